"""Keyed permutations of an integer range and of strings of a fixed shape."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from functools import cache

ROUNDS = 8
#: Texts with fewer values of their shape than this may be lengthened.
SMALL = 1 << 24

#: Letters that may stand for each other, by script, case and sound.
ALPHABETS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789",
    "àáâãäåèéêëìíîïòóôõöùúûü", "çñšžčřğşłßðþ", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "ÇÑŠŽČŘĞŞŁÐÞ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
HEX = ["0123456789abcdef", "0123456789ABCDEF"]
_PLACE = {c: (k, i) for k, a in enumerate(ALPHABETS) for i, c in enumerate(a)}


def _bits(key: bytes, label: bytes, x: int, bits: int) -> int:
    n = (bits + 7) // 8
    raw = b""
    block = 0
    while len(raw) < n:
        raw += hmac.new(key, label + block.to_bytes(2, "big") + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), hashlib.sha256).digest()
        block += 1
    return int.from_bytes(raw[:n], "big") & ((1 << bits) - 1)


def feistel(x: int, n: int, key: bytes, label: bytes, back: bool = False) -> int:
    """A keyed permutation of range(n): a balanced Feistel network over the next even power of two, walked until
    the value lies in the range again."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            tag = label + bytes([r])
            if back:
                left, right = right ^ _bits(key, tag, left, half), left
            else:
                left, right = right, left ^ _bits(key, tag, right, half)
        x = left << half | right
        if x < n:
            return x


def moved(x: int, n: int, key: bytes, label: bytes) -> int:
    """A keyed permutation of range(n) that leaves no value where it is (n > 1): one step in the hidden order."""
    return feistel((feistel(x, n, key, label) + 1) % n, n, key, label, back=True) if n > 1 else x


def _kind(c: str) -> tuple[str, str, bool] | None:
    """Category, script (the first word of the name) and whether case can be put on and taken off; None but for letters and digits."""
    if not c.isalnum():
        return None
    return unicodedata.category(c), unicodedata.name(c, "?").split()[0], len(c.upper()) == 1 and c.upper().lower() == c.lower()


@cache
def alphabet(c: str) -> str:
    """What may stand for c: its list in ALPHABETS, else the letters or digits of its kind and script among the 128 code points
    around it, else c alone. These sets don't overlap, so a text and its surrogates have one shape."""
    if c in _PLACE:
        return ALPHABETS[_PLACE[c][0]]
    kind, first = _kind(c), ord(c) & ~0x7F
    near = [d for d in map(chr, range(first, first + 128)) if d not in _PLACE and kind and _kind(d) == kind]
    return "".join(near) or c


def shape(text: str, alphabets: list[str] | None = None) -> list[str]:
    """The alphabet of each character."""
    if alphabets:
        return [next((a for a in alphabets if c in a), c) for c in text]
    return [alphabet(c) for c in text]


def move_text(text: str, key: bytes, label: bytes, alphabets: list[str] | None = None, longer: int | None = None) -> str:
    """Another text of the same shape; two texts never become the same one.

    With longer, a text whose shape has under SMALL values gets that many letters of its own script before it, and one more
    at least if there is no other value: so it never stays as it is, and any number of texts finds room."""
    kinds = shape(text, alphabets)
    n = 1
    for a in kinds:
        n *= len(a)
    if longer is not None and n < SMALL:
        own = next((a for c, a in zip(text, kinds) if c.isalpha() and len(a) > 1), ALPHABETS[1])
        more = max(longer, 1 if n == 1 else 0)
        kinds, text = [own] * more + kinds, own[0] * more + text
    x, n = 0, 1
    for c, a in zip(text, kinds):
        x, n = x * len(a) + a.index(c), n * len(a)
    x = moved(x, n, key, label)
    out = []
    for a in reversed(kinds):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))
