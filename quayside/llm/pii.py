"""Personal data and secrets: detection and surrogates.

Entities: e-mail addresses, IPv4 addresses, payment card numbers (whether or not the check digit holds), phone numbers, US social security numbers, IBANs,
long hexadecimal and well-known access tokens, and names after a title that shows the gender. Each is reduced to a
canonical form (case, separators), which a keyed permutation of all values of the same shape maps to its surrogate;
the surrogate then takes the case and separators of the text it stands in. A permutation keeps different entities
different, the canonical form and the key keep equal ones equal in all documents and runs, and no value maps to
itself: letters of any script move among their like, and a text with no other value of its shape (one letter, say) gets
longer. Cards keep their first digit, cards and IBANs whether their check digits hold, addresses keep script and
separators, first names come from the list of their gender where they are on it.

Collision check: over the corpus' distinct entities, a surrogate must be no entity of the corpus, and no two may be
the same. Those that are get another permutation (of a longer shape if the shape has few values), round after round; only
they are checked again. What ROUNDS rounds leave, as where a format's values are all taken, is masked by its kind and a
keyed hash of 128 bits. The exceptions are a table (empty or tiny as a rule) that is joined to the texts that need it.

Overlaps and ties: of overlapping entities the longest holds, of equally long ones the first kind of PATTERNS, then the
first place. Nulls: a null text stays null; a null id stands for itself. Texts without entities stay as they are. Repeated
rows get equal surrogates. A long text is worked on whole, in time about in proportion to it. An empty table gives an
empty result. Columns other than text are passed through; one named as the count is an error, any other name is free.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import Stored, mapped, text_key
from quayside.llm.permute import HEX, move_text, moved

#: For tests and benchmarks; a production key comes from the caller.
DEFAULT_KEY = b"quayside surrogate key"
#: Rounds of the collision check; each leaves about the share of the value range that is taken.
ROUNDS = 20
#: The attempt that stands for a mask.
MASKED = -1

#: First names by gender; a permutation of each list serves names that are on it.
FIRST_NAMES = {
    "f": ["Anna", "Clara", "Elena", "Emma", "Eva", "Hanna", "Ines", "Julia", "Laura", "Lena", "Lucia", "Maria", "Marta", "Nina", "Nora", "Paula", "Rosa", "Sara", "Sofia", "Vera"],
    "m": ["Adam", "Anton", "Bruno", "Carlos", "David", "Emil", "Felix", "Hugo", "Ivan", "Jakob", "John", "Karl", "Leo", "Lukas", "Marco", "Martin", "Oskar", "Paul", "Peter", "Tomas"],
}
#: Titles that show a gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"]}

_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
PATTERNS: dict[str, re.Pattern] = {
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@[\w-]+(?:\.[\w-]+)+"),
    "token": re.compile(r"(?<![\w])(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,})(?![\w])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "phone": re.compile(r"(?<![\w+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])|(?<![\w])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w]|\.[0-9])"),
    "name": re.compile(r"(?<!\w)(?:%s)\.? +(%s(?: +%s)?)" % ("|".join(t for g in TITLES.values() for t in g), _NAME, _NAME)),
}
_GENDER = {t: g for g, own in TITLES.items() for t in own}
_DIGIT = re.compile("[0-9]")
_TITLE = re.compile(r"(?<!\w)(?:%s)\.? " % "|".join(_GENDER))


def luhn(digits: str) -> int:
    """The check digit that digits ask for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _checks(iban: str) -> bool:
    """Whether an IBAN's check digits hold."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _opens(name: str) -> bool:
    """Whether it begins as names do: with a capital, or in a script that has none."""
    return name[0] == name[0].title()


Entity = tuple[int, int, str, str]


def _made_up(text: str, x: Entity, found: list[Entity]) -> bool:
    """Whether shorter entities side by side hold all letters and digits of x, as a phone number and an SSN do in a card's
    span. found: all candidates, from left to right."""
    at = x[0]
    for i in range(bisect_left(found, (x[0],)), len(found)):
        y = found[i]
        if y[0] >= x[1]:
            break
        if y[0] >= at and y[1] <= x[1] and y[:2] != x[:2]:
            if any(c.isalnum() for c in text[at : y[0]]):
                return False
            at = y[1]
    return at > x[0] and not any(c.isalnum() for c in text[at : x[1]])


def _apart(found: list[Entity], text: str) -> list[Entity]:
    """Of candidates those that hold, from left to right. The ones taken lie apart, so only the neighbours of a place count."""
    rank = {k: i for i, k in enumerate(PATTERNS)}
    found = sorted(found)
    out: list[Entity] = []
    for x in sorted(found, key=lambda x: (x[0] - x[1], rank.get(x[2], 99), x[0])):
        i = bisect_left(out, x)
        free = (i == 0 or out[i - 1][1] <= x[0]) and (i == len(out) or out[i][0] >= x[1])
        if free and not _made_up(text, x, found):
            insort(out, x)
    return out


def find(text: str) -> list[Entity]:
    """start, end, kind, canonical form of each entity, from left to right, none inside another: of those that overlap the
    longest (an address, not the phone number that three of its parts look like), of equally long ones the first kind."""
    digits = _DIGIT.search(text) is not None
    found = []
    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text or kind == "name" and not _TITLE.search(text) or kind in ("iban", "phone", "ssn", "card", "ip") and not digits:
            continue
        for m in pattern.finditer(text):
            if kind == "name":
                if _opens(m.group(1)):
                    gender = _GENDER[re.match(r"[^\W\d_]+", m.group(0)).group(0)]
                    at = m.start(1)
                    parts = [x for x in re.finditer(_NAME, m.group(1)) if _opens(x.group(0))]
                    for i, part in enumerate(parts):
                        found.append((at + part.start(), at + part.end(), f"first_{gender}" if i == 0 and len(parts) > 1 else "surname", part.group(0).lower()))
            elif kind == "phone" and not 7 <= sum(c.isdigit() for c in m.group(0)) <= 15:
                continue
            else:
                value = m.group(0)
                canonical = value.lower() if kind == "email" else "".join(c for c in value if c.isdigit()) if kind in ("phone", "ssn", "card") else value.replace(" ", "") if kind == "iban" else value
                found.append((*m.span(), kind, canonical))
    return _apart(found, text)


def mask(kind: str, canonical: str, key: bytes) -> str:
    return f"[{kind} {hmac.new(key, f'{kind}/{canonical}'.encode(), hashlib.sha256).hexdigest()[:32]}]"


def _card(canonical: str, key: bytes, label: bytes) -> str:
    body, gap = canonical[:-1], (int(canonical[-1]) - luhn(canonical[:-1])) % 10
    n = 10 ** (len(body) - 1)
    x = int(body[1:])
    if gap:  # the check digit doesn't hold; neither does the surrogate's
        x, g = divmod(moved(x * 9 + gap - 1, n * 9, key, label + b"odd"), 9)
        gap = g + 1
    else:
        x = moved(x, n, key, label)
    body = body[0] + str(x).zfill(len(body) - 1)
    return body + str((luhn(body) + gap) % 10)


def _iban(canonical: str, key: bytes, label: bytes) -> str:
    country = canonical[:2]
    if _checks(canonical):
        rest = move_text(canonical[4:], key, label + country.encode())
        digits = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
        return f"{country}{98 - digits % 97:02d}{rest}"
    out = canonical
    while out == canonical or _checks(out):  # on until the check digits don't hold again
        out = country + move_text(out[2:], key, label + b"odd" + country.encode())
    return out


def _first_name(canonical: str, gender: str, key: bytes, label: bytes, attempt: int) -> str:
    names = [n.lower() for n in FIRST_NAMES[gender]]
    if canonical in names:
        return names[moved(names.index(canonical), len(names), key, label)]
    if len(canonical) == 1:
        return move_text(canonical, key, label, longer=attempt)
    # another name keeps its last letter, which often tells the gender, and never becomes one of the list
    while True:
        stem = move_text(canonical[:-1], key, label + canonical[-1:].encode(), longer=attempt)
        if stem + canonical[-1:] not in names:
            return stem + canonical[-1:]
        canonical = stem + canonical[-1:]


def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the surrogate."""
    label = f"{kind}/{attempt}/".encode()
    if attempt == MASKED:
        return mask(kind, canonical, key)
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, canonical.split("."))), "big")
        return ".".join(map(str, moved(x, 1 << 32, key, label).to_bytes(4, "big")))
    if kind == "card":
        return _card(canonical, key, label)
    if kind == "iban":
        return _iban(canonical, key, label)
    if kind in SHARED:
        return _first_name(canonical, kind[-1], key, label, attempt)
    if kind == "phone" and len(canonical) > 10:
        return canonical[:-10] + move_text(canonical[-10:], key, label + canonical[:-10].encode())
    if kind == "email":
        local, _, domain = canonical.partition("@")
        # the last label of the domain stays; what comes before it is one value with the local part
        stem, dot, top = domain.rpartition(".")
        both = move_text(f"{local}@{stem}", key, label, longer=attempt)
        return f"{both}{dot}{top}"
    if kind == "token":
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", canonical):
            return move_text(canonical, key, label, HEX[:1] if canonical == canonical.lower() else HEX[1:])
        head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-|", canonical).group(0)
        return head + move_text(canonical[len(head) :], key, label)
    return move_text(canonical, key, label, longer=attempt if kind == "surname" else None)


def dress(value: str, like: str, kind: str) -> str:
    """A surrogate with the separators and case of the text that it replaces. A mask stays as it is."""
    if value.startswith("["):
        return value
    if kind in ("phone", "ssn", "card", "iban"):
        rest = iter(value)
        return "".join(next(rest) if c.isalnum() else c for c in like)
    if kind in ("email", "surname", "first_f", "first_m"):
        if like == like.lower():
            return value
        if like == like.upper() and len(like) > 1:
            return value.upper()
        if len(like) == len(value):
            return "".join(v.upper() if c.isupper() else v for v, c in zip(value, like))
        return value[:1].upper() + value[1:]
    return value


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, int]:
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, canonical in found:
        value = surrogate(kind, canonical, key, (attempts or {}).get((kind, canonical), 0))
        out += [text[at:start], dress(value, text[start:end], kind)]
        at = end
    return "".join(out) + text[at:], len(found)


def entities(docs: DataFrame) -> DataFrame:
    """t1, t2, kind, canonical: a row for each document and entity in it; t1 and t2 stand for its text."""
    names = ["t1", "t2", "kind", "canonical"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, values = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for kind, value in sorted({x[2:] for x in find(text or "")}):
                    rows.append(i)
                    kinds.append(kind)
                    values.append(value)
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.string()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(docs.select(*text_key(), "text"), run, "t1 long, t2 long, kind string, canonical string")


def with_surrogates(rows: DataFrame, key: bytes) -> DataFrame:
    """rows: kind, canonical, attempt. Adds surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, c, key, a) for k, c, a in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    return mapped(rows.select("kind", "canonical", F.col("attempt").cast("int").alias("attempt")), run, "kind string, canonical string, attempt int, surrogate string")


#: Kinds with lists, whose names are all surrogates of each other and so may be a name of the corpus.
SHARED = ["first_f", "first_m"]


def _fresh(candidates: DataFrame, real: DataFrame, settled: DataFrame | None) -> DataFrame:
    """candidates with again: whether the surrogate is an entity, is taken already, or an earlier candidate has it."""
    place = ["kind", "surrogate"]
    listed = F.lit(False)
    for kind in SHARED:
        listed |= (F.col("kind") == kind) & F.col("canonical").isin([n.lower() for n in FIRST_NAMES[kind[-1]]])
    asked = candidates.select(*place)
    taken = real.select("kind", F.col("canonical").alias("surrogate")).join(asked, place).select(*place)
    if settled is not None:
        taken = taken.unionAll(settled.select(*place).join(asked, place).select(*place))
    taken = taken.distinct().withColumn("taken", F.lit(True))
    first = candidates.groupBy(*place).agg(F.min("canonical").alias("first"))
    out = candidates.join(taken, place, "left").join(first, place)
    again = (F.coalesce("taken", F.lit(False)) | (F.col("first") != F.col("canonical"))) & ~listed
    return out.select("kind", "canonical", "attempt", "surrogate", again.alias("again"))


def assignments(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canonical, attempt, surrogate of each distinct entity, after the collision check. The first round is over all
    entities; each later one only looks at those that the one before left."""
    real = Stored(found.select("kind", "canonical").distinct())
    moving, settled = real.df.withColumn("attempt", F.lit(0)), None
    for turn in range(ROUNDS):
        marked = Stored(_fresh(with_surrogates(moving, key), real.df, settled))
        own = marked.df.filter("NOT again").drop("again")
        settled = own if settled is None else settled.unionAll(own)
        left = marked.df.filter("again")
        if left.isEmpty():
            return settled
        moving = left.select("kind", "canonical", F.lit(turn + 1 if turn + 1 < ROUNDS else MASKED).alias("attempt"))
    return settled.unionAll(with_surrogates(moving, key))


def pseudonymized(docs: DataFrame, key: bytes = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """docs with surrogates in text (and, if asked for, the number of entities replaced in the column count)."""
    if count in docs.columns:
        raise ValueError(f"{count} is a column already")
    found = Stored(entities(docs))
    odd = Stored(assignments(found.df, key).filter("attempt <> 0").select("kind", "canonical", "attempt"))
    plain = docs.schema.names
    rows = docs
    if not odd.df.isEmpty():
        own = found.df.join(odd.df, ["kind", "canonical"]).groupBy("t1", "t2").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("odd"))
        own = Stored(own).df
        # the rows of docs as one column, so that names of its own can't clash
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("row"), *text_key())
        joined = whole.join(own, ["t1", "t2"], "left")
        rows = joined.select("row.*", "odd")
    found.drop()
    at, last = plain.index("text"), len(plain)
    out = T.StructType([*docs.schema.fields, *([T.StructField(count, T.IntegerType())] if count else [])])
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd_ones = batch.column(last).to_pylist() if batch.num_columns > last else [None] * batch.num_rows
            texts, numbers = [], []
            for text, own in zip(batch.column(at).to_pylist(), odd_ones):
                new, n = rewrite(text, key, {(x["kind"], x["canonical"]): x["attempt"] for x in own or []}) if text is not None else (None, 0)
                texts.append(new)
                numbers.append(n)
            columns = batch.columns[:last]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(numbers, pa.int32())] * bool(count), names=names)

    return mapped(rows, run, out)
