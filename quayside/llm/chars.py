"""Code points of many texts at once and their classes, in all planes."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

LOWER, UPPER, DIGIT, SPACE, POINT, CRY, SYMBOL, BREAK = range(8)
N_CLASSES = 8
#: The first plane has a table; the few code points above it in a batch are looked up one by one.
_TABLE = 1 << 16


def _class(c: str) -> int:
    if c == "\n":
        return BREAK
    if c in "!?":
        return CRY
    if c in "#%&*@\\|/_~^":
        return SYMBOL
    kind = unicodedata.category(c)
    return UPPER if kind == "Lu" else {"N": DIGIT, "Z": SPACE, "C": SPACE, "S": SYMBOL, "P": POINT}.get(kind[0], LOWER)


@cache
def _classes() -> np.ndarray:
    return np.array([_class(chr(c)) for c in range(_TABLE)], np.uint8)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_TABLE)])


def _looked_up(codes: np.ndarray, known: np.ndarray, of) -> np.ndarray:
    out = known[np.minimum(codes, _TABLE - 1)]
    high = np.flatnonzero(codes >= _TABLE)
    if len(high):
        found, which = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([of(chr(c)) for c in found.tolist()], known.dtype)[which]
    return out


def classes(codes: np.ndarray) -> np.ndarray:
    return _looked_up(codes, _classes(), _class)


def letters(codes: np.ndarray) -> np.ndarray:
    return _looked_up(codes, _letters(), str.isalpha)


def code_points(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row and the len + 1 borders; null is empty."""
    parts = [t or "" for t in texts.to_pylist()]
    if lower:
        parts = [t.lower() for t in parts]
    borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), borders
