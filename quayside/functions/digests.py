"""Digests, checksums and message authentication as columns."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: sha256 with 64 or sha512 with 128 hex digits.
DIGEST = r"^(sha256:[0-9A-Fa-f]{64}|sha512:[0-9A-Fa-f]{128})$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_digest(c: str | Column) -> Column:
    return F.coalesce(_col(c).rlike(DIGEST), F.lit(False))


def parse_digest(c: str | Column) -> Column:
    """STRUCT<algorithm, hex> in canonical lower case; null if it isn't a digest."""
    low = F.split(F.lower(_col(c)), ":")
    return F.when(is_digest(c), F.struct(low[0].alias("algorithm"), low[1].alias("hex")))


def digest_of(content: str | Column, algorithm: str = "sha256") -> Column:
    """algorithm:hex of the content; an algorithm that isn't known counts as sha256."""
    bits = 512 if algorithm == "sha512" else 256
    return F.concat(F.lit("sha512:" if bits == 512 else "sha256:"), F.sha2(_col(content), bits))


def matches_digest(content: str | Column, digest: str | Column) -> Column:
    """Whether the content hashes to the digest, by the digest's own algorithm."""
    wide = F.lower(_col(digest)).startswith("sha512:")
    return F.coalesce(F.lower(_col(digest)) == F.when(wide, digest_of(content, "sha512")).otherwise(digest_of(content)), F.lit(False))


def hmac_sha256(message: str | Column, key: bytes) -> Column:
    """Hex of the keyed hash (RFC 2104) with the pads made on the driver, so it is one expression of built-in functions."""
    import hashlib

    if len(key) < 32:
        raise ValueError("the key has fewer than 32 bytes")
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), _col(message).cast("binary")), 256))), 256)


@cache
def _crc32c_table() -> np.ndarray:
    """CRC-32C (Castagnoli, reflected polynomial 0x82F63B78) of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


#: Bytes of a lane; lanes of an input go through the table together.
_LANE = 64


@cache
def _shift(level: int) -> np.ndarray:
    """What _LANE << level zero bytes make of a CRC: the sum of a table entry (4 x 256) for each of its bytes."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if level:
        return _shifted(_shifted(values, level - 1), level - 1)
    table = _crc32c_table()
    for _ in range(_LANE):
        values = table[values & 0xFF] ^ (values >> np.uint32(8))
    return values


def _shifted(values: np.ndarray, level: int) -> np.ndarray:
    t = _shift(level)
    return t[0][values & 0xFF] ^ t[1][values >> np.uint32(8) & 0xFF] ^ t[2][values >> np.uint32(16) & 0xFF] ^ t[3][values >> np.uint32(24)]


def crc32c(data: bytes) -> int:
    """Whole lanes are run side by side and joined in pairs; lanes of zeros before the first make their number a power of
    two, which a state of zero doesn't notice."""
    table, lanes, value = _crc32c_table(), len(data) // _LANE, 0xFFFFFFFF
    if lanes > 1:
        width = 1 << (lanes - 1).bit_length()
        state = np.zeros(width, np.uint32)
        state[width - lanes] = value
        rows = np.zeros((width, _LANE), np.uint8)
        rows[width - lanes :] = np.frombuffer(data, np.uint8, lanes * _LANE).reshape(lanes, _LANE)
        for column in rows.T:
            state = table[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
        level = 0
        while len(state) > 1:
            state = _shifted(state[0::2], level) ^ state[1::2]
            level += 1
        value, data = int(state[0]), data[lanes * _LANE :]
    for b in data:
        value = int(table[(value ^ b) & 0xFF]) ^ (value >> 8)
    return value ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def crc32c_col(content: pd.Series) -> pd.Series:
    """CRC-32C of each binary value; null stays null. There is no built-in one."""
    return content.map(lambda b: crc32c(bytes(b)), na_action="ignore").astype("Int64")
