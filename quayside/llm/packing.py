"""Packing documents along a space-filling curve.

A document's token ids are hashed into a signed vector, projected to three dimensions, squashed to a grid and put
on a Hilbert curve. Documents are range-sorted by their place on it, and each range is cut into sequences of
exactly `length` ids, so neighbours on the curve share sequences. What is left at a range's end becomes sequences
whose lengths are powers of two, which need no padding either; so nothing is padded at all.

The range partitioning is by (key, id, text), so equal documents spread over as many tasks as they need, and a task
streams its rows and holds one sequence. Token ids are written once and moved once.

Nulls: a null text is empty; an empty document is its end id alone. A null id stands after all others. Repeated rows
are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import _SPACE, mapped, order_id, partitions_for, store, text_bytes, text_slices, word_spans

#: Words a worker remembers the ids of; beyond it, it keeps those of the batch at hand, which has the common ones.
CACHED = 300_000
#: Rows and bytes of ids after which pieces leave a worker, so that a batch is small with ids as well as without.
OUT_ROWS, OUT_BYTES = 4096, 4 << 20
BITS, DIMS, BUCKETS = 16, 3, 256


#: Words of the fast path: letters whose composed lower-case form is themselves, then signs that no contraction starts with.
_SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
_LETTERS = re.compile("[a-zß-öø-ÿ]*")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PROBES = ["ab", "the", "übung", "éa", "ß", "ÿ", "a.", "the,", "été!!", "x&&&", "%", "|", "***", "$$$", "a-", '"', "re", "ve.", "s", "naïve?!", "zz_", "q(", "ll", "d", "çñ;"]


def _byte_signs() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class WordTokenizer:
    """The ids of a tokenizer that never joins what white space parts, word by word, each new word encoded once.

    Exact: runs of the six ASCII spaces part words, which the tokenizer's own splitting never bridges. Capital A-Z
    are lowered first only if the text can hold no special token's string. Simple words go to the tokenizer's model
    piece by piece (letters, signs), if that gives what the whole tokenizer gives for the probes; others go through all of it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.inner.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.lowers = self.inner.normalizer is not None and self.inner.normalizer.normalize_str("A") == "a"
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self.signs = _byte_signs()
        self.fast = True
        try:
            self.fast = all(self._simple(w) == np.asarray(self.inner.encode(w, add_special_tokens=False).ids, self.kind).tobytes() for w in _PROBES)
        except Exception:  # a model without byte-level pieces
            self.fast = False

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > CACHED:
                self.pieces = {"": b""}
            plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
            ids = self.pieces[piece] = array(self.code, [t.id for t in self.inner.model.tokenize(plain)]).tobytes()
        return ids

    def _simple(self, word: str) -> bytes | None:
        if not self.fast:
            return None
        letters = word.rstrip(_SIGNS)
        if not (letters.isascii() and letters.islower() and letters.isalpha() or _LETTERS.fullmatch(letters)):
            return None
        return self._piece(letters) + self._piece(word[len(letters) :])

    def _learn(self, words: list[bytes]) -> None:
        hard = []
        for w in words:
            text = w.decode()
            ids = self._simple(text)
            if ids is None:
                hard.append((w, text))
            else:
                self.known[w] = ids
        for at in range(0, len(hard), 20_000):
            part = hard[at : at + 20_000]
            begins = np.cumsum([0] + [len(text) + 1 for _, text in part[:-1]])
            enc = self.inner.encode(" ".join(text for _, text in part), add_special_tokens=False)
            ids = np.asarray(enc.ids, self.kind)
            first = np.fromiter((o[0] for o in enc.offsets), np.int64, len(ids))
            cuts = np.searchsorted(first, begins).tolist() + [len(ids)]
            self.known.update((w, ids[a:b].tobytes()) for (w, _), a, b in zip(part, cuts, cuts[1:]))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        ids = list(map(self.known.get, words))
        at = [i for i, x in enumerate(ids) if x is None]
        for a in range(0, len(at), CACHED // 4):
            part = at[a : a + CACHED // 4]
            if len(self.known) + len(part) > CACHED:
                self.known = {w: x for w, x in zip(words[: CACHED // 2], ids) if x is not None}
            self._learn([words[i] for i in part])
            for i in part:
                ids[i] = self.known[words[i]]
        return ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. The batch's words are numbered first, so each different one is looked up once."""
        raw, borders = text_bytes(texts)
        if self.lowers and b"<|" in raw.tobytes() and len(borders) > 2:
            return [x for i in range(len(texts)) for x in self.encode(texts.slice(i, 1))]
        if self.lowers and b"<|" not in raw.tobytes():
            raw = _LOWER[raw]
        starts, ends, cuts = word_spans(raw, borders)
        if not len(starts):
            return [np.zeros(0, self.kind)] * len(texts)
        lengths = ends - starts
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        packed = raw[~_SPACE[raw]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)]).dictionary_encode()
        ids = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize
        table, begins = np.frombuffer(b"".join(ids), self.kind), np.cumsum(sizes) - sizes
        codes = np.asarray(words.indices)
        each = sizes[codes]
        places = np.cumsum(each)
        out = table[np.repeat(begins[codes] - places + each, each) + np.arange(places[-1])]
        edges = np.concatenate([[0], places])[cuts]
        return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


_tokenizers: dict[str, WordTokenizer] = {}
_kinds: dict[str, type] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
        _kinds[path] = _tokenizers[path].kind
    return _tokenizers[path]


def id_kind(path: str) -> type:
    """The width of ids as stored; the tokenizer and the words it remembers go, as nothing is left to encode."""
    if path not in _kinds:
        tokenizer(path)
    _tokenizers.clear()
    return _kinds[path]


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of grid (n, dims), by the transposition method of Skilling (2004)."""
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """The Hilbert key of each document from its hashed vector; documents without ids lie in the grid's middle."""
    rng = np.random.default_rng(seed)
    plane = rng.normal(size=(BUCKETS, DIMS))
    vectors = np.zeros((len(ids), BUCKETS))
    for i, x in enumerate(ids):
        h = x.astype(np.uint32) * np.uint32(2654435761)
        counts = np.bincount((h >> np.uint32(23)).astype(np.int64), minlength=2 * BUCKETS)
        vectors[i] = counts[:BUCKETS] - counts[BUCKETS:]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = (vectors / np.where(norms == 0, 1, norms)) @ plane
    unit = 1 / (1 + np.exp(-1.702 * flat))  # near the normal distribution's function: the grid's cells fill evenly
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenized(docs: DataFrame, path: str, at_once: int = 4 << 20) -> DataFrame:
    """doc_id, ord, key, ids (raw bytes), kind's width: written once. at_once: bytes of text that are encoded together, which
    takes more memory and less time the more they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for whole in batches:
            for a, b in text_slices(whole.column(2), at_once):
                batch = whole.slice(a, b - a)
                ids = tok.encode(batch.column(2))
                keys, raw = curve_keys(ids), [x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "ord", "key", "crc", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_id().alias("ord"), "text")
    return mapped(rows, run, "doc_id long, ord long, key long, crc long, ids binary")


def _powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, with_ids: bool = False, at_once: int = 4 << 20) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    rows = store(tokenized(docs, path, at_once))
    total = rows.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0]
    n = partitions_for(docs.sparkSession, total, 32 << 20)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = id_kind(path)
        sequence = TaskContext.get().partitionId() << 32
        out: list[list] = [[] for _ in names]
        open_: list[tuple[int, int, int, np.ndarray]] = []  # pieces of the sequence that isn't full yet
        room, held = length, 0

        def write(piece: tuple[int, int, int, np.ndarray], at: int) -> None:
            nonlocal held
            doc, start, tokens, ids = piece
            raw = ids.astype("<u4")
            held += raw.nbytes if with_ids else 0
            for column, value in zip(out, (doc, start, len(ids), zlib.crc32(raw.tobytes()), tokens, sequence, at, raw.view(np.int32))):
                column.append(value)

        def close(pieces: list[tuple[int, int, int, np.ndarray]]) -> None:
            nonlocal sequence
            at = 0
            for piece in pieces:
                write(piece, at)
                at += len(piece[3])
            sequence += 1

        def emit() -> pa.RecordBatch:
            nonlocal held
            held = 0
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(np.frombuffer(raw.as_buffer(), kind).astype(np.uint32), np.uint32(end_id))
                start = 0
                while start < len(ids):
                    part = ids[start : start + room]
                    open_.append((doc, start, len(ids), part))
                    start += len(part)
                    room -= len(part)
                    if not room:
                        close(open_)
                        open_, room = [], length
                        if len(out[0]) >= OUT_ROWS or held >= OUT_BYTES:
                            yield emit()
        for size in _powers_of_two(length - room):  # the range's tail
            taken: list[tuple[int, int, int, np.ndarray]] = []
            while size:
                doc, start, tokens, ids = open_.pop(0)
                if len(ids) > size:
                    open_.insert(0, (doc, start + size, tokens, ids[size:]))
                    ids = ids[:size]
                taken.append((doc, start, tokens, ids))
                size -= len(ids)
            close(taken)
        yield emit()

    ordered = rows.repartitionByRange(n, "key", "ord", "crc").sortWithinPartitions("key", "ord", "crc").select("doc_id", "ids")
    schema = ", ".join(f"`{c}` long" for c in names[:7]) + ", ids array<int>" * with_ids
    return mapped(ordered, run, schema)
