"""Media columns: audio features.

Bytes are stored as 8-bit mono PCM in a WAV file and read back; the samples of a file are resampled by a polyphase
filter (UP / DOWN of the rate, UP phases), cut into overlapping frames, turned into log-mel bands and segmented by energy
with hysteresis (a segment opens above a high threshold and stays until the energy falls below a low one). The bands have
half precision and are kept as a fixed-shape tensor (PATCH frames x MELS, the last one padded with the floor) for each
patch, with its time span.

Signals are worked on in chunks of samples, with the filter's and the frames' overlap carried over. A document's bytes,
its media and its bands (MELS / (HOP * DOWN / UP) half floats a byte) are held whole, so a task's memory follows its
longest text, some times over, and nothing else.

Nulls: a null text is empty; an empty payload is padded to the least size. A null id stays null. Repeated rows get equal
values, each its own file. An empty table gives an empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import mapped

#: From 16 to 6 kHz by three phases; frames of 40 ms, half of them overlapping.
RATE, UP, DOWN, TAPS = 16_000, 3, 8, 24
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, FFT, MELS, PATCH = 240, 120, 256, 40, 96
FLOOR = 1e-6
#: Segments open above HIGH and close below LOW, as parts of the way from a file's quiet frames (their 20th percentile of
#: log energy) to its loud ones (the 95th); shorter ones than SHORT frames are dropped.
HIGH, LOW, SHORT = 0.6, 0.3, 3
_CHUNK = 1 << 18
UNIT = 64


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM: the payload's bytes are the samples (an odd number of them is followed by a pad byte)."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def unwav(media: bytes) -> tuple[bytes, int]:
    """The samples' bytes and the rate of an 8-bit mono PCM file; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw)), len(raw)


@cache
def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Phases (up x taps) of a Hann-windowed sinc that cuts at the lower of both rates."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(cut * t) * cut * np.hanning(n + 2)[1:-1]
    h = (h / h.sum() * up).astype(np.float32)
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1])


def resample(x: np.ndarray, first: int, count: int, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """count output samples from the first on; x holds the input from sample first * down // up - taps + 1 on."""
    phases = low_pass(up, down, taps)
    out = np.empty(count, np.float32)
    base = first * down // up
    windows = np.lib.stride_tricks.sliding_window_view(x, taps)
    for p in range(min(up, count)):  # outputs of one phase are a dot product with a regular stride of windows
        k = np.arange(p, count, up)
        places = (first + k) * down // up - base
        phase = (first + p) * down % up
        out[p::up] = windows[places[0] : places[-1] + 1 : max(1, (places[1] - places[0]) if len(places) > 1 else 1)] @ phases[phase]
    return out


@cache
def mel_bank(rate: int = OUT_RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles (fft // 2 + 1 x mels) evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    bank = np.minimum((f[:, None] - left) / (mid - left), (right - f[:, None]) / (right - mid))
    bank = np.maximum(bank, 0)
    near = np.abs(f[:, None] - mid).argmin(axis=0)
    bank[near, np.arange(mels)] = np.maximum(bank[near, np.arange(mels)], 1e-3)  # no band without a bin
    return bank.astype(np.float32)


def log_mels(payload: bytes) -> Iterator[np.ndarray]:
    """Frames x MELS of half precision, chunk by chunk. The signal is followed by silence until the last frame is whole."""
    window = np.hanning(FRAME).astype(np.float32)
    bank = mel_bank()
    samples = np.frombuffer(payload, np.uint8)
    total = max(1, len(samples) * UP // DOWN)
    frames = 1 + max(0, -(-(total - FRAME) // HOP))
    per_chunk = max(1, _CHUNK // HOP)
    for first in range(0, frames, per_chunk):
        n = min(per_chunk, frames - first)
        start, count = first * HOP, (n - 1) * HOP + FRAME
        low = start * DOWN // UP - TAPS + 1
        high = (start + count - 1) * DOWN // UP + 1
        x = np.zeros(high - low, np.float32)
        a, b = max(0, low), min(len(samples), high)
        if b > a:
            x[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
        signal = resample(x, start, count)
        cut = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(cut * window, FFT, axis=1)) ** 2
        yield np.log(power.astype(np.float32) @ bank + FLOOR).astype(np.float16)


@dataclass
class Segmenter:
    """Hysteresis over the frames' energies, which come chunk by chunk; spans in frames."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    open_at: int | None = None
    at: int = 0

    def feed(self, energy: np.ndarray, quiet: float, loud: float) -> None:
        high, low = energy > quiet + HIGH * (loud - quiet), energy < quiet + LOW * (loud - quiet)
        for i in np.flatnonzero(high | low).tolist():
            if high[i] and self.open_at is None:
                self.open_at = self.at + i
            elif low[i] and self.open_at is not None:
                self.close(self.at + i)
        self.at += len(energy)

    def close(self, end: int) -> None:
        if self.open_at is not None and end - self.open_at >= SHORT:
            self.spans.append((self.open_at, end))
        self.open_at = None


@dataclass(frozen=True)
class Features:
    frames: int
    mean: np.ndarray
    spread: np.ndarray
    spans: list[tuple[int, int]]
    patches: list[np.ndarray]

    def digest(self) -> str:
        """frames, segments, voiced frames and each band's mean and spread in eighths, as text."""
        voiced = sum(b - a for a, b in self.spans)
        levels = np.clip(np.round(np.concatenate([self.mean, self.spread]) * 8) + 128, 0, 255).astype(np.uint8)
        return f"{self.frames}:{len(self.spans)}:{voiced}:{levels.tobytes().hex()}"


def features(payload: bytes, patches: bool = False) -> Features:
    return features_of(log_mels(payload), patches)


def features_of(blocks: Iterator[np.ndarray], patches: bool = False) -> Features:
    """blocks: the frames as log_mels cuts them."""
    n, total, squares = 0, np.zeros(MELS), np.zeros(MELS)
    energies, kept = [], []
    for block in blocks:
        block = block.astype(np.float32)
        n += len(block)
        total += block.sum(axis=0, dtype=np.float64)
        squares += np.einsum("ij,ij->j", block, block, dtype=np.float64)
        energies.append(block.mean(axis=1))
        if patches:
            kept.append(block.astype(np.float16))
    mean = total / n
    energy = np.concatenate(energies)
    segmenter = Segmenter()
    segmenter.feed(energy, *np.percentile(energy, [20, 95]).tolist())
    segmenter.close(len(energy))
    out = patched(kept) if patches else []
    return Features(n, mean, np.sqrt(np.maximum(0, squares / n - mean**2)), segmenter.spans, out)


def patched(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """PATCH frames each; the last one is padded with the floor."""
    whole = np.concatenate(blocks)
    out = []
    for a in range(0, len(whole), PATCH):
        patch = np.full((PATCH, MELS), np.log(FLOOR), np.float16)
        patch[: min(PATCH, len(whole) - a)] = whole[a : a + PATCH]
        out.append(patch)
    return out


TENSOR = "STRUCT<start_s: DOUBLE, end_s: DOUBLE, shape: ARRAY<INT>, values: ARRAY<FLOAT>>"


def stored(docs: DataFrame, media: bool = False, tensors: bool = False) -> DataFrame:
    """A row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    segments (time spans in seconds) and, if asked for, the media file itself and the log-mel tensors with their spans."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments array<struct<start_s: double, end_s: double>>"
    schema += ", media binary" * media + f", tensors array<{TENSOR}>" * tensors
    out_schema = docs.sparkSession.createDataFrame([], schema).schema
    hop = HOP / OUT_RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload, n = payload_of(text)
                file = wav(payload)
                back, _ = unwav(file)
                found = features(back, tensors)
                row = {"doc_id": doc, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:])}
                row |= {"media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": found.digest(), "segments": [{"start_s": a * hop, "end_s": b * hop} for a, b in found.spans]}
                if media:
                    row["media"] = file
                if tensors:
                    row["tensors"] = [{"start_s": i * PATCH * hop, "end_s": min((i + 1) * PATCH, found.frames) * hop, "shape": [PATCH, MELS], "values": p.ravel().astype(np.float32)} for i, p in enumerate(found.patches)]
                rows.append(row)
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, out_schema)


def tensor_batch(patches: list[np.ndarray]) -> pa.Array:
    """The patches as one Arrow array of the canonical fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float16(), [PATCH, MELS])
    flat = np.concatenate([p.ravel() for p in patches]) if patches else np.zeros(0, np.float16)
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float16()), PATCH * MELS))


#: Of the compression of what is stored.
LEVEL = 3
#: Patches and bytes of media that one row of the stored form holds, unless a single document has more.
_ROW_PATCHES, _ROW_BYTES = 128, 1 << 20


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def files(docs: DataFrame) -> DataFrame:
    """The form of storage, a row a few documents, as two Arrow streams: media (doc_id, n_bytes, the WAV file) and tensors
    (doc, the row in media; start_s, end_s, tensor, of the fixed-shape type, for each patch)."""
    hop = HOP / OUT_RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, media, at, starts, ends, patches = held = tuple([] for _ in range(7))

        def out() -> pa.RecordBatch:
            a = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
            b = pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), tensor_batch(patches)], names=["doc", "start_s", "end_s", "tensor"])
            row = pa.RecordBatch.from_arrays([pa.array([_ipc(a)], pa.binary()), pa.array([_ipc(b)], pa.binary())], names=["media", "tensors"])
            for x in held:
                x.clear()
            return row

        for batch in batches:
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload, n = payload_of(text)
                blocks = list(log_mels(payload))
                frames = sum(map(len, blocks))
                own = patched(blocks)
                if ids and (len(patches) + len(own) > _ROW_PATCHES or size + len(payload) > _ROW_BYTES):
                    yield out()
                    size = 0
                at.extend([len(ids)] * len(own))
                starts.extend(i * PATCH * hop for i in range(len(own)))
                ends.extend(min((i + 1) * PATCH, frames) * hop for i in range(len(own)))
                patches.extend(own)
                ids.append(doc)
                lengths.append(n)
                media.append(wav(payload))
                size += len(payload)
            if ids:
                yield out()

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "media binary, tensors binary")


def read_back(stored_: DataFrame) -> DataFrame:
    """The columns of stored, but for media and tensors, made from a table of files alone: digests from the media, feature
    and segments from the tensors."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments array<struct<start_s: double, end_s: double>>"
    out_schema = stored_.sparkSession.createDataFrame([], schema).schema
    hop = HOP / OUT_RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        per_block = max(1, _CHUNK // HOP)
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1)):
                docs = pa.ipc.open_stream(one.as_buffer()).read_next_batch()
                cut = pa.ipc.open_stream(other.as_buffer()).read_next_batch()
                values = cut.column(3).to_numpy_ndarray()
                edges = np.searchsorted(cut.column(0).to_numpy(), np.arange(docs.num_rows + 1))
                last = cut.column(2).to_numpy()
                rows = []
                for i, (doc, n, file) in enumerate(zip(*(c.to_pylist() for c in docs.columns))):
                    back, _ = unwav(file)
                    frames = round(last[edges[i + 1] - 1] / hop)
                    whole = values[edges[i] : edges[i + 1]].reshape(-1, MELS)[:frames]
                    found = features_of(whole[a : a + per_block] for a in range(0, frames, per_block))
                    row = {"doc_id": doc, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:])}
                    rows.append(row | {"media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": found.digest(), "segments": [{"start_s": a * hop, "end_s": b * hop} for a, b in found.spans]})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return mapped(stored_.select("media", "tensors"), run, out_schema)
