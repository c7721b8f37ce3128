"""Audio columns: byte payloads stored as 8-bit PCM, and their features as fixed-shape Arrow tensors.

Samples are resampled by a polyphase windowed-sinc filter (of each output sample only its
phase of the filter is computed), cut into overlapped frames, and brought to log-mel energies.
Segments are spans whose frame energy rose over an upper threshold and has not yet
fallen under a lower one. Features are stored as an Arrow stream of fixed-shape tensors
(FRAMES x MELS, the last one padded by zeros) with the time span of each.

Resampling and spectra go over BLOCK frames at a time, so beside a text's payload, its stored form and its
tensors (0.4 bytes for each byte) a long text needs some 20 MB of work space, whatever its length.

Cases: a null or empty text is 64 zero bytes; signals shorter than a frame are padded to
one; equal texts give equal bytes and features; very long texts are one row with more tensors; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices, texts_of

RATE, UP, DOWN, TAPS = 16_000, 3, 8, 24
FRAME, HOP, MELS, FRAMES = 240, 120, 32, 32
UPPER_DB, LOWER_DB = 1.0, -1.0
BLOCK = 4096  # frames


def payload_of(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """The filter's up phases, taps values each: a sinc under a Hann window, cut off at the lower of both rates."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cutoff = min(1.0, up / down) / up
    h = cutoff * np.sinc(cutoff * n) * np.hanning(up * taps + 2)[1:-1] * up
    return h.reshape(taps, up).T.astype(np.float32).copy()


def samples(payload: np.ndarray) -> np.ndarray:
    """8-bit samples as numbers from -1 to 1."""
    return (payload.astype(np.float32) - 128) / 128


def resample(x: np.ndarray, first: int = 0, last: int | None = None, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Of the len(x) * up / down samples, rounded up, those from first to last; each phase is one product of strided windows. x: numbers or 8-bit samples."""
    h = phases(up, down)
    taps = h.shape[1]
    n = -(-len(x) * up // down)
    last = n if last is None else min(last, n)
    first -= first % up  # a phase starts at the same place in every block
    begin = first * down // up - taps // 2
    end = begin + (last - first) * down // up + taps + down
    part = x[max(0, begin) : max(0, end)]
    part = samples(part) if part.dtype == np.uint8 else part
    padded = np.concatenate((np.zeros(max(0, -begin), np.float32), part, np.zeros(max(0, end - len(x)), np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(last - first, np.float32)
    for i in range(min(up, len(out))):
        count = -(-(len(out) - i) // up)
        out[i::up] = windows[i * down // up :: down][:count] @ h[(i * down) % up][::-1]
    return out


@lru_cache
def mel_filters(rate: float = RATE * UP / DOWN, fft: int = 256) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, (fft / 2 + 1) x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, fft // 2 + 1)[:, None]
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid))).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """frames x MELS of log energies, to three decimals."""
    if len(x) < FRAME:
        x = np.concatenate((x, np.zeros(FRAME - len(x), np.float32)))
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window
    power = np.abs(np.fft.rfft(frames, 256)) ** 2
    return np.round(np.log(power.astype(np.float32) @ mel_filters() + 1e-6), 3)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans, ends exclusive, by hysteresis about the median energy."""
    db = 10 / np.log(10) * mel.max(axis=1)
    level = float(np.median(db))
    turn = np.where(db > level + UPPER_DB, 1, np.where(db < level + LOWER_DB, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    on = np.where(last >= 0, turn[np.maximum(last, 0)], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


def to_tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of (tensor, frames, start_ms, end_ms)."""
    n = -(-len(mel) // FRAMES)
    full = np.zeros((n * FRAMES, MELS), np.float32)
    full[: len(mel)] = mel
    first = np.arange(n) * FRAMES
    used = np.minimum(FRAMES, len(mel) - first)
    ms = 1000 * DOWN / (RATE * UP)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * MELS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(used, pa.int32()), pa.array(first * HOP * ms), pa.array(((first + used - 1) * HOP + FRAME) * ms)], ["tensor", "frames", "start_ms", "end_ms"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def from_tensors(stored: bytes) -> np.ndarray:
    """The log-mel frames of a stored stream."""
    table = pa.ipc.open_stream(stored).read_all()
    parts = [c.to_numpy_ndarray() for c in table.column("tensor").chunks]
    used = int(sum(table.column("frames").to_pylist()))
    return np.concatenate(parts).reshape(-1, MELS)[:used]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text's bytes, padded, as a WAV of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(map(len, data), pa.int64()), pa.array([to_wav(payload_of(x)) for x in data], pa.binary())], [key, "n_bytes", "media"])

    return map_arrow(texts_of(docs, key, text=text), run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, tensors, segments) of stored media: the Arrow stream of log-mel tensors, and spans in milliseconds."""
    ms = HOP * 1000 * DOWN / (RATE * UP)
    span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            tensors, spans = [], []
            for x in batch.column(column).to_pylist():
                mel = mel_of(from_wav(x))
                tensors.append(to_tensors(mel))
                spans.append([{"start_ms": a * ms, "end_ms": b * ms} for a, b in segments(mel)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(tensors, pa.binary()), pa.array(spans, span)], [key, "tensors", "segments"])

    return map_arrow(media.select(key, column), run, f"{key} {media.schema[key].dataType.simpleString()}, tensors binary, segments array<struct<start_ms:double,end_ms:double>>")


def mel_of(payload: bytes) -> np.ndarray:
    """Log-mel frames of 8-bit samples, BLOCK frames at a time; blocks start at multiples of HOP * BLOCK, so frames don't depend on the cut."""
    x = np.frombuffer(payload, np.uint8)
    n = -(-len(x) * UP // DOWN)
    frames = max(1, 1 + (n - FRAME) // HOP)
    out = np.empty((frames, MELS), np.float32)
    for a in range(0, frames, BLOCK):
        b = min(a + BLOCK, frames)
        out[a:b] = log_mel(resample(x, a * HOP, (b - 1) * HOP + FRAME))
    return out


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text, reads it back, and gives digests of payload, stored form and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for stored in batch.column("media").to_pylist():
                payload = from_wav(stored)
                tensors = to_tensors(mel_of(payload))
                mel = from_tensors(tensors)
                spans = segments(mel)
                feature = f"{len(mel)}x{MELS};segments={len(spans)};on={sum(b - a for a, b in spans)};{hashlib.sha256(tensors).hexdigest()[:32]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(store(docs), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
