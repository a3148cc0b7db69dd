"""Media columns: audio stored losslessly, and its features as fixed-shape tensors with time spans.

A payload of 8-bit samples is stored as a WAV file (mono, 8 bit, RATE samples a
second) in a binary column and read back from those bytes. A polyphase filter
halves the rate, overlapped frames give log-mel energies, and frame energies are
segmented with hysteresis: a segment opens above one level and closes below a
lower one. Frames are grouped in tensors of one fixed shape, each with its time
span, inside an Arrow IPC stream.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, load, slices

RATE, UP, DOWN = 16_000, 1, 2
TAPS = 32
FRAME, HOP, FFT, MELS = 200, 80, 256, 24
#: Frames in a tensor; the last one of a payload is padded with the floor.
SPAN_FRAMES = 64
#: Decibels above the quietest tenth of the frames at which a segment opens, and below which it closes.
OPEN_DB, CLOSE_DB = 6.0, 3.0
FLOOR = 1e-10
#: Samples of resampled signal that are turned into frames at a time.
BLOCK = HOP * 1024


def pad(payload: bytes, unit: int = 64) -> bytes:
    """Bytes 0 appended up to a positive multiple of unit."""
    return payload + bytes(-len(payload) % unit or (0 if payload else unit))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit WAV file whose samples are the payload's bytes."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def samples(stored: bytes) -> bytes:
    """The samples of a stored WAV file, found by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(stored):
        kind, n = struct.unpack_from("<4sI", stored, at)
        if kind == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@lru_cache
def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc filter, one row per phase."""
    widest, n = max(up, down), taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / widest) / widest * np.hamming(n)
    return np.ascontiguousarray((h / h.sum() * up).reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up/down times its rate. Each output takes the one phase of the filter that meets it."""
    phases = low_pass(up, down)
    taps = phases.shape[1]
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(up):
        # outputs that share a phase are up apart, their inputs down apart
        at, phase = divmod(first * down, up)
        out[first::up] = windows[at :: down][: len(out[first::up])] @ phases[phase]
    return out


@lru_cache
def mel_bank(rate: int = RATE * UP // DOWN, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, even on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = (700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)) / rate * fft
    bins = np.arange(fft // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    bank = np.clip(np.minimum((bins - low) / np.maximum(mid - low, 1e-9), (high - bins) / np.maximum(high - mid, 1e-9)), 0, None)
    return bank.astype(np.float32)


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies of overlapped frames, and each frame's energy in decibels. A short signal is one frame."""
    n = max(1, 1 + -(-max(0, len(signal) - FRAME) // HOP))
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    signal = np.concatenate([signal, np.zeros(max(0, (n - 1) * HOP + FRAME - len(signal)), np.float32)])
    window, step = np.hanning(FRAME).astype(np.float32), BLOCK // HOP
    for a in range(0, n, step):
        b = min(n, a + step)
        frames = np.lib.stride_tricks.sliding_window_view(signal[a * HOP : (b - 1) * HOP + FRAME], FRAME)[::HOP]
        energy[a:b] = 10 * np.log10((frames * frames).mean(axis=1) + FLOOR)
        spectrum = np.fft.rfft(frames * window, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        mels[a:b] = np.log(power.astype(np.float32) @ mel_bank() + FLOOR)
    return mels, energy


def segments(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Spans of frames, end exclusive, that open above one level and close below a lower one."""
    base = float(np.quantile(energy, 0.1))
    # +1 opens, -1 closes, 0 keeps the state: the last mark before a frame is its state
    marks = np.where(energy >= base + open_db, 1, np.where(energy < base + close_db, -1, 0))
    last = np.maximum.accumulate(np.where(marks != 0, np.arange(len(marks)), -1))
    on = (last >= 0) & (marks[np.maximum(last, 0)] > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float32(), (SPAN_FRAMES, MELS), dim_names=("frame", "mel"))
SPANS = pa.schema([("start_ms", pa.float32()), ("end_ms", pa.float32()), ("frames", pa.int32()), ("log_mel", TENSOR)])


def tensors(mels: np.ndarray) -> bytes:
    """An Arrow IPC stream of fixed-shape tensors, with the time span that each covers."""
    n, ms = len(mels), 1000 * DOWN / UP / RATE
    count = -(-n // SPAN_FRAMES)
    whole = np.full((count * SPAN_FRAMES, MELS), np.log(FLOOR), np.float32)
    whole[:n] = mels
    starts = np.arange(count) * SPAN_FRAMES
    frames = np.minimum(SPAN_FRAMES, n - starts).astype(np.int32)
    columns = [pa.array((starts * HOP * ms).astype(np.float32)), pa.array((((starts + frames - 1) * HOP + FRAME) * ms).astype(np.float32)), pa.array(frames), pa.FixedShapeTensorArray.from_numpy_ndarray(whole.reshape(count, SPAN_FRAMES, MELS))]
    columns[3] = pa.ExtensionArray.from_storage(TENSOR, columns[3].storage)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, SPANS) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=SPANS))
    return sink.getvalue()


def read_tensors(stream: bytes) -> pa.Table:
    """The spans and tensors of one media value."""
    return pa.ipc.open_stream(stream).read_all()


def describe(payload: bytes) -> tuple[bytes, list[tuple[int, int]], str]:
    """Tensor stream, segments in frames, and a short feature text of a payload of 8-bit samples."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x))
    found = segments(energy)
    mean = ",".join(f"{v:.2f}" for v in mels.mean(axis=0, dtype=np.float64) + 0.0)
    voiced = sum(b - a for a, b in found)
    return tensors(mels), found, f"frames={len(mels)};segments={len(found)};active={voiced};db={float(energy.mean(dtype=np.float64)):.2f};mel={mean}"


RESULT = "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, segments array<struct<start_ms:float,end_ms:float>>, feature string"


def audio_features(df: DataFrame, text: str = "text", *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then the stored media, digests of what is read back from it, and its features.

    A null text counts as empty, which is stored as 64 bytes 0. Every byte of a
    text is a sample, however long it is. Columns of df outside keep are left
    out; a name in keep that is also a result's is an error.
    """
    names = [c.split()[0] for c in RESULT.replace("array<struct<start_ms:float,end_ms:float>>", "array").split(", ")]
    if clash := set(keep) & set(names):
        raise ValueError(f"keep may not name {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ms = 1000 * DOWN / UP / RATE * HOP
        for batch in slices(batches, "__text", 2 << 20):
            rows = []
            for text in batch.column("__text").cast(pa.binary()).to_pylist():
                stored = wav(pad(text))
                payload = samples(stored)
                stream, found, feature = describe(payload)
                rows.append((stored, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), stream, [{"start_ms": a * ms, "end_ms": b * ms} for a, b in found], feature))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start_ms", pa.float32()), ("end_ms", pa.float32())])), pa.string()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=[*keep, *names])

    source = few_rows(df).select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, {RESULT}")


TENSOR_ROW = "start_ms float, end_ms float, frames int, log_mel array<float>"


def tensor_rows(df: DataFrame, tensors: str = "tensors", *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each tensor of a column of streams: the columns keep, its time span, how many of its frames are of the payload, and its SPAN_FRAMES x MELS values row by row.

    A null stream gives no row. A name in keep that is also a result's is an error.
    """
    names = [c.split()[0] for c in TENSOR_ROW.split(", ")]
    if clash := set(keep) & set(names):
        raise ValueError(f"keep may not name {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, stream in enumerate(batch.column("__tensors").to_pylist()):
                for part in pa.ipc.open_stream(stream):
                    values = part.column("log_mel").storage.cast(pa.list_(pa.float32()))
                    own = [batch.column(k).take(pa.array([i] * part.num_rows)) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, *(part.column(c) for c in names[:3]), values], names=[*keep, *names])

    source = few_rows(df).select(*keep, F.col(tensors).alias("__tensors")).where("__tensors is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, {TENSOR_ROW}")


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op9_audio_features": op9_audio_features}
