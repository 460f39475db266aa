"""Media columns: audio features stored as fixed-shape Arrow tensors with time spans (operator 10).

A payload is stored as an 8-bit mono WAV file, whose samples are its bytes.  Features are computed from
the stored bytes: polyphase resampling to ``RATE``, overlapped frames, log-mel filterbank energies, and
segments by hysteresis of frame energy (a segment opens above the upper threshold and closes below the
lower one).  Log-mel frames are cut into patches of one shape; an Arrow IPC stream holds them as a
fixed_shape_tensor column beside each patch's time span.

Every text is computed by itself, ``BLOCK`` frames at a time, so equal payloads give equal bytes wherever they run
and a long one takes little more memory than its stored form and its tensors.

Defined results.  Null text is empty; the payload is padded with bytes 255 to a positive multiple of 576,
so every text has at least one frame.  Null ids keep their row; repeated rows give repeated rows; an
empty table gives an empty result; other columns are ignored.  A media value that is not such a WAV file
raises ValueError.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, text_bytes

UNIT = 576
PAD = b"\xff"
STORED_RATE = 16_000
UP, DOWN = 1, 2
RATE = STORED_RATE * UP // DOWN
FRAME, HOP, MELS = 256, 128, 24
#: Frames of a patch: the tensor shape is (PATCH, MELS).
PATCH = 32
#: Decibels of a frame above the mean energy that open a segment, and below it that close one.
OPENS, CLOSES = 1.0, -1.0
FLOOR = 1e-6
#: Frames whose signal is made at once.
BLOCK = 1024


def payload(text: bytes) -> bytes:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + PAD * (size - len(text))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(STORED_RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    try:
        with wave.open(io.BytesIO(media), "rb") as w:
            if (w.getnchannels(), w.getsampwidth()) != (1, 1):
                raise ValueError("not 8-bit mono")
            return w.readframes(w.getnframes())
    except (wave.Error, EOFError, struct.error) as e:
        raise ValueError(f"not a WAV file: {e}") from e


@lru_cache
def _low_pass(up: int, down: int, zeros: int = 8) -> np.ndarray:
    half = zeros * max(up, down)
    at = np.arange(-half, half + 1)
    taps = np.sinc(at / max(up, down)) * np.hanning(2 * half + 3)[1:-1]
    return (taps / taps.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Polyphase resampling, of which the samples from start to stop: each output phase uses its own taps on the input as it is, without zero stuffing.

    x: the wave, or 8-bit samples of it, of which only what the range needs is turned into numbers between -1 and 1.
    """
    taps = _low_pass(up, down)
    half = len(taps) // 2
    count = -(-len(x) * up // down)
    start, stop = min(start, count), count if stop is None else min(stop, count)
    out = np.zeros(stop - start, np.float32)
    for r in range(up):
        t = max(0, -(-(start - r) // up))
        part = out[r + t * up - start :: up]
        if not len(part):
            continue
        phase = taps[(r * down + half) % up :: up]
        lo = (r * down + half) // up + t * down - (len(phase) - 1)
        near = np.zeros(len(phase) + (len(part) - 1) * down, np.float32)
        a, z = max(lo, 0), min(lo + len(near), len(x))
        if z > a:
            near[a - lo : z - lo] = (x[a:z].astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else x[a:z]
        for k, tap in enumerate(phase):
            part += tap * near[len(phase) - 1 - k :][: (len(part) - 1) * down + 1 : down]
    return out


@lru_cache
def mel_bank() -> np.ndarray:
    def mel(hz):
        return 2595 * np.log10(1 + hz / 700)

    edges = 700 * (10 ** (np.linspace(mel(40), mel(RATE / 2), MELS + 2) / 2595) - 1)
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    rise = (hz[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])[None, :]
    fall = (edges[None, 2:] - hz[:, None]) / (edges[2:] - edges[1:-1])[None, :]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, MELS), rounded to 1/256, and the energy of each frame in decibels; zeros fill the last frame up."""
    short = max(FRAME - len(y), (FRAME - len(y)) % HOP)
    if short:
        y = np.concatenate([y, np.zeros(short, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(views * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    mels = np.log(power @ mel_bank() + FLOOR)
    return (np.round(mels * 256) / 256).astype(np.float32), 10 * np.log10(power.mean(axis=1) + FLOOR)


def features(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Log-mel energies and frame energies of 8-bit samples, and how many samples the signal has after resampling; ``BLOCK`` frames at a time."""
    size = -(-len(samples) * UP // DOWN)
    frames = 1 + max(0, -(-(size - FRAME) // HOP))
    parts = [log_mel(resample(samples, UP, DOWN, i * HOP, (min(i + BLOCK, frames) - 1) * HOP + FRAME)) for i in range(0, frames, BLOCK)]
    return np.concatenate([m for m, _ in parts]), np.concatenate([e for _, e in parts]), size


def segments(energy: np.ndarray) -> np.ndarray:
    """(segments, 2): first frame and the frame after the last of each stretch that hysteresis keeps open."""
    level = energy - energy.mean()
    says = np.where(level >= OPENS, 1, np.where(level <= CLOSES, 0, -1))
    last = np.maximum.accumulate(np.where(says >= 0, np.arange(len(says)), -1))
    is_open = np.where(last >= 0, says[last], 0)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], is_open, [0]])))
    return turns.reshape(-1, 2)


def tensors(mels: np.ndarray, samples: int) -> bytes:
    """Arrow IPC stream: start_s, end_s, log_mel as fixed_shape_tensor(float32, (PATCH, MELS)); the last patch is filled up with the floor, and ends with the signal of so many samples."""
    frames = len(mels)
    n = -(-frames // PATCH)
    filled = np.full((n * PATCH, MELS), np.log(FLOOR), np.float32)
    filled[:frames] = mels
    first = np.arange(n) * PATCH
    start = first * HOP / RATE
    end = np.minimum((np.minimum(first + PATCH, frames) - 1) * HOP + FRAME, samples) / RATE
    table = pa.table({"start_s": start, "end_s": end, "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, PATCH, MELS))})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text stored as a WAV file."""

    def over(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(b["text"])
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(payload(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return each_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), over, "doc_id long, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) with what its stored samples give: sizes, digests, frames, segments as time spans, tensors."""

    def over(b: pa.RecordBatch) -> pa.RecordBatch:
        size, sha, crc, frames, spans, patches = [], [], [], [], [], []
        for x in b["media"].to_pylist():
            samples = from_wav(x)
            size.append(len(samples))
            sha.append(hashlib.sha256(samples).hexdigest())
            crc.append(zlib.crc32(samples[-32:]))
            mels, energy, length = features(np.frombuffer(samples, np.uint8))
            frames.append(len(mels))
            spans.append([{"start_s": a * HOP / RATE, "end_s": min((z - 1) * HOP + FRAME, length) / RATE} for a, z in segments(energy).tolist()])
            patches.append(tensors(mels, length))
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [b["doc_id"], b["n_bytes"], b["media"], pa.array(size, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(frames, pa.int64()), pa.array(spans, span), pa.array(patches, pa.binary())],
            names=["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "frames", "segments", "tensors"],
        )

    return each_batch(media, over, "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, frames long, segments array<struct<start_s:double,end_s:double>>, tensors binary")


def op10_audio_features(spark, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents."""
    out = audio_features(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    feature = F.format_string("frames=%d;segments=%d;tensors=%s", "frames", F.size("segments"), F.sha2("tensors", 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
