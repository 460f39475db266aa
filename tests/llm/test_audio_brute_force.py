import hashlib
import zlib

import numpy as np
import pytest

from gridloom.llm import audio_features as op


def plain_features(samples):
    """Frames, segments as frames and log-mel energies by the definitions, in double precision and without any blocks."""
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    half = 8 * 2
    at = np.arange(-half, half + 1)
    taps = np.sinc(at / 2) * np.hanning(2 * half + 3)[1:-1]
    taps /= taps.sum()
    y = np.convolve(x, taps)[half:][: len(x)][::2]
    frames = 1
    while (frames - 1) * 128 + 256 < len(y):
        frames += 1
    y = np.concatenate([y, np.zeros((frames - 1) * 128 + 256 - len(y))])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(256), np.arange(129)) / 256)
    power = np.array([np.abs((y[i * 128 : i * 128 + 256] * np.hanning(256)) @ turn) ** 2 for i in range(frames)])
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 40 / 700), 2595 * np.log10(1 + 4000 / 700), 26) / 2595) - 1)
    mels = np.zeros((frames, 24))
    for m in range(24):
        for k in range(129):
            hz = k * 8000 / 256
            weight = min((hz - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - hz) / (edges[m + 2] - edges[m + 1]))
            mels[:, m] += max(0, weight) * power[:, k]
    level = 10 * np.log10(power.mean(axis=1) + 1e-6)
    level -= level.mean()
    is_open, spans = False, []
    for i, v in enumerate(level):
        if not is_open and v >= 1:
            is_open = True
            spans.append([i, frames])
        elif is_open and v <= -1:
            is_open = False
            spans[-1][1] = i
    return frames, spans, np.log(mels + 1e-6), level, len(y)


def close(level):
    """Whether no frame is so near to a threshold that rounding could decide."""
    return min(np.abs(level - 1).min(), np.abs(level + 1).min()) > 1e-3


def test_features_by_their_definitions(docs, rows):
    texts, sure = dict(rows), 0
    for r in op.audio_features(op.media_column(docs)).collect():
        samples = op.payload((texts[r["doc_id"]] or "").encode())
        if len(samples) > 50_000:
            continue
        frames, spans, mels, level, _ = plain_features(samples)
        assert r["frames"] == frames
        got = np.concatenate(op.read_tensors(bytes(r["tensors"]))["log_mel"].combine_chunks().to_numpy_ndarray())
        np.testing.assert_allclose(got[:frames], mels, atol=2 / 256 + 1e-3)
        np.testing.assert_allclose(got[frames:], np.log(1e-6), atol=1e-4)
        if close(level):
            sure += 1
            assert [(x["start_s"], x["end_s"]) for x in r["segments"]] == [(a * 128 / 8000, min((z - 1) * 128 + 256, len(samples) // 2) / 8000) for a, z in spans]
    assert sure > 5


@pytest.mark.parametrize("size", [576, 576 * 40, 576 * 1000])
@pytest.mark.parametrize("block", [1, 7, 1024])
def test_blocks_change_nothing(monkeypatch, size, block):
    if size // 256 > 3000 * block:
        return
    samples = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
    whole, energy = op.log_mel(op.resample(samples, op.UP, op.DOWN))
    monkeypatch.setattr(op, "BLOCK", block)
    got, levels, n = op.features(samples)
    assert n == size // 2 and got.shape == whole.shape
    np.testing.assert_allclose(got, whole, atol=1 / 256 + 1e-6)
    np.testing.assert_allclose(levels, energy, atol=1e-4)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (5, 8)])
def test_ranges_of_resampling(up, down):
    x = np.random.default_rng(4).standard_normal(500).astype(np.float32)
    whole = op.resample(x, up, down)
    for start, stop in ((0, 1), (0, 50), (13, 14), (17, 200), (100, 10_000), (len(whole) - 1, len(whole)), (len(whole), len(whole) + 5)):
        np.testing.assert_array_equal(op.resample(x, up, down, start, stop), whole[start:stop])


def test_query(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op.op10_audio_features(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        samples = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(samples), hashlib.sha256(samples).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(samples[-32:])
        media = b"RIFF" + (36 + len(samples)).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("10000000010001 00803e0000803e0000 01000800") + b"data" + len(samples).to_bytes(4, "little") + samples
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        frames, spans, _, level, _ = plain_features(samples)
        assert r["feature"].startswith(f"frames={frames};")
        assert not close(level) or r["feature"].split(";")[1] == f"segments={len(spans)}"
