import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import audio_features as op


def test_round_trip(docs, rows):
    got = {r["doc_id"]: r for r in op.audio_features(op.media_column(docs)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        want = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(want), hashlib.sha256(want).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(want[-32:]) and op.from_wav(bytes(r["media"])) == want
        table = op.read_tensors(bytes(r["tensors"]))
        kind = table.schema.field("log_mel").type
        assert isinstance(kind, pa.FixedShapeTensorType) and list(kind.shape) == [op.PATCH, op.MELS]
        assert len(table) == -(-r["frames"] // op.PATCH)
        assert all(a < z for a, z in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))


def test_equal_texts_equal_values(spark, docs):
    both = docs.union(docs.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "_row", "key").repartition(1))
    got = {r["doc_id"]: tuple(r[1:]) for r in op.audio_features(op.media_column(both)).collect()}
    assert all(got[i] == got[i + 1000] for i in got if i < 1000)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (1, 1), (5, 8)])
def test_resampling_matches_zero_stuffing(up, down):
    x = np.random.default_rng(4).standard_normal(777).astype(np.float32)
    taps = op._low_pass(up, down)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    want = np.convolve(stuffed, taps)[len(taps) // 2 :][: len(stuffed)][::down]
    got = op.resample(x, up, down)
    np.testing.assert_allclose(got[: len(want)], want[: len(got)], atol=1e-4)


def test_resampling_keeps_a_low_tone():
    t = np.arange(16_000) / 16_000
    y = op.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 1, 2)
    np.testing.assert_allclose(y[100:-100], np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)[100:-100], atol=0.02)


def test_mel_peak_is_where_the_tone_is():
    t = np.arange(8000) / 8000
    mels, _ = op.log_mel(np.sin(2 * np.pi * 1000 * t).astype(np.float32))
    hz = (np.arange(op.FRAME // 2 + 1) * op.RATE / op.FRAME)[op.mel_bank()[:, mels.mean(axis=0).argmax()].argmax()]
    assert abs(hz - 1000) < 150


def test_hysteresis():
    assert op.segments(np.array([0, 5, 0.0, 0.2, -9, 0, 0.5, 6, 6, -8.5, 0.0])).tolist() == [[1, 4], [7, 9]]
    assert op.segments(np.zeros(5)).tolist() == []


def test_damaged_media():
    with pytest.raises(ValueError):
        op.from_wav(b"not a file")


def test_empty(empty):
    assert op.audio_features(op.media_column(empty)).collect() == []
