import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import suffix_array_dedup as op
from gridloom.llm import window_kernel as wk


@pytest.mark.parametrize("depth", [8, 24, 27, 100])
def test_classes_are_equal_windows(depth):
    rng = random.Random(depth)
    stock = [bytes(rng.choice(b"ab") for _ in range(depth)) for _ in range(6)]
    stock += [x[:-1] + b"c" for x in stock[:3]] + [b"c" + x[1:] for x in stock[:3]]
    windows = [rng.choice(stock) for _ in range(80)] + [bytes(rng.choice(b"xyz") for _ in range(depth)) for _ in range(40)]
    group = np.array([rng.randrange(3) for _ in windows])
    got = wk.classes(np.frombuffer(b"".join(windows), np.uint8), np.arange(len(windows)) * depth, group, depth)
    keys = list(zip(group.tolist(), windows, strict=True))
    for i, k in enumerate(keys):
        assert (got[i] < 0) == (keys.count(k) == 1)
        assert all((got[i] == got[j]) == (k == keys[j]) for j in range(len(keys)) if got[i] >= 0)
    assert wk.classes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), depth).tolist() == []


@pytest.mark.parametrize("most", [1, 10_000, 1 << 22])
def test_groups_are_whole_however_batches_are_cut(monkeypatch, most):
    monkeypatch.setattr(op, "BODIES", most)
    rng = random.Random(3)
    stock = [bytes(rng.choice(b"abc") for _ in range(140)) for _ in range(5)]
    rows = sorted((rng.randrange(9), i % 50, i, 0, rng.random() < 0.1, rng.choice(stock)[: rng.randint(100, 140)]) for i in range(200))
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("_row", pa.int64()), ("at", pa.int64()), ("done", pa.bool_()), ("body", pa.binary())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, (*r[:5], None if r[4] else r[5]), strict=True)) for r in rows[i : i + 7]], schema) for i in range(0, 200, 7)]
    got = {(r["_row"], r["at"] + j) for b in op._last_digits(100)(iter(batches)) for r in b.to_pylist() for j in range(r["n"])}
    want, seen = set(), set()
    for key, _, row, _, done, body in rows:
        if done:
            want.add((row, 0))
            continue
        for p in range(len(body) - 99):
            if (key, body[p : p + 100]) in seen:
                want.add((row, p))
            seen.add((key, body[p : p + 100]))
    assert got == want
