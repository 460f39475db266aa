"""Numpy kernel that cuts byte strings into anchored runs of fixed-length windows.

A window is the depth-limited suffix at a byte position: its first ``depth`` bytes.  Its *anchor* is
the leftmost k-gram of least hash inside it, so equal windows have equal anchors at equal offsets.
Neighbouring windows mostly share their anchor; a maximal stretch of them is a *run*.  The anchor's
hash is the leading radix digit of all windows in the run.
"""

from __future__ import annotations

import numpy as np
import xxhash

BLOCK = 1 << 15
_POS = np.uint64(BLOCK - 1)
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + _A).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = splitmix(np.arange(256, dtype=np.uint64))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _B
    x += right
    x ^= x >> np.uint64(29)
    x *= _A
    return x


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes at every position, by doubling."""
    power, width, out, got = _TABLE[buf], 1, None, 0
    while True:
        if k & width:
            if out is None:
                out, got = power, width
            else:
                n = len(power) - got
                out, got = _pair(out[:n], power[got : got + n]), got + width
        if width * 2 > k:
            return out ^ (out >> np.uint64(32))
        power = _pair(power[:-width], power[width:])
        width *= 2


def classes(buf: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """For the window of ``depth`` bytes from each place of ``at`` on: a number that it shares with equal windows of its group; -1 where there is none.

    Most-significant-digit passes: a digit is eight bytes, read as one integer with the first byte highest.  Each pass orders
    the windows of a class by their next digit, and only those that are equal to another so far go on.
    """
    digit_at = np.ndarray(max(0, len(buf) - 7), ">u8", buf, strides=(1,))
    out = np.unique(group, return_inverse=True)[1].astype(np.int64)
    active = np.arange(len(at))
    for offset in [*range(0, depth - 8, 8), depth - 8]:
        digit = digit_at[at[active] + offset].astype(np.uint64)
        order = np.lexsort((digit, out[active]))
        active, digit = active[order], digit[order]
        own = out[active]
        new = np.ones(len(active), bool)
        new[1:] = (own[1:] != own[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        equal = (np.bincount(number) > 1)[number] if len(active) else new
        out[active] = np.where(equal, number, -1)
        active = active[equal]
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def blocks(lengths: np.ndarray, depth: int):
    """Cut documents into segments of at most BLOCK bytes that overlap by depth-1, packed into blocks.

    Yields lists of (document index, start in the document, end in the document).
    """
    block, room = [], BLOCK
    for i, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= depth:
            if room < depth + 64 or (n - start > room and room < BLOCK):
                if block:
                    yield block
                block, room = [], BLOCK
            end = min(n, start + room)
            block.append((i, start, end))
            room -= end - start
            if end == n:
                break
            start = end - depth + 1
    if block:
        yield block


def runs(data: bytes, segments: list[tuple[int, int, int]], depth: int, k: int):
    """Runs of one block: document index, start in the document, windows, anchor hash, content digest.

    data: the concatenated segments.
    """
    buf = np.frombuffer(data, np.uint8)
    seg = np.array(segments, np.int64)
    size = seg[:, 2] - seg[:, 1]
    ends = np.cumsum(size)
    starts = ends - size
    grams = gram_hashes(buf, k)
    low = sliding_min((grams & ~_POS) | np.arange(len(grams), dtype=np.uint64), depth - k + 1)
    edge = np.zeros(len(low) + 1, np.int8)
    edge[starts] = 1
    np.add.at(edge, np.minimum(ends - depth + 1, len(low)), -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = np.empty(len(low), bool)
    new[0] = True
    new[1:] = low[1:] != low[:-1]
    new[starts] = True
    at = np.flatnonzero(new & valid)
    owner = np.searchsorted(ends, at, side="right")
    stop = np.minimum(np.append(at[1:], len(low)), ends[owner] - depth + 1)
    n = stop - at
    anchor = grams[(low[at] & _POS).astype(np.int64)]
    view = memoryview(data)
    digest = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at.tolist(), (stop + depth - 1).tolist())], np.uint64)
    return seg[owner, 0], at - starts[owner] + seg[owner, 1], n, anchor, digest
