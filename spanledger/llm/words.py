"""Words and their hashes for whole Arrow batches of texts, without a Python loop per row.

A word is a run of bytes outside space and 0x09-0x0D, with A-Z lower-cased. Word hashes are
differences of one running polynomial over the batch's bytes (modulo 2**64, table-mixed), so a
batch costs a few passes over its bytes. Two words collide with a chance of about 2**-62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20  # texts are hashed in pieces of about this size; a longer text is one piece

_rng = np.random.Generator(np.random.PCG64(20240917))
_MIX = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_SLOTS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C13
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def finish(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text each: (rows, bytes, offsets)."""
    array = batch.column(batch.schema.get_field_index(column))
    buf, offs = raw(array)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    gap = _SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    edge[0] = edge[n] = True
    before = edge[:-1].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same for equal bytes wherever they stand."""
    up, down = _power(len(buf) + 1)
    run = np.empty(len(buf) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_MIX[buf] * up[: len(buf)], out=run[1:])
    return finish((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a piece with A-Z lower-cased, and each row's first word."""
    low = _LOWER[buf]
    starts, ends, first = spans(low, offs)
    return span_hashes(low, starts, ends), first


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` consecutive words (rows are not told apart)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64) * _SLOTS[-1]
    for k in range(size):
        total += words[k : k + n] * _SLOTS[k % 48] + np.uint64(k // 48)
    return finish(total)


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """Per row its distinct shingles, sorted: runs of ``size`` words, or all words if fewer."""
    every = runs(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield runs(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
