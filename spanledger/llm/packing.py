"""Bounded-space online packing of token ids into sequences.

Each partition reads its documents once and keeps a fixed number of open windows. Whole windows are
cut off long documents at once; the remainder goes to the open window that it fills best. Where it
fits none and no more may be opened, the fullest window is topped up with the remainder's first ids
and emitted (a gap of a few ids is left as padding rather than cut a document for it). Windows still
open at the end are the leftovers: small tables of ids, one per partition, which are laid end to end
by groups of partitions and cut again. The last stretch of a group is cut at powers of two, so it
needs no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import tokens as K
from spanledger.llm import words as W
from spanledger.session import cut_lineage

SIZE = 2048
OPEN = 64
LEAST_CUT = 16
MERGED = 32  # partitions whose leftovers are merged in one task
END = 1

_PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
_PIECE_SQL = ", ".join(f"`{c}` long" for c in _PIECE)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


class Window:
    def __init__(self, number: int) -> None:
        self.number, self.used, self.pieces = number, 0, []


class Packer:
    """The open windows of one partition, kept sorted by their gaps."""

    def __init__(self, first: int, size: int, limit: int) -> None:
        self.next, self.size, self.limit = first, size, limit
        self.gaps: list[tuple[int, int, Window]] = []
        self.rows: list[tuple] = []

    def _put(self, window: Window, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        window.pieces.append((doc, start, ids, total, window.used))
        window.used += len(ids)

    def _new(self) -> Window:
        self.next += 1
        return Window(self.next - 1)

    def _close(self, window: Window) -> None:
        self.rows += [(d, s, len(i), checksum(i), n, window.number, at) for d, s, i, n, at in window.pieces]

    def _keep(self, window: Window) -> None:
        if window.used == self.size:
            self._close(window)
        else:
            insort(self.gaps, (self.size - window.used, window.number, window))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self.rows.append((doc, at, self.size, checksum(ids[at : at + self.size]), total, self.next, 0))
            self.next += 1
            at += self.size
        if at == total:
            return
        fit = bisect_left(self.gaps, (total - at,))
        if fit < len(self.gaps):
            window = self.gaps.pop(fit)[2]
        elif len(self.gaps) < self.limit:
            window = self._new()
        else:
            gap, _, full = self.gaps.pop(0)
            if gap >= LEAST_CUT:
                self._put(full, doc, at, ids[at : at + gap].copy(), total)
                at += gap
            self._close(full)
            fit = bisect_left(self.gaps, (total - at,))
            window = self.gaps.pop(fit)[2] if fit < len(self.gaps) else self._new()
        self._put(window, doc, at, ids[at:].copy(), total)
        self._keep(window)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _table(rows: list[tuple], part: int, ids: list[bytes] | None = None) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(_PIECE))]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([part] * len(rows), pa.int64()), pa.array(ids or [None] * len(rows), pa.binary())], [*_PIECE, "part", "ids"]
    )


def _merge(size: int):
    """Streams leftovers, sorted by group: end to end, cut at ``size``, a group's rest at powers of two."""
    def cut(pieces: list[tuple], sizes: Iterator[int], first: int) -> list[tuple]:
        rows, number, room, used = [], first, next(sizes), 0
        for doc, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                part = ids[at : at + room - used]
                rows.append((doc, start + at, len(part), checksum(part), total, number, used))
                at, used = at + len(part), used + len(part)
                if used == room:
                    number, room, used = number + 1, next(sizes, 0), 0
        return rows

    def halves(n: int) -> Iterator[int]:
        return iter([1 << b for b in reversed(range(n.bit_length())) if n >> b & 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, held, have = None, 0, [], 0

        def flush(rest: bool):
            nonlocal number, held, have
            whole = have // size
            head, tail, need = [], [], whole * size
            for doc, start, ids, total in held:
                if need:
                    head.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    tail.append((doc, start + need, ids[need:], total))
                need -= min(need, len(ids))
            rows = cut(head, iter([size] * whole), number) if whole else []
            number, held, have = number + whole, tail, have - whole * size
            if rest and have:
                rows += cut(held, halves(have), number)
                held, have = [], 0
            return _table(rows, 0).select(list(_PIECE))

        for batch in batches:
            for r in batch.to_pylist():
                if r["bundle"] != group:
                    if held:
                        yield flush(True)
                    group, number = r["bundle"], (1 << 62) | (r["bundle"] << 32)
                ids = np.frombuffer(r["ids"], "<u4")
                held.append((r["doc_id"], r["start"], ids, r["doc_tokens"]))
                have += len(ids)
                if have >= 64 * size:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, open_windows: int = OPEN) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of ``docs``.

    A document is the ids of its whole text by the tokenizer file, without special ids, then END; a
    null or empty text is END alone. Every id lies in exactly one piece; sequences hold ``size`` ids
    at most, without gaps from offset 0. ``size`` is a power of two. Rows that share a doc_id are documents of their own; a
    null doc_id stays null. Further columns of ``docs`` are not read.
    """
    path = tokenizer or K.vocabulary("byte_bpe_50k.json")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer = K.encoder(path), Packer(part << 32, size, open_windows)
        try:
            for batch in batches:
                for rows, buf, offs in W.pieces(batch):
                    ids, first = K.with_end(*encoder.encode(buf, offs), END)
                    for doc, a, b in zip(rows.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                        packer.add(doc, ids[a:b])
                    yield _table(packer.take(), part)
        finally:
            encoder.clear()  # other stages of a pipeline use this worker's memory next
        left = [(p, w) for _, _, w in packer.gaps for p in w.pieces]
        yield _table([(d, s, len(i), 0, n, w.number, at) for (d, s, i, n, at), w in left], part, [p[2].tobytes() for p, _ in left])

    made = cut_lineage(texts.mapInArrow(run, f"{_PIECE_SQL}, part long, ids binary"))
    bundle = F.floor(F.col("part") / MERGED).cast("long")
    left = made.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids", "sequence_id", "offset", bundle.alias("bundle"))
    left = left.repartition("bundle").sortWithinPartitions("bundle", "sequence_id", "offset")
    return made.where("ids is null").select(*_PIECE).union(left.mapInArrow(_merge(size), _PIECE_SQL))
