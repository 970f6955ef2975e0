"""Importance resampling towards a target distribution over hashed word features.

A text's features are runs of consecutive words. One 256-byte table lower-cases A-Z and blanks every
separator, so ``bytes.split`` yields the words; the checksum of a run is the checksum of its first word carried on
over a blank and the next word. Two passes over the texts: the first adds up how often each bucket occurs (never
more than BUCKETS rows leave a task), the second adds each text's gains. The draw without replacement takes the
largest sums of weight and Gumbel noise; its order comes from a range partitioning and one offset per partition.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.session import cut_lineage

BUCKETS = 10_000
LONGEST = 1  # words of the longest run
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
KNOWN = 200_000  # runs whose bucket a task remembers

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of digits, letters a-z (A-Z lower-cased) and bytes from 128 on."""
    return text.translate(_TABLE).split()


def checksums(held: list[bytes], longest: int = LONGEST) -> Counter[int]:
    """How often each checksum occurs among all runs of 1 to ``longest`` words."""
    if longest == 1:
        return _reduced(Counter(held))
    found: Counter[int] = Counter()
    carried = [crc32(w) for w in held]
    found.update(carried)
    for n in range(1, longest):
        carried = [crc32(b" " + held[i + n], c) for i, c in enumerate(carried[: max(0, len(held) - n)])]
        found.update(carried)
    return found


def _reduced(counts: Counter[bytes]) -> Counter[int]:
    out: Counter[int] = Counter()
    for word, n in counts.items():
        out[crc32(word)] += n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Per bucket the floored thousandfold log of its smoothed target share over its smoothed source share."""
    size = len(source)
    all_source, all_target = float(source.sum() + size), float(target.sum() + size)
    return [math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A thousandfold standard Gumbel value decided by the id alone; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all rows of ``texts`` (text) fall into each bucket; null texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0):
                held = words(text.as_py() or b"")
                if longest == 1:
                    seen.update(held)
                else:
                    _add(total, checksums(held, longest))
            _add(total, _reduced(seen))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    def _add(total: np.ndarray, found: Counter[int]) -> None:
        if found:
            np.add.at(total, np.fromiter(found, np.int64, len(found)) % buckets, np.fromiter(found.values(), np.int64, len(found)))

    summed = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def weights(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for every row of ``docs``."""
    size = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n_words, n_features, weight, score = [], [], [], []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                held = words(text.as_py() or b"")
                total = 0
                if longest == 1:
                    for word, n in Counter(held).items():
                        g = known.get(word)
                        if g is None:
                            if len(known) >= KNOWN:
                                known.clear()
                            g = known[word] = gain[crc32(word) % size]
                        total += g * n
                else:
                    total = sum(gain[c % size] * n for c, n in checksums(held, longest).items())
                n_words.append(len(held))
                n_features.append(sum(max(0, len(held) - k) for k in range(longest)))
                weight.append(total)
                score.append(total + noise(doc_id, seed))
            columns = [batch.column(0), *(pa.array(v, pa.int64()) for v in (n_words, n_features, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... by ``order`` over all of them.

    A range partitioning sorts, each partition counts its own rows, and the offsets of the partitions (one row
    each) are added. Rows that tie in every key are told apart by their place in the written input, so a key that
    holds a third of the rows spreads over several partitions.
    """
    placed = rows.withColumn("__place", F.monotonically_increasing_id())
    keys = [*order, F.col("__place").asc()]
    fields = rows.schema
    numbered = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "__part int", "__at long"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(np.arange(seen + 1, seen + 1 + batch.num_rows), pa.int64())
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), at], [*batch.schema.names, "__part", "__at"])

    sorted_ = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__place")
    written = cut_lineage(sorted_.mapInArrow(number, numbered))
    sizes = written.groupBy("__part").agg(F.max("__at").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    return written.join(offsets, "__part").withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text); ``rank`` says which are drawn.

    ``target`` (text) sets the distribution to move towards. Of the N rows with at least ``least_words`` words
    the floor(percent * N / 100) highest scores are drawn, ties to the smaller doc_id, null ids last; the others have
    a null rank. A null or empty text has no features and weight 0; a null doc_id draws the noise of an empty id.
    Repeated rows are counted, scored and ranked each. Without target rows or without documents all counts are
    smoothed ones. Further columns are not read. A text is held whole, one at a time.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = cut_lineage(weights(docs, gain, longest, seed))
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    order = ranked(scored.where(able), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    place = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    return order.select(*out, place).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))


def sampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **settings: int) -> DataFrame:
    """The rows of ``docs``, all columns, that ``resample`` draws, by doc_id; ids must be unique and not null."""
    picked = resample(docs, target, percent, **settings).where("rank is not null").select(F.col("doc_id").alias("__drawn"))
    return docs.join(picked, F.col("doc_id") == F.col("__drawn"), "left_semi")
