"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes begin at words. Only those at minimisers are kept: the places where a run of GRAM words has the
least hash among WINDOW neighbouring ones, which equal passages choose alike. A passage of MIN_WORDS
words keeps a suffix within its first WINDOW words, so that at least CORE words follow it there. Suffixes
whose CORE words occur in one document only are dropped; the others are sorted, with the words that
follow and precede, and every suffix is compared with its neighbours from other documents: how far
do both agree to the right, how far to the left? They are sorted twice, by what follows and by what
precedes first, so that the neighbour that agrees longest on either side is met.

A partner may be next in neither order. So suffixes whose windows of MIN_WORDS words do not all lie in the
spans found, and all suffixes with the same cores, hash these windows: one that two documents hold is a span.
Every window belongs to one suffix, at the least of its first runs, so that no repeated window is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm import words as W
from spanledger.session import cut_lineage

MIN_WORDS = 50
GRAM = 5
WINDOW = 20
CORE = MIN_WORDS - WINDOW + 1
REACH = MIN_WORDS - CORE  # words looked at on either side of the core

_SUFFIX = "core long, doc_id long, pos long, fore binary, back binary"
_OPENED = _SUFFIX + ", low long, high long"  # the window begins low to high words before the core


def _least(words: np.ndarray) -> np.ndarray:
    """For every word but the last, the place of the least of the WINDOW runs from there on; never falls."""
    grams = W.runs(words, GRAM)
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(1) + np.arange(len(grams) - WINDOW + 1)


def _chosen(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all minimisers of a piece with CORE words to their right."""
    least = _least(words)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(first, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + WINDOW + GRAM - 1 <= first[row + 1]
    spots = np.unique(least[inside])
    row = np.searchsorted(first, spots, "right") - 1
    far = spots + CORE <= first[row + 1]
    return row[far], spots[far]


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in W.pieces(batch):
            words, first = W.word_hashes(buf, offs)
            row, spot = _chosen(words, first)
            core = W.runs(words, CORE)
            docs = rows.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core[spot].view(np.int64)), pa.array(docs[row].astype(np.int64)), pa.array(spot - first[row])], ["core", "doc_id", "pos"]
            )


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate suffixes with the words after their core and, backwards, before it."""
    for batch in batches:
        for rows, buf, offs in W.pieces(batch):
            words, first = W.word_hashes(buf, offs)
            core = W.runs(words, CORE)
            least = _least(words)
            short = (words >> np.uint64(32)).astype(">u4")
            keys, docs, spots, fore, back, low, high = [], [], [], [], [], [], []
            for doc, a, b, wanted in zip(rows.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), rows.column(2).to_pylist(), strict=True):
                places = a + np.array(wanted, np.int64)
                earliest = np.maximum(np.searchsorted(least, places, "left"), a).tolist()
                latest = np.minimum(np.searchsorted(least, places, "right") - 1, b - MIN_WORDS).tolist()
                for pos, early, late in zip(wanted, earliest, latest, strict=True):
                    at = a + pos
                    if at + CORE > b:
                        continue  # a place of another text under the same doc_id
                    keys.append(core[at])
                    docs.append(doc)
                    spots.append(pos)
                    fore.append(short[at + CORE : min(b, at + CORE + REACH)].tobytes())
                    back.append(short[max(a, at - REACH) : at][::-1].tobytes())
                    low.append(at - late)
                    high.append(at - early)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(docs, pa.int64()), pa.array(spots, pa.int64()), pa.array(fore, pa.binary()), pa.array(back, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                ["core", "doc_id", "pos", "fore", "back", "low", "high"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and place of every window of MIN_WORDS words that belongs to a suffix."""
    for batch in batches:
        core, doc, pos, low, high = (batch.column(i).to_numpy() for i in (0, 1, 2, 5, 6))
        after, before = _sums(batch.column(3), W._SLOTS[:REACH]), _sums(batch.column(4), W._SLOTS[REACH : 2 * REACH])
        for k in range(REACH + 1):
            here = np.flatnonzero((low <= k) & (k <= high))
            total = core[here].view(np.uint64) * W._SLOTS[-1] + after[here, REACH - k] + before[here, k] + np.uint64(k)
            yield pa.RecordBatch.from_arrays([pa.array(W.finish(total).view(np.int64)), pa.array(doc[here]), pa.array(pos[here] - k)], ["window", "doc_id", "start"])


def _sums(column: pa.Array, slots: np.ndarray) -> np.ndarray:
    """Per entry the hashes of its first 0, 1, ... REACH words; counts on after its end are not to be used."""
    buf, offs = W.raw(column)
    held = np.zeros((len(offs) - 1, REACH + 1), np.uint64)
    held[:, 1:][np.arange(REACH) < (np.diff(offs) // 4)[:, None]] = buf.view(np.uint32)
    held[:, 1:] *= slots
    return np.cumsum(held, 1, dtype=np.uint64)


def _agreement(column: pa.Array, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many leading words the entries at ``one`` and ``two`` share."""
    buf, offs = W.raw(column)
    sizes = np.diff(offs) // 4
    held = np.zeros((len(sizes), REACH + 1), np.uint32)
    mask = np.arange(REACH + 1) < sizes[:, None]
    held[mask] = buf.view(np.uint32)
    same = (held[one] == held[two]) & (np.arange(REACH + 1) < np.minimum(sizes[one], sizes[two])[:, None])
    return same.argmin(1)  # the last column never agrees


def _neighbours(table: pa.Table) -> tuple[pa.RecordBatch, int, int]:
    """Spans (doc_id, start, words) that sorted suffixes share with neighbours from other documents;
    where the first row's run of one document ends, and where the last one's begins."""
    batch = table.combine_chunks().to_batches()[0]
    n = batch.num_rows
    core, doc, pos = (batch.column(i).to_numpy() for i in (0, 1, 2))
    new = np.ones(n, bool)
    new[1:] = (core[1:] != core[:-1]) | (doc[1:] != doc[:-1])
    run = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], n) - 1
    starts, docs, words = [], [], []
    for other, there in ((heads[run] - 1, run > 0), (tails[run] + 1, run < len(heads) - 1)):
        one = np.flatnonzero(there)
        two = other[one]
        alike = (core[one] == core[two]) & (doc[one] != doc[two])
        one, two = one[alike], two[alike]
        if not len(one):
            continue
        right, left = _agreement(batch.column(3), one, two), _agreement(batch.column(4), one, two)
        enough = left + CORE + right >= MIN_WORDS
        one, right, left = one[enough], right[enough], left[enough]
        docs.append(doc[one])
        starts.append(pos[one] - left)
        words.append(left + CORE + right)
    parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, starts, words)]
    return pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], ["doc_id", "start", "words"]), int(tails[0]) + 1, int(heads[-1])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from each partition of sorted suffixes, and the rows at its edges for a second pass."""
    schema = ["doc_id", "start", "words", "core", "pos", "fore", "back"]

    def edge(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        none = pa.nulls(part.num_rows, pa.int64())
        column = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
        return pa.RecordBatch.from_arrays([column[1], none, none, column[0], column[2], column[3], column[4]], schema)

    held = None
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        spans, first, last = _neighbours(table)
        if not begun:
            yield edge(table.slice(0, first))
            begun = True
        wide = spans.num_rows
        yield pa.RecordBatch.from_arrays([*spans.columns, pa.nulls(wide, pa.int64()), pa.nulls(wide, pa.int64()), pa.nulls(wide, pa.binary()), pa.nulls(wide, pa.binary())], schema)
        # the last two runs go on: the last may continue, and its rows need a neighbour before them
        before = _neighbours(table.slice(0, last))[2] if last else 0
        held = table.slice(before)
    if held is not None:
        _, _, last = _neighbours(held)
        yield edge(held.slice(last))


def _spans(suffixes: DataFrame, first: str, then: str) -> DataFrame:
    ordered = suffixes.repartitionByRange("core", first, then, "doc_id").sortWithinPartitions("core", first, then, "doc_id", "pos")
    out = cut_lineage(ordered.mapInArrow(_compare, "doc_id long, start long, words long, core long, pos long, fore binary, back binary"))
    # two runs of rows for each partition
    edges = out.where("core is not null").select("core", "doc_id", "pos", "fore", "back").dropDuplicates(["core", "doc_id", "pos"])
    edges = edges.repartition(1).sortWithinPartitions("core", first, then, "doc_id", "pos")
    more = edges.mapInArrow(_compare, "doc_id long, start long, words long, core long, pos long, fore binary, back binary")
    return out.union(more).where("words is not null").select("doc_id", "start", "words")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words): the parts of documents, in words from 0, that another document
    repeats for MIN_WORDS words or more; parts that touch or overlap are one row.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased. Texts that are
    null or shorter repeat nothing. Rows of one doc_id are one document, whose texts do not repeat each other; rows
    without a doc_id can't be named and are not searched. Further columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    cores = cut_lineage(texts.mapInArrow(_cores, "core long, doc_id long, pos long"))
    # written, as all aggregates here that a join follows: two plain shuffles, which AQE may split at a common core
    common = cut_lineage(cores.groupBy("core").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("core"))
    places = cores.join(common, "core").groupBy("doc_id").agg(F.collect_set("pos").alias("wanted"))  # bounded by the document
    suffixes = cut_lineage(texts.join(places, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_around, _OPENED))
    narrow = suffixes.drop("low", "high")
    spans = cut_lineage(_spans(narrow, "fore", "back").union(_spans(narrow, "back", "fore")).distinct())
    return _merged(spans.union(_unmet(suffixes, spans)))


def _unmet(suffixes: DataFrame, spans: DataFrame) -> DataFrame:
    """Windows of MIN_WORDS words that two documents hold and ``spans`` may lack."""
    asked = suffixes.where("low <= high").select("doc_id", (F.col("pos") - F.col("high")).alias("at"), (F.col("pos") - F.col("low") + MIN_WORDS).alias("need"), "core", "pos")
    known = _merged(spans).select("doc_id", F.col("first_word").alias("at"), (F.col("first_word") + F.col("n_words")).alias("end"))
    # spans are apart from each other, so the last one that begins before a place ends last
    before = Window.partitionBy("doc_id").orderBy("at", F.col("end").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = asked.unionByName(known, allowMissingColumns=True).withColumn("reach", F.max("end").over(before))
    opened = cut_lineage(reached.where(F.col("core").isNotNull() & (F.coalesce("reach", F.lit(-1)) < F.col("need"))).select("core", "doc_id", "pos"))
    cores = cut_lineage(opened.select("core").distinct())
    form = "window long, doc_id long, start long"
    held = suffixes.join(cores, "core", "left_semi").select(suffixes.columns).mapInArrow(_windows, form)
    common = cut_lineage(held.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window"))
    mine = suffixes.join(opened, ["core", "doc_id", "pos"], "left_semi").select(suffixes.columns).mapInArrow(_windows, form)
    return mine.join(common, "window", "left_semi").select("doc_id", "start", F.lit(MIN_WORDS).cast("long").alias("words")).distinct()


def _merged(spans: DataFrame) -> DataFrame:
    """Spans that touch or overlap as one row: (doc_id, first_word, n_words)."""
    order = Window.partitionBy("doc_id").orderBy("start", "words")
    reach = F.max(F.col("start") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("long"))
    parts = begun.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("doc_id", "part").agg(F.min("start").alias("first_word"), F.max(F.col("start") + F.col("words")).alias("end"))
    return merged.select("doc_id", "first_word", (F.col("end") - F.col("first_word")).alias("n_words"))
