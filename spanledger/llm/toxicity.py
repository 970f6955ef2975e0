"""Toxic documents by a recurrent network over all their windows.

The network and its vocabulary are learnt from labelled documents alone, in one task, from a bounded
sample: SAMPLE rows of each label, in the order of a hash of doc_id, with texts up to LONGEST
code points, as far as SAMPLE_BYTES go. Labels hold for documents, so each round of training picks the windows that speak for them: the
most telling window of a toxic document, the most telling and a random one of the others. A
logistic regression over a document's windows, weighted to the labels' true shares, gives its score. Scoring
reads every window of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm import recurrent as R
from spanledger.llm import words as W
from spanledger.session import cut_lineage

SAMPLE = {1: 2000, 0: 4000}
LONGEST = 20_000
SAMPLE_BYTES = 32 << 20  # of text, all rows together
PIECE_BYTES = 1 << 20  # of text in work at once
VOCABULARY = 2048
ROUNDS = (4, 4)  # epochs of each round
REJECT = 0.7


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3


def sample(docs: DataFrame, labels: DataFrame, bound: dict[int, int] = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """(doc_id, text, toxic, share): labelled rows outside the held-out fold, and how many each stands for.

    Several labels of one doc_id count as toxic if one is; null labels and doc_ids are left out. Of several texts of
    one doc_id the greatest is taken.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    told = told.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    picked = [
        told.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("share", F.lit(max(1.0, totals.get(label, 0) / n)))
        for label, n in bound.items()
    ]
    chosen = cut_lineage(picked[0].union(picked[1]))  # bounded by SAMPLE
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.where(F.char_length("text") <= longest).join(chosen, "doc_id")
    return met.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"), F.max("share").alias("share"))


def _pieces(texts: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of consecutive rows with about PIECE_BYTES of text each."""
    batch, out, at = pa.RecordBatch.from_arrays([texts], ["text"]), [], 0
    for rows, buf, offs in W.pieces(batch, limit=PIECE_BYTES):
        out.append((at, buf, offs))
        at += rows.num_rows
    return out


def _word_counts(pieces: list[tuple[int, np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of all words, in how many texts each occurs, and in how many toxic ones."""
    uniq, held, bad = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for at, buf, offs in pieces:
        hashes, _, _, first, _ = R.inputs(buf, offs)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        order = np.lexsort((row, hashes))
        hashes, row = hashes[order], row[order]
        once = np.ones(len(hashes), bool)
        once[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, flag = hashes[once], toxic[at + row[once]].astype(float)
        every = np.concatenate([uniq, hashes])
        merged, back = np.unique(every, return_inverse=True)
        held = np.bincount(back, np.concatenate([held, np.ones(len(hashes))]), len(merged))
        bad = np.bincount(back, np.concatenate([bad, flag]), len(merged))
        uniq = merged
    return uniq, held, bad


def _last_of_each(order: np.ndarray, row: np.ndarray) -> np.ndarray:
    return order[np.append(np.flatnonzero(np.diff(row[order])), len(order) - 1)] if len(order) else order


def _windows_to_train(p: R.Params, pieces: list[tuple[int, np.ndarray, np.ndarray]], toxic: np.ndarray, signal: np.ndarray | None, rng: np.random.Generator) -> tuple:
    """The windows that speak for their texts, as ``train`` takes them: the most telling one of each text, then a random
    one of each text that isn't toxic. ``signal`` per word row says what is telling; without it the network does."""
    told, extra = [], []
    for at, buf, offs in pieces:
        hashes, begin, end, first, (low, starts, ends) = R.inputs(buf, offs)
        word = R.known(p, hashes)
        row, start, size = R.windows(first)
        noise = rng.random(len(row))
        if not len(row):
            continue
        if signal is None:
            telling = R.evidence(p, buf, offs)[2].astype(float)
        else:
            run = np.concatenate([[0.0], np.cumsum(signal[word])])
            telling = run[start + size] - run[start]
        best, other = _last_of_each(np.lexsort((noise, telling, row)), row), _last_of_each(np.lexsort((noise, row)), row)
        for pick, into in ((best, told), (other[toxic[at + row[other]] == 0], extra)):
            spot = np.minimum(start[pick][:, None] + np.arange(R.LENGTH), len(word) - 1)
            flat = spot.ravel()
            bytes_ = np.repeat(starts[flat], ends[flat] - starts[flat])
            bytes_ += np.arange(len(bytes_)) - np.repeat(np.cumsum(ends[flat] - starts[flat]) - (ends[flat] - starts[flat]), ends[flat] - starts[flat])
            into.append((word[spot], begin[spot], end[spot], size[pick], toxic[at + row[pick]].astype(np.float32), low[bytes_], ends[flat] - starts[flat]))
    if not told:
        return ()
    word, begin, end, size, label, low, width = (np.concatenate(x) for x in zip(*told, *extra, strict=True))
    ends = np.cumsum(width)
    return word, begin, end, size, label, (low, ends - width, ends), np.arange(len(width)).reshape(word.shape)


def _learn(texts: pa.Array, toxic: np.ndarray, share: np.ndarray) -> R.Params | None:
    """The trained network, from a sample that is read a piece at a time."""
    if len(set(toxic.tolist())) < 2:
        return None
    pieces = _pieces(texts)
    # words by how much more often toxic documents hold them, in standard deviations
    uniq, held, bad = _word_counts(pieces, toxic)
    rate = toxic.mean()
    lean = (bad - held * rate) / np.sqrt(held * rate * (1 - rate) + 1)
    often = held >= 5
    chosen = np.sort(np.union1d(np.argsort(-np.abs(lean) * often)[: VOCABULARY // 2], np.argsort(-held)[: VOCABULARY // 2]))
    p = R.fresh(uniq[chosen])
    signal = np.concatenate([[0.0], np.maximum(lean[chosen] - 4, 0)])
    rng = np.random.Generator(np.random.PCG64(5))
    for k, epochs in enumerate(ROUNDS):
        given = _windows_to_train(p, pieces, toxic, None if k else signal, rng)
        if given:
            R.train(p, *given, epochs, seed=k + 1)
    found = np.concatenate([R.evidence(p, buf, offs)[3] for _, buf, offs in pieces])
    p["final"] = _fit(_expand(found), toxic.astype(float), share)
    return p


def _expand(x: np.ndarray) -> np.ndarray:
    """A document's sums with their squares and products, and one."""
    x = x / np.array([5.0, 1.0, 2.0, 5.0])
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.stack([np.ones(len(x)), *x.T, *pairs], 1)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton's steps."""
    b = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - q)) - hold * b
        bend = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(bend, slope)
        b += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """The trained network, or None without labels of both kinds. One task trains on the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], SAMPLE_BYTES
        for batch in batches:
            taken = min(batch.num_rows, int(np.searchsorted(W.raw(batch.column(0))[1][1:], room, "right")))
            held.append(batch.slice(0, taken))
            room -= int(W.raw(batch.column(0))[1][taken])
            if taken < batch.num_rows:
                break
        p = None
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            p = _learn(table.column(0).combine_chunks(), table.column(1).to_numpy(), table.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([R.dump(p)] if p else [], pa.binary())], ["model"])

    chosen = sample(docs, labels).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "toxic", "share")
    made = chosen.mapInArrow(run, "model binary").collect()  # one row of a fixed size
    return bytes(made[0].model) if made else None


def score(docs: DataFrame, model: bytes | None) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; without a model every score is 0."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = R.load(model) if model else None
        for batch in batches:
            for rows, buf, offs in W.pieces(batch, limit=1 << 20):
                value = np.zeros(rows.num_rows)
                if p:
                    x = _expand(R.evidence(p, buf, offs)[3]) @ p["final"]
                    value = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(value, pa.float64())], ["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) teaches; held_out says that a row's fold was kept from training, false for a
    null doc_id. A null or empty text has no windows and scores low. Repeated rows are scored each.
    Without labels of both kinds all scores are 0. Further columns are not read.
    """
    out = score(docs, learn(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``reject``.

    A null or empty text scores low and stays; repeated rows are judged alike; an empty table stays empty. Without labels
    of both kinds all rows stay. ``doc_id`` teaches only, as in ``learn``.
    """
    model = learn(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = R.load(model) if model else None
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for rows, buf, offs in W.pieces(batch.set_column(at, "text", batch.column(at).cast(pa.string())), limit=1 << 20):
                if p:
                    x = _expand(R.evidence(p, buf, offs)[3]) @ p["final"]
                    rows = rows.filter(pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))) < reject))
                yield rows

    return docs.mapInArrow(keep, docs.schema)
