"""Near-duplicate documents by HyperMinHash.

The distinct shingles of a text are dealt by their leading hash bits into 256 buckets. A
bucket's register keeps of its least hash the number of leading zeros and the next ten bits. An
empty bucket takes the register of another one, named by a fixed sequence of draws. Five registers
make a band, 51 bands an index: texts of similarity 0.75 share no band with a chance of about 1e-6.
Texts in one band are candidates; the share of equal registers, corrected for registers that agree
by chance, drops the hopeless ones; the full sets confirm the rest.

No band is expanded into all its pairs. First every text of a band meets the band's most central
text, the one that shares its bands with the most others, and the confirmed links give components. Only bands that still hold several components are looked
at again: there every text outside the band's main component meets the others, in blocks of
bounded size, and only pairs that join components leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import words as W
from spanledger.llm.components import components
from spanledger.session import cut_lineage

BUCKETS, MANTISSA = 256, 10
BAND = 5
BANDS = BUCKETS // BAND
BLOCK = 512
SKETCH = 1024  # least members of a set that stand for it in a block; smaller sets are whole there
_MOST = np.uint64(2**64 - 1)
SLACK = 6.0  # standard deviations that an estimate may fall short of the threshold

_draws = np.random.Generator(np.random.PCG64(7)).integers(0, BUCKETS, (1024, BUCKETS))
_edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)


def registers(shingles: np.ndarray) -> np.ndarray:
    """256 registers (uint16: leading zeros in the high six bits, then the mantissa) of a sorted
    set; an empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.uint16)
    at = np.searchsorted(shingles, _edges)
    full = np.empty(BUCKETS, bool)
    full[:-1] = at[1:] > at[:-1]
    full[-1] = at[-1] < len(shingles)
    rest = shingles[np.minimum(at, len(shingles) - 1)] << np.uint64(8)  # the bits below the bucket's
    top = (rest >> np.uint64(11)).astype(np.float64)  # 53 bits are exact
    zeros = np.where(top > 0, 52 - np.floor(np.log2(np.maximum(top, 1))), 53).astype(np.uint64)
    zeros = np.minimum(zeros, 45)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~full)
    for draw in _draws:
        if not len(empty):
            break
        pick = draw[empty]
        hit = full[pick]
        out[empty[hit]] = out[pick[hit]]
        empty = empty[~hit]
    if len(empty):  # a chance of about e-4 for one shingle alone: then the first full bucket
        out[empty] = out[np.flatnonzero(full)[0]]
    return out


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that registers of two unrelated sets of these sizes agree."""
    octave = np.arange(46)
    high, low = 2.0**-octave, np.where(octave < 45, 2.0 ** -(octave + 1), 0.0)

    def share(n):  # of buckets whose least value lies in an octave
        load = np.maximum(np.asarray(n, float), BUCKETS)[..., None] / BUCKETS
        return np.power(1 - low, load) - np.power(1 - np.minimum(high, 1), load)

    return (share(n_a) * share(n_b)).sum(-1) / 2**MANTISSA


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, without those equal by chance."""
    c = chance(n_a, n_b)
    return np.clip((equal / BUCKETS - c) / (1 - c), 0, 1)


def worth(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair can reach the threshold: by its sizes for certain, by its estimate with
    SLACK deviations to spare. A set smaller than the buckets fills fewer registers on its own, which
    widens the deviation; one that fills under a quarter goes to the full check unseen."""
    level = percent / 100
    least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    own = 0.6 * np.minimum(least, BUCKETS)
    near = estimate(equal, n_a, n_b) >= level - SLACK * (level * (1 - level) / own) ** 0.5
    return (100 * least >= percent * most) & (near | (4 * least < BUCKETS))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in W.pieces(batch):
            n, one, two, regs = [], [], [], []
            for s in W.shingle_sets(*W.word_hashes(buf, offs)):
                n.append(len(s))
                mixed = W.finish(s + np.uint64(0x5851F42D4C957F2D))
                one.append(s.sum(dtype=np.uint64).astype(np.int64))
                two.append(mixed.sum(dtype=np.uint64).astype(np.int64))
                regs.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())],
                ["doc_id", "n", "d1", "d2", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in W.pieces(batch):
            packed = [s.tobytes() for s in W.shingle_sets(*W.word_hashes(buf, offs))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(packed, pa.binary())], ["node", "members"])


def _matrix(column: pa.Array) -> np.ndarray:
    buf, _ = W.raw(column)
    return buf.view(np.uint16).reshape(-1, BUCKETS)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, regs) of whole texts: set size, a 128-bit digest of the set, registers."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_sketch, "doc_id long, n long, d1 long, d2 long, regs binary")


def _promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that sizes and registers do not rule out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b"))
    met = pairs.join(right, "b").join(left, "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def keep(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                equal = (_matrix(part.column(3)) == _matrix(part.column(5))).sum(1)
                good = worth(equal, part.column(2).to_numpy(), part.column(4).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good))

    return met.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(keep, "a long, b long").distinct()


def _read_out(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members): the full sets of the given nodes, read out of the texts again. The nodes grow with
    the corpus, so they are met by a merge at every size."""
    return texts.join(nodes.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id").mapInArrow(_sets, "node long, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. A text in many pairs is a skewed join
    key, which Spark splits."""
    def check(batches):
        for batch in batches:
            (one, at), (two, bt) = W.raw(batch.column(2)), W.raw(batch.column(3))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = one[at[i] : at[i + 1]].view(np.uint64), two[bt[i] : bt[i + 1]].view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("s_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("members").alias("s_a")), "a"
    )
    return met.select("a", "b", "s_a", "s_b").mapInArrow(check, "a long, b long").distinct()


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, least): of each set its size and its least SKETCH members."""
    for batch in batches:
        buf, at = W.raw(batch.column(1))
        sets = [buf[x:y].view(np.uint64) for x, y in zip(at[:-1], at[1:], strict=True)]
        short = [s[:SKETCH].tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(short, pa.binary())], ["node", "n", "least"])


def _open_bands(banded: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (band, node, component, main, wide, deep) of bands that hold several components."""
    labelled = banded.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    sizes = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("held"))
    main = cut_lineage(sizes).groupBy("band").agg(
        F.sum("held").alias("total"), F.max(F.struct("held", "component")).alias("top"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1 and total > 2")
    main = main.select(
        "band", F.col("top.component").alias("main"), F.ceil(F.col("total") / BLOCK).cast("long").alias("wide"),
        F.ceil((F.col("total") - F.col("top.held")) / BLOCK).cast("long").alias("deep"),
    )
    return labelled.join(cut_lineage(main), "band")


def _leftover(rows: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """Pairs between components that share a band and look alike by their short sets.

    A band's rows outside its main component meet all its rows, in blocks of bounded size. A
    block gives no more pairs than join its components, but for texts too long to be sure of.
    """
    rows = rows.join(short, "node")
    mine = F.pmod(F.xxhash64("node"), F.col("wide"))
    theirs = F.pmod(F.xxhash64("node"), F.col("deep"))
    shape = ["band", "i", "j", "stray", "node", "component", "n", "least"]
    every = rows.select("*", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("deep") - 1)).alias("j"), F.lit(False).alias("stray"))
    stray = rows.where("component <> main").select("*", theirs.alias("j"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("i"), F.lit(True).alias("stray"))
    blocks = every.select(*shape).union(stray.select(*shape))
    blocks = blocks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def meet(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cut = _last_group(table)
            if cut:
                yield from _meet_groups(table.slice(0, cut), percent)
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from _meet_groups(held, percent)

    return blocks.mapInArrow(meet, "a long, b long").distinct()


def _last_group(table: pa.Table) -> int:
    keys = [table.column(c).to_numpy() for c in (0, 1, 2)]
    same = np.logical_and.reduce([k == k[-1] for k in keys])
    return int(np.flatnonzero(~same)[-1] + 1) if not same.all() else 0


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``one`` has in common with each of ``two``."""
    flat = np.concatenate([*one, *two])
    owner = np.repeat(np.arange(len(one) + len(two)), [len(s) for s in (*one, *two)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    twice = np.zeros(len(flat) + 1, bool)
    twice[1:-1] = flat[1:] == flat[:-1]
    keep = twice[1:] | twice[:-1]  # a member of one set alone is shared with none
    flat, owner = flat[keep], owner[keep]
    column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]])) if len(flat) else flat
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [at, at + 8192])
        held = np.zeros((len(one) + len(two), 8192), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        out += held[: len(one)] @ held[len(one) :].T
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity estimated from the least members of two sets, up to where both are known."""
    edge = min(a[-1] if len(a) >= SKETCH else _MOST, b[-1] if len(b) >= SKETCH else _MOST)
    a, b = a[a <= edge], b[b <= edge]
    both = len(np.intersect1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def _meet_groups(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    keys = [table.column(c).to_numpy() for c in (0, 1, 2)]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    stray, node, comp, n = (table.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6))
    buf, offs = W.raw(table.column(7))
    sets = [buf[x:y].view(np.uint64) for x, y in zip(offs[:-1], offs[1:], strict=True)]
    starts = [*np.flatnonzero(new).tolist(), table.num_rows]
    level = percent / 100
    loose = level - SLACK * (level * (1 - level) / SKETCH) ** 0.5
    found: list[tuple[int, int]] = []
    for at, end in zip(starts[:-1], starts[1:], strict=True):
        inside = np.arange(at, end)
        ones, twos = inside[stray[at:end]], inside[~stray[at:end]]
        if not len(ones) or not len(twos):
            continue
        both = _shared([sets[i] for i in ones], [sets[i] for i in twos])
        sizes = (np.minimum.outer(n[ones], n[twos]) * 100 >= percent * np.maximum.outer(n[ones], n[twos])) & (comp[ones][:, None] != comp[twos][None, :])
        whole = (n[ones][:, None] <= SKETCH) & (n[twos][None, :] <= SKETCH)
        sure = sizes & whole & (100 * both >= percent * (n[ones][:, None] + n[twos][None, :] - both))
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for i, j in zip(*np.nonzero(sure), strict=True):
            x, y = root(comp[ones[i]]), root(comp[twos[j]])
            if x != y:
                joined[max(x, y)] = min(x, y)
                found.append((node[ones[i]], node[twos[j]]))
        for i, j in zip(*np.nonzero(sizes & ~whole & (both >= 0.4 * SKETCH)), strict=True):
            if _alike(sets[ones[i]], sets[twos[j]]) >= loose:
                found.append((node[ones[i]], node[twos[j]]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents whose sets of distinct five-word shingles share ``percent`` of their union are
    linked; component_id is the least doc_id reachable over links, kept says it is the row's own.
    Fewer than five words are one shingle; a null or empty text has none and links to nothing.
    Rows with the same doc_id are one node, whatever their texts. A null doc_id can't be named: its
    row has a null component and is kept. Further columns of ``docs`` are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(sketches(texts))
    filled = rows.where("doc_id is not null and n > 0")
    # written, as all aggregates here that a join follows: two plain shuffles, which AQE may split at a hot key
    classes = cut_lineage(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")))
    nodes = filled.join(classes, ["d1", "d2"]).where("doc_id = node").select("node", "n", "regs").dropDuplicates(["node", "regs"])
    nodes = cut_lineage(nodes)
    copies = filled.join(classes, ["d1", "d2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()

    width = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))
    index = nodes.select("node", F.explode(bands).alias("band"))
    shared = cut_lineage(index.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    met = cut_lineage(index.join(shared, "band"))
    # the text with the most company in all its bands stands in the middle of its group
    middle = cut_lineage(met.groupBy("node").agg(F.sum("held").alias("company")))
    pivot = met.join(middle, "node").groupBy("band").agg(F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("top"))
    pivot = cut_lineage(pivot.select("band", (-F.col("top.node")).alias("pivot")))
    banded = cut_lineage(met.select("band", "node").join(pivot, "band"))

    stars = banded.where("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    sets = cut_lineage(_read_out(texts, banded.select("node").distinct()))
    links = cut_lineage(_confirmed(_promising(stars, nodes, percent), sets, percent))
    rows_open = cut_lineage(_open_bands(banded.select("band", "node"), components(links)))
    short = sets.join(rows_open.select("node").distinct(), "node").select("node", "members").mapInArrow(_least, "node long, n long, least binary")
    pairs = _leftover(rows_open, short, percent)
    rest = _confirmed(pairs, sets, percent)
    more = cut_lineage(links.select("a", "b").union(rest).union(copies))
    found = components(more)
    out = rows.select("doc_id", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, with one row for each component of near-duplicates.

    Rows without a doc_id stay. Of rows that share a kept doc_id any one stays.
    """
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__kept")).agg(F.count(F.lit(1)).alias("__rows"))
    kept = cut_lineage(kept)
    key = docs["doc_id"].cast("long")
    # two joins by the same key: where texts are shuffled, they are shuffled once
    alone, shared = kept.where("__rows = 1"), kept.where("__rows > 1")
    single = docs.join(alone, key == alone["__kept"], "left_semi")
    several = docs.join(shared, key == shared["__kept"], "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(docs.where(key.isNull()))
