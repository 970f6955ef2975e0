"""Benchmark items inside documents: size-partitioned MinHash containment, by DataFrame functions only.

An item of q shingles that a document holds to a share c misses at most (1 - c) q of them. So of
its floor((1 - c) q) + 1 least hashes, its MinHash sketch, at least one lies in every such document: the
search loses nothing. Items are partitioned by the magnitude of q. Every partition has a bound, the
greatest hash of its sketches, and a document looks only at its own hashes up to the bounds of the
partitions whose items it is long enough to hold. Hits are joined to the sketches; candidate pairs are
verified on all shingles of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import shingles as S
from spanledger.session import cut_lineage

PERCENT = 75


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, q, hashes): distinct texts of items with their distinct shingles."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    made = texts.select("item_id", F.xxhash64("item_id", "text").alias("item"), S.words(F.col("text")).alias("words")).dropDuplicates(["item"])
    made = made.select("item_id", "item", F.sort_array(F.array_distinct(S.shingles("words"))).alias("hashes"))
    return made.where(F.size("hashes") > 0).withColumn("q", F.size("hashes"))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment, text_hash) of every document that holds
    an item's distinct five-word shingles to ``percent`` or more.

    Words are lower-cased. An item of fewer than five words is one shingle and found only in a document
    of the same words; one without words, or with a null text, is in none, as nothing is in a document
    without words. Equal rows give one row; rows of one doc_id with other texts one each; a null
    doc_id is kept. Either table may be empty. Further columns are not read.
    """
    items = cut_lineage(_items(benchmark))
    miss = F.floor(F.col("q") * (100 - percent) / 100).cast("int") + 1
    magnitude = F.floor(F.log2(F.col("q"))).cast("int")
    sketch = cut_lineage(items.select("item", "q", magnitude.alias("part"), F.explode(F.slice("hashes", F.lit(1), miss)).alias("hash")))
    # one bound for each power of two that a size can have
    bounds = {r.part: r.bound for r in sketch.groupBy("part").agg(F.max("hash").alias("bound")).collect()}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), S.words(F.col("text")).alias("words"))
    held = held.select("doc_id", "text_hash", S.shingles("words").alias("hashes"))
    limit = F.lit(None).cast("long")
    for part, bound in sorted(bounds.items(), key=lambda b: b[1]):  # the greatest bound that applies comes last
        limit = F.when(100 * F.size("hashes") >= percent * 2**part, F.lit(bound)).otherwise(limit)
    probes = held.withColumn("limit", limit).select("doc_id", "text_hash", F.explode(F.filter("hashes", lambda h: h <= F.col("limit"))).alias("hash"))
    pairs = cut_lineage(probes.join(sketch, "hash").select("doc_id", "text_hash", "item").distinct())

    again = texts.withColumn("text_hash", F.xxhash64("text"))
    found = again.join(
        pairs.withColumnRenamed("doc_id", "named").withColumnRenamed("text_hash", "told"),
        (F.col("text_hash") == F.col("told")) & F.col("doc_id").eqNullSafe(F.col("named")),
    ).select("doc_id", "text_hash", "item", S.words(F.col("text")).alias("words"))
    found = found.select("doc_id", "text_hash", "item", S.shingles("words").alias("own")).join(items, "item")
    found = found.select("doc_id", "item_id", F.col("q").cast("long").alias("item_shingles"), F.size(F.array_intersect("hashes", "own")).cast("long").alias("shared"), "text_hash")
    found = found.where(100 * F.col("shared") >= percent * F.col("item_shingles"))
    best = found.groupBy("doc_id", "item_id", "text_hash").agg(F.max(F.struct(F.col("shared") / F.col("item_shingles"), "shared", "item_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.item_shingles", "best.shared", F.col("best.col1").alias("containment"), "text_hash")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item.

    Null and empty texts hold none; repeated rows, and rows without a doc_id, are judged by their text. Without items, or
    without documents, nothing goes.
    """
    found = contaminated(docs, benchmark, percent)
    bad = found.select(F.col("doc_id").alias("__bad_doc"), F.col("text_hash").alias("__bad_text")).distinct()
    bad = cut_lineage(bad)  # its size is known to the join, which needn't shuffle texts for a few keys
    met = F.xxhash64(docs["text"].cast("string")).eqNullSafe(bad["__bad_text"]) & docs["doc_id"].cast("long").eqNullSafe(bad["__bad_doc"])
    return docs.join(bad, met, "left_anti")
