"""Archived snapshots whose items carry a content hash, and whose ranges carry hashes that two snapshots compare by.

An item's range is the beginning of its key's hash. A range's hash adds up its items' hashes, which needs no
order and adds up before the shuffle; each shorter beginning hashes its sixteen parts. Items are written by range, so a
comparison walks down from the one root through ranges that differ and reads the items of those alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 2  # hexadecimal digits of a range; 16 ** DIGITS ranges
CHUNKS = 4  # of a hash's digits, each added up on its own


def canonical(df: DataFrame) -> Column:
    """A row as JSON: columns in order of name, every value as text, nulls kept."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def items(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(item_id, content, content_hash, range) of every row; ``keys`` name a row and are not null."""
    item = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in keys)))
    content = canonical(df)
    return df.select(item.alias("item_id"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), F.substring(F.sha2(item, 256), 1, DIGITS).alias("range"))


def tree(rows: DataFrame) -> DataFrame:
    """(prefix, items, hash) of all ranges of ``rows`` (item_id, content_hash, range) and of all their beginnings up to ''."""
    said = F.sha2(F.concat_ws(" ", "item_id", "content_hash"), 256)
    parts = [F.conv(F.substring(said, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(CHUNKS)]
    sums = rows.groupBy(F.col("range").alias("prefix")).agg(F.count(F.lit(1)).alias("items"), *(F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)))
    level = sums.select("prefix", "items", F.sha2(F.concat_ws(":", "prefix", F.col("items").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(CHUNKS))), 256).alias("hash"))
    out = level
    for size in reversed(range(DIGITS)):
        under = F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "hash")))  # sixteen at most
        level = level.groupBy(F.substring("prefix", 1, size).alias("up")).agg(F.sum("items").alias("items"), F.sha2(F.array_join(under, " "), 256).alias("hash")).withColumnRenamed("up", "prefix")
        out = out.unionByName(level)
    return out


def write(df: DataFrame, keys: Sequence[str], path: str) -> None:
    """Writes the items of ``df`` under ``path``/items, a folder a range, and the hashes under ``path``/tree."""
    items(df, keys).hint("rebalance", "range").write.partitionBy("range").parquet(f"{path}/items")
    spark = df.sparkSession
    # a few hundred rows
    tree(read(spark, path)).coalesce(1).write.parquet(f"{path}/tree")


def read(spark: SparkSession, path: str, ranges: Sequence[str] | None = None) -> DataFrame:
    """The items of an archive, or those of some ranges: only their folders are read."""
    rows = spark.read.schema("item_id string, content string, content_hash string, range string").parquet(f"{path}/items")
    return rows if ranges is None else rows.where(F.col("range").isin(*ranges)) if ranges else rows.where(F.lit(False))


def root(spark: SparkSession, path: str) -> str | None:
    """The hash of a whole archive, its id; null for an empty one."""
    top = spark.read.parquet(f"{path}/tree").where("prefix = ''").first()
    return top.hash if top else None


def differing_ranges(spark: SparkSession, one: str, two: str) -> list[str]:
    """Ranges whose items differ, found from the root downwards through what differs."""
    a, b = (spark.read.parquet(f"{p}/tree").select("prefix", F.col("hash").alias(n)) for p, n in ((one, "a"), (two, "b")))
    both = a.join(b, "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix").cache()
    open_ = [""]
    try:
        for size in range(DIGITS + 1):  # at most 16 ** size rows
            open_ = [r.prefix for r in both.where((F.length("prefix") == size) & F.substring("prefix", 1, max(0, size - 1)).isin(*open_)).collect()] if open_ else []
    finally:
        both.unpersist()
    return sorted(open_)


def changes(spark: SparkSession, one: str, two: str) -> DataFrame:
    """(item_id, change, old_hash, new_hash): items ``added``, ``removed`` or ``changed`` from archive ``one`` to ``two``."""
    ranges = differing_ranges(spark, one, two)
    a, b = (read(spark, p, ranges).select("range", "item_id", F.col("content_hash").alias(n)) for p, n in ((one, "old_hash"), (two, "new_hash")))
    met = a.join(b, ["range", "item_id"], "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
    return met.select("item_id", kind.alias("change"), "old_hash", "new_hash")
