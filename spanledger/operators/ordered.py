"""Ordered computations per key that stay parallel when one key holds most rows.

A plain window sorts every row of a key in one task. Here each key is cut into
buckets that follow the order (a day, a range of sequence numbers). Rows are
ordered inside their bucket, one small row per bucket carries what crosses the
bucket edges, and the two are joined again. Should a single bucket still be large,
as when many rows share one instant, its rows are range-partitioned by the full
order and cut along the partitions. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.session import cut_lineage

BUCKET = "__bucket"
# rows of one bucket that a task may sort without becoming the one others wait for
HOT_ROWS = 5_000_000


def hot_buckets(df: DataFrame, keys: Sequence[str], bucket: Column, hot_rows: int) -> DataFrame:
    """The few (key, bucket) pairs with more than ``hot_rows`` rows, as a written table.

    At most the number of rows over ``hot_rows`` of them exist.
    """
    sizes = df.groupBy(*keys, bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    return cut_lineage(sizes.where(F.col("__n") > hot_rows).drop("__n"))


def bucketed(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], hot_rows: int
) -> DataFrame:
    """Adds the bucket, an orderable struct that never decreases along ``order``."""
    hot = hot_buckets(df, keys, bucket, hot_rows)
    whole = F.struct(F.col("__b").alias("b"), F.lit(0).alias("part"))
    rows = df.withColumn("__b", bucket)
    if hot.isEmpty():
        return rows.withColumn(BUCKET, whole).drop("__b")
    on = [*keys, "__b"]
    cores = df.sparkSession.sparkContext.defaultParallelism
    # written, so that the parts stay what they are when a task runs again
    large = cut_lineage(
        rows.join(hot, on, "left_semi")
        .repartitionByRange(max(cores, 8), *on, *order)
        .withColumn(BUCKET, F.struct(F.col("__b").alias("b"), F.spark_partition_id().alias("part")))
    )
    small = rows.join(hot, on, "left_anti").withColumn(BUCKET, whole)
    return small.unionByName(large).drop("__b")


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    values: Sequence[str],
    prefix: str = "next_",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``prefix + v`` holding column v of the following row of the key.

    ``bucket`` must not decrease along ``order``; ``order`` must be total.
    """
    rows = bucketed(df, keys, bucket, order, hot_rows)
    needed = list(dict.fromkeys([*order, *values]))
    head = F.struct(*[F.col(c) for c in needed])
    heads = (
        rows.groupBy(*keys, BUCKET)
        .agg(F.min(head).alias("__head"))
        .withColumn(
            "__after", F.lead("__head").over(Window.partitionBy(*keys).orderBy(BUCKET))
        )
        .select(*keys, BUCKET, "__after")
    )
    inside = rows.withColumn(
        "__lead", F.lead(head).over(Window.partitionBy(*keys, BUCKET).orderBy(*order))
    )
    a, b = inside.alias("a"), heads.alias("b")
    cond = F.lit(True)
    for key in [*keys, BUCKET]:
        cond = cond & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    joined = a.join(b, cond, "left")
    # an own lead always exists unless the row is the last of its bucket
    follow = F.coalesce(F.col("a.__lead"), F.col("b.__after"))
    return joined.select(
        *[F.col(f"a.{c}") for c in df.columns],
        *[follow[v].alias(prefix + v) for v in values],
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    value: Column,
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds the sum of ``value`` over the key up to and including the row."""
    rows = bucketed(df, keys, bucket, order, hot_rows).withColumn("__value", value)
    before = (
        rows.groupBy(*keys, BUCKET)
        .agg(F.sum("__value").alias("__total"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__total").over(
                    Window.partitionBy(*keys)
                    .orderBy(BUCKET)
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select(*keys, BUCKET, "__before")
    )
    inside = rows.withColumn(
        "__inside",
        F.sum("__value").over(
            Window.partitionBy(*keys, BUCKET)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    return inside.join(before, [*keys, BUCKET]).select(
        *[F.col(c) for c in df.columns], (F.col("__before") + F.col("__inside")).alias(out)
    )


def sum_before(
    events: DataFrame,
    keys: Sequence[str],
    row_id: Sequence[str],
    micros: str,
    value: str,
    span_micros: int,
    bucket_micros: int,
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per event: sum of ``value`` over its key in [t - span, t).

    Built from prefix sums: each event also asks for the prefix at t and at
    t - span, and the two answers are subtracted per event.
    """
    zero = F.lit(0).cast("bigint")

    def point(at: Column, after: int, amount: Column, sign: int) -> Column:
        return F.struct(
            at.alias("at"),
            F.lit(after).alias("after"),
            amount.cast("bigint").alias("amount"),
            F.lit(sign).alias("sign"),
        )

    t = F.col(micros)
    points = events.select(
        *keys,
        *row_id,
        F.explode(
            F.array(
                point(t, 1, F.col(value), 0),
                point(t, 0, zero, 1),
                point(t - F.lit(span_micros), 0, zero, -1),
            )
        ).alias("p"),
    ).select(*keys, *row_id, "p.*")
    bucket = F.floor(F.col("at") / F.lit(bucket_micros))
    order = ["at", "after", *row_id, "sign"]
    summed = running_sum(points, keys, bucket, order, F.col("amount"), "prefix", hot_rows)
    return (
        summed.where(F.col("sign") != 0)
        .groupBy(*keys, *row_id)
        .agg(F.sum(F.col("prefix") * F.col("sign")).cast("bigint").alias(out))
    )


def count_within(
    events: DataFrame,
    keys: Sequence[str],
    row_id: Sequence[str],
    micros: str,
    span_micros: int,
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per event: number of rows of its key strictly inside (t - span, t).

    Each row is placed in its own span-wide bucket and, as context, in the next.
    Where a bucket is too large for that, prefix sums give the same number.
    """
    home = F.floor(F.col(micros) / F.lit(span_micros))
    if not hot_buckets(events, keys, home, hot_rows).isEmpty():
        counted = sum_before(
            events.withColumn("__one", F.lit(1)), keys, row_id, micros, "__one",
            span_micros - 1, span_micros, out, hot_rows,
        )
        return events.join(counted, [*keys, *row_id])
    placed = events.withColumn("__home", home).withColumn(
        BUCKET, F.explode(F.array(F.col("__home"), F.col("__home") + 1))
    )
    frame = (
        Window.partitionBy(*keys, BUCKET).orderBy(micros).rangeBetween(-(span_micros - 1), -1)
    )
    return (
        placed.withColumn(out, F.count(F.lit(1)).over(frame))
        .where(F.col(BUCKET) == F.col("__home"))
        .select(*events.columns, out)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key; aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    packed = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("__r"))
    return packed.select(*keys, "__r.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key; aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    packed = df.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("__r"))
    return packed.select(*keys, "__r.*").select(*df.columns)


def with_keys_of(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``df`` semi- or anti-joined with the keys of ``other``; null keys are equal, as they are to an aggregate."""
    told = other.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(told, same, how)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, as a written table.

    Hashes are counted first, and only rows whose hash comes twice send their keys, to be compared as they are. ``df`` is
    read twice, so it should be a written table.
    """
    hashed = df.select(*keys).withColumn("__h", F.xxhash64(*keys))
    twice = cut_lineage(hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h"))
    if twice.isEmpty():
        return df.select(*keys).where(F.lit(False))
    some = hashed.join(twice, "__h", "left_semi")
    return cut_lineage(some.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))


def once_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key, for tables in which few keys repeat.

    Counting needs the keys' hashes alone; what repeats is written, and only its rows are compared as a whole. All others
    pass by an anti-join with that table, whose size decides how it is joined. ``df`` is read four times, so it should be
    a written table.
    """
    repeated = repeated_keys(df, keys)
    return with_keys_of(df, repeated, keys, "left_anti").unionByName(first_per_key(with_keys_of(df, repeated, keys, "left_semi"), keys, order))
