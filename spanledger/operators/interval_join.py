"""Joins of points with intervals, and of intervals that overlap, as equi-joins.

Intervals lie on levels of buckets whose width grows by four: each goes to the finest level whose buckets are at
least as long as it, so it touches one or two of them. A point looks into its one bucket of each level that holds
an interval. Long intervals cost no more rows than short ones, a pair meets exactly once, and a key with many rows is spread over its
buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 11


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: Column, start: Column, end: Column) -> DataFrame:
    """Rows of ``points`` with every row of ``intervals`` of equal ``keys`` and ``start <= at < end``.

    ``at``, ``start`` and ``end`` are whole numbers (instants in microseconds, positions). A null end is open, a null start
    or point fits nothing, and so does an interval that ends where it starts. Other columns must differ in name. Both tables are
    read twice, so they should be written ones.
    """
    told = points.where(at.isNotNull()).agg(F.min(at).alias("low"), F.max(at).alias("high")).first()  # one row
    low, high = (told.low, told.high) if told.low is not None else (0, 0)
    base = max(1, -(-(high - low + 1) // 4 ** (LEVELS - 1)))
    begin, stop = F.greatest(start, F.lit(low)) - low, F.least(F.coalesce(end, F.lit(high + 1)), F.lit(high + 1)) - low
    spans = intervals.where(start.isNotNull()).withColumns({"__begin": begin.cast("long"), "__stop": stop.cast("long")}).where("__begin < __stop")
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(F.col("__stop") - F.col("__begin") <= base * 4**k, F.lit(k)).otherwise(level)
    spans = spans.withColumn("__level", level)
    held = sorted(r[0] for r in spans.select("__level").distinct().collect())  # at most as many as there are levels
    width = F.lit(base) * F.expr("shiftleft(1L, 2 * __level)")
    bucket = F.sequence(F.floor(F.col("__begin") / width), F.floor((F.col("__stop") - 1) / width))
    spans = spans.withColumn("__bucket", F.explode(bucket))
    place = (at - low).cast("long")
    looks = F.array(*(F.struct(F.lit(k).alias("__level"), F.floor(place / (base * 4**k)).alias("__bucket")) for k in held or [0]))
    asked = points.where(at.isNotNull()).withColumn("__at", place).select("*", F.inline(looks))
    met = asked.join(spans, [*keys, "__level", "__bucket"])
    return met.where((F.col("__begin") <= F.col("__at")) & (F.col("__at") < F.col("__stop"))).drop("__level", "__bucket", "__at", "__begin", "__stop")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column]) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose spans [start, end) share a place; empty spans share none.

    Two spans overlap where one begins inside the other, so two point joins find each pair once.
    """
    some_left, some_right = left.where(left_span[0] < left_span[1]), right.where(right_span[0] < right_span[1])
    first = points_in_intervals(some_right, some_left, keys, right_span[0], *left_span)
    # the spans that begin together are found above already
    second = points_in_intervals(some_left, some_right, keys, left_span[0], right_span[0] + 1, right_span[1])
    return first.unionByName(second)
