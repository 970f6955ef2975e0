"""Streams of ledger events and requests.

Each function runs what is available of a stream and returns a table. What the watermark has passed is final and
leaves the state; rows that come behind it are kept in a side table and merged by key where merging can put them right.
``delay_ms`` is how far rows may be out of order; ``root`` is the folder of a feed that goes on later; ``finish``
says that it is complete, so that all that waits becomes final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.operators.ordered import first_per_key
from spanledger.session import cut_lineage
from spanledger.streaming.state import admitted, run_feed

EVENT = ["tenant_id", "event_id"]
SUMS = ["event_count", "input_tokens", "output_tokens", "cost_millicents"]
DAY_MS = 24 * 3_600_000


def dedupe(events: DataFrame, delay_ms: int = DAY_MS, root: str | None = None, finish: bool = True) -> DataFrame:
    """Each (tenant, event id) once, the first recorded, however often and late it is delivered.

    ``events`` have ``occurred_at``, the same in every delivery of one event. An event waits in the state until the watermark
    has passed it; deliveries after that meet the table by their key.
    """
    rest = [c for c in events.columns if c not in (*EVENT, "occurred_at")]

    def once(rows: DataFrame) -> DataFrame:
        first = F.min(F.struct("recorded_at", *(c for c in rest if c != "recorded_at"))).alias("first")
        return rows.groupBy(*EVENT, "occurred_at").agg(first).select(*EVENT, "occurred_at", "first.*").select(*events.columns)

    feed = run_feed(events, "occurred_at", F.col("occurred_at"), delay_ms, once, root, finish)
    known = F.col("event_id").isNotNull()
    late = cut_lineage(feed.late.where(known))
    keys = late.select(*EVENT).distinct()
    again = first_per_key(feed.out.join(keys, EVENT, "left_semi").unionByName(late), EVENT, ["recorded_at"])
    return feed.out.join(keys, EVENT, "left_anti").unionByName(again)


def daily_usage(events: DataFrame, delay_ms: int = DAY_MS, root: str | None = None, finish: bool = True) -> DataFrame:
    """Usage per tenant and day of occurrence; late rows count in their own day.

    A day's sums are in the state until the watermark has passed its end; rows after that are added up apart.
    """
    def per_day(rows: DataFrame, start) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in SUMS]
        return rows.withColumn("event_count", F.lit(1).cast("bigint")).groupBy("tenant_id", start).agg(*sums)

    def step(rows: DataFrame) -> DataFrame:
        return per_day(rows, F.window("occurred_at", "1 day").alias("w")).select("tenant_id", F.col("w.start").alias("day"), *SUMS)

    day = F.date_trunc("day", "occurred_at")
    feed = run_feed(events, "occurred_at", day + F.expr("INTERVAL 1 DAY"), delay_ms, step, root, finish)
    late = per_day(feed.late, day.alias("day")).select("tenant_id", "day", *SUMS)
    both = feed.out.unionByName(late).groupBy("tenant_id", "day").agg(*(F.sum(c).alias(c) for c in SUMS))
    return both.select("tenant_id", "day", *SUMS)


def spend_windows(events: DataFrame, tiers: DataFrame, days: int = 30, delay_ms: int = DAY_MS, root: str | None = None, finish: bool = True) -> DataFrame:
    """Spend per tenant in windows of ``days`` that slide by a day, and whether the cap is reached."""
    daily = daily_usage(events, delay_ms, root, finish)
    first = F.expr(f"day - INTERVAL {days - 1} DAY")
    starts = F.explode(F.sequence(first, F.col("day"), F.expr("INTERVAL 1 DAY")))
    # only days are multiplied, never events
    spent = (
        daily.select("tenant_id", "cost_millicents", starts.alias("window_start"))
        .groupBy("tenant_id", "window_start")
        .agg(F.sum("cost_millicents").alias("spent_millicents"))
    )
    return spent.join(tiers.select("tenant_id", "spend_cap_millicents"), "tenant_id").select(
        "tenant_id",
        "window_start",
        F.expr(f"window_start + INTERVAL {days} DAY").alias("window_end"),
        "spent_millicents",
        (F.col("spent_millicents") >= F.col("spend_cap_millicents")).alias("breach"),
    )


def admissions(requests: DataFrame, delay_ms: int = DAY_MS, root: str | None = None, finish: bool = True) -> DataFrame:
    """accepted per request of a stream, for request rates and for slots alike; as the batch operator decides.

    ``requests`` (tenant_id, event_id, at_micros, until_micros, cap) may be delivered any number of times, always with the
    same instant, and out of order by ``delay_ms``. Decisions are made once, in order of time, as the watermark passes. A request
    that comes only after that can't be heard any more: it gets a null, unless another delivery of it was decided.
    """
    timed = requests.select(*EVENT, "at_micros", "until_micros", "cap", F.timestamp_micros("at_micros").alias("at"))
    feed = run_feed(timed, "at", F.col("at"), delay_ms, admitted, root, finish, rocks=True)
    late = feed.late.select(*EVENT).where("event_id is not null").distinct()
    unheard = late.join(feed.out.select(*EVENT), EVENT, "left_anti").withColumn("accepted", F.lit(None).cast("boolean"))
    return feed.out.unionByName(unheard)
