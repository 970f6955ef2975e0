"""The append-only usage ledger: validation, pricing, idempotence, corrections, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.usage import cost_millicents

# Fixed value: millicents in a dollar.
MILLICENTS_PER_DOLLAR = 100_000
EVENT = ["tenant_id", "event_id"]


def with_rates(events: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the four rates and the promotion end; the exact model id beats its alias."""
    p = prices.select(
        "price_version", F.col("model_id").alias("__model"), "input_rate", "output_rate",
        "cache_read_rate", "cache_write_rate", "promo_until",
    )
    exact = prices.select("price_version", "model_id").withColumn("__exact", F.lit(True))
    named = aliases.select(F.col("alias").alias("model_id"), F.col("model_id").alias("__real"))
    keyed = (
        events.join(exact, ["price_version", "model_id"], "left")
        .join(named, "model_id", "left")
        .withColumn(
            "__model",
            F.when(F.col("__exact"), F.col("model_id")).otherwise(
                F.coalesce("__real", F.col("model_id"))
            ),
        )
        .drop("__exact", "__real")
    )
    return keyed.join(p, ["price_version", "__model"], "left").drop("__model")


def priced(events: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds cost_millicents; NULL marks a model the version does not price."""
    rates = ("input_rate", "output_rate", "cache_read_rate", "cache_write_rate")
    rated = with_rates(events, prices, aliases).withColumn(
        "cost_millicents",
        cost_millicents(
            F.col("input_tokens"),
            F.col("output_tokens"),
            F.col("cache_read_input_tokens"),
            F.col("cache_write_input_tokens"),
            tuple(F.col(r) for r in rates),
        ),
    )
    return rated.drop(*rates, "promo_until")


def judged(events: DataFrame, versions: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``reason``: why the ledger refuses the event, NULL when it takes it."""
    promo = prices.where(F.col("promo_until").isNotNull()).select(
        "price_version", "model_id", "promo_until"
    )
    correction = F.coalesce(F.col("is_correction"), F.lit(False))
    return (
        events.join(versions, "price_version", "left")
        .join(promo, ["price_version", "model_id"], "left")
        .withColumn(
            "reason",
            F.when(F.col("state").isNull(), "unknown_price_version")
            .when(correction & F.col("correction_for_event_id").isNull(), "correction_without_original")
            .when(~correction & (F.col("state") == "historical"), "historical_price_version")
            .when(F.col("occurred_at") > F.col("promo_until"), "promotion_expired")
            .when(
                ~correction & ((F.col("input_tokens") < 0) | (F.col("output_tokens") < 0)),
                "negative_tokens",
            ),
        )
        .drop("state", "promo_until")
    )


def with_duplicate_flag(events: DataFrame, order: list[str]) -> DataFrame:
    """Flags every row but the first of its (tenant, event id).

    The firsts are aggregated and joined back: an event retried without end is
    then split by the skew join, which a window could not do.
    """
    mark = F.struct(*order)
    first = events.groupBy(*EVENT).agg(F.min(mark).alias("__first"))
    return (
        events.join(first, EVENT)
        .withColumn("is_duplicate", mark != F.col("__first"))
        .drop("__first")
    )


def correction_verdicts(events: DataFrame) -> DataFrame:
    """Per correction: is its original there, with the same price version?"""
    fixes = events.where("is_correction").select(
        *EVENT, "correction_for_event_id", "price_version"
    )
    originals = (
        events.where(~F.col("is_correction"))
        .groupBy("tenant_id", F.col("event_id").alias("correction_for_event_id"))
        .agg(F.min("price_version").alias("original_version"))
    )
    return fixes.join(originals, ["tenant_id", "correction_for_event_id"], "left").withColumn(
        "reason",
        F.when(F.col("original_version").isNull(), "original_not_found").when(
            F.col("original_version") != F.col("price_version"), "price_version_differs"
        ),
    )


def corrections(
    ledger: DataFrame, requests: DataFrame, prices: DataFrame, aliases: DataFrame
) -> DataFrame:
    """Offsetting rows for correction requests.

    ``requests``: tenant_id, original_event_id, correction_event_id, the two token
    offsets, occurred_at and reason text. Model, provider, price version and
    attribution come from the original.
    """
    originals = ledger.select(
        "tenant_id", F.col("event_id").alias("original_event_id"), "provider", "model_id",
        "price_version", "document_id",
    )
    rows = requests.join(originals, ["tenant_id", "original_event_id"]).select(
        "tenant_id",
        F.col("correction_event_id").alias("event_id"),
        "occurred_at",
        F.lit("correction").alias("event_type"),
        "provider",
        "model_id",
        "price_version",
        "document_id",
        F.col("input_tokens_offset").alias("input_tokens"),
        F.col("output_tokens_offset").alias("output_tokens"),
        F.lit(0).cast("bigint").alias("cache_read_input_tokens"),
        F.lit(0).cast("bigint").alias("cache_write_input_tokens"),
        F.lit(True).alias("is_correction"),
        F.col("original_event_id").alias("correction_for_event_id"),
        "reason",
    )
    return priced(rows, prices, aliases)


def in_period(events: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Events with start <= occurred_at < end; an unset side is open."""
    rows = events
    if start is not None:
        rows = rows.where(F.col("occurred_at") >= start)
    if end is not None:
        rows = rows.where(F.col("occurred_at") < end)
    return rows


TOTALS = (
    ("input_tokens", "total_input_tokens"),
    ("output_tokens", "total_output_tokens"),
    ("cache_read_input_tokens", "total_cache_read_tokens"),
    ("cache_write_input_tokens", "total_cache_write_tokens"),
    ("cost_millicents", "total_cost_millicents"),
)


def usage_totals(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in TOTALS],
    )


def tenant_usage(events: DataFrame, tenants: DataFrame) -> DataFrame:
    """One row per tenant, also for those without events, with dollars."""
    totals = usage_totals(events, ["tenant_id"])
    names = ["event_count", *[n for _, n in TOTALS]]
    rows = tenants.select("tenant_id").join(totals, "tenant_id", "left")
    filled = rows.select("tenant_id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names])
    return filled.withColumn(
        "total_cost_dollars", F.col("total_cost_millicents") / F.lit(float(MILLICENTS_PER_DOLLAR))
    )


def token_metrics(events: DataFrame) -> DataFrame:
    """Token usage by tenant, provider, model and token type; zero cache rows are left out."""
    long = events.select(
        "tenant_id",
        "provider",
        "model_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("token_type"), F.col(c).cast("bigint").alias("n"))
                    for kind, c in (
                        ("input", "input_tokens"),
                        ("output", "output_tokens"),
                        ("cache_read", "cache_read_input_tokens"),
                        ("cache_write", "cache_write_input_tokens"),
                    )
                ]
            )
        ).alias("m"),
    ).select("tenant_id", "provider", "model_id", "m.*")
    told = F.col("token_type").isin("input", "output") | (F.coalesce("n", F.lit(0)) != 0)
    return (
        long.where(told)
        .groupBy("tenant_id", "provider", "model_id", "token_type")
        .agg(F.count(F.lit(1)).alias("n_points"), F.sum("n").alias("n_tokens"))
    )
