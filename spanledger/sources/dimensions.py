"""Small reference tables. Each is a handful of literal rows whose size the
optimizer knows, so that a join broadcasts them without a hint."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Price versions and their state.
PRICE_VERSIONS = (
    ("2026-Q1", "historical"),
    ("2026-Q2", "historical"),
    ("2026-Q3", "active"),
    ("2026-Q4", "active"),
)
CURRENT_PRICE_VERSION = "2026-Q4"

# An example schedule with figures of its own, in millicents per token: input, output, cache read,
# cache write, and the end of a promotion. Operators take any such rows.
PRICES = (
    ("2026-Q1", "model-small", 0.06, 0.18, 0.012, 0.09, None),
    ("2026-Q1", "embedding-small", 0.004, 0.0, 0.0, 0.0, None),
    ("2026-Q2", "model-small", 0.055, 0.165, 0.011, 0.08, None),
    ("2026-Q3", "model-small-4", 0.05, 0.16, 0.01, 0.075, None),
    ("2026-Q3", "model-medium-5", 0.14, 0.56, 0.028, 0.21, None),
    ("2026-Q3", "embedding-small", 0.003, 0.0, 0.0, 0.0, None),
    ("2026-Q4", "model-small-4", 0.05, 0.16, 0.01, 0.075, None),
    ("2026-Q4", "model-medium-5", 0.13, 0.52, 0.026, 0.195, None),
    ("2026-Q4", "model-large-5", 0.65, 2.6, 0.13, 0.975, None),
    ("2026-Q4", "flash-lite", 0.015, 0.06, 0.003, 0.0, None),
    ("2026-Q4", "flash-promo", 0.04, 0.24, 0.008, 0.0, "2026-12-31 23:59:59"),
)

# Short names and the model each stands for.
MODEL_ALIASES = (
    ("model-small", "model-small-4"),
    ("model-medium", "model-medium-5"),
    ("model-large", "model-large-5"),
)

# Tier, spend cap in millicents, requests per minute, ingestions at once, period.
QUOTA_TIERS = (
    ("free", 1_000_000, 60, 2, 30),
    ("pro", 10_000_000, 600, 10, 30),
    ("enterprise", 100_000_000, 3_000, 50, 30),
)

# Categories compared by value, by clause text, and not scored.
VALUE_CATEGORIES = (
    "Agreement Date", "Effective Date", "Expiration Date", "Governing Law", "Parties",
)
DATE_CATEGORIES = ("Agreement Date", "Effective Date", "Expiration Date")
CLAUSE_CATEGORIES = (
    "Anti-Assignment", "Cap On Liability", "Change Of Control", "Exclusivity", "Non-Compete",
    "Termination For Convenience", "Uncapped Liability",
)
NOT_SCORED_CATEGORIES = ("Renewal Term", "Notice Period To Terminate Renewal")

# Question, the categories that answer it, how well they fit.
QUESTIONS = (
    ("Q1", ("Parties",), "direct"),
    ("Q2", ("Agreement Date",), "direct"),
    ("Q3", ("Effective Date",), "direct"),
    ("Q4", ("Expiration Date",), "direct"),
    ("Q5", ("Renewal Term", "Notice Period To Terminate Renewal"), "partial"),
    ("Q6", ("Termination For Convenience",), "direct"),
    ("Q7", ("Governing Law",), "direct"),
    ("Q8", ("Cap On Liability", "Uncapped Liability"), "direct"),
    ("Q9", (), "not_covered"),
    ("Q10", (), "not_covered"),
    ("Q11", ("Anti-Assignment", "Change Of Control"), "direct"),
    ("Q12", ("Exclusivity", "Non-Compete"), "direct"),
    ("Q13", (), "not_applicable"),
)


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return f"CAST({value!r} AS {'DOUBLE' if isinstance(value, float) else 'BIGINT'})"
    if isinstance(value, (tuple, list)):
        return f"ARRAY({', '.join(map(sql_literal, value))})"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_frame(
    spark: SparkSession, schema: str, rows: Iterable[Sequence[object]]
) -> DataFrame:
    """A local relation of literal rows; ``schema`` is a DDL column list."""
    listed = list(rows)
    names = [part.strip().split()[0] for part in schema.split(", ")]
    types = [part.strip().split(None, 1)[1] for part in schema.split(", ")]
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in listed)
    raw = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return raw.select(*[raw[n].cast(t).alias(n) for n, t in zip(names, types)])


def prices(spark: SparkSession, rows: Iterable[Sequence[object]] = PRICES) -> DataFrame:
    return values_frame(
        spark,
        "price_version string, model_id string, input_rate double, output_rate double, "
        "cache_read_rate double, cache_write_rate double, promo_until timestamp_ntz",
        rows,
    )


def price_versions(spark: SparkSession, rows: Iterable = PRICE_VERSIONS) -> DataFrame:
    return values_frame(spark, "price_version string, state string", rows)


def model_aliases(spark: SparkSession, rows: Iterable = MODEL_ALIASES) -> DataFrame:
    return values_frame(spark, "alias string, model_id string", rows)


def quota_tiers(spark: SparkSession, rows: Iterable = QUOTA_TIERS) -> DataFrame:
    return values_frame(
        spark,
        "tier string, spend_cap_millicents bigint, rate_limit_rpm bigint, "
        "max_concurrent bigint, period_days int",
        rows,
    )


def questions(spark: SparkSession, rows: Iterable = QUESTIONS) -> DataFrame:
    """One row per question and category; uncovered questions keep a NULL category."""
    flat = [(q, c, fit) for q, cats, fit in rows for c in (cats or (None,))]
    return values_frame(spark, "question_id string, category string, fit string", flat)


def categories(spark: SparkSession) -> DataFrame:
    kinds = (
        [(c, "value") for c in VALUE_CATEGORIES]
        + [(c, "clause") for c in CLAUSE_CATEGORIES]
        + [(c, "not_scored") for c in NOT_SCORED_CATEGORIES]
    )
    return values_frame(spark, "category string, category_type string", kinds)
