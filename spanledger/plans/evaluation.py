"""End-to-end scoring of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import normalizers as N
from spanledger.operators.evaluate import (
    ITEM,
    STRINGS,
    align,
    category_metrics,
    contract_metrics,
    f1,
    present,
    share,
    value_counts,
    value_or_quote,
    with_intervals,
)
from spanledger.sources.dimensions import DATE_CATEGORIES


def evaluate(
    labels: DataFrame, predictions: DataFrame, texts: DataFrame, parties: str = "alias-aware"
) -> DataFrame:
    """Per category: counts, shares, intervals and the too-few flag."""
    rows = align(labels, predictions, texts)
    return with_intervals(category_metrics(contract_metrics(rows, parties)))


def compare_party_modes(rows: DataFrame) -> DataFrame:
    """The party category under both ways of comparing names."""
    only = rows.where(F.col("category") == "Parties")

    def under(mode: str) -> DataFrame:
        counted = contract_metrics(only, mode).withColumn("mode", F.lit(mode))
        return category_metrics(counted, ("mode", "category"))

    keep = ["mode", "category", "tp", "fp", "fn", "precision", "recall", "f1"]
    return under("exact-name").unionByName(under("alias-aware")).select(*keep)


def compare_dates(rows: DataFrame, reference: Column) -> DataFrame:
    """Date categories scored with filled-in parts ("before") and without ("after")."""
    answers = F.filter(F.coalesce("answers", F.array().cast(STRINGS)), lambda a: F.trim(a) != "")
    said = F.transform(F.coalesce("items", F.array().cast(ITEM)), value_or_quote)
    only = rows.where(F.col("category").isin(*DATE_CATEGORIES))

    lists = only.select("category", answers.alias("a"), said.alias("s"))

    def counted(mode: str, norm) -> DataFrame:
        normal = lists.select(
            "category",
            present(F.transform("a", norm)).alias("have"),
            present(F.transform("s", norm)).alias("said"),
        )
        c = value_counts(F.col("have"), F.col("said"))
        return normal.select(
            "category", F.lit(mode).alias("mode"), c["tp"].alias("tp"), c["fp"].alias("fp"),
            (F.size("have") - c["tp"]).alias("fn"),
        )

    both = counted("before", lambda t: N.filled_date(t, reference)).unionByName(
        counted("after", lambda t: N.calendar_date(t))
    )
    c = F.col
    return (
        both.groupBy("mode", "category")
        .agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")])
        .withColumns(
            {
                "precision": share(c("tp"), c("tp") + c("fp")),
                "recall": share(c("tp"), c("tp") + c("fn")),
            }
        )
        .withColumn("f1", f1(c("precision"), c("recall")))
    )
