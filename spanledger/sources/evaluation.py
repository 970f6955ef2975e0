"""Readers for annotation tables and saved predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.normalizers import parse_answers
from spanledger.functions.text import strip

# Endings of the column that holds the short answer, in order of preference.
ANSWER_SUFFIXES = ("-Answer", "- Answer", " - Answer", " Answer")
# Categories whose answer column is spelled differently in the source.
ANSWER_COLUMNS = {"Notice Period To Terminate Renewal": "Notice Period To Terminate Renewal- Answer"}


def answer_candidates(category: str) -> list[str]:
    named = [ANSWER_COLUMNS[category]] if category in ANSWER_COLUMNS else []
    return list(dict.fromkeys(named + [category + s for s in ANSWER_SUFFIXES]))


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """Wide annotation CSV, all text; lines that start with # are comments."""
    return (
        spark.read.option("header", "true")
        .option("comment", "#")
        .option("multiLine", "true")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def labels_long(wide: DataFrame, categories: list[str]) -> DataFrame:
    """contract, category, answers; only categories with an answer.

    The answer column wins; "yes" points to the category's own column, "no" means none.
    """
    names = {c.lower(): c for c in wide.columns}

    def cell(name: str) -> Column:
        return F.col(f"`{name}`") if name in wide.columns else F.lit(None).cast("string")

    def raw(category: str) -> Column:
        own = cell(category)
        answer = next((c for c in answer_candidates(category) if c in wide.columns), None)
        if answer is None:
            return own
        said = F.coalesce(F.col(f"`{answer}`"), F.lit(""))
        word = F.lower(strip(said))
        return F.when(word == "yes", own).when(word == "no", F.lit("")).otherwise(said)

    contract = strip(F.coalesce(cell(names.get("filename", "Filename")), F.lit("")))
    rows = wide.select(
        contract.alias("contract"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("category"), parse_answers(raw(c)).alias("answers"))
                    for c in categories
                ]
            )
        ).alias("a"),
    )
    return rows.select("contract", "a.category", "a.answers").where(F.size("answers") > 0)


PREDICTION_RECORD = (
    "contract string, filename string, prompt_hash string, "
    "predictions map<string, array<struct<normalized_value:string, name:string, "
    "verbatim_quote:string, quote_found:boolean>>>"
)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records of a JSON Lines file; the last record of a contract wins.

    File name, block offset and position within the block decide what is last. Blank lines don't count; a line that
    isn't a record fails the job, since what it said would be missing without a trace (``refused_predictions`` lists them).
    """
    lines = spark.read.schema(PREDICTION_RECORD).option("mode", "FAILFAST").json(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    contract = F.coalesce(F.nullif("contract", F.lit("")), F.nullif("filename", F.lit("")))
    # one pass: the place is compared and the record carried inside the aggregate
    newest = (
        lines.select("*", place.alias("__at"))
        .withColumn("contract", contract)
        .where(F.col("contract").isNotNull())
        .groupBy("contract")
        .agg(F.max_by(F.struct("prompt_hash", "predictions"), "__at").alias("r"))
    )
    return newest.select("contract", "r.*")


def refused_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, reason): lines that ``read_predictions`` can't use, unreadable ones and those that name no contract."""
    lines = spark.read.schema(PREDICTION_RECORD + ", __line string").option("columnNameOfCorruptRecord", "__line").json(path)
    named = F.coalesce(F.nullif("contract", F.lit("")), F.nullif("filename", F.lit("")))
    # the file is asked for in the same scan, which also keeps the reader from pruning the record away
    told = lines.select(F.col("_metadata.file_path").alias("file"), "__line", named.alias("__contract"), "prompt_hash", "predictions")
    reason = F.when(F.col("__line").isNotNull(), "unreadable").when(F.col("__contract").isNull(), "no_contract")
    return told.withColumn("reason", reason).where("reason is not null").select("file", F.col("__line").alias("line"), "reason")


def predictions_long(records: DataFrame) -> DataFrame:
    """contract, category, items: the value is the normalised one, else the name."""
    flat = records.select("contract", F.explode("predictions").alias("category", "raw"))

    def item(p: Column) -> Column:
        value = F.coalesce(F.nullif(p["normalized_value"], F.lit("")), p["name"], F.lit(""))
        return F.struct(
            strip(value).alias("value"),
            strip(F.coalesce(p["verbatim_quote"], F.lit(""))).alias("quote"),
            F.coalesce(p["quote_found"], F.lit(True)).alias("found"),
        )

    return flat.select("contract", "category", F.transform("raw", item).alias("items"))
