"""Documents, chunks and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.ids import chunk_uuid, content_hash
from spanledger.functions.text import (
    decode_utf8,
    line_chunk_bounds,
    normalize_for_provenance,
    paragraphs,
    slice_text,
    strip,
    words,
)


def read_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Files below a folder: path, stem, raw content, size."""
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return raw.select("path", file_stem(F.col("path")).alias("stem"), "content", "length")


def file_stem(path: Column) -> Column:
    """Trimmed file name without its last extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return strip(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def decoded(documents: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``text``: the bytes as UTF-8 with malformed parts replaced."""
    return documents.withColumn("text", decode_utf8(F.col(content)))


def paragraph_chunks(
    documents: DataFrame, separator: str = "\n\n", normalize: bool = True
) -> DataFrame:
    """Chunks of every document: tenant_id, document_id, chunk_id, chunk_index, text, token_count.

    Text is normalised before it is cut, so offsets stay true afterwards.
    """
    text = normalize_for_provenance(F.col("text")) if normalize else F.col("text")
    exploded = documents.select(
        "tenant_id",
        "document_id",
        F.posexplode(paragraphs(text, separator)).alias("chunk_index", "text"),
    )
    return exploded.select(
        "tenant_id",
        "document_id",
        chunk_uuid(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        "text",
        F.size(words(F.col("text"))).cast("bigint").alias("token_count"),
    )


def line_chunks(documents: DataFrame, max_chars: int = 4000) -> DataFrame:
    """Chunks of packed lines with their offsets in the text."""
    bounds = documents.select(
        "*", F.posexplode(line_chunk_bounds(F.col("text"), max_chars)).alias("chunk_index", "__b")
    )
    return bounds.select(
        *[c for c in documents.columns if c != "text"],
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("__b.start").cast("bigint").alias("start_offset"),
        F.col("__b.end").cast("bigint").alias("end_offset"),
        slice_text(F.col("text"), F.col("__b")).alias("text"),
    )


def match_files(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation rows with the file whose stem equals theirs; others drop out."""
    keyed = annotations.withColumn("stem", file_stem(F.col("filename")))
    return keyed.join(files, "stem")


def pending_inputs(inputs: DataFrame, saved: DataFrame, prompt_hash: str) -> tuple[DataFrame, DataFrame]:
    """(saved predictions made with the current prompt, inputs still to process)."""
    reusable = saved.where(F.col("prompt_hash") == prompt_hash)
    done = reusable.select("contract")
    return reusable.join(inputs.select("contract"), "contract", "left_semi"), inputs.join(
        done, "contract", "left_anti"
    )


def manifest_report(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per manifest row: does the content hash agree, does the predecessor exist?"""
    hashed = files.select("filename", content_hash(F.col("content")).alias("actual"))
    known = manifest.select(F.col("doc_id").alias("amendment_of"), F.lit(True).alias("__known")).distinct()
    return (
        manifest.join(hashed, "filename", "left")
        .join(known, "amendment_of", "left")
        .select(
            "doc_id",
            "filename",
            F.when(F.col("actual").isNull(), "missing_file")
            .when(F.col("actual") != F.concat(F.lit("sha256:"), F.col("sha256")), "hash_differs")
            .when(
                F.col("amendment_of").isNotNull() & F.col("__known").isNull(), "unknown_predecessor"
            )
            .otherwise("ok")
            .alias("status"),
        )
    )
