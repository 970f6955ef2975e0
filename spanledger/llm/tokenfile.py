"""Token files: the ids of a corpus in ascending order of doc_id, compressed by ``codec``.

A token file is a folder of Parquet files whose rows are segments: whole documents in order, with
their ids as independent, checksummed blocks. Spark's writer commits them, so a lost executor leaves
no half-written file, and any store that Spark reaches holds them. A segment has one order-0 table for its blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.llm import tokens as K
from spanledger.llm import words as W
from spanledger.llm.codec import pack_ids, unpack_ids

END = 1
SEGMENT = 1 << 20  # ids after which a segment ends with its document
AT_ONCE = 1 << 23  # ids coded side by side

_SCHEMA = "shard long, segment long, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the ids of every whole text of ``docs``, each document followed by END.

    Ids are those of the tokenizer file without special ids; one of 65,536 or more fails the job. A null text is empty. Rows are ordered by
    doc_id, null first, rows of one doc_id by the hash of their text; further columns are not read. Without rows the
    folder holds an empty table.
    """
    file = tokenizer or K.vocabulary("word_bpe_49k.json")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), K.encoder(file)
        segments: list[tuple[list, list, list]] = []
        held = at = 0

        def flush() -> pa.RecordBatch:
            nonlocal segments, held, at
            payloads = pack_ids([np.concatenate(ids) for _, _, ids in segments])
            rows = len(segments)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * rows, pa.int64()), pa.array(range(at, at + rows), pa.int64()),
                    pa.array([d for d, _, _ in segments], pa.list_(pa.int64())), pa.array([n for _, n, _ in segments], pa.list_(pa.int64())),
                    pa.array([sum(n) for _, n, _ in segments], pa.int64()), pa.array(payloads, pa.binary()),
                ],
                ["shard", "segment", "doc_ids", "lengths", "n_ids", "payload"],
            )
            segments, held, at = [], 0, at + rows
            return made

        full = SEGMENT
        for batch in batches:
            for rows, buf, offs in W.pieces(batch):
                ids, first = K.with_end(*encoder.encode(buf, offs), END)
                for doc, a, b in zip(rows.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if full >= SEGMENT:
                        if held >= AT_ONCE:
                            yield flush()
                        segments.append(([], [], []))
                        full = 0
                    for part, value in zip(segments[-1], (doc, b - a, ids[a:b].astype(np.uint16)), strict=True):
                        part.append(value)
                    full, held = full + b - a, held + b - a
        if segments:
            yield flush()

    ordered.mapInArrow(run, _SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token file, from its decoded ids.

    ``start`` counts the ids of all documents before it. A damaged block fails the job.
    """
    segments = spark.read.schema(_SCHEMA).parquet(path)
    inner = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file of the folder
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    places = segments.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("within"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, AT_ONCE // SEGMENT)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                shard, segment, docs, lengths = (part.column(i).to_pylist() for i in range(4))
                rows: list[tuple] = []
                for s, g, d, n, ids in zip(shard, segment, docs, lengths, unpack_ids(part.column(4).to_pylist()), strict=True):
                    if len(ids) != sum(n):
                        raise ValueError("a segment does not hold the ids of its documents")
                    begin = 0
                    for doc, size in zip(d, n, strict=True):
                        rows.append((s, g, doc, begin, size, zlib.crc32(np.ascontiguousarray(ids[begin : begin + size], "<u4").data)))
                        begin += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["shard", "segment", "doc_id", "local", "n_tokens", "ids_crc32"]
                )

    found = segments.select("shard", "segment", "doc_ids", "lengths", "payload").mapInArrow(
        run, "shard long, segment long, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    met = found.join(places, ["shard", "segment"]).join(shards, "shard")
    return met.select("doc_id", (F.col("before") + F.col("within") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
