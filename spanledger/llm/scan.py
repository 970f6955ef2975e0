"""Row-wise text scans as Arrow maps: one Python function per text, batch by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<struct<kind:string,start:long,end:long>>": pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))}


def scan(docs: DataFrame, columns: dict[str, str], fn: Callable[[str], tuple]) -> DataFrame:
    """(doc_id, *columns) with ``fn`` of every whole text; a null text is empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", *columns]
    types = [ARROW[t] for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [fn(text) for text in part.column(1).to_pylist()]
                made = [pa.array(values, t) for values, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names)

    return texts.mapInArrow(run, ", ".join(["doc_id long", *(f"`{c}` {t}" for c, t in columns.items())]))


def written(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: Iterable[tuple[str, int, int]]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
