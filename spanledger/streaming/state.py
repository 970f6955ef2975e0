"""Streams with keyed state that a watermark bounds, and a side table for rows behind it.

A feed runs in two steps. The first files each micro-batch under ``rows`` and tells rows whose time is over, by the watermark
of the micro-batches before, from the others: those go to the side table, none is lost. The second feeds the others into
Spark's keyed state, which forgets what the watermark has passed, and appends what became final. Both go on where
they stopped when called again with the same folder, so a call costs its new rows and the open state, whatever came before.
The second step takes the filed micro-batches whole, so its watermark is never ahead of the first one's and drops nothing.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from spanledger.operators.quota import admit_rows
from spanledger.session import work_dir

MARGIN = 1000  # milliseconds by which the second watermark stays behind the first
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
END = "2250-01-01 00:00:00"  # a row of this instant ends a feed; pandas knows none after 2262


@dataclass
class Feed:
    """``out``: what is final; ``late``: rows that came behind the watermark."""

    out: DataFrame
    late: DataFrame


def _mark(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The greatest instant of all micro-batches up to ``batch_id``, in milliseconds."""
    if batch_id < 0:
        return None
    return spark.read.schema("top long").parquet(f"{path}/{batch_id}").first().top


def run_feed(stream: DataFrame, at: str, due: Column, delay_ms: int, step: Callable[[DataFrame], DataFrame], root: str | None = None, finish: bool = False, rocks: bool = False) -> Feed:
    """Runs what is available of ``stream`` through ``step``.

    ``at`` names a timestamp column, which moves the watermark: its greatest value so far less ``delay_ms``. ``due`` is the instant with
    which a row becomes final, a timestamp; a row that comes when the watermark has reached it is late. ``step`` turns the rows, with
    their watermark set, into an append-mode result. ``finish`` declares the feed complete: all that waits becomes final, and
    nothing may follow. Rows without ``at`` or ``due`` are late.
    """
    spark = stream.sparkSession
    root = root or f"{work_dir(spark)}/feed-{uuid.uuid4().hex}"
    fields = list(stream.schema.fields)
    filed = T.StructType([*fields, T.StructField("batch", T.StringType()), T.StructField("late", T.BooleanType())])
    # a feed without rows has a table too
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{root}/rows/batch=none/late=false")

    def route(batch: DataFrame, batch_id: int) -> None:
        top = _mark(spark, f"{root}/marks", batch_id - 1)
        over = due.isNull() | F.col(at).isNull()
        if top is not None:
            over = over | (F.unix_millis(due) <= top - delay_ms)
        place = f"{root}/rows/batch={batch_id}"
        batch.withColumn("late", over).write.mode("overwrite").partitionBy("late").parquet(place)
        met = spark.read.schema(T.StructType([*fields, T.StructField("late", T.BooleanType())])).parquet(place).agg(F.max(F.unix_millis(at))).first()[0]
        tops = [t for t in (top, met) if t is not None]
        spark.createDataFrame([(max(tops) if tops else None,)], "top long").coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/{batch_id}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/route").foreachBatch(route).start().awaitTermination()
    if finish:
        last = spark.range(1).select(*(F.lit(END if f.name == at else None).cast(f.dataType).alias(f.name) for f in fields))
        last.write.mode("overwrite").parquet(f"{root}/rows/batch=finish/late=false")
    rows = spark.readStream.schema(filed).option("basePath", f"{root}/rows").parquet(f"{root}/rows").where(~F.col("late")).drop("batch", "late")
    made = step(rows.withWatermark(at, f"{delay_ms + MARGIN} milliseconds"))
    before = spark.conf.get(PROVIDER)
    if rocks:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        running = made.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    running.awaitTermination()
    late = spark.read.schema(filed).option("basePath", f"{root}/rows").parquet(f"{root}/rows").where("late").drop("batch", "late")
    return Feed(spark.read.schema(made.schema).parquet(f"{root}/out"), late)


PART = 50_000  # requests decided and given out at a time
DECIDED = "tenant_id string, event_id string, accepted boolean"


class Admission(StatefulProcessor):
    """Requests of one tenant wait until the watermark has passed them, then are decided in order of time.

    State: the waiting requests, and the ends of accepted ones that still hold, at most as many as the limit. A request
    that is delivered again while it waits counts once; one that was decided already comes late and never gets here.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id string, until long, cap long")
        self.held = handle.getListState("held", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for df in rows:
            df = df[df["event_id"].notna()]
            if len(df):
                self.waiting.appendList([*zip(*(df[c].astype("int64").tolist() if c != "event_id" else df[c].astype(str) for c in ("at_micros", "event_id", "until_micros", "cap")), strict=True)])
                low = int(df["at_micros"].min())
                least = low if least is None else min(least, low)
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # columns of numbers: what waits is held in few bytes a row, and decided a part at a time
        at, until, cap, ids = array("q"), array("q"), array("q"), []
        for a, e, u, c in self.waiting.get():
            at.append(a)
            until.append(u)
            cap.append(c)
            ids.append(e)
        rows = pd.DataFrame({"at": np.frombuffer(at, np.int64), "event_id": pd.Series(ids, dtype=object), "until": np.frombuffer(until, np.int64), "cap": np.frombuffer(cap, np.int64)}) if ids else None
        del ids
        if rows is None:
            return
        rows = rows.sort_values(["at", "event_id", "until", "cap"], ignore_index=True).drop_duplicates("event_id")
        over = rows["at"] < passed
        ready, rest = rows[over], rows[~over]
        del rows
        if len(ready):
            held = sorted(r[0] for r in self.held.get())
            for low in range(0, len(ready), PART):
                part = ready.iloc[low : low + PART]
                taken, held = admit_rows(held, part["at"].tolist(), part["until"].tolist(), part["cap"].tolist())
                yield pd.DataFrame({"tenant_id": key[0], "event_id": part["event_id"].to_numpy(), "accepted": taken})
            held = sorted(held)
            self.held.put([(u,) for u in held]) if held else self.held.clear()
        if len(rest):
            self.waiting.put([*zip(rest["at"].tolist(), rest["event_id"], rest["until"].tolist(), rest["cap"].tolist(), strict=True)])
            self.handle.registerTimer(int(rest["at"].iloc[0]) // 1000 + 1)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def admitted(rows: DataFrame) -> DataFrame:
    """Decisions of ``rows`` (tenant_id, event_id, at_micros, until_micros, cap and a watermark column)."""
    return rows.groupBy("tenant_id").transformWithStateInPandas(statefulProcessor=Admission(), outputStructType=DECIDED, outputMode="append", timeMode="EventTime")
