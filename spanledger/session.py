"""Session helpers: settings the operators rely on and the lineage cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spanledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join splitting and UTC; keyword settings win.

    ``master`` stays unset on a cluster so that spark-submit decides.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and stream state.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, since other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="spanledger-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared folder.

    Losing any executor costs a re-read, never the steps before, and the written
    size is what later joins are planned with.
    """
    path = f"{work_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    # ids are random hex digits, which this codec halves and the default one keeps
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed over the cores when the scan has fewer splits than cores.

    Work per row on long texts would else run in the few tasks that hold a small
    input. A table of many files has splits enough and passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
