"""Bi-temporal facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.catalog import query
from spanledger.catalog.twins import with_parts
from spanledger.functions import intervals
from spanledger.operators import temporal
from spanledger.sources import driver_tables as dt

COLS = ["fact_id", "subject", "predicate", "object", "valid_from", "valid_to", "created_at", "expired_at", "superseded_by_id"]
SQL_COLS = ", ".join(COLS)
VALID, SYSTEM = "1997-06-01", "1998-01-01"


def closed(spark, sf):
    return temporal.close_superseded(dt.order_facts(spark, sf))


@query("win_supersede_close", with_parts(f"SELECT {SQL_COLS} FROM closed", "closed"))
def win_supersede_close(spark, sf):
    return closed(spark, sf).select(*COLS)


@query("join_asof_valid", with_parts(f"""SELECT {SQL_COLS}, t AS as_of FROM closed,
    (VALUES (TIMESTAMP '1996-01-01'), (TIMESTAMP '1997-06-01'), (TIMESTAMP '2001-08-01')) v(t)
    WHERE valid_from <= t AND (valid_to IS NULL OR valid_to > t)""", "closed"))
def join_asof_valid(spark, sf):
    return temporal.as_of_each(closed(spark, sf), ["1996-01-01", "1997-06-01", "2001-08-01"]).select(*COLS, "as_of")


@query("join_asof_system", with_parts(f"""SELECT 'at' AS part, {SQL_COLS} FROM closed
      WHERE created_at <= TIMESTAMP '{SYSTEM}' AND (expired_at IS NULL OR expired_at > TIMESTAMP '{SYSTEM}')
    UNION ALL SELECT 'now', {SQL_COLS} FROM closed WHERE expired_at IS NULL""", "closed"))
def join_asof_system(spark, sf):
    f = closed(spark, sf)
    return temporal.as_of_system(f, SYSTEM).select(F.lit("at").alias("part"), *COLS).unionByName(
        temporal.as_of_system(f, None).select(F.lit("now").alias("part"), *COLS)
    )


@query("join_asof_bitemporal", with_parts(f"""SELECT {SQL_COLS} FROM closed WHERE predicate = '1-URGENT'
    AND valid_from <= TIMESTAMP '{VALID}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{VALID}')
    AND created_at <= TIMESTAMP '{SYSTEM}' AND (expired_at IS NULL OR expired_at > TIMESTAMP '{SYSTEM}')""", "closed"))
def join_asof_bitemporal(spark, sf):
    return temporal.as_of(closed(spark, sf), VALID, SYSTEM, predicate="1-URGENT").select(*COLS)


def shipped(spark, sf):
    """Each line of an order asks for its customer's facts: some as of the shipping day, some as believed then, some both, some neither."""
    flag, lines = F.col("l_returnflag"), dt.shipments(spark, sf)
    return lines.select(
        F.lit("trade").alias("tenant_id"), F.col("o_custkey").cast("string").alias("subject"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when((flag == "A") | (F.col("l_linenumber") % 2 == 0), F.col("l_shipdate")).alias("valid_at"),
        F.when((flag == "R") | (F.col("l_linenumber") % 3 == 0), F.col("l_shipdate")).alias("system_at"),
    )


ASKED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "valid_at", "system_at", "fact_id"]


def asked_sql(condition: str) -> str:
    return f"""
    , asked AS (SELECT 'trade' AS tenant_id, CAST(o_custkey AS VARCHAR) AS subject, l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN l_returnflag = 'A' OR l_linenumber % 2 = 0 THEN l_shipdate END AS valid_at,
        CASE WHEN l_returnflag = 'R' OR l_linenumber % 3 = 0 THEN l_shipdate END AS system_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT {", ".join(ASKED)} FROM asked JOIN closed USING (tenant_id, subject) WHERE {condition}
      AND (valid_at IS NULL OR (valid_from <= valid_at AND (valid_to IS NULL OR valid_to > valid_at)))
      AND CASE WHEN system_at IS NULL THEN expired_at IS NULL ELSE created_at <= system_at AND (expired_at IS NULL OR expired_at > system_at) END"""


@query("join_asof_valid_table", with_parts(asked_sql("valid_at IS NOT NULL AND system_at IS NULL"), "closed"))
def join_asof_valid_table(spark, sf):
    asked = shipped(spark, sf).where("valid_at is not null and system_at is null")
    return temporal.as_of_table(closed(spark, sf), asked).select(*ASKED)


@query("join_asof_system_table", with_parts(asked_sql("valid_at IS NULL AND system_at IS NOT NULL"), "closed"))
def join_asof_system_table(spark, sf):
    asked = shipped(spark, sf).where("valid_at is null and system_at is not null")
    return temporal.as_of_table(closed(spark, sf), asked).select(*ASKED)


@query("join_asof_bitemporal_table", with_parts(asked_sql("TRUE"), "closed"))
def join_asof_bitemporal_table(spark, sf):
    return temporal.as_of_table(closed(spark, sf), shipped(spark, sf)).select(*ASKED)


@query("win_fact_timeline", with_parts(f"SELECT {SQL_COLS} FROM closed WHERE subject = '7' AND predicate = '2-HIGH'", "closed"))
def win_fact_timeline(spark, sf):
    return temporal.timeline(closed(spark, sf), "7", "2-HIGH").select(*COLS)


@query("job_supersede", with_parts("""
    , prior AS (SELECT * FROM bifacts WHERE object = 'O')
    , news AS (SELECT fact_id AS prior_id, -fact_id - 1 AS fact_id, valid_from + INTERVAL 30 DAY AS vf FROM prior)
    SELECT fact_id, object, valid_from, CASE WHEN object = 'O' THEN valid_from + INTERVAL 30 DAY END AS valid_to,
      CASE WHEN object = 'O' THEN -fact_id - 1 END AS superseded_by_id,
      CASE WHEN object = 'O' AND predicate = '1-URGENT' THEN TIMESTAMP '2002-01-01' ELSE expired_at END AS expired_at, CAST(NULL AS VARCHAR) AS reason FROM bifacts
    UNION ALL SELECT fact_id, 'F', vf, NULL, NULL, NULL, NULL FROM news
    UNION ALL SELECT -fact_id - 1, NULL, NULL, NULL, NULL, NULL, 'closes_before_start' FROM bifacts WHERE object = 'P'
    UNION ALL SELECT -fact_id - 1, NULL, NULL, NULL, NULL, NULL, 'prior_not_found' FROM bifacts WHERE object = 'F'""", "bifacts"))
def job_supersede(spark, sf):
    facts = dt.order_facts(spark, sf)
    kind = F.col("object")
    shift = F.expr("INTERVAL '30' DAY")
    # open orders get a successor; others are asked for with a bad instant or a missing prior
    start = F.when(kind == "P", F.col("valid_from") - shift).otherwise(F.col("valid_from") + shift)
    values = {
        "fact_id": (-F.col("fact_id") - 1), "object": F.lit("F"), "valid_from": start,
        "expired_at": F.lit(None).cast("timestamp_ntz"),
    }
    batch = facts.select(
        F.when(kind == "F", F.lit(-1) * F.col("fact_id") - 1_000_000_000).otherwise(F.col("fact_id")).alias("prior_fact_id"),
        F.struct(*[values.get(c, F.col(c)).alias(c) for c in facts.columns]).alias("successor"),
        F.lit(None).cast("timestamp_ntz").alias("closing_valid_instant"),
        F.when(F.col("predicate") == "1-URGENT", F.lit("2002-01-01").cast("timestamp_ntz")).alias("system_invalidation_instant"),
    )
    after, refused = temporal.supersede(facts, batch)
    cols = ["fact_id", "object", "valid_from", "valid_to", "superseded_by_id", "expired_at"]
    kept = after.select(*cols, F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(refused.select("fact_id", "reason"), allowMissingColumns=True)


@query("fn_fact_interval_ops", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate >= o_orderdate AS valid,
      coalesce(o_orderdate <= TIMESTAMP '1998-01-01' AND l_shipdate > TIMESTAMP '1998-01-01', FALSE) AS holds,
      CASE WHEN l_shipdate >= o_orderdate THEN l_shipdate END AS closed_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def fn_fact_interval_ops(spark, sf):
    start, end = F.col("o_orderdate"), F.col("l_shipdate")
    return dt.shipments(spark, sf).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        intervals.interval_valid(start, end).alias("valid"),
        intervals.contains(start, end, temporal.instant("1998-01-01")).alias("holds"),
        intervals.close_at(start, end, end).alias("closed_at"),
    )
