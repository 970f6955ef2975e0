"""Resolution log."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.catalog import query
from spanledger.catalog.twins import u5, with_parts
from spanledger.operators import resolution
from spanledger.sources import driver_tables as dt


@query("win_active_membership", with_parts("""
    SELECT mention_id, cluster_id, source, CASE WHEN NOT ok THEN 'refused' WHEN seq = (SELECT a.seq FROM active a WHERE a.mention_id = j.mention_id)
      THEN 'active' ELSE 'superseded' END AS status FROM judged_log j""", "judged_log", "active"))
def win_active_membership(spark, sf):
    return resolution.membership_status(dt.decision_log(spark, sf)).select("mention_id", "cluster_id", "source", "status")


@query("win_golden_records", with_parts("""
    , m AS (SELECT a.cluster_id, a.decision_id, p_name, p_type FROM active a JOIN part ON CAST(p_partkey AS VARCHAR) = a.mention_id)
    SELECT cluster_id, arg_min(p_name, (-length(p_name), p_name, p_type)) AS canonical_name,
      arg_min(p_type, (-length(p_name), p_name, p_type)) AS entity_type, count(*) AS n_members, count(DISTINCT decision_id) AS n_decisions
    FROM m GROUP BY cluster_id""", "active"))
def win_golden_records(spark, sf):
    active = resolution.active_memberships(dt.decision_log(spark, sf))
    out = resolution.golden_records(active, dt.part_mentions(spark, sf))
    return out.select("cluster_id", "canonical_name", "entity_type", "n_members", "n_decisions")


@query("win_golden_members", with_parts("""
    SELECT cluster_id, mention_id, decision_id, max_by(p_name, (length(p_name), p_name)) OVER (PARTITION BY cluster_id) AS canonical_name
    FROM (SELECT a.*, p_name FROM active a JOIN part ON CAST(p_partkey AS VARCHAR) = a.mention_id)""".replace(
    "max_by(p_name, (length(p_name), p_name)) OVER (PARTITION BY cluster_id)",
    "first_value(p_name) OVER (PARTITION BY cluster_id ORDER BY length(p_name) DESC, p_name)"), "active"))
def win_golden_members(spark, sf):
    active = resolution.active_memberships(dt.decision_log(spark, sf))
    records = resolution.golden_records(active, dt.part_mentions(spark, sf))
    return resolution.golden_members(active, records).select("cluster_id", "mention_id", "decision_id", "canonical_name")


@query("win_membership_history", with_parts("""
    SELECT mention_id, cluster_id, source, decided_at, lead(decided_at) OVER w AS active_until, lead(decided_at) OVER w IS NULL AS is_active
    FROM judged_log WHERE ok WINDOW w AS (PARTITION BY tenant_id, mention_id ORDER BY seq)""", "judged_log"))
def win_membership_history(spark, sf):
    return resolution.membership_history(dt.decision_log(spark, sf)).select(
        "mention_id", "cluster_id", "source", "decided_at", "active_until", "is_active"
    )


def _proposals(rows, proposal, source, day):
    return rows.select(
        F.lit("catalog").alias("tenant_id"), F.col("p_partkey").cast("string").alias("mention_id"),
        proposal.alias("proposal_id"), F.lit(source).alias("source"), F.lit(1.0).alias("confidence"),
        F.lit(day).cast("timestamp_ntz").alias("decided_at"), F.col("p_partkey").alias("seq"),
    )


OUT = ["mention_id", "cluster_id", "decision_id", "action", "source"]


@query("job_resolution_merge", f"""SELECT CAST(p_partkey AS VARCHAR) AS mention_id, {u5("'catalog:cluster:'||p_brand||'/'||p_type")} AS cluster_id,
    {u5("'catalog:decision:'||p_brand||'/'||p_type")} AS decision_id, 'merge' AS action, 'rule' AS source FROM part""")
def job_resolution_merge(spark, sf):
    p = dt.table(spark, sf, "part")
    return resolution.merge(_proposals(p, F.concat_ws("/", "p_brand", "p_type"), "rule", "2024-01-01")).select(*OUT)


@query("job_resolution_unmerge", f"""
    WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS mention_id, {u5("'catalog:cluster:'||p_brand||'/'||p_type")} AS merged,
      {u5("'catalog:cluster:split:'||p_partkey")} AS own, p_size > 25 AS out FROM part)
    SELECT mention_id, CASE WHEN out THEN own ELSE merged END AS cluster_id FROM d""")
def job_resolution_unmerge(spark, sf):
    p = dt.table(spark, sf, "part")
    merged = resolution.merge(_proposals(p, F.concat_ws("/", "p_brand", "p_type"), "rule", "2024-01-01"))
    split = resolution.unmerge(_proposals(p.where("p_size > 25"), F.lit("split"), "human", "2024-02-01"))
    # a later model run proposes the merge again and must not undo the split
    again = resolution.merge(_proposals(p, F.concat_ws("/", "p_brand", "p_type"), "model", "2024-03-01"))
    log = merged.unionByName(split.withColumn("seq", F.col("seq") + 10**12)).unionByName(
        again.withColumn("seq", F.col("seq") + 2 * 10**12)
    )
    return resolution.active_memberships(log).select("mention_id", "cluster_id")


@query("job_resolution_disambiguate", f"""SELECT CAST(p_partkey AS VARCHAR) AS mention_id, {u5("'catalog:cluster:'||p_name||':'||p_partkey")} AS cluster_id,
    {u5("'catalog:decision:'||p_name")} AS decision_id, 'disambiguate' AS action, 'human' AS source FROM part""")
def job_resolution_disambiguate(spark, sf):
    p = dt.table(spark, sf, "part")
    return resolution.disambiguate(_proposals(p, F.col("p_name"), "human", "2024-01-01")).select(*OUT)
