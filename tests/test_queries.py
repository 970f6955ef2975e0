"""Registered queries against their SQL on the smallest tables, and the shape of plans."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanledger.sources import driver_tables as dt
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

# a cross-section; tools/check.py runs all
CHECKED = (
    "src_documents", "src_labels_csv", "sink_audit_csv", "flt_tenant_scope", "flt_audit_valid", "join_fact_trace",
    "join_anti_orphans", "agg_assertion_support", "agg_shared_facts", "win_supersede_close", "join_asof_bitemporal",
    "win_active_membership", "win_golden_records", "join_expand_hops", "top_overview", "agg_usage_tenant",
    "win_spend_trailing", "win_slot_admission", "fn_chunk_lines", "fn_norm_date", "job_evaluate", "agg_deletion_result",
    "str_usage_windows", "join_asof_bitemporal_table", "opt_similar_candidates", "opt_label_disagreements", "opt_edge_signature",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, con, name):
    text, good = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert good, text


def test_every_query_has_sql():
    queries, oracles = entry.catalog.load()
    assert set(queries) == set(oracles) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"fact_id", "assertion_id", "start_offset", "quote"} <= set(df.columns) and df.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(entry.queries()["win_fact_timeline"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,2-HIGH)" in p or "EqualTo(o_orderpriority,2-HIGH)" in p
    p = plan(entry.queries()["fn_content_hash"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


@pytest.mark.parametrize("name", ["agg_usage_document", "win_spend_trailing", "join_fact_evidence", "win_golden_records",
                                  "agg_assertion_support", "fn_uuid5", "win_first_event"])
def test_no_cartesian_products(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_python_is_left_out_where_spark_has_the_function(spark):
    for name in ("fn_norm_date", "fn_chunk_lines", "agg_usage_document", "win_golden_records", "flt_audit_valid"):
        p = plan(entry.queries()[name](spark, SF))
        assert "Python" not in p and "ArrowEval" not in p, name


def test_aggregates_start_before_the_shuffle(spark):
    p = plan(dt.usage_events(spark, SF).groupBy("tenant_id").count())
    assert p.count("HashAggregate") >= 2


def test_side_by_side_shows_every_category(spark, con):
    from spanledger.operators import evaluate as ev

    text, good = compare(spark, con, "job_side_by_side_all", entry.queries()["job_side_by_side_all"], entry.oracle_sql()["job_side_by_side_all"], SF)
    assert good, text
    rows = spark.createDataFrame(
        [("c", "Parties", ["One Holdings, Inc.; ; Two LLC (x)"], [("Two, L.L.C.", "q", True)]), ("c", "Renewal Term", ["two  Years"], None),
         ("c", "Agreement Date", ["soon", "May 1, 2014"], [("YYYY-MM-DD", "q", False)])],
        f"contract string, category string, answers {ev.STRINGS}, items {ev.ITEM}")
    assert {tuple(r)[1:5] for r in ev.side_by_side(rows).collect()} == {
        ("Parties", 0, "one holdings", "two"), ("Parties", 1, "two", None), ("Renewal Term", 0, "two years", None), ("Agreement Date", 0, "2014-05-01", "YYYY-MM-DD")}


def test_refusals_of_all_three_gates(spark, con):
    from spanledger.catalog.ledger import spend_refusals

    text, good = compare(spark, con, "job_quota_refusals_all", entry.queries()["job_quota_refusals_all"], entry.oracle_sql()["job_quota_refusals_all"], SF)
    assert good, text
    day = 24 * 3600 * 1_000_000
    events = spark.createDataFrame([("t", "a", 0, 60), ("t", "b", day, 39), ("t", "c", 2 * day, 1), ("t", "d", 9 * day, 99), ("u", "e", 0, 100)], "tenant_id string, event_id string, at_micros long, cost_millicents long")
    tiers = spark.createDataFrame([("t", 100), ("u", 100)], "tenant_id string, spend_cap_millicents long")
    got = {r.event_id: (r.action, r.metadata_json) for r in spend_refusals(events, tiers, 7).collect()}
    assert got == {f"refusal-spend-{e}": ("spend_cap_exceeded", f'{{"current_spend_millicents":{s},"spend_cap_millicents":100,"projected_cost_millicents":{c},"reason":"period spend cap"}}') for e, s, c in (("c", 99, 1), ("d", 1, 99), ("e", 0, 100))}
