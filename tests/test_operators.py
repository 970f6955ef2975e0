"""Behaviour of the table operators on small fixtures, against goldens and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanledger.operators import graph, ontology, ordered, provenance, quota, resolution, temporal, usage
from spanledger.plans import delete, evaluation, ingest
from spanledger.scope import scoped, split_foreign_writes
from spanledger.sources import dimensions as dim
from spanledger.sources import documents as docs
from spanledger.sources import driver_tables as dt
from spanledger.sources import evaluation as ev_src
from spanledger.sources.store import SnapshotStore, upsert


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# ---- ordered helpers agree with plain windows, hot key included ----------------


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    # key k0 holds half of the rows; times collide
    data = [
        (f"k{rng.choice([0, 0, 0, 1, 2, 3])}", i, rng.randrange(400), rng.randrange(-5, 20))
        for i in range(600)
    ]
    return spark.createDataFrame(data, "k string, id long, t long, v long")


@pytest.mark.parametrize("hot", [10**6, 20])
def test_with_next(series, hot):
    got = ordered.with_next(series, ["k"], F.floor(F.col("t") / 50), ["t", "id"], ["t", "id"], hot_rows=hot)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = series.select("*", F.lead("t").over(w).alias("next_t"), F.lead("id").over(w).alias("next_id"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("hot", [10**6, 20])
def test_running_sum(series, hot):
    got = ordered.running_sum(series, ["k"], F.floor(F.col("t") / 50), ["t", "id"], F.col("v"), "s", hot)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got) == rows(series.select("*", F.sum("v").over(w).alias("s")))


def test_sum_before(series):
    got = ordered.sum_before(series, ["k"], ["id"], "t", "v", 70, 50, "s")
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-70, -1)
    assert rows(got) == rows(series.select("k", "id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")))


@pytest.mark.parametrize("hot", [10**6, 20])
def test_count_within(series, hot):
    got = ordered.count_within(series, ["k"], ["id"], "t", 40, "n", hot)
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-39, -1)
    assert rows(got, "id", "n") == rows(series.select("id", F.count(F.lit(1)).over(w).alias("n")))


def test_first_and_last_per_key(series):
    first = {r.k: (r.t, r.id) for r in ordered.first_per_key(series, ["k"], ["t", "id"]).collect()}
    last = {r.k: (r.t, r.id) for r in ordered.last_per_key(series, ["k"], ["t", "id"]).collect()}
    data = [(r.k, r.t, r.id) for r in series.collect()]
    for k in first:
        assert first[k] == min((t, i) for kk, t, i in data if kk == k)
        assert last[k] == max((t, i) for kk, t, i in data if kk == k)


@pytest.mark.parametrize("block", [37, 100, 1000])
def test_admissions_against_brute_force(spark, block):
    rng = random.Random(block)
    data = [
        (rng.choice(["hot", "hot", "hot", "a"]), f"{i:04d}", rng.randrange(600), 0, 3) for i in range(400)
    ]
    data = [(t, i, at, at + rng.randrange(1, 90), c) for t, i, at, _, c in data]
    df = spark.createDataFrame(data, "tenant_id string, event_id string, at_micros long, until_micros long, cap long")
    got = {r.event_id: r.accepted for r in quota.admissions(df, block).collect()}
    held: dict[str, list[int]] = {}
    for tenant, event, at, until, cap in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        active = [e for e in held.get(tenant, []) if e > at]
        ok = len(active) < cap
        held[tenant] = active + [until] * ok
        assert got[event] == ok, event
    assert len(got) == len(data) and not all(got.values())


def test_admission_rounds_of_a_saturated_tenant(spark, monkeypatch):
    """One slot, holds longer than a block, a request an hour: no block ever ends empty."""
    written = []
    cut = quota.cut_lineage
    monkeypatch.setattr(quota, "cut_lineage", lambda df: written.append(1) or cut(df))
    df = spark.range(200 * 24).select(
        F.lit("t").alias("tenant_id"), F.format_string("%05d", "id").alias("event_id"), (F.col("id") * quota.HOUR).alias("at_micros"),
        ((F.col("id") + 25) * quota.HOUR).alias("until_micros"), F.lit(1).cast("long").alias("cap"))
    got = quota.admissions(df, quota.DAY).where("accepted").select(F.col("event_id").cast("long")).collect()
    assert sorted(r[0] for r in got) == list(range(0, 200 * 24, 25))
    # two tables a round, eight doublings for 200 blocks
    assert len(written) <= 3 + 2 * 9
    assert quota.admissions(df).where("accepted").count() == len(got)


# ---- tenant scope --------------------------------------------------------------


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "tenant_id string, id int")
    assert rows(scoped(df, "a"), "id") == [(1,)]
    assert rows(scoped(df, None)) == []
    own, refused = split_foreign_writes(df, "a")
    assert rows(own, "id") == [(1,)] and rows(refused, "id") == [(2,), (3,)]
    own, refused = split_foreign_writes(df, None)
    assert rows(own) == [] and refused.count() == 3


# ---- time ----------------------------------------------------------------------

FACT = ("tenant_id string, fact_id string, claim string, subject string, predicate string, object string, valid_from timestamp_ntz, "
        "valid_to timestamp_ntz, created_at timestamp_ntz, expired_at timestamp_ntz, superseded_by_id string")


def fact(i, start, end=None, created="2020-01-01", expired=None, subject="s"):
    import datetime as d

    day = lambda x: x and d.datetime.fromisoformat(x)
    return ("t", i, i, subject, "p", i, day(start), day(end), day(created), day(expired), None)


def test_as_of(spark):
    facts = spark.createDataFrame(
        [fact("a", "2020-01-01", "2020-06-01"), fact("b", "2020-06-01"),
         fact("c", "2020-01-01", expired="2020-03-01", subject="x")], FACT)
    at = lambda v, s=None, **k: [r.fact_id for r in temporal.as_of(facts, v, s, **k).collect()]
    assert at("2020-06-01") == ["b"]  # the end is exclusive, the start inclusive
    assert at("2020-05-31") == ["a"]
    assert at(None) == ["b", "a"]  # no instant: no valid-time constraint, unexpired only
    assert sorted(at("2020-02-01", "2020-02-01")) == ["a", "c"]
    assert at("2020-02-01", "2020-03-01") == ["a"]
    assert at("2020-02-01", "2020-02-01", subject="x") == ["c"]
    assert rows(temporal.as_of_each(facts, ["2020-02-01", "2020-07-01"]), "fact_id") == [("a",), ("b",), ("c",), ("c",)]


def test_supersede(spark):
    facts = spark.createDataFrame([fact("a", "2020-01-01"), fact("b", "2020-01-01")], FACT)
    succ = spark.createDataFrame([fact("n1", "2020-06-01"), fact("n2", "2019-01-01"), fact("n3", "2020-06-01")], FACT)
    prior = F.when(F.col("fact_id") == "n1", "a").when(F.col("fact_id") == "n2", "b").otherwise("gone")
    batch = succ.select(
        prior.alias("prior_fact_id"), F.struct(*succ.columns).alias("successor"),
        F.lit(None).cast("timestamp_ntz").alias("closing_valid_instant"),
        F.lit(None).cast("timestamp_ntz").alias("system_invalidation_instant"))
    after, refused = temporal.supersede(facts, batch)
    got = {r.fact_id: (str(r.valid_to), r.superseded_by_id) for r in after.collect()}
    assert got == {"a": ("2020-06-01 00:00:00", "n1"), "b": ("None", None), "n1": ("None", None)}
    assert rows(refused, "fact_id", "reason") == [("n2", "closes_before_start"), ("n3", "prior_not_found")]


# ---- resolution ----------------------------------------------------------------


def log(spark, entries):
    data = [("t", m, c, f"d{i}", s, 1.0, i) for i, (m, c, s) in enumerate(entries)]
    df = spark.createDataFrame(data, "tenant_id string, mention_id string, cluster_id string, decision_id string, source string, confidence double, seq long")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn("decided_at", start + F.make_dt_interval(days=F.col("seq").cast("int")))


def test_human_split_survives_a_model_rerun(spark):
    entries = [("m1", "c", "model"), ("m2", "c", "model"), ("m1", "own", "human"), ("m1", "c", "model"), ("m2", "c2", "model")]
    df = log(spark, entries)
    assert rows(resolution.active_memberships(df), "mention_id", "cluster_id") == [("m1", "own"), ("m2", "c2")]
    status = {r.decision_id: r.status for r in resolution.membership_status(df).collect()}
    assert status == {"d0": "superseded", "d1": "superseded", "d2": "active", "d3": "refused", "d4": "active"}


def test_random_logs_follow_the_rule(spark):
    rng = random.Random(3)
    entries = [(f"m{rng.randrange(12)}", f"c{rng.randrange(4)}", rng.choice(["human", "model", "rule", "rule"])) for _ in range(200)]
    want = {}
    for m, c, s in entries:
        now = want.get(m)
        if now and now[1] == "human" and s != "human":
            continue
        want[m] = (c, s)
    got = {r.mention_id: (r.cluster_id, r.source) for r in resolution.active_memberships(log(spark, entries)).collect()}
    assert got == want
    history = resolution.membership_history(log(spark, entries))
    assert history.where("is_active").count() == len(want)


def test_golden_records_and_empty_clusters(spark):
    df = log(spark, [("m1", "a", "rule"), ("m2", "a", "rule"), ("m3", "b", "rule"), ("m3", "a", "human")])
    mentions = spark.createDataFrame([("t", "m1", "MSFT", "org"), ("t", "m2", "Microsoft", "org"), ("t", "m3", "Microsofd", "org")],
                                     "tenant_id string, mention_id string, name string, entity_type string")
    active = resolution.active_memberships(df)
    got = rows(resolution.golden_records(active, mentions), "cluster_id", "canonical_name", "n_members")
    assert got == [("a", "Microsofd", 3)]  # longest, then smallest; b has no member left
    preferred = spark.createDataFrame([("t", "a", "Chosen")], "tenant_id string, cluster_id string, preferred_name string")
    assert rows(resolution.golden_records(active, mentions, preferred), "canonical_name") == [("Chosen",)]


# ---- graph ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain(spark):
    names = ["Alpha", "Beta", "Gamma", "Delta", "100%_sure"]
    e = spark.createDataFrame([("t", "ABCDE"[i], n, "x", "raw", i) for i, n in enumerate(names)] + [("u", "Z", "Alpha", "x", "raw", 9)],
                              "tenant_id string, entity_id string, name string, entity_type string, kind string, created_at int")
    links = [("t", "AB", "A", "B"), ("t", "CB", "C", "B"), ("t", "CD", "C", "D"), ("t", "AA", "A", "A"), ("u", "ZB", "Z", "B")]
    d = spark.createDataFrame([(*link, "r", i) for i, link in enumerate(links)],
                              "tenant_id string, edge_id string, source_entity_id string, target_entity_id string, edge_type string, created_at int")
    return e, d


@pytest.mark.parametrize("depth, nodes, edges", [
    (0, "A", []), (1, "AB", ["AA", "AB"]), (2, "ABC", ["AA", "AB", "CB"]), (3, "ABCD", ["AA", "AB", "CB", "CD"])])
def test_expansion_by_depth(chain, depth, nodes, edges):
    e, d = chain
    got_nodes, got_edges = graph.search(scoped(e, "t"), scoped(d, "t"), "alpha", depth)
    assert "".join(sorted(r.entity_id for r in got_nodes.collect())) == nodes
    assert sorted(r.edge_id for r in got_edges.collect()) == edges


def test_search_takes_text_literally(chain):
    e, _ = chain
    find = lambda q: [r.name for r in graph.find_by_name(scoped(e, "t"), q).collect()]
    assert find("%") == ["100%_sure"] and find("_") == ["100%_sure"] and find("e_a") == []
    assert find(" ETA ") == ["Beta"]


def test_views_are_capped(spark):
    e = spark.range(205).select(F.lit("t").alias("tenant_id"), F.format_string("n%03d", "id").alias("entity_id"),
                                F.lit("hub").alias("name"), F.col("id").alias("created_at"), F.lit("raw").alias("kind"))
    d = e.select("tenant_id", F.concat(F.lit("e"), "entity_id").alias("edge_id"), F.col("entity_id").alias("source_entity_id"),
                 F.lit("n204").alias("target_entity_id"), F.lit("r").alias("edge_type"), "created_at")
    view = graph.overview(e, d)
    assert rows(view.groupBy("item", "truncated").count()) == [("edge", True, 200), ("node", True, 200)]
    small = graph.overview(e.limit(3), d.limit(0))
    assert rows(small.groupBy("item", "truncated").count()) == [("node", False, 3)]
    found = graph.capped_search(e, d, "hub", 99)
    assert found.where("item = 'node'").count() == 200 and found.first().truncated


def test_duplicate_mentions_collapse(spark):
    e = spark.createDataFrame([("t", "c", "N", 0, 5, f"e{i}", i) for i in range(2)] + [("t", "c", "N", 6, 9, "e2", 2)],
                              "tenant_id string, chunk_id string, name string, start_offset int, end_offset int, entity_id string, seq int")
    d = spark.createDataFrame([("t", f"x{i}", f"e{i}", "e2", "r", "c", 0, 5, i) for i in range(2)],
                              "tenant_id string, edge_id string, source_entity_id string, target_entity_id string, edge_type string, chunk_id string, start_offset int, end_offset int, seq int")
    survivors, id_map, edges = graph.dedupe_mentions(e, d)
    assert rows(survivors, "entity_id") == [("e0",), ("e2",)]
    assert ("e1", "e0") in rows(id_map, "entity_id", "kept_id")
    assert rows(edges, "edge_id", "source_entity_id") == [("x0", "e0")]


# ---- facts and erasure ---------------------------------------------------------

SHARED = "This very same opening sentence is found in both of the documents."


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {"d1": f"{SHARED} One.\n\nOnly in the first.", "d2": f"{SHARED} Two.\n\n\n\nOnly in the second."}
    return spark.createDataFrame([("t", f"00000000-0000-0000-0000-00000000000{i}", text) for i, text in enumerate(texts.values())],
                                 "tenant_id string, document_id string, text string")


def tables_of(spark, corpus):
    t = ingest.ingest(corpus)
    none = "tenant_id string, document_id string, row_id string"
    t["documents"] = corpus.select("tenant_id", "document_id")
    t["mentions"] = t["chunks"].select("tenant_id", "document_id", "chunk_id", F.concat(F.lit("m"), "chunk_id").alias("mention_id"),
                                       F.substring("text", 1, 8).alias("name"))
    t["memberships"] = t["mentions"].select("tenant_id", "mention_id", F.concat(F.lit("s"), "mention_id").alias("membership_id"),
                                            F.col("name").alias("cluster_id"), F.lit(True).alias("is_active"))
    t["golden_records"] = t["memberships"].select("tenant_id", "cluster_id", F.col("cluster_id").alias("canonical_name")).distinct()
    for name in delete.BY_DOCUMENT:
        t[name] = spark.createDataFrame([], none)
    return t


def test_shared_fact_lives_until_the_last_assertion(spark, corpus):
    t = tables_of(spark, corpus)
    assert t["facts"].count() == 5 and t["assertions"].count() == 6
    assert rows(ingest.shared_facts(t), "n_documents") == [(2,), (2,)]
    first = t["documents"].orderBy("document_id").limit(1)
    after, gone = delete.delete_documents(t, first)
    report = delete.deletion_report(gone).first()
    assert (report.n_chunks, report.n_assertions, report.n_facts, report.n_facts_kept) == (2, 3, 2, 1)
    assert report.facts_died and report.facts_survived
    assert report.total_records_erased == 2 + 3 + 2 + 2 + 3 + 3  # chunks, assertions, facts, mentions, entities, edges
    live = provenance.live_facts(after["facts"], after["assertions"], after["spans"])
    assert live.where(F.col("claim").startswith("This very same")).count() == 1
    # nothing dangles after the erasure
    bad = provenance.integrity_violations(after["facts"], after["assertions"], after["spans"], after["documents"],
                                          after["chunks"], after["edges"], after["entities"])
    assert bad.count() == 0
    empty, gone = delete.delete_documents(after, t["documents"])
    assert delete.deletion_report(gone).first().n_facts == 3
    assert all(empty[n].count() == 0 for n in delete.ROW_IDS)


def test_deleting_a_set_equals_one_by_one(spark, corpus):
    t = tables_of(spark, corpus)
    both, _ = delete.delete_documents(t, t["documents"])
    ids = [r.document_id for r in t["documents"].collect()]
    step = t
    for i in ids:
        step, _ = delete.delete_documents(step, t["documents"].where(F.col("document_id") == i))
    for n in delete.ROW_IDS:
        assert both[n].count() == step[n].count() == 0


def test_foreign_documents_are_not_deleted(spark, corpus):
    t = tables_of(spark, corpus)
    foreign = t["documents"].withColumn("tenant_id", F.lit("other"))
    _, gone = delete.delete_documents(t, foreign)
    assert all(df.count() == 0 for df in gone.values())


def test_ingest_is_idempotent(spark, corpus, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    t = ingest.ingest(corpus)
    store.write(t)
    again = ingest.ingest(corpus.unionByName(corpus))
    keys = {"chunks": "chunk_id", "entities": "entity_id", "edges": "edge_id", "facts": "fact_id", "assertions": "assertion_id", "spans": "span_id"}
    for n, key in keys.items():
        old = store.read(n).select(*t[n].columns)
        merged = upsert(old, again[n], ["tenant_id", key], [c for c in old.columns if c not in ("tenant_id", key)])
        assert rows(merged) == rows(old), n
    assert t["chunks"].count() == 4


def test_offsets_quote_the_stored_text(spark):
    dirty = spark.createDataFrame([("t", "00000000-0000-0000-0000-000000000001", "ﬁrst part\r\n\r\n  ﬂat \r\n\r\n\r\n")],
                                  "tenant_id string, document_id string, text string")
    t = ingest.ingest(dirty)
    assert [r.text for r in t["chunks"].orderBy("chunk_index").collect()] == ["first part", "flat"]
    joined = t["spans"].join(t["chunks"], "chunk_id")
    exact = F.substring("text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) == F.col("quote")
    assert joined.where(~exact).count() == 0 and joined.count() == 2


def test_fabricated_quotes_and_loose_edges_are_rejected(spark):
    chunk = spark.createDataFrame([("t", "d", "c", "Acme owes Bolt ten.")], "tenant_id string, document_id string, chunk_id string, text string")
    named = spark.createDataFrame(
        [("t", "d", "c", 1, "Acme", "Org", "Acme"), ("t", "d", "c", 2, "Bolt", "Org", "Bolt"), ("t", "d", "c", 3, "Made", "Org", "made up"),
         ("t", "d", "c", 4, "Bad", "Planet", "owes"), ("t", "d", "c", 5, " ", "Org", "ten")],
        "tenant_id string, document_id string, chunk_id string, seq int, name string, entity_type string, quote string")
    linked = spark.createDataFrame(
        [("t", "d", "c", 1, "Acme", "Bolt", "OWES", "Acme owes Bolt"), ("t", "d", "c", 2, "Acme", "Nobody", "OWES", "owes")],
        "tenant_id string, document_id string, chunk_id string, seq int, source_name string, target_name string, edge_type string, quote string")
    onto = spark.createDataFrame([("t", ["Org"], [])], "tenant_id string, entity_types array<string>, edge_types array<string>")
    out = ingest.verify_extraction(chunk, named, linked, onto)
    assert rows(out["entities"], "name", "start_offset", "end_offset") == [("Acme", 0, 4), ("Bolt", 10, 14)]
    assert rows(out["edges"], "start_offset", "end_offset") == [(0, 14)]
    assert rows(out["rejected"], "kind", "reason") == [("edge", "unknown_endpoint"), ("entity", "quote_not_in_text")]


def test_require_fails_the_write(spark):
    df = spark.createDataFrame([(1,), (-1,)], "x int")
    assert provenance.require(df.where("x > 0"), F.col("x") > 0, "bad").count() == 1
    with pytest.raises(Exception, match="bad row"):
        provenance.require(df, F.col("x") > 0, "bad row").collect()


# ---- ledger --------------------------------------------------------------------


def test_usage_periods_retries_and_empty_tenants(spark):
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    data = [("t", "e1", "2026-09-30 23:59:00", "2026-10-01 00:05:00", 10), ("t", "e1", "2026-09-30 23:59:00", "2026-10-01 00:06:00", 10),
            ("t", "e2", "2026-10-01 00:00:00", "2026-10-01 00:00:01", 5)]
    df = spark.createDataFrame(data, "tenant_id string, event_id string, occurred_at string, recorded_at string, n long")
    df = df.withColumns({"occurred_at": ts("occurred_at"), "recorded_at": ts("recorded_at")}).withColumns(
        {c: F.col("n") for c, _ in usage.TOTALS})
    flagged = usage.with_duplicate_flag(df, ["recorded_at"])
    assert flagged.where("is_duplicate").count() == 1
    september = usage.in_period(flagged.where("NOT is_duplicate"), F.lit("2026-09-01").cast("timestamp_ntz"), F.lit("2026-10-01").cast("timestamp_ntz"))
    tenants = spark.createDataFrame([("t",), ("quiet",)], "tenant_id string")
    got = rows(usage.tenant_usage(september, tenants), "tenant_id", "event_count", "total_cost_millicents")
    assert got == [("quiet", 0, 0), ("t", 1, 10)]


def test_exact_model_id_beats_alias(spark):
    e = spark.createDataFrame([("2026-Q1", "model-small"), ("2026-Q4", "model-small"), ("2026-Q4", "nobody")], "price_version string, model_id string")
    e = e.withColumns({"input_tokens": F.lit(1000), "output_tokens": F.lit(0), "cache_read_input_tokens": F.lit(None).cast("int"), "cache_write_input_tokens": F.lit(0)})
    got = {(r.price_version, r.model_id): r.cost_millicents for r in usage.priced(e, dim.prices(spark), dim.model_aliases(spark)).collect()}
    assert got == {("2026-Q1", "model-small"): 60, ("2026-Q4", "model-small"): 50, ("2026-Q4", "nobody"): None}


def test_ontology_versions(spark):
    schema = "tenant_id string, ontology_name string, ontology_version long, entity_types array<string>, edge_types array<string>"
    stored = spark.createDataFrame([("t", "o", 1, ["A"], ["R"]), ("t", "o", 2, ["A", "B"], ["R"])], schema)
    asked = spark.createDataFrame([("t", "o", None, ["S"]), ("t", "new", ["C"], None)],
                                  "tenant_id string, ontology_name string, entity_types array<string>, edge_types array<string>")
    got = {r.ontology_name: (r.ontology_version, r.entity_types, r.edge_types) for r in ontology.next_versions(stored, asked).collect()}
    assert got == {"o": (3, ["A", "B"], ["S"]), "new": (1, ["C"], [])}
    table, refused = ontology.publish(stored, spark.createDataFrame([("t", "o", 2, ["X"], []), ("t", "o", 3, ["X"], [])], schema))
    assert rows(refused, "ontology_version") == [(2,)] and table.count() == 3
    assert rows(ontology.latest(table), "ontology_version") == [(3,)]


# ---- sources and scoring -------------------------------------------------------


def test_label_table(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text(
        '# a comment\nFilename,Document Name,Governing Law,Governing Law-Answer,Non-Compete,Non-Compete-Answer,Parties\n'
        '" a.pdf ",A,"some clause","Delaware","the full\nclause",Yes,"X; Y"\n'
        'b.pdf,B,"clause",nan,"text",No,\n', encoding="utf-8")
    wide = ev_src.read_label_table(spark, str(path))
    long = ev_src.labels_long(wide, ["Governing Law", "Non-Compete", "Parties"])
    assert sorted((r.contract, r.category, r.answers) for r in long.collect()) == [
        ("a.pdf", "Governing Law", ["Delaware"]), ("a.pdf", "Non-Compete", ["the full", "clause"]), ("a.pdf", "Parties", ["X", "Y"])]


def test_predictions_file(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text(
        '{"contract":"a","prompt_hash":"h","predictions":{"Parties":[{"name":"old"}]}}\n\n'
        '{"filename":"b","prompt_hash":"h","predictions":{}}\n'
        '{"contract":"a","prompt_hash":"h","predictions":{"Parties":[{"normalized_value":"","name":"N","verbatim_quote":" q ","quote_found":false},{"value":"x","quote":"y"}]}}\n')
    long = ev_src.predictions_long(ev_src.read_predictions(spark, str(path)))
    got = [(r.contract, r.category, [tuple(i) for i in r["items"]]) for r in long.collect()]
    assert got == [("a", "Parties", [("N", "q", False), ("", "", True)])]


def test_unusable_prediction_lines_are_told(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"contract":"a","prompt_hash":"h","predictions":{}}\n{"contract":"b","predic\n\n{"prompt_hash":"h","predictions":{}}\n')
    told = ev_src.refused_predictions(spark, str(path))
    assert {(r.line, r.reason) for r in told.collect()} == {('{"contract":"b","predic', "unreadable"), (None, "no_contract")}
    with pytest.raises(Exception, match="(?i)malformed"):
        ev_src.read_predictions(spark, str(path)).collect()


def scoring_rows(spark, wrong=False, empty=False):
    labels = spark.createDataFrame(
        [("a", "Parties", ['Copper Kettle, Inc. ("Kettle"); Bolt LLC']), ("a", "Agreement Date", ["October 21, 2016"]),
         ("a", "Exclusivity", ["The buyer shall buy only here", "No other seller may be used"]),
         ("b", "Parties", ["Gamma Corp"]), ("b", "Agreement Date", ["1/2/2018"]), ("b", "Exclusivity", ["Completely different words follow"])],
        "contract string, category string, answers array<string>")
    other = F.when(F.col("contract") == "a", "b").otherwise("a") if wrong else F.col("contract")
    items = F.transform("answers", lambda a: F.struct(F.when(F.col("category") != "Exclusivity", a).otherwise("").alias("value"), a.alias("quote"), F.lit(True).alias("found")))
    preds = labels.select(other.alias("contract"), "category", items.alias("items"))
    texts = labels.groupBy("contract").agg(F.array_join(F.flatten(F.collect_list("answers")), " ").alias("contract_text"))
    return labels, preds.limit(0) if empty else preds, texts


def test_labels_as_predictions_score_one(spark):
    out = evaluation.evaluate(*scoring_rows(spark)).collect()
    got = {r.category: (r.recall, r.quote_found_rate) for r in out}
    assert got["Agreement Date"] == (1.0, 1.0) and got["Exclusivity"] == (1.0, 1.0)
    # two parties in one cell: predicted as one name, the first is found
    assert got["Parties"][1] == 1.0


def test_no_predictions_recall_zero(spark):
    assert all(r.recall == 0 and r.precision == 0 for r in evaluation.evaluate(*scoring_rows(spark, empty=True)).collect())


def test_swapped_labels_recall_near_zero(spark):
    out = evaluation.evaluate(*scoring_rows(spark, wrong=True)).collect()
    assert sum(r.tp for r in out) == 0


def test_party_modes(spark):
    schema = "contract string, category string, answers array<string>, items array<struct<value:string,quote:string,found:boolean>>"
    df = spark.createDataFrame([("a", "Parties", ['Copper Kettle, Inc.', 'Big Stoves, Inc. ("Stove")'],
                                 [("Copper Kettle, Inc.", "", True), ("Stove", "", True)])], schema)
    got = {r["mode"]: (r.tp, r.fp, r.fn) for r in evaluation.compare_party_modes(df).collect()}
    assert got == {"alias-aware": (2, 0, 0), "exact-name": (1, 1, 1)}


def test_snapshots_switch_together(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    a = spark.createDataFrame([("007", 1)], "tenant_id string, x int")
    assert store.version() == 0 and store.write({"a": a, "b": a}) == 1
    assert store.write({"a": a.withColumn("x", F.lit(2)), "b": a}) == 2
    assert store.read("a").first().x == 2 and store.read("a", 1).first().x == 1
    assert store.read("a").first().tenant_id == "007" and store.read("a").columns == a.columns


def test_manifest(spark):
    files = spark.createDataFrame([("a", b"one"), ("b", b"two")], "filename string, content binary")
    m = spark.createDataFrame([("1", "a", "one", None), ("2", "b", "xxx", "1"), ("3", "a", "one", "9"), ("4", "c", "one", None)],
                              "doc_id string, filename string, s string, amendment_of string").withColumn("sha256", F.sha2("s", 256))
    got = {r.doc_id: r.status for r in docs.manifest_report(m, files).collect()}
    assert got == {"1": "ok", "2": "hash_differs", "3": "unknown_predecessor", "4": "missing_file"}


def test_audit_keys_are_decoded_and_unreadable_metadata_is_refused(spark):
    from spanledger.operators import audit

    cases = {
        r'{"\u0074ext":"a"}': "document_text", r'{"d":{"Bod\u0079":"a"}}': "document_text", '{"a":"text"}': None, '{"TEXT" : 1}': "document_text",
        '{"a":[{"content":1}]}': "document_text", r'{"a":"b\"text\":"}': None, '{"a":"' + r"\u00e9" * 500 + '"}': None, '{"a":"' + r"\u00e9" * 501 + '"}': "document_text",
        "{bad": "metadata_unreadable", "[1]": "metadata_unreadable", "": "metadata_unreadable", "{}": None, None: None,
    }
    rows = spark.createDataFrame([(m,) for m in cases], "metadata_json string").selectExpr(
        "'data_access' as event_type", "'m' as model", "'1' as model_version", "0 as input_tokens", "0 as output_tokens", "metadata_json")
    assert {r.metadata_json: r.reason for r in audit.judged(rows).collect()} == cases


def test_packed_ids_come_back(one):
    from spanledger.functions.ids import packed, unpacked

    texts = {"a": "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "b": "6BA7B811-9dad-11d1-80b4-00c04fd430c8", "c": "", "d": "next-12", "e": "x" * 16,
             "f": "6ba7b811-9dad-11d1-80b4-00c04fd430c8-retry", "g": "6ba7b8119dad11d180b400c04fd430c8", "h": "éﬁ"}
    row = one([F.struct(packed(F.col(c)).alias("short"), unpacked(packed(F.col(c))).alias("text")).alias(c) for c in texts]
              + [unpacked(packed(F.lit(None).cast("string"))).alias("none")], **texts)
    assert {c: row[c].text for c in texts} == texts and row["none"] is None
    assert len(row["a"].short) == 17 and len({bytes(row[c].short) for c in texts}) == len(texts)


def test_an_extraction_writes_and_moves_each_row_once(spark, tmp_path):
    """Facts, assertions and spans of documents that differ need no shuffle of whole rows; repeated ones are told apart."""
    from spanledger.plans.ingest import facts_of, repeated_documents, sentence_extract
    from spanledger.sources.documents import paragraph_chunks

    def rows(docs):
        d = spark.createDataFrame(docs, "tenant_id string, document_id string, text string")
        entities, _ = sentence_extract(paragraph_chunks(d))
        return facts_of(entities, repeated_documents(d)), facts_of(entities)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    single, plain = rows([("t", "a", "One. Two."), ("t", "b", "One. One.")])
    assert all("Exchange" not in plan(x) for x in single[1:]) and all("Exchange" in plan(x) for x in plain[1:])
    # the same id with texts that agree in part, a whole repeat and a tenant that is null
    for docs in ([("t", "a", "One. Two."), ("t", "b", "One. One.")],
                 [("t", "a", "One. Two."), ("t", "a", "One. Six."), ("t", "b", "One."), ("t", "b", "One."), (None, "c", "X."), (None, "c", "X.")]):
        for got, whole in zip(*rows(docs), strict=True):
            assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*got.columns).collect()))


def test_an_upsert_moves_its_changes_alone(spark):
    from spanledger.sources.store import upsert

    form = "tenant_id string, row_id string, a string, b string"
    stored = spark.createDataFrame([("t", "1", "x", None), ("t", "2", "x", "y"), ("t", "2", "z", "y"), ("t", None, "n", "n")], form)
    news = spark.createDataFrame([("t", "1", None, "x"), ("t", "2", "x", "y"), ("t", "3", "w", None), ("t", "3", "w", None), ("t", None, "n", "n")], form)
    got = upsert(stored, news, ["tenant_id", "row_id"], ["a", "b"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("t", "1", None, "x"), ("t", "2", "x", "y"), ("t", "2", "x", "y"), ("t", None, "n", "n"), ("t", None, "n", "n"), ("t", "3", "w", None)], key=str)
    same = upsert(stored.where("row_id = '1'"), stored.where("row_id = '1'"), ["tenant_id", "row_id"], ["a", "b"])
    text = same._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in same.collect()] == [("t", "1", "x", None)] and text.count("Aggregate") == 0


def test_capped_views_read_the_links_they_found_once(chain, capsys):
    e, d = chain
    view = graph.capped_search(scoped(e, "t"), scoped(d, "t"), "alpha", 3)
    capsys.readouterr()
    view.explain()
    assert "min(struct(hop" not in capsys.readouterr().out
    assert not any(r.truncated for r in view.collect())


def test_shipments_are_dealt_by_their_rows(spark, tmp_path, monkeypatch, capsys):
    at = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    key = F.when(F.col("id") % 7 > 0, F.col("id") % 50)
    spark.range(400).select(key.alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(1.0).alias("l_quantity"), at.alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), at.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    whole = rows(dt.shipments(spark, str(tmp_path)), "l_orderkey", "l_partkey", "o_custkey")
    monkeypatch.setattr(dt, "SHARE", 10)
    dealt = dt.shipments(spark, str(tmp_path))
    capsys.readouterr()
    dealt.explain()
    assert "hashpartitioning(l_orderkey" in (told := capsys.readouterr().out) and "REPARTITION_BY_NUM" in told
    assert rows(dealt, "l_orderkey", "l_partkey", "o_custkey") == whole and whole
