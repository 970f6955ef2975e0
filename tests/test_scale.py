"""What moves: rows travel without what nobody asked for, keys and ids in few bytes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from spanledger.functions import text
from spanledger.operators import graph, interval_join, similar
from spanledger.session import cut_lineage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


MENTION = "tenant_id string, chunk_id string, name string, start_offset int, end_offset int, entity_id string, seq int, quote string"
EDGE = "tenant_id string, edge_id string, source_entity_id string, target_entity_id string, edge_type string, chunk_id string, start_offset int, end_offset int, seq int, quote string"


def test_repeated_mentions_move_without_their_quotes(spark):
    told = [("t", "c", "N", 0, 5, "b", 1, "q"), ("t", "c", "N", 0, 5, "a", 1, "r"), ("t", "c", "N", 0, 5, "a", 1, "q"), ("t", None, "N", 0, 5, "n2", 2, "q"),
            ("t", None, "N", 0, 5, "n1", 1, "q"), ("t", "c", None, 0, 5, "m", 1, "q"), ("t", "c", "N", 0, 5, "z", None, "q"), ("t", "d", "N", 0, 5, "a", 3, "q")]
    links = [("t", "x2", "a", "n2", "r", "c", 0, 5, 1, "q"), ("t", "x1", "b", "n1", "r", "c", 0, 5, 1, "q"), ("t", "x1", "b", "n1", "r", "c", 0, 5, 1, "p"), ("t", "y", None, "gone", "r", "c", 0, 5, 1, "q")]
    survivors, id_map, edges = graph.dedupe_mentions(spark.createDataFrame(told, MENTION), spark.createDataFrame(links, EDGE))
    # a missing sequence number comes first, the smaller id among equal ones, the smaller row among equal ids
    assert sorted(r.entity_id for r in survivors.collect()) == ["a", "m", "n1", "z"]
    assert {tuple(r)[1:] for r in id_map.collect()} >= {("b", "z"), ("n2", "n1"), ("m", "m")}
    assert sorted((r.edge_id, r.source_entity_id or "", r.target_entity_id, r.quote) for r in edges.collect()) == [("x1", "z", "n1", "p"), ("y", "", "gone", "q")]
    once = cut_lineage(spark.createDataFrame([t for t in told if t[5] != "a"], MENTION))
    survivors, _, _ = graph.dedupe_mentions(once, spark.createDataFrame(links, EDGE))
    assert "quote" not in plan(survivors.select("entity_id"))
    ties, _, _ = graph.dedupe_mentions(spark.createDataFrame([told[1], told[2]], MENTION), spark.createDataFrame(links, EDGE))
    assert [(r.entity_id, r.quote) for r in ties.collect()] == [("a", "q")]


def test_upserted_keys_are_told_by_signatures(spark):
    columns = EDGE + ", weight double, valid_from timestamp_ntz, valid_to timestamp_ntz"
    old = [("t", "x", "a", "b", "r", "c", 0, 5, 1, "q", 1.0, None, None), ("t", "n", "a", "b", None, "c", 0, 5, 1, "q", 1.0, None, None)]
    new = [("t", "y", "a", "b", "r", "c", 0, 5, 1, "q", 2.0, None, None), ("t", "m", "a", "b", None, "c", 0, 5, 1, "q", 3.0, None, None)]
    after = graph.upsert_edges(spark.createDataFrame(old, columns), spark.createDataFrame(new, columns))
    assert sorted((r.edge_id, r.weight) for r in after.collect()) == [("m", 3.0), ("n", 1.0), ("x", 2.0)]
    assert not any("hashpartitioning" in line and "chunk_id" in line for line in plan(after).splitlines())


def test_far_vectors_are_compared_in_tiles_not_in_bands(spark, monkeypatch):
    made = []
    rows = [(i, [float((i * 7 + k * k) % 11 - 5) for k in range(8)]) for i in range(700)]
    given = spark.createDataFrame(rows, "id long, embedding array<double>")
    signed = similar._signed
    monkeypatch.setattr(similar, "_signed", lambda bits, number: made.append(number) or signed(bits, number))
    want = {(r.id_a, r.id_b) for r in similar.similar_pairs(given, 0.3, miss=1e-9).collect()}
    assert made == [1]
    tiled = [(r.id_a, r.id_b) for r in similar.similar_pairs(given, 0.3, miss=1e-9, tile=3).collect()]
    assert len(tiled) == len(want) and set(tiled) == want
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows}
    first = {}
    for i, v in rows:
        first.setdefault(tuple(v), i)
    distinct = sorted(first.values())
    brute = {(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1:] if sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) > 0.3}
    assert brute == {(a, b) for a, b in want if a in distinct and b in distinct}


def test_only_foreign_parts_of_a_text_go_to_python(spark, monkeypatch):
    texts = ["plain", "", None, "① áȩ́x \r\n각 ﬁn\U0001d400é", "é", "x" * 5000 + "½", "́a\n̈́\r"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(rows.select("i", text.normalize_for_provenance(F.col("t"))).collect())
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ") for i, t in enumerate(texts)}
    assert "_nfkc(t#" not in plan(rows.select(text.normalize_for_provenance(F.col("t")))) and "array<string>" in str(text._nfkc.returnType.simpleString())


def test_points_look_into_levels_that_hold_intervals(spark):
    points = spark.createDataFrame([("k", i) for i in range(0, 4000, 7)], "k string, p long")
    spans = spark.createDataFrame([("k", s, s + 5) for s in range(0, 4000, 50)], "k string, s long, e long")
    met = interval_join.points_in_intervals(points, spans, ["k"], F.col("p"), F.col("s"), F.col("e"))
    assert sorted((r.p, r.s) for r in met.collect()) == sorted((p, s) for p in range(0, 4000, 7) for s in range(0, 4000, 50) if s <= p < s + 5)
    looked = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "inline(" in line]
    assert looked and all(line.count("__bucket") <= 3 for line in looked)
    none = interval_join.points_in_intervals(points, spans.limit(0), ["k"], F.col("p"), F.col("s"), F.col("e"))
    assert none.count() == 0


def test_settled_texts_are_in_nfkc_and_stay_out_of_python(spark):
    marks = [chr(c) for c in range(0x80, 0x3000)] + ["가", "각", "\U0001d400", "ﬁ"]
    rows = spark.createDataFrame([(i, f"a{m}b {m}") for i, m in enumerate(marks)], "i int, t string")
    settled = [r.t for r in rows.where(~F.col("t").rlike(text.UNSETTLED)).collect()]
    assert all(unicodedata.normalize("NFKC", t) == t for t in settled) and {"aéb é", "aßb ß", "aжb ж", "a–b –"} <= set(settled)
    got = dict(rows.select("i", text.normalize_for_provenance(F.col("t"))).collect())
    assert got == {i: unicodedata.normalize("NFKC", f"a{m}b {m}").replace(" ", " ") for i, m in enumerate(marks)}


def test_sentences_are_the_same_without_a_fold(spark):
    texts = ["One. Two!  Three?", "", None, "   ", "...", " . a. .b", "é. ü! " * 700, "x" * 3000, "a.b.c" * 90, "  lead. trail  "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    want = rows.select("i", F.inline(text.sentence_spans(F.col("text"))))
    got = text.sentence_rows(rows, "i")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and "aggregate" not in plan(got)


def test_ids_of_written_assertions_are_not_worked_out_again(spark, tmp_path):
    from spanledger.sources import driver_tables as dt

    told = [(1, "Hi there. You.", "en", "src0"), (1, "Hi there. You.", "en", "src0"), (2, None, "de", "src1"), (3, "Hi there.\nGut.", None, "src0")]
    spark.createDataFrame(told, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lazy, held = (dt.provenance(spark, str(tmp_path), stored=True, **more) for more in ({}, {"proven": True}))
    assert "sha1" in plan(lazy["assertions"]) and "sha1" not in plan(held["assertions"])
    assert sorted(map(str, lazy["assertions"].collect())) == sorted(map(str, held["assertions"].collect()))


def test_what_an_ingest_upserts_is_written_once(spark, tmp_path, monkeypatch):
    from spanledger.catalog import jobs

    told = [(1, "Hi there. You.", "en", "src0"), (3, "Hi there.\nGut.", "de", "src1")]
    spark.createDataFrame(told, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, upsert = [], jobs.upsert
    monkeypatch.setattr(jobs, "upsert", lambda stored, incoming, *more: plans.append(plan(incoming)) or upsert(stored, incoming, *more))
    sizes = {(r.table_name, r.tenant_id): (r.n_rows, r.n_ids) for r in jobs.job_ingest(spark, str(tmp_path)).collect()}
    assert len(plans) == 6 and not any("sha1" in p or "Exchange" in p for p in plans)
    assert sizes["facts", "src0"] == (2, 2) and sizes["assertions", "src1"] == (2, 2)
