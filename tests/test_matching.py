"""Similar vectors, interval joins, walks, blocking, qualities, triples, registry and archive against plain readings."""

from __future__ import annotations

import collections
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.operators import blocking, interval_join, ontology, quality, registry, similar, temporal, walk
from spanledger.session import cut_lineage
from spanledger.sources import archive


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


# vectors


@pytest.fixture(scope="module")
def vectors():
    """Clusters, copies, and vectors that are similar to nothing."""
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.standard_normal((12, 24))
    out = [(i, (centres[i % 12] + 0.35 * rng.standard_normal(24)).round(6).tolist()) for i in range(240)]
    out += [(1000 + i, out[7][1]) for i in range(40)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0, None]), (2004, [float("nan")] * 24), (2005, [1.0, 0.0]), (2006, [2.0, 0.0]), (None, out[7][1]), (1001, out[7][1])]
    return out + odd


@pytest.mark.parametrize("tile, bucket", [(512, 64), (5, 200), (16, 8)])
def test_similar_pairs(spark, vectors, tile, bucket):
    given = spark.createDataFrame([(i, v, 7) for i, v in vectors], "id long, embedding array<double>, similarity int")
    got = similar.similar_pairs(given, 0.8, miss=1e-6, bucket=bucket, tile=tile).collect()
    first: dict[tuple, int] = {}
    want = {}
    usable = [(i, v) for i, v in vectors if i is not None and v and None not in v and not any(map(math.isnan, v)) and any(v)]
    for i, v in sorted(usable, key=lambda x: x[0]):
        first.setdefault(tuple(v), i)
        if first[tuple(v)] != i:
            want[first[tuple(v)], i] = 1.0
    for (v, i), (w, j) in itertools.combinations(first.items(), 2):
        if len(v) == len(w):
            c = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
            if c > 0.8:
                want[min(i, j), max(i, j)] = c
    assert {(r.id_a, r.id_b): round(r.similarity, 9) for r in got} == {k: round(c, 9) for k, c in want.items()} and len(got) == len(want) > 200


def test_bands_keep_their_promise():
    for count, threshold, miss in ((500, 0.3, 1e-9), (10**6, 0.85, 0.01), (10**9, 0.9, 0.001)):
        bits, number = similar.bands(count, threshold, miss)
        agree = (1 - math.acos(threshold) / math.pi) ** bits
        assert (1 - agree) ** number <= miss * 1.0001 and count / 2**bits <= similar.BUCKET


def test_no_vectors(spark):
    assert similar.similar_pairs(spark.createDataFrame([], "id long, embedding array<float>"), 0.8).count() == 0


# intervals


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scale", [1, 10**9])
def test_points_in_intervals(spark, scale):
    rng = random.Random(scale)
    points = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(-50, 1000) * scale])) for i in range(300)]
    spans = []
    for i in range(300):
        a = rng.randrange(-100, 1100)
        spans.append((rng.choice("abc"), i, rng.choice([None, a * scale, a * scale, a * scale]), rng.choice([None, (a + rng.choice([0, 1, 3, 50, 900])) * scale])))
    spans.append((None, 999, 0, None))
    p, s = spark.createDataFrame(points, "k string, p int, at long"), spark.createDataFrame(spans, "k string, s int, a long, e long")
    got = interval_join.points_in_intervals(p, s, ["k"], F.col("at"), F.col("a"), F.col("e"))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    want = sorted(((x, y) for k, x, t in points for m, y, a, e in spans if k == m and None not in (t, a) and a <= t and (e is None or t < e)), key=repr)
    assert rows(got, "p", "s") == want and len(want) > 500
    assert interval_join.points_in_intervals(p.limit(0), s, ["k"], F.col("at"), F.col("a"), F.col("e")).count() == 0


def test_overlapping_spans(spark):
    rng = random.Random(8)
    made = [[(rng.choice("ab"), i, (a := rng.randrange(300)), a + rng.choice([0, 1, 5, 40, 250])) for i in range(150)] for _ in range(2)]
    left, right = (spark.createDataFrame(m, f"k string, {n} int, {n}s long, {n}e long") for m, n in zip(made, "lr", strict=True))
    got = interval_join.overlapping(left, right, ["k"], (F.col("ls"), F.col("le")), (F.col("rs"), F.col("re")))
    want = sorted(((i, j) for k, i, a, b in made[0] for m, j, c, d in made[1] if k == m and max(a, c) < min(b, d)), key=repr)
    assert rows(got, "l", "r") == want


def test_as_of_table_equals_one_by_one(spark):
    rng = random.Random(2)
    day = lambda d: None if d is None else f"2020-{1 + d // 28:02d}-{1 + d % 28:02d}"
    facts = [(i, "t", rng.choice("xyz"), day(a := rng.randrange(200)), day(rng.choice([None, min(300, a + rng.randrange(0, 90))])), day(b := rng.randrange(200)), day(rng.choice([None, b + 60]))) for i in range(120)]
    asked = [(100 + i, "t", rng.choice(["x", "y", None]), day(rng.choice([None, rng.randrange(300)])), day(rng.choice([None, rng.randrange(300)]))) for i in range(80)]
    f = spark.createDataFrame(facts, "fact_id int, tenant_id string, subject string, valid_from string, valid_to string, created_at string, expired_at string")
    f = f.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to", "created_at", "expired_at")}).withColumn("predicate", F.lit("p"))
    a = spark.createDataFrame(asked, "asked int, tenant_id string, subject string, valid_at string, system_at string")
    a = a.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_at", "system_at")})
    got = collections.defaultdict(list)
    for r in temporal.as_of_table(f, a).collect():
        got[r.asked].append(r.fact_id)
    for k, _, subject, valid, system in asked[:25]:
        want = [] if subject is None else [r.fact_id for r in temporal.as_of(f, valid, system, subject=subject).collect()]
        assert sorted(got[k]) == sorted(want)


# walks


@pytest.fixture(scope="module")
def graph_tables(spark):
    rng = random.Random(6)
    n = [("t", f"n{i}") for i in range(40)] + [("u", "n0"), ("u", "lonely")]
    e = [("t", f"e{i}", f"n{rng.randrange(30)}", f"n{rng.choice([0, rng.randrange(30)])}", rng.choice([None, 1.0, 2.5, 0.0])) for i in range(90)]
    e += [("t", "x", "n31", None, 1.0), ("t", "y", "n31", "gone", 1.0), ("u", "z", "n0", "n0", 1.0)]
    return spark.createDataFrame(n, "tenant_id string, entity_id string"), spark.createDataFrame(e, "tenant_id string, edge_id string, source_entity_id string, target_entity_id string, weight double"), n, e


def plain_links(e, directed=False):
    w = collections.defaultdict(float)
    for t, _, a, b, x in e:
        x = 1.0 if x is None else x
        if a and b and a != b and x > 0:
            w[t, a, b] += x
            if not directed:
                w[t, b, a] += x
    return w


@pytest.mark.parametrize("directed", [False, True])
def test_personal_ranks(spark, graph_tables, directed):
    _, edges, _, e = graph_tables
    seeds = [("one", "t", "n3"), ("two", "t", "n0"), ("two", "t", "n9"), ("two", "t", "n9"), ("far", "t", "n39"), ("two", "u", "n0"), ("two", "t", None)]
    got = walk.personal_ranks(edges, spark.createDataFrame(seeds, "seed_set string, tenant_id string, entity_id string"), rounds=7, directed=directed)
    w = plain_links(e, directed)
    total = collections.defaultdict(float)
    for (t, a, _), x in w.items():
        total[t, a] += x
    for s, t in {(s, t) for s, t, _ in seeds}:
        mine = sorted({n for q, u, n in seeds if (q, u) == (s, t) and n})
        rank = {n: 1 / len(mine) for n in mine}
        for _ in range(7):
            new = collections.defaultdict(float)
            stuck = sum(r for n, r in rank.items() if not total[t, n])
            for n in mine:
                new[n] += (0.15 + 0.85 * stuck) / len(mine)
            for (u, a, b), x in w.items():
                if u == t and a in rank:
                    new[b] += 0.85 * rank[a] * x / total[t, a]
            rank = new
        found = {r.entity_id: r.rank for r in got.where(f"seed_set = '{s}' and tenant_id = '{t}'").collect()}
        assert found.keys() == rank.keys() and all(math.isclose(found[n], rank[n], abs_tol=1e-12) for n in rank) and math.isclose(sum(found.values()), 1)


def test_ranks_stop_when_they_stand(spark, graph_tables):
    _, edges, _, _ = graph_tables
    seeds = spark.createDataFrame([("s", "t", "n3")], "seed_set string, tenant_id string, entity_id string")
    early = walk.personal_ranks(edges, seeds, rounds=200, tolerance=1e-3)
    late = walk.personal_ranks(edges, seeds, rounds=60)
    a, b = ({r.entity_id: r.rank for r in x.collect()} for x in (early, late))
    assert sum(abs(a.get(k, 0) - b[k]) for k in b) < 1e-2


@pytest.mark.parametrize("rounds", [0, 1, 2, 5, 8])
def test_communities(graph_tables, rounds):
    nodes, edges, n, e = graph_tables
    known = set(n)
    w = {k: x for k, x in plain_links(e).items() if (k[0], k[1]) in known and (k[0], k[2]) in known}
    label = {k: k[1] for k in known}
    for _ in range(rounds):
        votes = collections.defaultdict(lambda: collections.defaultdict(float))
        for (t, a, b), x in w.items():
            votes[t, a][label[t, b]] += x
        label = {k: min(votes[k], key=lambda c: (-votes[k][c], c)) if k in votes else c0 for k, c0 in label.items()}
    got = walk.communities(nodes, edges, rounds)
    assert {(r.tenant_id, r.entity_id): r.community for r in got.collect()} == label


def test_communities_that_swap(spark):
    """A star with equal weights swaps between two states: the last round's state is given without its rounds."""
    nodes = spark.createDataFrame([("t", c) for c in "ab"], "tenant_id string, entity_id string")
    edges = spark.createDataFrame([("t", "e", "a", "b")], "tenant_id string, edge_id string, source_entity_id string, target_entity_id string")
    for rounds, want in ((1000, {"a": "a", "b": "b"}), (1001, {"a": "b", "b": "a"})):
        assert {r.entity_id: r.community for r in walk.communities(nodes, edges, rounds).collect()} == want


# names


def plain_trigrams(n):
    p = f"  {n} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


@pytest.mark.parametrize("frequent", [0, 2, 1000])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75])
def test_trigram_pairs(spark, frequent, threshold):
    rng = random.Random(1)
    parts = ["acme", "acne", "north", "northern", "holding", "holdings", "inc", "co", "a", "ab", "ünï", "中文"]
    names = sorted({" ".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(120)})
    given = spark.createDataFrame([("t", i, n) for i, n in enumerate(names)] + [("u", 500, names[0])], "tenant_id string, id long, plain string")
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
        x, y = plain_trigrams(a), plain_trigrams(b)
        if len(x & y) / len(x | y) >= threshold:
            want[i, j] = len(x & y) / len(x | y)
    got = {(r.id_a, r.id_b): r.score for r in blocking.trigram_pairs(given, threshold, frequent).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want) and want


def test_blocks_are_stars(spark):
    given = [("t", 5, "Smith  Co"), ("t", 3, " smith co "), ("t", 9, "SMYTHE CO"), ("t", 1, "Zed"), ("t", 2, None), ("t", 4, "  "), ("t", 6, "中文"), ("u", 7, "smith co"), ("t", None, "Zed")]
    got = rows(blocking.candidates(spark.createDataFrame(given, "tenant_id string, id long, name string")).where("strategy <> 'trigram'"), "tenant_id", "strategy", "id_a", "id_b")
    assert got == [("t", "exact", 3, 5), ("t", "phonetic", 3, 9)]


# quality


def test_resolution_quality(spark):
    rng = random.Random(4)
    mine = [("t", f"m{i}", f"c{rng.randrange(12)}") for i in range(90)] + [("u", "m", "c")]
    gold = [("t", f"m{i}", f"g{rng.randrange(9)}") for i in range(10, 95)] + [("u", "m", "g")]
    got = {r.tenant_id: r for r in quality.resolution_quality(spark.createDataFrame(mine, "tenant_id string, mention_id string, cluster_id string"), spark.createDataFrame(gold, "tenant_id string, mention_id string, entity_id string")).collect()}
    c, g = ({m: x for t, m, x in table if t == "t"} for table in (mine, gold))
    both = sorted(c.keys() & g.keys())
    pairs = list(itertools.combinations(both, 2))
    made, true = sum(c[a] == c[b] for a, b in pairs), sum(g[a] == g[b] for a, b in pairs)
    same = sum(c[a] == c[b] and g[a] == g[b] for a, b in pairs)
    r = got["t"]
    assert (r.true_pairs, r.made_pairs, r.gold_pairs, r.mentions) == (same, made, true, len(both))
    cubed = [sum(c[b] == c[a] and g[b] == g[a] for b in both) / sum(c[b] == c[a] for b in both) for a in both]
    assert math.isclose(r.b_cubed_precision, sum(cubed) / len(both)) and math.isclose(r.precision, same / made)
    assert r.over_merged == sum(len({g[m] for m in both if c[m] == k}) > 1 for k in set(c.values()))
    assert (got["u"].precision, got["u"].recall, got["u"].over_merge_rate) == (1.0, 1.0, 0.0)


def test_agreement_and_disagreements(spark):
    told = [("d", "q", "a", "a1", "yes", 0, 10), ("d", "q", "b", "b1", "yes", 5, 20), ("d", "q", "a", "a2", "no", 30, 40), ("d", "q", "b", "b2", "yes", 35, 36),
            ("d", "q", "a", "a3", "yes", 50, 60), ("d", "q", "b", "b3", None, 60, 70), ("d", "q", "c", "c1", "yes", 0, 99), ("e", "q", "b", "b4", "yes", 0, 10), ("d", "r", "a", "a5", "x", None, None)]
    summary, listed = quality.agreement(spark.createDataFrame(told, "document_id string, question_id string, labeller string, answer_id string, value string, start_offset int, end_offset int"), "a", "b")
    assert rows(listed, "answer_id", "reason") == [("a2", "other_value"), ("a3", "no_overlap"), ("a5", "no_overlap"), ("b2", "other_value"), ("b3", "no_overlap"), ("b4", "no_overlap")]
    by = {r.question_id: r for r in summary.collect()}
    assert (by["q"].answers, by["q"].matching, by["q"].pairs) == (7, 2, 2) and math.isclose(by["q"].span_agreement, 4 / 7) and by["q"].kappa == 0.0
    assert (by["r"].answers, by["r"].agreement, by["r"].pairs, by["r"].kappa) == (1, 0.0, 0, None)


# triples


def test_legal_triples(spark):
    nodes = spark.createDataFrame([("t", k, v) for k, v in (("c", "Company"), ("b", "Bank"), ("k", "Contract"), ("a", "Amendment"), ("p", "Person"), ("n", None))], "tenant_id string, entity_id string, entity_type string")
    signatures = spark.createDataFrame([("PARTY", ["Company"], ["Contract"]), ("PARTY", ["Person"], ["Amendment"]), ("SIGNS", ["*"], ["Contract"])], "edge_type string, allowed_sources array<string>, allowed_targets array<string>")
    parents = spark.createDataFrame([("Bank", "Company"), ("Amendment", "Contract"), ("Contract", "Document"), ("Document", "Contract"), ("Company", None)], "type string, parent string")
    asked = {"ok": ("PARTY", "c", "k"), "inherits": ("PARTY", "b", "a"), "combination": ("PARTY", "p", "k"), "second": ("PARTY", "p", "a"), "source_type": ("PARTY", "k", "k"), "target_type": ("PARTY", "c", "p"),
             "any": ("SIGNS", "n", "k"), "unknown_edge_type": ("X", "c", "k"), "no_source": ("PARTY", "zz", "k"), "no_target": ("PARTY", "c", "zz"), "nothing": (None, "c", "k")}
    edges = spark.createDataFrame([("t", k, *v) for k, v in asked.items()], "tenant_id string, edge_id string, edge_type string, source_entity_id string, target_entity_id string")
    got = {r.edge_id: r.reason for r in ontology.judged_triples(edges, nodes, signatures, parents).collect()}
    assert got == {k: {"ok": None, "inherits": None, "second": None, "any": "no_source", "nothing": "unknown_edge_type"}.get(k, k) for k in asked}
    assert {(r.type, r.ancestor) for r in ontology.ancestors(parents).collect() if r.type == "Amendment"} == {("Amendment", x) for x in ("Amendment", "Contract", "Document")}


# registry


def test_registry_tiers(spark):
    entries = [("R1", "Acme Widgets, Inc.", ["The Widget People"], True), ("R2", "Bolt & Nut LLC", [], True), ("R3", "Nut and Bolt LLC", None, True), ("R4", "Gone Ltd", [], False), ("R5", None, ["x"], True)]
    names = ["Acme Widgets, Inc."] * 3 + ["ACME WIDGETS", "the widget people", "widgets acme", "Gone Ltd", "who?", None, " ", "Bolt Nut & LLC"]
    got = {r.name: (r.mentions, r.tier, r.registry_id, r.bucket) for r in registry.registry_buckets(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(entries, "registry_id string, legal_name string, aliases array<string>, active boolean")).collect()}
    assert got["Acme Widgets, Inc."] == (3, "exact", "R1", "exact") and got["ACME WIDGETS"][1:] == ("normalised", "R1", "exact")
    assert got["the widget people"][1:] == ("alias", "R1", "candidate") and got["widgets acme"][1:] == ("token_set", "R1", "candidate")
    assert got["Gone Ltd"][1:] == ("exact", "R4", "lapsed") and {got[n][3] for n in ("who?", None, " ")} == {"unresolved"}
    assert sum(m for m, *_ in got.values()) == len(names) and len(got) == len(set(names))


# archive


def test_snapshots_compare_by_ranges(spark, tmp_path):
    one, two, same = (str(tmp_path / n) for n in ("one", "two", "same"))
    table = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("text"))
    archive.write(table, ["id"], one)
    archive.write(table.repartition(7).select("text", "id"), ["id"], same)
    archive.write(table.where("id <> 11").withColumn("text", F.when(F.col("id") == 10, "new").otherwise(F.col("text"))).union(spark.createDataFrame([(5000, None)], table.schema)), ["id"], two)
    assert archive.root(spark, one) == archive.root(spark, same) != archive.root(spark, two)
    assert archive.differing_ranges(spark, one, same) == [] and archive.changes(spark, one, same).count() == 0
    ranges = archive.differing_ranges(spark, one, two)
    assert 1 <= len(ranges) <= 3
    got = {json.loads(r.item_id)["id"]: r.change for r in archive.changes(spark, one, two).collect()}
    assert got == {"10": "changed", "11": "removed", "5000": "added"}
    read = archive.read(spark, one, ranges)
    folders = {r.f.split("/range=")[1][:2] for r in read.select(F.input_file_name().alias("f")).collect()}
    assert folders <= set(ranges) and "PartitionFilters: [" in plan(read) and read.count() < 100


def test_empty_archive(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    table = spark.range(3)
    archive.write(table.limit(0), ["id"], a)
    archive.write(table, ["id"], b)
    assert archive.root(spark, a) is None and {r.change for r in archive.changes(spark, a, b).collect()} == {"added"}


# what moves


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_triples_look_edges_up_once(spark, capsys):
    nodes = spark.createDataFrame([("t", "c", "Company"), ("t", "k", "Contract")], "tenant_id string, entity_id string, entity_type string")
    signatures = spark.createDataFrame([("PARTY", ["Company"], ["Contract"])], "edge_type string, allowed_sources array<string>, allowed_targets array<string>")
    parents = spark.createDataFrame([("Bank", "Company")], "type string, parent string")
    edges = cut_lineage(spark.createDataFrame([("t", "e", "PARTY", "c", "k")], "tenant_id string, edge_id string, edge_type string, source_entity_id string, target_entity_id string"))
    told = ontology.judged_triples(edges, nodes, signatures, parents)
    scans = [x for x in plan_of(told, capsys).splitlines() if "FileScan" in x and "source_entity_id" in x]
    assert len(scans) == 1 and rows(told, "edge_id", "reason") == [("e", None)]


def test_links_add_each_pair_up_once(spark, capsys):
    edges = spark.createDataFrame([("t", "a", "b", 2.0), ("t", "b", "a", 3.0), ("t", "a", "a", 1.0), ("t", None, "a", 1.0)], "tenant_id string, source_entity_id string, target_entity_id string, weight double")
    got = walk.links(edges)
    assert "Union" not in plan_of(got, capsys) and rows(got, "a", "b", "weight") == [("a", "b", 5.0), ("b", "a", 5.0)]


def test_smaller_names_send_fewer_keys(spark):
    name = [("t", 1, [(k, f"g{k:02d}", k + 1) for k in range(12)], 12, 0, 0)]
    ordered = spark.createDataFrame(name, "tenant_id string, num long, g array<struct<n: int, gram: string, at: int>>, size int, bits0 long, bits1 long")
    assert [blocking._keyed(ordered, share, 100).count() for share in (2 / 3, 1 / 2)] == [5, 7]
    bits = spark.createDataFrame([([(1, g) for g in trigrams],) for trigrams in ("abc", "abd", "xyzw")], "g array<struct<n: int, gram: string>>").select(*(blocking._bits("g", h).alias(f"b{h}") for h in range(2))).collect()
    apart = lambda x, y: sum(bin((x[h] ^ y[h]) & (2**64 - 1)).count("1") for h in range(2))
    assert 0 < apart(bits[0], bits[1]) <= 2 and 0 < apart(bits[0], bits[2]) <= 7


def test_answers_are_judged_alike_in_place_and_by_their_places(spark, monkeypatch):
    """Each answer moves once to those of its question; a crowded question takes the other way."""
    rng, rows = random.Random(5), []
    for i in range(400):
        start = rng.choice([None, *range(0, 60)])
        end = None if start is None or rng.random() < 0.05 else start + rng.randrange(0, 30)
        rows.append((rng.choice(["d", "e", "f", None]), rng.choice(["q", "r", None]), rng.choice("aabbc"), rng.choice([None, *map(str, range(90))]), rng.choice(["x", "y", None]), start, end))
    rows += rows[:40]
    answers = cut_lineage(spark.createDataFrame(rows, "document_id string, question_id string, labeller string, answer_id string, value string, start_offset int, end_offset int"))
    got = []
    for met in (0, 10**9, 40):
        monkeypatch.setattr(quality, "MET", met)
        got.append([sorted(map(str, part.collect())) for part in quality.agreement(answers, "a", "b")])
    assert got[0] == got[1] == got[2]
    slow = [sorted(map(str, part.collect())) for part in quality.agreement(answers, "a", "b", quality.answer_pairs(answers, "a", "b"))]
    assert got[0] == slow
    monkeypatch.setattr(quality, "MET", 10**9)
    summary, listed = quality.agreement(answers, "a", "b")
    for part in (summary, listed):  # the plan of the pairs had 14 sort-merge joins
        assert part._jdf.queryExecution().executedPlan().toString().count("Generate") == 0
