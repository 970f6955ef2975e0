"""Blocking, resolution quality, labeller agreement, legal triples, registry buckets and archived snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanledger.catalog import query
from spanledger.catalog.twins import with_parts
from spanledger.functions.text import words
from spanledger.operators import blocking, ontology, quality, registry, resolution
from spanledger.session import cut_lineage, work_dir
from spanledger.sources import archive
from spanledger.sources import driver_tables as dt
from spanledger.sources.dimensions import values_frame

# letters of a name by their sound, as the operator has them, one run of equal digits at a time
_SOUND = f"translate(w[2:], '{blocking.CONSONANTS}', '{blocking.SOUNDS}')"
for _digit in "123456":
    _SOUND = f"regexp_replace({_SOUND}, '{_digit}+', '{_digit}', 'g')"


@query("opt_blocking", with_parts(f"""
    , told AS (SELECT tenant_id, mention_id AS id, lower(trim(name)) AS plain FROM mentions)
    , units AS MATERIALIZED (SELECT tenant_id, plain, min(id) AS id, list_distinct(list_transform(range(1, length(plain) + 2), lambda i: substr('  ' || plain || ' ', i, 3))) AS g FROM told GROUP BY tenant_id, plain)
    , voiced AS (SELECT tenant_id, id, array_to_string(list_transform(list_filter(regexp_split_to_array(plain, '[^a-z]+'), lambda w: w <> ''), lambda w: w[1] || {_SOUND}), ' ') AS sound FROM units)
    , grams AS (SELECT tenant_id, id, len(g) AS n, unnest(g) AS gram FROM units)
    , met AS (SELECT a.tenant_id, a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS shared FROM grams a JOIN grams b ON a.tenant_id = b.tenant_id AND a.gram = b.gram AND a.id < b.id GROUP BY ALL)
    SELECT t.tenant_id, 'exact' AS strategy, u.id AS id_a, t.id AS id_b, 1.0::DOUBLE AS score FROM told t JOIN units u ON u.tenant_id = t.tenant_id AND u.plain = t.plain WHERE u.id <> t.id
    UNION ALL SELECT * FROM (SELECT tenant_id, 'phonetic', min(id) OVER (PARTITION BY tenant_id, sound) AS id_a, id AS id_b, 1.0 FROM voiced WHERE sound <> '') WHERE id_a <> id_b
    UNION ALL SELECT tenant_id, 'trigram', id_a, id_b, shared / (na + nb - shared)::DOUBLE FROM met WHERE shared / (na + nb - shared)::DOUBLE >= {blocking.SIMILAR}""", "mentions"))
def opt_blocking(spark, sf):
    chunks = dt.chunks(spark, sf).where(F.size(words(F.col("text"))) > 0)
    name = F.concat_ws(" ", F.slice(words(F.col("text")), 1, 2))
    named = chunks.select("tenant_id", dt.url_uuid5("mention", F.col("chunk_id")).alias("id"), name.alias("name"))
    return blocking.candidates(named, frequent=100)


@query("opt_resolution_quality", with_parts("""
    , m AS MATERIALIZED (SELECT a.tenant_id, mention_id, cluster_id, p_name AS entity_id FROM active a JOIN part ON CAST(p_partkey AS VARCHAR) = mention_id)
    , pairs AS (SELECT a.tenant_id, count(*) FILTER (a.cluster_id = b.cluster_id AND a.entity_id = b.entity_id) AS same, count(*) FILTER (a.cluster_id = b.cluster_id) AS made,
        count(*) FILTER (a.entity_id = b.entity_id) AS gold FROM m a JOIN m b ON a.tenant_id = b.tenant_id AND a.mention_id < b.mention_id AND (a.cluster_id = b.cluster_id OR a.entity_id = b.entity_id) GROUP BY 1)
    , cells AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, cluster_id, entity_id) AS n, count(*) OVER (PARTITION BY tenant_id, cluster_id) AS c, count(*) OVER (PARTITION BY tenant_id, entity_id) AS e FROM m)
    , cubed AS (SELECT tenant_id, count(*) AS mentions, count(DISTINCT cluster_id) AS clusters, count(DISTINCT entity_id) AS entities, avg(n / c::DOUBLE) AS bp, avg(n / e::DOUBLE) AS br FROM cells GROUP BY 1)
    , over AS (SELECT tenant_id, count(*) AS over_merged FROM (SELECT tenant_id, cluster_id FROM m GROUP BY ALL HAVING count(DISTINCT entity_id) > 1) GROUP BY 1)
    , split AS (SELECT tenant_id, count(*) AS split FROM (SELECT tenant_id, entity_id FROM m GROUP BY ALL HAVING count(DISTINCT cluster_id) > 1) GROUP BY 1)
    SELECT tenant_id, mentions, clusters, entities, same AS true_pairs, made AS made_pairs, gold AS gold_pairs, round(same / made::DOUBLE, 9) AS precision, round(same / gold::DOUBLE, 9) AS recall,
      round(2.0::DOUBLE * same / (made + gold), 9) AS f1, over_merged, round(over_merged / clusters::DOUBLE, 9) AS over_merge_rate, split, round(bp, 9) AS b_cubed_precision, round(br, 9) AS b_cubed_recall
    FROM cubed JOIN pairs USING (tenant_id) JOIN over USING (tenant_id) JOIN split USING (tenant_id)""", "active"))
def opt_resolution_quality(spark, sf):
    active = resolution.active_memberships(dt.decision_log(spark, sf))
    gold = dt.part_mentions(spark, sf).select("tenant_id", "mention_id", F.col("name").alias("entity_id"))
    out = quality.resolution_quality(active, gold)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "over_merge_rate", "b_cubed_precision", "b_cubed_recall")})


def labelled(spark, sf):
    """Two labellers mark lines: the second one from the middle on and a little further, some lines not at all."""
    lines = dt.chunks(spark, sf).select("document_id", "chunk_index", F.col("text").alias("line"), F.length("text").alias("n"))
    start = (F.col("chunk_index") * 50).cast("long")
    n, value = F.col("n"), (F.col("n") % 4).cast("string")

    def answer(labeller, told, begin, end):
        answer_id = F.concat(F.lit(f"{labeller[0]}-"), "document_id", F.lit("-"), F.col("chunk_index").cast("string"))
        return F.struct(F.lit(labeller).alias("labeller"), answer_id.alias("answer_id"), told.alias("value"), begin.alias("start_offset"), end.alias("end_offset"))

    first = answer("ann", value, start, start + n)
    second = answer("ben", F.when(n % 7 == 0, F.lit("other")).otherwise(value), start + F.floor(n / 2), start + n + 20)
    told = F.when(n % 5 != 0, F.array(first, second)).otherwise(F.array(first))
    return lines.select("document_id", F.concat(F.lit("Q"), (F.col("chunk_index") % 3).cast("string")).alias("question_id"), F.inline(told))


_LABELLED = """
    , l AS (SELECT document_id, chunk_index, length(text) AS n, chunk_index * 50 AS s, 'Q' || (chunk_index % 3) AS question_id FROM chunks)
    , a AS (SELECT document_id, question_id, 'a-' || document_id || '-' || chunk_index AS id, CAST(n % 4 AS VARCHAR) AS v, s, s + n AS e FROM l)
    , b AS (SELECT document_id, question_id, 'b-' || document_id || '-' || chunk_index AS id, CASE WHEN n % 7 = 0 THEN 'other' ELSE CAST(n % 4 AS VARCHAR) END AS v, s + n // 2 AS s, s + n + 20 AS e FROM l WHERE n % 5 <> 0)
    , pairs AS MATERIALIZED (SELECT a.question_id, a.id AS ia, b.id AS ib, a.v AS va, b.v AS vb FROM a JOIN b ON a.document_id = b.document_id AND a.question_id = b.question_id AND a.s < b.e AND b.s < a.e)
    , told AS (SELECT question_id, 'ann' AS labeller, id, v FROM a UNION ALL SELECT question_id, 'ben', id, v FROM b)
    , best AS (SELECT id, max(same) AS same FROM (SELECT ia AS id, va = vb AS same FROM pairs UNION ALL SELECT ib, va = vb FROM pairs) GROUP BY 1)
    , judged AS (SELECT t.*, same FROM told t LEFT JOIN best USING (id))"""


@query("opt_label_agreement", with_parts(_LABELLED + """
    , counts AS (SELECT question_id, count(*) AS answers, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS matching, round(avg(CASE WHEN same THEN 1 ELSE 0 END), 9) AS agreement, round(avg(CASE WHEN same IS NULL THEN 0 ELSE 1 END), 9) AS span_agreement FROM judged GROUP BY 1)
    , sums AS (SELECT question_id, count(*) AS pairs, avg(CASE WHEN va = vb THEN 1.0::DOUBLE ELSE 0 END) AS po FROM pairs GROUP BY 1)
    , pe AS (SELECT x.question_id, sum(CAST(x.n AS DOUBLE) * y.n) AS e FROM (SELECT question_id, va, count(*) AS n FROM pairs GROUP BY ALL) x JOIN (SELECT question_id, vb, count(*) AS n FROM pairs GROUP BY ALL) y ON x.question_id = y.question_id AND va = vb GROUP BY 1)
    SELECT c.*, coalesce(pairs, 0) AS pairs, round(CASE WHEN coalesce(e, 0) / (pairs * pairs) < 1 THEN (po - coalesce(e, 0) / (pairs * pairs)) / (1 - coalesce(e, 0) / (pairs * pairs)) END, 9) AS kappa
    FROM counts c LEFT JOIN sums s ON s.question_id = c.question_id LEFT JOIN pe ON pe.question_id = c.question_id""", "chunks"))
def opt_label_agreement(spark, sf):
    summary, _ = quality.agreement(cut_lineage(labelled(spark, sf)), "ann", "ben")
    return summary.withColumns({c: F.round(c, 9) for c in ("agreement", "span_agreement", "kappa")})


@query("opt_label_disagreements", with_parts(_LABELLED + """
    SELECT id AS answer_id, labeller, question_id, v AS value, CASE WHEN same IS NULL THEN 'no_overlap' ELSE 'other_value' END AS reason FROM judged WHERE same IS NULL OR NOT same""", "chunks"))
def opt_label_disagreements(spark, sf):
    _, listed = quality.agreement(cut_lineage(labelled(spark, sf)), "ann", "ben")
    return listed.select("answer_id", "labeller", "question_id", "value", "reason")


@query("opt_span_grounding", with_parts("""
    , e AS (SELECT tenant_id, CASE WHEN lang = 'fr' THEN start_offset + 1 ELSE start_offset END AS s, end_offset, quote, lang, chunk_id FROM ents)
    SELECT e.tenant_id, count(*) AS items, CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS BIGINT) AS grounded, round(avg(CASE WHEN g THEN 1 ELSE 0 END), 9) AS grounding_rate,
      CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS conforming, round(avg(CASE WHEN o THEN 1 ELSE 0 END), 9) AS conformance_rate
    FROM (SELECT e.tenant_id, substr(c.text, s + 1, greatest(end_offset - s, 0)) = quote AS g, e.tenant_id = 'src1' OR e.lang IN ('en', 'fr') AS o FROM e JOIN chunks c USING (chunk_id)) e GROUP BY 1""", "ents", "chunks"))
def opt_span_grounding(spark, sf):
    p = dt.provenance(spark, sf)
    lang = dt.documents(spark, sf).select("tenant_id", "document_id", "lang")
    # the offsets of one language are one off
    off = F.when(F.col("lang") == "fr", F.col("start_offset") + 1).otherwise(F.col("start_offset"))
    items = p["entities"].join(lang, ["tenant_id", "document_id"]).select("tenant_id", "chunk_id", off.alias("start_offset"), "end_offset", "quote", F.upper("lang").alias("entity_type"))
    onto = dt.documents(spark, sf).select("tenant_id").distinct().withColumn(
        "entity_types", F.when(F.col("tenant_id") == "src1", F.array().cast("array<string>")).otherwise(F.array(F.lit("EN"), F.lit("FR"))))
    return quality.grounding_rates(items, p["chunks"], onto).withColumns({c: F.round(c, 9) for c in ("grounding_rate", "conformance_rate")})


# what the graph's triples may say; the last one is an alternative of the one before
SIGNATURES = (
    ("nation_in", ("nation",), ("region",)), ("customer_in", ("organisation",), ("place",)), ("supplier_in", ("organisation",), ("region",)),
    ("bought", ("customer",), ("*",)), ("lists", ("supplier",), ("part",)), ("lists", ("customer",), ("nation",)),
)
PARENTS = (("customer", "organisation"), ("supplier", "organisation"), ("nation", "place"), ("region", "place"), ("organisation", "agent"), ("place", "thing"))


@query("opt_edge_signature", with_parts("""
    , more AS (SELECT edge_id, edge_type, source_entity_id, target_entity_id FROM arcs
        UNION ALL SELECT 'swapped:' || edge_id, edge_type, target_entity_id, source_entity_id FROM arcs WHERE edge_type <> 'bought'
        UNION ALL SELECT 'lists:' || edge_id, 'lists', source_entity_id, target_entity_id FROM arcs
        UNION ALL SELECT 'lost:' || edge_id, edge_type, source_entity_id, 'gone' FROM arcs WHERE edge_type = 'nation_in'
        UNION ALL SELECT 'odd:' || edge_id, 'odd', source_entity_id, target_entity_id FROM arcs WHERE edge_type = 'supplier_in')
    , t AS (SELECT m.*, s.entity_type AS st, d.entity_type AS dt FROM more m LEFT JOIN nodes s ON s.entity_id = source_entity_id LEFT JOIN nodes d ON d.entity_id = target_entity_id)
    SELECT edge_id, CASE WHEN edge_type = 'odd' THEN 'unknown_edge_type' WHEN st IS NULL THEN 'no_source' WHEN dt IS NULL THEN 'no_target'
      WHEN edge_type = 'nation_in' THEN CASE WHEN st <> 'nation' THEN 'source_type' WHEN dt <> 'region' THEN 'target_type' END
      WHEN edge_type = 'customer_in' THEN CASE WHEN st NOT IN ('customer', 'supplier') THEN 'source_type' WHEN dt NOT IN ('nation', 'region') THEN 'target_type' END
      WHEN edge_type = 'supplier_in' THEN CASE WHEN st NOT IN ('customer', 'supplier') THEN 'source_type' WHEN dt <> 'region' THEN 'target_type' END
      WHEN edge_type = 'bought' THEN CASE WHEN st <> 'customer' THEN 'source_type' END
      ELSE CASE WHEN st NOT IN ('supplier', 'customer') THEN 'source_type' WHEN dt NOT IN ('part', 'nation') THEN 'target_type'
        WHEN NOT (st = 'supplier' AND dt = 'part' OR st = 'customer' AND dt = 'nation') THEN 'combination' END END AS reason FROM t""", "nodes", "arcs"))
def opt_edge_signature(spark, sf):
    nodes, arcs = dt.stored_graph(spark, sf, ["tenant_id", "edge_id", "edge_type", "source_entity_id", "target_entity_id"])

    def named(prefix, rows, **columns):
        return rows.withColumns({"edge_id": F.concat(F.lit(prefix), "edge_id"), **columns})

    kind = F.col("edge_type")
    more = (
        arcs.unionByName(named("swapped:", arcs.where(kind != "bought"), source_entity_id=F.col("target_entity_id"), target_entity_id=F.col("source_entity_id")))
        .unionByName(named("lists:", arcs, edge_type=F.lit("lists")))
        .unionByName(named("lost:", arcs.where(kind == "nation_in"), target_entity_id=F.lit("gone")))
        .unionByName(named("odd:", arcs.where(kind == "supplier_in"), edge_type=F.lit("odd")))
    )
    signatures = values_frame(spark, "edge_type string, allowed_sources array<string>, allowed_targets array<string>", SIGNATURES)
    parents = values_frame(spark, "type string, parent string", PARENTS)
    return ontology.judged_triples(more, nodes, signatures, parents).select("edge_id", "reason")


@query("opt_registry_buckets", """
    WITH kinds AS (SELECT DISTINCT p_name AS k FROM part)
    , registry AS (SELECT 'R-' || k AS id, k, string_split(k, ' ')[2] AS noun, substr(k, 1, 1) <> 'b' AS active FROM kinds WHERE substr(k, 1, 1) <> 'g')
    , named AS (SELECT p_name AS k, p_size % 6 AS f, CASE p_size % 6 WHEN 0 THEN p_name || ' Holdings Inc.' WHEN 1 THEN upper(p_name) || ' HOLDINGS, INC' WHEN 2 THEN 'Old ' || p_name
        WHEN 3 THEN string_split(p_name, ' ')[2] || ' Holdings ' || string_split(p_name, ' ')[1] WHEN 4 THEN 'Works of ' || string_split(p_name, ' ')[2] ELSE 'Nobody ' || p_partkey END AS name FROM part)
    , told AS (SELECT name, any_value(k) AS k, any_value(f) AS f, count(*) AS mentions FROM named GROUP BY name)
    , makers AS (SELECT noun, count(*) AS n, min(id) AS id, bool_or(active) AS active FROM registry GROUP BY noun)
    , hit AS (SELECT t.*, CASE WHEN f < 4 THEN r.id WHEN f = 4 THEN m.id END AS found, CASE WHEN f < 4 THEN 1 ELSE m.n END AS n, CASE WHEN f < 4 THEN r.active ELSE m.active END AS active
        FROM told t LEFT JOIN registry r ON r.k = t.k LEFT JOIN makers m ON m.noun = string_split(t.k, ' ')[2] AND f = 4)
    SELECT name, mentions, CASE WHEN found IS NOT NULL THEN CASE f WHEN 0 THEN 'exact' WHEN 1 THEN 'normalised' WHEN 2 THEN 'alias' WHEN 3 THEN 'token_set' ELSE 'alias' END END AS tier,
      CASE WHEN n = 1 THEN found END AS registry_id,
      CASE WHEN found IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' WHEN NOT active THEN 'lapsed' WHEN f < 2 THEN 'exact' ELSE 'candidate' END AS bucket FROM hit""")
def opt_registry_buckets(spark, sf):
    part = dt.table(spark, sf, "part")
    kind, noun = F.col("p_name"), F.split("p_name", " ").getItem(1)
    form = F.col("p_size") % 6
    name = (
        F.when(form == 0, F.concat(kind, F.lit(" Holdings Inc."))).when(form == 1, F.concat(F.upper(kind), F.lit(" HOLDINGS, INC"))).when(form == 2, F.concat(F.lit("Old "), kind))
        .when(form == 3, F.concat(noun, F.lit(" Holdings "), F.split("p_name", " ").getItem(0))).when(form == 4, F.concat(F.lit("Works of "), noun)).otherwise(F.concat(F.lit("Nobody "), F.col("p_partkey").cast("string")))
    )
    first = F.substring(kind, 1, 1)
    entries = part.select("p_name").distinct().where(first != "g").select(
        F.concat(F.lit("R-"), kind).alias("registry_id"), F.concat(kind, F.lit(" Holdings Inc.")).alias("legal_name"),
        F.array(F.concat(F.lit("Old "), kind), F.concat(F.lit("Works of "), noun)).alias("aliases"), (first != "b").alias("active"))
    return registry.registry_buckets(part.select(name.alias("name")), entries)


FACT = ["fact_id", "subject", "predicate", "object", "valid_from"]
_ITEM = """'{"fact_id":"' || o_orderkey || '"}'"""
_CONTENT = """sha256('{{"fact_id":"' || o_orderkey || '","object":"' || {status} || '","predicate":"' || o_orderpriority || '","subject":"' || o_custkey || '","valid_from":"' || o_orderdate || '"}}')"""


@query("opt_export_snapshot", f"SELECT {_ITEM} AS item_id, {_CONTENT.format(status='o_orderstatus')} AS content_hash FROM orders")
def opt_export_snapshot(spark, sf):
    return archive.items(dt.order_facts(spark, sf).select(*FACT), ["fact_id"]).select("item_id", "content_hash")


@query("opt_snapshot_changes", f"""
    SELECT {_ITEM} AS item_id, CASE WHEN o_orderkey % 997 = 0 THEN 'changed' WHEN o_orderkey % 997 = 1 THEN 'removed' ELSE 'added' END AS change,
      CASE WHEN o_orderkey % 997 < 2 THEN {_CONTENT.format(status='o_orderstatus')} END AS old_hash,
      CASE WHEN o_orderkey % 997 = 0 THEN {_CONTENT.format(status="'X'")} WHEN o_orderkey % 997 = 2 THEN {_CONTENT.format(status='o_orderstatus')} END AS new_hash
    FROM orders WHERE o_orderkey % 997 <= 2""")
def opt_snapshot_changes(spark, sf):
    facts = dt.order_facts(spark, sf).select(*FACT)
    rest = F.col("fact_id") % 997
    paths = [f"{work_dir(spark)}/archive-{uuid.uuid4().hex}" for _ in range(2)]
    archive.write(facts.where(rest != 2), ["fact_id"], paths[0])
    archive.write(facts.where(rest != 1).withColumn("object", F.when(rest == 0, F.lit("X")).otherwise(F.col("object"))), ["fact_id"], paths[1])
    return archive.changes(spark, *paths)
