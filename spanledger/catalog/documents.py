"""Sources, sinks and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanledger.catalog import query
from spanledger.catalog.twins import with_parts
from spanledger.operators import audit, graph, ontology, provenance, usage
from spanledger.scope import scoped, split_foreign_writes
from spanledger.session import work_dir
from spanledger.sources import dimensions as dim
from spanledger.sources import documents as docs
from spanledger.sources import driver_tables as dt
from spanledger.sources import evaluation as ev
from spanledger.sources.store import SnapshotStore, upsert, write_csv, write_jsonl


def scratch(spark, name: str) -> str:
    """A new folder in the shared work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("src_documents", """SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS n_chars,
    sha256(chr(65533) || text) AS digest FROM documents""")
def src_documents(spark, sf):
    d = dt.spread_documents(spark, sf)
    # a stray byte in front of every text has to come out as U+FFFD
    raw = d.select("doc_id", F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8")).alias("content"))
    return docs.decoded(raw).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("digest")
    )


@query("src_labels_csv", with_parts("""
    SELECT contract, category, CAST(i AS BIGINT) AS position, a[i+1] AS answer FROM (
      SELECT contract, category, a, unnest(range(len(a))) AS i FROM (
        SELECT contract, 'Agreement Date' AS category, [CASE lang WHEN 'en' THEN strftime(day,'%B %-d, %Y')
          WHEN 'fr' THEN strftime(day,'%-dth day of %B, %Y') WHEN 'de' THEN strftime(day,'%-m/%-d/%y') ELSE strftime(day,'%Y-%m-%d') END] AS a FROM contracts
        UNION ALL SELECT contract, 'Governing Law', [source_name] FROM contracts WHERE lang <> 'es'
        UNION ALL SELECT contract, 'Exclusivity', CASE WHEN toxic = 1 THEN ['lang '||lang, 'src '||source] ELSE ['clause of '||source] END
          FROM contracts WHERE quality IS NOT NULL
        UNION ALL SELECT contract, 'Notice Period To Terminate Renewal', ['line one '||lang, 'line two'] FROM contracts))""", "contracts"))
def src_labels_csv(spark, sf):
    c = dt.contracts(spark, sf)
    day = dt.contract_date(F.col("n_chars"))
    labelled = F.col("quality").isNotNull()
    wide = c.select(
        F.concat(F.lit(" "), "contract").alias("Filename"),
        F.col("contract").alias("Document Name"),
        F.lit("seen on page one").alias("Agreement Date"),
        dt.spelled(day, F.col("lang")).alias("Agreement Date-Answer"),
        F.lit("nan").alias("Governing Law"),
        F.when(F.col("lang") == "es", F.lit("None")).otherwise(
            F.concat(F.lit("['"), F.initcap("source"), F.lit("']"))
        ).alias("Governing Law- Answer"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("lang "), "lang", F.lit('; "src '), "source", F.lit('";')))
        .otherwise(F.concat(F.lit("clause of "), "source")).alias("Exclusivity"),
        F.when(labelled, F.lit("Yes")).otherwise(F.lit(" no")).alias("Exclusivity-Answer"),
        F.concat(F.lit("line one "), "lang", F.lit("\n\n line two ")).alias(
            "Notice Period To Terminate Renewal- Answer"
        ),
    )
    path = scratch(spark, "labels")
    wide.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    names = ["Agreement Date", "Governing Law", "Exclusivity", "Notice Period To Terminate Renewal"]
    long = ev.labels_long(ev.read_label_table(spark, path), names)
    return long.select("contract", "category", F.posexplode("answers").alias("position", "answer")).withColumn(
        "position", F.col("position").cast("bigint")
    )


@query("src_predictions_jsonl", with_parts("""
    SELECT contract, 'Governing Law' AS category, CAST(0 AS BIGINT) AS position,
      CASE WHEN quality = 1 THEN source_name ELSE 'fallback '||lang END AS value, 'quote '||lang AS quote, quality = 1 AS found
    FROM contracts WHERE quality IS NOT NULL
    UNION ALL SELECT contract, 'Governing Law', 1, 'second', '', TRUE FROM contracts WHERE quality IS NOT NULL
    UNION ALL SELECT contract, 'Governing Law', 0, 'early', '', TRUE FROM contracts WHERE quality IS NULL""", "contracts"))
def src_predictions_jsonl(spark, sf):
    c = dt.contracts(spark, sf)
    def record(items, contract, filename):
        return F.to_json(F.struct(contract.alias("contract"), filename.alias("filename"), F.lit("h1").alias("prompt_hash"),
                                  F.create_map(F.lit("Governing Law"), items).alias("predictions")))
    def item(value, name, quote, found):
        return F.struct(value.alias("normalized_value"), name.alias("name"), quote.alias("verbatim_quote"),
                        found.alias("quote_found"))
    none = F.lit(None).cast("string")
    early = F.array(item(F.lit("early"), none, none, F.lit(None).cast("boolean")))
    good = F.col("quality") == 1
    late = F.array(
        item(F.when(good, F.initcap("source")).otherwise(F.lit("")), F.concat(F.lit("fallback "), "lang"),
             F.concat(F.lit(" quote "), "lang"), good),
        item(F.lit("second"), none, none, F.lit(None).cast("boolean")),
    )
    # one file per contract group: the early record stands above the late one
    both = c.select(
        F.concat_ws(
            "\n",
            record(early, F.col("contract"), none),
            F.lit(""),
            F.when(F.col("quality").isNotNull(), record(late, none, F.col("contract"))),
        ).alias("value")
    )
    path = scratch(spark, "predictions")
    both.write.text(path)
    long = ev.predictions_long(ev.read_predictions(spark, path))
    return long.select("contract", "category", F.posexplode("items").alias("position", "i")).select(
        "contract", "category", F.col("position").cast("bigint").alias("position"), "i.*"
    )


@query("src_resume_filter", with_parts("""
    SELECT contract, CASE WHEN quality IS NOT NULL AND lang = 'en' THEN 'reused' ELSE 'pending' END AS state FROM contracts""",
    "contracts"))
def src_resume_filter(spark, sf):
    c = dt.contracts(spark, sf)
    saved = c.where("quality IS NOT NULL").select("contract", F.concat(F.lit("prompt-"), "lang").alias("prompt_hash"))
    reused, pending = docs.pending_inputs(c.select("contract"), saved, "prompt-en")
    return reused.select("contract", F.lit("reused").alias("state")).unionByName(
        pending.select("contract", F.lit("pending").alias("state"))
    )


@query("src_file_text_join", """SELECT 'doc.'||d.doc_id AS stem, CAST(length(text) AS BIGINT) AS n_chars, quality
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def src_file_text_join(spark, sf):
    files = dt.spread_documents(spark, sf).select(
        F.concat(F.lit("/corpus/"), "source", F.lit("/doc."), F.col("doc_id").cast("string"), F.lit(" .txt")).alias("path"),
        "text",
    ).withColumn("stem", docs.file_stem(F.col("path")))
    notes = dt.table(spark, sf, "labels").select(
        F.concat(F.lit("doc."), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "quality"
    )
    return docs.match_files(files, notes).select(
        "stem", F.length("text").cast("bigint").alias("n_chars"), "quality"
    )


@query("src_manifest_verify", """SELECT 'd'||d.doc_id AS doc_id, d.doc_id||'.txt' AS filename,
      CASE WHEN l.toxic = 1 THEN 'hash_differs'
           WHEN d.lang = 'de' AND NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = 2*d.doc_id) THEN 'unknown_predecessor'
           ELSE 'ok' END AS status
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id""")
def src_manifest_verify(spark, sf):
    d = dt.spread_documents(spark, sf)
    files = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                     F.encode("text", "UTF-8").alias("content"))
    bad = dt.table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("bad", F.lit("!"))
    manifest = d.join(bad, "doc_id", "left").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.sha2(F.concat(F.col("text"), F.coalesce("bad", F.lit(""))), 256).alias("sha256"),
        F.when(F.col("lang") == "de", F.concat(F.lit("d"), (F.col("doc_id") * 2).cast("string"))).alias("amendment_of"),
    )
    return docs.manifest_report(manifest, files)


EXPORT_SQL = """strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(occurred_at) % 1000000 = 0 THEN ''
    ELSE '.' || lpad(CAST(epoch_us(occurred_at) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"""
PERIOD_SQL = "occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20'"


def _period(rows):
    return usage.in_period(rows, F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))


@query("sink_audit_jsonl", with_parts(f"""
    SELECT tenant_id, event_id, '{{"id":"'||id||'","tenant_id":"'||tenant_id||'","event_id":"'||event_id||'","event_type":"'||event_type
      ||'","action":"'||action||'","occurred_at":"'||({EXPORT_SQL})||'","recorded_at":"'||({EXPORT_SQL})||'","actor_id":"'||actor_id
      ||'","actor_type":"user","resource_type":null,"resource_id":null,"scope":null,"data_hash":null,"model":'
      ||coalesce('"'||model||'"','null')||',"model_version":'||coalesce('"'||model_version||'"','null')
      ||',"input_tokens":'||coalesce(CAST(input_tokens AS VARCHAR),'null')||',"output_tokens":'||coalesce(CAST(output_tokens AS VARCHAR),'null')
      ||',"cache_read_input_tokens":null,"cache_write_input_tokens":null,"metadata":'||metadata_json||'}}' AS line
    FROM audit WHERE tenant_id = 't3' AND {PERIOD_SQL}""", "audit"))
def sink_audit_jsonl(spark, sf):
    lines = audit.export_jsonl(_period(scoped(dt.audit_events(spark, sf), "t3")))
    path = scratch(spark, "audit-jsonl")
    write_jsonl(lines, path)
    back = spark.read.text(path)
    return back.select(
        F.get_json_object("value", "$.tenant_id").alias("tenant_id"),
        F.get_json_object("value", "$.event_id").alias("event_id"),
        F.col("value").alias("line"),
    )


@query("sink_audit_csv", with_parts(f"""
    SELECT id, tenant_id, event_id, event_type, action, ({EXPORT_SQL}) AS occurred_at, ({EXPORT_SQL}) AS recorded_at, actor_id,
      'user' AS actor_type, '' AS resource_type, '' AS resource_id, '' AS scope, '' AS data_hash, coalesce(model,'') AS model,
      coalesce(model_version,'') AS model_version, coalesce(CAST(input_tokens AS VARCHAR),'') AS input_tokens,
      coalesce(CAST(output_tokens AS VARCHAR),'') AS output_tokens, '' AS cache_read_input_tokens, '' AS cache_write_input_tokens,
      CASE WHEN action = 'view' THEN '' ELSE metadata_json END AS metadata
    FROM audit WHERE tenant_id = 't3' AND {PERIOD_SQL}""", "audit"))
def sink_audit_csv(spark, sf):
    events = dt.audit_events(spark, sf).withColumn("metadata_json", F.when(F.col("action") != "view", F.col("metadata_json")))
    rows = audit.export_csv(_period(scoped(events, "t3")))
    path = scratch(spark, "audit-csv")
    write_csv(rows, path)
    back = spark.read.option("header", "true").option("escape", "\\").csv(path)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in back.columns])


@query("sink_upsert_snapshot", with_parts("""
    SELECT d.tenant_id, d.document_id, d.lang, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'resolved' END AS status
    FROM docs d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id
    WHERE d.lang <> 'fr' OR l.doc_id IS NOT NULL""", "docs"))
def sink_upsert_snapshot(spark, sf):
    d = dt.documents(spark, sf)
    stored = d.where("lang <> 'fr'").select("tenant_id", "document_id", "lang", F.lit("pending").alias("status"))
    labelled = dt.table(spark, sf, "labels").select("doc_id").distinct()
    incoming = d.join(labelled, "doc_id", "left_semi").select(
        "tenant_id", "document_id", "lang", F.lit("resolved").alias("status")
    )
    store = SnapshotStore(spark, scratch(spark, "store"))
    store.write({"documents": stored})
    # saved twice: the second save changes nothing
    for _ in range(2):
        store.write({"documents": upsert(store.read("documents"), incoming, ["tenant_id", "document_id"], ["status"])})
    return store.read("documents").select("tenant_id", "document_id", "lang", "status")


# ---- filters -----------------------------------------------------------------


@query("flt_tenant_scope", with_parts("""
    SELECT 'scoped' AS part, tenant_id, doc_id FROM docs WHERE tenant_id = 'src3'
    UNION ALL SELECT 'refused_write', tenant_id, doc_id FROM docs WHERE tenant_id <> 'src3'""", "docs"))
def flt_tenant_scope(spark, sf):
    d = dt.documents(spark, sf).select("tenant_id", "doc_id")
    _, refused = split_foreign_writes(d, "src3")
    parts = {"scoped": scoped(d, "src3"), "unset": scoped(d, None), "refused_write": refused}
    out = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("part"), "tenant_id", "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("flt_name_ilike", with_parts("""
    SELECT 'ring' AS q, entity_id, name FROM nodes WHERE contains(lower(name), 'ring')
    UNION ALL SELECT '0_1', entity_id, name FROM nodes WHERE contains(name, '0_1')
    UNION ALL SELECT 'n_1', entity_id, name FROM nodes WHERE contains(lower(name), 'n_1')""", "nodes"))
def flt_name_ilike(spark, sf):
    e = dt.entities(spark, sf)
    out = None
    for q, text in (("ring", " RING "), ("0_1", "0_1"), ("n_1", "n_1"), ("%", "%")):
        part = graph.find_by_name(e, text).select(F.lit(q).alias("q"), "entity_id", "name")
        out = part if out is None else out.unionByName(part)
    return out


@query("flt_ontology_conform", with_parts("""
    SELECT chunk_id, upper(lang) AS entity_type FROM ents WHERE lang IN ('en','fr') AND token_ok AND tenant_id <> 'src1'
    UNION ALL SELECT chunk_id, upper(lang) FROM ents WHERE tenant_id = 'src1' AND token_ok""".replace("token_ok", "chunk_index > 0"), "ents"))
def flt_ontology_conform(spark, sf):
    p = dt.provenance(spark, sf)
    lang = dt.documents(spark, sf).select("tenant_id", "document_id", "lang")
    rows = p["entities"].join(lang, ["tenant_id", "document_id"]).select(
        "tenant_id", "chunk_id", F.upper("lang").alias("entity_type"), "quote",
        F.when(F.col("seq") > 0, F.col("name")).otherwise(F.lit("  ")).alias("name"),
    )
    # one tenant has an empty list, which allows everything
    onto = dt.documents(spark, sf).select("tenant_id").distinct().withColumn(
        "entity_types",
        F.when(F.col("tenant_id") == "src1", F.array().cast("array<string>")).otherwise(F.array(F.lit("EN"), F.lit("FR"))),
    )
    return ontology.conforming_entities(rows, onto).select("chunk_id", "entity_type")


@query("flt_provenance_valid", with_parts("""
    SELECT chunk_id, lang <> 'es' AND end_offset - token_count >= start_offset AND trim(CASE WHEN lang='de' AND token_count < 4 THEN ' ' ELSE quote END) <> '' AS valid
    FROM (SELECT e.*, c.token_count FROM ents e JOIN chunks c USING (chunk_id))""", "ents", "chunks"))
def flt_provenance_valid(spark, sf):
    tables = dt.provenance(spark, sf)
    lang = dt.documents(spark, sf).select("tenant_id", "document_id", "lang")
    size = tables["chunks"].select("tenant_id", "chunk_id", "token_count")
    rows = tables["entities"].join(lang, ["tenant_id", "document_id"]).join(size, ["tenant_id", "chunk_id"]).select(
        "chunk_id",
        F.when(F.col("lang") == "es", -1).otherwise(F.col("start_offset")).alias("start_offset"),
        (F.col("end_offset") - F.col("token_count")).alias("end_offset"),
        F.when((F.col("lang") == "de") & (F.col("token_count") < 4), F.lit(" ")).otherwise(F.col("quote")).alias("quote"),
    )
    return provenance.with_graph_validity(rows).select("chunk_id", "valid")


@query("flt_span_invariant", with_parts("""
    SELECT chunk_id, end_offset % 3 <> 0 AND lang <> 'es' AS valid FROM ents""", "ents"))
def flt_span_invariant(spark, sf):
    e = dt.provenance(spark, sf)["entities"]
    lang = dt.documents(spark, sf).select("tenant_id", "document_id", "lang")
    # some spans end one character late, those of one language start before the text
    late = F.col("end_offset") + (F.col("end_offset") % 3 == 0).cast("int")
    rows = e.join(lang, ["tenant_id", "document_id"]).withColumn("end_offset", late).withColumn(
        "start_offset", F.when(F.col("lang") == "es", F.lit(-1)).otherwise(F.col("start_offset"))
    )
    return provenance.with_span_validity(rows).select("chunk_id", "valid")


@query("flt_audit_valid", with_parts("""
    SELECT event_id, CASE WHEN event_type = 'llm_invocation' AND model_version IS NULL THEN 'model_missing' END AS reason FROM audit
    UNION ALL SELECT conv_id||'-'||turn, CASE WHEN role = 'system' OR length(text) > 500 THEN 'document_text' END FROM conversations""", "audit"))
def flt_audit_valid(spark, sf):
    cols = ["event_id", "event_type", "model", "model_version", "input_tokens", "output_tokens", "metadata_json"]
    rows = dt.audit_events(spark, sf).select(*cols).unionByName(dt.conversation_audit(spark, sf).select(*cols))
    return audit.judged(rows).select("event_id", "reason")


@query("flt_usage_valid", with_parts("""
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'historical_price_version' WHEN event_type = 'signup' THEN 'unknown_price_version'
      WHEN event_type = 'click' AND output_tokens > 50 THEN 'promotion_expired'
      WHEN event_type = 'error' AND output_tokens > 90 THEN 'negative_tokens' END AS reason FROM raw_usage""", "raw_usage"))
def flt_usage_valid(spark, sf):
    kind = F.col("event_type")
    many = F.col("output_tokens") > 50
    rows = dt.usage_events(spark, sf).withColumns({
        "price_version": F.when(kind == "view", "2026-Q1").when(kind == "signup", "1999-Q1").otherwise("2026-Q4"),
        "model_id": F.when(kind == "click", "flash-promo").otherwise(F.col("model_id")),
        "occurred_at": F.when((kind == "click") & many, F.col("occurred_at") + F.expr("INTERVAL '4' YEAR"))
        .otherwise(F.col("occurred_at")),
        "input_tokens": F.when((kind == "error") & (F.col("output_tokens") > 90), F.lit(-1)).otherwise(F.col("input_tokens")),
    })
    return usage.judged(rows, dim.price_versions(spark), dim.prices(spark)).select("event_id", "reason")


@query("flt_events_period", with_parts(f"""
    SELECT tenant_id, event_id, occurred_at, event_type FROM usage_events
    WHERE {PERIOD_SQL} AND event_type = 'purchase'""", "usage_events"))
def flt_events_period(spark, sf):
    rows = _period(dt.usage_events(spark, sf)).where("event_type = 'purchase'")
    return rows.select("tenant_id", "event_id", "occurred_at", "event_type").orderBy("occurred_at", "event_id")


@query("flt_hide_types", with_parts("""
    SELECT edge_id, source_entity_id, target_entity_id FROM arcs WHERE edge_type IN ('nation_in','customer_in')""", "arcs"))
def flt_hide_types(spark, sf):
    _, shown = graph.hide_types(dt.entities(spark, sf), dt.edges(spark, sf), ["part", "supplier"])
    return shown.select("edge_id", "source_entity_id", "target_entity_id")
