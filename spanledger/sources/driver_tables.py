"""Engine tables derived from the given parquet tables.

Each function reads whole tables and returns one engine table. The SQL twins used
for checking live in ``catalog/twins.py``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.ids import url_uuid5
from spanledger.functions.text import SENTENCE, words
from spanledger.operators.usage import priced
from spanledger.plans.ingest import facts_of, repeated_documents, sentence_extract
from spanledger.session import cut_lineage, spread
from spanledger.sources import dimensions as dim
from spanledger.sources.documents import paragraph_chunks


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# ---- documents ---------------------------------------------------------------


def document_id(doc_id: Column) -> Column:
    return url_uuid5("document", doc_id.cast("string"))


def spread_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread_documents(spark, sf).select(
        F.col("source").alias("tenant_id"),
        document_id(F.col("doc_id")).alias("document_id"),
        "doc_id",
        "lang",
        "text",
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as chunks: the given texts hold no blank line."""
    return paragraph_chunks(documents(spark, sf), "\n")


def provenance(spark: SparkSession, sf: str, stored: bool = False, proven: bool = False) -> dict[str, DataFrame]:
    """Chunks, entities, edges, facts, assertions and spans of all documents.

    ``stored`` writes the two tables the others follow from, as an engine would have
    them: for jobs that read them many times; ``proven`` writes the assertions too, whose ids
    are dear to work out again for each reader.
    """
    c = cut_lineage(chunks(spark, sf)) if stored else chunks(spark, sf)
    entities, edges = sentence_extract(c)
    if stored:
        entities = cut_lineage(entities)
    facts, assertions, spans = facts_of(entities, repeated_documents(documents(spark, sf)))
    if proven:
        assertions = cut_lineage(assertions)
    return {
        "documents": documents(spark, sf).select("tenant_id", "document_id"),
        "chunks": c,
        "entities": entities,
        "edges": edges,
        "facts": facts,
        "assertions": assertions,
        "spans": spans,
    }


def toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents to erase: those labelled toxic."""
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    return documents(spark, sf).join(bad, "doc_id", "left_semi").select("tenant_id", "document_id")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One extraction run per tenant and language; Spanish documents had none recorded."""
    known = documents(spark, sf).select("tenant_id", "lang").where(F.col("lang") != "es").distinct()
    return known.select(
        "tenant_id",
        url_uuid5("run", F.col("tenant_id"), F.col("lang")).alias("extraction_run_id"),
        F.lit("contracts").alias("ontology_name"),
        F.when(F.col("lang") == "en", 2).otherwise(1).cast("bigint").alias("ontology_version"),
        F.concat(F.lit("model-"), F.col("lang")).alias("model_id"),
        F.lit("p1").alias("prompt_version"),
    )


def assertions_with_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select(
        "tenant_id",
        "document_id",
        url_uuid5("run", F.col("tenant_id"), F.col("lang")).alias("extraction_run_id"),
    )
    return provenance(spark, sf)["assertions"].join(d, ["tenant_id", "document_id"])


def erasable(spark: SparkSession, sf: str, often: bool = True) -> dict[str, DataFrame]:
    """All tables a document erasure reaches; ``often`` writes the larger ones, for jobs that do not write all of them themselves."""
    t = provenance(spark, sf, stored=True, proven=often)
    written = cut_lineage if often else lambda rows: rows
    name = F.concat_ws(" ", F.slice(words(F.col("text")), 1, 2))
    mentions = written(t["chunks"].where(F.size(words(F.col("text"))) > 0).select(
        "tenant_id", "document_id", "chunk_id",
        url_uuid5("mention", F.col("chunk_id")).alias("mention_id"),
        name.alias("name"),
    ))
    # mentions cluster by their first word
    memberships = written(mentions.select(
        "tenant_id",
        url_uuid5("membership", F.col("mention_id")).alias("membership_id"),
        "mention_id",
        url_uuid5("cluster", F.col("tenant_id"), F.lower(F.element_at(F.split("name", " "), 1))).alias(
            "cluster_id"
        ),
        F.lit(True).alias("is_active"),
    ))
    golden = (
        memberships.join(mentions.select("tenant_id", "mention_id", "name"), ["tenant_id", "mention_id"])
        .groupBy("tenant_id", "cluster_id")
        .agg(F.min("name").alias("canonical_name"))
    )
    ids = documents(spark, sf).select("tenant_id", "document_id", "doc_id")

    def beside(name: str, key: str, row: Column) -> DataFrame:
        rows = table(spark, sf, name).select(F.col(key).alias("doc_id"), row.alias("row_id"))
        return rows.join(ids, "doc_id").select("tenant_id", "document_id", "row_id")

    turns = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return {
        **t,
        "mentions": mentions,
        "memberships": memberships,
        "golden_records": golden,
        "embeddings": beside("embeddings", "vec_id", F.col("vec_id").cast("string")),
        "caches": beside("conversations", "conv_id", turns),
        "summaries": beside("pages", "page_id", F.col("page_id").cast("string")),
        "fixtures": beside("labels", "doc_id", F.col("doc_id").cast("string")),
        "runs": documents(spark, sf).select(
            "tenant_id", "document_id", url_uuid5("run", F.col("document_id")).alias("run_id")
        ),
    }


# ---- resolution --------------------------------------------------------------


def part_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.lit("catalog").alias("tenant_id"),
        F.col("p_partkey").cast("string").alias("mention_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("entity_type"),
    )


def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    """A rule groups all parts by name, people then single out the large ones, a model
    run at last proposes brands for promotion parts."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")

    def wave(rows: DataFrame, number: int, source: str, cluster: Column, confidence: float) -> DataFrame:
        return rows.select(
            F.lit("catalog").alias("tenant_id"),
            key.cast("string").alias("mention_id"),
            cluster.alias("cluster_id"),
            F.concat(F.lit(f"{source}:"), cluster).alias("decision_id"),
            F.lit(source).alias("source"),
            F.lit(confidence).alias("confidence"),
            F.lit(f"2024-0{number}-01 00:00:00").cast("timestamp_ntz").alias("decided_at"),
            (key + F.lit(number) * F.lit(1_000_000_000_000)).alias("seq"),
        )

    return (
        wave(p, 1, "rule", F.concat(F.lit("name:"), "p_name"), 0.7)
        .unionByName(
            wave(p.where("p_size >= 45"), 2, "human", F.concat(F.lit("own:"), key.cast("string")), 1.0)
        )
        .unionByName(
            wave(p.where("p_type = 'PROMO'"), 3, "model", F.concat(F.lit("brand:"), "p_brand"), 0.9)
        )
    )


# ---- time --------------------------------------------------------------------


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts: a customer's priority class has a status from the order date on."""
    o = table(spark, sf, "orders")
    created = F.col("o_orderdate") + F.make_dt_interval(days=F.floor(F.col("o_totalprice") / 20000).cast("int"))
    return o.select(
        F.lit("trade").alias("tenant_id"),
        F.col("o_orderkey").alias("fact_id"),
        F.concat_ws(" ", F.col("o_orderpriority"), F.col("o_orderstatus")).alias("claim"),
        F.col("o_custkey").cast("string").alias("subject"),
        F.col("o_orderpriority").alias("predicate"),
        F.col("o_orderstatus").alias("object"),
        F.col("o_orderdate").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        created.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", created + F.expr("INTERVAL '365' DAY")).alias("expired_at"),
        F.lit(None).cast("bigint").alias("superseded_by_id"),
    )


# line items that one task joins with their orders and sums up
SHARE = 250_000


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with order and ship date: many ship before they are ordered.

    Large tables are dealt into as many parts as their rows ask for, so that what a task holds does not grow with them.
    """
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_custkey")
    lines = table(spark, sf, "lineitem")
    parts = lines.count() // SHARE
    if parts > spark.sparkContext.defaultParallelism:
        lines, o = (x.where("l_orderkey is not null").repartition(parts, "l_orderkey") for x in (lines, o))
    return lines.join(o, "l_orderkey")


# ---- graph -------------------------------------------------------------------


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as graph entities."""
    def kind(name: str, key: str, label: str, entity_type: Column, order: int) -> DataFrame:
        return table(spark, sf, name).select(
            F.lit("trade").alias("tenant_id"),
            F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("entity_id"),
            F.col(label).alias("name"),
            entity_type.alias("entity_type"),
            F.lit("raw").alias("kind"),
            (
                F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
                + F.make_dt_interval(days=F.lit(order), secs=F.col(key).cast("decimal(18,6)"))
            ).alias("created_at"),
        )

    return (
        kind("region", "r_regionkey", "r_name", F.lit("region"), 0)
        .unionByName(kind("nation", "n_nationkey", "n_name", F.lit("nation"), 1))
        .unionByName(kind("supplier", "s_suppkey", "s_name", F.lit("supplier"), 2))
        .unionByName(kind("customer", "c_custkey", "c_name", F.lit("customer"), 3))
        .unionByName(kind("part", "p_partkey", "p_name", F.lit("part"), 4))
    )


def stored_graph(spark: SparkSession, sf: str, columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Entities and edges as written tables, for walks that read them once per hop; of the edges the named columns, else all."""
    links = edges(spark, sf)
    return cut_lineage(entities(spark, sf)), cut_lineage(links.select(*columns) if columns else links)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Structural edges and one trade edge per order and part."""
    def ref(prefix: str, key: str) -> Column:
        return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))

    def link(name: str, src: tuple[str, str], dst: tuple[str, str], edge_type: str) -> DataFrame:
        return table(spark, sf, name).select(
            F.lit("trade").alias("tenant_id"),
            F.concat(F.lit(f"{edge_type}:"), F.col(src[1]).cast("string")).alias("edge_id"),
            ref(*src).alias("source_entity_id"),
            ref(*dst).alias("target_entity_id"),
            F.lit(edge_type).alias("edge_type"),
            F.lit(1.0).alias("weight"),
            F.lit(None).cast("timestamp_ntz").alias("valid_from"),
            F.lit(None).cast("timestamp_ntz").alias("valid_to"),
            F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        )

    traded = (
        shipments(spark, sf)
        .groupBy("l_orderkey", "l_partkey", "o_custkey", "o_orderdate")
        .agg(F.sum("l_quantity").alias("weight"), F.max("l_shipdate").alias("shipped"))
    )
    trade = traded.select(
        F.lit("trade").alias("tenant_id"),
        F.concat_ws(":", F.lit("bought"), F.col("l_orderkey").cast("string"),
                    F.col("l_partkey").cast("string")).alias("edge_id"),
        ref("customer", "o_custkey").alias("source_entity_id"),
        ref("part", "l_partkey").alias("target_entity_id"),
        F.lit("bought").alias("edge_type"),
        "weight",
        F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("shipped") > F.col("o_orderdate"), F.col("shipped")).alias("valid_to"),
        F.col("o_orderdate").alias("created_at"),
    )
    return (
        link("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "nation_in")
        .unionByName(link("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "customer_in"))
        .unionByName(link("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "supplier_in"))
        .unionByName(trade)
    )


# ---- usage, audit, quota -----------------------------------------------------

# model per kind of event, by long and short names; one kind uses a model nobody priced
EVENT_MODELS = (
    ("click", "model-small", "batch", "2026-Q4"),
    ("view", "flash-lite", "batch", "2026-Q4"),
    ("signup", "embedding-small", "batch", "2026-Q3"),
    ("purchase", "model-large-5", "interactive", "2026-Q4"),
    ("error", "model-medium-5", "interactive", "2026-Q3"),
)


def event_tenant() -> Column:
    return F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string"))


def usage_from(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Usage rows of events, without retries; works on a stream too."""
    models = dim.values_frame(
        spark, "event_type string, model_id string, provider string, price_version string", EVENT_MODELS
    )
    rows = events.join(models, "event_type").select(
        event_tenant().alias("tenant_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("occurred_at"),
        (F.col("ts") + F.make_dt_interval(hours=F.get_json_object("props", "$.k").cast("int"))).alias("recorded_at"),
        "event_type",
        "provider",
        "model_id",
        "price_version",
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("document_id"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
        F.col("user_id").cast("bigint").alias("cache_read_input_tokens"),
        F.lit(0).cast("bigint").alias("cache_write_input_tokens"),
        F.lit(False).alias("is_correction"),
        F.lit(None).cast("string").alias("correction_for_event_id"),
    )
    return priced(rows, dim.prices(spark), dim.model_aliases(spark))


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    return usage_from(spark, table(spark, sf, "events"))


def delivered_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage rows as delivered: events of kind error arrive a second time an hour later."""
    once = usage_events(spark, sf)
    again = once.where("event_type = 'error'").withColumn(
        "recorded_at", F.col("recorded_at") + F.expr("INTERVAL '1' HOUR")
    )
    return once.unionByName(again)


def correction_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with more tokens than their event value explains are taken back in half."""
    big = usage_events(spark, sf).where("event_type = 'purchase' AND input_tokens > 10000")
    half = F.floor(F.col("input_tokens") / 2).cast("bigint")
    return big.select(
        "tenant_id",
        F.col("event_id").alias("original_event_id"),
        F.concat(F.lit("fix-"), "event_id").alias("correction_event_id"),
        (-half).alias("input_tokens_offset"),
        (-F.col("output_tokens")).alias("output_tokens_offset"),
        (F.col("occurred_at") + F.expr("INTERVAL '1' DAY")).alias("occurred_at"),
        F.lit("counted twice").alias("reason"),
    )


def corrected_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger with its corrections."""
    from spanledger.operators.usage import corrections

    ledger = usage_events(spark, sf)
    fixes = corrections(
        ledger, correction_requests(spark, sf), dim.prices(spark), dim.model_aliases(spark)
    )
    cols = [c for c in ledger.columns if c not in ("recorded_at",)]
    return ledger.select(*cols).unionByName(fixes.select(*cols))


# audit type per kind of event
EVENT_AUDIT = (
    ("click", "data_access"),
    ("view", "data_access"),
    ("signup", "authentication"),
    ("purchase", "llm_invocation"),
    ("error", "authorization_failure"),
)


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    kinds = dim.values_frame(spark, "kind string, audit_type string", EVENT_AUDIT)
    e = table(spark, sf, "events").withColumnRenamed("event_type", "kind").join(kinds, "kind")
    llm = F.col("audit_type") == "llm_invocation"
    return e.select(
        url_uuid5("audit", F.col("event_id").cast("string")).alias("id"),
        event_tenant().alias("tenant_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("audit_type").alias("event_type"),
        F.col("kind").alias("action"),
        F.col("ts").alias("occurred_at"),
        F.col("ts").alias("recorded_at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_id"),
        F.lit("user").alias("actor_type"),
        F.when(llm, "model-large-5").alias("model"),
        # small purchases come without a model version
        F.when(llm & (F.col("value") > 10), "v1").alias("model_version"),
        F.when(llm, F.floor(F.col("value") * 100).cast("bigint")).alias("input_tokens"),
        F.when(llm, F.get_json_object("props", "$.k").cast("bigint")).alias("output_tokens"),
        F.col("props").alias("metadata_json"),
    )


def conversation_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns proposed as audit metadata: notes at some depth, some with a
    forbidden key, some too long."""
    c = table(spark, sf, "conversations")
    note = F.to_json(F.struct(F.struct(F.col("text").alias("note")).alias("detail")))
    body = F.to_json(F.struct(F.struct(F.struct(F.col("role").alias("Body")).alias("inner")).alias("detail")))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        F.lit("data_access").alias("event_type"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("model_version"),
        F.lit(None).cast("bigint").alias("input_tokens"),
        F.lit(None).cast("bigint").alias("output_tokens"),
        F.when(F.col("role") == "system", body).otherwise(note).alias("metadata_json"),
    )


# tier per tenant of the event tables; tenants not listed are on the free tier
TENANT_TIERS = (("t0", "enterprise"), ("t1", "pro"), ("t2", "pro"))


def tenant_tiers(spark: SparkSession, sf: str) -> DataFrame:
    tenants = table(spark, sf, "events").select(event_tenant().alias("tenant_id")).distinct()
    named = dim.values_frame(spark, "tenant_id string, tier string", TENANT_TIERS)
    return (
        tenants.join(named, "tenant_id", "left")
        .withColumn("tier", F.coalesce("tier", F.lit("free")))
        .join(dim.quota_tiers(spark), "tier")
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        event_tenant().alias("tenant_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("occurred_at"),
        micros(F.col("ts")).alias("at_micros"),
    )


def slots(spark: SparkSession, sf: str) -> DataFrame:
    """Ingestions that hold a slot for as many minutes as the event's counter says."""
    e = table(spark, sf, "events")
    at = micros(F.col("ts"))
    minutes = F.get_json_object("props", "$.k").cast("bigint") + 1
    return e.select(
        event_tenant().alias("tenant_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("occurred_at"),
        at.alias("at_micros"),
        (at + minutes * 60_000_000).alias("until_micros"),
    )


# ---- evaluation --------------------------------------------------------------


def contract_date(n_chars: Column) -> Column:
    """A day that follows from the length of the document."""
    return F.date_add(F.lit("2010-01-01").cast("date"), n_chars.cast("int"))


def spelled(day: Column, lang: Column) -> Column:
    """A day in a different spelling per language."""
    return (
        F.when(lang == "en", F.date_format(day, "MMMM d, yyyy"))
        .when(lang == "fr", F.concat(F.date_format(day, "d"), F.lit("th day of "), F.date_format(day, "MMMM, yyyy")))
        .when(lang == "de", F.date_format(day, "M/d/yy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their quality label, which decides how good the predictions are."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    return spread_documents(spark, sf).join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("contract"),
        "text", "lang", "source", "n_chars", "quality", "toxic",
    )


# clause category of a document, by source
SOURCE_CLAUSES = (
    ("src0", "Anti-Assignment"), ("src1", "Cap On Liability"), ("src2", "Change Of Control"),
    ("src3", "Exclusivity"), ("src4", "Non-Compete"), ("src5", "Termination For Convenience"),
    ("src6", "Uncapped Liability"),
)


def _clause(spark: SparkSession, rows: DataFrame) -> DataFrame:
    named = dim.values_frame(spark, "source string, clause string", SOURCE_CLAUSES)
    return rows.join(named, "source", "left").withColumn("clause", F.coalesce("clause", F.lit("Exclusivity")))


def _lines(min_words: int) -> Column:
    lines = F.transform(F.split("text", "\n"), F.trim)
    return F.filter(lines, lambda x: F.size(F.split(x, " ")) >= min_words)


def eval_labels(spark: SparkSession, sf: str) -> DataFrame:
    """contract, category, answers: what the annotators would have written."""
    c = _clause(spark, contracts(spark, sf))
    day = contract_date(F.col("n_chars"))
    party = F.concat(
        F.initcap("source"), F.lit(' Holdings, Inc. ("'), F.upper("source"), F.lit('", "Supplier"); '),
        F.initcap("lang"), F.lit(" Partners LLC (formerly known as Old "), F.initcap("lang"), F.lit(")"),
    )
    law = F.when(F.col("lang") == "en", F.concat(F.lit("State of "), F.initcap("source"), F.lit(", USA"))).otherwise(
        F.concat(F.lit("laws of the Commonwealth of "), F.initcap("source"))
    )
    cells = F.array(
        F.struct(F.lit("Agreement Date").alias("category"), F.array(spelled(day, F.col("lang"))).alias("answers")),
        F.struct(F.lit("Governing Law").alias("category"), F.array(law).alias("answers")),
        F.struct(F.lit("Parties").alias("category"), F.array(party).alias("answers")),
        F.struct(F.lit("Renewal Term").alias("category"), F.array(F.lit("two years")).alias("answers")),
        F.struct(F.col("clause").alias("category"), _lines(8).alias("answers")),
    )
    return c.select("contract", F.explode(cells).alias("x")).select("contract", "x.*").where(F.size("answers") > 0)


def eval_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """contract, category, items: good for good documents, off or missing for others."""
    c = _clause(spark, contracts(spark, sf).where(F.col("quality").isNotNull()))
    day = contract_date(F.col("n_chars"))
    good = F.col("quality") == 1

    def items(category: Column, values: Column, quotes: Column) -> Column:
        return F.struct(
            category.alias("category"),
            F.transform(
                F.arrays_zip(values.alias("v"), quotes.alias("q")),
                lambda z: F.struct(z["v"].alias("value"), z["q"].alias("quote"), F.lit(True).alias("found")),
            ).alias("items"),
        )

    first = F.regexp_extract("text", SENTENCE, 0)
    said_day = (
        F.when(F.col("toxic") == 1, F.lit("YYYY-MM-DD"))
        .when(good, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(F.date_add(day, 1), "MM/dd/yyyy"))
    )
    said_law = F.when(good, F.concat(F.lit("laws of the State of "), F.initcap("source"))).otherwise(F.lit("Nowhere"))
    said_parties = F.array(
        F.upper("source"),
        F.concat(F.initcap("lang"), F.lit(" Partners, L.L.C.")),
        F.concat(F.initcap("source"), F.lit(" Holdings Inc")),
        F.when(good, F.concat(F.lit("old "), "lang")).otherwise(F.lit("Other Co.")),
    )
    # clauses: each line without its last two words, lower case for poor documents
    said_lines = F.transform(
        _lines(5),
        lambda x: F.when(good, x).otherwise(F.lower(x)),
    )
    cut = F.transform(said_lines, lambda x: F.regexp_replace(x, r"( [^ ]*){2}$", ""))
    none = F.transform(cut, lambda x: F.lit(""))
    quotes4 = F.array(first, F.lower(first), F.lit("not in there"), first)
    cells = F.array(
        items(F.lit("Agreement Date"), F.array(said_day), F.array(first)),
        items(F.lit("Governing Law"), F.array(said_law), F.array(F.lit("no such quote"))),
        items(F.lit("Parties"), said_parties, quotes4),
        items(F.col("clause"), none, cut),
    )
    return c.select("contract", F.explode(cells).alias("x")).select("contract", "x.*").where(F.size("items") > 0)


def contract_texts(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("contract", F.col("text").alias("contract_text"))
