"""From documents to chunks, verified extractions, facts and a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.ids import assertion_uuid, fact_uuid, url_uuid5
from spanledger.functions.text import locate_span, normalize_for_provenance, not_blank, sentence_rows, strip
from spanledger.operators import graph, ontology as onto
from spanledger.operators.ordered import first_per_key, last_per_key, repeated_keys, with_keys_of
from spanledger.operators.provenance import full_ids, short_ids
from spanledger.session import cut_lineage
from spanledger.sources.documents import paragraph_chunks

Extraction = tuple[DataFrame, DataFrame | Callable[[DataFrame], DataFrame]]
Extractor = Callable[[DataFrame], Extraction]

PLACE = ["tenant_id", "document_id", "chunk_id"]


def _entity_id(*parts: Column) -> Column:
    return url_uuid5("entity", *[p.cast("string") for p in parts])


def _edge_id(*parts: Column) -> Column:
    return url_uuid5("edge", *[p.cast("string") for p in parts])


def sentence_extract(
    chunks: DataFrame, entity_type: str = "Unknown", edge_type: str = "RELATED_TO"
) -> Extraction:
    """One entity and one self edge per sentence of a chunk: the quotes are the whole text.

    Needs no model, so the whole pipeline can run and be checked offline.
    """
    name = F.concat(F.lit("Sentence of chunk "), F.col("chunk_index").cast("string")).alias("name")
    rows = sentence_rows(chunks, *PLACE, "chunk_index", name)
    return _quoted(rows, entity_type, edge_type)


def baseline_extract(
    chunks: DataFrame,
    entity_type: str = "Unknown",
    edge_type: str = "RELATED_TO",
    quote_chars: int = 50,
) -> Extraction:
    """One entity and one self edge per chunk, quoting its first ``quote_chars`` characters."""
    rows = chunks.where(F.length("text") > 0).select(
        *PLACE,
        "chunk_index",
        F.concat(F.lit("Entity from chunk "), F.col("chunk_index").cast("string")).alias("name"),
        F.lit(0).alias("start_offset"),
        F.least(F.length("text"), F.lit(quote_chars)).alias("end_offset"),
        F.substring("text", 1, quote_chars).alias("quote"),
    )
    return _quoted(rows, entity_type, edge_type)


def self_linked_sentences(chunks: DataFrame) -> Extraction:
    """As ``sentence_extract``; the edges follow from the entities and need not be written beside them."""
    entities, _ = sentence_extract(chunks)
    return entities, lambda stored: _self_edges(stored, "RELATED_TO")


def _quoted(rows: DataFrame, entity_type: str, edge_type: str) -> Extraction:
    """An entity and its self edge for each quoted span."""
    c = F.col
    span = ["start_offset", "end_offset", "quote"]
    entities = rows.select(
        *PLACE,
        _entity_id(c("chunk_id"), c("name"), c("start_offset"), c("end_offset")).alias("entity_id"),
        "name",
        F.lit(entity_type).alias("entity_type"),
        *span,
        c("chunk_index").alias("seq"),
    )
    return entities, _self_edges(entities, edge_type)


def _self_edges(entities: DataFrame, edge_type: str) -> DataFrame:
    c = F.col
    return entities.select(
        *PLACE,
        _edge_id(c("entity_id"), c("entity_id"), F.lit(edge_type)).alias("edge_id"),
        c("entity_id").alias("source_entity_id"),
        c("entity_id").alias("target_entity_id"),
        F.lit(edge_type).alias("edge_type"),
        "start_offset", "end_offset", "quote",
        "seq",
    )


def repeated_documents(documents: DataFrame) -> DataFrame:
    """Ids (document_id) of documents that come more than once, as a written table."""
    counts = documents.groupBy("document_id").agg(F.count(F.lit(1)).alias("__n"))
    return cut_lineage(counts.where("__n > 1").drop("__n"))


def facts_of(entities: DataFrame, repeated: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, assertions, spans) stated by entities.

    The claim is the quote, so equal quotes of one tenant share a fact. Ids are
    deterministic: running the job again yields the same rows. ``repeated`` tells the only
    documents (document_id) that may state the same thing at the same place twice; the rows
    of all others are then known to differ and need no shuffle to be told apart.
    """
    c = F.col
    one_span = F.array(F.struct("start_offset", "end_offset", "quote"))
    stated = entities.select(
        *PLACE,
        fact_uuid(c("tenant_id"), c("quote")).alias("fact_id"),
        c("quote").alias("claim"),
        "start_offset", "end_offset", "quote",
    ).withColumn(
        "assertion_id",
        assertion_uuid(c("tenant_id"), c("fact_id"), c("document_id"), c("chunk_id"), one_span),
    )
    span_id = url_uuid5("span", c("assertion_id"), c("start_offset").cast("string"), c("end_offset").cast("string"))

    def once(*columns: str | Column) -> DataFrame:
        # an id follows from the whole row, so equal ids are equal rows and hashing suffices
        if repeated is None:
            return stated.select(*columns).distinct()
        if repeated.isEmpty():
            return stated.select(*columns)
        alone = with_keys_of(stated, repeated, ["document_id"], "left_anti").select(*columns)
        return alone.unionByName(with_keys_of(stated, repeated, ["document_id"], "left_semi").select(*columns).distinct())

    assertions = once(*PLACE, "assertion_id", "fact_id", "claim")
    spans = once("tenant_id", "assertion_id", "chunk_id", "start_offset", "end_offset", "quote", span_id.alias("span_id"))
    # the id follows from tenant and claim and need not travel
    told = stated.select("tenant_id", "claim").distinct()
    facts = told.select("tenant_id", fact_uuid(c("tenant_id"), c("claim")).alias("fact_id"), "claim")
    return facts, assertions, spans


def ingest(
    documents: DataFrame, extractor: Extractor = self_linked_sentences, separator: str = "\n\n"
) -> dict[str, DataFrame]:
    """All tables the documents give rise to, keyed by table name.

    Chunks and extractions are written once: six tables follow from them, and an
    extractor that calls a model must not run again for each. An extractor may give its
    edges as a function of the written entities.
    """
    chunks = cut_lineage(paragraph_chunks(documents, separator))
    entities, edges = extractor(chunks)
    entities = cut_lineage(entities)
    edges = edges(entities) if callable(edges) else cut_lineage(edges)
    stated_twice = repeated_keys(entities, [*PLACE, "start_offset", "end_offset", "quote"])
    facts, assertions, spans = facts_of(entities, cut_lineage(stated_twice.select("document_id").distinct()))
    survivors, _, unique_edges = graph.dedupe_mentions(entities, edges)
    return {
        "chunks": chunks,
        "entities": survivors,
        "edges": unique_edges,
        "facts": facts,
        "assertions": assertions,
        "spans": spans,
    }


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct ids per table and tenant."""
    ids = {
        "chunks": "chunk_id", "entities": "entity_id", "edges": "edge_id", "facts": "fact_id",
        "assertions": "assertion_id", "spans": "span_id",
    }
    out = None
    for name, df in tables.items():
        part = (
            df.groupBy("tenant_id", F.col(ids[name]).alias("id")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("tenant_id")
            .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"))
            .withColumn("table_name", F.lit(name))
        )
        out = part if out is None else out.unionByName(part)
    return out


def shared_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """Facts asserted by two or more documents, with each piece of evidence."""
    a = short_ids(tables["assertions"].select("tenant_id", "fact_id", "assertion_id", "document_id", "chunk_id"))
    support = (
        a.groupBy("tenant_id", "fact_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tenant_id", "fact_id")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_assertions"))
        .where(F.col("n_documents") >= 2)
    )
    s = short_ids(tables["spans"].select("tenant_id", "assertion_id", "start_offset", "end_offset", "quote"))
    return full_ids(
        a.join(support, ["tenant_id", "fact_id"])
        .join(s, ["tenant_id", "assertion_id"])
        .select(
            "tenant_id", "fact_id", "n_documents", "n_assertions", "document_id", "chunk_id",
            "assertion_id", "start_offset", "end_offset", "quote",
        )
    )


def bind_quotes(rows: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bound, rejected) model outputs: a quote must occur in its chunk word for word.

    ``rows`` hold tenant_id, chunk_id and quote; bound rows get the offsets.
    """
    texts = chunks.select("tenant_id", "chunk_id", F.col("text").alias("__text"))
    located = (
        rows.join(texts, ["tenant_id", "chunk_id"], "left")
        .withColumn("quote", normalize_for_provenance(F.col("quote")))
        .withColumn("__span", locate_span(F.col("__text"), F.col("quote")))
        .withColumn(
            "reason",
            F.when(F.col("__text").isNull(), "chunk_not_found")
            .when(~not_blank(F.col("quote")), "blank_quote")
            .when(F.col("__span").isNull(), "quote_not_in_text"),
        )
        .drop("__text")
    )
    located = cut_lineage(located)
    bound = located.where(F.col("reason").isNull()).select(
        *[c for c in rows.columns if c != "quote"],
        F.col("__span.start_offset").alias("start_offset"),
        F.col("__span.end_offset").alias("end_offset"),
        "quote",
    )
    rejected = located.where(F.col("reason").isNotNull()).select(*rows.columns, "reason")
    return bound, rejected


def verify_extraction(
    chunks: DataFrame, named: DataFrame, linked: DataFrame, ontology: DataFrame
) -> dict[str, DataFrame]:
    """Turns saved model outputs into entities and edges with proven spans.

    ``named``: tenant_id, document_id, chunk_id, seq, name, entity_type, quote.
    ``linked``: the same place columns, seq, source_name, target_name, edge_type, quote.
    Ends resolve by name inside the chunk; the last entity of a name counts.
    """
    trimmed = named.withColumns({c: strip(F.col(c)) for c in ("name", "entity_type", "quote")})
    bound, rejected = bind_quotes(onto.conforming_entities(trimmed, ontology), chunks)
    c = F.col
    entities = bound.withColumn(
        "entity_id",
        _entity_id(c("chunk_id"), c("name"), c("entity_type"), c("start_offset"), c("end_offset"), c("seq")),
    )
    tidy = linked.withColumns(
        {x: strip(F.col(x)) for x in ("source_name", "target_name", "edge_type", "quote")}
    )
    links, rejected_links = bind_quotes(onto.conforming_edges(tidy, ontology), chunks)
    by_name = last_per_key(
        entities.select("tenant_id", "chunk_id", "name", "seq", "entity_id"),
        ["tenant_id", "chunk_id", "name"], ["seq", "entity_id"],
    )

    def end(side: str) -> DataFrame:
        return by_name.select(
            "tenant_id", "chunk_id", F.col("name").alias(f"{side}_name"),
            F.col("entity_id").alias(f"{side}_entity_id"),
        )

    ended = links.join(end("source"), ["tenant_id", "chunk_id", "source_name"], "left").join(
        end("target"), ["tenant_id", "chunk_id", "target_name"], "left"
    )
    known = c("source_entity_id").isNotNull() & c("target_entity_id").isNotNull()
    edges = ended.where(known).withColumn(
        "edge_id",
        _edge_id(c("source_entity_id"), c("target_entity_id"), c("edge_type"),
                 c("start_offset"), c("end_offset")),
    )
    loose = ended.where(~known).select(
        "tenant_id", "chunk_id", "seq", "quote", F.lit("unknown_endpoint").alias("reason")
    )
    slim = ["tenant_id", "chunk_id", "seq", "quote", "reason"]
    return {
        "entities": entities,
        "edges": first_per_key(edges, ["tenant_id", "edge_id"], ["seq"]),
        "rejected": rejected.select(*slim)
        .withColumn("kind", F.lit("entity"))
        .unionByName(rejected_links.select(*slim).unionByName(loose).withColumn("kind", F.lit("edge"))),
    }
