"""Facts, the assertions that support them and the spans that prove them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.functions.ids import packed, unpacked
from spanledger.functions.text import valid_provenance, valid_span


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """The same rows; the write that reads them fails on the first bad one."""
    sure = F.coalesce(ok, F.lit(False))
    checked = F.when(sure, F.lit(None)).otherwise(F.raise_error(F.lit(message)))
    return df.where(checked.isNull())


def with_graph_validity(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "valid",
        valid_provenance(
            F.col("chunk_id"), F.col("start_offset"), F.col("end_offset"), F.col("quote")
        ),
    )


def with_span_validity(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "valid", valid_span(F.col("start_offset"), F.col("end_offset"), F.col("quote"))
    )


def short_ids(rows: DataFrame) -> DataFrame:
    """The rows with their text ids packed, as long as they travel; tenants stay as they are."""
    ids = [f.name for f in rows.schema if f.name.endswith("_id") and f.name != "tenant_id" and f.dataType == T.StringType()]
    return rows.withColumns({c: packed(F.col(c)) for c in ids})


def full_ids(rows: DataFrame) -> DataFrame:
    """The rows with the ids that ``short_ids`` packed."""
    ids = [f.name for f in rows.schema if f.name.endswith("_id") and f.dataType == T.BinaryType()]
    return rows.withColumns({c: unpacked(F.col(c)) for c in ids})


def fact_evidence(facts: DataFrame, assertions: DataFrame, spans: DataFrame) -> DataFrame:
    """Fact, assertion and span in one flat row each; spanless assertions drop out.

    Flat on purpose: a sentence shared by a third of the corpus makes one fact
    with as many assertions, which no single row should hold.
    """
    f = short_ids(facts.select("tenant_id", "fact_id", F.col("claim").alias("fact_claim")))
    a = short_ids(assertions.select("tenant_id", "fact_id", "assertion_id", "document_id", "chunk_id"))
    s = short_ids(spans.select("tenant_id", "assertion_id", "start_offset", "end_offset", "quote"))
    return full_ids(f.join(a, ["tenant_id", "fact_id"]).join(s, ["tenant_id", "assertion_id"]))


def live_facts(facts: DataFrame, assertions: DataFrame, spans: DataFrame) -> DataFrame:
    """Facts with at least one assertion that still has a span."""
    a = short_ids(assertions.select("tenant_id", "assertion_id", "fact_id"))
    s = short_ids(spans.select("tenant_id", "assertion_id"))
    proven = a.join(s, ["tenant_id", "assertion_id"], "left_semi")
    alive = short_ids(facts).join(
        proven.select("tenant_id", "fact_id"), ["tenant_id", "fact_id"], "left_semi"
    )
    return full_ids(alive).select(*facts.columns)


def assertion_support(assertions: DataFrame, spans: DataFrame) -> DataFrame:
    """Per fact: number of assertions, distinct documents and spans."""
    per_assertion = short_ids(spans.select("tenant_id", "assertion_id")).groupBy(
        "tenant_id", "assertion_id"
    ).agg(F.count(F.lit(1)).alias("n_spans"))
    counts = (
        short_ids(assertions.select("tenant_id", "assertion_id", "fact_id", "document_id"))
        .join(per_assertion, ["tenant_id", "assertion_id"], "left")
        # two steps keep the distinct count spread over (fact, document)
        .groupBy("tenant_id", "fact_id", "document_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_spans", F.lit(0))).alias("s"))
        .groupBy("tenant_id", "fact_id")
        .agg(
            F.sum("n").alias("n_assertions"),
            F.count(F.lit(1)).alias("n_documents"),
            F.sum("s").alias("n_spans"),
        )
    )
    return full_ids(counts)


def fact_trace(assertions: DataFrame, runs: DataFrame) -> DataFrame:
    """Which ontology, model and prompt produced each assertion of a fact."""
    r = runs.select(
        "tenant_id", "extraction_run_id", "ontology_name", "ontology_version", "model_id",
        "prompt_version",
    )
    return assertions.select("tenant_id", "assertion_id", "fact_id", "extraction_run_id").join(
        r, ["tenant_id", "extraction_run_id"]
    )


def span_signature(spans: DataFrame) -> DataFrame:
    """A fingerprint of its set of spans per assertion, whatever their order.

    Sums and exclusive ors of 64-bit hashes aggregate before the shuffle; nothing is
    gathered into a list.
    """
    span = ["start_offset", "end_offset", "quote"]
    return spans.groupBy("tenant_id", "assertion_id").agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64(*span).cast("decimal(20,0)")).alias("total"),
            F.bit_xor(F.xxhash64(F.lit("span"), *span)).alias("mix"),
        ).alias("signature")
    )


def match_assertions(
    incoming: DataFrame, incoming_spans: DataFrame, stored: DataFrame, stored_spans: DataFrame
) -> DataFrame:
    """Stored assertion an incoming one repeats: by id, else by place and spans."""
    place = ["tenant_id", "fact_id", "document_id", "chunk_id"]
    key = ["tenant_id", "assertion_id"]
    span = ["start_offset", "end_offset", "quote"]
    rows, kept = (short_ids(x.select(*place, "assertion_id")) for x in (incoming, stored))
    signed, signed_kept = (span_signature(short_ids(x.select(*key, *span))) for x in (incoming_spans, stored_spans))
    new = rows.join(signed, key).select(*place, "assertion_id", "signature")
    old = kept.join(signed_kept, key)
    # the least id as text
    same_place = old.groupBy(*place, "signature").agg(F.min(unpacked(F.col("assertion_id"))).alias("by_place"))
    by_id = kept.select("tenant_id", "assertion_id", F.lit(True).alias("by_id"))
    matched = full_ids(
        new.join(by_id, key, "left")
        .join(same_place, [*place, "signature"], "left")
        .select("tenant_id", "assertion_id", "by_id", "by_place")
    )
    return (
        matched
        .select(
            "tenant_id",
            "assertion_id",
            F.when(F.col("by_id"), F.col("assertion_id")).otherwise(F.col("by_place")).alias("stored_assertion_id"),
            F.when(F.col("by_id"), "id")
            .when(F.col("by_place").isNotNull(), "spans")
            .otherwise("new")
            .alias("matched_by"),
        )
    )


def integrity_violations(
    facts: DataFrame,
    assertions: DataFrame,
    spans: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    edges: DataFrame,
    entities: DataFrame,
) -> DataFrame:
    """Rows that break a reference, with the rule they break."""

    def missing(rows: DataFrame, row_id: str, name: str, other: DataFrame, pairs: dict) -> DataFrame:
        cond = F.lit(True)
        left = short_ids(rows.select(*dict.fromkeys([*pairs, row_id]))).alias("l")
        right = short_ids(other.select(*pairs.values())).alias("r")
        for mine, theirs in pairs.items():
            cond = cond & (F.col(f"l.{mine}") == F.col(f"r.{theirs}"))
        return left.join(right, cond, "left_anti").select(
            F.lit(name).alias("violation"), "tenant_id", F.col(row_id).alias("row_id")
        )

    t = {"tenant_id": "tenant_id"}
    checks = [
        missing(facts, "fact_id", "fact_without_assertion", assertions, t | {"fact_id": "fact_id"}),
        missing(assertions, "assertion_id", "assertion_without_document", documents,
                t | {"document_id": "document_id"}),
        missing(assertions, "assertion_id", "assertion_without_chunk", chunks,
                t | {"chunk_id": "chunk_id"}),
        missing(spans, "span_id", "span_without_chunk", chunks, t | {"chunk_id": "chunk_id"}),
        missing(edges, "edge_id", "edge_without_source", entities, t | {"source_entity_id": "entity_id"}),
        missing(edges, "edge_id", "edge_without_target", entities, t | {"target_entity_id": "entity_id"}),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return full_ids(out)


def remove_assertions(
    assertions: DataFrame, spans: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Assertions and spans left after removing the listed assertion ids."""
    keys = doomed.select("tenant_id", "assertion_id")
    on = ["tenant_id", "assertion_id"]
    return assertions.join(keys, on, "left_anti"), spans.join(keys, on, "left_anti")
