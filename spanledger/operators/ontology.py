"""Immutable ontology versions and the filter they impose on extractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.text import not_blank
from spanledger.operators.ordered import last_per_key
from spanledger.session import cut_lineage

NAME = ["tenant_id", "ontology_name"]


def latest(ontologies: DataFrame) -> DataFrame:
    return last_per_key(ontologies, NAME, ["ontology_version"])


def versions(ontologies: DataFrame, name: str) -> DataFrame:
    return ontologies.where(F.col("ontology_name") == name).orderBy("tenant_id", "ontology_version")


def next_versions(ontologies: DataFrame, proposals: DataFrame) -> DataFrame:
    """The next version per proposal; type lists left NULL carry over from the last one."""
    last = latest(ontologies).select(
        *NAME,
        F.col("ontology_version").alias("__v"),
        F.col("entity_types").alias("__e"),
        F.col("edge_types").alias("__r"),
    )
    none = F.array().cast("array<string>")
    return proposals.join(last, NAME, "left").select(
        *NAME,
        (F.coalesce("__v", F.lit(0)) + 1).cast("bigint").alias("ontology_version"),
        F.coalesce("entity_types", "__e", none).alias("entity_types"),
        F.coalesce("edge_types", "__r", none).alias("edge_types"),
    )


def publish(ontologies: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the new versions, refused rows whose version already exists)."""
    key = [*NAME, "ontology_version"]
    taken = ontologies.select(*key)
    fresh = incoming.join(taken, key, "left_anti")
    refused = incoming.join(taken, key, "left_semi")
    return ontologies.unionByName(fresh.select(*ontologies.columns)), refused


def _allowed(types: str, column: str):
    return (F.size(types) == 0) | F.array_contains(types, F.col(column))


def conforming_entities(rows: DataFrame, ontology: DataFrame) -> DataFrame:
    """Rows with a name, a quote and an allowed type; an empty list allows all types."""
    o = ontology.select("tenant_id", F.col("entity_types").alias("__types"))
    ok = not_blank(F.col("name")) & not_blank(F.col("quote")) & _allowed("__types", "entity_type")
    return rows.join(o, "tenant_id").where(ok).drop("__types")


def conforming_edges(rows: DataFrame, ontology: DataFrame) -> DataFrame:
    o = ontology.select("tenant_id", F.col("edge_types").alias("__types"))
    ok = not_blank(F.col("quote")) & _allowed("__types", "edge_type")
    return rows.join(o, "tenant_id").where(ok).drop("__types")


ANY = "*"


def ancestors(parents: DataFrame) -> DataFrame:
    """(type, ancestor): every type of ``parents`` (type, parent) with itself and all that it inherits from.

    Rounds of one join each, as many as the hierarchy is deep; what is known already is not followed again, so a cycle
    ends. Types are few: a hierarchy is a table of its ontology.
    """
    edges = cut_lineage(parents.select("type", "parent").where("type is not null and parent is not null").distinct())
    own = edges.select("type").unionByName(edges.select(F.col("parent").alias("type"))).distinct()
    known = cut_lineage(own.select("type", F.col("type").alias("ancestor")))
    fresh = known
    while not fresh.isEmpty():
        up = fresh.join(edges.withColumnsRenamed({"type": "ancestor", "parent": "next"}), "ancestor").select("type", F.col("next").alias("ancestor")).distinct()
        fresh = cut_lineage(up.join(known, ["type", "ancestor"], "left_anti"))
        known = cut_lineage(known.unionByName(fresh))
    return known


def judged_triples(edges: DataFrame, entities: DataFrame, signatures: DataFrame, parents: DataFrame) -> DataFrame:
    """``edges`` with ``source_type``, ``target_type`` and ``reason``, null where the triple is legal.

    ``signatures`` (edge_type, allowed_sources, allowed_targets) name types, types that inherit from a named one fit as well, and ``*`` allows any; several
    rows of one edge type are alternatives. Reasons, the first that holds: ``unknown_edge_type``, ``no_source``,
    ``no_target``, ``source_type``, ``target_type``, and ``combination`` where each end fits some alternative but none fits both.
    """
    types = entities.select("tenant_id", F.col("entity_id"), F.col("entity_type"))
    ends = edges
    for side in ("source", "target"):
        ends = ends.join(types.withColumnsRenamed({"entity_id": f"{side}_entity_id", "entity_type": f"{side}_type"}), ["tenant_id", f"{side}_entity_id"], "left")
    # what an edge type allows is one small row, its types written out with all that inherit from them, so the edges
    # are looked up once and judged where they lie
    own = signatures.select("edge_type", "allowed_sources", "allowed_targets").where("allowed_sources is not null").withColumn("__n", F.monotonically_increasing_id())
    own = cut_lineage(own)
    down = ancestors(parents).select(F.col("ancestor").alias("named"), "type")
    for side in ("source", "target"):
        named = own.select("__n", F.explode(f"allowed_{side}s").alias("named"))
        more = named.join(down, "named").select("__n", "type").unionByName(named.select("__n", F.col("named").alias("type")))
        own = own.join(more.groupBy("__n").agg(F.collect_set("type").alias(f"{side}s")), "__n", "left")
    alternatives = own.groupBy(F.col("edge_type").alias("__type")).agg(F.collect_list(F.struct("sources", "targets")).alias("__allowed"))
    met = ends.join(alternatives, F.col("edge_type") == F.col("__type"), "left")

    def fits(alternative: Column, side: str) -> Column:
        held = F.coalesce(alternative[f"{side}s"], F.array().cast("array<string>"))
        return F.array_contains(held, ANY) | F.array_contains(held, F.col(f"{side}_type"))

    def some(test: Callable[[Column], Column]) -> Column:
        return F.exists("__allowed", lambda a: F.coalesce(test(a), F.lit(False)))

    reason = (
        F.when(F.col("__allowed").isNull(), "unknown_edge_type").when(F.col("source_type").isNull(), "no_source").when(F.col("target_type").isNull(), "no_target")
        .when(~some(lambda a: fits(a, "source")), "source_type").when(~some(lambda a: fits(a, "target")), "target_type")
        .when(~some(lambda a: fits(a, "source") & fits(a, "target")), "combination")
    )
    return met.withColumn("reason", reason).drop("__type", "__allowed")
