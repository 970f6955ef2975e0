"""Names against a registry, in tiers: each name leaves at the first tier that knows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.normalizers import party_name
from spanledger.session import cut_lineage

TIERS = ("exact", "normalised", "alias", "token_set")
SURE = ("exact", "normalised")  # tiers whose single hits need no confirmation


def token_set(plain: Column) -> Column:
    """The distinct words of a normalised name in order; null where there are none."""
    words = F.filter(F.array_sort(F.array_distinct(F.split(plain, "[^\\p{L}\\p{N}]+"))), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def registry_buckets(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, mentions, tier, registry_id, bucket): each distinct name of ``names`` (name) with its bucket.

    ``registry`` (registry_id, legal_name, aliases, active). Tiers ask for the legal name as written, normalised, for
    a normalised alias and for the same set of words. What a tier knows goes no further: its bucket is ``ambiguous`` where several
    entries answer, ``lapsed`` where the one that does is not active, ``exact`` for the first two tiers and ``candidate`` for the
    others; what no tier knows is ``unresolved``. A null or blank name is ``unresolved``. Mentions add up to the rows of ``names``.
    """
    told = names.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))
    plain = F.nullif(party_name(F.col("name")), F.lit(""))
    rest = cut_lineage(told.select("name", "mentions", F.nullif(F.trim("name"), F.lit("")).alias("exact"), plain.alias("normalised"), plain.alias("alias"), token_set(plain).alias("token_set")))
    legal = F.nullif(party_name(F.col("legal_name")), F.lit(""))
    entries = registry.select("registry_id", "active", F.trim("legal_name").alias("exact"), legal.alias("normalised"), token_set(legal).alias("token_set"), "aliases")
    also = registry.select("registry_id", "active", F.explode("aliases").alias("a")).select("registry_id", "active", F.nullif(party_name(F.col("a")), F.lit("")).alias("alias"))
    out = None
    for tier in TIERS:
        rows = (also if tier == "alias" else entries).where(F.col(tier).isNotNull())
        index = rows.groupBy(tier).agg(F.min("registry_id").alias("registry_id"), F.min("registry_id").eqNullSafe(F.max("registry_id")).alias("one"), F.max("active").alias("active"))
        met = cut_lineage(rest.join(cut_lineage(index), tier, "left"))
        bucket = F.when(~F.col("one"), "ambiguous").when(~F.coalesce("active", F.lit(False)), "lapsed").otherwise("exact" if tier in SURE else "candidate")
        hits = met.where("one is not null").select("name", "mentions", F.lit(tier).alias("tier"), F.when(F.col("one"), F.col("registry_id")).alias("registry_id"), bucket.alias("bucket"))
        out = hits if out is None else out.unionByName(hits)
        rest = met.where("one is null").drop("registry_id", "one", "active")
    last = rest.select("name", "mentions", F.lit(None).cast("string").alias("tier"), F.lit(None).cast(out.schema["registry_id"].dataType).alias("registry_id"), F.lit("unresolved").alias("bucket"))
    return out.unionByName(last)
