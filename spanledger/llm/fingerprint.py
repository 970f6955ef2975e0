"""Document fingerprints: the least K hashes of a text's shingles, by DataFrame functions only.

A fingerprint is an array of distinct shingle hashes in ascending order, at most K of them; with
fewer it holds the whole set. Fingerprints of parts merge into that of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm import shingles as S
from spanledger.session import cut_lineage

K = 128
_LEAST = -(2**63)


def bottom(hashes: Column, k: int = K) -> Column:
    """The least ``k`` distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") - F.lit(float(_LEAST))) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1; two empty sets are alike."""
    both = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1; 1 for an empty first."""
    alike = resemblance(a, b, k)
    one, two = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), alike / (1 + alike) * (one + two) / one))


def merge_parts(parts: DataFrame, key: str, fingerprint: str, k: int = K) -> DataFrame:
    """One fingerprint for each ``key`` from those of its parts; null parts count as empty.

    The least ``k`` hashes of a key are taken by a ranked window, which Spark limits before the
    shuffle, so a key with very many parts sends little and no list of parts is gathered.
    """
    hashes = parts.select(key, F.explode_outer(fingerprint).alias("hash")).distinct()
    ranked = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("hash").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).groupBy(key).agg(F.sort_array(F.collect_list("hash")).alias(fingerprint))


def written(a: Column) -> Column:
    """A fingerprint as text: sixteen hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _follow(rows: DataFrame) -> DataFrame:
    """(key, before, half) for every key: the key whose next it is, and how much of it that takes.

    Keys are sorted over all tasks in ranges; a window inside each range finds the neighbour, and the
    first key of a range meets the last of the range before through one row for each range.
    """
    keys = rows.groupBy("key").agg(F.max("half").alias("half")).repartitionByRange(F.col("key").desc())
    keys = cut_lineage(keys.select("key", "half", F.spark_partition_id().alias("range")))
    within = Window.partitionBy("range").orderBy(F.col("key").desc())
    met = keys.select("key", "range", F.lag(F.struct("key", "half")).over(within).alias("prior"))
    ends = keys.groupBy("range").agg(F.min_by(F.struct("key", "half"), "key").alias("end"))
    across = Window.orderBy("range")
    last = ends.agg(F.max_by("end", "range").alias("last"))
    ends = ends.select("range", F.lag("end").over(across).alias("edge"))
    met = met.join(ends, "range").join(last)  # one row
    prior = F.coalesce("prior", "edge", "last")
    return met.select("key", prior["key"].alias("before"), prior["half"].alias("half"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row for every row of ``docs`` (doc_id, text). The edited text keeps all but the last
    floor(n_chars / 2) code points and goes on with the first as many of the next document: that of the
    next smaller doc_id, after the least that of the greatest. A doc_id with several texts stands in
    the order once, with the text of the least hash. A null doc_id comes last, and so does the least long, which counts as null; a null text is empty;
    an only document is its own next. Further columns are not read.

    Texts are shuffled once by doc_id; from there each sends its predecessor only the beginning
    that it takes over, and its fingerprint.
    """
    # both joins below take the same two columns, so that Spark shuffles them once
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = F.when(F.col("key") != _LEAST, F.col("key")).alias("doc_id")
    half = F.floor(F.char_length("text") / 2).cast("int")
    order = cut_lineage(_follow(rows.select("key", half.alias("half"))))

    sent = rows.join(order, "key").withColumn("tie", F.xxhash64("text"))
    sent = sent.select("before", "half", "key", "text", "tie", F.min("tie").over(Window.partitionBy("key")).alias("least")).where("tie = least")
    sent = sent.select("before", F.substring("text", F.lit(1), F.col("half")).alias("taken"), S.words(F.col("text")).alias("words"))
    sent = sent.select("before", "taken", S.shingles("words").alias("hashes")).select("before", "taken", bottom(F.col("hashes"), k).alias("next_sketch"))
    sent = sent.dropDuplicates(["before"]).withColumnRenamed("before", "key")

    met = rows.join(sent, "key").withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 2).cast("int")
    met = met.select(
        named, "n_chars", "next_sketch", S.words(F.col("text")).alias("words"),
        F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - tail).cast("int")), F.substring("taken", F.lit(1), tail)).alias("edited"),
    )
    met = met.select("doc_id", "n_chars", "next_sketch", S.shingles("words").alias("hashes"), F.sha2("edited", 256).alias("edited_sha256"), S.words(F.col("edited")).alias("words"))
    met = met.select("doc_id", "n_chars", "next_sketch", "edited_sha256", bottom(F.col("hashes"), k).alias("sketch"), S.shingles("words").alias("hashes"))
    met = met.select("doc_id", "n_chars", "next_sketch", "edited_sha256", "sketch", bottom(F.col("hashes"), k).alias("edited_sketch"))
    return met.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
