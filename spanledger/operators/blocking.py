"""Candidate pairs of names: equal ones, those that sound alike, those that share most trigrams.

Equal names and names of one sound are blocks, told as membership: each member with its block's least id, so a block
of any size costs one row a member. Trigram pairs are found by prefixes: with trigrams in order of rarity, two names of Jaccard
similarity t or more share one of their rarest size - ceil(t * size) + 1, the smaller name of the two even one of its rarest
size - ceil(2t / (1 + t) * size) + 1. Where the rarest one they share is frequent, all that they share are, and then two of them
lie in the prefixes that are one longer: frequent trigrams count in twos, which are rarer, and none is dropped. Names that meet
are first told apart by sizes, by the place of the key and by 128 bits; the trigrams of the pairs left are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.session import cut_lineage

SIMILAR = 0.5
SLACK = 1e-9  # what a bound may be off by rounding
FREQUENT = 1000  # names that hold a trigram, beyond which it counts in twos only

# Consonants that sound alike have one digit; other letters have none.
CONSONANTS, SOUNDS = "bfpvcgjkqsxzdtlmnraeiouyhw", "111122222222334556"


def normal(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name.cast("string"), r"\s+", " ")))


def sound(plain: Column) -> Column:
    """Each word's first letter and the sounds of its other consonants, runs of one sound once."""
    words = F.filter(F.split(plain, "[^a-z]+"), lambda w: w != "")
    told = F.transform(words, lambda w: F.concat(w.substr(1, 1), F.regexp_replace(F.translate(w.substr(F.lit(2), F.length(w)), CONSONANTS, SOUNDS), r"(.)\1+", "$1")))
    return F.array_join(told, " ")


def trigrams(plain: Column) -> Column:
    """The distinct runs of three characters of the name with two blanks before and one behind it."""
    padded = F.concat(F.lit("  "), plain, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_pairs(names: DataFrame, threshold: float = SIMILAR, frequent: int = FREQUENT) -> DataFrame:
    """(tenant_id, id_a, id_b, score): pairs of ``names`` (tenant_id, id, plain), distinct in ``plain``, of Jaccard
    similarity ``threshold`` or more."""
    # names are numbered, so that what meets is told by two numbers
    held = cut_lineage(names.select("tenant_id", "id", trigrams(F.col("plain")).alias("grams")).withColumn("num", F.monotonically_increasing_id()))
    counts = cut_lineage(held.select("tenant_id", F.explode("grams").alias("gram")).groupBy("tenant_id", "gram").agg(F.count(F.lit(1)).alias("n")))
    spread = held.select("tenant_id", "num", F.explode("grams").alias("gram")).join(counts, ["tenant_id", "gram"])
    # a name's own trigrams only
    ordered = spread.groupBy("tenant_id", "num").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    bits = [_bits("g", half).alias(f"bits{half}") for half in range(2)]
    ordered = cut_lineage(ordered.select("tenant_id", "num", F.size("g").alias("size"), F.transform("g", lambda x, i: F.struct(x["n"].alias("n"), x["gram"].alias("gram"), (i + 1).alias("at"))).alias("g"), *bits))
    # of two names the smaller one, of equal sizes the one numbered first, holds at least this share of itself in common
    small, large = (cut_lineage(_keyed(ordered, share, frequent)) for share in (2 * threshold / (1 + threshold), threshold))
    a, b = (side.select("tenant_id", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("num", "size", "at", "bits0", "bits1"))) for side, s in ((small, "a"), (large, "b")))
    both = F.col("size_a") + F.col("size_b")
    first = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("num_a") < F.col("num_b")))
    # what is shared from the first key on: the key's own trigrams and at most all behind it
    most = F.when(F.length("key") == 3, 1).otherwise(2) + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    apart = F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))) + F.bit_count(F.col("bits1_a").bitwiseXOR(F.col("bits1_b")))
    may = (F.col("size_a") >= threshold * F.col("size_b") - SLACK) & (most * (1 + threshold) >= threshold * both - SLACK) & (apart * (1 + threshold) <= (1 - threshold) * both + SLACK)
    met = cut_lineage(a.join(b, ["tenant_id", "key"]).where(first & may).select("num_a", "num_b").distinct())
    for s in "ab":
        met = met.join(held.select(*(F.col(c).alias(f"{c}_{s}") for c in ("num", "id", "grams")), *(["tenant_id"] if s == "a" else [])), f"num_{s}")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    score = shared / (F.size("grams_a") + F.size("grams_b") - shared)
    scored = met.select("tenant_id", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), score.alias("score"))
    return scored.where(F.col("score") >= threshold)


def _bits(grams: str, half: int) -> Column:
    """64 bits of a name's trigrams, each of which sets one of the 128 of both halves: two names differ in at least as many
    trigrams as in bits."""
    def place(x: Column) -> Column:
        return F.pmod(F.xxhash64(x["gram"]), F.lit(128)).cast("int")

    def told(acc: Column, x: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place(x) % 64)
        return F.when(F.floor(place(x) / 64) == half, acc.bitwiseOR(bit)).otherwise(acc)

    return F.aggregate(grams, F.lit(0).cast("bigint"), told)


def _keyed(ordered: DataFrame, share: float, frequent: int) -> DataFrame:
    """Each name with the keys of its rarest trigrams, for partners with whom it shares ``share`` of itself or more.

    ``at`` is the place of the key's last trigram in the name's order.
    """
    size = F.col("size")
    least = F.ceil(size * share - SLACK).cast("int")
    one, two = F.slice("g", F.lit(1), size - least + 1), F.slice("g", F.lit(1), F.least(size, size - least + 2))
    rare = F.transform(F.filter(one, lambda x: (x["n"] <= frequent) | (least <= 1)), lambda x: F.struct(x["gram"].alias("key"), x["at"].alias("at")))
    held = ordered.withColumn("rare", rare).withColumn("often", F.filter(two, lambda x: x["n"] > frequent))
    twos = F.flatten(F.transform("often", lambda x, i: F.transform(F.slice("often", i + 2, F.size("often")), lambda y: F.struct(F.concat(x["gram"], y["gram"]).alias("key"), y["at"].alias("at")))))
    return held.select("tenant_id", "num", "size", "bits0", "bits1", F.inline(F.concat("rare", twos)))


def candidates(names: DataFrame, threshold: float = SIMILAR, frequent: int = FREQUENT) -> DataFrame:
    """(tenant_id, strategy, id_a, id_b, score) for ``names`` (tenant_id, id, name), ids distinct, of one tenant each.

    ``exact``: id_b's normalised name is that of id_a, the least id of that name. ``phonetic``: the names of two least ids sound
    alike; id_a is the least id of that sound. ``trigram``: all pairs of least ids with similar names, with their Jaccard similarity.
    Null and blank names have no partners; names without a letter a-z have no sound.
    """
    told = cut_lineage(names.select("tenant_id", "id", normal(F.col("name")).alias("plain")).where("id is not null and plain <> ''"))
    units = cut_lineage(told.groupBy("tenant_id", "plain").agg(F.min("id").alias("first")))
    exact = told.join(units, ["tenant_id", "plain"]).where(F.col("id") != F.col("first")).select("tenant_id", F.lit("exact").alias("strategy"), F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("score"))
    voiced = cut_lineage(units.select("tenant_id", "first", sound(F.col("plain")).alias("sound")).where("sound <> ''"))
    least = cut_lineage(voiced.groupBy("tenant_id", "sound").agg(F.min("first").alias("id_a")))
    phonetic = voiced.join(least, ["tenant_id", "sound"]).where(F.col("first") != F.col("id_a")).select("tenant_id", F.lit("phonetic").alias("strategy"), "id_a", F.col("first").alias("id_b"), F.lit(1.0).alias("score"))
    near = trigram_pairs(units.select("tenant_id", F.col("first").alias("id"), "plain"), threshold, frequent)
    return exact.unionByName(phonetic).unionByName(near.withColumn("strategy", F.lit("trigram")))
