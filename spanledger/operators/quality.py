"""How good a resolution, a labelling and a set of facts are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.operators.interval_join import overlapping
from spanledger.session import cut_lineage


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(1.0)


def resolution_quality(clusters: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per tenant: how ``clusters`` (tenant_id, mention_id, cluster_id) agree with ``gold`` (tenant_id, mention_id, entity_id).

    Pair counts come from the sizes of cells (cluster, entity), clusters and entities as n * (n - 1) / 2; no pair is made.
    ``over_merged`` counts clusters of two or more entities, ``split`` entities over two or more clusters. B-cubed precision
    of a mention is its cell's share of its cluster, recall its cell's share of its entity. Mentions that only one
    table holds do not count; a mention has one cluster and one entity.
    """
    met = clusters.select("tenant_id", "mention_id", "cluster_id").join(gold.select("tenant_id", "mention_id", "entity_id"), ["tenant_id", "mention_id"])
    cells = met.groupBy("tenant_id", "cluster_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    def by(key: str) -> DataFrame:
        """Of each group its mentions, its cells and their squares, one row a tenant."""
        one = cells.groupBy("tenant_id", key).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        return one.groupBy("tenant_id").agg(
            F.count(F.lit(1)).alias(f"{key}_groups"), F.sum(_pairs(F.col("size"))).alias(f"{key}_pairs"),
            F.sum((F.col("cells") > 1).cast("long")).alias(f"{key}_mixed"), F.sum(F.col("squares") / F.col("size")).alias(f"{key}_cubed"),
        )

    whole = cells.groupBy("tenant_id").agg(F.sum("n").alias("mentions"), F.sum(_pairs(F.col("n"))).alias("same"))
    t = whole.join(by("cluster_id"), "tenant_id").join(by("entity_id"), "tenant_id")
    precision, recall = _share(F.col("same"), F.col("cluster_id_pairs")), _share(F.col("same"), F.col("entity_id_pairs"))
    return t.select(
        "tenant_id", "mentions", F.col("cluster_id_groups").alias("clusters"), F.col("entity_id_groups").alias("entities"),
        F.col("same").cast("long").alias("true_pairs"), F.col("cluster_id_pairs").cast("long").alias("made_pairs"), F.col("entity_id_pairs").cast("long").alias("gold_pairs"),
        precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        F.col("cluster_id_mixed").alias("over_merged"), (F.col("cluster_id_mixed") / F.col("cluster_id_groups")).alias("over_merge_rate"),
        F.col("entity_id_mixed").alias("split"),
        (F.col("cluster_id_cubed") / F.col("mentions")).alias("b_cubed_precision"), (F.col("entity_id_cubed") / F.col("mentions")).alias("b_cubed_recall"),
    )


ANSWER = ["document_id", "question_id"]


def answer_pairs(answers: DataFrame, first: str, second: str) -> DataFrame:
    """Answers of two labellers to one question of one document whose quotes overlap: (keys, answer ids, same)."""
    def of(labeller: str, side: str) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{side}") for c in ("answer_id", "value", "start_offset", "end_offset")]
        return answers.where(F.col("labeller") == labeller).select(*ANSWER, *columns)

    spans = [(F.col(f"start_offset_{s}").cast("long"), F.col(f"end_offset_{s}").cast("long")) for s in "ab"]
    met = overlapping(of(first, "a"), of(second, "b"), ANSWER, *spans)
    return met.withColumn("same", F.col("value_a").eqNullSafe(F.col("value_b")))


# candidates a row may meet on average before a question's answers are dealt by their places
MET = 200


def _cells(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("question_id", "value_a", "value_b").agg(F.count(F.lit(1)).alias("n"))


def _judged_by_pairs(told: DataFrame, pairs: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """(answers with ``same``, numbers of pairs of values) from the pairs of overlapping answers."""
    hits = [pairs.select(*ANSWER, F.lit(who).alias("labeller"), F.col(f"answer_id_{side}").alias("answer_id"), "same") for who, side in ((first, "a"), (second, "b"))]
    best = hits[0].unionByName(hits[1]).groupBy(*ANSWER, "labeller", "answer_id").agg(F.max("same").alias("same"))
    return told.join(best, [*ANSWER, "labeller", "answer_id"], "left"), _cells(pairs)


def _judged_in_place(told: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """The same where the answers to one question of one document are few: each row moves once, to those of its question."""
    rows = told.withColumn("__row", F.monotonically_increasing_id()).repartition(*ANSWER)
    columns = ["answer_id", "value", "start_offset", "end_offset"]

    def of(who: str, side: str) -> DataFrame:
        return rows.where(F.col("labeller") == who).select(*ANSWER, *(F.col(c).alias(f"{c}_{side}") for c in columns))

    def judged(who: str, other: str) -> DataFrame:
        mine, theirs = rows.where(F.col("labeller") == who), of(other, "b").withColumnsRenamed({c: f"__{c}" for c in ANSWER})
        on = (F.col("document_id") == F.col("__document_id")) & (F.col("question_id") == F.col("__question_id"))
        met = mine.join(theirs, on & _overlap([F.col(c) for c in columns[2:]], [F.col(f"{c}_b") for c in columns[2:]]), "left")
        # no right row has a null key, so its presence tells a match
        same = F.when(F.col("__document_id").isNotNull(), F.col("value").eqNullSafe(F.col("value_b")))
        each = met.groupBy(*ANSWER, "labeller", *columns, "__row").agg(F.max(same).alias("same"))
        # rows that share an id share what was found; those without an id have found nothing
        shared = F.max("same").over(Window.partitionBy(*ANSWER, "answer_id"))
        return each.withColumn("same", F.when(F.col("answer_id").isNotNull(), shared)).select(*told.columns, "same")

    spans = [[F.col(f"{c}_{side}") for c in columns[2:]] for side in "ab"]
    met = of(first, "a").join(of(second, "b"), ANSWER).where(_overlap(*spans))
    return judged(first, second).unionByName(judged(second, first)), _cells(met)


def _overlap(one: Sequence[Column], two: Sequence[Column]) -> Column:
    """Two spans share a place; empty spans and those without a start or an end share none."""
    (start, end), (begin, stop) = ([c.cast("long") for c in span] for span in (one, two))
    return (start < end) & (begin < stop) & (start < stop) & (begin < end)


def agreement(answers: DataFrame, first: str, second: str, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary per question, answers without a match) of two labellers.

    ``answers`` (document_id, question_id, labeller, answer_id, value, start_offset, end_offset) hold one row an answer. One
    matches where the other labeller's answer has the same value and an overlapping quote. ``agreement`` is the share of
    matching answers of both, ``span_agreement`` that of answers that some quote of the other overlaps; ``kappa`` sets the share of
    overlapping pairs of equal value against the share expected from how often each labeller gives each value in such
    pairs, null where nothing overlaps or chance alone is sure. Answers without a span overlap nothing.

    Where answers to one question of one document are few, they all meet in one task; those of others meet by their places. ``answers``
    is read several times, so it should be a written table.
    """
    told = answers.where(F.col("labeller").isin(first, second)).select(*ANSWER, "labeller", "answer_id", "value", "start_offset", "end_offset")
    if pairs is not None or first == second:
        judged, cells = _judged_by_pairs(told, answer_pairs(answers, first, second) if pairs is None else pairs, first, second)
    else:
        mine, theirs = (F.count_if(F.col("labeller") == who) for who in (first, second))
        sizes = told.groupBy(F.xxhash64(*ANSWER).alias("__key")).agg(mine.alias("a"), theirs.alias("b"))
        crowded = cut_lineage(sizes.where(F.col("a") * F.col("b") > MET * (F.col("a") + F.col("b"))).select("__key"))
        if crowded.isEmpty():
            judged, cells = _judged_in_place(told, first, second)
        else:
            rare, many = (told.withColumn("__key", F.xxhash64(*ANSWER)).join(crowded, "__key", how).drop("__key") for how in ("left_anti", "left_semi"))
            many = cut_lineage(many)
            parts = [_judged_in_place(rare, first, second), _judged_by_pairs(many, answer_pairs(many, first, second), first, second)]
            judged, cells = (one.unionByName(two) for one, two in zip(*parts, strict=True))
            cells = cells.groupBy("question_id", "value_a", "value_b").agg(F.sum("n").alias("n"))
    met, same = F.col("same").isNotNull().cast("int"), F.coalesce(F.col("same"), F.lit(False)).cast("int")
    counts = judged.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("answers"), F.sum(same).alias("matching"), F.avg(same).alias("agreement"), F.avg(met).alias("span_agreement"),
    )
    totals = cells.groupBy("question_id").agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("value_a").eqNullSafe(F.col("value_b")), F.col("n")).otherwise(0)).alias("equal"))
    a = cells.groupBy("question_id", F.col("value_a").alias("value")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(F.col("question_id").alias("q"), F.col("value_b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, (F.col("question_id") == F.col("q")) & F.col("value").eqNullSafe(F.col("v"))).groupBy("question_id").agg(F.sum(F.col("na") * F.col("nb")).alias("by_chance"))
    t = totals.join(chance, "question_id", "left")
    expected = F.coalesce("by_chance", F.lit(0)) / (F.col("pairs") * F.col("pairs"))
    t = t.select("question_id", "pairs", F.when(expected < 1, (F.col("equal") / F.col("pairs") - expected) / (1 - expected)).alias("kappa"))
    summary = counts.join(t, "question_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return summary, judged.where(~F.coalesce(F.col("same"), F.lit(False))).withColumn("reason", F.when(F.col("same").isNull(), "no_overlap").otherwise("other_value")).drop("same")


def grounding_rates(items: DataFrame, chunks: DataFrame, ontology: DataFrame) -> DataFrame:
    """Per tenant the share of ``items`` (tenant_id, chunk_id, start_offset, end_offset, quote, entity_type) whose quote stands at its
    place in its chunk's text, and of those whose type the tenant's ``ontology`` (tenant_id, entity_types) allows.

    A missing chunk, offset or quote is not grounded; an empty list of types allows all, no list none. Texts meet the items in
    one join by chunk.
    """
    texts = chunks.select("tenant_id", "chunk_id", F.col("text").alias("__text"))
    allowed = ontology.select("tenant_id", F.col("entity_types").alias("__types"))
    at = F.substring("__text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    grounded = F.coalesce((at == F.col("quote")) & (F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset")), F.lit(False))
    conforms = F.coalesce((F.size("__types") == 0) | F.array_contains("__types", F.col("entity_type")), F.lit(False)) & F.col("__types").isNotNull()
    met = items.join(texts, ["tenant_id", "chunk_id"], "left").join(allowed, "tenant_id", "left")
    return met.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(grounded.cast("long")).alias("grounded"), F.avg(grounded.cast("int")).alias("grounding_rate"),
        F.sum(conforms.cast("long")).alias("conforming"), F.avg(conforms.cast("int")).alias("conformance_rate"),
    )
