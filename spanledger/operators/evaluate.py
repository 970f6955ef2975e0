"""Scoring of extractions against labels, one row per contract and category.

Input rows hold ``answers`` (array of label texts) and ``items`` (array of structs
value, quote, found), both in their original order. All matching happens inside the
row; only counts are shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.functions import normalizers as N
from spanledger.functions.text import bound, normalize_ws, not_blank, strip
from spanledger.sources.dimensions import (
    DATE_CATEGORIES,
    NOT_SCORED_CATEGORIES,
    VALUE_CATEGORIES,
)

# Token overlap that makes two clause texts the same, the normal quantile
# of a 95 % interval, and the support below which a score says little.
MATCH_THRESHOLD = 0.5
Z95 = 1.96
FEW = 10

ITEM = "array<struct<value:string,quote:string,found:boolean>>"
STRINGS = "array<string>"


def _f1_of_sets(s: Column) -> Column:
    """F1 of the distinct tokens a and b of a struct; 0 when one is empty."""
    n = F.size(s["a"]) + F.size(s["b"])
    common = F.size(F.array_intersect(s["a"], s["b"])).cast("double")
    return F.when((F.size(s["a"]) > 0) & (F.size(s["b"]) > 0), common * 2 / n).otherwise(F.lit(0.0))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def token_f1(left: Column, right: Column) -> Column:
    """F1 over the distinct tokens of two normalised texts; 0 when one is empty."""
    return bound(F.struct(_tokens(left).alias("a"), _tokens(right).alias("b")), _f1_of_sets)


def texts_match(left: Column, right: Column, threshold: float = MATCH_THRESHOLD) -> Column:
    """Equal, or token F1 at the threshold; blank texts match nothing."""
    def judge(s: Column) -> Column:
        return (s["l"] != "") & (s["r"] != "") & (
            (s["l"] == s["r"]) | (token_f1(s["l"], s["r"]) >= threshold)
        )

    both = F.struct(normalize_ws(left).alias("l"), normalize_ws(right).alias("r"))
    return F.coalesce(bound(both, judge), F.lit(False))


def match_in_order(
    predictions: list[frozenset], labels: list[frozenset], threshold: float
) -> list[int]:
    """Index of the label each prediction takes, -1 for none: first come, first match.

    Labels are found by their tokens, so a prediction meets those alone that share one with it. ``threshold`` is above 0.
    """
    holders: dict[str, list[int]] = defaultdict(list)
    for index, tokens in enumerate(labels):
        for token in tokens:
            holders[token].append(index)
    taken: list[int] = []
    gone: set[int] = set()
    for tokens in predictions:
        shared = Counter(i for t in tokens for i in holders.get(t, ()) if i not in gone)
        fits = (i for i, n in shared.items() if 2.0 * n / (len(tokens) + len(labels[i])) >= threshold)
        hit = min(fits, default=-1)
        gone.add(hit)
        taken.append(hit)
    return taken


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy(predictions: pd.Series, labels: pd.Series) -> pd.Series:
    """Row-wise greedy matching of already normalised texts; depends on their order."""
    def one(p, g):
        if p is None or g is None:
            return []
        return match_in_order(
            [frozenset(t.split()) for t in p], [frozenset(t.split()) for t in g], MATCH_THRESHOLD
        )

    return pd.Series([one(p, g) for p, g in zip(predictions, labels)])


def greedy_matches(predictions: Column, labels: Column) -> Column:
    """Array: label index taken by each prediction text, -1 for none."""
    return _greedy(F.transform(predictions, normalize_ws), F.transform(labels, normalize_ws))


def party_sets(answers: Column) -> Column:
    """Array of struct(primary, names) for every party of a label cell."""
    def one(part: Column) -> Column:
        primary = N.party_name(part)
        own = F.when(
            (primary != "") & ~primary.isin(*N.GENERIC_PRIMARY_NAMES), F.array(primary)
        ).otherwise(F.array().cast(STRINGS))
        other = F.filter(N.party_aliases(part), lambda a: ~a.isin(*N.GENERIC_NAMES))
        return F.struct(primary.alias("primary"), F.array_distinct(F.concat(own, other)).alias("names"))

    parts = F.flatten(F.transform(F.filter(answers, not_blank), lambda a: F.split(a, ";")))
    return F.filter(F.transform(parts, one), lambda p: F.size(p["names"]) > 0)


def value_or_quote(item: Column) -> Column:
    v = F.coalesce(item["value"], F.lit(""))
    return F.when(v != "", v).otherwise(F.coalesce(item["quote"], F.lit("")))


def party_predictions(items: Column) -> Column:
    """Distinct party names in order of first mention, without generic words."""
    names = F.transform(items, lambda i: N.party_name(value_or_quote(i)))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.isin(*N.GENERIC_NAMES)))


def party_counts(predictions: Column, parties: Column, exact: bool = False) -> Column:
    """Struct tp, fp. A prediction takes the first free party it names. Naming a party
    that is already taken counts as neither, unless only primary names count."""
    def names_it(party: Column, name: Column) -> Column:
        return party["primary"] == name if exact else F.array_contains(party["names"], name)

    ids = F.sequence(F.lit(1), F.size(parties))
    ids = F.when(F.size(parties) > 0, ids).otherwise(F.array().cast("array<int>"))
    start = F.struct(
        F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"), F.lit(0).alias("fp")
    )

    def step(acc: Column, name: Column) -> Column:
        hits = F.filter(ids, lambda i: names_it(F.element_at(parties, i), name))
        free = F.array_except(hits, acc["used"])
        taken = F.size(free) > 0
        known = F.lit(False) if exact else F.size(hits) > 0
        return F.struct(
            F.when(taken, F.concat(acc["used"], F.slice(free, 1, 1))).otherwise(acc["used"]).alias("used"),
            (acc["tp"] + taken.cast("int")).alias("tp"),
            (acc["fp"] + (~taken & ~known).cast("int")).alias("fp"),
        )

    return F.aggregate(predictions, start, step, lambda a: F.struct(a["tp"], a["fp"]))


def value_counts(labels: Column, predictions: Column) -> Column:
    """Struct tp, fp for normalised values: distinct predictions, one label each."""
    tp = F.size(F.array_intersect(predictions, labels))
    return F.struct(tp.alias("tp"), (F.size(F.array_distinct(predictions)) - tp).alias("fp"))


def value_match(labels: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn per key for values held one per row in column v.

    Predictions count once per value; a value takes one label. Counting both sides
    per (key, value) first bounds what one key sends through the join.
    """
    have = labels.where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    said = predictions.where("v IS NOT NULL").select(*keys, "v").distinct().withColumn("said", F.lit(1))
    both = have.join(said, [*keys, "v"], "full")
    hit = F.col("n").isNotNull() & F.col("said").isNotNull()
    return both.groupBy(*keys).agg(
        F.count_if(hit).alias("tp"),
        F.count_if(F.col("said").isNotNull() & F.col("n").isNull()).alias("fp"),
        (F.sum(F.coalesce("n", F.lit(0))) - F.count_if(hit)).alias("fn"),
    )


def present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def contract_metrics(rows: DataFrame, parties: str = "alias-aware") -> DataFrame:
    """Adds the counts of one contract and category; see the module text for the input."""
    answers = F.coalesce("answers", F.array().cast(STRINGS))
    items = F.coalesce("items", F.array().cast(ITEM))
    trimmed = F.transform(
        items,
        lambda i: F.struct(
            strip(F.coalesce(i["value"], F.lit(""))).alias("value"),
            strip(F.coalesce(i["quote"], F.lit(""))).alias("quote"),
            F.coalesce(i["found"], F.lit(True)).alias("found"),
        ),
    )
    cat = F.col("category")
    kind = (
        F.when(cat.isin(*NOT_SCORED_CATEGORIES), "not_scored")
        .when(cat.isin(*VALUE_CATEGORIES), "value")
        .otherwise("clause")
    )
    empty = F.array().cast(STRINGS)
    no_parties = F.array().cast("array<struct<primary:string,names:array<string>>>")
    clause_row = F.col("category_type") == "clause"
    its, labels, quotes = F.col("__items"), F.col("__labels"), F.col("__quotes")

    # staged, so that no later expression repeats an earlier one
    base = rows.select(
        "contract", "category", kind.alias("category_type"), answers.alias("__answers"),
        trimmed.alias("__items"),
    )
    lists = base.withColumns(
        {
            "__labels": F.filter("__answers", not_blank),
            "__quotes": F.filter(F.transform(its, lambda i: i["quote"]), lambda q: q != ""),
        }
    )

    def normal(texts: Column) -> Column:
        """Comparable values of a date or law category."""
        value = lambda t: F.when(cat == "Governing Law", N.jurisdiction(t)).otherwise(N.calendar_date(t))
        by_value = cat.isin("Governing Law", *DATE_CATEGORIES)
        return F.when(by_value, present(F.transform(texts, value))).otherwise(empty)

    staged = lists.withColumns(
        {
            "__have": normal(labels),
            "__said": normal(F.transform(its, value_or_quote)),
            "__parties": F.when(cat == "Parties", party_sets(F.col("__answers"))).otherwise(no_parties),
            "__names": F.when(cat == "Parties", party_predictions(its)).otherwise(empty),
            # texts travel to the Arrow function for clause rows only
            "__taken": greedy_matches(
                F.when(clause_row, quotes).otherwise(empty), F.when(clause_row, labels).otherwise(empty)
            ),
        }
    )
    party = party_counts(F.col("__names"), F.col("__parties"), exact=parties == "exact-name")
    clause_tp = F.size(F.filter("__taken", lambda i: i >= 0))
    tp_fp = (
        F.when(cat == "Parties", party)
        .when(
            clause_row,
            F.struct(clause_tp.alias("tp"), (F.size(quotes) - clause_tp).alias("fp")),
        )
        .otherwise(value_counts(F.col("__have"), F.col("__said")))
    )
    n_labels = (
        F.when(cat == "Parties", F.size("__parties"))
        .when(clause_row, F.size(labels))
        .otherwise(F.size("__have"))
    )
    counted = staged.withColumns({"__c": tp_fp, "__n": n_labels})

    on = F.col("category_type") != "not_scored"
    has_label, has_said = F.size(labels) > 0, F.size(quotes) > 0
    # a clause prediction without a quote is not counted, also when it claims to be found
    seen = F.filter(its, lambda i: i["found"] & (~clause_row | (i["quote"] != "")))
    template = F.filter(its, lambda i: N.is_template(i["value"]) | N.is_template(i["quote"]))

    def flag(cond: Column) -> Column:
        return (clause_row & cond).cast("bigint")

    def scored(value: Column) -> Column:
        return F.when(on, value).otherwise(0).cast("bigint")

    return counted.select(
        "contract",
        "category",
        "category_type",
        scored(F.col("__c.tp")).alias("tp"),
        scored(F.col("__c.fp")).alias("fp"),
        scored(F.col("__n") - F.col("__c.tp")).alias("fn"),
        F.when(on, F.col("__n")).otherwise(F.size("__answers")).cast("bigint").alias("support"),
        flag(has_label & has_said).alias("presence_tp"),
        flag(~has_label & has_said).alias("presence_fp"),
        flag(has_label & ~has_said).alias("presence_fn"),
        flag(~has_label & ~has_said).alias("presence_tn"),
        scored(F.size(seen)).alias("quotes_found"),
        scored(F.size(its)).alias("quotes_total"),
        scored(F.size(template)).alias("template_values"),
    )


COUNTS = (
    "tp", "fp", "fn", "support", "presence_tp", "presence_fp", "presence_fn", "presence_tn",
    "quotes_found", "quotes_total", "template_values",
)


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty))


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, precision * 2.0 * recall / both).otherwise(F.lit(0.0))


def category_metrics(per_contract: DataFrame, keys: tuple[str, ...] = ("category", "category_type")) -> DataFrame:
    """Sums per category with precision, recall and F1. There is no score across categories."""
    sums = per_contract.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
    c = F.col
    out = sums.withColumns(
        {
            "precision": share(c("tp"), c("tp") + c("fp")),
            "recall": share(c("tp"), c("tp") + c("fn")),
            "presence_precision": share(c("presence_tp"), c("presence_tp") + c("presence_fp")),
            "presence_recall": share(c("presence_tp"), c("presence_tp") + c("presence_fn")),
            "quote_found_rate": share(c("quotes_found"), c("quotes_total"), 1.0),
        }
    )
    return out.withColumns(
        {
            "f1": f1(c("precision"), c("recall")),
            "presence_f1": f1(c("presence_precision"), c("presence_recall")),
        }
    )


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """Struct low, high of the Wilson interval; NULL for n = 0, an error unless 0 <= k <= n."""
    count, size = k.cast("double"), n.cast("double")
    p = count / size
    z2 = z * z
    scale = z2 / size + 1.0
    center = (p + z2 / (size * 2.0)) / scale
    spread = F.sqrt((p * (F.lit(1.0) - p)) / size + z2 / (size * size * 4.0)) * z / scale
    bad = (k < 0) | (n < 0) | (k > n)
    low = F.when(bad, F.raise_error(F.lit("need 0 <= k <= n")).cast("double")).otherwise(
        F.greatest(F.lit(0.0), center - spread)
    )
    return F.when(
        n != 0,
        F.struct(low.alias("low"), F.least(F.lit(1.0), center + spread).alias("high")),
    )


def too_few(category_type: Column, support: Column, presence_support: Column) -> Column:
    return (
        F.when(category_type == "clause", presence_support < FEW)
        .when(category_type == "value", (support > 0) & (support < FEW))
        .otherwise(F.lit(False))
    )


def with_intervals(metrics: DataFrame) -> DataFrame:
    """Adds Wilson bounds of the four shares and the too-few flag."""
    c = F.col
    pairs = {
        "precision": (c("tp"), c("tp") + c("fp")),
        "recall": (c("tp"), c("tp") + c("fn")),
        "presence_precision": (c("presence_tp"), c("presence_tp") + c("presence_fp")),
        "presence_recall": (c("presence_tp"), c("presence_tp") + c("presence_fn")),
    }
    bounds = {}
    for name, (k, n) in pairs.items():
        w = wilson(k, n)
        bounds[f"{name}_low"], bounds[f"{name}_high"] = w["low"], w["high"]
    bounds["too_few"] = too_few(
        c("category_type"), c("support"), c("presence_tp") + c("presence_fn")
    )
    return metrics.withColumns(bounds)


def mark_found(predictions: DataFrame, texts: DataFrame) -> DataFrame:
    """``found`` of every item from the contract text; without a text it stays as given.

    The categories of a contract, a handful, meet its text in one row: the text is
    shuffled and normalised once, not once per category.
    """
    per_contract = predictions.groupBy("contract").agg(
        F.collect_list(F.struct("category", "items")).alias("__cats")
    )
    normal = texts.where(F.length("contract_text") > 0).select(
        "contract", normalize_ws(F.col("contract_text")).alias("__text")
    )

    def judged(i: Column) -> Column:
        inside = not_blank(i["quote"]) & F.contains("__text", normalize_ws(i["quote"]))
        return F.struct(
            i["value"].alias("value"),
            i["quote"].alias("quote"),
            F.when(F.col("__text").isNull(), F.coalesce(i["found"], F.lit(True)))
            .otherwise(inside)
            .alias("found"),
        )

    cats = F.transform(
        "__cats",
        lambda c: F.struct(c["category"].alias("category"), F.transform(c["items"], judged).alias("items")),
    )
    met = per_contract.join(normal, "contract", "left").select("contract", F.explode(cats).alias("c"))
    return met.select("contract", "c.category", "c.items")


def align(labels: DataFrame, predictions: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels and predictions side by side, one row per contract and category."""
    key = ["contract", "category"]
    return labels.select(*key, "answers").join(mark_found(predictions, texts), key, "full")


def side_by_side(rows: DataFrame) -> DataFrame:
    """Report rows: the label and the prediction at each position, normalised, with the
    in-text flag; the shorter side is NULL. Every party of a label cell is a label of its own;
    labels without a name, a jurisdiction or a date in them are left out."""
    cat = F.col("category")
    answers = F.coalesce("answers", F.array().cast(STRINGS))
    items = F.coalesce("items", F.array().cast(ITEM))

    def shown(text: Column) -> Column:
        return (
            F.when(cat == "Parties", N.party_name(text))
            .when(cat == "Governing Law", N.jurisdiction(text))
            .when(cat.isin(*DATE_CATEGORIES), F.coalesce(N.calendar_date(text), text))
            .otherwise(normalize_ws(text))
        )

    names = F.transform(F.flatten(F.transform(answers, lambda a: F.split(a, ";"))), lambda n: N.party_name(n))
    laws, days = F.transform(answers, lambda a: N.jurisdiction(a)), F.transform(answers, lambda a: N.calendar_date(a))
    labels = (
        F.when(cat == "Parties", F.filter(names, lambda n: n != ""))
        .when(cat == "Governing Law", F.filter(laws, lambda n: n != ""))
        .when(cat.isin(*DATE_CATEGORIES), F.filter(days, lambda n: n.isNotNull()))
        .otherwise(F.transform(answers, lambda a: normalize_ws(a)))
    )
    zipped = F.arrays_zip(labels.alias("label"), items.alias("item"))
    flat = rows.select("contract", "category", F.posexplode(zipped).alias("position", "z"))
    label, item = F.col("z.label"), F.col("z.item")
    predicted = F.when(cat.isin(*VALUE_CATEGORIES), value_or_quote(item)).otherwise(item["quote"])
    return flat.select(
        "contract",
        "category",
        F.col("position").cast("bigint").alias("position"),
        label.alias("label"),
        F.when(item.isNotNull(), shown(predicted)).alias("prediction"),
        F.when(item.isNotNull(), item["found"]).alias("quote_in_text"),
    )


def question_metrics(metrics: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores of the categories behind each question; uncovered questions keep NULLs."""
    return questions.withColumn(
        "supported", F.col("fit").isin("direct", "partial")
    ).join(metrics, "category", "left")


def run_rates(chunks: DataFrame) -> DataFrame:
    """Per run: exclusion rate, chunk failure rate, token and cost totals.

    ``chunks``: run_id, contract, failed, input_tokens, output_tokens,
    cache_read_tokens, cost_millicents. A contract with a failed chunk is excluded.
    """
    per_contract = chunks.groupBy("run_id", "contract").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("failed").alias("bad"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cost_millicents")],
    )
    out = per_contract.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("contracts"),
        F.count_if(F.col("bad") > 0).alias("excluded"),
        F.sum("n").alias("chunks"),
        F.sum("bad").alias("failed_chunks"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cost_millicents")],
    )
    return out.withColumns(
        {
            "exclusion_rate": share(F.col("excluded"), F.col("contracts")),
            "chunk_failure_rate": share(F.col("failed_chunks"), F.col("chunks")),
        }
    )


# Share of valid answers a candidate model needs, and the failure classes.
SCHEMA_BAR = 0.95
FAILURES = ("not_found", "timeout", "gateway_timeout", "empty_output", "invalid_json", "quote_not_found")


def probe_scorecard(calls: DataFrame) -> DataFrame:
    """Per candidate model: shares, latency, failures, eligibility and rank.

    ``calls``: model_id, valid_schema, ok, latency_millis, quotes, quotes_found, failure.
    """
    sums = calls.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if("valid_schema").alias("n_valid"),
        F.count_if("ok").alias("n_ok"),
        F.sum("quotes").alias("quotes"),
        F.sum("quotes_found").alias("quotes_found"),
        F.sum(F.when(F.col("ok"), F.col("latency_millis")).otherwise(0)).alias("latency"),
        *[F.count_if(F.col("failure") == f).alias(f"failed_{f}") for f in FAILURES],
    )
    c = F.col
    scored = sums.withColumns(
        {
            "valid_schema_share": share(c("n_valid"), c("n_calls")),
            "quote_found_share": share(c("quotes_found"), c("quotes")),
            "avg_latency_millis": share(c("latency"), c("n_ok")),
        }
    ).withColumns(
        {
            "valid_verified_share": c("valid_schema_share")
            * F.when(c("quotes") > 0, c("quote_found_share")).otherwise(F.lit(1.0)),
            "eligible": c("valid_schema_share") >= SCHEMA_BAR,
        }
    )
    # a model that never answered sorts behind every measured latency
    speed = F.when(c("avg_latency_millis") > 0, c("avg_latency_millis")).otherwise(F.lit(999_000.0))
    best = scored.where("eligible").agg(
        F.min(
            F.struct(
                (-c("valid_verified_share")).alias("a"), (-c("quote_found_share")).alias("b"),
                speed.alias("c"), c("model_id"),
            )
        )["model_id"].alias("__winner")
    )
    return (
        scored.join(best, c("model_id") == c("__winner"), "left")
        .withColumn("selected", c("__winner").isNotNull())
        .drop("__winner", "latency")
    )


def split_leakage(rows: DataFrame) -> DataFrame:
    """Companies that occur in more than one split."""
    return (
        rows.select("company", "split").distinct().groupBy("company")
        .agg(F.count(F.lit(1)).alias("n_splits"))
        .where(F.col("n_splits") > 1)
    )


def split_sizes(rows: DataFrame) -> DataFrame:
    """Companies and rows per split."""
    return (
        rows.groupBy("split", "company").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("split").agg(F.count(F.lit(1)).alias("n_companies"), F.sum("n").alias("n_rows"))
    )


def sample_split(ids: DataFrame, key: str, n_test: int, n_dev: int, seed: str, dev_seed: str) -> DataFrame:
    """A fixed test sample and a disjoint development sample, by hash order.

    Two top-n selections; the whole table is never ranked in one task.
    """
    def draw(rows: DataFrame, n: int, salt: str, name: str) -> DataFrame:
        order = F.md5(F.concat(F.lit(salt), F.lit(":"), F.col(key).cast("string")))
        return rows.orderBy(order, key).limit(n).select(key, F.lit(name).alias("split"))

    keys = ids.select(key).distinct()
    test = draw(keys, n_test, seed, "test")
    rest = keys.join(test, key, "left_anti")
    return test.unionByName(draw(rest, n_dev, dev_seed, "dev"))


def next_chunks(
    documents: DataFrame, key: str, n_test: int, seed: str, n_documents: int, n_chunks: int, size: int
) -> DataFrame:
    """The first pieces of the first documents that follow the test sample in hash order."""
    order = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))
    first = documents.select(key, order.alias("o")).orderBy("o", key).limit(n_test + n_documents)
    reserved = first.orderBy("o", key).limit(n_test).select(key)
    chosen = first.join(reserved, key, "left_anti").select(key)
    rows = documents.join(chosen, key, "left_semi").select(
        key, "text", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk_index")
    )
    piece = F.substring("text", F.col("chunk_index") * size + 1, F.lit(size))
    return rows.select(key, F.col("chunk_index").cast("bigint").alias("chunk_index"), piece.alias("text")).where(
        F.col("text") != ""
    )
