"""URL filter: rules first, then segmented host names scored by naive Bayes.

Hosts are concatenated words, so each name of a host (a run of letters) is split by a unigram Viterbi search. Its
word counts come from the text of all pages. Names are few beside pages: each distinct name is taken once, all its
substrings meet the counted words in a join, and one small search per name picks the likeliest words. A page's tokens
are the words of its host and of its path; multinomial naive Bayes over BUCKETS hashed tokens, counted over all
pages, decides. It learns from ``topics``: a page that has one of these words among its tokens counts as blocked, the
others as allowed, so that words which keep such company (as ``pills`` with ``cheap``) come to count as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.session import cut_lineage

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# Topics that a training corpus leaves out.
TOPICS = ("ads", "adult", "bet", "bets", "bingo", "casino", "escort", "jackpot", "lottery", "pills", "poker", "porn", "slots", "spam", "viagra", "xxx")

LONGEST_WORD = 24  # letters of the longest word of the vocabulary
PIECE = 256  # a longer name is segmented in pieces of so many letters, four times what a host name may have
SHORT = 3  # words of so many letters a-z are at most 18,278 and travel with the search instead of joining
BUCKETS = 1 << 16
TOPIC_SHARE = 2e-4  # a topic counts as so common a word at least
SMOOTHING = 0.1  # added to every count of a bucket that some page has

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.char_length(host) + F.lit(1), F.char_length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _A, _Z), F.lit("")), F.coalesce(path, F.lit(""))


def by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equal ones, block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # the last one asked is outermost
        name, _, rest = text.partition("/")
        fits = ((host == name.translate(str.maketrans(_A, _Z))) | host.endswith("." + name.translate(str.maketrans(_A, _Z)))) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def letters(text: Column) -> Column:
    """Runs of letters, lower-cased, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def word_counts(texts: Column, rows: DataFrame) -> DataFrame:
    """(word, n): how often each word of at most LONGEST_WORD letters occurs outside scripts, styles and tags."""
    plain = F.regexp_replace(texts, r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z]+;", " ")
    return rows.select(F.explode(letters(plain)).alias("word")).where(F.char_length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _search(name: str, cost: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The cheapest split of a name; ``cost`` holds known words by (start, length). A stretch without known words
    costs ``unknown`` and ten times the odds of each letter; of equal splits the one with the longer last word."""
    best, step = [0.0], [0]
    for end in range(1, len(name) + 1):
        found = (math.inf, 0)
        for size in range(min(end, LONGEST_WORD), 0, -1):
            word = cost.get((end - size, size))
            price = best[end - size] + (unknown + size * _TEN if word is None else word)
            if price < found[0]:
                found = (price, size)
        best.append(found[0])
        step.append(found[1])
    words, at = [], len(name)
    while at:
        words.append(name[at - step[at] : at])
        at -= step[at]
    return words[::-1]


_TEN = math.log(10)


def segmented(names: DataFrame, counts: DataFrame, topics: Sequence[str] = TOPICS) -> DataFrame:
    """(name, words) for the distinct names of ``names`` (name); ``counts`` (word, n) is a written table."""
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    unknown = math.log(total) - _TEN
    short = {r.word: math.log(total / r.n) for r in counts.where(F.col("word").rlike(f"^[a-z]{{1,{SHORT}}}$")).collect()}  # at most 18,278
    size = F.char_length("name")
    cut = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / PIECE).cast("int")), lambda i: F.struct(i.alias("nth"), F.col("name").substr(i * PIECE + 1, F.lit(PIECE)).alias("piece")))
    pieces = cut_lineage(names.where(size > 0).distinct().select("name", F.inline(cut)))
    long = F.char_length("piece")
    spots = pieces.select("name", "nth", "piece", F.explode(F.sequence(F.lit(1), long)).alias("start"))
    most = F.least(F.lit(LONGEST_WORD), long - F.col("start") + 1)
    parts = spots.where(most > 0).select("name", "nth", "start", F.explode(F.sequence(F.lit(1), most)).alias("size"), "piece")
    parts = parts.select("name", "nth", "start", "size", F.expr("substr(piece, start, size)").alias("word")).where(~F.col("word").rlike(f"^[a-z]{{1,{SHORT}}}$"))
    met = parts.join(counts.where(~F.col("word").rlike(f"^[a-z]{{1,{SHORT}}}$")), "word")
    held = met.groupBy("name", "nth").agg(F.collect_list(F.struct("start", "size", "n")).alias("found"))  # bounded by PIECE x LONGEST_WORD
    joined = pieces.join(held, ["name", "nth"], "left").select("name", "nth", "piece", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                cost = {(f["start"] - 1, f["size"]): math.log(total / f["n"]) for f in found or ()}
                for at in range(len(piece)):
                    for n in range(1, SHORT + 1):
                        if (word := piece[at : at + n]) in short and at + n <= len(piece):
                            cost[at, n] = short[word]
                for topic in topics:
                    at = piece.find(topic)
                    while at >= 0:
                        cost[at, len(topic)] = min(-math.log(TOPIC_SHARE), cost.get((at, len(topic)), math.inf))
                        at = piece.find(topic, at + 1)
                out.append(_search(piece, cost, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["name", "nth", "words"])

    split = joined.mapInArrow(run, "name string, nth int, words array<string>")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("nth", "words"))), lambda x: x["words"])
    return split.groupBy("name").agg(F.flatten(in_order).alias("words"))


def tokens(rows: DataFrame, counts: DataFrame, topics: Sequence[str] = TOPICS) -> DataFrame:
    """``rows`` (host, path, ...) with ``tokens``: the words of the host's names, then those of the path."""
    hosts = cut_lineage(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    named = hosts.select("host", F.posexplode(letters(F.col("host"))).alias("at", "name"))
    words = cut_lineage(segmented(named.select("name"), counts, topics))
    told = named.join(words, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    told = cut_lineage(told)
    none = F.array().cast("array<string>")
    return rows.join(told, "host", "left").withColumn("tokens", F.concat(F.coalesce("host_words", none), letters(F.col("path")))).drop("host_words")


def naive_bayes(rows: DataFrame, topics: Sequence[str], buckets: int = BUCKETS) -> tuple[float, np.ndarray]:
    """(odds, weight per bucket) in logs, from ``rows`` (tokens): smoothed multinomial naive Bayes over hashed tokens.

    Without a page of either kind nothing tells them apart: every page is allowed.
    """
    bad = F.arrays_overlap("tokens", F.array(*map(F.lit, topics))) if topics else F.lit(False)
    marked = rows.select(F.coalesce(bad, F.lit(False)).cast("int").alias("bad"), "tokens")
    pages = {r.bad: r.n for r in marked.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    said = marked.select("bad", F.explode("tokens").alias("token"))
    bucket = (F.crc32(F.col("token").cast("binary")) % buckets).alias("bucket")
    found = said.groupBy(bucket).agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()  # at most ``buckets`` rows
    counts = np.zeros((2, buckets))
    for r in found:
        counts[:, r.bucket] = r.good, r.bad
    if not pages.get(0) or not pages.get(1):
        return -math.inf, np.zeros(buckets)
    seen = counts.sum(0) > 0
    share = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * seen.sum()))
    return math.log(pages[1] / pages[0]), np.where(seen, share[1] - share[0], 0.0)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, topics: Sequence[str] = TOPICS, buckets: int = BUCKETS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url, html).

    ``verdict`` is that of the longest rule that fits, else ``block`` where the log-odds ``score`` of naive Bayes are
    above 0, else ``allow``. ``rules`` and ``topics`` are short lists of the caller. A null url, or one without ``://``, has
    an empty host and path, fits no rule and is judged by the shares alone. A null html adds no words; a null page_id is
    kept. Repeated rows are counted and judged each. An empty table gives no rows. Further columns are not read.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    counts = cut_lineage(word_counts(F.col("html").cast("string"), pages))
    told = cut_lineage(tokens(rows, counts, topics))
    odds, weight = naive_bayes(told, topics, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores = []
            for words in batch.column(3).to_pylist():
                total = odds
                for w in words:
                    if (v := known.get(w)) is None:
                        if len(known) > 200_000:
                            known.clear()
                        v = known[w] = float(weight[crc32(w.encode()) % buckets])
                    total += v
                scores.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.float64())], ["page_id", "host", "path", "score"])

    kind = told.schema["page_id"].dataType.simpleString()
    scored = told.select("page_id", "host", "path", "tokens").mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")


def without_blocked(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, topics: Sequence[str] = TOPICS) -> DataFrame:
    """The rows of ``pages``, all columns, that ``judged`` allows; page_ids must be unique and not null."""
    allowed = judged(pages, rules, topics).where("verdict = 'allow'").select(F.col("page_id").alias("__allowed"))
    return pages.join(allowed, F.col("page_id") == F.col("__allowed"), "left_semi")
