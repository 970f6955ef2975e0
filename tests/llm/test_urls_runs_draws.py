"""URL verdicts, periodic runs and importance draws against brute force, with the odd cases: nulls, empty and long texts,
ties, repeated rows, further columns with clashing names, no rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm import importance, periods, queries, urls

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "la " * 30), (1004, "la " * 30), (1005, "a b c d " * 500 + "\u00a0x"), (None, "x y " * 40), (1006, "word " * 30000)]


# periodic runs


def plain_runs(words):
    n, found = len(words), {}
    code = {}
    ids = np.array([code.setdefault(w, len(code)) for w in words], int)
    for p in range(1, n // 4 + 1):
        same = np.concatenate([[0], (ids[p:] == ids[:-p]).astype(int), [0]])
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + p >= max(6, 4 * p):
                found.setdefault((a, b - a + p), p)  # the least period comes first
    return sorted((s, length, p) for (s, length), p in found.items())


def plain_digest(doc_id, text):
    w = re.findall("[^ \t-\r]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        w = [w[i] if i < a else w[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, *sha)


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    return given.withColumns({c: F.lit(7) for c in ("n", "start", "period", "length", "bucket", "score", "rank", "weight", "__place", "__part")}).cache()


def test_runs_of_documents(docs):
    got = sorted(map(tuple, periods.run_digests(docs, periods.planted).collect()), key=repr)
    want = sorted((plain_digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert got == want and sum(r[1] > 0 for r in got) > 20


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_short_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
        w = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 13)
            w = [w[i] if i < a else w[a + (i - a) % min(p, n - a)] for i in range(n)]
            w[rng.randrange(n)] = rng.choice(w)
        assert sorted(tuple(r) for r in periods.runs_of(w)) == plain_runs(w)


def test_last_places_of_suffixes():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 30))]
        seen = periods.LastSeen()
        for i, x in enumerate(w):
            want = {}
            for size in range(1, i + 1):
                e = next((e for e in range(i - 1, size - 2, -1) if w[e - size + 1 : e + 1] == w[i - size + 1 : i + 1]), None)
                if e is None:
                    break
                want[e] = size
            assert {e: size for e, size in seen.append(x) if size} == want


def test_runs_table_and_collapsed_texts(spark, docs):
    listed = collections.Counter(map(tuple, periods.periodic_runs(docs).collect()))
    rows = docs.select("doc_id", "text").collect()
    assert listed == collections.Counter((r.doc_id, *x) for r in rows for x in plain_runs((r.text or "").encode().split()))
    kept = periods.without_repetition(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1000] is None and texts[1001] == "" and texts[1004] == "la" and texts[1005] == "a b c d \u00a0x" and texts[1006] == "word" and texts[None] == "x y"


def test_runs_cost_grows_with_the_length():
    base = [b"%d" % random.Random(5).randrange(9000) for _ in range(20000)]
    assert [tuple(r) for r in periods.runs_of(base * 6)] == plain_runs(base * 6)
    with pytest.raises(ValueError):
        periods.runs_of([b"a"], least_periods=2)


# importance draws


def test_words_and_chained_checksums():
    text = "Été--2 A_b\x7fC\x00中文 x".encode()
    w = importance.words(text)
    assert w == [x.encode() for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.decode().translate({c: c + 32 for c in range(65, 91)}))]
    for longest in (1, 2, 3):
        want = collections.Counter(zlib.crc32(b" ".join(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
        assert importance.checksums(w, longest) == want


@pytest.mark.parametrize("longest", [1, 2])
def test_draws(spark, docs, longest):
    target = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").union(spark.createDataFrame([(None,)], "text string"))

    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    rows = [(r.doc_id, *features(r.text)) for r in docs.select("doc_id", "text").collect()]
    s = collections.Counter(b for r in rows for b in r[2])
    t = collections.Counter(b for r in target.collect() for b in features(r.text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    want = []
    for d, n, held in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in held)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append((d, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    want = [(*r[:4], i + 1 if i < len(able) // 10 else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in want if r[4] < 20]
    got = importance.resample(docs, target, longest=longest)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(r[4] for r in want if r[4]) == list(range(1, len(able) // 10 + 1))


def test_order_of_a_key_held_by_many(spark):
    """A third of the rows tie in every key; places are all different and follow the order."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("score"), F.floor(F.col("id") / 2).alias("doc_id"))
    got = importance.ranked(rows, F.col("score").desc(), F.col("doc_id")).collect()
    got.sort(key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(1, 3001)) and [(r.score, r.doc_id) for r in got] == sorted(((r.score, r.doc_id) for r in got), key=lambda r: (-r[0], r[1]))


def test_sampled_rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    drawn = {r.doc_id for r in importance.resample(given, target).where("rank is not null").collect()}
    kept = importance.sampled(given, target)
    assert kept.columns == given.columns and {r.doc_id for r in kept.collect()} == drawn and drawn


# URL verdicts

URLS = ["https://www.Example.com/en/1?x=/y", "http://example.com/en", "http://example.com/en/", "http://xexample.com/en/a", "ftp://a.net/es/#f", "net/es/", None, "", "://", "http://com", "http://com/", "http://com?/a",
        "http://m.example.net/fr/x", "http://EXAMPLE.net/FR/x", "http://spamfarm.example.org/en/", "http://bestcasinowin.example.org/", "x://y://z/net/es/", "http://münchen.example.org/straße/12", "http://" + "the" * 300 + ".org/", "http://a.example.org:80/fr/"]


@pytest.fixture(scope="module")
def pages(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(2000 + i, u, "<p>best of the casino win</p>" if i % 3 else None) for i, u in enumerate(URLS)] + [(2000, URLS[0], "x"), (None, URLS[0], "<b")]
    return given.union(spark.createDataFrame(odd, given.schema)).withColumns({c: F.lit(7) for c in ("host", "path", "n", "word", "name", "tokens", "score", "bad")}).cache()


def plain_host(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match("[^/?#]*", rest).group()
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match("[^?#]*", rest[len(host):]).group()


def plain_rule(host, path):
    fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def runs_of_letters(t):
    return ["".join(g) for k, g in itertools.groupby((t or "").lower(), str.isalpha) if k]


def test_verdicts(pages):
    rows = pages.select("page_id", "url", "html").collect()
    texts = [re.sub("(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z]+;", " ", r.html or "") for r in rows]
    counts = collections.Counter(w for t in texts for w in runs_of_letters(t) if len(w) <= 24)
    total = sum(counts.values())

    def price(w):
        known = math.log(total / counts[w]) if counts[w] else math.inf
        if w in urls.TOPICS:
            known = min(known, -math.log(urls.TOPIC_SHARE))
        return known if known < math.inf else math.log(total) - math.log(10) + len(w) * math.log(10)

    def split(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            best.append(min(((best[end - n][0] + price(name[end - n : end]), -n, [*best[end - n][1], name[end - n : end]]) for n in range(1, min(end, 24) + 1)), key=lambda x: (round(x[0], 9), x[1]))[::2])
        return best[-1][1]

    def tokens(host, path):
        return [w for n in runs_of_letters(host) for a in range(0, len(n), 256) for w in split(n[a : a + 256])] + runs_of_letters(path)

    told = [(r.page_id, *plain_host(r.url)) for r in rows]
    held = [tokens(h, p) for _, h, p in told]
    bad = [any(t in urls.TOPICS for t in ts) for ts in held]
    assert 0 < sum(bad) < len(bad)
    counts2 = [collections.Counter(zlib.crc32(t.encode()) % urls.BUCKETS for ts, b in zip(held, bad, strict=True) if b == k for t in ts) for k in (False, True)]
    size = len(counts2[0] | counts2[1])
    share = [lambda b, c=c: math.log((c[b] + 0.1) / (sum(c.values()) + 0.1 * size)) for c in counts2]
    want = []
    for (page, host, path), ts in zip(told, held, strict=True):
        odds = math.log(sum(bad) / (len(bad) - sum(bad))) + sum(share[1](b) - share[0](b) for t in ts for b in [zlib.crc32(t.encode()) % urls.BUCKETS])
        rule, verdict = plain_rule(host, path)
        want.append((page, host, path, rule, verdict or ("block" if odds > 0 else "allow"), round(odds, 6)))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 6)) for r in urls.judged(pages).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by_host = {r[1]: r[4] for r in got if r[3] is None}
    assert by_host["spamfarm.example.org"] == by_host["bestcasinowin.example.org"] == "block"


def test_allowed_pages_and_other_rules(spark, pages):
    given = pages.where("page_id is not null").dropDuplicates(["page_id"])
    rules = [("block", "org/"), ("allow", "EXAMPLE.org/"), ("block", "example.org/")]
    kept = {r.page_id for r in urls.without_blocked(given, rules, topics=()).collect()}
    for r in given.collect():
        host, path = plain_host(r.url)
        assert (r.page_id in kept) == (not (host.endswith("org") and path))


def test_no_rows(spark, docs, pages):
    none = docs.limit(0)
    assert periods.run_digests(none, periods.planted).count() == periods.periodic_runs(none).count() == urls.judged(pages.limit(0)).count() == 0
    target = spark.createDataFrame([], "text string")
    assert importance.resample(none, target).count() == 0
    assert importance.resample(docs, target).count() == docs.count()


def test_registered():
    assert {"op11_segmented_url_verdicts", "op12_automaton_period_runs", "op13_hashed_importance_resampling"} <= set(queries.QUERIES)
