"""Table operators against brute force, on a small table with the odd cases: nulls, empty and long texts,
ties, repeated rows, further columns with clashing names, and no rows at all."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from spanledger.llm import chat, decontaminate, fingerprint, minhash, packing, pii, queries, recurrent, repeats, secrets, tokenfile, tokens, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^ \t-\r]+")
CASES = [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one two"), (1004, "One two"), (1005, "a b c d e"), (1006, "word " * 20000), (1007, "é ö 中文 😀 " * 30), (None, "no name here at all")]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(CASES, "doc_id long, text string")
    from pyspark.sql import functions as F

    extra = {c: F.lit(7) for c in ("n", "node", "band", "component", "kept", "score", "key", "hashes", "words", "part", "__kept")}
    return given.union(odd).withColumns(extra).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def lowered(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def shingles(t, low=lowered):
    w = WORD.findall(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = collections.defaultdict(list)
    for i, (d, s) in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in seen[g]).items():
            o, t = sets[j]
            if 100 * n >= 75 * (len(s) + len(t) - n):
                a, b = sorted((find(o), find(d)))
                parent[b] = a
        for g in s:
            seen[g].append(i)
    return {d: find(d) for d in parent}


def test_near_duplicates(docs, rows):
    want = groups(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None) and r.kept == (r.component_id == r.doc_id)
    assert {(r.doc_id, r.n_shingles) for r in got} == {(d, len(shingles(t))) for d, t in rows}


def test_blocks_find_what_the_pivots_miss(spark):
    """A chain of texts, each like the next alone, and copies: bands hold several components."""
    base = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(f"x{j}" if i * 8 <= j < i * 8 + 40 else w for j, w in enumerate(base))) for i in range(40)]
    table = spark.createDataFrame([*texts, *texts[:5]], "doc_id long, text string")
    want = groups([*texts, *texts[:5]])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect()} == want


def test_one_of_each(docs, rows):
    kept = [r.doc_id for r in minhash.one_of_each(docs).select("doc_id").collect()]
    assert sorted(d for d in kept if d is not None) == sorted({v for v in groups(rows).values()}) and kept.count(None) == 1


def test_decontamination(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, None), (901, ""), (902, "ONE two"), (903, "a b c d e")], "item_id long, text string"))
    items = [(r.item_id, shingles(r.text or "", str.lower)) for r in bench.collect()]
    want = {(d, i): len(shingles(t, str.lower) & s) for d, t in rows for i, s in items if s and 100 * len(shingles(t, str.lower) & s) >= 75 * len(s)}
    assert {(r.doc_id, r.item_id): r.shared for r in decontaminate.contaminated(docs, bench).collect()} == want
    left = decontaminate.without_benchmark(docs, bench)
    assert left.columns == docs.columns
    bad = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in left.select("doc_id").collect()) == sorted(str(d) for d, _ in rows if d not in bad)


def test_native_operators_run_no_python(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df in (decontaminate.contaminated(docs, bench), fingerprint.fingerprints(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingles(t, str.lower), shingles(other, str.lower)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    same = collections.defaultdict(set)
    for d, t in rows:
        same[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_merge(spark):
    from pyspark.sql import functions as F

    parts = spark.range(2000).select((F.col("id") % 2).alias("k"), F.array(F.xxhash64(F.col("id") % 900)).alias("f")).union(
        spark.createDataFrame([(9, None)], "k long, f array<long>"))
    whole = spark.range(2000).select((F.col("id") % 2).alias("k"), F.xxhash64(F.col("id") % 900).alias("h")).distinct()
    got = fingerprint.merge_parts(parts, "k", "f", 64).select("*", fingerprint.distinct_shingles(F.col("f"), 64).alias("n")).collect()
    for k in (0, 1):
        want = sorted(r.h for r in whole.where(F.col("k") == k).collect())
        mine = next(r for r in got if r.k == k)
        assert mine.f == want[:64] and 0.6 < mine.n / len(want) < 1.6
    assert next(r for r in got if r.k == 9).f == []


def test_repeats(docs, rows):
    n, seen, held = repeats.MIN_WORDS, collections.defaultdict(set), []
    for d, t in rows:
        w = WORD.findall(lowered(t))
        runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if d is not None else []
        held.append((d, runs))
        for r in set(runs):
            seen[r].add(d)
    want = set()
    for d, runs in held:
        cur = None
        for i in (i for i, r in enumerate(runs) if len(seen[r]) > 1):
            if cur and i <= cur[1]:
                cur[1] = i + n
            else:
                if cur:
                    want.add((d, cur[0], cur[1] - cur[0]))
                cur = [i, i + n]
        if cur:
            want.add((d, cur[0], cur[1] - cur[0]))
    assert want and {tuple(r) for r in repeats.repeated_passages(docs).collect()} == want


def test_repeats_with_partners_next_in_neither_order(spark):
    """A passage shorter than MIN_WORDS with mixed heads and tails around it, as in templates."""
    rnd = random.Random(4)
    core = [f"c{i}" for i in range(36)]
    heads, tails = ([[f"{k}{i}x{j}" for j in range(rnd.randint(0, 14))] for i in range(12)] for k in "ht")
    texts = [(d, [f"a{d}x{i}" for i in range(5)] + rnd.choice(heads) + core + rnd.choice(tails) + [f"z{d}x{i}" for i in range(5)]) for d in range(150)]
    held = collections.defaultdict(set)
    for d, w in texts:
        for i in range(len(w) - 49):
            held[tuple(w[i : i + 50])].add(d)
    want = set()
    for d, w in texts:
        begins = [i for i in range(len(w) - 49) if len(held[tuple(w[i : i + 50])]) > 1]
        if begins:  # all of them overlap in the core
            want.add((d, begins[0], begins[-1] + 50 - begins[0]))
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id long, text string")
    assert len(want) > 20 and {tuple(r) for r in repeats.repeated_passages(table).collect()} == want


def test_packing(docs, rows):
    enc = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")).tokenizer
    ids = {d: enc.encode(t, add_special_tokens=False).ids + [1] for d, t in rows}
    sequences, cover = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, open_windows=3).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        cover[r.doc_id].append((r.start, r.length))
    for parts in [*sequences.values(), *cover.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert all(sum(n for _, n in cover[d]) == len(i) for d, i in ids.items())
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert max(sizes) <= 2048 and sum(2048 - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)


def test_token_files(spark, docs, rows, tmp_path):
    enc = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")).tokenizer
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = enc.encode(t, add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    tokenfile.write_tokens(docs, f"{tmp_path}/file")
    got = [tuple(r) for r in tokenfile.read_tokens(spark, f"{tmp_path}/file").collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_chat_windows(spark):
    said = [(c, t, r, x) for c in (1, 2, None) for t, r, x in ((0, "system", "be brief"), (1, "user", "hello " * 300), (2, "assistant", "hi " * 900), (2, "assistant", "hi " * 900),
            (3, "user", None), (4, "assistant", "### a: </turn>\\"), (5, None, "x"), (None, "user", "first"))] + [(3, 0, "system", "alone")]
    said += [(4, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * (i % 40)) for i in range(600)]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as tokens", "2 as rank", "3 as cell")
    windows = chat.format_conversations(table, budget=256, history=64)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in said if c == conv))
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{b}\n{x}\n" for _, _, b, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, b, x in turns if b == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.where("conv_id = 4").collect():
        new = chat.parse(w.text)[w.repeated :]
        assert w.tokens <= 256 or len(new) == 1
    lead = [chat.parse(w.text)[0] for w in windows.where("conv_id = 2").collect()]
    assert len(lead) > 1


def test_scans(docs, rows):
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    told = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for d, t in rows:
        spans = pii.spans(t)
        assert found[d].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in pii.BASE)
        assert found[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert told[d].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.spans(t))
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(docs).select("doc_id", "text").collect()}
    assert masked[1000] is None and all(masked[d] == pii.masked(t) for d, t in rows if d != 1000)


def test_toxicity(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet") if os.path.isdir("/root/testdata/sf0.1") else spark.read.parquet(f"{SF}/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet") if os.path.isdir("/root/testdata/sf0.1") else docs
    got = toxicity.classify(big, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / max(1, (got.predicted == 1).sum()) > 0.8 and hit / (got.toxic == 1).sum() > 0.65
    for r in got.head(50).itertuples():
        assert zlib.crc32(str(r.doc_id).encode()) % 3 == 1
    none = toxicity.classify(docs, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0)]


def test_empty_tables(spark, docs, tmp_path):
    empty = docs.limit(0)
    tokenfile.write_tokens(empty, f"{tmp_path}/file")
    assert tokenfile.read_tokens(spark, f"{tmp_path}/file").count() == 0
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    for df in (minhash.near_duplicates(empty), decontaminate.contaminated(empty, bench), repeats.repeated_passages(empty), packing.pack(empty), fingerprint.fingerprints(empty),
               toxicity.classify(empty, labels), pii.find_personal_data(empty), secrets.find_secrets(empty)):
        assert df.count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0


def test_pipeline_and_registry(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "packing"]
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in queries.QUERIES] == list(range(1, 14))
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == given.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0 < len(ids) < given.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids


ODD_ROWS = [(9001, None), (9002, ""), (9003, "one two"), (None, "no name at all here"), (9004, "same words again and again " * 30), (9004, "same words again and again " * 30), (9005, "mail a@b.org, call +44 20 7946 0958 123"), (9006, "x " * 60000)]


def test_every_stage_against_a_plain_reading(spark, tmp_path):
    """Each stage on what the one before kept, with nulls, repeated rows and further columns of clashing names."""
    odd = spark.createDataFrame(ODD_ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    names = ("__kept", "__rows", "node", "band", "score", "item_id", "held", "start", "piece")
    given = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd).selectExpr("*", *(f"7 as `{n}`" for n in names))
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def texts(df):
        return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.classify(given, labels).collect()}
    clean = step("toxicity", given)
    assert texts(clean) == sorted(((d, t) for d, t in texts(given) if scores[d] < toxicity.REJECT), key=repr)

    single = step("near_dedup", clean)
    rows = texts(clean)
    component = groups([(d, t or "") for d, t in rows])
    kept = sorted({(d, t) for d, t in rows if d is None or component[d] == d}, key=repr)
    assert sorted(set(texts(single)), key=repr) == kept and len(texts(single)) == len(kept)

    fresh = step("decontamination", single)
    items = [shingles(r.text, str.lower) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    def holds(t):
        mine = shingles(t or "", str.lower)
        return any(100 * len(i & mine) >= 75 * len(i) for i in items if i)
    assert texts(fresh) == [(d, t) for d, t in texts(single) if not holds(t)]

    masked = step("personal_data", fresh)
    assert texts(masked) == sorted(((d, None if t is None else pii.masked(t)) for d, t in texts(fresh)), key=repr)
    assert all(r.n_chars == len(r.text) for r in masked.select("n_chars", "text").collect() if r.text is not None)

    enc = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")).tokenizer
    packed = corpus_pipeline.STAGES[-1][1](spark, masked, SF).collect()
    sizes = collections.Counter()
    for r in packed:
        sizes[r.doc_id] += r.length
    assert sizes == collections.Counter({d: len(enc.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts(masked)})


def test_stages_of_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def plain_score(p, text):
    """A text's score by one window and one word at a time, from the weights alone."""
    buf = np.frombuffer((text or "").encode(), np.uint8)
    hashes, begin, end, first, (low, starts, ends) = recurrent.inputs(buf, np.array([0, len(buf)]))
    n = int(first[-1])
    def sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    logits, soft, at = [], 0.0, 0
    vocabulary = p["vocabulary"].tolist()
    while n and (at == 0 or at < n - (recurrent.LENGTH - recurrent.STRIDE)):
        xs = []
        for w in range(at, min(n, at + recurrent.LENGTH)):
            row = vocabulary.index(hashes[w]) + 1 if hashes[w] in vocabulary else 0
            b = [0, *low[starts[w] : ends[w]].tolist(), 0]
            grams = [int(recurrent._gram(*(np.array([v], np.uint8) for v in b[k : k + 3]))[0]) for k in range(len(b) - 2)]
            xs.append(np.concatenate([p["word"][row], p["char"][begin[w]] + p["char"][end[w]] + p["gram"][grams].mean(0)]).astype(float))
        states = []
        for side, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            h, out = np.zeros(recurrent.HIDDEN), [None] * len(xs)
            for t in order:
                g, r_ = xs[t] @ p["x" + side] + p["c" + side], h @ p["h" + side]
                k = recurrent.HIDDEN
                z, r = sig(g[:k] + r_[:k]), sig(g[k : 2 * k] + r_[k : 2 * k])
                new = np.tanh(g[2 * k :] + r * r_[2 * k :])
                h = out[t] = new + z * (h - new)
            states.append(out)
        s = np.array([np.concatenate(x) for x in zip(*states, strict=True)])
        energy = np.tanh(s @ p["u"]) @ p["v"]
        weight = np.exp(energy - energy.max())
        local = s @ p["o"] + p["k"][0]
        logits.append(float((weight / weight.sum()) @ local))
        soft += sig(local).sum()
        at += recurrent.STRIDE
    x = np.array([[max([-10.0, *np.clip(logits, -10, 10)]), np.log1p(sum(sig(v) for v in logits)), np.log1p(soft), np.log1p(n)]])
    return float(1 / (1 + np.exp(-np.clip(toxicity._expand(x) @ p["final"], -30, 30)))[0])


def test_scores_equal_a_plain_forward_pass(spark, docs):
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    p = recurrent.load(model)
    for r in toxicity.score(docs.where("length(text) < 4000 or text is null"), model).join(docs.select("doc_id", "text"), "doc_id").limit(60).collect():
        assert abs(r.score - plain_score(p, r.text)) < 1e-4
