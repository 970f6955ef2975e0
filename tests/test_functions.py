"""Golden values of the column functions."""

from __future__ import annotations

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanledger.functions import intervals, ids
from spanledger.functions import normalizers as N
from spanledger.functions import text as tx
from spanledger.functions.usage import cost_millicents, usage_from_json
from spanledger.operators import evaluate as ev
from spanledger.operators.audit import holds_document_text, retention_cutoff


def mapped(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_jurisdictions(spark):
    golden = {
        "State of Texas": "texas",
        "the State of Delaware": "delaware",
        "Commonwealth of Massachusetts": "massachusetts",
        "laws of the State of California": "california",
        "State of New York, USA": "new york",
        "Nevada, without regard to conflict of laws": "nevada",
        "England and Wales": "england and wales",
        "Governed by and construed in accordance with the laws of the State of Ohio": "ohio",
        "": "",
    }
    assert mapped(spark, N.jurisdiction, list(golden)) == list(golden.values())
    assert mapped(spark, N.jurisdiction, [None]) == [""]


def test_dates(spark):
    golden = {
        "10/21/16": "2016-10-21",
        "21st day of October, 2016": "2016-10-21",
        "October 21, 2016": "2016-10-21",
        "3/9/15": "2015-03-09",
        "2001-07-16": "2001-07-16",
        "9th day of March 2015": "2015-03-09",
        "Mar 9, 2015": "2015-03-09",
        "Oct. 21st, 2016": "2016-10-21",
        "21 October 2016": "2016-10-21",
        "21-Oct-2016": "2016-10-21",
        "Friday, October 21, 2016": "2016-10-21",
        "20161021": "2016-10-21",
        "Sept 3, 1999": "1999-09-03",
        "21/10/2016": "2016-10-21",
        "1/2/73": "1973-01-02",
        "04/31/2018": "2018-04-31",
        "15": None,
        "2018": None,
        "March 2018": None,
        "March 15": None,
        "04/30/": None,
        "/[]/2018": None,
        "12/2018": None,
        "YYYY-MM-DD": None,
        "February 30, 2018": None,
        "": None,
    }
    assert mapped(spark, N.calendar_date, list(golden)) == list(golden.values())


def test_filled_dates(spark):
    golden = {
        "March 2018": "2018-03-31",
        "February 2018": "2018-02-28",
        "March 15": "2026-03-15",
        "15": "2026-10-15",
        "2018": "2018-10-31",
        "12/2018": "2018-12-31",
        "11/30/17": "2017-11-30",
        "no date": None,
    }
    ref = F.lit("2026-10-31").cast("date")
    assert mapped(spark, lambda c: N.filled_date(c, ref), list(golden)) == list(golden.values())


def test_party_names(spark):
    golden = {
        'Harbour Freightways, S.A. ("Freightways")': "harbour freightways",
        "LANTERN BOOKS, INC. d/b/a The Reading Room": "lantern books",
        "Lantern Books doing  business as Books": "lantern books",
        "Company": "",
        "MILL.EXAMPLE WORKS, INC.": "mill example works",
        'Third Quarry Mining Inc. ("Company")': "third quarry mining",
        "Jo Lindqvist (“Author”)": "jo lindqvist",
        "Acme Co. Pty Ltd [the seller]": "acme",
        "Incorporated Ideas": "incorporated ideas",
        "U.K. Mills L.L.C.": "uk mills",
        "A.Wren and B. Owl": "awren and b owl",
    }
    assert mapped(spark, N.party_name, list(golden)) == list(golden.values())


def test_party_aliases(spark):
    golden = {
        'Tall Pines Holdings Inc. ("Timber Agent", "TP")': {"timber agent", "tp"},
        'Velvet Looms, Inc. ("Velvet")': {"velvet"},
        "Oarlock, Inc. (“Oarlock”)": {"oarlock"},
        "New Name (formerly known as Old Name, Inc.)": {"old name"},
        "Plain Corp (the seller)": {"the seller"},
        "No aside": set(),
    }
    got = mapped(spark, N.party_aliases, list(golden))
    assert [set(g) for g in got] == list(golden.values())


def test_templates_and_answers(spark):
    assert mapped(spark, N.is_template, ["YYYY-MM-DD", " [yyyy/mm/dd] ", "ISO format", "2018-01-01", ""]) == [
        True, True, True, False, False]
    got = mapped(spark, N.parse_answers, ["a; 'b' ;nan", "x\n\n[y]", "['z']", "None", "", None, '"q"'])
    assert got == [["a", "b"], ["x", "y"], ["z"], [], [], [], ["q"]]


def test_uuid5_agrees_with_the_standard_library(spark):
    names = ["", "a", "tenant:claim", "Größe", "x" * 300]
    want = [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert mapped(spark, lambda c: ids.uuid5(ids.URL_NAMESPACE, c), names) == want
    doc = str(uuid.uuid4())
    row = spark.range(3).select(ids.chunk_uuid(F.lit(doc), F.col("id")).alias("u")).collect()
    assert [r.u for r in row] == [str(uuid.uuid5(uuid.UUID(doc), str(i))) for i in range(3)]


def test_provenance_normalisation_precedes_offsets(one):
    text = "The ﬁrst clause.\r\nSecond clause."
    row = one(
        [tx.normalize_for_provenance(F.col("t")).alias("n")], t=text
    )
    assert row.n == "The first clause.\nSecond clause."
    span = one([tx.locate_span(F.lit(row.n), F.lit("Second clause.")).alias("s")]).s
    assert row.n[span.start_offset : span.end_offset] == span.quote == "Second clause."
    assert one([tx.locate_span(F.lit(row.n), F.lit("made up")).alias("s")]).s is None
    assert one([tx.locate_span(F.lit(row.n), F.lit("")).alias("s")]).s is None


def test_ordered_quotes(one):
    t = F.lit("one two one three")
    two = one([tx.locate_spans(t, F.array(F.lit("one"), F.lit("one"))).alias("s")]).s
    assert [(s.start_offset, s.end_offset) for s in two] == [(0, 3), (8, 11)]
    assert one([tx.locate_spans(t, F.array(F.lit("three"), F.lit("one"))).alias("s")]).s is None
    each = one([tx.locate_each(t, F.array(F.lit("three"), F.lit("one"))).alias("s")]).s
    assert [s.start_offset for s in each] == [12, 0]


def pack(text, limit):
    """Brute force of greedy line packing."""
    out, now = [], ""
    for line in text.splitlines(keepends=True):
        if len(now) + len(line) <= limit:
            now += line
            continue
        if now:
            out.append(now)
        now = ""
        if len(line) > limit:
            out += [line[i : i + limit] for i in range(0, len(line), limit)]
        else:
            now = line
    return (out + [now] if now else out) or [""]


def test_line_chunks_against_brute_force(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text(alphabet="ab é\n\r ", max_size=60), min_size=1, max_size=30))
    def check(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        got = df.select("i", F.transform(
            tx.line_chunk_bounds(F.col("t"), 10), lambda b: tx.slice_text(F.col("t"), b)).alias("c"))
        for r in got.collect():
            assert r.c == pack(texts[r.i], 10), texts[r.i]

    check()


def test_matching(one):
    a = "The quick brown fox"
    assert one([ev.texts_match(F.lit(a), F.lit("the QUICK  brown fox")).alias("m")]).m
    # a short generic text inside a long one does not match
    assert not one([ev.texts_match(F.lit("fox"), F.lit(a + " jumps over the lazy dog")).alias("m")]).m
    assert not one([ev.texts_match(F.lit(" "), F.lit(" ")).alias("m")]).m


def test_greedy_matching_depends_on_order(one):
    labels = F.array(F.lit("a b c d"), F.lit("a b c x"))
    got = one([ev.greedy_matches(F.array(F.lit("a b c x"), F.lit("a b c d"), F.lit("zzz")), labels).alias("g")]).g
    # the first prediction takes the first label that passes, not its equal
    assert got == [0, 1, -1]


def test_wilson(spark):
    rows = spark.createDataFrame([(6, 16), (13, 13), (0, 0), (0, 10)], "k long, n long")
    got = [r.w for r in rows.select(ev.wilson(F.col("k"), F.col("n")).alias("w")).collect()]
    assert [(round(w.low, 2), round(w.high, 2)) if w else None for w in got] == [
        (0.18, 0.61), (0.77, 1.0), None, (0.0, 0.28)]
    bad = spark.createDataFrame([(5, 4)], "k long, n long")
    with pytest.raises(Exception, match="0 <= k <= n"):
        bad.select(ev.wilson(F.col("k"), F.col("n")).alias("w")).collect()


def test_prices(one):
    def cost(tokens, rates):
        return one([cost_millicents(*[F.lit(t) for t in tokens], tuple(F.lit(r) for r in rates)).alias("c")]).c

    assert cost((10_000, 2_000, 40_000, None), (0.20, 1.00, 0.020, 0.25)) == 4_800
    assert cost((5_000, 1_000, 0, 0), (0.10, 0.50, 0.0, 0.0)) == 1_000
    assert cost((5, 0, 0, 0), (0.5, 0.0, 0.0, 0.0)) == 2  # 2.5 to even
    assert cost((-5, 0, 0, 0), (0.5, 0.0, 0.0, 0.0)) == -2


def test_provider_payloads(spark):
    payloads = [
        '{"usage":{"input_tokens":10,"output_tokens":5,"cache_read_input_tokens":null}}',
        '{"prompt_tokens":100,"completion_tokens":7,"prompt_tokens_details":{"cached_tokens":30}}',
        '{"promptTokenCount":50,"cachedContentTokenCount":60,"candidatesTokenCount":3,"thoughtsTokenCount":4}',
        "{}",
    ]
    got = mapped(spark, usage_from_json, payloads)
    assert [tuple(g) for g in got] == [(10, 5, 0, 0), (70, 7, 30, 0), (0, 7, 60, 0), (0, 0, 0, 0)]


def test_audit_metadata(spark):
    cases = {
        '{"a": 1}': False,
        '{"deep": [{"Content": 1}]}': True,
        '{"note": "text"}': False,
        '{"note": "say \\"text\\": now"}': False,
        '{"note": "%s"}' % ("x" * 500): False,
        '{"note": "%s"}' % ("x" * 501): True,
        '{"note": "%s"}' % ("\\n" * 400): False,
        None: False,
    }
    assert mapped(spark, holds_document_text, list(cases)) == list(cases.values())


def test_retention_cutoff_clamps_the_day(one):
    cut = lambda s: str(one([retention_cutoff(F.lit(s).cast("timestamp_ntz")).alias("c")]).c)
    assert cut("2026-05-31 10:30:00") == "2025-02-28 10:30:00"
    assert cut("2025-05-31 00:00:00") == "2024-02-29 00:00:00"
    assert cut("2026-10-15 00:00:00") == "2025-07-15 00:00:00"


def test_intervals(spark):
    df = spark.sql("SELECT timestamp'2020-01-01' s, timestamp'2020-01-01' z, timestamp'2020-02-01' e, CAST(NULL AS timestamp) o")
    at = lambda t: F.lit(t).cast("timestamp")
    row = df.select(
        intervals.interval_valid(F.col("s"), F.col("z")), intervals.contains(F.col("s"), F.col("z"), at("2020-01-01")),
        intervals.contains(F.col("s"), F.col("e"), at("2020-01-01")), intervals.contains(F.col("s"), F.col("e"), at("2020-02-01")),
        intervals.contains(F.col("s"), F.col("o"), at("2030-01-01")), intervals.is_open(F.col("o")),
        intervals.close_at(F.col("s"), F.col("e"), at("2019-01-01")).isNull(),
    ).first()
    assert list(row) == [True, False, True, False, True, True, True]


def test_span_rules(spark):
    df = spark.createDataFrame(
        [("c", 0, 3, "abc"), ("c", 0, 0, "a"), ("c", -1, 2, "abc"), ("c", 0, 2, "abc"), (None, 0, 3, "abc"), ("c", 1, 4, " ")],
        "c string, s int, e int, q string")
    got = df.select(tx.valid_span(F.col("s"), F.col("e"), F.col("q")), tx.valid_provenance(F.col("c"), F.col("s"), F.col("e"), F.col("q"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False), (False, True), (True, False), (False, False)]


@pytest.mark.parametrize("text", ["", " ", "One. Two", "... lead! Ünï ? tail  ", "no mark", " a.b  .c\n d", "x" * 60 + ". " + "y" * 70])
def test_sentence_spans_hold_the_whole_text(one, text):
    got = one([tx.sentence_spans(F.col("t")).alias("s")], t=text).s
    assert all(text[s.start_offset : s.end_offset] == s.quote and s.quote.strip(" ") == s.quote != "" for s in got)
    assert "".join(s.quote for s in got).replace(" ", "") == text.replace(" ", "")
