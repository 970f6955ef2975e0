"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.catalog import query
from spanledger.catalog.twins import with_parts
from spanledger.functions import normalizers as N
from spanledger.functions import text as tx
from spanledger.functions.ids import assertion_uuid, chunk_uuid, content_hash, fact_uuid
from spanledger.operators import evaluate
from spanledger.sources import documents as docs
from spanledger.sources import driver_tables as dt


@query("fn_normalize_prov", """SELECT doc_id, length(text) + 12 AS n_chars, sha256('fi 1' || chr(10) || chr(10) || ' x ' || lang || text || ' ' || chr(10)) AS digest FROM documents""".replace(
    "length(text) + 12", "CAST(length('fi 1' || chr(10) || chr(10) || ' x ' || lang || text || ' ' || chr(10)) AS BIGINT)"))
def fn_normalize_prov(spark, sf):
    d = dt.spread_documents(spark, sf)
    # a ligature, a circled digit, both foreign line ends and a no-break space around every text
    dirty = F.concat(F.lit("\ufb01 \u2460\r\n\r\u00a0x "), "lang", "text", F.lit("\u00a0\r"))
    return d.select("doc_id", tx.normalize_for_provenance(dirty).alias("t")).select(
        "doc_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("digest")
    )


@query("fn_chunk_paragraph", with_parts("SELECT tenant_id, document_id, chunk_id, chunk_index, text, token_count FROM chunks", "chunks"))
def fn_chunk_paragraph(spark, sf):
    return dt.chunks(spark, sf)


# greedy packing as a fold over the lines of each text; the state is (bounds so far, start, end)
PACK = """
    WITH l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x, i: length(x) + 1) AS s, length(text) AS n FROM documents),
    r AS (SELECT doc_id, text, n, list_concat(s[1:len(s)-1], CASE WHEN s[len(s)] > 1 THEN [s[len(s)] - 1] ELSE [] END) AS s FROM l),
    f AS (SELECT doc_id, text, n, list_reduce(s, lambda a, x:
        CASE WHEN a.e + x - a.b <= 400 THEN {'d': a.d, 'b': a.b, 'e': a.e + x}
        WHEN x > 400 THEN {'d': list_concat(list_concat(a.d, CASE WHEN a.e > a.b THEN [a.b] ELSE [] END), list_transform(range(0, x, 400), lambda o: a.e + o)), 'b': a.e + x, 'e': a.e + x}
        ELSE {'d': CASE WHEN a.e > a.b THEN list_append(a.d, a.b) ELSE a.d END, 'b': a.e, 'e': a.e + x} END,
        {'d': CAST([] AS BIGINT[]), 'b': CAST(0 AS BIGINT), 'e': CAST(0 AS BIGINT)}) AS a FROM r),
    g AS (SELECT doc_id, text, n, CASE WHEN a.e > a.b THEN list_append(a.d, a.b) ELSE a.d END AS starts FROM f)
    SELECT doc_id, chunk_index, start_offset, end_offset, substr(text, CAST(start_offset AS INTEGER) + 1, CAST(end_offset - start_offset AS INTEGER)) AS text FROM (
      SELECT doc_id, text, unnest(range(len(starts))) AS chunk_index, unnest(starts) AS start_offset,
        unnest(list_append(starts[2:], n)) AS end_offset FROM g)"""


@query("fn_chunk_lines", PACK)
def fn_chunk_lines(spark, sf):
    d = dt.spread_documents(spark, sf).select("doc_id", "text")
    return docs.line_chunks(d, 400).select("doc_id", "chunk_index", "start_offset", "end_offset", "text")


def quoted_chunks(spark, sf):
    """Chunks with a quote: their second sentence, shouted for French documents."""
    c = dt.chunks(spark, sf)
    lang = dt.documents(spark, sf).select("tenant_id", "document_id", "lang")
    second = F.get(F.split("text", r"\. "), F.lit(1))
    return c.join(lang, ["tenant_id", "document_id"]).withColumn(
        "quote", F.when(F.col("lang") == "fr", F.upper(second)).otherwise(second)
    )


QUOTED = """
    , q0 AS (SELECT *, string_split(text, '. ')[2] AS second FROM chunks)
    , q AS (SELECT *, CASE WHEN lang = 'fr' THEN upper(second) ELSE second END AS quote FROM q0)"""


@query("fn_locate_span", with_parts(QUOTED + """
    SELECT chunk_id, CASE WHEN quote <> '' AND contains(text, quote) THEN CAST(strpos(text, quote) - 1 AS BIGINT) END AS start_offset,
      CASE WHEN quote <> '' AND contains(text, quote) THEN CAST(strpos(text, quote) - 1 + length(quote) AS BIGINT) END AS end_offset FROM q""", "chunks"))
def fn_locate_span(spark, sf):
    rows = quoted_chunks(spark, sf).withColumn("s", tx.locate_span(F.col("text"), F.col("quote")))
    return rows.select(
        "chunk_id", F.col("s.start_offset").cast("bigint").alias("start_offset"),
        F.col("s.end_offset").cast("bigint").alias("end_offset"),
    )


@query("fn_locate_spans", with_parts("""
    , w AS (SELECT chunk_id, text, substr(text, 1, 3) AS a, substr(text, -4) AS b FROM chunks)
    , p AS (SELECT *, strpos(text, a) - 1 AS s1 FROM w)
    , p2 AS (SELECT *, CASE WHEN strpos(substr(text, s1 + length(a) + 1), b) > 0 THEN s1 + length(a) + strpos(substr(text, s1 + length(a) + 1), b) - 1 END AS s2 FROM p)
    , p3 AS (SELECT *, CASE WHEN s2 IS NOT NULL AND strpos(substr(text, s2 + length(b) + 1), a) > 0 THEN 1 ELSE 0 END AS again FROM p2)
    SELECT chunk_id, s2 IS NOT NULL AS in_order, CAST(s2 AS BIGINT) AS second_start, again = 1 AS three_found,
      (strpos(text, a) > 0 AND strpos(text, b) > 0) AS each_found FROM p3""", "chunks"))
def fn_locate_spans(spark, sf):
    a, b, t = F.substring("text", 1, 3), F.substring("text", -4, 4), F.col("text")
    c = dt.chunks(spark, sf).select("chunk_id", "text")
    two = tx.locate_spans(t, F.array(a, b))
    return c.select(
        "chunk_id",
        two.isNotNull().alias("in_order"),
        F.element_at(two, 2)["start_offset"].cast("bigint").alias("second_start"),
        tx.locate_spans(t, F.array(a, b, a)).isNotNull().alias("three_found"),
        tx.locate_each(t, F.array(a, b)).isNotNull().alias("each_found"),
    )


@query("fn_quote_in_text", with_parts(QUOTED + """
    SELECT chunk_id, coalesce(trim(quote) <> '' AND contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(replace(quote, ' ', '  ')), '\\s+', ' ', 'g'))), FALSE) AS found
    FROM q""", "chunks"))
def fn_quote_in_text(spark, sf):
    # shouted and stretched quotes still count
    stretched = F.replace(F.col("quote"), F.lit(" "), F.lit("  "))
    return quoted_chunks(spark, sf).select("chunk_id", tx.quote_in_text(stretched, F.col("text")).alias("found"))


@query("fn_normalize_ws", """SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents""")
def fn_normalize_ws(spark, sf):
    return dt.spread_documents(spark, sf).select("doc_id", F.sha2(tx.normalize_ws(F.col("text")), 256).alias("digest"))


@query("fn_token_f1", """
    WITH t AS (SELECT doc_id, list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')), lambda w: w <> '') AS a,
      list_filter(list_distinct(string_split(trim(regexp_replace(lower(substr(text, 1, CAST(length(text) / 2 AS INTEGER))), '\\s+', ' ', 'g')), ' ')), lambda w: w <> '') AS b FROM documents)
    SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN CAST(len(list_intersect(a, b)) AS DOUBLE) * 2 / (len(a) + len(b)) ELSE 0 END AS f1,
      len(a) > 0 AND len(b) > 0 AND CAST(len(list_intersect(a, b)) AS DOUBLE) * 2 / (len(a) + len(b)) >= 0.5 AS matches FROM t""".replace(
    "CAST(length(text) / 2 AS INTEGER)", "CAST(length(text) // 2 AS INTEGER)"))
def fn_token_f1(spark, sf):
    # a text against its own first half
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    d = dt.spread_documents(spark, sf)
    return d.select(
        "doc_id",
        evaluate.token_f1(tx.normalize_ws(F.col("text")), tx.normalize_ws(half)).alias("f1"),
        evaluate.texts_match(F.col("text"), half).alias("matches"),
    )


PREFIX = "|".join(N.JURISDICTION_PREFIXES)


@query("fn_norm_jurisdiction", f"""
    WITH t AS (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN ' the State of '||n_name||', USA' WHEN 'HOUSEHOLD' THEN 'Governed by the Laws of the Commonwealth of '||n_name||', without  regard to conflicts'
        WHEN 'AUTOMOBILE' THEN 'internal laws of the state of '||n_name||' (U.S.)' ELSE n_name||' and Wales, Excluding CISG' END AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
    u AS (SELECT c_custkey, trim(regexp_replace(trim(lower(s)), '^({PREFIX})', '')) AS s FROM t)
    SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(s, ',\\s*(without\\s+regard|excluding|usa\\b|u\\.s\\.a\\b).*$', ''), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS jurisdiction FROM u""")
def fn_norm_jurisdiction(spark, sf):
    n = dt.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    c = dt.table(spark, sf, "customer").join(n, "c_nationkey")
    seg, name = F.col("c_mktsegment"), F.col("n_name")
    said = (
        F.when(seg == "MACHINERY", F.concat(F.lit(" the State of "), name, F.lit(", USA")))
        .when(seg == "HOUSEHOLD", F.concat(F.lit("Governed by the Laws of the Commonwealth of "), name, F.lit(", without  regard to conflicts")))
        .when(seg == "AUTOMOBILE", F.concat(F.lit("internal laws of the state of "), name, F.lit(" (U.S.)")))
        .otherwise(F.concat(name, F.lit(" and Wales, Excluding CISG")))
    )
    return c.select("c_custkey", N.jurisdiction(said).alias("jurisdiction"))


def spelled_orders(spark, sf):
    o = dt.table(spark, sf, "orders")
    day, p = F.col("o_orderdate"), F.col("o_orderpriority")
    said = (
        F.when(p == "1-URGENT", F.date_format(day, "MM/dd/yy"))
        .when(p == "2-HIGH", F.concat(F.date_format(day, "d"), F.lit("th day of "), F.date_format(day, "MMMM, yyyy")))
        .when(p == "3-MEDIUM", F.date_format(day, "MMM. d, yyyy"))
        .when(p == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "EEEE, d MMMM yyyy"))
    )
    return o.select("o_orderkey", "o_orderstatus", "o_orderdate", said.alias("said"))


@query("fn_norm_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def fn_norm_date(spark, sf):
    return spelled_orders(spark, sf).select("o_orderkey", N.calendar_date(F.col("said")).alias("day"))


@query("fn_norm_date_legacy", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'F' THEN strftime(o_orderdate, '%Y-%m') || '-' ||
        lpad(CAST(least(31, day(last_day(o_orderdate))) AS VARCHAR), 2, '0') ELSE '2026-' || strftime(o_orderdate, '%m-%d') END AS filled,
      CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS strict FROM orders WHERE NOT (o_orderstatus = 'P' AND strftime(o_orderdate, '%m-%d') = '02-29')
    UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderstatus = 'P' AND strftime(o_orderdate, '%m-%d') = '02-29'""")
def fn_norm_date_legacy(spark, sf):
    o = spelled_orders(spark, sf)
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    # whole dates, month and year only, month and day only
    said = (
        F.when(status == "O", F.col("said"))
        .when(status == "F", F.date_format(day, "MMMM yyyy"))
        .otherwise(F.date_format(day, "MMMM d"))
    )
    ref = F.lit("2026-10-31").cast("date")
    return o.select("o_orderkey", N.filled_date(said, ref).alias("filled"), N.calendar_date(said).alias("strict"))


SUFFIX = "|".join(N.CORPORATE_SUFFIXES)


def sql_party(e: str) -> str:
    """SQL twin of the party normaliser."""
    s = f"regexp_replace(regexp_replace(trim({e}), '\\(.*?\\)', ' ', 'g'), '\\[.*?\\]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\b(d/?b/?a|doing business as)\\b.*', ' ', 'gi')"
    s = f"regexp_replace({s}, '\\b([a-zA-Z])\\.([a-zA-Z])\\.?', '\\1\\2', 'g')"
    s = f"trim(regexp_replace(lower(regexp_replace({s}, '[^\\w\\s]', ' ', 'g')), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace({s}, '((^| )({SUFFIX}))+$', ''))"


SAID_PARTY = """SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN replace(s_name, '#', ' ') || ', Inc. ("Sup", ''The Maker'')'
    WHEN s_nationkey < 16 THEN 'S.A. ' || replace(s_name, '#', '.') || ' Co. Pty Ltd [formerly known as Old ' || s_suppkey || ' Corp, now new]'
    ELSE 'TIME ' || s_suppkey || ' L.L.C. d/b/a Other (Company) (Plain Alias)' END AS said FROM supplier"""


def supplier_parties(spark, sf):
    s = dt.table(spark, sf, "supplier")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    said = (
        F.when(nation < 8, F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(", Inc. (\"Sup\", 'The Maker')")))
        .when(nation < 16, F.concat(F.lit("S.A. "), F.replace("s_name", F.lit("#"), F.lit(".")),
                                    F.lit(" Co. Pty Ltd [formerly known as Old "), key, F.lit(" Corp, now new]")))
        .otherwise(F.concat(F.lit("TIME "), key, F.lit(" L.L.C. d/b/a Other (Company) (Plain Alias)")))
    )
    return s.select("s_suppkey", "s_nationkey", said.alias("said"))


@query("fn_norm_party", f"WITH t AS ({SAID_PARTY}) SELECT s_suppkey, {sql_party('said')} AS party FROM t")
def fn_norm_party(spark, sf):
    return supplier_parties(spark, sf).select("s_suppkey", N.party_name(F.col("said")).alias("party"))


@query("fn_party_aliases", """
    SELECT s_suppkey, a AS alias FROM supplier, (VALUES ('sup'), ('the maker')) v(a) WHERE s_nationkey < 8
    UNION ALL SELECT s_suppkey, 'old ' || s_suppkey FROM supplier WHERE s_nationkey >= 8 AND s_nationkey < 16
    UNION ALL SELECT s_suppkey, 'plain alias' FROM supplier WHERE s_nationkey >= 16""")
def fn_party_aliases(spark, sf):
    return supplier_parties(spark, sf).select("s_suppkey", F.explode(N.party_aliases(F.col("said"))).alias("alias"))


@query("fn_template_literal", """SELECT event_id, event_type IN ('click', 'view', 'error') AS is_template FROM events""")
def fn_template_literal(spark, sf):
    kind = F.col("event_type")
    said = (
        F.when(kind == "click", " YYYY-MM-DD ").when(kind == "view", "[yyyy/mm/dd]").when(kind == "error", "ISO Format")
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd")).otherwise("yyyy mm")
    )
    return dt.table(spark, sf, "events").select("event_id", N.is_template(said).alias("is_template"))


@query("fn_parse_answers", """
    SELECT p_partkey, CAST(i AS BIGINT) AS position, a[i + 1] AS answer FROM (SELECT p_partkey, a, unnest(range(len(a))) AS i FROM (
      SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN [p_name, p_brand] WHEN 'SMALL' THEN [p_name, p_brand, p_type] WHEN 'LARGE' THEN []
        WHEN 'ECONOMY' THEN [p_name] ELSE [p_name || ', ' || p_brand] END AS a FROM part))""")
def fn_parse_answers(spark, sf):
    kind = F.col("p_type")
    cell = (
        F.when(kind == "PROMO", F.concat(F.lit("'"), "p_name", F.lit("'; nan ;\""), "p_brand", F.lit('"; ')))
        .when(kind == "SMALL", F.concat_ws("\n", F.lit(" "), F.col("p_name"), F.col("p_brand"), F.lit("None"), F.col("p_type")))
        .when(kind == "LARGE", F.lit(" NaN "))
        .when(kind == "ECONOMY", F.concat(F.lit("['"), "p_name", F.lit("']")))
        .otherwise(F.concat_ws(", ", "p_name", "p_brand"))
    )
    rows = dt.table(spark, sf, "part").select("p_partkey", F.posexplode(N.parse_answers(cell)).alias("position", "answer"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("fn_uuid5", with_parts("SELECT chunk_id, fact_id, assertion_id FROM assertions", "assertions"))
def fn_uuid5(spark, sf):
    c, t = dt.chunks(spark, sf), F.col("tenant_id")
    quoted = c.select(t, "document_id", "chunk_index", F.explode(tx.sentence_spans(F.col("text"))).alias("span"))
    ids = quoted.select(t, "document_id", chunk_uuid(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
                        fact_uuid(t, F.col("span.quote")).alias("fact_id"), F.array("span").alias("spans"))
    return ids.select(
        "chunk_id", "fact_id",
        assertion_uuid(t, F.col("fact_id"), F.col("document_id"), F.col("chunk_id"), F.col("spans")).alias("assertion_id"),
    )


@query("fn_content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def fn_content_hash(spark, sf):
    return dt.spread_documents(spark, sf).select("doc_id", content_hash(F.encode("text", "UTF-8")).alias("digest"))
