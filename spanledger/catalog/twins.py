"""SQL twins of the derived tables, as named WITH parts for the checking SQL."""

from __future__ import annotations

from spanledger.sources.dimensions import (
    MODEL_ALIASES, PRICE_VERSIONS, PRICES, QUESTIONS, QUOTA_TIERS,
)
from spanledger.sources.driver_tables import EVENT_AUDIT, EVENT_MODELS, SOURCE_CLAUSES, TENANT_TIERS

URL_BYTES = "unhex('6ba7b8119dad11d180b400c04fd430c8')"


def u5(name: str, namespace: str = URL_BYTES) -> str:
    """Version 5 UUID text of an SQL string expression."""
    h = f"sha1({namespace} || encode({name}))"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)"
        f"||'-'||substr({h},21,12))"
    )


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    return "'" + str(value).replace("'", "''") + "'"


def rows(columns: str, values) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in values)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


ROUND = "CAST(round_even({}, 0) AS BIGINT)"

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), f"""SELECT source AS tenant_id, doc_id, lang, text,
        {u5("'document:' || CAST(doc_id AS VARCHAR)")} AS document_id FROM documents"""),
    "lines": (("docs",), """SELECT tenant_id, doc_id, document_id, lang,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l
        FROM docs"""),
    "chunk_rows": (("lines",), """SELECT tenant_id, doc_id, document_id, lang,
        unnest(range(len(l))) AS chunk_index, unnest(l) AS text FROM lines"""),
    "chunks": (("chunk_rows",), f"""SELECT tenant_id, doc_id, document_id, lang, chunk_index, text,
        {u5("CAST(chunk_index AS VARCHAR)", "unhex(replace(document_id,'-',''))")} AS chunk_id,
        CAST(len(list_filter(string_split(text,' '), lambda w: w <> '')) AS BIGINT) AS token_count
        FROM chunk_rows"""),
    "sentences": (("chunks",), """SELECT *, list_sum(list_transform(pieces[1:k - 1], lambda x: length(x))) AS before, pieces[k] AS piece
        FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS k FROM (SELECT *, regexp_extract_all(text, '[^.!?]+[.!?]*|[.!?]+') AS pieces FROM chunks))"""),
    "ents0": (("sentences",), """SELECT tenant_id, doc_id, document_id, lang, chunk_id, chunk_index,
        'Sentence of chunk ' || chunk_index AS name, start_offset, start_offset + length(trim(piece)) AS end_offset, trim(piece) AS quote
        FROM (SELECT *, CAST(coalesce(before, 0) + length(piece) - length(ltrim(piece)) AS INTEGER) AS start_offset FROM sentences) WHERE trim(piece) <> ''"""),
    "baseline": (("chunks",), f"""SELECT *, {u5("'entity:' || chunk_id || ':' || name || ':' || 0 || ':' || length(quote)")} AS entity_id
        FROM (SELECT tenant_id, chunk_id, 'Entity from chunk ' || chunk_index AS name, substr(text, 1, 50) AS quote FROM chunks)"""),
    "ents": (("ents0",), f"""SELECT *, 'Unknown' AS entity_type,
        {u5("'entity:' || chunk_id || ':' || name || ':' || start_offset || ':' || end_offset")} AS entity_id
        FROM ents0"""),
    "links": (("ents",), f"""SELECT tenant_id, document_id, chunk_id, entity_id AS source_entity_id,
        entity_id AS target_entity_id, 'RELATED_TO' AS edge_type, start_offset, end_offset, quote,
        {u5("'edge:' || entity_id || ':' || entity_id || ':RELATED_TO'")} AS edge_id FROM ents"""),
    "stated": (("ents",), f"""SELECT tenant_id, doc_id, document_id, lang, chunk_id, quote AS claim,
        start_offset, end_offset, quote, {u5("tenant_id || ':' || quote")} AS fact_id FROM ents"""),
    "assertions": (("stated",), f"""SELECT *, {u5("tenant_id||':'||fact_id||':'||document_id||':'||chunk_id||':'||start_offset||':'||end_offset||':'||quote")}
        AS assertion_id FROM stated"""),
    "spans": (("assertions",), f"""SELECT tenant_id, doc_id, document_id, assertion_id, chunk_id, start_offset, end_offset, quote,
        {u5("'span:'||assertion_id||':'||start_offset||':'||end_offset")} AS span_id FROM assertions"""),
    "facts": (("stated",), "SELECT DISTINCT tenant_id, fact_id, claim FROM stated"),
    "runs": (("docs",), f"""SELECT DISTINCT tenant_id, {u5("'run:'||tenant_id||':'||lang")} AS extraction_run_id,
        'contracts' AS ontology_name, CAST(CASE WHEN lang='en' THEN 2 ELSE 1 END AS BIGINT) AS ontology_version,
        'model-'||lang AS model_id, 'p1' AS prompt_version FROM docs WHERE lang <> 'es'"""),
    "doomed": (("docs",), """SELECT tenant_id, document_id, doc_id FROM docs
        WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""),
    "mentions": (("chunks",), f"""SELECT tenant_id, document_id, doc_id, chunk_id,
        {u5("'mention:'||chunk_id")} AS mention_id,
        array_to_string(list_filter(string_split(text,' '), lambda w: w <> '')[1:2], ' ') AS name
        FROM chunks WHERE token_count > 0"""),
    "members": (("mentions",), f"""SELECT *, {u5("'membership:'||mention_id")} AS membership_id,
        {u5("'cluster:'||tenant_id||':'||lower(string_split(name,' ')[1])")} AS cluster_id FROM mentions"""),
    # resolution
    "log": ((), """SELECT 'catalog' AS tenant_id, CAST(p_partkey AS VARCHAR) AS mention_id, 'name:'||p_name AS cluster_id,
          'rule' AS source, CAST(0.7 AS DOUBLE) AS confidence, TIMESTAMP '2024-01-01' AS decided_at, p_partkey + 1000000000000 AS seq FROM part
        UNION ALL SELECT 'catalog', CAST(p_partkey AS VARCHAR), 'own:'||p_partkey, 'human', CAST(1 AS DOUBLE), TIMESTAMP '2024-02-01', p_partkey + 2000000000000
          FROM part WHERE p_size >= 45
        UNION ALL SELECT 'catalog', CAST(p_partkey AS VARCHAR), 'brand:'||p_brand, 'model', CAST(0.9 AS DOUBLE), TIMESTAMP '2024-03-01', p_partkey + 3000000000000
          FROM part WHERE p_type = 'PROMO'"""),
    "judged_log": (("log",), """SELECT *, source||':'||cluster_id AS decision_id, source = 'human' OR NOT EXISTS (SELECT 1 FROM log h
        WHERE h.source='human' AND h.mention_id = l.mention_id AND h.seq < l.seq) AS ok FROM log l"""),
    "active": (("judged_log",), """SELECT * FROM judged_log WHERE ok
        QUALIFY row_number() OVER (PARTITION BY tenant_id, mention_id ORDER BY source='human' DESC, seq DESC) = 1"""),
    # time
    "bifacts": ((), """SELECT 'trade' AS tenant_id, o_orderkey AS fact_id, o_orderpriority||' '||o_orderstatus AS claim,
        CAST(o_custkey AS VARCHAR) AS subject, o_orderpriority AS predicate, o_orderstatus AS object,
        o_orderdate AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
        o_orderdate + to_days(CAST(floor(o_totalprice/20000) AS INTEGER)) AS created_at,
        CASE WHEN o_orderstatus='F' THEN o_orderdate + to_days(CAST(floor(o_totalprice/20000) AS INTEGER)) + INTERVAL 365 DAY END AS expired_at,
        CAST(NULL AS BIGINT) AS superseded_by_id FROM orders"""),
    "closed": (("bifacts",), """SELECT * REPLACE (lead(valid_from) OVER w AS valid_to, lead(fact_id) OVER w AS superseded_by_id)
        FROM bifacts WINDOW w AS (PARTITION BY tenant_id, subject, predicate ORDER BY valid_from, fact_id)"""),
    # graph
    "nodes": ((), " UNION ALL ".join(
        f"""SELECT 'trade' AS tenant_id, '{t}:'||{k} AS entity_id, {n} AS name, '{t}' AS entity_type, 'raw' AS kind,
        TIMESTAMP '2020-01-01' + INTERVAL {i} DAY + to_seconds({k}) AS created_at FROM {t}"""
        for i, (t, k, n) in enumerate((("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"),
            ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"))))),
    "arcs": ((), """SELECT 'trade' AS tenant_id, 'nation_in:'||n_nationkey AS edge_id, 'nation:'||n_nationkey AS source_entity_id,
          'region:'||n_regionkey AS target_entity_id, 'nation_in' AS edge_type, CAST(1 AS DOUBLE) AS weight,
          CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TIMESTAMP '2020-01-01' AS created_at FROM nation
        UNION ALL SELECT 'trade', 'customer_in:'||c_custkey, 'customer:'||c_custkey, 'nation:'||c_nationkey, 'customer_in', 1, NULL, NULL, TIMESTAMP '2020-01-01' FROM customer
        UNION ALL SELECT 'trade', 'supplier_in:'||s_suppkey, 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'supplier_in', 1, NULL, NULL, TIMESTAMP '2020-01-01' FROM supplier
        UNION ALL SELECT 'trade', 'bought:'||l_orderkey||':'||l_partkey, 'customer:'||o_custkey, 'part:'||l_partkey, 'bought', sum(l_quantity),
          o_orderdate, CASE WHEN max(l_shipdate) > o_orderdate THEN max(l_shipdate) END, o_orderdate
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey, o_custkey, o_orderdate"""),
    # dimensions
    "prices": ((), "SELECT * REPLACE (CAST(promo_until AS TIMESTAMP) AS promo_until) FROM (" + rows(
        "price_version, model_id, r1, r2, r3, r4, promo_until", PRICES) + ")"),
    "versions": ((), rows("price_version, state", PRICE_VERSIONS)),
    "aliases": ((), rows("alias, model_id", MODEL_ALIASES)),
    "tiers": ((), rows("tier, spend_cap_millicents, rate_limit_rpm, max_concurrent, period_days", QUOTA_TIERS)),
    "questions": ((), rows("question_id, category, fit",
        [(q, c, f) for q, cs, f in QUESTIONS for c in (cs or (None,))])),
    "event_models": ((), rows("event_type, model_id, provider, price_version", EVENT_MODELS)),
    "event_audit": ((), rows("event_type, audit_type", EVENT_AUDIT)),
    "tenant_tiers": (("tiers",), f"""SELECT tenant_id, t.* FROM (SELECT DISTINCT 't'||(user_id % 10) AS tenant_id FROM events) e
        LEFT JOIN ({rows('tenant_id, tier', TENANT_TIERS)}) n USING (tenant_id) JOIN tiers t ON t.tier = coalesce(n.tier, 'free')"""),
    # ledger
    "raw_usage": (("event_models",), """SELECT 't'||(user_id % 10) AS tenant_id, CAST(event_id AS VARCHAR) AS event_id, ts AS occurred_at,
        ts + to_hours(CAST(json_extract_string(props,'$.k') AS INTEGER)) AS recorded_at, e.event_type, provider, model_id, price_version,
        'user-'||user_id AS document_id, CAST(floor(value*100) AS BIGINT) AS input_tokens,
        CAST(json_extract_string(props,'$.k') AS BIGINT) AS output_tokens, user_id AS cache_read_input_tokens,
        CAST(0 AS BIGINT) AS cache_write_input_tokens, FALSE AS is_correction, CAST(NULL AS VARCHAR) AS correction_for_event_id
        FROM events e JOIN event_models m ON e.event_type = m.event_type"""),
    "usage_events": (("raw_usage", "prices", "aliases"), f"""SELECT u.*, {ROUND.format(
        "CAST(input_tokens AS DOUBLE)*r1 + CAST(output_tokens AS DOUBLE)*r2 + CAST(cache_read_input_tokens AS DOUBLE)*r3 + CAST(cache_write_input_tokens AS DOUBLE)*r4")} AS cost_millicents
        FROM raw_usage u LEFT JOIN aliases a ON a.alias = u.model_id
        LEFT JOIN prices p ON p.price_version = u.price_version AND p.model_id =
          CASE WHEN EXISTS (SELECT 1 FROM prices x WHERE x.price_version = u.price_version AND x.model_id = u.model_id)
          THEN u.model_id ELSE coalesce(a.model_id, u.model_id) END"""),
    "delivered": (("usage_events",), """SELECT * FROM usage_events UNION ALL
        SELECT * REPLACE (recorded_at + INTERVAL 1 HOUR AS recorded_at) FROM usage_events WHERE event_type = 'error'"""),
    "fixes": (("usage_events", "prices", "aliases"), f"""SELECT tenant_id, 'fix-'||event_id AS event_id, occurred_at + INTERVAL 1 DAY AS occurred_at,
        'correction' AS event_type, provider, u.model_id, u.price_version, document_id,
        -CAST(floor(input_tokens/2) AS BIGINT) AS input_tokens, -output_tokens AS output_tokens,
        CAST(0 AS BIGINT) AS cache_read_input_tokens, CAST(0 AS BIGINT) AS cache_write_input_tokens, TRUE AS is_correction,
        event_id AS correction_for_event_id,
        {ROUND.format("CAST(-CAST(floor(input_tokens/2) AS BIGINT) AS DOUBLE)*r1 + CAST(-output_tokens AS DOUBLE)*r2")} AS cost_millicents
        FROM usage_events u LEFT JOIN aliases a ON a.alias = u.model_id JOIN prices p ON p.price_version = u.price_version
          AND p.model_id = coalesce(a.model_id, u.model_id)
        WHERE event_type = 'purchase' AND input_tokens > 10000"""),
    "ledger": (("usage_events", "fixes"), """SELECT tenant_id, event_id, occurred_at, event_type, provider, model_id, price_version, document_id,
        input_tokens, output_tokens, cache_read_input_tokens, cache_write_input_tokens, is_correction, correction_for_event_id, cost_millicents FROM usage_events
        UNION ALL SELECT tenant_id, event_id, occurred_at, event_type, provider, model_id, price_version, document_id,
        input_tokens, output_tokens, cache_read_input_tokens, cache_write_input_tokens, is_correction, correction_for_event_id, cost_millicents FROM fixes"""),
    "audit": (("event_audit",), f"""SELECT {u5("'audit:'||event_id")} AS id, 't'||(user_id % 10) AS tenant_id, CAST(event_id AS VARCHAR) AS event_id,
        audit_type AS event_type, e.event_type AS action, ts AS occurred_at, 'user-'||user_id AS actor_id,
        CASE WHEN audit_type='llm_invocation' THEN 'model-large-5' END AS model,
        CASE WHEN audit_type='llm_invocation' AND value > 10 THEN 'v1' END AS model_version,
        CASE WHEN audit_type='llm_invocation' THEN CAST(floor(value*100) AS BIGINT) END AS input_tokens,
        CASE WHEN audit_type='llm_invocation' THEN CAST(json_extract_string(props,'$.k') AS BIGINT) END AS output_tokens,
        props AS metadata_json FROM events e JOIN event_audit a ON a.event_type = e.event_type"""),
    "requests": ((), """SELECT 't'||(user_id % 10) AS tenant_id, CAST(event_id AS VARCHAR) AS event_id, ts AS occurred_at, epoch_us(ts) AS at_micros,
        epoch_us(ts) + (CAST(json_extract_string(props,'$.k') AS BIGINT) + 1) * 60000000 AS until_micros FROM events"""),
    # evaluation
    "contracts": ((), """SELECT 'doc-'||d.doc_id AS contract, d.doc_id, text, lang, source, n_chars, quality, toxic,
        date '2010-01-01' + CAST(n_chars AS INTEGER) AS day, upper(source[1])||source[2:] AS source_name, upper(lang[1])||lang[2:] AS lang_name
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id"""),
    "clauses": ((), rows("source, clause", SOURCE_CLAUSES)),
}


def with_parts(body: str, *names: str) -> str:
    """``body`` preceded by the named parts and all they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in PARTS[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    listed = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    return f"WITH RECURSIVE {listed}\n{body}" if listed else body
