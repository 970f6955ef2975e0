"""Usage, quota, audit and ontology."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spanledger.catalog import query
from spanledger.catalog.twins import with_parts
from spanledger.functions.usage import usage_from_json
from spanledger.operators import audit, ontology, quota, usage
from spanledger.sources import dimensions as dim
from spanledger.sources import driver_tables as dt

SUMS = """count(*) AS event_count, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
    CAST(sum(cache_read_input_tokens) AS BIGINT) AS total_cache_read_tokens, CAST(sum(cache_write_input_tokens) AS BIGINT) AS total_cache_write_tokens,
    CAST(sum(cost_millicents) AS BIGINT) AS total_cost_millicents"""
NAMES = ("event_count", "total_input_tokens", "total_output_tokens", "total_cache_read_tokens", "total_cache_write_tokens", "total_cost_millicents")


@query("fn_cost_millicents", with_parts("SELECT event_id, model_id, cost_millicents FROM usage_events", "usage_events"))
def fn_cost_millicents(spark, sf):
    return dt.usage_events(spark, sf).select("event_id", "model_id", "cost_millicents")


@query("fn_usage_from_json", """
    SELECT event_id, CASE WHEN event_type = 'click' THEN greatest(0, k - user_id) WHEN event_type = 'view' THEN greatest(0, k - user_id)
        WHEN event_type = 'error' THEN 0 ELSE k END AS input_tokens,
      CASE event_type WHEN 'click' THEN user_id WHEN 'view' THEN user_id + k WHEN 'error' THEN 0 WHEN 'signup' THEN user_id ELSE 0 END AS output_tokens,
      CASE event_type WHEN 'click' THEN user_id WHEN 'view' THEN user_id WHEN 'signup' THEN 3 ELSE 0 END AS cache_read_input_tokens,
      CAST(CASE event_type WHEN 'signup' THEN 4 ELSE 0 END AS BIGINT) AS cache_write_input_tokens
    FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)""")
def fn_usage_from_json(spark, sf):
    k, u = F.get_json_object("props", "$.k").cast("bigint"), F.col("user_id")
    plain = F.struct(k.alias("input_tokens"), u.alias("output_tokens"), F.lit(3).alias("cache_read_input_tokens"),
                     F.lit(4).alias("cache_creation_input_tokens"))
    chat = F.struct(k.alias("prompt_tokens"), u.alias("completion_tokens"),
                    F.struct(u.alias("cached_tokens")).alias("prompt_tokens_details"))
    thinking = F.struct(k.alias("promptTokenCount"), u.alias("cachedContentTokenCount"), u.alias("candidatesTokenCount"),
                        k.alias("thoughtsTokenCount"))
    kind = F.col("event_type")
    payload = (
        F.when(kind == "click", F.to_json(F.struct(chat.alias("usage"))))
        .when(kind == "view", F.to_json(thinking))
        .when(kind == "signup", F.to_json(F.struct(plain.alias("usage"))))
        .when(kind == "error", F.lit("{}"))
        .otherwise(F.to_json(F.struct(k.alias("input_tokens"))))
    )
    return dt.table(spark, sf, "events").select("event_id", usage_from_json(payload).alias("u")).select("event_id", "u.*")


@query("join_correction_orig", with_parts("""
    SELECT 'fix-'||event_id AS event_id, CASE WHEN event_type = 'view' THEN 'price_version_differs' WHEN event_type = 'signup' THEN 'original_not_found' END AS reason
    FROM raw_usage""", "raw_usage"))
def join_correction_orig(spark, sf):
    events = dt.usage_events(spark, sf)
    kind = F.col("event_type")
    # one correction per event; some name another price version, some an unknown event
    fixes = events.withColumns({
        "is_correction": F.lit(True),
        "correction_for_event_id": F.when(kind == "signup", F.concat(F.lit("lost-"), "event_id")).otherwise(F.col("event_id")),
        "price_version": F.when(kind == "view", "2026-Q2").otherwise(F.col("price_version")),
        "event_id": F.concat(F.lit("fix-"), "event_id"),
    })
    return usage.correction_verdicts(events.unionByName(fixes)).select("event_id", "reason")


@query("win_first_event", with_parts("""
    SELECT tenant_id, event_id, recorded_at, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY recorded_at) > 1 AS is_duplicate FROM delivered""", "delivered"))
def win_first_event(spark, sf):
    rows = usage.with_duplicate_flag(dt.delivered_usage(spark, sf), ["recorded_at"])
    return rows.select("tenant_id", "event_id", "recorded_at", "is_duplicate")


@query("agg_usage_tenant", with_parts(f"""
    , t AS (SELECT 't'||i AS tenant_id FROM range(0, 12) r(i)), s AS (SELECT tenant_id, {SUMS} FROM ledger
      WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT tenant_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in NAMES)}, coalesce(total_cost_millicents, 0) / CAST(100000 AS DOUBLE) AS total_cost_dollars
    FROM t LEFT JOIN s USING (tenant_id)""", "ledger"))
def agg_usage_tenant(spark, sf):
    # two of the twelve tenants have no events
    tenants = spark.range(12).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tenant_id"))
    rows = usage.in_period(dt.corrected_ledger(spark, sf), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return usage.tenant_usage(rows, tenants)


@query("agg_usage_document", with_parts(f"SELECT tenant_id, document_id, {SUMS} FROM ledger GROUP BY ALL", "ledger"))
def agg_usage_document(spark, sf):
    return usage.usage_totals(dt.corrected_ledger(spark, sf), ["tenant_id", "document_id"])


@query("agg_llm_token_metrics", with_parts("""
    SELECT tenant_id, provider, model_id, token_type, count(*) AS n_points, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
      SELECT tenant_id, provider, model_id, 'input' AS token_type, input_tokens AS n FROM usage_events
      UNION ALL SELECT tenant_id, provider, model_id, 'output', output_tokens FROM usage_events
      UNION ALL SELECT tenant_id, provider, model_id, 'cache_read', cache_read_input_tokens FROM usage_events WHERE cache_read_input_tokens <> 0
      UNION ALL SELECT tenant_id, provider, model_id, 'cache_write', cache_write_input_tokens FROM usage_events WHERE cache_write_input_tokens <> 0) GROUP BY ALL""", "usage_events"))
def agg_llm_token_metrics(spark, sf):
    return usage.token_metrics(dt.usage_events(spark, sf))


@query("job_usage_correct", with_parts("""SELECT tenant_id, event_id, correction_for_event_id, event_type, provider, model_id, price_version, document_id,
    input_tokens, output_tokens, cost_millicents, occurred_at, 'counted twice' AS reason FROM fixes""", "fixes"))
def job_usage_correct(spark, sf):
    return usage.corrections(
        dt.usage_events(spark, sf), dt.correction_requests(spark, sf), dim.prices(spark), dim.model_aliases(spark)
    ).select("tenant_id", "event_id", "correction_for_event_id", "event_type", "provider", "model_id", "price_version",
             "document_id", "input_tokens", "output_tokens", "cost_millicents", "occurred_at", "reason")


# ---- quota -------------------------------------------------------------------


@query("win_spend_trailing", with_parts("""
    SELECT tenant_id, event_id, spent AS spent_millicents, spent + cost_millicents >= spend_cap_millicents AS breach FROM (
      SELECT u.*, CAST(coalesce(sum(cost_millicents) OVER (PARTITION BY u.tenant_id ORDER BY epoch_us(occurred_at)
        RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent, spend_cap_millicents
      FROM usage_events u JOIN tenant_tiers USING (tenant_id))""", "usage_events", "tenant_tiers"))
def win_spend_trailing(spark, sf):
    # the events span one month, so a period of a week shows both edges
    events = dt.usage_events(spark, sf).withColumn("at_micros", dt.micros(F.col("occurred_at")))
    rows = quota.trailing_spend(events, dt.tenant_tiers(spark, sf), 7)
    return rows.select("tenant_id", "event_id", "spent_millicents", "breach")


@query("win_rate_observed", with_parts("""
    SELECT tenant_id, event_id, in_window, in_window >= rate_limit_rpm AS over_limit FROM (
      SELECT r.*, rate_limit_rpm, count(*) OVER (PARTITION BY r.tenant_id ORDER BY at_micros // 60
        RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) AS in_window FROM (SELECT * REPLACE (at_micros AS at_micros) FROM requests) r JOIN tenant_tiers USING (tenant_id))""".replace(
    "at_micros // 60", "at_micros"), "requests", "tenant_tiers"))
def win_rate_observed(spark, sf):
    return quota.observed_rate(dt.requests(spark, sf), dt.tenant_tiers(spark, sf)).select(
        "tenant_id", "event_id", "in_window", "over_limit"
    )


@query("win_concurrency_peak", with_parts("""
    , moves AS (SELECT tenant_id, event_id, at_micros AS moment, 1 AS delta FROM requests UNION ALL SELECT tenant_id, event_id, until_micros, -1 FROM requests)
    SELECT tenant_id, event_id, CAST(active AS BIGINT) AS active, active > max_concurrent AS over_limit FROM (
      SELECT *, sum(delta) OVER (PARTITION BY tenant_id ORDER BY moment, delta, event_id ROWS UNBOUNDED PRECEDING) AS active FROM moves)
    JOIN tenant_tiers USING (tenant_id) WHERE delta = 1""", "requests", "tenant_tiers"))
def win_concurrency_peak(spark, sf):
    return quota.concurrency(dt.slots(spark, sf), dt.tenant_tiers(spark, sf)).select(
        "tenant_id", "event_id", "active", "over_limit"
    )


def slot_requests(spark, sf):
    """Requests for ingestion slots with the tenant's limit."""
    tiers = dt.tenant_tiers(spark, sf).select("tenant_id", F.col("max_concurrent").alias("cap"))
    return dt.slots(spark, sf).join(tiers, "tenant_id")


def rate_requests(spark, sf):
    """Requests whose window is stretched to an hour, so that the limit bites on these data."""
    tiers = dt.tenant_tiers(spark, sf).select("tenant_id", F.lit(2).cast("bigint").alias("cap"))
    rows = dt.requests(spark, sf).join(tiers, "tenant_id")
    return rows.withColumn("until_micros", F.col("at_micros") + 60 * quota.RATE_WINDOW)


# admission in DuckDB: one recursive step per request of a tenant, the state in a list
ADMIT = """
    , nr AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY at_micros, event_id) AS i FROM asked)
    , run AS (SELECT tenant_id, event_id, i, cap > 0 AS accepted, CASE WHEN cap > 0 THEN [until_micros] ELSE CAST([] AS BIGINT[]) END AS held FROM nr WHERE i = 1
      UNION ALL SELECT n.tenant_id, n.event_id, n.i, len(list_filter(r.held, lambda e: e > n.at_micros)) < n.cap,
        CASE WHEN len(list_filter(r.held, lambda e: e > n.at_micros)) < n.cap THEN list_append(list_filter(r.held, lambda e: e > n.at_micros), n.until_micros)
        ELSE list_filter(r.held, lambda e: e > n.at_micros) END
      FROM run r JOIN nr n ON n.tenant_id = r.tenant_id AND n.i = r.i + 1)"""


@query("win_slot_admission", with_parts("""
    , asked AS (SELECT tenant_id, event_id, at_micros, until_micros, max_concurrent AS cap FROM requests JOIN tenant_tiers USING (tenant_id))"""
    + ADMIT + " SELECT tenant_id, event_id, accepted FROM run", "requests", "tenant_tiers"))
def win_slot_admission(spark, sf):
    return quota.admissions(slot_requests(spark, sf))


@query("win_rate_admission", with_parts("""
    , asked AS (SELECT tenant_id, event_id, at_micros, at_micros + 3600000000 AS until_micros, CAST(2 AS BIGINT) AS cap FROM requests)"""
    + ADMIT + " SELECT tenant_id, event_id, accepted FROM run", "requests"))
def win_rate_admission(spark, sf):
    return quota.admissions(rate_requests(spark, sf))


ADMIT_RATES = re.sub(r"\b(asked|nr|run)\b", r"\1_rate", ADMIT)


REFUSED_SLOTS_AND_RATES = with_parts("""
    , asked AS (SELECT tenant_id, event_id, at_micros, until_micros, max_concurrent AS cap FROM requests JOIN tenant_tiers USING (tenant_id))
    , asked_rate AS (SELECT tenant_id, event_id, at_micros, at_micros + 3600000000 AS until_micros, CAST(2 AS BIGINT) AS cap FROM requests)"""
    + ADMIT + ADMIT_RATES + """
    , refused AS (SELECT tenant_id, event_id, 'slot' AS gate, cap FROM run JOIN asked USING (tenant_id, event_id) WHERE NOT accepted
      UNION ALL SELECT tenant_id, event_id, 'rate', cap FROM run_rate JOIN asked_rate USING (tenant_id, event_id) WHERE NOT accepted)
    SELECT 'refusal-'||gate||'-'||event_id AS event_id, tenant_id, 'authorization_failure' AS event_type,
      CASE gate WHEN 'slot' THEN 'concurrent_limit_exceeded' ELSE 'rate_limit_exceeded' END AS action, occurred_at, 'user' AS actor_type, 'quota' AS scope,
      CASE gate WHEN 'slot' THEN '{"active":'||cap||',"max_concurrent":'||cap||',"reason":"concurrent ingestion limit"}'
        ELSE '{"in_window":'||cap||',"rate_limit":'||cap||',"reason":"request rate limit"}' END AS metadata_json
    FROM refused JOIN requests USING (tenant_id, event_id)""", "requests", "tenant_tiers")


def slot_and_rate_refusals(spark, sf):
    """A gate refuses exactly when as many admitted requests hold as its limit allows."""
    def refused(requests, gate, action, reason, held, limit):
        out = quota.admissions(requests).where("not accepted").join(requests.select("tenant_id", "event_id", "at_micros", "cap"), ["tenant_id", "event_id"])
        rows = out.withColumns({"occurred_at": F.timestamp_micros("at_micros").cast("timestamp_ntz"), held: F.col("cap"), limit: F.col("cap")})
        return audit.refusals(rows, action, F.lit(reason), [held, limit], F.concat(F.lit(f"refusal-{gate}-"), "event_id"))

    slots = refused(slot_requests(spark, sf), "slot", "concurrent_limit_exceeded", "concurrent ingestion limit", "active", "max_concurrent")
    return slots.unionByName(refused(rate_requests(spark, sf), "rate", "rate_limit_exceeded", "request rate limit", "in_window", "rate_limit"))


# spend caps are cut to a thousandth, so that these data reach them
CAP_PART = 1000
REFUSED = f"SELECT * FROM ({REFUSED_SLOTS_AND_RATES}) UNION ALL SELECT * FROM (" + with_parts("""
    SELECT 'refusal-spend-'||event_id AS event_id, tenant_id, 'authorization_failure' AS event_type, 'spend_cap_exceeded' AS action, occurred_at, 'user' AS actor_type, 'quota' AS scope,
      '{"current_spend_millicents":'||spent||',"spend_cap_millicents":'||spend_cap_millicents||',"projected_cost_millicents":'||cost_millicents||',"reason":"period spend cap"}' AS metadata_json
    FROM (SELECT u.*, CAST(coalesce(sum(cost_millicents) OVER (PARTITION BY u.tenant_id ORDER BY epoch_us(occurred_at)
        RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent, spend_cap_millicents // 1000 AS spend_cap_millicents
      FROM usage_events u JOIN tenant_tiers USING (tenant_id)) WHERE spent + cost_millicents >= spend_cap_millicents""", "usage_events", "tenant_tiers") + ")"


@query("job_quota_refusals_all", REFUSED)
@query("job_quota_refusals", REFUSED)
def job_quota_refusals(spark, sf):
    """Slots, rates and, as the third gate, the spend cap; two names of one job."""
    events = dt.usage_events(spark, sf).withColumn("at_micros", dt.micros(F.col("occurred_at")))
    tiers = dt.tenant_tiers(spark, sf).withColumn("spend_cap_millicents", F.floor(F.col("spend_cap_millicents") / CAP_PART).cast("bigint"))
    return slot_and_rate_refusals(spark, sf).unionByName(spend_refusals(events, tiers, 7))


def spend_refusals(events, tiers, period_days):
    """Audit rows of the events whose cost reaches the spend cap."""
    over = quota.trailing_spend(events, tiers, period_days).where("breach").select(
        "tenant_id", "event_id", F.timestamp_micros("at_micros").cast("timestamp_ntz").alias("occurred_at"),
        F.col("spent_millicents").alias("current_spend_millicents"), "spend_cap_millicents", F.col("cost_millicents").alias("projected_cost_millicents"))
    details = ["current_spend_millicents", "spend_cap_millicents", "projected_cost_millicents"]
    return audit.refusals(over, "spend_cap_exceeded", F.lit("period spend cap"), details, F.concat(F.lit("refusal-spend-"), "event_id"))


@query("job_audit_prune", with_parts("""
    SELECT id, occurred_at < TIMESTAMP '2025-04-15 10:00:00' - INTERVAL 15 MONTH AS expired FROM audit""", "audit"))
def job_audit_prune(spark, sf):
    kept, expired = audit.prune(dt.audit_events(spark, sf), F.lit("2025-04-15 10:00:00").cast("timestamp_ntz"))
    return kept.select("id", F.lit(False).alias("expired")).unionByName(expired.select("id", F.lit(True).alias("expired")))


# ---- ontology ----------------------------------------------------------------


def ontologies(spark, sf):
    """Two versions per brand: the part types of its small parts, then of all its parts."""
    p = dt.table(spark, sf, "part")

    def version(number, rows):
        # the number of distinct types is small and fixed
        types = rows.select("p_brand", "p_type").distinct().groupBy("p_brand").agg(
            F.sort_array(F.collect_list("p_type")).alias("entity_types"))
        return types.select(
            F.lit("catalog").alias("tenant_id"), F.col("p_brand").alias("ontology_name"),
            F.lit(number).cast("bigint").alias("ontology_version"), "entity_types",
            F.array(F.lit("MADE_BY")).alias("edge_types"),
        )

    return version(1, p.where("p_size <= 10")).unionByName(version(2, p))


ONTO = """ont AS (SELECT p_brand AS ontology_name, 1 AS v, list_sort(list(DISTINCT p_type)) AS types FROM part WHERE p_size <= 10 GROUP BY 1
    UNION ALL SELECT p_brand, 2, list_sort(list(DISTINCT p_type)) FROM part GROUP BY 1)"""


@query("win_latest_ontology", f"""WITH {ONTO} SELECT ontology_name, CAST(v AS BIGINT) AS ontology_version, array_to_string(types, ',') AS types
    FROM ont QUALIFY row_number() OVER (PARTITION BY ontology_name ORDER BY v DESC) = 1""")
def win_latest_ontology(spark, sf):
    rows = ontology.latest(ontologies(spark, sf))
    return rows.select("ontology_name", "ontology_version", F.array_join("entity_types", ",").alias("types"))


@query("win_next_ontology", f"""WITH {ONTO}, o AS (SELECT * FROM ont WHERE v = 1)
    SELECT p_brand AS ontology_name, CAST(coalesce(o.v, 0) + 1 AS BIGINT) AS ontology_version,
      CASE WHEN o.types IS NULL THEN '' ELSE array_to_string(o.types, ',') END AS types, 'new' AS edges,
      EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size <= 10) AND p_brand < 'Brand#2' AS refused
    FROM (SELECT DISTINCT p_brand FROM part) p LEFT JOIN o ON o.ontology_name = p_brand""")
def win_next_ontology(spark, sf):
    stored = ontologies(spark, sf).where("ontology_version = 1")
    proposals = dt.table(spark, sf, "part").select(
        F.lit("catalog").alias("tenant_id"), F.col("p_brand").alias("ontology_name"),
        F.lit(None).cast("array<string>").alias("entity_types"), F.array(F.lit("new")).alias("edge_types"),
    ).distinct()
    news = ontology.next_versions(stored, proposals)
    # some brands try to publish their first version once more
    again = F.col("ontology_name") < "Brand#2"
    tried = news.withColumn("ontology_version", F.when(again, F.lit(1).cast("bigint")).otherwise(F.col("ontology_version")))
    _, refused = ontology.publish(stored, tried)
    mark = refused.select("tenant_id", "ontology_name", F.lit(True).alias("refused"))
    return news.join(mark, ["tenant_id", "ontology_name"], "left").select(
        "ontology_name", "ontology_version", F.array_join("entity_types", ",").alias("types"),
        F.array_join("edge_types", ",").alias("edges"), F.coalesce("refused", F.lit(False)).alias("refused"),
    )
