"""The audit log: what may enter it, how it is exported, how long it stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metadata keys that would carry document text, and the longest string allowed.
FORBIDDEN_KEYS = ("text", "document_text", "content", "raw_content", "body", "document_body")
MAX_TEXT = 500
# Fixed value: months an audit event is kept.
RETENTION_MONTHS = 15
# Kinds of audit event.
EVENT_TYPES = (
    "authentication", "authorization_failure", "admin_change", "data_access", "data_export",
    "data_deletion", "api_key_lifecycle", "llm_invocation",
)
# Columns of an export, in order.
EXPORT_COLUMNS = (
    "id", "tenant_id", "event_id", "event_type", "action", "occurred_at", "recorded_at",
    "actor_id", "actor_type", "resource_type", "resource_id", "scope", "data_hash", "model",
    "model_version", "input_tokens", "output_tokens", "cache_read_input_tokens",
    "cache_write_input_tokens", "metadata",
)

# a JSON string with its escapes, and the colon that makes it a key
JSON_STRING = r'"(?:[^"\\]|\\.)*+"\s*:?'


def _unescaped(quoted: Column) -> Column:
    """The characters a quoted JSON string stands for, by reading it as a one-element array."""
    return F.get(F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>"), 0)


def holds_document_text(metadata: Column) -> Column:
    """True when a key at any depth is forbidden or any string is too long, escapes decoded."""
    strings = F.regexp_extract_all(F.coalesce(metadata, F.lit("")), F.lit(JSON_STRING), F.lit(0))

    def bad(s: Column) -> Column:
        quoted = F.regexp_extract(s, r'(?s)^(".*")\s*:?$', 1)
        bare = _unescaped(quoted)
        is_key = s.rlike(r":$")
        found = F.when(is_key, F.lower(bare).isin(*FORBIDDEN_KEYS)).otherwise(F.length(bare) > MAX_TEXT)
        return F.coalesce(found, F.lit(True))  # a string that can't be read is refused

    return F.exists(strings, bad)


def unreadable(metadata: Column) -> Column:
    """True for metadata that is given but is no JSON object."""
    return metadata.isNotNull() & F.try_parse_json(metadata).isNull() | F.coalesce(~metadata.rlike(r"^\s*\{"), F.lit(False))


def judged(events: DataFrame) -> DataFrame:
    """Adds ``reason``: why the log refuses the event, NULL when it takes it."""
    llm = F.col("event_type") == "llm_invocation"

    def empty(c: str) -> Column:
        return F.coalesce(F.length(c), F.lit(0)) == 0

    return events.withColumn(
        "reason",
        F.when(unreadable(F.col("metadata_json")), "metadata_unreadable")
        .when(holds_document_text(F.col("metadata_json")), "document_text")
        .when(llm & (empty("model") | empty("model_version")), "model_missing")
        .when(llm & ((F.col("input_tokens") < 0) | (F.col("output_tokens") < 0)), "negative_tokens"),
    )


def _iso(ts: Column) -> Column:
    """ISO text in UTC; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


def export_rows(events: DataFrame) -> DataFrame:
    """The export columns in order, instants as text, metadata as JSON text."""
    cols = {c: F.col(c) for c in EXPORT_COLUMNS if c in events.columns}
    for c in EXPORT_COLUMNS:
        cols.setdefault(c, F.lit(None).cast("string"))
    cols["metadata"] = F.col("metadata_json")
    for c in ("occurred_at", "recorded_at"):
        cols[c] = _iso(F.col(c))
    return events.select(*[cols[c].alias(c) for c in EXPORT_COLUMNS])


def export_jsonl(events: DataFrame) -> DataFrame:
    """One JSON object per line, metadata nested, NULL kept; ordered by time."""
    rows = export_rows(events)
    scalars = [c for c in EXPORT_COLUMNS if c != "metadata"]
    head = F.to_json(F.struct(*scalars), {"ignoreNullFields": "false"})
    line = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"metadata":'),
        F.coalesce(F.col("metadata"), F.lit("{}")),
        F.lit("}"),
    )
    return rows.orderBy("occurred_at", "event_id").select(
        "tenant_id", "event_id", line.alias("line")
    )


def export_csv(events: DataFrame) -> DataFrame:
    """The columns of the CSV export; NULL and absent metadata become empty text."""
    return (
        export_rows(events)
        .orderBy("occurred_at", "event_id")
        .select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS])
    )


def retention_cutoff(as_of: Column) -> Column:
    """The day is clamped to the end of the month, the time of day stays."""
    return as_of - F.expr(f"INTERVAL '{RETENTION_MONTHS}' MONTH")


def prune(events: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) events of all tenants."""
    old = F.col("occurred_at") < retention_cutoff(as_of)
    return events.where(~old), events.where(old)


def refusals(
    refused: DataFrame, action: str, reason: Column, details: list[str], event_id: Column
) -> DataFrame:
    """Audit rows for requests a quota turned away."""
    return refused.select(
        "tenant_id",
        event_id.alias("event_id"),
        F.lit("authorization_failure").alias("event_type"),
        F.lit(action).alias("action"),
        F.col("occurred_at"),
        F.lit("user").alias("actor_type"),
        F.lit("quota").alias("scope"),
        F.to_json(F.struct(*details, reason.alias("reason"))).alias("metadata_json"),
    )
