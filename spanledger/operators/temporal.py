"""Facts over valid time and system time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.intervals import contains
from spanledger.operators.interval_join import points_in_intervals
from spanledger.operators.ordered import with_next
from spanledger.session import cut_lineage

Instant = dt.datetime | str


def instant(value: Instant) -> Column:
    """A literal instant without zone; aware values are moved to UTC."""
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(str(value)).cast("timestamp_ntz")


def as_of_valid(facts: DataFrame, at: Instant | None) -> DataFrame:
    """Facts valid in the world at ``at``; no instant means no constraint."""
    if at is None:
        return facts
    return facts.where(contains(F.col("valid_from"), F.col("valid_to"), instant(at)))


def as_of_system(facts: DataFrame, at: Instant | None) -> DataFrame:
    """Facts the system believed at ``at``; no instant means not expired."""
    if at is None:
        return facts.where(F.col("expired_at").isNull())
    return facts.where(contains(F.col("created_at"), F.col("expired_at"), instant(at)))


def as_of(
    facts: DataFrame,
    valid: Instant | None = None,
    system: Instant | None = None,
    subject: str | None = None,
    predicate: str | None = None,
) -> DataFrame:
    """Both times at once, newest validity first."""
    rows = facts
    if subject is not None:
        rows = rows.where(F.col("subject") == subject)
    if predicate is not None:
        rows = rows.where(F.col("predicate") == predicate)
    return as_of_system(as_of_valid(rows, valid), system).orderBy(F.desc("valid_from"), "fact_id")


def as_of_each(facts: DataFrame, instants: Sequence[Instant]) -> DataFrame:
    """Facts valid at each of a short list of instants, one row per hit; no join."""
    listed = F.array(*[instant(i) for i in instants])
    hits = F.filter(listed, lambda i: contains(F.col("valid_from"), F.col("valid_to"), i))
    return facts.withColumn("as_of", F.explode(hits))


def as_of_table(facts: DataFrame, asked: DataFrame, keys: Sequence[str] = ("tenant_id", "subject")) -> DataFrame:
    """Every row of ``asked`` (keys, valid_at, system_at, ...) with every fact of its keys as of its own two instants.

    A null valid_at sets no constraint, a null system_at asks for facts that have not expired, as in ``as_of``. Rows that
    find no fact drop out. The instants meet the intervals in buckets of several levels (``points_in_intervals``): by valid
    time where it is given, else by system time. Other columns of ``asked`` must differ from those of ``facts``.
    """
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    valid, system = F.col("valid_at"), F.col("system_at")
    believed = F.when(system.isNull(), F.col("expired_at").isNull()).otherwise(contains(F.col("created_at"), F.col("expired_at"), system))

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    def at(points: DataFrame, instant_: str, start: str, end: str) -> DataFrame:
        return points_in_intervals(points, facts, keys, micros(instant_), micros(start), micros(end))

    # both are read several times, and may be joins themselves
    asked, facts = cut_lineage(asked.where(keyed)), cut_lineage(facts)
    by_valid = at(asked.where(valid.isNotNull()), "valid_at", "valid_from", "valid_to").where(believed)
    by_system = at(asked.where(valid.isNull() & system.isNotNull()), "system_at", "created_at", "expired_at")
    neither = asked.where(valid.isNull() & system.isNull()).join(facts.where(F.col("expired_at").isNull()), list(keys))
    return by_valid.unionByName(by_system).unionByName(neither)


def timeline(facts: DataFrame, subject: str, predicate: str) -> DataFrame:
    return facts.where((F.col("subject") == subject) & (F.col("predicate") == predicate)).orderBy(
        "valid_from", "fact_id"
    )


def close_superseded(facts: DataFrame) -> DataFrame:
    """Closes each fact at the start of the next one with its subject and predicate."""
    chained = with_next(
        facts,
        ["tenant_id", "subject", "predicate"],
        F.date_trunc("day", F.col("valid_from")),
        ["valid_from", "fact_id"],
        ["valid_from", "fact_id"],
    )
    return (
        chained.withColumn("valid_to", F.coalesce("next_valid_from", "valid_to"))
        .withColumn("superseded_by_id", F.col("next_fact_id"))
        .drop("next_valid_from", "next_fact_id")
    )


def supersede(
    facts: DataFrame, batch: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Applies a batch of supersessions; (new fact table, refused rows with a reason).

    ``batch`` holds prior_fact_id, the successor as a struct column ``successor``
    shaped like a fact row, and optional closing_valid_instant and
    system_invalidation_instant. The prior row stays, closed and linked.
    """
    columns = facts.columns
    priors = facts.select(
        "tenant_id", F.col("fact_id").alias("prior_fact_id"),
        F.col("valid_from").alias("prior_from"),
    )
    close = F.coalesce("closing_valid_instant", F.col("successor.valid_from"))
    judged = (
        batch.withColumn("tenant_id", F.col("successor.tenant_id"))
        .withColumn("closed_at", close)
        .join(priors, ["tenant_id", "prior_fact_id"], "left")
        .withColumn(
            "reason",
            F.when(F.col("prior_from").isNull(), "prior_not_found").when(
                F.col("closed_at") < F.col("prior_from"), "closes_before_start"
            ),
        )
    )
    good = judged.where(F.col("reason").isNull())
    refused = judged.where(F.col("reason").isNotNull()).select(
        "tenant_id", "prior_fact_id", F.col("successor.fact_id").alias("fact_id"), "reason"
    )
    # the last supersession of a prior decides, as if applied one after the other
    closing = good.groupBy("tenant_id", F.col("prior_fact_id").alias("fact_id")).agg(
        F.max(F.struct("closed_at", "successor.fact_id", "system_invalidation_instant")).alias("c")
    )
    added = good.select("successor.*").select(*columns)
    kept = facts.join(added.select("tenant_id", "fact_id"), ["tenant_id", "fact_id"], "left_anti")
    everything = kept.unionByName(added).join(closing, ["tenant_id", "fact_id"], "left")
    hit = F.col("c").isNotNull()
    updated = everything.select(
        *[
            F.when(hit, F.col("c.closed_at")).otherwise(F.col("valid_to")).alias("valid_to")
            if c == "valid_to"
            else F.when(hit, F.col("c.fact_id")).otherwise(F.col(c)).alias(c)
            if c == "superseded_by_id"
            else F.coalesce(F.col("c.system_invalidation_instant"), F.col(c)).alias(c)
            if c == "expired_at"
            else F.col(c)
            for c in columns
        ]
    )
    return updated, refused
