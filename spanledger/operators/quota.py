"""Spend caps, request rates and concurrent ingestions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.operators.ordered import count_within, running_sum, sum_before
from spanledger.session import cut_lineage

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
# The window of the request rate in microseconds.
RATE_WINDOW = MINUTE


def trailing_spend(events: DataFrame, tiers: DataFrame, period_days: int = 30) -> DataFrame:
    """Per event: what its tenant spent in the period before it, and whether
    the event's own cost reaches the cap (a reached cap already refuses)."""
    spent = sum_before(
        events, ["tenant_id"], ["event_id"], "at_micros", "cost_millicents",
        period_days * DAY, DAY, "spent_millicents",
    )
    return (
        events.join(spent, ["tenant_id", "event_id"])
        .join(tiers.select("tenant_id", "spend_cap_millicents"), "tenant_id")
        .withColumn(
            "breach",
            F.col("spent_millicents") + F.col("cost_millicents") >= F.col("spend_cap_millicents"),
        )
    )


def observed_rate(requests: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per request: requests of its tenant in the 60 seconds before it, against the limit."""
    counted = count_within(
        requests, ["tenant_id"], ["event_id"], "at_micros", RATE_WINDOW, "in_window"
    )
    return counted.join(tiers.select("tenant_id", "rate_limit_rpm"), "tenant_id").withColumn(
        "over_limit", F.col("in_window") >= F.col("rate_limit_rpm")
    )


def concurrency(slots: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per slot start: slots of the tenant active right after it, against the limit.

    An end at the same instant frees its slot first.
    """
    moves = slots.select(
        "tenant_id",
        "event_id",
        F.explode(
            F.array(
                F.struct(F.col("at_micros").alias("at"), F.lit(1).alias("delta")),
                F.struct(F.col("until_micros").alias("at"), F.lit(-1).alias("delta")),
            )
        ).alias("m"),
    ).select("tenant_id", "event_id", "m.*")
    active = running_sum(
        moves, ["tenant_id"], F.floor(F.col("at") / DAY), ["at", "delta", "event_id"],
        F.col("delta").cast("bigint"), "active",
    )
    return (
        active.where(F.col("delta") > 0)
        .join(tiers.select("tenant_id", "max_concurrent"), "tenant_id")
        .select(
            "tenant_id", "event_id", F.col("at").alias("at_micros"), "active", "max_concurrent",
            (F.col("active") > F.col("max_concurrent")).alias("over_limit"),
        )
    )


def admit_rows(
    expiries: list[int], at: list[int], until: list[int], limit: list[int]
) -> tuple[list[bool], list[int]]:
    """Admission of one ordered run of rows: a row is taken when fewer than its limit
    of the taken rows still hold at that instant. ``expiries`` is a heap."""
    taken = []
    for now, end, cap in zip(at, until, limit):
        while expiries and expiries[0] <= now:
            heapq.heappop(expiries)
        ok = len(expiries) < cap
        if ok:
            heapq.heappush(expiries, end)
        taken.append(ok)
    return taken, expiries


BLOCK = ["tenant_id", "block"]
STATES = "tenant_id string, block bigint, came array<bigint>, held array<bigint>"
TAKEN = "tenant_id string, event_id string, accepted boolean"


def _fold(emit_rows: bool):
    """Streams the sorted rows of a partition, block after block, with a bounded state.

    A header row, which has no instant, hands in a state; a block without one goes on from the
    block before it. Gives each row's admission, or what each block began and ended with.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, came, held = None, None, []
        for batch in batches:
            rows, states = [], []
            for block_key, part in batch.groupby(BLOCK, sort=False):
                if block_key != key:
                    if came is not None:
                        states.append((*key, came, sorted(held)))
                    key, came = block_key, None
                heads = part["at_micros"].isna()
                if heads.any():
                    held = sorted(int(x) for x in part.loc[heads, "carry"].iloc[0])
                    part = part[~heads]
                if part.empty:
                    continue
                at = part["at_micros"].astype("int64").tolist()
                if came is None:
                    held = sorted(e for e in held if e > at[0])
                    came = list(held)
                taken, held = admit_rows(
                    held, at, part["until_micros"].astype("int64").tolist(),
                    part["cap"].astype("int64").tolist(),
                )
                rows.append(part[["tenant_id", "event_id"]].assign(accepted=taken))
            if emit_rows and rows:
                yield pd.concat(rows)
            elif states and not emit_rows:
                yield pd.DataFrame(states, columns=[*BLOCK, "came", "held"])
        if came is not None and not emit_rows:
            yield pd.DataFrame([(*key, came, sorted(held))], columns=[*BLOCK, "came", "held"])

    return run


def admissions(requests: DataFrame, block_micros: int | None = None) -> DataFrame:
    """accepted per request, in the order (at_micros, event_id) of its tenant.

    ``requests``: tenant_id, event_id, at_micros, until_micros, cap. A request is
    accepted when fewer than ``cap`` accepted requests have until > at.

    Admission is sequential per tenant, so a tenant's requests are cut into blocks that run in
    parallel: ranges of about equal numbers of rows, whatever time they span, or of
    ``block_micros``. Each block first starts from nothing. Blocks whose predecessor hands over
    something else than they began with run again in chains, and a chain may be twice as long in
    each round. After round k the first 2^k blocks of a tenant are right for certain, so the
    rounds grow with the logarithm of its blocks even if no block ever runs empty. Handed over are
    at most ``cap`` instants per block, in one row.
    """
    rows = requests.select("tenant_id", "event_id", "at_micros", "until_micros", "cap")
    if block_micros:
        rows = rows.withColumn("block", F.floor(F.col("at_micros") / block_micros))
    else:
        ranges = rows.repartitionByRange("tenant_id", "at_micros", "event_id")
        rows = ranges.withColumn("block", F.spark_partition_id().cast("bigint"))
    rows = cut_lineage(rows)
    nothing = F.array().cast("array<bigint>")
    in_order = Window.partitionBy("tenant_id").orderBy("block")
    # one row for each block
    blocks = rows.groupBy(*BLOCK).agg(F.min("at_micros").alias("first_at"))
    blocks = cut_lineage(blocks.withColumn("place", F.row_number().over(in_order).cast("bigint") - 1))

    def folded(part: DataFrame, heads: DataFrame, chain: list[str], schema: str) -> DataFrame:
        fed = part.withColumn("carry", F.lit(None).cast("array<bigint>")).unionByName(
            heads.select(*dict.fromkeys([*chain, "block", "carry"])),
            allowMissingColumns=True,
        )
        order = [*chain, "block", F.col("at_micros").asc_nulls_first(), "event_id"]
        fed = fed.repartition(*chain).sortWithinPartitions(*order)
        return fed.mapInPandas(_fold(schema == TAKEN), schema)

    states = cut_lineage(folded(rows, blocks.withColumn("carry", nothing), BLOCK, STATES))
    width = 1
    while True:
        handed = blocks.join(states, BLOCK).withColumn(
            "carry", F.filter(F.coalesce(F.lag("held").over(in_order), nothing), lambda e: e > F.col("first_at"))
        )
        width *= 2
        chain = F.floor(F.col("place") / width).alias("chain")
        wrong = cut_lineage(
            handed.where(F.col("carry") != F.col("came")).groupBy("tenant_id", chain)
            .agg(F.min(F.struct("place", "block", "carry")).alias("first")).select("tenant_id", "chain", "first.*")
        )
        if wrong.isEmpty():
            break
        again = blocks.select(*BLOCK, "place", chain).join(
            wrong.select("tenant_id", "chain", F.col("place").alias("since")), ["tenant_id", "chain"]
        ).where(F.col("place") >= F.col("since")).select(*BLOCK, "chain")
        redone = folded(rows.join(again, BLOCK), wrong, ["tenant_id", "chain"], STATES)
        states = cut_lineage(states.join(again, BLOCK, "left_anti").unionByName(redone))
    return folded(rows, handed, BLOCK, TAKEN)
