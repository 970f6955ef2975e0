"""Token counts and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost_millicents(
    input_tokens: Column,
    output_tokens: Column,
    cache_read: Column,
    cache_write: Column,
    rates: tuple[Column, Column, Column, Column],
) -> Column:
    """Tokens times rates, NULL counts as zero, rounded half to even."""
    total = None
    for count, rate in zip((input_tokens, output_tokens, cache_read, cache_write), rates):
        part = F.coalesce(count, F.lit(0)).cast("double") * rate
        total = part if total is None else total + part
    return F.rint(total).cast("bigint")


USAGE_PAYLOAD = (
    "input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, "
    "cache_creation_input_tokens bigint, prompt_tokens bigint, completion_tokens bigint, "
    "prompt_tokens_details struct<cached_tokens:bigint>, promptTokenCount bigint, "
    "cachedContentTokenCount bigint, candidatesTokenCount bigint, thoughtsTokenCount bigint"
)


def usage_from_json(payload: Column) -> Column:
    """Struct of the four token counts read from a provider's JSON payload.

    Known shapes: plain counts; prompt/completion counts whose prompt includes the
    cached part; prompt/candidates counts whose thinking tokens bill as output.
    A ``usage`` wrapper is looked through.
    """
    body = F.coalesce(F.get_json_object(payload, "$.usage"), payload)
    u = F.from_json(body, USAGE_PAYLOAD)

    def zero(col: Column) -> Column:
        return F.coalesce(col, F.lit(0).cast("bigint"))

    def counts(inp: Column, out: Column, read: Column, write: Column) -> Column:
        return F.struct(
            inp.alias("input_tokens"),
            out.alias("output_tokens"),
            read.alias("cache_read_input_tokens"),
            write.alias("cache_write_input_tokens"),
        )

    none = F.lit(0).cast("bigint")
    prompt_cached = zero(u["prompt_tokens_details"]["cached_tokens"])
    content_cached = zero(u["cachedContentTokenCount"])
    return (
        F.when(
            u["prompt_tokens"].isNotNull() & u["input_tokens"].isNull(),
            counts(
                F.greatest(none, u["prompt_tokens"] - prompt_cached),
                zero(u["completion_tokens"]),
                prompt_cached,
                none,
            ),
        )
        .when(
            u["promptTokenCount"].isNotNull() | u["candidatesTokenCount"].isNotNull(),
            counts(
                F.greatest(none, zero(u["promptTokenCount"]) - content_cached),
                zero(u["candidatesTokenCount"]) + zero(u["thoughtsTokenCount"]),
                content_cached,
                none,
            ),
        )
        .otherwise(
            counts(
                zero(u["input_tokens"]),
                zero(u["output_tokens"]),
                zero(u["cache_read_input_tokens"]),
                zero(u["cache_creation_input_tokens"]),
            )
        )
    )
