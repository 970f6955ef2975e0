"""Chat conversations as budgeted training windows.

Prefix sums of the turns' tokens place every turn on a line, which is cut into cells of a fixed length.
The turns that lie within a cell are the targets of one window, and a turn that crosses a border is
the target of its own; so a window's targets never exceed a cell, but for a single longer turn. A window
is the system turn, the last turns before its targets as far as the history budget goes, and its
targets. Loss lies on assistant targets alone: repeated turns are masked, so each assistant text counts once.

Prefix sums are taken in ranges over all tasks and carried across their borders by small sums, and a
window's turns meet by (conversation, cell), so a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm import tokens as K
from spanledger.llm import words as W
from spanledger.session import cut_lineage

BUDGET, HISTORY = 1024, 128  # tokens of a window, and of the turns it repeats

OPEN, CLOSE = "### ", "</turn>\n"
_control = re.compile(r"\\|###|</turn>")
_in_role = re.compile(r"\\|###|</turn>|:")
_escaped = re.compile(r"\\(\\|###|</turn>|:)")
_turn = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """The text with control strings behind a backslash."""
    return _control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def head(role: str) -> str:
    return OPEN + _in_role.sub(lambda m: "\\" + m.group(), role) + ": "


def written(role: str, text: str) -> str:
    return head(role) + escape(text) + CLOSE


def parse(window: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a written window; anything else in it is an error."""
    out, at = [], 0
    while at < len(window):
        m = _turn.match(window, at)
        if not m:
            raise ValueError("not a written window")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


def _counted(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running sums of rows and tokens within this partition, by conversation."""
        encoder = K.encoder(tokenizer)
        conv, n, total = object(), 0, 0
        for batch in batches:
            written_ = [written(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            sizes: list[int] = []
            for _, buf, offs in W.pieces(pa.RecordBatch.from_arrays([pa.array(written_, pa.string())], ["text"])):
                sizes += np.diff(encoder.encode(buf, offs)[1]).tolist()
            rank, before = [], []
            for c, size in zip(batch.column(0).to_pylist(), sizes, strict=True):
                if c != conv:
                    conv, n, total = c, 0, 0
                rank.append(n)
                before.append(total)
                n, total = n + 1, total + size
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 2, 3, 4)), pa.array(sizes, pa.int64()), pa.array(rank, pa.int64()), pa.array(before, pa.int64())],
                ["conv_id", "role", "text", "range", "tokens", "rank", "before"],
            )

    return run


def _placed(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, role, text, tokens, rank, before): every turn's place and the tokens before it."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id().cast("long"))
    local = cut_lineage(ordered.mapInArrow(_counted(tokenizer), "conv_id long, role string, text string, range long, tokens long, rank long, before long"))
    sums = local.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("size"))
    # one row for each range that a conversation reaches into
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.sum("n").over(earlier).alias("rows"), F.sum("size").over(earlier).alias("size"))
    carry = carry.where("rows is not null")
    met = local.join(carry, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")), "left")
    return met.select(
        "conv_id", "role", "text", "tokens", (F.col("rank") + F.coalesce("rows", F.lit(0))).alias("rank"),
        (F.col("before") + F.coalesce("size", F.lit(0))).alias("before"),
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows from turns that are sorted by conversation, cell and rank."""
    key, group = None, []
    for batch in batches:
        made = []
        for r in batch.to_pylist():
            if (r["conv_id"], r["cell"]) != key and group:
                made += _cell(group)
                group = []
            key = (r["conv_id"], r["cell"])
            group.append(r)
        yield _as_batch(made)
    if group:
        yield _as_batch(_cell(group))


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "window", "repeated", "tokens", "text", "loss"])


def _cell(rows: list[dict]) -> list[tuple]:
    """The windows of one cell: that of the turns within it and that of the turn that leaves it."""
    system = [r for r in rows if r["kind"] == "system"]
    turns = [r for r in rows if r["kind"] != "system"]
    out = []
    for number, kind in enumerate(("inner", "crossing")):
        own = [r for r in turns if r["kind"] == kind]
        first_of_all = not out and rows[0]["cell"] == 0
        if not own and not (first_of_all and system and not turns):
            continue
        past = [r for r in turns if own and r["rank"] < own[0]["rank"] and r["before"] >= own[0]["before"] - r["history"]]
        text, loss, at = [], [], 0
        for r in [*system, *past, *own]:
            form = written(r["role"], r["text"])
            if r["kind"] == kind and r["role"] == "assistant" and r["rank"] >= own[0]["rank"]:
                begin = at + len(head(r["role"]))
                loss.append({"start": begin, "end": at + len(form) - len(CLOSE)})
            text.append(form)
            at += len(form)
        repeated = len(past) + (0 if first_of_all else len(system))
        tokens = sum(r["tokens"] for r in (*system, *past, *own))
        out.append((rows[0]["conv_id"], rows[0]["cell"] * 2 + number, repeated, tokens, "".join(text), loss))
    return out


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, window, repeated, tokens, text, loss): training windows of all conversations.

    ``turns`` has conv_id, turn, role and text; turns are ordered by turn, null first, then role, then the text's
    hash, and equal rows are turns of their own. Null roles and texts are empty; turns without a conv_id are
    one conversation. A leading turn of role "system" is the system turn. ``repeated`` counts a window's leading
    turns that an earlier window has already; ``loss`` gives the spans of ``text``, in code points, that count. A window
    exceeds ``budget`` only where a single turn, or the system turn, does. Further columns are not read.
    """
    placed = _placed(turns, tokenizer or K.vocabulary("byte_bpe_50k.json"))
    lead = (F.col("rank") == 0) & (F.col("role") == "system")
    system = placed.where(lead).select(F.col("conv_id").alias("c"), F.col("text").alias("s_text"), F.col("tokens").alias("s_tokens"))
    rest = placed.where(~lead)
    met = rest.join(system.select("c", "s_tokens"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    given = F.coalesce("s_tokens", F.lit(0))
    room = F.greatest(F.lit(budget) - given, F.lit(4))
    kept = F.least(F.lit(history), F.floor(room / 4)).cast("long")
    stride = room - kept
    begin = F.col("before") - given

    def cell(place: Column) -> Column:
        return F.floor(place / stride).cast("long")

    met = met.select(
        "conv_id", "role", "text", "tokens", "rank", begin.alias("before"), kept.alias("history"), cell(begin).alias("cell"),
        cell(begin + kept).alias("shown"), F.when(cell(begin) == cell(begin + F.col("tokens") - 1), "inner").otherwise("crossing").alias("kind"),
    )
    shape = ["conv_id", "cell", "rank", "kind", "role", "text", "tokens", "before", "history"]
    later = met.where("shown > cell").withColumns({"cell": F.col("shown"), "kind": F.lit("past")})
    cells = met.select("conv_id", "cell").distinct().union(placed.where(lead).select("conv_id", F.lit(0).cast("long").alias("cell"))).distinct()
    heads = cells.join(system, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "cell", F.lit(-1).cast("long").alias("rank"), F.lit("system").alias("kind"), F.lit("system").alias("role"), F.col("s_text").alias("text"),
        F.col("s_tokens").alias("tokens"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("history"),
    )
    dealt = met.select(*shape).union(later.select(*shape)).union(heads.select(*shape))
    dealt = dealt.repartition("conv_id", "cell").sortWithinPartitions("conv_id", "cell", "rank")
    return dealt.mapInArrow(_windows, "conv_id long, window long, repeated long, tokens long, text string, loss array<struct<start:long,end:long>>")


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) of written windows.

    A conversation's windows pass one task in order, one at a time: a digest of a whole can't be
    split, but it holds no more than a window.
    """
    ordered = windows.select("conv_id", "window", "repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def close() -> tuple:
            return (state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"], state["windows"])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if state is None or state["conv"] != r["conv_id"]:
                    if state is not None:
                        done.append(close())
                    state = {"conv": r["conv_id"], "turns": 0, "chars": 0, "length": 0, "windows": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, text in parse(r["text"])[r["repeated"] :]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                for span in r["loss"]:
                    text = unescape(r["text"][span["start"] : span["end"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["length"] += len(r["text"])
                state["windows"] += 1
            yield table(done)
        if state is not None:
            yield table([close()])

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
