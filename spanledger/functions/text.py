"""Text functions: decoding, provenance normalisation, chunking, quote location."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space when a string is stripped.
STRIP_CLASS = r"[\s\x1c-\x1f]"
# the same characters one by one
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Characters that end a line.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"

SPAN = T.StructType(
    [
        T.StructField("start_offset", T.IntegerType()),
        T.StructField("end_offset", T.IntegerType()),
        T.StructField("quote", T.StringType()),
    ]
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` worked out once, however often the body names it.

    Inside lambdas Spark shares no common part, and a long expression that repeats
    its input grows past what can be compiled.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_utf8(content: Column) -> Column:
    """Bytes to text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def not_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, rf"(?U){STRIP_CLASS}+"), lambda w: w != "")


def normalize_ws(text: Column) -> Column:
    """Lower case, runs of white space to one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(text), rf"(?U){STRIP_CLASS}+", " "))


# what NFKC may change: other than ASCII, with the letter before it that a mark may join; nothing joins a following ASCII letter
FOREIGN = r"[\x00-\x7f]?[^\x00-\x7f]+"




def _settled() -> str:
    """Latin, Greek, Cyrillic and punctuation that NFKC keeps, whatever stands beside them, as ranges of a pattern."""
    ranges: list[list[int]] = []
    for low, high in ((0x80, 0x24F), (0x386, 0x3CE), (0x400, 0x4FF), (0x2010, 0x2022)):
        for code in range(low, high + 1):
            if unicodedata.combining(chr(code)) or unicodedata.normalize("NFKC", chr(code)) != chr(code):
                continue
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in ranges)


# a text without any of these is in NFKC already
UNSETTLED = rf"[[^\x00-\x7f]&&[^{_settled()}]]"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda told: None if told is None else [unicodedata.normalize("NFKC", t) for t in told])


def normalize_for_provenance(text: Column) -> Column:
    """NFKC, line ends to LF, no-break space to space.

    Spark has no NFKC. Texts of settled characters alone pass as they are. Of others only the parts
    that are not ASCII travel to the Arrow function, never whole texts; what is ASCII keeps its place between them.
    """
    unsettled = (F.octet_length(text) != F.length(text)) & text.rlike(UNSETTLED)
    made = _nfkc(F.when(unsettled, F.regexp_extract_all(text, F.lit(FOREIGN), F.lit(0))))
    whole = F.zip_with(F.split(text, FOREIGN, -1), made, lambda kept, piece: F.concat(kept, F.coalesce(piece, F.lit(""))))
    composed = F.when(made.isNotNull(), F.array_join(whole, "")).otherwise(text)
    lines = F.replace(F.replace(composed, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(lines, F.lit("\u00a0"), F.lit(" "))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Stripped, non-empty parts in order; use with posexplode."""
    parts = F.split(text, "\\Q" + separator + "\\E", -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def line_lengths(text: Column) -> Column:
    """Length of every line with its line end; the costly pattern runs only on texts
    with line ends other than LF."""
    pattern = rf"[^{LINE_ENDS}]*(?:\r\n|[{LINE_ENDS}])|[^{LINE_ENDS}]+"
    parts = F.split(text, "\n", -1)
    # every part but the last had a line end; the last may be empty
    plain = bound(
        parts,
        lambda p: F.filter(
            F.transform(p, lambda line, i: F.length(line) + (i < F.size(p) - 1).cast("int")),
            lambda n: n > 0,
        ),
    )
    mixed = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    return F.when(text.rlike(f"[{LINE_ENDS[2:]}]"), mixed).otherwise(plain)


def line_chunk_bounds(text: Column, max_chars: int = 4000) -> Column:
    """Array of (start, end) offsets of greedily packed lines.

    The fold carries offsets only, never text. A line longer than the limit is
    cut into pieces that take no further line.
    """
    lengths = line_lengths(text)
    empty = F.struct(
        F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(0).alias("start"), F.lit(0).alias("end")
    )

    def closed(acc: Column) -> Column:
        tail = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["end"] > acc["start"], F.concat(acc["done"], tail)).otherwise(acc["done"])

    def pieces(begin: Column, size: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), size - 1, F.lit(max_chars)),
            lambda off: F.struct(
                (begin + off).alias("start"),
                (begin + F.least(off + max_chars, size)).alias("end"),
            ),
        )

    def step(acc: Column, size: Column) -> Column:
        after = acc["end"] + size
        fits = after - acc["start"] <= max_chars
        return F.when(
            fits, F.struct(acc["done"].alias("done"), acc["start"].alias("start"), after.alias("end"))
        ).when(
            size > max_chars,
            F.struct(
                F.concat(closed(acc), pieces(acc["end"], size)).alias("done"),
                after.alias("start"),
                after.alias("end"),
            ),
        ).otherwise(
            F.struct(closed(acc).alias("done"), acc["end"].alias("start"), after.alias("end"))
        )

    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    packed = F.aggregate(lengths, empty, step, closed)
    return F.when(text == "", whole).otherwise(packed)


# a sentence with its closing marks; the matches cover a text from end to end
SENTENCE = "[^.!?]+[.!?]*|[.!?]+"


BLOCK = 32  # sentences of a short text's only block


def sentence_spans(text: Column) -> Column:
    """start_offset, end_offset and quote of each sentence, without the blanks around it.

    Lengths are added up within blocks of about the root of the number of sentences, and over the blocks: an array grows by
    one element at a time in either, so a text of n sentences costs n * sqrt(n) and not their square.
    """
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    spans = "array<struct<start_offset:int,end_offset:int,quote:string>>"

    def blocks(held: Column) -> Column:
        size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(held))).cast("int"))
        firsts = F.sequence(F.lit(0), F.greatest(F.size(held) - 1, F.lit(0)), size)
        return F.transform(firsts, lambda first: F.slice(held, first + 1, size))

    def lengths(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, piece: n + F.length(piece))

    def starts(cut: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(cut, zero, lambda acc, block: F.struct((acc["at"] + lengths(block)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece) - F.length(F.ltrim(piece))
        quote = F.trim(piece)
        span = F.struct(start.alias("start_offset"), (start + F.length(quote)).alias("end_offset"), quote.alias("quote"))
        found = F.when(quote == "", acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span)))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), found.alias("spans"))

    def inside(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(spans).alias("spans")), step, lambda acc: acc["spans"])

    return bound(pieces, lambda held: bound(blocks(held), lambda cut: F.flatten(F.zip_with(cut, starts(cut), inside))))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _sums_before(lengths: pa.Array) -> pa.Array:
    """In each list the sum of what stands before."""
    ends = lengths.offsets.to_numpy() - lengths.offsets[0].as_py()
    sums = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    inside = sums[:-1] - np.repeat(sums[ends[:-1]], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inside, pa.int32()))


def sentence_rows(texts: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of each row of ``texts`` with the spans of its ``text`` that ``sentence_spans`` tells, one a row.

    Only lengths of sentences go to Python, which adds them up, so a text of n sentences costs n.
    """
    cut = texts.select(*columns, F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)).alias("__pieces"))
    kept = cut.columns[:-1]
    at = cut.withColumn("__at", _sums_before(F.transform("__pieces", F.length)))
    rows = at.select(*kept, F.inline(F.arrays_zip("__at", "__pieces")).alias("__at", "__piece"))
    piece = F.col("__piece")
    start = F.col("__at") + F.length(piece) - F.length(F.ltrim(piece))
    end = F.col("__at") + F.length(F.rtrim(piece))
    return rows.select(*kept, start.alias("start_offset"), end.alias("end_offset"), F.trim(piece).alias("quote")).where(F.col("quote") != "")


def slice_text(text: Column, bound: Column) -> Column:
    return F.substring(text, bound["start"] + 1, bound["end"] - bound["start"])


def locate_span(text: Column, quote: Column, start: Column | None = None) -> Column:
    """Span of the first occurrence at or after ``start``; NULL when absent.

    Both sides must already be normalised; offsets count code points.
    """
    begin = F.lit(0) if start is None else start
    at = F.position(quote, text, begin + 1)
    return F.when(
        (F.length(quote) > 0) & (at > 0),
        F.struct(
            (at - 1).alias("start_offset"),
            (at - 1 + F.length(quote)).alias("end_offset"),
            quote.alias("quote"),
        ),
    )


def locate_spans(text: Column, quotes: Column) -> Column:
    """Spans of several quotes in order, each after the end of the one before.

    NULL as soon as one quote is missing.
    """
    found = "array<struct<start_offset:int,end_offset:int,quote:string>>"
    start = F.struct(
        F.array().cast(found).alias("spans"), F.lit(0).alias("pos"), F.lit(True).alias("ok")
    )

    def step(acc: Column, quote: Column) -> Column:
        span = locate_span(text, quote, acc["pos"])
        hit = acc["ok"] & span.isNotNull()
        return F.when(
            hit,
            F.struct(
                F.concat(acc["spans"], F.array(span)).alias("spans"),
                span["end_offset"].alias("pos"),
                F.lit(True).alias("ok"),
            ),
        ).otherwise(
            F.struct(acc["spans"].alias("spans"), acc["pos"].alias("pos"), F.lit(False).alias("ok"))
        )

    return F.aggregate(quotes, start, step, lambda acc: F.when(acc["ok"], acc["spans"]))


def locate_each(text: Column, quotes: Column) -> Column:
    """Spans of quotes searched independently; NULL when one is missing."""
    spans = F.transform(quotes, lambda q: locate_span(text, q))
    return F.when(~F.exists(spans, lambda s: s.isNull()), spans)


def quote_in_text(quote: Column, text: Column) -> Column:
    """Containment after normalize_ws; blank sides are never contained."""
    return F.coalesce(
        not_blank(quote) & (F.length(text) > 0) & F.contains(normalize_ws(text), normalize_ws(quote)),
        F.lit(False),
    )


def valid_span(start: Column, end: Column, quote: Column) -> Column:
    """Span rule for facts: a non-empty range whose quote has exactly its length."""
    return F.coalesce(
        (start >= 0) & (end > start) & (F.length(quote) > 0) & (F.length(quote) == end - start),
        F.lit(False),
    )


def valid_provenance(chunk_id: Column, start: Column, end: Column, quote: Column) -> Column:
    """Span rule for graph rows: a chunk, an ordered range and a quote that is not blank."""
    return F.coalesce(
        chunk_id.isNotNull() & (start >= 0) & (end >= start) & not_blank(quote), F.lit(False)
    )
