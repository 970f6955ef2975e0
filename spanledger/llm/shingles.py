"""Word shingles as column expressions: Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text, lower-cased; none for a null or empty one."""
    plain = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANKS))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(plain), SPACE))


def shingles(column: str, size: int = 5) -> Column:
    """Hashes of all runs of ``size`` words of an array column, in order and with repeats; fewer words
    are one shingle, no words none."""
    held = F.col(column)
    many = F.transform(F.sequence(F.lit(0), F.size(held) - size), lambda i: F.xxhash64(*(F.get(held, i + k) for k in range(size))))
    return F.when(F.size(held) >= size, many).when(F.size(held) > 0, F.array(F.xxhash64(held))).otherwise(F.array().cast("array<bigint>"))
