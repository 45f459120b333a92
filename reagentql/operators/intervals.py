"""Points in intervals of any length, by dyadic blocks.

The line is cut into cells, and cells into blocks of 1, 2, 4, ... cells at multiples of their
length.  An interval is the union of at most two blocks of each length, so one of 10^9 cells is
some sixty rows, and a point lies in one block of each length that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dyadic_blocks(first: Column, last: Column) -> Column:
    """The blocks (level, block) whose union is the cells from first to last; block b of level k holds the cells b * 2^k to (b + 1) * 2^k - 1."""

    def of_level(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -first, k), F.call_function("shiftright", last + 1, k)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        block = lambda x: F.struct(k.alias("level"), x.alias("block"))
        left, right = F.when((low < high) & odd(low), block(low)), F.when((low < high) & odd(high), block(high - 1))
        return F.array_compact(F.array(left, right))

    levels = F.ceil(F.log2((last - first + 2).cast("double"))).cast("int")
    return F.when(first <= last, F.flatten(F.transform(F.sequence(F.lit(0), levels), of_level)))


def within_intervals(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points joined with the intervals [start, end] of their group that hold them.

    ``width`` is the length of a cell; it should be small beside most intervals, and need not be
    near the long ones.  Intervals that end before they start, and null bounds, hold nothing.
    The levels in use, at most 64, are looked up first, and a point becomes a row for each.
    """
    cell = lambda x: F.floor(F.col(x) / width).cast("long")
    spread = intervals.withColumn("__b", F.explode(dyadic_blocks(cell(start), cell(end))))
    spread = spread.withColumns({"__level": F.col("__b.level"), "__block": F.col("__b.block")}).drop("__b")
    levels = [r[0] for r in spread.select("__level").distinct().collect()]
    dealt = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    dealt = dealt.withColumn("__block", F.call_function("shiftright", cell(at), F.col("__level")))
    return dealt.join(spread, [by, "__level", "__block"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__level", "__block")
