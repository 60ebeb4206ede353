"""Algebra on sets of closed integer intervals (start, end).

All of it is one sweep: intervals become steps up and down at their ends, running totals of the steps
say what covers a point, and where that begins and stops to fulfil a condition, intervals begin and
end. Totals run in cells of the number line (``prefix``), so no task sees all points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import BITS, running


def _steps(intervals: DataFrame, by: Sequence[str], **signs: int) -> DataFrame:
    """by, at and the named steps: +sign where an interval starts, -sign after its end. Intervals with start > end are dropped."""
    rows = intervals.where(F.col("start") <= F.col("end"))
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d")))).alias("s")
    return rows.select(*by, ends).select(*by, F.col("s.at").cast("bigint").alias("at"), *[(F.col("s.d") * k).cast("bigint").alias(n) for n, k in signs.items()])


def _sweep(steps: DataFrame, by: Sequence[str], holds: Column) -> DataFrame:
    """by, start, end of the maximal stretches in which ``holds`` (of running totals a and b) is true."""
    points = steps.groupBy(*by, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    points = points.where("a <> 0 OR b <> 0").withColumns({"da": F.col("a"), "db": F.col("b")})
    now = running(points, by, "at", {"a": "sum", "b": "sum"})
    was = now.withColumns({"after": holds, "a": F.col("a") - F.col("da"), "b": F.col("b") - F.col("db")}).withColumn("was", holds)
    turns = was.where("after <> was").select(*by, "at", F.col("after").cast("bigint").alias("n"), "after")
    paired = running(turns, by, "at", {"n": "sum"})
    return paired.groupBy(*by, "n").agg(F.max(F.when(F.col("after"), F.col("at"))).alias("start"), F.max(F.when(~F.col("after"), F.col("at") - 1)).alias("end")).drop("n")


def merge(intervals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Overlapping and adjacent intervals as one, for each ``by``; those with start > end are dropped."""
    return _sweep(_steps(intervals, by, a=1, b=0), by, F.col("a") > 0)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What a covers and b doesn't, merged."""
    return _sweep(_steps(a, (), a=1, b=0).unionByName(_steps(b, (), a=0, b=1)), (), (F.col("a") > 0) & (F.col("b") == 0))


def length(merged: DataFrame) -> DataFrame:
    """How many integers disjoint intervals hold (total)."""
    return merged.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("total"))


def total(intervals: DataFrame) -> DataFrame:
    """How many integers intervals cover."""
    return length(merge(intervals))


def covered(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """The distinct values v of points that lie in an interval."""
    there = points.select(F.col("v").cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("a"), F.lit(True).alias("point"))
    rows = _steps(intervals, (), a=1).withColumn("point", F.lit(False)).unionByName(there)
    rows = rows.groupBy("at").agg(F.sum("a").alias("a"), F.bool_or("point").alias("point"))
    return running(rows, (), "at", {"a": "sum"}).where("point AND a > 0").select(F.col("at").alias("v"))


def contains(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows of points (column v) that lie in an interval, each once."""
    return points.join(covered(points, intervals), "v", "left_semi")


def values(merged: DataFrame) -> DataFrame:
    """The integers v of disjoint intervals. A long one is cut into pieces that are dealt out first."""
    piece = 1 << BITS
    cuts = F.explode(F.sequence(F.col("start"), F.col("end"), F.lit(piece).cast("bigint"))).alias("lo")
    pieces = merged.select("end", cuts).select("lo", F.least(F.col("end"), F.col("lo") + piece - 1).alias("hi")).repartition("lo")
    return pieces.select(F.explode(F.sequence("lo", "hi")).alias("v"))


def gaps(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Intervals of the expected values that aren't among found (column v)."""
    return subtract(expected, found.select(F.col("v").alias("start"), F.col("v").alias("end")))


def missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Values v of the expected intervals that aren't among found (column v)."""
    return values(gaps(expected, found))
