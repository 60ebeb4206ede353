"""Running totals over a long number line, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers are dealt to cells of 2**BITS; cells to cells of cells, and so on.
BITS = 16
_TOTAL = {"sum": F.sum, "max": F.max}


def _joined(kind: str, a: Column, b: Column) -> Column:
    """A total of two values that may be null."""
    both = a + b if kind == "sum" else F.when(b > a, b).otherwise(a)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def before(rows: DataFrame, by: Sequence[str], key: str, totals: dict[str, str], levels: int = 1) -> DataFrame:
    """by, key and, for each column of ``totals`` ("sum" or "max"), its total over all smaller keys (null if there are none).

    ``rows`` has one row per by and key, a whole number. Keys are totalled in groups of 2**BITS, as
    often as ``levels`` says, and only the groups of the last time meet in one window for each ``by``:
    with one level and cells of points as keys, a range of 2**48 gives 2**BITS rows. Columns of ``by``
    mustn't be null.
    """
    over = lambda w: [_TOTAL[kind](n).over(w.rowsBetween(W.unboundedPreceding, -1)).alias(n) for n, kind in totals.items()]
    if not levels:
        return rows.select(*by, key, *over(W.partitionBy(*by).orderBy(key)))
    up = f"__up{levels}"
    grouped = rows.withColumn(up, F.shiftright(key, BITS))
    sums = grouped.groupBy(*by, up).agg(*[_TOTAL[kind](n).alias(n) for n, kind in totals.items()])
    carried = before(sums, by, up, totals, levels - 1).withColumnsRenamed({n: f"__c_{n}" for n in totals})
    own = grouped.select(*by, up, key, *over(W.partitionBy(*by, up).orderBy(key)))
    return own.join(carried, [*by, up]).select(*by, key, *[_joined(kind, F.col(n), F.col(f"__c_{n}")).alias(n) for n, kind in totals.items()])


def running(rows: DataFrame, by: Sequence[str], at: str, totals: dict[str, str]) -> DataFrame:
    """rows, with each column of ``totals`` replaced by its total over all rows up to and including this one.

    One row per by and at. Cells of 2**BITS numbers run on their own, from what ``before`` carries in.
    """
    celled = rows.withColumn("__cell", F.shiftright(at, BITS))
    sums = celled.groupBy(*by, "__cell").agg(*[_TOTAL[kind](n).alias(n) for n, kind in totals.items()])
    carried = before(sums, by, "__cell", totals).withColumnsRenamed({n: f"__c_{n}" for n in totals})
    w = W.partitionBy(*by, "__cell").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    joined = celled.join(carried, [*by, "__cell"])
    return joined.select(*[_joined(totals[c], _TOTAL[totals[c]](c).over(w), F.col(f"__c_{c}")).alias(c) if c in totals else F.col(c) for c in rows.columns])
