"""Latency histograms that add up: log-linear buckets of a fixed relative error.

Each power of two is cut into 2**bits buckets of equal width (values below 2**(bits + 1) have one each),
so a bucket is at most 2**-bits of its values wide. A histogram is a table of counted buckets: tasks,
windows and hosts each make their own, and ``merge`` adds them. Percentiles come from sums over the few
buckets of a group; no samples are sorted. min and max are exact, and a percentile is at most 2**-bits
above the exact one (it is the greatest sample of the exact one's bucket).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reports import PERCENTILES

#: Three decimal digits, and one hour in microseconds: larger values count as that.
BITS, HIGHEST = 10, 3_600_000_000


def bucket(value: Column, bits: int = BITS) -> Column:
    """The bucket of a whole number from 0 on."""
    shift = F.greatest(F.length(F.bin(value)) - bits - 1, F.lit(0))
    return (F.lit(1 << bits) * shift + F.call_function("shiftright", value, shift)).cast("bigint")


def histogram(samples: DataFrame, by: list[str], value: str, bits: int = BITS, highest: int = HIGHEST) -> DataFrame:
    """by, bucket, n, least, most of whole numbers; negative ones count as 0, larger ones than ``highest`` as that, nulls not at all."""
    v = F.least(F.greatest(F.col(value).cast("bigint"), F.lit(0)), F.lit(highest))
    rows = samples.where(F.col(value).isNotNull()).select(*by, v.cast("bigint").alias("__v"))
    return rows.groupBy(*by, bucket(F.col("__v"), bits).alias("bucket")).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"))


def merge(histograms: list[DataFrame], by: list[str]) -> DataFrame:
    """The histogram of all samples together; ``by`` may be some of the groups' columns."""
    rows = reduce(DataFrame.unionByName, [h.select(*by, "bucket", "n", "least", "most") for h in histograms])
    return rows.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def summary(histograms: DataFrame, by: list[str], percentiles: dict[str, float] = PERCENTILES) -> DataFrame:
    """by, n, min, the percentiles and max of each group."""
    own = W.partitionBy(*by)
    upto = F.sum("n").over(own.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    placed = histograms.withColumns({"upto": upto, "total": F.sum("n").over(own)})
    cells = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * p), F.lit(1)), F.col("most"))).alias(name) for name, p in percentiles.items()]
    return placed.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("min"), *cells, F.max("most").alias("max"))
