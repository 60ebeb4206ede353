"""The older metrics model: joined points, and histogram buckets from arrays of bounds and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_view(points: DataFrame, series: DataFrame, metrics: DataFrame, scopes: DataFrame, resources: DataFrame) -> DataFrame:
    """Points with their series, metric, scope and resource."""
    return points.join(series, "series_id").join(metrics, "metric_id").join(scopes, "scope_id").join(resources, "resource_id")


def distinct_metrics(rows: DataFrame) -> DataFrame:
    """One row per identity; monotonicity and temporality are part of it, series tell apart by canonical attributes."""
    return rows.dropDuplicates(["resource_id", "scope_id", "name", "unit", "kind", "is_monotonic", "temporality", "attributes_json"])


def histogram_buckets(points: DataFrame, key: str = "point_id", json: str = "histogram_json") -> DataFrame:
    """key, bucket_index, bound (null if not numeric), bound_text, n: the finite buckets, then +Inf."""
    parsed = points.select(key, F.from_json(json, "bounds array<string>, counts array<bigint>").alias("h"))
    zipped = parsed.select(key, F.posexplode(F.arrays_zip("h.bounds", "h.counts")).alias("bucket_index", "z"), F.size("h.bounds").alias("n_bounds"))
    finite = zipped.where("bucket_index < n_bounds").select(key, "bucket_index", F.col("z.bounds").try_cast("double").alias("bound"), F.col("z.bounds").alias("bound_text"), F.col("z.counts").alias("n"))
    rest = parsed.select(key, F.size("h.bounds").alias("bucket_index"), F.lit(None).cast("double").alias("bound"), F.lit("+Inf").alias("bound_text"), F.try_element_at("h.counts", F.size("h.bounds") + 1).alias("n"))
    return finite.unionByName(rest)
