"""The resource dimension: deduplication, first-writer-wins upsert, orphans and foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resource_rows(records: DataFrame) -> DataFrame:
    """One row per resource_id: that of the earliest record that names it.

    Ids alone are reduced first (their aggregation needs no sort); only the rows found so are fetched.
    """
    first = records.groupBy("resource_id").agg(F.min("id").alias("first_seen"))
    own = records.select("resource_id", F.col("id").alias("first_seen"), "service_name", "host_name", "schema_url", F.col("resource_json").alias("attributes_json"))
    rows = own.join(first, ["resource_id", "first_seen"], "left_semi").dropDuplicates(["resource_id"])
    return rows.select(F.col("resource_id").alias("id"), "service_name", "host_name", "schema_url", "attributes_json", "first_seen")


def upsert_resources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing plus the incoming ids that it lacks; an id that is there is left as it is."""
    return existing.unionByName(incoming.join(existing, "id", "left_anti"), allowMissingColumns=True)


def orphan_resources(resources: DataFrame, events: DataFrame) -> DataFrame:
    """Resources that no event refers to."""
    return resources.join(events.select(F.col("resource_id").alias("id")).distinct(), "id", "left_anti")


def cascade_delete(events: DataFrame, deleted_resources: DataFrame) -> DataFrame:
    """Events without those of deleted resources."""
    return events.join(deleted_resources.select(F.col("id").alias("resource_id")), "resource_id", "left_anti")


def foreign_key_violations(events: DataFrame, resources: DataFrame) -> DataFrame:
    """Events whose resource is missing."""
    return events.join(resources.select(F.col("id").alias("resource_id")), "resource_id", "left_anti")


def trace_lookup(events: DataFrame, trace_id: bytes) -> DataFrame:
    """The events of one trace. The id reaches the scan as a literal, so row groups whose bloom filter lacks it aren't read."""
    return events.where(F.col("trace_id") == F.lit(trace_id))


def read_view(events: DataFrame, resources: DataFrame) -> DataFrame:
    """The 20 columns of the logs view. The optimiser sees the small side's size and picks the join."""
    r = resources.select(F.col("id").alias("resource_id"), "service_name", "host_name", F.col("schema_url").alias("resource_schema_url"))
    names = ["id", "resource_id", "timestamp_ns", "observed_timestamp_ns", "severity_number", "severity_text", "trace_id", "span_id", "body", "event_name", "flags", "dropped_attributes_count", "scope_name", "scope_version", "scope_attributes_json", "scope_schema_url", "attributes_json", "service_name", "host_name", "resource_schema_url"]
    return events.join(r, "resource_id").select(*names)
