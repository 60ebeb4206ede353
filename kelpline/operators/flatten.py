"""Nested export requests and their flat records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, mapping

SCOPE = ["scope_name", "scope_version", "scope_attributes", "scope_schema_url"]


def nest_requests(records: DataFrame) -> DataFrame:
    """Flat wire records as requests: resource groups of scope groups of records, each in order.

    Group numbers are kept as positions, so a number that no record has leaves an empty group.
    A request is one message, so its records fit into one row by nature.
    """
    fields = [c for c in records.columns if c not in ("request_id", "resource_idx", "scope_idx", "resource_attributes", "schema_url", *SCOPE)]
    scopes = records.groupBy("request_id", "resource_idx", "scope_idx").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in fields if c != "id"]))).alias("records"), *[F.first(c).alias(c) for c in SCOPE], F.first("resource_attributes").alias("resource_attributes"), F.first("schema_url").alias("schema_url"))
    groups = scopes.groupBy("request_id", "resource_idx").agg(F.array_sort(F.collect_list(F.struct("scope_idx", *SCOPE, "records"))).alias("scopes"), F.first("resource_attributes").alias("resource_attributes"), F.first("schema_url").alias("schema_url"))
    return groups.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("resource_idx", "schema_url", "resource_attributes", "scopes"))).alias("resources"))


def flatten_requests(requests: DataFrame) -> DataFrame:
    """One row per record. Groups without records vanish; order stays in the index columns.

    A scope's columns are rendered once per scope group, before its records are exploded.
    """
    groups = requests.select("request_id", F.explode("resources").alias("g")).select("request_id", "g.resource_idx", "g.schema_url", "g.resource_attributes", F.explode("g.scopes").alias("s"))
    scopes = groups.select("request_id", "resource_idx", "schema_url", "resource_attributes", "s.scope_idx", "s.scope_name", mapping.non_empty(F.col("s.scope_version")).alias("scope_version"), canonical.attributes_json(F.col("s.scope_attributes")).alias("scope_attributes_json"), mapping.non_empty(F.col("s.scope_schema_url")).alias("scope_schema_url"), "s.records")
    return scopes.select("*", F.posexplode("records").alias("record_idx", "r")).drop("records").select("*", "r.*").drop("r")


def combined_groups(requests: DataFrame) -> DataFrame:
    """One row per resource group, with the number of its records over all scopes; empty groups vanish."""
    groups = requests.select("request_id", F.explode("resources").alias("g"))
    n = F.aggregate("g.scopes", F.lit(0), lambda acc, s: acc + F.size(s["records"]))
    return groups.select("request_id", "g.resource_idx", n.cast("long").alias("records")).where("records > 0")
