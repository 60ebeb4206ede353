"""Adapters: the driver's tables in the shape of log telemetry, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import canonical, mapping

#: Tasks for each core where given events are mapped.
TASKS_A_CORE = 3
RECORD_COLUMNS = ["id", "request_id", "resource_idx", "scope_idx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def raw_records(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """events as wire-level log records, one row each; attribute values are JSON text.

    ``even`` deals the events to all cores first: a row group of a million of them is else one task's work.
    """
    e = table(spark, sf_dir, "events")
    if even:
        e = e.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "event_id")
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    nanos = (micros * 1000).cast("decimal(20,0)")
    text = lambda c: c.cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = F.when(kind == "error", 17).when(kind == "purchase", 9).when(kind == "signup", 10).when(kind == "view", 5).otherwise(1)
    trace = F.unhex(F.md5(F.concat(text(u), F.lit("-"), text(F.to_date("ts"))).cast("binary")))
    return e.select(
        i.alias("id"), F.expr("event_id div 100").alias("request_id"), (u % 4).cast("int").alias("resource_idx"), F.when(kind == "error", 1).otherwise(0).alias("scope_idx"),
        F.when(i % 10 == 0, F.lit(0).cast("decimal(20,0)")).when(i % 997 == 1, F.lit("18446744073709551615").cast("decimal(20,0)")).otherwise(nanos).alias("time_unix_nano"),
        (nanos + (i % 1000) * 1000000).cast("decimal(20,0)").alias("observed_time_unix_nano"),
        F.when(i % 50 == 7, 99).otherwise(number).alias("severity_number"), F.when(i % 7 == 0, "").otherwise(F.upper(kind)).alias("severity_text"),
        F.when(i % 11 == 0, F.unhex(F.lit(""))).when(i % 13 == 0, F.unhex(F.lit("0102"))).when(i % 17 == 0, F.unhex(F.lit("00" * 16))).otherwise(trace).alias("trace_id"),
        F.when(i % 19 == 0, F.unhex(F.lit("00" * 8))).otherwise(F.substring(F.unhex(F.md5(text(i).cast("binary"))), 1, 8)).alias("span_id"),
        F.when(i % 23 == 0, "").otherwise(F.concat(kind, F.lit(" by user "), text(u))).alias("body"),
        F.when(kind.isin("purchase", "signup"), kind).otherwise("").alias("event_name"), (256 + i % 2).cast("bigint").alias("flags"), F.lit(0).cast("bigint").alias("dropped_attributes_count"),
        F.array(_pair("bench.run_id", quoted(F.concat(F.lit("run-"), text(u % 2)))), _pair("bench.seq", text(i)), _pair("bench.record_id", text(F.when(i % 101 == 0, i + 1).otherwise(i))), _pair("k", F.get_json_object("props", "$.k")), _pair("user", F.lit('"old"')), _pair("user", quoted(text(u)))).alias("attributes"),
        F.concat(F.lit("scope-"), F.when(kind == "error", "1").otherwise("0")).alias("scope_name"), F.when(kind == "error", "").otherwise("1.0").alias("scope_version"),
        F.array(_pair("lib", F.lit('"k"'))).alias("scope_attributes"), F.lit("").alias("scope_schema_url"),
        F.when(u % 3 != 0, F.array(_pair("service.name", quoted(F.concat(F.lit("svc-"), text(u % 4)))), _pair("host.name", quoted(F.concat(F.lit("host-"), text(u % 8)))))).otherwise(F.array(_pair("service.name", quoted(F.concat(F.lit("svc-"), text(u % 4)))))).alias("resource_attributes"),
        F.when(u % 2 == 0, "https://example.test/schemas").otherwise("").alias("schema_url"), "user_id", "event_type", "value", "ts", "props",
    ).withColumns({"body_size": F.octet_length("body"), "body_fact": F.lit(None).cast(f"struct<{canonical.WALK_DDL}>"), "wrong_scalars": F.lit(0), **{f"{n}_facts": _facts(F.col(c)) for n, c in (("attribute", "attributes"), ("resource", "resource_attributes"), ("scope", "scope_attributes"))}})


def _facts(attributes: Column) -> Column:
    """What a walk tells of plain values whose JSON text has no escapes."""
    leaf = lambda v: F.when(v.startswith('"'), F.octet_length(v) - 2).otherwise(0)
    zero = F.lit(0)
    return F.transform(attributes, lambda x: F.struct(x["value"].alias("json"), zero.alias("depth"), zero.alias("max_key_bytes"), leaf(x["value"]).alias("max_leaf_bytes"), (leaf(x["value"]) + canonical.NODE_OVERHEAD).cast("bigint").alias("size"), zero.alias("strindex_losses"), zero.alias("scalar_losses")))


#: The same records in DuckDB SQL, as a chain of CTEs: raw, rec (stored values), res (resources), logs (the read view).
CTES = """
WITH raw AS (SELECT event_id AS id, event_id // 100 AS request_id, CAST(user_id % 4 AS INTEGER) AS resource_idx, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS scope_idx,
  CASE WHEN event_id % 10 = 0 THEN 0::HUGEINT WHEN event_id % 997 = 1 THEN 18446744073709551615::HUGEINT ELSE epoch_us(ts)::HUGEINT * 1000 END AS time_unix_nano,
  epoch_us(ts) * 1000 + (event_id % 1000) * 1000000 AS obs,
  CASE WHEN event_id % 50 = 7 THEN 99 WHEN event_type = 'error' THEN 17 WHEN event_type = 'purchase' THEN 9 WHEN event_type = 'signup' THEN 10 WHEN event_type = 'view' THEN 5 ELSE 1 END AS sev,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE upper(event_type) END AS sev_text,
  CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '0102' WHEN event_id % 17 = 0 THEN repeat('0', 32) ELSE md5(CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR)) END AS trace_hex,
  CASE WHEN event_id % 19 = 0 THEN repeat('0', 16) ELSE substr(md5(CAST(event_id AS VARCHAR)), 1, 16) END AS span_hex,
  CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type || ' by user ' || CAST(user_id AS VARCHAR) END AS raw_body,
  CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE '' END AS raw_name, 256 + event_id % 2 AS flags,
  '{"bench.record_id":' || CASE WHEN event_id % 101 = 0 THEN event_id + 1 ELSE event_id END || ',"bench.run_id":"run-' || (user_id % 2) || '","bench.seq":' || event_id || ',"k":' || coalesce(json_extract_string(props, '$.k'), 'null') || ',"user":"' || user_id || '"}' AS attributes_json,
  CASE WHEN event_id % 101 = 0 THEN event_id + 1 ELSE event_id END AS record_id, 'run-' || (user_id % 2) AS run_id,
  'svc-' || (user_id % 4) AS service_name, CASE WHEN user_id % 3 <> 0 THEN 'host-' || (user_id % 8) ELSE '' END AS host,
  CASE WHEN user_id % 2 = 0 THEN 'https://example.test/schemas' ELSE '' END AS url,
  '{' || CASE WHEN user_id % 3 <> 0 THEN '"host.name":"host-' || (user_id % 8) || '",' ELSE '' END || '"service.name":"svc-' || (user_id % 4) || '"}' AS res_json,
  user_id, event_type, value, ts, props FROM events),
rec AS (SELECT *, sha256(unhex(printf('%02x', strlen(service_name)) || repeat('00', 7)) || encode(service_name) || unhex(printf('%02x', strlen(host)) || repeat('00', 7)) || encode(host) || unhex(printf('%02x', strlen(url)) || repeat('00', 7)) || encode(url) || unhex(printf('%02x', strlen(res_json)) || repeat('00', 7)) || encode(res_json)) AS resource_id,
  CASE WHEN time_unix_nano = 0 THEN obs ELSE CAST(least(time_unix_nano, 9223372036854775807::HUGEINT) AS BIGINT) END AS timestamp_ns, obs AS observed_timestamp_ns,
  CASE WHEN sev BETWEEN 0 AND 24 THEN sev ELSE 0 END AS severity_number, nullif(sev_text, '') AS severity_text,
  CASE WHEN length(trace_hex) = 32 AND trace_hex <> repeat('0', 32) THEN trace_hex END AS trace_id, CASE WHEN length(span_hex) = 16 AND span_hex <> repeat('0', 16) THEN span_hex END AS span_id,
  nullif(raw_body, '') AS body, nullif(raw_name, '') AS event_name, CAST(0 AS BIGINT) AS dropped_attributes_count,
  'scope-' || scope_idx AS scope_name, CASE WHEN scope_idx = 0 THEN '1.0' END AS scope_version, '{"lib":"k"}' AS scope_attributes_json, CAST(NULL AS VARCHAR) AS scope_schema_url FROM raw),
res AS (SELECT resource_id AS id, any_value(service_name) AS service_name, nullif(any_value(host), '') AS host_name, nullif(any_value(url), '') AS schema_url, any_value(res_json) AS attributes_json, min(id) AS first_seen FROM rec GROUP BY resource_id),
logs AS (SELECT rec.id, resource_id, timestamp_ns, observed_timestamp_ns, severity_number, severity_text, trace_id, span_id, body, event_name, flags, dropped_attributes_count, scope_name, scope_version, scope_attributes_json, scope_schema_url, rec.attributes_json, res.service_name, host_name, schema_url AS resource_schema_url FROM rec JOIN res ON res.id = rec.resource_id)
"""


def _resource_columns() -> dict[str, Column]:
    """service_name, host, canonical JSON and identity of a resource, from its attributes and schema URL."""
    attrs = F.col("resource_attributes")
    unquoted = lambda key: F.when(canonical.attribute(attrs, key)["value"].startswith('"'), F.expr(f"""from_json(concat('{{"x":', try_element_at(filter(resource_attributes, y -> y.key = '{key}'), -1).value, '}}'), 'x string').x"""))
    service, host, text = F.coalesce(unquoted("service.name"), F.lit("")), F.coalesce(unquoted("host.name"), F.lit("")), canonical.attributes_json(attrs)
    return {"service_name": service, "__host": host, "resource_json": text, "resource_id": canonical.fingerprint(service, host, F.col("schema_url"), text)}


def stored_records(raw: DataFrame) -> DataFrame:
    """Wire-level records as rows of log_event, with their resource's columns and identity beside them."""
    # a resource has many records: it is rendered once for each distinct one (a stream renders it where it stands).
    # These are stored first: the optimiser sees how small they are, and doesn't deal all records by a few resources
    if raw.isStreaming:
        rows = raw.withColumns(_resource_columns())
    else:
        key = ["resource_attributes", "schema_url"]
        path = f"{store.shared_dir(raw.sparkSession)}/resources-{uuid.uuid4().hex}"
        raw.select(*key).distinct().withColumns(_resource_columns()).write.parquet(path)
        own = raw.sparkSession.read.parquet(path)
        names = {c: f"__{c}" for c in key}
        same = raw["resource_attributes"].eqNullSafe(F.col("__resource_attributes")) & raw["schema_url"].eqNullSafe(F.col("__schema_url"))
        rows = raw.join(own.withColumnsRenamed(names), same).drop(*names.values())
    return rows.select(
        "id", "request_id", "resource_idx", "scope_idx", "resource_id",
        mapping.event_time(mapping.saturate_timestamp(F.col("time_unix_nano")), mapping.saturate_timestamp(F.col("observed_time_unix_nano"))).alias("timestamp_ns"), mapping.saturate_timestamp(F.col("observed_time_unix_nano")).alias("observed_timestamp_ns"),
        mapping.severity(F.col("severity_number")).alias("severity_number"), mapping.non_empty(F.col("severity_text")).alias("severity_text"), mapping.parse_id(F.col("trace_id"), 16).alias("trace_id"), mapping.parse_id(F.col("span_id"), 8).alias("span_id"),
        mapping.body_choice(F.col("body"), F.col("body_json") if "body_json" in raw.columns else F.lit(None).cast("string")).alias("body"), mapping.non_empty(F.col("event_name")).alias("event_name"), "flags", "dropped_attributes_count", "scope_name", mapping.non_empty(F.col("scope_version")).alias("scope_version"),
        canonical.attributes_json(F.col("scope_attributes")).alias("scope_attributes_json"), mapping.non_empty(F.col("scope_schema_url")).alias("scope_schema_url"), canonical.attributes_json(F.col("attributes")).alias("attributes_json"),
        "service_name", mapping.non_empty(F.col("__host")).alias("host_name"), mapping.non_empty(F.col("schema_url")).alias("schema_url"), "resource_json", *[c for c in ("ticket", "user_id", "event_type", "value", "ts") if c in raw.columns],
    )


RESOURCE = ["service_name", "host_name", "schema_url", "resource_json"]


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All log rows with their resource's columns, mapped once and stored by event_date, each file sorted by (resource_id, timestamp_ns)."""

    return store.derived(spark, "log_rows", f"{sf_dir}/events.parquet", lambda path: build_log_rows(spark, sf_dir, path))


#: Bloom filters of trace ids in each row group, as small as its ids allow: a trace opens only the row groups that may hold it.
TRACE_FILTERS = {"parquet.bloom.filter.enabled#trace_id": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 20)}


def build_log_rows(spark: SparkSession, sf_dir: str, path: str) -> None:
    rows = stored_records(raw_records(spark, sf_dir, even=True)).withColumn("event_date", mapping.event_date(F.col("timestamp_ns")))
    rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", "resource_id", "timestamp_ns").write.mode("overwrite").options(**TRACE_FILTERS).partitionBy("event_date").parquet(path)


def log_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(log_event, log_resource) of the events table."""
    from ..operators.identity import resource_rows

    rows = log_rows(spark, sf_dir)
    resources = store.derived(spark, "log_resource", f"{sf_dir}/events.parquet", lambda path: resource_rows(rows).write.mode("overwrite").parquet(path))
    return rows.drop(*RESOURCE), resources
