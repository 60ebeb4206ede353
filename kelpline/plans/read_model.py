"""Read-side queries over the log model: scans, filters, scalar mappings, counts (operators A3, A7, A8, A11, B*, C*, D12, J1-J6, G1-G5, G22, H1-H3)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import canonical, mapping
from ..operators import identity
from ..sources.driver_tables import CTES, build_log_rows, log_rows, log_tables, raw_records, stored_records
from .registry import query

JAN_10, JAN_20 = 1704844800000000000, 1705708800000000000


def logs(spark: SparkSession, sf_dir: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The read view, of all rows or of a range of times."""
    events, resources = log_tables(spark, sf_dir)
    if low is not None and high is not None:
        events = events.where(mapping.in_range("timestamp_ns", low, high))
    view = identity.read_view(events, resources)
    return view.withColumns({"trace_id": mapping.hex_text(F.col("trace_id")), "span_id": mapping.hex_text(F.col("span_id"))})


def log(name: str, tail: str):
    return query(name, CTES + tail)


@log("b1_logs_view", "SELECT * FROM logs")
def b1(spark, sf):
    return logs(spark, sf)


@log("b2_time_range", f"SELECT id, timestamp_ns, service_name FROM logs WHERE timestamp_ns >= {JAN_10} AND timestamp_ns < {JAN_20}")
def b2(spark, sf):
    return logs(spark, sf, JAN_10, JAN_20).select("id", "timestamp_ns", "service_name")


@log("b3_resource_time_range", f"SELECT id, resource_id, timestamp_ns FROM logs WHERE resource_id = (SELECT min(id) FROM res) AND timestamp_ns >= {JAN_10} AND timestamp_ns < {JAN_20}")
def b3(spark, sf):
    events, resources = log_tables(spark, sf)
    first = resources.agg(F.min("id").alias("resource_id"))
    return events.where(mapping.in_range("timestamp_ns", JAN_10, JAN_20)).join(first, "resource_id", "left_semi").select("id", "resource_id", "timestamp_ns")


@log("b4_trace_lookup", "SELECT trace_id, timestamp_ns, id FROM logs WHERE trace_id = (SELECT min(trace_id) FROM logs WHERE trace_id IS NOT NULL) ORDER BY timestamp_ns, id")
def b4(spark, sf):
    events, _ = log_tables(spark, sf)
    wanted = events.agg(F.min("trace_id")).first()[0]
    found = identity.trace_lookup(events, bytes(wanted or b""))
    return found.orderBy("timestamp_ns", "id").select(mapping.hex_text(F.col("trace_id")).alias("trace_id"), "timestamp_ns", "id")


@log("b0_build_log_table", "SELECT CAST(CAST(make_timestamp(timestamp_ns // 1000) AS DATE) AS VARCHAR) AS event_date, count(*) AS n FROM rec GROUP BY 1")
def b0(spark, sf):
    """The write path by itself: all events mapped, identified and stored anew."""
    path = f"{store.shared_dir(spark)}/log-rows-{uuid.uuid4().hex}"
    build_log_rows(spark, sf, path)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("n"))


@log("b5_service_filter", "SELECT id, host_name FROM logs WHERE service_name = 'svc-2'")
def b5(spark, sf):
    return logs(spark, sf).where("service_name = 'svc-2'").select("id", "host_name")


@log("b6_body_scope_equality", "SELECT id, body, scope_name FROM logs WHERE body = 'error by user 3' AND scope_name = 'scope-1'")
def b6(spark, sf):
    return logs(spark, sf).where("body = 'error by user 3' AND scope_name = 'scope-1'").select("id", "body", "scope_name")


@log("b7_attribute_ilike", "SELECT id FROM logs WHERE attributes_json ILIKE '%RUN-1%' AND attributes_json ILIKE '%\"k\":7,%'")
def b7(spark, sf):
    a = F.col("attributes_json")
    return logs(spark, sf).where(a.ilike("%RUN-1%") & a.ilike('%"k":7,%')).select("id")


@log("b8_has_trace", "SELECT count(*) AS n FROM logs WHERE trace_id IS NOT NULL")
def b8(spark, sf):
    return logs(spark, sf).where("trace_id IS NOT NULL").agg(F.count("*").alias("n"))


@log("b9_origin_audit", "SELECT count(*) AS n FROM logs WHERE (id // 10 % 2 = 0 AND service_name <> 'svc-0') OR (id // 10 % 2 = 1 AND service_name <> 'svc-1')")
def b9(spark, sf):
    return logs(spark, sf).where("(id div 10 % 2 = 0 AND service_name <> 'svc-0') OR (id div 10 % 2 = 1 AND service_name <> 'svc-1')").agg(F.count("*").alias("n"))


@log("b10_zero_observed", "SELECT count(*) AS n, count_if(observed_timestamp_ns = 0) AS n_zero FROM logs")
def b10(spark, sf):
    return logs(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("observed_timestamp_ns") == 0).alias("n_zero"))


@log("b11_seq_not_record_id", "SELECT count(*) AS n FROM rec WHERE id IS DISTINCT FROM record_id AND run_id = 'run-1'")
def b11(spark, sf):
    a = F.col("attributes_json")
    seq, record = (mapping.json_value(a, k).cast("bigint") for k in ("bench.seq", "bench.record_id"))
    return logs(spark, sf).where((mapping.json_value(a, "bench.run_id") == "run-1") & ~seq.eqNullSafe(record)).agg(F.count("*").alias("n"))


@log("b12_trace_context", "SELECT id, trace_id IS NOT NULL AS has_trace, span_id IS NOT NULL AS has_span, trace_id IS NOT NULL AND span_id IS NOT NULL AS has_trace_context FROM logs")
def b12(spark, sf):
    t, s = F.col("trace_id").isNotNull(), F.col("span_id").isNotNull()
    return logs(spark, sf).select("id", t.alias("has_trace"), s.alias("has_span"), (t & s).alias("has_trace_context"))


@log("b13_events_only", "SELECT id, event_name FROM logs WHERE event_name IS NOT NULL")
def b13(spark, sf):
    return logs(spark, sf).where("event_name IS NOT NULL").select("id", "event_name")


@log("b14_trace_flags", "SELECT id, flags & 255 AS trace_flags FROM logs")
def b14(spark, sf):
    return logs(spark, sf).select("id", F.col("flags").bitwiseAND(255).alias("trace_flags"))


@log("b_service_errors", f"SELECT service_name, count(*) AS n, count(DISTINCT trace_id) AS traces, max(timestamp_ns) AS latest FROM logs WHERE severity_number >= 17 AND timestamp_ns >= {JAN_10} AND timestamp_ns < {JAN_20} GROUP BY service_name")
def service_errors(spark, sf):
    seen = logs(spark, sf, JAN_10, JAN_20).where(F.col("severity_number") >= 17)
    return seen.groupBy("service_name").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces"), F.max("timestamp_ns").alias("latest"))


@log("a3_flatten_requests", "SELECT request_id, resource_idx, scope_idx, CAST(row_number() OVER (PARTITION BY request_id, resource_idx, scope_idx ORDER BY id) - 1 AS INTEGER) AS record_idx, id FROM raw")
def a3(spark, sf):
    from ..operators.flatten import flatten_requests, nest_requests

    return flatten_requests(nest_requests(raw_records(spark, sf))).select("request_id", "resource_idx", "scope_idx", "record_idx", "id")


@log("a7_resource_upsert", "SELECT id, service_name, host_name, schema_url, attributes_json FROM res")
def a7(spark, sf):
    rows = log_rows(spark, sf)
    early, late = (identity.resource_rows(rows.where(c)) for c in ("id % 2 = 0", "id % 2 = 1"))
    return identity.upsert_resources(early, late).drop("first_seen")


A8 = """SELECT sha256(unhex('00000000000000000000000000000000') || unhex(CASE WHEN user_id % 2 = 0 THEN '1c' ELSE '00' END || '00000000000000') || encode(CASE WHEN user_id % 2 = 0 THEN 'https://example.test/schemas' ELSE '' END) || unhex('0200000000000000') || encode('{}')) AS resource_id,
  '' AS service_name, count(*) AS n FROM events GROUP BY 1"""


@query("a8_resourceless_origin", A8)
def a8(spark, sf):
    rows = stored_records(raw_records(spark, sf).withColumn("resource_attributes", F.array().cast(canonical.ATTRIBUTES)))
    return rows.groupBy("resource_id", "service_name").agg(F.count("*").alias("n"))


@log("a11_count_for_run", "SELECT count(*) AS n FROM rec WHERE run_id = 'run-0'")
def a11(spark, sf):
    return log_tables(spark, sf)[0].where(mapping.json_value(F.col("attributes_json"), "bench.run_id") == "run-0").agg(F.count("*").alias("n"))


@log("c1_timestamp_saturation", "SELECT id, CAST(least(time_unix_nano, 9223372036854775807::HUGEINT) AS BIGINT) AS t, time_unix_nano > 9223372036854775807::HUGEINT AS overflows FROM raw")
def c1(spark, sf):
    t = F.col("time_unix_nano")
    return raw_records(spark, sf).select("id", mapping.saturate_timestamp(t).alias("t"), mapping.timestamp_overflows(t).alias("overflows"))


@log("c2_event_time", "SELECT id, timestamp_ns, observed_timestamp_ns FROM rec")
def c2(spark, sf):
    raw = raw_records(spark, sf)
    t, o = (mapping.saturate_timestamp(F.col(c)) for c in ("time_unix_nano", "observed_time_unix_nano"))
    return raw.select("id", mapping.event_time(t, o).alias("timestamp_ns"), o.alias("observed_timestamp_ns"))


@log("c3_severity", "SELECT severity_number, count(*) AS n FROM rec GROUP BY severity_number")
def c3(spark, sf):
    return raw_records(spark, sf).groupBy(mapping.severity(F.col("severity_number")).alias("severity_number")).agg(F.count("*").alias("n"))


@log("c4_severity_name", "SELECT id, CASE severity_number WHEN 1 THEN 'TRACE' WHEN 5 THEN 'DEBUG' WHEN 9 THEN 'INFO' WHEN 13 THEN 'WARN' WHEN 17 THEN 'ERROR' WHEN 21 THEN 'FATAL' ELSE 'UNSPECIFIED' END AS name FROM rec")
def c4(spark, sf):
    return stored_records(raw_records(spark, sf)).select("id", mapping.severity_name(F.col("severity_number")).alias("name"))


@log("c5_ids", "SELECT id, trace_id, span_id, trace_hex <> '' AND trace_id IS NULL AS trace_invalid, span_id IS NULL AS span_invalid FROM rec")
def c5(spark, sf):
    t, s = F.col("trace_id"), F.col("span_id")
    return raw_records(spark, sf).select("id", mapping.hex_text(mapping.parse_id(t, 16)).alias("trace_id"), mapping.hex_text(mapping.parse_id(s, 8)).alias("span_id"), mapping.id_invalid(t, 16).alias("trace_invalid"), mapping.id_invalid(s, 8).alias("span_invalid"))


#: Doubles, how they print without exponent, and how in JSON.
DOUBLES = [
    (1e-20, "0.00000000000000000001", "1e-20"), (1.2e-7, "0.00000012", "1.2e-7"), (1e-6, "0.000001", "1e-6"), (1e-5, "0.00001", "0.00001"), (-0.03125, "-0.03125", "-0.03125"), (0.0, "0", "0.0"), (-0.0, "-0", "-0.0"), (123456.789, "123456.789", "123456.789"),
    (1e7, "10000000", "10000000.0"), (-12345678.5, "-12345678.5", "-12345678.5"), (1e15, "1000000000000000", "1000000000000000.0"), (1e16, "10000000000000000", "1e16"), (1.5e21, "1500000000000000000000", "1.5e21"), (1e300, "1" + "0" * 300, "1e300"),
    (float("nan"), "NaN", "null"), (float("inf"), "inf", "null"), (float("-inf"), "-inf", "null"),
]
def special():
    return F.element_at(F.array(*[F.lit(d[0]) for d in DOUBLES]), (F.col("id") % len(DOUBLES) + 1).cast("int"))


def _expected(k: int) -> str:
    return f"CASE id % {len(DOUBLES)} " + " ".join(f"WHEN {i} THEN '{d[k]}'" for i, d in enumerate(DOUBLES)) + " END"


QUARTERS = "rtrim(rtrim(CAST(CAST(floor(value * 4) / 4 AS DECIMAL(18, 2)) AS VARCHAR), '0'), '.')"


@log("c6_scalar_body", f"SELECT id, CASE id % 5 WHEN 0 THEN event_type WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN {QUARTERS} WHEN 3 THEN {_expected(1)} ELSE CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END END AS body FROM raw")
def c6(spark, sf):
    k = F.col("id") % 5
    double = F.when(k == 2, F.floor(F.col("value") * 4) / 4).when(k == 3, special())
    body = mapping.scalar_body(F.when(k == 0, F.col("event_type")), F.when(k == 1, F.col("user_id")), double, F.when(k == 4, F.col("user_id") % 2 == 0))
    return raw_records(spark, sf).select("id", body.alias("body"))


@log("c9_body_choice", "SELECT id, coalesce(body, CASE WHEN id % 2 = 0 THEN '{}' END) AS body FROM rec")
def c9(spark, sf):
    return raw_records(spark, sf).select("id", mapping.body_choice(F.col("body"), F.when(F.col("id") % 2 == 0, F.lit("{}"))).alias("body"))


@log("c11_attributes_json", "SELECT id, attributes_json, res_json AS resource_json FROM raw")
def c11(spark, sf):
    return raw_records(spark, sf).select("id", canonical.attributes_json(F.col("attributes")).alias("attributes_json"), canonical.attributes_json(F.col("resource_attributes")).alias("resource_json"))


@log("c13_hex", "SELECT id, trace_hex, span_hex FROM raw")
def c13(spark, sf):
    return raw_records(spark, sf).select("id", mapping.hex_text(F.col("trace_id")).alias("trace_hex"), mapping.hex_text(F.col("span_id")).alias("span_hex"))


@log("c14_json_double", f"SELECT id, CASE WHEN id % 3 = 0 THEN CAST(user_id AS VARCHAR) || '.5' ELSE {_expected(2)} END AS json FROM raw")
def c14(spark, sf):
    return raw_records(spark, sf).select("id", mapping.json_double(F.when(F.col("id") % 3 == 0, F.col("user_id") + 0.5).otherwise(special())).alias("json"))


@log("c17_empty_to_null", "SELECT id, severity_text, event_name, scope_version FROM rec")
def c17(spark, sf):
    return raw_records(spark, sf).select("id", *[mapping.non_empty(F.col(c)).alias(c) for c in ("severity_text", "event_name", "scope_version")])


@log("c18_attribute_lookup", "SELECT id, '\"' || user_id || '\"' AS user_value, CAST(NULL AS VARCHAR) AS missing FROM raw")
def c18(spark, sf):
    a = F.col("attributes")
    return raw_records(spark, sf).select("id", canonical.attribute(a, "user")["value"].alias("user_value"), canonical.attribute(a, "nothing")["value"].alias("missing"))


@log("c19_typed_access", "SELECT id, record_id AS as_int, run_id AS as_string, CAST(NULL AS BIGINT) AS wrong_type FROM raw")
def c19(spark, sf):
    j = canonical.attributes_json(F.col("attributes"))
    return raw_records(spark, sf).select("id", mapping.json_value(j, "bench.record_id").cast("bigint").alias("as_int"), mapping.json_value(j, "bench.run_id").alias("as_string"), mapping.json_value(j, "bench.run_id").try_cast("bigint").alias("wrong_type"))


@log("c20_service_host", "SELECT id, service_name, nullif(host, '') AS host_name FROM raw")
def c20(spark, sf):
    return stored_records(raw_records(spark, sf)).select("id", "service_name", "host_name")


@log("c21_fingerprint", "SELECT id, resource_id FROM rec")
def c21(spark, sf):
    return stored_records(raw_records(spark, sf)).select("id", "resource_id")


@query("c22_preview", r"SELECT doc_id, regexp_replace(left(text, 200), '[\x00-\x1F\x7F-\x9F]', chr(65533), 'g') AS preview FROM documents")
def c22(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", mapping.safe_preview(F.col("text")).alias("preview"))


@log("c23_json_extract", "SELECT id, id AS seq, run_id FROM raw")
def c23(spark, sf):
    a = F.col("attributes_json")
    return log_tables(spark, sf)[0].select("id", mapping.json_value(a, "bench.seq").cast("bigint").alias("seq"), mapping.json_value(a, "bench.run_id").alias("run_id"))


@log("c24_json_object", "SELECT id, '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' AS json FROM raw")
def c24(spark, sf):
    return raw_records(spark, sf).select("id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("json"))


@log("c25_index_text", "SELECT id, coalesce(body, '') AS body, coalesce(event_name, '') AS event_name, coalesce(severity_text, '') AS severity_text FROM logs")
def c25(spark, sf):
    return logs(spark, sf).select("id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("body", "event_name", "severity_text")])


@log("c28_retention_cutoff", "SELECT count(*) AS n FROM rec WHERE timestamp_ns < 1706659200000000000 - 864000000000000")
def c28(spark, sf):
    cutoff = mapping.retention_cutoff(1706659200000000000, 864000000000000)
    return log_tables(spark, sf)[0].where(F.col("timestamp_ns") < cutoff).agg(F.count("*").alias("n"))


@log("c29_series_key", "SELECT id, event_type || '{user=' || user_id || ',svc=' || service_name || '}' AS series FROM raw")
def c29(spark, sf):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    rows = stored_records(raw_records(spark, sf))
    return rows.select("id", mapping.series_key(F.col("event_type"), F.array(pair("user", F.col("user_id")), pair("svc", F.col("service_name")))).alias("series"))


@log("c30_clamped_micros", "SELECT id, CAST(trunc(least(greatest(value * 1e6, 0.0), 3.6e9)) AS BIGINT) AS micros FROM raw")
def c30(spark, sf):
    return raw_records(spark, sf).select("id", mapping.clamped_micros(F.col("value")).alias("micros"))


@log("c31_scope_columns", "SELECT scope_name, scope_version, scope_attributes_json, count(*) AS n FROM rec GROUP BY ALL")
def c31(spark, sf):
    from ..operators.flatten import flatten_requests, nest_requests

    flat = flatten_requests(nest_requests(raw_records(spark, sf)))
    return flat.groupBy("scope_name", "scope_version", "scope_attributes_json").agg(F.count("*").alias("n"))


@log("d12_mapping_losses", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN time_unix_nano > 9223372036854775807::HUGEINT THEN 'timestamp_overflow' END AS reason FROM rec UNION ALL SELECT CASE WHEN trace_hex <> '' AND trace_id IS NULL THEN 'invalid_trace_id' END FROM rec UNION ALL SELECT CASE WHEN span_id IS NULL THEN 'invalid_span_id' END FROM rec UNION ALL SELECT CASE WHEN sev NOT BETWEEN 0 AND 24 THEN 'unknown_severity' END FROM rec) WHERE reason IS NOT NULL GROUP BY reason")
def d12(spark, sf):
    from ..operators.validation import mapping_losses

    return mapping_losses(raw_records(spark, sf))


@log("j1_resource_join", "SELECT logs.id, service_name FROM logs")
def j1(spark, sf):
    return logs(spark, sf).select("id", "service_name")


@log("j3_orphan_resources", "SELECT id FROM res WHERE id NOT IN (SELECT resource_id FROM rec WHERE service_name <> 'svc-1')")
def j3(spark, sf):
    events, resources = log_tables(spark, sf)
    kept = events.join(resources.where("service_name <> 'svc-1'").select(F.col("id").alias("resource_id")), "resource_id", "left_semi")
    return identity.orphan_resources(resources, kept).select("id")


@log("j4_cascade_delete", "SELECT id FROM rec WHERE service_name <> 'svc-3'")
def j4(spark, sf):
    events, resources = log_tables(spark, sf)
    return identity.cascade_delete(events, resources.where("service_name = 'svc-3'")).select("id")


@log("j5_foreign_keys", "SELECT count(*) AS violations FROM rec WHERE service_name = 'svc-0'")
def j5(spark, sf):
    events, resources = log_tables(spark, sf)
    return identity.foreign_key_violations(events, resources.where("service_name <> 'svc-0'")).agg(F.count("*").alias("violations"))


@log("j6_delete_selected", "SELECT id FROM rec WHERE id NOT IN (SELECT id FROM rec ORDER BY timestamp_ns, id LIMIT 500)")
def j6(spark, sf):
    events, _ = log_tables(spark, sf)
    oldest = events.orderBy("timestamp_ns", "id").limit(500).select("id")
    return events.join(oldest, "id", "left_anti").select("id")


@log("g1_counts", "SELECT count(*) AS n, count_if(severity_number >= 17) AS n_errors FROM logs")
def g1(spark, sf):
    return logs(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("severity_number") >= 17).alias("n_errors"))


@log("g2_count_distinct", "SELECT count(DISTINCT trace_id) AS traces, count(DISTINCT resource_id) AS resources FROM logs")
def g2(spark, sf):
    return logs(spark, sf).agg(F.countDistinct("trace_id").alias("traces"), F.countDistinct("resource_id").alias("resources"))


@log("g3_conditional_counts", "SELECT count_if(service_name = 'svc-0') AS backend, count_if(attributes_json ILIKE '%run-1%') AS other, count_if(observed_timestamp_ns = 0) AS zero, count(*) AS total FROM logs")
def g3(spark, sf):
    return logs(spark, sf).agg(F.count_if(F.col("service_name") == "svc-0").alias("backend"), F.count_if(F.col("attributes_json").ilike("%run-1%")).alias("other"), F.count_if(F.col("observed_timestamp_ns") == 0).alias("zero"), F.count("*").alias("total"))


@log("g4_max_or_zero", "SELECT service_name, coalesce(max(id) FILTER (WHERE severity_number = 17), 0) AS max_id FROM logs GROUP BY service_name")
def g4(spark, sf):
    return logs(spark, sf).groupBy("service_name").agg(F.coalesce(F.max(F.when(F.col("severity_number") == 17, F.col("id"))), F.lit(0)).alias("max_id"))


@log("g5_row_counts", "SELECT 'log_event' AS name, count(*) AS n FROM rec UNION ALL SELECT 'log_resource', count(*) FROM res")
def g5(spark, sf):
    from ..operators.lifecycle import row_counts

    events, resources = log_tables(spark, sf)
    return row_counts({"log_event": events, "log_resource": resources})


@log("g22_volumes", "SELECT service_name, severity_number, event_name, count(*) AS n FROM logs GROUP BY ALL")
def g22(spark, sf):
    return logs(spark, sf).groupBy("service_name", "severity_number", "event_name").agg(F.count("*").alias("n"))


@log("h1_by_id", "SELECT id, timestamp_ns FROM logs WHERE service_name = 'svc-1' ORDER BY id")
def h1(spark, sf):
    return logs(spark, sf).where("service_name = 'svc-1'").select("id", "timestamp_ns").orderBy("id")


@log("h2_oldest", "SELECT id, timestamp_ns FROM logs ORDER BY timestamp_ns, id LIMIT 100")
def h2(spark, sf):
    return logs(spark, sf).orderBy("timestamp_ns", "id").limit(100).select("id", "timestamp_ns")


@log("h3_keyset_pages", "SELECT page, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 2000 AS page FROM rec WHERE id > 99 AND id <= (SELECT max(id) - 50 FROM rec)) GROUP BY page")
def h3(spark, sf):
    from ..operators.search import keyset_pages

    events, _ = log_tables(spark, sf)
    until = events.agg(F.max("id")).first()[0] or 0
    return keyset_pages(events, 99, until - 50, 2000)
