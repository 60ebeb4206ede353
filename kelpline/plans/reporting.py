"""Reconciliation, lifecycle, windows and older metrics (operators A5, G*, H4, H5, J2, J7-J11, K*, S*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import store
from ..operators import histogram, intervals, lifecycle, metrics, reports, versions
from ..sources.access_log import parse_access_log
from ..sources.driver_tables import log_tables, table
from .read_model import log
from .registry import query

NOW = 1706659200000000000
WINDOW = 10 * 86400 * 10**9


@query("a5_access_log", "SELECT event_id, '10.0.0.' || (user_id % 250) AS remote, '/' || event_type AS path, 200 + event_id % 300 AS status, event_id * 7 AS bytes, epoch_us(ts) // 1000000 * 1000000 AS t_us FROM events")
def a5(spark, sf):
    e = table(spark, sf, "events")
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    line = F.format_string('10.0.0.%d - - [%s +0000] "GET /%s HTTP/1.1" %d %d "-" "agent/1.0"', F.col("user_id") % 250, stamp, F.col("event_type"), 200 + F.col("event_id") % 300, F.col("event_id") * 7)
    parsed = parse_access_log(e.select("event_id", line.alias("value")))
    return parsed.select("event_id", "remote", "path", "status", "bytes", F.unix_micros("time").alias("t_us"))


SPANS = "a AS (SELECT event_id * 10 AS s, event_id * 10 + user_id % 25 AS e FROM events), b AS (SELECT event_id * 10 AS s, event_id * 10 + user_id % 25 AS e FROM events WHERE event_type = 'error')"
COVER = "pa AS (SELECT DISTINCT unnest(range(s, e + 1)) AS v FROM a), pb AS (SELECT DISTINCT unnest(range(s, e + 1)) AS v FROM b)"
ISLANDS = "SELECT min(v) AS start, max(v) AS \"end\" FROM (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM {}) GROUP BY g"


def spans(spark, sf, only=None):
    e = table(spark, sf, "events")
    e = e.where(only) if only else e
    return e.select((F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + F.col("user_id") % 25).alias("end"))


ERROR = "event_type = 'error'"


@query("s2_interval_merge", f"WITH {SPANS}, {COVER} {ISLANDS.format('pa')}")
def s2(spark, sf):
    return intervals.merge(spans(spark, sf))


@query("s3_interval_subtract", f"WITH {SPANS}, {COVER} {ISLANDS.format('(SELECT v FROM pa EXCEPT SELECT v FROM pb)')}")
def s3(spark, sf):
    return intervals.subtract(spans(spark, sf), spans(spark, sf, ERROR))


@query("s4_interval_total", f"WITH {SPANS}, {COVER} SELECT count(*) AS total FROM pa")
def s4(spark, sf):
    return intervals.total(spans(spark, sf))


@query("j7_interval_contains", f"WITH {SPANS}, {COVER} SELECT event_id * 7 AS v FROM events WHERE event_id * 7 IN (SELECT v FROM pb)")
def j7(spark, sf):
    points = table(spark, sf, "events").select((F.col("event_id") * 7).alias("v"))
    return intervals.contains(points, spans(spark, sf, ERROR))


FOUND = "f AS (SELECT event_id + 1 AS v FROM events WHERE event_id % 31 <> 0 UNION ALL SELECT event_id + 1 FROM events WHERE event_id % 37 = 0 AND event_id % 31 <> 0 UNION ALL SELECT -event_id - 1 FROM events WHERE event_id % 997 = 3)"


def found(spark, sf):
    e = table(spark, sf, "events")
    v = (F.col("event_id") + 1).alias("v")
    return e.where("event_id % 31 <> 0").select(v).unionByName(e.where("event_id % 37 = 0 AND event_id % 31 <> 0").select(v)).unionByName(e.where("event_id % 997 = 3").select((-F.col("event_id") - 1).alias("v")))


@query("j8_missing_sequence", f"WITH {FOUND} SELECT event_id + 1 AS v FROM events WHERE event_id + 1 NOT IN (SELECT v FROM f)")
def j8(spark, sf):
    whole = table(spark, sf, "events").agg(F.lit(1).cast("bigint").alias("start"), (F.max("event_id") + 1).alias("end"))
    return intervals.missing(whole, found(spark, sf))


@query("g6_duplicates", f"WITH {FOUND} SELECT count(v) - count(DISTINCT v) AS duplicates FROM f")
def g6(spark, sf):
    return reports.duplicates(found(spark, sf))


def _run(spark, sf, recovery):
    n = (table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0) + 1
    o = table(spark, sf, "events")
    some = lambda k: o.where(F.col("event_id") % 100 == k).select((F.col("event_id") + 1).alias("start"), (F.col("event_id") + 3).alias("end"))
    return reports.correctness(found(spark, sf), n, some(50), some(80), recovery)


RUN = f"WITH {FOUND}, r AS (SELECT unnest(range(event_id + 1, event_id + 4)) AS v FROM events WHERE event_id % 100 = 50), m AS (SELECT unnest(range(event_id + 1, event_id + 4)) AS v FROM events WHERE event_id % 100 = 80), u AS (SELECT DISTINCT v FROM f), x AS (SELECT (SELECT count(*) FROM (SELECT event_id + 1 AS v FROM events EXCEPT SELECT v FROM r EXCEPT SELECT v FROM m EXCEPT SELECT v FROM f)) AS missing, (SELECT count(v) - count(DISTINCT v) FROM f) AS duplicate, (SELECT count(*) FROM u WHERE v < 1 OR v > (SELECT max(event_id) + 1 FROM events)) AS unexpected, (SELECT count(*) FROM u WHERE v IN (SELECT v FROM r)) AS rejected_present, (SELECT count(*) FROM u WHERE v IN (SELECT v FROM m)) AS ambiguous_present) SELECT *, missing = 0 AND duplicate = 0 AND unexpected = 0 AND {{}} AS passed FROM x"


@query("g7_correctness", RUN.format("rejected_present = 0"))
def g7(spark, sf):
    return _run(spark, sf, False)


@query("g7b_recovery", RUN.format("true"))
def g7b(spark, sf):
    return _run(spark, sf, True)


LEDGER = "l AS (SELECT o_orderkey * 10 AS s, o_orderkey * 10 + 9 AS e, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'ambiguous' END AS class FROM orders)"


def ledger(spark, sf):
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "accepted").when(status == "O", "rejected").otherwise("ambiguous")
    return o.select((F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 9).alias("end"), kind.alias("class"))


@query("g8_accounting", f"WITH {LEDGER} SELECT sum(e - s + 1)::BIGINT AS generated, coalesce(sum(e - s + 1) FILTER (WHERE class = 'accepted'), 0)::BIGINT AS accepted, coalesce(sum(e - s + 1) FILTER (WHERE class = 'rejected'), 0)::BIGINT AS rejected, coalesce(sum(e - s + 1) FILTER (WHERE class = 'ambiguous'), 0)::BIGINT AS ambiguous, true AS balanced, true AS partitioned FROM l")
def g8(spark, sf):
    return reports.accounting(ledger(spark, sf))


@query("g9_expected_persisted", f"WITH x AS (SELECT unnest(range(1, (SELECT max(event_id) + 2 FROM events))) AS v EXCEPT SELECT event_id + 1 FROM events WHERE event_id % 100 IN (50, 80)) {ISLANDS.format('x')}")
def g9(spark, sf):
    e = table(spark, sf, "events")
    n = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    one = lambda k: e.where(F.col("event_id") % 100 == k).select((F.col("event_id") + 1).alias("start"), (F.col("event_id") + 1).alias("end"))
    return reports.expected_persisted(n, one(50), one(80))


@query("g10_outcome_ledger", f"WITH {LEDGER} SELECT class, min(s) AS start, max(e) AS \"end\", NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS positions_exact FROM (SELECT *, s - 10 * row_number() OVER (PARTITION BY class ORDER BY s) AS g FROM l) GROUP BY class, g")
def g10(spark, sf):
    rows = ledger(spark, sf)
    return reports.outcome_ledger(rows.withColumn("class", F.when(F.col("class") == "ambiguous", "partial").otherwise(F.col("class"))))


@query("g11_outcome_class", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'partial' END WHEN o_orderkey % 5 IN (1, 2) AND o_orderkey % 7 <> 0 THEN 'rejected' ELSE 'ambiguous' END AS class FROM orders")
def g11(spark, sf):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("ok", "invalid_argument", "unavailable", "deadline_exceeded", "resource_exhausted")]), (k % 5 + 1).cast("int"))
    rejected = F.when(k % 3 == 0, 0).when(k % 3 == 1, 10).otherwise(4)
    return table(spark, sf, "orders").select("o_orderkey", reports.classify_outcome(status, k % 7 == 0, rejected, F.lit(10)).alias("class"))


PCT = ", ".join(f"quantile_disc(m, {p}) AS {n}" for n, p in reports.PERCENTILES.items())


@query("g12_latency", f"SELECT event_type, count(*) AS n, min(m) AS min, {PCT}, max(m) AS max FROM (SELECT event_type, CAST(trunc(value * 1000) AS BIGINT) AS m FROM events) GROUP BY event_type")
def g12(spark, sf):
    samples = table(spark, sf, "events").select("event_type", (F.col("value") * 1000).cast("bigint").alias("m"))
    return reports.latency_summary(samples, ["event_type"], "m", exact=True)


BUCKETED = """v AS (SELECT event_type, least(greatest(CAST(trunc(value * 1000) AS BIGINT), 0), 3600000000) AS v FROM events WHERE value IS NOT NULL),
b AS (SELECT event_type, greatest(length(bin(v)) - 11, 0) * 1024 + (v >> greatest(length(bin(v)) - 11, 0)) AS bucket, count(*) AS n, min(v) AS least, max(v) AS most FROM v GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b)"""
BUCKET_CELLS = ", ".join(f"min(most) FILTER (WHERE upto >= greatest(ceil(total * {p}::DOUBLE), 1)) AS {n}" for n, p in reports.PERCENTILES.items())


@query("g12_latency_histogram", f"WITH {BUCKETED} SELECT event_type, CAST(sum(n) AS BIGINT) AS n, min(least) AS min, {BUCKET_CELLS}, max(most) AS max FROM u GROUP BY event_type")
def g12_histogram(spark, sf):
    """A histogram for each user and type, then added up for each type."""
    samples = table(spark, sf, "events").select("event_type", "user_id", (F.col("value") * 1000).cast("bigint").alias("m"))
    own = histogram.histogram(samples, ["event_type", "user_id"], "m")
    return histogram.summary(histogram.merge([own], ["event_type"]), ["event_type"])


HEALTH = """h AS (SELECT event_id, user_id, event_id % 97 <> 5 AS wr, event_id % 89 <> 7 AS br, event_id % 23 * 4000 AS wi, event_id % 19 * 5000 AS bi, CASE WHEN event_id % 4 = 0 THEN event_id % 11 ELSE 0 END AS qd,
  CASE WHEN event_id % 7 = 0 THEN 0 ELSE 10 END AS qc, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE 0 END AS pr, event_id % 2 AS ot, event_id % 41 * 3000 AS wm, event_id % 13 = 0 AS mi, event_id % 701 * 2000 AS me FROM events),
x AS (SELECT *, qc > 0 AND qd >= 8 AS sat, ot > 0 AND wm >= 60000 AS slow, greatest(CASE WHEN qd > 0 THEN wi ELSE 0 END, CASE WHEN pr > 0 THEN bi ELSE 0 END) AS age FROM h),
j AS (SELECT *, CASE WHEN NOT wr THEN 'Unhealthy|writer not running' WHEN NOT br THEN 'Unhealthy|batcher not running'
  WHEN mi THEN CASE WHEN me >= 900000 THEN 'Unhealthy|maintenance stalled' WHEN slow THEN 'Degraded|maintenance ack stall' WHEN sat THEN 'Degraded|maintenance saturated' ELSE 'Healthy|maintenance running' END
  WHEN qd + pr = 0 THEN CASE WHEN slow AND wi >= 60000 AND bi >= 60000 THEN 'Unhealthy|ack stall' ELSE 'Healthy|idle' END
  WHEN age >= 30000 THEN 'Unhealthy|stalled' WHEN age >= 5000 THEN 'Degraded|draining' WHEN sat THEN 'Degraded|saturated' ELSE 'Healthy|progressing' END AS v FROM x)"""


def health_samples(spark, sf):
    i = F.col("event_id")
    cells = {
        "writer_running": i % 97 != 5, "batcher_running": i % 89 != 7, "writer_idle_ms": i % 23 * 4000, "batcher_idle_ms": i % 19 * 5000, "queue_depth": F.when(i % 4 == 0, i % 11).otherwise(0), "queue_capacity": F.when(i % 7 == 0, 0).otherwise(10),
        "pending_records": F.when(i % 3 == 0, i % 5).otherwise(0), "outstanding_tickets": i % 2, "watermark_idle_ms": i % 41 * 3000, "maintenance_in_progress": i % 13 == 0, "maintenance_elapsed_ms": i % 701 * 2000,
    }
    return table(spark, sf, "events").select("event_id", "user_id", *[c.alias(n) for n, c in cells.items()])


@query("g13_health", f"WITH {HEALTH} SELECT event_id, split_part(v, '|', 1) AS state, nullif(split_part(v, '|', 2), '') AS reason FROM j")
def g13(spark, sf):
    return reports.health(health_samples(spark, sf)).select("event_id", "state", "reason")


@query("g14_transitions", f"WITH {HEALTH}, t AS (SELECT user_id, event_id, split_part(v, '|', 1) AS state, lag(split_part(v, '|', 1)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM j) SELECT * FROM t WHERE state IS DISTINCT FROM previous")
def g14(spark, sf):
    judged = reports.health(health_samples(spark, sf)).select("user_id", "event_id", "state")
    return reports.transitions(judged, "user_id", "event_id")


def samples(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("series"), F.to_date("ts").cast("string").alias("window"), F.struct("ts", "event_id").alias("t"), "value", "ts", "event_id")


@query("g15_counter_deltas", "SELECT event_type AS series, CAST(CAST(ts AS DATE) AS VARCHAR) AS \"window\", greatest(arg_max(value, struct_pack(a := ts, b := event_id)) - arg_min(value, struct_pack(a := ts, b := event_id)), 0.0) AS delta FROM events GROUP BY 1, 2")
def g15(spark, sf):
    return reports.counter_deltas(samples(spark, sf), ["series", "window"])


@query("g16_gauges", "SELECT event_type AS series, CAST(CAST(ts AS DATE) AS VARCHAR) AS \"window\", arg_max(value, struct_pack(a := ts, b := event_id)) AS last, greatest(max(value), 0.0) AS peak FROM events GROUP BY 1, 2")
def g16(spark, sf):
    return reports.gauges(samples(spark, sf), ["series", "window"])


@query("g17_prefix_sum", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS \"window\", round(sum(value), 4) AS total FROM events WHERE starts_with(event_type, 'p') GROUP BY 1")
def g17(spark, sf):
    return reports.prefix_sum(samples(spark, sf), "p", ["window"]).withColumn("total", F.round("total", 4))


@query("g18_size_trajectory", "SELECT arg_min(event_id * 3, event_id) AS first, arg_max(event_id * 3, event_id) AS last, max(event_id * 3) AS peak FROM events")
def g18(spark, sf):
    return reports.size_trajectory(table(spark, sf, "events").select("event_id", (F.col("event_id") * 3).alias("bytes")), "event_id", "bytes")


@query("g19_throughput", "SELECT event_type, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second FROM events GROUP BY event_type")
def g19(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return reports.throughput(e, ["event_type"], "ts", F.lit(1)).withColumn("per_second", F.round("per_second", 9))


@query("g20_until_saturated", "WITH s AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, count(*) AS generated, count_if(event_type = 'error' AND value > 10) AS rejected FROM events GROUP BY 1) SELECT step, generated, rejected FROM s WHERE step <= coalesce((SELECT min(step) FROM s WHERE rejected > 0.05 * generated), 9999)")
def g20(spark, sf):
    e = table(spark, sf, "events").withColumn("step", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    steps = e.groupBy("step").agg(F.count("*").alias("generated"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 10)).alias("rejected"), F.lit(0).alias("ambiguous"))
    return reports.until_saturated(steps).select("step", "generated", "rejected")


HIST = "p AS (SELECT strftime(l_shipdate, '%Y-%m') AS point_id, count_if(l_quantity <= 10) AS c0, count_if(l_quantity > 10 AND l_quantity <= 20) AS c1, count_if(l_quantity > 20 AND l_quantity <= 30) AS c2, count_if(l_quantity > 30 AND l_quantity <= 40) AS c3, count_if(l_quantity > 40) AS c4 FROM lineitem GROUP BY 1)"


def points(spark, sf):
    q = F.col("l_quantity")
    cells = [F.count_if(q <= 10), F.count_if((q > 10) & (q <= 20)), F.count_if((q > 20) & (q <= 30)), F.count_if((q > 30) & (q <= 40)), F.count_if(q > 40)]
    rows = table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("point_id")).agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    bounds = F.array(F.lit(10), F.lit(20), F.lit(30), F.lit(40))
    return rows.select("point_id", F.to_json(F.struct(bounds.alias("bounds"), F.array(*[f"c{i}" for i in range(5)]).alias("counts"))).alias("histogram_json"))


@query("g21_histogram_buckets", f"WITH {HIST} SELECT point_id, k AS bucket_index, CASE WHEN k < 4 THEN (k + 1) * 10.0 END::DOUBLE AS bound, CASE WHEN k < 4 THEN CAST((k + 1) * 10 AS VARCHAR) ELSE '+Inf' END AS bound_text, [c0, c1, c2, c3, c4][k + 1] AS n FROM p, range(5) r(k)")
def g21(spark, sf):
    return metrics.histogram_buckets(points(spark, sf))


@query("j10_unnest_bounds", f"WITH {HIST} SELECT point_id, k AS pos, (k + 1) * 10 AS bound FROM p, range(4) r(k)")
def j10(spark, sf):
    h = F.from_json("histogram_json", "bounds array<bigint>, counts array<bigint>")
    return points(spark, sf).select("point_id", F.posexplode(h["bounds"]).alias("pos", "bound"))


@query("j9_zip_arrays", f"WITH {HIST} SELECT point_id, k AS pos, (k + 1) * 10 AS bound, [c0, c1, c2, c3][k + 1] AS n FROM p, range(4) r(k)")
def j9(spark, sf):
    h = F.from_json("histogram_json", "bounds array<bigint>, counts array<bigint>")
    z = points(spark, sf).select("point_id", F.posexplode(F.arrays_zip(h["bounds"].alias("b"), h["counts"].alias("c"))).alias("pos", "z"))
    return z.where("pos < 4").select("point_id", "pos", F.col("z.b").alias("bound"), F.col("z.c").alias("n"))


@query("j11_bound_count", f"WITH {HIST} SELECT point_id, CAST(substr(point_id, 6, 2) AS INTEGER) % 5 AS n_bounds FROM p")
def j11(spark, sf):
    """Histograms of 0 to 4 bounds, by their month."""
    h, month = F.from_json("histogram_json", "bounds array<bigint>, counts array<bigint>"), F.substring("point_id", 6, 2).cast("int")
    cut = F.to_json(F.struct(F.slice(h["bounds"], F.lit(1), month % 5).alias("bounds"), F.slice(h["counts"], F.lit(1), month % 5 + 1).alias("counts")))
    rows = points(spark, sf).select("point_id", cut.alias("histogram_json"))
    return rows.select("point_id", F.size(h["bounds"]).alias("n_bounds"))


@query("s1_bucket_union", f"WITH {HIST} SELECT point_id, 'finite' AS part, c0 + c1 + c2 + c3 AS n FROM p UNION ALL SELECT point_id, '+Inf', c4 FROM p")
def s1(spark, sf):
    b = metrics.histogram_buckets(points(spark, sf))
    return b.groupBy("point_id", F.when(F.col("bound_text") == "+Inf", "+Inf").otherwise("finite").alias("part")).agg(F.sum("n").alias("n"))


@query("j2_metrics_view", "SELECT l_orderkey * 10 + l_linenumber AS point, p_name, s_name, n_name, r_name, l_quantity AS value FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def j2(spark, sf):
    t = lambda n: table(spark, sf, n)
    point = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point"), F.col("l_partkey").alias("series_id"), F.col("l_suppkey").alias("metric_id"), F.col("l_quantity").alias("value"))
    series, metric = t("part").select(F.col("p_partkey").alias("series_id"), "p_name"), t("supplier").select(F.col("s_suppkey").alias("metric_id"), "s_name", F.col("s_nationkey").alias("scope_id"))
    scope, resource = t("nation").select(F.col("n_nationkey").alias("scope_id"), "n_name", F.col("n_regionkey").alias("resource_id")), t("region").select(F.col("r_regionkey").alias("resource_id"), "r_name")
    return metrics.metrics_view(point, series, metric, scope, resource).select("point", "p_name", "s_name", "n_name", "r_name", "value")


SNAPS = "c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'snapshot-' || o_orderkey || '.tmp' WHEN o_orderkey % 7 = 0 THEN 'other-' || o_orderkey ELSE 'snapshot-' || o_orderkey END AS name, o_orderdate AS mtime FROM orders)"


@query("h5_prunable_snapshots", f"WITH {SNAPS}, r AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, '/b/' || name DESC) AS n FROM c WHERE starts_with(name, 'snapshot-') AND NOT ends_with(name, '.tmp')) SELECT name FROM r WHERE n > 50")
def h5(spark, sf):
    k = F.col("o_orderkey")
    name = F.when(k % 9 == 0, F.concat(F.lit("snapshot-"), k, F.lit(".tmp"))).when(k % 7 == 0, F.concat(F.lit("other-"), k)).otherwise(F.concat(F.lit("snapshot-"), k))
    rows = table(spark, sf, "orders").select(name.alias("name"), F.concat(F.lit("/b/"), name).alias("path"), F.col("o_orderdate").alias("mtime"))
    return lifecycle.prunable_snapshots(rows, 50).select("name")


@query("h4_latest_version", "SELECT max('v' || lpad(CAST(event_id AS VARCHAR), 9, '0')) AS version FROM events")
def h4(spark, sf):
    return lifecycle.latest_version(table(spark, sf, "events").select(F.concat(F.lit("v"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("version")))


@query("k6_schema_status", "SELECT 'v' || event_id AS version, CASE WHEN event_id % 5 = 0 THEN 'pending' WHEN event_id % 7 = 0 THEN 'newer' ELSE 'applied' END AS status FROM events")
def k6(spark, sf):
    e = table(spark, sf, "events")
    v = F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version")
    return lifecycle.schema_status(e.where("event_id % 5 = 0 OR event_id % 7 <> 0").select(v), e.where("event_id % 5 <> 0").select(v))


@log("k7_schema_evolution", "SELECT id, CASE WHEN id % 2 = 0 THEN '{}' ELSE scope_attributes_json END AS scope_attributes_json, CASE WHEN id % 2 = 1 THEN scope_name END AS scope_name FROM rec")
def k7(spark, sf):
    events, _ = log_tables(spark, sf)
    old = events.where("id % 2 = 0").drop("scope_name", "scope_attributes_json", "scope_version", "scope_schema_url")
    return lifecycle.with_scope_columns(old, events.where("id % 2 = 1")).select("id", "scope_attributes_json", "scope_name")


@query("k8_metric_identity", "SELECT DISTINCT user_id % 4 AS resource_id, event_type AS name, user_id % 2 = 0 AS is_monotonic, user_id % 3 AS temporality FROM events")
def k8(spark, sf):
    u = F.col("user_id")
    rows = table(spark, sf, "events").select((u % 4).alias("resource_id"), F.lit(0).alias("scope_id"), F.col("event_type").alias("name"), F.lit("1").alias("unit"), F.lit("sum").alias("kind"), (u % 2 == 0).alias("is_monotonic"), (u % 3).alias("temporality"), F.lit("{}").alias("attributes_json"))
    return metrics.distinct_metrics(rows).select("resource_id", "name", "is_monotonic", "temporality")


PURGE = f"x AS (SELECT * FROM rec WHERE timestamp_ns >= {NOW} - {WINDOW})"


@log("k1_purge", f", {PURGE} SELECT 'deleted' AS name, (SELECT count(*) FROM rec) - (SELECT count(*) FROM x) AS n UNION ALL SELECT 'kept', (SELECT count(*) FROM x) UNION ALL SELECT 'resources', count(DISTINCT resource_id) FROM x")
def k1(spark, sf):
    return lifecycle.purge_report(*log_tables(spark, sf), NOW, WINDOW)


@log("k1_purge_stored", f", {PURGE} SELECT 'deleted' AS name, (SELECT count(*) FROM rec) - (SELECT count(*) FROM x) AS n UNION ALL SELECT 'kept', (SELECT count(*) FROM x) UNION ALL SELECT 'resources', count(DISTINCT resource_id) FROM x")
def k1_stored(spark, sf):
    """The purge as a delete of stored tables: whole days go, the border day is written anew."""
    return _stored(spark, sf, lambda tables, schema, own: tables.purge(NOW, WINDOW, schema, own))


def _stored(spark, sf, evict):
    """(name, n): what a call of ``evict`` deletes of stored tables, and what they hold then."""
    events, resources = log_tables(spark, sf)
    schema, own = (", ".join(f"{c} {t}" for c, t in df.dtypes) for df in (events, resources))
    tables = versions.Tables(spark, f"{store.shared_dir(spark)}/evicted-{uuid.uuid4().hex}")
    tables.append({"log_event": events, "log_resource": resources})
    gone = evict(tables, schema, own)
    counts = lifecycle.row_counts({"kept": tables.read("log_event", schema), "resources": tables.read("log_resource", own)})
    return counts.unionByName(spark.range(1).select(F.lit("deleted").alias("name"), F.lit(gone["deleted"]).cast("bigint").alias("n")))


QUOTA = 400_000
GONE = f"z AS (SELECT id, timestamp_ns, row_number() OVER (ORDER BY timestamp_ns, id) AS place, sum(coalesce(octet_length(encode(body)), 0) + octet_length(encode(attributes_json))) OVER (ORDER BY timestamp_ns, id) AS upto FROM rec), s AS (SELECT max(upto) AS total, count(*) AS n FROM z), g AS (SELECT CASE WHEN (SELECT total FROM s) <= {QUOTA} THEN 0 ELSE least(coalesce((SELECT min(place) FROM z, s WHERE place % 1000 = 0 AND total - upto <= {QUOTA}), (SELECT n FROM s)), 8000, ((SELECT n FROM s) - 1) // 1000 * 1000) END AS gone)"


@log("k2_quota", f", {GONE} SELECT id, timestamp_ns FROM z, g WHERE place > gone")
def k2(spark, sf):
    return lifecycle.enforce_quota(log_tables(spark, sf)[0], QUOTA, batch=1000).select("id", "timestamp_ns")


@log("k2_quota_stored", f", {GONE}, x AS (SELECT * FROM z, g WHERE place > gone) SELECT 'deleted' AS name, CAST(gone AS BIGINT) AS n FROM g UNION ALL SELECT 'kept', (SELECT count(*) FROM x) UNION ALL SELECT 'resources', (SELECT count(DISTINCT resource_id) FROM rec JOIN x USING (id))")
def k2_stored(spark, sf):
    """The quota as a delete of stored tables."""
    return _stored(spark, sf, lambda tables, schema, own: tables.enforce_quota(QUOTA, schema, own, batch=1000))


POINTS = "p AS (SELECT l_orderkey * 10 + l_linenumber AS point, l_partkey AS series_id, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400000000000 AS t FROM lineitem)"


@query("k9_purge_points", f"WITH {POINTS}, k AS (SELECT * FROM p WHERE t >= 883612800000000000 - 31536000000000000 * 2) SELECT 'points' AS name, count(*) AS n FROM k UNION ALL SELECT 'series', count(DISTINCT series_id) FROM k WHERE series_id IN (SELECT p_partkey FROM part)")
def k9(spark, sf):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    points = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("series_id"), (day * 86_400_000_000_000).alias("time_unix_nano"))
    kept, series = lifecycle.purge_points(points, table(spark, sf, "part").select(F.col("p_partkey").alias("series_id")), 883_612_800_000_000_000, 2 * 31_536_000_000_000_000)
    return lifecycle.row_counts({"points": kept, "series": series})


EVENT = ["id", "resource_id", "timestamp_ns", "observed_timestamp_ns", "severity_number", "severity_text", "trace_id", "span_id", "body", "event_name", "flags", "dropped_attributes_count", "scope_name", "scope_version", "attributes_json", "scope_attributes_json", "scope_schema_url"]
ROW = ["id", "service_name", "host_name", "schema_url", "attributes_json"]


def _sum(name: str, source: str, columns: list[str]) -> str:
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in sorted(columns))
    return f"SELECT '{name}' AS name, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5({text}), 1, 15) AS HUGEINT)) AS VARCHAR) AS checksum FROM {source}"


@log("k5_verify", f"{_sum('log_event', 'rec', EVENT)} UNION ALL {_sum('log_resource', 'res', ROW)}")
def k5(spark, sf):
    events, resources = log_tables(spark, sf)
    tables = {"log_event": events.select(*EVENT), "log_resource": resources.select(*ROW)}
    out = [lifecycle.checksum(df).select(F.lit(name).alias("name"), "rows", "checksum") for name, df in tables.items()]
    return out[0].unionByName(out[1])
