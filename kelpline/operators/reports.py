"""Reconciliation, latency, health and window reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals, prefix


def duplicates(found: DataFrame, column: str = "v") -> DataFrame:
    """rows minus distinct values."""
    return found.agg((F.count(column) - F.countDistinct(column)).alias("duplicates"))


def expected_persisted(generated: int, rejected: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """[1, generated] without the rejected and the ambiguous intervals."""
    everything = rejected.sparkSession.createDataFrame([(1, generated)], "start long, end long")
    return intervals.subtract(everything, rejected.select("start", "end").unionByName(ambiguous.select("start", "end")))


def correctness(found: DataFrame, generated: int, rejected: DataFrame, ambiguous: DataFrame, recovery: bool = False) -> DataFrame:
    """One row: missing, duplicate, unexpected, rejected_present, ambiguous_present, passed.

    found has a column v. In a recovery run, rows of rejected requests that were applied in part are tolerated.
    """
    everything = found.sparkSession.createDataFrame([(1, generated)], "start long, end long")
    open_ = intervals.length(intervals.subtract(everything, rejected.select("start", "end").unionByName(ambiguous.select("start", "end")))).select(F.col("total").alias("open"))
    # one sweep: at each value, how often it was found and what covers it
    zero = F.lit(0).cast("bigint")
    points = found.where("v IS NOT NULL").groupBy(F.col("v").cast("bigint").alias("at")).agg(F.count("*").alias("n")).select("at", zero.alias("a"), zero.alias("b"), "n")
    ends = intervals._steps(rejected, (), a=1, b=0).unionByName(intervals._steps(ambiguous, (), a=0, b=1)).withColumn("n", zero)
    rows = points.unionByName(ends).groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    seen = prefix.running(rows, (), "at", {"a": "sum", "b": "sum"}).where("n > 0")
    inside, some = F.col("at").between(1, generated), lambda t, name: F.count_if(t).alias(name)
    sums = seen.agg(some(inside & (F.col("a") == 0) & (F.col("b") == 0), "there"), (F.coalesce(F.sum("n"), zero) - F.count("*")).alias("duplicate"), some(~inside, "unexpected"), some(F.col("a") > 0, "rejected_present"), some(F.col("b") > 0, "ambiguous_present"))
    wide = sums.crossJoin(open_).select((F.col("open") - F.col("there")).alias("missing"), "duplicate", "unexpected", "rejected_present", "ambiguous_present")  # one row each
    fatal = ["missing", "duplicate", "unexpected"] + ([] if recovery else ["rejected_present"])
    ok = F.lit(True)
    for n in fatal:
        ok = ok & (F.col(n) == 0)
    return wide.withColumn("passed", ok)


def classify_outcome(status: Column, transport: Column, rejected: Column, records: Column) -> Column:
    """What became of a request: accepted, rejected, ambiguous or partial.

    An answer (status ok) tells how many records were rejected: none, all, or some, whose positions
    it doesn't say. Invalid argument and unavailable are the server's own verdicts and reject all,
    unless the transport made them up. Any other end (a timeout too) leaves open what was stored.
    """
    answer = F.when(F.coalesce(rejected, F.lit(0)) <= 0, "accepted").when(rejected >= records, "rejected").otherwise("partial")
    verdict = status.isin("invalid_argument", "unavailable") & ~F.coalesce(transport, F.lit(False))
    return F.when(status == "ok", answer).when(verdict, "rejected").otherwise("ambiguous")


def outcome_ledger(results: DataFrame) -> DataFrame:
    """Merged intervals of each class: class, start, end, positions_exact.

    A request that was rejected in part counts as ambiguous; one such makes the positions inexact.
    Requests without a class, start or end are left out.
    """
    exact = results.where(F.col("class") == "partial").isEmpty()
    rows = results.where("class IS NOT NULL").withColumn("class", F.when(F.col("class") == "partial", "ambiguous").otherwise(F.col("class")))
    return intervals.merge(rows, by=["class"]).withColumn("positions_exact", F.lit(exact))


def accounting(results: DataFrame) -> DataFrame:
    """generated, accepted, rejected, ambiguous and whether the classes add up and don't overlap."""
    size = F.col("end") - F.col("start") + 1
    sums = results.agg(F.coalesce(F.sum(size), F.lit(0)).alias("generated"), *[F.coalesce(F.sum(F.when(F.col("class") == k, size)), F.lit(0)).alias(k) for k in ("accepted", "rejected", "ambiguous")])
    covered = intervals.total(results.select("start", "end")).first()[0]
    return sums.withColumn("balanced", F.col("generated") == F.col("accepted") + F.col("rejected") + F.col("ambiguous")).withColumn("partitioned", F.col("generated") == F.lit(covered))


PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def latency_summary(samples: DataFrame, by: list[str], value: str, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """n, min, the percentiles and max of each group. Approximate percentiles merge across tasks; exact ones sort."""
    if exact:
        cells = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, p in PERCENTILES.items()]
        return samples.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), *cells, F.max(value).alias("max"))
    q = F.percentile_approx(value, F.array(*[F.lit(p) for p in PERCENTILES.values()]), F.lit(accuracy)).alias("q")
    got = samples.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), q, F.max(value).alias("max"))
    return got.select(*by, "n", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(PERCENTILES)], "max")


def health(samples: DataFrame, degraded_ms: int = 5_000, unhealthy_ms: int = 30_000, ack_stall_ms: int = 60_000, maintenance_ms: int = 900_000, pressure: float = 0.8) -> DataFrame:
    """Each sample with state (Healthy, Degraded, Unhealthy) and reason; the first rule that holds decides.

    During maintenance the writer rests by design: only its own bound makes it unhealthy. Outside of
    it, tickets that wait while nothing is pending and both stages rest are lost. A stage's age counts
    only while it has work. A queue is full from ``pressure`` of its capacity on (1 at least); without
    a capacity never.
    """
    c = F.col
    pending = c("queue_depth") + c("pending_records")
    share = min(max(pressure, 0.0), 1.0) if math.isfinite(pressure) else 1.0
    full = (c("queue_capacity") > 0) & (c("queue_depth") >= F.greatest(F.floor(c("queue_capacity") * share), F.lit(1)))
    waiting = (c("outstanding_tickets") > 0) & (c("watermark_idle_ms") >= ack_stall_ms)
    resting = (c("writer_idle_ms") >= ack_stall_ms) & (c("batcher_idle_ms") >= ack_stall_ms)
    age = F.greatest(F.when(c("queue_depth") > 0, c("writer_idle_ms")).otherwise(0), F.when(c("pending_records") > 0, c("batcher_idle_ms")).otherwise(0))
    upkeep = c("maintenance_in_progress")
    rules = [
        (~c("writer_running"), "Unhealthy", "writer not running"),
        (~c("batcher_running"), "Unhealthy", "batcher not running"),
        (upkeep & (c("maintenance_elapsed_ms") >= maintenance_ms), "Unhealthy", "maintenance stalled"),
        (upkeep & waiting, "Degraded", "maintenance ack stall"),
        (upkeep & full, "Degraded", "maintenance saturated"),
        (upkeep, "Healthy", "maintenance running"),
        (waiting & (pending == 0) & resting, "Unhealthy", "ack stall"),
        (pending == 0, "Healthy", "idle"),
        (age >= unhealthy_ms, "Unhealthy", "stalled"),
        (age >= degraded_ms, "Degraded", "draining"),
        (full, "Degraded", "saturated"),
    ]
    state, reason = F.lit("Healthy"), F.lit("progressing")
    for test, s, r in reversed(rules):
        state, reason = F.when(test, s).otherwise(state), F.when(test, r).otherwise(reason)
    return samples.withColumns({"state": state, "reason": reason})


def transitions(judged: DataFrame, by: str, at: str) -> DataFrame:
    """Samples whose state differs from the one before, for each ``by``; the first counts."""
    before = F.lag("state").over(W.partitionBy(by).orderBy(at))
    return judged.withColumn("previous", before).where(~F.col("state").eqNullSafe(F.col("previous")))


def counter_deltas(samples: DataFrame, by: list[str]) -> DataFrame:
    """last minus first value of each series and window, not below 0."""
    return samples.groupBy(*by).agg(F.greatest(F.max_by("value", "t") - F.min_by("value", "t"), F.lit(0.0)).alias("delta"))


def gauges(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(F.max_by("value", "t").alias("last"), F.greatest(F.max("value"), F.lit(0.0)).alias("peak"))


def prefix_sum(samples: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    return samples.where(F.col("series").startswith(prefix)).groupBy(*by).agg(F.sum("value").alias("total"))


def size_trajectory(samples: DataFrame, at: str, size: str) -> DataFrame:
    return samples.agg(F.min_by(size, at).alias("first"), F.max_by(size, at).alias("last"), F.max(size).alias("peak"))


def throughput(samples: DataFrame, by: list[str], at: str, n: Column) -> DataFrame:
    """rows and rows per second between the first and the last sample of each group."""
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    return samples.groupBy(*by).agg(F.sum(n).alias("n"), F.try_divide(F.sum(n), seconds).alias("per_second"))


def until_saturated(steps: DataFrame, limit: float = 0.05) -> DataFrame:
    """Steps up to the first whose share of rejected and ambiguous records exceeds the limit."""
    share = F.coalesce(F.try_divide(F.col("rejected") + F.col("ambiguous"), F.col("generated")), F.lit(0.0))
    marked = steps.withColumn("share", share).withColumn("saturated", F.col("share") > limit)
    first = marked.agg(F.min(F.when(F.col("saturated"), F.col("step")))).first()[0]
    return marked if first is None else marked.where(F.col("step") <= first)
