"""Streaming ingest: one micro-batch feeds the event, resource, postings and quarantine tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import store
from ..functions import mapping
from ..operators import identity, search, validation, versions
from ..sources import otlp_json
from ..sources.driver_tables import stored_records


#: Folders of a batch's new resources, by their ids.
RESOURCE_BUCKETS = 64


def write_batch(root: str, mode: str = "body") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Each batch writes below its own number, so a replay overwrites only itself.

    Client retries may repeat rows; they are kept, as no key tells a retry from a second event.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        healthy, poison, per_ticket = validation.salvage(rows)
        out = lambda name: f"{root}/{name}/batch={batch_id}"
        events = healthy.withColumn("event_date", mapping.event_date(F.col("timestamp_ns")))
        events.drop("service_name", "host_name", "schema_url", "resource_json").sortWithinPartitions("event_date", "resource_id", "timestamp_ns").write.mode("overwrite").partitionBy("event_date").parquet(out("log_event"))
        incoming = identity.resource_rows(healthy).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(RESOURCE_BUCKETS)).cast("int"))
        if store.exists(spark, f"{root}/log_resource"):
            # ids alone, of the buckets that this batch touches, are read again
            touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]  # RESOURCE_BUCKETS at most
            seen = spark.read.schema("id string, batch long, bucket int").parquet(f"{root}/log_resource").where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id))
            incoming = incoming.join(seen.select("bucket", "id"), ["bucket", "id"], "left_anti")
        incoming.write.mode("overwrite").partitionBy("bucket").parquet(out("log_resource"))
        search.postings(healthy, mode).write.mode("overwrite").parquet(out("postings"))
        poison.select("request_id", "ticket", "reason", "body_preview", "timestamp_ns").write.mode("overwrite").parquet(out("quarantine"))
        per_ticket.write.mode("overwrite").parquet(out("tickets"))
        rows.unpersist()

    return write


EVENT_ORDER = ["resource_id", "timestamp_ns"]


def write_versioned(tables: versions.Tables, stream: str, mode: str = "body") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts all tables of a batch under one version, each batch once.

    Readers see all of a batch or nothing of it, and a batch that is replayed adds nothing, whatever was
    purged or compacted in between. A purge that takes a resource away before the batch is put is seen:
    the batch then brings the resource again. ``stream`` names the query; it goes with its checkpoint.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        healthy, poison, per_ticket = validation.salvage(rows)
        events = healthy.withColumn("event_date", mapping.event_date(F.col("timestamp_ns"))).drop("service_name", "host_name", "schema_url", "resource_json")
        incoming = identity.resource_rows(healthy).withColumn("resource_bucket", F.pmod(F.xxhash64("id"), F.lit(RESOURCE_BUCKETS)).cast("int"))

        def new_resources(folders: list[versions.Folder]) -> DataFrame:
            touched = {str(r["resource_bucket"]) for r in incoming.select("resource_bucket").distinct().collect()}  # RESOURCE_BUCKETS at most
            seen = tables.read("log_resource", "id string, resource_bucket int", folders=[f for f in folders if f.part in touched])
            return incoming.join(seen, ["resource_bucket", "id"], "left_anti")

        new = {"log_event": events, "postings": search.postings(healthy, mode), "quarantine": poison.select("request_id", "ticket", "reason", "body_preview", "timestamp_ns"), "tickets": per_ticket}
        tables.append_batch(stream, batch_id, new, {"log_event": EVENT_ORDER, "log_resource": ["id"]}, "log_resource", new_resources)
        rows.unpersist()

    return write


def write_requests(root: str, mode: str = "body", limits: validation.Limits | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over lines (file, value) of one request each.

    Accepted requests go on as rows, with a ticket for each scope group. Requests that can't be read or
    break a bound go to rejected_requests, with their reasons; losses and counts go to tables of their
    own. In request_counts, lines = accepted + empty + rejected in each batch.
    """
    limits = limits or validation.Limits()
    rows_of = write_batch(root, mode)

    def write(lines: DataFrame, batch_id: int) -> None:
        parsed = otlp_json.parse_requests(otlp_json.numbered(lines)).persist()
        out = lambda name: f"{root}/{name}/batch={batch_id}"
        records = otlp_json.flatten(parsed).persist()
        violations = validation.request_violations(records, limits)
        rejected = validation.rejected_requests(parsed, violations).persist()
        rejected.write.mode("overwrite").parquet(out("rejected_requests"))
        accepted = validation.judge_records(records, violations).where("accepted").drop("accepted")
        named = accepted.withColumns({"id": F.xxhash64("request_id", "resource_idx", "scope_idx", "record_idx"), "ticket": F.xxhash64("request_id", "resource_idx", "scope_idx")})
        validation.mapping_losses(accepted).write.mode("overwrite").parquet(out("losses"))
        rows_of(stored_records(named), batch_id)
        counts = parsed.agg(F.count("*").alias("lines")).crossJoin(rejected.agg(F.count("*").alias("rejected"))).crossJoin(named.agg(F.countDistinct("request_id").alias("accepted"), F.count("*").alias("records")))  # three rows of one
        counts.select("lines", "accepted", "rejected", (F.col("lines") - F.col("accepted") - F.col("rejected")).alias("empty"), "records").write.mode("overwrite").parquet(out("request_counts"))
        for df in (rejected, records, parsed):
            df.unpersist()

    return write


def start_requests(lines: DataFrame, root: str, checkpoint: str, mode: str = "body", limits: validation.Limits | None = None) -> StreamingQuery:
    """Ingest the requests that are there of a stream of lines, then stop."""
    return lines.writeStream.foreachBatch(write_requests(root, mode, limits)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The name of the counters in a query's progress.
COUNTERS = "ingest"


def counted(rows: DataFrame, chunk_start: Column | None = None) -> DataFrame:
    """rows, with counters that Spark fills in while they pass: records, dropped (poison) and chunks (rows that begin one)."""
    return rows.observe(COUNTERS, F.count(F.lit(1)).alias("records"), F.count_if(validation.poison_reason().isNotNull()).alias("dropped"), F.count_if(chunk_start if chunk_start is not None else F.lit(False)).alias("chunks"))


def counters(query: StreamingQuery) -> dict[str, int]:
    """The counters of all batches that the query still tells of."""
    out: dict[str, int] = {}
    for p in query.recentProgress:
        row = p["observedMetrics"].get(COUNTERS)
        for name, n in (row.asDict() if row is not None else {}).items():
            out[name] = out.get(name, 0) + (n or 0)
    return out


def start(rows: DataFrame, root: str, checkpoint: str, mode: str = "body") -> StreamingQuery:
    """Ingest what is there, then stop; the checkpoint remembers what was committed."""
    return rows.writeStream.foreachBatch(write_batch(root, mode)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
