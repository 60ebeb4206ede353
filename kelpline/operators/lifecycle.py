"""Jobs on stored tables: retention, quota, compaction, verification, snapshots, schema evolution."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import mapping
from . import identity

BATCH = 5_000
QUOTA_ROUNDS = 8


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _since(events: DataFrame, cutoff: int) -> DataFrame:
    """Events from a time on; where they are stored by day, older days aren't read."""
    kept = events.where(F.col("timestamp_ns") >= cutoff)
    return kept.where(F.col("event_date") >= mapping.event_date(F.lit(cutoff))) if "event_date" in events.columns else kept


def purge(events: DataFrame, resources: DataFrame, now_ns: int, window_ns: int) -> tuple[DataFrame, DataFrame]:
    """Events within the window and the resources that they use. Strictly older events go.

    Resources are only cleaned when the purge deletes something; orphans from before stay otherwise.
    """
    cutoff = mapping.retention_cutoff(now_ns, window_ns)
    kept = _since(events, cutoff)
    if events.where(F.col("timestamp_ns") < cutoff).isEmpty():
        return kept, resources
    return kept, resources.join(kept.select(F.col("resource_id").alias("id")).distinct(), "id", "left_semi")


def purge_report(events: DataFrame, resources: DataFrame, now_ns: int, window_ns: int) -> DataFrame:
    """(name, n): what a purge deletes, keeps, and the resources that stay. Events are read once."""
    old = F.col("timestamp_ns") < mapping.retention_cutoff(now_ns, window_ns)
    per = events.groupBy("resource_id").agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))
    used = per.join(resources.select(F.col("id").alias("resource_id"), F.lit(1).alias("known")), "resource_id", "full")
    zero = F.lit(0)
    sums = used.agg(F.coalesce(F.sum("deleted"), zero).alias("deleted"), F.coalesce(F.sum("kept"), zero).alias("kept"), F.count_if((F.col("kept") > 0) & F.col("known").isNotNull()).alias("used"), F.count("known").alias("known"))
    one = lambda name, n: F.struct(F.lit(name).alias("name"), n.alias("n"))
    left = F.when(F.col("deleted") > 0, F.col("used")).otherwise(F.col("known"))
    return sums.select(F.explode(F.array(one("deleted", F.col("deleted")), one("kept", F.col("kept")), one("resources", left))).alias("r")).select("r.*")


def oldest(events: DataFrame, n: int) -> DataFrame:
    """The n oldest events by (timestamp_ns, id), where n is bounded.

    Numbers per day, then per second of the day in question, bound the times first, so that not much
    more than n rows are sorted.
    """
    def bound(rows: DataFrame, cell: Column, width: int) -> tuple[DataFrame, int | None]:
        sizes = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("c")).orderBy("cell").limit(100_000)
        seen = 0
        for r in sizes.toLocalIterator():
            seen += r["c"]
            if seen >= n:
                return rows.where(F.col("timestamp_ns") < (r["cell"] + 1) * width), r["cell"]
        return rows, None

    floor = lambda width: ((F.col("timestamp_ns") - F.pmod("timestamp_ns", F.lit(width))) / width).cast("bigint")
    day, second = 86_400_000_000_000, 1_000_000_000
    rows, last = bound(events, floor(day), day)
    if last is not None:
        if "event_date" in events.columns:
            rows = rows.where(F.col("event_date") <= mapping.event_date(F.lit(last * day)))
        before = rows.where(F.col("timestamp_ns") < last * day).count()
        inside, left = rows.where(F.col("timestamp_ns") >= last * day), n - before
        seen, cells = 0, inside.groupBy(floor(second).alias("cell")).agg(F.count("*").alias("c")).orderBy("cell")
        for r in cells.toLocalIterator():
            seen += r["c"]
            if seen >= left:
                rows = rows.where(F.col("timestamp_ns") < (r["cell"] + 1) * second)
                break
    return rows.orderBy("timestamp_ns", "id").limit(n)


def quota_cut(events: DataFrame, quota_bytes: int, batch: int = BATCH, rounds: int = QUOTA_ROUNDS) -> tuple[int, int] | None:
    """(timestamp_ns, id) of the last event that a quota lets go; None if none goes.

    The oldest go in whole batches until the rest fits, in at most ``rounds`` batches. The newest batch
    always stays, even where the quota can't be met. Only the oldest ``rounds`` * ``batch`` events are
    ever ordered.
    """
    size = F.coalesce(F.octet_length("body"), F.lit(0)) + F.octet_length("attributes_json")
    total = events.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    most = min(rounds * batch, (total["n"] - 1) // batch * batch) if total["n"] else 0
    if total["b"] <= quota_bytes or most <= 0:
        return None
    w = W.orderBy("timestamp_ns", "id")  # over at most rounds * batch rows
    placed = oldest(events.select(*{"timestamp_ns", "id", *(["event_date"] if "event_date" in events.columns else [])}, size.cast("bigint").alias("bytes")), most)
    placed = placed.select("timestamp_ns", "id", F.row_number().over(w).alias("place"), F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    ends = placed.where(F.col("place") % batch == 0).orderBy("place").collect()  # one row for each batch
    last = next((r for r in ends if total["b"] - r["upto"] <= quota_bytes), ends[-1])
    return last["timestamp_ns"], last["id"]


def enforce_quota(events: DataFrame, quota_bytes: int, batch: int = BATCH, rounds: int = QUOTA_ROUNDS) -> DataFrame:
    """The events that stay: those after ``quota_cut``, by a plain filter."""
    cut = quota_cut(events, quota_bytes, batch, rounds)
    if cut is None:
        return events
    t = F.col("timestamp_ns")
    return _since(events, cut[0]).where((t > cut[0]) | ((t == cut[0]) & (F.col("id") > cut[1])))


def drop_signal(spark: SparkSession, root: str, tables: tuple[str, ...] = ("metric_data_point", "metric_series", "metric", "scope")) -> list[str]:
    """Remove an older signal's stored tables, children before parents; the names of those that were there. Log tables aren't touched."""
    gone = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(name)
    return gone


def purge_points(points: DataFrame, series: DataFrame, now_ns: int, window_ns: int) -> tuple[DataFrame, DataFrame]:
    """Metric points within the window (time_unix_nano), and the series that still have one."""
    kept = points.where(F.col("time_unix_nano") >= mapping.retention_cutoff(now_ns, window_ns))
    return kept, series.join(kept.select("series_id").distinct(), "series_id", "left_semi")


def checksum(df: DataFrame) -> DataFrame:
    """rows and an order-independent content checksum: the sum of 60 bits of each row's MD5, taken over its columns by name."""
    cells = [F.lower(F.hex(c)) if kind == "binary" else F.col(c).cast("string") for c, kind in sorted(df.dtypes)]
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in cells])
    h = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def verify(events: DataFrame, resources: DataFrame, version: str) -> dict:
    """ok, foreign-key violations, version, and counts and checksums of both tables."""
    violations = identity.foreign_key_violations(events, resources).count()
    sums = {name: checksum(df).first().asDict() for name, df in (("log_event", events), ("log_resource", resources))}
    return {"ok": violations == 0, "violations": violations, "version": version, "tables": sums}


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables and a manifest into a new folder below root; returns the folder."""
    at = f"{root}/snapshot-{uuid.uuid4().hex}"
    rows = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{at}/{name}")
        r = checksum(spark.read.parquet(f"{at}/{name}")).first()
        rows.append((name, r["rows"], r["checksum"]))
    spark.createDataFrame(rows, "name string, rows long, checksum string").write.json(f"{at}/manifest")
    return at


def restore(spark: SparkSession, at: str, target: str) -> dict[str, DataFrame]:
    """Copy a snapshot into an empty target, comparing counts and checksums before and after."""
    out = {}
    for m in spark.read.schema("name string, rows long, checksum string").json(f"{at}/manifest").collect():
        source = spark.read.parquet(f"{at}/{m['name']}")
        for df in (source, None):
            if df is None:
                source.write.mode("errorifexists").parquet(f"{target}/{m['name']}")
                df = out[m["name"]] = spark.read.parquet(f"{target}/{m['name']}")
            r = checksum(df).first()
            if (r["rows"], r["checksum"]) != (m["rows"], m["checksum"]):
                raise ValueError(f"{m['name']} differs from the manifest")
    return out


def compact(spark: SparkSession, source: str, target: str, files: int, order: list[str]) -> DataFrame:
    """Rewrite a table into ``files`` files, ranged and sorted by ``order``."""
    spark.read.parquet(source).repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def prunable_snapshots(catalogue: DataFrame, keep: int) -> DataFrame:
    """Snapshots beyond the newest ``keep`` by (mtime, path), both descending; 0 keeps all. Transient names don't count."""
    real = catalogue.where(~F.col("name").rlike(r"\.(tmp|partial)$") & F.col("name").startswith("snapshot-"))
    if keep == 0:
        return real.limit(0)
    newest = real.orderBy(F.desc("mtime"), F.desc("path")).limit(keep)
    return real.join(newest, ["name", "path", "mtime"], "left_anti")


def latest_version(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.max("version").alias("version"))


def schema_status(known: DataFrame, applied: DataFrame) -> DataFrame:
    """(version, status): applied, pending, or newer than what is known."""
    both = known.select("version", F.lit(True).alias("k")).join(applied.select("version", F.lit(True).alias("a")), "version", "full")
    return both.select("version", F.when(F.col("a").isNull(), "pending").when(F.col("k").isNull(), "newer").otherwise("applied").alias("status"))


def with_scope_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows beside new ones: columns that old rows lack are null, and their scope JSON is {}."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("scope_attributes_json", F.coalesce("scope_attributes_json", F.lit("{}")))
