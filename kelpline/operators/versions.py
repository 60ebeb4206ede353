"""Several tables under one version: immutable files, named by manifests that are each put in one step.

A write makes new folders (``data/<table>/c=<commit>``, and days below it where a table has
event_date), then puts the next manifest, which names the folders of all tables. A reader keeps to one
manifest, so it sees all tables as of one commit, whatever is written meanwhile. Two writers that put
the same number: one wins, the other takes the winner's manifest and tries again; it gives up only if
folders that it replaces are gone. A snapshot is a file that names a version; it copies no data.
Folders that no manifest or snapshot names any more are removed by ``vacuum``.

A stream adds each of its batches once: the manifest that has a batch's folders has its number too, so a
batch that is replayed after a failure is known to be there. Tables with event_date have a folder for each
day, those with resource_bucket one for each bucket.

A manifest has an entry for each commit and day, so compaction, which joins a day's commits, bounds it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mapping
from . import lifecycle

DAY, BUCKET = "event_date", "resource_bucket"
#: The name in manifests under which the last batch of each stream stands.
STREAMS = "_streams"


class Conflict(RuntimeError):
    """Folders that a commit replaces were replaced by another."""


@dataclass(frozen=True)
class Folder:
    """What one commit wrote of one table (of one day): the path below data/<table>, its files, bytes, and the number of its commit."""

    table: str
    path: str
    files: int
    bytes: int
    seq: int = 0

    @property
    def part(self) -> str | None:
        """The day or bucket of a table that has them."""
        name, _, value = self.path.partition("/")[2].partition("=")
        return value if name in (DAY, BUCKET) else None

    @property
    def day(self) -> str | None:
        return self.part if self.path.partition("/")[2].startswith(f"{DAY}=") else None


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.system = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def version(self) -> int:
        """The number of the latest manifest; 0 before the first."""
        at = self._path(f"{self.root}/manifests")
        if not self.system.exists(at):
            return 0
        return max([int(f.getPath().getName()[:-5]) for f in self.system.listStatus(at) if f.getPath().getName().endswith(".json")], default=0)

    def folders(self, version: int | None = None) -> list[Folder]:
        version = self.version() if version is None else version
        return [Folder(**x) for x in json.loads(self._read(f"manifests/{version:012d}.json"))] if version else []

    def _read(self, name: str) -> str:
        stream = self.system.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put_once(self, name: str, text: str) -> bool:
        """Put a whole file in one step; False if it is there already."""
        at, own = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/tmp-{uuid.uuid4().hex}")
        self.system.mkdirs(at.getParent())
        out = self.system.create(own, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self.system.getUri().getScheme() == "file":  # a rename would overwrite; a link doesn't
                nio = jvm.java.nio.file
                local = lambda p: nio.Path.of(self.system.makeQualified(p).toUri())
                nio.Files.createLink(local(at), local(own))
                return True
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, at, self._no_options())
            return True
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        finally:
            if self.system.exists(own):
                self.system.delete(own, False)

    def _no_options(self):
        return self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _commit(self, add: list[Folder], remove: list[Folder], unchanged: tuple[str, list[Folder]] | None = None) -> int:
        """The next version. unchanged: a table and what it must consist of, as what is added was computed from it."""
        while True:
            version = self.version()
            now = self.folders(version)
            if not set(remove) <= set(now):
                raise Conflict(f"version {version} has other folders than those to be replaced")
            if unchanged and {f for f in now if f.table == unchanged[0]} != set(unchanged[1]):
                raise Conflict(f"{unchanged[0]} has changed before version {version + 1}")
            gone = set(remove)
            kept = [f for f in now if f not in gone]
            # a folder that replaces others stands for the latest of them, a new one for this commit
            new = [f if f.seq else Folder(**(asdict(f) | {"seq": version + 1})) for f in add]
            if self._put_once(f"manifests/{version + 1:012d}.json", json.dumps([asdict(f) for f in [*kept, *new]])):
                return version + 1

    # reading

    def read(self, table: str, schema: str, version: int | None = None, folders: list[Folder] | None = None) -> DataFrame:
        """A table as of a version (the latest), or some of its folders. schema: of its files; days come as event_date."""
        own = [f for f in (self.folders(version) if folders is None else folders) if f.table == table]
        if not own:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/data/{table}"
        rows = self.spark.read.option("basePath", base).schema(f"{schema}, c string").parquet(*[f"{base}/{f.path}" for f in own])
        return rows.drop("c")

    # writing

    def _write(self, table: str, df: DataFrame, order: list[str], files: int | None = None, seq: int = 0) -> list[Folder]:
        """New folders of a table, sorted by ``order`` within files; by day or bucket if the rows have one."""
        commit = f"c={uuid.uuid4().hex}"
        at = f"{self.root}/data/{table}/{commit}"
        by = [c for c in (DAY, BUCKET) if c in df.columns][:1]
        if files is not None:
            df = df.repartitionByRange(files, *order) if order else df.repartition(files)
        elif by:
            df = df.hint("rebalance", *by)
        df = df.sortWithinPartitions(*by, *order) if order or by else df
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*by) if by else writer).parquet(at)
        found, sizes = self.system.listFiles(self._path(at), True), {}
        while found.hasNext():
            f = found.next()
            if f.getPath().getName().endswith(".parquet"):
                parent = f.getPath().getParent().toString()
                path = commit + parent.partition(commit)[2]
                n, size = sizes.get(path, (0, 0))
                sizes[path] = n + 1, size + f.getLen()
        return [Folder(table, path, n, size, seq) for path, (n, size) in sorted(sizes.items())]

    def append(self, tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None) -> int:
        """Add rows to several tables at once; the new version."""
        add = [f for name, df in tables.items() for f in self._write(name, df, (order or {}).get(name, []))]
        return self._commit(add, [])

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that is there; -1 before the first."""
        return max([int(f.path.rpartition("/")[2]) for f in self.folders() if f.table == STREAMS and f.path.rpartition("/")[0] == stream], default=-1)

    def append_batch(self, stream: str, batch: int, tables: dict[str, DataFrame], order: dict[str, list[str]], upsert: str, new_rows: Callable[[list[Folder]], DataFrame]) -> bool:
        """Add a batch of a stream to several tables at once; False if it is there already.

        ``new_rows`` tells what to add to the table ``upsert``, given its folders; it is asked again if
        that table changes before the batch is put.
        """
        if self.last_batch(stream) >= batch:
            return False
        written = [f for name, df in tables.items() for f in self._write(name, df, order.get(name, []))]
        while self.last_batch(stream) < batch:
            now = self.folders()
            own = [f for f in now if f.table == upsert]
            before = [f for f in now if f.table == STREAMS and f.path.rpartition("/")[0] == stream]
            add = self._write(upsert, new_rows(own), order.get(upsert, []))
            try:
                self._commit([*written, *add, Folder(STREAMS, f"{stream}/{batch}", 0, 0)], before, (upsert, own))
                return True
            except Conflict:
                continue
        return False  # another run of the stream was faster

    def delete_through(self, table: str, schema: str, timestamp_ns: int, id_: int | None = None, order: tuple[str, ...] = ("resource_id", "timestamp_ns")) -> int:
        """Delete what lies before a time, and at the time the ids up to ``id_``; how many rows went.

        Whole days go as entries of the manifest, without being read but for their numbers of rows; only
        the border day is written anew, and all folders of later days stay as they are. A repeated call
        finds nothing to do. schema: with event_date date.
        """
        while True:
            add, remove, n = self._without_through([f for f in self.folders() if f.table == table], table, schema, timestamp_ns, id_, order)
            if not n:
                return 0
            try:
                self._commit(add, remove)
            except Conflict:
                continue
            return n

    def _without_through(self, own: list[Folder], table: str, schema: str, timestamp_ns: int, id_: int | None, order: tuple[str, ...]) -> tuple[list[Folder], list[Folder], int]:
        """Folders to add and to remove for ``delete_through``, and how many rows go."""
        border = self.spark.range(1).select(mapping.event_date(F.lit(timestamp_ns)).cast("string")).first()[0]
        old, edge = [f for f in own if f.day < border], [f for f in own if f.day == border]
        t = F.col("timestamp_ns")
        gone: Column = (t < timestamp_ns) if id_ is None else (t < timestamp_ns) | ((t == timestamp_ns) & (F.col("id") <= id_))
        rows = self.read(table, schema, folders=edge) if edge else None
        n = rows.where(gone).count() if edge else 0
        edge = edge if n else []
        whole = self.read(table, schema, folders=old).count() if old else 0
        add = self._write(table, rows.where(~gone), list(order), seq=max(f.seq for f in edge)) if edge else []
        return add, [*old, *edge], whole + n

    def replace(self, table: str, df: DataFrame, version: int, order: list[str] | None = None) -> int:
        """All of a table anew, as computed from ``version``; a Conflict if the table has changed since."""
        before = [f for f in self.folders(version) if f.table == table]
        if set(before) != {f for f in self.folders() if f.table == table}:
            raise Conflict(f"{table} has changed since version {version}")
        return self._commit(self._write(table, df, order or []), before)

    def purge(self, now_ns: int, window_ns: int, schema: str, resource_schema: str, tries: int = 5) -> dict[str, int]:
        """Retention: events older than the window go, and if any go, resources without events, in one version."""
        return self._evict(mapping.retention_cutoff(now_ns, window_ns), None, schema, resource_schema, tries)

    def enforce_quota(self, quota_bytes: int, schema: str, resource_schema: str, batch: int = lifecycle.BATCH, rounds: int = lifecycle.QUOTA_ROUNDS, tries: int = 5) -> dict[str, int]:
        """Quota: the oldest events go as ``lifecycle.quota_cut`` says, and with them resources without events, in one version.

        What arrives meanwhile and is older than the last event to go, goes too.
        """
        cut = lifecycle.quota_cut(self.read("log_event", schema), quota_bytes, batch, rounds)
        return self._evict(*cut, schema, resource_schema, tries) if cut else {"deleted": 0, "orphans": 0}

    def _evict(self, timestamp_ns: int, id_: int | None, schema: str, resource_schema: str, tries: int, order: tuple[str, ...] = ("resource_id", "timestamp_ns")) -> dict[str, int]:
        """``delete_through`` for log_event, and resources without events go too if any went.

        An event that arrives meanwhile may use a resource that was to go, so the resources are then looked
        at anew. After ``tries`` such times only events go; the resources wait for the next call that
        deletes something.
        """
        for _ in range(tries):
            now = self.folders()
            before = [f for f in now if f.table == "log_event"]
            add, remove, deleted = self._without_through(before, "log_event", schema, timestamp_ns, id_, order)
            if not deleted:
                return {"deleted": 0, "orphans": 0}
            left = [f for f in before if f not in set(remove)] + add
            used = self.read("log_event", schema, folders=left).select(F.col("resource_id").alias("id")).distinct()  # a resource may have most events
            resources = self.read("log_resource", resource_schema, folders=now)
            orphans = resources.join(used, "id", "left_anti").count()
            if orphans:
                remove = [*remove, *(f for f in now if f.table == "log_resource")]
                add = [*add, *self._write("log_resource", resources.join(used, "id", "left_semi"), [])]
            try:
                self._commit(add, remove, ("log_event", before) if orphans else None)
            except Conflict:
                continue
            return {"deleted": deleted, "orphans": orphans}
        return {"deleted": self.delete_through("log_event", schema, timestamp_ns, id_, order), "orphans": 0}

    def compact(self, table: str, schema: str, target_bytes: int = 256 << 20, order: tuple[str, ...] = ("resource_id", "timestamp_ns")) -> list[str]:
        """Join small files, day by day or bucket by bucket (or the table, where it has neither); those that were written anew.

        Folders of a day are packed into bins: those whose files have less than half of the target on
        average, if that makes fewer files. Other days, and folders of large files, aren't read.
        """
        done = []
        own = [f for f in self.folders() if f.table == table]
        for day in sorted({f.part or "" for f in own}):
            small = [f for f in own if (f.part or "") == day and f.bytes < f.files * target_bytes / 2]
            files = max(1, -(-sum(f.bytes for f in small) // target_bytes))
            if sum(f.files for f in small) <= files:
                continue
            add = self._write(table, self.read(table, schema, folders=small), list(order), files, max(f.seq for f in small))
            try:
                self._commit(add, small)
                done.append(day)
            except Conflict:  # a purge was faster: the next run sees what is left
                continue
        return done

    # snapshots

    def snapshot(self, name: str) -> int:
        """Name the latest version; False names are refused twice."""
        version = self.version()
        if not self._put_once(f"snapshots/{name}.json", json.dumps({"version": version})):
            raise ValueError(f"{name} is there already")
        return version

    def snapshots(self) -> dict[str, int]:
        at = self._path(f"{self.root}/snapshots")
        names = [f.getPath().getName()[:-5] for f in self.system.listStatus(at)] if self.system.exists(at) else []
        return {n: json.loads(self._read(f"snapshots/{n}.json"))["version"] for n in names}

    def restore(self, name: str) -> int:
        """A new version with the folders of a snapshot; no data is copied."""
        wanted = self.folders(self.snapshots()[name])
        while True:
            version = self.version()
            if self._put_once(f"manifests/{version + 1:012d}.json", json.dumps([asdict(f) for f in wanted])):
                return version + 1

    def vacuum(self, keep: int = 10) -> list[str]:
        """Remove the folders that neither the last ``keep`` versions nor a snapshot name; the folders that went.

        Call it only when no write is under way that began before the oldest version kept.
        """
        last = self.version()
        versions = {*range(max(1, last - keep + 1), last + 1), *self.snapshots().values()}
        used = {(f.table, f.path.partition("/")[0], f.path) for v in versions if v for f in self.folders(v)}
        gone = []
        data = self._path(f"{self.root}/data")
        for t in self.system.listStatus(data) if self.system.exists(data) else []:
            for c in self.system.listStatus(t.getPath()):
                table, commit = t.getPath().getName(), c.getPath().getName()
                if not any(x[:2] == (table, commit) for x in used):
                    self.system.delete(c.getPath(), True)
                    gone.append(f"{table}/{commit}")
                    continue
                for d in self.system.listStatus(c.getPath()):
                    if d.isDirectory() and (table, commit, f"{commit}/{d.getPath().getName()}") not in used:
                        self.system.delete(d.getPath(), True)
                        gone.append(f"{table}/{commit}/{d.getPath().getName()}")
        return gone
