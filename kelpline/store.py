"""Tables that Spark has derived from given ones, kept in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only with a local master and without that setting, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kelpline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows and bytes of a batch that goes to a Python worker, at most. Whole texts and request lines make rows large.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of few rows bound what tasks hold of texts, in the JVM and in Python."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(name).rstrip("bB")) <= most:
            spark.conf.set(name, str(most))


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _files(spark, path)
    return system.exists(at)


def version(spark: SparkSession, path: str) -> str:
    """What changes when the files below a path do: their names, lengths and times."""
    system, at = _files(spark, path)
    found, seen = system.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def derived(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> DataFrame:
    """The table ``name`` derived from the files below ``source``; ``build`` writes it to a path if it isn't there yet."""
    path = f"{shared_dir(spark)}/derived/{name}-{CODE}-{version(spark, source)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        # built under a name of its own: of two jobs that build at once, the first one to rename wins
        own = f"{path}.{uuid.uuid4().hex}"
        build(own)
        system, at = _files(spark, own)
        system.mkdirs(_files(spark, path)[1].getParent())
        if not exists(spark, path):
            system.rename(at, _files(spark, path)[1])
        if exists(spark, own):
            system.delete(at, True)
        lost = f"{path}/{own.rpartition('/')[2]}"  # where a rename lands if another job's folder was there just before it
        if exists(spark, lost):
            system.delete(_files(spark, lost)[1], True)
    return spark.read.parquet(path)


def _code() -> str:
    """What changes when the library's code does: a changed mapping doesn't read an old table."""
    own = Path(__file__).resolve().parent
    names = sorted(p for d in ("functions", "operators", "sources", "plans") for p in (own / d).glob("*.py"))
    return hashlib.sha256(b"\n".join(p.read_bytes() for p in names)).hexdigest()[:12] if names else "packed"


CODE = _code()
