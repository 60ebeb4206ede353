"""WARC archives as a PySpark data source, and deduplicated crawl archives over it.

``WarcDataSource`` (format name "warc") reads standard archives: ``.warc.gz``, with a gzip member for
each record or several records in one, and plain ``.warc``. It plans a partition for each file, and for each byte range of a
large compressed one. It takes filters on header columns (equality and IN) down to the reader: a task
first parses a record's headers, and a record that the filters exclude, or whose payload column isn't
asked for (option payload=false), is passed over without its payload being decoded: by its length in
a plain file, by the member's length in a compressed one if its writer left the skip-lengths field
("sl") of the format, else by inflating to nowhere. The payload of a record with an HTTP message is
the message's body; full_length is the length that its HTTP header tells, so a revisit, which has no
body, still tells that of the page it stands for.

The writer makes such archives: a member for each record, skip-lengths, HTTP headers, base-32
digests, revisits that name the profile and the record that they refer to. In URIs, white space is
percent-escaped. Paths go through Arrow's file systems, so any store that they know can hold the
archives.

Defined results: every row of pages gives one record, a null page_id too (its record names none) and
each of several equal rows; a null html is an empty payload, a null url an empty URI. Of equal
payloads of LEAST_SHARED bytes or more, one row with the largest page_id (nulls are least) is stored.
An empty table gives an archive without records. Extra columns don't matter.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .store import Scratch

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, full_length long, content_length long, payload binary"
#: Column -> header. Filters on these are taken. Digests are given as bare hex.
HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Fixed values of the format: the profile of revisits, and the mark of skip-lengths in a gzip header.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIP = b"sl"
#: A byte range of a large archive that one task reads; bytes that are read at once.
RANGE, CHUNK = 64 << 20, 1 << 16
LEAST_SHARED = 1000


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def member(data: bytes) -> bytes:
    """One gzip member with skip-lengths: its own size, and that of what it holds (0 where they don't fit)."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 24 + len(body) + 8
    lengths = struct.pack("<II", size, len(data)) if max(size, len(data)) < 1 << 32 else bytes(8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + SKIP + struct.pack("<H", 8) + lengths + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """A header's value must not break the line."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n\t " else c for c in value)


def record(values: dict[str, str | None], full_length: int, payload: bytes) -> bytes:
    """A record as it stands in a plain archive: WARC headers, then an HTTP message."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_length}\r\n\r\n".encode()
    head = {HEADERS[c]: _clean(v) for c, v in values.items() if v is not None}
    if values.get("payload_digest"):
        head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(values["payload_digest"])).decode()
    if values.get("warc_type") == "revisit":
        head["WARC-Profile"] = PROFILE
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(payload))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + http + payload + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name, after the first line; a line that starts with white space goes on the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _hex_digest(value: str | None) -> str | None:
    """The digest without its label; 32 characters are base 32."""
    if not value:
        return None
    text = value.rpartition(":")[2]
    if len(text) == 32:
        try:
            return base64.b32decode(text.upper()).hex()
        except ValueError:
            return text
    return text.lower()


class _Member:
    """A gzip member that is inflated as far as it is asked for. It may hold several records, one after another."""

    def __init__(self, f, at: int):
        self.f, self.start, self.at, self.data, self.zip = f, at, at, b"", zlib.decompressobj(31)
        self.size = self.inflated = self.length = self.passed = 0
        f.seek(at)
        lead = f.read(24)
        if len(lead) == 24 and lead[3] & 4 and lead[12:14] == SKIP:
            self.size, self.inflated = struct.unpack("<II", lead[16:24])

    def _more(self) -> bytes:
        self.f.seek(self.at)
        raw = self.f.read(CHUNK)
        if not raw:
            return b""
        out = self.zip.decompress(raw)
        self.at += len(raw) - len(self.zip.unused_data)
        return out

    def upto(self, n: int) -> bytes:
        """The first n bytes, or all there are."""
        while len(self.data) < n and not self.zip.eof:
            before = self.at
            self.data += self._more()
            if self.at == before and not self.zip.eof:
                break
        return self.data

    def another(self) -> bool:
        """Pass over the record (``length`` bytes) and the blank lines after it, without holding it; whether the member goes on."""
        if self.size and self.passed + self.length <= self.inflated <= self.passed + self.length + 4:
            return False  # as the skip-lengths tell, without inflating
        self.passed += self.length
        left = self.length
        while left or not self.data:
            step = min(left, len(self.data))
            self.data, left = self.data[step:], left - step
            if not left:
                rest = self.data.lstrip(b"\r\n")
                self.passed, self.data = self.passed + len(self.data) - len(rest), rest
            if not self.data:
                before = self.at
                if self.zip.eof or not (more := self._more()) and self.at == before:
                    return False
                self.data = more
        return True

    def end(self) -> int:
        """Where the next member begins."""
        if self.size:
            return self.start + self.size
        while not self.zip.eof:
            before = self.at
            self._more()
            if self.at == before:
                break
        return self.at


class _Plain:
    """A record in a plain file."""

    def __init__(self, f, at: int):
        self.f, self.start, self.data, self.length = f, at, b"", 0
        f.seek(at)

    def upto(self, n: int) -> bytes:
        while len(self.data) < n:
            self.f.seek(self.start + len(self.data))  # others move the handle too
            raw = self.f.read(max(CHUNK, n - len(self.data)) if n < 1 << 40 else CHUNK)
            if not raw:
                break
            self.data += raw
        return self.data

    def another(self) -> bool:
        return False

    def end(self) -> int:
        return self.start + self.length


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.decode = options["path"], options.get("payload", "true").lower() != "false"
        self.range = int(options.get("rangebytes", RANGE))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value}
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = set(f.value)
            else:
                yield f
                continue
            have = self.wanted.get(f.attribute[0])
            self.wanted[f.attribute[0]] = values if have is None else have & values

    def partitions(self) -> list[ArchiveRange]:
        system, path = _system(self.path)
        at = system.get_file_info(path)
        found = [at] if at.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.is_file and f.base_name.endswith((".warc.gz", ".warc")) and not f.base_name.startswith(".")]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            step = self.range if f.path.endswith(".gz") else max(1, f.size)
            out += [ArchiveRange(f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
        return out or [ArchiveRange("", 0, 0)]

    def read(self, part: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = _system(self.path)
        schema = _arrow_schema()
        rows: list[tuple] = []
        held = 0
        with system.open_input_file(part.path) as f:
            size, zipped = f.size(), part.path.endswith(".gz")
            at = _sync(f, part.start, size) if part.start else 0
            while at < min(part.stop, size):
                item = _Member(f, at) if zipped else _Plain(f, at)
                more = True
                while more:
                    row, more = self._record(item)
                    if row:
                        rows.append(row)
                        held += len(row[-1] or b"") + 300
                        if held > 8 << 20:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                    more = more and item.another()
                after = item.end()
                if after <= at:
                    break
                at = after
        if rows:
            yield _batch(rows, schema)

    def _record(self, item) -> tuple[tuple | None, bool]:
        """A record's row, if it is wanted, and whether there was a record at all."""
        cut, n = _headers_end(item, 0)
        lead = item.upto(n)[:cut]
        if not lead.lstrip().startswith(b"WARC/"):
            item.length = n
            return None, False
        head = _fields(lead.lstrip())
        length = int(head.get("content-length", 0))
        item.length = cut + length
        if isinstance(item, _Plain):  # the blank lines after the block
            tail = item.upto(cut + length + 4)[cut + length :] if length < CHUNK else _tail(item)
            item.length += len(tail[:4]) - len(tail[:4].lstrip(b"\r\n"))
        values = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        values["payload_digest"] = _hex_digest(values["payload_digest"])
        if not all(values[c] in w for c, w in self.wanted.items()):
            return None, True
        body, full = cut, None
        if head.get("content-type", "").startswith("application/http"):
            end, n = _headers_end(item, cut, cut + length)
            told = _fields(item.upto(n)[cut:end]).get("content-length", "")
            body, full = end, int(told) if told.isdigit() else None
        full = cut + length - body if full is None else full
        payload = item.upto(cut + length)[body : cut + length] if self.decode else None
        return (*values.values(), full, length, payload), True


def _tail(item: _Plain) -> bytes:
    item.f.seek(item.start + item.length)
    return item.f.read(4)


def _headers_end(item, start: int, most: int = 1 << 24) -> tuple[int, int]:
    """Where the headers that begin at ``start`` end (their blank line included), and how much was read for that."""
    n = start + 512
    while True:
        data = item.upto(min(n, most))
        for mark in (b"\r\n\r\n", b"\n\n"):
            at = data.find(mark, start + (4 if start == 0 else 0), most)
            if at >= 0:
                return at + len(mark), at + len(mark)
        if len(data) < n:
            return min(len(data), most), len(data)
        n *= 2


def _sync(f, start: int, size: int) -> int:
    """The first member at or after ``start`` that holds a record."""
    at, mark = start, b"\x1f\x8b\x08"
    while at < size:
        f.seek(at)
        data = f.read(CHUNK + len(mark))
        k = data.find(mark)
        while 0 <= k < CHUNK:
            f.seek(at + k)
            try:
                if zlib.decompressobj(31).decompress(f.read(4096), 5) == b"WARC/":
                    return at + k
            except zlib.error:
                pass
            k = data.find(mark, k + 1)
        at += CHUNK
    return size


def _arrow_schema() -> pa.Schema:
    return pa.schema([(c, pa.string()) for c in HEADERS] + [("full_length", pa.int64()), ("content_length", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records


class WarcWriter(DataSourceArrowWriter):
    """Each task writes one file under a temporary name; the commit gives it its name."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = _system(self.path)
        system.create_dir(path, recursive=True)
        at, n = f"{path}/.{task.partitionId():05d}-{task.taskAttemptId()}.tmp", 0
        with system.open_output_stream(at) as out:
            for batch in iterator:
                for row in zip(*(batch.column(c) for c in [*HEADERS, "full_length", "payload"]), strict=True):
                    *values, full, payload = (v.as_py() for v in row)
                    body = payload or b""
                    out.write(member(record(dict(zip(HEADERS, values, strict=True)), len(body) if full is None else full, body)))
                    n += 1
        return Written(at, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                system.move(m.path, f"{folder}/part-{name[1:].removesuffix('.tmp')}.warc.gz")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class WarcDataSource(DataSource):
    """spark.read/df.write.format("warc"). Options: path (a folder or a file); payload (false skips payloads); rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_pages(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """Write a record per row of pages. Of equal payloads of LEAST_SHARED bytes or more, one is stored; the others revisit it.

    Payloads are told apart by SHA-1, SHA-256 and length. Only digests are compared across tasks;
    revisits are made from the table of digests alone. Payloads meet the few facts about their rows
    by page_id and digest, so a payload with many copies goes to many tasks.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    facts = [F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("check")]
    digests = scratch.table(rows.select(F.uuid().alias("u"), "page_id", "url", *facts), "digests")
    same = ["digest", "check", "size"]
    groups = scratch.table(digests.where(F.col("size") >= LEAST_SHARED).groupBy(*same).agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1"), "groups")
    chosen = digests.join(groups, same).where("page_id <=> first").groupBy(*same).agg(F.min("u").alias("chosen"), F.first("first").alias("first"), F.count("*").alias("k"))
    chosen = scratch.table(chosen, "chosen")

    name = lambda page, u: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), u, F.lit(">"))
    shape = lambda df, kind, ident, refers, payload: df.select(
        ident.alias("record_id"), F.lit(kind).alias("warc_type"), F.col("url").alias("target_uri"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.col("digest").alias("payload_digest"), refers.cast("string").alias("refers_to"), F.col("size").alias("full_length"), F.lit(None).cast("long").alias("content_length"), payload.cast("binary").alias("payload"),
    )
    marked = digests.join(chosen, same, "left")
    again = marked.where("chosen IS NOT NULL AND u <> chosen")
    revisits = shape(again, "revisit", name(F.col("page_id"), F.col("u")), name(F.col("first"), F.col("chosen")), F.lit(None))

    # what is stored, by page_id and digest: a row of a group that is the chosen one's, or of no group
    key = [F.coalesce("page_id", F.lit(0)).alias("p"), F.col("page_id").isNull().alias("none"), "digest"]
    stored = marked.where("chosen IS NULL OR u = chosen").groupBy(*key).agg(F.max("chosen").alias("chosen"), F.max("k").alias("k"))
    stored = scratch.table(stored, "stored")
    found = rows.select("*", *facts).withColumns({"p": F.coalesce("page_id", F.lit(0)), "none": F.col("page_id").isNull()}).join(stored, ["p", "none", "digest"])
    ident = name(F.col("page_id"), F.coalesce("chosen", F.uuid()))
    once = found.where("k IS NULL OR k = 1")
    if not stored.where("k > 1").isEmpty():  # rows that repeat both: one of them is stored
        once = once.unionByName(found.where("k > 1").dropDuplicates(["p", "none", "digest"]))
    responses = shape(once, "response", ident, F.lit(None), F.col("payload"))
    responses.unionByName(revisits).write.format("warc").mode("append").save(path)


def crawl_report(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder, read the archives back, and report each record.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Responses are read with their
    payloads, whose digest and length are taken anew; revisits are read by header only.
    """
    spark = pages.sparkSession
    register(spark)
    scratch = Scratch(spark, "warc")
    path = f"{scratch.at}/archives"
    archive_pages(pages, path, scratch)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1), F.lit("")).cast("long")
    whole = spark.read.format("warc").load(path).where("warc_type = 'response'")
    whole = whole.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    heads = spark.read.format("warc").option("payload", "false").load(path).where("warc_type = 'revisit'")
    heads = heads.select(number("record_id").alias("page_id"), F.col("full_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
    return whole.unionByName(heads)


#: DuckDB SQL for the contract's columns.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN payload_bytes >= {LEAST_SHARED} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_SHARED} AND first <> page_id THEN first END AS refers_to
FROM g
"""
