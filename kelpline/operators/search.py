"""Text search over postings: (term, id, column, pos), or blocks of them: (term, column, cell, n, docs, places)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.tokens import cut, cuttable, tokens
from . import prefix

FULL = ["body", "event_name", "severity_text", "attributes_json", "scope_name", "service_name"]
#: Buckets of terms of a stored index.
BUCKETS = 64
MODES = {"off": [], "body": ["body"], "full": FULL}


def postings(rows: DataFrame, mode: str) -> DataFrame:
    """One row per token of the mode's columns. Mode off gives an index that is there but empty.

    Body mode reads only the fact table; full mode needs the read view.
    """
    columns = MODES[mode]
    if not columns:
        return rows.select(F.lit("").alias("term"), "id", F.lit("").alias("column"), F.lit(0).alias("pos")).limit(0)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns])).alias("p")
    split = rows.select("id", parts).select("id", "p.column", F.posexplode(tokens(F.col("p.text"))).alias("pos", "term"))
    return split.select("term", "id", "column", "pos")


BLOCKS = "term string, column string, cell bigint, n int, docs int, places binary"
#: Ids are dealt to cells of 2**CELL_BITS; bytes of tokens that are put into blocks together, at least.
CELL_BITS, BLOCK_BYTES = 15, 1 << 23
#: A posting inside a block: its id's place in the cell, and its position.
PLACE = np.dtype([("id", "<u2"), ("pos", "<i4")])


def blocks(rows: DataFrame, mode: str) -> DataFrame:
    """The same postings, those of one term, column and cell of ids together for as many rows as have BLOCK_BYTES of them.

    Few rows are dealt and sorted in place of one for each token. A block tells how many postings and
    distinct ids it has; their places are packed, by id. An id may stand in several blocks.
    """
    columns = MODES[mode]
    if not columns:
        return rows.sparkSession.createDataFrame([], BLOCKS)
    store.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += sum(c.nbytes for c in batch.columns[1:])
            if n >= BLOCK_BYTES:
                yield from _blocks(held)
                held, n = [], 0
        if held:
            yield from _blocks(held)

    return rows.select(F.col("id").cast("bigint").alias("id"), *[cuttable(F.col(c)).alias(c) for c in columns]).mapInArrow(run, BLOCKS)


def _blocks(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (id, and its cuttable text by column). Postings without an id have no cell."""
    table = pa.Table.from_batches(batches)
    ids = pa.concat_arrays(table["id"].chunks)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    cell = np.where(known, (ids >> CELL_BITS) * 2, 1)  # an odd number: no cell
    within = np.where(known, ids & ((1 << CELL_BITS) - 1), 0)
    # rows are put in order of their ids, so that their tokens need to be sorted by the term only
    by_id = np.lexsort((within, cell))
    table, cell, within = table.take(pa.array(by_id)), cell[by_id], within[by_id]
    for name in table.column_names[1:]:
        row, pos, words = cut(pa.concat_arrays(table[name].chunks))
        if not len(words):
            continue
        words = words.dictionary_encode()
        term = words.indices.to_numpy()
        order = _order(term, len(words.dictionary))
        term, row = term[order], row[order]
        places = np.empty(len(order), PLACE)
        places["id"], places["pos"] = within[row], pos[order]
        of = cell[row]
        block = np.r_[True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])]
        new = block | np.r_[True, places["id"][1:] != places["id"][:-1]]
        first = np.flatnonzero(block)
        of = of[first]
        numbers = [np.diff(np.r_[first, len(row)]), np.where(of & 1, 0, np.add.reduceat(new.astype(np.int64), first))]
        yield _batch(BLOCKS, [words.dictionary.take(pa.array(term[first])), _repeated(name, len(first)), pa.array(of >> 1, mask=(of & 1) == 1), *[pa.array(n.astype(np.int32)) for n in numbers], _packed(places, np.r_[first, len(row)])])


def _order(numbers: np.ndarray, n: int) -> np.ndarray:
    """The stable order of numbers below n. NumPy sorts 16 bits by counting, so it takes one pass for these, or two."""
    order = np.argsort((numbers & 0xFFFF).astype(np.uint16), kind="stable")
    return order if n <= 1 << 16 else order[np.argsort((numbers >> 16).astype(np.uint16)[order], kind="stable")]


def _batch(ddl: str, columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ddl.split(", ")])


def _repeated(text: str, n: int) -> pa.Array:
    return pa.array([text]).take(pa.array(np.zeros(n, np.int64)))


def _packed(places: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Places from one end to the next as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * PLACE.itemsize).astype(np.int32)), pa.py_buffer(places.tobytes())])


def _unpacked(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places of binary values, and the value that each is of."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    places = np.frombuffer(data, PLACE, (offsets[-1] - offsets[0]) // PLACE.itemsize, offsets[0]) if data else np.empty(0, PLACE)
    return places, np.repeat(np.arange(len(values)), np.diff(offsets) // PLACE.itemsize)


def unblocked(index: DataFrame) -> DataFrame:
    """Blocks as postings, one row each."""
    store.small_batches(index.sparkSession)
    ddl = "term string, id bigint, column string, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, block = _unpacked(b["places"])
            own = pa.array(block)
            cell = b["cell"].fill_null(0).to_numpy(zero_copy_only=False)[block]
            ids = pa.array((cell << CELL_BITS) + places["id"], mask=b["cell"].is_null().to_numpy(zero_copy_only=False)[block])
            yield _batch(ddl, [b["term"].take(own), ids, b["column"].take(own), pa.array(places["pos"])])

    return index.select("term", "column", "cell", "places").mapInArrow(run, ddl)


def term_counts(index: DataFrame, mode: str, ids: DataFrame) -> DataFrame:
    """(term, n, docs) of blocks: postings of each term, and distinct ids. ids: those of the indexed rows, repeated as there."""
    whole = index.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # an id that has one row, of one column, stands in one block of a term
    if len(MODES[mode]) == 1 and ids.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return whole
    return unblocked(index).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(index: DataFrame, path: str) -> None:
    """Store postings or blocks by buckets of terms, sorted by term, so that a search reads one bucket's row groups of its term."""
    rows = index.withColumn("bucket", _bucket(F.col("term")))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id" if "id" in index.columns else "cell").write.mode("overwrite").partitionBy("bucket").parquet(path)


def term_search(index: DataFrame, rows: DataFrame, term: str, column: str | None = None) -> DataFrame:
    """Rows that hold the term, in any indexed column or in one. A stored index is read in the term's bucket only."""
    hits = index.where(F.col("term") == term)
    hits = hits.where(F.col("bucket") == _bucket(F.lit(term))) if "bucket" in index.columns else hits
    hits = hits.where(F.col("column") == column) if column else hits
    hits = hits if "id" in index.columns else unblocked(hits)
    return rows.join(hits.select("id"), "id", "left_semi")


def contains_term(text: Column, term: str) -> Column:
    """The same test without an index."""
    return F.array_contains(tokens(text), term)


def without_deleted(index: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after rows went: no posting of a deleted id stays."""
    return index.join(deleted.select("id"), "id", "left_anti")


def keyset_pages(rows: DataFrame, after: int, until: int, size: int) -> DataFrame:
    """(page, first_id, last_id, n) of the ids above ``after`` up to ``until``, ``size`` a page."""
    ids = rows.where((F.col("id") > after) & (F.col("id") <= until)).groupBy("id").agg(F.count("*").alias("n"))
    placed = prefix.running(ids.select("id", F.lit(1).cast("bigint").alias("n")), (), "id", {"n": "sum"})
    return placed.groupBy(F.floor((F.col("n") - 1) / size).alias("page")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


#: Rows of the smallest page of a rebuild; how many of them a step takes at first when nothing else runs.
UNIT, IDLE_UNITS = 500, 4


class Rebuild:
    """A rebuild of the postings below ``root``, page after page, that can stop and go on.

    The rows are first laid out by ranges of ids, with the columns of the mode only, and a zone map tells
    which file holds which ids; so a page opens only its own files, and of these, as they are sorted and
    have an index of small pages, reads little more than its own rows. The plan of pages is made once and
    stored, in units of UNIT rows. A step takes one of them while ``busy()``, else IDLE_UNITS, and twice as
    many with each further step for which nothing else runs, its files side by side: so the number of steps
    grows with the logarithm of the rows. It writes its postings over what an earlier try left there, then
    the cursor; so a step that is repeated after a failure converges. The cursor is the last file of a
    folder whose files are never changed.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, root: str, mode: str, until: int, unit: int = UNIT, file_rows: int = 1 << 20, busy: Callable[[], bool] = lambda: False):
        self.spark, self.root, self.mode, self.busy, self.idle = spark, root, mode, busy, IDLE_UNITS
        if not store.exists(spark, f"{root}/pages/_SUCCESS"):
            own = rows.where(F.col("id") <= until).select("id", *MODES[mode])
            files = max(1, -(-own.count() // file_rows))
            laid = own.repartitionByRange(files, "id").sortWithinPartitions("id")
            laid.write.mode("overwrite").option("parquet.page.row.count.limit", unit).parquet(f"{root}/rows")
            laid = spark.read.parquet(f"{root}/rows")
            laid.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("id").alias("low"), F.max("id").alias("high")).write.mode("overwrite").parquet(f"{root}/zones")
            keyset_pages(laid, -(2**63), until, unit).repartitionByRange("page").sortWithinPartitions("page").write.mode("overwrite").parquet(f"{root}/pages")
        self.pages, self.zones = spark.read.parquet(f"{root}/pages"), spark.read.parquet(f"{root}/zones")

    def done(self) -> int:
        """Units that are done: the persisted cursor."""
        if not store.exists(self.spark, f"{self.root}/cursor"):
            return 0
        return self.spark.read.schema("unit long").json(f"{self.root}/cursor").agg(F.coalesce(F.max("unit"), F.lit(0))).first()[0]

    def page(self, first: int, last: int) -> DataFrame:
        """The rows of a range of ids, from the files that hold it."""
        files = [r["file"] for r in self.zones.where((F.col("low") <= last) & (F.col("high") >= first)).select("file").collect()]  # a page's own
        return self.spark.read.parquet(*files).where(F.col("id").between(first, last))

    def step(self) -> bool:
        """Rebuild one page; False if all are done."""
        at = self.done()
        busy = self.busy()
        units = 1 if busy else self.idle
        page = self.pages.where(F.col("page").between(at, at + units - 1)).agg(F.min("first_id").alias("first"), F.max("last_id").alias("last"), F.count("*").alias("n")).first()
        if not page["n"]:
            return False
        rows = self.page(page["first"], page["last"]) if MODES[self.mode] else self.spark.read.parquet(f"{self.root}/rows").limit(0)
        found = postings(rows, self.mode)
        (found.coalesce(1) if units <= IDLE_UNITS else found).write.mode("overwrite").parquet(f"{self.root}/postings/unit={at}")
        self.spark.range(1).select(F.lit(at + page["n"]).cast("long").alias("unit")).coalesce(1).write.mode("append").json(f"{self.root}/cursor")
        self.idle = IDLE_UNITS if busy else 2 * units
        return True

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings").drop("unit")


def reconcile(state: DataFrame, configured: str, max_id: int) -> DataFrame:
    """The state row after a start with ``configured`` mode: another mode means a rebuild up to max_id."""
    changed = F.col("mode") != configured
    rebuild = changed & F.lit(configured != "off") & F.lit(max_id > 0)
    return state.select("id", F.lit(configured).alias("mode"), F.when(rebuild, "rebuilding").when(changed, "current").otherwise(F.col("status")).alias("status"), F.when(changed, F.lit(0).cast("bigint")).otherwise(F.col("last_rowid")).alias("last_rowid"), F.when(rebuild, F.lit(max_id).cast("bigint")).when(changed, F.lit(None).cast("bigint")).otherwise(F.col("rebuild_until")).alias("rebuild_until"))


def index_status(state: DataFrame, configured: str) -> DataFrame:
    """mode, status, indexed_through, and whether to warn of a rebuild or of another mode."""
    return state.select("mode", "status", F.col("last_rowid").alias("indexed_through"), (F.col("status") == "rebuilding").alias("rebuilding"), (F.col("mode") != configured).alias("mode_mismatch"))
