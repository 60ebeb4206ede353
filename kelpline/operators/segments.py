"""A text index of immutable segments: an append adds one, a delete adds a tombstone, merges keep them few.

A segment holds blocks of postings by buckets of terms, sorted by term. Tombstones are bit maps of deleted
ids, by the cells of 32,768 ids that blocks have too; one counts for segments that were committed before it, so an id may be indexed
again. A merge takes a tier (segments of about one size) as soon as it has ``FAN`` of them, drops what
tombstones hide, and commits the result in their place: a posting is merged once for each tier, and
there are at most FAN - 1 segments in each. Both tables have one version (``versions``), so a search
sees segments and tombstones of the same moment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from . import search
from .versions import Conflict, Folder, Tables

POSTINGS = f"{search.BLOCKS}, bucket int"
TOMBSTONES = "cell bigint, bits binary"
ORDER = ["bucket", "term", "cell"]
#: Parts that a cell's blocks are dealt to when tombstones hide some of their postings.
PARTS = 8
#: Segments of a tier that are merged; the least bytes that make a tier of their own.
FAN, LEAST = 4, 1 << 16


class SegmentedIndex:
    def __init__(self, spark: SparkSession, root: str, mode: str):
        self.spark, self.mode, self.tables = spark, mode, Tables(spark, root)

    def append(self, rows: DataFrame) -> None:
        """Index new rows as a segment, then merge what has become too much."""
        found = search.blocks(rows, self.mode).withColumn("bucket", search._bucket(F.col("term")))
        self.tables.append({"postings": found}, {"postings": ORDER})
        self.merge()

    def delete(self, ids: DataFrame) -> None:
        """Hide all postings of ids (column id) that are indexed so far."""
        cells = ids.where("id IS NOT NULL").groupBy(F.shiftright("id", search.CELL_BITS).alias("cell")).agg(F.bitmap_construct_agg(F.col("id").bitwiseAND(F.lit((1 << search.CELL_BITS) - 1).cast("bigint"))).alias("bits"))
        self.tables.append({"tombstones": cells})

    def segments(self) -> list[Folder]:
        return [f for f in self.tables.folders() if f.table == "postings"]

    def search(self, term: str, column: str | None = None) -> DataFrame:
        """Distinct ids of the rows that hold the term, in any column or in one. Each segment is read in the term's bucket only."""
        hits = lambda df: df.where((F.col("bucket") == search._bucket(F.lit(term))) & (F.col("term") == term) & (F.lit(True) if column is None else F.col("column") == column))
        return search.unblocked(self._visible(self.tables.folders(), hits)).select("id").distinct()

    def blocks(self) -> DataFrame:
        """All blocks, without the postings that are hidden."""
        return self._visible(self.tables.folders(), lambda df: df)

    def postings(self) -> DataFrame:
        """All postings that aren't hidden."""
        return search.unblocked(self.blocks())

    def _visible(self, folders: list[Folder], some) -> DataFrame:
        own = [f for f in folders if f.table == "postings"]
        out = self.spark.createDataFrame([], POSTINGS)
        stones = [f for f in folders if f.table == "tombstones"]
        alike: dict[tuple[Folder, ...], list[Folder]] = {}
        for f in own:  # those that the same tombstones hide
            alike.setdefault(tuple(t for t in stones if t.seq > f.seq), []).append(f)
        for later, same in alike.items():
            rows = some(self.tables.read("postings", POSTINGS, folders=same))
            out = out.unionByName(self._without(rows, list(later)) if later else rows)
        return out

    def _without(self, rows: DataFrame, stones: list[Folder]) -> DataFrame:
        """rows but for the postings whose ids tombstones hold: a cell's blocks meet its bit map, which comes before them, in PARTS places."""
        store.small_batches(self.spark)
        maps = self.tables.read("tombstones", TOMBSTONES, folders=stones).groupBy("cell").agg(F.bitmap_or_agg("bits").alias("places"))
        maps = maps.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(PARTS)]))).withColumn("kind", F.lit(0))
        both = rows.withColumns({"part": F.col("bucket") % PARTS, "kind": F.lit(1)}).unionByName(maps, allowMissingColumns=True)
        return both.repartition("cell", "part").sortWithinPartitions("cell", "kind").select(*rows.columns, "kind").mapInArrow(_hide, POSTINGS)

    def merge(self) -> int:
        """Merge each tier that has FAN segments or more, until none has; how many merges that took."""
        merges = 0
        while True:
            folders = self.tables.folders()
            tiers: dict[int, list[Folder]] = {}
            for f in folders:
                if f.table == "postings":
                    tiers.setdefault(max(0, int(math.log(max(1, f.bytes) / LEAST, FAN)) + 1) if f.bytes > LEAST else 0, []).append(f)
            full = next((own for _, own in sorted(tiers.items()) if len(own) >= FAN), None)
            if full is None:
                self._drop_tombstones(folders)
                return merges
            stones = [f for f in folders if f.table == "tombstones"]
            rows = self._visible([*full, *stones], lambda df: df)
            add = self.tables._write("postings", rows.hint("rebalance", "bucket"), ORDER, seq=max(f.seq for f in full))
            try:
                self.tables._commit(add, full)
                merges += 1
            except Conflict:
                continue

    def _drop_tombstones(self, folders: list[Folder]) -> None:
        """Tombstones that are older than every segment hide nothing any more."""
        first = min((f.seq for f in folders if f.table == "postings"), default=None)
        old = [f for f in folders if f.table == "tombstones" and first is not None and f.seq < first]
        if old:
            try:
                self.tables._commit([], old)
            except Conflict:
                pass  # another merge did it


def _hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks without the places that the bit map of their cell holds; rows of kind 0 are bit maps, and come before their cell's blocks."""
    maps: dict[int, np.ndarray] = {}
    for b in batches:
        stone = b["kind"].to_numpy() == 0
        for cell, bits in zip(*(b.filter(pa.array(stone))[c].to_pylist() for c in ("cell", "places")), strict=True):
            maps[cell] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        rows = b.filter(pa.array(~stone))
        if not rows.num_rows:
            continue
        places, block = search._unpacked(rows["places"])
        cells = rows["cell"].to_pylist()
        first = np.searchsorted(block, np.arange(rows.num_rows + 1))
        keep = np.ones(len(places), bool)
        changes = [0, *(k for k in range(1, len(cells)) if cells[k] != cells[k - 1]), len(cells)]
        for low, high in zip(changes, changes[1:], strict=False):
            if cells[low] in maps:
                own = slice(first[low], first[high])
                keep[own] = ~maps[cells[low]][places["id"][own]]
        maps = {c: m for c, m in maps.items() if c == cells[-1]}
        places, block = places[keep], block[keep]
        n = np.bincount(block, minlength=rows.num_rows)
        new = np.r_[True, (block[1:] != block[:-1]) | (places["id"][1:] != places["id"][:-1])][: len(block)]
        docs = np.where(rows["cell"].is_null().to_numpy(zero_copy_only=False), 0, np.bincount(block[new], minlength=rows.num_rows))
        out = {"n": pa.array(n.astype(np.int32)), "docs": pa.array(docs.astype(np.int32)), "places": search._packed(places, np.r_[0, np.cumsum(n)])}
        yield search._batch(POSTINGS, [out.get(c, rows[c]) for c in rows.schema.names if c != "kind"]).filter(pa.array(n > 0))
