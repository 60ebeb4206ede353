"""Near-duplicate documents by MinHash with tensored banding.

A plain scheme computes k fresh hashes for each of L tables. Here two collections of ``half_keys``
short keys (``rows`` MinHashes each) are computed, and every pair of one key from each collection
is a table: half_keys**2 tables of 2*rows MinHashes for 2*half_keys*rows hash evaluations.

1. A task turns each text into its exact shingle set (64-bit hashes), a set fingerprint, the two
   key collections and a 128-bit sketch.
2. Equal sets are folded into one representative, so copies cost one row from here on.
3. Half keys that only one set holds can't make a table key that two sets share; they go first.
   What is left forms the paired keys.
4. The shingles that no other remaining set holds bound every similarity of their set from above.
   This exact test drops sets, and later pairs, that can't reach the threshold.
5. A round links the members of a table to its hub, confirms on full sets and contracts by
   connected components. So a large family of near copies is never expanded into pairs.
6. The pairs of sets that share a table, still lie in different components, and aren't ruled out by
   size, own shingles or sketch are confirmed on full sets. Tables of up to ``SMALL`` sets are joined
   with themselves. Larger ones are dealt into blocks of bounded size, and each pair of blocks is
   compared on full sets, as bits, in a task of its own, which returns a spanning forest of the links
   that it finds: never more rows than sets. No cap applies to any of these steps.

At similarity s a pair is missed with probability about 2*(1 - s**rows)**half_keys: 1.5e-4 at the
threshold 0.85 with the defaults, 2e-6 at 0.9, and the rounds give further chances through others.

Defined results: null, empty and blank texts have an empty set, link with nothing and are kept.
Texts of fewer words than a shingle form one shingle of all their words. Rows that repeat a doc_id
count as documents with equal ids: each distinct set has a key of its own, so different texts of one
id keep their own links, and the rows have the same component only if links join them. doc_id is a
whole number. Null doc_ids are dropped: such a row can't be named in a result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as B
from .components import components
from .maptext import let_go
from .store import Scratch

SIGNATURE = "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, us array<long>, vs array<long>, s1 long, s2 long"
#: How many standard deviations above the mean the differing sketch bits of a pair at the threshold may lie.
SLACK = 6.5
#: Sets in a table that is joined with itself; sets and bytes in a block of a larger one.
SMALL, BLOCK_SETS, BLOCK_BYTES = 16, 1500, 4 << 20
FILTER_BITS = 26
#: Bytes of text that a task signs at once.
SLICE = 512 << 10


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their offsets."""
    low = B.LOWER[data]
    starts, ends, words = B.word_spans(low, offsets, B.WORD_BYTES)
    hashes = B.range_hashes(B.prefix_hashes(low), starts, ends)
    acc = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        acc[: len(acc) - k or None] += hashes[k:] * np.uint64(2 * k * k + 6 * k + 3)
    acc = B.mix(acc)
    parts, sizes = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        a, b = words[i], words[i + 1]
        if b - a >= width:
            part = np.unique(acc[a : b - width + 1])
        elif b > a:
            k = np.arange(b - a, dtype=np.uint64)
            part = B.mix((hashes[a:b] * (k * np.uint64(10) + np.uint64(7))).sum(keepdims=True) + np.uint64(b - a))
        else:
            part = acc[:0]
        parts.append(part)
        sizes[i + 1] = len(part)
    return (np.concatenate(parts) if parts else acc[:0]), np.cumsum(sizes)


def _fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over the hashes of each set; 0 of an empty one."""
    fp = np.zeros((2, len(bounds) - 1), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        fp[0][full] = np.add.reduceat(sets, bounds[:-1][full])
        fp[1][full] = np.add.reduceat(B.mix(sets), bounds[:-1][full])
    return fp


def _signatures(width: int, half_keys: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 2 * half_keys * rows
        rng = np.random.default_rng(977)
        xors, odd = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, n, np.uint64) | np.uint64(1)
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(1))
            ids = batch.column(0)
            for a, b in B.slices(offsets, SLICE):
                sets, bounds = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                at = bounds[:-1][full]
                fp = _fingerprints(sets, bounds)
                mins = np.zeros((n, b - a), np.uint64)
                if len(full):
                    work = np.empty_like(sets)
                    for j in range(n):
                        np.bitwise_xor(sets, xors[j], out=work)
                        np.multiply(work, odd[j], out=work)
                        work ^= work >> np.uint64(32)
                        np.multiply(work, odd[n - 1 - j], out=work)
                        mins[j][full] = np.minimum.reduceat(work, at)
                mixed = B.mix(mins.reshape(-1)).reshape(mins.shape)
                groups = mixed.reshape(2, half_keys, rows, b - a)
                steps = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                keys = B.mix(((groups * steps[None, None, :, None]).sum(2) + np.arange(2 * half_keys, dtype=np.uint64).reshape(2, half_keys, 1)).reshape(-1)).reshape(2, half_keys, b - a)
                sketch = np.zeros((2, b - a), np.uint64)
                for bit in range(2):
                    for j in range(min(n, 64)):
                        sketch[bit] |= ((mixed[j] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j)
                empty = sizes == 0
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * half_keys), pa.array(np.ascontiguousarray(keys[s].T).reshape(-1).view(np.int64)), mask=pa.array(empty)) for s in range(2)]
                longs = [pa.array(x.view(np.int64)) for x in (fp[0], fp[1])]
                yield pa.RecordBatch.from_arrays([ids[a:b].cast(pa.int64()), batch.column(2)[a:b], pa.array(sizes), *longs, *lists, pa.array(sketch[0].view(np.int64)), pa.array(sketch[1].view(np.int64))], names=["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "us", "vs", "s1", "s2"])
        let_go()

    return run


def _sets(width: int):
    """(rep, items): the sorted hashes of each set."""
    kind = np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(1))
            for a, b in B.slices(offsets):
                sets, bounds = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                raw = pa.py_buffer(sets.astype(kind).tobytes())
                at = pa.py_buffer((bounds * kind().itemsize).astype(np.int64).tobytes())
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, at, raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), column], names=["rep", "items"])

    return run


def _candidate_texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, text) of the wanted sets: (rep, doc_id, fp1, fp2, n), of which each document of the set can give the text.

    A bit map of fixed size (FILTER_BITS, whatever the number of documents) lets each task drop most
    others before their sets are told again; the join decides.
    """
    place = F.expr(f"(doc_id ^ shiftrightunsigned(doc_id, {FILTER_BITS})) & {(1 << FILTER_BITS) - 1}")
    maps = wanted.select((place + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    rows = {r["bucket"] - 1: bytes(r["bits"]) for r in maps.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << 12
        bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for bucket, part in shared.value.items():
            bits[bucket * size : (bucket + 1) * size] = np.frombuffer(part, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            at = (ids ^ (ids >> np.uint64(FILTER_BITS))) & np.uint64((1 << FILTER_BITS) - 1)
            keep = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            some = batch.filter(pa.array(keep.astype(bool)))
            data, offsets = B.text_buffers(some.column(1))
            for a, b in B.slices(offsets, SLICE):
                sets, bounds = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                fp = _fingerprints(sets, bounds)
                yield pa.RecordBatch.from_arrays([*some.slice(a, b - a).columns, *[pa.array(x.view(np.int64)) for x in fp], pa.array(np.diff(bounds))], names=["doc_id", "text", "fp1", "fp2", "n"])

    key = ["doc_id", "fp1", "fp2", "n"]
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, fp1 long, fp2 long, n long")
    return some.join(wanted, key).groupBy(*key).agg(F.first("rep").alias("rep"), F.first("text").alias("text")).select("rep", "text")


def _items(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in B.slices(offsets, 1 << 20):
                sets, bounds = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], np.diff(bounds))), pa.array(sets.view(np.int64))], names=["rep", "item"])

    return run


def slack(percent: int, hashes: int) -> int:
    """Sketch bits that may differ. A hash differs with the chance 1 - s; then either of its two bits does with 1 / 2."""
    n, differs = min(hashes, 64), 1 - percent / 100
    return math.ceil(n * differs + SLACK * math.sqrt(n * differs / 2 + n * differs * (1 - differs)))


def _compare_blocks(percent: int):
    """Of two blocks' sets: links at the threshold between different components, as a spanning forest.

    Sets are compared in full here, so every link is a true one, and no more of them are returned
    than there are sets.
    """

    def run(table: pa.Table) -> pa.Table:
        rep, block, comp, n, own = (table[c].to_numpy() for c in ("rep", "block", "comp", "n", "own"))
        column = table["items"].combine_chunks()
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
        owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        _, place, held = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        common = held > 1
        number = np.cumsum(common) - 1
        shared = common[place]
        width = max(1, -(-int(common.sum()) // 64))
        bits = np.zeros((len(raw), width), np.uint64)
        at, who = number[place[shared]], owner[shared]
        np.bitwise_or.at(bits, (who, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        two = table["bi"][0].as_py() != table["bj"][0].as_py()
        found: list[tuple[int, int]] = []
        _, tree = np.unique(comp, return_inverse=True)  # what is linked so far
        for i in range(len(raw) - 1):
            rest = np.arange(i + 1, len(raw))
            bound = np.minimum(n[i] - own[i], n[rest] - own[rest]) * 100 >= percent * np.maximum(n[i] + own[rest], n[rest] + own[i])
            rest = rest[bound & (tree[rest] != tree[i]) & ((block[rest] != block[i]) if two else True)]
            if len(rest):
                both = np.bitwise_count(bits[rest] & bits[i]).sum(1, dtype=np.int64)
                for j in rest[100 * both >= percent * (n[i] + n[rest] - both)].tolist():
                    if tree[j] != tree[i]:
                        tree[tree == tree[j]] = tree[i]
                        found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(len(batch)):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch, tag: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = docs.join(wanted, "rep", "left_semi")
    sets = scratch.table(texts.mapInArrow(_sets(width), "rep long, items binary"), f"{tag}-sets")
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    linked = scratch.table(both.mapInArrow(_confirm(percent), "a long, b long"), f"{tag}-links")
    scratch.drop(f"{tag}-sets")
    return linked


def _possible(percent: int, hashes: int, a: str = "", b: str = "h_") -> str:
    """What every pair above the threshold fulfils.

    n is the size of a set, own the number of its shingles that no other set in question holds:
    the intersection is at most n - own of either, the union at least n plus the other's own. That
    test is exact; the sketches allow SLACK standard deviations.
    """
    return f"""100 * least({a}n - {a}own, {b}n - {b}own) >= {percent} * greatest({a}n + {b}own, {b}n + {a}own)
        AND bit_count({a}s1 ^ {b}s1) + bit_count({a}s2 ^ {b}s2) <= {slack(percent, hashes)}"""


def _own_shingles(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, own): how many shingles of each wanted set no other wanted set holds."""
    rows = docs.join(wanted, "rep", "left_semi").mapInArrow(_items(width), "rep long, item long")
    alone = rows.groupBy("item").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other")
    return alone.groupBy("rep").agg(F.count("*").alias("own"))


def _large_tables(members: DataFrame, mixed: DataFrame, docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Links within large tables, block against block, each block pair's as a spanning forest."""
    rows = scratch.table(members.join(mixed, "u").select("u", "rep", "comp", "n", "own", "blocks"), "large")
    sets = docs.join(rows.select("rep").distinct(), "rep", "left_semi").mapInArrow(_sets(width), "rep long, items binary")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("block", block).withColumn("k", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("u", F.least("block", "k").alias("bi"), F.greatest("block", "k").alias("bj"), "rep", "block", "comp", "n", "own")
    return dealt.join(sets, "rep").groupBy("u", "bi", "bj").applyInArrow(_compare_blocks(percent), "a long, b long")


def _in_components(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("rep"))
    known = comps.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    return rows.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def near_duplicates(documents: DataFrame, width: int = 3, percent: int = 85, half_keys: int = 10, rows: int = 3, hub_rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group and text_hash of every document; see the module's text.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct
    ``width``-word shingles; component_id is the smallest doc_id reachable, kept is
    doc_id = component_id. ``documents`` needs columns doc_id and text. group numbers the components
    (null without words): it tells those apart that repeated doc_ids give the same component_id.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "near-dup")
    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL")
    signed = scratch.table(docs.withColumn("h", F.xxhash64(F.col("text").cast("string"))).mapInArrow(_signatures(width, half_keys, rows), SIGNATURE), "signed")

    full = signed.where("n_shingles > 0")
    sets = full.groupBy("fp1", "fp2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("doc_id"), F.first("us").alias("us"), F.first("vs").alias("vs"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    # a number for each set; the written table keeps it
    sets = scratch.table(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")

    halves = sets.select("rep", F.explode("us").alias("h"), F.lit(0).alias("side")).union(sets.select("rep", F.explode("vs").alias("h"), F.lit(1).alias("side")))
    shared = scratch.table(halves.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
    lists = halves.join(shared, "h").groupBy("rep").agg(F.collect_list(F.when(F.col("side") == 0, F.col("h"))).alias("us"), F.collect_list(F.when(F.col("side") == 1, F.col("h"))).alias("vs")).where("size(us) > 0 AND size(vs) > 0")
    lists = scratch.table(lists.join(sets.select("rep", "n", "s1", "s2"), "rep"), "lists")
    docs = scratch.table(_candidate_texts(docs, sets.join(lists.select("rep"), "rep", "left_semi").select("rep", "doc_id", "fp1", "fp2", "n"), width), "texts")
    own = scratch.table(_own_shingles(docs, lists.select("rep"), width), "own")
    lists = lists.join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    lists = scratch.table(lists.where(f"100 * (n - own) >= {percent} * n"), "live")
    facts = ["rep", "n", "own", "s1", "s2"]
    keyed = lists.select(*facts, F.explode("us").alias("u"), "vs").select(*facts, "u", F.explode("vs").alias("v"))
    keyed = scratch.table(keyed.select(F.xxhash64("u", "v").alias("key"), *facts), "keyed")

    links = comps = None
    hashes = 2 * half_keys * rows
    for turn in range(hub_rounds + 1):
        tag = f"round{turn}"
        if turn < hub_rounds:
            members = _in_components(keyed, comps)
            rank = F.xxhash64("rep", F.lit(turn))
            hub = F.min(F.struct(rank.alias("rank"), *facts, "comp")).alias("hub")
            # a table with one component is done; the rest go on
            hubs = members.groupBy("key").agg(hub, F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
            hubs = scratch.table(hubs.select("key", *[F.col(f"hub.{c}").alias(f"h_{c}") for c in [*facts, "comp"]]), f"{tag}-hubs")
            pairs = members.join(hubs, "key").where(f"comp <> h_comp AND {_possible(percent, hashes)}")
            direct = None
        else:
            members = scratch.table(_in_components(lists, comps).select("comp", *facts, "vs", F.explode("us").alias("u")), f"{tag}-members")
            weight = F.greatest(F.count("*") / BLOCK_SETS, F.sum(F.col("n") * 4) / BLOCK_BYTES)
            mixed = members.groupBy("u").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m"), F.ceil(weight).cast("int").alias("blocks")).where("c0 <> c1")
            mixed = scratch.table(mixed.select("u", "m", "blocks"), f"{tag}-mixed")
            left = members.join(mixed.where(F.col("m") <= SMALL).select("u"), "u", "left_semi")
            right = left.select("u", *[F.col(c).alias(f"h_{c}") for c in [*facts, "comp", "vs"]])
            pairs = left.join(right, "u").where(f"comp < h_comp AND {_possible(percent, hashes)} AND arrays_overlap(vs, h_vs)")
            direct = scratch.table(_large_tables(members, mixed.where(F.col("m") > SMALL), docs, scratch, width, percent).distinct(), f"{tag}-direct")
        pairs = scratch.table(pairs.select(F.least("rep", "h_rep").alias("a"), F.greatest("rep", "h_rep").alias("b")).distinct(), f"{tag}-pairs")
        found = None if pairs.isEmpty() else _verify(pairs, docs, scratch, tag, width, percent)
        if direct is not None:
            found = direct if found is None else found.union(direct)
        if found is None:
            continue
        links = found if links is None else links.union(found)
        comps = scratch.table(components(links, scratch, f"{tag}-cc"), f"{tag}-comps")

    if comps is None:
        comps = spark.createDataFrame([], "node long, component long")
    # a component is called by its smallest doc_id; sets without links by their own
    linked = comps.select(F.col("node").alias("rep"), "component").join(sets.select("rep", "doc_id"), "rep")
    linked = linked.join(linked.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("rep", "component", "least")
    where = sets.select("rep", "doc_id", "fp1", "fp2", F.col("n").alias("n_shingles")).join(linked, "rep", "left")
    where = scratch.table(where.select("fp1", "fp2", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("component", "rep").alias("group")), "where")
    out = signed.select("doc_id", "text_hash", "n_shingles", "fp1", "fp2").join(where, ["fp1", "fp2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "group", "text_hash")


def one_of_each(documents: DataFrame, **settings: int) -> DataFrame:
    """The rows of documents without near duplicates: of each group the row of the smallest doc_id (of several, one) stays.

    Rows without words are linked with nothing and stay, except for rows that repeat both doc_id and text;
    rows without a doc_id stay as they are. Columns are those of documents.
    """
    names = documents.columns
    found = near_duplicates(documents, **settings).select("group", "doc_id", "text_hash")
    # a group may be large: only its least row is sought, and rows meet those by doc_id and text
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("own")).select("own.*")
    stay = first.unionByName(found.where("group IS NULL").select("doc_id", "text_hash")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"))
    # all input columns travel in one struct, so none of their names can clash
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__h"))
    kept = rows.join(stay, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"]).unionByName(rows.where("__id IS NULL"))
    return kept.select(*[F.col(f"row.`{c}`") for c in names])
