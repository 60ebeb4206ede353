"""Ranked lexical search over K2-treaps of term-document grids.

A shard is a bounded number of postings of whole documents in one task. Its grid has a row for each
term that the items ask for (frequent terms first), a column for each document (by doc_id), and in a
cell the impact of the term in the document. The grid is cut into quarters again and again; of each
quarter that isn't empty the tree keeps a bit in its parent's mask, found by ranks over the masks, and
the greatest impact below it. An item starts at the root with all its rows and descends best-first over
ranges of documents: the sum of the maxima along its rows' paths bounds what a document of the range
can score, the ranges of the greatest bounds are halved first, and those that can't reach the best
``k`` documents so far are left. What a single document's cells add up to is its score, so results are
exact. Ties fall out in order of doc_id, because columns are in that order. A second step takes the
best ``k`` of all shards.

Statistics count all documents. Postings are kept of the terms of the items, which go to the tasks in
blocks of bounded bytes; each further block is one more pass over the texts.

Terms: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, told by 64-bit hashes of their bytes.

Defined results: null texts and texts without terms match nothing and don't count as documents; items
without terms that occur give no rows. Each row of items is an item of its own, ranked by itself even if it repeats an item_id; each
row of documents is a document, even if it repeats a doc_id. Null doc_ids come first among equal scores.
Empty tables give empty results. Extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytes_np as B
from .maptext import let_go, map_texts
from .store import Scratch

#: Bytes of items that go to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Postings of a shard, about.
SHARD_POSTINGS = 1 << 20
#: Cells that are halved at once: few until there are k documents, then more.
FIRST_CELLS, MORE_CELLS = 1 << 12, 1 << 17
#: How many bits of a mask are set.
_ONES = np.array([bin(x).count("1") for x in range(16)], np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """Each bit of a number below 2**31 at twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A compressed quadtree over the cells (row, column, value > 0); each node knows the greatest value below it."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int):
        self.row_bits, self.column_bits = (max(1, int(n - 1).bit_length()) for n in (n_rows, n_columns))
        self.height = max(self.row_bits, self.column_bits)
        # both numbers begin at the top bit, so a short one ends early and its levels split the other one only
        at = (_spread(rows << (self.height - self.row_bits)) << np.uint64(1)) | _spread(columns << (self.height - self.column_bits))
        order = np.argsort(at)
        codes, most = at[order], values[order]
        levels = []  # (greatest values, masks of children), leaves first
        masks = np.zeros(len(codes), np.uint8)
        for _ in range(self.height):
            levels.append((most, masks))
            parents = codes >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            masks = np.bitwise_or.reduceat(np.left_shift(1, (codes & np.uint64(3)).astype(np.int64)).astype(np.uint8), first)
            most, codes = np.maximum.reduceat(most, first), parents[first]
        levels.append((most, masks))
        levels.reverse()
        self.most = np.concatenate([m for m, _ in levels])
        self.masks = np.concatenate([m for _, m in levels])
        # nodes stand level by level, so a node's children follow those of all nodes before it
        self.first = 1 + np.concatenate([[0], np.cumsum(_ONES[self.masks])[:-1]])

    def child(self, nodes: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child in that quarter, and the children of those."""
        masks = self.masks[nodes]
        there = np.flatnonzero((masks >> quarter) & 1)
        return there, self.first[nodes[there]] + _ONES[masks[there] & ((1 << quarter[there]) - 1)]

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and sums (weights times values over the rows) of the k best columns: greatest sum first, then smallest column."""
        # ranges: bound, level, number among those of the level; and for each its cells: term (of rows), node
        bound, level, number = np.array([int(self.most[0]) * int(weights.sum())]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        count, terms, nodes = np.array([len(rows)]), np.arange(len(rows)), np.zeros(len(rows), np.int64)
        columns, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            # the greatest bounds first, of equal ones the first documents
            begin = number << np.maximum(self.column_bits - level, 0)
            order = np.lexsort((begin, -bound))
            some = max(1, int(np.searchsorted(np.cumsum(count[order]), FIRST_CELLS if len(columns) < k else MORE_CELLS)))
            taken = np.zeros(len(bound), bool)
            taken[order[:some]] = True
            owner = np.repeat(np.arange(len(bound)), count)
            inside = taken[owner]
            o, t, x = owner[inside], terms[inside], nodes[inside]
            lvl = level[o]
            row_bit = np.where(lvl < self.row_bits, rows[t] >> np.maximum(self.row_bits - 1 - lvl, 0), 0) & 1
            parts = [(bound[~taken], level[~taken], number[~taken], count[~taken], terms[~inside], nodes[~inside])]
            for half in (0, 1):
                there, children = self.child(x, 2 * row_bit + half)
                if not len(there):
                    continue
                first = np.flatnonzero(np.concatenate([[True], o[there][1:] != o[there][:-1]]))
                own = o[there[first]]
                split = level[own] < self.column_bits
                parts.append((np.add.reduceat(weights[t[there]] * self.most[children], first), level[own] + 1, np.where(split, 2 * number[own] + half, number[own]), np.diff(np.append(first, len(there))), t[there], children))
            bound, level, number, count, terms, nodes = (np.concatenate(p) for p in zip(*parts, strict=True))
            done = level == self.height
            if done.any():
                columns, sums = np.concatenate([columns, number[done]]), np.concatenate([sums, bound[done]])
                order = np.lexsort((columns, -sums))[:k]
                columns, sums = columns[order], sums[order]
            live = ~done
            if len(columns) == k:
                begin = number << np.maximum(self.column_bits - level, 0)
                live &= (bound > sums[-1]) | ((bound == sums[-1]) & (begin < columns[-1]))
            if not live.all():
                terms, nodes = (v[np.repeat(live, count)] for v in (terms, nodes))
                bound, level, number, count = bound[live], level[live], number[live], count[live]
        return columns, sums


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and offsets of the texts into them."""
    low = B.LOWER[data]
    starts, ends, words = B.word_spans(low, offsets, B.ALNUM_BYTES)
    return B.range_hashes(B.prefix_hashes(low), starts, ends), words


class Items:
    """The terms of one block of items: the vocabulary as sorted hashes, and each item's terms (places there) with their numbers."""

    def __init__(self, texts: list[str | None]):
        hashes, words = _terms(*B.text_buffers(pa.array(texts, pa.large_string())))
        self.vocabulary, at = np.unique(hashes, return_inverse=True)
        self.terms = [np.unique(at[a:b], return_counts=True) for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True)]


def _counter(shared):
    """n (terms of a text), and those of the vocabulary with their numbers."""

    def make():
        table = B.Table(shared.value.vocabulary.view(np.int64), np.arange(len(shared.value.vocabulary)), -1)
        size = max(1, len(shared.value.vocabulary))

        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            hashes, words = _terms(data, offsets)
            at = table.get(hashes.view(np.int64))
            known = np.flatnonzero(at >= 0)
            pairs, tf = np.unique(B.owners(words)[known] * size + at[known], return_counts=True)
            bounds = pa.array(np.searchsorted(pairs // size, np.arange(len(offsets))).astype(np.int32))
            return [pa.array(np.diff(words)), pa.ListArray.from_arrays(bounds, pa.array((pairs % size).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf))]

        return run

    return make


def _searcher(shared, n: int, total: int, k: int):
    """Batches of (doc_id, n, terms, tfs) -> the best k documents of each shard for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, row, weight = shared.value  # row: the grid's row of each term; weight: of each row
        kept: list[pa.RecordBatch] = []
        held = 0

        def search() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept).combine_chunks()
            t = t.take(pc.sort_indices(t, [("doc_id", "ascending")], null_placement="at_start")).combine_chunks()
            lists, tf = (t.column(c).chunk(0) for c in ("terms", "tfs"))
            size = np.diff(lists.offsets.to_numpy())
            column, rows = np.repeat(np.arange(len(size)), size), row[lists.flatten().to_numpy()]
            tf, length = tf.flatten().to_numpy(), t.column("n").chunk(0).to_numpy()
            m = 75 + 25 * length * n // total
            values = weight[rows] * (1_000_000_000 * tf // (1000 * tf + 12 * m[column]))
            some = values > 0
            out = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            if some.any():
                tree = Treap(rows[some], column[some], values[some], len(weight), len(size))
                for i, (terms, times) in enumerate(items):
                    if len(terms):
                        columns, sums = tree.best(row[terms], times, k)
                        out.append((np.full(len(columns), i, np.int32), columns, sums))
            no, columns, sums = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(no), t.column("doc_id").chunk(0).take(pa.array(columns)), pa.array(sums)], names=["item", "doc_id", "score"])

        try:
            for batch in batches:
                kept.append(batch)
                held += len(batch.column(2).flatten())
                if held >= SHARD_POSTINGS:
                    yield search()
                    kept, held = [], 0
            if kept:
                yield search()
        finally:
            let_go()

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """Rows (item_id, text) in blocks of bounded bytes, partition after partition."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len((r["text"] or "").encode()) + 64
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append(r)
        size += n
    if block:
        yield block


def search(documents: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) of the highest scores above 0 for each item (item_id, text)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "search")
    id_type = items.schema["item_id"].dataType
    out = None
    for b, block in enumerate(_blocks(items.select("item_id", F.col("text").cast("string").alias("text")), block_bytes)):
        asked = Items([r["text"] for r in block])
        shared = spark.sparkContext.broadcast(asked)
        counted = scratch.table(map_texts(documents, "text", _counter(shared), "n long, terms array<int>, tfs array<long>", ["doc_id"]).where("n > 0"), f"postings{b}")
        n, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(asked.vocabulary), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # one row for each term of the block
            df[r["t"]] = r["n"]
        order = np.argsort(-df, kind="stable")
        row = np.empty_like(order)
        row[order] = np.arange(len(order))
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
        used = spark.sparkContext.broadcast(([(t[df[t] > 0], c[df[t] > 0]) for t, c in asked.terms], row, weight))
        found = counted.where(F.size("terms") > 0).mapInArrow(_searcher(used, n, total, k), f"item int, doc_id {documents.schema['doc_id'].dataType.simpleString()}, score long")
        w = W.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {id_type.simpleString()}")
        found = scratch.table(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), f"found{b}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = documents.limit(0).select(F.lit(None).cast(id_type).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return out


#: DuckDB SQL for the same rows.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
p AS (SELECT k, doc_id, len(w) AS len, t, count(*) AS tf FROM (SELECT k, doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY k, doc_id, len(w), t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS wt FROM p, s GROUP BY t, n),
r AS (SELECT q.i, q.item_id, p.k, p.doc_id, CAST(sum(c * wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l)))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN f USING (t), s GROUP BY q.i, q.item_id, p.k, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""
