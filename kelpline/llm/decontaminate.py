"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a slice of whole documents in one task. Its words become symbols (the benchmark's
vocabulary; any other word ends a run, as no phrase can cross it). Over the runs a task builds the
Burrows-Wheeler transform, holds it in a wavelet matrix, finds every phrase by backward search with
wavelet ranks, locates the occurrences by walking to sampled suffix positions, and merges what they
cover into spans to remove. Nothing is shuffled, and memory is bounded by the shard.

The benchmark goes to the tasks in blocks of bounded bytes; each further block is one more pass in
the same stage.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A phrase is ``window`` consecutive
words of an item; an item of fewer words (but not none) is one phrase.

Defined results: null, empty and word-less texts have no words and no hits; null or word-less items
have no phrases; an empty benchmark gives no hits. Rows that repeat a doc_id are judged each by
itself, in their own row. Items that repeat an item_id count once; items with a null id are ignored; ids may be of any type.
Extra columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .maptext import map_texts
from .store import Scratch

#: Benchmark bytes that go to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Bytes of a shard's texts; a longer text is a shard by itself.
SHARD_BYTES = 2 << 20
RESULT = "n_words long, items array<string>, hits array<struct<first:long,last:long,start:long,stop:long>>"


class WaveletMatrix:
    """Ranks over a sequence of symbols, one bit level after another."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low, high = np.zeros_like(at), at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit, ones, zeros = ((symbol >> level) & 1).astype(bool), self.ones[k], self.zeros[k]
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Over runs of symbols >= 1 that are each ended by a 0. The zeros are ordered by place."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        n = len(text)
        stops = text == 0
        n_stops = int(stops.sum())
        rank = np.where(stops, np.cumsum(stops) - 1, text.astype(np.int64) + n_stops - 1)
        step = 1
        while True:  # prefix doubling; the ends of runs differ, so it takes log2 of the longest repeat
            new = np.zeros(n, np.int64)
            ahead = np.full(n, -1, np.int64)
            ahead[: n - step] = rank[step:] if step < n else 0
            order = np.lexsort((ahead, rank))
            differs = (rank[order[1:]] != rank[order[:-1]]) | (ahead[order[1:]] != ahead[order[:-1]])
            new[order[1:]] = np.cumsum(differs)
            rank, step = new, step * 2
            if not n or rank[order[-1]] == n - 1 or step >= n:
                break
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(sigma).bit_length()))
        counts = np.bincount(text, minlength=sigma + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        starts = np.zeros(n, bool)
        starts[1:] = stops[:-1]
        starts[:1] = True
        self.sampled = ((order % sample) == 0) | starts[order]
        self.sampled_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]
        self.n = n

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long patterns: those that occur, and their row ranges."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[which, j]
            low, high = self.first[c] + self.wavelet.rank(c, low), self.first[c] + self.wavelet.rank(c, high)
            live = high > low
            which, low, high = which[live], low[live], high[live]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked, index = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(rows):
            done = self.sampled[rows]
            out[index[done]] = self.positions[self.sampled_rank[rows[done]]] + walked
            rows, index = rows[~done], index[~done]
            c = self.wavelet.access(rows)
            rows = self.first[c] + self.wavelet.rank(c, rows)
            walked += 1
        return out


class Phrases:
    """The phrases of one block of items as rows of symbols, by length, and the items that hold each (as places in ``ids``).

    Equal phrases are told by 64-bit hashes of their symbols, which are exact here: words were told by
    64-bit hashes of their bytes before.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.ids = [i for i, _ in items]
        data, offsets = B.text_buffers(pa.array([t for _, t in items], pa.large_string()))
        low = B.LOWER[data]
        starts, ends, words = B.word_spans(low, offsets, B.ALNUM_BYTES)
        self.vocabulary, symbols = np.unique(B.range_hashes(B.prefix_hashes(low), starts, ends), return_inverse=True)
        symbols = symbols.astype(np.int32) + 1
        sizes = np.diff(words)
        counts = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        item = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
        first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - words[:-1], counts)
        length = np.minimum(sizes, window)[item]
        #: length -> (patterns, offsets into holders, holders)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            key = np.zeros(len(own), np.uint64)
            for k in range(n):
                key = B.mix(key * np.uint64(2 * k + 3) + symbols[first[own] + k].astype(np.uint64))
            pairs = np.unique(np.stack([np.unique(key, return_inverse=True)[1], item[own]]), axis=1)
            _, one = np.unique(key, return_index=True)
            patterns = symbols[first[own[one]][:, None] + np.arange(n)]
            self.by_length[n] = patterns, np.searchsorted(pairs[0], np.arange(len(one) + 1)), pairs[1]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _search(phrases: Phrases, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in a phrase, and the (document, item) pairs that were found, as two rows."""
    hit, found = np.zeros(len(symbols) + 1, np.int64), [np.zeros((2, 0), np.int64)]
    # runs of known words inside a document, long enough for the shortest phrase
    known = symbols > 0
    breaks = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
    edges = np.unique(np.concatenate([breaks, words]))
    a, b = edges[:-1], edges[1:]
    fit = known[np.minimum(a, len(symbols) - 1)] & (b - a >= min(phrases.by_length)) if len(symbols) else np.zeros(len(a), bool)
    a, b = a[fit], b[fit]
    if not len(a):
        return hit[:-1] > 0, found[0]
    sizes = b - a + 1
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes - a, sizes)
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[ends - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    for n, (patterns, starts, holders) in phrases.by_length.items():
        which, low, high = index.find(patterns)
        count = high - low
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
        at = place[index.locate(rows)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
        document = np.searchsorted(words, at, "right") - 1
        pairs = np.unique(np.stack([document, np.repeat(which, count)]), axis=1)
        held = starts[pairs[1] + 1] - starts[pairs[1]]
        place_of = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held - starts[pairs[1]], held)
        found.append(np.stack([np.repeat(pairs[0], held), holders[place_of]]))
    return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(found, 1), axis=1)


def _searcher(phrases: Phrases):
    def make():
        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            low = B.LOWER[data]
            starts, ends, words = B.word_spans(low, offsets, B.ALNUM_BYTES)
            if phrases.by_length:
                hit, pairs = _search(phrases, phrases.symbols(B.range_hashes(B.prefix_hashes(low), starts, ends)), words)
            else:
                hit, pairs = np.zeros(len(starts), bool), np.zeros((2, 0), np.int64)
            # maximal runs of hit words within a document, as word and byte ranges
            before = np.concatenate([[False], hit[:-1]])
            before[words[:-1][words[:-1] < len(hit)]] = False
            after = np.concatenate([hit[1:], [False]])
            after[words[1:][words[1:] > 0] - 1] = False
            first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
            document = np.searchsorted(words, first, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(first - words[document]), pa.array(last - words[document] + 1), pa.array(starts[first] - offsets[document]), pa.array(ends[last] - offsets[document])], names=["first", "last", "start", "stop"])
            bounds = pa.array(np.searchsorted(first, words).astype(np.int32))
            names = pa.array([phrases.ids[i] for i in pairs[1].tolist()], pa.string())
            held = pa.array(np.searchsorted(pairs[0], np.arange(len(offsets))).astype(np.int32))
            return [pa.array(np.diff(words)), pa.ListArray.from_arrays(held, names), pa.ListArray.from_arrays(bounds, spans)]

        return run

    return make


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def _blocks(items: DataFrame, block_bytes: int) -> int:
    return max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))


def find_contamination(documents: DataFrame, benchmark: DataFrame, carry: list[str], window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry``, then n_words, items (ids, as strings, of items with a phrase in the text) and hits.

    hits: maximal ranges of covered words [first, last) and the bytes [start, stop) they take.
    """
    spark = documents.sparkSession
    items = _items(benchmark)
    n_blocks = _blocks(items, block_bytes)
    found = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").cast("string").alias("text"))
    for k in range(n_blocks):
        block = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        known = [c for c in found.columns if c not in ("row", "text")]
        found = map_texts(found, "text", _lazy(shared), RESULT, ["row", *known, *(["text"] if k + 1 < n_blocks else [])], SHARD_BYTES)
        found = found.withColumnsRenamed({"n_words": f"n{k}", "items": f"i{k}", "hits": f"h{k}"})
    parts = range(n_blocks)
    both = lambda name: F.flatten(F.array(*[F.col(f"{name}{k}") for k in parts]))
    joined = F.col("h0") if n_blocks == 1 else F.aggregate(
        F.array_sort(both("h")),
        F.array().cast("array<struct<first:long,last:long,start:long,stop:long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"), F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return found.select(*[F.col(f"row.`{c}`") for c in carry], F.col("n0").alias("n_words"), F.array_sort(F.array_distinct(both("i"))).alias("items"), joined.alias("hits"))


def _lazy(shared):
    def make():
        return _searcher(shared.value)()

    return make


def contamination_report(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hits."""
    found = find_contamination(documents, benchmark, ["doc_id"], window)
    ids = F.array_join("items", ",")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items", "hits")


def remove_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents without the words that any phrase covers, in the same columns.

    A span gives way to a line break. Where a text's rest brings words of a phrase together, the
    rest is searched again, until no phrase is left. n_chars, where it is a column, is renewed.
    Rows whose texts have no hit come back unchanged, null texts included.

    One block is cut and searched again inside the task, around the cuts only, however deep phrases lie in each other. With more, a round finds the spans of all
    blocks in the same text and cuts their union; the next round has the rows that were cut.
    """
    spark = documents.sparkSession
    names = documents.columns
    items = _items(benchmark)
    # all input columns travel in one struct, so none of their names can clash
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))

    def renewed(df: DataFrame) -> DataFrame:
        columns = {c: F.col(f"row.`{c}`") for c in names}
        columns["text"] = F.when(F.col("cut"), F.col("text")).otherwise(columns["text"])
        if "n_chars" in names:
            columns["n_chars"] = F.when(F.col("cut"), F.char_length("text").cast(documents.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
        return df.select(*[columns[c].alias(c) for c in names])

    if _blocks(items, block_bytes) == 1:
        shared = spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in items.collect()], window))
        made = map_texts(rows, "text", _cleaner(shared), "clean string, cut boolean", ["row"], SHARD_BYTES)
        return renewed(made.withColumnRenamed("clean", "text"))
    scratch, done, rounds = Scratch(spark, "decontaminate"), [], 0
    left = rows.withColumn("cut", F.lit(False))
    while rounds == 0 or not left.isEmpty():
        found = find_contamination(left, benchmark, ["row", "text", "cut"], window, block_bytes)
        raw, hits = F.col("text").cast("binary"), F.col("hits")
        rest = F.transform(
            F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), hits["stop"]).alias("a"), F.concat(hits["start"], F.array(F.octet_length("text").cast("long"))).alias("b")),
            lambda x: F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string"),
        )
        hit = F.size("hits") > 0
        made = found.select("row", F.when(hit, F.array_join(rest, "\n")).otherwise(F.col("text")).alias("text"), (F.col("cut") | hit).alias("cut"), hit.alias("again"))
        made = scratch.table(made, f"round{rounds}")
        done.append(made.where("NOT again"))
        left, rounds = made.where("again").drop("again"), rounds + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return renewed(out)


def _uncovered(phrases: Phrases, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, offsets of documents into them, and which go until no phrase is left.

    The words that stay are a linked list. After the first search a phrase can only appear where a cut
    brought words together, so further rounds index just the words around the last cuts.
    """
    low = B.LOWER[data]
    starts, ends, words = B.word_spans(low, offsets, B.ALNUM_BYTES)
    n = len(starts)
    gone = np.zeros(n + 1, bool)
    if not phrases.by_length or not n:
        return starts, ends, words, gone[:-1]
    symbols = phrases.symbols(B.range_hashes(B.prefix_hashes(low), starts, ends))
    # the neighbours that stay; n stands for the end of a document on either side
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[words[1:][words[1:] > words[:-1]] - 1] = n
    before[words[:-1][words[1:] > words[:-1]]] = n
    after, before = np.append(after, n), np.append(before, n)
    reach = max(phrases.by_length) - 1
    hit = np.flatnonzero(_search(phrases, symbols, words)[0])
    while len(hit):
        gone[hit] = True
        # both ends of each stretch of words that just went
        left = before[hit]
        first = hit[(left == n) | ~gone[left]]
        a, b = before[first], after[first]
        while len(inner := np.flatnonzero(gone[b])):
            b[inner] = after[b[inner]]
        after[a[a < n]], before[b[b < n]] = b[a < n], a[b < n]
        joined = (a < n) & (b < n)
        a, b = a[joined], b[joined]
        if not len(a) or not reach:
            break
        around = [b]
        for _ in range(reach - 1):
            around.append(after[around[-1]])
        behind = [a]
        for _ in range(reach - 1):
            behind.append(before[behind[-1]])
        near = np.stack([*behind[::-1], *around], axis=1)
        inside = near < n
        own = near[inside]
        found = _search(phrases, symbols[own], np.concatenate([[0], np.cumsum(inside.sum(1))]))[0]
        hit = np.unique(own[found])
    return starts, ends, words, gone[:-1]


def _cleaner(shared):
    def make():
        phrases = shared.value

        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            starts, ends, words, gone = _uncovered(phrases, data, offsets)
            inner = np.concatenate([[False], gone[:-1]])
            inner[words[:-1][words[:-1] < len(gone)]] = False
            outer = np.concatenate([gone[1:], [False]])
            outer[words[1:][words[1:] > 0] - 1] = False
            first, last = np.flatnonzero(gone & ~inner), np.flatnonzero(gone & ~outer)
            bounds = np.searchsorted(first, words).tolist()
            start, stop = starts[first].tolist(), ends[last].tolist()
            out: list[str | None] = []
            for k in range(len(offsets) - 1):
                if bounds[k] == bounds[k + 1]:
                    out.append(None)
                    continue
                at, rest = int(offsets[k]), []
                for i in range(bounds[k], bounds[k + 1]):
                    rest.append(data[at : start[i]].tobytes())
                    at = stop[i]
                out.append(b"\n".join([*rest, data[at : offsets[k + 1]].tobytes()]).decode())
            return [pa.array(out, pa.string()), pa.array([x is not None for x in out])]

        return run

    return make


#: DuckDB SQL for the columns of the contract.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, len(w) AS n_words, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
f AS (SELECT o.doc_id, o.i, o.n, p.item_id FROM o JOIN p USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM f) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
