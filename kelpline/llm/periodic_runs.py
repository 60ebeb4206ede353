"""Runs of words that repeat with a period, and texts collapsed to one period of each run.

Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period q that has at least
``least`` words and ``exponent`` periods, and that no neighbouring word extends. For each q, words a
fixed distance apart (the grid; all grids together are a harmonic sum) are compared with those q words
later: every run has an agreeing pair among them. How far the agreement of a pair reaches in either
direction is a longest common extension. It is answered by a difference cover: of each V positions
only those of the cover have their suffixes sorted. Any two positions reach positions of the cover
after fewer than V words, which are compared one by one; from there on a range minimum over the common
prefixes of neighbouring suffixes tells the rest. Only documents with a stretch that is long enough to
matter get this index. A slice of whole documents is indexed in one task, and nothing is shuffled.

Words are told by 64-bit hashes of their bytes. Defined results: null, empty and blank texts have no
words, no runs and an empty collapsed text. Rows that repeat an id are judged each by itself, and extra
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .maptext import map_texts

#: A perfect difference set: each residue modulo V but 0 is the difference of one pair.
V, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
#: For each difference, the cover's position that the smaller one of a pair is led to.
_LED = np.zeros(V, np.int64)
for _x in COVER:
    _LED[(COVER - _x) % V] = _x
#: Pairs of the grid that are compared at once.
PAIRS = 1 << 20
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _agree(ids: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray, sign: int) -> np.ndarray:
    """How many words from i and j on agree, one by one, at most ``room`` of each pair."""
    out, live = np.zeros(len(i), np.int64), np.flatnonzero(room > 0)
    k = 0
    while len(live):
        live = live[ids[i[live] + sign * k] == ids[j[live] + sign * k]]
        k += 1
        out[live] = k
        live = live[room[live] > k]
    return out


class CoverIndex:
    """Longest common extensions of positions in a sequence of whole numbers from 0 on."""

    def __init__(self, ids: np.ndarray):
        self.ids, n, c = ids, len(ids), len(COVER)
        at = (np.arange((n + V - 1) // V)[:, None] * V + COVER).ravel()
        m = int(np.searchsorted(at, n))
        at = at[:m]
        self.slot = np.full(V, -1)
        self.slot[COVER] = np.arange(c)
        # the first V words of each sampled suffix, several to a key
        bits = int(ids.max(initial=0) + 1).bit_length()
        some = max(1, 62 // bits)
        padded = np.concatenate([ids + 1, np.zeros(V + 1, np.int64)])
        keys = []
        for k in range(0, V, some):
            key = np.zeros(m, np.int64)
            for d in range(k, min(k + some, V)):
                key = (key << bits) | padded[at + d]
            keys.append(key)
        rank = self._rank(keys)
        ranks, shift = [rank], c  # the sample V words later stands c places later
        while m and rank.max() < m - 1 and shift < m:
            ahead = np.full(m, -1)
            ahead[: m - shift] = rank[shift:]
            rank = self._rank([rank, ahead])
            ranks.append(rank)
            shift *= 2
        self.rank, order = rank, np.empty(m, np.int64)
        order[rank] = np.arange(m)
        # common prefixes of neighbours: by equal ranks of halving stretches, then by words
        a, b, words = order[:-1].copy(), order[1:].copy(), np.zeros(max(m - 1, 0), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
            a[same] += c << level
            b[same] += c << level
            words[same] += V << level
        pa_, pb = at[order[:-1]] + words, at[order[1:]] + words
        words += _agree(ids, pa_, pb, n - np.maximum(pa_, pb), 1)
        self.least = [words]
        while 2 << (len(self.least) - 1) <= len(words):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    @staticmethod
    def _rank(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            k = key[order]
            new[1:] |= k[1:] != k[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on (i < j) agree."""
        n = len(self.ids)
        lead = (_LED[(j - i) % V] - i) % V
        out = _agree(self.ids, i, j, np.minimum(lead, n - j), 1)
        far = np.flatnonzero((out == lead) & (j + lead < n))
        p, q = i[far] + lead[far], j[far] + lead[far]
        a, b = (self.rank[x // V * len(COVER) + self.slot[x % V]] for x in (p, q))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        rest = np.zeros(len(far), np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            rest[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k)])
        out[far] += rest
        return out


def _grid(ids: np.ndarray, words: np.ndarray, exponent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """document, place and period of the agreeing pairs of all grids."""
    n = np.diff(words)
    most = np.where(n >= least, np.maximum(n // exponent, 1), 0)
    doc = np.repeat(np.arange(len(n)), most)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(least, exponent * q) - q
    count = np.maximum(0, -((q - n[doc]) // step))
    ends, a = np.cumsum(count), 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        c = count[a:b]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        i, p, d = k * np.repeat(step[a:b], c) + np.repeat(words[doc[a:b]], c), np.repeat(q[a:b], c), np.repeat(doc[a:b], c)
        same = np.flatnonzero(ids[i] == ids[i + p])
        yield d[same], i[same], p[same]
        a = b


def find_runs(ids: np.ndarray, words: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, start (in ``ids``), length and period of all runs, by document, start and period; words: offsets of documents."""
    found = []
    for d, i, q in _grid(ids, words, exponent, least):
        # at least ``least`` - 1 neighbouring pairs have to agree; chance agreements end here
        some = np.full(len(i), max(least, exponent) - 1)
        near = _agree(ids, i, i + q, np.minimum(some, words[d + 1] - i - q), 1) + _agree(ids, i - 1, i + q - 1, np.minimum(some, i - words[d]), -1)
        stay = near >= np.minimum(some, np.maximum(least, exponent * q) - q)
        found.append((d[stay], i[stay], q[stay]))
    d, i, q = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
    if not len(d):
        return d, i, i, q
    # the documents that are left, one after another
    own = np.unique(d)
    size = words[own + 1] - words[own]
    to = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(to[-1]) - np.repeat(to[:-1] - words[own], size)
    text = np.unique(ids[place], return_inverse=True)[1].astype(np.int64)
    k = np.searchsorted(own, d)
    at = i - words[d] + to[k]
    n = len(text)
    ahead = np.minimum(CoverIndex(text).extend(at, at + q), to[k + 1] - at - q)
    behind = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > to[k])
    behind[inner] = np.minimum(CoverIndex(text[::-1].copy()).extend(n - at[inner] - q[inner], n - at[inner]), at[inner] - to[k[inner]])
    good = ahead + behind >= np.maximum(least, exponent * q) - q
    start, length = (i - behind)[good], (ahead + behind + q)[good]
    d, q = d[good], q[good]
    # multiples of a run's period give the same stretch
    order = np.lexsort((q, length, start))
    d, start, length, q = d[order], start[order], length[order], q[order]
    first = np.ones(len(d), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    d, start, length, q = d[first], start[first], length[first], q[first]
    order = np.lexsort((q, start))
    return d[order], start[order], length[order], q[order]


def periodic_runs(documents: DataFrame, column: str, carry: list[str], exponent: int = 4, least: int = 6) -> DataFrame:
    """``carry``, then n_words, runs (start, length, period, in words; by start, then period) and the collapsed text.

    The collapsed text has, joined by single spaces, the words that no run holds after its first period.
    """
    def make():
        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            docs = len(offsets) - 1
            starts, ends, words = B.word_spans(data, offsets, B.WORD_BYTES)
            ids = np.unique(B.range_hashes(B.prefix_hashes(data), starts, ends), return_inverse=True)[1].astype(np.int64)
            d, start, length, q = find_runs(ids, words, exponent, least)
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, start + q, 1)
            np.add.at(cover, start + length, -1)
            keep = np.cumsum(cover[:-1]) == 0
            # bytes of kept words, each with one byte after it, out of a copy with room between documents
            room, where = np.full(len(data) + docs, 32, np.uint8), np.repeat(np.arange(docs), np.diff(words))
            for k in range(docs):
                room[offsets[k] + k : offsets[k + 1] + k] = data[offsets[k] : offsets[k + 1]]
            a, b = (starts + where)[keep], (ends + where)[keep]
            room[b] = 32
            mark = np.zeros(len(room) + 1, np.int8)
            mark[a] += 1
            mark[b + 1] -= 1
            text = room[np.cumsum(mark[:-1], dtype=np.int8) > 0]
            sizes = np.bincount(where[keep], weights=b - a + 1, minlength=docs).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            raw = text.tobytes()
            collapsed = pa.array([raw[x : max(x, y - 1)] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())
            bounds = pa.array(np.searchsorted(d, np.arange(docs + 1)).astype(np.int32))
            runs = pa.StructArray.from_arrays([pa.array(start - words[d]), pa.array(length), pa.array(q)], names=["start", "length", "period"])
            return [pa.array(np.diff(words)), pa.ListArray.from_arrays(bounds, runs), collapsed]

        return run

    return map_texts(documents, column, make, RESULT, carry)


def run_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs and of the collapsed text.

    Every tenth document, by the checksum of its doc_id, first has the rest of its words from some place
    on replaced by repetitions of the words there, so that there are runs to find.
    """
    words, h = F.col("w"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.floor(h / 10).alias("g"), (F.coalesce(h % 10, F.lit(1)) == 0).alias("planted"))
    rows = rows.withColumn("w", F.when(F.col("planted"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    n = F.size(words)
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    unit = F.slice(words, (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), (n - F.col("a")).cast("int"))
    text = F.when(F.col("planted") & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a").cast("int")), tail), " ")).otherwise(F.col("text"))
    found = periodic_runs(rows.select("doc_id", text.alias("text")), "text", ["doc_id"])
    best = F.array_sort("runs", lambda x, y: F.coalesce(F.nullif(y["length"] - x["length"], F.lit(0)), F.nullif(x["start"] - y["start"], F.lit(0)), x["period"] - y["period"]).cast("int"))
    found = found.withColumn("best", F.try_element_at(best, F.lit(1)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
