"""Language-model scores by online logistic context mixing.

A text is its words (A-Z lower-cased) and one end. Each is coded as binary decisions: a walk down a
Huffman tree over the training corpus' most frequent words (those seen twice or more), the end, and
an escape. After an escape the word is spelled, byte by byte, along a Huffman tree of bytes.

For each decision several hashed contexts give a prediction from the corpus' bit counts. Words: the
word before, the two words before, and the last very frequent word (which tells the language).
Spelling: three bytes before, the word so far, and two bytes with the last frequent word. Where no
context was seen, what the trees' shape says stands. A mixer adds them in the logistic domain with weights from the set that a gate picks
(how often the contexts were seen) plus what the text itself has taught it so far; an adaptive
probability map refines the result. What is learnt from a text is kept to its end: the weights and
the map move on after each ``BLOCK`` decisions, which lets a task work on many texts side by side.

An escaped word's probability joins two sources: the exact count of the word in the corpus with a
discount (Spark joins these counts, whose table grows with the corpus without bound), and its
spelling for the mass that the discounts leave.

Spark gathers, over all training texts: word and byte counts, then the bit counts of every context,
summed in chunks of slots. The weights to start from are learnt in that same pass, progressively: a
task predicts every decision of every text from the counts of its texts before, counts these few
texts while their slots are still in the cache, and steps its weights after each slice; no text is
its own witness. Spark averages the tasks' weights. Broadcast are tables of fixed size and ``VOCABULARY`` words.

Defined results: null and empty texts consist of the end alone. Rows that repeat a doc_id are
scored, and count in training, each by itself; a null doc_id is held in. An empty table gives no
rows; without training texts every count is 0. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .maptext import let_go, map_texts
from .store import Scratch, partitions
from .toxicity import held_out

INPUTS = 3
#: log2 of the slots of each context, for words and for spelling.
WORD_BITS, SPELL_BITS = (21, 21, 21), (19, 20, 19)
#: Words in the tree, and whose counts the tasks hold, at most; of them, words so frequent that they tell a language.
VOCABULARY, FREQUENT = (1 << 18) - 4, 192
#: Counts from which a context counts as seen rarely, sometimes, often.
SEEN = (1, 4, 40)
GATES = 64
#: Leading bits of a word's hash that find its place among the frequent words.
PREFIX = 20
BLOCK, BUCKETS = 256, 24
#: Bytes of text whose texts are scored side by side, and whose decisions are listed at once.
SLICE, PART = 1 << 20, 192 << 10
#: Decisions of whole texts whose counts are read and then raised at once, and decisions that are worked on at once.
STRETCH, TILE = 1 << 14, 1 << 17
RATE, MAP_RATE, START_WEIGHT, LEAST = 0.003, 0.02, 0.3, 1 / (1 << 22)
ADDED, STEP = 0.15, 512
#: Slots whose counts travel as one row.
CHUNK = 1 << 10
END_WORD = np.int64(0x5EED0E4D)
_GOLDEN = np.uint32(0x9E3779B1)


class Code:
    """A Huffman code of symbols 0..n-1: path lengths, and each path's nodes and bits from the root on."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        weight = np.append(counts[order].astype(np.float64), np.inf).tolist()
        up, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
        made, leaf, inner = [], 0, 0
        name = order.tolist()
        for k in range(n - 1):  # the two lightest of both queues
            pair = []
            for _ in range(2):
                if leaf < n and (inner >= len(made) or weight[leaf] <= made[inner]):
                    pair.append((name[leaf], weight[leaf]))
                    leaf += 1
                else:
                    pair.append((n + inner, made[inner]))
                    inner += 1
            up[pair[0][0]] = up[pair[1][0]] = n + k
            side[pair[1][0]] = 1
            made.append(pair[0][1] + pair[1][1])
        root, at, levels = 2 * n - 2, np.arange(n), []
        self.length = np.zeros(n, np.int32)
        while n > 1 and (at != root).any():
            live = at != root
            self.length += live
            levels.append((np.where(live, up[at] - n, 0).astype(np.int32), np.where(live, side[at], 0).astype(np.uint8)))
            at = np.where(live, up[at], root)
        self.start = np.cumsum(self.length) - self.length
        self.step = np.zeros(int(self.length.sum()), np.int32)  # 2 * node + bit
        for height, (node, bit) in enumerate(levels):
            own = np.flatnonzero(self.length > height)
            place = self.start[own] + self.length[own] - 1 - height
            self.step[place] = node[own] * 2 + bit[own]

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many decisions each symbol takes, and all of them as 2 * node + bit."""
        size = self.length[symbols]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[symbols] - (ends - size), size)
        return size, self.step.take(flat)


class Stream:
    """The decisions of some texts in one of the two codes: slots (INPUTS, n), bits, symbol sizes."""

    def __init__(self, code: Code, symbols: np.ndarray, contexts: list[np.ndarray], widths: tuple[int, ...], base: int):
        self.size, step = code.decisions(symbols)
        self.slots, self.bit = np.empty((INPUTS, len(step)), np.intp), (step & 1).astype(np.uint8)
        step >>= 1
        hashed = step.view(np.uint32) * _GOLDEN
        for row, (context, width) in enumerate(zip(contexts, widths, strict=True)):
            v = np.repeat(context, self.size)
            v ^= hashed
            v >>= np.uint32(32 - width)
            v += np.uint32(base)
            self.slots[row] = v
            base += 1 << width


WORD_BASE, SPELL_BASE = 0, sum(1 << b for b in WORD_BITS)
SLOTS = SPELL_BASE + sum(1 << b for b in SPELL_BITS)


class Vocabulary:
    """The frequent words (sorted by hash) with counts, and both codes. Symbols of words are ranks by count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_ends: int, n_train: int, byte_counts: np.ndarray):
        rank = np.lexsort((keys, -counts))
        self.n_words = int((counts >= 2).sum())
        symbol = np.empty(len(keys), np.int32)
        symbol[rank] = np.arange(len(keys))
        self.end, self.escape = self.n_words, self.n_words + 1
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.symbol = np.minimum(symbol[order], self.escape)
        self.symbol[self.counts < 2] = self.escape
        # where the keys of each leading PREFIX bits begin
        self.first = np.searchsorted(self._leading(self.keys), np.arange((1 << PREFIX) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))
        inside = np.sort(counts[counts >= 2])[::-1]
        escaped = n_train - n_ends - int(inside.sum())
        self.words = Code(np.concatenate([inside, [n_ends + 0.5, escaped + 0.5]]))
        self.letters = Code(byte_counts + 0.01)

    @staticmethod
    def _leading(keys: np.ndarray) -> np.ndarray:
        return (keys >> (64 - PREFIX)) + (1 << (PREFIX - 1))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, counts, and whether the count is known here."""
        if not len(self.keys):
            return np.full(len(hashes), self.escape, np.int32), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.first.take(self._leading(hashes))
        for _ in range(self.most):  # few keys share their leading bits
            at += self.keys.take(at, mode="clip") < hashes
        np.minimum(at, len(self.keys) - 1, out=at)
        found = self.keys.take(at) == hashes
        return np.where(found, self.symbol[at], self.escape), np.where(found, self.counts[at], 0), found


class Sliced:
    """Words of some texts, and both streams of decisions."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        low = B.LOWER[data]
        starts, ends, words = B.word_spans(low, offsets, B.WORD_BYTES)
        prefix = B.prefix_hashes(low)
        self.hashes, self.words = B.range_hashes(prefix, starts, ends).view(np.int64), words
        symbol, self.counts, self.known = vocabulary.look_up(self.hashes)
        n = len(words) - 1
        # tokens: each text's words, then its end
        doc = B.owners(words)
        self.bounds = words + np.arange(n + 1)
        place = np.arange(len(starts)) + doc
        tokens, mixed = np.full(self.bounds[-1], vocabulary.end, np.int32), np.zeros(self.bounds[-1], np.uint32)
        tokens[place] = symbol
        mixed[place] = (self.hashes.view(np.uint64) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        first = np.repeat(self.bounds[:-1], np.diff(self.bounds))
        at = np.arange(len(tokens))
        before = np.zeros(len(tokens), np.uint32)
        before[1:] = mixed[:-1]
        before[self.bounds[:-1]] = 0
        older = np.zeros(len(tokens), np.uint32)
        older[2:] = mixed[:-2]
        older[at - first < 2] = 0
        last = np.maximum.accumulate(np.where(tokens < min(FREQUENT, vocabulary.n_words), at + 1, 0))
        last = np.concatenate([[0], last[:-1]])
        tells = np.where(last > first, tokens[np.maximum(last - 1, 0)] + 1, 0).astype(np.uint32) * np.uint32(0x85EBCA6B)
        tells ^= tells >> np.uint32(15)
        pair = (older * np.uint32(0xC2B2AE35) + before) * np.uint32(0x27D4EB2F)
        pair ^= pair >> np.uint32(13)
        self.word = Stream(vocabulary.words, tokens, [before, pair, tells], WORD_BITS, WORD_BASE)
        self.doc_ends = np.concatenate([[0], np.cumsum(self.word.size)])[self.bounds]
        self.n_bytes = np.diff(np.concatenate([[0], np.cumsum(B.WORD_BYTES[data])])[offsets]) + np.diff(self.bounds)
        # escaped words, spelled with a space at the end
        self.escaped = np.flatnonzero(symbol == vocabulary.escape)
        a, length = starts[self.escaped], ends[self.escaped] - starts[self.escaped]
        self.letters = np.concatenate([[0], np.cumsum(length + 1)])
        within = np.arange(self.letters[-1]) - np.repeat(self.letters[:-1], length + 1)
        source = np.repeat(a, length + 1) + within
        text = low[np.minimum(source, max(0, len(low) - 1))] if len(low) else np.zeros(0, np.uint8)
        text[self.letters[1:] - 1] = 32
        back, wide = [], text.astype(np.uint32) + np.uint32(1)
        for j in (1, 2, 3):
            b = np.zeros(len(text), np.uint32)
            b[j:] = wide[:-j]
            b[within < j] = 0
            back.append(b)
        two = (back[0] + back[1] * np.uint32(263)) * np.uint32(0x85EBCA77)
        three = (back[0] + back[1] * np.uint32(263) + back[2] * np.uint32(69169)) * np.uint32(0xC2B2AE3D)
        three ^= three >> np.uint32(15)
        so_far = (B.range_hashes(prefix, np.repeat(a, length + 1), source) >> np.uint64(32)).astype(np.uint32)
        with_tell = (two ^ (two >> np.uint32(14))) + np.repeat(tells[place[self.escaped]], length + 1)
        self.spelling = Stream(vocabulary.letters, text, [three, so_far, with_tell * np.uint32(0x27D4EB2F)], SPELL_BITS, SPELL_BASE)
        self.spelled = np.concatenate([[0], np.cumsum(self.spelling.size)])[self.letters]
        self.spell_doc_ends = self.spelled[np.searchsorted(self.escaped, words)]


def _weights(odds: list[np.ndarray], gate: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros(len(gate), np.float32)
    for k in range(INPUTS):
        term = start[:, k].take(gate)
        term *= odds[k]
        out += term
    return out


class Mixer:
    """Log odds and seen class by slot (int16), and each gate's starting weights for both streams."""

    def __init__(self, table: np.ndarray, start: np.ndarray):
        self.table, self.start = table, start.astype(np.float32)

    def inputs(self, slots: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        odds, gate = [], None
        for k in range(INPUTS):
            cell = self.table.take(slots[k])
            seen = cell & np.int16(3)
            gate = seen if gate is None else gate * np.int16(4) + seen
            cell >>= 2
            x = cell.astype(np.float32)
            x *= 1 / STEP
            odds.append(x)
        return odds, gate.astype(np.intp)

    def prepared(self, stream: Stream, which: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Inputs, the gated weights' sum, and bits; the stream's slots aren't needed any more."""
        odds, gate = self.inputs(stream.slots)
        del stream.slots
        return odds, _weights(odds, gate, self.start[which]), stream.bit

    def log_odds(self, parts: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], ends: list[np.ndarray]) -> list[np.ndarray]:
        """Natural log probability of each decision as it fell; in each part, texts are given by offsets of their decisions."""
        size = np.concatenate([np.diff(e) for e in ends])
        counts = -(-size // BLOCK)
        total = int(counts.sum())
        rows = np.cumsum(counts) - counts
        x, z0 = np.zeros((INPUTS, total * BLOCK), np.float32), np.zeros(total * BLOCK, np.float32)
        bit = np.full(total * BLOCK, 0.5, np.float32)
        places = []
        for (odds, first, bits), own in zip(parts, ends, strict=True):
            at = len(places)
            places += (rows[at : at + len(own) - 1] * BLOCK).tolist()
            for to, a, b in zip(places[at:], own[:-1].tolist(), own[1:].tolist(), strict=True):
                here = slice(to, to + b - a)
                for k in range(INPUTS):
                    x[k, here] = odds[k][a:b]
                z0[here], bit[here] = first[a:b], bits[a:b]
            odds.clear()
        result = self._run(x.reshape(INPUTS, total, BLOCK), z0.reshape(total, BLOCK), bit.reshape(total, BLOCK), rows, counts).reshape(-1)
        out, at = [], 0
        for own in ends:
            values = np.empty(int(own[-1]), np.float32)
            for to, a, b in zip(places[at : at + len(own) - 1], own[:-1].tolist(), own[1:].tolist(), strict=True):
                values[a:b] = result[to : to + b - a]
            out.append(values)
            at += len(own) - 1
        return out

    @staticmethod
    def _run(x: np.ndarray, z0: np.ndarray, bit: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Block after block of all texts. Padding has bit 0.5 and teaches nothing."""
        lanes = np.argsort(-counts, kind="stable")
        lanes = lanes[counts[lanes] > 0]
        live = np.searchsorted(-counts[lanes], -np.arange(int(counts.max(initial=0))), "left")
        more = np.zeros((len(lanes), INPUTS), np.float32)
        centres = ((np.arange(BUCKETS) + 0.5) / BUCKETS * 24 - 12).astype(np.float32)
        refined = np.tile(1 / (1 + np.exp(-centres)), len(lanes)).astype(np.float32)
        out, work = np.empty_like(z0), np.empty((len(lanes), z0.shape[1]), np.float32)
        places = (np.arange(len(lanes)) * BUCKETS)[:, None]
        for s, n in enumerate(live.tolist()):
            at = rows[lanes[:n]] + s
            own, y, z = [x[k].take(at, axis=0) for k in range(INPUTS)], bit.take(at, axis=0), z0.take(at, axis=0)
            for k in range(INPUTS):
                z += np.multiply(more[:n, k, None], own[k], out=work[:n])
            np.clip(z, -11.99, 11.99, out=z)
            p = np.negative(z, out=work[:n])
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            wrong = y - p
            for k in range(INPUTS):
                # padding has inputs of 0
                more[:n, k] += RATE * np.einsum("ab,ab->a", wrong, own[k])
            z += 12
            z *= BUCKETS / 24
            cell = z.astype(np.intp)
            cell += places[:n]
            r = refined.take(cell)
            # a cell moves by its mean error; padding lies half way, which is where its inputs put it
            seen = np.bincount(cell.reshape(-1), minlength=n * BUCKETS).astype(np.float32)
            np.subtract(y, r, out=wrong)
            error = np.bincount(cell.reshape(-1), wrong.reshape(-1), n * BUCKETS).astype(np.float32)
            p *= 0.75
            r *= 0.25
            p += r
            refined[: n * BUCKETS] += MAP_RATE * error / (1 + MAP_RATE * seen)
            p += y
            p -= 1  # now the probability of what fell, but for the sign
            np.abs(p, out=p)
            np.maximum(p, LEAST, out=p)
            out[at] = np.log(p, out=p)
        return out


class Learner:
    """A task's bit counts, and weights that follow them slice by slice."""

    def __init__(self):
        self.flat = np.zeros(2 * SLOTS, np.uint32)
        self.start = np.full((2, GATES, INPUTS), START_WEIGHT)
        self.curve = np.tile(np.eye(INPUTS) * 20.0, (2, GATES, 1, 1))
        self.used = np.zeros((2, GATES))

    def learn(self, stream: Stream, which: int, ends: np.ndarray | None = None) -> None:
        """Predict the decisions, count them, step the weights. ``ends`` are the offsets of the texts (none: it is one text)."""
        if len(stream.bit):
            ends = np.array([0, len(stream.bit)]) if ends is None else ends
            stretches = [slice(int(ends[a]), int(ends[b])) for a, b in B.slices(ends, STRETCH)]
            self._step(stream.slots, stream.bit, which, stretches)

    def _counted(self, slots: np.ndarray, bit: np.ndarray, stretches: list[slice]) -> np.ndarray:
        """Both counts of each slot in one number, as they were before its stretch; the decisions are counted."""
        out, both = np.empty(slots.shape, "<u8"), self.flat.view("<u8")
        # a stream's inputs have slots of their own, so they take turns in the cache; one stretch alone is read as a whole first
        for rows in [[k] for k in range(INPUTS)] if len(stretches) > 1 else [range(INPUTS)]:
            for own in stretches:
                for k in rows:
                    both.take(slots[k, own], out=out[k, own], mode="clip")  # every slot is inside; only this mode writes to out directly
                for k in rows:
                    at = slots[k, own] * 2
                    at += bit[own]
                    np.add.at(self.flat, at, np.uint32(1))
        return out

    def _step(self, slots: np.ndarray, bit: np.ndarray, which: int, stretches: list[slice]) -> None:
        cells = self._counted(slots, bit, stretches)
        x, gate = np.empty(slots.shape, np.float32), np.zeros(slots.shape[1], np.uint8)
        for a in range(0, len(bit), TILE):
            own = gate[a : a + TILE]
            for row, odds in zip(cells[:, a : a + TILE], x[:, a : a + TILE], strict=True):
                n0, n1 = (half.astype(np.float32) for half in row.view("<u4").reshape(-1, 2).T)
                n = n0 + n1
                own <<= 2
                for seen in SEEN:
                    own += (n >= seen).view(np.uint8)
                n1 += np.float32(ADDED)
                n0 += np.float32(ADDED)
                n1 /= n0
                np.log(n1, out=odds)
        del cells
        # the decisions of a gate lie side by side, so its sums run over whole stretches
        order, used = np.argsort(gate, kind="stable"), np.bincount(gate, minlength=GATES)
        names = np.flatnonzero(used)
        ends = np.cumsum(used[names])
        start = self.start[which]
        weights, work = start.T.astype(np.float32), np.empty(min(TILE, len(bit)), np.float32)
        slope, curve = np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS))
        for a in range(0, len(bit), TILE):
            at = order[a : a + TILE]
            here = slice(np.searchsorted(ends, a, "right"), np.searchsorted(ends, a + len(at), "left") + 1)
            gates, until = names[here], np.minimum(ends[here] - a, len(at))
            first = np.concatenate([[0], until[:-1]])
            own, p, term = [row.take(at) for row in x], np.zeros(len(at), np.float32), work[: len(at)]
            for k in range(INPUTS):
                p += np.multiply(np.repeat(weights[k, gates], until - first), own[k], out=term)
            np.clip(p, -12, 12, out=p)
            np.exp(np.negative(p, out=p), out=p)
            p += 1
            np.reciprocal(p, out=p)
            wrong = bit.take(at) - p
            p *= 1 - p
            for i in range(INPUTS):
                slope[gates, i] += np.add.reduceat(np.multiply(wrong, own[i], out=term), first)
                weighted = p * own[i]
                for j in range(i, INPUTS):
                    curve[gates, i, j] += np.add.reduceat(np.multiply(weighted, own[j], out=term), first)
        for i in range(INPUTS):
            curve[:, i:, i] = curve[:, i, i:]
        self.curve[which] = self.curve[which] * 0.97 + curve
        start += np.clip(np.linalg.solve(self.curve[which], slope[:, :, None])[:, :, 0], -0.2, 0.2)
        self.used[which] += used


def _slices(batches):
    for batch in batches:
        data, offsets = B.text_buffers(batch.column(0))
        for a, b in B.slices(offsets, PART):
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _corpus_counts(batches):
    """Byte counts (kind 0) and word counts (kind 1) of a task's texts."""
    size = np.zeros(256, np.int64)
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts: list[np.ndarray] = []

    def folded():
        key, n = np.unique(np.concatenate([keys[:0], *parts]), return_counts=True)
        at = np.searchsorted(keys, key)  # both are sorted
        old = at < len(keys)
        old[old] = keys[at[old]] == key[old]
        sums[at[old]] += n[old]
        return np.insert(keys, at[~old], key[~old]), np.insert(sums, at[~old], n[~old])

    for data, offsets in _slices(batches):
        low = B.LOWER[data]
        starts, ends, _ = B.word_spans(low, offsets, B.WORD_BYTES)
        seen = np.bincount(low, minlength=256) * B.WORD_BYTES
        seen[32] = len(starts)
        size += seen
        parts += [B.range_hashes(B.prefix_hashes(low), starts, ends).view(np.int64), np.full(len(offsets) - 1, END_WORD)]
        if sum(map(len, parts)) > 1_000_000:
            keys, sums = folded()
            parts = []
    keys, sums = folded()
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(256, np.int32)), pa.array(np.arange(256)), pa.array(size)], names=["kind", "key", "n"])
    for a in range(0, len(keys), 1 << 16):
        part = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys[part]), np.int32)), pa.array(keys[part]), pa.array(sums[part])], names=["kind", "key", "n"])
    del keys, sums, parts
    let_go()


def _rows(chunks: list[int], cells: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(cells, pa.binary())], names=["chunk", "cells"])


def _bit_counts(shared):
    """Each task's counts by chunk of slots, the bytes of equal weight together (they compress); chunk -1 has its weights."""

    def run(batches):
        vocabulary, learner = shared.value, Learner()
        for data, offsets in _slices(batches):
            part = Sliced(vocabulary, data, offsets)
            learner.learn(part.word, 0, part.doc_ends)
            learner.learn(part.spelling, 1, part.spell_doc_ends)
        counts = learner.flat.reshape(-1, 2 * CHUNK)
        used = np.flatnonzero(counts.any(1))
        for a in range(0, len(used), 256):
            own = used[a : a + 256]
            planes = counts[own].view(np.uint8).reshape(len(own), -1, 4).transpose(0, 2, 1)
            yield _rows(own.tolist(), [x.tobytes() for x in planes])
        if len(used):
            yield _rows([-1], [np.concatenate([(learner.start * learner.used[:, :, None]).reshape(-1), learner.used.reshape(-1)]).tobytes()])
        del learner, counts
        let_go()

    return run


def _summed(batches):
    """Chunks summed as they arrive: a task holds its own chunks only. Out come int16 cells, and for -1 the weights."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = cells.as_buffer()
            if chunk < 0:
                value = np.frombuffer(raw, np.float64)
            else:
                planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
                value = np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1).astype(np.int64)
            if chunk in sums:
                sums[chunk] += value
            else:
                sums[chunk] = value.copy()
    done: tuple[list[int], list[bytes]] = [], []
    for chunk, value in sums.items():
        if chunk < 0:
            weights, used = value[: 2 * GATES * INPUTS].reshape(2, GATES, INPUTS), value[2 * GATES * INPUTS :].reshape(2, GATES, 1)
            out = np.where(used > 0, weights / np.maximum(used, 1), START_WEIGHT).tobytes()
        else:
            n0, n1 = value[0::2], value[1::2]
            # log odds in steps of 1 / STEP, and the seen class in the lowest two bits
            odds = np.clip(np.round(np.log((n1 + ADDED) / (n0 + ADDED)) * STEP), -8191, 8191).astype(np.int16)
            out = (odds * np.int16(4) + np.searchsorted(SEEN, n0 + n1, "right").astype(np.int16)).tobytes()
        done[0].append(chunk)
        done[1].append(out)
    if sums:
        yield _rows(*done)


def escaped_log10(spelled: np.ndarray, counts: np.ndarray, discount: float, known: float, fresh: float) -> np.ndarray:
    """log10 of (count - discount) / known + fresh * 10**spelled; see ``score_documents``."""
    tail = np.log10(fresh) + spelled
    with np.errstate(divide="ignore"):
        return np.where(counts > 0, np.log10(np.maximum(counts - discount, 0) / known + 10.0 ** np.maximum(tail, -300)), tail)


def score_texts(mixer: Mixer, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[Sliced, np.ndarray, np.ndarray]]:
    """Parts of the texts, and log10 probabilities: each text's words, ends and escapes; each escaped word's spelling."""
    parts, words, letters = [], [], []
    for a, b in B.slices(offsets, PART):
        part = Sliced(vocabulary, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(part)
        words.append(mixer.prepared(part.word, 0))
        letters.append(mixer.prepared(part.spelling, 1))
    words = mixer.log_odds(words, [p.doc_ends for p in parts])
    letters = mixer.log_odds(letters, [p.spell_doc_ends for p in parts])
    # every text has its end and every escaped word a letter, so no sum is empty
    sums = lambda x, ends: np.add.reduceat(x, ends[:-1]).astype(np.float64) / np.log(10)
    for part, word, letter in zip(parts, words, letters, strict=True):
        yield part, sums(word, part.doc_ends), sums(letter, part.spelled)


def _scorer(shared):
    def make():
        mixer, vocabulary, terms = shared.value

        def one(part: Sliced, score: np.ndarray, spelled: np.ndarray) -> list[pa.Array]:
            per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[part.words])
            held = part.known[part.escaped]
            here = np.zeros(len(part.hashes))
            here[part.escaped[held]] = escaped_log10(spelled[held], part.counts[part.escaped[held]], *terms)
            outside = part.escaped[~held]
            bounds = np.searchsorted(outside, part.words).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(part.hashes[outside]), pa.array(spelled[~held])], names=["key", "spelled"])
            return [
                pa.array(score + per_text(here)), pa.array(np.diff(part.bounds)), pa.array(per_text(part.counts > 0).astype(np.int64)),
                pa.array(per_text(np.log10(part.counts + 1.0))), pa.array(part.n_bytes), pa.ListArray.from_arrays(pa.array(bounds), rare),
            ]

        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            made = [one(*x) for x in score_texts(mixer, vocabulary, data, offsets)]
            return [pa.concat_arrays(column) for column in zip(*made, strict=True)]

        return run

    return make


RESULT = "score double, n_tokens long, known long, logs double, n_bytes long, rare array<struct<key:long,spelled:double>>"


def score_documents(documents: DataFrame, common: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns only where crc32 of the doc_id as text, modulo 7, is not 2. base_score is the add-one
    unigram log10 probability of the words and the end; score is the model's. An escaped word of
    count c has probability max(c - d, 0) / R + d * T / R * spelling, with the discount d from the
    counts of counts, and R tokens of T types outside the tree. ``common``: words whose counts tasks
    hold; all others' are joined.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lm")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    training = texts.where(~held_out("doc_id", 7, 2)).select("text")
    gathered = scratch.table(training.mapInArrow(_corpus_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = gathered.where("kind = 1").select("key", "n")
    is_end = F.col("key") == F.lit(int(END_WORD))
    totals = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.coalesce(F.sum(F.when(is_end, F.col("n"))), F.lit(0)).alias("ends"),
        F.count_if((F.col("n") == 1) & ~is_end).alias("n1"), F.count_if((F.col("n") == 2) & ~is_end).alias("n2"),
    ).first()
    n_train, n_types, n_ends = int(totals["tokens"]), int(totals["types"]), int(totals["ends"])
    letters = np.zeros(256)
    for r in gathered.where("kind = 0").collect():
        letters[r["key"]] = r["n"]
    top = words.where(~is_end).orderBy(F.desc("n"), "key").limit(common).toArrow()
    keys, counts = top["key"].to_numpy(), top["n"].to_numpy()
    vocabulary = Vocabulary(keys, counts, n_ends, n_train, letters)
    inside = counts >= 2
    known, types = n_train - n_ends - int(counts[inside].sum()), n_types - (n_ends > 0) - int(inside.sum())
    discount = min(0.95, max(0.05, totals["n1"] / (totals["n1"] + 2 * totals["n2"]))) if totals["n1"] else 0.5
    terms = (discount, float(max(known, 1)), discount * types / known if known else 1.0)
    del top, keys, counts

    shared = spark.sparkContext.broadcast(vocabulary)
    chunks = training.mapInArrow(_bit_counts(shared), "chunk int, cells binary").repartition(partitions(spark), "chunk")
    got = scratch.table(chunks.mapInArrow(_summed, "chunk int, cells binary"), "cells").toArrow()
    shared.destroy()
    table, start = np.zeros(SLOTS, np.int16), np.full((2, GATES, INPUTS), START_WEIGHT)
    for chunk, cells in zip(got["chunk"].to_pylist(), got["cells"], strict=True):
        if chunk < 0:
            start = np.frombuffer(cells.as_buffer(), np.float64).reshape(start.shape)
        else:
            table[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(cells.as_buffer(), np.int16)
    del got
    shared = spark.sparkContext.broadcast((Mixer(table, start), vocabulary, terms))
    del table, vocabulary
    let_go()

    scored = scratch.table(map_texts(texts, "text", _scorer(shared), RESULT, ["doc_id"], slice_bytes=SLICE).withColumn("row", F.monotonically_increasing_id()), "scored")
    shared.destroy()
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.key").alias("key"), F.col("r.spelled").alias("spelled")).join(words.where(~is_end), "key", "left")
    tail = F.col("spelled") + float(np.log10(terms[2]))
    own = F.log10(F.greatest(F.col("n") - discount, F.lit(0.0)) / terms[1] + F.pow(F.lit(10.0), F.greatest(tail, F.lit(-300.0))))
    rare = rare.groupBy("row").agg(F.count("n").alias("more"), F.coalesce(F.sum(F.log10(F.col("n") + 1.0)), F.lit(0.0)).alias("more_logs"), F.sum(F.when(F.col("n").isNull(), tail).otherwise(own)).alias("more_score"))
    out = scored.drop("rare").join(rare, "row", "left")
    zero = F.lit(0)
    base = F.col("logs") + F.coalesce("more_logs", zero) + float(np.log10(n_ends + 1)) - F.col("n_tokens") * float(np.log10(n_train + n_types + 1))
    score = F.col("score") + F.coalesce("more_score", zero)
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", zero) + (1 if n_ends else 0)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), (score * float(-np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
