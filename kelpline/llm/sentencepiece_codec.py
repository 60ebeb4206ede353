"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a text's characters and keeps, for each of the last ``longest`` boundaries (the
longest piece's length), the best way to reach it: its score, last piece and backpointer. Whenever
the paths of all boundaries that a later piece can still start from share a boundary, the ids up to
it are committed and what lies before is forgotten. So memory is bounded by that window plus the
stretch that isn't decided yet, however long the text.

Unigram models: a path's score is the sum of its pieces' scores. BPE models: a path is admissible if
each two neighbouring pieces are what the merges make of their joint text; merges are local, so this
singles out exactly one admissible path to each boundary, and it is the model's own encoding.

White space is escaped as U+2581. In a model none of whose pieces has it after another character, no
piece crosses the start of a run of it: there all paths are known to meet. A task therefore searches
the stretches between such boundaries side by side, one character of all of them at a time
(``Lanes``, the same search with a window of fixed size), and each distinct stretch of a slice once. A
stretch of more than ``LONG`` characters goes through ``StreamingViterbi``, character by character; so
does every text of a model with other pieces. Texts are taken in portions of bytes, and nothing is remembered between them
but the model and a table of fixed size of which pieces may stand side by side.
Characters without a piece become byte pieces, or the unknown id in models without them.

Defined results: null gives null ids (and null on decoding); an empty text gives no ids. As in the
format itself, a literal U+2581 decodes to a space; every other text decodes to itself, if the model
normalises nothing and has byte pieces. Repeated rows are encoded each by itself. Extra columns are
kept, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes_np as B
from .maptext import let_go
from .store import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Characters of a stretch that is searched beside others; bytes of text that are searched at once.
LONG, PORTION = 256, 1 << 20
#: Boundaries that a lane holds (bits of a number); characters after which lanes look for a place to commit to.
RING, EVERY = 64, 16
#: Pairs of pieces whose verdict a worker holds: 2**PAIR_BITS.
PAIR_BITS = 20
_NEVER = 1 << 30


class Model:
    """Pieces of a model file: ids, scores, types, the trie, and for BPE models what merges into what."""

    def __init__(self, path: str = MODEL, kind: int | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.kind = kind or proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be searched")
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that normalise texts are not supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.scores = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.longest = max(map(len, self.ids))
        self.names = [p.piece for p in proto.pieces]
        self.in_stretches = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        lowest = min((p.score for p in proto.pieces if p.type == 1), default=0.0)
        self.unknown_score = lowest - 10.0
        self.out = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in self.out])])
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)
        self._merges()
        self._trie()
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _merges(self) -> None:
        """For each piece the last merge that makes it, and what each pair of pieces merges into. -1: nothing."""
        n = len(self.names) + 1  # the last one stands for a character without a piece
        order = {s: i for i, s in enumerate(sorted(set(self.scores), reverse=True))}
        self.rank, self.left, self.right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        keys, ranks = [], []
        self.made = np.zeros(n, bool)
        for piece, k in self.ids.items():
            if len(piece) > 1:
                self.rank[k] = order[self.scores[k]]
                for cut in range(1, len(piece)):
                    a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                    if a is not None and b is not None:
                        keys.append(a << 20 | b)
                        ranks.append(order[self.scores[k]])
            if self.kind == BPE:
                parts = self.merged(piece, stop=2)
                self.made[k] = len(piece) == 1 or len(parts) == 2 and "".join(parts) == piece and self.merged(piece) == [piece]
                if len(parts) == 2:
                    self.left[k], self.right[k] = (self.ids.get(p, n - 1) for p in parts)
        self.pairs = B.Table(np.array(keys, np.int64), np.array(ranks, np.int64), _NEVER)

    def _trie(self) -> None:
        self.next: dict[int, int] = {}
        piece_at = [-1]
        for piece, k in self.ids.items():
            if self.kind == BPE and not self.made[k]:
                continue  # no merges lead to it
            node = 0
            for c in piece:
                to = self.next.get(node << 21 | ord(c))
                if to is None:
                    to = self.next[node << 21 | ord(c)] = len(piece_at)
                    piece_at.append(-1)
                node = to
            piece_at[node] = k
        self.piece_at, self.steps = np.array(piece_at, np.int32), B.Table(np.fromiter(self.next, np.int64), np.fromiter(self.next.values(), np.int64), -1)

    def text(self, piece: int) -> str:
        """A piece's characters; negative numbers are characters without a piece."""
        return self.names[piece] if piece >= 0 else chr(-1 - piece)

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """What a BPE model's merges make of a short text: best score first, the leftmost of equals. Ends at ``stop`` parts."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair of pieces as they are.

        The pieces are taken apart in the reverse order of their making. If at some time the two parts
        at the seam would merge before what made either of them whole, the pair can't stand. Of equal
        ranks the leftmost merge comes first.
        """
        out, at = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), _NEVER)
        while len(at):
            stands = self.pairs.get(a << 20 | b) >= limit
            out[at[~stands]] = False
            at, a, b, limit = at[stands], a[stands], b[stands], limit[stands]
            can_a, can_b = self.right[a] >= 0, self.left[b] >= 0
            do_a = can_a & (~can_b | (self.rank[a] > self.rank[b]))
            more = can_a | can_b
            limit = np.where(do_a, self.rank[a], self.rank[b] + 1)
            a, b = np.where(do_a, self.right[a], a), np.where(do_a, b, self.left[b])
            at, a, b, limit = at[more], a[more], b[more], limit[more]
        return out

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``side_by_side`` with the table of recent verdicts."""
        key = before.astype(np.int64) << 20 | piece
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        out = self.pair_fits.take(slot)
        new = np.flatnonzero(self.pair_keys.take(slot) != key)
        if len(new):
            out[new] = self.side_by_side(before[new], piece[new])
            self.pair_fits[slot[new]], self.pair_keys[slot[new]] = out[new], key[new]
        return out


class StreamingViterbi:
    """The search over characters that may come in portions.

    A cursor in the pieces' trie stands for each recent boundary that a piece may still start from;
    a character moves all cursors on, and those that fall out of the trie end. The lists hold, for
    each boundary since the last committed one, the start of its last piece, that piece and a score.
    Pieces are ids; a character without a piece is -1 minus its code.
    """

    def __init__(self, model: Model):
        self.model, self.verdicts = model, {}
        self.before, self.starts, self.pieces, self.scores = 0, [0], [0], [0.0]
        self.begun = False  # whether a piece was committed; self.before is the last one
        self.cursors: list[tuple[int, int]] = []

    def _fits(self, before: int, piece: int) -> bool:
        if len(self.verdicts) > 100_000:
            self.verdicts.clear()
        other = len(self.model.names)
        ok = self.verdicts[before, piece] = bool(self.model.side_by_side(np.array([before if before >= 0 else other]), np.array([piece]))[0])
        return ok

    def feed(self, portion: str) -> Iterator[int]:
        model, trie, piece_at, fits = self.model, self.model.next, self.model.piece_at, self.verdicts
        bpe, cost, longest = model.kind == BPE, model.scores, model.longest
        starts, pieces, scores = self.starts, self.pieces, self.scores
        for c in portion:
            at, code = len(starts), ord(c)
            moved, chosen, value = [], -1, 0.0
            self.cursors.append((at - 1, 0))
            for start, node in self.cursors:
                node = trie.get(node << 21 | code)
                if node is None:
                    continue
                moved.append((start, node))
                k = int(piece_at[node])
                if k < 0:
                    continue
                if not bpe:
                    score = scores[start] + cost[k]
                    if chosen < 0 or score > value:
                        chosen, piece, value = start, k, score
                elif chosen < 0:  # the longest one that fits is the only one
                    before = pieces[start] if start else self.before
                    if not start and not self.begun:
                        ok = True
                    else:
                        ok = fits.get((before, k))
                        if ok is None:
                            ok = self._fits(before, k)
                    if ok:
                        chosen, piece = start, k
            if chosen < 0:
                chosen, piece, value = at - 1, -1 - code, scores[at - 1] + model.unknown_score
            self.cursors = moved
            starts.append(chosen)
            pieces.append(piece)
            scores.append(value)
            if at >= 4 * longest and at % longest == 0:
                yield from self._commit(self._shared())
                starts, pieces, scores = self.starts, self.pieces, self.scores

    def _path(self, to: int) -> list[int]:
        """The boundaries of the best path to one, itself first, without the committed one."""
        out = []
        while to:
            out.append(to)
            to = self.starts[to]
        return out

    def _shared(self) -> int:
        """The last boundary on the paths of all that a piece can still start from."""
        ends = set(self._path(len(self.starts) - 1))
        for start, _ in self.cursors:
            ends &= set(self._path(start))
        return max(ends, default=0)

    def _commit(self, to: int) -> Iterator[int]:
        if not to:
            return
        yield from [self.pieces[i] for i in reversed(self._path(to))]
        self.before, self.begun = self.pieces[to], True
        base = self.scores[to]
        self.starts = [0, *(x - to for x in self.starts[to + 1 :])]
        self.pieces = [0, *self.pieces[to + 1 :]]
        self.scores = [0.0, *(x - base for x in self.scores[to + 1 :])]
        self.cursors = [(start - to, node) for start, node in self.cursors]

    def finish(self) -> Iterator[int]:
        yield from self._commit(len(self.starts) - 1)
        self.cursors = []


class Lanes:
    """The streaming search over many stretches at once: one character of all that are long enough at a time.

    A lane holds RING boundaries: those since its last committed one. The best path to each of them is a
    number with a bit for each boundary that lies on it. Where the paths of the boundaries that a piece
    may still start from share a bit, the ids up to there are committed, and the ring goes on. A lane
    whose paths don't meet within the ring is left to ``StreamingViterbi``, whose window grows.
    """

    def __init__(self, model: Model, points: np.ndarray, bounds: np.ndarray):
        self.model, self.points, self.bounds = model, points, bounds

    def _pieces(self) -> np.ndarray:
        """(longest, n): the piece of each length that starts at each character, or -1."""
        model, n = self.model, len(self.points)
        out = np.full((model.longest, n), -1, np.int32)
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at, node = np.arange(n), np.zeros(n, np.int64)
        for depth in range(model.longest):
            inside = np.flatnonzero(at + depth < ends[at])
            at, node = at[inside], node[inside]
            node = model.steps.get(node << 21 | self.points[at + depth])
            on = np.flatnonzero(node >= 0)
            at, node = at[on], node[on]
            if not len(at):
                break
            out[depth, at] = model.piece_at[node]
        return out

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all stretches (characters without one as -1 minus their code), and their offsets."""
        model, lengths = self.model, np.diff(self.bounds)
        order = np.argsort(-lengths, kind="stable")
        self.base, size = self.bounds[:-1][order], lengths[order]
        most, lanes = int(size.max(initial=0)), len(order)
        live = np.searchsorted(-size, -np.arange(most + 2), "right")
        pieces, other = self._pieces(), len(model.names)
        self.last, self.length = np.zeros((RING, lanes), np.int32), np.ones((RING, lanes), np.int16)
        self.path, self.done, self.count = np.zeros((RING, lanes), np.uint64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.path[0] = 1
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last, length, path = self.last, self.length, self.path
        value = np.zeros((RING, lanes)) if model.kind == UNIGRAM else None
        cost, stuck = np.array(model.scores), np.zeros(lanes, bool)
        for i in range(1, most + 1):
            n, row = int(live[i]), i % RING
            last[row, :n], length[row, :n] = other, 1
            rest = np.arange(n)
            if value is not None:
                value[row, :n] = -np.inf
            for step in range(min(i, model.longest), 0, -1):
                found = pieces[step - 1].take(self.base[rest] + (i - step))
                own = np.flatnonzero(found >= 0)
                lane, piece, before = rest[own], found[own], (i - step) % RING
                if value is not None:  # the best sum of scores
                    score = value[before, lane] + cost[piece]
                    better = score > value[row, lane]
                    lane, piece = lane[better], piece[better]
                    value[row, lane] = score[better]
                elif step < i:  # the longest one that fits is the only one
                    fits = np.flatnonzero(model.fits(last[before, lane], piece))
                    lane, piece, own = lane[fits], piece[fits], own[fits]
                last[row, lane], length[row, lane] = piece, step
                if value is None:
                    left = np.ones(len(rest), bool)
                    left[own] = False
                    rest = rest[left]
                    if not len(rest):
                        break
            if value is not None:
                none = np.flatnonzero(value[row, :n] == -np.inf)
                value[row, none] = value[(i - 1) % RING, none] + model.unknown_score
            all_ = np.arange(n)
            far = i - self.done[:n]
            stuck[:n] |= far >= RING
            path[row, :n] = path[(i - length[row, :n].astype(np.int64)) % RING, all_] | (np.uint64(1) << np.minimum(far, RING - 1).astype(np.uint64))
            if i % EVERY == 0:
                shared = path[row, :n].copy()
                for j in range(max(0, i + 1 - model.longest), i):
                    shared &= path[j % RING, :n]
                top = _highest(shared)
                own = np.flatnonzero((top > 0) & ~stuck[:n])
                if len(own):
                    self._commit(own, self.done[own] + top[own])
            ended = np.arange(int(live[i + 1]), n)
            ended = ended[~stuck[ended]]
            if len(ended):
                self._commit(ended, np.full(len(ended), i))
        for lane in np.flatnonzero(stuck).tolist():
            text = "".join(map(chr, self.points[self.base[lane] : self.base[lane] + size[lane]].tolist()))
            search = StreamingViterbi(model)
            own = np.array([*search.feed(text), *search.finish()], np.int32)
            self.out = [tuple(x[held != lane] for x in (held, at, piece)) for held, at, piece in self.out]
            self.out.append((np.full(len(own), lane), np.arange(len(own)), own))
            self.count[lane] = len(own)
        sizes = np.zeros(lanes, np.int64)
        sizes[order] = self.count
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out, starts = np.zeros(offsets[-1], np.int32), offsets[:-1][order]
        for lane, at, piece in self.out:
            out[starts[lane] + at] = piece
        return out, offsets

    def _commit(self, lanes: np.ndarray, to: np.ndarray) -> None:
        """The pieces of some lanes from their last committed boundary to another one that is certain."""
        other = len(self.model.names)
        new = np.bitwise_count(self.path[to % RING, lanes]).astype(np.int64) - 1
        at, own = to.copy(), np.arange(len(lanes))
        while len(own):
            lane, row = lanes[own], at[own] % RING
            piece, place = self.last[row, lane], np.bitwise_count(self.path[row, lane]).astype(np.int64) - 2
            odd = piece == other
            if odd.any():
                piece[odd] = -1 - self.points[self.base[lane[odd]] + at[own[odd]] - 1].astype(np.int32)
            self.out.append((lane, self.count[lane] + place, piece))
            at[own] -= self.length[row, lane]
            own = own[at[own] > self.done[lane]]
        self.path[:, lanes] >>= (to - self.done[lanes]).astype(np.uint64)
        self.count[lanes] += new
        self.done[lanes] = to


def _highest(x: np.ndarray) -> np.ndarray:
    """The place of the highest bit that is set; -1 without one."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    return np.bitwise_count(x).astype(np.int64) - 1


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of values one after another."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Encoder:
    def __init__(self, model: Model):
        self.model = model

    def _long(self, text: str) -> np.ndarray:
        """One stretch, fed in portions to one search; only its ids grow with it."""
        search, out = StreamingViterbi(self.model), array("i")
        for a in range(0, len(text), 1 << 16):
            out.extend(search.feed(text[a : a + (1 << 16)]))
        out.extend(search.finish())
        return np.frombuffer(out, np.int32)

    def _with_bytes(self, pieces: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become byte pieces, or the unknown id."""
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces, offsets
        sizes = np.ones(len(pieces), np.int64)
        codes, which = np.unique(-1 - pieces[odd], return_inverse=True)
        made = [[self.model.bytes[b] for b in chr(c).encode()] if self.model.bytes else [self.model.unknown] for c in codes.tolist()]
        sizes[odd] = np.array([len(x) for x in made])[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.repeat(pieces, sizes)
        for k, ids in enumerate(made):
            for j, i in enumerate(ids):
                out[ends[odd[which == k]] + j] = i
        return out, ends[offsets]

    def _stretches(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each range of bytes that is a stretch by itself, and their offsets."""
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points[points == 32] = ord(SPACE)
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
        sizes = np.diff(at)
        long = np.flatnonzero(sizes > LONG)
        short = np.flatnonzero(sizes <= LONG)
        own = _gather(points, at[short], sizes[short])
        pieces, offsets = self._with_bytes(*Lanes(self.model, own, np.concatenate([[0], np.cumsum(sizes[short])])).search())
        if not len(long):
            return pieces, offsets
        parts: list[np.ndarray] = [pieces[:0]] * len(sizes)
        for k, i in enumerate(short.tolist()):
            parts[i] = pieces[offsets[k] : offsets[k + 1]]
        for i in long.tolist():
            text = "".join(map(chr, points[at[i] : at[i + 1]].tolist()))
            ids = self._long(text)
            parts[i] = self._with_bytes(ids, np.array([0, len(ids)]))[0]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode_buffers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts and each text's offsets. Works on portions of about PORTION bytes; a text may span several."""
        parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
        for a, b in B.slices(offsets, PORTION):
            if b == a + 1 and offsets[b] - offsets[a] > PORTION and self.model.in_stretches:
                for lead, own in self._portions(data[offsets[a] : offsets[b]]):
                    ids, n = self._encode(own, np.array([0, len(own)]), lead)
                    parts.append(ids)
                    sizes[a] += len(ids)
            else:
                ids, n = self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.model.prefix)
                parts.append(ids)
                sizes[a:b] = np.diff(n)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)).astype(np.int32, copy=False), np.concatenate([[0], np.cumsum(sizes)])

    def _portions(self, text: np.ndarray) -> Iterator[tuple[bool, np.ndarray]]:
        """A long text cut where a run of spaces begins; only the first portion gets the prefix."""
        at = 0
        while at < len(text):
            to = min(len(text), at + PORTION)
            while to < len(text):
                window = text[max(at, to - PORTION) : to + 1] == 32
                starts = np.flatnonzero(window[1:] & ~window[:-1])
                if len(starts):
                    to = max(at, to - PORTION) + 1 + int(starts[-1])
                    break
                to = min(len(text), to + PORTION)
            yield self.model.prefix and at == 0, text[at:to]
            at = to

    def _encode(self, data: np.ndarray, offsets: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        full = np.diff(offsets) > 0
        if prefix:
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        starts = offsets[:-1][full]
        if self.model.in_stretches and len(data):
            space = data == 32
            first = np.zeros(len(data), bool)
            first[1:] = space[1:] & ~space[:-1]
            first[starts] = True
            starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        key = B.range_hashes(B.prefix_hashes(data), starts, ends)
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        size = ends[one] - starts[one]
        ids, at = self._stretches(_gather(data, starts[one], size), np.concatenate([[0], np.cumsum(size)]))
        count = np.diff(at)[which]
        return _gather(ids, at[:-1][which], count), np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_buffers(raw, np.array([0, len(raw)]))[0].tolist()

    def decode_buffers(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each list of ids, as they stand (a prefix included), and their offsets."""
        at = self.model.out_at
        size = at[ids + 1] - at[ids]
        return _gather(self.model.out_bytes, at[ids], size), np.concatenate([[0], np.cumsum(size)])[offsets]

    def decode(self, ids: Iterable[int]) -> str:
        own = np.fromiter(ids, np.int64)
        return self.as_text(self.decode_buffers(own, np.array([0, len(own)]))[0].tobytes())

    def as_text(self, raw: bytes) -> str:
        return (raw[1:] if self.model.prefix and raw.startswith(b" ") else raw).decode("utf-8", "replace")

    def decodes_to(self, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each list of ids decodes to its text."""
        made, at = self.decode_buffers(ids, bounds)
        lead = (np.diff(at) > 0) & self.model.prefix
        lead[lead] = made[at[:-1][lead]] == 32
        out = np.diff(at) - lead == np.diff(offsets)
        size = np.diff(offsets)[out]
        wrong = _gather(made, (at[:-1] + lead)[out], size) != _gather(data, offsets[:-1][out], size)
        out[out] = np.diff(np.concatenate([[0], np.cumsum(wrong)])[np.concatenate([[0], np.cumsum(size)])]) == 0
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder for a model file; its size is fixed."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Model(path))
    return _ENCODERS[path]


def _lists(ids: np.ndarray, bounds: np.ndarray, nulls: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=nulls)


def _mapped(df: DataFrame, column: str, result: T.StructType, f: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Every column of df, then the result's fields (which replace equal names)."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in result.fieldNames()]
    packed = df.select(F.col(f"`{column}`").alias("value"), F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in names]).alias("carry"))
    schema = T.StructType([packed.schema["carry"], T.StructField("result", result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0)
            if pa.types.is_string(value.type) or pa.types.is_large_string(value.type):
                cuts = B.slices(B.text_buffers(value)[1], PORTION)
            else:
                cuts = B.slices(np.concatenate([[0], np.cumsum(value.value_lengths().fill_null(0).to_numpy())]), PORTION // 4)
            for a, b in cuts:
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.StructArray.from_arrays(f(value.slice(a, b - a)), names=result.fieldNames())], names=["carry", "result"])
        let_go()

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col(f"carry.`{c}`") for c in names], *[F.col(f"result.`{c}`") for c in result.fieldNames()])


def encode_texts(df: DataFrame, column: str = "text", path: str = MODEL) -> DataFrame:
    """df with ids array<int> and n_tokens long (null where the text is)."""

    def f(texts: pa.Array) -> list[pa.Array]:
        ids, bounds = encoder(path).encode_buffers(*B.text_buffers(texts))
        return [_lists(ids, bounds, texts.is_null()), pa.array(np.diff(bounds), mask=texts.is_null().to_numpy(zero_copy_only=False))]

    return _mapped(df, column, T._parse_datatype_string("ids array<int>, n_tokens long"), f)


def decode_ids(df: DataFrame, column: str = "ids", path: str = MODEL) -> DataFrame:
    """df with decoded string (null where the ids are)."""

    def f(ids: pa.Array) -> list[pa.Array]:
        sizes = ids.value_lengths().fill_null(0).to_numpy()
        own = encoder(path)
        raw, at = own.decode_buffers(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
        whole = raw.tobytes()
        texts = [None if null else own.as_text(whole[a:b]) for null, a, b in zip(ids.is_null().to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [pa.array(texts, pa.string())]

    return _mapped(df, column, T._parse_datatype_string("decoded string"), f)


def encode_and_check(documents: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """``keep``, ids, n_tokens and round_trip: whether the ids decode to the text (null: true)."""

    def f(texts: pa.Array) -> list[pa.Array]:
        own, (data, offsets), nulls = encoder(path), B.text_buffers(texts), texts.is_null()
        ids, bounds = own.encode_buffers(data, offsets)
        return [_lists(ids, bounds, nulls), pa.array(np.diff(bounds), mask=nulls.to_numpy(zero_copy_only=False)), pa.array(own.decodes_to(ids, bounds, data, offsets))]

    chosen = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    out = _mapped(chosen, "text", T._parse_datatype_string("ids array<int>, n_tokens long, round_trip boolean"), f)
    return out.select(*[f"`{c}`" for c in keep], "ids", "n_tokens", "round_trip")
