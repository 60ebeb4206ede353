"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into segments of ``SEGMENT`` bytes, all of them, to its end. In each, one network
reads forwards and one backwards; both states at a byte give the probabilities of the languages
there, and a document's probabilities are their mean over every byte of the text.

The network is trained in NumPy on the driver by backpropagation through time (Adam), on segments
of about ``sample`` documents of each language (those of the smallest hash of doc_id; at most
``PER_DOCUMENT`` segments each), so the training set is bounded. Tasks score segments in batches,
one matrix step for each byte position.

Defined results: texts that are null or hold no letter are ``und`` with score 0; so is everything
if no training row has a language. Rows that repeat a doc_id are judged each by itself; a null
doc_id is held in. A null language trains nothing. Extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .maptext import map_texts
from .toxicity import held_out

SEGMENT, HIDDEN, BATCH = 96, 8, 2048
#: Training documents of each language, on average; and segments of each of them, at most.
SAMPLE, PER_DOCUMENT = 300, 6
STEPS, TRAIN_BATCH, RATE = 150, 128, 0.02
#: Segments of each language in a training step, at least: with many languages steps grow.
LEAST_EACH = 8
LETTER = re.compile(r"[^\W\d_]")


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SEGMENT, n) bytes with zeros after each end, the lengths, and each segment's text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[doc] + within * SEGMENT
    lengths = np.minimum(SEGMENT, offsets[doc + 1] - starts)
    place = starts[None, :] + np.arange(SEGMENT)[:, None]
    out = data[np.minimum(place, max(0, len(data) - 1))] if len(data) else np.zeros((SEGMENT, 0), np.uint8)
    out[np.arange(SEGMENT)[:, None] >= lengths[None, :]] = 0
    return out, lengths, doc


def squash(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The networks' tanh: x (27 + x^2) / (27 + 9 x^2), which reaches -1 and 1 at -3 and 3."""
    np.clip(x, -3, 3, out=out)
    square = out * out
    below = square * 9
    below += 27
    square += 27
    out *= square
    out /= below
    return out


def slope(x: np.ndarray) -> np.ndarray:
    """The derivative of ``squash``."""
    square = np.minimum(x * x, 9)
    return (9 - square) ** 2 / (9 * (3 + square) ** 2)


class Direction:
    """One gated recurrent network. x: (3H, 256) input terms with bias; u: (3H, H)."""

    def __init__(self, rng: np.random.Generator):
        self.x = rng.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32)

    def states(self, text: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """(steps, H, n) states; where not valid the state is 0."""
        h2, (steps, n) = 2 * HIDDEN, text.shape
        x, u = self.x.copy(), self.u.copy()
        x[:h2] *= 0.5  # a gate is squash(v / 2) / 2 + 1 / 2
        u[:h2] *= 0.5
        out = np.empty((steps, HIDDEN, n), np.float32)
        h = np.zeros((HIDDEN, n), np.float32)
        g, a = np.empty((3 * HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32)
        gates, new = g[:h2], g[h2:]
        for t in range(steps):
            np.take(x, text[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=a)
            gates += a[:h2]
            squash(gates, gates)
            gates *= 0.5
            gates += 0.5
            a[h2:] *= g[HIDDEN:h2]
            new += a[h2:]
            squash(new, new)
            h = out[t] = (h - new) * g[:HIDDEN] + new
            if valid is not None:
                h = out[t] = h * valid[t]
        return out

    def gradients(self, text: np.ndarray, valid: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time of d_out (steps, H, n) into (x, u)."""
        k, (steps, n) = HIDDEN, text.shape
        kept, h = [], np.zeros((k, n), np.float32)
        for t in range(steps):
            g, a = self.x[:, text[t]], self.u @ h
            inner = (g[: 2 * k] + a[: 2 * k]) / 2
            gates = squash(inner, np.empty_like(inner)) / 2 + 0.5
            z, r = gates[:k], gates[k:]
            term = g[2 * k :] + r * a[2 * k :]
            new = squash(term, np.empty_like(term))
            kept.append((h, z, r, new, a[2 * k :], slope(inner) / 4, slope(term)))
            h = ((1 - z) * new + z * h) * valid[t]
        dx, du, dh = np.zeros((256, 3 * k), np.float32), np.zeros_like(self.u), np.zeros((k, n), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, inner, at_gates, at_new = kept[t]
            dh = (dh + d_out[t]) * valid[t]
            d_new = dh * (1 - z) * at_new
            d_z = dh * (before - new) * at_gates[:k]
            d_r = d_new * inner * at_gates[k:]
            d_a = np.concatenate([d_z, d_r, d_new * r])
            np.add.at(dx, text[t], np.concatenate([d_z, d_r, d_new]).T)
            du += d_a @ before.T
            dh = dh * z + self.u.T @ d_a
        return dx.T, du


class Network:
    """Both directions and the output layer over their states at each byte."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.forward, self.backward = languages, Direction(rng), Direction(rng)
        self.v = rng.normal(0, 0.3, (len(languages), 2 * HIDDEN)).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def probabilities(self, text: np.ndarray, valid: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(steps, languages, n) at each byte, and the states that they come from."""
        ahead = self.forward.states(text, valid)
        back = self.backward.states(text[::-1], None if valid is None else valid[::-1])[::-1]
        logits = np.matmul(self.v[:, :HIDDEN], ahead) + np.matmul(self.v[:, HIDDEN:], back) + self.c[:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits, np.concatenate([ahead, back], 1)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of each text (n, languages); 0 for empty ones."""
        text, lengths, doc = segments(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        order = np.argsort(lengths < SEGMENT, kind="stable")  # whole segments need no mask
        full = int((lengths == SEGMENT).sum())
        for lo, hi, whole in ((0, full, True), (full, len(order), False)):
            for a in range(lo, hi, BATCH):
                own = order[a : min(hi, a + BATCH)]
                steps = SEGMENT if whole else int(lengths[own].max())
                valid = None if whole else (np.arange(steps)[:, None] < lengths[own][None, :]).astype(np.float32)[:, None, :]
                p, _ = self.probabilities(np.ascontiguousarray(text[:steps, own]), valid)
                sums = p.sum(0) if whole else (p * valid).sum(0)
                for k in range(len(self.languages)):
                    out[:, k] += np.bincount(doc[own], sums[k], len(out))
        return out / np.maximum(np.diff(offsets), 1)[:, None]

    def fit(self, text: np.ndarray, lengths: np.ndarray, label: np.ndarray, steps: int = STEPS) -> None:
        """Every byte of a segment is labelled with its document's language."""
        rng = np.random.default_rng(3)
        by = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        weights = [self.forward.x, self.forward.u, self.backward.x, self.backward.u, self.v, self.c]
        m, s = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        each = max(LEAST_EACH, TRAIN_BATCH // len(by))
        for step in range(1, steps + 1):
            own = np.concatenate([rng.choice(b, each) for b in by if len(b)])
            x, y = np.ascontiguousarray(text[:, own]), label[own]
            valid = (np.arange(SEGMENT)[:, None] < lengths[own][None, :]).astype(np.float32)[:, None, :]
            p, states = self.probabilities(x, valid)
            p[:, y, np.arange(len(y))] -= 1
            d = p * valid / valid.sum()
            g_v = np.einsum("tkn,thn->kh", d, states)
            d_states = np.matmul(self.v.T, d)
            fx, fu = self.forward.gradients(x, valid, d_states[:, :HIDDEN])
            bx, bu = self.backward.gradients(x[::-1], valid[::-1], d_states[::-1, HIDDEN:])
            rate = RATE * (1 - step / (steps + 1))
            for i, (w, g) in enumerate(zip(weights, (fx, fu, bx, bu, g_v, d.sum((0, 2))), strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.99 * s[i] + 0.01 * g * g
                w -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def _pick(batches):
    for batch in batches:
        data, offsets = B.text_buffers(batch.column(0))
        lang, key = batch.column(1), batch.column(2).to_pylist()
        text, lengths, doc = segments(data, offsets)
        bounds = np.searchsorted(doc, np.arange(len(batch) + 1))
        for i in range(len(batch)):
            n = bounds[i + 1] - bounds[i]
            if n:
                own = bounds[i] + np.unique([zlib.crc32(b"%d %d" % (k, key[i])) % n for k in range(PER_DOCUMENT)])
                yield pa.RecordBatch.from_arrays([pa.array([lang[i].as_py()] * len(own)), pa.array([text[: lengths[j], j].tobytes() for j in own], pa.binary())], names=["lang", "segment"])


def train(documents: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from (doc_id, text, lang) rows, or None if none has a language and a text."""
    rows = documents.where("lang IS NOT NULL AND octet_length(text) > 0")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    key = F.xxhash64("doc_id", "text")
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])[F.col("lang")]
    chosen = rows.where(F.pmod(key, F.lit(1_000_000)) < share * 1_000_000)
    got = chosen.select("text", "lang", key.alias("key")).mapInArrow(_pick, "lang string, segment binary").orderBy("lang", "segment").toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    if not languages:
        return None
    raw = got["segment"].to_pylist()
    text = np.zeros((SEGMENT, len(raw)), np.uint8)
    for i, s in enumerate(raw):
        text[: len(s), i] = np.frombuffer(s, np.uint8)
    network = Network(languages)
    network.fit(text, np.array([len(s) for s in raw]), np.array([languages.index(x) for x in got["lang"].to_pylist()]))
    return network


def _predictor(shared):
    def make():
        network = shared.value

        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            raw = data.tobytes()
            letters = [LETTER.search(raw[a:b].decode("utf-8", "replace")) is not None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if network is None:
                return [pa.array(["und"] * len(letters)), pa.array(np.zeros(len(letters)))]
            p = network.pooled(data, offsets)
            best = p.argmax(1)
            score = np.where(letters, np.clip(p.max(1), 0, 1), 0.0)
            return [pa.array([network.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]), pa.array(score)]

        return run

    return make


def predict_languages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns only where crc32 of the doc_id as text, modulo 5, is not 0.
    """
    fold = held_out("doc_id", 5, 0)
    network = train(documents.where(~fold).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), sample)
    shared = documents.sparkSession.sparkContext.broadcast(network)
    scored = map_texts(documents.select("doc_id", "text"), "text", _predictor(shared), "lang_pred string, score double", ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
