"""The pass of op5_lm_score that counts and learns: what it reads, and how often it goes through memory."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from kelpline.llm import lm_mixing


def test_texts_are_learnt_from_the_texts_before(monkeypatch):
    """A decision is predicted from the counts before its stretch of whole texts; a stretch is counted before the next is read."""
    rng, n = np.random.default_rng(8), 9000
    monkeypatch.setattr(lm_mixing, "STRETCH", 1000)
    monkeypatch.setattr(lm_mixing, "TILE", 700)
    ends = np.array([0, 0, 400, 900, 900, 4000, 4001, 5000, 5400, n])
    stretches = [(0, 900), (900, 4000), (4000, 5000), (5000, 5400), (5400, n)]  # whole texts; a longer one stands alone

    class Part:
        slots, bit = rng.integers(0, [[9], [300], [2000]], (lm_mixing.INPUTS, n)) + 3000 * np.arange(lm_mixing.INPUTS)[:, None], rng.integers(0, 2, n).astype(np.uint8)

    learner = lm_mixing.Learner()
    learner.learn(Part, 1, ends)
    counts, before = np.zeros((9000, 2)), np.zeros((lm_mixing.INPUTS, n, 2))
    for a, b in stretches:
        before[:, a:b] = counts[Part.slots[:, a:b]]
        for row in Part.slots[:, a:b]:
            np.add.at(counts, (row, Part.bit[a:b]), 1)
    assert (learner.flat.reshape(-1, 2)[:9000] == counts).all() and learner.flat.sum() == lm_mixing.INPUTS * n
    x = np.log((before[:, :, 1] + lm_mixing.ADDED) / (before[:, :, 0] + lm_mixing.ADDED))
    gate = np.zeros(n, int)
    for row in before:
        gate = gate * 4 + np.searchsorted(lm_mixing.SEEN, row.sum(1), "right")
    assert len(np.unique(gate)) > 3 and (learner.used[1] == np.bincount(gate, minlength=lm_mixing.GATES)).all()
    for g in range(lm_mixing.GATES):
        own, bit = x[:, gate == g], Part.bit[gate == g]
        p = 1 / (1 + np.exp(-np.clip(own.sum(0) * lm_mixing.START_WEIGHT, -12, 12)))
        curve = np.eye(lm_mixing.INPUTS) * 20 * 0.97 + (own * p * (1 - p)) @ own.T
        assert np.allclose(learner.curve[1, g] - np.eye(lm_mixing.INPUTS) * 20 * 0.97, curve - np.eye(lm_mixing.INPUTS) * 20 * 0.97, rtol=1e-3, atol=1e-2)
        assert np.allclose(learner.start[1, g], lm_mixing.START_WEIGHT + np.clip(np.linalg.solve(curve, own @ (bit - p)), -0.2, 0.2), atol=1e-4)


def test_word_counts_of_many_parts():
    """Counts of a task that folds its words several times are those of a plain count, sorted by key."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 200 + 900 * k, 240_000))) for k in range(10)] + ["", None]
    got, names = Counter(), set()
    for part in lm_mixing._corpus_counts([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]):
        kinds, keys, n = (x.to_numpy() for x in part.columns)
        assert (np.diff(keys) > 0).all() and not (names & set(keys[kinds == 1].tolist()))
        names |= set(keys[kinds == 1].tolist())
        got.update(dict(zip(keys[kinds == 1].tolist(), n[kinds == 1].tolist(), strict=True)))
    want = Counter(w for t in texts for w in (t or "").split())
    assert got.pop(int(lm_mixing.END_WORD)) == len(texts)
    assert sorted(got.values()) == sorted(want.values())
