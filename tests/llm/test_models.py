"""Scores of trained models against plain loops over their weights, on tiny inputs."""

import math

import numpy as np
import pytest

from kelpline.llm import language_id, toxicity


def test_toxicity_score_by_hand():
    """score = logistic of the best two neighbouring windows, the number of features and a constant; a feature stands where it comes last."""
    rng = np.random.default_rng(4)
    weights = rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    terms = np.array([0.7, -0.3, 0.1])

    class Shared:
        value = (weights, terms)

    texts = ["", "abc", "abcd", "The Lamp! the lamp. " * 40, "Étude ÉTUDE é" * 60, "x" * 900, "".join(chr(97 + k) for k in rng.integers(0, 26, 1200))]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = toxicity._scorer(Shared)()(np.frombuffer(b"".join(raw), np.uint8), offsets)[0].to_pylist()
    single = {n: toxicity.Presence(lengths=(n,)) for n in toxicity.LENGTHS}

    def bucket(s):
        data = np.frombuffer(s.encode(), np.uint8)
        return int(next(single[len(s)](data, np.array([0, len(data)])))[0][0])

    for text, score in zip(texts, got, strict=True):
        place = {}
        for n in toxicity.LENGTHS:
            for i in range(len(text) - n + 1):
                place[bucket(text.lower()[i : i + n])] = i
        sums = [0.0] * (max(place.values(), default=-1) // toxicity.WINDOW + 1)
        for b, i in place.items():
            sums[i // toxicity.WINDOW] += float(weights[b])
        most = 0.0 if not sums else sums[0] if len(sums) == 1 else max(a + b for a, b in zip(sums, sums[1:], strict=False))
        z = terms[0] * most + terms[1] * math.log1p(len(place)) + terms[2]
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-5), text[:20]


@pytest.mark.parametrize("languages", [["a", "b"], ["a", "b", "c", "d", "e"]])
def test_network_by_hand(languages):
    """Gates, states, both directions, the output layer and the pooled mean, byte by byte."""
    net, k = language_id.Network(languages), language_id.HIDDEN
    rng = np.random.default_rng(6)
    texts = [b"", b"x", rng.integers(0, 256, 50).astype(np.uint8).tobytes(), rng.integers(0, 256, 96).astype(np.uint8).tobytes(), rng.integers(0, 256, 250).astype(np.uint8).tobytes()]

    def squash(v):
        v = max(-3.0, min(3.0, v))
        return v * (27 + v * v) / (27 + 9 * v * v)

    def states(direction, data):
        x, u = direction.x.astype(float), direction.u.astype(float)
        h, out = [0.0] * k, []
        for byte in data:
            a = [sum(u[i, j] * h[j] for j in range(k)) for i in range(3 * k)]
            z = [squash((x[i, byte] + a[i]) / 2) / 2 + 0.5 for i in range(k)]
            r = [squash((x[k + i, byte] + a[k + i]) / 2) / 2 + 0.5 for i in range(k)]
            new = [squash(x[2 * k + i, byte] + r[i] * a[2 * k + i]) for i in range(k)]
            h = [(1 - z[i]) * new[i] + z[i] * h[i] for i in range(k)]
            out.append(h)
        return out

    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, pooled in zip(texts, got, strict=True):
        total = np.zeros(len(languages))
        for s in range(0, len(text), language_id.SEGMENT):
            part = text[s : s + language_id.SEGMENT]
            ahead, back = states(net.forward, part), states(net.backward, part[::-1])[::-1]
            for f, b in zip(ahead, back, strict=True):
                logits = net.v.astype(float) @ np.array([*f, *b]) + net.c
                e = np.exp(logits - logits.max())
                total += e / e.sum()
        assert np.allclose(pooled, total / max(1, len(text)), atol=2e-4)
