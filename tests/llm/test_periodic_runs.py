"""Periodic runs against a scan of all periods, and the report against its definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kelpline.llm import bytes_np as B
from kelpline.llm import periodic_runs as P
from kelpline.llm import queries

EMPTY = hashlib.sha256(b"").hexdigest()


def scan(w, exponent=4, least=6):
    """All runs as (start, length, period), by comparing the words of every distance."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, exponent * q):
                out.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = scan(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 10)])
def test_runs_against_scan(exponent, least):
    rng = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 5, 6, 7, 8, 20, 100, 300]), rng.choice([1, 2, 3, 50])
            w = [rng.randint(0, k) for _ in range(n)]
            if n > 10 and rng.random() < 0.7:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 4))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                if rng.random() < 0.5:
                    w[rng.randrange(n)] = 99
            docs.append(w)
        words = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
        d, start, length, q = P.find_runs(np.array([x for w in docs for x in w], np.int64), words, exponent, least)
        got = [sorted(zip((start[d == k] - words[k]).tolist(), length[d == k].tolist(), q[d == k].tolist(), strict=True)) for k in range(len(docs))]
        assert got == [scan(w, exponent, least) for w in docs]


def test_cover_index_extends():
    """Every difference is covered, and extensions equal those found word by word."""
    assert sorted({(a - b) % P.V for a in P.COVER for b in P.COVER}) == list(range(P.V))
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (40, 1), (200, 2), (500, 1), (300, 40)):
        text = np.tile(rng.integers(0, k, n), 3)
        i, j = np.triu_indices(len(text), 1) if len(text) < 150 else np.sort(rng.integers(0, len(text), (2, 4000)), axis=0)
        i, j = i[i < j], j[i < j]
        want = [next((x for x in range(len(text) - b) if text[a + x] != text[b + x]), len(text) - b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert P.CoverIndex(text).extend(i, j).tolist() == want


def test_pairs_in_portions(monkeypatch):
    w = [1, 2] * 50 + [3] * 40 + list(range(10, 60)) * 4
    monkeypatch.setattr(P, "PAIRS", 7)
    got = P.find_runs(np.array(w), np.array([0, len(w)]))
    assert sorted(zip(*(x.tolist() for x in got[1:]), strict=True)) == scan(w)


def test_report_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf).collect()}
    want = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in docs.collect()}
    assert got == want
    assert sum(w[0] > 0 for w in want.values()) > 5


def test_report_odd(spark):
    """Nulls, empty and long texts, repeated ids and rows, clashing names, an empty table."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b " * 9), (6, "word " * 30_000), (7, "x\ty " * 5), (7, "again again"), (7, "again again"), (None, "no id " * 8), (8, "y" * 100_000), (9, "é\x00 ß " * 12 + "end")]
    tens = [k for k in range(300) if zlib.crc32(str(k).encode()) % 10 == 0][:12]
    texts += [(k, " ".join(f"w{j % (i + 1)}" for j in range(i * 7))) for i, k in enumerate(tens)]
    odd = spark.createDataFrame([(i, t, 1, [2], "p") for i, t in texts], "doc_id long, text string, runs int, w array<int>, planted string")
    got = sorted((tuple(r) for r in P.run_report(odd).collect()), key=str)
    assert got == sorted(((i, *expected(i, t)) for i, t in texts), key=str)
    assert next(r for r in got if r[0] == 1) == (1, 0, None, None, None, None, EMPTY, EMPTY)
    assert P.run_report(odd.limit(0)).count() == 0


def test_collapsed_text(spark):
    rows = [("a b a b a b a b c", "a b c"), ("z z z z z z", "z"), ("z z z z z", "z z z z z"), ("p  q\tr\n", "p q r")]
    found = P.periodic_runs(spark.createDataFrame(rows, "t string, want string"), "t", ["want"]).collect()
    assert [r["collapsed"] for r in found] == [r["want"] for r in found]
    assert [r["n_words"] for r in found] == [9, 6, 5, 3]
    assert len(B.word_spans(np.frombuffer(b"a b", np.uint8), np.array([0, 3]), B.WORD_BYTES)[0]) == 2
