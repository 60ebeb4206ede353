"""Ranked search against scores of every document, and the tree against a dense grid."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from kelpline.llm import queries
from kelpline.llm import ranked_search as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) of lists of (id, text)."""
    counted = [(i, c) for i, t in docs if (c := Counter(terms(t)))]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(k_ * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k_ in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is not None, i, s))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize(("first", "more"), [(R.FIRST_CELLS, R.MORE_CELLS), (1, 1), (7, 50)])
def test_tree_against_dense_grid(monkeypatch, first, more):
    monkeypatch.setattr(R, "FIRST_CELLS", first)
    monkeypatch.setattr(R, "MORE_CELLS", more)
    rng = np.random.default_rng(5)
    for rows, columns, share in ((1, 1, 1.0), (1, 50, 0.3), (40, 1, 0.5), (13, 200, 0.1), (200, 37, 0.02), (64, 64, 0.9)):
        grid = np.where(rng.random((rows, columns)) < share, rng.integers(1, 6, (rows, columns)), 0)
        if not grid.any():
            grid[0, 0] = 1
        r, c = np.nonzero(grid)
        tree = R.Treap(r, c, grid[r, c].astype(np.int64), rows, columns)
        assert tree.most[0] == grid.max()
        for k in (1, 5, 20):
            asked = rng.choice(rows, min(rows, 9), replace=False)
            weights = rng.integers(1, 4, len(asked))
            sums = weights @ grid[asked]
            want = sorted(((-int(s), i) for i, s in enumerate(sums) if s > 0))[:k]
            got_columns, got_sums = tree.best(asked, weights, k)
            assert [(-int(s), int(i)) for i, s in zip(got_columns, got_sums, strict=True)] == want


def test_search_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "SHARD_POSTINGS", 500)  # several shards in a task
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op13_ranked_search(spark, sf).collect())
    assert got == sorted(brute(docs, items))


def test_search_odd(spark):
    """Nulls, empty and long texts, ties, repeated ids and rows, clashing names, several blocks, empty tables."""
    docs = [(1, None), (2, ""), (3, "... --"), (4, "Tie one"), (5, "tie ONE"), (5, "tie one"), (None, "tie one"), (6, "tie " * 5000), (7, "x" * 100_000 + " tie"), (8, "é ß 日本"), (9, "one two three"), *((k, "other words") for k in range(10, 40))]
    items = [(1, "tie one"), (1, "two"), (None, "É é tie tie"), (2, None), (3, "nothing known"), (4, ""), (5, "x" * 100_000), (6, "other other words")]
    d = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in docs], "doc_id long, text string, rank int, score long, n string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    want = sorted(brute(docs, items), key=str)
    for block in (R.BLOCK_BYTES, 100):
        assert sorted((tuple(r) for r in R.search(d, b, block_bytes=block).collect()), key=str) == want
    assert R.search(d.limit(0), b).count() == R.search(d, b.limit(0)).count() == 0


def test_oracle(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = queries.op13_ranked_search(spark, sf)
    rel = con.sql(queries.ORACLES["op13_ranked_search"])
    assert rel.columns == got.columns
    assert sorted(rel.fetchall()) == sorted(tuple(r) for r in got.collect())
