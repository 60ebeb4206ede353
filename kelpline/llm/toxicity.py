"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. Spark counts, over at most ``TOXIC`` and ``CLEAN`` labelled training texts (those of the smallest
   hash), in how many texts of either label each hashed n-gram occurs; tasks add up their own counts
   first. The log ratio of the two smoothed rates is
   the n-gram's scale. Rare n-grams shrink to 0 in proportion to the classes' sizes.
2. A logistic regression on scaled presence features is fitted in NumPy on at most ``sample`` texts
   of each label (those of the smallest hash), with L2 regularisation. N-grams of a weak scale are
   left out.
3. A text's figures are the largest sum of weights in any window of 2 * WINDOW characters (steps of
   WINDOW, over the whole text: one insult counts as much in a long text as in a short one), and the
   log of its number of features, as noise grows with it. A second regression turns them into a
   probability; it is fitted on figures from scales and weights that were learnt without the text
   (two folds by hash of the text).
4. Each task scores its whole texts with the weights: 2**BITS numbers, whatever the corpus.

Defined results: null and empty texts have no features and get the score of figures of 0. Labels
other than 0 and 1, and texts without a label, train nothing. If either label is missing from the
training rows, every score is the share of toxic training labels (0 if there are none). Where
labels repeat a doc_id, the largest label counts. Rows that repeat a doc_id are scored each by
itself; a null doc_id is never labelled and is held in. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .maptext import let_go, map_texts
from .store import Scratch

BITS = 20
LENGTHS = (4, 5, 6)
WINDOW = 256
#: Bytes of text that a task scores at once.
SLICE = 256 << 10
#: Labelled texts of each kind that are learnt from, at most; the bound lets their ids be broadcast.
TOXIC, CLEAN = 12_000, 24_000
#: Tasks that count the n-grams of these texts.
COUNTERS = 8
#: Texts of each label that the regression is fitted on, at most.
SAMPLE = 1500
#: Added counts per class share; scales below LEAST_SCALE are left out.
ALPHA, LEAST_SCALE = 30.0, 0.8
#: From this score on a text is taken as toxic.
THRESHOLD = 0.7
_STEPS = np.random.default_rng(5).integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded characters of some texts, one number each, and the texts' offsets."""
    text = data.tobytes().decode("utf-8", "replace")
    # lower() may change the number of characters, so letters that would are left as they are
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(low.encode("utf-32-le"), np.uint32), starts[offsets]


class Presence:
    """The distinct n-gram buckets of each text and where each stands, by a stamp per bucket instead of a sort."""

    def __init__(self, bits: int = BITS, lengths: tuple[int, ...] = LENGTHS):
        self.bits, self.lengths, self.stamp = bits, lengths, np.zeros(1 << bits, np.int32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        points, bounds = code_points(data, offsets)
        wide = points.astype(np.uint64)
        hashes = []
        for n in self.lengths:
            acc = np.full(max(0, len(wide) - n + 1), n, np.uint64)
            for k in range(n):
                acc += wide[k : k + len(acc)] * _STEPS[k]
            acc ^= acc >> np.uint64(29)
            acc *= _STEPS[6]
            hashes.append((acc >> np.uint64(64 - self.bits)).astype(np.int32))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.concatenate([h[a : b - n + 1] if b - a >= n else h[:0] for n, h in zip(self.lengths, hashes, strict=True)])
            order = np.arange(len(own), dtype=np.int32)
            self.stamp[own] = order
            kept = np.flatnonzero(self.stamp[own] == order)
            at = kept.copy()
            left = 0
            for n in self.lengths[:-1]:
                left += max(0, b - a - n + 1)
                at[kept >= left] = kept[kept >= left] - left
            yield own[kept], at


def figures(weights: np.ndarray, at: np.ndarray) -> tuple[float, float]:
    """Largest sum over two neighbouring windows, log of the number of features."""
    if not len(at):
        return 0.0, 0.0
    sums = np.bincount(at // WINDOW, weights)
    most = float((sums[1:] + sums[:-1]).max() if len(sums) > 1 else sums[0])
    return most, float(np.log1p(len(at)))


def _counts(batches):
    """Texts with each n-gram by cell (2 * label + fold); bucket -1 has the numbers of texts."""
    features, counts, sizes = Presence(), np.zeros((4, 1 << BITS), np.int32), np.zeros(4, np.int64)
    for batch in batches:
        data, offsets = B.text_buffers(batch.column(0))
        cell = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in B.slices(offsets):
            for y, (own, _) in zip(cell[a:b], features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), strict=True):
                counts[y, own] += 1
                sizes[y] += 1
    found = np.flatnonzero(counts.any(0))
    bucket = np.concatenate([[-1], found])
    for a in range(0, len(bucket), 1 << 16):
        part = slice(a, a + (1 << 16))
        cells = [pa.array(np.concatenate([[sizes[y]], counts[y, found]])[part]) for y in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[part].astype(np.int32)), *cells], names=["bucket", "c0", "c1", "c2", "c3"])
    del counts, features, cells
    let_go()


def _scale(buckets: np.ndarray, cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log ratio of the toxic and the clean rate of each bucket; cells and sizes: (2, ...), clean first."""
    scale, total = np.zeros(1 << BITS), max(1, sizes.sum())
    rates = [(cells[y] + ALPHA * sizes[y] / total) / max(1, sizes[y]) for y in (0, 1)]
    scale[buckets] = np.log(rates[1] / rates[0]) if sizes.all() else 0
    scale[np.abs(scale) < LEAST_SCALE] = 0
    return scale


def _fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, l2: float = 10.0, steps: int = 100) -> np.ndarray:
    """Logistic regression by Adam on full batches; returns a weight per bucket."""
    if not len(labels):
        return np.zeros(len(scale), np.float32)
    used, column = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = scale[used].astype(np.float32)[column]
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for t in range(1, steps + 1):
        z = b + np.bincount(row, x * w[column], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * share
        grad = np.append(np.bincount(column, x * error[row], len(used)) + l2 / len(rows) * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(len(scale), np.float32)
    weights[used] = w * scale[used]
    return weights


def _calibrate(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A class-balanced logistic regression on a few figures, by Newton steps; the last term is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).T
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    w = np.zeros(len(x))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
        step = np.linalg.solve((x * (share * p * (1 - p))) @ x.T + 1e-4 * np.eye(len(x)), x @ (share * (p - labels)) + 1e-4 * w)
        w = w - np.clip(step, -1, 1)
    return w


def _rows(shared):
    """Of each text: the buckets of a strong scale, and where each stands."""

    def run(batches):
        strong, features = shared.value, Presence()
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(0))
            for a, b in B.slices(offsets, SLICE):
                found = [(own[strong[own]], at[strong[own]]) for own, at in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                lists = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *lists], names=["cell", "own", "at"])
        del features
        let_go()

    return run


def train(texts: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and the second regression's terms, from (text, label) rows with labels 0 and 1.

    The driver gets counts by bucket, and of the sample the features of a strong scale, never texts.
    """
    fold = F.xxhash64("text").bitwiseAND(1).cast("int")
    cells = texts.select("text", (F.col("label") * 2 + fold).alias("cell"))
    counted = cells.mapInArrow(_counts, "bucket int, c0 long, c1 long, c2 long, c3 long").groupBy("bucket").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)]).toArrow()
    bucket = counted["bucket"].to_numpy()
    table = np.array([counted[f"c{i}"].to_numpy() for i in range(4)]).reshape(4, -1)
    sizes, table, bucket = table[:, bucket == -1].sum(1), table[:, bucket >= 0], bucket[bucket >= 0]
    if not sizes[:2].sum() or not sizes[2:].sum():
        return np.zeros(1 << BITS, np.float32), np.array([0, 0, 40.0 if sizes[2:].sum() else -40.0])
    # 0, 1: without that fold; 2: all
    scales = [_scale(bucket, table[[1 - k, 3 - k]], sizes[[1 - k, 3 - k]]) for k in (0, 1)]
    scales.append(_scale(bucket, table[[0, 2]] + table[[1, 3]], sizes[[0, 2]] + sizes[[1, 3]]))
    rows, places, labels, folds = [], [], [], []
    strong = (scales[0] != 0) | (scales[1] != 0) | (scales[2] != 0)
    shared = texts.sparkSession.sparkContext.broadcast(strong)
    for y in (0, 1):
        chosen = cells.where(F.shiftright("cell", 1) == y).orderBy(F.xxhash64("text")).limit(sample)
        got = chosen.mapInArrow(_rows(shared), "cell int, own array<int>, at array<int>").toArrow()
        folds += (got["cell"].to_numpy() % 2).tolist()
        labels += [y] * len(got)
        rows += [np.array(x, np.int32) for x in got["own"].to_pylist()]
        places += [np.array(x, np.int32) for x in got["at"].to_pylist()]
    shared.destroy()
    mark, fold_of, held = np.array(labels), np.array(folds), np.zeros((len(rows), 2))
    for k in (0, 1):
        inside, outside = np.flatnonzero(fold_of != k), np.flatnonzero(fold_of == k)
        part = _fit([rows[i][scales[k][rows[i]] != 0] for i in inside], mark[inside], scales[k])
        for i in outside:
            held[i] = figures(part[rows[i]], places[i])
    return _fit([r[scales[2][r] != 0] for r in rows], mark, scales[2]), _calibrate(held, mark)


def _scorer(shared):
    def make():
        weights, terms = shared.value
        features = Presence()

        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            z = np.array([(*figures(weights[own], at), 1.0) for own, at in features(data, offsets)]).reshape(-1, 3) @ terms
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))]

        return run

    return make


def held_out(doc_id: str = "doc_id", modulus: int = 3, remainder: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _model(documents: DataFrame, labels: DataFrame, sample: int, toxic: int, clean: int):
    """The broadcast model: one number per bucket, and the second regression."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("label"))
    marks = marks.where(~held_out("__id"))
    pick = lambda y, most: marks.where(F.col("label") == y).orderBy(F.xxhash64("__id"), "__id").limit(most)
    chosen = F.broadcast(pick(1, toxic).unionByName(pick(0, clean)))
    texts = documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "label")
    texts = Scratch(documents.sparkSession, "toxicity").table(texts, "training").coalesce(COUNTERS)
    shared = documents.sparkSession.sparkContext.broadcast(train(texts, sample))
    let_go()
    return shared


def toxicity_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Learns from ``toxic`` and ``clean`` labelled texts at most.

    Labels train only where crc32 of the doc_id as text, modulo 3, is not 1.
    """
    scored = map_texts(documents.select("doc_id", "text"), "text", _scorer(_model(documents, labels, sample, toxic, clean)), "score double", ["doc_id"], SLICE)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """The rows of documents that aren't predicted toxic, in the same columns."""
    packed = documents.select(F.col("text"), F.struct(*[f"`{c}`" for c in documents.columns]).alias("__row"))
    scored = map_texts(packed, "text", _scorer(_model(documents, labels, sample, toxic, clean)), "score double", ["__row"], SLICE)
    return scored.where(F.col("score") < threshold).select("__row.*")
