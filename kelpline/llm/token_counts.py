"""Exact histogram of encoded lengths, and what its suffix sums answer.

Tasks encode each whole text with a byte-level BPE vocabulary and count documents by length before
anything is shuffled, so the exchange carries lengths, not documents. The histogram is then summed
from the longest length down, in two levels (within ranges of lengths, then over ranges), so no task
sees all of it. From the sums at a length follow, for every context limit at or below it, the
documents that reach the limit and the tokens within and beyond it.

Defined results: null and empty texts have length 0. An empty table has an empty histogram, totals
of 0 and null quantiles. Repeated rows count as often as they occur. Extra columns don't matter.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How many neighbouring lengths form a range.
RANGE = 1024


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(path: str, split: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("given", pat_str=split, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, path: str = VOCABULARY, split: str | None = None, column: str = "text") -> DataFrame:
    """(n_tokens, n_docs) pairs, several rows for a length; the sum over rows is the histogram."""
    split = split or pattern()

    def run(batches):
        encode, counts = encoder(path, split).encode_ordinary, np.zeros(1 << 10, np.int64)
        for batch in batches:
            n = np.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], np.int64)
            if len(n) and n.max() >= len(counts):
                counts = np.concatenate([counts, np.zeros(int(n.max()) + 1, np.int64)])
            counts += np.bincount(n, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["n_tokens", "n_docs"])

    return documents.select(F.col(column).cast("string")).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per encoded length that occurs, with suffix sums.

    n_tokens, n_docs; docs_from, tokens_from: documents of that length or more and their tokens;
    tokens_truncated: tokens left if every document is cut to this length; docs_upto: documents of
    this length or less (for quantiles).
    """
    rows = lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    rows = Scratch(lengths.sparkSession, "lengths").table(rows, "histogram")  # it is read twice below
    sums = rows.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    below = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("range", F.coalesce(F.sum("d").over(above), zero).alias("d_above"), F.coalesce(F.sum("t").over(above), zero).alias("t_above"), F.coalesce(F.sum("d").over(below), zero).alias("d_below"), F.coalesce(F.sum("t").over(below), zero).alias("t_below"))
    within = W.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    upto = W.partitionBy("range").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    tokens = F.col("n_docs") * F.col("n_tokens")
    out = rows.join(sums, "range")
    docs_from = F.sum("n_docs").over(within) + F.col("d_above")
    tokens_upto = F.sum(tokens).over(upto) + F.col("t_below")
    return out.select("n_tokens", "n_docs", docs_from.alias("docs_from"), (F.sum(tokens).over(within) + F.col("t_above")).alias("tokens_from"), (tokens_upto - tokens + F.col("n_tokens") * docs_from).alias("tokens_truncated"), (F.sum("n_docs").over(upto) + F.col("d_below")).alias("docs_upto"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """total_tokens and truncated_tokens at any context limit, from the histogram alone."""
    at_least = F.col("n_tokens") >= limit
    total = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0))
    left = F.coalesce(F.sum(F.col("n_docs") * F.when(at_least, F.lit(limit)).otherwise(F.col("n_tokens"))), F.lit(0))
    return histogram.agg(total.alias("total_tokens"), left.cast("long").alias("truncated_tokens"))


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """n_tokens: the smallest length that at least a share q of the documents doesn't exceed."""
    total = histogram.agg(F.max("docs_upto")).first()[0] or 0
    return histogram.where(F.col("docs_upto") >= math.ceil(total * q)).agg(F.min("n_tokens").alias("n_tokens"))
