"""Batches per origin, tickets of the records in them, commit watermark and acknowledgements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import prefix

CAPACITY = 500
#: Rows of an origin that are numbered together; origins are dealt by (origin, id div CHUNK).
CHUNK = 1 << 16


def size_batches(records: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """records (origin_id, ordinal, ...) with batch_no: first come first served within an origin.

    Origins never share a batch. An origin may be hot, so it is numbered in chunks of its ordinals,
    whose sizes are summed up first.
    """
    chunked = records.withColumn("chunk", F.floor(F.col("ordinal") / CHUNK))
    sizes = chunked.groupBy("origin_id", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("origin_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("origin_id", "chunk", before.alias("n0"))
    place = F.row_number().over(W.partitionBy("origin_id", "chunk").orderBy("ordinal")) + F.col("n0") - 1
    out = chunked.join(offsets, ["origin_id", "chunk"]).withColumn("place", place)
    return out.withColumn("batch_no", F.floor(F.col("place") / capacity)).drop("chunk", "n0", "place")


#: Rows that are scanned together, and chunks whose tables are put together.
SCAN, FAN = 1 << 15, 256
_PATH = "origin_id string, chunk long, entry long, batches long"
_TABLE = "origin_id string, chunk long, entry long, exit long, batches long"


def _next_starts(t: np.ndarray, capacity: int, age_ms: int) -> np.ndarray:
    """For each arrival the place where the batch that it opens ends: full, or the first later arrival that finds it too old."""
    n, least = len(t), t + age_ms
    out = np.minimum(np.arange(n) + capacity, n)
    # where times only rise, the running maximum is the time; else the first place whose maximum is large enough
    # may have it from before the batch, and the search goes on by maxima of blocks of doubling size
    top = np.maximum.accumulate(t)
    found = np.maximum(np.searchsorted(top, least), np.arange(n) + 1)
    open_ = np.flatnonzero((found < out) & (t[np.minimum(found, n - 1)] < least))
    if len(open_):
        levels = [t]
        while 1 << len(levels) <= min(capacity, n):
            half = 1 << (len(levels) - 1)
            levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))
        at, want, end = found[open_], least[open_], out[open_]
        for k in range(len(levels) - 1, -1, -1):
            fits = at + (1 << k) <= end
            fits[fits] = levels[k][at[fits]] < want[fits]
            at = np.where(fits, at + (1 << k), at)
        # each size was tried once: a stretch that is longer than that is walked on by the largest ones
        while len(more := np.flatnonzero((at < end) & (t[np.minimum(at, n - 1)] < want))):
            at[more] += 1
        found[open_] = at
    return np.minimum(found, out)


def _chains(following: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """From each place, where a chain of batches leaves the first ``own`` places, and how many batches it opens: by pointer doubling."""
    n = len(following)
    jump = np.append(np.where(np.arange(n) < own, following, np.arange(n)), n)
    count = np.append((np.arange(n) < own).astype(np.int64), 0)
    while (jump[jump] != jump).any():
        count, jump = count + count[jump], jump[jump]
    return jump[:n], count[:n]


def age_batches(records: DataFrame, capacity: int, age_ms: int) -> DataFrame:
    """Replay of the age-bounded flush: origin_id, ordinal, arrival_ms, batch_no.

    A batch closes when it is full, or when an arrival finds its oldest record ``age_ms`` old; later
    arrivals never postpone that. Where a batch ends depends only on where it starts, and a batch has
    at most ``capacity`` records. So each chunk of an origin's rows can tell by itself, for each of its
    first ``capacity`` places, where a chain of batches that enters there leaves it and how many it
    opens. These small tables are put together, chunk after chunk; then each chunk numbers its rows.
    Rows without an origin, ordinal or arrival are left out.
    """
    rows = records.select(F.col("origin_id").cast("string"), F.col("ordinal").cast("long"), F.col("arrival_ms").cast("long")).dropna()
    scan = max(SCAN, 2 * capacity)
    placed = size_batches(rows, scan).withColumnRenamed("batch_no", "chunk")
    place = F.row_number().over(W.partitionBy("origin_id", "chunk").orderBy("ordinal")) - 1
    placed = placed.withColumn("place", place)
    # the rows that a chunk's last batches may reach lie at the start of the next one
    ahead = placed.where(F.col("place") < capacity).withColumns({"chunk": F.col("chunk") - 1, "place": F.col("place") + scan}).where("chunk >= 0")
    both = placed.unionByName(ahead)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = int((pdf["place"] < scan).sum())
        following = _next_starts(pdf["arrival_ms"].to_numpy(), capacity, age_ms)
        exit_, count = _chains(following, own)
        n = min(own, capacity)
        return pd.DataFrame({"origin_id": pdf["origin_id"].iloc[0], "chunk": pdf["chunk"].iloc[0], "entry": np.arange(n), "exit": exit_[:n] - own, "batches": count[:n]})

    paths = _paths(both.groupBy("origin_id", "chunk").applyInPandas(table, _TABLE))

    def number(key: tuple, pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = int((pdf["place"] < scan).sum())
        following = _next_starts(pdf["arrival_ms"].to_numpy(), capacity, age_ms)
        starts, at = np.zeros(own, np.int64), int(path["entry"].iloc[0])
        while at < own:
            starts[at] = 1
            at = int(following[at])
        out = pdf.iloc[:own][["origin_id", "ordinal", "arrival_ms"]]
        return out.assign(batch_no=np.cumsum(starts) + int(path["batches"].iloc[0]) - 1)

    return both.groupBy("origin_id", "chunk").cogroup(paths.groupBy("origin_id", "chunk")).applyInPandas(number, "origin_id string, ordinal long, arrival_ms long, batch_no long")


def _paths(tables: DataFrame) -> DataFrame:
    """Where each chunk is entered, and how many batches were opened before it."""

    def follow(tables: pd.DataFrame, entry: int, batches: int) -> pd.DataFrame:
        out = []
        for chunk, own in tables.groupby("chunk", sort=True):
            out.append((own["origin_id"].iloc[0], chunk, entry, batches))
            if entry < len(own):
                row = own.sort_values("entry").iloc[entry]
                entry, batches = int(row["exit"]), batches + int(row["batches"])
            else:  # a last chunk that is shorter than where the chain enters
                entry -= len(own)
        return pd.DataFrame(out, columns=["origin_id", "chunk", "entry", "batches"])

    most = tables.agg(F.max("chunk")).first()[0] or 0
    if most < FAN:
        return tables.groupBy("origin_id").applyInPandas(lambda pdf: follow(pdf, 0, 0), _PATH)

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [own.sort_values("entry") for _, own in pdf.groupby("chunk", sort=True)]
        at, count = parts[0]["exit"].to_numpy(), parts[0]["batches"].to_numpy()
        for own in parts[1:]:
            inside = at < len(own)
            place = np.minimum(at, len(own) - 1)
            at, count = np.where(inside, own["exit"].to_numpy()[place], at - len(own)), count + np.where(inside, own["batches"].to_numpy()[place], 0)
        return pd.DataFrame({"origin_id": pdf["origin_id"].iloc[0], "chunk": pdf["up"].iloc[0], "entry": np.arange(len(at)), "exit": at, "batches": count})

    grouped = tables.withColumn("up", F.floor(F.col("chunk") / FAN))
    above = _paths(grouped.groupBy("origin_id", "up").applyInPandas(together, _TABLE)).withColumnRenamed("chunk", "up")
    return grouped.groupBy("origin_id", "up").cogroup(above.groupBy("origin_id", "up")).applyInPandas(lambda pdf, top: follow(pdf, int(top["entry"].iloc[0]), int(top["batches"].iloc[0])), _PATH)


def segments(batched: DataFrame) -> DataFrame:
    """origin_id, batch_no, ticket, records, complete: whether the ticket's last record is in that batch."""
    last = batched.groupBy("ticket").agg(F.max("ordinal").alias("ticket_last"))
    per = batched.groupBy("origin_id", "batch_no", "ticket").agg(F.count("*").alias("records"), F.max("ordinal").alias("last"))
    return per.join(last, "ticket").select("origin_id", "batch_no", "ticket", "records", (F.col("last") == F.col("ticket_last")).alias("complete"))


def ticket_states(events: DataFrame) -> DataFrame:
    """ticket, state (Unsettled, Completed, Failed), committed, dropped from ticket events (ticket, kind, records)."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("records"))), F.lit(0))
    had = lambda kind: F.coalesce(F.max(F.col("kind") == kind), F.lit(False))
    per = events.groupBy("ticket").agg(n("committed").alias("committed"), n("dropped").alias("dropped"), had("complete").alias("complete"), had("void").alias("void"))
    state = F.when(F.col("void"), "Completed").when(~F.col("complete"), "Unsettled").when(F.col("dropped") > 0, "Failed").otherwise("Completed")
    return per.select("ticket", state.alias("state"), "committed", "dropped")


def watermark(states: DataFrame) -> DataFrame:
    """committed_through: the greatest N such that tickets 1..N are all settled (0 if there is none)."""
    t = states.where("state <> 'Unsettled' AND ticket >= 1").select("ticket", F.floor((F.col("ticket") - 1) / CHUNK).alias("block")).distinct()
    # of each block how many of its first tickets are settled: places up to the first gap
    placed = t.withColumn("k", F.row_number().over(W.partitionBy("block").orderBy("ticket")))
    blocks = placed.groupBy("block").agg(F.coalesce(F.max(F.when(F.col("ticket") == F.col("block") * CHUNK + F.col("k"), F.col("k"))), F.lit(0)).cast("bigint").alias("settled"))
    return watermark_of_blocks(blocks, CHUNK)


def watermark_of_blocks(blocks: DataFrame, size: int, first: int = 0) -> DataFrame:
    """committed_through of (block, settled), block numbers from ``first`` on being known to matter.

    The first block that isn't settled throughout, whether it is there or not, follows a whole one (or
    is the first): those that whole blocks call for, without the whole ones, have it as their least.
    """
    whole = blocks.where(F.col("settled") == size).select("block")
    start = blocks.sparkSession.range(1).select(F.lit(first).cast("bigint").alias("block"))
    open_ = whole.select((F.col("block") + 1).alias("block")).unionByName(start).join(whole, "block", "left_anti").agg(F.min("block").alias("block"))
    return open_.join(blocks, "block", "left").agg((F.max("block") * size + F.coalesce(F.max("settled"), F.lit(0))).cast("bigint").alias("committed_through"))


def outstanding(states: DataFrame) -> DataFrame:
    """How many issued tickets aren't settled."""
    return states.agg(F.count_if(F.col("state") == "Unsettled").alias("outstanding"))


def commit_acks(request_tickets: DataFrame, states: DataFrame) -> DataFrame:
    """request_id, total, committed, rejected, reason, available: the answer that waits for the commit."""
    joined = request_tickets.join(states, "ticket", "left")
    per = joined.groupBy("request_id").agg(F.sum("records").alias("total"), F.coalesce(F.sum("committed"), F.lit(0)).alias("committed"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))
    rejected = F.col("total") - F.col("committed")
    reason = F.when(rejected == 0, None).when(F.col("dropped") == rejected, "quarantined").otherwise("not_committed")
    return per.select("request_id", "total", "committed", rejected.alias("rejected"), reason.alias("reason"), (F.col("committed") > 0).alias("available"))


def enqueue_acks(request_tickets: DataFrame, accepted: DataFrame) -> DataFrame:
    """The answer once enqueued: only the tail that wasn't taken counts as rejected. accepted: (request_id, taken)."""
    per = request_tickets.groupBy("request_id").agg(F.sum("records").alias("total"))
    joined = per.join(accepted, "request_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return joined.select("request_id", "total", (F.col("total") - F.col("taken")).alias("rejected"), (F.col("taken") > 0).alias("available"))


def batch_counters(batched: DataFrame, capacity: int, dropped: DataFrame | None = None) -> DataFrame:
    """chunks (an origin's tickets), batches, full batches, batches that a timer or the end flushed, and dropped records."""
    per = batched.groupBy("origin_id", "batch_no").agg(F.count("*").alias("n"))
    sizes = per.agg(F.count("*").alias("batches"), F.count_if(F.col("n") == capacity).alias("full"), F.count_if(F.col("n") < capacity).alias("flushed"))
    chunks = batched.select("origin_id", "ticket").distinct().agg(F.count("*").alias("chunks"))
    lost = dropped.agg(F.count("*").alias("dropped")) if dropped is not None else batched.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("dropped"))
    return sizes.crossJoin(chunks).crossJoin(lost).select("chunks", "batches", "full", "flushed", "dropped")  # one row each


def drained_at(samples: DataFrame, target: int | None = None, stable_ms: int = 1500) -> DataFrame:
    """The first time t_ms at which the count n reached the target. Without a target: at which a count above 0 had not changed for ``stable_ms``."""
    rows = samples.where("t_ms IS NOT NULL AND n IS NOT NULL").groupBy("t_ms").agg(F.max("n").alias("n"))
    if target is not None:
        return rows.where(F.col("n") >= target).agg(F.min("t_ms").alias("t_ms"))
    # the sample before each one, and the last change up to it, carried from cell to cell of time
    last = rows.select("t_ms", F.struct("t_ms", "n").alias("s")).withColumn("cell", F.shiftright("t_ms", prefix.BITS))
    carried = prefix.before(last.groupBy("cell").agg(F.max("s").alias("s")), (), "cell", {"s": "max"}).withColumnRenamed("s", "c")
    earlier = F.coalesce(F.lag("s").over(W.partitionBy("cell").orderBy("t_ms")), F.col("c"))["n"]
    marked = last.join(carried, "cell").select("t_ms", F.col("s.n").alias("n"), F.when(~earlier.eqNullSafe(F.col("s.n")), F.col("t_ms")).alias("since"))
    since = prefix.running(marked, (), "t_ms", {"since": "max"})
    return since.where((F.col("n") > 0) & (F.col("t_ms") - F.col("since") >= stable_ms)).agg(F.min("t_ms").alias("t_ms"))
