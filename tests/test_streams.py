"""Streams of tickets and batches equal their batch forms, however the input is split, and over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from kelpline.operators import tickets
from kelpline.streaming import age_flush, ledger

EVENTS = "ticket long, kind string, records long"


def written(spark, rows, schema, folder, parts, seed):
    """The rows as files of random sizes, one for each micro-batch."""
    rng = random.Random(seed)
    cuts = sorted(rng.choices(range(len(rows) + 1), k=parts - 1))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_equals_batch(spark, tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    events = []
    for t in [*range(1, 60), *range(70, 80), 2000, 2001]:
        n = rng.randint(1, 3)
        events += [(t, rng.choice(["committed", "committed", "committed", "dropped"]), rng.randint(1, 9)) for _ in range(n)]
        events += [(t, "complete", 0)] if t != 50 else []
        events += [(t, "void", 0)] if t % 17 == 0 else []
    rng.shuffle(events)
    half = len(events) // 2
    for part, rows in enumerate((events[:half], events[half:])):  # a restart between them
        written(spark, rows, EVENTS, tmp_path / "in" / str(part), 3, seed)
        ledger.start(stream(spark, EVENTS, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        want = tickets.ticket_states(spark.createDataFrame(events[: half * (part + 1) + part * len(events)], EVENTS))
        assert sorted(map(tuple, ledger.current_tickets(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
        assert ledger.committed_through(spark, str(tmp_path / "out")) == tickets.watermark(want).first()[0]
    assert ledger.committed_through(spark, str(tmp_path / "out")) == 49
    late = [(50, "complete", 0)]
    written(spark, late, EVENTS, tmp_path / "in" / "late", 1, seed)
    ledger.start(stream(spark, EVENTS, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert ledger.committed_through(spark, str(tmp_path / "out")) == 59


def test_watermark_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(tickets, "CHUNK", 4)
    for settled in ([], [2], [1], [1, 2, 3, 4], [1, 2, 3, 4, 5, 7], [*range(1, 13)], [*range(1, 9), 13, 14], [5, 6, 7, 8]):
        states = spark.createDataFrame([(t, "Completed") for t in settled] + [(99, "Unsettled")], "ticket long, state string")
        want = next(n for n in range(20) if n + 1 not in settled)
        assert tickets.watermark(states).first()[0] == want


def test_acks_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, issued, events = [], [], []
    for r in range(8):
        own = range(10 * r + 1, 10 * r + 1 + r % 4)
        rows.append((f"r{r}", None, "request", len(own)))
        for t in own:
            n = rng.randint(1, 9)
            issued.append((f"r{r}", t, n))
            dropped = rng.choice([0, 0, n, n // 2])
            kinds = [("committed", n - dropped), ("dropped", dropped), ("complete", 0)] if t != 31 else [("void", 0)]
            events += [(t, k, x) for k, x in kinds]
            rows += [(f"r{r}", t, "issued", n), *((f"r{r}", t, k, x) for k, x in kinds)]
    rng.shuffle(rows)
    schema = "request_id string, " + EVENTS
    written(spark, rows, schema, tmp_path / "in", 4, 5)
    q = ledger.acks(stream(spark, schema, tmp_path / "in")).writeStream.format("memory").queryName("acks").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = tickets.commit_acks(spark.createDataFrame(issued, "request_id string, ticket long, records long"), tickets.ticket_states(spark.createDataFrame(events, EVENTS)))
    empty = [(f"r{r}", 0, 0, 0, None, False) for r in (0, 4)]
    assert sorted(map(tuple, spark.table("acks").collect()), key=str) == sorted([*map(tuple, want.collect()), *empty], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_records_equal_replay(spark, tmp_path, seed):
    """Batch numbers of records, for random splits and a restart, equal those of the batch replay."""
    rng = random.Random(seed)
    rows, t = [], 1_000_000
    for i in range(400):
        t += rng.choice([0, 1, 5, 5, 40, 300])
        rows.append((rng.choice("abc"), i, t))
    schema = "origin_id string, ordinal long, arrival_ms long"
    start = lambda: age_flush.batches_by_age(stream(spark, schema, tmp_path / "in"), 7, 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    written(spark, rows[:250], schema, tmp_path / "in" / "0", 3, seed)
    start()
    # a late record of another origin moves the clock past all deadlines
    written(spark, [*rows[250:], ("z", 9999, t + 10_000)], schema, tmp_path / "in" / "1", 3, seed)
    start()
    got = sorted((r["origin_id"], r["ordinal"], r["arrival_ms"], r["batch_no"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in tickets.age_batches(spark.createDataFrame(rows, schema), 7, 100).collect())
    assert got == want


def test_flush_by_the_processing_clock(spark, tmp_path):
    import time

    spark.range(7).select(F.lit("a").alias("origin_id"), F.col("id").alias("ordinal")).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = stream(spark, "origin_id string, ordinal long", tmp_path / "in")
    q = age_flush.flush_by_age(rows, 3, 50).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    end = time.time() + 90
    while time.time() < end and spark.table("flushed").count() < 7 and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert sorted((r["batch_no"], r["ordinal"], r["reason"]) for r in spark.table("flushed").collect()) == [(0, 0, "full"), (0, 1, "full"), (0, 2, "full"), (1, 3, "full"), (1, 4, "full"), (1, 5, "full"), (2, 6, "age")]
