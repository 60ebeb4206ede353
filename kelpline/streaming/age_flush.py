"""Age-bounded batches in a stream: a timer at the oldest buffered record, which later arrivals don't move.

The buffer is a list in the state store; a batch that closes gives its records, with their batch number.
By the arrival clock (``batches_by_age``) a batch closes when it is full, or when an arrival, or the
stream's event-time watermark, finds its oldest record ``age_ms`` old: the batches of
``tickets.age_batches`` on the same arrival times. By the processing clock (``flush_by_age``) a timer
closes it. Both need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUTPUT = StructType([StructField("origin_id", StringType()), StructField("ordinal", LongType()), StructField("arrival_ms", LongType()), StructField("batch_no", LongType()), StructField("reason", StringType())])
STATE = StructType([StructField("batch_no", LongType()), StructField("records", LongType()), StructField("deadline", LongType())])
RECORD = StructType([StructField("ordinal", LongType()), StructField("arrival_ms", LongType())])


class AgeFlush(StatefulProcessor):
    """Buffers each origin's records; gives a batch's records when it is full or its first record is ``age_ms`` old."""

    def __init__(self, capacity: int, age_ms: int, by_arrival: bool):
        self.capacity, self.age_ms, self.by_arrival = capacity, age_ms, by_arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", STATE)
        self.buffer = handle.getListState("buffer", RECORD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, size, deadline = self.head.get() if self.head.exists() else (0, 0, 0)
        held = [tuple(r) for r in self.buffer.get()] if size else []
        came = pd.concat(list(rows)).sort_values("ordinal")
        now, out, had = timerValues.getCurrentProcessingTimeInMs(), [], deadline

        def close(reason: str) -> None:
            nonlocal batch, held
            out.extend((key[0], o, t, batch, reason) for o, t in held)
            batch, held = batch + 1, []

        arrivals = came["arrival_ms"].tolist() if self.by_arrival else [now] * len(came)
        for ordinal, t in zip(came["ordinal"].tolist(), arrivals, strict=True):
            if held and self.by_arrival and t >= deadline:
                close("age")
            if not held:
                deadline = t + self.age_ms
            held.append((ordinal, t))
            if len(held) == self.capacity:
                close("full")
        deadline = deadline if held else 0
        if deadline != had:
            if had:
                self.handle.deleteTimer(had)
            if deadline:
                self.handle.registerTimer(deadline)
        self._keep(batch, held, deadline)
        yield pd.DataFrame(out, columns=OUTPUT.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch, size, deadline = self.head.get()
        out = []
        if size and deadline and expiredTimerInfo.getExpiryTimeInMs() >= deadline:
            out = [(key[0], o, t, batch, "age") for o, t in (tuple(r) for r in self.buffer.get())]
            self._keep(batch + 1, [], 0)
        yield pd.DataFrame(out, columns=OUTPUT.fieldNames())

    def _keep(self, batch: int, held: list[tuple[int, int]], deadline: int) -> None:
        self.head.update((batch, len(held), deadline))
        if held:
            self.buffer.put(held)
        else:
            self.buffer.clear()

    def close(self) -> None:
        pass


def flush_by_age(records: DataFrame, capacity: int = 500, age_ms: int = 10) -> DataFrame:
    """OUTPUT rows of a stream with origin_id and ordinal; records arrive when they are processed."""
    rows = records.select(F.col("origin_id").cast("string").alias("origin_id"), F.col("ordinal").cast("long").alias("ordinal"))
    return rows.groupBy("origin_id").transformWithStateInPandas(AgeFlush(capacity, age_ms, False), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")


def batches_by_age(records: DataFrame, capacity: int = 500, age_ms: int = 10, late_ms: int = 1) -> DataFrame:
    """OUTPUT rows of a stream with origin_id, ordinal and arrival_ms; its clock stays ``late_ms`` behind the latest arrival of any origin.

    What arrives no later than the clock is lost to the stream, so ``late_ms`` is 1 at least: equal times stay apart from it.
    """
    rows = records.select(F.col("origin_id").cast("string").alias("origin_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("arrival_ms").cast("long").alias("arrival_ms"))
    timed = rows.dropna().withColumn("arrived", F.timestamp_millis("arrival_ms")).withWatermark("arrived", f"{max(1, late_ms)} milliseconds")
    return timed.groupBy("origin_id").transformWithStateInPandas(AgeFlush(capacity, age_ms, True), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
