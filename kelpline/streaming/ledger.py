"""Tickets, watermark and acknowledgements kept up to date by a stream of ticket events.

Events come in any order and in any micro-batches, late ones too; what has been said last of a ticket
equals ``tickets.ticket_states`` over all events so far, and the watermark ``tickets.watermark`` of
these states. State is keyed by blocks of BLOCK consecutive tickets, so that the tickets of a busy
moment belong to many tasks; a block knows each of its tickets, and up to where all of its tickets are
settled. Both need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .. import store
from ..operators import tickets

#: Consecutive tickets whose state is kept together.
BLOCK = 1024

_TICKET = StructType([StructField("ticket", LongType())])
_SEEN = StructType([StructField("committed", LongType()), StructField("dropped", LongType()), StructField("complete", BooleanType()), StructField("void", BooleanType())])
_PREFIX = StructType([StructField("settled", LongType())])
#: A row of a ticket (kind ticket), or of its block (kind block: ``settled`` is how many of its first tickets are settled).
LEDGER = StructType([StructField("block", LongType()), StructField("kind", StringType()), StructField("ticket", LongType()), StructField("state", StringType()), StructField("committed", LongType()), StructField("dropped", LongType()), StructField("settled", LongType())])


def state_of(seen: tuple) -> str:
    """As ``tickets.ticket_states``."""
    _, dropped, complete, void = seen
    if void:
        return "Completed"
    if not complete:
        return "Unsettled"
    return "Failed" if dropped > 0 else "Completed"


def _folded(seen: tuple | None, events: pd.DataFrame) -> tuple:
    committed, dropped, complete, void = seen or (0, 0, False, False)
    n = events.groupby("kind")["records"].sum()
    kinds = set(events["kind"])
    return int(committed + n.get("committed", 0)), int(dropped + n.get("dropped", 0)), bool(complete or "complete" in kinds), bool(void or "void" in kinds)


class Ledger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", _TICKET, _SEEN)
        self.prefix = handle.getValueState("prefix", _PREFIX)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, (block,) = pd.concat(list(rows)), key
        out, first = [], block * BLOCK + 1
        settled = self.prefix.get()[0] if self.prefix.exists() else 0
        for ticket, own in events.groupby("ticket"):
            at = (int(ticket),)
            seen = _folded(self.seen.getValue(at) if self.seen.containsKey(at) else None, own)
            self.seen.updateValue(at, seen)
            out.append((block, "ticket", at[0], state_of(seen), seen[0], seen[1], None))
        while settled < BLOCK and self.seen.containsKey((first + settled,)) and state_of(self.seen.getValue((first + settled,))) != "Unsettled":
            settled += 1
        self.prefix.update((settled,))
        out.append((block, "block", None, None, None, None, settled))
        yield pd.DataFrame(out, columns=LEDGER.fieldNames()).astype({"ticket": "Int64", "committed": "Int64", "dropped": "Int64", "settled": "Int64"})

    def close(self) -> None:
        pass


def ledger(events: DataFrame) -> DataFrame:
    """LEDGER rows of a stream of ticket events (ticket, kind, records): of each ticket that an event touched, and of its block."""
    rows = events.where("ticket >= 1").select(F.floor((F.col("ticket") - 1) / BLOCK).cast("long").alias("block"), F.col("ticket").cast("long").alias("ticket"), "kind", F.col("records").cast("long").alias("records"))
    return rows.groupBy("block").transformWithStateInPandas(Ledger(), outputStructType=LEDGER, outputMode="Update", timeMode="None")


def write_ledger(root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for LEDGER rows: tables tickets and blocks with what is new, and the watermark after each batch."""

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        rows.where("kind = 'ticket'").select("ticket", "state", "committed", "dropped").write.mode("overwrite").parquet(f"{root}/tickets/batch={batch_id}")
        rows.where("kind = 'block'").select("block", "settled").write.mode("overwrite").parquet(f"{root}/blocks/batch={batch_id}")
        before = committed_through(spark, root, batch_id)
        blocks = spark.read.schema("block long, settled long, batch long").parquet(f"{root}/blocks").where(F.col("batch") <= batch_id)
        # only blocks from the watermark's on can move it
        new = blocks.where(F.col("block") >= before // BLOCK).groupBy("block").agg(F.max_by("settled", "batch").alias("settled"))
        tickets.watermark_of_blocks(new, BLOCK, before // BLOCK).write.mode("overwrite").parquet(f"{root}/watermark/batch={batch_id}")
        rows.unpersist()

    return write


def committed_through(spark: SparkSession, root: str, before: int | None = None) -> int:
    """The watermark after the last batch, or after the last one before ``before``."""
    if not store.exists(spark, f"{root}/watermark"):
        return 0
    rows = spark.read.schema("committed_through long, batch long").parquet(f"{root}/watermark")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.agg(F.coalesce(F.max("committed_through"), F.lit(0))).first()[0]


def current_tickets(spark: SparkSession, root: str) -> DataFrame:
    """ticket, state, committed, dropped: what was said last of each ticket."""
    rows = spark.read.schema("ticket long, state string, committed long, dropped long, batch long").parquet(f"{root}/tickets")
    last = F.max_by(F.struct("state", "committed", "dropped"), "batch").alias("s")
    return rows.groupBy("ticket").agg(last).select("ticket", "s.*")


def start(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Take up what is there of a stream of ticket events, then stop; the checkpoint keeps the state for the next start."""
    return ledger(events).writeStream.outputMode("update").foreachBatch(write_ledger(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_REQUEST = StructType([StructField("tickets", LongType()), StructField("answered", BooleanType())])
_ISSUED = StructType([StructField("records", LongType()), StructField("issued", BooleanType()), *_SEEN.fields])
ACKS = StructType([StructField("request_id", StringType()), StructField("total", LongType()), StructField("committed", LongType()), StructField("rejected", LongType()), StructField("reason", StringType()), StructField("available", BooleanType())])


class Acks(StatefulProcessor):
    """Answers a request once, when all the tickets that it was said to have are issued and done.

    A ticket is done if it is void, or complete with all its records committed or dropped; so its events may come in any order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.request = handle.getValueState("request", _REQUEST)
        self.issued = handle.getMapState("issued", _TICKET, _ISSUED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        n, answered = self.request.get() if self.request.exists() else (None, False)
        said = events[events["kind"] == "request"]["records"]
        n = int(said.iloc[-1]) if len(said) else n
        for ticket, own in events[events["kind"] != "request"].groupby("ticket"):
            at = (int(ticket),)
            records, issued, *seen = self.issued.getValue(at) if self.issued.containsKey(at) else (0, False, 0, 0, False, False)
            issues = own[own["kind"] == "issued"]["records"]
            self.issued.updateValue(at, (int(records + issues.sum()), bool(issued or len(issues)), *_folded(tuple(seen), own)))
        out = []
        if n is not None and not answered:
            own = [v for _, v in self.issued.iterator()]
            if len(own) >= n and all(v[1] and (v[5] or v[4] and v[2] + v[3] >= v[0]) for v in own):
                total, committed, dropped = (sum(v[k] for v in own) for k in (0, 2, 3))
                rejected = total - committed
                reason = None if rejected == 0 else "quarantined" if dropped == rejected else "not_committed"
                out.append((key[0], total, committed, rejected, reason, committed > 0))
                answered = True
        self.request.update((n, answered))
        yield pd.DataFrame(out, columns=ACKS.fieldNames())

    def close(self) -> None:
        pass


def acks(events: DataFrame) -> DataFrame:
    """Answers (as ``tickets.commit_acks``) of a stream of (request_id, ticket, kind, records).

    Kinds: request (records: how many tickets the request has), issued (records of the ticket), and those
    of ticket events. A request of no tickets is answered at once, with nothing rejected.
    """
    rows = events.select(F.col("request_id").cast("string").alias("request_id"), F.col("ticket").cast("long").alias("ticket"), "kind", F.col("records").cast("long").alias("records"))
    return rows.groupBy("request_id").transformWithStateInPandas(Acks(), outputStructType=ACKS, outputMode="Append", timeMode="None")
