"""Bounds on whole requests, counted mapping losses, and quarantine of single rows."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, mapping


@dataclass(frozen=True)
class Limits:
    """Fixed default bounds of one export request."""

    records: int = 100_000
    attributes: int = 1_000
    key_bytes: int = 512
    value_bytes: int = 64 * 1024
    depth: int = 32
    body_bytes: int = 1024 * 1024
    string_bytes: int = 64 * 1024
    scope_bytes: int = 16 * 1024 * 1024
    chunks: int = 50_000


def request_shape(records: DataFrame) -> DataFrame:
    """records and chunks (non-empty scope groups) of each request."""
    scopes = records.groupBy("request_id", "resource_idx", "scope_idx").agg(F.count("*").alias("n"))
    return scopes.groupBy("request_id").agg(F.sum("n").alias("records"), F.count("*").alias("chunks"))


#: The lists of attributes of a record, and what the walk over each value tells (canonical.WALKED).
LISTS = {"attributes": "attribute_facts", "resource_attributes": "resource_facts", "scope_attributes": "scope_facts"}


def _record_tests(limits: Limits, columns: Collection[str]) -> dict[str, Column]:
    """Why one record breaks its request: in its own, its resource's or its scope's fields.

    Bounds on keys, leaves and depth hold inside containers too, and in structured bodies (body_fact).
    """
    any_list = lambda test: _or([F.exists(c, test) for c in LISTS])
    any_fact = lambda field, most: _or([F.exists(c, lambda x: x[field] > most) for c in LISTS.values()] + [F.coalesce(F.col("body_fact")[field] > most, F.lit(False))])
    plain = ("schema_url", "scope_name", "scope_version", "scope_schema_url", "severity_text", "event_name")
    return {
        "attribute_count": _or([(F.col(f"{c}_n") if f"{c}_n" in columns else F.size(c)) > limits.attributes for c in LISTS]),
        "key_bytes": any_list(lambda x: F.octet_length(x["key"]) > limits.key_bytes) | any_fact("max_key_bytes", limits.key_bytes),
        "value_bytes": any_fact("max_leaf_bytes", limits.value_bytes),
        "nesting_depth": any_fact("depth", limits.depth),
        "body_bytes": F.col("body_size") > limits.body_bytes,
        "string_bytes": F.greatest(*[F.coalesce(F.octet_length(c), F.lit(0)) for c in plain]) > limits.string_bytes,
    }


def _or(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _scope_bytes() -> Column:
    """A scope's metadata: name, version, schema URL, and for each attribute its key, its value's estimated size and a fixed overhead."""
    add = lambda acc, x: acc + x
    keys = F.aggregate(F.transform("scope_attributes", lambda x: F.octet_length(x["key"]) + canonical.ENTRY_OVERHEAD), F.lit(0), add)
    values = F.aggregate(F.transform("scope_facts", lambda x: x["size"]), F.lit(0).cast("long"), add)
    text = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return keys + values + text("scope_name") + text("scope_version") + text("scope_schema_url")


GROUP = ["request_id", "resource_idx", "scope_idx"]


def request_violations(records: DataFrame, limits: Limits, reasons: Collection[str] | None = None) -> DataFrame:
    """(request_id, reason) pairs, distinct, from bounds on records and on the request's shape; those of some reasons, or all.

    Tests for other reasons aren't made, nor are the columns that only they read.

    Records are read once: a scope group sums up which bounds its records break, how many they are and
    how large its metadata is, and a request sums up its groups.
    """
    tests = {name: t for name, t in _record_tests(limits, records.columns).items() if reasons is None or name in reasons}
    bits = F.lit(0)
    for k, t in enumerate(tests.values()):
        bits = bits.bitwiseOR(F.when(t, 1 << k).otherwise(0))
    scopes = records.groupBy(*GROUP).agg(F.bit_or(bits).alias("bits"), F.count("*").alias("n"), F.max(_scope_bytes()).alias("meta"))
    whole = scopes.groupBy("request_id").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("records"), F.count("*").alias("chunks"), F.max(_expands(limits)).alias("expands"))
    broken = {**{name: F.col("bits").bitwiseAND(1 << k) != 0 for k, name in enumerate(tests)}, "record_count": F.col("records") > limits.records, "chunk_count": F.col("chunks") > limits.chunks, "scope_expansion": F.col("expands")}
    broken = {name: t for name, t in broken.items() if reasons is None or name in reasons}
    return whole.select("request_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in broken.items()]))).alias("reason"))


def _expands(limits: Limits) -> Column:
    return F.coalesce(F.col("meta") > F.floor(F.lit(limits.scope_bytes) / F.col("n")), F.lit(False))


def scope_expansion(records: DataFrame, limits: Limits) -> DataFrame:
    """Requests with a scope whose metadata, repeated for each of its records, exceeds the budget."""
    scopes = records.groupBy(*GROUP).agg(F.max(_scope_bytes()).alias("meta"), F.count("*").alias("n"))
    return scopes.where(_expands(limits)).select("request_id", F.lit("scope_expansion").alias("reason"))


def judge_records(records: DataFrame, violations: DataFrame) -> DataFrame:
    """records with accepted: one violation rejects the whole request."""
    bad = violations.select("request_id").distinct().withColumn("__bad", F.lit(True))
    return records.join(bad, "request_id", "left").withColumn("accepted", F.col("__bad").isNull()).drop("__bad")


def rejected_requests(parsed: DataFrame, violations: DataFrame) -> DataFrame:
    """The requests that are given back, one row for each line: request_id, reasons (sorted), bytes, preview.

    ``parsed`` has a row (request_id, value, reason) for each line that came in; those that couldn't be
    read have their reason there, the others may have broken bounds (request_id, reason).
    """
    broken = violations.groupBy("request_id").agg(F.collect_set("reason").alias("broken"))  # from a dozen reasons
    all_ = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("reason"), F.coalesce("broken", F.array().cast("array<string>"))))))
    joined = parsed.select("request_id", "reason", F.coalesce(F.octet_length("value"), F.lit(0)).alias("bytes"), mapping.safe_preview(F.col("value")).alias("preview")).join(broken, "request_id", "left")
    return joined.select("request_id", all_.alias("reasons"), "bytes", "preview").where("size(reasons) > 0")


def split_requests(records: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records: one violation rejects the whole request."""
    bad = violations.select("request_id").distinct()
    return records.join(bad, "request_id", "left_anti"), records.join(bad, "request_id", "left_semi")


def mapping_losses(raw: DataFrame) -> DataFrame:
    """(reason, n): what mapping had to change or drop.

    String-table references, and values that aren't of the kind that they claim, count wherever a value
    is mapped: in a record's attributes and structured body for each record, in a scope's or resource's
    attributes once for each group. A reference that is a body itself counts as an absent body. Times
    that are no unsigned 64-bit numbers count with the values.
    """
    flags = {"timestamp_overflow": mapping.timestamp_overflows(F.col("time_unix_nano")), "invalid_trace_id": mapping.id_invalid(F.col("trace_id"), 16), "invalid_span_id": mapping.id_invalid(F.col("span_id"), 8), "unknown_severity": mapping.severity_unknown(F.col("severity_number"))}
    values = {"string_value_strindex": "strindex_losses", "invalid_scalar": "scalar_losses"}
    losses = lambda c, field: F.aggregate(F.transform(c, lambda x: x[field]), F.lit(0), lambda acc, x: acc + x)
    cells = [F.count_if(f).alias(f"own_{name}") for name, f in flags.items()]
    for name, field in values.items():
        own = losses("attribute_facts", field) + F.coalesce(F.col(f"body_fact.{field}"), F.lit(0)) + (F.col("wrong_scalars") if name == "invalid_scalar" else F.lit(0))
        cells += [F.sum(own).alias(f"own_{name}"), F.max(losses("scope_facts", field)).alias(f"scope_{name}"), F.max(losses("resource_facts", field)).alias(f"resource_{name}")]
    scopes = raw.groupBy(*GROUP).agg(*cells)
    names = [*flags, *values]
    groups = scopes.groupBy("request_id", "resource_idx").agg(*[(F.sum(f"own_{n}") + (F.sum(f"scope_{n}") + F.max(f"resource_{n}") if n in values else F.lit(0))).alias(n) for n in names])
    total = groups.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return total.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).cast("long").alias("n")) for n in names])).alias("x")).select("x.*").where("n > 0")


def poison_reason() -> Column:
    """Why one row can't be stored, else null: only faults of the row itself count."""
    return F.when(F.col("resource_id").isNull(), "missing resource").when(F.col("timestamp_ns").isNull(), "missing timestamp").when(~F.col("severity_number").between(0, 24), "severity out of range").when(F.col("flags").isNull() | (F.col("flags") < 0), "flags out of range")


def salvage(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(healthy rows, quarantined rows with their reason, kept and dropped per ticket)."""
    marked = rows.withColumn("reason", poison_reason())
    per = marked.groupBy("ticket").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("dropped"))
    bad = marked.where("reason IS NOT NULL").withColumn("body_preview", mapping.safe_preview(F.col("body")))
    return marked.where("reason IS NULL").drop("reason"), bad, per


def index_state_valid() -> Column:
    """The states that a search index's row may be in."""
    return (F.col("mode").isin("off", "body", "full") & F.col("status").isin("current", "rebuilding") & (F.col("last_rowid") >= 0) & ((F.col("status") == "rebuilding") == F.col("rebuild_until").isNotNull()) & (F.col("mode").isin("body", "full") | (F.col("status") == "current"))).alias("valid")
