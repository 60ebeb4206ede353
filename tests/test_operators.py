"""Fixed expected values, properties, and empty tables."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.functions import canonical, mapping
from kelpline.functions.tokens import cut, cuttable, tokens
from kelpline.operators import histogram, identity, intervals, lifecycle, reports, search, tickets, validation
from kelpline.sources import otlp_json
from kelpline.sources.access_log import parse_access_log
from kelpline.sources.driver_tables import log_tables, raw_records, stored_records
from kelpline.streaming import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def pairs(*items):
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in items])


def test_canonical_json(spark):
    assert one(spark, canonical.attributes_json(pairs(("b", "1"), ("a", "2"), ("b", "3")))) == '{"a":2,"b":3}'
    assert one(spark, canonical.attributes_json(F.array().cast(canonical.ATTRIBUTES))) == "{}"
    assert one(spark, canonical.json_string(F.lit('he"llo\x07'))) == '"he\\"llo\\u0007"'


def test_nested_walk():
    kv = {"kvlistValue": {"values": [{"key": "b", "value": {"intValue": "1"}}, {"key": "a", "value": {"intValue": "2"}}, {"key": "b", "value": {"intValue": "3"}}, {"key": "nan", "value": {"doubleValue": "NaN"}}]}}
    arr = {"arrayValue": {"values": [{"boolValue": True}, {"doubleValue": 1.5}, {"bytesValue": "3q0="}, {"kvlistValue": {"values": [{"key": "z", "value": {"intValue": 1}}, {"key": "a", "value": {"stringValue": "x"}}]}}]}}
    assert canonical.walk_value(kv)[0] == '{"a":2,"b":3,"nan":null}'
    assert canonical.walk_value(arr)[0] == '[true,1.5,"dead",{"a":"x","z":1}]'
    assert canonical.walk_value({"stringValueStrindex": 3})[::5] == ("null", 1)
    assert canonical.walk_value({})[0] == "null"
    deep = {"stringValue": "x"}
    for _ in range(32):
        deep = {"arrayValue": {"values": [deep]}}
    assert canonical.walk_value(deep)[1] == 32
    assert canonical.walk_value({"stringValue": "abc"})[4] == canonical.NODE_OVERHEAD + 3
    assert canonical.walk_value({"kvlistValue": {"values": [{"key": "k", "value": {"stringValue": "abc"}}]}})[4] == 2 * canonical.NODE_OVERHEAD + canonical.ENTRY_OVERHEAD + 4


def test_doubles(spark):
    from kelpline.plans.read_model import DOUBLES

    for value, plain, text in DOUBLES:
        assert (one(spark, mapping.plain_double(F.lit(value))), one(spark, mapping.json_double(F.lit(value))), canonical.float_json(value)) == (plain, text, text)


def test_health_rules(spark):
    base = {"writer_running": True, "batcher_running": True, "writer_idle_ms": 0, "batcher_idle_ms": 0, "queue_depth": 0, "queue_capacity": 100, "pending_records": 0, "outstanding_tickets": 0, "watermark_idle_ms": 0, "maintenance_in_progress": False, "maintenance_elapsed_ms": 0}
    cases = [
        ({"writer_idle_ms": 10**9, "batcher_idle_ms": 10**9}, "Healthy"), ({"pending_records": 5}, "Healthy"), ({"queue_depth": 5, "pending_records": 5, "writer_idle_ms": 150, "batcher_idle_ms": 150}, "Unhealthy"),
        ({"queue_depth": 5, "writer_idle_ms": 60, "batcher_idle_ms": 60}, "Degraded"), ({"queue_depth": 5, "writer_idle_ms": 5, "batcher_idle_ms": 10_000}, "Healthy"), ({"pending_records": 5, "writer_idle_ms": 10_000, "batcher_idle_ms": 5}, "Healthy"),
        ({"maintenance_in_progress": True, "maintenance_elapsed_ms": 200, "outstanding_tickets": 2, "watermark_idle_ms": 50_000}, "Degraded"), ({"maintenance_in_progress": True, "maintenance_elapsed_ms": 300}, "Unhealthy"), ({"maintenance_in_progress": True, "queue_depth": 75}, "Degraded"),
        ({"outstanding_tickets": 1, "watermark_idle_ms": 70, "writer_idle_ms": 70, "batcher_idle_ms": 70}, "Unhealthy"), ({"outstanding_tickets": 1, "watermark_idle_ms": 70, "writer_idle_ms": 70, "batcher_idle_ms": 10}, "Healthy"), ({"queue_depth": 75}, "Degraded"), ({"queue_depth": 75, "queue_capacity": 0}, "Healthy"), ({"writer_running": False}, "Unhealthy"),
    ]
    rows = spark.createDataFrame([{**base, **c, "k": i} for i, (c, _) in enumerate(cases)])
    got = {r["k"]: r["state"] for r in reports.health(rows, 50, 100, 60, 300, 0.75).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_signal_drop(spark, tmp_path):
    for name in ("metric", "scope", "log_event"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}")
    assert lifecycle.drop_signal(spark, f"file://{tmp_path}") == ["metric", "scope"] and spark.read.parquet(f"{tmp_path}/log_event").count() == 1


def test_bodies(spark):
    assert one(spark, mapping.plain_double(F.lit(5.0))) == "5"
    assert one(spark, mapping.plain_double(F.lit(1e21))) == "1000000000000000000000"
    assert one(spark, mapping.plain_double(F.lit(float("nan")))) == "NaN"
    assert one(spark, mapping.lossy_text(F.unhex(F.lit("FF61")))) == "�a"
    assert one(spark, mapping.body_choice(F.lit(""), F.lit("{}"))) == "{}"
    assert one(spark, mapping.severity_name(F.lit(2))) == "UNSPECIFIED"
    assert one(spark, mapping.safe_preview(F.lit("a\nb\x85c"))) == "a�b�c"
    assert mapping.retention_cutoff(5, 2**63) == 5 - 2**63 if 5 - 2**63 >= -(2**63) else -(2**63)


def test_ids(spark):
    for raw, want in (("0102", None), ("00" * 16, None), ("", None), ("ab" * 16, "ab" * 16)):
        assert one(spark, mapping.hex_text(mapping.parse_id(F.unhex(F.lit(raw)), 16))) == want
    assert one(spark, mapping.id_invalid(F.unhex(F.lit("0102")), 16)) is True
    assert one(spark, mapping.id_invalid(F.unhex(F.lit("")), 16)) is False


def test_fingerprint(spark):
    import hashlib

    want = hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in (b"svc", "hoé".encode(), b"", b"{}"))).hexdigest()
    assert one(spark, canonical.fingerprint(F.lit("svc"), F.lit("hoé"), F.lit(None).cast("string"), F.lit("{}"))) == want


def test_tokens(spark):
    assert one(spark, tokens(F.lit("Café ÉtÉ-x_1 Å"))) == ["cafe", "ete", "x", "1", "a"]
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


def spans(spark, items):
    return spark.createDataFrame(items, "start long, end long")


def covered(df):
    return {v for r in df.collect() for v in range(r["start"], r["end"] + 1)}


@pytest.mark.parametrize("bits", [4, 16])
def test_intervals_against_sets(spark, bits, monkeypatch):
    from kelpline.operators import prefix

    monkeypatch.setattr(prefix, "BITS", bits)  # 4: totals are carried over many cells, and cells of cells
    rng = random.Random(4)
    for _ in range(2):
        a = [(s, s + rng.randint(-2, 30)) for s in (rng.randint(-200, 400) for _ in range(30))]
        b = [(s, s + rng.randint(-2, 9)) for s in (rng.randint(-200, 400) for _ in range(30))]
        sa, sb = ({v for s, e in x for v in range(s, e + 1)} for x in (a, b))
        merged = intervals.merge(spans(spark, a))
        assert covered(merged) == sa and merged.count() == len([v for v in sa if v - 1 not in sa])
        assert covered(intervals.subtract(spans(spark, a), spans(spark, b))) == sa - sb
        points = spark.range(450).union(spark.range(3)).select(F.col("id").alias("v"), F.lit(1).alias("start"))
        got = [r["v"] for r in intervals.contains(points, spans(spark, a)).collect()]
        assert set(got) == {v for v in sa if 0 <= v < 450} and len(got) == sum((2 if v < 3 else 1) for v in sa if 0 <= v < 450)
        assert {r["v"] for r in intervals.missing(spans(spark, a), spark.createDataFrame([(v,) for v in sb], "v long")).collect()} == sa - sb
    assert intervals.total(spans(spark, [(5, 10), (1, 3), (11, 20), (2, 4)])).first()[0] == 20
    assert intervals.total(spans(spark, [])).first()[0] == 0


def test_missing_of_a_long_range(spark):
    """Three thousand million expected values: only gaps are made."""
    found = spans(spark, [(1, 1_500_000_000), (1_500_000_004, 3_000_000_000)])
    gaps = intervals.subtract(spans(spark, [(1, 3_000_000_000)]), found)
    assert [r["v"] for r in intervals.values(gaps).orderBy("v").collect()] == [1_500_000_001, 1_500_000_002, 1_500_000_003]
    assert intervals.values(spans(spark, [(5, 200_004)])).count() == 200_000


def test_size_batches(spark):
    rows = spark.range(560).select(F.lit("a").alias("origin_id"), F.col("id").alias("ordinal"), F.when(F.col("id") < 70, 1).when(F.col("id") < 220, 2).when(F.col("id") < 470, 3).otherwise(4).alias("ticket"))
    got = tickets.size_batches(rows, 100)
    assert got.groupBy("batch_no").count().count() == 6
    seg = {(r["batch_no"], r["ticket"]): (r["records"], r["complete"]) for r in tickets.segments(got).collect()}
    assert seg[0, 1] == (70, True) and seg[0, 2] == (30, False) and seg[2, 2] == (20, True)


def test_tickets_watermark(spark):
    def state(events):
        return tickets.ticket_states(spark.createDataFrame(events, "ticket long, kind string, records long"))

    s = state([(1, "committed", 2), (1, "complete", 0), (2, "committed", 1), (2, "dropped", 1), (3, "issued", 1), (4, "void", 0)])
    assert {r["ticket"]: (r["state"], r["committed"], r["dropped"]) for r in s.collect()} == {1: ("Completed", 2, 0), 2: ("Unsettled", 1, 1), 3: ("Unsettled", 0, 0), 4: ("Completed", 0, 0)}
    assert tickets.watermark(s).first()[0] == 1
    done = state([(t, "complete", 0) for t in (1, 2, 3, 5)])
    assert tickets.watermark(done).first()[0] == 3
    assert tickets.watermark(state([])).first()[0] == 0


def test_age_batches_do_not_extend(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 6, 9, 10, 12, 19, 20])], "origin_id string, ordinal long, arrival_ms long")
    got = {r["ordinal"]: r["batch_no"] for r in tickets.age_batches(rows, 500, 10).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2}


def test_age_batches_in_chunks(spark, monkeypatch):
    """Chunks of a hot origin, and tables of chunks put together, give what one scan gives."""
    monkeypatch.setattr(tickets, "SCAN", 16)
    monkeypatch.setattr(tickets, "FAN", 3)
    rng, rows, want = random.Random(7), [], {}
    for origin, n in (("hot", 400), ("b", 17), ("c", 1)):
        t, batch, size, oldest = 0, 0, 0, 0
        for i in range(n):
            t += rng.choice([0, 0, 1, 2, 5, 30, -2])
            if size and (size >= 7 or t >= oldest + 10):
                batch, size = batch + 1, 0
            oldest = t if not size else oldest
            size += 1
            rows.append((origin, 3 * i, t))
            want[origin, 3 * i] = batch
    got = tickets.age_batches(spark.createDataFrame(rows, "origin_id string, ordinal long, arrival_ms long"), 7, 10).collect()
    assert {(r["origin_id"], r["ordinal"]): r["batch_no"] for r in got} == want and len(got) == len(rows)


def test_drained(spark):
    samples = spark.createDataFrame([(0, 0), (200, 0), (2000, 0), (2200, 5), (2400, 7), (3000, 7), (3900, 7), (9000, 9), (70_000_000, 9)], "t_ms long, n long")
    assert tickets.drained_at(samples, 7).first()[0] == 2400
    assert tickets.drained_at(samples, 99).first()[0] is None
    assert tickets.drained_at(samples).first()[0] == 3900
    assert tickets.drained_at(samples, stable_ms=5000).first()[0] == 70_000_000


def test_purge_and_quota(spark, sf):
    events, resources = log_tables(spark, sf)
    low, high = events.agg(F.min("timestamp_ns"), F.max("observed_timestamp_ns")).first()
    kept, used = lifecycle.purge(events, resources, high, (high - low) // 2)
    again, used2 = lifecycle.purge(kept, used, high, (high - low) // 2)
    assert 0 < kept.count() < events.count() and again.count() == kept.count() and used2.count() == used.count()
    kept, gone = lifecycle.oldest(events, 7).collect(), events.count()
    first = events.orderBy("timestamp_ns", "id").limit(7).collect()
    assert [r["id"] for r in kept] == [r["id"] for r in first]
    left = lifecycle.enforce_quota(events, 1, batch=100, rounds=1000)
    assert gone - left.count() == (gone - 1) // 100 * 100
    assert left.count() == (events.count() - 1) % 100 + 1
    assert lifecycle.enforce_quota(events, 10**12).count() == events.count()


def test_snapshot_restore(spark, sf, tmp_path):
    events, resources = log_tables(spark, sf)
    at = lifecycle.snapshot(spark, {"log_event": events, "log_resource": resources}, str(tmp_path))
    back = lifecycle.restore(spark, at, str(tmp_path / "restored"))
    assert lifecycle.verify(back["log_event"], back["log_resource"], "6")["ok"]
    small = lifecycle.compact(spark, f"{at}/log_event", str(tmp_path / "compact"), 2, ["resource_id", "timestamp_ns"])
    assert lifecycle.checksum(small).first() == lifecycle.checksum(events).first()


def scanned(spark, df):
    """Rows that the scans of a query give on, before any filter."""
    df.collect()
    plan, rows = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            plan.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            plan.append(node.plan())
        elif node.nodeName().startswith("Scan"):
            rows += node.metrics().apply("numOutputRows").value()
        plan += [node.children().apply(k) for k in range(node.children().size())]
    return rows


def test_search_rebuild_converges(spark, sf, tmp_path):
    events, _ = log_tables(spark, sf)
    top = events.agg(F.max("id")).first()[0]
    root = f"file://{tmp_path}/index"
    busy = [True]
    make = lambda: search.Rebuild(spark, events, root, "body", top, unit=100, file_rows=300, busy=lambda: busy[0])
    first = make()
    assert first.step() and first.done() == 1  # one unit while other work runs
    later = make()  # goes on where the cursor stands
    assert later.done() == 1
    search.postings(events.limit(5), "body").write.parquet(f"{root}/postings/unit=1")  # what a failed try left
    busy[0] = False
    assert later.step() and later.done() == 1 + search.IDLE_UNITS
    while later.step():
        pass
    assert later.done() == 10 and not later.step()
    want = search.postings(events, "body")
    assert later.index().count() == want.count() and later.index().exceptAll(want.select(*later.index().columns)).isEmpty()
    pages = later.pages.collect()
    assert later.zones.count() >= 3 and max(len(later.page(p["first_id"], p["last_id"]).inputFiles()) for p in pages) <= 2
    assert sum(scanned(spark, later.page(p["first_id"], p["last_id"])) for p in pages) <= 2 * events.count()


def test_idle_rebuild_takes_few_steps(spark, sf, tmp_path):
    """Steps grow while nothing else runs, and fall back to one unit when something does."""
    events, _ = log_tables(spark, sf)
    busy = [False]
    index = search.Rebuild(spark, events, f"file://{tmp_path}/index", "body", events.agg(F.max("id")).first()[0], unit=10, file_rows=300, busy=lambda: busy[0])
    done = []
    for busy[0] in (False, False, True, False):
        assert index.step()
        done.append(index.done())
    assert done == [4, 12, 13, 17]
    steps = 4
    while index.step():
        steps += 1
    assert index.done() == 100 and steps <= 9
    want = search.postings(events, "body")
    assert index.index().count() == want.count() and index.index().exceptAll(want.select(*index.index().columns)).isEmpty()


def test_records_are_not_dealt_by_resource(spark, sf):
    """The few distinct resources are broadcast: no exchange of records by a handful of keys."""
    rows = stored_records(raw_records(spark, sf)).select("id", "resource_id")
    assert rows.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_last_of_equal_keys(spark):
    """Null keys and values, repeated keys, keys that need escapes, and lists that are null or empty."""
    lists = [[("b", "1"), ("a", "2"), ("b", None)], [(None, "1"), (None, "2"), ("a", "3")], [('q"', "1"), ("a\n", "2"), ('q"', "3")], [], None, [("é", "1"), ("z", "2"), ("Z", "3"), ("z", "4")]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, a array<struct<key:string,value:string>>")
    got = [r[0] for r in df.orderBy("k").select(canonical.attributes_json(F.col("a"))).collect()]
    assert got == ['{"a":2,"b":null}', got[1], '{"a\\n":2,"q\\"":3}', "{}", None, '{"Z":3,"z":4,"é":1}']
    assert [[x["value"] for x in r[0]] for r in df.where("k = 1").select(canonical.last_wins(F.col("a"))).collect()] == [["2", "1", "3"]]


def test_trace_filters_skip_row_groups(spark, sf):
    """A trace that isn't there opens no row group, though its id lies between others."""
    events, _ = log_tables(spark, sf)
    some = bytes(events.agg(F.max("trace_id")).first()[0])
    assert 0 < scanned(spark, identity.trace_lookup(events, some).select("id", "trace_id")) < events.count()
    absent = bytes([some[0] // 2]) + bytes(range(15))
    assert scanned(spark, identity.trace_lookup(events, absent).select("id", "trace_id")) == 0


def test_mergeable_histogram(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.randint(0, 3000), int(rng.lognormvariate(10, 3)), 0, 2047, 2048, 2**31]) for _ in range(4000)] + [-5, 10**12, None]
    rows = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "g int, v long")
    own = histogram.histogram(rows, ["g"], "v")
    assert own.groupBy("g", "bucket").count().where("count > 1").isEmpty() and own.where("most - least > least / 1024").isEmpty()
    parts = [histogram.histogram(rows.where(F.pmod(F.hash("v"), F.lit(3)) == k), ["g"], "v") for k in range(3)]
    assert sorted(map(tuple, histogram.merge(parts, ["g"]).collect())) == sorted(map(tuple, own.collect()))
    for by, groups in ((["g"], [0, 1, 2]), ([], [None])):
        for r in histogram.summary(histogram.merge([own], by), by).collect():
            have = sorted(min(max(v, 0), histogram.HIGHEST) for k, v in enumerate(values) if v is not None and (not by or k % 3 == r["g"]))
            assert (r["n"], r["min"], r["max"]) == (len(have), have[0], have[-1])
            for name, p in reports.PERCENTILES.items():
                exact = have[max(1, math.ceil(p * len(have))) - 1]
                assert exact <= r[name] <= exact * (1 + 2**-histogram.BITS)


def test_next_starts_against_a_scan():
    rng = random.Random(8)
    for _ in range(200):
        n, capacity, age = rng.randint(1, 60), rng.randint(1, 12), rng.randint(1, 30)
        t = np.cumsum([rng.choice([0, 1, 5, 20, -15]) for _ in range(n)])
        want = [next((j for j in range(i + 1, min(i + capacity, n)) if t[j] >= t[i] + age), min(i + capacity, n)) for i in range(n)]
        got = tickets._next_starts(t, capacity, age)
        assert got.tolist() == want
        exits, counts = tickets._chains(got, n)
        assert all(exits == n) and counts[0] == len({*itertools.accumulate(range(n), lambda at, _: want[at] if at < n else at, initial=0)} - {n})


def test_stored_index_is_read_by_bucket(spark, sf, tmp_path):
    events, _ = log_tables(spark, sf)
    search.write_index(search.postings(events, "body"), f"file://{tmp_path}/p")
    stored = spark.read.parquet(f"file://{tmp_path}/p")
    hits = search.term_search(stored, events, "error")
    assert "PartitionFilters: [isnotnull(bucket" in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == events.where(search.contains_term(F.col("body"), "error")).count() > 0


def test_blocks_hold_all_postings(spark, sf, tmp_path, monkeypatch):
    """Null, negative and repeated ids, texts without tokens, and other alphabets; far fewer rows than tokens."""
    texts = ["Red red x_1", None, " ", "ÉtÉ Å e\u0301 red", "\u0130 \u212a ١٢ 中文 red", "-red--RED-", ""]
    rows = spark.createDataFrame([(i, texts[k % 7], "svc red") for k, i in enumerate([5, -3, 40_000, 5, None, 7, -40_000, 5, 0, -3, 9])], "id bigint, body string, service_name string")
    rows = rows.withColumns({c: F.lit("") for c in search.FULL if c not in rows.columns})
    want = search.postings(rows, "full")
    for most in (1, search.BLOCK_BYTES):
        monkeypatch.setattr(search, "BLOCK_BYTES", most)
        got = search.blocks(rows.coalesce(1), "full")
        key = lambda r: tuple(map(repr, r))
        assert sorted(map(key, search.unblocked(got).collect())) == sorted(map(key, want.collect()))
    counted = lambda df: sorted(map(tuple, df.groupBy("term").agg(F.count("*"), F.countDistinct("id")).collect()))
    for mode, some in (("full", rows), ("body", rows), ("body", rows.where("id > 6")), ("full", rows.where("id > 6"))):
        assert sorted(map(tuple, search.term_counts(search.blocks(some, mode), mode, some).collect())) == counted(search.postings(some, mode))
    search.write_index(got, f"file://{tmp_path}/b")
    assert sorted(r["id"] for r in search.term_search(spark.read.parquet(f"file://{tmp_path}/b"), rows.where("id IS NOT NULL"), "red", "body").collect()) == sorted(r["id"] for r in rows.where("id IS NOT NULL").where(search.contains_term(F.col("body"), "red")).collect())


def test_tokens_cut_from_bytes(spark):
    """All tokens with their places, as the regular expressions find them; no ASCII text is changed before."""
    texts = ["", None, "a", "Red red\tx_1", "x", "9-É Å e\u0301-", "\u0130 \u212a ١٢ 中文A", " -- ", "end\x00End\x7f", "ǅ ß K", "zz"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    read = rows.select(cuttable(F.col("t")).alias("c"), F.coalesce(tokens(F.col("t")), F.array()).alias("w")).toArrow()
    assert [c for c, t in zip(read["c"].to_pylist(), texts, strict=True) if t and t.isascii()] == [t for t in texts if t and t.isascii()]
    want = [(k, i, w) for k, words in enumerate(read["w"].to_pylist()) for i, w in enumerate(words)]
    column = read["c"].combine_chunks()
    row, place, words = cut(column)
    assert list(zip(row.tolist(), place.tolist(), words.to_pylist(), strict=True)) == want
    row, place, words = cut(column.slice(3, 6))
    assert list(zip((row + 3).tolist(), place.tolist(), words.to_pylist(), strict=True)) == [x for x in want if 3 <= x[0] < 9]
    assert len(cut(column.slice(0, 2))[2]) == 0


def test_one_row_group_is_mapped_by_many_tasks(spark, sf):
    """A file's row group is one task's work until it is dealt."""
    given, dealt = raw_records(spark, sf), raw_records(spark, sf, even=True)
    tasks = lambda rows: rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(given) == 1 and tasks(dealt) >= spark.sparkContext.defaultParallelism
    ids = lambda rows: sorted(r["id"] for r in rows.select("id").collect())
    assert ids(given) == ids(dealt)


def test_stored_indexes_have_few_rows(spark, sf):
    """What is dealt, sorted and stored isn't a row for each token."""
    from kelpline.plans import ingest

    for index in (ingest.body_index(spark, sf), ingest.full_index(spark, sf)):
        assert index.agg(F.sum("n")).first()[0] > 2 * index.count()


def test_time_ranges_prune(spark, sf):
    from kelpline.plans.read_model import JAN_10, JAN_20

    events, _ = log_tables(spark, sf)
    plan = events.where(mapping.in_range("timestamp_ns", JAN_10, JAN_20))._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1].split("]")[0] and "timestamp_ns" in plan.split("PushedFilters")[1].split("]")[0]
    got = spark.range(1).select(*[mapping.event_date(F.lit(t)).cast("string").alias(f"d{i}") for i, t in enumerate((0, -1, 2**63 - 1, JAN_10))]).first()
    assert tuple(got) == ("1970-01-01", "1969-12-31", "2262-04-11", "2024-01-10")


def test_correctness_report_finds_faults(spark):
    none = spans(spark, [])
    good = spark.range(1, 101).select(F.col("id").alias("v"))
    assert reports.correctness(good, 100, none, none).first()["passed"]
    bad = good.where("v <> 7").unionByName(spark.createDataFrame([(9,), (200,)], "v long"))
    r = reports.correctness(bad, 100, spans(spark, [(3, 4)]), none).first()
    assert (r["missing"], r["duplicate"], r["unexpected"], r["rejected_present"], r["passed"]) == (1, 1, 1, 2, False)


def test_access_log(spark):
    lines = spark.createDataFrame([('1.2.3.4 - bob [10/Oct/2024:13:55:36 -0700] "GET /a?b HTTP/1.0" 200 2326 "-" "x y"',), ("junk",)], "value string")
    good, bad = sorted(parse_access_log(lines).collect(), key=lambda r: r["status"] is None)
    assert (good["path"], good["status"], good["user"], good["referer"]) == ("/a?b", 200, "bob", None) and bad["path"] is None
    assert str(good["time"]) == "2024-10-10 20:55:36"


REQUEST = {
    "resourceLogs": [
        {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeLogs": [
            {"scope": {"name": "s"}, "logRecords": [
                {"timeUnixNano": "0", "observedTimeUnixNano": 222, "severityNumber": 9, "body": {"stringValue": "hi"}, "traceId": "ab" * 16, "attributes": [{"key": "n", "value": {"intValue": 5}}]},
                {"timeUnixNano": "18446744073709551615", "body": {"kvlistValue": {"values": [{"key": "b", "value": {"intValue": "1"}}, {"key": "a", "value": {"stringValue": 'x"y'}}]}}},
            ]},
            {"scope": {"name": "empty"}, "logRecords": []},
        ]},
        {"scopeLogs": []},
    ]
}


def test_otlp_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(REQUEST) + "\n")
    rows = otlp_json.flatten(otlp_json.read_requests(spark, str(tmp_path)))
    got = sorted(rows.collect(), key=lambda r: r["record_idx"])
    assert [r["body"] for r in got] == ["hi", ""] and got[1]["body_json"] == '{"a":"x\\"y","b":1}'
    assert got[0]["attributes"][0]["value"] == "5" and got[0]["trace_id"].hex() == "ab" * 16
    stored = stored_records(rows.withColumns({c: F.lit(None) for c in ("user_id", "event_type", "value", "ts")}).withColumn("id", F.col("record_idx")))
    by = {r["id"]: r for r in stored.collect()}
    assert by[1]["body"] == '{"a":"x\\"y","b":1}'
    assert by[0]["timestamp_ns"] == 222 and by[1]["timestamp_ns"] == 2**63 - 1 and by[0]["service_name"] == "shop"


def test_requests_stream_to_tables(spark, tmp_path):
    """Export requests in files, as a stream, through flatten and mapping to the stored tables."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(REQUEST) + "\nnot json\n")
    flat = otlp_json.flatten(otlp_json.stream_requests(spark, f"file://{tmp_path}/in", 1))
    named = flat.withColumns({"id": F.xxhash64("request_id", "record_idx"), "ticket": F.lit(1), "user_id": F.lit(0), "event_type": F.lit(""), "value": F.lit(0.0), "ts": F.lit(None).cast("timestamp")})
    sinks.start(stored_records(named).withColumn("ticket", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    assert sorted(r["body"] for r in out("log_event").collect()) == ["hi"] * 3 + ['{"a":"x\\"y","b":1}'] * 3
    assert {r["service_name"] for r in out("log_resource").collect()} == {"shop"} and out("log_resource").count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = stored_records(raw_records(spark, sf)).withColumn("ticket", F.expr("id div 20 + 1"))
    for k in range(2):
        rows.where(f"id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sinks.start(sinks.counted(stream, F.col("id") % 20 == 0), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert sinks.counters(query) == {"records": rows.count(), "dropped": 0, "chunks": rows.select("ticket").distinct().count()}
    out = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    events, resources = log_tables(spark, sf)
    assert out("log_event").count() == events.count() and out("log_resource").count() == resources.count()
    assert out("postings").count() == search.postings(events, "body").count() and out("quarantine").count() == 0


def test_salvage_and_limits(spark, sf):
    rows = stored_records(raw_records(spark, sf)).withColumn("ticket", F.lit(1)).withColumn("severity_number", F.when(F.col("id") == 5, 30).otherwise(F.col("severity_number")))
    good, bad, per = validation.salvage(rows)
    assert bad.select("id", "reason").collect()[0] == (5, "severity out of range") and per.first()["dropped"] == 1
    assert validation.request_violations(raw_records(spark, sf), validation.Limits()).count() == 0


def test_empty_tables(spark, sf):
    events, resources = (t.limit(0) for t in log_tables(spark, sf))
    assert lifecycle.purge(events, resources, 0, 0)[0].count() == 0
    assert lifecycle.enforce_quota(events, 0).count() == 0
    assert search.postings(events, "body").count() == 0
