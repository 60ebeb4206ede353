"""Versioned tables and the segmented index: concurrent writers, pinned readers, deletes, compaction, merges."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from kelpline.functions import mapping
from kelpline.operators import search, segments
from kelpline.operators.versions import Conflict, Tables
from kelpline.sources.driver_tables import log_tables, raw_records, stored_records
from kelpline.streaming import sinks

EVENT = "id bigint, resource_id string, timestamp_ns bigint, body string, event_date date"
RESOURCE = "id string, service_name string"
DAY = 86_400_000_000_000


def events(spark, low, high, step=DAY // 4):
    rows = spark.range(low, high).select("id", F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("resource_id"), (F.col("id") * step).alias("timestamp_ns"), F.lit("b").alias("body"))
    return rows.withColumn("event_date", mapping.event_date(F.col("timestamp_ns")))


def resources(spark, n=3):
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.lit("svc").alias("service_name"))


def files(tables, table="log_event"):
    """Names and times of a table's files in the latest version."""
    out = {}
    for f in tables.folders():
        if f.table == table:
            for s in tables.system.listStatus(tables._path(f"{tables.root}/data/{table}/{f.path}")):
                out[f"{f.path}/{s.getPath().getName()}"] = s.getModificationTime()
    return out


def test_writers_and_pinned_readers(spark, tmp_path):
    """Two tables always agree, while several writers append at once; no append is lost."""
    t = Tables(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and t.read("a", "id bigint").count() == 0
    seen, errors = [], []

    def write(k):
        try:
            for i in range(3):
                own = spark.range(10 * k + i, 10 * k + i + 1)
                t.append({"a": own, "b": own.withColumn("x", F.lit(k))})
        except Exception as error:
            errors.append(error)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for w in writers:
        w.start()
    while any(w.is_alive() for w in writers):
        v = t.version()
        seen.append((v, t.read("a", "id bigint", v).count(), t.read("b", "id bigint, x int", v).count()))
    for w in writers:
        w.join()
    assert not errors and all(a == b == v for v, a, b in seen) and t.version() == 12
    assert sorted(r["id"] for r in t.read("a", "id bigint").collect()) == sorted(10 * k + i for k in range(4) for i in range(3))
    old = t.read("a", "id bigint", 3)
    t.append({"a": spark.range(5)})
    assert old.count() == 3


def test_snapshots_copy_nothing(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    t.append({"log_event": events(spark, 0, 40), "log_resource": resources(spark)})
    before = files(t)
    assert t.snapshot("nightly") == 1 and t.snapshots() == {"nightly": 1}
    with pytest.raises(ValueError, match="already"):
        t.snapshot("nightly")
    t.append({"log_event": events(spark, 40, 60)})
    t.delete_through("log_event", EVENT, 10 * DAY)
    t.restore("nightly")
    assert files(t) == before and t.read("log_event", EVENT).count() == 40
    t.vacuum(keep=1)
    assert files(t) == before and t.read("log_event", EVENT, t.snapshots()["nightly"]).count() == 40


def test_purge_drops_days_and_rewrites_the_border(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    t.append({"log_event": events(spark, 0, 40), "log_resource": resources(spark, 5)})
    t.append({"log_event": events(spark, 40, 60)})
    before = files(t)
    now, window = 60 * DAY // 4, 60 * DAY // 4 - (5 * DAY + DAY // 3)  # the cutoff lies within day 5
    assert t.purge(now, window, EVENT, RESOURCE) == {"deleted": 22, "orphans": 2}
    left = t.read("log_event", EVENT)
    assert sorted(r["id"] for r in left.collect()) == list(range(22, 60))
    assert {r["id"] for r in t.read("log_resource", RESOURCE).collect()} == {"r0", "r1", "r2"}
    newer = {n: m for n, m in before.items() if n.split("event_date=")[1][:10] > "1970-01-06"}
    assert newer.items() <= files(t).items() and len(newer) >= 9
    version = t.version()
    assert t.purge(now, window, EVENT, RESOURCE) == {"deleted": 0, "orphans": 0} and t.version() == version  # again: nothing to do
    assert t.delete_through("log_event", EVENT, 22 * DAY // 4, 22) == 1  # at the time itself, up to an id


def test_purge_sees_events_that_arrive(spark, tmp_path, monkeypatch):
    """An event of a resource that was to go arrives before the purge commits: the resource stays, in each version."""
    t = Tables(spark, f"file://{tmp_path}/t")
    t.append({"log_event": events(spark, 0, 40), "log_resource": resources(spark, 5)})
    late = events(spark, 40, 41).withColumn("resource_id", F.lit("r4"))
    commit = t._commit

    def commit_after_another(add, remove, unchanged=None):
        monkeypatch.setattr(t, "_commit", commit)
        t.append({"log_event": late})
        return commit(add, remove, unchanged)

    monkeypatch.setattr(t, "_commit", commit_after_another)
    assert t.purge(40 * DAY // 4, 5 * DAY, EVENT, RESOURCE) == {"deleted": 20, "orphans": 1}
    for v in range(1, t.version() + 1):
        known = t.read("log_resource", RESOURCE, v).select(F.col("id").alias("resource_id"))
        assert t.read("log_event", EVENT, v).join(known, "resource_id", "left_anti").count() == 0
    assert {r["id"] for r in t.read("log_resource", RESOURCE).collect()} == {"r0", "r1", "r2", "r4"}
    assert sorted(r["id"] for r in t.read("log_event", EVENT).collect()) == list(range(20, 41))

    def never(add, remove, unchanged=None):  # rows keep on arriving
        if unchanged:
            raise Conflict("changed")
        return commit(add, remove, unchanged)

    t.append({"log_resource": spark.createDataFrame([("r9", "svc")], RESOURCE)})
    monkeypatch.setattr(t, "_commit", never)
    assert t.purge(41 * DAY // 4, 5 * DAY, EVENT, RESOURCE, tries=2) == {"deleted": 1, "orphans": 0}
    monkeypatch.setattr(t, "_commit", commit)
    assert t.purge(42 * DAY // 4, 5 * DAY, EVENT, RESOURCE) == {"deleted": 1, "orphans": 1}


def test_quota_deletes_the_oldest(spark, tmp_path):
    """Against a loop over sorted rows: ties of times, a border inside a day, a quota that can't be met, and one that is."""
    rows = [(i, f"r{i % 3 if i > 12 else 7}", (i // 4) * (DAY // 5), "x" * (i % 7), "{}") for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, resource_id string, timestamp_ns bigint, body string, attributes_json string").withColumn("event_date", mapping.event_date(F.col("timestamp_ns")))
    schema = "id bigint, resource_id string, timestamp_ns bigint, body string, attributes_json string, event_date date"
    own = spark.createDataFrame([(r, "svc") for r in ("r0", "r1", "r2", "r7")], RESOURCE)
    for quota, rounds in ((150, 8), (0, 3), (0, 80), (10_000, 8)):
        t = Tables(spark, f"file://{tmp_path}/t{quota}-{rounds}")
        t.append({"log_event": df, "log_resource": own})
        left, n = sorted(rows, key=lambda r: (r[2], r[0])), 0
        while sum(len(r[3]) + 2 for r in left) > quota and n < rounds and len(left) > 6:
            left, n = left[6:], n + 1
        used = {r[1] for r in left}
        assert t.enforce_quota(quota, schema, RESOURCE, batch=6, rounds=rounds) == {"deleted": 50 - len(left), "orphans": 4 - len(used)}
        assert sorted(r["id"] for r in t.read("log_event", schema).collect()) == sorted(r[0] for r in left)
        assert {r["id"] for r in t.read("log_resource", RESOURCE).collect()} == used and t.version() == 1 + (len(left) < 50)


def test_compaction_by_size(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    for k in range(4):
        t.append({"log_event": events(spark, 10 * k, 10 * k + 10, DAY // 100)})
    t.append({"log_event": events(spark, 1000, 1004, DAY // 100)})
    before, want = files(t), sorted(map(tuple, t.read("log_event", EVENT).collect()))
    assert t.compact("log_event", EVENT) == ["1970-01-01"]
    after = files(t)
    assert len([n for n in after if "1970-01-01" in n]) == 1 < len([n for n in before if "1970-01-01" in n])
    assert {n: m for n, m in before.items() if "1970-01-11" in n}.items() <= after.items()
    assert sorted(map(tuple, t.read("log_event", EVENT).collect())) == want and t.compact("log_event", EVENT) == []
    size = sum(f.bytes for f in t.folders() if f.day == "1970-01-01")
    t.append({"log_event": events(spark, 40, 60, DAY // 100)})
    assert t.compact("log_event", EVENT, target_bytes=size // 4) == []  # the folders' files are large by that measure
    with pytest.raises(Conflict):
        t.replace("log_event", events(spark, 0, 1), 1)


def test_stream_puts_each_batch_once(spark, sf, tmp_path):
    """Batches of all tables under one version: a replay adds nothing, a purged resource comes again, compaction shrinks what batches left."""
    rows = stored_records(raw_records(spark, sf)).withColumn("ticket", F.expr("id div 20 + 1")).persist()
    t = Tables(spark, f"file://{tmp_path}/t")
    write = sinks.write_versioned(t, "s")
    for k in range(3):
        write(rows.where(f"id % 3 = {k}"), k)
    assert t.version() == 3 and t.last_batch("s") == 2 and t.last_batch("other") == -1
    write(rows.where("id % 3 = 2"), 2)
    assert t.version() == 3
    all_events, all_resources = log_tables(spark, sf)
    schema = ", ".join(f"{c} {k}" for c, k in rows.drop("service_name", "host_name", "schema_url", "resource_json").dtypes) + ", event_date date"
    own = "id string, service_name string, host_name string, schema_url string, attributes_json string, first_seen bigint, resource_bucket int"
    ids = lambda df, c="id": sorted(r[c] for r in df.select(c).collect())
    assert ids(t.read("log_event", schema)) == ids(all_events) and ids(t.read("log_resource", own)) == ids(all_resources)
    assert t.read("postings", "id bigint").count() == search.postings(all_events, "body").count() and t.read("tickets", "kept bigint").agg(F.sum("kept")).first()[0] == rows.count()
    days = {f.part for f in t.folders() if f.table == "log_event"}
    assert set(t.compact("log_event", schema)) == days and ids(t.read("log_event", schema)) == ids(all_events)
    assert sum(f.files for f in t.folders() if f.table == "log_event") == len(days)
    t.compact("log_resource", own, order=("id",))
    assert ids(t.read("log_resource", own)) == ids(all_resources)

    # most events go before the next batch is put, and their resources with them; saturated times stay
    read, once = t.read, []
    stay = rows.where(F.col("timestamp_ns") >= 2**62)
    n_stay, used = stay.count(), {r["resource_id"] for r in stay.collect()}
    assert 0 < n_stay < 10

    def read_then_purge(table, *args, **kwargs):
        out = read(table, *args, **kwargs)
        if table == "log_resource" and not once:
            once.append(1)
            out = out.persist()
            out.count()
            assert t.purge(2**62, 0, schema, own) == {"deleted": rows.count() - n_stay, "orphans": len(ids(all_resources)) - len(used)}
        return out

    t.read = read_then_purge
    late = rows.where("id % 50 = 0")
    write(late, 3)
    t.read = read
    assert once and t.last_batch("s") == 3 and ids(t.read("log_event", schema)) == ids(late.unionAll(stay))
    assert ids(t.read("log_resource", own)) == sorted({r["resource_id"] for r in late.collect()} | used)


def test_segments_equal_a_fresh_index(spark, tmp_path, monkeypatch):
    """Appends, deletes, deletes of what isn't there, and ids that come again, against an index of what is left."""
    rng = random.Random(3)
    index, live = segments.SegmentedIndex(spark, f"file://{tmp_path}/i", "body"), {}
    schema = "id bigint, body string"
    for turn in range(9):
        new = {i: " ".join(rng.choices(["red", "green", "Blue", "x y"], k=rng.randint(0, 4))) for i in rng.sample([*range(-3, 30), 40_000, 90_000], 5) if i not in live}
        if new:
            index.append(spark.createDataFrame(list(new.items()), schema).coalesce(1))
            live |= new
        if turn % 2:
            gone = rng.sample(sorted(live), min(3, len(live))) + [77]
            index.delete(spark.createDataFrame([(i,) for i in gone], "id bigint"))
            live = {i: b for i, b in live.items() if i not in gone}
        assert len(index.segments()) < segments.FAN
        fresh = search.postings(spark.createDataFrame(list(live.items()), schema), "body")
        if turn in (3, 8):
            assert sorted(map(tuple, index.postings().select(*fresh.columns).collect())) == sorted(map(tuple, fresh.collect()))
        got = {r["id"] for r in index.search("blue", rng.choice([None, "body"])).collect()}
        assert got == {i for i, b in live.items() if "Blue" in b}
    assert index.search("blue", "service_name").count() == 0


def test_segments_keep_blocks(spark, tmp_path):
    """Tombstones take postings out of blocks, over cells of negative and large ids and a null one; blocks aren't taken apart."""
    index = segments.SegmentedIndex(spark, f"file://{tmp_path}/i", "body")
    ids = [None, *range(-40, 40), *range(32_760, 32_780)]
    index.append(spark.createDataFrame([(i, "red blue red") for i in ids], "id bigint, body string").coalesce(1))
    index.delete(spark.createDataFrame([(i,) for i in [None, *range(-40, 40, 2), 32_768]], "id bigint"))
    left = [i for i in ids if i is None or not (-40 <= i < 40 and i % 2 == 0 or i == 32_768)]
    assert sorted(map(repr, (r["id"] for r in index.postings().where("term = 'red' AND pos = 2").collect()))) == sorted(map(repr, left))
    got = {r["term"]: (r["n"], r["docs"], r["blocks"]) for r in index.blocks().groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.count("*").alias("blocks")).collect()}
    assert got == {"red": (2 * len(left), len(left) - 1, 4), "blue": (len(left), len(left) - 1, 4)}
