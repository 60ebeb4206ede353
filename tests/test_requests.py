"""Export requests that can't be read, or hold values of the wrong kind: nothing vanishes."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpline.functions import canonical, json_bytes
from kelpline.operators import validation
from kelpline.sources import otlp_json


def request(*attributes, body="b", n=1, **record):
    kv = [{"key": f"k{i}", "value": v} for i, v in enumerate(attributes)]
    return {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": body}, "attributes": kv, **record} for _ in range(n)]}]}]}


def deep(levels):
    """A list in a list ..., and a list of keys innermost: ``levels`` containers around it."""
    return '{"arrayValue":{"values":[' * levels + '{"kvlistValue":{"values":[]}}' + "]}}" * levels


def with_value(text):
    return json.dumps(request({"stringValue": "@"})).replace('{"stringValue": "@"}', text)


def frames(line):
    """depth and framed, by a scan of characters."""
    depth = most = zeros = 0
    inside = escaped = False
    ink = [i for i, c in enumerate(line) if c not in " \t\n\r\x0b\x0c"]
    first = last = None
    low = 0
    for i, c in enumerate(line):
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            continue
        if c == "\\":
            return None  # no JSON, whatever its brackets are: left to the parser
        if c == '"':
            inside, escaped = True, False
        elif c in "[{]}":
            depth += 1 if c in "[{" else -1
            most, low, zeros = max(most, depth), min(low, depth), zeros + (depth == 0)
            first, last = (i if first is None else first), i
    return {"depth": most, "framed": bool(ink) and first is not None and not inside and low == 0 and zeros == 1 and first == ink[0] and last == ink[-1] and line[first] == "{"}


def test_frames_against_a_scan(monkeypatch):
    rng = random.Random(2)
    lines = ["", "{}", " {} ", "[]", "{}{}", '{"a":"}"}', '{"a":"\\"}"}', '{"a":"\\\\"}', "}{", "5", '"{}"', '{"a":1} x', "{" * 5000, "{}\\"]
    lines += ["".join(rng.choices('{}[]"\\ a', weights=[4, 4, 2, 2, 3, 2, 1, 3], k=rng.randint(1, 12))) for _ in range(4000)]
    for size in (json_bytes.SLICE, 50):
        monkeypatch.setattr(json_bytes, "SLICE", size)
        for kind in (pa.string(), pa.large_string()):
            got = json_bytes.scan_lines(pa.array(["skipped", *lines], kind).slice(1)).to_pylist()
            wrong = [(x, g, frames(x)) for x, g in zip(lines, got, strict=True) if frames(x) and g["framed"] != frames(x)["framed"] or g["framed"] and frames(x) and g["depth"] != frames(x)["depth"]]
            assert not wrong
    assert json_bytes.scan_lines(pa.array([None, "{}"])).to_pylist() == [{"depth": 0, "framed": False}, {"depth": 1, "framed": True}]


def read(spark, tmp_path, lines):
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n")
    parsed = otlp_json.read_requests(spark, str(tmp_path))
    records = otlp_json.flatten(parsed)
    return parsed, records, validation.request_violations(records, validation.Limits())


def test_every_line_is_a_record_or_a_rejection(spark, tmp_path):
    good = json.dumps(request({"intValue": "1"}))
    cases = {
        good: [], with_value(deep(31)): [], with_value(deep(32)): ["nesting_depth"], with_value(deep(340)): ["nesting_depth"], with_value(deep(100_000)): ["nesting_depth"],
        "not json": ["malformed"], "": ["malformed"], "[1]": ["malformed"], good + good: ["malformed"], good[:-1]: ["malformed"], good + "x": ["malformed"], '{"resourceLogs":[{]}}': ["malformed"], '{"resourceLogs":5}': ["malformed"],
        json.dumps(request(severityNumber="x")): ["malformed"], "{}": [], '{"resourceLogs":[]}': [], '{"resourceLogs":null,"more":[[]]}': [], json.dumps(request(body="x" * 2_000_000)): ["body_bytes"],
    }
    lines = [*cases, good, good, "not json"]
    parsed, records, violations = read(spark, tmp_path, lines)
    assert parsed.count() == len(lines)
    rejected = validation.rejected_requests(parsed, violations).collect()
    want = sorted([r for r in cases.values() if r] + [["malformed"]])
    assert sorted(r["reasons"] for r in rejected) == want
    assert all(len(r["preview"]) <= 200 and "\n" not in r["preview"] for r in rejected)
    judged = validation.judge_records(records, violations)
    accepted = judged.where("accepted").select("request_id").distinct().count()
    empty = 3
    assert accepted == 4 and accepted + empty + len(rejected) == len(lines)


@pytest.mark.parametrize("levels", [31, 32])
def test_validation_and_walk_agree_on_the_boundary(spark, tmp_path, levels):
    _, records, violations = read(spark, tmp_path, [with_value(deep(levels))])
    assert [r["reason"] for r in violations.collect()] == (["nesting_depth"] if levels >= 32 else [])
    assert records.select(canonical.attributes_json(F.col("attributes")).alias("j")).first()["j"] == '{"k0":' + "[" * levels + "{}" + "]" * levels + "}"


WRONG = ['{"intValue":"x"}', '{"intValue":1.5}', '{"intValue":"9223372036854775808"}', '{"doubleValue":"1.0f"}', '{"doubleValue":{}}', '{"boolValue":"yes"}', '{"bytesValue":"###"}', '{"bytesValue":"A"}']
RIGHT = {'{"intValue":"-9223372036854775808"}': "-9223372036854775808", '{"intValue":"007"}': "7", '{"doubleValue":"-1e3"}': "-1000.0", '{"doubleValue":"NaN"}': "null", '{"boolValue":"true"}': "true", '{"bytesValue":"3q0"}': '"dead"', '{"bytesValue":"_-8="}': '"ffef"', '{"bytesValue":""}': '""', '{"stringValue":5}': '"5"', "{}": "null"}


def test_wrong_scalars_are_null_and_counted(spark, tmp_path):
    """One rule inside and outside of containers, and for bodies."""
    inside = ['{"arrayValue":{"values":[' + x + "]}}" for x in [*WRONG, *RIGHT]]
    bodies = ['{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":' + x + "}]}]}]}" for x in WRONG]
    parsed, records, violations = read(spark, tmp_path, [with_value(x) for x in [*WRONG, *RIGHT, *inside]] + bodies)
    assert parsed.where("reason IS NOT NULL").count() == violations.count() == 0
    losses = {r["reason"]: r["n"] for r in validation.mapping_losses(records).collect()}
    assert losses == {"invalid_scalar": 3 * len(WRONG)}
    got = sorted(r["j"] for r in records.select(canonical.attributes_json(F.col("attributes")).alias("j")).collect())
    values = ["null"] * len(WRONG) + list(RIGHT.values())
    assert got == sorted([f'{{"k0":{x}}}' for x in values] + [f'{{"k0":[{x}]}}' for x in values] + ["{}"] * len(WRONG))
    assert all(json.loads(j) is not None for j in got)
    assert records.where("body <> '' AND body <> 'b'").count() == 0


def test_wrong_times_and_ids_are_counted(spark, tmp_path):
    lines = [json.dumps(request(timeUnixNano=t, traceId=i)) for t, i in (("5", "ab" * 16), ("x", "zz"), ("-1", "abc"), ("18446744073709551616", ""), ("18446744073709551615", "ab" * 16))]
    _, records, _ = read(spark, tmp_path, lines)
    losses = {r["reason"]: r["n"] for r in validation.mapping_losses(records).collect()}
    assert losses == {"invalid_scalar": 3, "invalid_trace_id": 2, "timestamp_overflow": 1}


def test_walk_of_odd_shapes():
    for odd in (5, "x", [1], {"arrayValue": 5}, {"arrayValue": {"values": 5}}, {"kvlistValue": "x"}):
        assert canonical.walk_value(odd)[0] == "null" and canonical.walk_value(odd)[6] == 1
    assert canonical.walk_value({"arrayValue": {"values": [5, None, {}, {"arrayValue": {}}]}})[::6] == ("[null,null,null,[]]", 1)
    assert canonical.walk_value({"kvlistValue": {"values": [5, {"value": {"intValue": "1"}}, {"key": "a"}]}})[::6] == ('{"":1,"a":null}', 1)
    value = {"intValue": "1"}
    for _ in range(50_000):
        value = {"arrayValue": {"values": [value]}}
    assert canonical.walk_value(value)[:2] == ("[" * 50_000 + "1" + "]" * 50_000, 50_000)
    assert canonical._walk_text(deep(400))[1] > 32 and canonical._walk_text('{"intValue":' + "1" * 5000 + "}")[6] == 1


def test_rejected_requests_in_a_stream(spark, tmp_path):
    """All lines of all files are in the counts of their batch; the rejected ones are stored with their reasons."""
    from kelpline.streaming import sinks

    (tmp_path / "in").mkdir()
    good = json.dumps(request({"intValue": "1"}, {"boolValue": "no"}, n=2))
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join([good, "no json", with_value(deep(40)), good, "{}"][: 5 - k]) + "\n")
    lines = otlp_json.stream_lines(spark, f"file://{tmp_path}/in", 1)
    sinks.start_requests(lines, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    counts = sorted((r["lines"], r["accepted"], r["rejected"], r["empty"], r["records"]) for r in out("request_counts").collect())
    assert counts == [(3, 1, 2, 0, 2), (4, 2, 2, 0, 4), (5, 2, 2, 1, 4)]
    assert sorted((r["reasons"], r["preview"][:7]) for r in out("rejected_requests").collect()) == sorted([(["malformed"], "no json"), (["nesting_depth"], '{"resou')] * 3)
    assert out("log_event").count() == 10 and out("log_resource").count() == 1 and out("tickets").count() == 5
    assert [r["reason"] for r in out("losses").collect()] == ["invalid_scalar"] * 3


def test_requests_go_to_python_in_small_batches(spark):
    """A line may be a large request: batches are bounded by rows and bytes."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    kept = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "10000")
    spark.conf.unset(names[1])
    otlp_json.parse_requests(spark.createDataFrame([("a", "{}")], "request_id string, value string"))
    assert 0 < int(spark.conf.get(names[0])) <= 1024 and 0 < int(spark.conf.get(names[1])) <= 1 << 24
    for n, v in zip(names, kept, strict=True):
        spark.conf.set(n, v)


def test_some_reasons_cost_no_walk(spark, sf):
    """A count of attributes needs no walk over nested values, and gives the same rows as all tests together."""
    from kelpline.plans import ingest

    records = ingest.wire_records(spark, sf)
    some = validation.request_violations(records, ingest.WIRE_LIMITS, ["attribute_count"])
    every = validation.request_violations(records, ingest.WIRE_LIMITS).where("reason = 'attribute_count'")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "walk" not in plan and "walk" in every._jdf.queryExecution().optimizedPlan().toString()
