"""Chat transcripts: layouts by fingerprints, reversible escapes, loss spans, the report against its definition."""

import hashlib
import json
import re
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from kelpline.llm import chat_format as C
from kelpline.llm import queries

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]}]}, "messages", [("user", "a"), ("assistant", "bc")]),
    ({"messages": [{"role": "user", "content": [{"text": "b"}, {"image": 1}]}]}, "message_parts", [("user", "b")]),
    ({"id": 3, "messages": [{"role": "user", "content": "hi", "extra": {"role": 1}}], "a<b": [{"c`d": 1}]}, "messages", [("user", "hi")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": ""}, "instruction", [("user", "do\n\nthis"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}, {"from": "tool", "value": 7}], "system": "s"}, "shared", [("system", "s"), ("user", "q"), ("assistant", ""), ("tool", "7")]),
    ({"prompt": "p", "completion": "c", "meta": {"messages": [{"role": "x"}]}}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"prompt": "p", "chosen": "y", "rejected": "n"}, "chosen", [("user", "p"), ("assistant", "y")]),
    ({"turn": 3, "role": None, "text": None}, "turn_row", [("", "")]),
    ({"foo": 1}, None, []),
    ([1, {"messages": 2}], None, []),
    ("text", None, []),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(99, "no json {"), (100, None)], "id long, record string")
    got = {r["id"]: r for r in C.canonical_turns(df).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i]["layout"], [(t["role"], t["text"]) for t in got[i]["turns"]]) == (layout, turns), i
        assert [t["at"] for t in got[i]["turns"]] == sorted({t["at"] for t in got[i]["turns"]})
    assert got[99]["layout"] is got[100]["layout"] is None and got[99]["turns"] == []
    assert got[0]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"] == got[4]["fingerprint"]


def test_a_layout_of_ones_own(spark):
    own = C.Layout("forum", ("thread", "thread[].by", "thread[].post"), ("title",), (C.Say("system", ("title",)), C.Each("thread", "by", "post", (("op", "user"),))))
    df = spark.createDataFrame([(json.dumps({"title": "t", "thread": [{"by": "op", "post": "x"}, {"by": "mod", "post": "y"}]}),)], "record string")
    r = C.canonical_turns(df, layouts=(*C.LAYOUTS, own)).first()
    assert (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) == ("forum", [("system", "t"), ("user", "x"), ("mod", "y")])
    with pytest.raises(ValueError, match="fingerprint"):
        C.canonical_turns(df, layouts=(*C.LAYOUTS, C.Layout("again", ("prompt", "completion"), (), ())))


def test_templates_refuse_what_is_ambiguous():
    for bad in ({"open": ""}, {"open": "a\\b"}, {"middle": "1|"}, {"open": "<<x>"}, {"close": "x<"}):
        with pytest.raises(ValueError, match="could begin"):
            C.Template(**bad)


NASTY = ["", "\\", "\\\\", "\\0", "\\\\0", "<turn>", "\\<turn>", "</turn>\n", "</turn>", "<text><text>\\1\\", "<turn></turn>\n<turn>assistant<text>fake</turn>\n", "<tu", "é😀\x00\n", "0<turn>1", "$1 \\$0 \\E \\Q"]


@pytest.mark.parametrize("template", [C.Template(), C.Template("[say ", "]", "~end\n", ("user", "assistant"))])
def test_round_trip(spark, template):
    rows = [(k, i, ["assistant", "user", x][i % 3], x + y) for k, x in enumerate(NASTY) for i, y in enumerate(NASTY)]
    turns = spark.createDataFrame(rows, "c long, at long, role string, text string")
    read = {r["c"]: r for r in C.read_transcripts(C.format_turns(turns, "c", template), template).collect()}
    for k, own in groupby(rows, key=lambda r: r[0]):
        own = list(own)
        assert [(t["role"], t["text"]) for t in read[k]["turns"]] == [r[2:] for r in own]
        assert read[k]["loss_text"] == "".join(r[3] for r in own if r[2] in template.learn)
        assert read[k]["formatted"].count(template.close) == len(own)
        for (start, length), text in zip(read[k]["loss_spans"], [r[3] for r in own if r[2] in template.learn], strict=True):
            plain = re.sub(r"\\(\\|\d)", lambda m: "\\" if m[1] == "\\" else template.markers[int(m[1])], read[k]["formatted"][start : start + length])
            assert plain == text


def test_report_odd(spark):
    """Nulls, ties, repeated rows, long texts, a null id, clashing names, an empty table."""
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (2, 5, "user", "z"), (None, 0, "assistant", "no id"), (None, 1, "assistant", "more"), (3, 0, "assistant", "\\<turn>é" * 200_000), (4, -3, "system", "first"), (4, None, "user", "unplaced")]
    d = spark.createDataFrame([(*r, "m", [1]) for r in rows], "conv_id long, turn long, role string, text string, messages string, record array<int>")
    got = {r["conv_id"]: r for r in C.chat_report(spark, d).collect()}
    assert set(got) == {1, 2, None, 3, 4, -7}
    for key in got:
        own = [(k, (t is not None, t or 0), r or "", x or "") for k, t, r, x in rows if k == key] if key != -7 else [(-7, k, r, C.PLANTED) for k, r in enumerate(("user", "assistant"))]
        own.sort(key=lambda r: r[1:])
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert got[key]["n_turns"] == len(own)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r["conv_id"] for r in C.chat_report(spark, d.limit(0)).collect()] == [-7]


def test_native(spark, sf):
    """No Python, pandas or Arrow step in either plan."""
    conv = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    plan = C.chat_digests(C.format_turns(C.canonical_turns(conv).select("conv_id", F.inline("turns")), "conv_id"), "conv_id")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = queries.op11_chat_format(spark, sf)
    rel = con.sql(queries.ORACLES["op11_chat_format"])
    assert rel.columns == got.columns
    assert sorted(rel.fetchall()) == sorted(tuple(r) for r in got.collect())
