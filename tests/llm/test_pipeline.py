"""The pipeline's stages: columns, decisions, and that clean documents stay."""

import corpus_pipeline as pipeline
from kelpline.llm.decontaminate import contamination_report
from kelpline.llm.minhash_dedup import near_duplicates
from kelpline.llm.store import Scratch


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before, scratch = docs.columns, docs.count(), Scratch(spark, "test")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = scratch.table(stage(spark, docs, sf), name)
        assert out.columns == names or k == len(pipeline.STAGES) - 1
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        n = out.count()
        assert 0.6 * before < n <= before
        if name == "near_dedup":
            assert near_duplicates(out, width=5, percent=80).where("NOT kept").count() == 0
        if name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert n == before and contamination_report(out, items).where("contaminated").count() == 0
        docs, before = out, n
    assert docs.where("NOT round_trip").count() == 0


def test_odd_rows(spark, sf):
    rows = [(1, None, None, "s", None), (1, "", "en", None, 0), (None, "no id " * 20, "en", "s", 1), (2, " ".join(f"w{i}" for i in range(50)), "en", "s", 9), (3, " ".join(f"w{i}" for i in range(50)), None, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            assert stage(spark, df, sf).count() <= df.count(), name


def test_encoding_keeps_every_row(spark, sf):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "two words"), (4, "two words"), (None, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pipeline.encode_documents(spark, docs, sf)
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, docs.collect()))
    assert {(r["text"], r["ids"] is None, r["n_tokens"]) for r in out.collect() if r["doc_id"] in (1, 2)} == {(None, True, None), ("", False, 0)}
    assert out.where("NOT round_trip").count() == 0
