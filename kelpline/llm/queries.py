"""The thin queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, ranked_search, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    found = contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_languages

    return predict_languages(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import length_histogram, token_lengths

    return length_histogram(token_lengths(_table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.crawl_report(_table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_and_check

    return encode_and_check(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_mixing import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_report(spark, _table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import run_report

    return run_report(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op6_decontaminate": op6_decontaminate, "op10_quality": op10_quality, "op4_toxicity": op4_toxicity, "op8_language_id": op8_language_id, "op2_token_counts": op2_token_counts, "op7_warc": op7_warc, "op9_url_filter": op9_url_filter, "op3_sentencepiece": op3_sentencepiece, "op5_lm_score": op5_lm_score, "op11_chat_format": op11_chat_format, "op12_periodic_runs": op12_periodic_runs, "op13_ranked_search": op13_ranked_search}
ORACLES: dict[str, str] = {"op6_decontaminate": decontaminate.ORACLE, "op7_warc": warc.ORACLE, "op9_url_filter": url_filter.ORACLE, "op11_chat_format": chat_format.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
