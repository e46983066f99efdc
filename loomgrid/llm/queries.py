"""The registered queries of this package: one ``opN_<name>`` for each operator, and the pipeline."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_text, jaccard, lm_score, quality, secrets, suffix_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.render(_table(spark, sf_dir, "pages"))


_ALL = (
    op1_suffix_dedup,
    op2_ngram_jaccard_join,
    op3_lm_scoring,
    op4_secret_scan,
    op5_bpe_codec,
    op6_benchmark_decontamination,
    op7_url_filter,
    op8_quality_rules,
    op9_toxicity,
    op10_html_extraction,
)


def queries() -> dict:
    """The operators' queries, and the pipeline where its module stands beside the package."""
    found = {f.__name__: f for f in _ALL}
    if importlib.util.find_spec("corpus_pipeline") is not None:
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    return {"op3_lm_scoring": lm_score.ORACLE}
