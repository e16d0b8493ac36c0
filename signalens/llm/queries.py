"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalens.llm import decontamination, jaccard_join, language_id, mixing, quality_classifier, quality_rules, secret_scan, sharding, url_filters, warc

#: Sources whose documents are to make up twice, one and a half times and half the share of others.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}
URL_RULES = [
    ("example.com", "allow"),
    ("example.net", "allow"),
    ("example.org", "review"),
    ("spam-farm.example.org", "block"),
    ("cheap-pills.example.com", "block"),
    ("casino.example.net", "block"),
    ("ththan.example.net", "review"),
    ("blog.ththan.example.net/en/", "allow"),
    ("blog.ththan.example.net/en/8", "block"),
    ("ththre.example.com/fr", "review"),
    ("therou.example.com/en/4", "block"),
    ("m.therou.example.com", "allow"),
    ("com", "default"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), WEIGHTS)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs, _table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.classify(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.bundle(_table(spark, sf_dir, "pages"))


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


MIXING_SQL = f"""
WITH t AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{mixing.TOKEN}'))) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, CASE WHEN n > 0 THEN CASE source {' '.join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in WEIGHTS.items())} ELSE 1.0::DOUBLE END ELSE 0::DOUBLE END AS weight FROM t),
r AS (SELECT source, CASE WHEN n > 0 THEN weight * (SELECT sum(n) FROM t)::DOUBLE / ((SELECT sum(weight) FROM w) * n::DOUBLE) ELSE 0 END AS rate FROM w),
d AS (SELECT d.*, rate, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':17'), 1, 13) AS BIGINT)::DOUBLE / {1 << 52} AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": MIXING_SQL, "op3_quality_rules": quality_rules.rules_sql(), "op7_url_filters": url_filters.rules_sql(URL_RULES)}
