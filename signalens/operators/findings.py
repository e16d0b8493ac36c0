"""Findings: one schema, one order, counts and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalens.functions import rules as R
from signalens.operators import tables

CODES = {
    "promql": "E001_PROMQL_PARSE_ERROR", "logql": "E002_LOGQL_PARSE_ERROR", "yaml": "E003_RULEFILE_YAML_INVALID", "json": "E004_DASHBOARD_JSON_INVALID", "metric": "E101_METRIC_UNKNOWN", "label": "E102_LABEL_UNKNOWN", "value": "E103_LABEL_VALUE_UNKNOWN",
    "stream_label": "E201_STREAM_LABEL_UNKNOWN", "stream_value": "E202_STREAM_VALUE_UNKNOWN", "severity": "E301_MISSING_SEVERITY", "annotation": "E302_MISSING_ANNOTATION", "duplicate": "E303_DUPLICATE_ALERT", "for": "W401_FOR_LT_INTERVAL", "empty": "W402_EMPTY_EXPR",
}
SCHEMA = "code string, severity string, category string, source struct<file:string,line:int,group:string,rule:string,panel:string>, message string, suggestions array<string>, context struct<metric:string,label:string,value:string,expr:string>, seq long"
SEVERITIES = ("error", "warning", "info")


def make(df: DataFrame, code: str | Column, category: str, message: Column, *, severity: Column | None = None, file: str | None = "path", group: str | None = None, rule: str | None = None, panel: str | None = None, suggestions: str | None = None, metric=None, label=None, value=None, expr=None, seq: str | None = None) -> DataFrame:
    """Findings of one code from the rows of df; arguments that name columns may be left out."""
    s = lambda c: F.coalesce(F.col(c), F.lit("")) if isinstance(c, str) else F.lit("") if c is None else c
    return df.select(
        (code if isinstance(code, Column) else F.lit(code)).alias("code"),
        (severity if severity is not None else R.severity_of(code if isinstance(code, Column) else F.lit(code))).alias("severity"),
        F.lit(category).alias("category"),
        F.struct(s(file).alias("file"), F.lit(0).alias("line"), s(group).alias("group"), s(rule).alias("rule"), s(panel).alias("panel")).alias("source"),
        message.alias("message"),
        (F.col(suggestions) if suggestions else F.lit(None).cast("array<string>")).alias("suggestions"),
        F.struct(s(metric).alias("metric"), s(label).alias("label"), s(value).alias("value"), s(expr).alias("expr")).alias("context"),
        (F.col(seq).cast("long") if seq else F.lit(0).cast("long")).alias("seq"),
    )


def none(spark: SparkSession) -> DataFrame:
    return tables.local(spark, [], SCHEMA)


def union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = none(spark)
    for p in parts:
        out = out.unionByName(p)
    return out


SORT_KEYS = ("source.file", "source.line", "source.group", "source.rule", "code", "message")


def ordered(f: DataFrame) -> DataFrame:
    """By file, line, group, rule, code and message, then in the order of production; the panel is no key."""
    return f.orderBy(*SORT_KEYS, "seq")


def positions(f: DataFrame) -> DataFrame:
    """Findings with their position in a report, from 1 on."""
    return tables.numbered(f, *SORT_KEYS, "seq")


def counts(f: DataFrame) -> DataFrame:
    """Findings by code, severity and category."""
    return f.groupBy("code", "severity", "category").agg(F.count("*").alias("n"))


def by_severity(f: DataFrame) -> DataFrame:
    """Findings of each of the three severities, zero where there are none."""
    all_of = f.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return all_of.join(f.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def verdict(f: DataFrame) -> DataFrame:
    """One row (outcome, exit_code): clean and 0 (information counts as clean), warnings and 1, or errors and 2."""
    worst = f.agg(F.coalesce(F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)), F.lit(0)).alias("exit_code"))
    return worst.select(F.element_at(F.array(F.lit("clean"), F.lit("warnings"), F.lit("errors")), F.col("exit_code") + 1).alias("outcome"), "exit_code")


def files_by_kind(paths: DataFrame) -> DataFrame:
    """Input files of each kind, zero where there are none; unreadable files count."""
    kinds = paths.sparkSession.createDataFrame([(k,) for k in ("promql", "logql", "dashboard")], "kind string")
    return kinds.join(paths.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
