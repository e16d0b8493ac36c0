"""Registered queries: expressions and documents are written from the columns of the tables, parsed by the engine and
compared with what the same columns say. The SQL never parses anything, so the two sides are independent."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalens import cli
from signalens.functions import rules as R
from signalens.functions.extract import logql_extract, promql_extract, register, traceql_extract
from signalens.functions.wrappers import unwrap_variable_query
from signalens.operators import checks, lint, suggest
from signalens.operators import findings as fd
from signalens.plans import report
from signalens.operators.tables import local, new_path, written
from signalens.plans.validate import Inputs, Settings, extracted, parse_findings, validate
from signalens.sources import allowlist, yaml_docs
from signalens.sources import catalog as cat_source
from signalens.sources import dashboards as boards
from signalens.sources import documents as docs
from signalens.sources.allowlist import Allowlist
from signalens.sources.catalog import Tables
from signalens.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cat(*parts) -> Column:
    """Strings and columns joined; `name` in backquotes is a column."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if isinstance(p, str) and len(p) > 2 and p[0] == p[-1] == "`" else F.lit(p) if isinstance(p, str) else p for p in parts])


# extraction


def _promql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event a ratio of two rates of the same selector, summed."""
    sel = ("`event_type`", '_total{user="u', "`user_id`", '",type!="', "`event_type`", '"}')
    return _t(spark, sf_dir, "events").select("event_id", promql_extract(cat("sum by (user) (rate(", *sel, "[5m])) / sum by (user) (increase(", *sel, "[1h]))")).alias("r"))


@query("SELECT event_id, event_type || '_total' AS metric FROM events")
def promql_metric_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promql(spark, sf_dir).select("event_id", F.explode("r.metricRefs").alias("metric"))


@query("""SELECT event_id, event_type || '_total' AS metric, s.label, s.op, s.value FROM events, (VALUES (1), (2)) t(n),
LATERAL (SELECT 'user' AS label, '=' AS op, 'u' || user_id AS value UNION ALL SELECT 'type', '!=', event_type) s""")
def promql_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promql(spark, sf_dir).select("event_id", F.explode("r.selectors").alias("s")).select("event_id", "s.*")


@query("SELECT event_id, f AS function FROM events, (VALUES ('rate'), ('increase')) t(f)")
def promql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promql(spark, sf_dir).select("event_id", F.explode("r.functions").alias("function"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) + 0.5 AS at FROM orders")
def promql_at_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = promql_extract(cat("max_over_time(orders_total[1h] @ ", "`o_orderkey`", ".5)"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.explode(r.getField("atModifiers")).alias("at"))


@query("SELECT c_custkey, c_acctbal < 0 AS failed, CASE WHEN c_acctbal >= 0 THEN c_mktsegment || '_total' END AS metric FROM customer")
def promql_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt get an expression without its last bracket."""
    c = _t(spark, sf_dir, "customer")
    r = promql_extract(cat("sum(rate(", "`c_mktsegment`", "_total[5m])", F.when(F.col("c_acctbal") < 0, "").otherwise(")")))
    return c.select("c_custkey", r.alias("r")).select("c_custkey", F.startswith(F.coalesce("r.error", F.lit("")), F.lit("parse: ")).alias("failed"), F.try_element_at("r.metricRefs", F.lit(1)).alias("metric"))


def _logql(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat('sum by (user) (rate({app="', "`event_type`", '", user=~"u', "`user_id`", '"} |= "', "`event_type`", '" |= "', "`event_type`", '" != "none" | json | k >= ', "`user_id`", ' | kind="', "`event_type`", '" [5m]))')
    return _t(spark, sf_dir, "events").select("event_id", logql_extract(e).alias("r"))


@query("SELECT event_id, s.label, s.op, s.value FROM events, LATERAL (SELECT 'app' AS label, '=' AS op, event_type AS value UNION ALL SELECT 'user', '=~', 'u' || user_id) s")
def logql_stream_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logql(spark, sf_dir).select("event_id", F.explode("r.streamSelectors").alias("s")).select("event_id", "s.*")


@query("""SELECT event_id, op, "match" FROM events, LATERAL (SELECT '|=' AS op, event_type AS "match" UNION ALL SELECT '|=', event_type UNION ALL SELECT '!=', 'none') s""")
def logql_line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logql(spark, sf_dir).select("event_id", F.explode("r.lineFilters").alias("s")).select("event_id", "s.*")


@query("""SELECT event_id, f AS filter FROM events, LATERAL (SELECT 'k>=' || user_id AS f UNION ALL SELECT 'kind="' || event_type || '"') s""")
def logql_label_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logql(spark, sf_dir).select("event_id", F.explode("r.labelFilters").alias("filter"))


@query("SELECT event_id, 'json' AS parser FROM events")
def logql_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logql(spark, sf_dir).select("event_id", F.explode("r.parsers").alias("parser"))


@query("SELECT event_id, f AS function FROM events, (VALUES ('rate'), ('sum')) t(f)")
def logql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logql(spark, sf_dir).select("event_id", F.explode("r.functions").alias("function"))


def _traceql(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat("{ span.", "`event_type`", " = ", "`user_id`", ' && resource.service.name = "', "`event_type`", '" && parent.u', "`user_id`", " != nil && duration > 1ms && status = error } | rate() by (span.", "`event_type`", ")")
    return _t(spark, sf_dir, "events").select("event_id", traceql_extract(e).alias("r"))


@query("SELECT event_id, scope, parent, name FROM events, LATERAL (SELECT 'span' AS scope, false AS parent, event_type AS name UNION ALL SELECT 'resource', false, 'service.name' UNION ALL SELECT '', true, 'u' || user_id) s")
def traceql_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traceql(spark, sf_dir).select("event_id", F.explode("r.attributes").alias("s")).select("event_id", "s.*")


@query("SELECT event_id, i AS intrinsic FROM events, (VALUES ('duration'), ('status')) t(i)")
def traceql_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traceql(spark, sf_dir).select("event_id", F.explode("r.intrinsics").alias("intrinsic"))


@query("SELECT event_id, 'rate' AS function FROM events")
def traceql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traceql(spark, sf_dir).select("event_id", F.explode("r.functions").alias("function"))


@query("""SELECT event_id, s.m AS metric, s.label, s.op, s.value FROM events, LATERAL (
SELECT event_type || '_.*' AS m, NULL AS label, NULL AS op, NULL AS value UNION ALL SELECT event_type, NULL, NULL, NULL
UNION ALL SELECT event_type || '_.*', 'user', '!=', 'u' || user_id UNION ALL SELECT event_type, 'kind', '=~', 'k.*' UNION ALL SELECT event_type, 'zone', '!~', 'z' || user_id || '|y') s""")
def promql_name_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name given by a matcher of any operator is a metric and no selector; all four operators; aggregations are no functions."""
    e = cat('topk(3, {__name__=~"', "`event_type`", '_.*",user!="u', "`user_id`", '"}) or ', "`event_type`", '{kind=~"k.*",zone!~"z', "`user_id`", '|y"}')
    r = _t(spark, sf_dir, "events").select("event_id", promql_extract(e).alias("r")).where("r.error is null and size(r.functions) = 0")
    none = [F.lit(None).cast("string").alias(c) for c in ("label", "op", "value")]
    metrics = F.transform("r.metricRefs", lambda m: F.struct(m.alias("metric"), *none))
    return r.select("event_id", F.explode(F.concat(metrics, "r.selectors")).alias("s")).select("event_id", "s.*")


@query("SELECT o_orderkey, o_orderkey::DOUBLE + s.x AS at FROM orders, (VALUES (0.0::DOUBLE), (0.25::DOUBLE)) s(x)")
def promql_at_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed times of subqueries and of selectors within; start() and end() carry none."""
    r = promql_extract(cat("max_over_time(rate(a[1m] @ ", "`o_orderkey`", ".25)[1h:5m] @ ", "`o_orderkey`", ") + b @ start() - c @ end()"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.explode(r.getField("atModifiers")).alias("at"))


@query("""SELECT event_id, op, "match" FROM events, LATERAL (SELECT '|=' AS op, 'a' || user_id AS "match" UNION ALL SELECT '!=', 'b' UNION ALL SELECT '|~', 'c' || user_id || '.*'
UNION ALL SELECT '!~', event_type UNION ALL SELECT '|>', '<_>d' || user_id || '<_>' UNION ALL SELECT '!>', '<_>e<_>' UNION ALL SELECT '|=', '10.0.0.0/8') s""")
def logql_filter_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line filters; an empty one is dropped, and of a filter function only the operand stays."""
    e = cat('{app="x"} |= "a', "`user_id`", '" != "b" |~ "c', "`user_id`", '.*" !~ "', "`event_type`", '" |> "<_>d', "`user_id`", '<_>" !> "<_>e<_>" |= "" |= ip("10.0.0.0/8")')
    return _t(spark, sf_dir, "events").select("event_id", F.explode(logql_extract(e).getField("lineFilters")).alias("s")).select("event_id", "s.*")


@query("SELECT event_id, s.label, s.op, s.value FROM events, LATERAL (SELECT 'app' AS label, '!=' AS op, event_type AS value UNION ALL SELECT 'b', '!~', 'u' || user_id UNION ALL SELECT 'c', '=', 'c' UNION ALL SELECT 'd', '=~', 'd.+') s")
def logql_matcher_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat('{app!="', "`event_type`", '", b!~"u', "`user_id`", '", c="c", d=~"d.+"}')
    return _t(spark, sf_dir, "events").select("event_id", F.explode(logql_extract(e).getField("streamSelectors")).alias("s")).select("event_id", "s.*")


@query("SELECT event_id, f AS function FROM events, (VALUES ('count_over_time'), ('label_replace'), ('sum')) t(f)")
def logql_label_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat('label_replace(sum by (app) (count_over_time({app="', "`event_type`", '"}[5m])), "dst", "$1", "app", "(.*)")')
    return _t(spark, sf_dir, "events").select("event_id", F.explode(logql_extract(e).getField("functions")).alias("function"))


@query("""SELECT event_id, 'json' AS parsers, 'k>' || user_id AS filters, 'max,sum_over_time' AS functions, CAST(NULL AS VARCHAR) AS error FROM events""")
def logql_not_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, drops, unwraps, offsets, groupings and binary operators must parse, and leave no trace."""
    e = cat('max without (pod) (sum_over_time({app="', "`event_type`", '"} | json | k > ', "`user_id`", ' | line_format "{{.x}}" | label_format a=b, c="{{.d}}" | drop e | keep v, k | unwrap v [5m] offset 1h)) / 2 > bool 1')
    r = _t(spark, sf_dir, "events").select("event_id", logql_extract(e).alias("r"))
    return r.select("event_id", *[F.array_join(f"r.{c}", ",").alias(n) for c, n in (("parsers", "parsers"), ("labelFilters", "filters"), ("functions", "functions"))], F.col("r.error").alias("error"))


@query("SELECT event_id, 'rate' AS functions FROM events")
def traceql_second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topk of a second stage is none of the functions."""
    r = traceql_extract(cat("{ span.", "`event_type`", " = ", "`user_id`", " } | rate() by (resource.service.name) | topk(5)"))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(r.getField("functions"), ",").alias("functions"))


@query("SELECT event_id, event_type AS metric, 'user' AS label, '=' AS op, 'u' || user_id AS value, 'rate' AS functions FROM events")
def promql_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered function and table function, called from SQL."""
    register(spark)
    _t(spark, sf_dir, "events").createOrReplaceTempView("signalens_events")
    return spark.sql("""SELECT event_id, s.metric, s.label, s.op, s.value, array_join(promql_extract(e).functions, ',') AS functions
      FROM (SELECT event_id, concat('rate(', event_type, '{user="u', user_id, '"}[5m])') AS e FROM signalens_events), LATERAL promql_selectors(e) s""")


@query("SELECT o_orderkey, 'orders_total' AS metric FROM orders")
def expression_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions from text files, a line each, with empty lines between."""
    folder = new_path(spark, "expressions")
    _t(spark, sf_dir, "orders").select(F.explode(F.array(cat('orders_total{key="', "`o_orderkey`", '"}'), F.lit(""))).alias("value")).write.text(folder)
    r = docs.expressions(spark, folder).select(promql_extract("expr").alias("r"))
    return r.select(F.element_at("r.selectors", 1)["value"].cast("long").alias("o_orderkey"), F.element_at("r.metricRefs", 1).alias("metric"))


# rule files and lint

#: The table part as rules: a file a brand and size, a group a type; positions count from 0.
RULES_SQL = """rules AS (SELECT p_partkey, p_brand || '-' || p_size || '.yaml' AS path, p_brand, p_type AS grp, p_name AS alert, p_size, p_retailprice,
  dense_rank() OVER (PARTITION BY p_brand, p_size ORDER BY p_type) - 1 AS group_pos, row_number() OVER (PARTITION BY p_brand, p_size, p_type ORDER BY p_partkey) - 1 AS rule_pos,
  CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) * 100 + p_size AS file_pos FROM part)"""


def rule_files(spark: SparkSession, sf_dir: str, kind: str = "promql", recording: bool = False) -> DataFrame:
    """Files as sources.documents.contents gives them, but written from the table part. recording: rules of even parts record."""
    p = _t(spark, sf_dir, "part")
    expr = cat('rate(part_total{size="', "`p_size`", '"}[5m]) > 1') if kind == "promql" else cat('sum(rate({part="', "`p_size`", '"} |= "x" [5m])) > 1')
    rule = cat(
        "  - ", F.when(F.lit(recording) & (F.col("p_partkey") % 2 == 0), "record").otherwise("alert"), ': "', "`p_name`", "\"\n    expr: '", F.when(F.col("p_retailprice") < 950, "").otherwise(expr), "'\n    for: ", "`p_size`", "m\n    labels:\n      part: ", "`p_partkey`", "\n",
        F.when(F.col("p_size") > 10, "      severity: page\n").otherwise(""), "    annotations:\n      summary: 'x'\n", F.when(F.col("p_retailprice") > 980, "      description: ' '\n").otherwise("      description: d\n"),
    )
    groups = p.groupBy("p_brand", "p_size", "p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", rule.alias("y")))), lambda s: s["y"]), "").alias("y"))
    groups = groups.select("p_brand", "p_size", "p_type", cat('- name: "', "`p_type`", '"\n  interval: 20m\n  rules:\n', "`y`").alias("y"))
    files = groups.groupBy("p_brand", "p_size").agg(F.concat(F.lit("groups:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", "y"))), lambda s: s["y"]), "")).alias("content"))
    pos = (F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") * 100 + F.col("p_size")).cast("int")
    return files.select(F.lit(kind).alias("kind"), pos.alias("file_pos"), cat("`p_brand`", "-", "`p_size`", ".yaml").alias("path"), "content", F.lit(None).cast("string").alias("read_error"))


def _flat(f: DataFrame) -> DataFrame:
    return f.select("code", "severity", "category", "source.file", "source.group", "source.rule", "message")


def _rules(spark: SparkSession, sf_dir: str, kind: str = "promql", recording: bool = False) -> DataFrame:
    return docs.rule_table(rule_files(spark, sf_dir, kind, recording))


@query(f"""WITH {RULES_SQL} SELECT path, CAST(group_pos AS INTEGER) AS group_pos, CAST(rule_pos AS INTEGER) AS rule_pos, grp AS "group", '20m' AS "interval", alert AS rule, CAST(p_partkey AS VARCHAR) AS part, p_size || 'm' AS "for",
CASE WHEN p_retailprice >= 950 THEN 'part_total' END AS metric, CASE WHEN p_retailprice < 950 THEN 'empty expression' END AS error FROM rules""")
def rulefile_promql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("path", "group_pos", "rule_pos", "group", "interval", "rule", F.col("labels")["part"].alias("part"), "for", F.try_element_at("prom.metricRefs", F.lit(1)).alias("metric"), F.col("prom.error").alias("error"))


@query(f"""WITH {RULES_SQL} SELECT path, CAST(group_pos AS INTEGER) AS group_pos, CAST(rule_pos AS INTEGER) AS rule_pos, alert AS rule, CASE WHEN p_retailprice >= 950 THEN CAST(p_size AS VARCHAR) END AS value FROM rules""")
def rulefile_logql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir, "logql").select("path", "group_pos", "rule_pos", "rule", F.try_element_at("log.streamSelectors", F.lit(1)).getField("value").alias("value"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * 90000 AS ms, CASE WHEN p_size * 90 >= 3600 THEN (p_size * 90 // 3600) || 'h' ELSE '' END || CASE WHEN p_size * 90 % 3600 >= 60 THEN (p_size * 90 % 3600 // 60) || 'm' ELSE '' END || CASE WHEN p_size * 90 % 60 > 0 THEN (p_size * 90 % 60) || 's' ELSE '' END AS shown FROM part")
def duration_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = R.duration_ms(cat("`p_size`", "m", (F.col("p_size") * 30).cast("string"), "s"))
    return _t(spark, sf_dir, "part").select("p_partkey", ms.alias("ms")).withColumn("shown", R.duration_text(F.col("ms")))


def _lint_sql(code: str, severity: str, message: str, where: str, extra: str = "") -> str:
    return f"""WITH {RULES_SQL} SELECT '{code}' AS code, '{severity}' AS severity, 'lint' AS category, path AS file, grp AS "group", alert AS rule, {message} AS message FROM rules{extra} WHERE {where}"""


def _lint(spark: SparkSession, sf_dir: str, **only) -> DataFrame:
    base = {"require_severity": False, "require_annotations": (), "for_lt_interval": "off", "duplicate_alerts": False, "empty_expr": False}
    return _flat(fd.union(spark, lint.lint(_rules(spark, sf_dir), lint.Config(**(base | only)))))


@query(_lint_sql("W402_EMPTY_EXPR", "warning", "'rule expression is empty'", "p_retailprice < 950"))
def lint_empty_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lint(spark, sf_dir, empty_expr=True)


@query(_lint_sql("E301_MISSING_SEVERITY", "error", "'alert is missing required label `severity`'", "p_size <= 10"))
def lint_missing_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lint(spark, sf_dir, require_severity=True)


@query(_lint_sql("E302_MISSING_ANNOTATION", "error", "'alert is missing required annotation `' || k || '`'", "k = 'runbook' OR p_retailprice > 980", ", (VALUES ('description'), ('runbook')) t(k)"))
def lint_missing_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lint(spark, sf_dir, require_annotations=("summary", "description", "runbook"))


@query(_lint_sql("W401_FOR_LT_INTERVAL", "error", "'alert `for` (' || p_size || 'm) is less than group `interval` (20m)'", "p_size < 20"))
def lint_for_lt_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lint(spark, sf_dir, for_lt_interval="error")


@query(f"""WITH {RULES_SQL} SELECT 'W402_EMPTY_EXPR' AS code, path AS file, grp AS "group", alert AS rule FROM rules WHERE p_retailprice < 950
UNION ALL SELECT c, path, grp, alert FROM rules, (VALUES ('E301_MISSING_SEVERITY'), ('E302_MISSING_ANNOTATION'), ('W401_FOR_LT_INTERVAL')) t(c)
WHERE p_partkey % 2 = 1 AND CASE c[:4] WHEN 'E301' THEN p_size <= 10 WHEN 'E302' THEN p_retailprice > 980 ELSE p_size < 20 END""")
def lint_recording_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that record need neither severity nor annotations nor a wait, but an expression."""
    found = fd.union(spark, lint.lint(_rules(spark, sf_dir, recording=True), lint.Config(duplicate_alerts=False)))
    return _flat(found).select("code", "file", "group", "rule")


@query(f"""WITH {RULES_SQL} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN alert ELSE '' END AS record, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE alert END AS alert, alert AS rule FROM rules""")
def rulefile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule is called by its alert, else by what it records."""
    r = docs.decoded_rules(rule_files(spark, sf_dir, recording=True)).withColumn("rule", F.coalesce(F.nullif("alert", F.lit("")), "record"))
    return r.select(F.col("labels")["part"].cast("long").alias("p_partkey"), "record", "alert", "rule")


DUPLICATE_SQL = "SELECT *, row_number() OVER w AS nth, first_value(path) OVER w AS fp, first_value(grp) OVER w AS fg FROM rules WINDOW w AS (PARTITION BY alert ORDER BY file_pos, group_pos, rule_pos)"


@query(f"""WITH {RULES_SQL}, d AS ({DUPLICATE_SQL}) SELECT 'E303_DUPLICATE_ALERT' AS code, 'error' AS severity, 'lint' AS category, path AS file, grp AS "group", alert AS rule, 'alert name `' || alert || '` is also defined at ' || fp || ':' || fg AS message FROM d WHERE nth > 1""")
def lint_duplicate_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lint(spark, sf_dir, duplicate_alerts=True)


# dashboards

#: Customers as panels: a dashboard a nation; all panels are in one row whose source is Prometheus.
PANELS_SQL = """panels AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal, 'nation' || c_nationkey || '.json' AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS panel_pos,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'prometheus' WHEN 'AUTOMOBILE' THEN 'loki' WHEN 'MACHINERY' THEN 'grafana-tempo' WHEN 'HOUSEHOLD' THEN 'grafana-mimir' ELSE 'mixed' END AS datasource FROM customer)"""


def dashboard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboards as sources.documents.contents gives them, but written from the table customer."""
    c, seg = _t(spark, sf_dir, "customer"), F.col("c_mktsegment")
    none = F.lit(None).cast("string")
    log = cat('{app="$app", cust="', "`c_custkey`", '"} |= "${word:raw}"')
    expr = F.when(seg.isin("AUTOMOBILE", "MACHINERY"), log).otherwise(cat('rate(cust_total{cust="', "`c_custkey`", '",job="[[job]]"}[$__rate_interval])'))
    target = F.struct(F.lit("A").alias("refId"), F.when(seg == "HOUSEHOLD", "Grafana-Mimir").alias("datasource"), F.when(F.col("c_acctbal") < 0, none).otherwise(expr).alias("expr"), F.when(F.col("c_acctbal") < 0, expr).alias("query"))
    own = F.when(seg == "AUTOMOBILE", F.struct(F.lit("Loki").alias("type"))).when(seg == "MACHINERY", F.struct(F.lit("grafana-tempo").alias("type"))).when(seg == "FURNITURE", F.struct(F.lit("mixed").alias("type")))
    panel = F.struct("c_custkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("graph").alias("type"), own.alias("datasource"), F.array(target).alias("targets")).alias("p"))
    per = c.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(panel)), lambda s: s["p"]).alias("panels"))
    row = F.struct(F.lit("row").alias("type"), F.struct(F.lit("prometheus").alias("type")).alias("datasource"), F.col("panels"))
    variables = F.array(
        F.struct(F.lit("job").alias("name"), F.lit("query").alias("type"), F.lit("prometheus").alias("datasource"), cat('label_values(up{nation="', "`c_nationkey`", '"}, job)').alias("query")),
        F.struct(F.lit("step").alias("name"), F.lit("interval").alias("type"), F.lit("prometheus").alias("datasource"), F.lit("1m,5m").alias("query")),
        F.struct(F.lit("names").alias("name"), F.lit("query").alias("type"), F.lit("prometheus").alias("datasource"), F.lit("label_names()").alias("query")),
    )
    doc = F.struct(cat("nation ", "`c_nationkey`").alias("title"), cat("n", "`c_nationkey`").alias("uid"), F.array(row).alias("panels"), F.struct(variables.alias("list")).alias("templating"))
    return per.select(F.lit("dashboard").alias("kind"), F.col("c_nationkey").cast("int").alias("file_pos"), cat("nation", "`c_nationkey`", ".json").alias("path"), F.to_json(doc).alias("content"), none.alias("read_error"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.dashboard_table(dashboard_files(spark, sf_dir))


@query(f"WITH {PANELS_SQL} SELECT path, 'n' || c_nationkey AS uid, CAST(panel_pos AS INTEGER) AS panel_pos, c_custkey AS panel_id, c_name AS panel_title FROM panels")
def dashboard_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).where("item = 'panel'").select("path", "uid", "panel_pos", "panel_id", "panel_title")


_LANG_SQL = "CASE WHEN datasource LIKE '%loki%' OR (datasource IN ('mixed', 'grafana-tempo') AND c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')) THEN 'logql' ELSE 'promql' END"


@query(f"WITH {PANELS_SQL}, s AS (SELECT *, CASE WHEN c_mktsegment NOT IN ('BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD','FURNITURE') THEN 'prometheus' ELSE datasource END AS ds FROM panels) SELECT path, c_custkey AS panel_id, ds AS datasource, {_LANG_SQL.replace('datasource', 'ds')} AS lang FROM s")
def dashboard_datasource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inherited data sources and the language that follows from them."""
    return _items(spark, sf_dir).where("item = 'target'").select("path", "panel_id", "datasource", "lang")


@query(f"""WITH {PANELS_SQL} SELECT c_custkey AS panel_id, c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AS is_log,
CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN '{{app="__dashboard_var__", cust="' || c_custkey || '"}} |= "__dashboard_var__"' ELSE 'rate(cust_total{{cust="' || c_custkey || '",job="__dashboard_var__"}}[5m])' END AS norm,
CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'app,word' ELSE 'job' END AS variables FROM panels""")
def dashboard_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).where("item = 'target'").select("panel_id", (R.guessed_language(F.col("raw")) == "logql").alias("is_log"), "norm", F.array_join("variables", ",").alias("variables"))


@query("""SELECT 'nation' || k || '.json' AS path, name, query, metric FROM (SELECT DISTINCT c_nationkey AS k FROM customer),
LATERAL (SELECT 'job' AS name, 'label_values(up{nation="' || k || '"}, job)' AS query, 'up' AS metric UNION ALL SELECT 'names', 'label_names()', NULL) v""")
def dashboard_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).where("item = 'variable'").select("path", "name", F.col("raw").alias("query"), F.try_element_at("prom.metricRefs", F.lit(1)).alias("metric"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'sum(x{a=~"' || o_orderkey || ',b"})' WHEN 'O' THEN 'o' || o_orderkey ELSE NULL END AS inner_query FROM orders""")
def dashboard_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_result(...) with a comma within quotes, a bare query, and label_values(label), which holds nothing to check."""
    s = F.col("o_orderstatus")
    q = F.when(s == "F", cat('query_result( sum(x{a=~"', "`o_orderkey`", ',b"}) )')).when(s == "O", cat("o", "`o_orderkey`")).otherwise(cat("label_values(o", "`o_orderkey`", ")"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", unwrap_variable_query(q).alias("inner_query"))


# catalog checks


def _catalog(spark: SparkSession, sf_dir: str) -> Tables:
    """What series there are: metrics of events of value, labels of those, users of purchases."""
    e = _t(spark, sf_dir, "events").select(cat("`event_type`", "_total").alias("metric"), cat("u", "`user_id`").alias("user"), "event_type")
    known = e.where("event_type in ('click', 'purchase', 'view')")
    labels = known.select("metric").distinct().withColumn("label", F.lit("user"))
    values = known.where("event_type = 'purchase' or length(user) < 4").select("metric", F.lit("user").alias("label"), F.col("user").alias("value")).distinct()
    streams = local(spark, [("app",), ("user",)], "label string")
    return Tables(known.select("metric").distinct(), labels, values, streams, known.select(F.lit("app").alias("label"), F.col("event_type").alias("value")).distinct())


def _checked(spark: SparkSession, sf_dir: str, lang: str, allow: Allowlist | None = None, part: int | None = None, **kw) -> DataFrame:
    """Findings for an expression an event: one with a label of the catalog, one without."""
    e = _t(spark, sf_dir, "events")
    if lang == "promql":
        expr = cat("rate(", "`event_type`", '_total{user="u', "`user_id`", '",kind="', "`event_type`", '"}[5m])')
        r, check = promql_extract(expr), checks.check_promql
    else:
        expr = cat('{app="', "`event_type`", '", host="u', "`user_id`", '"}')
        r, check = logql_extract(expr), checks.check_logql
    none = F.lit("")
    df = e.select(F.col("event_id").cast("string").alias("path"), none.alias("group"), none.alias("rule"), none.alias("panel"), expr.alias("expr"), r.alias("r"))
    parts = check(df, _catalog(spark, sf_dir), allow or Allowlist(), **kw)
    out = parts[part] if part is not None else fd.union(spark, parts)
    return out.select("code", "source.file", "message", F.array_join(F.coalesce("suggestions", F.array()), ",").alias("suggestions"))


_KNOWN = "event_type IN ('click', 'purchase', 'view')"
_NEAR = """near AS (SELECT t.q, string_agg(c.n, ',' ORDER BY c.rk) AS s FROM (SELECT DISTINCT event_type || '_total' AS q FROM events) t,
LATERAL (SELECT n, row_number() OVER (ORDER BY d, n) AS rk FROM (SELECT n, levenshtein(t.q, n) AS d FROM (SELECT DISTINCT event_type || '_total' AS n FROM events WHERE event_type IN ('click', 'purchase', 'view'))) WHERE d <= 3) c WHERE c.rk <= 3 GROUP BY t.q)"""
_VALUES = "vals AS (SELECT DISTINCT event_type || '_total' AS metric, 'u' || user_id AS value FROM events WHERE event_type = 'purchase' OR (event_type IN ('click', 'view') AND length('u' || user_id) < 4))"


@query(f"""WITH {_NEAR} SELECT 'E101_METRIC_UNKNOWN' AS code, CAST(event_id AS VARCHAR) AS file, 'metric "' || event_type || '_total" not present in catalog' AS message, coalesce(s, '') AS suggestions FROM events LEFT JOIN near ON q = event_type || '_total' WHERE NOT {_KNOWN}""")
def check_metric_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "promql", part=0)


@query(f"""SELECT 'E102_LABEL_UNKNOWN' AS code, CAST(event_id AS VARCHAR) AS file, 'label "kind" not present on metric "' || event_type || '_total"' AS message, '' AS suggestions FROM events WHERE {_KNOWN}""")
def check_label_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "promql", part=1)


@query(f"""WITH {_VALUES}, miss AS (SELECT e.event_id, e.event_type || '_total' AS metric, 'u' || e.user_id AS value FROM events e WHERE {_KNOWN} AND NOT EXISTS (SELECT 1 FROM vals v WHERE v.metric = e.event_type || '_total' AND v.value = 'u' || e.user_id)),
near AS (SELECT m.metric, m.value, string_agg(c.n, ',' ORDER BY c.rk) AS s FROM (SELECT DISTINCT metric, value FROM miss) m, LATERAL (SELECT n, row_number() OVER (ORDER BY d, n) AS rk FROM (SELECT v.value AS n, levenshtein(m.value, v.value) AS d FROM vals v WHERE v.metric = m.metric) WHERE d <= 3) c WHERE c.rk <= 3 GROUP BY m.metric, m.value)
SELECT 'E103_LABEL_VALUE_UNKNOWN' AS code, CAST(event_id AS VARCHAR) AS file, 'value "' || value || '" not observed for label "user" on metric "' || metric || '"' AS message, coalesce(s, '') AS suggestions FROM miss LEFT JOIN near USING (metric, value)""")
def check_value_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "promql", part=2)


@query("""SELECT 'E201_STREAM_LABEL_UNKNOWN' AS code, CAST(event_id AS VARCHAR) AS file, 'stream label "host" not present in Loki' AS message, 'app' AS suggestions FROM events WHERE false
UNION ALL SELECT 'E201_STREAM_LABEL_UNKNOWN', CAST(event_id AS VARCHAR), 'stream label "host" not present in Loki', '' FROM events""")
def check_stream_label_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "logql", part=0)


@query(f"""SELECT 'E202_STREAM_VALUE_UNKNOWN' AS code, CAST(event_id AS VARCHAR) AS file, 'value "' || event_type || '" not observed for stream label "app"' AS message, '' AS suggestions FROM events WHERE NOT {_KNOWN}""")
def check_stream_value_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "logql", part=1, distance=0)


@query(f"""WITH {_VALUES} SELECT code, file, message, '' AS suggestions FROM (
SELECT 'E101_METRIC_UNKNOWN' AS code, CAST(event_id AS VARCHAR) AS file, 'metric "' || event_type || '_total" not present in catalog' AS message FROM events WHERE NOT {_KNOWN} AND NOT starts_with(event_type, 'err')
UNION ALL SELECT 'E102_LABEL_UNKNOWN', CAST(event_id AS VARCHAR), 'label "kind" not present on metric "' || event_type || '_total"' FROM events WHERE {_KNOWN} AND event_type <> 'click'
UNION ALL SELECT 'E103_LABEL_VALUE_UNKNOWN', CAST(event_id AS VARCHAR), 'value "u' || user_id || '" not observed for label "user" on metric "' || event_type || '_total"' FROM events e
WHERE {_KNOWN} AND NOT starts_with('u' || user_id, 'u1') AND NOT EXISTS (SELECT 1 FROM vals v WHERE v.metric = e.event_type || '_total' AND v.value = 'u' || e.user_id))""")
def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow = Allowlist([("err*", "")], [("click_total", "ki*", "")], [("*", "user", "u1*", "")])
    return _checked(spark, sf_dir, "promql", allow).withColumn("suggestions", F.lit(""))


@query("""WITH q AS (SELECT DISTINCT p_name || 'é' AS query FROM part), c AS (SELECT DISTINCT p_name AS name FROM part)
SELECT query, name, CAST(d AS INTEGER) AS dist, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, name) AS rk FROM (SELECT query, name, levenshtein(query, name) AS d FROM q, c) WHERE d <= 3) WHERE rk <= 3""")
def suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return suggest.ranked(p.select(cat("`p_name`", "é").alias("query")), p.select(F.col("p_name").alias("name")).distinct())


@query("SELECT p_partkey, sha256('promql' || chr(10) || p_brand || chr(10) || p_name) AS key FROM part")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", R.cache_key(F.lit("promql"), F.col("p_brand"), F.col("p_name")).alias("key"))


@query("SELECT p_partkey, p_size - 5 <= 0 OR 20000 - p_partkey % 7 * 3000 <= (p_size - 5) * 1000 AS fresh FROM part")
def cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = (F.col("p_partkey") % 7 * 3000).cast("long")
    return _t(spark, sf_dir, "part").select("p_partkey", R.is_fresh(fetched, F.col("p_size") - 5, F.lit(20000)).alias("fresh"))


@query("""SELECT 'promql' AS lang, 'names' AS task, '' AS metric, '' AS label FROM events HAVING count(*) > 0
UNION ALL SELECT DISTINCT 'promql', 'labels', event_type || '_total', '' FROM events UNION ALL SELECT DISTINCT 'promql', 'values', event_type || '_total', 'user' FROM events
UNION ALL SELECT 'logql', 'labels', '', '' FROM events HAVING count(*) > 0 UNION ALL SELECT DISTINCT 'logql', 'values', '', 'app' FROM events""")
def prewarm_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = [F.lit("").alias(c) for c in ("path", "group", "rule", "panel", "expr")]
    m, s = checks.asked(_promql(spark, sf_dir).select(*none, "r"), "promql")
    _, st = checks.asked(_logql(spark, sf_dir).select(*none, "r"), "logql")
    return checks.work_list(m, s, st)


@query("""SELECT kind, n_name || '*' AS metric_pat, CASE WHEN kind <> 'metrics' THEN 'l' || n_regionkey END AS label_pat, CASE kind WHEN 'values' THEN 'v' || n_nationkey || '*' END AS value_pat, 'r: ' || n_name AS reason
FROM nation, (VALUES ('metrics'), ('labels'), ('values')) t(kind)""")
def allowlist_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allowlist file with an entry of each kind a nation, and entries that lack what they need."""
    names = sorted((r.n_nationkey, r.n_regionkey, r.n_name) for r in _t(spark, sf_dir, "nation").collect())  # one file, parsed on the driver
    text = "metrics:\n- reason: no pattern\n" + "".join(f"- {{pattern: '{n}*', reason: 'r: {n}'}}\n" for _, _, n in names)
    text += "labels:\n- {patterns: [x], reason: no metric}\n" + "".join(f"- {{metric: '{n}*', patterns: [l{r}], reason: 'r: {n}'}}\n" for _, r, n in names)
    text += "label_values:\n- {metric: m, patterns: [x]}\n" + "".join(f"- {{metric: '{n}*', label: l{r}, patterns: ['v{k}*'], reason: 'r: {n}'}}\n" for k, r, n in names)
    none = F.lit(None).cast("string")
    m, lb, v = allowlist.parse(text).tables(spark)
    parts = (m.select(F.lit("metrics").alias("kind"), "metric_pat", none.alias("label_pat"), none.alias("value_pat"), "reason"), lb.select(F.lit("labels").alias("kind"), "metric_pat", "label_pat", none.alias("value_pat"), "reason"), v.select(F.lit("values").alias("kind"), "metric_pat", "label_pat", "value_pat", "reason"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT c_custkey, '"c' || c_custkey || chr(92) || 'x01' || chr(92) || 'u00a0' || chr(92) || 't' || chr(92) || chr(92) || chr(92) || '"é"' AS quoted FROM customer""")
def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as messages show them: what cannot be seen is escaped."""
    return _t(spark, sf_dir, "customer").select("c_custkey", R.quoted(cat("c", "`c_custkey`", '\x01\u00a0\t\\"é')).alias("quoted"))


# findings and reports

ALL_LINT_SQL = f"""{RULES_SQL}, d AS ({DUPLICATE_SQL}), found AS (
SELECT 'W402_EMPTY_EXPR' AS code, 'warning' AS severity, 'lint' AS category, path AS file, grp, alert AS rule, 'rule expression is empty' AS message, 0 AS seq FROM rules WHERE p_retailprice < 950
UNION ALL SELECT 'E301_MISSING_SEVERITY', 'error', 'lint', path, grp, alert, 'alert is missing required label `severity`', 0 FROM rules WHERE p_size <= 10
UNION ALL SELECT 'E302_MISSING_ANNOTATION', 'error', 'lint', path, grp, alert, 'alert is missing required annotation `description`', 0 FROM rules WHERE p_retailprice > 980
UNION ALL SELECT 'W401_FOR_LT_INTERVAL', 'warning', 'lint', path, grp, alert, 'alert `for` (' || p_size || 'm) is less than group `interval` (20m)', 0 FROM rules WHERE p_size < 20
UNION ALL SELECT 'E303_DUPLICATE_ALERT', 'error', 'lint', path, grp, alert, 'alert name `' || alert || '` is also defined at ' || fp || ':' || fg, nth FROM d WHERE nth > 1)"""


def _all_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.union(spark, lint.lint(_rules(spark, sf_dir)))


@query(f"""WITH {ALL_LINT_SQL} SELECT row_number() OVER (ORDER BY file, grp, rule, code, message, seq) AS position, code, file, grp AS "group", rule, message FROM found""")
def findings_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each finding in a report."""
    return fd.positions(_all_lint(spark, sf_dir)).select("position", "code", "source.file", "source.group", "source.rule", "message")


@query(f"WITH {ALL_LINT_SQL} SELECT code, severity, category, count(*) AS n FROM found GROUP BY ALL")
def metrics_findings_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.counts(_all_lint(spark, sf_dir))


@query(f"WITH {ALL_LINT_SQL} SELECT s AS severity, count(code) AS n FROM (VALUES ('error'), ('warning'), ('info')) t(s) LEFT JOIN found ON severity = s GROUP BY s")
def metrics_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.by_severity(_all_lint(spark, sf_dir))


@query(f"WITH {ALL_LINT_SQL} SELECT CASE max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'errors' WHEN 1 THEN 'warnings' ELSE 'clean' END AS outcome, coalesce(max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END), 0) AS exit_code FROM found")
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.verdict(_all_lint(spark, sf_dir))


@query("SELECT 'promql' AS kind, count(DISTINCT (p_brand, p_size)) AS n FROM part UNION ALL SELECT 'logql', 0 UNION ALL SELECT 'dashboard', count(DISTINCT c_nationkey) FROM customer")
def files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.files_by_kind(rule_files(spark, sf_dir).select("kind", "path").unionByName(dashboard_files(spark, sf_dir).select("kind", "path")))


@query(f"WITH {ALL_LINT_SQL} SELECT concat_ws(chr(9), severity, code, category, file, '0', grp, rule, message) AS line FROM found")
def report_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_lint(spark, sf_dir).select(report.tsv_line().alias("line"))


@query(f"WITH {ALL_LINT_SQL} SELECT '::' || severity || ' file=' || file || ',title=' || code || '::' || message AS line FROM found")
def report_github(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_lint(spark, sf_dir).select(report.github_line().alias("line"))


@query(f"WITH {ALL_LINT_SQL} SELECT upper(severity) || ' ' || code || ': ' || message || chr(10) || '  at ' || file || ' (' || grp || '/' || rule || ')' || chr(10) AS block FROM found")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_lint(spark, sf_dir).select(report.text_block().alias("block"))


@query(f"""WITH {ALL_LINT_SQL} SELECT '{{"code":"' || code || '","severity":"' || severity || '","category":"lint","source":{{"file":"' || file || '","group":"' || grp || '","rule":"' || rule || '"}},"message":"' || message || '","context":{{' || CASE code WHEN 'E302_MISSING_ANNOTATION' THEN '"label":"description"' ELSE '' END || '}}}}' AS line FROM found""")
def report_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_lint(spark, sf_dir).select(report.ndjson_line().alias("line"))


@query(f"WITH {ALL_LINT_SQL} SELECT file, count(*) AS tests, count(*) AS failures, CAST(0 AS BIGINT) AS skipped FROM found GROUP BY file")
def report_junit_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.junit_suites(_all_lint(spark, sf_dir))


@query(f"WITH {ALL_LINT_SQL} SELECT DISTINCT code, CASE code[1] WHEN 'E' THEN 'error' ELSE 'warning' END AS severity FROM found")
def report_sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(_all_lint(spark, sf_dir))


#: Lint findings of the rules as metric rules and, in the folder logs, as log rules, which are duplicates one and all.
BOTH_SQL = ALL_LINT_SQL + """, both_kinds AS (SELECT * EXCLUDE (seq) FROM found
UNION ALL SELECT code, severity, category, 'logs/' || file, grp, rule, message FROM found WHERE code NOT LIKE 'E303%'
UNION ALL SELECT 'E303_DUPLICATE_ALERT', 'error', 'lint', 'logs/' || path, grp, alert, 'alert name `' || alert || '` is also defined at ' || fp || ':' || fg FROM d)"""


@query(f"""WITH {BOTH_SQL}, {PANELS_SQL},
refs AS (SELECT path, grp, alert AS rule, '' AS panel, 'size' AS label FROM rules WHERE p_retailprice >= 950),
cust AS (SELECT path, c_name || '/A' AS panel FROM panels WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY')),
vars AS (SELECT DISTINCT path, 'var=job' AS panel FROM panels)
SELECT code, severity, category, file, grp AS "group", rule, '' AS panel, message FROM both_kinds
UNION ALL SELECT 'E002_LOGQL_PARSE_ERROR', 'error', 'parse', 'logs/' || path, grp, alert, '', 'LogQL parse error: empty expression' FROM rules WHERE p_retailprice < 950
UNION ALL SELECT 'E201_STREAM_LABEL_UNKNOWN', 'error', 'catalog', 'logs/' || path, grp, alert, '', 'stream label "part" not present in Loki' FROM rules WHERE p_retailprice >= 950
UNION ALL SELECT 'E001_PROMQL_PARSE_ERROR', 'error', 'parse', path, grp, alert, '', 'PromQL parse error: empty expression' FROM rules WHERE p_retailprice < 950
UNION ALL SELECT 'E102_LABEL_UNKNOWN', 'error', 'catalog', path, grp, rule, '', 'label "size" not present on metric "part_total"' FROM refs
UNION ALL SELECT 'E101_METRIC_UNKNOWN', 'error', 'catalog', path, '', '', panel, 'metric "cust_total" not present in catalog' FROM cust
UNION ALL SELECT 'E101_METRIC_UNKNOWN', 'error', 'catalog', path, '', '', panel, 'metric "up" not present in catalog' FROM vars
UNION ALL SELECT 'E201_STREAM_LABEL_UNKNOWN', 'error', 'catalog', path, '', '', c_name || '/A', 'stream label "cust" not present in Loki' FROM panels WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')
UNION ALL SELECT 'E202_STREAM_VALUE_UNKNOWN', 'error', 'catalog', path, '', '', c_name || '/A', 'value "__dashboard_var__" not observed for stream label "app"' FROM panels WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')""")
def validate_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files of both languages and dashboards through parsing, linting and catalog checks; findings with their place."""
    rules = _rules(spark, sf_dir).unionByName(_rules(spark, sf_dir, "logql"))
    rules, items = written(rules.withColumn("path", F.when(F.col("kind") == "logql", F.concat(F.lit("logs/"), "path")).otherwise(F.col("path"))), "rules"), written(_items(spark, sf_dir), "items")
    tables = Tables(
        local(spark, [("part_total",)], "metric string"), local(spark, [("part_total", "brand")], "metric string, label string"), local(spark, [("part_total", "brand", "x")], "metric string, label string, value string"),
        local(spark, [("app",)], "label string"), local(spark, [("app", "api")], "label string, value string"),
    )
    parts = parse_findings(rules, items) + lint.lint(rules) + checks.check_promql(extracted(rules, items, "promql"), tables, Allowlist()) + checks.check_logql(extracted(rules, items, "logql"), tables, Allowlist())
    return fd.union(spark, parts).select("code", "severity", "category", "source.file", "source.group", "source.rule", "source.panel", "message")


DOCUMENTS_SQL = f"""WITH {ALL_LINT_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY file, grp, rule, code, message, seq) AS k FROM found),
label AS (SELECT *, CASE code WHEN 'E302_MISSING_ANNOTATION' THEN chr(10) || '        "label": "description"' || chr(10) || '      ' ELSE '' END AS lab FROM f),
suite AS (SELECT file, '  <testsuite name="' || file || '" tests="' || count(*) || '" failures="' || count(*) || '" skipped="0">' || chr(10) ||
  string_agg('    <testcase name="' || grp || '/' || rule || '/' || code || '" classname="lint">' || chr(10) || '      <failure type="' || code || '" message="' || message || '"></failure>' || chr(10) || '    </testcase>' || chr(10), '' ORDER BY k) || '  </testsuite>' || chr(10) AS x FROM f GROUP BY file),
rule AS (SELECT DISTINCT code, CASE code[1] WHEN 'E' THEN 'error' ELSE 'warning' END AS lev FROM f)
SELECT 'json' AS format, '{{' || chr(10) || '  "schemaVersion": 1,' || chr(10) || '  "tool": "signalens",' || chr(10) || '  "generatedAt": "2024-05-06T07:08:09Z",' || chr(10) || '  "filesScanned": 7,' || chr(10) || '  "findings": [' || chr(10) ||
  (SELECT string_agg('    {{' || chr(10) || '      "code": "' || code || '",' || chr(10) || '      "severity": "' || severity || '",' || chr(10) || '      "category": "lint",' || chr(10) || '      "source": {{' || chr(10) ||
  '        "file": "' || file || '",' || chr(10) || '        "group": "' || grp || '",' || chr(10) || '        "rule": "' || rule || '"' || chr(10) || '      }},' || chr(10) || '      "message": "' || message || '",' || chr(10) || '      "context": {{' || lab || '}}' || chr(10) || '    }}', ',' || chr(10) ORDER BY k) FROM label) || chr(10) || '  ]' || chr(10) || '}}' || chr(10) AS text
UNION ALL SELECT 'junit', '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<testsuites name="signalens">' || chr(10) || (SELECT string_agg(x, '' ORDER BY file) FROM suite) || '</testsuites>' || chr(10)
UNION ALL SELECT 'sarif', '{{' || chr(10) || '  "$schema": "https://json.schemastore.org/sarif-2.1.0.json",' || chr(10) || '  "version": "2.1.0",' || chr(10) || '  "runs": [' || chr(10) || '    {{' || chr(10) || '      "tool": {{' || chr(10) || '        "driver": {{' || chr(10) || '          "name": "signalens",' || chr(10) || '          "rules": [' || chr(10) ||
  (SELECT string_agg('            {{' || chr(10) || '              "id": "' || code || '",' || chr(10) || '              "name": "' || code || '",' || chr(10) || '              "properties": {{' || chr(10) || '                "defaultSeverity": "' || lev || '"' || chr(10) || '              }}' || chr(10) || '            }}', ',' || chr(10) ORDER BY code) FROM rule) ||
  chr(10) || '          ]' || chr(10) || '        }}' || chr(10) || '      }},' || chr(10) || '      "results": [' || chr(10) ||
  (SELECT string_agg('        {{' || chr(10) || '          "ruleId": "' || code || '",' || chr(10) || '          "level": "' || severity || '",' || chr(10) || '          "message": {{' || chr(10) || '            "text": "' || message || '"' || chr(10) || '          }},' || chr(10) || '          "locations": [' || chr(10) || '            {{' || chr(10) || '              "physicalLocation": {{' || chr(10) ||
  '                "artifactLocation": {{' || chr(10) || '                  "uri": "' || file || '"' || chr(10) || '                }}' || chr(10) || '              }}' || chr(10) || '            }}' || chr(10) || '          ]' || chr(10) || '        }}', ',' || chr(10) ORDER BY k) FROM f) ||
  chr(10) || '      ]' || chr(10) || '    }}' || chr(10) || '  ]' || chr(10) || '}}' || chr(10)"""


@query(DOCUMENTS_SQL)
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of the reports that are one document, written by executors and read one after another."""
    found, at, out = written(_all_lint(spark, sf_dir), "findings"), datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc), None
    for f in ("json", "junit", "sarif"):
        path = new_path(spark, f)
        report.write_document(found, f, path, 7, at)
        text = spark.read.text(path, wholetext=True).select(F.lit(f).alias("format"), F.col("value").alias("text"))
        out = text if out is None else out.unionByName(text)
    return out.coalesce(1)


@query("""WITH f AS (SELECT DISTINCT p_brand, p_size FROM part), c AS (SELECT DISTINCT c_nationkey AS k FROM customer)
SELECT CASE WHEN p_size % 5 = 0 THEN 'E003_RULEFILE_YAML_INVALID' ELSE 'W402_EMPTY_EXPR' END AS code, CASE WHEN p_size % 3 = 0 THEN 'more/' ELSE '' END || p_brand || '-' || p_size || CASE WHEN p_size % 2 = 0 THEN '.YML' ELSE '.yaml' END AS file, 'promql' AS kind FROM f WHERE p_size % 7 <> 0
UNION ALL SELECT 'E004_DASHBOARD_JSON_INVALID', 'n' || k || '.json', 'dashboard' FROM c WHERE k % 2 = 0
UNION ALL SELECT 'E101_METRIC_UNKNOWN', 'n' || k || '.json', 'dashboard' FROM c WHERE k % 2 = 1
UNION ALL SELECT 'scanned', CAST((SELECT count(*) FROM f WHERE p_size % 7 <> 0) AS VARCHAR), 'promql' UNION ALL SELECT 'scanned', CAST((SELECT count(*) FROM c) AS VARCHAR), 'dashboard' UNION ALL SELECT 'scanned', '0', 'logql'""")
def validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in directories, written first: nested, hidden and foreign ones, some that cannot be decoded; found, read and validated."""
    root = written(spark.range(1), "root").inputFiles()[0].removeprefix("file://").rpartition("/")[0] + "/files"
    rules = _t(spark, sf_dir, "part").select("p_brand", "p_size").distinct()
    size, name = F.col("p_size"), cat("`p_brand`", "-", "`p_size`", F.when(F.col("p_size") % 2 == 0, ".YML").otherwise(".yaml"))
    path = F.concat(F.when(size % 7 == 0, F.when(size % 2 == 0, "rules/.hidden/").otherwise("rules/.")).when(size % 3 == 0, "rules/more/").otherwise("rules/"), name)
    body = F.when(size % 5 == 0, "groups: [}").otherwise(cat("groups:\n- name: g\n  rules:\n  - record: r", "`p_size`", "\n    expr: ' '\n"))
    boards = _t(spark, sf_dir, "customer").select("c_nationkey").distinct()
    board = F.when(F.col("c_nationkey") % 2 == 0, '{"panels": {}}').otherwise('{"panels": [{"title": "t", "targets": [{"refId": "A", "expr": "nope"}]}]}')
    files = rules.select(path.alias("path"), body.alias("body")).unionByName(rules.select(F.concat(F.lit("rules/"), "p_brand", F.lit(".txt")).alias("path"), F.lit("groups: [}").alias("body")).distinct())
    files = files.unionByName(boards.select(cat("boards/n", "`c_nationkey`", ".json").alias("path"), board.alias("body")))

    def put(frames):
        for df in frames:
            for p, b in zip(df.path, df.body, strict=True):
                os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
                with open(f"{root}/{p}", "w", encoding="utf-8") as f:
                    f.write(b)
            yield df[["path"]]

    files.mapInPandas(put, "path string").count()
    catalog = Tables(spark.createDataFrame([("up",)], "metric string"), spark.createDataFrame([], "metric string, label string"), spark.createDataFrame([], "metric string, label string, value string"))
    r = validate(spark, Inputs([f"{root}/rules"], [], [f"{root}/boards"]), Settings(catalog=catalog))
    found = r.findings.where("code <> 'E001_PROMQL_PARSE_ERROR'").select("code", F.regexp_replace("source.file", r"^.*/files/(rules|boards)/", "").alias("file"), F.when(F.col("source.file").contains("/boards/"), "dashboard").otherwise("promql").alias("kind"))
    return found.unionByName(spark.createDataFrame([("scanned", str(n), k) for k, n in r.files_by_kind.items()], "code string, file string, kind string"))


# what is written out, and single rules


def _mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """f of a pandas frame to a list of rows, in batches."""

    def part(frames):
        for x in frames:
            yield pd.DataFrame(f(x), columns=[c.split()[0] for c in schema.split(", ")])

    return df.mapInPandas(part, schema)


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"expr": "' || e || '", "metricRefs": ["' || event_type || '"], "selectors": [{"metric": "' || event_type || '", "label": "u", "op": "=", "value": "' || user_id || '"}], "atModifiers": null, "functions": ["rate"]}'
WHEN 1 THEN '{"expr": "' || e || '", "streamSelectors": [{"label": "u", "op": "=", "value": "' || user_id || '"}], "lineFilters": null, "labelFilters": null, "parsers": ["logfmt"], "functions": null}'
ELSE '{"expr": "' || e || '", "attributes": [{"scope": "span", "parent": false, "name": "u' || user_id || '"}]}' END AS line
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'rate(' || event_type || '{u=' || chr(92) || '"' || user_id || chr(92) || '"}[5m])' WHEN 1 THEN '{u=' || chr(92) || '"' || user_id || chr(92) || '"} | logfmt' ELSE '{ span.u' || user_id || ' = 1 }' END AS e FROM events)""")
def emit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON lines of the extraction commands, in all three languages."""
    k = F.col("event_id") % 3
    e = F.when(k == 0, cat("rate(", "`event_type`", '{u="', "`user_id`", '"}[5m])')).when(k == 1, cat('{u="', "`user_id`", '"} | logfmt')).otherwise(cat("{ span.u", "`user_id`", " = 1 }"))
    df = _t(spark, sf_dir, "events").select("event_id", F.when(k == 0, "promql").when(k == 1, "logql").otherwise("traceql").alias("lang"), e.alias("e"))
    return _mapped(df, lambda x: [(i, json.dumps(cli.expression(lang, e), ensure_ascii=False)) for i, lang, e in zip(x.event_id, x.lang, x.e, strict=True)], "event_id long, line string")


@query(f"""WITH {RULES_SQL} SELECT path, CAST(group_pos AS INTEGER) AS group_pos, CAST(rule_pos AS INTEGER) AS rule_pos, alert, p_size || 'm' AS wait, CASE WHEN p_retailprice >= 950 THEN 'part_total' END AS metric, CASE WHEN p_retailprice < 950 THEN 'empty expression' END AS error FROM rules""")
def emit_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object of the rule-file command, a file a line, taken apart again."""

    def lines(x):
        return [(p, json.dumps({"groups": cli.rule_groups("promql", yaml_docs.rule_groups(c))})) for p, c in zip(x.path, x.content, strict=True)]

    rule = "struct<alert:string,`for`:string,error:string,result:struct<metricRefs:array<string>>>"
    doc = _mapped(rule_files(spark, sf_dir).select("path", "content"), lines, "path string, doc string").select("path", F.from_json("doc", f"groups array<struct<name:string,rules:array<{rule}>>>").alias("d"))
    rules = doc.select("path", F.posexplode("d.groups").alias("group_pos", "g")).select("path", "group_pos", F.posexplode("g.rules").alias("rule_pos", "r"))
    return rules.select("path", "group_pos", "rule_pos", "r.alert", F.col("r.for").alias("wait"), F.try_element_at("r.result.metricRefs", F.lit(1)).alias("metric"), F.col("r.error").alias("error"))


@query(f"""WITH {PANELS_SQL} SELECT path, nullif(c_custkey, 0) AS id, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'logql' ELSE 'promql' END AS language, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'app,word' ELSE 'job' END AS variables,
CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY') THEN 'cust_total' END AS metric, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 2 ELSE 0 END AS streams, 'up' AS variable_metric FROM panels""")
def emit_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object of the dashboard command, a file a line, taken apart again."""

    def lines(x):
        return [(p, json.dumps(cli.dashboard(boards.decode(c)))) for p, c in zip(x.path, x.content, strict=True)]

    target = "struct<language:string,expr:string,variables:array<string>,promql:struct<metricRefs:array<string>>,logql:struct<streamSelectors:array<struct<label:string>>>,error:string>"
    doc = _mapped(dashboard_files(spark, sf_dir).select("path", "content"), lines, "path string, doc string")
    doc = doc.select("path", F.from_json("doc", f"panels array<struct<id:bigint,targets:array<{target}>>>, variables array<{target}>").alias("d"))
    t = doc.select("path", F.col("d.variables")[0]["promql"]["metricRefs"][0].alias("variable_metric"), F.explode("d.panels").alias("p")).select("path", "variable_metric", "p.id", F.explode("p.targets").alias("t")).where("t.error is null")
    return t.select("path", "id", "t.language", F.array_join("t.variables", ",").alias("variables"), F.try_element_at("t.promql.metricRefs", F.lit(1)).alias("metric"), F.coalesce(F.size("t.logql.streamSelectors"), F.lit(0)).alias("streams"), "variable_metric")


@query("SELECT DISTINCT event_type, '?match%5B%5D=%7B__name__%3D%22' || event_type || '%22%7D&match%5B%5D=up' AS params FROM events")
def match_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "events").select("event_type").distinct()
    return _mapped(names, lambda x: [(n, cat_source.match_query([cat_source.scope(n), "", "up"])) for n in x.event_type], "event_type string, params string")


@query("SELECT p_partkey, CASE WHEN n > 512 THEN repeat('x', 512) || '…' ELSE repeat('x', n) END AS body FROM (SELECT p_partkey, CAST(480 + p_size AS INTEGER) AS n FROM part)")
def error_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of failed requests, cut at 512 bytes."""
    return _mapped(_t(spark, sf_dir, "part").select("p_partkey", F.expr("repeat('x', 480 + p_size)").alias("b")), lambda x: [(k, cat_source.cut_body(b.encode())) for k, b in zip(x.p_partkey, x.b, strict=True)], "p_partkey long, body string")


@query("""SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size >= 10 AND (p_size % 11 <> 0 OR p_size % 4 = 0) AS ok FROM part""")
def entries_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries of which some lack a query, a source, a language, a time or a result, or have another version or a negative lifetime."""

    def one(n: int) -> bool:
        e = cat_source.Entry("" if n % 3 == 0 else "q", "sql" if n % 5 == 0 else "promql", "" if n % 7 == 0 else "s", 1.0, -1 if n < 10 else 0, None if n % 11 == 0 else [], 1 if n % 2 == 0 else 2, "e" if n % 4 == 0 else "")
        try:
            e.validate()
        except ValueError:
            return False
        return True

    return _mapped(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), lambda x: [(k, one(int(n))) for k, n in zip(x.p_partkey, x.p_size, strict=True)], "p_partkey long, ok boolean")


@query("SELECT p_partkey, p_size % 4 IN (0, 1, 2) AS relevant FROM part")
def relevant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose changes count: by extension, in any letter case."""
    name = cat("d.yaml/f", "`p_partkey`", F.element_at(F.array(*[F.lit(x) for x in (".yaml", ".YML", ".Json", ".yaml.bak")]), (F.col("p_size") % 4 + 1).cast("int")))
    return _mapped(_t(spark, sf_dir, "part").select("p_partkey", name.alias("n")), lambda x: [(k, watch.relevant(n)) for k, n in zip(x.p_partkey, x.n, strict=True)], "p_partkey long, relevant boolean")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '::error title=C::m%25 %0A' WHEN 1 THEN '::warning title=C::m%25 %0A' WHEN 2 THEN '::notice title=C::m%25 %0A' END AS line FROM part""")
def report_github_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities have commands of their own; one that has none gives no line."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("error", "warning", "info", "off")]), (F.col("p_size") % 4 + 1).cast("int")).alias("s"))
    f = fd.make(p, "C", "x", F.lit("m% \n"), severity=F.col("s"), file=None, seq="p_partkey")
    return f.select(F.col("seq").alias("p_partkey"), report.github_line().alias("line"))


@query(f"WITH {ALL_LINT_SQL} SELECT concat_ws(chr(9), severity, code, category, file, '0', grp, rule, message) AS line FROM found")
def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written in parts, and read."""
    folder = new_path(spark, "report")
    report.write(fd.ordered(_all_lint(spark, sf_dir)), "tsv", folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


class _Series:
    """Clients of both kinds over (metric, user) pairs."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.by: dict[str, list[str]] = {}
        for m, u in pairs:
            self.by.setdefault(m, []).append(u)

    def metric_names(self) -> list[str]:
        return list(self.by)

    def label_names(self, matchers: list[str] | None = None) -> list[str]:
        return ["user"] if matchers is None or matchers[0][len('{__name__="') : -2] in self.by else []

    def label_values(self, label: str, matchers: list[str] | None = None) -> list[str]:
        return ["web", "api", "web"] if matchers is None else self.by.get(matchers[0][len('{__name__="') : -2], []) if label == "user" else []


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[Tables, str]:
    """A catalog of events read through clients and a file store: for metrics of clicks and purchases what they have, for others nothing."""
    root = new_path(spark, "cache").removeprefix("file://")
    e = _t(spark, sf_dir, "events").select("event_type", F.concat(F.lit("u"), F.col("user_id") % 10).alias("u")).distinct()
    pairs = [(r.event_type, r.u) for r in e.where("event_type in ('click', 'purchase')").collect()]  # ten users a type
    plan = e.select(F.lit("promql").alias("lang"), F.explode(F.array(F.lit("names"), F.lit("labels"), F.lit("values"))).alias("task"), F.col("event_type").alias("metric"), F.lit("user").alias("label"))
    plan = plan.select("lang", "task", F.when(F.col("task") == "names", "").otherwise(F.col("metric")).alias("metric"), F.when(F.col("task") == "values", F.col("label")).otherwise("").alias("label")).distinct()
    plan = plan.unionByName(spark.createDataFrame([("logql", "labels", "", ""), ("logql", "values", "", "app")], plan.schema))
    client = _Series(pairs)
    made = lambda: cat_source.Catalog(client, client, prometheus_source="http://p", loki_source="http://l", store=cat_source.FileStore(root), clock=lambda: 1700000000.0)
    made().snapshot(spark, plan)
    client.by = {k: [] for k in client.by}  # what is cached is not asked for again
    return made().snapshot(spark, plan), root


_SERIES_SQL = "s AS (SELECT DISTINCT event_type AS metric, 'u' || user_id % 10 AS u FROM events WHERE event_type IN ('click', 'purchase'))"


@query(f"""WITH {_SERIES_SQL} SELECT DISTINCT 'metrics' AS kind, metric, NULL AS label, NULL AS value FROM s UNION ALL SELECT DISTINCT 'labels', metric, 'user', NULL FROM s UNION ALL SELECT 'values', metric, 'user', u FROM s
UNION ALL SELECT 'stream_labels', NULL, 'user', NULL UNION ALL SELECT 'stream_values', NULL, 'app', v FROM (VALUES ('api'), ('web')) t(v)""")
def catalog_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a catalog that was asked twice, the second time from its cache."""
    t, _ = _snapshot(spark, sf_dir)
    out, none = None, F.lit(None).cast("string")
    for kind in ("metrics", "labels", "values", "stream_labels", "stream_values"):
        df = getattr(t, kind)
        part = df.select(F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else none.alias(c) for c in ("metric", "label", "value")])
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_SERIES_SQL}, k AS (SELECT 'promql' AS language, 'http://p' AS source, '__all_metric_names__' AS query, (SELECT string_agg(DISTINCT metric, ',' ORDER BY metric) FROM s) AS held
UNION ALL SELECT DISTINCT 'promql', 'http://p', '__metric_labels__:' || event_type, CASE WHEN event_type IN ('click', 'purchase') THEN 'user' ELSE '' END FROM events
UNION ALL SELECT 'promql', 'http://p', '__metric_label_values__:' || e.t || ':user', 'user=' || coalesce((SELECT string_agg(u, ',' ORDER BY u) FROM s WHERE metric = e.t), '') FROM (SELECT DISTINCT event_type AS t FROM events) e
UNION ALL SELECT 'logql', 'http://l', '__all_label_names__', 'user' UNION ALL SELECT 'logql', 'http://l', '__stream_label_values__:app', 'app=api,web')
SELECT sha256(language || chr(10) || source || chr(10) || query) AS key, language, source, query, 3600 AS ttl_seconds, held FROM k""")
def catalog_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored entries as a table: names, labels, or values by label, each sorted and without repetitions."""
    _, root = _snapshot(spark, sf_dir)
    c, r = cat_source.cache_table(spark, f"file://{root}"), "result."
    by_label = F.array_join(F.transform(F.map_entries(r + "label_values"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ","))), ";")
    return c.where("fetched_at = timestamp_seconds(1700000000)").select("key", "language", "source", "query", "ttl_seconds", F.coalesce(F.array_join(r + "metric_names", ","), F.array_join(r + "label_names", ","), by_label).alias("held"))
