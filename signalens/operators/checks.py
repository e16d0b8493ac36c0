"""Catalog checks as joins: which references are not in the catalog, nor allowed.

References come as tables with the position (seq) of each within its expression and the columns that name its source.
Anti-joins keep repeated references, so a matcher that stands twice in an expression is reported twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalens.functions import rules as R
from signalens.operators import findings as f
from signalens.operators import suggest
from signalens.operators import tables as tables_of
from signalens.sources.allowlist import Allowlist
from signalens.sources.catalog import Tables

SOURCE = ("path", "group", "rule", "panel", "expr")


def references(df: DataFrame, lang: str, result: str = "r") -> tuple[DataFrame, DataFrame]:
    """(metrics, selectors) of PromQL results or (None, stream selectors) of LogQL results, for rows without an error."""
    if lang == "logql":
        return None, _fit(df, result).select(*SOURCE, F.posexplode(f"{result}.streamSelectors").alias("seq", "s")).select(*SOURCE, "seq", "s.*")
    each = _each(df, result)
    return each.where("whole").select(*SOURCE, "seq", "metric"), each.where("not whole").drop("whole")


def _fit(df: DataFrame, result: str) -> DataFrame:
    return df.where(F.col(f"{result}.error").isNull() & F.col(result).isNotNull())


def _each(df: DataFrame, result: str) -> DataFrame:
    """Metrics (whole) and selectors of PromQL results."""
    none = F.lit("")
    m = F.transform(f"{result}.metricRefs", lambda x, i: F.struct(F.lit(True).alias("whole"), i.alias("seq"), x.alias("metric"), none.alias("label"), none.alias("op"), none.alias("value")))
    s = F.transform(f"{result}.selectors", lambda x, i: F.struct(F.lit(False).alias("whole"), i.alias("seq"), x["metric"].alias("metric"), x["label"].alias("label"), x["op"].alias("op"), x["value"].alias("value")))
    return _fit(df, result).select(*SOURCE, F.explode(F.concat(m, s)).alias("s")).select(*SOURCE, "s.*")


def cut(df: DataFrame, result: str = "r") -> DataFrame:
    """Sources and results as a table, so that the several checks don't parse again."""
    return tables_of.written(df.select(*SOURCE, result), "references")


def asked(df: DataFrame, lang: str, result: str = "r") -> tuple[DataFrame | None, DataFrame]:
    """References as far as a work list goes by them: distinct, without places, and of a value only whether there is one. One pass over
    the results leaves them as a table, so that no part of the list parses again."""
    value = F.when(F.col("value") != "", "*").otherwise("").alias("value")
    if lang == "logql":
        return None, tables_of.written(references(df, lang, result)[1].select("label", "op", value).distinct(), "asked")
    each = tables_of.written(_each(df, result).select("whole", "metric", "label", "op", value).distinct(), "asked")
    return each.where("whole").select("metric"), each.where("not whole").drop("whole")


def work_list(metrics: DataFrame | None, selectors: DataFrame | None, streams: DataFrame | None) -> DataFrame:
    """Distinct (lang, task, metric, label) that a catalog has to be asked for. Labels of metrics that turn out unknown are in it."""
    parts, none = [], F.lit("")
    if metrics is not None:
        s = selectors.where("metric <> '' and label <> ''")
        parts.append(metrics.select("metric").unionByName(s.select("metric")).select(F.lit("promql").alias("lang"), F.lit("names").alias("task"), none.alias("metric"), none.alias("label")).limit(1))
        parts.append(s.select(F.lit("promql").alias("lang"), F.lit("labels").alias("task"), "metric", none.alias("label")).distinct())
        parts.append(s.where("op = '=' and value <> ''").select(F.lit("promql").alias("lang"), F.lit("values").alias("task"), "metric", "label").distinct())
    if streams is not None:
        s = streams.where("label <> ''")
        parts.append(s.select(F.lit("logql").alias("lang"), F.lit("labels").alias("task"), none.alias("metric"), none.alias("label")).limit(1))
        parts.append(s.where("op = '=' and value <> ''").select(F.lit("logql").alias("lang"), F.lit("values").alias("task"), none.alias("metric"), "label").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unknown_metrics(metrics: DataFrame, known: DataFrame, allow: DataFrame) -> DataFrame:
    m = metrics.join(known.select("metric").distinct(), "metric", "left_anti")
    return m.join(F.broadcast(allow), R.matches_pattern(F.col("metric_pat"), F.col("metric")), "left_anti")


def _usable(selectors: DataFrame, known: DataFrame) -> DataFrame:
    """Selectors of known metrics; those of unknown ones say nothing, even where the metric is allowed."""
    return selectors.where("metric <> '' and label <> ''").join(known.select("metric").distinct(), "metric", "left_semi")


def unknown_labels(selectors: DataFrame, known: DataFrame, labels: DataFrame, allow: DataFrame) -> DataFrame:
    s = _usable(selectors, known).join(labels.select("metric", "label").distinct(), ["metric", "label"], "left_anti")
    return s.join(F.broadcast(allow), R.matches_pattern(F.col("metric_pat"), F.col("metric")) & R.matches_pattern(F.col("label_pat"), F.col("label")), "left_anti")


def unknown_values(selectors: DataFrame, known: DataFrame, labels: DataFrame, values: DataFrame, allow: DataFrame) -> DataFrame:
    """Values of equality matchers whose label is known."""
    s = _usable(selectors, known).where("op = '=' and value <> ''").join(labels.select("metric", "label").distinct(), ["metric", "label"], "left_semi")
    s = s.join(values.select("metric", "label", "value").distinct(), ["metric", "label", "value"], "left_anti")
    a = R.matches_pattern(F.col("metric_pat"), F.col("metric")) & R.matches_pattern(F.col("label_pat"), F.col("label")) & R.matches_pattern(F.col("value_pat"), F.col("value"))
    return s.join(F.broadcast(allow), a, "left_anti")


def unknown_stream_labels(streams: DataFrame, labels: DataFrame, allow: DataFrame) -> DataFrame:
    """Labels of logs are global: allowlist entries are asked with an empty metric."""
    s = streams.where("label <> ''").join(labels.select("label").distinct(), "label", "left_anti")
    return s.join(F.broadcast(allow), R.matches_pattern(F.col("metric_pat"), F.lit("")) & R.matches_pattern(F.col("label_pat"), F.col("label")), "left_anti")


def unknown_stream_values(streams: DataFrame, labels: DataFrame, values: DataFrame, allow: DataFrame) -> DataFrame:
    s = streams.where("label <> '' and op = '=' and value <> ''").join(labels.select("label").distinct(), "label", "left_semi").join(values.select("label", "value").distinct(), ["label", "value"], "left_anti")
    a = R.matches_pattern(F.col("metric_pat"), F.lit("")) & R.matches_pattern(F.col("label_pat"), F.col("label")) & R.matches_pattern(F.col("value_pat"), F.col("value"))
    return s.join(F.broadcast(allow), a, "left_anti")


def _say(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def check_promql(df: DataFrame, tables: Tables, allow: Allowlist, result: str = "r", *, skip_variables: bool = False, k: int = suggest.MOST, distance: int = suggest.DISTANCE) -> list[DataFrame]:
    """Findings E101 to E103 for rows of (path, group, rule, panel, expr, <result>); none without a metrics catalog.

    skip_variables leaves out references that stand for a dashboard variable; by default they are checked like any other.
    """
    if tables.metrics is None:
        return []
    if tables.metrics.isEmpty():
        raise ValueError("the metrics catalog is empty")
    metrics, selectors = references(cut(df, result), "promql", result)
    if skip_variables:
        metrics = metrics.where(~F.col("metric").contains(R.VARIABLE))
        selectors = selectors.where(~F.col("metric").contains(R.VARIABLE) & ~F.col("value").contains(R.VARIABLE) & ~F.col("label").contains(R.VARIABLE))
    am, al, av = allow.tables(df.sparkSession)
    q = lambda c: R.quoted(F.col(c))
    m = suggest.attach(unknown_metrics(metrics, tables.metrics, am).withColumn("query", F.col("metric")), tables.metrics.select(F.col("metric").alias("name")), [], k, distance)
    lb = suggest.attach(unknown_labels(selectors, tables.metrics, tables.labels, al).withColumn("query", F.col("label")), tables.labels.select("metric", F.col("label").alias("name")), ["metric"], k, distance)
    v = suggest.attach(unknown_values(selectors, tables.metrics, tables.labels, tables.values, av).withColumn("query", F.col("value")), tables.values.select("metric", "label", F.col("value").alias("name")), ["metric", "label"], k, distance)
    place = {"group": "group", "rule": "rule", "panel": "panel", "suggestions": "suggestions", "expr": "expr", "seq": "seq"}
    return [
        f.make(m, f.CODES["metric"], "catalog", _say("metric ", q("metric"), " not present in catalog"), metric="metric", **place),
        f.make(lb, f.CODES["label"], "catalog", _say("label ", q("label"), " not present on metric ", q("metric")), metric="metric", label="label", **place),
        f.make(v, f.CODES["value"], "catalog", _say("value ", q("value"), " not observed for label ", q("label"), " on metric ", q("metric")), metric="metric", label="label", value="value", **place),
    ]


def check_logql(df: DataFrame, tables: Tables, allow: Allowlist, result: str = "r", *, skip_variables: bool = False, k: int = suggest.MOST, distance: int = suggest.DISTANCE) -> list[DataFrame]:
    """Findings E201 and E202; none without a logs catalog."""
    if tables.stream_labels is None:
        return []
    if tables.stream_labels.isEmpty():
        raise ValueError("the logs catalog is empty")
    _, streams = references(cut(df, result), "logql", result)
    if skip_variables:
        streams = streams.where(~F.col("value").contains(R.VARIABLE) & ~F.col("label").contains(R.VARIABLE))
    _, al, av = allow.tables(df.sparkSession)
    q = lambda c: R.quoted(F.col(c))
    lb = suggest.attach(unknown_stream_labels(streams, tables.stream_labels, al).withColumn("query", F.col("label")), tables.stream_labels.select(F.col("label").alias("name")), [], k, distance)
    v = suggest.attach(unknown_stream_values(streams, tables.stream_labels, tables.stream_values, av).withColumn("query", F.col("value")), tables.stream_values.select("label", F.col("value").alias("name")), ["label"], k, distance)
    place = {"group": "group", "rule": "rule", "panel": "panel", "suggestions": "suggestions", "expr": "expr", "seq": "seq"}
    return [
        f.make(lb, f.CODES["stream_label"], "catalog", _say("stream label ", q("label"), " not present in Loki"), label="label", **place),
        f.make(v, f.CODES["stream_value"], "catalog", _say("value ", q("value"), " not observed for stream label ", q("label")), label="label", value="value", **place),
    ]
