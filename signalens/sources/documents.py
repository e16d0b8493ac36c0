"""Scans of rule files and dashboards: a table of paths, their contents, and flat tables of what is in them.

Paths are listed on the driver (Spark's own listing leaves out names that start with _ and heeds letter case); files are read
and decoded on the executors. Every table carries the positions it was exploded by, because order counts in several checks.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signalens.functions import rules as R
from signalens.functions.extract import logql_extract, promql_extract
from signalens.functions.wrappers import unwrap_variable_query
from signalens.sources import dashboards as D
from signalens.sources import yaml_docs as Y

YAML, JSON = (".yaml", ".yml"), (".json",)
PATHS = "kind string, file_pos int, path string"
CONTENT = PATHS + ", content string, read_error string"
RULES = "kind string, file_pos int, path string, group_pos int, rule_pos int, group string, interval string, record string, alert string, expr string, `for` string, labels map<string,string>, annotations map<string,string>, file_error string"
ITEMS = "file_pos int, path string, title string, uid string, item string, panel_pos int, panel_id long, panel_title string, panel_type string, pos int, ref_id string, name string, datasource string, raw string, file_error string"


class MissingPath(FileNotFoundError):
    """An input path that does not exist ends the run."""


def expand(paths: list[str], extensions: tuple[str, ...]) -> list[str]:
    """Files of the given paths, in byte order: a file is taken whatever its extension; in a directory, files with one of the
    extensions (in any letter case), leaving out hidden files and directories. Repeated arguments repeat their files."""
    out: list[str] = []
    for p in paths:
        if not os.path.exists(p):
            raise MissingPath(p)
        if not os.path.isdir(p):
            out.append(p)
            continue
        for root, dirs, files in os.walk(p):
            dirs[:] = [d for d in dirs if not d.startswith(".")]
            out += [os.path.join(root, f) for f in files if not f.startswith(".") and os.path.splitext(f)[1].lower() in extensions]
    return sorted(out, key=lambda s: s.encode("utf-8", "surrogateescape"))


def path_table(spark: SparkSession, prometheus: list[str] = (), loki: list[str] = (), dashboards: list[str] = ()) -> DataFrame:
    """(kind, file_pos, path) of all inputs; kinds are promql, logql and dashboard."""
    rows = [(kind, i, p) for kind, given, ext in (("promql", prometheus, YAML), ("logql", loki, YAML), ("dashboard", dashboards, JSON)) for i, p in enumerate(expand(list(given), ext))]
    return spark.createDataFrame(rows, PATHS).repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism))) if rows else spark.createDataFrame([], PATHS)


def contents(paths: DataFrame) -> DataFrame:
    """Each path with its content, or with the reason why it cannot be read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            content, error = [], []
            for p in df.path:
                try:
                    with open(p, encoding="utf-8", errors="replace", newline="") as f:
                        content.append(f.read())
                    error.append(None)
                except OSError as e:
                    content.append(None)
                    error.append(f"{e.strerror or e}")
            yield df.assign(content=content, read_error=error)

    return paths.mapInPandas(read, CONTENT)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


#: Rows of decoded files that are handed over at once.
AT_ONCE = 2000


def _decoder(rows: Callable[..., Iterator[tuple]], kinds: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches of files: what rows() gives of each file, in batches of bounded size. A worker holds one file and one such
    batch beside what came in, however many files that is and whatever is in them."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            each = (row for i in range(rb.num_rows) for row in rows(*[c[i].as_py() for c in rb.columns]))
            while some := list(islice(each, AT_ONCE)):
                yield _batch(some, kinds)

    return decode


def decoded_rules(files: DataFrame) -> DataFrame:
    """One row a rule; one with file_error for a file that is unreadable or no rule file; one without a rule for an empty group."""

    kinds = _arrow(RULES)

    def rows(kind, pos, path, content, error) -> Iterator[tuple]:
        head = (kind, pos, path)
        if error is not None:
            yield (*head, *[None] * 10, f"cannot read file: {error}")
            return
        try:
            groups = Y.rule_groups(content)
        except (yaml.YAMLError, Y.ShapeError, ValueError, RecursionError) as e:
            yield (*head, *[None] * 10, f"rule file YAML invalid: {' '.join(str(e).split())}")
            return
        for i, g in enumerate(groups):
            for j, r in enumerate(g["rules"]):
                yield (*head, i, j, g["name"], g["interval"], r["record"], r["alert"], r["expr"], r["for"], list(r["labels"].items()), list(r["annotations"].items()), None)
            if not g["rules"]:
                yield (*head, i, None, g["name"], g["interval"], *[None] * 7)

    return files.where("kind in ('promql', 'logql')").select("kind", "file_pos", "path", "content", "read_error").mapInArrow(_decoder(rows, kinds), RULES)


def rule_table(files: DataFrame) -> DataFrame:
    """Rules with their name (alert, else record) and what their expression refers to, as columns prom and log."""
    r = decoded_rules(files).withColumn("rule", F.coalesce(F.nullif("alert", F.lit("")), "record"))
    has = F.col("rule_pos").isNotNull()
    return r.withColumn("prom", F.when(has & (F.col("kind") == "promql"), promql_extract("expr"))).withColumn("log", F.when(has & (F.col("kind") == "logql"), logql_extract("expr")))


def decoded_dashboards(files: DataFrame) -> DataFrame:
    """One row a panel, target and variable (item), or one with file_error."""

    kinds = _arrow(ITEMS)

    def rows(pos, path, content, error) -> Iterator[tuple]:
        head = (pos, path)
        try:
            if error is not None:
                raise OSError(f"cannot read file: {error}")
            d = D.decode(content)
        except OSError as e:
            yield (*head, None, None, "unreadable", *[None] * 9, str(e))
            return
        except D.DashboardError as e:
            yield (*head, None, None, "invalid", *[None] * 9, f"dashboard JSON invalid: {e}")
            return
        head = (*head, d["title"], d["uid"])
        for i, p in enumerate(d["panels"]):
            panel = (i, p["id"], p["title"], p["type"])
            yield (*head, "panel", *panel, None, None, None, p["datasource"], None, None)
            for j, t in enumerate(p["targets"]):
                yield (*head, "target", *panel, j, t["ref_id"], None, t["datasource"], t["expr"], None)
        for j, v in enumerate(d["variables"]):
            yield (*head, "variable", None, None, None, None, j, None, v["name"], v["datasource"], v["query"], None)

    return files.where("kind = 'dashboard'").select("file_pos", "path", "content", "read_error").mapInArrow(_decoder(rows, kinds), ITEMS)


def dashboard_table(files: DataFrame) -> DataFrame:
    """Items with language, normalised text, the variables in it, label for reports, and references as columns prom and log."""
    d = decoded_dashboards(files)
    known = R.language_of(F.col("datasource"))
    d = d.withColumn("lang", F.when(F.col("raw").isNotNull(), F.when(known == "unknown", R.guessed_language(F.col("raw"))).otherwise(known)))
    d = d.withColumn("norm", R.normalised(F.col("raw"))).withColumn("variables", F.when(F.col("raw").isNotNull(), R.variables_in(F.col("raw"))))
    d = d.withColumn("inner", F.when((F.col("item") == "variable") & (F.col("lang") == "promql"), unwrap_variable_query("norm")).otherwise(F.col("norm")))
    d = d.withColumn("panel", F.when(F.col("item") == "variable", F.concat(F.lit("var="), "name")).otherwise(F.concat(F.when(F.col("panel_title") != "", F.col("panel_title")).otherwise(F.concat(F.lit("id="), F.col("panel_id").cast("string"))), F.when(F.col("ref_id") != "", F.concat(F.lit("/"), "ref_id")).otherwise(""))))
    use = F.col("raw").isNotNull() & F.col("inner").isNotNull()
    return d.withColumn("prom", F.when(use & (F.col("lang") == "promql"), promql_extract("inner"))).withColumn("log", F.when(use & (F.col("lang") == "logql"), logql_extract("inner")))


def expressions(spark: SparkSession, path: str) -> DataFrame:
    """One expression a line; empty lines are left out, blank ones are not."""
    return spark.read.text(path).where("value <> ''").withColumnRenamed("value", "expr")
