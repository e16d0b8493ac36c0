"""Validation of a corpus: scan, extract, lint, check, sort."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalens.operators import checks, lint
from signalens.operators import findings as f
from signalens.operators.tables import written
from signalens.sources import documents as docs
from signalens.sources.allowlist import Allowlist
from signalens.sources.catalog import Catalog, Tables


@dataclass
class Inputs:
    prometheus_rules: list[str] = field(default_factory=list)
    loki_rules: list[str] = field(default_factory=list)
    dashboards: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.prometheus_rules or self.loki_rules or self.dashboards)


@dataclass
class Settings:
    """lint: None leaves linting out (parse errors are reported all the same); catalog: None leaves checks out."""

    lint: lint.Config | None = field(default_factory=lint.Config)
    catalog: Catalog | Tables | None = None
    allow: Allowlist = field(default_factory=Allowlist)
    skip_dashboard_vars: bool = False


@dataclass
class Result:
    findings: DataFrame
    files_scanned: int
    files_by_kind: dict[str, int]


def parse_findings(rules: DataFrame, items: DataFrame) -> list[DataFrame]:
    """E001 to E004: files that cannot be read or decoded, expressions that do not parse."""
    at = {"group": "group", "rule": "rule"}
    bad = rules.where("file_error is not null")
    prom, log = rules.where("prom.error is not null"), rules.where("log.error is not null")
    d_bad, d_open = items.where("item = 'invalid'"), items.where("item = 'unreadable'")
    say = lambda who, c: F.concat(F.lit(f"{who} parse error: "), F.col(c))
    return [
        f.make(bad, f.CODES["yaml"], "parse", F.col("file_error")),
        f.make(d_open, f.CODES["yaml"], "parse", F.col("file_error")),
        f.make(d_bad, f.CODES["json"], "parse", F.col("file_error")),
        f.make(prom, f.CODES["promql"], "parse", say("PromQL", "prom.error"), **at),
        f.make(log, f.CODES["logql"], "parse", say("LogQL", "log.error"), **at),
        f.make(items.where("prom.error is not null"), f.CODES["promql"], "parse", say("promql", "prom.error"), panel="panel"),
        f.make(items.where("log.error is not null"), f.CODES["logql"], "parse", say("logql", "log.error"), panel="panel"),
    ]


def extracted(rules: DataFrame, items: DataFrame, lang: str) -> DataFrame:
    """(path, group, rule, panel, expr, r) of all expressions of a language that parse."""
    col = "prom" if lang == "promql" else "log"
    none = F.lit("")
    a = rules.where(f"{col} is not null and {col}.error is null").select("path", "group", "rule", none.alias("panel"), F.col(f"{col}.expr").alias("expr"), F.col(col).alias("r"))
    b = items.where(f"{col} is not null and {col}.error is null").select("path", none.alias("group"), none.alias("rule"), "panel", F.col(f"{col}.expr").alias("expr"), F.col(col).alias("r"))
    return a.unionByName(b)


def validate(spark: SparkSession, inputs: Inputs, settings: Settings | None = None) -> Result:
    """One full pass. Documents are read and parsed once: rules and items are written for the several checks that use them."""
    settings = settings or Settings()
    paths = docs.path_table(spark, inputs.prometheus_rules, inputs.loki_rules, inputs.dashboards)
    files = docs.contents(paths)
    rules, items = written(docs.rule_table(files), "rules"), written(docs.dashboard_table(files), "items")
    parts = parse_findings(rules, items)
    if settings.lint is not None:
        parts += lint.lint(rules, settings.lint)
    if settings.catalog is not None:
        prom, log = extracted(rules, items, "promql"), extracted(rules, items, "logql")
        tables = settings.catalog
        if isinstance(tables, Catalog):
            m, s = checks.asked(prom, "promql")
            _, st = checks.asked(log, "logql")
            tables = tables.snapshot(spark, checks.work_list(m, s, st))
        if not prom.isEmpty():
            parts += checks.check_promql(prom, tables, settings.allow, skip_variables=settings.skip_dashboard_vars)
        if not log.isEmpty():
            parts += checks.check_logql(log, tables, settings.allow, skip_variables=settings.skip_dashboard_vars)
    n = {r.kind: r.n for r in f.files_by_kind(paths).collect()}
    return Result(f.ordered(f.union(spark, parts)), sum(n.values()), n)
