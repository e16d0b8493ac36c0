"""Lint: structural checks over the table of rules, whichever language they are in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalens.functions import rules as R
from signalens.operators import findings as f
from signalens.operators import tables


@dataclass(frozen=True)
class Config:
    """What is checked. for_lt_interval: off, warn or error; anything else counts as warn."""

    require_severity: bool = True
    require_annotations: tuple[str, ...] = ("summary", "description")
    for_lt_interval: str = "warn"
    duplicate_alerts: bool = True
    empty_expr: bool = True

    @property
    def is_zero(self) -> bool:
        return not (self.require_severity or self.require_annotations or self.for_lt_interval or self.duplicate_alerts or self.empty_expr)


ZERO = Config(False, (), "", False, False)
FOUND = "array<struct<code:string,severity:string,message:string,label:string,seq:bigint>>"


def lint(rules: DataFrame, config: Config = Config()) -> list[DataFrame]:
    """Findings of all checks, in one pass over the rules. rules: as made by sources.documents.rule_table; rows without a rule are
    left out.

    Duplicates are every alert after the first of its name, with the place of the first: metric rules before log rules, then in
    order of file, group and rule. For them what the pass found is a table, so that rules are not decoded again.
    """
    if config.is_zero:
        config = Config()
    r, alert, found = rules.where("rule_pos is not null"), F.col("alert") != "", []

    def add(when, code: str, severity: str, message, label=None) -> None:
        found.append(F.when(when, F.struct(F.lit(f.CODES[code]).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(label or "").alias("label"), F.lit(0).cast("long").alias("seq"))))

    if config.empty_expr:
        add(R.stripped(F.col("expr")) == "", "empty", "warning", F.lit("rule expression is empty"))
    if config.require_severity:
        add(alert & (R.stripped(F.col("labels")["severity"]) == ""), "severity", "error", F.lit("alert is missing required label `severity`"))
    for key in config.require_annotations:
        add(alert & (R.stripped(F.col("annotations")[key]) == ""), "annotation", "error", F.lit(f"alert is missing required annotation `{key}`"), key)
    if config.for_lt_interval != "off":
        r = r.withColumn("for_ms", R.duration_ms(F.col("for"))).withColumn("interval_ms", R.duration_ms(F.col("interval")))
        msg = F.concat(F.lit("alert `for` ("), "for", F.lit(") is less than group `interval` ("), R.duration_text(F.col("interval_ms")), F.lit(")"))
        add(alert & (F.col("for_ms") < F.col("interval_ms")), "for", "error" if config.for_lt_interval == "error" else "warning", msg)
    own = F.array_compact(F.array(*found)) if found else F.array().cast(FOUND)
    each = r.select("path", "group", "rule", "alert", "kind", "file_pos", "group_pos", "rule_pos", own.alias("own"))
    made = lambda x: f.make(x, F.col("code"), "lint", F.col("message"), severity=F.col("severity"), group="group", rule="rule", label="label", seq="seq")
    if config.duplicate_alerts:
        each = tables.written(each, "lint")
    rows = [made(each.select("path", "group", "rule", F.explode("own").alias("x")).select("path", "group", "rule", "x.*"))]
    return rows + [made(duplicates(each))] if config.duplicate_alerts else rows


def duplicates(rules: DataFrame) -> DataFrame:
    """What is to be said of every alert after the first of its name. The first of each name is an aggregate that starts before the
    shuffle, and goes back by a join of which adaptive execution splits a hot name: no task sees all rules of a name."""
    at = F.struct(F.when(F.col("kind") == "promql", 0).otherwise(1).alias("of"), "file_pos", "group_pos", "rule_pos")
    place = F.when(F.col("group") != "", F.concat("path", F.lit(":"), "group")).otherwise(F.col("path"))
    named = rules.where("alert <> ''").select("path", "group", "rule", "alert", at.alias("at"), place.alias("place"))
    first = named.groupBy("alert").agg(F.min(F.struct("at", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("alert", "first")
    again = named.join(first, "alert").where(F.col("at") > F.col("first.at"))
    message = F.concat(F.lit("alert name `"), "alert", F.lit("` is also defined at "), "first.place")
    seq = F.shiftleft(F.col("at.group_pos").cast("long"), 32) + F.col("at.rule_pos")
    return again.select("path", "group", "rule", F.lit(f.CODES["duplicate"]).alias("code"), F.lit("error").alias("severity"), message.alias("message"), F.lit("").alias("label"), seq.alias("seq"))
