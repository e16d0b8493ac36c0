"""Allowlists: three small tables of patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from signalens.operators.tables import local
from signalens.sources import yaml_docs as Y


#: Patterns of an allowlist at most.
MOST = 100_000


@dataclass
class Allowlist:
    """(pattern, reason), (metric, label, reason) and (metric, label, value, reason); all but reasons are patterns."""

    metrics: list[tuple[str, str]] = field(default_factory=list)
    labels: list[tuple[str, str, str]] = field(default_factory=list)
    values: list[tuple[str, str, str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.check()

    def check(self) -> None:
        """Patterns go to all workers, so there is a bound to them."""
        if (n := len(self.metrics) + len(self.labels) + len(self.values)) > MOST:
            raise ValueError(f"{n} patterns are more than an allowlist may have ({MOST})")

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        self.check()
        return (
            local(spark, self.metrics, "metric_pat string, reason string"),
            local(spark, self.labels, "metric_pat string, label_pat string, reason string"),
            local(spark, self.values, "metric_pat string, label_pat string, value_pat string, reason string"),
        )


def parse(content: str | None) -> Allowlist:
    """An allowlist file; nothing or an empty document allows nothing. Entries without a pattern, metric or label are left out."""
    doc = Y.mapping(Y.load(content), "document") if content else {}
    out = Allowlist()
    for e in Y.items(doc.get("metrics"), "metrics"):
        e = Y.mapping(e, "entry")
        if p := Y.text(e.get("pattern"), "pattern"):
            out.metrics.append((p, Y.text(e.get("reason"), "reason")))
    for e in Y.items(doc.get("labels"), "labels"):
        e = Y.mapping(e, "entry")
        if m := Y.text(e.get("metric"), "metric"):
            out.labels += [(m, Y.text(p, "pattern"), Y.text(e.get("reason"), "reason")) for p in Y.items(e.get("patterns"), "patterns")]
    for e in Y.items(doc.get("label_values"), "label_values"):
        e = Y.mapping(e, "entry")
        m, lab = Y.text(e.get("metric"), "metric"), Y.text(e.get("label"), "label")
        if m and lab:
            out.values += [(m, lab, Y.text(p, "pattern"), Y.text(e.get("reason"), "reason")) for p in Y.items(e.get("patterns"), "patterns")]
    return out


def load(path: str | None) -> Allowlist:
    if not path:
        return Allowlist()
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
