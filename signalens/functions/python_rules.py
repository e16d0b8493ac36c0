"""The rules of dashboards in Python, for single documents on the driver; functions.rules has them as Spark expressions, and tests
hold one against the other."""

from __future__ import annotations

import re

from signalens.functions import rules as R

_INTERVAL = re.compile(R.INTERVAL_PATTERN, re.ASCII)
_VARIABLES = [re.compile(p.replace(r"\p{Alpha}", "A-Za-z"), re.ASCII) for p in R.VARIABLE_PATTERNS]


def language(datasource: str, expr: str) -> str:
    """promql or logql: by the data source, else by how the expression begins."""
    if "prometheus" in datasource or "mimir" in datasource:
        return "promql"
    if "loki" in datasource:
        return "logql"
    return "logql" if expr.lstrip(" \t\r\n").startswith("{") else "promql"


def normalised(expr: str) -> str:
    out = _INTERVAL.sub(R.INTERVAL, expr)
    for p in _VARIABLES:
        out = p.sub(R.VARIABLE, out)
    return out


def variables(expr: str) -> list[str]:
    left, names = _INTERVAL.sub(R.INTERVAL, expr), set()
    for p in _VARIABLES:
        names |= set(p.findall(left))
        left = p.sub(R.VARIABLE, left)
    return sorted(names - set(R.RESERVED))
