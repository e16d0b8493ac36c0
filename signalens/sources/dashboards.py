"""Dashboard JSON decoded into flat rows of panels, targets and variables."""

from __future__ import annotations

import json

from signalens.sources.yaml_docs import uncollected


class DashboardError(ValueError):
    """The document is not a dashboard."""


def _get(d: dict, key: str):
    """A value by its key, in any letter case if the exact one is missing."""
    if key in d:
        return d[key]
    return next((v for k, v in d.items() if k.lower() == key.lower()), None)


def _typed(d: dict, key: str, kind: type, empty):
    v = _get(d, key)
    if v is None:
        return empty
    if kind is int and isinstance(v, float) and v.is_integer() or not isinstance(v, kind) or kind is int and isinstance(v, bool):
        raise DashboardError(f"field {key} must be {kind.__name__}, not {type(v).__name__}")
    return v


def _objects(d: dict, key: str) -> list[dict]:
    out = []
    for x in _typed(d, key, list, []):
        if x is not None and not isinstance(x, dict):
            raise DashboardError(f"field {key} must hold objects")
        out.append(x or {})
    return out


def datasource_type(raw) -> str:
    """A string is itself, an object its type; lower case."""
    if isinstance(raw, dict):
        raw = _get(raw, "type")
    return raw.lower() if isinstance(raw, str) else ""


def variable_query(raw) -> str:
    if isinstance(raw, dict):
        raw = _get(raw, "query")
    return raw if isinstance(raw, str) else ""


def _no_constant(name: str):
    raise DashboardError(f"{name} is not JSON")


def decode(content: str) -> dict:
    """title, uid, panels (rows flattened, in order; each with its targets) and variables. A wrong type anywhere in the fields
    that are read fails the whole document."""
    try:
        with uncollected():
            doc = json.loads(content, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise DashboardError(str(e)) from None
    if doc is not None and not isinstance(doc, dict):
        raise DashboardError("a dashboard must be an object")
    doc = doc or {}
    panels: list[dict] = []

    def walk(raw: list[dict], outer: str, keep: bool) -> None:
        for p in raw:
            own = datasource_type(_get(p, "datasource")) or outer
            ident, title, kind = _typed(p, "id", int, 0), _typed(p, "title", str, ""), _typed(p, "type", str, "")
            inner, targets = _objects(p, "panels"), []
            for t in _objects(p, "targets"):
                ref, expr, query = _typed(t, "refId", str, ""), _typed(t, "expr", str, ""), _typed(t, "query", str, "")
                if expr or query:
                    targets.append({"ref_id": ref, "datasource": datasource_type(_get(t, "datasource")) or own, "expr": expr or query})
            is_row = kind == "row"
            if keep and not is_row:
                panels.append({"id": ident, "title": title, "type": kind, "datasource": own, "targets": targets})
            walk(inner, own, keep and is_row)

    walk(_objects(doc, "panels"), "", True)
    templating = _typed(doc, "templating", dict, {})
    variables = []
    for v in _objects(templating, "list"):
        name, kind, query = _typed(v, "name", str, ""), _typed(v, "type", str, ""), variable_query(_get(v, "query"))
        if kind in ("", "query") and query:
            variables.append({"name": name, "type": kind, "datasource": datasource_type(_get(v, "datasource")), "query": query})
    return {"title": _typed(doc, "title", str, ""), "uid": _typed(doc, "uid", str, ""), "panels": panels, "variables": variables}
