"""YAML decoded into fixed shapes: scalars keep their source text, nulls are empty, unknown keys are ignored."""

from __future__ import annotations

import contextlib
import gc

import yaml


class ShapeError(ValueError):
    """The document is not of the shape that is asked for."""


_Base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
_TAGS = ("tag:yaml.org,2002:null", "tag:yaml.org,2002:merge")


class _Loader(_Base):
    """libyaml's parser where it is there: a tenth of the time. Scalars keep their text, so that null and merge are all that is resolved."""

    yaml_implicit_resolvers = {first: [x for x in each if x[0] in _TAGS] for first, each in _Base.yaml_implicit_resolvers.items()}

    def descend_resolver(self, node, index) -> None:
        """There are no resolvers by path."""

    def ascend_resolver(self) -> None:
        pass


@contextlib.contextmanager
def uncollected():
    """No garbage collection: a tree of nodes has no cycles, but while it grows it is searched for them again and again, longer each time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def load(text: str):
    """Nested dicts, lists and strings of the first document; None if it is empty. Raises ShapeError or yaml.YAMLError."""
    with uncollected():
        node = next(iter(yaml.compose_all(text, Loader=_Loader)), None)
        return None if node is None else _plain(node, 0)


def _plain(node: yaml.Node, depth: int):
    if depth > 200:
        raise ShapeError("nested too deeply")
    if isinstance(node, yaml.ScalarNode):
        return "" if node.tag == "tag:yaml.org,2002:null" else node.value
    if isinstance(node, yaml.SequenceNode):
        return [_plain(n, depth + 1) for n in node.value]
    own: dict[str, object] = {}
    merged: dict[str, object] = {}
    for k, v in node.value:
        if not isinstance(k, yaml.ScalarNode):
            raise ShapeError("a key must be a scalar")
        if k.tag == "tag:yaml.org,2002:merge":
            for part in v.value if isinstance(v, yaml.SequenceNode) else [v]:
                got = _plain(part, depth + 1)
                if not isinstance(got, dict):
                    raise ShapeError("map merge requires map or sequence of maps as the value")
                merged = got | merged
            continue
        if k.value in own:
            raise ShapeError(f"mapping key {k.value!r} already defined")
        own[k.value] = _plain(v, depth + 1)
    return merged | own


def text(x, what: str) -> str:
    if x is None:
        return ""
    if not isinstance(x, str):
        raise ShapeError(f"{what} must be a scalar")
    return x


def items(x, what: str) -> list:
    if x in (None, ""):
        return []
    if not isinstance(x, list):
        raise ShapeError(f"{what} must be a sequence")
    return x


def mapping(x, what: str) -> dict:
    if x in (None, ""):
        return {}
    if not isinstance(x, dict):
        raise ShapeError(f"{what} must be a mapping")
    return x


def text_map(x, what: str) -> dict[str, str]:
    return {k: text(v, f"{what}.{k}") for k, v in mapping(x, what).items()}


def rule_groups(content: str) -> list[dict]:
    """Groups of a rule file: name, interval, rules; of a rule: record, alert, expr, for, labels, annotations."""
    out = []
    for g in items(mapping(load(content), "document").get("groups"), "groups"):
        g = mapping(g, "group")
        rules = []
        for r in items(g.get("rules"), "rules"):
            r = mapping(r, "rule")
            rules.append({k: text(r.get(k), k) for k in ("record", "alert", "expr", "for")} | {k: text_map(r.get(k), k) for k in ("labels", "annotations")})
        out.append({"name": text(g.get("name"), "name"), "interval": text(g.get("interval"), "interval"), "rules": rules})
    return out
