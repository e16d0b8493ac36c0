"""The three parsers as Arrow UDFs for the DataFrame API and SQL.

A parser runs in batches beside the JVM. Within a batch an expression that comes again is not parsed again; within a worker, what
differs in plain values alone is parsed once (signalens.lang.shapes). What a worker remembers is bounded, whatever passes through it.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from signalens.lang import logql, promql, shapes, traceql
from signalens.lang.lexing import ParseError

PROMQL = "expr string, metricRefs array<string>, selectors array<struct<metric:string,label:string,op:string,value:string>>, atModifiers array<double>, functions array<string>, error string"
LOGQL = "expr string, streamSelectors array<struct<label:string,op:string,value:string>>, lineFilters array<struct<op:string,match:string>>, labelFilters array<string>, parsers array<string>, functions array<string>, error string"
TRACEQL = "expr string, attributes array<struct<scope:string,parent:boolean,name:string>>, intrinsics array<string>, functions array<string>, error string"
_FIELDS = {
    "promql": (promql.extract, {"metricRefs": None, "selectors": ("metric", "label", "op", "value"), "atModifiers": None, "functions": None}),
    "logql": (logql.extract, {"streamSelectors": ("label", "op", "value"), "lineFilters": ("op", "match"), "labelFilters": None, "parsers": None, "functions": None}),
    "traceql": (traceql.extract, {"attributes": ("scope", "parent", "name"), "intrinsics": None, "functions": None}),
}
SCHEMAS = {"promql": PROMQL, "logql": LOGQL, "traceql": TRACEQL}


#: Expressions that are turned into rows of an Arrow array at once.
AT_ONCE = 2000


def _found(lang: str, expr: str | None) -> tuple[dict | None, str | None]:
    """What an expression refers to, or why it does not parse."""
    try:
        return shapes.extract(lang, _FIELDS[lang][0], expr or ""), None
    except ParseError as e:
        return None, str(e)
    except RecursionError:
        return None, "parse: nested too deeply"


def extract_row(lang: str, expr: str | None) -> tuple:
    """(expr, one value a field, error): lists are null where the expression does not parse."""
    fields, (got, error) = _FIELDS[lang][1], _found(lang, expr)
    if got is None:
        return (expr or "", *[None] * len(fields), error)
    return (expr, *[list(got[f]) if names is None else [dict(zip(names, x, strict=True)) for x in got[f]] for f, names in fields.items()], None)


def _fields(lang: str) -> list[pa.Field]:
    kinds = {"parent": pa.bool_()}
    out = [pa.field("expr", pa.string())]
    for name, parts in _FIELDS[lang][1].items():
        item = pa.struct([(p, kinds.get(p, pa.string())) for p in parts]) if parts else pa.float64() if name == "atModifiers" else pa.string()
        out.append(pa.field(name, pa.list_(item)))
    return [*out, pa.field("error", pa.string())]


def _lists(lists: list[list | None], kind: pa.ListType) -> pa.Array:
    """An array of lists, of structs given as tuples too, made of flat columns."""
    flat, item = [x for each in lists if each for x in each], kind.value_type
    if pa.types.is_struct(item):
        columns = zip(*flat, strict=True) if flat else [()] * item.num_fields
        values = pa.StructArray.from_arrays([pa.array(c, item[i].type) for i, c in enumerate(columns)], fields=list(item))
    else:
        values = pa.array(flat, item)
    offsets = [0, *accumulate(len(each or ()) for each in lists)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind, mask=pa.array([each is None for each in lists], pa.bool_()))


def _rows(lang: str, exprs: list[str | None]) -> pa.Array:
    fields, found = _fields(lang), [_found(lang, e) for e in exprs]
    lists = [_lists([got and got[f.name] for got, _ in found], f.type) for f in fields[1:-1]]
    return pa.StructArray.from_arrays([pa.array([e or "" for e in exprs], pa.string()), *lists, pa.array([error for _, error in found], pa.string())], fields=fields)


def _batch(lang: str, exprs: pa.Array) -> pa.Array:
    """Results of distinct expressions, put in the places of all of them."""
    each = exprs.dictionary_encode(null_encoding="encode")
    distinct = pa.concat_arrays([_rows(lang, each.dictionary[at : at + AT_ONCE].to_pylist()) for at in range(0, max(1, len(each.dictionary)), AT_ONCE)])
    return distinct if len(distinct) == len(exprs) else distinct.take(each.indices)


@lru_cache(maxsize=3)
def _udf(lang: str):
    """Made when first used: workers import this module without a session. Parsers are deterministic, but Catalyst must not take them
    so: it would put the filter that comes with an explode below the projection, and with it a second pass of the parser."""

    def run(expr: pa.Array) -> pa.Array:
        return _batch(lang, expr)

    run.__annotations__ = {"expr": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, SCHEMAS[lang]).asNondeterministic()


def promql_extract(expr: Column | str) -> Column:
    return _udf("promql")(expr)


def logql_extract(expr: Column | str) -> Column:
    return _udf("logql")(expr)


def traceql_extract(expr: Column | str) -> Column:
    return _udf("traceql")(expr)


class promql_selectors:
    """The label matchers of one PromQL expression, a row each; none if it does not parse."""

    def eval(self, expr: str):
        for s in extract_row("promql", expr)[2] or []:
            yield s["metric"], s["label"], s["op"], s["value"]


def register(spark: SparkSession) -> None:
    """promql_extract, logql_extract, traceql_extract and the table function promql_selectors, for SQL."""
    for lang in SCHEMAS:
        spark.udf.register(f"{lang}_extract", _udf(lang))
    spark.udtf.register("promql_selectors", F.udtf(promql_selectors, returnType="metric string, label string, op string, value string"))
