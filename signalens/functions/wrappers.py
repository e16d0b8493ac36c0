"""Dashboard variable queries: what is PromQL in label_values(...), query_result(...) and the like."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_call(text: str) -> tuple[str, list[str]] | None:
    """(name, arguments) if the text is one call and nothing else. Commas count only at the call's own depth, outside braces,
    brackets and quotes."""
    i = 0
    while i < len(text) and (text[i].isascii() and (text[i].isalpha() or text[i] == "_") or i and text[i].isascii() and text[i].isdigit()):
        i += 1
    head = text[:i]
    while i < len(text) and text[i] in " \t\r\n":
        i += 1
    if not head or i >= len(text) or text[i] != "(":
        return None
    depth, nested, quote, args, start = 1, 0, "", [], i + 1
    i += 1
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote != "`":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "{[":
            nested += 1
        elif c in "}]":
            nested -= 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                if text[i + 1 :].strip() or nested:
                    return None
                last = text[start:i]
                return head, args + [last] if args or last.strip() else []
        elif c == "," and depth == 1 and nested == 0:
            args.append(text[start:i])
            start = i + 1
        i += 1
    return None


def unwrap(query: str | None) -> str | None:
    """The PromQL within a variable's query; None if there is nothing to check."""
    call = split_call((query or "").strip())
    if call is None:
        return query
    name, args = call
    if name == "label_values":
        return args[0].strip() if len(args) >= 2 else None
    if name == "query_result":
        return args[0].strip() if args else None
    return None if name in ("metrics", "label_names") else query


@lru_cache(maxsize=1)
def _udf():
    def run(query: pd.Series) -> pd.Series:
        return query.map(unwrap)

    run.__annotations__ = {"query": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def unwrap_variable_query(query: Column | str) -> Column:
    return _udf()(query)
