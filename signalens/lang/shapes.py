"""Expressions that differ in plain values alone are parsed once a shape.

A shape is an expression with holes: string literals of letters, digits and signs that no regular expression gives a meaning, whole
numbers after a comparison, and in TraceQL digits at the end of names. No parser decides by such a value, so what it finds in the
shape, with the values in the holes, is what it finds in the expression. Anything else stays in the shape; an expression that may
hold comments, escapes or other quotes is parsed as it is, and so is one whose shape does not parse, for the text of the error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import count

from signalens.lang.lexing import ParseError

#: What stands in the shape for the value of a hole, which is counted by the last three digits: a number, a name and a string alike.
_MARK, _MOST = "9007190000", 999
_HOLE = re.compile(_MARK + r"(\d{3})")
_OTHER = re.compile(r"[\\`'#]|//|/\*|" + _MARK)
_WORD = r"[A-Za-z0-9.:/ -][A-Za-z0-9_.:/ -]*"
_STRING = rf'"({_WORD}(?:\|{_WORD})*)"|"[^"]*"'
_NUMBER = r"(?<=[=<>])([1-9][0-9]{0,14})(?![\w.])|(?<=[=<>] )([1-9][0-9]{0,14})(?![\w.])"
_VALUES = {"promql": re.compile(_STRING), "logql": re.compile(f"{_STRING}|{_NUMBER}"), "traceql": re.compile(rf"{_STRING}|{_NUMBER}|(?<=[A-Za-z_])([0-9]+)(?=[\s){{}},])")}
#: Fields in which values of holes may come up -> whether repetitions stay.
_FILLED = {"metricRefs": False, "selectors": True, "streamSelectors": False, "lineFilters": True, "labelFilters": False, "attributes": False}
#: Shapes that a process remembers, and the longest of them: a few MB.
SHAPES, LONGEST = 1024, 2000


def shape_of(lang: str, expr: str) -> tuple[str, list[str]] | None:
    """An expression with marks in its holes, and the values of these; None where there are none or they cannot be told."""
    if len(expr) > LONGEST or _OTHER.search(expr):
        return None
    values: list[str] = []
    number = count()

    def mark(m: re.Match) -> str:
        if (i := m.lastindex) is None:
            return m[0]
        values.append(m[i])
        held = f"{_MARK}{next(number):03d}"
        return f'"{held}"' if i == 1 else held

    shape = _VALUES[lang].sub(mark, expr)
    return (shape, values) if 0 < len(values) <= _MOST else None


def _parts(text):
    """A text itself if it has no holes, the number of the hole that it is, or the pieces and holes in it."""
    if not isinstance(text, str) or _MARK not in text:
        return text, None
    pieces = _HOLE.split(text)
    if len(pieces) == 3 and not pieces[0] and not pieces[2]:
        return None, int(pieces[1])
    return None, tuple(int(p) if i % 2 else p for i, p in enumerate(pieces))


def _fill(part, values: list[str]):
    text, hole = part
    if hole is None:
        return text
    return values[hole] if isinstance(hole, int) else "".join([values[p] if isinstance(p, int) else p for p in hole])


@lru_cache(maxsize=SHAPES)
def _parsed(parse: Callable[[str], dict], shape: str) -> tuple[dict, list] | None:
    """What is found in a shape, and of the fields that have holes (name, whether rows are tuples, parts); None if it does not parse."""
    try:
        found = parse(shape)
    except (ParseError, RecursionError):
        return None
    open_fields = []
    for name in found:
        rows = found[name]
        if name in _FILLED and any(_MARK in x for row in rows for x in (row if isinstance(row, tuple) else (row,)) if isinstance(x, str)):
            whole = isinstance(rows[0], tuple)
            open_fields.append((name, whole, [[_parts(x) for x in row] if whole else _parts(row) for row in rows]))
    return found, open_fields


def _by_name(row: tuple) -> tuple:
    return row[0], row[2], row[1]


def extract(lang: str, parse: Callable[[str], dict], expr: str) -> dict:
    """parse(expr), by the shape of the expression where it has one. The lists are shared: callers don't change them."""
    held = shape_of(lang, expr)
    got = held and _parsed(parse, held[0])
    if not got:
        return parse(expr)
    found, open_fields = got
    if not open_fields:
        return found
    found, values = dict(found), held[1]
    for name, whole, rows in open_fields:
        filled = [tuple([_fill(p, values) for p in row]) for row in rows] if whole else [_fill(p, values) for p in rows]
        found[name] = sorted(filled if _FILLED[name] else set(filled), key=_by_name if name == "attributes" else None)
    return found
