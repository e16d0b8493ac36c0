"""Scalar rules as Spark expressions: blanks, patterns, distances, durations, dashboard rewrites, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVAL, VARIABLE = "5m", "__dashboard_var__"
_NAME = r"([\p{Alpha}_]\w*)"
INTERVAL_PATTERN = r"\$__(?:interval_ms|interval|range|rate_interval)\b"
#: [[name:format]], ${name:format} and $name, in the order in which they are replaced.
VARIABLE_PATTERNS = (*[start + r"\s*" + _NAME + rf"(?::[^\{end[-1]}]*)?\s*" + end for start, end in ((r"\[\[", r"\]\]"), (r"\$\{", r"\}"))], r"\$" + _NAME)
RESERVED = tuple("__" + n for n in "from interval interval_ms name org range rate_interval to user".split())


def stripped(c: Column) -> Column:
    """Without white space, of any Unicode kind, at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def matches_pattern(pattern: Column, s: Column) -> Column:
    """``*`` is everything, a star at the end a prefix, anything else the string itself."""
    return F.when(pattern == "*", True).when(pattern.endswith("*"), F.startswith(s, F.substring(pattern, F.lit(1), F.length(pattern) - 1))).otherwise(pattern == s)


def byte_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance in UTF-8 bytes; -1 beyond ``most``."""
    as_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b), most)


_UNITS = (("y", 31_536_000_000), ("w", 604_800_000), ("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1))
_DURATION = r"^(?:([0-9]+)y)?(?:([0-9]+)w)?(?:([0-9]+)d)?(?:([0-9]+)h)?(?:([0-9]+)m(?!s))?(?:([0-9]+)s)?(?:([0-9]+)ms)?$"


def duration_ms(c: Column) -> Column:
    """Milliseconds of a duration such as 1h30m or of 0; null if it is none. A zero before the digits makes units that are not
    given a number too: a cast that fails throws within, which costs more than all the rest of a row."""
    parts = [F.coalesce(F.concat(F.lit("0"), F.regexp_extract(c, _DURATION, i + 1)).try_cast("long"), F.lit(0)) * F.lit(ms) for i, (_, ms) in enumerate(_UNITS)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(c == "0", F.lit(0).cast("long")).when((c != "") & c.rlike(_DURATION), total)


def duration_text(ms: Column) -> Column:
    """The shortest exact spelling: 60000 becomes 1m."""
    size = dict(_UNITS)
    whole = lambda u: F.concat(F.floor(ms / size[u]).cast("string"), F.lit(u))
    left, parts = {"d": ms, "h": ms % size["d"], "m": ms % size["h"], "s": ms % size["m"], "ms": ms % size["s"]}, []
    for u, rest in left.items():
        n = F.floor(rest / size[u])
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise(""))
    return F.when(ms == 0, "0s").when(ms % size["y"] == 0, whole("y")).when(ms % size["w"] == 0, whole("w")).otherwise(F.concat(*parts))


_HIDDEN = r"[\p{C}\p{Z}&&[^ ]]"


def quoted(c: Column) -> Column:
    """A double-quoted literal: quotes and backslashes are escaped, and so are characters that cannot be seen, control characters of one
    byte as \\xNN, others as \\uNNNN or \\UNNNNNNNN."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v")):
        out = F.replace(out, F.lit(raw), F.lit(name))

    def each(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("long")
        digits = lambda n: F.lpad(F.lower(F.hex(code)), n, "0")
        return F.when(~ch.rlike(_HIDDEN), ch).when(code < 128, F.concat(F.lit("\\x"), digits(2))).when(code < 65536, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))

    hidden = F.array_join(F.transform(F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0)), each), "")
    return F.concat(F.lit('"'), F.when(out.rlike(_HIDDEN), hidden).otherwise(out), F.lit('"'))


def language_of(datasource: Column) -> Column:
    """promql or logql by what a lower-cased data source type contains, else unknown."""
    d = F.coalesce(datasource, F.lit(""))
    return F.when(d.contains("prometheus") | d.contains("mimir"), "promql").when(d.contains("loki"), "logql").otherwise("unknown")


def guessed_language(expr: Column) -> Column:
    """logql if the first character that is not blank is an opening brace, else promql."""
    return F.when(F.regexp_replace(F.coalesce(expr, F.lit("")), r"^[ \t\r\n]+", "").startswith("{"), "logql").otherwise("promql")


def normalised(expr: Column) -> Column:
    """Dashboard variables replaced by what a parser takes: intervals by 5m, others by a name."""
    out = F.regexp_replace(F.coalesce(expr, F.lit("")), INTERVAL_PATTERN, INTERVAL)
    for p in VARIABLE_PATTERNS:
        out = F.regexp_replace(out, p, VARIABLE)
    return out


def variables_in(expr: Column) -> Column:
    """Names of the variables in an expression, sorted, without repetitions and built-in ones."""
    left, names = F.regexp_replace(F.coalesce(expr, F.lit("")), INTERVAL_PATTERN, INTERVAL), []
    for p in VARIABLE_PATTERNS:
        names.append(F.regexp_extract_all(left, F.lit(p), F.lit(1)))
        left = F.regexp_replace(left, p, VARIABLE)
    return F.array_sort(F.array_except(F.array_distinct(F.concat(*names)), F.array(*[F.lit(r) for r in RESERVED])))


def cache_key(lang: Column, source: Column, query: Column) -> Column:
    return F.sha2(F.concat_ws("\n", lang, source, query), 256)


def is_fresh(fetched_ms: Column, ttl_seconds: Column, now_ms: Column) -> Column:
    """A lifetime of 0 or less never ends; at its very end an entry is still fresh."""
    return (ttl_seconds <= 0) | (now_ms - fetched_ms <= ttl_seconds * 1000)


def severity_of(code: Column) -> Column:
    return F.when(code.startswith("E"), "error").when(code.startswith("W"), "warning").otherwise("info")
