"""URL filters by a sort-merge range join.

A URL's canonical key is its host's labels in reverse order, each followed by a dot, then path and query. A rule is a
host, with all hosts below it, or a host and the start of a path; either is a prefix of keys, that is an interval. Keys
and intervals are cut into the same ranges, each range is sorted, and one sweep keeps the stack of rules that are open;
intervals of prefixes are nested or apart, so the top of the stack is the most specific rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalens.llm import _io

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^#]*)"
LAST = "\U0010ffff"
#: About how many keys are drawn to place the cuts between ranges. They decide how even ranges are, never what matches.
CUT_SAMPLE = 20_000


def url_key(url: Column) -> Column:
    """The canonical key; null if there is no host."""
    host = F.rtrim(F.lower(F.regexp_extract(url, URL, 1)), F.lit("."))
    rest = F.regexp_extract(url, URL, 2)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."), path))


def rule_key(pattern: str | None) -> str | None:
    """The prefix of a rule, "host" or "host/path"; None if it is null or has no host."""
    host, slash, path = (pattern or "").strip().partition("/")
    host = host.lower().rstrip(".")
    return ".".join(reversed(host.split("."))) + "." + slash + path if host else None


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, rule, action) of rules (pattern, action, position): of the same key the rule of the least position, of equal ones that of
    the least pattern and action, nulls last."""
    trimmed = F.trim("pattern", F.lit(" \t\n\r\f\x0B"))
    at = F.locate("/", trimmed)
    host = F.rtrim(F.lower(F.when(at > 0, F.substring(trimmed, F.lit(1), at - 1)).otherwise(trimmed)), F.lit("."))
    path = F.when(at > 0, F.substring(trimmed, at, F.length(trimmed))).otherwise("")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."), path)
    named = rules.where("pattern is not null").select(F.when(host != "", key).alias("key"), "position", F.col("pattern").alias("rule"), F.col("action").isNull().alias("no"), "action").where("key is not null")
    first = named.groupBy("key").agg(F.min(F.struct("position", "rule", "no", "action")).alias("r"))
    return first.select("key", "r.rule", "r.action")


def _ranges(cuts: np.ndarray):
    """A function of columns: for each key the first and the last of the ranges that it may lie in. Where a cut is drawn more than once,
    its key may lie in all ranges between."""

    def run(low: pa.Array, high: pa.Array) -> pa.Array:
        find = lambda c, side: np.searchsorted(cuts.value, c.to_numpy(zero_copy_only=False).astype(object), side).astype(np.int32) if len(cuts.value) else np.zeros(len(c), np.int32)
        return pa.StructArray.from_arrays([pa.array(find(low, "left")), pa.array(find(high, "right"))], names=["lo", "hi"])

    run.__annotations__ = {"low": pa.Array, "high": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "lo int, hi int")


def classify(pages: DataFrame, rules: DataFrame | list[tuple[str | None, str | None]], *, id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """Of every page: id, url, rule (the most specific that holds), action (that rule's) and n_rules (how many hold).

    rules: a table (pattern, action, and position if there is one) of any size, or a list of (pattern, action). Of the same
    pattern the first counts (least position; without one, the least pattern and action), and patterns that are null or
    without a host are left out. Where no rule holds, or a URL is null or has no host, rule and action are null and n_rules is
    0; such URLs are not shuffled. Repeated rows and null ids are kept; other columns of pages play no part. Pages of one URL
    that many have are spread over as many ranges as its share of the draw.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(p, a, i) for i, (p, a) in enumerate(rules)], "pattern string, action string, position long")
    named = rule_keys(rules if "position" in rules.columns else rules.withColumn("position", F.lit(0)))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.schema[id_col].dataType.simpleString()
    p = pages.select(_io.column(pages, id_col).alias("id"), _io.column(pages, url_col).alias("url")).withColumn("key", url_key(F.col("url")))
    share = min(1.0, CUT_SAMPLE / max(1, p.count()))
    salt = F.xxhash64("key", "id")
    drawn = sorted(r[0] for r in p.where("key is not null").where(F.pmod(salt, F.lit(1 << 30)) < int(share * (1 << 30))).select("key").collect()) if n > 1 else []
    cuts = np.array([drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else [], dtype=object)
    where = _ranges(spark.sparkContext.broadcast(cuts))
    none = F.lit(None).cast("string")
    r = named.withColumn("at", where("key", F.concat("key", F.lit(LAST)))).select(F.explode(F.sequence("at.lo", "at.hi")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), none.alias("url"), "rule", "action")
    q = p.where("key is not null").withColumn("at", where("key", "key"))
    q = q.select((F.col("at.lo") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("at.hi") - F.col("at.lo") + 1)).cast("int").alias("part"), "key", F.lit(1).alias("kind"), "id", "url", none.alias("rule"), none.alias("action"))
    s = r.unionByName(q).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] = []
        for b in batches:
            rule, action, depth = [], [], []
            for key, kd, rl, ac in zip(*(b.column(c).to_pylist() for c in ("key", "kind", "rule", "action")), strict=True):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kd == 0:
                    stack.append((key, rl, ac))
                    continue
                top = stack[-1] if stack else (None, None, None)
                rule.append(top[1])
                action.append(top[2])
                depth.append(len(stack))
            got = b.filter(pc.equal(b.column("kind"), 1))
            yield pa.RecordBatch.from_arrays([got.column("id"), got.column("url"), pa.array(rule, pa.string()), pa.array(action, pa.string()), pa.array(depth, pa.int64())], names=["id", "url", "rule", "action", "n_rules"])

    swept = s.mapInArrow(sweep, f"id {kind}, url string, rule string, action string, n_rules long")
    apart = p.where("key is null").select("id", "url", none.alias("rule"), none.alias("action"), F.lit(0).cast("long").alias("n_rules"))
    return swept.unionByName(apart).withColumnRenamed("id", id_col)


def rules_sql(rules: list[tuple[str, str]], table: str = "pages") -> str:
    """classify() by a nested loop, for DuckDB."""
    seen: dict[str, tuple[str, str]] = {}
    for pattern, action in rules:
        if (k := rule_key(pattern)) is not None:
            seen.setdefault(k, (pattern, action))
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(k)}, {q(p)}, {q(a)})" for k, (p, a) in seen.items())
    return f"""
WITH r(prefix, rule, action) AS (VALUES {values}),
h AS (SELECT page_id, url, rtrim(lower(regexp_extract(url, '{URL}', 1)), '.') AS host, regexp_extract(url, '{URL}', 2) AS rest FROM {table}),
k AS (SELECT page_id, url, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), '.') || '.' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS key FROM h)
SELECT k.page_id, k.url, arg_max(r.rule, length(r.prefix)) AS rule, arg_max(r.action, length(r.prefix)) AS action, count(r.prefix) AS n_rules
FROM k LEFT JOIN r ON starts_with(k.key, r.prefix) GROUP BY k.page_id, k.url, k.key"""
