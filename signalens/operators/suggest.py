"""Nearest names: for each unknown name up to k names of a corpus within an edit distance, nearest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalens.functions import rules as R

MOST, DISTANCE = 3, 3


def ranked(unknown: DataFrame, corpus: DataFrame, on: list[str] = (), k: int = MOST, distance: int = DISTANCE) -> DataFrame:
    """(on..., query, name, dist, rank): unknown(on..., query) against corpus(on..., name), by distance in bytes, then by name.

    Queries are made distinct first. Byte lengths are compared before distances, and both sides are joined by length, so
    that only names whose lengths differ by at most the distance meet. Names that a corpus repeats are repeated.
    """
    distance = max(0, distance)
    if k <= 0:
        k = 0
    on = list(on)
    q = unknown.where("query <> ''").select(*on, "query").distinct().withColumn("size", F.explode(F.sequence(F.octet_length("query") - distance, F.octet_length("query") + distance)))
    c = corpus.select(*on, "name").withColumn("size", F.octet_length("name"))
    near = q.join(c, [*on, "size"]).withColumn("dist", R.byte_distance(F.col("query"), F.col("name"), distance)).where("dist >= 0")
    w = Window.partitionBy(*on, "query").orderBy("dist", "name")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*on, "query", "name", "dist", "rank")


def attach(unknown: DataFrame, corpus: DataFrame, on: list[str] = (), k: int = MOST, distance: int = DISTANCE) -> DataFrame:
    """unknown with the column suggestions: names in order, null where there are none."""
    on = list(on)
    best = ranked(unknown, corpus, on, k, distance).groupBy(*on, "query").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("s")).select(*on, "query", F.col("s.name").alias("suggestions"))
    return unknown.join(best, [*on, "query"], "left")
