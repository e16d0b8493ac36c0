"""Small tables with everything that is awkward in them."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())] + [T.StructField(n, T.StringType()) for n in ("id", "key", "copy", "shard", "_d", "_t", "th", "sid", "rate", "n", "a b`c")])
WORDS = "the river of time runs over old stones and under new bridges while birds sing in tall trees near green hills where people walk every morning before work starts again"


def prose(i: int, n: int = 60) -> str:
    w = WORDS.split()
    return " ".join(w[(i * 7 + k * (i + 3)) % len(w)] + (str((i * 31 + k) % 97) if k % 3 == 0 else "") for k in range(n))


def messy(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows, ties, a very long text, further columns with clashing names."""
    more = ["x"] * 11
    long = " ".join(prose(i, 200) for i in range(300))
    rows = [(1, prose(1), "en", "a"), (2, None, None, None), (None, prose(2), "en", "a"), (None, None, None, None), (3, "", "en", "b"), (4, " \n\t", "de", "b"), (5, prose(5), "fr", None), (5, prose(5), "fr", None), (6, prose(5), "fr", "c"), (7, long, "en", "c"), (8, "one", "xx", "a"), (-9, "§§ €€ 𝒳 \x00 ퟿ é", "en", "a")]
    return spark.createDataFrame([(*r, *more) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def long_text():
    return " ".join(prose(i, 200) for i in range(300))
