"""Mixing sources to target weights.

Tokens are runs of characters other than ASCII white space. One scan adds up the tokens of each source; from them and
the weights comes each source's repetition rate; a second scan emits the copies. No text is shuffled unless there are
so many sources that their rates cannot be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalens.llm import _io

TOKEN = r"[^ \t\n\r\f\x0B]+"


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, target_tokens: int | None = None, *, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, n_tokens, rate): how often each source's documents are to be repeated.

    rate = weight x target tokens / (sum of the weights of sources that have tokens x the source's tokens). Sources without
    a weight get ``default_weight``; the target defaults to the tokens there are. A null source is a source of its own. A
    null text has no tokens. A source without tokens has rate 0: nothing can bring it to its share. If all weights are zero,
    so are all rates. Weights that are negative or not finite raise ValueError.
    """
    if bad := {k: w for k, w in {**weights, "(default)": default_weight}.items() if not 0 <= w < float("inf")}:
        raise ValueError(f"weights must be finite and not negative: {bad}")
    per = docs.select(_io.column(docs, source_col).alias("source"), F.coalesce(F.regexp_count(_io.column(docs, text_col), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("n_tokens"))
    known = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else None
    weight = F.lit(float(default_weight)) if known is None else F.coalesce(F.try_element_at(known, F.coalesce("source", F.lit(""))), F.lit(float(default_weight)))
    per = per.withColumn("weight", F.when(F.col("n_tokens") > 0, F.when(F.col("source").isNull(), F.lit(float(default_weight))).otherwise(weight)).otherwise(0.0))
    total = per.agg(F.sum("weight").alias("weights"), F.sum("n_tokens").alias("tokens"))
    target = F.col("tokens") if target_tokens is None else F.lit(int(target_tokens))
    rate = F.when((F.col("n_tokens") > 0) & (F.col("weights") > 0), F.col("weight") * target.cast("double") / (F.col("weights") * F.col("n_tokens"))).otherwise(0.0)
    return per.crossJoin(total).select("source", "n_tokens", rate.alias("rate"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on nothing but the key and the seed (52 bits of MD5)."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


@_io.tidy
def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, target_tokens: int | None = None, seed: int = 17, *, copy_col: str | None = "copy", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", broadcast_bytes: int = _io.BROADCAST_BYTES) -> DataFrame:
    """Each document floor(rate) times, and once more with a probability of the rate's fraction.

    The draw is a hash of the identifier and the seed, so a rerun or a lost executor changes nothing and repeated rows are
    repeated alike; where the identifier is null it is a hash of the text. Columns are those of docs plus ``copy_col`` (1,
    2, ... within a document; an input column of that name is replaced; None: no such column). Null and empty texts count
    no tokens and follow the rate of their source. An empty table, and weights that are all zero, give no rows.
    """
    rates = _io.written(source_rates(docs, weights, default_weight, target_tokens, source_col=source_col, text_col=text_col), "rates").select(F.col("source").alias("_s"), F.col("rate").alias("_r"))
    if _io.is_small(rates, broadcast_bytes):
        rates = F.broadcast(rates)
    key = F.coalesce(_io.column(docs, id_col).cast("string"), F.md5(F.coalesce(_io.column(docs, text_col), F.lit(""))))
    kept = [c for c in docs.columns if copy_col is None or c.lower() != copy_col.lower()]
    d = docs.select(F.struct(*[_io.column(docs, c).alias(c) for c in kept]).alias("_d"), uniform(key, seed).alias("_u"), _io.column(docs, source_col).alias("_src"))
    whole = F.floor("_r")
    n = (whole + F.when(F.col("_u") < F.col("_r") - whole, 1).otherwise(0)).cast("int")
    out = d.join(rates, F.col("_src").eqNullSafe(F.col("_s"))).withColumn("_n", n).where("_n > 0").select("_d", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_c"))
    return out.select("_d.*", *([F.col("_c").alias(copy_col)] if copy_col else []))
