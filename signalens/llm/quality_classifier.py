"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are Spark expressions. Trees are grown level by level on binned statistics of a bounded labelled sample,
by the gradients and curvatures of the logistic loss; then all trees are flattened into arrays, so that scoring a batch
takes one step per level for all rows and trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalens.llm import _io

#: Labelled rows that the trees are fitted to at most.
SAMPLE_ROWS = 6000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 60, 4, 64, 0.15, 1.0, 8
SPACE = r"[ \t\n\r\f\x0B]+"
STATISTICS = ("chars", "words", "word_length", "lines", "line_length", "repeated_lines", "distinct_words", "symbols", "punctuation", "digits", "capitals", "short_words", "bangs")


def statistics(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, list[Column]]:
    """docs packed into _d with the shared expressions beside it, and the statistics over those. Null counts as empty."""
    df = docs.select(F.struct(*[_io.column(docs, c).alias(c) for c in docs.columns]).alias("_d"), F.coalesce(_io.column(docs, text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_words", F.array_remove(F.split(F.col("_t"), SPACE), "")).withColumn("_lines", F.array_remove(F.split("_t", "\n"), "")).withColumn("_chars", F.length("_t") - _io.count_of(F.col("_t"), " \t\n\r\f\x0b"))
    of = lambda chars: _io.count_of(F.col("_t"), chars).cast("double")
    per = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(0.0)
    words, lines, chars = F.size("_words"), F.size("_lines"), F.col("_chars")
    return df, [
        F.log1p(chars.cast("double")),
        F.log1p(words.cast("double")),
        per(chars, words),
        F.log1p(lines.cast("double")),
        per(chars, lines),
        per(lines - F.size(F.array_distinct("_lines")), lines),
        per(F.size(F.array_distinct("_words")), words),
        per(of("#$%&*|<>{}[]\\^~=+@_"), chars),
        per(of(".,;:?"), chars),
        per(of("0123456789"), chars),
        per(of("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"), chars),
        per(F.size(F.filter("_words", lambda w: F.length(w) <= 3)), words),
        per(of("!"), chars),
    ]


@dataclass
class Forest:
    """Full binary trees of one depth, as (trees, nodes) arrays: node i goes to 2i+1 if its statistic is at most ``cut``, else
    to 2i+2; leaves hold what is added to the log-odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        tree, row = np.arange(len(self.feature))[None], np.arange(len(x))[:, None]
        while inner and len(self.feature) and node.min(initial=inner) < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1) if len(self.feature) else np.full(len(x), self.base)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees; with one class only, or no rows, a constant."""
    n, k = x.shape
    p = (y.sum() + 1) / (n + 2)
    base, inner = float(np.log(p / (1 - p))), (1 << depth) - 1
    none = np.empty((0, inner), dtype=np.int64)
    if n == 0 or y.min() == y.max():
        return Forest(base, none, none.astype(float), np.empty((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)])
    odds, feature, cut, leaf = np.full(n, base), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        q = 1 / (1 + np.exp(-odds))
        g, h, node = y - q, q * (1 - q), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at, gain = (node - first) * BINS, np.full((width, k, BINS), -np.inf)
            for j in range(k):
                hist = [np.bincount(at + code[j], w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, np.ones(n))]
                (gl, gt), (hl, ht), (nl, nt) = [(a, a[:, -1:]) for a in hist]
                s = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[:, j] = np.where((nl >= LEAST_ROWS) & (nt - nl >= LEAST_ROWS), s, -np.inf)
            flat = gain.reshape(width, -1)
            top = flat.argmax(axis=1)
            for i in np.flatnonzero(flat[np.arange(width), top] > 1e-9):
                feature[t, first + i], cut[t, first + i] = top[i] // BINS, cuts[top[i] // BINS][top[i] % BINS]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        end = node - inner
        leaf[t] = RATE * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + RIDGE)
        odds += leaf[t][end]
    return Forest(base, feature, cut, leaf)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Trees from at most ``rows`` labelled documents, those whose ids have the least hashes. Labels other than 0 and 1, and
    null ids, are not used; of an id that is labelled more than once the greatest label counts."""
    lab = labels.select(_io.column(labels, id_col).alias("_i"), _io.column(labels, label_col).alias("_y")).where("_i is not null and _y in (0, 1)").groupBy("_i").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_i", F.lit(6)), "_i").limit(rows)
    some = docs.select(_io.column(docs, id_col).alias("_i"), _io.column(docs, text_col).alias("_x")).join(F.broadcast(lab), "_i")
    df, cols = statistics(some, text_col="_x")
    got = df.select(F.col("_d._y").cast("double").alias("y"), *[c.alias(n) for c, n in zip(cols, STATISTICS, strict=True)]).toPandas().sort_values(["y", *STATISTICS])
    return fit(got[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), got["y"].to_numpy(float))


def classify(docs: DataFrame, forest: Forest, threshold: float = 0.5, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, keep) of every row: the probability of good quality, and whether it is at least the threshold. A null text
    is scored as an empty one; null ids and repeated rows are rows like any other; other columns play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.probability(x.to_numpy(dtype=float)))

    df, cols = statistics(docs, text_col=text_col)
    return df.select(F.col("_d").getField(id_col).alias(id_col), score(F.struct(*[c.alias(n) for c, n in zip(cols, STATISTICS, strict=True)])).alias("score")).withColumn("keep", F.col("score") >= threshold)
