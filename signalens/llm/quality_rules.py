"""Quality rules: a table of thresholds compiled into one projection, without user functions.

A measure is an expression over a few shared ones; a rule is (name, measure, least, most, fewest words from which it
applies, where fewer would make the measure meaningless). Vocabulary is Guiraud's index, distinct words by the root of all
words: since a vocabulary grows about as that root does, one threshold serves texts of any length. Catalyst evaluates
everything in one pass over the text, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalens.llm import _io

STOP_WORDS = (
    "a", "al", "an", "and", "are", "as", "at", "au", "auch", "auf", "avec", "be", "by", "con", "dans", "das", "de", "del", "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "es", "est", "et", "for", "from", "für", "in", "is", "ist", "it", "la",
    "las", "le", "les", "lo", "los", "mit", "nicht", "no", "of", "on", "par", "para", "pas", "por", "pour", "que", "qui", "se", "sich", "su", "sur", "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with", "y", "zu",
)
SYMBOLS = "#$%&*!|<>{}[]\\^~=+@_"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
BREAKS = r"[ \t\n\r\f\x0B.,;:!?]+"


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


RULES = (
    Rule("words", "words", least=1),
    Rule("word_length", "word_length", least=2, most=14, from_words=20),
    Rule("symbols", "symbols", most=0.08, from_words=4),
    Rule("capitals", "capitals", most=0.35, from_words=10),
    Rule("stop_words", "stop_words", least=0.02, from_words=60),
    Rule("vocabulary", "vocabulary", least=3, from_words=30),
    Rule("repeated_lines", "repeated_lines", most=0.5, from_words=8),
)


def _measures(text: Column) -> tuple[list[tuple[str, Column]], dict[str, Column]]:
    """Shared expressions, in an order in which each may use those before it, and the measures over them."""
    t = F.coalesce(text, F.lit(""))
    shared = [
        ("_len", F.length(t) - _io.count_of(t, " \t\n\r\f\x0b")),
        ("_sym", _io.count_of(t, SYMBOLS)),
        ("_cap", _io.count_of(t, CAPITALS)),
        ("_lines", F.array_remove(F.split(t, "\n"), "")),
        ("_words", F.array_remove(F.split(F.lower(t), BREAKS), "")),
        ("_stop", F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS)))),
    ]
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(0.0)
    words = F.size("_words")
    return shared, {
        "words": words.cast("double"),
        "word_length": ratio(F.col("_len"), words),
        "symbols": ratio(F.col("_sym"), F.col("_len")),
        "capitals": ratio(F.col("_cap"), F.col("_len")),
        "stop_words": ratio(F.col("_stop"), words),
        "vocabulary": ratio(F.size(F.array_distinct("_words")), F.sqrt(words.cast("double"))),
        "repeated_lines": ratio(F.size("_lines") - F.size(F.array_distinct("_lines")), F.size("_lines")),
    }


def measured(docs: DataFrame, rules=RULES, *, text_col: str = "text") -> DataFrame:
    """(_d: the row as it was, n_words, failed: names of the rules that it breaks in the table's order, joined by commas)."""
    shared, measure = _measures(F.col("_t"))
    df = docs.select(F.struct(*[_io.column(docs, c).alias(c) for c in docs.columns]).alias("_d"), _io.column(docs, text_col).alias("_t"))
    for name, c in shared:
        df = df.withColumn(name, c)
    df = df.select("_d", *[measure[m].alias(f"_m_{m}") for m in dict.fromkeys(["words", *(r.measure for r in rules)])])
    broken = []
    for r in rules:
        m = F.col(f"_m_{r.measure}")
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (m < r.least)
        if r.most is not None:
            bad = bad | (m > r.most)
        broken.append(F.when(bad & (F.col("_m_words") >= r.from_words), F.lit(r.name)))
    return df.select("_d", F.col("_m_words").cast("long").alias("n_words"), F.concat_ws(",", *broken).alias("failed"))


def judge(docs: DataFrame, rules=RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, failed, keep) of every row. A null, empty or blank text has no words and breaks the rule "words"; null
    identifiers and repeated rows are judged like any other; further columns play no part; no rows give no rows."""
    df = measured(docs, rules, text_col=text_col)
    return df.select(F.col("_d").getField(id_col).alias(id_col), "n_words", "failed", (F.col("failed") == "").alias("keep"))


def apply(docs: DataFrame, rules=RULES, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that break no rule, with docs' columns.

    The filter asks for a partition number as well: a projection that holds one is not merged with a filter, which otherwise
    would be pushed below the measures and repeat each of them wherever another uses it.
    """
    df = measured(docs, rules, text_col=text_col).withColumn("_here", F.spark_partition_id())
    return df.where("failed = '' and _here >= 0").select("_d.*")


def rules_sql(table: str = "documents") -> str:
    """judge() over RULES, for DuckDB."""
    q = lambda s: s.replace("'", "''")
    cond = []
    for r in RULES:
        parts = [f"m_{r.measure} < {r.least!r}"] * (r.least is not None) + [f"m_{r.measure} > {r.most!r}"] * (r.most is not None)
        cond.append(f"CASE WHEN ({' OR '.join(parts)}) AND m_words >= {r.from_words} THEN '{r.name}' END")
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
b AS (SELECT doc_id, ' ' || regexp_replace(lower(t), '{BREAKS}', '  ', 'g') || ' ' AS pad, length(regexp_replace(t, '[ \\t\\n\\r\\f\\x0B]+', '', 'g')) AS len,
  length(t) - length(translate(t, '{q(SYMBOLS)}', '')) AS sym, length(t) - length(translate(t, '{CAPITALS}', '')) AS cap, list_filter(string_split(t, chr(10)), lambda x: x <> '') AS lines FROM a),
c AS (SELECT *, list_filter(string_split(trim(pad, ' '), '  '), lambda x: x <> '') AS words, len(regexp_extract_all(pad, ' ({'|'.join(STOP_WORDS)}) ')) AS stop FROM b),
d AS (SELECT doc_id, len(words)::DOUBLE AS m_words, CASE WHEN len(words) > 0 THEN len::DOUBLE / len(words) ELSE 0 END AS m_word_length,
  CASE WHEN len > 0 THEN sym::DOUBLE / len ELSE 0 END AS m_symbols, CASE WHEN len > 0 THEN cap::DOUBLE / len ELSE 0 END AS m_capitals,
  CASE WHEN len(words) > 0 THEN stop::DOUBLE / len(words) ELSE 0 END AS m_stop_words, CASE WHEN len(words) > 0 THEN len(list_distinct(words))::DOUBLE / sqrt(len(words)) ELSE 0 END AS m_vocabulary,
  CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines)))::DOUBLE / len(lines) ELSE 0 END AS m_repeated_lines FROM c),
e AS (SELECT doc_id, m_words::BIGINT AS n_words, concat_ws(',', {', '.join(cond)}) AS failed FROM d)
SELECT doc_id, n_words, failed, failed = '' AS keep FROM e"""
