import hashlib
import math
import random
from collections import Counter

import pytest
from common import empty, messy, prose
from pyspark.sql import functions as F

from signalens.llm import _io, mixing, quality_rules


def test_mixing_against_brute_force(spark):
    docs = messy(spark)
    rows = [r.asDict() for r in docs.collect()]
    weights = {"a": 3.0, "b": 0.5}
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += len((r["text"] or "").split()) if r["text"] and "\x00" not in r["text"] else len([x for x in (r["text"] or "").split(" ") if x])
    w = {s: (weights.get(s, 1.0) if s is not None else 1.0) if n else 0.0 for s, n in tokens.items()}
    rate = {s: w[s] * sum(tokens.values()) / (sum(w.values()) * n) if n else 0.0 for s, n in tokens.items()}
    got_rates = {r.source: (r.n_tokens, r.rate) for r in mixing.source_rates(docs, weights).collect()}
    assert got_rates == {s: (tokens[s], pytest.approx(rate[s])) for s in tokens}
    want = Counter()
    for r in rows:
        key = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5((r["text"] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{key}:17".encode()).hexdigest()[:13], 16) / 2**52
        n = math.floor(rate[r["source"]])
        n += u < rate[r["source"]] - n
        for c in range(1, n + 1):
            want[(r["doc_id"], r["text"], r["source"], c)] += 1
    out = mixing.mix(docs, weights)
    assert Counter((r.doc_id, r.text, r.source, r["copy"]) for r in out.collect()) == want
    assert sorted(out.columns) == sorted(docs.columns)
    kept = mixing.mix(docs, weights, copy_col=None, broadcast_bytes=0)
    assert kept.columns == docs.columns and kept.count() == sum(want.values())  # sources joined by a shuffle


def test_mixing_meets_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "x" if i % 10 else "y") for i in range(4000)], "doc_id long, text string, source string")
    n = Counter(r.source for r in mixing.mix(docs, {"x": 1.0, "y": 1.0}).collect())
    assert abs(n["x"] - 2000) < 120 and n["y"] == 2000
    assert mixing.mix(empty(spark), {}).count() == 0
    assert mixing.mix(docs.where("source = 'y'"), {}, target_tokens=8000).count() == 800
    assert mixing.mix(docs, {"x": 0.0}, 0.0).count() == 0 and {r.source for r in mixing.mix(docs, {"x": 0.0}).collect()} == {"y"}
    for w in (-1.0, math.nan, math.inf):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix(docs, {"x": w})


def test_rules(spark):
    texts = {
        1: prose(1), 2: None, 3: "", 4: " \n ", 5: "That it.", 6: "A!! B!!" * 30, 7: "word*** " * 40, 8: "same line of the text\n" * 30, 9: "Und " * 200, 10: " | ".join(["thing"] * 3 + [f"q{i}" for i in range(90)]), 11: "THE RIVER RUNS OVER THE STONES OF OLD AND NEW", 12: prose(3, 5000),
    }
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {k for k, r in got.items() if r["keep"]} == {1, 5, 12}
    assert got[2].failed == got[3].failed == got[4].failed == "words" and got[11].failed == "capitals" and "repeated_lines" in got[8].failed and "symbols" in got[7].failed and "vocabulary" in got[9].failed


def test_vocabulary_of_texts_of_any_length(spark):
    """A passage of 250 distinct words is prose once and no more so eighty times over; a long text of many words is."""
    r = random.Random(2)
    passage = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ala", "enu", "iro", "ota", "una", "alt", "ent", "irn", "ost", "umb", "ari", "eno", "ilu", "ora", "ust", "ang", "elm", "ink")][:250]
    names = [f"n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(8000)]
    long = " ".join(names[min(7999, int(r.paretovariate(0.7)))] + (" the" if k % 9 == 0 else "") for k in range(300_000))
    docs = [(1, "the " + " ".join(passage)), (2, " ".join(("the " + " ".join(passage[k % 5 :])) for k in range(80))), (3, long)]
    got = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "vocabulary" not in got[1].failed and "vocabulary" in got[2].failed and "vocabulary" not in got[3].failed and got[3].n_words > 300_000


def test_rules_on_awkward_rows(spark):
    docs = messy(spark)
    judged = quality_rules.judge(docs).collect()
    assert len(judged) == docs.count()
    kept = quality_rules.apply(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in judged)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged if r["keep"]) and Counter(r.doc_id for r in kept.collect())[5] == 2
    assert quality_rules.judge(empty(spark)).count() == quality_rules.apply(empty(spark)).count() == 0


def test_each_measure_is_evaluated_once(spark):
    plan = quality_rules.apply(messy(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_count(") <= 6


def test_counts_of_characters(spark):
    chars = quality_rules.SYMBOLS + "]-^&&\\ \t\x0b"
    texts = ["", "a-b]c^d&e\\f g\th\x0bi~[{}]", chars * 3, "É€😀-" + chars[::-1], "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(_io.count_of(F.col("t"), chars)).collect()] == [sum(c in chars for c in t) for t in texts]
