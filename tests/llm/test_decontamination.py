import random
import re
import time

import numpy as np
import pytest
from common import empty, messy, prose

from signalens.llm import decontamination as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def spans(doc, item, least):
    """Maximal shared spans, by brute force."""
    a, b = words(doc), words(item)
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, n))
    return out


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 7, 8, 9, 20, 50])))) for i in range(30)] + [(99, None), (None, prose(1)), (100, "")]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))))
            w = words(r.choice(items)[1])
            s = r.randint(0, max(0, len(w) - 5))
            parts.append(",  ".join(w[s : s + r.randint(3, 20)]).upper())
        docs.append((d, "\n".join(parts)))
    return docs, items


def test_finds_every_span(spark, data):
    docs, items = data
    want = {(d, i, j, n) for d, t in docs for i, x in items for _, j, n in spans(t, x, 8)}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK_BYTES, 50):  # all items at once, and in many blocks
        got = D.find(df, it, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id, r.item_word, r.n_words) for r in got} == want and len(want) > 20
        text = dict(docs)
        for r in got:
            assert len(words(text[r.doc_id][r.first_char : r.end_char])) == r.n_words
        dirty = {r.doc_id for r in got}
        assert {r.doc_id for r in D.remove(df, it, block_bytes=block).collect()} == {d for d, _ in docs} - dirty


def test_awkward_rows(spark):
    docs = messy(spark)
    items = spark.createDataFrame([(1, prose(5)), (2, None), (None, prose(2))], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in D.find(docs, items).where("n_words = 60").collect())
    assert got.count(("5", "1")) == 2 and ("6", "1") in got and ("None", "None") in got
    left = D.remove(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {1, 2, None, 3, 4, 8, -9} - {1} and not {5, 6} & {r.doc_id for r in left.collect()}
    assert D.find(empty(spark), items).count() == D.remove(empty(spark), items).count() == 0
    assert D.find(docs, items.where("false")).count() == 0 and D.remove(docs, items.where("false")).count() == docs.count()


@pytest.mark.parametrize("hits", [D.HITS, 5])
def test_texts_that_repeat_themselves(monkeypatch, hits):
    monkeypatch.setattr(D, "HITS", hits)
    docs = ["yes " * 70, "a b c " * 30 + "x " + "a b c d " * 9, "a b c d e f g h i j " * 3, "no " * 7, None]
    items = ["yes " * 40, "a b c " * 20, "b c d e f g h i j a b", "no " * 20, "", None]
    block = D.index(list(range(len(items))), items)
    got = [(t, i, w, n, s) for t, i, s, _, w, n in D.matches(block, docs, 8)]
    want = {(t, i, b, n) for t, x in enumerate(docs) for i, y in enumerate(items) for _, b, n in spans(x, y, 8)}
    assert {g[:4] for g in got} == want and len(got) == len(set(got)) == sum(len(spans(x, y, 8)) for x in docs for y in items)


def test_time_of_texts_that_repeat_themselves():
    block, began = D.index([1], ["yes " * 400]), time.perf_counter()
    assert sum(1 for _ in D.matches(block, ["yes " * 16000], 8)) == 16000 + 400 - 1 - 2 * 7
    assert time.perf_counter() - began < 5


def test_fingerprints_guarantee():
    r = np.random.default_rng(1)
    for n in range(0, 30):
        g = r.integers(0, 5, n).astype(np.uint64)
        chosen = D.fingerprints(g, 4)
        for i in range(max(0, n - 3)):
            assert (g[i : i + 4][chosen[i : i + 4]] == g[i : i + 4].min()).any()
