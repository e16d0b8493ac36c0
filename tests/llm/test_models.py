import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from common import empty, messy, prose
from pyspark.sql import functions as F

from signalens.llm import language_id as L
from signalens.llm import quality_classifier as Q
from signalens.llm import secret_scan as S

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return S.fit(S.random_strings(3000, 1), S.identifiers(3000, 1))


def test_secrets_of_held_out_samples(model):
    secret = [s for s in S.random_strings(1500, 77) if len(s) >= 16]
    plain = [s for s in S.identifiers(3000, 78) if len(s) >= S.MIN_LENGTH and S.RUN.fullmatch(s)]
    hit = lambda s: S.best(model.ratio, s)[2] > model.threshold
    assert np.mean([hit(s) for s in secret]) > 0.97 and np.mean([hit(s) for s in plain]) < 0.01


def test_secret_spans(spark, model):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = spark.createDataFrame([(1, f'x token = "{key}" end'), (2, "internationalization_of_user_interfaces and 4111111111111111 " + "-" * 60), (None, key), (3, None), (4, ""), (5, key + " " + key)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.first_char, r.end_char, r.secret) for r in S.scan(docs, model).collect())
    assert got == [("1", 11, 51, key), ("5", 0, 40, key), ("5", 41, 81, key), ("None", 0, 40, key)]
    assert S.scan(empty(spark), model).count() == 0 and S.scan(messy(spark), model).count() == 0


def brute_best(ratio, run):
    x = np.concatenate([[S._START, S._START], S._codes(run)])
    g = [float(ratio[a, b, c]) for a, b, c in zip(x[:-2], x[1:-1], x[2:], strict=True)]
    return max(sum(g[i:j]) for i in range(len(g)) for j in range(i + S.MIN_LENGTH, len(g) + 1))


def test_best_stretch(model):
    r = random.Random(4)
    for _ in range(30):
        run = "".join(r.choice(S.ALPHABET) for _ in range(r.randint(16, 40)))
        assert abs(S.best(model.ratio, run)[2] - brute_best(model.ratio, run)) < 1e-3


def test_training_on_a_table_of_samples(spark, model):
    """Tokens of a kind of their own (vowels that never meet), told from words by samples alone, held-out ones too."""
    r = random.Random(8)
    odd = ["".join(r.choice("aeiou") + r.choice("wxqz") for _ in range(12)) for _ in range(1200)]
    plain = S.identifiers(1500, 4)
    table = [(v, True) for v in odd[:900]] * 2 + [(v, False) for v in plain] + [(None, True), ("a b", True), ("", False), ("both_ways_labelled", True), ("both_ways_labelled", False), ("unlabelled_value_here", None)]
    m = S.train(samples=spark.createDataFrame(table, "value string, secret boolean").repartition(3), seed=3)
    hit = lambda x, v: S.best(x.ratio, v)[2] > x.threshold
    assert np.mean([hit(m, v) for v in odd[900:]]) > 0.99 and np.mean([hit(m, v) for v in S.identifiers(1500, 5) if len(v) >= 16]) < 0.01
    only = S.train(samples=spark.createDataFrame(table[:900], "value string, secret boolean"), sample_rows=100)
    assert np.mean([hit(only, v) for v in odd[900:]]) > 0.95


def brute_segments(ratio, threshold, run):
    """Whether each character lies in some stretch of MIN_LENGTH characters at least whose sum exceeds the threshold, and in one without
    which no such stretch is there: by sums of all stretches."""
    total = S._sums(ratio, run)
    n, least = len(run), S.MIN_LENGTH
    good = [(i, j) for i in range(n) for j in range(i + least, n + 1) if total[j] - total[i] > threshold]
    within = np.zeros(n, dtype=bool)
    for i, j in good:
        within[i:j] = True
    return within, good


def test_scan_against_all_stretches(spark, model):
    """Every secret lies where some stretch exceeds the threshold; where a run has one, something is reported; and every stretch above
    the threshold meets a secret that is reported."""
    r, docs = random.Random(12), []
    parts = S.random_strings(40, 5) + S.identifiers(80, 6)
    for i in range(60):
        docs.append((i, " ".join(r.choice(["/", "=", "-", "_", ""]).join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(2))))
    found = {}
    for x in S.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect():
        assert dict(docs)[x.doc_id][x.first_char : x.end_char] == x.secret and x.score > model.threshold
        found.setdefault(x.doc_id, []).append((x.first_char, x.end_char))
    runs = 0
    for i, t in docs:
        spans = found.get(i, [])
        assert all(b <= c for (_, b), (c, _) in zip(sorted(spans), sorted(spans)[1:], strict=False))
        for run in S.RUN.finditer(t):
            within, good = brute_segments(model.ratio, model.threshold, run.group())
            own = [(a - run.start(), b - run.start()) for a, b in spans if run.start() <= a < run.end()]
            assert bool(own) == bool(good) or run.group().isdigit()
            assert all(within[a:b].any() for a, b in own)
            best = max(good, key=lambda p: S._sums(model.ratio, run.group())[p[1]] - S._sums(model.ratio, run.group())[p[0]], default=None)
            assert best is None or any(a < best[1] and best[0] < b for a, b in own)
            runs += bool(own)
    assert runs > 40


def test_several_secrets_in_one_run(model):
    r = random.Random(6)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(3)]
    mixed = ["".join(r.choice(S.string.ascii_letters + S.string.digits) for _ in range(32)) for _ in range(3)]
    found = lambda run: [run[a:b] for a, b, _ in S.stretches(model.ratio, model.threshold, run)]
    for keys in (hexes, mixed, [hexes[0], mixed[1], hexes[2]]):
        for join in ("/", "=", "-", "_", "/user_profile_settings_handler/", "-internationalization_of_user_interfaces-"):
            for n in (1, 2, 3):
                assert found(join.join(keys[:n])) == keys[:n], (join, n)
        assert found(f"first_key={keys[0]}-second_key={keys[1]}/third_key={keys[2]}") == keys
        assert found(f"https/example/{keys[0]}/download_report_for_every_customer_in_the_region/{keys[1]}") == keys[:2]
    assert found("internationalization_of_user_interfaces/" * 5) == found("short") == []


def test_single_secrets_stay_whole(model):
    secret = [s for s in S.random_strings(1500, 77) if S.best(model.ratio, s)[2] > model.threshold]
    assert np.mean([len(S.stretches(model.ratio, model.threshold, s)) == 1 for s in secret]) > 0.97
    key = "wJalrXUtnFEMI/K7MDENGbPxRfiCYzQ8vLs2hTq0"
    assert [key[a:b] for a, b, _ in S.stretches(model.ratio, model.threshold, key)] == [key]


def test_languages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    train, rest = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 and length(text) > 30")
    f = L.train(train)
    assert f.languages == ["de", "en", "es", "fr"] and (f.false_rate < 0.05).all()
    got = L.identify(rest, f).join(rest.withColumnRenamed("lang", "truth"), "doc_id")
    assert got.where("lang = truth").count() >= 0.98 * rest.count() == 0.98 * got.count()


def test_filters_have_no_false_negatives():
    r = random.Random(1)
    samples = {lang: ["".join(r.choice(letters) for _ in range(3000))] for lang, letters in (("a", "abcd "), ("b", "bcde "), ("c", "xyz "))}
    f = L.build(samples)
    for j, lang in enumerate(f.languages):
        h, _ = L.ngrams(samples[lang])
        u, c = np.unique(h, return_counts=True)
        top = u[np.lexsort((u, -c))[: L.PER_LANGUAGE]]
        assert ((f.masks(top) >> np.uint8(j)) & 1).all()
    total, got = f.counts(["abab dcba", "xyzzy", "", None, "123 456", "ab\x00cd"])
    brute = [len(L.ngrams([t])[0]) for t in ("abab dcba", "xyzzy", "", None, "123 456", "ab\x00cd")]
    assert total.tolist() == brute and total[2] == total[3] == 0


def naive_ngrams(text, n=L.N):
    """n-grams of a text with a space at either end, all but letters being single spaces."""
    s = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in (text or "").replace("\x00", " ")) + " "
    s = re.sub(" +", " ", s)
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def test_ngrams_of_texts_of_any_length(monkeypatch):
    """The same n-grams, whether texts come together or one comes in parts, wherever these are cut."""
    r = random.Random(3)
    texts = ["".join(r.choice("abÀé  .\n1x") for _ in range(k)) for k in (0, 1, 2, 3, 5, 17, 64, 65, 200, 999)] + [None, "   ", "ß\x00İx", "  lead and trail  "]
    hash_of = lambda g: int(L._hashed(np.array([ord(c) for c in g], dtype=np.uint64), L.N)[0])
    want = [sorted(hash_of(g) for g in naive_ngrams(t)) for t in texts]
    h, off = L.ngrams(texts)
    assert [sorted(h[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)] == want
    for chunk in (3, 7, 64):
        monkeypatch.setattr(L._text, "CHUNK", chunk)
        assert [sorted(x for p in L.long_ngrams(t or "") for x in p.tolist()) for t in texts] == want
        f = L.build({"a": [t for t in texts if t][:3], "b": ["xyz " * 50]})
        assert f.counts(texts)[0].tolist() == [len(w) for w in want]


def test_languages_against_exact_sets(spark):
    """The query's answer and counts against sets of n-grams instead of filters."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    sample: dict[str, list[str]] = {}
    f = L.train(d, 40)
    some = d.where("lang is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id", F.lit(8)).alias("h")).toPandas().sort_values(["h", "doc_id"])
    for lang, texts in some.groupby("lang", sort=True).text:
        sample[lang] = list(texts[:40])
    own = {}
    for lang, texts in sample.items():
        n = Counter(g for t in texts for g in naive_ngrams(t))
        code = {g: int(L._hashed(np.array([ord(c) for c in g], dtype=np.uint64), L.N)[0]) for g in n}
        own[lang] = set(sorted(n, key=lambda g: (-n[g], code[g]))[: L.PER_LANGUAGE])
    got = {r.doc_id: r for r in L.identify(d, f).collect()}
    right = near = 0
    for r in d.collect():
        grams = naive_ngrams(r.text)
        count = {lang: sum(g in s for g in grams) for lang, s in own.items()}
        best = max(sorted(count), key=count.get) if any(count.values()) else None
        assert got[r.doc_id].n_grams == len(grams)
        right += got[r.doc_id].lang == best or sorted(count.values())[-1] == sorted(count.values())[-2]
        near += best is None or abs(got[r.doc_id].confidence - count[best] / len(grams)) < 0.03
    assert right >= 0.995 * len(got) and near >= 0.98 * len(got)


@pytest.mark.parametrize("n", [64, 65, 130])
def test_more_languages_than_a_word_has_bits(n):
    r = random.Random(n)
    letters = ["".join(r.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçøåšžþð", 6)) + " " for _ in range(n)]
    text = lambda i: "".join(r.choice(letters[i]) for _ in range(2000))
    f = L.build({f"l{i:03d}": [text(i)] for i in range(n)})
    _, got = f.counts([text(i) for i in range(n)])
    assert f.languages == [f"l{i:03d}" for i in range(n)] and (got.argmax(axis=1) == np.arange(n)).all()


def test_language_of_awkward_rows(spark):
    f = L.train(messy(spark))
    assert L.train(messy(spark), languages=2).languages == ["en", "fr"] and f.languages == ["de", "en", "fr", "xx"]
    got = L.identify(messy(spark), f).collect()
    assert len(got) == 12 and all(r.lang is None and r.confidence == 0 for r in got if r.doc_id in (2, 3, 4))
    assert L.identify(empty(spark), f).count() == 0 and L.identify(messy(spark), L.build({})).where("lang is not null").count() == 0


def test_classifier_on_held_out_labels(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = Q.train(d, lab.where("doc_id % 2 = 0"))
    held = Q.classify(d, forest).join(lab.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (held.keep == (held.quality == 1)).mean() > 0.95


def test_flattened_trees_against_a_walk():
    r = np.random.default_rng(3)
    x = r.normal(size=(800, 5)).round(1)
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    f = Q.fit(x, y, trees=20)

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            node = 0
            while node < f.feature.shape[1]:
                node = 2 * node + 1 + (row[f.feature[t, node]] > f.cut[t, node])
            total += f.leaf[t, node - f.feature.shape[1]]
        return total

    assert np.allclose(f.log_odds(x), [walk(v) for v in x]) and ((f.probability(x) > 0.5) == y).mean() > 0.95
    assert Q.fit(x, np.ones(800)).probability(x[:3]).min() > 0.99 and len(Q.fit(x[:0], y[:0]).probability(x)) == 800


def test_splits_against_all_splits():
    """The first split, and those of both halves, are the best of all that leave enough rows on either side; leaves are Newton steps."""
    r = np.random.default_rng(5)
    for _ in range(5):
        x = r.integers(0, 8, size=(400, 4)).astype(float)
        y = (x[:, 1] + 2 * (x[:, 2] > 4) + r.normal(size=400) > 6).astype(float)
        f = Q.fit(x, y, trees=1, depth=2)
        q = 1 / (1 + np.exp(-f.base))
        g, h = y - q, np.full(400, q * (1 - q))
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + Q.RIDGE)
        gain = lambda rows, left: score(rows & left) + score(rows & ~left) - score(rows)

        def best(rows):
            splits = [gain(rows, x[:, j] <= c) for j in range(4) for c in range(8) if min((rows & (x[:, j] <= c)).sum(), (rows & (x[:, j] > c)).sum()) >= Q.LEAST_ROWS]  # noqa: B023
            return max(splits)

        at = lambda node: x[:, f.feature[0, node]] <= f.cut[0, node]
        everything = np.ones(400, dtype=bool)
        first = at(0)
        for node, rows in ((0, everything), (1, first), (2, ~first)):
            assert abs(gain(rows, at(node)) - best(rows)) < 1e-9
        for leaf, rows in enumerate((first & at(1), first & ~at(1), ~first & at(2), ~first & ~at(2))):
            assert abs(f.leaf[0, leaf] - Q.RATE * g[rows].sum() / (h[rows].sum() + Q.RIDGE)) < 1e-9


def test_classifier_on_awkward_rows(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (1, 0), (7, None), (4, 5)], "doc_id long, quality int")
    got = Q.classify(docs, Q.train(docs, labels)).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert Q.classify(docs, Q.train(docs, labels.where("false"))).count() == 12 and Q.classify(empty(spark), Q.train(docs, labels)).count() == 0
    assert prose(1)
