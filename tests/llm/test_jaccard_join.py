import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from common import empty, long_text, messy, prose

from signalens.llm import _text
from signalens.llm import jaccard_join as J


def truth(docs, t=J.THRESHOLD, n=J.N):
    sets = {d: set(s.tolist()) for (d, _), s in zip(docs, _text.gram_sets([x for _, x in docs], n), strict=True)}
    inverse, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            inverse[g].append(d)
    for ds in inverse.values():
        shared.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    out = {tuple(sorted(p)): c / (len(sets[p[0]]) + len(sets[p[1]]) - c) for p, c in shared.items()}
    return {p: j for p, j in out.items() if j >= t}


def degrees(docs, want):
    """Of each document the number of different sets that it is linked with, and the least document of its class."""
    same = defaultdict(list)
    for (d, _), s in zip(docs, _text.gram_sets([x for _, x in docs], J.N), strict=True):
        same[s.tobytes()].append(d)
    first, root = {d: min(ds) for ds in same.values() for d in ds}, {d: d for d, _ in docs}
    near = defaultdict(set)
    for a, b in want:
        if first[a] != first[b]:
            near[first[a]].add(first[b])
            near[first[b]].add(first[a])

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d: len(near[first[d]]) for d in root}, {d: find(d) for d in root}


def held(docs, got, want, least):
    """Links are counted exactly or missed; at most a share of 1 - least is missed, and classes are those of brute force."""
    links, cls = degrees(docs, want)
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == set(links) and all(rows[d].links <= links[d] for d in rows)
    assert sum(r.links for r in rows.values()) >= least * sum(links.values()) > 0
    assert sum(rows[d].class_id != cls[d] for d in rows) <= 0.002 * len(rows)
    return rows


@pytest.fixture(scope="module")
def corpus():
    """Copies and near copies of texts of all lengths, in groups of up to 150, and a line that most share."""
    r, docs = random.Random(5), []
    vocabulary = [f"{a}{b}" for a in "bcdfghklmn" for b in range(60)]
    for size in (1, 2, 3, 5, 8, 12, 20, 40, 90, 200, 500, 1500):
        for _ in range(12):
            base = [r.choice(vocabulary) for _ in range(size)]
            for _ in range(r.choice([1, 2, 4])):
                w = [r.choice(vocabulary) if r.random() < r.choice([0, 0.01, 0.03, 0.06]) else x for x in base]
                docs.append((len(docs), " ".join(w) + (" licensed under the apache license version two" if size > 20 and r.random() < 0.7 else "")))
    base = [r.choice(vocabulary) for _ in range(120)]
    for _ in range(150):
        docs.append((len(docs), " ".join(r.choice(vocabulary) if r.random() < 0.02 else x for x in base)))
    docs += [(len(docs) + i, " ".join(base)) for i in range(100)]
    return docs


def test_links_against_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    rows = held(corpus, J.classes(df), truth(corpus), 0.98)
    assert sorted(r.doc_id for r in J.deduplicate(df).collect()) == sorted({r.class_id for r in rows.values()})


def test_sketch_bounds(corpus):
    r = np.random.default_rng(2)
    for n in (4, 30, 60):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - 1], r.integers(0, 2**63, 1).astype(np.uint64)]))
        band = J.band_of(len(a), 0.6)
        (ka, fa), (kb, fb) = J.sketch(a, band, 0.6), J.sketch(b, band, 0.6)
        hamming = sum(int(x).bit_count() for x in (fa ^ fb).view(np.uint64).tolist())
        assert hamming <= len(set(a.tolist()) ^ set(b.tolist())) and set(ka.tolist()) & set(kb.tolist())


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_partners_are_in_neighbouring_bands(t):
    for a in range(1, 400):
        for b in range(a, int(a / t + 1e-9) + 1):
            assert J.band_of(b, t) - J.band_of(a, t) in (0, 1)


def test_awkward_rows(spark):
    docs = messy(spark)
    got = Counter((r.doc_id, r.class_id, r.copies, r.links) for r in J.classes(docs).collect())
    assert got == Counter({(1, 1, 1, 0): 1, (2, 2, 1, 0): 1, (None, None, 1, 0): 2, (3, 3, 1, 0): 1, (4, 4, 1, 0): 1, (5, 5, 3, 0): 2, (6, 5, 3, 0): 1, (7, 7, 1, 0): 1, (8, 8, 1, 0): 1, (-9, -9, 1, 0): 1})
    left = J.deduplicate(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter({1: 1, 2: 1, None: 2, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, -9: 1})
    assert J.classes(empty(spark)).count() == J.deduplicate(empty(spark)).count() == 0
    same = spark.createDataFrame([(None, prose(1)), (None, prose(1)), (4, prose(1)), (None, long_text()), (None, long_text())], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in J.deduplicate(same).collect()) == [0, 4]
    assert sorted((r.doc_id or 0, r.class_id or 0, r.copies) for r in J.classes(same).collect()) == [(0, 0, 2), (0, 0, 2), (0, 4, 3), (0, 4, 3), (4, 4, 3)]


def _edited(r, words, share):
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in words)


def test_large_groups_across_band_edges(spark):
    """Hundreds of distinct copies just above the edge of a band, few just below it, at several edges; and a line that others share."""
    docs, below = [], []
    line = " licensed under the apache license version two of january"
    for edge in (60, 101, 170, 285):
        r, base = random.Random(edge), [f"e{edge}w{i}" for i in range(edge + 12)]
        for size, copies in ((edge + 4, 300), (edge + 1, 5), (edge, 3)):
            below += range(len(docs), len(docs) + copies * (copies < 300))
            docs += [(len(docs) + i, _edited(r, base[:size], 0.01)) for i in range(copies)]
        docs += [(len(docs) + i, " ".join(f"o{r.randrange(10**6)}" for _ in range(edge // 2)) + line) for i in range(150)]
    want = truth(docs)
    rows, links = held(docs, J.classes(spark.createDataFrame(docs, "doc_id long, text string")), want, 0.995), degrees(docs, want)[0]
    assert sum(rows[d].links for d in below) >= 0.995 * sum(links[d] for d in below) > 2000


def test_large_groups_with_many_edits(spark):
    """Over 64 copies with 3 to 10 % of their words replaced: many pairs are near the threshold."""
    docs = []
    for size in (50, 90, 160, 400):
        r, base = random.Random(size), [f"s{size}w{i}" for i in range(size)]
        docs += [(len(docs) + i, _edited(r, base, r.choice([0, 0.03, 0.05, 0.07, 0.1]))) for i in range(140)]
    held(docs, J.classes(spark.createDataFrame(docs, "doc_id long, text string")), truth(docs), 0.99)


def test_near_copies_and_longer_ones(spark):
    """Two kinds in one group: near copies of a text, and such with half as much appended."""
    r, base = random.Random(9), [f"w{i}" for i in range(300)]
    docs = [(i, _edited(r, base, r.choice([0, 0.005, 0.01]))) for i in range(120)]
    docs += [(120 + i, _edited(r, base, 0.005) + " " + " ".join(f"n{r.randrange(10**6)}" for _ in range(150))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held(docs, J.classes(df), truth(docs), 0.98)
    assert [x.doc_id for x in J.deduplicate(df).collect()] == [0]


@pytest.mark.parametrize(("common", "block", "rounds"), [(4, 7, 2), (10**6, 7, 1)])
def test_parameters_decide_how_not_what(spark, corpus, monkeypatch, common, block, rounds):
    """Blocks, rounds of leaders and what counts as common change the way, not the links."""
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    some = [(d, x) for d, x in corpus if d % 3 or d > 250]
    held(some, J.classes(spark.createDataFrame(some, "doc_id long, text string")), truth(some), 0.98)


def test_linked_is_brute_force():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 12000, k).astype(np.uint64)) for k in (1, 2, 3, 50, 5000, 9000)] + [np.arange(k, dtype=np.uint64) for k in (600, 1000, 5000, 5001)]
    want = [[len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6 for b in map(np.ndarray.tolist, sets)] for a in map(np.ndarray.tolist, sets)]
    assert J.linked(sets, sets, 0.6).tolist() == want and J.linked(sets[:1], sets[6:7], 0.6).shape == (1, 1)
