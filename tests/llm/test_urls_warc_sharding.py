import datetime
import random
from collections import Counter

import numpy as np
import pytest
from common import empty, long_text, messy
from pyspark.sql import functions as F

from signalens.llm import sharding as K
from signalens.llm import url_filters as U
from signalens.llm import warc as A


def brute(url, rules):
    import re

    m = re.match(U.URL, url or "")
    host = m.group(1).lower().rstrip(".") if m else ""
    if not host:
        return None, None, 0
    path = m.group(2) if m.group(2).startswith("/") else "/" + m.group(2)
    key, hits, seen = ".".join(reversed(host.split("."))) + "." + path, [], set()
    for pattern, action in rules:
        k = U.rule_key(pattern)
        if k is not None and k not in seen and key.startswith(k):
            hits.append((len(k), pattern, action))
        seen.add(k)
    top = max(hits, default=(0, None, None))
    return top[1], top[2], len(hits)


def test_urls_against_brute_force(spark):
    r = random.Random(1)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "a.b.") for b in ("x", "xy", "example") for c in ("com", "co.uk", "COM.")]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(['', 'u:p@'])}{r.choice(hosts)}{r.choice(['', ':80'])}{r.choice(['', '/', '/a', '/a/b?q=1', '?q', '/é#f', '#x', '/ab'])}" for _ in range(800)] + [None, "", "nonsense", "http:///x", "mailto:a@b"]
    rules = [("com", "1"), ("x.com", "2"), ("x.com/a", "3"), ("x.com/a/b", "4"), ("b.x.com", "5"), ("x.com", "later"), (None, "n"), ("", "e"), ("/p", "h"), ("co.uk", None), ("example.co.uk/é", "6"), ("EXAMPLE.com.", "7")]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    want = Counter((i if i % 50 else None, u, *brute(u, rules)) for i, u in enumerate(urls))
    for n in (1, 3, 16):
        got = Counter(tuple(x) for x in U.classify(pages, rules, ranges=n).collect())
        assert got == Counter({k: 2 * v for k, v in want.items()})
    table = spark.createDataFrame([(p, a, i) for i, (p, a) in enumerate(rules)], "pattern string, action string, position long").repartition(3)
    assert Counter(tuple(x) for x in U.classify(pages, table, ranges=5).collect()) == got
    ties = spark.createDataFrame([("x.com", "b"), ("X.com", "a"), ("x.com", None)], "pattern string, action string")
    assert {(r.rule, r.action) for r in U.classify(pages, ties).where("rule is not null").collect()} == {("X.com", "a")}
    assert {r.key: r.rule for r in U.rule_keys(table).collect()} == {U.rule_key(p): p for p, _ in reversed(rules) if U.rule_key(p)}
    assert U.classify(pages.where("false"), rules).count() == 0 and U.classify(pages, []).where("rule is not null or n_rules > 0").count() == 0


def test_a_url_that_most_pages_have(spark):
    pages = spark.createDataFrame([(i, "http://x.com/a" if i % 4 else f"http://h{i}.org/b") for i in range(4000)], "page_id long, url string").repartition(4)
    rules = [("com", "1"), ("x.com/a", "2"), ("x.com/ab", "3"), ("org", "4")]
    got = U.classify(pages, rules, ranges=8)
    assert Counter((r.rule, r.n_rules) for r in got.collect()) == {("x.com/a", 2): 3000, ("org", 1): 1000}
    size = [r["count"] for r in got.where("rule = 'x.com/a'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(size) >= 5 and max(size) < 1000


def test_bundles_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i} é</p>" * (i % 40)) for i in range(400)] + [(None, None, None), (7, "http://h/7", "again"), (7, "http://h/7", "again"), (500, "http://a\r\nX: y", ""), (501, "u", long_text())]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string").repartition(3)
    index = A.bundle(pages, f"file://{tmp_path}/b", frame_bytes=4000, bundle_bytes=9000)
    assert index.count() == len(rows) and index.select("bundle").distinct().count() > 3 and index.agg({"frame": "max"}).first()[0] > 0
    want = Counter((i, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, h) for i, u, h in rows)
    assert Counter((r.page_id, r.url, r.body) for r in A.fetch(index).collect()) == want
    for r in index.limit(20).collect():
        frames = A.read_seek_table(r.bundle)
        assert frames[r.frame][:2] == (r.frame_start, r.frame_bytes) and r.offset + r.length <= frames[r.frame][2]
        head, _ = A.parse(A.read_record(r.bundle, r.frame_start, r.frame_bytes, r.offset, r.length))
        assert head["WARC-Type"] == "resource" and head["WARC-Record-ID"] == f"<{r.record_id}>"
    assert index.select("record_id").distinct().count() == len(rows)
    import zstandard

    path = index.first().bundle.removeprefix("file://")
    with open(path, "rb") as f:  # a plain reader takes the whole file
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.0\r\n")
    assert A.bundle(pages.where("false")).count() == 0


def test_bundles_leave_other_files_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * i) for i in range(60)], "page_id long, url string, html string").repartition(2)
    (tmp_path / "below").mkdir()
    (tmp_path / "precious.txt").write_text("keep")
    first = A.bundle(pages, f"file://{tmp_path}", frame_bytes=500)
    second = A.bundle(pages.where("page_id < 9"), f"file://{tmp_path}", frame_bytes=500)
    assert (tmp_path / "precious.txt").read_text() == "keep" and (tmp_path / "below").is_dir()
    assert {(r.page_id, r.body) for r in A.fetch(first).collect()} == {(i, "x" * i) for i in range(60)} and A.fetch(second).count() == 9
    assert first.join(second, "record_id").count() == 0 and first.join(second, "bundle").count() == 0
    assert len(list(tmp_path.glob("*.warc.zst"))) == first.unionByName(second).select("bundle").distinct().count()


def brute_tree(x, w, target):
    """Shards of the columns of x by the same rule, with sorting instead of histograms."""
    scale, out, n = x.max(axis=1) - x.min(axis=1), np.zeros(x.shape[1], dtype=int), [0]

    def go(at):
        v = x[:, at]
        span = v.max(axis=1) - v.min(axis=1)
        width = np.divide(span, scale, out=np.zeros(len(span)), where=scale > 0)
        d = int(width.argmax())
        if w[at].sum() <= target or width[d] <= 0:
            out[at], n[0] = n[0], n[0] + 1
            return
        values = np.unique(v[d])
        cum = np.array([w[at][v[d] <= u].sum() for u in values])
        cut = values[min(int(np.searchsorted(cum, w[at].sum() / 2)), len(values) - 2)]
        go(at[v[d] <= cut])
        go(at[v[d] > cut])

    go(np.arange(x.shape[1]))
    return out


def test_sharding_against_sorting(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, "é" * r.choice([0, 1, 5, 50, 3000]), r.choice(["de", "en", "fr", None]), f"src{min(9, int(r.expovariate(0.5)))}") for i in range(700)] + [(3, "tie", "en", "src1")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = K.shard(docs, 20_000).collect()
    names, langs = (sorted({x[k] for x in rows if x[k] is not None}) for k in (3, 2))
    m = np.array([[langs.index(x[2]) if x[2] else -1, names.index(x[3]), x[0], len(x[1])] for x in rows], dtype=float).T
    w = np.array([max(1, len(x[1].encode())) for x in rows])
    want = Counter(zip(m[2].tolist(), brute_tree(m, w, 20_000).tolist(), strict=True))
    assert Counter((float(r.doc_id), r.shard) for r in got) == want
    for local, size in ((7, K.TREE_BYTES), (100, 1500), (10**6, 100)):  # how much is split globally, how many trees go to workers at once
        monkeypatch.setattr(K, "LOCAL_ROWS", local)
        monkeypatch.setattr(K, "TREE_BYTES", size)
        assert Counter((float(r.doc_id), r.shard) for r in K.shard(docs, 20_000).collect()) == want
    monkeypatch.setattr(K, "PARTITIONS", 3)
    parts = K.shard(docs, 20_000).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in parts}) == 3 and len(parts) == len({r.shard for r in parts})
    size = Counter()
    for r in got:
        size[r.shard] += max(1, len(r.text.encode()))
    assert max(size.values()) <= 20_000 and len(size) > 10
    assert K.shard(docs, 20_000, move=False).count() == len(rows)


def test_sharding_of_awkward_rows(spark):
    docs = messy(spark)
    out = K.shard(docs, 100)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == 12
    by = {}
    for r in out.collect():
        by.setdefault(r.shard, []).append(r.doc_id)
    assert [5, 5] in by.values()  # equal rows stay together
    assert K.shard(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "x" * 50, "en", "a")] * 10, "doc_id long, text string, lang string, source string")
    assert {r.shard for r in K.shard(same, 60).collect()} == {0}


def test_sharding_takes_whole_values(spark, monkeypatch):
    """Long common prefixes, whole numbers beyond 2^53, dates, fractions with NaN and infinity, null apart from -1: eight values of a
    dimension make eight shards, in their order."""
    kinds = {
        "string": [f"common_crawl_{y}" for y in range(2010, 2018)], "text": [None, "", " ", "-1", "Z", "a", "z", "é"], "long": [None, -(2**63), -1, 0, 1, 5, 2**62, 2**62 + 1], "date": [datetime.date(2020, 1, 1 + i) for i in range(8)],
        "double": [None, float("-inf"), -1.0, 5e-324, 0.5, 1e300, float("inf"), float("nan")],
    }
    rows = list(zip(*kinds.values(), strict=True))
    docs = spark.createDataFrame([(i, *x, "x" * 50) for i, x in random.Random(3).sample(list(enumerate(rows)), 8)], "at int, string string, text_ string, long long, date date, double double, text string").repartition(2)
    for local in (1, 10**6):
        monkeypatch.setattr(K, "LOCAL_ROWS", local)
        for name in ("string", "text_", "long", "date", "double"):
            got = K.shard(docs, 60, dimensions=(name,), move=False).select("at", "shard").collect()
            assert sorted((r.shard, r["at"]) for r in got) == [(i, i) for i in range(8)], name
