import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), os.path.dirname(os.path.dirname(HERE))]

from oracle import connect, spark_rows, sql_rows  # noqa: E402

from signalens.llm import decontamination, jaccard_join, mixing, quality_rules, sharding  # noqa: E402
from signalens.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.judge(docs).collect() if r["keep"]}
    some = docs.where(docs.doc_id.isin(*good))
    root = {d: d for d in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    from test_jaccard_join import truth

    for a, b in truth([(d, texts[d]) for d in sorted(good)]):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    one = {d for d in good if find(d) == d}
    from test_decontamination import spans

    items = [r.text for r in bench.collect()]
    clean = {d for d in one if not any(spans(texts[d], t, 8) for t in items)}
    stages, seen = dict(P.STAGES), docs
    for name, want in (("quality_rules", good), ("near_duplicates", one), ("decontamination", clean)):
        seen = spark.createDataFrame(stages[name](spark, seen, SF).collect(), docs.schema)
        assert {r.doc_id for r in seen.collect()} == want
    out = P.run(spark, SF).collect()
    mixed = mixing.mix(seen, Q.WEIGHTS, copy_col=None).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed) and set(out[0].asDict()) == set(docs.columns) | {"shard"}
    assert some.count() == len(good) and decontamination.K == 5 and jaccard_join.N == 3 and sharding.BINS


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(Q.queries()[name](spark, SF)) == sql_rows(connect(SF), Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_runs(spark, name):
    assert Q.queries()[name](spark, SF.replace("0.001", "0.01")).count() > 0
