import random

import pyarrow as pa
import pytest

from signalens.functions import extract as X
from signalens.lang import logql, promql, shapes, traceql
from signalens.lang.lexing import ParseError

PARSE = {"promql": promql.extract, "logql": logql.extract, "traceql": traceql.extract}
VALUES = ["u17", "a", "b|c", "x|", "|", "a.b", "", "__name__", "_x", ".", "a b", "k.*", "(", "10.0.0.0/8", "é", "a-b", "9007190000001", "it's", "0", "a#b", "a//b", "<p>", "(?P<n>x)", "z9 ", "a\\\\d", "up", "1m"]
NUMBERS = ["0", "1", "17", "017", "1.5", "1e3", "5m", "123456789012345", "1234567890123456", "12x", "-3", "0x1f", "20MB", "1."]
EXPRS = {
    "promql": ['m{a="V",b=~"V",c!="V",d!~"V"} > N', '{"V"="V","V"=~"V"} and on (a) m{a="V"}', '{"V"}', '{__name__=~"V",a="V"}', 'count_values("V", m{a="V"} == bool N)', 'm{a="V"} @ N', 'label_replace(m{z="V",a="V"}, "V", "$1", "V", "V")', "m{a='V'} offset N # \"V\"", 'topk(N, rate(m{a="V"}[N])) or uN{a="V"}', 'm{a="V"} "V"'],
    "logql": ['{a="V",b=~"V",c!~"V"} |= "V" != "V" |~ "V" or "V" | k >= N | k=N | k = "V" | d="V" or e=~"V"', 'sum by (a) (rate({a="V"} | json x="V" | k >N and b!="V" [5m])) > N', '{a="V"} | regexp "V"', '{a="V"} | pattern "V"', '{a="V"} |= ip("V") | x=ip("V") | label_format a="V",b=N', '{a="V"} | drop a="V", b=~"V" | line_format "V"', 'quantile_over_time(N, {a="V"} | unwrap x [N]) == bool N', '{a=`V`} |> "V" | k < -N', '{b="V",a="V",a="V"} |= "V" |= "V" # x="V"'],
    "traceql": ['{ span.aN = N && resource.b = "V" && parent.uN != nil && name =~ "V" }', '{ .aN > N } | by(span.bN, span."V") | count() > N', '{ span."V"N = "V" || span.aN.bN = "V" } | quantile_over_time(span.xN, N) by (span.yN)', "{ duration > N } | rate() with (aN=N) // uN = 1", '{ trace:durationN = "V" && kN = N }', "{ span.b1 = 1 && span.aN = 1 && parent.aN = 1 && .aN = 2 } | topk(N)"],
}


def both(lang, expr):
    def tried(f):
        try:
            return f()
        except ParseError as e:
            return str(e)

    return tried(lambda: PARSE[lang](expr)), tried(lambda: shapes.extract(lang, PARSE[lang], expr))


@pytest.mark.parametrize("lang", PARSE)
def test_shapes_find_what_the_parser_finds(lang):
    pick, parsed = random.Random(7), 0
    for _ in range(6000):
        expr = "".join(pick.choice(VALUES) if c == "V" else pick.choice(NUMBERS) if c == "N" else c for c in pick.choice(EXPRS[lang]))
        want, got = both(lang, expr)
        assert got == want, expr
        parsed += not isinstance(want, str)
    assert parsed > 600


def test_values_are_sorted_and_repetitions_dropped_anew():
    for a, b in ("za", "az", "aa"):
        for lang, expr in (("promql", f'm{{x="{a}"}} + m{{x="{b}"}} + {{"{b}"}} + {{"{a}"}}'), ("logql", f'{{x="{a}",x="{b}"}} |= "{a}" |= "{b}" | k="{a}" | k="{b}" | n > {len(a)} | n > 1'), ("traceql", f"{{ span.{a}1 = 1 && span.{b}1 = 2 && parent.{b}2 = 3 && span.{a}2 = 1 }}")):
            want, got = both(lang, expr)
            assert isinstance(want, dict) and got == want


@pytest.mark.parametrize("lang, expr", [("promql", 'rate(m{{user="u{0}",type!="t{0}"}}[5m])'), ("logql", 'rate({{app="a{0}"}} |= "x{0}" | json | k >= {0} [5m])'), ("traceql", "{{ span.a = {0} && parent.u{0} != nil }}")])
def test_one_parse_a_shape_and_little_memory(lang, expr, monkeypatch):
    """However many expressions pass, a worker keeps the shapes alone."""
    calls = []
    parse, fields = X._FIELDS[lang]
    monkeypatch.setitem(X._FIELDS, lang, (lambda e: calls.append(e) or parse(e), fields))
    got = X._batch(lang, pa.array([expr.format(i) for i in range(1, 5001)] * 2))
    assert len(got) == 10_000 and got[4999] == got[9999] and got[3].as_py() != got[4].as_py() and len(calls) == 1
    assert not hasattr(X.extract_row, "cache_info") and shapes._parsed.cache_info().maxsize <= 1024


@pytest.mark.parametrize("lang", PARSE)
def test_batches_are_rows_one_by_one(lang):
    exprs = ['rate(a{b="c"}[5m])', None, "x{", '{a="b"} |= "c" | k > 5', 'rate(a{b="c"}[5m])', "", "a @ 1.5", "{ span.a1 = 2 }", '{a="d"} |= "e" | k > 6', *['m{a="' + "x" * 3000 + '"}'] * 2]
    names = [f.name for f in X._fields(lang)]
    for some in (exprs, [None], []):
        assert X._batch(lang, pa.array(some, pa.string())).to_pylist() == [dict(zip(names, X.extract_row(lang, e), strict=True)) for e in some]


@pytest.mark.parametrize("name", ["promql_functions", "promql_name_matchers", "logql_label_filters", "traceql_intrinsics"])
def test_a_query_parses_each_row_once(spark, name):
    from signalens.plans import queries as Q

    plan = Q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_work_list_reads_tables(spark):
    from signalens.plans import queries as Q

    assert "ArrowEvalPython" not in Q.queries()["prewarm_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["check_value_unknown", "allowlist_filter", "check_stream_label_unknown"])
def test_checks_of_few_names_need_no_workers(spark, name):
    """Small tables are relations of known size; as lists of rows, each was read by Python workers beside those of the parser."""
    from signalens.plans import queries as Q

    assert "ExistingRDD" not in Q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_local_rows(spark):
    from signalens.operators import tables

    rows = [("a", None, ["x"]), ("é", 2, [])]
    df = tables.local(spark, rows, "s string, n long, l array<string>")
    assert [tuple(r) for r in df.collect()] == rows and df.schema == spark.createDataFrame(rows, "s string, n long, l array<string>").schema
    assert tables.local(spark, [], "s string, t struct<a:int>").collect() == []
