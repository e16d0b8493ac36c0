import random

import pytest
from pyspark.sql import functions as F

from signalens.functions.extract import logql_extract, promql_extract, register
from signalens.operators import checks, lint, suggest
from signalens.operators import findings as fd
from signalens.plans import report
from signalens.sources import allowlist
from signalens.sources.allowlist import Allowlist
from signalens.sources.catalog import Tables


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.createDataFrame
    return Tables(
        d([("up",), ("http_requests_total",)], "metric string"), d([("up", "job"), ("http_requests_total", "code")], "metric string, label string"), d([("up", "job", "api"), ("up", "job", "web")], "metric string, label string, value string"),
        d([("app",)], "label string"), d([("app", "api")], "label string, value string"),
    )


def _found(spark, tables, exprs, lang="promql", allow=None, **kw):
    none = F.lit("")
    f = promql_extract if lang == "promql" else logql_extract
    df = spark.createDataFrame([(e,) for e in exprs], "expr string").select(F.col("expr").alias("path"), none.alias("group"), none.alias("rule"), none.alias("panel"), "expr", f("expr").alias("r"))
    parts = (checks.check_promql if lang == "promql" else checks.check_logql)(df, tables, allow or Allowlist(), **kw)
    return sorted((r.source.file, r.code[:4], r.message, r.suggestions) for r in fd.union(spark, parts).collect())


def test_promql_checks(spark, tables):
    got = _found(spark, tables, ["upp", 'up{jbo="x"}', 'up{job="apy"}', 'up{job=~"zzz"}', 'up{job="api"}', 'nope{job="x"}', 'up{x="1"} + up{x="1"}', "rate(up"])
    assert [(a, b, d) for a, b, _, d in got] == [("nope{job=\"x\"}", "E101", ["up"]), ("upp", "E101", ["up"]), ('up{jbo="x"}', "E102", ["job"]), ('up{job="apy"}', "E103", ["api", "web"]), ('up{x="1"} + up{x="1"}', "E102", ["job"]), ('up{x="1"} + up{x="1"}', "E102", ["job"])]
    assert got[3][2] == 'value "apy" not observed for label "job" on metric "up"'


def test_logql_checks(spark, tables):
    got = _found(spark, tables, ['{aap="x"}', '{app="apo"}', '{app="api"}', '{app=~"q"}'], "logql")
    assert [(a, b, d) for a, b, _, d in got] == [('{aap="x"}', "E201", ["app"]), ('{app="apo"}', "E202", ["api"])]


def test_allowlist(spark, tables):
    a = allowlist.parse("metrics: [{pattern: 'up*', reason: r}, {pattern: ''}]\nlabels: [{metric: up, patterns: ['j*']}, {patterns: [x]}]\nlabel_values: [{metric: '*', label: job, patterns: ['ap*']}]")
    assert a.metrics == [("up*", "r")] and a.labels == [("up", "j*", "")] and a.values == [("*", "job", "ap*", "")]
    assert _found(spark, tables, ["upp", 'up{jbo="x"}', 'up{job="apy"}', 'upp{q="1"}'], allow=a) == []
    assert allowlist.parse("") == Allowlist() == allowlist.parse(None)
    assert [x[1] for x in _found(spark, tables, ['{aap="x"}'], "logql", Allowlist(labels=[("up", "*", "")]))] == ["E201"]
    assert _found(spark, tables, ['{aap="x"}'], "logql", Allowlist(labels=[("*", "aa*", "")])) == []


def test_no_catalog(spark, tables):
    assert _found(spark, Tables(), ["nope"]) == []
    with pytest.raises(ValueError):
        _found(spark, Tables(tables.metrics.where("false"), tables.labels, tables.values), ["nope"])


def test_dashboard_variables_are_checked_unless_left_out(spark, tables):
    e = ['up{job="__dashboard_var__"}']
    assert [x[1] for x in _found(spark, tables, e)] == ["E103"] and _found(spark, tables, e, skip_variables=True) == []


def test_suggestions(spark):
    d = spark.createDataFrame
    q, c = d([("abc",), ("",), ("é",)], "query string"), d([("abd",), ("abe",), ("abc",), ("xyz1",), ("e",), ("abcdef",)], "name string")
    got = {}
    for r in suggest.ranked(q, c, k=2).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.name, r.dist))
    assert got == {"abc": [("abc", 0), ("abd", 1)], "é": [("e", 2), ("abc", 3)]}
    assert suggest.ranked(q, c, k=0).count() == 0 and [r.dist for r in suggest.ranked(q, c, distance=-1).collect()] == [0]


def _rules(spark, rows):
    cols = "kind string, file_pos int, path string, group_pos int, rule_pos int, group string, interval string, rule string, alert string, expr string, `for` string, labels map<string,string>, annotations map<string,string>"
    return spark.createDataFrame(rows, cols)


def test_lint(spark):
    ok = {"summary": "s", "description": "d"}
    rows = [
        ("promql", 0, "a", 0, 0, "g", "1m", "A", "A", "x", "30s", {"severity": "p"}, ok),
        ("promql", 0, "a", 0, 1, "g", "1m", "A", "A", "\u00a0\t", "1m", {}, {"summary": " \n"}),
        ("logql", 0, "b", 0, 0, "", "60s", "A", "A", "x", "bad", {"severity": "p"}, ok),
        ("promql", 1, "c", 0, 0, "g", "", "r", "", " ", "1s", {}, {}),
    ]
    got = [(r.code[:4], r.source.file, r.message) for r in fd.ordered(fd.union(spark, lint.lint(_rules(spark, rows)))).collect()]
    assert got == [
        ("E301", "a", "alert is missing required label `severity`"), ("E302", "a", "alert is missing required annotation `description`"), ("E302", "a", "alert is missing required annotation `summary`"),
        ("E303", "a", "alert name `A` is also defined at a:g"), ("W401", "a", "alert `for` (30s) is less than group `interval` (1m)"), ("W402", "a", "rule expression is empty"),
        ("E303", "b", "alert name `A` is also defined at a:g"), ("W402", "c", "rule expression is empty"),
    ]
    n = lambda c: fd.union(spark, lint.lint(_rules(spark, rows), c)).count()
    assert n(lint.ZERO) == n(lint.Config())  # nothing asked for means the defaults
    assert n(lint.Config(False, (), "", False, False)) == n(lint.Config()) and n(lint.Config(True, (), "off", False, False)) == 1


@pytest.fixture(scope="module")
def three(spark):
    src = ("f", 3, "g", "r", "")
    rows = [
        ("E101_METRIC_UNKNOWN", "error", "catalog", src, 'a\t"b"\n100%', ["x", "y"], ("m", "", "", "e"), 0),
        ("W402_EMPTY_EXPR", "warning", "lint", ("f", 0, "", "", "p"), "w", None, ("", "", "", ""), 0),
        ("I901_X", "info", "lint", ("", 0, "", "", ""), "i", None, ("", "", "", ""), 0),
    ]
    return spark.createDataFrame(rows, fd.SCHEMA).orderBy("code")


def test_outcomes(spark, three):
    assert {r.severity: r.n for r in fd.by_severity(three).collect()} == {"error": 1, "warning": 1, "info": 1}
    v = lambda f: tuple(fd.verdict(f).first())
    assert v(three) == ("errors", 2) and v(three.where("severity <> 'error'")) == ("warnings", 1) and v(three.where("severity = 'info'")) == ("clean", 0) and v(fd.none(spark)) == ("clean", 0)


def test_reports(three):
    import json
    import xml.etree.ElementTree as ET

    text = report.render(three, "text")
    assert 'ERROR E101_METRIC_UNKNOWN: a\t"b"\n100%\n  at f:3 (g/r)\n  suggestions: x, y\n' in text and "  at f (panel=p)\n" in text and "INFO I901_X: i\n" in text
    assert '::error file=f,line=3,title=E101_METRIC_UNKNOWN::a\t"b"%0A100%25\n' in report.render(three, "github-actions")
    assert 'error\tE101_METRIC_UNKNOWN\tcatalog\tf\t3\tg\tr\ta\\t"b"\\n100%\n' in report.render(three, "tsv")
    first = json.loads(report.render(three, "ndjson").splitlines()[0])
    assert first["source"] == {"file": "f", "line": 3, "group": "g", "rule": "r"} and first["suggestions"] == ["x", "y"] and first["context"] == {"metric": "m", "expr": "e"}
    doc = json.loads(report.render(three, "json", 4))
    assert doc["schemaVersion"] == 1 and doc["filesScanned"] == 4 and doc["findings"][0] == first and doc["findings"][1]["source"] == {}
    suites = ET.fromstring(report.render(three, "junit").split("\n", 1)[1])
    assert [(s.get("name"), s.get("tests"), s.get("failures"), s.get("skipped")) for s in suites] == [("<unknown>", "1", "0", "1"), ("f", "2", "2", "0")]
    run = json.loads(report.render(three, "sarif"))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["E101_METRIC_UNKNOWN", "I901_X", "W402_EMPTY_EXPR"] and [r["level"] for r in run["results"]] == ["error", "note", "warning"]
    with pytest.raises(ValueError):
        report.render(three, "nope")


def test_reports_in_parts(spark, three, tmp_path):
    import glob

    for fmt in report.ROWS:
        text, found = report.rendered(three, fmt)
        assert text == report.render(three, fmt) and found == report.collected(three)
        report.write(three.orderBy("code"), fmt, f"file://{tmp_path}/{fmt}")
        parts = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/{fmt}/part-*")))
        assert parts.rstrip("\n") == text.rstrip("\n")
    with pytest.raises(ValueError):
        report.write(three, "sarif", str(tmp_path))


def test_numbering_without_one_task_for_all(spark):
    from signalens.operators.tables import numbered

    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS id", "id % 3 AS k").repartition(7)
    got = numbered(df, "k", "id").collect()
    assert [r.position for r in sorted(got, key=lambda r: (r.k, r.id))] == list(range(1, 5001))
    assert numbered(df.where("false"), "id").count() == 0


def test_scratch_tables(spark):
    from signalens.operators.tables import scratch, tidy, written

    made = []

    @tidy
    def inner():
        a, b, c = (written(spark.range(n), "t") for n in (1, 2, 3))
        made.extend((a, b, c))
        return a.join(b, "id", "left"), a

    there = lambda df: len(spark.read.parquet(*{f.rpartition("/")[0] for f in df}).collect())
    files = []
    with scratch() as keep:
        left, one = inner()
        files = [df.inputFiles() for df in made[:2]]
        assert left.count() == 1 and one.count() == 1
        with pytest.raises(Exception, match="(?i)path|file"):
            made[2].collect()
        keep(made[1])
    assert there(files[1]) == 2
    with pytest.raises(Exception, match="(?i)path|file"):
        there(files[0])


def test_quoted(spark):
    from pyspark.sql import functions as F

    from signalens.functions import rules as R

    cases = {'a"b\\c': r'"a\"b\\c"', "\a\b\f\n\r\t\v": r'"\a\b\f\n\r\t\v"', "é 日本 😀": '"é 日本 😀"', "\x00\x7f": r'"\x00\x7f"', "\u00a0\u200b\ufeff": r'"\u00a0\u200b\ufeff"', "\U000e0001": r'"\U000e0001"', "": '""'}
    df = spark.createDataFrame(list(cases.items()), "c string, want string")
    assert [(r.got, r.want) for r in df.select(R.quoted(F.col("c")).alias("got"), "want").collect() if r.got != r.want] == []


def test_allowlists_have_a_bound(monkeypatch):
    from signalens.sources import allowlist

    monkeypatch.setattr(allowlist, "MOST", 2)
    allowlist.Allowlist([("a", ""), ("b", "")])
    with pytest.raises(ValueError):
        allowlist.Allowlist([("a", ""), ("b", ""), ("c", "")])


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("""SELECT promql_extract('rate(a{b="c"}[5m])').functions[0]""").first()[0] == "rate"
    assert [tuple(r) for r in spark.sql("""SELECT * FROM promql_selectors('a{b="c"}')""").collect()] == [("a", "b", "=", "c")]


def test_duplicates_against_a_loop(spark):
    """One name in two thirds of the rules, in both languages, a file that is given twice, names that are empty or null."""
    rng, rows = random.Random(7), []
    for kind in ("logql", "promql"):
        for pos, path in enumerate(("a.yaml", "b.yaml", "b.yaml", "c.yaml")):
            for g in range(3):
                for r in range(12):
                    name = rng.choice(["Hot"] * 8 + [None, "", f"once-{kind}-{pos}-{g}-{r}", rng.choice("xyz")])
                    rows.append((kind, pos, path, g, r, rng.choice(["g", ""]), name, name or "rec"))
    table = spark.createDataFrame(rows, "kind string, file_pos int, path string, group_pos int, rule_pos int, `group` string, alert string, rule string").repartition(5)
    first, want = {}, []
    for kind, _, path, _, _, group, name, rule in sorted(rows, key=lambda x: (x[0] != "promql", *x[1:2], *x[3:5])):
        if name in first:
            want.append((path, group, rule, f"alert name `{name}` is also defined at {first[name]}"))
        elif name:
            first[name] = f"{path}:{group}" if group else path
    got = [tuple(r) for r in lint.duplicates(table).select("path", "group", "rule", "message").collect()]
    assert sorted(got) == sorted(want) and len(want) > 150
    assert lint.duplicates(table.where("false")).count() == 0
    by = [r.seq for r in lint.duplicates(table.where("kind = 'promql' and file_pos = 0 and alert = 'Hot'")).orderBy("seq").collect()]
    assert len(by) == len(set(by))
