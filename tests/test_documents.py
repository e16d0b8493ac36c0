import gc
import json

import pytest
import yaml
from pyspark.sql import functions as F

from signalens.functions import rules as R
from signalens.functions.wrappers import split_call, unwrap
from signalens.lang.lexing import duration_ms
from signalens.sources import dashboards as D
from signalens.sources import documents as docs
from signalens.sources import yaml_docs as Y

RULES = """
groups:
  - name: g
    interval: 1m
    rules:
      - record: r
        expr: rate(a[5m])
      - alert: A
        expr: rate(b
        for: 5
        labels: {severity: true, n: ~}
"""


def test_rule_groups():
    (g,) = Y.rule_groups(RULES)
    assert g["name"] == "g" and [r["record"] for r in g["rules"]] == ["r", ""]
    assert g["rules"][1]["for"] == "5" and g["rules"][1]["labels"] == {"severity": "true", "n": ""}
    assert Y.rule_groups("") == [] and Y.rule_groups("groups:") == []
    assert Y.rule_groups("x: &b {severity: p}\ngroups: [{name: g, rules: [{alert: a, labels: {<<: *b, k: v}}]}]")[0]["rules"][0]["labels"] == {"severity": "p", "k": "v"}


def test_decoding_is_not_searched_for_garbage():
    """The search took longer the larger a file was."""
    text = "groups:\n" + "".join(f"- name: g{i}\n  rules:\n" + f"  - {{alert: a, labels: {{n: null, t: true, k: {i}}}}}\n" * 50 for i in range(60))
    seen = []
    gc.collect()
    gc.callbacks.append(lambda phase, info: seen.append(phase))
    try:
        groups = Y.load(text)["groups"]
        board = D.decode(json.dumps({"panels": [{"title": "t", "id": i, "targets": []} for i in range(20)]}))
    finally:
        gc.callbacks.pop()
    assert len(groups) == 60 and groups[7]["rules"][49] == {"alert": "a", "labels": {"n": "", "t": "true", "k": "7"}} and len(board["panels"]) == 20
    assert len(seen) <= 2 and gc.isenabled()
    with pytest.raises(yaml.YAMLError):
        Y.load("groups: [")
    assert gc.isenabled()


def test_loader_resolves_as_yaml_does():
    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for v in ("", "~", "null", "Null", "NULL", "nULL", "<<", "=", "no", "1", "1.5", "2001-01-01", "'null'", '"~"', "!!str null", "!!null x", "! ~", "n", "<", "N"):
        ours, theirs = (yaml.compose(f"k: {v}", Loader=x).value[0][1] for x in (Y._Loader, base))
        assert ours.value == theirs.value and all((ours.tag == t) == (theirs.tag == t) for t in Y._TAGS), v


def test_durations_do_not_cast_in_vain(spark):
    """A try_cast of a text that is no number throws within: units that are not given did, twelve times a rule."""
    given = ["12m", "1h30m", "0", "", "5", "1m1h", "1y2w3d4h5m6s7ms", "007s", "99999999999999999999s", None]
    df = spark.createDataFrame([(x,) for x in given], "d string").select("d", R.duration_ms(F.col("d")).alias("ms"))
    want = {x: 0 if x and x.startswith("999") else duration_ms(x) if x is not None else None for x in given}
    assert {r.d: r.ms for r in df.collect()} == want
    assert "try_cast(regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text", ["groups: {a: b}", "groups: [{name: [1]}]", "groups: [{rules: [{labels: [x]}]}]", "a: 1\na: 2", "groups: [", "- a"])
def test_bad_rule_files(text):
    with pytest.raises((Y.ShapeError, yaml.YAMLError)):
        Y.rule_groups(text)


def _dashboard():
    target = lambda **k: {"refId": "A", **k}
    return {
        "title": "t", "uid": "u",
        "panels": [
            {"type": "row", "datasource": {"type": "Loki"}, "panels": [{"title": "in", "targets": [target(expr='{a="$b"}'), target(expr="", query="")], "id": 1}, {"id": 2, "targets": [target(expr="up", datasource="Prometheus")]}], "targets": [target(expr="ignored")]},
            {"id": 3, "title": "", "datasource": None, "targets": [target(query='rate(m{x="[[y]]"}[$__interval])')], "panels": [{"id": 9, "targets": [target(expr="never")]}]},
        ],
        "templating": {"list": [{"query": {"query": "label_values(up, job)"}, "datasource": "prometheus", "type": "query", "name": "v"}, {"query": "1m", "name": "i", "type": "interval"}, {"name": "e", "query": ""}]},
    }


def test_dashboard_decoding():
    d = D.decode(json.dumps(_dashboard()))
    assert [(p["id"], p["datasource"], [t["datasource"] for t in p["targets"]]) for p in d["panels"]] == [(1, "loki", ["loki"]), (2, "loki", ["prometheus"]), (3, "", [""])]
    assert d["variables"] == [{"name": "v", "type": "query", "datasource": "prometheus", "query": "label_values(up, job)"}]
    for bad in ("[", '{"panels": [{"id": "3"}]}', '{"panels": [{"targets": [{"query": {}}]}]}', '{"x": NaN}', "[]"):
        with pytest.raises(D.DashboardError):
            D.decode(bad)
    assert D.decode("{}")["panels"] == [] and D.decode('{"TITLE": "x"}')["title"] == "x"


def test_variable_queries():
    assert unwrap('label_values(up{a=~"x,y"}, job)') == 'up{a=~"x,y"}' and unwrap("label_values(job)") is None
    assert unwrap("query_result( sum(a) )") == "sum(a)" and unwrap("metrics(x)") is None and unwrap("sum(a) + 1") == "sum(a) + 1" and unwrap("rate(x[5m])") == "rate(x[5m])"
    assert split_call("f()") == ("f", []) and split_call("f(a, g(b, c), {d,e})") == ("f", ["a", " g(b, c)", " {d,e}"]) and split_call("f(a) b") is None and split_call("f(a") is None


def test_normalising(spark):
    cases = {
        "rate(a[$__rate_interval])": ("rate(a[5m])", []), "a[$__interval_ms]": ("a[5m]", []), "a{b=\"${c:raw}\",d='[[ e ]]',f=\"$g$c\"}": ("a{b=\"V\",d='V',f=\"VV\"}", ["c", "e", "g"]),
        "${__interval}": ("V", []), "$__range_s": ("V", ["__range_s"]), "": ("", []),
    }
    df = spark.createDataFrame([(k,) for k in cases], "e string").select("e", R.normalised(F.col("e")).alias("n"), R.variables_in(F.col("e")).alias("v"))
    for r in df.collect():
        assert (r.n.replace(R.VARIABLE, "V"), r.v) == cases[r.e]


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "_b.YML").write_text(RULES)
    (tmp_path / "sub" / "a.yaml").write_text("groups: [")
    (tmp_path / ".hidden" / "c.yaml").write_text(RULES)
    (tmp_path / "x.txt").write_text("")
    (tmp_path / "d.json").write_text(json.dumps(_dashboard()))
    assert docs.expand([str(tmp_path)], docs.YAML) == [str(tmp_path / "_b.YML"), str(tmp_path / "sub" / "a.yaml")]
    assert docs.expand([str(tmp_path / "x.txt")], docs.YAML) == [str(tmp_path / "x.txt")]
    with pytest.raises(docs.MissingPath):
        docs.expand([str(tmp_path / "none")], docs.YAML)
    files = docs.contents(docs.path_table(spark, [str(tmp_path)], [], [str(tmp_path)]))
    rules = docs.rule_table(files).orderBy("path", "rule_pos").collect()
    assert [(r.rule, r.prom and r.prom.metricRefs, bool(r.file_error)) for r in rules] == [("r", ["a"], False), ("A", None, False), (None, None, True)]
    assert rules[1].prom.error.startswith("parse: ") and rules[1]["for"] == "5"
    items = docs.dashboard_table(files).where("item <> 'panel'").orderBy("item", "panel_pos").collect()
    assert [(i.panel, i.lang, i.prom and i.prom.metricRefs, i.variables) for i in items] == [("in/A", "logql", None, ["b"]), ("id=2/A", "promql", ["up"], []), ("id=3/A", "promql", ["m"], ["y"]), ("var=v", "promql", ["up"], [])]


def test_decoded_rows_come_in_bounded_batches(monkeypatch):
    """However many rules the files of a batch have, a worker holds a file and AT_ONCE rows; none is lost, nor their order."""
    import pyarrow as pa

    from signalens.sources import documents as docs

    asked = []

    def rows(path, n):
        asked.append(path)
        return ((path, i) for i in range(n))

    files = pa.RecordBatch.from_pydict({"path": ["a", "b", "c", "d"], "n": [5000, 0, 1, 2500]})
    out = docs._decoder(rows, docs._arrow("path string, i int"))(iter([files, files.slice(0, 0)]))
    first = next(out)
    assert first.num_rows == docs.AT_ONCE and asked == ["a"]
    got = [first, *out]
    assert max(b.num_rows for b in got) <= docs.AT_ONCE
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(p, i) for p, n in (("a", 5000), ("c", 1), ("d", 2500)) for i in range(n)]
