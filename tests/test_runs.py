import io
import json
import threading
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from signalens import cli, telemetry
from signalens.sources import catalog as C
from signalens.streaming import watch as W


@pytest.fixture
def server():
    asked = []

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlsplit(self.path)
            asked.append((u.path, parse_qs(u.query).get("match[]", []), self.headers.get("X-T")))
            data = {"/api/v1/label/__name__/values": ["up"], "/api/v1/labels": ["job"], "/api/v1/label/job/values": ["api"], "/loki/api/v1/labels": ["app"], "/loki/api/v1/label/app/values": ["web"]}.get(u.path)
            body = json.dumps({"status": "success", "data": data} if data else {"status": "error", "errorType": "t", "error": "e"} if u.path == "/bad" else {"x": "é" * 600}).encode()
            self.send_response(200 if data or u.path == "/bad" else 500)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_http(server):
    url, asked = server
    p = C.PrometheusHttp(url, {"X-T": "v"})
    assert p.metric_names() == ["up"] and p.label_names([C.scope('u"p'), ""]) == ["job"]
    assert asked[1] == ("/api/v1/labels", ['{__name__="u\\"p"}'], "v")
    for path in ("/bad", "/none"):
        with pytest.raises(C.CatalogError):
            C.get_list(url + path)
    assert C.cut_body(b"x" * 512) == "x" * 512 and C.cut_body(("é" * 300).encode()) == "é" * 256 + "…"


def test_cache(tmp_path):
    now, calls = [1000.0], []
    for store in (C.MemoryStore(), C.FileStore(str(tmp_path))):
        c = C.Catalog(object(), prometheus_source="s", store=store, ttl_seconds=60, clock=lambda: now[0])
        fetch = lambda: calls.append(1) or ["b", "a"]
        calls.clear()
        assert c.cached("promql", "q", fetch) == c.cached("promql", "q", fetch) == ["a", "b"] and len(calls) == 1
        now[0] += 60
        c.cached("promql", "q", fetch)
        assert len(calls) == 1  # still fresh at the very end
        now[0] += 0.1
        c.cached("promql", "q", fetch)
        assert len(calls) == 2 and len(store.keys()) == 1
        c.cached("promql", "none", lambda: calls.append(1) or [])
        c.cached("promql", "none", lambda: calls.append(1) or [])
        assert len(calls) == 4  # an empty list is never a hit
        store.delete(C.key_for("promql", "s", "q"))
        assert store.get(C.key_for("promql", "s", "q")) is None
    with pytest.raises(ValueError):
        C.MemoryStore().put(C.Entry("", "promql", "s", 1, 0, []))
    with pytest.raises(C.CatalogError):
        C.Catalog(object())


def _run(*argv, stdin=""):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(argv), out, err, io.StringIO(stdin)), out.getvalue(), err.getvalue()


def test_extraction_commands(tmp_path):
    code, out, _ = _run("promql", "expr", "up", "-", stdin='rate(a{b="c"}[5m])\n\nrate(\n')
    lines = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and lines[0] == {"expr": "up", "metricRefs": ["up"], "selectors": None, "atModifiers": None, "functions": None}
    assert lines[1]["functions"] == ["rate"] and lines[2]["metricRefs"] is None and lines[2]["error"].startswith("parse: ")
    assert json.loads(_run("traceql", "expr", "{}")[1]) == {"expr": "{}"}
    (tmp_path / "r.yaml").write_text("groups: [{name: g, rules: [{alert: A, expr: up}]}]")
    assert json.loads(_run("promql", "rule-file", str(tmp_path / "r.yaml"))[1])["groups"][0]["rules"][0]["result"]["metricRefs"] == ["up"]
    assert _run()[0] == _run("nope")[0] == _run("promql", "expr")[0] == _run("dashboard", str(tmp_path / "none"))[0] == _run("traceql", "rule-file", "x")[0] == 1


def test_dashboard_command(tmp_path):
    """Language, variables and references of every target and variable, or the error; wrappers of variables are taken off."""
    from test_documents import _dashboard

    d = _dashboard()
    d["panels"][1]["targets"] += [{"refId": "B", "expr": "rate("}]
    d["templating"]["list"] += [{"name": "w", "type": "query", "query": "label_names()"}]
    (tmp_path / "d.json").write_text(json.dumps(d))
    code, out, _ = _run("dashboard", str(tmp_path / "d.json"), "-", stdin="[")
    doc, bad = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and bad["panels"] is None and "error" in bad and doc["title"] == "t" and [p["id"] for p in doc["panels"]] == [1, 2, 3]
    one, two, three = (p["targets"] for p in doc["panels"])
    assert (one[0]["language"], one[0]["variables"], one[0]["logql"]["streamSelectors"]) == ("logql", ["b"], [{"label": "a", "op": "=", "value": "__dashboard_var__"}])
    assert two[0]["promql"]["metricRefs"] == ["up"] and two[0]["datasource"] == "prometheus" and "error" not in two[0] and "variables" not in two[0]
    assert three[0]["expr"] == 'rate(m{x="[[y]]"}[$__interval])' and three[0]["promql"]["expr"] == 'rate(m{x="__dashboard_var__"}[5m])' and three[0]["variables"] == ["y"]
    assert three[1]["error"].startswith("parse: ") and "promql" not in three[1] and three[1]["language"] == "promql"
    v, w = doc["variables"]
    assert (v["type"], v["query"], v["promql"]["metricRefs"]) == ("query", "label_values(up, job)", ["up"]) and w == {"name": "w", "type": "query", "query": "label_names()", "language": "promql"}


def test_rules_of_dashboards_in_python_and_in_spark(spark):
    from pyspark.sql import functions as F

    from signalens.functions import python_rules as P
    from signalens.functions import rules as R

    exprs = ["", "up", " \t{a}", "\u00a0{a}", "$a ${b:raw} [[c]] [[ d:x ]] $__interval $__range_x ${__from}", "$é $1 $_x $$y ${a", "rate(m[$__rate_interval]) $__org", "$__interval_ms[[x]]$__intervals"]
    sources = ["", "prometheus", "x-loki", "mixed", "grafana-mimir"]
    df = spark.createDataFrame([(e, s) for e in exprs for s in sources], "e string, s string")
    known = R.language_of(F.col("s"))
    for r in df.select("e", "s", R.normalised(F.col("e")).alias("n"), R.variables_in(F.col("e")).alias("v"), F.when(known == "unknown", R.guessed_language(F.col("e"))).otherwise(known).alias("lang")).collect():
        assert (P.normalised(r.e), P.variables(r.e), P.language(r.s, r.e)) == (r.n, r.v, r.lang), r


def test_prewarm_goes_on_after_failures(spark):
    class Client:
        asked: list = []

        def metric_names(self):
            return ["a", "b"]

        def label_names(self, matchers):
            self.asked.append(matchers[0])
            if "bad" in matchers[0]:
                raise C.CatalogError(f"no {matchers[0]}")
            return ["x"]

        def label_values(self, label, matchers):
            return ["1"]

    plan = spark.createDataFrame([("promql", "names", "", ""), ("promql", "labels", "bad1", ""), ("promql", "labels", "ok", ""), ("promql", "labels", "bad2", ""), ("promql", "values", "ok", "x")], "lang string, task string, metric string, label string")
    m, c = telemetry.Metrics(), C.Catalog(Client(), prometheus_source="s", jobs=0)
    c.observe = m.observe_prewarm
    with pytest.raises(C.CatalogError) as e:
        c.snapshot(spark, plan)
    assert "bad1" in str(e.value) and "bad2" in str(e.value) and len(Client.asked) == 3
    assert len(c.store.keys()) == 3  # what was got is kept
    assert "signalens_prewarm_duration_seconds_count 1\n" in m.text() and 'signalens_prewarm_duration_seconds_bucket{le="+Inf"} 1\n' in m.text()


def test_stored_entries(tmp_path):
    s = C.FileStore(str(tmp_path))
    for query, values, where in ((C.NAMES, ["b", "a", "b"], "metric_names"), (C.METRIC_LABELS.format("m"), ["l"], "label_names"), (C.METRIC_VALUES.format("m:x", "job"), ["v"], "label_values"), (C.STREAM_VALUES.format("app"), ["w"], "label_values"), (C.LABEL_NAMES, [], "label_names")):
        e = C.Entry(query, "promql", "src", 1700000000.5, 60, values, series_count=3)
        s.put(e)
        with open(s._path("promql", e.key)) as f:
            doc = json.load(f)
        assert set(doc) == {"schema_version", "query", "language", "source", "fetched_at", "ttl_seconds", "result"} and doc["fetched_at"] == "2023-11-14T22:13:20.500000Z"
        want = sorted(set(values))
        assert doc["result"] == {where: {query.rpartition(":")[2]: want} if where == "label_values" else want, "series_count": 3}
        got = s.get(e.key)
        assert got.values == want and got.fetched_at == 1700000000.5 and got.series_count == 3
    e = C.Entry("q", "logql", "src", 1.0, 0, None, error="gone")
    s.put(e)
    assert s.get(e.key).error == "gone" and s.get(e.key).values is None
    (tmp_path / "v1/promql/x.json").write_text('{"query": 1}')
    with pytest.raises((KeyError, ValueError)):
        s.get("x")


def test_catalog_source(spark, server):
    url, asked = server
    C.register(spark)
    read = lambda **o: spark.read.format("signal_catalog").options(url=url, **o).load()
    assert [tuple(r) for r in read(**{"header.X-T": "tenant"}).collect()] == [("up", None, None)] and asked[-1][2] == "tenant"
    m = read(metrics="up,down")
    assert m.rdd.getNumPartitions() == 2 and sorted(tuple(r) for r in m.collect()) == [("down", "job", "api"), ("up", "job", "api")]
    assert [tuple(r) for r in read(lang="logql").collect()] == [("", "app", "web")]


def test_validation_commands(spark, tmp_path, server):
    url, asked = server
    (tmp_path / "r.yaml").write_text("groups: [{name: g, interval: 1m, rules: [{alert: A, expr: 'up{job=\"apx\"} + upp', for: 5m, labels: {severity: p}, annotations: {summary: s, description: d}}]}]")
    (tmp_path / "l.yaml").write_text("groups: [{name: g, rules: [{record: B, expr: 'rate({app=\"x\"}[5m])'}]}]")
    args = ["--prometheus-rules", str(tmp_path / "r.yaml"), "--loki-rules", str(tmp_path / "l.yaml")]
    assert _run("lint", *args)[0] == 0
    code, out, _ = _run("validate", *args, "--prometheus-url", url, "--loki-url", url, f"--output={tmp_path}/o.json", "--format=json")
    doc = json.loads((tmp_path / "o.json").read_text())
    assert code == 2 and out == "" and doc["filesScanned"] == 2
    assert sorted((f["code"][:4], tuple(f.get("suggestions", []))) for f in doc["findings"]) == [("E101", ("up",)), ("E103", ("api",)), ("E202", ("web",))]
    assert sum(a[0] == "/api/v1/label/__name__/values" for a in asked) == 1
    assert _run("check", *args, "--prometheus-url", url, "--exit-zero")[0] == 0
    assert _run("validate", *args, "--prometheus-url", url, "--loki-url", url, f"--output={tmp_path}/parts/", "--format=tsv")[:2] == (2, "")
    lines = [x for f in sorted((tmp_path / "parts").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == _run("validate", *args, "--prometheus-url", url, "--loki-url", url, "--format=tsv")[1].splitlines() and len(lines) == 3
    assert _run("lint", *args, f"--output={tmp_path}/parts/", "--format=json")[0] == 2
    assert _run("validate", *args, "--offline", "--prometheus-url", "http://127.0.0.1:1")[0] == 0
    assert _run("validate", *args, "--prometheus-url", "http://127.0.0.1:1")[0] == 2
    for bad in (["lint"], ["check", *args], ["lint", *args, "--format", "x"], ["lint", "--prometheus-rules", str(tmp_path / "none")], ["lint", "--what"]):
        assert _run(*bad)[0] == 2


def test_watcher(tmp_path):
    (tmp_path / "a.yaml").write_text("1")
    now, results, ready = [0.0], [], []
    files = {"a": (1, 1)}
    w = W.Watcher([str(tmp_path)], lambda: 1 / (len(results) != 1), lambda r, e: results.append(e is None), lambda: ready.append(1), debounce_s=1, refresh_s=100, poll_s=0.001, clock=lambda: now[0], look=lambda _: dict(files))
    t = threading.Thread(target=w.loop)
    t.start()

    def until(n):
        end = time.time() + 5
        while len(results) < n and time.time() < end:
            time.sleep(0.005)
        time.sleep(0.03)
        return len(results)

    assert until(1) == 1  # at once
    files["a"] = (2, 1)
    time.sleep(0.05)
    now[0] = 0.9
    files["a"] = (3, 1)  # starts the wait anew
    time.sleep(0.05)
    now[0] = 1.5
    time.sleep(0.05)
    assert len(results) == 1
    now[0] = 2.0
    assert until(2) == 2
    now[0] = 101
    assert until(3) == 3  # refresh
    w.stop()
    t.join(5)
    assert results == [True, False, True] and ready == [1]


def test_fingerprints(tmp_path):
    (tmp_path / ".git").mkdir()
    for n in ("a.YAML", "b.json", "c.txt", ".git/d.yml"):
        (tmp_path / n).write_text("1")
    one = W.fingerprint([str(tmp_path)])
    assert sorted(p.rpartition("/")[2] for p in one) == ["a.YAML", "b.json"]
    (tmp_path / "a.YAML").write_text("22")
    (tmp_path / "b.json").unlink()
    (tmp_path / "e.yml").write_text("")
    assert [op for _, op in W.changes(one, W.fingerprint([str(tmp_path)]))] == ["changed", "deleted", "created"]


def test_stream(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("1")
    passes = []
    q = W.start_stream(spark, [str(tmp_path)], lambda: len(passes), lambda r, e: passes.append((r, e)), str(tmp_path / "ck"), "100 milliseconds")
    try:
        end = time.time() + 60
        while len(passes) < 1 and time.time() < end:
            time.sleep(0.1)
        (tmp_path / "a.yaml").write_text("edited in place")
        while len(passes) < 2 and time.time() < end:
            time.sleep(0.1)
    finally:
        q.stop()
    assert passes[:2] == [(0, None), (1, None)]


def test_telemetry():
    m = telemetry.Metrics("v")
    m.observe_run([{"code": "E1", "severity": "error", "category": "lint"}], {"promql": 2}, 0.3)
    m.observe_run([], {}, 70, failed=True)
    m.observe_run([{"code": "E2", "severity": "error", "category": "lint", "n": 5}], {}, 0.1)
    assert 'signalens_findings_total{code="E2",severity="error",category="lint"} 5\n' in m.text()
    m = telemetry.Metrics("v")
    m.observe_run([{"code": "E1", "severity": "error", "category": "lint"}], {"promql": 2}, 0.3)
    m.observe_run([], {}, 70, failed=True)
    s = telemetry.serve(m, "127.0.0.1", 0)
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{p}").read().decode()
    text = get("/metrics")
    for line in ('findings_total{code="E1",severity="error",category="lint"} 1', 'last_run_findings{severity="error"} 1', 'runs_total{outcome="errors"} 1', 'runs_total{outcome="failed"} 1', 'run_duration_seconds_bucket{le="0.5"} 1', 'run_duration_seconds_bucket{le="+Inf"} 2', "files_scanned_total 2"):
        assert f"signalens_{line}\n" in text
    with pytest.raises(urllib.error.HTTPError) as e:
        get("/readyz")
    assert e.value.code == 503
    m.is_ready = True
    assert get("/readyz") == "ready\n" and get("/healthz") == "ok\n"
    s.shutdown()


@pytest.mark.parametrize("n", [0, 1, 40])
def test_documents_are_written_by_executors(spark, tmp_path, monkeypatch, n):
    """The text of a report in memory, without collecting findings: hidden characters, no file, a file called like its stand-in."""
    from datetime import datetime, timezone

    from signalens.operators import findings as fd
    from signalens.plans import report

    files, says = ["", "<unknown>", "b&.yaml", "é.yaml", "a.yaml"], ['x "q" \\ <&>', "line\nbreak\ttab", "  ü", "[]"]
    rows = [(("E001_X", "W401_Y", "I9")[i % 3], ("error", "warning", "info")[i % 3], "lint", (files[i % 5], i % 4, f"g{i % 2}", "r", "p" if i % 7 == 0 else ""), says[i % 4], ["s1", "s2"] if i % 3 == 0 else None, ("m" if i % 2 else "", "", "", "e"), i) for i in range(n)]
    found, at = spark.createDataFrame(rows, fd.SCHEMA).repartition(5), datetime(2024, 5, 6, tzinfo=timezone.utc)
    want = {f: report.render(fd.ordered(found), f, n, at) for f in ("json", "junit", "sarif")}
    monkeypatch.setattr(report, "collected", None)
    for f, text in want.items():
        report.write_document(found, f, f"file://{tmp_path}/{f}", n, at)
        assert (tmp_path / f).read_text(encoding="utf-8", newline="") == text
    with pytest.raises(ValueError):
        report.write_document(found, "tsv", f"file://{tmp_path}/tsv")
