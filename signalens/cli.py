"""Command line: extraction of single expressions, rule files and dashboards; lint, check, validate; watching.

Extraction commands exit with 0 even where an expression does not parse (the error is in the output) and with 1 on usage and
I/O errors. lint, check and validate exit with 0 if clean, 1 on warnings and 2 on errors, wrong usage or a failed run.
"""

from __future__ import annotations

import argparse
import concurrent.futures
import json
import re
import sys
import threading
import time

from signalens import telemetry
from signalens.functions import python_rules
from signalens.functions.extract import _FIELDS, extract_row
from signalens.functions.wrappers import unwrap
from signalens.lang.lexing import duration_ms

USAGE, CLEAN, WARNINGS, ERRORS = 1, 0, 1, 2
MAX_LINE = 4 << 20


def main(argv: list[str] | None = None, out=None, err=None, stdin=None) -> int:
    argv, out, err, stdin = sys.argv[1:] if argv is None else argv, out or sys.stdout, err or sys.stderr, stdin or sys.stdin
    if not argv:
        print("usage: promql|logql|traceql expr ..., promql|logql rule-file ..., dashboard ..., lint|check|validate ...", file=err)
        return USAGE
    head, rest = argv[0], argv[1:]
    try:
        if head in ("promql", "logql", "traceql"):
            if rest[:1] == ["expr"]:
                return _exprs(head, rest[1:], out, stdin)
            if rest[:1] == ["rule-file"] and head != "traceql":
                return _files(head, rest[1:], out, stdin)
        elif head == "dashboard":
            return _files("dashboard", rest, out, stdin)
        elif head in ("lint", "check", "validate"):
            return validation(head, rest, out, err)
    except OSError as e:
        print(f"error: {e}", file=err)
        return USAGE
    print(f"unknown command: {' '.join(argv[:2])}", file=err)
    return USAGE


def _line(obj: dict) -> str:
    return json.dumps(obj, ensure_ascii=False)


def expression(lang: str, expr: str) -> dict:
    """The references of an expression as they are written out: lists are null where it does not parse."""
    row = extract_row(lang, expr)
    out = dict(zip(["expr", *_FIELDS[lang][1]], row, strict=False))
    if lang == "traceql":
        out = {k: v for k, v in out.items() if k == "expr" or v}
    elif row[-1] is None:
        out = {k: v if v or k in ("expr", "metricRefs", "streamSelectors") or k == "selectors" else None for k, v in out.items()}
        if lang == "promql" and not out["selectors"]:
            out["selectors"] = None
    return out | ({"error": row[-1]} if row[-1] else {})


def _exprs(lang: str, args: list[str], out, stdin) -> int:
    if not args:
        raise OSError("no expression given")
    for a in args:
        if a != "-":
            print(_line(expression(lang, a)), file=out)
            continue
        for raw in stdin:
            text = raw.rstrip("\n").removesuffix("\r")
            if len(text.encode()) > MAX_LINE:
                raise OSError("line too long")
            if text:
                print(_line(expression(lang, text)), file=out)
    return 0


def _files(kind: str, paths: list[str], out, stdin) -> int:
    import yaml

    from signalens.sources import dashboards, yaml_docs

    if not paths:
        raise OSError("no file given")
    for p in paths:
        if p == "-":
            text = stdin.read()
        else:
            with open(p, encoding="utf-8", errors="replace") as f:
                text = f.read()
        doc: dict = {"path": p}
        try:
            if kind == "dashboard":
                doc |= {"panels": None}
                doc |= dashboard(dashboards.decode(text))
            else:
                doc["groups"] = rule_groups(kind, yaml_docs.rule_groups(text))
        except (yaml.YAMLError, ValueError) as e:
            doc["error"] = str(e)
        print(_line(doc), file=out)
    return 0


def rule_groups(lang: str, groups: list[dict]) -> list[dict]:
    """Decoded groups with the references of every rule, or the error; what is empty is left out."""

    def rule(r: dict) -> dict:
        got = expression(lang, r["expr"])
        error = got.pop("error", "")
        return {k: v for k, v in r.items() if v and k != "expr"} | {"result": got} | ({"error": error} if error else {})

    return [{"name": g["name"]} | ({"interval": g["interval"]} if g["interval"] else {}) | {"rules": [rule(r) for r in g["rules"]]} for g in groups]


def dashboard(d: dict) -> dict:
    """A decoded dashboard with the language, the variables and the references of every target and variable; what is empty is left out."""
    filled = lambda x: {k: v for k, v in x.items() if v or k in ("language", "expr", "name")}

    def query(raw: str, datasource: str, wrapped: bool) -> dict:
        lang, names, text = python_rules.language(datasource, raw), python_rules.variables(raw), python_rules.normalised(raw)
        text = unwrap(text) if wrapped and lang == "promql" else text
        got = expression(lang, text) if text is not None else {}
        error = got.pop("error", "")
        return {"language": lang, "variables": names, lang: None if error else got, "error": error}

    panels = []
    for p in d["panels"]:
        targets = [filled({"refId": t["ref_id"], "datasource": t["datasource"], "expr": t["expr"]} | query(t["expr"], t["datasource"], False)) for t in p["targets"]]
        panels.append({k: v for k, v in {"id": p["id"], "title": p["title"], "type": p["type"], "datasource": p["datasource"], "targets": targets}.items() if v})
    variables = [filled({"name": v["name"], "type": v["type"], "datasource": v["datasource"], "query": v["query"]} | query(v["query"], v["datasource"], True)) for v in d["variables"]]
    head = {k: d[k] for k in ("title", "uid") if d[k]} | {"panels": panels}
    return head | ({"variables": variables} if variables else {})


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


def _seconds(text: str) -> float:
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return float(text)
    ms = duration_ms(text)
    if ms is None:
        raise ValueError(f"bad duration {text!r}")
    return ms / 1000


def options() -> argparse.ArgumentParser:
    p, flag = _Parser(add_help=False), lambda s: s.lower() in ("1", "t", "true", "yes")
    for name in ("prometheus-rules", "loki-rules", "dashboards"):
        p.add_argument(f"--{name}", action="append", default=[])
    for name in ("prometheus-url", "loki-url", "allowlist", "cache-dir", "listen"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--prometheus-header", action="append", default=[])
    for name in ("offline", "exit-zero", "no-lint-defaults", "require-severity", "watch", "skip-dashboard-vars"):
        p.add_argument(f"--{name}", nargs="?", const=True, default=name == "require-severity", type=flag)
    p.add_argument("--output", default="-")
    p.add_argument("--format", default="text")
    p.add_argument("--jobs", type=int, default=4)
    p.add_argument("--deadline", default="0")
    p.add_argument("--watch-debounce", default="500ms")
    p.add_argument("--catalog-refresh", default="0")
    return p


def settings(mode: str, o: argparse.Namespace):
    """What a mode does: lint never asks a catalog, check never lints but needs a catalog, validate does both where it can."""
    from signalens.operators import lint
    from signalens.plans.validate import Settings
    from signalens.sources import allowlist
    from signalens.sources.catalog import Catalog, FileStore, LokiHttp, PrometheusHttp

    config = lint.ZERO if o.no_lint_defaults else lint.Config()
    config = lint.Config(o.require_severity, config.require_annotations, config.for_lt_interval, config.duplicate_alerts, config.empty_expr)
    catalog = None
    if mode != "lint" and not (mode == "validate" and o.offline) and (o.prometheus_url or o.loki_url):
        headers = {}
        for h in o.prometheus_header:
            k, eq, v = h.partition("=")
            if not eq or not k:
                raise ValueError(f"bad header {h!r}, expected K=V")
            headers[k] = v
        catalog = Catalog(
            PrometheusHttp(o.prometheus_url, headers) if o.prometheus_url else None, LokiHttp(o.loki_url) if o.loki_url else None,
            prometheus_source=o.prometheus_url, loki_source=o.loki_url, store=FileStore(o.cache_dir) if o.cache_dir else None, jobs=o.jobs,
        )
    if mode == "check" and catalog is None:
        raise ValueError("check needs a catalog")
    return Settings(None if mode == "check" else config, catalog, allowlist.load(o.allowlist), o.skip_dashboard_vars)


def validation(mode: str, argv: list[str], out, err) -> int:
    from signalens.operators import findings
    from signalens.operators.tables import scratch, written
    from signalens.plans import report
    from signalens.plans.validate import Inputs, validate

    try:
        o = options().parse_args(argv)
        inputs = Inputs(o.prometheus_rules, o.loki_rules, o.dashboards)
        if inputs.empty:
            raise ValueError("no inputs: give --prometheus-rules, --loki-rules or --dashboards")
        if o.format not in report.FORMATS:
            raise ValueError(f"unknown format {o.format!r}")
        if o.output.endswith("/") and o.format not in report.ROWS:
            raise ValueError(f"{o.format} is one document: it cannot go to a folder")
        deadline, debounce, refresh = _seconds(o.deadline), _seconds(o.watch_debounce), _seconds(o.catalog_refresh)
        conf = settings(mode, o)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=err)
        return ERRORS
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("signalens").config("spark.ui.showConsoleProgress", "false").getOrCreate()

    def once() -> tuple[list[dict], dict[str, int]]:
        with scratch():
            r = validate(spark, inputs, conf)
            if o.output.endswith("/"):  # a folder: lines are written where they are, and only counts come back
                f = written(r.findings, "findings")
                report.write(findings.ordered(f), o.format, o.output)
                return [x.asDict() for x in findings.counts(f).collect()], r.files_by_kind
            text, found = report.rendered(r.findings, o.format, r.files_scanned)
        if o.output == "-":
            out.write(text)
        else:
            with open(o.output, "w", encoding="utf-8") as f:
                f.write(text)
        return found, r.files_by_kind

    if mode == "validate" and o.watch:
        return watch(inputs, once, debounce, refresh, o.listen, err, catalog=conf.catalog)
    try:
        if deadline > 0:
            found, _ = concurrent.futures.ThreadPoolExecutor(1).submit(once).result(timeout=deadline)
        else:
            found, _ = once()
    except concurrent.futures.TimeoutError:
        spark.sparkContext.cancelAllJobs()
        print("error: deadline exceeded", file=err)
        return ERRORS
    except Exception as e:
        print(f"error: {e}", file=err)
        return ERRORS
    return CLEAN if o.exit_zero else exit_code(found)


def exit_code(found: list[dict]) -> int:
    worst = {f["severity"] for f in found}
    return ERRORS if "error" in worst else WARNINGS if "warning" in worst else CLEAN


def watch(inputs, once, debounce: float, refresh: float, listen: str, err, stop: threading.Event | None = None, catalog=None) -> int:
    """Until interrupted; each pass is logged and counted, and so is how long the catalog takes. Fails if the probes' address cannot
    be had."""
    from signalens.streaming.watch import Watcher

    metrics, log = telemetry.Metrics(), telemetry.logger(stream=err)
    if catalog is not None:
        catalog.observe = metrics.observe_prewarm
    server = None
    if listen:
        host, _, port = listen.rpartition(":")
        try:
            server = telemetry.serve(metrics, host or "0.0.0.0", int(port))
        except (OSError, ValueError) as e:
            print(f"error: {e}", file=err)
            return ERRORS
    began = [time.monotonic()]

    def run():
        began[0] = time.monotonic()
        return once()

    def result(got, error) -> None:
        seconds = time.monotonic() - began[0]
        found, files = got if got else ([], {})
        metrics.observe_run(found, files, seconds, failed=error is not None)
        log.info("pass failed: %s", error) if error else log.info("pass ended: %d findings in %.2f s", sum(f.get("n", 1) for f in found), seconds)

    w = Watcher(inputs.prometheus_rules + inputs.loki_rules + inputs.dashboards, run, result, lambda: setattr(metrics, "is_ready", True), debounce, refresh)
    if stop is not None:
        w._stop = stop
    try:
        w.loop()
    except KeyboardInterrupt:
        pass
    finally:
        if server:
            server.shutdown()
    return CLEAN


if __name__ == "__main__":
    sys.exit(main())
