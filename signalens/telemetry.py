"""Counters, gauges and histograms of a watching process, served as text with probes."""

from __future__ import annotations

import json
import logging
import os
import sys
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

RUN_BUCKETS = tuple(ms / 1000 for ms in (50, 100, 250, 500, 1000, 2500, 5000, 10_000, 30_000, 60_000))
PREWARM_BUCKETS = (0.01, *RUN_BUCKETS[:-1])
SEVERITIES = ("error", "warning", "info")


class Metrics:
    """What a process has done so far; counts never fall."""

    def __init__(self, version: str = "") -> None:
        self.lock, self.version, self.is_ready = threading.Lock(), version, False
        self.findings: dict[tuple[str, str, str], int] = {}
        self.last: dict[str, int] = dict.fromkeys(SEVERITIES, 0)
        self.runs: dict[str, int] = {}
        self.files = self.iterations = 0
        self.times = {"run": (RUN_BUCKETS, []), "prewarm": (PREWARM_BUCKETS, [])}

    def observe_run(self, findings: list[dict], files: dict[str, int], seconds: float, failed: bool = False) -> None:
        """findings: one by one, or counts of them in n."""
        with self.lock:
            count = dict.fromkeys(SEVERITIES, 0)
            for f in findings:
                k = (f["code"], f["severity"], f["category"])
                self.findings[k] = self.findings.get(k, 0) + f.get("n", 1)
                count[f["severity"]] = count.get(f["severity"], 0) + f.get("n", 1)
            outcome = "failed" if failed else "errors" if count["error"] else "warnings" if count["warning"] else "clean"
            if not failed:
                self.last = count
            self.runs[outcome] = self.runs.get(outcome, 0) + 1
            self.files += sum(files.values())
            self.iterations += 1
            self.times["run"][1].append(seconds)

    def observe_prewarm(self, seconds: float) -> None:
        with self.lock:
            self.times["prewarm"][1].append(seconds)

    def text(self) -> str:
        out: list[str] = []

        def family(name: str, kind: str, rows) -> None:
            out.append(f"# TYPE signalens_{name} {kind}")
            out.extend(f"signalens_{name}{s}{'{' + ','.join(f'{k}={json.dumps(str(v))}' for k, v in labels.items()) + '}' if labels else ''} {v:g}" for s, labels, v in rows)

        with self.lock:
            family("findings_total", "counter", [("", dict(zip(("code", "severity", "category"), k, strict=True)), n) for k, n in sorted(self.findings.items())])
            family("last_run_findings", "gauge", [("", {"severity": s}, n) for s, n in sorted(self.last.items())])
            family("runs_total", "counter", [("", {"outcome": o}, n) for o, n in sorted(self.runs.items())])
            family("files_scanned_total", "counter", [("", {}, self.files)])
            family("watch_iterations_total", "counter", [("", {}, self.iterations)])
            family("build_info", "gauge", [("", {"version": self.version}, 1)])
            for name, (buckets, seen) in self.times.items():
                rows = [("_bucket", {"le": f"{b:g}"}, sum(x <= b for x in seen)) for b in buckets]
                family(f"{name}_duration_seconds", "histogram", [*rows, ("_bucket", {"le": "+Inf"}, len(seen)), ("_sum", {}, sum(seen)), ("_count", {}, len(seen))])
        return "\n".join(out) + "\n"


def serve(metrics: Metrics, host: str, port: int) -> ThreadingHTTPServer:
    """/metrics, /healthz and /readyz (503 until ready); anything else is 404."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = {"/metrics": (200, metrics.text()), "/healthz": (200, "ok\n"), "/readyz": (200, "ready\n") if metrics.is_ready else (503, "not ready\n")}.get(self.path.split("?")[0], (404, "not found\n"))
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; version=0.0.4; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class _Json(logging.Formatter):
    def format(self, r: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(r), "level": r.levelname, "msg": r.getMessage(), **getattr(r, "fields", {})})


def logger(run_id: str | None = None, stream=None) -> logging.LoggerAdapter:
    """Structured logs: SIGNALENS_LOG_FORMAT is json (default) or text, SIGNALENS_LOG_LEVEL a level; every line has the run's id."""
    log, handler = logging.getLogger("signalens"), logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s") if os.environ.get("SIGNALENS_LOG_FORMAT", "").lower() == "text" else _Json())
    log.handlers, log.propagate = [handler], False
    log.setLevel(logging.getLevelNamesMapping().get(os.environ.get("SIGNALENS_LOG_LEVEL", "info").upper(), logging.INFO))
    return logging.LoggerAdapter(log, {"fields": {"run_id": run_id or uuid.uuid4().hex}})
