"""Catalogs: HTTP clients, cache entries with a lifetime, and snapshot tables that the checks join with.

A check sees tables only: metrics(metric), labels(metric, label), values(metric, label, value) and, for logs,
stream_labels(label), stream_values(label, value). A snapshot fills them for a work list of distinct keys.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from signalens.functions import rules as R

TTL_SECONDS, TIMEOUT_S, MAX_BODY, MAX_ERROR, SCHEMA_VERSION = 3600, 30, 32 << 20, 512, 1
NAMES, LABEL_NAMES, METRIC_LABELS, METRIC_VALUES, STREAM_VALUES = "__all_metric_names__", "__all_label_names__", "__metric_labels__:{}", "__metric_label_values__:{}:{}", "__stream_label_values__:{}"

_VALUES_OF = tuple(x.partition(":")[0] + ":" for x in (METRIC_VALUES, STREAM_VALUES))


class CatalogError(RuntimeError):
    """The catalog cannot be read; it ends the run."""


def cut_body(raw: bytes, most: int = MAX_ERROR) -> str:
    return raw.decode("utf-8", "replace") if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "…"


def get_list(url: str, headers: dict[str, str] | None = None) -> list[str]:
    """The data of an answer {status, data, errorType, error}."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json", **(headers or {})}), timeout=TIMEOUT_S) as r:
            raw = r.read(MAX_BODY)
    except urllib.error.HTTPError as e:
        raise CatalogError(f"{url}: status {e.code}: {cut_body(e.read(MAX_BODY))}") from None
    except OSError as e:
        raise CatalogError(f"{url}: {e}") from None
    try:
        doc = json.loads(raw)
    except ValueError as e:
        raise CatalogError(f"{url}: {e}") from None
    if not isinstance(doc, dict) or doc.get("status") != "success":
        raise CatalogError(f"{url}: {doc.get('errorType', '')}: {doc.get('error', '')}" if isinstance(doc, dict) else f"{url}: no object")
    return [str(x) for x in doc.get("data") or []]


def match_query(matchers: Iterable[str]) -> str:
    pairs = [("match[]", m) for m in matchers if m]
    return "?" + urllib.parse.urlencode(pairs) if pairs else ""


def scope(metric: str) -> str:
    return "{__name__=" + json.dumps(metric, ensure_ascii=False) + "}"


class MetricsClient(Protocol):
    def metric_names(self) -> list[str]: ...
    def label_names(self, matchers: list[str]) -> list[str]: ...
    def label_values(self, label: str, matchers: list[str]) -> list[str]: ...


class LogsClient(Protocol):
    def label_names(self) -> list[str]: ...
    def label_values(self, label: str) -> list[str]: ...


@dataclass
class PrometheusHttp:
    url: str
    headers: dict[str, str] | None = None

    def _get(self, path: str, matchers: list[str]) -> list[str]:
        return get_list(self.url.rstrip("/") + path + match_query(matchers), self.headers)

    def metric_names(self) -> list[str]:
        return self._get("/api/v1/label/__name__/values", [])

    def label_names(self, matchers: list[str]) -> list[str]:
        return self._get("/api/v1/labels", matchers)

    def label_values(self, label: str, matchers: list[str]) -> list[str]:
        return self._get(f"/api/v1/label/{urllib.parse.quote(label, safe='')}/values", matchers)


@dataclass
class LokiHttp:
    url: str
    headers: dict[str, str] | None = None

    def label_names(self) -> list[str]:
        return get_list(self.url.rstrip("/") + "/loki/api/v1/labels", self.headers)

    def label_values(self, label: str) -> list[str]:
        return get_list(self.url.rstrip("/") + f"/loki/api/v1/label/{urllib.parse.quote(label, safe='')}/values", self.headers)


def key_for(lang: str, source: str, query: str) -> str:
    return hashlib.sha256(f"{lang}\n{source}\n{query}".encode()).hexdigest()


@dataclass
class Entry:
    query: str
    language: str
    source: str
    fetched_at: float
    ttl_seconds: int
    values: list[str] | None
    schema_version: int = SCHEMA_VERSION
    error: str = ""
    series_count: int = 0

    def document(self) -> dict:
        """The entry as it is stored: names of metrics, names of labels or, by label, values; sorted, without repetitions."""
        values = sorted(set(self.values or []))
        label = self.query.rpartition(":")[2]
        result = {"metric_names": values} if self.query == NAMES else {"label_values": {label: values}} if self.query.startswith(_VALUES_OF) else {"label_names": values}
        result |= {"series_count": self.series_count} if self.series_count else {}
        when = datetime.fromtimestamp(self.fetched_at, timezone.utc).isoformat().replace("+00:00", "Z")
        own = {"schema_version": self.schema_version, "query": self.query, "language": self.language, "source": self.source, "fetched_at": when}
        return own | ({"ttl_seconds": self.ttl_seconds} if self.ttl_seconds else {}) | ({"error": self.error} if self.error else {"result": result})

    @classmethod
    def of(cls, doc: dict) -> Entry:
        """The entry of a document; raises ValueError, TypeError or KeyError if it is none."""
        r = doc.get("result")
        values = None if r is None else [*r.get("metric_names", []), *r.get("label_names", []), *[v for vs in r.get("label_values", {}).values() for v in vs]]
        e = cls(doc["query"], doc["language"], doc["source"], datetime.fromisoformat(doc["fetched_at"]).timestamp(), doc.get("ttl_seconds", 0), values, doc["schema_version"], doc.get("error", ""), (r or {}).get("series_count", 0))
        e.validate()
        return e

    def expired(self, now: float) -> bool:
        return self.ttl_seconds > 0 and now - self.fetched_at > self.ttl_seconds

    def validate(self) -> None:
        """Raises ValueError if a field is missing or wrong."""
        for wrong, what in (
            (self.schema_version != SCHEMA_VERSION, "schema version"), (not self.query, "query"), (self.language not in ("promql", "logql"), "language"), (not self.source, "source"),
            (not self.fetched_at, "time"), (self.ttl_seconds < 0, "lifetime"), (self.values is None and not self.error, "result"),
        ):
            if wrong:
                raise ValueError(f"cache entry: bad {what}")

    @property
    def key(self) -> str:
        return key_for(self.language, self.source, self.query)


class MemoryStore:
    """Entries in this process; kept as they are put."""

    def __init__(self) -> None:
        self._held: dict[str, Entry] = {}

    def get(self, key: str) -> Entry | None:
        return self._held.get(key)

    def put(self, e: Entry) -> None:
        e.validate()
        self._held[e.key] = e

    def delete(self, key: str) -> None:
        self._held.pop(key, None)

    def keys(self) -> list[str]:
        return sorted(self._held)


class FileStore:
    """Entries as JSON files <root>/v1/<language>/<key>.json, sorted and without repetitions, replaced atomically."""

    def __init__(self, root: str):
        self.root = root

    def _path(self, lang: str, key: str) -> str:
        return os.path.join(self.root, "v1", lang, key + ".json")

    def get(self, key: str) -> Entry | None:
        for lang in ("promql", "logql"):
            try:
                with open(self._path(lang, key), encoding="utf-8") as f:
                    return Entry.of(json.load(f))
            except FileNotFoundError:
                continue
        return None

    def put(self, e: Entry) -> None:
        e.validate()
        path = self._path(e.language, e.key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        fd, temp = tempfile.mkstemp(dir=os.path.dirname(path), suffix=".tmp")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(e.document(), f)
        os.replace(temp, path)

    def delete(self, key: str) -> None:
        for lang in ("promql", "logql"):
            if os.path.exists(p := self._path(lang, key)):
                os.remove(p)

    def keys(self) -> list[str]:
        out = []
        for lang in ("promql", "logql"):
            d = os.path.join(self.root, "v1", lang)
            out += [f[:-5] for f in (os.listdir(d) if os.path.isdir(d) else []) if f.endswith(".json")]
        return sorted(out)


ENTRY = (
    "schema_version int, query string, language string, source string, fetched_at timestamp, ttl_seconds int, "
    "result struct<metric_names:array<string>,label_names:array<string>,label_values:map<string,array<string>>,series_count:int>, error string"
)


def cache_table(spark: SparkSession, root: str) -> DataFrame:
    """The entries in a file store as rows (key and what is stored), so that checks can join with a cache of any size."""
    raw = spark.read.schema(ENTRY).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(f"{root.rstrip('/')}/v1")
    return raw.select(R.cache_key(F.col("language"), F.col("source"), F.col("query")).alias("key"), *raw.columns)


@dataclass
class Tables:
    """A snapshot; None where there is no client for the language, whose checks are then left out."""

    metrics: DataFrame | None = None
    labels: DataFrame | None = None
    values: DataFrame | None = None
    stream_labels: DataFrame | None = None
    stream_values: DataFrame | None = None


class Catalog:
    """Clients behind a cache. An unreadable or expired entry is a miss, and so is an empty list."""

    def __init__(self, prometheus: MetricsClient | None = None, loki: LogsClient | None = None, *, prometheus_source: str = "", loki_source: str = "", store=None, ttl_seconds: int = TTL_SECONDS, jobs: int = 4, clock: Callable[[], float] = time.time):
        if prometheus is not None and not prometheus_source or loki is not None and not loki_source:
            raise CatalogError("a client needs the name of its source")
        self.prometheus, self.loki, self.sources = prometheus, loki, {"promql": prometheus_source, "logql": loki_source}
        self.store, self.ttl, self.jobs, self.clock = store or MemoryStore(), ttl_seconds, jobs, clock
        #: Called with the seconds that the requests of a snapshot took.
        self.observe: Callable[[float], None] | None = None

    def cached(self, lang: str, query: str, fetch: Callable[[], list[str]]) -> list[str]:
        source, now = self.sources[lang], self.clock()
        try:
            e = self.store.get(key_for(lang, source, query))
        except (OSError, ValueError, TypeError, KeyError, AttributeError):
            e = None
        if e is not None and e.values and not e.expired(now):
            return e.values
        got = sorted(fetch())
        self.store.put(Entry(query, lang, source, now, self.ttl, got))
        return got

    def snapshot(self, spark: SparkSession, plan: DataFrame) -> Tables:
        """Tables for a work list (lang, task, metric, label) as made by operators.checks.work_list: at most ``jobs`` requests at
        a time. All are tried; what was got is in the store, and the failures of the others are raised together."""
        wanted = sorted({(r.lang, r.task, r.metric or "", r.label or "") for r in plan.collect()})

        def fetch(w):
            lang, task, metric, label = w
            p, lo = self.prometheus, self.loki
            if lang == "promql" and p is not None:
                if task == "names":
                    return w, self.cached(lang, NAMES, p.metric_names)
                if task == "labels":
                    return w, self.cached(lang, METRIC_LABELS.format(metric), lambda: p.label_names([scope(metric)]))
                return w, self.cached(lang, METRIC_VALUES.format(metric, label), lambda: p.label_values(label, [scope(metric)]))
            if lang == "logql" and lo is not None:
                if task == "labels":
                    return w, self.cached(lang, LABEL_NAMES, lo.label_names)
                return w, self.cached(lang, STREAM_VALUES.format(label), lambda: lo.label_values(label))
            return w, []

        def attempt(w):
            try:
                return fetch(w)
            except (CatalogError, OSError, ValueError) as e:
                return e

        began = time.monotonic()
        with ThreadPoolExecutor(self.jobs if self.jobs > 0 else 4) as pool:
            got = list(pool.map(attempt, wanted))
        if self.observe is not None:
            self.observe(time.monotonic() - began)
        if errors := [str(e) for e in got if isinstance(e, Exception)]:
            raise CatalogError("\n".join(dict.fromkeys(errors)))
        rows = {k: [] for k in ("metrics", "labels", "values", "stream_labels", "stream_values")}
        for (lang, task, metric, label), found in got:
            if lang == "promql":
                rows["metrics" if task == "names" else task] += [(v,) if task == "names" else (metric, v) if task == "labels" else (metric, label, v) for v in found]
            else:
                rows["stream_" + task] += [(v,) if task == "labels" else (label, v) for v in found]
        table = lambda k, schema: spark.createDataFrame(rows[k], schema)
        out = Tables()
        if self.prometheus is not None:
            out.metrics, out.labels, out.values = table("metrics", "metric string"), table("labels", "metric string, label string"), table("values", "metric string, label string, value string")
        if self.loki is not None:
            out.stream_labels, out.stream_values = table("stream_labels", "label string"), table("stream_values", "label string, value string")
        return out


class _Part(InputPartition):
    def __init__(self, metric: str, label: str = ""):
        self.metric, self.label = metric, label


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _client(self) -> PrometheusHttp | LokiHttp:
        o, headers = self.options, {k[len("header.") :]: v for k, v in self.options.items() if k.startswith("header.")}
        return LokiHttp(o["url"], headers) if o.get("lang") == "logql" else PrometheusHttp(o["url"], headers)

    def partitions(self):
        if self.options.get("lang") == "logql":
            return [_Part("", label) for label in self._client().label_names()] or [_Part("")]
        metrics = [m for m in self.options.get("metrics", "").split(",") if m]
        return [_Part(m, label) for m in metrics for label in self._client().label_names([scope(m)])] or [_Part("")]

    def read(self, partition: _Part):
        client, metric, label = self._client(), partition.metric, partition.label
        if isinstance(client, LokiHttp):
            for v in client.label_values(label) if label else []:
                yield "", label, v
        elif label:
            for v in client.label_values(label, [scope(metric)]):
                yield metric, label, v
        elif not self.options.get("metrics"):
            for m in client.metric_names():
                yield m, None, None


class CatalogSource(DataSource):
    """format("signal_catalog"): options url, lang (promql or logql), metrics (comma-separated; without them, names only) and header.<name>
    for each header. Labels are asked for when the read is planned; the values of each are a partition."""

    @classmethod
    def name(cls) -> str:
        return "signal_catalog"

    def schema(self) -> str:
        return "metric string, label string, value string"

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogSource)
