"""Watching inputs: a streaming source of changes, and a loop that validates again when they have come to rest.

Spark's file source neither delivers a file again that is edited in place nor tells of deletions, so the source here
compares fingerprints (path, time of change, size) of the watched files.
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

EXTENSIONS = (".yaml", ".yml", ".json")
DEBOUNCE_S = 0.5


def relevant(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in EXTENSIONS


def watched_dirs(paths: list[str]) -> list[str]:
    """Directories to look into: those of files, and directories with all that are below and not hidden; sorted, without repetitions."""
    out = set()
    for p in paths:
        if os.path.isdir(p):
            for root, dirs, _ in os.walk(p):
                dirs[:] = [d for d in dirs if not d.startswith(".")]
                out.add(root)
        else:
            out.add(os.path.dirname(p) or ".")
    return sorted(out)


def fingerprint(paths: list[str]) -> dict[str, tuple[int, int]]:
    """Time of change and size of every relevant file in the watched directories; a change of rights alone changes nothing."""
    out = {}
    for d in watched_dirs(paths):
        try:
            entries = list(os.scandir(d))
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_file() and relevant(e.name):
                    s = e.stat()
                    out[e.path] = (s.st_mtime_ns, s.st_size)
            except OSError:
                continue
    return out


def changes(old: dict, new: dict) -> list[tuple[str, str]]:
    """(path, created, changed or deleted), sorted."""
    return sorted([(p, "created") for p in new.keys() - old.keys()] + [(p, "deleted") for p in old.keys() - new.keys()] + [(p, "changed") for p in new.keys() & old.keys() if tuple(new[p]) != tuple(old[p])])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def initialOffset(self) -> dict:
        return {"digest": "", "files": "{}"}

    def read(self, start: dict):
        now = fingerprint(self.paths)
        text = json.dumps(now, sort_keys=True)
        digest = hashlib.sha256(text.encode()).hexdigest()
        if digest == start["digest"]:
            return iter([]), start
        return iter(changes(json.loads(start["files"]), now)), {"digest": digest, "files": text}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(changes(json.loads(start["files"]), json.loads(end["files"])))


class ChangeSource(DataSource):
    """format("file_changes"), option paths: a JSON list. Rows (path, op); the first batch holds all files as created."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, op string"

    def simpleStreamReader(self, schema):
        return _Reader(json.loads(self.options["paths"]))


def change_stream(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("file_changes").option("paths", json.dumps(paths)).load()


def start_stream(spark: SparkSession, paths: list[str], run: Callable[[], object], on_result: Callable[[object, Exception | None], None], checkpoint: str, interval: str = "500 milliseconds"):
    """A streaming query that runs a full pass for each batch of changes, the first at once."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            try:
                on_result(run(), None)
            except Exception as e:  # a failed pass is reported, watching goes on
                on_result(None, e)

    return change_stream(spark, paths).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


@dataclass
class Watcher:
    """A pass at once, then one whenever relevant files have not changed for the debounce time, and one on every refresh.

    Errors of looking at files and of passes go to on_result and do not end the loop; on_ready is called once, after the first
    pass that does not fail. A debounce of 0 is the default; a refresh of 0 is off.
    """

    paths: list[str]
    run: Callable[[], object]
    on_result: Callable[[object, Exception | None], None]
    on_ready: Callable[[], None] = lambda: None
    debounce_s: float = DEBOUNCE_S
    refresh_s: float = 0.0
    poll_s: float = 0.1
    clock: Callable[[], float] = time.monotonic
    look: Callable[[list[str]], dict] = fingerprint
    iterations: int = 0
    ready: bool = False
    _stop: threading.Event = field(default_factory=threading.Event)

    def stop(self) -> None:
        self._stop.set()

    def once(self) -> None:
        self.iterations += 1
        try:
            result = self.run()
        except Exception as e:
            self.on_result(None, e)
            return
        self.on_result(result, None)
        if not self.ready:
            self.ready = True
            self.on_ready()

    def loop(self) -> None:
        wait = self.debounce_s or DEBOUNCE_S
        seen = self._seen({})
        self.once()
        quiet_at, refresh_at = None, self.clock() + self.refresh_s
        while not self._stop.wait(self.poll_s):
            now = self._seen(seen)
            if changes(seen, now):
                seen, quiet_at = now, self.clock() + wait  # each change starts the wait anew
            if quiet_at is not None and self.clock() >= quiet_at:
                quiet_at = None
                self.once()
            if self.refresh_s > 0 and self.clock() >= refresh_at:
                refresh_at = self.clock() + self.refresh_s
                self.once()

    def _seen(self, last: dict) -> dict:
        try:
            return self.look(self.paths)
        except OSError as e:
            self.on_result(None, e)
            return last
