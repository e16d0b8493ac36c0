"""Secret scans: two character Markov models, one of random strings and one of ordinary identifiers.

Candidates are runs of characters that tokens are made of. Each character adds the logarithm of how much likelier it is,
after the two before it, in a random string than in an ordinary identifier; all disjoint stretches of a run that are long
enough and whose sums exceed the threshold, which is set on labelled samples as well, are reported, the greatest first
sought and then what is left and right of it.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalens.llm import _io

MIN_LENGTH = 16
#: Strings of both cases are told apart at a joining character if they are this long.
JOINED = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Labelled documents from which ordinary words are taken at most.
SAMPLE_ROWS = 1500
#: Labelled samples of a kind that the models are made from at most.
SAMPLES = 20_000
_CODE = np.full(128, len(ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_START = len(ALPHABET)
_SIZE = len(ALPHABET) + 1

WORDS = (
    "abort accept access account action active adapter address admin agent alias allocate amount analyze append apply archive array assert assign async atomic attribute audit author auto await backup balance base batch begin binary binding block boolean border "
    "boundary bucket buffer build bundle button byte cache calculate callback cancel capture catalog category cell center channel character check child chunk class clean client clone close cluster code collect column command comment commit compare compile complete "
    "component compress compute concat config confirm connect const constraint construct consumer contact container content context continue control convert cookie copy core count create credit cursor custom customer data database date debug decode default define "
    "delay delete deliver depth describe design detail detect device dialog digest direct directory disable dispatch display distance document domain double download driver dynamic edge edit element email empty enable encode encrypt endpoint engine entity entry "
    "enum environment equal error escape event example exception exclude execute exist expand expect expire export express extend external extract factory fail feature fetch field file filter final find first fixed flag flat float flush folder format forward frame "
    "function future gateway generate get global grant graph group handle handler hash header health height hidden history host icon identifier ignore image implement import include index info init initial inline inner input insert instance integer interface "
    "internal interval invalid invoice issue item iterator join journal json kernel key keyword kind label language last latency layer layout lazy left length level library limit line link list listener load local lock logger login long lookup loop machine main "
    "manager map marker mask master match matrix maximum measure member memory menu merge message metadata method metric minimum mobile mode model modify module monitor month mount move multi mutable name namespace native network node normal note notify null "
    "number object observe offset online open operator option order origin output override owner package page panel parallel parameter parent parse partition password path pattern payment pending percent permission phone pipeline pixel platform player plugin point "
    "policy pool position post prefix prepare previous price primary print priority private process producer product profile progress project promise property protocol provider proxy public publish purchase query queue random range rank reader record redirect "
    "reduce reference refresh region register release reload remote remove render repeat replace report repository request require reset resize resolve resource response result resume retry return revenue review right role rollback root rotate route row rule "
    "runtime sample scale schedule schema scope score screen script scroll search second secret section secure segment select send sequence serial server service session setting setup shape share shard shell shift show shutdown signal simple single size skip sleep "
    "slice socket sort source space split stack stage standard start state static status step storage store stream string struct style submit subscribe success suffix summary support suspend switch symbol sync system table target task template temp terminal test "
    "text theme thread threshold throttle timeout timer timestamp title toggle token topic total trace track transaction transfer transform transport tree trigger type undo unique unit update upgrade upload usage user util valid validate value variable vector "
    "verify version view virtual visible visit volume wait warning watch weight widget width window worker workflow wrapper write writer year zone"
).split()


def random_strings(n: int, seed: int) -> list[str]:
    """Labelled samples of secrets: keys, tokens and digests as programs make them."""
    r, out = random.Random(seed), []
    kinds = [
        ("", "0123456789abcdef", (32, 40, 64)), ("", "0123456789ABCDEF", (32, 40)), ("", string.ascii_letters + string.digits, (20, 24, 32, 40, 48)), ("", string.ascii_letters + string.digits + "+/", (24, 40, 44, 64)), ("", string.ascii_letters + string.digits + "-_", (22, 43)),
        ("AKIA", string.ascii_uppercase + "234567", (16,)), ("", string.ascii_uppercase + "234567", (16, 26, 32)), ("", string.ascii_lowercase + string.digits, (16, 25, 32)), ("sk_live_", string.ascii_letters + string.digits, (24,)), ("ghp_", string.ascii_letters + string.digits, (36,)),
    ]
    for _ in range(n):
        head, letters, sizes = r.choice(kinds)
        out.append(head + "".join(r.choice(letters) for _ in range(r.choice(sizes))))
    return out


def identifiers(n: int, seed: int) -> list[str]:
    """Labelled samples of ordinary identifiers: names as programmers make them, paths, versions, counters, dates."""
    r, out = random.Random(seed), []
    for _ in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(2, 5))]
        style, tail = r.randrange(7), r.choice(["", "", "", "1", "2", "_v2", "-2024", "64", "-01", "/v1"])
        out.append([w[0] + "".join(x.title() for x in w[1:]), "".join(x.title() for x in w), "_".join(w), "-".join(w), "_".join(w).upper(), "/".join(w), "=".join(w[:2])][style] + tail)
        if r.random() < 0.06:
            out.append(r.choice(["{:04d}-{:02d}-{:02d}-{}", "{:04d}/{:02d}/{:02d}/{}", "{:04d}{:02d}{:02d}_{}"]).format(r.randint(1990, 2030), r.randint(1, 12), r.randint(1, 28), w[0]))
        if r.random() < 0.03:
            out.append(r.choice("-=_+/") * r.randint(8, 40))
    return out


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float


def _codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]


def _counts(samples: list[str]) -> np.ndarray:
    c = np.zeros((_SIZE, _SIZE, _SIZE))
    for s in samples:
        x = np.concatenate([[_START, _START], _codes(s)])
        np.add.at(c, (x[:-2], x[1:-1], x[2:]), 1)
    return c


def _log_probabilities(c: np.ndarray) -> np.ndarray:
    """Order two, smoothed by order one, that by order nothing, and that by all characters alike."""
    k = 4.0
    p0 = (c.sum(axis=(0, 1)) + 0.5) / (c.sum() + 0.5 * _SIZE)
    c1 = c.sum(axis=0)
    p1 = (c1 + k * p0) / (c1.sum(axis=1, keepdims=True) + k)
    return np.log((c + k * p1[None]) / (c.sum(axis=2, keepdims=True) + k))


def fit(secrets: list[str], ordinary: list[str]) -> Model:
    """Models from four fifths of each list; the threshold from the rest: above all but one in a thousand ordinary ones."""
    cut = lambda x: ([s for i, s in enumerate(x) if i % 5], x[::5])
    (s_fit, _), (o_fit, o_rest) = cut(secrets), cut(ordinary)
    ratio = _log_probabilities(_counts(s_fit)) - _log_probabilities(_counts(o_fit))
    top = sorted((best(ratio, s)[2] for s in o_rest if len(s) >= MIN_LENGTH), reverse=True)
    return Model(ratio.astype(np.float32), float(max(12.0, top[len(top) // 1000] if top else 0.0)))


def _sums(ratio: np.ndarray, run: str) -> np.ndarray:
    x = np.concatenate([[_START, _START], _codes(run)])
    return np.concatenate([[0.0], np.cumsum(ratio[x[:-2], x[1:-1], x[2:]], dtype=np.float64)])


def _greatest(total: np.ndarray, lo: int, hi: int) -> tuple[int, int, float]:
    """(start, end, sum) of the stretch within lo:hi, of MIN_LENGTH characters at least, with the greatest sum."""
    m = hi - lo + 1 - MIN_LENGTH
    if m <= 0:
        return lo, lo, float("-inf")
    part = total[lo : hi + 1]
    low = np.minimum.accumulate(part[:m])
    gain = part[MIN_LENGTH:] - low
    e = int(gain.argmax())
    return lo + int(np.flatnonzero(part[: e + 1] == low[e])[0]), lo + e + MIN_LENGTH, float(gain[e])


def _widened(total: np.ndarray, run: str, start: int, end: int, lo: int, hi: int) -> tuple[int, int]:
    """A stretch widened within lo:hi to whole groups of letters and digits, or cut back where the whole first or last group is
    ordinary."""
    while start > lo and run[start - 1].isalnum():
        start -= 1
    while end < hi and run[end].isalnum():
        end += 1
    first = next((i for i in range(start, end) if not run[i].isalnum()), end)
    if end - first > MIN_LENGTH and total[first + 1] < total[start]:
        start = first + 1
    last = next((i for i in range(end - 1, start, -1) if not run[i].isalnum()), start)
    if last - start >= MIN_LENGTH and total[end] < total[last]:
        end = last
    return start, end


def best(ratio: np.ndarray, run: str) -> tuple[int, int, float]:
    """(start, end, sum) of the stretch of at least MIN_LENGTH characters with the greatest sum, of equal ones the first, widened
    to whole groups of letters and digits."""
    total = _sums(ratio, run)
    start, end, s = _greatest(total, 0, len(run))
    return (*_widened(total, run, start, end, 0, len(run)), s) if s > float("-inf") else (0, 0, s)


def _pieces(total: np.ndarray, threshold: float, run: str) -> list[tuple[int, int]]:
    """The run cut where no secret goes on: at "=", which is padding at most, and at a "+", "/", "-" or "_" between two secrets
    that have none of its kind in them: keys of one case, or of JOINED characters at least. Shorter ones of both cases
    may be one Base64 string, and stay together."""
    out = []
    for m in re.finditer(r"[^=]+", run):
        cuts = set()
        for kind in ("[+/]", "[-_]"):
            at = [m.start() - 1, *[x.start() + m.start() for x in re.finditer(kind, m.group())], m.end()]
            parts = [(a + 1, b) for a, b in zip(at[:-1], at[1:], strict=True)]
            long = [b - a >= MIN_LENGTH and (b - a >= JOINED or run[a:b] in (run[a:b].lower(), run[a:b].upper())) and _greatest(total, a, b)[2] > threshold for a, b in parts]
            cuts |= {at[i] for i in range(1, len(parts)) if long[i - 1] and long[i]}
        edges = [m.start() - 1, *sorted(cuts), m.end()]
        out += [(a + 1, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _lull(total: np.ndarray, start: int, end: int) -> tuple[int, int, float]:
    """(start, end, sum) of the stretch within start:end with the least sum."""
    part = total[start : end + 1]
    fall = part - np.maximum.accumulate(part)
    e = int(fall.argmin())
    return start + int(part[: e + 1].argmax()), start + e, float(fall[e])


def stretches(ratio: np.ndarray, threshold: float, run: str) -> list[tuple[int, int, float]]:
    """(start, end, sum) of every secret of a run, in order. A stretch is two if what lies within it is as surely ordinary
    (a sum below -threshold) as what lies on either side of that is not."""
    total, out = _sums(ratio, run), []
    if _greatest(total, 0, len(run))[2] <= threshold:
        return out
    todo = _pieces(total, threshold, run)
    while todo:
        lo, hi = todo.pop()
        start, end, s = _greatest(total, lo, hi)
        if s <= threshold:
            continue
        a, b, fall = _lull(total, start, end)
        if fall < -threshold and _greatest(total, start, a)[2] > threshold and _greatest(total, b, end)[2] > threshold:
            middle = next((i for i in range(a, b) if not run[i].isalnum()), a)
            todo += [(lo, middle), (middle, hi)]
            continue
        start, end = _widened(total, run, start, end, lo, hi)
        out.append((start, end, s))
        todo += [(lo, start), (end, hi)]
    return sorted(out)


def train(docs: DataFrame | None = None, labels: DataFrame | None = None, rows: int = SAMPLE_ROWS, seed: int = 5, *, samples: DataFrame | None = None, sample_rows: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> Model:
    """Models from labelled samples: ``samples`` (value string, secret boolean), at most ``sample_rows`` distinct ones of each kind, those of
    the least hashes; nulls, values of other characters than tokens are made of, and what is labelled both ways are left out.
    A kind of which there are no samples is made up. With docs and labels the longer words of at most ``rows`` documents of good
    quality (those whose ids have the least hashes) are ordinary as well."""
    secrets, ordinary, words = [], [], []
    if samples is not None:
        v = samples.select(_io.column(samples, "value").cast("string").alias("v"), _io.column(samples, "secret").cast("boolean").alias("s")).where(F.col("s").isNotNull() & F.col("v").rlike(r"^[A-Za-z0-9+/_=-]+$"))
        one = v.groupBy("v").agg(F.min("s").alias("s"), F.max("s").alias("t")).where("s = t")
        secrets, ordinary = ([r.v for r in one.where(F.col("s") == kind).orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(sample_rows).collect()] for kind in (True, False))
    if docs is not None and labels is not None:
        good = labels.where(_io.column(labels, quality_col) == 1).select(_io.column(labels, id_col).alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(rows)
        d = docs.select(_io.column(docs, id_col).alias("i"), _io.column(docs, text_col).alias("t")).join(F.broadcast(good), "i").select(F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("w"))
        words = sorted({w for r in d.collect() for w in r.w or []})
    return fit(secrets or random_strings(6000, seed), (ordinary or identifiers(6000, seed)) + words)


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_char, end_char, secret, score) of every secret. At least one letter is in it: numbers alone are not
    secrets here. Null and empty texts have none; repeated rows are reported once a row, null ids as null; other columns play
    no part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def part(batches):
        m = shared.value
        for rb in batches:
            at, start, end, secret, score = [], [], [], [], []
            for i, t in enumerate(rb.column(1).to_pylist()):
                for run in RUN.finditer(t or ""):
                    for a, b, s in stretches(m.ratio, m.threshold, run.group()):
                        found = run.group()[a:b]
                        if not found.isdigit():
                            at.append(i)
                            start.append(run.start() + a)
                            end.append(run.start() + b)
                            secret.append(found)
                            score.append(s)
            if at:
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(at)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(secret), pa.array(score)], names=["id", "first_char", "end_char", "secret", "score"])

    return docs.select(_io.column(docs, id_col).alias("id"), _io.column(docs, text_col).alias("text")).mapInArrow(part, f"id {kind}, first_char long, end_char long, secret string, score double").withColumnRenamed("id", id_col)
