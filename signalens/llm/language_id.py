"""Language identification by bit-sliced Bloom filters of n-grams.

A text is lower-cased, all but letters become single spaces, and its character n-grams are looked up. One table holds the
filters of all languages, 64 in a word: bit l of a slot is slot's bit in the filter of language l, so ANDing the slots of an n-gram's
hashes gives at once the mask of languages that have it. Per language the n-grams are counted, the expected number of
false positives is taken off, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalens.llm import _io, _text

#: n-grams have two characters at least.
N, HASHES, SLOTS_LOG2 = 4, 3, 17
#: n-grams that a language's filter holds at most: the most frequent ones of its sample.
PER_LANGUAGE = 6000
#: Labelled rows of each language that the filters are made from.
SAMPLE_ROWS = 400
#: Languages at most: those of the most labelled rows.
LANGUAGES = 512


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its lower case if it is a letter, else a space."""
    import unicodedata

    _, lower = _text._tables()
    out = lower.copy()
    for cp in range(len(out)):
        if unicodedata.category(chr(cp))[0] != "L":
            out[cp] = 32
    return out


def ngrams(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams of all texts, offsets: those of text i are offsets[i]:offsets[i+1]). A text counts with a
    space at either end."""
    joined = "".join(f" {t or ''} \x00" for t in texts)
    cps = _text.code_points(joined)
    ends = np.flatnonzero(cps == 0)
    if len(ends) != len(texts):  # texts with NUL characters
        joined = "".join(f" {(t or '').replace(chr(0), ' ')} \x00" for t in texts)
        cps = _text.code_points(joined)
        ends = np.flatnonzero(cps == 0)
    c = _letters()[cps]
    c[ends] = 0
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep].astype(np.uint64)
    stop = np.flatnonzero(c == 0)
    m = max(0, len(c) - n + 1)
    ok = np.ones(m, dtype=bool)
    for i in range(n):
        at = stop - i
        ok[at[(at >= 0) & (at < m)]] = False
    count = np.concatenate([[0], np.cumsum(ok)])
    return _hashed(c, n)[ok], np.concatenate([[0], count[np.minimum(stop, m)]])


def long_ngrams(text: str, n: int = N) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of one text as ngrams() has them, a part at a time: parts overlap by n-1 characters."""
    held = np.array([32], dtype=np.uint64)  # what the parts so far end with, a space in front of the text
    for at in range(0, len(text) + 1, _text.CHUNK):
        part = text[at : at + _text.CHUNK] + (" " if at + _text.CHUNK > len(text) else "")
        c = np.concatenate([held, _letters()[_text.code_points(part)].astype(np.uint64)])
        new = np.ones(len(c), dtype=bool)
        new[len(held) :] = (c[len(held) :] != 32) | (c[len(held) - 1 : -1] != 32)
        c = c[new]
        yield _hashed(c, n)
        held = c[-max(1, n - 1) :]


def _hashed(c: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(c) - n + 1)
    h = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + m] + np.uint64(1)
    return _text.mix(h)


def _parts(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text indices, hashes of n-grams, offsets) of about CHUNK characters at a time."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t or "") > _text.CHUNK:
            for h in long_ngrams(t, n):
                yield np.array([i]), h, np.array([0, len(h)])
            continue
        at.append(i)
        held.append(t)
        size += len(t or "") + 3
        if size >= _text.CHUNK:
            yield np.array(at), *ngrams(held, n)
            at, held, size = [], [], 0
    if at:
        yield np.array(at), *ngrams(held, n)


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # a row for each 64 languages
    false_rate: np.ndarray

    def masks(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """Of each n-gram those of the 64 languages from 64 * word on that may have it, as bits."""
        slots = self.slots[word]
        out = slots[(h & np.uint64(len(slots) - 1)).astype(np.int64)]
        for k in range(1, HASHES):
            out = out & slots[((h >> np.uint64(SLOTS_LOG2 * k)) & np.uint64(len(slots) - 1)).astype(np.int64)]
        return out

    def counts(self, texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected count of each text and language)."""
        total, got = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for at, h, off in _parts(texts, n):
            np.add.at(total, at, np.diff(off))
            for j in range(len(self.languages)):
                if j % 64 == 0:
                    m = self.masks(h, j // 64)
                c = np.concatenate([[0], np.cumsum((m >> self.slots.dtype.type(j % 64)) & self.slots.dtype.type(1), dtype=np.int64)])
                np.add.at(got[:, j], at, c[off[1:]] - c[off[:-1]])
        return total, (got - total[:, None] * self.false_rate) / (1 - self.false_rate)


def build(samples: dict[str, list[str]], n: int = N, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from labelled texts, of any number of languages."""
    languages = sorted(samples)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOTS_LOG2), dtype=kind)
    for j, name in enumerate(languages):
        h = np.concatenate([h for _, h, _ in _parts(samples[name], n)] or [np.empty(0, np.uint64)])
        u, c = np.unique(h, return_counts=True)
        top = u[np.lexsort((u, -c))[:per_language]]
        for k in range(HASHES):
            slots[j // 64, ((top >> np.uint64(SLOTS_LOG2 * k)) & np.uint64(slots.shape[1] - 1)).astype(np.int64)] |= kind(1 << j % 64)
    fill = np.array([((slots[j // 64] >> kind(j % 64)) & kind(1)).mean() for j in range(len(languages))])
    return Filters(languages, slots, np.minimum(fill**HASHES, 0.999))


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, languages: int = LANGUAGES, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from at most ``rows`` rows of each language, those whose ids have the least hashes, and of at most ``languages`` languages,
    those of the most rows (of equal ones the first in alphabetical order). Rows without a language, an id or a text are not used."""
    d = labelled.select(_io.column(labelled, id_col).alias("i"), _io.column(labelled, lang_col).cast("string").alias("l"), _io.column(labelled, text_col).alias("t")).where("i is not null and l is not null and l <> ''")
    known = d.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(languages).select("l")
    d = d.join(F.broadcast(known), "l")
    w = Window.partitionBy("l").orderBy(F.xxhash64("i", F.lit(8)), "i")
    chosen = d.select("i", "l").withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).select("i").distinct()
    out: dict[str, list[str]] = {}
    for r in d.where("t is not null").join(F.broadcast(chosen), "i").select("l", "t").collect():
        out.setdefault(r.l, []).append(r.t)
    return build(out)


def identify(docs: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, confidence, n_grams) of every row: the language of the largest corrected count (of equal ones the first in
    alphabetical order) and that count's share of the n-grams. Where no language has a positive count, as for null and empty
    texts and texts without letters, lang is null and confidence 0. Null ids and repeated rows are rows like any other;
    other columns play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema[id_col].dataType.simpleString()

    def part(batches):
        f = shared.value
        for rb in batches:
            total, got = f.counts(rb.column(1).to_pylist())
            best = got.argmax(axis=1) if len(f.languages) and rb.num_rows else np.zeros(rb.num_rows, dtype=int)
            most = got[np.arange(rb.num_rows), best] if len(f.languages) else np.zeros(rb.num_rows)
            ok = most > 1e-9
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array([f.languages[b] if k else None for b, k in zip(best, ok, strict=True)], pa.string()), pa.array(np.where(ok, most / np.maximum(total, 1), 0.0)), pa.array(total.astype(np.int64))],
                names=["id", "lang", "confidence", "n_grams"],
            )

    return docs.select(_io.column(docs, id_col).alias("id"), _io.column(docs, text_col).alias("text")).mapInArrow(part, f"id {kind}, lang string, confidence double, n_grams long").withColumnRenamed("id", id_col)
