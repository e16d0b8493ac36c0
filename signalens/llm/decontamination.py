"""Benchmark decontamination by winnowing.

Of every window of ``window`` successive k-grams of words the one with the least hash is a fingerprint, in documents and in
benchmark items. A shared span of k + window - 1 words holds a whole window on both sides, hence a shared fingerprint; each
hit is extended word by word to both sides. Benchmark items are few: they go to the workers in blocks of checked size, one
pass over the documents a block, and documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from signalens.llm import _io, _text

K, WINDOW = 5, 4
#: Bytes of benchmark text that go to the workers at once.
BLOCK_BYTES = 16 << 20
_BITS = 20
#: Hits that are held at once.
HITS = 1 << 21


def fingerprints(g: np.ndarray, window: int) -> np.ndarray:
    """Whether each of the hashes is the least of a window that it lies in (fewer hashes than a window: of all)."""
    n = len(g)
    if n == 0:
        return np.zeros(0, dtype=bool)
    w = min(window, n)
    low = g[: n - w + 1].copy()
    for i in range(1, w):
        np.minimum(low, g[i : n - w + 1 + i], out=low)
    high = np.zeros(n, dtype=np.uint64)
    for i in range(w):
        np.maximum(high[i : n - w + 1 + i], low, out=high[i : n - w + 1 + i])
    return g == high


def _inside(offsets: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which k-grams of a stream of n words lie within one text."""
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    for i in range(1, k):
        at = offsets[1:-1] - i
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


@dataclass
class Block:
    """Items of a benchmark: their words, and for each fingerprint where it is."""

    ids: list
    words: np.ndarray
    offsets: np.ndarray
    prints: np.ndarray
    places: np.ndarray
    bits: np.ndarray


def index(ids: list, texts: list[str | None], k: int = K, window: int = WINDOW) -> Block:
    words, offsets, prints, places, n = [], [0], [], [], 0
    for _, _, off, h, _, _ in _text.words(texts):
        for a, b in zip(off[:-1], off[1:], strict=True):
            g = _text.grams(h[a:b], k)
            at = np.flatnonzero(fingerprints(g, window))
            prints.append(g[at])
            places.append(at + n)
            words.append(h[a:b])
            n += int(b - a)
            offsets.append(n)
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    p, at = cat(prints, np.uint64), cat(places, np.int64)
    order = np.argsort(p, kind="stable")
    bits = np.zeros(1 << _BITS, dtype=bool)
    bits[(p >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Block(ids, cat(words, np.uint64), np.array(offsets), p[order], at[order], bits)


def matches(block: Block, texts: list[str | None], least: int, k: int = K, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, first character, character after the last, first word in the item, words) of each maximal shared span of
    at least ``least`` words."""
    for first, last, off, h, start, end in _text.words(texts):
        g = _text.grams(h, k)
        ok = _inside(off, len(h), k)
        g = np.where(ok, g, np.uint64(0xFFFFFFFFFFFFFFFF))
        at = np.flatnonzero(fingerprints(g, window) & ok & block.bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(block.prints, g[at], "left"), np.searchsorted(block.prints, g[at], "right")
        for t, item, diagonal in _diagonals(at, lo, hi, block, off):
            a, b, c, d = int(off[t]), int(off[t + 1]), int(block.offsets[item]), int(block.offsets[item + 1])
            p, q = max(a, c + diagonal), min(b, d + diagonal)
            same = h[p:q] == block.words[p - diagonal : q - diagonal]
            edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if y - x >= least:
                    yield first + t, item, int(start[p + x]), int(end[p + y - 1]), p + x - diagonal - c, y - x


def _diagonals(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: Block, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, place in the texts less place in the block) of the fingerprints at ``at``, which are block.prints[lo:hi], without
    repetitions: texts that repeat themselves have many hits, but each of their diagonals is looked at once."""
    some = np.flatnonzero(hi > lo)
    n = np.cumsum(hi[some] - lo[some])
    items, span = len(block.offsets), int(off[-1]) + len(block.words) + 1  # texts x items x span is far below 2^63: a block and a group of texts are small
    out: np.ndarray | None = None
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + HITS, "right")))
        x = some[i:j]
        each = hi[x] - lo[x]
        p = np.repeat(at[x], each)
        q = block.places[np.repeat(lo[x] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(int(each.sum()))]
        text, item = np.searchsorted(off, p, "right") - 1, np.searchsorted(block.offsets, q, "right") - 1
        new = np.unique((text * items + item) * span + (p - q + len(block.words)))
        out = new if out is None else np.union1d(out, new)
        i = j
    if out is None:
        return []
    pair, diagonal = np.divmod(out, span)
    return list(zip((pair // items).tolist(), (pair % items).tolist(), (diagonal - len(block.words)).tolist(), strict=True))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, k: int, window: int) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for r in benchmark.select(_io.column(benchmark, id_col).alias("i"), _io.column(benchmark, text_col).alias("t")).toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t or "")
        if size >= block_bytes:
            yield index(ids, texts, k, window)
            ids, texts, size = [], [], 0
    if ids:
        yield index(ids, texts, k, window)


def find(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item id, first_char, end_char, item_word, n_words): every maximal span of at least k + window - 1 words that a
    document shares with an item, word by word, whatever the case, punctuation and spacing.

    Null and empty texts, and items shorter than that, share nothing. Repeated rows are reported once a row, null ids as
    null; other columns play no part. Without items or documents there are no rows.
    """
    sc, least = docs.sparkSession.sparkContext, k + window - 1
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id_col].dataType.simpleString()]
    d = docs.select(_io.column(docs, id_col).alias("id"), _io.column(docs, text_col).alias("text"))
    names = ["id", "item", "first_char", "end_char", "item_word", "n_words"]
    schema = f"id {kinds[0]}, item {kinds[1]}, first_char long, end_char long, item_word long, n_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    item_type = to_arrow_type(benchmark.schema[item_id_col].dataType)
    for block in _blocks(benchmark, item_id_col, item_text_col, block_bytes, k, window):
        shared = sc.broadcast(block)

        def part(batches, shared=shared):
            b = shared.value
            for rb in batches:
                rows = list(matches(b, rb.column(1).to_pylist(), least, k, window))
                if rows:
                    t, item, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(t)), pa.array([b.ids[i] for i in item], item_type), *[pa.array(c, pa.int64()) for c in rest]], names=names)

        out = out.unionByName(d.mapInArrow(part, schema))
    return out.toDF(id_col, item_id_col if item_id_col != id_col else "item_" + item_id_col, *names[2:])


def remove(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that share no such span with any item; rows pass through the workers, none is shuffled."""
    sc, least, at = docs.sparkSession.sparkContext, k + window - 1, docs.columns.index(text_col)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema)])
    out = docs.toDF(*plain.names)
    for block in _blocks(benchmark, item_id_col, item_text_col, block_bytes, k, window):
        shared = sc.broadcast(block)

        def part(batches, shared=shared):
            b = shared.value
            for rb in batches:
                keep = np.ones(rb.num_rows, dtype=bool)
                for t, *_ in matches(b, rb.column(at).to_pylist(), least, k, window):
                    keep[t] = False
                yield rb.filter(pa.array(keep)) if not keep.all() else rb

        out = out.mapInArrow(part, plain)
    return out.toDF(*docs.columns)
