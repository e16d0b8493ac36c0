"""Sharding by a k-d tree over metadata.

A node that holds more than the target bytes is split at the weighted median (weight: bytes of text) of the dimension in
which it is widest, relative to the whole table. A narrow table of coordinates is all that the tree is made from. Its top is
built level by level, for all open nodes at once: partitions add up histograms, Spark adds those up, and the bin that holds
the median is refined until it holds one value, so medians are exact. Nodes of at most LOCAL_ROWS rows go to a task each, which
finishes them by sorting. So there are few passes, and the driver and the histograms hold few nodes, however many shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalens.llm import _io

BINS = 256
#: Rows of coordinates that a task takes at once to finish a node; it decides where a node is split, not how.
LOCAL_ROWS = 1 << 20
#: Bytes of the trees that workers get at once: beyond it rows pass through several times.
TREE_BYTES = 32 << 20
#: Partitions at most; beyond it a partition holds successive shards, sorted.
PARTITIONS = 1 << 15
DIMENSIONS = ("lang", "source", "doc_id", "#length")
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def ranks(df: DataFrame, name: str) -> DataFrame:
    """(value, rank) of the distinct values of a column as strings, without null, in their order from 0 on."""
    values = df.select(_io.column(df, name).cast("string").alias("value")).where("value is not null").distinct()
    return _io.numbered(values, "value", name="rank", first=0)


def placed(docs: DataFrame, *, text_col: str = "text", dimensions: tuple[str, ...] = DIMENSIONS) -> tuple[DataFrame, list[str]]:
    """(_d: the row, _w: bytes of its text, 1 at least, _c0, _c1, ...: coordinates in the order of ``dimensions``, null where there is none)
    and the coordinates' names. #length: characters of the text. Whole numbers, booleans, dates and times count as they are,
    floating-point numbers in Spark's order (NaN last), strings and everything else by the rank of their distinct text."""
    out = docs.select(F.struct(*[_io.column(docs, c).alias(c) for c in docs.columns]).alias("_d"), F.greatest(F.coalesce(F.octet_length(_io.column(docs, text_col)), F.lit(0)), F.lit(1)).cast("long").alias("_w"), *[_io.column(docs, d).alias(f"_v{i}") for i, d in enumerate(dimensions) if d != "#length"], F.length(_io.column(docs, text_col)).alias("_n"))
    for i, d in enumerate(dimensions):
        kind, name, v = T.LongType() if d == "#length" else docs.schema[d].dataType, f"_c{i}", F.col(f"_v{i}")
        if d == "#length":
            out = out.withColumn(name, F.coalesce(F.col("_n"), F.lit(0)).cast("long"))
        elif isinstance(kind, (*_INTEGERS, T.BooleanType)):
            out = out.withColumn(name, v.cast("long"))
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            out = out.withColumn(name, v.cast("double"))
        elif isinstance(kind, T.DateType):
            out = out.withColumn(name, F.unix_date(v).cast("long"))
        elif isinstance(kind, T.TimestampType):
            out = out.withColumn(name, F.unix_micros(v))
        else:
            r = _io.written(ranks(docs, d), "ranked").select(F.col("value").alias("_value"), F.col("rank").alias(name))
            out = out.join(F.broadcast(r) if _io.is_small(r) else r, v.cast("string") == F.col("_value"), "left").drop("_value")
    names = [f"_c{i}" for i in range(len(dimensions))]
    return out.select("_d", "_w", *names), names


def ordinals(c: np.ndarray | pa.Array) -> np.ndarray:
    """Whole or floating-point numbers as signed whole ones in the same order; minus zero is zero."""
    if c.dtype.kind != "f":
        return c
    bits = (c.astype(np.float64) + 0.0).view(np.int64)
    return np.where(np.isnan(c), np.int64(0x7FF8000000000000), np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def _points(columns: list[pa.Array], low: np.ndarray) -> np.ndarray:
    """One row a dimension: 0 for null, else 1 more than the distance from the least of the table."""
    out = np.empty((len(columns), len(columns[0])), dtype=np.uint64)
    for i, c in enumerate(columns):
        v = ordinals(c.fill_null(0).to_numpy(zero_copy_only=False)).view(np.uint64) - low[i : i + 1].view(np.uint64)
        out[i] = np.where(c.is_null().to_numpy(zero_copy_only=False), np.uint64(0), np.where(v == np.uint64(0xFFFFFFFFFFFFFFFF), v, v + np.uint64(1)))
    return out


@dataclass
class Tree:
    """Nodes as arrays; dim -1: a leaf. A row goes to the node ``left`` if its coordinate is at most ``at``, else to the one after that."""

    dim: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])

    def split(self, node: int, dim: int, at: int) -> tuple[int, int]:
        a = len(self.dim)
        self.dim[node], self.at[node], self.left[node] = dim, int(at), a
        for col, x in ((self.dim, -1), (self.at, 0), (self.left, -1)):
            col += [x, x]
        return a, a + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.dim, dtype=np.int8), np.array(self.at, dtype=np.uint64), np.array(self.left, dtype=np.int32)


def leaves(dim: np.ndarray, left: np.ndarray) -> list[int]:
    """The leaves from left to right."""
    out, stack = [], [0]
    while stack:
        k = stack.pop()
        if dim[k] < 0:
            out.append(k)
        else:
            stack += [int(left[k]) + 1, int(left[k])]
    return out


def find_nodes(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """x: one row a dimension. The leaf of each column of x."""
    dim, at, left = tree
    node = np.zeros(x.shape[1], dtype=np.int64)
    going = np.flatnonzero(dim[node] >= 0)
    while len(going):
        n = node[going]
        node[going] = left[n] + (x[dim[n], going] > at[n])
        going = going[dim[node[going]] >= 0]
    return node


def widest(lo: np.ndarray, hi: np.ndarray, scale: np.ndarray) -> tuple[int, float]:
    """The dimension of the greatest extent relative to ``scale``, the first of equal ones, and that extent."""
    width = np.divide((hi - lo).astype(float), scale, out=np.zeros(len(lo)), where=scale > 0)
    d = int(width.argmax())
    return d, float(width[d])


def finish(x: np.ndarray, w: np.ndarray, target: float, scale: np.ndarray) -> Tree:
    """The tree of one node, by sorting. x: one row a dimension."""
    tree, todo = Tree(), [(0, np.arange(x.shape[1]))]
    while todo:
        node, rows = todo.pop(0)
        if not len(rows) or w[rows].sum() <= target:
            continue
        v = x[:, rows]
        d, width = widest(v.min(axis=1), v.max(axis=1), scale)
        if width <= 0:
            continue
        order = np.argsort(v[d], kind="stable")
        values, sums = v[d][order], np.cumsum(w[rows][order])
        last = np.append(np.flatnonzero(values[1:] != values[:-1]), len(values) - 1)  # of each value
        k = int(np.searchsorted(sums[last], sums[-1] / 2))
        cut = values[last[min(k, len(last) - 2)]]
        a, b = tree.split(node, d, cut)
        todo += [(a, rows[v[d] <= cut]), (b, rows[v[d] > cut])]
    return tree


def _low(meta: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least coordinate of each dimension and what the dimensions extend over, nulls included."""
    one = meta.agg(*[f(F.col(f"_c{i}")).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))], *[F.count_if(F.col(f"_c{i}").isNull()).alias(f"no{i}") for i in range(k)]).first()
    low, span = np.zeros(k, np.int64), np.zeros(k)
    for i in range(k):
        if one[f"lo{i}"] is not None:
            a, b = (int(ordinals(np.array([one[f"{n}{i}"]]))[0]) for n in ("lo", "hi"))
            low[i], span[i] = a, float(b - a + (one[f"no{i}"] > 0))
    return low, span


def _read(b: pa.RecordBatch, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _points(b.columns[1:], low), b.column(0).to_numpy(zero_copy_only=False)


def _longs(*cols: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols]


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def _extent(meta: DataFrame, tree: Tree, open_nodes: list[int], low: np.ndarray) -> dict[int, tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows, weight, least and greatest coordinates of each open node."""
    shared, k, flip = meta.sparkSession.sparkContext.broadcast((tree.arrays(), np.array(open_nodes))), len(low), np.uint64(1 << 63)
    names = ["node", "n", "w", *[f"{m}{d}" for d in range(k) for m in ("lo", "hi")]]

    def part(batches):
        arrays, nodes = shared.value
        size = len(nodes)
        n, w, lo, hi = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full((k, size), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros((k, size), np.uint64)
        for b in batches:
            x, weight = _read(b, low)
            node = find_nodes(arrays, x)
            i = np.minimum(np.searchsorted(nodes, node), size - 1)
            ok = nodes[i] == node
            i, x = i[ok], x[:, ok]
            n += np.bincount(i, minlength=size)
            np.add.at(w, i, weight[ok])
            for d in range(k):
                np.minimum.at(lo[d], i, x[d])
                np.maximum.at(hi[d], i, x[d])
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(_longs(nodes[has], n[has], w[has], *[m[d][has] ^ flip for d in range(k) for m in (lo, hi)]), names=names)  # signed, for Spark's order

    rows = meta.mapInArrow(part, ", ".join(f"{x} long" for x in names)).groupBy("node").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *[(F.min if x[0] == "l" else F.max)(x).alias(x) for x in names[3:]]).collect()
    back = lambda r, m: np.array([_unsigned(r[f"{m}{d}"]) for d in range(k)], dtype=np.uint64) ^ flip
    return {r["node"]: (r["n"], r["w"], back(r, "lo"), back(r, "hi")) for r in rows}


def _medians(meta: DataFrame, tree: Tree, todo: dict[int, tuple[int, int, int, int]], low: np.ndarray) -> dict[int, int]:
    """todo: node -> (dimension, least, greatest, weight). The least coordinate up to which a node has half its weight; where
    that is its greatest, the greatest below it. Both sides of each split hold rows."""
    found: dict[int, int] = {}
    flip = np.uint64(1 << 63)
    state = {n: (d, lo, hi, 0, w, lo) for n, (d, lo, hi, w) in todo.items()}  # weight before lo, of the node, greatest below lo
    names = ["node", "bin", "before", "whole", "w", "least", "most"]
    while state:
        nodes = np.array(sorted(state))
        spec = tuple(np.array([state[n][j] for n in nodes], dtype=np.uint64 if j in (1, 2) else np.int64) for j in range(5))
        shared = meta.sparkSession.sparkContext.broadcast((tree.arrays(), nodes, spec))

        def part(batches):
            arrays, nodes, (dims, lo, hi, before, whole) = shared.value
            size = len(nodes) * BINS
            step = (hi - lo) // np.uint64(BINS) + np.uint64(1)
            w, least, most = np.zeros(size, np.int64), np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(size, np.uint64)
            for b in batches:
                x, weight = _read(b, low)
                node = find_nodes(arrays, x)
                i = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                at = np.flatnonzero(nodes[i] == node)
                i = i[at]
                v = x[dims[i], at]
                inside = (v >= lo[i]) & (v <= hi[i])
                i, v, at = i[inside], v[inside], at[inside]
                cell = i * BINS + ((v - lo[i]) // step[i]).astype(np.int64)
                np.add.at(w, cell, weight[at])
                np.minimum.at(least, cell, v)
                np.maximum.at(most, cell, v)
            has = np.flatnonzero(w)
            at = has // BINS
            yield pa.RecordBatch.from_arrays(_longs(nodes[at], has % BINS, before[at], whole[at], w[has], least[has] ^ flip, most[has] ^ flip), names=names)

        bins = meta.mapInArrow(part, ", ".join(f"{x} long" for x in names)).groupBy("node", "bin", "before", "whole").agg(F.sum("w").alias("w"), F.min("least").alias("least"), F.max("most").alias("most"))
        by = Window.partitionBy("node").orderBy("bin")  # as many rows as there are bins
        cum = bins.withColumn("cum", F.col("before") + F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("below", F.lag("most").over(by))
        for r in cum.where("2 * cum >= whole and 2 * (cum - w) < whole").select("node", "least", "most", "below", (F.col("cum") - F.col("w")).alias("sofar")).collect():
            d, _, _, _, whole, below = state.pop(r.node)
            least, most = (int(np.uint64(_unsigned(v)) ^ flip) for v in (r.least, r.most))
            below = below if r.below is None else int(np.uint64(_unsigned(r.below)) ^ flip)
            if least < most:
                state[r.node] = (d, least, most, r.sofar, whole, below)
            else:
                found[r.node] = least if least < todo[r.node][2] else below
    return found


def build(meta: DataFrame, low: np.ndarray, scale: np.ndarray, target_bytes: float) -> tuple[Tree, list[int]]:
    """The top of the tree, and those of its leaves that a task finishes. meta: weight and coordinates."""
    tree, open_nodes, small = Tree(), [0], []
    while open_nodes:
        todo = {}
        for node, (n, w, lo, hi) in _extent(meta, tree, open_nodes, low).items():
            d, width = widest(lo, hi, scale)
            if w > target_bytes and width > 0:
                if n <= LOCAL_ROWS:
                    small.append(node)
                else:
                    todo[node] = (d, int(lo[d]), int(hi[d]), w)
        cuts = _medians(meta, tree, todo, low)
        open_nodes = sorted(c for node in sorted(cuts) for c in tree.split(node, todo[node][0], cuts[node]))
    return tree, sorted(small)


def _finished(meta: DataFrame, tree: Tree, small: list[int], low: np.ndarray, scale: np.ndarray, target_bytes: float) -> DataFrame:
    """(node, dim, at, left): the rest of the tree below each of these leaves."""
    shared, k = meta.sparkSession.sparkContext.broadcast((tree.arrays(), np.array(small))), len(low)
    names = ["node", "w", *[f"c{i}" for i in range(k)]]

    def part(batches):
        arrays, nodes = shared.value
        for b in batches:
            x, weight = _read(b, low)
            node = find_nodes(arrays, x)
            ok = nodes[np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)] == node
            yield pa.RecordBatch.from_arrays(_longs(node[ok], weight[ok], *x[:, ok]), names=names)

    def one(t: pa.Table) -> pa.Table:
        cols = [c.to_numpy() for c in t.columns]
        dim, at, left = finish(np.vstack(cols[2:]).view(np.uint64), cols[1], target_bytes, scale).arrays()
        return pa.table({"node": pa.array([int(cols[0][0])]), "dim": [dim.astype(np.int64)], "at": [at.view(np.int64)], "left": [left.astype(np.int64)]})

    return meta.mapInArrow(part, ", ".join(f"{x} long" for x in names)).groupBy("node").applyInArrow(one, "node long, dim array<long>, at array<long>, left array<long>")


def _blocks(top: Tree, below: dict[int, tuple[np.ndarray, ...]]) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """(tree, shard of every node) with as much of what is below the top as TREE_BYTES holds; shards of leaves that are in other
    blocks, and of inner nodes, are -1. Leaves from left to right are 0, 1, ..."""
    dim, at, left = top.arrays()
    first, n = {}, 0
    for leaf in leaves(dim, left):
        first[leaf] = n
        n += int((below[leaf][0] < 0).sum()) if leaf in below else 1
    todo = [leaf for leaf in first if leaf in below]
    lone = [leaf for leaf in first if leaf not in below]
    while True:
        parts, shard, size, held = [[dim.copy()], [at.copy()], [left.copy()]], [np.full(len(dim), -1, np.int64)], len(dim), []
        while todo and (not held or 21 * (size + len(below[todo[0]][0])) <= TREE_BYTES):
            leaf = todo.pop(0)
            d, a, m = below[leaf]
            own = np.full(len(d), -1, np.int64)
            own[leaves(d, m)] = first[leaf] + np.arange(int((d < 0).sum()))
            # the root of what is below takes the leaf's place
            parts[0][0][leaf], parts[1][0][leaf], parts[2][0][leaf], shard[0][leaf] = d[0], a[0], m[0] + size - 1 if d[0] >= 0 else -1, own[0]
            for p, x in zip(parts, (d[1:], a[1:], np.where(m[1:] >= 0, m[1:] + size - 1, -1)), strict=True):
                p.append(x)
            shard.append(own[1:])
            size += len(d) - 1
            held.append(leaf)
        shard[0][lone] = [first[x] for x in lone]
        lone = []
        yield tuple(np.concatenate(p).astype(k) for p, k in zip(parts, (np.int8, np.uint64, np.int32), strict=True)), np.concatenate(shard)
        if not todo:
            return


def _finder(shared, low: np.ndarray):
    """A function of the coordinates: the shard."""

    def find(x: pa.Array) -> pa.Array:
        tree, shards = shared.value
        return pa.array(shards[find_nodes(tree, _points(x.flatten(), low))])

    find.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, "long")


@_io.tidy
def shard(docs: DataFrame, target_bytes: int = 32 << 20, *, text_col: str = "text", dimensions: tuple[str, ...] = DIMENSIONS, shard_col: str = "shard", move: bool = True) -> DataFrame:
    """docs and the shard of each row, rows of a shard together (``move=False``: where they were).

    Shards are numbered from left to right in the tree. A null coordinate comes before all others, NaN after; an empty or null
    text weighs one byte. Rows that are equal in all dimensions stay together, so a shard exceeds the target only if all of
    it is equal in all dimensions. An input column named like ``shard_col`` is replaced; an empty table stays empty.
    """
    sc = docs.sparkSession.sparkContext
    rows, names = placed(docs, text_col=text_col, dimensions=dimensions)
    meta = _io.written(rows.select("_w", *names), "coordinates")
    low, scale = _low(meta, len(names))
    top, small = build(meta, low, scale, target_bytes)
    below = {}
    if small:
        for r in _io.written(_finished(meta, top, small, low, scale, target_bytes), "trees").toLocalIterator():
            below[r.node] = tuple(np.array(v, dtype=np.int64).astype(k) if k != np.uint64 else np.array(v, dtype=np.int64).view(np.uint64) for v, k in ((r.dim, np.int8), (r["at"], np.uint64), (r.left, np.int32)))
    blocks = list(_blocks(top, below))
    parts = []
    for block in blocks:
        shared = sc.broadcast(block)

        own = rows.select("_d", _finder(shared, low)(F.struct(*names)).alias("_s"))
        parts.append(own if len(blocks) == 1 else own.where("_s >= 0"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select(*[F.col("_d").getField(c).alias(c) for c in docs.columns if c.lower() != shard_col.lower()], F.col("_s").alias(shard_col))
    if not move:
        return out
    n = max(int(s.max()) for _, s in blocks) + 1
    if n <= PARTITIONS:
        return out.repartitionById(n, F.col(shard_col).cast("int"))  # a shard a partition: hashing would put several into one
    return out.repartitionById(PARTITIONS, F.floor(F.col(shard_col) * F.lit(PARTITIONS) / F.lit(n)).cast("int")).sortWithinPartitions(shard_col)
