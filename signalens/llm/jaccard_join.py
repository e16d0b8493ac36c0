"""N-gram Jaccard join by parity sketches.

A document's set is that of its word n-grams. Sets of J >= t differ in at most (1-t)/(1+t) (|A|+|B|) n-grams. Sets are put
into size bands such that partners lie in the same or in neighbouring bands. In each band the n-grams with the least hashes
(all of them in small bands, about SAMPLE in others) are XOR-hashed into a sketch of SEGMENTS segments: an n-gram toggles one
bit of one segment, so an n-gram that differs changes one segment at most, and by the pigeonhole principle sets that differ
in fewer sampled n-grams than there are segments agree in a segment. Segments are kept as 64-bit XOR hashes and joined;
segments without n-grams are left out. The sketch folded to 256 bits has a Hamming distance that bounds the symmetric
difference of the samples from below, which drops most chance candidates before the rest is verified on the whole sets.

Large groups cost neither pairs nor a task of their own:

- Equal sets are one set from the start, however many documents have it.
- 1 - J is a metric. Sets whose J with a leader (of those that share segments with many others, the one that shares most) is
  (1+t)/2 or more make up the leader's home: any two of a home are linked, which the triangle inequality tells without a
  look at them. Segments join homes, not sets. Of two homes the distance of the leaders tells in most cases whether all or none of
  their sets are linked; only homes near the threshold are compared set by set, in blocks, each block against each in a task of
  its own that returns counts, not pairs.
- Segments that very many homes share (licence lines and the like) are not joined: the sets that have such segments meet
  in the rarest of their sampled n-grams, as many of them as must hold one that a partner has.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalens.llm import _io, _text

N, THRESHOLD = 3, 0.6
SAMPLE, LEAST_SEGMENTS = 64, 16
#: A segment shared by more homes than this is common: its homes meet in their rarest n-grams instead.
COMMON = 64
FOLD = 256
#: How often leaders are sought for the sets that have none yet. It decides how far groups shrink, not what is found.
ROUNDS = 1
#: Sets that meet in a task at once.
BLOCK = 256


@lru_cache(maxsize=8)
def _edges(t: float) -> np.ndarray:
    """The greatest size of each band: partners of a set in band b are in bands b-1, b and b+1."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, math.floor(low / t + 1e-9))
        out.append(high)
        low = high + 1
    return np.array(out, dtype=np.int64)


def band_of(size: int, t: float) -> int:
    return int(np.searchsorted(_edges(t), size))


@lru_cache(maxsize=512)
def level(b: int, t: float) -> tuple[int, float, int]:
    """(segments, share of n-grams that are sampled, the hash below which they are) in band b."""
    top = int(_edges(t)[b])
    share = min(1.0, SAMPLE / top)
    segments = max(LEAST_SEGMENTS, math.floor((1 - t) / t * min(top, SAMPLE)) + 1) if top > 2 else 1
    return segments, share, (1 << 64) - 1 if share == 1.0 else int(share * (1 << 64))


def sketches(sets: list[np.ndarray], bands: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many sets (their sorted hashes) in a band each: keys of the segments of their sketches, how many keys each has, and the
    folded sketches. A set in a negative band has none."""
    n = len(sets)
    size = np.array([len(u) for u in sets], dtype=np.int64)
    kinds, at = np.unique(np.maximum(bands, 0), return_inverse=True)
    levels = [level(int(b), t) for b in kinds]
    segments, below = np.array([x[0] for x in levels], dtype=np.uint64)[at], np.array([x[2] for x in levels], dtype=np.uint64)[at]
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    of = np.repeat(np.arange(n), size)
    sampled = np.flatnonzero((flat <= below[of]) & (bands >= 0)[of])
    of = of[sampled]
    band = bands.astype(np.uint64)[of]
    s = _text.mix(flat[sampled] + band)
    place = of * 4096 + (s % segments[of]).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    digest = np.bitwise_xor.reduceat(s[order], first) if len(first) else s[:0]
    owner = place[first] // 4096
    with np.errstate(over="ignore"):
        keys = _text.mix(digest ^ (bands.astype(np.uint64)[owner] * np.uint64(4096) + (place[first] % 4096).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.bincount(of * FOLD + (s >> np.uint64(40)).astype(np.int64) % FOLD, minlength=n * FOLD).reshape(n, FOLD) & 1
    return keys.view(np.int64), np.bincount(owner, minlength=n), np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def sketch(u: np.ndarray, b: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments of a set's sketch in band b, and the folded sketch."""
    keys, _, folded = sketches([u], np.array([b]), t)
    return keys, folded[0]


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set (none is empty) by which sets are equal."""
    size = np.array([len(u) for u in sets], dtype=np.uint64)
    flat, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(size.astype(np.int64))[:-1]])
    with np.errstate(over="ignore"):
        return tuple((np.bitwise_xor.reduceat(_text.mix(flat + np.uint64(c)), first) + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for c in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D))


_SKETCH = ("size", "band", "own", "low", "f_own", "f_low")


def _lists(x: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in x])]).astype(np.int32)), pa.array(np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64)))


def _rows(docs: DataFrame, n: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """Of every row: id, hash of the text, the set's hash (null without words), size, keys and folded sketches in its band and in
    the one below."""
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(_io.column(docs, id_col).alias("id"), F.xxhash64(_io.column(docs, text_col)).alias("th"), _io.column(docs, text_col).alias("text"))
    def part(batches):
        for rb in _io.slices(batches):
            sets = list(_text.gram_sets(rb.column(2).to_pylist(), n))
            size = np.array([len(u) for u in sets], dtype=np.int64)
            has = np.flatnonzero(size)
            band = np.searchsorted(_edges(t), size)
            hashes = np.zeros((2, len(sets)), dtype=np.int64)
            if len(has):
                hashes[:, has] = set_hashes([sets[i] for i in has])
            own, n_own, f_own = sketches(sets, np.where(size > 0, band, -1), t)
            low, n_low, f_low = sketches(sets, np.where(size > 0, band - 1, -1), t)
            lists = lambda x, count: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(x))
            four = np.full(len(sets), 4)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), *[pa.array(h, mask=size == 0) for h in hashes], pa.array(size), pa.array(band.astype(np.int64)), lists(own, n_own), lists(low, n_low), lists(f_own.ravel(), four), lists(f_low.ravel(), four)],
                names=["id", "th", "h1", "h2", *_SKETCH],
            )

    return d.mapInArrow(part, f"id {kind}, th long, h1 long, h2 long, size long, band long, own array<long>, low array<long>, f_own array<long>, f_low array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """One row a set: sid, its hash, how many documents have it, the first of these (least id, nulls last), and what the sketch needs."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("rep")
    one = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("copies"), first, *[F.first(c).alias(c) for c in _SKETCH])
    return one.withColumn("sid", F.monotonically_increasing_id())


def _texts(docs: DataFrame, need: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """need (a written table with the columns id and th of rows of docs) with the texts; rows that are repeated in docs are so here."""
    small = _io.hinted(need)
    d = docs.select(_io.column(docs, id_col).alias("id"), F.xxhash64(_io.column(docs, text_col)).alias("th"), _io.column(docs, text_col).alias("text")).alias("d")
    return d.join(small.alias("w"), (F.col("d.th") == F.col("w.th")) & F.col("d.id").eqNullSafe(F.col("w.id"))).select(*[f"w.{c}" for c in need.columns if c not in ("id", "th")], "text")


def _grams(docs: DataFrame, sets: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(sid, grams) of the sets in wanted(sid), from the text of their first documents."""
    need = _io.written(wanted.select("sid").distinct().join(sets.select("sid", "rep.id", "rep.th"), "sid"), "wanted")

    def part(batches):
        seen: set[int] = set()  # rows that are repeated in docs come once a task
        for rb in _io.slices(batches):
            new = [i for i, s in enumerate(rb.column(0).to_pylist()) if not (s in seen or seen.add(s))]
            rb = rb.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([rb.column(0), _lists(list(_text.gram_sets(rb.column(1).to_pylist(), n)))], names=["sid", "grams"])

    return _texts(docs, need, id_col, text_col).select("sid", "text").mapInArrow(part, "sid long, grams array<long>")


def _slices(grams: pa.ChunkedArray) -> list[np.ndarray]:
    one = grams.combine_chunks()
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    value, off = one.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(one.value_lengths().to_numpy())])
    return [value[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def _jaccards(docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, jaccard) of the pairs of sets whose whole sets have J >= least. pairs: a written table (a, b, meet, least); pairs of one
    ``meet`` are compared in one task, to which each of their sets is sent once."""
    at = pairs.select("meet", F.col("a").alias("sid")).unionByName(pairs.select("meet", F.col("b").alias("sid"))).distinct()
    at = _io.written(at, "meetings")  # small beside the n-grams, which are then shuffled once
    tasks = max(1, at.count() // BLOCK)
    bucket = F.pmod(F.xxhash64("meet"), F.lit(tasks)).alias("bucket")
    whole = _grams(docs, sets, at, n, id_col, text_col)

    def compare(pairs: pa.Table, members: pa.Table) -> pa.Table:
        have = dict(zip(members.column("sid").to_pylist(), _slices(members.column("grams")), strict=True))
        a, b, j = [], [], []
        for x, y, least in zip(*[pairs.column(c).to_pylist() for c in ("a", "b", "least")], strict=True):
            p, q = have[x], have[y]
            if len(p) > len(q):
                p, q = q, p
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            r = both / (len(p) + len(q) - both)
            if r >= least:
                a.append(x)
                b.append(y)
                j.append(r)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "jaccard": pa.array(j, pa.float64())})

    members = whole.join(_io.hinted(at).select(bucket, "sid").distinct(), "sid")
    return pairs.select(bucket, "a", "b", "least").groupBy("bucket").cogroup(members.groupBy("bucket")).applyInArrow(compare, "a long, b long, jaccard double")


def _near(pairs: DataFrame, sets: DataFrame, t: float, least: Column) -> DataFrame:
    """The pairs (a, b, ...) that sizes and Hamming distances don't rule out for J >= least, with that as a column. Where the
    bands are not neighbours the sketches cannot be compared; such pairs stay if less than t is asked for."""
    cols = ("size", "band", "f_own", "f_low")
    side = lambda x: sets.select(F.col("sid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in cols])
    both = pairs.withColumn("least", F.greatest(F.lit(0.0), least)).join(side("a"), "a").join(side("b"), "b")
    same, lower = F.col("a_band") == F.col("b_band"), F.col("a_band") < F.col("b_band")
    fa, fb = F.when(same | lower, F.col("a_f_own")).otherwise(F.col("a_f_low")), F.when(same | ~lower, F.col("b_f_own")).otherwise(F.col("b_f_low"))
    hamming = F.aggregate(F.zip_with(fa, fb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    tops = F.array(*[F.lit(float(x)) for x in _edges(t)])
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.element_at(tops, (F.least("a_band", "b_band") + 1).cast("int")))
    mean = F.floor((1 - F.col("least")) / (1 + F.col("least")) * (F.col("a_size") + F.col("b_size")) + 1e-9) * share
    most = mean + F.when(share < 1.0, 4 * F.sqrt(mean) + 1).otherwise(0.0)
    sizes = F.least("a_size", "b_size") >= F.col("least") * F.greatest("a_size", "b_size") - 1e-9
    ok = sizes & F.when(F.abs(F.col("a_band") - F.col("b_band")) <= 1, hamming <= most).otherwise(F.col("least") < t)
    return both.where(ok).select(*pairs.columns, "least")


def _shared(sets: DataFrame) -> DataFrame:
    """(key, sid, down, n): segments that n > 1 sets have; down is 1 for those of the band below. Counts are added up before
    the shuffle; adaptive execution splits a hot key's rows in the join."""
    keys = sets.select("sid", F.size("own").alias("n_own"), F.posexplode(F.concat("own", "low")).alias("at", "key")).select("key", "sid", (F.col("at") >= F.col("n_own")).cast("int").alias("down"))
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _homes(docs: DataFrame, sets: DataFrame, shared: DataFrame, n: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """(sid, home, d): sets that lie within (1-t)/2 of a leader. No leader has a home but itself."""
    found, left = None, shared.where("down = 0").select("key", "sid", "n")  # groups mostly lie in one band
    for _ in range(ROUNDS):
        score = left.groupBy("sid").agg(F.sum("n").alias("score"))
        scored = left.join(score, "sid")
        lead = scored.groupBy("key").agg(F.max(F.struct("score", "sid")).alias("lead"))
        votes = scored.select("key", "sid").join(lead.select("key", F.col("lead.sid").alias("lead")), "key").groupBy("sid", "lead").agg(F.count("*").alias("c"))
        choice = votes.groupBy("sid").agg(F.max(F.struct("c", "lead")).alias("v")).select(F.col("sid").alias("a"), F.col("v.lead").alias("b")).where("a <> b")
        near = _io.written(_near(choice, sets, t, F.lit((1 + t) / 2)), "choices")
        size = near.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        stars = _io.written(near.join(size, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), "blocks")).alias("meet"), "least"), "stars")
        close = _io.written(_jaccards(docs, sets, stars, n, id_col, text_col), "close")
        led = close.select(F.col("a").alias("b")).distinct()  # leaders that have a home themselves lead none
        homed = _io.written(close.join(led, "b", "left_anti").select(F.col("a").alias("sid"), F.col("b").alias("home"), (1 - F.col("jaccard")).alias("d")), "homes")
        found = homed if found is None else found.unionByName(homed)
        if homed.isEmpty():
            break
        gone = homed.select("sid").unionByName(homed.select(F.col("home").alias("sid"))).distinct()
        left = left.join(gone, "sid", "left_anti")
    return found


def reach(k: int, t: float, whole: bool) -> int:
    """Of k sampled n-grams so many, the first of any order that all sets share, hold one that a set of J >= t shares: at most
    a share of 1-t isn't shared, to which a sample adds four standard deviations."""
    return min(k, math.floor((1 - t) * k + (0.0 if whole else 4 * math.sqrt(k * t * (1 - t))) + 1e-9) + 1)


def _by_grams(docs: DataFrame, sets: DataFrame, hot: DataFrame, n: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """(key, home, down, rest, k) by the sampled n-grams of sets in a level of whose segments they have common ones.

    n-grams are ordered by the number of sets that have them, and sets meet in the first of theirs only (prefix filter), if
    what is left of both from there on is enough. So lines that most sets share make pairs of sets only that consist of them.
    hot: (sid, home, down) of the sets; down is 1 for the level of the band below.
    """
    levels = hot.groupBy("sid", "home").agg(F.max(F.col("down") == 0).alias("own"), F.max(F.col("down") == 1).alias("low"))
    need = _io.written(levels.join(sets.select("sid", "rep.id", "rep.th"), "sid"), "common")

    def part(batches):
        seen: set[int] = set()
        for rb in _io.slices(batches):
            at, facts, keys = [], [], []
            wanted = list(zip(*[rb.column(c).to_pylist() for c in range(3)], strict=True))
            new = [i for i, (s, _, _) in enumerate(wanted) if not (s in seen or seen.add(s))]
            texts = rb.column(4).take(pa.array(new, pa.int64())).to_pylist()
            for i, u in zip(new, _text.gram_sets(texts, n), strict=True):
                b = band_of(len(u), t)
                for d in [d for d, has in enumerate(wanted[i][1:]) if has and b >= d]:
                    _, share, below = level(b - d, t)
                    s = u[: np.searchsorted(u, np.uint64(below), "right")]
                    at.append(i)
                    facts.append((d, share == 1.0, len(s), reach(len(s), t, share == 1.0)))
                    with np.errstate(over="ignore"):
                        keys.append(_text.mix(s + np.uint64(b - d + 1) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
            took, down, whole = rb.take(pa.array(at, pa.int64())), [x[0] for x in facts], [x[1] for x in facts]
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(3), pa.array(down, pa.int32()), pa.array(whole, pa.bool_()), *[pa.array([x[i] for x in facts], pa.int32()) for i in (2, 3)], _lists(keys)], names=["sid", "home", "down", "whole", "k", "reach", "keys"])

    rows = _texts(docs, need, id_col, text_col).select("sid", "own", "low", "home", "text").mapInArrow(part, "sid long, home long, down int, whole boolean, k int, reach int, keys array<long>")
    rows = _io.written(rows.withColumn("of", 2 * F.col("sid") + F.col("down")), "common-grams")
    once = rows.select("of").distinct().count() == rows.count()  # else rows that are repeated in docs came in several tasks
    grams = (rows if once else rows.groupBy("of").agg(F.first("keys").alias("keys"))).select("of", F.explode("keys").alias("key"))  # narrow: they are many
    shared = grams.join(grams.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    by = Window.partitionBy("of")  # as many rows as a sample has n-grams
    order = shared.withColumn("shared", F.count("*").over(by)).withColumn("at", F.row_number().over(by.orderBy("n", "key")))
    facts = rows.groupBy("of").agg(*[F.first(c).alias(c) for c in ("home", "down", "whole", "k", "reach")])
    used = order.join(facts, "of").withColumn("place", F.col("k") - F.col("shared") + F.col("at")).where("place <= reach").select("key", "home", "down", "whole", (F.col("k") - F.col("place") + 1).alias("rest"), "k")
    return used.groupBy("key", "home").agg(F.min("down").alias("down"), F.first("whole").alias("whole"), F.max("rest").alias("rest"), F.min("k").alias("k"))


def _candidates(docs: DataFrame, sets: DataFrame, shared: DataFrame, homes: DataFrame, n: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b, key): pairs of homes of which sets share a segment, or an n-gram that stands for common segments; key is the least."""
    of = F.coalesce("home", "sid")
    keyed = _io.written(shared.select("key", "sid", "down").join(homes.select("sid", "home"), "sid", "left").select("key", "sid", "down", of.alias("home")), "keys")
    per = keyed.groupBy("key", "home").agg(F.min("down").alias("down"))
    per = per.join(per.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    meet = _io.written(per, "segments")
    used, hot = meet.where(F.col("n") <= COMMON).select("key", "home", "down"), meet.where(F.col("n") > COMMON).select("key").distinct()

    def joined(by: DataFrame, more: Column) -> DataFrame:
        x, y = by.alias("x"), by.alias("y")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.home") < F.col("y.home")) & (F.col("x.down") + F.col("y.down") < 2)
        return x.join(y, on & more).select("x.key", F.col("x.home").alias("a"), F.col("y.home").alias("b"))

    pairs = joined(used, F.lit(True))
    if not hot.isEmpty():
        grams = _io.written(_by_grams(docs, sets, keyed.join(hot, "key", "left_semi"), n, t, id_col, text_col), "grams")
        k = F.col("x.k") + F.col("y.k")
        least = F.lit(t / (1 + t)) * k - F.when(F.col("x.whole"), 1e-6).otherwise(4 * F.sqrt(k * (t * (1 - t) / (1 + t))) / (1 + t))
        pairs = pairs.unionByName(joined(grams, F.least("x.rest", "y.rest") >= least))
    return pairs.groupBy("a", "b").agg(F.min("key").alias("key"))


def _in_blocks(docs: DataFrame, sets: DataFrame, amb: DataFrame, members: DataFrame, n: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """Sets of two homes compared each with each. amb: (anchor, other); members: (home, sid). Returns rows (sid, null, null, links) and
    (null, anchor, other, links): how many links a set has across such homes, and how many two homes have between their sets."""
    size = members.groupBy("home").agg(F.count("*").alias("n"))
    blocks = amb.join(size.withColumnRenamed("home", "other"), "other").groupBy("anchor").agg(F.sum("n").alias("pool")).join(size.withColumnRenamed("home", "anchor"), "anchor")
    blocks = _io.written(blocks.select("anchor", F.ceil(F.col("n") / BLOCK).alias("na"), F.ceil(F.col("pool") / BLOCK).alias("nb")), "blocks")
    mine = lambda k: F.pmod(F.xxhash64("sid"), k).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), (F.col(k) - 1).cast("int")))
    left = blocks.join(members.withColumnRenamed("home", "anchor"), "anchor").select("anchor", F.lit(None).cast("long").alias("other"), "sid", mine("na").alias("ba"), all_of("nb").alias("bb"))
    right = amb.join(members.withColumnRenamed("home", "other"), "other").join(blocks, "anchor").select("anchor", "other", "sid", mine("nb").alias("bb"), all_of("na").alias("ba"))
    at = _io.written(left.unionByName(right), "blocks")
    tasks = max(1, at.count() // (2 * BLOCK))
    rows = _grams(docs, sets, at, n, id_col, text_col).join(_io.hinted(at.withColumn("bucket", F.pmod(F.xxhash64("anchor", "ba", "bb"), F.lit(tasks)))), "sid")

    def count(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("anchor", "other", "sid", "ba", "bb")}
        grams, places, out = _slices(table.column("grams")), {}, []
        for i, (a, o, s, x, y) in enumerate(zip(*cols.values(), strict=True)):
            places.setdefault((a, x, y), ({}, {}))[o is not None][s, o] = i
        for (anchor, _, _), (p, q) in places.items():
            if not p or not q:
                continue
            hit = linked([grams[i] for i in p.values()], [grams[i] for i in q.values()], t)
            out += [(s, None, None, int(c)) for (s, _), c in zip(p, hit.sum(axis=1), strict=True) if c] + [(s, None, None, int(c)) for (s, _), c in zip(q, hit.sum(axis=0), strict=True) if c]
            per: dict[int, int] = {}
            for (_, o), c in zip(q, hit.sum(axis=0), strict=True):
                per[o] = per.get(o, 0) + int(c)
            out += [(None, anchor, o, c) for o, c in per.items() if c]
        return pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("sid", "anchor", "other", "links"))})

    return rows.groupBy("bucket").applyInArrow(count, "sid long, anchor long, other long, links long")


def linked(left: list[np.ndarray], right: list[np.ndarray], t: float) -> np.ndarray:
    """Whether each of left has J >= t with each of right, by products of membership matrices over the n-grams on both sides."""
    g, h = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(g, h)
    common = np.zeros((len(left), len(right)))
    place = lambda x, sets: (np.minimum(np.searchsorted(both, x), max(0, len(both) - 1)), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    if len(both):
        (pg, rg), (ph, rh) = place(g, left), place(h, right)
        ok_g, ok_h = both[pg] == g, both[ph] == h
        pg, rg, ph, rh = pg[ok_g], rg[ok_g], ph[ok_h], rh[ok_h]
        og, oh = np.argsort(pg, kind="stable"), np.argsort(ph, kind="stable")
        pg, rg, ph, rh = pg[og], rg[og], ph[oh], rh[oh]
        for at in range(0, len(both), 4096):
            width = min(4096, len(both) - at)
            a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            i, j = np.searchsorted(pg, [at, at + width])
            a[rg[i:j], pg[i:j] - at] = 1
            i, j = np.searchsorted(ph, [at, at + width])
            b[rh[i:j], ph[i:j] - at] = 1
            common += a @ b.T
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None]
    return common / (total - common) >= t


def components(pairs: DataFrame) -> DataFrame:
    """(sid, root): the least set that each set of a pair is connected with, by label propagation with pointer jumping."""
    edges = _io.written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = _io.written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("sid"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = edges.join(label.select(F.col("sid").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(seen, label.sid == seen.a).select("sid", "root", F.least("root", "near").alias("low"))
        jump = label.select(F.col("sid").alias("low"), F.col("root").alias("far"))
        after = _io.written(step.join(jump, "low").select("sid", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("moved")), "labels")
        _io.drop(label)
        label = after.select("sid", "root")
        if after.where("moved").isEmpty():
            return label


@_io.tidy
def _classes(docs: DataFrame, n: int, t: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes), both written. rows: (id, th, h1, h2) of every row of docs; classes: (h1, h2, best, in_class, copies, links) of every set."""
    rows = _io.written(_rows(docs, n, t, id_col, text_col), "rows")
    sets = _io.written(_sets(rows), "sets")
    shared = _io.written(_shared(sets), "shared")
    homed = _homes(docs, sets, shared, n, t, id_col, text_col)
    home = _io.written(homed.groupBy("home").agg((F.count("*") + 1).alias("n"), F.max("d").alias("r")), "radii")
    found = _io.written(_candidates(docs, sets, shared, homed, n, t, id_col, text_col), "pairs")
    side = lambda x: home.select(F.col("home").alias(x), F.col("n").alias(f"{x}_n"), F.col("r").alias(f"{x}_r"))
    sized = found.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({f"{x}_{c}": F.coalesce(f"{x}_{c}", F.lit(v)) for x in "ab" for c, v in (("n", 1), ("r", 0.0))})
    near = _io.written(_near(sized, sets, t, t - F.col("a_r") - F.col("b_r") - 1e-9 * (F.col("a_n") + F.col("b_n") > 2).cast("int")), "candidates")
    many = near.select("key", F.col("a").alias("s")).unionByName(near.select("key", F.col("b").alias("s"))).distinct().groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1)))
    placed = near.join(many, "key", "left").select("a", "b", F.xxhash64("key", F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))).alias("meet"), "least")
    leaders = _jaccards(docs, sets, _io.written(placed, "placed"), n, id_col, text_col)
    known = _io.written(near.select("a", "b", "a_n", "b_n", "a_r", "b_r").join(leaders, ["a", "b"]), "leaders")
    single, slack = (F.col("a_n") == 1) & (F.col("b_n") == 1), F.col("a_r") + F.col("b_r")
    all_linked = (single & (F.col("jaccard") >= t)) | (~single & (1 - F.col("jaccard") + slack <= 1 - t - 1e-9))
    whole = known.where(all_linked)
    amb = _io.written(known.where(~all_linked & ~single).select(*[F.when((F.col("a_n") >= F.col("b_n")) == first, F.col("a")).otherwise(F.col("b")).alias(c) for c, first in (("anchor", True), ("other", False))]), "near-homes")
    links = [homed.select("sid", F.col("home")).join(home, "home").select("sid", (F.col("n") - 1).alias("links")), home.select(F.col("home").alias("sid"), (F.col("n") - 1).alias("links"))]
    edges = [whole.select("a", "b")]
    member = homed.select("home", "sid").unionByName(home.select("home", F.col("home").alias("sid")))
    across = whole.select(F.col("a").alias("home"), F.col("b_n").alias("links")).unionByName(whole.select(F.col("b").alias("home"), F.col("a_n").alias("links"))).groupBy("home").agg(F.sum("links").alias("links"))
    links.append(across.join(member, "home", "left").select(F.coalesce("sid", "home").alias("sid"), "links"))
    if not amb.isEmpty():
        lone = amb.select(F.col("other").alias("home")).distinct().join(home, "home", "left_anti").select("home", F.col("home").alias("sid"))
        counted = _io.written(_in_blocks(docs, sets, amb, member.unionByName(lone), n, t, id_col, text_col), "counted")
        links.append(counted.where("sid is not null").select("sid", "links"))
        edges.append(counted.where("sid is null").select(F.col("anchor").alias("a"), F.col("other").alias("b")).distinct())
    total, joined = links[0], edges[0]
    for x in links[1:]:
        total = total.unionByName(x)
    for x in edges[1:]:
        joined = joined.unionByName(x)
    root = components(joined).select(F.col("sid").alias("home"), "root")
    placed = sets.select("sid", "h1", "h2", "copies", "rep").join(homed.select("sid", "home"), "sid", "left").withColumn("home", F.coalesce("home", "sid")).join(root, "home", "left").withColumn("root", F.coalesce("root", "home"))
    placed = _io.written(placed.join(total.groupBy("sid").agg(F.sum("links").alias("links")), "sid", "left").select("h1", "h2", "copies", "rep", "root", F.coalesce("links", F.lit(0)).alias("links")), "placed")
    best = placed.groupBy("root").agg(F.min("rep").alias("best"), F.sum("copies").alias("in_class"))
    return rows.select("id", "th", "h1", "h2"), _io.written(placed.join(best, "root").select("h1", "h2", "best", "in_class", "copies", "links"), "classes")


@_io.tidy
def classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: id, class_id, copies, links. Documents whose sets of word n-grams have a Jaccard index of at least t are linked; a
    class is what links connect, and class_id its least id (null if none of it has an id). copies: rows with the same set, itself
    included; links: different sets with which the row's set is linked.

    Words are compared without case and punctuation. A text of fewer than n words has one n-gram, all its words; a null text
    or one without words is a class of its own without links. Null ids are kept, and repeated rows are copies of each other.
    Other columns play no part; an empty table gives none. The search misses few links near t (tests hold it against
    brute force); links that are counted are exact, but for sets of one 128-bit hash being taken as equal.
    """
    rows, found = _classes(docs, n, t, id_col, text_col)
    out = rows.join(found.select("h1", "h2", F.col("best.id").alias("best_id"), "copies", "links"), ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("best_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


@_io.tidy
def deduplicate(docs: DataFrame, n: int = N, t: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near duplicates, that of the least id (null ids last; of equal rows, one).

    Classes are those of classes(). Rows whose text is null or has no words are in no class and stay.
    """
    rows, found = _classes(docs, n, t, id_col, text_col)
    m = rows.join(found.where("in_class > 1").select("h1", "h2", F.struct("best.id", "best.th").alias("best")), ["h1", "h2"]).select("id", "th", (F.struct("id", "th") == F.col("best")).alias("first"))
    named = _io.written(m.groupBy("id", "th", "first").agg(F.count("*").alias("n")), "decided")
    d = docs.select(F.struct(*[_io.column(docs, c).alias(c) for c in docs.columns]).alias("d"), _io.column(docs, id_col).alias("id"), F.xxhash64(_io.column(docs, text_col)).alias("th"))
    small = _io.is_small(named)

    def against(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        r = right.select(F.col("id").alias("r_id"), F.col("th").alias("r_th"))
        return left.join(F.broadcast(r) if small else r, (F.col("th") == F.col("r_th")) & F.col("id").eqNullSafe(F.col("r_id")), how)

    kept, again = against(d, named.where("not first"), "left_anti"), named.where("first and n > 1")
    if not again.isEmpty():  # rows that are equal even in id and text
        kept = against(kept, again, "left_anti").unionByName(against(kept, again, "left_semi").dropDuplicates(["id", "th"]))
    return kept.select("d.*")
