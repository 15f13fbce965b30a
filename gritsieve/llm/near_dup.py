"""Operator 10: SimHash near-duplicate groups by May-Ozerov recursion.

Every text gets a 128-bit SimHash of its distinct folded words. Fingerprints within ``radius`` bits are neighbours and
groups are the connected components of neighbours. Neighbours are found as May and Ozerov (2015) do: coordinates are
permuted and cut into strips; a node of the recursion draws random centres and keeps, for each, the fingerprints whose
distance to the centre on the node's strip is at most ``weight``; the kept lists recurse on the next strip with centres of
their own, and after ``depth`` strips are small and searched by brute force. The number of centres is computed so that a pair
*at* the radius is met with probability ``recall`` (nearer pairs more often). Depth and weight are parameters (:class:`Plan`)
and the same at every size, so which pairs are met doesn't depend on other rows; :func:`cheapest` says which would cost least
for an expected number of distinct fingerprints. The default is the cheapest with two levels for 12 million.

Scale: exact copies and texts with equal fingerprints collapse before the search, so a hot group costs one row; the
recursion is a map over fingerprints (32 bytes a row are shuffled, text never). A leaf emits a spanning forest, not all
pairs, and in a leaf beyond ``LEAF`` rows what a pivot's neighbourhood already joins isn't compared again, so a large group
of copies that differ costs linear time. Groups are counted by partial aggregation; no window spans a group. Rows in and out:

* null texts are in no group; wordless texts (empty, white space, punctuation) have no fingerprint and are grouped with
  exact copies alone;
* texts of any length have one; equal texts, also those of repeated rows, have the same one;
* a null ``doc_id`` counts as greater than all others, so it represents a group only if all are null;
* repeated rows (the same id and text) are one member; an empty table gives an empty result;
* further columns of any name are ignored by :func:`groups` and kept by :func:`dedup`.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Stored
from .textkernel import Words, chunks, mix, need, row_key

BITS, STRIP = 128, 64
RADIUS = 20
RECALL = 0.9
#: Rows of a leaf up to which all its pairs are compared.
LEAF = 1024
_U = np.uint64
_LANES = _U(0x0101010101010101)


def _sums(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 128) counts of set bits; byte lanes add 8 counters at once, in runs of at most 255."""
    rows = len(first) - 1
    out = np.zeros((rows, BITS), np.int64)
    count = np.diff(first)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    runs = -(-count[full] // 255)
    begin = np.concatenate([[0], np.cumsum(runs)])
    cut = np.repeat(first[:-1][full], runs) + 255 * (np.arange(begin[-1]) - np.repeat(begin[:-1], runs))
    for half, salt in enumerate((0, 0x5BF03635D1A6E2C9)):
        h = mix(hashes ^ _U(salt))
        for shift in range(8):
            part = np.add.reduceat((h >> _U(shift)) & _LANES, cut).view(np.uint8).reshape(-1, 8)
            out[full, 64 * half + 8 * np.arange(8)[:, None] + shift] = np.add.reduceat(part.astype(np.int64), begin[:-1], axis=0).T
    return out


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n, 2) uint64 fingerprints, which rows have one) of an Arrow string column.

    Bit b is set if more than half of the row's distinct words have bit b of their hash set.
    """
    out, have = [np.zeros((0, 2), np.uint64)], [np.zeros(0, bool)]
    for start, end, data, off in chunks(column):
        w = Words(data, off)
        key = np.sort((w.row().astype(np.uint64) << _U(44)) | (w.hash >> _U(20)))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        first = np.searchsorted(key, np.arange(end - start + 1, dtype=np.uint64) << _U(44))
        total = _sums(mix(key & _U((1 << 44) - 1)), first)
        bits = 2 * total > np.diff(first)[:, None]
        out.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        have.append(np.diff(first) > 0)
    return np.concatenate(out), np.concatenate(have)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, have = fingerprints(b["text"])
        key = np.stack([b[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("_k1", "_k2")], 1)
        fp = np.where(have[:, None], fp, key)  # without words, the text's hash
        hi, lo = (pa.array(np.ascontiguousarray(fp[:, j]).view(np.int64)) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([*[b[c] for c in ("doc_id", "_k1", "_k2")], hi, lo, pa.array(have)], names=["doc_id", "_k1", "_k2", "hi", "lo", "words"])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, _k1, _k2, hi, lo, words): one narrow row for each text; ``words`` says that (hi, lo) is a fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = need(docs, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", "text", *row_key(F.col("text")))
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {kind}, _k1 long, _k2 long, hi long, lo long, words boolean")


def _pass(weight: int) -> float:
    return sum(math.comb(STRIP, i) for i in range(weight + 1)) / 2**STRIP


def _both(weight: int, d: int) -> float:
    """Probability that a random centre is within ``weight`` of both of two strips that differ in d bits."""
    total = 0
    for i in range(d + 1):  # of the d differing bits, the centre agrees with the first on d - i
        most = weight - max(i, d - i)
        if most >= 0:
            total += math.comb(d, i) * sum(math.comb(STRIP - d, j) for j in range(most + 1))
    return total / 2**STRIP


@functools.cache
def _centres(depth: int, weight: int, radius: int, recall: float) -> int:
    """The least number of centres a node needs for pairs at the radius, whose bits fall on strips at random, to be met with ``recall``."""
    chance = [math.comb(STRIP, d) * math.comb(BITS - STRIP, radius - d) / math.comb(BITS, radius) if radius - d <= BITS - STRIP else 0 for d in range(min(STRIP, radius) + 1)]
    both = [_both(weight, d) for d in range(len(chance))]

    def met(centres: int) -> float:
        found = 1.0  # from the last level: a shared list leads to a shared leaf with the chance of the level below
        for _ in range(depth):
            found = sum(c * (1 - math.exp(-centres * b * found)) for c, b in zip(chance, both, strict=True))
        return found

    low, high = 1, 1 << 30
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if met(mid) >= recall else (mid + 1, high)
    return low


@dataclass(frozen=True)
class Plan:
    """Levels of the recursion and the distance to a centre, on a strip, up to which its list takes a fingerprint."""

    depth: int = 2
    weight: int = 22


def cheapest(n: int, depths: tuple[int, ...] = (2, 3), radius: int = RADIUS, recall: float = RECALL) -> Plan:
    """The plan that should cost least for about n distinct fingerprints, as a help in choosing one; nothing here calls it.

    The cost in seconds counts comparisons with centres, rows shuffled and sorted, and comparisons in leaves. Every plan
    meets the same recall.
    """
    best = None
    for depth in depths:
        for weight in range(14, STRIP // 2 + 1):
            p, centres = _pass(weight), _centres(depth, weight, radius, recall)
            lists = (centres * p) ** depth
            looks = sum((centres * p) ** k for k in range(depth)) * centres
            cost = n * (looks * 3e-9 + lists * 3e-6) + n * n * lists * p**depth * 3e-9
            if best is None or cost < best[0]:
                best = cost, Plan(depth, weight)
    return best[1]


class Recursion:
    """The lists (leaf buckets) to which fingerprints belong; the same on every executor for a seed."""

    def __init__(self, depth: int, weight: int, centres: int, seed: int = 7):
        self.depth, self.centres, self.weight, self.seed = depth, centres, weight, seed
        rng = np.random.default_rng(seed)
        self.order = np.concatenate([rng.permutation(BITS) for _ in range(-(-depth * STRIP // BITS))])[: depth * STRIP]

    def strips(self, fp: np.ndarray) -> np.ndarray:
        """(n, depth) uint64: two levels cut one permutation of the coordinates, further levels another."""
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 16), axis=1, bitorder="little")
        return np.packbits(np.ascontiguousarray(bits[:, self.order]), axis=1, bitorder="little").view(np.uint64)

    def leaves(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket ids, rows of ``fp``) pieces."""
        strips = self.strips(fp)
        for start in range(0, len(fp), 4096):
            yield from self._node(strips, np.arange(start, min(start + 4096, len(fp))), 0, self.seed)

    def _node(self, strips: np.ndarray, rows: np.ndarray, level: int, path: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        with np.errstate(over="ignore"):
            child = mix(_U(path) * _U(0xD1B54A32D192ED03) + np.arange(1, self.centres + 1, dtype=np.uint64))
        centre = mix(child ^ _U(0x2545F4914F6CDD1D))
        x = strips[rows, level]
        which, at = [], []
        for c in range(0, self.centres, 64):
            w, a = np.nonzero(np.bitwise_count(centre[c : c + 64, None] ^ x[None, :]) <= self.weight)
            which.append(w + c)
            at.append(a)
        which, at = np.concatenate(which), np.concatenate(at)
        if level + 1 == self.depth:
            yield child[which], rows[at]
            return
        cut = np.searchsorted(which, np.arange(self.centres + 1))
        for c in np.flatnonzero(np.diff(cut)):
            yield from self._node(strips, rows[at[cut[c] : cut[c + 1]]], level + 1, int(child[c]))


def _fp_array(b: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([b[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in names], 1)


def _spread(recursion: Recursion):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _fp_array(b, "hi", "lo")
            signed = fp.view(np.int64)
            bucket, row, held = [], [], 0
            for k, r in recursion.leaves(fp):
                bucket.append(k)
                row.append(r)
                held += len(k)
                if held > 1 << 18:
                    yield _spread_batch(bucket, row, signed)
                    bucket, row, held = [], [], 0
            if held:
                yield _spread_batch(bucket, row, signed)

    return run


def _spread_batch(bucket: list, row: list, signed: np.ndarray) -> pa.RecordBatch:
    k, r = np.concatenate(bucket).view(np.int64), np.concatenate(row)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.ascontiguousarray(signed[r, 0])), pa.array(np.ascontiguousarray(signed[r, 1]))], names=["bucket", "hi", "lo"])


def _small_edges(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the radius in runs of equal ``bucket``, by comparing rows 1, 2, 3, … places apart."""
    n = len(bucket)
    ends = np.flatnonzero(np.concatenate([bucket[1:] != bucket[:-1], [True]])) + 1
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    hi, lo = np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1])
    left, right, at, lag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(n), 0
    while True:
        lag += 1
        at = at[at + lag < end[at]]
        if not len(at):
            return np.concatenate(left), np.concatenate(right)
        near = at[np.bitwise_count(hi[at] ^ hi[at + lag]) + np.bitwise_count(lo[at] ^ lo[at + lag]) <= radius]
        if len(near):
            left.append(near)
            right.append(near + lag)


def _large_edges(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all rows within the radius of a large leaf.

    From a pivot, its neighbours are joined and asked in turn, but only for rows that aren't joined yet and whose distance to
    the pivot lets them be neighbours (triangle inequality).
    """
    hi, lo = np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1])

    def apart(i: int, rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count(hi[rows] ^ hi[i]) + np.bitwise_count(lo[rows] ^ lo[i])

    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = np.arange(len(fp))
    while len(rest) > 1:
        pivot, rest = int(rest[0]), rest[1:]
        d = apart(pivot, rest)
        hit = d <= radius
        queue = [(int(i), int(x)) for i, x in zip(rest[hit], d[hit], strict=True)]
        left.append(np.full(len(queue), pivot))
        right.append(rest[hit])
        rest, d = rest[~hit], d[~hit]
        ring = np.argsort(d, kind="stable")  # what is left, by distance to the pivot
        ring_d, ring_row, gone = d[ring], rest[ring], np.zeros(len(ring), bool)
        while queue:
            i, x = queue.pop()
            span = slice(int(np.searchsorted(ring_d, x - radius)), int(np.searchsorted(ring_d, x + radius, "right")))
            own = np.flatnonzero(~gone[span]) + span.start
            if not len(own):
                continue
            own = own[apart(i, ring_row[own]) <= radius]
            gone[own] = True
            left.append(np.full(len(own), i))
            right.append(ring_row[own])
            queue += zip(ring_row[own].tolist(), ring_d[own].tolist(), strict=True)
        if gone.any():
            rest = np.sort(ring_row[~gone])
    return np.concatenate(left), np.concatenate(right)


def leaf_edges(bucket: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """(m, 2) row pairs that join all rows of the same bucket (sorted runs) within ``radius``: a spanning forest."""
    n = len(bucket)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    small = np.flatnonzero(np.repeat(size <= LEAF, size))
    a, b = _small_edges(bucket[small], fp[small], radius) if len(small) else (small, small)
    a, b = [small[a]], [small[b]]
    for i, k in zip(begin[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
        x, y = _large_edges(fp[i : i + k], radius)
        a.append(x + i)
        b.append(y + i)
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            break
    joined = np.flatnonzero(label != np.arange(n))
    return np.stack([label[joined], joined], 1)


def _search(radius: int):
    def out(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        e = leaf_edges(bucket, fp, radius)
        s = fp.view(np.int64)
        cols = [np.ascontiguousarray(s[e[:, i], j]) for i in (0, 1) for j in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hi1", "lo1", "hi2", "lo2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
        for b in batches:  # sorted by bucket; the last bucket of a batch may go on in the next
            bucket = np.concatenate([bucket, b["bucket"].to_numpy()])
            fp = np.concatenate([fp, _fp_array(b, "hi", "lo")])
            if len(bucket) < 1 << 16:
                continue
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield out(bucket[:cut], fp[:cut])
                bucket, fp = bucket[cut:], fp[cut:]
        if len(bucket):
            yield out(bucket, fp)

    return run


def neighbour_edges(fps: DataFrame, radius: int = RADIUS, recall: float = RECALL, plan: Plan = Plan()) -> DataFrame:
    """(a, b) edges that connect distinct fingerprints (hi, lo) within the radius; a and b are struct(hi, lo)."""
    recursion = Recursion(plan.depth, plan.weight, _centres(plan.depth, plan.weight, radius, recall))
    spread = fps.select("hi", "lo").mapInArrow(_spread(recursion), "bucket long, hi long, lo long")
    found = spread.repartition("bucket").sortWithinPartitions("bucket", "hi", "lo").mapInArrow(_search(radius), "hi1 long, lo1 long, hi2 long, lo2 long")
    return found.distinct().select(F.struct(F.col("hi1").alias("hi"), F.col("lo1").alias("lo")).alias("a"), F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo")).alias("b"))


def members(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, _k1, _k2, copies, first_id, first_k1, first_k2, group_size) of every distinct (doc_id, text) in a group of two rows or more."""
    rows = Stored(fingerprinted(docs)).df
    each = rows.groupBy("doc_id", "_k1", "_k2", "hi", "lo", "words").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2")
    fps = Stored(rows.groupBy("hi", "lo", "words").agg(F.min(order).alias("least"), F.count("*").alias("copies"))).df
    wide = max(12, docs.sparkSession.sparkContext.defaultParallelism)
    found = components(neighbour_edges(fps.where("words").repartition(wide, "hi", "lo"), radius, recall, plan))
    root = found.select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), F.lit(True).alias("words"), "root")
    placed = fps.join(root, ["hi", "lo", "words"], "left").withColumn("root", F.struct(F.coalesce("root", F.struct("hi", "lo")), "words"))
    sizes = placed.groupBy("root").agg(F.min("least").alias("least"), F.sum("copies").alias("group_size")).where("group_size > 1")
    of = placed.select("hi", "lo", "words", "root").join(sizes, "root").drop("root")
    met = each.join(of, ["hi", "lo", "words"])
    return met.select("doc_id", "_k1", "_k2", "copies", F.col("least.doc_id").alias("first_id"), F.col("least._k1").alias("first_k1"), F.col("least._k2").alias("first_k2"), "group_size")


def groups(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of every distinct (doc_id, text) whose group has two rows or more; group_id is the least doc_id."""
    m = members(docs, radius, recall, plan)
    keep = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("_k1") == F.col("first_k1")) & (F.col("_k2") == F.col("first_k2"))
    return m.select("doc_id", F.col("first_id").alias("group_id"), "group_size", keep.alias("keep"))


def dedup(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, plan: Plan = Plan()) -> DataFrame:
    """``docs``, all columns, with one row of every group; rows in no group stay as they are.

    The narrow decisions join the documents on a hash of id and text, in a shuffle of the documents whatever their size, and
    are the hashed side. Of exactly repeated rows that are to stay, one does.
    """
    stay = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("_k1") == F.col("first_k1")) & (F.col("_k2") == F.col("first_k2"))
    names = docs.columns
    r1, r2 = _fresh(names, "1"), _fresh(names, "2")
    m = Stored(members(docs, radius, recall, plan).select(*_row_hash(F.col("doc_id"), F.col("_k1"), F.col("_k2"), r1 + "x", r2 + "x"), stay.alias("_stay"), (F.col("copies") > 1).alias("_more"))).df
    k1, k2 = row_key(F.col("`text`"))
    keyed = docs.select("*", *_row_hash(F.col("`doc_id`"), k1, k2, r1, r2))
    decided = keyed.join(m.where("not _stay or _more").hint("shuffle_hash"), (F.col(r1) == F.col(r1 + "x")) & (F.col(r2) == F.col(r2 + "x")), "left")
    once = decided.where("_stay and _more").dropDuplicates([r1, r2])
    return decided.where("_stay is null").unionByName(once).select(*[F.col(f"`{n}`") for n in names])


def _row_hash(doc_id: Column, k1: Column, k2: Column, first: str, second: str) -> list[Column]:
    """128 bits of (doc_id, text), never null."""
    return [F.xxhash64(doc_id.isNull(), doc_id, k1, F.lit(1)).alias(first), F.xxhash64(doc_id.isNull(), doc_id, k2, F.lit(2)).alias(second)]


def _fresh(names: list[str], stem: str) -> str:
    have = {n.lower() for n in names}
    out = f"_nd_{stem}"
    while out in have or out + "x" in have:
        out += "_"
    return out


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
