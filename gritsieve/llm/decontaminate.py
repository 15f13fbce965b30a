"""Operator 5: benchmark decontamination by SimHash over item-sized windows.

Texts and items are word shingles (3 folded words). A shingle's weight is the rounded log of its rarity among items; the
similarity of a window and an item is the weighted Jaccard of their shingle multisets, and a match has at least ``least``.
For an item of n words every window of n words of every document is a query (a shorter document is one window). Windows are
screened without loss: shared weight is at most the weight of the window's shingles that an item has, so a window in which
these weigh less than ``least`` of the whole can't match any item; only shingles of items of the window's size count. What
is left gets a 64-bit weighted SimHash, by prefix sums over the text. Items of that size within ``RADIUS`` bits are found
through 8 blocks of 8 bits, each listing every item under all values with at most one changed bit (15 differing bits leave
one block with one or none, so none within the radius is missed). The exact similarity of a candidate item is computed for
all windows of the document at once: a shingle counts in a window unless the window already holds as many of it as the item
has, so each place adds its weight to one run of windows, and verifying costs time linear in the text, whatever the item's
length.

Scale: one map over the documents; neither text nor windows are shuffled, and :func:`clean` is a filter in the scan. The item
side (weights, shingles and index) is what is shared with tasks; it is cut into slices of about ``SLICE`` shingles, each with
a scan of its own. A slice holds the weights of its own shingles and of those of other slices whose weight isn't that of
unknown ones (several items have them), so every slice scores alike; only these shared shingles add to a broadcast as the
benchmark grows.

Defined cases: null and empty texts and texts of fewer than 3 words match nothing; items of fewer than 3 words and null items
are left out; texts of any length are covered whole; repeated items report each, repeated rows report once per (doc_id,
text); null ids stay null; ties in similarity give the earliest window; empty tables give empty results (and keep every
document); further columns are ignored by :func:`matches` and kept by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stored
from .textkernel import Words, chunks, mix, need, row_key

K = 3
LEAST = 0.75
RADIUS, BLOCKS = 15, 8
#: Item shingles of a slice, about.
SLICE = 2_000_000
#: Shingles whose SimHash sums are held at once.
_SPAN = 1 << 16
_U = np.uint64


def simhashes(h: np.ndarray, weight: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit weighted SimHash of each range [start, stop) (starts ascending) of shingles: bit b is set if the shingles with it weigh more than those without."""
    out = np.zeros(len(start), np.uint64)
    if len(start):  # only what some range holds counts
        low, high = int(start.min()), int(stop.max())
        edge = np.bincount(start - low, minlength=high - low + 1) - np.bincount(stop - low, minlength=high - low + 1)
        inside = np.cumsum(edge[:-1]) > 0
        place = np.concatenate([[0], np.cumsum(inside)])
        h, weight, start, stop = h[low:high][inside], weight[low:high][inside], place[start - low], place[stop - low]
    at = 0
    while at < len(start):
        low = int(start[at])
        end = max(at + 1, int(np.searchsorted(start, low + _SPAN)))
        high = int(stop[at:end].max())
        w = weight[low:high]
        run = np.concatenate([[0], np.cumsum(w)])
        a, b = start[at:end] - low, stop[at:end] - low
        half = run[b] - run[a]
        x = mix(h[low:high] ^ _U(0xA24BAED4963EE407))
        for bit in range(64):
            np.cumsum(w * ((x >> _U(bit)) & _U(1)).astype(np.int64), out=run[1:])
            out[at:end] |= (2 * (run[b] - run[a]) > half).astype(np.uint64) << _U(bit)
        at = end
    return out


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, end, data, off in chunks(b["text"]):
            words = Words(data, off)
            h, first = words.shingles(K)
            keep = np.flatnonzero(np.diff(words.first) >= K)
            lists = [h[first[i] : first[i + 1]].view(np.int64) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [b["item_id"].slice(start, end - start).take(pa.array(keep)), pa.array(np.diff(words.first)[keep].astype(np.int32)), pa.array(lists, pa.list_(pa.int64()))],
                names=["item_id", "size", "h"],
            )


class Weights:
    """Weight of every item shingle of one slice and of those of other slices (without size bits) that need it, and that of any other."""

    def __init__(self, h: np.ndarray, weight: np.ndarray, sizes: np.ndarray, other: int):
        order = np.argsort(h)
        self.h, self.weight, self.other = h[order], weight[order].astype(np.int64), other
        self.sizes = sizes[order].view(np.uint64)  # bit b: an item of a size that is b modulo 64 has it; 0: no item of the slice
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[h >> _U(42)] = True

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight of every shingle, places of those that items of the slice have, size bits of these)."""
        weight, places, bits = np.full(len(h), self.other, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.maybe[h >> _U(42)])
        if len(at) and len(self.h):
            found = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
            same = self.h[found] == h[at]
            places, bits = at[same], self.sizes[found[same]]
            weight[places] = self.weight[found[same]]
            places, bits = places[bits != 0], bits[bits != 0]
        return weight, places, bits


def _between(places: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sum of the weights of places in [low, high)."""
    run = np.concatenate([[0], np.cumsum(weight)])
    return run[np.searchsorted(places, high)] - run[np.searchsorted(places, low)]


def _slice_weights(rarity: DataFrame, own: DataFrame, other: int) -> DataFrame:
    """(h, sizes, weight) of the shingles of a slice's items, and without sizes of all others that don't weigh ``other``."""
    mine = own.select(F.explode("h").alias("h")).distinct().withColumn("mine", F.lit(True))
    both = rarity.join(mine, "h", "left").where(F.col("mine") | (F.col("weight") != other))
    return both.select("h", F.when(F.col("mine"), F.col("sizes")).otherwise(F.lit(0).cast("long")).alias("sizes"), "weight")


class Items:
    """The items of a slice, each distinct text once: shingles, SimHashes, and for every size the blocks' lists."""

    def __init__(self, sizes: np.ndarray, shingles: list[np.ndarray], weights: Weights):
        self.names: list[int] = []  # of every row given, the distinct item it is
        known: dict[bytes, int] = {}
        self.size, self.h = [], []
        for n, h in zip(sizes.tolist(), shingles, strict=True):
            key = h.tobytes()
            if key not in known:
                known[key] = len(self.h)
                self.size.append(n)
                self.h.append(np.ascontiguousarray(h).view(np.uint64))
            self.names.append(known[key])
        self.size = np.array(self.size, np.int64)
        self.total = np.zeros(len(self.h), np.int64)
        fp = np.zeros(len(self.h), np.uint64)
        for i, h in enumerate(self.h):
            w = weights.of(h)[0]
            self.total[i] = w.sum()
            fp[i] = simhashes(h, w, np.zeros(1, np.int64), np.full(1, len(h)))[0]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        flips = np.array([0, *(1 << np.arange(8))])
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            lists = []
            for block in range(BLOCKS):
                value = ((fp[own] >> _U(8 * block)) & _U(255)).astype(np.int64)
                probe = (value[:, None] ^ flips).reshape(-1)
                order = np.argsort(probe, kind="stable")
                lists.append((np.searchsorted(probe[order], np.arange(257)), np.repeat(np.arange(len(own)), len(flips))[order]))
            self.by_size[n] = own, fp[own], lists

    def near(self, size: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within RADIUS bits, each once."""
        own, item_fp, lists = self.by_size[size]
        out = []
        for begin in range(0, len(fp), 1 << 12):
            part = fp[begin : begin + (1 << 12)]
            for block, (first, listed) in enumerate(lists):
                value = ((part >> _U(8 * block)) & _U(255)).astype(np.int64)
                have = first[value + 1] - first[value]
                window = np.repeat(np.arange(len(part)), have)
                item = listed[np.repeat(first[value] - np.cumsum(have) + have, have) + np.arange(have.sum())]
                x = part[window] ^ item_fp[item]
                ok = np.bitwise_count(x) <= RADIUS
                for earlier in range(block):  # of the blocks in which a pair meets, only the first counts
                    ok &= np.bitwise_count((x >> _U(8 * earlier)) & _U(255)) > 1
                out.append((window[ok] + begin, own[item[ok]], np.bitwise_count(x[ok])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def shared_weights(h: np.ndarray, weight: np.ndarray, item: np.ndarray, length: int) -> np.ndarray:
    """For every window of ``length`` shingles (the last one of a shorter text being whole): the weight it shares with the item."""
    count = max(1, len(h) - length + 1)
    kinds, have = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
    place = np.flatnonzero(kinds[at] == h)
    kind = at[place]
    order = np.argsort(kind, kind="stable")
    s, k = place[order], kind[order]
    begin = np.searchsorted(k, k)
    back = np.arange(len(k)) - have[k]  # the occurrence that must have left the window
    since = np.where(back >= begin, s[np.maximum(back, 0)] + 1, 0)
    low, high = np.maximum(since, s - length + 1), np.minimum(s, count - 1)
    keep = low <= high
    run = np.zeros(count + 1, np.int64)
    np.add.at(run, low[keep], weight[s[keep]])
    np.add.at(run, high[keep] + 1, -weight[s[keep]])
    return np.cumsum(run[:-1])


def screened(words: Words, h: np.ndarray, first: np.ndarray, sizes: list[int], weights: Weights, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(item size, rows, first and end shingle of the windows that pass the screen, weight of all shingles)."""
    count = np.diff(words.first)
    weight, hit, bits = weights.of(h)
    if not len(hit):
        return
    total = np.concatenate([[0], np.cumsum(weight)])
    row = np.repeat(np.arange(len(count)), np.diff(first))
    end = first[1:][row]
    low = int(weights.weight.min()) if len(weights.weight) else 1
    shortest, longest = min(sizes) - K + 1, max(sizes) - K + 1
    at = np.arange(len(h))
    reach = _between(hit, weight[hit], at, np.minimum(at + longest, end))
    whole = first[:-1][row] == at
    need_weight = least * np.minimum(shortest, np.diff(first)[row]) * min(low, weights.other)
    at = at[(reach >= need_weight) & (reach > 0) & (count[row] >= K)]
    for size in sizes:
        n = size - K + 1
        own_hit = hit[(bits >> _U(size % 64)) & _U(1) == 1]
        part = at[(at + n <= end[at]) | (whole[at] & (count[row[at]] < size))]
        stop = np.minimum(part + n, end[part])
        pass_ = _between(own_hit, weight[own_hit], part, stop) >= least * (total[stop] - total[part])
        if pass_.any():
            yield size, row[part[pass_]], part[pass_], stop[pass_], weight


def found_in(data: np.ndarray, off: np.ndarray, weights: Weights, items: Items, least: float) -> list[tuple[int, int, int, float, int]]:
    """(row, distinct item, first word, similarity, distance) of the best window of every item that a row of the chunk holds."""
    words = Words(data, off)
    h, first = words.shingles(K)
    out = []
    if not len(h) or not len(items.h):
        return out
    for size, row, start, stop, weight in screened(words, h, first, sorted(items.by_size), weights, least):
        window, item, distance = items.near(size, simhashes(h, weight, start, stop))
        if not len(window):
            continue
        order = np.lexsort((start[window], item, row[window]))
        window, item, distance = window[order], item[order], distance[order]
        cut = np.flatnonzero(np.concatenate([[True], (row[window][1:] != row[window][:-1]) | (item[1:] != item[:-1])]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(window)], strict=True):
            r, i = int(row[window[a]]), int(item[a])
            low, high = int(first[r]), int(first[r + 1])
            met = shared_weights(h[low:high], weight[low:high], items.h[i], size - K + 1)
            own = window[a:b]
            run = np.concatenate([[0], np.cumsum(weight[low:high])])
            both = met[start[own] - low]
            similarity = both / (run[stop[own] - low] - run[start[own] - low] + items.total[i] - both)
            best = int(np.argmax(similarity))  # the earliest of the best
            if similarity[best] >= least:
                out.append((r, i, int(start[own[best]] - low), float(similarity[best]), int(distance[a + best])))
    return out


def _slices(benchmark: DataFrame) -> Iterator[tuple[Weights, Items, pa.Array]]:
    """(weights, distinct items, item_id of every item row) of every slice of the benchmark."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    kept = Stored(need(benchmark, "item_id", "text").where(F.col("text").isNotNull()).mapInArrow(_item_batches, f"item_id {kind}, size int, h array<long>"))
    items = kept.df
    n, shingles = items.agg(F.count("*"), F.coalesce(F.sum(F.size("h")), F.lit(0))).first()
    slices = max(1, -(-shingles // SLICE))
    rarity = items.select((F.col("size") % 64).alias("bit"), F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("sizes"), F.greatest(F.lit(1), F.round(8 * F.log(1 + F.lit(n) / F.count("*")))).cast("long").alias("weight"))
    other = max(1, round(8 * float(np.log(1 + n))))
    for s in range(slices):
        own = items if slices == 1 else items.where(F.pmod(F.xxhash64("size", "h"), F.lit(slices)) == s)
        table = (rarity if slices == 1 else _slice_weights(rarity, own, other)).toArrow()
        weights = Weights(table["h"].to_numpy().view(np.uint64), table["weight"].to_numpy(), table["sizes"].to_numpy(), other)
        rows = own.toArrow().combine_chunks()
        lists = rows["h"].combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int64()))
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        yield weights, Items(rows["size"].to_numpy(), [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], weights), rows["item_id"].combine_chunks()
    kept.drop()


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, start_word, similarity, distance): the most similar window of every item that a document holds."""
    kind, doc_kind = (t.schema[c].dataType.simpleString() for t, c in ((benchmark, "item_id"), (docs, "doc_id")))
    rows = need(docs, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", "text", *row_key(F.col("text")))
    out = None
    for weights, items, names in _slices(benchmark):
        of = [[] for _ in items.h]
        for place, item in enumerate(items.names):
            of[item].append(place)
        shared = docs.sparkSession.sparkContext.broadcast((weights, items, of, names))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, items, of, names = shared.value
            for b in batches:
                for begin, _, data, off in chunks(b["text"]):
                    got = [(r + begin, place, w, s, d) for r, i, w, s, d in found_in(data, off, weights, items, least) for place in of[i]]
                    if got:
                        at, item, word, similarity, distance = zip(*got, strict=True)
                        cols = [b[c].take(pa.array(at)) for c in ("doc_id", "_k1", "_k2")]
                        yield pa.RecordBatch.from_arrays([*cols, names.take(pa.array(item)), pa.array(word, pa.int32()), pa.array(similarity, pa.float64()), pa.array(distance, pa.int32())], names=["doc_id", "_k1", "_k2", "item_id", "start_word", "similarity", "distance"])

        part = rows.mapInArrow(run, f"doc_id {doc_kind}, _k1 long, _k2 long, item_id {kind}, start_word int, similarity double, distance int")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "_k1", "_k2", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), (-F.col("distance")).alias("d"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.s")).alias("start_word"), F.col("best.similarity").alias("similarity"), (-F.col("best.d")).alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs``, all columns, without the texts that hold an item."""
    names = docs.columns
    out = docs
    for weights, items, _ in _slices(benchmark):
        out = out.where(~_holds(docs.sparkSession.sparkContext.broadcast((weights, items)), least)(F.col("`text`")))
    return out.select(*[F.col(f"`{n}`") for n in names])


def _holds(shared, least: float):
    @F.arrow_udf("boolean")
    def holds(column: pa.Array) -> pa.Array:
        weights, items = shared.value
        hit = np.zeros(len(column), bool)
        for begin, _, data, off in chunks(column):
            for r, *_ in found_in(data, off, weights, items, least):
                hit[begin + r] = True
        return pa.array(hit)

    return holds


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
