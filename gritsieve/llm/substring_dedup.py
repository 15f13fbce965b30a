"""Operator 7: repeated passages by a suffix array built in blocks with a difference cover.

A passage of ``LENGTH`` words (runs of characters other than ASCII white space, case kept) is repeated if the same words
occur at another place of the corpus, in the same document or another. The result is, for every document, the union of its
repeated passages: spans that are merged where they touch.

Plan: equal texts are one text with a count of copies, and if there are copies all their passages are repeated. Every passage
has a seed, the least hash among its groups of 8 words, so equal passages have equal seeds; runs of passages of one seed make
a segment. Narrow segment rows meet by seed, and seeds met once are dropped, which loses no repeat. One document of each text
that still has segments is joined by (doc_id, text hash), and its segments go, as text, to the seed's suffix bucket. A task
takes buckets in blocks of at most ``BLOCK_WORDS`` words (a larger bucket alone), holds equal segments once, sorts the
block's suffixes (see :mod:`suffix_array`), and neighbours that share LENGTH words are repeats.

Scale: copies and seeds are counted by partial aggregation, so neither a hot text nor a hot seed is one task's group. A seed
of more than ``HOT`` segments of different texts isn't sorted in one bucket: each of its passages goes by two hashes of its 50
words (128 bits in all), these are counted by partial aggregation, and passages counted twice are joined back; the rows found
are the same.

Defined cases: null texts and texts of fewer than LENGTH words have no spans; very long texts are covered whole; of repeated
rows (same id and text), which repeat each other, each span is reported once; null ids stay null; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import suffix_array as S
from .shared import Stored
from .textkernel import NOT_SPACE, SAME, Words, chunks, mix, need, row_key

LENGTH = 50
SEED = 8
BLOCK_WORDS = 400_000
#: Segments of a seed up to which they are sorted in one bucket.
HOT = 50_000
_U = np.uint64


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, first word, passages, seed, start byte, end byte) of every segment of a chunk."""
    words = Words(data, off, NOT_SPACE, SAME)
    h, n = words.hash, len(words)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):
            h = mix(h[:-step] * _U(0x9E3779B97F4A7C15) + h[step:] * _U(2 * step + 1))
    width = length - SEED + 1
    best, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        best = np.where(h[a] <= h[b], a, b)
        span += step
    row = words.row()
    at = np.arange(n - length + 1)
    inside = row[at] == row[at + length - 1]
    begin = inside.copy()
    begin[1:] &= ~(inside[:-1] & (best[1:] == best[:-1]))
    first = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~(inside[1:] & (best[1:] == best[:-1]))
    last = np.flatnonzero(stop)
    return row[first], first - words.first[row[first]], last - first + 1, h[best[first]], words.start[first], words.end[last + length - 1]


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the segments, and for every text of LENGTH words or more one with its id, no seed and all its words (``first`` is -1)."""
    for b in batches:
        for start, end, data, off in chunks(b["text"]):
            row, first, count, seed, _, _ = segments(data, off)
            size = np.bincount(row, weights=count, minlength=end - start).astype(np.int64) if len(row) else np.zeros(end - start, np.int64)
            long = np.flatnonzero(size)
            at = pa.array(np.concatenate([row, long]) + start)
            own = np.concatenate([np.zeros(len(row), bool), np.ones(len(long), bool)])
            ids = pc.if_else(pa.array(own), b["doc_id"].take(at), pa.scalar(None, b["doc_id"].type))
            cols = [pa.array(np.concatenate([first, np.full(len(long), -1)]).astype(np.int32)), pa.array(np.concatenate([count, size[long] + LENGTH - 1]).astype(np.int32)), pa.array(np.concatenate([seed.view(np.int64), np.zeros(len(long), np.int64)]))]
            yield pa.RecordBatch.from_arrays([ids, *[b[c].take(at) for c in ("_k1", "_k2")], *cols], names=["doc_id", "_k1", "_k2", "first", "count", "seed"])


def _wanted(b: pa.RecordBatch, start: int, end: int, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of a chunk's segments are asked for by ``firsts``."""
    lists, offsets = b["firsts"].values.to_numpy(), b["firsts"].offsets.to_numpy()
    own = lists[offsets[start] : offsets[end]].astype(np.int64) | (np.repeat(np.arange(end - start), np.diff(offsets[start : end + 1])).astype(np.int64) << 32)
    return np.flatnonzero(np.isin(first | (row << 32), own))


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, end, data, off in chunks(b["text"]):
            row, first, count, seed, begin, stop = segments(data, off)
            keep = _wanted(b, start, end, row, first)
            raw = data.tobytes()
            texts = [raw[begin[i] : stop[i]] for i in keep.tolist()]
            at = pa.array(row[keep] + start)
            cols = [pa.array(seed[keep].view(np.int64)), *[b[c].take(at) for c in ("_k1", "_k2")], pa.array(first[keep].astype(np.int32)), pa.array(count[keep].astype(np.int32)), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["seed", "_k1", "_k2", "first", "count", "piece"])


def _passage_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every passage of the wanted segments."""
    for b in batches:
        for start, end, data, off in chunks(b["text"]):
            row, first, count, _, _, _ = segments(data, off)
            keep = _wanted(b, start, end, row, first)
            if not len(keep):
                continue
            words = Words(data, off, NOT_SPACE, SAME)
            owner = np.repeat(keep, count[keep])
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count[keep]) - count[keep], count[keep]) + first[owner]
            at = words.first[row[owner]] + place
            h = [np.full(len(at), salt, np.uint64) for salt in (1, 2)]
            with np.errstate(over="ignore"):
                for j in range(LENGTH):
                    w = words.hash[at + j]
                    h = [mix(x * _U(0x9E3779B97F4A7C15) + mix(w ^ _U(salt))) for x, salt in zip(h, (0x51ED, 0xC0DE), strict=True)]
            rows = pa.array(row[owner] + start)
            yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in h], *[b[c].take(rows) for c in ("_k1", "_k2")], pa.array(place.astype(np.int32))], names=["h1", "h2", "_k1", "_k2", "start_word"])


def repeated(pieces: list[bytes], counts: np.ndarray, seeds: np.ndarray, many: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Which passages of each segment are repeated: among the segments of its seed, or as the segment itself occurs ``many`` times."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    words = Words(raw, off, NOT_SPACE, SAME)
    symbols = np.unique(words.hash, return_inverse=True)[1].astype(np.int64) + 1
    size = np.diff(words.first)
    text = np.zeros(len(symbols) + len(pieces), np.int64)  # a 0 ends every segment
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(pieces)), size)] = symbols
    begin = words.first[:-1] + np.arange(len(pieces))
    owner = np.repeat(np.arange(len(pieces)), counts)
    suffixes = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[owner]
    seed_of = np.zeros(len(text), np.uint64)
    seed_of[suffixes] = seeds[owner]
    order = S.sort_bucket(text, suffixes, S.sample_ranks(text), seeds[owner])
    same = np.zeros(len(order), bool)
    for a in range(0, len(order) - 1, 1 << 15):
        i, j = order[a : a + (1 << 15)], order[a + 1 : a + 1 + (1 << 15)]
        i = i[: len(j)]
        alive = np.flatnonzero(seed_of[i] == seed_of[j])
        for k in range(length):
            alive = alive[text[i[alive] + k] == text[j[alive] + k]]
        same[a + alive] = True
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    hit[order[1:][same[:-1]]] = True
    out = []
    for p in range(len(pieces)):
        out.append(np.ones(counts[p], bool) if many[p] > 1 else hit[begin[p] : begin[p] + counts[p]])
    return out


class _Block:
    """Segments of whole seeds; equal ones are held once, with the places where they occur."""

    def __init__(self):
        self.pieces: dict[tuple[int, bytes], int] = {}
        self.counts: list[int] = []
        self.places: list[tuple] = []
        self.which: list[int] = []
        self.words = 0

    def add(self, seed: int, piece: bytes, count: int, place: tuple) -> None:
        key = (seed, piece)
        at = self.pieces.setdefault(key, len(self.pieces))
        if at == len(self.counts):
            self.counts.append(count)
            self.words += count + LENGTH
        self.which.append(at)
        self.places.append(place)

    def spans(self, length: int = LENGTH) -> list[tuple]:
        many = np.bincount(self.which, minlength=len(self.counts))
        seeds = np.array([s for s, _ in self.pieces], np.int64).view(np.uint64)
        found = repeated([p for _, p in self.pieces], np.array(self.counts), seeds, many, length)
        runs = []
        for hit in found:
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            runs.append(list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1 + length).tolist(), strict=True)))
        return [(a, b, first + s, first + e) for at, (a, b, first) in zip(self.which, self.places, strict=True) for s, e in runs[at]]


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(block: _Block) -> pa.RecordBatch:
        rows = block.spans()
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["_k1", "_k2", "start_word", "end_word"])

    block, last = _Block(), None
    for b in batches:
        for seed, k1, k2, first, count, piece in zip(*[b[c].to_pylist() for c in ("seed", "_k1", "_k2", "first", "count", "piece")], strict=True):
            if seed != last and block.words >= BLOCK_WORDS:
                yield out(block)
                block = _Block()
            last = seed
            block.add(seed, piece, count, (k1, k2, first))
    if block.counts:
        yield out(block)


_SPANS = "_k1 long, _k2 long, start_word int, end_word int"


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): merged spans [start, end) of words that lie in repeated passages."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = need(docs, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", "text", *row_key(F.col("text")))
    text = ["_k1", "_k2"]
    found = rows.mapInArrow(_segment_batches, f"doc_id {kind}, _k1 long, _k2 long, first int, count int, seed long")
    met = Stored(found.groupBy(*text, "first", "count", "seed").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))).df
    texts = met.where("first < 0").select(*text, "copies", "rep", F.col("count").alias("words"))
    own = met.where("first >= 0").select(*text, "first", "seed")
    seeds = own.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
    shared = Stored(own.join(seeds, "seed").select(*text, "first", (F.col("n") > HOT).alias("hot"))).df

    def asked(own: DataFrame) -> DataFrame:
        """One document of every text that has such segments, with their places."""
        wanted = own.groupBy(*text).agg(F.collect_set("first").alias("firsts")).join(texts, text)  # as many as the text has
        wanted = wanted.select("rep", F.col("_k1").alias("_x1"), F.col("_k2").alias("_x2"), "firsts")
        return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("_k1") == F.col("_x1")) & (F.col("_k2") == F.col("_x2"))).select(*text, "text", "firsts")

    pieces = asked(shared.where("not hot")).mapInArrow(_text_batches, "seed long, _k1 long, _k2 long, first int, count int, piece binary")
    spans = pieces.repartition("seed").sortWithinPartitions("seed").mapInArrow(_span_batches, _SPANS)
    if not shared.where("hot").isEmpty():
        passages = asked(shared.where("hot")).mapInArrow(_passage_batches, "h1 long, h2 long, _k1 long, _k2 long, start_word int").distinct()
        twice = passages.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
        spans = spans.union(passages.join(twice, ["h1", "h2"]).select(*text, "start_word", (F.col("start_word") + LENGTH).alias("end_word")))
    doc = W.partitionBy(*text).orderBy("start_word", "end_word")
    before = F.max("end_word").over(doc.rowsBetween(W.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(F.col("start_word") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    merged = island.groupBy(*text, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("island")
    copied = texts.where("copies > 1").select(*text, F.lit(0).alias("start_word"), F.col("words").alias("end_word"))
    single = merged.join(texts.where("copies = 1").select(*text), text)
    each = rows.select("doc_id", *text).distinct()
    return each.join(single.unionByName(copied), text).select("doc_id", "start_word", "end_word")


SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, count(*) OVER (PARTITION BY doc_id, text) AS copies,
             regexp_extract_all(text, '[^\\x09-\\x0D ]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, text, copies, i, array_to_string(w[i + 1:i + 50], ' ') AS gram FROM d, unnest(range(0, len(w) - 49)) AS r(i)),
n AS (SELECT doc_id, text, i, sum(copies) OVER (PARTITION BY gram) AS times FROM g),
m AS (SELECT doc_id, text, i, lag(i) OVER (PARTITION BY doc_id, text ORDER BY i) AS p FROM n WHERE times > 1),
s AS (SELECT doc_id, text, i, sum(CASE WHEN p IS NOT NULL AND i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, text ORDER BY i) AS island FROM m)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + 50 AS INTEGER) AS end_word FROM s GROUP BY doc_id, text, island
"""


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
