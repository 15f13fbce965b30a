"""Operator 2: quality rules by a hashed n-gram logistic regression.

Features are hashed byte 2-, 3- and 4-grams (case kept), folded words and word pairs (a word that repeats at once is one
shared feature), each kind as its share of the row's grams of that kind, so a score is a sum of mean weights and takes a few
numpy passes over the bytes of an Arrow batch. The model is trained on labelled rows: at most ``rows`` of each class, taken
in the order of a hash of the id (the only bound; labels and class counts are counted in full), weighted back to the counts
of the classes, and calibrated by Platt's method on a held-out fifth. Thresholds are fixed.

Scale: one scan finds the training rows (the bounded sample is broadcast), one scores; no text is shuffled.

Defined cases: a null text or one without a word has no probability and is rejected as ``empty``; texts of any length are
scored whole; equal texts score equally; repeated rows stay repeated; null ids are scored like others. Labels count if all
labels of an id agree (null labels are left out). Without labelled rows of both classes nothing is rejected but empty texts,
and the decision is ``unscored``. An empty table gives an empty result. Columns of any other name pass through
:func:`keep_good` and are ignored by :func:`scores`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logreg import Model, Rows, train
from .textkernel import Words, chunks, need

_U = np.uint64
DIM = 1 << 15
#: Labelled rows of each class that the model is fitted on, at most.
TRAIN_ROWS = 2000
#: Calibrated probability below which a document is rejected, and from which it is good.
REJECT_BELOW, GOOD_FROM = 0.5, 0.8
_SCALE = 50.0
_L2 = 1e-4


def _within(first: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of grams cut to the n there are; a row too short for one has none."""
    first = np.minimum(first, n)
    return first, np.maximum(np.minimum(last, n), first)


def _grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of every gram of the chunk, first and end gram of every row), a kind at a time."""
    wide = data.astype(np.uint32)
    for n in (2, 3, 4):
        if len(data) >= n:
            code = wide[: len(data) - n + 1].copy()
            for j in range(1, n):
                code |= wide[j : len(data) - n + 1 + j] << np.uint32(8 * j)
            bucket = ((code + np.uint32(n * 0x01000193)) * np.uint32(2654435761)) >> np.uint32(32 - 15)
            yield bucket, *_within(off[:-1], off[1:] - n + 1, len(bucket))
    words = Words(data, off)
    yield (words.hash >> _U(49)).astype(np.uint32), words.first[:-1], words.first[1:]
    if len(words) > 1:
        pair = words.hash[:-1] * _U(3) + words.hash[1:] * _U(0x9E3779B97F4A7C15)
        pair ^= pair >> _U(29)
        pair[words.hash[:-1] == words.hash[1:]] = _U(12345) << _U(49)
        yield (pair >> _U(49)).astype(np.uint32), *_within(words.first[:-1], words.first[1:] - 1, len(pair))


def linear(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The linear score of every row; NaN for a row without a word."""
    out = []
    for start, end, data, off in chunks(column):
        score = np.zeros(end - start)
        have = np.zeros(end - start, bool)
        with np.errstate(over="ignore"):
            for bucket, first, last in _grams(data, off):
                total = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
                count = last - first
                score += _SCALE * (total[last] - total[first]) / np.maximum(count, 1)
                have |= count > 0
            none = np.diff(Words(data, off).first) == 0
        score[none | ~have] = np.nan
        out.append(score)
    return np.concatenate(out) if out else np.zeros(0)


def features(column: pa.Array) -> Rows:
    """The same score's features as sparse rows."""
    index, value, count = [np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for start, end, data, off in chunks(column):
        keys, parts = [], []
        with np.errstate(over="ignore"):
            for bucket, first, last in _grams(data, off):
                have = last - first
                row = np.repeat(np.arange(end - start), have)
                at = np.repeat(first - np.concatenate([[0], np.cumsum(have)[:-1]]), have) + np.arange(have.sum())
                keys.append(row.astype(np.int64) * DIM + bucket[at])
                parts.append(_SCALE / have[row])
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        value.append(np.bincount(back, weights=np.concatenate(parts), minlength=len(key)))
        index.append((key % DIM).astype(np.int32))
        count.append(np.bincount(key // DIM, minlength=end - start))
    return Rows(np.concatenate(index), np.concatenate(value), np.concatenate([[0], np.cumsum(np.concatenate(count))]))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b["text"])
        first = pa.array(x.first.astype(np.int32))
        lists = [pa.ListArray.from_arrays(first, pa.array(v.astype(t))) for v, t in ((x.index, np.int16), (x.value, np.float32))]
        yield pa.RecordBatch.from_arrays([b["fold"], b["label"], *lists], names=["fold", "label", "index", "value"])


def agreed_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of ids whose labels of this name all agree."""
    each = need(labels, "doc_id", name).where(F.col("doc_id").isNotNull() & F.col(f"`{name}`").isin(0, 1))
    return each.groupBy("doc_id").agg(F.min(name).alias("label"), F.max(name).alias("_most")).where("label = _most").select("doc_id", F.col("label").cast("int"))


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """The calibrated model, or None without labelled documents of both classes."""
    agreed = agreed_labels(labels, "quality")
    counts = {r["label"]: r["n"] for r in agreed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64("doc_id")
    sample = agreed.where("label = 0").orderBy(order, "doc_id").limit(rows).union(agreed.where("label = 1").orderBy(order, "doc_id").limit(rows))
    text = need(docs, "doc_id", "text").where(F.col("text").isNotNull())
    text = text.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most 2 * rows rows
    found = text.select(F.xxhash64("doc_id").alias("fold"), "label", "text").mapInArrow(_feature_batches, "fold long, label int, index array<smallint>, value array<float>")
    table = found.toArrow().sort_by([("fold", "ascending"), ("label", "ascending")]).combine_chunks()
    y = table["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    index, value = table["index"].combine_chunks(), table["value"].combine_chunks()
    first = index.offsets.to_numpy().astype(np.int64)
    x = Rows(index.values.to_numpy()[first[0] : first[-1]], value.values.to_numpy()[first[0] : first[-1]], first - first[0])
    weight = np.where(y > 0, counts[1] / (y > 0).sum(), counts[0] / (y <= 0).sum()) * len(y) / sum(counts.values())
    fold = table["fold"].to_numpy().view(np.uint64) >> _U(7)
    return train(x, y, weight, DIM, fold % _U(5) == 0, _L2)


def probability(model: Model | None, text: Column) -> Column:
    """Calibrated probability that a text is good; null for null and wordless texts and without a model."""
    weights = np.zeros(DIM, np.float32) if model is None else model.weights

    @F.arrow_udf("struct<p double, words boolean>")
    def score(column: pa.Array) -> pa.Array:
        z = linear(column, weights)
        p = np.full(len(z), np.nan) if model is None else model.probability(z)
        return pa.StructArray.from_arrays([pa.array(p, mask=np.isnan(p)), pa.array(~np.isnan(z))], names=["p", "words"])

    return score(text)


def decision(scored: Column) -> Column:
    p = scored["p"]
    return F.when(~F.coalesce(scored["words"], F.lit(False)), "empty").when(p.isNull(), "unscored").when(p < REJECT_BELOW, "reject").when(p < GOOD_FROM, "review").otherwise("good")


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, quality, decision) of every row."""
    scored = need(docs, "doc_id", "text").select("doc_id", probability(model, F.col("text")).alias("s"))
    return scored.select("doc_id", F.col("s.p").alias("quality"), decision(F.col("s")).alias("decision"))


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs``, all columns, without the rows that are rejected or empty."""
    names = docs.columns
    new = "_q"
    while new in {n.lower() for n in names}:
        new += "_"
    scored = docs.withColumn(new, probability(model, F.col("`text`")))
    return scored.where(~decision(F.col(new)).isin("empty", "reject")).select(*[F.col(f"`{n}`") for n in names])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
