"""Operator 3: secret scans by a battery of randomness tests.

A candidate is a run of 16 or more characters of the base-64 alphabets, of any length, that holds a letter. So is, beside the
run, each of its parts of that size with '-', '_', '/' or any of these as separators, and each longest chain of parts of one
alphabet (hex or base36 in one case, any) without its separators, as of a UUID; each is tested for itself and counted in the
control of false discoveries. What lies within a longer discovery isn't reported again. A candidate's encoding is
inferred from its characters (hex, base32, alpha26, base36, base64), which gives the alphabet in which it would be uniform
if it were random. Three tests ask whether it is: chi-squared uniformity over the alphabet, runs above and below the middle
of the alphabet, and lag-1 serial correlation of the codes; Fisher's method combines them to p. The evidence is an e-value
against natural text: the likelihood ratio of uniform characters against natural ones, times min(1, p / 0.001), so it falls
with every decade by which the battery denies uniformity (a factor of at most 1 keeps it an e-value). The natural model is
counted over all documents: folded letter frequencies, transitions between letters, digits and symbols, and a price for
changes of case. Evidence grows with length, and the e-BH procedure (Wang and Ramdas, 2022) over all candidates of the corpus
holds the share of false discoveries at ``FDR`` whatever their dependence; e-values are rounded down to tenths of a decade,
which keeps that.

Scale: two counting scans whose results are a few hundred numbers, then one scan that decides; nothing is shuffled but those
counts. Starts and lengths are bytes of the UTF-8 text.

Defined cases: null and empty texts have no findings and :func:`redact` leaves them; very long texts and tokens are tested
whole; equal tokens get equal decisions in one corpus, repeated rows repeat their findings; null ids stay null; an empty
table gives an empty result; further columns are ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import chunks, need, utf8

LEAST = 16
RANDOM_FROM = 1e-3
FDR = 0.01
#: Tenths of a decade of evidence that are told apart: below 1 / FDR none can be a discovery, and beyond the last all are.
LOWEST, HIGHEST = 20, 400
MASK = b"[SECRET]"
_CANDIDATE = re.compile(rb"(?<![\x80-\xffA-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2}+(?![\x80-\xff])")
_LETTER = re.compile(rb"[A-Za-z]")
_BETWEEN = re.compile(rb"[/_\-]+")
_PARTS = [re.compile(rb"[^" + cut + rb"=]{16,}") for cut in (rb"/", rb"_", rb"\-", rb"/_", rb"/\-", rb"_\-", rb"/_\-")]
_CHAINS = [re.compile(rb"(?<![A-Za-z0-9+])[" + c + rb"]+(?:[/_\-]+[" + c + rb"]+)+(?![A-Za-z0-9+])") for c in (rb"0-9a-f", rb"0-9A-F", rb"0-9a-z", rb"0-9A-Z", rb"A-Za-z0-9+")]
_KINDS = [
    ("hex", re.compile(rb"[0-9a-f]+|[0-9A-F]+"), (b"0123456789abcdef", b"0123456789ABCDEF")),
    ("alpha26", re.compile(rb"[a-z]+|[A-Z]+"), (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    ("base32", re.compile(rb"[A-Z2-7]+"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",)),
    ("base36", re.compile(rb"[0-9a-z]+|[0-9A-Z]+"), (b"0123456789abcdefghijklmnopqrstuvwxyz", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    ("base64", re.compile(rb"[A-Za-z0-9+/_\-]+"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")),
]


def _tables() -> dict[str, tuple[int, np.ndarray]]:
    out = {}
    for name, _, alphabets in _KINDS:
        code = np.zeros(256, np.int64)
        for a in alphabets:
            code[np.frombuffer(a, np.uint8)] = np.arange(len(a))
        out[name] = len(alphabets[0]), code
    return out


_CODES = _tables()
#: 0 other, 1 letter, 2 digit, 3 symbol.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[[43, 45, 47, 95]] = 3
_SYMBOL = {43: 0, 45: 1, 47: 2, 95: 3}
_SWITCH = 0.05


def infer(token: bytes) -> str:
    """The narrowest encoding whose alphabet holds the token (padding aside)."""
    return next(name for name, pattern, _ in _KINDS if pattern.fullmatch(token))


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: bytes, kind: str) -> tuple[float, float, float, float]:
    """p-values of the hypothesis that the token is uniform: chi-squared, runs, serial correlation, combined."""
    size, table = _CODES[kind]
    x = table[np.frombuffer(token, np.uint8)]
    n = len(x)
    seen = np.bincount(x, minlength=size)
    statistic = size / n * float(seen @ seen) - n
    mean, var = size - 1, 2 * (size - 1) * (n - 1) / n  # exact moments under uniformity, whatever the length
    k, scale = 2 * mean * mean / var, var / (2 * mean)
    chi = _tail((max(statistic, 0) / scale / k) ** (1 / 3) / math.sqrt(2 / (9 * k)) - (1 - 2 / (9 * k)) / math.sqrt(2 / (9 * k)))
    high = x >= size / 2
    up = int(high.sum())
    down = n - up
    if up and down:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        run = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        run = 2.0 ** (1 - n)
    c = x - x.mean()
    total = float(c @ c)
    serial = 2 * _tail(abs(float(c[1:] @ c[:-1]) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (chi, run, serial))
    return chi, run, serial, math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0


@dataclass
class Natural:
    """Log probabilities of natural characters: 26 letters, 4 symbols, and class transitions (4 x 4)."""

    letters: np.ndarray
    symbols: np.ndarray
    moves: np.ndarray

    def log10_ratio(self, token: bytes, kind: str) -> float:
        """log10 of the likelihood of the token under uniformity over that under the natural model."""
        b = np.frombuffer(token, np.uint8)
        c = _CLASS[b]
        natural = self.moves[np.concatenate([[0], c[:-1]]), c].sum() + self.letters[(b[c == 1] | 32) - 97].sum()
        natural += (c == 2).sum() * -math.log(10) + sum(self.symbols[_SYMBOL[v]] for v in b[c == 3].tolist())
        upper = (b[c == 1] & 32) == 0
        if len(upper):
            turns = int((upper[1:] != upper[:-1]).sum())
            natural += math.log(0.5) + turns * math.log(_SWITCH) + (len(upper) - 1 - turns) * math.log(1 - _SWITCH)
        return float((-math.log(len(_KINDS)) - len(b) * math.log(_CODES[kind][0]) - natural) / math.log(10))


def evidence(p_random: float, log10_ratio: float) -> float:
    """log10 of the e-value of a candidate with these results of the battery and of the likelihood ratio."""
    return log10_ratio + min(0.0, math.log10(p_random / RANDOM_FROM)) if p_random > 0 else -math.inf


def bucket(log10_e: float) -> int | None:
    """Tenths of a decade, rounded down; None for what can't be a discovery."""
    return min(HIGHEST, math.floor(10 * log10_e)) if log10_e >= LOWEST / 10 else None


@dataclass
class Detector:
    """The natural model and the least e-value bucket (tenths of a decade) that is a discovery; None if there is none."""

    natural: Natural
    least: int | None

    def tests(self, token: bytes) -> tuple[str, float, float, float, float, float]:
        body = token.rstrip(b"=")
        kind = infer(body)
        p = battery(body, kind)
        return (kind, *p, evidence(p[3], self.natural.log10_ratio(body, kind)))

    def secret(self, log10_e: float) -> bool:
        own = bucket(log10_e)
        return self.least is not None and own is not None and own >= self.least


def _within(run: bytes) -> set[tuple[int, int, bytes]]:
    """(start, end, token) of a run and of the parts and chains in it; padding goes with what ends at it."""
    out = {(0, len(run), run)}
    if _BETWEEN.search(run):
        body = len(run.rstrip(b"="))
        for pattern in (*_PARTS, *_CHAINS):
            for m in pattern.finditer(run):
                token = _BETWEEN.sub(b"", m.group()) if pattern in _CHAINS else m.group()
                if len(token) >= LEAST and _LETTER.search(token):
                    out.add((m.start(), len(run) if m.end() == body else m.end(), token + run[body:] if m.end() == body else token))
    return out


def candidates(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, bytes]]]]:
    """(row, start byte of a run, its candidates from there) of every run of an Arrow string column."""
    data, off = utf8(column)
    raw = memoryview(data)
    for row, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        text = raw[a:b]
        for m in _CANDIDATE.finditer(text):
            token = m.group()
            if _LETTER.search(token):
                yield row, m.start(), sorted(_within(bytes(token)))


def discovered(column: pa.Array, found: Detector) -> Iterator[tuple[int, int, int, tuple]]:
    """(row, start byte, end byte, tests) of every secret that lies in no other, in order; of one span the best evidence."""
    for row, start, tokens in candidates(column):
        hits = [(a, b, t) for a, b, token in tokens if found.secret((t := found.tests(token))[5])]
        last = -1
        for a, b, t in sorted(hits, key=lambda x: (x[0], -x[1], -x[2][5])):
            if b > last:
                last = b
                yield row, start + a, start + b, t


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total = np.zeros(256 + 16, np.int64)
        for _, _, data, off in chunks(b["text"]):
            c = _CLASS[data]
            total[:256] += np.bincount(data, minlength=256)
            if len(c) > 1:
                pair = 4 * c[:-1] + c[1:]
                cut = off[(off > 0) & (off < len(c))] - 1
                total[256:] += np.bincount(pair, minlength=16) - np.bincount(pair[np.unique(cut)], minlength=16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "n"])


def natural_model(docs: DataFrame) -> Natural:
    """Counted over all bytes of all documents; every count is raised by one."""
    got = need(docs, "text").mapInArrow(_count_batches, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    total = np.ones(256 + 16)
    for r in got:
        total[r["k"]] += r["n"]
    letters = total[97:123] + total[65:91]
    symbols = total[[43, 45, 47, 95]]
    moves = total[256:].reshape(4, 4).copy()
    moves[:, 0] = 0  # given that the token goes on
    moves[0] = moves.sum(0)  # its first character: any class as often as it occurs
    with np.errstate(divide="ignore"):
        return Natural(np.log(letters / letters.sum()), np.log(symbols / symbols.sum()), np.log(moves / moves.sum(1, keepdims=True)))


def _bucket_batches(natural: Natural):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Detector(natural, None)
        for b in batches:
            out = []
            for _, _, tokens in candidates(b["text"]):
                for _, _, token in tokens:
                    out.append(bucket(probe.tests(token)[5]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["bucket"])

    return run


def discoveries_from(counts: list[tuple[int | None, int]], fdr: float = FDR) -> int | None:
    """e-BH on bucket counts (None: no discovery, whatever the rest): the least bucket b with 10^(b/10) >= m / (fdr * tokens at b or above)."""
    m, above, least = sum(n for _, n in counts), 0, None
    for own, n in sorted(((b, n) for b, n in counts if b is not None), reverse=True):
        above += n
        if own / 10 >= math.log10(m / (fdr * above)):
            least = own
    return least


def calibrate(docs: DataFrame) -> Detector:
    natural = natural_model(docs)
    counts = need(docs, "text").mapInArrow(_bucket_batches(natural), "bucket long").groupBy("bucket").count().collect()
    return Detector(natural, discoveries_from([(r["bucket"], r["count"]) for r in counts]))


def scan(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, start, length, encoding, p_chi, p_runs, p_serial, p_random, log10_e) of every secret."""
    found = detector or calibrate(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for row, start, end, t in discovered(b["text"], found):
                rows.append(row)
                out.append((start, end - start, *t))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5]
            ids = b["doc_id"].take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "start", "length", "encoding", "p_chi", "p_runs", "p_serial", "p_random", "log10_e"])

    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, start int, length int, encoding string, p_chi double, p_runs double, p_serial double, p_random double, log10_e double")


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``docs``, all rows and columns, with every secret of ``text`` replaced by a mark; ``n_chars``, if there, follows the text."""
    found = detector or calibrate(docs)

    @F.arrow_udf("string")
    def masked(column: pa.Array) -> pa.Array:
        spans: dict[int, list[tuple[int, int]]] = {}
        for row, start, end, _ in discovered(column, found):
            cut = spans.setdefault(row, [])
            if cut and start < cut[-1][1]:  # two that overlap are masked as one
                start = cut.pop()[0]
            cut.append((start, end))
        if not spans:
            return column.cast(pa.string())
        texts = column.to_pylist()
        for row, cut in spans.items():
            raw, parts, at = texts[row].encode(), [], 0
            for a, b in cut:
                parts += [raw[at:a], MASK]
                at = b
            texts[row] = b"".join([*parts, raw[at:]]).decode()
        return pa.array(texts, pa.string())

    names = docs.columns
    new = "_masked"
    while new in {n.lower() for n in names}:
        new += "_"
    out = docs.withColumn(new, masked(F.col("`text`")))
    swap = {"text": F.col(new)}
    if "n_chars" in names:
        swap["n_chars"] = F.when(F.col(new) != F.col("`text`"), F.length(F.col(new)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("`n_chars`"))
    return out.select(*[swap[n].alias(n) if n in swap else F.col(f"`{n}`") for n in names])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
