"""Vectorised text primitives shared by the corpus operators.

Everything works on the raw UTF-8 bytes of an Arrow string column, so no Python string is built per row.
A *word* is a maximal run of word bytes; the byte class is a 256-entry table. Word hashes come from one
prefix sum of a polynomial hash over the whole chunk, so the cost is a few numpy passes over the bytes and
does not depend on the number of words. Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that one vectorised pass takes at most (a longer single text is taken whole).
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Word bytes of ``token`` words: everything but the six ASCII white-space bytes.
NOT_SPACE = ~_SPACE
#: Word bytes of ``alnum`` words: ASCII letters, digits and every non-ASCII byte.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: ASCII lower case of every byte; words fold the accented capitals of Latin-1 besides.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("p", _MUL), ("q", _INV)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                _POW[key] = np.cumprod(table, dtype=np.uint64)
    return _POW["p"], _POW["q"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off if len(off) else np.zeros(1, np.int64)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``most`` bytes."""
    data, off = utf8(column)
    n, row = len(off) - 1, 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


class Words:
    """Words of a chunk: ``start``/``end`` byte positions, 64-bit ``hash`` and ``first`` word of every row (n+1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray = ALNUM, fold: np.ndarray = LOWER):
        n = len(data)
        inside = kind[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cuts = off[(off > 0) & (off < n)]
            before[cuts] = False
            after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        power, inverse = _powers(n + 1)
        data = fold[data]
        if fold is LOWER and n:
            data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[data] * power[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first shingle of every row (n+1)) of k consecutive words; a row of 1 to k-1 words has one shingle, of all its words."""
        count = np.diff(self.first)
        have = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
        first = np.concatenate([[0], np.cumsum(have)])
        row = np.repeat(np.arange(len(count)), have)
        at = self.first[:-1][row] + np.arange(first[-1]) - first[:-1][row]
        last = self.first[1:][row]
        out = np.zeros(len(at), np.uint64)
        padded = np.concatenate([self.hash, np.zeros(k, np.uint64)])
        with np.errstate(over="ignore"):
            for j in range(k):
                part = padded[at + j]
                part[at + j >= last] = 0
                out = mix(out + part * _U(2 * j + 3) + _U(j + 1))
        return out, first


def row_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text, ``_k1`` and ``_k2``; null only for a null text."""
    return [
        F.when(text.isNotNull(), F.xxhash64(text)).alias("_k1"),
        F.when(text.isNotNull(), F.xxhash64(F.lit("second"), text, F.octet_length(text))).alias("_k2"),
    ]


def need(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of a table alone, so that other columns of any name can't clash; absent ones are an error."""
    return df.select(*[F.col(f"`{n}`") for n in names])
