"""Blockwise suffix sorting with a difference cover (Kärkkäinen, 2007), on integer texts, in numpy.

Suffixes are sorted one bucket at a time by their first ``PERIOD`` symbols. Suffixes that tie on these are told apart by the
ranks of a sample that is ranked beforehand: the positions whose residue modulo the period lies in a difference cover. For
any two positions some shift below the period moves both into the sample, so one comparison of ranks settles a tie of any
length, and memory is that of the bucket, the text and the sample.
"""

from __future__ import annotations

import functools

import numpy as np

PERIOD = 16
#: Every difference modulo 16 is one of two of these.
COVER = (0, 1, 2, 5, 8)
_SHIFT = np.full((PERIOD, PERIOD), -1, np.int64)
for _d in range(PERIOD - 1, -1, -1):
    for _i in range(PERIOD):
        for _j in range(PERIOD):
            if (_i + _d) % PERIOD in COVER and (_j + _d) % PERIOD in COVER:
                _SHIFT[_i, _j] = _d
assert (_SHIFT >= 0).all()


def packed(text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first PERIOD symbols at each position as columns of 64 bits, as many symbols to each as fit; past the end reads 0."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    pack = max(1, min(PERIOD, 64 // bits))
    long = np.concatenate([text, np.zeros(PERIOD, text.dtype)]).astype(np.uint64)
    out = []
    for c in range(0, PERIOD, pack):
        key = np.zeros(len(at), np.uint64)
        for j in range(c, min(c + pack, PERIOD)):
            key = (key << np.uint64(bits % 64)) | long[np.minimum(at + j, n + PERIOD - 1)]
        out.append(key)
    return out


def _dense(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 1 in that order) of rows of key columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new) + 1


def sample_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of every sample position among the sample (0 elsewhere and past the end), by prefix doubling.

    Ranks are told apart in full: if two could be equal, comparisons at different shifts might contradict each other.
    """
    n = len(text)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + 2 * PERIOD, np.int64)
    if not len(at):
        return rank
    order, dense = _dense(packed(text, at))
    rank[at[order]] = dense
    known = PERIOD
    while dense[-1] < len(at):
        key = rank[at] * (len(at) + 1) + rank[np.minimum(at + known, n + PERIOD)]  # at + known has the same residue
        order, dense = _dense([key])
        rank[at[order]] = dense
        known *= 2
    return rank


def _resolve(group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rows of tied positions (m, g), each row put in order."""
    d = _SHIFT[group[:, :, None] % PERIOD, group[:, None, :] % PERIOD]
    mine, other = rank[group[:, :, None] + d], rank[group[:, None, :] + d]
    before = (other < mine) | ((other == mine) & (group[:, None, :] < group[:, :, None]))
    place = before.sum(2)
    out = np.empty_like(group)
    np.put_along_axis(out, place, group, 1)
    return out


def sort_bucket(text: np.ndarray, suffixes: np.ndarray, rank: np.ndarray, lead: np.ndarray | None = None) -> np.ndarray:
    """``suffixes`` in order (by ``lead`` first, if given); ties on PERIOD symbols by sample ranks, equal ranks by position."""
    columns = packed(text, suffixes)
    if lead is not None:
        columns = [lead, *columns]
    order, dense = _dense(columns)
    out = suffixes[order]
    ends = np.flatnonzero(np.concatenate([dense[1:] != dense[:-1], [True]])) + 1 if len(out) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([[0], ends]))
    begin = ends - size
    for g in np.unique(size[size > 1]).tolist():
        own = begin[size == g]
        if g <= 96:
            step = max(1, (1 << 21) // (g * g))
            for a in range(0, len(own), step):
                index = own[a : a + step, None] + np.arange(g)
                out[index] = _resolve(out[index], rank)
        else:
            for b in own.tolist():
                out[b : b + g] = _merge_classes(out[b : b + g], rank)
    return out


def _merge_classes(group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A long tie: each residue class is in order by its ranks at any one shift, and classes are merged by searching ranks."""
    residue = group % PERIOD
    classes = [group[residue == r] for r in np.unique(residue)]
    classes = [c[np.lexsort((c, rank[c + _SHIFT[c[0] % PERIOD, c[0] % PERIOD]]))] for c in classes]
    place = np.zeros(len(group), np.int64)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in classes])])
    for i, c in enumerate(classes):
        place[begin[i] : begin[i + 1]] += np.arange(len(c))
        for j, o in enumerate(classes):
            if i != j:
                d = _SHIFT[c[0] % PERIOD, o[0] % PERIOD]
                place[begin[i] : begin[i + 1]] += np.searchsorted(rank[o + d], rank[c + d], "right" if j < i else "left")
    out = np.empty_like(group)
    out[place] = np.concatenate(classes)
    return out


def suffix_array(text: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The whole suffix array, a bucket of about ``block`` suffixes (a range of first symbols) at a time."""
    text = np.asarray(text, np.int64) + 1
    rank = sample_ranks(text)
    by = np.argsort(text, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], text[by][1:] != text[by][:-1]])) if len(text) else np.zeros(0, np.int64)
    out, at = [], 0
    for c in [*cuts[1:].tolist(), len(text)]:
        if c - at >= block or c == len(text):
            out.append(sort_bucket(text, by[at:c], rank))
            at = c
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def naive(text: list[int]) -> list[int]:
    """The definition, for tests."""
    return sorted(range(len(text)), key=functools.cmp_to_key(lambda i, j: -1 if text[i:] < text[j:] else 1))
