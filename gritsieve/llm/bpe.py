"""Operator 9: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one vocabulary token can end its BPE encoding. The table of these last tokens is
filled from left to right: a token that ends the prefix is the last one if, with the last token of what precedes it, it forms
a pair that BPE would leave as it is. Walking the table back gives the encoding of any prefix; appending bytes extends the
table; after an edit only entries from the edit on are recomputed, until as many in a row as the longest token agree with
the old table. Whether a pair stays apart is decided by undoing both tokens' merges from the boundary outwards, so a text
costs time linear in its length, long runs included, unlike merge loops.

Documents are first cut by the vocabulary's split pattern, so results equal those of the usual encoders; a worker remembers
the encodings of the pieces it has met. The vocabulary is a rank file, read on the driver and broadcast (its size is fixed).

Scale: one map over the documents, no shuffle. Defined cases: a null text has null tokens, an empty one none; texts are
encoded whole, whatever their length; repeated rows stay; strings that name special tokens are ordinary text; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .textkernel import need, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered pieces of a worker, the longest piece remembered, and remembered pairs; beyond them all is found anew.
CACHE_PIECES, CACHE_BYTES, CACHE_PAIRS = 400_000, 64, 1_000_000
#: Setting that names another vocabulary file.
SETTING = "gritsieve.bpe.vocabulary"


class Vocabulary:
    """Tokens by rank, and the last merge of each: ``left`` and ``right`` (a byte is its own)."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.whole: set[int] = set()  # tokens that merging their own bytes doesn't give; only a piece equal to one has it
        for t, raw in enumerate(tokens):
            if len(raw) > 1:
                parts = self.merge(raw, t)
                if len(parts) == 2:
                    self.left[t], self.right[t] = parts
                else:
                    self.whole.add(t)
        self._index()

    def _index(self) -> None:
        self.apart: dict[int, bool] = {}
        ends: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        self.inner = {t: i for t, i in self.rank.items() if i not in self.whole}
        #: Sizes, longest first, of the tokens that may end where these three bytes do.
        self.sizes = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}

    @classmethod
    def of(cls, tokens: list[bytes], left: list[int], right: list[int], whole: set[int]) -> Vocabulary:
        """A vocabulary whose merges are known."""
        v = cls.__new__(cls)
        v.tokens, v.left, v.right, v.whole = tokens, left, right, whole
        v.rank, v.longest = {t: i for i, t in enumerate(tokens)}, max(map(len, tokens))
        v._index()
        return v

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must be consecutive and hold all single bytes")
        return cls(tokens)

    def merge(self, raw: bytes, below: int | None = None) -> list[int]:
        """The definition of BPE: merge the leftmost pair of least rank until none is left. Quadratic; the reference for tests."""
        below = len(self.tokens) if below is None else below
        parts = [bytes([b]) for b in raw]
        while len(parts) > 1:
            best = min(((self.rank.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)))
            if best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def stays_apart(self, one: int, two: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two tokens."""
        key = one << 32 | two
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= CACHE_PAIRS:
                self.apart.clear()
            known = self.apart[key] = self._stays_apart(one, two)
        return known

    def _stays_apart(self, one: int, two: int) -> bool:
        limit = len(self.tokens)
        while True:
            if self.rank.get(self.tokens[one] + self.tokens[two], limit) < limit:
                return False
            if one > two:  # the later merge is undone first
                limit, one = one, self.right[one]
                if one == limit:
                    limit, two = two + 1, self.left[two]
                    if two + 1 == limit:
                        return True
            else:
                limit, two = two + 1, self.left[two]
                if two + 1 == limit:
                    limit, one = one, self.right[one]
                    if one == limit:
                        return True

    def extend(self, raw: bytes, last: list[int], until: list[int] | None = None, shift: int = 0, clean: int = 0) -> int:
        """Fill ``last`` (entry i: last token of the first i bytes) up to the end of ``raw``.

        With ``until``, an old table whose entry i - shift speaks of the same place, filling stops once the longest token's
        number of entries in a row, all past byte ``clean``, agree; the old entries are then taken over. Returns the number of entries computed.
        """
        rank, apart, longest, sizes = self.inner, self.apart, self.longest, self.sizes
        same, begun = 0, len(last)
        for i in range(len(last), len(raw) + 1):
            for n in sizes.get(raw[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                j = i - n
                if j < 0:
                    continue
                t = rank.get(raw[j:i])
                if t is None:
                    continue
                if j == 0:
                    break
                key = last[j] << 32 | t
                ok = apart.get(key)
                if ok is None:
                    ok = self.stays_apart(last[j], t)
                if ok:
                    break
            last.append(t)
            if until is not None and i > clean:
                same = same + 1 if until[i - shift] == t else 0
                if same >= longest:
                    last.extend(until[i - shift + 1 :])
                    return i + 1 - begun
        return len(raw) + 1 - begun

    def walk(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def piece(self, raw: bytes) -> list[int]:
        """Encoding of one piece; a piece that is itself a token is that token."""
        t = self.rank.get(raw)
        if t is not None:
            return [t]
        last = [-1]
        self.extend(raw, last)
        return self.walk(last, len(raw))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class PrefixTable:
    """The encoding of a changing byte string, without split pattern: exact appends, edits and encodings of any prefix."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", [-1]
        self.append(raw)

    def append(self, more: bytes) -> int:
        self.raw += more
        return self.vocabulary.extend(self.raw, self.last)

    def edit(self, at: int, remove: int, insert: bytes) -> int:
        """Replace ``remove`` bytes at ``at``; returns the number of table entries that had to be computed."""
        old, self.raw = self.last, self.raw[:at] + insert + self.raw[at + remove :]
        self.last = old[: at + 1]
        return self.vocabulary.extend(self.raw, self.last, old, len(insert) - remove, at + len(insert))

    def encode(self, end: int | None = None) -> list[int]:
        """Tokens of the first ``end`` bytes, by default of all."""
        return self.vocabulary.walk(self.last, len(self.raw) if end is None else end)


@functools.cache
def splitter(pattern: str = PATTERN) -> Callable[[str], list[str]]:
    """Cuts a text by the pattern. For texts of Latin-1 characters the classes are spelled out for the quicker engine."""
    full = regex.compile(pattern).findall
    if pattern != PATTERN:
        return full
    letters, numbers, space = ("".join(f"\\x{c:02x}" for c in range(256) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    quick = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return full(text)
        return quick(text)

    return split


class Encoder:
    """Encoding of texts by pieces, which are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary, self.split = vocabulary, splitter(pattern)
        self.known = _Pieces(vocabulary)
        self.flat = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.size = np.array([len(t) for t in vocabulary.tokens])
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def packed(self, text: str) -> bytes:
        """Token ids as little-endian int32."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of many tokens at once."""
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(end):
            return np.zeros(0, np.uint8)
        return self.flat[np.repeat(self.at[ids] - end + size, size) + np.arange(end[-1])]


class _Pieces(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        out = array("i", self.vocabulary.piece(piece.encode())).tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


class EditableText:
    """A text with its pieces and tokens; an edit cuts and encodes anew only from the piece before it until the cuts agree."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.pieces = encoder.split(text)

    def edit(self, at: int, remove: int, insert: str) -> int:
        """Replace ``remove`` characters at ``at``; returns the number of pieces cut anew."""
        new = self.text[:at] + insert + self.text[at + remove :]
        keep, place = 0, 0  # pieces that end two pieces or more before the edit can't change
        while keep < len(self.pieces) and place + len(self.pieces[keep]) < at:
            place += len(self.pieces[keep])
            keep += 1
        for _ in range(min(2, keep)):
            keep -= 1
            place -= len(self.pieces[keep])
        ends, where = {}, place
        shift = len(insert) - remove
        for k in range(keep, len(self.pieces)):
            if where >= at + remove:
                ends[where + shift] = k
            where += len(self.pieces[k])
        fresh = []
        tail: list[str] = []
        for m in regex.compile(PATTERN).finditer(new, place):
            if m.start() in ends and m.start() >= at + len(insert):
                tail = self.pieces[ends[m.start()] :]
                break
            fresh.append(m.group())
        self.text, self.pieces = new, [*self.pieces[:keep], *fresh, *tail]
        return len(fresh)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), 0, more)

    def encode(self) -> list[int]:
        return np.frombuffer(b"".join(map(self.encoder.known.__getitem__, self.pieces)), np.int32).tolist()


_ENCODERS: dict[str, Encoder] = {}


def vocabulary_path(spark: SparkSession) -> str:
    """The file that the session's setting names, else the default one."""
    return spark.conf.get(SETTING, None) or VOCABULARY


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, tokens, exact): exact says that decoding gives the text's bytes."""
    path = path or vocabulary_path(docs.sparkSession)
    vocabulary = Vocabulary.read(path)
    shared = docs.sparkSession.sparkContext.broadcast((path, vocabulary.tokens, vocabulary.left, vocabulary.right, vocabulary.whole))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encoder() -> Encoder:
        name, tokens, left, right, whole = shared.value
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(Vocabulary.of(tokens, left, right, whole))
        return _ENCODERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for whole in batches:
            for begin in range(0, len(whole), 500):
                b = whole.slice(begin, 500)
                column = b["text"]
                data, off = utf8(column)
                packed = [e.packed(t) if t is not None else b"" for t in column.to_pylist()]
                count = np.array([len(p) // 4 for p in packed], np.int64)
                ids = np.frombuffer(b"".join(packed), np.int32)
                ends = np.concatenate([[0], np.cumsum(count)])
                back = e.decode(ids)
                at = np.concatenate([[0], np.cumsum(e.size[ids])])[ends]
                wrong = np.concatenate([[0], np.cumsum(back != data[off[0] : off[-1]])]) if len(back) == off[-1] - off[0] else None
                if wrong is not None and (at == off - off[0]).all():
                    exact = wrong[at[1:]] == wrong[at[:-1]]
                else:
                    exact = np.array([back[at[i] : at[i + 1]].tobytes() == data[off[i] : off[i + 1]].tobytes() for i in range(len(b))])
                null = column.is_null().to_numpy(zero_copy_only=False)
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(off), mask=null), pa.array(count, mask=null), tokens, pa.array(exact, mask=null)], names=["doc_id", "n_bytes", "n_tokens", "tokens", "exact"])

    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, tokens array<int>, exact boolean")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens); null tokens give a null text, ids outside the vocabulary are an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.read(path or vocabulary_path(tokens.sparkSession)).tokens)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            texts = [None if t is None else b"".join([table[i] for i in t]).decode("utf-8", "replace") for t in b["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return need(tokens, "doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, text string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
