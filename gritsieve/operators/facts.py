"""File facts: one Python stage for each file, everything after it is native."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import FACTS, of

PROVIDER, SCHEMA_VERSION = "php.structure", 1


#: Files that a worker holds the facts of at once, by their number and the bytes of their texts; a longer text is taken alone.
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch["text"]).fill_null(0).to_pylist()):
        if i > start and (i - start >= PIECE_ROWS or size + n > PIECE_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _facts(path: str, text: str | None, names: list[str]) -> tuple:
    from ..functions.php_facts import Facts

    made = Facts(path, text or "")
    row = made.row(names)
    made.release()
    return row


def _kind(names: Iterable[str] | None) -> list[T.StructField]:
    every = of(FACTS).fields[1:]
    if names is None:
        return every
    wanted = set(names)
    if unknown := wanted - {f.name for f in every}:
        raise ValueError(f"Unknown facts: {', '.join(sorted(unknown))}")
    return [f for f in every if f.name in wanted]


def _extend(schema: pa.Schema, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = list(schema)[len(kept) :]
        names = [f.name for f in fields]
        none = (None,) * len(names)
        for batch in batches:
            for b in pieces(batch):
                rows = [_facts(p, t, names)[1:] if kind == "php" else none for p, t, kind in zip(b["path"].to_pylist(), b["text"].to_pylist(), b["language_id"].to_pylist(), strict=True)]
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([b[c].cast(schema.field(c).type) for c in kept] + new, schema=schema)

    return run


def extract(files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The facts of the PHP files among ``files``: all, or those of ``names``, for which nothing else is computed."""
    return extended(files.where("language_id = 'php'").select("path", "language_id", "text"), names, ["path"])


def extended(files: DataFrame, names: Iterable[str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """Every file with its facts (null for languages without), as :func:`with_facts` gives them, in one pass: no text is shuffled.

    ``names`` are the facts to compute, in the order of the schema, and ``kept`` the columns of ``files`` to keep; else all.
    """
    kept = files.columns if kept is None else kept
    kind = T.StructType([*[files.schema[c] for c in kept], *_kind(names)])
    return files.mapInArrow(_extend(to_arrow_schema(kind), kept), kind)


def fingerprint() -> F.Column:
    """Content-addressed key of a file's facts."""
    return F.sha2(F.concat(F.lit(f"{PROVIDER}:{SCHEMA_VERSION}:"), F.col("content_hash")), 256)


def with_facts(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Every file with its facts (null for languages without)."""
    return files.join(facts, "path", "left")


def fingerprint_of(content_hash: str) -> str:
    return hashlib.sha256(f"{PROVIDER}:{SCHEMA_VERSION}:{content_hash}".encode()).hexdigest()
