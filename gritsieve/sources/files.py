"""Files of a source tree as a DataFrame."""

from __future__ import annotations

import codecs
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, text

LANGUAGES = {"php": ["php", "phtml", "inc"], "markdown": ["md", "markdown"]}


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one."""
    return text.ascii_lower(F.regexp_extract(text.basename(path), r"(\.[^.]*)\z", 1))


def language(path: Column, languages: dict[str, list[str]] | None = None) -> Column:
    """The first language that has the path's extension, else null."""
    out = F.lit(None).cast("string")
    for name, known in reversed((languages or LANGUAGES).items()):
        out = F.when(extension(path).isin(["." + e for e in known]), name).otherwise(out)
    return out


def ignored(path: Column, ignores: list[str]) -> Column:
    """Whether an ignore glob matches the path or a folder above it."""
    pattern = globs.any_above(ignores)
    return F.lit(False) if pattern is None else F.translate(path, "\\", "/").rlike(pattern)


def discovered(files: DataFrame, ignores: list[str], languages: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of (path, text, …) that have a language and that no ignore glob matches, with their line counts and hash.

    The predicates see the path alone, so a columnar source prunes or skips the text of what goes. A ``content_hash`` that
    the rows bring (of bytes that are no text) is kept.
    """
    kept = files.where(language(F.col("path"), languages).isNotNull() & ~ignored(F.col("path"), ignores))
    digest = F.col("content_hash") if "content_hash" in files.columns else F.sha2("text", 256)
    return kept.select(
        "path", extension(F.col("path")).alias("extension"), language(F.col("path"), languages).alias("language_id"), "text",
        text.physical_lines(F.col("text")).alias("line_count"), text.logical_lines(F.col("text")).alias("logical_line_count"), digest.alias("content_hash"),
    )


#: Stands for a byte that is no UTF-8: one byte, no word character, so columns and word edges stay.
UNREADABLE = "\x7f"
codecs.register_error("one-byte", lambda e: (UNREADABLE * (e.end - e.start), e.end))


def readable(raw: bytes) -> str:
    return raw.decode("utf-8", "one-byte")


def listed(root: str, ignores: list[str], languages: dict[str, list[str]] | None = None) -> list[tuple[str, str, str]]:
    """(path below the root, address, stamp) of the files that have a language, whatever their case, dots and underscores.

    A folder that an ignore glob matches isn't entered, nor is a linked one. Local folders are read with the operating
    system, others (hdfs, s3, gs, …) through pyarrow.
    """
    skip = re.compile(globs.any_of(ignores) or r"(?!)")
    ends = tuple("." + e for known in (languages or LANGUAGES).values() for e in known)
    wanted = lambda p: p.lower().endswith(ends) and p.lower()[p.rfind("."):] in ends
    out = []
    if "://" not in root or root.startswith("file:"):
        base = os.path.realpath(re.sub(r"^file:(//)?", "", root))
        if not os.path.isdir(base):
            raise FileNotFoundError(f"No such folder: {root}")
        folders = [""]
        while folders:
            at = folders.pop()
            with os.scandir(os.path.join(base, at)) as entries:
                for e in entries:
                    path = f"{at}/{e.name}" if at else e.name
                    if skip.search(path):
                        continue
                    if e.is_dir(follow_symlinks=False):
                        folders.append(path)
                    elif wanted(path) and e.is_file():
                        s = e.stat()
                        out.append((path, "file://" + e.path, f"{s.st_mtime_ns}:{s.st_size}"))
        return sorted(out)
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    base, scheme = base.rstrip("/"), root[: root.index("://") + 3]
    host = root[len(scheme) :].split("/")[0] + "/" if scheme in ("hdfs://", "viewfs://") else ""
    folders = [base]
    while folders:
        for e in system.get_file_info(fs.FileSelector(folders.pop())):
            path = e.path[len(base) :].lstrip("/")
            if skip.search(path):
                continue
            if e.type == fs.FileType.Directory:
                folders.append(e.path)
            elif e.type == fs.FileType.File and wanted(path):
                out.append((path, scheme + host + e.path.lstrip("/"), f"{e.mtime_ns}:{e.size}"))
    return sorted(out)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    systems: dict[str, object] = {}
    for b in batches:
        for begin in range(0, len(b), 64):
            part = b.slice(begin, 64)
            raw = []
            for address in part["address"].to_pylist():
                if address.startswith("file://"):
                    with open(address[7:], "rb") as f:
                        raw.append(f.read())
                    continue
                scheme = address[: address.index("://") + 3] + address.split("://", 1)[1].split("/")[0]
                if scheme not in systems:
                    systems[scheme] = fs.FileSystem.from_uri(address)[0]
                with systems[scheme].open_input_stream(fs.FileSystem.from_uri(address)[1]) as f:
                    raw.append(f.read())
            yield pa.RecordBatch.from_arrays([part["path"], pa.array(map(readable, raw), pa.string()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())], names=["path", "text", "content_hash"])


def read_tree(spark: SparkSession, root: str, ignores: list[str], languages: dict[str, list[str]] | None = None) -> DataFrame:
    """The files under a folder, path relative to it; executors read the bytes, which a folder they share must hold.

    The hash is of the bytes; a byte that is no UTF-8 reads as one unreadable character. Change stamps are part of the plan,
    so rows of a file that has changed since are never taken for those of before.
    """
    found = listed(root, ignores, languages)
    table = spark.createDataFrame(found, "path string, address string, stamp string")
    parts = max(1, min(len(found) // 64 + 1, 4 * spark.sparkContext.defaultParallelism + len(found) // 4096))
    raw = table.repartition(parts, "path", "stamp").mapInArrow(_read_batches, "path string, text string, content_hash string")
    return discovered(raw, [], languages)


def directories(files: DataFrame) -> DataFrame:
    """(directory, paths sorted, file_count) of every directory that holds a file."""
    grouped = files.groupBy(text.dirname(F.col("path")).alias("directory")).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return grouped.withColumn("file_count", F.size("paths"))
