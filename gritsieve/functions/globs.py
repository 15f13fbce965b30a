"""Path globs as anchored regular expressions that Java, RE2 and Python read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([\\.+?()\[\]{}^$|])")


def to_regex(glob: str) -> str:
    """``**/`` any directories or none, ``**`` anything, ``*`` anything but a slash; all else is literal."""
    out = _SPECIAL.sub(r"\\\1", glob.replace("\\", "/"))
    marked = out.replace("**/", "\x00").replace("**", "\x01").replace("*", "[^/]*")
    return "^" + marked.replace("\x00", "(?:.*/)?").replace("\x01", ".*") + "$"


def any_of(globs: list[str]) -> str | None:
    """One regex for any of the globs; None if there are none."""
    return "|".join(f"(?:{to_regex(g)})" for g in globs) or None


def any_above(globs: list[str]) -> str | None:
    """One regex for paths that any of the globs matches, or a folder above them."""
    return "|".join(f"(?:{to_regex(g).removesuffix('$')}(?:/.*)?$)" for g in globs) or None


def matches(path: Column, globs: list[str]) -> Column:
    pattern = any_of(globs)
    return F.lit(False) if pattern is None else F.translate(path, "\\", "/").rlike(pattern)
