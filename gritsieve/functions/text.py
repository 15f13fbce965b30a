"""Column functions with byte-mode and ASCII semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[ \t\n\r\x00\x0B]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word edges that see ASCII alone (a JVM regex would take accented letters for word characters).
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def trim(c: Column) -> Column:
    """Strip blanks, tabs, line ends, NUL and vertical tabs."""
    return F.regexp_replace(c, rf"\A{_BLANK}+|{_BLANK}+\z", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def physical_lines(c: Column) -> Column:
    """Lines of a text; a closing line end opens no further line."""
    breaks = F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(c == "", 0).otherwise(breaks + F.when(c.endswith("\n"), 0).otherwise(1)).cast("int")


def lines(c: Column) -> Column:
    """Lines of a text, CRLF and CR folded."""
    return F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)


def logical_lines(c: Column) -> Column:
    """Lines that aren't blank and don't begin as a comment does."""
    kept = F.filter(F.split(c, r"\R", -1), lambda x: (trim(x) != "") & ~trim(x).rlike(r"\A(?://|\*)"))
    return F.size(kept).cast("int")


def comment_body(c: Column) -> Column:
    """A comment without its opening and closing marks."""
    opened = F.regexp_replace(trim(c), r"\A\s*(?://|#|/\*\*?| \*)\s?", "")
    return trim(F.regexp_replace(opened, r"\s*\*/\s*\z", ""))


def word_count(c: Column) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens that hold more than edge marks."""
    clean = F.regexp_replace(F.regexp_replace(c, r"\A['\-]+", ""), r"-\z", "")
    return F.size(F.regexp_extract_all(clean, F.lit("[A-Za-z'\\-]+"), F.lit(0)))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def dirname(c: Column) -> Column:
    """The directory of a relative path; ``.`` at the root."""
    return F.when(F.instr(c, "/") == 0, ".").otherwise(F.regexp_replace(c, r"/[^/]*\z", ""))
