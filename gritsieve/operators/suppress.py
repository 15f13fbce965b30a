"""Configured ignores with budgets, and inline directives."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import text as X
from .findings import candidate_paths

DIRECTIVE = "quality-ignore"
_ID = r"[A-Za-z0-9_]+(?:[.\-][A-Za-z0-9_]+)*"


@dataclass
class Ignore:
    messages: list[str]
    paths: list[str]
    rules: list[str]
    count: int | None = None


def java_pattern(pattern: str) -> str:
    """A delimited PCRE pattern as a Java one; raises ValueError if it isn't one."""
    p = pattern.strip()
    if len(p) < 2 or p[0].isalnum() or p[0] == "\\":
        raise ValueError(f"Invalid ignore pattern: {pattern}")
    close = {"(": ")", "[": "]", "{": "}", "<": ">"}.get(p[0], p[0])
    end = p.rfind(close)
    flags = p[end + 1 :]
    if end <= 0 or not re.fullmatch("[imsxuD]*", flags):
        raise ValueError(f"Invalid ignore pattern: {pattern}")
    body = p[1:end].replace("\\" + p[0], p[0] if p[0] in "/#~!@%&," else "\\" + p[0])
    try:
        re.compile(body)
    except re.error:
        raise ValueError(f"Invalid ignore pattern: {pattern}") from None
    kept = "".join(dict.fromkeys(f for f in flags if f in "imsx"))
    return (f"(?{kept})" if kept else "") + body


def normalize(entries: list[Any]) -> list[Ignore]:
    """A string is a message pattern; an object has message(s), path(s), ruleId(s) or identifier(s), and count."""
    out = []
    for e in entries:
        if isinstance(e, str):
            e = {"message": e}
        if not isinstance(e, dict):
            continue

        def several(*names: str, e: dict = e) -> list[str]:
            return [v for n in names for v in (e[n] if isinstance(e.get(n), list) else [e.get(n)]) if isinstance(v, str) and v]

        count = e.get("count")
        if isinstance(count, str):
            if not count.strip().isdigit():
                raise ValueError(f"Invalid ignore count: {count}")
            count = int(count)
        ignore = Ignore([java_pattern(m) for m in several("message", "messages")], several("path", "paths"), several("ruleId", "ruleIds", "identifier", "identifiers"), max(0, count) if isinstance(count, int) and not isinstance(count, bool) else None)
        if ignore.messages or ignore.paths or ignore.rules:
            out.append(ignore)
    return out


def matches(ignore: Ignore) -> Column:
    cond = F.lit(True)
    if ignore.rules:
        cond &= F.col("rule_id").isin(ignore.rules)
    if ignore.messages:
        cond &= F.col("message").rlike("|".join(f"(?:{m})" for m in ignore.messages))
    if ignore.paths:
        cond &= F.exists(candidate_paths(), lambda p: globs.matches(p, ignore.paths))
    return cond


def ignored(findings: DataFrame, ignores: list[Ignore]) -> DataFrame:
    """Findings that no entry ignores. An entry with a count takes its first matches in order of emission, in turn.

    Entries without a count fold into one predicate. For a counted one the place of its last match is found (the greatest of
    the first ``count``, a bounded heap in every task) and becomes a predicate too, so entries don't multiply the plan.
    """
    out = findings
    for g in ignores:
        hit = F.coalesce(matches(g), F.lit(False))
        if g.count is None:
            out = out.where(~hit)
        elif g.count:
            place = F.struct("ord", "rule_id")
            last = out.where(hit).select(place.alias("p")).orderBy("p").limit(g.count).agg(F.max("p").alias("p"), F.count("*").alias("n")).first()
            if last["n"] == g.count:
                out = out.where(~hit | (place > _literal(last["p"])))
            else:
                out = out.where(~hit)
    return out


def _literal(p) -> Column:
    kinds = [("phase", "int"), ("unit", "string"), ("rule", "int"), ("key", "string"), ("a", "bigint"), ("b", "bigint")]
    return F.struct(F.struct(*[F.lit(p["ord"][n]).cast(k).alias(n) for n, k in kinds]).alias("ord"), F.lit(p["rule_id"]).alias("rule_id"))


def directives(comments: DataFrame, token: str = DIRECTIVE) -> DataFrame:
    """(path, rule_id, first, last) of comments (path, line, text) that carry a directive; a malformed tail voids it."""
    body = X.comment_body(F.col("text"))
    tail = X.trim(F.regexp_extract(body, rf"(?i)@{re.escape(token)}(?![A-Za-z0-9_])([^\r\n]*)", 1))
    ids = F.regexp_extract(tail, rf"\A({_ID}(?:\s*,\s*{_ID})*)(?:\s*\([^()\r\n]+\))?\z", 1)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = comments.select("path", F.explode(F.split(ids, ",")).alias("id"), F.col("line").alias("first"), (F.col("line") + breaks).alias("last"))
    return rows.select("path", X.trim(F.col("id")).alias("rule_id"), "first", "last").where("rule_id <> ''")


def inline_suppressed(findings: DataFrame, found: DataFrame) -> DataFrame:
    """Drop file findings that have a location from a directive's first line to the line after its last.

    Whether a line of a file is covered for a rule is decided once, by the furthest end of the directives that begin up to it;
    so findings and directives meet in order of lines, not each with each.
    """
    keyed = findings.withColumn("_key", F.struct("rule_id", "ord"))
    each = keyed.where("scope = 'file'").select("_key", "rule_id", F.explode("locations").alias("l")).select("_key", "rule_id", F.col("l.path").alias("at"), F.col("l.line").alias("line"))
    here = ["at", "rule_id", "line"]
    lines = each.select(*here).where("at IS NOT NULL AND rule_id IS NOT NULL AND line IS NOT NULL").distinct().withColumn("end", F.lit(None).cast("bigint"))
    spans = found.where("path IS NOT NULL AND rule_id IS NOT NULL AND first IS NOT NULL AND last IS NOT NULL").groupBy(F.col("path").alias("at"), "rule_id", F.col("first").cast("int").alias("line")).agg((F.max("last").cast("bigint") + 1).alias("end"))
    # of one line the directives come first, as null ends come last
    furthest = F.max("end").over(W.partitionBy("at", "rule_id").orderBy("line", F.asc_nulls_last("end")).rowsBetween(W.unboundedPreceding, 0))
    covered = lines.unionByName(spans).withColumn("furthest", furthest).where("end IS NULL AND furthest >= line").select(*here)
    hit = each.join(covered, here, "left_semi").select(F.col("_key").alias("_hit")).distinct()
    return keyed.join(hit, F.col("_key") == F.col("_hit"), "left_anti").drop("_key")
