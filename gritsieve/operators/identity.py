"""Fingerprints, deltas with relocation, and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
#: What tells a finding but for its line; ``at_path`` is the path of the place.
_KEY = ["rule_id", "family", "scope", "message", "at_path", "evidence"]


def places() -> Column:
    """The finding's locations; without any, line 1 of its path or of ``<repo>``."""
    none = F.array(F.struct(F.coalesce("path", F.lit("<repo>")).alias("path"), F.lit(1).alias("line"), F.lit(1).alias("column")))
    return F.when(F.size("locations") > 0, F.col("locations")).otherwise(none)


def fingerprint(rule: Column, message: Column, path: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws(":", rule, message, path, line.cast("string")), 256)


def with_occurrences(findings: DataFrame) -> DataFrame:
    """``occurrences``: the fingerprint of every place. Column and evidence don't count."""
    each = F.transform(places(), lambda p: F.struct(fingerprint(F.col("rule_id"), F.col("message"), p["path"], p["line"]).alias("fingerprint"), p["path"].alias("path"), p["line"].alias("line"), p["column"].alias("column")))
    return findings.withColumn("occurrences", each)


def _each(findings: DataFrame) -> DataFrame:
    """(fingerprint, row, order) of every place of every finding; ``at_path`` is the place's path."""
    each = with_occurrences(findings).select("*", F.posexplode("occurrences").alias("at", "o"))
    order = F.struct(F.concat("rule_id", F.coalesce("path", F.lit(""))), "ord", "at")
    return each.select(F.col("o.fingerprint").alias("fingerprint"), F.struct("rule_id", "family", "scope", "message", F.col("o.path").alias("at_path"), "evidence", "path", "severity", "score", "locations", "o").alias("row"), order.alias("order"))


def occurrences(findings: DataFrame) -> DataFrame:
    """One row for each fingerprint: of findings that share it, the last in raw order."""
    return _each(findings).groupBy("fingerprint").agg(F.max_by("row", "order").alias("r")).select("fingerprint", "r.*")


def differences(base: DataFrame, head: DataFrame) -> DataFrame:
    """(status, fingerprint, finding columns) of the fingerprints that only one side has, from one grouping of both."""
    both = _each(base).withColumn("status", F.lit("resolved")).unionByName(_each(head).withColumn("status", F.lit("added")))
    g = both.groupBy("fingerprint").agg(F.min("status").alias("status"), F.max("status").alias("other"), F.max_by("row", "order").alias("r"))
    return g.where("status = other").select("status", "fingerprint", "r.*")


def moved(changes: DataFrame) -> DataFrame:
    """(added, resolved) fingerprints of findings that only moved: the same but for line, once on either side."""
    own = lambda s: F.col("status") == s
    g = changes.groupBy(*_KEY).agg(*[F.count_if(own(s)).alias("n_" + s) for s in ("added", "resolved")], *[F.min(F.when(own(s), F.col("fingerprint"))).alias(s) for s in ("added", "resolved")])
    return g.where("n_added = 1 and n_resolved = 1").select("added", "resolved")


def relocations(added: DataFrame, resolved: DataFrame) -> DataFrame:
    return moved(added.withColumn("status", F.lit("added")).unionByName(resolved.withColumn("status", F.lit("resolved"))))


def delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(status, fingerprint, finding columns) of what head adds and resolves, without what only moved.

    Both sides meet in one grouping by fingerprint, and what differs is grouped once more by all but its line; the groups are
    counted by partial aggregation, whatever their size.
    """
    changes = differences(base, head)
    gone = moved(changes).select(F.explode(F.array("added", "resolved")).alias("fingerprint"))
    kept = changes.join(gone, "fingerprint", "left_anti")
    return kept.select("status", "fingerprint", "rule_id", "family", "scope", "message", "path", "evidence", "severity", "score", "locations").orderBy("fingerprint")


def delta_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "resolved").alias("resolved"))


def new_findings(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings that have an added fingerprint."""
    added = delta(baseline, findings).where("status = 'added'").select("fingerprint")
    each = with_occurrences(findings).select("*", F.explode("occurrences.fingerprint").alias("fingerprint"))
    return each.join(added, "fingerprint", "left_semi").dropDuplicates(["rule_id", "message", "path", "ord"]).drop("fingerprint", "occurrences")


def fails(changes: DataFrame, on: list[str]) -> bool:
    """Whether a change has a listed status (``any``: either)."""
    if not on:
        return False
    return changes.where(F.lit(True) if "any" in on else F.col("status").isin(on)).limit(1).count() > 0
