"""Selection, order, weights and rollups of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, text


def candidate_paths() -> Column:
    """The finding's path and those of its locations: non-empty, distinct, in order."""
    all_paths = F.concat(F.array("path"), F.transform("locations", lambda x: x["path"]))
    return F.array_distinct(F.filter(all_paths, lambda p: p.isNotNull() & (p != "")))


def selected(findings: DataFrame, rules: list[str] | None = None, paths: list[str] | None = None, min_score: float | None = None) -> DataFrame:
    """Findings of the listed rules, of at least the score, with a candidate path that any glob matches."""
    out = findings
    if rules:
        out = out.where(F.col("rule_id").isin(rules))
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if paths:
        out = out.where(F.exists(candidate_paths(), lambda p: globs.matches(p, paths)))
    return out


def emission_order() -> list[Column]:
    """As rules emit: files, then directories, then the repository."""
    return [F.col("ord")]


def raw_order() -> list[Column]:
    """By rule id and path written together, then by emission."""
    return [F.concat("rule_id", F.coalesce("path", F.lit(""))), F.col("ord")]


def selection_order() -> list[Column]:
    """By falling score, rule, first candidate path and first line, then raw order."""
    first = F.coalesce(F.get(candidate_paths(), 0), F.lit(""))
    line = F.coalesce(F.get(F.col("locations"), 0)["line"], F.lit(0))
    return [F.desc("score"), F.asc("rule_id"), first.asc(), line.asc(), *raw_order()]


def top(findings: DataFrame, most: int | None) -> DataFrame:
    """In selection order, the first ``most`` (all if None): a bounded heap in every task, no global sort."""
    out = findings.orderBy(*selection_order())
    return out if most is None else out.limit(most)


def weighted(findings: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores times the weights of their rules (1 where none is given)."""
    changed = {r: w for r, w in weights.items() if w != 1.0}
    if not changed:
        return findings
    table = F.create_map(*[F.lit(x) for pair in changed.items() for x in (pair[0], float(pair[1]))])
    return findings.withColumn("score", F.col("score") * F.coalesce(F.try_element_at(table, "rule_id"), F.lit(1.0)))


def raw_file_scores(findings: DataFrame) -> DataFrame:
    """(path, score, finding_count) by the finding's own path, directories included."""
    g = findings.where("path is not null").groupBy("path").agg(F.sum("score").alias("score"), F.count("*").alias("finding_count"))
    return g.orderBy(F.desc("score"), "path")


def raw_directory_scores(findings: DataFrame) -> DataFrame:
    return raw_file_scores(findings.where("scope = 'directory'"))


def file_scores(findings: DataFrame) -> DataFrame:
    """A finding counts once for each of its candidate paths."""
    each = findings.select("score", F.explode(candidate_paths()).alias("path"))
    return each.groupBy("path").agg(F.sum("score").alias("score"), F.count("*").alias("finding_count")).orderBy(F.desc("score"), F.desc("finding_count"), "path")


def directory_scores(findings: DataFrame) -> DataFrame:
    """A finding counts for the directory of each of its candidate paths, twice if two lie in one."""
    each = findings.select("score", F.explode(candidate_paths()).alias("path")).withColumn("path", text.dirname(F.col("path")))
    return each.groupBy("path").agg(F.sum("score").alias("score"), F.count("*").alias("finding_count")).orderBy(F.desc("score"), F.desc("finding_count"), "path")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of totals and ratios; ``files`` has path, line_count, logical_line_count and function_count."""
    f = files.agg(
        F.count("*").alias("file_count"), F.count_distinct(text.dirname(F.col("path"))).alias("directory_count"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("physical_line_count"),
        F.coalesce(F.sum("logical_line_count"), F.lit(0)).cast("long").alias("logical_line_count"), F.coalesce(F.sum("function_count"), F.lit(0)).cast("long").alias("function_count"),
    )
    g = findings.agg(F.count("*").alias("finding_count"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("repo_score"))
    both = f.unionByName(g, allowMissingColumns=True)  # one row each, of different columns
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    kloc = F.col("logical_line_count") / 1000
    return both.select(
        "*", _ratio(F.col("repo_score"), F.col("file_count")).alias("score_per_file"), _ratio(F.col("repo_score"), kloc).alias("score_per_kloc"), _ratio(F.col("repo_score"), F.col("function_count")).alias("score_per_function"),
        _ratio(F.col("finding_count"), F.col("file_count")).alias("findings_per_file"), _ratio(F.col("finding_count"), kloc).alias("findings_per_kloc"), _ratio(F.col("finding_count"), F.col("function_count")).alias("findings_per_function"),
    )


def stat_path() -> Column:
    first = F.get(F.col("locations"), 0)["path"]
    return F.coalesce(F.when(F.col("path") != "", F.col("path")), first, F.lit("<repo>"))


def top_rules(findings: DataFrame, most: int = 10) -> DataFrame:
    """(rule_id, finding_count, location_count), most findings first, ties as first met."""
    g = findings.groupBy("rule_id").agg(F.count("*").alias("finding_count"), F.sum(F.greatest(F.lit(1), F.size("locations"))).alias("location_count"), F.min(F.struct(*raw_order())).alias("first"))
    return g.orderBy(F.desc("finding_count"), "first").limit(max(1, most)).drop("first")


def top_files(findings: DataFrame, most: int = 10) -> DataFrame:
    g = findings.withColumn("path_", stat_path()).groupBy(F.col("path_").alias("path")).agg(F.count("*").alias("finding_count"), F.min(F.struct(*raw_order())).alias("first"))
    return g.orderBy(F.desc("finding_count"), "first").limit(max(1, most)).drop("first")


def stats_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("finding_count"), F.count_distinct("rule_id").alias("unique_rules"), F.count_distinct(stat_path()).alias("unique_paths"))
