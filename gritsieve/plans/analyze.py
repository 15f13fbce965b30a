"""The whole analysis as one lazy plan: files -> facts -> findings -> weights -> suppression -> rollups."""

from __future__ import annotations

import copy
from dataclasses import asdict, dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import facts, findings, overrides, rules, suppress
from ..plugins import Registry, RulePlugin, default_registry
from ..sources import cache, files, reports
from ..sources.config import Config

_PATH_SCOPED = {r for r, (_, _, scope) in rules.RULES_META.items() if scope == "file" and r != "php.duplicate-mock-setup"}
_DIRECTORY = ("php.directory-fanout-hotspot", "php.over-fragmentation")


@dataclass
class Analysis:
    """``files`` with facts and ``findings`` (in no order) after weights and suppression."""

    root: str
    config: Config
    files: DataFrame
    findings: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Let go of what is held in memory; the tables stay usable and are computed anew."""
        for df in self.kept:
            df.unpersist()

    def select(self) -> DataFrame:
        s = self.config.scan
        return findings.top(findings.selected(self.findings, s.rules, s.path_filters, s.min_score), s.max_findings)

    def summary(self, kept: DataFrame | None = None) -> DataFrame:
        counted = self.files.select("path", "line_count", "logical_line_count", F.size(F.coalesce("functions", F.array())).alias("function_count"))
        return findings.summary(counted, self.findings if kept is None else kept)

    def whole_report(self) -> dict[str, Any]:
        """The report of all findings, whatever the configured selection."""
        config = copy.deepcopy(self.config)
        config.scan.rules, config.scan.path_filters, config.scan.max_findings, config.scan.min_score = [], [], None, None
        return Analysis(self.root, config, self.files, self.findings).report([F.concat("ruleId", F.coalesce("path", F.lit(""))), F.col("ord")]) | {"config": asdict(self.config)}

    def write_findings(self, path: str, kind: str = "ndjson") -> None:
        """Findings of any number as text lines, written by the executors in selection order; the report's totals aren't among them."""
        lines = {"ndjson": reports.ndjson_lines, "lint": reports.lint_lines, "github": reports.annotations}[kind](self.select())
        lines.select("value").write.text(path)

    def report(self, order: list[Column] | None = None) -> dict[str, Any]:
        """The report as plain data (collected to the driver: it is one document)."""
        kept = self.select()
        s = self.summary(kept).first().asDict()
        camel = lambda k: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(k.split("_")))
        ratios = ("score_per_file", "score_per_kloc", "score_per_function", "findings_per_file", "findings_per_kloc", "findings_per_function")
        summary = {camel(k): v for k, v in s.items() if k not in ratios} | {"normalized": {camel(k): s[k] for k in ratios}}
        rows = [r.asDict(True) for r in reports.report_rows(kept).orderBy(*(order or _report_order())).drop("ord").collect()]
        listed = [{"path": r["path"], "extension": r["extension"], "lineCount": r["line_count"], "languageId": r["language_id"]} for r in self.files.select("path", "extension", "line_count", "language_id").orderBy("path").collect()]
        folders = [{"path": r["directory"], "filePaths": r["paths"]} for r in files.directories(self.files.select("path")).orderBy("directory").collect()]
        score = lambda df: [{"path": r["path"], "score": r["score"], "findingCount": r["finding_count"]} for r in df.collect()]
        out = reports.assemble(self.root, asdict(self.config), summary, rows, listed, folders, score(findings.file_scores(kept)), score(findings.directory_scores(kept)))
        applied = {k: v for k, v in (("rules", self.config.scan.rules), ("paths", self.config.scan.path_filters), ("maxFindings", self.config.scan.max_findings), ("minScore", self.config.scan.min_score)) if v not in (None, [])}
        if applied:
            out["metadata"]["appliedFilters"] = applied
            out["summary"]["findingCountBeforeFilters"] = self.findings.count()
        return out


def _report_order():
    first = F.coalesce(F.get("locations", 0)["path"], F.lit(""))
    return [F.desc("score"), F.asc("ruleId"), F.coalesce(F.when(F.col("path") != "", F.col("path")), first), F.coalesce(F.get("locations", 0)["line"], F.lit(0)), F.col("ord")]


def analyze(spark: SparkSession, found: DataFrame, config: Config | None = None, root: str = ".", cache_path: str | None = None, directive: str = suppress.DIRECTIVE, registry: Registry | None = None) -> Analysis:
    """Analyse (path, text, …) rows as :func:`sources.files.discovered` gives them, with the registry's providers and rules too."""
    config = config or Config()
    registry = registry or default_registry()
    full = facts.with_facts(found, cache.facts(spark, found, cache_path)) if cache_path else facts.extended(found)
    for provider in registry.ordered_providers():
        full = full.join(provider.run(full).select("path", *provider.provides), "path", "left")
    full = full.persist(StorageLevel.MEMORY_AND_DISK)  # the branches share one parse; lost blocks are computed anew
    added = registry.added_rules()
    parts = []
    for scope, path in (("file", F.col("path")), ("directory", text.dirname(F.col("path"))), ("repo", None)):
        names = [r for r in rules.RULES_META if (scope == "file") == (r in _PATH_SCOPED) and (scope == "directory") == (r in _DIRECTORY)]
        own = [r for r in added if r.scope == scope]
        if scope == "repo" or not config.overrides:
            parts.append(_branch(full, names, own, config, ""))
            continue
        keyed = full.withColumn("_key", overrides.variant(path, config.overrides))
        # as many variants as combinations of overrides that occur, a handful
        for (key,) in keyed.select("_key").distinct().collect():
            parts.append(_branch(keyed.where(F.col("_key") == key).drop("_key"), names, own, config, key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    made = out.persist(StorageLevel.MEMORY_AND_DISK)  # read by every suppression; the rules' plan is compiled and run once
    out = suppress.ignored(made, suppress.normalize(config.ignore_errors))
    comments = full.where("language_id = 'php'").select("path", F.explode("comments").alias("c")).select("path", "c.line", "c.text")
    out = suppress.inline_suppressed(out, suppress.directives(comments, directive))
    out = out.persist(StorageLevel.MEMORY_AND_DISK)  # a report reads them several times
    return Analysis(root, config, full, out, (full, made, out))


def _branch(full: DataFrame, names: list[str], own: list[RulePlugin], config: Config, key: str) -> DataFrame:
    resolved = {r: overrides.resolve(r, config.rules, config.overrides, key) for r in [*names, *[r.id for r in own]]}
    made = rules.evaluate(full, {r: resolved[r].options for r in names if resolved[r].enabled})
    for i, rule in enumerate(own):
        if resolved[rule.id].enabled:
            made = made.unionByName(rule.findings(full, resolved[rule.id].options, len(rules.RULES_META) + i))
    return findings.weighted(made, {r: c.weight for r, c in resolved.items()})


def analyze_tree(spark: SparkSession, root: str, config: Config | None = None, cache_path: str | None = None, registry: Registry | None = None) -> Analysis:
    config, registry = config or Config(), registry or default_registry()
    return analyze(spark, files.read_tree(spark, root, config.ignores, registry.language_table()), config, root, cache_path, registry=registry)
