"""What an analysis is made of: languages, fact providers, rules and reporters, which callers may add to.

A provider gives columns of facts for (path) rows, a rule gives findings from the files with their facts; both are plans over
DataFrames, evaluated with the built-in ones. Built-in rules share one scan of the facts (:mod:`operators.rules`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import rules as R
from .schema import FINDING_COLUMNS, LOCATION
from .sources import files, reports

#: Facts that every file has before any provider runs.
FILE_FACTS = ("path", "text", "extension", "language_id", "line_count", "logical_line_count", "content_hash")
PHP_FACTS = ("comments", "functions", "catches", "parser", "phpdoc", "debug_calls", "test_calls", "type_escapes", "envelopes", "array_casts", "normalizations", "mock_setups")
_PHASE = {"file": 0, "directory": 1, "repo": 2}


@dataclass(frozen=True)
class LanguagePlugin:
    id: str
    extensions: tuple[str, ...]


@dataclass(frozen=True)
class FactProvider:
    """``run`` takes the files with the facts there are and gives (path, *provides) rows, at most one a path."""

    id: str
    provides: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]
    requires: tuple[str, ...] = ()


@dataclass(frozen=True)
class RulePlugin:
    """``evaluate`` takes the files with facts and the rule's options and gives (path, line, message, evidence, score) rows; null path: the repository."""

    id: str
    family: str
    severity: str
    scope: str
    evaluate: Callable[[DataFrame, dict[str, Any]], DataFrame]
    requires: tuple[str, ...] = ()

    def findings(self, full: DataFrame, options: dict[str, Any], place: int) -> DataFrame:
        """Rows with all columns of findings; ``place`` is that of the rule among all."""
        made = self.evaluate(full, options).select("path", F.coalesce(F.col("line"), F.lit(1)).cast("int").alias("line"), "message", F.col("evidence").cast("array<string>").alias("evidence"), F.col("score").cast("double").alias("score"))
        at = F.when(F.col("path").isNotNull(), F.array(R.location(F.col("path"), F.col("line")))).otherwise(F.array().cast(f"array<{LOCATION}>"))
        own = F.concat_ws("\x1f", "message", "evidence")
        return made.select(
            *[F.lit(v).alias(n) for n, v in (("rule_id", self.id), ("family", self.family), ("severity", self.severity), ("scope", self.scope))], "message", "evidence", "score", at.alias("locations"), "path",
            R.order(_PHASE[self.scope], F.coalesce("path", F.lit("")), place, own, F.col("line")).alias("ord"),
        ).select(*FINDING_COLUMNS)


@dataclass(frozen=True)
class ReporterPlugin:
    id: str
    render: Callable[[dict[str, Any]], str]


class Registry:
    """Plugins in the order in which they were registered; of reporters of one id the last counts."""

    def __init__(self) -> None:
        self.languages: list[LanguagePlugin] = []
        self.providers: list[FactProvider] = []
        self.rules: list[RulePlugin] = []
        self.reporters: dict[str, ReporterPlugin] = {}

    def register(self, plugin: LanguagePlugin | FactProvider | RulePlugin | ReporterPlugin) -> Registry:
        if isinstance(plugin, ReporterPlugin):
            self.reporters[plugin.id] = plugin
        else:
            {LanguagePlugin: self.languages, FactProvider: self.providers, RulePlugin: self.rules}[type(plugin)].append(plugin)
        return self

    def language_table(self) -> dict[str, list[str]]:
        """Language -> extensions; an extension belongs to the first language that has it."""
        out: dict[str, list[str]] = {}
        for p in self.languages:
            out.setdefault(p.id, []).extend(e.lower().lstrip(".") for e in p.extensions)
        return out

    def detect_language(self, path: str) -> str | None:
        name = path.rsplit("/", 1)[-1]
        own = name[name.rfind(".") + 1 :].lower() if "." in name else None
        return next((p.id for p in self.languages if own in [e.lower().lstrip(".") for e in p.extensions]), None)

    def reporter(self, id: str) -> ReporterPlugin:
        if id not in self.reporters:
            raise ValueError(f"Unknown reporter: {id}")
        return self.reporters[id]

    def added_rules(self) -> list[RulePlugin]:
        return [r for r in self.rules if r.id not in R.RULES_META]

    def ordered_providers(self) -> list[FactProvider]:
        """Added providers, each after those whose facts it requires; an error if some can't be met."""
        known, rest, out = {*FILE_FACTS, *PHP_FACTS}, [p for p in self.providers if p.id != "php.structure"], []
        while rest:
            ready = [p for p in rest if set(p.requires) <= known]
            if not ready:
                raise ValueError("Fact providers can't be ordered: " + ", ".join(p.id for p in rest))
            out += ready
            known |= {f for p in ready for f in p.provides}
            rest = [p for p in rest if p not in ready]
        for rule in self.added_rules():
            if missing := set(rule.requires) - known:
                raise ValueError(f"Rule {rule.id} requires unknown facts: {', '.join(sorted(missing))}")
        return out


def default_registry() -> Registry:
    """The built-in languages, the provider of PHP facts, the 27 rules and six reporters."""
    from .operators import facts

    out = Registry()
    for name, ends in files.LANGUAGES.items():
        out.register(LanguagePlugin(name, tuple(ends)))
    out.register(FactProvider("php.structure", PHP_FACTS, facts.extract, ("text",)))
    for name, (family, severity, scope) in R.RULES_META.items():
        out.register(RulePlugin(name, family, severity, scope, lambda full, o, name=name: R.evaluate(full, {name: o})))
    for kind in ("json", "toon", "ndjson", "github", "lint", "text"):
        out.register(ReporterPlugin(kind, lambda report, kind=kind: reports.render(report, kind)))
    return out
