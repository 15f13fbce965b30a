"""Reports: assembling, reading, and the six encoders. Large findings are written by executors, reports by the driver."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import VERSION, with_occurrences
from ..schema import LOCATION, OCCURRENCE
from . import toon
from .metadata import with_metadata

TOOL, TOOL_VERSION = "gritsieve", "0.1.0"


class ReportError(ValueError):
    pass


def json_text(value: Any, pretty: bool = False) -> str:
    """JSON as findings are hashed and written: unescaped slashes, escaped non-ASCII."""
    return json.dumps(value, indent=4) if pretty else json.dumps(value, separators=(",", ":"))


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings with the names and order of report fields."""
    full = with_metadata(with_occurrences(findings))
    return full.select(
        F.col("rule_id").alias("ruleId"), "family", "severity", "scope", "message", "why", F.col("suggested_action").alias("suggestedAction"), "confidence", "evidence", "score", "locations", "path",
        F.struct(F.lit(VERSION).alias("fingerprintVersion"), "occurrences").alias("deltaIdentity"), "ord",
    )


def assemble(root: str, config: dict[str, Any], summary: dict[str, Any], findings: list[dict[str, Any]], files: list[dict], directories: list[dict], file_scores: list[dict], directory_scores: list[dict]) -> dict[str, Any]:
    metadata = {"schemaVersion": 1, "tool": {"name": TOOL, "version": TOOL_VERSION}, "configHash": hashlib.sha256(json_text(config).encode()).hexdigest(), "findingFingerprintVersion": VERSION, "plugins": []}
    return {"metadata": metadata, "rootDir": root, "config": config, "summary": summary, "files": files, "directories": directories, "findings": findings, "fileScores": file_scores, "directoryScores": directory_scores}


# -- encoders over DataFrames


def ndjson_lines(findings: DataFrame) -> DataFrame:
    """(value) one JSON line for each finding, for ``write.text``."""
    return report_rows(findings).select(F.to_json(F.struct(F.lit("finding").alias("type"), F.struct("ruleId", "family", "severity", "scope", "message", "why", "suggestedAction", "confidence", "evidence", "score", "locations", "path", "deltaIdentity").alias("finding")), {"ignoreNullFields": "false"}).alias("value"), "ord")


def lint_text() -> Column:
    """``severity  message  rule`` and at most three places."""
    at = F.transform(F.slice("locations", 1, 3), lambda x: F.concat(F.lit("\n  at "), x["path"], F.lit(":"), x["line"].cast("string"), F.lit(":"), F.coalesce(x["column"], F.lit(1)).cast("string")))
    return F.concat("severity", F.lit("  "), "message", F.lit("  "), "rule_id", F.concat_ws("", at))


def lint_lines(findings: DataFrame) -> DataFrame:
    return findings.select(lint_text().alias("value"), "ord")


_ESCAPES = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C"), ("{", "%7B"), ("}", "%7D")]


def escape(c: Column) -> Column:
    for a, b in _ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotations(findings: DataFrame) -> DataFrame:
    """(value) one workflow error for each place."""
    none = F.array(F.struct(F.coalesce("path", F.lit("")).alias("path"), F.lit(1).alias("line"), F.lit(1).alias("column")))
    each = findings.select("message", "rule_id", "ord", F.posexplode(F.when(F.size("locations") > 0, F.col("locations")).otherwise(none)).alias("at", "l"))
    file = F.when(F.col("l.path") != "", F.concat(F.lit("file="), escape(F.col("l.path")), F.lit(","))).otherwise("")
    value = F.concat(F.lit("::error "), file, F.lit("line="), F.col("l.line").cast("string"), F.lit(",col="), F.coalesce("l.column", F.lit(1)).cast("string"), F.lit("::"), escape(F.concat("message", F.lit(" ("), "rule_id", F.lit(")"))))
    return each.select(value.alias("value"), "ord", "at")


# -- driver-side rendering of one report


def text_report(report: dict[str, Any], title: str = TOOL + " report") -> str:
    s = report["summary"]
    return "\n".join([
        title, f"root: {report['rootDir']}", f"files scanned: {s['fileCount']}", f"directories scanned: {s['directoryCount']}", f"physical LOC: {s['physicalLineCount']}",
        f"logical LOC: {s['logicalLineCount']}", f"functions: {s['functionCount']}", "", "Raw totals:", f"- findings: {s['findingCount']}", f"- repo score: {s['repoScore']:.2f}",
    ])


def ndjson_report(report: dict[str, Any]) -> str:
    head = {"type": "summary", "metadata": report.get("metadata", {}), "rootDir": report.get("rootDir"), "summary": report.get("summary", {})}
    return "\n".join([json_text(head), *[json_text({"type": "finding", "finding": f}) for f in report.get("findings", [])]])


def new_ndjson_report(findings: list[dict[str, Any]], delta: dict[str, int]) -> str:
    """The findings that are new against a baseline."""
    head = {"type": "summary", "summary": {"findingCount": len(findings), "label": "new findings", "delta": delta}}
    return "\n".join([json_text(head), *[json_text({"type": "finding", "finding": f}) for f in findings]])


def with_delta(report: dict[str, Any], delta: dict[str, Any]) -> dict[str, Any]:
    """A report with its changes against a baseline; a new finding is told for each of its added places."""
    return report | {"baseline": delta, "newFindings": [c["finding"] for c in delta["changes"] if c["status"] == "added"]}


def lint_report(findings: list[dict[str, Any]], label: str = "findings") -> str:
    if not findings:
        return f"0 {label}"
    lines = []
    for f in findings:
        lines.append(f"{f['severity']}  {f['message']}  {f['ruleId']}")
        lines += [f"  at {x['path']}:{x['line']}:{x.get('column') or 1}" for x in f["locations"][:3]] + [""]
    return "\n".join([*lines, f"{len(findings)} {label.rstrip('s') if len(findings) == 1 else label}"])


def github_report(findings: list[dict[str, Any]]) -> str:
    def esc(s: str) -> str:
        for a, b in _ESCAPES:
            s = s.replace(a, b)
        return s

    out = []
    for f in findings:
        for x in f["locations"] or [{"path": f.get("path") or "", "line": 1, "column": 1}]:
            file = f"file={esc(x['path'])}," if x["path"] else ""
            out.append(f"::error {file}line={x['line']},col={x.get('column') or 1}::{esc(f['message'] + ' (' + f['ruleId'] + ')')}")
    return "\n".join(out)


def reporter(json: bool = False, toon: bool = False, ndjson: bool = False, github: bool = False, lint: bool = False) -> str:
    """The first that is asked for, else text."""
    return next((n for n, on in (("json", json), ("toon", toon), ("ndjson", ndjson), ("github", github), ("lint", lint)) if on), "text")


def render(report: dict[str, Any], kind: str) -> str:
    findings = report.get("findings", [])
    return {"json": lambda: json_text(report, True), "toon": lambda: toon.encode(report), "ndjson": lambda: ndjson_report(report), "github": lambda: github_report(findings), "lint": lambda: lint_report(findings), "text": lambda: text_report(report)}[kind]()


def delta_report(changes: list[dict[str, Any]], title: str = TOOL + " delta") -> str:
    count = {s: sum(c["status"] == s for c in changes) for s in ("added", "resolved")}
    return "\n".join([title, f"added: {count['added']}", f"resolved: {count['resolved']}", *[f"{c['status']} {c['finding'].get('ruleId') or '<unknown>'}" for c in changes]])


def stats_report(stats: dict[str, Any]) -> str:
    s = stats["summary"]
    lines = [TOOL + " stats", f"findings: {s['findingCount']}", f"unique rules: {s['uniqueRules']}", f"unique paths: {s['uniquePaths']}", f"report kind: {s['reportKind']}", "", "top rules:"]
    lines += [f"- {r['ruleId']}: {r['findingCount']} findings, {r['locationCount']} locations" for r in stats["topRules"]]
    return "\n".join([*lines, "", "top files:", *[f"- {f['path']}: {f['findingCount']} findings" for f in stats["topFiles"]]])


# -- files


def read_report(path: str) -> dict[str, Any]:
    """A JSON report, or a TOON one by extension; it must be an object."""
    if not os.path.isfile(path):
        raise ReportError(f"Report not found: {path}")
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        data = toon.decode(raw) if path.lower().endswith(".toon") else json.loads(raw)
    except (ValueError, IndexError) as e:
        raise ReportError(f"Invalid report {path}: {e}") from None
    if not isinstance(data, dict):
        raise ReportError(f"Invalid report: {path}")
    return data


def read_baseline(path: str) -> dict[str, Any]:
    data = read_report(path)
    if not isinstance(data.get("findings"), list):
        raise ReportError(f"Baseline has no findings: {path}")
    return data


def baseline(report: dict[str, Any]) -> dict[str, Any]:
    return {"metadata": {**report["metadata"], "kind": "baseline"}, "summary": {"findingCount": len(report["findings"])}, "findings": report["findings"]}


def write_report(path: str, report: dict[str, Any]) -> None:
    folder = os.path.dirname(path) or "."
    if not os.path.isdir(folder):
        raise ReportError(f"Directory not found: {folder}")
    with open(path, "w", encoding="utf-8") as f:
        f.write((toon.encode(report) if path.lower().endswith(".toon") else json_text(report, True)) + "\n")


_REPORT_FINDING = f"ruleId string, family string, severity string, scope string, message string, evidence array<string>, score double, locations array<{LOCATION}>, path string, deltaIdentity struct<fingerprintVersion: int, occurrences: array<{OCCURRENCE}>>"


def findings_of(spark: SparkSession, report: dict[str, Any]) -> DataFrame:
    """A report's findings as a table; ``ord`` follows their order."""
    rows = []
    for i, f in enumerate(report.get("findings") or []):
        if not isinstance(f, dict):
            continue
        where = [(str(x.get("path", "")), int(x.get("line", 1)), int(x.get("column") or 1)) for x in f.get("locations") or [] if isinstance(x, dict)]
        rows.append((f.get("ruleId"), f.get("family"), f.get("severity"), f.get("scope"), f.get("message"), [str(e) for e in f.get("evidence") or []], float(f.get("score") or 0), where, f.get("path"), (0, "", 0, None, i, 0)))
    from ..schema import FINDING, of

    return spark.createDataFrame(rows, of(FINDING))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Findings of NDJSON reports of any size, read by executors with an explicit schema."""
    raw = spark.read.schema(f"type string, finding struct<{_REPORT_FINDING.replace(' string', ': string').replace(' double', ': double').replace(' array', ': array').replace(' struct', ': struct')}>").json(path)
    f = raw.where("type = 'finding'").select("finding.*")
    order = F.struct(F.lit(0).alias("phase"), F.coalesce("path", F.lit("")).alias("unit"), F.lit(0).alias("rule"), F.col("ruleId").alias("key"), F.coalesce(F.get("locations", 0)["line"], F.lit(0)).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    return f.select(F.col("ruleId").alias("rule_id"), "family", "severity", "scope", "message", "evidence", "score", "locations", "path", order.alias("ord"))
