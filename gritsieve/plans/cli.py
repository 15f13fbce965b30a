"""Commands: scan, delta, stats."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from ..operators import findings, identity
from ..plugins import default_registry
from ..sources import cache, reports
from ..sources.config import Config, load
from .analyze import Analysis, analyze_tree


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gritsieve")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("path", nargs="?", default=".")
    for flag in ("json", "toon", "ndjson", "lint", "github"):
        scan.add_argument("--" + flag, action="store_true")
    for name in ("ignore", "rule", "path-filter"):
        scan.add_argument("--" + name, action="append", default=[])
    scan.add_argument("--max-findings", type=int)
    scan.add_argument("--min-score", type=float)
    for name in ("config-file", "cache-file", "baseline-file"):
        scan.add_argument("--" + name)
    scan.add_argument("--generate-baseline", action="store_true")
    delta = sub.add_parser("delta")
    delta.add_argument("base_path", nargs="?")
    delta.add_argument("head_path", nargs="?", default=".")
    delta.add_argument("--json", action="store_true")
    delta.add_argument("--ignore", action="append", default=[])
    for name in ("base", "head", "base-config-file", "head-config-file", "base-report", "head-report", "fail-on"):
        delta.add_argument("--" + name)
    stats = sub.add_parser("stats")
    stats.add_argument("path", nargs="?", default=".")
    stats.add_argument("--report")
    stats.add_argument("--json", action="store_true")
    stats.add_argument("--config-file")
    stats.add_argument("--ignore", action="append", default=[])
    stats.add_argument("--top-rules", type=int, default=10)
    stats.add_argument("--top-files", type=int, default=10)
    return p


def _config(root: str, path: str | None, ignore: list[str]) -> Config:
    config = load(root, path)
    config.ignores = [*config.ignores, *ignore]
    return config


def _analysis(spark: SparkSession, root: str, config: Config, cache_file: str | None = None) -> Analysis:
    """With the cache that is named, else the configured one, else the default one."""
    below = config.scan.cache_file
    return analyze_tree(spark, root, config, cache_file or (os.path.join(root, below) if below else os.path.join(root, cache.DEFAULT_NAME)))


def _delta_of(spark: SparkSession, base: dict, head: dict) -> dict:
    """The changes between two reports, each with its finding."""
    told = [{o["fingerprint"]: f for f in r.get("findings") or [] for o in (f.get("deltaIdentity") or {}).get("occurrences") or []} for r in (head, base)]
    rows = identity.delta(reports.findings_of(spark, base), reports.findings_of(spark, head)).select("status", "fingerprint").orderBy("fingerprint").collect()
    changes = [{"status": r["status"], "fingerprint": r["fingerprint"], "finding": told[r["status"] == "resolved"].get(r["fingerprint"], {})} for r in rows]
    return {"summary": {s: sum(c["status"] == s for c in changes) for s in ("added", "resolved")}, "changes": changes}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gritsieve").getOrCreate()
    try:
        return {"scan": _scan, "delta": _delta, "stats": _stats}[a.command](spark, a)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


def _scan(spark: SparkSession, a: argparse.Namespace) -> int:
    config = _config(a.path, a.config_file, a.ignore)
    s = config.scan
    s.rules, s.path_filters = a.rule or s.rules, a.path_filter or s.path_filters
    s.max_findings = s.max_findings if a.max_findings is None else max(0, a.max_findings)
    s.min_score = s.min_score if a.min_score is None else a.min_score
    against = a.baseline_file or (s.baseline_file and os.path.join(a.path, s.baseline_file))
    if a.generate_baseline and not against:
        raise ValueError("Missing --baseline-file for --generate-baseline.")
    kind = reports.reporter(a.json, a.toon, a.ndjson, a.github, a.lint)
    done = _analysis(spark, a.path, config, a.cache_file)
    try:
        report = done.report()
    finally:
        done.release()
    if a.generate_baseline:
        reports.write_report(against, reports.baseline(report))
        print(f"{reports.TOOL} baseline written to {against}")
        return 0
    if not against:
        print(default_registry().reporter(kind).render(report))
        return 0
    delta = _delta_of(spark, reports.read_baseline(against), report)
    added = {c["fingerprint"] for c in delta["changes"] if c["status"] == "added"}
    new = [f for f in report["findings"] if added & {o["fingerprint"] for o in f["deltaIdentity"]["occurrences"]}]
    print({
        "json": lambda: reports.render(reports.with_delta(report, delta), kind), "toon": lambda: reports.render(reports.with_delta(report, delta), kind),
        "ndjson": lambda: reports.new_ndjson_report(new, delta["summary"]), "github": lambda: reports.github_report(new), "lint": lambda: reports.lint_report(new, "new findings"),
        "text": lambda: reports.delta_report(delta["changes"]),
    }[kind]())
    return int(delta["summary"]["added"] > 0)


def _side(spark: SparkSession, report: str | None, path: str | None, config_file: str | None, ignore: list[str]) -> dict:
    if report:
        return reports.read_report(report)
    if not path:
        raise ValueError("Missing delta input.")
    done = _analysis(spark, path, _config(path, config_file, ignore))
    try:
        return done.whole_report()
    finally:
        done.release()


def _delta(spark: SparkSession, a: argparse.Namespace) -> int:
    base = _side(spark, a.base_report, a.base or a.base_path, a.base_config_file, a.ignore)
    head = _side(spark, a.head_report, a.head or a.head_path, a.head_config_file, a.ignore)
    delta = _delta_of(spark, base, head)
    print(reports.json_text(delta, True) if a.json else reports.delta_report(delta["changes"]))
    on = [x.strip() for x in (a.fail_on or "").split(",") if x.strip()]
    return int(bool(on) and any("any" in on or c["status"] in on for c in delta["changes"]))


def _stats(spark: SparkSession, a: argparse.Namespace) -> int:
    data = _side(spark, a.report, a.path, a.config_file, a.ignore)
    found = reports.findings_of(spark, data)
    s = findings.stats_summary(found).first()
    own, metadata = data.get("summary"), data.get("metadata")
    stats = {
        "summary": {
            "findingCount": s["finding_count"], "uniqueRules": s["unique_rules"], "uniquePaths": s["unique_paths"], "reportKind": (metadata if isinstance(metadata, dict) else {}).get("kind") or "scan",
            "reportFindingCount": int((own if isinstance(own, dict) else {}).get("findingCount", s["finding_count"]) or 0),
        },
        "topRules": [{"ruleId": r["rule_id"], "findingCount": r["finding_count"], "locationCount": r["location_count"]} for r in findings.top_rules(found, max(1, a.top_rules)).collect()],
        "topFiles": [{"path": r["path"], "findingCount": r["finding_count"]} for r in findings.top_files(found, max(1, a.top_files)).collect()],
    }
    print(reports.json_text(stats, True) if a.json else reports.stats_report(stats))
    return 0


if __name__ == "__main__":
    sys.exit(main())
