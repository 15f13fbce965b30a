"""Configuration: files, defaults and merging. Small and driver-side."""

from __future__ import annotations

import copy
import json
import os
from dataclasses import dataclass, field
from typing import Any

DEFAULT_IGNORES = ["**/vendor/**", "**/.git/**", "**/node_modules/**", "**/dist/**", "**/coverage/**", "**/*.generated.*"]
FILE_NAMES = ("quality-scan.config.json", "repo-quality.config.json")


class ConfigError(ValueError):
    pass


@dataclass
class Scan:
    cache_file: str | None = None
    baseline_file: str | None = None
    rules: list[str] = field(default_factory=list)
    path_filters: list[str] = field(default_factory=list)
    max_findings: int | None = None
    min_score: float | None = None


@dataclass
class Config:
    ignores: list[str] = field(default_factory=lambda: list(DEFAULT_IGNORES))
    rules: dict[str, dict[str, Any]] = field(default_factory=dict)
    thresholds: dict[str, Any] = field(default_factory=dict)
    overrides: list[dict[str, Any]] = field(default_factory=list)
    ignore_errors: list[Any] = field(default_factory=list)
    scan: Scan = field(default_factory=Scan)


def _deep(base: Any, over: Any) -> Any:
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: _deep(base[k], over[k]) if k in base and k in over else copy.deepcopy(over.get(k, base.get(k))) for k in {**base, **over}}
    return copy.deepcopy(over)


def _strings(x: Any) -> list[str]:
    return [v for v in x if isinstance(v, str) and v] if isinstance(x, list) else [x] if isinstance(x, str) and x else []


def merge(data: dict[str, Any], base: Config | None = None) -> Config:
    """Lists are replaced, rules merged in depth, thresholds at the top level, scan options key by key with coercion."""
    out = copy.deepcopy(base or Config())
    if isinstance(data.get("ignores"), list):
        out.ignores = _strings(data["ignores"])
    if isinstance(data.get("rules"), dict):
        out.rules = _deep(out.rules, data["rules"])
    if isinstance(data.get("thresholds"), dict):
        out.thresholds = {**out.thresholds, **data["thresholds"]}
    if isinstance(data.get("overrides"), list):
        out.overrides = copy.deepcopy(data["overrides"])
    if isinstance(data.get("ignoreErrors"), list):
        out.ignore_errors = copy.deepcopy(data["ignoreErrors"])
    scan = data.get("scan")
    if isinstance(scan, dict):
        for key, name in (("cacheFile", "cache_file"), ("baselineFile", "baseline_file")):
            if key in scan:
                setattr(out.scan, name, scan[key] if isinstance(scan[key], str) and scan[key] else None)
        for key, name in (("rules", "rules"), ("pathFilters", "path_filters")):
            if key in scan:
                setattr(out.scan, name, _strings(scan[key]))
        if "maxFindings" in scan:
            out.scan.max_findings = None if scan["maxFindings"] is None else max(0, int(float(scan["maxFindings"])))
        if "minScore" in scan:
            out.scan.min_score = None if scan["minScore"] is None else float(scan["minScore"])
    return out


def load(root: str, path: str | None = None, names: tuple[str, ...] = FILE_NAMES) -> Config:
    """An explicit file (absolute, or relative to the root; it must exist), else the first default file there is, else defaults."""
    if path:
        found = path if os.path.isabs(path) else os.path.join(root, path)
        if not os.path.isfile(found):
            raise ConfigError(f"Config file not found: {path}")
    else:
        found = next((p for n in names if os.path.isfile(p := os.path.join(root, n))), None)
        if found is None:
            return Config()
    try:
        with open(found, encoding="utf-8") as f:
            data = json.load(f)
    except json.JSONDecodeError as e:
        raise ConfigError(f"Invalid JSON in {found}: {e}") from None
    if not isinstance(data, dict):
        raise ConfigError(f"Config must be an object: {found}")
    return merge(data)
