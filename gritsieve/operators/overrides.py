"""Rule configuration for a path: defaults, configured rules, then path overrides in order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import globs


@dataclass
class RuleConfig:
    enabled: bool = True
    weight: float = 1.0
    options: dict[str, Any] = field(default_factory=dict)


def _apply(base: RuleConfig, data: dict[str, Any]) -> RuleConfig:
    own, options = data.get("options"), base.options
    if "options" in data:  # objects are merged; anything else replaces, and rules then use their defaults
        options = {**base.options, **own} if isinstance(own, dict) else {}
    return RuleConfig(bool(data["enabled"]) if "enabled" in data else base.enabled, float(data["weight"]) if "weight" in data else base.weight, options)


def patterns(override: dict[str, Any]) -> list[str]:
    out = [override.get("path"), *(override["paths"] if isinstance(override.get("paths"), list) else [])]
    return [p for p in out if isinstance(p, str) and p]


def variant(path: Column, overrides: list[dict[str, Any]]) -> Column:
    """Which overrides match a path, as a string of 0 and 1; folded into one native expression."""
    marks = [F.when(globs.matches(path, patterns(o)), "1").otherwise("0") for o in overrides]
    return F.concat(*marks) if marks else F.lit("")


def resolve(rule: str, rules: dict[str, Any], overrides: list[dict[str, Any]] = (), key: str = "") -> RuleConfig:
    """The configuration of a rule where the overrides of ``key`` apply."""
    out = _apply(RuleConfig(), rules[rule]) if isinstance(rules.get(rule), dict) else RuleConfig()
    for o, mark in zip(overrides, key, strict=False):
        own = (o.get("rules") or {}).get(rule)
        if mark == "1" and isinstance(own, dict):
            out = _apply(out, own)
    return out


def path_key(path: str, overrides: list[dict[str, Any]]) -> str:
    """The same as :func:`variant` for one path."""
    return "".join("1" if any(re.search(globs.to_regex(p), path.replace("\\", "/")) for p in patterns(o)) else "0" for o in overrides)
