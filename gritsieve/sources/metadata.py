"""Why a rule matters, what to do, and how sure it is. Two rules have no entry; theirs read null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_H, _M, _L = "high", "medium", "low"
METADATA: dict[str, tuple[str, str, str]] = {
    "php.empty-catch": ("A catch without statements loses the failure.", "Handle it, fall back on purpose, or throw on.", _H),
    "php.exception-wrap-without-previous": ("The new exception drops the first one's trace.", "Hand the caught exception on as previous.", _H),
    "php.error-obscuring-catch": ("A generic replacement hides what failed.", "Keep the type, or pass it as previous.", _H),
    "php.error-swallowing": ("Work goes on after an error that was only printed.", "Stop, fall back on purpose, or throw after logging.", _H),
    "php.blanket-static-analysis-suppressions": ("A broad suppression also hides other problems.", "Name the identifier and the reason.", _M),
    "php.excessive-static-analysis-suppressions": ("So many suppressions point to a type problem.", "Group them by cause; fix the largest group.", _M),
    "php.stacked-static-analysis-suppressions": ("A stack of suppressions marks code that resists repair.", "Rework the site or keep one precise suppression.", _H),
    "php.commented-out-code": ("Disabled code leaves open which path counts.", "Delete it, or keep the intent as prose.", _M),
    "php.catch-default-fallbacks": ("A default from a catch looks like a result.", "Make the error path explicit.", _H),
    "php.catch-returns-exception-message": ("Exception text as data blurs success and failure.", "Map the failure to a typed result.", _H),
    "php.generic-status-envelopes": ("A boolean envelope says little about the outcome.", "Return a domain result or a typed response.", _M),
    "php.generic-array-casts": ("A vague array loses its structure at the boundary.", "Decode into a typed object or check the shape.", _M),
    "php.debug-output": ("Forgotten debug output can leak state.", "Remove it, log, or assert.", _H),
    "php.mock-heavy-tests-without-assertions": ("Setup without assertions tests no behaviour.", "Assert what can be observed.", _M),
    "php.misleading-phpdoc-types": ("Documentation that differs from the signature misleads.", "Keep only what the signature lacks.", _M),
    "php.placeholder-comments": ("A placeholder marks unfinished work.", "Finish it or track it elsewhere.", _M),
    "php.pass-through-wrappers": ("A thin wrapper adds a step and no meaning.", "Inline it, or give it behaviour.", _M),
    "php.directory-fanout-hotspot": ("A crowded directory is hard to review.", "See whether it wants groups.", _L),
    "php.over-fragmentation": ("Many tiny files scatter simple behaviour.", "Merge fragments that separate nothing.", _L),
    "php.duplicate-function-signatures": ("Repeated signatures may be copied design.", "Decide whether they share a contract.", _L),
    "php.return-constant-stub": ("A lone constant return may be a stub.", "Confirm it or implement it.", _M),
    "php.placeholder-method-bodies": ("An empty method may be forgotten work.", "Implement it or make it abstract.", _H),
    "php.clone-cluster": ("Equal bodies often come from copying.", "Move the logic into one place.", _M),
    "php.type-escape-hotspots": ("Mixed types and casts gather where types rub.", "Tighten the contract or isolate the conversion.", _M),
    "markdown.low-signal": ("Process prose without anchors adds review noise.", "Add references, fold it in, or delete it.", _M),
}


def with_metadata(findings: DataFrame) -> DataFrame:
    """``why``, ``suggested_action`` and ``confidence`` by rule; null for rules without an entry."""
    spark: SparkSession = findings.sparkSession
    table = spark.createDataFrame([(r, *m) for r, m in METADATA.items()], "rule_id string, why string, suggested_action string, confidence string")
    return findings.join(F.broadcast(table), "rule_id", "left")  # 25 rows
