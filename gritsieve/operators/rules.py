"""The 27 rules. File rules over facts are array expressions, so one scan of the facts serves them all; the others group.

A rule takes the facts (or what it groups) and its options and gives findings. ``ord`` is the order of emission.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.php_facts import normalized_number
from ..schema import FINDING_COLUMNS, LOCATION

Options = dict[str, Any]


def _empty() -> Column:
    return F.lit(None).cast("string")


def _path() -> Column:
    return F.col("path")


def location(path: Column, line: Column | int, column: Column | int = 1) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(path.alias("path"), as_col(line).cast("int").alias("line"), as_col(column).cast("int").alias("column"))


def order(phase: int, unit: Column, rule: int, key: Column | None = None, a: Column | int = 0, b: Column | int = 0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(phase).alias("phase"), unit.alias("unit"), F.lit(rule).alias("rule"), (_empty() if key is None else key).alias("key"), as_col(a).cast("bigint").alias("a"), as_col(b).cast("bigint").alias("b")
    )


def evidence(*items: Column | str) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])


def tagged(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value.cast("string"))


def finding(rule: str, message: Column | str, found: Column, score: Column | float, locations: Column, path: Column, emitted: Column) -> Column:
    r = RULES_META[rule]
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(r[0]).alias("family"), F.lit(r[1]).alias("severity"), F.lit(r[2]).alias("scope"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"), found.alias("evidence"),
        (F.lit(float(score)) if isinstance(score, (int, float)) else score.cast("double")).alias("score"), locations.alias("locations"), path.alias("path"), emitted.alias("ord"),
    )


#: id -> (family, severity, scope of findings), in order of registration.
RULES_META: dict[str, tuple[str, str, str]] = {
    "php.empty-catch": ("error-handling", "medium", "file"),
    "php.exception-wrap-without-previous": ("error-handling", "medium", "file"),
    "php.error-obscuring-catch": ("error-handling", "medium", "file"),
    "php.error-swallowing": ("error-handling", "medium", "file"),
    "php.blanket-static-analysis-suppressions": ("static-analysis", "weak", "file"),
    "php.excessive-static-analysis-suppressions": ("static-analysis", "medium", "file"),
    "php.stacked-static-analysis-suppressions": ("static-analysis", "medium", "file"),
    "php.commented-out-code": ("comments", "weak", "file"),
    "php.catch-default-fallbacks": ("error-handling", "medium", "file"),
    "php.catch-returns-exception-message": ("error-handling", "medium", "file"),
    "php.generic-status-envelopes": ("api", "medium", "file"),
    "php.generic-array-casts": ("type-safety", "medium", "file"),
    "php.debug-output": ("debugging", "medium", "file"),
    "php.mock-heavy-tests-without-assertions": ("tests", "weak", "file"),
    "php.magic-numbers": ("abstraction", "weak", "file"),
    "php.misleading-phpdoc-types": ("documentation", "weak", "file"),
    "php.placeholder-comments": ("comments", "weak", "file"),
    "php.pass-through-wrappers": ("abstraction", "weak", "file"),
    "php.directory-fanout-hotspot": ("structure", "medium", "directory"),
    "php.over-fragmentation": ("structure", "weak", "directory"),
    "php.duplicate-function-signatures": ("duplication", "medium", "repo"),
    "php.duplicate-mock-setup": ("tests", "medium", "file"),
    "php.return-constant-stub": ("abstraction", "weak", "file"),
    "php.placeholder-method-bodies": ("abstraction", "weak", "file"),
    "php.clone-cluster": ("duplication", "medium", "repo"),
    "php.type-escape-hotspots": ("type-safety", "medium", "file"),
    "markdown.low-signal": ("docs", "weak", "file"),
}
INDEX = {name: i for i, name in enumerate(RULES_META)}


def _number(options: Options, name: str, default: float) -> int:
    try:
        return int(float(options.get(name, default)))
    except (TypeError, ValueError):
        return 0


def _each(rule: str, items: Column, keep: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """Findings of the items that are kept, with their places."""
    placed = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(placed, lambda p: F.coalesce(keep(p["x"]), F.lit(False))), lambda p: make(p["x"], p["i"]))


def _one(rule: str, message: Column | str, found: Column, score: Column | float, line: Column, column: Column | int, a: Column, b: Column | int = 0) -> Column:
    return finding(rule, message, found, score, F.array(location(_path(), line, column)), _path(), order(0, _path(), INDEX[rule], None, a, b))


# -- static-analysis comments

_ANY = r"(?i)@(phpstan-ignore(?:-(?:next-)?line)?|psalm-suppress|psalm-ignore-var|phpcsSuppress)(?![A-Za-z0-9_])"
_STAN = r"(?i)@(phpstan-ignore(?:-(?:next-)?line)?)(?![A-Za-z0-9_])([^\r\n]*)"
_IDS = r"[A-Za-z0-9_]+(?:[.\-][A-Za-z0-9_]+)*(?:\s*,\s*[A-Za-z0-9_]+(?:[.\-][A-Za-z0-9_]+)*)*"
_REASON = r"\([^()\r\n]+\)"


def any_suppression(c: Column) -> Column:
    return c.rlike(_ANY)


def blanket(c: Column) -> Column:
    """A static-analysis ignore directive without identifier, or without context for its line forms."""
    body = X.comment_body(c)
    directive, tail = X.ascii_lower(F.regexp_extract(body, _STAN, 1)), X.trim(F.regexp_extract(body, _STAN, 2))
    scoped = tail.rlike(rf"\A{_IDS}(?:\s+{_REASON})?\z")
    context = (tail != "") & (((F.octet_length(tail) > 1) & scoped) | tail.rlike(rf"\A(?:[A-Za-z][A-Za-z0-9 _.,:\-]+|{_REASON})\z"))
    return F.when(directive == "", False).when(directive == "phpstan-ignore", ~scoped).otherwise(~context)


def unexplained(c: Column) -> Column:
    """A suppression that isn't both scoped and explained in parentheses."""
    body = X.comment_body(c)
    tail = X.trim(F.regexp_extract(body, _ANY + r"([^\r\n]*)", 2))
    return body.rlike(_ANY) & ~tail.rlike(rf"\A{_IDS}\s+{_REASON}\z")


_CODE = (
    r"(?i)\A(?:<\?php(?![A-Za-z0-9_])|(?:return|throw|case|try)(?![A-Za-z0-9_])|(?:if|elseif|foreach|for|while|switch|catch)\s*\(|\$[A-Za-z_][A-Za-z0-9_]*(?:\[[^\]]+\])?\s*="
    r"|[A-Za-z_\\][A-Za-z0-9_\\]*\s*\([^)]*\)\s*;|\}\s*else(?![A-Za-z0-9_]))"
)


def commented_code(c: Column) -> Column:
    body = X.comment_body(c)
    return body.rlike(_CODE) & body.rlike("[;{}]")


def placeholder(c: Column) -> Column:
    return c.rlike(rf"(?i){X.EDGE_L}(?:todo|fixme|hack|placeholder|temporary|generated by ai){X.EDGE_R}")


def _comment_rule(rule: str, keep: Callable[[Column], Column], message: str, score: float) -> Column:
    return _each(rule, F.col("comments"), lambda c: keep(c["text"]), lambda c, i: _one(rule, message, evidence(X.trim(c["text"])), score, c["line"], 1, i))


def _excessive(o: Options) -> Column:
    rule, limit = "php.excessive-static-analysis-suppressions", max(1, _number(o, "commentCount", 3))
    own = F.filter("comments", lambda c: unexplained(c["text"]))
    n = F.size(own)
    lines = F.concat_ws(",", F.transform(F.slice(own, 1, 8), lambda c: c["line"].cast("string")))
    made = _one(rule, "Found excessive static-analysis suppression comments in one PHP file", evidence(tagged("suppressions", n), f"threshold={limit}", tagged("lines", lines)), F.least(F.lit(3.0), 0.5 * n), own[0]["line"], 1, F.lit(0))
    return F.when(n > limit, F.array(made)).otherwise(F.array().cast(f"array<{_FINDING_TYPE}>"))


_FINDING_TYPE = f"struct<rule_id: string, family: string, severity: string, scope: string, message: string, evidence: array<string>, score: double, locations: array<{LOCATION}>, path: string, ord: struct<phase: int, unit: string, rule: int, key: string, a: bigint, b: bigint>>"


def _when(cond: Column, made: Column) -> Column:
    return F.when(cond, F.array(made)).otherwise(F.array().cast(f"array<{_FINDING_TYPE}>"))


# -- PHPDoc

_EXTRA = rf"{X.EDGE_L}(?:array-key|callable-string|class-string|closed-resource|int-mask|key-of|list|literal-string|negative-int|non-empty-array|non-empty-string|numeric-string|positive-int|resource|scalar|trait-string|value-of){X.EDGE_R}"


def canonical_type(c: Column) -> Column:
    t = X.trim(X.ascii_lower(c))
    t = F.when(t.startswith("?"), F.concat(F.lit("null|"), F.substring(t, 2, 1 << 20))).otherwise(t)
    parts = F.filter(F.transform(F.split(F.replace(t, F.lit(" "), F.lit("")), r"\|", -1), lambda p: F.regexp_replace(X.trim(p), r"\A\\+", "")), lambda p: (p != "") & (p != "0"))
    return F.when(F.array_contains(parts, "mixed"), "mixed").otherwise(F.array_join(F.array_sort(F.array_distinct(parts)), "|"))


def _phpdoc(o: Options) -> Column:
    rule = "php.misleading-phpdoc-types"
    aliases = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"@(?:phpstan|psalm)-(?:type|import-type)\s+([A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9_])"), F.lit(1)))
    flat = F.flatten(F.transform("phpdoc", lambda e, i: F.transform(e["annotations"], lambda a, j: F.struct(e["subject"].alias("subject"), a.alias("a"), i.alias("i"), j.alias("j")))))

    def judge(x: Column) -> Column:
        a = x["a"]
        native, doc = canonical_type(a["native"]), canonical_type(a["doc_type"])
        candidate = X.ascii_lower(X.trim(F.coalesce(F.when(a["extended"] != "", a["extended"]), a["raw"])))
        extra = candidate.rlike(r"[<>{}\[\](),:&]") | candidate.rlike(_EXTRA)
        first = F.regexp_extract(X.trim(a["raw"]), r"\A(\S*)", 1)
        aliased = F.exists(aliases, lambda n: F.regexp_like(first, F.concat(F.lit(r"(?:^|[|&?(<,])\\?"), n, F.lit(r"(?:$|[|&?)>\[\],])"))))
        raw = X.trim(F.regexp_replace(a["raw"], r"\s+", " "))
        rest = F.when(a["tag"] == "@param", F.regexp_extract(raw, r"\A\S+\s+\$[A-Za-z0-9_]+\s+(.+)\z", 1)).otherwise(F.regexp_extract(raw, r"\A\S+\s+(.+)\z", 1))
        usable = a["native"].isNotNull() & a["doc_type"].isNotNull() & (native != "") & (doc != "") & ~extra & ~aliased
        return F.when(usable & (native == doc) & (X.trim(rest) == ""), "redundant").when(usable & (native != doc), "misleading")

    judged = F.filter(F.transform(flat, lambda x: F.struct(x.alias("x"), judge(x).alias("kind"))), lambda y: y["kind"].isNotNull())

    def make(y: Column) -> Column:
        x, a, same = y["x"], y["x"]["a"], y["kind"] == "redundant"
        message = F.when(same, "Found redundant PHPDoc type annotation that repeats the native signature").otherwise("Found misleading PHPDoc type annotation that disagrees with the native signature")
        reason = F.when(same, "phpdoc-repeats-native-type").otherwise("phpdoc-disagrees-with-native-type")
        items = evidence(tagged("subject", x["subject"]), tagged("annotation", a["annotation"]), tagged("native", a["native"]), tagged("phpdoc", a["raw"]), tagged("reason", reason))
        return _one(rule, message, items, F.when(same, 0.75).otherwise(1.5), a["line"], 1, x["i"], x["j"])

    return F.transform(judged, make)


# -- catches and other facts

_SWALLOW = ["echo", "error_log", "print", "trigger_error", "var_dump"]


def _thrown(rule: str, keep: Callable[[Column], Column], message: str, reason: str, score: float) -> Column:
    flat = F.flatten(F.transform("catches", lambda c, i: F.transform(c["thrown"], lambda t, j: F.struct(c["line"].alias("line"), t.alias("t"), i.alias("i"), j.alias("j")))))
    kept = F.filter(flat, lambda x: F.coalesce(keep(x["t"]), F.lit(False)))
    return F.transform(kept, lambda x: _one(rule, message, evidence(tagged("class", x["t"]["class"]), f"reason={reason}"), score, x["line"], 1, x["i"], x["j"]))


def _in_budget(o: Options) -> Column:
    return F.col("logical_line_count") <= max(1, _number(o, "maxFileLines", 5000))


def _caught(o: Options) -> Column:
    rule = "php.catch-returns-exception-message"
    kinds = lambda c: F.transform(c["returned_caught_value_kinds"], lambda k: tagged("return", k))
    first = _each(rule, F.col("catches"), lambda c: F.size(c["returned_caught_value_kinds"]) > 0, lambda c, i: _one(rule, "Found PHP catch block that returns the caught exception as data", kinds(c), 2.0, c["line"], 1, i))
    second = _each(
        rule, F.col("normalizations"), lambda n: ~n["kind"].startswith("returned-"),
        lambda n, i: _one(rule, "Found PHP catch block that flattens the caught exception into generic string data", evidence(tagged("normalization", n["kind"])), 2.0, n["line"], n["column"], 1 << 30, i),
    )
    return F.concat(first, F.when(_in_budget(o), second).otherwise(F.array().cast(f"array<{_FINDING_TYPE}>")))


def _envelopes(o: Options) -> Column:
    rule = "php.generic-status-envelopes"
    items = lambda e: F.concat(evidence(tagged("kind", e["kind"]), F.concat(F.lit("status="), e["key"], F.lit(":"), e["value"])), F.transform(e["payload"], lambda p: tagged("payload", p)))
    return _each(rule, F.col("envelopes"), lambda e: _in_budget(o), lambda e, i: _one(rule, "Found PHP array literal shaped as a generic status envelope", items(e), 2.0, e["line"], e["column"], i))


def _casts(o: Options) -> Column:
    rule = "php.generic-array-casts"
    return _each(rule, F.col("array_casts"), lambda e: _in_budget(o), lambda e, i: _one(rule, "Found generic array conversion assigned to a vague bag variable", evidence(tagged("variable", e["variable"]), tagged("kind", e["kind"])), 2.0, e["line"], e["column"], i))


def _mock_heavy(o: Options) -> Column:
    rule, t, least = "php.mock-heavy-tests-without-assertions", F.col("test_calls"), max(1, _number(o, "mockCount", 2))
    keep = t["looks_like_test"] & (t["tests"] > 0) & (t["mocks"] >= least) & (t["assertions"] == 0) & (t["expectations"] == 0)
    return _when(keep, _one(rule, "Found mock-heavy PHP test file without assertions or mock expectations", evidence(*[tagged(k, t[k]) for k in ("tests", "mocks", "assertions", "expectations")]), 1.25, F.lit(1), 1, F.lit(0)))


def ignored_numbers(o: Options) -> list[str]:
    values = o.get("ignoredValues", [0, 1])
    if not isinstance(values, (list, tuple)):
        values = [0, 1]
    found = [normalized_number(str(v)) for v in values if isinstance(v, (int, float, str)) and not isinstance(v, bool)]
    return list(dict.fromkeys(v for v in found if v is not None))


def _magic(o: Options) -> Column:
    rule, skip = "php.magic-numbers", ignored_numbers(o)
    flat = F.flatten(F.transform("functions", lambda f, i: F.transform(f["magic_numbers"], lambda n, j: F.struct(f["name"].alias("name"), n.alias("n"), i.alias("i"), j.alias("j")))))
    kept = F.filter(flat, lambda x: ~x["n"]["normalized"].isin(skip)) if skip else flat
    return F.transform(kept, lambda x: _one(rule, "Found inline PHP magic number literal", evidence(x["name"], tagged("value", x["n"]["value"]), tagged("kind", x["n"]["kind"])), 0.5, x["n"]["line"], x["n"]["column"], x["i"], x["j"]))


_ACCESSOR = r"(?i)\Aget_[a-z0-9_]+_(?:name|info)\z"


def constant_stub(name: Column, constant: Column, kind: Column, cls: Column, accessors: Column) -> Column:
    """Whether a function that returns a constant is a stub; ``accessors`` counts the metadata accessors of its file."""
    spared = kind.isin("interface", "abstract-class") | ((accessors >= 4) & name.rlike(_ACCESSOR)) | cls.rlike(r"(?i)(?:dummy|stub|fake|mock|test)(?![A-Za-z0-9_])")
    predicate = constant.isin("false", "true") & name.rlike(r"\A(?:is|has|can|supports|should|needs|allows|must|may|was|were)[A-Z0-9_]")
    return constant.isNotNull() & ~constant.isin("empty-array", "null") & ~F.coalesce(spared, F.lit(False)) & ~F.coalesce(predicate, F.lit(False))


def is_accessor(name: Column) -> Column:
    return name.rlike(_ACCESSOR)


def _stub(o: Options) -> Column:
    rule = "php.return-constant-stub"
    accessors = F.size(F.filter("functions", lambda f: is_accessor(f["name"])))
    return _each(
        rule, F.col("functions"), lambda f: constant_stub(f["name"], f["constant_return"], f["class_kind"], f["class_name"], accessors),
        lambda f, i: _one(rule, "Found PHP function whose body is only a constant placeholder return", evidence(f["name"], tagged("return", f["constant_return"])), 1.0, f["line"], 1, i),
    )


def empty_method(name: Column, kind: Column, body: Column) -> Column:
    return (kind == "class") & (F.coalesce(body, F.lit("")) == "") & ~name.startswith("__")


def _escapes(o: Options) -> Column:
    rule, t = "php.type-escape-hotspots", F.col("type_escapes")
    total = t["mixed"] + t["casts"]
    return _when((t["mixed"] > 0) & (total >= _number(o, "threshold", 3)), _one(rule, "Found file with concentrated type escape patterns", evidence(tagged("mixed-types", t["mixed"]), tagged("casts", t["casts"]), tagged("total", total)), total, F.lit(1), 1, F.lit(0)))


#: File rules over facts: options -> array of findings.
FACT_RULES: dict[str, Callable[[Options], Column]] = {
    "php.empty-catch": lambda o: _each("php.empty-catch", F.col("catches"), lambda c: c["statement_count"] == 0, lambda c, i: _one("php.empty-catch", "Found empty PHP catch block", evidence("catch block has no statements"), 2.0, c["line"], 1, i)),
    "php.exception-wrap-without-previous": lambda o: _thrown("php.exception-wrap-without-previous", lambda t: ~t["is_generic"] & ~t["preserves_previous"] & t["uses_caught"] & t["class"].isNotNull(), "Found PHP catch block that wraps an exception without preserving previous context", "wraps-caught-exception-without-previous", 2.0),
    "php.error-obscuring-catch": lambda o: _thrown("php.error-obscuring-catch", lambda t: t["is_generic"] & ~t["preserves_previous"], "Found PHP catch block that replaces the original error with a generic exception", "generic-replacement-without-previous", 2.25),
    "php.error-swallowing": lambda o: _each("php.error-swallowing", F.col("catches"), lambda c: swallows(c["call_names"], c["has_throw"], c["has_return"]), lambda c, i: _one("php.error-swallowing", "Found PHP catch block that logs or prints and continues", evidence("catch body logs/prints without throw or return"), 2.0, c["line"], 1, i)),
    "php.blanket-static-analysis-suppressions": lambda o: _comment_rule("php.blanket-static-analysis-suppressions", blanket, "Found blanket PHPStan suppression without an identifier or reason", 0.75),
    "php.excessive-static-analysis-suppressions": _excessive,
    "php.commented-out-code": lambda o: _comment_rule("php.commented-out-code", commented_code, "Found PHP comment that looks like disabled code", 0.75),
    "php.catch-default-fallbacks": lambda o: _each("php.catch-default-fallbacks", F.col("catches"), lambda c: F.size(c["default_return_kinds"]) > 0, lambda c, i: _one("php.catch-default-fallbacks", "Found PHP catch block that returns a default fallback literal", F.transform(c["default_return_kinds"], lambda k: tagged("return", k)), 2.0, c["line"], 1, i)),
    "php.catch-returns-exception-message": _caught,
    "php.generic-status-envelopes": _envelopes,
    "php.generic-array-casts": _casts,
    "php.debug-output": lambda o: _each("php.debug-output", F.col("debug_calls"), lambda c: F.lit(True), lambda c, i: _one("php.debug-output", "Found PHP debug-output call left in source", evidence(c["name"]), 1.25, c["line"], 1, i)),
    "php.mock-heavy-tests-without-assertions": _mock_heavy,
    "php.magic-numbers": _magic,
    "php.misleading-phpdoc-types": _phpdoc,
    "php.placeholder-comments": lambda o: _comment_rule("php.placeholder-comments", placeholder, "Found placeholder-style PHP comment", 0.5),
    "php.pass-through-wrappers": lambda o: _each("php.pass-through-wrappers", F.col("functions"), lambda f: f["pass_through"].isNotNull(), lambda f, i: _one("php.pass-through-wrappers", "Found pass-through PHP wrapper function", evidence(f["name"]), 1.0, f["line"], 1, i)),
    "php.return-constant-stub": _stub,
    "php.placeholder-method-bodies": lambda o: _each("php.placeholder-method-bodies", F.col("functions"), lambda f: empty_method(f["name"], f["class_kind"], f["body"]), lambda f, i: _one("php.placeholder-method-bodies", "Found empty method body in a concrete class", evidence(f["name"]), 1.0, f["line"], 1, i)),
    "php.type-escape-hotspots": _escapes,
}


def swallows(calls: Column, throws: Column, returns: Column) -> Column:
    return F.arrays_overlap(calls, F.array(*[F.lit(c) for c in _SWALLOW])) & ~throws & ~returns


def fact_findings(files: DataFrame, rules: dict[str, Options]) -> DataFrame:
    """Findings of all enabled file rules over facts, from one scan."""
    made = [FACT_RULES[r](o) for r, o in rules.items() if r in FACT_RULES]
    if not made:
        return files.sparkSession.createDataFrame([], _FINDING_TYPE_DDL)
    arrays = [F.coalesce(m, F.array().cast(f"array<{_FINDING_TYPE}>")) for m in made]
    return files.select(F.explode(F.concat(*arrays)).alias("f")).select("f.*")


_FINDING_TYPE_DDL = _FINDING_TYPE.removeprefix("struct<").removesuffix(">")


def stacked(comments: DataFrame, options: Options) -> DataFrame:
    """Runs of suppressions on consecutive lines: (path, pos, line, text) rows -> findings (gaps and islands)."""
    rule, least = "php.stacked-static-analysis-suppressions", max(2, _number(options, "commentCount", 2))
    along = W.partitionBy("path").orderBy("line", "pos")
    marked = comments.withColumn("s", any_suppression(F.col("text")))
    joined = F.lag("s").over(along) & (F.col("line") == F.lag("line").over(along) + 1)
    runs = marked.withColumn("begins", F.when(F.col("s") & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)).withColumn("run", F.sum("begins").over(along))
    grouped = runs.where("s").groupBy("path", "run").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"), F.min("pos").alias("pos")).where(F.col("n") >= least)
    items = evidence(tagged("suppressions", F.col("n")), tagged("lines", F.concat_ws(",", F.transform("lines", lambda x: x.cast("string")))))
    made = _one(rule, "Found stacked static-analysis suppression comments above one PHP code site", items, F.least(F.lit(2.5), 0.75 * F.col("n")), F.col("lines")[0], 1, F.col("pos"))
    return grouped.select(made.alias("f")).select("f.*")


def exploded_comments(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode("comments").alias("pos", "c")).select("path", "pos", "c.line", "c.text")


# -- Markdown

_ARTIFACTS = "analysis checklist implementation notes plan progress report status summary task todo".split()
_SECTIONS = ["summary", "overview", "change", "changes", "implementation", "testing", "validation", "next steps", "follow-up", "note", "notes", "status", "checklist", "plan", "completed work", "remaining work"]
_PROCESS = ["implemented", "updated", "added", "removed", "validated", "completed", "remaining work", "follow-up", "next steps", "this document", "the following changes", "successfully"]
_S, _P = "|".join(_SECTIONS), "|".join(_PROCESS)
_BULLET = r"(?:[\-*+]|[0-9]+\.)\s+"


def line_signals(files: DataFrame) -> DataFrame:
    """Every content line of (path, text) Markdown with its fence state and signals, and fence lines."""
    rows = files.select("path", F.posexplode(X.lines(F.col("text"))).alias("pos", "line")).withColumn("line", X.trim(F.col("line")))
    rows = rows.withColumn("fence", F.col("line").rlike(r"\A(?:```|~~~)"))
    # the lines of one file are one partition of the window; files are many
    inside = F.sum(F.col("fence").cast("int")).over(W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) % 2 == 1
    rows = rows.withColumn("inside", inside & ~F.col("fence"))
    c = F.col("line")
    anchor = (
        c.rlike("`[^`]+`") | c.rlike(r"\[[^\]]+\]\([^)]+\)") | c.rlike(r"(?:^|[\s(])(?:\.{0,2}/)?(?:[A-Za-z0-9_.\-]+/)+[A-Za-z0-9_.\-]+\.[A-Za-z0-9]+(?:[:#][0-9]+)?")
        | c.rlike(r"(?i)(?:^|\s)(?:composer|php|vendor/bin/[A-Za-z0-9_.\-]+|bin/[A-Za-z0-9_.\-]+)(?![A-Za-z0-9_])")
    )
    content = ~F.col("fence") & ~F.col("inside") & (c != "")
    checklist = c.rlike(rf"\A{_BULLET}\[[ xX]\]")
    heading = c.rlike(rf"(?i)\A(?:#+\s*)?(?:{_S})(?![A-Za-z0-9_])")
    boilerplate = heading | c.rlike(rf"(?i)\A{_BULLET}(?:\[[ xX]\]\s*)?(?:{_S})(?![A-Za-z0-9_])") | c.rlike(rf"(?i){X.EDGE_L}(?:{_P}){X.EDGE_R}")
    words = X.word_count(F.regexp_replace(c, r"[^A-Za-z0-9'\-]+", " "))
    return rows.select(
        "path", "pos", "line", "fence", "inside", content.alias("content"), (content & checklist).alias("checklist"), (content & heading).alias("heading"),
        (F.col("fence") | (content & anchor)).alias("anchor"), (content & boilerplate).alias("boilerplate"), (content & ~boilerplate & ~checklist & (words >= 8)).alias("descriptive"),
    )


def low_signal(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Findings for Markdown files dominated by process scaffolding."""
    o, rule = options or {}, "markdown.low-signal"
    least, boiler, anchors = _number(o, "minContentLines", 6), _number(o, "minBoilerplateLines", 4), _number(o, "maxRepoAnchors", 2)
    counted = line_signals(files).groupBy("path").agg(
        *[F.count_if(s).alias(s) for s in ("content", "checklist", "heading", "anchor", "boilerplate", "descriptive")], F.min(F.when(F.col("boilerplate"), F.col("pos") + 1)).alias("first")
    )
    name = X.basename(_path())
    artifact = name.rlike(rf"(?i)(?:^|[\-_.])(?:{'|'.join(_ARTIFACTS)})(?:[\-_.]|$)")
    effective = F.col("boilerplate") + F.when(artifact, 1).otherwise(0)
    kept = counted.where(
        (F.col("content") >= least) & (effective >= boiler) & (F.col("descriptive") < 2) & (F.col("anchor") <= anchors)
        & (artifact | (F.col("heading") >= 2) | (F.col("checklist") >= 2)) & (F.col("anchor") * 2 < effective + 1)
    )
    items = evidence(tagged("filename", name), tagged("boilerplateLines", F.col("boilerplate")), tagged("genericHeadings", F.col("heading")), tagged("checklistLines", F.col("checklist")), tagged("repoAnchors", F.col("anchor")))
    items = F.when(artifact, F.concat(items, evidence("filenamePattern=generic-artifact"))).otherwise(items)
    made = _one(rule, "Found Markdown document dominated by generic process scaffolding with few repo-specific anchors", items, 0.75, F.coalesce("first", F.lit(1)), 1, F.lit(0))
    return kept.select(made.alias("f")).select("f.*")


# -- directories and the repository


def fanout(files: DataFrame, options: Options) -> DataFrame:
    """(path) rows -> directories with more than ``fileCount`` files."""
    rule = "php.directory-fanout-hotspot"
    g = files.groupBy(X.dirname(_path()).alias("d")).agg(F.count("*").alias("n"), F.min("path").alias("first")).where(F.col("n") > _number(options, "fileCount", 12))
    made = finding(rule, "Found high PHP file fanout in one directory", evidence(tagged("fileCount", F.col("n"))), 1.5, F.array(location(F.col("first"), 1)), F.col("d"), order(1, F.col("d"), INDEX[rule]))
    return g.select(made.alias("f")).select("f.*")


def fragmentation(files: DataFrame, options: Options) -> DataFrame:
    """(path, logical_line_count, function_count) rows -> directories of many tiny files."""
    rule = "php.over-fragmentation"
    tiny = F.col("logical_line_count").between(1, 12) & (F.coalesce("function_count", F.lit(0)) <= 1)
    g = files.groupBy(X.dirname(_path()).alias("d")).agg(F.count("*").alias("n"), F.count_if(tiny).alias("small"), F.min("path").alias("first")).where((F.col("small") >= 6) & (F.col("small") * 2 >= F.col("n")))
    made = finding(rule, "Found many tiny PHP files in one directory", evidence(tagged("tinyFiles", F.col("small"))), 1.0, F.array(location(F.col("first"), 1)), F.col("d"), order(1, F.col("d"), INDEX[rule]))
    return g.select(made.alias("f")).select("f.*")


_LIFECYCLE = ["__construct", "__destruct", "_before", "_after", "setup", "teardown"]
_PLACE = "struct<path: string, pos: int, line: int, name: string, namespace_name: string>"


def _places() -> Column:
    return F.array_sort(F.collect_list(F.struct("path", "pos", "line", "name", "namespace_name")))


def flat_functions(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode("functions").alias("pos", "f")).select("path", "pos", "f.*")


def signature_clusters(functions: DataFrame) -> DataFrame:
    """(signature, places, first) of signatures that occur more than once, by partial aggregation: no group is gathered."""
    own = functions.where(~X.ascii_lower(F.col("name")).isin(_LIFECYCLE))
    return own.groupBy("signature").agg(F.count("*").alias("places"), F.min(F.struct("path", "pos", "line")).alias("first")).where("places > 1")


def duplicate_signatures(functions: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, pos, line, name, namespace_name, signature) rows -> signatures that occur more than once, a finding each.

    A finding holds all its places, as a report lists them; :func:`signature_clusters` counts them for groups of any size.
    """
    rule = "php.duplicate-function-signatures"
    own = functions.where(~X.ascii_lower(F.col("name")).isin(_LIFECYCLE))
    g = own.groupBy("signature").agg(_places().alias("at")).where(F.size("at") > 1)
    where = F.transform("at", lambda p: location(p["path"], p["line"]))
    made = finding(rule, "Found duplicated PHP function signatures", evidence(F.col("signature")), 2.0, where, _empty(), order(2, F.lit(""), INDEX[rule], F.col("signature")))
    return g.select(made.alias("f")).select("f.*")


def normalized_body(c: Column) -> Column:
    return F.regexp_replace(X.ascii_lower(X.trim(c)), r"\s+", " ")


def directory_prefix(path: Column, depth: int = 3) -> Column:
    d = X.dirname(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(d, "/"), lambda s: (s != "") & (s != "."))
    return F.concat_ws("/", F.slice(parts, 1, depth))


def _bodies(functions: DataFrame) -> DataFrame:
    return functions.where(~X.ascii_lower(F.col("name")).isin(_LIFECYCLE) & (F.octet_length("body") >= 40)).withColumn("normal", normalized_body(F.col("body")))


def _spread() -> list[Column]:
    """Ends of the namespaces and directory prefixes of a group: it has exactly one of them if they are equal."""
    space, prefix = F.when(F.col("namespace_name") != "", F.col("namespace_name")), directory_prefix(_path())
    return [F.min(space).alias("s0"), F.max(space).alias("s1"), F.min(prefix).alias("p0"), F.max(prefix).alias("p1")]


_SPREADS = "(s0 IS NULL OR s0 <> s1) AND p0 <> p1"


def clone_clusters(functions: DataFrame) -> DataFrame:
    """(normal, places, names, first) of equal bodies across namespaces and directories, by partial aggregation: of a group only its distinct names are gathered."""
    g = _bodies(functions).groupBy("normal").agg(F.count("*").alias("places"), F.sort_array(F.collect_set("name")).alias("names"), F.min(F.struct("path", "pos", "line")).alias("first"), *_spread())
    return g.where(f"places > 1 AND {_SPREADS}").select("normal", "places", "names", "first")


def clones(functions: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, pos, line, name, namespace_name, body) rows -> equal bodies across namespaces and directories, a finding each.

    A finding holds all its places, as a report lists them; :func:`clone_clusters` counts them for groups of any size.
    """
    rule = "php.clone-cluster"
    g = _bodies(functions).groupBy("normal").agg(_places().alias("at"), *_spread()).where(F.size("at") > 1).where(_SPREADS)
    names = F.array_sort(F.array_distinct(F.transform("at", lambda p: p["name"])))
    where = F.transform("at", lambda p: location(p["path"], p["line"]))
    made = finding(rule, "Found near-duplicate PHP function bodies", F.transform(names, lambda n: tagged("name", n)), 2.0, where, _empty(), order(2, F.lit(""), INDEX[rule], F.col("normal")))
    return g.select(made.alias("f")).select("f.*")


def _met(setups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What files share of (path, line, label, fingerprint) rows, without gathering the places of any setup.

    Gives ``each``, a row for every file and setup it shares with two other files or more; ``paths``, the files of these;
    ``spots``, their places by setup; ``places`` with ``k``, the number of a place's setups that most of ``paths`` share; and
    ``pairs`` (q, p, l, k, plus): q has place (p, l) if k is above 0 and there is no pair, or if ``plus``.

    A setup that few files share gives its files times its places, one that most share gives the files that lack it times its
    places; so a setup of all files costs its places once, not once a file.
    """
    rows = setups.where("fingerprint IS NOT NULL").groupBy("fingerprint", "path", "line").agg(F.min("label").alias("label"))
    key = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"))
    own = rows.groupBy("fingerprint", "path").agg(F.min("label").alias("label"), F.min(key).alias("first"))
    met = own.groupBy("fingerprint").agg(F.min("label").alias("label"), F.count("path").alias("files"), F.min("first").alias("first")).where("files >= 3")
    held = own.where("path IS NOT NULL").select("fingerprint", "path")
    each = held.join(met, "fingerprint")
    paths = each.select("path").distinct()
    kinds = met.crossJoin(F.broadcast(paths.agg(F.count("*").alias("n")))).select("fingerprint", (F.col("files") * 2 > F.col("n")).alias("most"))
    spots = rows.join(kinds, "fingerprint").select("fingerprint", "most", F.col("path").alias("p"), F.col("line").alias("l"))
    places = spots.groupBy("p", "l").agg(F.count_if("most").alias("k"))
    few = held.join(kinds.where("NOT most").select("fingerprint"), "fingerprint")
    # a setup of most files has over half of them: these are at most twice as many rows as the files have setups
    lack = paths.crossJoin(F.broadcast(kinds.where("most").select("fingerprint"))).select("fingerprint", "path").join(held, ["fingerprint", "path"], "left_anti")
    marks = few.unionByName(lack).withColumnRenamed("path", "q")
    met_at = spots.join(marks, "fingerprint").groupBy("q", "p", "l").agg(F.count_if(~F.col("most")).alias("has"), F.count_if("most").alias("lacks"))
    at = places.select(F.col("p").alias("p2"), F.col("l").alias("l2"), "k")
    pairs = met_at.join(at, F.col("p").eqNullSafe(F.col("p2")) & F.col("l").eqNullSafe(F.col("l2"))).where("k = 0 OR (has = 0 AND lacks = k)").select("q", "p", "l", "k", (F.col("k") == 0).alias("plus"))
    return each, paths, spots, places, pairs


def _setup_items(each: DataFrame) -> DataFrame:
    """(path, items, score, first) of every file: its evidence and the first of its places."""
    return each.groupBy("path").agg(
        F.array_sort(F.collect_list(F.concat(F.lit("setup="), "label", F.lit("|files="), F.col("files").cast("string")))).alias("items"),
        F.least(F.lit(5.0), F.sum(1.0 + F.greatest(F.lit(0), F.col("files") - 2) * 0.5)).alias("score"), F.min("first").alias("first"),
    )


def _mock_message() -> Column:
    return F.concat(F.lit("Found duplicated PHPUnit mock/setup pattern"), F.when(F.size("items") == 1, "").otherwise("s"))


def mock_clusters(setups: DataFrame) -> DataFrame:
    """(path, items, score, message, line, places) of the files that :func:`duplicate_mocks` finds, whose places are counted and not listed."""
    each, _, _, places, pairs = _met(setups)
    moved = pairs.groupBy(F.col("q").alias("path")).agg(F.sum(F.when(F.col("plus"), 1).otherwise(-1)).alias("moved"))
    g = _setup_items(each).join(moved, "path", "left").crossJoin(F.broadcast(places.agg(F.count_if(F.col("k") > 0).alias("all"))))
    return g.select("path", "items", "score", _mock_message().alias("message"), F.substring_index("first", ":", -1).cast("int").alias("line"), (F.col("all") + F.coalesce("moved", F.lit(0))).cast("int").alias("places"))


def duplicate_mocks(setups: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, line, label, fingerprint) rows -> for every file, the setups it shares with two other files or more.

    A finding lists every place of every setup that its file shares, so a row is as long as the rule asks; each place is
    gathered once. :func:`mock_clusters` counts them for groups of any size.
    """
    rule = "php.duplicate-mock-setup"
    each, paths, _, places, pairs = _met(setups)
    of_most = F.broadcast(paths.select(F.col("path").alias("q"))).crossJoin(places.where("k > 0 AND p IS NOT NULL AND l IS NOT NULL").select("p", "l"))
    listed = of_most.join(pairs.where("NOT plus").select("q", "p", "l"), ["q", "p", "l"], "left_anti").unionByName(pairs.where("plus AND p IS NOT NULL AND l IS NOT NULL").select("q", "p", "l"))
    at = listed.groupBy(F.col("q").alias("path")).agg(F.sort_array(F.collect_list(F.struct(F.concat("p", F.lit(":"), F.col("l").cast("string")).alias("key"), "p", "l"))).alias("at"))
    where = F.transform("at", lambda s: location(s["p"], s["l"]))
    made = finding(rule, _mock_message(), F.col("items"), F.col("score"), where, _path(), order(2, F.lit(""), INDEX[rule], _path()))
    return _setup_items(each).join(at, "path").select(made.alias("f")).select("f.*")


def evaluate(files: DataFrame, options: dict[str, Options]) -> DataFrame:
    """All findings of ``files`` (with facts) under the rules named in ``options``; disabled rules add no branch to the plan."""
    php = files.where("language_id = 'php'")
    parts = [fact_findings(php, options)]
    if (o := options.get("php.stacked-static-analysis-suppressions")) is not None:
        parts.append(stacked(exploded_comments(php), o))
    if (o := options.get("markdown.low-signal")) is not None:
        parts.append(low_signal(files.where("language_id = 'markdown'").select("path", "text"), o))
    if (o := options.get("php.directory-fanout-hotspot")) is not None:
        parts.append(fanout(files.select("path"), o))
    if (o := options.get("php.over-fragmentation")) is not None:
        parts.append(fragmentation(files.select("path", "logical_line_count", F.size("functions").alias("function_count")), o))
    functions = flat_functions(php.select("path", "functions"))
    if (o := options.get("php.duplicate-function-signatures")) is not None:
        parts.append(duplicate_signatures(functions, o))
    if (o := options.get("php.duplicate-mock-setup")) is not None:
        parts.append(duplicate_mocks(php.select("path", F.explode("mock_setups").alias("m")).select("path", "m.*"), o))
    if (o := options.get("php.clone-cluster")) is not None:
        parts.append(clones(functions, o))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*FINDING_COLUMNS)
