"""Findings end to end: our own fixtures, suppression, deltas, reports, configuration, cache and commands."""

import json
import random

import pytest

from pyspark.sql import functions as F

from gritsieve import plugins
from gritsieve.functions import globs
from gritsieve.operators import facts, findings, identity, overrides, suppress
from gritsieve.plans import cli, fixtures
from gritsieve.plans.analyze import analyze, analyze_tree
from gritsieve.plans.corpora import findings as as_findings
from gritsieve.schema import FINDING, of
from gritsieve.sources import cache, config, files, reports, toon


@pytest.fixture(scope="module")
def whole(spark):
    found = files.discovered(spark.createDataFrame(fixtures.CORPUS, "path string, text string"), config.DEFAULT_IGNORES)
    return analyze(spark, found)


@pytest.fixture(scope="module")
def rows(whole):
    return whole.findings.orderBy(*findings.raw_order()).collect()


def test_each_fixture_has_its_finding_alone(rows):
    by = {}
    for r in rows:
        by.setdefault(r["path"], set()).add(r["rule_id"])
    for rule, (path, _) in fixtures.POSITIVE.items():
        own = by[path]
        assert rule in own, (rule, own)
        assert own <= {rule, "php.blanket-static-analysis-suppressions"}, (rule, own)


def test_grouped_rules_and_clean_files(rows):
    got = {}
    for r in rows:
        got.setdefault(r["rule_id"], []).append(r)
    assert [(r["path"], r["evidence"]) for r in got["php.directory-fanout-hotspot"]] == [("lib/many", ["fileCount=13"]), ("src", [f"fileCount={sum(p.startswith('src/') for p, _ in fixtures.CORPUS)}"])]
    assert [r["path"] for r in got["php.over-fragmentation"]] == ["lib/tiny"] or {r["path"] for r in got["php.over-fragmentation"]} >= {"lib/tiny"}
    assert [r["evidence"] for r in got["php.clone-cluster"]] == [["name=collect", "name=gather"]]
    assert ["shared(1)"] in [r["evidence"] for r in got["php.duplicate-function-signatures"]]
    assert {r["path"] for r in got["php.duplicate-mock-setup"]} == {f"tests/set/S{i}Test.php" for i in range(3)}
    clean = {p for p, _ in fixtures.CLEAN}
    assert not [r for r in rows if r["path"] in clean]


def test_golden_fingerprints(spark):
    f = spark.createDataFrame([("php.empty-catch", "Found empty PHP catch block", "src/EmptyCatch.php", 7), ("php.blanket-static-analysis-suppressions", "Found blanket PHPStan suppression without an identifier or reason", "src/BlanketSuppression.php", 3)], "r string, m string, p string, l int")
    got = [x[0] for x in f.select(identity.fingerprint(f.r, f.m, f.p, f.l)).collect()]
    assert got == ["b49dcf759303fa669bed307614a6910133c2e49388d1e551a9e59af7cfa7489d", "d7ad1b969682973ce4d3972dba567570ffdddf05f25b0ba6698abea4296ee1d6"]


@pytest.mark.parametrize(("glob", "path", "want"), [("**/vendor/**", "vendor", False), ("**/vendor/**", "vendor/a.php", True), ("**/vendor/**", "x/vendor/y/z.php", True), ("src/*.php", "src/a/b.php", False), ("a?[b]", "a?[b]", True), ("a\\b", "a/b", True), ("*.generated.*", "x/y.generated.php", False)])
def test_globs(spark, glob, path, want):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(globs.matches(df.path, [glob])).first()[0] is want


def made(spark, items):
    return as_findings(spark.createDataFrame(items, "rule_id string, message string, path string, line int, item string, score double, k long"))


def test_budgets_equal_the_greedy_loop(spark):
    r = random.Random(5)
    items = [(f"r{r.randint(0, 2)}", f"m{r.randint(0, 3)}", f"p{r.randint(0, 2)}", i, "e", 1.0, i) for i in range(60)]
    entries = [{"message": "/m[01]/", "count": 7}, {"ruleId": "r1", "count": 5}, {"path": "p2", "ruleIds": ["r0"]}, {"message": "/^m/", "count": 4}]
    alive, budget = [], [7, 5, None, 4]
    tests = [lambda x: x[1] in ("m0", "m1"), lambda x: x[0] == "r1", lambda x: x[2] == "p2" and x[0] == "r0", lambda x: True]
    for x in sorted(items, key=lambda x: (x[2], x[6])):
        for i, t in enumerate(tests):
            if t(x) and (budget[i] is None or budget[i] > 0):
                if budget[i] is not None:
                    budget[i] -= 1
                break
        else:
            alive.append(x[6])
    got = suppress.ignored(made(spark, items), suppress.normalize(entries))
    assert sorted(x[0] for x in got.select("ord.a").collect()) == sorted(alive)


def test_ignore_patterns():
    assert suppress.java_pattern("#a/b#i") == "(?i)a/b"
    for bad in ("plain", "/open", "/a/q", "/(/"):
        with pytest.raises(ValueError):
            suppress.java_pattern(bad)
    with pytest.raises(ValueError):
        suppress.normalize([{"ruleId": "a", "count": "many"}])
    assert suppress.normalize([{"count": 3}, 7]) == []


def test_inline_directives(spark):
    text = "<?php\n// @quality-ignore php.debug-output (known)\nvar_dump(1);\nvar_dump(2);\n/* @quality-ignore php.debug-output\n*/\nvar_dump(3);\n// @quality-ignore not valid!\nvar_dump(4);\n"
    out = analyze(spark, files.discovered(spark.createDataFrame([("a.php", text)], "path string, text string"), [])).findings
    assert sorted(r["locations"][0]["line"] for r in out.where("rule_id = 'php.debug-output'").collect()) == [4, 9]


def test_delta_cases(spark):
    one = lambda line, item="e", n=1: [("r", "m", "p", line + i, item, 1.0, i) for i in range(n)]

    def count(base, head):
        return tuple(identity.delta_counts(identity.delta(made(spark, base), made(spark, head))).first())

    assert count(one(10), one(16)) == (0, 0)
    assert count(one(10), one(16, "other")) == (1, 1)
    assert count(one(10, n=2), one(20, n=2)) == (2, 2)
    assert count([], one(1)) == (1, 0) and count(one(1), one(1)) == (0, 0)
    changes = identity.delta(made(spark, []), made(spark, one(1)))
    assert identity.fails(changes, ["any"]) and identity.fails(changes, ["added"]) and not identity.fails(changes, ["resolved"]) and not identity.fails(changes, [])


def test_overrides(spark):
    over = [{"path": "lib/**", "rules": {"php.debug-output": {"weight": 3, "options": {"a": 1}}}}, {"paths": ["lib/x/**"], "rules": {"php.debug-output": {"enabled": False}}}]
    assert overrides.resolve("php.debug-output", {"php.debug-output": {"weight": 2}}, over, overrides.path_key("lib/a.php", over)) == overrides.RuleConfig(True, 3.0, {"a": 1})
    c = config.merge({"overrides": over, "rules": {"php.debug-output": {"weight": 2}}})
    src = [(p, "<?php\nvar_dump(1);\n") for p in ("a.php", "lib/b.php", "lib/x/c.php")]
    out = analyze(spark, files.discovered(spark.createDataFrame(src, "path string, text string"), []), c).findings
    assert sorted((r["path"], r["score"]) for r in out.where("rule_id = 'php.debug-output'").collect()) == [("a.php", 2.5), ("lib/b.php", 3.75)]


def test_selection_and_rollups(spark):
    f = made(spark, [("a", "m", "d/x.php", 3, "e", 1.0, 1), ("a", "m", "d/y.php", 1, "e", 2.0, 2), ("b", "m", "d/x.php", 9, "e", 2.0, 3)])
    assert [r["rule_id"] for r in findings.top(findings.selected(f, min_score=1.5), 1).collect()] == ["a"]
    assert findings.top(f, 0).count() == 0 and findings.selected(f, ["b"], ["d/*.php"]).count() == 1
    assert [tuple(r) for r in findings.file_scores(f).collect()] == [("d/x.php", 3.0, 2), ("d/y.php", 2.0, 1)]
    assert [tuple(r) for r in findings.directory_scores(f).collect()] == [("d", 5.0, 3)]


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "path string, line_count int, logical_line_count int, function_count int")
    s = findings.summary(empty, made(spark, [])).first()
    assert (s["file_count"], s["repo_score"], s["score_per_kloc"]) == (0, 0.0, None)


def test_reports(whole, tmp_path):
    report = whole.report()
    assert report["summary"]["findingCount"] == len(report["findings"]) and report["metadata"]["schemaVersion"] == 1
    for kind in ("json", "toon", "ndjson", "github", "lint", "text"):
        assert reports.render(report, kind)
    assert json.loads(reports.render(report, "json")) == json.loads(json.dumps(report))
    assert toon.decode(toon.encode(report)) == json.loads(json.dumps(report))
    assert reports.lint_report([]) == "0 findings" and reports.lint_report(report["findings"][:1]).endswith("1 finding")
    path = str(tmp_path / "b.json")
    reports.write_report(path, reports.baseline(report))
    assert len(reports.read_baseline(path)["findings"]) == len(report["findings"])
    with pytest.raises(reports.ReportError):
        reports.write_report(str(tmp_path / "none" / "b.json"), report)


@pytest.mark.parametrize("data", [{"a": [], "b": {}, "c": [{"x": 1, "y": "a,b"}, {"x": 2, "y": "-"}], "d": [[1, 2], {"e": [None, True]}], "f g": "true", "h": "1.5", "i": " pad "}, {"n": {"m": {"o": ["a b", 'q"', ""]}}}])
def test_toon_round_trip(data):
    assert toon.decode(toon.encode(data)) == data


def test_config(tmp_path):
    assert config.load(str(tmp_path)).ignores == config.DEFAULT_IGNORES
    (tmp_path / config.FILE_NAMES[1]).write_text(json.dumps({"ignores": ["x"], "rules": {"r": {"options": {"a": 1}}}, "scan": {"maxFindings": "-3", "minScore": "1.5", "rules": "r"}}))
    c = config.load(str(tmp_path))
    assert (c.ignores, c.scan.max_findings, c.scan.min_score, c.scan.rules) == (["x"], 0, 1.5, ["r"])
    assert config.merge({"rules": {"r": {"options": {"b": 2}, "weight": 2}}}, c).rules == {"r": {"options": {"a": 1, "b": 2}, "weight": 2}}
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path), "missing.json")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path), "bad.json")


def test_cache_parses_only_what_is_new(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "facts")
    src = [("a.php", "<?php\nvar_dump(1);\n"), ("b.php", "<?php\nfunction f() {}\n")]
    found = files.discovered(spark.createDataFrame(src, "path string, text string"), [])
    first = sorted(map(repr, cache.facts(spark, found, at).collect()))
    seen = []
    extract = cache.X.extract
    monkeypatch.setattr(cache.X, "extract", lambda df: seen.append(df.count()) or extract(df))
    assert sorted(map(repr, cache.facts(spark, found, at).collect())) == first and seen == [0]


def test_a_lost_cache_write_loses_nothing(spark, tmp_path):
    at = str(tmp_path / "facts")
    found = files.discovered(spark.createDataFrame([("a.php", "<?php\nvar_dump(1);\n")], "path string, text string"), [])
    want = cache.facts(spark, found, at).collect()
    torn = tmp_path / "facts" / "g-99999999999999999999-torn"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half a file")
    assert cache.facts(spark, found, at).collect() == want and len(cache.generations(spark, at)) == 2
    cache.facts(spark, found, at)
    assert len(cache.generations(spark, at)) == 2
    (tmp_path / "plain").write_text("no folder")
    assert cache.facts(spark, found, str(tmp_path / "plain" / "x")).collect() == want


def tree(root, sources):
    for path, text in sources:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_discovery(spark, tmp_path):
    import hashlib

    latin = "<?php\n// caf\u00e9 todo: x\n$a = 'n\u00e4h'; var_dump($a);\n".encode("latin-1")
    root = tree(tmp_path, [("src/A.php", "<?php\n"), ("src/_ide.php", "<?php\n"), (".hid/a.php", "<?php\n"), ("src/B.PHP", latin), ("legacy/c.php", "<?php\n"), ("legacy/deep/d.php", "x"), ("x.generated.d/e.php", "x"), ("notes.txt", "x"), ("noext", "x"), ("a.Md", "")])
    (tmp_path / "loop").symlink_to(tmp_path / "src")
    got = {r["path"]: r for r in files.read_tree(spark, root, ["legacy", "**/*.generated.*"]).collect()}
    assert sorted(got) == [".hid/a.php", "a.Md", "src/A.php", "src/B.PHP", "src/_ide.php"]
    odd = got["src/B.PHP"]
    assert odd["content_hash"] == hashlib.sha256(latin).hexdigest() and len(odd["text"]) == len(latin) and odd["line_count"] == 3
    assert (odd["extension"], odd["language_id"], got["a.Md"]["language_id"], got["a.Md"]["line_count"]) == (".php", "php", "markdown", 0)
    found = analyze(spark, files.read_tree(spark, root, [])).findings.where("path = 'src/B.PHP'").collect()
    assert {(r["rule_id"], r["locations"][0]["line"]) for r in found} >= {("php.placeholder-comments", 2), ("php.debug-output", 3)}
    same = [("legacy/c.php", "x"), ("src/A.php", "x")]  # rows of a table are pruned alike
    assert [r["path"] for r in files.discovered(spark.createDataFrame(same, "path string, text string"), ["legacy"]).collect()] == ["src/A.php"]
    with pytest.raises(OSError):
        files.read_tree(spark, str(tmp_path / "none"), [])
    assert files.read_tree(spark, tree(tmp_path / "void", [("t.txt", "x")]), []).count() == 0


def test_a_second_scan_sees_changes(spark, tmp_path):
    root = tree(tmp_path, [("a.php", "<?php\nvar_dump(1);\n")])
    count = lambda: analyze_tree(spark, root).findings.where("rule_id = 'php.debug-output'").count()
    assert count() == 1
    tree(tmp_path, [("b.php", "<?php\nvar_dump(1);\n")])
    assert count() == 2
    tree(tmp_path, [("b.php", "<?php\nvar_dump(1);\nvar_dump(2);\n")])
    assert count() == 3


def test_plugins(spark, tmp_path):
    reg = plugins.default_registry()
    assert len(reg.rules) == 27 and reg.detect_language("x/Y.PHTML") == "php" and reg.detect_language("x.sql") is None
    reg.register(plugins.LanguagePlugin("sql", ("sql",)))
    reg.register(plugins.FactProvider("sql.twice", ("twice",), lambda full: full.select("path", (F.col("stars") * 2).alias("twice")), ("stars",)))
    reg.register(plugins.FactProvider("sql.stars", ("stars",), lambda full: full.where("language_id = 'sql'").select("path", F.length(F.regexp_replace("text", "[^*]", "")).alias("stars")), ("text",)))
    reg.register(plugins.RulePlugin("sql.star", "sql", "weak", "file", lambda full, o: full.where(F.col("twice") >= o.get("least", 2)).select("path", F.lit(1).alias("line"), F.lit("Found a star").alias("message"), F.array(F.col("twice").cast("string")).alias("evidence"), F.lit(1.5).alias("score")), ("twice",)))
    reg.register(plugins.ReporterPlugin("count", lambda report: str(len(report["findings"]))))
    assert [p.id for p in reg.ordered_providers()] == ["sql.stars", "sql.twice"]
    root = tree(tmp_path, [("q.sql", "select * from t"), ("r.sql", "select 1"), ("a.php", "<?php\nvar_dump(1);\n")])
    done = analyze_tree(spark, root, config.merge({"rules": {"sql.star": {"weight": 2}}}), registry=reg)
    got = {(r["rule_id"], r["path"], r["score"]) for r in done.findings.collect()}
    assert ("sql.star", "q.sql", 3.0) in got and ("php.debug-output", "a.php", 1.25) in got and not any(p == "r.sql" for _, p, _ in got)
    assert reg.reporter("count").render(done.report()) == str(len(got))
    off = analyze_tree(spark, root, config.merge({"rules": {"sql.star": {"enabled": False}}}), registry=reg)
    assert off.findings.where("rule_id = 'sql.star'").count() == 0
    with pytest.raises(ValueError):
        reg.reporter("none")
    with pytest.raises(ValueError):
        plugins.Registry().register(plugins.FactProvider("x", ("y",), lambda f: f, ("nowhere",))).ordered_providers()


def test_override_options():
    base = overrides.RuleConfig(True, 1.0, {"a": 1})
    assert overrides._apply(base, {"options": {"b": 2}}).options == {"a": 1, "b": 2} and overrides._apply(base, {"options": 7}).options == {} and overrides._apply(base, {}).options == {"a": 1}
    assert overrides.patterns({"path": "", "paths": ["", "a", 3]}) == ["a"] and overrides.patterns({"paths": "a"}) == []


def test_delta_tells_places_apart_by_their_file(spark):
    """A finding of two files whose place in one of them moved."""
    def rows(line):
        places = [("a.php", 1, 1), ("b.php", line, 1)]
        return spark.createDataFrame([("r", "f", "medium", "repo", "m", ["e"], 1.0, places, None, (2, "", 0, None, 0, 0))], of(FINDING))

    assert identity.delta(rows(5), rows(9)).count() == 0
    assert identity.delta(rows(5), rows(5)).count() == 0


def test_write_findings(spark, tmp_path):
    root = tree(tmp_path / "t", [("a.php", "<?php\nvar_dump(1);\nvar_dump(2);\n")])
    done = analyze_tree(spark, root)
    for kind in ("ndjson", "lint", "github"):
        done.write_findings(str(tmp_path / kind), kind)
        assert spark.read.text(str(tmp_path / kind)).where("value like '%var_dump%' or value like '%debug-output%'").count() == 2
    done.release()


def test_commands(spark, tmp_path, capsys):
    root = tmp_path / "tree"
    tree(root, fixtures.CORPUS[:3] + fixtures.CLEAN[-2:])
    base = str(tmp_path / "base.json")
    out = lambda: capsys.readouterr().out
    assert cli.main(["scan", str(root), "--json", "--rule", "php.empty-catch"], spark) == 0
    report = json.loads(out())
    assert [f["ruleId"] for f in report["findings"]] == ["php.empty-catch"] and report["summary"]["findingCountBeforeFilters"] >= 3
    assert cache.generations(spark, str(root / cache.DEFAULT_NAME))
    assert cli.main(["scan", str(root), "--generate-baseline"], spark) == 1 and "Missing --baseline-file" in capsys.readouterr().err
    assert cli.main(["scan", str(root), "--baseline-file", base, "--generate-baseline"], spark) == 0 and f"baseline written to {base}" in out()
    assert cli.main(["scan", str(root), "--baseline-file", base, "--lint"], spark) == 0 and out().strip() == "0 new findings"
    (root / "src" / "New.php").write_text("<?php\nvar_dump(1);\n")
    assert cli.main(["scan", str(root), "--baseline-file", base, "--lint"], spark) == 1
    assert "php.debug-output" in out()
    assert cli.main(["scan", str(root), "--baseline-file", base, "--ndjson"], spark) == 1
    lines = [json.loads(x) for x in out().splitlines()]
    assert lines[0] == {"type": "summary", "summary": {"findingCount": 1, "label": "new findings", "delta": {"added": 1, "resolved": 0}}} and lines[1]["finding"]["ruleId"] == "php.debug-output" and len(lines) == 2
    assert cli.main(["scan", str(root), "--baseline-file", base, "--json"], spark) == 1
    full = json.loads(out())
    assert [c["status"] for c in full["baseline"]["changes"]] == ["added"] and full["newFindings"] == [full["baseline"]["changes"][0]["finding"]] and full["newFindings"][0]["path"] == "src/New.php"
    assert cli.main(["delta", "--base-report", base, "--head", str(root), "--fail-on", "resolved"], spark) == 0
    assert "added: 1" in (text := out()) and "added php.debug-output" in text
    assert cli.main(["delta", "--base-report", base, "--head", str(root), "--json", "--fail-on", "any"], spark) == 1
    assert json.loads(out())["changes"][0]["finding"]["ruleId"] == "php.debug-output"
    assert cli.main(["stats", "--report", base, "--json"], spark) == 0
    stats = json.loads(out())
    assert stats["summary"] | {"uniqueRules": 0, "uniquePaths": 0} == {"findingCount": stats["summary"]["reportFindingCount"], "uniqueRules": 0, "uniquePaths": 0, "reportKind": "baseline", "reportFindingCount": len(json.load(open(base))["findings"])}
    assert set(stats["topRules"][0]) == {"ruleId", "findingCount", "locationCount"} and set(stats["topFiles"][0]) == {"path", "findingCount"}
    assert cli.main(["stats", "--report", base], spark) == 0 and " findings, " in (text := out()) and text.strip().endswith(" findings")
    assert cli.main(["stats", "--report", str(tmp_path / "none.json")], spark) == 1


def test_facts_in_one_pass_equal_the_join(spark):
    rows = [*fixtures.CORPUS, ("src/empty.php", ""), ("src/broken.php", "<?php function ("), ("src/html.php", "<b>x</b>")]
    found = files.discovered(spark.createDataFrame([*rows, ("src/null.php", None)], "path string, text string"), [])
    joined = facts.with_facts(found, facts.extract(found))
    once = facts.extended(found)
    assert once.columns == joined.columns
    as_text = lambda df: sorted(map(repr, df.collect()))
    assert as_text(once) == as_text(joined)
    assert facts.extended(found.limit(0)).count() == 0


def test_inline_suppression_meets_in_order_of_lines(spark):
    from gritsieve.plans import corpora

    found = [("r", 3, 5), ("r", 4, 4), ("r", 9, 9), ("r", 9, 20), ("r", 30, 30), ("q", 1, 50), ("r", 33, 32)]
    lines = [*range(1, 40), 6, 6]
    spans = spark.createDataFrame([("a.php", r, a, b) for r, a, b in found] + [(None, "r", 1, 99), ("b.php", "r", 1, 2)], "path string, rule_id string, first int, last int")
    rows = [(r, "m", p, n, "e", 1.0, i * 100 + j) for i, (r, p) in enumerate([("r", "a.php"), ("q", "c.php"), ("r", None)]) for j, n in enumerate(lines)]
    kept = suppress.inline_suppressed(corpora.findings(spark.createDataFrame(rows, "rule_id string, message string, path string, line int, item string, score double, k long")), spans)
    want = [r[6] for r in rows if not any(r[0] == q and r[2] == "a.php" and a <= r[3] <= b + 1 for q, a, b in found)]
    assert sorted(r["ord"]["a"] for r in kept.collect()) == want
    joins = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("<=" in x or ">=" in x for x in joins)
