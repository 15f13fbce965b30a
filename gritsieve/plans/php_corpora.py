"""PHP sources derived from the documents table, one file a document, and in SQL what the parser has to find in them.

A file holds the document's whole text in a comment and code whose names, literals and shapes follow the document's id. The
statements run on both engines; what is expected is stated from the same ids, without any parsing.
"""

from __future__ import annotations

import re

_SPECIAL = {"\n": 10, "'": 39, "\\": 92, "{": 123, "}": 125}


def _sql(template: str) -> str:
    """SQL for a template's text; ``<<expression>>`` is SQL inside it."""
    out = []
    for i, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if i % 2:
            out.append(f"({part})")
            continue
        out += [f"chr({_SPECIAL[p]})" if p in _SPECIAL else f"'{p}'" for p in re.split(r"([\n'\\{}])", part) if p]
    return " || ".join(out)


def pick(over: int, *values: str, by: str = "k") -> str:
    """The value of ``k % over``; values are text for :func:`_sql`."""
    assert len(values) == over
    return f"CASE {by} % {over} " + " ".join(f"WHEN {i} THEN {_sql(v) if v else repr('')}" for i, v in enumerate(values)) + " END"


def choose(over: int, *values: str) -> str:
    """The SQL expression of ``k % over``."""
    assert len(values) == over
    return f"CASE k % {over} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


N = "CAST(k AS VARCHAR(20))"
#: doc_id as k, the text as it stands in a comment, and b, the line of the code's first line.
BASE = "SELECT k, body, CAST(3 + length(body) - length(replace(body, chr(10), '')) AS INT) AS b FROM (SELECT doc_id AS k, replace(coalesce(text, ''), '*/', '* /') AS body FROM documents)"


def _files(path: str, code: str) -> str:
    return f"SELECT k, b, body, {path} AS path, 'php' AS language_id, {_sql('<?php' + chr(10) + '/* <<body>> */' + chr(10) + code)} AS text FROM ({BASE})"


# -- catches

_CATCH_BODY = (
    "", "throw new StoreFailed($e->getMessage());", 'throw new \\RuntimeException("failed <<' + N + '>>");', 'throw new StoreFailed("m", 1, $e);', 'throw new \\LogicException("no", previous: $e);',
    'error_log("failed");', "return [];", "return 0;", "return $e->getMessage();", "return (string) $e;", "$error = $e->getMessage(); keep($error);", 'return ["reason" => (string) $e, "k" => 1];',
    '$f = fn($e) => ["error" => $e->getMessage()]; run($f);', 'print "x"; echo "y";', "throw $e;",
)
CATCHES = _files(
    f"'src/c' || {N} || '.php'",
    "function load<<" + N + ">>($x) {\n    try {\n        return go($x, true);\n    } catch (Oops $e) {\n        <<" + pick(15, *_CATCH_BODY) + ">>\n    }\n}\n",
)


def _of_catch(name: str, values: dict[int, str], other: str = "''") -> str:
    return f"CASE k % 15 {' '.join(f'WHEN {i} THEN {v}' for i, v in values.items())} ELSE {other} END AS {name}"


_THROWS = "k % 15 IN (1, 2, 3, 4, 14)"
CATCH_FACTS = f"""
SELECT path, b + 3 AS line, CAST(CASE k % 15 WHEN 0 THEN 0 WHEN 10 THEN 2 WHEN 12 THEN 2 WHEN 13 THEN 2 ELSE 1 END AS INT) AS statements, {_THROWS} AS has_throw, k % 15 IN (6, 7, 8, 9, 11) AS has_return,
  {_of_catch('calls', {5: "'error_log'", 10: "'keep'", 12: "'run'", 13: "'echo,print'"})}, {_of_catch('defaults', {6: "'empty-array'", 7: "'zero'"})}, {_of_catch('returned', {8: "'caught-message'", 9: "'caught-string'"})},
  {_of_catch('thrown', {1: "'StoreFailed:false:false:true'", 2: "'RuntimeException:true:false:false'", 3: "'StoreFailed:false:true:true'", 4: "'LogicException:true:true:true'", 14: "':false:false:false'"})}
FROM ({CATCHES})"""
NORMALIZATIONS = f"""
SELECT path, CASE k % 15 WHEN 8 THEN 'returned-caught-message' WHEN 9 THEN 'returned-caught-string' WHEN 10 THEN 'assigned-caught-message' ELSE 'property-caught-string' END AS kind, b + 4 AS line,
  CAST(CASE k % 15 WHEN 8 THEN 16 WHEN 9 THEN 16 WHEN 10 THEN 18 ELSE 29 END AS INT) AS col FROM ({CATCHES}) WHERE k % 15 IN (8, 9, 10, 11)"""


def found(rule: str, source: str, where: str, line: str, score: str, message: str, evidence: str) -> str:
    """Flat findings of a rule in SQL."""
    return f"SELECT '{rule}' AS rule_id, path, CAST({line} AS INT) AS line, CAST({score} AS DOUBLE) AS score, {message if message.startswith('CASE') else repr(message)} AS message, {evidence} AS evidence, CAST(1 AS INT) AS places FROM ({source}) WHERE {where}"


ERROR_RULES = ["php.empty-catch", "php.exception-wrap-without-previous", "php.error-obscuring-catch", "php.error-swallowing", "php.catch-default-fallbacks", "php.catch-returns-exception-message"]
ERROR_FINDINGS = " UNION ALL ".join(
    [
        found(ERROR_RULES[0], CATCHES, "k % 15 = 0", "b + 3", "2", "Found empty PHP catch block", "'catch block has no statements'"),
        found(ERROR_RULES[1], CATCHES, "k % 15 = 1", "b + 3", "2", "Found PHP catch block that wraps an exception without preserving previous context", "'class=StoreFailed|reason=wraps-caught-exception-without-previous'"),
        found(ERROR_RULES[2], CATCHES, "k % 15 = 2", "b + 3", "2.25", "Found PHP catch block that replaces the original error with a generic exception", "'class=RuntimeException|reason=generic-replacement-without-previous'"),
        found(ERROR_RULES[3], CATCHES, "k % 15 IN (5, 13)", "b + 3", "2", "Found PHP catch block that logs or prints and continues", "'catch body logs/prints without throw or return'"),
        found(ERROR_RULES[4], CATCHES, "k % 15 IN (6, 7)", "b + 3", "2", "Found PHP catch block that returns a default fallback literal", "CASE k % 15 WHEN 6 THEN 'return=empty-array' ELSE 'return=zero' END"),
        found(ERROR_RULES[5], CATCHES, "k % 15 IN (8, 9)", "b + 3", "2", "Found PHP catch block that returns the caught exception as data", "CASE k % 15 WHEN 8 THEN 'return=caught-message' ELSE 'return=caught-string' END"),
        found(ERROR_RULES[5], CATCHES, "k % 15 IN (10, 11) AND {short}", "b + 4", "2", "Found PHP catch block that flattens the caught exception into generic string data", "CASE k % 15 WHEN 10 THEN 'normalization=assigned-caught-message' ELSE 'normalization=property-caught-string' END"),
    ]
)

# -- functions, methods, classes

_CLASS = pick(6, "StoreFake", "Store", "Shop", "Store", "Till", "Store")
_NAME1 = pick(5, "isReady", "label", "hasAny", "value<<" + N + ">>", "get_item_name")
_CONST = pick(7, "null", "false", "0", "0.0", '""', "[]", "true")
_NAME2 = pick(3, "__clone", "later", "touch")
_CALL = pick(5, "other($a, $b)", "other($b, $a)", "other($a)", "\\Lib\\other($a, $b)", "other(b: $a, a: $b)")
_NUMBER = pick(4, "37", "1", "2.50", "0x1F")
_M = "CAST(k + 2 AS VARCHAR(20))"
FUNCTIONS = _files(
    f"'lib/m' || CAST(k % 9 AS VARCHAR(20)) || '/f' || {N} || '.php'",
    "namespace App\\M<<CAST(k % 5 AS VARCHAR(20))>>;\n<<" + pick(4, "class", "abstract class", "trait", "final class") + ">> <<" + _CLASS + ">> {\n"
    "    public function <<" + _NAME1 + ">>(): int {\n        return <<" + _CONST + ">>;\n    }\n    public function <<" + _NAME2 + ">>(int $n = 3): void {\n    }\n}\n"
    "function pass<<" + N + ">>($a, $b) {\n    return <<" + _CALL + ">>;\n}\nfunction magic<<" + N + ">>($x) {\n    $y = $x * <<" + _NUMBER + '>>;\n    return pick(["7" => "<<' + _M + '>>", "n" => -<<' + _M + ">>], $y);\n}\n",
)
_SPACE = "'App' || chr(92) || 'M' || CAST(k % 5 AS VARCHAR(20))"
_KIND = "CASE k % 4 WHEN 1 THEN 'abstract-class' WHEN 2 THEN 'trait' ELSE 'class' END"
_RETURNED = "CASE k % 7 WHEN 0 THEN 'null' WHEN 1 THEN 'false' WHEN 2 THEN 'zero' WHEN 3 THEN 'zero' WHEN 4 THEN 'empty-string' WHEN 5 THEN 'empty-array' END"
_BODY1 = "'return ' || " + pick(7, "null", "false", "0", "0.0", "''", "[]", "true") + " || ';'"
_CALLEE = "CASE k % 5 WHEN 0 THEN 'other' WHEN 3 THEN 'Lib' || chr(92) || 'other' END"


def _fn(pos: int, name: str, cls: bool, line: int, params: str, n: int, callee: str, constant: str, body: str) -> str:
    own = f"lower({_CLASS}) || '::' || " if cls else ""
    return (
        f"SELECT path, CAST({pos} AS INT) AS pos, {name} AS name, {own}lower({name}) || '({n})' AS signature, b + {line} AS line, '{params}' AS params, {callee} AS callee, {constant} AS constant_return, "
        f"{_KIND if cls else 'CAST(NULL AS VARCHAR(20))'} AS class_kind, {_CLASS if cls else 'CAST(NULL AS VARCHAR(20))'} AS class_name, {_SPACE} AS namespace_name, {body} AS body FROM ({FUNCTIONS})"
    )


_NULL = "CAST(NULL AS VARCHAR(20))"
_BODY3 = _sql("$y = $x * <<" + _NUMBER + ">>;\nreturn pick(['7' => '<<" + _M + ">>', 'n' => -<<" + _M + ">>], $y);")
FUNCTION_FACTS = " UNION ALL ".join(
    [
        _fn(0, _NAME1, True, 2, "", 0, _NULL, _RETURNED, _BODY1),
        _fn(1, _NAME2, True, 5, "$n", 1, _NULL, _NULL, "''"),
        _fn(2, f"'pass' || {N}", False, 8, "$a,$b", 2, _CALLEE, _NULL, f"'return ' || {_CALL} || ';'"),
        _fn(3, f"'magic' || {N}", False, 11, "$x", 1, _NULL, _NULL, _BODY3),
    ]
)
NUMBERS = f"""
SELECT path, name, value, normalized, kind, line, CAST(col AS INT) AS col FROM (
  SELECT k, path, 'magic' || {N} AS name, {_NUMBER} AS value, CASE k % 4 WHEN 0 THEN '37' WHEN 1 THEN '1' ELSE '2.5' END AS normalized, 'numeric' AS kind, b + 12 AS line, 15 AS col FROM ({FUNCTIONS}) WHERE k % 4 < 3
  UNION ALL SELECT k, path, 'magic' || {N}, {_M}, {_M}, 'numeric-string', b + 13, 25 FROM ({FUNCTIONS})
  UNION ALL SELECT k, path, 'magic' || {N}, '-' || {_M}, '-' || {_M}, 'numeric', b + 13, 36 + length({_M}) FROM ({FUNCTIONS})
  UNION ALL SELECT k, path, {_NAME1}, CASE k % 7 WHEN 2 THEN '0' ELSE '0.0' END, '0', 'numeric', b + 3, 16 FROM ({FUNCTIONS}) WHERE k % 7 IN (2, 3))"""
FUNCTION_RULES = ["php.magic-numbers", "php.pass-through-wrappers", "php.return-constant-stub", "php.placeholder-method-bodies"]
FUNCTION_FINDINGS = " UNION ALL ".join(
    [
        found(FUNCTION_RULES[0], NUMBERS, "normalized NOT IN ('0', '1')", "line", "0.5", "Found inline PHP magic number literal", "name || '|value=' || value || '|kind=' || kind"),
        found(FUNCTION_RULES[1], FUNCTIONS, "k % 5 IN (0, 3)", "b + 8", "1", "Found pass-through PHP wrapper function", f"'pass' || {N}"),
        found(
            FUNCTION_RULES[2], FUNCTIONS, "k % 7 IN (1, 2, 3, 4) AND k % 4 <> 1 AND k % 6 <> 0 AND NOT (k % 7 = 1 AND k % 5 IN (0, 2))", "b + 2", "1",
            "Found PHP function whose body is only a constant placeholder return", f"{_NAME1} || '|return=' || {_RETURNED}",
        ),
        found(FUNCTION_RULES[3], FUNCTIONS, "k % 4 IN (0, 3) AND k % 3 <> 0", "b + 5", "1", "Found empty method body in a concrete class", _NAME2),
    ]
)

# -- calls, casts, arrays

_BAG = pick(5, "data", "payload", "rows", "Record", "other")
_EXPR = pick(4, "(array) $a", "parse($a, true)", "json_decode($a, associative: TRUE)", "json_decode($a, false)")
_DEBUG = pick(6, "var_dump($a)", "\\dd($a)", "Print_R($a, true)", "$a->dump()", "ray()", "go($a)")
_ENVELOPE = pick(5, '["ok" => true, "rows" => $a]', '$this->json(["Status" => FALSE, "error" => $a, "message" => $b])', 'new Reply(["success" => true, "data" => $a])', 'wrap(["ok" => $a, "data" => 1])', '["ok" => true, "other" => $a]')
CALLS = _files(
    f"'app/g' || {N} || '.php'",
    "use function json_decode as parse;\nuse Http\\JsonResponse as Reply;\nfunction run<<" + N + ">>(mixed $a, ?int $b, $c): <<" + pick(2, "mixed", "string") + ">> {\n"
    "    $<<" + _BAG + ">> = <<" + _EXPR + ">>;\n    <<" + _DEBUG + ">>;\n    return <<" + _ENVELOPE + ">>;\n}\n",
)
_DEBUGGED = "CASE k % 6 WHEN 0 THEN 'var_dump' WHEN 1 THEN 'dd' WHEN 2 THEN 'print_r' ELSE 'ray' END"
_CAST_WHERE = "k % 5 IN (0, 1, 3) AND k % 4 < 3"
_CAST_KIND = "CASE k % 4 WHEN 0 THEN 'array-cast' ELSE 'json-decode-assoc' END"
_STATUS = choose(5, "'ok:true'", "'status:false'", "'success:true'", "''", "''")
_PAYLOAD = choose(5, "'rows'", "'error,message'", "'data'", "''", "''")
_SHAPED = "CASE k % 5 WHEN 0 THEN 'returned-generic-status-envelope' ELSE 'json-generic-status-envelope' END"
CALL_FACTS = f"""
SELECT path, 'debug' AS fact, b + 4 AS line, CAST(NULL AS INT) AS col, {_DEBUGGED} AS detail FROM ({CALLS}) WHERE k % 6 IN (0, 1, 2, 4)
UNION ALL SELECT path, 'cast', b + 3, CAST(length({_BAG}) + 9 AS INT), '$' || {_BAG} || ' ' || {_CAST_KIND} FROM ({CALLS}) WHERE {_CAST_WHERE}
UNION ALL SELECT path, 'envelope', b + 5, CAST(CASE k % 5 WHEN 0 THEN 12 WHEN 1 THEN 24 ELSE 22 END AS INT), {_SHAPED} || ' ' || {_STATUS} || ' ' || {_PAYLOAD} FROM ({CALLS}) WHERE k % 5 < 3
UNION ALL SELECT path, 'escapes', CAST(NULL AS INT), CAST(NULL AS INT), 'mixed=' || CASE k % 2 WHEN 0 THEN '2' ELSE '1' END || ' casts=' || CASE k % 4 WHEN 0 THEN '1' ELSE '0' END FROM ({CALLS})
UNION ALL SELECT path, 'parser', CAST(NULL AS INT), CAST(NULL AS INT), 'true classes=0 functions=1' FROM ({CALLS})"""
CALL_RULES = ["php.generic-status-envelopes", "php.generic-array-casts", "php.debug-output", "php.type-escape-hotspots"]
_PAYLOADS = choose(5, "'payload=rows'", "'payload=error|payload=message'", "'payload=data'", "''", "''")
CALL_FINDINGS = " UNION ALL ".join(
    [
        found(CALL_RULES[0], CALLS, "k % 5 < 3 AND {short}", "b + 5", "2", "Found PHP array literal shaped as a generic status envelope", f"'kind=' || {_SHAPED} || '|status=' || {_STATUS} || '|' || {_PAYLOADS}"),
        found(CALL_RULES[1], CALLS, f"{_CAST_WHERE} AND {{short}}", "b + 3", "2", "Found generic array conversion assigned to a vague bag variable", f"'variable=$' || {_BAG} || '|kind=' || {_CAST_KIND}"),
        found(CALL_RULES[2], CALLS, "k % 6 IN (0, 1, 2, 4)", "b + 4", "1.25", "Found PHP debug-output call left in source", _DEBUGGED),
        found(CALL_RULES[3], CALLS, "k % 4 = 0", "1", "3", "Found file with concentrated type escape patterns", "'mixed-types=2|casts=1|total=3'"),
    ]
)

# -- tests

_CHECKED = pick(5, "$this->assertSame(1, run($a, $b));", "$a->expects($this->once());", "run($a, $b);", "self::assertTrue(run($a));", "\\Mockery::mock(A::class);")
TESTS = _files(
    "CASE k % 3 WHEN 0 THEN 'tests/T' || " + N + " || 'Test.php' WHEN 1 THEN 'src/Plain' || " + N + " || '.php' ELSE 'src/Case' || " + N + " || '.php' END",
    "class C<<" + N + ">> <<" + pick(3, "", "", "extends \\PHPUnit\\Framework\\TestCase") + ">> {\n    public function testRuns<<" + N + ">>(): void {\n        $a = $this->createMock(A::class);\n"
    '        $b = $this->getMockBuilder(B::class)->getMock();\n        $a->method("get")->willReturn(<<' + N + ">>);\n        <<" + _CHECKED + ">>\n    }\n    <<"
    + pick(4, "#[Test]", "", "", "") + ">>\n    public function other(): void {\n        $a = 1;\n        $a->method(\"get\")->willReturn(2);\n    }\n}\n",
)
_LOOKS = "k % 3 <> 1"
_TESTS = "CASE k % 4 WHEN 0 THEN 2 ELSE 1 END"
_MOCKS = "CASE k % 5 WHEN 4 THEN 3 ELSE 2 END"
TEST_FACTS = f"""
SELECT path, {_LOOKS} AS looks_like_test, CAST(CASE WHEN {_LOOKS} THEN {_TESTS} ELSE 0 END AS INT) AS tests, CAST(CASE WHEN {_LOOKS} THEN {_MOCKS} ELSE 0 END AS INT) AS mocks,
  CAST(CASE WHEN {_LOOKS} AND k % 5 IN (0, 3) THEN 1 ELSE 0 END AS INT) AS assertions, CAST(CASE WHEN {_LOOKS} AND k % 5 = 1 THEN 1 ELSE 0 END AS INT) AS expectations,
  CASE WHEN {_LOOKS} THEN 'getMockBuilder|getMock:' || CAST(b + 3 AS VARCHAR(20)) || ',method|willReturn:' || CAST(b + 4 AS VARCHAR(20)) ELSE '' END AS setups FROM ({TESTS})"""
MOCK_FINDINGS = found(
    "php.mock-heavy-tests-without-assertions", TESTS, f"{_LOOKS} AND k % 5 IN (2, 4)", "1", "1.25", "Found mock-heavy PHP test file without assertions or mock expectations",
    f"'tests=' || CAST({_TESTS} AS VARCHAR(20)) || '|mocks=' || CAST({_MOCKS} AS VARCHAR(20)) || '|assertions=0|expectations=0'",
)

# -- PHPDoc and comments

_DOC = pick(5, "string", "int", "Int|null", "array<int>", "?int")
_WORDS = pick(2, "", " the number kept")
_GIVEN = pick(3, "void", "string", "string|null")
_NATIVE = pick(3, "void", "?string", "?string")
DOCS = _files(
    f"'doc/d' || {N} || '.php'",
    "/**\n * @param <<" + _DOC + ">> $count<<" + _WORDS + ">>\n * @return <<" + _GIVEN + ">>\n */\nfunction docs<<" + N + ">>(int $count): <<" + _NATIVE + ">> {\n    go($count, true); // TODO <<" + N + ">>\n}\n",
)
_RAW = f"{_DOC} || ' $count' || {_WORDS}"
_SAME = "Found redundant PHPDoc type annotation that repeats the native signature"
_DIFFERS = "Found misleading PHPDoc type annotation that disagrees with the native signature"
_SHOWN = "CASE k % 3 WHEN 0 THEN 'void' ELSE 'null|string' END"
_DOC_EVIDENCE = "'subject=docs' || " + N + " || '|annotation={}|native=' || {} || '|phpdoc=' || {} || '|reason=phpdoc-{}-native-type'"
DOC_FACTS = f"""
SELECT path, 'docs' || {N} AS subject, b + 4 AS line, '@param $count' AS annotation, 'int' AS native, {_DOC} AS doc_type, {_RAW} AS raw FROM ({DOCS})
UNION ALL SELECT path, 'docs' || {N}, b + 4, '@return', {_SHOWN}, {_GIVEN}, {_GIVEN} FROM ({DOCS})"""
DOC_FINDINGS = " UNION ALL ".join(
    [
        found("php.misleading-phpdoc-types", DOCS, "k % 5 = 1 AND k % 2 = 0", "b + 4", "0.75", _SAME, _DOC_EVIDENCE.format("@param $count", "'int'", _RAW, "repeats")),
        found("php.misleading-phpdoc-types", DOCS, "k % 5 IN (0, 2, 4)", "b + 4", "1.5", _DIFFERS, _DOC_EVIDENCE.format("@param $count", "'int'", _RAW, "disagrees-with")),
        found("php.misleading-phpdoc-types", DOCS, "k % 3 IN (0, 2)", "b + 4", "0.75", _SAME, _DOC_EVIDENCE.format("@return", _SHOWN, _GIVEN, "repeats")),
        found("php.misleading-phpdoc-types", DOCS, "k % 3 = 1", "b + 4", "1.5", _DIFFERS, _DOC_EVIDENCE.format("@return", _SHOWN, _GIVEN, "disagrees-with")),
    ]
)
_DOC_COMMENT = _sql("/**\n * @param <<" + _DOC + ">> $count<<" + _WORDS + ">>\n * @return <<" + _GIVEN + ">>\n */")
COMMENT_FACTS = f"""
SELECT path, CAST(0 AS INT) AS pos, CAST(2 AS INT) AS line, sha256('/* ' || body || ' */') AS hash FROM ({DOCS})
UNION ALL SELECT path, CAST(1 AS INT), b, sha256({_DOC_COMMENT}) FROM ({DOCS}) UNION ALL SELECT path, CAST(2 AS INT), b + 5, sha256('// TODO ' || {N}) FROM ({DOCS})"""

PHP_SOURCES = (CATCHES, FUNCTIONS, CALLS, TESTS, DOCS)
