"""Explicit schemas of files, facts and findings."""

from __future__ import annotations

from pyspark.sql import types as T


def of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


LOCATION = "struct<path: string, line: int, column: int>"
#: Emission order: phase (0 file, 1 directory, 2 repository), file or directory, rule, key, place in a fact, place inside it.
ORD = "struct<phase: int, unit: string, rule: int, key: string, a: bigint, b: bigint>"
OCCURRENCE = "struct<fingerprint: string, path: string, line: int, column: int>"
FINDING = f"rule_id string, family string, severity string, scope string, message string, evidence array<string>, score double, locations array<{LOCATION}>, path string, ord {ORD}"
FINDING_COLUMNS = ["rule_id", "family", "severity", "scope", "message", "evidence", "score", "locations", "path", "ord"]
FILE = "path string, extension string, language_id string, text string, line_count int, logical_line_count int, content_hash string"
COMMENTS = "array<struct<text: string, line: int>>"
MAGIC = "array<struct<value: string, normalized: string, kind: string, line: int, column: int>>"
FUNCTIONS = (
    "array<struct<name: string, signature: string, line: int, body: string, params: array<string>, pass_through: struct<callee: string, args: array<string>>, "
    f"constant_return: string, magic_numbers: {MAGIC}, class_kind: string, class_name: string, namespace_name: string>>"
)
CATCHES = (
    "array<struct<line: int, body: string, statement_count: int, has_throw: boolean, has_return: boolean, call_names: array<string>, default_return_kinds: array<string>, "
    "returned_caught_value_kinds: array<string>, thrown: array<struct<class: string, is_generic: boolean, preserves_previous: boolean, uses_caught: boolean>>>>"
)
PHPDOC = (
    "array<struct<kind: string, subject: string, line: int, end_line: int, annotations: array<struct<annotation: string, tag: string, variable: string, line: int, "
    "native: string, doc_type: string, raw: string, extended: string>>>>"
)
FACTS = (
    f"path string, comments {COMMENTS}, functions {FUNCTIONS}, catches {CATCHES}, parser struct<available: boolean, class_count: int, function_count: int, error: string>, phpdoc {PHPDOC}, "
    "debug_calls array<struct<name: string, line: int>>, test_calls struct<looks_like_test: boolean, tests: int, mocks: int, assertions: int, expectations: int>, "
    "type_escapes struct<mixed: int, casts: int>, envelopes array<struct<key: string, value: string, payload: array<string>, kind: string, line: int, column: int>>, "
    "array_casts array<struct<variable: string, kind: string, line: int, column: int>>, normalizations array<struct<kind: string, line: int, column: int>>, "
    "mock_setups array<struct<label: string, fingerprint: string, line: int>>"
)
