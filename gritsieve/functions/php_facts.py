"""Structural facts of one PHP file, from one lexing and one parse."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterable
from operator import attrgetter

from .php_lexer import PhpSyntaxError, comments, tokens
from .php_parser import Node, find, parse

DEBUG = frozenset(["dd", "print_r", "ray", "var_dump"])
GENERIC = frozenset(
    "exception errorexception logicexception runtimeexception domainexception invalidargumentexception lengthexception "
    "outofrangeexception overflowexception rangeexception underflowexception unexpectedvalueexception".split()
)
BAGS = frozenset("body config data json obj parsed payload record result value".split())
ERROR_NAMES = frozenset("detail details error message reason".split())
STATUS = frozenset(["ok", "status", "success"])
PAYLOAD = frozenset("data detail details error errors info message payload reason result results rows".split())
PREVIOUS_AT = 2
SHAPE_DEPTH = 5
_TEST_PATH = re.compile(r"(?:^|/)(?:tests?|spec)(?:/|$)|(?:Test|TestCase)\.php$", re.I)
_NUMERIC = re.compile(r"[ \t\n\r\v\f]*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t\n\r\v\f]*\Z")
_START = attrgetter("start")
_CLASSES = ("Class", "Interface", "Trait", "Enum")
_CALLABLES = ("Function", "ClassMethod")


def lower(s: str) -> str:
    """ASCII lower case."""
    return s.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)}


def utf8(s: str | None) -> str | None:
    """A value of Latin-1 source as the text it stands for."""
    return None if s is None else s.encode("latin-1", "replace").decode("utf-8", "replace")


def normalized_number(value: str) -> str | None:
    """The JSON of a numeric string's number, or None if it isn't numeric."""
    if not _NUMERIC.match(value):
        return None
    v = value.strip()
    if re.fullmatch(r"[+-]?[0-9]+", v) and -(2**63) <= int(v) < 2**63:
        return str(int(v))
    x = float(v)
    if abs(x) < 1e15 and x == int(x):
        return "-0" if x == 0 and str(x)[0] == "-" else str(int(x))
    return json.dumps(x) if abs(x) != float("inf") else None


def default_kind(e: Node | None) -> str | None:
    if e is None:
        return None
    if e.kind == "ConstFetch":
        return {"null": "null", "false": "false"}.get(lower(e.name))
    if e.kind in ("LNumber", "DNumber"):
        return "zero" if e.value == 0 else None
    if e.kind == "String":
        return "empty-string" if e.value == "" else None
    return "empty-array" if e.kind == "Array" and not e.items else None


def uses(e: Node | None, name: str) -> bool:
    return e is not None and any(n.kind == "Variable" and n.name == name for n in e.walk())


def is_message_call(e: Node | None, variable: str | None) -> bool:
    return (
        e is not None and e.kind == "MethodCall" and e.var.kind == "Variable" and e.var.name == variable and variable is not None
        and e.parts["name"].kind == "Identifier" and lower(e.parts["name"].name) == "getmessage" and not e.args
    )


class Facts:
    """All facts of a source; ``row()`` gives them in the order of the facts schema."""

    def __init__(self, path: str, text: str):
        self.path = path
        self.text = text.encode("utf-8", "surrogatepass").decode("latin-1")
        self.error: str | None = None
        try:
            self.tokens = tokens(self.text)
            self.statements = parse(self.text, self.tokens)
        except PhpSyntaxError as e:
            self.statements, self.error = [], str(e)
            self.tokens = tokens(self.text, strict=False)
        self.nodes: dict[str, list[tuple[int, Node]]] = {}
        for i, n in enumerate(n for top in self.statements for n in top.walk()):
            self.nodes.setdefault(n.kind, []).append((i, n))
        self.namespace, self.imports = "", {"class": {}, "function": {}}
        for n in self.all("UseItem"):
            if n.type in self.imports:
                self.imports[n.type][lower(n.alias)] = n.target

    def all(self, *kinds: str) -> list[Node]:
        """All nodes of these kinds, in the order of :func:`find`."""
        if len(kinds) == 1:
            return [n for _, n in self.nodes.get(kinds[0], ())]
        return [n for _, n in sorted((x for k in kinds for x in self.nodes.get(k, ())), key=lambda x: x[0])]

    def column(self, n: Node) -> int:
        return n.start - self.text.rfind("\n", 0, n.start)

    def source(self, n: Node) -> str:
        return self.text[n.start : n.end]

    def resolved(self, n: Node, kind: str) -> str:
        name = n.name
        if name.startswith("\\"):
            return name[1:]
        first, slash, rest = name.partition("\\")
        table = self.imports["class" if slash else kind]
        return table.get(lower(first), first) + slash + rest

    def printed(self, stmts: list[Node]) -> str:
        """Statements as tokens with set spacing, so that layout and comments don't count."""
        if not stmts:
            return ""
        out, last, before = [], "", ""
        start, end = stmts[0].start, stmts[-1].end
        for t in self.tokens[bisect_left(self.tokens, start, key=_START) :]:
            if t.end > end:
                break
            if t.kind in ("comment", "doc"):
                continue
            s = t.text.strip()
            if t.kind == "str" and t.quote in ("'", '"'):
                s = "'" + t.body.replace("\\'", "'").replace("'", "\\'") + "'" if t.quote == "'" or "\\" not in t.body else s
            signed = last in ("+", "-", "&", "...") and (before in _OPENERS or not before)
            label = s == ":" and before in ("(", ",") and (last[:1].isalpha() or last[:1] == "_")
            tight = not out or signed or label or s in (")", "]", ",", ";", "(", "[", "->", "?->", "::", "++", "--") or last in ("(", "[", "->", "?->", "::", "!", "@", "~", "$")
            if s in ("(", "[") and last in _OPENERS and last not in ("(", "[") and not signed:
                tight = False
            out.append(s if tight else ("\n" if last in (";", "{", "}") else " ") + s)
            before, last = last, s
        return "".join(out)

    # -- facts

    def functions(self) -> list[tuple]:
        out: list[tuple] = []

        def collect(stmts: list[Node], cls: str | None, namespace: str | None) -> None:
            for s in stmts:
                if s.kind == "Namespace":
                    collect(s.stmts, cls, s.parts["name"].name if s.parts["name"] else None)
                elif s.kind == "Function":
                    out.append(self.function(s, None, None, namespace))
                elif s.kind in _CLASSES:
                    name = s.parts["name"].name if s.parts["name"] else None
                    kind = "abstract-class" if s.kind == "Class" and "abstract" in s.flags else lower(s.kind)
                    for m in s.stmts:
                        if m.kind == "ClassMethod" and m.stmts is not None:
                            out.append(self.function(m, name, kind, namespace))
                    for m in s.stmts:
                        if m.kind == "ClassMethod" and m.stmts:
                            collect(m.stmts, name or cls, namespace)
                else:
                    nested(s, cls, namespace)

        def nested(s: Node, cls: str | None, namespace: str | None) -> None:
            for value in s.parts.values():
                if isinstance(value, list) and value and all(isinstance(v, Node) and v.kind in _STATEMENTS for v in value):
                    collect(value, cls, namespace)

        collect(self.statements, None, None)
        del collect, nested  # which hold each other, and with them the source
        return out

    def function(self, f: Node, cls: str | None, kind: str | None, namespace: str | None) -> tuple:
        name = f.parts["name"].name
        params = ["$" + (p.var.name or "") for p in f.params]
        signature = (lower(cls) + "::" if cls is not None else "") + f"{lower(name)}({len(params)})"
        stmts = f.stmts or []
        constant = default_kind(stmts[0].expr) if len(stmts) == 1 and stmts[0].kind == "Return" else None
        return (
            utf8(name), utf8(signature), f.line, utf8(self.printed(stmts)), [utf8(p) for p in params], self.pass_through(stmts, params), constant,
            self.magic_numbers(stmts), kind, utf8(cls), utf8(namespace),
        )

    def pass_through(self, stmts: list[Node], params: list[str]) -> tuple | None:
        if not params or len(stmts) != 1 or stmts[0].kind != "Return" or stmts[0].expr is None or stmts[0].expr.kind != "FuncCall":
            return None
        call = stmts[0].expr
        if call.parts["name"].kind != "Name":
            return None
        args = []
        for a in call.args:
            if a.kind != "Arg" or a.parts["name"] is not None or a.unpack or a.value.kind != "Variable" or a.value.name is None:
                return None
            args.append("$" + a.value.name)
        return (utf8(call.parts["name"].name.lstrip("\\")), [utf8(a) for a in args]) if args == params else None

    def magic_numbers(self, stmts: list[Node]) -> list[tuple]:
        found: dict[tuple, tuple] = {}

        def visit(n: Node, parent: Node | None) -> None:
            if n.kind in _CLASSES:
                return
            value = kind = None
            if n.kind == "String":
                if not (parent is not None and parent.kind == "ArrayItem" and parent.key is n):
                    value, kind = n.value, "numeric-string"
            elif n.kind in ("LNumber", "DNumber"):
                if not (parent is not None and parent.kind == "Unary" and parent.op in "+-"):
                    value, kind = self.source(n), "numeric"
            elif n.kind == "Unary" and n.op in "+-" and n.expr.kind in ("LNumber", "DNumber"):
                value, kind = self.source(n), "numeric"
            if value is not None and (norm := normalized_number(value)) is not None:
                row = (utf8(value), norm, kind, n.line, self.column(n))
                found[(n.line, row[4], kind, value)] = row
            for v in n.parts.values():
                if v.__class__ is Node:
                    visit(v, n)
                elif v.__class__ is list:
                    for c in v:
                        if c.__class__ is Node:
                            visit(c, n)

        for s in stmts:
            visit(s, None)
        del visit
        return sorted(found.values(), key=lambda r: (r[3], r[4], r[0]))

    def catches(self) -> list[tuple]:
        out = []
        for c in self.all("Catch"):
            variable = c.var.name if c.var is not None else None
            names, defaults, returned, thrown = set(), set(), set(), []
            for n in find(c.stmts, "FuncCall", "Print", "Echo", "Return", "Throw"):
                if n.kind == "FuncCall":
                    if n.parts["name"].kind == "Name":
                        names.add(lower(n.parts["name"].name).lstrip("\\"))
                elif n.kind in ("Print", "Echo"):
                    names.add(lower(n.kind))
                elif n.kind == "Return":
                    if (kind := default_kind(n.expr)) is not None:
                        defaults.add(kind)
                    if variable is not None and n.expr is not None:
                        if is_message_call(n.expr, variable):
                            returned.add("caught-message")
                        elif n.expr.kind == "Cast" and n.expr.type == "string" and uses(n.expr.expr, variable):
                            returned.add("caught-string")
                else:
                    thrown.append(self.thrown(n, variable))
            has = {n.kind for n in find(c.stmts, "Throw", "Return")}
            out.append((c.line, utf8(self.printed(c.stmts)), len(c.stmts), "Throw" in has, "Return" in has, [utf8(x) for x in sorted(names)], sorted(defaults), sorted(returned), thrown))
        return out

    def thrown(self, throw: Node, variable: str | None) -> tuple:
        new = throw.expr
        if new is None or new.kind != "New":
            return (None, False, False, False)
        cls = new.cls.name.lstrip("\\") if new.cls.kind == "Name" else None
        previous = used = False
        for i, a in enumerate(new.args):
            if variable is None or a.kind != "Arg" or not uses(a.value, variable):
                continue
            used = True
            label = a.parts["name"]
            previous |= lower(label.name) == "previous" if label is not None else i == PREVIOUS_AT
        return (utf8(cls), cls is not None and lower(cls) in GENERIC, previous, used)

    def debug_calls(self) -> list[tuple]:
        calls = [(lower(n.parts["name"].name).lstrip("\\"), n.line) for n in self.all("FuncCall") if n.parts["name"].kind == "Name"]
        return [c for c in calls if c[0] in DEBUG]

    def looks_like_test(self) -> bool:
        if self.error is not None:
            return False
        if _TEST_PATH.search(self.path):
            return True
        for c in self.all("Class"):
            for e in c.extends[:1]:
                name = lower(e.name).lstrip("\\")
                if name in ("phpunit\\framework\\testcase", "testcase") or name.endswith("\\testcase"):
                    return True
        return False

    def test_calls(self, looks: bool) -> tuple:
        if not looks:
            return (False, 0, 0, 0, 0)
        tests = set()
        for m in self.all("ClassMethod"):
            name = m.parts["name"].name
            marked = any((a := lower(x.parts["name"].name).lstrip("\\")) == "test" or a.endswith("\\test") for g in m.attrs for x in g.attrs)
            if marked or re.match(r"test[A-Z0-9_][A-Za-z0-9_]*\Z", name):
                tests.add((m.line, name))
        mocks = assertions = expectations = 0
        for n in self.all("MethodCall", "StaticCall"):
            if n.parts["name"].kind != "Identifier":
                continue
            raw = n.parts["name"].name
            name = lower(raw)
            if name in ("createmock", "createconfiguredmock", "getmockbuilder", "prophesize"):
                mocks += 1
            elif n.kind == "StaticCall" and name == "mock" and n.cls.kind == "Name" and lower(n.cls.name).lstrip("\\") == "mockery":
                mocks += 1
            own = n.var.kind == "Variable" and n.var.name == "this" if n.kind == "MethodCall" else n.cls.kind == "Name" and lower(n.cls.name) in ("self", "static")
            if own and (re.match("assert[A-Z]", raw) or name in ("expectexception", "expectexceptioncode", "expectexceptionmessage", "expectexceptionmessagematches", "expectexceptionobject", "expectnottoperformassertions")):
                assertions += 1
            if n.kind == "MethodCall" and name in ("expects", "shouldreceive", "shouldhavereceived"):
                expectations += 1
        return (True, len(tests), mocks, assertions, expectations)

    def type_escapes(self) -> tuple:
        mixed = 0
        for f in self.all(*_CALLABLES):
            kinds = [p.type for p in f.params] + [f.returns]
            mixed += sum(k is not None and k.kind == "Identifier" and lower(k.name) == "mixed" for k in kinds)
        return (mixed, sum(c.type in ("int", "string", "array", "object", "float", "bool") for c in self.all("Cast")))

    def array_casts(self) -> list[tuple]:
        out = []
        for a in self.all("Assign"):
            if a.var.kind != "Variable" or a.var.name is None or lower(a.var.name) not in BAGS:
                continue
            kind = None
            e = a.expr
            if e.kind == "Cast" and e.type == "array":
                kind = "array-cast"
            elif e.kind == "FuncCall" and e.parts["name"].kind == "Name" and lower(self.resolved(e.parts["name"], "function")) == "json_decode":
                for i, arg in enumerate(x for x in e.args if x.kind == "Arg"):
                    label = arg.parts["name"]
                    if (lower(label.name) == "associative") if label is not None else i == 1:
                        kind = "json-decode-assoc" if arg.value.kind == "ConstFetch" and lower(arg.value.name) == "true" else None
                        break
            if kind is not None:
                out.append((utf8("$" + a.var.name), kind, e.line, self.column(e)))
        return sorted(out, key=lambda r: (r[2], r[3], r[0]))

    def envelopes(self) -> list[tuple]:
        out = []
        for a in self.all("Array"):
            key = value = None
            payload = set()
            for item in a.items:
                if item.key is None or item.key.kind != "String":
                    continue
                k = lower(item.key.value)
                v = lower(item.value.name) if item.value.kind == "ConstFetch" else ""
                if key is None and v in ("true", "false") and k in STATUS:
                    key, value = k, v
                elif k in PAYLOAD:
                    payload.add(k)
            if key is not None and payload:
                out.append((key, value, sorted(payload), self.envelope_kind(a), a.line, self.column(a)))
        return sorted(out, key=lambda r: (r[4], r[5], r[0]))

    def envelope_kind(self, a: Node) -> str:
        p = a.parent
        if p is not None and p.kind == "Return":
            return "returned-generic-status-envelope"
        if p is not None and p.kind == "Arg":
            call = p.parent
            if call.kind == "MethodCall" and call.parts["name"].kind == "Identifier" and lower(call.parts["name"].name) == "json":
                return "json-generic-status-envelope"
            if call.kind == "New" and call.cls.kind == "Name" and lower(self.resolved(call.cls, "class")).endswith("jsonresponse"):
                return "json-generic-status-envelope"
        return "assigned-generic-status-envelope"

    def normalizations(self) -> list[tuple]:
        rows = []
        for c in self.all("Catch"):
            variable = c.var.name if c.var is not None else None
            if variable is None:
                continue
            for n in find(c.stmts, "Return", "Assign", "ArrayItem"):
                owner = n.parent
                while owner is not None and owner.kind != "Catch":
                    owner = owner.parent
                if owner is not c:
                    continue
                if n.kind == "Return":
                    prefix, e = "returned-", n.expr
                elif n.kind == "Assign":
                    if n.var.kind != "Variable" or n.var.name is None or lower(n.var.name) not in ERROR_NAMES:
                        continue
                    prefix, e = "assigned-", n.expr
                else:
                    if n.key is None or n.key.kind != "String" or lower(n.key.value) not in ERROR_NAMES:
                        continue
                    prefix, e = "property-", n.value
                kind = self.caught_kind(e, variable, c)
                if kind is not None:
                    rows.append((prefix + kind, e.line, self.column(e)))
        rows.sort(key=lambda r: (r[1], r[2], r[0]))
        return list(dict.fromkeys(rows))

    def caught_kind(self, e: Node | None, variable: str, c: Node) -> str | None:
        if is_message_call(e, variable) and refers(e.var, variable, c):
            return "caught-message"
        if e is not None and e.kind == "Cast" and e.type == "string" and any(n.kind == "Variable" and n.name == variable and refers(n, variable, c) for n in e.expr.walk()):
            return "caught-string"
        return None

    def mock_setups(self, looks: bool) -> list[tuple]:
        if not looks:
            return []
        out = []
        for m in self.all("ClassMethod"):
            alive = set()
            for s in m.stmts or []:
                if s.kind != "Expression":
                    continue
                e = s.expr
                if e.kind == "Assign" and e.var.kind == "Variable" and e.var.name is not None:
                    made = e.expr
                    if made.kind == "MethodCall" and made.parts["name"].kind == "Identifier" and lower(made.parts["name"].name) == "createmock" and made.var.kind == "Variable" and made.var.name == "this":
                        alive.add(e.var.name)
                    else:
                        alive.discard(e.var.name)
                label = None
                if configured(e) in alive and configured(e) is not None:
                    label = "method|willReturn"
                else:
                    names = {lower(x.parts["name"].name) for x in find([e], "MethodCall") if x.parts["name"].kind == "Identifier"}
                    if {"getmockbuilder", "getmock"} <= names:
                        label = "getMockBuilder|getMock"
                if label is not None:
                    out.append((label, f"{label}::{shape(s, SHAPE_DEPTH)}", s.line))
        return sorted(out, key=lambda r: (r[2], r[1]))

    def phpdoc(self) -> list[tuple]:
        from .phpdoc import entries

        return entries(self)

    def parser(self) -> tuple:
        classes, functions = (len([c for c in self.all(*_CLASSES)]), len(self.all("Function"))) if self.error is None else (0, 0)
        return (True, classes, functions, self.error)

    def row(self, names: Iterable[str] | None = None) -> tuple:
        """The path and the facts of these names, or all."""
        out: list = [self.path]
        for name in NAMES if names is None else names:
            if name == "comments":
                out.append([(utf8(t), line) for t, line in comments(self.text, self.tokens)])
            else:
                out.append(getattr(self, name)(self.looks_like_test()) if name in _OF_TESTS else getattr(self, name)())
        return tuple(out)

    def release(self) -> None:
        """Cut the links from nodes to their parents, so that the source goes at once and not when cycles are next collected."""
        for of_kind in self.nodes.values():
            for _, n in of_kind:
                n.parent = None


#: All facts, in the order of the schema; those of tests take whether the file is one.
NAMES = ("comments", "functions", "catches", "parser", "phpdoc", "debug_calls", "test_calls", "type_escapes", "envelopes", "array_casts", "normalizations", "mock_setups")
_OF_TESTS = ("test_calls", "mock_setups")
#: Tokens after which an operand begins, so that a bracket opens a list or group and a sign is one.
_OPENERS = frozenset(
    "( [ , = => return echo print ? : && || . * / % + - < > == === != !== <= >= <=> ?? ??= += -= *= /= .= ; { } & | ^ << >> and or xor "
    "if for foreach while switch catch match function fn use as case throw yield elseif".split()
)
_STATEMENTS = frozenset(
    "Namespace Use Function Class Interface Trait Enum Return Echo Expression If ElseIf Else For Foreach While Do Switch Case TryCatch Catch Finally "
    "Global Static Unset Break Continue Goto Label Const Declare InlineHTML".split()
)


def refers(n: Node, variable: str, c: Node) -> bool:
    """Whether a variable node inside a catch means the caught exception, given closures and inner catches on the way."""
    p = n.parent
    while p is not None:
        if p is c:
            return True
        if p.kind == "Catch":
            if p.var is not None and p.var.name == variable:
                return False
        elif p.kind in ("Closure", "ArrowFunction"):
            if any(x.var.name == variable for x in p.params):
                return False
            if p.kind == "Closure" and not any(u.var.name == variable for u in p.uses):
                return False
        elif p.kind in _CALLABLES:
            return False
        p = p.parent
    return False


def configured(e: Node) -> str | None:
    """The variable at the root of ``$m->…->method(…)->willReturn(…)``."""

    def named(n: Node, name: str) -> bool:
        return n.kind == "MethodCall" and n.parts["name"].kind == "Identifier" and lower(n.parts["name"].name) == name

    if not (named(e, "willreturn") and named(e.var, "method")):
        return None
    root = e.var.var
    while root.kind == "MethodCall":
        root = root.var
    return root.name if root.kind == "Variable" else None


def shape(n: Node, depth: int) -> str:
    """Node kinds down to a depth, names and values left out."""
    if depth <= 1:
        return n.kind
    inner = ",".join(shape(c, depth - 1) for c in n.children())
    return f"{n.kind}({inner})" if inner else n.kind
