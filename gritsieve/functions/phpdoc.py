"""PHPDoc types beside the native types of functions, methods and properties."""

from __future__ import annotations

import re

from .php_lexer import Token
from .php_parser import Node

_KINDS = ("Class", "Interface", "Trait", "Enum")


def _docs(read: list[Token]) -> dict[int, str]:
    """The doc comment right before a token, by that token's place."""
    out: dict[int, str] = {}
    doc = None
    for t in read:
        if t.kind == "doc":
            doc = t.text
        elif t.kind != "comment":
            if doc is not None:
                out[t.start] = doc
            doc = None
    return out


def _tags(doc: str) -> list[tuple[str, str]]:
    body = re.sub(r"^/\*\*|\*/$", "", doc.strip())
    lines = [re.sub(r"^\s*\*? ?", "", line).rstrip() for line in body.split("\n")]
    out: list[tuple[str, str]] = []
    for line in lines:
        m = re.match(r"\s*@(\S+)\s*(.*)", line)
        if m:
            out.append((m.group(1), m.group(2)))
        elif out and line.strip():
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
    return out


def _type_of(raw: str) -> str:
    """The leading type expression of a tag's text, brackets balanced."""
    depth = 0
    for i, c in enumerate(raw):
        depth += (c in "<([{") - (c in ">)]}")
        if c.isspace() and depth <= 0:
            return raw[:i]
    return raw


def native(t: Node | None) -> str | None:
    if t is None:
        return None
    if t.kind == "NullableType":
        return "null|" + (native(t.type) or "")
    if t.kind in ("UnionType", "IntersectionType"):
        return ("|" if t.kind == "UnionType" else "&").join(native(x) or "" for x in t.types)
    return t.name.lstrip("\\")


def entries(facts) -> list[tuple]:
    from .php_facts import utf8

    if facts.error is not None:
        return []
    docs = _docs(facts.tokens)
    rows: list[tuple] = []

    def note(tag: str, variable: str | None, line: int, own: str | None, raw: str) -> tuple | None:
        if not raw.strip():
            return None
        doc = _type_of(raw.strip())
        plain = re.fullmatch(r"\??\\?[A-Za-z_\x80-\xff][A-Za-z0-9_\\\x80-\xff]*(?:\|\\?[A-Za-z_\x80-\xff][A-Za-z0-9_\\\x80-\xff]*)*", doc)
        return (f"{tag} ${variable}" if variable is not None else tag, tag, variable, line, own, doc if plain or doc else None, raw.strip(), None if plain else doc)

    def function(f: Node, kind: str, subject: str) -> None:
        doc = docs.get(f.start)
        if doc is None:
            return
        tags = _tags(doc)
        found = []
        for p in f.params:
            for name, raw in tags:
                m = re.match(r"(?P<t>.*?)\s*(?:&|\.\.\.)?\$" + re.escape(p.var.name or "") + r"(?![A-Za-z0-9_])", raw) if name == "param" else None
                if m:
                    found.append(note("@param", p.var.name, p.line, native(p.type), raw))
                    break
        for name, raw in tags:
            if name == "return":
                found.append(note("@return", None, f.line, native(f.returns), raw))
                break
        found = [x for x in found if x is not None]
        if found:
            rows.append((kind, subject, f.line, facts.text.count("\n", 0, f.end) + 1, found))

    def visit(stmts: list[Node], namespace: str) -> None:
        for s in stmts:
            if s.kind == "Namespace":
                visit(s.stmts, s.parts["name"].name + "\\" if s.parts["name"] else "")
            elif s.kind == "Function":
                function(s, "function", namespace + s.parts["name"].name)
            elif s.kind in _KINDS:
                cls = namespace + s.parts["name"].name
                for m in s.stmts:
                    if m.kind == "ClassMethod":
                        function(m, "method", f"{cls}::{m.parts['name'].name}")
                    elif m.kind == "Property" and m.start in docs:
                        raw = next((r for n, r in _tags(docs[m.start]) if n == "var"), None)
                        for item in m.items if raw is not None else []:
                            x = note("@var", item.name, m.line, native(m.type), raw)
                            if x is not None:
                                rows.append(("property", f"{cls}::${item.name}", m.line, facts.text.count("\n", 0, m.end) + 1, [x]))
            elif s.kind in ("If", "Else", "ElseIf"):
                visit([c for c in s.children() if c.kind in ("Function", *_KINDS, "If", "Else", "ElseIf")], namespace)

    visit(facts.statements, "")
    del visit  # which holds itself, and with it the source
    rows.sort(key=lambda r: (r[2], r[1]))
    return [(k, utf8(s), line, end, [tuple(utf8(v) if isinstance(v, str) else v for v in x) for x in found]) for k, s, line, end, found in rows]
