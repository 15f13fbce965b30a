"""Tokens of PHP source. Works on bytes decoded as Latin-1, so every offset is a byte offset."""

from __future__ import annotations

import re
from typing import NamedTuple


class PhpSyntaxError(Exception):
    """Source that isn't PHP."""


class Token(NamedTuple):
    kind: str  # html, var, name, num, str, tpl (interpolated), cast, op, comment, doc, end
    text: str
    start: int
    line: int
    end: int
    body: str = ""  # of str and tpl: the raw inner text
    quote: str = ""  # of str and tpl: ' " ` <<< or <<<'


_LABEL = r"[A-Za-z_\x7f-\xff][A-Za-z0-9_\x7f-\xff]*"
_RULES = re.compile(
    rf"""(?P<ws>[ \t\r\n]+)
    |(?P<attr>\#\[)
    |(?P<line>(?://|\#)(?:(?!\?>)[^\r\n])*)
    |(?P<close>\?>(?:\r\n|\n)?)
    |(?P<heredoc><<<[ \t]*(?P<q>['"]?)(?P<tag>{_LABEL})(?P=q)\r?\n)
    |(?P<var>\${_LABEL})
    |(?P<cast>\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)[ \t]*\))
    |(?P<num>0[xX][0-9A-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?|[0-9][0-9_]*\.?(?:[eE][+-]?[0-9]+)?(?![0-9]))
    |(?P<name>\\?{_LABEL}(?:\\{_LABEL})*)
    |(?P<single>[bB]?'(?:[^'\\]|\\.)*')
    |(?P<op><=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|=>|->|::|\+\+|--|&&|\|\||\?\?|\*\*|<<|>>|==|!=|<>|<=|>=|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|[-+*/%=<>!.,;:?(){{}}\[\]&|^~@$\\])
    """,
    re.X | re.S,
)
_OPEN = re.compile(r"<\?(?:php(?=\s|\Z)|=)", re.I)
_TICK = {'"': re.compile(r'"((?:[^"\\]|\\.)*)"', re.S), "`": re.compile(r"`((?:[^`\\]|\\.)*)`", re.S)}
_INTERPOLATED = re.compile(r"(?<!\\)(?:\\\\)*(?:\$[A-Za-z_\x7f-\xff]|\{\$|\$\{)")


#: Kinds that hold no line end.
_PLAIN = {"var": "var", "name": "name", "op": "op", "num": "num", "cast": "cast", "attr": "op"}


def tokens(text: str, strict: bool = True) -> list[Token]:
    """All tokens but white space, comments included. Not strict: what can't be read ends the list."""
    out: list[Token] = []
    at, line, size = 0, 1, len(text)

    def add(kind: str, end: int, **more: str) -> None:
        nonlocal at, line
        raw = text[at:end]
        out.append(Token(kind, raw, at, line, end, **more))
        line += raw.count("\n")
        at = end

    opened, match, new = False, _RULES.match, tuple.__new__
    while at < size:
        if not opened:
            m = _OPEN.search(text, at)
            if not m:
                add("html", size)
                break
            if m.start() > at:
                add("html", m.start())
            echo = m.group() == "<?="
            line += text.count("\n", at, m.end())
            at = m.end()
            if echo:
                out.append(Token("name", "echo", m.start(), line, at))
            opened = True
            continue
        c = text[at]
        if c == "/" and text.startswith("/*", at):
            end = text.find("*/", at + 2)
            add("doc" if text[at + 2 : at + 3] == "*" and text[at + 3 : at + 4].isspace() else "comment", size if end < 0 else end + 2)
            continue
        m = match(text, at)
        if m is not None and (plain := _PLAIN.get(m.lastgroup)) is not None:
            end = m.end()
            out.append(new(Token, (plain, m.group(), at, line, end, "", "")))
            at = end
            continue
        if m is None and c in _TICK or (m is None and c in "bB" and text[at + 1 : at + 2] == '"'):
            q = c if c in _TICK else '"'
            s = _TICK[q].match(text, at + (c not in _TICK))
            if s is None:
                if strict:
                    raise PhpSyntaxError(f"unterminated string on line {line}")
                break
            kind = "tpl" if q == "`" or _INTERPOLATED.search(s.group(1)) else "str"
            add(kind, s.end(), body=s.group(1), quote=q)
            continue
        if m is None:
            if strict:
                raise PhpSyntaxError(f"unexpected character on line {line}")
            break
        kind = m.lastgroup if m.lastgroup not in ("q", "tag") else "heredoc"
        if kind == "ws":
            line += m.group().count("\n")
            at = m.end()
        elif kind == "line":
            add("comment", m.end())
        elif kind == "close":
            add("op", m.end())
            opened = False
        elif kind == "heredoc":
            stop = re.compile(rf"^([ \t]*){m.group('tag')}(?![A-Za-z0-9_\x7f-\xff])", re.M).search(text, m.end())
            if stop is None:
                if strict:
                    raise PhpSyntaxError(f"unterminated heredoc on line {line}")
                break
            body = text[m.end() : max(m.end(), stop.start() - 1)].removesuffix("\r")
            if stop.group(1):
                body = re.sub(rf"^{re.escape(stop.group(1))}", "", body, flags=re.M)
            raw = m.group("q") == "'"
            add("tpl" if not raw and _INTERPOLATED.search(body) else "str", stop.end(), body=body, quote="<<<'" if raw else "<<<")
        else:
            add("str", m.end(), body=m.group()[m.group().index("'") + 1 : -1], quote="'")
    return out


def comments(text: str, read: list[Token] | None = None) -> list[tuple[str, int]]:
    """(comment, first line) pairs of a source, also if it doesn't parse, and of its tokens if they are known."""
    return [(t.text, t.line) for t in (tokens(text, strict=False) if read is None else read) if t.kind in ("comment", "doc")]


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f", "\\": "\\", "$": "$"}


def unescape(body: str, quote: str) -> str:
    """The value of a string literal without interpolation."""
    if quote == "<<<'":
        return body
    if quote == "'":
        return re.sub(r"\\([\\'])", r"\1", body)

    def one(m: re.Match) -> str:
        s = m.group(1)
        if s in _ESCAPES:
            return _ESCAPES[s]
        if s == quote:
            return s
        if s[0] == "x":
            return chr(int(s[1:], 16))
        if s[0] == "u":
            return chr(int(s[2:-1], 16)).encode("utf-8", "replace").decode("latin-1")
        return chr(int(s, 8) & 255) if s[0] in "01234567" else m.group()

    return re.sub(r"\\(x[0-9A-Fa-f]{1,2}|u\{[0-9A-Fa-f]+\}|[0-7]{1,3}|.)", one, body, flags=re.S)
