"""A compact indented encoding of JSON data with tables for uniform lists, and its reader."""

from __future__ import annotations

import json
import re
from typing import Any

_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")


def _scalar(v: Any) -> str:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, (int, float)):
        return json.dumps(v)
    safe = v and v == v.strip() and v not in ("true", "false", "null") and not _NUMBER.match(v) and not re.search(r'[\n\r\t"\\,:\[\]{}#-]', v)
    return v if safe else json.dumps(v, ensure_ascii=False)


def _key(k: str) -> str:
    return k if _BARE.match(k) else json.dumps(k, ensure_ascii=False)


def _flat(v: Any) -> bool:
    return not isinstance(v, (dict, list))


def _lines(key: str | None, v: Any, depth: int) -> list[str]:
    pad, name = "  " * depth, "" if key is None else _key(key)
    if _flat(v):
        return [f"{pad}{name}: {_scalar(v)}" if key is not None else pad + _scalar(v)]
    if isinstance(v, dict):
        if not v:
            return [f"{pad}{name}: {{}}" if key is not None else pad + "{}"]
        head = [f"{pad}{name}:"] if key is not None else []
        return head + [line for k, x in v.items() for line in _lines(k, x, depth + (key is not None))]
    if all(_flat(x) for x in v):
        return [f"{pad}{name}[{len(v)}]:" + (" " + ",".join(map(_scalar, v)) if v else "")]
    if all(isinstance(x, dict) and x and list(x) == list(v[0]) and all(map(_flat, x.values())) for x in v):
        head = f"{pad}{name}[{len(v)}]{{{','.join(map(_key, v[0]))}}}:"
        return [head] + ["  " * (depth + 1) + ",".join(map(_scalar, x.values())) for x in v]
    out = [f"{pad}{name}[{len(v)}]:"]
    for x in v:
        out += ["  " * (depth + 1) + "-"] + _lines(None, x, depth + 2)
    return out


def encode(data: Any) -> str:
    return "\n".join(_lines(None, data, 0))


def _split(s: str) -> list[str]:
    out, now, quoted, skip = [], "", False, False
    for c in s:
        if quoted:
            now += c
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = False
        elif c == ",":
            out.append(now)
            now = ""
        else:
            quoted = c == '"'
            now += c
    return [*out, now]


def _value(s: str) -> Any:
    s = s.strip()
    if s.startswith('"'):
        return json.loads(s)
    if s in ("null", "true", "false") or _NUMBER.match(s):
        return json.loads(s)
    return {} if s == "{}" else s


_HEAD = re.compile(r'("(?:[^"\\]|\\.)*"|[A-Za-z_][A-Za-z0-9_.]*|)(?:\[(\d+)\](?:\{(.*)\})?)?:(?: (.*))?\Z', re.S)


def decode(text: str) -> Any:
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.split("\n") if x.strip()]
    at = 0

    def block(depth: int) -> Any:
        nonlocal at
        if at >= len(lines) or lines[at][0] < depth:
            return {}
        if not _HEAD.match(lines[at][1]):
            at += 1
            return _value(lines[at - 1][1])
        out: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == depth and (m := _HEAD.match(lines[at][1])):
            at += 1
            name, size, columns, rest = m.groups()
            key = json.loads(name) if name.startswith('"') else name
            if size is None:
                v = _value(rest) if rest is not None else block(depth + 2)
            elif columns is not None:
                names = [_value(c) for c in _split(columns)]
                v = []
                for _ in range(int(size)):
                    v.append(dict(zip(names, map(_value, _split(lines[at][1])), strict=True)))
                    at += 1
            elif rest is not None or int(size) == 0:
                v = [_value(x) for x in _split(rest)] if rest else []
            else:
                v = []
                for _ in range(int(size)):
                    at += 1  # the dash
                    v.append(block(depth + 4))
            if name == "" and size is not None:
                return v
            out[key] = v
        return out

    return block(0)
