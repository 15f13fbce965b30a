"""A recursive-descent and precedence-climbing parser of PHP 8 source into plain nodes with parent links."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .php_lexer import PhpSyntaxError, Token, tokens, unescape


class Node:
    """``kind``, byte span, line, parent, and named parts in source order."""

    __slots__ = ("end", "kind", "line", "parent", "parts", "start")

    def __init__(self, kind: str, start: Token | Node, **parts):
        self.kind, self.start, self.line, self.parts, self.parent = kind, start.start, start.line, parts, None
        self.end = start.end

    def __getattr__(self, name: str):
        try:
            return self.parts[name]
        except KeyError:
            return None

    def walk(self) -> Iterator[Node]:
        """This node and all below it, parents first, in source order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            below = []
            for value in node.parts.values():
                if value.__class__ is Node:
                    below.append(value)
                elif value.__class__ is list:
                    below += [v for v in value if v.__class__ is Node]
            below.reverse()
            stack += below

    def children(self) -> Iterator[Node]:
        for value in self.parts.values():
            if isinstance(value, Node):
                yield value
            elif isinstance(value, list):
                yield from (v for v in value if isinstance(v, Node))


def find(nodes: list[Node], *kinds: str) -> list[Node]:
    return [n for top in nodes for n in top.walk() if n.kind in kinds]


_BINARY = {
    "or": 1, "xor": 2, "and": 3, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12, "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13,
    "<": 14, "<=": 14, ">": 14, ">=": 14, ".": 15, "<<": 16, ">>": 16, "+": 17, "-": 17, "*": 18, "/": 18, "%": 18, "instanceof": 20, "**": 21,
}
_ASSIGN = frozenset("= += -= *= /= .= %= &= |= ^= <<= >>= **= ??=".split())
_TERNARY, _ASSIGNING, _UNARY = 6, 5, 19
_MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
_CASTS = {"integer": "int", "boolean": "bool", "double": "float", "real": "float", "binary": "string"}
_STOP = frozenset([";", ")", "]", "}", ",", ":", "=>", "?>", "end"])


class _Parser:
    def __init__(self, text: str, read: list[Token] | None = None):
        self.text = text
        self.tokens = [t for t in (tokens(text) if read is None else read) if t.kind not in ("comment", "doc")]
        last = self.tokens[-1] if self.tokens else Token("end", "", 0, 1, 0)
        self.tokens.append(Token("end", "", last.end, last.line, last.end))
        self.at = 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, ahead: int = 1) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def is_op(self, *texts: str) -> bool:
        t = self.tokens[self.at]
        return t.kind == "op" and (t.text in texts or (t.text[:2] == "?>" and "?>" in texts))

    def is_word(self, *words: str) -> bool:
        t = self.tokens[self.at]
        return t.kind == "name" and t.text.lower() in words

    def take(self) -> Token:
        t = self.tokens[self.at]
        self.at += 1
        return t

    def op(self, *texts: str) -> Token | None:
        t = self.tokens[self.at]
        if t.kind == "op" and (t.text in texts or (t.text[:2] == "?>" and "?>" in texts)):
            self.at += 1
            return t
        return None

    def word(self, *words: str) -> Token | None:
        t = self.tokens[self.at]
        if t.kind == "name" and t.text.lower() in words:
            self.at += 1
            return t
        return None

    def need(self, text: str) -> Token:
        t = self.op(text) or self.word(text)
        if t is None:
            raise PhpSyntaxError(f"expected {text} on line {self.now.line}")
        return t

    def done(self, node: Node) -> Node:
        node.end = self.tokens[self.at - 1].end if self.at else node.start
        return node

    def close(self) -> None:
        if not (self.op(";", "?>") or self.now.kind in ("end", "html")):
            raise PhpSyntaxError(f"unexpected {self.now.text!r} on line {self.now.line}")

    # -- statements

    def program(self) -> list[Node]:
        out = []
        while self.now.kind != "end":
            out += self.statement()
        return out

    def block(self) -> list[Node]:
        self.need("{")
        out: list[Node] = []
        while not self.op("}"):
            if self.now.kind == "end":
                raise PhpSyntaxError("unexpected end of file")
            out += self.statement()
        return out

    def body(self, *ends: str) -> list[Node]:
        """Statements of a control structure, braced, single or in the colon form that ``ends`` close."""
        if self.is_op("{"):
            return self.block()
        if self.op(":"):
            out: list[Node] = []
            while not self.is_word(*ends):
                if self.now.kind == "end":
                    raise PhpSyntaxError("unexpected end of file")
                out += self.statement()
            return out
        return self.statement()

    def statement(self) -> list[Node]:
        t = self.now
        if t.kind == "html":
            self.take()
            return [Node("InlineHTML", t)]
        if self.op("?>", ";"):
            return []
        if self.is_op("{"):
            return self.block()
        attrs = self.attributes()
        if self.now.kind == "name":
            word = self.now.text.lower()
            if (made := self.keyword(word, t, attrs)) is not None:
                return [self.done(n) for n in made]
            if self.peek().kind == "op" and self.peek().text == ":" and self.peek(2).text != ":" and "\\" not in word and word not in ("default", "parent", "self", "static"):
                self.at += 2
                return [self.done(Node("Label", t))]
        expr = self.expression()
        self.close()
        return [self.done(Node("Expression", t, expr=expr))]

    def keyword(self, word: str, t: Token, attrs: list[Node]) -> list[Node] | None:
        after = self.peek()
        if word == "namespace" and after.text != "\\":
            self.take()
            name = self.name() if self.now.kind == "name" else None
            if self.is_op("{"):
                return [Node("Namespace", t, name=name, stmts=self.block())]
            self.close()
            stmts: list[Node] = []
            while self.now.kind != "end" and not (self.is_word("namespace") and self.peek().kind in ("name", "op") and self.peek().text != "\\"):
                stmts += self.statement()
            return [Node("Namespace", t, name=name, stmts=stmts)]
        if word == "use":
            return self.use(t)
        if word == "function" and (after.kind == "name" or (after.text == "&" and self.peek(2).kind == "name")):
            self.take()
            self.op("&")
            return [self.function("Function", t, self.identifier(), attrs)]
        if word in ("abstract", "final", "class", "interface", "trait", "enum", "readonly") and after.kind == "name" and not (word == "enum" and after.text.lower() in ("extends", "implements")):
            return [self.class_like(t, attrs)]
        if word == "return":
            self.take()
            return [self.ended(Node("Return", t, expr=None if self.at_stop() else self.expression()))]
        if word == "echo":
            self.take()
            exprs = [self.expression()]
            while self.op(","):
                exprs.append(self.expression())
            return [self.ended(Node("Echo", t, exprs=exprs))]
        if word == "if":
            return [self.if_statement()]
        if word == "while":
            self.take()
            cond = self.parens()
            stmts = self.body("endwhile")
            self.endword("endwhile")
            return [Node("While", t, cond=cond, stmts=stmts)]
        if word == "do":
            self.take()
            stmts = self.body()
            self.need("while")
            return [self.ended(Node("Do", t, stmts=stmts, cond=self.parens()))]
        if word == "for":
            self.take()
            self.need("(")
            groups: list[Node] = []
            while not self.op(")"):
                if not self.op(";", ","):
                    groups.append(self.expression())
            stmts = self.body("endfor")
            self.endword("endfor")
            return [Node("For", t, exprs=groups, stmts=stmts)]
        if word == "foreach":
            self.take()
            self.need("(")
            expr = self.expression()
            self.need("as")
            self.op("&")
            key, value = None, self.expression()
            if self.op("=>"):
                self.op("&")
                key, value = value, self.expression()
            self.need(")")
            stmts = self.body("endforeach")
            self.endword("endforeach")
            return [Node("Foreach", t, expr=expr, key=key, value=value, stmts=stmts)]
        if word == "switch":
            return [self.switch()]
        if word == "try":
            return [self.try_statement()]
        if word in ("break", "continue", "goto"):
            self.take()
            return [self.ended(Node(word.capitalize(), t, expr=None if self.at_stop() else self.expression()))]
        if word in ("global", "unset") and after.kind != "op" or word == "unset":
            self.take()
            paren = self.op("(")
            items = self.listed(")") if paren else self.comma()
            return [self.ended(Node(word.capitalize(), t, items=items))]
        if word == "static" and after.kind == "var":
            self.take()
            return [self.ended(Node("Static", t, items=self.comma()))]
        if word == "const":
            self.take()
            return [self.ended(self.constants(t, "Const"))]
        if word == "declare":
            self.take()
            self.need("(")
            items = []
            while not self.op(")"):
                n = self.identifier()
                self.need("=")
                items.append(Node("ConstItem", n, name=n, value=self.expression()))
                self.op(",")
            if self.is_op("{", ":"):
                stmts = self.body("enddeclare")
                self.endword("enddeclare")
                return [Node("Declare", t, items=items, stmts=stmts)]
            return [self.ended(Node("Declare", t, items=items))]
        if word == "__halt_compiler":
            self.at = len(self.tokens) - 1
            return []
        return None

    def ended(self, node: Node) -> Node:
        self.close()
        return node

    def endword(self, word: str) -> None:
        if self.word(word):
            self.close()

    def at_stop(self) -> bool:
        return self.now.kind in ("end", "html") or (self.now.kind == "op" and self.now.text.strip() in _STOP)

    def parens(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def comma(self) -> list[Node]:
        out = [self.expression()]
        while self.op(","):
            out.append(self.expression())
        return out

    def listed(self, end: str) -> list[Node]:
        out: list[Node] = []
        while not self.op(end):
            out.append(self.expression())
            if not self.op(",") and not self.is_op(end):
                raise PhpSyntaxError(f"unexpected {self.now.text!r} on line {self.now.line}")
        return out

    def use(self, t: Token) -> list[Node]:
        self.take()
        kind = self.take().text.lower() if self.is_word("function", "const") else "class"
        items: list[Node] = []

        def one(prefix: str, kind: str) -> None:
            if self.is_word("function", "const") and self.peek().kind == "name":
                kind = self.take().text.lower()
            n = self.now
            name = self.take().text
            alias = self.take().text if self.word("as") else name.rsplit("\\", 1)[-1]
            items.append(Node("UseItem", n, type=kind, target=(prefix + name).lstrip("\\"), alias=alias))

        while True:
            if self.peek().text == "\\" and self.peek(2).text == "{":
                prefix = self.take().text + "\\"
                self.at += 2
                while not self.op("}"):
                    one(prefix, kind)
                    self.op(",")
            else:
                one("", kind)
            if not self.op(","):
                break
        return [self.ended(Node("Use", t, items=items))]

    def if_statement(self) -> Node:
        t = self.take()
        cond = self.parens()
        colon = self.is_op(":")
        stmts = self.body("elseif", "else", "endif")
        others: list[Node] = []
        last = None
        while True:
            o = self.now
            if self.is_word("elseif") or (self.is_word("else") and self.peek().text.lower() == "if" and not colon):
                self.at += 1 if self.is_word("elseif") else 2
                c = self.parens()
                others.append(self.done(Node("ElseIf", o, cond=c, stmts=self.body("elseif", "else", "endif"))))
            elif self.word("else"):
                last = self.done(Node("Else", o, stmts=self.body("endif")))
                break
            else:
                break
        if colon:
            self.need("endif")
            self.close()
        return Node("If", t, cond=cond, stmts=stmts, elseifs=others, orelse=last)

    def switch(self) -> Node:
        t = self.take()
        cond = self.parens()
        end = "}" if self.op("{") else self.need(":") and "endswitch"
        cases: list[Node] = []
        while not (self.op(end) or self.word(end)):
            c = self.now
            if self.word("default"):
                value = None
            else:
                self.need("case")
                value = self.expression()
            if not self.op(":", ";"):
                raise PhpSyntaxError(f"unexpected {self.now.text!r} on line {self.now.line}")
            stmts: list[Node] = []
            while not (self.is_word("case", "default") or self.is_op(end) or self.is_word(end)):
                stmts += self.statement()
            cases.append(self.done(Node("Case", c, cond=value, stmts=stmts)))
        if end == "endswitch":
            self.close()
        return Node("Switch", t, cond=cond, cases=cases)

    def try_statement(self) -> Node:
        t = self.take()
        stmts = self.block()
        catches: list[Node] = []
        finally_ = None
        while self.is_word("catch"):
            c = self.take()
            self.need("(")
            types = [self.name()]
            while self.op("|"):
                types.append(self.name())
            var = self.variable() if self.now.kind == "var" else None
            self.need(")")
            catches.append(self.done(Node("Catch", c, types=types, var=var, stmts=self.block())))
        if self.is_word("finally"):
            f = self.take()
            finally_ = self.done(Node("Finally", f, stmts=self.block()))
        if not catches and finally_ is None:
            raise PhpSyntaxError(f"try without catch on line {t.line}")
        return Node("TryCatch", t, stmts=stmts, catches=catches, orelse=finally_)

    def constants(self, t: Token, kind: str) -> Node:
        if self.now.kind == "name" and self.peek().kind == "name":
            self.type()
        items = []
        while True:
            n = self.identifier()
            self.need("=")
            items.append(Node("ConstItem", n, name=n, value=self.expression()))
            if not self.op(","):
                return Node(kind, t, items=items)

    # -- declarations

    def attributes(self) -> list[Node]:
        groups = []
        while self.is_op("#["):
            t = self.take()
            attrs = []
            while not self.op("]"):
                n = self.name()
                attrs.append(self.done(Node("Attribute", n, name=n, args=self.args() if self.is_op("(") else [])))
                self.op(",")
            groups.append(self.done(Node("AttributeGroup", t, attrs=attrs)))
        return groups

    def type(self) -> Node:
        t = self.now
        if self.op("?"):
            return self.done(Node("NullableType", t, type=self.type()))
        if self.op("("):
            inner = self.type()
            self.need(")")
        else:
            n = self.take()
            if n.kind != "name":
                raise PhpSyntaxError(f"expected a type on line {n.line}")
            simple = n.text.lower() in ("int", "float", "string", "bool", "array", "object", "mixed", "void", "null", "false", "true", "never", "iterable", "callable", "static")
            inner = Node("Identifier" if simple else "Name", n, name=n.text)
        parts = [inner]
        sign = None
        while self.is_op("|") or (self.is_op("&") and self.peek().kind != "var" and self.peek().text not in ("...", "&")):
            sign = self.take().text
            if self.op("("):
                parts.append(self.type())
                self.need(")")
            else:
                n = self.take()
                parts.append(Node("Name", n, name=n.text))
        return inner if sign is None else self.done(Node("UnionType" if sign == "|" else "IntersectionType", t, types=parts))

    def params(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.op(")"):
            t = self.now
            attrs = self.attributes()
            flags = []
            while self.is_word("public", "protected", "private", "readonly"):
                flags.append(self.take().text.lower())
            kind = None if self.now.kind == "var" or self.is_op("&", "...") else self.type()
            self.op("&")
            self.op("...")
            var = self.variable()
            default = self.expression() if self.op("=") else None
            if self.is_op("{"):
                self.skip_braces()
            out.append(self.done(Node("Param", t, attrs=attrs, flags=flags, type=kind, var=var, default=default)))
            if not self.op(",") and not self.is_op(")"):
                raise PhpSyntaxError(f"unexpected {self.now.text!r} on line {self.now.line}")
        return out

    def skip_braces(self) -> None:
        depth = 0
        while True:
            t = self.take()
            if t.kind == "end":
                raise PhpSyntaxError("unexpected end of file")
            depth += (t.text == "{") - (t.text == "}")
            if depth == 0:
                return

    def function(self, kind: str, t: Token, name: Node, attrs: list[Node], flags: list[str] | None = None) -> Node:
        params = self.params()
        returns = self.type() if self.op(":") else None
        stmts = self.block() if self.is_op("{") else self.close()
        return self.done(Node(kind, t, attrs=attrs, flags=flags or [], name=name, params=params, returns=returns, stmts=stmts))

    def class_like(self, t: Token, attrs: list[Node]) -> Node:
        flags = []
        while self.is_word("abstract", "final", "readonly"):
            flags.append(self.take().text.lower())
        kind = self.take().text.lower()
        return self.class_body(t, kind, self.identifier(), flags, attrs)

    def class_body(self, t: Token, kind: str, name: Node | None, flags: list[str], attrs: list[Node]) -> Node:
        backing = self.type() if kind == "enum" and self.op(":") else None
        parents: list[Node] = []
        implements: list[Node] = []
        while self.is_word("extends", "implements"):
            own = parents if self.take().text.lower() == "extends" else implements
            own.append(self.name())
            while self.op(","):
                own.append(self.name())
        self.need("{")
        stmts: list[Node] = []
        while not self.op("}"):
            stmts.append(self.done(self.member()))
        return self.done(Node(kind.capitalize(), t, attrs=attrs, flags=flags, name=name, backing=backing, extends=parents, implements=implements, stmts=stmts))

    def member(self) -> Node:
        t = self.now
        if t.kind == "end":
            raise PhpSyntaxError("unexpected end of file")
        attrs = self.attributes()
        if self.word("use"):
            names = [self.name()]
            while self.op(","):
                names.append(self.name())
            if self.is_op("{"):
                self.skip_braces()
            else:
                self.close()
            return Node("TraitUse", t, names=names)
        if self.is_word("case") and self.peek().kind == "name":
            self.take()
            name = self.identifier()
            return self.ended(Node("EnumCase", t, name=name, expr=self.expression() if self.op("=") else None))
        flags = []
        while self.is_word(*_MODIFIERS):
            flags.append(self.take().text.lower())
            if self.is_op("(") and self.peek().text.lower() == "set":
                self.at += 3
        if self.word("const"):
            return self.ended(self.constants(t, "ClassConst"))
        if self.word("function"):
            self.op("&")
            return self.function("ClassMethod", t, self.identifier(), attrs, flags)
        kind = None if self.now.kind == "var" else self.type()
        items = []
        while True:
            v = self.variable()
            default = self.expression() if self.op("=") else None
            items.append(self.done(Node("PropertyItem", v, name=v.name, default=default)))
            if not self.op(","):
                break
        if self.is_op("{"):
            self.skip_braces()
        else:
            self.close()
        return Node("Property", t, attrs=attrs, flags=flags, type=kind, items=items)

    # -- names and expressions

    def identifier(self) -> Node:
        t = self.take()
        if t.kind != "name":
            raise PhpSyntaxError(f"expected a name on line {t.line}")
        return Node("Identifier", t, name=t.text)

    def name(self) -> Node:
        t = self.take()
        if t.kind != "name":
            raise PhpSyntaxError(f"expected a name on line {t.line}")
        return Node("Name", t, name=t.text)

    def variable(self) -> Node:
        t = self.take()
        if t.kind == "var":
            return Node("Variable", t, name=t.text[1:])
        if t.kind == "op" and t.text == "$":
            if self.op("{"):
                inner = self.expression()
                self.need("}")
            else:
                inner = self.variable()
            return self.done(Node("Variable", t, name=None, expr=inner))
        raise PhpSyntaxError(f"expected a variable on line {t.line}")

    def args(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.op(")"):
            t = self.now
            if self.op("..."):
                if self.is_op(")"):
                    out.append(Node("VariadicPlaceholder", t))
                    continue
                out.append(self.done(Node("Arg", t, name=None, unpack=True, value=self.expression())))
            elif t.kind == "name" and self.peek().text == ":" and self.peek(2).text != ":":
                label = self.identifier()
                self.take()
                out.append(self.done(Node("Arg", t, name=label, unpack=False, value=self.expression())))
            else:
                out.append(self.done(Node("Arg", t, name=None, unpack=False, value=self.expression())))
            if not self.op(",") and not self.is_op(")"):
                raise PhpSyntaxError(f"unexpected {self.now.text!r} on line {self.now.line}")
        return out

    def expression(self, least: int = 0) -> Node:
        left = self.unary()
        while True:
            t = self.now
            sign = t.text.lower() if t.kind in ("op", "name") else ""
            if sign in _ASSIGN and t.kind == "op" and left.kind in ("Variable", "ArrayDim", "PropertyFetch", "NullsafePropertyFetch", "StaticPropertyFetch", "Array", "List"):
                self.take()
                ref = sign == "=" and self.op("&")
                right = self.expression(_ASSIGNING)
                left = self.done(Node("AssignRef" if ref else "Assign" if sign == "=" else "AssignOp", left, var=left, expr=right))
                continue
            if sign == "?" and t.kind == "op" and least <= _TERNARY:
                self.take()
                then = None if self.is_op(":") else self.expression(_ASSIGNING)
                self.need(":")
                left = self.done(Node("Ternary", left, cond=left, then=then, orelse=self.expression(_TERNARY + 1)))
                continue
            power = _BINARY.get(sign)
            if power is None or power < least:
                return left
            self.take()
            if sign == "instanceof":
                right = Node("Name", self.now, name=self.take().text) if self.now.kind == "name" else self.unary()
            else:
                right = self.expression(power if sign in ("**", "??") else power + 1)
            left = self.done(Node("Binary", left, op=sign, left=left, right=right))

    def unary(self) -> Node:
        t = self.now
        if t.kind == "cast":
            self.take()
            word = re.sub(r"[()\s]", "", t.text).lower()
            return self.done(Node("Cast", t, type=_CASTS.get(word, word), expr=self.expression(_UNARY)))
        if t.kind == "op":
            if t.text in ("!", "~", "@", "+", "-", "&"):
                self.take()
                return self.done(Node("Unary", t, op=t.text, expr=self.expression(_UNARY)))
            if t.text in ("++", "--"):
                self.take()
                return self.done(Node("PreInc", t, var=self.expression(_UNARY)))
        elif t.kind == "name":
            word = t.text.lower()
            if word == "new":
                return self.postfix(self.new())
            if word in ("print", "include", "include_once", "require", "require_once"):
                self.take()
                return self.done(Node("Print" if word == "print" else "Include", t, expr=self.expression(_ASSIGNING)))
            if word in ("throw", "clone"):
                self.take()
                return self.done(Node(word.capitalize(), t, expr=self.expression(0 if word == "throw" else _UNARY)))
            if word == "yield":
                self.take()
                if self.word("from"):
                    return self.done(Node("Yield", t, value=self.expression(_ASSIGNING)))
                value = None if self.at_stop() else self.expression(_ASSIGNING)
                key = None
                if self.op("=>"):
                    key, value = value, self.expression(_ASSIGNING)
                return self.done(Node("Yield", t, key=key, value=value))
        return self.postfix(self.primary())

    def new(self) -> Node:
        t = self.take()
        attrs = self.attributes()
        if self.is_word("class", "readonly") and (self.is_word("class") or self.peek().text.lower() == "class"):
            flags = [self.take().text.lower()] if self.is_word("readonly") else []
            c = self.take()
            args = self.args() if self.is_op("(") else []
            made = self.class_body(c, "class", None, flags, attrs)
            return self.done(Node("New", t, cls=made, args=args))
        if self.op("("):
            cls = self.expression()
            self.need(")")
        elif self.now.kind == "name":
            cls = self.name()
        else:
            cls = self.variable()
            while self.is_op("->", "::", "["):
                cls = self.access(cls, call=False)
        return self.done(Node("New", t, cls=cls, args=self.args() if self.is_op("(") else []))

    def access(self, left: Node, call: bool = True) -> Node:
        t = self.take()
        if t.text in ("[", "{"):
            end = "]" if t.text == "[" else "}"
            dim = None if self.is_op(end) else self.expression()
            self.need(end)
            return self.done(Node("ArrayDim", left, var=left, dim=dim))
        static = t.text == "::"
        if self.now.kind == "var" or self.is_op("$"):
            member: Node = self.variable()
            if static:
                if call and self.is_op("("):
                    return self.done(Node("StaticCall", left, cls=left, name=member, args=self.args()))
                return self.done(Node("StaticPropertyFetch", left, cls=left, name=member))
        elif self.op("{"):
            member = self.expression()
            self.need("}")
        else:
            member = self.identifier()
        if call and self.is_op("("):
            kind = "StaticCall" if static else "MethodCall" if t.text == "->" else "NullsafeMethodCall"
            return self.done(Node(kind, left, **({"cls": left} if static else {"var": left}), name=member, args=self.args()))
        if static:
            return self.done(Node("ClassConstFetch", left, cls=left, name=member))
        return self.done(Node("PropertyFetch" if t.text == "->" else "NullsafePropertyFetch", left, var=left, name=member))

    def postfix(self, left: Node) -> Node:
        while self.now.kind == "op":
            text = self.now.text
            if text in ("->", "?->", "::", "["):
                left = self.access(Node("Name", left, name=left.name) if text == "::" and left.kind == "ConstFetch" else left)
            elif text == "(" and left.kind != "Array":
                callee = Node("Name", left, name=left.name) if left.kind == "ConstFetch" else left
                left = self.done(Node("FuncCall", left, name=callee, args=self.args()))
            elif text in ("++", "--"):
                self.take()
                left = self.done(Node("PostInc", left, var=left))
            else:
                break
        return left

    def items(self, end: str) -> list[Node]:
        out = []
        while not self.op(end):
            t = self.now
            if self.op(","):
                continue
            if self.op("..."):
                out.append(self.done(Node("ArrayItem", t, key=None, value=self.expression(), unpack=True)))
            else:
                self.op("&")
                key, value = None, self.expression()
                if self.op("=>"):
                    self.op("&")
                    key, value = value, self.expression()
                out.append(self.done(Node("ArrayItem", t, key=key, value=value, unpack=False)))
            if not self.op(",") and not self.is_op(end):
                raise PhpSyntaxError(f"unexpected {self.now.text!r} on line {self.now.line}")
        return out

    def primary(self) -> Node:
        t = self.now
        if t.kind == "var" or self.is_op("$"):
            return self.variable()
        if t.kind == "num":
            self.take()
            raw = t.text.replace("_", "")
            low = raw.lower()
            real = not low.startswith(("0x", "0b")) and bool(re.search(r"[.e]", low))
            if real:
                value: float | int = float(raw)
            elif low.startswith(("0x", "0b", "0o")):
                value = int(low, 0)
            else:
                value = int(raw, 8) if len(raw) > 1 and raw[0] == "0" and raw.isdigit() and not re.search("[89]", raw) else int(raw)
            return Node("DNumber" if real or value > 2**63 - 1 else "LNumber", t, value=value)
        if t.kind == "str":
            self.take()
            return Node("String", t, value=unescape(t.body, t.quote))
        if t.kind == "tpl":
            self.take()
            return Node("Encapsed", t, pieces=self.interpolated(t))
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        if self.op("["):
            return self.done(Node("Array", t, items=self.items("]")))
        if self.is_op("#["):
            self.attributes()
            return self.primary()
        if t.kind != "name":
            raise PhpSyntaxError(f"unexpected {t.text!r} on line {t.line}")
        word, after = t.text.lower(), self.peek().text
        if word in ("array", "list") and after == "(":
            self.at += 2
            return self.done(Node("Array" if word == "array" else "List", t, items=self.items(")")))
        if word in ("function", "fn") or (word == "static" and after.lower() in ("function", "fn")):
            return self.closure(t)
        if word == "match" and after == "(":
            return self.match()
        if word == "isset" and after == "(":
            self.at += 2
            return self.done(Node("Isset", t, vars=self.listed(")")))
        if word == "empty" and after == "(":
            self.take()
            return self.done(Node("Empty", t, expr=self.parens()))
        if word in ("exit", "die"):
            self.take()
            expr = None
            if self.op("("):
                expr = None if self.is_op(")") else self.expression()
                self.need(")")
            return self.done(Node("Exit", t, expr=expr))
        self.take()
        return Node("ConstFetch", t, name=t.text)

    def closure(self, t: Token) -> Node:
        static = self.word("static") is not None
        arrow = self.take().text.lower() == "fn"
        self.op("&")
        params = self.params()
        uses: list[Node] = []
        if not arrow and self.word("use"):
            self.need("(")
            while not self.op(")"):
                u = self.now
                self.op("&")
                uses.append(Node("ClosureUse", u, var=self.variable()))
                self.op(",")
        returns = self.type() if self.op(":") else None
        if arrow:
            self.need("=>")
            return self.done(Node("ArrowFunction", t, params=params, returns=returns, expr=self.expression(_ASSIGNING), static=static))
        return self.done(Node("Closure", t, params=params, uses=uses, returns=returns, stmts=self.block(), static=static))

    def match(self) -> Node:
        t = self.take()
        cond = self.parens()
        self.need("{")
        arms = []
        while not self.op("}"):
            a = self.now
            conds: list[Node] = []
            if self.is_word("default") and self.peek().text in ("=>", ","):
                self.take()
                self.op(",")
            else:
                while not self.is_op("=>"):
                    conds.append(self.expression())
                    self.op(",")
            self.need("=>")
            arms.append(self.done(Node("MatchArm", a, conds=conds, body=self.expression())))
            self.op(",")
        return self.done(Node("Match", t, cond=cond, arms=arms))

    def interpolated(self, t: Token) -> list[Node]:
        """The expressions inside an interpolated string."""
        out: list[Node] = []
        past = 0
        for m in re.finditer(r"\\.|\{(?=\$)|\$\{|\$([A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)", t.body, re.S):
            if m.start() < past or m.group().startswith("\\"):
                continue
            if m.group(1):
                out.append(Node("Variable", t, name=m.group(1)))
                continue
            depth, past = 1, m.end()
            while past < len(t.body) and depth:
                depth += (t.body[past] == "{") - (t.body[past] == "}")
                past += 1
            inner = t.body[m.end() : past - 1]
            try:
                out += [n for s in _Parser("<?php " + (inner if m.group() == "{" else "$" + inner) + ";").program() for n in s.children()]
            except PhpSyntaxError:
                continue
        for n in out:
            for x in n.walk():
                x.start, x.end, x.line = t.start, t.end, t.line
        return out


def link(nodes: list[Node]) -> None:
    """Set parents."""
    stack = list(nodes)
    while stack:
        node = stack.pop()
        for value in node.parts.values():
            if value.__class__ is Node:
                value.parent = node
                stack.append(value)
            elif value.__class__ is list:
                for v in value:
                    if v.__class__ is Node:
                        v.parent = node
                        stack.append(v)


def parse(text: str, read: list[Token] | None = None) -> list[Node]:
    """Statements of a source given as Latin-1 text, and its tokens if they are known; raises PhpSyntaxError."""
    try:
        out = _Parser(text, read).program()
    except RecursionError:
        raise PhpSyntaxError("nested too deeply") from None
    link(out)
    return out
