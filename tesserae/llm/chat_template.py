"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                                    output
    {% if e %} {% elif e %} {% else %} {% endif %}      choice
    {% for name in e %} {% endfor %}                    loop; ``loop.first`` and ``loop.index0`` are known in it
    {% set name = e %}                                  assignment
    {% generation %} {% endgeneration %}                text the model is trained to write
    {# comment #}                                       nothing

Expressions: strings, whole numbers, true, false, none; ``a.b`` and ``a['b']`` on mappings only; ``not and or``;
``== != < <= > >= in``; ``+ - * %`` and ``~`` (joins as text); filters ``e | name`` and the conditional
``a if c else b``. There are no calls, and no attribute of any Python object can be reached. Constant expressions,
choices between them and adjacent texts are folded when the template is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

Scope = dict[str, object]
#: Takes a piece of output and whether it is generated.
Write = Callable[[str, bool], None]


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """``kind`` and operands; expressions: const, name, get, unary, binary, and, or, filter, choice."""

    kind: str
    parts: tuple


_PIECES = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(\d+)|([A-Za-z_]\w*)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(==|!=|<=|>=|[-+*%~<>|.()\[\]=]))""")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_BINARY = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "%": lambda a, b: a % b,
    "~": lambda a, b: _text(a) + _text(b),
}
_LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*", "%"))
_WORDS = {"true": True, "false": False, "none": None}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class _Parser:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append(next((k, x) for k, x in zip(("number", "word", "string", "sign"), m.groups(), strict=True) if x is not None))
            at = m.end()
        self.at = 0

    def peek(self, *signs: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign") and self.tokens[self.at][1] in signs

    def take(self, *signs: str) -> str | None:
        if not self.peek(*signs):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> Node:
        out = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            out = Node("choice", (test, out, self.choice()))
        return out

    def either(self) -> Node:
        out = self.both()
        while self.take("or"):
            out = Node("or", (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.take("and"):
            out = Node("and", (out, self.negated()))
        return out

    def negated(self) -> Node:
        return Node("unary", ("not", self.negated())) if self.take("not") else self.level(0)

    def level(self, k: int) -> Node:
        if k == len(_LEVELS):
            return self.filtered()
        out = self.level(k + 1)
        while sign := self.take(*_LEVELS[k]):
            out = Node("binary", (sign, out, self.level(k + 1)))
        return out

    def filtered(self) -> Node:
        out = self.signed()
        while self.take("|"):
            out = Node("filter", (self.word(), out))
        return out

    def signed(self) -> Node:
        return Node("unary", ("-", self.signed())) if self.take("-") else self.postfix()

    def postfix(self) -> Node:
        out = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                out = Node("get", (out, Node("const", (self.word(),))))
            else:
                out = Node("get", (out, self.choice()))
                self.need("]")
        return out

    def atom(self) -> Node:
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Node("const", (int(value),))
        if kind == "string":
            return Node("const", (re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S),))
        if kind == "word":
            return Node("const", (_WORDS[value],)) if value in _WORDS else Node("name", (value,))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[Node]:
    """Statements: text, out, if, for, set, generation."""
    pieces, at = [], 0
    for m in _PIECES.finditer(source):
        pieces += [("text", source[at : m.start()]), (m[0][:2], m[0][2:-2].strip())]
        at = m.end()
    pieces = [x for x in [*pieces, ("text", source[at:])] if x[0] != "{#" and x != ("text", "")]
    out, rest, end = _block(pieces, ())
    if rest or end:
        raise TemplateError("a block is closed that was not opened")
    return out


def _block(pieces: list, ends: tuple[str, ...]) -> tuple[list[Node], list, str]:
    out: list[Node] = []
    while pieces:
        (kind, body), pieces = pieces[0], pieces[1:]
        if kind == "text":
            out.append(Node("text", (body,)))
        elif kind == "{{":
            out.append(Node("out", (_Parser(body).whole(),)))
        else:
            word, _, rest = body.partition(" ")
            if word in ends:
                return out, pieces, body
            if word == "if":
                arms, test = [], rest
                while True:
                    inner, pieces, end = _block(pieces, ("elif", "else", "endif"))
                    arms.append((_Parser(test).whole(), inner))
                    if not end.startswith("elif"):
                        break
                    test = end[4:]
                last: list[Node] = []
                if end == "else":
                    last, pieces, end = _block(pieces, ("endif",))
                for test_node, inner in reversed(arms):
                    last = [Node("if", (test_node, inner, last))]
                out += last
            elif word == "for":
                parser = _Parser(rest)
                name = parser.word()
                parser.need("in")
                items = parser.whole()
                inner, pieces, _ = _block(pieces, ("endfor",))
                out.append(Node("for", (name, items, inner)))
            elif word == "set":
                parser = _Parser(rest)
                name = parser.word()
                parser.need("=")
                out.append(Node("set", (name, parser.whole())))
            elif word == "generation":
                inner, pieces, _ = _block(pieces, ("endgeneration",))
                out.append(Node("generation", (inner,)))
            else:
                raise TemplateError(f"unknown statement {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return out, [], ""


def _get(value: object, key: object) -> object:
    if not isinstance(value, Mapping):
        raise TemplateError("only mappings have members")
    return value.get(key)


class Template:
    """A compiled template. ``filters``: by name, on one value each; they must give the same for the same."""

    def __init__(self, source: str, filters: Mapping[str, Callable[[object], object]] | None = None):
        self.filters = {"trim": lambda x: _text(x).strip(), "lower": lambda x: _text(x).lower(), "upper": lambda x: _text(x).upper()}
        self.filters |= filters or {}
        self.tree = self._fold_all(parse(source))
        self._run = self._statements(self.tree, False)

    def render(self, write: Write, **scope: object) -> None:
        self._run(dict(scope), write)

    # folding

    def _fold(self, node: Node) -> Node:
        kind = node.kind
        parts = tuple(self._fold(x) if isinstance(x, Node) else x for x in node.parts)
        node = Node(kind, parts)
        if kind in ("const", "name"):
            return node
        if kind == "filter" and parts[0] not in self.filters:
            raise TemplateError(f"unknown filter {parts[0]!r}")
        if kind in ("and", "or", "choice") and parts[0].kind == "const":
            known = parts[0].parts[0]
            return (parts[1] if known else parts[2]) if kind == "choice" else parts[1] if bool(known) == (kind == "and") else parts[0]
        if kind != "get" and all(x.kind == "const" for x in parts if isinstance(x, Node)):
            try:
                return Node("const", (self._expression(node)({}),))
            except TypeError as error:
                raise TemplateError(str(error)) from error
        return node

    def _fold_all(self, nodes: Iterable[Node]) -> list[Node]:
        out: list[Node] = []
        for node in nodes:
            kind, parts = node.kind, node.parts
            if kind == "out":
                value = self._fold(parts[0])
                new = [Node("text", (_text(value.parts[0]),))] if value.kind == "const" else [Node("out", (value,))]
            elif kind == "if":
                test = self._fold(parts[0])
                arms = [self._fold_all(x) for x in parts[1:]]
                new = arms[not test.parts[0]] if test.kind == "const" else [Node("if", (test, *arms))]
            elif kind in ("for", "set"):
                new = [Node(kind, (parts[0], self._fold(parts[1]), *map(self._fold_all, parts[2:])))]
            elif kind == "generation":
                new = [Node(kind, (self._fold_all(parts[0]),))]
            else:
                new = [node]
            for x in new:
                if x.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", (out[-1].parts[0] + x.parts[0],))
                elif x != Node("text", ("",)):
                    out.append(x)
        return out

    # closures

    def _expression(self, node: Node) -> Callable[[Scope], object]:
        kind, parts = node.kind, node.parts
        if kind == "const":
            return lambda scope, value=parts[0]: value
        if kind == "name":
            return lambda scope, name=parts[0]: scope.get(name)
        if kind == "binary":
            apply, a, b = _BINARY[parts[0]], self._expression(parts[1]), self._expression(parts[2])
            return lambda scope: apply(a(scope), b(scope))
        if kind == "unary":
            a = self._expression(parts[1])
            return (lambda scope: not a(scope)) if parts[0] == "not" else (lambda scope: -a(scope))
        if kind == "filter":
            apply, a = self.filters[parts[0]], self._expression(parts[1])
            return lambda scope: apply(a(scope))
        a, *rest = map(self._expression, parts)
        if kind == "get":
            return lambda scope: _get(a(scope), rest[0](scope))
        if kind == "and":
            return lambda scope: a(scope) and rest[0](scope)
        if kind == "or":
            return lambda scope: a(scope) or rest[0](scope)
        return lambda scope: rest[0](scope) if a(scope) else rest[1](scope)

    def _statements(self, nodes: list[Node], marked: bool) -> Callable[[Scope, Write], None]:
        steps = [self._statement(x, marked) for x in nodes]

        def run(scope: Scope, write: Write) -> None:
            for step in steps:
                step(scope, write)

        return steps[0] if len(steps) == 1 else run

    def _statement(self, node: Node, marked: bool) -> Callable[[Scope, Write], None]:
        kind, parts = node.kind, node.parts
        if kind == "text":
            return lambda scope, write, text=parts[0]: write(text, marked)
        if kind == "generation":
            return self._statements(parts[0], True)
        value = self._expression(parts[1] if kind in ("for", "set") else parts[0])
        if kind == "out":
            return lambda scope, write: write(_text(value(scope)), marked)
        if kind == "set":
            return lambda scope, write, name=parts[0]: scope.__setitem__(name, value(scope))
        if kind == "if":
            yes, no = self._statements(parts[1], marked), self._statements(parts[2], marked)
            return lambda scope, write: (yes if value(scope) else no)(scope, write)
        name, body = parts[0], self._statements(parts[2], marked)

        def loop(scope: Scope, write: Write) -> None:
            items = value(scope)
            if isinstance(items, str | Mapping) or not isinstance(items, Iterable):
                raise TemplateError("a loop needs a list")
            for i, item in enumerate(items):
                body(scope | {name: item, "loop": {"index0": i, "first": i == 0}}, write)

        return loop
