"""A small sandboxed template language, compiled to Python closures.

Text outside tags is copied.  Tags:

* ``{{ expression }}``
* ``{% if e %} {% elif e %} {% else %} {% endif %}``
* ``{% for name in e %} ... {% endfor %}`` with ``loop.index0``, ``loop.first``, ``loop.last``
* ``{% set name = e %}``
* ``{% generation %} ... {% endgeneration %}``: text under the loss mask

Expressions: strings, whole numbers, ``true``, ``false``, ``none``, names, ``a.key``,
``a['key']``, ``+ == != < > <= >=``, ``and or not``, ``in``, ``x if c else y`` and filters
``e | name``.  There are no calls, no Python attributes and no imports: a key reads a
mapping, everything else fails, so a template cannot reach beyond its values.

The parser makes a syntax tree of tuples, constants are folded, and each node becomes a
closure.  Rendering is a stream of ``(text, under_mask)``: loops draw from an iterator
with one element of look-ahead, so a conversation of any length needs constant memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(
    r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<op>==|!=|<=|>=|[-+<>.|\[\]()]))"""
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}

Filters = Mapping[str, Callable[[object], object]]
Node = tuple


class TemplateError(ValueError):
    """The template cannot be parsed, or asks for something that is not there."""


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens = _tokens(source)
        self.at = 0

    def parse(self) -> Node:
        node = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def peek(self, *values: str) -> bool:
        if self.at >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at]
        return kind != "str" and value in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def choice(self) -> Node:
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return ("choice", test, node, self.choice())
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> Node:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("compare", op, node, self.added())
        return node

    def added(self) -> Node:
        node = self.filtered()
        while op := self.take("+", "-"):
            node = ("add", op, node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.keyed()
        while self.take("|"):
            node = ("filter", self.name(), node)
        return node

    def keyed(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("key", node, ("const", self.name()))
            elif self.take("["):
                node = ("key", node, self.choice())
                self.need("]")
            else:
                return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is expected")
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    parts = [p for p in _TAGS.split(source) if p]
    body, at = _block(parts, 0, ())
    if at != len(parts):
        raise TemplateError(f"unexpected {parts[at]}")
    return body


def _tag(part: str) -> tuple[str, str]:
    word, _, rest = part[2:-2].strip().partition(" ")
    return word, rest.strip()


def _block(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[Node, int]:
    """Nodes up to a closing tag named in ``ends``; returns the place of that tag."""
    nodes = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{{"):
            nodes.append(("emit", _Expression(part[2:-2]).parse()))
            at += 1
            continue
        if not part.startswith("{%"):
            nodes.append(("text", part))
            at += 1
            continue
        word, rest = _tag(part)
        if word in ends:
            return ("block", nodes), at
        if word == "if":
            node, at = _if(parts, at, rest)
        elif word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read {part}")
            body, at = _closed(parts, at + 1, "endfor")
            node = ("for", m[1], _Expression(m[2]).parse(), body)
        elif word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"cannot read {part}")
            node, at = ("set", name.strip(), _Expression(value).parse()), at + 1
        elif word == "generation":
            body, at = _closed(parts, at + 1, "endgeneration")
            node = ("generation", body)
        else:
            raise TemplateError(f"unknown tag {part}")
        nodes.append(node)
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return ("block", nodes), at


def _closed(parts: list[str], at: int, end: str) -> tuple[Node, int]:
    body, at = _block(parts, at, (end,))
    return body, at + 1


def _if(parts: list[str], at: int, test: str) -> tuple[Node, int]:
    yes, at = _block(parts, at + 1, ("elif", "else", "endif"))
    word, rest = _tag(parts[at])
    if word == "elif":
        no, at = _if(parts, at, rest)
    elif word == "else":
        no, at = _closed(parts, at + 1, "endif")
    else:
        no, at = ("block", []), at + 1
    return ("if", _Expression(test).parse(), yes, no), at


def _compare(op: str, a, b) -> bool:
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "in":
        return a in b
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _add(op: str, a, b):
    if isinstance(a, str) and isinstance(b, str) and op == "+":
        return a + b
    if isinstance(a, int) and isinstance(b, int):
        return a + b if op == "+" else a - b
    raise TemplateError(f"cannot combine {type(a).__name__} and {type(b).__name__}")


def fold(node: Node, filters: Filters) -> Node:
    """The tree with constant parts computed, dead branches gone and texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "block":
        out: list[Node] = []
        for child in (fold(n, filters) for n in node[1]):
            for one in child[1] if child[0] == "block" else [child]:
                if one[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + one[1])
                elif one != ("text", ""):
                    out.append(one)
        return ("block", out)
    parts = [fold(p, filters) if isinstance(p, tuple) else p for p in node[1:]]
    if kind == "emit":
        return ("text", _shown(parts[0][1])) if parts[0][0] == "const" else ("emit", parts[0])
    if kind == "if":
        if parts[0][0] == "const":
            return parts[1] if parts[0][1] else parts[2]
        return ("if", *parts)
    if kind in ("for", "set", "generation"):
        return (kind, *parts)
    if kind == "choice" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    folded = (kind, *parts)
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        return ("const", _value(folded, filters)({}))
    return folded


def _shown(value) -> str:
    return "" if value is None else str(value)


def _value(node: Node, filters: Filters) -> Callable[[dict], object]:
    """The closure that computes an expression from the names in scope."""
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda scope: constant
    if kind == "name":
        name = node[1]

        def look_up(scope):
            if name not in scope:
                raise TemplateError(f"unknown name {name}")
            return scope[name]

        return look_up
    if kind == "key":
        of, key = _value(node[1], filters), _value(node[2], filters)

        def get(scope):
            box = of(scope)
            if not isinstance(box, Mapping):
                raise TemplateError("only mappings have keys")
            return box.get(key(scope))

        return get
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]}")
        apply, inner = filters[node[1]], _value(node[2], filters)
        return lambda scope: apply(inner(scope))
    if kind == "not":
        inner = _value(node[1], filters)
        return lambda scope: not inner(scope)
    if kind == "choice":
        test, yes, no = (_value(n, filters) for n in node[1:])
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if kind in ("and", "or"):
        left, right = _value(node[1], filters), _value(node[2], filters)
        if kind == "and":
            return lambda scope: left(scope) and right(scope)
        return lambda scope: left(scope) or right(scope)
    op, left, right = node[1], _value(node[2], filters), _value(node[3], filters)
    combine = _compare if kind == "compare" else _add
    return lambda scope: combine(op, left(scope), right(scope))


Stream = Iterator[tuple[str, bool]]


def _writer(node: Node, filters: Filters, masked: bool) -> Callable[[dict], Stream]:
    """The closure that streams a statement's text."""
    kind = node[0]
    if kind == "text":
        piece = (node[1], masked)

        def text(scope):
            yield piece

        return text
    if kind == "block":
        writers = [_writer(n, filters, masked) for n in node[1]]

        def block(scope):
            for write in writers:
                yield from write(scope)

        return block
    if kind == "emit":
        value = _value(node[1], filters)

        def emit(scope):
            yield _shown(value(scope)), masked

        return emit
    if kind == "generation":
        return _writer(node[1], filters, True)
    if kind == "set":
        name, value = node[1], _value(node[2], filters)

        def assign(scope):
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "if":
        test = _value(node[1], filters)
        yes, no = _writer(node[2], filters, masked), _writer(node[3], filters, masked)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    name, items, body = node[1], _value(node[2], filters), _writer(node[3], filters, masked)

    def loop(scope):
        drawn = iter(items(scope))
        index, end = 0, object()
        item = next(drawn, end)
        inner = dict(scope)
        while item is not end:
            ahead = next(drawn, end)
            inner[name] = item
            inner["loop"] = {"index0": index, "first": index == 0, "last": ahead is end}
            yield from body(inner)
            index, item = index + 1, ahead

    return loop


def compile_template(source: str, filters: Filters) -> Callable[..., Stream]:
    """``render(**values)`` streams ``(text, under_mask)``."""
    write = _writer(fold(parse(source), filters), filters, False)
    return lambda **values: write(dict(values))
