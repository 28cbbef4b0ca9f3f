"""A small sandboxed template language, compiled to Python closures.

``{{ value }}`` writes a value, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in xs %} {% endfor %}`` and
``{% set x = value %}`` do as elsewhere, ``{% generation %} {% endgeneration %}`` mark text that a model is to learn, ``{# #}``
is a comment, and a ``-`` inside a tag strips the blanks beside it. Values are strings, whole numbers, true, false, none, names,
``a.b``, ``a['b']``, ``a[0]``, ``not``, ``and``, ``or``, comparisons, ``in``, ``+``, ``~`` (joins as text), parentheses, and filters
behind ``|``. There are no calls and no attributes: a member is looked up in mappings and lists only, and filters are those
that the caller hands in. A source becomes a syntax tree, constant parts of the tree are folded, and the tree becomes closures
that yield pieces of text, ``BEGIN`` and ``END``.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
TOKENS = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|"
                    r"(?P<op>==|!=|<=|>=|[-<>+~|().\[\]=]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
FILTERS: dict[str, Callable] = {"upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
                                "trim": lambda v: _text(v).strip(), "length": len}


class BEGIN:
    """Yielded where text to be learned begins."""


class END:
    """Yielded where it ends."""


class TemplateError(ValueError):
    """The source is no valid template."""


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class _Expression:
    """Recursive descent over the tokens of one tag; nodes are tuples whose first entry is their kind."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters, end = [], 0, filters, 0
        source = source.rstrip()
        while end < len(source):
            m = TOKENS.match(source, end)
            if not m:
                raise TemplateError(f"can't read {source[end:end + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            end = m.end()

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self, node):
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")
        return node

    def value(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.sum()
        while op := self.take(*COMPARE, "in", "not"):
            if op == "not":
                self.need("in")
                node = ("not", ("in", node, self.sum()))
            else:
                node = ("in", node, self.sum()) if op == "in" else ("compare", op, node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while op := self.take("+", "~"):
            node = ("add" if op == "+" else "join", node, self.filtered())
        return node

    def filtered(self):
        node = self.member()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"there is no filter {name!r}")
            node = ("filter", name, node)
        return node

    def member(self):
        node = self.atom()
        while op := self.take(".", "["):
            node = ("member", node, ("const", self.name()) if op == "." else self.value())
            if op == "[":
                self.need("]")
        return node

    def atom(self):
        if self.take("("):
            node = self.value()
            self.need(")")
            return node
        if self.take("-"):
            node = self.atom()
            if node[0] != "const" or not isinstance(node[1], int):
                raise TemplateError("only numbers can be negative")
            return ("const", -node[1])
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(text))
        if kind == "name":
            return ("const", CONSTANTS[text]) if text in CONSTANTS else ("name", text)
        raise TemplateError(f"{text!r} is no value")


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """Syntax tree: ``("block", [nodes])``."""
    parts = TAGS.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-" and len(parts[i]) > 5:
            parts[i + 1] = parts[i + 1].lstrip()
    root: list = []
    open_tags: list[tuple[str, list, list]] = []  # kind, the node's parts, the body above
    body = root
    for i, part in enumerate(parts):
        if i % 2 == 0:
            if part:
                body.append(("text", part))
            continue
        inner = part[2:-2].strip("-").strip() if part[1] != "#" else ""
        if part[1] == "#":
            continue
        if part[1] == "{":
            e = _Expression(inner, filters)
            body.append(("write", e.done(e.value())))
            continue
        word, _, rest = inner.partition(" ")
        e = _Expression(rest, filters)
        if word == "set":
            name = e.name()
            e.need("=")
            body.append(("set", name, e.done(e.value())))
        elif word == "for":
            name = e.name()
            e.need("in")
            open_tags.append(("for", ["for", name, e.done(e.value()), inside := []], body))
            body = inside
        elif word == "if":
            open_tags.append(("if", ["if", [(e.done(e.value()), inside := [])], []], body))
            body = inside
        elif word == "generation":
            open_tags.append(("generation", ["generation", inside := []], body))
            body = inside
        elif word in ("elif", "else") and open_tags and open_tags[-1][0] == "if":
            body = []
            branch = (e.done(e.value()) if word == "elif" else e.done(("const", True)), body)
            open_tags[-1][1][1].append(branch)
        elif word in ("endfor", "endif", "endgeneration") and open_tags and open_tags[-1][0] == word[3:]:
            _, node, body = open_tags.pop()
            body.append(tuple(node))
        else:
            raise TemplateError(f"{word!r} is out of place")
    if open_tags:
        raise TemplateError(f"{open_tags[-1][0]!r} is never closed")
    return ("block", root)


def fold(node, filters: Mapping[str, Callable] = FILTERS):
    """The tree with constant values computed, constant branches decided and neighbouring texts joined."""
    kind = node[0]
    if kind == "block":
        out: list = []
        for child in node[1]:
            child = fold(child, filters)
            if child[0] == "write" and child[1][0] == "const":
                child = ("text", _text(child[1][1]))
            for c in child[1] if child[0] == "block" else [child]:
                if c[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + c[1])
                elif c != ("text", ""):
                    out.append(c)
        return ("block", out)
    if kind in ("text", "const", "name"):
        return node
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(("block", node[3]), filters)[1])
    if kind == "generation":
        return ("generation", fold(("block", node[1]), filters)[1])
    if kind == "if":
        branches = []
        for test, body in node[1]:
            test, body = fold(test, filters), fold(("block", body), filters)[1]
            if test[0] == "const" and not test[1]:
                continue
            branches.append((test, body))
            if test[0] == "const":
                break
        if not branches:
            return ("block", [])
        return ("block", branches[0][1]) if branches[0][0][0] == "const" else ("if", branches, [])
    parts = tuple(fold(p, filters) if isinstance(p, tuple) else p for p in node)
    if kind in ("write", "set"):
        return parts
    if all(p[0] == "const" for p in parts[1:] if isinstance(p, tuple)):
        try:
            return ("const", _value(parts, filters)({}))
        except TypeError:  # raised again if that place is ever rendered
            return parts
    return parts


def _member(thing, key):
    if isinstance(thing, Mapping):
        return thing.get(key)
    if isinstance(thing, Sequence) and not isinstance(thing, str) and isinstance(key, int) and -len(thing) <= key < len(thing):
        return thing[key]
    return None


def _value(node, filters) -> Callable:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "compare":
        f, a, b = COMPARE[node[1]], _value(node[2], filters), _value(node[3], filters)
        return lambda scope: f(a(scope), b(scope))
    if kind == "filter":
        f, a = filters[node[1]], _value(node[2], filters)
        return lambda scope: f(a(scope))
    a = _value(node[1], filters)
    if kind == "not":
        return lambda scope: not a(scope)
    b = _value(node[2], filters)
    return {"or": lambda scope: a(scope) or b(scope), "and": lambda scope: a(scope) and b(scope),
            "in": lambda scope: a(scope) in b(scope), "add": lambda scope: a(scope) + b(scope),
            "join": lambda scope: _text(a(scope)) + _text(b(scope)),
            "member": lambda scope: _member(a(scope), b(scope))}[kind]


def _block(nodes, filters) -> Callable[[dict], Iterator]:
    steps = [_step(n, filters) for n in nodes]

    def run(scope):
        for step in steps:
            yield from step(scope)
    return run


def _step(node, filters) -> Callable[[dict], Iterator]:
    kind = node[0]
    if kind == "text":
        return lambda scope, pieces=(node[1],): pieces
    if kind == "write":
        value = _value(node[1], filters)
        return lambda scope: (_text(value(scope)),)
    if kind == "set":
        name, value = node[1], _value(node[2], filters)

        def assign(scope):
            scope[name] = value(scope)
            return ()
        return assign
    if kind == "generation":
        inner = _block(node[1], filters)

        def mark(scope):
            yield BEGIN
            yield from inner(scope)
            yield END
        return mark
    if kind == "if":
        branches = [(_value(test, filters), _block(body, filters)) for test, body in node[1]]

        def choose(scope):
            for test, body in branches:
                if test(scope):
                    return body(scope)
            return ()
        return choose
    name, items, body = node[1], _value(node[2], filters), _block(node[3], filters)

    def repeat(scope):
        found, inner, missing = iter(items(scope) or ()), dict(scope), object()
        item, index = next(found, missing), 0
        while item is not missing:
            after, index = next(found, missing), index + 1
            inner[name] = item
            inner["loop"] = {"index": index, "index0": index - 1, "first": index == 1, "last": after is missing}
            yield from body(inner)
            item = after
    return repeat


def _uses(node, name: str) -> int:
    if isinstance(node, (list, tuple)):
        return (node == ("name", name)) + sum(_uses(n, name) for n in node)
    return 0


class Template:
    """A compiled template. ``render`` yields strings, ``BEGIN`` and ``END``."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        known = FILTERS | dict(filters or {})
        self.tree = fold(parse(source, known), known)
        self._run = _block(self.tree[1], known)

    def reads_once(self, name: str) -> bool:
        """Whether ``name`` is only read by one loop at the top, so that an iterator will do."""
        return _uses(self.tree, name) == 1 and any(n[0] == "for" and n[2] == ("name", name) for n in self.tree[1])

    def render(self, **scope) -> Iterator:
        return self._run(scope)
