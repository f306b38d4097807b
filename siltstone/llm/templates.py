"""A sandboxed template language, compiled to Python closures.

Text with `{{ expression }}`, `{% statement %}` and `{# comment #}`. Statements: for, if /
elif / else, set, generation; each block ends with end<name>. Expressions: literals, names,
item and key access (a.b and a['b'] look into mappings and lists only, never at Python
attributes), arithmetic + - * %, text joining ~, comparisons, in, and / or / not,
conditionals and filters from a fixed list. Nothing can be called, imported or assigned
outside the template's own scope, and text cannot grow but by what is written.

A template is parsed to a syntax tree of tuples, constants are folded, and every node
becomes a closure. Rendering yields (text, generated) pieces one after another, generated
being true within generation blocks, so a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

Scope = dict[str, Any]
_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-+*%~<>|.,:()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


FILTERS: dict[str, Callable[..., Any]] = {
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "title": lambda v: _text(v).title(),
    "trim": lambda v: _text(v).strip(),
    "length": len,
    "string": _text,
    "default": lambda v, other="": other if v is None else v,
    "replace": lambda v, old, new: _text(v).replace(_text(old), _text(new)),
}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        number, name, string, sign = m.groups()
        if number:
            out.append(("const", int(number)))
        elif name:
            out.append(("name", name))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)))
        else:
            out.append(("sign", sign))
        at = m.end()
    return [*out, ("end", None)]


#: Binary operators from the loosest to the tightest.
_LEVELS = [["or"], ["and"], ["==", "!=", "<", ">", "<=", ">=", "in"], ["~"], ["+", "-"], ["*", "%"]]
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b), "*": lambda a, b: int(a) * int(b), "%": lambda a, b: int(a) % int(b),
}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def next(self) -> tuple[str, Any]:
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *wanted: str) -> str | None:
        kind, v = self.tokens[self.at]
        if kind in ("sign", "name") and v in wanted:
            self.at += 1
            return v
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign} expected, not {self.tokens[self.at][1]!r}")

    def whole(self) -> tuple:
        tree = self.choice()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self) -> tuple:
        tree = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            tree = ("choose", test, tree, self.choice() if self.take("else") else ("const", None))
        return tree

    def binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self.unary()
        if level == 2 and self.take("not"):
            return ("not", self.binary(level))
        tree = self.binary(level + 1)
        while op := self.take(*_LEVELS[level]):
            right = self.binary(level + 1)
            tree = (op, tree, right) if op in ("and", "or") else ("binary", op, tree, right)
        return tree

    def unary(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take("."):
                tree = ("item", tree, ("const", self.next()[1]))
            elif self.take("["):
                tree = ("item", tree, self.choice())
                self.need("]")
            elif self.take("|"):
                name, args = self.next()[1], []
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.choice())
                        self.take(",")
                tree = ("filter", name, tree, tuple(args))
            else:
                return tree

    def atom(self) -> tuple:
        kind, v = self.next()
        if kind == "const":
            return (kind, v)
        if kind == "name":
            return ("const", _CONSTANTS[v]) if v in _CONSTANTS else ("name", v)
        if v == "(":
            tree = self.choice()
            self.need(")")
            return tree
        if v == "-":
            return ("binary", "-", ("const", 0), self.unary())
        raise TemplateError(f"unexpected {v!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", nodes)."""
    parts = _TAG.split(source)
    for k in range(1, len(parts), 2):  # a dash at a tag's side takes the white space there
        if parts[k][2:3] == "-":
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k][-3:-2] == "-":
            parts[k + 1] = parts[k + 1].lstrip()
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal at
        nodes = []
        while at < len(parts):
            part, tag = parts[at], at % 2
            at += 1
            if not tag:
                if part:
                    nodes.append(("text", part))
                continue
            if part.startswith("{#"):
                continue
            body = part[2:-2].strip("-").strip()
            if part.startswith("{{"):
                nodes.append(("show", _Expression(body).whole()))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return ("block", tuple(nodes)), body
            nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", tuple(nodes)), ""

    def statement(word: str, rest: str) -> tuple:
        if word == "set":
            name, _, value = rest.partition("=")
            return ("set", name.strip(), _Expression(value).whole())
        if word == "for":
            name, _, over = rest.partition(" in ")
            inner, _ = block(("endfor",))
            return ("for", name.strip(), _Expression(over).whole(), inner)
        if word == "generation":
            return ("generation", block(("endgeneration",))[0])
        if word == "if":
            inner, end = block(("elif", "else", "endif"))
            if end.startswith("elif"):
                return ("if", _Expression(rest).whole(), inner, ("block", (statement("if", end[4:]),)))
            return ("if", _Expression(rest).whole(), inner, block(("endif",))[0] if end == "else" else ("block", ()))
        raise TemplateError(f"unknown statement {word!r}")

    return block(())[0]


def fold(tree: tuple) -> tuple:
    """The tree with constant expressions computed, dead branches gone and texts joined."""
    kind = tree[0]
    if kind in ("const", "name", "text"):
        return tree
    if kind == "block":
        nodes: list[tuple] = []
        for n in map(fold, tree[1]):
            for x in n[1] if n[0] == "block" else (n,):
                if x[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + x[1])
                else:
                    nodes.append(x)
        return ("block", tuple(nodes))
    if kind == "filter":
        tree = (kind, tree[1], fold(tree[2]), tuple(map(fold, tree[3])))
        fixed = all(x[0] == "const" for x in (tree[2], *tree[3])) and tree[1] in FILTERS
    else:
        tree = (kind, *(fold(x) if isinstance(x, tuple) else x for x in tree[1:]))
        if kind == "show" and tree[1][0] == "const":
            return ("text", _text(tree[1][1]))
        if kind == "if" and tree[1][0] == "const":
            return tree[2] if tree[1][1] else tree[3]
        fixed = kind in ("binary", "and", "or", "not", "choose", "item") and all(x[0] == "const" for x in tree[1:] if isinstance(x, tuple))
    return ("const", expression(tree, {})({})) if fixed else tree


def _item(holder: Any, key: Any) -> Any:
    if isinstance(holder, dict):
        return holder.get(key)
    if isinstance(holder, (list, tuple, str)) and isinstance(key, int):
        return holder[key] if -len(holder) <= key < len(holder) else None
    return None


def expression(tree: tuple, filters: dict[str, Callable[..., Any]]) -> Callable[[Scope], Any]:
    kind, *rest = tree
    if kind == "const":
        return lambda s, v=rest[0]: v
    if kind == "name":
        return lambda s, n=rest[0]: s.get(n)
    if kind == "filter":
        name, value, args = rest
        f = filters.get(name) or FILTERS.get(name)
        if not f:
            raise TemplateError(f"unknown filter {name!r}")
        v, more = expression(value, filters), [expression(x, filters) for x in args]
        return lambda s: f(v(s), *[x(s) for x in more])
    if kind == "binary":
        f, a, b = _BINARY[rest[0]], expression(rest[1], filters), expression(rest[2], filters)
        return lambda s: f(a(s), b(s))
    x = [expression(t, filters) for t in rest]
    if kind == "item":
        return lambda s: _item(x[0](s), x[1](s))
    if kind == "not":
        return lambda s: not x[0](s)
    if kind == "and":
        return lambda s: x[0](s) and x[1](s)
    if kind == "or":
        return lambda s: x[0](s) or x[1](s)
    return lambda s: x[1](s) if x[0](s) else x[2](s)


Piece = tuple[str, bool]


def renderer(tree: tuple, filters: dict[str, Callable[..., Any]]) -> Callable[[Scope, bool], Iterator[Piece]]:
    kind, *rest = tree
    if kind == "block":
        inner = [renderer(x, filters) for x in rest[0]]

        def run(s: Scope, g: bool) -> Iterator[Piece]:
            for f in inner:
                yield from f(s, g)
    elif kind == "text":

        def run(s: Scope, g: bool, t: str = rest[0]) -> Iterator[Piece]:
            yield t, g
    elif kind == "show":
        value = expression(rest[0], filters)

        def run(s: Scope, g: bool) -> Iterator[Piece]:
            yield _text(value(s)), g
    elif kind == "set":
        value = expression(rest[1], filters)

        def run(s: Scope, g: bool) -> Iterator[Piece]:
            s[rest[0]] = value(s)
            yield from ()
    elif kind == "generation":
        body = renderer(rest[0], filters)

        def run(s: Scope, g: bool) -> Iterator[Piece]:
            yield from body(s, True)
    elif kind == "if":
        test, yes, no = expression(rest[0], filters), renderer(rest[1], filters), renderer(rest[2], filters)

        def run(s: Scope, g: bool) -> Iterator[Piece]:
            yield from (yes if test(s) else no)(s, g)
    else:
        name, over, body = rest[0], expression(rest[1], filters), renderer(rest[2], filters)

        def run(s: Scope, g: bool) -> Iterator[Piece]:
            outer = s.get("loop")
            items = iter(over(s) or ())  # looks ahead by one item, never at the whole
            more = next(items, _NONE)
            k = 0
            while more is not _NONE:
                item, more = more, next(items, _NONE)
                s["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": more is _NONE}
                s[name] = item
                yield from body(s, g)
                k += 1
            s["loop"] = outer

    return run


_NONE = object()


def compiled(source: str, filters: dict[str, Callable[..., Any]] | None = None) -> Callable[..., Iterator[Piece]]:
    """render(**names) -> pieces of the template. filters: more filters, by name."""
    run = renderer(fold(parse(source)), filters or {})
    return lambda **names: run(dict(names), False)


def rendered(pieces: Iterable[Piece]) -> str:
    return "".join(t for t, _ in pieces)
