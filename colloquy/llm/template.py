"""A small sandboxed template language, compiled to Python closures.

Text holds three kinds of tags: ``{{ expression }}`` puts a value out,
``{% ... %}`` is a statement and ``{# ... #}`` a comment. Statements are
``for x in y``, ``if`` / ``elif`` / ``else``, ``generation`` (what is rendered
inside is text that a model should learn to write) and their ``end...``.
Expressions know strings, integers, ``true false none``, names, ``a.b``, ``a[b]``,
``== != in not and or``, ``~`` (joining as text), ``|`` (filters) and parentheses.

There are no calls, no attributes of Python objects (``a.b`` looks a key up in a
dictionary), no names but the given ones and no filters but those in ``FILTERS``:
a template can only read what it is handed.

A template is parsed into a tree, the tree is folded with the constants known
at compile time (constant expressions, branches that cannot be taken, texts side by side),
and each node becomes a closure. Rendering yields ``(text, generated)`` pieces
one by one and reads the sequence of a loop once, one element ahead, so
a conversation of any length is rendered in constant memory.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

Piece = tuple[str, bool]
Env = dict[str, Any]


class TemplateError(ValueError):
    """The template cannot be parsed, or asks for something that is not there."""


# --- Control strings in texts ----------------------------------------------------------------

#: What marks turns; inside a text each of them gets a backslash before it.
CONTROL = re.compile(r"\\|###|</turn>")
NAME_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def escape(value: Any) -> str:
    return CONTROL.sub(r"\\\g<0>", _text(value))


def escape_name(value: Any) -> str:
    return NAME_CONTROL.sub(r"\\\g<0>", _text(value))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape, "escape_name": escape_name,
    "trim": lambda v: _text(v).strip(), "lower": lambda v: _text(v).lower(), "upper": lambda v: _text(v).upper(),
}


# --- Syntax tree -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter on already evaluated operands."""

    function: Callable
    operands: tuple


@dataclass(frozen=True)
class Choice:
    """``and`` and ``or``: the right side is looked at only if the left does not decide."""

    left: Any
    right: Any
    stops_on: bool


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- Parser ----------------------------------------------------------------------------------

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[().|~\[\]]))""", re.ASCII)
_WORDS = {"and", "or", "not", "in"}
_LITERALS = {"true": True, "false": False, "none": None}
MOST_DEPTH = 40


def _contains(a: Any, b: Any) -> bool:
    return a in b


def _joined(a: Any, b: Any) -> str:
    return _text(a) + _text(b)


_COMPARE = {"==": operator.eq, "!=": operator.ne, "in": _contains}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        while source[at:].strip():
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"unexpected {source[at:].strip()[:10]!r} in {source!r}")
            self.tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()
        self.at, self.depth = 0, 0

    def peek(self) -> str | None:
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return token if kind == "sign" or token in _WORDS and kind == "name" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing in {self.source!r}")

    def whole(self) -> Any:
        found = self.any_of()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return found

    def any_of(self) -> Any:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("the expression is nested too deeply")
        left = self.all_of()
        while self.take("or"):
            left = Choice(left, self.all_of(), True)
        self.depth -= 1
        return left

    def all_of(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Choice(left, self.negated(), False)
        return left

    def negated(self) -> Any:
        times = 0
        while self.take("not"):
            times += 1
        found = self.compared()
        return reduce(lambda x, _: Apply(operator.not_, (x,)), range(times), found)

    def compared(self) -> Any:
        left = self.text()
        sign = self.take(*_COMPARE)
        return Apply(_COMPARE[sign], (left, self.text())) if sign else left

    def text(self) -> Any:
        left = self.filtered()
        while self.take("~"):
            left = Apply(_joined, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        found = self.member()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            found = Apply(FILTERS[name], (found,))
        return found

    def member(self) -> Any:
        found = self.single()
        while sign := self.take(".", "["):
            if sign == ".":
                found = Item(found, Const(self.name()))
            else:
                found = Item(found, self.any_of())
                self.need("]")
        return found

    def name(self) -> str:
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or token in _WORDS or token.startswith("_"):
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return token

    def single(self) -> Any:
        if self.take("("):
            found = self.any_of()
            self.need(")")
            return found
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind in ("string", "int"):
            self.at += 1
            return Const(token[1:-1] if kind == "string" else int(token))
        name = self.name()
        return Const(_LITERALS[name]) if name in _LITERALS else Name(name)


def _expression(source: str) -> Any:
    return _Expression(source).whole()


_FOR = re.compile(r"for\s+([A-Za-z]\w*)\s+in\s(.+)", re.DOTALL | re.ASCII)


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    parts = iter(enumerate(_TAG.split(source)))

    def block(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        if depth > MOST_DEPTH:
            raise TemplateError("blocks are nested too deeply")
        nodes: list = []
        for place, part in parts:
            inner = part[2:-2].strip()
            if place % 2 == 0:
                if "{{" in part or "{%" in part:
                    raise TemplateError(f"a tag is not closed in {part[:40]!r}")
                nodes.append(Text(part))
            elif part.startswith("{#"):
                continue
            elif part.startswith("{{"):
                nodes.append(Output(_expression(inner)))
            elif inner.split(None, 1)[:1] and inner.split(None, 1)[0] in ends:
                return tuple(nodes), inner
            elif match := _FOR.fullmatch(inner):
                body, _ = block(("endfor",), depth + 1)
                nodes.append(For(match[1], _expression(match[2]), body))
            elif inner.startswith("if "):
                nodes.append(branch(inner[3:], depth + 1))
            elif inner == "generation":
                nodes.append(Generation(block(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"unknown or misplaced statement {inner!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    def branch(test: str, depth: int) -> If:
        then, end = block(("elif", "else", "endif"), depth)
        if end.startswith("elif"):
            return If(_expression(test), then, (branch(end[4:], depth + 1),))
        otherwise = block(("endif",), depth)[0] if end == "else" else ()
        return If(_expression(test), then, otherwise)

    return block((), 0)[0]


# --- Folding ---------------------------------------------------------------------------------

def _folded(node: Any, known: Mapping[str, Any]) -> Any:
    """An expression with its constant parts evaluated."""
    match node:
        case Name(name) if name in known:
            return Const(known[name])
        case Item(of, key):
            of, key = _folded(of, known), _folded(key, known)
            return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
        case Apply(function, operands):
            operands = tuple(_folded(x, known) for x in operands)
            if all(isinstance(x, Const) for x in operands):
                return Const(function(*(x.value for x in operands)))
            return Apply(function, operands)
        case Choice(left, right, stops_on):
            left = _folded(left, known)
            if isinstance(left, Const):
                return left if bool(left.value) == stops_on else _folded(right, known)
            return Choice(left, _folded(right, known), stops_on)
    return node


def fold(nodes: tuple, known: Mapping[str, Any]) -> tuple:
    """The tree with constants of ``known`` put in, dead branches left out and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        match node:
            case Output(value):
                value = _folded(value, known)
                made = (Text(_text(value.value)),) if isinstance(value, Const) else (Output(value),)
            case If(test, then, otherwise):
                test = _folded(test, known)
                if isinstance(test, Const):
                    made = fold(then if test.value else otherwise, known)
                else:
                    made = (If(test, fold(then, known), fold(otherwise, known)),)
            case For(name, over, body):
                inner = {k: v for k, v in known.items() if k not in (name, "loop")}
                made = (For(name, _folded(over, known), fold(body, inner)),)
            case Generation(body):
                body = fold(body, known)
                made = (Generation(body),) if body else ()
            case _:
                made = (node,)
        for new in made:
            if isinstance(new, Text) and out and isinstance(out[-1], Text):
                out[-1] = replace(out[-1], text=out[-1].text + new.text)
            elif new != Text(""):
                out.append(new)
    return tuple(out)


# --- Closures --------------------------------------------------------------------------------

def _item(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping) and isinstance(key, str) or isinstance(of, (list, tuple)) and isinstance(key, int):
        try:
            return of[key]
        except (KeyError, IndexError):
            pass
    raise TemplateError(f"there is no {key!r}")


def _value(node: Any, names: frozenset[str]) -> Callable[[Env], Any]:
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):
            if name not in names:
                raise TemplateError(f"unknown name {name!r}")
            return lambda env: env[name]
        case Item(of, key):
            of, key = _value(of, names), _value(key, names)
            return lambda env: _item(of(env), key(env))
        case Apply(function, (single,)):
            single = _value(single, names)
            return lambda env: function(single(env))
        case Apply(function, (left, right)):
            left, right = _value(left, names), _value(right, names)
            return lambda env: function(left(env), right(env))
        case Choice(left, right, stops_on):
            left, right = _value(left, names), _value(right, names)
            return lambda env: found if bool(found := left(env)) == stops_on else right(env)
    raise TemplateError(f"unknown node {node!r}")


Renderer = Callable[[Env, bool], Iterator[Piece]]


def _looped(values: Iterable) -> Iterator[tuple[Any, dict]]:
    """Each value with its place; one value is read ahead, to know the last."""
    none = object()
    ahead, index = iter(values), 0
    current = next(ahead, none)
    while current is not none:
        following = next(ahead, none)
        yield current, {"index0": index, "index": index + 1, "first": index == 0, "last": following is none}
        current, index = following, index + 1


def _statement(node: Any, names: frozenset[str]) -> Renderer:
    match node:
        case Text(text):
            def constant(env: Env, generated: bool) -> Iterator[Piece]:
                yield text, generated
            return constant
        case Output(value):
            value = _value(value, names)

            def output(env: Env, generated: bool) -> Iterator[Piece]:
                if shown := _text(value(env)):
                    yield shown, generated
            return output
        case If(test, then, otherwise):
            test, then, otherwise = _value(test, names), _sequence(then, names), _sequence(otherwise, names)
            return lambda env, generated: (then if test(env) else otherwise)(env, generated)
        case For(name, over, body):
            over, body = _value(over, names), _sequence(body, names | {name, "loop"})

            def loop(env: Env, generated: bool) -> Iterator[Piece]:
                values = over(env)
                if isinstance(values, (str, bytes, Mapping)) or not isinstance(values, Iterable):
                    raise TemplateError("a loop needs a sequence")
                inner = dict(env)
                for inner[name], inner["loop"] in _looped(values):
                    yield from body(inner, generated)
            return loop
        case Generation(body):
            body = _sequence(body, names)
            return lambda env, generated: body(env, True)
    raise TemplateError(f"unknown node {node!r}")


def _sequence(nodes: tuple, names: frozenset[str]) -> Renderer:
    parts = [_statement(node, names) for node in nodes]

    def run(env: Env, generated: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(env, generated)
    return parts[0] if len(parts) == 1 else run


def compile_template(source: str, names: Iterable[str], constants: Mapping[str, Any] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the given names that renders the template piece by piece."""
    names = frozenset(names)
    render = _sequence(fold(parse(source), constants or {}), names)
    return lambda **values: render({name: values[name] for name in names}, False)
