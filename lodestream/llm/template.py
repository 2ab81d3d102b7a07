"""A small sandboxed template language, compiled to closures.

    {{ expression }}                     writes a value
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% endfor %}        with loop.index0, loop.index, loop.first, loop.last
    {% set x = e %}
    {% generation %} {% endgeneration %} marks what is written inside as generated
    {# comment #}                        a '-' inside a tag's border trims white space on that side

Expressions: literals, names, key access by ``.key`` or ``[e]``, ``not and or == != in + ~ -``, comparisons, and filters by ``|``.
Values are strings, whole numbers, booleans, None, lists and dicts. Nothing else can be reached: keys are looked up in
dicts only, never as attributes, there are no calls but the filters given at compilation, and source size, nesting
and the text that one run writes between two messages are bounded.

The source becomes tokens, a syntax tree, a folded tree (constant expressions and branches are worked out, texts that
follow one another are joined) and then closures. A loop reads its list one element ahead, so that it can run over an
iterator that is longer than memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

MOST_SOURCE, MOST_DEPTH, MOST_TEXT = 100_000, 50, 1 << 28


class TemplateError(ValueError):
    pass


# --- syntax tree --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing ------------------------------------------------------------------------------------------------------

_TAGS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~|.,()\[\]<>=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    def __init__(self, source: str, filters: dict) -> None:
        self.t, self.at, self.depth, self.filters = _tokens(source), 0, 0, filters

    def peek(self, *values: str) -> bool:
        return self.at < len(self.t) and self.t[self.at][0] in ("op", "name") and self.t[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at >= len(self.t) or self.t[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.t[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.t):
            raise TemplateError(f"unexpected {self.t[self.at][1]!r}")

    def parse(self) -> object:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        e = self._and()
        while self.take("or"):
            e = Op("or", (e, self._and()))
        self.depth -= 1
        return e

    def _and(self) -> object:
        e = self._not()
        while self.take("and"):
            e = Op("and", (e, self._not()))
        return e

    def _not(self) -> object:
        flips = 0
        while self.take("not"):
            flips += 1
        e = self._compare()
        for _ in range(flips):
            e = Op("not", (e,))
        return e

    def _compare(self) -> object:
        e = self._sum()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            op = self.t[self.at][1]
            self.at += 1
            e = Op(op, (e, self._sum()))
        return e

    def _sum(self) -> object:
        e = self._filtered()
        while self.peek("+", "-", "~"):
            op = self.t[self.at][1]
            self.at += 1
            e = Op(op, (e, self._filtered()))
        return e

    def _filtered(self) -> object:
        e = self._atom()
        while True:
            if self.take("."):
                e = Key(e, Const(self.name()))
            elif self.take("["):
                e = Key(e, self.parse())
                self.need("]")
            elif self.take("|"):
                name, args = self.name(), [e]
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.parse())
                        if not self.peek(")"):
                            self.need(",")
                e = Filter(name, tuple(args))
            else:
                return e

    def _atom(self) -> object:
        if self.take("("):
            e = self.parse()
            self.need(")")
            return e
        if self.at >= len(self.t):
            raise TemplateError("an expression expected")
        kind, value = self.t[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return Const(words[value.lower()]) if value.lower() in words else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: dict[str, Callable]) -> tuple:
    """The syntax tree of ``source``: a tuple of statements."""
    if len(source) > MOST_SOURCE:
        raise TemplateError("source too long")
    parts, at, trim = [], 0, False
    for m in _TAGS.finditer(source):
        text = source[at : m.start()]
        left, right = next((m[i], m[j]) for i, j in ((1, 3), (4, 6), (7, 8)) if m[i] is not None)
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if left else text))
        if m[1] is not None:
            parts.append(("write", m[2]))
        elif m[4] is not None:
            parts.append(("tag", m[5].strip()))
        at, trim = m.end(), bool(right)
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    place = 0

    def whole(text: str) -> object:
        e = _Expression(text, filters)
        out = e.parse()
        e.end()
        return out

    def block(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal place
        if depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        out = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                if value:
                    out.append(Write(Const(value)))
                continue
            if kind == "write":
                out.append(Write(whole(value)))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return tuple(out), value
            if word == "if":
                out.append(branch(rest, depth))
            elif word == "for":
                e = _Expression(rest, filters)
                name = e.name()
                e.need("in")
                over = e.parse()
                e.end()
                out.append(For(name, over, block(("endfor",), depth + 1)[0]))
            elif word == "set":
                e = _Expression(rest, filters)
                name = e.name()
                e.need("=")
                out.append(Set(name, e.parse()))
                e.end()
            elif word == "generation":
                out.append(Generation(block(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return tuple(out), ""

    def branch(test: str, depth: int) -> If:
        then, end = block(("elif", "else", "endif"), depth + 1)
        word, _, rest = end.partition(" ")
        if word == "elif":
            return If(whole(test), then, (branch(rest, depth + 1),))
        return If(whole(test), then, block(("endif",), depth + 1)[0] if word == "else" else ())

    return block((), 0)[0]


# --- constant folding ---------------------------------------------------------------------------------------------


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only strings, numbers and booleans can be written")


def _same_kind(a: object, b: object) -> None:
    if not (isinstance(a, str) and isinstance(b, str)) and not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("operands of different kinds")


def _binary(op: str, a: object, b: object) -> object:
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "~":
        return _text(a) + _text(b)
    if op == "in":
        if not isinstance(b, (str, list, dict)):
            raise TemplateError("'in' needs a string, list or dict")
        return a in b
    _same_kind(a, b)
    if op == "+":
        return a + b
    if op == "-" and isinstance(a, int):
        return a - b
    if op in ("<", ">", "<=", ">="):
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    raise TemplateError(f"{op!r} doesn't fit its operands")


def _key(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def fold(node: object, filters: dict[str, Callable]) -> object:
    """``node`` with constant parts worked out; what would fail is left for the run."""
    go = lambda x: fold(x, filters)
    try:
        if isinstance(node, Op):
            args = tuple(map(go, node.args))
            if node.op in ("and", "or") and isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
            if all(isinstance(a, Const) for a in args) and node.op not in ("and", "or"):
                return Const(not args[0].value if node.op == "not" else _binary(node.op, args[0].value, args[1].value))
            return Op(node.op, args)
        if isinstance(node, Key):
            of, key = go(node.of), go(node.key)
            return Const(_key(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Key(of, key)
        if isinstance(node, Filter):
            args = tuple(map(go, node.args))
            return Const(filters[node.name](*[a.value for a in args])) if all(isinstance(a, Const) for a in args) else Filter(node.name, args)
    except Exception:  # noqa: BLE001  it will fail again where it runs, if it runs
        return node
    return node


def fold_block(body: tuple, filters: dict[str, Callable]) -> tuple:
    out: list = []
    for s in body:
        if isinstance(s, Write):
            s = Write(fold(s.value, filters))
            if isinstance(s.value, Const) and isinstance(s.value.value, (str, int, type(None))):
                s = Write(Const(_text(s.value.value)))
                if not s.value.value:
                    continue
                if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                    s = Write(Const(out.pop().value.value + s.value.value))
            out.append(s)
        elif isinstance(s, If):
            test, then, other = fold(s.test, filters), fold_block(s.then, filters), fold_block(s.other, filters)
            if isinstance(test, Const):
                out = list(fold_block((*out, *(then if test.value else other)), filters))
            else:
                out.append(If(test, then, other))
        elif isinstance(s, For):
            over = fold(s.over, filters)
            if not (isinstance(over, Const) and not over.value):
                out.append(For(s.name, over, fold_block(s.body, filters)))
        elif isinstance(s, Set):
            out.append(Set(s.name, fold(s.value, filters)))
        elif body := fold_block(s.body, filters):
            out.append(Generation(body))
    return tuple(out)


# --- closures -----------------------------------------------------------------------------------------------------


class Sink:
    """Takes (text, generated) pieces; ``pause`` is called after each round of an outermost loop."""

    def __init__(self) -> None:
        self.pieces: list[tuple[str, bool]] = []
        self.generated, self.size, self.loops = False, 0, 0

    def write(self, text: str) -> None:
        self.size += len(text)
        if self.size > MOST_TEXT:
            raise TemplateError("too much text")
        self.pieces.append((text, self.generated))

    def pause(self) -> None:
        pass


def _value(node: object, filters: dict[str, Callable]) -> Callable[[dict], object]:
    go = lambda x: _value(x, filters)
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Key):
        of, key = go(node.of), go(node.key)
        return lambda env: _key(of(env), key(env))
    if isinstance(node, Filter):
        f, args = filters[node.name], [go(a) for a in node.args]
        return lambda env: f(*[a(env) for a in args])
    op, args = node.op, [go(a) for a in node.args]
    if op == "not":
        return lambda env, a=args[0]: not a(env)
    a, b = args
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _binary(op, a(env), b(env))


def _statement(node: object, filters: dict[str, Callable]) -> Callable[[dict, Sink], None]:
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            return lambda env, out, v=_text(node.value.value): out.write(v)
        value = _value(node.value, filters)
        return lambda env, out: out.write(_text(value(env)))
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def assign(env: dict, out: Sink) -> None:
            env[node.name] = value(env)

        return assign
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _block(node.then, filters), _block(node.other, filters)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(node, Generation):
        body = _block(node.body, filters)

        def mark(env: dict, out: Sink) -> None:
            was, out.generated = out.generated, True
            body(env, out)
            out.generated = was

        return mark
    over, body = _value(node.over, filters), _block(node.body, filters)

    def loop(env: dict, out: Sink) -> None:
        values = over(env)
        if values is None:
            return
        if isinstance(values, (str, int, dict)):
            raise TemplateError("a loop needs a list")
        ahead, i, nothing = iter(values), 0, object()
        item = next(ahead, nothing)
        out.loops += 1
        outer = {n: env.get(n) for n in (node.name, "loop")}
        while item is not nothing:
            later = next(ahead, nothing)
            env[node.name], env["loop"] = item, {"index0": i, "index": i + 1, "first": i == 0, "last": later is nothing}
            body(env, out)
            if out.loops == 1:
                out.pause()
            item, i = later, i + 1
        out.loops -= 1
        env.update(outer)

    return loop


def _block(body: tuple, filters: dict[str, Callable]) -> Callable[[dict, Sink], None]:
    steps = [_statement(s, filters) for s in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Sink) -> None:
        for s in steps:
            s(env, out)

    return run


#: Filters that every template has.
BASE_FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "default": lambda x, other="": other if x is None else x,
}


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict, Sink], None]:
    """render(env, sink). Filters are pure functions of their arguments."""
    own = BASE_FILTERS | (filters or {})
    return _block(fold_block(parse(source, own), own), own)


def render(source: str, env: dict[str, object], filters: dict[str, Callable] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the spans (start, end) that are marked as generated."""
    out = Sink()
    compile_template(source, filters)(dict(env), out)
    spans: list[tuple[int, int]] = []
    at = 0
    for text, generated in out.pieces:
        if generated and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        at += len(text)
    return "".join(t for t, _ in out.pieces), spans


Messages = Iterable[dict[str, str]]
