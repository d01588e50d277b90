"""Expressions as values: frozen nodes, Python builders, an s-expression reader and list forms.

Three ways to write one expression::

    col("mass") > 4000          e("(> :mass 4000)")          form(["and", [">", ":mass", 4000]])

Nodes know nothing of Spark; ``framequery.lower`` turns them into columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any

from framequery.errors import DtError, closest

AGGREGATES = {"mn": 1, "sm": 1, "md": 1, "qnt": (2, 3), "sd": 1, "variance": 1, "mx": 1, "mi": 1, "ct": 1, "nuniq": 1, "first-val": 1, "last-val": 1, "wavg": 2, "wsum": 2, "N": 0}
COMPARISONS = (">", "<", ">=", "<=", "=", "and", "or", "not", "in", "between?")
ARITHMETIC = ("+", "-", "*", "/", "sq", "log")
SCALARS = {"+": None, "-": None, "*": None, "/": 2, "div0": 2, "sq": 1, "log": 1, "asinh": 1, "na2zero": 1, "neg2na": 1, "nonfin2na": 1, ">": 2, "<": 2, ">=": 2, "<=": 2, "=": 2, "and": None, "or": None, "not": 1, "in": 2, "between?": 3}
ALIASES = {"mean": "mn", "sum": "sm", "median": "md", "stddev": "sd", "max*": "mx", "min*": "mi", "count*": "ct", "count-distinct": "nuniq", "fst": "first-val", "lst": "last-val", "wa": "wavg", "ws": "wsum", "nrow": "N", "coalescef": "coalesce-finite", "div": "/"}
WINDOWS = ("rank", "dense-rank", "row-number", "lag", "lead", "cumsum", "cummin", "cummax", "cummean", "rleid", "delta", "ratio", "differ", "grr", "mavg", "msum", "mmin", "mmax", "mdev", "mdowndev", "ema", "fills")
ROWS = ("sum", "mean", "min", "max", "count-nil", "any-nil?")
STATS = ("standardize", "demean", "winsorize")
SCAN_OPS, PRIOR_OPS = ("+", "*", "max", "min"), ("+", "-", "*", "/", "max", "min", ">", "<", ">=", "<=", "=")


class Expr:
    """Base of all nodes; operators build nodes."""

    def __add__(self, o): return op("+", self, o)  # noqa: E704
    def __radd__(self, o): return op("+", o, self)  # noqa: E704
    def __sub__(self, o): return op("-", self, o)  # noqa: E704
    def __rsub__(self, o): return op("-", o, self)  # noqa: E704
    def __mul__(self, o): return op("*", self, o)  # noqa: E704
    def __rmul__(self, o): return op("*", o, self)  # noqa: E704
    def __truediv__(self, o): return op("/", self, o)  # noqa: E704
    def __rtruediv__(self, o): return op("/", o, self)  # noqa: E704
    def __gt__(self, o): return op(">", self, o)  # noqa: E704
    def __lt__(self, o): return op("<", self, o)  # noqa: E704
    def __ge__(self, o): return op(">=", self, o)  # noqa: E704
    def __le__(self, o): return op("<=", self, o)  # noqa: E704
    def __and__(self, o): return op("and", self, o)  # noqa: E704
    def __or__(self, o): return op("or", self, o)  # noqa: E704
    def __invert__(self): return op("not", self)  # noqa: E704
    def eq(self, o): return op("=", self, o)  # noqa: E704
    def isin(self, values): return Op("in", (self, Lit(frozenset(values))))  # noqa: E704
    def between(self, lo, hi): return op("between?", self, lo, hi)  # noqa: E704

    def __str__(self) -> str:
        return to_string(self)


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Op(Expr):
    name: str
    args: tuple


@dataclass(frozen=True)
class If(Expr):
    test: Expr
    then: Expr
    other: Expr


@dataclass(frozen=True)
class Coalesce(Expr):
    args: tuple
    finite: bool = False


@dataclass(frozen=True)
class Win(Expr):
    name: str
    args: tuple
    opts: tuple = ()


@dataclass(frozen=True)
class Scan(Expr):
    name: str
    arg: Expr


@dataclass(frozen=True)
class EachPrior(Expr):
    name: str
    arg: Expr


@dataclass(frozen=True)
class Row(Expr):
    name: str
    args: tuple


@dataclass(frozen=True)
class Stat(Expr):
    name: str
    args: tuple


@dataclass(frozen=True)
class Cut(Expr):
    arg: Expr
    n: int
    within: Expr | None = None


@dataclass(frozen=True)
class Xbar(Expr):
    arg: Expr
    width: int
    unit: str | None = None


def node(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def col(name: str) -> Col:
    return Col(name)


def children(n: Expr) -> Iterator[Expr]:
    for f in fields(n):
        v = getattr(n, f.name)
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, Expr):
                yield x


def walk(n: Expr) -> Iterator[Expr]:
    yield n
    for x in children(n):
        yield from walk(x)


def rewrite(n: Expr, f: Callable[[Expr], Expr]) -> Expr:
    """Bottom-up replacement."""
    new = {}
    for fd in fields(n):
        v = getattr(n, fd.name)
        if isinstance(v, tuple):
            new[fd.name] = tuple(rewrite(x, f) if isinstance(x, Expr) else x for x in v)
        elif isinstance(v, Expr):
            new[fd.name] = rewrite(v, f)
    return f(replace(n, **new) if new else n)


def columns_of(n: Expr) -> list[str]:
    return list(dict.fromkeys(x.name for x in walk(n) if isinstance(x, Col)))


def has_window(n: Expr) -> bool:
    return any(isinstance(x, (Win, Scan, EachPrior)) for x in walk(n))


def has_aggregate(n: Expr) -> bool:
    return any((isinstance(x, Op) and x.name in AGGREGATES) or isinstance(x, (Cut, Stat)) for x in walk(n))


def _arity(name: str, n: int) -> None:
    want = AGGREGATES.get(name, SCALARS.get(name))
    lo, hi = want if isinstance(want, tuple) else (want, want) if want is not None else (1, None)
    if n < lo or (hi is not None and n > hi):
        raise DtError("wrong-arity", f"{name} takes {lo if lo == hi else f'{lo} or more'} arguments, not {n}", op=name, given=n)


def op(name: str, *args: Any, check: bool = True) -> Expr:
    """An operator or aggregate; names may be aliases."""
    name = ALIASES.get(name, name)
    if name not in SCALARS and name not in AGGREGATES:
        near = closest(name, [*SCALARS, *AGGREGATES, *ALIASES], 2, 3) if len(name) >= 2 else []
        raise DtError("unknown-op", f"{name}" + (f"; did you mean {', '.join(near)}?" if near else ""), op=name, suggestions=near)
    _arity(name, len(args))
    args = tuple(map(node, args))
    if check and name in ARITHMETIC and any(isinstance(a, Lit) and a.value is None for a in args):
        raise DtError("arith-nil-literal", f"{name} with nil is always missing", op=name)
    return Op(name, args)


def _win(name: str, args: tuple, opts: dict) -> Expr:
    if name == "scan" or name == "each-prior":
        f, x = args
        ok, code, kind = (SCAN_OPS, "win-scan-unknown-op", Scan) if name == "scan" else (PRIOR_OPS, "each-prior-unknown-op", EachPrior)
        f = f.value if isinstance(f, Lit) else f
        if f not in ok:
            raise DtError(code, f"{f} is not one of {', '.join(ok)}", op=f)
        return kind(f, node(x))
    if name not in WINDOWS:
        near = closest(name, WINDOWS, 2, 3)
        raise DtError("unknown-win-op", f"win/{name}" + (f"; did you mean {', '.join(near)}?" if near else ""), op=name, suggestions=near)
    return Win(name, tuple(map(node, args)), tuple(sorted(opts.items())))


class _Named:
    """win.lag(col("x"), 1, fill=0), row.mean(...), stat.demean(...)."""

    def __init__(self, make):
        self._make = make

    def __getattr__(self, name: str):
        return lambda *args, **opts: self._make(name.rstrip("_").replace("_", "-"), args, {k.replace("_", "-"): v for k, v in opts.items()})


def _row(name: str, args: tuple, _opts: dict) -> Expr:
    name = "any-nil?" if name == "any-nil" else name
    if name not in ROWS:
        raise DtError("unknown-row-op", f"row/{name}", op=name, suggestions=closest(name, ROWS, 2, 3))
    return Row(name, tuple(map(node, args)))


def _stat(name: str, args: tuple, _opts: dict) -> Expr:
    if name not in STATS:
        raise DtError("unknown-stat-op", f"stat/{name}", op=name, suggestions=closest(name, STATS, 2, 3))
    return Stat(name, tuple(map(node, args)))


win, row, stat = _Named(_win), _Named(_row), _Named(_stat)


def agg(name: str, *args: Any) -> Expr:
    return op(name, *args)


def if_(test: Any, then: Any, other: Any = None) -> If:
    return If(node(test), node(then), node(other))


def coalesce(*args: Any, finite: bool = False) -> Coalesce:
    return Coalesce(tuple(map(node, args)), finite)


def cut(x: Any, n: int, within: Any = None) -> Cut:
    return Cut(node(x), n, None if within is None else node(within))


def xbar(x: Any, width: int, unit: str | None = None) -> Xbar:
    return Xbar(col(x) if isinstance(x, str) else node(x), width, unit)


# -- the s-expression reader

_TOKEN = re.compile(r'\s*(?:,|;[^\n]*)*\s*(#\{|[()\[\]{}]|"(?:\\.|[^"\\])*"|[^\s()\[\]{},"]+)')


@dataclass(frozen=True)
class _Sym:
    name: str


@dataclass(frozen=True)
class _Key:
    name: str


def _read(text: str) -> Any:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            break
        tokens.append(m[1])
        at = m.end()
    form, rest = _one(tokens, 0)
    if rest != len(tokens):
        raise DtError("unreadable", f"more than one form in {text!r}")
    return form


def _one(t: list[str], i: int) -> tuple[Any, int]:
    if i >= len(t):
        raise DtError("unreadable", "the form ends too early")
    x = t[i]
    pairs = {"(": ")", "[": "]", "{": "}", "#{": "}"}
    if x in pairs:
        out, i = [], i + 1
        while i < len(t) and t[i] != pairs[x]:
            v, i = _one(t, i)
            out.append(v)
        if i >= len(t):
            raise DtError("unreadable", f"{pairs[x]} is missing")
        make = {"(": tuple, "[": list, "#{": frozenset, "{": lambda o: {k.name: v for k, v in zip(o[::2], o[1::2], strict=True)}}
        return make[x](out), i + 1
    if x.startswith('"'):
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1:-1]), i + 1
    if x.startswith(":"):
        return _Key(x[1:]), i + 1
    if x in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[x], i + 1
    if re.fullmatch(r"[+-]?\d+", x):
        return int(x), i + 1
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?", x):
        return float(x), i + 1
    return _Sym(x), i + 1


def e(text: str, **bound: Expr) -> Expr:
    """Read an s-expression; symbols may be bound to expressions by keyword."""
    return _parse(_read(text), dict(bound))


def _plain(x: Any) -> Any:
    if isinstance(x, (_Key, _Sym)):
        return x.name
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _parse(f: Any, env: dict[str, Expr]) -> Expr:
    if isinstance(f, Expr):
        return f
    if isinstance(f, _Key):
        return Col(f.name)
    if isinstance(f, _Sym):
        if f.name in env:
            return env[f.name]
        if f.name in ("N", "nrow"):
            return op("N")
        raise DtError("unknown-op", f"the symbol {f.name} is not bound", op=f.name)
    if isinstance(f, frozenset):
        return Lit(frozenset(_plain(x) for x in f))
    if isinstance(f, list):
        return Lit(tuple(_plain(f)))
    if not isinstance(f, tuple):
        return Lit(f)
    if not f or not isinstance(f[0], _Sym):
        raise DtError("unreadable", "a form starts with an operator")
    head, args = f[0].name, f[1:]
    sub = lambda x: _parse(x, env)
    if head == "if":
        return If(sub(args[0]), sub(args[1]), sub(args[2]) if len(args) > 2 else Lit(None))
    if head == "cond":
        if len(args) % 2:
            raise DtError("wrong-arity", "cond takes pairs", op="cond")
        out: Expr = Lit(None)
        for t, v in reversed(list(zip(args[::2], args[1::2], strict=True))):
            out = sub(v) if t == _Key("else") else If(sub(t), sub(v), out)
        return out
    if head in ("coalesce", "coalesce-finite", "coalescef"):
        return Coalesce(tuple(map(sub, args)), head != "coalesce")
    if head == "let":
        inner = dict(env)
        for s, v in zip(args[0][::2], args[0][1::2], strict=True):
            inner[s.name] = _parse(v, inner)
        return _parse(args[-1], inner)
    if head == "cut":
        opts = dict(zip(args[2::2], args[3::2], strict=True))
        return Cut(sub(args[0]), args[1], sub(opts[_Key("from")]) if _Key("from") in opts else None)
    if head == "xbar":
        return Xbar(sub(args[0]), args[1], _plain(args[2]) if len(args) > 2 else None)
    space, _, name = head.partition("/")
    if name and space in ("win", "row", "stat"):
        opts = {k: _plain(v) for x in args if isinstance(x, dict) for k, v in x.items()}
        rest = tuple(x.name if isinstance(x, _Sym) and x.name not in env else sub(x) for x in args if not isinstance(x, dict))
        return {"win": _win, "row": _row, "stat": _stat}[space](name, rest, opts)
    return op(head, *map(sub, args))


# -- list forms: [":and", [">=", ":m", lo], ...], element-wise in filters

def form(x: Any, elementwise: bool = False) -> Expr:
    """A list or tuple whose head is an operator; strings that start with ':' are columns."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, str) and x.startswith(":") and len(x) > 1:
        return Col(x[1:])
    if isinstance(x, (set, frozenset)):
        return Lit(frozenset(x))
    if not isinstance(x, (list, tuple)):
        return Lit(x)
    if not x or not isinstance(x[0], str):
        raise DtError("invalid-data-op", f"the head {x[:1]} of a form must be a name", form=x)
    name = ALIASES.get(x[0].lstrip(":"), x[0].lstrip(":"))
    known = [*SCALARS, "if", "coalesce"] + ([] if elementwise else [*AGGREGATES])
    space, _, tail = name.partition("/")
    if tail and space in ("win", "row", "stat") and not (elementwise and space == "win"):
        opts = {k.lstrip(":"): v for a in x[1:] if isinstance(a, dict) for k, v in a.items()}
        return {"win": _win, "row": _row, "stat": _stat}[space](tail, tuple(form(a) for a in x[1:] if not isinstance(a, dict)), opts)
    if name not in known:
        near = closest(name, known, 2, 3)
        raise DtError("unknown-data-op", f"{name}" + (f"; did you mean {', '.join(near)}?" if near else ""), op=name, suggestions=near)
    args = [form(a, elementwise) for a in x[1:]]
    if name == "if":
        return if_(*args)
    if name == "coalesce":
        return coalesce(*args)
    return op(name, *args, check=False)


def expression(x: Any, elementwise: bool = False) -> Expr:
    """An expression from a node, an s-expression string, or a list form."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, str):
        return e(x)
    if isinstance(x, (list, tuple)):
        return form(x, elementwise)
    return Lit(x)


def to_string(n: Any) -> str:
    """The expression as an s-expression again."""
    join = lambda head, xs: f"({' '.join([head, *map(to_string, xs)])})"
    if isinstance(n, Col):
        return f":{n.name}"
    if isinstance(n, Lit):
        v = n.value
        if isinstance(v, frozenset):
            return "#{" + " ".join(sorted(to_string(Lit(x)) for x in v)) + "}"
        if isinstance(v, tuple):
            return "[" + " ".join(to_string(Lit(x)) for x in v) + "]"
        return {None: "nil", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)
    if isinstance(n, Op):
        return "N" if n.name == "N" else join(n.name, n.args)
    if isinstance(n, If):
        return join("if", (n.test, n.then, n.other))
    if isinstance(n, Coalesce):
        return join("coalesce-finite" if n.finite else "coalesce", n.args)
    if isinstance(n, Win):
        tail = " {" + " ".join(f":{k} {to_string(Lit(v))}" for k, v in n.opts) + "}" if n.opts else ""
        return join(f"win/{n.name}", n.args)[:-1] + tail + ")"
    if isinstance(n, Scan):
        return f"(win/scan {n.name} {to_string(n.arg)})"
    if isinstance(n, EachPrior):
        return f"(win/each-prior {n.name} {to_string(n.arg)})"
    if isinstance(n, Row):
        return join(f"row/{n.name}", n.args)
    if isinstance(n, Stat):
        return join(f"stat/{n.name}", n.args)
    if isinstance(n, Cut):
        return f"(cut {to_string(n.arg)} {n.n}" + (f" :from {to_string(n.within)})" if n.within else ")")
    if isinstance(n, Xbar):
        return f"(xbar {to_string(n.arg)} {n.width}" + (f" :{n.unit})" if n.unit else ")")
    return repr(n)
