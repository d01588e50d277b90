"""Short names for interactive work: ``from framequery.concise import *``."""

from __future__ import annotations

from framequery.expr import agg as _agg
from framequery.expr import col, e, if_, row, stat, win
from framequery.operators.joins import join
from framequery.operators.query import asc, between, cut, desc, dt, pass_nil, qtile, rename, xbar
from framequery.operators.reshape import cast, melt
from framequery.operators.tidy import describe

__all__ = ["N", "asc", "between", "cast", "col", "ct", "cut", "desc", "describe", "div0", "dt", "e", "fst", "if_", "join", "lst", "md", "melt", "mi", "mn", "mx", "nuniq", "pass_nil", "qnt", "qtile", "rename", "row", "sd", "sm", "stat", "variance", "wa", "win", "ws", "xbar"]

N = _agg("N")


def _one(name: str):
    def make(x, *more):
        return _agg(name, col(x) if isinstance(x, str) else x, *[col(m) if isinstance(m, str) else m for m in more])

    make.__name__ = name
    make.__doc__ = f"The aggregate {name} of a column (name or expression)."
    return make


mn, sm, md, sd, variance, mx, mi, nuniq, fst, lst, qnt, wa, ws = map(_one, ("mn", "sm", "md", "sd", "variance", "mx", "mi", "nuniq", "first-val", "last-val", "qnt", "wavg", "wsum"))


def ct(_x=None):
    """All rows, missing or not: unlike the aggregate ``ct`` in expressions, which counts values."""
    return _agg("N")


def div0(a, b):
    from framequery.expr import op

    return op("div0", col(a) if isinstance(a, str) else a, col(b) if isinstance(b, str) else b)
