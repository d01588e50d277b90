"""``dt``: filter, derive or aggregate, select, order and limit in one call.

The steps run in this order: where, set or agg, select, order_by, take. All but the marked ones are lazy; Catalyst
sees one declarative plan. Row order, where it matters, is (within_order, then the order of the input), the latter as
an id taken on the scan, before any shuffle.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequery.errors import DtError, unknown_columns
from framequery.expr import Col, Expr, Op, Win, Xbar, columns_of, expression, has_window, rewrite, walk
from framequery.expr import xbar as xbar_node
from framequery.functions import numbers as N
from framequery.functions.quantiles import percentiles
from framequery.lower import RID, Lower, Order, Scope, bins, order_columns, quoted, shares, window_forbidden, xbar_column
from framequery.operators.whole import derive_whole, spreadable

log = logging.getLogger("framequery")
_SAID: set[str] = set()


def note_once(text: str) -> None:
    if text not in _SAID:
        _SAID.add(text)
        log.info(text)


def reset_notes() -> None:
    _SAID.clear()


# -- markers

def asc(name: str) -> Order:
    return Order(name)


def desc(name: str) -> Order:
    return Order(name, True)


@dataclass(frozen=True)
class Between:
    first: str
    last: str


def between(first: str, last: str) -> Between:
    """The columns from one to the other, in either order, both included."""
    return Between(first, last)


@dataclass(frozen=True)
class Without:
    names: tuple


def without(*names: str) -> Without:
    return Without(names)


@dataclass(frozen=True)
class Qtile:
    col: str
    n: int
    within: Expr | None = None

    @property
    def name(self) -> str:
        return f"{self.col}-q{self.n}"


def qtile(name: str, n: int, within: Any = None) -> Qtile:
    """Quantile group of a column: a group key for ``by``."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 2:
        raise DtError("qtile-invalid-n", f"{n!r} is not a number of groups", n=n)
    if not isinstance(name, str):
        raise DtError("qtile-invalid-col", f"{name!r} is not a column", col=name)
    if within is not None and not isinstance(within, (Expr, str, list, tuple)):
        raise DtError("qtile-invalid-from", f"{within!r} is not a condition")
    return Qtile(name, n, None if within is None else expression(within))


def cut(*_args: Any) -> None:
    raise DtError("cut-standalone-not-supported", "cut is an expression; group by it with qtile")


def xbar(x: Any, width: int, unit: str | None = None) -> Xbar:
    return xbar_node(x, width, unit)


NUMERICAL, NOT_NUMERICAL = ":type/numerical", ":!type/numerical"


@dataclass(frozen=True)
class Typed:
    """A Python function with the type that it returns; unmarked functions return doubles (booleans in ``where``)."""

    f: Callable
    kind: str
    name: str | None = None

    def __call__(self, *a):
        return self.f(*a)


def typed(kind: str, name: str | None = None) -> Callable[[Callable], Typed]:
    return lambda f: Typed(f, kind, name)


def pass_nil(f: Callable, *guards: str) -> Callable:
    """f of the row, or None if a guard column is missing."""
    g = lambda r: None if any(r.get(k) is None for k in guards) else f(r)
    return Typed(g, f.kind, f.name) if isinstance(f, Typed) else g


@dataclass(frozen=True)
class Grouping:
    """Keys and order, the table they were prepared from, and that table dealt and sorted by them."""

    by: tuple
    within_order: tuple
    df: DataFrame
    source: DataFrame


def prepare_grouping(df: DataFrame, by: list[str], within_order: list | None = None, persist: bool = False) -> Grouping:
    """Shuffle and sort once for several derivations over the same groups: derivations of the table, and of what such
    derivations gave, share one shuffle and one sort. A table made from it in other ways (filtered, say) is worked on by
    its own rows, with the same keys and order. ``persist`` keeps the rows (memory, then disk) for separate actions."""
    if any(not isinstance(b, str) for b in by) or not by:
        raise DtError("invalid-grouping-by", "a grouping needs names of columns", by=by)
    unknown_columns(by, df.columns, "by")
    orders = order_specs(within_order or [], df, "within-order-invalid")
    out = df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())
    out = out.repartition(*map(quoted, by)).sortWithinPartitions(*map(quoted, by), *order_columns(orders), quoted(RID))
    return Grouping(tuple(by), tuple(orders), out.persist() if persist else out, df)


def _lineage(df: DataFrame, names: tuple) -> dict[str, int]:
    """The identities of columns, which filters and further columns leave as they are."""
    out = df._jdf.queryExecution().analyzed().output()
    attributes = [out.apply(i) for i in range(out.size())]
    return {a.name(): a.exprId().id() for a in attributes if a.name() in names}


def _grouped(df: DataFrame, grouping: Grouping) -> DataFrame:
    """The rows of df, dealt and sorted as prepared where they still are."""
    if df is grouping.source or df is grouping.df:
        return grouping.df
    held = df.__dict__.get("_fq_held")
    if held is not None and held[0] is grouping:
        return held[1]
    if len(_lineage(df, grouping.by)) < len(grouping.by) or _lineage(df, grouping.by) != _lineage(grouping.df, grouping.by):
        raise DtError("grouping-row-mismatch", "the grouping was prepared from another table")
    return df


# -- orders

def order_specs(specs: list, df: DataFrame, code: str = "invalid-order-spec") -> list[Order]:
    out = []
    for s in specs if isinstance(specs, (list, tuple)) else [specs]:
        s = Order(s) if isinstance(s, str) else s
        if not isinstance(s, Order):
            raise DtError(code, f"{s!r} is neither a column nor asc / desc of one", spec=repr(s))
        out.append(s)
    unknown_columns([s.col for s in out], df.columns, "the order")
    return out


# -- steps

def _udf(f: Callable, kind: str, df: DataFrame) -> Column:
    return F.udf(lambda r: f(r.asDict()), kind, useArrow=True)(F.struct(*[quoted(c) for c in df.columns if c != RID]))


def _where(df: DataFrame, where: Any) -> DataFrame:
    if callable(where) and not isinstance(where, Expr):
        return df.filter(_udf(lambda r: bool(where(r)), "boolean", df))
    n = expression(where, elementwise=True)
    window_forbidden(n, "where")
    held = RID in df.columns or not order_sensitive(n)
    own = df if held else df.withColumn(RID, F.monotonically_increasing_id())
    lower = Lower(Scope(own))
    lower.check(n, "where")
    out = own.filter(lower.predicate(n))
    return out if held else out.drop(RID)


def order_sensitive(n: Expr) -> bool:
    return any(isinstance(x, Op) and x.name in ("first-val", "last-val") for x in walk(n))


def _staged_ema(df: DataFrame, n: Expr, by: list[str], orders: list[Order], made: list[str]) -> tuple[DataFrame, Expr]:
    """Averages that refer to themselves become columns first: their recursion is no window frame."""
    for w in [x for x in walk(n) if isinstance(x, Win) and x.name == "ema"]:
        opts = dict(w.opts)
        p = opts.get("alpha", opts.get("period", w.args[1].value if len(w.args) > 1 else None))
        if p is None or ("alpha" in opts and "period" in opts) or not isinstance(p, (int, float)) or p <= 0:
            raise DtError("ema-opts", "give a period, or one of alpha and period", opts=opts)
        alpha = p if "alpha" in opts or ("period" not in opts and p < 1) else 2 / (1 + p)
        source, name = f"__in{len(made)}", f"__ema{len(made)}"
        made += [source, name]
        df = df.withColumn(source, N.no_nan(Lower(Scope(df, "window" if by else "row", by, order_columns(orders), orders=orders)).column(w.args[0]).cast("double")))
        df = _ema(df, source, name, float(alpha), by, order_columns(orders))
        n = rewrite(n, lambda x, w=w, name=name: Col(name) if x == w else x)
    return df, n


def _ema(df: DataFrame, source: str, name: str, alpha: float, by: list[str], order: list[Column]) -> DataFrame:
    """Streams the sorted partitions through Python, a batch at a time, with one number of state: groups of any length
    run in the memory of a batch."""
    import pyarrow as pa

    rows = df.repartition(*map(quoted, by)) if by else df.coalesce(1)
    rows = rows.sortWithinPartitions(*map(quoted, by), *order, quoted(RID))
    same = [rows.columns.index(k) for k in by]
    at = rows.columns.index(source)

    def run(batches):
        last, value = None, None
        for b in batches:
            ks = list(zip(*(b.column(i).to_pylist() for i in same), strict=True)) if same else [()] * b.num_rows
            out = []
            for k, x in zip(ks, b.column(at).to_pylist(), strict=True):
                if k != last:
                    last, value = k, None
                if x is not None:
                    value = x if value is None else alpha * x + (1 - alpha) * value
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], schema=b.schema.append(pa.field(name, pa.float64())))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def _derive(df: DataFrame, pairs: list[tuple[str, Any]], by: list[str], orders: list[Order], spread: bool = False) -> DataFrame:
    """One simultaneous step."""
    made: list[str] = []
    new = {}
    if spread and not by:
        nodes = {name: expression(x) for name, x in pairs if not callable(x) or isinstance(x, Expr)}
        windows = {k: n for k, n in nodes.items() if has_window(n)}
        if windows and spreadable(list(windows.values())):
            for name, n in windows.items():
                Lower(Scope(df)).check(n, f"set {name}")
            kept = {k: f"__new_{k}" for k in windows}
            df = derive_whole(df, {kept[k]: n for k, n in windows.items()}, orders)
            made += kept.values()
            pairs = [(k, Col(kept[k]) if k in kept else x) for k, x in pairs]
    for name, x in pairs:
        if callable(x) and not isinstance(x, Expr):
            new[name] = _udf(x, x.kind if isinstance(x, Typed) else "double", df)
            continue
        n = expression(x)
        Lower(Scope(df)).check(n, f"set {name}")
        df, n = _staged_ema(df, n, by, orders, made)
        new[name] = Lower(Scope(df, "window" if by else "row", by, order_columns(orders), orders=orders)).column(n)
    return df.withColumns(new).drop(*made)


def _set(df: DataFrame, derivations: Any, by: list[str], orders: list[Order], spread: bool) -> DataFrame:
    if isinstance(derivations, dict):
        nodes = {k: expression(v) for k, v in derivations.items() if isinstance(v, (Expr, str))}
        for name, n in nodes.items():
            used = [c for c in columns_of(n) if c in derivations and c != name and c not in df.columns]
            crossed = used or [c for c in columns_of(n) if c in derivations and c != name]
            if crossed:
                raise DtError("map-set-cross-reference", f"{name} refers to {', '.join(crossed)}, derived in the same step; use a list of pairs", column=name, refers=crossed)
        return _derive(df, list(derivations.items()), by, orders, spread)
    for name, x in derivations:
        df = _derive(df, [(name, x)], by, orders, spread)
    return df


def _keys(df: DataFrame, by: Any) -> tuple[DataFrame, list[str], list[str]]:
    """Group keys as columns; names of the keys, and of those added here."""
    if callable(by) and not isinstance(by, Expr):
        kind = by.kind if isinstance(by, Typed) else None
        if kind is None or not kind.startswith("struct"):
            raise DtError("invalid-grouping-by", "mark a grouping function with typed('struct<...>')")
        names = [f.name for f in T._parse_datatype_string(kind).fields]
        return df.withColumn("__key", _udf(by, kind, df)).withColumns({n: F.col("__key")[n] for n in names}).drop("__key"), names, names
    plain = [b for b in by if isinstance(b, str)]
    unknown_columns(plain, df.columns, "by")
    names, added = [], []
    for i, b in enumerate(by):
        if isinstance(b, str):
            names.append(b)
        elif isinstance(b, Xbar):
            source = b.arg.name if isinstance(b.arg, Col) else f"xbar-{i}"
            lower = Lower(Scope(df))
            lower.check(b, "by")
            x = lower.column(b.arg)
            df = df.withColumn(source, xbar_column(x, lower.kind(x), b.width, b.unit))
            names.append(source)
            added.append(source)
        elif isinstance(b, Qtile):
            df = _qtile(df, b, plain)
            names.append(b.name)
            added.append(b.name)
        elif callable(b):
            name = b.name if isinstance(b, Typed) and b.name else f"fn-{i}"
            df = df.withColumn(name, _udf(b, b.kind if isinstance(b, Typed) else "string", df))
            names.append(name)
            added.append(name)
        else:
            raise DtError("invalid-grouping-by", f"{b!r} can't be a group key", key=repr(b))
    return df, names, added


def _qtile(df: DataFrame, q: Qtile, exact: list[str]) -> DataFrame:
    unknown_columns([q.col, *(columns_of(q.within) if q.within is not None else [])], df.columns, "qtile")
    lower = Lower(Scope(df))
    x = lower.column(Col(q.col))
    ref = x.cast("double") if q.within is None else F.when(lower.predicate(q.within), x.cast("double"))
    if exact:  # one row of breaks for each exact key meets its rows in the same partitioning
        over = W.partitionBy(*map(quoted, exact))
        breaks, present = F.percentile(N.finite(ref), shares(q.n)).over(over), F.count(ref).over(over)
    else:
        breaks, present = percentiles(df, N.finite(ref), [i / q.n for i in range(1, q.n)]).scalar(), df.agg(F.count(ref).alias("n")).scalar()
    return df.withColumn(q.name, F.when(present >= q.n, bins(x, breaks, q.n, bool(exact))).when(x.isNotNull(), F.lit(1)).cast("int"))


def _agg(df: DataFrame, by: Any, aggs: dict, orders: list[Order]) -> DataFrame:
    names: list[str] = []
    if by:
        df, names, _ = _keys(df, by)
    plain = {k: v for k, v in aggs.items() if callable(v) and not isinstance(v, Expr)}
    nodes = {k: expression(v) for k, v in aggs.items() if k not in plain}
    place = None
    if any(order_sensitive(n) for n in nodes.values()):
        if any(o.descending for o in orders):
            rank = F.row_number().over(W.partitionBy(*map(quoted, names)).orderBy(*order_columns(orders), quoted(RID)))
            df, place = df.withColumn("__place", rank), F.col("__place")
        else:
            place = F.struct(*[quoted(o.col) for o in orders], quoted(RID))
    lower = Lower(Scope(df, "group", names, place=place))
    columns = []
    for k, n in nodes.items():
        window_forbidden(n, "agg")
        lower.check(n, f"agg {k}")
        columns.append(lower.column(n).alias(k))
    out = None
    if columns or not plain:
        out = df.groupBy(*map(quoted, names)).agg(*columns) if columns else df.select(*map(quoted, names)).distinct()
    for k, f in plain.items():
        part = _plain_agg(df, names, k, f)
        if out is None:
            out = part
        else:
            a, b = out.alias("a"), part.alias("b")
            match = F.lit(True)
            for c in names:
                match = match & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
            out = a.join(b, match).select("a.*", F.col(f"b.`{k}`"))
    return out.select(*map(quoted, [*names, *aggs]))


def _plain_agg(df: DataFrame, names: list[str], k: str, f: Callable) -> DataFrame:
    """A Python function of the group as a pandas frame."""
    import pandas as pd

    kind = f.kind if isinstance(f, Typed) else "double"
    schema = T.StructType([*[df.schema[n] for n in names], T.StructField(k, T._parse_datatype_string(kind))])
    columns = [c for c in df.columns if not c.startswith("__")]

    def run(key, pdf):
        v = f(pdf[columns])
        if isinstance(v, (pd.Series, pd.DataFrame)):
            raise DtError("agg-plain-fn-returned-non-scalar", f"{k} gave a {type(v).__name__}", column=k)
        return pd.DataFrame({**{n: [x] for n, x in zip(names, key, strict=True)}, k: [v]})

    if names:
        return df.groupBy(*map(quoted, names)).applyInPandas(run, schema)
    return df.groupBy(F.lit(0)).applyInPandas(lambda key, pdf: run((), pdf), schema)


def _select(df: DataFrame, select: Any) -> DataFrame:
    names = [c for c in df.columns if c != RID]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, N.NUMERIC) and f.name != RID]
    hidden = [quoted(RID)] if RID in df.columns else []
    if isinstance(select, dict):
        unknown_columns(select, names, "select")
        return df.select(*[quoted(a).alias(b) for a, b in select.items()], *hidden)
    if isinstance(select, Without):
        unknown_columns(select.names, names, "select")
        chosen = [c for c in names if c not in select.names]
    elif isinstance(select, Between):
        unknown_columns([select.first, select.last], names, "select")
        i, j = sorted((names.index(select.first), names.index(select.last)))
        chosen = names[i : j + 1]
    elif select == NUMERICAL:
        chosen = numeric
    elif select == NOT_NUMERICAL:
        chosen = [c for c in names if c not in numeric]
    elif isinstance(select, re.Pattern):
        chosen = [c for c in names if select.search(c)]
    elif callable(select):
        chosen = [c for c in names if select(c)]
    else:
        chosen = [select] if isinstance(select, str) else list(select)
        unknown_columns(chosen, names, "select")
    return df.select(*map(quoted, chosen), *hidden)


def _order_take(df: DataFrame, order_by: Any, take: int | None) -> DataFrame:
    orders = order_specs(order_by, df) if order_by is not None else []
    rid = [quoted(RID)] if RID in df.columns else []
    if take is None:
        return df.orderBy(*order_columns(orders), *[r.asc() for r in rid]) if orders else df
    if take >= 0:
        return (df.orderBy(*order_columns(orders), *[r.asc() for r in rid]) if orders or rid else df).limit(take)
    # the last rows: the first in the opposite order (no full sort), put right again
    last = df.orderBy(*order_columns(orders, backwards=True), *[r.desc() for r in rid]).limit(-take)
    return last.orderBy(*order_columns(orders), *[r.asc() for r in rid])


def dt(df: DataFrame, *, where: Any = None, set: Any = None, agg: dict | None = None, by: Any = None, within_order: Any = None, select: Any = None, order_by: Any = None, take: int | None = None, grouping: Grouping | None = None, off_heap: bool | None = None, spread: bool = False) -> DataFrame:  # noqa: A002
    """One query. With ``spread``, window functions without ``by`` run over ranges of the table (which are written once)
    instead of in one task. ``off_heap`` is accepted for compatibility and has no effect: Spark manages the memory."""
    if set is not None and agg is not None:
        raise DtError("set-agg-conflict", "a query derives or aggregates, not both")
    if take is not None and (not isinstance(take, int) or isinstance(take, bool)):
        raise DtError("invalid-take", f"{take!r} is not a number of rows", take=take)
    if grouping is not None:
        if set is None:
            raise DtError("grouping-requires-set", "a prepared grouping serves derivations")
        if by is not None or within_order is not None or where is not None:
            raise DtError("grouping-conflict", "a prepared grouping has its own by and within_order, and rows can't be filtered under it")
        had = RID in df.columns
        df, by, within_order = _grouped(df, grouping), list(grouping.by), list(grouping.within_order)
    if within_order is not None and set is None and agg is None:
        raise DtError("within-order-invalid", "within_order belongs to set or agg")
    if isinstance(by, (str, Xbar, Qtile)):
        by = [by]
    if grouping is None:
        had = RID in df.columns
    nodes = [expression(x) for x in ((set.values() if isinstance(set, dict) else [p[1] for p in set]) if set else []) if isinstance(x, (Expr, str, list, tuple))]
    ordered = [n for n in [*nodes, *(expression(x) for x in (agg or {}).values() if isinstance(x, (Expr, str)))] if has_window(n) or order_sensitive(n)]
    if where is not None:
        df = _where(df, where)
    if RID not in df.columns and (ordered or (take is not None and take < 0) or within_order is not None):
        # after the filter, which keeps the order: an id below it would hold the filter back from the scan
        df = df.withColumn(RID, F.monotonically_increasing_id())
    if set is not None:
        orders = order_specs(within_order or [], df, "within-order-invalid")
        if ordered and not orders:
            note_once("window functions without within_order use the order of the input")
        names: list[str] = []
        before = df.columns
        if by:
            clash = [b for b in by if isinstance(b, Xbar)] if isinstance(by, (list, tuple)) else []
            kept = {b.arg.name: f"__was_{b.arg.name}" for b in clash if isinstance(b.arg, Col)}
            df = df.withColumns({k: quoted(c) for c, k in kept.items()})
            df, names, added = _keys(df, by)
            # in a derivation keys only group: none is added, and bucketed columns keep their values
            df = df.withColumnsRenamed({n: f"__key_{n}" for n in added}).withColumnsRenamed({k: c for c, k in kept.items()})
            names = [f"__key_{n}" if n in added else n for n in names]
        derived = [k for k in (set if isinstance(set, dict) else dict(set))]
        df = _set(df, set, names, orders, spread)
        df = df.select(*[quoted(c) for c in [*before, *[d for d in derived if d not in before]] if c in df.columns])
        if orders and not by:
            df = df.orderBy(*order_columns(orders), quoted(RID))
    if agg is not None:
        if not by:
            note_once("an aggregation without by gives one row")
        df = _agg(df, by, agg, order_specs(within_order or [], df, "within-order-invalid"))
    if select is not None:
        df = _select(df, select)
    df = _order_take(df, order_by, take)
    out = df if had else df.drop(RID)
    if grouping is not None and order_by is None and take is None:
        out._fq_held = (grouping, df)  # a further pass goes on from the rows with their ids, still dealt and sorted
    return out


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    unknown_columns(names, df.columns, "rename")
    return df.withColumnsRenamed(names)


def row_numbered(df: DataFrame) -> DataFrame:
    """Pin the order of the input: later steps break ties by it."""
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())
