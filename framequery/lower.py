"""From expression nodes to Spark columns, in the scope of one derivation, filter or aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequery.errors import DtError, unknown_columns
from framequery.expr import AGGREGATES, Coalesce, Col, Cut, EachPrior, Expr, If, Lit, Op, Row, Scan, Stat, Win, Xbar, columns_of, has_window
from framequery.functions import numbers as N
from framequery.functions.quantiles import percentiles

RID = "__rid"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Order:
    col: str
    descending: bool = False


def order_columns(orders: list[Order], backwards: bool = False) -> list[Column]:
    """Missing values come first going up, last going down."""
    return [quoted(o.col).desc_nulls_last() if o.descending != backwards else quoted(o.col).asc_nulls_first() for o in orders]


@dataclass
class Scope:
    """Where an expression stands. ``mode``: row (whole-table aggregates), group (inside groupBy.agg), window (by given,
    aggregates cover the group), frame (aggregates over ``frame``, a window)."""

    df: DataFrame
    mode: str = "row"
    by: list[str] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)
    orders: list[Order] = field(default_factory=list)
    place: Column | None = None  # order of rows inside a group, as one sortable value
    frame: object = None
    names: dict[str, str] = field(default_factory=dict)  # for expressions on a joined table: name there -> name here

    @property
    def keys(self) -> list[Column]:
        return [quoted(b) for b in self.by]

    @property
    def rows(self):
        order = [*self.order, *([quoted(RID)] if RID in self.df.columns else [])]
        return W.partitionBy(*self.keys).orderBy(*order)

    @property
    def whole(self):
        return W.partitionBy(*self.keys)


class Lower:
    def __init__(self, scope: Scope):
        self.s = scope
        self.kinds = {f.name: f.dataType for f in scope.df.schema.fields}

    def check(self, n: Expr, where: str) -> None:
        unknown_columns([self.s.names.get(c, c) for c in columns_of(n)], self.s.df.columns, where)

    def kind(self, c: Column) -> T.DataType:
        return self.s.df.select(c.alias("v")).schema["v"].dataType

    # -- filters: true only where surely true; comparisons stay bare so that scans can use them

    def predicate(self, n: Expr) -> Column:
        if isinstance(n, Op) and n.name in ("and", "or") and not self._nil(n):
            out = self.predicate(n.args[0])
            for a in n.args[1:]:
                out = out & self.predicate(a) if n.name == "and" else out | self.predicate(a)
            return out
        if isinstance(n, Op) and n.name in (">", "<", ">=", "<=", "=", "between?", "in") and not self._nil(n):
            return self._compare(n)
        return F.coalesce(self.column(n).cast("boolean"), F.lit(False))

    @staticmethod
    def _nil(n: Op) -> bool:
        return any(isinstance(a, Lit) and a.value is None for a in n.args)

    def _bare(self, n: Expr) -> tuple[Column, Column | None]:
        """A bare column without its NaN guard, and the guard."""
        if isinstance(n, Col):
            name = self.s.names.get(n.name, n.name)
            c = quoted(name)
            return c, (~F.isnan(c) if isinstance(self.kinds.get(name), N.FLOATING) else None)
        return self.column(n), None

    def _compare(self, n: Op) -> Column:
        if n.name == "in":
            values = n.args[1].value if isinstance(n.args[1], Lit) else ()
            held = [v for v in values if v is not None]
            x = self.column(n.args[0])
            hit = x.isin(*held) if held else F.lit(False)
            return (hit | x.isNull()) if None in values else hit
        sides = [self._bare(a) for a in n.args]
        (a, _), (b, _) = sides[:2]
        guards = [g for _, g in sides if g is not None]
        if n.name == "between?":
            out = (a >= b) & (a <= sides[2][0])
        else:
            out = {">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b, "=": lambda: a == b}[n.name]()
        for g in guards:
            out = out & g
        return out

    # -- values

    def column(self, n: Expr) -> Column:
        return getattr(self, f"_{type(n).__name__.lower()}")(n)

    def _col(self, n: Col) -> Column:
        name = self.s.names.get(n.name, n.name)
        c = quoted(name)
        return N.no_nan(c) if isinstance(self.kinds.get(name), N.FLOATING) else c

    def _lit(self, n: Lit) -> Column:
        if isinstance(n.value, tuple):
            return F.array(*[F.lit(float(v)) for v in n.value])
        return F.lit(n.value)

    def _if(self, n: If) -> Column:
        test = F.coalesce(self.column(n.test).cast("boolean"), F.lit(False))
        out = F.when(test, self.column(n.then))
        return out if isinstance(n.other, Lit) and n.other.value is None else out.otherwise(self.column(n.other))

    def _coalesce(self, n: Coalesce) -> Column:
        xs = [self.column(a) for a in n.args]
        return F.coalesce(*[N.finite(x) for x in xs] if n.finite else xs)

    def _op(self, n: Op) -> Column:
        name = n.name
        if name in AGGREGATES:
            return self._aggregate(n)
        if name in (">", "<", ">=", "<=", "=", "and", "or", "not", "in", "between?"):
            if self._nil(n):
                return F.lit(False)
            if name == "not":
                return ~F.coalesce(self.column(n.args[0]).cast("boolean"), F.lit(False))
            if name in ("and", "or"):
                return F.coalesce(self.predicate(n), F.lit(False))
            return F.coalesce(self._compare(n), F.lit(False))
        xs = [self.column(a) for a in n.args]
        if name in ("+", "-", "*"):
            if name == "-" and len(xs) == 1:
                return F.try_subtract(F.lit(0), xs[0])
            f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[name]
            out = xs[0]
            for x in xs[1:]:
                out = f(out, x)
            return out
        if name == "/":
            return N.divide(*xs)
        if name == "div0":
            return N.divide_or_missing(*xs)
        if name == "sq":
            return F.try_multiply(xs[0], xs[0])
        if name == "log":
            return N.natural_log(xs[0])
        if name == "asinh":
            return N.arsinh(xs[0])
        f = N.finite(xs[0])
        if name == "na2zero":
            return F.coalesce(f, F.lit(0.0))
        return F.when(f >= 0, f) if name == "neg2na" else f

    # -- aggregates

    def _over(self, c: Column) -> Column:
        if self.s.mode == "group":
            return c
        if self.s.mode == "frame":
            return c.over(self.s.frame)
        if self.s.mode == "window":
            return c.over(self.s.whole)
        # one row for the whole table, computed once: no single-partition window over all rows
        return self.s.df.agg(c.alias("v")).scalar()

    def _shares(self, f: Column, shares: list[float]) -> Column:
        """The quantiles of f at the shares, as an array."""
        if self.s.mode == "row":
            return percentiles(self.s.df, f, shares).scalar()
        return self._over(F.percentile(f, F.array(*map(F.lit, shares))))

    def _inner(self, n: Expr) -> Column:
        return self.column(n)

    def _number(self, n: Expr) -> Column:
        """As a double, without NaN; columns have had theirs taken out."""
        d = self.column(n).cast("double")
        return d if isinstance(n, Col) else N.no_nan(d)

    def _aggregate(self, n: Op) -> Column:
        name = n.name
        if name == "N":
            return self._over(F.count(F.lit(1)) if self.s.mode != "frame" else F.count(quoted("__there")))
        x = self._inner(n.args[0])
        d = x.cast("double")
        if name in ("mn", "sm", "sd", "variance"):
            f = {"mn": F.avg, "sm": F.sum, "sd": F.stddev_samp, "variance": F.var_samp}[name]
            return self._over(f(self._number(n.args[0])))
        if name in ("mx", "mi"):
            return self._over((F.max if name == "mx" else F.min)(x))
        if name == "ct":
            return self._over(F.count(x))
        if name in ("md", "qnt"):
            return self._quantile(n, x)
        if name == "nuniq":
            if self.s.mode in ("group", "row"):
                return self._over(F.count_distinct(x))
            if self.s.mode == "frame":
                return F.size(F.collect_set(x).over(self.s.frame)).cast("long")
            place = F.dense_rank().over(W.partitionBy(*self.s.keys).orderBy(x.asc_nulls_last()))
            return F.coalesce(F.max(F.when(x.isNotNull(), place)).over(self.s.whole), F.lit(0)).cast("long")
        if name in ("wavg", "wsum"):
            v = self._inner(n.args[1]).cast("double")
            product = self._over(F.sum(d * v))
            return product if name == "wsum" else F.try_divide(product, self._over(F.sum(F.when(v.isNotNull(), d))))
        if self.s.mode == "window":
            f = F.first if name == "first-val" else F.last
            return f(x).over(self.s.rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        if self.s.mode == "row":  # the first row either way round: a top-1, not a sort of the table
            back = name == "last-val"
            rid = quoted(RID).desc() if back else quoted(RID).asc()
            return self.s.df.orderBy(*order_columns(self.s.orders, back), rid).select(x.alias("v")).limit(1).scalar()
        if self.s.place is None:
            raise DtError("within-order-invalid", f"{name} needs an order of rows")
        return self._over((F.min_by if name == "first-val" else F.max_by)(x, self.s.place))

    def _quantile(self, n: Op, x: Column) -> Column:
        kind = self.kind(x) if self.s.mode != "frame" else None
        if kind is not None and not isinstance(kind, (*N.NUMERIC, T.NullType)):
            raise DtError("quantile-non-numeric", f"quantiles need numbers, not {kind.simpleString()}", type=kind.simpleString())
        f = N.finite(x)
        if n.name == "md":
            return self._shares(f, [0.5])[0] if self.s.mode == "row" else self._over(F.percentile(f, F.lit(0.5)))
        p = n.args[1].value if isinstance(n.args[1], Lit) else None
        clip = lambda v: min(max(float(v), 0.0), 1.0)
        if isinstance(p, tuple):
            out = self._shares(f, [clip(v) for v in p])
        else:
            out = self._shares(f, [clip(p)])[0] if self.s.mode == "row" else self._over(F.percentile(f, F.lit(clip(p))))
        if len(n.args) > 2:
            out = F.when(self._over(F.count(f)) >= n.args[2].value, out)
        return out

    # -- rows, statistics, bins

    def _row(self, n: Row) -> Column:
        xs = [self.column(a) for a in n.args]
        missing = sum((x.isNull().cast("int") for x in xs), F.lit(0))
        if n.name == "count-nil":
            return missing
        if n.name == "any-nil?":
            return missing > 0
        ds = [N.no_nan(x.cast("double")) for x in xs]
        if n.name in ("min", "max"):
            return ds[0] if len(ds) == 1 else (F.least if n.name == "min" else F.greatest)(*ds)
        total = sum((F.coalesce(d, F.lit(0.0)) for d in ds), F.lit(0.0))
        present = sum((d.isNotNull().cast("int") for d in ds), F.lit(0))
        return F.when(present > 0, total if n.name == "sum" else total / present)

    def _stat(self, n: Stat) -> Column:
        x = self._number(n.args[0])
        if n.name == "demean":
            return x - self._over(F.avg(x))
        if n.name == "standardize":
            return F.try_divide(x - self._over(F.avg(x)), self._over(F.stddev_samp(x)))
        p = float(n.args[1].value)
        f = N.finite(x)
        ends = self._shares(f, [min(p, 1 - p), max(p, 1 - p)])
        # the middle one of the lower end, x and the upper end
        return F.when(x.isNotNull(), F.coalesce(F.get(F.sort_array(F.concat(ends, F.array(x))), F.lit(1)), x))

    def _cut(self, n: Cut) -> Column:
        x = self.column(n.arg)
        ref = N.finite(x)
        if n.within is not None:
            ref = F.when(F.coalesce(self.column(n.within).cast("boolean"), F.lit(False)), ref)
        return bins(x, self._shares(ref, [i / n.n for i in range(1, n.n)]), n.n, self.s.mode != "row")

    def _xbar(self, n: Xbar) -> Column:
        return xbar_column(self.column(n.arg), self.kind(self.column(n.arg)), n.width, n.unit)

    # -- windows

    def _need_rows(self) -> None:
        if self.s.mode not in ("window", "row"):
            raise DtError("win-outside-window", "window functions stand in derivations only")

    def _scan(self, n: Scan) -> Column:
        self._need_rows()
        x = self.column(n.arg)
        run = self.s.rows.rowsBetween(W.unboundedPreceding, 0)
        out = {"+": F.sum, "*": F.product, "max": F.max, "min": F.min}[n.name](x).over(run)
        if n.name == "*" and isinstance(self.kind(x), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            # products of whole numbers are whole; beyond what a double holds exactly they are missing, as overflows are
            return F.when(F.abs(out) < float(1 << 53), out).cast("long")
        return out

    def _eachprior(self, n: EachPrior) -> Column:
        self._need_rows()
        x = self.column(n.arg)
        b = F.lag(x).over(self.s.rows)
        both = x.isNotNull() & b.isNotNull()
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": N.divide, "max": F.greatest, "min": F.least, ">": lambda a, c: a > c, "<": lambda a, c: a < c, ">=": lambda a, c: a >= c, "<=": lambda a, c: a <= c, "=": lambda a, c: a == c}[n.name]
        return F.when(both, f(x, b))

    def _win(self, n: Win) -> Column:
        self._need_rows()
        rows, opts = self.s.rows, dict(n.opts)
        run = rows.rowsBetween(W.unboundedPreceding, 0)
        if n.name == "row-number":
            return F.row_number().over(rows)
        x = self.column(n.args[0])
        d = self._number(n.args[0])
        if n.name in ("rank", "dense-rank", "rleid", "differ"):
            first = F.row_number().over(rows) == 1
            changed = first | ~x.eqNullSafe(F.lag(x).over(rows))
            if n.name == "differ":
                return changed
            if n.name == "rank":
                return F.max(F.when(changed, F.row_number().over(rows))).over(run)
            return F.sum(changed.cast("int")).over(run)
        if n.name in ("lag", "lead"):
            f, k = F.lag if n.name == "lag" else F.lead, n.args[1].value
            if opts.get("fill") is None:
                return f(x, k).over(rows)
            # the fill takes the column's type; a missing value of the column itself stays missing
            edge = F.row_number().over(rows) <= k if n.name == "lag" else F.row_number().over(rows) > F.count(F.lit(1)).over(self.s.whole) - k
            return F.when(edge, F.lit(opts["fill"]).cast(self.kind(x))).otherwise(f(x, k).over(rows))
        if n.name == "cumsum":
            return F.coalesce(F.sum(d).over(run), F.lit(0.0))
        if n.name in ("cummin", "cummax"):
            return F.when(d.isNotNull(), (F.min if n.name == "cummin" else F.max)(d).over(run))
        if n.name == "cummean":
            return F.avg(d).over(run)
        if n.name == "fills":
            return F.last(x, ignorenulls=True).over(run)
        prior = F.lag(d).over(rows)
        if n.name == "delta":
            return d - prior
        if n.name == "ratio":
            return F.when(prior != 0, N.no_nan(F.try_divide(d, prior)))
        if n.name == "grr":
            return F.when((d == 0) & (prior == 0), F.lit(0.0)).otherwise(N.finite(N.arsinh(d) - N.arsinh(prior)))
        if n.name == "ema":
            raise DtError("ema-opts", "an average that refers to itself is staged by dt()")
        return self._rolling(n, d, opts)

    def _rolling(self, n: Win, d: Column, opts: dict) -> Column:
        width = n.args[1].value
        rows = self.s.rows
        frame = rows.rowsBetween(-(width - 1), 0)
        inside = F.least(F.row_number().over(rows), F.lit(width))
        if n.name == "mdev":
            ddof = opts.get("ddof", n.args[2].value if len(n.args) > 2 else 1)
            present = F.count(d).over(frame)
            square = F.var_pop(d).over(frame) * present / F.when(present - ddof > 0, present - ddof)
            out = F.stddev_samp(d).over(frame) if ddof == 1 else F.sqrt(square)
        elif n.name == "mdowndev":
            low = F.least(N.finite(d), F.lit(0.0))
            out = F.sqrt(F.avg(F.when(N.finite(d).isNotNull(), low * low)).over(frame))
        else:
            out = {"mavg": F.avg, "msum": F.sum, "mmin": F.min, "mmax": F.max}[n.name](d).over(frame)
        least = opts.get("min-periods")
        return out if least is None else F.when(inside >= least, out)


def shares(n: int) -> Column:
    return F.array(*[F.lit(i / n) for i in range(1, n)])


def bins(x: Column, breaks: Column, n: int, once: bool) -> Column:
    """1 + the number of breaks below x: ties go to the lowest bin; no breaks at all mean bin 1.

    Spark computes a window anew for each place that it stands in, so there ``breaks`` stands ``once``; a scalar
    subquery, which may not stand in a lambda, is computed once anyway.
    """
    if once:
        below = F.size(F.filter(F.coalesce(breaks, F.array().cast("array<double>")), lambda b: b < x))
    else:
        below = sum((F.coalesce(x > F.get(breaks, F.lit(i)), F.lit(False)).cast("int") for i in range(n - 1)), F.lit(0))
    return F.when(x.isNotNull(), below + 1)


def xbar_column(x: Column, kind: T.DataType, width: int, unit: str | None) -> Column:
    """Lower end of the bucket: of the truncated number, or of the count of units since the epoch."""
    if isinstance(kind, N.TEMPORAL):
        if unit not in N.UNIT_MS:
            raise DtError("xbar-unknown-unit", f"{unit} is not one of {', '.join(N.UNIT_MS)}", unit=unit)
        v = F.floor(N.epoch_ms(x, kind) / N.UNIT_MS[unit])
    else:
        v = x.cast("long")
    return (v - F.pmod(v, F.lit(width))).cast("long")


def window_forbidden(n: Expr, where: str) -> None:
    if has_window(n):
        raise DtError("win-outside-window", f"window functions can't stand in {where}")
