"""Window functions over a whole table without one task that sees it all.

The rows are dealt by ranges of their order and written. Functions that look back or ahead a bounded number of rows get
that many rows of the neighbouring ranges beside their own; running functions are computed within each range and
combined with one row a range of what came before. Only these rows, as many as there are ranges, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequery.expr import Col, EachPrior, Expr, Scan, Win, children, rewrite, walk
from framequery.functions import numbers as N
from framequery.lower import RID, Lower, Order, Scope, order_columns, quoted
from framequery.sources.scratch import written

PART, HALO, PLACE = "__part", "__halo", "__place"
RUNNING = ("cumsum", "cummin", "cummax", "cummean", "fills", "row-number", "rank", "dense-rank", "rleid")


def reach(n: Expr) -> int:
    """How many rows before or after its own a node looks at, its arguments' reach included."""
    own = 0
    if isinstance(n, Win) and n.name not in RUNNING:
        own = n.args[1].value if n.name in ("lag", "lead") or n.name[0] == "m" else 1
    elif isinstance(n, Win) and n.name in ("rank", "dense-rank", "rleid") or isinstance(n, EachPrior):
        own = 1
    return own + max((reach(c) for c in children(n)), default=0)


def spreadable(nodes: list[Expr]) -> bool:
    return not any(isinstance(x, Win) and x.name == "ema" for n in nodes for x in walk(n))


def dealt(df: DataFrame, orders: list[Order], most: int) -> DataFrame:
    """Rows with their range, and beside each range up to ``most`` rows of its neighbours (``__halo``)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order_columns(orders), quoted(RID)]
    rows = written(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(PART).count().collect()  # one row a range
    if not most or len(sizes) < 2:
        return rows.withColumn(HALO, F.lit(False))
    if min(r["count"] for r in sizes) < most:  # ranges too short for the reach: fewer and longer ones
        number, held, cuts = 0, 0, {}
        for p, size in sorted((r[PART], r["count"]) for r in sizes):
            cuts[p] = number
            held += size
            if held >= most:
                number, held = number + 1, 0
        if held and number:
            cuts = {p: min(i, number - 1) for p, i in cuts.items()}
    else:
        cuts = {p: i for i, p in enumerate(sorted(r[PART] for r in sizes))}
    names = F.create_map(*[F.lit(x) for p, i in cuts.items() for x in (p, i)])
    rows = rows.withColumn(PART, names[F.col(PART)])
    up, down = W.partitionBy(PART).orderBy(*order), W.partitionBy(PART).orderBy(*order_columns(orders, backwards=True), quoted(RID).desc())
    last = rows.withColumn("__n", F.row_number().over(down)).filter(F.col("__n") <= most).drop("__n").withColumn(PART, F.col(PART) + 1)
    first = rows.withColumn("__n", F.row_number().over(up)).filter(F.col("__n") <= most).drop("__n").withColumn(PART, F.col(PART) - 1)
    real = max(cuts.values())
    beside = last.unionByName(first).filter(F.col(PART).between(0, real)).withColumn(HALO, F.lit(True))
    return rows.withColumn(HALO, F.lit(False)).unionByName(beside)


def depth(n: Expr) -> int:
    """How many window functions lie within one another."""
    return isinstance(n, (Win, Scan, EachPrior)) + max((depth(c) for c in children(n)), default=0)


def _running(n: Expr) -> bool:
    return isinstance(n, Scan) or isinstance(n, Win) and n.name in RUNNING


def _fold(f):
    return lambda x, y: y if x is None else x if y is None else f(x, y)


#: What a range keeps (over its own column), and how two ranges' values are put together.
KEPT = {
    "+": (F.sum, _fold(lambda x, y: x + y)), "*": (F.product, _fold(lambda x, y: x * y)), "max": (F.max, _fold(max)), "min": (F.min, _fold(min)), "count": (F.count, _fold(lambda x, y: x + y)),
    "last": (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(PLACE))), _fold(lambda x, y: y)),
}


class Whole:
    """Adds a column for each window node, a level of nesting at a time. What the ranges keep comes to the driver, one row
    a range, and goes back as a small table."""

    def __init__(self, df: DataFrame, orders: list[Order]):
        self.df, self.orders, self.names = df, orders, {}
        self.run = W.partitionBy(PART).orderBy(*order_columns(orders), quoted(RID)).rowsBetween(W.unboundedPreceding, 0)

    def plain(self, n: Expr) -> Expr:
        """n with the nodes done so far replaced by their columns."""
        if n in self.names:
            return Col(self.names[n])
        return rewrite(n, lambda x: Col(self.names[x]) if x in self.names else x)

    def level(self, found: list[Expr]) -> None:
        """Nodes whose arguments hold no window that isn't done."""
        lower = Lower(Scope(self.df, "window", [PART], order_columns(self.orders), orders=self.orders))
        inner = {n: rewrite_arguments(n, self.plain) for n in found}
        name = {n: f"__w{len(self.names) + i}" for i, n in enumerate(found)}
        real = ~F.col(HALO)
        new, kept, final = {}, {}, {}
        new[PLACE] = F.count_if(real).over(self.run)  # place in the range
        for n, m in inner.items():
            if not _running(n):
                new[name[n]] = lower.column(m)
            elif isinstance(n, Win) and n.name in ("rank", "dense-rank", "rleid"):
                new[f"{name[n]}x"] = lower.column(Win("differ", m.args)) & real
            elif n != Win("row-number", ()):
                x = lower.column(m.arg if isinstance(m, Scan) else m.args[0])
                x = F.when(real, N.no_nan(x.cast("double")) if isinstance(n, Win) and n.name != "fills" else x)
                new[f"{name[n]}x"] = x
        self.df = self.df.withColumns(new)
        kept["n"] = F.max(PLACE), KEPT["+"][1]
        told = {}
        for n in filter(_running, found):
            x, k = f"{name[n]}x", name[n]
            if n == Win("row-number", ()):
                continue
            if isinstance(n, Win) and n.name in ("rank", "dense-rank", "rleid"):
                told[f"{k}a"] = F.count_if(F.col(x)), KEPT["+"][1]
                told[f"{k}b"] = F.max(F.when(F.col(x), F.col(PLACE))), None
                continue
            for tag, how in zip("ab", _how(n), strict=False):
                f, fold = KEPT[how]
                told[f"{k}{tag}"] = f(x), fold
        final = {**kept, **told}
        if any(map(_running, found)):
            self._before(final)
        done = {}
        for n in filter(_running, found):
            done[name[n]] = self._put(n, name[n])
        self.df = self.df.withColumns(done).drop(PLACE, *[f"{k}{t}" for k in done for t in "xab"], *(["n__"] if done else []))
        self.names.update(name)

    def _before(self, told: dict) -> None:
        rows = self.df.filter(~F.col(HALO)).groupBy(PART).agg(*[c.alias(k) for k, (c, _) in told.items()]).orderBy(PART)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        state: dict = dict.fromkeys(told)
        out = []
        for r in rows.collect():
            out.append((r[PART], *[state[k] for k in told]))
            before = state["n"] or 0
            for k, (_, fold) in told.items():
                # the place of the last change counts from the table's start
                state[k] = fold(state[k], r[k]) if fold else state[k] if r[k] is None else before + r[k]
        small = self.df.sparkSession.createDataFrame(out, schema).withColumnsRenamed({"n": "n__", PART: "__p"})
        self.df = self.df.join(F.broadcast(small), F.col(PART) == F.col("__p"), "left").drop("__p")

    def _put(self, n: Expr, k: str) -> Column:
        place = F.col(PLACE) + F.coalesce(F.col("n__"), F.lit(0))
        if n == Win("row-number", ()):
            return place.cast("int")
        x, a, b, run = F.col(f"{k}x"), F.col(f"{k}a"), F.col(f"{k}b") if f"{k}b" in self.df.columns else None, self.run
        if isinstance(n, Win) and n.name == "rank":
            return F.coalesce(F.max(F.when(x, place)).over(run), b).cast("int")
        if isinstance(n, Win) and n.name in ("dense-rank", "rleid"):
            return F.count_if(x).over(run) + F.coalesce(a, F.lit(0))
        how = _how(n)
        if how[0] == "last":
            return F.coalesce(F.last(x, ignorenulls=True).over(run), a)
        if len(how) == 2:
            count = F.count(x).over(run) + F.coalesce(b, F.lit(0))
            return F.when(count > 0, _either(F.sum(x).over(run), a, lambda p, q: p + q) / count)
        here = {"+": F.sum, "*": F.product, "max": F.max, "min": F.min}[how[0]](x).over(run)
        out = {"max": F.greatest, "min": F.least}[how[0]](here, a) if how[0] in ("max", "min") else _either(here, a, (lambda p, q: p + q) if how[0] == "+" else (lambda p, q: p * q))
        if isinstance(n, Win) and n.name == "cumsum":
            return F.coalesce(out, F.lit(0.0))
        return F.when(x.isNotNull(), out) if isinstance(n, Win) and n.name in ("cummin", "cummax") else out


def _how(n: Expr) -> tuple:
    if isinstance(n, Scan):
        return (n.name,)
    return {"cumsum": ("+",), "cummean": ("+", "count"), "cummin": ("min",), "cummax": ("max",), "fills": ("last",)}[n.name]


def _either(x: Column, y: Column, f) -> Column:
    return F.coalesce(f(x, y), x, y)


def rewrite_arguments(n: Expr, f) -> Expr:
    if isinstance(n, Win):
        return Win(n.name, tuple(f(x) for x in n.args), n.opts)
    return type(n)(n.name, f(n.arg))


def derive_whole(df: DataFrame, nodes: dict[str, Expr], orders: list[Order]) -> DataFrame:
    """All nodes over the whole table in its order; ``df`` has row ids."""
    w = Whole(dealt(df, orders, max(map(reach, nodes.values()), default=0)), orders)
    found = [x for n in nodes.values() for x in walk(n) if isinstance(x, (Win, Scan, EachPrior))]
    for k in sorted(set(map(depth, found))):
        w.level(list(dict.fromkeys(x for x in found if depth(x) == k)))
    plain = {k: w.plain(n) for k, n in nodes.items()}
    own = w.df.filter(~F.col(HALO)).drop(HALO, PART)
    lower = Lower(Scope(own, "row", orders=orders))
    out = own.withColumns({k: lower.column(n) for k, n in plain.items()})
    return out.select(*map(quoted, [*df.columns, *[k for k in nodes if k not in df.columns]]))
