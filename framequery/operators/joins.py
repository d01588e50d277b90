"""Equi-joins, as-of joins and window joins.

As-of: both sides in one table, one shuffle by the exact keys, and the last (or next) right row carried along the sorted
rows. With ``spread`` the rows are dealt by ranges of (keys, time) instead, so one key may hold most of the table: each
range carries within itself, and one row a range tells the next ones what came before.

Window joins: simple aggregates are RANGE frames over the same union; Python functions take a range join on time bins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequery.errors import DtError, unknown_columns
from framequery.expr import Expr, columns_of, expression
from framequery.functions import numbers as N
from framequery.lower import RID, Lower, Scope, quoted, window_forbidden
from framequery.operators.query import Typed, row_numbered
from framequery.sources.scratch import written

HOWS = ("inner", "left", "right", "outer", "asof", "window")
DIRECTIONS = ("backward", "forward", "nearest")
VALIDATE = {"1:1": (True, True), "1:m": (True, False), "m:1": (False, True), "m:m": (False, False)}


@dataclass(frozen=True)
class Report:
    """Distinct key tuples on both sides, on the left only, on the right only."""

    matched: int
    left_only: int
    right_only: int

    def __str__(self) -> str:
        return f"matched: {self.matched}, left only: {self.left_only}, right only: {self.right_only}"


def _names(keys: Any) -> list[str]:
    out = [keys] if isinstance(keys, str) else list(keys)
    if not out or any(not isinstance(k, str) for k in out):
        raise DtError("join-invalid-keys", f"{keys!r} is not a name or a list of names", keys=keys)
    return out


def _keys(on: Any, left_on: Any, right_on: Any) -> tuple[list[str], list[str]]:
    if on is not None:
        return _names(on), _names(on)
    if left_on is None or right_on is None:
        raise DtError("join-missing-keys", "give on, or left_on and right_on")
    a, b = _names(left_on), _names(right_on)
    if len(a) != len(b):
        raise DtError("join-invalid-keys", f"{len(a)} keys on the left, {len(b)} on the right", left=a, right=b)
    return a, b


def _unique(df: DataFrame, keys: list[str], side: str, validate: str) -> None:
    """An action: the first keys that occur more than once."""
    twice = df.groupBy(*map(quoted, keys)).count().filter("count > 1").limit(1).collect()
    if twice:
        raise DtError("join-cardinality-violation", f"{validate}: keys repeat on the {side}, as {twice[0][:-1]}", side=side, validate=validate, keys=tuple(twice[0][:-1]))


def join_report(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> Report:
    """An action: compares the distinct keys of both sides in one aggregation, without a join."""
    side = lambda df, keys, l, r: df.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(l).alias("l"), F.lit(r).alias("r"))
    both = side(left, left_keys, 1, 0).union(side(right, right_keys, 0, 1)).groupBy(*[f"k{i}" for i in range(len(left_keys))]).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    found = both.agg(*[F.count_if(F.expr(x)) for x in ("l + r = 2", "l > r", "l < r")]).first()
    return Report(*found)


def join(
    left: DataFrame, right: DataFrame, on: Any = None, *, left_on: Any = None, right_on: Any = None, how: str = "inner", validate: str | None = None, report: bool | Callable = False,
    direction: str = "backward", tolerance: Any = None, window: Any = None, agg: dict | None = None, right_index: Any = None, spread: bool = False,
) -> DataFrame:
    """Join two tables. ``validate`` and ``report`` are actions; ``report`` prints, or calls the function given.

    Columns of the right that clash are named ``right.<name>``. Missing keys match nothing in equi-joins and each other
    as exact keys of as-of and window joins.
    """
    how = str(how).lstrip(":")
    a, b = _keys(on, left_on, right_on)
    if how not in HOWS:
        raise DtError("join-unknown-how", f"{how} is not one of {', '.join(HOWS)}", how=how)
    direction = str(direction).lstrip(":")
    if direction not in DIRECTIONS:
        raise DtError("join-unknown-direction", f"{direction} is not one of {', '.join(DIRECTIONS)}", direction=direction)
    unknown_columns(a, left.columns, "the left of the join")
    unknown_columns(b, right.columns, "the right of the join")
    if validate is not None:
        validate = str(validate).lstrip(":")
        if validate not in VALIDATE:
            raise DtError("join-unknown-validate", f"{validate} is not one of {', '.join(VALIDATE)}", validate=validate)
        on_left, on_right = VALIDATE[validate]
        if on_left and how not in ("asof", "window"):
            _unique(left, a, "left", validate)
        if on_right:
            _unique(right, b, "right", validate)
    if report:
        found = join_report(left, right, a, b)
        report(found) if callable(report) else print(found)
    if right_index is not None and how in ("asof", "window"):
        right = _from_index(right_index, right, b)
    if how == "asof":
        return asof_join(left, right, a, b, direction, tolerance, spread)
    if how == "window":
        if spread:
            raise DtError("join-invalid-window", "spread serves as-of joins; a window join deals rows by its exact keys")
        if window is None:
            raise DtError("join-missing-window", "a window join needs window=[lo, hi] or [lo, hi, unit]")
        if not agg:
            raise DtError("join-missing-agg", "a window join needs agg={name: aggregate}")
        return window_join(left, right, a, b, window, agg)
    return _equi(left, right, a, b, how)


def _equi(left: DataFrame, right: DataFrame, a: list[str], b: list[str], how: str) -> DataFrame:
    if a == b:
        taken = [c for c in left.columns if c not in a]
        right = right.withColumnsRenamed({c: f"right.{c}" for c in right.columns if c not in b and c in taken})
        out = left.join(right, on=a, how=how)
        return out.select(*map(quoted, [*left.columns, *[c for c in right.columns if c not in b]]))
    right = right.withColumnsRenamed({c: f"right.{c}" for c in right.columns if c in left.columns})
    named = [f"right.{c}" if c in left.columns else c for c in b]
    match = F.lit(True)
    for x, y in zip(a, named, strict=True):
        match = match & (left["`" + x.replace("`", "``") + "`"] == right["`" + y.replace("`", "``") + "`"])
    return left.join(right, match, how)


def _from_index(index: Any, right: DataFrame, keys: list[str]) -> DataFrame:
    from framequery.operators.index import Index

    if not isinstance(index, Index):
        raise DtError("asof-index-required", "right_index takes an index")
    if index.kind != "asof":
        raise DtError("asof-index-wrong-kind", f"right_index takes an as-of index, not {index.kind}", kind=index.kind)
    if index.source is not right:
        raise DtError("asof-index-dataset-mismatch", "the index was made from another table")
    if list(index.keys) != keys:
        raise DtError("asof-index-keys-mismatch", f"the index has the keys {list(index.keys)}, the join {keys}", index=list(index.keys), join=keys)
    return index.df


# -- as-of

def _tolerance(tolerance: Any, kind: T.DataType) -> float | int | None:
    if tolerance is None:
        return None
    if isinstance(tolerance, (list, tuple)):
        if len(tolerance) != 2 or isinstance(tolerance[0], bool) or not isinstance(tolerance[0], (int, float)) or tolerance[0] < 0:
            raise DtError("join-tolerance-invalid", f"{tolerance!r} is not [number, unit]", tolerance=tolerance)
        unit = str(tolerance[1]).lstrip(":")
        if unit not in N.UNIT_MS:
            raise DtError("join-tolerance-unknown-unit", f"{unit} is not one of {', '.join(N.UNIT_MS)}", unit=unit)
        if not isinstance(kind, N.TEMPORAL):
            raise DtError("join-tolerance-non-numeric", "a tolerance with a unit needs a time as the as-of key")
        return tolerance[0] * N.UNIT_MS[unit]
    if isinstance(tolerance, bool) or not isinstance(tolerance, (int, float)) or tolerance < 0:
        raise DtError("join-tolerance-invalid", f"{tolerance!r} is no tolerance", tolerance=tolerance)
    if not isinstance(kind, N.NUMERIC):
        raise DtError("join-tolerance-non-numeric", "a bare number is a tolerance for numbers; give [n, unit] for times")
    return tolerance


def _measure(c: Column, kind: T.DataType) -> Column:
    return N.epoch_ms(c, kind) if isinstance(kind, N.TEMPORAL) else c


def _together(left: DataFrame, right: DataFrame, a: list[str], b: list[str]) -> tuple[DataFrame, list[str]]:
    """Both sides as rows (k0.., t, side, rid, l, r); right rows without a time are left out."""
    exact = [f"__k{i}" for i in range(len(a) - 1)]
    row = lambda df, keys: [*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys[:-1])], quoted(keys[-1]).alias("__t")]
    t = quoted(b[-1])
    there = t.isNotNull() & ~F.isnan(t) if isinstance(right.schema[b[-1]].dataType, N.FLOATING) else t.isNotNull()
    r = right.filter(there).select(*row(right, b), F.lit(0).alias("__side"), quoted(RID).alias("__id"), F.struct(t.alias("__rt"), quoted(RID).alias("__rid"), *[quoted(c) for c in right.columns if c not in b and c != RID]).alias("__r"))
    l = left.select(*row(left, a), F.lit(1).alias("__side"), quoted(RID).alias("__id"), F.struct(*[quoted(c) for c in left.columns if c != RID]).alias("__l"))  # noqa: E741
    return l.unionByName(r, allowMissingColumns=True), exact


def _carried(both: DataFrame, exact: list[str], forward: bool, spread: bool) -> Column | tuple[DataFrame, Column]:
    """The last right row before each row in the given direction."""
    flip = (lambda c: c.desc()) if forward else (lambda c: c.asc())
    # at equal times right rows come first in either direction; of equal right rows the one nearest to the left row wins
    order = [flip(F.col("__t")), F.col("__side").asc(), flip(F.col("__id"))]
    if not spread:
        return both, F.last("__r", ignorenulls=True).over(W.partitionBy(*exact).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    keys = [F.col(k).asc_nulls_first() for k in exact]
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(both.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "asof")
    key = F.struct(*[F.col(k) for k in exact], F.lit(0).alias("__z"))
    # one row a range: its first and last key, and the last right row of its last key
    ends = dealt.groupBy("__part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    tails = dealt.join(F.broadcast(ends), "__part").filter(F.col("last") == key)
    newest = F.struct("__t", "__id")
    pick = (F.min_by if forward else F.max_by)("__r", F.when(F.col("__r").isNotNull(), newest))
    tail = tails.groupBy("__part").agg(pick.alias("__tail"))
    told = ends.join(tail, "__part").select(F.col("__part").alias("p"), "first", "last", "__tail")
    older = told.select(F.col("p").alias("q"), F.col("last").alias("k"), F.col("__tail").alias("v")).filter("v is not null")
    seen = told.join(F.broadcast(older), (F.col("q") < F.col("p")) & (F.col("k") == F.col("first"))).groupBy("p", "first").agg(F.max_by("v", "q").alias("__seen"))
    met = dealt.join(F.broadcast(seen), (F.col("__part") == F.col("p")) & (F.col("first") == key), "left")
    within = F.last("__r", ignorenulls=True).over(W.partitionBy("__part", *exact).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return met, F.coalesce(within, F.col("__seen"))


def _matched(left: DataFrame, right: DataFrame, a: list[str], b: list[str], direction: str, tolerance: Any, spread: bool) -> DataFrame:
    """Left rows as ``__l`` with ``__id`` and the matched right row ``__r`` (null if none)."""
    kinds = left.schema[a[-1]].dataType, right.schema[b[-1]].dataType
    most = _tolerance(tolerance, kinds[1])
    if direction == "nearest" and not all(isinstance(k, N.NUMERIC) for k in kinds):
        raise DtError("asof-non-numeric-asof-key", f"nearest needs numbers, not {kinds[0].simpleString()}", types=[k.simpleString() for k in kinds])
    both, exact = _together(row_numbered(left), row_numbered(right), a, b)
    t, kind = F.col("__t"), both.schema["__t"].dataType
    gap = lambda r: F.abs(_measure(t, kind) - _measure(r["__rt"], kinds[1]))
    if direction == "nearest":
        own = both.columns
        both, before = _carried(both, exact, False, spread)
        both = both.select(*own, before.alias("__before"))
        both, after = _carried(both, exact, True, spread)
        both = both.select(*own, "__before", after.alias("__after"))
        x, y = F.col("__before"), F.col("__after")
        picked = F.when(y.isNull() | (gap(x) <= gap(y)), x).otherwise(y)
    else:
        both, picked = _carried(both, exact, direction == "forward", spread)
    out = both.withColumn("__hit", picked).filter("__side = 1")
    ok = t.isNotNull()
    if isinstance(kind, N.FLOATING):
        ok = ok & ~F.isnan(t)
    if most is not None:
        ok = ok & (gap(F.col("__hit")) <= most)
    return out.select("__l", "__id", "__t", F.when(ok, F.col("__hit")).alias("__hit"))


def asof_join(left: DataFrame, right: DataFrame, a: list[str], b: list[str], direction: str = "backward", tolerance: Any = None, spread: bool = False) -> DataFrame:
    """Every left row with the last (``backward``), next (``forward``) or nearest right row of its exact keys."""
    hit = _matched(left, right, a, b, direction, tolerance, spread)
    own = [c for c in left.columns if c != RID]
    extra = [c for c in right.columns if c not in b and c != RID]
    cols = [F.col("__l")[c].alias(c) for c in own]
    cols += [F.col("__hit")[c].alias(f"right.{c}" if c in own else c) for c in extra]
    keep = [F.col("__id").alias(RID)] if RID in left.columns else []
    return hit.select(*cols, *keep)


def asof_row_indices(left: DataFrame, right: DataFrame, a: list[str], b: list[str], direction: str = "backward", tolerance: Any = None) -> DataFrame:
    """(left_row, right_row): row ids of the matches, ``right_row`` null where there is none."""
    hit = _matched(left, right, a, b, direction, tolerance, False)
    return hit.select(F.col("__id").alias("left_row"), F.col("__hit")["__rid"].alias("right_row"))


def asof_search(values: list, x: Any, direction: str = "backward") -> int:
    """Place in a sorted list of the last value <= x (backward), the first >= x (forward), or the nearest; -1 if none."""
    from bisect import bisect_left, bisect_right

    if direction not in DIRECTIONS:
        raise DtError("asof-unknown-direction", f"{direction} is not one of {', '.join(DIRECTIONS)}", direction=direction)
    if x is None:
        return -1
    before = bisect_right(values, x) - 1
    after = bisect_left(values, x)
    after = after if after < len(values) else -1
    if direction == "backward":
        return before
    if direction == "forward":
        return after
    if before < 0 or after < 0:
        return max(before, after)
    return before if x - values[before] <= values[after] - x else after


def asof_indices(left: list, right: list) -> list[int]:
    """For each value of a sorted list the place of the last value <= it in another sorted list; -1 if there is none.
    Missing values match nothing."""
    from bisect import bisect_right

    there = [(x, i) for i, x in enumerate(right) if x is not None]
    values = [x for x, _ in there]
    at = [-1 if x is None else bisect_right(values, x) - 1 for x in left]
    return [there[i][1] if i >= 0 else -1 for i in at]


# -- windows

def window_bounds(window: Any) -> tuple[float | int, float | int]:
    """[lo, hi], [lo, hi, unit] or [lo, unit, hi]; with a unit in milliseconds."""
    if not isinstance(window, (list, tuple)) or len(window) not in (2, 3):
        raise DtError("join-invalid-window", f"{window!r} is not [lo, hi] or [lo, hi, unit]", window=window)
    unit = next((str(x).lstrip(":") for x in window if isinstance(x, str)), None)
    bounds = [x for x in window if not isinstance(x, str)]
    if len(bounds) != 2 or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in bounds) or (len(window) == 3) != (unit is not None) or bounds[0] > bounds[1]:
        raise DtError("join-invalid-window", f"{window!r} has no two ascending bounds", window=window)
    if unit is not None and unit not in N.UNIT_MS:
        raise DtError("join-unknown-window-unit", f"{unit} is not one of {', '.join(N.UNIT_MS)}", unit=unit)
    by = N.UNIT_MS[unit] if unit else 1
    return bounds[0] * by, bounds[1] * by


def window_join(left: DataFrame, right: DataFrame, a: list[str], b: list[str], window: Any, agg: dict) -> DataFrame:
    """Aggregates, for each left row, of the right rows with the same exact keys and a time in [t + lo, t + hi].

    An empty window gives null, also for counts; a Python function then sees a table without rows.
    """
    lo, hi = window_bounds(window)
    for df, k in ((left, a[-1]), (right, b[-1])):
        kind = df.schema[k].dataType
        if not isinstance(kind, N.NUMERIC):
            raise DtError("join-invalid-window", f"the time {k} must be a number, not {kind.simpleString()}", column=k)
    nodes = {k: v if callable(v) and not isinstance(v, Expr) else expression(v) for k, v in agg.items()}
    for k, n in nodes.items():
        if isinstance(n, Expr):
            window_forbidden(n, f"agg {k}")
            unknown_columns(columns_of(n), right.columns, f"agg {k}")
    numbered = row_numbered(left)
    if any(not isinstance(n, Expr) for n in nodes.values()):
        # two plans meet by the row id: written once, it is the same in both whatever is run again
        numbered = written(numbered, "window_left")
    out = _framed(numbered, row_numbered(right), a, b, lo, hi, {k: n for k, n in nodes.items() if isinstance(n, Expr)})
    for k, f in nodes.items():
        if not isinstance(f, Expr):
            part = _ranged(numbered, row_numbered(right), a, b, lo, hi, k, f)
            out = out.join(part, RID, "left")
    own = [c for c in left.columns if c != RID]
    return out.select(*map(quoted, [*own, *nodes]), *([quoted(RID)] if RID in left.columns else []))


def _framed(left: DataFrame, right: DataFrame, a: list[str], b: list[str], lo, hi, nodes: dict[str, Expr]) -> DataFrame:
    if not nodes:
        return left
    both, exact = _together(left, right, a, b)
    names = {c: f"__r_{c}" for c in right.columns if c != RID}
    both = both.withColumns({f"__r_{c}": (F.when(F.col("__side") == 0, F.col("__t")) if c == b[-1] else F.col("__k" + str(b.index(c))) if c in b else F.col("__r")[c]) for c in names})
    both = both.withColumn("__there", F.when(F.col("__side") == 0, F.lit(1)))
    t = F.col("__t")
    if isinstance(lo, float) or isinstance(hi, float) or not isinstance(both.schema["__t"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        frame = _double_frame(exact, t, lo, hi)
    else:
        frame = W.partitionBy(*exact).orderBy(t.cast("long")).rangeBetween(int(lo), int(hi))
    place = F.when(F.col("__side") == 0, F.struct(t, F.col("__id")))
    lower = Lower(Scope(both, "frame", exact, place=place, frame=frame, names=names))
    there = F.count("__there").over(frame)
    found = both.withColumns({"__n": there} | {f"__a_{k}": lower.column(n) for k, n in nodes.items()}).filter("__side = 1")
    some = (F.col("__n") > 0) & F.col("__t").isNotNull()
    own = [c for c in left.columns if c != RID]
    return found.select(*[F.col("__l")[c].alias(c) for c in own], F.col("__id").alias(RID), *[F.when(some, quoted(f"__a_{k}")).alias(k) for k in nodes])


def _double_frame(exact: list[str], t: Column, lo, hi):
    """Range frames take whole bounds: where a bound isn't whole, times are scaled as decimals by up to a million."""
    if float(lo).is_integer() and float(hi).is_integer():
        return W.partitionBy(*exact).orderBy(t.cast("double")).rangeBetween(int(lo), int(hi))
    scale = next(10**k for k in range(1, 7) if k == 6 or all(float(round(x * 10**k)) == x * 10**k for x in (lo, hi)))
    return W.partitionBy(*exact).orderBy((t.cast("decimal(31,6)") * F.lit(scale)).cast("decimal(38,6)")).rangeBetween(round(lo * scale), round(hi * scale))


def _ranged(left: DataFrame, right: DataFrame, a: list[str], b: list[str], lo, hi, k: str, f: Callable) -> DataFrame:
    """(row id, value of f) by a join on time bins as wide as the window: a left row meets two bins at most."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    width = float(max(hi - lo, 1e-9)) if hi > lo else 1.0
    kind = f.kind if isinstance(f, Typed) else "double"
    cell = lambda x: F.floor(x.cast("double") / width)
    l = left.select(quoted(RID).alias("__lid"), quoted(a[-1]).alias("__lt"), *[quoted(c).alias(f"__k{i}") for i, c in enumerate(a[:-1])])  # noqa: E741
    l = l.withColumn("__bin", F.explode_outer(F.sequence(cell(F.col("__lt") + F.lit(lo)), cell(F.col("__lt") + F.lit(hi)))))  # noqa: E741
    own = [c for c in right.columns if c != RID]
    r = right.filter(quoted(b[-1]).isNotNull()).select(F.struct(*[quoted(c) for c in own]).alias("__r"), quoted(RID).alias("__rrid"), quoted(b[-1]).alias("__rt"), *[quoted(c).alias(f"__q{i}") for i, c in enumerate(b[:-1])], cell(quoted(b[-1])).alias("__rbin"))
    match = (F.col("__bin") == F.col("__rbin")) & (F.col("__rt") >= F.col("__lt") + F.lit(lo)) & (F.col("__rt") <= F.col("__lt") + F.lit(hi))
    for i in range(len(a) - 1):
        match = match & F.col(f"__k{i}").eqNullSafe(F.col(f"__q{i}"))
    met = l.join(r, match, "left").select(F.col("__lid").alias(RID), "__rrid", "__rt", *[F.col("__r")[c].alias(c) for c in own])

    result = T._parse_datatype_string(kind)
    zone = left.sparkSession.conf.get("spark.sql.session.timeZone")

    def calls(t):
        """f once for each left row of a sorted table that holds all their windows."""
        there = t["__rrid"].is_valid()
        frame = t.filter(there).select(own).to_pandas()
        for c in own:
            if getattr(frame[c].dtype, "tz", None) is not None:
                frame[c] = frame[c].dt.tz_convert(zone).dt.tz_localize(None)
        ids = t[RID].to_numpy()
        found, lefts = ids[there.to_numpy(zero_copy_only=False)], np.unique(ids)
        first, stop = np.searchsorted(found, lefts, "left"), np.searchsorted(found, lefts, "right")
        values = [f(frame.iloc[x:y].reset_index(drop=True)) for x, y in zip(first, stop, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(lefts), pa.array([getattr(v, "item", lambda v=v: v)() for v in values], to_arrow_type(result))], [RID, k])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows:
                ids = held[RID].to_numpy()
                whole = int(np.searchsorted(ids, ids[-1]))  # the last left row may go on in the next batch
                if whole:
                    yield calls(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield calls(held)

    dealt = met.repartition(quoted(RID)).sortWithinPartitions(quoted(RID), "__rt", "__rrid")
    return dealt.mapInArrow(run, T.StructType([T.StructField(RID, T.LongType()), T.StructField(k, result)]))


def window_row_indices(left: DataFrame, right: DataFrame, a: list[str], b: list[str], window: Any) -> DataFrame:
    """(left_row, right_rows): ids of the right rows in each left row's window, in their order."""
    lo, hi = window_bounds(window)
    both, exact = _together(row_numbered(left), row_numbered(right), a, b)
    frame = _double_frame(exact, F.col("__t"), lo, hi)
    rows = F.collect_list(F.when(F.col("__side") == 0, F.struct("__t", "__id"))).over(frame)
    return both.withColumn("__rows", rows).filter("__side = 1").select(F.col("__id").alias("left_row"), F.transform(F.sort_array("__rows"), lambda x: x["__id"]).alias("right_rows"))
