"""Wide to long and back."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequery.errors import DtError, unknown_columns
from framequery.expr import Expr, expression
from framequery.lower import RID, Lower, Scope, quoted
from framequery.operators.query import Typed, row_numbered


def melt(df: DataFrame, *, id: list[str], measure: list[str] | None = None, variable_col: str = "variable", value_col: str = "value") -> DataFrame:  # noqa: A002
    """One row for each measure and row: the ids, the value, the variable's name. Values take the common type. No
    shuffle: rows come out row by row; order by the variable for the other order."""
    names = [c for c in df.columns if c != RID]
    unknown_columns(id, names, "melt")
    measure = [c for c in names if c not in id] if measure is None else list(measure)
    unknown_columns(measure, names, "melt")
    if not measure:
        kinds = [df.schema[c] for c in id] + [T.StructField(variable_col, T.StringType()), T.StructField(value_col, T.StringType())]
        return df.sparkSession.createDataFrame([], T.StructType(kinds))
    long = df.unpivot([quoted(c) for c in id], [quoted(c) for c in measure], variable_col, value_col)
    return long.select(*map(quoted, [*id, value_col, variable_col]))


def cast(df: DataFrame, *, id: Any = None, from_: str | None = None, value: str | None = None, agg: Any = None, fill: Any = None, columns: list | None = None) -> DataFrame:  # noqa: A002
    """One row for each id, one column for each value of ``from_``; both in order of first appearance.

    A cell holds its first row's value (which may be missing) or ``agg`` of its rows: an aggregate name of one argument
    as ``"sm"``, an expression, or a Python function of the list of values. ``fill`` is for cells without rows only.
    Unless ``columns`` lists them, the distinct values of ``from_`` are read first (an action; one row a column).
    """
    for code, v in (("cast-missing-id", id), ("cast-missing-from", from_), ("cast-missing-value", value)):
        if not v:
            raise DtError(code, "cast needs id, from_ and value")
    ids = [id] if isinstance(id, str) else list(id)
    unknown_columns([*ids, from_, value], df.columns, "cast")
    rows = row_numbered(df)
    if columns is None:
        firsts = rows.groupBy(quoted(from_).alias("v")).agg(F.min(RID).alias("at")).orderBy("at")
        columns = [r["v"] for r in firsts.collect()]
    place = quoted(RID)
    named = [(v, "nil" if v is None else str(v)) for v in columns]
    cells: list[Column] = []
    for v, name in named:
        here = quoted(from_).isNull() if v is None else quoted(from_) == F.lit(v)
        x = F.when(here, quoted(value))
        if agg is None:
            cell = F.min_by(quoted(value), F.when(here, place))
        elif callable(agg) and not isinstance(agg, Expr):
            kind = agg.kind if isinstance(agg, Typed) else "double"
            held = F.transform(F.sort_array(F.collect_list(F.when(here, F.struct(place.alias("at"), quoted(value).alias("v"))))), lambda s: s["v"])
            cell = F.udf(agg.f if isinstance(agg, Typed) else agg, kind, useArrow=True)(held)
        else:
            n = expression(f"({agg} :{value})") if isinstance(agg, str) and not agg.startswith("(") else expression(agg)
            cell = _only(df, n, value, x, F.when(here, place))
        cells.append(F.when(F.count_if(here) > 0, cell).otherwise(F.lit(fill)).alias(name))
    out = rows.groupBy(*map(quoted, ids)).agg(F.min(RID).alias("__first"), *cells)
    return out.orderBy("__first").drop("__first")


def _only(df: DataFrame, n: Expr, value: str, x: Column, place: Column) -> Column:
    """The aggregate over the rows of one cell."""

    class Cell(Lower):
        def _col(self, c):
            return x if c.name == value else super()._col(c)

    return Cell(Scope(df, "group", place=place)).column(n)
