"""Element-wise queries and time bars over streams (Structured Streaming)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequery.errors import DtError, unknown_columns
from framequery.expr import Expr, expression, has_aggregate, has_window, walk
from framequery.functions import numbers as N
from framequery.lower import Lower, Scope, quoted

#: Aggregates that Spark keeps in bounded state for each group.
BOUNDED = ("mn", "sm", "sd", "variance", "mx", "mi", "ct", "wavg", "wsum", "N")


def stream_dt(df: DataFrame, *, where: Any = None, set: dict | None = None) -> DataFrame:  # noqa: A002
    """Filters and element-wise derivations: the same expressions as in ``dt``, for tables and streams alike."""
    if where is not None:
        n = expression(where, elementwise=True)
        _elementwise(n, "where")
        lower = Lower(Scope(df))
        lower.check(n, "where")
        df = df.filter(lower.predicate(n))
    if set:
        new = {}
        for k, v in set.items():
            n = expression(v)
            _elementwise(n, f"set {k}")
            lower = Lower(Scope(df))
            lower.check(n, f"set {k}")
            new[k] = lower.column(n)
        df = df.withColumns(new)
    return df


def _elementwise(n: Expr, where: str) -> None:
    if has_window(n) or has_aggregate(n):
        raise DtError("win-outside-window", f"{where}: a stream takes element-wise expressions here")


def time_bars(df: DataFrame, time: str, width: int, unit: str, agg: dict, by: list[str] | None = None, late: str | None = None) -> DataFrame:
    """Tumbling bars: key columns, ``bar`` (start) and the aggregates. ``late`` is the watermark: how long a bar waits."""
    if unit not in N.UNIT_MS:
        raise DtError("xbar-unknown-unit", f"{unit} is not one of {', '.join(N.UNIT_MS)}", unit=unit)
    unknown_columns([time, *(by or [])], df.columns, "time_bars")
    nodes = _bounded(df, agg)
    if late:
        df = df.withWatermark(time, late)
    cols = _aggregated(df, nodes, by or [])
    bar = F.window(quoted(time), f"{width} {unit}")
    return df.groupBy(bar.alias("__bar"), *map(quoted, by or [])).agg(*cols).select(*map(quoted, by or []), F.col("__bar.start").alias("bar"), *map(quoted, nodes))


def _bounded(df: DataFrame, agg: dict) -> dict[str, Expr]:
    nodes = {k: expression(v) for k, v in agg.items()}
    for k, n in nodes.items():
        odd = [x.name for x in walk(n) if type(x).__name__ == "Op" and x.name in ("md", "qnt", "nuniq", "first-val", "last-val")]
        if odd and df.isStreaming:
            raise DtError("unknown-op", f"{k}: {odd[0]} needs unbounded state; a stream takes {', '.join(BOUNDED)}", op=odd[0])
    return nodes


def _aggregated(df: DataFrame, nodes: dict[str, Expr], by: list[str]) -> list[Column]:
    lower = Lower(Scope(df, "group", by))
    out = []
    for k, n in nodes.items():
        lower.check(n, f"agg {k}")
        out.append(lower.column(n).alias(k))
    return out


def sessions(df: DataFrame, time: str, gap: str, agg: dict, by: list[str], late: str | None = None) -> DataFrame:
    """Runs of rows of a key without a pause of ``gap``: keys, ``start``, ``end`` and the aggregates."""
    unknown_columns([time, *by], df.columns, "sessions")
    nodes = _bounded(df, agg)
    if late:
        df = df.withWatermark(time, late)
    cols = _aggregated(df, nodes, by)
    out = df.groupBy(F.session_window(quoted(time), gap).alias("__bar"), *map(quoted, by)).agg(*cols)
    return out.select(*map(quoted, by), F.col("__bar.start").alias("start"), F.col("__bar.end").alias("end"), *map(quoted, agg))
