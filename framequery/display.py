"""Tables and expressions as HTML or text, for notebooks; the last result for consoles."""

from __future__ import annotations

import html
from typing import Any

from pyspark.sql import DataFrame

from framequery.expr import Expr, children, to_string

_LAST: list[DataFrame] = []


def remember(df: DataFrame) -> DataFrame:
    """Keep as the last result (``last()``)."""
    _LAST[:] = [df]
    return df


def last() -> DataFrame | None:
    return _LAST[0] if _LAST else None


def _cell(v: Any) -> str:
    if v is None:
        return '<td class="nil">nil</td>'
    if isinstance(v, float):
        return f'<td class="num">{v:.6g}</td>'
    return f'<td class="{"num" if isinstance(v, int) and not isinstance(v, bool) else "txt"}">{html.escape(str(v))}</td>'


def table_html(df: DataFrame, rows: int = 25) -> str:
    """The first rows; one more is read to tell whether there are others."""
    got = df.limit(rows + 1).collect()
    head = "".join(f"<th>{html.escape(f.name)}<br><small>{f.dataType.simpleString()}</small></th>" for f in df.schema.fields)
    body = "".join("<tr>" + "".join(_cell(v) for v in r) + "</tr>" for r in got[:rows])
    more = "<caption>more rows follow</caption>" if len(got) > rows else ""
    return f"<table>{more}<thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def expr_html(n: Expr) -> str:
    return f"<code>{html.escape(to_string(n))}</code>"


def expr_tree(n: Expr, depth: int = 0) -> str:
    """The expression's nodes, one a line."""
    own = type(n).__name__ + (f" {n.name}" if hasattr(n, "name") else f" {n.value!r}" if hasattr(n, "value") else "")
    return "\n".join(["  " * depth + own, *(expr_tree(c, depth + 1) for c in children(n))])


def view_html(x: Any) -> str:
    if isinstance(x, DataFrame):
        return table_html(x)
    return expr_html(x) if isinstance(x, Expr) else f"<pre>{html.escape(str(x))}</pre>"
