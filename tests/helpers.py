"""Small tables and results as lists."""

import math


def make(spark, schema=None, **columns):
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, schema or ", ".join(f"`{k}` {kind(v)}" for k, v in columns.items())).coalesce(1)


def kind(values):
    some = [v for v in values if v is not None]
    if some and all(isinstance(v, bool) for v in some):
        return "boolean"
    if some and all(isinstance(v, int) for v in some):
        return "bigint"
    return "string" if some and all(isinstance(v, str) for v in some) else "double"


def column(df, name, places=None):
    out = [r[name] for r in df.collect()]
    return [round(v, places) if places is not None and isinstance(v, float) and math.isfinite(v) else v for v in out]


def near(a, b, rel=1e-9):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=rel, abs_tol=1e-9)
    return a == b
