"""Whole-table quantiles against numpy, on columns that are hard to bucket."""

import numpy as np
import pytest
from helpers import make

from framequery import dt
from framequery.functions.quantiles import percentiles

SHARES = [0.0, 0.05, 1 / 3, 0.5, 0.9, 1.0]
RNG = np.random.default_rng(8)


@pytest.mark.parametrize(
    "values",
    [
        RNG.normal(size=501),
        np.append(RNG.normal(size=300), [1e300, -1e300, 1e-300]),
        1e9 + RNG.random(200) * 1e-3,
        np.repeat([3.0, -2.0, 0.0], [50, 70, 1]),
        np.array([1.7e308, -1.7e308, 5.0, 6.0]),
        np.array([4.25]),
        RNG.integers(-5, 5, 999).astype(float),
    ],
)
def test_like_numpy(spark, values):
    df = make(spark, schema="x double", x=[*map(float, values), None, None]).repartition(5)
    got = percentiles(df, df["x"], SHARES).first()["v"]
    pos = np.array(SHARES) * (len(values) - 1)
    s, lo, hi = np.sort(values), np.floor(pos).astype(int), np.ceil(pos).astype(int)
    want = [s[a] if a == b or s[a] == s[b] else (b - p) * s[a] + (p - a) * s[b] for p, a, b in zip(pos, lo, hi, strict=True)]
    assert got == pytest.approx(want, rel=1e-12)


def test_no_values_and_one_plan(spark):
    df = make(spark, schema="x double", x=[None, None])
    assert percentiles(df, df["x"], [0.5]).first()["v"] is None
    t = make(spark, x=[1.0, 2.0, 3.0, 4.0])
    out = dt(t, where="(> :x (md :x))")
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["x"] for r in out.collect()) == [3.0, 4.0]
