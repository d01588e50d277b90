"""Window functions against fixed values and a plain evaluation row by row."""

import math
import random

import pytest
from helpers import column, make, near

from framequery import DtError, desc, dt


def run(spark, expr, values, **more):
    t = make(spark, g=["A"] * len(values), i=list(range(len(values))), x=values, **more)
    return column(dt(t, by=["g"], within_order=["i"], set={"v": expr}).orderBy("i"), "v", 4)


@pytest.mark.parametrize(("expr", "values", "want"), [
    ("(win/rank :x)", [10, 20, 20, 30], [1, 2, 2, 4]), ("(win/rank :x)", [10, 20, 20, 10, None, None], [1, 2, 2, 4, 5, 5]), ("(win/dense-rank :x)", [10, 20, 20, 30], [1, 2, 2, 3]), ("(win/row-number)", [5, 5, 5], [1, 2, 3]),
    ("(win/lag :x 1)", [10, 20, 30, 40], [None, 10, 20, 30]), ("(win/lead :x 1)", [10, 20, 30, 40], [20, 30, 40, None]), ("(win/lag :x 1 {:fill 0})", [10, None, 30], [0, 10, None]), ("(win/lead :x 2 {:fill -1})", [10.0, 20.0, 30.0], [30.0, -1.0, -1.0]),
    ("(win/cumsum :x)", [None, 10.0, 20.0, None], [0.0, 10.0, 30.0, 30.0]), ("(win/cummin :x)", [None, None, 5.0, 3.0], [None, None, 5.0, 3.0]), ("(win/cummax :x)", [None, 5.0, None, 3.0], [None, 5.0, None, 5.0]), ("(win/cummean :x)", [None, 2.0, None, 4.0], [None, 2.0, 2.0, 3.0]),
    ("(win/rleid :x)", ["+", "+", "+", "-", "-", "+", "+"], [1, 1, 1, 2, 2, 3, 3]), ("(win/differ :x)", ["A", "A", "B", "B", "A"], [True, False, True, False, True]), ("(win/delta :x)", [1, 4, None, 9], [None, 3.0, None, None]),
    ("(win/ratio :x)", [100.0, 0.0, 50.0, 100.0], [None, 0.0, None, 2.0]), ("(win/fills :x)", [1.0, None, None, 4.0, None], [1.0, 1.0, 1.0, 4.0, 4.0]), ("(win/grr :x)", [0.0, 0.0, 2.0, 5.0], [None, 0.0, 1.4436, 0.8688]),
    ("(win/mavg :x 3)", [10.0, 20.0, 30.0, 40.0, 50.0], [10.0, 15.0, 20.0, 30.0, 40.0]), ("(win/msum :x 3)", [10.0, 20.0, 30.0, 40.0, 50.0], [10.0, 30.0, 60.0, 90.0, 120.0]), ("(win/mmin :x 3)", [30.0, 10.0, 50.0, 20.0, 40.0], [30.0, 10.0, 10.0, 10.0, 20.0]),
    ("(win/mmax :x 3)", [30.0, 10.0, 50.0, 20.0, 40.0], [30.0, 30.0, 50.0, 50.0, 50.0]), ("(win/mdev :x 3)", [10.0, 20.0, 30.0, 40.0, 50.0], [None, 7.0711, 10.0, 10.0, 10.0]), ("(win/mdev :x 3 0)", [10.0, 20.0, 30.0], [0.0, 5.0, 8.165]),
    ("(win/mdev :x 3 {:ddof 2})", [10.0, 20.0, 30.0], [None, None, 14.1421]), ("(win/mavg :x 3 {:min-periods 3})", [10.0, 20.0, 30.0, 40.0], [None, None, 20.0, 30.0]), ("(win/mdowndev :x 3)", [1.0, 2.0, -2.0], [0.0, 0.0, 1.1547]), ("(win/mdowndev :x 3)", [None, None], [None, None]),
    ("(win/ema :x 3)", [10.0, None, 20.0], [10.0, 10.0, 15.0]), ("(win/ema :x 0.5)", [None, 4.0, 8.0], [None, 4.0, 6.0]), ("(win/ema :x {:alpha 0.25})", [4.0, 8.0], [4.0, 5.0]), ("(- (win/ema :x {:period 3}) :x)", [10.0, 20.0], [0.0, -5.0]),
    ("(win/scan * (+ 1 :x))", [0.1, 0.2, -0.1], [1.1, 1.32, 1.188]), ("(win/scan + :x)", [1, None, 3], [1, 1, 4]), ("(win/scan max :x)", [1, 5, 3], [1, 5, 5]), ("(win/each-prior > :x)", [1, 3, None, 2], [None, True, None, None]), ("(win/each-prior / :x)", [1, 0, 4], [None, 0.0, math.inf]),
    ("(mn :x)", [1.0, None, 5.0], [3.0] * 3), ("(first-val :x)", [None, 2.0], [None, None]), ("(last-val :x)", [1.0, 2.0], [2.0, 2.0]), ("(nuniq :x)", [1, 1, None, 2], [2] * 4), ("(- :x (md :x))", [1.0, 2.0, 6.0], [-1.0, 0.0, 4.0]),
    ("(win/mdev (- (win/ratio :x) 1) 2)", [1.0, 2.0, 3.0], [None, None, 0.3536]),
])
def test_values(spark, expr, values, want):
    if expr.startswith("(win/mdev (-"):
        assert run(spark, expr, values)[2] == want[2]
    else:
        assert run(spark, expr, values) == want


def test_order(spark):
    t = make(spark, date=[3, 1, 2], price=[105, 100, 110])
    out = dt(t, within_order=["date"], set={"c": "(win/cumsum :price)"})
    assert column(out, "date") == [1, 2, 3] and column(out, "c") == [100.0, 210.0, 315.0]
    assert column(dt(t, set={"c": "(win/cumsum :price)"}), "c") == [105.0, 205.0, 315.0]  # the input's order
    assert column(dt(t, within_order=[desc("date")], set={"n": "(win/row-number)"}), "date") == [3, 2, 1]
    assert dt(t, set={"c": "(win/ema :price 3)"}).columns == ["date", "price", "c"]


def test_bad_averages(spark):
    t = make(spark, x=[1.0])
    for bad in ("(win/ema :x)", "(win/ema :x {:alpha 0.1 :period 3})", "(win/ema :x -1)"):
        with pytest.raises(DtError) as x:
            dt(t, set={"v": bad})
        assert x.value.code == "ema-opts"


def naive(op, xs):
    out, acc, prev = [], None, None
    for i, x in enumerate(xs):
        if op == "cumsum":
            acc = (acc or 0.0) + (x or 0.0)
            out.append(acc)
        elif op == "fills":
            acc = x if x is not None else acc
            out.append(acc)
        elif op == "ema":
            acc = acc if x is None else x if acc is None else 0.5 * x + 0.5 * acc
            out.append(acc)
        elif op == "rank":
            acc = acc if i and x == prev else i + 1
            out.append(acc)
        elif op == "mavg":
            w = [v for v in xs[max(0, i - 3) : i + 1] if v is not None]
            out.append(sum(w) / len(w) if w else None)
        elif op == "delta":
            out.append(x - prev if i and x is not None and prev is not None else None)
        prev = x
    return out


def test_random_tables(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c", None]), t, rng.choice([None, 0.0, 1.0, 1.0, 2.5])) for t in range(300)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    t = spark.createDataFrame(shuffled, "g string, t long, x double").repartition(3)
    ops = {"cumsum": "(win/cumsum :x)", "fills": "(win/fills :x)", "ema": "(win/ema :x 3)", "rank": "(win/rank :x)", "mavg": "(win/mavg :x 4)", "delta": "(win/delta :x)"}
    got = {r["t"]: r for r in dt(t, by=["g"], within_order=["t"], set=ops).collect()}
    for g in ("a", "b", "c", None):
        own = [r for r in rows if r[0] == g]
        for op in ops:
            for (_, at, _), want in zip(own, naive(op, [r[2] for r in own]), strict=True):
                assert near(got[at][op], want), (op, at)


def test_one_shuffle_for_many_windows(spark):
    t = spark.range(100).selectExpr("id % 7 AS g", "id AS i", "cast(id AS double) AS x").repartition(3)
    plan = dt(t, by=["g"], within_order=["i"], set={f"m{n}": f"(win/mavg :x {n})" for n in range(2, 12)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_ranges_of_a_whole_table(spark, n):
    """Spread over ranges, every function gives what one task gives, also where ranges are shorter than its reach."""
    rng = random.Random(n)
    rows = [(rng.randrange(50), rng.choice([None, 1.0, 1.0, 2.0, 5.5]), i) for i in range(n)]
    t = spark.createDataFrame(rows, "t long, x double, i long").coalesce(1)
    names = ["row-number", "rank :x", "dense-rank :x", "rleid :x", "differ :x", "cumsum :x", "cummin :x", "cummax :x", "cummean :x", "fills :x", "delta :x", "ratio :x", "grr :x", "lag :x 3", "lead :x 2 {:fill 9}", "lag :x 2 {:fill 0}", "mavg :x 5 {:min-periods 4}", "msum :x 3", "mmin :x 4", "mmax :x 2", "mdev :x 6",
             "scan + :x", "scan max :x", "scan * (+ 0.5 (/ :x 3))", "each-prior - :x", "mavg (win/delta :x) 3", "cumsum (win/lag :x 2)"]
    new = {f"v{i}": f"(win/{name})" for i, name in enumerate(names)} | {"mixed": "(- (win/cumsum :x) (mn :x))"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    one = {r["i"]: r for r in dt(t, within_order=["t"], set=new).collect()}
    two = {r["i"]: r for r in dt(t, within_order=["t"], set=new, spread=True).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one.keys() == two.keys() and len(one) == n
    for i in one:
        for k in new:
            assert near(one[i][k], two[i][k]), (i, k, new[k])
