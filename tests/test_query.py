"""dt(): every keyword, missing values, row order, errors."""

import re
from datetime import date, datetime

import pytest
from helpers import column, make

from framequery import DtError, N, asc, between, col, desc, dt, e, pass_nil, prepare_grouping, qtile, rename, typed, without, xbar
from framequery.operators.query import NOT_NUMERICAL, NUMERICAL, cut

INF = float("inf")


@pytest.fixture
def penguins(spark):
    return make(spark, species=["Adelie", "Adelie", "Gentoo", "Gentoo", "Chinstrap"], mass=[3750, 3800, 5000, 4800, 3500], year=[2007, 2008, 2007, 2008, 2007])


def code(f, *a, **k):
    with pytest.raises(DtError) as x:
        f(*a, **k)
    return x.value.code


def test_filters(spark, penguins):
    assert column(dt(penguins, where="(> :mass 4000)"), "mass") == [5000, 4800]
    assert column(dt(penguins, where=["and", [">", ":mass", 3600], ["=", ":year", 2007]]), "mass") == [3750, 5000]
    assert column(dt(penguins, where=lambda r: r["mass"] == 3500), "species") == ["Chinstrap"]
    assert column(dt(penguins, where="(> :mass (mn :mass))"), "mass") == [5000, 4800]
    assert column(dt(penguins, where="(= :mass (first-val :mass))"), "mass") == [3750]
    t = make(spark, x=[1.0, None, float("nan"), INF, -1.0])
    assert len(column(dt(t, where="(> :x 0)"), "x")) == 2 and len(column(dt(t, where="(not (> :x 0))"), "x")) == 3
    assert column(dt(t, where="(> :x nil)"), "x") == [] and column(dt(t, where="(not nil)"), "x") == []
    assert column(dt(t, where="(in :x #{nil -1.0})"), "x") == [None, None, -1.0] or len(column(dt(t, where="(in :x #{nil -1.0})"), "x")) == 3
    assert column(dt(t, where="(between? :x -1 1)"), "x") == [1.0, -1.0]


def test_filters_reach_the_scan(spark, tmp_path):
    make(spark, a=[1, 2, 3], b=["x", "y", "z"], c=[1.0, 2.0, 3.0]).write.parquet(f"{tmp_path}/t.parquet")
    t = spark.read.parquet(f"{tmp_path}/t.parquet")
    plan = dt(t, where="(> :a 1)", by=["b"], within_order=["a"], agg={"f": "(first-val :a)"})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,1)" in plan and "ReadSchema: struct<a:bigint,b:string>" in plan


def test_derivations(spark, penguins):
    assert column(dt(penguins, set={"kg": col("mass") / 1000}), "kg") == [3.75, 3.8, 5.0, 4.8, 3.5]
    assert column(dt(penguins, set=[("a", "(+ :mass 1)"), ("b", "(* :a 2)")]), "b")[0] == 7502
    assert code(dt, penguins, set={"a": "(+ :mass 1)", "b": "(* :a 2)"}) == "map-set-cross-reference"
    assert column(dt(penguins, set={"mass": "(/ :mass 2)"}), "mass")[0] == 1875.0
    assert column(dt(penguins, set={"s": "(sm :mass)"}), "s") == [20850.0] * 5
    t = make(spark, a=[10.0, None, 6.0, 0.0], b=[2.0, 2.0, 0.0, None])
    assert column(dt(t, set={"q": "(div0 :a :b)"}), "q") == [5.0, None, None, None]
    assert column(dt(t, set={"q": "(/ :a :b)"}), "q") == [5.0, None, INF, None]
    assert column(dt(t, set={"c": "(coalesce :b :a 9.0)"}), "c") == [2.0, 2.0, 0.0, 0.0]
    x = make(spark, x=[-2.0, 0.0, 5.0, INF, None, float("nan")])
    assert column(dt(x, set={"v": "(na2zero :x)"}), "v") == [-2.0, 0.0, 5.0, 0.0, 0.0, 0.0]
    assert column(dt(x, set={"v": "(neg2na :x)"}), "v") == [None, 0.0, 5.0, None, None, None]
    assert column(dt(x, set={"v": "(log :x)"}), "v", 6) == [None, -INF, 1.609438, INF, None, None]
    assert column(dt(x, set={"v": "(asinh :x)"}), "v", 6) == [-1.443635, 0.0, 2.312438, None, None, None]
    assert column(dt(x, set={"v": "(coalesce-finite :x 1.0)"}), "v")[3:] == [1.0] * 3
    assert column(dt(x, set={"v": '(if (> :x 0) "p" "n")'}), "v") == ["n", "n", "p", "p", "n", "n"]
    big = make(spark, x=[2**62])
    assert column(dt(big, set={"v": "(* :x 4)"}), "v") == [None]  # overflow is missing, never an error
    f = pass_nil(typed("double")(lambda r: r["a"] + r["b"]), "a", "b")
    assert column(dt(t, set={"v": f}), "v") == [12.0, None, 6.0, None]


def test_selections(spark):
    t = make(spark, a=[1], b=["x"], c=[2.0], d=[True])
    assert dt(t, select="b").columns == ["b"] and dt(t, select=["c", "a"]).columns == ["c", "a"] and dt(t, select=without("a")).columns == ["b", "c", "d"]
    assert dt(t, select={"a": "z", "c": "y"}).columns == ["z", "y"] and dt(t, select=NUMERICAL).columns == ["a", "c"] and dt(t, select=NOT_NUMERICAL).columns == ["b", "d"]
    assert dt(t, select=re.compile("[ab]")).columns == ["a", "b"] and dt(t, select=lambda c: c > "b").columns == ["c", "d"] and dt(t, select=between("c", "b")).columns == ["b", "c"]
    assert rename(t, {"a": "z"}).columns == ["z", "b", "c", "d"]
    with pytest.raises(DtError) as x:
        dt(make(spark, species=["a"]), select=["speces"])
    assert x.value.code == "unknown-column" and x.value.data["suggestions"] == {"speces": "species"}


def test_orders(spark):
    t = make(spark, k=[1, 1, 2, None, 2], id=[0, 1, 2, 3, 4])
    assert column(dt(t, order_by=["k", desc("id")]), "id") == [3, 1, 0, 4, 2] and column(dt(t, order_by=[desc("k"), asc("id")]), "id") == [2, 4, 0, 1, 3]
    assert column(dt(t, take=2), "id") == [0, 1] and column(dt(t, take=-2), "id") == [3, 4] and column(dt(t, take=0), "id") == [] and len(column(dt(t, take=-99), "id")) == 5
    assert column(dt(t, order_by="id", take=-2), "id") == [3, 4]
    d = make(spark, "date date, id bigint", date=[date(2020, 1, 3), date(2020, 1, 1), None], id=[0, 1, 2])
    assert column(dt(d, order_by="date"), "id") == [2, 1, 0]
    assert code(dt, t, order_by=[3]) == "invalid-order-spec" and code(dt, t, take="x") == "invalid-take" and code(dt, t, order_by="kk") == "unknown-column"


def test_aggregates(spark, penguins):
    out = dt(penguins, by=["species"], agg={"n": N, "m": "(mn :mass)", "s": "(sm :mass)", "u": "(nuniq :year)"}, order_by="species")
    assert [tuple(r) for r in out.collect()] == [("Adelie", 2, 3775.0, 7550.0, 2), ("Chinstrap", 1, 3500.0, 3500.0, 1), ("Gentoo", 2, 4900.0, 9800.0, 2)]
    t = make(spark, g=["a", "a", "b", "b"], v=[3.0, None, 1.0, 2.0], w=[1.0, 2.0, None, 4.0])
    out = dt(t, by=["g"], agg={"hi": "(mx :v)", "lo": "(mi :v)", "c": "(ct :v)", "f": "(first-val :v)", "l": "(last-val :v)", "wa": "(wavg :w :v)", "ws": "(wsum :w :v)", "sd": "(sd :v)"}, order_by="g").collect()
    assert [tuple(r) for r in out] == [("a", 3.0, 3.0, 1, 3.0, None, 3.0, 3.0, None), ("b", 2.0, 1.0, 2, 1.0, 2.0, 2.0, 8.0, pytest.approx(0.70710678))]
    empty = make(spark, "g string, v double", g=["a"], v=[None]).filter("v > 0")
    assert dt(empty, by=["g"], agg={"n": N}).collect() == []
    q = make(spark, x=[float(i) for i in range(1, 11)] + [INF, None])
    assert [round(v, 9) for v in dt(q, agg={"q": e("(qnt :x [0.2 0.5 0.8])")}).first()["q"]] == [2.8, 5.5, 8.2]
    assert dt(q, agg={"m": "(md :x)", "q": "(qnt :x 0.5 11)", "p": "(qnt :x 7)"}).first() == (5.5, None, 10.0)
    assert code(dt, penguins, agg={"m": "(md :species)"}) == "quantile-non-numeric"
    ohlc = make(spark, sym=["A"] * 3 + ["B"] * 3, time=[3, 1, 2, 2, 1, 3], price=[10.3, 10.1, 10.2, 20.2, 20.0, 20.3])
    out = dt(ohlc, by=["sym"], within_order=["time"], agg={"o": "(first-val :price)", "c": "(last-val :price)"}, order_by="sym")
    assert [tuple(r) for r in out.collect()] == [("A", 10.1, 10.3), ("B", 20.0, 20.3)]
    out = dt(ohlc, by=["sym"], within_order=[desc("time")], agg={"o": "(first-val :price)"}, order_by="sym")
    assert column(out, "o") == [10.3, 20.3]
    assert column(dt(ohlc, by=["sym"], agg={"r": lambda g: float(g["price"].max() - g["price"].min())}, order_by="sym"), "r", 6) == [0.2, 0.3]
    with pytest.raises(Exception, match="agg-plain-fn-returned-non-scalar"):
        dt(ohlc, by=["sym"], agg={"r": lambda g: g["price"]}).collect()
    k = make(spark, g=[1, None, 1, None, 2], v=[10, 20, 30, 40, 50])
    assert sorted(map(str, dt(k, by=["g"], agg={"s": "(sm :v)"}).collect())) == sorted(["Row(g=1, s=40.0)", "Row(g=2, s=50.0)", "Row(g=None, s=60.0)"])


def test_buckets(spark):
    t = make(spark, price=[3, 7, 12, 18, 22, 28, 35, 41], vol=[1, 2, 3, 4, 5, 6, 7, 8])
    out = dt(t, by=[xbar("price", 10)], agg={"v": "(sm :vol)"}, order_by="price")
    assert [tuple(r) for r in out.collect()] == [(0, 3.0), (10, 7.0), (20, 11.0), (30, 7.0), (40, 8.0)]
    assert column(dt(make(spark, x=[-0.5, -7.0, 7.9]), set={"b": "(xbar :x 5)"}), "b") == [0, -10, 5]
    times = [datetime(2024, 1, 1, 9, m) for m in (30, 33, 37, 41, 46)]
    bars = dt(make(spark, "t timestamp_ntz, vol bigint", t=times, vol=[10, 20, 30, 40, 50]), by=[xbar("t", 5, "minutes")], agg={"n": N, "v": "(sm :vol)"}, order_by="t")
    assert column(bars, "n") == [2, 1, 1, 1] and column(bars, "v")[0] == 30.0
    assert code(dt, make(spark, "t timestamp_ntz", t=times), set={"b": "(xbar :t 5)"}) == "xbar-unknown-unit"
    c = make(spark, mktcap=[5, 15, 25, 35, 45], exchcd=[1, 1, 2, 1, 2])
    assert column(dt(c, set={"b": "(cut :mktcap 2 :from (= :exchcd 1))"}), "b") == [1, 1, 2, 2, 2]
    q = make(spark, date=[1] * 4 + [2] * 4, cap=[10.0, 30.0, 15.0, 40.0, 100.0, 300.0, 150.0, 400.0], ex=[1, 1, 2, 2, 1, 1, 2, 2])
    out = dt(q, by=["date", qtile("cap", 2)], agg={"n": N, "m": "(mx :cap)"}, order_by=["date", "cap-q2"])
    assert [tuple(r) for r in out.collect()] == [(1, 1, 2, 15.0), (1, 2, 2, 40.0), (2, 1, 2, 150.0), (2, 2, 2, 400.0)]
    few = dt(make(spark, cap=[1.0, 2.0, None]), by=[qtile("cap", 3)], agg={"n": N}, order_by="cap-q3")
    assert [tuple(r) for r in few.collect()] == [(None, 1), (1, 2)]
    assert column(dt(make(spark, x=[5.0, 5.0, 5.0, 9.0]), set={"b": "(cut :x 4)"}), "b") == [1, 1, 1, 4]
    assert code(qtile, "x", 1) == "qtile-invalid-n" and code(qtile, 3, 2) == "qtile-invalid-col" and code(qtile, "x", 2, 7) == "qtile-invalid-from" and code(cut) == "cut-standalone-not-supported"
    kept = dt(q, by=[qtile("cap", 2)], set={"m": "(mx :cap)"})
    assert kept.columns == ["date", "cap", "ex", "m"] and column(kept.orderBy("cap"), "m")[0] == 40.0


def test_rows_and_statistics(spark):
    t = make(spark, q1=[10.0, 20.0, None], q2=[2.0, None, None], q3=[6.0, 4.0, None])
    new = {"s": "(row/sum :q1 :q2 :q3)", "m": "(row/mean :q1 :q2 :q3)", "lo": "(row/min :q1 :q2 :q3)", "hi": "(row/max :q1 :q2 :q3)", "n": "(row/count-nil :q1 :q2 :q3)", "a": "(row/any-nil? :q1 :q2 :q3)"}
    assert [tuple(r)[3:] for r in dt(t, set=new).collect()] == [(18.0, 6.0, 2.0, 10.0, 0, False), (24.0, 12.0, 4.0, 20.0, 1, True), (None, None, None, None, 3, True)]
    x = make(spark, x=[1.0, 2.0, 3.0, 4.0, 5.0])
    assert column(dt(x, set={"z": "(stat/standardize :x)"}), "z", 4) == [-1.2649, -0.6325, 0.0, 0.6325, 1.2649]
    assert column(dt(x, set={"z": "(stat/demean :x)"}), "z") == [-2.0, -1.0, 0.0, 1.0, 2.0] and column(dt(x, set={"z": "(stat/winsorize :x 0.25)"}), "z") == [2.0, 2.0, 3.0, 4.0, 4.0]
    assert column(dt(make(spark, x=[5.0] * 3), set={"z": "(stat/standardize :x)"}), "z") == [None] * 3


def test_groupings_and_conflicts(spark):
    t = make(spark, k=["a", "b", "a", "b", "a"], t=[1, 1, 2, 2, 3], x=[10.0, 100.0, 20.0, 200.0, 30.0])
    g = prepare_grouping(t, ["k"], ["t"], persist=True)
    a, b = dt(t, grouping=g, set={"d": "(win/delta :x)"}), dt(t, by=["k"], within_order=["t"], set={"d": "(win/delta :x)"})
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert code(dt, t, grouping=g) == "grouping-requires-set" and code(dt, t, grouping=g, set={"d": ":x"}, by=["k"]) == "grouping-conflict"
    assert code(dt, t, grouping=g, set={"d": ":x"}, where="(> :t 1)") == "grouping-conflict" and code(dt, make(spark, k=["a"], t=[1], x=[2.0]), grouping=g, set={"d": ":t"}) == "grouping-row-mismatch"
    assert code(prepare_grouping, t, [3]) == "invalid-grouping-by" and code(dt, t, by=[3], agg={"n": N}) == "invalid-grouping-by"
    assert code(dt, t, set={"a": "1"}, agg={"n": N}) == "set-agg-conflict" and code(dt, t, within_order=["t"]) == "within-order-invalid" and code(dt, t, set={"a": ":x"}, within_order=[5]) == "within-order-invalid"
    assert code(dt, t, where="(> (win/lag :x 1) 2)") == "win-outside-window" and code(dt, t, agg={"a": "(win/lag :x 1)"}) == "win-outside-window"
    assert code(dt, t, where="(> :y 1)") == "unknown-column" and code(dt, t, by=["kk"], agg={"n": N}) == "unknown-column"
    assert dt(t, set={"a": "(* :x 2)"}, off_heap=True).count() == 5
