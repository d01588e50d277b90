"""Joins against fixed values and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import column, make, near

from framequery import DtError, N, asof_index, asof_row_indices, asof_search, index_by, join, join_report, typed, window_row_indices
from framequery.plans import catalogue


def code(f, *a, **k):
    with pytest.raises(DtError) as x:
        f(*a, **k)
    return x.value.code


@pytest.fixture
def sides(spark):
    return make(spark, id=[1, 2, 3], x=["a", "b", "c"]), make(spark, id=[2, 3, 4], y=[20, 30, 40])


@pytest.mark.parametrize(("how", "want"), [("inner", [2, 3]), ("left", [1, 2, 3]), ("right", [2, 3, 4]), ("outer", [1, 2, 3, 4])])
def test_equi(sides, how, want):
    out = join(*sides, on="id", how=how)
    assert sorted(column(out, "id")) == want and out.columns == ["id", "x", "y"]


def test_keys_and_names(spark, sides):
    a, b = make(spark, a=[1, 1, 2], b=["x", "y", "x"], v=[1, 2, 3]), make(spark, a=[1, 2, 2], b=["x", "x", "y"], v=[10, 20, 30])
    out = join(a, b, on=["a", "b"])
    assert out.columns == ["a", "b", "v", "right.v"] and sorted(map(tuple, out.collect())) == [(1, "x", 1, 10), (2, "x", 3, 20)]
    out = join(sides[0], sides[1].withColumnRenamed("id", "key").withColumnRenamed("y", "x"), left_on="id", right_on="key", how=":left")
    assert out.columns == ["id", "x", "key", "right.x"] and out.count() == 3
    nulls = make(spark, id=[None, 1], z=[1, 2])
    assert join(nulls, nulls.withColumnRenamed("z", "w"), on="id").count() == 1
    assert code(join, *sides) == "join-missing-keys" and code(join, *sides, on=[]) == "join-invalid-keys" and code(join, *sides, on="id", how="cross") == "join-unknown-how"
    assert code(join, *sides, on="idd") == "unknown-column" and code(join, *sides, left_on=["id"], right_on=["id", "y"]) == "join-invalid-keys" and code(join, *sides, on="id", validate="2:2") == "join-unknown-validate"
    assert code(join, *sides, on="id", how="asof", direction="up") == "join-unknown-direction"


def test_validation_and_report(spark, sides):
    l, r = make(spark, id=[1, 1, 2]), make(spark, id=[2, 2, 3])  # noqa: E741
    assert code(join, l, sides[1], on="id", validate="1:1") == "join-cardinality-violation" and code(join, sides[0], r, on="id", validate=":m:1") == "join-cardinality-violation"
    assert join(l, sides[1], on="id", validate="m:1").count() == 1 and join(l, r, on="id", validate="m:m").count() == 2
    told = []
    join(*sides, on="id", report=told.append)
    assert (told[0].matched, told[0].left_only, told[0].right_only) == (2, 1, 1) and join_report(l, r, ["id"], ["id"]).matched == 1


def test_asof_values(spark):
    t = make(spark, sym=["A", "A", "B", "A"], time=[1, 3, 2, 6])
    q = make(spark, sym=["A", "A", "A", "B"], time=[1, 2, 5, 1], bid=[10, 11, 12, 20])
    out = join(t, q, on=["sym", "time"], how="asof")
    assert out.columns == ["sym", "time", "bid"] and {(r[0], r[1]): r[2] for r in out.collect()} == {("A", 1): 10, ("A", 3): 11, ("B", 2): 20, ("A", 6): 12}
    by = lambda l, r, **k: [r["v"] for r in join(make(spark, t=l), make(spark, t=r, v=[10 * (i + 1) for i in range(len(r))]), on="t", how="asof", **k).orderBy("t").collect()]  # noqa: E731, E741
    assert by([2, 4, 6], [1, 3, 5], direction="forward") == [20, 30, None] and by([3, 5, 6], [1, 4, 7], direction="nearest") == [20, 20, 30] and by([3], [1, 5], direction="nearest") == [10]
    assert by([3, 7, 15], [1, 5], tolerance=3) == [10, 20, None] and by([1, 2], [1, 1, 2, 2]) == [20, 40] and by([1], [1, 1], direction="forward") == [10]
    clash = join(make(spark, t=[1], val=[5]), make(spark, t=[1], val=[6]), on="t", how="asof")
    assert clash.columns == ["t", "val", "right.val"] and clash.first() == (1, 5, 6)
    times = [datetime(2024, 1, 1, 0, m) for m in (0, 10)]
    l, r = make(spark, "t timestamp_ntz", t=[datetime(2024, 1, 1, 0, 4), datetime(2024, 1, 1, 0, 30)]), make(spark, "t timestamp_ntz, v bigint", t=times, v=[1, 2])  # noqa: E741
    assert column(join(l, r, on="t", how="asof", tolerance=[5, "minutes"]).orderBy("t"), "v") == [1, None]
    assert code(join, l, r, on="t", how="asof", direction="nearest") == "asof-non-numeric-asof-key" and code(join, l, r, on="t", how="asof", tolerance=5) == "join-tolerance-non-numeric"
    assert code(join, t, q, on=["sym", "time"], how="asof", tolerance=[5, "minutes"]) == "join-tolerance-non-numeric" and code(join, l, r, on="t", how="asof", tolerance=[5, "eons"]) == "join-tolerance-unknown-unit"
    assert code(join, t, q, on=["sym", "time"], how="asof", tolerance=-1) == "join-tolerance-invalid"


def random_sides(rng, n=120):
    key = lambda: rng.choice(["a", "b", None])
    left = [(key(), rng.choice([None, *range(40)]), i) for i in range(n)]
    right = [(key(), rng.choice([None, *range(40)]), i) for i in range(n // 2)]
    return left, right


def brute(left, right, direction, tolerance=None):
    out = {}
    for k, t, i in left:
        rows = [(rt, j) for rk, rt, j in right if rk == k and rt is not None]
        before = max(((rt, j) for rt, j in rows if t is not None and rt <= t), default=None)
        after = min(((rt, j) for rt, j in rows if t is not None and rt >= t), default=None)
        hit = {"backward": before, "forward": after}.get(direction) if direction != "nearest" else before if after is None or (before and t - before[0] <= after[0] - t) else after
        out[i] = None if hit is None or (tolerance is not None and abs(hit[0] - t) > tolerance) else hit[1]
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("spread", [False, True])
def test_asof_brute(spark, direction, spread):
    left, right = random_sides(random.Random(3))
    l = spark.createDataFrame(left, "k string, t long, i long").coalesce(1)  # noqa: E741
    r = spark.createDataFrame(right, "k string, t long, j long").coalesce(1)
    for tolerance in (None, 2):
        got = {x["i"]: x["j"] for x in join(l, r, on=["k", "t"], how="asof", direction=direction, tolerance=tolerance, spread=spread).collect()}
        assert got == brute(left, right, direction, tolerance)


def test_asof_of_one_key(spark):
    """Without exact keys everything is one group; spread, it lies in ranges."""
    left, right = random_sides(random.Random(5))
    left, right = [("a", t, i) for _, t, i in left], [("a", t, i) for _, t, i in right]
    l, r = spark.createDataFrame(left, "k string, t long, i long").coalesce(1), spark.createDataFrame(right, "k string, t long, j long").coalesce(1)  # noqa: E741
    for direction in ("backward", "forward"):
        got = {x["i"]: x["j"] for x in join(l.drop("k"), r.drop("k"), on="t", how="asof", direction=direction, spread=True).collect()}
        assert got == brute(left, right, direction)


def test_indices(spark):
    l, r = make(spark, t=[1, 5, 9]), make(spark, t=[4, 8], v=[1, 2])  # noqa: E741
    assert sorted(map(tuple, asof_row_indices(l, r, ["t"], ["t"]).collect()), key=str) == [(0, None), (1, 0), (2, 1)]
    assert sorted(map(tuple, window_row_indices(l, r, ["t"], ["t"], [-4, 0]).collect())) == [(0, []), (1, [0]), (2, [1])]
    assert [asof_search([1, 3, 5], x) for x in (0, 3, 4, None)] == [-1, 1, 1, -1] and asof_search([1, 5], 3, "nearest") == 0 and asof_search([1, 5], 6, "forward") == -1
    assert code(asof_search, [1], 1, "up") == "asof-unknown-direction"
    ix = asof_index(r, ["t"])
    assert join(l, r, on="t", how="asof", right_index=ix).count() == 3
    assert code(join, l, r, on="t", how="asof", right_index=r) == "asof-index-required" and code(join, l, r, on="t", how="asof", right_index=index_by(r, "t")) == "asof-index-wrong-kind"
    assert code(join, l, make(spark, t=[1]), on="t", how="asof", right_index=ix) == "asof-index-dataset-mismatch"
    assert code(join, l.withColumnRenamed("t", "v"), r, on="v", how="asof", right_index=ix) == "asof-index-keys-mismatch"


def test_windows(spark):
    q = make(spark, time=list(range(1, 9)), bid=[float(i) for i in range(10, 18)])
    t = make(spark, time=[2, 5, 8, 0])
    out = join(t, q, on="time", how="window", window=[-2, 0], agg={"m": "(mn :bid)", "n": N, "f": "(first-val :bid)", "l": "(last-val :bid)", "rows": typed("bigint")(len)}).orderBy("time")
    assert [tuple(r) for r in out.collect()] == [(0, None, None, None, None, 0), (2, 10.5, 2, 10.0, 11.0, 2), (5, 13.0, 3, 12.0, 14.0, 3), (8, 16.0, 3, 15.0, 17.0, 3)]
    ms = make(spark, time=[0, 60000, 120000], bid=[10.0, 20.0, 30.0])
    assert join(make(spark, time=[120000]), ms, on="time", how="window", window=[-1, 0, "minutes"], agg={"m": "(mn :bid)"}).first()["m"] == 25.0
    assert join(make(spark, time=[120000]), ms, on="time", how="window", window=[-1, "minutes", 0], agg={"m": "(mn :bid)"}).first()["m"] == 25.0
    assert code(join, t, q, on="time", how="window", agg={"n": N}) == "join-missing-window" and code(join, t, q, on="time", how="window", window=[1, 0], agg={"n": N}) == "join-invalid-window"
    assert code(join, t, q, on="time", how="window", window=[0, 1, "eons"], agg={"n": N}) == "join-unknown-window-unit" and code(join, t, q, on="time", how="window", window=[0, 1]) == "join-missing-agg"


def test_window_brute(spark):
    left, right = random_sides(random.Random(9), 80)
    l = spark.createDataFrame(left, "k string, t long, i long").coalesce(1)  # noqa: E741
    r = spark.createDataFrame([(k, t, float(j)) for k, t, j in right], "k string, t long, v double").coalesce(1)
    for lo, hi in ((-3, 2), (0, 0), (-2.5, 1.5)):
        aggs = {"s": "(sm :v)", "n": N, "md": "(md :v)", "u": "(nuniq :v)", "py": typed("double")(lambda g: float(g["v"].sum()))}
        got = {x["i"]: x for x in join(l, r, on=["k", "t"], how="window", window=[lo, hi], agg=aggs).collect()}
        for k, t, i in left:
            rows = sorted(float(j) for rk, rt, j in right if rk == k and None not in (rt, t) and t + lo <= rt <= t + hi)
            want = (sum(rows), len(rows), (rows[(len(rows) - 1) // 2] + rows[len(rows) // 2]) / 2, len(rows)) if rows else (None,) * 4
            assert all(near(a, b) for a, b in zip((got[i]["s"], got[i]["n"], got[i]["md"], got[i]["u"]), want, strict=True)) and near(got[i]["py"], sum(rows))


def test_window_function_over_every_left_row(spark, tmp_path):
    rng = random.Random(12)
    at = [rng.randrange(48 * 60) for _ in range(120)]
    rows = [(i, rng.randrange(4), datetime(2024, 1, 1) + timedelta(minutes=m), rng.choice(["purchase", "view"]), float(i)) for i, m in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["n"] for r in catalogue.QUERIES["join_window_function"](spark, str(tmp_path)).collect()}
    want = {i: sum(k == "view" and v == u and abs(at[j] - at[i]) <= 120 for j, v, _, k, _ in rows) for i, u, _, kind, _ in rows if kind == "purchase"}
    assert got == want and len(want) > 40 and 0 in want.values()
