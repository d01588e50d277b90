"""Window functions over events by user in time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequery.expr import col, win
from framequery.operators.query import desc, dt
from framequery.plans.basics import GAPPY, gappy
from framequery.plans.registry import query, rounded, table

W = "(PARTITION BY user_id ORDER BY ts)"
UP = "(PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def last(n: int) -> str:
    return f"(PARTITION BY user_id ORDER BY ts ROWS {n - 1} PRECEDING)"


def over_users(rows, **new):
    return dt(rows, by=["user_id"], within_order=["ts"], set=new, select=["event_id", *new])


@query(f"""WITH c AS (SELECT event_id, user_id, ts, row_number() OVER {W} AS rn, (row_number() OVER {W} = 1 OR kind IS DISTINCT FROM lag(kind) OVER {W}) AS ch
           FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END AS kind FROM events))
           SELECT event_id, (max(CASE WHEN ch THEN rn END) OVER {UP})::INT AS rank, (sum(ch::INT) OVER {UP})::BIGINT AS dense, (sum(ch::INT) OVER {UP})::BIGINT AS run, rn::INT AS rn, ch AS differ FROM c""")
def win_runs(spark, d):
    """Ranks by runs of equal neighbours, not by value."""
    rows = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b"))
    return over_users(rows, rank="(win/rank :kind)", dense="(win/dense-rank :kind)", run="(win/rleid :kind)", rn="(win/row-number)", differ="(win/differ :kind)")


@query(f"SELECT event_id, lag(v, 1) OVER {W} AS lag1, CASE WHEN row_number() OVER {W} <= 2 THEN 0 ELSE lag(v, 2) OVER {W} END AS lag2, lead(v, 1) OVER {W} AS lead1, lead(event_id, 1, -1) OVER {W} AS next FROM {GAPPY}")
def win_lag_lead(spark, d):
    return over_users(gappy(spark, d), lag1="(win/lag :v 1)", lag2="(win/lag :v 2 {:fill 0})", lead1="(win/lead :v 1)", next=win.lead(col("event_id"), 1, fill=-1))


@query(f"""SELECT event_id, round(coalesce(sum(v) OVER {UP}, 0), 6) AS cs, CASE WHEN v IS NOT NULL THEN min(v) OVER {UP} END AS lo, CASE WHEN v IS NOT NULL THEN max(v) OVER {UP} END AS hi, round(avg(v) OVER {UP}, 9) AS mean,
           last_value(v IGNORE NULLS) OVER {UP} AS filled FROM {GAPPY}""")
def win_cumulative(spark, d):
    return rounded(over_users(gappy(spark, d), cs="(win/cumsum :v)", lo="(win/cummin :v)", hi="(win/cummax :v)", mean="(win/cummean :v)", filled="(win/fills :v)"), cs=6, mean=9)


@query(f"""SELECT event_id, round(v - lag(v) OVER {W}, 9) AS delta, round(CASE WHEN lag(v) OVER {W} <> 0 THEN v / lag(v) OVER {W} END, 9) AS ratio, round(asinh(v) - asinh(lag(v) OVER {W}), 9) AS grr FROM {GAPPY}""")
def win_changes(spark, d):
    return rounded(over_users(gappy(spark, d), delta="(win/delta :v)", ratio="(win/ratio :v)", grr="(win/grr :v)"), delta=9, ratio=9, grr=9)


@query(f"""SELECT event_id, round(avg(v) OVER {last(5)}, 9) AS ma, round(sum(v) OVER {last(5)}, 6) AS ms, min(v) OVER {last(5)} AS lo, max(v) OVER {last(5)} AS hi FROM {GAPPY}""")
def win_rolling(spark, d):
    return rounded(over_users(gappy(spark, d), ma="(win/mavg :v 5)", ms="(win/msum :v 5)", lo="(win/mmin :v 5)", hi="(win/mmax :v 5)"), ma=9, ms=6)


@query(f"""SELECT event_id, round(stddev_samp(v) OVER {last(4)}, 6) AS sd, round(stddev_pop(v) OVER {last(4)}, 6) AS sd0, round(sqrt(avg(CASE WHEN v IS NOT NULL THEN power(least(v - 50, 0), 2) END) OVER {last(4)}), 6) AS down,
           CASE WHEN row_number() OVER {W} >= 4 THEN round(avg(v) OVER {last(4)}, 9) END AS ma FROM {GAPPY}""")
def win_rolling_deviation(spark, d):
    return rounded(over_users(gappy(spark, d), sd="(win/mdev :v 4)", sd0="(win/mdev :v 4 {:ddof 0})", down="(win/mdowndev (- :v 50) 4)", ma="(win/mavg :v 4 {:min-periods 4})"), sd=6, sd0=6, down=6, ma=9)


@query(f"""WITH s AS (SELECT event_id, user_id, ts, v, row_number() OVER {W} AS i FROM {GAPPY}),
           p AS (SELECT event_id, list(v) FILTER (v IS NOT NULL) OVER {UP} AS vs FROM s)
           SELECT event_id, round(list_reduce(vs, lambda a, x: 2.0 / 11 * x + (1 - 2.0 / 11) * a), 6) AS ema, round(list_reduce(vs, lambda a, x: 0.3 * x + 0.7 * a), 6) AS ema3 FROM p""")
def win_ema(spark, d):
    return rounded(over_users(gappy(spark, d), ema="(win/ema :v 10)", ema3="(win/ema :v {:alpha 0.3})"), ema=6, ema3=6)


@query(f"""SELECT event_id, round(product(1 + v / 10000) OVER {UP}, 8) AS growth, max(v) OVER {UP} AS top, round(v - lag(v) OVER {W}, 9) AS step, CASE WHEN v IS NOT NULL AND lag(v) OVER {W} IS NOT NULL THEN v > lag(v) OVER {W} END AS up FROM {GAPPY}""")
def win_scan_prior(spark, d):
    return rounded(over_users(gappy(spark, d), growth="(win/scan * (+ 1 (/ :v 10000)))", top="(win/scan max :v)", step="(win/each-prior - :v)", up="(win/each-prior > :v)"), growth=8, step=9)


@query("""WITH r AS (SELECT event_id, user_id, ts, value / nullif(lag(value) OVER (PARTITION BY user_id ORDER BY ts), 0) - 1 AS ret FROM events)
          SELECT event_id, round(stddev_samp(ret) OVER (PARTITION BY user_id ORDER BY ts ROWS 9 PRECEDING), 6) AS vol FROM r""")
def win_nested(spark, d):
    return rounded(over_users(table(spark, d, "events"), vol="(win/mdev (- (win/ratio :value) 1) 10)"), vol=6)


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 9) AS mean, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER (PARTITION BY user_id ORDER BY ts) AS first, first_value(value) OVER (PARTITION BY user_id ORDER BY ts DESC) AS last, (SELECT count(DISTINCT event_type) FROM events x WHERE x.user_id = e.user_id) AS kinds, round(median(value) OVER (PARTITION BY user_id), 6) AS med FROM events e")
def win_group_broadcast(spark, d):
    new = {"mean": "(mn :value)", "n": "N", "first": "(first-val :value)", "last": "(last-val :value)", "kinds": "(nuniq :event_type)", "med": "(md :value)"}
    return rounded(over_users(table(spark, d, "events"), **new), mean=9, med=6)


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS rn FROM orders")
def win_descending(spark, d):
    return dt(table(spark, d, "orders"), by=["o_custkey"], within_order=[desc("o_totalprice"), "o_orderkey"], set={"rn": "(win/row-number)"}, select=["o_orderkey", "rn"])


@query("SELECT c_custkey, round(sum(c_acctbal) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), 2) AS cs, lag(c_acctbal) OVER (ORDER BY c_custkey) AS before FROM customer")
def win_whole_table(spark, d):
    return rounded(dt(table(spark, d, "customer"), within_order=["c_custkey"], set={"cs": "(win/cumsum :c_acctbal)", "before": "(win/lag :c_acctbal 1)"}, select=["c_custkey", "cs", "before"]), cs=2)


WHOLE = """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS cs, lag(o_totalprice, 3) OVER o AS before, lead(o_totalprice, 2) OVER o AS after, round(avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS 6 PRECEDING), 5) AS ma,
           max(o_totalprice) OVER w AS top, (row_number() OVER o)::INT AS n, round(o_totalprice - lag(o_totalprice) OVER o, 4) AS step FROM orders WINDOW o AS (ORDER BY o_orderkey), w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"""


@query(WHOLE)
def win_whole_spread(spark, d):
    """Windows over the whole table, by ranges of it."""
    new = {"cs": "(win/cumsum :o_totalprice)", "before": "(win/lag :o_totalprice 3)", "after": "(win/lead :o_totalprice 2)", "ma": "(win/mavg :o_totalprice 7)", "top": "(win/cummax :o_totalprice)", "n": "(win/row-number)", "step": "(win/delta :o_totalprice)"}
    return rounded(dt(table(spark, d, "orders"), within_order=["o_orderkey"], set=new, select=["o_orderkey", *new], spread=True), cs=2, ma=5, step=4)


AVERAGES = 40


@query("SELECT event_id, " + ", ".join(f"round(avg(value) OVER {last(n)}, 9) AS ma{n}" for n in range(2, AVERAGES + 2)) + " FROM events")
def win_forty_averages(spark, d):
    """Forty moving averages share one shuffle and one sort."""
    new = {f"ma{n}": f"(win/mavg :value {n})" for n in range(2, AVERAGES + 2)}
    return rounded(over_users(table(spark, d, "events"), **new), **dict.fromkeys(new, 9))
