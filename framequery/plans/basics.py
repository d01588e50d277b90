"""Filters, derivations, selections, orders, aggregations and buckets over the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from framequery.concise import mn
from framequery.expr import agg, coalesce, col, cut, e, if_, op, row
from framequery.operators.query import NUMERICAL, asc, between, desc, dt, pass_nil, prepare_grouping, qtile, rename, typed, without, xbar
from framequery.plans.registry import query, rounded, table

N = agg("N")
#: Missing values made the same way on both sides: the tables have none.


def gappy(spark, d):
    ev = table(spark, d, "events")
    return ev.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value"))).withColumn("w", F.when(F.col("event_id") % 5 != 0, F.col("value") * 2))


GAPPY = "(SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS w FROM events)"


# -- filters

@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02")
def where_cmp(spark, d):
    return dt(table(spark, d, "lineitem"), where="(and (> :l_quantity 45) (<= :l_discount 0.02))", select=["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def where_in(spark, d):
    return dt(table(spark, d, "events"), where='(in :event_type #{"click" "error"})', select=["event_id", "event_type"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def where_between(spark, d):
    return dt(table(spark, d, "orders"), where=col("o_totalprice").between(100000, 150000), select=["o_orderkey", "o_totalprice"])


@query(f"SELECT event_id FROM {GAPPY} WHERE NOT coalesce(v > 20, false)")
def where_not_missing(spark, d):
    """A comparison with a missing value is false, so its negation holds."""
    return dt(gappy(spark, d), where="(not (> :v 20))", select=["event_id"])


@query("SELECT event_id FROM events WHERE false")
def where_nil_literal(spark, d):
    return dt(table(spark, d, "events"), where="(> :value nil)", select=["event_id"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def where_agg_scalar(spark, d):
    return dt(table(spark, d, "orders"), where="(> :o_totalprice (mn :o_totalprice))", select=["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.75) FROM orders)")
def where_cut(spark, d):
    return dt(table(spark, d, "orders"), where="(= (cut :o_totalprice 4) 4)", select=["o_orderkey"])


@query("SELECT event_id, value FROM events WHERE value >= 50 AND event_type = 'view'")
def where_form(spark, d):
    return dt(table(spark, d, "events"), where=["and", [">=", ":value", 50], ["=", ":event_type", "view"]], select=["event_id", "value"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 1")
def where_function(spark, d):
    return dt(table(spark, d, "nation"), where=lambda r: r["n_nationkey"] % 3 == 1, select=["n_nationkey", "n_name"])


# -- derivations

@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_extendedprice AS sq FROM lineitem")
def set_arithmetic(spark, d):
    new = {"net": col("l_extendedprice") * (1 - col("l_discount")), "sq": "(sq :l_extendedprice)"}
    return dt(table(spark, d, "lineitem"), set=new, select=["l_orderkey", "l_linenumber", "net", "sq"])


@query("SELECT event_id, CASE WHEN value > 80 THEN 'high' WHEN value > 30 THEN 'mid' ELSE 'low' END AS band, CASE WHEN value > 80 THEN value END AS top FROM events")
def set_cond(spark, d):
    new = {"band": '(cond (> :value 80) "high" (> :value 30) "mid" :else "low")', "top": if_(col("value") > 80, col("value"))}
    return dt(table(spark, d, "events"), set=new, select=["event_id", "band", "top"])


@query("SELECT event_id, (value * 2 + 1) * (value * 2 + 1 + value) AS x FROM events")
def set_let(spark, d):
    return dt(table(spark, d, "events"), set={"x": "(let [a (+ (* :value 2) 1) b (+ a :value)] (* a b))"}, select=["event_id", "x"])


@query(f"SELECT event_id, value / nullif(event_id % 3, 0) AS q, CASE WHEN event_id % 3 = 0 THEN CASE WHEN value > 0 THEN 'Infinity'::DOUBLE WHEN value < 0 THEN '-Infinity'::DOUBLE END ELSE value / (event_id % 3) END AS ieee FROM {GAPPY}")
def set_div0(spark, d):
    rows = gappy(spark, d).withColumn("m", F.col("event_id") % 3)
    return dt(rows, set={"q": "(div0 :value :m)", "ieee": "(/ :value :m)"}, select=["event_id", "q", "ieee"])


@query(f"SELECT event_id, coalesce(v, w, -1.0) AS c, CASE WHEN v IS NULL THEN 0.0 ELSE v END AS z FROM {GAPPY}")
def set_coalesce(spark, d):
    return dt(gappy(spark, d), set={"c": "(coalesce :v :w -1.0)", "z": "(na2zero :v)"}, select=["event_id", "c", "z"])


@query("SELECT event_id, CASE WHEN value / ((event_id % 2)::DOUBLE) < 1e300 THEN value / ((event_id % 2)::DOUBLE) ELSE value END AS f, CASE WHEN value >= 40 THEN value - 40 END AS pos FROM (SELECT event_id, value, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 1 END FROM events)")
def set_finite(spark, d):
    rows = table(spark, d, "events").withColumn("m", F.col("event_id") % 2)
    return dt(rows, set={"f": "(coalesce-finite (/ :value :m) :value)", "pos": "(neg2na (- :value 40))"}, select=["event_id", "f", "pos"])


@query("SELECT event_id, round(ln(value + 1), 9) AS l, round(asinh(value - 50), 9) AS a FROM events")
def set_logs(spark, d):
    return rounded(dt(table(spark, d, "events"), set={"l": "(log (+ :value 1))", "a": "(asinh (- :value 50))"}, select=["event_id", "l", "a"]), l=9, a=9)


@query("SELECT o_orderkey, o_totalprice / 100 AS hundreds, (o_totalprice / 100) * 2 AS doubled FROM orders")
def set_sequential(spark, d):
    return dt(table(spark, d, "orders"), set=[("hundreds", "(/ :o_totalprice 100)"), ("doubled", "(* :hundreds 2)")], select=["o_orderkey", "hundreds", "doubled"])


@query("SELECT c_custkey, round(c_acctbal / (SELECT max(c_acctbal) FROM customer), 9) AS share FROM customer")
def set_whole_aggregate(spark, d):
    return rounded(dt(table(spark, d, "customer"), set={"share": "(/ :c_acctbal (mx :c_acctbal))"}, select=["c_custkey", "share"]), share=9)


@query("SELECT n_nationkey, CASE WHEN n_regionkey IS NULL THEN NULL ELSE n_name || '/' || n_regionkey END AS label FROM nation")
def set_function(spark, d):
    f = pass_nil(typed("string")(lambda r: f"{r['n_name']}/{r['n_regionkey']}"), "n_regionkey")
    return dt(table(spark, d, "nation"), set={"label": f}, select=["n_nationkey", "label"])


@query(f"""SELECT event_id, CASE WHEN v IS NULL AND w IS NULL THEN NULL ELSE coalesce(v, 0) + coalesce(w, 0) END AS s, CASE WHEN v IS NULL THEN w WHEN w IS NULL THEN v ELSE (v + w) / 2 END AS m,
          least(v, w) AS lo, greatest(v, w) AS hi, ((v IS NULL)::INT + (w IS NULL)::INT)::INT AS gaps, v IS NULL OR w IS NULL AS anygap FROM {GAPPY}""")
def row_ops(spark, d):
    new = {"s": "(row/sum :v :w)", "m": row.mean(col("v"), col("w")), "lo": "(row/min :v :w)", "hi": "(row/max :v :w)", "gaps": "(row/count-nil :v :w)", "anygap": "(row/any-nil? :v :w)"}
    return dt(gappy(spark, d), set=new, select=["event_id", *new])


# -- selections, orders, limits

@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_numerical(spark, d):
    return dt(table(spark, d, "customer"), select=NUMERICAL)


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders")
def select_renamed(spark, d):
    return dt(table(spark, d, "orders"), select={"o_orderkey": "k", "o_totalprice": "price"})


@query("SELECT p_name, p_brand, p_type FROM part")
def select_between(spark, d):
    return dt(table(spark, d, "part"), select=between("p_type", "p_name"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_without(spark, d):
    return dt(table(spark, d, "part"), select=without("p_name", "p_brand", "p_type"))


@query("SELECT c_custkey, c_nationkey FROM customer")
def select_regex(spark, d):
    return dt(table(spark, d, "customer"), select=re.compile("key$"))


@query("SELECT s_suppkey, s_nationkey, s_acctbal AS balance FROM supplier")
def rename_columns(spark, d):
    return rename(table(spark, d, "supplier"), {"s_acctbal": "balance"}).drop("s_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 500")
def order_take_head(spark, d):
    return dt(table(spark, d, "orders"), select=["o_orderkey", "o_custkey", "o_totalprice"], order_by=[asc("o_custkey"), desc("o_totalprice"), "o_orderkey"], take=500)


@query("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100)")
def order_take_tail(spark, d):
    return dt(table(spark, d, "orders"), select=["o_orderkey", "o_totalprice"], order_by=["o_totalprice", "o_orderkey"], take=-100)


@query("SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def sort_two_keys(spark, d):
    return dt(table(spark, d, "lineitem"), select=["l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], order_by=[asc("l_suppkey"), desc("l_extendedprice")])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_k_per_group(spark, d):
    ranked = dt(table(spark, d, "orders"), by=["o_custkey"], within_order=[desc("o_totalprice"), "o_orderkey"], set={"n": "(win/row-number)"})
    return dt(ranked, where="(<= :n 3)", select=["o_custkey", "o_orderkey", "o_totalprice"])


# -- aggregations

@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price, round(sum(l_quantity), 2) AS sum_qty FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def agg_basic(spark, d):
    out = dt(table(spark, d, "lineitem"), where="(> :l_quantity 10)", by=["l_returnflag", "l_linestatus"], agg={"n": N, "avg_price": "(mn :l_extendedprice)", "sum_qty": "(sm :l_quantity)"}, order_by=["l_returnflag", "l_linestatus"])
    return rounded(out, avg_price=4, sum_qty=2)


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def agg_whole(spark, d):
    return rounded(dt(table(spark, d, "lineitem"), agg={"n": N, "total": "(sm :l_extendedprice)", "lo": "(mi :l_quantity)", "hi": "(mx :l_quantity)"}), total=2)


@query(f"""SELECT user_id, count(*) AS n, count(v) AS present, round(avg(v), 9) AS mean, round(stddev_samp(v), 6) AS sd, round(var_samp(v), 6) AS var, min(v) AS lo, max(v) AS hi,
           count(DISTINCT event_type) AS kinds, round(max(v) - min(v), 6) AS spread FROM {GAPPY} GROUP BY user_id""")
def agg_moments(spark, d):
    aggs = {"n": N, "present": "(ct :v)", "mean": mn("v"), "sd": "(sd :v)", "var": "(variance :v)", "lo": "(mi :v)", "hi": "(mx :v)", "kinds": "(nuniq :event_type)", "spread": "(- (mx :v) (mi :v))"}
    return rounded(dt(gappy(spark, d), by=["user_id"], agg=aggs), mean=9, sd=6, var=6, spread=6)


@query("SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS wavg, round(sum(l_quantity * l_extendedprice), 2) AS wsum FROM lineitem GROUP BY l_suppkey")
def agg_wavg(spark, d):
    return rounded(dt(table(spark, d, "lineitem"), by=["l_suppkey"], agg={"wavg": "(wavg :l_quantity :l_extendedprice)", "wsum": "(wsum :l_quantity :l_extendedprice)"}), wavg=4, wsum=2)


@query("SELECT event_type, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY event_type")
def agg_ohlc(spark, d):
    aggs = {"open": "(first-val :value)", "high": "(mx :value)", "low": "(mi :value)", "close": "(last-val :value)"}
    return dt(table(spark, d, "events"), by=["event_type"], within_order=["ts"], agg=aggs)


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.2), 4) AS q20, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.8), 4) AS q80 FROM lineitem GROUP BY l_suppkey")
def agg_quantiles(spark, d):
    aggs = {"q20": "(qnt :l_extendedprice 0.2)", "med": "(md :l_extendedprice)", "q80": "(qnt :l_extendedprice 0.8)"}
    return rounded(dt(table(spark, d, "lineitem"), by=["l_suppkey"], agg=aggs), q20=4, med=4, q80=4)


@query("SELECT user_id, CASE WHEN count(value) >= 8 THEN round(quantile_cont(value, 0.1), 6) END AS q FROM events GROUP BY user_id")
def agg_quantile_min_n(spark, d):
    return rounded(dt(table(spark, d, "events"), by=["user_id"], agg={"q": "(qnt :value 0.1 8)"}), q=6)


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY event_type")
def agg_quantile_band(spark, d):
    out = dt(table(spark, d, "events"), by=["event_type"], agg={"q": op("qnt", col("value"), (0.25, 0.75))})
    return rounded(out.select("event_type", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")), q1=6, q3=6)


@query("SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1")
def agg_missing_key(spark, d):
    rows = table(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 4 != 0, F.col("event_type")))
    return dt(rows, by=["kind"], agg={"n": N})


@query("SELECT s_nationkey, round(max(s_acctbal) - median(s_acctbal), 6) AS gap FROM supplier GROUP BY s_nationkey")
def agg_function(spark, d):
    f = typed("double")(lambda g: float(g["s_acctbal"].max() - g["s_acctbal"].median()))
    return rounded(dt(table(spark, d, "supplier"), by=["s_nationkey"], agg={"gap": f}), gap=6)


@query("SELECT l_returnflag, n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 100")
def agg_having(spark, d):
    return dt(dt(table(spark, d, "lineitem"), by=["l_returnflag"], agg={"n": N}), where="(> :n 100)")


@query("SELECT n_regionkey % 2 AS parity, count(*) AS n FROM nation GROUP BY 1")
def by_function(spark, d):
    f = typed("struct<parity:int>")(lambda r: {"parity": r["n_regionkey"] % 2})
    return dt(table(spark, d, "nation"), by=f, agg={"n": N})


# -- buckets

@query("SELECT (floor(p_retailprice) - floor(p_retailprice)::BIGINT % 50)::BIGINT AS p_retailprice, count(*) AS n, round(sum(p_size), 2) AS size FROM part GROUP BY 1")
def by_xbar_number(spark, d):
    return dt(table(spark, d, "part"), by=[xbar("p_retailprice", 50)], agg={"n": N, "size": "(sm :p_size)"})


@query("SELECT event_type, (epoch_ms(ts) // 300000 // 12 * 12 // 12)::BIGINT AS ts, count(*) AS n, max(value) AS high FROM events GROUP BY ALL")
def by_xbar_time(spark, d):
    return dt(table(spark, d, "events"), by=["event_type", xbar("ts", 1, "hours")], agg={"n": N, "high": "(mx :value)"})


@query("SELECT event_id, (epoch_ms(ts) // 60000 - epoch_ms(ts) // 60000 % 5)::BIGINT AS bar FROM events")
def set_xbar(spark, d):
    return dt(table(spark, d, "events"), set={"bar": "(xbar :ts 5 :minutes)"}, select=["event_id", "bar"])


def _bins(x: str, over: str, n: int) -> str:
    return " + ".join(["1", *[f"coalesce(({x} > quantile_cont({x}, {i / n}) OVER ({over}))::INT, 0)" for i in range(1, n)]])


@query(f"SELECT bin AS \"c_acctbal-q4\", count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM (SELECT c_acctbal, ({_bins('c_acctbal', '', 4)})::INT AS bin FROM customer) GROUP BY 1")
def by_qtile(spark, d):
    return rounded(dt(table(spark, d, "customer"), by=[qtile("c_acctbal", 4)], agg={"n": N, "mean": "(mn :c_acctbal)"}), mean=6)


@query(f"SELECT c_nationkey, CASE WHEN m >= 3 THEN bin ELSE 1 END AS \"c_acctbal-q3\", count(*) AS n FROM (SELECT c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS m, ({_bins('c_acctbal', 'PARTITION BY c_nationkey', 3)})::INT AS bin FROM customer) GROUP BY ALL")
def by_qtile_within(spark, d):
    return dt(table(spark, d, "customer"), by=["c_nationkey", qtile("c_acctbal", 3)], agg={"n": N})


@query("""SELECT bin AS "c_acctbal-q2", count(*) AS n FROM (SELECT CASE WHEN c_acctbal > (SELECT quantile_cont(c_acctbal, 0.5) FROM customer WHERE c_mktsegment = 'MACHINERY') THEN 2 ELSE 1 END::INT AS bin FROM customer) GROUP BY 1""")
def by_qtile_from(spark, d):
    return dt(table(spark, d, "customer"), by=[qtile("c_acctbal", 2, within='(= :c_mktsegment "MACHINERY")')], agg={"n": N})


@query(f"SELECT c_custkey, ({_bins('c_acctbal', 'PARTITION BY c_nationkey', 5)})::INT AS bin FROM customer")
def set_cut(spark, d):
    return dt(table(spark, d, "customer"), by=["c_nationkey"], set={"bin": cut(col("c_acctbal"), 5)}, select=["c_custkey", "bin"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal > q THEN 2 ELSE 1 END::INT AS bin FROM (SELECT *, quantile_cont(c_acctbal, 0.5) FILTER (c_mktsegment = 'FURNITURE') OVER (PARTITION BY c_nationkey) AS q FROM customer)""")
def set_cut_from(spark, d):
    return dt(table(spark, d, "customer"), by=["c_nationkey"], set={"bin": '(cut :c_acctbal 2 :from (= :c_mktsegment "FURNITURE"))'}, select=["c_custkey", "bin"])


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER w, 6) AS dm, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z, round(greatest(least(c_acctbal, quantile_cont(c_acctbal, 0.95) OVER w), quantile_cont(c_acctbal, 0.05) OVER w), 6) AS wz FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def stat_within(spark, d):
    new = {"dm": "(stat/demean :c_acctbal)", "z": "(stat/standardize :c_acctbal)", "wz": "(stat/winsorize :c_acctbal 0.05)"}
    return rounded(dt(table(spark, d, "customer"), by=["c_nationkey"], set=new, select=["c_custkey", "dm", "z", "wz"]), dm=6, z=6, wz=6)


@query("SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (), 6) AS dm, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 6) AS z FROM supplier")
def stat_whole(spark, d):
    return rounded(dt(table(spark, d, "supplier"), set={"dm": "(stat/demean :s_acctbal)", "z": "(stat/standardize :s_acctbal)"}, select=["s_suppkey", "dm", "z"]), dm=6, z=6)


@query("""WITH a AS (SELECT *, o_totalprice - lag(o_totalprice) OVER w AS delta, (row_number() OVER w)::INT AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
          SELECT o_orderkey, round(delta, 6) AS delta, n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS mean FROM a""")
def grouping_reuse(spark, d):
    orders = table(spark, d, "orders")
    g = prepare_grouping(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    first = dt(orders, grouping=g, set={"delta": "(win/delta :o_totalprice)", "n": "(win/row-number)", "mean": "(mn :o_totalprice)"})
    return rounded(dt(first, select=["o_orderkey", "delta", "n", "mean"]), delta=6, mean=6)


@query("SELECT o_orderkey, o_orderpriority, coalesce(o_totalprice, 0) AS price FROM orders WHERE o_orderstatus = 'F'")
def chained(spark, d):
    a = dt(table(spark, d, "orders"), where='(= :o_orderstatus "F")', set={"price": coalesce(col("o_totalprice"), 0.0)})
    return dt(a, select=["o_orderkey", "o_orderpriority", "price"])


@query("SELECT event_type, round(avg(value) / max(value), 9) AS ratio, round(sum(value) / count(value), 9) AS mean FROM events GROUP BY 1")
def agg_composed(spark, d):
    mean = e("(mn :value)")
    return rounded(dt(table(spark, d, "events"), by=["event_type"], agg={"ratio": mean / e("(mx :value)"), "mean": "(/ (sm :value) (ct :value))"}), ratio=9, mean=9)
