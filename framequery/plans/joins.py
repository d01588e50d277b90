"""Joins, reshaping, tidying and look-ups over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequery.expr import agg
from framequery.operators.index import asof_index, index_by, lookup
from framequery.operators.joins import asof_row_indices, join, window_row_indices
from framequery.operators.query import dt, typed
from framequery.operators.reshape import cast, melt
from framequery.operators.tidy import clean_column_names, coerce_columns, describe, drop_constant_columns, duplicate_rows, mark_duplicates
from framequery.plans.registry import query, rounded, table
from framequery.streaming.bars import sessions, time_bars

N = agg("N")

# -- equi-joins

@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner(spark, d):
    big = dt(table(spark, d, "orders"), where="(> :o_totalprice 200000)")
    return join(big, table(spark, d, "customer"), left_on="o_custkey", right_on="c_custkey").select("o_orderkey", "o_custkey", "c_name", "c_nationkey")


@query("SELECT n_nationkey AS k, n_name, r_name FROM nation LEFT JOIN (SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def join_left(spark, d):
    some = dt(table(spark, d, "region"), where="(< :r_regionkey 3)")
    out = join(table(spark, d, "nation"), some, left_on="n_regionkey", right_on="r_regionkey", how="left", validate="m:1")
    return out.select(F.col("n_nationkey").alias("k"), "n_name", "r_name")


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey < 10) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    some = dt(table(spark, d, "supplier"), where="(< :s_nationkey 10)")
    return join(some, table(spark, d, "nation"), left_on=["s_nationkey"], right_on=["n_nationkey"], how="right").select("s_suppkey", "n_name")


@query("SELECT k, a.n AS n, b.n AS \"right.n\" FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 5 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1) b USING (k)")
def join_outer(spark, d):
    count = lambda t, k, w: dt(table(spark, d, t), where=w, by=[k], agg={"n": N}).withColumnRenamed(k, "k")
    return join(count("customer", "c_nationkey", "(> :c_nationkey 5)"), count("supplier", "s_nationkey", "(< :s_nationkey 20)"), on="k", how="outer")


# -- as-of and window joins: purchases against views of the same user

def sides(spark, d):
    ev = table(spark, d, "events").withColumn("t", F.expr("unix_date(cast(ts as date)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(date_part('SECOND', ts) * 1000000 as bigint)"))
    pick = lambda kind: dt(ev, where=f'(= :event_type "{kind}")', select=["event_id", "user_id", "t", "value"])
    return pick("purchase"), pick("view")


SIDES = "p AS (SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'view')"
HOUR = 3_600_000_000
NAMES = '"right.event_id", "right.value"'


def asof(spark, d, **kw):
    p, v = sides(spark, d)
    return join(p, v, on=["user_id", "t"], how="asof", **kw)


@query(f'WITH {SIDES} SELECT p.*, v.event_id AS "right.event_id", v.value AS "right.value" FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t')
def join_asof_backward(spark, d):
    return asof(spark, d)


@query(f'WITH {SIDES} SELECT p.*, v.event_id AS "right.event_id", v.value AS "right.value" FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t')
def join_asof_spread(spark, d):
    """The same by ranges of (user, time): one user may hold any share of the rows."""
    return asof(spark, d, spread=True)


@query(f'WITH {SIDES} SELECT p.*, v.event_id AS "right.event_id", v.value AS "right.value" FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t <= v.t')
def join_asof_forward(spark, d):
    return asof(spark, d, direction="forward")


@query(f"""WITH {SIDES}, b AS (SELECT p.*, v.t AS bt, v.event_id AS be, v.value AS bv FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t),
           f AS (SELECT b.*, v.t AS ft, v.event_id AS fe, v.value AS fv FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.t <= v.t)
           SELECT event_id, user_id, t, value, CASE WHEN ft IS NULL OR t - bt <= ft - t THEN be ELSE fe END AS "right.event_id", CASE WHEN ft IS NULL OR t - bt <= ft - t THEN bv ELSE fv END AS "right.value" FROM f""")
def join_asof_nearest(spark, d):
    return asof(spark, d, direction="nearest")


@query(f"""WITH {SIDES} SELECT p.*, CASE WHEN p.t - v.t <= {6 * HOUR} THEN v.event_id END AS "right.event_id", CASE WHEN p.t - v.t <= {6 * HOUR} THEN v.value END AS "right.value" FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t""")
def join_asof_tolerance(spark, d):
    return asof(spark, d, tolerance=6 * HOUR)


@query("""WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS e, user_id, ts, value AS x FROM events WHERE event_type = 'view')
          SELECT p.*, CASE WHEN epoch_ms(p.ts) - epoch_ms(v.ts) <= 7200000 THEN e END AS e, CASE WHEN epoch_ms(p.ts) - epoch_ms(v.ts) <= 7200000 THEN x END AS x FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_asof_time_index(spark, d):
    """A time as the key, a tolerance with a unit, and a prepared right side."""
    ev = table(spark, d, "events")
    p = dt(ev, where='(= :event_type "purchase")', select=["event_id", "user_id", "ts", "value"])
    v = dt(ev, where='(= :event_type "view")', select={"event_id": "e", "user_id": "user_id", "ts": "ts", "value": "x"})
    return join(p, v, on=["user_id", "ts"], how="asof", tolerance=[2, "hours"], right_index=asof_index(v, ["user_id", "ts"], persist=False))


@query(f"WITH {SIDES}, m AS (SELECT p.event_id AS a, v.event_id AS b FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t) SELECT count(*) AS n, count(b) AS matched FROM m")
def asof_matches(spark, d):
    p, v = sides(spark, d)
    return dt(asof_row_indices(p, v, ["user_id", "t"], ["user_id", "t"]), agg={"n": N, "matched": "(ct :right_row)"})


@query(f"""WITH {SIDES} SELECT p.event_id, p.user_id, p.t, p.value, CASE WHEN count(v.t) > 0 THEN count(v.t) END AS n, round(avg(v.value), 9) AS mean, max(v.value) AS top, arg_min(v.value, v.t) AS first
           FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.t BETWEEN p.t - {12 * HOUR} AND p.t GROUP BY ALL""")
def join_window(spark, d):
    p, v = sides(spark, d)
    return rounded(join(p, v, on=["user_id", "t"], how="window", window=[-12 * HOUR, 0], agg={"n": N, "mean": "(mn :value)", "top": "(mx :value)", "first": "(first-val :value)"}), mean=9)


@query(f"""WITH {SIDES} SELECT p.event_id, p.user_id, p.t, p.value, count(v.t) AS n FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.t BETWEEN p.t - {2 * HOUR} AND p.t + {2 * HOUR} GROUP BY ALL""")
def join_window_function(spark, d):
    """A Python function over each window, called once a left row; it sees an empty table where nothing matches."""
    p, v = sides(spark, d)
    return join(p, v, on=["user_id", "t"], how="window", window=[-2 * HOUR, 2 * HOUR], agg={"n": typed("bigint")(len)})


@query(f"WITH {SIDES} SELECT sum(n)::BIGINT AS pairs, max(n) AS most FROM (SELECT p.event_id, count(v.t) AS n FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.t BETWEEN p.t - {HOUR} AND p.t + {HOUR} GROUP BY 1)")
def window_matches(spark, d):
    p, v = sides(spark, d)
    found = window_row_indices(p, v, ["user_id", "t"], ["user_id", "t"], [-HOUR, HOUR]).withColumn("n", F.size("right_rows").cast("long"))
    return found.agg(F.sum("n").alias("pairs"), F.max("n").alias("most"))


# -- reshaping

@query("SELECT s_suppkey, 's_nationkey' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier")
def melt_columns(spark, d):
    return melt(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), id=["s_suppkey"])


@query("SELECT user_id, " + ", ".join(f"coalesce(round(sum(value) FILTER (event_type = '{k}'), 6), 0) AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def cast_columns(spark, d):
    out = cast(table(spark, d, "events"), id="user_id", from_="event_type", value="value", agg="sm", fill=0.0)
    kinds = ("click", "error", "purchase", "signup", "view")
    return rounded(out.select("user_id", *kinds), **dict.fromkeys(kinds, 6))


@query("SELECT user_id, arg_min(value, ts) FILTER (event_type = 'click') AS click, arg_min(value, ts) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def cast_first(spark, d):
    """The first row of each cell, in the order of the table (events come by time)."""
    return cast(table(spark, d, "events"), id=["user_id"], from_="event_type", value="value", columns=["click", "view"])


# -- tidying, look-ups

@query("""SELECT 'l_quantity' AS "column", 'double' AS datatype, count(*) AS n, 0::BIGINT AS "n-missing", round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS p25, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS max FROM lineitem
          UNION ALL SELECT 'l_returnflag', 'string', count(*), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem""")
def describe_columns(spark, d):
    return rounded(describe(table(spark, d, "lineitem"), ["l_quantity", "l_returnflag"]), mean=6, sd=6)


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dup FROM lineitem")
def mark_duplicate_keys(spark, d):
    return mark_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], name="dup").select("l_orderkey", "l_linenumber", "dup")


@query("SELECT c_nationkey, c_mktsegment FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE n > 1")
def duplicate_pairs(spark, d):
    return duplicate_rows(table(spark, d, "customer").select("c_nationkey", "c_mktsegment"))


@query("SELECT n_nationkey AS \"n-nationkey\", n_name AS \"n-name\", n_regionkey AS \"n-regionkey\" FROM nation")
def clean_names(spark, d):
    return clean_column_names(table(spark, d, "nation"))


@query("SELECT r_regionkey, r_name FROM region")
def drop_constants(spark, d):
    return drop_constant_columns(table(spark, d, "region").withColumn("one", F.lit(1)).withColumn("none", F.lit(None).cast("string")))


@query("SELECT o_orderkey, o_totalprice::INT AS o_totalprice, try_cast(o_orderpriority AS INT) AS o_orderpriority FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_orderpriority FROM orders)")
def coerce_types(spark, d):
    return coerce_columns(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), {"o_totalprice": "int", "o_orderpriority": "int"})


@query("SELECT event_id, value FROM events WHERE user_id = 5 AND event_type = 'view'")
def lookup_rows(spark, d):
    ix = index_by(table(spark, d, "events"), ["user_id", "event_type"], persist=False)
    return lookup(ix, (5, "view")).select("event_id", "value")


# -- time bars and sessions: the same code runs on streams

@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS bar, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY ALL")
def stream_time_bars(spark, d):
    return rounded(time_bars(table(spark, d, "events"), "ts", 1, "days", {"n": N, "mean": "(mn :value)"}, by=["event_type"]), mean=9)


@query("""WITH g AS (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT AS new FROM events),
          s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
          SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return sessions(table(spark, d, "events"), "ts", "6 hours", {"n": N}, ["user_id"])
