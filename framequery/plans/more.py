"""Files, checks, look-ups, rarer operator values, messages: the surface beyond the everyday query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framequery import concise
from framequery.display import expr_tree, last, remember, view_html
from framequery.errors import DtError
from framequery.expr import agg, col, e, to_string
from framequery.operators.index import asof_groups, asof_index, index_by, is_index, lookup_indices, row_asof_val, row_exact_key
from framequery.operators.joins import asof_indices, asof_search, join, join_report
from framequery.operators.query import NOT_NUMERICAL, cut, dt, pass_nil, prepare_grouping, qtile, row_numbered, typed
from framequery.plans.joins import HOUR, SIDES, sides
from framequery.plans.registry import query, rounded, table
from framequery.plans.windows import GAPPY, UP, gappy, over_users
from framequery.plans.windows import W as BY_USER
from framequery.sources.files import extension, from_rows, read, read_pieces, read_seq, write
from framequery.sources.scratch import shared_folder
from framequery.streaming.bars import stream_dt

N = agg("N")

# -- files: written to the shared folder and read back

def place(spark, name: str) -> str:
    return f"{shared_folder(spark).removeprefix('file://')}/fq_{uuid.uuid4().hex}/{name}"


def there_and_back(spark, df, name: str, **options):
    """The table by way of a file of that name."""
    path = place(spark, name)
    _folder(spark, path.rsplit("/", 1)[0])
    write(df, path)
    return read(spark, path, **options)


def _folder(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
KINDS = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query(CUSTOMERS)
def file_csv(spark, d):
    return there_and_back(spark, table(spark, d, "customer"), "t.csv", schema=KINDS)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def file_csv_types_found(spark, d):
    return there_and_back(spark, table(spark, d, "nation"), "t.csv")


@query(CUSTOMERS)
def file_csv_gz(spark, d):
    return there_and_back(spark, table(spark, d, "customer"), "t.csv.gz", schema=KINDS)


@query(CUSTOMERS)
def file_tsv(spark, d):
    return there_and_back(spark, table(spark, d, "customer"), "t.tsv", schema=KINDS)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def file_json(spark, d):
    """One JSON document, an array of objects."""
    return there_and_back(spark, table(spark, d, "supplier"), "t.json", schema="s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query(CUSTOMERS)
def file_json_lines(spark, d):
    return there_and_back(spark, table(spark, d, "customer"), "t.jsonl", schema=KINDS)


@query(CUSTOMERS)
def file_ndjson_gz(spark, d):
    return there_and_back(spark, table(spark, d, "customer"), "t.ndjson.gz", schema=KINDS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def file_parquet(spark, d):
    return there_and_back(spark, table(spark, d, "orders"), "t.parquet")


@query(CUSTOMERS)
def file_arrow(spark, d):
    return there_and_back(spark, table(spark, d, "customer"), "t.arrow")


@query(CUSTOMERS)
def file_feather(spark, d):
    return there_and_back(spark, table(spark, d, "customer"), "t.feather")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def file_allowed_columns(spark, d):
    return read(spark, f"{d}/orders.parquet", column_allowlist=["o_orderkey", "o_totalprice"])


@query("SELECT s_suppkey AS S_SUPPKEY, s_nationkey AS S_NATIONKEY FROM supplier")
def file_blocked_columns(spark, d):
    return read(spark, f"{d}/supplier.parquet", column_blocklist=["s_name", "s_acctbal"], key_fn=str.upper)


@query("SELECT c_custkey, c_acctbal FROM customer")
def file_pieces_parquet(spark, d):
    """The pieces of a file put together again."""
    path = place(spark, "t.parquet")
    write(table(spark, d, "customer"), path)
    out = None
    for piece in read_seq(spark, path, column_allowlist=["c_custkey", "c_acctbal"]):
        out = piece if out is None else out.unionByName(piece)
    return out


@query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys, (count(*) + 99) // 100 AS pieces FROM customer")
def file_pieces_lines(spark, d):
    """Each piece by itself, all of them in one job."""
    path = place(spark, "t.jsonl")
    _folder(spark, path.rsplit("/", 1)[0])
    write(table(spark, d, "customer"), path)
    each = read_pieces(spark, path, batch_size=100).groupBy("piece").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.sum("keys").alias("keys"), F.count("*").alias("pieces"))


@query("SELECT * FROM (VALUES ('a.csv', 'csv'), ('b/c.TSV.gz', 'tsv'), ('d.ndjson', 'ndjson'), ('none', NULL)) t(path, ext)")
def file_extensions(spark, d):
    paths = ["a.csv", "b/c.TSV.gz", "d.ndjson", "none"]
    return from_rows(spark, {"path": paths, "ext": [extension(p) for p in paths]}, "path string, ext string")


# -- joins: checks, reports, missing keys, names

@query("""WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0)
          SELECT (SELECT count(*) FROM o JOIN c USING (k)) AS matched, (SELECT count(*) FROM o ANTI JOIN c USING (k)) AS left_only, (SELECT count(*) FROM c ANTI JOIN o USING (k)) AS right_only""")
def join_key_report(spark, d):
    r = join_report(table(spark, d, "orders"), table(spark, d, "customer").filter("c_custkey % 3 <> 0"), ["o_custkey"], ["c_custkey"])
    return from_rows(spark, {"matched": [r.matched], "left_only": [r.left_only], "right_only": [r.right_only]}, "matched bigint, left_only bigint, right_only bigint")


@query("SELECT * FROM (VALUES ('1:1', 'join-cardinality-violation'), ('1:m', 'join-cardinality-violation'), ('m:1', 'right'), ('m:m', 'right')) t(validate, said)")
def join_validated(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    said = []
    for v in ("1:1", "1:m", "m:1", "m:m"):
        try:
            join(orders, customer, left_on="o_custkey", right_on="c_custkey", validate=v)
            said.append("right")
        except DtError as x:
            said.append(x.code)
    return from_rows(spark, {"validate": ["1:1", "1:m", "m:1", "m:m"], "said": said}, "validate string, said string")


@query("SELECT s_suppkey, s.k, s.name, c.name AS \"right.name\" FROM (SELECT s_suppkey, s_nationkey AS k, s_name AS name FROM supplier) s JOIN (SELECT n_nationkey AS k, n_name AS name FROM nation) c USING (k)")
def join_clashing_names(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return join(s, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), on="k")


HOLED = "p AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view')"


@query(f"""WITH {HOLED}, m AS (SELECT p.event_id AS a, v.event_id AS b, v.t FROM p JOIN v ON p.user_id IS NOT DISTINCT FROM v.user_id AND v.t <= p.t)
           SELECT p.event_id, p.user_id, p.t, (SELECT max_by(b, (m.t, b)) FROM m WHERE a = p.event_id) AS "right.event_id" FROM p""")
def join_asof_missing_keys(spark, d):
    """Missing exact keys match each other; a missing time matches nothing."""
    p, v = sides(spark, d)
    holed = lambda df: df.withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id"))).drop("value")
    return join(holed(p).withColumn("t", F.when(F.col("event_id") % 5 != 0, F.col("t"))), holed(v), on=["user_id", "t"], how="asof")


@query(f"""WITH {SIDES}, b AS (SELECT p.*, v.t AS bt, v.event_id AS be FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t),
           f AS (SELECT b.*, v.t AS ft, v.event_id AS fe FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.t <= v.t)
           SELECT event_id, CASE WHEN ft IS NULL OR t - bt <= ft - t THEN be ELSE fe END AS hit FROM f""")
def join_asof_nearest_spread(spark, d):
    p, v = sides(spark, d)
    return join(p, v, on=["user_id", "t"], how="asof", direction="nearest", spread=True).select("event_id", F.col("`right.event_id`").alias("hit"))


@query(f"""WITH {SIDES} SELECT p.event_id, CASE WHEN count(v.t) > 0 THEN count(v.t) END AS n FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.t >= p.t - {HOUR}.5 AND v.t <= p.t + 0.25 GROUP BY 1""")
def join_window_fractions(spark, d):
    """Bounds that are no whole numbers, on times beyond ten to the fifteenth."""
    p, v = sides(spark, d)
    return join(p, v, on=["user_id", "t"], how="window", window=[-HOUR - 0.5, 0.25], agg={"n": N}).select("event_id", "n")


@query("SELECT * FROM (VALUES ('backward', 2), ('forward', 3), ('nearest', 2), ('before all', -1), ('after all', -1)) t(kind, place)")
def asof_places(spark, d):
    v = [1, 4, 6, 9]
    at = [asof_search(v, 7), asof_search(v, 7, "forward"), asof_search(v, 7, "nearest"), asof_search(v, 0), asof_search(v, 10, "forward")]
    return from_rows(spark, {"kind": ["backward", "forward", "nearest", "before all", "after all"], "place": at}, "kind string, place int")


@query("SELECT * FROM (VALUES (0, -1), (1, 0), (2, 0), (3, 2), (4, -1)) t(i, place)")
def asof_merge(spark, d):
    return from_rows(spark, {"i": list(range(5)), "place": asof_indices([0, 1, 3, 9, None], [1, None, 4, 12])}, "i int, place int")


# -- groupings, indexes

@query("""WITH o AS (SELECT * FROM orders WHERE o_totalprice > 150000)
          SELECT o_orderkey, (row_number() OVER w)::INT AS n, round(o_totalprice - lag(o_totalprice) OVER w, 6) AS step FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def grouping_filtered(spark, d):
    """A table filtered after its grouping was prepared is worked on by its own rows."""
    orders = table(spark, d, "orders")
    g = prepare_grouping(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    some = orders.filter("o_totalprice > 150000")
    return rounded(dt(some, grouping=g, set={"n": "(win/row-number)", "step": "(win/delta :o_totalprice)"}, select=["o_orderkey", "n", "step"]), step=6)


@query("""WITH a AS (SELECT *, o_totalprice - lag(o_totalprice) OVER w AS d1 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
          b AS (SELECT *, d1 - lag(d1) OVER w AS d2 FROM a WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
          SELECT o_orderkey, round(d1, 6) AS d1, round(d2, 6) AS d2, round(avg(d2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING), 6) AS m FROM b""")
def grouping_chain(spark, d):
    """Three passes over one grouping: one shuffle, one sort."""
    orders = table(spark, d, "orders")
    g = prepare_grouping(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    a = dt(orders, grouping=g, set={"d1": "(win/delta :o_totalprice)"})
    b = dt(a, grouping=g, set={"d2": "(win/delta :d1)"})
    return rounded(dt(b, grouping=g, set={"m": "(win/mavg :d2 3)"}, select=["o_orderkey", "d1", "d2", "m"]), d1=6, d2=6, m=6)


@query("SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id")
def index_groups(spark, d):
    return asof_groups(asof_index(table(spark, d, "events"), ["user_id", "ts"], persist=False))


@query("SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'click'")
def index_lookup_rows(spark, d):
    """Row ids of a key, met with the table that they number."""
    ev = row_numbered(table(spark, d, "events").coalesce(1))
    found = lookup_indices(index_by(ev, ["user_id", "event_type"], persist=False), (7, "click"))
    return ev.join(found, ev[ev.columns[-1]] == found["row"]).select("event_id")


@query("SELECT true AS is_index, false AS is_not, 'hash' AS kind, 'c_nationkey,c_custkey' AS keys, 5::BIGINT AS exact, 9::BIGINT AS time")
def index_facts(spark, d):
    ix = index_by(table(spark, d, "customer"), ["c_nationkey", "c_custkey"], persist=False)
    row = {"c_nationkey": 5, "c_custkey": 9}
    facts = {"is_index": [is_index(ix)], "is_not": [is_index("no")], "kind": [ix.kind], "keys": [",".join(ix.keys)], "exact": [row_exact_key(row, list(ix.keys))[0]], "time": [row_asof_val(row, list(ix.keys))]}
    return from_rows(spark, facts, "is_index boolean, is_not boolean, kind string, keys string, exact bigint, time bigint")


# -- selections, aggregates, derivations

@query("SELECT c_name, c_mktsegment FROM customer")
def select_not_numerical(spark, d):
    return dt(table(spark, d, "customer"), select=NOT_NUMERICAL)


@query("SELECT o_orderkey, o_custkey FROM orders")
def select_predicate(spark, d):
    return dt(table(spark, d, "orders"), select=lambda c: c.endswith("key"))


@query("SELECT lower(substr(event_type, 1, 1)) AS letter, (user_id % 3)::INT AS third, count(*) AS n FROM events GROUP BY ALL")
def by_two_functions(spark, d):
    letter = typed("string", "letter")(lambda r: r["event_type"][0])
    third = typed("int", "third")(lambda r: r["user_id"] % 3)
    return dt(table(spark, d, "events"), by=[letter, third], agg={"n": N})


@query("SELECT event_type, count(*) AS n, avg(value) AS mean FROM events WHERE false GROUP BY event_type")
def by_without_rows(spark, d):
    return dt(table(spark, d, "events"), where="(< :event_id 0)", by=["event_type"], agg={"n": N, "mean": "(mn :value)"})


@query(f"SELECT event_type, count(*) AS n, count(v) AS there FROM {GAPPY} GROUP BY event_type")
def agg_short_names(spark, d):
    return dt(gappy(spark, d), by=["event_type"], agg={"n": concise.ct("v"), "there": "(ct :v)"}, off_heap=True)


@query(f"SELECT event_id, CASE WHEN isfinite(v / (user_id % 2)) THEN v / (user_id % 2) END AS x FROM (SELECT event_id, v, user_id::DOUBLE AS user_id FROM {GAPPY})")
def set_nonfinite(spark, d):
    return dt(gappy(spark, d).withColumn("h", (F.col("user_id") % 2).cast("double")), set={"x": "(nonfin2na (/ :v :h))"}, select=["event_id", "x"])


@query("SELECT s_suppkey, round(greatest(least(s_acctbal, (SELECT quantile_cont(s_acctbal, 0.9) FROM supplier)), (SELECT quantile_cont(s_acctbal, 0.1) FROM supplier)), 6) AS wz FROM supplier")
def stat_winsorized_whole(spark, d):
    return rounded(dt(table(spark, d, "supplier"), set={"wz": "(stat/winsorize :s_acctbal 0.1)"}, select=["s_suppkey", "wz"]), wz=6)


@query(f"SELECT event_id, round(sum(v) OVER {UP}, 6) AS total, min(v) OVER {UP} AS low FROM {GAPPY}")
def win_scan_sums(spark, d):
    return rounded(over_users(gappy(spark, d), total="(win/scan + :v)", low="(win/scan min :v)"), total=6)


@query("SELECT c_custkey, least(product(1 + c_custkey % 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), 1e6)::BIGINT AS p FROM customer WHERE c_custkey <= 200")
def win_scan_whole_numbers(spark, d):
    """A running product of whole numbers is whole."""
    some = dt(table(spark, d, "customer"), where="(<= :c_custkey 200)").withColumn("f", F.col("c_custkey") % 2 + 1)
    out = dt(some, by=["c_nationkey"], within_order=["c_custkey"], set={"p": "(win/scan * :f)"}, select=["c_custkey", "p"])
    return out.withColumn("p", F.least("p", F.lit(1_000_000).cast("bigint")))


@query(f"""WITH l AS (SELECT event_id, v, lag(v) OVER {BY_USER} AS b FROM {GAPPY}), m AS (SELECT event_id, CASE WHEN b IS NOT NULL THEN v END AS v, CASE WHEN v IS NOT NULL THEN b END AS b FROM l)
           SELECT event_id, round(v + b, 9) AS plus, round(v * b, 6) AS times, CASE WHEN b <> 0 THEN round(v / b, 6) END AS quotient, CASE WHEN v IS NOT NULL THEN greatest(v, b) END AS top, CASE WHEN v IS NOT NULL THEN least(v, b) END AS low,
           v < b AS lt, v >= b AS ge, v <= b AS le, v = b AS eq FROM m""")
def win_prior_all(spark, d):
    new = {"plus": "+", "times": "*", "quotient": "/", "top": "max", "low": "min", "lt": "<", "ge": ">=", "le": "<=", "eq": "="}
    out = over_users(gappy(spark, d), **{k: f"(win/each-prior {o} :v)" for k, o in new.items()})
    out = out.withColumn("quotient", F.when(F.abs("quotient") != float("inf"), F.col("quotient")))
    return rounded(out, plus=9, times=6, quotient=6)


@query(f"""SELECT event_id, CASE WHEN count(v) OVER f > 2 THEN round(sqrt(var_pop(v) OVER f * count(v) OVER f / (count(v) OVER f - 2)), 6) END AS sd2 FROM {GAPPY} WINDOW f AS (PARTITION BY user_id ORDER BY ts ROWS 5 PRECEDING)""")
def win_deviation_two(spark, d):
    return rounded(over_users(gappy(spark, d), sd2="(win/mdev :v 6 {:ddof 2})"), sd2=6)


@query("SELECT event_id, round(value * 2, 6) AS twice FROM events WHERE value > 50")
def stream_elementwise(spark, d):
    return rounded(stream_dt(table(spark, d, "events"), where="(> :value 50)", set={"twice": "(* :value 2)"}).select("event_id", "twice"), twice=6)


# -- messages, displays

@query("""SELECT * FROM (VALUES ('unknown column', 'unknown-column'), ('window in a filter', 'win-outside-window'), ('set and agg', 'set-agg-conflict'), ('bad take', 'invalid-take'), ('cut alone', 'cut-standalone-not-supported'),
          ('bad key', 'invalid-grouping-by'), ('how', 'join-unknown-how'), ('no window', 'join-missing-window'), ('no aggregate', 'join-missing-agg'), ('tolerance', 'join-tolerance-invalid'), ('extension', 'unsupported-format'), ('index kind', 'invalid-index-kind'),
          ('direction', 'asof-unknown-direction'), ('grouping without set', 'grouping-requires-set'), ('other table', 'grouping-row-mismatch'), ('spread window', 'join-invalid-window')) t(what, code)""")
def error_codes(spark, d):
    ev, nation = table(spark, d, "events"), table(spark, d, "nation")
    g = prepare_grouping(nation, ["n_regionkey"])
    wrong = {
        "unknown column": lambda: dt(ev, where="(> :valeu 1)"), "window in a filter": lambda: dt(ev, where="(> (win/lag :value 1) 2)"), "set and agg": lambda: dt(ev, set={"a": ":value"}, agg={"n": N}),
        "bad take": lambda: dt(ev, take="x"), "cut alone": lambda: cut(1), "bad key": lambda: dt(ev, by=[3], agg={"n": N}), "how": lambda: join(ev, ev, on="user_id", how="cross"),
        "no window": lambda: join(ev, ev, on="event_id", how="window"), "no aggregate": lambda: join(ev, ev, on="event_id", how="window", window=[0, 1]), "tolerance": lambda: join(ev, ev, on="event_id", how="asof", tolerance=-1),
        "extension": lambda: read(spark, "x.nippy"), "index kind": lambda: index_by(ev, ["user_id"], "tree"), "direction": lambda: asof_search([1], 1, "up"),
        "grouping without set": lambda: dt(nation, grouping=g), "other table": lambda: dt(table(spark, d, "nation"), grouping=g, set={"a": ":n_name"}), "spread window": lambda: join(ev, ev, on="event_id", how="window", window=[0, 1], agg={"n": N}, spread=True),
    }
    codes = []
    for f in wrong.values():
        try:
            f()
            codes.append("none")
        except DtError as x:
            codes.append(x.code)
    return from_rows(spark, {"what": list(wrong), "code": codes}, "what string, code string")


@query("SELECT '(/ (sm :v) (ct :v))' AS text, 4 AS nodes, true AS table_shown, true AS kept, 'MOROCCO-ish' AS mapped")
def displays(spark, d):
    """Expressions as text and trees, tables as HTML, the last result, a guarded function."""
    n = e("(/ (sm :v) (ct :v))")
    nation = table(spark, d, "nation")
    kept = last() is nation if remember(nation) is not None else False
    shown = view_html(nation.limit(2)).count("<tr>") == 3
    ish = pass_nil(lambda r: r["n"] + "-ish", "n")
    tree = len({line.strip() for line in expr_tree(n).splitlines()})
    return from_rows(spark, {"text": [to_string(n)], "nodes": [tree], "table_shown": [shown], "kept": [kept], "mapped": [ish({"n": "MOROCCO"})]}, "text string, nodes int, table_shown boolean, kept boolean, mapped string")


@query("SELECT c_nationkey, (1 + (c_acctbal > q1)::INT + (c_acctbal > q2)::INT)::INT AS tercile, count(*) AS n FROM (SELECT *, quantile_cont(c_acctbal, 1.0/3) OVER w AS q1, quantile_cont(c_acctbal, 2.0/3) OVER w AS q2 FROM customer WINDOW w AS (PARTITION BY c_nationkey)) GROUP BY ALL")
def by_qtile_keys(spark, d):
    return dt(table(spark, d, "customer"), by=["c_nationkey", qtile("c_acctbal", 3)], agg={"n": N}).toDF("c_nationkey", "tercile", "n")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def chained_conditions(spark, d):
    return dt(dt(table(spark, d, "customer"), where=col("c_acctbal") > 5000), select=["c_custkey", "c_name"])
