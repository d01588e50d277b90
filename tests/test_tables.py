"""Reshaping, tidying, look-ups, files, display, concise names, streams, and the driver's entry module."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from helpers import column, make

from framequery import DtError, cast, clean_column_names, coerce_columns, concise, describe, display, drop_constant_columns, dt, duplicate_rows, e, from_rows, index_by, is_index, lookup, lookup_indices, mark_duplicates, melt, read, read_seq, write
from framequery.plans import catalogue
from framequery.sources.files import extension
from framequery.streaming.bars import stream_dt, time_bars

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def code(f, *a, **k):
    with pytest.raises(DtError) as x:
        f(*a, **k)
    return x.value.code


def test_reshape(spark):
    wide = make(spark, species=["Adelie", "Gentoo"], year=[2007, 2008], mass=[3750, 5000], flipper=[181, 210])
    long = melt(wide, id=["species", "year"])
    assert long.columns == ["species", "year", "value", "variable"] and sorted(column(long, "value")) == [181, 210, 3750, 5000]
    assert melt(wide, id=["species"], measure=[]).columns == ["species", "variable", "value"]
    s = make(spark, id=[2, 1, 1, 1], metric=["b", "a", "b", "a"], val=[30, 10, 20, 99])
    out = cast(s, id="id", from_="metric", value="val", fill=0)
    assert out.columns == ["id", "b", "a"] and [tuple(r) for r in out.collect()] == [(2, 30, 0), (1, 20, 10)]
    assert [tuple(r) for r in cast(s, id=["id"], from_="metric", value="val", agg="sm").collect()] == [(2, 30.0, None), (1, 20.0, 109.0)]
    assert [tuple(r) for r in cast(s, id=["id"], from_="metric", value="val", agg=lambda v: float(len(v))).collect()] == [(2, 1.0, None), (1, 1.0, 2.0)]
    missing = make(spark, id=[1, 1], metric=["a", "a"], val=[None, 5.0])
    assert cast(missing, id="id", from_="metric", value="val", fill=7.0).first() == (1, None)  # the first row, though missing
    assert code(cast, s) == "cast-missing-id" and code(cast, s, id="id") == "cast-missing-from" and code(cast, s, id="id", from_="metric") == "cast-missing-value"


def test_tidy(spark):
    t = make(spark, name=["a", "b", None], age=[25, 30, 35], score=[1.0, None, float("nan")])
    got = {r["column"]: r for r in describe(t).collect()}
    assert (got["age"]["n"], got["age"]["mean"], got["age"]["min"], got["age"]["max"], got["age"]["median"]) == (3, 30.0, 25.0, 35.0, 30.0)
    assert (got["name"]["n"], got["name"]["n-missing"], got["name"]["mean"]) == (2, 1, None) and (got["score"]["n"], got["score"]["n-missing"], got["score"]["max"]) == (1, 2, 1.0)
    assert clean_column_names(make(spark, **{"Some Ugly Name!": [1], "Revenue ($)": [1], "Größe_m": [1]})).columns == ["some-ugly-name", "revenue", "größe-m"]
    d = make(spark, id=[1, 2, 2, 3, None, None], val=["a", "b", "b", "c", "d", "d"])
    assert column(mark_duplicates(d), "duplicate?").count(True) == 4 and column(duplicate_rows(d), "id") == [2, 2, None, None]
    c = make(spark, "a bigint, b bigint, c string, n string, m string", a=[1, 1, 1], b=[1, 2, 1], c=["x"] * 3, n=[None] * 3, m=["x", None, "x"])
    assert drop_constant_columns(c).columns == ["b", "m"] and drop_constant_columns(c.limit(1)).columns == c.columns
    assert column(coerce_columns(make(spark, x=["1", "z"]), {"x": "int"}), "x") == [1, None]


def test_index(spark):
    p = make(spark, tic=["AAPL", "MSFT", "AAPL", None], year=[2021, 2021, 2020, 2021], sales=[100, 90, 80, 70])
    ix = index_by(p, "tic")
    assert column(lookup(ix, "AAPL"), "sales") == [100, 80] and column(lookup(ix, "IBM"), "sales") == [] and column(lookup(ix, None), "sales") == [70] and column(lookup_indices(ix, "AAPL"), "row") == [0, 2]
    two = index_by(p, ["tic", "year"])
    assert column(lookup(two, ("AAPL", 2020)), "sales") == [80] and is_index(two) and not is_index(p)
    assert code(lookup, two, "AAPL") == "invalid-lookup-key" and code(lookup, p, 1) == "not-an-index" and code(lookup, index_by(p, ["tic", "year"], ":asof"), ("A", 1)) == "asof-index-not-lookable"
    assert code(index_by, p, []) == "invalid-key-cols" and code(index_by, p, "tic", "tree") == "invalid-index-kind" and code(index_by, p, "tick") == "unknown-column"
    ix.unpersist()


@pytest.mark.parametrize("name", ["t.csv", "t.csv.gz", "t.tsv", "t.json", "t.json.gz", "t.jsonl", "t.ndjson.gz", "t.parquet", "t.arrow", "t.feather"])
def test_files(spark, tmp_path, name):
    t = from_rows(spark, {"species": ["Adelie", "Gentoo", None], "mass": [3750, 5000, 1], "year": [2007, 2008, 2009]}, "species string, mass bigint, year bigint")
    path = f"{tmp_path}/{name}"
    write(t, path)
    assert Path(path).is_file()
    back = read(spark, path)
    key = lambda r: r[1]
    assert sorted(map(tuple, back.select("species", "mass", "year").collect()), key=key) == sorted(map(tuple, t.collect()), key=key)
    assert read(spark, path, column_allowlist=["mass"]).columns == ["mass"] and set(read(spark, path, column_blocklist="mass").columns) == {"species", "year"}
    assert "MASS" in read(spark, path, key_fn=str.upper).columns
    if name in ("t.parquet", "t.jsonl", "t.json"):
        assert sum(p.count() for p in read_seq(spark, path, batch_size=2)) == 3


def test_file_errors(spark, tmp_path):
    t = make(spark, a=[1])
    assert extension("x.CSV.gz") == "csv" and extension("x") is None and code(read, spark, "x.nippy") == "unsupported-format" and code(write, t, f"{tmp_path}/x.xls") == "unsupported-format"
    assert code(lambda: list(read_seq(spark, "x.csv"))) == "unsupported-format" and code(write, t, f"{tmp_path}/x.xlsx") == "missing-dep"
    write(t, f"{tmp_path}/parts.parquet", single=False)
    assert Path(f"{tmp_path}/parts.parquet").is_dir() and read(spark, f"{tmp_path}/parts.parquet").count() == 1


def test_display_and_concise(spark):
    t = make(spark, a=[1, 2], b=["<x>", None])
    assert "&lt;x&gt;" in display.table_html(t) and "more rows follow" in display.table_html(t, 1) and "nil" in display.view_html(t)
    assert "(&gt; :a 1)" in display.view_html(e("(> :a 1)")) and display.expr_tree(e("(> :a 1)")).splitlines() == ["Op >", "  Col a", "  Lit 1"]
    assert display.remember(t) is display.last() is t
    out = dt(make(spark, g=["a", "a"], x=[1.0, None]), by=["g"], agg={"m": concise.mn("x"), "n": concise.ct("x"), "q": concise.qnt("x", 0.5)}).first()
    assert out == ("a", 1.0, 2, 1.0)


def test_stream(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 'a' AS k, 1D AS v UNION ALL SELECT timestamp'2024-01-01 00:00:50', 'a', 3D UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'b', -5D").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    kept = stream_dt(rows, where="(> :v 0)", set={"w": "(* :v 2)"})
    bars = time_bars(kept, "ts", 1, "minutes", {"n": "N", "m": "(mn :w)"}, by=["k"], late="10 minutes")
    q = bars.writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["k"], r["n"], r["m"]) for r in spark.table("bars").collect()] == [("a", 2, 4.0)]
    assert code(stream_dt, rows, set={"x": "(win/lag :v 1)"}) == "win-outside-window" and code(time_bars, rows, "ts", 1, "minutes", {"q": "(md :v)"}) == "unknown-op"


def value(v):
    if v is None or v != v:
        return "nil"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df, rel = catalogue.QUERIES[name](spark, str(DATA)), con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(value(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(value(r[i]) for i in at) for r in rel.fetchall())


def test_entry_without_the_corpus_operators(tmp_path):
    """The entry module works when that folder and the pipeline's file are gone."""
    shutil.copytree(ROOT / "framequery", tmp_path / "framequery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, 'agg_basic' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False", "True", "True"], said.stderr
