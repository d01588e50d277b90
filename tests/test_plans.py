"""Catalogue queries against their SQL on small tables of rare values."""

import duckdb
import pytest

from framequery import DtError, read_pieces, read_seq
from framequery.plans import catalogue


@pytest.fixture
def events(spark, tmp_path):
    """Writes (type, time, value) as the events of one user and gives the folder."""

    def make(rows, kind="timestamp_ntz"):
        t = spark.createDataFrame([(i, t, 1, k, v) for i, (k, t, v) in enumerate(rows)], "event_id bigint, ts string, user_id bigint, event_type string, value double")
        t.withColumn("ts", t.ts.cast(kind)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        return tmp_path

    return make


def both(spark, name, folder):
    """The rows of a query and those of its SQL."""
    df = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    rel = con.sql(catalogue.ORACLES[name])
    return sorted(map(tuple, df.select(*rel.columns).collect()), key=str), sorted(rel.fetchall(), key=str)


EDGES = ["2024-01-01 00:59:59.999499", "2024-01-01 00:59:59.999500", "2024-01-01 00:59:59.999999", "2024-01-01 01:00:00", "2024-01-01 01:00:00.000500"]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_bars_by_the_hour_take_times_to_the_nearest_millisecond(spark, events, kind):
    got, want = both(spark, "by_xbar_time", events([("view", t, float(i)) for i, t in enumerate(EDGES)], kind))
    assert got == want and [r[2] for r in got] == [1, 4]


def test_bars_of_rows_take_times_to_the_nearest_millisecond(spark, events):
    got, want = both(spark, "set_xbar", events([("view", t, 1.0) for t in EDGES]))
    first = 28401175
    assert got == want == [(0, first), *((i, first + 5) for i in range(1, 5))]


def test_tolerance_takes_times_to_the_nearest_millisecond(spark, events):
    """Two hours and 0.6 ms are 1 ms too many, two hours and 0.4 ms are not."""
    seen = [("view", "2024-01-01 08:00:00", 1.0), ("purchase", "2024-01-01 10:00:00.000600", 2.0), ("view", "2024-01-02 08:00:00", 3.0), ("purchase", "2024-01-02 10:00:00.000400", 4.0)]
    got, want = both(spark, "join_asof_time_index", events(seen))
    assert got == want and [r[4] for r in got] == [None, 2]


def test_pieces_of_lines_take_one_job_together(spark, tmp_path):
    """However many pieces there are: 61 here, in fewer jobs."""
    spark.range(6050).selectExpr("id AS c_custkey", "concat('n', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sparkContext.setJobGroup("pieces", "pieces")
    try:
        got = catalogue.QUERIES["file_pieces_lines"](spark, str(tmp_path)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in got] == [(6050, 6050 * 6049 // 2, 61)]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pieces")) < 30


def test_pieces_together_are_those_in_turn(spark, tmp_path):
    """Also where the file is read in many splits and has blank lines."""
    path = f"{tmp_path}/t.jsonl"
    with open(path, "w") as f:
        for i in range(1000):
            f.write(f'{{"k": {i}, "s": "{"x" * (i % 50)}"}}\n' + "  \n" * (i % 3 == 0))
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in held:
            spark.conf.set(c, "1000")
        turn = [[r["k"] for r in p.collect()] for p in read_seq(spark, path, batch_size=70, column_allowlist=["k"])]
        together = read_pieces(spark, path, batch_size=70, column_allowlist=["k"])
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert together.columns == ["k", "piece"]
    pieces = {}
    for r in together.collect():
        pieces.setdefault(r["piece"], []).append(r["k"])
    assert turn == [list(range(i, min(i + 70, 1000))) for i in range(0, 1000, 70)] == [sorted(pieces[i]) for i in range(len(pieces))]
    with pytest.raises(DtError, match="duplicate-column"):
        read_pieces(spark, path, piece="k")
