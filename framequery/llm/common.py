"""Helpers shared by the corpus operators: the shared folder, cut lineage, hot-key joins, prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space as the contracts fix it (ASCII only), as a Java / RE2 character class body.
SPACE = r"\x20\x09-\x0D"
#: At most so many groups are called hot, so the table of hot groups has a proven bound and may be broadcast.
MAX_HOT = 1000
#: Bytes of rows in one Arrow batch: a worker holds a batch or two, and Spark as much outside its heap for each task.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only where that is unset and Spark runs in this machine
    alone (tests) a fresh temp folder takes its place; on a cluster it must be set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fq_ckpt_"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


_FOLDERS: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder, which goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/fq_{app}_{uuid.uuid4().hex}"
        atexit.register(_sweep, spark, _FOLDERS[app])
    return f"{_FOLDERS[app]}/{name}_{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  Spark may be gone already; then the folder stays for whoever owns it
        pass


def lean(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes; long texts would else make batches of hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read back. Survives lost executors. ``few``: for tables
    far smaller than the input, an eighth as many files as there are shuffle partitions."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if few:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fq_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_fq_path", None):
            drop_path(t.sparkSession, t._fq_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, wherever it lies."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shielded(docs: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1, ..., so that none clashes with an operator's own, and the new names of cols.
    ``out.toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [f"c{docs.columns.index(c)}" for c in cols]


def normal_text(text: Column | str) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACE}]+", " ")


def words(text: Column | str) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` as an array; null gives an empty array. Only the ends can be empty strings."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), "")


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to one row per key without sending a hot key's rows to one task.

    A key is hot when its ``size`` is over total / MAX_HOT: at most MAX_HOT keys can be, so their rows are
    broadcast; the rest meet in a merge join at every size, whose groups are small.
    """
    bar = max(1000, -(-total // MAX_HOT))
    hot = groups.where(F.col(size) > bar)
    cold = groups.where(F.col(size) <= bar)
    by_hot = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return by_hot.unionByName(rest.join(cold.hint("merge"), key, how), allowMissingColumns=True)


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` over the whole table in the given order, without one big window.

    The table is range-partitioned, summed within each partition, and shifted by the sums of the partitions
    before: only one row per partition meets in a single task. The range-partitioned rows are written first, so
    both passes see the same partitions even when tasks are run again.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    total = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    base = total.withColumn("__base", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "__base")
    within = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return dealt.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(base), "__part").withColumn(out, F.col("__base") + F.col("__in")).drop("__part", "__in", "__base")
