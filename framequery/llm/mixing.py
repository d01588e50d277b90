"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Sources share the corpus by weight; a source's target stops at ``most`` times its own size and the excess is shared
again (water filling, in closed form over the sources). A source at rate r = target / size gives each document r
expected copies; the prefix sums of these over the source's documents, shifted by one random offset, cross some
integers, and a document is emitted once for each integer that it crosses. Documents are taken in the order of their
size, so by partial summation the words taken miss the target by less than about one longest document.

The positions are prefix sums over range partitions: a source that holds a third of all rows is spread over many
tasks. Only the table of sources (one row each) meets in a single task.

Defined cases: null text has size 0; null sources are one source, the last; a source without words has target 0; ties
are broken by doc_id, so reruns agree; repeated rows are sampled each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framequery.llm.common import prefix_sums, shielded, words, written

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: source, n_docs, source_size, weight, target, first (its documents before it, nulls first)."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("first", F.coalesce(F.sum("n_docs").over(W.orderBy(F.col("source").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    every = W.partitionBy()
    before = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("__level", left.cast("double") / share).withColumn("__level", F.max("__level").over(every))
    cap = (most * F.col("source_size")).cast("double")
    return s.withColumn("target", F.least(cap, F.col("__level") * F.col("weight"))).drop("__level")


def copies(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and copies to a written table of (doc_id, source, size, ...)."""
    placed = prefix_sums(sizes.withColumn("__one", F.lit(1).cast("long")), ["source", "size", "doc_id"], "__one", "__at").drop("__one")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    t = written(targets(sizes, weights, most).withColumn("__u", offset), "sources").withColumnRenamed("source", "__source")
    # one row a source: rows are many times the sources, so the optimizer broadcasts the sources while they are small
    df = placed.join(t, F.col("source").eqNullSafe(F.col("__source")))
    k = (F.col("__at") - F.col("first")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("__u") + rate * (k + 1)) - F.floor(F.col("__u") + rate * k)
    return df.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).drop("__at", "__source", "first", "weight", "n_docs", "__u")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: each row of docs as many times as it is copied, all columns."""
    names = docs.columns
    docs, (id_col, text_col, source_col) = shielded(docs, id_col, text_col, source_col)
    kept = written(docs.withColumn("__row", F.monotonically_increasing_id()), "mix")
    sizes = written(kept.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(text_col)).cast("long").alias("size"), "__row"), "sizes")
    n = copies(sizes, **kw).where("copies > 0").select("__row", "copies")
    return kept.join(n, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns).toDF(*names)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = written(docs.select("doc_id", "source", F.size(words("text")).cast("long").alias("size")), "sizes")
    return copies(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = {
    "op10_source_mixing": rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
    l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lvl FROM w
          WINDOW b AS (ORDER BY source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, max(lvl) OVER () * weight::DOUBLE) AS target,
                 ('0x' || substr(md5('{SEED}:' || coalesce('s:' || source, 'null')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
    p AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS r,
                 (row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1)::DOUBLE AS k
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, least((floor(u + r * (k + 1)) - floor(u + r * k))::BIGINT, 3) AS copies FROM p)
    SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c"""
}
QUERIES = {"op10_source_mixing": op10_source_mixing}
