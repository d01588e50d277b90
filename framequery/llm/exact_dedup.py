"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Pass 1 reads each text once, keeps its SHA-256 and sets, for two probes, the bits that at least two rows hit.
Pass 2 tests every row against those bit maps (a broadcast of fixed greatest size): a row whose bits were hit only
once is certainly unique and passes straight through; only the others are shuffled, as 40-byte digests, and grouped.

Defined cases: null text counts as empty; a null id never is the one that stays unless its group has no other id;
rows with the same id and text are one document and share ``kept``; an empty table gives no rows; other columns of
the input are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.bloom import MAX_BITS, filter_bits, tested
from framequery.llm.common import hot_join, normal_text, shielded, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normal_text(text_col), 256)).alias("sha")), "digests")
    n = digests.count()
    marked = tested(digests, "sha", digests, filter_bits(n, max_bits), at_least=2, out="again")
    single = marked.where(~F.col("again")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = marked.where("again").select("doc_id", "sha")
    groups = suspects.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = hot_join(suspects, groups, "sha", "group_size", n).select("doc_id", "sha", "keep_id", "group_size")
    return single.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns, under any names."""
    names = docs.columns
    docs, (id_col, text_col) = shielded(docs, id_col, text_col)
    keep = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__id"]), "left_semi").toDF(*names)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op2_exact_dedup": r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)"""
}
QUERIES = {"op2_exact_dedup": op2_exact_dedup}
