"""Line dedup by content-defined line chunks (DataFrame functions only), by two rules of what a chunk is.

``line_dedup`` (the pipeline's stage): each line and the next are a chunk, so chunks overlap, depend on their own lines
only, and no line is exempt. A chunk whose bytes occur again, anywhere in the corpus, goes from all places but the
first (smallest doc_id, then place in the document), and a line goes if a chunk it is in goes: of any run of two lines
or more that stands in an earlier document, nothing is left. A single line that occurs again between other lines stays.

``chunk_dedup`` (``op5_line_dedup``, whose SQL fixes this rule): a rolling hash over the last two line hashes ends a
chunk wherever it is divisible by ``every``; chunks of two lines or more that occur again are removed, single-line
chunks always stay. The first chunk in a passage starts after a hit and the last one ends at a hit, so most short
passages amid other text are missed.

Under both, candidates come from a repeat filter over 64-bit chunk hashes (a broadcast of fixed greatest size), so the
text of chunks that occur once is never shuffled; equality is decided on the bytes. A second such filter keeps
documents that lose nothing out of the last shuffle.

Defined cases: null text stays null and has no line; an empty text is one empty line; a text of one line stays; rows
with a null id are left as they are; rows with the same id are one document, and lose the same chunks; an empty table
gives no rows; only the id and text columns are looked at, all others are carried along under any
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.bloom import MAX_BITS, filter_bits, tested
from framequery.llm.common import hot_join, shielded, written

EVERY = 3


def chunked(docs: DataFrame, every: int = EVERY, text_col: str = "text") -> DataFrame:
    """Adds __chunks: array of (k, n, text) in the order of the document."""
    df = docs.withColumn("__lines", F.split(text_col, "\n"))
    df = df.withColumn("__h", F.transform("__lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")))
    rolled = F.zip_with("__h", F.slice(F.col("__h"), 2, F.size("__h")), lambda a, b: (a * 31 + b) % every == 0)
    # 0-based first lines of the chunks: 0, and each line after one where the rolling hash hits
    hit = F.filter(F.transform(rolled, lambda x, i: F.when(x, i + 2)), lambda x: x.isNotNull())
    df = df.withColumn("__starts", F.filter(F.concat(F.array(F.lit(0)), hit), lambda x: x < F.size("__lines")))
    ends = F.concat(F.slice(F.col("__starts"), 2, F.size("__starts")), F.array(F.size("__lines")))
    df = df.withColumn("__spans", F.zip_with("__starts", ends, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))))
    piece = lambda s, i: F.struct(i.alias("k"), s["n"].alias("n"), F.array_join(F.slice(F.col("__lines"), s["at"] + 1, s["n"]), "\n").alias("text"))
    return df.withColumn("__chunks", F.transform("__spans", piece)).withColumn("__n_lines", F.size("__lines")).drop("__h", "__starts", "__spans", "__lines")


def _exploded(docs: DataFrame, every: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k, text) of the chunks of two lines or more."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = chunked(own, every).select("doc_id", F.explode(F.filter("__chunks", lambda c: c["n"] > 1)).alias("c"))
    return rows.select("doc_id", F.col("c.k").alias("k"), F.col("c.text").alias("text"))


def _pairs(lines: Column) -> Column:
    """(k, text) of each line and the next; k is the 0-based place of the first."""
    return F.zip_with(F.transform(lines, lambda x, i: F.struct(i.alias("k"), x.alias("x"))), F.slice(lines, 2, F.size(lines)), lambda a, b: F.struct(a["k"].alias("k"), F.concat_ws("\n", a["x"], b).alias("text")))


def _exploded_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k, text) of the chunks of two lines."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.split(text_col, "\n").alias("lines")).where(F.size("lines") > 1)
    # the last line has no next one
    rows = own.select("doc_id", F.explode(F.slice(_pairs(F.col("lines")), 1, F.size("lines") - 1)).alias("c"))
    return rows.select("doc_id", F.col("c.k").alias("k"), F.col("c.text").alias("text"))


def repeated_chunks(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, k, h): of the chunks (doc_id, k, text) those to remove, one row each."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    hashes = written(rows.select("h"), "hashes")  # 8 bytes a chunk
    total = hashes.count()
    maybe = tested(rows, "h", hashes, filter_bits(total, max_bits), at_least=2)
    seen = written(maybe.where("maybe").drop("maybe"), "chunks")  # the chunks that may occur again, with their bytes
    place = F.struct("doc_id", "k")
    groups = seen.groupBy("h").agg(F.min(place).alias("first"), F.min_by("text", place).alias("first_text"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = hot_join(seen, groups, "h", "size", total)
    late = F.struct("doc_id", "k") > F.col("first")
    decided = met.withColumn("same", F.col("text") == F.col("first_text")).where(~F.col("same") | late)
    decided = written(decided.select("doc_id", "k", "h", "same", F.when(~F.col("same"), F.col("text")).alias("text")), "repeats")
    # chunks that only share the hash with the first: grouped by their bytes
    other = decided.where(~F.col("same")).drop("same")
    firsts = other.groupBy("text").agg(F.min(place).alias("first"))
    return decided.where("same").select("doc_id", "k", "h").unionByName(other.join(firsts, "text").where(late).select("doc_id", "k", "h"))


def _met(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs that lose chunks, with __gone, and the others with their counts; gone is (__id, __gone)."""
    gone = written(gone, "gone")
    # only documents that may lose a chunk are shuffled to meet the list of their chunks
    split = tested(docs.withColumn("__id", F.col(id_col)), "__id", gone, filter_bits(gone.count()), out="__maybe")
    df = split.where("__maybe").drop("__maybe").join(gone.hint("merge"), "__id", "left").drop("__id")
    clean = df.where(F.col("__gone").isNull()).drop("__gone").unionByName(split.where(~F.col("__maybe")).drop("__maybe", "__id"))
    clean = clean.withColumn("__n_lines", F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long")).withColumn("__n_removed", F.lit(0).cast("long"))
    return df.where(F.col("__gone").isNotNull()), clean


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines of repeated pairs of lines, and __n_lines, __n_removed added."""
    names = [*docs.columns, "__n_lines", "__n_removed"]
    docs, (id_col, text_col) = shielded(docs, id_col, text_col)
    # place and hash as one string: sets of strings are hashed, sets of structs are compared one by one
    key = lambda k, h: F.concat_ws(":", k.cast("string"), h.cast("string"))
    gone = repeated_chunks(_exploded_pairs(docs, id_col, text_col)).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(key(F.col("k"), F.col("h"))).alias("__gone"))
    hit, clean = _met(docs, gone, id_col, text_col)
    cut = hit.withColumn("__lines", F.split(text_col, "\n"))
    own = F.transform(F.slice(_pairs(F.col("__lines")), 1, F.greatest(F.size("__lines") - 1, F.lit(0))), lambda c: key(c["k"], F.xxhash64(c["text"])))
    at = F.transform(F.array_intersect(own, F.col("__gone")), lambda x: F.substring_index(x, ":", 1).cast("int"))
    cut = cut.withColumn("__at", F.flatten(F.transform(at, lambda i: F.array(i, i + 1))))
    cut = cut.withColumn("__left", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__at")))
    cut = cut.withColumn("__n_lines", F.coalesce(F.size("__lines"), F.lit(0)).cast("long")).withColumn("__n_removed", F.coalesce(F.col("__n_lines") - F.size("__left"), F.lit(0)).cast("long"))
    cut = cut.withColumn(text_col, F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n"))
    cols = [*docs.columns, "__n_lines", "__n_removed"]
    return cut.select(*cols).unionByName(clean.select(*cols)).toDF(*names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line_dedup`` with the columns of docs alone, whatever their names."""
    named, (own_id, own_text) = shielded(docs, id_col, text_col)
    return line_dedup(named, own_id, own_text).select(*named.columns).toDF(*docs.columns)


def chunk_dedup(docs: DataFrame, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated chunks of the rolling hash taken out of the text, and __n_lines, __n_removed added."""
    names = [*docs.columns, "__n_lines", "__n_removed"]
    docs, (id_col, text_col) = shielded(docs, id_col, text_col)
    gone = repeated_chunks(_exploded(docs, every, id_col, text_col)).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("k", "h")).alias("__gone"))
    hit, clean = _met(docs, gone, id_col, text_col)
    cut = chunked(hit, every, text_col)
    left = F.filter("__chunks", lambda c: ~F.array_contains(F.col("__gone"), F.struct(c["k"].alias("k"), F.xxhash64(c["text"]).alias("h"))))
    cut = cut.withColumn("__left", left)
    cut = cut.withColumn("__n_removed", (F.col("__n_lines") - F.aggregate("__left", F.lit(0), lambda a, c: a + c["n"])).cast("long")).withColumn(text_col, F.array_join(F.transform("__left", lambda c: c["text"]), "\n"))
    cut = cut.withColumn("__n_lines", F.col("__n_lines").cast("long"))
    cols = [*docs.columns, "__n_lines", "__n_removed"]
    return cut.select(*cols).unionByName(clean.select(*cols)).toDF(*names)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = chunk_dedup(docs)
    return df.select("doc_id", F.when(F.col("text").isNull() & (F.col("__n_removed") == 0), 0).otherwise(F.col("__n_lines")).cast("long").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = {
    "op5_line_dedup": f"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
    h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
    r AS (SELECT *, coalesce((lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h) % {EVERY} = 0, false) AS ends FROM h),
    k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
    c AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM k GROUP BY ALL),
    m AS (SELECT *, CASE WHEN n > 1 THEN row_number() OVER (PARTITION BY n > 1, t ORDER BY doc_id, k) > 1 ELSE false END AS gone FROM c)
    SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
           sha256(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
    FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id"""
}
QUERIES = {"op5_line_dedup": op5_line_dedup}
