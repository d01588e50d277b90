"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once and stores one failure bit a rule beside the measurements. Policies are named,
versioned sets of bits applied later without reading a text again, and ``ablations`` counts, from the counts per
mask alone (at most 2 ** rules rows), what each rule rejects by itself and what dropping it would let in.

Defined cases: null text has no words (it fails the length rule); a text of under eight words has no window; very
long texts are handled a row at a time with arrays linear in their words; repeated rows give repeated rows; an empty
table gives no rows; only the id and text columns are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.common import SPACE, words

#: rule -> failing condition over the measurements, as SQL that Spark and DuckDB read alike. The place is the bit.
RULES = {
    "too_short": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length_low": "word_chars < 2 * n_words",
    "word_length_high": "word_chars > 15 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "exclamations": "2 * n_exclaims > n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("too_short", "repeated_windows")
#: version -> the rules that reject a document.
POLICIES = {
    "v1": BASE + ("symbols", "repeated_lines", "word_length_low", "word_length_high"),
    "v2": tuple(RULES),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")
WINDOW = 8


def policy_mask(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def _pairs(col: str, step: int) -> Column:
    """At i, the hash of the grams at i and i + step: grams twice as long. Each array is walked once."""
    return F.zip_with(col, F.slice(F.col(col), step + 1, F.size(col)), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and MEASURES. Windows are compared by 64-bit hashes within one text only."""
    text = F.col("__text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).select("*", words("__text").alias("__w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("__lines"))
    df = df.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("n_exclaims"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h1"),
    )
    for step in (1, 2, 4):
        df = df.withColumn(f"__h{2 * step}", _pairs(f"__h{step}", step)).drop(f"__h{step}")
    df = df.withColumn("__g", F.when(F.col("n_words") >= WINDOW, F.slice("__h8", F.lit(1), F.size("__h8") - (WINDOW - 1)))).drop("__h8")
    # only a text with an equal pair of windows is sorted
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("__g")
    near = lambda x, i: x["h"].eqNullSafe(F.get(F.col("__s"), i - 1)["h"]) | x["h"].eqNullSafe(F.get(F.col("__s"), i + 1)["h"])
    df = df.withColumn("__p", F.sort_array(F.transform(F.filter("__s", near), lambda x: x["p"]))).drop("__s")
    gaps = F.zip_with("__p", F.slice(F.col("__p"), 2, F.size("__p")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).select("doc_id", *MEASURES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, MEASURES and ``failed``, the bits of the rules that the document fails."""
    bits = None
    for name, rule in RULES.items():
        bit = F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, id_col, text_col).withColumn("failed", bits)


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``rejected_by`` (the policy's bits that failed) and ``kept``."""
    by = F.col("failed").bitwiseAND(F.lit(policy_mask(policy)))
    return led.withColumn("rejected_by", by).withColumn("kept", by == 0)


def mask_counts(led: DataFrame) -> DataFrame:
    """How many documents have each mask: combined before the shuffle, at most 2 ** rules rows."""
    return led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone (gained if it is dropped), and kept without it."""
    counts, mask, parts = mask_counts(led), policy_mask(policy), []
    for r in POLICIES[policy]:
        parts.append(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).alias("bit")))
    each = counts.select("failed", "n", F.explode(F.array(*parts)).alias("r"))
    inside = F.col("failed").bitwiseAND(F.lit(mask))
    bit, total = F.col("r.bit"), lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule")).agg(
        total(F.col("failed").bitwiseAND(bit) != 0).alias("n_failed"),
        total(inside == bit).alias("n_gained_without"),
        total(inside.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )


def with_verdicts(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    base = sum(BITS[r] for r in BASE)
    df = apply_policy(led, policy).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(base)) != 0)
    return df.withColumn("kept", ~F.col("base_failed") & F.col("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = with_verdicts(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "rejected_by")


def _sql() -> str:
    mask = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES.items())
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
    s AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    c AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM s) GROUP BY doc_id),
    m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
                 length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaims
          FROM d LEFT JOIN c USING (doc_id)),
    f AS (SELECT *, ({mask})::INTEGER AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {sum(BITS[r] for r in BASE)}) <> 0 AS base_failed,
           (failed & {policy_mask(CURRENT) | sum(BITS[r] for r in BASE)}) = 0 AS kept, failed, (failed & {policy_mask(CURRENT)})::INTEGER AS rejected_by FROM f"""


SQL = {"op3_quality_rules": _sql()}
QUERIES = {"op3_quality_rules": op3_quality_rules}
