"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

toxicity      drops the documents that the machine predicts toxic (learned from ``labels``)
line_dedup    takes runs of two lines or more that stand earlier in the corpus out of the texts; documents stay
near_dedup    keeps one document of each group of near copies (five-word shingles, similarity 0.8)
mixing        repeats or leaves out documents so that sources come near their target shares
sentencepiece encodes each text and decodes it again; its rows are the result

All stages but the last return the columns of ``documents``. Every stage's result is written as Parquet in the shared
folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm import line_dedup as lines
from framequery.llm import mixing, near_dedup, pieces, toxicity
from framequery.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic. Null ids and texts are scored like any other (a text without words is
    clean unless most labels are toxic); repeated rows stay or go together; an empty table stays empty; all columns are
    carried along. The machine is fitted on labelled rows of ``documents`` (a bounded sample, see its module)."""
    machine = toxicity.fitted(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, machine)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand in a run of two or more elsewhere before. Every row stays, also with an empty text;
    null texts stay null; rows with a null id keep their text."""
    return lines.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id. Texts without words and rows with a null id stay; rows
    with the same id stay or go together; of a table without rows nothing."""
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it (0 to 3). Null sources are one source, the last; null texts have size 0;
    ties are broken by id, and rows equal in source, size and id may change places."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: doc_id, n_tokens, ids_crc32, decoded_sha256, n_decoded_bytes, scanned. Null texts count as
    empty; repeated rows are encoded each."""
    import public_tokenizers

    return pieces.digests(pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: The learned and tokenizing stages can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage_{name}")
    return docs
