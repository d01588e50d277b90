"""The pipeline against its stages done by hand."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import folder, table
from test_near_dedup import brute

import corpus_pipeline
from framequery.llm import line_dedup, mixing, toxicity

CLASHING = ["__lines", "__gone", "__id", "__row", "__copy", "__n_lines", "rep", "key", "size", "copies"]


def test_run(spark, tmp_path):
    import sentencepiece

    found = folder(spark, str(tmp_path), 9, 90)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.op4_toxicity(spark, str(tmp_path)).collect()}
    left = docs.where(docs["doc_id"].isin([d for d in found if not scores[d]]))
    lined = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(left).collect()}
    comp = brute(lined, 5)
    kept = {d for d in lined if comp[d][1] == d}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    stayed = spark.createDataFrame([(d, lined[d], "en", source[d], 0) for d in sorted(kept)], docs.schema)
    copies = Counter(r["doc_id"] for r in mixing.mix_documents(stayed).collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for d, n in copies.items():
        ids = sp.encode(lined[d] or "")
        want[d, len(ids), zlib.crc32(np.asarray(ids, "<u2").tobytes())] += n
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(kept) < len(lined)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, tmp_path, stage):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, further columns with an operator's
    own names: rows that nothing speaks against stay, with all their columns."""
    folder(spark, str(tmp_path), 9, 40)
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` int" for c in CLASHING)
    extra = tuple(range(len(CLASHING)))
    rows = [(None, "no id at all", None, None, None, *extra), (7001, None, "en", "web", 0, *extra), (7002, "", "en", None, 0, *extra), (7003, "good words\nin lines " * 9000, "en", "web", 1, *extra)]
    rows += [(7004, "the same row twice", "en", "web", 1, *extra)] * 2
    f = dict(corpus_pipeline.STAGES)[stage]
    docs = table(spark, rows, schema)
    out = f(spark, docs, str(tmp_path)).collect()
    if stage == "sentencepiece":
        assert len(out) == len(rows) and {r["n_tokens"] for r in out if r["doc_id"] in (7001, 7002)} == {0}
    elif stage == "mixing":
        assert {r["doc_id"] for r in out} <= {r[0] for r in rows} and all(tuple(r)[5:] == extra for r in out)
    else:
        assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(r[0]) for r in rows) and all(tuple(r)[5:] == extra for r in out)
    assert f(spark, table(spark, [], schema), str(tmp_path)).count() == 0


def test_near_copies_tied_by_one_link(spark, tmp_path):
    """Pairs of families of 100 texts, tied by one link of exactly 0.8 in five-word shingles among 9,999 pairs below: one
    document of each pair stays."""
    rows = []
    for f in range(4):
        for side in range(2):
            for k in range(100):
                words = [f"c{f}_{i}" for i in range(164)] + [f"p{f}_{side}_{i}" for i in range(20)] + [f"u{len(rows)}"] * (k != 50)
                rows.append((len(rows), " ".join(words)))
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, rows), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 200, 400, 600]
