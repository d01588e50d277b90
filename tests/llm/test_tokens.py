"""Token files and SentencePiece against the libraries."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import folder, table, texts

from framequery.llm import pieces, token_files
from framequery.llm.token_files import op8_token_files, read_files, write_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "<|endoftext|> end", "don't we'll 12ab3 x_y--z", "ΑΣ ΟΔΟΣ", "É é İ ß ﬁ", "a" * 300, "漢字かな交じり", "\U0001f600\U0001f468‍\U0001f469", "tab\tand\x0bother\x00control\x1c signs ", "CamelCase UPPER", "نص عربي", "l'été d'Œuvre", "x y", "'S 'll n't 'tis"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_token_query(spark, tmp_path, library):
    found = folder(spark, str(tmp_path), 6, 80)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op8_token_files(spark, str(tmp_path)).collect()}
    at = 0
    for d in sorted(found):
        ids = [*library.encode(found[d] or "", add_special_tokens=False).ids, 1]
        assert got[d] == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())), d
        at += len(ids)


def test_odd_texts(library):
    w = token_files.WordIds(WORDS, "<u2")
    rng = random.Random(3)
    made = ["".join(rng.choice("aA'é1 -_Σß́漢.,#") for _ in range(rng.randrange(60))) for _ in range(400)]
    for t, data in zip(ODD + made, w.encode([t.encode() for t in ODD + made]), strict=True):
        assert np.frombuffer(data, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_cases(spark, tmp_path):
    df = table(spark, [(None, "null id", 1), (3, None, 2), (3, "twice", 3), (-5, "", 4)], "doc_id long, text string, part int")
    manifest = write_files(df, f"{tmp_path}/t", WORDS)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in read_files(manifest).collect()))
    assert [x[:2] for x in got] == [(False, 0), (True, -5), (True, 3), (True, 3)] and [x[3] for x in got] == [3, 1, *[x[3] for x in got[2:]]]
    assert got[0][2] == 0 and got[1][2] == 3 and sum(x[3] for x in got) == manifest.selectExpr("sum(n_tokens)").first()[0]
    assert read_files(write_files(table(spark, []), f"{tmp_path}/e", WORDS)).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECES)


def test_pieces_are_the_librarys(model):
    for t in [x for x in texts(8, 80) + ODD if x is not None]:
        ids = np.frombuffer(model.encode(t), "<u2").tolist()
        assert ids == model.sp.encode(t), repr(t)
        if t and "▁" not in t:
            assert model.decode(model.encode(t)).decode() == t


@pytest.mark.parametrize("size", [40, 97])
def test_scan(model, size):
    rng = random.Random(size)
    long = [" ".join(rng.choice(["the", "international", "Unbelievable", "a", "straße", "x" * 30, "12345", "漢字", "don't", "\n"]) for _ in range(120)) for _ in range(6)]
    long += ["ab" * 150, " " * 130, "intercontinental" * 20, "a  b   c" * 30]
    for t in long:
        chunks = pieces.cut(t, size, model.longest)
        states = pieces.solve([pieces.transfer(model, c, lo, s, n, size) for c, lo, s, n in chunks])
        assert states is not None
        got = b"".join(pieces.traced(model, c, lo, s, n, size, states[i], states[i + 1]) for i, (c, lo, s, n) in enumerate(chunks))
        assert np.frombuffer(got, "<u2").tolist() == model.sp.encode(t), repr(t[:60])


def test_sentencepiece_operator(spark, model):
    rng = random.Random(1)
    giant = " ".join(rng.choice(["alpha", "beta", "gamma's", "delta,", "Ünïcode"]) for _ in range(700))
    rows = [(1, giant, 1), (2, None, 2), (3, "", 3), (4, "short one", 4), (4, giant[::-1], 5), (None, giant + "\n" + giant, 6)]
    out = pieces.encoded(table(spark, rows, "doc_id long, text string, c int"), PIECES, size=500).collect()
    assert len(out) == 6 and sum(r["scanned"] for r in out) == 3
    want = sorted((str(d), t) for d, t, _ in rows)
    got = sorted((str(r["doc_id"]), None if r["decoded"] is None else bytes(r["decoded"]).decode()) for r in out)
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in out:
        if r["ids"] is not None:
            assert np.frombuffer(r["ids"], "<u2").tolist() == model.sp.encode(bytes(r["decoded"]).decode())
    assert pieces.encoded(table(spark, []), PIECES).count() == 0


def test_sentencepiece_query(spark, tmp_path, model):
    """The query's digests against the library, on whole texts."""
    found = folder(spark, str(tmp_path), 12, 70)
    got = {r["doc_id"]: r for r in pieces.op9_sentencepiece(spark, str(tmp_path)).collect()}
    assert set(got) == set(found)
    for d, t in found.items():
        ids = model.sp.encode(t or "")
        assert (got[d]["n_tokens"], got[d]["ids_crc32"]) == (len(ids), zlib.crc32(np.asarray(ids, "<u2").tobytes())), d
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[d]["n_decoded_bytes"] == len((t or "").encode())


def test_long_words_and_other_tokenizers(library, tmp_path):
    """Words of any length go through the model; a file with other settings is left to the library whole."""
    w = token_files.WordIds(WORDS, "<u2")
    assert w.known
    for t in ["a" * 40, "a" * 41, "xyz" * 500, "q" * 5000 + " end"]:
        assert np.frombuffer(next(w.encode([t.encode()])), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    with open(WORDS, encoding="utf-8") as f:
        other = json.load(f)
    other["normalizer"] = {"type": "NFC"}
    with open(tmp_path / "other.json", "w", encoding="utf-8") as f:
        json.dump(other, f)
    from tokenizers import Tokenizer

    o, lib = token_files.WordIds(str(tmp_path / "other.json"), "<u2"), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not o.known
    for t in ["Upper and lower", "", None, "don't"]:
        assert np.frombuffer(next(o.encode([None if t is None else t.encode()])), "<u2").tolist() == lib.encode(t or "", add_special_tokens=False).ids
