"""Token ids in flat binary files with 64-bit document offsets.

Documents are range-partitioned by id and sorted, so partition p's documents all come before those of p + 1. Each
task encodes its documents and writes one pair of files to the shared folder:

* ``<name>.bin``  the ids of its documents back to back, little-endian unsigned 16-bit (32-bit if the vocabulary
  needs it), each document followed by the end id;
* ``<name>.idx``  little-endian: magic ``FQTOKEN1``, item size (u64), documents n (u64), n + 1 offsets in ids (i64,
  from the start of the file), n document ids (i64; a null id is stored as the least i64).

The manifest (one row a file) gives, by prefix sums, each file's base: the ids of all documents before it. Readers map
the files into memory where they are local and otherwise read them through their file system.

File names are new at each attempt and only files named in the manifest count, so a task that is run again does no harm.

Defined cases: null and empty texts are the end id alone; null ids come first; rows with the same id stay separate, in
any order among themselves; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framequery.llm.common import lean, new_path, written
from framequery.llm.memo import Memo, grouped

MAGIC = b"FQTOKEN1"
NO_ID = -(1 << 63)
END_ID = 1
#: Bytes of text that are split into units together.
CHARS = 4_000_000
#: Bytes of units and their ids that a worker remembers, in each of two generations.
MEMO_BYTES = 32_000_000
#: The character that stands for each byte in byte-level vocabularies.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_MOVED = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _KEPT)}
MANIFEST = "part int, stem string, n_docs long, n_tokens long"

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a tokenizer file must say for texts to be split here; texts of any other tokenizer go to the library whole.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
}
SPACE, LETTER, DIGIT, SIGN, ODD, WHOLE = range(6)
#: Class of each byte: control characters, the apostrophe (it starts units of its own) and bytes over ASCII are odd.
CLASS = np.full(256, ODD, np.uint8)
CLASS[0x21:0x7F] = SIGN
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[0x30:0x3A] = DIGIT
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASS[0x27] = ODD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The second bytes, after 0xC3, of the letters U+00C0 to U+00FF, and of those that have a small letter 32 further.
LATIN, CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
LATIN[0x80:0xC0] = True
CAPITAL[0x80:0x9F] = True
LATIN[[0x97, 0xB7]] = CAPITAL[0x97] = False


class WordIds:
    """A text's ids as little-endian bytes.

    A tokenizer of these SETTINGS gives the same ids for a text as for its units (runs of letters, single digits, runs
    of signs), each by itself. Whole batches are split into units by the classes of their bytes; the library's model
    encodes each unit that is not remembered. Words with anything but ASCII and the letters up to U+00FF, with an
    apostrophe or with what may be a special token are kept whole: those of Latin letters and ASCII are split by the
    tokenizer's own pattern, the others are encoded by the library as they are.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.dtype, self.memo = Tokenizer.from_file(path), dtype, Memo(MEMO_BYTES)
        self.model, self.kind = self.tokenizer.model, "H" if dtype == "<u2" else "I"
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model = found["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.known = plain and all(found[k] == v for k, v in SETTINGS.items()) and all("<|" in t["content"] for t in found["added_tokens"])
        self.latin = regex.compile("[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+")
        self.units = regex.compile(SPLIT)

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        for part in grouped(texts, CHARS):
            yield from self.batch(part) if self.known else self.whole([(t or b"").decode("utf-8", "replace") for t in part])

    def whole(self, texts: list[str]) -> Iterator[bytes]:
        """By the library."""
        for at in range(0, len(texts), 1000):
            for e in self.tokenizer.encode_batch(texts[at : at + 1000], add_special_tokens=False):
                yield array(self.kind, e.ids).tobytes()

    def batch(self, texts: list[bytes | None]) -> Iterator[bytes]:
        data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        kind, low = CLASS[data], LOWER[data]
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):
            lead = lead[LATIN[data[lead + 1]]]
            kind[lead] = kind[lead + 1] = LETTER
            low[lead[CAPITAL[data[lead + 1]]] + 1] += 0x20
        solid = kind != SPACE
        odd = np.concatenate([np.flatnonzero(kind == ODD), np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))])
        if len(odd):
            edge = np.flatnonzero(np.diff(solid, prepend=False))  # starts and ends of words by turns; a space ends the data
            word = np.unique(np.searchsorted(edge, odd, "right") - 1)
            n = edge[word + 1] - edge[word]
            at = np.repeat(edge[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            kind[at], low[at] = WHOLE, data[at]
        start = solid.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        places = np.flatnonzero(start)
        if not len(places):
            yield from [b""] * len(texts)
            return
        body = low[solid]
        offsets = np.append(np.flatnonzero(start[solid]), len(body)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        indices = units.indices.to_numpy()
        whole = np.zeros(len(units.dictionary), bool)
        whole[indices] = kind[places] == WHOLE
        flat = pa.array(self.ids_of(units.dictionary.to_pylist(), whole), pa.binary()).take(units.indices)
        where, out = np.frombuffer(flat.buffers()[1], np.int32), flat.buffers()[2].to_pybytes() if flat.buffers()[2] else b""
        stops = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
        ends = where[np.searchsorted(places, stops)].tolist()
        last = 0
        for end in ends:
            yield out[last:end]
            last = end

    def ids_of(self, units: list[bytes], whole: np.ndarray) -> list[bytes]:
        found = self.memo.get(units)
        new = {u: self.one(u) for u, ids, w in zip(units, found, whole.tolist(), strict=True) if ids is None and not w}
        words = [u for u, ids, w in zip(units, found, whole.tolist(), strict=True) if ids is None and w]
        strange = []
        for u in words:
            s = u.decode("utf-8", "replace")
            if "<|" not in s and self.latin.fullmatch(s):
                new[u] = b"".join([self.one(x.encode()) for x in self.units.findall(s.lower())])
            else:
                strange.append(u)
        new.update(zip(strange, self.whole([u.decode("utf-8", "replace") for u in strange]), strict=True))
        if new:
            self.memo.put(new)
            found = [new[u] if ids is None else ids for u, ids in zip(units, found, strict=True)]
        return found

    def one(self, unit: bytes) -> bytes:
        s = unit.decode() if unit.isascii() else unit.decode("latin-1").translate(_MOVED)
        return array(self.kind, [t.id for t in self.model.tokenize(s)]).tobytes()


_MEMOS: dict[str, WordIds] = {}


def word_ids(path: str, dtype: str) -> WordIds:
    """One memo for each worker process, kept between tasks."""
    key = f"{path}|{dtype}"
    if key not in _MEMOS:
        _MEMOS[key] = WordIds(path, dtype)
    return _MEMOS[key]


def _fs(path: str):
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return None, url.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(path: str, write: Callable) -> None:
    store, at = _fs(path)
    if store is None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as out:
            write(out)
    else:
        with store.open_output_stream(at) as out:
            write(out)


def _get(path: str, dtype, offset: int = 0) -> np.ndarray:
    """The file's items from a byte offset on: a memory map of a local file, else its bytes."""
    store, at = _fs(path)
    if store is None:
        n = (os.path.getsize(at) - offset) // np.dtype(dtype).itemsize
        return np.memmap(at, dtype, "r", offset, (n,)) if n else np.empty(0, dtype)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read_at(f.size() - offset, offset), dtype)


def write_files(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode and write; returns the manifest (part, stem, n_docs, n_tokens, base), one row a file."""
    from tokenizers import Tokenizer

    lean(docs.sparkSession)
    dtype = "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    end = np.asarray([end_id], dtype).tobytes()
    item = np.dtype(dtype).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part = word_ids(vocabulary, dtype), TaskContext.get().partitionId()
        stem, ids, lengths = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}", array("q"), array("q")

        def write(out) -> None:
            for b in batches:
                ids.extend(NO_ID if x is None else x for x in b.column(0).to_pylist())
                for data in memo.encode(t.as_py() for t in b.column(1)):
                    data += end
                    lengths.append(len(data) // item)
                    out.write(data)

        _put(f"{stem}.bin", write)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64) if lengths else np.empty(0, np.int64))]).astype("<i8")
        _put(f"{stem}.idx", lambda out: out.write(MAGIC + struct.pack("<QQ", item, len(ids)) + offsets.tobytes() + np.asarray(ids, "<i8").tobytes()))
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "stem": [stem], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([int(offsets[-1])], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    sorted_rows = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id")
    manifest = written(sorted_rows.mapInArrow(encode, MANIFEST), "manifest")
    # one row a file, so this window is small
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head = _get(f"{stem}.idx", "<u8")
                magic, item, n = bytes(head[:1].tobytes()), int(head[1]), int(head[2])
                if magic != MAGIC:
                    raise ValueError(f"{stem}.idx is not an index of token files")
                offsets, ids = head[3 : n + 4].view("<i8"), head[n + 4 : 2 * n + 4].view("<i8")
                tokens = _get(f"{stem}.bin", "<u2" if item == 2 else "<u4")
                for at in range(0, n, 10_000):
                    to = min(n, at + 10_000)
                    crc = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(at, to)]
                    doc = np.asarray(ids[at:to])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, mask=doc == NO_ID), pa.array(np.asarray(offsets[at:to]) + base), pa.array(np.diff(offsets[at : to + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    dealt = manifest.where("n_docs > 0").select("stem", "base", "part").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return dealt.select("stem", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(write_files(docs, new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op8_token_files": op8_token_files}
SQL: dict[str, str] = {}
