"""SentencePiece encoding and decoding by a max-plus scan over boundary states.

The segmentation of a text is a path through the lattice of pieces. For a BPE model the path is the one on which every
two neighbours are compatible (encoding the two together gives the two back): weights are 0 and minus infinity. A
giant document is cut into chunks at any place. The state at a cut is the piece that ends at or reaches over it. Each
chunk yields, independently, the matrix of states at its left cut against states at its right cut; matrices combine
associatively (max-plus products, here of sparse 0 / -inf matrices); when the states at all cuts are known, each chunk
traces its own pieces back independently.

Pieces never reach over the start of a word, or over a character that no longer piece holds: there all states meet, so
inside a chunk only the two words at the cuts need the lattice, and the words between are looked up in a memo of
words that the library encodes. Should a cut have no path (never seen; the rule about neighbours is not proven for
every vocabulary), the library encodes that whole document and ``scanned`` is false.

Defined cases: null text gives null ids from ``encoded`` and is counted as empty by the query; an empty text has no ids;
decoding gives the text back byte for byte, except that U+2581 decodes as a space, which the format cannot tell apart;
rows with the same id are encoded each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.common import lean, written

#: Characters a chunk; a document of up to twice as many is encoded in one go.
CHUNK = 1 << 15
MARK = "▁"
MEMO_WORDS = 200_000
U2 = "<u2"


class Pieces:
    """A SentencePiece BPE model with byte fallback: its vocabulary, its words' ids, and its lattice."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback, the identity normalizer and a dummy prefix are supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        self.longest = max(map(len, self.ids))
        self.bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.out = [b""] * len(proto.pieces)
        for p, i in self.ids.items():
            self.out[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes_at.items():
            self.out[i] = bytes([b])
        self.newline = self.raw([10]) if "\n" not in self.joined else None
        self.first: dict[bytes, bytes] = {}  # a word after a space: with its mark
        self.bare: dict[bytes, bytes] = {}  # a word after an isolated character: without
        self.fit: dict[tuple[str, str], bool] = {}

    def raw(self, codes) -> bytes:
        return np.asarray([self.bytes_at[b] for b in codes], U2).tobytes()

    def _word(self, w: bytes) -> bytes:
        if len(self.first) > MEMO_WORDS:
            self.first.clear()
        # an empty word is a mark alone
        self.first[w] = v = np.asarray(self.sp.encode(w.decode()) or [self.ids[MARK]], U2).tobytes()
        return v

    def _bare(self, w: bytes) -> bytes:
        if len(self.bare) > MEMO_WORDS:
            self.bare.clear()
        ids = self.sp.encode("\n" + w.decode())
        self.bare[w] = v = np.asarray(ids[2:], U2).tobytes()  # without the dummy mark and the line end
        return v

    def words(self, segment: bytes) -> bytes:
        """Ids of words joined by single spaces; the first is not marked before it."""
        first, get = self.first, self.first.get
        head, *rest = segment.split(b" ")
        out = [self.bare.get(head) or (self._bare(head) if head else b"")]
        for w in rest:
            out.append(get(w) or self._word(w))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The library's ids as little-endian u16, from the memo where words stand alone."""
        if not text:
            return b""
        if self.newline is None or "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text or MARK in text or "\0" in text:
            return np.asarray(self.sp.encode(text), U2).tobytes()
        head, *rest = text.encode().split(b"\n")
        out = [self.words(b" " + head)] if head else [np.asarray([self.ids[MARK]], U2).tobytes()]
        for line in rest:
            out += [self.newline, self.words(line)]
        return b"".join(out)

    # -- the lattice, over the marked text (a mark for each space and one before the text)

    def resets(self, s: str) -> list[int]:
        """Places of s (but 0) over which no piece can reach."""
        return [i for i in range(1, len(s)) if s[i] not in self.joined or s[i - 1] not in self.joined or s[i] == MARK != s[i - 1]]

    def merges(self, s: str) -> list[str]:
        """The model's own pieces of a short string: best-scored neighbours first, leftmost of equals."""
        parts = list(s)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, a: str, b: str) -> bool:
        if a[-1] not in self.joined or b[0] not in self.joined or (b[0] == MARK != a[-1]):
            return True
        if (a, b) not in self.fit:
            if len(self.fit) > MEMO_WORDS:
                self.fit.clear()
            self.fit[a, b] = self.merges(a + b) == [a, b]
        return self.fit[a, b]

    def starting(self, s: str, at: int) -> list[str]:
        """Pieces (or the lone character) that start there."""
        found = [s[at : at + n] for n in range(1, min(self.longest, len(s) - at) + 1) if s[at : at + n] in self.ids]
        return found if found and len(found[0]) == 1 else [s[at], *found]

    def paths(self, s: str, start: int, entry: str | None, stop: int) -> dict[tuple[int, str], tuple]:
        """From a state (entry: the piece that ends at start; None: any), all (end, piece) that compatible paths
        reach, with the state before; pieces start before ``stop`` and may end after it."""
        back: dict[tuple[int, str], tuple] = {}
        at: dict[int, list[str | None]] = {start: [entry]}
        for i in range(start, min(stop, len(s))):
            for last in at.get(i, ()):
                for p in self.starting(s, i):
                    if (last is None or self.compatible(last, p)) and (i + len(p), p) not in back:
                        back[i + len(p), p] = (i, last)
                        at.setdefault(i + len(p), []).append(p)
        return back

    def id_bytes(self, p: str) -> bytes:
        i = self.ids.get(p)
        return self.raw(p.encode()) if i is None else np.asarray([i], U2).tobytes()

    def decode(self, ids: bytes) -> bytes:
        out = self.out
        text = b"".join([out[i] for i in np.frombuffer(ids, U2).tolist()])
        return text[1:]  # the dummy mark


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One model for each worker process, kept between tasks."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


# -- chunks of one marked text s; chunk c covers [c * size, (c + 1) * size)


def cut(text: str, size: int, longest: int) -> list[tuple[int, int, str, int]]:
    """(chunk, first place of its context, context, length of the marked text); the context reaches one piece
    further to both sides."""
    s = MARK + text.replace(" ", MARK)
    return [(c, lo, s[lo : min(len(s), (c + 1) * size + longest)], len(s)) for c in range(-(-len(s) // size)) for lo in [max(0, c * size - longest)]]


def _plan(m: Pieces, c: int, lo: int, s: str, n: int, size: int):
    """(left cut, right cut, first reset, last reset) in the context; resets are None if the chunk has none."""
    a, b = c * size - lo, min((c + 1) * size, n) - lo
    inside = [i for i in m.resets(s) if a <= i <= b]
    if c == 0:
        inside = [0, *inside]
    if b + lo == n:
        inside.append(b)
    return a, b, (inside[0] if inside else None), (inside[-1] if inside else None)


def _entries(m: Pieces, s: str, a: int) -> list[tuple[int, str]]:
    """States at the left cut: (end - a, piece) of the pieces that start before it and end at or after it."""
    return [(q + len(p) - a, p) for q in range(max(0, a - m.longest), a) for p in m.starting(s, q) if q + len(p) >= a]


def transfer(m: Pieces, c: int, lo: int, s: str, n: int, size: int) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """The chunk's matrix: the (left state, right state) entries of weight 0. The text's ends have the state (0, '')."""
    a, b, r1, r2 = _plan(m, c, lo, s, n, size)
    last = b + lo == n
    out = []
    tail = {} if r2 is None else m.paths(s, r2, None, b)
    tails = [(0, "")] if last else sorted({(e - b, p) for e, p in tail if e >= b}) or []
    if r2 == b and not last:
        # a reset at the cut itself: any piece may end there, and none is compatible or not with the next
        tails = [(0, "")]
    for over, p in [(0, "")] if c == 0 else [(0, "")] * (r1 == a) + _entries(m, s, a):
        if r1 is None:
            if over + a >= b:
                out.append(((over, p), (over + a - b, p)))
                continue
            ends = m.paths(s, a + over, p, b)
            out += [((over, p), t) for t in sorted({(e - b, q) for e, q in ends if e >= b})]
        elif a + over == r1 or any(e == r1 for e, _ in m.paths(s, a + over, p or None, r1)):
            out += [((over, p), t) for t in tails]
    return out


def solve(matrices: list[list[tuple]]) -> list[tuple[int, str]] | None:
    """The states at all cuts, from the chunks' matrices in order: products forwards, then a trace backwards."""
    seen, back = {(0, "")}, []
    for m in matrices:
        step: dict = {}
        for a, b in m:
            if a in seen:
                step.setdefault(b, a)
        back.append(step)
        seen = set(step)
    if (0, "") not in seen:
        return None
    states = [(0, "")]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def _walk(m: Pieces, s: str, start: int, entry: str | None, stop: int, goal) -> bytes:
    back = m.paths(s, start, entry, stop)
    state = next(((e, p) for e, p in back if goal(e, p)), None)
    out = []
    while state is not None and state in back:
        out.append(m.id_bytes(state[1]))
        i, p = back[state]
        state = None if i == start else (i, p)
    return b"".join(reversed(out))


def traced(m: Pieces, c: int, lo: int, s: str, n: int, size: int, left: tuple[int, str], right: tuple[int, str]) -> bytes:
    """The ids of the pieces that start in the chunk."""
    a, b, r1, r2 = _plan(m, c, lo, s, n, size)
    start, entry = a + left[0], left[1] or None
    ends = lambda e, p: e - b == right[0] and (not right[1] or p == right[1])
    if r1 is None:
        return b"" if start >= b else _walk(m, s, start, entry, b, ends)
    head = b"" if start >= r1 else _walk(m, s, start, entry, r1, lambda e, p: e == r1)
    inner = s[r1:r2]
    tail = b"" if r2 >= b else _walk(m, s, r2, None, b, ends)
    return head + _inner(m, inner) + tail


def _inner(m: Pieces, s: str) -> bytes:
    """Ids of a stretch of marked text between two resets."""
    if not s:
        return b""
    text = s.replace(MARK, " ")
    if s[0] == MARK and (len(s) < 2 or s[1] != MARK):
        return m.encode(text[1:]) if len(text) > 1 else m.id_bytes(MARK)
    skip = len(m.sp.encode("\n"))
    return np.asarray(m.sp.encode("\n" + text)[skip:], U2).tobytes()


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """docs' id as doc_id, ``ids`` (little-endian u16, binary; null for null text), ``decoded`` (the ids decoded) and
    ``scanned`` (whether a giant document took the scan)."""
    spark = docs.sparkSession
    lean(spark)
    longest = model(model_file).longest
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    giant = F.length("text") > 2 * size
    id_type = dict(own.dtypes)["doc_id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for b in batches:
            for at in range(0, b.num_rows, 512):  # ids and decoded text of a few rows at a time
                part = b.slice(at, 512)
                ids = [None if t is None else m.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([None if i is None else m.decode(i) for i in ids], pa.binary()), pa.array([False] * len(ids))], ["doc_id", "ids", "decoded", "scanned"])

    out_schema = f"doc_id {id_type}, ids binary, decoded binary, scanned boolean"
    small = own.where(~F.coalesce(giant, F.lit(False))).select("doc_id", "text").mapInArrow(whole, out_schema)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c, lo, s, n in cut(text, size, longest):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "c": pa.array([c], pa.int32()), "lo": pa.array([lo], pa.int64()), "s": [s], "n": pa.array([n], pa.int64())})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for b in batches:
            for r in b.to_pylist():
                found = [(a, p, z, q) for (a, p), (z, q) in transfer(m, r["c"], r["lo"], r["s"], r["n"], size)]
                cells = pa.array([[{"a": a, "p": p, "b": z, "q": q} for a, p, z, q in found]], pa.list_(pa.struct([("a", pa.int32()), ("p", pa.string()), ("b", pa.int32()), ("q", pa.string())])))
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]]), pa.array([r["c"]], pa.int32()), cells], ["row", "c", "cells"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = solve([[((x["a"], x["p"]), (x["b"], x["q"])) for x in c["cells"]] for c in sorted(r["m"], key=lambda c: c["c"])])
                n = len(r["m"])
                found = found or [(-1, "")] * (n + 1)
                yield pa.RecordBatch.from_pydict({"row": pa.array([r["row"]] * n), "c": pa.array(range(n), pa.int32()), "a": pa.array([x for x, _ in found[:-1]], pa.int32()), "p": [p for _, p in found[:-1]], "b": pa.array([x for x, _ in found[1:]], pa.int32()), "q": [q for _, q in found[1:]]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for b in batches:
            for r in b.to_pylist():
                ids = b"" if r["a"] < 0 else traced(m, r["c"], r["lo"], r["s"], r["n"], size, (r["a"], r["p"]), (r["b"], r["q"]))
                yield pa.RecordBatch.from_pydict({"row": pa.array([r["row"]]), "c": pa.array([r["c"]], pa.int32()), "ids": pa.array([ids], pa.binary()), "solved": [r["a"] >= 0]})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for b in batches:
            for r in b.to_pylist():
                ids = b"".join(p["ids"] for p in sorted(r["parts"], key=lambda p: p["c"])) if r["solved"] else m.encode(r["text"])
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"]], b.schema.field("doc_id").type), pa.array([ids], pa.binary()), pa.array([m.decode(ids)], pa.binary()), pa.array([r["solved"]])], ["doc_id", "ids", "decoded", "scanned"])

    # written, so that row numbers are the same whatever is run again
    large = written(own.where(giant), "giant")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = written(large.select("row", "text").mapInArrow(cuts, "row long, c int, lo long, s string, n long").repartition(parts, "row", "c"), "chunks")
    cells = "array<struct<a:int,p:string,b:int,q:string>>"
    mats = chunks.mapInArrow(matrices, f"row long, c int, cells {cells}")
    # a document's matrices are a few dozen cells a chunk
    found = mats.groupBy("row").agg(F.collect_list(F.struct("c", "cells")).alias("m")).mapInArrow(states, "row long, c int, a int, p string, b int, q string")
    ids = chunks.join(found, ["row", "c"]).mapInArrow(trace, "row long, c int, ids binary, solved boolean")
    whole_ids = ids.groupBy("row").agg(F.collect_list(F.struct("c", "ids")).alias("parts"), F.min("solved").alias("solved"))
    big = large.join(whole_ids, "row").select("doc_id", "text", "parts", "solved").mapInArrow(finish, out_schema)
    return small.unionByName(big)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian u16), decoded_sha256, n_decoded_bytes, scanned."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encoded(docs, public_tokenizers.path("piece_bpe_32k.model")))


def digests(df: DataFrame) -> DataFrame:
    empty = F.lit(b"")
    return df.select("doc_id", F.coalesce(F.length("ids") / 2, F.lit(0)).cast("long").alias("n_tokens"), F.crc32(F.coalesce("ids", empty)).alias("ids_crc32"), F.sha2(F.coalesce("decoded", empty), 256).alias("decoded_sha256"), F.coalesce(F.length("decoded"), F.lit(0)).cast("long").alias("n_decoded_bytes"), "scanned")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
