"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes are dealt to groups by a prefix of variable length: the eight words of their anchor gram, or, where a gram has
more contexts than a group may hold, the whole window of twenty. Each memory-sized group builds the suffix tree of its
suffixes: they are sorted by their words, longest common prefixes of neighbours are found by doubling, and an inner node
is an interval of suffixes with the least common prefix inside as its depth. Inner nodes at ``window`` words or deeper
are the repeats; of the leaves below such a node all but the earliest start a repeated window. The nodes nearest the
root hold the leaves of all deeper ones, so their leaves decide; ``inner_nodes`` gives them all, which are the maximal
repeats to the right. Only suffixes that share a gram with another text and differ in its surroundings reach a tree;
repeats with equal surroundings are settled by hash before (see ``repeats``).

Defined cases: null and empty texts have no words; texts shorter than the window lose nothing; rows with a null id are
left whole; rows with the same id are one document (equal texts get equal results); an empty table gives no rows; the
first of ties is the smallest doc_id, then the earliest start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.repeats import merged, repeated_spans, with_spans

WINDOW, GRAM = 20, 8
MEMO_WORDS = 200_000


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w) | 1
        return h


_WORDS = _Words()


def word_units(text: bytes, plain: bool = False) -> np.ndarray:
    """A 64-bit hash for each word (bytes.split divides at ASCII white space alone)."""
    found = text.split()
    return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))


def pack(units: np.ndarray) -> np.ndarray:
    return units


def suffixes(units: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at these places by their first ``depth`` units or more, and the common prefix of each with
    the one before it in that order (0 for the first; at most what was sorted by)."""
    n = len(units)
    name = np.unique(units, return_inverse=True)[1].astype(np.int64) + 1
    names, reach = [name], 1  # names of prefixes of 1, 2, 4, ... units, in their order; 0 beyond the end
    while reach < depth:
        other = np.zeros(n, np.int64)
        other[: max(n - reach, 0)] = names[-1][reach:]
        names.append(np.unique(names[-1] * (n + 2) + other, return_inverse=True)[1].astype(np.int64) + 1)
        reach *= 2
    order = np.argsort(names[-1][at], kind="stable")
    one, two = at[order[1:]], at[order[:-1]]
    common = np.zeros(len(one), np.int64)
    for k in range(len(names) - 1, -1, -1):
        name = np.append(names[k], np.zeros(reach * 2, np.int64))
        x, y = name[one + common], name[two + common]
        common += np.where((x == y) & (x > 0), 1 << k, 0)
    # a suffix that ends before the prefix does shares no more than its length
    return order, np.append(0, np.minimum(common, n - np.maximum(one, two)))


def inner_nodes(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, end, depth) of the tree's inner nodes of depth ``least`` or more, from the common prefixes of neighbours."""
    out, open_ = [], []
    for i in range(1, len(common) + 1):
        depth, first = int(common[i]) if i < len(common) else 0, i - 1
        while open_ and open_[-1][1] > depth:
            first, d = open_.pop()
            if d >= least:
                out.append((first, i, d))
        if depth and (not open_ or open_[-1][1] < depth):
            open_.append((first, depth))
    return sorted(out)


def nodes(units: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For the suffix at each place the number of the node nearest the root, of ``depth`` or more, that it lies below; a
    suffix below none is a leaf with a number of its own."""
    order, common = suffixes(units, at, depth)
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces), spans."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    spans = repeated_spans(own, word_units, pack, "<u8", nodes, window, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for t, s in zip((x.as_py() for x in b.column(1)), b.column(2).to_pylist(), strict=True):
                w = (t or b"").split()
                at, left = 0, []
                for lo, hi in merged(s, len(w)):
                    left += w[at:lo]
                    at = hi
                left += w[at:]
                n.append(len(w))
                gone.append(len(w) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return with_spans(own, spans).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL = {
    "op1_substring_dedup": rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
    r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
    c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range({WINDOW})) AS j)),
    u AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM d),
    k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM u ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
}
