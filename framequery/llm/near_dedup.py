"""MinHash near-dedup by an LSH forest, with links confirmed on full shingle sets.

Texts with equal shingle sets are one class and only its representative (smallest doc_id) goes on. A signature has
HASHES minima; each of TREES trees sorts the representatives by its own sequence of them. Representatives that share the
first LEVELS[0] minima of a tree form a region; in it each is compared with the WINDOW rows before and after it in the
tree's order, which are its neighbours of longest common prefix, by their whole signatures (two bits a minimum). So the depth
adapts: in a region of up to WINDOW rows all meet at the least depth, in a crowded one only those that share longer
prefixes. Regions with more than a small share of all rows are dealt to the tasks by longer prefixes (the other LEVELS),
and where even these are crowded by an even hash, another one in each tree.

Of its neighbours in a tree each representative takes the one most alike as candidate, and candidates become links only
if the full sets reach the similarity, in integers. In a second round, among the representatives that had any candidate,
only neighbours in other components than one's own count, and the three most alike are taken in each tree (REACH).

WINDOW, REACH and the dealing of crowded regions only order the work. What they leave out is marked: the rows of a
region that have others beyond WINDOW, all rows of crowded regions, and the rows whose candidates in other components exceeded
REACH in the last round. Regions that share a marked row form a group, and in each group that still has several components all pairs
of marked rows of different components are compared on full sets (``rest_links``), in blocks dealt to tasks. So every pair
that shares a region and looks alike is either in one component already or compared in full.

What can be missed: a pair at similarity 0.8 shares no region in any tree with a chance of about 1 in 20 million, and
its signatures look too unlike (SLACK) with one of about 1 in 55,000, if the minima are independent. Equal 64-bit
shingle hashes count as equal shingles.

Defined cases: null, empty or wordless text has an empty set and is linked with nothing; null ids are linked with
nothing and kept; rows with the same id are one node; a text with fewer words than a shingle is one shingle; very long
texts are hashed whole; ties are broken by id; columns but id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.bloom import filter_bits, tested
from framequery.llm.common import dropped, hot_join, lean, shielded, written
from framequery.llm.components import components, extended

#: Trees, and the minima that no other tree starts with.
TREES, OWN = 32, 4
HASHES = TREES * OWN
#: Depths by which regions are dealt to tasks, and the minima after them that order their rows.
LEVELS, FAR = (OWN, 8, 12), 4
WINDOW = 96
#: Neighbours in each tree that become candidates, by round; from the second round on only those in other components.
REACH = (1, 3)
#: Rows of a block of ``rest_links`` until a side has BLOCKS blocks, and bytes of sets that no usual block exceeds.
BLOCK, BLOCKS, BLOCK_BYTES = 512, 32, 4 << 20
#: Rows and shingles that are multiplied at once.
STRIP, COLUMNS = 512, 4096
#: Signatures look alike if at most so many of the HASHES two-bit values differ: at similarity 0.8, 4.5 deviations more than the mean.
SLACK = int(HASHES * 0.15 + 4.5 * (HASHES * 0.15 * 0.85) ** 0.5)
#: A region is crowded if it has over a CROWD-th of all representatives: at most CROWD * TREES * len(LEVELS) are.
CROWD, LEAST_CROWD = 64, 1000
MEMO_WORDS = 200_000
_RNG = np.random.default_rng(20240607)
MULTIPLY = (_RNG.integers(0, 1 << 32, HASHES, np.uint64) | 1).astype(np.uint32)
ADD = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
#: Each tree's order of the minima: its own, then those of the trees after it.
ORDERS = (np.arange(TREES)[:, None] * OWN + np.arange(LEVELS[-1] + FAR)) % HASHES
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
PAIRS = np.uint64(0x5555555555555555)


class WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = WordHashes()


def shingles(text: bytes, width: int = 2) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles, A-Z in lower case."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = max(len(h) - width + 1, 1)
    out = np.full(n, np.uint64(min(width, len(h))))
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * M1
        out ^= out >> np.uint64(29)
    out = out * M3
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of the set under multiply-add hashes of 32 bits."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512, None] * MULTIPLY + ADD).min(axis=0), out=low)
    return low


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, key, sig = [], [], []
        for t in b.column(1):
            s = shingles(t.as_py() or b"", width)
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "key", "sig"])
    _WORDS.clear()


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """That many well-mixed bits of 32-bit values."""
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)


def _keys(sig: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The minima in each tree's order, and for each of LEVELS the hashes of the prefixes of that depth (rows x trees)."""
    own = sig[:, ORDERS]
    h, out = np.broadcast_to(np.arange(TREES, dtype=np.uint64), own.shape[:2]) * M2, []
    for d in range(LEVELS[-1]):
        h = (h ^ own[:, :, d].astype(np.uint64)) * M1
        h = h ^ (h >> np.uint64(31))
        if d + 1 in LEVELS:
            out.append(h)
    return own, out


def _rows(b: pa.RecordBatch, column: str, step: int = 1000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, b.num_rows, step):
        part = b.slice(at, step)
        yield part, np.frombuffer(b"".join(part.column(column).to_pylist()), np.uint32).reshape(-1, HASHES)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the prefixes that rows of one batch share: an estimate from below that large regions cannot escape."""
    for b in batches:
        found = [np.concatenate([k.reshape(-1) for k in _keys(sig)[1]]) for _, sig in _rows(b, "sig")]
        if found:
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["key", "n"])


def _crowded(reps: DataFrame, total: int) -> np.ndarray:
    """The sorted hashes of crowded prefixes: at most CROWD * TREES * len(LEVELS) numbers, whatever the input."""
    counts = reps.select("sig").mapInArrow(_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > max(LEAST_CROWD, total // CROWD)).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def _dealt(batches: Iterator[pa.RecordBatch], crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(rep, n, comp, sig) -> a row a tree: key (the region, or a part of a crowded one), ``far`` (the minima after the
    region's depth, which order it by longest common prefix), and the signature by two bits a minimum."""
    for b in batches:
        for part, sig in _rows(b, "sig"):
            own, levels = _keys(sig)
            rep = part.column("rep").to_numpy(zero_copy_only=False)
            key, level = levels[0], np.zeros(own.shape[:2], np.int64)
            if len(crowded):
                for d in range(1, len(LEVELS)):
                    full = (level == d - 1) & np.isin(key, crowded)
                    key, level = np.where(full, levels[d], key), level + full
                full = (level == len(LEVELS) - 1) & np.isin(key, crowded)
                salt = (rep.astype(np.uint64)[:, None] * M1 ^ np.arange(TREES, dtype=np.uint64) * M2) * M3 >> np.uint64(58)
                key = np.where(full, (key ^ salt) * M1, key)
            after = np.array(LEVELS)[level]
            far = np.zeros(key.shape, np.uint64)
            for d in range(FAR):
                m = np.take_along_axis(own, (after + d)[:, :, None], 2)[:, :, 0]
                far = far << np.uint64(16) | _mixed(m, 16).astype(np.uint64)
            two = _mixed(sig, 2).astype(np.uint8).reshape(len(sig), -1, 4)
            packed = (two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6).astype(np.uint8)
            width = packed.shape[1]
            data = np.repeat(packed, TREES, axis=0)
            offsets = np.arange(len(data) + 1, dtype=np.int32) * width
            look = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            each = lambda name: pa.array(np.repeat(part.column(name).to_numpy(zero_copy_only=False), TREES))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(far.reshape(-1).view(np.int64)), each("rep"), each("comp"), each("n").cast(pa.int32()), look], ["key", "far", "rep", "comp", "n", "look"])


def _crowd(batches: Iterator[pa.RecordBatch], crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(rep, sig) -> a mark (rep, region) for each crowded region of a row."""
    for b in batches:
        for part, sig in _rows(b, "sig"):
            key = _keys(sig)[1][0]
            row, tree = np.nonzero(np.isin(key, crowded))
            yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(row)), pa.array(key[row, tree].view(np.int64))], ["rep", "region"])


def _near(batches: Iterator[pa.RecordBatch], reach: int, percent: int, window: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows of _dealt -> candidate pairs (a, b, null), and marks (a, null, region) of the rows with pairs left out:
    beyond the window, or in the last round beyond ``reach``. Keeps the last ``window`` + 1 rows at most."""
    held: dict[str, np.ndarray] | None = None

    def marks(rep, key, rows):
        rows = np.unique(rows)
        return pa.RecordBatch.from_arrays([pa.array(rep[rows], kind), pa.nulls(len(rows), kind), pa.array(key[rows], pa.int64())], ["a", "b", "region"])

    for b in batches:
        if not b.num_rows:
            continue
        kind = b.schema.field("rep").type
        now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep", "comp", "n")}
        look = b.column("look")
        at = look.offset * HASHES // 4
        now["look"] = np.frombuffer(look.buffers()[2], np.uint64, b.num_rows * HASHES // 32, at).reshape(b.num_rows, -1)
        before = 0
        if held is not None:
            before = len(held["key"])
            now = {c: np.concatenate([held[c], v]) for c, v in now.items()}
        key, rep, comp, n, look = (now[c] for c in ("key", "rep", "comp", "n", "look"))
        left, right, gap = [], [], []
        i = np.arange(len(key))
        for lag in range(1, window + 2):
            i = i[: np.searchsorted(i, len(key) - lag)]
            i = i[key[i + lag] == key[i]]
            if not len(i):
                break
            x = i[i + lag >= before] if before else i
            if lag > window:
                if len(x):
                    yield marks(rep, key, np.concatenate([x, x + lag]))
                break
            x = x[comp[x] != comp[x + lag]]
            y = x + lag
            fits = 100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64)
            x, y = x[fits], y[fits]
            d = look[x] ^ look[y]
            d = np.bitwise_count((d | d >> np.uint64(1)) & PAIRS).sum(axis=1)
            ok = d <= SLACK
            left.append(x[ok])
            right.append(y[ok])
            gap.append(d[ok])
        if left:
            x, y, d = np.concatenate(left), np.concatenate(right), np.concatenate(gap)
            if len(x):
                one, other, far = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([d, d])
                order = np.lexsort((rep[other], far, one))
                new = np.append(True, one[order[1:]] != one[order[:-1]])
                first = np.flatnonzero(new)
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                take = np.zeros(len(x), bool)
                take[order[rank < reach] % len(x)] = True
                a, c = rep[x[take]], rep[y[take]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c), kind), pa.array(np.maximum(a, c), kind), pa.nulls(len(a), pa.int64())], ["a", "b", "region"])
                if last and not take.all():
                    yield marks(rep, key, np.concatenate([x[~take], y[~take]]))
        keep = max(int(np.searchsorted(np.flip(key) != key[-1], True)), 1)
        keep = min(keep, window + 1)
        held = {c: v[-keep:].copy() for c, v in now.items()}


def candidates(reps: DataFrame, crowded: np.ndarray, reach: int, percent: int, last: bool) -> DataFrame:
    """The distinct candidate pairs (a, b, null), a < b, and marks (a, null, region) of reps (rep, n, comp, sig)."""
    window = WINDOW
    kind = dict(reps.dtypes)["rep"]
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.mapInArrow(lambda it: _dealt(it, crowded), f"key long, far long, rep {kind}, comp {kind}, n int, look binary")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "far", "rep")
    return rows.mapInArrow(lambda it: _near(it, reach, percent, window, last), f"a {kind}, b {kind}, region long").distinct()


def full_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, s): the full sets of the documents of ids (doc_id), eight bytes a shingle, written."""
    ids = written(ids.distinct(), "ids", few=True)
    own = tested(docs, "doc_id", ids, filter_bits(ids.count())).where("maybe").select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py() or b"", width).tobytes() for t in part.column(1)], pa.binary())], ["doc_id", "s"])
        _WORDS.clear()

    out = written(own.mapInArrow(sets, f"doc_id {kind}, s binary"), "sets")
    dropped(ids)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. The two sets of a pair meet in joins on one id each, which
    Spark may split where an id is hot."""
    kind = dict(sets.dtypes)["doc_id"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.withColumnRenamed("s", "x").hint("merge"), F.col("b") == F.col("doc_id")).drop("doc_id")
    full = left.join(sets.withColumnRenamed("s", "y").hint("merge"), F.col("a") == F.col("doc_id")).select("a", "b", "x", "y")
    return full.mapInArrow(check, f"a {kind}, b {kind}")


def _joined(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, i, j, block, comp, s) sorted by (group, i, j) -> (a, b): for each component that links of full sets between
    the blocks i and j join to others, the least of these."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        names, low = np.unique(t["comp"].to_numpy(), return_inverse=True)
        own, low = low, np.arange(len(names))
        block, i, j = t["block"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["s"]]
        size = np.fromiter(map(len, found), np.int64, len(found))

        def strips(which: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            rows, out = np.flatnonzero(block == which), []
            for at in range(0, len(rows), STRIP):
                part = rows[at : at + STRIP]
                out.append((part, np.concatenate([found[r] for r in part]), np.repeat(np.arange(len(part)), size[part])))
            return out

        left = strips(i)
        right = left if i == j else strips(j)
        for at, (x, some, of_x) in enumerate(left):
            for y, others, of_y in right[at:] if i == j else right:
                apart = low[own[x]][:, None] != low[own[y]]
                if not apart.any():
                    continue
                both = np.intersect1d(some, others)
                common = np.zeros((len(x), len(y)), np.float32)  # whole numbers far below 2 ** 24
                for c in range(0, len(both), COLUMNS):
                    sides = []
                    for n, tokens, of in ((len(x), some, of_x), (len(y), others, of_y)):
                        place = np.minimum(np.searchsorted(both[c : c + COLUMNS], tokens), len(both[c : c + COLUMNS]) - 1)
                        hit = both[c : c + COLUMNS][place] == tokens
                        m = np.zeros((n, len(both[c : c + COLUMNS])), np.float32)
                        m[of[hit], place[hit]] = 1
                        sides.append(m)
                    common += sides[0] @ sides[1].T
                common = common.astype(np.int64)
                p, q = np.nonzero(apart & (100 * common >= percent * (size[x][:, None] + size[y] - common)))
                p, q = own[x[p]], own[y[q]]
                while (low[p] != low[q]).any():
                    p, q = low[p], low[q]
                    least = np.minimum(p, q)
                    np.minimum.at(low, p, least)
                    np.minimum.at(low, q, least)
                    while (low[low] != low).any():
                        low = low[low]
        new = np.flatnonzero(low != np.arange(len(low)))
        kind = t.schema.field("comp").type
        return pa.RecordBatch.from_arrays([pa.array(names[low[new]], kind), pa.array(names[new], kind)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = tuple(key[:, lo].tolist())
            if held and now != last:
                yield solve(pa.Table.from_batches(held))
                held = []
            last = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield solve(pa.Table.from_batches(held))


def rest_links(marks: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (a, b) between components of labels (node, comp) by all pairs of marked rows (rep, region) of a group, the
    regions that share rows. A side of a group, its largest component or the other rows, is dealt evenly to blocks;
    each block of other rows meets every block of both sides in a task of its own. None if no group has two components."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = written(marks.distinct(), "marks", few=True)
    hubs = marks.groupBy("region").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # a row lies in a few regions of each tree: the least of their hubs stands for it, and only hubs are linked with hubs
    tied = hot_join(marks, hubs, "region", "size", marks.count()).groupBy("rep").agg(F.min("hub").alias("hub"), F.collect_set("hub").alias("hubs"))
    tied = written(tied, "tied", few=True)
    ends = components(tied.select(F.col("hub").alias("a"), F.explode("hubs").alias("b")))
    groups = tied.join(ends.withColumnRenamed("node", "hub").hint("merge"), "hub", "left").select(F.col("rep").alias("node"), F.coalesce("comp", "hub").alias("group"))
    members = groups.join(labels.hint("merge"), "node", "left").select(F.col("node").alias("doc_id"), "group", F.coalesce("comp", "node").alias("comp"))
    shares = members.groupBy("group", "comp").count()
    several = shares.groupBy("group").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("size"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("group", "main", "size")
    several = written(several, "groups", few=True)
    dropped(marks)
    if not several.limit(1).count():
        dropped(tied)
        return None
    total = several.agg(F.sum("size")).first()[0]
    own = written(hot_join(members, several, "group", "size", total).select("doc_id", "group", "comp", (F.col("comp") == F.col("main")).alias("inner")), "members", few=True)
    sets = full_sets(own.select("doc_id"), docs, width)
    rows = written(own.join(sets.hint("merge"), "doc_id"), "members")
    blocks = lambda inner: F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.sum(F.when(inner, 1)) / BLOCK)), F.ceil(F.sum(F.when(inner, F.length("s"))) / BLOCK_BYTES))
    sides = rows.groupBy("group").agg(blocks(F.col("inner")).alias("ins"), blocks(~F.col("inner")).alias("outs"), F.count(F.lit(1)).alias("size"))
    dealt = hot_join(rows, sides, "group", "size", rows.count())
    even = F.xxhash64("doc_id", "s")
    dealt = dealt.withColumn("block", F.when(F.col("inner"), F.pmod(even, "ins")).otherwise(F.col("ins") + F.pmod(even, "outs")))
    met = F.when(F.col("inner"), F.sequence("ins", F.col("ins") + F.col("outs") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("ins") + F.col("outs") - 1))
    dealt = dealt.withColumn("other", F.explode(met)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    kind = dict(labels.dtypes)["comp"]
    dealt = dealt.select("group", "i", "j", "block", "comp", "s").repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j")
    out = written(dealt.mapInArrow(lambda it: _joined(it, percent), f"a {kind}, b {kind}"), "links", few=True)
    dropped(tied, several, own, sets, rows)
    return out


def forest_links(reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """The components (node, comp) of the links among reps (rep, n, sig); None without any."""

    def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        return found.where(F.col("b").isNotNull()).select("a", "b"), found.where(F.col("b").isNull()).select(F.col("a").alias("rep"), "region")

    kind = dict(reps.dtypes)["rep"]
    crowded = _crowded(reps, reps.count())
    found = written(candidates(reps.withColumn("comp", F.col("rep")), crowded, REACH[0], percent, len(REACH) == 1), "pairs")
    if not found.limit(1).count() and not len(crowded):
        return None
    tried, beyond = split(found)
    if len(crowded):
        beyond = beyond.unionByName(reps.select("rep", "sig").mapInArrow(lambda it: _crowd(it, crowded), f"rep {kind}, region long"))
    sets = full_sets(tried.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, width)
    links = written(confirmed(tried, sets, percent).distinct(), "links", few=True)
    labels, left = components(links), beyond
    dropped(links)
    family = written(reps.join(sets.select(F.col("doc_id").alias("rep")).distinct().hint("merge"), "rep", "left_semi"), "family")
    for k, reach in enumerate(REACH[1:], 2):
        named = family.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        more, cut = split(written(candidates(named, crowded, reach, percent, k == len(REACH)), "pairs"))
        left = beyond.unionByName(cut)
        more = more.join(tried.hint("merge"), ["a", "b"], "left_anti")
        new = written(confirmed(more, sets, percent).distinct(), "links", few=True)
        if new.limit(1).count():
            labels, tried = extended(labels, new), tried.unionByName(more)
    if left.limit(1).count():
        new = rest_links(left, labels, docs, width, percent)
        if new is not None and new.limit(1).count():
            labels = extended(labels, new)
    dropped(family, sets)
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Ids must be integers."""
    lean(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    signed = written(own.mapInArrow(lambda it: _signed(it, width), f"doc_id {kind}, n long, key binary, sig binary"), "signed")
    total = signed.count()
    real = signed.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(real.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    # the signature of a class is that of its representative, found by id: texts of one id may differ, so by key too
    both = real.join(classes.select(F.col("key").alias("k"), "rep").hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("key") == F.col("k")))
    reps = written(both.dropDuplicates(["doc_id", "key"]).select("rep", "n", "sig"), "reps")
    labels = forest_links(reps, own, width, percent)
    dropped(reps)
    named = signed.select("doc_id", "n", "key")
    grouped = hot_join(named.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()), classes, "key", "size", total).select("doc_id", "n", "rep")
    if labels is None:
        found = grouped.select("doc_id", "n", F.col("rep").alias("component_id"))
    else:
        found = grouped.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("doc_id", "n", F.coalesce("comp", "rep").alias("component_id"))
    alone = named.where(F.col("key").isNull() | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that stay, all columns: one document of each group. Rows with the same id stay or go together.
    Only rows whose id may be one that goes are shuffled. Other columns are carried along under any names."""
    names = docs.columns
    docs, (id_col, text_col) = shielded(docs, id_col, text_col)
    gone = near_dedup(docs, id_col, text_col, **kw).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    gone = written(gone, "dropped", few=True)
    split = tested(docs.withColumn("__id", F.col(id_col)), "__id", gone, filter_bits(gone.count()), out="__maybe")
    sure = split.where(~F.col("__maybe")).select(*docs.columns)
    return sure.unionByName(split.where("__maybe").join(gone.hint("merge"), "__id", "left_anti").select(*docs.columns)).toDF(*names)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
SQL = {
    "op7_minhash_near_dedup": r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id, d.doc_id = low AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY 1) USING (doc_id)"""
}
