"""Finding every stretch of ``window`` units (words or bytes) that also starts earlier in the corpus.

Windows are brought together by anchors. An anchor is a gram of ``gram`` units whose hash is the least among the grams
of some window; every window has one, and equal windows have theirs at the same place, so windows are compared only
within groups of one gram. About one place in ten (words) or thirty-five (bytes) is an anchor.

1. Each task hashes its texts, picks the anchors and, with each, a hash of its context: all units that a window with
   this anchor can reach. Anchors equal in gram and context to an earlier one in the same task are settled at once.
2. Anchors meet by gram, sorted by (gram, context, document, place). Those whose context occurred before are settled:
   every window through them is a repeat. First contexts of a gram that has several are undecided: they agree around
   the gram and differ further out. Grams of one context are unique. This is a stream with a state of one row; its rows
   go straight to an aggregation by document, and the documents are written.
3. Undecided anchors fetch their context from the text and meet by gram again. There windows are told apart by the two
   orders of their contexts, from the gram on and from it backwards (``late_windows``). With a ``solver`` each is instead
   trimmed to the longest stretches before and behind the gram that another shares (what is further out repeats nowhere);
   of equal trimmed contexts all but the earliest are repeats, and those shorter than ``window`` hold none. Of the rest the
   solver finds the windows that start earlier, for groups of whole grams, STEP contexts or one gram at a time. A gram
   with GROUP contexts or more is dealt on by a longer prefix, the whole window (128 bits of hash), to an aggregation with
   a combine; of equal windows that are held at once only the first is.
4. The spans of each document are merged and cut out.

Texts are shuffled only for the documents that have undecided anchors (3) or spans (4), behind Bloom filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.bloom import filter_bits, tested
from framequery.llm.memo import grouped
from framequery.llm.common import lean, written

CHUNK_BYTES = 1 << 20
GROUP, STEP = 20_000, 1500
#: Contexts in one Arrow batch.
FETCHED = 8192
BASE = 0x5851F42D4C957F2D
SECOND = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, kept by the worker for a chunk of usual size."""
    for i, b in enumerate((BASE, INVERSE)):
        if len(_POWERS[i]) < n:
            p = np.full(max(n, 1 << 16), np.uint64(b))
            p[0] = 1
            made = np.cumprod(p, dtype=np.uint64)
            if n > 4 * CHUNK_BYTES:  # a giant text: not kept
                return (made, powers_of(INVERSE, n)) if i == 0 else (_POWERS[0], made)
            _POWERS[i] = made
    return _POWERS[0], _POWERS[1]


def powers_of(b: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(b))
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` items."""
    m, done = x, 1
    while done * 2 <= width:
        m = op(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return op(m[: len(m) - rest], m[rest:]) if rest else m


class Hashed:
    """Units of some texts, end to end, with prefix sums that hash any stretch of them."""

    def __init__(self, units: np.ndarray, lengths: np.ndarray):
        self.n = len(units)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(units * up[: self.n], out=self.sums[1:])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, texts, gram hashes and context hashes of the anchors."""
        none = np.empty(0, np.int64)
        if self.n < window:
            return none, none, none.view(np.uint64), none.view(np.uint64)
        width = window - gram + 1
        g = mix((self.sums[gram:] - self.sums[:-gram]) * self.down[: self.n - gram + 1])
        h = np.maximum((g >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        low = sliding(h, width, np.minimum)  # of each window start
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            low[max(s, e - window + 1) : e] = 0  # windows that would leave their text
        padded = np.concatenate([np.zeros(width - 1, np.uint32), low, np.zeros(width - 1, np.uint32)])
        at = np.flatnonzero(sliding(padded, width, np.maximum) == h)
        text = np.searchsorted(self.ends, at, "right")
        lo, hi = np.maximum(at - (window - gram), self.starts[text]), np.minimum(at + window, self.ends[text])
        context = mix(self.of(lo, hi) ^ ((at - lo).astype(np.uint64) * M2) ^ ((hi - at).astype(np.uint64) * M1))
        return at, text, g[at], context


def spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64) * M1 + place.astype(np.uint64))


def find_anchors(batches: Iterator[pa.RecordBatch], units: Callable, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, context, doc, place, settled)."""
    rows = ((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True) if t)
    for part in grouped(_sized(rows), CHUNK_BYTES):
        part = sorted((x.row for x in part), key=lambda r: r[0])
        arrays = [units(t) for _, t in part]
        hashed = Hashed(np.concatenate(arrays), np.fromiter(map(len, arrays), np.int64, len(arrays)))
        at, text, g, c = hashed.anchors(window, gram)
        if not len(at):
            continue
        doc = np.fromiter((d for d, _ in part), np.int64, len(part))[text]
        place = at - hashed.starts[text]
        # rows are in the order (doc, place): of equal ones, all but the first are repeats
        key = g * M1 ^ c
        order = np.argsort(key, kind="stable")
        later = np.zeros(len(at), bool)
        later[order[1:]] = key[order[1:]] == key[order[:-1]]
        twin = later & (np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))
        g = np.where(twin, spread(doc, place), g)  # settled rows travel to any task, not to their gram's
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(twin)], ["gram", "context", "doc", "place", "settled"])


class _Sized:
    __slots__ = ("row",)

    def __init__(self, row):
        self.row = row

    def __len__(self):
        return len(self.row[1])


def _sized(rows):
    return map(_Sized, rows)


def match_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted anchors -> (doc, place, gram, settled): the repeats, and the first contexts of grams that have several."""
    last_gram = last_context = first = None  # first: the gram's first row while it has one context only
    for b in batches:
        if not b.num_rows:
            continue
        gram, context, doc, place = (b.column(i).to_numpy() for i in range(4))
        settled = b.column(4).to_numpy(zero_copy_only=False)
        new_gram = np.append(last_gram is None or gram[0] != last_gram, gram[1:] != gram[:-1])
        new_context = new_gram | np.append(last_context is None or context[0] != last_context, context[1:] != context[:-1])
        group = np.cumsum(new_gram)  # 0: the gram of the batch before goes on
        contexts = np.bincount(group[new_context], minlength=group[-1] + 1)
        several = contexts > 1
        out = [[], [], [], []]
        if not new_gram[0]:
            if first is not None and contexts[0] > 0:
                for o, v in zip(out, (*first, False), strict=True):
                    o.append(np.array([v]))
                first = None
            several[0] = contexts[0] > 0 and first is None or first is None
        repeat = ~new_context | settled
        open_ = new_context & several[group] & ~settled
        take = repeat | open_
        for o, v in zip(out, (doc[take], place[take], gram[take], repeat[take]), strict=True):
            o.append(v)
        if group[-1] > 0 or first is not None or new_gram[0]:
            if contexts[-1] == 1 and group[-1] > 0:
                i = int(np.flatnonzero(new_gram)[-1])
                first = (doc[i], place[i], gram[i])
            elif group[-1] > 0:
                first = None
        last_gram, last_context = gram[-1], context[-1]
        d, p, g, r = (np.concatenate(o) for o in out)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(p.astype(np.int32)), pa.array(g.astype(np.int64)), pa.array(r.astype(bool))], ["doc", "place", "gram", "settled"])


def fetch_contexts(batches: Iterator[pa.RecordBatch], units: Callable, pack: Callable, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(id, text, anchors) -> a row for each undecided anchor: gram, doc, start of the context, the gram's place in it, its
    units packed."""
    none = [np.empty(0, np.int64)] * 4 + [[]]

    def rows(held):
        grams, docs, starts, places = (np.concatenate(x) for x in zip(*(h[:4] for h in held), strict=True))
        data = pa.array([x for h in held for x in h[4]], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(docs), pa.array(starts.astype(np.int32)), pa.array(places.astype(np.int32)), data], ["gram", "doc", "start", "place", "units"])

    held, size = [none], 0
    for b in batches:
        found = b.column(2)
        place, gram_of = (found.flatten().field(x).to_numpy().astype(np.int64) for x in ("place", "gram"))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy())
        for r, (doc, end) in enumerate(zip(b.column(0).to_pylist(), ends.tolist(), strict=True)):
            begin = int(ends[r - 1]) if r else 0
            text = b.column(1)[r].as_py()
            if not text or begin == end:
                continue
            u = pack(units(text, plain=True))
            raw, item = u.tobytes(), u.dtype.itemsize
            for i in range(begin, end, FETCHED):
                at, g = place[i : min(i + FETCHED, end)], gram_of[i : min(i + FETCHED, end)]
                at, g = at[at + gram <= len(u)], g[at + gram <= len(u)]
                lo, hi = np.maximum(at - (window - gram), 0), np.minimum(at + window, len(u))
                held.append([g, np.full(len(at), doc), lo, at - lo, [raw[x:y] for x, y in zip((lo * item).tolist(), (hi * item).tolist(), strict=True)]])
                size += len(at)
                if size >= FETCHED:
                    yield rows(held)
                    held, size = [none], 0
    if size:
        yield rows(held)


def repeats_of(classes: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, from, to) covered by windows that are not the earliest of their class."""
    docs, code = np.unique(doc, return_inverse=True)
    when = code.astype(np.int64) << 32 | place
    order = np.argsort(classes, kind="stable")
    sorted_class, sorted_when = classes[order], when[order]
    first = np.flatnonzero(np.append(True, sorted_class[1:] != sorted_class[:-1]))
    least = np.repeat(np.minimum.reduceat(sorted_when, first), np.diff(np.append(first, len(order))))
    return joined(docs, sorted_when[sorted_when > least], window)


def joined(docs: np.ndarray, when: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans (doc, from, to) that stretches of ``length`` make together. when: index of the document << 32 | start."""
    when = np.unique(when)
    if not len(when):
        return docs[:0], when, when
    head = np.append(True, when[1:] - when[:-1] > length)  # spans that touch are one; another document is far away
    tail = np.append(head[1:], True)
    at = when & 0xFFFFFFFF
    return docs[when[head] >> 32], at[head], at[tail] + length


def late_windows(units: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, grams: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each context, and each number k of units before its gram, whether the window from there is also that of an
    earlier context of the gram.

    A window is its k units before the gram, and the rest. So the contexts are sorted twice, by gram and what follows
    from it on, and by what precedes it, read backwards; the longest common prefixes of neighbours bound the interval of
    contexts that agree to a depth. Two windows are equal if they lie in the same interval of each order, which leaves
    one number to sort for each window, in place of a suffix for each unit."""
    reach, n = window - gram, len(grams)
    late = np.zeros((n, reach + 1), bool)
    at, slots = begin + place, np.arange(n)
    if units.dtype == np.uint8:
        units = units + np.uint8(1)  # zeros fill up short stretches; no window that is compared reaches into them
    units = np.pad(units, window)

    def sorted_by(side: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order, how far each agrees with the one before it in that order, and with any other."""
        width = side.shape[1]
        side = np.where(np.arange(width) < room[:, None], side, units.dtype.type(0))
        key = np.concatenate([grams.astype(">i8").view(np.uint8).reshape(n, 8), side.view(np.uint8).reshape(n, -1)], axis=1)
        order = np.argsort(key.view(f"S{key.shape[1]}")[:, 0])
        one = side[order]
        differ = np.ones((n - 1, width + 1), bool)
        np.not_equal(one[1:], one[:-1], out=differ[:, :width])
        common = np.append(-1, np.where(grams[order[1:]] == grams[order[:-1]], differ.argmax(axis=1), -1))
        most = np.empty(n, np.int64)
        most[order] = np.maximum(common, np.append(common[1:], -1))
        return order, common, np.minimum(most, room)

    by_before, common_before, before = sorted_by(np.lib.stride_tricks.sliding_window_view(units, reach)[at + gram, ::-1], place)
    by_behind, common_behind, behind = sorted_by(np.lib.stride_tricks.sliding_window_view(units, window)[at + window], end - at)

    def intervals(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
        """Of each context, where its interval of this depth begins."""
        out = np.empty(n, np.int64)
        out[order] = np.maximum.accumulate(np.where(common < depth, slots, 0))
        return out

    rows = np.lexsort((start + place, doc))  # the earliest first; rows of one place of one document are one
    when = np.empty(n, np.int64)
    when[rows] = np.cumsum(np.append(True, (np.diff(doc[rows]) != 0) | (np.diff((start + place)[rows]) != 0)))
    bits = n.bit_length()
    for k in range(reach + 1):
        some = rows[(before[rows] >= k) & (behind[rows] >= window - k)]
        if len(some) < 2:
            continue
        pair = intervals(by_before, common_before, k)[some] << bits | intervals(by_behind, common_behind, window - k)[some]
        if 3 * bits > 63:
            pair = np.unique(pair, return_inverse=True)[1]
        key = np.sort(pair << bits | np.arange(len(some)))
        own, pair = some[key & ((1 << bits) - 1)], key >> bits
        head = np.append(True, pair[1:] != pair[:-1])
        late[own, k] = when[own] > when[own[np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))]]
    return late


def trimmed(units: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, grams: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts sorted by gram, how far each agrees before and behind its gram with any other of the gram: the longest
    common prefixes of neighbours when these stretches are sorted."""
    reach, n = window - gram, len(grams)
    at, steps = begin + place, np.arange(window - gram)
    if units.dtype == np.uint8:
        units = units + np.uint8(1)  # no zeros, which fill up short stretches (UTF-8 has no 0xFF; hashes of words are odd)

    def longest(places: np.ndarray, room: np.ndarray) -> np.ndarray:
        side = np.where(steps < room[:, None], units[np.clip(places, 0, len(units) - 1)], units.dtype.type(0))
        key = np.concatenate([grams.astype(">i8").view(np.uint8).reshape(n, 8), side.view(np.uint8).reshape(n, -1)], axis=1)
        order = np.argsort(key.view(f"S{key.shape[1]}")[:, 0])
        one = side[order]
        differ = np.ones((n - 1, reach + 1), bool)
        np.not_equal(one[1:], one[:-1], out=differ[:, :reach])
        common = np.where(grams[order[1:]] == grams[order[:-1]], differ.argmax(axis=1), 0)
        out = np.zeros(n, np.int64)
        out[order] = np.maximum(np.append(0, common), np.append(common, 0))
        return np.minimum(out, room)

    return longest(at[:, None] - 1 - steps, place), longest(at[:, None] + gram + steps, end - at - gram)


def window_hashes(units: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the window at each place."""
    units = units.astype(np.uint64) + np.uint64(1)
    first = Hashed(units, np.array([len(units)])).of(at, at + window)
    second, base = np.zeros(len(at), np.uint64), np.uint64(SECOND)
    other = mix(units)
    for i in range(window):
        second = second * base + other[at + i]
    return mix(first), mix(second)


def decide(batches: Iterator[pa.RecordBatch], solver: Callable | None, dtype, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram -> spans (doc, lo, hi, null, null), or single windows (doc, lo, hi, and two hashes) of a
    gram that has too many contexts to be held: the first of each kind among those held at once, the others are spans.
    Without a ``solver`` windows are told apart by ``late_windows``."""

    def rows(spans, hashes=None):
        d, lo, hi = spans
        h = [pa.nulls(len(d), pa.int64())] * 2 if hashes is None else [pa.array(x.view(np.int64)) for x in hashes]
        return pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), *h], ["doc", "lo", "hi", "hash", "hash2"])

    def windows(part):
        """All windows of the contexts: packed units, index of each start, document, place."""
        arrays = [np.frombuffer(x, dtype) for x in part["units"].to_pylist()]
        lengths = np.fromiter(map(len, arrays), np.int64, len(arrays))
        units = np.concatenate(arrays)
        begin = np.cumsum(lengths) - lengths
        n = np.maximum(lengths - window + 1, 0)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return units, np.repeat(begin, n) + offset, np.repeat(part["doc"].to_numpy(), n), np.repeat(part["start"].to_numpy(), n).astype(np.int64) + offset

    def laid(part):
        """Units end to end, where each context begins and ends in them, its gram's place, gram and document."""
        units = np.frombuffer(b"".join(part["units"].to_pylist()), dtype)
        end = np.cumsum(pc.binary_length(part["units"]).to_numpy().astype(np.int64)) // units.itemsize
        return units, np.append(0, end[:-1]), end, part["place"].to_numpy().astype(np.int64), part["gram"].to_numpy(), part["doc"].to_numpy()

    def late_of(part):
        """late_windows of the contexts, and the spans that these windows make."""
        units, begin, end, place, grams, doc = laid(part)
        start = part["start"].to_numpy().astype(np.int64)
        late = late_windows(units, begin, end, place, grams, doc, start, window, gram)
        row, k = np.nonzero(late)
        docs, code = np.unique(doc, return_inverse=True)
        return late, joined(docs, code[row] << 32 | (start + place)[row] - k, window)

    def solve(part):
        """Whole grams, the distinct trimmed contexts about STEP at a time."""
        if solver is None:
            spans = late_of(part)[1]
            if len(spans[0]):
                yield rows(spans)
            return
        units, begin, end, place, grams, doc = laid(part)
        before, behind = trimmed(units, begin, end, place, grams, window, gram)
        lo, size = place - before, before + gram + behind
        start = part["start"].to_numpy() + lo
        order = np.lexsort((start, doc, grams))
        order = order[size[order] >= window]
        data, item = units.tobytes(), units.dtype.itemsize
        first: dict = {}
        again = []
        for i, g, a, b, n in zip(order.tolist(), grams[order].tolist(), (begin + lo)[order].tolist(), before[order].tolist(), size[order].tolist(), strict=True):
            k = (g, b, data[a * item : (a + n) * item])
            if k in first:
                again.append(i)
            else:
                first[k] = i
        if again:
            yield rows((doc[again], start[again], (start + size)[again]))
        if not first:
            return
        own = np.fromiter(first.values(), np.int64, len(first))  # in the order of grams
        own_grams = grams[own]
        head = np.flatnonzero(np.append(True, own_grams[1:] != own_grams[:-1]))
        step = head // STEP
        cuts = [*head[np.flatnonzero(np.append(True, step[1:] != step[:-1]))].tolist(), len(own)]
        left = pa.table({"doc": doc[own], "start": start[own], "units": pa.array([k[2] for k in first], pa.binary())})
        lonely = np.diff(np.append(head, len(own))) == 1  # one context: nothing to compare it with
        left = left.append_column("alone", pa.array(np.repeat(lonely, np.diff(np.append(head, len(own))))))
        for x, y in zip(cuts, cuts[1:], strict=False):
            some = left.slice(x, y - x)
            some = some.filter(pc.invert(some["alone"]))
            if some.num_rows:
                u, at, d, p = windows(some)
                spans = repeats_of(solver(u, at, window), d, p, window)
                if len(spans[0]):
                    yield rows(spans)

    def loose(part):
        if not part.num_rows:
            return
        late, spans = late_of(part)
        if len(spans[0]):
            yield rows(spans)
        for i in range(0, part.num_rows, STEP):
            some = part.slice(i, STEP)
            units, at, doc, lo = windows(some)
            n = np.maximum(pc.binary_length(some["units"]).to_numpy() // units.itemsize - window + 1, 0)
            row = np.repeat(np.arange(some.num_rows), n)
            first = ~late[i + row, (some["start"].to_numpy() + some["place"].to_numpy())[row] - lo]
            at, doc, lo = at[first], doc[first], lo[first]
            if len(at):
                yield rows((doc, lo, lo + window), window_hashes(units, at, window))

    held: pa.Table | None = None
    crowded = None
    for b in batches:
        t = pa.table(b)
        if crowded is not None:
            stop = int((t["gram"].to_numpy() == crowded).sum())
            yield from loose(t.slice(0, stop))
            t = t.slice(stop)
            if not t.num_rows:
                continue
            crowded = None
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        grams = held["gram"].to_numpy()
        tail = int((grams == grams[-1]).sum())
        if tail < held.num_rows:
            yield from solve(held.slice(0, held.num_rows - tail))
            held = held.slice(held.num_rows - tail)
        if held.num_rows >= GROUP:
            crowded = int(grams[-1])
            yield from loose(held)
            held = None
    if held is not None and held.num_rows:
        yield from solve(held)


def repeated_spans(docs: DataFrame, units: Callable, pack: Callable, dtype: str, solver: Callable, window: int, gram: int) -> DataFrame:
    """(doc, spans: array of (lo, hi)) of the documents that have repeats. docs: (doc long, text binary)."""
    spark = docs.sparkSession
    lean(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.where(F.col("doc").isNotNull() & (F.length("text") >= window))
    anchors = own.select("doc", "text").mapInArrow(lambda it: find_anchors(it, units, window, gram), "gram long, context long, doc long, place int, settled boolean")
    by_gram = anchors.repartition(parts, "gram").sortWithinPartitions("gram", "context", "doc", "place")
    found = by_gram.mapInArrow(match_anchors, "doc long, place int, gram long, settled boolean")
    of_doc = [F.collect_set(F.when(~F.col("settled"), F.struct("place", "gram"))).alias("anchors"), F.collect_list(F.when(F.col("settled"), F.col("place"))).alias("places")]
    by_doc = written(found.groupBy("doc").agg(*of_doc), "anchors", few=True)
    open_ = by_doc.where(F.size("anchors") > 0).select("doc", "anchors")
    some = tested(own, "doc", open_, filter_bits(open_.count())).where("maybe").select("doc", "text")
    met = some.join(open_.hint("merge"), "doc")
    contexts = met.mapInArrow(lambda it: fetch_contexts(it, units, pack, window, gram), "gram long, doc long, start int, place int, units binary")
    sorted_contexts = contexts.repartition(parts, "gram").sortWithinPartitions("gram")
    decided = written(sorted_contexts.mapInArrow(lambda it: decide(it, solver, dtype, window, gram), "doc long, lo int, hi int, hash long, hash2 long"), "decided", few=True)
    crowd = decided.where(F.col("hash").isNotNull())
    first = crowd.groupBy("hash", "hash2").agg(F.min(F.struct("doc", "lo")).alias("first"))
    late = crowd.join(first.hint("merge"), ["hash", "hash2"]).where(F.struct("doc", "lo") > F.col("first")).select("doc", "lo", "hi")
    settled = by_doc.where(F.size("places") > 0).select("doc", "places").mapInArrow(lambda it: settled_spans(it, window, gram), "doc long, lo int, hi int")
    spans = settled.unionByName(decided.where(F.col("hash").isNull()).select("doc", "lo", "hi")).unionByName(late)
    return spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def settled_spans(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(doc, places of repeated anchors) -> spans (doc, lo, hi) covered by the windows through them; they may leave the text."""
    reach = window - gram
    for b in batches:
        place = b.column(1).flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy())
        docs, lo, hi = joined(b.column(0).to_numpy(), row << 32 | place, reach + window)
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array((lo - reach).astype(np.int32)), pa.array((hi - reach).astype(np.int32))], ["doc", "lo", "hi"])


def merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Spans within [0, n), sorted, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((max(0, s["lo"]), min(n, s["hi"])) for s in spans or ()):
        if hi <= lo:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, text, spans): spans are null for documents without any, which are not shuffled."""
    spans = written(spans, "spans", few=True)
    split = tested(docs, "doc", spans, filter_bits(spans.count()))
    hit = split.where("maybe").drop("maybe").join(spans.hint("merge"), "doc", "left")
    return hit.select("doc", "text", "spans").unionByName(split.where(~F.col("maybe")).select("doc", "text", F.lit(None).cast(hit.schema["spans"].dataType).alias("spans")))
