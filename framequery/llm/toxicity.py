"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

Kernel of two words: over all three-character subsequences within SPAN characters of each (word ends marked,
accented letters, digits and signs as classes), the sum of products of decay ** span, divided by the words' own norms. Inserted signs and stretched letters cost a factor, not the match; a run of single characters is
also read as one word.

Labels are for documents, insults are words of their sentences: training is by multiple instances. Witnesses are the
words far commoner in toxic documents; a squared-hinge machine over Nystroem features (landmarks: witnesses and common
clean words) is fitted, then again TURNS - 1 times with the words that it finds in toxic documents as positives and the highest
ones of clean documents as negatives. A document's margin is that of its highest word; one logistic curve, fitted on
the same documents, maps it to the score.

The machine is linear in the kernel, so it is folded into one weight per subsequence (CLASSES ** 3 floats, whatever
the number of landmarks): a word costs a few look-ups a character, and whole texts are scored.

Fitting takes a sample of at most TRAIN_TOXIC toxic and TRAIN_CLEAN clean documents, smallest hashes of doc_id first, and
of each only its distinct words; this bound is the parameter ``train``. Everything else covers all rows.

Defined cases: null or empty text, or one without words, has the margin of no word (EMPTY); a document with more than
one label counts as toxic if any label says so; null labels are left out; if either class is missing the score is the
share of toxic documents among the labels (0 without labels) with the bias of 1e-6 below 0.5; null ids are scored and
not held out; repeated rows are scored each.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.common import lean
from framequery.llm.memo import grouped

CLASSES, SPAN, DECAY = 40, 8, 0.6
START, END, DIGIT, LETTER, SIGN, ACCENTED = 27, 28, 29, 30, 31, 32
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 4800
LANDMARKS, NEGATIVES = 512, 9000
#: Margins stop there; the margin of no word at all.
EMPTY = -1.0
#: Tokens whose margins a task remembers, in each of two generations, and characters of text that are looked up together.
MEMO_WORDS, CHARS = 150_000, 500_000
FOLDS, TURNS = 5, 4
STRIP = ".,!?;:#$%&*|\"'()[]{}<>"
PAIRS = [(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]
RUN = re.compile(r"(.)\1{2,}", re.DOTALL)
SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:\s+\S){2,}(?=\s|$)")


def _class(ch: str) -> int:
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if ch.isdigit():
        return DIGIT
    if ch.isalpha():
        base = unicodedata.normalize("NFD", ch)[0]
        # accented letters have eight classes of their own, which keeps those of one language apart
        return ACCENTED + ord(ch) % (CLASSES - ACCENTED) if "a" <= base <= "z" and base != ch or ch == "\u00df" else LETTER
    return SIGN


#: Class of each code point of the basic plane; 0 is no character.
TABLE = np.array([0, START, END, *(_class(chr(i)) for i in range(3, 0xD800)), *[SIGN] * 0x800, *(_class(chr(i)) for i in range(0xE000, 0x10000)), LETTER], np.int32)


def buffers(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' classes in one array, marked and padded so that no subsequence runs into the next; their starts."""
    flat = "".join(["\1" + w + "\2" + "\0" * SPAN for w in words])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + (2 + SPAN)
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
    return TABLE[np.minimum(points, 0x10000)], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def least_norms(lengths: np.ndarray) -> np.ndarray:
    """Lower bound of the feature vectors' lengths, met if no subsequence occurs twice: of the word's length alone."""
    total = np.zeros(len(lengths))
    for _, k in PAIRS:
        total += np.maximum(lengths - k, 0) * DECAY ** (2 * (k + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def entries(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit feature vectors: word, subsequence and value of each entry that isn't zero."""
    classes, starts = buffers(words)
    n = len(classes)
    own = np.repeat(np.arange(len(words)), np.append(starts[1:], n) - starts)
    padded = np.concatenate([classes, np.zeros(SPAN, np.int32)])
    keys, values = [], []
    for j, k in PAIRS:
        b, c = padded[j : n + j], padded[k : n + k]
        i = np.flatnonzero((classes > 0) & (b > 0) & (c > 0))
        keys.append(own[i] * CLASSES**3 + (classes[i] * CLASSES + b[i]) * CLASSES + c[i])
        values.append(np.full(len(i), DECAY ** (k + 1)))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    v = np.bincount(at, np.concatenate(values))
    word = key // CLASSES**3
    return word, key % CLASSES**3, v / np.sqrt(np.bincount(word, v * v, minlength=len(words)))[word]


def features(words: list[str]) -> np.ndarray:
    """Dense rows for a few hundred words."""
    out = np.zeros((len(words), CLASSES**3), np.float32)
    word, code, v = entries(words)
    out[word, code] = v
    return out


def margins(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin of each word, EMPTY at least. A bound from a few look-ups a character rules most words
    out (a negative sum, or one that is too small even for the least norm); the others get their own norm."""
    if not words:
        return np.zeros(0)
    classes, starts = buffers(words)
    n = len(classes)
    padded = np.concatenate([classes, np.zeros(SPAN, np.int32)])
    total = np.zeros(n, np.float32)
    for j, k in PAIRS:
        total += weights[(classes * CLASSES + padded[j : n + j]) * CLASSES + padded[k : n + k]] * np.float32(DECAY ** (k + 1))
    most = np.add.reduceat(total, starts) / least_norms(np.diff(np.append(starts, n)) - SPAN) + bias
    out = np.full(len(words), EMPTY)
    left = np.flatnonzero(most > EMPTY) if bias <= EMPTY else np.arange(len(words))
    for at in range(0, len(left), 5000):
        part = left[at : at + 5000]
        word, code, v = entries([words[i] for i in part])
        out[part] = np.maximum(np.bincount(word, v * weights[code], minlength=len(part)) + bias, EMPTY)
    return out


def tokens(text: str) -> list[str]:
    found = text.split()
    if SPACED.search(text):
        found += ["".join(x.split()) for x in SPACED.findall(text)]
    return found


def _plain(token: str) -> str:
    """Lower case, without signs around it; runs of a character are cut to two."""
    return RUN.sub(r"\1\1", token.lower().strip(STRIP))


def _letters(word: str) -> str:
    return "".join(c for c in word if c.isalpha())


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def token_margins(self, found: list[str]) -> np.ndarray:
        """A token's margin; with signs or digits inside, the higher of it and of its letters."""
        plain = [_plain(t) for t in found]
        bare = [w if w.isalpha() else _letters(w) for w in plain]
        place = {w: i for i, w in enumerate(dict.fromkeys([*plain, *bare]))}  # each form once
        m = margins(list(place), self.weights, self.bias)
        both = np.maximum(m[[place[w] for w in plain]], m[[place[w] for w in bare]]) if found else np.zeros(0)
        return np.where([bool(w) for w in plain], both, EMPTY)

    def score(self, margin: float) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * (margin - self.shift), -30, 30))))


def _svm(f: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Squared hinge by Newton steps on the primal; the bias is not regularised."""
    f = np.c_[f, np.ones(len(f))]
    w = np.zeros(f.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-6
    for _ in range(40):
        gap = 1 - y * (f @ w)
        on = gap > 0
        fw = f[on] * weight[on][:, None]
        step = np.linalg.solve(np.diag(ridge) + 2 * c * fw.T @ f[on], ridge * w - 2 * c * fw.T @ (gap[on] * y[on]))
        w -= step
        if np.linalg.norm(step) < 1e-6 * max(1.0, np.linalg.norm(w)):
            break
    return w[:-1], float(w[-1])


class _Nystroem:
    def __init__(self, landmarks: list[str]):
        self.z = features(landmarks)
        values, vectors = np.linalg.eigh((self.z @ self.z.T).astype(float))
        keep = values > 1e-6
        self.map = vectors[:, keep] / np.sqrt(values[keep])
        self.seen: dict[str, np.ndarray] = {}

    def rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        for at in range(0, len(new), 250):
            part = new[at : at + 250]
            self.seen.update(zip(part, (features(part) @ self.z.T).astype(float) @ self.map, strict=True))
        return np.array([self.seen[w] for w in words])

    def folded(self, w: np.ndarray) -> np.ndarray:
        return (self.z.T @ (self.map @ w).astype(np.float32)).astype(np.float32)


def fit(sample: list[tuple[int, list[str]]], seed: int = 0) -> Machine:
    """From (toxic, distinct tokens) of each sampled document."""
    sample = list({tuple(ws): (t, ws) for t, ws in sample}.values())  # copies of a text count once
    total = Counter(t for t, _ in sample)
    if not total[0] or not total[1]:
        return Machine(np.zeros(CLASSES**3, np.float32), 0.0, 1.0, 0.0, float(min(max(total[1] / max(sum(total.values()), 1), 0.0), 1.0)))
    place: dict[str, int] = {}
    aside = sample[::4]  # for the curve only
    if len({t for t, _ in aside}) == 2 and len(sample) >= 40 and len({t for i, (t, _) in enumerate(sample) if i % 4}) == 2:
        sample = [x for i, x in enumerate(sample) if i % 4]
        total = Counter(t for t, _ in sample)
    else:
        aside = sample
    docs = [np.fromiter({place.setdefault(w, len(place)) for w in map(_plain, ws) if w}, np.int64) for _, ws in sample]
    vocabulary = list(place)
    df = np.zeros((2, len(vocabulary)))
    for (t, _), ids in zip(sample, docs, strict=True):
        df[t, ids] += 1
    odds = (df[1] / total[1]) / ((df[0] + 0.5) / total[0])
    rng = np.random.default_rng(seed)
    for least, ratio in ((max(4, total[1] // 100), 40), (2, 10), (1, 0)):
        lead = [i for i in np.argsort(-df[1] - 1e-9 * odds, kind="stable") if odds[i] > ratio and df[1, i] >= least][:1500]
        if len(lead) >= 5:
            break
    common = [i for i in np.argsort(-df[0], kind="stable")[:3000] if df[0, i] > 0]
    once = np.flatnonzero((df[0] == 1) & (df[1] == 0))
    negative = list(dict.fromkeys([*common, *rng.choice(once, min(3000, len(once)), replace=False)]))
    marks = [*lead[:300], *rng.choice(negative, min(len(negative), LANDMARKS - 300), replace=False)] if negative else lead[:LANDMARKS]
    nys = _Nystroem([vocabulary[i] for i in marks])
    positive, hard = lead, np.zeros(len(vocabulary), bool)
    for turn in range(TURNS):
        inside = set(positive)
        hardest = [i for i in np.argsort(-m * hard, kind="stable")[: hard.sum()] if hard[i]] if turn else []
        clean = [i for i in dict.fromkeys([*hardest, *negative]) if i not in inside][:NEGATIVES]
        rows = [*positive, *clean]
        weight = np.concatenate([3 * np.sqrt(np.maximum(df[1, positive], 1)), 1 + np.log1p(df[0, clean]) + 3 * hard[clean]])
        w, bias = _svm(nys.rows([vocabulary[i] for i in rows]), np.array([1.0] * len(positive) + [-1.0] * len(clean)), weight)
        weights = nys.folded(w)
        m = margins(vocabulary, weights, bias)
        if turn < TURNS - 1:
            witness, hard = set(), np.zeros(len(vocabulary), bool)
            for (t, _), ids in zip(sample, docs, strict=True):
                if not len(ids):
                    continue
                if t:
                    witness.update(ids[m[ids] > 0.5].tolist() + [int(ids[np.argmax(m[ids])])])
                else:
                    hard[ids[m[ids] > -0.3]] = True
                    hard[ids[np.argmax(m[ids])]] = True
            positive = [i for i in sorted(witness) if odds[i] > ratio] or positive
    machine = Machine(weights, bias, 1.0, 0.0)
    top = np.array([machine.token_margins(ws).max() if ws else EMPTY for _, ws in aside])
    slope, shift = _logistic(top, np.array([t for t, _ in aside], float))
    return Machine(weights, bias, slope, shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve, the slope held back by a small penalty."""
    share = np.full(len(x), 1 / max(len(x), 1))
    f, w = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        g = f.T @ (share * (p - y)) + np.array([1e-4 * w[0], 0])
        h = (f * (share * p * (1 - p))[:, None]).T @ f + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if w[0] <= 1e-6:
        return 1.0, float(np.median(x))
    return float(w[0]), float(-w[1] / w[0])


def fold(id_col: str = "doc_id", folds: int = FOLDS):
    """crc32 of the id as text, modulo ``folds``; fold 0 is never trained on."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, train: tuple[int, int] = (TRAIN_TOXIC, TRAIN_CLEAN)) -> DataFrame:
    """doc_id, toxic and the distinct words (a line each) of at most train[0] toxic and train[1] clean labelled documents outside fold 0, by hash of the id."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(fold() != 0).withColumn("order", F.crc32(F.concat(F.lit("t"), F.col("doc_id").cast("string")).cast("binary")))
    picked = None
    for toxic, most in enumerate(reversed(train)):
        part = own.where(F.col("toxic") == toxic).orderBy("order", "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.select(F.col("doc_id").alias("id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "toxic", F.col("text"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = "\n".join(sorted({w for w in map(_plain, tokens(text or "")) if w}))
                yield pa.RecordBatch.from_arrays([pa.array([i], b.schema.field(0).type), pa.array([t], pa.int32()), pa.array([words])], ["doc_id", "toxic", "words"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, words string"
    return rows.mapInArrow(distinct, schema)


def fitted(docs: DataFrame, labels: DataFrame, train: tuple[int, int] = (TRAIN_TOXIC, TRAIN_CLEAN)) -> Machine:
    """The machine, fitted by one task on the bounded sample; only its weights come to the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(t, w.split("\n") if w else []) for b in batches for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample))], pa.binary())], ["machine"])

    lean(docs.sparkSession)
    one = training_sample(docs, labels, train).repartition(1).sortWithinPartitions("doc_id", "words")
    found = one.mapInArrow(learn, "machine binary").collect()
    return pickle.loads(found[0]["machine"]) if found else fit([])


class Known:
    """Margins of tokens in two generations, so that words in use stay."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def learn(self, words: set[str]) -> dict[str, float]:
        new = words.difference(self.young)
        if len(self.young) > MEMO_WORDS:
            self.old, self.young, new = self.young, {}, words
        held = {w: self.old[w] for w in new if w in self.old}
        self.young.update(held)
        rest = [w for w in new if w not in held]
        self.young.update(zip(rest, self.machine.token_margins(rest).tolist(), strict=True))
        return self.young


def best_margins(texts: pa.Array, known: Known) -> np.ndarray:
    """The highest margin of each text's tokens."""
    best = []
    for part in grouped((x.as_py() or "" for x in texts), CHARS):
        found = [set(tokens(t)) for t in part]
        get = known.learn(set().union(*found)).__getitem__
        best += [max(map(get, ws)) if ws else EMPTY for ws in found]
    return np.array(best, float)


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and ``margin`` of every whole text."""
    lean(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # CLASSES ** 3 floats: 128 KB, whatever the input
    kind = dict(docs.dtypes)[id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        known = Known(m)
        for b in batches:
            best = best_margins(b.column(1), known)
            s = np.array([m.score(x) for x in best])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(best)], ["doc_id", "score", "predicted", "margin"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, f"doc_id {kind}, score double, predicted int, margin double")
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "margin")


def clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns. Rows are tested where they are: nothing moves."""
    lean(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        known = Known(m)
        for b in batches:
            best = best_margins(b.column(at), known)
            yield b.filter(pa.array([m.score(x) < 0.5 for x in best], pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fitted(docs, labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
