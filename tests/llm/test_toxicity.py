"""The subsequence-kernel machine: held-out accuracy on the driver's tables, and the defined cases."""

import os
import zlib

import numpy as np
import pytest
from cases import table

from framequery.llm import toxicity
from framequery.llm.toxicity import CLASSES, features, margins

DATA = "/root/testdata/sf0.1"


def kernel(a, b):
    """All three-character subsequences within SPAN characters, decayed, divided by the norms."""
    def phi(w):
        c, _ = toxicity.buffers([w])
        c, out = c[: len(w) + 2], {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    key = (int(c[i]), int(c[j]), int(c[k]))
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_features_are_the_kernel():
    words = ["idiot", "id!ot", "i.d.i.o.t", "garden", "é"]
    f = features(words).astype(float)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert f[i] @ f[j] == pytest.approx(kernel(a, b), abs=1e-5)
    assert f[0] @ f[1] > 0.3 > f[0] @ f[3]


def test_folded_weights_give_the_margins():
    rng = np.random.default_rng(0)
    weights = rng.normal(0, 0.1, CLASSES**3).astype(np.float32)
    words = ["alpha", "beta", "x", "a" * 40, "wörd"]
    want = np.maximum(features(words) @ weights + 0.1, toxicity.EMPTY)
    assert margins(words, weights, 0.1) == pytest.approx(want, abs=1e-4)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = toxicity.op4_toxicity(spark, DATA).collect()
    for r in out[:200]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


def test_defined_cases(spark):
    rows = [(i, "you utter blorkhead" if i % 3 == 0 else f"a fine garden number {i}", 9) for i in range(120)] + [(None, None, 9), (500, "", 9), (501, "such a bl.ork.head", 9), (502, "word " * 20_000, 9)]
    docs = table(spark, rows, "doc_id long, text string, score int")
    labels = table(spark, [(i, int(i % 3 == 0)) for i in range(120)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == len(rows) and out[None]["predicted"] == out[500]["predicted"] == out[502]["predicted"] == 0 and not out[None]["held_out"]
    assert np.mean([out[i]["predicted"] == (i % 3 == 0) for i in range(120)]) > 0.97 and out[501]["predicted"] == 1
    kept = toxicity.clean(docs, toxicity.fitted(docs, labels))
    assert kept.columns == docs.columns and 70 < kept.count() < 90
    none = toxicity.toxicity(docs, table(spark, [], "doc_id long, toxic int"))
    assert {r["predicted"] for r in none.collect()} == {0}
    assert toxicity.toxicity(table(spark, []), labels).count() == 0
