"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, other columns."""

import random

PASSAGE = " ".join(f"pass{i}" for i in range(60))


def texts(seed=0, n=60, vocabulary=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(vocabulary))
    out = []
    for i in range(n):
        kind = rng.randrange(9)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind == 1:
            out.append(" ".join([word() for _ in range(rng.randrange(30))] + [PASSAGE] + [word() for _ in range(rng.randrange(30))]))
        elif kind == 2 and out and any(out):
            ws = (rng.choice([x for x in out if x]) or "").split()
            for _ in range(max(1, len(ws) // 40)):
                if ws:
                    ws[rng.randrange(len(ws))] = word()
            out.append(" ".join(ws))
        elif kind == 3:
            out.append(rng.choice([None, "", "  \t ", "one", "two joined words", "naïve café Σ 漢字 \U0001f600"]))
        elif kind == 4:
            out.append(" ".join(["go"] * rng.randrange(1, 90)))
        else:
            out.append(rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randrange(1, 120))))
    return out


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def docs(spark, seed=0, n=60):
    rows = list(enumerate(texts(seed, n)))
    random.Random(seed + 1).shuffle(rows)
    return table(spark, rows), dict(rows)


def folder(spark, path, seed=0, n=60):
    """documents and labels as the driver lays them out; returns the texts by id."""
    rows = [(i, t, "en", [None, "web", "book", "code"][min(i % 6, 3)], len(t or "")) for i, t in enumerate(texts(seed, n))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(0, n, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {r[0]: r[1] for r in rows}
