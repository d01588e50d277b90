"""The operators of DataFrame functions only: exact dedup, quality rules, line dedup, mixing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from cases import folder, table

from framequery.llm import exact_dedup, line_dedup, mixing, quality_rules
from framequery.llm import bloom

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


def by_sql(path, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(map(str, (tuple(r[i] for i in order) for r in rel.fetchall())))


@pytest.mark.parametrize("module", [exact_dedup, quality_rules, line_dedup, mixing])
def test_query_equals_its_sql(spark, tmp_path, module):
    folder(spark, str(tmp_path), 11, 120)
    for k, f in module.QUERIES.items():
        assert rows_of(f(spark, str(tmp_path))) == by_sql(tmp_path, module.SQL[k])


@pytest.mark.parametrize("module", [exact_dedup, quality_rules, line_dedup, mixing])
def test_no_python_in_the_plan(spark, tmp_path, module):
    folder(spark, str(tmp_path), 11, 20)
    for f in module.QUERIES.values():
        plan = f(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_by_hand(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (3, ""), (4, " "), (None, "q"), (7, "q"), (7, "q"), (8, "Q")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(table(spark, rows)).collect()), key=str)
    want = [(5, 2, 2, False), (2, 2, 2, True), (9, 9, 1, True), (1, 1, 2, True), (3, 1, 2, False), (4, 4, 1, True), (None, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True), (8, 8, 1, True)]
    assert got == sorted(want, key=str)
    sha = exact_dedup.exact_dedup(table(spark, [(1, "a \n b")])).first()["text_sha256"]
    assert sha == hashlib.sha256(b"a b").hexdigest()
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    df = table(spark, [(1, "x", 3), (2, "x", 4)], "doc_id long, text string, sha int")
    assert exact_dedup.deduplicated(df).collect() == [(1, "x", 3)]


def test_a_full_filter_only_costs_shuffle(spark):
    rows = [(i, f"t{i % 700}") for i in range(1000)]
    a = rows_of(exact_dedup.exact_dedup(table(spark, rows)))
    assert a == rows_of(exact_dedup.exact_dedup(table(spark, rows), max_bits=1 << 15))


def test_bloom_never_misses(spark):
    keys = table(spark, [(i,) for i in range(0, 3000, 3)] * 2, "k long")
    got = bloom.tested(table(spark, [(i,) for i in range(3000)], "k long"), "k", keys, 1 << 15, at_least=2).collect()
    hit = {r["k"] for r in got if r["maybe"]}
    assert hit >= set(range(0, 3000, 3)) and len(hit) < 1400


def brute_rules(text):
    t = text or ""
    w = WORD.findall(t)
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    inside = {p for v in where.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_quality_by_hand(spark):
    texts = [None, "", " ".join("abcdefgh") + " x " + " ".join("abcdefgh"), "go " * 60, "a\nb\na\n \n\n", "#$ |x<>\nthe é\U0001f600 end", " ".join(f"w{i % 11}" for i in range(3000)), "one two three four five six seven", "A B C D E F G H " * 5 + "tail"]
    rows = list(enumerate(texts))
    led = quality_rules.with_verdicts(quality_rules.ledger(table(spark, rows)))
    for r in led.collect():
        want = brute_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_policies_and_ablations(spark):
    names = list(quality_rules.RULES)
    led = table(spark, [(i,) for i in (0, 0, 1, 2, 3, 4, 68)], "failed int")
    kept = quality_rules.apply_policy(led, "v1").where("kept").count()
    assert kept == 2
    got = {r["rule"]: r for r in quality_rules.ablations(led, "v1").collect()}
    assert got["too_short"]["n_failed"] == 2 and got["too_short"]["n_gained_without"] == 1 and got["too_short"]["n_kept_without"] == 3
    assert got["symbols"]["n_gained_without"] == 2 and set(got) == set(quality_rules.POLICIES["v1"]) <= set(names)


def test_lines(spark):
    block = "\n".join(f"line {i} of the shared block" for i in range(40))
    rows = [(1, f"head\n{block}\ntail", "x"), (2, f"other\n\n{block}", "y"), (3, None, "z"), (4, "", "z"), (None, f"{block}", "z"), (5, "single", "z"), (6, "single", "z")]
    df = table(spark, rows, "doc_id long, text string, h string")
    got = {(r["doc_id"], r["h"]): r for r in line_dedup.line_dedup(df).collect()}
    assert got[1, "x"]["text"] == rows[0][1] and got[1, "x"]["__n_removed"] == 0
    assert got[2, "y"]["__n_removed"] > 20 and got[2, "y"]["text"].startswith("other")
    assert set(got[2, "y"]["text"].split("\n")) <= set(rows[1][1].split("\n"))
    assert got[3, "z"]["text"] is None and got[None, "z"]["text"] == block and got[6, "z"]["text"] == "single"
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def without_pairs(texts):
    """By hand: a line goes if it and a neighbour stand together earlier."""
    seen, out = set(), {}
    for d in sorted(texts):
        ls = (texts[d] or "").split("\n")
        gone = set()
        for i, pair in enumerate(zip(ls, ls[1:])):
            gone |= {i, i + 1} if pair in seen else set()
            seen.add(pair)
        out[d] = None if texts[d] is None else ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone))
    return out


def test_passages_amid_other_text(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    passages = [[line() for _ in range(n)] for n in (2, 3, 4, 5) * 10]
    other = lambda: [line() for _ in range(rng.randrange(1, 4))]
    rows, own = [], {}
    for k, p in enumerate(passages):
        for d in (k, 100 + k):
            a, b = other(), other()
            rows.append((d, "\n".join(a + p + b)))
            own[d] = "\n".join(a + p + b if d < 100 else a + b), len(p) * (d >= 100)
    got = {r["doc_id"]: (r["text"], r["__n_removed"]) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == own


def test_pairs_by_hand(spark):
    rng = random.Random(6)
    rows = [(d, "\n".join(rng.choice("abcdef") + str(rng.randrange(5)) for _ in range(rng.randrange(1, 14)))) for d in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, "x\nx\nx"), (204, "x\nx"), (205, "y"), (206, "y")]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    want = without_pairs(dict(rows))
    for d, text in rows:
        assert (None if text is None else (got[d]["text"], got[d]["__n_removed"])) == want[d] and got[d]["__n_lines"] == (0 if text is None else text.count("\n") + 1)
    assert got[200]["text"] is None and got[200]["__n_removed"] == 0


def targets(sizes):
    """source -> target, by raising the water step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        share = sum(weight[s] for s in left)
        rest = total - sum(full.values())
        over = [s for s in left if rest * weight[s] / share > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: full.get(s, rest * weight[s] / share if s in left else 0.0) for s in names}
        full |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, tmp_path):
    found = folder(spark, str(tmp_path), 5, 200)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {d: len(WORD.findall(t or "")) for d, t in found.items()}
    sizes = Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    want = targets(dict(sizes))
    got = mixing.op10_source_mixing(spark, str(tmp_path)).collect()
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    longest = max(size.values())
    assert len(got) == len(found) and all(abs(taken[s] - want[s]) <= 2 * longest for s in want)
    again = mixing.op10_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mix.collect())
    assert all(copies[r["doc_id"]] == r["copies"] for r in got)


def test_mixing_of_nothing(spark):
    empty = table(spark, [], "doc_id long, text string, source string")
    assert mixing.mix_documents(empty).count() == 0
    blank = table(spark, [(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert mixing.mix_documents(blank).count() == 0


def test_normal_text_matches_the_contract():
    assert NORMAL.sub(" ", "a \x0b\x0c b c") == "a b c"
