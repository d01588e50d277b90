"""Expressions: the three ways to write them, checks and suggestions."""

import pytest

from framequery import DtError, agg, coalesce, col, cut, e, form, if_, op, row, stat, to_string, win, xbar
from framequery.errors import closest, edit_distance
from framequery.expr import columns_of, has_aggregate, has_window


def code(f, *a, **k):
    with pytest.raises(DtError) as x:
        f(*a, **k)
    return x.value.code


@pytest.mark.parametrize("text", [
    "(> :mass 4000)", '(and (>= :m 3.5) (in :s #{"a" "b"}))', "(if (= :x nil) 0 :x)", "(win/lag :x 1 {:fill 0})", "(win/scan * (+ 1 :r))", "(win/each-prior - :x)", "(cut :x 4 :from (= :e 1))",
    "(xbar :t 5 :minutes)", "(row/sum :a :b)", "(stat/winsorize :x 0.05)", "(coalesce-finite :a 0)", "(qnt :x [0.1 0.9])", "(div0 :a :b)", "(- :x)", "N",
])
def test_text_round_trip(text):
    n = e(text)
    assert e(to_string(n)) == n


def test_ways_agree():
    assert (col("m") > 4000) == e("(> :m 4000)") == form(["and", [">", ":m", 4000]]).args[0]
    assert e("(mean :x)") == agg("mn", col("x")) == e("(mn :x)")
    assert 1 - col("d") == e("(- 1 :d)") and ~(col("a") & col("b")) == e("(not (and :a :b))")
    assert win.lag(col("x"), 2, fill=0) == e("(win/lag :x 2 {:fill 0})") and row.any_nil(col("a")) == e("(row/any-nil? :a)")
    assert stat.demean(col("x")) == e("(stat/demean :x)") and if_(col("a"), 1) == e("(if :a 1)") and coalesce(col("a"), 0) == e("(coalesce :a 0)")
    assert cut(col("x"), 3) == e("(cut :x 3)") and xbar("t", 5, "minutes") == e("(xbar :t 5 :minutes)")
    assert col("x").isin([1, None]) == e("(in :x #{1 nil})") and col("x").between(1, 2) == e("(between? :x 1 2)")


def test_let_cond_and_composition():
    assert e("(let [a (+ :x 1) b (* a a)] (- b a))") == e("(- (* (+ :x 1) (+ :x 1)) (+ :x 1))")
    assert e("(cond (> :x 1) 1 :else 2)") == e("(if (> :x 1) 1 2)")
    heavy = e("(> :m 5)")
    assert e("(and heavy :k)", heavy=heavy) == e("(and (> :m 5) :k)")
    n = e("(win/mdev (- (win/ratio :price) 1) 20)")
    assert columns_of(n) == ["price"] and has_window(n) and not has_aggregate(n) and has_aggregate(e("(> :x (mn :x))"))


def test_errors():
    assert code(e, "(meen :x)") == "unknown-op"
    with pytest.raises(DtError) as x:
        e("(meann :x)")
    assert "mean" in x.value.data["suggestions"]
    assert code(e, "(win/lagg :x 1)") == "unknown-win-op" and code(e, "(row/summ :x)") == "unknown-row-op" and code(e, "(stat/z :x)") == "unknown-stat-op"
    assert code(e, "(win/scan / :x)") == "win-scan-unknown-op" and code(e, "(win/each-prior ^ :x)") == "each-prior-unknown-op"
    assert code(e, "(+ :x nil)") == "arith-nil-literal" and code(e, "(and)") == "wrong-arity" and code(e, "(wavg :x)") == "wrong-arity"
    assert code(form, ["frob", ":x"]) == "unknown-data-op" and code(form, [1, 2]) == "invalid-data-op" and code(form, ["mn", ":x"], True) == "unknown-data-op"
    assert form(["+", ":x", None]) == op("+", col("x"), None, check=False)
    assert code(e, "(> :x 1") == "unreadable" and code(e, "(> :x 1) (> :y 1)") == "unreadable"


def test_distance():
    assert edit_distance("ca", "ac") == 1 and edit_distance("kitten", "sitting") == 3 and closest("spceies", ["year", "species"], 3) == ["species"]
