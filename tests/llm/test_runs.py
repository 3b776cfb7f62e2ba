import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from pairlens.llm.grammar import Grammar
from pairlens.llm.runs import find, find_runs, joined, kept_words, longest
from pairlens.llm.text import BLANK, SAME, words


def brute(w, repeats=4, least=6):
    """(start, length, period) of all runs, period by period."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            k = i
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k > i and k - i + q >= max(least, repeats * q):
                found.setdefault((i, k + q - i), q)
            i = k + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def patchwork(pick, size, vocabulary):
    w = []
    while len(w) < size:
        kind = pick.random()
        period = [str(pick.randrange(vocabulary)) for _ in range(pick.randint(1, 9))]
        if kind < 0.6:
            n = pick.randint(1, 8 * len(period))
            w += (period * 9)[:n]
        elif kind < 0.7:
            w += (period * 5 + period[:1]) * pick.randint(1, 5)
        else:
            w += [str(pick.randrange(vocabulary * 50)) for _ in range(pick.randint(1, 12))]
    return w[:size]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 3, 30]))
def test_runs_against_brute_force(seed, vocabulary):
    pick = random.Random(seed)
    texts = [patchwork(pick, pick.randint(0, 120), vocabulary) for _ in range(pick.randint(1, 6))]
    w = words(pa.array([" ".join(t) for t in texts]), BLANK, SAME)
    repeats, least = pick.choice([(4, 6), (2, 2), (3, 9)])
    runs = find(w, repeats, least)
    for i, t in enumerate(texts):
        mine = runs.doc == i
        got = list(zip(runs.start[mine].tolist(), runs.length[mine].tolist(), runs.period[mine].tolist()))
        assert got == brute(t, repeats, least)
    out = joined(w, kept_words(w, runs)).to_pylist()
    assert out == [collapsed(t, brute(t, repeats, least)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 5, 400]))
def test_extensions_against_brute_force(seed, vocabulary):
    rng = np.random.default_rng(seed)
    body = rng.integers(0, vocabulary, rng.integers(1, 300))
    s = np.concatenate(([vocabulary], body, [vocabulary + 1]))
    grammar = Grammar(np.unique(s, return_inverse=True)[1])
    i, j = rng.integers(1, len(s), 200), rng.integers(1, len(s), 200)
    i, j = i[i != j], j[i != j]
    ahead, behind = grammar.forward(i, j), grammar.backward(i, j)
    for a, b, f, g in zip(i, j, ahead, behind):
        assert (s[a : a + f] == s[b : b + f]).all() and s[a + f] != s[b + f]
        assert (s[a - g : a] == s[b - g : b]).all() and s[a - g - 1] != s[b - g - 1]


def test_the_grammar_is_short_and_equal_symbols_spell_equal_words():
    s = np.concatenate(([2], np.tile([0, 1, 0], 20_000), [3]))
    grammar = Grammar(s)
    assert len(grammar.levels) < 80 and len(grammar.levels[-1].name) < 60
    # Every occurrence of a symbol spans as many words.
    span = np.arange(len(s) + 1)
    for level in grammar.levels[:-1]:
        span = span[level.first]
    assert span[0] == 0 and span[-1] == len(s)


def test_rows(spark, odd, odd_rows, none):
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in find_runs(odd).collect())
    want = []
    for r in odd_rows:
        w = (r[1] or "").split()
        # The very long text is random words: brute force on short periods is enough, and longer ones cannot fit.
        runs = brute(w) if len(w) < 5000 else []
        want.append((str(r[0]), len(w), runs, collapsed(w, runs)))
    assert got == sorted(want)
    assert find_runs(none).count() == 0 and find_runs(none).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_grid_points_that_agree_across_texts():
    """Few words that recur at fixed places in many texts, so that agreeing grid points run from text to text."""
    pick = random.Random(3)
    for size in (7, 11, 24):
        texts = [["same" if k % 6 == 0 else f"u{pick.randrange(10**6)}" for k in range(size - 1)] for _ in range(40)]
        texts[17] = (["a", "b"] * size)[:size]
        w = words(pa.array([" ".join(t) for t in texts] + ["long " + " ".join(f"v{i}" for i in range(400))]), BLANK, SAME)
        runs = find(w)
        got = list(zip(runs.doc.tolist(), runs.start.tolist(), runs.length.tolist(), runs.period.tolist()))
        assert got == [(i, *r) for i, t in enumerate(texts) for r in brute(t)]


def test_a_very_long_text_with_planted_runs(spark):
    pick = random.Random(8)
    free = [f"u{i}" for i in range(60_000)]
    period = [f"p{i}" for i in range(700)]
    w = free[:20_000] + (period * 6)[:3600] + free[20_000:] + ["x"] * 30_000 + ["y", "x"] * 5000
    rows = find_runs(spark.createDataFrame([("a", " \n".join(w)), ("b", " ".join(pick.sample(free, 100)))], "id string, body string"), "id", "body").collect()
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in rows}
    at = 20_000 + 3600 + 40_000
    assert got == {"a": [(20_000, 3600, 700), (at, 30_000, 1), (at + 29_999, 10_001, 2)], "b": []}
    best = find_runs(spark.createDataFrame([(1, "a a a a a a b c b c b c b c c")], "doc_id int, text string")).select(longest("runs").alias("best")).first()[0]
    assert tuple(best) == (6, 8, 2)
