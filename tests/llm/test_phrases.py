import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pairlens.llm import phrases as P
from pairlens.llm.automata import Trie, compose, cut, from_paths, minimal, pack, prefix_range, prune, union, unpack
from pairlens.llm.phrases import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))]


def brute(rows, longest=3, least=10, inside=50, top=2000):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for w in pieces(text):
            total[lang] += len(w)
            for n in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cand.items():
            around = [b for h, b in cand.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * b >= inside * a for b in around):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def chatter(seed, docs, langs=("en", "de", None)):
    pick = random.Random(seed)
    fixed = ["New York", "red hot chili", "as well As", "état d'âme"]
    rows = []
    for _ in range(docs):
        w = [pick.choice(fixed) if pick.random() < 0.3 else f"w{min(pick.randrange(40), pick.randrange(40))}" for _ in range(pick.randint(0, 60))]
        rows.append(("".join(x + pick.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "!x "]) for x in w), pick.choice(langs)))
    return rows


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, data string, range int, w0 long")
    return sorted(tuple(r) for r in collocations(frame.repartition(3), **kw).collect())


@pytest.mark.parametrize("longest, least, inside, top", [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 4, 80, 40)])
def test_phrases_against_brute_force(spark, monkeypatch, longest, least, inside, top):
    rows = chatter(longest, 150) + [(None, "en"), ("", "fr"), (" .,\n", "es"), ("rare words only", "it"), ("Big Deal " * 400, "en")]
    want = brute(rows, longest, least, inside, top)
    assert want and run(spark, rows, longest=longest, least=least, inside=inside, top=top) == want


def test_small_shards_and_ranges_change_nothing(spark, monkeypatch):
    rows = chatter(9, 80)
    monkeypatch.setattr(P, "RANGE_BYTES", 200)
    assert run(spark, rows, least=5) == brute(rows, least=5)


def test_without_a_list_length_all_phrases_come(spark):
    rows = chatter(5, 60, ("en",))
    got = run(spark, rows, least=4, top=None)
    assert sorted((r[0], *r[2:]) for r in got) == sorted((r[0], *r[2:]) for r in brute(rows, least=4, top=10**9)) and {r[1] for r in got} == {None}


def test_odd_rows(spark, odd, odd_rows, none):
    got = sorted(tuple(r) for r in collocations(odd).collect())
    assert got == brute([(r[1], r[2]) for r in odd_rows])
    assert collocations(none).count() == 0


def test_one_very_long_text(spark):
    rows = [("a b " * 100_000 + "c d " * 12, "en")]
    assert run(spark, rows) == brute(rows)


def test_products_beyond_64_bits_are_exact(spark):
    rows = [(2, a, l, r, 0, 0) for a, l, r in ((4 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 9), (3, 10**15, 7), (10**15 - 1, 10**15, 10**15))]  # noqa: E741
    rows.append((3, 10**12, 2 * 10**12, 10**12, 10**12, 2 * 10**12))
    frame = spark.createDataFrame(rows, "size int, a long, left1 long, right1 long, left2 long, right2 long")
    got = [tuple(r[0]) for r in frame.select(P._best_cut(3)).collect()]
    want = [(10**6 * a * a // (l * r), 1, l, r) for _, a, l, r, *_ in rows]  # noqa: E741
    assert got == want


def tries(seed, count, depth=3, symbols=12):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        paths = Counter()
        for _ in range(rng.randint(1, 150)):
            p = tuple(rng.randrange(1, symbols) for _ in range(depth))
            paths.update(p[:k] for k in range(1, depth + 1))
        out.append(paths)
    return out


def spelled_out(trie):
    out, paths = {}, [()]
    for level in trie.levels:
        paths = [(*paths[p], label) for p, label in zip(level.parent.tolist(), level.label.tolist())]
        out |= dict(zip(paths, level.weight.tolist()))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_automata(seed):
    made = tries(seed, 4)
    whole = sum(made, Counter())
    parts = [from_paths(dict(p), 3) for p in made]
    for t, p in zip(parts, made):
        again, head = unpack(pack(t, langs={"1": "x"}))
        assert spelled_out(again) == dict(p) and head == {"langs": {"1": "x"}}
    both = union(parts)
    assert spelled_out(both) == dict(whole)
    low = prune(union(parts), 5)
    assert spelled_out(low) == {p: n for p, n in whole.items() if n >= 5}
    asked = [p for p in whole] + [(99,), (1, 99), (1, 1, 99), (1, 2, 3)]
    columns = [np.array([p[d] if d < len(p) else 0 for p in asked], dtype=np.uint64) for d in range(3)]
    assert compose(both, columns, np.array(list(map(len, asked)))).tolist() == [whole.get(p, 0) for p in asked]


def test_cut_parts_unite_to_the_whole():
    paths = sum(tries(3, 3, depth=4, symbols=9), Counter())
    trie = from_paths(dict(paths), 4)
    trie.texts = pa.array([str(x).encode() for x in trie.levels[1].label.tolist()], pa.binary())
    parts = dict(cut(trie, 3))
    assert len(parts) > 3
    whole = spelled_out(union(list(parts.values())))
    # Level 0 counts single words, so it adds up to them.
    first = Counter()
    for p, n in paths.items():
        if len(p) == 2:
            first[p[:1]] += n
    assert whole == {p: (first[p] if len(p) == 1 else n) for p, n in paths.items()}
    for r, part in parts.items():
        ones = part.levels[1]
        home = prefix_range(ones.label, None, 3) == r
        assert ((ones.weight > 0) == home).all()
        assert part.texts.to_pylist() == [str(x).encode() if h else None for x, h in zip(ones.label.tolist(), home)]


def test_equal_continuations_are_one_state():
    words = [(1, a, b) for a in range(100) for b in (5, 6)]
    paths = Counter(p[:k] for p in words for k in (1, 2, 3))
    states = minimal(from_paths(dict(paths), 3))
    assert [len(s.first) - 1 for s in states] == [1, 1, 1]
    assert isinstance(from_paths({}, 3), Trie) and spelled_out(unpack(pack(from_paths({}, 3)))[0]) == {}
