import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pairlens.llm.graph import components
from pairlens.llm.neardup import Shape, bags, keep_one, near_duplicates, overlap, signatures


def shingles(text, n=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    whole = sum((a | b).values())
    return both / whole if whole else 0.0


def classes(rows, at=0.8):
    """Smallest id of each row's component, by comparing all pairs."""
    bag, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(bag[i], bag[j]) >= at - 1e-9:
                parent[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            best[find(i)] = min(best.get(find(i), doc), doc)
    return [best.get(find(i)) for i in range(len(rows))]


def family(seed):
    """A text, edited copies of it at many distances, and exact copies."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(300)}" for _ in range(pick.randint(30, 120))]
    out = [base]
    for _ in range(12):
        copy = list(pick.choice(out))
        for _ in range(pick.randint(0, 4)):
            copy[pick.randrange(len(copy))] = f"x{pick.randrange(9)}"
        if pick.random() < 0.3:
            copy += copy[: pick.randint(1, 10)]
        out.append(copy)
    return [" ".join(c) for c in out]


def test_bags_hold_counts_and_overlap_is_exact():
    a = ["a b c d e f a b c d e f a b c d e f", "x y", "", None, "one two three four five"]
    b = ["a b c d e f a b c d e f", "x y", "", "z", "one two three four six"]
    left, right = bags(pa.array(a), 5), bags(pa.array(b), 5)
    assert left.weight.tolist() == [sum(shingles(t).values()) for t in a]
    assert overlap(left, right).tolist() == [sum((shingles(x) & shingles(y)).values()) for x, y in zip(a, b)]


def test_signatures_are_unbiased_for_weighted_similarity():
    errors = []
    for seed in range(120):
        pick = random.Random(seed)
        part = lambda n: [f"{seed}-{pick.randrange(6)}" for _ in range(n)]
        one = part(pick.randint(20, 150))
        two = one[: pick.randint(10, len(one))] + part(pick.randint(0, 60))
        a, b = " ".join(one), " ".join(two)
        s = signatures(bags(pa.array([a, b]), 2), 256)
        errors.append(((s[0] == s[1]).mean() - similarity(shingles(a, 2), shingles(b, 2))))
    assert abs(np.mean(errors)) < 4 * np.std(errors) / np.sqrt(len(errors)) + 1e-3
    assert np.std(errors) < 0.04


def test_signatures_do_not_depend_on_what_shares_the_chunk():
    texts = ["a b c d e f g", "q " * 500, "a", " ".join(str(i) for i in range(3000))]
    together = signatures(bags(pa.array(texts), 5), 150)
    for i, t in enumerate(texts):
        assert (signatures(bags(pa.array([t]), 5), 150)[0] == together[i]).all()


def test_classes_against_all_pairs(spark):
    rows = [t for seed in range(12) for t in family(seed)]
    rows = list(enumerate(rows)) + [(900, ""), (901, None), (902, " \n"), (903, "a b"), (904, "a  b"), (905, "b a")]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame([(i, t, "v", 1) for i, t in rows], "doc_id long, text string, vid string, bucket int").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == dict(zip([i for i, _ in rows], classes(rows)))


def test_a_large_group_of_near_copies_is_one_class(spark):
    pick = random.Random(7)
    base = [f"w{pick.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(250):
        copy = list(base)
        for _ in range(3):
            copy[pick.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(base)) for i in range(100)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 350 and {r["class_id"] for r in got} == {0}


def test_odd_rows(spark, odd, odd_rows, none):
    plain = [(r[0], r[1]) for r in odd_rows]
    want = Counter(zip([str(i) for i, _ in plain], classes(plain)))
    assert Counter((str(r["doc_id"]), r["class_id"]) for r in near_duplicates(odd).collect()) == want
    kept = keep_one(odd, odd.columns).collect()
    groups = {c for c in classes(plain)}
    assert len(kept) == len(groups) and {r["doc_id"] for r in kept} == groups
    assert kept[0].asDict().keys() == set(odd.columns)
    assert near_duplicates(none).count() == 0 and keep_one(none, none.columns).count() == 0


def test_shape_sets_the_similarity(spark):
    texts = [(1, " ".join(map(str, range(100)))), (2, " ".join(map(str, [*range(60), *range(200, 240)])))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["class_id"] for r in near_duplicates(df, Shape(similarity=0.35, bands=60, rows=2)).collect()} == {1}
    assert {r["class_id"] for r in near_duplicates(df).collect()} == {1, 2}


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(500, 400), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(7)}, 500: 400, 400: 400}
