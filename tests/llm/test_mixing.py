import random

import pytest

from pairlens.llm.mixing import mix_sources, take_mix

SCHEMA = "doc_id long, text string, source string, size long, h long, skey string, bucket long"


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Fill by rounds, as the definition says."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, got, free = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        give = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            got[s] += give[s]
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                free.discard(s)
    return got


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x", 3) for i, t, s in rows], SCHEMA).repartition(3)


def test_targets_and_words_taken(spark):
    pick = random.Random(5)
    rows = [(i, "w " * pick.randint(0, 30), pick.choice(["a", "b", "b", "b", "b", "é", "Z", None])) for i in range(900)]
    rows += [(5000, None, "b"), (5001, "", None), (5002, "only blanks\t\n", "zero"), (None, "no id", "a"), (3, rows[3][1], rows[3][2])]
    got = mix_sources(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in got:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest.get(s, 0), r["size"])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mix_sources(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_one_document_per_source_and_zero_sizes(spark):
    rows = [(1, "a b c d", "x"), (2, "", "y"), (3, None, None)]
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mix_sources(docs_of(spark, rows)).collect()}
    assert got == {1: (4, 4, 6.0, 8), 2: (0, 0, 0.0, 0), 3: (0, 0, 0.0, 0)}
    assert mix_sources(docs_of(spark, rows).where("doc_id > 9")).collect() == []
    assert {r["taken"] for r in mix_sources(docs_of(spark, rows[1:])).collect()} == {0}


def test_taken_rows_are_those_of_the_mix(spark, odd):
    want = sorted((str(r["doc_id"]), r["copies"]) for r in mix_sources(odd).where("copies > 0").collect())
    got = take_mix(odd, ["doc_id", "text", "key"])
    assert got.columns == ["doc_id", "text", "key", "copies"]
    assert sorted((str(r["doc_id"]), r["copies"]) for r in got.collect()) == want
