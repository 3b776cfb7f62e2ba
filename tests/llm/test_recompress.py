import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairlens.llm.recompress import anchors, dedup_substrings, parse, windows
from pairlens.llm.skew import join_counted
from pairlens.llm.text import BLANK, SAME, words


def brute(rows, n):
    first = {}
    for doc, text in rows:
        w = (text or "").split()
        for i in range(len(w) - n + 1):
            if doc is not None:
                g = tuple(w[i : i + n])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = (text or "").split(), set()
        for i in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[i : i + n])] < doc:
                gone |= set(range(i, i + n))
        out.append((str(doc), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def mosaic(seed, docs, length, vocabulary):
    """Texts made of shared passages, shifted, nested, repeated and inside long runs."""
    pick = random.Random(seed)
    pool = [[f"{pick.randrange(vocabulary)}" for _ in range(pick.randint(length // 2, 4 * length))] for _ in range(6)]
    rows = []
    for i in range(docs):
        w = []
        for _ in range(pick.randint(0, 4)):
            kind = pick.random()
            if kind < 0.5:
                p = pick.choice(pool)
                a = pick.randrange(len(p))
                w += p[a : a + pick.randint(1, len(p))]
            elif kind < 0.7:
                w += ["run"] * pick.randint(1, 3 * length)
            elif kind < 0.8:
                w += ["ab", "cd", "ef"] * pick.randint(1, length)
            else:
                w += [f"u{pick.randrange(10**9)}" for _ in range(pick.randint(1, length))]
        rows.append((i, " ".join(w)))
    return rows


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([8, 20, 50]), st.sampled_from([1, 2, 3, 1000]))
def test_equal_windows_have_equal_anchors(seed, length, vocabulary):
    w = words(pa.array([t for _, t in mosaic(seed, 8, length, vocabulary)]), BLANK, SAME)
    at, anchor, one, two = anchors(w, length)
    seen = {}
    for k, i in enumerate(at):
        assert seen.setdefault(tuple(w.hash[i : i + length].tolist()), (anchor[k], one[k], two[k])) == (anchor[k], one[k], two[k])
    assert len({x[1] for x in seen.values()}) == len(seen)


def test_symbols_partition_the_words_and_carry_what_decides_them():
    w = words(pa.array([t for _, t in mosaic(3, 20, 50, 40)]), BLANK, SAME)
    s = parse(w)
    assert s.start[0] == 0 and s.end[-1] == len(w.hash) and (s.start[1:] == s.end[:-1]).all()
    assert (s.low <= s.start).all() and (s.high >= s.end).all()
    assert (w.doc[s.start] == w.doc[s.end - 1]).all()


def test_most_windows_are_decided_by_symbols():
    w = words(pa.array([" ".join(f"u{i * 7919 % 1000}" for i in range(5000))]), BLANK, SAME)
    at, anchor, one, _ = anchors(w, 50)
    assert len(np.unique(anchor)) < 0.2 * len(at) and len(windows(w, 50)[0]) == len(at) == 4951 and len(one) == 4951


def test_removed_words_against_brute_force(spark):
    for seed, vocabulary in ((1, 1000), (2, 3)):
        rows = mosaic(seed, 40, 50, vocabulary)
        rows += [(100, rows[5][1]), (101, rows[5][1]), (50, rows[7][1] + " tail"), (60, None), (61, ""), (62, " \n")]
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, anchor string, repeats string").repartition(4)
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(df).collect())
        assert got == brute(rows, 50)


def test_odd_rows(spark, odd, odd_rows, none):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(odd).collect())
    assert got == brute([(r[0], r[1]) for r in odd_rows], 50)
    assert dedup_substrings(none).count() == 0


def test_a_hot_key_joins_where_its_rows_are(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k % 2 = 0").withColumn("w", F.col("k") * 2)
    got = sorted(tuple(r) for r in join_counted(rows, keyed, ["k"]).select("k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in rows.join(keyed, "k").select("k", "v", "w").collect()) and len(got) == 6000
