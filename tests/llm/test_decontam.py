import pickle
import random
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pairlens.llm import decontam
from pairlens.llm.decontam import Automaton, Limits, decontaminate, find_contamination, union
from pairlens.llm.text import ALNUM, LOWER, words

ITEMS = "item_id long, text string, hits string, found string"


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, window):
    w, hit, found = plain(text), set(), set()
    for item, body in items:
        words_ = plain(body)
        n = min(window, len(words_))
        grams = {tuple(words_[i : i + n]) for i in range(len(words_) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in grams:
                hit |= set(range(j, j + n))
                found.add(item)
    return len(w), hit, found


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text(alphabet="abc ", min_size=1, max_size=18), min_size=1, max_size=5),
    st.lists(st.text(alphabet="abcd ", max_size=40), min_size=1, max_size=4),
    st.integers(2, 5),
)
def test_the_automaton_finds_all_windows(items, docs, window):
    numbered = list(enumerate(items))
    automaton = Automaton([(i, [x.encode() for x in plain(t)]) for i, t in numbered], window)
    w = words(pa.array(docs), ALNUM, LOWER)
    hits, found = [set() for _ in docs], [set() for _ in docs]
    for at, tokens in automaton.segments(w):
        spans, ids, longest = automaton.stream(tokens)
        doc = max(i for i in range(len(docs)) if w.first[i] <= at)
        hits[doc] |= {p + at - int(w.first[doc]) for a, b in union(spans) for p in range(a, b)}
        found[doc] |= ids
        assert longest >= max((b - a for a, b in spans), default=0)
    for i, text in enumerate(docs):
        assert (len(plain(text)), hits[i], found[i]) == brute(text, numbered, window)


def bench(odd_rows):
    w = odd_rows[0][1].split()
    return [
        (1, " ".join(w[30:60]), "", ""), (2, "ONE, two; Three!", "", ""), (3, None, "", ""), (4, "", "", ""), (5, " ".join(w[100:109]), "", ""),
        (None, " ".join(w[200:215]), "", ""), (1, " ".join(w[30:60]), "", ""), (10, "same same same same same same same same same same", "", ""), (11, "unseen " * 12, "", ""),
    ]


def test_documents_against_brute_force(spark, odd, odd_rows):
    items = bench(odd_rows)
    known = [(i, t) for i, t, *_ in items]
    for shard in (5, 10_000):  # many automata, or one
        got = find_contamination(odd, spark.createDataFrame(items, ITEMS), ["doc_id", "key"], window=10, shard_words=shard).collect()
        assert len(got) == len(odd_rows)
        by_text = {r[1]: brute(r[1], known, 10) for r in odd_rows}
        for r in got:
            n, hit, found = by_text[r["text"]]
            assert r["n_words"] == n
            assert {p for s in r["hits"] for p in range(s["start"], s["end"])} == hit
            assert set(r["found"]) == found - {None}


def test_empty_tables(spark, odd, none, odd_rows):
    items = spark.createDataFrame(bench(odd_rows), ITEMS)
    assert find_contamination(none, items).count() == 0
    assert find_contamination(odd, items.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate(none, items).count() == 0


def test_spans_are_cut_and_covered_documents_go(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    clean = "Étude: clean, text — untouched…\n"
    rows = [(1, f"Before it. {passage.upper()}! After it, " + "more words " * 30), (2, passage + " end"), (3, clean), (4, None), (5, ""), (6, " ".join(passage.split()[:9]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate(df, items).collect()}
    assert got == {1: "Before it. ! After it, " + "more words " * 30, 3: clean, 4: None, 5: "", 6: rows[5][1]}
    assert 2 in {r["doc_id"] for r in decontaminate(df, items, limits=Limits(coverage=1.0)).collect()}


def test_random_texts(spark):
    pick = random.Random(9)
    gen = lambda n: " ".join(pick.choice(["a", "b", "c", "the"]) for _ in range(n))
    items = [(i, gen(pick.randint(1, 25))) for i in range(6)] + [(50, gen(12))]
    docs = [(i, gen(pick.randint(0, 80))) for i in range(60)]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], window=10).collect()
    for r in got:
        n, hit, found = brute(dict(docs)[r["doc_id"]], items, 10)
        assert (r["n_words"], {p for s in r["hits"] for p in range(s["start"], s["end"])}, set(r["found"])) == (n, hit, found)


def test_a_whole_short_item_is_cut_from_a_long_document(spark):
    short = "what is the capital city of northern france"
    rows = [(1, "filler text " * 40 + short + "? " + "more words " * 40), (2, "clean " * 30 + "yes it is " * 3), (3, "clean " * 30 + "what is the capital city of northern spain")]
    items = spark.createDataFrame([(1, short), (2, "yes"), (3, "of whom")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1: "filler text " * 40 + "? " + "more words " * 40, 2: rows[1][1], 3: rows[2][1]}


def test_fifty_shards_equal_one_and_ids_may_be_texts(spark):
    pick = random.Random(11)
    items = [(f"item{i:03d}", " ".join(f"w{pick.randrange(400)}" for _ in range(pick.choice([3, 12, 30])))) for i in range(60)]
    docs = [(i, " ".join([f"v{pick.randrange(90)}" for _ in range(20)] + items[i][1].split() + [f"v{pick.randrange(90)}" for _ in range(5)])) for i in range(0, 60, 4)]
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    size = sum(len(t.split()) for _, t in items)
    want = [tuple(r) for r in find_contamination(frame, table, shard_words=size).orderBy("doc_id").collect()]
    assert [r[4] for r in want] == [[items[i][0]] for i, _ in docs]
    assert decontam.automata(table, "item_id", "text", 10, size // 8).count() >= 7
    assert [tuple(r) for r in find_contamination(frame, table, shard_words=size // 8).orderBy("doc_id").collect()] == want


def test_many_shards_hold_one_automaton_each(spark):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(200)], "item_id int, text string")
    built = decontam.automata(items, "item_id", "text", 10, 16).collect()
    sizes = [len(pickle.loads(zlib.decompress(r["data"])).vocabulary) for r in built]
    assert len(built) >= 40 and sum(sizes) == 800 and max(sizes) <= 60


def test_names_that_the_search_uses_are_refused(spark):
    frame = spark.createDataFrame([(1, "x", 2)], "doc_id int, text string, hits int")
    with pytest.raises(ValueError, match="hits"):
        decontam.decontaminate(frame, spark.createDataFrame([], "item_id int, text string"), columns=["doc_id", "text", "hits"])
    # Without items nothing is found, and words are counted.
    got = find_contamination(frame.drop("hits"), spark.createDataFrame([], "item_id int, text string")).first()
    assert (got["n_words"], got["hits"], got["found"]) == (1, [], [])
