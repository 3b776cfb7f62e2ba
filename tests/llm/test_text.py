import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from pairlens.llm import text as t

PATTERNS = {"blank": (t.BLANK, t.SAME, r"[^\x20\x09-\x0D]+"), "alnum": (t.ALNUM, t.LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.-Z9\x85", max_size=40)), max_size=8), st.sampled_from(sorted(PATTERNS)), st.sampled_from([3, 17, 1 << 20]))
def test_words_are_the_pattern_s_matches(texts, kind, piece):
    word, fold, pattern = PATTERNS[kind]
    old, t.PIECE = t.PIECE, piece
    try:
        w = t.words(pa.array(texts, pa.string()), word, fold)
    finally:
        t.PIECE = old
    names = {}
    for i, text in enumerate(texts):
        folded = (text or "") if kind == "blank" else re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        want = [m.group().encode() for m in re.finditer(pattern, folded)]
        at = range(w.first[i], w.first[i + 1])
        assert [fold[w.data[w.start[k] : w.end[k]]].tobytes() for k in at] == want
        for k, spelled in zip(at, want):
            assert names.setdefault(spelled, w.hash[k]) == w.hash[k]
    assert len(set(names.values())) == len(names)


def test_run_hashes_are_equal_for_equal_runs_only():
    h = np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64)
    h[200:260] = h[40:100]
    for n in (5, 50):
        g = t.run_hashes(h, n)
        assert (g[200 : 260 - n + 1] == g[40 : 100 - n + 1]).all()
        assert len(set(g.tolist())) == len(g) - (60 - n + 1)


def test_chunks_hold_all_rows():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 100, 3, 3)] + [None])], names=["text"])
    parts = list(t.chunks(batch, "text", limit=8))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


def test_long_texts_take_memory_in_proportion_to_their_words():
    tracemalloc.start()
    t.words(pa.array([("abcdefghi " * 1_600_000)]), t.BLANK)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 260e6


def test_a_word_longer_than_a_piece_and_the_look_ahead_stays_whole(monkeypatch):
    texts = pa.array(["ab " + "x" * (3 * t.AHEAD + 7) + " cd", "y" * (2 * t.AHEAD), "z"])
    want = t.words(texts, t.BLANK)
    monkeypatch.setattr(t, "PIECE", 16)
    got = t.words(texts, t.BLANK)
    assert (got.end - got.start).tolist() == [2, 3 * t.AHEAD + 7, 2, 2 * t.AHEAD, 1]
    assert got.hash.tolist() == want.hash.tolist()
