import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, bucket string, text_a string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n, words=WORDS):
    pick = random.Random(seed)
    return " ".join(pick.choice(words) for _ in range(n))


def doc(i, text, source="a"):
    # The last columns carry names that the operators use inside.
    return (i, text, "en", source, None if text is None else len(text), "x", "y", "z", "t")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    base = prose(1, 300)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    long = prose(2, 30_000)
    rows = [
        doc(1, base), doc(2, base, "b"), doc(3, near, "a"), doc(4, prose(3, 300), "c"), doc(5, "", "a"), doc(6, None, "b"),
        doc(7, "   \n", None), doc(8, long, "a"), doc(9, "same " * 200, "b"), doc(10, "same " * 150, "c"), doc(11, "one two three", None),
        doc(12, prose(4, 40) + " " + " ".join(words[20:120]) + " " + prose(5, 40), "d"), doc(4, prose(3, 300), "c"),
        doc(None, base, "a"), doc(None, None, None), doc(13, "é ü ß 東京 " * 20 + "x" * 5000, "d"),
    ]
    return rows + [(14, prose(6, 60), None, None, None, None, None, None, None)]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
