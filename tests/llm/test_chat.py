import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairlens.llm.chat import LAYOUTS, Layout, Template, digest, format_chats, masked_text, to_turns
from pairlens.llm.chat_query import as_records

RECORD = (
    "id long, turns string, record struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string>>,"
    "prompt:string,response:string,system:string,instruction:string,input:string,output:string,other:string>"
)
M, C, P, R, S, I, IN, O, X = range(9)


def record(**fields):
    names = ("messages", "conversations", "prompt", "response", "system", "instruction", "input", "output", "other")
    return tuple(fields.get(n) for n in names)


ROWS = [
    (1, record(messages=[("user", "hi"), ("assistant", "yo")]), "messages", [("user", "hi"), ("assistant", "yo")]),
    (2, record(conversations=[("human", "hi"), ("gpt", "yo"), ("tool", "t")]), "from_value", [("user", "hi"), ("assistant", "yo"), ("tool", "t")]),
    (3, record(prompt="p", response="r"), "prompt_response", [("user", "p"), ("assistant", "r")]),
    (4, record(system="s", prompt="p", response="r"), "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    (5, record(instruction="i", input="n", output="o"), "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    (6, record(instruction="i", output=""), "instruction", [("user", "i"), ("assistant", "")]),
    (7, record(messages=[]), "messages", []),
    (8, record(messages=[(None, None)]), "messages", [("", "")]),
    (9, record(prompt="p"), None, None),
    (10, record(prompt="p", response="r", other="?"), None, None),
    (11, record(), None, None),
]


def test_layouts_are_found_by_fingerprint(spark):
    df = spark.createDataFrame([(i, "clash", r) for i, r, _, _ in ROWS], RECORD)
    got = {r["id"]: (r["layout"], None if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in to_turns(df, ["id"]).collect()}
    assert got == {i: (layout, turns) for i, _, layout, turns in ROWS}


def test_unknown_layouts_have_null_output_and_stay(spark):
    df = spark.createDataFrame([(i, "clash", r) for i, r, _, _ in ROWS], RECORD)
    made = {r["id"]: r for r in format_chats(df, ["id"]).collect()}
    assert len(made) == len(ROWS) and made[9]["formatted"] is None and made[9]["loss_spans"] is None
    assert made[7]["formatted"] == "" and made[7]["loss_spans"] == []
    assert format_chats(df.limit(0), ["id"]).count() == 0


def test_fingerprints_of_layouts_differ():
    prints = [f for layout in LAYOUTS for f in layout.fingerprints()]
    assert len(prints) == len(set(prints)) and digest(["a", "b"]) == digest(["b", "a"])
    assert len(Layout("x", ("a",), ("b", "c")).fingerprints()) == 4


def test_templates_without_a_control_in_a_mark_are_refused():
    with pytest.raises(ValueError):
        Template(end="\n")
    with pytest.raises(ValueError):
        Template(controls=("<s>", "a\\b"))


PARTS = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\0", "\\1", "a", "<", "/s>", "é", "\n", "0"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[INST]", ""]), PARTS), max_size=4), min_size=1, max_size=12))
def test_formatting_is_reversible(spark, chats):
    template = Template()
    df = spark.createDataFrame([(i, "", record(messages=c)) for i, c in enumerate(chats)], RECORD)
    made = format_chats(df, ["id"], template=template)
    made = made.select("id", "formatted", template.parse(F.col("formatted")).alias("back"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in made.collect():
        turns = chats[r["id"]]
        assert [tuple(t) for t in r["back"]] == turns
        assert r["loss"] == "".join(text for role, text in turns if role == "assistant")
        assert r["formatted"].count("</s>") == len(turns) and r["formatted"].count("[/INST]") == len(turns)


def test_conversations_keep_turns_in_order_whatever_layout_they_take(spark):
    lines = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "s"), (2, 1, "user", "a"), (2, 2, "assistant", None), (3, 2, "user", "z"), (3, 0, "user", "x"), (3, 1, "assistant", "y")]
    lines += [(4, 0, None, None), (None, 1, "user", "n"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a")]
    df = spark.createDataFrame(lines, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in format_chats(as_records(df), ["conv_id"]).collect()}
    assert got[1] == ("prompt_response", [("user", "a"), ("assistant", "b")])
    assert got[2] == ("prompt_response", [("system", "s"), ("user", "a"), ("assistant", "")])
    assert got[3] == ("from_value", [("user", "x"), ("assistant", "y"), ("user", "z")])
    assert got[4] == ("messages", [("", "")]) and got[None][1] == [("user", "n")]
    assert got[5] == ("from_value", [("user", "a"), ("user", "a"), ("user", "b")])
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ""), 256)).first()[0]
