"""Chat formatting: schema fingerprints select mappings to canonical turns. DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Layout:
    """How records of one layout become turns.

    ``required`` and ``optional`` are nested field paths (``a.b``, ``a[]``, ``a[].b``); a record has this
    layout if its non-null paths are the required ones and some of the optional ones.  Either
    ``array`` names a list of messages with their ``role`` and ``text`` fields, or ``flat``
    lists (role, paths): each of these roles gives a turn if one of its paths is there, their
    texts joined by an empty line.  ``roles`` renames roles.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> list[str]:
        found = []
        for n in range(len(self.optional) + 1):
            found += [digest(self.required + more) for more in combinations(self.optional, n)]
        return found


#: The layouts that public chat, instruction and completion sets use.
LAYOUTS = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), array="messages", role="role", text="content"),
    Layout(
        "from_value", ("conversations[]",), ("conversations[].from", "conversations[].value"), array="conversations", role="from", text="value",
        roles={"human": "user", "gpt": "assistant"},
    ),
    Layout(
        "prompt_response", ("prompt", "response"), ("system",),
        flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    ),
    Layout(
        "instruction", ("instruction", "output"), ("system", "input"),
        flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
)


def digest(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def present_paths(record: str, schema: T.StructType) -> list[tuple[str, Column]]:
    """(path, is it there in this row) for every leaf and list of a nested record."""
    found = []

    def walk(path: str, kind: T.DataType, value, any_of) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{path}.{f.name}" if path else f.name, f.dataType, lambda x, n=f.name: value(x)[n], any_of)
        elif isinstance(kind, T.ArrayType):
            found.append((f"{path}[]", any_of(lambda x: value(x).isNotNull())))
            inner = lambda test: any_of(lambda x: F.coalesce(F.exists(value(x), test), F.lit(False)))
            if isinstance(kind.elementType, T.StructType):
                walk(f"{path}[]", kind.elementType, lambda x: x, inner)
        else:
            found.append((path, any_of(lambda x: value(x).isNotNull())))

    walk("", schema, lambda x: x, lambda test: test(F.col(record)))
    return sorted(found)


def fingerprint(record: str, schema: T.StructType) -> Column:
    """SHA-256 over the sorted non-null field paths of a record; equal for records of one layout."""
    paths = [F.when(there, F.lit(path)) for path, there in present_paths(record, schema)]
    return F.sha2(F.concat_ws("\n", *paths), 256)


def _field(record: str, path: str, schema: T.StructType) -> Column | None:
    kind, col = schema, F.col(record)
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return None
        kind, col = kind[name].dataType, col[name]
    return col


def _turns(layout: Layout, record: str, schema: T.StructType) -> Column | None:
    """The canonical turns of records of this layout, or None where the schema cannot hold it."""
    def renamed(role: Column) -> Column:
        out = F.coalesce(role.cast("string"), F.lit(""))
        for old, new in layout.roles.items():
            out = F.when(role == old, F.lit(new)).otherwise(out)
        return out

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    if layout.array:
        messages = _field(record, layout.array, schema)
        if messages is None:
            return None
        kind = schema
        for name in layout.array.split("."):
            kind = kind[name].dataType
        names = kind.elementType.fieldNames() if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else []
        if layout.role not in names or layout.text not in names:
            return None
        return F.transform(messages, lambda m: turn(renamed(m[layout.role]), m[layout.text])).cast(TURNS)
    turns = []
    for role, paths in layout.flat:
        cols = [c for c in (_field(record, p, schema) for p in paths) if c is not None]
        if cols:
            there = cols[0].isNotNull()
            for c in cols[1:]:
                there = there | c.isNotNull()
            turns.append(F.when(there, turn(F.lit(role), F.concat_ws("\n\n", *cols))))
    return F.array_compact(F.array(*turns)).cast(TURNS) if turns else None


@dataclass(frozen=True)
class Template:
    """Marks around a turn.  ``controls`` are all strings that may not occur inside a role or text.

    Inside, a backslash becomes ``\\0`` and the i-th control string ``\\1``, ``\\2`` ...; every
    backslash of the output is followed by its code, so reading the codes back in any order
    restores the text, and no control string is left inside it.
    """

    start: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    CODES = "123456789abcdefghijklmnopqrstuvwxyz"

    def __post_init__(self):
        if len(self.controls) > len(self.CODES) or any("\\" in c or not c for c in self.controls):
            raise ValueError("control strings must be few, not empty and without a backslash")
        for mark in (self.start, self.middle, self.end):
            if not any(c in mark for c in self.controls):
                raise ValueError(f"the mark {mark!r} holds no control string, so a text could hold it")

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\0"))
        for code, control in zip(self.CODES, self.controls):
            out = F.replace(out, F.lit(control), F.lit("\\" + code))
        return out

    def unescape(self, text: Column) -> Column:
        out = text
        for code, control in zip(self.CODES, self.controls):
            out = F.replace(out, F.lit("\\" + code), F.lit(control))
        return F.replace(out, F.lit("\\0"), F.lit("\\"))

    def render(self, turns: Column) -> Column:
        """One struct(head, text) of marked and escaped pieces per turn; the end mark is left out."""
        return F.transform(
            turns,
            lambda t: F.struct(
                t["role"].alias("role"),
                F.concat(F.lit(self.start), self.escape(t["role"]), F.lit(self.middle)).alias("head"),
                self.escape(t["text"]).alias("text"),
            ),
        )

    def parse(self, formatted: Column) -> Column:
        """The turns that ``formatted`` was made of."""
        quoted = lambda s: rf"\Q{s}\E"
        pieces = F.split(formatted, quoted(self.end))
        pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
        inner = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(self.start) + 1)), quoted(self.middle), 2))
        return F.transform(inner, lambda p: F.struct(self.unescape(p[0]).alias("role"), self.unescape(p[1]).alias("text"))).cast(TURNS)


def to_turns(records: DataFrame, ids: Sequence[str], record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``ids`` with ``fingerprint, layout, turns``: every record's canonical turns.

    Records of an unknown layout have a null layout and null turns, and are kept.  Null roles and
    texts become empty ones; a layout's list without messages gives no turns.
    """
    schema = records.schema[record].dataType
    marked = records.select(*ids, F.col(record).alias("record"), fingerprint(record, schema).alias("fingerprint"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        made = _turns(layout, "record", schema)
        if made is not None:
            known = F.col("fingerprint").isin(layout.fingerprints())
            name = F.when(known, F.lit(layout.name)).otherwise(name)
            turns = F.when(known, made).otherwise(turns)
    return marked.select(*ids, "fingerprint", name.alias("layout"), turns.alias("turns"))


def format_chats(
    records: DataFrame, ids: Sequence[str], record: str = "record", layouts: Sequence[Layout] = LAYOUTS, template: Template = Template(),
    trained: Sequence[str] = ("assistant",),
) -> DataFrame:
    """``ids`` with ``layout, turns, formatted, loss_spans``.

    ``loss_spans`` are the code points [start, end) of ``formatted`` that hold the (escaped) texts
    of the ``trained`` roles.  A record of unknown layout has null outputs; one without turns an
    empty text.  Only ``ids`` and the record are read, so other columns cannot clash.
    """
    turns = to_turns(records, ids, record, layouts)
    pieces = turns.withColumn("pieces", template.render(F.col("turns")))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(template.end))), "")
    length = lambda c: F.length(c).cast("long")

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + length(p["head"])
        end = start + length(p["text"])
        here = F.array(F.struct(start.alias("start"), end.alias("end"))).cast(SPANS)
        spans = F.when(p["role"].isin(list(trained)), F.concat(state["spans"], here)).otherwise(state["spans"])
        return F.struct((end + len(template.end)).alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
    spans = F.aggregate("pieces", none, add, lambda s: s["spans"])
    return pieces.select(*ids, "layout", "turns", formatted.alias("formatted"), spans.alias("loss_spans"))


def masked_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    part = lambda s: template.unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, part), "")
