"""Quality rules: a decision list learned from labelled statistics and applied as ordered Spark conditions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .sums import bounded_sample
from .text import BLANK, SAME, chunks, code_points, mix, run_hashes, words

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_bare_words")
WINDOW = 3


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


LINE = ~_bytes_in((0x0A, 0x0A))
CAPITAL = _bytes_in((0x41, 0x5A))
MARK = _bytes_in((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _running(flag: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=out[1:])
    return out


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how often it occurs in its text, and whether it is the first there."""
    _, first, which, count = np.unique(mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True, return_counts=True)
    new = np.zeros(len(keys), dtype=bool)
    new[first] = True
    return count[which], new


def text_counts(column: pa.Array) -> np.ndarray:
    """The ``COUNTS`` of every text, one row each."""
    w = words(column, BLANK, SAME)
    data, docs = w.data, len(w.first) - 1
    per_byte = lambda table: np.diff(_running(table[data])[w.offsets])
    per_word = lambda values: np.diff(_running(values)[w.first])
    points = code_points(data)
    marks = _running(MARK[data])
    size = w.end - w.start

    lines = words(column, LINE, SAME)
    filled = _running(BLANK[data])
    at = np.flatnonzero(filled[lines.end] > filled[lines.start])
    line_doc = lines.doc[at]
    _, new = _repeats(lines.hash[at], line_doc)

    doc = w.doc
    covered = np.zeros(len(doc), dtype=bool)
    if len(doc) >= WINDOW:
        inside = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
        often, _ = _repeats(run_hashes(w.hash, WINDOW)[inside], doc[inside])
        for step in range(WINDOW):
            covered[inside[often >= 2] + step] = True
    out = [
        np.diff(w.first), per_word(points[w.end] - points[w.start]), per_byte(SYMBOL), np.bincount(line_doc[~new], minlength=docs), per_word(covered),
        np.bincount(line_doc, minlength=docs), per_byte(CAPITAL), per_byte(MARK), per_word(marks[w.end] - marks[w.start] == size),
    ]
    return np.stack(out, axis=1).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "_text"):
            counts = text_counts(part.column("_text"))
            keep = [n for n in part.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *(pa.array(c) for c in counts.T)], names=[*keep, *COUNTS])


def statistics(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and the ``COUNTS`` of every whole text, in one pass and without moving rows."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(_rows, T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def features() -> dict[str, Column]:
    """What conditions may compare: shares that do not grow with a text, and its length.  A share without a base is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_char": share("n_symbols", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "capitals_per_char": share("n_capitals", "word_chars"),
        "marks_per_char": share("n_marks", "word_chars"),
        "bare_words": share("n_bare_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = features()[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; each rejects the documents that meet all its conditions, and what none rejects is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rejected(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for rule in self.rules:
            out |= _covers(rule, x, names)
        return out

    def column(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does."""
        out = F.lit(0)
        for i in range(len(self.rules), 0, -1):
            out = F.when(reduce(lambda a, b: a & b, (c.column() for c in self.rules[i - 1])), F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        lines = [f"{i}. reject if {' and '.join(map(str, rule))}" for i, rule in enumerate(self.rules, 1)]
        return "\n".join([*lines, "else keep"])


def _covers(rule: Sequence[Condition], x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Condition | None:
    """The threshold of greatest information gain over the rows that a rule covers so far."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    if not p0 or not n0:
        return None
    best, found = 1e-9, None
    before = np.log2(p0 / (p0 + n0))
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        p = np.cumsum(b)[cut]
        n = cut + 1 - p
        for above, (good, wrong) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
            gain = np.where(good > 0, good * (np.log2(np.maximum(good, 1) / np.maximum(good + wrong, 1)) - before), 0.0)
            if len(gain) and gain.max() > best:
                k = int(np.argmax(gain))
                best, found = float(gain[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return found


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str], most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most:
        c = _best_condition(x[inside], bad[inside], names)
        if c is None:
            break
        rule.append(c)
        inside &= c.holds(x, names)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> list[Condition]:
    """The shortest beginning of a rule that does best on rows it was not grown on."""

    def worth(k: int) -> float:
        inside = _covers(rule[:k], x, names)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        return (p - n) / (p + n + 2)

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(
    x: np.ndarray, bad: np.ndarray, grow: np.ndarray, names: Sequence[str], precision: float = 0.95, least: int = 3, conditions: int = 4
) -> DecisionList:
    """Sequential covering: grow a rule on the rows in ``grow``, prune it on the others, take out what it covers, go on.

    A rule stays if it covers ``least`` bad rows and ``precision`` of all rows that it covers are
    bad; with the first that does not, the list ends.
    """
    left, rules = np.ones(len(x), dtype=bool), []
    while (left & bad).any():
        a, b = left & grow, left & ~grow
        rule = _prune(_grow(x[a], bad[a], names, conditions), x[b], bad[b], names)
        inside = left & _covers(rule, x, names)
        right = int((inside & bad).sum())
        if not rule or right < least or right < precision * inside.sum():
            break
        rules.append(tuple(rule))
        left &= ~inside
    return DecisionList(tuple(rules))


def learn_rules(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = 20_000, **learning) -> DecisionList:
    """Rules that tell ``label = 0`` apart, from the statistics of about ``sample`` labelled rows at most.

    The sample is drawn by a hash of the key, two thirds of it grow rules and a third prunes them.
    Null keys and labels and labels of unknown documents are ignored.  Without rows of both labels
    there is no rule.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_key IS NOT NULL AND _label IS NOT NULL")
    named = features()
    rows = stats.withColumnRenamed(key, "_key").join(known, "_key").select("_key", "_label", *(c.alias(n) for n, c in named.items()))
    rows = sorted(bounded_sample(rows, sample, "_key"), key=lambda r: tuple(r))
    x = np.array([tuple(r)[2:] for r in rows], dtype=np.float64).reshape(len(rows), len(named))
    bad = np.array([r["_label"] == 0 for r in rows], dtype=bool)
    grow = np.array([crc32(str(r["_key"]).encode()) % 3 > 0 for r in rows], dtype=bool)
    return learn(x, bad, grow, list(named), **learning)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in windows that repeat."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000
) -> tuple[DataFrame, DecisionList]:
    """``doc_id``, the ``COUNTS``, ``base_failed``, ``rule`` and ``kept`` for every document, and the learned list.

    ``rule`` is the number of the first learned rule that rejects the document, 0 if none does;
    ``kept`` is false if the base rules fail or a learned rule holds.

    Statistics come from all whole texts; words are compared by 64-bit hashes.  Null and empty
    texts count 0 everywhere and fail the base rules.  Rows that repeat an id are judged each by
    its own text; a document labelled twice counts once for each label.  Other columns are ignored,
    and an empty table gives an empty one.
    """
    stats = materialize(statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]), "rule-statistics")
    rules = learn_rules(stats, labels.withColumnRenamed(doc_id, "doc_id"), label=label, sample=sample)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.column())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
