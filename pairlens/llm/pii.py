"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .boosting import BoostedTrees, platt, sigmoid
from .sums import bounded_sample
from .text import chunks, code_points, column_bytes

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# What a generator knows of a span: passed or failed its format's check, or proposed without one.
PASSED, FAILED, OPEN = 1, 0, -1

LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
HOST = re.compile(rb"[A-Za-z0-9-]+")
SPELLED = re.compile(rb" ?[\[(](?:at|AT)[\])] ?")
DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(rb"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
GROUPS = re.compile(rb"(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,6}){1,5}")
# Numbers and what stands between their groups: every match of the number formats lies in one run of these.
NUMERIC = np.zeros(256, dtype=bool)
NUMERIC[list(b"0123456789 .()+-")] = True
IS_DIGIT = np.zeros(256, dtype=bool)
IS_DIGIT[list(b"0123456789")] = True

#: Words that announce a kind of personal data, looked for just before a span.
CUES = {
    EMAIL: ("mail", "contact", "write"),
    IP: ("ip", "host", "address", "server"),
    CARD: ("card", "visa", "credit", "account", "iban"),
    PHONE: ("tel", "phone", "call", "fax", "mobile"),
}
CANDIDATES = "array<struct<kind:int,start:int,end:int,label:int,x:array<float>>>"


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def runs_of_groups(number: bytes, least: int, most: int, first_only: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digits) of all runs of neighbouring digit groups with ``least`` to ``most`` digits."""
    groups = [(g.start(), g.end(), g.group()) for g in re.finditer(rb"[0-9]+", number)]
    for i, (start, _, _) in enumerate(groups[:1] if first_only else groups):
        digits = b""
        for _, end, group in groups[i : i + most]:
            if len(digits) + len(group) > most:
                break
            digits += group
            if len(digits) >= least:
                yield start, end, digits


def number_spans(run: bytes) -> Iterator[tuple]:
    """(kind, start, end, label, check) in a run of numeric bytes, in time linear in its length; parts of a number have its span as well.

    The three formats are matched leftmost and without overlap within a kind.  A dotted chain of
    digit groups is read in fours, which is what the leftmost greedy match does.  Numbers that
    run into each other fail as a whole, so all runs of their groups that are long enough are proposed as well,
    at most eight from each group; of a dotted chain every four neighbouring parts.
    """
    for chain in DOTTED.finditer(run):
        parts = chain.group().split(b".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            fits = all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four)
            yield IP, at, end, int(fits), fits
            at = end + 1
        fits = [len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in parts]
        at = chain.start()
        for i in range(len(parts) - 3):
            if i % 4 and all(fits[i : i + 4]):
                yield IP, at, at + sum(map(len, parts[i : i + 4])) + 3, OPEN, True, chain.span()
            at += len(parts[i]) + 1
    for m in DIGITS.finditer(run):
        digits = m.group().translate(None, b" -")
        fits = 12 <= len(digits) <= 19 and luhn(digits)
        if 12 <= len(digits) <= 19:
            yield CARD, *m.span(), int(fits), fits
        if len(digits) >= 12 and not fits:
            for start, end, part in runs_of_groups(m.group(), 12, 19):
                if len(part) < len(digits) and luhn(part):
                    yield CARD, m.start() + start, m.start() + end, OPEN, True, m.span()
    phones = []
    for m in PLUS.finditer(run):
        n = len(m.group().translate(None, b"+ ().-"))
        phones.append(m.span())
        fits = 9 <= n <= 15
        yield PHONE, *m.span(), int(fits), fits
        if n > 15:
            for start, end, _ in runs_of_groups(m.group(), 9, 15, first_only=True):
                yield PHONE, m.start(), m.start() + end, OPEN, True, m.span()
    # Without a plus sign the digits alone prove nothing; the words before decide.
    for m in GROUPS.finditer(run):
        n = len(m.group().translate(None, b" ()./-"))
        at = bisect_left(phones, (m.end(),)) - 1
        if at >= 0 and m.start() < phones[at][1]:
            continue
        if 9 <= n <= 15:
            yield PHONE, *m.span(), OPEN, None
        elif n > 15:
            for start, end, _ in runs_of_groups(m.group(), 9, 15):
                # An area code keeps its bracket.
                start -= run[m.start() + start - 1 : m.start() + start] == b"(" and start > 0
                yield PHONE, m.start() + start, m.start() + end, OPEN, None, m.span()


def email_spans(data: bytes, signs: list[int], begin: int, stop: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(kind, start, end, label, check) around the @ signs of a text that lies at begin to stop."""
    done = last = begin
    for at in signs:
        head = data[max(done, last) : at]
        local = len(head) - len(head.rstrip(LOCAL)) if head else 0
        last = at + 1
        if not local:
            continue
        host = DOMAIN.match(data, at + 1, stop)
        if host:
            done = host.end()
            yield EMAIL, at - local, done, PASSED, True
        elif host := HOST.match(data, at + 1, stop):
            yield EMAIL, at - local, host.end(), FAILED, False


def spelled_emails(data: bytes, begin: int, stop: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """``name [at] host.org``: no check exists for these."""
    last = begin
    for m in SPELLED.finditer(data, begin, stop):
        head, last = data[last : m.start()], m.end()  # no local part holds a bracket
        local = len(head) - len(head.rstrip(LOCAL))
        host = DOMAIN.match(data, m.end(), stop)
        if local and host:
            yield EMAIL, m.start() - local, host.end(), OPEN, True


def features(data: bytes, begin: int, stop: int, kind: int, start: int, end: int, run: tuple[int, int] | None = None) -> list[float]:
    """Format and context of a span; whether it passes its format's check is not among them.

    The context of a part of a number is what stands around the whole number, ``run``.
    """
    span = data[start:end]
    left, right = run or (start, end)
    before, after = data[max(begin, left - 40) : left], data[right : min(stop, right + 8)]
    digits = sum(48 <= b < 58 for b in span)
    letters = sum(65 <= (b & 0xDF) < 91 for b in span)
    groups = [len(g) for g in re.findall(rb"[0-9]+", span)] or [0]
    cues = before.lower()
    other = lambda b: b in b" \n\t,.;:!?\"'()[]<>=" or not b
    cued = any(c.encode() in cues for c in CUES[kind])
    return [
        *(float(kind == k) for k in range(4)), float(kind != PHONE or span[:1] == b"+"),
        float(min(len(span), 80)), float(min(digits, 40)), letters / max(1, len(span)), float(min(len(groups), 12)), float(max(groups)), float(min(groups)),
        float(span.count(b" ")), float(span.count(b"-")), float(span.count(b".")), float(span.count(b"(")),
        float(span[:1] in b"0123456789" and span[0] - 48), len(set(span)) / max(1, len(span)),
        float(cued), float(any(c.encode() in cues for k in range(4) if k != kind for c in CUES[k])),
        float(other(before[-1:])), float(other(after[:1])), float(before[-1:].isdigit() or after[:1].isdigit()),
        float(before.count(b" ")), float(sum(48 <= b < 58 for b in before)), float(len(before) == 0),
    ]


N_FEATURES, CUED = 25, 17


def propose(column: pa.Array) -> list[list[tuple[int, int, int, int, list[float], int, int]]]:
    """Per text its candidates: kind, start, end (code points), label, features, start, end (bytes)."""
    buffer, offsets = column_bytes(column)
    data = buffer.tobytes()
    found: list[list] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return found
    numeric = NUMERIC[buffer]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begin = np.flatnonzero(numeric & ~(np.concatenate(([False], numeric[:-1])) & ~edge[:-1]))
    stop = np.flatnonzero(numeric & ~(np.concatenate((numeric[1:], [False])) & ~edge[1:])) + 1
    digits = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(IS_DIGIT[buffer], out=digits[1:])
    many = digits[stop] - digits[begin] >= 4
    signs = np.flatnonzero(buffer == 0x40)
    brackets = np.flatnonzero((buffer[:-1] == 0x5B) | (buffer[:-1] == 0x28))
    brackets = brackets[(buffer[brackets + 1] | 0x20) == 0x61]
    doc_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    spans: dict[int, list] = {}
    for a, b, doc in zip(begin[many].tolist(), stop[many].tolist(), doc_of(begin[many]).tolist()):
        mine = ((k, a + s, a + e, label, check, *((a + r[0], a + r[1]) for r in run)) for k, s, e, label, check, *run in number_spans(data[a:b]))
        spans.setdefault(doc, []).extend(mine)
    by_doc: dict[int, list[int]] = {}
    for at, doc in zip(signs.tolist(), doc_of(signs).tolist()):
        by_doc.setdefault(doc, []).append(at)
    for doc, ats in by_doc.items():
        spans.setdefault(doc, []).extend(email_spans(data, ats, int(offsets[doc]), int(offsets[doc + 1])))
    for doc in set(doc_of(brackets).tolist()):
        spans.setdefault(doc, []).extend(spelled_emails(data, int(offsets[doc]), int(offsets[doc + 1])))
    points = code_points(buffer)
    for doc, mine in spans.items():
        a, b = int(offsets[doc]), int(offsets[doc + 1])
        for kind, start, end, label, check, *run in mine:
            # What has no label must hold its check, a phone number without a plus sign a cue word: rules beside the trees.
            x = features(data, a, b, kind, start, end, *run)
            if label == OPEN and not (x[CUED] if check is None else check):
                continue
            found[doc].append((kind, int(points[start] - points[a]), int(points[end] - points[a]), label, x, start - a, end - a))
    return found


@dataclass
class Selector:
    """The fitted trees, their calibration and the probability that each kind needs to be selected."""

    trees: BoostedTrees | None = None
    slope: float = 1.0
    offset: float = 0.0
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)

    def accepts(self, candidates: list[tuple]) -> list[bool]:
        """Spans that pass their format's check stay whatever the trees say; the others need a high probability."""
        out = [c[3] == PASSED for c in candidates]
        rest = [i for i, c in enumerate(candidates) if c[3] != PASSED]
        if self.trees is None or not rest:
            return out
        p = sigmoid(self.slope * self.trees.score(np.array([candidates[i][4] for i in rest], dtype=np.float64)) + self.offset)
        taken = bytearray(max(c[2] for c in candidates))
        for c, ok in zip(candidates, out):
            if ok:
                taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
        # Of equally probable spans the longest.
        for i, prob in sorted(zip(rest, p.tolist()), key=lambda x: (-x[1], candidates[x[0]][1] - candidates[x[0]][2], x[0])):
            kind, start, end = candidates[i][:3]
            if prob >= self.thresholds[kind] and taken.find(1, start, end) < 0:
                out[i], taken[start:end] = True, b"\1" * (end - start)
        return out


# Candidates are scored by trees that have not seen their fold, and counted by score in BINS steps of 0.05 from -LIMIT to LIMIT.
FOLDS, BINS, LIMIT = 5, 480, 12.0


def score_bins(folds: Sequence[BoostedTrees], x: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The bin of every candidate's score by its own fold's trees."""
    score = np.zeros(len(x))
    for f, trees in enumerate(folds):
        mine = np.flatnonzero(fold == f)
        if len(mine):
            score[mine] = trees.score(x[mine])
    return np.clip((score + LIMIT) * (BINS / (2 * LIMIT)), 0, BINS - 1).astype(np.int64)


def fit_trees(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[BoostedTrees | None, list[BoostedTrees]]:
    """Trees of all rows, and for each fold the trees of the other ones; none with fewer than 20 examples of a class, or none in some fold's rest."""
    rest = [fold != f for f in range(FOLDS)]
    if min((y == 1).sum(), (y == 0).sum()) < 20 or any(len(set(y[r])) < 2 for r in rest):
        return None, []
    return BoostedTrees().fit(x, y), [BoostedTrees().fit(x[r], y[r]) for r in rest]


def calibrate(trees: BoostedTrees, counts: np.ndarray, precision: float = 0.98) -> Selector:
    """From ``counts`` by kind, label and score bin: a calibration, and per kind the lowest threshold of at least ``precision``."""
    score = (np.arange(BINS) + 0.5) * (2 * LIMIT / BINS) - LIMIT
    weight = counts.sum(axis=0)
    y = np.repeat([0.0, 1.0], BINS)
    slope, offset = platt(np.tile(score, 2), y, weight=weight.ravel() / max(1.0, weight.sum() / 10_000))
    p, thresholds = sigmoid(slope * score + offset), []
    for failed, passed in counts:
        seen = np.flatnonzero(failed + passed)[::-1]
        right = np.cumsum(passed[seen]) / np.cumsum((failed + passed)[seen])
        enough = np.flatnonzero(right >= precision)
        ranked = np.append(p[seen], 0.0)
        # Half-way to the next lower one, so that a span like the accepted ones is accepted.
        thresholds.append(max(0.5, float(ranked[enough[-1] : enough[-1] + 2].mean())) if len(enough) and slope > 0 else 2.0)
    return Selector(trees, slope, offset, tuple(thresholds))


def fit_selector(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float = 0.98) -> Selector:
    """What ``learn`` does, for candidates in memory: fit, score each by the trees of the other folds, calibrate on all.

    With fewer than 20 examples of a class there is nothing to learn from, and nothing is added.
    """
    fold = np.arange(len(y)) % FOLDS
    trees, folds = fit_trees(x, y, fold)
    if trees is None:
        return Selector()
    counts = np.zeros((len(KINDS), 2, BINS))
    np.add.at(counts, (kinds.astype(np.int64), y.astype(np.int64), score_bins(folds, x, fold)), 1)
    return calibrate(trees, counts, precision)


def _candidates(text: str):
    names = ["kind", "start", "end", "label", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                rows = [[dict(zip(names, c[:5])) for c in row] for row in propose(part.column(text))]
                kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float32()))]))
                keep = [n for n in part.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(rows, kind)], names=[*keep, "candidates"])

    return run


def candidates_of(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every document with its ``candidates``; a null or empty text has none."""
    rows = docs.select(*keep, F.col(text).alias("text"))
    kept = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("candidates", T._parse_datatype_string(CANDIDATES))])
    return rows.mapInArrow(_candidates("text"), schema)


def _histogram(folds: Sequence[BoostedTrees]):
    """Counts of checked candidates by kind, label and score bin; each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(KINDS), 2, BINS), dtype=np.int64)
        for batch in batches:
            kind, label, fold, x = (batch.column(n) for n in ("kind", "label", "fold", "x"))
            if batch.num_rows:
                features_ = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, N_FEATURES)
                np.add.at(counts, (kind.to_numpy(), label.to_numpy(), score_bins(folds, features_, fold.to_numpy())), 1)
        k, y, at = np.nonzero(counts)
        columns = [*(pa.array(c.astype(np.int32)) for c in (k, y, at)), pa.array(counts[k, y, at])]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "label", "bin", "n"])

    return run


def learn(candidates: DataFrame, sample: int = 20_000) -> Selector:
    """Trees from about ``sample`` checked candidates at most; calibration and thresholds from all of them.

    The sample has the mix of the whole: it is chosen by a hash of the document's columns and the span, so
    copies are drawn one by one.  Every checked candidate is then scored by trees that were
    fitted without its fold, and the counts by kind, outcome and score, whose number is fixed, set the thresholds.
    """
    keys = [n for n in candidates.columns if n != "candidates"]
    c = candidates.select(*(F.col(n).alias(f"_key_{n}") for n in keys), F.explode("candidates").alias("c"))
    # The folds go by content, so that no copy of a span is scored by trees that have seen it.
    fold = F.pmod(F.xxhash64("c.x"), F.lit(FOLDS)).cast("int").alias("fold")
    c = c.select(*(f"_key_{n}" for n in keys), "c.*", fold).where(F.col("label") >= 0)
    rows = bounded_sample(c, sample, *(f"_key_{n}" for n in keys), "kind", "start", "end", "x")
    if not rows:
        return Selector()
    rows.sort(key=lambda r: (r["kind"], r["start"], r["end"], r["label"], r["x"]))
    x, y, folds = np.array([r["x"] for r in rows], dtype=np.float64), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])
    trees, parts = fit_trees(x, y, folds)
    if trees is None:
        return Selector()
    counted = c.select("kind", "label", "fold", "x").mapInArrow(_histogram(parts), "kind int, label int, bin int, n long")
    counts = np.zeros((len(KINDS), 2, BINS))
    for r in counted.groupBy("kind", "label", "bin").agg(F.sum("n").alias("n")).collect():  # at most 8 BINS rows
        counts[r["kind"], r["label"], r["bin"]] = r["n"]
    return calibrate(trees, counts)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, a, b in spans))


def _report(selector: Selector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n != "candidates"]
            counts, shas, spans = [[] for _ in KINDS], [], []
            for row in batch.column("candidates").to_pylist():
                mine = [(c["kind"], c["start"], c["end"], c["label"], c["x"]) for c in row]
                base = [c[:3] for c in mine if c[3] == PASSED]
                for k, column in enumerate(counts):
                    column.append(sum(c[0] == k for c in base))
                shas.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell([c[:3] for c, ok in zip(mine, selector.accepts(mine)) if ok]))
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *columns], names=[*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns of every document with ``n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Base spans match their kind's format and pass its check.  More are proposed (parts of numbers
    that run into each other, phone numbers without a plus sign, spelled-out or host-only mail
    addresses); the trees have learned from the format and the context of spans that have a check where
    it holds, never from the check, and
    a proposal, or a span that fails its check where others pass, is added if it overlaps no chosen span and its calibrated probability reaches
    its kind's threshold.  Offsets are code points, ends exclusive.

    A null or empty text has no spans.  Repeated rows are each reported.  The trees are fitted on a
    bounded sample of candidates, the thresholds on counts of all; candidates come from every whole text.  No other column is read.
    """
    found = materialize(candidates_of(docs, keep, text), "pii-candidates")
    kept = found.schema.fields[:-1]
    schema = T.StructType([*kept, *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return found.mapInArrow(_report(learn(found)), schema)


def _redact(selector: Selector, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                texts = part.column(text).to_pylist()
                for i, row in enumerate(propose(part.column(text))):
                    chosen = sorted((c[5], c[6], c[0]) for c, ok in zip(row, selector.accepts(row)) if ok)
                    if chosen:
                        data, at, out = texts[i].encode(), 0, []
                        for start, end, kind in chosen:
                            if start >= at:
                                out += [data[at:start], b"<%s>" % KINDS[kind].upper().encode()]
                            at = max(at, end)
                        texts[i] = b"".join([*out, data[at:]]).decode()
                columns = [pa.array(texts, part.column(n).type) if n == text else part.column(n) for n in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return run


def redact(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The given columns with every selected span of ``text`` replaced by its kind, such as ``<EMAIL>``."""
    selector = learn(materialize(candidates_of(docs, [c for c in docs.columns if c == "doc_id"]), "pii-candidates"))
    rows = docs.select(*columns)
    return rows.mapInArrow(_redact(selector, "text"), rows.schema)
