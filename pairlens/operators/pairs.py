"""Pairs of units per period: universe, sides, events, attributes, directions.

Naming: ``A_`` and ``B_`` columns belong to one side of a pair, ``ud_`` columns to
the pair.  An undirected pair is stored with ``a_unit`` before ``b_unit``; in text
order the unit codes are strings, so the same comparison serves both orders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bounded, hash_rank, seeded_draw
from ..session import materialize
from .spells import expand_spells

PAIR = ("a_unit", "b_unit")


def _ordered(col: Column, order: str) -> Column:
    if order not in ("numeric", "text"):
        raise ValueError(f"unknown pair order {order!r}")
    return col if order == "numeric" else col.cast("string")


def make_pairs(
    panel: DataFrame, unit: str, period: str, order: str = "numeric", blocks: int = 16
) -> DataFrame:
    """All unordered pairs of units present in the same period.

    The result is quadratic in the units of a period by definition, so only the keys
    are joined.  Units are hashed into ``blocks`` and the pairs of one period are
    built as ``blocks * blocks`` independent cells: a period that holds a third of
    the panel is spread over the cluster instead of landing in one task.
    """
    keys = panel.select(_ordered(F.col(unit), order).alias("u"), period).distinct()
    block = F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = keys.select(F.col("u").alias("a_unit"), period, block.alias("i")).withColumn("j", every)
    right = keys.select(F.col("u").alias("b_unit"), period, block.alias("j")).withColumn("i", every)
    joined = left.join(right, [period, "i", "j"])
    return joined.where(F.col("a_unit") < F.col("b_unit")).select("a_unit", "b_unit", period)


def attach_sides(
    pairs: DataFrame, panel: DataFrame, attrs: Sequence[str], unit: str, period: str, by: Sequence[str] = ()
) -> DataFrame:
    """Both units' attributes as ``A_`` and ``B_`` columns; a pair missing a side goes.

    ``by`` names replicate columns of the panel: the pairs are then produced once
    per replicate, and both sides come from the same one.
    """
    side_a = panel.select(
        *by, F.col(unit).alias("a_unit"), period, *[F.col(c).alias(f"A_{c}") for c in attrs]
    )
    side_b = panel.select(
        *by, F.col(unit).alias("b_unit"), period, *[F.col(c).alias(f"B_{c}") for c in attrs]
    )
    return pairs.join(side_a, ["a_unit", period]).join(side_b, [*by, "b_unit", period])


def event_pairs(
    participants: DataFrame,
    event: str,
    side: str,
    unit: str,
    start: str,
    end: str,
    side_a=1,
    side_b=0,
    side_rows: int = 1000,
) -> DataFrame:
    """Each side-A participant of an event against each side-B participant.

    Columns ``event, attacker, target, start, end``; start is the earliest and end the
    latest of the event.  An event without one of the sides yields nothing, a unit on
    both sides is not paired with itself.  Participants are reduced to distinct units
    and stored first, since each side and the span of the event read them; an event is cut
    into a grid of one part for each ``side_rows`` units on side A and on side B, so neither
    side of a large event meets in one task.
    """
    p = participants.groupBy(
        F.col(event).alias("event"), F.col(side).alias("side"), F.col(unit).alias("unit")
    ).agg(F.min(start).alias("start"), F.max(end).alias("end"))
    p = materialize(p, "participants")
    span = p.groupBy("event").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        *[F.ceil(F.count(F.when(F.col("side") == s, 1)) / F.lit(side_rows)).cast("int").alias(n) for s, n in ((side_a, "rows_a"), (side_b, "rows_b"))],
    )
    span = span.where((F.col("rows_a") > 0) & (F.col("rows_b") > 0))
    a = p.where(F.col("side") == side_a).select("event", F.col("unit").alias("attacker"))
    b = p.where(F.col("side") == side_b).select("event", F.col("unit").alias("target"))
    part = lambda unit, n: F.pmod(F.xxhash64(unit), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(span, "event").withColumn("part_a", part("attacker", "rows_a")).withColumn("part_b", every("rows_b"))
    b = b.join(span.select("event", "rows_a", "rows_b"), "event").withColumn("part_b", part("target", "rows_b"))
    b = b.select("event", "target", "part_b", every("rows_a").alias("part_a"))
    return (
        a.join(b, ["event", "part_a", "part_b"])
        .where(F.col("attacker") != F.col("target"))
        .select("event", "attacker", "target", "start", "end")
    )


def onset_flags(pairs: DataFrame, events: DataFrame, period: str) -> DataFrame:
    """Two 0/1 flags: A started an event against B in this period, and the converse.

    The events are folded onto the stored pair order first, so both directions
    come from one join against one row per pair and start.
    """
    onset = (
        events.select(
            F.least("attacker", "target").alias("a_unit"),
            F.greatest("attacker", "target").alias("b_unit"),
            F.col("start").alias(period),
            (F.col("attacker") < F.col("target")).cast("int").alias("by_a"),
        )
        .groupBy(*PAIR, period)
        .agg(F.max("by_a").alias("__a"), F.max(1 - F.col("by_a")).alias("__b"))
    )
    return _flag_join(pairs, onset, [*PAIR, period], {"A_attacked": "__a", "B_attacked": "__b"})


def _flag_join(pairs: DataFrame, marks: DataFrame, key: list[str], names: Mapping[str, str]) -> DataFrame:
    out = pairs.join(marks, key, "left")
    out = out.withColumns({n: F.coalesce(F.col(c), F.lit(0)) for n, c in names.items()})
    return out.drop(*names.values())


def ongoing_flag(
    pairs: DataFrame,
    events: DataFrame,
    period: str,
    name: str = "ud_ongoing",
    horizon: int = 0,
    clamp: tuple | None = None,
) -> DataFrame:
    """0/1: the pair is inside an event spell, or at most ``horizon`` periods past its end.

    Events of a pair that start together are reduced to the longest before the
    spells are expanded into periods.
    """
    spells = (
        events.select(
            F.least("attacker", "target").alias("a_unit"), F.greatest("attacker", "target").alias("b_unit"), "start", "end"
        )
        .groupBy(*PAIR, "start")
        .agg(F.max("end").alias("end"))
        .withColumn("end", F.col("end") + F.lit(horizon))
    )
    marks = expand_spells(spells, "start", "end", period, clamp).distinct().withColumn("__hit", F.lit(1))
    return _flag_join(pairs, marks, [*PAIR, period], {name: "__hit"})


def event_flags(
    pairs: DataFrame, events: DataFrame, period: str, horizons: Mapping[str, int], clamp: tuple | None = None
) -> DataFrame:
    """Onset flags of both sides and one running flag per horizon, in a single join.

    Same results as :func:`onset_flags` and :func:`ongoing_flag` one after the other.  Each
    event is expanded once, to its longest horizon; every flag is a condition on the
    distance to its start and end, and all are combined per pair and period before the
    shuffle.
    """
    furthest = max(horizons.values())
    spells = events.select(
        F.least("attacker", "target").alias("a_unit"),
        F.greatest("attacker", "target").alias("b_unit"),
        (F.col("attacker") < F.col("target")).cast("int").alias("by_a"),
        F.col("start").alias("__from"),
        F.col("end").alias("__to"),
        "start",
        (F.col("end") + F.lit(furthest)).alias("end"),
    )
    begins = (F.col(period) == F.col("__from")).cast("int")
    aggs = [F.max(begins * F.col("by_a")).alias("A_attacked"), F.max(begins * (1 - F.col("by_a"))).alias("B_attacked")]
    aggs += [F.max((F.col(period) <= F.col("__to") + F.lit(h)).cast("int")).alias(n) for n, h in horizons.items()]
    marks = expand_spells(spells, "start", "end", period, clamp).groupBy(*PAIR, period).agg(*aggs)
    names = ["A_attacked", "B_attacked", *horizons]
    out = pairs.join(marks, [*PAIR, period], "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def canonical_pairs(
    table: DataFrame, a: str, b: str, sided: Mapping[str, tuple[str, str]] | None = None, order: str = "numeric"
) -> DataFrame:
    """Re-key a pair table to the stored pair order.

    ``sided`` maps a name to its (A column, B column); their values change places
    where the key does.
    """
    first, second = _ordered(F.col(a), order), _ordered(F.col(b), order)
    swap = first > second
    out = {}
    for name, (ca, cb) in (sided or {}).items():
        out[f"A_{name}"] = F.when(swap, F.col(cb)).otherwise(F.col(ca))
        out[f"B_{name}"] = F.when(swap, F.col(ca)).otherwise(F.col(cb))
    used = {a, b, *[c for ab in (sided or {}).values() for c in ab]}
    rest = [c for c in table.columns if c not in used]
    return table.select(
        F.least(first, second).alias("a_unit"),
        F.greatest(first, second).alias("b_unit"),
        *rest,
        *[c.alias(n) for n, c in out.items()],
    )


def pair_attributes(
    pairs: DataFrame,
    table: DataFrame,
    a: str,
    b: str,
    period: str | None,
    sided: Mapping[str, tuple[str, str]] | None = None,
    shared: Mapping[str, str] | None = None,
    present: str | None = None,
    canonicalize: bool = True,
    order: str = "numeric",
    fill: Mapping[str, object] | None = None,
) -> DataFrame:
    """Left join of a pair-period table: sided columns, shared columns, a presence flag.

    ``sided={"imports": ("flow1", "flow2")}`` gives ``A_imports`` and ``B_imports``;
    ``shared`` maps target names to columns; ``present`` names a 0/1 flag. Rows whose
    key is in the other order are turned round if ``canonicalize``, else they never match.
    """
    t = table
    if canonicalize:
        t = canonical_pairs(t, a, b, sided, order)
    else:
        renames = {f"{s}_{n}": F.col(c) for n, ab in (sided or {}).items() for s, c in zip("AB", ab)}
        t = t.withColumnsRenamed({a: "a_unit", b: "b_unit"}).withColumns(renames)
    key = [*PAIR] + ([period] if period else [])
    picked = [F.col(f"{s}_{n}") for n in (sided or {}) for s in "AB"]
    picked += [F.col(c).alias(n) for n, c in (shared or {}).items()]
    side = t.select(*key, *picked)
    if present:
        side = side.withColumn("__hit", F.lit(1))
    out = pairs.join(side, key, "left")
    if present:
        out = out.withColumn(present, F.coalesce("__hit", F.lit(0))).drop("__hit")
    for n, v in (fill or {}).items():
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(v)))
    return out


def directed_membership(
    pairs: DataFrame, table: DataFrame, src: str, dst: str, period: str, names: tuple[str, str]
) -> DataFrame:
    """Two 0/1 flags: A->B is in a directed table, and B->A is; one join for both."""
    marks = (
        table.select(
            F.least(src, dst).alias("a_unit"),
            F.greatest(src, dst).alias("b_unit"),
            period,
            (F.col(src) < F.col(dst)).cast("int").alias("forward"),
        )
        .where(F.col(src) != F.col(dst))
        .groupBy(*PAIR, period)
        .agg(F.max("forward").alias("__ab"), F.max(1 - F.col("forward")).alias("__ba"))
    )
    return _flag_join(pairs, marks, [*PAIR, period], {names[0]: "__ab", names[1]: "__ba"})


def pair_static_lookup(
    pairs: DataFrame,
    table: DataFrame,
    a: str,
    b: str,
    value: str,
    name: str,
    substitutes: DataFrame | None = None,
    zero_value: float | None = None,
    overrides: DataFrame | None = None,
    order: str = "numeric",
) -> DataFrame:
    """Time-invariant pair value.

    A pair without a value is looked up again under ``substitutes(code, substitute)``;
    the substituted pair is put in order before the second lookup.  Zeros are then
    replaced and ``overrides(a_unit, b_unit, value)`` have the last word.  Only the
    distinct pairs are resolved; the result joins back to all periods.
    """
    known = canonical_pairs(table.select(a, b, value), a, b, order=order)
    known = known.groupBy(*PAIR).agg(F.min(value).alias("__value"))
    keys = pairs.select(*PAIR).distinct()
    found = keys.join(known, list(PAIR), "left")
    if substitutes is not None:
        substitutes = bounded(substitutes)
        for c in PAIR:
            s = substitutes.select(F.col("code").alias(c), F.col("substitute").alias(f"__s_{c}"))
            found = found.join(s, c, "left").withColumn(f"__s_{c}", F.coalesce(f"__s_{c}", c))
        # Only the pairs without a value take part in the second lookup.
        open_ = found.where(F.col("__value").isNull())
        again = canonical_pairs(open_.select(*PAIR, "__s_a_unit", "__s_b_unit").withColumnsRenamed(
            {"a_unit": "__a", "b_unit": "__b"}), "__s_a_unit", "__s_b_unit", order=order)
        again = again.join(known, list(PAIR)).select(
            F.col("__a").alias("a_unit"), F.col("__b").alias("b_unit"), F.col("__value").alias("__second")
        )
        found = found.drop("__s_a_unit", "__s_b_unit").join(again, list(PAIR), "left")
        found = found.withColumn("__value", F.coalesce("__value", "__second")).drop("__second")
    resolved = F.col("__value")
    if zero_value is not None:
        resolved = F.when(resolved == 0, F.lit(zero_value)).otherwise(resolved)
    found = found.withColumn("__value", resolved)
    if overrides is not None:
        o = bounded(overrides).select(*PAIR, F.col(value).alias("__override"))
        found = found.join(o, list(PAIR), "left")
        found = found.withColumn("__value", F.coalesce("__override", "__value")).drop("__override")
    return pairs.join(found.withColumnRenamed("__value", name), list(PAIR), "left")


def mirror_pairs(df: DataFrame, sides: Sequence[str] = ("A_", "B_")) -> DataFrame:
    """Directed table: every row, and the row with its sides exchanged.

    Each input row is emitted twice by one generator, so the (costly) pair table is
    computed once and never joined to itself.
    """
    a, b = sides

    def other(c: str) -> str:
        if c in PAIR:
            return PAIR[1 - PAIR.index(c)]
        swapped = f"{b}{c[len(a):]}" if c.startswith(a) else f"{a}{c[len(b):]}" if c.startswith(b) else c
        if swapped not in df.columns:
            raise ValueError(f"column {c} has no counterpart {swapped}")
        return swapped

    kept = F.struct(*[F.col(c).alias(c) for c in df.columns])
    turned = F.struct(*[F.col(other(c)).alias(c) for c in df.columns])
    return df.select(F.inline(F.array(kept, turned)))


# Periods whose pairs are numbered in one range, and parts that a list of draws is counted in.
MAX_PERIODS, DRAW_PARTS = 1000, 4096


def unranked_pair(rank: Column) -> tuple[Column, Column]:
    """The pair ``(i, j)``, ``0 <= i < j``, with number ``rank`` when pairs are counted (0,1), (0,2), (1,2), (0,3), ...

    ``j`` is the triangular root of the rank; the root of a long is one off at most, which is mended.
    """
    guess = F.floor((F.sqrt(rank.cast("double") * 8 + 1) + 1) / 2).cast("long")
    below = lambda j: F.shiftright(j * (j - 1), 1)
    j = F.when(below(guess) > rank, guess - 1).when(below(guess + 1) <= rank, guess + 1).otherwise(guess)
    return rank - below(j), j


def case_control_pairs(
    panel: DataFrame, unit: str, period: str, cases: DataFrame, ratio: float = 100, seed: int | str = 90210
) -> DataFrame:
    """A down-sample of the pair universe that never builds the universe: ``a_unit, b_unit, period, label, n_draws``.

    All unordered pairs of units of a period have numbers.  Numbers are drawn with replacement
    and turned back into pairs; a draw that hits a case counts for nothing, and the first
    ``ratio`` times as many draws as there are cases stay as controls (label 0).  Cases
    (``a_unit, b_unit, period``; distinct, both units present) are drawn with replacement as
    often as there are cases (label 1).  Work and shuffles grow with cases times ratio.

    The draws are md5 draws, so partitions do not matter.  Every pair without a case has the same
    chance in every draw, as in sampling from ``make_pairs``.
    """
    spark = panel.sparkSession
    units = panel.select(F.col(unit).alias("unit"), F.col(period).alias("period")).where("unit IS NOT NULL AND period IS NOT NULL").distinct()
    ranks = materialize(hash_rank(units, "unit", ["period"], seed, "rank").withColumn("rank", F.col("rank") - 1), "unit-ranks")
    sizes = ranks.groupBy("period").count().limit(MAX_PERIODS + 1).collect()
    if len(sizes) > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods")
    starts, total = [], 0
    for p, n in sorted(tuple(r) for r in sizes):
        starts.append((p, total))
        total += n * (n - 1) // 2
    side = lambda name: ranks.select(F.col("unit").alias(name), F.col("period").alias(period), F.col("rank").alias(f"__{name}"))
    known = cases.select(F.least(*PAIR).alias("a_unit"), F.greatest(*PAIR).alias("b_unit"), period).where("a_unit < b_unit").distinct()
    known = known.join(side("a_unit"), ["a_unit", period]).join(side("b_unit"), ["b_unit", period])
    known = materialize(known.select(*PAIR, period), "cases")
    n1 = known.count()
    wanted = int(n1 * ratio)
    if not n1 or total <= n1:
        raise ValueError("no cases, or no pairs without one")

    def draws(n: int) -> DataFrame:
        number = seeded_draw(f"{seed}:pair", F.col("id")) % F.lit(total)
        begin = F.array(*[F.lit(s).cast("long") for _, s in starts])
        at = F.size(F.filter(begin, lambda s: s <= F.col("number")))
        named = F.array(*[F.lit(p) for p, _ in starts])
        drawn = spark.range(n).withColumn("number", number).withColumn("at", at)
        # Periods of one unit have no pairs and share their start with the next; the last of them holds the pairs.
        drawn = drawn.select("id", F.element_at(named, F.col("at")).alias(period), (F.col("number") - F.element_at(begin, F.col("at"))).alias("r"))
        i, j = unranked_pair(F.col("r"))
        drawn = drawn.select("id", period, i.alias("__a_unit"), j.alias("__b_unit"))
        found = drawn.join(side("a_unit"), ["__a_unit", period]).join(side("b_unit"), ["__b_unit", period])
        found = found.select("id", F.least(*PAIR).alias("a_unit"), F.greatest(*PAIR).alias("b_unit"), period)
        return materialize(found.join(known, [*PAIR, period], "left_anti"), "controls")

    tried = int(wanted * total / (total - n1) * 1.02 + 6 * wanted**0.5) + 100
    while True:
        hits = draws(tried)
        width = tried // DRAW_PARTS + 1
        left, last = wanted, None
        for part, n in sorted(tuple(r) for r in hits.groupBy(F.floor(F.col("id") / width).alias("part")).count().collect()):
            if n >= left:
                last = part
                break
            left -= n
        if last is not None or not wanted:
            break
        tried *= 2
    part = F.floor(F.col("id") / width)
    kept = hits.where(part < (last or 0)).unionByName(hits.where(part == (last or 0)).orderBy("id").limit(left))
    controls = kept.groupBy(*PAIR, period).agg(F.count(F.lit(1)).alias("n_draws")).withColumn("label", F.lit(0))
    numbered = hash_rank(known.withColumn("key", F.concat_ws(":", *PAIR, period)), "key", [], seed, "rank").drop("key")
    drawn = spark.range(n1).select((seeded_draw(f"{seed}:case", F.col("id")) % F.lit(n1) + 1).alias("rank"))
    drawn = drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("n_draws"))
    positives = numbered.join(drawn, "rank").select(*PAIR, period, "n_draws").withColumn("label", F.lit(1))
    return positives.unionByName(controls).select(*PAIR, period, "label", "n_draws")
