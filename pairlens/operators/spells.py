"""Spells (start, end) and panel variables.

Windows here are partitioned by unit and ordered by period on tables keyed by
(unit, period).  Such a group holds at most one row per period of the study
range, however many source rows there are, so it always fits one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import bounded, flag, in_set
from .clean import duplicate_audit


def _keys(key: Sequence[str] | str) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def enrich(
    df: DataFrame,
    other: DataFrame,
    key: Sequence[str] | str,
    cols: Sequence[str],
    rename: Mapping[str, str] | None = None,
    audit: bool = True,
) -> DataFrame:
    """Left join of a pruned attribute table; refuses a key that would multiply rows."""
    keys, rename = _keys(key), dict(rename or {})
    if audit:
        clash = duplicate_audit(other, keys).limit(1).collect()
        if clash:
            raise ValueError(f"attribute table has several rows for key {clash[0].asDict()}")
    return df.join(other.select(*keys, *[F.col(c).alias(rename.get(c, c)) for c in cols]), keys, "left")


def _period_range(start: Column, end: Column, clamp: tuple | None, descending: str) -> Column:
    if descending not in ("drop", "keep"):
        raise ValueError(f"unknown descending rule {descending!r}")
    lo, hi = start, end
    if descending == "keep":
        lo, hi = F.least(start, end), F.greatest(start, end)
    if clamp is not None:
        first, last = [F.lit(b) if not isinstance(b, Column) else b for b in clamp]
        lo, hi = F.greatest(lo, first), F.least(hi, last)
    known = start.isNotNull() & end.isNotNull()
    return F.when(known & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def expand_spells(
    df: DataFrame,
    start: str,
    end: str,
    period: str = "period",
    clamp: tuple | None = None,
    extra_intervals: Sequence[tuple[str, str]] = (),
    absent: int | None = None,
    descending: str = "drop",
) -> DataFrame:
    """One row per period of each spell.

    ``extra_intervals`` names further (start, end) columns of the same row, skipped
    where their start holds the ``absent`` code.  ``clamp`` cuts to a study range
    before the rows are generated.  ``descending`` says whether a spell that ends
    before it starts is dropped or read backwards.
    """
    ranges = []
    for i, (s, e) in enumerate([(start, end), *extra_intervals]):
        begin, stop = F.col(s).cast("int"), F.col(e).cast("int")
        if i and absent is not None:
            begin = F.when(begin != absent, begin)
        ranges.append(_period_range(begin, stop, clamp, descending))
    periods = ranges[0] if len(ranges) == 1 else F.array_distinct(F.concat(*ranges))
    drop = {c for pair in [(start, end), *extra_intervals] for c in pair}
    return df.withColumn(period, F.explode(periods)).drop(*drop)


def spell_flag(panel: DataFrame, periods: DataFrame, key: Sequence[str] | str, name: str) -> DataFrame:
    """0/1: is the unit-period one of the expanded spell periods."""
    keys = _keys(key)
    marks = periods.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return panel.join(marks, keys, "left").withColumn(name, F.coalesce("__hit", F.lit(0))).drop("__hit")


def spell_open(panel: DataFrame, spells: DataFrame, unit: str, period: str, start: str, end: str, name: str) -> DataFrame:
    """0/1: does a spell of the unit run in the period, first and last one included.

    The same as flagging the expanded spells, but nothing is expanded.  Of the spells that begin
    in one period only the latest end counts, and a period is open if an earlier start reaches it.
    Spells are dealt by unit and start before they are reduced, so that a task holds the groups of
    its own keys only, not those of all units.  Rows of the panel may repeat.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    known = spells.select(F.col(unit).alias("__u"), s.alias("__t"), e.alias("__e")).where("__u IS NOT NULL AND __t <= __e")
    reach = known.repartition("__u", "__t").groupBy("__u", "__t").agg(F.max("__e").alias("__e"))
    asked = panel.withColumns({"__u": F.col(unit), "__t": F.col(period).cast("long"), "__asked": F.lit(True)})
    # A unit has one row per period that a spell begins in, beside the panel's own; a period's own starts count too.
    so_far = W.partitionBy("__u").orderBy("__t").rangeBetween(W.unboundedPreceding, W.currentRow)
    both = asked.unionByName(reach, allowMissingColumns=True).withColumn("__until", F.max("__e").over(so_far))
    is_open = F.coalesce(F.col("__until") >= F.col("__t"), F.lit(False)).cast("int")
    return both.where("__asked").select(*panel.columns, is_open.alias(name))


def spell_count(
    panel: DataFrame,
    spells: DataFrame,
    unit: str,
    period: str,
    start: str,
    end: str,
    name: str,
    end_rule: str = "exclusive",
    single_period: str = "previous",
    clamp: tuple | None = None,
) -> DataFrame:
    """Number of spells running in each unit-period.

    With ``end_rule="exclusive"`` the last period of a spell is not counted; a spell
    of one period is then counted in the period before it (``single_period="previous"``),
    in its own (``"same"``) or nowhere (``"drop"``).
    """
    s, e = F.col(start).cast("int"), F.col(end).cast("int")
    if end_rule == "exclusive":
        single = {"previous": (s - 1, s - 1), "same": (s, s), "drop": (F.lit(None).cast("int"),) * 2}[single_period]
        first = F.when(e > s, s).when(e == s, single[0])
        last = F.when(e > s, e - 1).when(e == s, single[1])
    elif end_rule == "inclusive":
        first, last = s, e
    else:
        raise ValueError(f"unknown end rule {end_rule!r}")
    ranged = spells.select(unit, first.alias("__s"), last.alias("__e"))
    running = expand_spells(ranged, "__s", "__e", period, clamp).groupBy(unit, period).agg(F.count(F.lit(1)).alias(name))
    return panel.join(running, [unit, period], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def state_flags(
    df: DataFrame,
    unit: str,
    period: str,
    col: str,
    state_code: int,
    change_codes: Sequence[int],
    jump: float,
    state_name: str = "in_state",
    change_name: str = "changed",
) -> DataFrame:
    """Flag for one special code (NULL if unknown) and a change flag (unknown counts as 0)."""
    before = F.lag(col).over(W.partitionBy(unit).orderBy(period))
    changed = in_set(F.col(col), change_codes) | (F.abs(F.col(col) - before) >= jump)
    return df.withColumns(
        {state_name: flag(F.col(col) == state_code), change_name: F.coalesce(flag(changed), F.lit(0))}
    )


def resolve_primary(
    df: DataFrame, group: str, candidate: str, sentinel, overrides: DataFrame, order: Sequence[str] = ()
) -> DataFrame:
    """One row per group.

    A single row stands.  Of several rows the only one whose candidate is not the
    sentinel stands.  Otherwise ``overrides(group, candidate)`` names the row; a
    group it does not name goes.  Everything is a partial aggregate per group.
    """
    rest = [c for c in df.columns if c != group]
    lead = [F.col(c) for c in order]
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(lead)], F.struct(*rest).alias("row"))
    real = F.col(candidate) != F.lit(sentinel)
    named = overrides.groupBy(group).agg(F.min(candidate).alias("__pick"))
    # The rows are reduced to one per group and candidate before they meet the overrides.
    reduced = df.groupBy(group, candidate).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    per_group = (
        reduced.join(named, group, "left")
        .groupBy(group)
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n_real"),
            F.min("first").alias("any_row"),
            F.min(F.when(real, F.col("first"))).alias("real_row"),
            F.min(F.when(F.col(candidate) == F.col("__pick"), F.col("first"))).alias("named_row"),
        )
    )
    pick = F.when(F.col("n") == 1, F.col("any_row")).when(F.col("n_real") == 1, F.col("real_row")).otherwise(
        F.col("named_row")
    )
    return per_group.select(group, pick.alias("m")).where("m IS NOT NULL").select(group, "m.row.*").select(*df.columns)


def ordered_max(
    df: DataFrame,
    key: Sequence[str] | str,
    col: str,
    levels: DataFrame,
    name: str,
    universe: DataFrame | None = None,
) -> DataFrame:
    """Highest level per key, as its label.

    ``levels(code, label, rank)`` maps codes to labels in order; an unknown code is
    ignored.  With ``universe`` the keys it holds but ``df`` lacks get the lowest level.
    """
    keys, levels = _keys(key), bounded(levels)
    coded = levels.select(F.col("code").alias(col), "rank", "label").where(F.col(col).isNotNull())
    best = df.join(coded, col, "inner").groupBy(*keys).agg(F.max(F.struct("rank", "label")).alias("__top"))
    best = best.select(*keys, F.col("__top.label").alias(name))
    if universe is None:
        return best
    lowest = levels.agg(F.min_by("label", "rank")).scalar()
    return universe.join(best, keys, "left").withColumn(name, F.coalesce(F.col(name), lowest))


def time_since(
    df: DataFrame, unit: Sequence[str] | str, period: str, kill: str, name: str = "time_since"
) -> DataFrame:
    """Periods since the last event.

    An event row is 0 and so is the row after a gap in the periods; the very first
    row is 1 unless it is an event; any other row adds one.  All windows share one sort.
    """
    units = _keys(unit)
    order = W.partitionBy(*units).orderBy(period)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    broken = F.col(period) != F.lag(period).over(order) + 1
    reset = F.coalesce((F.col(kill) == 1) | broken, F.lit(False))
    marked = df.withColumn("__reset", F.when(reset, F.col(period)))
    # No gap can lie between a row and its last reset, so the distance is the count.
    since_reset = F.col(period) - F.max("__reset").over(so_far)
    since_start = F.col(period) - F.min(period).over(so_far) + 1
    return marked.withColumn(name, F.coalesce(since_reset, since_start).cast("int")).drop("__reset")


def lag_features(
    df: DataFrame, unit: Sequence[str] | str, period: str, cols: Sequence[str], suffix: str = "_lag"
) -> DataFrame:
    """Previous-row value of several columns per unit; all share one sort."""
    order = W.partitionBy(*_keys(unit)).orderBy(period)
    return df.withColumns({f"{c}{suffix}": F.lag(c).over(order) for c in cols})


# --- spells as changes: nothing is expanded into periods ------------------------------------


def _changes(spells: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """``key, t, change``: +1 where a spell begins, -1 in the period after its end; spells that end before they start are dropped."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    both = F.array(F.struct(s.alias("t"), F.lit(1).alias("change")), F.struct((e + 1).alias("t"), F.lit(-1).alias("change")))
    known = spells.where(s.isNotNull() & e.isNotNull() & (s <= e))
    return known.select(*key, F.inline(both)).groupBy(*key, "t").agg(F.sum("change").alias("change"))


def _running(changes: DataFrame, key: Sequence[str], span: int) -> DataFrame:
    """Running sum ``n`` of the changes by key and time, and the time ``until`` the next one.

    Time is cut into ranges of ``span`` periods.  Sums run inside a range; what ran before it is
    carried over from one row per key and range, so a key with very many changes is spread.
    """
    ranged = changes.withColumn("__range", F.floor(F.col("t") / span))
    inside = W.partitionBy(*key, "__range").orderBy("t")
    over = W.partitionBy(*key).orderBy("__range")
    totals = ranged.groupBy(*key, "__range").agg(F.sum("change").alias("__sum"), F.min("t").alias("__first"))
    carried = totals.select(
        *key, "__range",
        F.coalesce(F.sum("__sum").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.lead("__first").over(over).alias("__after"),
    )
    summed = ranged.withColumn("n", F.sum("change").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    summed = summed.withColumn("until", F.lead("t").over(inside)).join(carried, [*key, "__range"])
    return summed.select(*key, "t", (F.col("n") + F.col("__before")).alias("n"), F.coalesce("until", "__after").alias("until"))


def running_spans(spells: DataFrame, key: Sequence[str] | str, start: str, end: str, span: int = 4096) -> DataFrame:
    """``key, first, last, n``: stretches of periods in which the same number of spells runs, at least one.

    The sum of all stretches equals the expanded spells; each spell adds two changes, however
    long it is.  Neighbouring stretches of equal number are one.
    """
    keys = _keys(key)
    changes = _changes(spells, keys, start, end).where("change <> 0")
    return _running(changes, keys, span).where("n > 0").select(*keys, F.col("t").alias("first"), (F.col("until") - 1).alias("last"), "n")


def count_at(
    points: DataFrame, spells: DataFrame, key: Sequence[str] | str, period: str, start: str, end: str, name: str, span: int = 4096
) -> DataFrame:
    """``points`` with the number of spells that run in their period, first and last one included.

    Points join the changes as changes of 0, so that one sweep serves both.  The same as
    counting expanded spells; a null key or period runs no spell.
    """
    keys = _keys(key)
    marks = points.select(*keys, F.col(period).cast("long").alias("t")).dropna().distinct().withColumn("change", F.lit(0).cast("long"))
    changes = _changes(spells, keys, start, end).unionByName(marks).groupBy(*keys, "t").agg(F.sum("change").alias("change"))
    counted = _running(changes, keys, span).select(*keys, F.col("t").alias("__t"), F.col("n").alias(name))
    out = points.withColumn("__t", F.col(period).cast("long")).join(counted, [*keys, "__t"], "left")
    return out.select(*points.columns, F.coalesce(name, F.lit(0)).alias(name))
