"""Multiple imputation under a joint normal model (bootstrapped EM).

Published method: Honaker, King and Blackwell (2011), J. Stat. Software 45(7).

Targets are normal around a polynomial of time, which may differ by unit.  Given the
parameters, what the rows of one missingness pattern are expected to add is a linear image of
their raw cross-products, so Spark makes ONE pass over the data and sums weighted
cross-products per bootstrap, unit and pattern.  Every iteration is a Spark job over these sums.

Unit effects do not widen any matrix: units share no rows, so each is solved by itself given the
common polynomial, and what is left of it (a Schur complement) adds to one small system for the
common part.  Beliefs about single cells differ from row to row; such rows are kept as they are
and corrected one by one around their pattern's matrix (Woodbury's identity).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import bounded
from ..functions.arrays import task_sums
from ..session import materialize

REDRAWS = 20  # redraws of an out-of-bounds row that are made together
FLUSH_CELLS = 4_000_000  # doubles a task may hold before it emits partial sums
UNIT_CELLS = 4_000_000  # doubles of unit systems that a task solves together
MAX_COPIES = 1000  # replicates of a table that are imputed together


@dataclass
class Layout:
    """Target columns of the model, their scaling, and how the raw columns map onto them."""

    numeric: list[str]
    nominal: dict[str, list]
    ordinal: dict[str, tuple[float, float]]
    poly: int
    period: str
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))
    t0: float = 0.0
    t1: float = 1.0
    rows: int = 0
    base_unit: object = None

    @property
    def targets(self) -> int:
        return len(self.numeric) + sum(len(v) - 1 for v in self.nominal.values())

    @property
    def terms(self) -> int:
        return self.poly + 1

    def time(self, pdf: pd.DataFrame) -> np.ndarray:
        """Powers 0, 1, ... of the scaled period."""
        t = (pdf[self.period].to_numpy(dtype=float) - self.t0) / (self.t1 - self.t0 or 1.0) * 2 - 1
        return t[:, None] ** np.arange(self.terms)

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        """Standardised targets; NaN marks a missing cell."""
        cols = [pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in self.numeric]
        for c, levels in self.nominal.items():
            raw = pdf[c].to_numpy(dtype=object)
            unknown = pd.isna(raw)
            for v in levels[1:]:
                cols.append(np.where(unknown, np.nan, (raw == v).astype(float)))
        return (np.column_stack(cols) - self.centre) / self.spread


# --- hashed draws: the same row always gets the same numbers ------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(h: np.ndarray, n: int, *salt: int) -> np.ndarray:
    """Uniform draws in (0, 1), one row per hash and ``n`` columns."""
    key = h.astype(np.uint64)
    for s in salt:
        key = _mix(key ^ np.uint64(s + 1))
    grid = _mix(key[:, None] ^ _mix(np.arange(1, n + 1, dtype=np.uint64))[None, :])
    return ((grid >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _normal(h: np.ndarray, n: int, *salt: int) -> np.ndarray:
    u = _uniform(h, 2 * n, *salt)
    return np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * np.pi * u[:, n:])


_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(0, 18)])


def _bootstrap_weights(h: np.ndarray, rep: int) -> np.ndarray:
    """How often a row enters bootstrap ``rep`` (Poisson with mean one)."""
    return np.searchsorted(_POISSON, _uniform(h, 1, 7, rep)[:, 0]).astype(float)


def _binomial(u: np.ndarray, trials: int, share: np.ndarray) -> np.ndarray:
    """Binomial draws from one uniform per row, whatever the number of trials.

    The distribution function is followed up from 0 (from the nearer end) while its mean is small;
    beyond that the normal quantile with continuity correction differs from it by less than one.
    """
    flip = share > 0.5
    p, v = np.where(flip, 1 - share, share), np.where(flip, 1 - u, u)
    out = np.zeros(len(u))
    few = trials * p <= 64
    term = np.where(few, np.exp(trials * np.log1p(-p)), 1.0)
    below, k = term.copy(), 0
    while k < trials and (few & (below < v) & (k < 64 + 24 * 8)).any():
        term = term * (trials - k) / (k + 1) * p / (1 - p)
        out = out + (few & (below < v))
        below, k = below + term, k + 1
    wide = ~few
    if wide.any():
        z = np.array([NormalDist().inv_cdf(x) for x in v[wide]])
        mean = trials * p[wide]
        out[wide] = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - p[wide]))), 0, trials)
    return np.where(flip, trials - out, out)


# --- pattern algebra ----------------------------------------------------------------------


def _patterns(x: np.ndarray) -> Iterator[tuple[bytes, np.ndarray]]:
    """Row groups with the same missing cells, by their packed flags."""
    flags = np.ascontiguousarray(np.packbits(np.isnan(x), axis=1))
    _, where = np.unique(flags.view(f"V{flags.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(where, kind="stable")
    for rows in np.split(order, np.cumsum(np.bincount(where))[:-1]):
        yield flags[rows[0]].tobytes(), rows


def _conditional(gaps: bytes, sigma: np.ndarray):
    """Missing and observed positions, slopes and covariance of missing given observed deviations from the mean."""
    gap = np.unpackbits(np.frombuffer(gaps, dtype=np.uint8), count=len(sigma)).astype(bool)
    m, o = np.nonzero(gap)[0], np.nonzero(~gap)[0]
    if not len(m):
        return m, o, np.zeros((0, len(o))), np.zeros((0, 0))
    beta = np.linalg.lstsq(sigma[np.ix_(o, o)], sigma[np.ix_(o, m)], rcond=None)[0].T if len(o) else np.zeros((len(m), 0))
    cov = sigma[np.ix_(m, m)] - beta @ sigma[np.ix_(o, m)]
    return m, o, beta, (cov + cov.T) / 2 + 1e-10 * np.eye(len(m))


def _told(cov: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Covariances of rows whose cells are also known with these precisions: one update of ``cov`` per row."""
    d = np.sqrt(precision)
    scaled = d[:, :, None] * cov[None]
    new = cov[None] - np.einsum("ij,nj,njk->nik", cov, d, np.linalg.solve(scaled * d[:, None, :] + np.eye(len(cov)), scaled))
    return (new + new.transpose(0, 2, 1)) / 2


def _maps(gaps: bytes, sigma: np.ndarray, centre: np.ndarray | None = None, precision: np.ndarray | None = None):
    """``H, shift, cov``: the expected deviation from the mean is ``H (y - mean) + shift`` with missing cells of y as 0.

    One for the pattern, or one per row if centres and precisions (rows x targets) are given.
    """
    p = len(sigma)
    m, o, beta, cov = _conditional(gaps, sigma)
    h, whole = np.zeros((p, p)), np.zeros((p, p))
    h[o, o] = 1.0
    h[np.ix_(m, o)] = beta
    whole[np.ix_(m, m)] = cov
    if precision is None:
        return h, np.zeros(p), whole
    n, out, shift = len(precision), np.repeat(h[None], len(precision), axis=0), np.zeros((len(precision), p))
    wholes = np.repeat(whole[None], n, axis=0)
    if len(m):
        new = _told(cov, precision[:, m])
        pull = new * precision[:, None, m]
        out[:, m[:, None], o] -= pull @ beta
        out[:, m[:, None], m] = pull
        shift[:, m] = np.einsum("nij,nj->ni", pull, centre[:, m])
        wholes[:, m[:, None], m] = new
    return out, shift, wholes


# --- Spark passes -------------------------------------------------------------------------


def _layouts(
    df: DataFrame, numeric: Sequence[str], noms: Sequence[str], ords: Sequence[str], ts: str, cs: str | None, polytime: int, intercs: bool,
    max_width: int, by: str | None,
) -> dict[object, Layout]:
    """A layout per copy of the table, from one aggregation of the raw columns; ``by`` names the copies."""
    keys = [by] if by else []
    aggs = [F.count(F.lit(1)).alias("n"), F.min(ts).alias("t0"), F.max(ts).alias("t1")]
    aggs += [F.min(c).alias(f"lo_{c}") for c in ords] + [F.max(c).alias(f"hi_{c}") for c in ords]
    aggs += [F.min(cs).alias("base")] if cs and intercs else []
    for i, c in enumerate(numeric):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
    heads = df.groupBy(*keys).agg(*aggs).limit(MAX_COPIES + 1).collect()
    if len(heads) > MAX_COPIES:
        raise ValueError(f"{by} has more than {MAX_COPIES} values")
    # A level of a nominal column costs a model column, so their number is bounded by max_width.
    levels: dict[str, dict] = {}
    for c in noms:
        found = df.where(F.col(c).isNotNull()).select(*keys, c).distinct().limit(max_width * len(heads) + 1).collect()
        levels[c] = {}
        for r in found:
            levels[c].setdefault(r[0] if by else None, []).append(r[-1])
        if len(found) > max_width * len(heads) or any(len(v) > max_width for v in levels[c].values()):
            raise ValueError(f"{c} has more than {max_width} levels; a level left out would count as the first one")
    out = {}
    for head in heads:
        copy = head[by] if by else None
        lay = Layout(
            list(numeric), {c: sorted(levels[c].get(copy, [])) or [None] for c in noms},
            {c: (float(head[f"lo_{c}"]), float(head[f"hi_{c}"])) for c in ords if head[f"lo_{c}"] is not None},
            polytime, ts, t0=float(head["t0"] or 0), t1=float(head["t1"] or 0), rows=head["n"], base_unit=head["base"] if cs and intercs else None,
        )
        if lay.targets > max_width:
            raise ValueError(f"{lay.targets} model columns; a dense covariance of more than {max_width} is refused")
        rest = lay.targets - len(numeric)
        lay.centre = np.array([head[f"m{i}"] or 0.0 for i in range(len(numeric))] + [0.0] * rest, dtype=float)
        lay.spread = np.array([head[f"s{i}"] or 1.0 for i in range(len(numeric))] + [1.0] * rest, dtype=float)
        out[copy] = lay
    return dict(sorted(out.items(), key=lambda kv: (kv[0] is not None, kv[0])))


def _prior_cells(pdf: pd.DataFrame, lay: Layout, prior_cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Prior centre and precision of every cell in model units; zero precision means none."""
    centre, precision = np.zeros((len(pdf), lay.targets)), np.zeros((len(pdf), lay.targets))
    for c in prior_cols:
        j = lay.numeric.index(c)
        mu = pdf[f"__mu_{c}"].to_numpy(dtype=float, na_value=np.nan)
        sd = pdf[f"__sd_{c}"].to_numpy(dtype=float, na_value=np.nan)
        known = ~np.isnan(mu) & ~np.isnan(sd) & pd.isna(pdf[c]).to_numpy()
        centre[known, j] = (mu[known] - lay.centre[j]) / lay.spread[j]
        precision[known, j] = (lay.spread[j] / sd[known]) ** 2
    return centre, precision


SUMS = "run int, unit {unit}, gaps binary, raw array<double>, centre array<double>, precision array<double>"


def _copies(pdf: pd.DataFrame, lays: Mapping, by: str | None) -> Iterator[tuple[int, Layout, pd.DataFrame]]:
    """Rows of each copy with its number and layout."""
    for i, (copy, lay) in enumerate(lays.items()):
        part = pdf if by is None else pdf[pdf[by] == copy]
        if len(part):
            yield i, lay, part


def _sums(data: DataFrame, lays: Mapping, m: int, prior_cols: Sequence[str], by: str | None, cs: str | None) -> DataFrame:
    """``run, unit, groups``: weighted cross-products of (time, targets) per bootstrap, unit and pattern.

    Rows with priors are groups of their own, with their centres and precisions.  Groups add up,
    so partial sums of several tasks may stand beside each other.  ``unit`` is null without unit
    effects and for the first unit, whose polynomial is the common one.
    """

    def frame(run, unit, gaps, sums, centre=(), precision=()) -> tuple:
        return run, unit, gaps, sums[np.triu_indices(len(sums))], list(centre), list(precision)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cells = {}, 0
        columns = ["run", "unit", "gaps", "raw", "centre", "precision"]

        def emit() -> pd.DataFrame:
            return pd.DataFrame([frame(k[0] * m + r, k[1], k[2], v[r]) for k, v in held.items() for r in range(m)], columns=columns)

        for pdf in batches:
            alone = []
            for i, lay, part in _copies(pdf, lays, by):
                x, z = lay.matrix(part), lay.time(part)
                h = part["__hash"].to_numpy(dtype=np.int64).view(np.uint64)
                weights = np.stack([_bootstrap_weights(h, r) for r in range(m)])
                centre, precision = _prior_cells(part, lay, prior_cols)
                told = precision.any(axis=1)
                unit = part[cs].to_numpy(dtype=object) if cs else None
                v = np.hstack([z, np.nan_to_num(x)])
                for gaps, rows in _patterns(x):
                    for r in rows[told[rows]]:
                        one, u = np.outer(v[r], v[r]), None if cs is None or unit[r] == lay.base_unit else unit[r]
                        alone += [frame(i * m + rep, u, gaps, one * weights[rep, r], centre[r], precision[r]) for rep in range(m) if weights[rep, r]]
                    rows = rows[~told[rows]]
                    if cs is None:
                        split = [(None, rows)]
                    else:
                        names, which = np.unique(unit[rows], return_inverse=True)
                        order = np.argsort(which, kind="stable")
                        split = list(zip(names.tolist(), np.split(rows[order], np.cumsum(np.bincount(which))[:-1])))
                    for u, mine in split:
                        if not len(mine):
                            continue
                        key = (i, None if u == lay.base_unit else u, gaps)
                        if key not in held:
                            held[key] = np.zeros((m, v.shape[1], v.shape[1]))
                            cells += held[key].size
                        held[key] += np.einsum("rn,na,nb->rab", weights[:, mine], v[mine], v[mine], optimize=True)
            if alone:
                yield pd.DataFrame(alone, columns=columns)
            if cells > FLUSH_CELLS:
                yield emit()
                held, cells = {}, 0
        if held:
            yield emit()

    kind = data.schema[cs].dataType.simpleString() if cs else "string"
    rows = data.mapInPandas(partial, SUMS.format(unit=kind))
    group = F.struct("gaps", "raw", "centre", "precision")
    if cs is None:
        # Sums of equal patterns meet, so that an iteration reads each once.
        return rows.repartition("run", "gaps").mapInPandas(_merge, SUMS.format(unit=kind)).select("run", "unit", F.array(group).alias("groups"))
    # The first unit's rows need not stand together, and those of another are its periods.
    alone = rows.where("unit IS NULL").select("run", "unit", F.array(group).alias("groups"))
    return alone.unionByName(rows.where("unit IS NOT NULL").groupBy("run", "unit").agg(F.collect_list(group).alias("groups")))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}
    for pdf in batches:
        told = pdf["precision"].map(len).to_numpy() > 0
        if told.any():
            yield pdf[told]
        for run, gaps, raw in zip(pdf["run"][~told], pdf["gaps"][~told], pdf["raw"][~told]):
            held[run, gaps] = held.get((run, gaps), 0) + np.asarray(raw)
        if sum(map(len, held.values())) > FLUSH_CELLS:
            yield _merged(held)
            held = {}
    if held:
        yield _merged(held)


def _merged(held: dict) -> pd.DataFrame:
    return pd.DataFrame([(r, None, g, raw, [], []) for (r, g), raw in held.items()], columns=["run", "unit", "gaps", "raw", "centre", "precision"])


@dataclass
class Theta:
    """Common polynomial (terms x targets) and covariance of one run, with the weights that its penalties refer to."""

    b: np.ndarray
    sigma: np.ndarray
    rows: float
    ridge: float

    def penalty(self, gram: np.ndarray) -> np.ndarray:
        """The ridge on a block's polynomial terms: so many rows that vary like its own and go with nothing."""
        d = np.einsum("...aa->...a", gram) / self.rows - (gram[..., 0, :] / self.rows) ** 2
        return self.ridge * np.maximum(d, 0.0)


@dataclass
class Groups:
    """The sums of some table rows of one run: all their groups, and the table row that each belongs to."""

    raw: np.ndarray
    h: np.ndarray
    shift: np.ndarray
    cov: np.ndarray
    owner: np.ndarray
    count: int
    own: np.ndarray  # which table rows have a polynomial of their own


def _groups(batch: pa.RecordBatch, mine: np.ndarray, theta: Theta) -> Groups:
    k, p = theta.b.shape
    q = k + p
    lists = batch.column("groups").take(pa.array(mine))
    cells = lists.flatten()
    owner = np.repeat(np.arange(len(mine)), np.diff(lists.offsets.to_numpy()))
    upper = cells.field("raw").flatten().to_numpy(zero_copy_only=False).reshape(len(owner), -1)
    raw = np.zeros((len(owner), q, q))
    low, high = np.triu_indices(q)
    raw[:, low, high] = raw[:, high, low] = upper
    gaps = cells.field("gaps").to_pylist()
    size = np.diff(cells.field("precision").offsets.to_numpy())
    told = np.flatnonzero(size)
    centre, precision = (cells.field(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) for c in ("centre", "precision"))
    h, shift, cov = np.zeros((len(owner), p, p)), np.zeros((len(owner), p)), np.zeros((len(owner), p, p))
    by_gaps: dict[bytes, list[int]] = {}
    for i, g in enumerate(gaps):
        by_gaps.setdefault(g, []).append(i)
    place = np.full(len(owner), -1)
    place[told] = np.arange(len(told))
    for g, at in by_gaps.items():
        at = np.array(at)
        plain, known = at[place[at] < 0], at[place[at] >= 0]
        if len(plain):
            h[plain], shift[plain], cov[plain] = _maps(g, theta.sigma)
        if len(known):
            h[known], shift[known], cov[known] = _maps(g, theta.sigma, centre[place[known]], precision[place[known]])
    own = np.asarray(batch.column("unit").take(pa.array(mine)).is_valid())
    return Groups(raw, h, shift, cov, owner, len(mine), own)


def _unit_systems(g: Groups, theta: Theta) -> tuple[np.ndarray, ...]:
    """For every table row with a polynomial of its own: A, c, the inverse of A plus its ridge, the ridge."""
    k, p = theta.b.shape
    place = np.cumsum(g.own) - 1
    mine = np.flatnonzero(g.own[g.owner])
    to, units = place[g.owner[mine]], int(g.own.sum())
    gram = np.zeros((units, k, k))
    np.add.at(gram, to, g.raw[mine, :k, :k])
    a = np.zeros((units, k, p, k, p))
    np.add.at(a, to, np.einsum("nab,nst->nasbt", g.raw[mine, :k, :k], g.h[mine]))
    c = np.zeros((units, k, p))
    np.add.at(c, to, _score(g, mine, k))
    a, c, ridge = a.reshape(units, k * p, k * p), c.reshape(units, k * p), theta.penalty(gram)
    wide = np.repeat(ridge, p, axis=1)
    # A unit with fewer periods than terms has no best polynomial without a ridge; a trace of one picks the smallest.
    least = 1e-9 * np.einsum("uii->ui", a).mean(axis=1, keepdims=True) + 1e-12
    inverse = np.linalg.inv(a + np.einsum("ui,ij->uij", wide + least, np.eye(k * p)))
    return a, c, inverse, ridge


def _score(g: Groups, which: np.ndarray, k: int) -> np.ndarray:
    """Cross-products of time with what the targets are expected to be where the mean is 0."""
    raw = g.raw[which]
    return np.einsum("nat,nst->nas", raw[:, :k, k:], g.h[which]) + raw[:, :k, :1] * g.shift[which][:, None, :]


def _polynomials(theta: Theta, a: np.ndarray, c: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Each unit's deviation from the common polynomial."""
    return np.einsum("uij,uj->ui", inverse, c - a @ theta.b.ravel()).reshape(len(c), *theta.b.shape)


def _add_expected(total: np.ndarray, g: Groups, theta: Theta) -> None:
    """Add a run's expected sums: the system for the common polynomial, residuals, ridge terms, and squares and sums of targets."""
    k, p = theta.b.shape
    q, kp = k + p, k * p
    left, right, residual, square, plain = np.split(total, np.cumsum([kp * kp, kp, p * p, p]))
    b = np.repeat(theta.b[None], g.count, axis=0)
    loose = np.flatnonzero(~g.own[g.owner])
    if len(loose):
        a = np.einsum("nab,nst->asbt", g.raw[loose, :k, :k], g.h[loose], optimize=True)
        left += a.ravel()
        right += _score(g, loose, k).sum(axis=0).ravel()
    if g.own.any():
        a, c, inverse, ridge = _unit_systems(g, theta)
        units = _polynomials(theta, a, c, inverse)
        rest = np.eye(kp)[None] - a @ inverse
        left += (rest @ a).sum(axis=0).ravel()
        right += np.einsum("uij,uj->i", rest, c)
        residual += np.einsum("ua,uas,uat->st", ridge, units, units).ravel()
        b[g.own] += units
    mean = b[g.owner]
    # Rows are (time, targets with gaps as 0); the time terms begin with 1, which carries the shift.
    off = np.concatenate((-np.einsum("nst,nat->nsa", g.h, mean), g.h), axis=2)
    off[:, :, 0] += g.shift
    n = g.raw[:, 0, 0]
    spare = np.einsum("n,nst->st", n, g.cov)
    residual += (np.einsum("nsi,nij,ntj->st", off, g.raw, off, optimize=True) + spare).ravel()
    full = off
    full[:, :, :k] += mean.transpose(0, 2, 1)
    square += np.einsum("nsi,nij,nsj->s", full, g.raw, full, optimize=True) + np.diag(spare)
    plain += np.einsum("nsi,ni->s", full, g.raw[:, 0, :q])


def _slices(batch: pa.RecordBatch, thetas: Mapping[int, Theta]) -> Iterator[tuple[int, Groups]]:
    """The groups of each wanted run of a batch, a bounded number of unit systems at a time."""
    runs = batch.column("run").to_numpy(zero_copy_only=False)
    for run in np.unique(runs).tolist():
        if run in thetas:
            theta = thetas[run]
            step = max(1, UNIT_CELLS // (theta.b.size**2 + 8 * (sum(theta.b.shape) ** 2)))
            mine = np.flatnonzero(runs == run)
            for at in range(0, len(mine), step):
                yield run, _groups(batch, mine[at : at + step], theta)


def _expected_job(sums: DataFrame, thetas: Mapping[int, Theta]) -> dict[int, np.ndarray]:
    """One expectation over the sums; one vector per run comes back."""
    sizes = {r: (t.b.size + 1) * t.b.size + (t.b.shape[1] + 2) * t.b.shape[1] for r, t in thetas.items()}
    ends = dict(zip(sizes, np.cumsum(list(sizes.values())).tolist()))

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for run, g in _slices(batch, thetas):
            _add_expected(total[ends[run] - sizes[run] : ends[run]], g, thetas[run])

    wanted = sums.where(F.col("run").isin(list(thetas)))
    total = task_sums(wanted, sum(sizes.values()), add)
    return {r: total[ends[r] - sizes[r] : ends[r]] for r in thetas}


def _updated(theta: Theta, total: np.ndarray, common: np.ndarray) -> Theta:
    """The next parameters; the ridge adds rows without covariance."""
    k, p = theta.b.shape
    kp = k * p
    left, right, residual, square, plain = np.split(total, np.cumsum([kp * kp, kp, p * p, p]))
    n, r = theta.rows, theta.ridge
    ridge = theta.penalty(common)
    ridge[0] = 0.0
    b = np.linalg.lstsq(left.reshape(kp, kp) + np.diag(np.repeat(ridge, p)), right, rcond=None)[0].reshape(k, p)
    residual = residual.reshape(p, p) + np.einsum("a,as,at->st", ridge, theta.b, theta.b)
    spread = np.maximum(square / n - (plain / n) ** 2, 0.0)
    sigma = (residual + r * np.diag(spread)) / (n + r)
    return Theta(b, (sigma + sigma.T) / 2, n, r)


def _em(sums: DataFrame, lays: Mapping, m: int, ridge: float | None, tol: float, max_iter: int) -> dict[int, Theta]:
    """Parameters of every run (copy times ``m`` plus bootstrap); all runs share the scans, each stops by itself.

    Raises if one of them still moves after ``max_iter`` iterations.
    """
    grams, shapes = {}, {}
    for i, lay in enumerate(lays.values()):
        for r in range(m):
            grams[i * m + r], shapes[i * m + r] = np.zeros((lay.terms, lay.terms)), lay
    cells = F.explode("groups")
    k = next(iter(lays.values())).terms if lays else 1

    def corner(q: int) -> list[int]:
        low, high = np.triu_indices(q)
        return [int(np.flatnonzero((low == a) & (high == b))[0]) for a in range(k) for b in range(a, k)]

    for lay in {v.targets: v for v in lays.values()}.values():
        places = corner(k + lay.targets)
        picked = F.transform(F.array(*[F.lit(x) for x in places]), lambda x: F.get(F.col("g.raw"), x))
        rows = sums.select("run", cells.alias("g")).where(F.size("g.raw") == (k + lay.targets) * (k + lay.targets + 1) // 2)
        for run, cell, v in rows.select("run", F.posexplode(picked).alias("cell", "v")).groupBy("run", "cell").agg(F.sum("v")).collect():
            a, b = [(a, b) for a in range(k) for b in range(a, k)][cell]
            grams[run][a, b] = grams[run][b, a] = v
    theta = {}
    for run, lay in shapes.items():
        r = 0.01 * lay.rows if ridge is None else ridge
        theta[run] = Theta(np.zeros((k, lay.targets)), np.eye(lay.targets), max(grams[run][0, 0], 1e-9), r)
    open_ = {r for r, lay in shapes.items() if lay.targets and grams[r][0, 0] > 0}
    for _ in range(max_iter):
        if not open_:
            return theta
        totals = _expected_job(sums, {r: theta[r] for r in sorted(open_)})
        for r in sorted(open_):
            new = _updated(theta[r], totals[r], grams[r])
            change = max(np.abs(new.b - theta[r].b).max(), np.abs(new.sigma - theta[r].sigma).max())
            theta[r] = new
            if change < tol:
                open_.discard(r)
    if open_:
        raise RuntimeError(f"EM did not converge within {max_iter} iterations for {len(open_)} of {len(theta)} bootstraps; raise max_iter, tol or ridge")
    return theta


def _unit_table(sums: DataFrame, thetas: Mapping[int, Theta], m: int, kind: str) -> DataFrame:
    """``copy, unit, effects``: each unit's deviations from the common polynomial, of all bootstraps in turn."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("run").to_numpy(zero_copy_only=False)
            for run in np.unique(runs).tolist():
                mine = np.flatnonzero(runs == run)
                step = max(1, UNIT_CELLS // thetas[run].b.size ** 2)
                for at in range(0, len(mine), step):
                    part = mine[at : at + step]
                    a, c, inverse, _ = _unit_systems(_groups(batch, part, thetas[run]), thetas[run])
                    b = _polynomials(thetas[run], a, c, inverse)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(runs[part]), batch.column("unit").take(pa.array(part)), pa.array([x.ravel() for x in b], pa.list_(pa.float64()))], names=["run", "unit", "b"]
                    )

    solved = sums.where("unit IS NOT NULL").mapInArrow(solve, f"run int, unit {kind}, b array<double>")
    copy, rep = F.floor(F.col("run") / m).cast("int").alias("__copy"), F.pmod("run", F.lit(m)).alias("rep")
    return solved.select(copy, "unit", rep, "b").groupBy("__copy", F.col("unit").alias("__unit")).agg(F.collect_list(F.struct("rep", "b")).alias("__effects"))


def _draw(x, mean, h, rep, known, lower, upper, max_resample, centre=None, precision=None):
    """Complete the rows of ``x``: draw from the conditional, redraw out-of-bounds rows, clamp the rest."""
    for gaps, rows in _patterns(x):
        m, o, beta, cov = known(gaps)
        if not len(m):
            continue
        middle = mean[np.ix_(rows, m)] + (x[np.ix_(rows, o)] - mean[np.ix_(rows, o)]) @ beta.T
        vals, vecs = np.linalg.eigh(cov)
        root = np.repeat((vecs * np.sqrt(np.maximum(vals, 0)))[None], len(rows), axis=0)
        if precision is not None and precision[np.ix_(rows, m)].any():
            told = np.flatnonzero(precision[np.ix_(rows, m)].any(axis=1))
            p, c = precision[np.ix_(rows[told], m)], centre[np.ix_(rows[told], m)]
            new = _told(cov, p)
            middle[told] += np.einsum("nij,nj->ni", new, p * (c - middle[told]))
            vals, vecs = np.linalg.eigh(new)
            root[told] = vecs * np.sqrt(np.maximum(vals, 0))[:, None, :]
        value = middle + np.einsum("nij,nj->ni", root, _normal(h[rows], len(m), 11, rep, 0))
        lo, hi = lower[m], upper[m]
        if np.isfinite(lo).any() or np.isfinite(hi).any():
            bad = np.nonzero(((value < lo) | (value > hi)).any(axis=1))[0]
            tried = 0
            while len(bad) and tried < max_resample:
                # Several redraws at a time; the first one inside the bounds counts.
                block = min(REDRAWS, max_resample - tried)
                z = _normal(h[rows[bad]], len(m) * block, 11, rep, tried + 1).reshape(len(bad), block, len(m))
                again = middle[bad, None, :] + np.einsum("nij,nbj->nbi", root[bad], z)
                inside = ((again >= lo) & (again <= hi)).all(axis=2)
                hit = inside.any(axis=1)
                value[bad[hit]] = again[hit, inside[hit].argmax(axis=1)]
                bad, tried = bad[~hit], tried + block
            value = np.clip(value, lo, hi)
        x[np.ix_(rows, m)] = value
    return x


def em_impute(
    df: DataFrame,
    row_id: str,
    ts: str,
    cs: str | None = None,
    idvars: Sequence[str] = (),
    noms: Sequence[str] = (),
    ords: Sequence[str] = (),
    bounds: Mapping[str, tuple[float | None, float | None]] | None = None,
    priors: DataFrame | None = None,
    polytime: int = 3,
    intercs: bool = False,
    ridge: float | None = None,
    m: int = 5,
    seed: int = 90210,
    max_resample: int = 1000,
    tol: float = 1e-4,
    max_iter: int = 1000,
    max_width: int = 400,
    name: str = "imp",
    stored: bool = False,
    by: str | None = None,
) -> DataFrame:
    """``m`` completed copies of ``df``, stacked, with the copy number in ``name``.

    ``idvars`` pass through untouched; every other column but the keys is modelled: ``noms``
    as categories, ``ords`` as ordered integers, the rest as numbers.  The model holds a time
    polynomial, and with ``intercs`` one per unit, whatever the number of units.  ``bounds`` limit
    imputed values; ``priors(row_id, name, mu, sigma)`` state what is known of single missing
    cells.  ``ridge`` (default 1 percent of the rows) steadies the covariances.  ``max_width``
    limits the targets.  The input is read several times, so it is written out first unless it is
    a ``stored`` table already.

    ``by`` names a column of replicates of one table, each with its own rows of the same ids: they
    are imputed as if one after the other, with equal draws, but share every scan.
    """
    if not stored:
        df = materialize(df, "to-impute")
    skip = {row_id, ts, cs, by, *idvars}
    numeric = [c for c in df.columns if c not in skip and c not in noms]
    lays = _layouts(df, numeric, noms, ords, ts, cs, polytime, intercs, max_width, by)
    effects = cs if intercs else None

    data = df.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(row_id)))
    prior_cols: list[str] = []
    if priors is not None:
        prior_cols = [c for c in numeric if c in {r[0] for r in priors.select("name").distinct().collect()}]
    if prior_cols:
        picks = []
        for c in prior_cols:
            mine = F.col("name") == c
            picks += [F.max(F.when(mine, F.col("mu"))).alias(f"__mu_{c}"), F.max(F.when(mine, F.col("sigma"))).alias(f"__sd_{c}")]
        data = data.join(priors.groupBy(row_id).agg(*picks), row_id, "left")

    sums = materialize(_sums(data, lays, m, prior_cols, by, effects), "pattern-sums", rebalance=True)
    theta = _em(sums, lays, m, ridge, tol, max_iter)
    if effects:
        kind = df.schema[cs].dataType.simpleString()
        table = bounded(materialize(_unit_table(sums, theta, m, kind), "unit-effects"))
        number = F.lit(0)
        for i, copy in enumerate(lays):
            number = F.when(F.col(by) == F.lit(copy), F.lit(i)).otherwise(number) if by else number
        data = data.withColumn("__copy", number).join(table.withColumnRenamed("__unit", cs), ["__copy", cs], "left")

    limits = {}
    for copy, lay in lays.items():
        low, high = np.full(lay.targets, -np.inf), np.full(lay.targets, np.inf)
        for c, (lo, hi) in (bounds or {}).items():
            j = lay.numeric.index(c)
            low[j] = -np.inf if lo is None else (lo - lay.centre[j]) / lay.spread[j]
            high[j] = np.inf if hi is None else (hi - lay.centre[j]) / lay.spread[j]
        limits[copy] = (low, high)
    fields = df.schema.fields
    schema = f"`{name}` int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def means(part: pd.DataFrame, z: np.ndarray, t: Theta, rep: int) -> np.ndarray:
        out = z @ t.b
        if effects:
            for r, found in enumerate(part["__effects"]):
                for e in found if found is not None else ():
                    if e["rep"] == rep:
                        out[r] += z[r] @ np.asarray(e["b"]).reshape(t.b.shape)
        return out

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}

        def conditional(run: int):
            def get(gaps: bytes):
                if (run, gaps) not in seen:
                    seen[run, gaps] = _conditional(gaps, theta[run].sigma)
                return seen[run, gaps]

            return get

        for pdf in batches:
            for i, lay, part in _copies(pdf, lays, by):
                copy = list(lays)[i]
                h = part["__hash"].to_numpy(dtype=np.int64).view(np.uint64)
                raw, z = lay.matrix(part), lay.time(part)
                centre, precision = _prior_cells(part, lay, prior_cols) if prior_cols else (None, None)
                for rep in range(m):
                    run = i * m + rep
                    x = _draw(raw.copy(), means(part, z, theta[run], rep), h, rep, conditional(run), *limits[copy], max_resample, centre, precision)
                    yield _rescaled(part, x * lay.spread + lay.centre, h, rep, lay)

    def _rescaled(pdf: pd.DataFrame, x: np.ndarray, h: np.ndarray, rep: int, lay: Layout) -> pd.DataFrame:
        out = pdf[[f.name for f in fields]].copy()
        for j, c in enumerate(lay.numeric):
            gap = pd.isna(pdf[c]).to_numpy()
            if not gap.any():
                continue
            v = x[:, j]
            if c in lay.ordinal:
                lo, hi = lay.ordinal[c]
                trials = int(round(hi - lo))
                share = np.clip((v - lo) / (hi - lo or 1.0), 0, 1)
                v = lo + _binomial(_uniform(h, 1, 13, rep, j)[:, 0], trials, share)
            elif c in (bounds or {}):
                # Scaling back may step over a bound by one rounding error.
                v = np.clip(v, *[b if b is not None else s * np.inf for b, s in zip(bounds[c], (-1, 1))])
            out[c] = np.where(gap, v, pdf[c].to_numpy(dtype=float, na_value=np.nan))
        at = len(lay.numeric)
        for c, levels in lay.nominal.items():
            k = len(levels) - 1
            gap = pd.isna(pdf[c]).to_numpy()
            if gap.any():
                share = np.clip(x[:, at : at + k], 0, 1)
                share = np.hstack([np.maximum(1 - share.sum(axis=1, keepdims=True), 0), share])
                cum = np.cumsum(share / share.sum(axis=1, keepdims=True), axis=1)
                pick = (_uniform(h, 1, 17, rep, at) > cum).sum(axis=1).clip(0, k)
                chosen = np.array(levels, dtype=object)[pick]
                out[c] = np.where(gap, chosen, pdf[c].to_numpy(dtype=object))
            at += k
        for f in fields:
            if f.dataType.simpleString() in ("int", "bigint", "smallint", "tinyint") and f.name in lay.numeric:
                out[f.name] = np.round(out[f.name].astype(float)).astype("int64")
        out.insert(0, name, rep + 1)
        return out

    # Rows without gaps are only repeated, which needs no Python.
    gap = F.lit(False)
    for c in [*numeric, *noms]:
        gap = gap | F.col(f"`{c}`").isNull()
    whole = df.where(~gap).select(F.explode(F.sequence(F.lit(1), F.lit(m))).alias(name), *[f"`{f.name}`" for f in fields])
    return data.where(gap).mapInPandas(complete, schema).unionByName(whole)
