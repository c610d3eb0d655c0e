"""Library complexity beyond what was sequenced: counts of counts, a rational yield curve for each group, and bootstrap intervals.

With n_j molecules seen j times, t times as many reads again are expected to show n_1 t - n_2 t^2 + n_3 t^3 - ... new molecules. The series diverges beyond t = 1;
its continued fraction doesn't. Terms are taken back until the curve rises and flattens as a yield must.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of the series that are used at most, and the fewest that a continued fraction of more than two has.
TERMS, LEAST = 100, 4


def counts_of_counts(reads: DataFrame, by: str, fragment: list[str]) -> DataFrame:
    """(by, seen, molecules): how many distinct fragments of each group were seen so many times."""
    return reads.groupBy(by, *fragment).agg(F.count("*").alias("seen")).groupBy(by, "seen").agg(F.count("*").alias("molecules"))


def fraction(series: np.ndarray) -> np.ndarray:
    """Coefficients c of c0 / (1 + c1 t / (1 + c2 t / ...)) with the power series' terms, by quotients and differences; cut where one isn't finite."""
    n = len(series)
    out = [series[0]]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        q, e = series[1:] / series[:-1], np.zeros(n)
        while len(out) < n and len(q):
            out.append(-q[0])
            e = q[1:] - q[:-1] + e[1 : len(q)]
            if len(out) == n or not len(e):
                break
            out.append(-e[0])
            q = q[1 : len(e)] * e[1:] / e[:-1]
    c = np.array(out)
    bad = np.flatnonzero(~np.isfinite(c))
    return c[: bad[0]] if len(bad) else c


def evaluate(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    value = np.zeros_like(t)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for k in range(len(c) - 1, 0, -1):
            value = c[k] * t / (1 + value)
        return c[0] / (1 + value)


def gained(seen: np.ndarray, molecules: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Molecules that t times the reads again are expected to add, for rising t from 0; without a molecule seen twice, one for each read that was seen once."""
    table = np.zeros(TERMS + 2)
    small = seen <= TERMS + 1
    table[seen[small]] = molecules[small]
    run = int(np.argmin(table[1:] > 0))  # terms before the first gap
    series = table[1 : run + 1] * (-1.0) ** np.arange(run)
    if not run:
        return np.zeros_like(t)
    whole = fraction(series)
    grid = np.unique(np.concatenate((t, np.linspace(0, max(t[-1], 1), 200))))
    for degree in range(len(whole) - len(whole) % 2, LEAST - 1, -2):
        y = grid * evaluate(whole[:degree], grid)
        step = np.diff(y) / np.diff(grid)
        if np.isfinite(y).all() and (step >= -1e-9).all() and (np.diff(step) <= 1e-6 * max(step[0], 1)).all():
            return t * evaluate(whole[:degree], t)
    return t * evaluate(whole[: min(2, len(whole))], t)


def curve(seen: np.ndarray, molecules: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Expected distinct molecules among `totals` reads: below the observed number by subsampling, beyond it by the yield curve."""
    n = float((seen * molecules).sum())
    t = np.maximum(totals / n - 1, 0)
    order = np.argsort(t)
    more = np.empty(len(t))
    more[order] = gained(seen, molecules, t[order])
    share = np.minimum(totals / n, 1.0)
    below = (molecules[None, :] * (1 - (1 - share[:, None]) ** seen[None, :])).sum(1)
    return np.where(totals <= n, below, molecules.sum() + more)


def predicted(seen: np.ndarray, molecules: np.ndarray, totals: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected distinct molecules and the bounds within which 95 of 100 resampled tables lie."""
    r = np.random.default_rng(seed)
    distinct = int(molecules.sum())
    runs = []
    for _ in range(rounds):
        again = r.multinomial(distinct, molecules / distinct)
        held = again > 0
        runs.append(curve(seen[held], again[held], totals))
    low, high = np.quantile(runs, (0.025, 0.975), axis=0) if runs else (np.full(len(totals), np.nan),) * 2
    return curve(seen, molecules, totals), low, high


def extrapolate(histogram: DataFrame, by: str, step: int, upto: int, rounds: int = 100) -> DataFrame:
    """(by, total_reads, expected_distinct, lower, upper) at every multiple of `step` up to `upto` reads, for each group of counts_of_counts.

    A group is one table of different counts, so a task holds as many rows as a group has different multiplicities (the square root of twice its reads at most).
    Resampling is seeded by the group's name, so reruns agree. Groups without a fragment are not listed; without rounds the bounds are null.
    """
    totals = np.arange(step, upto + 1, step, dtype=float)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seen")
        name = own[by].iloc[0]
        mid, low, high = predicted(own["seen"].to_numpy(np.int64), own["molecules"].to_numpy(np.int64), totals, rounds, zlib.crc32(str(name).encode()))
        return pd.DataFrame({by: [name] * len(totals), "total_reads": totals.astype(np.int64), "expected_distinct": mid, "lower": low, "upper": high})

    kind = histogram.schema[by].dataType.simpleString()
    return histogram.select(by, "seen", "molecules").groupBy(by).applyInPandas(fit, f"`{by}` {kind}, total_reads long, expected_distinct double, lower double, upper double")
