"""Regressions, tests and histograms as closed forms over aggregates; Student's t as an Arrow function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_cdf(t: float, df: float) -> float:
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t; null where an argument is."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else 2 * t_cdf(-abs(a), b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def critical_t(df: pd.Series) -> pd.Series:
    """The 97.5 % point of Student's t."""
    return pd.Series([None if pd.isna(b) or b <= 0 else t_quantile(0.975, b) for b in df], dtype="float64")


def log_linear(df: DataFrame, by: str, x: str, count: str) -> DataFrame:
    """Least squares of ln(count) on x over positive counts: slope, intercept, r2, standard error of the slope, p-value."""
    rows = df.where(F.col(count) > 0).select(by, F.col(x).cast("double").alias("x"), F.log(F.col(count).cast("double")).alias("y"))
    a = rows.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    error = F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0)), (F.col("n") - 2) * F.col("sxx"))))
    return a.withColumn("stderr", error).drop("sxx", "syy")


def with_slope_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", two_sided_p(F.try_divide(F.col("slope"), F.col("stderr")), (F.col("n") - 2).cast("double")))


def mean_interval(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, sd, standard error of the mean and the bounds of the 95 % t-interval."""
    a = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    a = a.withColumn("sem", F.col("sd") / F.sqrt("n"))
    half = critical_t((F.col("n") - 1).cast("double")) * F.col("sem")
    return a.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def _two(df: DataFrame, by: str, value: str, first: str, second: str) -> DataFrame:
    side = lambda g, k: [F.count(F.when(F.col(by) == g, F.col(value))).alias(f"n{k}"), F.avg(F.when(F.col(by) == g, F.col(value))).alias(f"m{k}"), F.var_samp(F.when(F.col(by) == g, F.col(value))).alias(f"v{k}")]
    return df.agg(*side(first, 1), *side(second, 2))


def welch(df: DataFrame, by: str, value: str, first: str, second: str) -> DataFrame:
    """t and degrees of freedom of two groups with unequal variances, with their sizes, means and variances."""
    a = _two(df, by, value, first, second).withColumns({"s1": F.col("v1") / F.col("n1"), "s2": F.col("v2") / F.col("n2")})
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(F.col("s1") + F.col("s2")))
    d = F.try_divide(F.pow(F.col("s1") + F.col("s2"), F.lit(2.0)), F.col("s1") * F.col("s1") / (F.col("n1") - 1) + F.col("s2") * F.col("s2") / (F.col("n2") - 1))
    return a.withColumns({"t": t, "df": d}).drop("s1", "s2")


def student(df: DataFrame, by: str, value: str, first: str, second: str, log: bool = False) -> DataFrame:
    """The same with equal variances, on log10 of the values if asked."""
    rows = df.withColumn(value, F.log10(value)) if log else df
    a = _two(rows, by, value, first, second)
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return a.withColumns({"t": F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))), "df": (F.col("n1") + F.col("n2") - 2).cast("double")})


def delta_ratio(mean_a: Column, se_a: Column, mean_b: Column, se_b: Column) -> tuple[Column, Column]:
    """Ratio of two independent means and its standard error by the delta method."""
    ratio = mean_a / mean_b
    return ratio, F.abs(ratio) * F.sqrt(se_a * se_a / (mean_a * mean_a) + se_b * se_b / (mean_b * mean_b))


def doublings(slope: Column, days: float = 1.0) -> Column:
    """Doublings in `days` from a slope of ln(count) per day."""
    return slope / math.log(2) * days


def per_passage(value: Column, passage: Column, ratio: Column) -> Column:
    """A count without the growth of the passages before it: value / ratio^passage; null where the ratio is 0 or anything is missing."""
    return F.try_divide(value.cast("double"), F.pow(ratio.cast("double"), passage.cast("double")))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: str | None = None, weight: str | None = None, log: bool = False) -> DataFrame:
    """(by, bin, n): bins of equal width between low and high (of log10 if asked), the last one closed; weighted if asked."""
    x = F.log10(value) if log else F.col(value).cast("double")
    lo, hi = (math.log10(low), math.log10(high)) if log else (low, high)
    at = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("long")
    rows = df.where((F.col(value) >= low) & (F.col(value) <= high))
    return rows.groupBy(*([by] if by else []), at.alias("bin")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def mixed_model(df: DataFrame, y: str, group: str, fixed: list[str], slope: str | None = None) -> DataFrame:
    """REML fit of y on fixed columns with a random intercept (and slope) for each group: (term, estimate, std_error).

    Rows with a null are left out. Spark sums the cross products of 1, fixed columns, slope and y for each group; the fit
    needs no more than these sums (Woodbury form), which are one row for each group. No rows give no terms.
    """
    names = ["intercept", *fixed]
    extra = [slope] if slope and slope not in fixed else []
    columns = [*fixed, *extra, y]
    p, q = len(names), 2 if slope else 1
    at_z = [0] + ([1 + columns.index(slope)] if slope else [])
    at_y = len(columns)
    values = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns]]
    products = [(i, j) for i in range(len(values)) for j in range(i, len(values))]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(pdf), at_y + 1, at_y + 1))
        for k, (i, j) in enumerate(products):
            m[:, i, j] = m[:, j, i] = pdf[f"s{k}"].to_numpy(float)
        n, total = m[:, 0, 0].sum(), m.sum(axis=0)
        xx, xy, yy = total[:p, :p], total[:p, at_y], total[at_y, at_y]
        zz, zx, zy = m[:, at_z][:, :, at_z], m[:, at_z, :p], m[:, at_z, at_y]

        def solve(theta):
            low = np.zeros((q, q))
            low[np.tril_indices(q)] = theta
            inner = np.eye(q) + low.T @ zz @ low  # inv(I + Z G Z') = I - Z L inv(I + L' Z'Z L) L' Z'
            bx, by = low.T @ zx, (low.T @ zy[:, :, None])[:, :, 0]
            kx, ky = np.linalg.solve(inner, bx), np.linalg.solve(inner, by[:, :, None])[:, :, 0]
            xvx = xx - np.einsum("gqi,gqj->ij", bx, kx)
            xvy = xy - np.einsum("gqi,gq->i", bx, ky)
            yvy = yy - np.einsum("gq,gq->", by, ky)
            beta = np.linalg.solve(xvx, xvy)
            rss = yvy - beta @ xvy
            return beta, xvx, rss, (n - p) * math.log(max(rss, 1e-300)) + np.linalg.slogdet(inner)[1].sum() + np.linalg.slogdet(xvx)[1]

        theta = np.eye(q)[np.tril_indices(q)].astype(float)
        step, best = 0.5, solve(theta)[3]
        while step > 1e-7:  # pattern search over the factor of the covariance
            moved = False
            for k in range(len(theta)):
                for sign in (step, -step):
                    trial = theta.copy()
                    trial[k] += sign
                    if (value := solve(trial)[3]) < best - 1e-12:
                        theta, best, moved = trial, value, True
            step = step if moved else step / 2
        beta, xvx, rss, _ = solve(theta)
        errors = np.sqrt(np.diag(np.linalg.inv(xvx)) * rss / (n - p))
        return pd.DataFrame({"term": names, "estimate": beta, "std_error": errors})

    sums = df.dropna(subset=[y, group, *fixed, *extra]).groupBy(group).agg(*[F.sum(values[i] * values[j]).alias(f"s{k}") for k, (i, j) in enumerate(products)])
    return sums.drop(group).groupBy().applyInPandas(lambda pdf: fit(pdf), "term string, estimate double, std_error double")


def signature_weights(spectra: DataFrame, signatures: DataFrame, by: str = "sample") -> DataFrame:
    """(by, signature, weight): non-negative least squares of each spectrum (by, context, n) on signatures (signature, context, share), which must be few."""
    table = signatures.toPandas().pivot(index="context", columns="signature", values="share").fillna(0.0)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a = table.to_numpy()
        b = pdf.set_index("context")["n"].reindex(table.index).fillna(0.0).to_numpy(float)
        x = np.zeros(a.shape[1])
        active: list[int] = []
        for _ in range(10 * a.shape[1]):
            w = a.T @ (b - a @ x)
            rest = [k for k in range(len(x)) if k not in active and w[k] > 1e-10]
            if not rest:
                break
            active.append(max(rest, key=lambda k: w[k]))
            while True:
                s = np.zeros_like(x)
                s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
                if (s[active] > 0).all():
                    x = s
                    break
                low = [k for k in active if s[k] <= 0]
                step = min(x[k] / (x[k] - s[k]) for k in low)
                x = x + step * (s - x)
                active = [k for k in active if x[k] > 1e-12]
        return pd.DataFrame({by: pdf[by].iloc[0], "signature": table.columns, "weight": x})

    return spectra.groupBy(by).applyInPandas(fit, f"{by} string, signature string, weight double")


def combined(df: DataFrame, terms: list[str], name: str = "combined") -> DataFrame:
    """Adds the sum of some coefficients, such as that of passage and that of its interaction with the genotype."""
    total = F.col(terms[0])
    for t in terms[1:]:
        total = total + F.col(t)
    return df.withColumn(name, total)
