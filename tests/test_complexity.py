"""The yield curve against a dense solution and against what deeper sequencing shows."""

from fractions import Fraction

import numpy as np
import pytest

from strandlake.functions import complexity


def library(seed, molecules, reads):
    """(molecule of each read) from a library of uneven abundance."""
    r = np.random.default_rng(seed)
    p = r.gamma(1.2, 1.0, molecules)
    return r.choice(molecules, reads, p=p / p.sum())


def table(drawn):
    seen, n = np.unique(np.unique(drawn, return_counts=True)[1], return_counts=True)
    return seen.astype(np.int64), n.astype(np.int64)


@pytest.mark.parametrize("terms", [2, 4, 6])
def test_fraction_equals_the_dense_rational_function(terms):
    """A continued fraction of so many terms is the rational function whose power series has these terms, solved here exactly."""
    n = [900, 400, 220, 130, 80, 50][:terms]
    series = [Fraction((-1) ** k * v) for k, v in enumerate(n)]
    half = terms // 2
    # Numerator of degree half - 1, denominator 1 + b1 t + ... of degree half.
    rows = [[series[half - 1 + i - j] if half - 1 + i - j >= 0 else Fraction(0) for j in range(half)] for i in range(half)]
    right = [-series[half + i] for i in range(half)]
    for i in range(half):
        pivot = next(k for k in range(i, half) if rows[k][i])
        rows[i], rows[pivot], right[i], right[pivot] = rows[pivot], rows[i], right[pivot], right[i]
        for k in range(half):
            if k != i:
                f = rows[k][i] / rows[i][i]
                rows[k] = [x - f * y for x, y in zip(rows[k], rows[i], strict=True)]
                right[k] -= f * right[i]
    b = [Fraction(1)] + [right[i] / rows[i][i] for i in range(half)]
    a = [sum(series[k - j] * b[j] for j in range(k + 1)) for k in range(half)]
    c = complexity.fraction(np.array([float(s) for s in series]))
    for t in (0.0, 0.5, 1.0, 3.0, 20.0):
        dense = sum(float(x) * t**k for k, x in enumerate(a)) / sum(float(x) * t**k for k, x in enumerate(b))
        assert abs(complexity.evaluate(c, np.array([t]))[0] - dense) < 1e-6 * abs(dense)


def test_predicts_a_nested_deeper_sample(spark):
    drawn = library(1, 30_000, 120_000)
    part = drawn[:20_000]
    df = spark.createDataFrame([("a", int(m)) for m in part] + [("b", int(m)) for m in part[:9000]], "cell string, molecule long")
    histogram = complexity.counts_of_counts(df, "cell", ["molecule"])
    got = {(r.cell, r.total_reads): r for r in complexity.extrapolate(histogram, "cell", 10_000, 120_000, rounds=40).collect()}
    for reads in (10_000, 20_000, 40_000, 80_000, 120_000):
        truth = len(set(drawn[:reads].tolist()))
        r = got["a", reads]
        # Within 3 of 100 up to twice the reads, within 10 of 100 up to six times.
        assert abs(r.expected_distinct - truth) < (0.03 if reads <= 40_000 else 0.1) * truth
        assert r.lower <= r.expected_distinct * 1.02 and r.upper >= r.expected_distinct * 0.98
    curve = [got["a", n].expected_distinct for n in range(10_000, 120_001, 10_000)]
    assert all(0 < b - a for a, b in zip(curve, curve[1:], strict=False))
    again = {(r.cell, r.total_reads): r for r in complexity.extrapolate(histogram.repartition(3), "cell", 10_000, 120_000, rounds=40).collect()}
    assert again == got


def test_thin_tables(spark):
    once = spark.createDataFrame([("u", 1, 50)], "cell string, seen long, molecules long")
    got = complexity.extrapolate(once, "cell", 50, 200, rounds=0).collect()
    assert [(r.total_reads, r.expected_distinct) for r in got] == [(50, 50), (100, 100), (150, 150), (200, 200)]
    many = spark.createDataFrame([("v", 40, 10)], "cell string, seen long, molecules long")
    assert all(abs(r.expected_distinct - 10) < 1e-6 for r in complexity.extrapolate(many, "cell", 400, 4000).collect())
    assert complexity.extrapolate(once.limit(0), "cell", 50, 200).count() == 0
    seen, n = table(library(2, 500, 20_000))
    assert abs(complexity.curve(seen, n, np.array([200_000.0]))[0] - n.sum()) < 0.02 * n.sum()
