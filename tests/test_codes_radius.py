"""Correction at any radius against all comparisons."""

import random

import pytest

from strandlake.operators import codes


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_within_against_all_codes(spark, radius):
    r = random.Random(radius)
    listed = [(p, k, "".join(r.choice("ACGT") for _ in range(8))) for p in "DA" for k in range(12)]
    seen = set()
    for p, _, seq in listed:
        for _ in range(25):
            s = list(seq)
            for _ in range(r.randrange(0, 6)):
                s[r.randrange(8)] = r.choice("ACGTN")
            seen.add((p, "".join(s)))
    seen |= {("D", ""), ("D", "ACG"), ("B", "ACGTACGT")}
    df = spark.createDataFrame(sorted(seen), "position string, observed string")
    got = {(x.position, x.observed): (x.distance, x.corrected) for x in codes.within(df, spark.createDataFrame(listed, "position string, ord int, seq string"), radius).collect()}
    want = {}
    for p, o in seen:
        best = min(((sum(a != b for a, b in zip(o, s, strict=True)), k, s) for q, k, s in listed if q == p and len(s) == len(o)), default=None)
        if best and best[0] <= radius:
            want[p, o] = (best[0], best[2])
    assert got == want and len(got) > 10


def test_own_radius_and_close_codes(spark):
    rows = [("D", 0, "AAAAAAAA"), ("D", 1, "CCCCAAAA"), ("C", 0, "AAAAAAAA"), ("C", 1, "AAAAAAAC")]
    listed = spark.createDataFrame(rows, "position string, ord int, seq string")
    seen = spark.createDataFrame([("D", "AACCAAAA"), ("D", "GGGAAAAA"), ("C", "AAAAAAAA")], "position string, observed string")
    # D: radius 2, the first code wins a tie; C: codes that differ in one letter correct nothing, as the list's radius is below 0.
    assert [tuple(x) for x in codes.within(seen, listed).collect()] == [("D", "AACCAAAA", "AAAAAAAA", 2)]
