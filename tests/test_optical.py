"""Optical duplicates against plain components, and nearest rows against a full comparison."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.operators import optical, qc


def plain_components(points, distance):
    left, out = set(points), {}
    while left:
        start = left.pop()
        group, stack = {start}, [start]
        while stack:
            s, t, x, y = stack.pop()
            for p in [p for p in left if p[:2] == (s, t) and abs(p[2] - x) <= distance and abs(p[3] - y) <= distance]:
                left.discard(p)
                group.add(p)
                stack.append(p)
        least = min((p[2] // (distance + 1), p[3] // (distance + 1)) for p in group)
        out |= dict.fromkeys(group, least)
    return out


@pytest.mark.parametrize("distance", [1, 7, 30])
def test_squares_are_components(spark, distance):
    r = random.Random(distance)
    points = sorted({(f"s{r.randrange(2)}", r.randrange(2), r.randrange(200), r.randrange(60)) for _ in range(250)} | {("chain", 0, 5 * k, 3) for k in range(60)})
    got = optical.squares(spark.createDataFrame(points, "set string, tile long, x long, y long"), distance).collect()
    label = {(q["set"], q.tile, q.gx, q.gy): tuple(q.label) for q in got}
    assert {p: label[p[0], p[1], p[2] // (distance + 1), p[3] // (distance + 1)] for p in points} == plain_components(points, distance)


def test_squares_need_no_rounds_and_no_driver(spark, monkeypatch):
    cut = []
    monkeypatch.setattr(optical, "settle", lambda df: cut.append(df) or df)
    chain = spark.createDataFrame([("chain", 0, 5 * k, 3) for k in range(300)], "set string, tile long, x long, y long")
    found = optical.squares(chain, 7)
    assert {tuple(r.label) for r in found.collect()} == {(0, 0)} and not cut
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_location_and_metrics(spark):
    names = ["A:1:F:2:1101:15:20", "1101:5:6", "r1:2:3:4/1", "none", None, "a:b:c"]
    df = spark.createDataFrame([(n,) for n in names], "qname string").select(optical.location().alias("at"))
    assert [tuple(r.at) if r.at else None for r in df.collect()] == [(1101, 15, 20), None, (2, 3, 4), None, None, None]
    rows = []
    for k, (tile, x, y, score) in enumerate([(1, 0, 0, 30), (1, 50, 60, 20), (1, 120, 130, 40), (2, 50, 60, 10), (1, 900, 900, 5), (1, 950, 980, 6)]):
        for flag, pos in ((99, 100), (147, 300)):
            rows.append(("c", f"q{k}:{tile}:{x}:{y}", flag, "chr1", pos, "50M", score))
    df = spark.createDataFrame(rows, "cell string, qname string, flag int, chrom string, pos0 long, cigar string, score long")
    got = {r.qname.split(":")[0]: r.optical for r in optical.optical_templates(df).collect()}
    assert got == {"q0": True, "q1": True, "q2": False, "q3": False, "q4": True, "q5": False}
    m = optical.metrics(df).collect()[0]
    assert (m.read_pairs_examined, m.read_pair_duplicates, m.read_pair_optical_duplicates) == (6, 5, 3)
    assert optical.optical_templates(df.limit(0)).count() == 0


def test_nearest_rows_against_all(spark):
    r = random.Random(4)
    curve = [(g, x, f"{g}{x}") for g in "abc" for x in r.sample(range(0, 1000, 5), 30)]
    depths = [-5, 0, 12, 13, 400, 5000]
    got = {(q.sample, q.depth): (q.total_reads, q.v) for q in qc.nearest_row(spark.createDataFrame(curve + [("d", None, "z")], "sample string, total_reads long, v string"), spark.createDataFrame([(d,) for d in depths], "depth long")).collect()}
    want = defaultdict(list)
    for g, x, v in curve:
        for d in depths:
            want[g, d].append((abs(x - d), x, v))
    assert got == {k: min(v)[1:] for k, v in want.items()}
    assert qc.nearest_row(spark.createDataFrame([], "sample string, total_reads long, v string"), spark.createDataFrame([(1,)], "depth long")).select(F.count("*")).first()[0] == 0


def test_touching_reads_of_all_lengths(spark):
    """Reads from one base to most of a contig against disjoint intervals."""
    from strandlake.operators import intervals

    r = random.Random(8)
    sets = {}
    for name in ("few", "many"):
        at, own = 0, []
        while at < 300_000:
            at += r.choice([1, 50, 5000]) if name == "many" else r.choice([3000, 70_000])
            own.append(("x", at, at + r.choice([1, 40, 3000])))
            at = own[-1][2]
        sets[name] = own
    reads = [("x", a, a + n) for a, n in ((r.randrange(300_000), r.choice([1, 2, 100, 1023, 1024, 1025, 40_000, 250_000])) for _ in range(400))] + [("y", 1, 5), ("x", 0, 1)]
    made = {k: spark.createDataFrame(v, "chrom string, pos0 long, pos1 long") for k, v in sets.items()}
    got = intervals.touching(spark.createDataFrame(reads, "chrom string, pos0 long, pos1 long"), made).collect()
    assert len(got) == len(reads)
    for q in got:
        for name, own in sets.items():
            assert q[name] == any(c == q.chrom and a < q.pos1 and b > q.pos0 for c, a, b in own)
    assert intervals.touching(made["few"].limit(0), made).count() == 0
