"""The sparse joint store: batches, interrupted runs, and genotypes that tell reference from no coverage."""

from pathlib import Path

from strandlake.operators import joint, variants

CALLS = "sample string, chrom string, pos long, ref string, alt string, dp long, ad long"
RUNS = "sample string, chrom string, bin long, pos0 long, pos1 long, depth long"
WIDTH = 100


def given(spark):
    calls = spark.createDataFrame([("a", "x", 11, "A", "C", 9, 4), ("a", "x", 11, "A", "G", 9, 5), ("b", "x", 50, "T", "TA", 3, 3), ("c", "x", 150, "G", "T", 2, 2)], CALLS)
    runs = spark.createDataFrame([
        ("a", "x", 0, 5, 20, 9), ("a", "x", 0, 20, 30, 2), ("a", "x", 0, 49, 60, 1), ("b", "x", 0, 0, 10, 7), ("b", "x", 0, 10, 11, 4), ("b", "x", 0, 48, 51, 3), ("c", "x", 1, 140, 160, 2), ("c", "y", 0, 0, 99, 1),
    ], RUNS)
    return calls, runs


def test_blocks_merge_runs_of_one_class(spark):
    got = sorted(tuple(r) for r in joint.reference_blocks(given(spark)[1], (1, 5)).select("sample", "pos0", "pos1", "min_dp").collect())
    assert got == [("a", 5, 20, 9), ("a", 20, 30, 2), ("a", 49, 60, 1), ("b", 0, 10, 7), ("b", 10, 11, 4), ("b", 48, 51, 3), ("c", 0, 99, 1), ("c", 140, 160, 2)]
    one = sorted(tuple(r) for r in joint.reference_blocks(given(spark)[1]).where("sample <> 'c'").select("sample", "pos0", "pos1", "min_dp").collect())
    assert one == [("a", 5, 30, 2), ("a", 49, 60, 1), ("b", 0, 11, 4), ("b", 48, 51, 3)]
    assert [r.pos0 for r in joint.reference_blocks(given(spark)[1], (5,)).where("sample = 'a'").collect()] == [5]


def expected(calls, blocks):
    sites = {(c, p, r, a) for _, c, p, r, a, _, _ in calls}
    own = {(s, c, p, r, a) for s, c, p, r, a, _, _ in calls}
    out = list(calls)
    for s, c, p0, p1, dp in blocks:
        out += [(s, c, p, r, a, dp, 0) for cc, p, r, a in sites if cc == c and p0 < p <= p1 and (s, c, p, r, a) not in own]
    return sorted(out)


def test_store_in_batches(spark, tmp_path):
    calls, runs = given(spark)
    path = str(tmp_path / "store")
    first, rest = calls.where("sample = 'a'"), calls.where("sample <> 'a'")
    blocks = joint.reference_blocks(runs, (1, 5))
    assert joint.append(first, blocks.where("sample = 'a'"), path, "one", WIDTH)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    # An interrupted batch: alleles and blocks but no list of samples.
    joint.append(rest, blocks.where("sample <> 'a'"), path, "two", WIDTH)
    for p in (Path(path) / "samples" / "batch=two").iterdir():
        p.unlink()
    (Path(path) / "samples" / "batch=two").rmdir()
    alleles, held, samples = joint.open_store(spark, path)
    assert {r.sample for r in samples.collect()} == {"a"} and {r.sample for r in alleles.collect()} == {"a"} == {r.sample for r in held.collect()}
    assert joint.append(rest, blocks.where("sample <> 'a'"), path, "two", WIDTH)
    assert not joint.append(rest, blocks, path, "two", WIDTH)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    alleles, held, samples = joint.open_store(spark, path)
    got = joint.genotypes(alleles, held)
    plain = [tuple(r) for r in calls.collect()]
    assert sorted(tuple(r) for r in got.select(*calls.columns).collect()) == expected(plain, [tuple(r) for r in blocks.select("sample", "chrom", "pos0", "pos1", "min_dp").collect()])
    # The dense merge has the same alleles, and depths where it knew nothing.
    dense = {(r.sample, r.pos, r.alt): (r.dp, r.ad) for r in joint.dense(got, samples).collect()}
    for r in variants.merge_sites(calls, calls).collect():
        dp, ad = dense.pop((r.sample, r.pos, r.alt))
        assert (dp, ad) == (r.dp, r.ad) if r.dp is not None else ad in (None, 0)
    assert not dense


def test_empty_store(spark):
    calls, runs = given(spark)
    none = joint.genotypes(calls.limit(0).selectExpr("*", "0L AS bin"), joint.reference_blocks(runs.limit(0)))
    assert none.count() == 0
