"""Work that must not grow faster than the input: results against the plain way, and inputs on which the plain way doesn't end."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import coverage, intervals, pileup, qc, reads, variants
from strandlake.plans.catalog import QUERIES

SPAN = "chrom string, pos0 long, pos1 long"


def test_overlap_totals_against_pairs(spark):
    r = random.Random(3)
    some = lambda n, top, least: [(f"chr{r.randrange(3)}", s, s + r.randrange(least, 90)) for s in (r.randrange(top) for _ in range(n))]
    left = spark.createDataFrame(some(400, 900, 1), SPAN)
    right = spark.createDataFrame([(*x, f"g{r.randrange(6)}") for x in some(200, 700, 1)] + [("chr9", 5, 8, "none"), ("chr1", 5000, 5050, "none"), ("chr1", 3, 40, None)], f"{SPAN}, gene string")
    pairs = intervals.overlap_join(left, right, 64).groupBy("gene").agg(F.count("*").alias("n"), F.sum(F.least("pos1", "pos1_r") - F.greatest("pos0", "pos0_r")).alias("bp"))
    expected = {(x.gene, x.n, x.bp) for x in pairs.collect()}
    for width in (32, 16384):
        assert {(x.gene, x.n, x.bp) for x in intervals.overlap_totals(left, right, "gene", width).collect()} == expected
    assert len(expected) == 7 and intervals.overlap_totals(left.limit(0), right, "gene").isEmpty()


def test_overlap_totals_of_a_pile(spark):
    left = spark.range(1_000_000).selectExpr("'chr1' AS chrom", "100L AS pos0", "200L AS pos1")
    right = spark.range(1_000_000).selectExpr("'chr1' AS chrom", "150L AS pos0", "300L AS pos1", "'g' AS gene")
    assert intervals.overlap_totals(left, right, "gene").first() == ("g", 10**12, 50 * 10**12)


def test_nearest_rows_of_one_large_group(spark):
    curve = spark.range(1_500_000).selectExpr("'s' AS sample", "id * 2 AS total_reads", "id AS v")
    got = qc.nearest_row(curve, spark.createDataFrame([(-5,), (7,), (8,), (9_000_000,)], "depth long")).collect()
    assert {(x.depth, x.total_reads, x.v) for x in got} == {(-5, 0, 0), (7, 6, 3), (8, 8, 4), (9_000_000, 2_999_998, 1_499_999)}


def test_chunks_are_no_partitions(spark):
    df = spark.range(0, 1000, 1, 6).selectExpr("concat('r', id % 300) AS qname")
    dealt = reads.chunked(df, 2)
    assert dealt.rdd.getNumPartitions() == 6
    assert dealt.groupBy("qname").agg(F.count_distinct("chunk").alias("n")).where("n > 1").isEmpty() and dealt.select("chunk").distinct().count() == 2


def test_gene_counts_do_not_shuffle_a_row_for_each_gene(spark):
    """Fragments of one record and of several, reads of several lengths, overlapping genes, against a row for each gene."""
    r = random.Random(5)
    exons = spark.createDataFrame([("chr1", s, s + r.randrange(5, 400), f"g{r.randrange(5)}") for s in (r.randrange(6000) for _ in range(60))], f"{SPAN}, gene string")
    aligned = [(f"c{k % 2}", f"q{r.randrange(150)}" if k % 3 else f"own{k}", "chr1", s, s + r.randrange(1, 700), 0, "=") for k, s in enumerate(r.randrange(6000) for _ in range(500))]
    df = spark.createDataFrame(aligned + [("c0", None, "chr1", 10, 20, 0, "=")], "cell string, qname string, chrom string, pos0 long, pos1 long, flag int, mate_chrom string")
    merged = intervals.merge(exons, ("chrom", "gene"))
    hits = intervals.overlap_join(df, merged).groupBy("cell", "qname", "gene").agg(F.sum(F.least("pos1", "pos1_r") - F.greatest("pos0", "pos0_r")).alias("bp"))
    length = df.groupBy("cell", "qname").agg(F.sum(F.col("pos1") - F.col("pos0")).alias("length"))
    one = hits.join(length, ["cell", "qname"]).where("bp >= 0.5 * length").groupBy("cell", "qname").agg(F.min("gene").alias("gene"), F.count("*").alias("k")).where("k = 1")
    got = intervals.gene_counts(df, exons)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in one.groupBy("gene", "cell").count().collect()}
    assert "SortMergeJoin [cell" not in got._jdf.queryExecution().toString()


def test_lorenz_and_gini_sort_a_row_for_each_value(spark):
    """A group of many bins with few values: windows get its runs, and the curve is that of single bins."""
    r = random.Random(7)
    values = {"a": [r.randrange(1, 5) for _ in range(997)], "b": [3] * 40, "c": [9]}
    df = spark.createDataFrame([(c, x) for c, xs in values.items() for x in xs], "cell string, value long")
    for n in (1000, None):
        got = {}
        for x in coverage.lorenz(df, n=n).collect():
            got.setdefault(x.cell, []).append((x.cumulative_fraction_genome, x.cumulative_fraction_reads))
        for c, xs in values.items():
            full = sorted(xs + [0] * ((n or len(xs)) - len(xs)))
            sums = [sum(full[: k + 1]) / sum(full) for k in range(len(full))]
            at = [divmod(len(full) * j, 99) for j in range(100)]
            expected = [1.0 if k + 1 >= len(full) else sums[k] + f / 99 * (sums[k + 1] - sums[k]) for k, f in at]
            assert [y for _, y in sorted(got[c])] == pytest.approx(expected, abs=1e-9)
            gini = {x.cell: x.gini for x in coverage.gini(df, n=n).collect()}[c]
            assert gini == pytest.approx(1 - 2 / len(full) * (sum(sums) - (sums[0] + 1) / 2), abs=1e-9)
    assert {x.cell: x.m for x in coverage._runs(df, "cell", "value", 1000).where("value = 3 or value = 9").collect()}["b"] == 40


def test_folded_templates_and_checked_sites_are_made_once(spark):
    """What several branches of a plan read comes from a checkpoint: the results' plans hold no more folding of templates and no spelling of references for the check."""
    plan = lambda q: QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(start" not in plan("q67_gapped_pileup")
    assert "parquet" not in plan("q72_joint_genotypes")
    assert "collect_list(struct(bin" not in plan("q68_normalised_alleles")


def test_calls_of_a_site_are_gathered_once(spark):
    rows = [("s1", "c", 1, "A", "C", 9, 4), ("s2", "c", 1, "A", "G", 8, 8), ("s2", "c", 1, "A", "C", 7, 0), ("s3", None, 1, "A", "C", 5, 1), (None, "c", 2, "T", "C", 5, 1), ("s9", "c", 3, "T", "G", 5, 1), ("s1", "c", 1, "A", "C", 3, 3)]
    calls = spark.createDataFrame(rows, "sample string, chrom string, pos long, ref string, alt string, dp long, ad long")
    names = spark.createDataFrame([(s,) for s in ("s1", "s2", "s3", "s1", None)], "sample string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = variants.merge_sites(calls.repartition("chrom", "pos", "ref"), names)
        called = variants.combine_genotypes(calls.limit(3).unionAll(calls.where("sample = 's9' OR chrom IS NULL")).repartition("chrom", "pos", "ref"))
        for df in (merged, called):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(chrom") == 1
        got = sorted(merged.collect(), key=str)
        assert sorted((r.sample, r.alt, r.gt, r.dp, r.ad) for r in called.collect()) == [("s1", "C,G", "0/1", 9, [4, 0]), ("s2", "C,G", "2/2", 8, [0, 8]), ("s9", "G", "0/1", 5, [1])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    want = []
    for site in {r[1:5] for r in rows}:
        for s in ("s1", "s2", "s3", None):
            own = [r[5:] for r in rows if s and None not in site and r[0] == s and r[1:5] == site]
            want += [(s, *site, *x) for x in own or [(None, None)]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("least", [-40, 0, 13, 60])
def test_masks_are_cut_by_stretches_of_quality(spark, least):
    rows = [("ACGTN-AC", "I!,-.II~"), ("", ""), ("GGG", "~~~"), ("TTT", "!!!")]
    got = pileup.counted(spark.createDataFrame(rows, "b string, q string"), least)
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(b, "".join("1" if x in "ACGT" and ord(y) - 33 >= least else "0" for x, y in zip(b, q, strict=True))) for b, q in rows}
    assert {(r.b, r["mask"]) for r in got.collect()} == want
