"""Packs of counted bases and their sweep against the column expressions that say the same."""

import random

import pyarrow as pa
import pytest

from strandlake.operators import joint, pileup, sweep
from strandlake.plans.catalog import QUERIES

from .test_calling import READ, drawn, plain_pileup, windows_of


def genome_of(seed):
    r = random.Random(seed)
    return {c: "".join(r.choice("ACGT") for _ in range(300)) for c in ("x", "y")}


def by_columns(df, width):
    """Runs of depth by the column expressions, base by base."""
    canvas = pileup.counted(pileup.templates(pileup.blocks(pileup.walked(pileup.usable(df)), width)), 13)
    return pileup.depth_runs(pileup.depth_steps(canvas))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bases_are_not_walked_one_by_one_in_expressions(spark):
    plan = QUERIES["q67_gapped_pileup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan
    runs = pileup.covered_runs(spark.createDataFrame(drawn(1, 3, genome_of(0)), READ), 40)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "collect_list" not in plan and "regexp_extract_all" not in plan


@pytest.mark.parametrize("width", [7, 1000])
def test_runs_equal_those_of_columns(spark, width):
    reads = drawn(4, 120, genome_of(0))
    # Templates of three and more records, names and contigs that are null, and letters that are none.
    r = random.Random(1)
    odd = [(s, q if r.random() < 0.9 else "q1", c, p + r.randrange(3), 0, m, *x) for s, q, c, p, _, m, *x in reads[:90]]
    odd += [(None, None, "x", 5, 0, 60, "4M", "ACGT", None), (None, None, "x", 7, 0, 60, "4M", "AéGT", "IIII"), ("s0", "n", None, 5, 0, 60, "4M", "ACGT", "II~é"), ("s0", "n", None, -3, 0, 60, "2M2D2M", "ACGT", "IIII"), ("s0", "z", "x", None, 0, 60, "4M", "ACGT", "IIII")]
    odd += [("s0", f"w{k}", "x", 9, 0, 60, *x) for k, x in enumerate([("1M", "*", "I"), (None, "A", "I"), ("1M", None, "I"), ("1M", "A", "*"), ("M1", "A", "I"), ("1MM", "A", "I"), ("", "", ""), ("5H", "", ""), ("1M", "a", None)])]
    df = spark.createDataFrame(reads + odd, READ)
    columns = ["sample", "chrom", "bin", "pos0", "pos1", "depth"]
    got = rows(pileup.covered_runs(df, width).select(*columns))
    assert got == rows(by_columns(df, width).select(*columns)) and len(got) > 200


def test_small_chunks_and_deep_bins(spark, monkeypatch):
    """Batches and chunks cut anywhere, and bins deep enough for counts instead of bases, give the same alleles."""
    genome, width = genome_of(2), 40
    reads = drawn(3, 400, {c: g[:100] for c, g in genome.items()})
    used = sorted((x for x in reads if not x[4] & 0x704 and (not x[4] & 1 or x[4] & 2)), key=lambda x: (x[0], x[1], x[2]))
    names = ["sample", "qname", "chrom", "pos0", "cigar", "seq", "qual"]
    table = pa.table({n: [dict(zip(["sample", "qname", "chrom", "pos0", "flag", "mapq", "cigar", "seq", "qual"], x, strict=True))[n] for x in used] for n in names})
    want = [x for x in plain_pileup(reads, genome) if len(x[3]) == 1 or (x[2] - 1) % width + len(x[3]) <= width]
    for chunk, step in ((60, 3), (100_000, 1000)):
        monkeypatch.setattr(sweep, "_CHUNK", chunk)
        packs = pa.Table.from_batches(list(sweep.packing(width, 13)(iter(table.to_batches(step))))).to_pylist()
        assert {p["kind"] for p in packs} == ({sweep.PACK, sweep.INDEL} if chunk == 60 else {sweep.PACK, sweep.INDEL, sweep.COUNTS})
        packs += [{"chrom": c, "bin": b, "kind": sweep.WINDOW, "more": ("N" + g + "N")[b * width : b * width + width + 2]} for c, g in genome.items() for b in range(-(-len(g) // width))]
        packs.sort(key=lambda p: (p["chrom"], p["bin"], p.get("sample") or "", p["kind"]))
        schema = sweep._SCHEMAS[sweep.PACKED]
        dealt = pa.Table.from_pylist(packs, schema).to_batches(step)
        found = [r for b in sweep.sweeping(width, None, False)(iter(dealt)) for r in b.to_pylist()]
        assert sorted((r["sample"], r["chrom"], r["pos0"] + 1, r["ref"], r["alt"], r["dp"], r["ad"]) for r in found if r["ref"]) == want


def test_deletions_across_windows(spark):
    genome = genome_of(5)
    x = genome["x"]
    reads = [("s", "a", "x", 2, 0, 60, "4M45D4M", x[2:6] + x[51:55], None), ("s", "b", "x", 8, 0, 60, "1M1D2I1M", x[8] + "GG" + x[10], None), ("s", "c", "x", 290, 0, 60, "5M9D1M", x[290:295] + "A", None)]
    df = spark.createDataFrame(reads, READ)
    got = sorted(tuple(r) for r in pileup.pileup(df, windows_of(spark, genome, 10), 10).where("length(ref) > 1").select("pos", "ref", "alt", "dp", "ad").collect())
    assert got == [(6, x[5:51], x[5], 1, 1), (9, x[8:10], x[8], 1, 1)]


def test_blocks_are_made_where_depth_is_counted(spark):
    df = spark.createDataFrame(drawn(6, 200, genome_of(0)), READ)
    columns = ["sample", "chrom", "bin", "pos0", "pos1", "min_dp"]
    for classes in ((1,), (1, 3, 5), (4,)):
        want = joint.reference_blocks(pileup.covered_runs(df, 40), classes)
        assert rows(pileup.covered_blocks(df, 40, classes).select(*columns)) == rows(want.select(*columns))
    plan = QUERIES["q71_reference_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "zip_with" not in plan


def test_alleles_and_blocks_of_one_count(spark):
    genome = genome_of(0)
    df, windows = spark.createDataFrame(drawn(8, 100, genome), READ), windows_of(spark, genome, 40)
    found, blocks = pileup.pileup_and_blocks(df, windows, 40, (1, 3))
    assert rows(found) == rows(pileup.pileup(df, windows, 40)) and rows(blocks) == rows(pileup.covered_blocks(df, 40, (1, 3)))
    assert "MapInArrow" not in found.unionByName(blocks, allowMissingColumns=True)._jdf.queryExecution().optimizedPlan().toString()
