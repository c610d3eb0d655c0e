"""Pileup of gapped reads and normal forms of alleles against plain versions."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.operators import alleles, pileup

READ = "sample string, qname string, chrom string, pos0 long, flag int, mapq int, cigar string, seq string, qual string"


def windows_of(spark, genome, width):
    rows = []
    for chrom, text in genome.items():
        padded = "N" + text + "N"
        rows += [(chrom, b, padded[b * width : b * width + width + 2]) for b in range(-(-len(text) // width))]
    return spark.createDataFrame(rows, "chrom string, bin long, bases string")


def plain_pileup(reads, genome, least=13):
    seen, gaps = defaultdict(list), set()
    for sample, qname, chrom, pos0, flag, _mapq, cigar, seq, qual in reads:
        if flag & 0x704 or (flag & 1 and not flag & 2) or seq == "*":
            continue
        r, q, prior = pos0, 0, None
        for n, op in ((int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
            if op in "M=X":
                for i in range(n):
                    seen[sample, qname, chrom, r + i].append((seq[q + i], ord(qual[q + i]) - 33))
            if op in "ID" and prior and prior in "M=X" and ord(qual[q - 1]) - 33 >= least:
                gaps.add((sample, qname, chrom, r - 1, n if op == "D" else 0, seq[q : q + n] if op == "I" else ""))
            r += n if op in "MDN=X" else 0
            q += n if op in "MIS=X" else 0
            prior = op
    dp, ad = defaultdict(int), defaultdict(int)
    for (sample, _, chrom, p), bases in seen.items():
        b, q = bases[0]
        for b2, q2 in bases[1:]:
            b, q = (b, min(q + q2, 93)) if b == b2 else (b, q * 4 // 5) if (-q, b) < (-q2, b2) else (b2, q2 * 4 // 5)
        if q >= least and b in "ACGT":
            dp[sample, chrom, p] += 1
            if b != genome[chrom][p]:
                ad[sample, chrom, p, genome[chrom][p], b] += 1
    for sample, _, chrom, p, gone, more in gaps:
        ad[sample, chrom, p, genome[chrom][p : p + 1 + gone], genome[chrom][p] + more] += 1
    return sorted((s, c, p + 1, ref, alt, dp[s, c, p], n) for (s, c, p, ref, alt), n in ad.items())


def drawn(seed, n, genome):
    r = random.Random(seed)
    shapes = ["20M", "4S16M", "8M3D9M", "8M2I10M", "6M30N14M", "3S5M1I4M2D7M2S", "10=1X9=", "2I12M", "5M1P6M", "9M4H"]
    out = []
    for k in range(n):
        chrom = r.choice(list(genome))
        for mate in (0, 1):
            cigar = r.choice(shapes)
            length = sum(int(x) for x in re.findall(r"(\d+)[MIS=X]", cigar))
            start = r.randrange(0, len(genome[chrom]) - 80)
            out.append((f"s{k % 2}", f"q{k}", chrom, start if not mate else max(0, out[-1][3] + r.randrange(-8, 9)), r.choice([99, 99, 99, 0, 65, 1123, 355, 4]) if not mate else 147, 60, cigar,
                        "".join(r.choice("ACGTN" if r.random() < 0.3 else genome[chrom][(start + i) % 100]) for i in range(length)), "".join(r.choice("#,5FI~") for _ in range(length))))
    return out


@pytest.mark.parametrize("width", [7, 40, 1000])
def test_pileup_against_plain_walks(spark, width):
    r = random.Random(0)
    genome = {c: "".join(r.choice("ACGT") for _ in range(300)) for c in ("x", "y")}
    reads = drawn(1, 150, genome)
    df = spark.createDataFrame(reads, READ)
    got = sorted(tuple(x) for x in pileup.pileup(df, windows_of(spark, genome, width), width).select("sample", "chrom", "pos", "ref", "alt", "dp", "ad").collect())
    assert got == plain_pileup(reads, genome) and len(got) > 300
    assert pileup.pileup(df.limit(0), windows_of(spark, genome, width), width).count() == 0


def test_pileup_leaves_odd_records_out(spark):
    genome = {"x": "ACGT" * 30}
    rows = [
        ("s", "a", "x", 4, 0, 60, "4M", "AAGT", None), ("s", "b", "x", 4, 0, 60, "4M", "AAGT", "*"), ("s", "c", "x", 4, 0, 60, "*", "AAGT", "IIII"), ("s", "d", "x", 4, 0, 60, "9M", "AAGT", "IIII"),
        ("s", "e", "x", 4, 0, 60, "4M", "*", "*"), ("s", "f", None, 4, 0, 60, "4M", "AAGT", "IIII"), ("s", "g", "x", 4, 0, 60, "4M", "aagt", "IIII"), ("s", "h", "nowhere", 4, 0, 60, "4M", "AAGT", "IIII"),
    ]
    got = pileup.pileup(spark.createDataFrame(rows, READ), windows_of(spark, genome, 50), 50).collect()
    assert [tuple(r) for r in got] == [("s", "x", 6, "C", "A", 3, 3)]


def test_depth_runs_sum_to_counted_bases(spark):
    r = random.Random(5)
    genome = {"x": "".join(r.choice("ACGT") for _ in range(300))}
    reads = drawn(2, 60, genome)
    canvas = pileup.counted(pileup.templates(pileup.blocks(pileup.walked(pileup.usable(spark.createDataFrame(reads, READ))), 64)), 13)
    runs = pileup.depth_runs(pileup.depth_steps(canvas)).agg(F.sum((F.col("pos1") - F.col("pos0")) * F.col("depth"))).first()[0]
    assert runs == canvas.select(F.sum(F.length(F.translate("mask", "0", "")))).first()[0] > 0


# Normal forms

def plain_normal(text, pos, ref, alt):
    """One base at a time, as the definition has it; a contig's start can't be left."""
    while True:
        if ref and alt and ref[-1] == alt[-1]:
            if min(len(ref), len(alt)) == 1 and pos == 1:
                return pos, ref, alt
            ref, alt = ref[:-1], alt[:-1]
        elif not ref or not alt:
            pos -= 1
            ref, alt = text[pos - 1] + ref, text[pos - 1] + alt
        else:
            break
    while min(len(ref), len(alt)) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


def variants(seed, text, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        p = r.randrange(0, len(text) - 30)
        size = r.randrange(1, 25)
        ref = text[p : p + size]
        i = r.randrange(0, size)
        kind = r.random()
        if kind < 0.4:
            alt = ref[: i + 1] + r.choice([text[max(0, p + i - 3) : p + i + 1], "A", "CA", "CACA", text[p + i + 1 : p + i + 3]]) + ref[i + 1 :]
        elif kind < 0.8:
            alt = ref[: i + 1] + ref[min(size, i + 1 + r.randrange(1, 9)) :]
        else:
            alt = "".join(r.choice("ACGT") for _ in range(r.randrange(1, 4)))
        if alt and alt != ref:
            out.append(("x", p + 1, ref, alt))
    return sorted(set(out))


@pytest.mark.parametrize("width", [3, 10, 500])
def test_normal_forms_against_single_steps(spark, width):
    r = random.Random(9)
    text = "CACACACACACA" + "A" * 40 + "".join(r.choice("ACGT") for _ in range(60)) + "GATTACA" * 12 + "CA" * 30 + "".join(r.choice("AC") for _ in range(60))
    sites = variants(3, text, 250)
    df = spark.createDataFrame(sites, "chrom string, pos long, ref string, alt string")
    got = {tuple(x[:4]): tuple(x[4:]) for x in alleles.normal_sites(df, windows_of(spark, {"x": text}, width), width).collect()}
    assert set(got) == set(sites)
    for chrom, pos, ref, alt in sites:
        want = plain_normal(text, pos, ref, alt)
        have = got[chrom, pos, ref, alt]
        # At a contig's start there are several ways to write an indel: they must give the same sequence, at the first base.
        if want[0] == 1 or have[0] == 1:
            apply = lambda v: text[: v[0] - 1] + v[2] + text[v[0] - 1 + len(v[1]) :]
            assert apply(have) == apply((pos, ref, alt)) and have[0] == 1
        else:
            assert have == want


def test_normalise_drops_wrong_references_and_unites(spark):
    text = "GGGCACACACTTT"
    rows = [("s", "x", 9, "AC", "", 5, 1), ("s", "x", 8, "CAC", "C", 30, 9), ("s", "x", 3, "GCA", "G", 40, 2), ("t", "x", 5, "ACA", "A", 7, 7), ("t", "x", 5, "G", "A", 7, 7), ("t", "x", 12, "TTTT", "T", 7, 7), ("t", "x", 4, "C", "<DEL>", 3, 1), ("t", "x", 4, "c", "t", 3, 1), ("t", "y", 4, "c", "t", 3, 1)]
    df = spark.createDataFrame([(*r, "kept") for r in rows if r[4]], "sample string, chrom string, pos long, ref string, alt string, dp long, ad long, npos string")
    w = windows_of(spark, {"x": text}, 4)
    out = alleles.normalise(df, w, 4)
    assert out.columns == df.columns
    assert sorted(tuple(r)[:7] for r in out.collect()) == [("s", "x", 3, "GCA", "G", 30, 9), ("s", "x", 3, "GCA", "G", 40, 2), ("t", "x", 3, "GCA", "G", 7, 7), ("t", "x", 4, "C", "<DEL>", 3, 1), ("t", "x", 4, "C", "T", 3, 1)]
    assert sorted(tuple(r) for r in alleles.unite(out).where("sample = 's'").collect()) == [("s", "x", 3, "GCA", "G", 40, 2)]
    assert alleles.normalise(df, w, 4, check=False).count() == df.count()
