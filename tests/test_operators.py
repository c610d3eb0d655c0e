"""Small cases with answers worked out by hand."""

import gzip
import math
import struct
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import stats
from strandlake.operators import cells, codes, coverage, intervals, logs, qc, reads, variants
from strandlake.plans.catalog import QUERIES
from strandlake.sources import binary, dashboard, readers, writers

FLAGS = [99, 147, 77, 141, 73, 133, 2147, 355, 1123]


def flags(spark):
    return spark.createDataFrame([(f"r{i}", f) for i, f in enumerate(FLAGS)], "qname string, flag int")


def test_flagstat(spark):
    row = reads.flagstat(flags(spark)).first().asDict()
    assert {k: row[k] for k in ("total", "mapped", "secondary", "supplementary", "duplicates", "paired", "read1", "read2", "properly_paired", "singletons")} == {
        "total": 9, "mapped": 6, "secondary": 1, "supplementary": 1, "duplicates": 1, "paired": 7, "read1": 4, "read2": 3, "properly_paired": 3, "singletons": 1}
    assert (row["mapped_pct"], row["properly_paired_pct"], row["singletons_pct"]) == (66.67, 42.86, 14.29)


def test_flag_filters(spark):
    f = flags(spark)
    assert [reads.proper_pairs(f).count(), reads.primary(f).count(), reads.mapped_primary(f).count(), reads.mapped(f).count()] == [5, 7, 5, 6]
    assert reads.flag_columns(f).where("is_proper and is_primary").count() == 3


def whitelist(spark):
    return spark.createDataFrame([(p, i, s) for p in "ABCD" for i, s in enumerate(["ACGTACGT", "ACGTATTC", "TGCAACGT"])], "position string, ord int, seq string")


def test_demultiplexing(spark):
    def read(d="ACGTACGT", o="ACTC", b="TGCAACGT", a="ACGTACGT"):
        return f"{d}AGGAACGTATTC{o}{b}AAGG{a}ATGATTACA"

    seqs = [read(), read(d="ACGTACGA"), read(a="ACGTACAA"), read(o="GGTC"), read(b="TGCANCGT")]
    df = spark.createDataFrame([(f"r{i + 1}", s, "I" * len(s)) for i, s in enumerate(seqs)], "name string, seq2 string, qual2 string")
    assert {r.radius for r in codes.correction_radius(whitelist(spark)).collect()} == {1}
    strict = {r.name: r for r in codes.correct(df, whitelist(spark)).collect()}
    assert [strict[f"r{i}"].ok for i in range(1, 6)] == [True, True, False, False, True]
    kept = [r for r in strict.values() if r.ok]
    assert {r.insert for r in kept} == {"GATTACA"} and len({r.barcode for r in kept}) == 1 and all(len(r.insert_qual) == 7 for r in kept)
    loose = codes.correct(df, whitelist(spark), ignore_overhangs=True)
    assert codes.demux_stats(loose).first() == (5, 4, 0.8)
    assert codes.rejects(loose).first().name == "r3"


def test_wells_and_conditions(spark):
    plate = spark.createDataFrame([(r, c, f"{r}{c:02d}") for c in range(1, 13) for r in "ABCDEFGH"], "row string, col int, seq string")
    specs = spark.createDataFrame([("Ctl", 0, "A"), ("Trt", 1000, "B1"), ("Trt", 1001, "3")], "condition string, ord int, spec string")
    wells = codes.expand_wells(specs, plate, "A")
    found = {r.seq: r.condition for r in codes.code_conditions(wells).collect()}
    assert len(found) == 11 and sum(c == "Ctl" for c in found.values()) == 2 and found["A03"] == "Trt"
    assert [r.seq for r in codes.conflicts(wells).collect()] == ["A03"]
    with pytest.raises(Exception, match="several conditions"):
        codes.code_conditions(wells, strict=True).collect()
    with pytest.raises(Exception, match="no such well"):
        codes.expand_wells(spark.createDataFrame([("X", 0, "A4")], "condition string, ord int, spec string"), plate, "A").collect()


def test_ordmag(spark):
    counts = spark.createDataFrame([(str(i), v) for i, v in enumerate([100, 90, 80, 5, 1])], "barcode string, read_count long")
    best = cells.ordmag(counts).first()
    assert (best.x, round(best.m, 6), best.o, best.loss) == (3, 99.8, 3, 0.0)
    assert cells.call_cells(counts).count() == 3
    assert [r.read_count for r in cells.top_cells(counts, 2).collect()] == [100, 90]


def test_species(spark):
    b = spark.createDataFrame([("a", 260, 10), ("b", 1, 10), ("c", 5, 5), ("d", 7, 0), ("e", 0, 0), ("f", 9, 9)], "barcode string, human_count long, mouse_count long")
    got = {r.barcode: r.species for r in cells.species_call(b, b.where("barcode <> 'f'")).collect()}
    assert got == {"a": "human", "b": "mouse", "c": "mixed", "d": "human", "e": None, "f": "empty droplet"}


def spans(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"{extra}chrom string, pos0 long, pos1 long")


def test_enrichment_and_features(spark):
    exons = spans(spark, [("chr1", 0, 10), ("chr1", 10, 20), ("chr1", 30, 40)])
    merged = sorted(tuple(r) for r in intervals.merge(exons).collect())
    assert merged == [("chr1", 0, 20), ("chr1", 30, 40)]
    r = spans(spark, [("c", "chr1", 5, 8), ("c", "chr1", 20, 30), ("c", "chr1", 25, 31), ("c", "chr1", 50, 60)], "cell string, ")
    row = intervals.exonic_enrichment(r, exons, 100).first()
    assert (row.total_reads, row.exonic_reads, round(row.enrichment, 9)) == (4, 2, 0.2)
    shares = intervals.feature_distribution(r, exons, spans(spark, [("chr1", 0, 40)])).first()
    assert (shares.exonic, shares.intronic, shares.intergenic) == (2, 2, 1)
    assert [tuple(x) for x in intervals.subtract(spans(spark, [("chr1", 0, 40)]), exons).collect()] == [("chr1", 20, 30)]


def test_overlap_join_meets_every_pair_once(spark):
    a = spans(spark, [("chr1", k * 7, k * 7 + 5 + k % 90) for k in range(200)])
    b = spans(spark, [("chr1", k * 13, k * 13 + 1 + k % 40) for k in range(100)])
    expected = sum(x.pos0 < y.pos1 and x.pos1 > y.pos0 for x in a.collect() for y in b.collect())
    assert intervals.overlap_join(a, b, 16).count() == expected
    touched = sum(any(x.pos0 < y.pos1 and x.pos1 > y.pos0 for y in b.collect()) for x in a.collect())
    assert intervals.overlapping(a, b, 16).count() == touched


def test_contig_order(spark):
    df = spark.createDataFrame([(c, 10) for c in ("chrM", "chr10", "chrX", "scaffold_b", "chr2", "chr1_alt")], "chrom string, length long")
    assert [r.chrom for r in intervals.genome_offsets(df, 5).orderBy("offset").collect()] == ["chr1_alt", "chr2", "chr10", "chrX", "chrM", "scaffold_b"]


def test_coverage_and_gini(spark):
    contigs = spark.createDataFrame([("chr1", 2500)], "chrom string, length long")
    r = spans(spark, [("c", "chr1", 100, 150), ("c", "chr1", 990, 1010), ("c", "chr1", 2400, 2450)], "cell string, ")
    bins = sorted((x.bin_start, x.bin_end, x.value) for x in coverage.binned(r, contigs).collect())
    assert bins == [(0, 1000, 2), (1000, 2000, 1), (2000, 2500, 1)]
    v = spark.createDataFrame([("c", x) for x in (0, 1, 1, 2)], "cell string, value long")
    assert coverage.gini(v).first().gini == pytest.approx(0.375)
    assert coverage.gini(v, drop_zeros=True).first().gini == pytest.approx(0.25)
    assert coverage.gini(v.withColumn("value", F.lit(0))).first().gini is None
    assert coverage.lorenz(v).count() == 100


def test_modalities(spark):
    df = spark.createDataFrame([(1, "50M", 60, "ACGT"), (2, "20M500N30M", 60, "ACGT"), (3, "5S40M5S", 60, "ACGT"), (4, "50M", 10, "A" + "T" * 10)], "id int, cigar string, mapq int, seq string")
    assert [r.modality for r in reads.modality(df).orderBy("id").collect()] == ["dna", "rna", "dna", "dna"]
    assert [r.modality for r in reads.modality(df, two_pass=True).orderBy("id").collect()] == ["dna", "dna", "dna", "rna"]
    assert [(o.length, o.op) for o in df.select(reads.cigar_operations().alias("o")).collect()[1].o] == [(20, "M"), (500, "N"), (30, "M")]


def test_subsample_nests(spark):
    df = spark.range(2000).select(F.concat(F.lit("r"), (F.col("id") / 2).cast("long").cast("string")).alias("qname"))
    small, large = {r.qname for r in reads.subsample(df, 0.2).collect()}, {r.qname for r in reads.subsample(df, 0.5).collect()}
    assert small < large and reads.subsample(df, 0.5).count() == 2 * len(large)


def test_insert_stats(spark):
    rows = [("c", 99, 99, 199, 101), ("c", 99, 99, 199, 101), ("c", 99, 99, 299, 101), ("c", 73, 0, 0, 0)]
    got = reads.insert_stats(spark.createDataFrame(rows, "cell string, flag int, pos0 long, mate_pos long, tlen long")).first()
    assert (got.read_count, got.unique_read_count, round(got.average_insert_length, 2), got.unmapped_read_count) == (3, 2, 233.33, 1)


def test_lineages(spark):
    sites = {"s1": "1 2 3 9", "s2": "1 2 4", "s3": "1 4 5", "t1": "1 2", "t2": "1 3", "u1": "1 2", "u2": "1 2 3", "u3": "1 3 4", "u4": "1 3 4 5"}
    rows = [(s, "chr1", int(p), "A", "C", True) for s, ps in sites.items() for p in ps.split()]
    f = spark.createDataFrame(rows, "sample string, chrom string, pos long, ref string, alt string, high_vaf boolean")
    lines = spark.createDataFrame([("s", ["s1", "s2", "s3"]), ("t", ["t1", "t2"]), ("u", ["u1", "u2", "u3", "u4"])], "lineage string, samples array<string>")
    got = lambda strict: {k: [r.cumulative for r in variants.lineage_accumulation(f, lines, strict).orderBy("split").collect() if r.lineage == k] for k in "stu"}
    assert got(False) == {"s": [1, 2, 4], "t": [1, 2, None], "u": [1, 2, 4, 6]}
    assert got(True)["s"] == [1, 2, 3]


def test_trinucleotides(spark):
    windows = spark.createDataFrame([("chr1", 0, "N" + "TCTAGATTAC" + "G")], "chrom string, bin long, bases string")
    sites = spark.createDataFrame([("chr1", 2, "C", "A"), ("chr1", 5, "G", "T")], "chrom string, pos long, ref string, alt string")
    assert [r.trinuc_type for r in variants.trinucleotide(sites, windows, 10).orderBy("pos").collect()] == ["TCT>TAT", "TCT>TAT"]
    assert len(set(variants.contexts())) == 96


def test_summary_of_no_chunks_is_zero(spark):
    row = logs.summarise(spark.createDataFrame([], readers.CHUNK)).first()
    assert (row.chunks, row.barcode_mapping_rate, row.r1_pct_with_adapters, row.pct_pairs_removed) == (0, 0.0, 0.0, 0.0)


def test_flagstat_text(spark):
    text = "9 + 0 in total (QC-passed)\n1 + 0 secondary\n1 + 0 supplementary\n1 + 0 duplicates\n6 + 0 mapped (66.67% : N/A)\n7 + 0 paired in sequencing\n3 + 0 properly paired (42.86% : N/A)\n1 + 0 singletons (14.29% : N/A)\n"
    row = spark.createDataFrame([(text,)], "t string").select(logs.flagstat(F.col("t")).alias("f")).select("f.*").first()
    assert (row.total, row.mapped, row.mapped_pct, row.properly_paired, row.singletons_pct) == (9, 6, 66.67, 3, 14.29)


def test_metric_width_mismatch(spark):
    s = spark.createDataFrame([("# x\nA\tB\n1\t2\n",), ("A\tB\n1\n",)], "t string").select(qc.strict_metrics(F.col("t")).alias("m")).select("m.*").collect()
    assert s[0].metrics == {"A": "1", "B": "2"} and s[0].error is None and s[1].metrics is None and s[1].error


def test_depth_labels_and_nearest_rows(spark):
    d = spark.createDataFrame([(5_000_000,), (1500,), (7,)], "d long").select(qc.depth_label(F.col("d")).alias("l")).select("l", qc.label_depth(F.col("l")).alias("d")).collect()
    assert [tuple(r) for r in d] == [("5M", 5_000_000), ("1K", 1000), ("7", 7)]
    curve = spark.createDataFrame([("a", x, i) for i, x in enumerate((0, 1_000_000, 2_000_000, 6_000_000))], "sample string, total_reads long, ord int")
    got = {r.depth: r.total_reads for r in qc.nearest_row(curve, spark.createDataFrame([(5_000_000,), (1_500_000,)], "depth long")).collect()}
    assert got == {5_000_000: 6_000_000, 1_500_000: 1_000_000}


def test_markers(spark):
    m = qc.explode_markers(spark.createDataFrame([("s", "c", "unc-1, Myo-3,,zzz-9")], "subtype string, celltype string, genes string"))
    g = spark.createDataFrame([("unc-1", "G1", 0), ("myo-3", "G2", 1)], "gene_name string, gene_id string, ord int")
    assert {r.gene: r.gene_id for r in qc.map_markers(m, g).collect()} == {"unc-1": "G1", "Myo-3": "G2", "zzz-9": None}


def test_funnel(spark):
    s = spark.createDataFrame([(400, 230, 15, 400, 380)], "input_pairs long, mapped_pairs long, pairs_removed long, mapped long, proper long")
    assert [(r.reads, r.lost) for r in qc.funnel(s).orderBy("step").collect()] == [(800, 340), (460, 30), (430, 30), (400, 20), (380, None)]
    assert qc.funnel(s.withColumns({"mapped": F.lit(None), "proper": F.lit(None)})).count() == 3


def test_adjusted_p_values(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p_value double")
    assert [round(r.q_value, 6) for r in qc.adjust_p_values(p).orderBy("p_value").collect()] == [0.04, 0.053333, 0.053333, 0.5]


def test_golden_statistics(spark):
    wt, mut = [0.9351, 0.9837, 0.9189, 0.8608, 0.9417, 1.0023], 0.7988
    rows = spark.createDataFrame([("wt", v) for v in wt], "g string, v double")
    r = stats.mean_interval(rows, "g", "v").first()
    assert (round(r["mean"], 4), round(r.sd, 4), round(r.sem, 4)) == (0.9404, 0.0501, 0.0204)
    assert round(r.ci_low, 4) == round(r["mean"] - 2.570582 * r.sem, 4)
    assert round(r["mean"] * 21, 1) == 19.7 and round(mut * 21, 1) == 16.8
    assert stats.t_cdf(2.0, 5) == pytest.approx(0.9490302605850709, abs=1e-10)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)


def test_mixed_model_without_group_effect(spark):
    rows = [(float(2 + 3 * x + (0.1 if (x + g) % 2 else -0.1)), g, float(x)) for g in range(6) for x in range(8)]
    got = {r.term: r.estimate for r in stats.mixed_model(spark.createDataFrame(rows, "y double, g int, x double"), "y", "g", ["x"]).collect()}
    assert got["x"] == pytest.approx(3, abs=0.01) and got["intercept"] == pytest.approx(2, abs=0.1)


@pytest.mark.parametrize("slope", [None, "x"])
def test_mixed_model_equals_dense_matrices(spark, slope):
    r = np.random.default_rng(3)
    g = r.integers(0, 7, 100)
    x = r.normal(size=100) + 3
    target = 2 + 3 * x + r.normal(size=7)[g] * 2 + (r.normal(size=7)[g] * x if slope else 0) + r.normal(size=100)
    got = {row.term: row for row in stats.mixed_model(spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(target, g, x, strict=True)], "y double, g int, x double"), "y", "g", ["x"], slope).collect()}
    a, z = np.column_stack([np.ones(100), x]), np.column_stack([np.ones(100)] + ([x] if slope else []))

    def dense(theta):
        low = np.zeros((z.shape[1], z.shape[1]))
        low[np.tril_indices(len(low))] = theta
        v = np.eye(100) + np.where(g[:, None] == g, z @ low @ low.T @ z.T, 0)
        xvx, xvy = a.T @ np.linalg.solve(v, a), a.T @ np.linalg.solve(v, target)
        beta = np.linalg.solve(xvx, xvy)
        rss = target @ np.linalg.solve(v, target) - beta @ xvy
        return 98 * np.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1], beta, np.sqrt(np.diag(np.linalg.inv(xvx)) * rss / 98)

    best, step = np.ones(3 if slope else 1), 0.5
    while step > 1e-4:
        trials = [best + d * np.eye(len(best))[k] for k in range(len(best)) for d in (step, -step)]
        least = min(trials, key=lambda t: dense(t)[0])
        best, step = (least, step) if dense(least)[0] < dense(best)[0] - 1e-9 else (best, step / 2)
    _, beta, errors = dense(best)
    assert [got[t].estimate for t in ("intercept", "x")] == pytest.approx(list(beta), rel=1e-3) and [got[t].std_error for t in ("intercept", "x")] == pytest.approx(list(errors), rel=1e-2)


def test_mixed_model_query_takes_all_orders(spark, tmp_path):
    rows = [(c, 1000.0 * (c % 12 + 10 * (c > 60) + k), date(1992 + k, 1, 1 + c % 7)) for c in range(1, 121) for k in range(5)]
    orders = spark.createDataFrame(rows, "o_custkey long, o_totalprice double, o_orderdate date")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.term: r.estimate for r in QUERIES["q58_mixed_model"](spark, str(tmp_path)).collect()}
    assert got["intercept"] + got["genotype"] / 2 == pytest.approx(5.5 + 5, abs=0.1)


def test_signature_weights(spark):
    sig = spark.createDataFrame([("a", "x", 0.7), ("a", "y", 0.3), ("b", "x", 0.1), ("b", "y", 0.9)], "signature string, context string, share double")
    spec = spark.createDataFrame([("s", "x", 70 + 5), ("s", "y", 30 + 45)], "sample string, context string, n long")
    assert {r.signature: round(r.weight, 6) for r in stats.signature_weights(spec, sig).collect()} == {"a": 100.0, "b": 50.0}


def test_fastq_and_sam_round_trip(spark, tmp_path):
    for k, seq in ((1, "ACGT"), (2, "TTGA")):
        with gzip.open(tmp_path / f"r{k}.fastq.gz", "wt") as f:
            f.write(f"@a 1:N:0:ACGT\n{seq}\n+\nIIII\n@b\n{seq}\n+\nJJJJ\n@cut\nAC\n")
    binary.register(spark)
    got = spark.read.format("fastq_pairs").option("r1", str(tmp_path / "r1.fastq.gz")).option("r2", str(tmp_path / "r2.fastq.gz")).load().collect()
    assert [tuple(r) for r in got] == [("a", "1:N:0:ACGT", "ACGT", "IIII", "TTGA", "IIII"), ("b", "", "ACGT", "JJJJ", "TTGA", "JJJJ")]
    pairs = spark.createDataFrame(got).withColumns({"barcode": F.lit("CODE"), "insert": F.lit("GA"), "insert_qual": F.lit("II")})
    assert writers.fastq_lines(pairs, 2).first().value == "@a BC:Z:ACGT CB:Z:CODE\nGA\n+\nII"
    writers.write_text(writers.unaligned_sam(pairs), str(tmp_path / "sam"))
    back = readers.sam(spark, str(tmp_path / "sam"))
    assert sorted((r.qname, r.flag, r.cb) for r in back.collect()) == [("a", 77, "CODE"), ("a", 141, "CODE"), ("b", 77, "CODE"), ("b", 141, "CODE")]


def test_bam(spark, tmp_path):
    def record(name, flag, ref, pos, cigar, seq, tags):
        ops = b"".join(struct.pack("<I", n << 4 | binary.OPERATIONS.index(o)) for n, o in cigar)
        codes_ = [binary.SEQUENCE.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes_[::2], codes_[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + bytes([30] * len(seq)) + tags
        return struct.pack("<i", len(body)) + body

    header = b"@HD\n"
    data = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data += record("r1", 0, 0, 9, [(3, "M"), (2, "S")], "ACGTN", b"NMC\1CBZAAA\0") + record("r2", 4, -1, -1, [], "AC", b"")

    def blocked(raw, size):
        out = b""
        for k in range(0, len(raw), size):
            body = zlib.compressobj(wbits=-15)
            packed = body.compress(raw[k : k + size]) + body.flush()
            out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC\x02\x00" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(raw[k : k + size]), len(raw[k : k + size]))
        return out

    (tmp_path / "x.bam").write_bytes(blocked(data, 60))
    binary.register(spark)
    one, two = spark.read.format("bam").option("path", str(tmp_path / "x.bam")).load().collect()
    assert (one.qname, one.chrom, one.pos, one.cigar, one.seq, one.qual, one.cb) == ("r1", "chr1", 10, "3M2S", "ACGTN", "?????", "AAA")
    assert (two.chrom, two.cigar, two.cb, two.flag) == ("*", "*", None, 4)
    many = data + b"".join(record(f"read{k}", 0, 0, k, [(20 + k % 50, "M")], "ACGT" * 20, b"CBZCELL%d\0" % (k % 7)) for k in range(3000))
    (tmp_path / "y.bam").write_bytes(blocked(many, 997))
    for split in (1 << 27, 20_000, 3_001, 700):
        names = [r.qname for r in spark.read.format("bam").option("path", str(tmp_path / "y.bam")).option("split", str(split)).load().select("qname").collect()]
        assert sorted(names) == sorted(["r1", "r2", *(f"read{k}" for k in range(3000))]), split


def test_vcf_and_gtf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t5\t.\tA\tC,G\t.\t.\t.\tGT:DP:AD\t0/1:10:5,3,2\t./.:.:.\nchr1\t6\t.\tA\t.\t.\t.\t.\tDP:AD\t3:3\t4:4\n")
    calls = readers.vcf(spark, str(tmp_path / "a.vcf"))
    got = sorted((r.sample, r.alt, r.dp, r.ad, r.multiallelic) for r in variants.split_alleles(calls).where("dp is not null").collect())
    assert got == [("s1", "C", 10, 3, True), ("s1", "G", 10, 2, True)]
    (tmp_path / "a.gtf").write_text('#c\nchr1\tx\texon\t1\t10\t.\t+\t.\tgene_id "G1"; gene_name "abc";\nshort\n')
    assert tuple(readers.gtf(spark, str(tmp_path / "a.gtf")).first()) == ("chr1", "exon", 0, 10, "+", "G1", "abc")
    (tmp_path / "a.interval_list").write_text("@HD\nchr1\t1\t10\t+\tx\n")
    assert tuple(readers.interval_list(spark, str(tmp_path / "a.interval_list")).first()) == ("chr1", 0, 10)


def test_plate_conditions_and_settings(spark, tmp_path):
    (tmp_path / "map.csv").write_text("," + ",".join(map(str, range(1, 13))) + "\n" + "\n".join(f"{r}," + ",".join(f"{r}{c}" for c in range(1, 13)) for r in "ABCDEFGH") + "\n")
    assert readers.plate_map(spark, str(tmp_path / "map.csv")).count() == 96
    (tmp_path / "c.json").write_text('{"Ctl": ["A"],\n "Trt": ["B1", 3]}')
    assert [(r.condition, r.spec) for r in readers.conditions(spark, str(tmp_path / "c.json")).orderBy("ord").collect()] == [("Ctl", "A"), ("Trt", "B1"), ("Trt", "3")]
    (tmp_path / "w.txt").write_text("acgt\n\n TTTT \n")
    assert [(r.ord, r.seq) for r in readers.whitelist(spark, {"A": str(tmp_path / "w.txt")}).collect()] == [(0, "ACGT"), (1, "TTTT")]
    assert readers.settings({"a": "1", "p_q": "0"}, "p:\n  q: 2 # note\n  r: '3'\n", {"a": None, "z": 9}) == {"a": "1", "p_q": "2", "p_r": "3", "z": 9}


ALIGNED = "cell string, qname string, flag int, chrom string, pos0 long, cigar string, score long, mapq int, seq string, mate_chrom string, pos1 long"


def alignment(qname, flag, pos0, cigar="50M", score=10, cell="c", chrom="chr1", mate="="):
    return cell, qname, flag, chrom, pos0, cigar, score, 30, "A" * 50, mate, pos0 + 50


def test_unclipped_ends(spark):
    rows = [("5S45M", 0, 100), ("5S45M", 16, 100), ("2H3S40M4S1H", 0, 100), ("2H3S40M4S1H", 16, 100), ("10M30N40M", 16, 0), ("50M", 16, 7)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, cigar string, flag int, pos0 long")
    assert [r.e for r in df.select("k", reads.five_prime().alias("e")).orderBy("k").collect()] == [95, 144, 95, 144, 79, 56]


def test_duplicates(spark):
    rows = [
        alignment("a", 99, 100, score=5), alignment("a", 147, 200, score=5), alignment("b", 99, 100, score=9), alignment("b", 147, 200, score=9),
        alignment("c", 99, 105, "5S45M", 1), alignment("c", 147, 200, score=1),  # equal ends once clipped bases count
        alignment("d", 73, 100), alignment("d", 133, 100),  # its only end is that of a pair
        alignment("e", 73, 400, score=3), alignment("f", 73, 400, score=4), alignment("g", 77, 0), alignment("h", 77, 0), alignment("b", 355, 100), alignment("b", 2147, 100),
        alignment("z", 99, 100, cell="other"), alignment("z", 147, 200, cell="other"),
    ]
    df = spark.createDataFrame(rows, ALIGNED)
    assert {(r.qname, r.flag) for r in reads.mark_duplicates(df).collect() if r.is_duplicate} == {("a", 99), ("a", 147), ("c", 99), ("c", 147), ("d", 73), ("e", 73)}
    m = {r.cell: r for r in reads.duplicate_metrics(df).collect()}["c"]
    assert (m.unpaired_reads_examined, m.read_pairs_examined, m.unpaired_read_duplicates, m.read_pair_duplicates, m.unmapped_reads, m.secondary_or_supplementary_reads) == (3, 3, 2, 2, 3, 2)
    assert m.pct_duplicates == pytest.approx(6 / 9) and m.estimated_library_size == 1
    x = spark.range(1).select(reads.library_size(F.lit(1000), F.lit(900)).alias("x")).first().x
    assert 900 / x == pytest.approx(1 - np.exp(-1000 / x), rel=1e-3)


def test_alignment_metrics(spark):
    df = spark.createDataFrame([alignment("a", 99, 1), alignment("a", 147, 9), alignment("b", 73, 1), alignment("b", 133, 1), alignment("c", 611, 5), alignment("c", 355, 5), alignment("d", 0, 5)], ALIGNED)
    got = {r.category: r for r in reads.alignment_metrics(df).collect()}
    assert (got["pair"].total_reads, got["pair"].pf_reads, got["pair"].pf_reads_aligned, got["pair"].reads_aligned_in_pairs, got["unpaired"].total_reads) == (5, 4, 3, 2, 1)
    assert got["first_of_pair"].strand_balance == 1.0 and got["second_of_pair"].strand_balance == 0.0


def test_gene_counts_take_fragments(spark):
    exons = spark.createDataFrame([("chr1", 0, 100, "g"), ("chr1", 300, 500, "g"), ("chr1", 450, 600, "h")], "chrom string, pos0 long, pos1 long, gene string")
    rows = [
        alignment("a", 99, 10), alignment("a", 147, 80),  # 70 of 100 bases
        alignment("b", 99, 90), alignment("b", 147, 140),  # 10 of 100
        alignment("c", 73, 10), alignment("d", 99, 10, mate="chr2"), alignment("e", 355, 10), alignment("f", 0, 10), alignment("x", 99, 450), alignment("x", 147, 450),
    ]
    got = {(r.gene, r.n) for r in intervals.gene_counts(spark.createDataFrame(rows, ALIGNED), exons).collect()}
    assert got == {("g", 2)}


def test_sparse_bins_equal_listed_zeros(spark):
    v = spark.createDataFrame([("c", x) for x in (0, 0, 0, 0, 1, 1, 5)] + [("d", 3), ("d", 1)] + [("d", 0)] * 5, "cell string, value long")
    listed = v.where("value > 0")
    assert {r.cell: round(r.gini, 12) for r in coverage.gini(v).collect()} == {r.cell: round(r.gini, 12) for r in coverage.gini(listed, n=7).collect()}
    curve = lambda df: sorted((r.cell, round(r.cumulative_fraction_genome, 9), round(r.cumulative_fraction_reads, 9)) for r in df.collect())
    assert curve(coverage.lorenz(v)) == curve(coverage.lorenz(listed, n=7))


def test_depth_counts_bases_of_mates_once(spark):
    df = spark.createDataFrame([alignment("a", 99, 0), alignment("a", 147, 20), alignment("b", 1123, 0), alignment("c", 355, 0)], ALIGNED)
    assert [(r.pos0, r.pos1) for r in coverage.countable(df).collect()] == [(0, 70)]


def test_reference_windows(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1 first\nACGTa\nCCCCC\nGG\n>chr2\nTTTTT\n")
    got = {(r.chrom, r.bin): r.bases for r in readers.fasta_windows(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {("chr1", 0): "NACGTAC", ("chr1", 1): "ACCCCCG", ("chr1", 2): "CGGN", ("chr2", 0): "NTTTTTN"}
    sites = spark.createDataFrame([("chr1", 6, "C", "T"), ("chr1", 11, "G", "T")], "chrom string, pos long, ref string, alt string")
    typed = variants.trinucleotide(sites, readers.fasta_windows(spark, str(tmp_path / "x.fa")), readers.fasta_width(spark, str(tmp_path / "x.fa")))
    assert {r.pos: r.trinuc_type for r in typed.collect()} == {6: "ACC>ATC", 11: "CCG>CAG"}


def test_variant_files_of_different_samples(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(head + "s1\nchr1\t5\t.\tA\tC\t.\t.\t.\tDP:AD\t9:4,5\n")
    (tmp_path / "b.vcf").write_text(head + "s2\ts3\nchr1\t5\t.\tA\tG\t.\t.\t.\tDP:AD\t7:0,7\t3:3,0\n")
    calls = readers.vcf(spark, str(tmp_path))
    assert sorted((r.sample, r.alt, r.dp) for r in calls.collect()) == [("s1", "C", 9), ("s2", "G", 7), ("s3", "G", 3)]
    flat = variants.split_alleles(calls)
    assert sorted((r.sample, r.alt, r.gt, r.ad) for r in variants.combine_genotypes(flat).collect()) == [("s1", "C,G", "0/1", [5, 0]), ("s2", "C,G", "2/2", [0, 7]), ("s3", "C,G", "0/0", [0, 0])]
    shards = spark.createDataFrame([("chr1", 0, 5, 3), ("chr1", 5, 9, 4)], "chrom string, pos0 long, pos1 long, shard int")
    variants.save_shards(flat, shards, str(tmp_path / "store"))
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "store")).collect()} == {3}


def test_names_from_paths(spark, tmp_path):
    for name in ("s_S1_L001_R1_001.fastq.gz", "s_S1_L001_R2_001.fastq.gz", "s_S1_L002_R1_001.fastq.gz", "t_S2_L001_R1_001.fastq.gz", "x.g.vcf.gz", "x.norm.vcf.gz", "y.norm.vcf.gz"):
        (tmp_path / name).touch()
    sheet = {r["sample"]: r for r in readers.sample_sheet(spark, str(tmp_path)).collect()}
    assert sheet["s"].r1.endswith("L001_R1_001.fastq.gz") and sheet["s"].r2.endswith("L001_R2_001.fastq.gz") and sheet["t"].r2 is None
    assert readers.preferred(spark, str(tmp_path), "x").endswith("x.g.vcf.gz") and readers.preferred(spark, str(tmp_path), "y").endswith("y.norm.vcf.gz") and readers.preferred(spark, str(tmp_path), "z") is None
    files = spark.createDataFrame([("/d/run1/c1.bam",), ("/d/run2/sc_outputs/c2.markdup.bam",)], "path string")
    assert [(r.dataset, r.cell_id) for r in readers.path_names(files).orderBy("path").collect()] == [("run1", "c1"), ("run2", "c2")]
    assert readers.raw_csv(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "a.csv").write_text("x,y\n1,02\n")
    assert tuple(readers.raw_csv(spark, str(tmp_path / "a.csv")).first()) == ("1", "02")
    c = spark.createDataFrame([("NC_1",), ("chr1_hg38",), ("q",)], "chrom string")
    assert sorted(r.chrom for r in intervals.rename_contigs(c.where("chrom <> 'chr1_hg38'"), {"NC_1": "I"}).collect()) == ["I", "q"]
    assert intervals.rename_contigs(c.where("chrom = 'chr1_hg38'"), strip="_").first().chrom == "chr1"


def test_rescue(spark):
    ks = [(float(k), lam) for k in (0, 1, 3, 20, 200) for lam in (0.0, 0.3, 4.0, 150.0)]
    df = spark.createDataFrame(ks, "k double, lam double").select("k", "lam", qc.poisson_tail(F.col("k"), F.col("lam")).alias("p"))
    for r in df.collect():
        below = sum(np.exp(i * np.log(r.lam) - r.lam - math.lgamma(i + 1)) for i in range(int(r.k))) if r.lam else 1.0 * (r.k > 0)
        assert r.p == pytest.approx(1 - below, abs=1e-9)
    genes = spark.createDataFrame([("c", "g", 40, 1000), ("c", "h", 2, 1000), ("e", "g", 5, 10)], "cell string, gene string, reads long, bp long")
    shares = qc.rescue_rna(genes, spark.createDataFrame([("c", 20, 10_000)], "cell string, reads long, bp long"))
    got = {(r.cell, r.gene): r.rna_share for r in shares.collect()}
    assert got["c", "g"] == pytest.approx((40 - 2 + 3) / 45) and got["c", "h"] == 0.0 and got["e", "g"] == pytest.approx(0.8)
    r = qc.reassign(spark.range(4000).selectExpr("'c' AS cell", "concat('r', id) AS qname", "if(id % 2 = 0, 'g', 'h') AS gene"), shares).groupBy("modality").count().collect()
    assert {x.modality: x["count"] for x in r}["rna"] == pytest.approx(2000 * 41 / 45, rel=0.03)


def test_dashboard(spark, tmp_path):
    cards = spark.createDataFrame([(0, "cells", 12.0), (1, "pct_<b>", None)], "ord int, card string, value double")
    knee = spark.range(1, 50_001).selectExpr("id AS rank", "100000 - id AS read_count", "'Ctl' AS condition")
    scatter = spark.createDataFrame([("a", "Ctl", 1.5, 0.4), ("b", "Trt", 0.5, 0.2)], "barcode string, condition string, mean_coverage double, pct_1x double")
    text = dashboard.page("run", cards, knee=knee, histograms={"reads": spark.createDataFrame([(0, 3), (1, 4)], "bin long, n long")}, scatter=scatter)
    assert text.count("<figure>") == 3 and "pct_&lt;b&gt;" in text and "N/A" in text and dashboard.thinned(knee, "rank").count() < 2500
    dashboard.write(spark, text, str(tmp_path / "page.html"))
    assert (tmp_path / "page.html").read_text() == text
