"""Queries that write tables in the domain's file formats and read them back; files lie in the shared folder for checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators import cells, codes, coverage, intervals, logs, reads
from strandlake.operators.rounds import shared_folder
from strandlake.sources import bam_sink, bigwig, compressed, readers, writers

from .base import ALIGNMENTS_SQL, CALLS_SQL, alignments, calls, query, table
from .reads_queries import BARCODED_LISTED, demuxed_sql, whitelist


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_SPAN = "CASE cigar WHEN '20M500N30M' THEN 550 WHEN '5S40M5S' THEN 40 WHEN '50M' THEN 50 ELSE 46 END"
CONTIGS = [(f"chr{k}", 200_000) for k in range(1, 23)]


@query("q73_bam_region", f"""WITH {ALIGNMENTS_SQL} SELECT qname, flag, chrom, pos0 + 1 AS pos, cast(mapq AS int) AS mapq, cigar, seq, concat('g', length(qname) % 5) AS cb, tlen
FROM alignments WHERE chrom = 'chr7' AND pos0 < 60000 AND pos0 + {_SPAN} > 20000""")  # fmt: skip
def q73(spark: SparkSession, d: str) -> DataFrame:
    """Alignments written as indexed BAM parts for each of five groups; a region read by the indexes."""
    a = alignments(spark, d).selectExpr(
        "qname", "flag", "chrom", "cast(pos0 + 1 AS bigint) AS pos", "cast(mapq AS int) AS mapq", "cigar", "mate_chrom", "cast(mate_pos AS bigint) AS mate_pos", "tlen", "seq",
        "cast(null AS string) AS qual", "concat('g', length(qname) % 5) AS cb", "cast(null AS string) AS bc", "cast(null AS string) AS rg",
    )
    parts = bam_sink.write_bam(a, CONTIGS, place(spark, "bam"))
    return bam_sink.read_region(spark, parts, "chr7", 20_000, 60_000).select("qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "cb", "tlen")


@query("q74_bigwig_region", f"""WITH {ALIGNMENTS_SQL}, b AS (SELECT concat('g', length(qname) % 3) AS g, chrom, unnest(range(pos0 // 1000, (pos1 - 1) // 1000 + 1)) AS bin FROM alignments)
SELECT g, chrom, bin * 1000 AS pos0, bin * 1000 + 1000 AS pos1, count(*)::DOUBLE AS value FROM b WHERE chrom = 'chr5' AND bin >= 20 AND bin < 75 GROUP BY ALL""")  # fmt: skip
def q74(spark: SparkSession, d: str) -> DataFrame:
    """Binned coverage written as a bigWig file for each of three groups; a region read by the files' indexes."""
    bigwig.register(spark)
    a = alignments(spark, d).withColumn("g", F.concat(F.lit("g"), F.length("qname") % 3))
    track = coverage.bin_counts(a, 1000, "g").select("g", "chrom", F.col("bin_start").alias("pos0"), (F.col("bin_start") + 1000).alias("pos1"), "value")
    parts = bigwig.write_bigwig(track, CONTIGS, place(spark, "bigwig"), "g").select("path").collect()
    rows = spark.read.format("bigwig").option("path", ",".join(p.path for p in parts)).option("chrom", "chr5").option("start", 20_000).option("end", 75_000).load()
    return rows.select(F.regexp_extract("path", r"([^/]+)\.bw$", 1).alias("g"), "chrom", "pos0", "pos1", "value")


@query("q75_sam_scan", f"""WITH {ALIGNMENTS_SQL} SELECT qname, flag, chrom, pos0, cast(mapq AS int) AS mapq, cigar, mate_chrom, tlen, seq, cell AS cb, CASE WHEN flag % 2 = 0 THEN 'rg1' END AS rg FROM alignments""")
def q75(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "sam")
    columns = ["qname", "flag", "chrom", "pos0 + 1", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "'*'", "concat('CB:Z:', cell)", "CASE WHEN flag % 2 = 0 THEN 'RG:Z:rg1' END"]
    writers.write_text(alignments(spark, d).selectExpr(f"concat_ws('\t', {', '.join(columns)}) AS value"), path, "gzip")
    return readers.sam(spark, path).select("qname", "flag", "chrom", "pos0", "mapq", "cigar", "mate_chrom", "tlen", "seq", "cb", "rg")


def corrected_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("concat('read', l_orderkey, '_', l_linenumber, '_', l_partkey) AS name", "concat('1:N:0:', CASE WHEN l_linenumber % 2 = 0 THEN 'ACGT' ELSE '' END) AS comment", "'GATTACAGAT' AS seq1", "'IIIII@+III' AS qual1", f"{BARCODED_LISTED} AS seq2")
    return codes.correct(rows.withColumn("qual2", F.repeat(F.lit("@"), F.length("seq2"))), whitelist(spark)).where("ok")


_PAIRS = f"{demuxed_sql(False)}, good AS (SELECT concat('read', l_orderkey, '_', l_linenumber, '_', l_partkey) AS name, CASE WHEN l_linenumber % 2 = 0 THEN concat('BC:Z:ACGT CB:Z:', barcode) ELSE concat('CB:Z:', barcode) END AS comment, barcode, insert FROM demuxed WHERE ok)"


@query("q76_fastq_pairs", f"{_PAIRS} SELECT name, comment, barcode AS cb, 'GATTACAGAT' AS seq1, 'IIIII@+III' AS qual1, insert AS seq2, repeat('@', length(insert)) AS qual2 FROM good")
def q76(spark: SparkSession, d: str) -> DataFrame:
    """Corrected pairs written as plain FASTQ parts and read back in pieces of 64 KiB, mates paired by record numbers."""
    pairs, paths = corrected_pairs(spark, d).persist(), []
    for mate in (1, 2):
        path = place(spark, f"fastq{mate}")
        writers.write_text(writers.fastq_lines(pairs, mate), path)
        paths.append(readers.listed(spark, f"{path}/part-*"))
    found = compressed.fastq_pairs(spark, list(zip(*paths, strict=True)), 1 << 16, 64)
    return found.withColumn("cb", readers.tag_from_comment(F.col("comment")))


@query("q77_unaligned_sam", f"{_PAIRS} SELECT name AS qname, 77 AS flag, 'GATTACAGAT' AS seq, 'IIIII@+III' AS qual, barcode AS cb FROM good UNION ALL SELECT name, 141, insert, repeat('@', length(insert)), barcode FROM good")
def q77(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "unaligned")
    writers.write_text(writers.unaligned_sam(corrected_pairs(spark, d)), path)
    return readers.sam(spark, path).select("qname", "flag", "seq", "qual", "cb")


@query("q78_gene_extents", "SELECT concat('chr', 1 + p_size % 5) AS chrom, p_brand AS gene_id, min(p_partkey * 10) AS pos0, max(p_partkey * 10 + p_size) AS pos1 FROM part GROUP BY 1, 2")
def q78(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of a GTF file; a gene reaches from its first to its last one."""
    path = place(spark, "gtf")
    lines = ["concat('chr', 1 + p_size % 5)", "'src'", "explode(array('transcript', 'exon'))", "p_partkey * 10 + 1", "p_partkey * 10 + p_size", "'.'", "'+'", "'.'", "concat('gene_id \"', p_brand, '\"; gene_name \"', p_name, '\";')"]
    rows = table(spark, d, "part").selectExpr(f"{lines[2]} AS feature", "*").selectExpr(f"concat_ws('\t', {', '.join([*lines[:2], 'feature', *lines[3:]])}) AS value")
    writers.write_text(rows.unionByName(spark.createDataFrame([("#!genome",), ("short\tline",)], "value string")), path)
    return intervals.genes_from_transcripts(readers.gtf(spark, path).where("feature = 'transcript'"))


@query("q79_contigs_and_intervals", "SELECT concat('c', s_suppkey) AS chrom, s_suppkey * 10 AS pos0, s_suppkey * 10 + 5 AS pos1, s_suppkey * 100 AS length FROM supplier")
def q79(spark: SparkSession, d: str) -> DataFrame:
    """A contig list, an interval list with a header and a CSV of 1-based starts, joined."""
    rows, path = table(spark, d, "supplier").selectExpr("concat('c', s_suppkey) AS chrom", "s_suppkey AS k"), place(spark, "lists")
    writers.write_text(rows.selectExpr("concat_ws('\t', chrom, k * 100, 7, 60, 61) AS value"), f"{path}/fai")
    writers.write_text(rows.selectExpr("concat_ws('\t', chrom, k * 10 + 1, k * 10 + 5, '+', '.') AS value").unionByName(spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:c1\tLN:5",)], "value string")), f"{path}/intervals")
    writers.write_csv(rows.selectExpr("chrom", "k * 10 + 1 AS start"), f"{path}/csv")
    starts = intervals.from_one_based(readers.raw_csv(spark, f"{path}/csv").withColumn("start", F.col("start").cast("long")))
    joined = readers.interval_list(spark, f"{path}/intervals").join(readers.contigs(spark, f"{path}/fai"), "chrom").join(starts, "chrom")
    return joined.where("start = pos0").select("chrom", "pos0", "pos1", "length")


@query("q80_vcf_scan", f"WITH {CALLS_SQL} SELECT sample, chrom, pos, ref, alt, dp, CASE WHEN ad > 0 THEN ad END AS alt_ad FROM calls WHERE dp % 7 > 0")
def q80(spark: SparkSession, d: str) -> DataFrame:
    """One VCF folder for each sample, each file with its own header line."""
    path = place(spark, "vcf")
    c = calls(spark, d).where("dp % 7 > 0")
    fixed = "concat_ws('\t', chrom, pos, '.', ref, alt, '.', 'PASS', '.', 'GT:DP:AD', concat('0/1:', dp, ':', CASE WHEN ad > 0 THEN concat(dp - ad, ',', ad) ELSE '.' END))"
    head = c.select("sample").distinct().selectExpr("sample AS folder", "concat_ws('\t', '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', sample) AS value")
    rows = c.selectExpr("sample AS folder", f"{fixed} AS value").unionByName(head)
    rows.repartition("folder").write.partitionBy("folder").text(path)
    return readers.vcf(spark, f"{path}/folder=*").select("sample", "chrom", "pos", "ref", "alt", "dp", F.try_element_at("ad", F.lit(2)).alias("alt_ad"))


@query("q81_count_csv", f"WITH {ALIGNMENTS_SQL}, c AS (SELECT cell AS barcode, count(*) AS read_count FROM alignments GROUP BY cell) SELECT sum(read_count)::BIGINT AS assigned_reads, round(100.0::DOUBLE * sum(read_count) / (2 * 100000), 2) AS assignment_rate FROM c")
def q81(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "counts")
    writers.write_csv(reads.read_counts(alignments(spark, d)), path)
    return reads.assignment_rate(readers.counts(spark, path, strict=True), 100_000)


@query("q82_wide_matrix", f"WITH {ALIGNMENTS_SQL}, c AS (SELECT chrom, concat('b', length(qname) % 4) AS cell, count(*) AS n FROM alignments GROUP BY ALL) SELECT chrom AS gene_id, cell, coalesce(n, 0) AS n FROM (SELECT DISTINCT chrom FROM c) CROSS JOIN (SELECT DISTINCT cell FROM c) LEFT JOIN c USING (chrom, cell)")
def q82(spark: SparkSession, d: str) -> DataFrame:
    """Counts as a wide table with five more columns in front, written with tabs and read as a gene count table."""
    path = place(spark, "matrix")
    wide = writers.matrix(alignments(spark, d).groupBy("chrom", F.concat(F.lit("b"), F.length("qname") % 4).alias("cell")).agg(F.count("*").alias("n")), "chrom", "cell", "n", missing=0)
    named = wide.select(F.col("chrom").alias("Geneid"), *[F.lit(".").alias(c) for c in ("Chr", "Start", "End", "Strand", "Length")], *[c for c in wide.columns if c != "chrom"])
    writers.write_csv(named, path, "\t", single=True)
    return readers.feature_counts(spark, path)


@query("q83_tsv_of_rates", "SELECT n_name AS name, round(n_nationkey / 7 + 0.001, 2) AS rate, n_nationkey AS k FROM nation")
def q83(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "tsv")
    writers.write_tsv(table(spark, d, "nation").selectExpr("n_name AS name", "n_nationkey / 7 + 0.001D AS rate", "cast(n_nationkey AS bigint) AS k"), path)
    return readers.delimited(spark, path, "name string, rate double, k long")


@query("q84_lists_and_plates", "SELECT position, n_nationkey AS ord, concat('N', n_nationkey) AS seq, substr('ABCDE', 1 + n_nationkey % 5, 1) AS row, 1 + n_nationkey // 5 AS col FROM nation, (SELECT unnest(['A', 'B']) AS position)")
def q84(spark: SparkSession, d: str) -> DataFrame:
    """Code lists whose order counts, and a wide plate map, joined by code."""
    path, n = place(spark, "plates"), table(spark, d, "nation")
    ordered = n.orderBy("n_nationkey").select(F.concat(F.lit(" n"), "n_nationkey").alias("value")).coalesce(1)
    for p in "AB":
        writers.write_text(ordered, f"{path}/{p}")
    cells_ = n.selectExpr("substr('ABCDE', 1 + n_nationkey % 5, 1) AS row", "cast(1 + floor(n_nationkey / 5) AS string) AS col", "concat('N', n_nationkey) AS seq")
    writers.write_csv(writers.matrix(cells_, "row", "col", "seq").withColumnRenamed("row", "_"), f"{path}/map", single=True)
    listed = readers.whitelist(spark, {p: f"{path}/{p}" for p in "AB"})
    return listed.join(readers.plate_map(spark, f"{path}/map"), "seq").select("position", F.col("ord").cast("long").alias("ord"), "seq", "row", F.col("col").cast("long").alias("col"))


@query("q85_names_and_labels", "SELECT 's' || s_suppkey AS barcode, CASE WHEN s_suppkey % 3 = 0 THEN 'MDA' WHEN s_suppkey % 3 = 1 THEN 'PTA' END AS method, s_suppkey % 16 AS shown FROM supplier")
def q85(spark: SparkSession, d: str) -> DataFrame:
    """A list file of barcodes; their last code says how a cell was amplified."""
    path = place(spark, "names")
    codes_ = "concat('s', s_suppkey, repeat('A', 36), substr('CGT', cast(1 + s_suppkey % 3 AS int), 1), 'AAAAAAA', 'A')"
    writers.write_text(table(spark, d, "supplier").selectExpr(f"concat(' ', right({codes_}, 45), ' ') AS value", "s_suppkey").select("value"), path)
    held = readers.names(spark, path)
    methods = spark.createDataFrame([("CAAAAAAA", "MDA"), ("GAAAAAAA", "PTA")], "seq string, method string")
    own = table(spark, d, "supplier").selectExpr("s_suppkey", f"right({codes_}, 45) AS barcode")
    found = cells.amplification_label(held.distinct(), methods).select("barcode", "method")
    return own.join(found, "barcode").select(F.concat(F.lit("s"), "s_suppkey").alias("barcode"), "method", (F.col("s_suppkey") % 16).alias("shown"))


@query("q86_split_and_sorted", f"WITH {ALIGNMENTS_SQL} SELECT chrom, count(*) AS n, min(pos0) AS first, max(pos0) AS last, 0 AS disorder FROM alignments GROUP BY chrom")
def q86(spark: SparkSession, d: str) -> DataFrame:
    """Records split by contig into folders, sorted by place; disorder counts records that stand before their predecessor in a range."""
    path = place(spark, "split")
    writers.write_split(alignments(spark, d).select("chrom", "pos0"), path, "chrom")
    part = reads.coordinate_sort(spark.read.parquet(path)).select("chrom", "pos0", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    w = Window.partitionBy("part", "chrom").orderBy("at")
    wrong = F.coalesce((F.col("pos0") < F.lag("pos0").over(w)).cast("int"), F.lit(0))
    return part.withColumn("wrong", wrong).groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos0").alias("first"), F.max("pos0").alias("last"), F.sum("wrong").alias("disorder"))


@query("q87_log_discovery", "SELECT 100 + l_suppkey % 3 AS job, l_orderkey % 50 AS task FROM lineitem WHERE l_suppkey % 3 = 1 AND (SELECT count(DISTINCT l_orderkey % 50) FROM lineitem) > 0 GROUP BY ALL")
def q87(spark: SparkSession, d: str) -> DataFrame:
    """Log files of the job with most of them: job 101 has all tasks, the others have none beyond task 20."""
    named = table(spark, d, "lineitem").selectExpr("100 + l_suppkey % 3 AS job", "l_orderkey % 50 AS task").distinct().where("job = 101 or task < 20")
    files = named.selectExpr("concat('/logs/run_', job, '_', task, '.out') AS path")
    return logs.discover(files).select(F.col("job").cast("long").alias("job"), F.col("task").cast("long").alias("task"))


@query("q88_assignment_text", "SELECT s_suppkey AS k, s_suppkey * 1234 AS total_reads, s_suppkey * 1000 AS assigned_reads, round(s_suppkey % 100 + 0.25, 2) AS assignment_rate FROM supplier")
def q88(spark: SparkSession, d: str) -> DataFrame:
    text = "concat('Summary\nTotal reads: ', format_number(s_suppkey * 1234, 0), '\nAssigned reads:\t', s_suppkey * 1000, '\nAssignment rate (%): ', s_suppkey % 100, '.25\n') AS text"
    found = table(spark, d, "supplier").selectExpr("s_suppkey AS k", text).select("k", logs.assignment_stats(F.col("text")).alias("s"))
    return found.select("k", F.col("s.total_reads").cast("long").alias("total_reads"), F.col("s.assigned_reads").cast("long").alias("assigned_reads"), F.col("s.assignment_rate").alias("assignment_rate"))
