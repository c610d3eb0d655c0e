"""Queries over coverage, metrics, logs and dashboard data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import stats
from strandlake.operators import coverage, logs, qc, reads

from .base import ALIGNMENTS_SQL, GENOME, alignments, query, table

A = f"WITH {ALIGNMENTS_SQL}"
WIDTH = 10_000
BINNED = f"""contigs AS (SELECT concat('chr', 1 + range) AS chrom, 100200 AS length FROM range(22)),
spine AS (SELECT chrom, b * {WIDTH} AS bin_start, least(b * {WIDTH} + {WIDTH}, length) AS bin_end FROM contigs, (SELECT range AS b FROM range(11))),
hit AS (SELECT cell, chrom, unnest(range(pos0 // {WIDTH}, (pos1 - 1) // {WIDTH} + 1)) * {WIDTH} AS bin_start FROM alignments),
counts AS (SELECT cell, chrom, bin_start, count(*) AS n FROM hit GROUP BY ALL),
binned AS (SELECT cell, spine.chrom AS chrom, spine.bin_start AS bin_start, bin_end, coalesce(n, 0) AS value FROM (SELECT DISTINCT cell FROM alignments) CROSS JOIN spine LEFT JOIN counts USING (cell, chrom, bin_start))"""


def contigs(spark: SparkSession) -> DataFrame:
    return spark.range(22).select(F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("chrom"), F.lit(100200).cast("long").alias("length"))


def bins(spark: SparkSession, d: str) -> DataFrame:
    return coverage.binned(alignments(spark, d).select("cell", "chrom", "pos0", "pos1"), contigs(spark), WIDTH)


def counted_bins(spark: SparkSession, d: str) -> DataFrame:
    return coverage.bin_counts(alignments(spark, d).select("cell", "chrom", "pos0", "pos1"), WIDTH)


@query("q14_binned_coverage", f"{A}, {BINNED} SELECT cell, chrom, bin_start, bin_end::BIGINT AS bin_end, value FROM binned")
def q14(spark: SparkSession, d: str) -> DataFrame:
    return bins(spark, d).select("cell", "chrom", "bin_start", "bin_end", "value")


CURVE = """share AS (SELECT cell, row_number() OVER w AS i, sum(value) OVER w / sum(value) OVER (PARTITION BY cell) AS c, count(*) OVER (PARTITION BY cell) AS n FROM binned WINDOW w AS (PARTITION BY cell ORDER BY value, chrom, bin_start ROWS UNBOUNDED PRECEDING))"""


@query("q15_gini_per_cell", f"{A}, {BINNED}, {CURVE} SELECT cell, round(1 - 2 / max(n) * (sum(c) - (min(CASE WHEN i = 1 THEN c END) + 1) / 2), 9) AS gini FROM share GROUP BY cell")
def q15(spark: SparkSession, d: str) -> DataFrame:
    return coverage.gini(counted_bins(spark, d), n=coverage.number_of_bins(contigs(spark), WIDTH)).withColumn("gini", F.round("gini", 9))


@query("q15b_mean_gini_by_group", f"""{A}, {BINNED}, {CURVE}, g AS (SELECT cell, 1 - 2 / max(n) * (sum(c) - (min(CASE WHEN i = 1 THEN c END) + 1) / 2) AS gini FROM share GROUP BY cell)
SELECT s_nationkey AS method, round(avg(gini), 9) AS mean, count(gini) AS n FROM g JOIN supplier ON cell = concat('c', s_suppkey) GROUP BY s_nationkey""")  # fmt: skip
def q15b(spark: SparkSession, d: str) -> DataFrame:
    g = coverage.gini(counted_bins(spark, d), n=coverage.number_of_bins(contigs(spark), WIDTH))
    methods = table(spark, d, "supplier").selectExpr("concat('c', s_suppkey) AS cell", "s_nationkey AS method")
    return coverage.group_mean(g.join(methods, "cell"), ["method"]).withColumn("mean", F.round("mean", 9))


@query("q16_lorenz_curve", f"""{A}, {BINNED}, {CURVE}, grid AS (SELECT range AS j FROM range(100)), cells AS (SELECT cell, max(n) AS n FROM share GROUP BY cell),
spot AS (SELECT cell, n, j, floor(n * j / 99)::BIGINT AS k, n * j / 99 - floor(n * j / 99) AS f FROM cells, grid)
SELECT spot.cell AS cell, round(j / 99, 9) AS cumulative_fraction_genome, round(CASE WHEN k + 1 >= spot.n THEN 1 ELSE lo.c + f * (hi.c - lo.c) END, 9) AS cumulative_fraction_reads
FROM spot LEFT JOIN share lo ON lo.cell = spot.cell AND lo.i = k + 1 LEFT JOIN share hi ON hi.cell = spot.cell AND hi.i = k + 2""")  # fmt: skip
def q16(spark: SparkSession, d: str) -> DataFrame:
    return coverage.lorenz(counted_bins(spark, d), n=coverage.number_of_bins(contigs(spark), WIDTH)).select("cell", *[F.round(c, 9).alias(c) for c in ("cumulative_fraction_genome", "cumulative_fraction_reads")])


DEPTH = f"""counted AS (SELECT * FROM alignments WHERE (flag & 3332) = 0 AND mapq >= 20),
steps AS (SELECT cell, chrom, p, sum(s) AS s FROM (SELECT cell, chrom, pos0 AS p, 1 AS s FROM counted UNION ALL SELECT cell, chrom, pos1, -1 FROM counted) GROUP BY ALL),
runs AS (SELECT cell, sum(s) OVER w AS depth, lead(p) OVER w - p AS bp FROM steps WINDOW w AS (PARTITION BY cell, chrom ORDER BY p)),
hist AS (SELECT cell, depth, sum(bp) AS bp FROM runs WHERE depth > 0 AND bp > 0 GROUP BY ALL),
filled AS (SELECT * FROM hist UNION ALL SELECT cell, 0, {GENOME} - sum(bp) FROM hist GROUP BY cell),
upto AS (SELECT *, sum(bp) OVER (PARTITION BY cell ORDER BY depth) AS upto FROM filled)"""


@query("q17_wgs_metrics", f"""{A}, {DEPTH}, m AS (SELECT cell, sum(depth * bp) / {GENOME} AS mean, sum(depth * depth * bp) / {GENOME} AS square, min(CASE WHEN upto * 2 >= {GENOME} THEN depth END) AS median,
 coalesce(sum(bp) FILTER (WHERE depth >= 1), 0) / {GENOME} AS p1, coalesce(sum(bp) FILTER (WHERE depth >= 5), 0) / {GENOME} AS p5, coalesce(sum(bp) FILTER (WHERE depth >= 10), 0) / {GENOME} AS p10 FROM upto GROUP BY cell)
SELECT cell, round(mean, 9) AS mean_coverage, median::BIGINT AS median_coverage, round(sqrt(square - mean * mean), 6) AS sd_coverage, round(p1, 9) AS pct_1x, round(p5, 9) AS pct_5x, round(p10, 9) AS pct_10x FROM m""")  # fmt: skip
def q17(spark: SparkSession, d: str) -> DataFrame:
    m = coverage.wgs_metrics(coverage.countable(alignments(spark, d)), GENOME)
    return m.select("cell", F.round("mean_coverage", 9).alias("mean_coverage"), F.col("median_coverage").cast("long").alias("median_coverage"), F.round("sd_coverage", 6).alias("sd_coverage"), *[F.round(c, 9).alias(c) for c in ("pct_1x", "pct_5x", "pct_10x")])


@query("q18_lander_waterman", f"""{A}, r AS (SELECT cell, count(*) / {GENOME} * 1e6 AS x FROM alignments GROUP BY cell), top AS (SELECT max(x) * 1.05 AS top FROM r)
SELECT range AS k, round(top * range / 999, 6) AS x, round(1 - exp(-(top * range / 999) * 75 / 1e6), 9) AS coverage FROM top, range(1000)""")  # fmt: skip
def q18(spark: SparkSession, d: str) -> DataFrame:
    per_cell = alignments(spark, d).groupBy("cell").agg(F.count("*").alias("total_reads"))
    return coverage.theory_curve(coverage.lander_waterman(per_cell, GENOME), 75.0).select("k", F.round("x", 6).alias("x"), F.round("coverage", 9).alias("coverage"))


@query("q20_downsample_tasks", """WITH m AS (SELECT concat('n', s_nationkey) AS dataset, s_suppkey AS cell_id, s_suppkey * 130000 AS reads FROM supplier), dep AS (SELECT unnest([1000000, 1500, 5000000, 10000000]) AS target_depth)
SELECT row_number() OVER (ORDER BY dataset, cell_id, target_depth) AS task_id, dataset, cell_id, target_depth::BIGINT AS target_depth, round(target_depth / reads, 9) AS fraction,
 CASE target_depth WHEN 1500 THEN '1K' WHEN 1000000 THEN '1M' WHEN 5000000 THEN '5M' ELSE '10M' END AS depth_label FROM m, dep WHERE reads > 0 AND target_depth / reads <= 1""")  # fmt: skip
def q20(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "supplier").selectExpr("concat('n', s_nationkey) AS dataset", "s_suppkey AS cell_id", "s_suppkey * 130000 AS total_mapped_reads")
    depths = spark.createDataFrame([(1_000_000,), (1500,), (5_000_000,), (10_000_000,)], "target_depth long")
    return qc.downsample_tasks(manifest, depths).select("task_id", "dataset", "cell_id", "target_depth", F.round("fraction", 9).alias("fraction"), "depth_label")


@query("q21_nearest_depth_row", """WITH c AS (SELECT o_custkey % 20 AS sample, o_orderkey % 100000 AS total_reads, min(o_totalprice) AS v FROM orders GROUP BY ALL), dep AS (SELECT unnest([100, 5000, 50000]) AS depth)
SELECT sample, depth::BIGINT AS depth, total_reads, v FROM (SELECT *, row_number() OVER (PARTITION BY sample, depth ORDER BY abs(total_reads - depth), total_reads) AS k FROM c, dep) WHERE k = 1""")  # fmt: skip
def q21(spark: SparkSession, d: str) -> DataFrame:
    curve = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("sample"), (F.col("o_orderkey") % 100000).alias("total_reads")).agg(F.min("o_totalprice").alias("v"))
    return qc.nearest_row(curve, spark.createDataFrame([(100,), (5000,), (50000,)], "depth long"))


@query("q22_library_complexity", """WITH c AS (SELECT l_suppkey AS sample, l_linenumber AS depth, count(*) AS total_reads, count(DISTINCT l_partkey % 50) AS distinct_reads FROM lineitem GROUP BY ALL)
SELECT *, round(distinct_reads / total_reads, 9) AS fraction_unique FROM c""")  # fmt: skip
def q22(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("depth")).agg(F.count("*").alias("total_reads"), F.count_distinct(F.col("l_partkey") % 50).alias("distinct_reads"))
    return qc.fraction_unique(c).withColumn("fraction_unique", F.round("fraction_unique", 9))


@query("q22b_last_row_per_sample", "SELECT sample, total_reads, v FROM (SELECT o_custkey AS sample, o_orderkey AS total_reads, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def q22b(spark: SparkSession, d: str) -> DataFrame:
    return qc.last_row(table(spark, d, "orders").selectExpr("o_custkey AS sample", "o_orderkey AS total_reads", "o_totalprice AS v"), "sample", "total_reads")


@query("q27_group_mean_curve", "SELECT l_returnflag AS grp, l_linenumber AS x, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY ALL")
def q27(spark: SparkSession, d: str) -> DataFrame:
    curves = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("x"), "l_extendedprice")
    return coverage.group_curve(curves, "grp", "x", "l_extendedprice").select("grp", "x", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


#: Text of a tool's log over the columns of supplier: k = s_suppkey; a fifth of the logs is short.
_LOG = [
    "total_reads: ", "k * 100", "\nmapped_reads: ", "k * 80", "\nproportion of reads with barcode mapped: 0.8\n=== Summary ===\nTotal reads processed:     ", "format_number(k * 80, 0)", "\nReads with adapters:      ", "format_number(k * 40, 0)", " (50.0%)\nTotal basepairs processed:   ",
    "format_number(k * 12000, 0)", " bp\nQuality-trimmed:      120 bp (1.0%)\nTotal written (filtered):   11,000 bp (91.7%)\nOverview of removed sequences\nlength\tcount\texpect\tmax.err\terror counts\n1\t", "k", "\t20.0\t0\t30\n2\t10\t5.0\t0\t10\n\nNumber of sequence pairs removed because at least one read was shorter than the length cutoff (20 bp): ",
    "k % 50", " (6.25%)\n[M::mem_pestat] analyzing insert size distribution for orientation FR...\n[M::mem_pestat] (25, 50, 75) percentile: (180, ", "200 + k % 90", ", 430)\n[M::mem_pestat] mean and std.dev: (", "260 + k % 7", ".50, 90.25)\n[M::mem_process_seqs] Processed ", "k * 90", " reads in 0.1 CPU sec, 0.1 real sec\n[M::mem_process_seqs] Processed ", "k * 60",
    " reads in 0.1 CPU sec, 0.1 real sec\n[main] Version: 0.7.17\n",
]
_SHORT = ["", "k * 100", "/", "k * 100", " [00:01<00:00]\nproportion of reads with barcode mapped: 0.8\n"]


def _text(parts: list[str]) -> Column:
    return F.concat(*[(F.expr(x).cast("string") if k % 2 else F.lit(x)) for k, x in enumerate(parts)])


@query("q38_parse_logs", """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 > 0 AS long FROM supplier)
SELECT k AS log_id, k * 100 AS total_reads, k * 80 AS mapped_reads, 0.8::DOUBLE AS barcode_mapping_rate, CASE WHEN long THEN k * 80 END AS r1_total, CASE WHEN long THEN k * 40 END AS r1_adapters, CASE WHEN long THEN 50.0::DOUBLE END AS r1_pct, CASE WHEN long THEN k * 12000 END AS r1_bp, CASE WHEN long THEN 2 END AS r1_bins,
 CASE WHEN long THEN k % 50 END AS pairs_removed, CASE WHEN long THEN 6.25::DOUBLE END AS pct_pairs_removed, CASE WHEN long THEN k * 150 END AS reads_processed, CASE WHEN long THEN 200 + k % 90 END AS insert_median, CASE WHEN long THEN 260.5::DOUBLE + k % 7 END AS insert_mean FROM s""")  # fmt: skip
def q38(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "supplier").selectExpr("s_suppkey AS k").select(F.col("k").alias("log_id"), F.when(F.col("k") % 5 > 0, _text(_LOG)).otherwise(_text(_SHORT)).alias("value"))
    p = logs.parse(texts)
    r1 = "trimming.r1."
    return p.select(
        "log_id", "demux.*", F.col(r1 + "total_reads").alias("r1_total"), F.col(r1 + "reads_with_adapters").alias("r1_adapters"), F.col(r1 + "pct_with_adapters").alias("r1_pct"), F.col(r1 + "total_bp").alias("r1_bp"),
        F.when(F.col("trimming.r1").isNotNull(), F.size(r1 + "adapter_position_histogram")).alias("r1_bins"), "trimming.pairs_removed", "trimming.pct_pairs_removed", "alignment.reads_processed",
        F.col("alignment.insert_size_median").alias("insert_median"), F.col("alignment.insert_size_mean").alias("insert_mean"),
    )


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunk statistics made of the orders of each customer."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    histogram = F.expr("array(named_struct('length', k % 7, 'count', n), named_struct('length', k % 5 + 10, 'count', 2 * n))")
    side = lambda a, b: F.struct(F.expr(a).alias("total_reads"), F.expr(b).alias("reads_with_adapters"), histogram.alias("adapter_position_histogram"))
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("chunk_id"), F.concat(F.lit("sample"), F.col("o_custkey") % 3).alias("sample_name"), F.lit("ref").alias("reference_genome"),
        F.expr("named_struct('total_reads', n * 100, 'mapped_reads', n * 80 - k % 5, 'barcode_mapping_rate', 0.8D)").alias("demux"),
        F.struct(side("n * 80", "n * 40").alias("r1"), side("n * 80", "n * 30").alias("r2"), F.expr("k % 11").alias("pairs_removed")).alias("trimming"),
        F.expr("named_struct('bwa_version', '0.7.17', 'reads_processed', n * 150, 'insert_size_mean', if(k % 2 = 0, 300.0D + k % 10, null), 'insert_size_median', 290 + k % 10)").alias("alignment"),
    )


CHUNKS = "c AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)"


@query("q39_preprocessing_summary", f"""WITH {CHUNKS} SELECT count(*) AS chunks, arg_min(concat('sample', o_custkey % 3), o_custkey) AS sample_name, sum(n * 100)::BIGINT AS total_reads, sum(n * 80 - k % 5)::BIGINT AS mapped_reads,
 round(sum(n * 80 - k % 5) / sum(n * 100), 6) AS barcode_mapping_rate, sum(n * 40)::BIGINT AS r1_reads_with_adapters, 50.0::DOUBLE AS r1_pct_with_adapters, sum(k % 11)::BIGINT AS pairs_removed, sum(n * 150)::BIGINT AS reads_processed,
 round(avg(CASE WHEN k % 2 = 0 THEN 300.0 + k % 10 END), 6) AS insert_size_mean, round(avg(290 + k % 10), 6) AS insert_size_median FROM c""")  # fmt: skip
def q39(spark: SparkSession, d: str) -> DataFrame:
    s = logs.summarise(chunk_rows(spark, d))
    return s.select("chunks", "sample_name", "total_reads", "mapped_reads", "barcode_mapping_rate", "r1_reads_with_adapters", "r1_pct_with_adapters", "pairs_removed", "reads_processed", F.round("insert_size_mean", 6).alias("insert_size_mean"), F.round("insert_size_median", 6).alias("insert_size_median"))


@query("q40_adapter_histogram", f"WITH {CHUNKS}, h AS (SELECT k % 7 AS length, n AS c FROM c UNION ALL SELECT k % 5 + 10, 2 * n FROM c) SELECT length, sum(c)::BIGINT AS count FROM h GROUP BY length")
def q40(spark: SparkSession, d: str) -> DataFrame:
    return logs.merge_histograms(chunk_rows(spark, d))


#: Metric files over the columns of supplier (k = s_suppkey): name, header, values and which suppliers have one.
_FILES = [
    ("alignment_metrics", "CATEGORY\tTOTAL_READS\tPF_READS\tPF_READS_ALIGNED\tPCT_PF_READS_ALIGNED\tMEAN_READ_LENGTH", ["'PAIR'", "k * 10", "k * 9", "k * 8", "0.5 + (k % 8) / 16", "100 + k % 40"], "k % 7 > 0"),
    ("gc_summary", "MEAN_GC\tAT_DROPOUT\tGC_DROPOUT", ["(k % 64) / 64", "k % 5", "k % 3"], "k % 2 = 0"),
    ("duplicate_metrics", "LIBRARY\tREAD_PAIRS_EXAMINED\tREAD_PAIR_DUPLICATES\tPERCENT_DUPLICATION", ["''", "k * 4", "k", "0.25"], "k % 3 = 1"),
    ("duplication_metrics", "LIBRARY\tREAD_PAIRS_EXAMINED\tREAD_PAIR_DUPLICATES\tPERCENT_DUPLICATION", ["''", "k * 4", "k", "0.25"], "k % 3 = 2"),
    ("wgs_metrics", "GENOME_TERRITORY\tMEAN_COVERAGE\tSD_COVERAGE\tMEDIAN_COVERAGE\tPCT_1X\tPCT_10X", ["1000000", "k / 8", "3.0", "k % 30", "(k % 32) / 32", "(k % 16) / 32"], "k % 4 > 0"),
]
_HAS_D = "k % 3 > 0"


def metric_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, value) of the metric files of all suppliers."""
    s, out = table(spark, d, "supplier").selectExpr("s_suppkey AS k"), None
    name = lambda kind: F.concat(F.lit("x/BC"), F.col("k").cast("string"), F.lit(f"_{kind}.txt")).alias("path")
    for kind, header, values, which in _FILES:
        line = F.concat_ws("\t", *[F.expr(v).cast("string") for v in values])
        part = s.where(which).select(name(kind), F.concat(F.lit(f"# made\n## METRICS CLASS\t{kind}\n{header}\n"), line, F.lit("\n")).alias("value"))
        out = part if out is None else out.unionAll(part)
    return out.unionAll(s.select(name("gini"), F.when(F.col("k") % 6 == 0, "none").otherwise(F.concat(((F.col("k") % 16) / 16).cast("string"), F.lit("\n"))).alias("value")))


@query("q41_compile_qc_metrics", f"""WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 > 0)
SELECT concat('BC', k) AS barcode, 0.5::DOUBLE + (k % 8) / 16 AS pct_reads_aligned, (100 + k % 40)::DOUBLE AS mean_read_length, (k * 8)::DOUBLE AS reads_aligned, (k * 9)::DOUBLE AS total_reads,
 CASE WHEN k % 2 = 0 THEN (k % 64) / 64 END AS mean_gc, CASE WHEN k % 2 = 0 THEN (k % 5)::DOUBLE END AS at_dropout, CASE WHEN k % 2 = 0 THEN (k % 3)::DOUBLE END AS gc_dropout,
 CASE WHEN {_HAS_D} THEN 0.25::DOUBLE END AS pct_duplicates, CASE WHEN {_HAS_D} THEN (k * 4)::DOUBLE END AS read_pairs_examined, CASE WHEN {_HAS_D} THEN k::DOUBLE END AS read_pair_duplicates,
 CASE WHEN k % 4 > 0 THEN k / 8 END AS mean_coverage, CASE WHEN k % 4 > 0 THEN (k % 30)::DOUBLE END AS median_coverage, CASE WHEN k % 4 > 0 THEN (k % 32) / 32 END AS pct_1x, CASE WHEN k % 4 > 0 THEN (k % 16) / 32 END AS pct_10x,
 CASE WHEN k % 6 > 0 THEN (k % 16) / 16 END AS gini_coefficient FROM s""")  # fmt: skip
def q41(spark: SparkSession, d: str) -> DataFrame:
    return qc.compile_metrics(metric_files(spark, d))


@query("q61_wide_by_depth", """WITH c AS (SELECT o_custkey % 20 AS sample, o_orderkey % 100000 AS total_reads, min(o_totalprice) AS v FROM orders GROUP BY ALL), dep AS (SELECT unnest([1500, 5000]) AS depth),
n AS (SELECT *, row_number() OVER (PARTITION BY sample, depth ORDER BY abs(total_reads - depth), total_reads) AS k FROM c, dep)
SELECT sample, max(CASE WHEN depth = 1500 THEN total_reads END) AS extrap_1K_reads, max(CASE WHEN depth = 1500 THEN v END) AS extrap_1K_distinct, max(CASE WHEN depth = 5000 THEN total_reads END) AS extrap_5K_reads, max(CASE WHEN depth = 5000 THEN v END) AS extrap_5K_distinct FROM n WHERE k = 1 GROUP BY sample""")  # fmt: skip
def q61(spark: SparkSession, d: str) -> DataFrame:
    curve = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("sample"), (F.col("o_orderkey") % 100000).alias("total_reads")).agg(F.min("o_totalprice").alias("v"))
    near = qc.nearest_row(curve, spark.createDataFrame([(1500,), (5000,)], "depth long"))
    return qc.wide_by_depth(near, {"total_reads": "reads", "v": "distinct"})


@query("q62_coverage_scatter", """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey % 4 > 0)
SELECT concat('BC', k) AS barcode, k / 8 AS mean_coverage, (k % 32) / 32 AS pct_1x, CASE WHEN k % 3 = 0 THEN 'Ctl' ELSE 'Unassigned' END AS condition FROM s""")
def q62(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").where("s_suppkey % 3 = 0").selectExpr("concat('BC', s_suppkey) AS barcode", "'Ctl' AS condition")
    return qc.coverage_scatter(qc.compile_metrics(metric_files(spark, d)), known)


@query("q42_read_funnel", """WITH s AS (SELECT count(*) AS p, count(*) FILTER (WHERE l_linenumber < 6) AS m, count(*) FILTER (WHERE l_linenumber = 5) AS r, count(*) FILTER (WHERE l_linenumber < 4) AS a, count(*) FILTER (WHERE l_linenumber < 3) AS q FROM lineitem),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS step, unnest(['input', 'barcoded', 'trimmed', 'mapped', 'properly paired']) AS name, unnest([2 * p, 2 * m, 2 * (m - r), a, q]) AS reads FROM s)
SELECT step, name, reads::BIGINT AS reads, (reads - lead(reads) OVER (ORDER BY step))::BIGINT AS lost FROM f""")  # fmt: skip
def q42(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    s = table(spark, d, "lineitem").agg(F.count("*").alias("input_pairs"), F.count_if(n < 6).alias("mapped_pairs"), F.count_if(n == 5).alias("pairs_removed"), F.count_if(n < 4).alias("mapped"), F.count_if(n < 3).alias("proper"))
    return qc.funnel(s)


@query("q42b_summary_cards", "SELECT * FROM (SELECT unnest([0, 1, 2]) AS ord, unnest(['cells', 'pct_small', 'median_balance']) AS card, unnest([count(*)::DOUBLE, round(100 * count(*) FILTER (WHERE c_acctbal < 1000) / count(*), 6), round(median(c_acctbal), 6)]) AS value FROM customer)")
def q42b(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").agg(F.count("*").alias("cells"), (F.count_if(F.col("c_acctbal") < 1000) / F.count("*")).alias("pct_small"), F.median("c_acctbal").alias("median_balance"))
    return qc.cards(s, ["cells", "pct_small", "median_balance"]).withColumn("value", F.round("value", 6))


@query("q44_condition_histograms", """SELECT c_mktsegment AS condition, least(floor(c_acctbal / 10000 * 25), 24)::BIGINT AS bin, count(*) AS n FROM customer WHERE c_acctbal BETWEEN 0 AND 10000 GROUP BY ALL""")
def q44(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "condition")
    return stats.histogram(c, "c_acctbal", 0.0, 10000.0, 25, by="condition")


@query("q44b_log_histogram_weighted", """SELECT least(floor((log10(n_chars) - 1) / 4 * 30), 29)::BIGINT AS bin, sum(n_chars)::BIGINT AS n FROM documents WHERE n_chars BETWEEN 10 AND 100000 GROUP BY ALL""")
def q44b(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "documents"), "n_chars", 10, 100000, 30, weight="n_chars", log=True)


@query("q48_marker_gene_mapping", """WITH g AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS gene_name, concat('G', p_partkey) AS gene_id FROM part),
m AS (SELECT s_suppkey AS marker, unnest(['Brand#' || (11 + s_suppkey % 50), 'brand#' || (s_suppkey % 40), 'zzz-9']) AS gene FROM supplier),
e AS (SELECT gene_name, arg_min(gene_id, ord) AS id FROM g GROUP BY gene_name), l AS (SELECT lower(gene_name) AS low, arg_min(gene_id, ord) AS id FROM g GROUP BY 1)
SELECT marker, gene, coalesce(e.id, l.id) AS gene_id FROM m LEFT JOIN e ON e.gene_name = gene LEFT JOIN l ON l.low = lower(gene)""")  # fmt: skip
def q48(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").selectExpr("p_partkey AS ord", "CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS gene_name", "concat('G', p_partkey) AS gene_id")
    m = table(spark, d, "supplier").selectExpr("s_suppkey AS marker", "concat('Brand#', 11 + s_suppkey % 50, ', brand#', s_suppkey % 40, ',, zzz-9') AS genes")
    return qc.map_markers(qc.explode_markers(m), g)


@query("q52_overall_and_per_condition", """SELECT c_mktsegment AS condition, grouping(c_mktsegment) = 1 AS overall, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())""")
def q52(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "condition")
    return qc.grouped_and_overall(c, "condition", [F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.median("c_acctbal"), 6).alias("median")])


@query("q56_describe", """SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, max(value) AS max FROM events GROUP BY event_type""")
def q56(spark: SparkSession, d: str) -> DataFrame:
    return qc.describe(table(spark, d, "events"), "event_type", "value").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("q57_mean_track", f"{A} SELECT cell, chrom, pos0 // 20000 * 20000 AS bin_start, round(avg(mapq), 9) AS mean FROM alignments GROUP BY ALL")
def q57(spark: SparkSession, d: str) -> DataFrame:
    return coverage.mean_track(alignments(spark, d).withColumn("value", F.col("mapq")), 20000).withColumn("mean", F.round("mean", 9))


@query("q57b_genome_track", f"""{A}, m AS (SELECT chrom, pos0 // 20000 * 20000 AS bin_start, round(avg(mapq), 9) AS mean FROM alignments GROUP BY ALL)
SELECT chrom, bin_start, mean, (substr(chrom, 4)::BIGINT - 1) * 100010 + bin_start AS genome_start FROM m""")  # fmt: skip
def q57b(spark: SparkSession, d: str) -> DataFrame:
    """One track over all contigs, 10 bases apart."""
    a = alignments(spark, d).withColumns({"value": F.col("mapq"), "all": F.lit("all")})
    contigs = table(spark, d, "part").selectExpr("concat('chr', 1 + p_partkey % 22) AS chrom", "100000L AS length").distinct()
    return coverage.genome_track(coverage.mean_track(a, 20000, "all").drop("all").withColumn("mean", F.round("mean", 9)), contigs, 10)


@query("q90_number_formats", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'N/A' WHEN s_suppkey % 5 = 1 THEN '0.0012' ELSE format('{:,d}', s_suppkey * 98765) END AS shown FROM supplier")
def q90(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("s_suppkey") % 5 == 1, 0.0012).when(F.col("s_suppkey") % 5 > 1, F.col("s_suppkey") * 98765.0)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), qc.thousands(x).alias("shown"))


@query("q91_chunks_of_templates", f"{A} SELECT qname, concat(cell, '_1') AS rg, count(*) AS n, 1 AS chunks FROM alignments GROUP BY ALL")
def q91(spark: SparkSession, d: str) -> DataFrame:
    """Records with a read group, dealt into eight chunks: a template's records stay together."""
    dealt = reads.chunked(reads.with_read_group(alignments(spark, d), F.concat("cell", F.lit("_1"))), 8)
    return dealt.groupBy("qname", "rg").agg(F.count("*").alias("n"), F.count_distinct("chunk").alias("chunks"))


@query("q92_assigned_by_key", "SELECT n_nationkey AS k, n_regionkey AS region, r_name AS name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def q92(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").selectExpr("n_nationkey AS k", "n_regionkey AS region")
    return qc.assigned(n, table(spark, d, "region").where("r_regionkey <> 2").selectExpr("r_regionkey AS region", "r_name AS name"), ["region"], ["name"])
