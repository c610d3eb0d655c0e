"""Metric tables, down-sampling tasks, complexity curves, marker genes and dashboard data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metric keys of the tool's tables and the names they get.
METRICS = {
    "alignment_metrics": {"PCT_PF_READS_ALIGNED": "pct_reads_aligned", "MEAN_READ_LENGTH": "mean_read_length", "PF_READS_ALIGNED": "reads_aligned", "PF_READS": "total_reads"},
    "gc_summary": {"MEAN_GC": "mean_gc", "AT_DROPOUT": "at_dropout", "GC_DROPOUT": "gc_dropout"},
    "duplicate_metrics": {"PERCENT_DUPLICATION": "pct_duplicates", "READ_PAIRS_EXAMINED": "read_pairs_examined", "READ_PAIR_DUPLICATES": "read_pair_duplicates"},
    "wgs_metrics": {"MEAN_COVERAGE": "mean_coverage", "MEDIAN_COVERAGE": "median_coverage", "PCT_1X": "pct_1x", "PCT_10X": "pct_10x"},
}


def metrics_map(text: Column) -> Column:
    """map<string,string> of the first table after '## METRICS CLASS'; null if there is none."""
    line = lambda k: F.regexp_extract(text, r"(?m)^## METRICS CLASS[^\n]*\n([^\n]*)\n([^\n]*)", k)
    header, data = F.split(line(1), "\t"), F.split(line(2), "\t")
    return F.when((line(1) != "") & (F.size(header) == F.size(data)), F.map_from_arrays(header, data))


def strict_metrics(text: Column) -> Column:
    """struct(metrics, error): header is the first line that is neither blank nor a comment; a row of another width is an error."""
    body = F.filter(F.split(text, "\n"), lambda s: (F.trim(s) != "") & ~s.startswith("#"))
    header, data = F.split(F.try_element_at(body, F.lit(1)), "\t"), F.split(F.try_element_at(body, F.lit(2)), "\t")
    same = F.coalesce(F.size(header) == F.size(data), F.lit(False))
    return F.struct(F.when(same, F.map_from_arrays(header, data)).alias("metrics"), F.when(~same, F.lit("header and data differ in width")).alias("error"))


def scalar(text: Column) -> Column:
    """The one number in a file, null if it isn't one."""
    return F.trim(text).try_cast("double")


def file_part(path: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(path, pattern, group)
    return F.when(found != "", found)


def compile_metrics(files: DataFrame) -> DataFrame:
    """One row for each barcode with an alignment table, from (path, value): all metrics that are there, else null.

    Files are named {barcode}_{kind}.txt; both spellings of the duplicate table count. {barcode}_gini.txt holds one number.
    """
    kind = r"([^/]+?)_(alignment_metrics|gc_summary|duplicate_metrics|duplication_metrics|wgs_metrics|gini)\.txt$"
    rows = files.select(file_part(F.col("path"), kind, 1).alias("barcode"), file_part(F.col("path"), kind, 2).alias("kind"), "value").where("barcode is not null")
    rows = rows.withColumn("kind", F.when(F.col("kind") == "duplication_metrics", "duplicate_metrics").otherwise(F.col("kind"))).withColumn("m", metrics_map(F.col("value")))
    out = []
    for k, names in METRICS.items():
        out += [F.max(F.when(F.col("kind") == k, F.try_element_at("m", F.lit(key)).try_cast("double"))).alias(name) for key, name in names.items()]
    out.append(F.max(F.when(F.col("kind") == "gini", scalar(F.col("value")))).alias("gini_coefficient"))
    return rows.groupBy("barcode").agg(F.count_if(F.col("kind") == "alignment_metrics").alias("has"), *out).where("has > 0").drop("has")


def compile_enrichment(files: DataFrame) -> DataFrame:
    """(barcode, dna, rna, dna_postrescue, rna_postrescue) from files with one number each; unreadable is null."""
    kind = r"([^/]+?)_exonic_enrichment_(dna|rna)(_postrescue)?\.txt$"
    rows = files.select(file_part(F.col("path"), kind).alias("barcode"), F.concat(F.regexp_extract("path", kind, 2), F.regexp_extract("path", kind, 3)).alias("kind"), scalar(F.col("value")).alias("v")).where("barcode is not null")
    return rows.groupBy("barcode").pivot("kind", ["dna", "rna", "dna_postrescue", "rna_postrescue"]).agg(F.first("v"))


def depth_label(depth: Column) -> Column:
    """5000000 -> 5M, 1500 -> 1K."""
    return F.when(depth >= 1_000_000, F.concat(F.floor(depth / 1_000_000).cast("string"), F.lit("M"))).when(depth >= 1000, F.concat(F.floor(depth / 1000).cast("string"), F.lit("K"))).otherwise(depth.cast("string"))


def label_depth(label: Column) -> Column:
    n, unit = F.regexp_extract(label, r"^(\d+)([KM])", 1), F.regexp_extract(label, r"^(\d+)([KM])", 2)
    return F.when(n != "", n.cast("long") * F.when(unit == "M", 1_000_000).otherwise(1000)).otherwise(label.try_cast("long"))


def downsample_tasks(manifest: DataFrame, depths: DataFrame) -> DataFrame:
    """A task for each cell and depth that it reaches, numbered by data set, cell and depth."""
    tasks = manifest.where("total_mapped_reads > 0").crossJoin(F.broadcast(depths)).withColumn("fraction", F.col("target_depth").cast("double") / F.col("total_mapped_reads")).where("fraction <= 1")
    number = F.row_number().over(Window.orderBy("dataset", "cell_id", "target_depth"))
    return tasks.withColumns({"depth_label": depth_label(F.col("target_depth")), "task_id": number})


def nearest_row(curve: DataFrame, depths: DataFrame, by: str = "sample", x: str = "total_reads") -> DataFrame:
    """For every group and depth the row whose x is nearest, the first by x on ties.

    The depths, one short array, part a group's rows into stretches, of which only the first and the last row can be nearest to a depth. One aggregate keeps
    these two; depths and kept rows take their places in two running windows, one in either direction, over a few rows for each depth.
    """
    columns = [c for c in curve.columns if c != by]
    wanted = depths.agg(F.collect_set("depth").alias("d")).select(F.sort_array("d")).scalar()
    rows = curve.where(F.col(x).isNotNull()).select(F.col(by).alias("g"), F.col(x).cast("double").alias("at"), F.struct(*columns).alias("row"), wanted.alias("wanted"))
    rows = rows.withColumn("stretch", F.size(F.filter("wanted", lambda d: d < F.col("at"))))
    ends = rows.groupBy("g", "stretch").agg(F.min_by("row", "at").alias("first"), F.max_by("row", "at").alias("last"))
    rows = ends.select("g", F.explode(F.array("first", "last")).alias("row")).select("g", F.col(f"row.{x}").cast("double").alias("at"), F.lit(0).alias("asks"), "row", F.lit(None).cast(depths.schema["depth"].dataType).alias("depth"))
    asked = ends.select("g").distinct().select("g", F.explode(wanted).alias("depth"))
    asked = asked.select("g", F.col("depth").cast("double").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "depth")
    before = F.last("row", ignorenulls=True).over(Window.partitionBy("g").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.last("row", ignorenulls=True).over(Window.partitionBy("g").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    beside = rows.unionByName(asked).select("g", "asks", "depth", before.alias("a"), behind.alias("b")).where("asks = 1")
    closer = F.when(F.col("b").isNull() | (F.col("depth") - F.col(f"a.{x}") <= F.col(f"b.{x}") - F.col("depth")), F.col("a")).otherwise(F.col("b"))
    return beside.select(F.col("g").alias(by), "depth", closer.alias("r")).select(by, "depth", "r.*")


def last_row(curve: DataFrame, by: str, order: str) -> DataFrame:
    return curve.groupBy(by).agg(F.max_by(F.struct(*[c for c in curve.columns if c != by]), order).alias("b")).select(by, "b.*")


def wide_by_depth(rows: DataFrame, values: dict[str, str], by: str = "sample", prefix: str = "extrap") -> DataFrame:
    """One row for each group with a column {prefix}_{depth}_{name} for each depth and value, for a sink. rows: (by, depth, columns of `values`).

    The depths are one small list of targets, which names the columns.
    """
    labelled = rows.select(by, depth_label(F.col("depth")).alias("label"), F.col("depth"), *values)
    labels = [r[0] for r in labelled.groupBy("label").agg(F.min("depth").alias("d")).orderBy("d").select("label").collect()]
    out = labelled.groupBy(by).agg(*[F.max(F.when(F.col("label") == k, F.col(c))).alias(f"{prefix}_{k}_{name}") for k in labels for c, name in values.items()])
    return out


def fraction_unique(curve: DataFrame) -> DataFrame:
    return curve.withColumn("fraction_unique", F.try_divide(F.col("distinct_reads").cast("double"), F.col("total_reads")))


def complexity_curve(reads: DataFrame, key: str, fragment: list[str], fractions: list[float], by: str = "cell") -> DataFrame:
    """(by, fraction, total_reads, distinct_reads) over nested samples by a hash of the integer key, in one pass."""
    level = F.pmod(F.col(key) * F.lit(2654435761), F.lit(4294967296)) / F.lit(4294967296.0)
    wanted = F.array(*[F.lit(f) for f in fractions])
    rows = reads.select(by, *fragment, F.explode(F.filter(wanted, lambda f: level < f)).alias("fraction"))
    return rows.groupBy(by, "fraction").agg(F.count("*").alias("total_reads"), F.count_distinct(F.struct(*fragment)).alias("distinct_reads"))


def assigned(df: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """df with columns of another table that has one row for each key; null where it has none. Rows are matched by key and never by their order."""
    return df.join(other.groupBy(*on).agg(*[F.first(c).alias(c) for c in columns]), on, "left")


def explode_markers(markers: DataFrame) -> DataFrame:
    """One row for each gene in a comma list, trimmed, without blanks."""
    return markers.select(*[c for c in markers.columns if c != "genes"], F.explode(F.split("genes", ",")).alias("gene")).withColumn("gene", F.trim("gene")).where("gene <> ''")


def map_markers(markers: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds gene_id by exact name, else by lower-cased name (the first by ord), else null. genes: (gene_name, gene_id, ord)."""
    exact = genes.groupBy(F.col("gene_name").alias("gene")).agg(F.min_by("gene_id", "ord").alias("exact_id"))
    lower = genes.groupBy(F.lower("gene_name").alias("low")).agg(F.min_by("gene_id", "ord").alias("lower_id"))
    joined = markers.withColumn("low", F.lower("gene")).join(exact, "gene", "left").join(lower, "low", "left")
    return joined.select(*markers.columns, F.coalesce("exact_id", "lower_id").alias("gene_id"))


def funnel(summary: DataFrame) -> DataFrame:
    """(step, name, reads, lost) from one row (input_pairs, mapped_pairs, pairs_removed, mapped, proper): two reads for each pair; the last two steps only with a
    flagstat."""
    rows = [("input", 2 * F.col("input_pairs")), ("barcoded", 2 * F.col("mapped_pairs")), ("trimmed", 2 * (F.col("mapped_pairs") - F.col("pairs_removed"))), ("mapped", F.col("mapped")), ("properly paired", F.col("proper"))]
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), reads.cast("long").alias("reads")) for k, (name, reads) in enumerate(rows)]))
    out = summary.select(steps.alias("s")).select("s.*").where("reads is not null")
    return out.withColumn("lost", F.col("reads") - F.lead("reads").over(Window.orderBy("step")))


def complete_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join in which every left row must find one row on the right; a missing key raises."""
    joined = left.join(right.withColumn("__found", F.lit(True)), on, "left")
    checked = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no such key: "), F.col(on).cast("string")))).otherwise(F.col(on))
    return joined.withColumn(on, checked).drop("__found")


def coverage_scatter(cells: DataFrame, conditions: DataFrame | None = None, default: str = "Unassigned") -> DataFrame:
    """(barcode, condition, mean_coverage, pct_1x) of the cells that have both figures."""
    out = cells.where("mean_coverage is not null and pct_1x is not null").select("barcode", "mean_coverage", "pct_1x")
    if conditions is None:
        return out.withColumn("condition", F.lit(default))
    return out.join(conditions.select("barcode", "condition"), "barcode", "left").withColumn("condition", F.coalesce("condition", F.lit(default)))


def cards(summary: DataFrame, names: list[str]) -> DataFrame:
    """(card, value) in the given order; shares of at most 1 become percent."""
    values = [F.struct(F.lit(k).alias("ord"), F.lit(n).alias("card"), F.when(F.lit(n.startswith(("pct_", "rate_"))) & (F.col(n) <= 1), F.col(n) * 100).otherwise(F.col(n)).cast("double").alias("value")) for k, n in enumerate(names)]
    return summary.select(F.explode(F.array(*values)).alias("c")).select("c.*")


def thousands(x: Column) -> Column:
    """Thousands separators; four digits below 0.01; N/A for null."""
    return F.coalesce(F.when(F.abs(x) < 0.01, F.format_number(x, 4)).otherwise(F.format_number(x, 0)), F.lit("N/A"))


def grouped_and_overall(df: DataFrame, by: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates for each group and over all (group null, overall true): GROUPING SETS ((by), ())."""
    return df.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).cast("boolean").alias("overall"), *aggregates)


def describe(df: DataFrame, by: str, value: str) -> DataFrame:
    q = [F.percentile(value, p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return df.groupBy(by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), *q, F.max(value).alias("max"))


def adjust_p_values(df: DataFrame, p: str = "p_value", by: list[str] | None = None) -> DataFrame:
    """Adds q_value, the Benjamini-Hochberg adjusted p-value."""
    group = by or []
    up = Window.partitionBy(*group).orderBy(p)
    n = F.count(p).over(Window.partitionBy(*group))
    raw = df.withColumn("__q", F.col(p) * n / F.rank().over(up))
    return raw.withColumn("q_value", F.least(F.lit(1.0), F.min("__q").over(Window.partitionBy(*group).orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing)))).drop("__q")


def poisson_tail(k: Column, rate: Column, terms: int = 400) -> Column:
    """P(X >= k) of a Poisson variable, from its largest term on the side of k away from the rate; `terms` of them reach full precision for rates up
    to some thousands."""
    upper, start = k > rate, F.when(k > rate, k).otherwise(k - 1)
    ratio = lambda i: F.when(upper, rate / (start + i)).otherwise((start - i + 1) / rate)
    step = lambda a, i: F.struct((a["t"] * F.greatest(ratio(i), F.lit(0.0))).alias("t"), (a["s"] + a["t"] * F.greatest(ratio(i), F.lit(0.0))).alias("s"))
    total = F.exp(start * F.log(rate) - rate - log_factorial(start)) * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]
    return F.when(k <= 0, 1.0).when(rate <= 0, 0.0).when(upper, F.least(F.lit(1.0), total)).otherwise(F.greatest(F.lit(0.0), 1 - total))


def log_factorial(k: Column) -> Column:
    """ln k! from Stirling's series at k + 8, brought down again."""
    x = k + 8.0
    series = x * F.log(x) - x + 0.5 * F.log(2 * 3.141592653589793 * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    down = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), lambda s, i: s + F.log(k + i))
    return series - down


def rescue_rna(genes: DataFrame, background: DataFrame, fdr: float = 0.05, prior: tuple[float, float] = (3.0, 5.0)) -> DataFrame:
    """RNA share of the reads in each gene of a cell. genes: (cell, gene, reads, bp); background: (cell, reads, bp) of intergenic ground.

    The background rate gives the reads that DNA alone leaves in a gene; their Poisson tail is the p-value, adjusted over a cell's genes. Where it is
    at most `fdr` the share is (excess + a) / (reads + b), within 0 and 1, else 0. A cell without background has rate 0.
    """
    rate = background.groupBy("cell").agg(F.try_divide(F.sum("reads").cast("double"), F.sum("bp")).alias("rate"))
    rows = genes.join(rate, "cell", "left").withColumn("expected", F.coalesce("rate", F.lit(0.0)) * F.col("bp"))
    rows = rows.withColumn("p_value", poisson_tail(F.col("reads").cast("double"), F.col("expected")))
    q = adjust_p_values(rows, "p_value", ["cell"])
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("reads") - F.col("expected") + prior[0]) / (F.col("reads") + prior[1])))
    return q.withColumn("rna_share", F.when(F.col("q_value") <= fdr, share).otherwise(0.0)).drop("rate")


def reassign(reads: DataFrame, shares: DataFrame, seed: int = 42) -> DataFrame:
    """Adds modality rna or dna: a read is RNA with the greatest share of the genes it lies in, drawn by the hash of its template.

    reads: (cell, qname, gene), one row for each gene of a read; the result has one row for each read.
    """
    best = reads.join(shares.select("cell", "gene", "rna_share"), ["cell", "gene"], "left").groupBy("cell", "qname").agg(F.coalesce(F.max("rna_share"), F.lit(0.0)).alias("rna_share"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("qname")), F.lit(1 << 30)) / float(1 << 30)
    return best.withColumn("modality", F.when(draw < F.col("rna_share"), "rna").otherwise("dna"))
