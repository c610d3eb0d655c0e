"""Text of tool logs to structs, and their sums over chunks. A key whose line is missing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(text: Column, pattern: str, group: int = 1, kind: str = "long") -> Column:
    """The first match's group without thousands separators, null if there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")).cast(kind))


def word(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def demux(text: Column) -> Column:
    """struct(total_reads, mapped_reads, barcode_mapping_rate); a missing total is the first progress bar's, a missing count round(total * rate)."""
    total = F.coalesce(number(text, r"total_reads:\s*([\d,]+)"), number(text, r"\d+/(\d+) \["))
    rate = number(text, r"proportion of reads with barcode mapped:\s*([\d.eE+-]+)", kind="double")
    mapped = F.coalesce(number(text, r"(?<![a-z_])mapped_reads:\s*([\d,]+)"), F.bround(total * rate).cast("long"))
    return F.struct(total.alias("total_reads"), mapped.alias("mapped_reads"), rate.alias("barcode_mapping_rate"))


def trimming(text: Column) -> Column:
    """One struct for each '=== Summary ===' section, in order, with the removed-length histogram."""
    sections = F.slice(F.split(text, "=== Summary ==="), 2, 1 << 30)

    def section(s: Column) -> Column:
        block = F.regexp_extract(s, r"(?s)length\s+count\s+expect[^\n]*\n((?:\d+\t[^\n]*\n?)*)", 1)
        rows = F.regexp_extract_all(block, F.lit(r"(?m)^(\d+\t\d+)"), 1)
        histogram = F.transform(rows, lambda r: F.struct(F.split_part(r, F.lit("\t"), F.lit(1)).cast("long").alias("length"), F.split_part(r, F.lit("\t"), F.lit(2)).cast("long").alias("count")))
        return F.struct(
            number(s, r"Total reads processed:\s*([\d,]+)").alias("total_reads"),
            number(s, r"Reads with adapters:\s*([\d,]+)").alias("reads_with_adapters"),
            number(s, r"Reads with adapters:\s*[\d,]+\s*\(([\d.]+)%\)", kind="double").alias("pct_with_adapters"),
            number(s, r"Total basepairs processed:\s*([\d,]+)").alias("total_bp"),
            number(s, r"Quality-trimmed:\s*([\d,]+)").alias("quality_trimmed_bp"),
            number(s, r"Total written \(filtered\):\s*([\d,]+)").alias("written_bp"),
            histogram.alias("adapter_position_histogram"),
        )

    return F.transform(sections, section)


def pairs_removed(text: Column) -> Column:
    """struct(pairs_removed, pct_pairs_removed)."""
    line = r"Number of sequence pairs removed[^:\n]*:\s*([\d,]+)"
    return F.struct(number(text, line).alias("pairs_removed"), number(text, line + r"\s*\(([\d.]+)%\)", 2, "double").alias("pct_pairs_removed"))


def aligner(text: Column) -> Column:
    """struct of version, index path, reads processed over all batches, and the first batch's FR insert sizes."""
    batches = F.regexp_extract_all(text, F.lit(r"Processed (\d+) reads"), 1)
    reads = F.when(F.size(batches) > 0, F.aggregate(batches, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")))
    front = r"(?s)orientation FR\.\.\..*?"
    return F.struct(
        word(text, r"Version:\s*(\S+)").alias("bwa_version"),
        word(text, r"CMD:[^\n]*?mem\s[^\n]*?(\S+\.fa(?:sta)?)").alias("reference_index_path"),
        reads.alias("reads_processed"),
        number(text, front + r"percentile: \((\d+), \d+, \d+\)").alias("insert_size_p25"),
        number(text, front + r"percentile: \(\d+, (\d+), \d+\)").alias("insert_size_median"),
        number(text, front + r"percentile: \(\d+, \d+, (\d+)\)").alias("insert_size_p75"),
        number(text, front + r"mean and std\.dev: \(([\d.]+), [\d.]+\)", kind="double").alias("insert_size_mean"),
        number(text, front + r"mean and std\.dev: \([\d.]+, ([\d.]+)\)", kind="double").alias("insert_size_stddev"),
    )


def flagstat(text: Column) -> Column:
    """struct of the counters in a flagstat report."""
    count = lambda tail: number(text, r"(?m)^(\d+) \+ \d+ " + tail)
    share = lambda tail: number(text, r"(?m)^\d+ \+ \d+ " + tail + r" \(([\d.]+)%", kind="double")
    return F.struct(
        count("in total").alias("total"), count("secondary").alias("secondary"), count("supplementary").alias("supplementary"), count("duplicates").alias("duplicates"),
        count("mapped").alias("mapped"), share("mapped").alias("mapped_pct"), count("paired in sequencing").alias("paired"), count("properly paired").alias("properly_paired"),
        share("properly paired").alias("properly_paired_pct"), count("singletons").alias("singletons"), share("singletons").alias("singletons_pct"),
    )


def parse(logs: DataFrame, text: str = "value") -> DataFrame:
    """Adds the structs demux, trimming (r1, r2 and pairs) and alignment of whole logs."""
    t = F.col(text)
    sections = trimming(t)
    trim = F.struct(F.try_element_at(sections, F.lit(1)).alias("r1"), F.try_element_at(sections, F.lit(2)).alias("r2"), pairs_removed(t)["pairs_removed"].alias("pairs_removed"), pairs_removed(t)["pct_pairs_removed"].alias("pct_pairs_removed"))
    return logs.withColumns({"demux": demux(t), "trimming": trim, "alignment": aligner(t)})


def assignment_stats(text: Column) -> Column:
    return F.struct(number(text, r"(?i)total reads[^:\n]*:\s*([\d,]+)").alias("total_reads"), number(text, r"(?i)assigned reads[^:\n]*:\s*([\d,]+)").alias("assigned_reads"), number(text, r"(?i)assignment rate[^:\n]*:\s*([\d.]+)", kind="double").alias("assignment_rate"))


def discover(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of the job with most of them (ties: the least job), with task numbers, for names like PREFIX_JOB_TASK.out."""
    parts = files.withColumns({"job": number(F.col(path), r"_(\d+)_\d+\.(?:out|err|log)$"), "task": number(F.col(path), r"_\d+_(\d+)\.(?:out|err|log)$")}).where("job is not null")
    best = parts.groupBy("job").agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), "job")).alias("b")).select(F.col("b.job").alias("job"))
    return parts.join(F.broadcast(best), "job").orderBy("task")


def rate(part: Column, whole: Column, scale: float = 1.0, digits: int = 6) -> Column:
    """scale * sum(part) / sum(whole), 0 if there is nothing, rounded half to even."""
    return F.bround(F.coalesce(F.try_divide(F.lit(scale) * F.sum(part).cast("double"), F.sum(whole)), F.lit(0.0)), digits)


def summarise(chunks: DataFrame) -> DataFrame:
    """One row over chunk statistics: sums, weighted rates, plain means of what a chunk has, and the first chunk's constants."""
    c = F.col
    first = lambda x: F.min_by(x, "chunk_id")
    sides = []
    for r in ("r1", "r2"):
        t, w = c(f"trimming.{r}.total_reads"), c(f"trimming.{r}.reads_with_adapters")
        sides += [F.coalesce(F.sum(t), F.lit(0)).alias(f"{r}_total_reads"), F.coalesce(F.sum(w), F.lit(0)).alias(f"{r}_reads_with_adapters"), rate(w, t, 100.0, 2).alias(f"{r}_pct_with_adapters")]
    return chunks.agg(
        F.count("*").alias("chunks"), first(c("sample_name")).alias("sample_name"), first(c("reference_genome")).alias("reference_genome"), first(c("alignment.bwa_version")).alias("bwa_version"),
        F.coalesce(F.sum("demux.total_reads"), F.lit(0)).alias("total_reads"), F.coalesce(F.sum("demux.mapped_reads"), F.lit(0)).alias("mapped_reads"), rate(c("demux.mapped_reads"), c("demux.total_reads")).alias("barcode_mapping_rate"),
        *sides,
        F.coalesce(F.sum("trimming.pairs_removed"), F.lit(0)).alias("pairs_removed"), rate(c("trimming.pairs_removed"), c("trimming.r1.total_reads"), 100.0, 2).alias("pct_pairs_removed"),
        F.coalesce(F.sum("alignment.reads_processed"), F.lit(0)).alias("reads_processed"), F.avg("alignment.insert_size_mean").alias("insert_size_mean"), F.avg("alignment.insert_size_median").alias("insert_size_median"),
    )


def merge_histograms(chunks: DataFrame, side: str = "r1") -> DataFrame:
    """(length, count) summed over chunks."""
    return chunks.select(F.explode(f"trimming.{side}.adapter_position_histogram").alias("h")).groupBy("h.length").agg(F.sum("h.count").alias("count"))
