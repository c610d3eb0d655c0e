"""Readers of the domain's text formats; every one has an explicit schema."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import SPLIT
from .compressed import text_lines

ALIGNMENT_COLUMNS = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM file: eleven columns, tags cb, bc, rg (null if absent) and all tags as a map."""
    return parse_sam(_lines(spark, path).where(~F.col("value").startswith("@")))


def parse_sam(lines: DataFrame) -> DataFrame:
    # Split once, behind a test in the generator; a line with tabs only needs no expression.
    others = reduce(or_, [F.col("value").contains(x) for x in (" ", "\n", "\x0b", "\f", "\r", "\t\t")])
    f = F.when(others, F.split("value", r"\s+")).otherwise(F.split("value", "\t"))
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "mate_pos": "long", "tlen": "long"}
    columns = [F.element_at("f", i + 1).cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(ALIGNMENT_COLUMNS)]
    pairs = F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 30).alias("value")))
    whole = F.explode(F.filter(F.array(f), lambda x: F.size(x) >= 11)).alias("f")
    rows = lines.select(whole).select(*columns, F.map_from_entries(pairs).alias("tags"))
    return rows.withColumns({t.lower(): F.try_element_at("tags", F.lit(t)) for t in ("CB", "BC", "RG")}).withColumn("pos0", F.col("pos") - 1)


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """One row: the first contig of @SQ and the command line of the last @PG, null if absent."""
    rows = _lines(spark, path).where(F.col("value").startswith("@"))
    found = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return rows.agg(F.first(found(r"^@SQ\t.*?SN:(\S+)"), ignorenulls=True).alias("first_contig"), F.last(found(r"^@PG\t.*?CL:([^\t]+)"), ignorenulls=True).alias("command"))


def tag_from_comment(comment: Column, tag: str = "CB") -> Column:
    return F.nullif(F.regexp_extract(comment, rf"{tag}:Z:(\S+)", 1), F.lit(""))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features with 0-based half-open coordinates; comments and short lines are skipped."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 9)
    attr = lambda k: F.nullif(F.regexp_extract(F.element_at("f", 9), rf'{k} "([^"]+)"', 1), F.lit(""))
    at = lambda i: F.element_at("f", i)
    return rows.select(at(1).alias("chrom"), at(3).alias("feature"), (at(4).cast("long") - 1).alias("pos0"), at(5).cast("long").alias("pos1"), at(7).alias("strand"), attr("gene_id").alias("gene_id"), attr("gene_name").alias("gene_name"))


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) of a FASTA index or a chrom.sizes file."""
    f = F.split("value", r"\s+")
    return _lines(spark, path).where(F.trim("value") != "").select(F.element_at(f, 1).alias("chrom"), F.element_at(f, 2).cast("long").alias("length"))


def interval_list(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos0, pos1) of a 1-based inclusive interval list; header lines are dropped."""
    f = F.split("value", "\t")
    return _lines(spark, path).where(~F.col("value").startswith("@") & (F.trim("value") != "")).select(F.element_at(f, 1).alias("chrom"), (F.element_at(f, 2).cast("long") - 1).alias("pos0"), F.element_at(f, 3).cast("long").alias("pos1"))


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", r"\s+")
    rows = _lines(spark, path).where(~F.col("value").rlike("^(track|browser|#)") & (F.trim("value") != ""))
    return rows.select(F.element_at(f, 1).alias("chrom"), F.element_at(f, 2).cast("long").alias("pos0"), F.element_at(f, 3).cast("long").alias("pos1"), F.element_at(f, 4).cast("double").alias("value"))


def vcf(spark: SparkSession, path: str | list[str], split: int | None = None) -> DataFrame:
    """Calls in long form: (sample, chrom, pos, ref, alt, dp, ad array); '.' is null.

    Sample names come from the #CHROM line of the same file, so a folder may hold files of different samples. A list of files is read in parts of `split`
    bytes where they are block-compressed or plain.
    """
    if isinstance(path, list):
        rows = text_lines(spark, path, split or SPLIT).select("value", F.col("path").alias("file")).where(F.trim("value") != "")
    else:
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    names = rows.where(F.col("value").startswith("#CHROM")).select(F.col("file").alias("file2"), F.slice(F.split("value", "\t"), F.lit(10), F.lit(1 << 30)).alias("names")).dropDuplicates(["file2"])
    f = rows.where(~F.col("value").startswith("#")).select("file", F.split("value", "\t").alias("f")).join(names, F.col("file") == F.col("file2"))
    cells = f.select("f", F.posexplode("names").alias("k", "sample"))
    keys = F.split(F.element_at("f", 9), ":")
    value = F.split(F.element_at("f", F.col("k") + 10), ":")
    pick = lambda k: F.try_element_at(value, F.nullif(F.array_position(keys, k), F.lit(0)).cast("int"))
    ad = F.when(pick("AD") != ".", F.transform(F.split(pick("AD"), ","), lambda x: x.try_cast("long")))
    return cells.select("sample", F.element_at("f", 1).alias("chrom"), F.element_at("f", 2).cast("long").alias("pos"), F.element_at("f", 4).alias("ref"), F.element_at("f", 5).alias("alt"), pick("DP").try_cast("long").alias("dp"), ad.alias("ad"))


def fasta_width(spark: SparkSession, path: str) -> int:
    """Bases of a full line, from the first sequence line."""
    return len(_lines(spark, path).where(~F.col("value").startswith(">") & (F.trim("value") != "")).first()[0].strip())


def fasta_windows(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, bin, bases): the lines of a FASTA file, each with one more base on either side (N beyond the contig), in upper case.

    A record is read as one row (the reader splits at '>'), so lines keep their order; bin counts them. All lines of a contig but the last have
    the width of fasta_width, as in an indexed file; others raise.
    """
    width = fasta_width(spark, path)
    records = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    body = records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), F.slice(lines, F.lit(2), F.lit(1 << 30)).alias("lines"))
    each = body.select("chrom", "lines", F.posexplode("lines").alias("k", "line"))
    before = F.when(F.col("k") > 0, F.right(F.try_element_at("lines", F.col("k")), F.lit(1))).otherwise("N")
    after = F.coalesce(F.left(F.try_element_at("lines", F.col("k") + 2), F.lit(1)), F.lit("N"))
    whole = F.when((F.length("line") == width) | (F.col("k") == F.size("lines") - 1), F.concat(before, "line", after)).otherwise(F.raise_error("lines of unequal width"))
    return each.select("chrom", F.col("k").cast("long").alias("bin"), whole.alias("bases"))


def whitelist(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(position, ord, seq) from one list file for each position; the order of lines counts."""
    parts = []
    for position, path in paths.items():
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda x: F.upper(F.trim(x))), lambda x: x != "")).alias("ord", "seq"))
        parts.append(whole.select(F.lit(position).alias("position"), "ord", "seq"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plate_map(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, seq) from a wide table with a blank first header cell and columns 1 to 12."""
    wide = spark.read.csv(path, header=True)
    first, *columns = wide.columns
    return wide.withColumnRenamed(first, "row").unpivot("row", columns, "col", "seq").select("row", F.col("col").cast("int").alias("col"), "seq").where("seq is not null")


def conditions(spark: SparkSession, path: str) -> DataFrame:
    """(condition, ord, spec) from a JSON object of lists; numbers count as text."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    each = body.select(F.posexplode(F.map_entries("m")).alias("i", "e")).select("i", F.col("e.key").alias("condition"), F.posexplode("e.value").alias("j", "spec"))
    return each.select("condition", (F.col("i") * 1000 + F.col("j")).alias("ord"), "spec")


def names(spark: SparkSession, path: str) -> DataFrame:
    """Stripped, not blank lines of a list file."""
    return _lines(spark, path).select(F.trim("value").alias("barcode")).where("barcode <> ''")


def counts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(barcode, read_count) of a CSV file; lines with fewer fields or another type are skipped, or raise if strict."""
    return spark.read.csv(path, header=True, schema="barcode string, read_count long", mode="FAILFAST" if strict else "DROPMALFORMED")


def raw_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV file with its header and all columns as text; None where it is missing."""
    found = first_existing(spark, [path])
    return spark.read.csv(found, header=True, inferSchema=False) if found else None


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, schema=schema, mode="FAILFAST", nullValue="")


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, cell, n) from a gene count table with a comment line, six metadata columns and one column for each cell."""
    wide = spark.read.csv(path, header=True, sep="\t", comment="#")
    cells = wide.columns[6:]
    return wide.unpivot(wide.columns[0], cells, "cell", "n").select(F.col(wide.columns[0]).alias("gene_id"), "cell", F.col("n").cast("long").alias("n"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


CHUNK = (
    "chunk_id string, sample_name string, reference_genome string, demux struct<total_reads: bigint, mapped_reads: bigint, barcode_mapping_rate: double>, "
    "trimming struct<r1: struct<total_reads: bigint, reads_with_adapters: bigint, adapter_position_histogram: array<struct<length: bigint, count: bigint>>>, "
    "r2: struct<total_reads: bigint, reads_with_adapters: bigint, adapter_position_histogram: array<struct<length: bigint, count: bigint>>>, pairs_removed: bigint, pct_pairs_removed: double>, "
    "alignment struct<bwa_version: string, reference_index_path: string, reads_processed: bigint, insert_size_median: bigint, insert_size_mean: double, insert_size_stddev: double>"
)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path, multiLine=True)


def settings(defaults: dict, text: str = "", given: dict | None = None) -> dict:
    """Defaults, then 'section:' / '  key: value' lines as section_key, then given values."""
    out, section = dict(defaults), ""
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        key, _, value = body.strip().partition(":")
        value = value.strip().strip("\"'")
        if not value:
            section = key
        else:
            out[f"{section}_{key}" if body[0].isspace() and section else key] = value
    return out | {k: v for k, v in (given or {}).items() if v is not None}


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of some paths or globs that exists in whatever store it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for c in candidates:
        path = hadoop.Path(c)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            return found[0].getPath().toString()
    return None


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob finds in whatever store it names, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(x.getPath().toString() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def sample_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, r1, r2): the first pair of read files of each sample, named {sample}_S1_L001_R1_001.fastq.gz; r2 is null where it is missing."""
    schema = "sample string, r1 string, r2 string"
    found, second = listed(spark, f"{folder}/*_S*_L*_R1_001.fastq.gz"), set(listed(spark, f"{folder}/*_S*_L*_R2_001.fastq.gz"))
    files = spark.createDataFrame([(x, y if (y := x.replace("_R1_001.", "_R2_001.")) in second else None) for x in found], "r1 string, r2 string")
    sample = F.regexp_extract("r1", r"([^/]+?)_S\d+_L\d+_R1_001\.fastq\.gz$", 1)
    return files.groupBy(sample.alias("sample")).agg(F.min(F.struct("r1", "r2")).alias("f")).select("sample", "f.r1", "f.r2").to(spark.createDataFrame([], schema).schema)


def preferred(spark: SparkSession, folder: str, sample: str) -> str | None:
    """A sample's raw variant file, else its normalised one."""
    return first_existing(spark, [f"{folder}/{sample}.g.vcf.gz", f"{folder}/{sample}.vcf.gz", f"{folder}/{sample}.norm.vcf.gz", f"{folder}/{sample}*norm*.vcf.gz"])


def path_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds dataset (the folder of a file, or the one above where that is sc_outputs) and cell_id (the file's name up to its first dot)."""
    parts = F.split(path, "/")
    up = lambda k: F.try_element_at(parts, F.lit(-k))
    return files.withColumns({"dataset": F.when(up(2) == "sc_outputs", up(3)).otherwise(up(2)), "cell_id": F.split_part(up(1), F.lit("."), F.lit(1))})


def reference_candidates(root: str) -> list[str]:
    """Where a reference may stand under a root that is a file or a folder."""
    return [f"{root}" if root.endswith((".fa", ".fna", ".fasta")) else f"{root}/BWAIndex/genome.fa", f"{root}/genome.fa", f"{root}/*.fa", f"{root}/*.fna"]


def known_sites(spark: SparkSession, folder: str) -> list[str]:
    """The newest of the variant collections (146, 144, 138), then the two indel collections, as far as they exist."""
    groups = [[f"{folder}/*dbsnp_{v}*.vcf*" for v in (146, 144, 138)], [f"{folder}/*known_indels*.vcf*"], [f"{folder}/*Mills*.vcf*"]]
    return [p for g in groups if (p := first_existing(spark, g))]
