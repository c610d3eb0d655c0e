"""Alignment records: flag tests, counters, modality, subsampling, duplicates and insert sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, READ1, READ2 = 0x1, 0x2, 0x4, 0x8, 0x10, 0x40, 0x80
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800


def has(flag: Column | str, bits: int) -> Column:
    """All of the bits are set."""
    return F.col(flag).bitwiseAND(F.lit(bits)) == bits if isinstance(flag, str) else flag.bitwiseAND(F.lit(bits)) == bits


def lacks(flag: str, bits: int) -> Column:
    """None of the bits is set."""
    return F.col(flag).bitwiseAND(F.lit(bits)) == 0


def proper_pairs(df: DataFrame) -> DataFrame:
    return df.where(has("flag", PROPER))


def primary(df: DataFrame) -> DataFrame:
    """Neither secondary nor supplementary."""
    return df.where(lacks("flag", SECONDARY | SUPPLEMENTARY))


def mapped(df: DataFrame) -> DataFrame:
    return df.where(lacks("flag", UNMAPPED))


def mapped_primary(df: DataFrame) -> DataFrame:
    return df.where(lacks("flag", UNMAPPED | SECONDARY))


def flag_columns(df: DataFrame) -> DataFrame:
    """Boolean columns for ingest: unlike bit tests these can be pushed to a Parquet scan."""
    tests = {"is_proper": has("flag", PROPER), "is_primary": lacks("flag", SECONDARY | SUPPLEMENTARY), "is_mapped": lacks("flag", UNMAPPED), "is_duplicate": has("flag", DUPLICATE)}
    return df.withColumns(tests)


def flagstat(df: DataFrame) -> DataFrame:
    """One row of counters over all records; the paired counters look at primary records only."""
    first = lacks("flag", SECONDARY | SUPPLEMENTARY)
    paired = first & has("flag", PAIRED)
    is_mapped, mate_mapped = lacks("flag", UNMAPPED), lacks("flag", MATE_UNMAPPED)
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(is_mapped).alias("mapped"),
        F.count_if(has("flag", SECONDARY)).alias("secondary"),
        F.count_if(has("flag", SUPPLEMENTARY)).alias("supplementary"),
        F.count_if(has("flag", DUPLICATE)).alias("duplicates"),
        F.count_if(paired).alias("paired"),
        F.count_if(paired & has("flag", READ1)).alias("read1"),
        F.count_if(paired & has("flag", READ2)).alias("read2"),
        F.count_if(paired & has("flag", PROPER) & is_mapped).alias("properly_paired"),
        F.count_if(paired & is_mapped & ~mate_mapped).alias("singletons"),
    )
    pct = lambda part, whole: F.round(100 * F.try_divide(F.col(part).cast("double"), F.col(whole)), 2)
    return counts.withColumns({"mapped_pct": pct("mapped", "total"), "properly_paired_pct": pct("properly_paired", "paired"), "singletons_pct": pct("singletons", "paired")})


def read_counts(df: DataFrame, key: str = "cell") -> DataFrame:
    """(barcode, read_count); records without the tag are not counted."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("barcode")).agg(F.count("*").alias("read_count"))


def combine_modalities(dna: DataFrame, rna: DataFrame) -> DataFrame:
    """Full outer join of two (barcode, read_count) tables with 0 for the missing side, and their sum twice (as total and as count)."""
    joined = dna.withColumnRenamed("read_count", "dna_reads").join(rna.withColumnRenamed("read_count", "rna_reads"), "barcode", "full")
    d, r = F.coalesce("dna_reads", F.lit(0)), F.coalesce("rna_reads", F.lit(0))
    return joined.select("barcode", d.alias("dna_reads"), r.alias("rna_reads"), (d + r).alias("total_reads"), (d + r).alias("read_count"))


def soft_clipped(cigar: str = "cigar") -> Column:
    """Sum of the soft-clipped lengths."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)S"), 1), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def cigar_operations(cigar: str = "cigar") -> Column:
    """array<struct<length, op>>."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("length"), F.right(x, F.lit(1)).alias("op")))


def spliced(cigar: str = "cigar") -> Column:
    return F.col(cigar).contains("N")


def modality(df: DataFrame, two_pass: bool = False, least_mapq: int = 20, clip: int = 10, run: int = 10) -> DataFrame:
    """Adds modality dna or rna. By default a spliced CIGAR makes RNA.

    two_pass: a record is DNA at once with mapq >= least_mapq and fewer than `clip` clipped bases; of the others those spliced or with a run of
    `run` T or A are RNA, the rest DNA.
    """
    rna = spliced()
    if two_pass:
        candidate = ~((F.col("mapq") >= least_mapq) & (soft_clipped() < clip))
        rna = candidate & (spliced() | F.col("seq").rlike(f"T{{{run}}}|A{{{run}}}"))
    return df.withColumn("modality", F.when(rna, "rna").otherwise("dna"))


def sample_key(column: str = "qname", seed: int = 42, bits: int = 30) -> Column:
    """A number in [0, 2^bits) that all records of a template share."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << bits))


def subsample(df: DataFrame, fraction: float, column: str = "qname", seed: int = 42) -> DataFrame:
    """Keeps templates by hash: deterministic, mates stay together, and a smaller fraction is a subset of a larger one."""
    return df.where(sample_key(column, seed) < int(fraction * (1 << 30)))


def subsample_portable(df: DataFrame, fraction: float, key: str) -> DataFrame:
    """The same over an integer key with arithmetic that any SQL engine shares."""
    return df.where(F.pmod(F.col(key) * F.lit(2654435761), F.lit(4294967296)) < int(fraction * 4294967296))


def nested_sizes(df: DataFrame, fractions: list[float], key: str) -> DataFrame:
    """(fraction, n): records that each of some nested samples by an integer key keeps, counted in one pass."""
    level = F.pmod(F.col(key) * F.lit(2654435761), F.lit(4294967296))
    counts = df.agg(*[F.count_if(level < int(f * 4294967296)).alias(f"n{k}") for k, f in enumerate(fractions)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.col(f"n{k}").alias("n")) for k, f in enumerate(fractions)])).alias("r")).select("r.*")


def clipped(cigar: str = "cigar", end: bool = False) -> Column:
    """Clipped bases (soft and hard) at the start or the end of an alignment."""
    part = F.regexp_extract(cigar, r"[MIDNP=X]((?:\d+[SH])+)$" if end else r"^((?:\d+[SH])+)", 1)
    return F.aggregate(F.regexp_extract_all(part, F.lit(r"(\d+)"), 1), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def reference_length(cigar: str = "cigar") -> Column:
    """Bases of the reference that an alignment spans."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def five_prime(flag: str = "flag", pos: str = "pos0", cigar: str = "cigar") -> Column:
    """0-based place of a read's first base as sequenced, clipped bases included: before the start on the forward strand, behind the end on the reverse."""
    return F.when(has(flag, REVERSE), F.col(pos) + reference_length(cigar) + clipped(cigar, True) - 1).otherwise(F.col(pos) - clipped(cigar))


def examined(df: DataFrame) -> DataFrame:
    """Records that duplicate marking looks at: mapped and neither secondary nor supplementary."""
    return df.where(lacks("flag", UNMAPPED | SECONDARY | SUPPLEMENTARY))


def templates(df: DataFrame, score: str = "score") -> DataFrame:
    """(cell, qname, ends, n, score): each template's sorted unclipped 5' ends (contig, place, reverse) and the sum of its reads' scores."""
    end = F.struct(F.col("chrom"), five_prime().alias("five"), has("flag", REVERSE).alias("reverse"))
    return examined(df).groupBy("cell", "qname").agg(F.array_sort(F.collect_list(end)).alias("ends"), F.count("*").alias("n"), F.sum(score).alias("score"))


def duplicate_templates(df: DataFrame, score: str = "score") -> DataFrame:
    """(cell, qname, n, duplicate) for each examined template.

    Pairs with equal ends keep the one of greatest score (ties: least name). A single end that also is the end of a pair is a duplicate; of other equal single
    ends one stays. The best of a group comes from an aggregate, so that a pile of equal reads is never sorted in one task.
    """
    t = templates(df, score)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("qname").alias("kept"))).getField("kept").alias("kept")
    pairs, single = t.where("n > 1"), t.where("n = 1")
    kept = pairs.groupBy("cell", "ends").agg(best)
    marked = pairs.join(kept, ["cell", "ends"]).select("cell", "qname", "n", (F.col("qname") != F.col("kept")).alias("duplicate"))
    taken = pairs.select("cell", F.explode("ends").alias("end")).distinct().withColumn("paired", F.lit(True))
    alone = single.select("cell", "qname", "n", "score", F.col("ends")[0].alias("end"))
    kept = alone.groupBy("cell", "end").agg(best).join(taken, ["cell", "end"], "left")
    rest = alone.join(kept, ["cell", "end"]).select("cell", "qname", "n", (F.col("paired").isNotNull() | (F.col("qname") != F.col("kept"))).alias("duplicate"))
    return marked.unionAll(rest)


def mark_duplicates(df: DataFrame, score: str = "score") -> DataFrame:
    """Adds is_duplicate to every record (cell, qname, flag, chrom, pos0, cigar, score); unmapped, secondary and supplementary records are never marked."""
    found = duplicate_templates(df, score).where("duplicate").select("cell", "qname", F.lit(True).alias("__duplicate"))
    looked_at = lacks("flag", UNMAPPED | SECONDARY | SUPPLEMENTARY)
    return df.join(found, ["cell", "qname"], "left").withColumn("is_duplicate", F.coalesce(F.col("__duplicate") & looked_at, F.lit(False))).drop("__duplicate").select(*df.columns, "is_duplicate")


def library_size(pairs: Column, unique: Column) -> Column:
    """Distinct molecules X of a library with unique / X = 1 - exp(-pairs / X), by halving; null without a duplicate."""
    pairs, unique = pairs.cast("double"), unique.cast("double")
    step = lambda b, _: F.struct(
        F.when((unique / ((b["lo"] + b["hi"]) / 2)) > 1 - F.exp(-pairs / ((b["lo"] + b["hi"]) / 2)), (b["lo"] + b["hi"]) / 2).otherwise(b["lo"]).alias("lo"),
        F.when((unique / ((b["lo"] + b["hi"]) / 2)) > 1 - F.exp(-pairs / ((b["lo"] + b["hi"]) / 2)), b["hi"]).otherwise((b["lo"] + b["hi"]) / 2).alias("hi"),
    )
    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(unique.alias("lo"), (unique * 1e6).alias("hi")), step)
    return F.when((unique > 0) & (unique < pairs), F.floor((found["lo"] + found["hi"]) / 2))


def duplicate_metrics(df: DataFrame, score: str = "score") -> DataFrame:
    """Per cell: unpaired reads and pairs examined, unmapped, secondary or supplementary records, duplicates of either kind, their share and the library's size."""
    t = duplicate_templates(df, score).groupBy("cell").agg(
        F.count_if(F.col("n") == 1).alias("unpaired_reads_examined"), F.count_if(F.col("n") > 1).alias("read_pairs_examined"),
        F.count_if((F.col("n") == 1) & F.col("duplicate")).alias("unpaired_read_duplicates"), F.count_if((F.col("n") > 1) & F.col("duplicate")).alias("read_pair_duplicates"),
    )
    r = df.groupBy("cell").agg(F.count_if(has("flag", UNMAPPED)).alias("unmapped_reads"), F.count_if(~lacks("flag", SECONDARY | SUPPLEMENTARY)).alias("secondary_or_supplementary_reads"))
    names = ["unpaired_reads_examined", "read_pairs_examined", "unpaired_read_duplicates", "read_pair_duplicates"]
    out = r.join(t, "cell", "left").na.fill(0, names)
    share = F.try_divide((F.col("unpaired_read_duplicates") + 2 * F.col("read_pair_duplicates")).cast("double"), F.col("unpaired_reads_examined") + 2 * F.col("read_pairs_examined"))
    return out.withColumns({"pct_duplicates": F.coalesce(share, F.lit(0.0)), "estimated_library_size": library_size(F.col("read_pairs_examined"), F.col("read_pairs_examined") - F.col("read_pair_duplicates"))})


def alignment_metrics(df: DataFrame, good: int = 20) -> DataFrame:
    """Per cell and category (first_of_pair, second_of_pair, pair, unpaired): reads, those that passed the filter, aligned ones and their share,
    well aligned ones (mapq of `good`), mean read length, reads aligned in pairs, strand balance. Secondary and supplementary records don't count."""
    rows = primary(df).withColumn("kind", F.when(lacks("flag", PAIRED), F.array(F.lit("unpaired"))).otherwise(F.array(F.when(has("flag", READ1), "first_of_pair").otherwise("second_of_pair"), F.lit("pair"))))
    passed, is_mapped = lacks("flag", QC_FAIL), lacks("flag", UNMAPPED)
    aligned = passed & is_mapped
    in_pairs = aligned & has("flag", PAIRED) & lacks("flag", MATE_UNMAPPED)
    out = rows.select("cell", F.explode("kind").alias("category"), "flag", "mapq", "seq").groupBy("cell", "category").agg(
        F.count("*").alias("total_reads"), F.count_if(passed).alias("pf_reads"), F.count_if(aligned).alias("pf_reads_aligned"), F.count_if(aligned & (F.col("mapq") >= good)).alias("pf_hq_aligned_reads"),
        F.avg(F.when(passed, F.length("seq")).cast("double")).alias("mean_read_length"), F.count_if(in_pairs).alias("reads_aligned_in_pairs"), F.count_if(aligned & lacks("flag", REVERSE)).alias("__forward"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return out.withColumns({"pct_pf_reads_aligned": share("pf_reads_aligned", "pf_reads"), "pct_reads_aligned_in_pairs": share("reads_aligned_in_pairs", "pf_reads_aligned"), "strand_balance": share("__forward", "pf_reads_aligned")}).drop("__forward")


def limit_pairs(df: DataFrame, n: int) -> DataFrame:
    """The first n records of an input, for a trial run."""
    return df.limit(n)


def insert_stats(df: DataFrame, longest: int = 1000) -> DataFrame:
    """Per barcode over first reads: read count, distinct (5', 3') of proper pairs, mean insert below `longest`, records with an unmapped mate.

    Positions are 0-based; a barcode without a proper pair has mean 0.
    """
    first = df.where(has("flag", READ1))
    five, three = F.col("pos0") + 1, F.col("mate_pos") + F.col("tlen")
    loose, proper = has("flag", MATE_UNMAPPED), has("flag", PROPER)
    length = F.abs(three - five)
    return first.groupBy(F.col("cell").alias("barcode")).agg(
        F.count_if(proper).alias("read_count"),
        F.count_distinct(F.when(proper, F.struct(five, three))).alias("unique_read_count"),
        F.coalesce(F.avg(F.when(proper & (length < longest), length.cast("double"))), F.lit(0.0)).alias("average_insert_length"),
        F.count_if(loose).alias("unmapped_read_count"),
    )


def insert_pairs(df: DataFrame, longest: int = 1000) -> DataFrame:
    """(barcode, insert, n): the sparse matrix of barcodes by insert length in long form."""
    length = F.abs(F.col("tlen")).cast("long")
    return df.where(has("flag", PROPER | READ1) & (length < longest)).groupBy(F.col("cell").alias("barcode"), length.alias("insert")).agg(F.count("*").alias("n"))


def assignment_rate(counts: DataFrame, pairs: int) -> DataFrame:
    """Share of all reads (two for each pair) that have a barcode, in percent."""
    return counts.agg(F.sum("read_count").alias("assigned_reads")).withColumn("assignment_rate", F.round(100.0 * F.col("assigned_reads") / F.lit(2 * pairs), 2))


def with_read_group(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("rg", value)


def coordinate_sort(df: DataFrame) -> DataFrame:
    """Globally sorted by contig and position, for range-partitioned files."""
    return df.repartitionByRange("chrom", "pos0").sortWithinPartitions("chrom", "pos0")


def of_cells(df: DataFrame, cells: DataFrame, tag: str = "cell") -> DataFrame:
    """Records whose tag is one of the listed barcodes."""
    return df.join(cells.select(F.col("barcode").alias(tag)).distinct(), tag, "left_semi")


def matrix_sums(entries: DataFrame, by: str, value: str = "n") -> DataFrame:
    """(by, total, detected): sum and number of entries above 0 for each row or column of a sparse matrix in long form."""
    return entries.groupBy(by).agg(F.sum(value).alias("total"), F.count_if(F.col(value) > 0).alias("detected"))


def chunked(df: DataFrame, chunks: int, key: str = "qname") -> DataFrame:
    """Adds chunk 0 to chunks - 1 by the hash of the template, so that mates stay together. Rows stay where they are: a chunk may be larger than a task, and a sink parts its files by the column."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"))
