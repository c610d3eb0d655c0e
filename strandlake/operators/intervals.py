"""Half-open intervals: merging, overlap joins, subtraction, enrichment, feature shares, scatter and contig order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reads import MATE_UNMAPPED, PAIRED, SECONDARY, SUPPLEMENTARY, UNMAPPED, lacks


def from_one_based(df: DataFrame, start: str = "start") -> DataFrame:
    """1-based inclusive coordinates as 0-based half-open ones."""
    return df.withColumn(start, F.col(start) - 1)


def merge(df: DataFrame, by: tuple[str, ...] = ("chrom",), start: str = "pos0", end: str = "pos1") -> DataFrame:
    """Disjoint union of intervals in each group; touching ones join."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = df.select(*by, start, end).withColumn("opens", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("island", island)
    return marked.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, width: int = 16384) -> DataFrame:
    """All pairs of overlapping intervals (chrom, pos0, pos1); the right one's become pos0_r, pos1_r.

    Both sides are dealt into bins and a pair is kept in the first bin they share, so the range join is an equi-join and no pair comes twice.
    """
    a = left.withColumn("bin", F.explode(bins(F.col("pos0"), F.col("pos1"), width)))
    r = right.withColumnsRenamed({"pos0": "pos0_r", "pos1": "pos1_r"})
    r = r.withColumn("bin", F.explode(bins(F.col("pos0_r"), F.col("pos1_r"), width)))
    first = F.floor(F.greatest("pos0", "pos0_r") / width)
    return a.join(r, ["chrom", "bin"]).where((F.col("pos0") < F.col("pos1_r")) & (F.col("pos1") > F.col("pos0_r")) & (F.col("bin") == first)).drop("bin")


def overlap_totals(left: DataFrame, right: DataFrame, by: str, width: int = 16384) -> DataFrame:
    """(by, n, bp): for each group of right intervals the pairs that overlap_join would give and the bases they share, without making the pairs.

    An interval from s to e overlaps as many left ones as begin before e less those that end by s; the bases they share are those that left intervals have before
    e less those before s. Ends are summed up by place, and running sums in bins start from the sums of the bins before. Groups without a pair are not listed.
    """
    ends = lambda df: df.where("pos0 <= pos1").select(*df.columns, F.explode(F.array(F.struct(F.col("pos0").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("pos1").alias("at"), F.lit(0).alias("opens")))).alias("p"))
    none = F.lit(0).cast("long")
    # At one place left ends come first, then what is asked, then left starts.
    place = ends(left.select("chrom", "pos0", "pos1")).groupBy("chrom", "p.at", F.when(F.col("p.opens") == 1, 2).otherwise(0).alias("kind")).agg(F.count("*").alias("m"))
    begun, ended = (F.when(F.col("kind") == k, F.col("m")).otherwise(0) for k in (2, 0))
    place = place.select("chrom", F.col("at").cast("long").alias("at"), "kind", begun.alias("begun"), ended.alias("ended"), F.lit(None).cast(right.schema[by].dataType).alias("g"), none.alias("opens"), none.alias("closes"))
    asked = ends(right.select("chrom", "pos0", "pos1", by)).groupBy("chrom", "p.at", by).agg(F.count_if(F.col("p.opens") == 1).alias("opens"), F.count_if(F.col("p.opens") == 0).alias("closes"))
    asked = asked.select("chrom", F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), none.alias("begun"), none.alias("ended"), F.col(by).alias("g"), "opens", "closes")
    rows = place.unionByName(asked).where("chrom is not null").withColumn("bin", F.floor(F.col("at") / width)).withColumn("bases", (F.col("ended") - F.col("begun")) * F.col("at"))
    sums = ("begun", "ended", "bases")
    earlier = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("chrom", "bin").agg(*[F.sum(c).alias(c) for c in sums]).select("chrom", "bin", *[F.coalesce(F.sum(c).over(earlier), none).alias(f"{c}_0") for c in sums])
    w = Window.partitionBy("chrom", "bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select("chrom", "bin", "at", "kind", "g", "opens", "closes", *[F.sum(c).over(w).alias(c) for c in sums]).where("kind = 1").join(whole, ["chrom", "bin"])
    begun, ended, bases = (F.col(c) + F.col(f"{c}_0") for c in sums)
    before = F.col("at") * (begun - ended) + bases
    n, bp = F.sum(F.col("closes") * begun - F.col("opens") * ended), F.sum((F.col("closes") - F.col("opens")) * before)
    return run.groupBy(F.col("g").alias(by)).agg(n.alias("n"), bp.alias("bp")).where("n > 0")


def overlapping(left: DataFrame, right: DataFrame, width: int = 16384, how: str = "left_semi") -> DataFrame:
    """Left intervals that overlap any right one, each once (how=left_anti: none).

    Left rows aren't copied: each looks in the bin of its start only, and right intervals stand in every bin from which an interval of
    the left side's greatest length could reach them. That length is one aggregate over two columns.
    """
    longest = left.agg(F.coalesce(F.max(F.col("pos1") - F.col("pos0")), F.lit(1)).alias("longest"))
    r = right.select("chrom", F.col("pos0").alias("pos0_r"), F.col("pos1").alias("pos1_r")).crossJoin(F.broadcast(longest))
    r = r.withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos0_r") - F.col("longest")) / width), F.floor((F.col("pos1_r") - 1) / width)))).drop("longest").withColumnRenamed("chrom", "chrom_r")
    a = left.withColumn("__bin", F.floor(F.col("pos0") / width))
    on = (F.col("chrom") == F.col("chrom_r")) & (F.col("__bin") == F.col("bin")) & (F.col("pos0") < F.col("pos1_r")) & (F.col("pos1") > F.col("pos0_r"))
    return a.join(r, on, how).drop("__bin")


def touching(left: DataFrame, sets: dict[str, DataFrame], least: int = 10) -> DataFrame:
    """Adds a boolean for each named set of disjoint intervals: whether the left interval overlaps one. Left rows are neither copied nor grouped.

    A left interval looks in one bin, that of its start among bins of the next power of two above its length (2^least at least); so it reaches into the next bin
    at most, whatever the longest one is. The sets' intervals are listed in the bins of each of these widths that occurs, of which there are a few dozen at most; one
    join answers for all sets, and a list holds no more disjoint intervals than two bins have bases.
    """
    level = F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(F.col("pos1") - F.col("pos0"), F.lit(1)).cast("double")))).cast("int")
    levels = left.agg(F.collect_set(level).alias("l")).scalar()
    rows = None
    for name, df in sets.items():
        own = df.select("chrom", F.struct("pos0", "pos1").alias("span"), F.lit(name).alias("name"))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.select("chrom", "span", "name", F.explode(levels).alias("level")).withColumn("width", F.expr("shiftleft(1L, level)"))
    reach = F.explode(F.sequence(F.floor(F.col("span.pos0") / F.col("width")) - 1, F.floor((F.col("span.pos1") - 1) / F.col("width"))))
    lists = rows.select("chrom", "level", reach.alias("bin"), "span", "name").groupBy("chrom", "level", "bin").agg(*[F.collect_list(F.when(F.col("name") == n, F.col("span"))).alias(f"__{n}") for n in sets])
    lists = lists.withColumnsRenamed({"chrom": "__chrom", "level": "__level", "bin": "__bin"})
    own = left.withColumn("__own", level).withColumn("__at", F.floor(F.col("pos0") / F.expr("shiftleft(1L, __own)")))
    joined = own.join(lists, (F.col("chrom") == F.col("__chrom")) & (F.col("__own") == F.col("__level")) & (F.col("__at") == F.col("__bin")), "left")
    hit = lambda n: F.coalesce(F.exists(f"__{n}", lambda x: (F.col("pos0") < x["pos1"]) & (F.col("pos1") > x["pos0"])), F.lit(False)).alias(n)
    return joined.select(*left.columns, *[hit(n) for n in sets])


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Parts of the left union that the right union doesn't cover, by a sweep over all end points."""
    def points(df: DataFrame, side: str) -> DataFrame:
        at = F.explode(F.array(F.struct(F.col("pos0").alias("at"), F.lit(1).alias("step")), F.struct(F.col("pos1").alias("at"), F.lit(-1).alias("step")))).alias("p")
        return df.select("chrom", at).select("chrom", "p.at", F.when(F.lit(side == "l"), F.col("p.step")).otherwise(0).alias("l"), F.when(F.lit(side == "r"), F.col("p.step")).otherwise(0).alias("r"))

    sums = points(left, "l").unionAll(points(right, "r")).groupBy("chrom", "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = Window.partitionBy("chrom").orderBy("at")
    covered = sums.select("chrom", F.col("at").alias("pos0"), F.lead("at").over(w).alias("pos1"), F.sum("l").over(w).alias("l"), F.sum("r").over(w).alias("r"))
    return merge(covered.where((F.col("l") > 0) & (F.col("r") == 0) & F.col("pos1").isNotNull()))


def total_length(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col("pos1") - F.col("pos0")), F.lit(0)).alias("bp"))


def exonic_enrichment(reads: DataFrame, exons: DataFrame, genome_bp: int, by: str = "cell") -> DataFrame:
    """Per cell: reads, reads that touch an exon, and the share of these minus the exons' share of the genome. No reads: share 0."""
    merged = merge(exons)
    share = total_length(merged).select((F.col("bp") / F.lit(float(genome_bp))).alias("exon_share"))
    counts = touching(reads.select(by, "chrom", "pos0", "pos1"), {"exonic": merged}).groupBy(by).agg(F.count("*").alias("total_reads"), F.count_if("exonic").alias("exonic_reads"))
    fraction = F.coalesce(F.try_divide(F.col("exonic_reads").cast("double"), F.col("total_reads")), F.lit(0.0))
    return counts.crossJoin(share).select(by, "total_reads", "exonic_reads", (fraction - F.col("exon_share")).alias("enrichment"))


def feature_distribution(reads: DataFrame, exons: DataFrame, genes: DataFrame) -> DataFrame:
    """Reads that touch exons, introns (genes without exons) and neither gene nor intron, with percentages of all reads.

    A read at a border counts as exonic and intronic; intergenic is what touches no gene.
    """
    flagged = touching(reads.select("chrom", "pos0", "pos1"), {"exonic": merge(exons), "intronic": subtract(genes, exons), "genic": merge(genes)})
    row = flagged.agg(F.count("*").alias("total"), F.count_if("exonic").alias("exonic"), F.count_if("intronic").alias("intronic"), F.count_if(~F.col("genic")).alias("intergenic"))
    pct = lambda c: F.round(100 * F.try_divide(F.col(c).cast("double"), F.col("total")), 2).alias(f"{c}_pct")
    return row.select("*", pct("exonic"), pct("intronic"), pct("intergenic"))


def compare_distributions(sets: dict[str, DataFrame], exons: DataFrame, genes: DataFrame) -> DataFrame:
    """(source, feature, reads, pct) of several sets of reads (DNA, RNA) for exonic, intronic and intergenic, each from its own counts."""
    out = None
    for name, df in sets.items():
        row = feature_distribution(df, exons, genes)
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("reads"), F.col(f"{f}_pct").alias("pct")) for f in ("exonic", "intronic", "intergenic")]))
        own = row.select(F.lit(name).alias("source"), each.alias("x")).select("source", "x.*")
        out = own if out is None else out.unionByName(own)
    return out


def genes_from_transcripts(df: DataFrame) -> DataFrame:
    """Gene extents: least start and greatest end of their transcripts."""
    return df.groupBy("chrom", "gene_id").agg(F.min("pos0").alias("pos0"), F.max("pos1").alias("pos1"))


def fragments(reads: DataFrame, both_ends: bool = True, chimeric: bool = False) -> DataFrame:
    """Reads that count for genes: mapped and primary (several reported places are no obstacle), of paired reads only those whose mate is mapped
    and, unless asked, lies on the same contig."""
    single = lacks("flag", PAIRED)
    keep = lacks("flag", UNMAPPED | SECONDARY | SUPPLEMENTARY)
    if both_ends:
        keep = keep & (single | lacks("flag", MATE_UNMAPPED))
    if not chimeric:
        keep = keep & (single | F.coalesce((F.col("mate_chrom") == "=") | (F.col("mate_chrom") == F.col("chrom")), F.lit(False)))
    return reads.where(keep)


def gene_counts(reads: DataFrame, exons: DataFrame, least: float = 0.5) -> DataFrame:
    """(gene, cell, n): fragments (records of one qname that `fragments` keeps) with at least `least` of their bases in the exons of exactly one gene.

    Records are neither copied nor made into a row for each gene: a record looks in one bin, that of its start among bins of the next power of two above its length, for
    a list of the exons that it could reach. A fragment of one record is decided there; only the others' bases are summed up by gene.
    """
    kept = fragments(reads).select("cell", "qname", "chrom", "pos0", "pos1").where("cell is not null and qname is not null")
    size = F.col("pos1") - F.col("pos0")
    level = F.greatest(F.lit(7), F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double")))).cast("int")
    levels = kept.agg(F.collect_set(level).alias("l")).scalar()
    e = merge(exons, ("chrom", "gene")).where("gene is not null").select("chrom", F.struct("gene", "pos0", "pos1").alias("e"), F.explode(levels).alias("level")).withColumn("width", F.expr("shiftleft(1L, level)"))
    reach = F.explode(F.sequence(F.floor(F.col("e.pos0") / F.col("width")) - 1, F.floor((F.col("e.pos1") - 1) / F.col("width"))))
    lists = e.select("chrom", "level", reach.alias("bin"), "e").groupBy("chrom", "level", "bin").agg(F.sort_array(F.collect_list("e")).alias("exons"))
    w = Window.partitionBy("cell", "qname")
    rows = kept.select("*", F.count("*").over(w).alias("records"), F.sum(size).over(w).alias("length"), level.alias("level"))
    rows = rows.withColumn("bin", F.floor(F.col("pos0") / F.expr("shiftleft(1L, level)"))).join(lists, ["chrom", "level", "bin"])
    near = F.filter("exons", lambda x: (x["pos0"] < F.col("pos1")) & (x["pos1"] > F.col("pos0")))
    shared = lambda x: F.least(F.col("pos1"), x["pos1"]) - F.greatest(F.col("pos0"), x["pos0"])
    rows = rows.select("cell", "qname", "records", "length", F.transform(near, lambda x: F.struct(x["gene"].alias("gene"), shared(x).cast("long").alias("bp"))).alias("hits"))
    # A gene's exons stand together and don't overlap, so its bases are a sum over neighbours of the list.
    none = F.array().cast("array<struct<gene:string,bp:bigint>>") if exons.schema["gene"].dataType.simpleString() == "string" else F.slice("hits", F.lit(1), F.lit(0))
    add = lambda s, x: F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["gene"] == x["gene"]), F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(x["gene"].alias("gene"), (F.try_element_at(s, F.lit(-1))["bp"] + x["bp"]).alias("bp"))))).otherwise(F.concat(s, F.array(x)))
    rows = rows.withColumn("genes", F.when(F.size("hits") > 1, F.aggregate("hits", none, add)).otherwise(F.col("hits")))
    enough = F.filter("genes", lambda x: x["bp"] >= least * F.col("length"))
    open_ = F.when(F.col("records") > 1, F.col("genes")).when(F.size(enough) == 1, enough)
    sums = rows.select("cell", "qname", "length", F.explode(open_).alias("x")).groupBy("cell", "qname", "x.gene").agg(F.sum("x.bp").alias("bp"), F.max("length").alias("length"))
    single = sums.where(F.col("bp") >= least * F.col("length")).groupBy("cell", "qname").agg(F.min("gene").alias("gene"), F.max("gene").alias("other")).where("gene = other")
    return single.groupBy("gene", "cell").agg(F.count("*").alias("n"))


def balanced_scatter(df: DataFrame, shards: int) -> DataFrame:
    """Adds shard 0 to shards - 1 by the running length before each interval; intervals stay whole.

    The running length of each contig is taken by itself and starts from the sum of the contigs before, of which there is one row each.
    """
    length = F.col("pos1") - F.col("pos0")
    contigs = df.groupBy(F.col("chrom").alias("__chrom")).agg(F.sum(length).alias("__length"))
    before = F.coalesce(F.sum("__length").over(Window.orderBy("__chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    contigs = contigs.select("__chrom", before.alias("__before"), F.sum("__length").over(Window.partitionBy()).alias("__total"))
    w = Window.partitionBy("chrom").orderBy("pos0", "pos1").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(length).over(w), F.lit(0)) + F.col("__before")
    joined = df.join(contigs, F.col("chrom").eqNullSafe(F.col("__chrom")))
    return joined.withColumn("shard", F.floor(running * shards / F.col("__total")).cast("long")).select(*df.columns, "shard")


def rename_contigs(df: DataFrame, names: dict[str, str] | None = None, strip: str | None = None, column: str = "chrom") -> DataFrame:
    """Contig names by a table (accessions to numerals, say), after a suffix from `strip` on is cut off; names that the table lacks stay."""
    name = F.split_part(F.col(column), F.lit(strip), F.lit(1)) if strip else F.col(column)
    if names:
        known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        name = F.coalesce(F.try_element_at(known, name), name)
    return df.withColumn(column, name)


def contig_rank(chrom: str = "chrom") -> Column:
    """1 to 22 by number, X 23, Y 24, M 25, all others 99."""
    name = F.regexp_replace(F.split_part(F.col(chrom), F.lit("_"), F.lit(1)), "^chr", "")
    number = F.expr(f"try_cast(regexp_replace(split_part({chrom}, '_', 1), '^chr', '') as int)")
    return F.coalesce(F.when(number.between(1, 22), number), F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25), F.lit(99)).cast("long")


def genome_offsets(contigs: DataFrame, gap: int = 0) -> DataFrame:
    """Adds rank and the offset of each contig in natural order, with `gap` between contigs."""
    w = Window.orderBy("rank", "chrom")
    ranked = contigs.withColumn("rank", contig_rank())
    return ranked.withColumn("offset", F.coalesce(F.sum(F.col("length") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
