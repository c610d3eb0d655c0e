"""Binned coverage, Lorenz curves and Gini, depth metrics and saturation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import bins, genome_offsets, merge
from .reads import DUPLICATE, SECONDARY, SUPPLEMENTARY, UNMAPPED, lacks


def bin_spine(contigs: DataFrame, width: int = 1000) -> DataFrame:
    """All bins of (chrom, length); the last one of a contig is clipped."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(width).cast("long"))).alias("bin_start")
    return contigs.where("length > 0").select("chrom", "length", start).select("chrom", "bin_start", F.least(F.col("bin_start") + width, F.col("length")).alias("bin_end"))


def bin_counts(reads: DataFrame, width: int = 1000, by: str = "cell") -> DataFrame:
    """(by, chrom, bin_start, value): reads that touch each bin; bins without a read are not listed."""
    return reads.withColumn("bin", F.explode(bins(F.col("pos0"), F.col("pos1"), width))).groupBy(by, "chrom", (F.col("bin") * width).alias("bin_start")).agg(F.count("*").alias("value"))


def number_of_bins(contigs: DataFrame, width: int = 1000) -> int:
    """Bins of all contigs, one number."""
    return contigs.agg(F.coalesce(F.sum(F.ceil(F.col("length") / width)), F.lit(0)).cast("long")).first()[0]


def binned(reads: DataFrame, contigs: DataFrame, width: int = 1000, by: str = "cell") -> DataFrame:
    """(by, chrom, bin_start, bin_end, value): reads that touch each bin, 0 included, for every group that has a read. For an export; gini and lorenz
    take bin_counts and the number of bins."""
    groups = reads.select(by).distinct()
    return groups.crossJoin(bin_spine(contigs, width)).join(bin_counts(reads, width, by), [by, "chrom", "bin_start"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def _runs(values: DataFrame, by: str, value: str, n: int | None) -> DataFrame:
    """(by, value, m, at, before, following, total, n): runs of equal values of each group in ascending order, one row each: m values behind the `at` lesser ones, which
    sum up to `before`; following is the next run's value, null behind the last. n: number of values with the zeros that are not listed, which are a run of their own."""
    up, group = Window.partitionBy(by).orderBy(value), Window.partitionBy(by)
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    runs = values.groupBy(by, value).agg(F.count("*").alias("m"))
    listed, mass = F.sum("m").over(group), F.col(value) * F.col("m")
    zeros = F.lit(n) - listed if n is not None else F.lit(0)
    rows = runs.select(by, F.col(value).alias("value"), "m", (F.coalesce(F.sum("m").over(earlier), F.lit(0)) + zeros).cast("long").alias("at"), F.coalesce(F.sum(mass).over(earlier), F.lit(0)).alias("before"),
                       F.lead(value).over(up).alias("following"), F.sum(mass).over(group).alias("total"), (F.lit(n) if n is not None else listed).cast("long").alias("n"), (F.row_number().over(up) == 1).alias("first"), zeros.cast("long").alias("zeros"))
    if n is None:
        return rows.drop("first", "zeros")
    nothing = lambda c: F.lit(0).cast(rows.schema[c].dataType).alias(c)
    own = F.struct("value", "m", "at", "before", "following")
    unlisted = F.struct(nothing("value"), F.col("zeros").alias("m"), nothing("at"), nothing("before"), F.col("value").alias("following"))
    return rows.select(by, F.explode(F.when(F.col("first") & (F.col("zeros") > 0), F.array(unlisted, own)).otherwise(F.array(own))).alias("run"), "total", "n").select(by, "run.*", "total", "n")


def gini(values: DataFrame, by: str = "cell", value: str = "value", drop_zeros: bool = False, n: int | None = None) -> DataFrame:
    """Gini coefficient of each group from its Lorenz curve by trapezoids; null if the total is 0.

    The curve starts with a doubled 0, so the first share counts once more than in the textbook form. n: the number of values of each group
    if only those above 0 are listed.
    """
    rows = values.where(F.col(value) > 0) if drop_zeros else values
    # The m shares of a run rise by its value, so they are summed up at once.
    shares = F.try_divide((F.col("m") * F.col("before")).cast("double") + F.col("value").cast("double") * F.col("m") * (F.col("m") + 1) / 2, F.col("total"))
    first = F.min(F.when(F.col("at") == 0, F.try_divide(F.col("value").cast("double"), F.col("total"))))
    agg = _runs(rows, by, value, n).groupBy(by).agg(F.sum(shares).alias("sum"), F.coalesce(first, F.lit(0.0)).alias("first"), F.max("n").alias("n"), F.max("total").alias("total"))
    return agg.select(by, F.when(F.col("total") > 0, 1 - 2 / F.col("n") * (F.col("sum") - (F.col("first") + 1) / 2)).alias("gini"))


def lorenz(values: DataFrame, by: str = "cell", value: str = "value", points: int = 100, n: int | None = None) -> DataFrame:
    """The Lorenz curve of each group at `points` equal steps of the genome share, linearly interpolated. n as in gini."""
    runs = _runs(values, by, value, n)
    # point j stands at r = n j / (points - 1), between the curve's elements floor(r) + 1 and floor(r) + 2; beyond the last one it is 1
    low, high = F.ceil(F.col("at") * (points - 1) / F.col("n")), F.ceil((F.col("at") + F.col("m")) * (points - 1) / F.col("n")) - 1
    high = F.when(F.col("following").isNull(), points - 1).otherwise(high)
    rows = runs.select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("j")).withColumn("r", F.col("n") * F.col("j") / (points - 1))
    # how many of the run's values stand up to element floor(r) + 1
    rows = rows.withColumn("k", F.floor("r") + 1 - F.col("at"))
    share = lambda mass: F.try_divide(mass.cast("double"), F.col("total"))
    here = F.col("before") + F.col("k") * F.col("value")
    step = F.when(F.col("k") < F.col("m"), F.col("value")).otherwise(F.col("following"))
    y = F.when(F.col("at") + F.col("k") >= F.col("n"), 1.0).otherwise(share(here) + (F.col("r") - F.floor("r")) * (share(here + step) - share(here)))
    return rows.select(by, (F.col("j") / (points - 1)).alias("cumulative_fraction_genome"), y.alias("cumulative_fraction_reads"))


def depth_histogram(reads: DataFrame, by: str = "cell") -> DataFrame:
    """(by, depth, bp) of covered positions, by a sweep over interval ends; uncovered positions are not listed."""
    at = F.explode(F.array(F.struct(F.col("pos0").alias("at"), F.lit(1).alias("step")), F.struct(F.col("pos1").alias("at"), F.lit(-1).alias("step")))).alias("p")
    steps = reads.select(by, "chrom", at).groupBy(by, "chrom", F.col("p.at").alias("at")).agg(F.sum("p.step").alias("step"))
    w = Window.partitionBy(by, "chrom").orderBy("at")
    runs = steps.select(by, F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("depth"), (F.lead("at").over(w) - F.col("at")).alias("bp"))
    return runs.where("depth > 0 and bp > 0").groupBy(by, "depth").agg(F.sum("bp").alias("bp"))


def countable(alignments: DataFrame, least_mapq: int = 20, by: str = "cell") -> DataFrame:
    """(by, chrom, pos0, pos1) of what depth metrics count: mapped primary records that are no duplicates and have the mapping quality; bases that
    both mates of a template cover count once."""
    kept = alignments.where(lacks("flag", UNMAPPED | SECONDARY | SUPPLEMENTARY | DUPLICATE) & (F.col("mapq") >= least_mapq))
    return merge(kept, (by, "qname", "chrom")).select(by, "chrom", "pos0", "pos1")


def wgs_metrics(reads: DataFrame, territory: int, levels: tuple[int, ...] = (1, 5, 10, 20, 30), by: str = "cell") -> DataFrame:
    """Mean, median and standard deviation of depth over the territory, shares covered at each level, callable bases at 10."""
    h = depth_histogram(reads, by)
    covered = h.groupBy(by).agg(F.sum("bp").alias("bp"))
    full = h.unionAll(covered.select(by, F.lit(0).cast("long"), F.lit(territory) - F.col("bp")))
    up = Window.partitionBy(by).orderBy("depth")
    full = full.withColumn("upto", F.sum("bp").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = float(territory)
    mean = F.sum(F.col("depth") * F.col("bp")) / t
    square = F.sum(F.col("depth") * F.col("depth") * F.col("bp")) / t
    out = full.groupBy(by).agg(mean.alias("mean_coverage"), F.min(F.when(F.col("upto") * 2 >= territory, F.col("depth"))).alias("median_coverage"), F.sqrt(square - mean * mean).alias("sd_coverage"), *[(F.coalesce(F.sum(F.when(F.col("depth") >= k, F.col("bp"))), F.lit(0)) / t).alias(f"pct_{k}x") for k in levels])
    bases = (F.lit(t) * F.col("pct_10x")).cast("long")
    return out.withColumns({"callable_bases_10x": bases, "callable_mb_10x": bases / 1e6})


def lander_waterman(cells: DataFrame, genome_bp: int) -> DataFrame:
    """Adds reads per Mb to (barcode, total_reads, ...)."""
    return cells.withColumn("reads_per_mb", F.col("total_reads") / F.lit(float(genome_bp)) * 1e6)


def theory_curve(cells: DataFrame, read_length: float, points: int = 1000) -> DataFrame:
    """x from 0 to 1.05 times the greatest reads_per_mb and the covered share 1 - exp(-x L / 10^6)."""
    top = cells.agg((F.max("reads_per_mb") * 1.05).alias("top"))
    x = F.col("top") * F.col("k") / (points - 1)
    return top.select("top", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).select(F.col("k").cast("long").alias("k"), x.alias("x"), (1 - F.exp(-x * read_length / 1e6)).alias("coverage"))


def mean_track(values: DataFrame, width: int, by: str = "cell") -> DataFrame:
    """Mean of positional values in bins of `width`, nulls ignored."""
    return values.groupBy(by, "chrom", (F.floor(F.col("pos0") / width) * width).alias("bin_start")).agg(F.avg("value").alias("mean"))


def genome_track(track: DataFrame, contigs: DataFrame, gap: int = 0) -> DataFrame:
    """A binned track (chrom, bin_start, ..) along the whole genome: adds genome_start, the bin's start behind all contigs before its own in natural order. Contigs that aren't listed go."""
    return track.join(genome_offsets(contigs, gap).select("chrom", "offset"), "chrom").withColumn("genome_start", F.col("offset") + F.col("bin_start")).drop("offset")


def group_curve(curves: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Mean and standard deviation of curves at every x of a group."""
    return curves.groupBy(by, x).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))


def group_mean(df: DataFrame, by: list[str], value: str = "gini") -> DataFrame:
    """Mean and number of a per-cell figure for each group (method, species); nulls don't count."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
