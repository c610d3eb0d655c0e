"""Sparse joint store: alleles that samples have and blocks in which they look like the reference, appended by samples, and genotypes from it.

A sample without an allele at a site is either covered there (a block holds the position) or not seen at all; only the first is a row. Blocks are cut at
multiples of a width, so everything meets in equi-joins on (chrom, bin) and an as-of look-up inside a bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SITE = ["chrom", "pos", "ref", "alt"]


def reference_blocks(runs: DataFrame, classes: tuple[int, ...] = (1,)) -> DataFrame:
    """(sample, chrom, bin, pos0, pos1, min_dp) from runs of equal depth in bins: adjacent runs of one depth class become a block with their least depth.

    classes: the least depth of each class, rising; depth under the first one counts as not covered. One class of 1 makes a block of each covered stretch.
    """
    level = F.array_max(F.array(*[F.when(F.col("depth") >= c, k) for k, c in enumerate(classes)]))
    rows = runs.withColumn("level", level).where("level is not null")
    w = Window.partitionBy("sample", "chrom", "bin").orderBy("pos0")
    opens = (F.lag("pos1").over(w) != F.col("pos0")) | (F.lag("level").over(w) != F.col("level"))
    marked = rows.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("block", F.sum("opens").over(w))
    return marked.groupBy("sample", "chrom", "bin", "block").agg(F.min("pos0").alias("pos0"), F.max("pos1").alias("pos1"), F.min("depth").alias("min_dp")).drop("block")


def append(calls: DataFrame, blocks: DataFrame, path: str, batch: str, width: int) -> bool:
    """Adds the samples of a batch: calls (sample, chrom, pos, ref, alt, dp, ad) and blocks. Files of other batches are neither read nor written.

    The list of its samples is written last, and only batches that have one count, so what an interrupted run left is written anew. A batch that is there stays as it is (False).
    """
    spark = calls.sparkSession
    if _exists(spark, f"{path}/samples/batch={batch}/_SUCCESS"):
        return False
    rows = calls.select("sample", *SITE, "dp", "ad", F.floor((F.col("pos") - 1) / width).alias("bin"))
    for name, df in (("alleles", rows), ("blocks", blocks.select("sample", "chrom", "bin", "pos0", "pos1", "min_dp"))):
        df.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "sample").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    names = calls.select("sample").unionAll(blocks.select("sample")).distinct()
    names.write.mode("overwrite").parquet(f"{path}/samples/batch={batch}")
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alleles, blocks, samples) of all whole batches; interrupted ones are left out."""
    samples = spark.read.parquet(f"{path}/samples")
    whole = samples.select("batch").distinct()
    alleles, blocks = (spark.read.parquet(f"{path}/{name}").join(whole, "batch", "left_semi").drop("batch") for name in ("alleles", "blocks"))
    return alleles, blocks, samples.select("sample").distinct()


def genotypes(alleles: DataFrame, blocks: DataFrame) -> DataFrame:
    """(sample, chrom, pos, ref, alt, dp, ad): every allele that a sample has, and ad 0 with the block's least depth where it is covered without having it.

    Sites that a sample doesn't cover are not listed. A site meets the samples that have a block in its bin only, and finds its block as the last one
    that begins before it. A reference with several bases is covered where its first one is.
    """
    sites = alleles.select("bin", *SITE).distinct()
    places = sites.select("chrom", "bin", (F.col("pos") - 1).alias("pos0")).distinct()
    asked = places.join(blocks.select("sample", "chrom", "bin").distinct(), ["chrom", "bin"]).withColumns({"span": F.lit(None).cast("struct<pos1:bigint,min_dp:bigint>"), "asks": F.lit(1)})
    held = blocks.select("chrom", "bin", "pos0", "sample", F.struct(F.col("pos1").cast("long").alias("pos1"), F.col("min_dp").cast("long").alias("min_dp")).alias("span"), F.lit(0).alias("asks"))
    w = Window.partitionBy("chrom", "bin", "sample").orderBy("pos0", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(held).withColumn("last", F.last("span", ignorenulls=True).over(w)).where((F.col("asks") == 1) & (F.col("last.pos1") > F.col("pos0")))
    covered = found.select("sample", "chrom", (F.col("pos0") + 1).alias("pos"), F.col("last.min_dp").alias("dp")).join(sites.drop("bin"), ["chrom", "pos"])
    reference = covered.join(alleles, ["sample", *SITE], "left_anti").select("sample", *SITE, "dp", F.lit(0).cast("long").alias("ad"))
    return alleles.select("sample", *SITE, F.col("dp").cast("long").alias("dp"), F.col("ad").cast("long").alias("ad")).unionByName(reference)


def dense(found: DataFrame, samples: DataFrame) -> DataFrame:
    """Every site for every sample, null dp and ad where nothing is known. For exports: as many rows as samples times sites."""
    return found.select(*SITE).distinct().crossJoin(samples.select("sample").distinct()).join(found, ["sample", *SITE], "left").select("sample", *SITE, "dp", "ad")
