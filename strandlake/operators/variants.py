"""Variant tables in long form (sample, chrom, pos, ref, alt, dp, ad): merging, filters, lineages, spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join

SITE = ["chrom", "pos", "ref", "alt"]


def split_alleles(calls: DataFrame) -> DataFrame:
    """One row for each alternative allele of (.., alt 'C,G', ad array with the reference first); 'ALT .' rows go, ad becomes that allele's."""
    alts = F.split("alt", ",")
    rows = calls.where("alt <> '.'").withColumn("multiallelic", F.size(alts) > 1)
    other = [c for c in rows.columns if c not in ("alt", "ad")]
    return rows.select(*other, F.posexplode(alts).alias("k", "allele"), "ad").select(*other, F.col("allele").alias("alt"), F.try_element_at("ad", F.col("k") + 2).alias("ad"))


def snps(df: DataFrame) -> DataFrame:
    return df.where((F.length("ref") == 1) & (F.length("alt") == 1))


def merge_sites(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Every site of any sample for every sample, one record for each allele; a sample without the site has null dp and ad.

    A site's records are gathered and the samples that it lacks added to them, so that rows that say nothing are never shuffled. Null names meet nothing.
    """
    names = samples.select("sample").distinct()
    listed = names.agg(F.collect_list(F.struct("sample")).alias("listed"))
    known = calls.join(F.broadcast(names.withColumn("known", F.lit(True))), "sample", "left")
    named = F.col("known").isNotNull()
    for c in SITE:
        named = named & F.col(c).isNotNull()
    sites = known.groupBy(*SITE).agg(F.collect_list(F.when(named, F.struct("sample", "dp", "ad"))).alias("held")).crossJoin(F.broadcast(listed))
    kinds = dict(calls.dtypes)
    lacks = F.array_except(F.transform("listed", lambda x: x["sample"]), F.transform("held", lambda x: x["sample"]))
    empty = F.transform(lacks, lambda s: F.struct(s.alias("sample"), F.lit(None).cast(kinds["dp"]).alias("dp"), F.lit(None).cast(kinds["ad"]).alias("ad")))
    return sites.select(*SITE, F.explode(F.concat("held", empty)).alias("x")).select("x.sample", *SITE, "x.dp", "x.ad")


def combine_alleles(calls: DataFrame) -> DataFrame:
    """One row for each (chrom, pos, ref) with its alleles sorted and joined by commas, and the number of samples."""
    return calls.where("alt <> '.'").groupBy("chrom", "pos", "ref").agg(F.array_join(F.array_sort(F.collect_set("alt")), ",").alias("alt"), F.count_distinct("sample").alias("samples"))


def multiallelic(sites: DataFrame) -> DataFrame:
    """Adds multiallelic: another record stands at the same position."""
    return sites.withColumn("multiallelic", F.count("*").over(Window.partitionBy("chrom", "pos")) > 1)


def biallelic(sites: DataFrame) -> DataFrame:
    """Sites at whose position no other record stands."""
    return multiallelic(sites).where(~F.col("multiallelic")).drop("multiallelic")


def combine_genotypes(calls: DataFrame) -> DataFrame:
    """One row for each sample and (chrom, pos, ref): all alleles of the site in order, the sample's depth, genotype and depths by allele.

    A genotype names the alleles with reads by their place in the combined list (0: reference): none 0/0, two or more the first two, a
    single one twice if it has all reads, else with the reference. Alleles without a record in the sample have depth 0. The samples of a site are gathered once, not joined to its alleles.
    """
    seen = calls.where("alt <> '.'").dropna(subset=["chrom", "pos", "ref"])
    own = seen.groupBy("sample", "chrom", "pos", "ref").agg(F.max("dp").alias("dp"), F.map_from_entries(F.collect_list(F.struct("alt", "ad"))).alias("m"))
    alts = F.array_sort(F.array_distinct(F.flatten(F.transform("held", lambda x: F.map_keys(x["m"])))))
    # Alleles are put together before samples become rows again, once for each site.
    sites = own.groupBy("chrom", "pos", "ref").agg(F.collect_list(F.struct("sample", "dp", "m")).alias("held")).withColumn("alts", alts)
    ad = F.transform("alts", lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0)).cast("long"))
    rows = sites.select("chrom", "pos", "ref", "alts", F.explode("held").alias("x")).select("chrom", "pos", "ref", "alts", "x.*").withColumn("ad", ad)
    held = F.filter(F.transform("ad", lambda x, i: F.when(x > 0, i + 1)), lambda i: i.isNotNull())
    total = F.aggregate("ad", F.lit(0).cast("long"), lambda s, x: s + x)
    one = F.try_element_at("held", F.lit(1))
    pair = lambda a, b: F.concat_ws("/", a.cast("string"), b.cast("string"))
    gt = F.when(F.size("held") == 0, "0/0").when(F.size("held") > 1, pair(one, F.try_element_at("held", F.lit(2)))).when(total >= F.col("dp"), pair(one, one)).otherwise(pair(F.lit(0), one))
    return rows.withColumn("held", held).select("sample", "chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), "dp", gt.alias("gt"), "ad")


def call_summary(calls: DataFrame) -> DataFrame:
    """Records (distinct sites), SNPs, indels and samples of calls in long form."""
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    sites = calls.select(*SITE).distinct().agg(F.count("*").alias("records"), F.count_if(snp).alias("snps"), F.count_if(~snp).alias("indels"))
    return sites.crossJoin(calls.agg(F.count_distinct("sample").alias("samples")))


def label_by_prefix(df: DataFrame, labels: dict[str, str], name: str, column: str = "sample", default: str | None = None) -> DataFrame:
    """Adds the label of the first prefix that a name starts with (genotypes, broods, passages), else the default."""
    case = F.lit(default)
    for prefix, label in reversed(labels.items()):
        case = F.when(F.col(column).startswith(prefix), label).otherwise(case)
    return df.withColumn(name, case)


def save_shards(calls: DataFrame, intervals: DataFrame, path: str) -> None:
    """Joint store: calls as Parquet by the shard of their interval (chrom, pos0, pos1, shard), so that a shard is genotyped from its own files.
    A store that is there already is left as it is."""
    spans = calls.withColumns({"pos0": F.col("pos") - 1, "pos1": F.col("pos")})
    dealt = overlap_join(spans, intervals.select("chrom", "pos0", "pos1", "shard")).select(*calls.columns, "shard")
    dealt.repartition("shard", "chrom").write.mode("ignore").partitionBy("shard").parquet(path)


def site_depth(calls: DataFrame) -> DataFrame:
    return calls.groupBy(*SITE).agg(F.sum("dp").alias("site_dp"))


def bulk_vaf(calls: DataFrame, below: float | None = None) -> DataFrame:
    """Sum of allele depths over sum of depths for each site; `below` keeps sites under it."""
    out = calls.groupBy(*SITE).agg(F.sum("ad").alias("ad"), F.sum("dp").alias("dp")).withColumn("bulk_vaf", F.try_divide(F.col("ad").cast("double"), F.col("dp")))
    return out if below is None else out.where(F.col("bulk_vaf") < below)


def high_vaf(calls: DataFrame, least_dp: int = 10, most_dp: int = 100, above_ad: int = 1, above_vaf: float = 0.15) -> DataFrame:
    """Adds vaf and high_vaf (false where anything is missing)."""
    vaf = F.try_divide(F.col("ad").cast("double"), F.col("dp"))
    test = F.col("dp").between(least_dp, most_dp) & (F.col("ad") > above_ad) & (vaf > above_vaf)
    return calls.withColumns({"vaf": vaf, "high_vaf": F.coalesce(test, F.lit(False))})


def sample_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("sample").agg(F.count_if("high_vaf").alias("mutations"))


def ancestor_delta(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds the count of each group's ancestor and the difference; groups: (sample, group, is_ancestor)."""
    joined = counts.join(groups, "sample")
    base = joined.where("is_ancestor").select("group", F.col("mutations").alias("ancestor_mutations"))
    return joined.join(base, "group", "left").withColumn("delta", F.col("mutations") - F.col("ancestor_mutations"))


def lineage_accumulation(flags: DataFrame, lineages: DataFrame, strict: bool = False) -> DataFrame:
    """(lineage, split, gained, cumulative) from (sample, site columns, high_vaf) and lineages (lineage, samples array in order).

    With k samples: split 0 holds the sites of all of them; split i those of samples i to k not in split i-1 (i >= 1), the last one the last
    sample's sites not in the split before. strict takes away all earlier splits, so no site counts twice. For two samples: both; the second's alone; null.
    """
    members = lineages.select("lineage", F.size("samples").alias("k"), F.posexplode("samples").alias("i", "sample"))
    present = flags.where("high_vaf").select("sample", *SITE).distinct().join(members, "sample")
    sets = present.groupBy("lineage", "k", *SITE).agg(F.collect_set("i").alias("held"))

    def suffix(i: Column) -> Column:  # the site is in every sample from i on
        return F.forall(F.sequence(i, F.col("k") - 1), lambda j: F.array_contains("held", j))

    # split 0 = in all; split i = in samples i.. and not in split i - 1 (literal) or in none before (strict)
    def walk(state, i):
        here = F.when(i == 0, suffix(i)).otherwise(suffix(i) & ~(state["seen"] if strict else state["last"]))
        return F.struct(here.alias("last"), (state["seen"] | here).alias("seen"), F.concat(state["out"], F.when(here, F.array(i)).otherwise(F.array().cast("array<int>"))).alias("out"))

    start = F.struct(F.lit(False).alias("last"), F.lit(False).alias("seen"), F.array().cast("array<int>").alias("out"))
    splits = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), start, walk)["out"]
    counted = sets.select("lineage", F.explode(splits).alias("split")).groupBy("lineage", "split").agg(F.count("*").alias("gained"))
    spine = lineages.select("lineage", F.size("samples").alias("k"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("samples"), F.lit(3)) - 1)).alias("split"))
    out = spine.join(counted, ["lineage", "split"], "left").withColumn("gained", F.when(F.col("split") < F.col("k"), F.coalesce("gained", F.lit(0))))
    running = F.sum("gained").over(Window.partitionBy("lineage").orderBy("split"))
    return out.select("lineage", "split", "gained", F.when(F.col("split") < F.col("k"), running).alias("cumulative"))


def union_mask(flags: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, site): sites that any sample of the group carries."""
    return flags.where("high_vaf").join(groups, "sample").select("group", *SITE).distinct()


def complement(base: str) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def trinucleotide(sites: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Adds context like TCT>TAT, on the strand where the reference base is a pyrimidine.

    windows: (chrom, bin, bases) with `width` bases from bin * width on and one more on either side (N beyond the contig); pos is 1-based.
    """
    at = F.col("pos") - 1
    joined = sites.withColumn("bin", F.floor(at / width)).join(windows, ["chrom", "bin"], "left")
    tri = F.substring("bases", (at - F.col("bin") * width + 1).cast("int"), F.lit(3))
    alt = F.concat(F.substring(tri, 1, 1), "alt", F.substring(tri, 3, 1))
    fold = lambda x: F.reverse(F.translate(x, "ACGT", "TGCA"))
    context = F.when(F.col("ref").isin("C", "T"), F.concat(tri, F.lit(">"), alt)).otherwise(F.concat(fold(tri), F.lit(">"), fold(alt)))
    return joined.withColumn("trinuc_type", context).drop("bin", "bases")


def contexts() -> list[str]:
    """The 96 contexts."""
    return [f"{a}{r}{b}>{a}{x}{b}" for r in "CT" for x in "ACGT" if x != r for a in "ACGT" for b in "ACGT"]


def spectrum(sites: DataFrame, by: str = "sample", zeros: bool = True) -> DataFrame:
    """(by, trinuc_type, n), with 0 for contexts that a group lacks."""
    counts = sites.groupBy(by, "trinuc_type").agg(F.count("*").alias("n"))
    if not zeros:
        return counts
    spine = sites.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, contexts()))).alias("trinuc_type"))
    return spine.join(counts, [by, "trinuc_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
