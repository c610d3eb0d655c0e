"""Queries over variants, lineages, spectra and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import stats
from strandlake.operators import variants

from .base import CALLS_SQL, calls, query, raw_calls, table

C = f"WITH {CALLS_SQL}"
SITE = "chrom, pos, ref, alt"
FLAGGED = "flagged AS (SELECT *, ad / dp AS vaf, coalesce(dp BETWEEN 10 AND 100 AND ad > 1 AND ad / dp > 0.15, false) AS high FROM calls)"


@query("q28_site_merge_long", f"""{C}, sites AS (SELECT DISTINCT {SITE} FROM calls), samples AS (SELECT DISTINCT sample FROM calls)
SELECT sample, {SITE}, dp, ad FROM samples CROSS JOIN sites LEFT JOIN calls USING (sample, {SITE})""")  # fmt: skip
def q28(spark: SparkSession, d: str) -> DataFrame:
    return variants.merge_sites(calls(spark, d, ("chrom", "pos", "ref")), raw_calls(spark, d))


_MULTI = "concat(alt, CASE WHEN pos % 4 = 0 THEN ',N' ELSE '' END)"


@query("q29_split_multiallelics", f"""{C}, w AS (SELECT sample, chrom, pos, ref, CASE WHEN pos % 9 = 0 THEN '.' ELSE {_MULTI} END AS alt, dp, [dp - ad, ad, 1] AS ad FROM calls),
s AS (SELECT sample, chrom, pos, ref, dp, len(string_split(alt, ',')) > 1 AS multiallelic, unnest(string_split(alt, ',')) AS allele, unnest(range(len(string_split(alt, ',')))) AS k, ad FROM w WHERE alt <> '.')
SELECT sample, chrom, pos, ref, dp, multiallelic, allele AS alt, ad[k + 2] AS ad FROM s""")  # fmt: skip
def q29(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).selectExpr("sample", "chrom", "pos", "ref", f"CASE WHEN pos % 9 = 0 THEN '.' ELSE {_MULTI} END AS alt", "dp", "array(dp - ad, ad, 1L) AS ad")
    return variants.split_alleles(c)


@query("q29b_combine_alleles", f"{C} SELECT chrom, pos, ref, string_agg(DISTINCT alt, ',' ORDER BY alt) AS alt, count(DISTINCT sample) AS samples FROM calls GROUP BY chrom, pos, ref")
def q29b(spark: SparkSession, d: str) -> DataFrame:
    return variants.combine_alleles(calls(spark, d))


@query("q30_multiallelic_sites", f"{C}, s AS (SELECT DISTINCT {SITE} FROM calls) SELECT {SITE}, count(*) OVER (PARTITION BY chrom, pos) > 1 AS multiallelic FROM s")
def q30(spark: SparkSession, d: str) -> DataFrame:
    return variants.multiallelic(calls(spark, d).select("chrom", "pos", "ref", "alt").distinct())


@query("q30c_biallelic_sites", f"{C}, s AS (SELECT DISTINCT {SITE} FROM calls) SELECT {SITE} FROM (SELECT {SITE}, count(*) OVER (PARTITION BY chrom, pos) AS k FROM s) WHERE k = 1")
def q30c(spark: SparkSession, d: str) -> DataFrame:
    return variants.biallelic(calls(spark, d).select("chrom", "pos", "ref", "alt").distinct())


@query("q30b_call_summary", f"{C}, s AS (SELECT DISTINCT {SITE} FROM calls) SELECT count(*) AS records, count(*) FILTER (WHERE length(ref) = 1 AND length(alt) = 1) AS snps, count(*) FILTER (WHERE NOT (length(ref) = 1 AND length(alt) = 1)) AS indels, (SELECT count(DISTINCT sample) FROM calls) AS samples FROM s")
def q30b(spark: SparkSession, d: str) -> DataFrame:
    return variants.call_summary(calls(spark, d))


@query("q29c_combined_genotypes", f"""{C}, a AS (SELECT chrom, pos, ref, list(DISTINCT alt ORDER BY alt) AS alts FROM calls GROUP BY chrom, pos, ref),
g AS (SELECT sample, chrom, pos, ref, max(dp) AS dp, list(DISTINCT CASE WHEN ad > 0 THEN alt END ORDER BY CASE WHEN ad > 0 THEN alt END) AS held, sum(ad) AS alt_ad, map_from_entries(list((alt, ad))) AS m FROM calls GROUP BY sample, chrom, pos, ref)
SELECT sample, chrom, pos, ref, array_to_string(alts, ',') AS alt, dp, CASE WHEN len(list_filter(held, lambda x: x IS NOT NULL)) = 0 THEN '0/0' WHEN len(list_filter(held, lambda x: x IS NOT NULL)) > 1 THEN concat(list_position(alts, list_filter(held, lambda x: x IS NOT NULL)[1]), '/', list_position(alts, list_filter(held, lambda x: x IS NOT NULL)[2]))
 WHEN alt_ad >= dp THEN concat(list_position(alts, list_filter(held, lambda x: x IS NOT NULL)[1]), '/', list_position(alts, list_filter(held, lambda x: x IS NOT NULL)[1])) ELSE concat('0/', list_position(alts, list_filter(held, lambda x: x IS NOT NULL)[1])) END AS gt,
 array_to_string(list_transform(alts, lambda x: coalesce(m[x], 0)), ',') AS ad FROM g JOIN a USING (chrom, pos, ref)""")  # fmt: skip
def q29c(spark: SparkSession, d: str) -> DataFrame:
    out = variants.combine_genotypes(calls(spark, d, ("chrom", "pos", "ref")))
    return out.withColumn("ad", F.array_join(F.transform("ad", lambda x: x.cast("string")), ","))


@query("q31_bulk_vaf_filter", f"{C} SELECT {SITE}, sum(ad)::BIGINT AS ad, sum(dp)::BIGINT AS dp, round(sum(ad) / sum(dp), 9) AS bulk_vaf FROM calls GROUP BY {SITE} HAVING sum(ad) / sum(dp) < 0.3")
def q31(spark: SparkSession, d: str) -> DataFrame:
    return variants.bulk_vaf(variants.snps(calls(spark, d)), 0.3).withColumn("bulk_vaf", F.round("bulk_vaf", 9))


@query("q31b_site_depth", f"{C} SELECT {SITE}, sum(dp)::BIGINT AS site_dp FROM calls GROUP BY {SITE}")
def q31b(spark: SparkSession, d: str) -> DataFrame:
    return variants.site_depth(calls(spark, d))


@query("q32_high_vaf_flags", f"{C}, {FLAGGED} SELECT sample, {SITE}, dp, ad, round(vaf, 9) AS vaf, high AS high_vaf FROM flagged")
def q32(spark: SparkSession, d: str) -> DataFrame:
    return variants.high_vaf(calls(spark, d)).withColumn("vaf", F.round("vaf", 9))


@query("q32b_ancestor_delta", f"""{C}, {FLAGGED}, n AS (SELECT sample, count(*) FILTER (WHERE high) AS mutations FROM flagged GROUP BY sample),
g AS (SELECT *, CASE WHEN substr(sample, 2)::INT < 9 THEN 'g1' ELSE 'g2' END AS "group", sample IN ('s0', 's9') AS is_ancestor FROM n)
SELECT g.sample AS sample, g.mutations AS mutations, g."group" AS "group", g.is_ancestor AS is_ancestor, a.mutations AS ancestor_mutations, g.mutations - a.mutations AS delta FROM g JOIN g a ON a."group" = g."group" AND a.is_ancestor""")  # fmt: skip
def q32b(spark: SparkSession, d: str) -> DataFrame:
    counts = variants.sample_counts(variants.high_vaf(calls(spark, d)))
    groups = counts.select("sample", F.when(F.substring("sample", 2, 9).cast("int") < 9, "g1").otherwise("g2").alias("group"), F.col("sample").isin("s0", "s9").alias("is_ancestor"))
    return variants.ancestor_delta(counts, groups)


LINEAGES = [("L2", ["s1", "s2"]), ("L3", ["s3", "s4", "s5"]), ("L4", ["s6", "s7", "s8", "s9"])]
_IN = "max(CASE WHEN sample = '{0}' THEN 1 ELSE 0 END) AS {0}"


def lineage_sql(strict: bool) -> str:
    parts = []
    for name, s in LINEAGES:
        k = len(s)
        suffix = ["(" + " AND ".join(f"{x} = 1" for x in s[i:]) + ")" for i in range(k)]
        made = [suffix[0]]
        for i in range(1, k):
            made.append(f"({suffix[i]} AND NOT " + (f"({' OR '.join(made)})" if strict else made[i - 1]) + ")")
        parts += [f"SELECT '{name}' AS lineage, {i} AS split, count(*) FILTER (WHERE {m}) AS gained FROM held" for i, m in enumerate(made)]
        if k == 2:
            parts.append(f"SELECT '{name}', 2, NULL")
    columns = ", ".join(_IN.format(x) for _, s in LINEAGES for x in s)
    return f"{C}, {FLAGGED}, held AS (SELECT {SITE}, {columns} FROM flagged WHERE high GROUP BY {SITE}), g AS ({' UNION ALL '.join(parts)}) SELECT lineage, split, gained, CASE WHEN gained IS NOT NULL THEN sum(gained) OVER (PARTITION BY lineage ORDER BY split) END::BIGINT AS cumulative FROM g"


def _lineages(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    rows = spark.createDataFrame(LINEAGES, "lineage string, samples array<string>")
    return variants.lineage_accumulation(variants.high_vaf(calls(spark, d)), rows, strict)


@query("q33_lineage_accumulation", lineage_sql(False))
def q33(spark: SparkSession, d: str) -> DataFrame:
    return _lineages(spark, d, False)


@query("q33b_lineage_accumulation_strict", lineage_sql(True))
def q33b(spark: SparkSession, d: str) -> DataFrame:
    return _lineages(spark, d, True)


def base_at(p: str) -> str:
    """The reference base at a 1-based position, the same on all contigs and equal to `ref` where a call stands."""
    return f"CASE WHEN ({p}) % 10 < 2 THEN substr('ACGT', cast(1 + floor(({p}) / 10) % 4 AS int), 1) ELSE substr('ACGT', cast(1 + (({p}) + floor(({p}) / 7)) % 4 AS int), 1) END"


_T = "translate({0}, 'ACGT', 'TGCA')"
_L, _R = base_at("pos - 1"), base_at("pos + 1")
CONTEXT = f"CASE WHEN ref IN ('C', 'T') THEN concat({_L}, ref, {_R}, '>', {_L}, alt, {_R}) ELSE concat({_T.format(_R)}, {_T.format('ref')}, {_T.format(_L)}, '>', {_T.format(_R)}, {_T.format('alt')}, {_T.format(_L)}) END"
BASES = 1000


def reference_windows(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, bin, bases) over all positions that a call may have."""
    top = table(spark, d, "part").agg(F.floor((F.max("p_partkey") * 10 + 1) / BASES).alias("last"))
    bins = top.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    contigs = spark.range(22).select(F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("chrom"))
    bases = F.expr(f"array_join(transform(sequence(bin * {BASES}, bin * {BASES} + {BASES} + 1), p -> {base_at('p')}), '')")
    return contigs.crossJoin(bins.select("bin", bases.alias("bases")))


@query("q34_spectrum_by_group", f"""{C}, {FLAGGED}, ctx AS (SELECT sample, {CONTEXT} AS trinuc_type FROM flagged WHERE high AND ref <> alt),
spine AS (SELECT concat(a, r, b, '>', a, x, b) AS trinuc_type FROM (SELECT unnest(['A','C','G','T']) AS a), (SELECT unnest(['A','C','G','T']) AS b), (SELECT unnest(['C','T']) AS r), (SELECT unnest(['A','C','G','T']) AS x) WHERE r <> x),
n AS (SELECT sample, trinuc_type, count(*) AS n FROM ctx GROUP BY ALL)
SELECT sample, trinuc_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT sample FROM ctx) CROSS JOIN spine LEFT JOIN n USING (sample, trinuc_type)""")  # fmt: skip
def q34(spark: SparkSession, d: str) -> DataFrame:
    rows = variants.high_vaf(calls(spark, d)).where("high_vaf AND ref <> alt")
    return variants.spectrum(variants.trinucleotide(rows, reference_windows(spark, d), BASES).select("sample", "trinuc_type"))


@query("q34b_union_mask", f"""{C}, {FLAGGED} SELECT DISTINCT CASE WHEN substr(sample, 2)::INT < 9 THEN 'g1' ELSE 'g2' END AS "group", {SITE} FROM flagged WHERE high""")
def q34b(spark: SparkSession, d: str) -> DataFrame:
    f = variants.high_vaf(calls(spark, d))
    groups = f.select("sample").distinct().select("sample", F.when(F.substring("sample", 2, 9).cast("int") < 9, "g1").otherwise("g2").alias("group"))
    return variants.union_mask(f, groups)


_GROWTH = "g AS (SELECT o_custkey % 50 AS clone, year(o_orderdate) - 1990 AS day, count(*) AS n FROM orders GROUP BY ALL)"


@query("q35_log_linear_growth", f"""WITH {_GROWTH}, r AS (SELECT clone, count(*) AS n, regr_slope(ln(n), day) AS slope, regr_intercept(ln(n), day) AS intercept, regr_r2(ln(n), day) AS r2, regr_sxx(ln(n), day) AS sxx, regr_syy(ln(n), day) AS syy FROM g GROUP BY clone)
SELECT clone, n, round(slope, 9) AS slope, round(intercept, 9) AS intercept, round(r2, 9) AS r2, round(sqrt(greatest(syy - slope * slope * sxx, 0) / ((n - 2) * sxx)), 9) AS stderr FROM r""")  # fmt: skip
def q35(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("clone"), (F.year("o_orderdate") - 1990).alias("day")).agg(F.count("*").alias("n_orders"))
    out = stats.log_linear(g, "clone", "day", "n_orders")
    return out.select("clone", "n", *[F.round(c, 9).alias(c) for c in ("slope", "intercept", "r2", "stderr")])


@query("q36_mean_interval_and_welch", """WITH s AS (SELECT count(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS n1, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS m1, var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS v1,
 count(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n2, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m2, var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS v2 FROM customer)
SELECT n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 9) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) AS df FROM s""")  # fmt: skip
def q36(spark: SparkSession, d: str) -> DataFrame:
    w = stats.welch(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return w.select("n1", "n2", F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"), F.round("t", 9).alias("t"), F.round("df", 6).alias("df"))


@query("q36b_student", """WITH s AS (SELECT count(*) FILTER (WHERE l = 'en') AS n1, avg(x) FILTER (WHERE l = 'en') AS m1, var_samp(x) FILTER (WHERE l = 'en') AS v1, count(*) FILTER (WHERE l = 'de') AS n2, avg(x) FILTER (WHERE l = 'de') AS m2, var_samp(x) FILTER (WHERE l = 'de') AS v2
 FROM (SELECT lang AS l, log10(n_chars) AS x FROM documents WHERE n_chars > 0))
SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 9) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM s""")  # fmt: skip
def q36b(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("n_chars > 0").select("lang", F.col("n_chars").cast("double").alias("x"))
    return stats.student(rows, "lang", "x", "en", "de", log=True).select("n1", "n2", F.round("t", 9).alias("t"), "df")


def t_area(t: str, v: str) -> str:
    """Area under Student's density with v degrees of freedom between 0 and t, by Simpson's rule."""
    weight = "CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    total = f"list_sum(list_transform(range(0, 1001), lambda i: {weight} * (1 + ({t}) * ({t}) * i * i / 1000000.0::DOUBLE / {v}) ** (-({v} + 1) / 2.0::DOUBLE)))"
    return f"({total} * ({t}) / 3000.0::DOUBLE * exp(lgamma(({v} + 1) / 2.0::DOUBLE) - lgamma({v} / 2.0::DOUBLE)) / sqrt({v} * pi()))"


@query("q36c_intervals_with_p", f"""WITH RECURSIVE a AS (SELECT c_mktsegment, count(c_acctbal) AS n, avg(c_acctbal)::DOUBLE AS mean, stddev_samp(c_acctbal)::DOUBLE AS sd FROM customer GROUP BY c_mktsegment),
b AS (SELECT c_mktsegment, (n - 1)::DOUBLE AS v, 0::DOUBLE AS lo, 20::DOUBLE AS hi, 0 AS step FROM a UNION ALL
  SELECT c_mktsegment, v, CASE WHEN area < 0.475 THEN mid ELSE lo END, CASE WHEN area < 0.475 THEN hi ELSE mid END, step + 1 FROM (SELECT *, {t_area("mid", "v")} AS area FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE step < 50)))
SELECT a.c_mktsegment, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS sem, round(mean - lo * sd / sqrt(n), 4) AS ci_low, round(mean + lo * sd / sqrt(n), 4) AS ci_high FROM a JOIN b ON a.c_mktsegment = b.c_mktsegment AND step = 50""")  # fmt: skip
def q36c(spark: SparkSession, d: str) -> DataFrame:
    out = stats.mean_interval(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    return out.select("c_mktsegment", "n", *[F.round(F.col(c).cast("double"), k).alias(c) for c, k in (("mean", 6), ("sd", 6), ("sem", 6), ("ci_low", 4), ("ci_high", 4))])


@query("q36d_p_values", f"""WITH s AS (SELECT count(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS n1, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS m1, var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS v1,
 count(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n2, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m2, var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS v2 FROM customer),
u AS (SELECT 'welch' AS test, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS v FROM s UNION ALL
  SELECT 'student', (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), (n1 + n2 - 2)::DOUBLE FROM s),
{_GROWTH}, r AS (SELECT concat('slope', clone) AS test, count(*) AS n, regr_slope(ln(n), day) AS slope, regr_sxx(ln(n), day) AS sxx, regr_syy(ln(n), day) AS syy FROM g GROUP BY clone),
w AS (SELECT test, slope / sqrt(greatest(syy - slope * slope * sxx, 0) / ((n - 2) * sxx)) AS t, (n - 2)::DOUBLE AS v FROM r UNION ALL SELECT * FROM u)
SELECT test, round(1 - 2 * {t_area("abs(t)", "v")}, 6) AS p_value FROM w WHERE abs(t) < 100""")  # fmt: skip
def q36d(spark: SparkSession, d: str) -> DataFrame:
    """p-values of the two t-tests and of the slopes of growth."""
    c = table(spark, d, "customer")
    tests = [f(c, "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY").select(F.lit(f.__name__).alias("test"), "t", "df") for f in (stats.welch, stats.student)]
    p = tests[0].unionByName(tests[1]).withColumn("p_value", stats.two_sided_p(F.col("t"), F.col("df"))).where("abs(t) < 100").select("test", "p_value")
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("clone"), (F.year("o_orderdate") - 1990).alias("day")).agg(F.count("*").alias("n_orders"))
    slopes = stats.with_slope_p(stats.log_linear(g, "clone", "day", "n_orders")).where("abs(slope / stderr) < 100")
    return p.unionByName(slopes.select(F.concat(F.lit("slope"), "clone").alias("test"), "p_value")).select("test", F.round("p_value", 6).alias("p_value"))


@query("q37_rate_delta_method", """WITH s AS (SELECT n_regionkey AS region, avg(c_acctbal) AS m, stddev_samp(c_acctbal) / sqrt(count(*)) AS se, avg(c_nationkey + 1) AS b, stddev_samp(c_nationkey + 1) / sqrt(count(*)) AS sb FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)
SELECT region, round(m / b, 6) AS rate, round(abs(m / b) * sqrt(se * se / (m * m) + sb * sb / (b * b)), 6) AS rate_se, round(m / b - 1.96 * abs(m / b) * sqrt(se * se / (m * m) + sb * sb / (b * b)), 6) AS ci_low FROM s""")  # fmt: skip
def q37(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, n = F.col("c_nationkey") + 1, F.sqrt(F.count("*"))
    s = c.groupBy(F.col("n_regionkey").alias("region")).agg(F.avg("c_acctbal").alias("m"), (F.stddev_samp("c_acctbal") / n).alias("se"), F.avg(k).alias("b"), (F.stddev_samp(k) / n).alias("sb"))
    rate, error = stats.delta_ratio(F.col("m"), F.col("se"), F.col("b"), F.col("sb"))
    return s.select("region", F.round(rate, 6).alias("rate"), F.round(error, 6).alias("rate_se"), F.round(rate - 1.96 * error, 6).alias("ci_low"))


@query("q37b_cumulative_doublings", f"""WITH {_GROWTH}, r AS (SELECT clone, regr_slope(ln(n), day) / ln(2) * 21 AS per_passage FROM g GROUP BY clone) SELECT clone, passage, round(per_passage * passage, 6) AS cumulative FROM r, (SELECT unnest([1, 2, 3]) AS passage)""")
def q37b(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("clone"), (F.year("o_orderdate") - 1990).alias("day")).agg(F.count("*").alias("n_orders"))
    per = stats.log_linear(g, "clone", "day", "n_orders").select("clone", stats.doublings(F.col("slope"), 21).alias("p"))
    return per.select("clone", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("passage"), "p").select("clone", "passage", F.round(F.col("p") * F.col("passage"), 6).alias("cumulative"))


@query("q59_genotypes_and_slopes", """WITH g AS (SELECT concat('F', c_nationkey % 3, '_', c_custkey) AS sample, c_acctbal AS y, CASE c_nationkey % 3 WHEN 0 THEN 'wild' WHEN 1 THEN 'mutant' END AS genotype FROM customer)
SELECT genotype, count(*) AS n, round(avg(y), 6) AS mean FROM g GROUP BY genotype""")  # fmt: skip
def q59(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("concat('F', c_nationkey % 3, '_', c_custkey) AS sample", "c_acctbal AS y")
    return variants.label_by_prefix(c, {"F0": "wild", "F1": "mutant"}, "genotype").groupBy("genotype").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"))


@query("q59b_combined_coefficients", """WITH s AS (SELECT c_nationkey % 2 AS genotype, c_custkey % 7 AS passage, c_acctbal AS y FROM customer), f AS (SELECT genotype, regr_slope(y, passage) AS slope FROM s GROUP BY genotype)
SELECT round(max(CASE WHEN genotype = 0 THEN slope END), 6) AS passage, round(max(CASE WHEN genotype = 1 THEN slope END) - max(CASE WHEN genotype = 0 THEN slope END), 6) AS interaction, round(max(CASE WHEN genotype = 1 THEN slope END), 6) AS combined FROM f""")  # fmt: skip
def q59b(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").selectExpr("c_nationkey % 2 AS genotype", "c_custkey % 7 AS passage", "c_acctbal AS y")
    slopes = s.groupBy("genotype").agg(F.regr_slope("y", "passage").alias("slope"))
    at = lambda g: F.max(F.when(F.col("genotype") == g, F.col("slope")))
    terms = slopes.agg(at(0).alias("passage"), (at(1) - at(0)).alias("interaction"))
    return stats.combined(terms, ["passage", "interaction"]).select(*[F.round(c, 6).alias(c) for c in ("passage", "interaction", "combined")])


@query("q47_melt_pivot_roundtrip", """WITH w AS (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) SELECT p_partkey, price, size FROM w""")
def q47(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "part").selectExpr("p_partkey", "cast(p_size AS double) AS size", "p_retailprice AS price")
    return wide.unpivot("p_partkey", ["size", "price"], "metric", "value").groupBy("p_partkey").pivot("metric", ["price", "size"]).agg(F.first("value"))


@query("q58_mixed_model")
def q58(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("cast(o_totalprice / 1000 AS double) AS y", "o_custkey % 12 AS lineage", "cast(year(o_orderdate) - 1992 AS double) AS passage", "cast(o_custkey % 2 AS double) AS genotype")
    return stats.mixed_model(rows.withColumn("interaction", F.col("passage") * F.col("genotype")), "y", "lineage", ["passage", "genotype", "interaction"])


@query("q89_normalised_by_passage", "SELECT c_custkey AS sample, round(c_acctbal / (CASE WHEN c_nationkey % 3 = 0 THEN 296 / 168.0::DOUBLE ELSE 1 END) ** (c_custkey % 7), 6) AS per_passage FROM customer")
def q89(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.when(F.col("c_nationkey") % 3 == 0, 296 / 168).otherwise(1.0)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), F.round(stats.per_passage(F.col("c_acctbal"), F.col("c_custkey") % 7, ratio), 6).alias("per_passage"))
