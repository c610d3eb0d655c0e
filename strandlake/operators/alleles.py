"""Normal form of alleles: checked against the reference, trimmed, and indels aligned to the left across window borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pileup import reference_bases
from .rounds import settle

SITE = ["chrom", "pos", "ref", "alt"]
#: Strings of up to 2^20 - 1 letters are compared.
_POWERS = [1 << k for k in range(19, -1, -1)]


def common_prefix(a: Column, b: Column, most: Column) -> Column:
    """Length of the longest common prefix of two strings, `most` at most: a binary search, as a prefix is equal if a longer one is."""
    powers = F.array(*[F.lit(p) for p in _POWERS])
    fits = lambda k, p: (k + p <= most) & (F.substring(a, F.lit(1), k + p) == F.substring(b, F.lit(1), k + p))
    return F.aggregate(powers, F.lit(0), lambda k, p: F.when(fits(k, p), k + p).otherwise(k))


def matching(sites: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Sites whose ref is what the reference has there; those that reach beyond the windows go too."""
    spans = sites.select("chrom", (F.col("pos") - 1).alias("pos0"), F.length("ref").cast("long").alias("length")).distinct()
    bases = reference_bases(spans, windows, width).select("chrom", (F.col("pos0") + 1).alias("pos"), F.col("bases").alias("__bases"), F.col("length").alias("__length"))
    joined = sites.join(bases, ["chrom", "pos"]).where((F.length("ref") == F.col("__length")) & (F.upper("ref") == F.upper("__bases")))
    return joined.select(*sites.columns)


def shifted(rows: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Indels (keys.., s, at, next) moved to the left as far as the reference allows; adds `anchor`, the base before s (null at a contig's start).

    s is the inserted or deleted string, at the 0-based position where it begins, next the base behind it. It moves by k where the k bases before it,
    read backwards, are the string's own, read backwards and repeated. One join moves it to its window's start at most; what gets there goes on in another round.
    """
    windows = windows.select(F.col("chrom").alias("__chrom"), F.col("bin").alias("__bin"), F.col("bases").alias("__bases"))
    own = [c for c in rows.columns if c not in ("s", "at", "next")]
    open_, done = rows, None
    while True:
        joined = open_.join(windows, (F.col("chrom") == F.col("__chrom")) & (F.floor((F.col("at") - 1) / width) == F.col("__bin")), "left")
        left = (F.col("at") - F.col("__bin") * width).cast("int")
        joined = joined.withColumn("__before", F.reverse(F.substring("__bases", F.lit(2), left))).withColumn("__n", F.coalesce(F.length("__before"), F.lit(0)))
        cycle = F.repeat(F.reverse("s"), F.ceil(F.col("__n") / F.length("s")).cast("int"))
        joined = joined.withColumn("__k", F.coalesce(common_prefix(F.col("__before"), cycle, F.col("__n")), F.lit(0)))
        turn = (F.col("__k") % F.length("s")).cast("int")
        moved = joined.select(
            *own, F.concat(F.right("s", turn), F.substring("s", F.lit(1), F.length("s") - turn)).alias("s"), (F.col("at") - F.col("__k")).alias("at"), "next",
            F.substring("__before", F.col("__k") + 1, F.lit(1)).alias("anchor"), (F.col("__k") > 0).alias("moved"), ((F.col("__n") > 0) & (F.col("__k") == F.col("__n"))).alias("more"),
        )
        moved = settle(moved.withColumn("next", F.when(F.col("moved"), F.left("s", F.lit(1))).otherwise(F.col("next"))))
        goes_on = F.col("more") & (F.col("at") > 0)
        closed = moved.where(~goes_on).select(*own, "s", "at", "next", F.when((F.col("at") > 0) & (F.col("anchor") != ""), F.col("anchor")).alias("anchor"))
        done = closed if done is None else done.unionByName(closed)
        open_ = moved.where(goes_on).select(*own, "s", "at", "next")
        if open_.isEmpty():
            return done


def normal_sites(sites: DataFrame, windows: DataFrame, width: int, check: bool = True) -> DataFrame:
    """(chrom, pos, ref, alt, npos, nref, nalt) for distinct sites: the same variant with the fewest bases, as far to the left as possible.

    check: sites whose ref isn't the reference's are dropped. Symbolic alleles, references without an alternative and alleles of other letters stay as they are; so do indels in front of which
    the windows have nothing. At a contig's start an indel is anchored at the base behind it.
    """
    sites = sites.select(*SITE).distinct()
    if check:
        sites = settle(matching(sites, windows, width))  # read by each of the branches below
    plain = F.col("alt").rlike("^[ACGTNacgtn]+$") & F.col("ref").rlike("^[ACGTNacgtn]+$") & (F.upper("ref") != F.upper("alt"))
    rows = sites.select(*SITE, F.upper("ref").alias("r"), F.upper("alt").alias("a"), F.coalesce(plain, F.lit(False)).alias("plain"))
    least = F.least(F.length("r"), F.length("a"))
    rows = rows.withColumn("tail", F.when(F.col("plain"), common_prefix(F.reverse("r"), F.reverse("a"), least)))
    gap = F.col("plain") & (F.col("tail") == least)

    # Substitutions: what both end with goes, then what both begin with but one base.
    cut = rows.where(F.col("plain") & ~gap).select(*SITE, F.expr("left(r, length(r) - tail)").alias("r"), F.expr("left(a, length(a) - tail)").alias("a"))
    cut = cut.withColumn("head", common_prefix(F.col("r"), F.col("a"), F.least(F.length("r"), F.length("a")) - 1))
    cut = cut.select(*SITE, (F.col("pos") + F.col("head")).alias("npos"), F.expr("substring(r, head + 1)").alias("nref"), F.expr("substring(a, head + 1)").alias("nalt"))
    same = rows.where(~F.col("plain")).select(*SITE, F.col("pos").alias("npos"), F.col("ref").alias("nref"), F.col("alt").alias("nalt"))

    longer = F.when(F.length("r") > F.length("a"), F.col("r")).otherwise(F.col("a"))
    indels = rows.where(gap).select(*SITE, (F.length("r") > F.length("a")).alias("gone"), longer.alias("w"), "tail", (F.col("pos") - 1).alias("at"))
    indels = indels.select(*SITE, "gone", F.expr("left(w, length(w) - tail)").alias("s"), "at", F.expr("substring(w, length(w) - tail + 1, 1)").alias("next"))
    moved = shifted(indels, windows, width)
    short = F.coalesce("anchor", "next")
    long = F.when(F.col("anchor").isNotNull(), F.concat("anchor", "s")).otherwise(F.concat("s", "next"))
    pos = F.when(F.col("anchor").isNotNull(), F.col("at")).otherwise(F.col("at") + 1)
    moved = moved.select(*SITE, pos.alias("npos"), F.when(F.col("gone"), long).otherwise(short).alias("nref"), F.when(F.col("gone"), short).otherwise(long).alias("nalt"))
    return cut.unionByName(same).unionByName(moved)


def normalise(calls: DataFrame, windows: DataFrame, width: int, check: bool = True) -> DataFrame:
    """Calls with their alleles in normal form, columns as they came; several alleles of a record must be split before.

    Each distinct site is worked out once and joined back. Records of one sample that become the same variant stay records of their own.
    """
    name = "normal"
    while name in calls.columns:
        name += "_"
    sites = normal_sites(calls, windows, width, check)
    joined = calls.join(sites.select(*SITE, F.struct("npos", "nref", "nalt").alias(name)), SITE)
    return joined.select(*[F.col(f"{name}.n{c}").alias(c) if c in ("pos", "ref", "alt") else F.col(f"`{c}`") for c in calls.columns])


def unite(calls: DataFrame) -> DataFrame:
    """One record for each sample and variant: the deepest, then the one with most alternative reads."""
    best = F.max(F.struct("dp", "ad")).alias("b")
    return calls.groupBy("sample", *SITE).agg(best).select("sample", *SITE, "b.dp", "b.ad")
