"""Pileup of gapped reads: alleles with their depths, from CIGAR walks, mates resolved once, and depth by a sweep inside bins.

The records of a template meet in one task, where numpy walks them and resolves what both mates saw, so that it counts once (module `sweep`). What counts travels
packed to its bin, 2 bits a base, and is counted there beside the bin's reference window; only bases that differ from the reference become rows.

`blocks` to `depth_runs` say the same as column expressions, base by base or as strings: a read becomes blocks of aligned bases ('-' where it has a deletion; skipped
stretches end a block), cut at bin borders, and the blocks of a template in a bin are folded into one. They are what the sweep is tested against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweep
from .reads import DUPLICATE, PAIRED, PROPER, QC_FAIL, SECONDARY, UNMAPPED, has, lacks
from .rounds import settle

_END = "\x01"
_BASES = ("A", "C", "G", "T")


def operations(cigar: Column, pos0: Column) -> Column:
    """Array of (op, n, ref, read): each operation with the reference position and the read offset (from 0) where it begins."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    pairs = F.zip_with(ops, lengths, lambda o, n: F.struct(o.alias("op"), n.cast("long").alias("n")))
    none = F.array().cast("array<struct<op:string,n:bigint,ref:bigint,read:bigint>>")

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["op"].alias("op"), x["n"].alias("n"), s["ref"].alias("ref"), s["read"].alias("read"))
        ref = s["ref"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0)
        read = s["read"] + F.when(x["op"].isin("M", "I", "S", "=", "X"), x["n"]).otherwise(0)
        return F.struct(ref.alias("ref"), read.alias("read"), F.concat(s["out"], F.array(here)).alias("out"))

    return F.aggregate(pairs, F.struct(pos0.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), none.alias("out")), step, lambda s: s["out"])


def primary(reads: DataFrame, least_mapq: int = 0) -> DataFrame:
    """Mapped primary records that are neither duplicates nor failed; of paired ones only proper pairs."""
    keep = lacks("flag", UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE) & (lacks("flag", PAIRED) | has("flag", PROPER))
    return reads.where(keep & (F.col("mapq") >= least_mapq))


def usable(reads: DataFrame, least_mapq: int = 0) -> DataFrame:
    """`primary` without the records that have no sequence or CIGAR."""
    return primary(reads, least_mapq).where(F.col("cigar").rlike(r"^(\d+[MIDNSHP=X])+$") & (F.col("seq") != "*"))


def walked(reads: DataFrame) -> DataFrame:
    """(sample, qname, chrom, seq, qual, pos0, ops); absent qualities are the greatest. Records whose CIGAR needs more or fewer bases than they have go."""
    qual = F.when(F.coalesce(F.col("qual"), F.lit("*")) == "*", F.repeat(F.lit("~"), F.length("seq"))).otherwise(F.col("qual"))
    rows = reads.select("sample", "qname", "chrom", F.upper("seq").alias("seq"), qual.alias("qual"), "pos0", operations(F.col("cigar"), F.col("pos0")).alias("ops"))
    needs = F.aggregate("ops", F.lit(0).cast("long"), lambda s, o: s + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["n"]).otherwise(0))
    return rows.where((needs == F.length("seq")) & (F.length("qual") == F.length("seq")))


def blocks(walks: DataFrame, width: int) -> DataFrame:
    """(sample, qname, chrom, bin, start, b, q): aligned bases and qualities without skipped stretches, cut at multiples of width."""
    aligned, gap, skip = (lambda o: o["op"].isin("M", "=", "X")), (lambda o: o["op"] == "D"), (lambda o: o["op"] == "N")

    def laid(text: str, fill: str) -> Column:
        piece = lambda o: F.when(aligned(o), F.substring(F.col(text), (o["read"] + 1).cast("int"), o["n"].cast("int"))).when(gap(o), F.repeat(F.lit(fill), o["n"].cast("int"))).when(skip(o), F.lit(_END)).otherwise("")
        return F.split(F.array_join(F.transform("ops", piece), ""), _END, -1)

    starts = F.concat(F.array(F.col("pos0").cast("long")), F.transform(F.filter("ops", skip), lambda o: o["ref"] + o["n"]))
    rows = walks.select("sample", "qname", "chrom", F.explode(F.arrays_zip(starts.alias("start"), laid("seq", "-").alias("b"), laid("qual", "!").alias("q"))).alias("x"))
    rows = rows.select("sample", "qname", "chrom", "x.start", "x.b", "x.q").where("b <> ''")
    rows = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.length("b") - 1) / width))))
    first = F.greatest(F.col("bin") * width, "start")
    at, n = (first - F.col("start") + 1).cast("int"), (F.least((F.col("bin") + 1) * width, F.col("start") + F.length("b")) - first).cast("int")
    return rows.select("sample", "qname", "chrom", "bin", first.alias("start"), F.substring("b", at, n).alias("b"), F.substring("q", at, n).alias("q"))


def _chars(b: Column, q: Column) -> Column:
    return F.zip_with(F.split(b, ""), F.split(q, ""), lambda x, y: F.struct(x.alias("b"), y.alias("q")))


def _both(u: Column, v: Column) -> Column:
    """What two mates say of one base: qualities add up where they agree; else the better one stays with four fifths of its own (ties: the lesser letter)."""
    a, b = F.ascii(u["q"]) - 33, F.ascii(v["q"]) - 33
    same = F.struct(u["b"].alias("b"), F.char(F.least(a + b, F.lit(93)) + 33).alias("q"))
    first = F.struct(u["b"].alias("b"), F.char(F.floor(a * 4 / 5) + 33).alias("q"))
    other = F.struct(v["b"].alias("b"), F.char(F.floor(b * 4 / 5) + 33).alias("q"))
    return F.when(u["b"] == "-", v).when(v["b"] == "-", u).when(u["b"] == v["b"], same).when((a > b) | ((a == b) & (u["b"] < v["b"])), first).otherwise(other)


def _fold(s: Column, x: Column) -> Column:
    """The canvas s (start, b, q) with a block laid over it that doesn't begin before it."""
    here, end, its = (x["start"] - s["start"]).cast("int"), F.length(s["b"]), F.length(x["b"])
    shared = F.least(end - here, its)
    apart = F.struct(s["start"].alias("start"), F.concat(s["b"], F.repeat(F.lit("-"), here - end), x["b"]).alias("b"), F.concat(s["q"], F.repeat(F.lit("!"), here - end), x["q"]).alias("q"))
    part = lambda t, at, n: F.substring(t, at + 1, n)
    middle = F.zip_with(_chars(part(s["b"], here, shared), part(s["q"], here, shared)), _chars(part(x["b"], F.lit(0), shared), part(x["q"], F.lit(0), shared)), _both)
    rest = lambda c: F.when(end - here >= its, part(s[c], here + shared, end)).otherwise(part(x[c], shared, its))
    over = lambda c, both: F.concat(part(s[c], F.lit(0), here), F.array_join(F.transform(both, lambda m: m[c]), ""), rest(c)).alias(c)
    # The shared bases are resolved once for both texts.
    laid = F.transform(F.array(middle), lambda both: F.struct(s["start"].alias("start"), over("b", both), over("q", both)))
    return F.when(here >= end, apart).otherwise(laid[0])


def templates(cut: DataFrame) -> DataFrame:
    """(sample, chrom, bin, start, b, q): one row for each template and bin. What comes out of two mates doesn't depend on which is first."""
    one = F.struct("start", "b", "q")
    grouped = cut.groupBy("sample", "qname", "chrom", "bin").agg(F.sort_array(F.collect_list(one)).alias("list"))
    head = F.col("list")[0]
    whole = F.aggregate(F.slice("list", F.lit(2), F.size("list")), F.struct(head["start"].alias("start"), head["b"].alias("b"), head["q"].alias("q")), _fold)
    folded = F.when(F.size("list") == 1, F.struct(head["start"].alias("start"), head["b"].alias("b"), head["q"].alias("q"))).otherwise(whole)
    return grouped.select("sample", "chrom", "bin", folded.alias("t")).select("sample", "chrom", "bin", "t.start", "t.b", "t.q")


def counted(canvas: DataFrame, least_quality: int) -> DataFrame:
    """Adds mask: 1 for each base that counts (A, C, G or T of the quality at least), 0 for others."""
    bases = F.translate(F.regexp_replace("b", f"[^{''.join(_BASES)}]", "0"), "".join(_BASES), "1" * len(_BASES))
    if least_quality <= -33:
        return canvas.withColumn("mask", bases)
    # Stretches of low and of sufficient quality, a few for each read, instead of base by base.
    low = f"\\x{{0}}-\\x{{{32 + least_quality:x}}}"
    runs = F.regexp_extract_all("q", F.lit(f"[{low}]+|[^{low}]+"), F.lit(0))
    step = lambda s, r: F.struct(
        (s["at"] + F.length(r)).alias("at"), F.concat(s["out"], F.when(F.ascii(r) - 33 < least_quality, F.repeat(F.lit("0"), F.length(r))).otherwise(F.substring("__bases", s["at"], F.length(r)))).alias("out")
    )
    mask = F.aggregate(runs, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])
    return canvas.withColumn("__bases", bases).withColumn("mask", mask).drop("__bases")


def depth_steps(canvas: DataFrame) -> DataFrame:
    """(sample, chrom, bin, pos0, step): by how much depth changes at a position, within each bin; places without a change are left out."""
    runs = F.regexp_extract_all("mask", F.lit("1+|0+"), F.lit(0))
    begin = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,step:int>>").alias("out")), lambda s, r: F.struct(
        (s["at"] + F.length(r)).alias("at"),
        F.when(r.startswith("1"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), F.lit(1).alias("step")), F.struct((s["at"] + F.length(r)).alias("at"), F.lit(-1).alias("step"))))).otherwise(s["out"]).alias("out"),
    ), lambda s: s["out"])
    steps = canvas.select("sample", "chrom", "bin", "start", F.explode(begin).alias("e"))
    return steps.groupBy("sample", "chrom", "bin", (F.col("start") + F.col("e.at")).alias("pos0")).agg(F.sum("e.step").alias("step")).where("step <> 0")


def depth_runs(steps: DataFrame) -> DataFrame:
    """(sample, chrom, bin, pos0, pos1, depth) of covered stretches of equal depth within each bin."""
    w = Window.partitionBy("sample", "chrom", "bin").orderBy("pos0")
    runs = steps.select("sample", "chrom", "bin", "pos0", F.lead("pos0").over(w).alias("pos1"), F.sum("step").over(w).alias("depth"))
    return runs.where("depth > 0")


def reference_bases(spans: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(chrom, pos0, length, bases) for distinct spans (chrom, pos0, length) that lie in the windows whole, across their borders too."""
    cut = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos0") / width), F.floor((F.col("pos0") + F.col("length") - 1) / width))))
    first = F.greatest(F.col("bin") * width, "pos0")
    n = F.least((F.col("bin") + 1) * width, F.col("pos0") + F.col("length")) - first
    piece = F.substring("bases", (first - F.col("bin") * width + 2).cast("int"), n.cast("int"))
    parts = cut.join(windows, ["chrom", "bin"]).select("chrom", "pos0", "length", "bin", piece.alias("piece"))
    whole = parts.groupBy("chrom", "pos0", "length").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bin", "piece"))), lambda x: x["piece"]), "").alias("bases"))
    return whole.where(F.length("bases") == F.col("length"))


def _packs(reads: DataFrame, width: int, least_quality: int, least_mapq: int) -> DataFrame:
    """Counted bases and indels of `reads`, a template's records side by side in one task, by (sample, chrom, bin): rows of `sweep.PACKED`."""
    # Sequences, qualities and CIGARs are checked by numpy: a filter on them would spell them out once more where they are expressions.
    rows = primary(reads, least_mapq).where("pos0 is not null").select("sample", "qname", "chrom", F.col("pos0").cast("long").alias("pos0"), "cigar", F.upper("seq").alias("seq"), "qual")
    rows = rows.repartition("sample", "qname", "chrom").sortWithinPartitions(F.xxhash64("sample", "qname", "chrom"), "sample", "qname", "chrom")
    return rows.mapInArrow(sweep.packing(width, least_quality), sweep.PACKED)


def _swept(packs: DataFrame, windows: DataFrame | None, width: int, classes: tuple[int, ...] | None = None, runs: bool = False) -> DataFrame:
    """All packs of a bin meet its window in one task, which counts them: rows of `sweep.SWEPT`."""
    if windows is not None:
        window = windows.select(F.lit(None).cast("string").alias("sample"), "chrom", F.col("bin").cast("long").alias("bin"), F.lit(sweep.WINDOW).alias("kind"), F.col("bases").alias("more"))
        packs = packs.unionByName(window, allowMissingColumns=True)
    place = F.xxhash64("chrom", "bin")
    dealt = packs.repartition("chrom", "bin").sortWithinPartitions(place, "chrom", "bin", F.col("sample").asc_nulls_first(), "kind")
    return dealt.mapInArrow(sweep.sweeping(width, classes, runs), sweep.SWEPT)


def _alleles(swept: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Alleles of a settled sweep; deletions that reach beyond their window get their reference bases from all windows they lie in."""
    rows = swept.where(F.col("kind") == "allele").withColumn("pos", F.col("pos0") + 1)
    columns = ["sample", "chrom", "pos", "ref", "alt", "dp", "ad"]
    across = rows.where("ref is null")
    spans = across.select("chrom", "pos0", (F.col("gone") + 1).alias("length")).distinct()
    bases = reference_bases(spans, windows, width).select("chrom", "pos0", (F.col("length") - 1).alias("gone"), "bases")
    joined = across.join(bases, ["chrom", "pos0", "gone"]).withColumn("ref", F.col("bases")).withColumn("alt", F.concat(F.left("bases", F.lit(1)), "alt"))
    return rows.where("ref is not null").select(*columns).unionByName(settle(joined.select(*columns)))


def covered_runs(reads: DataFrame, width: int, least_quality: int = 13, least_mapq: int = 0) -> DataFrame:
    """(sample, chrom, bin, pos0, pos1, depth) of the stretches of equal depth that pileup counts, cut at multiples of width."""
    return _swept(_packs(reads, width, least_quality, least_mapq), None, width, runs=True).select("sample", "chrom", "bin", "pos0", "pos1", F.col("dp").alias("depth"))


def covered_blocks(reads: DataFrame, width: int, classes: tuple[int, ...] = (1,), least_quality: int = 13, least_mapq: int = 0) -> DataFrame:
    """`joint.reference_blocks` of `covered_runs`, made where depth is counted, so that runs are never rows."""
    return _blocks(_swept(_packs(reads, width, least_quality, least_mapq), None, width, classes))


def _blocks(swept: DataFrame) -> DataFrame:
    return swept.where(F.col("kind") == "block").select("sample", "chrom", "bin", "pos0", "pos1", F.col("dp").alias("min_dp"))


def pileup(reads: DataFrame, windows: DataFrame, width: int, least_quality: int = 13, least_mapq: int = 0) -> DataFrame:
    """(sample, chrom, pos, ref, alt, dp, ad) of every allele other than the reference that a template shows; pos is 1-based.

    reads: (sample, qname, chrom, pos0, flag, mapq, cigar, seq, qual); windows: (chrom, bin, bases) of `width` bases with one more on either side. dp counts templates with an
    aligned base of the quality at least at the position (deleted and skipped bases don't count); for indels it is that of the anchor, which must be an aligned base of the quality
    at least. Indels are as the reads have them, not yet aligned to the left. Positions without a reference base go.
    """
    return _alleles(settle(_swept(_packs(reads, width, least_quality, least_mapq), windows, width)), windows, width)


def pileup_and_blocks(reads: DataFrame, windows: DataFrame, width: int, classes: tuple[int, ...] = (1,), least_quality: int = 13, least_mapq: int = 0) -> tuple[DataFrame, DataFrame]:
    """`pileup` and `covered_blocks` of the same reads, counted once; both read one checkpoint."""
    swept = settle(_swept(_packs(reads, width, least_quality, least_mapq), windows, width, classes))
    return _alleles(swept, windows, width), _blocks(swept)
