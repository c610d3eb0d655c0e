"""Queries over gapped reads: pileup, normalised alleles, the sparse joint store, extrapolated complexity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import complexity
from strandlake.operators import alleles, joint, pileup

from .base import MATES_SQL, choose, exprs, mates, query, table
from .variant_queries import base_at

WIDTH, PERIOD = 1000, 280


def _reference(position: int) -> str:
    """base_at in Python, for the 280 bases after which it repeats."""
    return "ACGT"[position // 10 % 4] if position % 10 < 2 else "ACGT"[(position + position // 7) % 4]


#: 1-based positions 1 to 280, three times over, so that a read's bases are a part of this text.
_REF = "".join(_reference(p) for p in range(1, PERIOD + 1)) * 3
_K = "(l_linenumber + l_partkey + {m}) % 7"


def _at(shift: int, n: int) -> str:
    return f"substr('{_REF}', cast(1 + (pos0 + {shift}) % {PERIOD} AS int), {n})"


#: Operations of one read, and the bases that go with them: clips, gaps, a skipped stretch, and an insertion that could stand elsewhere.
SHAPES = [
    ("60M", _at(0, 60)),
    ("30M2D30M", f"concat({_at(0, 30)}, {_at(32, 30)})"),
    ("25M3I32M", f"concat({_at(0, 25)}, 'GAT', {_at(25, 32)})"),
    ("5S50M5H", f"concat('TTTTT', {_at(0, 50)})"),
    ("20M1200N40M", f"concat({_at(0, 20)}, {_at(1220, 40)})"),
    ("4S20M1D16=2I18M", f"concat('AAAA', {_at(0, 20)}, {_at(21, 16)}, 'CA', {_at(37, 18)})"),
    ("3I40M", f"concat('CCC', {_at(0, 40)})"),
]
_CLEAN = "CASE kind " + " ".join(f"WHEN {k} THEN {bases}" for k, (_, bases) in enumerate(SHAPES)) + " END"
QUALITIES = ["I" * 80, "I" * 20 + "#" * 5 + "F" * 55, "5" * 33 + "," * 9 + "I" * 38]


def _raw(m: int) -> dict[str, str]:
    return {
        "sample": "concat('s', cast(l_suppkey % 5 AS string))",
        "qname": "concat('p', cast(l_orderkey AS string), '_', cast(l_linenumber AS string), '_', cast(l_partkey AS string), '_', cast(l_suppkey AS string))",
        "chrom": "concat('chr', cast(1 + l_orderkey % 3 AS string))",
        "pos0": f"l_partkey * 10 + l_linenumber + {(m - 1)} * (l_orderkey % 80)",
        "flag": "cast(" + choose("l_orderkey % 13", [(99, 147)[m - 1], (1123, 1171)[m - 1], (83, 163)[m - 1], 4, (355, 403)[m - 1], (65, 129)[m - 1], *[(99, 147)[m - 1]] * 7]) + " AS int)",
        "mapq": "cast(l_quantity AS int)",
        "kind": _K.format(m=m),
        "wrong": f"(l_partkey + 3 * l_linenumber + {m}) % 50",
        "letter": "substr('ACGTN', cast(1 + (l_orderkey + l_partkey) % 5 AS int), 1)",
        "quals": choose(f"(l_orderkey + {m}) % 3", QUALITIES),
    }


_CIGAR = choose("kind", [c for c, _ in SHAPES])
#: Two mates of each template, with one changed base each in two of three.
FINAL = {
    "sample": "sample", "qname": "qname", "chrom": "chrom", "pos0": "pos0", "flag": "flag", "mapq": "mapq", "cigar": "cigar",
    "seq": "CASE WHEN wrong < 36 THEN concat(substr(clean, 1, cast(wrong AS int)), letter, substr(clean, cast(wrong + 2 AS int))) ELSE clean END",
    "qual": "substr(quals, 1, length(clean))",
}


def gapped(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("l_quantity"))
    both = lines.selectExpr(*exprs(_raw(1))).unionAll(lines.selectExpr(*exprs(_raw(2))))
    return both.selectExpr("*", f"{_CIGAR} AS cigar", f"{_CLEAN} AS clean").selectExpr(*exprs(FINAL))


GAPPED_SQL = f"""lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
drawn AS (SELECT {", ".join(exprs(_raw(1)))} FROM lines UNION ALL SELECT {", ".join(exprs(_raw(2)))} FROM lines),
shaped AS (SELECT *, {_CIGAR} AS cigar, {_CLEAN} AS clean FROM drawn), gapped AS (SELECT {", ".join(exprs(FINAL))} FROM shaped)"""


def wide_windows(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, bin, bases) over all positions that a gapped read may reach."""
    top = table(spark, d, "part").agg(F.floor((F.max("p_partkey") * 10 + 2000) / WIDTH).alias("last"))
    bins = top.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    contigs = table(spark, d, "orders").select(F.concat(F.lit("chr"), (1 + F.col("o_orderkey") % 3).cast("string")).alias("chrom")).distinct()
    return contigs.crossJoin(bins.select("bin", F.expr(f"substr('{_REF * 2}', cast(1 + (bin * {WIDTH} + {PERIOD - 1}) % {PERIOD} AS int), {WIDTH + 2})").alias("bases")))


#: Base by base: every aligned base of a usable read, then the two mates' view of it.
BASES_SQL = f"""{GAPPED_SQL}, used AS (SELECT * FROM gapped WHERE flag & 1796 = 0 AND (flag & 1 = 0 OR flag & 2 = 2)),
op AS (SELECT *, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS o, unnest(range(len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')))) AS k FROM used),
sized AS (SELECT *, o[-1:] AS c, o[:-2]::BIGINT AS n FROM op),
walked AS (SELECT *, pos0 + coalesce(sum(CASE WHEN c IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER before, 0)::BIGINT AS ref0, coalesce(sum(CASE WHEN c IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER before, 0)::BIGINT AS read0, lag(c) OVER (PARTITION BY qname, flag ORDER BY k) AS prior
  FROM sized WINDOW before AS (PARTITION BY qname, flag ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aligned AS (SELECT sample, qname, chrom, pos0, flag, seq, qual, ref0, read0, unnest(range(n)) AS i FROM walked WHERE c IN ('M', '=', 'X')),
base AS (SELECT sample, qname, chrom, ref0 + i AS p0, seq[read0 + i + 1] AS b, ascii(qual[read0 + i + 1]) - 33 AS q, flag & 128 AS mate FROM aligned),
seen AS (SELECT sample, qname, chrom, p0, count(*) AS n, list(b ORDER BY mate) AS bs, list(q ORDER BY mate) AS qs FROM base GROUP BY sample, qname, chrom, p0),
resolved AS (SELECT sample, qname, chrom, p0, CASE WHEN n = 1 OR qs[1] > qs[2] THEN bs[1] WHEN qs[1] < qs[2] THEN bs[2] ELSE least(bs[1], bs[2]) END AS b,
  CASE WHEN n = 1 THEN qs[1] WHEN bs[1] = bs[2] THEN least(qs[1] + qs[2], 93) ELSE floor(greatest(qs[1], qs[2]) * 4 / 5) END AS q FROM seen),
counted AS (SELECT * FROM resolved WHERE q >= 13 AND b IN ('A', 'C', 'G', 'T')), depth AS (SELECT sample, chrom, p0, count(*) AS dp FROM counted GROUP BY sample, chrom, p0)"""
_SPAN = "array_to_string(list_transform(range(p0 + 1, p0 + 2 + gone), lambda p: " + base_at("p") + "), '')"
PILEUP_SQL = f"""{BASES_SQL}, snv AS (SELECT sample, chrom, p0, {base_at("p0 + 1")} AS ref, b AS alt, count(*) AS ad FROM counted WHERE b <> {base_at("p0 + 1")} GROUP BY ALL),
gap AS (SELECT DISTINCT sample, qname, chrom, ref0 - 1 AS p0, CASE WHEN c = 'D' THEN n ELSE 0 END AS gone, CASE WHEN c = 'I' THEN substr(seq, read0 + 1, n) ELSE '' END AS more
  FROM walked WHERE c IN ('I', 'D') AND prior IN ('M', '=', 'X') AND ascii(qual[read0]) - 33 >= 13),
indel AS (SELECT sample, chrom, p0, {_SPAN} AS ref, concat({base_at("p0 + 1")}, more) AS alt, count(*) AS ad FROM gap GROUP BY ALL),
piled AS (SELECT sample, chrom, p0 + 1 AS pos, ref, alt, coalesce(dp, 0) AS dp, ad FROM (SELECT * FROM snv UNION ALL SELECT * FROM indel) LEFT JOIN depth USING (sample, chrom, p0))"""


@query("q67_gapped_pileup", f"WITH {PILEUP_SQL} SELECT sample, chrom, pos, ref, alt, dp, ad FROM piled")
def q67(spark: SparkSession, d: str) -> DataFrame:
    return pileup.pileup(gapped(spark, d), wide_windows(spark, d), WIDTH)


_SITE_REF = lambda shift, n: f"substr('{_REF}', cast(1 + (pos0 + {shift}) % {PERIOD} AS int), cast({n} AS int))"
#: The same variants written in many ways: bases before and behind them, copies of what stands before, and some references that are wrong.
WRITTEN = {
    "sample": "concat('s', cast(l_suppkey % 5 AS string))",
    "chrom": "concat('chr', cast(1 + l_orderkey % 3 AS string))",
    "pos0": "l_partkey * 10 + l_linenumber + 280",
    "n": "1 + l_quantity % 6",
    "kind": "(l_linenumber + l_partkey) % 6",
    "dp": "cast(l_quantity AS bigint) + 5",
    "ad": "cast(floor((l_quantity + 5) * l_discount * 10) AS bigint)",
}
ALLELES = {
    "ref": f"CASE kind WHEN 0 THEN {_SITE_REF(0, 'n + 1')} WHEN 1 THEN {_SITE_REF(0, 'n + 3')} WHEN 2 THEN {_SITE_REF(0, '1')} WHEN 3 THEN {_SITE_REF(0, 'n + 2')} WHEN 4 THEN {_SITE_REF(0, '4')} ELSE {_SITE_REF(0, 'n')} END",
    "alt": f"CASE kind WHEN 0 THEN {_SITE_REF(0, '1')} WHEN 1 THEN {_SITE_REF('n', '3')} WHEN 2 THEN concat({_SITE_REF(0, '1')}, {_SITE_REF('1 - n', 'n')}) WHEN 3 THEN concat({_SITE_REF(0, 'n + 1')}, {_SITE_REF('1', 'n + 1')}) WHEN 4 THEN concat({_SITE_REF(0, '1')}, 'T', {_SITE_REF(2, '2')}) ELSE concat('A', {_SITE_REF(1, 'n')}) END",
}


def written(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(*exprs(WRITTEN)).selectExpr("sample", "chrom", "pos0", "n", "dp", "ad", "kind", *exprs(ALLELES))
    wrong = "CASE WHEN (pos0 + dp) % 17 = 0 THEN concat('N', substr(ref, 2)) ELSE ref END AS ref"
    return rows.selectExpr("sample", "chrom", "pos0 + 1 AS pos", wrong, "alt", "dp", "ad")


_TWO = f"list_transform(range(0, length(ref)), lambda i: {base_at('pos + i')})"
#: One base at a time: drop a common last base, or take the base before where an allele is empty; then drop common first bases.
NORMAL_SQL = f"""raw AS (SELECT {", ".join(exprs(WRITTEN))} FROM lineitem),
spelt AS (SELECT sample, chrom, pos0 + 1 AS pos, dp, ad, kind, {", ".join(exprs(ALLELES))}, pos0 FROM raw),
marked AS (SELECT sample, chrom, pos, CASE WHEN (pos0 + dp) % 17 = 0 THEN concat('N', substr(ref, 2)) ELSE ref END AS ref, alt, dp, ad FROM spelt),
site AS (SELECT DISTINCT chrom, pos, ref, alt FROM marked), held AS (SELECT * FROM site WHERE array_to_string({_TWO}, '') = ref),
step AS (
  SELECT chrom, pos, ref, alt, pos AS p, ref AS r, alt AS a, ref <> alt AS more FROM held
  UNION ALL
  SELECT chrom, pos, ref, alt, CASE WHEN empty THEN p - 1 ELSE p END, CASE WHEN empty THEN concat({base_at("p - 1")}, r2) ELSE r2 END, CASE WHEN empty THEN concat({base_at("p - 1")}, a2) ELSE a2 END, empty OR r2 <> r
  FROM (SELECT *, r2 = '' OR a2 = '' AS empty FROM (SELECT *, CASE WHEN r[-1:] = a[-1:] THEN r[:-2] ELSE r END AS r2, CASE WHEN r[-1:] = a[-1:] THEN a[:-2] ELSE a END AS a2 FROM step WHERE more))
),
ended AS (SELECT * FROM step WHERE NOT more),
lead AS (SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, least(length(r), length(a))) t(i) WHERE r[:i] = a[:i] AND r <> a) AS k FROM ended),
normal AS (SELECT chrom, pos, ref, alt, p + k AS npos, substr(r, k + 1) AS nref, substr(a, k + 1) AS nalt FROM lead)"""


@query("q68_normalised_alleles", f"""WITH RECURSIVE {NORMAL_SQL}
SELECT sample, chrom, pos, ref, alt, dp, ad FROM (
  SELECT sample, n.chrom, npos AS pos, nref AS ref, nalt AS alt, dp, ad, row_number() OVER (PARTITION BY sample, n.chrom, npos, nref, nalt ORDER BY dp DESC, ad DESC) AS k
  FROM marked m JOIN normal n ON m.chrom = n.chrom AND m.pos = n.pos AND m.ref = n.ref AND m.alt = n.alt) WHERE k = 1""")  # fmt: skip
def q68(spark: SparkSession, d: str) -> DataFrame:
    return alleles.unite(alleles.normalise(written(spark, d), wide_windows(spark, d), WIDTH))


def _bin(expr: str) -> str:
    return f"cast(floor(({expr}) / {WIDTH}) AS bigint)"


#: Blocks of covered positions in each bin, of which the first class ends at depth 4.
BLOCKS_SQL = f"""lain AS (SELECT sample, chrom, p0, dp, {_bin("p0")} AS bin, dp >= 5 AS level FROM depth),
island AS (SELECT *, p0 - row_number() OVER (PARTITION BY sample, chrom, bin, level ORDER BY p0) AS k FROM lain),
block AS (SELECT sample, chrom, bin, min(p0) AS pos0, max(p0) + 1 AS pos1, min(dp) AS min_dp FROM island GROUP BY sample, chrom, bin, level, k)"""


@query("q71_reference_blocks", f"WITH {BASES_SQL}, {BLOCKS_SQL} SELECT sample, chrom, bin, pos0, pos1, min_dp FROM block")
def q71(spark: SparkSession, d: str) -> DataFrame:
    return pileup.covered_blocks(gapped(spark, d), WIDTH, (1, 5))


@query("q72_joint_genotypes", f"""WITH {PILEUP_SQL}, {BLOCKS_SQL}, site AS (SELECT DISTINCT chrom, pos, ref, alt FROM piled),
unseen AS (SELECT b.sample, s.chrom, s.pos, s.ref, s.alt, min_dp AS dp, 0 AS ad FROM site s JOIN block b ON s.chrom = b.chrom AND s.pos - 1 >= b.pos0 AND s.pos - 1 < b.pos1 ANTI JOIN piled p ON b.sample = p.sample AND s.chrom = p.chrom AND s.pos = p.pos AND s.ref = p.ref AND s.alt = p.alt)
SELECT sample, chrom, pos, ref, alt, dp, ad FROM piled UNION ALL SELECT * FROM unseen""")  # fmt: skip
def q72(spark: SparkSession, d: str) -> DataFrame:
    # Genotypes read alleles and blocks several times, and both come from the same checkpoint.
    found, blocks = pileup.pileup_and_blocks(gapped(spark, d), wide_windows(spark, d), WIDTH, (1, 5))
    return joint.genotypes(found.withColumn("bin", F.floor((F.col("pos") - 1) / WIDTH)), blocks)


_PLACES = ["chrom", "pos0", "cigar"]


@query("q69_counts_of_counts", f"WITH {MATES_SQL}, f AS (SELECT cell, chrom, pos0, cigar, count(*) AS seen FROM mates GROUP BY ALL) SELECT cell, seen, count(*) AS molecules FROM f GROUP BY ALL")
def q69(spark: SparkSession, d: str) -> DataFrame:
    return complexity.counts_of_counts(mates(spark, d), "cell", _PLACES)


@query("q70_extrapolated_complexity")
def q70(spark: SparkSession, d: str) -> DataFrame:
    return complexity.extrapolate(complexity.counts_of_counts(mates(spark, d), "cell", _PLACES), "cell", 1000, 20_000)
