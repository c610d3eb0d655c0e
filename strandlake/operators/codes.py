"""Combinatorial codes: error correction of 45-mers, wells, conditions and read groups.

A 45-mer is D(8) o(4) C(8) o(4) B(8) o(4) A(8) o(1): four codes with constant overhangs between them, then one spacer base and the insert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the read layout: code positions, their 1-based offsets, the overhangs that follow them.
POSITIONS = ("D", "C", "B", "A")
OFFSETS = {"D": 1, "C": 13, "B": 25, "A": 37}
OVERHANGS = {"D": ("AGGA", 9), "C": ("ACTC", 21), "B": ("AAGG", 33), "A": ("A", 45)}
CODE, LENGTH = 8, 45
# Fixed values of the plate: which columns belong to a position.
COLUMNS = {"A": (1, 2, 3), "B": (4, 5, 6), "C": (7, 8, 9), "D": (10, 11, 12)}


def hamming(a: Column, b: Column, n: int = CODE) -> Column:
    """Number of places in which two strings of n characters differ; an error if their lengths differ."""
    places = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, i: s + (F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int"))
    return F.when(F.length(a) == F.length(b), places).otherwise(F.raise_error("strings of unequal length").cast("int"))


def correction_radius(whitelist: DataFrame) -> DataFrame:
    """(position, radius): two less than the least distance between two codes of a position, so corrections are unambiguous."""
    a, b = whitelist.alias("a"), whitelist.alias("b")
    pairs = a.join(b, (F.col("a.position") == F.col("b.position")) & (F.col("a.ord") < F.col("b.ord")))
    return pairs.groupBy(F.col("a.position").alias("position")).agg((F.min(hamming(F.col("a.seq"), F.col("b.seq"))) - 2).alias("radius"))


def neighbours(whitelist: DataFrame, alphabet: str = "ACGTN") -> DataFrame:
    """(position, observed, corrected, distance): every string within distance 1 of a code; ties go to the first code of the list."""
    letter = F.explode(F.array(*map(F.lit, alphabet))).alias("letter")
    changed = whitelist.select("position", "ord", "seq", F.explode(F.sequence(F.lit(1), F.lit(CODE))).alias("i")).select("*", letter).where(F.col("letter") != F.substring("seq", F.col("i"), F.lit(1)))
    observed = F.concat(F.substring("seq", F.lit(1), F.col("i") - 1), "letter", F.substring("seq", F.col("i") + 1, F.lit(CODE)))
    both = whitelist.select("position", "ord", "seq", F.col("seq").alias("observed"), F.lit(0).alias("distance")).unionByName(changed.select("position", "ord", "seq", observed.alias("observed"), F.lit(1).alias("distance")))
    best = F.min(F.struct("distance", "ord", "seq"))
    return both.groupBy("position", "observed").agg(best.alias("b")).select("position", "observed", F.col("b.seq").alias("corrected"), F.col("b.distance").alias("distance"))


def nearest(observed: Column, codes: Column) -> Column:
    """struct(distance, ord, seq) of the nearest of an array<struct<ord, seq>>, the first one on ties; for any radius."""
    return F.array_min(F.transform(codes, lambda c: F.struct(hamming(observed, c["seq"]).alias("distance"), c["ord"].alias("ord"), c["seq"].alias("seq"))))


def split_codes(df: DataFrame, seq: str = "seq2") -> DataFrame:
    """Adds the four observed codes and overhangs."""
    codes = {f"code_{p}": F.substring(seq, OFFSETS[p], CODE) for p in POSITIONS}
    overhangs = {f"overhang_{p}": F.substring(seq, at, len(o)) for p, (o, at) in OVERHANGS.items()}
    return df.withColumns(codes | overhangs)


def within(observed: DataFrame, whitelist: DataFrame, radius: int | None = None) -> DataFrame:
    """(position, observed, corrected, distance): observed strings (position, observed) whose nearest code is within the radius; ties go to the first code of the list.

    Strings with r wrong letters share one of r + 1 pieces with their code at least, in its place, so codes and strings are listed by pieces and meet in an equi-join; only
    what shares a piece is compared. radius: None takes each position's own (correction_radius), under 0 of which nothing matches, not even a code.
    """
    own = whitelist.select("position").distinct().withColumn("radius", F.lit(radius)) if radius is not None else correction_radius(whitelist)
    own = own.where("radius >= 0")

    def pieces(df: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        cut = F.transform(F.sequence(F.lit(0), F.col("radius")), lambda i: F.struct(i.alias("i"), F.substring(F.col(name), F.floor(i * n / (F.col("radius") + 1)).cast("int") + 1, (F.floor((i + 1) * n / (F.col("radius") + 1)) - F.floor(i * n / (F.col("radius") + 1))).cast("int")).alias("piece")))
        return df.join(own, "position").withColumn("p", F.explode(cut)).withColumns({"i": F.col("p.i"), "piece": F.col("p.piece"), "length": n}).drop("p")

    seen = pieces(observed.select("position", "observed").distinct(), "observed")
    listed = pieces(whitelist.select("position", "ord", "seq"), "seq").drop("radius")
    pairs = seen.join(listed, ["position", "length", "i", "piece"]).select("position", "observed", "radius", "length", "ord", "seq").distinct()
    places = F.aggregate(F.sequence(F.lit(1), F.col("length")), F.lit(0), lambda s, i: s + (F.substring(F.col("observed"), i, F.lit(1)) != F.substring(F.col("seq"), i, F.lit(1))).cast("int"))
    near = pairs.withColumn("distance", places).where("distance <= radius")
    return near.groupBy("position", "observed").agg(F.min(F.struct("distance", "ord", "seq")).alias("b")).select("position", "observed", F.col("b.seq").alias("corrected"), F.col("b.distance").alias("distance"))


def _laid_out(seq: str) -> Column:
    """Whether each overhang of a 45-mer has one letter at most other than its constant, in one expression: four of them behind the joins are a method too large to be compiled."""
    parts, at = [], 1
    for p in POSITIONS:
        constant, start = OVERHANGS[p]
        one = "|".join(constant[:k] + "[^\\n]" + constant[k + 1 :] for k in range(len(constant)))
        parts.append(f"(?s:.{{{start - at}}})(?:{one})")
        at = start + len(constant)
    return F.col(seq).rlike("^" + "".join(parts))


def correct(df: DataFrame, whitelist: DataFrame, ignore_overhangs: bool = False, seq: str = "seq2", qual: str | None = "qual2", radius: int | None = 1) -> DataFrame:
    """Adds ok, the corrected barcode (null if not ok), insert and its quality.

    Each code must lie within the radius of a whitelisted one and each overhang within distance 1 of its constant unless they are ignored. Reads shorter than a
    45-mer are not ok. With radius 1 the table of all neighbours is made once, on the driver: 33 strings for each whitelisted code, of which there are a few hundred (4^8 a
    position at most), and broadcast, so that reads stay where they are. With any other, or None for what each position's list allows, the distinct codes of the reads are looked up (within), which reads them twice.
    """
    laid = F.length(seq) >= LENGTH
    out = split_codes(df, seq).withColumn("__laid", laid if ignore_overhangs else laid & _laid_out(seq))
    if radius == 1:
        made = neighbours(whitelist)
        table = df.sparkSession.createDataFrame(made.collect(), made.schema)
    else:
        codes_ = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.col(f"code_{p}").alias("observed")) for p in POSITIONS]))
        table = within(out.select(codes_.alias("c")).select("c.*").where(F.length("observed") == CODE).distinct(), whitelist, radius)
    for p in POSITIONS:
        own = table.where(F.col("position") == p).select(F.col("observed").alias(f"code_{p}"), F.col("corrected").alias(f"fixed_{p}"))
        out = out.join(F.broadcast(own) if radius == 1 else own, f"code_{p}", "left")
    ok = F.col("__laid")
    for p in POSITIONS:
        ok = ok & F.col(f"fixed_{p}").isNotNull()
    barcode = F.concat(*[x for p in POSITIONS for x in (F.col(f"fixed_{p}"), F.lit(OVERHANGS[p][0]))])
    new = {"ok": F.coalesce(ok, F.lit(False)), "insert": F.substring(seq, LENGTH + 2, 1 << 30)}
    if qual:
        new["insert_qual"] = F.substring(qual, LENGTH + 2, 1 << 30)
    out = out.withColumns(new).withColumn("barcode", F.when(F.col("ok"), barcode))
    return out.select(*df.columns, "ok", "barcode", "insert", *(["insert_qual"] if qual else []))


def demux_stats(corrected: DataFrame) -> DataFrame:
    return corrected.agg(F.count("*").alias("total_reads"), F.count_if("ok").alias("mapped_reads")).withColumn("barcode_mapping_rate", F.coalesce(F.try_divide(F.col("mapped_reads").cast("double"), F.col("total_reads")), F.lit(0.0)))


def rejects(corrected: DataFrame) -> DataFrame:
    return corrected.where(~F.col("ok"))


def header(comment: str = "comment", barcode: str = "barcode") -> Column:
    """Comment of a corrected read: the sample index after the third colon, if there is one, and the barcode."""
    index = F.regexp_extract(F.coalesce(F.col(comment), F.lit("")), r"^[^:]*:[^:]*:[^:]*:(.+)$", 1)
    cb = F.concat(F.lit("CB:Z:"), F.col(barcode))
    return F.when(index != "", F.concat(F.lit("BC:Z:"), index, F.lit(" "), cb)).otherwise(cb)


def expand_wells(specs: DataFrame, plate: DataFrame, position: str) -> DataFrame:
    """(condition, ord, row, col, seq) for specs (condition, ord, spec) at a position.

    A number is a column, a letter a row of the position's three columns, a letter with a number one well. A spec that names no well of
    the position raises.
    """
    own = plate.where(F.col("col").isin(*COLUMNS[position]))
    s = F.upper(F.trim("spec"))
    row, col = F.regexp_extract(s, "^([A-H])", 1), F.regexp_extract(s, r"(\d+)$", 1)
    legal = s.rlike(r"^([A-H]|\d+|[A-H]\d+)$") & ((col == "") | col.isin(*map(str, COLUMNS[position])))
    parsed = specs.select("condition", "ord", F.when(legal, row).otherwise(F.raise_error(F.concat(F.lit("no such well: "), "spec"))).alias("want_row"), F.when(legal, col).alias("want_col"))
    match = ((F.col("want_row") == "") | (F.col("want_row") == F.col("row"))) & ((F.col("want_col") == "") | (F.col("want_col") == F.col("col").cast("string")))
    return parsed.join(own, match).select("condition", "ord", "row", "col", "seq")


def code_conditions(wells: DataFrame, strict: bool = False) -> DataFrame:
    """(seq, condition): one condition for each code; where several claim it the last wins, or strict raises."""
    out = wells.groupBy("seq").agg(F.max_by("condition", "ord").alias("condition"), F.count_distinct("condition").alias("claims"))
    if strict:
        out = out.withColumn("condition", F.when(F.col("claims") == 1, F.col("condition")).otherwise(F.raise_error(F.concat(F.lit("code of several conditions: "), "seq"))))
    return out.drop("claims")


def conflicts(wells: DataFrame) -> DataFrame:
    """Codes that several conditions claim."""
    return wells.groupBy("seq").agg(F.count_distinct("condition").alias("claims")).where("claims > 1")


def assign_conditions(df: DataFrame, conditions: DataFrame, position: str = "A", default: str = "Unassigned", barcode: str = "barcode") -> DataFrame:
    """Adds condition by the code at a position of each barcode."""
    seq = F.substring(barcode, OFFSETS[position], CODE)
    return df.withColumn("seq", seq).join(conditions, "seq", "left").withColumn("condition", F.coalesce("condition", F.lit(default))).drop("seq")


def condition_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("condition").agg(F.count("*").alias("n"))


def name_read_groups(df: DataFrame, key: str = "barcode", order: str = "ord") -> DataFrame:
    """(key, read_group): cell1, cell2, ... in the order in which keys are first seen; records without a key get none."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))
    return first.select(key, F.concat(F.lit("cell"), F.row_number().over(Window.orderBy("first", key)).cast("string")).alias("read_group"))
