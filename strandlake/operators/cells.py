"""Calling cells among barcodes and labelling them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordmag(counts: DataFrame, quantile: float = 0.99, ratio: float = 10.0) -> DataFrame:
    """One row (x, m, o, loss): the number of cells that minimises (o(x) - x)^2 / x.

    m(x) is the `quantile` of the x largest counts (linear interpolation), o(x) the number of counts of at least m(x) / ratio. All x from 1 to n are
    tried and the smallest wins ties. o(x) comes from one running count over counts and thresholds together, not from a range join.
    """
    down = Window.orderBy(F.desc("read_count"), "barcode")
    v = counts.withColumn("x", F.row_number().over(down)).select("x", F.col("read_count").cast("double").alias("v"))
    h = (1 - quantile) * (F.col("x") - 1)
    k = F.floor(h)
    at = v.select("x", (k + 1).alias("lo"), F.least(k + 2, F.col("x")).alias("hi"), (h - k).alias("f"))
    low, high = v.select(F.col("x").alias("lo"), F.col("v").alias("vl")), v.select(F.col("x").alias("hi"), F.col("v").alias("vh"))
    m = at.join(low, "lo").join(high, "hi").select("x", (F.col("vl") + F.col("f") * (F.col("vh") - F.col("vl"))).alias("m"))
    both = v.select(F.col("v").alias("key"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("double").alias("m")).unionAll(m.select(F.col("m") / ratio, F.lit(0), "x", "m"))
    o = F.sum("n").over(Window.orderBy(F.desc("key")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    scored = both.withColumn("o", o).where("x is not null").withColumn("loss", F.pow(F.col("o") - F.col("x"), F.lit(2.0)) / F.col("x"))
    best = scored.agg(F.min(F.struct("loss", "x", "m", "o")).alias("b"))
    return best.select(F.col("b.x").cast("long").alias("x"), "b.m", F.col("b.o").cast("long").alias("o"), "b.loss")


def call_cells(counts: DataFrame, quantile: float = 0.99, ratio: float = 10.0) -> DataFrame:
    """Barcodes with at least m(x*) / ratio reads."""
    best = ordmag(counts, quantile, ratio).select("m")
    return counts.crossJoin(F.broadcast(best)).where(F.col("read_count") >= F.col("m") / ratio).drop("m")


def top_cells(counts: DataFrame, n: int) -> DataFrame:
    """The n barcodes with most reads; ties by barcode."""
    return counts.orderBy(F.desc("read_count"), "barcode").limit(n)


def knee(counts: DataFrame, conditions: DataFrame | None = None, default: str = "Unassigned") -> DataFrame:
    """Rank (1 = most reads), barcode, count and, if given, condition."""
    out = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("read_count"), "barcode")))
    if conditions is not None:
        out = out.join(conditions, "barcode", "left").withColumn("condition", F.coalesce("condition", F.lit(default)))
    return out


def mark_real(counts: DataFrame, k: int = 250) -> DataFrame:
    return knee(counts).withColumn("is_cell", F.col("rank") <= k)


def species_call(counts: DataFrame, cells: DataFrame, low: float = 0.2, high: float = 25.0) -> DataFrame:
    """Label by human to mouse ratio: above `high` human, below `low` mouse, else mixed; both 0 has none; no cell: empty droplet."""
    is_cell = counts.join(cells.select("barcode").distinct().withColumn("__cell", F.lit(True)), "barcode", "left")
    ratio = F.try_divide(F.col("human_count").cast("double"), F.col("mouse_count"))
    label = (
        F.when(F.col("__cell").isNull(), "empty droplet")
        .when((F.col("human_count") == 0) & (F.col("mouse_count") == 0), F.lit(None))
        .when(F.col("mouse_count") == 0, "human")
        .when(ratio > high, "human").when(ratio < low, "mouse").otherwise("mixed")
    )
    return is_cell.withColumn("species", label).drop("__cell")


def last_code(barcode: Column) -> Column:
    """The code at the end of a 45-mer (before its last base)."""
    return F.substring(barcode, 37, 8)


def amplification_label(cells: DataFrame, methods: DataFrame) -> DataFrame:
    """Adds `method` by the last code; null if it is in no list."""
    return cells.withColumn("seq", last_code(F.col("barcode"))).join(methods, "seq", "left").drop("seq")


def best_k(df: DataFrame, by: list[str], value: str, key: str, k: int = 6) -> DataFrame:
    """The k rows of least value in each group, ties by key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(value, key))).where(F.col("place") <= k)


def numbered(df: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """Adds rn, the place from 0 in ascending order over the whole table, without a window over all rows: ranges of the first column, cut at its
    approximate quantiles, are numbered by themselves and begin where the ones before end. The first column is a number."""
    cuts = df.agg(F.percentile_approx(order[0], [k / parts for k in range(1, parts)]).alias("q")).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order[0]))) if cuts else F.lit(0)
    rows = df.withColumn("__part", F.coalesce(bucket, F.lit(0)))
    sizes = rows.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    sizes = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = rows.join(sizes, F.col("__part") == F.col("__p"))
    return placed.withColumn("rn", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__before")).select(*df.columns, "rn")


def systematic(df: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """Every max(1, n div most)-th row in the order."""
    step = df.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") / most)).alias("step"))
    return numbered(df, order).crossJoin(step).where(F.col("rn") % F.col("step") == 0).drop("step")
