"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document d of a source gets a rate w_d in (0, cap), its expected number of copies. Among all rates that
give the source its target of words, those nearest to one copy each in the bounded (Fermi) relative entropy are
w_d = cap / (1 + (cap - 1) exp(-lambda x_d)), x_d being the document's size over its source's mean: rates tilted
exponentially in the odds w / (cap - w). The multiplier of each source is the root of the gradient of a convex dual,
found by Newton steps kept inside a bracket. A step is one distributed sum over a histogram of sizes. Rates are then
rounded to whole copies: size classes in descending order, each taking up what the ones before it left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (5, 2, 1), 3
#: Newton steps at most; the bracket is halved where a step would leave it, so this many reach full precision.
STEPS = 80
#: Classes of the largest sizes that are rounded one after the other in each source; smaller sizes are rounded side by side.
SEQUENTIAL = 512
#: Documents of one class (source, size) that are ranked together, about.
CLASS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) for every row; null text has size 0, h identifies the row's id and text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_key().alias("h"))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh `weights`, repeating. Shares of the total stop at cap times the source's size and the
    excess goes to the others by weight until none is above: the level L with sum of min(cap size, weight L) equal to the total.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("at"))
    first = F.min(fits).over(Window.partitionBy())
    chosen = F.max(F.when(F.col("at") == first, F.col("level"))).over(Window.partitionBy())
    target = F.when(chosen.isNull() | (F.col("at") < first), F.col("most")).otherwise(F.col("weight") * chosen)
    return rows.select("source", "source_size", target.alias("target"))


def rate(lam: Column, x: Column, cap: int = CAP) -> Column:
    return cap / (1 + (cap - 1) * F.exp(-lam * x))


def solve(histogram: DataFrame, goals: DataFrame, scratch: Scratch, cap: int = CAP, tolerance: float = 1e-9) -> DataFrame:
    """(source, source_size, target, mean, lam): each source's multiplier, null where it takes nothing or everything.

    Sums are decimals, so they don't depend on the order of addition and reruns agree.
    """
    means = histogram.where("size > 0").groupBy("source").agg((F.sum(F.col("c") * F.col("size")).cast("double") / F.sum("c")).alias("mean"))
    state = goals.join(means, goals.source.eqNullSafe(means.source), "left").select(goals.source, "source_size", "target", "mean")
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
    state = scratch.save(state.select("*", F.when(open_, F.lit(0.0)).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(1.0).alias("off")))
    for _ in range(STEPS):
        s = state.select("source", "target", "mean", "lam").where("lam is not null")
        x = F.col("size") / F.col("mean")
        w = rate(F.col("lam"), x, cap)
        words = F.col("c") * F.col("size").cast("double")
        sums = (
            histogram.join(s, histogram.source.eqNullSafe(s.source)).where("size > 0")
            .groupBy(s.source.alias("key"))
            .agg(F.sum((words * w).cast("decimal(28,6)")).cast("double").alias("got"), F.sum((words * x * w * (cap - w) / cap).cast("decimal(28,6)")).cast("double").alias("slope"))
        )
        j = state.join(sums, state.source.eqNullSafe(F.col("key")), "left")
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(gap, F.col("slope"))
        inside = (step > lo) & (step < hi)
        new = F.when(gap == 0, F.col("lam")).when(inside, step).otherwise((lo + hi) / 2)
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        old, state = state, scratch.save(j.select("source", "source_size", "target", "mean", F.when(F.col("lam").isNotNull(), F.when(off <= tolerance, F.col("lam")).otherwise(new)).alias("lam"), F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi"), off.alias("off")))
        scratch.drop(old)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("source", "source_size", "target", "mean", "lam")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, copies) for every row; copies are 0 to cap.

    Documents without words are taken once at no cost. A source's taken words differ from its target by about half of its smallest
    sizes. Repeated rows are rows of their own. An empty table gives an empty plan. Null texts have no words; a very long text is one row with a large size, which is rounded first.
    Of the documents only doc_id, source and text are read, whatever other columns are called. Two rules change with a source's size, neither of them what the mix
    takes from it: behind its SEQUENTIAL largest (size, part) cells copies are rounded by a running sum and no longer one after the other, and a size
    with more than CLASS documents is cut into parts by hash, so that other documents of equal size get the extra copy.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(sized(docs))
    classes = scratch.save(rows.groupBy("source", "size").agg(F.count("*").alias("c")))
    goals = scratch.save(targets(classes.groupBy("source").agg(F.sum(F.col("c") * F.col("size")).alias("source_size")), weights, cap))
    solved = solve(classes, goals, scratch, cap)

    # Classes with many documents are split by the hash, so that no class is ranked in one task.
    split = classes.select(F.col("source").alias("s1"), F.col("size").alias("z1"), F.ceil(F.col("c") / CLASS).cast("long").alias("parts"))
    dealt = rows.join(split, rows.source.eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1"))).withColumn("part", F.pmod(F.col("h"), F.col("parts"))).drop("s1", "z1", "parts")
    dealt = scratch.save(dealt)
    cells = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("c"))
    w = F.when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), float(cap)).otherwise(rate(F.col("lam"), F.col("size") / F.col("mean"), cap))
    rated = cells.join(solved.withColumnRenamed("source", "s2"), cells.source.eqNullSafe(F.col("s2"))).where("size > 0").select("source", "size", "part", "c", (F.col("c") * w).alias("ideal"))
    down = Window.partitionBy("source").orderBy(F.desc("size"), "part")
    rated = scratch.save(rated.withColumn("at", F.row_number().over(down)))

    # The largest sizes one after the other: each class rounds its words plus what is still open, within 0 and cap copies each.
    top = rated.where(F.col("at") <= SEQUENTIAL).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("at", "size", "part", "c", "ideal"))).alias("list"))
    none = F.expr("cast(array() as array<struct<size: bigint, part: bigint, copies: bigint>>)")

    def take(state: Column, cell: Column) -> Column:
        due = state["due"] + cell["ideal"] * cell["size"]
        copies = F.greatest(F.lit(0).cast("long"), F.least(cell["c"] * cap, F.floor(due / cell["size"] + 0.5)))
        return F.struct((due - copies * cell["size"]).alias("due"), F.concat(state["out"], F.array(F.struct(cell["size"].alias("size"), cell["part"].alias("part"), copies.alias("copies")))).alias("out"))

    folded = top.select("source", F.explode(F.aggregate("list", F.struct(F.lit(0.0).alias("due"), none.alias("out")), take)["out"]).alias("o")).select("source", "o.size", "o.part", F.col("o.copies").alias("total"))
    # The others by the running sum of copies: neighbours are alike in size, so the errors cancel.
    running = F.floor(F.round(F.sum("ideal").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 6) + 0.5)
    rest = rated.where(F.col("at") > SEQUENTIAL).withColumn("sum", running)
    rest = rest.select("source", "size", "part", F.least(F.col("c") * cap, F.col("sum") - F.coalesce(F.lag("sum").over(down), F.lit(0))).alias("total"))
    totals = scratch.save(folded.unionByName(rest))

    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    count = F.count("*").over(Window.partitionBy("source", "size", "part"))
    ranked = dealt.withColumn("rank", rank).withColumn("c", count)
    t = totals.select(F.col("source").alias("s3"), F.col("size").alias("z3"), F.col("part").alias("p3"), "total")
    g = solved.select(F.col("source").alias("s4"), "source_size", "target")
    joined = ranked.join(t, ranked.source.eqNullSafe(F.col("s3")) & (F.col("size") == F.col("z3")) & (F.col("part") == F.col("p3")), "left").join(g, ranked.source.eqNullSafe(F.col("s4")), "left")
    copies = F.expr("total div c") + F.when(F.col("rank") <= F.col("total") % F.col("c"), 1).otherwise(0)
    return joined.select("doc_id", "source", "h", "size", "source_size", "target", F.when(F.col("size") == 0, 1).otherwise(F.coalesce(copies, F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents, each as often as its copies say; columns as they came.

    Rows with the same id and text share their copies evenly.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.col("doc_id").alias("__id"), row_key().alias("__h"), row.alias("__row"))
    total = plan(docs, weights, cap).groupBy(F.col("doc_id").alias("__i2"), F.col("h").alias("__h2")).agg(F.sum("copies").alias("__sum"), F.count("*").alias("__m"))
    joined = keyed.join(total, (F.col("__h") == F.col("__h2")) & F.col("__id").eqNullSafe(F.col("__i2"))).where("__sum > 0")
    # Only rows that share id and text need a number; for all others it is 1.
    number = F.row_number().over(Window.partitionBy("__h", "__id").orderBy(F.lit(1)))
    many = joined.where("__m > 1").withColumn("__n", number).unionByName(joined.where("__m = 1").withColumn("__n", F.lit(1)))
    copies = F.expr("cast(__sum div __m + if(__n <= __sum % __m, 1, 0) as int)")
    return many.withColumn("__copies", copies).where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
