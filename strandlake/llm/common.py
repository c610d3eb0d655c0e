"""Helpers shared by the corpus operators: scratch tables, words and shingles, connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
import weakref

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors that spark.checkpoint.dir names; on a local master one of our own where none is set, elsewhere an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_MADE: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch folders that a session has made, when no result that reads them is needed any more; also done when the driver ends."""
    for base in _MADE.pop(spark, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear_all() -> None:
    for spark in list(_MADE):
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                clear_scratch(spark)
        except Exception:  # noqa: BLE001, S110  the JVM may be gone: what is left lies in the folder for checkpoints, which its owner clears
            pass


class Scratch:
    """Tables written to the shared folder so that lineage ends there and a lost executor costs one stage at most.

    Tables that only inner steps read are dropped by those; the others stay as long as results may read them, until clear_scratch.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.k = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        _MADE.setdefault(spark, []).append(self.base)

    def path(self) -> str:
        self.k += 1
        return f"{self.base}/{self.k}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the exchanges of plans that nothing refers to any more, instead of at its next half-hourly collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], n: str = "n", merge: bool = False) -> DataFrame:
    """left joined with right (one row for each key, `n` rows of left, which is dropped), with heavy keys dealt to several tasks.

    A key with more than a share of 1 in 4 x partitions of all rows is cut into pieces of that share by a hash of the left row, and its right row is
    repeated for each piece. There are at most as many heavy keys as pieces, so the list of their hashes, which is broadcast, has a proven bound.
    merge: the join is a sort-merge join at every size, so that exchanges of large rows grow with the input and not by leaps.
    """
    pieces = 4 * partitions(left.sparkSession)
    total = right.agg(F.sum(n)).first()[0] or 0
    slots = F.ceil(F.col(n) * pieces / float(max(total, 1))).cast("int")
    key = F.xxhash64(*on)
    heavy = F.broadcast(right.where(F.col(n) * pieces > total).groupBy(key.alias("__salt_key")).agg(F.max(slots).alias("__salt_slots")))
    piece = F.when(F.col("__salt_slots").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")], F.lit(7)), F.col("__salt_slots"))).cast("int")
    many = left.withColumn("__salt_key", key).join(heavy, "__salt_key", "left").withColumn("__salt_piece", piece).drop("__salt_key", "__salt_slots")
    each = right.withColumn("__salt_key", key).join(heavy, "__salt_key", "left").withColumn("__salt_piece", F.explode(F.sequence(F.lit(0), F.coalesce("__salt_slots", F.lit(1)) - 1))).drop("__salt_key", "__salt_slots", n)
    return (many.hint("merge") if merge else many).join(each, [*on, "__salt_piece"]).drop("__salt_piece")


def fresh(name: str, taken: tuple[str, ...] | list[str]) -> str:
    """The name, with underscores behind it until no column has it in any case."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that hash order is unrelated to text order."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def word_hashes(text: str | bytes | None, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a whole text, A-Z lower-cased if asked; null is empty."""
    if not text:
        return np.empty(0, U64)
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, in text order; of the whole sequence where there are fewer; nothing without words."""
    if not len(words):
        return words
    m = min(n, len(words))
    h = words[: len(words) - m + 1] + U64(m)
    for k in range(1, m):
        h = h * _MUL + words[k : len(words) - m + 1 + k]
    return mix64(h)


def components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b) of longs, for ids that have an edge.

    Alternating large-star and small-star steps: each step hangs neighbours on the smallest one, so
    stars form in a logarithmic number of rounds even for long chains. Each round ends in a scratch
    table. A hub's edges are grouped with partial aggregation and joined, never gathered in one row.
    Rounds end when every larger end has one edge and is no smaller end, which is when all are stars.
    The joins are sort-merge joins at every size: broadcasts of many short rounds pile up in the driver.
    """
    ends = lambda *pairs: F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs])).alias("e")
    now = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(limit):
        both = now.select(ends(("a", "b"), ("b", "a"))).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.hint("merge").join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.hint("merge").join(down, "b").select(ends(("m", "b"), ("m", "a"))).selectExpr("e.u as a", "e.v as b")
        new = scratch.save(small.where("a <> b").distinct())
        scratch.drop(now)
        now = new
        degrees = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(0).alias("n")), F.struct(F.col("b").alias("u"), F.lit(1).alias("n")))).alias("e")).groupBy("e.u").agg(F.sum("e.n").alias("n"), F.min("e.n").alias("least"))
        if not degrees.agg(F.expr("count_if(n > 1 or n = 1 and least = 0)")).first()[0]:
            break
    else:
        raise RuntimeError(f"no stable components after {limit} rounds")
    heads = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(heads)


def forest(rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row id, column id) that connect what the boolean matrix connects, no more than its rows and columns."""
    left, fresh, out = set(range(len(rows))), np.ones(len(cols), bool), []
    for start in range(len(rows)):
        if start not in left:
            continue
        left.discard(start)
        stack = [start]
        while stack:
            i = stack.pop()
            found = np.flatnonzero(linked[i] & fresh)
            fresh[found] = False
            out += [(rows[i], cols[j]) for j in found]
            for j in found:
                for k in np.flatnonzero(linked[:, j]):
                    if k in left:
                        left.discard(k)
                        stack.append(k)
                        out.append((rows[k], cols[j]))
    return [(a, b) for a, b in out if a != b]
