"""Near duplicates among embeddings: an exact range join in the metric space of unit vectors.

cosine >= c is a distance of at most r = sqrt(2 - 2c) between unit vectors. Pivots part the space: a vector's home is the cell of
its nearest pivot p and of the ring of distances to p that it lies in. By the triangle inequality a vector u may have a partner at
home in cell (p, [lo, hi)) only if lo - r <= d(u, p) < hi + r and d(u, p) <= d(u, home pivot) + 2r, so it is copied to those cells as
a guest and every cell is joined by itself. The innermost ring has radius r/2: all at home there are partners of each other without
a comparison, so a mass of near copies costs its size, not its square. Other cells compare in blocks, and blocks give
counts and a spanning forest of their links instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest

COSINE = 0.93
#: Rows looked at for pivots, pivots at most, rows a pivot is meant for, rows of a block.
SAMPLE, PIVOTS, PER_PIVOT, BLOCK = 1024, 256, 8192, 2048
#: Rows with their vectors that a task holds at once while it deals them to cells; a vector may be a guest in hundreds of these.
ROWS = 2048
EPS = 1e-9


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(x: np.ndarray, most: int, r: float) -> np.ndarray:
    """Of a sample of unit vectors those with the densest surroundings first, none within r of another."""
    near = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    dense = (near <= r / 2).sum(axis=1)
    chosen: list[int] = []
    for i in np.argsort(-dense, kind="stable"):
        if len(chosen) >= most and dense[i] < max(8, len(x) // 200):
            break
        if len(chosen) >= PIVOTS:
            break
        if all(near[i, j] > r for j in chosen):
            chosen.append(int(i))
    return x[chosen]


def assigned(pivots: dict[int, np.ndarray], edges: np.ndarray, r: float):
    """Task that gives vectors (embedding, ..) their home cell and the cells where they are guests, in frames of ROWS rows at most."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (whole.iloc[k : k + ROWS] for whole in frames for k in range(0, len(whole), ROWS)):
            for size, part in frame.groupby(frame["embedding"].map(len)):
                p = pivots.get(size)
                if p is None:  # no vector of this length was sampled: one cell with a ring for all
                    yield part.assign(size=size, pivot=-1, ring=1, home=True)
                    continue
                d = np.sqrt(np.maximum(2 - 2 * unit(list(part["embedding"])) @ p.T, 0))
                own = d.argmin(axis=1)
                at = d[np.arange(len(d)), own]
                ring = np.searchsorted(edges, at - EPS, side="left") - 1
                ring = np.maximum(ring, 0)
                yield part.assign(size=size, pivot=own, ring=ring, home=True)
                for k in range(len(edges)):
                    lo, hi = edges[k], edges[k + 1] if k + 1 < len(edges) else 3.0
                    guest = (d >= lo - r - EPS) & (d <= hi + r + EPS) & (d <= at[:, None] + 2 * r + EPS)
                    guest[np.flatnonzero(ring == k), own[ring == k]] = False
                    i, j = np.nonzero(guest)
                    for m in range(0, len(i), ROWS):
                        yield part.iloc[i[m : m + ROWS]].assign(size=size, pivot=j[m : m + ROWS], ring=k, home=False)

    return assign


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Linked are vectors of equal, not null label and equal length with a cosine of at least `cosine` (0.5 to 1), in double precision. Vectors
    that are null, empty, zero, or hold a null or non-finite component link with nothing. Equal vectors of a label are one point
    with a weight, and rows that repeat an id are vectors of their own. A vector as near to two pivots is at home with the first. An empty table
    gives an empty one; other columns are not read. Only the sample for pivots (SAMPLE vectors) passes the driver; it changes the cells, not the result.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    r = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists("embedding", lambda e: e != 0)
    # A point is known by the hash of its label and vector, as an id may stand for several vectors.
    points = rows.where(good).groupBy("label", "embedding").agg(F.count("*").alias("weight"))
    points = scratch.save(points.select("label", "embedding", F.xxhash64("label", "embedding").alias("head"), "weight"))
    members = scratch.save(rows.where(good).join(points, ["label", "embedding"]).select("vec_id", "head", "weight"))
    n = points.count()
    sample = [row[0] for row in points.orderBy("head").limit(SAMPLE).select("embedding").collect()]
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    pivots = {d: choose_pivots(unit(vs), max(1, min(PIVOTS, n // PER_PIVOT)), r) for d, vs in by_size.items()}
    edges = np.array([0.0, r / 2, *(r / 2 + r * k for k in range(1, math.ceil(2 / r) + 1))])

    schema = f"label {points.schema['label'].dataType.simpleString()}, embedding {points.schema['embedding'].dataType.simpleString()}, head long, weight long, size int, pivot int, ring int, home boolean"
    cell = ["label", "size", "pivot", "ring"]
    ordered = [c.split(" ")[0] for c in schema.split(", ")]
    assign = assigned(pivots, edges, r)
    placed = scratch.save(points.mapInPandas(lambda it: (f[ordered] for f in assign(it)), schema))
    sizes = placed.groupBy(*cell).agg(F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_guest"), F.sum(F.when(F.col("home"), F.col("weight"))).alias("mass"), F.min(F.when(F.col("home"), F.col("head"))).alias("least")).where("n_home > 0")
    # In the innermost ring only guests are compared with those at home.
    targets = F.when(F.col("ring") == 0, F.col("n_guest")).otherwise(F.col("n_home") + F.col("n_guest"))
    sizes = scratch.save(sizes.withColumn("h", F.ceil(F.col("n_home") / BLOCK).cast("int")).withColumn("t", F.ceil(targets / BLOCK).cast("int")))
    joined = placed.join(sizes, cell)
    ball = joined.where("ring = 0 and home").select(F.col("head").alias("a"), F.col("least").alias("b"), (F.col("mass") - F.col("weight")).alias("links"))
    spread = F.pmod(F.xxhash64("head"), F.lit(1 << 30))
    as_home = joined.where("home and t > 0").select(*cell, "head", "weight", "embedding", F.lit(True).alias("left"), (spread % F.col("h")).cast("int").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("tb"))
    as_target = joined.where("not home or ring > 0").select(*cell, "head", "weight", "embedding", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("hb"), (spread % F.col("t")).cast("int").alias("tb"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["left"]], frame[~frame["left"]]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": "int64", "b": "Int64", "links": "int64"})
        ids, others = left["head"].to_numpy(), right["head"].to_numpy()
        linked = unit(list(left["embedding"])) @ unit(list(right["embedding"])).T >= cosine
        linked &= ids[:, None] != others[None, :]
        counts = linked @ right["weight"].to_numpy()
        pairs = forest(ids, others, linked)
        a = np.concatenate([ids[counts > 0], np.array([p[0] for p in pairs], np.int64)])
        b = pd.array([None] * int((counts > 0).sum()) + [int(p[1]) for p in pairs], dtype="Int64")
        return pd.DataFrame({"a": a, "b": b, "links": np.concatenate([counts[counts > 0], np.zeros(len(pairs), np.int64)])})

    found = as_home.unionByName(as_target).groupBy(*cell, "hb", "tb").applyInPandas(compare, "a long, b long, links long")
    found = scratch.save(found.unionAll(ball))
    scratch.drop(placed)
    counts = found.groupBy(F.col("a").alias("head")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"), scratch).select(F.col("id").alias("head"), "component")
    per_head = scratch.save(members.join(counts, "head", "left").join(groups, "head", "left").select("vec_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "head").alias("component")))
    least = per_head.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = per_head.join(least, "component").select("vec_id", "n_links", "component_id")
    single = rows.where(~good | good.isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionAll(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
