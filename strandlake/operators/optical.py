"""Optical duplicates: templates of one duplicate set that lie next to each other on a tile of the flow cell."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reads import duplicate_metrics, library_size, templates
from .rounds import settle


def location(name: str = "qname") -> Column:
    """(tile, x, y) from the last three numbers of a read name, parted by colons; null where a name has none."""
    at = lambda k: F.regexp_extract(name, r":(\d+):(\d+):(\d+)(?:[^:\d][^:]*)?$", k).try_cast("long")
    return F.when(at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull(), F.struct(at(1).alias("tile"), at(2).alias("x"), at(3).alias("y")))


def joined_squares(links: DataFrame) -> DataFrame:
    """(set, tile, gx, gy, label) for the squares of links (set, tile, gx, gy, ox, oy): the least square that links join a square to.

    The links of one set and tile are read at a time; a tile has no more squares than its size allows, whatever the number of reads.
    """
    square = pa.struct([("gx", pa.int64()), ("gy", pa.int64())])
    kinds = {"set": pa.string(), "tile": pa.int64(), "gx": pa.int64(), "gy": pa.int64(), "label": square}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, above = None, {}

        def least(u: tuple[int, int]) -> tuple[int, int]:
            while above.setdefault(u, u) != u:
                above[u] = u = above[above[u]]
            return u

        def rows() -> pa.RecordBatch:
            out = [(*now, *u, dict(zip(("gx", "gy"), least(u), strict=True))) for u in above]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

        for batch in batches:
            for set_, tile, gx, gy, ox, oy in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (set_, tile):
                    if now:
                        yield rows()
                    now, above = (set_, tile), {}
                low, high = sorted((least((gx, gy)), least((ox, oy))))
                above[high] = low
        if now:
            yield rows()

    dealt = links.select("set", "tile", "gx", "gy", "ox", "oy").repartition("set", "tile").sortWithinPartitions("set", "tile")
    return dealt.mapInArrow(run, "set string, tile bigint, gx bigint, gy bigint, label struct<gx: bigint, gy: bigint>")


def squares(points: DataFrame, distance: int) -> DataFrame:
    """(set, tile, gx, gy, label): squares of side `distance` with points, labelled by the least square that a chain of near points joins them to.

    points: (set, tile, x, y). Two are near if neither coordinate differs by more than the distance. Points of one square are near each other and need no
    comparison; those of touching squares meet in an equi-join, of which one link for each pair of squares is kept. Joins are merged, so that no table passes the driver.
    """
    grid = points.select("set", "tile", "x", "y", F.floor(F.col("x") / (distance + 1)).alias("gx"), F.floor(F.col("y") / (distance + 1)).alias("gy")).distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    reach = grid.select("set", "tile", F.col("gx").alias("ox"), F.col("gy").alias("oy"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(steps).alias("s"))
    reach = reach.select("set", "tile", "ox", "oy", "x2", "y2", (F.col("ox") + F.col("s.a")).alias("gx"), (F.col("oy") + F.col("s.b")).alias("gy"))
    near = (F.abs(F.col("x") - F.col("x2")) <= distance) & (F.abs(F.col("y") - F.col("y2")) <= distance)
    links = grid.join(reach.hint("merge"), ["set", "tile", "gx", "gy"]).where(near).select("set", "tile", "gx", "gy", "ox", "oy").distinct()
    alone = grid.select("set", "tile", "gx", "gy").distinct()
    found = alone.join(joined_squares(links).hint("merge"), ["set", "tile", "gx", "gy"], "left")
    return found.select("set", "tile", "gx", "gy", F.coalesce("label", F.struct("gx", "gy")).alias("label"))


def optical_templates(df: DataFrame, score: str = "score", distance: int = 100) -> DataFrame:
    """(cell, qname, optical) for pairs of duplicate sets with two or more: all but one of those that chains of near points join.

    The one is the set's kept pair (greatest score, then least name) if it is among them, else the best of them. Names without a place are never optical.
    """
    pairs = settle(templates(df, score).where("n > 1").select("cell", "qname", "score", F.sha2(F.to_json(F.struct("cell", "ends")), 256).alias("set"), location().alias("at")))
    several = pairs.groupBy("set").agg(F.count("*").alias("m")).where("m > 1").select("set")
    placed = pairs.join(several.hint("merge"), "set").where("at is not null").select("cell", "qname", "score", "set", "at.*")
    own = placed.withColumns({"gx": F.floor(F.col("x") / (distance + 1)), "gy": F.floor(F.col("y") / (distance + 1))}).join(squares(placed, distance).hint("merge"), ["set", "tile", "gx", "gy"])
    best = own.groupBy("set", "tile", "label").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("qname").alias("kept"))).getField("kept").alias("kept"))
    return own.join(best.hint("merge"), ["set", "tile", "label"]).select("cell", "qname", (F.col("qname") != F.col("kept")).alias("optical"))


def metrics(df: DataFrame, score: str = "score", distance: int = 100) -> DataFrame:
    """duplicate_metrics with read_pair_optical_duplicates; the library's size leaves optical ones out, as they say nothing about it."""
    counts = optical_templates(df, score, distance).groupBy("cell").agg(F.count_if("optical").alias("read_pair_optical_duplicates"))
    out = duplicate_metrics(df, score).join(counts, "cell", "left").na.fill(0, ["read_pair_optical_duplicates"])
    pairs = F.col("read_pairs_examined")
    return out.withColumn("estimated_library_size", library_size(pairs - F.col("read_pair_optical_duplicates"), pairs - F.col("read_pair_duplicates")))
