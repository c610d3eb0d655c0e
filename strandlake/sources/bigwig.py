"""bigWig tracks: a data source that plans parts from the file's own index, values and means over regions, and a sink.

A file holds its contigs in a key tree and its data in compressed sections under a tree of ranges. The source descends only into branches that overlap what was asked for,
and gives each task a group of neighbouring sections.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .binary import open_binary, store_of

# Fixed values of the format.
MAGIC, KEYS, RANGES = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3
#: Compressed bytes of sections that a task reads, about; and bases in which a section of the sink begins.
SPLIT, WINDOW = 1 << 23, 16_384
_FAN = 256


def at(f, place: int, n: int) -> bytes:
    f.seek(place)
    return f.read(n)


def head(f) -> tuple[int, int, int]:
    """(key tree, range tree, size of the buffer for a section's text; 0: sections aren't compressed)."""
    raw = at(f, 0, 64)
    if len(raw) < 64 or struct.unpack_from("<I", raw)[0] != MAGIC:
        raise ValueError("not a bigWig file in little-endian order")
    return struct.unpack_from("<Q", raw, 8)[0], struct.unpack_from("<Q", raw, 24)[0], struct.unpack_from("<I", raw, 52)[0]


def contigs(f) -> dict[str, tuple[int, int]]:
    """name: (number, length) from the key tree."""
    tree = head(f)[0]
    magic, _, key, value, _, _ = struct.unpack("<IIIIQQ", at(f, tree, 32))
    if magic != KEYS or value != 8:
        raise ValueError("no tree of contigs")
    out, todo = {}, [tree + 32]
    while todo:
        place = todo.pop()
        leaf, _, n = struct.unpack("<BBH", at(f, place, 4))
        body = at(f, place + 4, n * (key + 8))
        for k in range(n):
            name = body[k * (key + 8) : k * (key + 8) + key].rstrip(b"\0").decode()
            if leaf:
                out[name] = struct.unpack_from("<II", body, k * (key + 8) + key)
            else:
                todo.append(struct.unpack_from("<Q", body, k * (key + 8) + key)[0])
    return out


def sections(f, chrom: int | None, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """(place, bytes) of the sections that overlap [begin, end) of a contig, or of all, in the file's order; other branches aren't read."""
    tree = head(f)[1]
    if struct.unpack("<I", at(f, tree, 4))[0] != RANGES:
        raise ValueError("no tree of ranges")

    def down(place: int) -> Iterator[tuple[int, int]]:
        leaf, _, n = struct.unpack("<BBH", at(f, place, 4))
        step = 32 if leaf else 24
        body = at(f, place + 4, n * step)
        for k in range(n):
            c0, b0, c1, b1, where = struct.unpack_from("<IIIIQ", body, k * step)
            if chrom is not None and ((c1, b1) <= (chrom, begin) or (c0, b0) >= (chrom, end)):
                continue
            if leaf:
                yield where, struct.unpack_from("<Q", body, k * step + 24)[0]
            else:
                yield from down(where)

    yield from down(tree + 48)


def items(raw: bytes) -> tuple[int, list[tuple[int, int, float]]]:
    """(contig, [(begin, end, value)]) of one section's text."""
    chrom, begin, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", raw)
    if kind == BEDGRAPH:
        return chrom, list(struct.iter_unpack("<IIf", raw[24 : 24 + 12 * n]))
    if kind == VARIABLE:
        return chrom, [(p, p + span, v) for p, v in struct.iter_unpack("<If", raw[24 : 24 + 8 * n])]
    if kind == FIXED:
        return chrom, [(begin + k * step, begin + k * step + span, v[0]) for k, v in enumerate(struct.iter_unpack("<f", raw[24 : 24 + 4 * n]))]
    raise ValueError(f"section of kind {kind}")


class BigWig(DataSource):
    """format("bigwig"): rows (path, chrom, pos0, pos1, value). Options: path, a comma list of files; chrom, start and end for a region (0-based, half-open; intervals
    that overlap it come whole); split, the compressed bytes of a part."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "path string, chrom string, pos0 long, pos1 long, value double"

    def reader(self, schema) -> DataSourceReader:
        return BigWigReader(self.options)


class BigWigReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.split = options["path"].split(","), int(options.get("split", SPLIT))
        self.chrom, self.begin, self.end = options.get("chrom"), int(options.get("start", 0)), int(options.get("end", 1 << 32))

    def partitions(self):
        out = []
        for path in self.paths:
            with open_binary(path) as f:
                number = contigs(f).get(self.chrom, (-1, 0))[0] if self.chrom else None
                group, size = [], 0
                for place, n in [] if number == -1 else sections(f, number, self.begin, self.end):
                    if group and size + n > self.split:
                        out.append(InputPartition((path, group)))
                        group, size = [], 0
                    group.append((place, n))
                    size += n
                if group:
                    out.append(InputPartition((path, group)))
        return out or [InputPartition((self.paths[0], []))]

    def read(self, partition):
        path, group = partition.value
        with open_binary(path) as f:
            names = {k: name for name, (k, _) in contigs(f).items()}
            packed = head(f)[2]
            for place, n in group:
                raw = at(f, place, n)
                chrom, rows = items(zlib.decompress(raw) if packed else raw)
                for a, b, v in rows:
                    if self.chrom is None or (names[chrom] == self.chrom and a < self.end and b > self.begin):
                        yield path, names[chrom], a, b, v


def values(track: DataFrame, chrom: str, begin: int, end: int) -> DataFrame:
    """(pos0, value) for every position of a region, null where the track has nothing; track: intervals (chrom, pos0, pos1, value) that don't overlap."""
    spark = track.sparkSession
    inside = track.where((F.col("chrom") == chrom) & (F.col("pos0") < end) & (F.col("pos1") > begin))
    known = inside.select(F.explode(F.sequence(F.greatest("pos0", F.lit(begin)), F.least("pos1", F.lit(end)) - 1)).alias("pos0"), "value")
    return spark.range(begin, end).withColumnRenamed("id", "pos0").join(known, "pos0", "left")


def section_of(chrom: int, rows) -> tuple[bytes, int, int, int]:
    """(compressed bytes, begin, end, size of the text) of sorted intervals of a contig."""
    begin, end = int(rows[0]["pos0"]), max(int(r["pos1"]) for r in rows)
    raw = struct.pack("<IIIIIBBH", chrom, begin, end, 0, 0, BEDGRAPH, 0, len(rows)) + b"".join(struct.pack("<IIf", r["pos0"], r["pos1"], r["value"]) for r in rows)
    return zlib.compress(raw), begin, end, len(raw)


def range_tree(leaves: list[tuple[int, int, int, int, int]], start: int, per: int) -> bytes:
    """The tree over (contig, begin, end, place, bytes), to stand at `start`; top first, each level in order."""
    levels = [[(c, a, c, b, place, n) for c, a, b, place, n in leaves]]
    while len(levels[-1]) > _FAN:
        below = levels[-1]
        groups = [below[k : k + _FAN] for k in range(0, len(below), _FAN)]
        levels.append([(*g[0][:2], *max(x[2:4] for x in g), 0, 0) for g in groups])
    levels.reverse()
    top = levels[0] or [(0, 0, 0, 0, 0, 0)]
    last = max(x[2:4] for x in top)
    out = struct.pack("<IIQIIIIQII", RANGES, _FAN, len(leaves), *top[0][:2], *last, start, per, 0)
    where = start + len(out)
    for depth, level in enumerate(levels):
        nodes = [level[k : k + _FAN] for k in range(0, len(level), _FAN)] or [[]]
        leaf = depth == len(levels) - 1
        below = where + sum(4 + len(g) * (32 if leaf else 24) for g in nodes)
        # Children stand one behind the other on the next level, full ones but the last.
        step = 4 + _FAN * (32 if depth == len(levels) - 2 else 24)
        child = 0
        for g in nodes:
            out += struct.pack("<BBH", leaf, 0, len(g))
            for c0, b0, c1, b1, place, n in g:
                out += struct.pack("<IIIIQQ", c0, b0, c1, b1, place, n) if leaf else struct.pack("<IIIIQ", c0, b0, c1, b1, below + child * step)
                child += 1
        where = below
    return out


def write_bigwig(track: DataFrame, lengths: list[tuple[str, int]], path: str, by: str | None = None, tasks: int = 256) -> DataFrame:
    """Writes `path`/<group>.bw and returns (grp, path, intervals, bytes). track: (chrom, pos0, pos1, value[, by]); intervals of a group don't overlap.

    Sections are made where the intervals are: those that begin in one window of 16,384 bases. A group's file is put together by one task, which streams its compressed sections in
    order and keeps a few numbers for each; groups are dealt to tasks. Contigs that the list lacks are left out. There are no zoom levels.
    """
    names = sorted(lengths)
    number = F.array_position(F.array(*[F.lit(n) for n, _ in names]), F.col("chrom"))
    group = F.coalesce(F.col(by).cast("string"), F.lit("none")) if by else F.lit("all")
    rows = track.select(group.alias("grp"), (number - 1).cast("long").alias("contig"), F.col("pos0").cast("long").alias("pos0"), F.col("pos1").cast("long").alias("pos1"), F.col("value").cast("double").alias("value")).where("contig >= 0 and pos0 < pos1 and value is not null")
    listed = rows.groupBy("grp", "contig", F.floor(F.col("pos0") / WINDOW).alias("w")).agg(F.sort_array(F.collect_list(F.struct("pos0", "pos1", "value"))).alias("rows"))

    @F.pandas_udf("data binary, begin long, end long, size long, n long")
    def packed(contig: pd.Series, lists: pd.Series) -> pd.DataFrame:
        made = [(*section_of(c, r), len(r)) for c, r in zip(contig, lists, strict=True)]
        return pd.DataFrame(made, columns=["data", "begin", "end", "size", "n"])

    made = listed.select("grp", "contig", packed("contig", "rows").alias("s")).select("grp", "contig", "s.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(path)
        store.create_dir(base, recursive=True)
        done, now, out, leaves = [], None, None, []
        place = intervals = size = most = 0
        width = max((len(n.encode()) for n, _ in names), default=1)
        tree = struct.pack("<IIIIQQ", KEYS, max(len(names), 1), width, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
        tree += b"".join(n.encode().ljust(width, b"\0") + struct.pack("<II", k, length) for k, (n, length) in enumerate(names))

        def close() -> None:
            out.close()
            data = 64 + len(tree) + 8
            index = range_tree([(c, a, b, data + p, n) for c, a, b, p, n in leaves], data + place, 1)
            header = struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, 64, 64 + len(tree), data + place, 0, 0, 0, 0, most, 0)
            final = f"{base}/{now}.bw"
            with store.open_output_stream(final + ".part") as f, store.open_input_file(scratch) as g:
                f.write(header + tree + struct.pack("<Q", len(leaves)))
                while raw := g.read(1 << 20):
                    f.write(raw)
                f.write(index)
            store.delete_file(scratch)
            store.move(final + ".part", final)
            done.append((now, f"{path}/{now}.bw", intervals, data + place + len(index)))

        for batch in batches:
            for grp, contig, data_, begin, end, size, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != now:
                    if out:
                        close()
                    now, leaves, place, intervals, most = grp, [], 0, 0, 0
                    scratch = f"{base}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(scratch)
                out.write(data_)
                leaves.append((contig, begin, end, place, len(data_)))
                place, intervals, most = place + len(data_), intervals + n, max(most, size)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["grp", "path", "intervals", "bytes"])

    written = made.repartition(tasks, "grp").sortWithinPartitions("grp", "contig", "begin").mapInArrow(run, "grp string, path string, intervals long, bytes long")
    return track.sparkSession.createDataFrame(written.collect(), written.schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BigWig)
