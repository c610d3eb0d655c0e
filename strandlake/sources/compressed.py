"""Compressed text in parts: lines and FASTQ pairs from block-compressed files that are cut at block borders; plain files are cut anywhere, other gzip files not.

Each part of a file reads the lines that begin behind its first line end, up to and with the first line end behind its last block, so every line is read once whatever the
part's size. Mates are paired by the record numbers of the parts, which one counting pass finds; no read is exchanged.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .binary import SPLIT, Blocks, block_at, open_binary

BLOCKED, GZIP, PLAIN = "blocked", "gzip", "plain"
_CHUNK = 1 << 16


def kind_of(f) -> str:
    head = f.read(18)
    f.seek(0)
    return BLOCKED if len(head) == 18 and block_at(head, 0) else GZIP if head[:2] == b"\x1f\x8b" else PLAIN


def first_block(f, begin: int, end: int, size: int) -> int | None:
    """Where the first block starts in [begin, end): one that a block or the file's end follows."""
    f.seek(begin)
    raw = f.read(min(end - begin, 1 << 17) + (1 << 16) + 64)
    for k in range(min(end - begin, len(raw))):
        n = block_at(raw, k)
        if n and (begin + k + n >= size or k + n + 18 > len(raw) or block_at(raw, k + n)):
            return begin + k
    return None


def pieces(f, begin: int, end: int) -> Iterator[tuple[bool, bytes]]:
    """(is the part's own, bytes) from the part's first block on, to the end of the file."""
    size, kind = f.size(), kind_of(f)
    if kind == BLOCKED:
        at = first_block(f, begin, end, size)
        if at is None:
            return
        s = Blocks(f, at)
        while s.more():
            yield s.last < end, s.held
            s.held = b""
    elif kind == GZIP:
        if begin == 0:
            stream = gzip.GzipFile(fileobj=f)
            while raw := stream.read(_CHUNK):
                yield True, raw
    else:
        f.seek(begin)
        at = begin
        while raw := f.read(min(_CHUNK, end - at) if at < end else _CHUNK):
            yield at < end, raw
            at += len(raw)


def lines(path: str, begin: int, end: int) -> Iterator[bytes]:
    """The lines of a part, without their ends ('\\n' or '\\r\\n')."""
    with open_binary(path) as f:
        held, started, beyond = b"", begin == 0, False
        for own, raw in pieces(f, begin, end):
            if not started:
                if not own:
                    return
                at = raw.find(b"\n")
                if at < 0:
                    continue
                raw, started = raw[at + 1 :], True
            if not own and not beyond:
                beyond = True
            held += raw
            *whole, held = held.split(b"\n")
            for k, line in enumerate(whole):
                yield line.removesuffix(b"\r")
                if beyond:
                    return
        if held and started:
            yield held.removesuffix(b"\r")


def parts(spark: SparkSession, paths: list[str], split: int) -> DataFrame:
    """(file, path, begin, end): the parts of each file, a row each; file is its place in the list."""
    rows = spark.createDataFrame(list(enumerate(paths)), "file long, path string")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, path in zip(batch["file"], batch["path"], strict=True):
                with open_binary(path) as f:
                    size, step = f.size(), split if kind_of(f) != GZIP else 1 << 62
                at = list(range(0, max(size, 1), step))
                yield pd.DataFrame({"file": file, "path": path, "begin": at, "end": [min(a + step, size) for a in at]})

    return rows.repartition(max(1, min(len(paths), 256)), "file").mapInPandas(cut, "file long, path string, begin long, end long")


def spread(tasks: DataFrame, n: int | None) -> DataFrame:
    """Parts dealt to n tasks, by default as many as a shuffle has partitions or twice the cores, if those are more."""
    spark = tasks.sparkSession
    return tasks.repartition(n or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *tasks.columns)


def text_lines(spark: SparkSession, paths: list[str], split: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """(path, value): every line of the files, read in parts of `split` bytes. Lines of different parts come in no order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                held, size = [], 0
                for line in lines(path, begin, end):
                    held.append(line.decode())
                    size += len(line)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held, pa.string())], names=["path", "value"])
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(held, pa.string())], names=["path", "value"])

    return spread(parts(spark, paths, split), tasks).mapInArrow(run, "path string, value string")


def raw_records(path: str, begin: int, end: int) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    """The four lines of each record that begins in a part.

    A part begins within a record: a header is a line with '@' whose next but one begins with '+'; a quality line with '@' in front has a sequence there.
    A record is read by the part that reads its header, with lines of the next part if need be; a cut record at the file's end goes.
    """
    own, held, mine = lines(path, begin, end), [], 0

    def following() -> Iterator[bytes]:
        """Lines behind the part's own."""
        with open_binary(path) as f:
            size = f.size()
        at = end
        while at < size:
            yield from lines(path, at, min(at + (1 << 17), size))
            at = min(at + (1 << 17), size)

    rest = following()

    def ahead(n: int) -> bool:
        nonlocal mine
        while len(held) < n:
            line = next(own, None)
            if line is not None:
                mine += 1
            elif (line := next(rest, None)) is None:
                return False
            held.append(line)
        return True

    while begin and not (ahead(1) and held[0][:1] == b"@" and ahead(3) and held[2][:1] == b"+"):
        if mine < 2 and not (ahead(2) and mine > 1):
            return
        del held[0]
        mine -= 1
    stream = chain(held[:mine], own)
    while len(record := tuple(islice(stream, 4))) == 4:
        yield record
    if record and len(record := (*record, *islice(chain(held[mine:], rest), 4 - len(record)))) == 4:
        yield record


def parted(head: bytes) -> tuple[bytes, bytes]:
    """(name, comment) of a header."""
    name, _, comment = head[1:].partition(b" ")
    return name, comment


def fastq_records(path: str, begin: int, end: int) -> Iterator[tuple[str, str, str, str]]:
    """(name, comment, sequence, quality) of the records that begin in a part."""
    for head, seq, _, qual in raw_records(path, begin, end):
        yield tuple(x.decode() for x in (*parted(head), seq, qual))


def directory(spark: SparkSession, pairs: list[tuple[str, str]], split: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """(pair, mate, path, begin, end, first, records): the parts of both files of each pair, with the number of the first record of each. One pass that only counts."""
    files = [p for pair in pairs for p in pair]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(records=[sum(1 for _ in raw_records(p, a, b)) for p, a, b in zip(batch["path"], batch["begin"], batch["end"], strict=True)])

    counted = spread(parts(spark, files, split), tasks).mapInPandas(count, "file long, path string, begin long, end long, records long")
    before = F.coalesce(F.sum("records").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select(F.floor(F.col("file") / 2).alias("pair"), (F.col("file") % 2).alias("mate"), "path", "begin", "end", before.alias("first"), "records")


def fastq_pairs(spark: SparkSession, pairs: list[tuple[str, str]], split: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """(name, comment, seq1, qual1, seq2, qual2): a row for each pair of records, until either file ends.

    Every part of a first file reads its mates from the part of the second one that holds the record of the same number, and skips what is before it: at most one part's
    records. The directory has a row for each part and is read twice, so it is settled as a table in memory or on disk.
    """
    found = directory(spark, pairs, split, tasks).persist()
    one = found.where("mate = 0 and records > 0")
    two = found.where("mate = 1 and records > 0").select("pair", F.col("path").alias("path2"), F.col("begin").alias("begin2"), F.col("first").alias("first2"), (F.col("first") + F.col("records")).alias("beyond2"))
    matched = one.join(two, "pair").where((F.col("first2") <= F.col("first")) & (F.col("first") < F.col("beyond2")))
    work = matched.select("path", "begin", "end", "path2", "begin2", (F.col("first") - F.col("first2")).alias("skip"))

    def mates(path: str, begin: int, skip: int) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
        with open_binary(path) as f:
            size = f.size()
        return islice(raw_records(path, begin, size), skip, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "comment", "seq1", "qual1", "seq2", "qual2"]
        for batch in batches:
            for path, begin, end, path2, begin2, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = zip(raw_records(path, begin, end), mates(path2, begin2, skip))  # noqa: B905  the shorter file ends both
                while rows := [(*parted(a[0]), a[1], a[3], b[1], b[3]) for a, b in islice(both, 8192)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(pa.string()) for c in zip(*rows, strict=True)], names=names)

    return spread(work, tasks).mapInArrow(run, "name string, comment string, seq1 string, qual1 string, seq2 string, qual2 string")
