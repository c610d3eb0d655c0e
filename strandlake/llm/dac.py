"""Token ids in directly addressable codes: chunk levels with continuation bitmaps and rank directories.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id; a bitmap has
one bit for each, set where the id goes on, and a directory has the number of set bits before every
block of 512. The next chunk of an id that goes on stands in the next level at the rank of its bit. So any
token is found with one directory look-up and one count of bits for each level, without decoding a block.

On disk a data set is a Parquet table of segments (any store that Spark reaches): shard and segment
number, the documents' ids and first positions, and for each level its chunks, bitmap and directory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, partitions

BLOCK = 512
#: A segment is closed once it holds so many ids (a longer document is a segment of its own).
SEGMENT = 1 << 20
#: Chunks of text in each of the two generations that a worker keeps ids of.
CACHE = 600_000
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SCHEMA = "shard int, segment int, n_ids long, doc_ids binary, has_id binary, starts binary, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, bitmap and directory of each level."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        bitmaps.append(bits.tobytes())
        per_block = np.add.reduceat(POPCOUNT[bits], np.arange(0, len(bits), BLOCK // 8), dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
        ranks.append((np.cumsum(per_block) - per_block).astype("<u4").tobytes())
        if not more.any():
            return chunks, bitmaps, ranks
        rest = rest[more] >> 8


class Codes:
    """Random access to packed ids."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.bitmaps = [np.frombuffer(b, np.uint8) for b in bitmaps]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def __getitem__(self, i: int) -> int:
        """The id at position i: a look-up in each level that it reaches."""
        value = 0
        for level, (chunk, bits, ranks) in enumerate(zip(self.chunks, self.bitmaps, self.ranks, strict=True)):
            value |= int(chunk[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            i = int(ranks[block]) + int(POPCOUNT[bits[block * (BLOCK // 8) : i >> 3]].sum()) + int(POPCOUNT[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def rank(self, level: int, i: int) -> int:
        """Set bits of a level before position i."""
        bits, block = self.bitmaps[level], i // BLOCK
        if block >= len(self.ranks[level]):
            block = len(self.ranks[level]) - 1
        if block < 0:
            return 0
        n = int(self.ranks[level][block]) + int(POPCOUNT[bits[block * (BLOCK // 8) : i >> 3]].sum())
        return n + (int(POPCOUNT[bits[i >> 3] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids at positions a to b, reading those positions of each level only."""
        out = np.zeros(b - a, np.uint32)
        at = np.arange(b - a)
        for level in range(len(self.chunks)):
            if a >= b:
                break
            out[at] |= self.chunks[level][a:b].astype(np.uint32) << np.uint32(8 * level)
            first = a >> 3
            bits = np.unpackbits(self.bitmaps[level][first : (b + 7) >> 3], bitorder="little")[a - 8 * first : b - 8 * first]
            at = at[bits.astype(bool)]
            if not len(at):
                break
            a = self.rank(level, a)
            b = a + len(at)
        return out


_IDS: dict[str, list[dict[bytes, bytes]]] = {}
_LETTERS = bpe.byte_letters()


def library_ids(path: str, texts: list[str | None]) -> list[np.ndarray]:
    """Ids that the tokenizers library gives each whole text, without special tokens added.

    The pre-tokenizer drops white space and no rule looks across it, so a text is encoded chunk by chunk and a worker keeps the ids of the
    chunks that it has met (two bounded generations). New chunks go through the library's normaliser, pre-tokenizer and model, each word once.
    """
    codec = bpe.codec(path)
    known, old = _IDS.setdefault(path, [{}, {}])
    if len(known) > CACHE:
        known, old = _IDS[path] = [{}, known]
    out: list[np.ndarray | None] = []
    later: dict[int, list[bytes]] = {}
    for k, text in enumerate(texts):
        chunks = text.encode("utf-8").split() if text else []
        try:
            out.append(np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<u4"))
        except KeyError:  # a chunk that this worker hasn't met
            out.append(None)
            later[k] = chunks
    missing = set().union(*later.values()).difference(known)
    again = missing.intersection(old)
    known.update((c, old[c]) for c in again)
    plain, other, words = codec.split(list(missing - again))
    model, found = codec.parts.model, {b"": b""}
    for w in words:
        if w in known and w.isalpha():
            found[w] = known[w]
            continue
        tokens = model.tokenize(w.decode() if w.isascii() and w.isalpha() else "".join([_LETTERS[b] for b in w]))
        found[w] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
    known.update((c, found[b] + found[t]) for c, b, t in plain)
    for c, s in other:
        known[c] = b"".join([w.to_bytes(4, "little") if isinstance(w, int) else found[w] for w in s])
    for k, chunks in later.items():
        out[k] = np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<u4")
    return out


def write(docs: DataFrame, target: str, vocabulary: str | None = None, end: int | None = 2) -> None:
    """Encodes every whole text, appends `end` (none if None) and writes segments in ascending doc_id order.

    Order: doc_id (null first), then text, so that repeated ids have a defined order; null text is an
    empty document. One range exchange of the texts; each task streams its sorted run into segments,
    holding one at a time.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, total = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs_: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, docs_, held, total, segment
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = total + np.cumsum(sizes) - sizes
            chunks, bitmaps, ranks = pack(np.concatenate(ids))
            row = {
                "shard": [shard], "segment": [segment], "n_ids": [held],
                "doc_ids": [np.array([d or 0 for d in docs_], "<i8").tobytes()], "has_id": [bytes(d is not None for d in docs_)],
                "starts": [starts.astype("<i8").tobytes()], "chunks": [chunks], "bitmaps": [bitmaps], "ranks": [ranks],
            }
            total, segment, ids, docs_, held = total + held, segment + 1, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=ARROW)

        tail = np.array([] if end is None else [end], "<u4")
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                for d, x in zip(part.column(0).to_pylist(), library_ids(vocabulary, part.column(1).to_pylist()), strict=True):
                    ids.append(np.concatenate([x, tail]))
                    docs_.append(d)
                    held += len(ids[-1])
                    if held >= SEGMENT:
                        yield close()
        if docs_:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(target)


ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("has_id", pa.binary()), ("starts", pa.binary()), ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def read(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) for every document of a data set; ids are little-endian 32-bit.

    `start` counts the ids of all documents before. Only the totals of the shards, one long for each task that
    wrote, pass the driver. `ids` costs nothing where it is not selected downstream of digest().
    """
    return _read(spark, target, True)


def digest(spark: SparkSession, target: str) -> DataFrame:
    """As read(), without the ids themselves."""
    return _read(spark, target, False)


def _read(spark: SparkSession, target: str, with_ids: bool) -> DataFrame:
    segments = spark.read.schema(SCHEMA).parquet(target)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    base, at = {}, 0
    for shard, n in totals:
        base[shard] = at
        at += n
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                codes = Codes(row["chunks"], row["bitmaps"], row["ranks"])
                doc_ids, starts = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
                ends = np.append(starts[1:], starts[0] + row["n_ids"])
                crcs, blobs = [], []
                for a, b in zip(starts - starts[0], ends - starts[0], strict=True):
                    raw = codes.slice(int(a), int(b)).astype("<u4").tobytes()
                    crcs.append(zlib.crc32(raw))
                    if with_ids:
                        blobs.append(raw)
                has = np.frombuffer(row["has_id"], np.uint8).astype(bool)
                arrays = [pa.array(doc_ids, mask=~has), pa.array(starts + base[row["shard"]]), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(blobs, pa.binary())] if with_ids else []), names=names)

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the documents to a scratch data set and returns its digest, read back from the files: one row for every row.

    Null and empty texts hold the end id only. Rows of one id (or of a null id, which come first) stand in the order of their texts; repeated rows
    have a row each, and which of two equal ones comes first makes no difference. Texts are encoded whole. An empty table gives an empty one;
    other columns are not read.
    """
    spark = docs.sparkSession
    target = Scratch(spark, "tokens").path()
    write(docs, target, vocabulary)
    return digest(spark, target)
