"""Alignment files: BAM parts in coordinate order, one or more for each group, with an index, and reading of a region by offsets.

Records are dealt out by ranges of (group, contig, place), so a task writes many small groups and a large group is written by many tasks. Each part is a whole BAM file with a bin
and linear index (BAI) beside it. Parts are written under a name of their own attempt and moved, so a repeated task leaves one file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import OPERATIONS, SEQUENCE, BamReader, Blocks, open_binary, store_of

COLUMNS = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual", "cb", "bc", "rg")
#: Text bytes of a block; the format allows 64 KiB.
BLOCK = 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
WINDOW = 14


def bin_of(begin: int, end: int) -> int:
    """Number of the smallest bin that holds [begin, end): 8^k bins of 2^(29 - 3k) bases on level k, counted from the top."""
    end -= 1
    if begin >> WINDOW == end >> WINDOW:
        return 4681 + (begin >> WINDOW)
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if begin >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def bins_of(begin: int, end: int) -> list[int]:
    """All bins that overlap [begin, end)."""
    return [0] + [((1 << 3 * k) - 1) // 7 + b for k in range(1, 6) for b in range(begin >> 29 - 3 * k, (end - 1 >> 29 - 3 * k) + 1)]


class _Codes(dict):
    """Hexadecimal digits of base codes for str.translate; what has no code is 15."""

    def __missing__(self, key: int) -> str:
        return "f"


HEAD = struct.Struct("<iiiBBHHHiiii")
DIGITS = _Codes({ord(c): f"{k:x}" for k, c in enumerate(SEQUENCE)})
LESS_33 = bytes((k - 33) % 256 for k in range(256))


# Values that records share are encoded once for each of the last 65,536 that a task met.
@lru_cache(1 << 16)
def operations(cigar: str) -> tuple[bytes, int]:
    """A CIGAR as packed operations, and the bases of the reference that it spans, 1 at least."""
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return struct.pack(f"<{len(ops)}I", *[n << 4 | OPERATIONS.index(o) for n, o in ops]), sum(n for n, o in ops if o in "MDN=X") or 1


def bases(seq: str) -> tuple[bytes, int]:
    """Two bases a byte, and their number."""
    return bytes.fromhex(seq.translate(DIGITS) + "0" * (len(seq) % 2)), len(seq)


def scores(qual: str) -> bytes:
    return qual.encode().translate(LESS_33) if qual.isascii() and min(qual, default="!") >= "!" else bytes(ord(c) - 33 for c in qual)


@lru_cache(1 << 16)
def tag(key: bytes, value: str | None) -> bytes:
    return b"" if value is None else key + b"Z" + value.encode() + b"\0"


class Writer:
    """Blocks of a BAM file and its index. Virtual offsets are a block's place, shifted by 16 bits, plus the place in its text."""

    def __init__(self, out, contigs: list[tuple[str, int]]):
        self.out, self.at, self.held = out, 0, bytearray()
        self.ids = {name: k for k, (name, _) in enumerate(contigs)}
        self.bins = [defaultdict(list) for _ in contigs]
        self.linear = [{} for _ in contigs]
        self.placeless, self.n = 0, 0
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{name}\tLN:{length}\n" for name, length in contigs)
        head = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(contigs))
        for name, length in contigs:
            head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
        self.add(head)
        self.flush()

    def add(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK:
            self.block(bytes(self.held[:BLOCK]))
            del self.held[:BLOCK]

    def block(self, text: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(text) + z.flush()
        raw = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))
        self.out.write(raw)
        self.at += len(raw)

    def flush(self) -> None:
        if self.held:
            self.block(bytes(self.held))
            self.held.clear()

    def offset(self) -> int:
        return self.at << 16 | len(self.held)

    def record(self, qname, flag, chrom, pos, mapq, cigar, mate_chrom, mate_pos, tlen, seq, qual, cb, bc, rg) -> None:
        ref, begin = self.ids.get(chrom, -1), (pos or 0) - 1
        mate = ref if mate_chrom == "=" else self.ids.get(mate_chrom, -1)
        ops, span = operations(cigar or "")
        end = begin + span
        packed, n = bases("" if seq in (None, "*") else seq)
        quality = b"\xff" * n if qual in (None, "*") else scores(qual)
        name = (qname or "*").encode() + b"\0"
        tags = tag(b"CB", cb) + tag(b"BC", bc) + tag(b"RG", rg)
        number = bin_of(begin, end) if begin >= 0 else 4680
        size = HEAD.size - 4 + len(name) + len(ops) + len(packed) + len(quality) + len(tags)
        before = self.offset()
        self.add(b"".join((HEAD.pack(size, ref, begin, len(name), mapq or 0, number, len(ops) // 4, flag or 0, n, mate, (mate_pos or 0) - 1, tlen or 0), name, ops, packed, quality, tags)))
        self.n += 1
        if ref < 0 or begin < 0:
            self.placeless += 1
            return
        chunks = self.bins[ref][number]
        if chunks and chunks[-1][1] == before:
            chunks[-1][1] = self.offset()
        else:
            chunks.append([before, self.offset()])
        for w in range(begin >> WINDOW, (end - 1 >> WINDOW) + 1):
            self.linear[ref].setdefault(w, before)

    def close(self) -> bytes:
        """Ends the file; the index as bytes."""
        self.flush()
        self.out.write(END)
        index = b"BAI\1" + struct.pack("<i", len(self.bins))
        for bins, linear in zip(self.bins, self.linear, strict=True):
            index += struct.pack("<i", len(bins))
            for number, chunks in sorted(bins.items()):
                index += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
            n, last = max(linear, default=-1) + 1, 0
            index += struct.pack("<i", n)
            for w in range(n):
                last = linear.get(w, last)
                index += struct.pack("<Q", last)
        return index + struct.pack("<Q", self.placeless)


def write_bam(reads: DataFrame, contigs: list[tuple[str, int]], path: str, by: str | None = "cb", tasks: int | None = None) -> DataFrame:
    """Writes `path`/<group>/part-<k>.bam with .bam.bai beside it and returns (grp, path, records, bytes) for each part.

    reads: the columns of the BAM reader, pos 1-based; by: the column of the group (null: the group `none`), or None for a single group `all`. Records of contigs that the list lacks and those
    without a place come last. A group's parts follow each other in coordinate order by their numbers.
    """
    group = F.coalesce(F.col(by).cast("string"), F.lit("none")) if by else F.lit("all")
    place = F.array_position(F.array(*[F.lit(n) for n, _ in contigs]), F.col("chrom"))
    rank = F.when(place.isNull() | (place == 0) | F.coalesce(F.col("pos") < 1, F.lit(True)), F.lit(1 << 30)).otherwise(place).cast("int")
    rows = reads.select(group.alias("__group"), rank.alias("__rank"), *COLUMNS)
    order = ["__group", "__rank", "pos", "qname", "flag"]
    dealt = rows.repartitionByRange(tasks, *order) if tasks else rows.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        now, last, out, writer, done = None, None, None, None, []

        def close() -> None:
            folder = f"{base}/{now}"
            index = writer.close()
            out.close()
            with store.open_output_stream(f"{folder}/.{attempt}.bai") as f:
                f.write(index)
            store.move(f"{folder}/.{attempt}.bai", f"{folder}/part-{part:06d}.bam.bai")
            store.move(f"{folder}/.{attempt}.bam", f"{folder}/part-{part:06d}.bam")
            done.append((now, f"{path}/{now}/part-{part:06d}.bam", writer.n, writer.at + len(END)))

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                columns = [c.to_pylist() for c in batch.slice(k, 4096).columns]
                for group_, _, *record in zip(*columns, strict=True):
                    name = now if group_ == last else re.sub(r"[^A-Za-z0-9_.=+-]", "_", group_)
                    last = group_
                    if name != now:
                        if writer:
                            close()
                        now = name
                        store.create_dir(f"{base}/{now}", recursive=True)
                        out = store.open_output_stream(f"{base}/{now}/.{attempt}.bam")
                        writer = Writer(out, contigs)
                    writer.record(*record)
        if writer:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["grp", "path", "records", "bytes"])

    written = dealt.sortWithinPartitions(*order).mapInArrow(run, "grp string, path string, records long, bytes long")
    # Written once, here: what is returned is the list of parts, a row each.
    return reads.sparkSession.createDataFrame(written.collect(), written.schema)


def chunks_of(index: bytes, ref: int, begin: int, end: int) -> list[tuple[int, int]]:
    """Spans of virtual offsets in which records that overlap [begin, end) of a contig may begin, in order, merged where they share a block."""
    at, number = 8, struct.unpack_from("<i", index, 4)[0]
    if index[:4] != b"BAI\1" or not 0 <= ref < number:
        return []
    wanted, found = set(bins_of(begin, end)), []
    for k in range(number):
        n_bin = struct.unpack_from("<i", index, at)[0]
        at += 4
        for _ in range(n_bin):
            b, n = struct.unpack_from("<Ii", index, at)
            if k == ref and b in wanted:
                found += [struct.unpack_from("<QQ", index, at + 8 + 16 * c) for c in range(n)]
            at += 8 + 16 * n
        n = struct.unpack_from("<i", index, at)[0]
        if k == ref:
            linear = struct.unpack_from(f"<{n}Q", index, at + 4)
            least = linear[min(begin >> WINDOW, n - 1)] if n else 0
            out: list[tuple[int, int]] = []
            for a, b in sorted(c for c in found if c[1] > least):
                a = max(a, least)
                if out and a >> 16 <= out[-1][1] >> 16:
                    out[-1] = (out[-1][0], max(out[-1][1], b))
                else:
                    out.append((a, b))
            return out
        at += 4 + 8 * n
    return []


def region_records(path: str, chrom: str, begin: int, end: int) -> Iterator[tuple]:
    """Records of an indexed file that overlap [begin, end), 0-based, of a contig; only blocks that the index names are read."""
    with open_binary(path) as f, open_binary(path + ".bai") as g:
        index = g.read()
        s = Blocks(f, 0)
        s.take(4)
        number = lambda: struct.unpack("<i", s.take(4))[0]
        s.take(number())
        contigs = []
        for _ in range(number()):
            contigs.append(s.take(number())[:-1].decode())
            s.take(4)
        reader = BamReader({"path": path})
        for a, b in chunks_of(index, contigs.index(chrom) if chrom in contigs else -1, begin, end):
            s = Blocks(f, a >> 16)
            s.take(a & 0xFFFF)
            # Up to the last record that begins in the span's last block; no other span has that block.
            for r in reader.records(s, contigs, (b >> 16) + 1):
                if r[2] != chrom or r[3] > end:
                    return
                length = sum(int(n) for n in re.findall(r"(\d+)[MDN=X]", r[5])) or 1
                if r[3] - 1 + length > begin:
                    yield r


def read_region(spark: SparkSession, parts: DataFrame, chrom: str, begin: int, end: int) -> DataFrame:
    """The records of written parts (path) that overlap [begin, end), 0-based, of a contig, with the columns of the BAM reader."""
    schema = "qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, seq string, qual string, cb string, bc string, rg string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for r in region_records(path, chrom, begin, end):
                    rows.append(r)
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=COLUMNS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=COLUMNS)

    return parts.select("path").repartition("path").mapInArrow(run, schema)
