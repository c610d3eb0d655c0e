"""Python data sources for paired FASTQ (plain or gzip) and BAM files; a partition reads one pair of files or one file."""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEQUENCE, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def records(stream) -> Iterator[tuple[str, str, str, str]]:
    """(name, comment, sequence, quality) of a FASTQ stream; stops at a cut record."""
    while True:
        head, seq, _, qual = (stream.readline() for _ in range(4))
        if not qual:
            return
        name, _, comment = head.rstrip("\n")[1:].partition(" ")
        yield name, comment, seq.rstrip("\n"), qual.rstrip("\n")


def store_of(path: str):
    """(store, name in it) of a path in any store that pyarrow knows by its scheme (file, hdfs, s3, gs, abfs); a path without one is local."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_binary(path: str):
    store, name = store_of(path)
    return store.open_input_file(name)


def open_text(path: str):
    raw = open_binary(path)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, encoding="utf-8")


class FastqPairs(DataSource):
    """format("fastq_pairs"), options r1 and r2: comma lists of files. A row for each pair, until either file ends."""

    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return "name string, comment string, seq1 string, qual1 string, seq2 string, qual2 string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.pairs = list(zip(options["r1"].split(","), options["r2"].split(","), strict=True))

    def partitions(self):
        return [InputPartition(p) for p in self.pairs]

    def read(self, partition):
        with open_text(partition.value[0]) as one, open_text(partition.value[1]) as two:
            for (name, comment, s1, q1), (_, _, s2, q2) in zip(records(one), records(two)):  # noqa: B905  the shorter file ends both
                yield name, comment, s1, q1, s2, q2


class Bam(DataSource):
    """format("bam"), option path: comma list of files. Positions are 1-based as in SAM; tags CB, BC and RG."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, seq string, qual string, cb string, bc string, rg string"

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


def tags(data: bytes) -> dict[str, str]:
    """Text tags of a record."""
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    out, at = {}, 0
    while at + 3 <= len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[key] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + sizes[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += sizes[kind]
    return out


def block_at(raw: bytes, at: int) -> int:
    """Size of the BGZF block that starts at `at`, 0 if none does."""
    if raw[at : at + 4] != b"\x1f\x8b\x08\x04" or raw[at + 12 : at + 16] != b"BC\x02\x00":
        return 0
    return struct.unpack_from("<H", raw, at + 16)[0] + 1


class Blocks:
    """Bytes of a BGZF file from a block on, decompressed block by block. `at` is where the next block starts, `last` where the last one read did."""

    def __init__(self, f, at: int):
        self.f, self.at, self.last, self.held = f, at, at, b""

    def more(self) -> bool:
        self.f.seek(self.at)
        head = self.f.read(18)
        size = block_at(head, 0) if len(head) == 18 else 0
        if not size:
            return False
        self.held += zlib.decompress((head + self.f.read(size - 18))[18:], -15)
        self.last, self.at = self.at, self.at + size
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out

    def place(self) -> int:
        """Where the block starts that holds the next byte."""
        return self.last if self.held else self.at


def plausible(raw: bytes, at: int, contigs: int, chain: int = 4) -> bool:
    """Whether records follow each other from `at` on, as many as `chain` or up to the end of what is there."""
    for k in range(chain):
        if at + 36 > len(raw):
            return k > 0
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", raw, at)
        need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        if not (l_name and l_seq >= 0 and need <= size < 1 << 26 and -1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1):
            return False
        name = raw[at + 36 : at + 36 + l_name]
        if len(name) == l_name and (name[-1] or not all(32 < c < 127 for c in name[:-1])):
            return False
        at += 4 + size
    return True


#: Bytes of a BAM file that a partition reads.
SPLIT = 1 << 27


class BamReader(DataSourceReader):
    """A file is cut every `split` bytes, and a record is read by the part in which the block starts that holds its first byte."""

    def __init__(self, options):
        self.paths, self.split = options["path"].split(","), int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path in self.paths:
            with open_binary(path) as f:
                size = f.size()
            out += [InputPartition((path, at, min(at + self.split, size))) for at in range(0, max(size, 1), self.split)]
        return out

    def read(self, partition):
        path, begin, end = partition.value
        with open_binary(path) as f:
            s = Blocks(f, 0)
            if s.take(4) != b"BAM\1":
                raise ValueError(f"{path} is not a BAM file in blocks")
            number = lambda: struct.unpack("<i", s.take(4))[0]
            s.take(number())
            contigs = []
            for _ in range(number()):
                contigs.append(s.take(number())[:-1].decode())
                s.take(4)
            if s.place() < begin:
                s = self.first_record(f, begin, end, len(contigs))
            if s:
                yield from self.records(s, contigs, end)

    def first_record(self, f, begin: int, end: int, contigs: int) -> Blocks | None:
        """The stream at the first record whose block starts within the part."""
        at = self.first_block(f, begin, end)
        if at is None:
            return None
        ahead, tried = Blocks(f, at), 0
        while True:
            for _ in range(4):
                ahead.more()
            start = next((k for k in range(tried, len(ahead.held)) if plausible(ahead.held, k, contigs)), None)
            if start is not None or ahead.at >= end:
                break
            tried = max(tried, len(ahead.held) - (1 << 16))
        if start is None:
            return None
        s = Blocks(f, at)  # blocks that were read ahead are given back
        s.take(start)
        return s

    def first_block(self, f, begin: int, end: int) -> int | None:
        """Where the first block starts from `begin` on: one whose next neighbour is a block too, or the file's end."""
        f.seek(begin)
        raw = f.read((1 << 17) + 64)
        for k in range(len(raw)):
            if begin + k >= end:
                return None
            size = block_at(raw, k)
            if size and (k + size == len(raw) or begin + k + size >= f.size() or block_at(raw, k + size)):
                return begin + k
        return None

    def records(self, s: Blocks, contigs: list[str], end: int):
        name_of = lambda i: contigs[i] if i >= 0 else "*"
        while True:
            if s.place() >= end:  # the next record begins in the next part
                return
            if len(size := s.take(4)) < 4:
                return
            d = s.take(struct.unpack("<i", size)[0])
            ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", d)
            at = 32 + l_name
            ops = struct.unpack_from(f"<{n_cigar}I", d, at)
            at += 4 * n_cigar
            packed = d[at : at + (l_seq + 1) // 2]
            at += len(packed)
            seq = "".join(SEQUENCE[b >> 4] + SEQUENCE[b & 15] for b in packed)[:l_seq]
            quality = d[at : at + l_seq]
            qual = "*" if quality[:1] in (b"", b"\xff") else "".join(chr(q + 33) for q in quality)
            t = tags(d[at + l_seq :])
            cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*"
            yield d[32 : 31 + l_name].decode(), flag, name_of(ref), pos + 1, mapq, cigar, name_of(mate), mate_pos + 1, tlen, seq or "*", qual, t.get("CB"), t.get("BC"), t.get("RG")


def register(spark) -> None:
    for source in (FastqPairs, Bam):
        spark.dataSource.register(source)
