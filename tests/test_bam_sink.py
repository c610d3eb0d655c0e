"""Written BAM parts: read back whole and by region, with indexes that name few blocks."""

import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandlake.sources import bam_sink, binary

SCHEMA = "qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, seq string, qual string, cb string, bc string, rg string"
CONTIGS = [("chr2", 5_000_000), ("chr1", 300_000), ("chrM", 16_569)]


def drawn(n):
    r = random.Random(n)
    out = []
    for k in range(n):
        chrom = r.choice(["chr1", "chr2", "chr2", "chrM", "*"])
        top = dict(CONTIGS).get(chrom, 1)
        length = r.randint(1, 60)
        cigar = f"{length}M" if r.random() < 0.8 else f"{length}M{r.choice([5, 70_000])}N10M"
        seq = "".join(r.choice("ACGTN") for _ in range(length + (10 if "N10M" in cigar else 0)))
        qual = "".join(chr(33 + r.randrange(60)) for _ in seq) if r.random() < 0.9 else "*"
        cell = r.choice(["hot", "hot", "hot", "a b", "c/d", None])
        if chrom == "*":
            out.append((f"q{k}", 4, "*", 0, 0, "*", "*", 0, 0, seq, qual, cell, None, "rg"))
        else:
            out.append((f"q{k}", r.choice([0, 16, 99, 1024]), chrom, r.randint(1, max(1, top - 80_000)) if top > 80_000 else r.randint(1, top - 80), r.randrange(60), cigar, r.choice(["*", "chr1"]), r.randint(0, 1000), r.randint(-500, 500), seq, qual, cell, "ACGT", None))
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = drawn(6000)
    path = str(tmp_path_factory.mktemp("bam"))
    old, bam_sink.BLOCK = bam_sink.BLOCK, 0xFF00
    parts = bam_sink.write_bam(spark.createDataFrame(rows, SCHEMA), CONTIGS, path, tasks=5)
    bam_sink.BLOCK = old
    return rows, path, parts


def test_groups_and_parts(written):
    rows, path, parts = written
    found = parts.collect()
    assert sum(p.records for p in found) == len(rows)
    assert {p.grp for p in found} == {"hot", "a_b", "c_d", "none"}
    assert sum(p.grp == "hot" for p in found) > 1 and len(found) > len({p.path.split("/")[-1] for p in found})
    assert all(Path(p.path).stat().st_size == p.bytes and Path(p.path + ".bai").exists() for p in found)
    assert not [f for f in Path(path).rglob(".*") if f.is_file() and not f.name.endswith(".crc")]


def test_read_back_whole_in_order(spark, written):
    rows, _, parts = written
    binary.register(spark)
    paths = [p.path for p in parts.collect()]
    got = spark.read.format("bam").option("path", ",".join(paths)).option("split", 1 << 14).load().collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    order = {n: k for k, (n, _) in enumerate(CONTIGS)} | {"*": 99}
    hot = sorted(p.path for p in parts.collect() if p.grp == "hot")
    keys = [(order[r.chrom], r.pos) for p in hot for r in spark.read.format("bam").option("path", p).load().collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("region", [("chr1", 0, 300_000), ("chr1", 100_000, 100_500), ("chr2", 1_000_000, 1_200_000), ("chr2", 4_999_000, 5_000_000), ("chrM", 5, 6), ("chrX", 0, 10), ("chr1", 16_383, 16_385)])
def test_regions_equal_a_filter(spark, written, region):
    rows, _, parts = written
    chrom, begin, end = region
    span = lambda c: sum(int(n) for n, o in zip(c.replace("N", "M").split("M")[:-1], "MMM", strict=False))
    want = sorted(repr(r) for r in rows if r[2] == chrom and r[3] - 1 < end and r[3] - 1 + span(r[5]) > begin)
    got = sorted(repr(tuple(r)) for r in bam_sink.read_region(spark, parts, chrom, begin, end).collect())
    assert got == want


def test_an_index_names_few_blocks(spark, tmp_path):
    rows = [(f"q{k}", 0, "chr2", 1 + 20 * k, 60, "50M", "*", 0, 0, "ACGTA" * 10, "I" * 50, None, None, None) for k in range(40_000)]
    parts = bam_sink.write_bam(spark.createDataFrame(rows, SCHEMA), CONTIGS, str(tmp_path), by=None, tasks=1).collect()
    index = Path(parts[0].path + ".bai").read_bytes()
    chunks = bam_sink.chunks_of(index, 0, 400_000, 400_100)
    blocks = sum((b >> 16) - (a >> 16) for a, b in chunks)
    assert blocks < parts[0].bytes / 5
    assert struct.unpack_from("<Q", index, len(index) - 8)[0] == 0
    assert len(list(bam_sink.region_records(parts[0].path, "chr2", 400_000, 400_100))) == 7


def test_bins_hold_their_intervals():
    r = random.Random(1)
    for _ in range(500):
        a = r.randrange(1 << 29)
        b = min(a + r.choice([1, 100, 1 << 15, 1 << 22]), 1 << 29)
        assert bam_sink.bin_of(a, b) in bam_sink.bins_of(a, b) and bam_sink.bin_of(a, b) in bam_sink.bins_of(b - 1, b)
    assert bam_sink.bin_of(0, 1) == 4681 and bam_sink.bin_of(0, 1 << 29) == 0


def test_empty_table(spark, tmp_path):
    assert bam_sink.write_bam(spark.createDataFrame([], SCHEMA), CONTIGS, str(tmp_path), tasks=2).select(F.count("*")).first()[0] == 0


def test_shared_values_are_encoded_once():
    bam_sink.operations.cache_clear()
    writer = bam_sink.Writer(Path("/dev/null").open("wb"), [("chr1", 1000)])
    for k in range(50):
        writer.record(f"q{k}", 0, "chr1", k + 1, 9, "5S40M3D2I", "=", 0, 0, "ACGTN=x", "!~IIIII", "g", None, None)
    assert bam_sink.operations.cache_info().misses == 1 and bam_sink.operations("5S40M3D2I")[1] == 43 and bam_sink.operations("") == (b"", 1)
    assert bam_sink.bases("ACGTN=x") == (bytes([0x12, 0x48, 0xF0, 0xF0]), 7) and bam_sink.bases("é") == (b"\xf0", 1)
    assert bam_sink.scores("!~I") == bytes([0, 93, 40]) and bam_sink.scores("") == b""
    with pytest.raises(ValueError):
        bam_sink.scores(" ")
