"""bigWig files: written and read back, by region, with the sections that a region needs and no others; all three kinds of sections."""

import random
import struct
import zlib

import pytest

from strandlake.operators import coverage
from strandlake.sources import bigwig, binary

LENGTHS = [("chr2", 3_000_000), ("chr10", 500_000), ("chrM", 16_569)]


def track(seed, n):
    r = random.Random(seed)
    out = []
    for chrom, length in LENGTHS:
        at = 0
        for _ in range(n):
            at += r.choice([0, 0, 1, 400])
            end = at + r.choice([1, 10, 50, 20_000 if r.random() < 0.01 else 5])
            if end > length:
                break
            out.append((chrom, at, end, float(r.randrange(40)) / 4))
            at = end
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    bigwig.register(spark)
    rows = {g: track(k, 4000) for k, g in enumerate("abc")}
    df = spark.createDataFrame([(g, *r) for g, own in rows.items() for r in own] + [("a", "chrX", 1, 2, 1.0)], "cell string, chrom string, pos0 long, pos1 long, value double")
    path = str(tmp_path_factory.mktemp("bw"))
    old, bigwig._FAN = bigwig._FAN, 256
    parts = {p.grp: p for p in bigwig.write_bigwig(df, LENGTHS, path, "cell", tasks=2).collect()}
    bigwig._FAN = old
    return rows, parts


def read(spark, path, **options):
    r = spark.read.format("bigwig").option("path", path)
    for k, v in options.items():
        r = r.option(k, v)
    return sorted(tuple(x)[1:] for x in r.load().collect())


def test_round_trip_and_parts(spark, written):
    rows, parts = written
    assert {g: p.intervals for g, p in parts.items()} == {g: len(own) for g, own in rows.items()}
    for g, own in rows.items():
        for split in (1, 5000, 1 << 30):
            assert read(spark, parts[g].path, split=split) == sorted(own)
    both = spark.read.format("bigwig").option("path", f"{parts['a'].path},{parts['b'].path}").load()
    assert both.count() == len(rows["a"]) + len(rows["b"])
    with binary.open_binary(parts["a"].path) as f:
        assert {n: length for n, (_, length) in bigwig.contigs(f).items()} == dict(LENGTHS)


@pytest.mark.parametrize("region", [("chr2", 10_000, 10_500), ("chr10", 0, 500_000), ("chrM", 16_000, 16_569), ("chr2", 2_999_999, 3_000_000), ("chr3", 0, 10)])
def test_regions(spark, written, region):
    rows, parts = written
    chrom, a, b = region
    want = sorted(r for r in rows["a"] if r[0] == chrom and r[1] < b and r[2] > a)
    assert read(spark, parts["a"].path, chrom=chrom, start=a, end=b) == want
    if chrom in dict(LENGTHS) and b - a <= 600:
        got = {r.pos0: r.value for r in bigwig.values(spark.read.format("bigwig").option("path", parts["a"].path).load(), chrom, a, b).collect()}
        assert got == {p: next((v for c, x, y, v in want if x <= p < y), None) for p in range(a, b)}


def test_other_sections_are_not_read(written):
    """Everything but the region's sections and the branches to them may be destroyed."""
    _, parts = written
    raw = open(parts["a"].path, "rb").read()
    with binary.open_binary(parts["a"].path) as f:
        number = bigwig.contigs(f)["chr2"][0]
        wanted = list(bigwig.sections(f, number, 40_000, 41_000))
        every = list(bigwig.sections(f, None, 0, 0))
    assert 1 <= len(wanted) <= 3 < len(every)
    broken = bytearray(raw)
    for place, n in set(every) - set(wanted):
        broken[place : place + n] = b"\xff" * n
    path = parts["a"].path + ".broken"
    open(path, "wb").write(bytes(broken))
    reader = bigwig.BigWigReader({"path": path, "chrom": "chr2", "start": "40000", "end": "41000"})
    whole = bigwig.BigWigReader({"path": parts["a"].path, "chrom": "chr2", "start": "40000", "end": "41000"})
    rows = [r[1:] for p in reader.partitions() for r in reader.read(p)]
    assert rows and rows == [r[1:] for p in whole.partitions() for r in whole.read(p)]
    with pytest.raises(zlib.error):
        every_one = bigwig.BigWigReader({"path": path})
        [r for p in every_one.partitions() for r in every_one.read(p)]


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_trees_of_any_depth(tmp_path, fan):
    old, bigwig._FAN = bigwig._FAN, fan
    leaves = [(c, 100 * k, 100 * k + 90, 1000 * c + k, 7) for c in range(3) for k in range(11)]
    raw = struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, 64, 64, 0, 0, 0, 0, 0, 0) + bigwig.range_tree(leaves, 64, 1)
    bigwig._FAN = old
    p = tmp_path / "t"
    p.write_bytes(raw)
    with binary.open_binary(str(p)) as f:
        assert list(bigwig.sections(f, None, 0, 0)) == [(x[3], 7) for x in leaves]
        for c in range(3):
            for a, b in ((0, 1), (95, 100), (250, 560), (1089, 5000)):
                assert list(bigwig.sections(f, c, a, b)) == [(x[3], 7) for x in leaves if x[0] == c and x[1] < b and x[2] > a]


def test_kinds_of_sections():
    variable = struct.pack("<IIIIIBBH", 4, 10, 40, 0, 5, bigwig.VARIABLE, 0, 2) + struct.pack("<IfIf", 10, 1.5, 30, 2.5)
    fixed = struct.pack("<IIIIIBBH", 4, 10, 40, 10, 5, bigwig.FIXED, 0, 3) + struct.pack("<fff", 1, 2, 3)
    assert bigwig.items(variable) == (4, [(10, 15, 1.5), (30, 35, 2.5)])
    assert bigwig.items(fixed) == (4, [(10, 15, 1.0), (20, 25, 2.0), (30, 35, 3.0)])


def test_track_means(spark, written):
    rows, parts = written
    df = spark.read.format("bigwig").option("path", parts["b"].path).option("chrom", "chrM").load().withColumn("cell", spark.range(1).selectExpr("'b' AS c").scalar())
    got = {r.bin_start: r["mean"] for r in coverage.mean_track(df, 1000).collect()}
    want = {}
    for c, a, _, v in rows["b"]:
        if c == "chrM":
            want.setdefault(a // 1000 * 1000, []).append(v)
    assert got == {k: pytest.approx(sum(v) / len(v)) for k, v in want.items()}
