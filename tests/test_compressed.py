"""Parts of compressed files: any size of parts and blocks gives the rows of one."""

import gzip
import random
import struct
import zlib

import pytest

from strandlake.operators import codes
from strandlake.sources import compressed, readers


def blocked(data: bytes, size: int) -> bytes:
    """Block-compressed bytes with `size` bytes of text in each block and the empty block at the end."""
    out = b""
    for k in [*range(0, len(data), size), len(data)]:
        part = data[k : k + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def reads(seed, n):
    """Records whose qualities begin with '@' and '+' often."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        length = r.randint(1, 60)
        out.append((f"read{k}", f"c{k}" if k % 3 else "", "".join(r.choice("ACGT") for _ in range(length)), "".join(r.choice("@+I#@+") for _ in range(length))))
    return out


def fastq(rows, end="\n"):
    return "".join(f"@{n} {c}{end}{s}{end}+{end}{q}{end}" if c else f"@{n}{end}{s}{end}+{end}{q}{end}" for n, c, s, q in rows).encode()


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("fastq")
    one, two = reads(1, 700), reads(2, 650)
    made = {}
    for kind, write in {"plain": lambda x: x, "gzip": gzip.compress, "small": lambda x: blocked(x, 97), "large": lambda x: blocked(x, 5000)}.items():
        for mate, rows in (("1", one), ("2", two)):
            p = d / f"{kind}_{mate}"
            p.write_bytes(write(fastq(rows)))
            made[kind, mate] = str(p)
    return one, two, made


@pytest.mark.parametrize("split", [150, 1000, 20_000, 1 << 27])
def test_pairs_of_any_parts(spark, files, split):
    one, two, made = files
    want = sorted((a[0], a[1], a[2], a[3], b[2], b[3]) for a, b in zip(one, two, strict=False))
    for first, second in (("small", "large"), ("plain", "small"), ("gzip", "plain"), ("large", "gzip")):
        got = compressed.fastq_pairs(spark, [(made[first, "1"], made[second, "2"])], split, tasks=8)
        assert sorted(tuple(r) for r in got.collect()) == want, (first, second)


def test_directory_numbers_records(spark, files):
    made = files[2]
    rows = compressed.directory(spark, [(made["small", "1"], made["large", "2"])], 1000, tasks=4).collect()
    for mate, total in ((0, 700), (1, 650)):
        own = sorted((r.begin, r.first, r.records) for r in rows if r.mate == mate)
        assert len(own) > 10 and sum(n for _, _, n in own) == total
        assert all(first == sum(n for _, _, n in own[:k]) for k, (_, first, _) in enumerate(own))


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\nb", b"\n\n\nx\n", b"long " * 500 + b"\nshort\n", "é\r\nü\r\n".encode() * 40, b"x" * 97 + b"\n" + b"y" * 97 + b"\n"])
def test_every_line_once(tmp_path, text):
    want = [x.removesuffix(b"\r") for x in text.split(b"\n")]
    want = want[:-1] if want[-1] == b"" else want
    for name, data in (("p", text), ("z", gzip.compress(text)), ("b", blocked(text, 97)), ("c", blocked(text, 1))):
        p = tmp_path / name
        p.write_bytes(data)
        for split in (1, 7, 40, 130, 1 << 20):
            step = split if name != "z" else 1 << 40
            got = [x for a in range(0, max(len(data), 1), step) for x in compressed.lines(str(p), a, min(a + step, len(data)))]
            assert got == want, (name, split)


def test_vcf_in_parts(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    body = "".join(f"chr{k % 3}\t{k + 1}\t.\tA\tC,G\t.\t.\t.\tGT:DP:AD\t0/1:{k}:{k},1,2\t./.:.:.\n" for k in range(400))
    plain, packed = tmp_path / "a.vcf", tmp_path / "b.vcf.gz"
    plain.write_text(head + body)
    packed.write_bytes(blocked((head + body).encode(), 300))
    want = sorted(map(repr, readers.vcf(spark, str(plain)).collect()))
    for split in (500, 1 << 20):
        assert sorted(map(repr, readers.vcf(spark, [str(packed)], split).collect())) == want and len(want) == 800


def test_counting_decodes_nothing_and_reads_stay_in_place(spark, tmp_path, monkeypatch):
    path = tmp_path / "r.fq"
    path.write_bytes(b"".join(b"@r%d c\nAC\n+\n@I\n" % k for k in range(500)) + b"@cut\nA\n")
    size = path.stat().st_size
    for step in (1, 7, 64, 1000, size):
        got = [r for a in range(0, size, step) for r in compressed.raw_records(str(path), a, min(a + step, size))]
        assert [r[0] for r in got] == [b"@r%d c" % k for k in range(500)]
    seqs = spark.createDataFrame([("a", "ACGTACGTAGGAACGTACGTACTCACGTACGTAAGGACGTACGTATGG"), ("b", "ACGTACGTAGGAACGTACGTACTT")], "name string, seq2 string")
    listed = spark.createDataFrame([(p, 0, "ACGTACGT") for p in "DCBA"], "position string, ord int, seq string")
    fixed = codes.correct(seqs, listed, qual=None)
    assert "hashpartitioning(code_" not in fixed._jdf.queryExecution().executedPlan().toString()
    assert {r["name"]: (r.ok, r.insert) for r in fixed.collect()} == {"a": (True, "GG"), "b": (False, "")}
    lines = ["\t".join(["q", "4", "*", "0", "0", "*", "*", "0", "0", "AC", "II", "CB:Z:x"]), " ".join(["p", "4", "*", "0", "0", "*", "*", "0", "0", "AC", "II"]), "short\tline"]
    rows = readers.parse_sam(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 2
    assert [(r.qname, r.cb) for r in rows.collect()] == [("q", "x"), ("p", None)]
