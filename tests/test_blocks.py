import gzip
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from nadir.sources import blocks as B


def block_gzip(data, sizes):
    """Blocks of the given sizes in turn, and the empty one at the end."""
    out, at, k = b"", 0, 0
    while at < len(data) or k == 0:
        piece = data[at : at + sizes[k % len(sizes)]]
        at, k = at + len(piece), k + 1
        out += one_block(piece)
    return out + one_block(b"")


def one_block(piece):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(piece) + c.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(piece), len(piece))


def text(seed, n=300, end="\n"):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abé\t ") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(n)]
    return lines, end.join(lines).encode()


@pytest.mark.parametrize("kind", ["plain", "blocks", "gzip"])
@pytest.mark.parametrize("tail", [b"", b"\n"])
def test_ranges_hold_each_line_once(tmp_path, kind, tail):
    lines, data = text(1)
    data = data.rstrip(b"\n") + tail
    want = data.decode().removesuffix("\n").split("\n")
    path = str(tmp_path / "f.txt.gz")
    raw = {"plain": data, "blocks": block_gzip(data, [1, 70, 500, 2000]), "gzip": gzip.compress(data)}[kind]
    (tmp_path / "f.txt.gz").write_bytes(raw)
    for size in (1, 7, 64, 1000, 1 << 20):
        parts = B.plan(path, size)
        assert kind == "gzip" or len(parts) == -(-len(raw) // size)
        assert [x for p in parts for group in B._lines(p) for x in group] == want


def test_line_that_begins_where_a_range_does(tmp_path):
    data = b"aa\nbb\ncc\n"
    (tmp_path / "p").write_bytes(data)
    (tmp_path / "b").write_bytes(b"".join(map(one_block, (b"aa\n", b"bb\n", b"cc\n"))))
    for name in ("p", "b"):
        for size in range(1, 40):
            assert [x for p in B.plan(str(tmp_path / name), size) for group in B._lines(p) for x in group] == ["aa", "bb", "cc"]


def test_lines_are_those_of_the_text_reader(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes(text(2, end="\r\n")[1])
    (folder / "b.txt").write_bytes(b"")
    (folder / "_no").write_bytes(b"x\n")
    df = B.lines(spark, str(folder), 500)
    assert df.rdd.getNumPartitions() > 10
    assert sorted(r["value"] for r in df.collect()) == sorted(r["value"] for r in spark.read.text(str(folder)).collect())
    (tmp_path / "none").mkdir()
    assert B.lines(spark, str(tmp_path / "none")).count() == 0


def test_members_of_archives_are_partitions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.tsv", "h\n1\nh\n")
        z.writestr("two.tsv", "x\n")
    df = B.lines(spark, str(tmp_path / "a.zip"))
    assert df.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, df.select("member", "value").collect())) == [("one.tsv", "1"), ("one.tsv", "h"), ("one.tsv", "h"), ("two.tsv", "x")]
    assert B.lines(spark, str(tmp_path / "a.zip"), member="two.tsv").count() == 1


def test_sites_with_pushed_filters(spark, tmp_path):
    rows = [f"chr{1 + i % 3}\t{i}\t.\tA\tC\t.\tPASS\tAC={i}" for i in range(2000)]
    data = "\n".join(["##fileformat", "#CHROM", *rows, "chr1\tx\t.\tA\tC\t.\tPASS\tDB\tGT", "broken\t1"]).encode()
    (tmp_path / "v.vcf.bgz").write_bytes(block_gzip(data, [3000]))
    path = str(tmp_path / "v.vcf.bgz")
    assert B.header(path) == ["##fileformat", "#CHROM"]
    df = B.sites(spark, path, range_bytes=1000)
    assert df.rdd.getNumPartitions() > 5 and df.count() == 2001
    assert [tuple(r) for r in df.where("position is null").select("chromosome", "info").collect()] == [("1", "DB")]
    near = B.sites(spark, path, ("position", "chromosome", "info"), 1000).where("chromosome = '2' and position >= 100 and position < 110 and info <> 'AC=103'")
    assert sorted(r["position"] for r in near.collect()) == [100, 106, 109]
    assert B.sites(spark, path).where(F.col("chromosome").isin("1", "3")).count() == sum(i % 3 != 1 for i in range(2000)) + 1
    with pytest.raises(Exception, match="no column"):
        B.sites(spark, path, ("position", "other")).count()
