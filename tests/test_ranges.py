"""Reading by place: keyed tables and block-gzipped calls, what is read counted, and writing in parallel."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from locusframe import cli
from locusframe.functions.predicates import KeyRange
from locusframe.sources import bgzf, files, keyed, keyed_source, vcf


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Two contigs, four parts of several blocks each, sorted by genome place."""
    path = str(tmp_path_factory.mktemp("k") / "t.ht")
    df = spark.range(60_000).select(
        F.struct(F.concat(F.lit("chr"), (F.col("id") % 2 + 1).cast("string")).alias("contig"), (F.col("id") / 2).cast("int").alias("position")).alias("locus"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    keyed.write(df, path, ["locus"], partitions=4)
    return path, df


class Counted:
    """Counts the bytes that are taken from files."""

    def __init__(self, monkeypatch):
        self.n = 0
        real = files.opened

        class File:
            def __init__(self, path):
                self.f = real(path)

            def read(inner, n=-1):  # noqa: N805
                out = inner.f.read(n)
                self.n += len(out)
                return out

            def seek(self, *a):
                return self.f.seek(*a)

            def __enter__(self):
                return self

            def __exit__(self, *a):
                self.f.close()

        monkeypatch.setattr(files, "opened", File)


def reader(spark, path, ranges=(), intervals=None, full=None):
    """The reader and its partitions, as a task has them."""
    taken = {}

    class Read:
        def format(self, name):
            return self

        def option(self, name, value):
            taken[name] = value
            return self

        def load(self):
            return None

    class Session:
        dataSource, conf = spark.dataSource, spark.conf
        read = Read()

    m = keyed.metadata(spark, path)
    keyed_source.load(Session(), m, "rows", keyed.prune(m, list(ranges), intervals), list(ranges), intervals, keyed.LIMITS, full)
    return keyed_source.PushedReader(keyed.spark_type(m.row_type), taken)


def test_spans_read_only_their_blocks(spark, table, monkeypatch):
    path, df = table
    m = keyed.metadata(spark, path)
    assert m.index and len(m.parts) == 4
    whole = sum(files.size(f"{path}/rows/parts/{p}") for p in m.parts)
    assert sorted(map(tuple, keyed.read(spark, path).collect())) == sorted(map(tuple, df.collect()))
    near = [("chr1", 20_000, 20_100), ("chr2", 7, 9), ("chr1", 20_050, 20_300), ("chr9", 1, 5)]
    counted = Counted(monkeypatch)
    r = reader(spark, path, intervals=near)
    got = sorted((x["locus"]["contig"], x["locus"]["position"]) for p in r.partitions() for x in r.found(p))
    assert got == [("chr1", k) for k in range(20_000, 20_301)] + [("chr2", k) for k in range(7, 10)]
    # Heads of the blocks passed over, a few blocks, and the index's.
    assert counted.n < whole / 3
    monkeypatch.undo()
    rows = keyed.read(spark, path, intervals=near)
    assert rows.count() == 304


def test_a_lookup_reads_the_index_and_one_block(spark, table, monkeypatch):
    path, _ = table
    key = {"locus": {"contig": "chr2", "position": 123}}
    counted = Counted(monkeypatch)
    r = reader(spark, path, [KeyRange.of("locus.contig", "=", "chr2"), KeyRange.of("locus.position", "=", 123)], full=key)
    found = [x for p in r.partitions() for x in r.found(p)]
    assert [x["locus"]["position"] for x in found] == [123]
    m = keyed.metadata(spark, path)
    part = max(files.size(f"{path}/rows/parts/{p}") for p in m.parts)
    index = max(files.size(f"{path}/index/{p}.idx/index") for p in m.parts)
    assert counted.n < index + 70_000 + 8 * (part // 30_000 + 10) and counted.n < part + index
    monkeypatch.undo()
    assert [x.locus.position for x in keyed.lookup(spark, path, locus__contig="chr2", locus__position=123).collect()] == [123]
    assert keyed.lookup(spark, path, locus__contig="chr2", locus__position=10**8).count() == 0


def test_filters_of_a_plan_prune_parts(spark, tmp_path):
    path = str(tmp_path / "p.ht")
    keyed.write(spark.range(1000).selectExpr("id as k", "id * 2 as v"), path, ["k"], partitions=5)
    df = keyed.read(spark, path)
    assert df.where("k = 7").collect() == [(7, 14)] and df.where("k > 990 and v < 1990").count() == 4
    # Where the session does not hand filters down, all the same.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert keyed.read(spark, path).where("k = 7").collect() == [(7, 14)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = reader(spark, path)
    assert len(r.partitions()) == 5
    from pyspark.sql.datasource import EqualTo

    assert list(r.pushFilters([EqualTo(("k",), 7)])) == [EqualTo(("k",), 7)] and len(r.partitions()) == 1


def test_an_index_of_several_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_source, "BRANCHES", 3)
    path = str(tmp_path / "l")
    row = keyed.parse_type("+EBaseStruct{k:+EInt32,s:EBinary}")
    tree = keyed_source.Tree(f"{path}/index", row, ["k"])
    for k in range(0, 200, 2):
        tree.add({"k": k, "s": "x"}, 10 * k)
    about = tree.close()
    assert about["height"] == 5 and about["nKeys"] == 100
    spec = keyed.IndexSpec("", *keyed_source.index_types(row, ["k"]), False)
    for k in range(-1, 201):
        with files.opened(f"{path}/index") as f:
            b = keyed.Blocks(f)
            assert keyed.find_row(b, spec, about["rootOffset"], about["height"], {"k": k}) == (10 * k if k % 2 == 0 and 0 <= k < 200 else None)
            place = keyed_source.entry_place(b, spec, about["rootOffset"], about["height"], "k", k)
            assert place <= 10 * (k + k % 2) and place >= 10 * (k - 4) or place == 0


def test_a_long_part_streams(tmp_path):
    """Rows of a part leave the reader before the part is read, and what is held stays small."""
    import tracemalloc

    row = keyed.parse_type("+EBaseStruct{k:+EInt64,s:+EBinary}")
    put, out = keyed.encoder(row), keyed_source.BlockFile(str(tmp_path / "part"))
    r = random.Random(1)
    for k in range(60_000):
        data = bytearray(b"\1")
        put(data, {"k": k, "s": r.randbytes(250).hex()})
        out.put(data)
    out.put(b"\0")
    out.close()
    size = files.size(str(tmp_path / "part"))
    assert size > 14_000_000
    tracemalloc.start()
    with files.opened(str(tmp_path / "part")) as f:
        n = sum(1 for _ in keyed.rows_of(keyed.Blocks(f), row))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < size / 10


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "w.ht")
    keyed.write(spark.range(50).selectExpr("id as k"), path, ["k"], partitions=2)
    with pytest.raises(Exception):
        keyed.write(spark.range(50).selectExpr("id as k", "repeat('x', 20) as s"), path, ["k"], partitions=2, limits=keyed.Limits(binary=3))
    assert keyed.read(spark, path).count() == 50
    assert not [p.name for p in (tmp_path / "w.ht").iterdir() if p.name.startswith(".making")]
    keyed.write(spark.range(0).selectExpr("id as k"), path, ["k"])
    assert keyed.read(spark, path).count() == 0


def calls(spark, n=4000):
    return spark.range(n).select(
        F.struct(F.concat(F.lit("chr"), (F.col("id") % 3 + 1).cast("string")).alias("contig"), (F.col("id") * 37 + 1).cast("int").alias("position")).alias("locus"),
        F.array(F.when(F.col("id") % 50 == 0, F.repeat(F.lit("A"), 20_000)).otherwise("C"), F.lit("G")).alias("alleles"),
        F.sha2(F.col("id").cast("string"), 512).alias("rsid"),
        F.lit(None).cast("double").alias("qual"),
        F.array().cast("array<string>").alias("filters"),
        F.struct(F.col("id").cast("int").alias("DP")).alias("info"),
    )


@pytest.fixture(scope="module")
def called(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("c") / "a.vcf.bgz")
    df = calls(spark)
    vcf.write(df, path, "bgzf")
    return path, sorted(map(repr, df.collect()))


def test_parallel_blocks_are_one_file(spark, called, tmp_path):
    path, want = called
    with open(path, "rb") as f:
        raw = f.read()
    text = gzip.decompress(raw).decode().splitlines()
    assert text[0] == "##fileformat=VCFv4.3" and sum(not x.startswith("#") for x in text) == 4000
    assert raw.endswith(bgzf.pack(b"")) and raw.count(bgzf.pack(b"")) == 1
    assert sorted(map(repr, vcf.read(spark, path).collect())) == want
    parts = str(tmp_path / "parts")
    vcf.write(calls(spark), parts, "bgzf", joined=False)
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*"))) == raw


def test_ranges_cut_anywhere(spark, called):
    path, want = called
    lines = gzip.decompress(files.whole(path)).decode().splitlines()
    size = files.size(path)
    for cut in (1, 100, 9_999, 65_536, size - 1, size, size + 5):
        if size / cut > 400:
            continue
        r = bgzf.LinesReader({"path": path, "range": str(cut)})
        assert [x.decode() for p in r.partitions() for x in r.found(p)] == lines
    r = bgzf.LinesReader({"path": path, "range": str(size // 300)})
    assert [x.decode() for p in r.partitions() for x in r.found(p)] == lines
    df = bgzf.read_lines(spark, path, range_bytes=50_000)
    assert df.rdd.getNumPartitions() > 3 and sorted(x.value for x in df.collect()) == sorted(lines)


def test_regions_open_only_their_blocks(spark, called, monkeypatch):
    path, _ = called
    rows = vcf.read(spark, path).select("locus.contig", "locus.position").collect()
    opened = []
    real = bgzf.inflate
    monkeypatch.setattr(bgzf, "inflate", lambda raw: opened.append(1) or real(raw))
    every = sum(1 for _ in bgzf.blocks(files.opened(path), 0))
    index = bgzf.read_index(files.whole(f"{path}.tbi"))
    assert sorted(index) == ["chr1", "chr2", "chr3"]
    r = random.Random(3)
    for given in [[("chr1", 1, 500)], [("chr2", 70_000, 71_000), ("chr3", 5, 90)], [("chr9", 1, 10)], [("chr3", 147_900, 10**9)], [("chr1", 5, 4)]] + [[(f"chr{r.randint(1, 3)}", a, a + r.randint(0, 3000))] for a in r.sample(range(150_000), 10)]:
        opened.clear()
        chunks = bgzf.chunks_over(index, given)
        reader = bgzf.LinesReader({"path": path, "chunks": json.dumps(chunks)})
        found = [x.decode().split("\t", 2)[:2] for p in reader.partitions() for x in reader.found(p)]
        got = sorted((c, int(x)) for c, x in found if any(c == k and a <= int(x) <= b for k, a, b in given))
        assert got == sorted(tuple(x) for x in rows if any(x[0] == k and a <= x[1] <= b for k, a, b in given))
        assert len(opened) < every / 2
    monkeypatch.undo()
    near = [("chr1", 1, 5000), ("chr3", 100_000, 110_000)]
    got = vcf.read(spark, path, near).select("locus.contig", "locus.position").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(x) for x in rows if any(x[0] == k and a <= x[1] <= b for k, a, b in near))


def test_an_index_made_by_hand():
    """Bins of known places, and an index of one contig spelled out."""
    assert [bgzf.bin_of(0, 1), bgzf.bin_of(16384, 16385), bgzf.bin_of(16383, 16385), bgzf.bin_of(0, 1 << 29), bgzf.bin_of(1 << 26, (1 << 26) + 1)] == [4681, 4682, 585, 0, 4681 + 4096]
    assert sorted(bgzf.bins_over(16383, 16385)) == [0, 1, 9, 73, 585, 4681, 4682]
    import struct

    raw = b"TBI\1" + struct.pack("<8i", 1, 2, 1, 2, 0, 35, 0, 5) + b"chr7\0" + struct.pack("<i", 2)
    raw += struct.pack("<IiQQ", 4681, 1, 5 << 16, 9 << 16 | 3) + struct.pack("<IiQQQQ", 37450, 2, 1, 2, 3, 4) + struct.pack("<iQ", 1, 5 << 16)
    index = bgzf.read_index(gzip.compress(raw))
    assert index == {"chr7": bgzf.Region({4681: [(5 << 16, 9 << 16 | 3)]}, {0: 5 << 16})}
    assert bgzf.read_index(bgzf.write_index(index)) == index
    assert bgzf.chunks_over(index, [("chr7", 100, 200)]) == [(5 << 16, 9 << 16 | 3)] and bgzf.chunks_over(index, [("chr7", 20_000, 20_001)]) == []


def test_export_by_the_command_line(spark, called, tmp_path, capsys):
    path, want = called
    out = str(tmp_path / "b.vcf.gz")
    cli.main(["export", path, "--interval", "chr2:1-60000", "--to", "vcf", "--compression", "bgzf", "--output", out], spark)
    got = vcf.read(spark, out)
    rows = vcf.read(spark, path).where("locus.contig = 'chr2' and locus.position <= 60000")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect())) and got.count() > 400
    assert files.size(out + ".tbi") and bgzf.is_blocked(out)


def test_limits_by_the_command_line(spark, tmp_path, capsys):
    path, out = str(tmp_path / "p.parquet"), str(tmp_path / "b.ht")
    spark.range(3).selectExpr("id as k", "repeat('x', 1200000) as s", "sequence(1, 100001) as xs").write.parquet(path)
    with pytest.raises(Exception):
        cli.main(["export", path, "--to", "ht", "--key", "k", "--output", out], spark)
    more = ["--max-text", "2000000", "--max-array", "200000"]
    cli.main(["export", path, "--to", "ht", "--key", "k", "--output", out, *more], spark)
    with pytest.raises(Exception):
        keyed.read(spark, out).count()
    cli.main(["query", out, "--where", "k = 1", *more], spark)
    assert len(json.loads(capsys.readouterr().out)["s"]) == 1_200_000
