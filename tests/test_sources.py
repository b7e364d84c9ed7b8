import gzip
import json

import pytest

from locusframe.functions.predicates import KeyRange
from locusframe.sources import bgzf, keyed, sinks, tables, vcf

NESTED = "id string not null, n int, big bigint, f float, d double, b boolean, info struct<name:string,xs:array<int>>, tags array<struct<k:string,v:double>>"
ROWS = [
    ("a", 42, 1234567890123, 3.5, 2.71828, True, ("BRCA1", [1, -2, None]), [("x", 1.0), ("y", None)]),
    ("b", -1, -5, None, None, False, None, []),
    ("c", None, None, 0.0, 1e300, None, (None, None), None),
]


def test_keyed_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.ht")
    df = spark.createDataFrame(ROWS, NESTED)
    keyed.write(df, path, ["id"], partitions=2)
    back = keyed.read(spark, path)
    assert back.schema["n"].dataType == df.schema["n"].dataType
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert tables.open_path(spark, path).count() == 3
    assert keyed.lookup(spark, path, id="b").first().n == -1
    assert keyed.info(spark, path).count() == len(keyed.metadata(spark, path).parts)
    assert keyed.read(spark, path, component="globals").count() == 0


def test_keyed_long_numbers_and_blocks(spark, tmp_path):
    path = str(tmp_path / "u.ht")
    df = spark.range(20000).selectExpr("id as k", "repeat('x', 20) as s", "-id as m")
    keyed.write(df, path, ["k"], partitions=3)
    assert keyed.read(spark, path).selectExpr("sum(k)", "sum(m)", "count(s)").first() == (199990000, -199990000, 20000)
    m = keyed.metadata(spark, path)
    assert len(m.parts) == 3 and len(keyed.prune(m, [KeyRange.of("k", "=", 5)])) == 1
    assert keyed.read(spark, path, [KeyRange.between("k", 100, 199)]).count() == 100
    with pytest.raises(EOFError):
        list(keyed.rows_of(keyed.blocked(b"\1\5"), keyed.physical_type(df.schema, False)))


def by_hand(parts: list[bytes]) -> bytes:
    """Blocks of a part file, made apart from our writer."""
    import struct

    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    out = b""
    for data in parts:
        packed = z.compress(data)
        out += struct.pack("<I", len(packed) + 4) + struct.pack("<i", len(data)) + packed
    return out


#: Rows {k: +EInt32, s: EBinary}: (5, "ab"), an absent row, (300, null), (-1, "é"), cut over blocks within a row.
PLAIN = b"\1\0\5\2ab" + b"\0" + b"\1\1\xac\x02" + b"\1\0\xff\xff\xff\xff\x0f\2\xc3\xa9" + b"\0"
KIND = "+EBaseStruct{k:+EInt32,s:EBinary}"


def test_rows_made_by_hand():
    p = keyed.parse_type(KIND)
    want = [{"k": 5, "s": "ab"}, {"k": 300, "s": None}, {"k": -1, "s": "é"}]
    for cuts in ([PLAIN], [PLAIN[:3], PLAIN[3:9], PLAIN[9:]], [PLAIN[k : k + 1] for k in range(len(PLAIN))]):
        assert list(keyed.rows_of(by_hand(cuts), p)) == want
    fixed = b"\1\0\5\0\0\0\2\0\0\0ab" + b"\0\0" + b"\1\1\x2c\1\0\0"
    assert list(keyed.rows_of(by_hand([fixed[:7], fixed[7:]]), p, fixed=True)) == want[:2]
    with pytest.raises(EOFError):
        list(keyed.rows_of(by_hand([PLAIN[:4]]), p))
    with pytest.raises(ValueError):
        list(keyed.rows_of(by_hand([PLAIN]), p, limits=keyed.Limits(binary=1)))
    with pytest.raises(ValueError):
        keyed.encoder(p, keyed.Limits(binary=1))(bytearray(), {"k": 1, "s": "ab"})
    blocks = keyed.Blocks(by_hand([PLAIN[:3], PLAIN[3:9], PLAIN[9:]]))
    assert [blocks.holding(x) for x in (0, 2, 3, 8, 9)] == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        keyed.fixed_numbers({"name": "LZ4BlockBufferSpec"})


def test_lookup_by_index(spark, tmp_path):
    """A table and a tree of two levels made by hand; a lookup goes down the tree to the row's place."""
    leb = keyed.BUFFERS
    number = lambda x: bytes([x])  # noqa: E731  below 128
    leaf = "+EBaseStruct{first_idx:+EInt64,keys:+EArray[+EBaseStruct{key:+EBaseStruct{k:+EInt32},offset:+EInt64,annotation:+EBaseStruct{}}]}"
    inner = "+EBaseStruct{children:+EArray[+EBaseStruct{index_file_offset:+EInt64,first_idx:+EInt64,first_key:+EBaseStruct{k:+EInt32},first_record_offset:+EInt64,first_annotation:+EBaseStruct{}}]}"
    keys = [3, 5, 8, 9, 20]
    rows, places = b"", []
    for k in keys:
        places.append(len(rows))
        rows += b"\1\0" + number(k) + b"\2k" + str(k)[:1].encode()
    entry = lambda k, at: number(k) + number(at)
    one = b"\0" + number(0) + number(2) + entry(3, places[0]) + entry(5, places[1])
    two = b"\0" + number(2) + number(3) + b"".join(entry(k, p) for k, p in zip(keys[2:], places[2:]))
    first = by_hand([one + two])
    # The leaves stand in the first block, the second of them by its place in it; the root is a block of its own.
    put = bytearray()
    keyed.put_number(put, len(one), 64)
    root = b"\1" + number(2) + number(0) + number(0) + number(3) + number(0) + bytes(put) + number(2) + number(8) + number(places[2])
    table = tmp_path / "i.ht"
    for name in ("rows/parts", "index/part-a.idx"):
        (table / name).mkdir(parents=True)
    (table / "rows/parts/part-a").write_bytes(by_hand([rows[:7], rows[7:20], rows[20:] + b"\0"]))
    (table / "index/part-a.idx/index").write_bytes(first + by_hand([root]))
    meta = {"fileVersion": 1, "branchingFactor": 2, "height": 2, "keyType": "", "annotationType": "", "nKeys": 5, "indexPath": "index", "rootOffset": len(first), "attributes": {}}
    (table / "index/part-a.idx/metadata.json.gz").write_bytes(gzip.compress(json.dumps(meta).encode()))
    codec = lambda kind: {"name": "TypedCodecSpec", "_eType": kind, "_vType": "", "_bufferSpec": leb}
    spec = {"name": "OrderedRVDSpec2", "_key": ["k"], "_codecSpec": codec(KIND), "_indexSpec": {"_relPath": "../index", "_leafCodec": codec(leaf), "_internalNodeCodec": codec(inner)}, "_partFiles": ["part-a"], "_jRangeBounds": [{"start": {"k": 3}, "end": {"k": 20}, "includeStart": True, "includeEnd": True}], "_attrs": {}}
    (table / "rows/metadata.json.gz").write_bytes(gzip.compress(json.dumps(spec).encode()))
    assert [r.k for r in keyed.read(spark, str(table), ordered=True).collect()] == keys
    for k in keys:
        assert keyed.lookup(spark, str(table), k=k).collect() == [(k, "k" + str(k)[:1])]
    for k in (2, 4, 10, 21):
        assert keyed.lookup(spark, str(table), k=k).collect() == []
    assert keyed.info(spark, str(table)).first().indexed


def test_keyed_write_replaces_and_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "w.ht")
    keyed.write(spark.range(50).selectExpr("id as k"), f"file://{path}", ["k"], partitions=4)
    keyed.write(spark.range(7).selectExpr("id as k", "'a\\nb' as s"), path, ["k"], partitions=2)
    assert sorted(r.k for r in keyed.read(spark, f"file://{path}").collect()) == list(range(7))
    left = sorted(p.name for p in (tmp_path / "w.ht").iterdir() if not p.name.endswith(".crc"))
    assert left == ["_SUCCESS", "globals", "index", "rows"]


def test_type_text():
    text = "+EBaseStruct{a:+EInt32,`odd name`:EArray[+EBinary],s:EBaseStruct{x:EFloat64}}"
    assert keyed.type_text(keyed.parse_type(text)) == text
    for bad in ("EWhat", "EArray[EInt32", "EInt32 EInt32"):
        with pytest.raises(ValueError):
            keyed.parse_type(bad)


def test_pruning_is_sound():
    bound = {"start": {"contig": "chr1", "pos": 1000000}, "end": {"contig": "chr2", "pos": 5000}}
    key = ("contig", "pos")
    # The second field counts only where the first is the same at both ends.
    assert keyed.may_hold(bound, key, [KeyRange.of("pos", ">=", 50000000)])
    assert not keyed.may_hold(bound, key, [KeyRange.of("contig", "=", "chr3")])
    same = {"start": {"contig": "chr1", "pos": 10}, "end": {"contig": "chr1", "pos": 20}}
    assert not keyed.may_hold(same, key, [KeyRange.of("pos", ">", 20)])
    assert keyed.may_hold(same, key, [KeyRange.of("pos", ">=", 20)])


VCF = """##fileformat=VCFv4.3
##contig=<ID=chr1,length=1000>
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency, of each">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Call">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
chr1\t10\trs1;x\tA\tG,T\t30.5\tPASS\tDP=7;AF=0.5,0.25;DB\tGT:AD\t0/1:3,4,5\t.|.
chr1\t20\t.\tC\t.\t.\tq10;s50\t.\tGT\t1\t.
chr2\t5\t.\tC\tA\t.\t.\tDP=.\tAD:GT\t1,2:0|1\t.:1
"""


@pytest.mark.parametrize("packed", [False, True])
def test_vcf(spark, tmp_path, packed):
    path = tmp_path / ("a.vcf.gz" if packed else "a.vcf")
    path.write_bytes(bgzf.pack(VCF.encode()) + bgzf.pack(b"") if packed else VCF.encode())
    if packed:
        assert gzip.decompress(path.read_bytes()) == VCF.encode()
    rows = tables.open_path(spark, str(path)).orderBy("locus").collect()
    one, two, three = rows
    assert one.alleles == ["A", "G", "T"] and one.rsid == "rs1;x" and one.qual == 30.5 and one.filters == []
    assert (one.info.DP, one.info.AF, one.info.DB) == (7, [0.5, 0.25], True)
    assert one.genotypes[0] == ("S1", "0/1", [3, 4, 5]) and one.genotypes[1].AD is None
    assert two.alleles == ["C"] and two.filters == ["q10", "s50"] and two.info.DB is False and two.info.DP is None
    assert three.filters is None and three.genotypes[0].AD == [1, 2] and three.genotypes[1].GT == "1"


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    df = vcf.read(spark, str(tmp_path / "a.vcf")).drop("genotypes")
    vcf.write(df, str(tmp_path / "out"))
    back = vcf.read(spark, str(tmp_path / "out"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_vcf_with_genotypes_and_regions(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    df = vcf.read(spark, str(tmp_path / "a.vcf"))
    vcf.write(df, str(tmp_path / "out"), compression="gzip")
    back = vcf.read(spark, str(tmp_path / "out"))
    assert back.schema == df.schema
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    places = lambda **how: [tuple(r.locus) for r in vcf.read(spark, str(tmp_path / "a.vcf"), **how).collect()]
    assert places(intervals=[("chr1", 15, 30), ("chr2", 1, 5)]) == [("chr1", 20), ("chr2", 5)] and places(intervals=[]) == []
    assert sorted(places(by_contig=True)) == [("chr1", 10), ("chr1", 20), ("chr2", 5)]
    many = df.selectExpr("locus", "transform(sequence(1, 12000), x -> concat('A', x)) as alleles").limit(1)
    line = many.select(vcf.record(many.schema).alias("x")).first().x
    assert line.split("\t")[4].count(",") == 11_998 and line.split("\t")[4].endswith("A12000")
    assert len(vcf.head_of(spark.createDataFrame([(f"##x={i}",) for i in range(600)] + [("#CHROM",), ("chr1\t5",)], "value string").coalesce(1))) == 601


def test_warehouse_shows_the_last_load(spark, tmp_path):
    rows = lambda p: spark.createDataFrame([("h", "eur", "1_5_9", p), ("h", "eur", "1_20_30", 0.5)], "phenotype string, ancestry string, locus_id string, lead_pvalue double")
    for p in (0.1, 0.2):
        sinks.warehouse({"loci": rows(p)}, str(tmp_path / "w"))
    out = sinks.read_warehouse(spark, str(tmp_path / "w"), "loci")
    assert sorted((r.locus_id, r.lead_pvalue) for r in out.collect()) == [("1_20_30", 0.5), ("1_5_9", 0.2)] and "_loaded_at" not in out.columns


def test_ingest_steps(spark, tmp_path):
    base = tmp_path / "h"
    base.mkdir()
    with pytest.raises(FileNotFoundError):
        sinks.ingest(spark, str(base), str(tmp_path / "w"), "h", "eur")
    (base / "manifest.json").write_text(json.dumps({"loci": [{"locus_id": "1_5_9", "lead_pvalue": 1e-9}], "plots": {"manhattan": "u.png", "qq": "v.png"}}))
    spark.createDataFrame([(5, "A", "C", 1e-9)], "xpos long, ref string, alt string, pvalue double").write.parquet(str(base / "exome_significant.parquet"))
    spark.createDataFrame([("g", "a", 0.1)], "gene_id string, annotation string, max_maf double").write.parquet(str(base / "gene_associations.parquet"))
    spark.createDataFrame([("chr1", 5, "A", "C")] * 3, "contig string, position int, ref string, alt string").write.parquet(str(base / "qq_genome.parquet"))
    for _ in range(2):
        told = [(r.table, r.rows) for r in sinks.ingest(spark, str(base), str(tmp_path / "w"), "h", "eur").collect()]
    assert told == [("loci", 1), ("phenotype_plots", 2), ("significant_variants", 1), ("gene_associations", 1), ("qq_points", 3)]
    assert sinks.read_warehouse(spark, str(tmp_path / "w"), "phenotype_plots").count() == 2
    assert sinks.read_warehouse(spark, str(tmp_path / "w"), "significant_variants").first().sequencing_type == "exome"


def test_column_store(spark, tmp_path):
    """Rows go to an end point in chunks, sent by tasks; a count that differs is an error."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    seen, stuck, tokens = [], [], {}

    class Store(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            if "INSERT" in self.path:
                token = parse_qs(urlparse(self.path).query)["insert_deduplication_token"][0]
                # As the store does: a token that is known adds nothing.
                if tokens.setdefault(token, body) is body:
                    seen.extend(body.splitlines())
            answer = str(stuck[0] if stuck else len(seen)) if body.startswith("SELECT") else ""
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer.encode())

    server = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    df = spark.range(2500).selectExpr("id", "if(id = 7, double('nan'), 0.5) as x").repartition(3)
    assert sinks.clickhouse(df, url, "d.t", ["id"]) == 2500
    assert sorted(json.loads(x)["id"] for x in seen) == list(range(2500)) and '{"id":7,"x":null}' in seen
    # A load that is sent again has the same chunks under the same tokens.
    for _ in range(2):
        assert sinks.insert_chunks(df, url, "d.t", rows=100, load="again") == 2500
    assert len(seen) == 5000 and len([t for t in tokens if t.startswith("again-")]) >= 25
    stuck.append(len(seen))
    with pytest.raises(OSError):
        sinks.clickhouse(df, url, "d.t", ["id"])
    server.shutdown()
    job = sinks.bigquery(df, str(tmp_path / "b"), "p.d.t")
    assert spark.read.parquet(str(tmp_path / "b" / "rows")).count() == 2500 and json.loads((tmp_path / "b" / "job.json").read_text()) == job


def test_ndjson(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")]), (2, 0.5, None)], "k int, x double, xs array<double>")
    sinks.ndjson(df, str(tmp_path / "j"))
    lines = sorted(json.dumps(json.loads(x)) for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines())
    assert lines == ['{"k": 1, "x": null, "xs": [1.0, null]}', '{"k": 2, "x": 0.5, "xs": null}']
    sinks.ndjson(df, str(tmp_path / "g"), group_by=["k"])
    assert (tmp_path / "g" / "k=1").is_dir()


def test_parquet_and_warehouse(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "'p' as phenotype")
    sinks.parquet(df, str(tmp_path / "one"), 1)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    with pytest.raises(ValueError):
        sinks.warehouse({"loci": df}, str(tmp_path / "w"))
    whole = df.selectExpr("*", "'eur' as ancestry", "cast(id as string) as locus_id")
    for _ in range(2):
        sinks.warehouse({"loci": whole}, str(tmp_path / "w"))
    assert sinks.read_warehouse(spark, str(tmp_path / "w"), "loci").count() == 100
    # Both loads lie there until the table is tidied up.
    tree = tables.parquet_tree(spark, str(tmp_path / "w"), "*.parquet")
    assert tree.count() == 200 and "file_path" in tree.columns


def test_assets(spark, tmp_path):
    one = [{"ancestry_group": "eur", "analysis_id": "h", "uri": "u", "asset_type": "variant", "sequencing_type": None}]
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps({"assets": one}))
    assert tables.assets(spark, str(tmp_path / "a.json")).collect() == tables.assets(spark, str(tmp_path / "b.json")).collect()


def test_cli(spark, tmp_path, capsys):
    from locusframe import cli

    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "chr1", 5), (2, "chr1", 50)], "id int, contig string, position int").write.parquet(path)
    cli.main(["query", path, "--where", "id >= 1", "--interval", "chr1:1-10"], spark)
    assert json.loads(capsys.readouterr().out) == {"id": 1, "contig": "chr1", "position": 5}


def test_cli_commands(spark, tmp_path, capsys):
    from locusframe import cli

    def run(*args):
        cli.main([str(x) for x in args], spark)
        return capsys.readouterr().out

    path = tmp_path / "t.parquet"
    spark.range(3000).selectExpr("id", "concat('chr', id % 3) as contig", "int(id) as position").write.parquet(str(path))
    lines = run("summary", path).splitlines()
    assert json.loads(lines[0])["rows"] == 3000 and "contig: string" in lines[2] and json.loads(lines[-1])["count"] == 3000
    (tmp_path / "s.json").write_text(json.dumps({"type": "object", "properties": {"position": {"type": "integer", "minimum": 1000}}}))
    assert json.loads(run("validate", path, "--schema", tmp_path / "s.json")) == {"scanned": 3000, "valid": 2000, "invalid": 1000}
    some = [run("validate", path, "--schema", tmp_path / "s.json", "--sample", 100, "--key", "id", "--seed", 5, "--errors", 2).splitlines() for _ in range(2)]
    assert some[0] == some[1] and len(some[0]) == 3 and json.loads(some[0][-1])["scanned"] == 100
    with pytest.raises(ValueError):
        run("validate", path, "--schema", tmp_path / "s.json", "--fail-fast")
    assets = [{"ancestry_group": "eur", "analysis_id": f"a{i}", "uri": "u", "asset_type": "variant", "sequencing_type": "exome"} for i in range(1500)]
    (tmp_path / "a.json").write_text(json.dumps(assets))
    assert len(run("batch", tmp_path / "a.json").splitlines()) == 1500


def test_cli_opens_only_parts_that_can_hold_a_row(spark, tmp_path, capsys, monkeypatch):
    from locusframe import cli

    path = str(tmp_path / "p.ht")
    rows = spark.range(900).selectExpr("struct(concat('chr', 1 + id div 300) as contig, int(id % 300) as position) as locus", "id as n")
    keyed.write(rows, path, ["locus"], partitions=6)
    opened, prune = [], keyed.prune
    monkeypatch.setattr(keyed, "prune", lambda *a: opened.append(prune(*a)) or opened[-1])
    cli.main(["query", path, "--interval", "chr2:10-20", "--where", "n >= 312"], spark)
    assert [json.loads(x)["n"] for x in capsys.readouterr().out.splitlines()] == list(range(312, 321)) and len(opened[-1]) <= 2
    cli.main(["query", path, "--where", "locus.contig = chr3", "--where", "n < 603"], spark)
    assert sorted(json.loads(x)["n"] for x in capsys.readouterr().out.splitlines()) == [600, 601, 602] and len(opened[-1]) <= 3


def test_stream(spark, tmp_path):
    from locusframe.streaming import liveness

    src = str(tmp_path / "s")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id % 3 as worker_id, double(id) as value from range(120)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, worker_id long, value double").parquet(src)
    q = liveness.window_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("rates").collect()
    assert sum(r.n for r in rows) == 120 and len({r.worker_id for r in rows}) == 3


def test_cli_manhattan(spark, tmp_path):
    from locusframe import cli

    rows = [("chr1", 10 * i, "A", "C", 1e-9 if i % 9 == 0 else 0.005, 0.1, 0.1, 0.2, "exome") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "contig string, position int, ref string, alt string, pvalue double, beta double, se double, af double, sequencing_type string")
    df.write.parquet(str(tmp_path / "v"))
    cli.main(["manhattan", str(tmp_path / "v"), "--phenotype", "height", "--ancestry", "eur", "--output", str(tmp_path / "w"), "--window", "30"], spark)
    assert spark.read.parquet(str(tmp_path / "w" / "significant_variants")).count() == 6
    loci = spark.read.parquet(str(tmp_path / "w" / "loci")).collect()
    assert len(loci) == 6 and all(r.exome_count == 1 for r in loci)
    assert spark.read.parquet(str(tmp_path / "w" / "loci_variants")).count() > 6


def test_text_calls_are_written_by_many_tasks(spark, tmp_path):
    df = spark.range(4000).selectExpr("struct(concat('chr', 1 + id % 22) as contig, cast(1 + id * 7919 % 5000 as int) as position) as locus", "array('A', 'C') as alleles", "struct(cast(id as int) as DP) as info")
    told = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    before = {k: spark.conf.get(k) for k in told}
    try:
        for k, x in told.items():
            spark.conf.set(k, x)
        for compression, suffix in (("none", ".txt"), ("gzip", ".txt.gz")):
            path = tmp_path / compression
            vcf.write(df, str(path), compression)
            parts = sorted(path.glob(f"part-*{suffix}"))
            assert len(parts) == 5
            import gzip

            texts = [(gzip.open(p, "rt") if suffix.endswith("gz") else open(p)).read().splitlines() for p in parts]
            # Every file is whole by itself, and one behind the other they are in order.
            heads = [[x for x in t if x.startswith("#")] for t in texts]
            assert all(h == heads[0] and t[: len(h)] == h for h, t in zip(heads, texts)) and len(heads[0]) > 22
            places = [(x.split("\t")[0], int(x.split("\t")[1])) for t in texts for x in t if not x.startswith("#")]
            assert places == sorted(places) and len(places) == 4000
            back = vcf.read(spark, str(path))
            assert sorted(tuple(r.locus) + (r.info.DP,) for r in back.collect()) == sorted(tuple(r.locus) + (r.info.DP,) for r in df.collect())
        by = vcf.read(spark, str(tmp_path / "none"), by_contig=True)
        parts = by.selectExpr("locus.contig", "spark_partition_id() as part").distinct().collect()
        # No two contigs share a partition.
        assert len(parts) == 22 == len({r.part for r in parts}) == len({r.contig for r in parts})
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    vcf.write(df.limit(0), str(tmp_path / "none at all"))
    assert vcf.read(spark, str(tmp_path / "none at all")).count() == 0


def test_shards_of_many_rows_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHARD_ROWS", 100)
    sinks.parquet(spark.range(1000), str(tmp_path / "many"), 3)
    assert len(list((tmp_path / "many").glob("*.parquet"))) == 12 and spark.read.parquet(str(tmp_path / "many")).count() == 1000
    sinks.parquet(spark.range(50), str(tmp_path / "few"), 3)
    assert len(list((tmp_path / "few").glob("*.parquet"))) == 3
    sinks.parquet(spark.range(1000), str(tmp_path / "one"), 1)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1


def test_columns_are_encoded_as_rows_are():
    import pyarrow as pa
    from pyspark.sql import types as T

    one = T.StructType([T.StructField("contig", T.StringType()), T.StructField("position", T.IntegerType())])
    kind = T.StructType([T.StructField("locus", one), T.StructField("a", T.LongType()), T.StructField("b", T.LongType(), False), T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("t", T.StringType()), T.StructField("y", T.BooleanType())])
    p = keyed.physical_type(kind, False)
    edge = [0, 1, 127, 128, -1, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63), 300]
    rows = [
        {
            "locus": None if i % 5 == 0 else {"contig": None if i % 7 == 0 else "chr" + "é" * (i % 4), "position": None if i % 3 == 0 else edge[i % 7]},
            "a": None if i % 4 == 0 else edge[i % 10], "b": edge[(i + 1) % 10], "f": None if i % 6 == 0 else i / 3, "d": [None, float("nan"), -0.0, 1e300][i % 4], "t": [None, "", "x" * i][i % 3], "y": [None, True, False][i % 3],
        }
        for i in range(100)
    ]
    from pyspark.sql.pandas.types import to_arrow_schema

    batch = pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(kind))
    for some, told in ((batch, rows), (batch.slice(13, 50), rows[13:63]), (batch.slice(0, 0), [])):
        raw, there = keyed.cells(p, some.to_struct_array())
        put, want = keyed.encoder(p), []
        for row in told:
            data = bytearray()
            put(data, row)
            want.append(bytes(data))
        assert [raw[k][there[k]].tobytes() for k in range(len(told))] == want
    # What the row's encoder must refuse or judge is left to it.
    assert keyed.cells(p, pa.RecordBatch.from_pylist([rows[1] | {"b": None}], schema=pa.schema([f.with_nullable(True) for f in batch.schema])).to_struct_array()) is None
    assert keyed.cells(p, pa.RecordBatch.from_pylist([rows[1] | {"t": "x" * 300}], schema=batch.schema).to_struct_array()) is None
