import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import genomics as g
from locusframe.operators import render, sampling, schema, stats, telemetry


def test_contigs(spark):
    names = ["1", "chr22", "chrX", "Y", "chrM", "MT", "chrUn_1", "300", "0"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    out = [(r.n, r.x, r.b) for r in df.select(g.contig_number(F.col("c")).alias("n"), g.xpos(F.col("c"), F.lit(7)).alias("x"), g.xpos_ingest(F.col("c"), F.lit(7)).alias("b")).collect()]
    want = [1, 22, 23, 24, 25, 25, 0, 0, 0]
    assert [o[0] for o in out] == want
    assert [o[1] for o in out] == [w * 10**9 + 7 for w in want]
    assert out[4][2] == out[5][2] == 7


def test_neg_log10(spark):
    rows = [(0.0, None), (1e-10, None), (1.0, None), (1.5, None), (float("nan"), None), (1.5, 3.0), (None, None), (0.1, float("inf"))]
    df = spark.createDataFrame(rows, "p double, y double")
    out = [r.v for r in df.select(g.neg_log10_p(F.col("p"), F.col("y")).alias("v")).collect()]
    assert out[0] == 350.0 and abs(out[1] - 10) < 1e-9 and out[2] == 0 and out[3] is None and out[4] is None and out[5] == 3.0 and out[6] is None and abs(out[7] - 1) < 1e-12


def test_plot(spark):
    y = [r.y for r in spark.createDataFrame([(0.0,), (10.0,), (20.0,), (1000.0,)], "v double").select(g.plot_y(F.col("v")).alias("y")).collect()]
    assert y[0] == 800 and abs(y[1] - 320) < 1e-9 and abs(y[2]) < 1e-9 and y[3] == 0
    x = spark.range(1).select(g.plot_x(F.lit("chr1"), F.lit(0)).alias("a"), g.plot_x(F.lit("chrY"), F.lit(5)).alias("b")).first()
    assert x.a == 0 and x.b is None


def test_bytes_text():
    assert [g.bytes_text(n) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.00 KiB", "3.00 MiB", "5.00 GiB"]


def test_field_statistics(spark):
    df = spark.createDataFrame(
        [("a", (1, [1.5, float("nan")])), ("b", None), (None, (2, None)), ("a", (10, [None]))], "s string, t struct<n:int,xs:array<double>>"
    )
    out = {r.path: r for r in stats.field_statistics(df).collect()}
    assert (out["s"]["count"], out["s"].null_count, out["s"]["min"], out["s"]["max"], out["s"].distinct_sample) == (4, 1, "a", "b", ["a", "b"])
    assert (out["t"]["count"], out["t"].null_count) == (1, 1)
    # Texts order as texts: "10" comes before "2".
    assert (out["t.n"]["count"], out["t.n"]["min"], out["t.n"]["max"]) == (3, "1", "2")
    assert (out["t.xs"]["count"], out["t.xs"].null_count, out["t.xs"].distinct_sample) == (4, 2, ["1.500000", "NaN"])


def test_row_sizes(spark):
    df = spark.createDataFrame([("ab", [1, 2])], "s string, xs array<int>")
    out = {r.field: r.avg_bytes for r in stats.row_sizes(df, None).collect()}
    assert out == {"s": 6, "xs": 12, "*": 18}


def test_validation(spark):
    rules = {"type": "object", "required": ["s", "gone"], "properties": {"s": {"type": "string", "minLength": 2, "pattern": "^a"}, "xs": {"type": ["array", "null"], "minItems": 1, "items": {"type": "integer", "maximum": 5}}}}
    df = spark.createDataFrame([("ab", [1]), ("b", [9]), (None, []), ("ac", None)], "s string, xs array<int>")
    out = [r.errors for r in schema.validate(df, rules).collect()]
    assert out[0] == ["row: gone missing"]
    assert out[1] == ["row: gone missing", "s: pattern", "s: minLength", "xs[]: maximum"]
    assert out[2] == ["row: gone missing", "s: type", "xs: minItems"]
    assert out[3] == ["row: gone missing"]


def test_generate_and_types(spark):
    df = spark.createDataFrame([], "a int not null, t struct<s:string,xs:array<double>>")
    made = schema.generate(df.schema)
    assert made["required"] == ["a"] and made["properties"]["t"]["type"] == ["object", "null"]
    assert schema.generate(df.schema, all_required=True)["required"] == ["a", "t"]
    assert "`a` Int32" in schema.clickhouse_ddl("d.t", df.schema, ["a"]) and "Tuple(s Nullable(String), xs Array(Nullable(Float64)))" in schema.clickhouse_ddl("d.t", df.schema, ["a"])
    fields = schema.bigquery_schema(df.schema)
    assert fields[0] == {"name": "a", "type": "INT64", "mode": "REQUIRED"} and fields[1]["fields"][1]["mode"] == "REPEATED"


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = [r.k for r in sampling.sample_rows(df, 20, ["k"]).collect()]
    two = [r.k for r in sampling.sample_rows(df.repartition(7), 20, ["k"]).collect()]
    assert one == two and len(set(one)) == 20
    ids = [r.k for r in sampling.sample_ids(df, "k", 0.01, always=[5, 6]).collect()]
    assert len(ids) == 10 and {5, 6} <= set(ids)
    assert sampling.count_owned(10, 3, 0) == 4 and sampling.count_owned(10, 3, 2) == 3


def test_progress(spark):
    r = spark.range(1).select(telemetry.progress(F.lit(5), F.lit(20), F.lit(10)).alias("p")).first().p
    assert r.percent == 25 and r.eta_seconds == 30


def test_png():
    import zlib

    raw = render.png(np.zeros((2, 3, 3), np.uint8))
    assert raw[:4] == b"\x89PNG" and zlib.decompress(raw[raw.index(b"IDAT") + 4 : -16]) == bytes(2 * 10)
    text = """
    [defaults]
    point_alpha = 0.2
    [variant]
    point_radius = 4.0
    [variant.genome]
    background = "#112233"
    [locus]
    point_alpha = 0.7
    """
    made = render.load_style(text)
    assert render.resolve() == render.LOOK and render.resolve(None, "gene_burden")["point_radius"] == 5.0
    assert [render.resolve(made, k)["point_radius"] for k in ("exome", "genome", "gene_burden", "locus")] == [4.0, 4.0, 5.0, 3.0]
    assert [render.resolve(made, k)["point_alpha"] for k in ("exome", "gene_burden", "locus")] == [0.2, 0.9, 0.7]
    assert render.resolve(made, "genome")["background"] == "#112233" and render.resolve(made)["background"] == "white"
    with pytest.raises(ValueError):
        render.resolve({"locus": {"size": 3}}, "locus")


def test_draw(spark):
    """Circles, diamonds over them, a threshold line, and points at the edge."""
    rows = [(10.2, 10.9, "circle"), (10.7, 10.1, "circle"), (30.0, 10.0, "diamond"), (-3.0, 500.0, "circle")]
    points = spark.createDataFrame(rows, "x_px double, y_px double, shape string")
    look = render.resolve({"defaults": {"point_alpha": 1.0, "threshold_alpha": 1.0}}, "locus")
    raw = render.draw(points, 40, 20, threshold_y=3, look=look)
    data, at = b"", 8
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        data += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    image = np.frombuffer(zlib.decompress(data), np.uint8).reshape(20, 1 + 120)[:, 1:].reshape(20, 40, 3)
    blue, red, line = (0x5E, 0x81, 0xAC), (0xBF, 0x61, 0x6A), (0xB7, 0x1C, 0x1C)
    assert tuple(image[10, 10]) == tuple(image[12, 12]) == blue and tuple(image[13, 13]) == (255, 255, 255)
    assert tuple(image[10, 33]) == red and tuple(image[12, 32]) == (255, 255, 255)
    assert tuple(image[3, 0]) == line and tuple(image[19, 0]) == blue
