"""Samples of few parts, ranks of hot p-values, statistics in one pass, silent workers."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusframe.operators import manhattan, sampling, stats
from locusframe.sources import keyed, tables


def test_a_sample_opens_few_parts(spark, tmp_path):
    df = spark.range(10_000).selectExpr("id as k", "repeat('x', 50) as s")
    folder = str(tmp_path / "p")
    df.repartition(40).write.parquet(folder)
    some = tables.sample_path(spark, folder, 100, seed=5)
    assert some.count() == 100 and some.columns == ["k", "s"]
    assert len(tables.sample_path(spark, folder, 100, seed=5).inputFiles()) == 10
    assert sorted(r.k for r in some.collect()) == sorted(r.k for r in tables.sample_path(spark, folder, 100, seed=5).collect())
    assert {r.k for r in some.collect()} != {r.k for r in tables.sample_path(spark, folder, 100, seed=6).collect()}
    path = str(tmp_path / "t.ht")
    keyed.write(df, path, ["k"], partitions=30)
    some = tables.sample_path(spark, path, 25, seed=1)
    assert some.count() == 25 and some.rdd.getNumPartitions() >= 1
    rows = [r.k for r in some.collect()]
    # Five parts of 30, so the rows stand in at most five runs of the key.
    bounds = [(b["start"]["k"], b["end"]["k"]) for b in keyed.metadata(spark, path).bounds]
    assert len({next(i for i, (a, b) in enumerate(bounds) if a <= k <= b) for k in rows}) <= 5
    assert tables.sample_path(spark, str(next((tmp_path / "p").glob("*.parquet"))), 5) is None


def test_reservoirs_are_uniform(spark):
    """Chi-square over many seeds: every row of a part is as likely as any other."""
    df = spark.range(40).selectExpr("id", "id % 2 as part").repartition(3, "part").cache()
    hits = Counter()
    for seed in range(60):
        hits.update(r.id for r in sampling.reservoirs(df, F.col("part"), 10, 2, seed).collect())
    expected = 60 * 10 / 40
    chi = sum((hits[i] - expected) ** 2 / expected for i in range(40))
    assert sum(hits.values()) == 600 and chi < 80  # 39 degrees of freedom: the 99.99th percentile is 79


@pytest.mark.parametrize("hot", [1 << 20, 50])
def test_ranks_where_most_p_are_equal(spark, monkeypatch, hot):
    monkeypatch.setattr(manhattan, "HOT", hot)
    r = random.Random(4)
    rows = [(f"chr{r.randint(1, 2)}", i, "A", "G", 1.0 if r.random() < 0.9 else r.choice([0.5, 1e-9, r.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "contig string, position int, ref string, alt string, pvalue double").repartition(6)
    out = {(x.contig, x.position): x.pvalue_expected_log10 for x in manhattan.qq_points(df, ["position"]).collect()}
    import math

    for contig in ("chr1", "chr2"):
        own = sorted((p, at) for c, at, _, _, p in rows if c == contig)
        for k, (_, at) in enumerate(own):
            assert abs(out[contig, at] - round(-math.log10((k + 0.5) / len(own)), 6)) < 2e-6


def test_hot_ranks_are_dealt_over_tasks(spark):
    df = spark.range(4000).selectExpr("'a' as g", "1.0D as p", "id as k").repartition(5)
    out = manhattan.ranged_ranks(df, ["g"], ["p", "k"], "rank")
    assert sorted((x.k, x["rank"]) for x in out.collect()) == [(k, k + 1) for k in range(4000)]
    spread = df.repartitionByRange(6, "g", "p", "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 2 and max(x["count"] for x in spread) < 2000


def brute_statistics(rows):
    out = {}
    for path, values in rows.items():
        there = sorted({v for v in values if v is not None}, key=str.encode)
        out[path] = (len(values), sum(v is None for v in values), there[0] if there else None, there[-1] if there else None, there[:10])
    return out


def test_statistics_in_one_pass(spark):
    r = random.Random(8)
    data = [(r.choice([None, "é", "z", "", *(f"w{k}" for k in range(40))]), r.choice([None, [], [None, "b"], ["c"] * 3]), r.choice([None, (r.randint(0, 99),)])) for _ in range(500)]
    df = spark.createDataFrame(data, "a string, xs array<string>, s struct<n:int>").repartition(7)
    want = brute_statistics({
        "a": [x[0] for x in data],
        "xs": [v for x in data for v in ([None] if x[1] is None else x[1])],
        "s": [None for x in data if x[2] is None],
        "s.n": [str(x[2][0]) for x in data if x[2] is not None],
    })
    out = stats.field_statistics(df)
    assert {x.path: (x["count"], x.null_count, x["min"], x["max"], x.distinct_sample) for x in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    assert stats.field_statistics(df.limit(0)).count() == 0


def test_a_worker_that_stops_is_reported(spark, tmp_path):
    """Without any further event of its own, or of others."""
    from locusframe.streaming import liveness

    key, value = liveness.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("".join(f'{{"worker_id": "{w}", "ts": "2024-01-01 00:00:0{k}"}}\n' for w in "ab" for k in range(3)))
    stream = spark.readStream.schema("worker_id string, ts timestamp").json(str(folder))
    query = liveness.watched(stream, 2).writeStream.format("memory").queryName("watch").outputMode("append").start()
    try:
        told = lambda: [(r.worker_id, r.status) for r in spark.sql("select * from watch").collect()]
        stop = time.time() + 90
        while Counter(told()) != Counter([("a", "alive"), ("b", "alive"), ("a", "dead"), ("b", "dead")]) and time.time() < stop:
            time.sleep(0.5)
        assert sorted(told()) == [("a", "alive"), ("a", "dead"), ("b", "alive"), ("b", "dead")]
        (folder / "b.json").write_text('{"worker_id": "b", "ts": "2024-01-01 00:05:00"}\n')
        while len(told()) < 6 and time.time() < stop:
            time.sleep(0.5)
        assert told()[4:] == [("b", "alive"), ("b", "dead")]
    finally:
        query.stop()
        spark.conf.set(key, before)
