"""Stores of snapshots and the states of phenotypes."""

from locusframe.operators import telemetry


def test_store_of_snapshots(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = spark.sql("select id as event_id, id % 3 as worker_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) as ts, double(id) as value from range(50)")
    telemetry.insert_snapshots(rows, path)
    telemetry.insert_snapshots(rows.withColumn("event_id", rows.event_id + 50), path)
    assert telemetry.snapshot_count(telemetry.stored(spark, path)).first().n == 100
    assert [r.event_id for r in telemetry.history(telemetry.stored(spark, path), 1).limit(3).collect()] == [1, 51, 4]
    assert telemetry.clear_snapshots(spark, path) == 100
    left = telemetry.stored(spark, path)
    assert left.count() == 0 and left.columns == rows.columns
    telemetry.insert_snapshots(rows, path)
    assert telemetry.snapshot_count(telemetry.stored(spark, path)).first().n == 50


def states(spark, text):
    rows = [tuple(x.split(":")) for x in text.split()]
    return spark.createDataFrame([(i, int(n), s) for i, n, s in rows], "phenotype_id string, partitions int, state string")


def test_activation(spark):
    given = states(spark, "a:3:active b:0:waiting c:5:waiting d:1:waiting e:2:scanned f:4:waiting")
    out = {r.phenotype_id: r.state for r in telemetry.activate(given, most=3).collect()}
    assert out == {"a": "active", "b": "failed", "c": "active", "d": "active", "e": "scanned", "f": "waiting"}
    assert {r.state for r in telemetry.activate(given.where("state = 'waiting'"), most=0).collect()} == {"failed", "waiting"}


def test_aggregation_waits_for_a_batch(spark):
    ids = lambda text, **how: [r.phenotype_id for r in telemetry.aggregate_ready(states(spark, text), **how).collect()]
    assert ids("a:1:scanned b:1:waiting") == []
    assert ids("b:1:scanned a:1:scanned c:1:failed") == ["a", "b"]
    assert ids("a:1:scanned b:1:scanned c:1:active", batch=2) == ["a", "b"]
    assert ids("a:1:done") == []


def test_phenotype_status(spark):
    rows = [(1, "done"), (1, "done"), (2, "done"), (2, "waiting"), (3, "waiting"), (4, "running"), (5, "done"), (5, "failed")]
    out = telemetry.phenotype_status(spark.createDataFrame(rows, "phenotype_id int, status string")).collect()
    assert [(r.phenotype_id, r.state) for r in out] == [(1, "complete"), (2, "active"), (3, "waiting"), (4, "active"), (5, "failed")]
