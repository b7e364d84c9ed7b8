"""Upserts on writing."""

import pytest
from pyspark.sql import functions as F

from locusframe.sources import sinks, warehouse

KEYS = ["phenotype", "ancestry", "locus_id"]
KIND = "phenotype string, ancestry string, locus_id string, p double"


def shown(spark, path):
    return sorted(map(tuple, warehouse.read(spark, path).collect()), key=repr)


def test_upserts_replace_keys_and_keep_the_rest(spark, tmp_path):
    path, rows = str(tmp_path / "t"), {}
    loads = [
        [("a", "eur", "1", 0.1), ("a", "eur", "2", 0.2), ("b", None, "1", 0.3), ("007", "x/y=z", "1", 0.7)],
        [("a", "eur", "2", 0.25), ("a", "eur", "3", None), ("a", "afr", "1", 0.4)],
        [("b", None, "1", 0.35), ("b", None, None, 1.0)],
        [("b", None, None, 2.0), ("007", "x/y=z", "1", 0.8)],
        [],
    ]
    for load in loads:
        warehouse.upsert(spark.createDataFrame(load, KIND), path, KEYS)
        rows |= {x[:3]: x for x in load}
        assert shown(spark, path) == sorted(rows.values(), key=repr)
    assert warehouse.read(spark, path, 1).count() == 4
    plan = warehouse.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Sort" not in plan
    assert warehouse.compact(spark, path) > 0 and warehouse.compact(spark, path) == 0
    assert warehouse.vacuum(spark, path) > 0
    assert shown(spark, path) == sorted(rows.values(), key=repr)
    assert warehouse.read(spark, path).schema["phenotype"].dataType.simpleString() == "string"


def test_duplicates_within_a_load(spark, tmp_path):
    path = str(tmp_path / "t")
    load = [("a", "eur", "1", p) for p in (0.5, 0.9, 0.1)] * 4
    warehouse.upsert(spark.createDataFrame(load, KIND).repartition(7), path, KEYS)
    assert shown(spark, path) == [("a", "eur", "1", 0.9)]


def test_a_load_that_fails_or_comes_second(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "eur", "1", 0.1)], KIND)
    warehouse.upsert(one, path, KEYS)
    with pytest.raises(Exception):
        warehouse.upsert(one.withColumn("p", F.raise_error(F.lit("no")).cast("double")), path, KEYS)
    assert shown(spark, path) == [("a", "eur", "1", 0.1)]
    # Another load takes the next number between this one's look and its end.
    real = warehouse.Table.version
    monkeypatch.setattr(warehouse.Table, "version", lambda self: real(self) - 1 if self.path.endswith("/t") else real(self))
    with pytest.raises(RuntimeError):
        warehouse.upsert(one.withColumn("p", F.lit(5.0)), path, KEYS, "replace")
    monkeypatch.undo()
    assert shown(spark, path) == [("a", "eur", "1", 0.1)]
    warehouse.upsert(one.withColumn("p", F.lit(7.0)), path, KEYS)
    assert shown(spark, path) == [("a", "eur", "1", 7.0)]


def test_modes_and_new_columns(spark, tmp_path):
    w = str(tmp_path / "w")
    one = spark.createDataFrame([("a", "eur", "1", 0.1)], KIND)
    sinks.warehouse({"loci": one}, w, "create")
    with pytest.raises(FileExistsError):
        sinks.warehouse({"loci": one}, w, "create")
    with pytest.raises(ValueError):
        sinks.warehouse({"what": one}, w)
    sinks.warehouse({"loci": one.withColumns({"locus_id": F.lit("2"), "more": F.array(F.lit(1))})}, w)
    out = sinks.read_warehouse(spark, w, "loci")
    assert sorted((r.locus_id, r.more) for r in out.collect()) == [("1", None), ("2", [1])]
    sinks.warehouse({"loci": one}, w, "replace")
    assert sinks.read_warehouse(spark, w, "loci").count() == 1
    with pytest.raises(FileNotFoundError):
        sinks.read_warehouse(spark, w, "qq_points")
