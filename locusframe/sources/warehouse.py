"""Warehouse tables that a load upserts: rows of a key are replaced when they are written, not when they are read.

A table is a folder of loads, each partitioned by phenotype and ancestry, and a
series of manifests, of which the last tells the folders of every live
(phenotype, ancestry).  A load

1. writes its own rows, one for each key (of several the greatest by the text of its other fields);
2. of the live folders of those (phenotype, ancestry) that it touches, writes anew the rows
   whose keys it does not have;
3. writes the next manifest, under a name that must not exist yet.

Nothing that is live is changed in place: a reader sees the table as of one
manifest, a load that fails leaves the last one standing, and of two loads at a
time the second to finish is an error.  Reading lists the live folders and plans
a scan, no window and no shuffle.  :func:`compact` makes one folder of each
(phenotype, ancestry), :func:`vacuum` deletes what no manifest lists.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.sources.keyed import Folder

#: Columns by which a load's folders are cut.
PARTS = ("phenotype", "ancestry")


class Table:
    """The manifests and loads of one table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path.rstrip("/"))

    def version(self) -> int:
        """The number of the last manifest, 0 if there is none."""
        at = self.folder.at("_live")
        if not self.folder.fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in self.folder.fs.listStatus(at)]
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))), default=0)

    def manifest(self, version: int) -> dict:
        stream = self.folder.fs.open(self.folder.at(f"_live/{version:09d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def publish(self, version: int, schema: T.StructType, live: dict[str, list[str]]) -> None:
        data = json.dumps({"schema": json.loads(schema.json()), "live": live}).encode()
        # The name is taken at the end, and only if it is free.
        made, name = self.folder.at(f"_live/.{uuid.uuid4().hex}"), self.folder.at(f"_live/{version:09d}.json")
        self.folder.put(f"_live/{made.getName()}", data)
        if self.folder.fs.exists(name) or not self.folder.fs.rename(made, name):
            self.folder.fs.delete(made, False)
            raise RuntimeError(f"another load of {self.path} came first")

    def read(self, live: dict[str, list[str]], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{d}" for dirs in live.values() for d in dirs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("load", T.StringType())])
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*paths).select(*schema.names)

    def write(self, df: DataFrame) -> dict[str, list[str]]:
        """Rows as a load; its folders by part."""
        load, by = f"load={uuid.uuid4().hex}", [c for c in PARTS if c in df.columns]
        df.write.partitionBy(*by).parquet(f"{self.path}/{load}")
        found = [""]
        for _ in by:
            found = [f"{d}/{f.getPath().getName()}".lstrip("/") for d in found for f in self.folder.fs.listStatus(self.folder.at(f"{load}/{d}")) if f.isDirectory()]
        return {d: [f"{load}/{d}"] for d in found}


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: of several the greatest by the text of its other fields."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    return df.groupBy(*keys).agg(F.max_by(row, F.to_json(row)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(df: DataFrame, path: str, keys: list[str], init: str = "append") -> None:
    """Rows of ``df`` into the table at ``path``; ``create`` wants none there, ``replace`` forgets what is live."""
    table = Table(df.sparkSession, path)
    version = table.version()
    if init == "create" and version:
        raise FileExistsError(path)
    known = table.manifest(version) if version and init == "append" else {"schema": None, "live": {}}
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"rows without their keys {missing}")
    live, new = dict(known["live"]), table.write(once(df, keys))
    schema = df.schema
    if known["schema"]:
        # Columns of before stay, with their kinds; new ones come behind.
        before = T.StructType.fromJson(known["schema"])
        schema = T.StructType([*before.fields, *[f for f in df.schema.fields if f.name not in before.names]])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    touched = {d: live[d] for d in new if d in live}
    if touched:
        old, fresh = table.read(touched, schema).alias("o"), table.read({d: new[d] for d in touched}, schema).select(*keys).alias("f")
        same = reduce(lambda a, b: a & b, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"f.`{k}`")) for k in keys])
        kept = table.write(old.join(fresh, same, "left_anti"))
        for d in touched:
            new[d] = [*new[d], *kept.get(d, [])]
    table.publish(version + 1, schema, live | new)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row for each key, as of the last load, or of a version."""
    table = Table(spark, path)
    number = table.version() if version is None else version
    if not number:
        raise FileNotFoundError(path)
    known = table.manifest(number)
    return table.read(known["live"], T.StructType.fromJson(known["schema"]))


def compact(spark: SparkSession, path: str, partitions: int | None = None) -> int:
    """Parts of several folders become one folder each; how many did."""
    table = Table(spark, path)
    version = table.version()
    known = table.manifest(version)
    schema = T.StructType.fromJson(known["schema"])
    split = {d: dirs for d, dirs in known["live"].items() if len(dirs) > 1}
    if split:
        by = [c for c in PARTS if c in schema.names]
        rows = table.read(split, schema)
        made = table.write(rows.repartition(*([partitions] if partitions else []), *by) if by else rows)
        table.publish(version + 1, schema, {**known["live"], **{d: made.get(d, []) for d in split}})
    return len(split)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete loads that the last manifest does not list, and older manifests; how many loads went.

    Readers of older versions must be done.
    """
    table = Table(spark, path)
    version = table.version()
    live = {d.split("/")[0] for dirs in table.manifest(version)["live"].values() for d in dirs}
    gone = [f.getPath().getName() for f in table.folder.fs.listStatus(table.folder.at("")) if f.getPath().getName().startswith("load=") and f.getPath().getName() not in live]
    for name in gone:
        table.folder.drop(name)
    for k in range(1, version):
        table.folder.drop(f"_live/{k:09d}.json")
    return len(gone)
