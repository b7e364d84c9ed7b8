"""Writers: Parquet, line-delimited JSON, warehouse tables, small JSON documents."""

from __future__ import annotations

import json
import math
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = {"create": "errorifexists", "replace": "overwrite", "append": "append"}

# Fixed values (K13): keys of the warehouse's tables.
WAREHOUSE_KEYS = {
    "loci": ["phenotype", "ancestry", "locus_id"],
    "loci_variants": ["phenotype", "ancestry", "locus_id", "xpos", "ref", "alt"],
    "significant_variants": ["phenotype", "ancestry", "sequencing_type", "xpos", "ref", "alt"],
    "phenotype_plots": ["phenotype", "ancestry", "plot_type"],
    "gene_associations": ["phenotype", "ancestry", "gene_id", "annotation", "max_maf"],
    "qq_points": ["phenotype", "ancestry", "sequencing_type", "contig", "position", "ref", "alt"],
}


SEQUENCING = ("exome", "genome")
#: Rows that one task writes as a file of a shard.
SHARD_ROWS = 4_000_000


def files_of(rows: int, shards: int) -> int:
    """So many files for each shard that none holds over ``SHARD_ROWS`` rows; one shard is one file."""
    return shards * max(1, -(-rows // (shards * SHARD_ROWS))) if shards > 1 else 1


def parquet(df: DataFrame, path: str, shards: int | None = None, init: str = "create", row_group: int = 100_000) -> None:
    """K1 (one shard), K2, K3: files of zstd-compressed row groups.

    A shard of many rows is several files, of a task each: file p belongs to shard p % ``shards``.
    """
    out = df if shards is None else df.repartition(files_of(df.count() if shards > 1 else 0, shards))
    out.write.mode(MODES[init]).option("compression", "zstd").option("parquet.block.row.count.limit", row_group).parquet(path)


def finite(value: Column, kind: T.DataType) -> Column:
    """NaN and infinities become null, at any depth."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value) & (F.abs(value) < math.inf), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.StructType):
        made = F.struct(*[finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    return value


def ndjson(df: DataFrame, path: str, group_by: list[str] = (), init: str = "create", limit: int | None = None) -> None:
    """K4, K5: one object a line with nulls written out; grouped into folders on demand."""
    some = df if limit is None else df.limit(limit)
    made = some.select(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    writer = made.write.mode(MODES[init]).option("ignoreNullFields", "false")
    (writer.partitionBy(*group_by) if group_by else writer).json(path)


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    made = F.struct(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(made, {"ignoreNullFields": "false"}).alias("json"))


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the last; tasks pass on one row a key."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def warehouse(tables: dict[str, DataFrame], path: str, init: str = "append") -> None:
    """Tables below a folder; rows of a key that was loaded before are replaced (:mod:`.warehouse`)."""
    from locusframe.sources.warehouse import upsert

    for name, df in tables.items():
        if name not in WAREHOUSE_KEYS:
            raise ValueError(f"not a warehouse table: {name}")
        upsert(df, f"{path}/{name}", WAREHOUSE_KEYS[name], init)


def read_warehouse(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with one row for each key, the last loaded."""
    from locusframe.sources.warehouse import read

    return read(spark, f"{path}/{name}")


def insert_chunks(df: DataFrame, url: str, table: str, rows: int = 25_000, partitions: int = 8, load: str | None = None) -> int:
    """K8, K9: rows as JSON lines to a column store's HTTP end point, sent by the executors; how many there were.

    Every chunk has a token made of the load, its partition and its place there, by which the store
    tells a chunk that a task sends again from a new one.
    """
    query, load = f"INSERT INTO {table} FORMAT JSONEachRow", load or uuid.uuid4().hex

    def send(chunk: list[dict], token: str) -> None:
        data = "\n".join(r["json"] for r in chunk).encode()
        asked = urllib.parse.urlencode({"query": query, "insert_deduplicate": 1, "insert_deduplication_token": f"{load}-{token}"})
        with urllib.request.urlopen(urllib.request.Request(f"{url}/?{asked}", data=data), timeout=600) as answer:
            answer.read()

    return post_chunks(json_lines(df), send, rows, partitions)


def clickhouse(df: DataFrame, url: str, table: str, keys: list[str]) -> int:
    """K8: create the table, load the rows, and compare the counts; how many rows there are."""
    from locusframe.operators.schema import clickhouse_ddl

    def ask(text: str) -> str:
        with urllib.request.urlopen(urllib.request.Request(url, data=text.encode()), timeout=600) as answer:
            return answer.read().decode()

    ask(clickhouse_ddl(table, df.schema, keys))
    before = int(ask(f"SELECT count() FROM {table}").strip() or 0)
    wanted = insert_chunks(df, url, table)
    found = int(ask(f"SELECT count() FROM {table}").strip()) - before
    if found != wanted:
        raise OSError(f"{table} has {found} new rows of {wanted}")
    return found


def bigquery(df: DataFrame, path: str, table: str) -> dict:
    """Rows as Parquet below a folder, and beside them the job that loads them; the job's text."""
    from locusframe.operators.schema import bigquery_schema
    from locusframe.sources.keyed import Folder

    parquet(df, f"{path}/rows")
    job = {"load": {"sourceUris": [f"{path}/rows/*.parquet"], "sourceFormat": "PARQUET", "writeDisposition": "WRITE_APPEND", "destinationTable": table, "schema": {"fields": bigquery_schema(df.schema)}}}
    Folder(df.sparkSession, path).put("job.json", json.dumps(job, indent=2).encode())
    return job


def post_chunks(df: DataFrame, send: Callable[[list[dict], str], None], rows: int = 25_000, partitions: int = 8) -> int:
    """K9: rows in chunks, each with a token, to a function that runs on the executors, a few partitions at a time; how many rows.

    A task that runs again has the same rows in the same order, and so the same tokens.  Rows are counted as they are
    sent, once for each task that counts.
    """
    # The upstream keeps its own parallelism; only the sending is held to a few tasks.
    few, sent = df.repartition(partitions), df.sparkSession.sparkContext.accumulator(0)

    def run(it):
        part, k, n, chunk = TaskContext.get().partitionId(), 0, 0, []
        for r in it:
            chunk.append(r.asDict(recursive=True))
            n += 1
            if len(chunk) >= rows:
                send(chunk, f"{part}-{k}")
                k, chunk = k + 1, []
        if chunk:
            send(chunk, f"{part}-{k}")
        sent.add(n)

    few.foreachPartition(run)
    return sent.value


def ingest(spark: SparkSession, base: str, path: str, phenotype: str, ancestry: str) -> DataFrame:
    """Q11: the outputs of one phenotype into the warehouse; one row for each step with its number of rows.

    Steps: the manifest, loci, plots, significant variants of each sequencing
    type, variants of loci, gene associations, QQ points of each type.  A step
    without a file adds nothing; without a manifest there is nothing to take in.
    """
    from locusframe.sources.keyed import Folder

    folder = Folder(spark, base)
    if not folder.fs.exists(folder.at("manifest.json")):
        raise FileNotFoundError(f"{base}/manifest.json")
    whole = spark.read.text(f"{base}/manifest.json", wholetext=True)
    known = json.loads(whole.first().value)
    named = {"phenotype": F.lit(phenotype), "ancestry": F.lit(ancestry)}
    steps: list[tuple[str, DataFrame]] = []
    if known.get("loci"):
        steps.append(("loci", spark.createDataFrame(known["loci"]).withColumns(named)))
    if known.get("plots"):
        steps.append(("phenotype_plots", spark.createDataFrame([{"plot_type": k, "gcs_uri": u} for k, u in sorted(known["plots"].items())]).withColumns(named)))
    files = [("significant_variants", f"{kind}_significant.parquet", kind) for kind in SEQUENCING]
    files += [("loci_variants", "loci_variants.parquet", None), ("gene_associations", "gene_associations.parquet", None)]
    files += [("qq_points", f"qq_{kind}.parquet", kind) for kind in SEQUENCING]
    for table, name, kind in files:
        if folder.fs.exists(folder.at(name)):
            df = spark.read.parquet(f"{base}/{name}").withColumns(named)
            steps.append((table, df.withColumn("sequencing_type", F.lit(kind)) if kind else df))
    for table, df in steps:
        warehouse({table: df}, path)
    counts = [df.agg(F.lit(i).alias("step"), F.lit(t).alias("table"), F.count("*").alias("rows")) for i, (t, df) in enumerate(steps)]
    return reduce(lambda a, b: a.unionByName(b), counts).orderBy("step") if counts else spark.createDataFrame([], "step int, table string, rows long")


def manifest(counts: DataFrame, **head) -> str:
    """A small table of aggregates as a JSON document."""
    return json.dumps(head | {"rows": [r.asDict(recursive=True) for r in counts.collect()]}, default=str, sort_keys=True)
