"""Opening tables by path, and the sources of pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.predicates import KeyRange
from locusframe.operators import sampling
from locusframe.sources import keyed, vcf


def open_path(spark: SparkSession, path: str, ranges: list[KeyRange] = (), intervals: list[tuple[str, int, int]] | None = None, limits: keyed.Limits = keyed.LIMITS) -> DataFrame:
    """By suffix: variant-call text, keyed table, or what Spark reads itself.

    Ranges and intervals tell what is wanted, so that parts that cannot hold it
    are not opened; callers filter the rows themselves.  ``limits`` are a keyed table's.
    """
    if path.endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
        return vcf.read(spark, path, intervals)
    if path.rstrip("/").endswith(".ht"):
        return keyed.read(spark, path.rstrip("/"), ranges, intervals, limits=limits)
    for suffix, kind in ((".json", "json"), (".ndjson", "json"), (".orc", "orc"), (".csv", "csv")):
        if path.endswith(suffix):
            return spark.read.format(kind).load(path)
    return spark.read.parquet(path)


def sample_path(spark: SparkSession, path: str, n: int, seed: int = 42) -> DataFrame | None:
    """About ``n`` rows of a few of a table's parts (:func:`..operators.sampling.chosen_parts`); the others are not opened.

    None for sources of one part, or whose parts Spark does not tell.
    """
    if path.rstrip("/").endswith(".ht"):
        path = path.rstrip("/")
        m = keyed.metadata(spark, path)
        place = {p: i for i, p in enumerate(m.parts)}
        some = sampling.chosen_parts(list(m.parts), n, seed)
        if len(m.parts) < 2:
            return None
        # A partition is a part.
        df = keyed.read(spark, path, parts=sorted(place[p] for p in some))
        return sampling.reservoirs(df, F.spark_partition_id(), n, len(some), seed)
    if path.endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
        return None
    files = open_path(spark, path).inputFiles()
    if len(files) < 2:
        return None
    some = sampling.chosen_parts(files, n, seed)
    kind = next((k for suffix, k in ((".json", "json"), (".ndjson", "json"), (".orc", "orc"), (".csv", "csv")) if path.endswith(suffix)), "parquet")
    df = spark.read.schema(open_path(spark, path).schema).option("basePath", path).format(kind).load(some)
    return sampling.reservoirs(df, F.input_file_name(), n, len(some), seed)


def assets(spark: SparkSession, path: str) -> DataFrame:
    """An array of assets, or an object that has it under ``assets``."""
    kind = "array<struct<ancestry_group:string,analysis_id:string,uri:string,asset_type:string,sequencing_type:string>>"
    text = spark.read.text(path, wholetext=True)
    found = F.coalesce(F.from_json("value", f"struct<assets:{kind}>")["assets"], F.from_json("value", kind))
    return text.select(F.explode(found).alias("a")).select("a.*")


def parquet_tree(spark: SparkSession, folder: str, pattern: str = "*-sig.parquet") -> DataFrame:
    """All files of a pattern below a folder, with the path of each row's file."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read.parquet(folder).withColumn("file_path", F.col("_metadata.file_path"))
