"""Whole-table statistics."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.functions.genomics import stat_text

SAMPLES = 10
#: Groups of tasks whose states merge first.
GROUPS = 256


def leaves(schema: T.StructType) -> list[tuple[str, Column]]:
    """Every leaf path with an array of the texts of its values; elements of arrays share a path.

    A null struct is one null at its own path.
    """
    out: list[tuple[str, Column]] = []

    def walk(path: str, values: Column, kind: T.DataType) -> None:
        # values: an array of what stands at the path.
        if isinstance(kind, T.StructType):
            out.append((path, F.transform(F.filter(values, lambda v: v.isNull()), lambda v: F.lit(None).cast("string"))))
            there = F.filter(values, lambda v: v.isNotNull())
            for f in kind.fields:
                walk(f"{path}.{f.name}", field_of(there, f.name), f.dataType)
        elif isinstance(kind, T.ArrayType):
            missing = F.transform(F.filter(values, lambda v: v.isNull()), lambda v: F.lit(None).cast("string"))
            out.append((path, missing))
            walk(path, F.flatten(F.filter(values, lambda v: v.isNotNull())), kind.elementType)
        elif isinstance(kind, T.MapType):
            pairs = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
            walk(path, F.transform(values, F.map_entries), pairs)
        else:
            out.append((path, F.transform(values, lambda v: stat_text(v, kind.typeName()))))

    def field_of(values: Column, name: str) -> Column:
        return F.transform(values, lambda v: v.getField(name))

    for f in schema.fields:
        walk(f.name, F.array(F.col(f"`{f.name}`")), f.dataType)
    return out


def field_statistics(df: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """A2: per leaf path the count (with nulls), nulls, least and greatest text, and the first distinct values.

    One pass: a task keeps of each path the numbers, the ends and its first ``samples``
    texts, so it passes on one row a path, whatever the data.  These merge
    like sums, in groups of tasks first.
    """
    found = leaves(df.schema)
    paths = [path for path, _ in found]

    def run(batches):
        state = [[0, 0, None, None, pa.array([], pa.string())] for _ in paths]
        for batch in batches:
            for own, column in zip(state, batch.columns):
                flat = column.flatten()
                own[0] += len(flat)
                own[1] += flat.null_count
                values = flat.drop_null()
                if not len(values):
                    continue
                ends = pc.min_max(values)
                low, high = ends["min"].as_py(), ends["max"].as_py()
                own[2] = low if own[2] is None else min(own[2], low, key=str.encode)
                own[3] = high if own[3] is None else max(own[3], high, key=str.encode)
                if len(own[4]) == samples:
                    # Only texts before the last one kept count.
                    values = values.filter(pc.less(values, own[4][-1]))
                some = pc.unique(pa.concat_arrays([own[4], values]))
                own[4] = some.take(pc.sort_indices(some)[:samples])
        columns = [paths, *[[x[k] for x in state] for k in range(4)], [x[4].to_pylist() for x in state]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["path", "count", "null_count", "min", "max", "first"])

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
    wide = df.select(*[values.alias(f"_{i}") for i, (_, values) in enumerate(found)])
    told = wide.mapInArrow(run, "path string, count long, null_count long, min string, max string, first array<string>")

    def merged(rows: DataFrame, by: list[str]) -> DataFrame:
        first = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("first")))), 1, samples)
        return rows.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("null_count").alias("null_count"), F.min("min").alias("min"), F.max("max").alias("max"), first.alias("first"))

    some = merged(told.withColumn("_some", F.spark_partition_id() % GROUPS), ["path", "_some"])
    return merged(some, ["path"]).withColumnRenamed("first", "distinct_sample").where("count > 0")



def partition_sizes(df: DataFrame, size_col: str) -> DataFrame:
    """A4: number, total, mean and sample deviation of sizes."""
    size = F.col(size_col)
    return df.agg(
        F.count(size).alias("n"),
        F.sum(size).alias("total"),
        F.avg(size).alias("mean"),
        F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("std_dev"),
    )


def file_sizes(df: DataFrame) -> DataFrame:
    """The files that a table is read from, with their sizes."""
    return df.select("_metadata.file_path", "_metadata.file_size").distinct()


def encoded_size(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in a row-wise encoding."""
    fixed = {"integer": 4, "long": 8, "float": 4, "double": 8, "boolean": 1, "short": 2, "byte": 1}
    if isinstance(kind, T.StringType):
        own = F.octet_length(value) + 4
    elif isinstance(kind, T.StructType):
        own = F.lit(0)
        for f in kind.fields:
            own = own + encoded_size(value.getField(f.name), f.dataType)
    elif isinstance(kind, T.ArrayType):
        own = F.aggregate(value, F.lit(4), lambda a, x: a + encoded_size(x, kind.elementType).cast("int"))
    else:
        own = F.lit(fixed.get(kind.typeName(), 8))
    return F.when(value.isNull(), 0).otherwise(own).cast("int")


def row_sizes(df: DataFrame, fraction: float | None = 0.001, seed: int = 42) -> DataFrame:
    """Of every field, and of whole rows, the mean, least and greatest bytes over a sample."""
    some = df if fraction is None else df.sample(fraction=fraction, seed=seed)
    sizes = {f.name: encoded_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    whole = sum(sizes.values(), F.lit(0))
    pairs = [F.struct(F.lit(n).alias("field"), s.alias("bytes")) for n, s in [("*", whole), *sizes.items()]]
    each = some.select(F.explode(F.array(*pairs)).alias("p")).select("p.field", "p.bytes")
    return each.groupBy("field").agg(
        F.count("*").alias("rows"), F.avg("bytes").alias("avg_bytes"), F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes")
    )


def extents(df: DataFrame, p: str = "pvalue") -> DataFrame:
    """Per contig the span of positions and the greatest -log10 p."""
    return df.groupBy("contig").agg(
        F.min("position").alias("min_position"), F.max("position").alias("max_position"), F.min(p).alias("min_p")
    ).withColumn("max_neg_log10_p", F.round(-F.log10("min_p"), 6)).drop("min_p")


def counts_by(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows, and rows that meet each condition, per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()])
