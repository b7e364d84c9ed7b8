"""Genomic intervals: 1-based, both ends inclusive; sources, merging, membership."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bases of a stretch of a contig in which intervals are united first.
STRETCH = 1 << 20
SCHEMA = "contig string, start long, end long"
TEXT = re.compile(r"^(?P<contig>[^:\s]+):(?P<start>[\d,]+)-(?P<end>[\d,]+)$")


def parse(text: str) -> list[tuple[str, int, int]]:
    """``contig:start-end``, several joined by commas or blanks."""
    out = []
    for part in re.split(r"[;\s]+|,(?=[^,\s]+:)", text.strip()):
        if not part:
            continue
        m = TEXT.match(part)
        if not m:
            raise ValueError(f"not an interval: {part!r}")
        start, end = (int(m[k].replace(",", "")) for k in ("start", "end"))
        if start > end:
            raise ValueError(f"start after end: {part!r}")
        out.append((m["contig"], start, end))
    return out


def from_text(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([x for t in texts for x in parse(t)], SCHEMA)


def bed_to_inclusive(df: DataFrame, contig: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """half-open from 0 to inclusive from 1; empty intervals go."""
    return df.where(F.col(end) > F.col(start)).select(
        F.col(contig).alias("contig"), (F.col(start) + 1).cast("long").alias("start"), F.col(end).cast("long").alias("end")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """A BED, JSON or text file of intervals, by its suffix."""
    if path.endswith((".bed", ".bed.gz")):
        lines = spark.read.text(path).where(~F.trim("value").rlike("^(#|track|browser|$)"))
        part = F.split(F.col("value"), "\t")
        return bed_to_inclusive(
            lines.select(part[0].alias("contig"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))
        )
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        kind = f"array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
        return whole.select(F.explode(F.from_json("value", kind)).alias("i")).select("i.*")
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(#|$)"))
    one = F.trim("value")
    return lines.select(
        F.regexp_extract(one, r"^([^:\s]+):", 1).alias("contig"),
        F.replace(F.regexp_extract(one, r":([\d,]+)-", 1), F.lit(","), F.lit("")).cast("long").alias("start"),
        F.replace(F.regexp_extract(one, r"-([\d,]+)$", 1), F.lit(","), F.lit("")).cast("long").alias("end"),
    )


def islands(df: DataFrame, adjacent: bool, group: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Rows with ``island``: the number, within a group, of the run of intervals that touch one another."""
    before = Window.partitionBy(*group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("start") > F.max("end").over(before) + F.lit(1 if adjacent else 0)
    return df.withColumn("_new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("_new").over(upto)).drop("_new")


def merge(df: DataFrame, adjacent: bool = True, group: tuple[str, ...] = ("contig",)) -> DataFrame:
    """F12 (adjacent intervals too) and W2 (overlap only): the union of intervals as disjoint ones.

    Intervals that start within one stretch of ``STRETCH`` bases are united first,
    stretch by stretch; what is left of a contig, which is little where intervals
    are many, is united then.
    """
    stretch = F.floor(F.col("start") / STRETCH).alias("_stretch")
    # Equal intervals meet before the window, so that a repeated interval costs nothing there.
    once = df.select(*group, "start", "end", stretch).distinct()

    def united(part: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return islands(part, adjacent, by).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")

    return united(united(once, (*group, "_stretch")).drop("_stretch"), group)


def union(*tables: DataFrame) -> DataFrame:
    """all intervals, merged."""
    out = tables[0].select("contig", "start", "end")
    for t in tables[1:]:
        out = out.unionByName(t.select("contig", "start", "end"))
    return merge(out)


def contains(start: Column, end: Column, position: Column) -> Column:
    """F9."""
    return (start <= position) & (position <= end)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start <= other_end) & (end >= other_start)


def to_json(df: DataFrame) -> str:
    """A small table of intervals as a JSON document."""
    return json.dumps([r.asDict() for r in df.orderBy("contig", "start").collect()])
