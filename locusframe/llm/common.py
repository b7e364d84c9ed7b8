"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_open: list[set[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset
    (a local test session) a temporary folder of this machine is used, and it
    is then recorded in the session so that later calls agree.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Tables made by :func:`cut` within go at the end, but for those taken out of the set given."""
    made: set[str] = set()
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
    for path in made:
        delete(spark, path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    for made in _open:
        made.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing needs any more, and let Spark drop the shuffle files of finished steps."""
    for made in _open:
        made.discard(df.shared_at)
    delete(df.sparkSession, df.shared_at)
    release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does once the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def handing_back(run):
    """A map over batches whose Python process, which Spark keeps for later tasks of any step, returns at the end what it has freed."""

    def mapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        # Of the C library in use, if it can.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return mapped


def sifted(df: DataFrame, by: str, some: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows of ``df`` whose ``by`` (a long) may be in ``some``, a table made by :func:`cut`: all that are, and few others.

    A bitmap of 32 bits a value goes to all tasks, of 8 MB at most, so that a join that follows need not shuffle
    what it drops.  Beyond 2**21 values more of the others stay; nothing is lost.
    """
    n = 1 << 15
    while n < min(bits, 32 * some.count()):
        n *= 2
    # Hashed, as values may have lower bits alike.
    place = F.pmod(F.xxhash64(F.col(by).cast("long"), F.lit(n)), F.lit(n))
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = some.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    octet = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = F.getbit(octet, (bit % 8).cast("int")) == 1
    return df.join(F.broadcast(maps), (bucket == F.col("_bucket")) & told).select(*df.columns)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
