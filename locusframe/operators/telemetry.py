"""Rollups over worker snapshots and job state.

Snapshots have ``worker_id``, ``ts`` and metrics.  Everything per worker is one
aggregate or one window, so nothing loops over workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def history(df: DataFrame, worker) -> DataFrame:
    """C6b."""
    return df.where(F.col("worker_id") == worker).orderBy("ts", "event_id")


def insert_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append to the store of snapshots, a Parquet folder; a writer never touches another's rows."""
    snapshots.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def snapshot_count(df: DataFrame) -> DataFrame:
    """C6e: how many snapshots there are."""
    return df.agg(F.count("*").alias("n"))


def clear_snapshots(spark: SparkSession, path: str) -> int:
    """C6e: delete all snapshots of a store, which stays with its columns; how many they were."""
    kept = stored(spark, path)
    n = kept.count()
    spark.createDataFrame([], kept.schema).write.mode("overwrite").parquet(path)
    return n


def latest(df: DataFrame, n: int) -> DataFrame:
    """C6c, C7g: the last n snapshots of every worker."""
    newest = Window.partitionBy("worker_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)


def workers(df: DataFrame) -> DataFrame:
    """C6d."""
    return df.select("worker_id").distinct()


def cluster_rate(df: DataFrame, now: Column, alive_seconds: int = 30) -> DataFrame:
    """Workers with a recent snapshot and the sum of their last rates."""
    last = df.groupBy("worker_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("l"))
    active = last.where(F.col("l.ts") >= now - F.expr(f"interval {alive_seconds} seconds"))
    return active.agg(F.count("*").alias("active_workers"), F.sum("l.value").alias("rate"))


def progress(done: Column, total: Column, elapsed: Column) -> Column:
    """Percent done and the seconds that the rest will take at this pace."""
    return F.struct(
        F.when(total > 0, done * 100.0 / total).otherwise(0.0).alias("percent"),
        F.when(done > 0, (total - done) * elapsed / done).alias("eta_seconds"),
    )


def bottleneck(cpu: Column, memory: Column, received: Column, sent: Column) -> Column:
    """C7e: what holds a cluster back."""
    return (
        F.when(cpu > 85, "cpu").when(memory > 85, "memory").when(received > 800, "network_in").when(sent > 500, "network_out")
        .when(cpu < 30, "io_wait").otherwise("balanced")
    )


def cluster_bottleneck(df: DataFrame, now: Column, alive_seconds: int = 30) -> DataFrame:
    """C7e: the bottleneck by the means of the last snapshots of the active workers."""
    metrics = ("cpu_percent", "memory_percent", "received_mb", "sent_mb")
    last = df.groupBy("worker_id").agg(F.max(F.struct("ts", "event_id", *metrics)).alias("l"))
    active = last.where(F.col("l.ts") >= now - F.expr(f"interval {alive_seconds} seconds"))
    means = active.agg(*[F.avg(f"l.{m}").alias(m) for m in metrics])
    return means.select(F.col("cpu_percent").alias("cpu"), F.col("memory_percent").alias("memory"), bottleneck(*map(F.col, metrics)).alias("label"))


def bottleneck_single(cpu_avg: Column, memory_max: Column, disk_write: Column) -> Column:
    """The same for one machine."""
    return F.when(cpu_avg > 80, "cpu").when(memory_max > 85, "memory").when((cpu_avg < 50) & (disk_write > 0), "io").otherwise("balanced")


def liveness(df: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """C7f."""
    last = df.groupBy("worker_id").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("status", F.when(F.col("last_seen") < now - F.expr(f"interval {seconds} seconds"), "suspected_dead").otherwise("alive"))


def since(df: DataFrame, ts: Column) -> DataFrame:
    """Strictly after."""
    return df.where(F.col("ts") > ts)


def phenotype_status(tasks: DataFrame, key: str = "phenotype_id", status: str = "status") -> DataFrame:
    """C7d: of every phenotype the state that its tasks add up to, by id.

    A failed task fails it; all done make it complete; any done or running, active; else it waits.
    """
    state = F.col(status)
    counts = tasks.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if(state == "done").alias("done"),
        F.count_if(state == "failed").alias("failed"),
        F.count_if(state == "running").alias("running"),
    )
    told = (
        F.when(F.col("failed") > 0, "failed").when(F.col("done") == F.col("total"), "complete")
        .when(F.col("done") + F.col("running") > 0, "active").otherwise("waiting")
    )
    return counts.withColumn("state", told).orderBy(key)


def activate(phenotypes: DataFrame, most: int = 20, key: str = "phenotype_id") -> DataFrame:
    """The states after waiting phenotypes have filled the free places, in the order of their ids.

    ``phenotypes`` has ``state`` and ``partitions``; one without partitions fails at once.
    """
    state = F.when((F.col("state") == "waiting") & (F.col("partitions") == 0), "failed").otherwise(F.col("state"))
    told = phenotypes.withColumn("state", state)
    active = told.where("state = 'active'").agg(F.count("*")).scalar()
    # The first ``most`` waiting ones by id are all that can start: a small table by construction.
    first = told.where("state = 'waiting'").orderBy(key).limit(most).select(key, F.lit(True).alias("_first"))
    placed = first.withColumn("_place", F.row_number().over(Window.orderBy(key)))
    starts = placed.where(F.col("_place") <= F.lit(most) - active).select(key, "_first")
    joined = told.join(starts, key, "left")
    return joined.withColumn("state", F.when(F.col("_first"), "active").otherwise(F.col("state"))).drop("_first").orderBy(key)


def aggregate_ready(phenotypes: DataFrame, batch: int = 10, key: str = "phenotype_id") -> DataFrame:
    """Phenotypes to aggregate now: those whose scans are done, once there are ``batch`` or nothing is left to scan."""
    counts = phenotypes.agg(
        F.count_if(F.col("state") == "scanned").alias("ready"), F.count_if(F.col("state").isin("waiting", "active")).alias("left")
    )
    now = counts.select((F.col("ready") >= batch) | ((F.col("ready") > 0) & (F.col("left") == 0))).scalar()
    return phenotypes.where((F.col("state") == "scanned") & now).orderBy(key).limit(batch)


def stage_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """C7b."""
    return df.groupBy(status).agg(F.count("*").alias("n"))
