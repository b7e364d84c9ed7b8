"""Samples that repeat under a seed, whatever the number of partitions."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(keys: list[str], seed: int) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *[F.col(k) for k in keys]]


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """N rows of least hash, a uniform sample; each task passes on n rows at most."""
    return df.orderBy(*hash_order(keys, seed)).limit(n)


def chosen_parts(names: list[str], n: int, seed: int = 42) -> list[str]:
    """Of a table's parts about the root of ``n``, in the order of a seeded hash."""
    many = min(n, len(names), max(1, math.isqrt(max(n - 1, 0)) + 1))
    return sorted(names, key=lambda x: hashlib.md5(f"{seed}|{x}".encode()).hexdigest())[:many]


def reservoirs(df: DataFrame, part: Column, n: int, parts: int, seed: int = 42) -> DataFrame:
    """Of every part as many rows as make ``n`` of all, uniform within the part; at most ``n`` rows.

    A task passes on the rows of a part with the least random numbers, no others.
    """
    each = n // max(parts, 1) + 1
    numbered = df.withColumns({"_part": part, "_u": F.rand(seed)})
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_u"))
    some = numbered.withColumn("_k", rank).where(F.col("_k") <= each)
    return some.orderBy("_u").limit(n).drop("_part", "_u", "_k")


def sample_by_weight(df: DataFrame, n: int, weights: dict[str, float], by: str, keys: list[str], seed: int = 42) -> DataFrame:
    """R2: of each group, by its weight, a share of n rows."""
    total = sum(weights.values())
    pairs = [F.lit(x) for k, w in weights.items() for x in (k, int(-(-n * w // total)))]
    share = F.try_element_at(F.create_map(*pairs), F.col(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*hash_order(keys, seed)))
    return df.where(share.isNotNull()).withColumn("_k", rank).where((F.col("_k") <= share) & (F.col("_k") <= n)).drop("_k")


def sample_ids(df: DataFrame, key: str, fraction: float, always: list[str] = (), limit: int | None = None, seed: int = 42) -> DataFrame:
    """The guaranteed ids, then ids in hash order up to ceil(fraction * n)."""
    ids = df.select(key).distinct()
    n = ids.count()
    want = -(-int(n * fraction * 1_000_000) // 1_000_000)
    want = min(want, limit) if limit is not None else want
    first = F.when(F.col(key).isin(*always), 0).otherwise(1) if always else F.lit(1)
    return ids.orderBy(first, *hash_order([key], seed)).limit(max(want, len(always) if limit is None else min(len(always), limit)))


def owned_partitions(df: DataFrame, workers: int, worker: int) -> DataFrame:
    """Rows of the partitions that a worker has under modulo allocation."""
    return df.where(F.pmod(F.spark_partition_id(), F.lit(workers)) == worker)


def count_owned(partitions: int, workers: int, worker: int) -> int:
    return len(range(worker, partitions, workers))
