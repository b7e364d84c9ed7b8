"""Exact top-k by inner product: columnar branch-and-bound.

Queries and candidates are dealt to the cells of a grid by their hash, queries by row and
candidates by column, each cell a bounded block of both; the deal depends on the rows only, so a
task that is run again after an executor is lost finds each in its place.  A cell holds its
candidates in vertical layout, dimension by dimension, dimensions of the most
mass first.  For a query it accumulates products block of dimensions by block;
after each block the mass that remains (the norms of what is left of query and
candidate, whose product bounds what the rest can add) gives every candidate an
upper bound, and candidates under the k-th best known score fall out: the
survivors are compacted before the next block.  Where there is more than one
block of candidates, every query is first searched in one of them, those of the
lowest hash of their id; the k-th best of it goes along to all cells, so that
these prune from their first block on.  Within a cell it rises by full scores of
the best so far.  Cells pass on k rows a query, and a last aggregate keeps the
best k.

A query set is compared with all rows, in blocks; with n candidates and q
queries the grid sends each candidate to q / QUERY_BLOCK cells and each query to
n / CANDIDATE_BLOCK.  Nothing is broadcast, nothing meets in one task.

Scores are exact: components are integers and sums stay below 2**53 in doubles
(beyond that bound, 64-bit integers are used throughout).

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; vectors are compared with those of equal length only (empty ones
score 0); ties go to the smaller id; a candidate with the query's own id is the
query itself; rows repeated under one id count once, with the best score; rows
with a null id take no part; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
DIM_BLOCK = 16
EXACT = 1 << 53


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as long; null if the vector takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(usable, ints)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, known: np.ndarray | None = None):
    """(query position, row id, score) of the k best rows of each query; rows of one id count once.

    With ``known``, scores that the k-th best of all rows reaches, rows below may be missing.
    """
    out_q, out_i, out_s = [], [], []
    if not len(rows):
        return out_q, out_i, out_s
    n, d = rows.shape
    # Ids ascend, so that of equal scores the first position is the smaller id.
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    repeated = bool((row_ids[1:] == row_ids[:-1]).any())
    top = int(max(abs(int(x.max(initial=0))) + abs(int(x.min(initial=0))) for x in (queries, rows))) if d else 0
    kind = np.float64 if top * top * max(d, 1) < EXACT else np.int64
    # Dimensions of the most mass first; vertical layout: one row of the array a dimension.
    mass = np.square(rows.astype(np.float64)).sum(0)
    by = np.argsort(-mass, kind="stable")
    columns = np.ascontiguousarray(rows[:, by].T.astype(kind))
    asked = queries[:, by].astype(kind)
    cuts = list(range(0, d, DIM_BLOCK)) + [d]
    # Mass that remains from each cut on, rounded up so that a bound is never too low.
    left = lambda x: np.sqrt(np.cumsum(np.square(x[::-1].astype(np.float64)), 0)[::-1]) * (1 + 1e-9)
    row_left = left(columns) if d else np.zeros((0, n))
    for q in range(len(asked)):
        v = asked[q]
        q_left = left(v)
        # A first k-th best, from the rows of the most mass.
        own = row_ids == query_ids[q]
        if d == 0:
            alive, score = np.flatnonzero(~own), np.zeros(n - int(own.sum()), kind)
        else:
            alive = np.flatnonzero(~own)
            score = v[: cuts[1]] @ columns[: cuts[1]][:, alive] if own.any() else v[: cuts[1]] @ columns[: cuts[1]]
            low = None if known is None or np.isnan(known[q]) else known[q]
            tried = False
            for a, b in zip(cuts[1:], cuts[2:]):
                bound = q_left[a] * row_left[a][alive]
                if not tried and len(alive) > 4 * k:
                    tried = True
                    # Whole scores of the best so far give a k-th best to prune by.
                    some = np.argpartition(-score, 2 * k)[: 2 * k]
                    at = alive[some]
                    some = some[np.unique(row_ids[at], return_index=True)[1]] if repeated else some
                    if len(some) >= k:
                        whole = v @ columns[:, alive[some]]
                        edge = np.partition(whole, len(whole) - k)[len(whole) - k]
                        low = edge if low is None else max(low, edge)
                if low is not None:
                    keep = score + bound >= low
                    alive, score = alive[keep], score[keep]
                score = score + v[a:b] @ columns[a:b][:, alive]
        if not len(alive):
            continue
        if repeated:
            # The best score of each id: ids ascend, so its rows stand together.
            first = np.flatnonzero(np.r_[True, row_ids[alive][1:] != row_ids[alive][:-1]])
            score, alive = np.maximum.reduceat(score, first), alive[first]
        if len(score) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            sure = np.flatnonzero(score > edge)
            pick = np.concatenate([sure, np.flatnonzero(score == edge)[: k - len(sure)]])
        else:
            pick = np.arange(len(score))
        out_q += [q] * len(pick)
        out_i += row_ids[alive[pick]].tolist()
        out_s += score[pick].astype(np.int64).tolist()
    return out_q, out_i, out_s


def search(queries: DataFrame, rows: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "ints") -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score`` of each query's k best rows.

    ``vector_col`` holds arrays of long; null ones take no part.
    """

    def usable(df: DataFrame) -> DataFrame:
        found = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
        # Rows that repeat would all be dealt to one column of the grid.
        return found.distinct()

    def matrix(t: pa.Table, d: int) -> np.ndarray:
        flat = t.column("v").combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), d)

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows and c.num_rows:
            d = q.column("d")[0].as_py()
            ids = q.column("id").to_numpy()
            known = q.column("known").to_numpy(zero_copy_only=False).astype(float)
            at, row, score = best(matrix(q, d), ids, matrix(c, d), c.column("id").to_numpy(), k, known)
        else:
            at, row, score, ids = [], [], [], np.zeros(0, np.int64)
        return pa.table(
            {
                "query_id": pa.array(ids[np.array(at, int)] if at else [], pa.int64()),
                "id": pa.array(row, pa.int64()),
                "score": pa.array(score, pa.int64()),
            }
        )

    def ranked(asked: DataFrame, others: DataFrame, down: int, across: int) -> DataFrame:
        """``query_id``, ``id``, ``score`` and ``rank`` of the k best, by the cells of a grid."""
        # By the row itself, so that a task that is run again deals alike; rows of one id are dealt by their vectors.
        spread = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("r", spread(down)).withColumn("c", every(across)).withColumn("d", F.size("v"))
        right = others.withColumn("c", spread(across)).withColumn("r", every(down)).withColumn("d", F.size("v"))
        cells = left.groupBy("r", "c", "d").cogroup(right.groupBy("r", "c", "d"))
        found = cells.applyInArrow(cell, "query_id long, id long, score long")
        once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        # The window limit is applied before the shuffle too: k rows a query and task are sent.
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked, all_rows = usable(queries), usable(rows)
    # Two numbers of the inputs size the grid.
    down = -(-asked.count() // QUERY_BLOCK) or 1
    across = -(-all_rows.count() // CANDIDATE_BLOCK) or 1
    asked_with = asked.withColumn("known", F.lit(None).cast("double"))
    if across > 1:
        first = all_rows.orderBy(F.xxhash64("id"), "id").limit(CANDIDATE_BLOCK)
        reached = ranked(asked_with, first, down, 1).where(F.col("rank") == k)
        # A bound from scores as doubles must not be above the score.
        bound = reached.select(F.col("query_id").alias("id"), (F.col("score") - F.abs(F.col("score")) * 1e-15 - 1).cast("double").alias("known"))
        asked_with = asked.join(bound, "id", "left")
    out = ranked(asked_with, all_rows, down, across)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
