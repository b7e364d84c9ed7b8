"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA-style).

Anchors and rows are dealt to blocks by the hash of their id and cut into panels
of ``DIMS`` dimensions.  The cell of an anchor block and a row block gets the panels
of both, multiplies them one after the other and adds the products up in its own
tile of 64-bit scores, ``STRIP`` anchors at a time.  Each strip is reduced
at once to what it can contribute: the best few rows of each anchor (and,
for negatives, of each window of scores that an anchor's positive opens).  A last
aggregate ranks what the cells pass on.  Only panels are shuffled, never scores.

Two such products are made, so that no score is computed for nothing: positives
multiply anchors with the rows of their own label only, in blocks as many as the
label needs (a hot label is many blocks); their scores are the windows in which
the second product, over all rows, looks for rows of other labels.

Nothing is broadcast or collected but three counts that size the grids.  A cell
has ``ANCHORS`` x ``ROWS`` vectors at most, about, whatever the data, and a row goes to
as many cells as there are blocks of anchors; a task that
is run again finds the same rows in the same blocks.

Scores are exact: products are made as doubles where no sum can pass 2**53, else
as 64-bit integers.

Defined cases: rows with a null id, label or vector take no part (a vector that
holds null or non-finite components should be given as null, as
:func:`locusframe.llm.topk.quantised` does); vectors are compared with those of
equal length only (empty ones score 0); rows repeated under one id count once, the least by
label and vector; ties go to the smaller id; an anchor without positives, or a
positive without negatives in its window, gives no rows; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Anchors and rows of a cell, about, anchors of a strip, and dimensions of a panel.
ANCHORS = 16_384
ROWS = 16_384
STRIP = 256
DIMS = 32
#: Rows of small tables lie in up to so many blocks of at least so many rows, for the sake of tasks.
SPREAD = 64
SMALL = 1024
EXACT = 1 << 53


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    flat = t.column(column).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of all rows of ``a`` and ``b``, as 64-bit integers."""
    width = a.shape[1]
    if not width or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top = [max(abs(int(x.max())), abs(int(x.min()))) for x in (a, b)]
    if top[0] * top[1] * width < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _cell(asked: pa.Table, others: pa.Table):
    """Strip by strip of a cell's anchors: the scores, the anchors, their labels and windows; and the rows and labels."""
    if not asked.num_rows or not others.num_rows:
        return
    sides = []
    for t in (asked, others):
        t = t.sort_by([("k", "ascending"), ("id", "ascending")])
        cuts = np.flatnonzero(np.r_[True, np.diff(t.column("k").to_numpy()) != 0, True])
        sides.append([t.slice(a, b - a) for a, b in zip(cuts, cuts[1:])])
    left, right = sides
    panels = [(_matrix(a, "part"), _matrix(b, "part")) for a, b in zip(left, right)]
    ids, kinds = (right[0].column(c).to_numpy() for c in ("id", "label"))
    for at in range(0, left[0].num_rows, STRIP):
        own = left[0].slice(at, STRIP)
        total = np.zeros((own.num_rows, len(ids)), np.int64)
        for a, b in panels:
            total += multiply(a[at : at + STRIP], b)
        yield total, *[own.column(c).to_pylist() for c in ("id", "label", "windows")], ids, kinds


def _first(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the ascending positions ``at`` the k of the highest scores, earlier ones first among equals."""
    own = score[at]
    if len(at) > k:
        edge = np.partition(own, len(own) - k)[len(own) - k]
        sure = np.flatnonzero(own > edge)
        at = at[np.r_[sure, np.flatnonzero(own == edge)[: k - len(sure)]]]
    return at


def _positives(k: int):
    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        out = ([], [], [])
        for score, anchors, _, _, ids, _ in _cell(asked, others):
            for q, anchor in enumerate(anchors):
                at = _first(score[q], np.flatnonzero(ids != anchor), k)
                for column, x in zip(out, ([anchor] * len(at), ids[at].tolist(), score[q, at].tolist())):
                    column += x
        return pa.table(dict(zip(("anchor_id", "id", "score"), (pa.array(x, pa.int64()) for x in out))))

    return run


def _negatives(k: int, low: int, high: int):
    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        for score, anchors, own, windows, ids, kinds in _cell(asked, others):
            for q, anchor in enumerate(anchors):
                other = kinds != own[q]
                for positive in windows[q]:
                    p = positive["score"]
                    # low * p <= 100 * s <= high * p, in integers of any size.
                    least, most = -(-low * p // 100), high * p // 100
                    at = _first(score[q], np.flatnonzero(other & (score[q] >= least) & (score[q] <= most)), k)
                    n = len(at)
                    for column, x in zip(out, ([anchor] * n, [positive["id"]] * n, [p] * n, ids[at].tolist(), score[q, at].tolist())):
                        column += x
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "id", "score"), (pa.array(x, pa.int64()) for x in out))))

    return run


def _blocks(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def _row_blocks(n: Column) -> Column:
    return F.greatest(_blocks(n, ROWS), F.least(F.lit(SPREAD), _blocks(n, SMALL)))


def _spread(rows: DataFrame, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
    """Every row, cut into chunks, in its own block and against all blocks of the other side."""
    dealt = rows.withColumn("d", F.size("v")).withColumn(own, F.pmod(F.xxhash64("id"), own_blocks).cast("int"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("v") / DIMS).cast("int") - 1)),
        lambda k: F.struct(k.alias("k"), F.slice("v", k * DIMS + 1, F.lit(DIMS)).alias("part")),
    )
    dealt = dealt.withColumn("c", F.explode(chunks)).withColumn(other, F.explode(F.sequence(F.lit(0), other_blocks - 1)))
    # Columns of its own, as both sides of a cell may come from the same rows.
    named = {"k": "c.k", "part": "c.part"}
    return dealt.select(*[F.col(named.get(c, c)).alias(c) for c in ("grid", "i", "j", "d", "k", "id", "label", "windows", "part")])


def cells(anchors: DataFrame, rows: DataFrame, work, layout: str) -> DataFrame:
    """What ``work`` finds in the cells of all blocks, within each ``grid``.

    Both have ``grid``, ``id``, ``label``, ``v``, ``windows`` and the numbers of blocks, ``down`` and ``across``.
    """
    left = _spread(anchors, "i", F.col("down"), "j", F.col("across"))
    right = _spread(rows, "j", F.col("across"), "i", F.col("down"))
    # Vectors of one length meet.
    key = ["grid", "i", "j", "d"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, layout)


def mine(
    df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "ints",
) -> DataFrame:
    """Of each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels.

    ``anchor`` is a condition on the rows of ``df``; ``vector_col`` holds arrays of long.  A negative's score lies
    within ``low`` and ``high`` hundredths of the positive's.  Columns: ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score``, ``negative_score``.
    """
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    once = given.where("id is not null and label is not null and v is not null").groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r"))
    none = F.lit(None).cast("array<struct<id: long, score: long>>").alias("windows")
    rows = once.select("id", "r.label", "r.v", "r.asks", none)
    # Two numbers a label size its grid, two of all rows the other's.
    sizes = rows.groupBy("label").agg(_row_blocks(F.count("*")).alias("across"), _blocks(F.count_if("asks"), ANCHORS).alias("down"))
    by_label = rows.join(sizes, "label").withColumn("grid", F.col("label"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    own = cells(by_label.where("asks"), by_label, _positives(positives), "anchor_id long, id long, score long")
    best = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    windows = best.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("windows"))
    across, down = rows.agg(_row_blocks(F.count("*")), _blocks(F.count_if("asks"), ANCHORS)).first()
    sized = rows.withColumn("grid", F.lit(0).cast("long")).withColumn("across", F.lit(across)).withColumn("down", F.lit(down))
    asked = sized.where("asks").drop("windows").join(windows.withColumnRenamed("anchor_id", "id"), "id")
    found = cells(asked, sized, _negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score long, id long, score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
