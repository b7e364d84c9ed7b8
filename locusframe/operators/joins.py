"""Lookups and joins.

Range joins go by bins: an interval is listed under each bin of ``bin_width``
bases that it touches, a position falls into one, and the join is on contig and
bin with the range as a residual.  A pair meets in one bin only, so no pair
appears twice.  Listings are counted first: up to ``FEW`` are broadcast, more are
sorted and merged; rows never are broadcast, and nothing is a nested loop.  Where many
intervals lie over one place, rows meet them in tiles, so that pairs take little room.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.sources.shared import kept

BIN_WIDTH = 1 << 14
#: Bins that may list an interval, but for one; wider intervals are listed under coarser bins.
MAX_BINS = 4
#: Levels of bins, each of MAX_BINS times the width of the one before.
LEVELS = tuple(range(12))
#: Listings of intervals that are broadcast: some 150 MB.
FEW = 1 << 21
#: Intervals listed under a row's bins, in the mean, from which on rows and intervals meet in tiles.
DENSE = 16
#: Listings of a bin in one tile, neighbouring rows in one block, and meetings of rows with tiles in one task.
TILE, BLOCK, TASK = 1 << 7, 1 << 8, 1 << 20


def level_of(width: Column, bin_width: int) -> Column:
    """The finest level at which an interval of this width is listed under few bins."""
    level = F.when(width < bin_width * MAX_BINS, 0)
    for k in LEVELS[1:-1]:
        level = level.when(width < bin_width * MAX_BINS ** (k + 1), k)
    return level.otherwise(LEVELS[-1])


def bin_size(level: Column, bin_width: int) -> Column:
    return F.lit(bin_width).cast("long") * F.pow(F.lit(MAX_BINS), level).cast("long")


def _bins(level: Column, bin_width: int, start: str, end: str) -> tuple[Column, Column]:
    size = bin_size(level, bin_width)
    return F.floor(F.col(start) / size).cast("long"), F.floor(F.col(end) / size).cast("long")


def levelled(intervals: DataFrame, bin_width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that hold anything, with the ``_level`` of their bins."""
    return intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level_of((F.col(end) - F.col(start)).cast("long"), bin_width))


def binned(intervals: DataFrame, bin_width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals with ``_level`` and ``_bin``: a wide interval is listed under few bins of a coarser level."""
    return levelled(intervals, bin_width, start, end).withColumn("_bin", F.explode(F.sequence(*_bins(F.col("_level"), bin_width, start, end))))


def points_in(rows: DataFrame, contig: str, position: str, spans: DataFrame, names: tuple[str, str, str], bin_width: int, few: int, dealt: bool = False) -> DataFrame:
    """Each row with every span (contig, start and end by ``names``) that holds its position; the contig of spans is dropped.

    A row is looked up once at each level of bins in use.  A job over the spans alone counts
    their listings: Spark's estimates do not see what an explode makes of a small file.
    Where a row has many of them, see :func:`in_tiles`; else, with ``dealt``, rows are dealt by hash first.
    """
    on, start, end = names
    marked = binned(spans.withColumnRenamed(on, "_contig"), bin_width, start, end)
    bins = marked.groupBy("_level", "_contig", "_bin").agg(F.count("*").alias("n"))
    found = bins.groupBy("_level").agg(F.sum("n").alias("n"), F.count("*").alias("bins"), F.sum(F.ceil(F.col("n") / TILE)).alias("tiles")).collect()
    used = sorted(x["_level"] for x in found) or [LEVELS[0]]
    near = "broadcast" if sum(x["n"] for x in found) <= few else "merge"

    def listed(some: DataFrame) -> DataFrame:
        at = F.floor(F.col(position).cast("long") / bin_size(F.col("_l"), bin_width)).cast("long")
        return some.withColumn("_l", F.explode(F.array(*map(F.lit, used)))).withColumn("_b", at)

    if found and sum(x["n"] / x["bins"] for x in found) >= DENSE:
        heads = "broadcast" if sum(x["tiles"] for x in found) <= few else "merge"
        return in_tiles(rows, contig, position, marked, (start, end), listed, (heads, near), sum(x["tiles"] / x["bins"] for x in found))
    if dealt:
        rows = rows.repartition(task_count(rows), F.xxhash64(*rows.columns))
    met = listed(rows).join(
        marked.hint(near),
        (F.col(contig) == F.col("_contig"))
        & (F.col("_l") == F.col("_level"))
        & (F.col("_b") == F.col("_bin"))
        & (F.col(start) <= F.col(position))
        & (F.col(position) <= F.col(end)),
    )
    return met.drop("_l", "_b", "_level", "_bin", "_contig")


def task_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_tiles(
    rows: DataFrame, contig: str, position: str, marked: DataFrame, ends: tuple[str, str], listed: Callable[[DataFrame], DataFrame], hints: tuple[str, str], each: float
) -> DataFrame:
    """:func:`points_in` for rows with many spans: a block of neighbouring rows meets one tile of spans after the other.

    Pairs are many more than rows and spans, so what counts is what they take where they are written.
    In this order the values of a row are a run, and those of spans repeat one short list, of which
    Parquet's runs and codecs make a few bits; in any other order a pair takes whole values.
    A bin's listings are cut into arrays of ``TILE``, and rows dealt by ranges of their places to as
    many tasks as the ``each`` tiles of a row ask for.
    """
    start, end = ends
    place, own = F.col(position), [c for c in marked.columns if c not in ("_contig", "_level", "_bin")]
    number = F.row_number().over(Window.partitionBy("_contig", "_level", "_bin").orderBy(start, end))
    tiles = marked.withColumn("_tile", F.floor((number - 1) / TILE)).groupBy("_contig", "_level", "_bin", "_tile")
    # Written, as they are read twice: for what tiles a row meets, and for these.
    tiles = kept(tiles.agg(F.min(start).alias("_low"), F.max(end).alias("_high"), F.collect_list(F.struct(*own)).alias("_spans")), "tiles")
    if hints[1] == "broadcast":
        parts = max(task_count(rows), int(rows.count() * each / TASK) + 1)
        # Rows of one place are told apart by what a hash takes, equal ones by where they come from, which a task that runs again finds the same.
        some = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
        rows = rows.withColumn("_h", F.xxhash64(*some, F.spark_partition_id())).repartitionByRange(parts, contig, position, "_h").drop("_h")
        rows = rows.sortWithinPartitions(contig, position).withColumn("_row", F.monotonically_increasing_id())
    heads = tiles.select(F.col("_contig").alias("_c"), "_level", "_bin", F.col("_tile").alias("_t"), "_low", "_high")
    met = listed(rows).join(
        heads.hint(hints[0]),
        (F.col(contig) == F.col("_c")) & (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_bin")) & place.between(F.col("_low"), F.col("_high")),
    ).drop("_c", "_level", "_bin", "_low", "_high")
    if hints[1] == "broadcast":
        met = met.sortWithinPartitions(F.floor(F.col("_row") / BLOCK), "_t", "_row", "_l")
        # Spark drops a sort below a join, unless the places of its rows are asked for.
        met = met.withColumn("_n", F.monotonically_increasing_id()).where("_n >= 0").drop("_row", "_n")
    whole = tiles.select("_contig", "_level", "_bin", "_tile", "_spans").hint(hints[1])
    met = met.join(whole, (F.col(contig) == F.col("_contig")) & (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_bin")) & (F.col("_t") == F.col("_tile")))
    return met.select(*rows.drop("_row").columns, F.inline("_spans")).where((F.col(start) <= place) & (place <= F.col(end)))


def interval_join(rows: DataFrame, intervals: DataFrame, contig: str = "contig", position: str = "position", bin_width: int = BIN_WIDTH) -> DataFrame:
    """Each row with every interval that holds its position.

    ``intervals`` has ``contig``, ``start``, ``end`` and any other columns; its
    contig is dropped, and no other name may be in both.
    """
    return points_in(rows, contig, position, intervals, ("contig", "start", "end"), bin_width, FEW)


def interval_semi_join(rows: DataFrame, intervals: DataFrame, contig: str = "contig", position: str = "position", bin_width: int = BIN_WIDTH) -> DataFrame:
    """Rows whose position lies in any interval.

    Merged intervals are disjoint, so all of them together are listed under as
    many bins as the contigs have, and once more each: one level of bins is enough.
    """
    from locusframe.operators.intervals import merge

    pieces = bin_pieces(merge(intervals), bin_width)
    at = F.floor(F.col(position).cast("long") / bin_width).cast("long")
    return rows.withColumn("_b", at).join(
        pieces,
        (F.col(contig) == F.col("_contig")) & (F.col("_b") == F.col("_bin")) & F.col(position).between(F.col("_start"), F.col("_end")),
        "left_semi",
    ).drop("_b")


def bin_pieces(intervals: DataFrame, bin_width: int) -> DataFrame:
    first, last = (F.floor(F.col(c) / bin_width).cast("long") for c in ("start", "end"))
    return intervals.select(
        F.col("contig").alias("_contig"), "start", "end", F.explode(F.sequence(first, last)).alias("_bin")
    ).select("_contig", "_bin", F.col("start").alias("_start"), F.col("end").alias("_end"))


def overlap_join(left: DataFrame, right: DataFrame, bin_width: int = BIN_WIDTH) -> DataFrame:
    """Pairs of intervals of one contig that overlap.

    ``left`` has contig, start, end; ``right`` has g_contig, g_start, g_end.  The later
    start of a pair lies in the other interval: pairs are starts of the right within
    the left, and starts of the left within the right beyond its own start.  Starts are
    dealt by hash to a fixed number of tasks first, as few rows may make many pairs.
    """
    some, others = left.where("start <= end"), right.where("g_start <= g_end")
    inside = points_in(others, "g_contig", "g_start", some, ("contig", "start", "end"), bin_width, FEW, dealt=True).withColumn("contig", F.col("g_contig"))
    around = points_in(some, "contig", "start", others, ("g_contig", "g_start", "g_end"), bin_width, FEW >> 4, dealt=True)
    around = around.where(F.col("g_start") < F.col("start")).withColumn("g_contig", F.col("contig"))
    columns = [*left.columns, *right.columns]
    return inside.select(*columns).unionByName(around.select(*columns))


def point_lookup(df: DataFrame, **key) -> DataFrame:
    """Rows of one key; nested fields by double underscores."""
    made = [F.col(k.replace("__", ".")) == F.lit(v) for k, v in key.items()]
    return df.where(reduce(lambda a, b: a & b, made))


def allele_filter(df: DataFrame, ref: str | None = None, alt: str | None = None, alleles: str = "alleles") -> DataFrame:
    """F16."""
    for i, want in ((0, ref), (1, alt)):
        if want is not None:
            df = df.where(F.get(F.col(alleles), i) == want)
    return df


def pair_left_join(left: DataFrame, right: DataFrame, keys: list[str], order_left: list[Column], order_right: list[Column]) -> DataFrame:
    """Left join that uses each right row for one left row of its key, in the given orders."""
    number = lambda df, order: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, order_left).join(number(right, order_right), [*keys, "_rn"], "left").drop("_rn")


def annotate(rows: DataFrame, notes: DataFrame, keys: list[str], fields: list[str], as_json: str | None = None, few: bool = False) -> DataFrame:
    """Fields of a key-unique table, as columns or as one JSON column.

    With ``few`` rows against many notes the notes are cut down to the rows' keys
    first, before whatever makes them aggregates or sorts; rows are then planned twice.
    """
    if few:
        notes = notes.join(rows.select(*[F.col(k).alias(k) for k in keys]).distinct(), keys, "left_semi")
    found = notes.select(*keys, *fields)
    if as_json:
        found = notes.select(*keys, F.to_json(F.struct(*fields)).alias(as_json))
    return rows.join(found, keys, "left")


def lead_in_regions(rows: DataFrame, regions: DataFrame, p: str = "pvalue", tie: list[str] = ("position", "ref", "alt")) -> DataFrame:
    """Of every region the row of least p.  Regions are made once and written, as the join reads them twice."""
    met = interval_join(rows, kept(regions, "regions"))
    best = met.groupBy("contig", "start", "end").agg(
        F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != "contig"]), F.struct(p, *tie)).alias("lead")
    )
    return best.select("contig", "start", "end", "lead.*")


def in_any(rows: DataFrame, intervals: DataFrame, contig: str = "contig", position: str = "position") -> DataFrame:
    """Interval semi join with each contig's envelope as a filter that the scan can use.

    The envelope is an aggregate with one row a contig.
    """
    spans = intervals.groupBy(F.col("contig").alias("_c")).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    near = rows.join(spans, (F.col(contig) == F.col("_c")) & F.col(position).between(F.col("_lo"), F.col("_hi")), "left_semi")
    return interval_semi_join(near, intervals, contig, position)


def pivot_assets(assets: DataFrame) -> DataFrame:
    """One row of each (ancestry, analysis) with the path of every sort of asset."""
    pick = lambda kind, seq: F.max(F.when((F.col("asset_type") == kind) & (F.col("sequencing_type") == seq), F.col("uri")))
    return assets.groupBy("ancestry", "analysis_id").agg(
        pick("variant", "exome").alias("exome_uri"),
        pick("variant", "genome").alias("genome_uri"),
        F.max(F.when(F.col("asset_type") == "gene", F.col("uri"))).alias("gene_uri"),
    )


def exclude_completed(todo: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet."""
    return todo.join(completed, keys, "left_anti")
