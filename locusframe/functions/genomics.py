"""Column expressions for contigs, positions, alleles and p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lengths in bases of the contigs of assembly GRCh38, in order.
GRCH38_LENGTHS = {
    "1": 248956422,
    "2": 242193529,
    "3": 198295559,
    "4": 190214555,
    "5": 181538259,
    "6": 170805979,
    "7": 159345973,
    "8": 145138636,
    "9": 138394717,
    "10": 133797422,
    "11": 135086622,
    "12": 133275309,
    "13": 114364328,
    "14": 107043718,
    "15": 101991189,
    "16": 90338345,
    "17": 83257441,
    "18": 80373285,
    "19": 58617616,
    "20": 64444167,
    "21": 46709983,
    "22": 50818468,
    "X": 156040895,
}
#: -log10 of a p-value of zero.
P_CEILING = 350.0


def grch38(spark: SparkSession) -> DataFrame:
    """``contig``, ``length`` and the running start ``offset`` in contig order."""
    rows, at = [], 0
    for i, (name, length) in enumerate(GRCH38_LENGTHS.items()):
        rows.append((i, name, length, at))
        at += length
    return spark.createDataFrame(rows, "ordinal int, contig string, length long, offset long")


def strip_chr(contig: Column) -> Column:
    """Without a leading ``chr``."""
    return F.when(contig.startswith("chr"), contig.substr(F.lit(4), F.length(contig))).otherwise(contig)


def chr_prefixed(contig: Column) -> Column:
    """With a leading ``chr``."""
    return F.when(contig.startswith("chr"), contig).otherwise(F.concat(F.lit("chr"), contig))


def contig_number(contig: Column) -> Column:
    """1 to 22, X 23, Y 24, M or MT 25; other names by number up to 255, else 0."""
    bare = strip_chr(contig)
    number = F.when(bare.rlike("^[0-9]{1,3}$"), bare.cast("int"))
    named = F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25)
    return F.coalesce(named, F.when(number <= 255, number), F.lit(0))


def xpos(contig: Column, position: Column) -> Column:
    """One number that orders all positions."""
    return contig_number(contig).cast("long") * 1_000_000_000 + position.cast("long")


def xpos_ingest(contig: Column, position: Column) -> Column:
    """As X4, but mitochondrial contigs count as unknown."""
    bare = strip_chr(contig)
    return F.when(bare.isin("M", "MT"), position.cast("long")).otherwise(xpos(contig, position))


def neg_log10_p(p: Column, known: Column | None = None) -> Column:
    """A finite given value; else 350 for p <= 0, null for p > 1 or not finite, else -log10 p."""
    usable = p.isNotNull() & ~F.isnan(p) & (p <= 1.0)
    own = F.when(usable & (p <= 0.0), P_CEILING).when(usable, -F.log10(p))
    if known is None:
        return own
    finite = known.isNotNull() & ~F.isnan(known) & (F.abs(known) < math.inf)
    return F.when(finite, known).otherwise(own)


def usable_p(p: Column) -> Column:
    """above 0, at most 1, and a number."""
    return F.coalesce((p > 0.0) & (p <= 1.0) & ~F.isnan(p), F.lit(False))


def neg_log10_p_or_zero(p: Column) -> Column:
    """Single precision, zero for p <= 0."""
    return F.when(p > 0.0, -F.log10(p)).otherwise(0.0).cast("float")


def variant_id(contig: Column, position: Column, ref: Column, alt: Column, sep: str = "-") -> Column:
    """X8."""
    return F.concat_ws(sep, contig, position.cast("string"), ref, alt)


def locus_id(contig: Column, start: Column, end: Column) -> Column:
    """X9."""
    return F.concat_ws("_", contig, start.cast("string"), end.cast("string"))


def allele(alleles: Column, i: int) -> Column:
    """The allele or an empty string."""
    return F.coalesce(F.get(alleles, i), F.lit(""))


def gene_location(interval_contig: Column, start: Column, end: Column, contig: Column, position: Column) -> Column:
    """X11: the interval if it is usable, widened to 1,000 bases; else the position and 1,000 bases on."""
    usable = (F.coalesce(interval_contig, F.lit("")) != "") & (F.coalesce(start, F.lit(0)) > 0)
    by_interval = F.struct(
        chr_prefixed(interval_contig).alias("contig"),
        start.cast("int").alias("start"),
        F.greatest(end, start + 1000).cast("int").alias("end"),
    )
    by_position = F.struct(
        chr_prefixed(contig).alias("contig"), position.cast("int").alias("start"), (position + 1000).cast("int").alias("end")
    )
    return F.when(usable, by_interval).otherwise(by_position)


def midpoint(start: Column, end: Column) -> Column:
    """Integer middle."""
    return F.floor((start + end) / 2).cast("int")


def window_start(position: Column, window: int) -> Column:
    """At least 1."""
    return F.greatest(F.lit(1), position - window)


def stat_text(value: Column, kind: str) -> Column:
    """Text of a value as statistics show it; floats with six decimals."""
    if kind in ("float", "double"):
        wide = value.cast("double")
        special = F.when(F.isnan(wide), "NaN").when(wide == math.inf, "inf").when(wide == -math.inf, "-inf")
        return F.when(wide.isNotNull(), F.coalesce(special, F.format_string("%.6f", wide)))
    return value.cast("string")


def plot_x(contig: Column, position: Column, width: int = 3000, gap: int = 4) -> Column:
    """Pixel column of a position; null for contigs without a place."""
    total = sum(GRCH38_LENGTHS.values())
    scale = (width - gap * (len(GRCH38_LENGTHS) - 1)) / total
    pairs, at = [], 0.0
    for name, length in GRCH38_LENGTHS.items():
        pairs += [F.lit(name), F.lit(at)]
        at += length * scale + gap
    start = F.try_element_at(F.create_map(*pairs), strip_chr(contig))
    return start + position * F.lit(scale)


def plot_y(value: Column, height: int = 800, top: float | Column = 20.0, threshold: float = 10.0, share: float = 0.6) -> Column:
    """Pixel row; linear up to the threshold over a share of the height, logarithmic above."""
    span = F.log(F.greatest(top, F.lit(20.0)) / threshold) if isinstance(top, Column) else math.log(max(top, 20.0) / threshold)
    low = height - value / threshold * (height * share)
    part = F.least(F.log(value / threshold) / span, F.lit(1.0))
    high = F.greatest(height * (1 - share) - part * (height * (1 - share)), F.lit(0.0))
    return F.when(value <= threshold, low).otherwise(high)


def locus_x(position: Column, start: Column, end: Column, width: int) -> Column:
    """Linear within the region."""
    return (position - start) / F.greatest(end - start, F.lit(1)) * width


def contig_order(contig: Column) -> list[Column]:
    """O2: numbers first, other names after them by name."""
    bare = strip_chr(contig)
    return [F.coalesce(F.when(bare.rlike("^[0-9]{1,9}$"), bare.cast("int")), F.lit(100)).asc(), bare.asc()]


def bytes_text(n: int) -> str:
    """X21."""
    for unit, size in (("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)):
        if n >= size:
            return f"{n / size:.2f} {unit}"
    return f"{n} B"
