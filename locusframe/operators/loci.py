"""Loci: greedy clumping of significant positions and merging of regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.intervals import merge
from locusframe.sources.shared import kept

#: Blocks of a contig, and how far a block's task sees beyond it, in windows.
BLOCK = 64
HALO = 8
#: What is known of a position: nothing yet, that it leads, that a lead has taken it.
OPEN, LEAD, TAKEN = 0, 1, 2


def settle(position: np.ndarray, order: np.ndarray, state: np.ndarray, low: int, high: int, window: int) -> np.ndarray:
    """States of positions (ascending) as far as these tell, of which all from ``low`` to before ``high`` are there.

    ``order`` gives them by rank.  A position leads if every one of a lower rank
    within the window is taken; where that is not known it stays open, and so
    do those of higher ranks around it that no lead takes.
    """
    state, held = state.copy(), np.zeros(len(position), bool)
    whole = (position - window >= low) & (position + window < high)
    first = np.searchsorted(position, position - window, "left")
    last = np.searchsorted(position, position + window, "right")
    for i in order.tolist():
        if state[i] == TAKEN:
            continue
        near = slice(first[i], last[i])
        if state[i] == OPEN and (held[i] or not whole[i]):
            held[near] = True
            continue
        own = state[near]
        own[own == OPEN] = TAKEN
        state[i] = LEAD
    return state


def leads(hits: DataFrame, by: list[str], window: int) -> DataFrame:
    """``hits`` (a row for each ``by``, position, ref, alt and p) that no lead of a lower rank takes.

    Blocks of a contig are settled in tasks of their own, each with what lies near
    it.  What depends on things further away stays open and is settled in a further
    round, with what the round before found; most often there is none.
    """
    reach, size = HALO * window, BLOCK * window
    block = lambda x: F.floor(x / size)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema)

    def work(t: pa.Table) -> pa.Table:
        position = t.column("position").to_numpy().astype(np.int64)
        sorted_ = np.argsort(position, kind="stable")
        t, position = t.take(pa.array(sorted_)), position[sorted_]
        keys = [("pvalue", "ascending"), ("position", "ascending"), ("ref", "ascending"), ("alt", "ascending")]
        order = pc.sort_indices(t, sort_keys=keys).to_numpy()
        here = t.column("_block")[0].as_py()
        state = settle(position, order, t.column("_state").to_numpy().astype(np.int8), here * size - reach, (here + 1) * size + reach, window)
        own = pa.array(position // size == here)
        return t.drop_columns(["_block", "_state"]).append_column("_state", pa.array(state.astype(np.int32))).filter(own)

    now = hits.withColumn("_state", F.lit(OPEN))
    while True:
        seen = F.sequence(block(F.col("position") - reach), block(F.col("position") + reach))
        # Blocks that are settled go on as they are.
        dealt = now.withColumn("_block", F.explode(seen))
        now = kept(dealt.groupBy(*by, "_block").applyInArrow(work, f"{kind}, _state int"), "clumps")
        if now.where(F.col("_state") == OPEN).isEmpty():
            return now.where(F.col("_state") == LEAD).drop("_state")


def clump(df: DataFrame, threshold: float = 5e-8, window: int = 1_000_000, min_variants: int = 1, by: list[str] = ()) -> DataFrame:
    """By rising p, a lead takes all free positions of its contig within the window.

    ``by`` names further columns (phenotype, ancestry) within which clumps are
    made, all at once.  Ties go to the smaller position, ref and alt.  No task
    holds a contig: see :func:`leads`.  A position belongs to the lead of the lowest rank within its reach.
    """
    groups, variant = [*by, "contig"], ["position", "ref", "alt", "pvalue"]
    usable = df.where((F.col("pvalue") < threshold) & F.col("position").isNotNull())
    hits = kept(usable.groupBy(*groups, *variant).agg(F.count("*").alias("n")), "hits")
    return clump_hits(hits, window, min_variants, by)


def clump_hits(hits: DataFrame, window: int, min_variants: int, by: list[str] = ()) -> DataFrame:
    """The clumps of significant positions, a row each with its number ``n`` of rows."""
    groups, variant = [*by, "contig"], ["position", "ref", "alt", "pvalue"]
    found = leads(hits, groups, window)
    lead = F.struct("pvalue", "position", "ref", "alt").alias("lead")
    bins = F.floor(F.col("position") / window)
    # At most two leads are within reach of a position, as leads are more than a window apart.
    spread = found.select(*groups, lead, F.explode(F.array(bins - 1, bins, bins + 1)).alias("_bin"))
    met = hits.withColumn("_bin", bins).join(spread, [*groups, "_bin"]).where(F.abs(F.col("position") - F.col("lead.position")) <= window)
    taken = met.groupBy(*groups, *variant, "n").agg(F.min("lead").alias("lead"))
    sizes = taken.groupBy(*groups, "lead").agg(F.sum("n").alias("n_variants")).where(F.col("n_variants") >= min_variants)
    at = F.col("lead.position")
    return sizes.select(
        *groups,
        at.cast("int").alias("lead_position"),
        F.col("lead.ref").alias("lead_ref"),
        F.col("lead.alt").alias("lead_alt"),
        F.col("lead.pvalue").alias("lead_pvalue"),
        F.greatest(F.lit(1), at - window).cast("int").alias("start"),
        (at + window).cast("int").alias("end"),
        "n_variants",
    )


def merge_regions(regions: DataFrame) -> DataFrame:
    """Overlapping regions become one; adjacent ones stay apart."""
    return merge(regions, adjacent=False)


def expand_and_merge(df: DataFrame, window: int, adjacent: bool = False) -> DataFrame:
    """W3 (overlap), W4 (adjacent too): positions widened by the window, merged."""
    reach = df.select(
        "contig", F.greatest(F.lit(1), F.col("position") - window).cast("long").alias("start"), (F.col("position") + window).cast("long").alias("end")
    )
    return merge(reach, adjacent=adjacent)


def loci(df: DataFrame, genes: DataFrame | None = None, strategy: str = "clump", threshold: float = 5e-8, window: int = 1_000_000, min_variants: int = 1, by: list[str] = ()) -> DataFrame:
    """Q6: regions of association with their lead and counts.

    ``clump``: regions of clumps, merged where they overlap.  ``window``: widened
    significant positions and gene intervals, merged where they touch.  ``df`` is
    read once: its significant rows are written and serve all steps.  ``by`` names
    columns of texts (phenotype, ancestry) within which regions are made, all at once;
    genes then have them too.
    """
    from locusframe.functions.genomics import locus_id, xpos
    from locusframe.operators.joins import interval_join

    # Groups travel in front of the contig's name, which all steps compare as a whole.
    unit = F.concat_ws("\x01", *[F.coalesce(c, F.lit("")) for c in by], "contig").alias("contig")
    hits = kept(df.where(F.col("pvalue") < threshold).select(unit, "position", "ref", "alt", "pvalue", "sequencing_type"), "hits")
    if strategy == "clump":
        each = hits.where("position is not null").groupBy("contig", "position", "ref", "alt", "pvalue").agg(F.count("*").alias("n"))
        regions = clump_hits(each, window, min_variants).select("contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    else:
        regions = hits.select("contig", F.greatest(F.lit(1), F.col("position") - window).cast("long").alias("start"), (F.col("position") + window).cast("long").alias("end"))
    if genes is not None:
        regions = regions.unionByName(genes.select(unit, F.greatest(F.lit(1), F.col("start") - window).cast("long").alias("start"), (F.col("end") + window).cast("long").alias("end")))
    # Written, as the join reads them twice.
    merged = kept(merge(regions, adjacent=strategy == "window"), "regions")
    met = interval_join(hits, merged)
    found = met.groupBy("contig", "start", "end").agg(
        F.min_by(F.struct("position", "ref", "alt", "pvalue", "sequencing_type"), F.struct("pvalue", "position", "ref", "alt")).alias("lead"),
        F.count_if(F.col("sequencing_type") == "exome").alias("exome_count"),
        F.count_if(F.col("sequencing_type") == "genome").alias("genome_count"),
    )
    found = found.withColumn("_unit", F.split("contig", "\x01")).withColumn("contig", F.element_at("_unit", -1))
    name = F.regexp_replace("contig", "chr", "")
    return found.select(
        *[F.get("_unit", i).alias(c) for i, c in enumerate(by)],
        locus_id(name, F.col("start"), F.col("end")).alias("locus_id"),
        "contig",
        "start",
        "end",
        xpos(F.col("contig"), F.col("start")).alias("xstart"),
        xpos(F.col("contig"), F.col("end")).alias("xstop"),
        F.col("lead.sequencing_type").alias("source"),
        F.concat_ws(":", "contig", F.col("lead.position").cast("string")).alias("lead_variant"),
        F.col("lead.pvalue").alias("lead_pvalue"),
        "exome_count",
        "genome_count",
    )
