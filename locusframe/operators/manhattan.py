"""Association pipelines: projected rows, plot points, QQ tables, locus variants, batch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import genomics as g
from locusframe.operators import burden, loci
from locusframe.operators.joins import interval_join, pivot_assets
from locusframe.sources.shared import kept

# Names under which sources give a statistic; the first that is there counts, then any case of it.
ALIASES = {
    "pvalue": ("Pvalue", "pvalue"),
    "neg_log10": ("Pvalue_log10",),
    "beta": ("BETA", "beta"),
    "se": ("SE", "se"),
    "af": ("AF_Allele2", "AF", "af"),
    "ac_cases": ("AC_case", "ac_case"),
    "ac_controls": ("AC_ctrl", "ac_ctrl"),
    "af_cases": ("AF_case", "af_case"),
    "af_controls": ("AF_ctrl", "af_ctrl"),
    "association_ac": ("AC_Allele2",),
}
#: Rows of a bucket of p that one task ranks.
HOT = 1 << 20
STATS = ("beta", "se", "af", "ac_cases", "ac_controls", "af_cases", "af_controls", "association_ac")


def by_alias(df: DataFrame, names: tuple[str, ...]) -> Column:
    """the first name that is a column, else one equal but for case, else null; as double."""
    found = next((n for n in names if n in df.columns), None)
    lower = {c.lower(): c for c in df.columns}
    found = found or next((lower[n.lower()] for n in names if n.lower() in lower), None)
    return F.col(f"`{found}`").cast("double") if found else F.lit(None).cast("double")


def association_rows(df: DataFrame) -> DataFrame:
    """contig, position, ref, alt, p, -log10 p and statistics; rows without a place or a usable p go."""
    nested = "locus" in df.columns
    place = [F.col("locus.contig"), F.col("locus.position")] if nested else [F.col("contig"), F.col("position")]
    alleles = [g.allele(F.col("alleles"), i) for i in (0, 1)] if "alleles" in df.columns else [F.col("ref"), F.col("alt")]
    out = df.select(
        g.chr_prefixed(place[0]).alias("contig"),
        place[1].cast("int").alias("position"),
        alleles[0].alias("ref"),
        alleles[1].alias("alt"),
        by_alias(df, ALIASES["pvalue"]).alias("pvalue"),
        g.neg_log10_p(by_alias(df, ALIASES["pvalue"]), by_alias(df, ALIASES["neg_log10"])).alias("neg_log10_p"),
        *[by_alias(df, ALIASES[s]).alias(s) for s in STATS],
    )
    return out.dropna(subset=["contig", "position", "neg_log10_p"])


def plot_points(df: DataFrame, threshold: float = 5e-8, width: int = 3000, height: int = 800, rounded: bool = True, keep: list[str] = ()) -> DataFrame:
    """Q12, Q13: pixel places of all variants with a place on the plot.

    Rows go by what has no place (contig, position, p), not by the computed
    places: a filter on these would compute them twice.
    """
    placed = F.coalesce(g.strip_chr(F.col("contig")).isin(*g.GRCH38_LENGTHS), F.lit(False)) & F.col("position").isNotNull()
    df = df.where(placed & (F.col("pvalue") <= 1.0) & ~F.isnan("pvalue"))
    y = g.neg_log10_p(F.col("pvalue"))
    x_px, y_px = g.plot_x(F.col("contig"), F.col("position"), width), g.plot_y(y, height)
    if rounded:
        x_px, y_px = F.round(x_px, 4), F.round(y_px, 4)
    return df.select(
        "contig", "position", x_px.alias("x_px"), y_px.alias("y_px"), (F.col("pvalue") < threshold).alias("significant"), *([] if rounded else ["pvalue"]), *keep
    )


def p_bucket(p: Column, fine: int = 1024) -> Column:
    """A number that rises with p: even steps above 1 / ``fine``, halvings below.

    Of p-values without an association, which spread evenly, every step holds as many.
    """
    small = F.greatest(-F.floor(-F.log2(p * fine)), F.lit(-1100)).cast("int")
    return F.when(p * fine < 1.0, small - 1).otherwise(F.floor(p * fine).cast("int"))


def ranged_ranks(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with their rank (from 1) by ``order`` within groups of any size.

    Spark deals rows by sampled ranges of groups and order; the rank is a row's place in
    its sorted range plus the rows of the group in the ranges before, of which there is one count a range and group.
    """
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    # Written once, as counts and places must come from the same ranges.
    placed = kept(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_range": F.spark_partition_id()}), "ranges")
    counts = placed.groupBy(*groups, "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    met = placed.join(counts, [*groups, "_range"])
    return met.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_first", "_range", "_rows", "_before")


def qq_points(df: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame:
    """Q9: observed and expected -log10 p of every contig, expected from the rank of p.

    Ranks are within contigs.  A contig is cut into buckets of p, each of which is
    ranked on its own; the rows of a contig in lower buckets, counted apart, come
    on top.  So no task sorts a contig.  Buckets of over ``hot`` (``HOT``) rows, where many rows have one p, are cut
    again, by ranges of (p, keys): see :func:`ranged_ranks`.
    """
    usable = df.where(g.usable_p(F.col("pvalue"))).withColumn("_bucket", p_bucket(F.col("pvalue")))
    by_contig = Window.partitionBy("contig")
    before = by_contig.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each contig and bucket: a few thousand of a contig at most.
    counts = kept(usable.groupBy("contig", "_bucket").agg(F.count("*").alias("_n")), "buckets")
    below = counts.select("contig", "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"), F.sum("_n").over(by_contig).alias("_all"))
    inside = F.row_number().over(Window.partitionBy("contig", "_bucket").orderBy("pvalue", *keys))
    named = usable.join(below, ["contig", "_bucket"])
    hot = HOT if hot is None else hot
    if counts.where(F.col("_n") > hot).isEmpty():
        ranked = named.withColumn("_inside", inside)
    else:
        ranked = named.where(F.col("_n") <= hot).withColumn("_inside", inside)
        ranked = ranked.unionByName(ranged_ranks(named.where(F.col("_n") > hot), ["contig", "_bucket"], ["pvalue", *keys], "_inside"))
    return ranked.select(
        "contig",
        "position",
        "ref",
        "alt",
        F.round(-F.log10("pvalue"), 6).alias("pvalue_log10"),
        F.round(-F.log10((F.col("_below") + F.col("_inside") - F.lit(0.5)) / F.col("_all")), 6).alias("pvalue_expected_log10"),
    )


def significant_variants(df: DataFrame, phenotype: str | Column, ancestry: str | Column, threshold: float = 5e-8) -> DataFrame:
    """Q11: significant rows with the columns of the warehouse in front; given ones of these names are replaced, or named as columns."""
    extra = [c for c in STATS if c in df.columns]
    return df.where(F.col("pvalue") < threshold).select(
        F.lit(phenotype).alias("phenotype"),
        F.lit(ancestry).alias("ancestry"),
        "sequencing_type",
        g.xpos(F.col("contig"), F.col("position")).alias("xpos"),
        g.chr_prefixed(F.col("contig")).alias("contig"),
        F.col("position").cast("int").alias("position"),
        "ref",
        "alt",
        "pvalue",
        *extra,
    )


def locus_variants(df: DataFrame, regions: DataFrame, threshold: float = 5e-8, locus_threshold: float = 0.01, by: list[str] = ()) -> DataFrame:
    """Q5, Q7: variants of every region below the locus threshold, with -log10 p in single precision.

    Regions are made once and written, as the join reads them twice.  With ``by`` a
    region holds variants of its own group only.
    """
    usable = df.where((F.col("pvalue") > 0) & (F.col("pvalue") < locus_threshold))
    if by:
        unit = F.concat_ws("\x01", *[F.coalesce(c, F.lit("")) for c in by], "contig")
        met = interval_join(usable.withColumn("_unit", unit), kept(regions.select(unit.alias("contig"), "start", "end"), "regions"), contig="_unit").drop("_unit")
    else:
        met = interval_join(usable, kept(regions, "regions"))
    return met.withColumns(
        {
            "locus_id": g.locus_id(F.regexp_replace("contig", "chr", ""), F.col("start"), F.col("end")),
            "neg_log10_p": g.neg_log10_p_or_zero(F.col("pvalue")),
            "is_significant": F.col("pvalue") < threshold,
            "xpos": g.xpos(F.col("contig"), F.col("position")),
        }
    )


def batch_summary(pivoted: DataFrame) -> DataFrame:
    """Phenotypes of each ancestry by their inputs."""
    e, s = F.col("exome_uri").isNotNull(), F.col("genome_uri").isNotNull()
    return pivoted.groupBy("ancestry").agg(
        F.count("*").alias("n"),
        F.count_if(e & s).alias("both_inputs"),
        F.count_if(e & ~s).alias("exome_only"),
        F.count_if(~e & s).alias("genome_only"),
        F.count_if(F.col("gene_uri").isNotNull()).alias("with_genes"),
    )


def batch_plan(assets: DataFrame) -> DataFrame:
    """Q10: one row of each phenotype with its inputs and whether any is there."""
    return pivot_assets(assets).withColumn("planned", F.coalesce("exome_uri", "genome_uri", "gene_uri").isNotNull())


def pipeline(variants: DataFrame, genes: DataFrame | None, tests: DataFrame | None, notes: DataFrame | None, phenotype: str, ancestry: str, **options) -> dict[str, DataFrame]:
    """Q3, Q4: all tables of one phenotype, each a plan of its own over the same inputs."""
    threshold, window = options.get("threshold", 5e-8), options.get("window", 1_000_000)
    strategy = options.get("strategy", "clump")
    hits = significant_variants(variants, phenotype, ancestry, threshold)
    if notes is not None:
        # Notes are joined to the few hits, not to all variants.
        hits = hits.join(notes, ["contig", "position", "ref", "alt"], "left")
    near = None
    if tests is not None:
        near = burden.significant_genes(tests, options.get("gene_threshold", burden.GENE_THRESHOLD)).select("contig", "start", "end")
    # Two tables come from the loci.
    found = kept(loci.loci(variants, near, strategy, threshold, window, options.get("min_variants", 1)), "loci")
    out = {
        "significant_variants": hits,
        "loci": found.withColumns({"phenotype": F.lit(phenotype), "ancestry": F.lit(ancestry)}),
        "loci_variants": locus_variants(variants, found.select("contig", "start", "end"), threshold, options.get("locus_threshold", 0.01)),
        "plot_points": plot_points(variants, threshold),
    }
    if tests is not None:
        out["gene_associations"] = burden.gene_associations(tests, phenotype, ancestry, options.get("maf"))
    return out


def pipeline_of_many(variants: DataFrame, tests: DataFrame | None = None, notes: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """All tables of all phenotypes at once, each table one plan.

    ``variants`` and ``tests`` have ``phenotype`` and ``ancestry``.  Phenotypes share scans,
    shuffles and tasks; none is a job of its own, and a large one is split like any other
    data.  Significant rows, loci and regions are made once for all.
    """
    threshold, window = options.get("threshold", 5e-8), options.get("window", 1_000_000)
    strategy, by = options.get("strategy", "clump"), ["phenotype", "ancestry"]
    hits = significant_variants(variants, F.col("phenotype"), F.col("ancestry"), threshold)
    if notes is not None:
        hits = hits.join(notes, ["contig", "position", "ref", "alt"], "left")
    near = None
    if tests is not None:
        near = burden.significant_genes(tests, options.get("gene_threshold", burden.GENE_THRESHOLD), by=by).select(*by, "contig", "start", "end")
    found = kept(loci.loci(variants, near, strategy, threshold, window, options.get("min_variants", 1), by), "loci")
    out = {
        "significant_variants": hits,
        "loci": found,
        "loci_variants": locus_variants(variants, found.select(*by, "contig", "start", "end"), threshold, options.get("locus_threshold", 0.01), by),
        "plot_points": plot_points(variants, threshold, keep=by),
    }
    if tests is not None:
        out["gene_associations"] = burden.gene_associations(tests, F.col("phenotype"), F.col("ancestry"), options.get("maf"))
    return out
