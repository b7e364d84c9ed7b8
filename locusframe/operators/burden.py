"""Gene burden tests: best p per gene and group, significant tests and genes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P_COLUMNS = ("pvalue", "pvalue_burden", "pvalue_skat")
GENE_THRESHOLD = 2.5e-6


def valid_p(p: Column) -> Column:
    """Finite, above 0 and below 1."""
    return p.isNotNull() & ~F.isnan(p) & (p > 0.0) & (p < 1.0)


def valid(columns: tuple[str, ...] = P_COLUMNS) -> list[Column]:
    """Each p-value where it is valid, else null."""
    return [F.when(valid_p(F.col(c)), F.col(c)) for c in columns]


def long_tests(df: DataFrame, columns: tuple[str, ...] = P_COLUMNS, below: float = 1.0) -> DataFrame:
    """One row of each valid p-value below a bound: the keys, ``field``, its order and ``p``."""
    # Rows without any go before their values are spread.
    some = df.where(F.coalesce(F.least(*valid(columns)) < below, F.lit(False)))
    each = [F.struct(F.lit(i).alias("rank"), F.lit(c).alias("field"), v.alias("p")) for i, (c, v) in enumerate(zip(columns, valid(columns)))]
    out = some.withColumn("_t", F.explode(F.array(*each))).where(F.col("_t.p") < below)
    return out.select(*df.columns, F.col("_t.rank").alias("rank"), F.col("_t.field").alias("field"), F.col("_t.p").alias("p"))


def maf_text(maf: Column) -> Column:
    return F.format_string("%.4f", maf)


def best_by(df: DataFrame, keys: list[str], columns: tuple[str, ...] = P_COLUMNS) -> DataFrame:
    """Of each group the least valid p (``p``) and the order of its column (``rank``); groups without one go.

    The columns' least values are plain numbers, which hash and combine before the shuffle.
    """
    least = df.groupBy(*keys).agg(*[F.min(v).alias(f"_v{i}") for i, v in enumerate(valid(columns))])
    values = [F.col(f"_v{i}") for i in range(len(columns))]
    p = F.least(*values)
    rank = reduce(lambda a, i: F.when(values[i] == p, i).otherwise(a), reversed(range(len(columns))), F.lit(len(columns)))
    return least.select(*keys, p.alias("p"), rank.alias("rank")).where("p is not null")


def best_per_gene(df: DataFrame) -> DataFrame:
    """A5: the least p of a gene and what gave it; ties by field, annotation and frequency."""
    key = F.struct("p", "rank", "annotation", "max_maf")
    return best_by(df, ["gene_id", "annotation", "max_maf"]).groupBy("gene_id").agg(F.min(key).alias("b")).select(
        "gene_id",
        F.col("b.p").alias("best_p"),
        F.concat_ws(":", F.col("b.annotation"), F.element_at(F.array(*map(F.lit, P_COLUMNS)), F.col("b.rank") + 1), maf_text(F.col("b.max_maf"))).alias("best_test"),
    )


def best_per_group(df: DataFrame) -> DataFrame:
    """The least p of each gene, annotation and frequency."""
    keys = ["gene_id", "annotation", "max_maf"]
    return best_by(df, keys).select(*keys, F.col("p").alias("best_p"))


def significant_tests(df: DataFrame, threshold: float = GENE_THRESHOLD, best_only: bool = False) -> DataFrame:
    """Significant p-values of a gene; of each row all of them, or the best."""
    if best_only:
        values = valid()
        p = F.least(*values)
        field = reduce(lambda a, i: F.when(values[i] == p, P_COLUMNS[i]).otherwise(a), reversed(range(len(values))), F.lit(None))
        return df.where(F.coalesce(p < threshold, F.lit(False))).select("gene_id", "annotation", "max_maf", field.alias("field"), p.alias("p"))
    return long_tests(df, below=threshold).select("gene_id", "annotation", "max_maf", "field", "p")


def significant_genes(df: DataFrame, threshold: float = GENE_THRESHOLD, margin: int = 100_000, by: list[str] = ()) -> DataFrame:
    """Genes with a significant test (within ``by``): symbol, place widened by the margin, least p, number of tests."""
    values = valid()
    p = F.least(*values)
    tests = reduce(lambda a, b: a + b, [F.when(v < threshold, 1).otherwise(0) for v in values])
    hits = df.where(F.coalesce(p < threshold, F.lit(False)))
    # Numbers first, by a gene's names too, so that they hash; then the few rows of a gene.
    some = hits.groupBy(*by, "gene_id", "gene_symbol", "contig").agg(F.min("position").alias("at"), F.min(p).alias("p"), F.sum(tests).alias("n"))
    return some.groupBy(*by, "gene_id").agg(
        F.min("gene_symbol").alias("gene_symbol"),
        F.min("contig").alias("contig"),
        F.greatest(F.lit(1), F.min("at") - margin).cast("long").alias("start"),
        (F.min("at") + margin).cast("long").alias("end"),
        F.min("p").alias("best_p"),
        F.sum("n").alias("n_tests"),
    )


def top_hit(df: DataFrame, keys: list[str], p: str = "pvalue") -> DataFrame:
    """The row of least p; nulls are passed over, ties by the keys."""
    usable = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    return usable.orderBy(p, *keys).limit(1)


def maf_filter(df: DataFrame, maf: float, tolerance: float = 1e-9) -> DataFrame:
    """F18; a missing frequency counts as 0."""
    return df.where(F.abs(F.coalesce("max_maf", F.lit(0.0)) - maf) <= tolerance)


def gene_associations(df: DataFrame, phenotype: str | Column, ancestry: str | Column, maf: float | None = None) -> DataFrame:
    """Q8: the gene table of one phenotype, or of those that columns name."""
    from locusframe.functions.genomics import chr_prefixed, xpos

    some = df if maf is None else maf_filter(df, maf)
    return some.select(
        "gene_id", "gene_symbol", "annotation", F.coalesce("max_maf", F.lit(0.0)).alias("max_maf"),
        F.lit(phenotype).alias("phenotype"), F.lit(ancestry).alias("ancestry"),  # a column stays one
        "pvalue", "pvalue_burden", "pvalue_skat", "beta_burden", "mac",
        chr_prefixed(F.col("contig")).alias("contig"), F.col("position").cast("int").alias("gene_start_position"),
        xpos(F.col("contig"), F.col("position")).alias("xpos"),
    )
