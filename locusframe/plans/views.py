"""Genomics-shaped views over the benchmark tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = """
    select concat('chr', cast(1 + l_suppkey % 22 as string)) as contig,
           cast(1 + (l_partkey * 104729 + l_orderkey * 7919 + l_linenumber * 31) % 1000000 as int) as position,
           l_returnflag as ref, l_linestatus as alt,
           (l_discount + 0.001D) * (l_tax + 0.0001D) * (l_quantity / 50.0D) * (l_quantity / 50.0D) * (l_quantity / 50.0D) as pvalue,
           l_discount - 0.05D as beta, l_tax + 0.01D as se, l_quantity / 100.0D as af,
           case when l_linenumber <= 3 then 'exome' else 'genome' end as sequencing_type,
           l_orderkey as k1, l_linenumber as k2, l_partkey as k3, l_suppkey as k4
    from lineitem
"""
INTERVALS = """
    select concat('chr', cast(1 + s_suppkey % 22 as string)) as contig,
           cast(1 + (s_suppkey * 7919) % 700000 as bigint) as start,
           cast(1 + (s_suppkey * 7919) % 700000 + 100000 + s_suppkey * 1500 as bigint) as `end`
    from supplier
"""
GENES = """
    select concat('G', cast(p_partkey as string)) as gene_id, p_name as symbol,
           concat('chr', cast(1 + p_partkey % 22 as string)) as contig,
           cast(1 + (p_partkey * 104729) % 900000 as bigint) as start,
           cast(1 + (p_partkey * 104729) % 900000 + 1000 + p_size * 200 as bigint) as `end`
    from part
"""
BURDEN = """
    select concat('G', cast(p_partkey as string)) as gene_id, p_name as gene_symbol, p_type as annotation,
           case when p_size <= 15 then 0.001D when p_size <= 30 then 0.01D else 0.05D end as max_maf,
           nullif((l_discount + 0.001D) * (l_tax + 0.0001D) * (l_quantity / 50.0D), 0.0001D * 0.001D) as pvalue,
           (l_discount + 0.002D) * (l_tax + 0.0002D) * (l_quantity / 50.0D) as pvalue_burden,
           case when l_linenumber = 7 then null else (l_discount + 0.0005D) * (l_tax + 0.001D) * (l_quantity / 50.0D) end as pvalue_skat,
           l_discount - 0.05D as beta_burden, l_orderkey % 1000 as mac,
           concat('chr', cast(1 + p_partkey % 22 as string)) as contig,
           cast(1 + (p_partkey * 104729) % 900000 as bigint) as position
    from lineitem join part on l_partkey = p_partkey
"""
ANNOTATIONS = """
    select contig, position, ref, alt, min(p_name) as gene_symbol, min(p_type) as consequence
    from variants join part on k3 = p_partkey group by contig, position, ref, alt
"""
TELEMETRY = """
    select event_id, user_id % 8 as worker_id, ts, value, event_type,
           value as cpu_percent, (value * 7) % 100 as memory_percent, value * 12 as received_mb, value * 5 as sent_mb
    from events
"""
ASSETS = """
    select substring(o_orderpriority, 1, 1) as ancestry, o_custkey as analysis_id,
           case when o_orderstatus = 'P' then 'gene' else 'variant' end as asset_type,
           case when o_orderstatus = 'F' then 'exome' when o_orderstatus = 'O' then 'genome' end as sequencing_type,
           concat('t/', cast(o_orderkey as string)) as uri
    from orders
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    """A view's text over the tables it names, without registering anything."""
    found = {t: table(spark, sf_dir, t) for t in TABLES if t in text} | given
    return spark.sql(braced(text, found), **found)


def braced(text: str, names) -> str:
    import re

    return re.sub(r"\b(from|join)\s+(" + "|".join(names) + r")\b", r"\1 {\2}", text)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, VARIANTS)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, INTERVALS)


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, GENES)


def burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, BURDEN)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, ANNOTATIONS, variants=variants(spark, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, TELEMETRY)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, ASSETS)


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with locus and alleles as nested fields, some of them null."""
    locus = F.when(F.col("k1") % 11 != 0, F.struct("contig", "position"))
    return variants(spark, sf_dir).select(
        locus.alias("locus"), F.array("ref", "alt").alias("alleles"), F.expr("nullif(af, 0.25D)").alias("af"), "pvalue", "k1", "k2", "k3", "k4"
    )


def duck(text: str) -> str:
    """The text for DuckDB."""
    import re

    text = re.sub(r"(\d)D\b", r"\1::double", text).replace("`end`", '"end"').replace("as string)", "as varchar)")
    return text


#: Starts every SQL twin; unused views cost nothing.
PRELUDE = "with recursive " + ", ".join(
    f"{name} as ({duck(text)})"
    for name, text in (
        ("variants", VARIANTS), ("intervals", INTERVALS), ("genes", GENES), ("burden", BURDEN),
        ("annotations", ANNOTATIONS), ("telemetry", TELEMETRY), ("assets", ASSETS),
    )
)
