"""Queries that write a table by a sink and read it by the source that belongs to it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.functions.predicates import KeyRange
from locusframe.operators import intervals as iv
from locusframe.operators import schema
from locusframe.plans import views as v
from locusframe.plans.registry import KEYS, query
from locusframe.sources import keyed, sinks, vcf, warehouse
from locusframe.sources.shared import place


@query("select contig, position, ref, alt, pvalue, k1, k2, k3, k4 from variants where contig = 'chr7' and position >= 300000")
def s2_keyed_round_trip(spark, sf):
    """A keyed table is written, and read where its key lies in a range."""
    path = place(spark, "keyed") + ".ht"
    keyed.write(v.variants(spark, sf).select("contig", "position", "ref", "alt", "pvalue", *KEYS), path, ["contig", "position"], partitions=8)
    return keyed.read(spark, path, [KeyRange.of("contig", "=", "chr7"), KeyRange.of("position", ">=", 300000)])


@query("select contig, position, ref, alt from variants order by contig, position, ref, alt limit 200")
def s3_keyed_ordered(spark, sf):
    path = place(spark, "keyed") + ".ht"
    keyed.write(v.variants(spark, sf).select("contig", "position", "ref", "alt"), path, ["contig", "position", "ref", "alt"], partitions=8)
    return keyed.read(spark, path, ordered=True).limit(200)


CALLS = "select contig, position, ref, alt, pvalue as qual, cast(k1 as varchar) as rsid, cast(k2 as integer) as depth, round(af, 4) as af, sequencing_type = 'exome' as known from variants"


def calls(spark, sf):
    rows = v.variants(spark, sf)
    return rows.select(
        F.struct("contig", "position").alias("locus"),
        F.array("ref", "alt").alias("alleles"),
        F.col("k1").cast("string").alias("rsid"),
        F.col("pvalue").alias("qual"),
        F.struct(F.col("k2").cast("int").alias("DP"), F.array(F.col("af")).alias("AF"), (F.col("sequencing_type") == "exome").alias("DB")).alias("info"),
    )


def flat(df):
    kept = [F.col("locus.contig"), F.col("locus.position"), F.get("alleles", 0).alias("ref"), F.get("alleles", 1).alias("alt"), "qual", "rsid"]
    return df.select(*kept, F.col("info.DP").alias("depth"), F.round(F.get("info.AF", 0).cast("double"), 4).alias("af"), F.col("info.DB").alias("known"))


@query(CALLS)
def k6_calls_round_trip(spark, sf):
    path = place(spark, "calls")
    vcf.write(calls(spark, sf), path, compression="gzip")
    return flat(vcf.read(spark, path))


@query(CALLS + " where contig = 'chr3' and position between 100000 and 400000")
def s8_calls_region(spark, sf):
    path = place(spark, "calls")
    vcf.write(calls(spark, sf), path)
    return flat(vcf.read(spark, path, intervals=[("chr3", 100_000, 400_000)]))


@query("select contig, count(*) as n, count(*) as n_in_order, 1 as n_parts from variants group by contig")
def s9_calls_by_contig(spark, sf):
    """Every contig lies in one partition, in order of place."""
    path = place(spark, "calls")
    vcf.write(calls(spark, sf), path)
    rows = vcf.read(spark, path, by_contig=True)
    seen = rows.select(F.col("locus.contig").alias("contig"), F.col("locus.position").alias("position"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    before = F.lag(F.struct("contig", "position")).over(Window.partitionBy("part").orderBy("at"))
    ordered = seen.withColumn("_before", before).withColumn("ok", F.coalesce((F.col("_before.contig") != F.col("contig")) | (F.col("_before.position") <= F.col("position")), F.lit(True)))
    return ordered.groupBy("contig").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_in_order"), F.count_distinct("part").cast("int").alias("n_parts"))


@query("select contig, position, pvalue, k1, k2, k3, k4, case when k1 % 3 <> 0 then af end as af from variants")
def k2_parquet_shards(spark, sf):
    path = place(spark, "shards")
    some = F.when(F.col("k1") % 3 != 0, F.col("af")).alias("af")
    sinks.parquet(v.variants(spark, sf).select("contig", "position", "pvalue", *KEYS, some), path, shards=3)
    return spark.read.parquet(path)


@query("select contig, k1, k2, k3, k4, case when k1 % 5 <> 0 then pvalue end as p, ref as first_allele from variants")
def k5_json_groups(spark, sf):
    """JSON lines in folders by contig; what is not a finite number becomes null."""
    path = place(spark, "json")
    rows = v.variants(spark, sf)
    p = F.when(F.col("k1") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("pvalue")).alias("p")
    sinks.ndjson(rows.select("contig", *KEYS, p, F.array("ref", "alt").alias("alleles")), path, group_by=["contig"])
    read = spark.read.schema("k1 long, k2 long, k3 long, k4 long, p double, alleles array<string>, contig string").json(path)
    return read.select("contig", *KEYS, "p", F.get("alleles", 0).alias("first_allele"))


@query("""loads as (select contig, 'chr' || '_' || (k3 % 50) as locus_id, max(pvalue) as lead_pvalue from variants group by 1, 2)
    select contig as phenotype, 'eur' as ancestry, locus_id, lead_pvalue from loads""")
def k13_warehouse_last_load(spark, sf):
    """Each key is loaded twice and shown once, as it was loaded last."""
    path = place(spark, "warehouse")
    loads = v.variants(spark, sf).groupBy(F.col("contig").alias("phenotype"), F.lit("eur").alias("ancestry"), F.concat(F.lit("chr_"), F.col("k3") % 50).alias("locus_id"))
    for best in (F.min, F.max):
        sinks.warehouse({"loci": loads.agg(best("pvalue").alias("lead_pvalue"))}, path)
    return sinks.read_warehouse(spark, path, "loci").select("phenotype", "ancestry", "locus_id", "lead_pvalue")


@query("""select contig, start + 1 as start, "end" from intervals where "end" > start""")
def s13_bed_file(spark, sf):
    path = place(spark, "regions") + ".bed"
    v.intervals(spark, sf).select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"))).write.text(path)
    return iv.read(spark, path)


@query("select count(*) as scanned, count(*) filter (k1 % 7 <> 0 and k2 <> 3) as valid, count(*) filter (k1 % 7 = 0 or k2 = 3) as invalid from variants")
def v5_schema_of_type(spark, sf):
    """A schema made of a type with a field that is always there, and elements that are, tells rows that lack them."""
    rows = v.variants(spark, sf).select("contig", F.when(F.col("k1") % 7 != 0, F.col("pvalue")).alias("p"), F.array("ref", F.when(F.col("k2") != 3, F.col("alt"))).alias("alleles"))
    wanted = T.StructType([T.StructField("contig", T.StringType()), T.StructField("p", T.DoubleType(), False), T.StructField("alleles", T.ArrayType(T.StringType(), False))])
    return schema.validation_counts(rows, schema.generate(wanted))


# Reading by place


def placed(spark, sf):
    """Variants as a keyed table with an index, by place and the rest of their key."""
    path = place(spark, "keyed") + ".ht"
    rows = v.variants(spark, sf).select(F.struct("contig", "position").alias("locus"), *KEYS, "pvalue")
    keyed.write(rows, path, ["locus", *KEYS], partitions=8)
    return path


@query("""select contig, position, k1, k2, k3, k4, pvalue from variants
    where contig = 'chr3' and position between 100000 and 140000 or contig = 'chr11' and position between 5 and 90000""")
def s16_keyed_spans(spark, sf):
    """Spans of a keyed table are entered by its index."""
    found = keyed.read(spark, placed(spark, sf), intervals=[("chr3", 100_000, 120_000), ("chr11", 5, 90_000), ("chr3", 110_000, 140_000), ("chr99", 1, 5)])
    return found.select("locus.contig", "locus.position", *KEYS, "pvalue")


@query("select contig, position, k1, k2, k3, k4, pvalue from variants where contig = 'chr5' order by position desc, k1 desc, k2 desc, k3 desc, k4 desc limit 1")
def j1_keyed_lookup(spark, sf):
    """The last row of a contig by its full key, down the index."""
    last = v.variants(spark, sf).where("contig = 'chr5'").agg(F.max(F.struct("position", *KEYS)).alias("k")).first().k
    key = {"locus__contig": "chr5", "locus__position": last.position, **{k: last[k] for k in KEYS}}
    return keyed.lookup(spark, placed(spark, sf), **key).select("locus.contig", "locus.position", *KEYS, "pvalue")


@query(CALLS)
def k6_calls_blocks(spark, sf):
    """Tasks write blocks of one file, which others read by ranges."""
    path = place(spark, "calls") + ".vcf.bgz"
    vcf.write(calls(spark, sf), path, compression="bgzf")
    return flat(vcf.read(spark, path))


@query(CALLS + " where contig = 'chr3' and position between 100000 and 400000 or contig = 'chr17' and position between 999000 and 1000000")
def s8_calls_by_index(spark, sf):
    """Regions by the index beside the file."""
    path = place(spark, "calls") + ".vcf.bgz"
    vcf.write(calls(spark, sf), path, compression="bgzf")
    return flat(vcf.read(spark, path, intervals=[("chr17", 999_000, 1_000_000), ("chr3", 100_000, 400_000), ("chr99", 1, 9)]))


@query("""loads as (select contig, 'chr' || '_' || (k3 % 50) as locus_id, k3 % 50 as part, min(pvalue) as least, max(pvalue) as most from variants group by all)
    select contig as phenotype, 'eur' as ancestry, locus_id, case when part < 20 then most else least end as lead_pvalue from loads""")
def k13_upsert_some(spark, sf):
    """A second load has some of the keys: their rows are replaced, others stay; the table is read after it was compacted."""
    path = place(spark, "warehouse")
    part = F.col("k3") % 50
    by = [F.col("contig").alias("phenotype"), F.lit("eur").alias("ancestry"), F.concat(F.lit("chr_"), part).alias("locus_id")]
    sinks.warehouse({"loci": v.variants(spark, sf).groupBy(*by).agg(F.min("pvalue").alias("lead_pvalue"))}, path)
    sinks.warehouse({"loci": v.variants(spark, sf).where(part < 20).groupBy(*by).agg(F.max("pvalue").alias("lead_pvalue"))}, path)
    warehouse.compact(spark, f"{path}/loci", 4)
    return sinks.read_warehouse(spark, path, "loci").select("phenotype", "ancestry", "locus_id", "lead_pvalue")
