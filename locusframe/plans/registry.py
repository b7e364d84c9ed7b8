"""One query of each operator over the benchmark tables, with its SQL twin where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import genomics as g
from locusframe.functions import predicates as pr
from locusframe.operators import burden as b
from locusframe.operators import intervals as iv
from locusframe.operators import joins as j
from locusframe.operators import loci, manhattan, render, sampling, schema, stats, telemetry
from locusframe.plans import views as v
from locusframe.plans.views import PRELUDE

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
KEYS = ["k1", "k2", "k3", "k4"]
P_GENE = 1e-5
WINDOW = 20_000


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir), with SQL that goes on after the views."""

    def register(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = PRELUDE + (" " if sql.lstrip().lower().startswith("select") else ", ") + sql
        return f

    return register


def queries():
    from locusframe.plans import round_trips  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql():
    from locusframe.plans import round_trips  # noqa: F401

    return dict(_SQL)


SEMI = "exists (select 1 from intervals i where i.contig = x.contig and x.position between i.start and i.\"end\")"


# Filters and predicates


@query(f"""select contig, position, ref, alt, pvalue, k1, k2, k3, k4 from variants x
    where pvalue < 1e-6 and af >= 0.02 and {SEMI} order by pvalue, k1, k2, k3, k4 limit 500""")
def q1_flagship_filter_interval(spark, sf):
    rows = pr.where(v.variants(spark, sf), "pvalue < 1e-6", "af >= 0.02")
    met = j.interval_semi_join(rows, v.intervals(spark, sf))
    return met.select("contig", "position", "ref", "alt", "pvalue", *KEYS).orderBy("pvalue", *KEYS).limit(500)


@query("select k1, k2, k3, k4, position from variants where contig = 'chr7'")
def f5_point(spark, sf):
    return pr.in_ranges(v.variants(spark, sf), pr.KeyRange.of("contig", "=", "chr7")).select(*KEYS, "position")


@query("select k1, k2, k3, k4, position from variants where position between 1000 and 50000")
def f5_range_inclusive(spark, sf):
    return pr.in_ranges(v.variants(spark, sf), pr.KeyRange.between("position", 1000, 50000)).select(*KEYS, "position")


@query("select k1, k2, k3, k4, position from variants where position > 1000 and position < 50000")
def f5_range_exclusive(spark, sf):
    return pr.in_ranges(v.variants(spark, sf), pr.KeyRange.between("position", 1000, 50000, inclusive=False)).select(*KEYS, "position")


@query("select k1, k2, k3, k4, position from variants where position >= 990000 and af < 0.1")
def f5_open_bounds(spark, sf):
    return pr.in_ranges(v.variants(spark, sf), pr.KeyRange.of("position", ">=", 990000), pr.KeyRange.of("af", "<", 0.1)).select(*KEYS, "position")


@query("select k1, k2, k3, k4, pvalue from variants where contig = 'chr3' and position >= 500000 and k1 % 11 <> 0")
def f6_nested_path(spark, sf):
    return pr.where(v.nested(spark, sf), "locus.contig=chr3", "locus.position gte 500000").select(*KEYS, "pvalue")


@query("select k1, k2, k3, k4 from variants where coalesce(nullif(af, 0.25) < 0.05, true)")
def f6_null_compat(spark, sf):
    return pr.where(v.nested(spark, sf), "af < 0.05", mode="compat").select(*KEYS)


@query("select k1, k2, k3, k4 from variants where nullif(af, 0.25) < 0.05")
def f6_null_sql(spark, sf):
    return pr.where(v.nested(spark, sf), "af < 0.05").select(*KEYS)


@query("select k1, k2, k3, k4 from variants")
def f6_type_mismatch_compat(spark, sf):
    """An int literal against a double column filters nothing in this mode."""
    return pr.where(v.nested(spark, sf), "af > 1", mode="compat").select(*KEYS)


@query("select k1, k2, k3, k4 from variants where contig = 'chr3' and k1 % 11 <> 0 and coalesce(nullif(af, 0.25) <= 0.3, true)")
def f7_calls_mode(spark, sf):
    """A null above a field drops the row, a null field is equal to the literal, and so is one of another type."""
    return pr.where(v.nested(spark, sf), "locus.contig = chr3", "af <= 0.3", "pvalue >= 1", mode="calls").select(*KEYS)


@query("select k1, k2, k3, k4, beta from variants where contig <> 'chr1' and beta <= -0.04")
def f1_where_parser(spark, sf):
    return pr.where(v.variants(spark, sf), "contig != chr1 AND beta <= -4e-2").select(*KEYS, "beta")


@query("""select contig, start + 1 as start, "end" from intervals where "end" > start""")
def f11_bed_to_inclusive(spark, sf):
    return iv.bed_to_inclusive(v.intervals(spark, sf))


MERGE = """ordered as (select *, max("end") over (partition by contig order by start, "end" rows between unbounded preceding and 1 preceding) as reach from {src}),
    flagged as (select *, sum(case when reach is null or start > reach + {gap} then 1 else 0 end) over (partition by contig order by start, "end" rows unbounded preceding) as island from ordered)
    select contig, min(start) as start, max("end") as "end" from flagged group by contig, island"""


@query(MERGE.format(src="intervals", gap=1))
def f12_interval_merge(spark, sf):
    return iv.merge(v.intervals(spark, sf))


@query("""both_ as (select contig, start, "end" from intervals union all select contig, start, "end" from genes), """ + MERGE.format(src="both_", gap=1))
def f13_interval_union(spark, sf):
    return iv.union(v.intervals(spark, sf), v.genes(spark, sf))


@query("""select a.contig, a.start, a."end", b.start as g_start, b."end" as g_end from intervals a join genes b on a.contig = b.contig and a.start <= b."end" and a."end" >= b.start""")
def f9_interval_overlaps(spark, sf):
    right = v.genes(spark, sf).select(F.col("contig").alias("g_contig"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    return j.overlap_join(v.intervals(spark, sf), right).select("contig", "start", "end", "g_start", "g_end")


@query("select k1, k2, k3, k4, ref from variants where ref = 'A' and alt = 'F'")
def f16_allele_filter(spark, sf):
    return j.allele_filter(v.nested(spark, sf), "A", "F").select(*KEYS, F.get("alleles", 0).alias("ref"))


@query("select gene_id, annotation, pvalue, mac from burden where abs(coalesce(max_maf, 0) - 0.01) <= 1e-9")
def f18_maf(spark, sf):
    return b.maf_filter(v.burden(spark, sf), 0.01).select("gene_id", "annotation", "pvalue", "mac")


@query("select k1, k2, k3, k4, pvalue from variants where pvalue < 5e-8")
def f19_significant(spark, sf):
    return v.variants(spark, sf).where(F.col("pvalue") < 5e-8).select(*KEYS, "pvalue")


@query(f"select k1, k2, k3, k4, pvalue from variants x where pvalue < 1e-7 or {SEMI}")
def f20_interest(spark, sf):
    rows = v.variants(spark, sf)
    low = F.col("pvalue") < 1e-7
    return rows.where(low).unionByName(j.interval_semi_join(rows.where(~low), v.intervals(spark, sf))).select(*KEYS, "pvalue")


@query("select gene_id, pvalue from burden where pvalue > 0 and pvalue <= 1")
def f21_valid_p(spark, sf):
    return v.burden(spark, sf).where(g.usable_p(F.col("pvalue"))).select("gene_id", "pvalue")


@query("select contig || '-' || position || '-' || ref || '-' || alt as variant_id, beta, se, af, round(-log10(pvalue), 6) as neg_log10_p from variants where pvalue < 1e-6")
def f22_project_hits(spark, sf):
    rows = v.variants(spark, sf).select("contig", "position", "ref", "alt", "pvalue", F.col("beta").alias("BETA"), F.col("se").alias("SE"), F.col("af").alias("AF_Allele2"))
    hits = manhattan.association_rows(rows).where(F.col("pvalue") < 1e-6)
    return hits.select(g.variant_id(*[F.col(c) for c in ("contig", "position", "ref", "alt")]).alias("variant_id"), "beta", "se", "af", F.round("neg_log10_p", 6).alias("neg_log10_p"))


@query("select k1, k2, k3, k4, contig from variants where contig in ('chr1', 'chr6', 'chr17')")
def f24_chrom(spark, sf):
    return v.variants(spark, sf).where(F.col("contig").isin(*[f"chr{c}" for c in "1,6,17".split(",")])).select(*KEYS, "contig")


# Lookups and joins


@query("select position, ref, alt, pvalue from variants where k1 = 10 and k2 = 1")
def j1_point_lookup(spark, sf):
    return j.point_lookup(v.variants(spark, sf), k1=10, k2=1).select("position", "ref", "alt", "pvalue")


@query("select k1, k2, k3, k4 from variants where contig = 'chr5' and position between 1 and 100000 and ref = 'R' and alt = 'F'")
def j12_variant_alleles(spark, sf):
    rows = j.point_lookup(v.variants(spark, sf), contig="chr5", ref="R", alt="F")
    return rows.where(F.col("position").between(1, 100000)).select(*KEYS)


@query("select x.k1, x.k2, x.k3, x.k4, a.gene_symbol, a.consequence from (select * from variants where pvalue < 1e-5) x left join annotations a on x.contig = a.contig and x.position = a.position and x.ref = a.ref and x.alt = a.alt and a.consequence <> 'ECONOMY'")
def j2_merge_left(spark, sf):
    rows = v.variants(spark, sf).where("pvalue < 1e-5")
    notes = v.annotations(spark, sf).where("consequence <> 'ECONOMY'")
    return j.annotate(rows, notes, ["contig", "position", "ref", "alt"], ["gene_symbol", "consequence"]).select(*KEYS, "gene_symbol", "consequence")


@query("""l as (select *, row_number() over (partition by contig, position order by k1, k2, k3, k4) as rn from variants where sequencing_type = 'exome'),
    r as (select contig, position, pvalue as p2, row_number() over (partition by contig, position order by pvalue, k1, k2, k3, k4) as rn from variants where sequencing_type = 'genome')
    select k1, k2, k3, k4, p2 from l left join r using (contig, position, rn)""")
def j2_merge_left_pairing(spark, sf):
    rows = v.variants(spark, sf)
    left = rows.where("sequencing_type = 'exome'").select("contig", "position", *KEYS)
    right = rows.where("sequencing_type = 'genome'").select("contig", "position", F.col("pvalue").alias("p2"), *[F.col(k).alias(f"r_{k}") for k in KEYS])
    out = j.pair_left_join(left, right, ["contig", "position"], [F.col(k) for k in KEYS], [F.col("p2"), *[F.col(f"r_{k}") for k in KEYS]])
    return out.select(*KEYS, "p2")


@query(f"select k1, k2, k3, k4, contig, position from variants x where {SEMI}")
def j3_interval_semi_join(spark, sf):
    return j.interval_semi_join(v.variants(spark, sf), v.intervals(spark, sf)).select(*KEYS, "contig", "position")


@query("""select x.k1, x.k2, x.k3, x.k4, i.start, i."end" from variants x join intervals i on i.contig = x.contig and x.position between i.start and i."end" """)
def j4_interval_inner_binned(spark, sf):
    return j.interval_join(v.variants(spark, sf), v.intervals(spark, sf)).select(*KEYS, "start", "end")


@query("""select g.gene_id, i.start, i."end" from intervals i join genes g on g.contig = i.contig and g.start <= i."end" and g."end" >= i.start""")
def j6_gene_overlap(spark, sf):
    right = v.genes(spark, sf).select("gene_id", F.col("contig").alias("g_contig"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    return j.overlap_join(v.intervals(spark, sf), right).select("gene_id", "start", "end")


@query("""firsts as (select symbol, min(cast(substr(gene_id, 2) as bigint)) as n from genes group by symbol)
    select a.contig, a.position, a.ref, a.alt, 'G' || f.n as gene_id from annotations a join firsts f on f.symbol = a.gene_symbol""")
def j7_gene_symbol(spark, sf):
    number = F.substring("gene_id", 2, 20).cast("long")
    firsts = v.genes(spark, sf).groupBy(F.col("symbol").alias("gene_symbol")).agg(F.min_by("gene_id", number).alias("gene_id"))
    return v.annotations(spark, sf).join(firsts, "gene_symbol").select("contig", "position", "ref", "alt", "gene_id")


@query("""select x.k1, x.k2, x.k3, x.k4, a.gene_symbol from variants x left join annotations a on x.contig = a.contig and x.position = a.position and x.ref = a.ref and x.alt = a.alt where x.pvalue < 5e-8""")
def j8_annotate(spark, sf):
    hits = v.variants(spark, sf).where(F.col("pvalue") < 5e-8)
    return j.annotate(hits, v.annotations(spark, sf), ["contig", "position", "ref", "alt"], ["gene_symbol"], few=True).select(*KEYS, "gene_symbol")


@query("""select x.k1, x.k2, x.k3, x.k4, case when a.gene_symbol is not null then '{"gene_symbol":"' || a.gene_symbol || '","consequence":"' || a.consequence || '"}' end as notes
    from variants x left join annotations a on x.contig = a.contig and x.position = a.position and x.ref = a.ref and x.alt = a.alt where x.pvalue < 5e-8""")
def j9_hit_annotator(spark, sf):
    hits = v.variants(spark, sf).where(F.col("pvalue") < 5e-8)
    return j.annotate(hits, v.annotations(spark, sf), ["contig", "position", "ref", "alt"], ["gene_symbol", "consequence"], as_json="notes", few=True).select(*KEYS, "notes")


@query("merged as (" + "select * from (with " + MERGE.format(src="intervals", gap=0) + ")" + """),
    ranked as (select m.contig, m.start, m."end", x.position, x.ref, x.alt, x.pvalue,
        row_number() over (partition by m.contig, m.start, m."end" order by x.pvalue, x.position, x.ref, x.alt) as rn
        from variants x join merged m on m.contig = x.contig and x.position between m.start and m."end")
    select contig, start, "end", position, ref, alt, pvalue from ranked where rn = 1""")
def j10_lead_variant(spark, sf):
    rows = v.variants(spark, sf).select("contig", "position", "ref", "alt", "pvalue")
    return j.lead_in_regions(rows, iv.merge(v.intervals(spark, sf), adjacent=False))


@query(f"select k1, k2, k3, k4 from variants x where {SEMI}")
def j11_multi_interval(spark, sf):
    return j.in_any(v.variants(spark, sf), v.intervals(spark, sf)).select(*KEYS)


@query("""select ancestry, analysis_id, max(case when asset_type = 'variant' and sequencing_type = 'exome' then uri end) as exome_uri,
    max(case when asset_type = 'variant' and sequencing_type = 'genome' then uri end) as genome_uri,
    max(case when asset_type = 'gene' then uri end) as gene_uri from assets group by ancestry, analysis_id""")
def j13_asset_pivot(spark, sf):
    return j.pivot_assets(v.assets(spark, sf))


@query("select distinct ancestry, analysis_id from assets where (ancestry, analysis_id) not in (select ancestry, analysis_id from assets where asset_type = 'gene')")
def c5_exclude_completed(spark, sf):
    keys = ["ancestry", "analysis_id"]
    assets = v.assets(spark, sf)
    return j.exclude_completed(assets.select(*keys).distinct(), assets.where("asset_type = 'gene'").select(*keys).distinct(), keys)


# Aggregations


@query("select count(*) as n from lineitem")
def a1_count(spark, sf):
    return v.table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


def _leaf(path: str, expr: str) -> str:
    return f"select '{path}' as path, {expr} as value from orders"


A2_LEAVES = " union all ".join(
    [
        _leaf("o_orderkey", "cast(o_orderkey as varchar)"),
        _leaf("who.custkey", "cast(o_custkey as varchar)") + " where o_orderkey % 7 <> 0",
        _leaf("who.status", "o_orderstatus") + " where o_orderkey % 7 <> 0",
        "select 'who' as path, cast(null as varchar) as value from orders where o_orderkey % 7 = 0",
        _leaf("o_totalprice", "printf('%.6f', o_totalprice)"),
        _leaf("tags", "o_orderstatus"),
        _leaf("tags", "o_orderpriority"),
    ]
)


@query(f"""leaves as ({A2_LEAVES}), totals as (
    select path, count(*) as count, count(*) - count(value) as null_count, min(value) as min, max(value) as max from leaves group by path),
    few as (select path, list(value order by value) as distinct_sample from (
        select path, value, row_number() over (partition by path order by value) as rn from (select distinct path, value from leaves where value is not null)) where rn <= 10 group by path)
    select t.path, t.count, t.null_count, t.min, t.max, coalesce(f.distinct_sample, []) as distinct_sample from totals t left join few f using (path)""")
def a2_field_stats(spark, sf):
    orders = v.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"))).alias("who"),
        "o_totalprice",
        F.array("o_orderstatus", "o_orderpriority").alias("tags"),
    )
    return stats.field_statistics(orders)


@query("select count(o_totalprice) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 4) as std_dev from orders")
def a4_size_stats(spark, sf):
    out = stats.partition_sizes(v.table(spark, sf, "orders"), "o_totalprice")
    return out.select("n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), F.round("std_dev", 4).alias("std_dev"))


@query("select contig, count(*) as n, count(*) filter (sequencing_type = 'exome') as exome_count, count(*) filter (sequencing_type = 'genome') as genome_count from variants group by contig")
def a10_counts(spark, sf):
    kind = F.col("sequencing_type")
    return stats.counts_by(v.variants(spark, sf), ["contig"], {"exome_count": kind == "exome", "genome_count": kind == "genome"})


@query("select contig, min(position) as min_position, max(position) as max_position, round(-log10(min(pvalue)), 6) as max_neg_log10_p from variants group by contig")
def a11_extents(spark, sf):
    return stats.extents(v.variants(spark, sf))


PIVOTED = """pivoted as (select ancestry, analysis_id, max(case when asset_type = 'variant' and sequencing_type = 'exome' then uri end) as e,
    max(case when asset_type = 'variant' and sequencing_type = 'genome' then uri end) as g, max(case when asset_type = 'gene' then uri end) as b from assets group by ancestry, analysis_id)"""


@query(PIVOTED + """ select ancestry, count(*) as n, count(*) filter (e is not null and g is not null) as both_inputs, count(*) filter (e is not null and g is null) as exome_only,
    count(*) filter (e is null and g is not null) as genome_only, count(*) filter (b is not null) as with_genes from pivoted group by ancestry""")
def a12_batch_summary(spark, sf):
    return manhattan.batch_summary(j.pivot_assets(v.assets(spark, sf)))


@query("select 'position' as field, count(*) as rows, 4.0::double as avg_bytes, 4 as min_bytes, 4 as max_bytes from variants union all select 'contig', count(*), avg(4 + strlen(contig)), min(4 + strlen(contig)), max(4 + strlen(contig)) from variants union all select '*', count(*), avg(8 + strlen(contig)), min(8 + strlen(contig)), max(8 + strlen(contig)) from variants")
def a13_row_sizes(spark, sf):
    out = stats.row_sizes(v.variants(spark, sf).select("contig", "position"), fraction=None)
    return out


TESTS = """tests as (select gene_id, gene_symbol, annotation, max_maf, contig, position, 0 as rank, 'pvalue' as field, pvalue as p from burden
    union all select gene_id, gene_symbol, annotation, max_maf, contig, position, 1, 'pvalue_burden', pvalue_burden from burden
    union all select gene_id, gene_symbol, annotation, max_maf, contig, position, 2, 'pvalue_skat', pvalue_skat from burden),
    valid as (select * from tests where p > 0 and p < 1)"""


@query(TESTS + """, best as (select *, row_number() over (partition by gene_id order by p, rank, annotation, max_maf) as rn from valid)
    select gene_id, p as best_p, annotation || ':' || field || ':' || printf('%.4f', max_maf) as best_test from best where rn = 1""")
def a5_gene_best_p(spark, sf):
    return b.best_per_gene(v.burden(spark, sf))


@query(TESTS + " select gene_id, annotation, max_maf, min(p) as best_p from valid group by gene_id, annotation, max_maf")
def a6_group_best_p(spark, sf):
    return b.best_per_group(v.burden(spark, sf))


@query(TESTS + f" select gene_id, annotation, max_maf, field, p from valid where p < {P_GENE}")
def a7_sig_tests(spark, sf):
    return b.significant_tests(v.burden(spark, sf), P_GENE)


@query(f"""rows_ as (select gene_id, annotation, max_maf, [{{'p': pvalue, 'rank': 0}}, {{'p': pvalue_burden, 'rank': 1}}, {{'p': pvalue_skat, 'rank': 2}}] as t from burden),
    best as (select gene_id, annotation, max_maf, list_min(list_filter(t, lambda x: x.p > 0 and x.p < 1)) as m from rows_)
    select gene_id, annotation, max_maf, ['pvalue', 'pvalue_burden', 'pvalue_skat'][m.rank + 1] as field, m.p as p from best where m.p < {P_GENE}""")
def a7_sig_tests_best(spark, sf):
    return b.significant_tests(v.burden(spark, sf), P_GENE, best_only=True)


@query(TESTS + f""" select gene_id, min(gene_symbol) as gene_symbol, min(contig) as contig, greatest(1, min(position) - 100000) as start, min(position) + 100000 as "end",
    min(p) as best_p, count(*) as n_tests from valid where p < {P_GENE} group by gene_id""")
def a8_sig_genes(spark, sf):
    return b.significant_genes(v.burden(spark, sf), P_GENE)


@query("select contig, position, ref, alt, pvalue from variants where pvalue is not null order by pvalue, k1, k2, k3, k4 limit 1")
def a9_top_hit(spark, sf):
    return b.top_hit(v.variants(spark, sf), KEYS).select("contig", "position", "ref", "alt", "pvalue")


RULES = "(position >= 1000) and (ref in ('A', 'R')) and regexp_matches(contig, '^chr[0-9]+$') and (af <= 0.4)"


@query(f"select count(*) as scanned, count(*) filter ({RULES}) as valid, count(*) filter (not ({RULES})) as invalid from variants")
def a14_validation(spark, sf):
    return schema.validation_counts(v.variants(spark, sf), SCHEMA_RULES)


SCHEMA_RULES = {
    "type": "object",
    "required": ["contig", "position"],
    "properties": {
        "contig": {"type": "string", "pattern": "^chr[0-9]+$"},
        "position": {"type": "integer", "minimum": 1000},
        "ref": {"type": "string", "enum": ["A", "R"]},
        "af": {"type": ["number", "null"], "maximum": 0.4},
    },
}


@query("""select k1, k2, k3, k4, list_filter([case when not regexp_matches(contig, '^chr[0-9]+$') then 'contig: pattern' end, case when position < 1000 then 'position: minimum' end,
    case when ref not in ('A', 'R') then 'ref: enum' end, case when af > 0.4 then 'af: maximum' end], lambda e: e is not null) as errors from variants""")
def v1_schema_rules(spark, sf):
    return schema.validate(v.variants(spark, sf), SCHEMA_RULES).select(*KEYS, "errors")


# Windows, order, limits, samples, unions


#: Each step takes the best hit left of every contig and what lies within the window; the rest goes on.
CLUMPS = f"""rest as (
        select 0 as step, contig, position, ref, alt, pvalue, sequencing_type from variants where pvalue < 5e-8
        union all
        select step + 1, contig, position, ref, alt, pvalue, sequencing_type from (
            select *, first_value(position) over (partition by contig order by pvalue, position, ref, alt) as lead_at from rest)
        where abs(position - lead_at) > {WINDOW}
    ), placed as (
        select *, first_value(position) over w as lead_at, row_number() over w as rn from rest window w as (partition by step, contig order by pvalue, position, ref, alt)
    ), clumps as (
        select contig, max(position) filter (rn = 1) as lead_position, max(ref) filter (rn = 1) as lead_ref, max(alt) filter (rn = 1) as lead_alt,
               max(pvalue) filter (rn = 1) as lead_pvalue, count(*) filter (abs(position - lead_at) <= {WINDOW}) as n_variants
        from placed group by step, contig)"""


@query(CLUMPS + f""" select *, cast(greatest(1, lead_position - {WINDOW}) as int) as start, cast(lead_position + {WINDOW} as int) as "end" from clumps""")
def w1_clump(spark, sf):
    return loci.clump(v.variants(spark, sf), threshold=5e-8, window=WINDOW)


@query(CLUMPS.replace("partition by contig", "partition by sequencing_type, contig").replace("partition by step, contig", "partition by step, sequencing_type, contig").replace(
    "clumps as (\n        select contig,", "clumps as (\n        select sequencing_type, contig,").replace("group by step, contig", "group by step, sequencing_type, contig")
    + f""" select *, cast(greatest(1, lead_position - {WINDOW}) as int) as start, cast(lead_position + {WINDOW} as int) as "end" from clumps""")
def w1_clump_by_group(spark, sf):
    """Clumps of each sequencing type, all in one job."""
    return loci.clump(v.variants(spark, sf), threshold=5e-8, window=WINDOW, by=["sequencing_type"])


HITS = f"""reach as (select contig, greatest(1, position - {WINDOW}) as start, position + {WINDOW} as "end" from variants where pvalue < 5e-8), """


@query(MERGE.format(src="intervals", gap=0))
def w2_gap_merge(spark, sf):
    return loci.merge_regions(v.intervals(spark, sf))


@query(HITS + MERGE.format(src="reach", gap=0))
def w3_expand_merge(spark, sf):
    return loci.expand_and_merge(v.variants(spark, sf).where(F.col("pvalue") < 5e-8), WINDOW)


@query(HITS + MERGE.format(src="reach", gap=1))
def w4_window_regions(spark, sf):
    return loci.expand_and_merge(v.variants(spark, sf).where(F.col("pvalue") < 5e-8), WINDOW, adjacent=True)


@query("select contig, count(*) as n, row_number() over (order by coalesce(try_cast(substr(contig, 4) as int), 100), contig) as place from variants group by contig")
def o2_chrom_order(spark, sf):
    from pyspark.sql import Window

    counts = v.variants(spark, sf).groupBy("contig").agg(F.count("*").alias("n"))
    # One row a contig: a single window is small by construction.
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*g.contig_order(F.col("contig")))))


@query("select k1, k2, k3, k4, pvalue, sequencing_type as source from variants where pvalue < 1e-6")
def u1_union(spark, sf):
    rows = v.variants(spark, sf).where(F.col("pvalue") < 1e-6)
    parts = [rows.where(F.col("sequencing_type") == s).withColumn("source", F.lit(s)) for s in ("exome", "genome")]
    return parts[0].unionByName(parts[1]).select(*KEYS, "pvalue", "source")


@query("select k1, k2, k3, k4, pvalue from variants order by pvalue, k1, k2, k3, k4 limit 100")
def l1_topk(spark, sf):
    return v.variants(spark, sf).orderBy("pvalue", *KEYS).limit(100).select(*KEYS, "pvalue")


@query("select k1, k2, k3, k4 from variants order by md5(concat_ws('|', 42, k1, k2, k3, k4)), k1, k2, k3, k4 limit 1000")
def r1_sample(spark, sf):
    return sampling.sample_rows(v.variants(spark, sf), 1000, KEYS).select(*KEYS)


WEIGHTS = {f"chr{k}": float(n) for k, n in g.GRCH38_LENGTHS.items()}


@query("shares(contig, share) as (values " + ", ".join(f"('{k}', {int(-(-500 * w // sum(WEIGHTS.values())))})" for k, w in WEIGHTS.items()) + """),
    ranked as (select contig, k1, k2, k3, k4, share, row_number() over (partition by contig order by md5(concat_ws('|', 42, k1, k2, k3, k4)), k1, k2, k3, k4) as rn from variants join shares using (contig))
    select contig, k1, k2, k3, k4 from ranked where rn <= share""")
def r2_weighted_sample(spark, sf):
    return sampling.sample_by_weight(v.variants(spark, sf), 500, WEIGHTS, "contig", KEYS).select("contig", *KEYS)


@query("""ids as (select distinct analysis_id from assets), ranked as (
    select analysis_id, row_number() over (order by analysis_id not in (1, 2, 3), md5(concat_ws('|', 42, analysis_id)), analysis_id) as rn from ids)
    select analysis_id from ranked where rn <= (select greatest(3, ceil(count(*) * 0.1)) from ids)""")
def r3_seeded_sample(spark, sf):
    return sampling.sample_ids(v.assets(spark, sf), "analysis_id", 0.1, always=[1, 2, 3])


# Scalar functions


@query("select k1, k2, k3, k4, round(case when pvalue <= 0 then 350 when pvalue <= 1 then -log10(pvalue) end, 6) as y from variants")
def x1_neglog10p(spark, sf):
    return v.variants(spark, sf).select(*KEYS, F.round(g.neg_log10_p(F.col("pvalue")), 6).alias("y"))


@query("select k1, k2, k3, k4, cast(substr(contig, 4) as bigint) * 1000000000 + position as xpos, position as xpos_mt from variants")
def x4_xpos(spark, sf):
    rows = v.variants(spark, sf)
    return rows.select(*KEYS, g.xpos(F.col("contig"), F.col("position")).alias("xpos"), g.xpos_ingest(F.lit("chrM"), F.col("position")).cast("int").alias("xpos_mt"))


@query("select k1, k2, k3, k4, contig || ':' || position || ':' || ref || ':' || alt as variant_id, substr(contig, 4) as bare, coalesce(ref, '') as a0 from variants")
def x8_variant_id(spark, sf):
    rows = v.variants(spark, sf)
    cols = [F.col(c) for c in ("contig", "position", "ref", "alt")]
    return rows.select(*KEYS, g.variant_id(*cols, sep=":").alias("variant_id"), g.strip_chr(F.col("contig")).alias("bare"), g.allele(F.array("ref", "alt"), 0).alias("a0"))


@query("""select contig || '_' || start || '_' || "end" as locus_id, cast((start + "end") // 2 as int) as middle from intervals""")
def x9_locus_id(spark, sf):
    return v.intervals(spark, sf).select(g.locus_id(F.col("contig"), F.col("start"), F.col("end")).alias("locus_id"), g.midpoint(F.col("start"), F.col("end")).alias("middle"))


@query("""select gene_id, contig, cast(start as int) as start, cast(case when start % 3 = 0 then start + 1000 else greatest("end", start + 1000) end as int) as "end" from genes""")
def x11_gene_location(spark, sf):
    known = F.when(F.col("start") % 3 != 0, g.strip_chr(F.col("contig")))
    at = g.gene_location(known, F.col("start"), F.col("end"), F.col("contig"), F.col("start"))
    return v.genes(spark, sf).select("gene_id", at.alias("at")).select("gene_id", "at.*")


_TOTAL = sum(g.GRCH38_LENGTHS.values())
_SCALE = (3000 - 4 * 22) / _TOTAL
_CASES, _AT = [], 0.0
for _name, _length in g.GRCH38_LENGTHS.items():
    _CASES.append(f"when 'chr{_name}' then {_AT!r}::double")
    _AT += _length * _SCALE + 4
PLOT_X = f"(case contig {' '.join(_CASES)} end + position * {_SCALE!r}::double)"
PLOT_Y = "(case when y <= 10 then 800 - y / 10 * 480 else greatest(320 - least(ln(y / 10) / ln(2), 1) * 320, 0) end)"


@query(f"select k1, k2, k3, k4, round({PLOT_X}, 4) as x from variants")
def x17_plot_x(spark, sf):
    return v.variants(spark, sf).select(*KEYS, F.round(g.plot_x(F.col("contig"), F.col("position")), 4).alias("x"))


@query(f"select k1, k2, k3, k4, round({PLOT_Y}, 4) as y from (select *, -log10(pvalue) as y from variants)")
def x18_plot_y(spark, sf):
    return v.variants(spark, sf).select(*KEYS, F.round(g.plot_y(g.neg_log10_p(F.col("pvalue"))), 4).alias("y"))


@query("""select k1, k2, k3, k4, round((position - 1000) / 49000.0 * 800, 4) as x from variants where position between 1000 and 50000""")
def x19_locus_x(spark, sf):
    rows = v.variants(spark, sf).where(F.col("position").between(1000, 50000))
    return rows.select(*KEYS, F.round(g.locus_x(F.col("position"), F.lit(1000), F.lit(50000), 800), 4).alias("x"))


# Telemetry


@query("latest as (select *, row_number() over (partition by worker_id order by ts desc, event_id desc) as rn from telemetry) select worker_id, event_id, cast(rn as int) as rn, value from latest where rn <= 5")
def c6_latest_n(spark, sf):
    return telemetry.latest(v.telemetry(spark, sf), 5).select("worker_id", "event_id", "rn", "value")


@query("select distinct worker_id from telemetry")
def c6_workers(spark, sf):
    return telemetry.workers(v.telemetry(spark, sf))


@query("select event_id, value from telemetry where worker_id = 3")
def c6_history(spark, sf):
    return telemetry.history(v.telemetry(spark, sf), 3).select("event_id", "value")


LAST = "last as (select * from (select *, row_number() over (partition by worker_id order by ts desc, event_id desc) as rn from telemetry) where rn = 1), clock as (select max(ts) as now from telemetry)"


@query(LAST + " select count(*) as active_workers, round(sum(value), 6) as rate from last, clock where ts >= now - interval 30 minutes")
def c7_cluster_rate(spark, sf):
    rows = v.telemetry(spark, sf)
    now = rows.agg(F.max("ts")).scalar()
    out = telemetry.cluster_rate(rows, now, alive_seconds=1800)
    return out.select("active_workers", F.round("rate", 6).alias("rate"))


@query(LAST + " select worker_id, case when ts < now - interval 30 seconds then 'suspected_dead' else 'alive' end as status from last, clock")
def c7_liveness(spark, sf):
    rows = v.telemetry(spark, sf)
    now = rows.agg(F.max("ts")).scalar()
    return telemetry.liveness(rows, now).select("worker_id", "status")


@query("select event_type as status, count(*) as n from telemetry group by event_type")
def c7_stage_counts(spark, sf):
    return telemetry.stage_counts(v.telemetry(spark, sf), "event_type").withColumnRenamed("event_type", "status")


@query("select event_id, worker_id from telemetry where ts > timestamp '2024-01-15 00:00:00'")
def c7_events_since(spark, sf):
    return telemetry.since(v.telemetry(spark, sf), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "worker_id")


@query("""means as (select worker_id, avg(cpu_percent) as c, avg(memory_percent) as m, avg(received_mb) as r, avg(sent_mb) as s from telemetry group by worker_id)
    select worker_id, case when c > 85 then 'cpu' when m > 85 then 'memory' when r > 800 then 'network_in' when s > 500 then 'network_out' when c < 30 then 'io_wait' else 'balanced' end as label from means""")
def a15_bottleneck(spark, sf):
    means = v.telemetry(spark, sf).groupBy("worker_id").agg(*[F.avg(c).alias(c) for c in ("cpu_percent", "memory_percent", "received_mb", "sent_mb")])
    return means.select("worker_id", telemetry.bottleneck(*[F.col(c) for c in ("cpu_percent", "memory_percent", "received_mb", "sent_mb")]).alias("label"))


# Pipelines


@query(CLUMPS + f""", reach as (select contig, greatest(1, lead_position - {WINDOW}) as start, lead_position + {WINDOW} as "end" from clumps),
    merged as (select * from (with """ + MERGE.format(src="reach", gap=0) + """)),
    met as (select m.contig, m.start, m."end", x.position, x.ref, x.alt, x.pvalue, x.sequencing_type from variants x join merged m on m.contig = x.contig and x.position between m.start and m."end" where x.pvalue < 5e-8),
    ranked as (select *, row_number() over w as rn, count(*) filter (sequencing_type = 'exome') over (partition by contig, start, "end") as exome_count,
        count(*) filter (sequencing_type = 'genome') over (partition by contig, start, "end") as genome_count from met window w as (partition by contig, start, "end" order by pvalue, position, ref, alt, sequencing_type))
    select replace(contig, 'chr', '') || '_' || start || '_' || "end" as locus_id, contig, start, "end", cast(substr(contig, 4) as bigint) * 1000000000 + start as xstart,
        cast(substr(contig, 4) as bigint) * 1000000000 + "end" as xstop, sequencing_type as source, contig || ':' || position as lead_variant, pvalue as lead_pvalue, exome_count, genome_count
    from ranked where rn = 1""")
def q6_loci(spark, sf):
    return loci.loci(v.variants(spark, sf), window=WINDOW)


WIN_LOCI = HITS + "merged as (select * from (with " + MERGE.format(src="reach", gap=1) + """)),
    met as (select m.contig, m.start, m."end", x.position, x.ref, x.alt, x.pvalue, x.sequencing_type from variants x join merged m on m.contig = x.contig and x.position between m.start and m."end" where x.pvalue < 5e-8),
    ranked as (select *, row_number() over (partition by contig, start, "end" order by pvalue, position, ref, alt, sequencing_type) as rn from met)"""


@query(WIN_LOCI + """ select r.contig, r.start, r."end", r.contig || ':' || r.position as lead_variant, r.pvalue as lead_pvalue, c.exome_count, c.genome_count,
    replace(r.contig, 'chr', '') || '_' || r.start || '_' || r."end" as locus_id
    from ranked r join (select contig, start, "end", count(*) filter (sequencing_type = 'exome') as exome_count, count(*) filter (sequencing_type = 'genome') as genome_count from met group by all) c
    on r.contig = c.contig and r.start = c.start and r."end" = c."end" where rn = 1""")
def q6_loci_window(spark, sf):
    out = loci.loci(v.variants(spark, sf), strategy="window", window=WINDOW)
    return out.select("locus_id", "contig", "start", "end", "lead_variant", "lead_pvalue", "exome_count", "genome_count")


@query("select gene_id, gene_symbol, annotation, max_maf, pvalue, pvalue_burden, pvalue_skat, beta_burden, mac, contig, cast(position as int) as gene_start_position, cast(substr(contig, 4) as bigint) * 1000000000 + position as xpos, 'height' as phenotype, 'eur' as ancestry from burden where abs(max_maf - 0.001) <= 1e-9")
def q8_gene_burden(spark, sf):
    return b.gene_associations(v.burden(spark, sf), "height", "eur", maf=0.001)


@query("""n as (select contig, count(*) as n from variants group by contig), ranked as (
    select contig, position, ref, alt, pvalue, row_number() over (partition by contig order by pvalue, k1, k2, k3, k4) as r from variants)
    select contig, position, ref, alt, round(-log10(pvalue), 6) as pvalue_log10, round(-log10((r - 0.5::double) / n), 6) as pvalue_expected_log10 from ranked join n using (contig)""")
def q9_qq(spark, sf):
    return manhattan.qq_points(v.variants(spark, sf), KEYS)


@query("""coarse as (select *, greatest(floor(pvalue * 50), 1) / 50 as p from variants), n as (select contig, count(*) as n from coarse where p <= 1 group by contig), ranked as (
    select contig, position, ref, alt, p, row_number() over (partition by contig order by p, k1, k2, k3, k4) as r from coarse where p <= 1)
    select contig, position, ref, alt, round(-log10(p), 6) as pvalue_log10, round(-log10((r - 0.5::double) / n), 6) as pvalue_expected_log10 from ranked join n using (contig)""")
def q9_qq_ties(spark, sf):
    """Nearly all rows have one p; its buckets are ranked by ranges of (p, keys)."""
    coarse = v.variants(spark, sf).withColumn("pvalue", F.greatest(F.floor(F.col("pvalue") * 50), F.lit(1)) / 50)
    return manhattan.qq_points(coarse, KEYS, hot=500)


@query("""select 'height' as phenotype, 'eur' as ancestry, sequencing_type, cast(substr(contig, 4) as bigint) * 1000000000 + position as xpos, contig, position, ref, alt, pvalue, beta, se, af from variants where pvalue < 5e-8""")
def q11_ingest_variants(spark, sf):
    return manhattan.significant_variants(v.variants(spark, sf), "height", "eur")


@query(f"""points as (select *, -log10(pvalue) as y from variants)
    select contig, position, round({PLOT_X}, 4) as x_px, round({PLOT_Y}, 4) as y_px, pvalue < 5e-8 as significant from points""")
def q12_plot_points(spark, sf):
    return manhattan.plot_points(v.variants(spark, sf))


@query(f"""points as (select *, -log10(pvalue) as y from variants), px as (select cast(floor({PLOT_X}) as int) as px, cast(floor({PLOT_Y}) as int) as py, pvalue from points)
    select px, py, count(*) as n, min(pvalue) as best_p from px group by px, py""")
def g1_pixel_density(spark, sf):
    return render.pixels(manhattan.plot_points(v.variants(spark, sf), rounded=False))


@query("""near as (select *, -log10(pvalue) as y from variants where contig = 'chr4' and position between 400000 and 600000 and pvalue > 0), top as (select greatest(10, max(y)) * 1.1 as top from near)
    select k1, k2, k3, k4, round((position - 400000) / 200000.0::double * 800, 4) as x_px, round(400 - y / top * 400, 4) as y_px, case when sequencing_type = 'exome' then 'diamond' else 'circle' end as shape from near, top""")
def g3_locus_points(spark, sf):
    near = v.variants(spark, sf).where("contig = 'chr4'")
    return render.locus_points(near, 400000, 600000).select(*KEYS, F.round("x_px", 4).alias("x_px"), F.round("y_px", 4).alias("y_px"), "shape")


@query(TESTS + f""", best as (select gene_id, contig, position, annotation, max_maf, min(p) as p from valid group by all),
    every as (select gene_id, contig, position, min(p) as p, 'all' as panel from best group by 1, 2, 3 union all select gene_id, contig, position, p, annotation || ':' || printf('%.4f', max_maf) from best),
    seen as (select *, -log10(p) as y, greatest(10, least(50, max(-log10(p)) over (partition by panel))) as top from every)
    select panel, gene_id, p as pvalue, round({PLOT_X}, 4) as x_px,
        round(case when y <= 10 then 800 - y / 10 * 480 else greatest(320 - least(ln(y / 10) / ln(greatest(top, 20) / 10), 1) * 320, 0) end, 4) as y_px from seen""")
def g4_gene_panels(spark, sf):
    out = render.gene_points(v.burden(spark, sf))
    return out.select("panel", "gene_id", "pvalue", F.round("x_px", 4).alias("x_px"), F.round("y_px", 4).alias("y_px"))


@query(f"""points as (select *, -log10(pvalue) as y from variants where pvalue < 1e-7), spot as (select {PLOT_X} as x, {PLOT_Y} as y_px, k1, k2, k3, k4 from points),
    asked as (select s_suppkey as id, (s_suppkey * 37) % 3000 as qx, (s_suppkey * 53) % 800 as qy from supplier),
    ranked as (select a.id, p.k1, p.k2, p.k3, p.k4, row_number() over (partition by a.id order by (p.x - a.qx) * (p.x - a.qx) + (p.y_px - a.qy) * (p.y_px - a.qy), p.k1, p.k2, p.k3, p.k4) as rn
        from asked a join spot p on (p.x - a.qx) * (p.x - a.qx) + (p.y_px - a.qy) * (p.y_px - a.qy) <= 100)
    select id, k1, k2, k3, k4 from ranked where rn = 1""")
def g6_nearest_hit(spark, sf):
    points = manhattan.plot_points(v.variants(spark, sf).where(F.col("pvalue") < 1e-7), rounded=False, keep=KEYS)
    asked = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37) % 3000).alias("qx"), ((F.col("s_suppkey") * 53) % 800).alias("qy"))
    return render.nearest(points, asked, KEYS).select("id", *KEYS)


@query("""keyed as (select contig, position, ref, alt, pvalue, row_number() over (partition by contig, position, ref, alt order by k1 desc, k2 desc, k3 desc, k4 desc) as rn from variants)
    select contig, position, ref, alt, pvalue from keyed where rn = 1""")
def k13_upsert(spark, sf):
    from locusframe.sources.sinks import last_per_key

    rows = v.variants(spark, sf)
    return last_per_key(rows, ["contig", "position", "ref", "alt"], KEYS).select("contig", "position", "ref", "alt", "pvalue")


@query("""select ancestry, analysis_id, exome_uri is not null or genome_uri is not null or gene_uri is not null as planned from (select ancestry, analysis_id,
    max(case when asset_type = 'variant' and sequencing_type = 'exome' then uri end) as exome_uri, max(case when asset_type = 'variant' and sequencing_type = 'genome' then uri end) as genome_uri,
    max(case when asset_type = 'gene' then uri end) as gene_uri from assets group by ancestry, analysis_id)""")
def q10_batch_plan(spark, sf):
    return manhattan.batch_plan(v.assets(spark, sf)).select("ancestry", "analysis_id", "planned")


@query("""hits as (select x.contig, x.position, x.ref, x.alt, x.pvalue, m.start, m."end" from variants x join (select * from (with """ + HITS + MERGE.format(src="reach", gap=1) + """)) m
    on m.contig = x.contig and x.position between m.start and m."end" where x.pvalue > 0 and x.pvalue < 0.01)
    select replace(contig, 'chr', '') || '_' || start || '_' || "end" as locus_id, contig, position, ref, alt, pvalue, pvalue < 5e-8 as is_significant, round(cast(cast(-log10(pvalue) as float) as double), 4) as y from hits""")
def q5_locus_variants(spark, sf):
    out = manhattan.locus_variants(v.variants(spark, sf), loci.expand_and_merge(v.variants(spark, sf).where(F.col("pvalue") < 5e-8), WINDOW, adjacent=True))
    return out.select("locus_id", "contig", "position", "ref", "alt", "pvalue", "is_significant", F.round(F.col("neg_log10_p").cast("double"), 4).alias("y"))


# Further scalar functions, orders and compositions


@query("select k1, k2, k3, k4, cast(substr(contig, 4) as int) as n, contig as prefixed, round(cast(case when pvalue > 0 then cast(-log10(pvalue) as float) else 0 end as double), 4) as y32 from variants")
def x3_contig_number(spark, sf):
    rows = v.variants(spark, sf)
    bare = g.strip_chr(F.col("contig"))
    y = F.round(g.neg_log10_p_or_zero(F.col("pvalue")).cast("double"), 4)
    return rows.select(*KEYS, g.contig_number(bare).alias("n"), g.chr_prefixed(bare).alias("prefixed"), y.alias("y32"))


@query("select k1, k2, k3, k4, printf('%.6f', pvalue) as p_text, cast(k1 as varchar) as k_text, greatest(1, position - 5000) as start from variants")
def x15_stat_text(spark, sf):
    rows = v.variants(spark, sf)
    return rows.select(*KEYS, g.stat_text(F.col("pvalue"), "double").alias("p_text"), g.stat_text(F.col("k1"), "long").alias("k_text"), g.window_start(F.col("position"), 5000).alias("start"))


@query("select contig, position, ref, alt, beta, af from variants where k1 % 11 <> 0 and k1 % 5 <> 0")
def f23_typed_record(spark, sf):
    """Rows without a place or a usable p-value go."""
    rows = v.variants(spark, sf).select(
        F.when(F.col("k1") % 11 != 0, F.struct("contig", "position")).alias("locus"),
        F.array("ref", "alt").alias("alleles"),
        F.when(F.col("k1") % 5 != 0, F.col("pvalue")).alias("Pvalue"),
        F.col("beta").alias("BETA"),
        F.col("af").alias("AF"),
    )
    return manhattan.association_rows(rows).select("contig", "position", "ref", "alt", "beta", "af")


@query("select k1, k2, k3, k4, p from (select *, case when k1 % 3 <> 0 then pvalue end as p from variants) order by p nulls last, k1, k2, k3, k4 limit 200")
def o1_sort_p_nulls_last(spark, sf):
    rows = v.variants(spark, sf).withColumn("p", F.when(F.col("k1") % 3 != 0, F.col("pvalue")))
    return rows.orderBy(F.asc_nulls_last("p"), *KEYS).limit(200).select(*KEYS, "p")


@query("select contig, position, ref, alt, k1, k2, k3, k4 from variants order by contig, position, ref, alt, k1, k2, k3, k4 limit 300")
def o3_key_order(spark, sf):
    """Structs and arrays order field by field."""
    rows = v.variants(spark, sf)
    order = [F.struct("contig", "position"), F.array("ref", "alt"), *KEYS]
    return rows.orderBy(*order).limit(300).select("contig", "position", "ref", "alt", *KEYS)


@query("select count(*) as n, count(distinct (k1, k2, k3, k4)) as n_keys from variants")
def p1_modulo_allocation(spark, sf):
    """Each row lies in a partition of one of four workers."""
    rows = v.variants(spark, sf).select(*KEYS)
    parts = [sampling.owned_partitions(rows, 4, w) for w in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.agg(F.count("*").alias("n"), F.count_distinct(*KEYS).alias("n_keys"))


@query("""select '{"contig":"' || contig || '","position":' || position || ',"note":null,"k1":' || k1 || ',"k2":' || k2 || ',"k3":' || k3 || ',"k4":' || k4 || '}' as json from variants""")
def k11_json_lines(spark, sf):
    from locusframe.sources.sinks import json_lines

    return json_lines(v.variants(spark, sf).select("contig", "position", F.lit(None).cast("string").alias("note"), *KEYS))


@query("""counts as (select ancestry, count(*) as total, count(*) filter (asset_type = 'gene') as done from assets group by ancestry)
    select ancestry, round(done * 100.0::double / total, 6) as percent, round((total - done) * 600.0::double / done, 6) as eta_seconds from counts""")
def c7_progress(spark, sf):
    counts = v.assets(spark, sf).groupBy("ancestry").agg(F.count("*").alias("total"), F.count_if(F.col("asset_type") == "gene").alias("done"))
    p = telemetry.progress(F.col("done"), F.col("total"), F.lit(600.0))
    return counts.select("ancestry", p.alias("p")).select("ancestry", F.round("p.percent", 6).alias("percent"), F.round("p.eta_seconds", 6).alias("eta_seconds"))


@query("""select k1, k2, k3, k4, position, round((position - 400000) / 200000.0 * 800, 4) as x, pvalue < 5e-8 as is_significant from variants
    where contig = 'chr4' and position between 400000 and 600000 and pvalue > 0 and pvalue < 0.01""")
def q7_locus_region(spark, sf):
    region = spark.createDataFrame([("chr4", 400000, 600000)], "contig string, start long, end long")
    out = manhattan.locus_variants(v.variants(spark, sf), region)
    return out.select(*KEYS, "position", F.round(g.locus_x(F.col("position"), F.col("start"), F.col("end"), 800), 4).alias("x"), "is_significant")


@query(HITS + TESTS + f""", every as (select contig, start, "end" from reach union all
        select contig, greatest(1, greatest(1, min(position) - 100000) - {WINDOW}), min(position) + 100000 + {WINDOW} from valid where p < 2.5e-6 group by gene_id, contig),
    merged as (select * from (with """ + MERGE.format(src="every", gap=1) + """)),
    found as (select * from merged m where exists (select 1 from variants x where x.contig = m.contig and x.pvalue < 5e-8 and x.position between m.start and m."end"))
    select 'significant_variants' as name, count(*) as n from variants where pvalue < 5e-8
    union all select 'plot_points', count(*) from variants where pvalue <= 1
    union all select 'gene_associations', count(*) from burden
    union all select 'loci', count(*) from found
    union all select 'loci_variants', count(*) from variants x join found f on f.contig = x.contig and x.position between f.start and f."end" where x.pvalue > 0 and x.pvalue < 0.01""")
def q3_pipeline_tables(spark, sf):
    """Rows of each of the pipeline's tables."""
    tables = manhattan.pipeline(v.variants(spark, sf), None, v.burden(spark, sf).withColumn("start", F.col("position")).withColumn("end", F.col("position")), None, "height", "eur", window=WINDOW, strategy="window")
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in tables.items()]
    return reduce(lambda a, x: a.unionByName(x), parts)


@query("many as (select *, 'p' || (k4 % 3) as phenotype, sequencing_type as ancestry from variants), hits as (select phenotype, ancestry, contig, greatest(1, position - 20000) as start, position + 20000 as \"end\" from many where pvalue < 5e-8),"
    + """ marked as (select *, case when start > max("end") over (partition by phenotype, ancestry, contig order by start, "end" rows between unbounded preceding and 1 preceding) + 1 or
        row_number() over (partition by phenotype, ancestry, contig order by start, "end") = 1 then 1 else 0 end as fresh from hits),
    islands as (select *, sum(fresh) over (partition by phenotype, ancestry, contig order by start, "end" rows unbounded preceding) as island from marked),
    found as (select phenotype, ancestry, contig, min(start) as start, max("end") as "end" from islands group by phenotype, ancestry, contig, island)
    select 'significant_variants' as name, phenotype, ancestry, count(*) as n from many where pvalue < 5e-8 group by all
    union all select 'plot_points', phenotype, ancestry, count(*) from many where pvalue <= 1 group by all
    union all select 'loci', phenotype, ancestry, count(*) from found group by all
    union all select 'loci_variants', x.phenotype, x.ancestry, count(*) from many x join found f on f.phenotype = x.phenotype and f.ancestry = x.ancestry and f.contig = x.contig
        and x.position between f.start and f."end" where x.pvalue > 0 and x.pvalue < 0.01 group by all""")
def c8_many_phenotypes(spark, sf):
    """Rows of each table of each of six phenotypes, made together."""
    rows = v.variants(spark, sf).withColumns({"phenotype": F.concat(F.lit("p"), (F.col("k4") % 3).cast("string")), "ancestry": F.col("sequencing_type")})
    tables = manhattan.pipeline_of_many(rows, window=WINDOW, strategy="window")
    parts = [t.groupBy("phenotype", "ancestry").agg(F.lit(n).alias("name"), F.count("*").alias("n")).select("name", "phenotype", "ancestry", "n") for n, t in tables.items()]
    return reduce(lambda a, x: a.unionByName(x), parts)


# Job state, samples that are validated, and columns of other systems


TASKS = "tasks as (select user_id as phenotype_id, case when value < 10 then 'failed' when value < 40 then 'running' when value < 60 then 'waiting' else 'done' end as status from events)"


def tasks(spark, sf):
    value = F.col("value")
    status = F.when(value < 10, "failed").when(value < 40, "running").when(value < 60, "waiting").otherwise("done")
    return v.table(spark, sf, "events").select(F.col("user_id").alias("phenotype_id"), status.alias("status"))


STATES = TASKS + """, states as (select phenotype_id, count(*) as total, count(*) filter (status = 'done') as done, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'running') as running from tasks group by 1),
    told as (select *, case when failed > 0 then 'failed' when done = total then 'complete' when done + running > 0 then 'active' else 'waiting' end as state from states)"""


@query(STATES + " select * from told")
def c7_phenotype_status(spark, sf):
    return telemetry.phenotype_status(tasks(spark, sf))


PHENOTYPES = """phenos as (select c_custkey as phenotype_id, c_nationkey as partitions, case when c_custkey % 40 = 0 then 'active' when c_custkey % 7 = 0 then 'scanned' else 'waiting' end as state from customer where c_custkey > 0)"""


def phenotypes(spark, sf):
    key = F.col("c_custkey")
    state = F.when(key % 40 == 0, "active").when(key % 7 == 0, "scanned").otherwise("waiting")
    return v.table(spark, sf, "customer").select(key.alias("phenotype_id"), F.col("c_nationkey").alias("partitions"), state.alias("state"))


@query(PHENOTYPES.replace(" where c_custkey > 0", "") + """, checked as (select phenotype_id, partitions, case when state = 'waiting' and partitions = 0 then 'failed' else state end as state from phenos),
    ranked as (select *, row_number() over (partition by state order by phenotype_id) as rn, (select count(*) from checked where state = 'active') as active from checked)
    select phenotype_id, partitions, case when state = 'waiting' and rn <= 30 - active then 'active' else state end as state from ranked""")
def c4_activation(spark, sf):
    return telemetry.activate(phenotypes(spark, sf), most=30)


@query(PHENOTYPES.replace(" where c_custkey > 0", "") + """ select phenotype_id from phenos where state = 'scanned' and (select count(*) from phenos where state = 'scanned') >= 10 order by phenotype_id limit 10""")
def c4_aggregate_ready(spark, sf):
    return telemetry.aggregate_ready(phenotypes(spark, sf)).select("phenotype_id")


@query("select count(*) as n from telemetry")
def c6_snapshot_count(spark, sf):
    return telemetry.snapshot_count(v.telemetry(spark, sf))


@query(LAST + """ select avg(cpu_percent) as cpu, avg(memory_percent) as memory, case when avg(cpu_percent) > 85 then 'cpu' when avg(memory_percent) > 85 then 'memory' when avg(received_mb) > 800 then 'network_in'
    when avg(sent_mb) > 500 then 'network_out' when avg(cpu_percent) < 30 then 'io_wait' else 'balanced' end as label from last, clock where ts >= now - interval 30 minutes""")
def c7_cluster_bottleneck(spark, sf):
    rows = v.telemetry(spark, sf)
    return telemetry.cluster_bottleneck(rows, rows.agg(F.max("ts")).scalar(), alive_seconds=1800)


@query(f"select k1, k2, k3, k4 from (select * from variants order by md5(concat_ws('|', 7, k1, k2, k3, k4)), k1, k2, k3, k4 limit 500) where not ({RULES})")
def v3_validated_sample(spark, sf):
    return schema.validate_sample(v.variants(spark, sf), SCHEMA_RULES, 500, KEYS, seed=7).where(F.size("errors") > 0).select(*KEYS)


@query(f"select k1, k2, k3, k4 from variants where not ({RULES}) order by k1, k2, k3, k4 limit 10")
def v2_first_errors(spark, sf):
    return schema.first_errors(v.variants(spark, sf), SCHEMA_RULES, KEYS).select(*KEYS)


@query("select sequencing_type, contig, position, pvalue from variants where sequencing_type = 'exome' and pvalue < 1e-6 union all select sequencing_type, contig, position, pvalue from variants where sequencing_type = 'genome' and pvalue < 1e-6")
def f17_where_after_interval(spark, sf):
    """A point filter over what an interval lookup found."""
    whole = iv.from_text(spark, *[f"chr{k}:1-2000000" for k in range(1, 23)])
    return pr.where(j.interval_semi_join(v.variants(spark, sf), whole), "pvalue < 1e-6").select("sequencing_type", "contig", "position", "pvalue")


@query("""select k1, k2, k3, k4, label from (select *, case when k2 % 2 = 0 then ' ' else '' end || contig || case when k1 % 3 = 0 then '  ' else '' end as label from variants)
    where label = ' chr3  ' and position >= 500000""")
def f2_where_untrimmed(spark, sf):
    """Conditions as they come in a request: no blanks are cut from values."""
    blank = lambda c, x: F.when(c, F.lit(x)).otherwise("")
    rows = v.variants(spark, sf).withColumn("label", F.concat(blank(F.col("k2") % 2 == 0, " "), "contig", blank(F.col("k1") % 3 == 0, "  ")))
    return pr.where(rows, "label= chr3  ", "position>=500000", request=True).select(*KEYS, "label")


@query("""both_ as (select contig, start, "end" from intervals), """ + TESTS + f""",
    sig as (select contig, greatest(1, min(position) - 100000) as start, min(position) + 100000 as "end" from valid where p < {P_GENE} group by gene_id, contig),
    every as (select * from both_ union all select * from sig), """ + MERGE.format(src="every", gap=1))
def w4_gene_regions(spark, sf):
    """Given regions and those of significant genes, merged."""
    genes_ = b.significant_genes(v.burden(spark, sf), P_GENE).select("contig", "start", "end")
    return iv.union(v.intervals(spark, sf), genes_)
