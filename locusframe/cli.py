"""Command line: query, summary, info, export, validate, schema, loci, locus, manhattan, batch, ingest, serve."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import predicates
from locusframe.operators import intervals, joins, loci, manhattan, sampling, schema, stats
from locusframe.session import session
from locusframe.sources import keyed, sinks, tables, vcf


#: Intervals up to which these are told to sources, which then open only what can hold them.
TOLD = 1000


def limits_of(a: argparse.Namespace) -> keyed.Limits:
    """The longest text and array that a keyed table may hold."""
    return keyed.Limits(getattr(a, "max_text", None) or keyed.LIMITS.binary, getattr(a, "max_array", None) or keyed.LIMITS.array)


def chosen(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    given = [intervals.from_text(spark, *a.interval)] if a.interval else []
    given += [intervals.read(spark, f) for f in a.intervals_file]
    # Conditions as the source may use them; in the other mode nulls pass, which bounds do not tell.
    request = getattr(a, "request", False)
    ranges = predicates.key_ranges(*a.where) if a.mode == "sql" and not request else []
    few = [tuple(r) for r in intervals.union(*given).limit(TOLD + 1).collect()] if given else []
    near = few if given and len(few) <= TOLD else None
    df = predicates.where(tables.open_path(spark, a.table, ranges, near, limits_of(a)), *a.where, mode=a.mode, request=request)
    if given:
        nested = "locus" in df.columns
        work = df.withColumns({"_contig_": df["locus.contig"], "_position_": df["locus.position"]}) if nested else df
        names = ("_contig_", "_position_") if nested else ("contig", "position")
        df = joins.interval_semi_join(work, intervals.union(*given), *names).drop("_contig_", "_position_")
    return df if a.limit is None else df.limit(a.limit)


def printed(df: DataFrame) -> None:
    """All rows as JSON lines, partition by partition."""
    for r in sinks.json_lines(df).toLocalIterator():
        print(r.json)


def renamed_assets(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("ancestry_group", "ancestry")


def summary(df: DataFrame) -> None:
    """Q2: the number of rows, the sizes of partitions, the schema, and statistics of every field."""
    sizes = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
    told = stats.partition_sizes(sizes, "rows").withColumnsRenamed({"n": "partitions", "total": "rows"})
    printed(told)
    print(schema.tree_text(df.schema))
    printed(stats.field_statistics(df).orderBy("path"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="locusframe")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("query", "summary", "info", "export", "validate", "schema", "loci", "locus", "manhattan", "batch", "ingest", "serve"):
        p = sub.add_parser(name)
        p.add_argument("table")
        p.add_argument("--where", action="append", default=[])
        p.add_argument("--interval", action="append", default=[])
        p.add_argument("--intervals-file", action="append", default=[])
        p.add_argument("--limit", type=int)
        p.add_argument("--max-text", type=int, help="bytes of a keyed table's longest text")
        p.add_argument("--max-array", type=int, help="elements of a keyed table's longest array")
        p.add_argument("--mode", choices=("sql", "compat", "calls"), default="sql")
        if name == "export":
            p.add_argument("--to", choices=("parquet", "json", "vcf", "ht", "clickhouse", "bigquery"), required=True)
            p.add_argument("--output", required=True, help="a path; for clickhouse the end point's URL")
            p.add_argument("--name", help="the table's name in the other system")
            p.add_argument("--compression", choices=("none", "gzip", "bgzf"), default="none")
            p.add_argument("--shards", type=int)
            p.add_argument("--group-by", action="append", default=[])
            p.add_argument("--key", action="append", default=[])
        if name == "validate":
            p.add_argument("--schema", required=True)
            p.add_argument("--sample", type=int, help="so many rows: of a few parts where the table has parts, else by a hash of the keys")
            p.add_argument("--key", action="append", default=[])
            p.add_argument("--seed", type=int, default=42)
            p.add_argument("--fail-fast", action="store_true")
            p.add_argument("--errors", type=int, default=0, help="print so many rows that break a rule")
        if name == "serve":
            p.add_argument("--port", type=int, default=8080)
        if name == "ingest":
            p.add_argument("--phenotype", required=True)
            p.add_argument("--ancestry", default="")
            p.add_argument("--output", required=True)
        if name == "manhattan":
            p.add_argument("--phenotype", required=True)
            p.add_argument("--ancestry", default="")
            p.add_argument("--genes")
            p.add_argument("--annotations")
            p.add_argument("--output", required=True)
            p.add_argument("--init", choices=("create", "replace", "append"), default="append")
        if name in ("loci", "manhattan"):
            p.add_argument("--threshold", type=float, default=5e-8)
            p.add_argument("--window", type=int, default=1_000_000)
            p.add_argument("--strategy", choices=("clump", "window"), default="clump")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or session()
    if a.command == "info":
        printed(keyed.info(spark, a.table) if a.table.rstrip("/").endswith(".ht") else stats.file_sizes(tables.open_path(spark, a.table)))
        return
    if a.command == "batch":
        printed(manhattan.batch_plan(renamed_assets(tables.assets(spark, a.table))))
        return
    if a.command == "ingest":
        printed(sinks.ingest(spark, a.table, a.output, a.phenotype, a.ancestry))
        return
    if a.command == "serve":
        from locusframe.server import serve

        serve(spark, a.port).serve_forever()
    df = chosen(spark, a)
    if a.command == "query":
        printed(df)
    elif a.command == "summary":
        summary(df)
    elif a.command == "schema":
        print(json.dumps(schema.generate(df.schema), indent=2))
    elif a.command == "validate":
        with open(a.schema, encoding="utf-8") as f:
            rules = json.load(f)
        keys = a.key or df.columns
        few = tables.sample_path(spark, a.table, a.sample, a.seed) if a.sample is not None and not (a.where or a.interval or a.intervals_file or a.limit) else None
        some = few if few is not None else df if a.sample is None else sampling.sample_rows(df, a.sample, keys, a.seed)
        if a.fail_fast:
            schema.check(some, rules)
        if a.errors:
            printed(schema.first_errors(some, rules, keys, a.errors))
        printed(schema.validation_counts(some, rules))
    elif a.command == "loci":
        printed(loci.loci(df, strategy=a.strategy, threshold=a.threshold, window=a.window).orderBy("lead_pvalue"))
    elif a.command == "locus":
        printed(manhattan.locus_variants(df, intervals.from_text(spark, *a.interval)).orderBy("pvalue"))
    elif a.command == "manhattan":
        given = lambda path: tables.open_path(spark, path) if path else None
        made = manhattan.pipeline(df, None, given(a.genes), given(a.annotations), a.phenotype, a.ancestry, threshold=a.threshold, window=a.window, strategy=a.strategy)
        names = {n: t if "phenotype" in t.columns else t.withColumns({"phenotype": F.lit(a.phenotype), "ancestry": F.lit(a.ancestry)}) for n, t in made.items()}
        sinks.warehouse({n: t for n, t in names.items() if n in sinks.WAREHOUSE_KEYS}, a.output, a.init)
    elif a.to == "parquet":
        sinks.parquet(df, a.output, a.shards)
    elif a.to == "json":
        sinks.ndjson(df, a.output, a.group_by)
    elif a.to == "vcf":
        vcf.write(df, a.output, a.compression)
    elif a.to == "clickhouse":
        print(json.dumps({"table": a.name, "rows": sinks.clickhouse(df, a.output, a.name, a.key)}))
    elif a.to == "bigquery":
        print(json.dumps(sinks.bigquery(df, a.output, a.name)))
    else:
        keyed.write(df, a.output, a.key, a.shards, limits_of(a))


if __name__ == "__main__":
    main()
