"""Variant-call text files as typed rows, and back.

The header is a few lines and shapes the schema.  Block-gzipped files are read in
parallel, and by region with an index beside them (:mod:`.bgzf`); other lines
come from Spark's text source, so that compressed and remote files need nothing
more.  Regions are compared on the first two fields of a line, before the others
are parsed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.sources import bgzf, files
from locusframe.sources.files import reachable

SCALARS = {"Integer": T.IntegerType(), "Float": T.FloatType(), "String": T.StringType(), "Character": T.StringType()}
FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


@dataclass(frozen=True)
class Field:
    name: str
    number: str
    kind: str
    about: str = ""

    @property
    def type(self) -> T.DataType:
        """Number 0 or 1 is one value, anything else an array."""
        if self.kind == "Flag":
            return T.BooleanType()
        one = SCALARS[self.kind]
        return one if self.number in ("0", "1") else T.ArrayType(one)


@dataclass(frozen=True)
class Header:
    info: tuple[Field, ...]
    format: tuple[Field, ...]
    contigs: tuple[str, ...]
    samples: tuple[str, ...]


def header(lines: list[str]) -> Header:
    fields: dict[str, list[Field]] = {"INFO": [], "FORMAT": []}
    contigs, samples = [], ()
    for line in lines:
        if m := re.match(r"##(INFO|FORMAT)=<(.*)>$", line):
            parts = dict(re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2]))
            fields[m[1]].append(Field(parts["ID"], parts.get("Number", "1"), parts.get("Type", "String"), parts.get("Description", "").strip('"')))
        elif m := re.match(r"##contig=<.*?ID=([^,>]+)", line):
            contigs.append(m[1])
        elif line.startswith("#CHROM"):
            samples = tuple(line.rstrip("\n").split("\t")[9:])
    return Header(tuple(fields["INFO"]), tuple(fields["FORMAT"]), tuple(contigs), samples)


def _value(text: Column, f: Field) -> Column:
    """A typed value; ``.`` and what does not parse are null."""
    if isinstance(f.type, T.ArrayType):
        one = f.type.elementType
        parts = F.transform(F.split(text, ","), lambda x: _scalar(x, one))
        return F.when(text != ".", parts)
    return _scalar(text, f.type)


def _scalar(text: Column, kind: T.DataType) -> Column:
    there = F.when(text != ".", text)
    return there if isinstance(kind, T.StringType) else there.try_cast(kind)


def head_of(lines: DataFrame) -> list[str]:
    """The header's lines, which a file starts with; no more of it is read than its first partitions."""
    n = 256
    while True:
        got = [r.value for r in lines.take(n)]
        if len(got) < n or any(not x.startswith("#") for x in got):
            return [x for x in got if x.startswith("#")]
        n *= 4


def read(spark: SparkSession, path: str, intervals: list[tuple[str, int, int]] | None = None, by_contig: bool = False) -> DataFrame:
    """``locus``, ``alleles``, ``rsid``, ``qual``, ``filters``, ``info`` and, with samples, ``genotypes``.

    S8: with ``intervals`` (contig, start, end), rows within any of them.  S9: on
    demand with every contig's rows in a partition of its own, in order of place.
    """
    if path.endswith((".gz", ".bgz")) and reachable(path) and files.size(path) and bgzf.is_blocked(path):
        lines, h = bgzf.read_lines(spark, path, intervals), header(bgzf.head_lines(path))
    else:
        lines = spark.read.text(path)
        h = header(head_of(lines))
    texts = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    if intervals is not None:
        front = F.split(F.col("value"), "\t", 3)
        contig, position = front[0], front[1].cast("int")
        within = [(contig == c) & position.between(a, b) for c, a, b in intervals]
        texts = texts.where(reduce(lambda x, y: x | y, within, F.lit(False)))
    if by_contig:
        front = F.split(F.col("value"), "\t", 3)
        if h.contigs:
            # A contig's partition is its place in the header, which no other shares; those that it lacks go by hash.
            at, n = F.array_position(F.array(*map(F.lit, h.contigs)), front[0]).cast("int"), len(h.contigs)
            texts = texts.repartitionById(n, F.when(at > 0, at - 1).otherwise(F.pmod(F.hash(front[0]), F.lit(n))))
        else:
            texts = texts.repartition(front[0])
        texts = texts.sortWithinPartitions(front[0], front[1].cast("int"))
    part = F.split(F.rtrim(F.col("value")), "\t")
    rows = texts.select(part.alias("p"))
    col = {n: F.get(F.col("p"), i) for i, n in enumerate(FIXED)}
    known = F.when(col["INFO"] != ".", F.str_to_map(col["INFO"], F.lit(";"), F.lit("=")))

    def info_value(f: Field) -> Column:
        if f.kind == "Flag":
            return F.coalesce(F.map_contains_key(known, f.name), F.lit(False))
        return _value(F.try_element_at(known, F.lit(f.name)), f)

    out = [
        F.struct(col["CHROM"].alias("contig"), col["POS"].cast("int").alias("position")).alias("locus"),
        F.when(col["ALT"] == ".", F.array(col["REF"])).otherwise(F.concat(F.array(col["REF"]), F.split(col["ALT"], ","))).alias("alleles"),
        F.when(col["ID"] != ".", col["ID"]).alias("rsid"),
        F.when(col["QUAL"] != ".", col["QUAL"]).try_cast("double").alias("qual"),
        F.when(col["FILTER"] == "PASS", F.array().cast("array<string>")).when(col["FILTER"] != ".", F.split(col["FILTER"], ";")).alias("filters"),
    ]
    if h.info:
        out.append(F.struct(*[info_value(f).alias(f.name) for f in h.info]).alias("info"))
    if h.samples:
        names = F.split(col["FORMAT"], ":")

        def call(name_and_text: Column) -> Column:
            values = F.split(name_and_text["text"], ":")
            pick = lambda n: F.get(values, F.when(F.array_contains(names, n), F.array_position(names, n).cast("int") - 1))
            return F.struct(name_and_text["sample"].alias("sample_id"), *[_value(pick(f.name), f).alias(f.name) for f in h.format])

        texts = F.slice(F.col("p"), 10, len(h.samples))
        zipped = F.zip_with(F.array(*map(F.lit, h.samples)), texts, lambda s, t: F.struct(s.alias("sample"), t.alias("text")))
        out.append(F.transform(zipped, call).alias("genotypes"))
    return rows.select(*out)


def call_fields(schema: T.StructType) -> list[T.StructField]:
    """Fields of a genotype but for its sample's name; GT comes first, as the format has it."""
    if "genotypes" not in schema.names:
        return []
    fields = [f for f in schema["genotypes"].dataType.elementType.fields if f.name != "sample_id"]
    return sorted(fields, key=lambda f: f.name != "GT")


def header_lines(schema: T.StructType, contigs: list[str] = (), samples: list[str] = ()) -> list[str]:
    """K6: a header that fits the rows' schema."""
    names = {T.IntegerType: "Integer", T.LongType: "Integer", T.FloatType: "Float", T.DoubleType: "Float", T.BooleanType: "Flag"}

    def line(word: str, f: T.StructField) -> str:
        many = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if many else f.dataType
        name = next((n for t, n in names.items() if isinstance(kind, t)), "String")
        number = "." if many else "0" if name == "Flag" else "1"
        return f'##{word}=<ID={f.name},Number={number},Type={name},Description="{f.name}">'

    out = ["##fileformat=VCFv4.3", '##FILTER=<ID=PASS,Description="All filters passed">']
    out += [f"##contig=<ID={c}>" for c in contigs]
    if "info" in schema.names:
        out += [line("INFO", f) for f in schema["info"].dataType.fields]
    out += [line("FORMAT", f) for f in call_fields(schema)]
    return [*out, "#" + "\t".join([*FIXED[:8], *(["FORMAT", *samples] if samples else [])])]


def record(schema: T.StructType, samples: list[str] = ()) -> Column:
    """K6: a row as a line, with a call of every sample given; a sample that the row lacks is missing."""
    names = schema.names

    def text(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.transform(value, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")
        return value.cast("string")

    info = F.lit(".")
    if "info" in names and schema["info"].dataType.fields:
        parts = []
        for f in schema["info"].dataType.fields:
            v = F.col("info").getField(f.name)
            if isinstance(f.dataType, T.BooleanType):
                parts.append(F.when(v, F.lit(f.name)))
            else:
                parts.append(F.when(v.isNotNull(), F.concat(F.lit(f.name + "="), text(v, f.dataType))))
        joined = F.concat_ws(";", *parts)
        info = F.when(joined == "", ".").otherwise(joined)
    alt = F.array_join(F.slice("alleles", 2, F.greatest(F.size("alleles"), F.lit(1))), ",")
    get = lambda n: F.col(n) if n in names else F.lit(None)
    calls = []
    if samples:
        fields = call_fields(schema)
        dot = lambda x: F.coalesce(x, F.lit("."))
        one = lambda g: F.concat_ws(":", *[dot(F.nullif(text(g.getField(f.name), f.dataType), F.lit(""))) for f in fields])
        known = F.map_from_entries(F.transform(F.coalesce("genotypes", F.array().cast(schema["genotypes"].dataType)), lambda g: F.struct(g["sample_id"], one(g))))
        calls = [F.lit(":".join(f.name for f in fields)), *[dot(F.try_element_at(known, F.lit(s))) for s in samples]]
    filters = F.when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";")) if "filters" in names else F.lit(None)
    return F.concat_ws(
        "\t",
        F.col("locus.contig"),
        F.col("locus.position").cast("string"),
        F.coalesce(get("rsid").cast("string"), F.lit(".")),
        F.get("alleles", 0),
        F.when(alt == "", ".").otherwise(alt),
        F.coalesce(get("qual").cast("string"), F.lit(".")),
        F.coalesce(filters.cast("string"), F.lit(".")),
        info,
        *calls,
    )


def write(df: DataFrame, path: str, compression: str = "none", samples: list[str] | None = None, joined: bool = True) -> None:
    """Header first, then rows by contig and position.

    With ``bgzf`` tasks write ranges of rows as blocks of one file, with an index
    beside it (apart, in a folder, with ``joined`` off); else tasks write ranges of rows as text
    files in a folder, in the order of their names, each with the header of its own.
    Samples are those given, or those of the genotypes of any row, by name.
    """
    spark = df.sparkSession
    contigs = [r[0] for r in df.select("locus.contig").distinct().orderBy("contig").collect()]
    if samples is None and call_fields(df.schema):
        # One name a sample: a line of the header.
        samples = [r[0] for r in df.select(F.explode("genotypes.sample_id").alias("s")).where("s is not null").distinct().orderBy("s").collect()]
    samples = samples or []
    told = "\n".join(header_lines(df.schema, contigs, samples))
    rows = df.select(F.col("locus.contig").alias("contig"), F.col("locus.position").alias("position"), "alleles", record(df.schema, samples).alias("value"))
    if compression == "bgzf":
        by = ("contig", "position", "alleles")
        return bgzf.write_lines(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("value"), path, told + "\n", True, joined)
    # The header's own row, without a contig, is the first of all, and stands alone where there are no others.
    head = spark.createDataFrame([(told,)], "value string").withColumn("_row", F.lit(0))
    by = ("_row", F.asc_nulls_first("contig"), "position", "alleles")
    ordered = rows.withColumn("_row", F.lit(1)).unionByName(head, allowMissingColumns=True).repartitionByRange(*by).sortWithinPartitions(*by)
    # Ids count from 0 in the lower bits, partition by partition.
    opens = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    value = F.when(opens & (F.col("_row") == 1), F.concat(F.lit(told + "\n"), "value")).otherwise(F.col("value"))
    ordered.select(value.alias("value")).write.option("compression", compression).text(path)
