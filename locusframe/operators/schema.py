"""JSON Schema validation and generation, and type mappings to other systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the kinds in JSON Schema.
KINDS = {
    "string": (T.StringType,),
    "integer": (T.IntegerType, T.LongType, T.ShortType, T.ByteType),
    "number": (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType),
    "boolean": (T.BooleanType,),
    "object": (T.StructType,),
    "array": (T.ArrayType,),
}


def rules(schema: dict, value: Column, kind: T.DataType, path: str = "") -> list[Column]:
    """Expressions that are a message where a value breaks a rule, else null.

    type, required, properties, additionalProperties, enum, pattern, minLength,
    maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minItems,
    maxItems and items are checked; title, description, $schema, format and default
    say something of a value but rule nothing out; other keywords are an error.
    """
    # The keywords.
    known = {
        "type", "required", "properties", "additionalProperties", "enum", "pattern", "minLength", "maxLength", "minimum", "maximum",
        "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "items", "title", "description", "$schema", "format", "default",
    }
    if unknown := schema.keys() - known:
        raise ValueError(f"keywords not supported: {sorted(unknown)}")
    out: list[Column] = []
    says = lambda bad, rule: out.append(F.when(bad, F.lit(f"{path or 'row'}: {rule}")))
    there = value.isNotNull()
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types:
        fits = any(isinstance(kind, KINDS.get(t, ())) for t in types)
        if not fits:
            says(there, "type")
        if "null" not in types and path:
            says(~there, "type")
    if "enum" in schema:
        wanted = [x for x in schema["enum"] if x is not None]
        says(there & ~value.isin(*wanted), "enum")
    if isinstance(kind, T.StringType):
        if "pattern" in schema:
            says(there & ~value.rlike(schema["pattern"]), "pattern")
        if "minLength" in schema:
            says(F.char_length(value) < schema["minLength"], "minLength")
        if "maxLength" in schema:
            says(F.char_length(value) > schema["maxLength"], "maxLength")
    if isinstance(kind, KINDS["number"]):
        for word, bad in (("minimum", value.__lt__), ("maximum", value.__gt__), ("exclusiveMinimum", value.__le__), ("exclusiveMaximum", value.__ge__)):
            if word in schema:
                says(bad(F.lit(schema[word])), word)
    if isinstance(kind, T.ArrayType):
        if "minItems" in schema:
            says(F.size(value) < schema["minItems"], "minItems")
        if "maxItems" in schema:
            says(F.size(value) > schema["maxItems"], "maxItems")
        if "items" in schema:

            def broken(x: Column) -> Column:
                inner = rules(schema["items"], x, kind.elementType, f"{path}[]")
                return F.coalesce(*inner) if inner else F.lit(None).cast("string")

            out.append(F.when(there, F.get(F.filter(F.transform(value, broken), lambda m: m.isNotNull()), 0)))
    if isinstance(kind, T.StructType):
        for name in schema.get("required", []):
            if name not in kind.names:
                says(F.lit(True), f"{name} missing")
        if schema.get("additionalProperties") is False and kind.names:
            for name in [n for n in kind.names if n not in schema.get("properties", {})]:
                says(there, f"{name} not allowed")
        for name, sub in schema.get("properties", {}).items():
            if name in kind.names:
                inner = rules(sub, value.getField(name) if path else F.col(f"`{name}`"), kind[name].dataType, f"{path}.{name}" if path else name)
                out += [F.when(there, r) for r in inner] if path else inner
    return out


def validate(df: DataFrame, schema: dict) -> DataFrame:
    """V1: rows with ``errors``, the messages of the rules they break, in the schema's order."""
    made = rules(schema, F.lit(True), df.schema)
    found = F.array(*made) if made else F.array().cast("array<string>")
    return df.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def validation_counts(df: DataFrame, schema: dict) -> DataFrame:
    """Rows scanned, valid and invalid."""
    bad = F.size("errors") > 0
    return validate(df, schema).agg(F.count("*").alias("scanned"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"))


def first_errors(df: DataFrame, schema: dict, keys: list[str], n: int = 10) -> DataFrame:
    """V2: the first errors, in the order of the keys."""
    return validate(df, schema).where(F.size("errors") > 0).orderBy(*keys).limit(n).select(*keys, "errors")


def validate_sample(df: DataFrame, schema: dict, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """V3: V1 over a seeded sample of ``n`` rows (R1); the sample repeats whatever the partitions."""
    from locusframe.operators.sampling import sample_rows

    return validate(sample_rows(df, n, keys, seed), schema)


def check(df: DataFrame, schema: dict) -> None:
    """V1, fail-fast: an error on the first row that breaks a rule."""
    bad = validate(df, schema).where(F.size("errors") > 0).select("errors").take(1)
    if bad:
        raise ValueError("; ".join(bad[0].errors))


def json_type(kind: T.DataType) -> str:
    names = {T.StringType: "string", T.BinaryType: "string", T.BooleanType: "boolean", T.ArrayType: "array", T.StructType: "object", T.MapType: "object"}
    for cls, name in names.items():
        if isinstance(kind, cls):
            return name
    return "integer" if isinstance(kind, KINDS["integer"]) else "number"


def generate(kind: T.DataType, nullable: bool = False, all_required: bool = False, title: str | None = None, top: bool = True) -> dict:
    """V5: a schema of a type; fields that cannot be null are required.  V4: ``all_required`` and all nullable."""
    name = json_type(kind)
    maybe = nullable or (all_required and not top)
    out: dict = {"type": [name, "null"] if maybe else name}
    if isinstance(kind, T.ArrayType):
        out["items"] = generate(kind.elementType, kind.containsNull, all_required, top=False)
    if isinstance(kind, T.StructType):
        out["properties"] = {f.name: generate(f.dataType, f.nullable, all_required, top=False) for f in kind.fields}
        out["additionalProperties"] = False
        needed = [f.name for f in kind.fields if all_required or not f.nullable]
        if needed:
            out["required"] = needed
    if top:
        out["$schema"] = "http://json-schema.org/draft-07/schema#" if all_required else "https://json-schema.org/draft/2020-12/schema"
        if title:
            out["title"] = title
    return out


def clickhouse_type(kind: T.DataType, nullable: bool) -> str:
    """K8: arrays and tuples are never nullable themselves."""
    if isinstance(kind, T.ArrayType):
        return f"Array({clickhouse_type(kind.elementType, kind.containsNull)})"
    if isinstance(kind, T.StructType):
        return "Tuple(" + ", ".join(f"{f.name} {clickhouse_type(f.dataType, f.nullable)}" for f in kind.fields) + ")"
    names = {"string": "String", "binary": "String", "integer": "Int32", "long": "Int64", "float": "Float32", "double": "Float64", "boolean": "Bool"}
    base = names[kind.typeName()]
    return f"Nullable({base})" if nullable else base


def clickhouse_ddl(table: str, schema: T.StructType, keys: list[str]) -> str:
    """K8: CREATE TABLE text."""
    columns = ",\n".join(f"    `{f.name}` {clickhouse_type(f.dataType, f.nullable and f.name not in keys)}" for f in schema.fields)
    order = ", ".join(f"`{k}`" for k in keys) or "tuple()"
    return f"CREATE TABLE IF NOT EXISTS {table} (\n{columns}\n) ENGINE = MergeTree()\nORDER BY ({order})"


def bigquery_schema(schema: T.StructType) -> list[dict]:
    """The fields of a load job."""

    def one(name: str, kind: T.DataType, nullable: bool) -> dict:
        mode = "NULLABLE" if nullable else "REQUIRED"
        if isinstance(kind, T.ArrayType):
            return one(name, kind.elementType, False) | {"mode": "REPEATED"}
        if isinstance(kind, T.StructType):
            return {"name": name, "type": "RECORD", "mode": mode, "fields": [one(f.name, f.dataType, f.nullable) for f in kind.fields]}
        names = {"string": "STRING", "binary": "STRING", "integer": "INT64", "long": "INT64", "float": "FLOAT", "double": "FLOAT", "boolean": "BOOLEAN"}
        return {"name": name, "type": names[kind.typeName()], "mode": mode}

    return [one(f.name, f.dataType, f.nullable) for f in schema.fields]


def tree_text(schema: T.StructType, indent: int = 0) -> str:
    """An indented listing of a schema."""
    lines = []
    for f in schema.fields:
        kind = f.dataType
        depth = ""
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + "array of "
        name = "struct" if isinstance(kind, T.StructType) else kind.simpleString()
        lines.append(f"{'  ' * indent}{f.name}: {depth}{name}{'' if f.nullable else ' (required)'}")
        if isinstance(kind, T.StructType):
            lines.append(tree_text(kind, indent + 1))
    return "\n".join(lines)
