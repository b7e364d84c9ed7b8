"""Conjunctive range predicates: text to a typed column expression.

A clause is ``path operator literal``; clauses are joined by AND.  Literals are
read as int, long, double, true or false, or text.  In mode ``sql`` (default) a
literal is cast to the column's type and a null drops the row.  In mode
``compat`` a null, an unknown path or a literal of another type keeps the row.
In mode ``calls`` (F7) an unknown path, or a null above the field, drops it, and
a null field or a literal of another type counts as equal to the literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = (">=", "<=", "!=", ">", "<", "=")
#: AND between clauses: what follows holds no end of a quotation.
AND = re.compile(r"""\s+AND\s+(?=(?:[^'"]*(?:'[^']*'|"[^"]*"))*[^'"]*$)""", re.I)
CLAUSE = re.compile(r"^\s*([^<>=!\s]+)\s*(>=|<=|!=|==|>|<|=|\bgte\b|\blte\b)\s*(.*?)\s*$", re.S)
NUMBER = re.compile(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


@dataclass(frozen=True)
class Clause:
    path: tuple[str, ...]
    op: str
    value: int | float | bool | str


@dataclass(frozen=True)
class Bound:
    value: object
    inclusive: bool = True


@dataclass(frozen=True)
class KeyRange:
    """A range over a path; a missing bound is open."""

    path: tuple[str, ...]
    low: Bound | None = None
    high: Bound | None = None

    @classmethod
    def of(cls, path: str, op: str, value) -> KeyRange:
        parts = tuple(path.split("."))
        return {
            "=": cls(parts, Bound(value), Bound(value)),
            ">=": cls(parts, Bound(value), None),
            ">": cls(parts, Bound(value, False), None),
            "<=": cls(parts, None, Bound(value)),
            "<": cls(parts, None, Bound(value, False)),
        }[op]

    @classmethod
    def between(cls, path: str, low, high, inclusive: bool = True) -> KeyRange:
        return cls(tuple(path.split(".")), Bound(low, inclusive), Bound(high, inclusive))


def literal(text: str) -> int | float | bool | str:
    """int, double, boolean or text, in this order."""
    text = text.strip()
    if re.fullmatch(r"[+-]?\d+", text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if NUMBER.match(text):
        return float(text)
    if text in ("true", "false"):
        return text == "true"
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text


def clause(text: str) -> Clause:
    """one clause; an unknown operator is an error."""
    m = CLAUSE.match(text)
    if not m or not m[3]:
        raise ValueError(f"not a condition: {text!r}")
    op = {"==": "=", "gte": ">=", "lte": "<="}.get(m[2], m[2])
    return Clause(tuple(m[1].split(".")), op, literal(m[3]))


def request_clause(text: str) -> Clause:
    """a clause as it comes in a request: the first of these operators cuts it, and no blank is cut from either side."""
    for op in (">=", "<=", ">", "<", "="):
        path, found, value = text.partition(op)
        if found:
            # What has blanks around it is a text, not a number.
            return Clause(tuple(path.split(".")), op, literal(value) if value == value.strip() and value[:1] not in ("'", '"') else value)
    raise ValueError(f"not a condition: {text!r}")


def field_type(schema: T.StructType, path: tuple[str, ...]) -> T.DataType | None:
    kind: T.DataType = schema
    for name in path:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def field(path: tuple[str, ...]) -> Column:
    """a nested field; names are quoted."""
    return F.col(".".join(f"`{p}`" for p in path))


def comparable(value, kind: T.DataType) -> bool:
    """Whether a literal has the column's own kind, without a cast."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    if isinstance(value, float):
        return isinstance(kind, T.DoubleType)
    return isinstance(kind, T.StringType)


def condition(df: DataFrame, c: Clause, mode: str = "sql") -> Column:
    kind = field_type(df.schema, c.path)
    if kind is None:
        if mode in ("compat", "calls"):
            return F.lit(mode == "compat")
        raise ValueError(f"no field {'.'.join(c.path)}")
    # A number wider than an integer column is compared as double, so that x > 1.5 keeps its sense.
    target = T.DoubleType() if isinstance(c.value, float) and comparable(1, kind) else kind
    value = F.lit(c.value).cast(target)
    at = field(c.path)
    made = {"=": at == value, "!=": at != value, ">": at > value, ">=": at >= value, "<": at < value, "<=": at <= value}[c.op]
    if mode == "compat":
        return F.coalesce(made, F.lit(True)) if comparable(c.value, kind) else F.lit(True)
    if mode == "calls":
        equal = F.lit(c.op in ("=", ">=", "<="))
        told = F.coalesce(made, equal) if comparable(c.value, kind) else equal
        return told & field(c.path[:-1]).isNotNull() if len(c.path) > 1 else told
    return made


def key_ranges(*conditions: str) -> list[KeyRange]:
    """the conditions that are ranges, for pruning; others stay with :func:`where`."""
    made = [clause(p) for text in conditions for p in AND.split(text)]
    return [KeyRange.of(".".join(c.path), c.op, c.value) for c in made if c.op != "!="]


def where(df: DataFrame, *conditions: str, mode: str = "sql", request: bool = False) -> DataFrame:
    """rows that meet all conditions; each may join several by AND, but for those of a request (F2)."""
    found = [request_clause(t) for t in conditions] if request else [clause(p) for text in conditions for p in AND.split(text)]
    made = [condition(df, c, mode) for c in found]
    return df.where(reduce(lambda a, b: a & b, made)) if made else df


def in_ranges(df: DataFrame, *ranges: KeyRange, mode: str = "sql") -> DataFrame:
    """rows within all ranges."""
    made = []
    for r in ranges:
        for bound, ops in ((r.low, (">", ">=")), (r.high, ("<", "<="))):
            if bound is not None:
                made.append(condition(df, Clause(r.path, ops[bound.inclusive], bound.value), mode))
    return df.where(reduce(lambda a, b: a & b, made)) if made else df
