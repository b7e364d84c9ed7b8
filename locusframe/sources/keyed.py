"""Keyed tables (``.ht`` folders): block-compressed, range-partitioned rows with typed nesting.

Part files are read by place and written as streams (:mod:`.keyed_source`) where
Arrow knows the file system; elsewhere Spark reads parts as whole binary files and
writes them by its text writer (one row of raw bytes a part).  Metadata names the key and each
part's range of keys; parts that cannot hold a wanted key are not opened.  Parts
are pruned by a leading run of the key only: a later field counts while both
bounds agree on all fields before it.  Where a table has an index, a lookup of a
full key goes down its tree to the place of the row, and only the blocks from
there on are decompressed.
"""

from __future__ import annotations

import bisect
import gzip
import io
import json
import posixpath
import re
import struct as st
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.functions.predicates import KeyRange, in_ranges
from locusframe.sources.files import reachable

# Names of the physical types in the format.
PRIMITIVES = {"EBinary": T.StringType(), "EInt32": T.IntegerType(), "EInt64": T.LongType(), "EFloat32": T.FloatType(), "EFloat64": T.DoubleType(), "EBoolean": T.BooleanType()}
LOGICAL = {"EBinary": "String", "EInt32": "Int32", "EInt64": "Int64", "EFloat32": "Float32", "EFloat64": "Float64", "EBoolean": "Boolean"}
# Size of a block, and the names of the layers of buffers.
BLOCK = 1 << 16
BUFFERS = {"name": "LEB128BufferSpec", "child": {"name": "BlockingBufferSpec", "blockSize": BLOCK, "child": {"name": "ZstdBlockBufferSpec", "blockSize": BLOCK, "child": {"name": "StreamBlockBufferSpec"}}}}
# Layers of a stack of buffers that can be read, from the outside in; the first may be absent.
LAYERS = ("LEB128BufferSpec", "BlockingBufferSpec", "ZstdBlockBufferSpec", "StreamBlockBufferSpec")


@dataclass(frozen=True)
class Limits:
    """Longest text (in bytes) and longest array that a table may hold, for reading and writing alike."""

    binary: int = 1_000_000
    array: int = 100_000


LIMITS = Limits()


@dataclass
class Physical:
    kind: str
    required: bool
    fields: list[tuple[str, Physical]] = field(default_factory=list)


def parse_type(text: str) -> Physical:
    """``+EBaseStruct{a:EInt32,`odd name`:EArray[+EBinary]}``."""
    tokens = re.findall(r"`(?:[^`\\]|\\.)*`|[A-Za-z0-9_]+|[+{}\[\]:,]", text)
    if "".join(tokens) != re.sub(r"\s+(?=(?:[^`]*`[^`]*`)*[^`]*$)", "", text):
        raise ValueError(f"not a type: {text!r}")
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or want and tokens[at] != want:
            raise ValueError(f"type breaks off at token {at}: {text!r}")
        at += 1
        return tokens[at - 1]

    def one() -> Physical:
        required = tokens[at : at + 1] == ["+"]
        if required:
            take("+")
        name = take()
        if name in PRIMITIVES:
            return Physical(name, required)
        if name == "EArray":
            take("[")
            inner = one()
            take("]")
            return Physical(name, required, [("element", inner)])
        if name == "EBaseStruct":
            take("{")
            fields = []
            while tokens[at : at + 1] != ["}"]:
                key = take()
                take(":")
                fields.append((key.strip("`").replace("\\`", "`"), one()))
                if tokens[at : at + 1] == [","]:
                    take(",")
            take("}")
            return Physical(name, required, fields)
        raise ValueError(f"unknown type {name!r}")

    made = one()
    if at != len(tokens):
        raise ValueError(f"more after the type: {text!r}")
    return made


def spark_type(p: Physical) -> T.DataType:
    if p.kind == "EArray":
        return T.ArrayType(spark_type(p.fields[0][1]), not p.fields[0][1].required)
    if p.kind == "EBaseStruct":
        return T.StructType([T.StructField(n, spark_type(f), not f.required) for n, f in p.fields])
    return PRIMITIVES[p.kind]


def physical_type(kind: T.DataType, nullable: bool) -> Physical:
    if isinstance(kind, T.ArrayType):
        return Physical("EArray", not nullable, [("element", physical_type(kind.elementType, kind.containsNull))])
    if isinstance(kind, T.StructType):
        return Physical("EBaseStruct", not nullable, [(f.name, physical_type(f.dataType, f.nullable)) for f in kind.fields])
    for name, t in PRIMITIVES.items():
        if t == kind:
            return Physical(name, not nullable)
    raise ValueError(f"no such type in the format: {kind.simpleString()}")


def type_text(p: Physical) -> str:
    """The physical spelling."""
    plus = "+" if p.required else ""
    quote = lambda n: n if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n) else "`" + n.replace("`", "\\`") + "`"
    if p.kind == "EArray":
        return f"{plus}EArray[{type_text(p.fields[0][1])}]"
    if p.kind == "EBaseStruct":
        return plus + "EBaseStruct{" + ",".join(f"{quote(n)}:{type_text(f)}" for n, f in p.fields) + "}"
    return plus + p.kind


def logical_text(p: Physical) -> str:
    if p.kind == "EArray":
        return f"Array[{logical_text(p.fields[0][1])}]"
    if p.kind == "EBaseStruct":
        return "Struct{" + ",".join(f"{n}:{logical_text(f)}" for n, f in p.fields) + "}"
    return LOGICAL[p.kind]


# Bytes of rows


class Blocks:
    """A part file's blocks by place, found and decompressed when they are needed.

    Of blocks that are passed over only the head is read.  An empty block ends them.
    """

    def __init__(self, raw: bytes | BinaryIO):
        self.file = io.BytesIO(raw) if isinstance(raw, bytes) else raw
        self.size = self.file.seek(0, 2)
        #: Of each block known so far where it stands in the file, where its bytes start once decompressed, and how it ends in the file.
        self.at: list[int] = []
        self.start: list[int] = [0]
        self.end: list[int] = []
        self.next, self.ended = 0, False

    def find(self) -> bool:
        """Whether there is a further block; its head is read."""
        while not self.ended and self.next + 4 <= self.size:
            at = self.next
            self.file.seek(at)
            head = self.file.read(8)
            (n,) = st.unpack_from("<I", head)
            if at + 4 + n > self.size:
                raise EOFError("part file ends within a block")
            self.next = at + 4 + n
            if n >= 4:
                (size,) = st.unpack_from("<i", head, 4)
                if size == 0:
                    break
                self.at.append(at)
                self.end.append(self.next)
                self.start.append(self.start[-1] + size)
                return True
        self.ended = True
        return False

    def has(self, k: int) -> bool:
        while k >= len(self.at):
            if not self.find():
                return False
        return True

    def read(self, k: int) -> bytes:
        import zstandard

        self.file.seek(self.at[k] + 8)
        raw = self.file.read(self.end[k] - self.at[k] - 8)
        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=self.start[k + 1] - self.start[k])

    def holding(self, place: int) -> int:
        """The block that holds a place of the decompressed bytes."""
        while place >= self.start[-1] and self.find():
            pass
        if not 0 <= place < self.start[-1]:
            raise ValueError(f"no byte {place}")
        return bisect.bisect_right(self.start, place) - 1

    def named(self, offset: int) -> int:
        """The place behind an offset in an index: a block's own offset, or 16 bits within the block of the others."""
        for file_offset, within in ((offset, 0), (offset >> 16, offset & 0xFFFF)):
            while (not self.at or self.at[-1] < file_offset) and self.find():
                pass
            k = bisect.bisect_left(self.at, file_offset)
            if k < len(self.at) and self.at[k] == file_offset:
                return self.start[k] + within
        raise ValueError(f"no block at offset {offset}")


class Cursor:
    """A place in bytes; those of a part file come block by block."""

    def __init__(self, data: bytes | Blocks, place: int = 0, fixed: bool = False):
        #: Whether numbers have all their bytes (B7), not as few as they need.
        self.fixed = fixed
        self.data, self.at, self.blocks, self.next = data, place, None, 0
        if isinstance(data, Blocks):
            self.blocks = data
            self.next = data.holding(place) if place else 0
            self.data, self.at = b"", place - data.start[self.next]

    def more(self) -> bool:
        """Whether there is a further byte."""
        while self.at >= len(self.data) and self.blocks and self.blocks.has(self.next):
            self.at -= len(self.data)
            self.data = self.blocks.read(self.next)
            self.next += 1
        return self.at < len(self.data)

    def raw(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        while len(out) < n:
            if not self.more():
                raise EOFError("part file ends within a row")
            part = self.data[self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        return out

    def number(self, bits: int) -> int:
        """Unsigned LEB128, read as two's complement of so many bits; B7: or all its bytes, the lowest first."""
        if self.fixed:
            return int.from_bytes(self.raw(bits // 8), "little", signed=True)
        out, shift = 0, 0
        while True:
            b = self.raw(1)[0]
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        out &= (1 << bits) - 1
        return out - (1 << bits) if out >> (bits - 1) else out


def decoder(p: Physical, limits: Limits = LIMITS) -> Callable[[Cursor], object]:
    """A function that reads a value that is there."""
    if p.kind == "EInt32":
        return lambda c: c.number(32)
    if p.kind == "EInt64":
        return lambda c: c.number(64)
    if p.kind == "EFloat32":
        return lambda c: st.unpack("<f", c.raw(4))[0]
    if p.kind == "EFloat64":
        return lambda c: st.unpack("<d", c.raw(8))[0]
    if p.kind == "EBoolean":
        return lambda c: c.raw(1) != b"\0"
    if p.kind == "EBinary":

        def text(c: Cursor) -> str:
            n = c.number(32)
            if not 0 <= n <= limits.binary:
                raise ValueError(f"text of {n} bytes")
            return c.raw(n).decode("utf-8", "replace")

        return text
    if p.kind == "EArray":
        inner, maybe = decoder(p.fields[0][1], limits), not p.fields[0][1].required

        def array(c: Cursor) -> list:
            n = c.number(32)
            if not 0 <= n <= limits.array:
                raise ValueError(f"array of {n} elements")
            gone = c.raw((n + 7) // 8) if maybe else b""
            return [None if maybe and gone[i >> 3] >> (i & 7) & 1 else inner(c) for i in range(n)]

        return array
    parts = [(n, decoder(f, limits), not f.required) for n, f in p.fields]
    n_maybe = sum(m for *_, m in parts)

    def record(c: Cursor) -> dict:
        gone, k, out = c.raw((n_maybe + 7) // 8), 0, {}
        for name, read, maybe in parts:
            missing = maybe and gone[k >> 3] >> (k & 7) & 1
            k += maybe
            out[name] = None if missing else read(c)
        return out

    return record


def put_number(out: bytearray, x: int, bits: int) -> None:
    x &= (1 << bits) - 1
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)


def encoder(p: Physical, limits: Limits = LIMITS) -> Callable[[bytearray, object], None]:
    """The mirror of :func:`decoder`; a null in a required place is an error, and so is what could not be read back."""
    if p.kind in ("EInt32", "EInt64"):
        bits = int(p.kind[4:])
        return lambda o, x: put_number(o, x, bits)
    if p.kind in ("EFloat32", "EFloat64"):
        form = "<f" if p.kind == "EFloat32" else "<d"
        return lambda o, x: o.extend(st.pack(form, x))
    if p.kind == "EBoolean":
        return lambda o, x: o.append(1 if x else 0)
    if p.kind == "EBinary":

        def text(o: bytearray, x: str) -> None:
            raw = x.encode()
            if len(raw) > limits.binary:
                raise ValueError(f"text of {len(raw)} bytes; the limit is {limits.binary}")
            put_number(o, len(raw), 32)
            o.extend(raw)

        return text

    def bitmap(o: bytearray, missing: list[bool]) -> None:
        bits = sum(1 << i for i, m in enumerate(missing) if m)
        o.extend(bits.to_bytes((len(missing) + 7) // 8, "little"))

    if p.kind == "EArray":
        inner, maybe = encoder(p.fields[0][1], limits), not p.fields[0][1].required

        def array(o: bytearray, x: list) -> None:
            if len(x) > limits.array:
                raise ValueError(f"array of {len(x)} elements; the limit is {limits.array}")
            put_number(o, len(x), 32)
            if maybe:
                bitmap(o, [e is None for e in x])
            for e in x:
                if e is not None:
                    inner(o, e)
                elif not maybe:
                    raise ValueError("null in an array without nulls")

        return array
    parts = [(n, encoder(f, limits), not f.required) for n, f in p.fields]

    def record(o: bytearray, x: dict) -> None:
        bitmap(o, [x.get(n) is None for n, _, maybe in parts if maybe])
        for n, write, maybe in parts:
            if x.get(n) is not None:
                write(o, x[n])
            elif not maybe:
                raise ValueError(f"null in {n}")

    return record


#: Bytes of the longest text of a batch that columns are encoded with; batches with longer ones go row by row.
LONGEST = 256
#: (bytes, which of them count), a row each.
Cells = tuple[np.ndarray, np.ndarray]


def number_cells(x: np.ndarray) -> Cells:
    """:func:`put_number` of unsigned numbers."""
    n = max(1, -(-int(x.max(initial=0)).bit_length() // 7))
    rest = x[:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(7))
    there = rest != 0
    there[:, 0] = True
    more = np.zeros_like(there)
    more[:, :-1] = there[:, 1:]
    return (rest & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8) << 7, there


def cells(p: Physical, values: pa.Array, limits: Limits = LIMITS, there: np.ndarray | None = None) -> Cells | None:
    """What :func:`encoder` makes of each value, for all of them at once; None where it must say.

    Values that are null, or not ``there``, must not count for the caller.
    """
    n = len(values)
    if p.kind in ("EInt32", "EInt64"):
        kind = np.int32 if p.kind == "EInt32" else np.int64
        x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
        return number_cells(x.view(f"u{x.itemsize}").astype(np.uint64))
    if p.kind in ("EFloat32", "EFloat64"):
        x = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f4" if p.kind == "EFloat32" else "<f8")
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(n, x.itemsize)
        return raw, np.ones(raw.shape, bool)
    if p.kind == "EBoolean":
        raw = values.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)[:, None]
        return raw, np.ones(raw.shape, bool)
    if p.kind == "EBinary":
        texts = values.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        size = np.diff(ends)
        if size.max(initial=0) > min(LONGEST, limits.binary):
            return None
        raw = np.zeros((n, int(size.max(initial=0))), np.uint8)
        own = np.arange(raw.shape[1]) < size[:, None]
        if raw.size:
            raw[own] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        head, counts = number_cells(size.astype(np.uint64))
        return np.hstack([head, raw]), np.hstack([counts, own])
    if p.kind != "EBaseStruct":
        return None
    there = np.ones(n, bool) if there is None else there
    missing, parts = [], []
    for (_, f), column in zip(p.fields, values.flatten()):
        gone = column.is_null().to_numpy(zero_copy_only=False)
        if f.required and (gone & there).any():
            return None
        found = cells(f, column, limits, there & ~gone)
        if found is None:
            return None
        parts.append((found[0], found[1] & ~gone[:, None]))
        if not f.required:
            missing.append(gone)
    marks = np.packbits(np.stack(missing, 1), axis=1, bitorder="little") if missing else np.zeros((n, 0), np.uint8)
    parts.insert(0, (marks, np.ones(marks.shape, bool)))
    return np.hstack([a for a, _ in parts]), np.hstack([b for _, b in parts])


def blocked(data: bytes) -> bytes:
    """B8."""
    import zstandard

    z, out = zstandard.ZstdCompressor(level=3), []
    for at in [*range(0, len(data), BLOCK), None]:
        part = b"" if at is None else data[at : at + BLOCK]
        packed = st.pack("<i", len(part)) + z.compress(part)
        out.append(st.pack("<I", len(packed)) + packed)
    return b"".join(out)


def rows_of(raw: bytes | Blocks, p: Physical, fixed: bool = False, limits: Limits = LIMITS, place: int = 0) -> Iterator[dict]:
    """Rows of a part file from a place to its end; marks of absent rows are passed over."""
    c, read = Cursor(raw if isinstance(raw, Blocks) else Blocks(raw), place, fixed), decoder(p, limits)
    while c.more():
        if c.raw(1) != b"\0":
            yield read(c)


# Index: a tree of nodes over the keys of a part

# Names of fields of nodes, and the marks of their kinds.
LEAF, INTERNAL = b"\0", b"\1"


@dataclass(frozen=True)
class IndexSpec:
    folder: str
    leaf: Physical
    internal: Physical
    fixed: bool


def order_of(value) -> tuple:
    """Keys compare field by field, texts by their characters, contigs by their numbers first; a null comes last."""
    if isinstance(value, dict):
        if list(value) == ["contig", "position"]:
            return (contig_order(value["contig"]), order_of(value["position"]))
        return tuple(order_of(x) for x in value.values())
    return (value is None, value)


# Contigs after the numbered ones, in order.
_LETTERED = {"X": 23, "Y": 24, "M": 25, "MT": 25}


def contig_order(contig: str | None) -> tuple:
    """Numbered contigs, X, Y and M, then others by name; a null comes last."""
    if contig is None:
        return (2, 0, "")
    name = contig.removeprefix("chr")
    n = int(name) if name.isdigit() else _LETTERED.get(name)
    return (0, n, "") if n is not None else (1, 0, contig)


def node_at(blocks: Blocks, spec: IndexSpec, offset: int) -> tuple[bool, dict]:
    """Whether a node is a leaf, and its fields."""
    c = Cursor(blocks, blocks.named(offset), spec.fixed)
    c.more()
    kind = c.raw(1)
    if kind not in (LEAF, INTERNAL):
        raise ValueError(f"unknown node {kind!r}")
    return kind == LEAF, decoder(spec.leaf if kind == LEAF else spec.internal)(c)


def find_row(blocks: Blocks, spec: IndexSpec, root: int, height: int, key: dict) -> int | None:
    """Where the row of a key starts in its part's decompressed bytes, or None.

    From each node it goes down to the last child whose first key is not above the key.
    """
    wanted, offset = order_of(key), root
    for _ in range(height - 1):
        leaf, node = node_at(blocks, spec, offset)
        if leaf:
            raise ValueError("a leaf above the lowest level")
        below = [c for c in node["children"] if list(c["first_key"]) == list(key) and order_of(c["first_key"]) <= wanted]
        offset = (below or node["children"])[-1 if below else 0]["index_file_offset"]
    leaf, node = node_at(blocks, spec, offset)
    if not leaf:
        raise ValueError("no leaf at the lowest level")
    return next((e["offset"] for e in node["keys"] if list(e["key"]) == list(key) and order_of(e["key"]) == wanted), None)


# Metadata and pruning


@dataclass(frozen=True)
class Meta:
    path: str
    key: tuple[str, ...]
    row_type: Physical
    parts: tuple[str, ...]
    bounds: tuple[dict, ...]
    index: IndexSpec | None = None
    fixed: bool = False


def _document(spark: SparkSession, path: str) -> dict:
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)


def fixed_numbers(spec: dict) -> bool:
    """Whether a stack of buffers keeps numbers at their full size; stacks that cannot be read are an error."""
    names, at = [], spec
    while at:
        names.append(at["name"])
        at = at.get("child")
    if tuple(names) not in (LAYERS, LAYERS[1:]):
        raise ValueError(f"buffers not supported: {names}")
    return names[0] != LAYERS[0]


def metadata(spark: SparkSession, path: str, component: str = "rows") -> Meta:
    m = _document(spark, f"{path}/{component}/metadata.json.gz")
    codec, index = m["_codecSpec"], m.get("_indexSpec")
    if index:
        leaf, internal = index["_leafCodec"], index["_internalNodeCodec"]
        folder = f"{path}/" + posixpath.normpath(f"{component}/{index['_relPath']}")
        index = IndexSpec(folder, parse_type(leaf["_eType"]), parse_type(internal["_eType"]), fixed_numbers(leaf["_bufferSpec"]))
    return Meta(path, tuple(m["_key"]), parse_type(codec["_eType"]), tuple(m["_partFiles"]), tuple(m["_jRangeBounds"]), index or None, fixed_numbers(codec["_bufferSpec"]))


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row of each part with its bounds."""
    m = metadata(spark, path)
    rows = [(i, p, json.dumps(b["start"]), json.dumps(b["end"]), list(m.key), m.index is not None, type_text(m.row_type)) for i, (p, b) in enumerate(zip(m.parts, m.bounds))]
    return spark.createDataFrame(rows, "part int, file string, low string, high string, key array<string>, indexed boolean, row_type string")


def _leaves(value, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], object]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _leaves(v, (*path, k))]
    return [(path, value)]


def may_hold(bound: dict, key: tuple[str, ...], ranges: list[KeyRange]) -> bool:
    """Whether a part with these bounds can hold a row within all ranges."""
    low = [x for k in key if k in bound["start"] for x in _leaves(bound["start"][k], (k,))]
    high = dict(x for k in key if k in bound["end"] for x in _leaves(bound["end"][k], (k,)))
    for path, a in low:
        b = high.get(path)
        if a is None or b is None:
            return True
        for r in ranges:
            if r.path != path:
                continue
            for edge, beyond in ((r.low, lambda e: b < e.value or not e.inclusive and b == e.value), (r.high, lambda e: a > e.value or not e.inclusive and a == e.value)):
                if edge is not None and type(edge.value) in (type(a), type(b)) and beyond(edge):
                    return False
        if a != b:
            return True
    return True


def prune(m: Meta, ranges: list[KeyRange] = (), intervals: list[tuple[str, int, int]] | None = None) -> list[int]:
    """Parts to open; intervals count where the key starts with ``locus``."""
    out = []
    for i, bound in enumerate(m.bounds):
        if not may_hold(bound, m.key, list(ranges)):
            continue
        if intervals is not None and m.key[:1] == ("locus",):
            fits = any(
                may_hold(bound, m.key, [KeyRange.of("locus.contig", "=", c), KeyRange.between("locus.position", a, b)])
                for c, a, b in intervals
            )
            if not fits:
                continue
        out.append(i)
    return out


# Reading and writing


def read(spark: SparkSession, path: str, ranges: list[KeyRange] = (), intervals: list[tuple[str, int, int]] | None = None, parts: list[int] | None = None, component: str = "rows", limits: Limits = LIMITS, ordered: bool = False) -> DataFrame:
    """Rows of a table; ranges prune parts and filter rows; on demand (S3) in the order of the key."""
    m = metadata(spark, path, component)
    chosen = parts if parts is not None else prune(m, ranges, intervals) if component == "rows" else range(len(m.parts))
    schema = spark_type(m.row_type)
    files = [f"{path}/{component}/parts/{m.parts[i]}" for i in chosen]
    if not files or not schema.fields:
        return spark.createDataFrame([], schema)
    if reachable(path):
        from locusframe.sources import keyed_source

        found = in_ranges(keyed_source.load(spark, m, component, list(chosen), list(ranges), intervals, limits), *ranges)
        return found.orderBy(*m.key) if ordered and m.key else found
    p = m.row_type
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for row in rows_of(raw.as_py(), p, m.fixed, limits):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    found = in_ranges(spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, schema), *ranges)
    return found.orderBy(*m.key) if ordered and m.key else found


class Folder:
    """A folder of any file system that Spark knows, for the few small files of a table."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self.make = path, jvm.org.apache.hadoop.fs.Path
        self.fs = self.make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.make(f"{self.path}/{name}")

    def put(self, name: str, data: bytes) -> None:
        out = self.fs.create(self.at(name), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.at(new).getParent())
        self.fs.delete(self.at(new), False)
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"cannot rename {self.path}/{old}")

    def only_file(self, name: str) -> str:
        """The name of the one data file of a folder."""
        found = [f.getPath().getName() for f in self.fs.listStatus(self.at(name)) if not f.getPath().getName().startswith(("_", "."))]
        if len(found) != 1:
            raise OSError(f"{len(found)} files in {self.path}/{name}")
        return f"{name}/{found[0]}"

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def write(df: DataFrame, path: str, key: list[str], partitions: int | None = None, limits: Limits = LIMITS) -> None:
    """K7: a table sorted by its key, with an index of each part.

    Tasks stream their parts, of any size, and a commit names them
    (:mod:`locusframe.sources.keyed_source`).
    """
    if not reachable(path):
        return write_whole(df, path, key, partitions, limits)
    from locusframe.sources import keyed_source

    dealt = df.repartitionByRange(*([partitions] if partitions else []), *key) if key else df.repartition(partitions) if partitions else df
    keyed_source.save(dealt.sortWithinPartitions(*key) if key else dealt, path, key, limits)


def write_whole(df: DataFrame, path: str, key: list[str], partitions: int | None = None, limits: Limits = LIMITS) -> None:
    """K7 on file systems that only Spark reaches: a table sorted by its key, without an index.

    Tasks make the bytes of whole parts, which are written once as Parquet, so
    that parts and their bounds belong together whatever is run again; then each
    part becomes a file of its own, and gets its name.  A part must fit in a row.
    """
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    work = f".making-{uuid.uuid4().hex}"
    p = physical_type(df.schema, False)
    if partitions:
        dealt = df.repartitionByRange(partitions, *key)
    elif key:
        dealt = df.repartitionByRange(*key)
    else:
        dealt = df

    def run(batches):
        put, out, n, first, last = encoder(p, limits), bytearray(), 0, None, None
        index = TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.to_pylist():
                out.append(1)
                put(out, row)
                last = {k: row[k] for k in key}
                first = first if n else last
                n += 1
        if n:
            out.append(0)
            row = {"i": [index], "first": [json.dumps(first)], "last": [json.dumps(last)], "n": [n], "content": [blocked(bytes(out))]}
            yield pa.RecordBatch.from_pydict(row, schema=told)

    told = pa.schema([("i", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("content", pa.binary())])
    sorted_ = dealt.sortWithinPartitions(*key) if key else dealt
    sorted_.mapInArrow(run, "i int, first string, last string, n long, content binary").write.parquet(f"{path}/{work}/bytes")
    whole = spark.read.parquet(f"{path}/{work}/bytes")
    # Spark's text writer passes bytes on as they are; the line's end comes after the block that ends a part.
    whole.select("i", F.col("content").cast("string")).write.partitionBy("i").text(f"{path}/{work}/parts")
    # One row a part.
    made = whole.select("i", "first", "last", "n").orderBy("i").collect()
    folder.drop("rows")
    for r in made:
        folder.move(folder.only_file(f"{work}/parts/i={r.i}"), f"rows/parts/part-{r.i:05d}")
    for name, data in documents(p, key, [f"part-{r.i:05d}" for r in made], [(json.loads(r.first), json.loads(r.last)) for r in made], sum(r.n for r in made)).items():
        folder.put(name, data)
    folder.drop(work)
    folder.put("_SUCCESS", b"")


def documents(p: Physical, key: list[str], parts: list[str], bounds: list[tuple[dict, dict]], n: int, index: dict | None = None) -> dict[str, bytes]:
    """The small files of a table by name."""
    # The keys of the metadata.
    codec = {"name": "TypedCodecSpec", "_bufferSpec": BUFFERS}
    told = [{"start": a, "end": b, "includeStart": True, "includeEnd": True} for a, b in bounds]
    rows = {"name": "OrderedRVDSpec2", "_key": key, "_codecSpec": codec | {"_eType": type_text(p), "_vType": logical_text(p)}, "_indexSpec": index, "_partFiles": parts, "_jRangeBounds": told, "_attrs": {"rows": n}}
    none = Physical("EBaseStruct", True)
    globals_ = rows | {"_key": [], "_codecSpec": codec | {"_eType": type_text(none), "_vType": logical_text(none)}, "_indexSpec": None, "_partFiles": ["part-0"], "_attrs": {}, "_jRangeBounds": [{"start": {}, "end": {}, "includeStart": True, "includeEnd": True}]}
    out = {f"{name}/metadata.json.gz": gzip.compress(json.dumps(m).encode()) for name, m in (("rows", rows), ("globals", globals_))}
    return out | {"globals/parts/part-0": blocked(b"\1\0")}


def nested(key: dict) -> dict:
    """Names with double underscores as fields within fields."""
    out: dict = {}
    for name, value in key.items():
        at, parts = out, name.split("__")
        for part in parts[:-1]:
            at = at.setdefault(part, {})
        at[parts[-1]] = value
    return out


def lookup(spark: SparkSession, path: str, **key) -> DataFrame:
    """The first row of a full key; only parts that can hold it are opened.

    With an index (B13 to B15) a task reads the index of a part, and another
    decodes the one row from its place on; else the part's rows are filtered.
    """
    ranges = [KeyRange.of(k.replace("__", "."), "=", x) for k, x in key.items()]
    m, wanted = metadata(spark, path), nested(key)
    if reachable(path):
        from locusframe.sources import keyed_source

        full = m.index is not None and list(wanted) == list(m.key)
        return in_ranges(keyed_source.load(spark, m, "rows", prune(m, ranges), ranges, None, LIMITS, wanted if full else None), *ranges).limit(1)
    if m.index is None or list(wanted) != list(m.key):
        return read(spark, path, ranges).limit(1)
    spec, schema = m.index, spark_type(m.row_type)
    files = lambda paths: spark.read.format("binaryFile").load(paths).select("content")
    for k in prune(m, ranges):
        folder = f"{spec.folder}/{m.parts[k]}.idx"
        about = _document(spark, f"{folder}/metadata.json.gz")
        root, height = about["rootOffset"], about["height"]

        def descend(batches):
            for batch in batches:
                for raw in batch.column(0):
                    place = find_row(Blocks(raw.as_py()), spec, root, height, wanted)  # noqa: B023
                    yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64())})

        # One number.
        place = files([f"{folder}/{about['indexPath']}"]).mapInArrow(descend, "place long").first().place
        if place is None:
            continue
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def decode(batches):
            for batch in batches:
                for raw in batch.column(0):
                    c = Cursor(Blocks(raw.as_py()), place, m.fixed)  # noqa: B023
                    c.more()
                    if c.raw(1) != b"\0":
                        yield pa.RecordBatch.from_pylist([decoder(m.row_type)(c)], schema=arrow)  # noqa: B023

        return files([f"{path}/rows/parts/{m.parts[k]}"]).mapInArrow(decode, schema)
    return spark.createDataFrame([], schema)


def with_part(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.spark_partition_id())
