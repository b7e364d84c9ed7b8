"""Keyed tables as a data source: parts read by place, and written as streams with a commit.

Reading: a partition is a part with the spans of its leading key field that are
wanted.  Blocks are read one after the other and dropped once decoded, so a part
of any size takes little memory.  With an index a span is entered near its first row: the
tree is descended, and blocks before it are passed over by their heads; reading
stops behind the span's last row.  A full key (B13 to B15) goes down the tree to
its row.  Filters of a plan that bound a key prune parts further.

Writing: a task streams its rows, encoded by columns of a batch where no field is an array or a long text,
into blocks of a file of its own, and the keys with
their places into the leaves of an index, whose upper levels are built from the
lower ones at the end.  What it made goes to the commit as a few names and keys;
files of tasks that failed or ran twice are in no message, and the folder they
stand in goes.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from locusframe.functions.predicates import KeyRange
from locusframe.sources import files, keyed

NAME = "keyed_table"
BATCH = 4096
#: Keys of a leaf of an index, and children of a node.
BRANCHES = 1024

#: A span of the leading key field: (lowest, highest), both included; None is open.
Span = tuple[object, object]


@dataclass
class Part(InputPartition):
    file: str
    index: str | None
    bound: dict
    spans: list[Span] | None = None

    def __post_init__(self):
        super().__init__(self.file)


def merged(spans: list[Span]) -> list[Span]:
    """Spans in order, those that meet as one."""
    out: list[Span] = []
    for low, high in sorted(spans, key=lambda s: keyed.order_of(s[0])):
        if out and keyed.order_of(low) <= keyed.order_of(out[-1][1]):
            if keyed.order_of(high) > keyed.order_of(out[-1][1]):
                out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def wanted_spans(key: tuple[str, ...], row: keyed.Physical, ranges: list[KeyRange], intervals: list[tuple[str, int, int]] | None) -> list[Span] | None:
    """What is wanted of the leading key field; None is all of it."""
    if not key:
        return None
    if key[0] == "locus" and intervals is not None:
        place = lambda c, x: {"contig": c, "position": x}
        return merged([(place(c, a), place(c, b)) for c, a, b in intervals])
    kind = dict(row.fields)[key[0]].kind
    known = {"EInt32": int, "EInt64": int, "EBinary": str}.get(kind)
    low = high = None
    for r in ranges:
        if r.path != key[:1] or known is None:
            continue
        if r.low is not None and type(r.low.value) is known and (low is None or r.low.value > low):
            low = r.low.value
        if r.high is not None and type(r.high.value) is known and (high is None or r.high.value < high):
            high = r.high.value
    return None if low is None and high is None else [(low, high)]


def entry_place(blocks: keyed.Blocks, spec: keyed.IndexSpec, root: int, height: int, name: str, low) -> int:
    """A place to read from, at or before the first row whose field is not below ``low``."""
    least, offset = keyed.order_of(low), root
    for _ in range(height):
        leaf, node = keyed.node_at(blocks, spec, offset)
        below = node["keys" if leaf else "children"]
        firsts = [keyed.order_of((x["key"] if leaf else x["first_key"])[name]) for x in below]
        if firsts != sorted(firsts):
            # Keys in an order that is not ours.
            return 0
        k = max([i for i, first in enumerate(firsts) if first < least], default=0)
        if leaf:
            return below[k]["offset"]
        offset = below[k]["index_file_offset"]
    return 0


def rows_within(part: Part, row: keyed.Physical, key: tuple[str, ...], fixed: bool, limits: keyed.Limits, spec: keyed.IndexSpec | None) -> Iterator[dict]:
    """Rows of a part within its spans."""
    with files.opened(part.file) as f:
        if part.spans is None:
            yield from keyed.rows_of(keyed.Blocks(f), row, fixed, limits)
            return
        blocks, about, tree = keyed.Blocks(f), None, None
        if part.index and spec:
            about = json.loads(gzip.decompress(files.whole(f"{part.index}/metadata.json.gz")))
            tree = keyed.Blocks(files.opened(f"{part.index}/{about['indexPath']}"))
        for low, high in part.spans:
            place = entry_place(tree, spec, about["rootOffset"], about["height"], key[0], low) if tree and low is not None else 0
            within = False
            for r in keyed.rows_of(blocks, row, fixed, limits, place):
                value = r[key[0]]
                at = keyed.order_of(value)
                if (low is None or at >= keyed.order_of(low)) and (high is None or at <= keyed.order_of(high)):
                    within = True
                    yield r
                elif within or high is not None and at > keyed.order_of(high) and key[0] != "locus":
                    # Sorted by key: nothing further is within.
                    break
                elif key[0] == "locus" and value is not None and value["contig"] == high["contig"] and value["position"] > high["position"]:
                    break


class KeyedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        plan = json.loads(options["plan"])
        self.parts, self.key, self.fixed, self.row = plan["parts"], tuple(plan["key"]), plan["fixed"], plan["row"]
        self.limits, self.index, self.full = keyed.Limits(*plan["limits"]), plan["index"], plan["full"]
        self.intervals = plan["intervals"]
        self.ranges = [KeyRange.of(".".join(p), op, x) for p, op, x in plan["ranges"]]

    def partitions(self):
        spans = wanted_spans(self.key, keyed.parse_type(self.row), self.ranges, self.intervals)
        found = []
        for p in self.parts:
            if not keyed.may_hold(p["bound"], self.key, self.ranges):
                continue
            own = spans
            if spans is not None and self.key[0] == "locus":
                fits = lambda s: keyed.may_hold(p["bound"], self.key, [KeyRange.of("locus.contig", "=", s[0]["contig"]), KeyRange.between("locus.position", s[0]["position"], s[1]["position"])])  # noqa: E731, B023
                own = [s for s in spans if fits(s)]
                if not own:
                    continue
            found.append(Part(p["file"], p["index"], p["bound"], own))
        return found or [Part("", None, {})]

    def spec(self) -> keyed.IndexSpec | None:
        return keyed.IndexSpec("", keyed.parse_type(self.index[0]), keyed.parse_type(self.index[1]), self.index[2]) if self.index else None

    def found(self, part: Part) -> Iterator[dict]:
        row, spec = keyed.parse_type(self.row), self.spec()
        if not part.file:
            return
        if self.full is None or not part.index:
            yield from rows_within(part, row, self.key, self.fixed, self.limits, spec)
            return
        about = json.loads(gzip.decompress(files.whole(f"{part.index}/metadata.json.gz")))
        with files.opened(f"{part.index}/{about['indexPath']}") as f:
            place = keyed.find_row(keyed.Blocks(f), spec, about["rootOffset"], about["height"], self.full)
        if place is not None:
            with files.opened(part.file) as f:
                yield from next(([r] for r in keyed.rows_of(keyed.Blocks(f), row, self.fixed, self.limits, place)), [])

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, rows = to_arrow_schema(self.schema), []
        for r in self.found(partition):
            rows.append(r)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class PushedReader(KeyedReader):
    """The reader where the session hands filters down; Spark takes no reader that could have them where it does not."""

    def pushFilters(self, filters):
        names = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in names and f.attribute[0] in self.key:
                self.ranges.append(KeyRange.of(".".join(f.attribute), names[type(f)], f.value))
            # Parts are pruned, rows are not.
            yield f


class BlockFile:
    """Bytes into compressed blocks of a file, as they come."""

    def __init__(self, path: str):
        import zstandard

        self.out, self.z = files.created(path), zstandard.ZstdCompressor(level=3)
        self.held = bytearray()
        #: Where the block that is being filled will stand in the file, and the bytes of those before once decompressed.
        self.block = self.before = 0

    def put(self, data: bytes | bytearray) -> None:
        self.held += data
        whole = len(self.held) // keyed.BLOCK * keyed.BLOCK
        for at in range(0, whole, keyed.BLOCK):
            self._write(bytes(self.held[at : at + keyed.BLOCK]))
        del self.held[:whole]

    def _write(self, data: bytes) -> None:
        packed = len(data).to_bytes(4, "little", signed=True) + self.z.compress(data)
        self.out.write(len(packed).to_bytes(4, "little") + packed)
        self.block += 4 + len(packed)
        self.before += len(data)

    @property
    def place(self) -> int:
        """Bytes so far, before compression."""
        return self.before + len(self.held)

    @property
    def name(self) -> int:
        """The next byte's offset as an index has it."""
        return self.block << 16 | len(self.held)

    def close(self) -> None:
        if self.held:
            self._write(bytes(self.held))
        self._write(b"")
        self.out.close()


def index_types(row: keyed.Physical, key: list[str]) -> tuple[keyed.Physical, keyed.Physical]:
    """Leaves and nodes above them."""
    of = dict(row.fields)
    struct = lambda **fields: keyed.Physical("EBaseStruct", True, list(fields.items()))
    long, keys, none = keyed.Physical("EInt64", True), struct(**{k: of[k] for k in key}), struct()
    array = lambda x: keyed.Physical("EArray", True, [("element", x)])
    leaf = struct(first_idx=long, keys=array(struct(key=keys, offset=long, annotation=none)))
    child = struct(index_file_offset=long, first_idx=long, first_key=keys, first_record_offset=long, first_annotation=none)
    return leaf, struct(children=array(child))


class Tree:
    """An index, leaf by leaf; upper levels come from lower ones.

    Of a level below only its nodes' first keys are held: one in ``BRANCHES`` of the level below that.
    """

    def __init__(self, path: str, row: keyed.Physical, key: list[str]):
        leaf, node = index_types(row, key)
        # Nodes are bounded by their branches, not by the limit for rows.
        limits = keyed.Limits(1 << 30, 1 << 30)
        self.file, self.key = BlockFile(path), key
        self.key_type = dict(dict(leaf.fields)["keys"].fields[0][1].fields)["key"]
        self.put_entry, self.put_node = keyed.encoder(dict(leaf.fields)["keys"].fields[0][1], limits), keyed.encoder(node, limits)
        #: Of the leaf that is being filled its entries' bytes, how many there are, and the first one's key and place.
        self.held, self.count, self.first = bytearray(), 0, ({}, 0)
        self.level: list[dict] = []
        self.n = 0

    def add(self, row: dict, place: int) -> None:
        data = bytearray()
        key = {k: row[k] for k in self.key}
        self.put_entry(data, {"key": key, "offset": place, "annotation": {}})
        self._take(data, 1, key, place)

    def add_all(self, batch: pa.RecordBatch, key_cells: keyed.Cells, places: np.ndarray) -> None:
        """Rows of a batch, whose keys are encoded."""
        at, counts = keyed.number_cells(places.astype(np.uint64))
        raw, there = np.hstack([key_cells[0], at]), np.hstack([key_cells[1], counts])
        ends = np.r_[0, there.sum(1).cumsum()].tolist()
        data, k = raw[there].tobytes(), 0
        while k < len(places):
            n = min(BRANCHES - self.count, len(places) - k)
            key = batch.select(self.key).slice(k, 1).to_pylist()[0] if not self.count else {}
            self._take(data[ends[k] : ends[k + n]], n, key, int(places[k]))
            k += n

    def _take(self, data: bytes | bytearray, n: int, key: dict, place: int) -> None:
        if not self.count:
            self.first = key, place
        self.held += data
        self.count += n
        self.n += n
        if self.count == BRANCHES:
            self._leaf()

    def _child(self, first_idx: int, key: dict, place: int) -> dict:
        return {"index_file_offset": self.file.name, "first_idx": first_idx, "first_key": key, "first_record_offset": place, "first_annotation": {}}

    def _leaf(self) -> None:
        first = self.n - self.count
        self.level.append(self._child(first, *self.first))
        data = bytearray(keyed.LEAF)
        keyed.put_number(data, first, 64)
        keyed.put_number(data, self.count, 32)
        self.file.put(data + self.held)
        self.held, self.count = bytearray(), 0

    def close(self) -> dict:
        """What the index's own metadata say."""
        if self.count:
            self._leaf()
        height = 1
        while len(self.level) > 1:
            above = []
            for k in range(0, len(self.level), BRANCHES):
                some = self.level[k : k + BRANCHES]
                above.append(self._child(some[0]["first_idx"], some[0]["first_key"], some[0]["first_record_offset"]))
                data = bytearray(keyed.INTERNAL)
                self.put_node(data, {"children": some})
                self.file.put(data)
            self.level = above
            height += 1
        self.file.close()
        # The keys of an index's metadata.
        return {"fileVersion": 67328, "branchingFactor": BRANCHES, "height": height, "keyType": "", "annotationType": "Struct{}", "nKeys": self.n, "indexPath": "index", "rootOffset": self.level[0]["index_file_offset"], "attributes": {}}


@dataclass
class Made(WriterCommitMessage):
    part: int
    name: str = ""
    first: str = ""
    last: str = ""
    rows: int = 0


class KeyedWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.key = options["path"], json.loads(options["key"])
        self.limits = keyed.Limits(*json.loads(options["limits"]))
        self.row = keyed.physical_type(schema, False)
        self.work = f"{self.path}/.making-{uuid.uuid4().hex}"

    def write(self, iterator):
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        put, out, tree, made = keyed.encoder(self.row, self.limits), None, None, Made(part)
        last = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                out = BlockFile(f"{self.work}/rows/parts/{name}")
                tree = Tree(f"{self.work}/index/{name}.idx/index", self.row, self.key) if self.key else None
                made.name, made.first = name, json.dumps(batch.select(self.key).slice(0, 1).to_pylist()[0] if self.key else {})
            made.rows += batch.num_rows
            last = batch.slice(batch.num_rows - 1)
            found = keyed.cells(self.row, batch.to_struct_array(), self.limits)
            keys = keyed.cells(tree.key_type, batch.select(self.key).to_struct_array()) if tree and found else None
            if found is None or tree and keys is None:
                for row in batch.to_pylist():
                    if tree:
                        tree.add(row, out.place)
                    data = bytearray(b"\1")
                    put(data, row)
                    out.put(data)
                continue
            ones = np.ones((batch.num_rows, 1), np.uint8)
            raw, there = np.hstack([ones, found[0]]), np.hstack([ones.astype(bool), found[1]])
            if tree:
                tree.add_all(batch, keys, out.place + np.r_[0, there.sum(1).cumsum()[:-1]])
            out.put(raw[there].tobytes())
        if out is not None:
            made.last = json.dumps(last.select(self.key).to_pylist()[0] if self.key else {})
            out.put(b"\0")
            out.close()
            if tree:
                files.put(f"{self.work}/index/{name}.idx/metadata.json.gz", gzip.compress(json.dumps(tree.close()).encode()))
        return made

    def commit(self, messages):
        made = sorted((m for m in messages if m and m.rows), key=lambda m: m.part)
        ready = f"{self.work}/ready"
        for m in made:
            files.move(f"{self.work}/rows/parts/{m.name}", f"{ready}/rows/parts/{m.name}")
            if self.key:
                files.move(f"{self.work}/index/{m.name}.idx", f"{ready}/index/{m.name}.idx")
        leaf, node = index_types(self.row, self.key)
        codec = lambda p: {"name": "TypedCodecSpec", "_bufferSpec": keyed.BUFFERS, "_eType": keyed.type_text(p), "_vType": keyed.logical_text(p)}
        # The keys of the metadata.
        index = {"name": "IndexSpec2", "_relPath": "../index", "_leafCodec": codec(leaf), "_internalNodeCodec": codec(node), "_keyType": "", "_annotationType": "Struct{}"} if self.key and made else None
        small = keyed.documents(self.row, self.key, [m.name for m in made], [(json.loads(m.first), json.loads(m.last)) for m in made], sum(m.rows for m in made), index)
        for name, data in small.items():
            files.put(f"{ready}/{name}", data)
        # The table that stood here goes only when the new one is whole.
        files.delete(f"{self.path}/_SUCCESS")
        for folder in ("rows", "index", "globals"):
            files.delete(f"{self.path}/{folder}")
            if folder != "index" or index:
                files.move(f"{ready}/{folder}", f"{self.path}/{folder}")
        files.delete(self.work)
        files.put(f"{self.path}/_SUCCESS", b"")

    def abort(self, messages):
        files.delete(self.work)


class KeyedTable(DataSource):
    """``spark.read.format("keyed_table")`` by :func:`load`, ``df.write`` by :func:`save`."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return keyed.spark_type(keyed.parse_type(json.loads(self.options["plan"])["row"]))

    def reader(self, schema):
        return (PushedReader if self.options.get("push") == "true" else KeyedReader)(schema, self.options)

    def writer(self, schema, overwrite):
        return KeyedWriter(schema, self.options)


def load(spark: SparkSession, m: keyed.Meta, component: str, parts: list[int], ranges: list[KeyRange], intervals: list[tuple[str, int, int]] | None, limits: keyed.Limits, full: dict | None = None) -> DataFrame:
    """Rows of the parts given; with ``full``, a key with all its fields, the first row of it."""
    bounded = [(list(r.path), op, edge.value) for r in ranges for op, edge in ((">=", r.low), ("<=", r.high)) if edge is not None]
    index = m.index if component == "rows" else None
    plan = {
        "parts": [{"file": f"{m.path}/{component}/parts/{m.parts[i]}", "index": f"{index.folder}/{m.parts[i]}.idx" if index else None, "bound": m.bounds[i]} for i in parts],
        "key": m.key if component == "rows" else [], "fixed": m.fixed, "row": keyed.type_text(m.row_type), "limits": [limits.binary, limits.array], "full": full,
        "index": [keyed.type_text(index.leaf), keyed.type_text(index.internal), index.fixed] if index else None,
        "ranges": bounded if component == "rows" else [], "intervals": [list(x) for x in intervals] if intervals is not None else None,
    }
    spark.dataSource.register(KeyedTable)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("plan", json.dumps(plan)).option("push", push).load()


def save(df: DataFrame, path: str, key: list[str], limits: keyed.Limits) -> None:
    df.sparkSession.dataSource.register(KeyedTable)
    df.write.format(NAME).mode("append").options(path=path, key=json.dumps(key), limits=json.dumps([limits.binary, limits.array])).save()
