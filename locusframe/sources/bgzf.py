"""Block-gzipped text: lines by block, regions by index, and writing in parallel.

A block is a gzip member of at most 64 KiB that tells its own size, so a file can be
entered at any block.  Places are *virtual offsets*: where a block stands in
the file, times 2**16, plus a byte's place in the decompressed block.

Reading: without an index a file is cut into byte ranges; a task looks for the first block
of its range and owns the lines that start in its blocks, but for the first,
which the task before it ends.  With an index the wanted regions become chunks of
virtual offsets, each a partition, and no other block is opened.

Writing: every task packs its lines into whole blocks of a file of its own and notes
what an index needs; the commit puts the files one behind the other, header
first, an end block last, and shifts the tasks' offsets to where their blocks came to
stand.  With ``joined`` off the files stay apart, in a folder, and one behind the other are the
same bytes.
"""

from __future__ import annotations

import bisect
import gzip
import json
import struct as st
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from locusframe.sources import files

NAME = "bgzf_lines"
#: Bytes of a block before compression.
FULL = 65280
#: Bytes of a file for each task.
RANGE = 32 << 20
ROWS = 8192
MAGIC = b"\x1f\x8b\x08\x04"


def pack(data: bytes) -> bytes:
    """One block."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + st.pack("<H", len(body) + 25) + body + st.pack("<II", zlib.crc32(data), len(data))


def block_size(head: bytes) -> int | None:
    """The size of the block that starts with these bytes; None if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    at, stop = 12, 12 + st.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(stop, len(head)):
        name, n = head[at : at + 2], st.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and n == 2:
            return st.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def inflate(raw: bytes) -> bytes:
    extra = st.unpack_from("<H", raw, 10)[0]
    data = zlib.decompress(raw[12 + extra : -8], -15)
    if zlib.crc32(data) != st.unpack_from("<I", raw, len(raw) - 8)[0]:
        raise ValueError("a block's checksum is wrong")
    return data


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, bytes) of the blocks from one on."""
    f.seek(at)
    while True:
        head = f.read(18)
        if not head:
            return
        n = block_size(head)
        if n is None:
            # A longer extra field.
            head += f.read(256)
            n = block_size(head)
            if n is None:
                raise ValueError(f"no block at {at}")
            f.seek(at + len(head))
        raw = head[:n] + f.read(n - len(head)) if n > len(head) else head[:n]
        if len(raw) < n:
            raise EOFError("file ends within a block")
        f.seek(at + n)
        yield at, inflate(raw)
        at += n


def first_block(f, at: int, size: int) -> int:
    """Where the first block at or after a place stands; the file's size if there is none."""
    f.seek(at)
    seen = f.read(2 * 65536 + 18)
    k = seen.find(MAGIC)
    while k >= 0:
        n = block_size(seen[k : k + 18])
        if n is not None and (at + k + n == size or block_size(seen[k + n : k + n + 18]) is not None):
            return at + k
        k = seen.find(MAGIC, k + 1)
    return size


def is_blocked(path: str) -> bool:
    with files.opened(path) as f:
        return block_size(f.read(18)) is not None


def lines(f, begin: int, end: int, skip: bool = False) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the lines that start from ``begin`` on and before ``end``; with ``skip`` without the first."""
    held, start = b"", begin
    for at, data in blocks(f, begin >> 16):
        place = (begin & 0xFFFF) if at == begin >> 16 else 0
        while True:
            stop = data.find(b"\n", place)
            if stop < 0:
                if not held:
                    start = at << 16 | place
                held += data[place:]
                break
            if not held:
                start = at << 16 | place
            line, held = held + data[place:stop], b""
            place = stop + 1
            if start >= end:
                return
            if not skip:
                yield start, line
            skip = False
        if not held and at << 16 >= end:
            return
    if held and start < end and not skip:
        yield start, held


# Region index


@dataclass
class Region:
    """Of one contig the chunks of each bin, and of each window of 2**14 places the least offset of what reaches into it."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    windows: dict[int, int] = field(default_factory=dict)


# Bits of the smallest bin, of a level, and the levels of bins.
SMALLEST, STEP, LEVELS = 14, 3, 5


def levels() -> Iterator[tuple[int, int]]:
    """(first bin, bits of a bin) from the smallest bins up."""
    for level in range(LEVELS, -1, -1):
        yield ((1 << STEP * level) - 1) // 7, SMALLEST + STEP * (LEVELS - level)


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds places from ``begin`` to before ``end``, from 0."""
    for first, bits in levels():
        if begin >> bits == end - 1 >> bits:
            return first + (begin >> bits)
    return 0


def bins_over(begin: int, end: int) -> Iterator[int]:
    """All bins that can hold what overlaps these places."""
    for first, bits in levels():
        yield from range(first + (begin >> bits), first + (end - 1 >> bits) + 1)


def read_index(raw: bytes) -> dict[str, Region]:
    raw, at = gzip.decompress(raw), 36
    if raw[:4] != b"TBI\1":
        raise ValueError("not a region index")
    n_contigs, *_, n_names = st.unpack_from("<8i", raw, 4)
    names = raw[at : at + n_names].split(b"\0")[:n_contigs]
    at += n_names
    out = {}
    for name in names:
        region = out[name.decode()] = Region()
        (n,) = st.unpack_from("<i", raw, at)
        at += 4
        for _ in range(n):
            number, chunks = st.unpack_from("<Ii", raw, at)
            flat = st.unpack_from(f"<{2 * chunks}Q", raw, at + 8)
            # The number past all bins holds counts, not chunks.
            if number <= 37448:
                region.bins[number] = list(zip(flat[::2], flat[1::2]))
            at += 8 + 16 * chunks
        (n,) = st.unpack_from("<i", raw, at)
        region.windows = {k: x for k, x in enumerate(st.unpack_from(f"<{n}Q", raw, at + 4)) if x}
        at += 4 + 8 * n
    return out


def write_index(regions: dict[str, Region]) -> bytes:
    names = b"".join(c.encode() + b"\0" for c in regions)
    # The kind of text, its columns of contig and place, the mark of header lines, and lines to pass over.
    out = [b"TBI\1", st.pack("<8i", len(regions), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
    for region in regions.values():
        out.append(st.pack("<i", len(region.bins)))
        for number, chunks in sorted(region.bins.items()):
            out.append(st.pack("<Ii", number, len(chunks)) + b"".join(st.pack("<QQ", *c) for c in chunks))
        n, last = max(region.windows, default=-1) + 1, 0
        filled = []
        for k in range(n):
            last = region.windows.get(k, last)
            filled.append(last)
        out.append(st.pack(f"<i{n}Q", n, *filled))
    raw = b"".join(out)
    return b"".join(pack(raw[k : k + FULL]) for k in range(0, len(raw), FULL)) + pack(b"")


def chunks_over(index: dict[str, Region], intervals: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Chunks that can hold lines of places (from 1, ends included), in order, those that meet or share a block as one."""
    found = set()
    for contig, a, b in intervals:
        region = index.get(contig)
        begin, end = max(a - 1, 0), min(b, 1 << 29)
        if region is None or begin >= end:
            continue
        # What stands before the least offset of the last window up to the first place ends before it.
        known = sorted(region.windows)
        k = bisect.bisect_right(known, begin >> SMALLEST)
        least = region.windows[known[k - 1]] if k else 0
        for number in bins_over(begin, end):
            for low, high in region.bins.get(number, []):
                if high > least:
                    found.add((max(low, least), high))
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and low >> 16 <= out[-1][1] >> 16:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


class Notes:
    """What an index needs of the lines of one part, in order."""

    def __init__(self):
        self.regions: dict[str, Region] = {}
        self.last: tuple[str, int] | None = None

    def add(self, line: bytes, begin: int, end: int) -> None:
        part = line.split(b"\t", 8)
        contig, at, size = part[0].decode(), int(part[1]) - 1, len(part[3])
        stop = at + max(size, 1)
        if len(part) > 7 and b"END=" in part[7]:
            for x in part[7].split(b";"):
                if x.startswith(b"END=") and x[4:].isdigit():
                    stop = max(stop, int(x[4:]))
        at = max(at, 0)
        region = self.regions.setdefault(contig, Region())
        number = bin_of(at, stop)
        chunks = region.bins.setdefault(number, [])
        if self.last == (contig, number):
            chunks[-1] = (chunks[-1][0], end)
        else:
            chunks.append((begin, end))
        self.last = contig, number
        for k in range(at >> SMALLEST, (stop - 1 >> SMALLEST) + 1):
            region.windows.setdefault(k, begin)

    def shifted_into(self, out: dict[str, Region], by: int) -> None:
        for contig, region in self.regions.items():
            own = out.setdefault(contig, Region())
            for number, chunks in region.bins.items():
                own.bins.setdefault(number, []).extend((a + (by << 16), b + (by << 16)) for a, b in chunks)
            for k, x in region.windows.items():
                own.windows[k] = min(own.windows.get(k, 1 << 63), x + (by << 16))


# Source


@dataclass
class Piece(InputPartition):
    begin: int
    end: int
    skip: bool

    def __post_init__(self):
        super().__init__((self.begin, self.end))


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunks, self.range = options["path"], options.get("chunks"), int(options.get("range", RANGE))

    def partitions(self):
        if self.chunks is not None:
            return [Piece(a, b, False) for a, b in json.loads(self.chunks)] or [Piece(0, 0, False)]
        size = files.size(self.path)
        return [Piece(at, min(at + self.range, size), at > 0) for at in range(0, size, self.range)] or [Piece(0, 0, False)]

    def found(self, piece: Piece) -> Iterator[bytes]:
        if piece.begin >= piece.end:
            return
        with files.opened(self.path) as f:
            begin, end = piece.begin, piece.end
            if self.chunks is None:
                size = f.seek(0, 2)
                # A line that starts with the first byte of the next range's first block is still this one's.
                begin, end = (first_block(f, x, size) << 16 for x in (begin, end))
                end += 1
                if begin >= end - 1:
                    return
            for _, line in lines(f, begin, end, piece.skip):
                yield line

    def read(self, partition):
        rows = []
        for line in self.found(partition):
            rows.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    size: int
    rows: int
    notes: Notes


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.head = options["path"], options.get("head", "")
        self.joined, self.indexed = options.get("joined", "true") == "true", options.get("indexed", "true") == "true"
        at = self.path.rstrip("/")
        self.work = f"{at}.making-{uuid.uuid4().hex}"

    def write(self, iterator):
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        out, held, size, rows, notes = files.created(f"{self.work}/{name}"), bytearray(), 0, 0, Notes()
        with out:
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    line, begin = value.encode(), size << 16 | len(held)
                    held += line + b"\n"
                    while len(held) >= FULL:
                        raw = pack(bytes(held[:FULL]))
                        out.write(raw)
                        size += len(raw)
                        del held[:FULL]
                    if self.indexed:
                        notes.add(line, begin, size << 16 | len(held))
                    rows += 1
            if held:
                raw = pack(bytes(held))
                out.write(raw)
                # The end of the last line is the start of the block that follows.
                size += len(raw)
        return Written(part, name, size, rows, notes)

    def commit(self, messages):
        made = sorted((m for m in messages if m and m.rows), key=lambda m: m.part)
        raw = self.head.encode()
        head = b"".join(pack(raw[k : k + FULL]) for k in range(0, len(raw), FULL))
        regions, at = {}, len(head)
        for m in made:
            m.notes.shifted_into(regions, at)
            at += m.size
        if self.joined:
            with files.created(f"{self.work}/whole") as out:
                out.write(head)
                for m in made:
                    with files.opened(f"{self.work}/{m.name}") as f:
                        while some := f.read(1 << 20):
                            out.write(some)
                out.write(pack(b""))
            files.delete(self.path)
            files.move(f"{self.work}/whole", self.path)
        else:
            files.delete(self.path)
            for k, m in enumerate(made):
                files.move(f"{self.work}/{m.name}", f"{self.path}/part-{k + 1:05d}.vcf.bgz")
            files.put(f"{self.path}/part-00000.vcf.bgz", head)
            files.put(f"{self.path}/part-{len(made) + 1:05d}.vcf.bgz", pack(b""))
        if self.indexed:
            files.put(f"{self.path.rstrip('/')}.tbi", write_index(regions))
        files.delete(self.work)

    def abort(self, messages):
        files.delete(self.work)


class BlockedLines(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "value string"

    def reader(self, schema: StructType):
        return LinesReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return LinesWriter(self.options)


def read_lines(spark: SparkSession, path: str, intervals: list[tuple[str, int, int]] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """``value``: the lines of a file; with intervals and an index beside the file, those of the blocks that can hold any of them."""
    spark.dataSource.register(BlockedLines)
    reader = spark.read.format(NAME).option("path", path).option("range", range_bytes)
    if intervals is not None and files.size(f"{path}.tbi") is not None:
        reader = reader.option("chunks", json.dumps(chunks_over(read_index(files.whole(f"{path}.tbi")), intervals)))
    return reader.load()


def head_lines(path: str, mark: str = "#") -> list[str]:
    """The lines that a file starts with, as long as these start with the mark."""
    out = []
    with files.opened(path) as f:
        for _, line in lines(f, 0, 1 << 63):
            text = line.decode("utf-8", "replace").removesuffix("\r")
            if not text.startswith(mark):
                break
            out.append(text)
    return out


def write_lines(df: DataFrame, path: str, head: str = "", indexed: bool = True, joined: bool = True) -> None:
    """The one text column of ``df``, whose partitions are in the order of the file; ``head`` comes before, with its line's end.

    With ``indexed`` lines are variant calls in order of place, and the index goes beside the file.
    """
    df.sparkSession.dataSource.register(BlockedLines)
    df.write.format(NAME).mode("append").options(path=path, head=head, indexed=str(indexed).lower(), joined=str(joined).lower()).save()
