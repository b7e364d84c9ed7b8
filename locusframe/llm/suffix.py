"""Removal of long repeated strings by suffix order and longest previous factors.

A *window* is ``length`` bytes of one text.  A window repeats if the same bytes
start anywhere else, in any text or in its own.  What is removed is the union of
windows: of all that repeat (``keep="none"``), or of all that have an earlier
copy by (id, row, position) (``keep="first"``).

1. *Segments* (one map): each window is named by its minimizer, the gram of
   least hash in it, leftmost of equals.  Equal windows have equal minimizers at
   equal places, so only segments (the runs of neighbouring windows of one
   minimizer) with equal minimizers need to be compared.  Copies of a segment
   inside one text are settled here, so that a text with a short period names
   each of its segments once.
2. *Equal segments* are folded by (minimizer hash, segment hash), with partial
   sums before the shuffle: a string that a million texts hold is one string
   with a count from here on.
3. *Unequal segments of one minimizer*: one copy of each is fetched and put in
   suffix order (ranks of prefixes by doubling) with the lengths that neighbours
   share.  The previous and next smaller positions in that order give every
   window's longest previous factor and where it starts (:func:`longest_previous`);
   those of ``length`` or more are repeats, and their sources have a later copy.
   A task takes minimizers in groups of bounded size.
   Minimizers with more than ``HOT`` unequal segments are split instead: their
   windows are counted by hash, again with partial sums.
4. Spans are merged in order of place, text by text, joined back and cut out.

With ``words`` a window is so many words (runs of bytes that are not space)
instead, whatever their bytes and the space between them: the same search runs
over the hashes of words.  A text with fewer words loses nothing.

Hashes only bring strings together: minimizers have 64 bits and segments 64
more over that; windows of hot minimizers have 128.  Texts are joined by id and
a hash of the row.

Defined cases: a null or empty text has no windows; a text below ``length``
bytes loses nothing; equal rows count as repeats of each other and are all cut
alike (with ``keep="first"`` they are one place in the order); with
``keep="first"`` a null id orders by a hash of the row, and rows of one id by
that hash; spans may split a character, and where text is returned they are
narrowed to whole characters; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from locusframe.llm.common import cut, discard

LENGTH = 400
#: The length of the second measure of :func:`digest`: most passages of over 50 words have as many bytes.
SHORT = 256
CHUNK = 1 << 20
HOT = 2048
GROUP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
WORD = re.compile(rb"\S+")
SPANS = "array<struct<lo:int,hi:int>>"


class Minimizers:
    """Runs of windows with one minimizer, for texts of any length."""

    def __init__(self, length: int):
        self.length = length
        self.gram = max(4, min(64, length // 4))
        self.width = length - self.gram + 1
        self.room = 0

    def powers(self, n: int) -> None:
        if n > self.room:
            n = max(n, 1 << 16)
            up = np.full(n, BASE, np.uint64)
            up[0] = 1
            down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            down[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.cumprod(up), np.cumprod(down)
            self.room = n

    def runs(self, text: np.ndarray):
        """Of a string of bytes or of words' hashes, arrays: hash of the minimizer, first window, last window."""
        n = len(text) - self.length + 1
        if n <= 0:
            return None
        parts = []
        for at in range(0, n, CHUNK):
            m = min(CHUNK, n - at)
            parts.append(self.chunk(text[at : at + m + self.length - 1], at, m))
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))

    def chunk(self, b: np.ndarray, at: int, m: int):
        self.powers(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], out=sums[1:])
            count = len(b) - self.gram + 1
            h = (sums[self.gram :] - sums[:count]) * self.down[:count]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        place = np.uint64((1 << 21) - 1)
        low = (h & ~place) | np.arange(count, dtype=np.uint64)
        done = 1
        while done * 2 <= self.width:
            low = np.minimum(low[: len(low) - done], low[done:])
            done *= 2
        low = np.minimum(low[:m], low[self.width - done : self.width - done + m])
        where = (low & place).astype(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        last = np.r_[first[1:] - 1, m - 1]
        return h[where[first]].view(np.int64), first + at, last + at


def padded(data: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """At every place and ``length`` beyond the end a word of the string from there on, and how much it holds."""
    if data.itemsize > 1:
        return np.concatenate([data, np.zeros(length, data.dtype)]), 1
    raw = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    n, known = len(data) + length, 8
    words = np.zeros(n, np.uint64)
    for k in range(known):
        words = (words << np.uint64(8)) | raw[k : k + n]
    return words, known


def ranks_of(key: np.ndarray, bits: int) -> np.ndarray:
    """Of numbers of so many bits their ranks, equal for equal ones."""
    n = len(key)
    own = max(1, (n - 1).bit_length())
    if bits + own <= 63:
        # Numbers with their places sort as they are, which is faster than sorting places.
        both = np.sort((key.astype(np.int64) << own) | np.arange(n))
        order, key = both & ((1 << own) - 1), both >> own
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    return rank


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all places, and of ``length`` beyond the end, by longer and longer prefixes: (symbols, ranks)."""
    words, known = padded(data, length)
    if known > 1:
        # Five bytes and a place fit in one number.
        shown = min(5, length)
        words, known = words >> np.uint64(8 * (known - shown)), shown
    out = [(known, ranks_of(words, 8 * known if data.itemsize == 1 else 64))]
    own = max(1, (len(words) - 1).bit_length())
    while known < length:
        rank = out[-1][1]
        bits = max(1, int(rank.max()).bit_length())
        # As many ranks as fit make a longer prefix at once; the last one may overlap.
        several = min(max(2, (63 - own) // bits), 63 // bits, -(-length // known))
        key = rank.copy()
        for k in range(1, several):
            step = min(k * known, length - known)
            key <<= bits
            key[: len(rank) - step] |= rank[step:]
        known = min(length, several * known)
        out.append((known, ranks_of(key, several * bits)))
    return out


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Of every place the rank of the ``length`` symbols from there on, in their order; past the end are zeros."""
    return prefix_ranks(data, length)[-1][1][: len(data)]


def shared_lengths(data: np.ndarray, order: np.ndarray, length: int, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How much every place in ``order`` shares with the one before it, ``length`` at most.

    The prefixes' ranks tell by steps of their lengths, the longest first, and the symbols tell the rest.
    """
    words, whole = padded(data, length)
    out = np.zeros(len(order), np.int64)
    if not len(order):
        return out
    a, b = order[:-1], order[1:]
    same = ranks[-1][1][a] == ranks[-1][1][b]
    out[1:][same] = length
    live = np.flatnonzero(~same) + 1
    a, b, got = order[live - 1], order[live], np.zeros(len(live), np.int64)
    for known, rank in ranks[-2::-1]:
        more = np.arange(len(live))
        while len(more):
            more = more[got[more] + known <= length]
            more = more[rank[a[more] + got[more]] == rank[b[more] + got[more]]]
            got[more] += known
    if whole > 1:
        # Of the words from there on the bytes before the first difference are shared.
        differ = words[a + got] ^ words[b + got]
        for k in range(1, whole):
            got += differ < np.uint64(1 << 64 - 8 * k)
    out[live] = np.minimum(got, length)
    return out


def smaller_before(place: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every rank the nearest rank before it with a smaller place (or -1), and the least shared on the way."""
    to, low = np.arange(-1, len(place) - 1), shared.copy()
    live = np.flatnonzero((to >= 0) & (place[to] > place))
    while len(live):
        over = to[live]
        low[live] = np.minimum(low[live], low[over])
        to[live] = to[over]
        live = live[to[live] >= 0]
        live = live[place[to[live]] > place[live]]
    low[to < 0] = 0
    return to, low


def longest_previous(data: np.ndarray, order: np.ndarray, length: int, ranks: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of every rank of ``order`` the longest match with a smaller place, and that place (or -1).

    ``order`` holds places in suffix order, by the last of the ``ranks`` of
    prefixes; matches are known up to ``length``.
    """
    n = len(order)
    shared = shared_lengths(data, order, length, ranks)
    before, low = smaller_before(order, shared)
    # The next smaller position is the previous one of the order turned round.
    after, low_after = smaller_before(order[::-1], np.r_[0, shared[:0:-1]] if n else shared)
    after, low_after = np.where(after < 0, -1, n - 1 - after)[::-1], low_after[::-1]
    source = np.where(low >= low_after, before, after)
    return np.maximum(low, low_after), np.where(source < 0, -1, order[source])


def matches(segments: list[np.ndarray], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each segment's windows: whether an earlier window equals it, and whether any other does.

    Earlier is by the order of segments, then by place.
    """
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    data = np.concatenate(segments)
    ranks = prefix_ranks(data, length)
    rank = ranks[-1][1]
    at = np.concatenate([np.arange(e - n, e - length + 1) for e, n in zip(ends, sizes)])
    order = at[np.lexsort((at, rank[at]))]
    factor, source = longest_previous(data, order, length, ranks)
    whole = factor >= length
    previous = np.zeros(len(data), bool)
    previous[order[whole]] = True
    other = previous.copy()
    other[source[whole]] = True
    cuts = np.cumsum(sizes - length + 1)[:-1]
    return list(zip(np.split(previous[at], cuts), np.split(other[at], cuts)))


def spans_of(hit: np.ndarray, at: int, length: int) -> list[tuple[int, int]]:
    """Byte spans of the windows marked, the first of which starts at ``at``."""
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [(at + int(a), at + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def runs_of(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of spans sorted by group (ascending numbers) and start: group, start, end."""
    if not len(lo):
        return group, lo, hi
    wide = np.int64(1) << 32
    reach = np.maximum.accumulate(group * wide + hi)
    new = np.flatnonzero(np.r_[True, group[1:] * wide + lo[1:] > reach[:-1]])
    return group[new], lo[new], reach[np.r_[new[1:] - 1, len(lo) - 1]] - group[new] * wide


def merged(spans: DataFrame) -> DataFrame:
    """``row``, ``ord`` and ``spans``, sorted and apart, from single spans in any order.

    A task sees the spans of a text in order of place and holds their unions only.
    """

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4

        def settle(last: bool):
            nonlocal held
            row, order, lo, hi = held
            new = np.r_[True, (row[1:] != row[:-1]) | (order[1:] != order[:-1])]
            text, lo, hi = runs_of(np.cumsum(new) - 1, lo, hi)
            row, order = row[new], order[new]
            # The last text may go on in the next batch.
            upto = len(lo) if last else int(np.searchsorted(text, len(row) - 1))
            n = len(row) - (not last)
            held = [np.repeat(row[n:], len(lo) - upto), np.repeat(order[n:], len(lo) - upto), lo[upto:], hi[upto:]]
            ends = np.searchsorted(text[:upto], np.arange(n + 1))
            pairs = pa.StructArray.from_arrays([pa.array(lo[:upto], pa.int32()), pa.array(hi[:upto], pa.int32())], ["lo", "hi"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            return pa.RecordBatch.from_arrays([pa.array(row[:n]), pa.array(order[:n]), lists], ["row", "ord", "spans"])

        for batch in batches:
            if batch.num_rows:
                held = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
                yield settle(False)
        if len(held[0]):
            yield settle(True)

    dealt = spans.select("row", "ord", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    dealt = dealt.repartition("row", "ord").sortWithinPartitions("row", "ord", "lo")
    return dealt.mapInArrow(run, f"row long, ord long, spans {SPANS}")


def release(*tables: DataFrame, spark: SparkSession | None = None) -> None:
    """Delete tables of finished steps, and let Spark drop their shuffle files."""
    spark = spark or tables[0].sparkSession
    for t in tables:
        discard(t)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def symbols(text: str, words: bool) -> np.ndarray:
    """The bytes of a text, or a hash of each of its words."""
    raw = text.encode()
    if not words:
        return np.frombuffer(raw, np.uint8)
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in raw.split()]), np.uint64)


def segments(given: DataFrame, length: int, words: bool = False) -> DataFrame:
    """``row``, ``ord``, ``a`` (minimizer), ``s`` (segment), ``lo`` (first window), ``w`` (windows but one), ``c``.

    ``c`` counts the copies of a segment in its text, of which the first is told;
    rows of ``c = 0`` are spans of the further ones.  With a column ``within`` only
    what lies in one of its spans counts.
    """
    columns = ["row", "ord", "text"] + ["within"] * ("within" in given.columns)

    def run(batches):
        find = Minimizers(length)
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keep: list[list[np.ndarray]] = [[] for _ in range(7)]
            held = 0

            def flush():
                cols = [np.concatenate(x) for x in keep]
                names = ["row", "ord", "a", "s", "lo", "w", "c"]
                out = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
                for x in keep:
                    x.clear()
                return out

            def put(row, order, a, s, lo, w, c):
                nonlocal held
                new = (np.full(len(a), row), np.full(len(a), order), a, s, lo.astype(np.int32), w.astype(np.int32), c.astype(np.int32))
                for x, y in zip(keep, new):
                    x.append(y)
                held += len(a)

            for i, (row, order) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                data = symbols(batch.column(2)[i].as_py(), words)
                inside = [(x["lo"], x["hi"]) for x in batch.column(3)[i].as_py()] if len(columns) > 3 else [(0, len(data))]
                found = [(got, at) for at, end in inside if (got := find.runs(data[at:end])) is not None]
                if not found:
                    continue
                a = np.concatenate([x[0] for x, _ in found])
                lo = np.concatenate([x[1] + at for x, at in found])
                hi = np.concatenate([x[2] + at for x, at in found])
                view, size = memoryview(data).cast("B"), data.itemsize
                s = [digest(view[x * size : (y + length) * size]) for x, y in zip(lo.tolist(), hi.tolist())]
                s = np.array(s, np.uint64).view(np.int64)
                c = np.ones(len(a), np.int64)
                if len(np.unique(s)) < len(s):
                    by = np.lexsort((lo, s, a))
                    new = np.r_[True, (a[by][1:] != a[by][:-1]) | (s[by][1:] != s[by][:-1])]
                    c[by[new]] = np.diff(np.r_[np.flatnonzero(new), len(by)])
                    again = np.sort(by[~new])
                    _, x, y = runs_of(np.zeros(len(again), np.int64), lo[again], hi[again] + length)
                    none = np.zeros(len(x), np.int64)
                    put(row, order, none, none, x, y - x - length, none)
                    first = np.sort(by[new])
                    a, s, lo, hi, c = a[first], s[first], lo[first], hi[first], c[first]
                put(row, order, a, s, lo, hi - lo, c)
                if held > 100_000:
                    held = 0
                    yield flush()
            if held:
                yield flush()

    return given.select(*columns).mapInArrow(run, "row long, ord long, a long, s long, lo int, w int, c int")


def fetch(given: DataFrame, need: DataFrame, length: int, words: bool = False) -> DataFrame:
    """The segments needed with their symbols."""
    kind = "a long, s long, n long, nv long, ord long, row long, lo int, data binary"
    # Equal rows name the same segments, and one of them tells.
    lists = need.groupBy("row", "ord").agg(F.collect_set(F.struct("lo", "w", "a", "s", "n", "nv")).alias("all"))
    texts = given.select("row", "ord", "text").join(lists, ["row", "ord"]).dropDuplicates(["row", "ord"])
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64()] * 6 + [pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                row, order = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = symbols(batch.column(2)[i].as_py(), words)
                for x in batch.column(3)[i]:
                    lo, w, *rest = (v.as_py() for v in x.values())
                    rows.append((*rest, order, row, lo, data[lo : lo + w + length].tobytes()))
                    size += len(rows[-1][-1])
                    if size > 1 << 23 or len(rows) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return texts.select("row", "ord", "text", "all").mapInArrow(run, kind)


def compare(fetched: DataFrame, length: int, first: bool, words: bool = False) -> DataFrame:
    """Spans of windows that repeat in unequal segments of one minimizer, by suffix order."""
    symbol = np.uint64 if words else np.uint8
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def run(batches):
        group: list[tuple] = []

        def settle():
            # One segment of each (a, s), the earliest; rows come in order of a, ord, row, lo.
            kept: dict[tuple, list] = {}
            for a, s, n, order, row, lo, data in group:
                kept.setdefault((a, s), [n, np.frombuffer(data, symbol), []])[2].append((row, order, lo))
            out = []
            # Earlier matches need segments in order of their first copies within each a: as they came.
            for (n, _, where), (previous, other) in zip(kept.values(), matches([x[1] for x in kept.values()], length)):
                if not first and n > 1:
                    continue
                for row, order, lo in where:
                    out += [(row, order, a, b) for a, b in spans_of(previous if first else other, lo, length)]
            group.clear()
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "ord", "lo", "hi"])

        size, last = 0, None
        for batch in batches:
            for a, s, n, order, row, lo, data in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if a != last and size > GROUP_BYTES:
                    yield settle()
                    size = 0
                last = a
                size += len(data)
                group.append((a, s, n, order, row, lo, data))
        if group:
            yield settle()

    dealt = fetched.repartition("a").sortWithinPartitions("a", "ord", "row", "lo")
    return dealt.select("a", "s", "n", "ord", "row", "lo", "data").mapInArrow(run, "row long, ord long, lo int, hi int")


def count_windows(fetched: DataFrame, length: int, first: bool, words: bool = False) -> DataFrame:
    """The same for hot minimizers, window by window."""
    size = 8 if words else 1

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for n, order, row, lo, data in zip(*[part.column(i).to_pylist() for i in range(5)]):
                    view = memoryview(data)
                    for k in range(len(data) // size - length + 1):
                        out.append((xxhash.xxh3_128_digest(view[k * size : (k + length) * size]), n, order, row, lo + k))
                types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["h", "n", "ord", "row", "lo"])

    each = fetched.select("n", "ord", "row", "lo", "data").mapInArrow(run, "h binary, n long, ord long, row long, lo int")
    # Copies of one segment came once for each text that holds its first copy: n counts all.
    counts = each.groupBy("h").agg(F.sum("n").alias("all"), F.min(F.struct("ord", "row", "lo")).alias("least")).where("all > 1")
    joined = each.join(counts, "h")
    told = joined.where(F.struct("ord", "row", "lo") != F.col("least")) if first else joined.where("n = 1")
    return told.select("row", "ord", "lo", (F.col("lo") + length).alias("hi"))


def removed(given: DataFrame, length: int, first: bool, words: bool = False) -> DataFrame:
    """``row``, ``ord`` and ``spans``, sorted and apart, of all texts that lose anything; with ``words`` spans of words.

    A column ``within`` of ``given`` may say where in a text to look.
    """
    occurrences = cut(segments(given, length, words), "segments")
    named = occurrences.where("c > 0")
    # The first copy speaks for all: by id and row, or where all copies go, by row alone.
    at = F.struct("ord", "row") if first else F.col("row")
    kinds = named.groupBy("a", "s").agg(F.sum("c").alias("n"), F.min(at).alias("least"))
    several = kinds.groupBy("a").agg(F.count("*").alias("nv")).where("nv > 1")
    wanted = kinds.join(several, "a", "left").where("n > 1 or nv > 1").withColumn("nv", F.coalesce("nv", F.lit(1)))
    told = named.join(wanted, ["a", "s"]).select("row", "ord", "a", "s", "lo", "w", "n", "nv", (at == F.col("least")).alias("own"))
    matched = cut(told, "matched")
    again = cut(occurrences.where("c = 0").select("row", "ord", "lo", "w"), "again")
    release(occurrences)
    copies = matched.where("not own" if first else "n > 1").select("row", "ord", "lo", "w").unionByName(again)
    fetched = cut(fetch(given, matched.where("own and nv > 1"), length, words), "fetched")
    release(spark=fetched.sparkSession)
    spans = copies.select("row", "ord", "lo", (F.col("lo") + F.col("w") + length).alias("hi"))
    spans = spans.unionByName(compare(fetched.where(F.col("nv") <= HOT), length, first, words))
    spans = spans.unionByName(count_windows(fetched.where(F.col("nv") > HOT), length, first, words))
    out = cut(merged(spans), "spans")
    release(again, matched, fetched)
    return out


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    return df.select(
        F.col(id_col).cast("long").alias("key"),
        row.alias("row"),
        F.coalesce(F.col(id_col).cast("long"), row).alias("ord"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none", short: int = SHORT) -> DataFrame:
    """The id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``n_repeated`` of every row.

    ``n_repeated`` counts the bytes covered by a string of ``short`` bytes (at
    most ``length``) that stands anywhere else as well.  Strings of ``length``
    can repeat inside such bytes only, so the search for these looks nowhere else.
    """
    given = keyed(df, id_col, text_col)
    near = removed(given, short, False)
    joined = given.join(near.withColumnRenamed("spans", "within"), ["row", "ord"], "left")
    raw = F.encode("text", "utf-8")
    # Texts without repeats are done; only the others are kept.
    far = cut(
        joined.select(
            "key",
            "row",
            "ord",
            F.when(F.col("within").isNotNull(), F.col("text")).alias("text"),
            "within",
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(F.col("within").isNull(), F.sha2(raw, 256)).alias("sha"),
        ),
        "repeated",
    )
    discard(near)
    spans = removed(far.where("text is not null").select("row", "ord", "text", "within"), length, keep == "first")

    def run(batches):
        for batch in batches:
            out = []
            for key, text, within, n, sha, found in zip(*[batch.column(i) for i in range(6)]):
                gone = [(x["lo"], x["hi"]) for x in found.as_py() or ()]
                kept = sha.as_py()
                if kept is None:
                    raw, digested, at = text.as_py().encode(), hashlib.sha256(), 0
                    for a, b in gone:
                        digested.update(raw[at:a])
                        at = b
                    digested.update(raw[at:])
                    kept = digested.hexdigest()
                repeated = sum(x["hi"] - x["lo"] for x in within.as_py() or ())
                out.append((key.as_py(), n.as_py(), sum(b - a for a, b in gone), len(gone), kept, repeated))
            types = [pa.int64()] * 4 + [pa.string(), pa.int64()]
            names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    told = far.join(spans, ["row", "ord"], "left").select("key", "text", "within", "n_bytes", "sha", "spans")
    kinds = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"
    return told.mapInArrow(run, kinds).withColumnRenamed("key", id_col)


def whole_characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The span narrowed to whole UTF-8 characters."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def strip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "first", words: int = 0) -> DataFrame:
    """``df`` with repeated strings cut out of its text; all columns stay; a null text stays null.

    With ``words``, strings of so many words, not of ``length`` bytes.
    """
    spans = removed(keyed(df, id_col, text_col), words or length, keep == "first", words > 0)
    fields = df.schema.fields
    names = [f.name for f in fields]
    at, by = names.index(text_col), names.index(id_col)
    hidden = [f"c{i}" for i in range(len(fields))]
    row = F.xxhash64(hidden[by], hidden[at])
    given = df.toDF(*hidden).withColumn("row", row).withColumn("ord", F.coalesce(F.col(hidden[by]).cast("long"), row))

    def run(batches):
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(at), batch.column(len(hidden))):
                if not found.is_valid:
                    texts.append(text.as_py())
                    continue
                raw, out, pos = text.as_py().encode(), [], 0
                places = [m.span() for m in WORD.finditer(raw)] if words else []
                for x in found.as_py():
                    a, b = (places[x["lo"]][0], places[x["hi"] - 1][1]) if words else whole_characters(raw, x["lo"], x["hi"])
                    out.append(raw[pos:a])
                    pos = b
                out.append(raw[pos:])
                texts.append(b"".join(out).decode())
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(hidden))]
            yield pa.RecordBatch.from_arrays(columns, hidden)

    schema = StructType([StructField(h, StringType() if i == at else f.dataType) for i, (h, f) in enumerate(zip(hidden, fields))])
    joined = given.join(spans, ["row", "ord"], "left").select(*hidden, "spans")
    return joined.mapInArrow(run, schema).toDF(*names)
