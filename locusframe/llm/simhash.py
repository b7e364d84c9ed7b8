"""SimHash near-duplicates by a Gray-order hierarchical index.

1. *Fingerprints*: one map over the texts.  Words are runs of non-space bytes
   after lower-casing A-Z; every shingle of ``width`` words, repeats included,
   is hashed by XXH64 (seed 42); a bit of the fingerprint is 1 if it is set in
   over half of the hashes.
2. *Ranges*: only distinct fingerprints go on (a hot group of copies is one
   fingerprint).  The 64 bits are cut into ``radius + 1`` blocks; two fingerprints
   within ``radius`` bits agree on one block at least.  For each block the
   fingerprints are dealt by its value, which leads their bits from here on.
   Values that more than ``SPLIT`` fingerprints have are dealt by a second block
   of the other bits as well, with the same argument.
3. *Index*: a task sorts its fingerprints by Gray rank, where neighbours differ
   in few bits, and folds groups of ``FANOUT`` level by level into nodes that hold
   the bits that a group shares (mask and pattern).  From the top, two nodes are
   compared by the bits that both share and that their upper nodes did not: the
   differences add up on the way down, and a pair of nodes falls as a whole group
   once they exceed the radius, once leading bits differ, or once all its members
   lie in one component.  Every link comes through this tree.  A task passes on
   a spanning forest of its links only, never all pairs of a dense group.
4. *Components*: rounds of large-star and small-star steps over fingerprints,
   as joins and aggregates, each written to the shared folder; no links are
   gathered on the driver.

:func:`similar` groups texts whose sets of five-word shingles have an exact
similarity of 0.8 or more.  The Gray-order index links fingerprints of these sets
within ``RADIUS`` bits; about ten differ at 0.8, so for what the index cannot see
:mod:`locusframe.llm.ngram_join` proposes further pairs by shared shingles, which ``JUDGES``
fingerprints judge (they must differ in at most ``JUDGED_BITS`` bits).  Counted shingles decide on all of them.

Every step is linear in the distinct fingerprints but the links inside a
bucket; skewed joins (many documents of one fingerprint) are split by adaptive
execution, as nothing above them needs a key's rows together.

Defined cases: no words (null, empty or blank text) give fingerprint zero,
which links as any other; ties of half the hashes give bit 0; equal rows are
all kept; a null id gets a component but names none (a component of null ids
only has a null id); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut, discard, handing_back

WIDTH = 3
RADIUS = 3
SEED = 42
FANOUT = 8
#: A block's value that more fingerprints have is split by a second block.
SPLIT = 1 << 14
#: Rows that a task gathers, in whole buckets, for one index.
CHUNK = 200_000
JUDGES = 3
#: Shingles at a similarity s of sets have an angle of cosine 2s / (1 + s); of 192 bits about 30 +- 5 differ at 0.8, 36 +- 6 in the smallest sets.
JUDGED_BITS = 72
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    # Count each byte's values, then weigh the values by their bits.
    place = by_byte + np.arange(0, 2048, 256, dtype=np.int64)
    set_in = np.bincount(place.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * set_in > len(hashes)).astype(np.uint8), axis=1).tobytes(), "big")


def words_of(text: str) -> list[bytes]:
    # bytes.split() cuts at space and bytes 9 to 13, as asked for.
    return text.encode().translate(_LOWER).split()


def fingerprint(text: str, width: int = WIDTH) -> int:
    words = words_of(text)
    return majority(shingle_hashes(words, width)) if words else 0


def variations(hashes: np.ndarray, n: int) -> list[int]:
    """Fingerprints of one set of shingles under n hash functions, the first the given one."""
    out = []
    for k in range(n):
        out.append(majority(hashes))
        with np.errstate(over="ignore"):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * k + 1)
            hashes = hashes ^ hashes >> np.uint64(32)
            hashes = hashes * np.uint64(0xD6E8FEB86659FD93)
            hashes = hashes ^ hashes >> np.uint64(29)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The id and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter(
                (fingerprint(t.as_py() or "", width) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    given = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "key long, fp long").withColumnRenamed("key", id_col)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray sequence."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Forest:
    """Union-find over positions, vectorised lookups."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            two = self.up[self.up]
            if (two == self.up).all():
                return self.up
            self.up = two

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The given links that join two components."""
        roots = self.roots()
        live = np.flatnonzero(roots[a] != roots[b])
        kept = []
        for i in live.tolist():
            x, y = self.find(int(a[i])), self.find(int(b[i]))
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append((int(a[i]), int(b[i])))
        return kept


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold what their members share."""

    def __init__(self, fp: np.ndarray, lead: int = 0):
        """``lead``: so many high bits must agree in a link."""
        self.order = np.argsort(gray_rank(fp), kind="stable")
        self.lead = ~np.uint64(0) << np.uint64(64 - lead) if lead else np.uint64(0)
        #: Level by level, from the fingerprints up: patterns and masks.
        self.levels = [(fp[self.order], np.full(len(fp), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > FANOUT:
            pattern, mask = self.levels[-1]
            cuts = np.arange(0, len(pattern), FANOUT)
            ones = np.bitwise_and.reduceat(pattern & mask, cuts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, cuts)
            self.levels.append((ones, ones | zeros))

    def links(self, radius: int) -> list[tuple[int, int]]:
        """A spanning forest, as positions of the given order, of the pairs within ``radius`` bits."""
        n, top = len(self.order), len(self.levels) - 1
        forest = Forest(n)
        found: list[tuple[int, int]] = []
        i, j = np.triu_indices(len(self.levels[top][0]))
        todo = [(top, i, j, np.zeros(len(i), np.int64), np.zeros(len(i), np.uint64))]
        while todo:
            level, i, j, differ, known = todo.pop()
            pattern, mask = self.levels[level]
            shared = mask[i] & mask[j]
            fresh = (pattern[i] ^ pattern[j]) & shared & ~known
            differ = differ + np.bitwise_count(fresh)
            ok = (differ <= radius) & (fresh & self.lead == 0)
            i, j, differ, known = i[ok], j[ok], differ[ok], shared[ok]
            if level == 0:
                ok = i != j
                found += forest.join(i[ok], j[ok])
                continue
            if not len(i):
                continue
            # Nodes whose members are all of one component need no look at each other.
            roots, cuts = forest.roots(), np.arange(0, n, FANOUT**level)
            low, high = np.minimum.reduceat(roots, cuts), np.maximum.reduceat(roots, cuts)
            ok = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
            i, j, differ, known = i[ok], j[ok], differ[ok], known[ok]
            size, below = len(self.levels[level - 1][0]), np.arange(FANOUT)
            # A node with itself first (it is on top of the stack): what it unites, others need not compare.
            for own in (False, True):
                at = np.flatnonzero((i == j) == own)
                for k in range(0, len(at), 4096):
                    part = at[k : k + 4096]
                    ci = (i[part, None, None] * FANOUT + below[:, None] + 0 * below).ravel()
                    cj = (j[part, None, None] * FANOUT + 0 * below[:, None] + below).ravel()
                    ok = (ci <= cj) & (ci < size) & (cj < size)
                    again = lambda x: np.repeat(x[part], FANOUT * FANOUT)[ok]  # noqa: B023, E731
                    todo.append((level - 1, ci[ok], cj[ok], again(differ), again(known)))
        return [(int(self.order[a]), int(self.order[b])) for a, b in found]


def links(fp: np.ndarray, bucket: np.ndarray, judges: np.ndarray, most: int, spans: np.ndarray, percent: int = 80) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of the proposed pairs of each bucket.

    ``judges`` are fingerprints of every row, of which a pair must differ in at
    most ``most`` bits; ``spans`` the size of every row's set and how much of it
    precedes the bucket's shingle: sets of a similarity of ``percent`` hundredths must be possible.
    """
    n = len(fp)
    order = np.lexsort((gray_rank(fp), bucket))
    bucket, judges, spans = bucket[order], judges[order], spans[order]
    forest = Forest(n)
    found: list[tuple[int, int]] = []

    def near(a, b):
        # All that the sets share comes from this shingle on.
        x, y = spans[a], spans[b]
        ok = (100 + percent) * np.minimum(x[:, 0] - x[:, 1], y[:, 0] - y[:, 1]) >= percent * (x[:, 0] + y[:, 0])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(judges[a] ^ judges[b]).sum(1, dtype=np.int64) <= most
        found.extend(forest.join(a[ok], b[ok]))

    # Neighbours in Gray order first: they unite most of a dense group at once.
    a = np.flatnonzero(bucket[1:] == bucket[:-1])
    near(a, a + 1)
    # Then groups of FANOUT against each other, but for those of one component.
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[edge, n])
    of = np.repeat(np.arange(len(edge)), size)
    place = np.arange(n) - edge[of]
    small = size[of] <= FANOUT
    for step in range(2, FANOUT):
        a = np.flatnonzero(small & (place + step < size[of]))
        if len(a):
            near(a, a + step)
    for k in np.flatnonzero(size > FANOUT).tolist():
        at, end = int(edge[k]), int(edge[k] + size[k])
        for lo in range(at, end, FANOUT):
            hi = min(lo + FANOUT, end)
            roots = forest.roots()
            cuts = np.arange(lo, end, FANOUT)
            low, high = np.minimum.reduceat(roots[:end], cuts), np.maximum.reduceat(roots[:end], cuts)
            cuts = cuts[(low != high) | (low != low[0]) | (low[0] != high[0])]
            for s in range(0, len(cuts), 4096):
                others = (cuts[s : s + 4096, None] + np.arange(FANOUT)).ravel()
                others = others[others < end]
                a, b = np.repeat(np.arange(lo, hi), len(others)), np.tile(others, hi - lo)
                near(a[a < b], b[a < b])
    return [(int(order[a]), int(order[b])) for a, b in found]


def cut_bits(bits: list[int], n: int) -> list[list[int]]:
    ends = [len(bits) * k // n for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:])]


def leads(radius: int) -> tuple[list[list[int]], list[list[int]]]:
    """Bits that lead: of each table, and of each table's parts for hot values, first table first."""
    first = cut_bits(list(range(64)), radius + 1)
    second = [a + b for a in first for b in cut_bits([k for k in range(64) if k not in a], radius + 1)]
    return first, second


def mask_of(bits: list[int]) -> int:
    """As a signed number."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def led_by(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The fingerprints with these bits moved to the top, the others below."""
    out = np.zeros_like(fp)
    for to, b in enumerate([*bits, *(k for k in range(64) if k not in bits)]):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(63 - to)
    return out


def whole_buckets(batches, width: int):
    """Columns of about ``CHUNK`` rows, cut between buckets only, of batches sorted by their columns 1 and 2."""
    held: list[list[np.ndarray]] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        table, part = columns[1], columns[2]
        if rows >= CHUNK:
            # The bucket that is open ends where the next begins, be that in a later batch.
            other = np.flatnonzero((table != last[0]) | (part != last[1]))
            if len(other):
                held.append([c[: other[0]] for c in columns])
                yield [np.concatenate(x) for x in zip(*held)]
                held, rows = [], 0
                columns = [c[other[0] :] for c in columns]
        held.append(columns)
        rows += len(columns[0])
        last = (table[-1], part[-1])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def linked(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def bucket_links(dealt: DataFrame, n_judges: int, most: int, percent: int = 80) -> DataFrame:
    """Proposed links (``a``, ``b``) between nodes, of rows dealt and sorted by ``table`` and ``part``.

    Columns: ``node``, ``table``, ``part``, ``fp``, the judges and the two of ``spans``.
    """

    def run(batches):
        for node, table, part, fp, *more in whole_buckets(batches, 6 + n_judges):
            start = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[start, len(fp)])
            # Most buckets have one row.
            live = np.repeat(size > 1, size)
            if not live.any():
                continue
            bucket = np.repeat(np.arange(len(start)), size)[live]
            more = [j[live] for j in more]
            told = np.stack(more[:n_judges], 1).view(np.uint64)
            got = links(fp[live].view(np.uint64), bucket, told, most, np.stack(more[n_judges:], 1), percent)
            node = node[live]
            yield linked(node[[x for x, _ in got]] if got else node[:0], node[[y for _, y in got]] if got else node[:0])

    return dealt.mapInArrow(handing_back(run), "a long, b long").distinct()


def candidate_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints ``fp`` that span all components."""
    first, second = leads(radius)
    masks = [F.lit(mask_of(b)).cast("long") for b in first + second]
    by_value = F.array(*[F.col("fp").bitwiseAND(m) for m in masks[: len(first)]])
    keyed = nodes.select("fp", F.posexplode(by_value).alias("table", "part"))
    hot = keyed.groupBy("table", "part").count().where(F.col("count") > SPLIT).select("table", "part", F.lit(True).alias("hot"))
    # Rows of a hot value go to the parts of its table by their second block.
    apart = F.array(*[F.struct((F.col("table") * (radius + 1) + len(first) + k).alias("table"), F.element_at(F.array(*masks), F.col("table") * (radius + 1) + len(first) + k + 1).alias("mask")) for k in range(radius + 1)])
    whole = F.array(F.struct("table", F.element_at(F.array(*masks), F.col("table") + 1).alias("mask")))
    spread = keyed.join(hot, ["table", "part"], "left").select("fp", F.explode(F.when(F.col("hot"), apart).otherwise(whole)).alias("at"))
    dealt = spread.select("fp", "at.table", F.col("fp").bitwiseAND(F.col("at.mask")).alias("part"))

    def run(batches):
        for fp, table, _ in whole_buckets(batches, 3):
            fp = fp.view(np.uint64)
            for t in np.unique(table).tolist():
                own = fp[table == t]
                bits = (first + second)[t]
                got = GrayIndex(led_by(own, bits), len(bits)).links(radius)
                if got:
                    own = own.view(np.int64)
                    yield linked(own[[x for x, _ in got]], own[[y for _, y in got]])

    sorted_by = dealt.repartition("table", "part").sortWithinPartitions("table", "part")
    return sorted_by.mapInArrow(handing_back(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of every end of an edge the smallest node that it reaches: (``node``, ``component``).

    Alternating large-star and small-star steps; every round is written to the
    shared folder, so that lineage stays short and lost executors cost little.
    """
    now = cut(edges.select("a", "b").where(F.col("a") != F.col("b")), "links")
    while True:
        # Large star: every larger neighbour of a node points to the node's smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("m").alias("a"), "b").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        starred = large.join(down, "b").select("m", F.explode(F.array("a", "b")).alias("to"))
        after = cut(starred.where("m != to").select(F.col("m").alias("a"), F.col("to").alias("b")).distinct(), "links")
        # Links of both rounds are distinct: all are the same if as many, and none is new.
        done = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        discard(now)
        now = after
        if done:
            break
    roots = now.select(F.col("a").alias("node")).distinct()
    out = now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
    # The table that it is read from.
    out.shared_at = now.shared_at
    return out


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The id, ``fp`` and ``component_id`` (the smallest id reachable over links) of every row."""
    prints = cut(fingerprints(df, id_col, text_col, width), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    found = components(candidate_edges(nodes.select("fp"), radius))
    labelled = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(labelled.join(first, "component").select("fp", "component_id"), "named")
    discard(nodes)
    discard(found)
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def gray_links(nodes: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, list[DataFrame]]:
    """Links (``a``, ``b``) that join the nodes (``node``, ``fp``) whose fingerprints the index links, and tables to discard later."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    edges = candidate_edges(prints.select("fp"), radius)
    first, second = (prints.select(F.col("fp").alias(c), F.col("least").alias(to)) for c, to in (("a", "x"), ("b", "y")))
    between = edges.join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # Nodes of one fingerprint by its smallest.
    within = nodes.join(prints, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return between.unionByName(within), [prints]


def set_node(hashes: np.ndarray) -> int:
    """The name of a set as a signed 64-bit number, zero for the empty one."""
    name = xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0
    return name - (1 << 64) if name >> 63 else name


def spot(id_col: str, text_col: str) -> Column:
    """A row's hash by id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``node``, ``component_id`` and ``spot`` of every row: groups of texts alike by five-word shingles.

    Ids that are null name no group; ``spot`` is :func:`spot` of the row.
    """
    from locusframe.llm import ngram_join

    found = ngram_join.join(df, 5, 80, id_col, text_col, empty_alone=False, gray=True)
    return found.select(id_col, "node", "component_id", "spot")
