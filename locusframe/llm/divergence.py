"""Source divergence audit by mergeable radix tries.

How differently do the sources of a language use its words?

1. *Tries*: a task counts the terms of its texts in one byte trie, with a counter
   for each source and one for documents at the leaves.  The trie is held in
   columns, leaf by leaf in the order of bytes; texts are cut into terms and counted
   a few MB at a time, and each count is merged into the trie.  A trie of ``LEAVES``
   leaves is passed on and begun anew, so a task holds little whatever it reads.
2. *Merge*: a trie leaves its task in pages, one for each node of ``PREFIX`` bytes
   with leaves below it: the tails of its terms with their counters.  Pages of a prefix are merged
   within ``MERGED`` groups of tasks; then Spark deals them by ranges of (language,
   prefix), sampled, each range to a task, which merges the pages of a prefix, adds up equal
   leaves and keeps terms of enough documents.  A frequent term is one leaf of each trie, never a row an
   occurrence; pages of a prefix are merged as they come, so that what is held is
   bounded by its distinct terms.
3. *Shares*: with V terms kept in a language and N occurrences of them in a group,
   p = 1 + floor(10**9 (count + 2) / (N + 2 V)); the divergence of p and q at a term is
   floor((p - q)**2 / (p + q)).
4. *Traversal*: kept terms are dealt to cells of ``TERMS`` terms by two blocks of ``SOURCES``
   sources; a cell walks its terms in byte order, adds the divergence of every
   two sources of its blocks up, and holds the ten best terms of each source
   that uses them more than its language, earlier bytes first among
   equals.  Sums of cells are added, candidates of cells ranked.

Numbers of terms, occurrences and sources of a language come from joins, so
nothing is collected or broadcast by hand.  All arithmetic is in integers: quotients
by long division in base 1000, which holds up to 9 * 10**15 occurrences.

Defined cases: null text, language and source count as empty; a text without
terms counts in its group; a language without kept terms has pairs of value 0
and no terms; a language of one source has no pairs; repeated rows count as many
times as they stand; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut

#: Leaves that the trie of a task holds, and pages' leaves that a merge holds, about.
LEAVES = 250_000
HELD = 200_000
#: Groups of tasks whose tries are merged first.
MERGED = 64
#: Pages of a group and prefix from which on merging them spares more than it costs.
FOLD = 4
#: Bytes of a node from which on a trie is cut into pages.
PREFIX = 3
#: Bytes of text that are counted at a time.
GATHER = 4_000_000
#: Terms and sources of a cell, about.
TERMS = 8192
SOURCES = 128
#: Places in which a language's terms meet its numbers.
SALT = 64
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
_BYTES = np.arange(256)
_LETTER = (_BYTES > 127) | (65 <= _BYTES) & (_BYTES <= 90) | (97 <= _BYTES) & (_BYTES <= 122)
_LOWER = np.where((65 <= _BYTES) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_PAGES = "lang string, prefix binary, page binary"
_DEALT = _PAGES + ", salt int"
_LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_LEAF_DDL = "lang string, term binary, docs long, sources array<string>, counts array<long>"


def _binary(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of byte strings, which follow each other in ``data``; ``ends`` starts with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts or byte strings, and where each ends (from 0)."""
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, and of each the position of its text."""
    data, ends = _raw(texts)
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    # A text begins a new term, whatever the one before ends with.
    begin = ends[:-1][ends[:-1] < len(data)]
    first[begin] |= letter[begin]
    at = np.flatnonzero(first)
    place = np.cumsum(letter, dtype=np.int32)
    found = _binary(_LOWER[data[letter]], np.r_[place[at] - 1, place[-1] if len(place) else 0])
    return found, np.searchsorted(ends, at, "right") - 1


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(values[order], at)


class Trie:
    """A byte trie in columns: terms, and at its leaves counters of documents by language and of occurrences by group.

    ``docs`` and ``uses`` are (term, language or group, number) columns; a group is a (language, source).
    """

    def __init__(self):
        self.terms = pa.array([], pa.binary())
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        none = np.zeros(0, np.int64)
        self.docs, self.uses = (none, none, none), (none, none, none)

    @property
    def leaves(self) -> int:
        return len(self.docs[0])

    def count(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(langs, sources)], np.int64)
        found, of = terms_of(texts)
        coded = found.dictionary_encode()
        term = coded.indices.to_numpy().astype(np.int64)
        n, ones = max(len(lang), 1), np.ones(len(term), np.int64)
        # Of each text each term once.
        pair, _ = _added(term * n + of, ones)
        docs, uses = (pair // n, lang[pair % n], np.ones(len(pair), np.int64)), (term, group[of], ones)
        self.merge(coded.dictionary, docs, uses)

    def merge(self, terms: pa.Array, docs: tuple, uses: tuple) -> None:
        """Add the counters of another trie's leaves, whose languages and groups are this one's."""
        before = len(self.terms)
        coded = pa.concat_arrays([self.terms, terms]).dictionary_encode()
        to = coded.indices.to_numpy().astype(np.int64)
        self.terms = coded.dictionary

        def both(old, new, n):
            keys = np.r_[to[old[0]] * n + old[1], to[before + new[0]] * n + new[1]]
            keys, total = _added(keys, np.r_[old[2], new[2]])
            return keys // n, keys % n, total

        self.docs = both(self.docs, docs, max(len(self.langs), 1))
        self.uses = both(self.uses, uses, max(len(self.groups), 1))

    def pages(self) -> Iterator[tuple[str, bytes, bytes]]:
        """(language, prefix, page) in the order of their bytes."""
        if not self.leaves:
            return
        order = pc.sort_indices(self.terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names, groups, n = list(self.langs), list(self.groups), len(order)
        lang_of = np.array([self.langs[g[0]] for g in groups], np.int64)
        at = np.argsort(self.docs[1] * n + rank[self.docs[0]])
        lang, leaf, docs = (x[at] for x in (self.docs[1], rank[self.docs[0]], self.docs[2]))
        use = np.argsort(lang_of[self.uses[1]] * n + rank[self.uses[0]], kind="stable")
        entries = _entries(pa.array([s.encode() for _, s in groups], pa.binary()), self.uses[1][use], self.uses[2][use])
        data, ends = _raw(entries)
        of = lang_of[self.uses[1][use]] * n + rank[self.uses[0][use]]
        # Leaves and uses go in one order.
        start = np.searchsorted(of, lang * n + leaf)
        uses_end = ends[np.r_[start, len(of)]]
        terms = self.terms.take(pa.array(order)).take(pa.array(leaf))
        raw, term_end = _raw(terms)
        size = np.diff(term_end)
        low = np.arange(len(raw), dtype=np.int32) - np.repeat(term_end[:-1], size) >= PREFIX
        prefix = _binary(raw[~low], np.r_[0, np.cumsum(np.minimum(size, PREFIX))])
        tails, tails_end = raw[low], np.r_[0, np.cumsum(np.maximum(size - PREFIX, 0))]
        head = prefix.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (lang[1:] != lang[:-1])])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(leaf)]):
            page = _page(np.diff(tails_end[a : b + 1]), docs[a:b], np.diff(uses_end[a : b + 1]), tails[tails_end[a] : tails_end[b]].tobytes(), data[uses_end[a] : uses_end[b]].tobytes())
            yield names[lang[a]], prefix[a].as_py(), page


def _entries(sources: pa.Array, group: np.ndarray, n: np.ndarray) -> pa.Array:
    """The counters of uses as bytes: number, length of the source's name, name."""
    head = pa.array([struct.pack("<I", len(s.as_py())) + s.as_py() for s in sources], pa.binary())
    numbers = _binary(n.astype("<i8").view(np.uint8), 8 * np.arange(len(n) + 1))
    return pc.binary_join_element_wise(numbers, head.take(pa.array(group)), pa.scalar(b"", pa.binary()))


def _uses(raw: bytes) -> Iterator[tuple[str, int]]:
    at = 0
    while at < len(raw):
        n, size = struct.unpack_from("<qI", raw, at)
        at += 12 + size
        yield raw[at - size : at].decode(), n


def _page(tails: np.ndarray, docs: np.ndarray, uses: np.ndarray, tail_bytes: bytes, use_bytes: bytes) -> bytes:
    return np.r_[len(docs), tails, docs, uses].astype("<i8").tobytes() + tail_bytes + use_bytes


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of a task's tries."""
    trie, salt = Trie(), TaskContext.get().partitionId() % MERGED

    def told():
        rows: list[tuple] = []
        for row in trie.pages():
            rows.append((*row, salt))
            if len(rows) == 5000:
                yield _batch(rows, True)
                rows = []
        if rows:
            yield _batch(rows, True)

    for batch in batches:
        _, ends = _raw(batch.column(0))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + GATHER, "right")) - 1)
            some = batch.slice(at, to - at)
            trie.count(some.column(0), some.column(1).to_pylist(), some.column(2).to_pylist())
            at = to
            if trie.leaves >= LEAVES:
                yield from told()
                trie = Trie()
    yield from told()


def _batch(rows: list[tuple], dealt: bool = False) -> pa.RecordBatch:
    kinds = [("lang", pa.string()), ("prefix", pa.binary()), ("page", pa.binary()), ("salt", pa.int32())][: 4 if dealt else 3]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


class Merge:
    """Pages of several tries to the sums of their leaves."""

    def summed(self, pages: list[tuple[str, bytes, bytes]]):
        """Leaves of pages, added up: position of their (language, prefix), tail, documents, uses."""
        heads: dict[tuple[str, bytes], int] = {}
        of, lens, docs, sizes, tails, uses = [], [], [], [], [], []
        for lang, prefix, page in pages:
            n = leaves_of(page)
            told = np.frombuffer(page, "<i8", 3 * n, 8).reshape(3, n)
            of.append(np.full(n, heads.setdefault((lang, prefix), len(heads))))
            lens.append(told[0])
            docs.append(told[1])
            sizes.append(told[2])
            middle = 8 + 24 * n + int(told[0].sum())
            tails.append(page[8 + 24 * n : middle])
            uses.append(page[middle:])
        of, lens, docs, sizes = (np.concatenate(x) for x in (of, lens, docs, sizes))
        coded = _binary(b"".join(tails), np.r_[0, np.cumsum(lens)]).dictionary_encode()
        key = of * len(coded.dictionary) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        return list(heads), of, coded, order, at, np.add.reduceat(docs[order], at), b"".join(uses), np.r_[0, np.cumsum(sizes)]

    def leaves(self, pages, least: int = 0):
        """(language, prefix, tail, documents, {source: occurrences}) of leaves in ``least`` documents at least."""
        heads, of, coded, order, at, docs, uses, ends = self.summed(pages)
        stop = np.r_[at[1:], len(order)]
        keep = docs >= least
        for a, b, n in zip(at[keep].tolist(), stop[keep].tolist(), docs[keep].tolist()):
            total: dict[str, int] = {}
            for k in order[a:b].tolist():
                for source, m in _uses(uses[ends[k] : ends[k + 1]]):
                    total[source] = total.get(source, 0) + m
            lang, prefix = heads[of[order[a]]]
            yield lang, prefix, coded.dictionary[coded.indices[int(order[a])].as_py()].as_py(), n, total

    def one(self, pages: list[tuple[str, bytes, bytes]]) -> list[tuple[str, bytes, bytes]]:
        """Pages of one prefix as a single one."""
        if len(pages) < 2:
            return pages
        found = list(self.leaves(pages))
        names = sorted({s for *_, total in found for s in total})
        place = {s: k for k, s in enumerate(names)}
        group, n = (np.array([f(x) for *_, total in found for x in total.items()], np.int64) for f in (lambda x: place[x[0]], lambda x: x[1]))
        data, ends = _raw(_entries(pa.array([s.encode() for s in names], pa.binary()), group, n))
        sizes = np.diff(ends[np.r_[0, np.cumsum([len(total) for *_, total in found])]])
        return [(*pages[0][:2], _page(np.array([len(x[2]) for x in found]), np.array([x[3] for x in found]), sizes, b"".join(x[2] for x in found), data.tobytes()))]

    def runs(self, batches, width: int) -> Iterator[list[tuple]]:
        """Rows in their order, about ``HELD`` leaves at a time and cut between runs of one key only.

        The key is the language, the prefix and, of ``width`` 3, the salt; a run that goes on becomes a page as it comes.
        """
        held: list[tuple] = []
        n = least = 0
        key = lambda row: (row[0], row[1], *row[3 : width + 1])
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if n > max(HELD, 2 * least):
                    open_at = next(k for k, x in enumerate(held) if key(x) == key(held[-1]))
                    if key(held[-1]) != key(row):
                        yield held
                        held, n, least = [], 0, 0
                    else:
                        if open_at:
                            yield held[:open_at]
                        rest = held[open_at][3:]
                        held = [(*x, *rest) for x in self.one([x[:3] for x in held[open_at:]])]
                        n = least = leaves_of(held[0][2])
                held.append(row)
                n += leaves_of(row[2])
        if held:
            yield held


def leaves_of(page: bytes) -> int:
    return int.from_bytes(page[:8], "little")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages sorted by (language, prefix, salt) one page each, where it takes the place of ``FOLD`` or more."""
    merge = Merge()
    for held in merge.runs(batches, 3):
        out, at = [], 0
        for k in range(1, len(held) + 1):
            if k == len(held) or (*held[k][:2], held[k][3]) != (*held[at][:2], held[at][3]):
                some = [x[:3] for x in held[at:k]]
                out += merge.one(some) if len(some) >= FOLD else some
                at = k
        yield _batch(out)


def _merged(min_docs: int):
    """Of pages sorted by (language, prefix) the leaves in ``min_docs`` documents at least."""

    def run(batches):
        merge = Merge()
        for held in merge.runs(batches, 2):
            rows = [(lang, prefix + tail, n, list(total), list(total.values())) for lang, prefix, tail, n, total in merge.leaves(held, min_docs)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _LEAF)], schema=_LEAF)

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang``, ``term`` (bytes), ``docs`` and, by source, ``counts`` of the terms kept."""
    dealt = docs.select("text", "lang", "source").mapInArrow(_tries, _DEALT)
    # Tries are merged in groups first, so that a prefix that many terms share comes from every group once.
    grouped = dealt.repartition("lang", "prefix", "salt").sortWithinPartitions("lang", "prefix", "salt")
    pages = cut(grouped.mapInArrow(_folded, _PAGES), "pages")
    ranged = pages.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return ranged.mapInArrow(_merged(min_docs), _LEAF_DDL)


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / whole), exactly; ``whole`` is over ``count + 1``."""
    rest, out = count + 2, np.zeros_like(count)
    # A share may be all: the quotient by itself first, then three digits of base 1000.
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _cell(top: int):
    """Sums of the divergence of a cell's sources and the candidates among its terms."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(terms: pa.Table, groups: pa.Table) -> pa.Table:
        if not groups.num_rows:
            return schema.empty_table()
        groups = groups.sort_by("source")
        sources = groups.column("source").to_pylist()
        lang, i, j = (groups.column(c)[0].as_py() for c in ("lang", "i", "j"))
        place = {s: k for k, s in enumerate(sources)}
        block = groups.column("block").to_numpy()
        whole = groups.column("whole").to_numpy()
        everything = groups.column("everything")[0].as_py()
        terms = terms.sort_by("term")
        names = terms.column("term").to_pylist()
        total = np.zeros((len(sources), len(sources)), np.int64)
        best: list[list[tuple[int, int]]] = [[] for _ in sources]
        step = max(1, 4_000_000 // max(len(sources) ** 2, 1))
        for a in range(0, len(names), step):
            some = terms.slice(a, step)
            count = np.zeros((some.num_rows, len(sources)), np.int64)
            used = some.column("sources").to_pylist()
            for row, (own, n) in enumerate(zip(used, some.column("counts").to_pylist())):
                for s, x in zip(own, n):
                    at = place.get(s)
                    if at is not None:
                        count[row, at] = x
            p = share(count, whole[None, :])
            for k in range(len(sources)):
                total[k] += divergence(p[:, k : k + 1], p).sum(0)
            if i == j:
                q = share(some.column("total").to_numpy(), np.int64(everything))
                for k in range(len(sources)):
                    at = np.flatnonzero((count[:, k] > 0) & (p[:, k] > q))
                    value = divergence(p[at, k], q[at])
                    first = np.argsort(-value, kind="stable")[:top]
                    # Earlier terms stand first, and stay first among equals.
                    best[k] = sorted(best[k] + list(zip((-value[first]).tolist(), (at[first] + a).tolist())))[:top]
        out = []
        for x in range(len(sources)):
            for y in range(len(sources)):
                # Either every two sources of one block, or those of different blocks.
                if x != y and (i == j or block[x] != block[y]):
                    out.append((lang, sources[x], "pair", sources[y], int(total[x, y])))
        for k, found in enumerate(best):
            out += [(lang, sources[k], "term", names[at].decode(), -value) for value, at in found]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    ``part`` is ``pair`` (items: the other sources of the language) or ``term`` (items: the ``top`` terms that the source uses
    more than the language does).
    """
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    kept = cut(kept_terms(docs, min_docs).withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), "terms")
    spoken = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n"))
    used = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("u")).groupBy("lang", F.col("u.sources").alias("source")).agg(F.sum("u.counts").alias("n"))
    every = docs.select("lang", "source").distinct()
    blocks = every.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("s"))
    sized = blocks.join(spoken, "lang", "left").select("lang", "s", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("all"))
    sized = sized.withColumn("t", F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int"))
    # Groups go to all cells of their block; terms to one block of terms, against every two blocks of sources.
    other = F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o")
    groups = every.join(used, ["lang", "source"], "left").join(sized, "lang")
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("s")).cast("int"))
    whole = F.coalesce("n", F.lit(0)) + 2 * F.col("v")
    groups = groups.select("lang", "source", "block", "t", whole.alias("whole"), (F.col("all") + 2 * F.col("v")).alias("everything"), other)
    groups = groups.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    groups = groups.select("lang", "source", "block", "whole", "everything", "b", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    # A language may have most terms: these meet its numbers in many places.
    spread = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    terms = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int")).join(spread, ["lang", "salt"]).withColumn("b", F.pmod(F.xxhash64("term"), F.col("t")).cast("int"))
    terms = terms.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("s") - 1)))
    key = ["lang", "b", "i", "j"]
    terms = terms.select(*[F.col(c).alias(c) for c in (*key, "term", "sources", "counts", "total")])
    cells = terms.groupBy(*key).cogroup(groups.groupBy(*key))
    found = cells.applyInArrow(_cell(top), "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
