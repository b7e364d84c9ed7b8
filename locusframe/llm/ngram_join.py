"""N-gram Jaccard join by token-combination prefixes.

Texts are sets of word n-grams (tokens, hashed to 64 bits); two link when their
similarity is ``percent`` hundredths or more.  Of a set of n tokens at most
m = n - ceil(percent n / 100) can be missing from a partner, so the first m + 1
tokens in an order that all sets share cannot all be missing.

1. *Nodes*: equal sets are one node from here on, whatever the number of copies.
2. *Classes*: each node posts its tokens of the lowest hashes, a third as many again as
   m + 1; their nodes are counted exactly, by partial sums.  Tokens of
   more than ``OFTEN`` nodes are frequent, of more than ``VERY`` very frequent.
   Nodes that have fewer than m + 1 other tokens there post their whole set,
   whose tokens are counted too, once more if that makes others short; what no
   one has counted is rare.  The shared order: rare tokens by hash, then frequent ones by hash.
3. *Signatures*: rare tokens of a prefix stand alone.  Where they are fewer than
   m + 1, the prefix is extended into the frequent tokens, which are dealt by
   hash to classes, pairs of them for frequent and triples for very frequent
   tokens: if p tokens of a class are in the prefix, p - k + 1 of them must be missing before no
   combination of k is shared, so the prefix goes on until those sums reach m + 1.
   The number of classes follows the size of the set, so that combinations stay in
   proportion to it; sets near a change of that number post under both.
   A pair of partners shares a signature, always.
4. *Proposals*: nodes of one signature are compared by size and by 192 bits of
   SimHash; a task passes on a spanning forest, never all pairs.  Signatures of
   more than ``BUCKET`` nodes are dealt in blocks, every two of which meet.
5. *Verification*: the sets of a group of proposals meet (large groups in blocks, every
   two of which meet), and exact counts of common tokens decide.

The order and the classes decide on cost only; the links found are all links,
but for the 192 bits: at a similarity of 0.8 some 30 of them differ (36 in the smallest sets), and pairs
pass up to 72, which by a binomial model loses under one pair in 10**9.

Defined cases: A-Z are lower-cased, words are runs of bytes other than space and 9 to 13; fewer
words than n are one token; a text without words, or null, has the
empty set, which links with nothing (or, with ``empty_alone`` off, with other empty sets); copies, ties and repeated rows
share a component; rows with a null id link others but name no component; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm import simhash
from locusframe.llm.common import cut, discard, handing_back, release, sifted

#: Nodes of a token from which on it is frequent, and very frequent.
OFTEN = 32
VERY = 2048
#: Nodes of a signature that one block holds, and sets of a group.
BUCKET = 4096
BLOCK = 10_000
#: Tokens of a set for each class of frequent ones.
CLASS = 32
_JUDGES = [f"j{k}" for k in range(simhash.JUDGES)]


def missing(n: int, percent: int) -> int:
    """Of n tokens, how many can be missing from a partner."""
    return n - -(-percent * n // 100)


def window(n: int, percent: int) -> int:
    """Tokens that a set of n posts at first."""
    need = missing(n, percent) + 1
    return min(n, need + need // 3 + 6)


def _needed(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100) + 1


def _window(n: Column, percent: int) -> Column:
    need = _needed(n, percent)
    return F.least(n, need + F.floor(need / 3) + 6)


#: An odd base of polynomials of bytes modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of the shingles, sorted, each once.

    A shingle's hash is the polynomial of its bytes, taken from sums over the whole text, and mixed.
    """
    words = simhash.words_of(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    space = np.flatnonzero(joined == 32)
    starts, ends = np.r_[0, space + 1], np.r_[space, len(joined)]
    if len(starts) > width:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    with np.errstate(over="ignore"):
        sums = np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(joined)), dtype=np.uint64)
        sums = np.r_[np.zeros(1, np.uint64), sums]
        h = (sums[ends] - sums[starts]) * _powers(_BACK, len(joined))[starts]
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        h ^= h >> np.uint64(33)
    return np.unique(h)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def levels(n: int, percent: int) -> range:
    """The class numbers, as powers of two, that a set of n shares with any partner."""
    level = lambda size: max(0, (size // CLASS).bit_length() - 1)
    return range(level(-(-percent * n // 100)), level(n) + 1)


def signatures(n: int, known: int, tokens: list[tuple[int, int, int]], percent: int) -> list[int]:
    """Signatures of a set of n tokens, of which the first ``known`` by hash are classed.

    ``tokens`` are (place, token, nodes), all frequent ones among them; those left out are in no other set.
    """
    need = missing(n, percent) + 1
    # Tasks may have said the same token.
    tokens = sorted(set(tokens))
    hot = [t for t in tokens if t[2] > OFTEN]
    before = 0
    out = []
    for place, token, nodes in tokens:
        if nodes > OFTEN:
            before += 1
        elif place - before < need:
            out.append(token)
    rare = known - len(hot)
    if rare >= need:
        return out
    if known < n:
        raise ValueError("a set with too few rare tokens must be known whole")
    for level in levels(n, percent):
        covered, groups = rare, {}
        for _, token, nodes in hot:
            k = 3 if nodes > VERY else 2
            group = groups.setdefault((k, token & (1 << level) - 1), [])
            group.append(token)
            covered += len(group) >= k
            if covered >= need:
                break
        if covered < need:
            # A set of very few tokens: each stands alone.
            out += [token for _, token, _ in hot]
            continue
        for (k, _), group in groups.items():
            for some in combinations(sorted(group), k):
                out.append(_signed(xxhash.xxh64_intdigest(np.array([level, k, *some], np.int64).tobytes(), simhash.SEED)))
    return out


def signed(node: np.ndarray, n: np.ndarray, known: np.ndarray, place: np.ndarray, token: np.ndarray, nodes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`signatures` and their nodes, of rows sorted by node, size, part known, place and token, each a token of a set."""
    differ = (node[1:] != node[:-1]) | (n[1:] != n[:-1]) | (known[1:] != known[:-1])
    # Tasks may have said the same token.
    once = np.r_[True, differ | (place[1:] != place[:-1]) | (token[1:] != token[:-1])]
    start = np.flatnonzero(np.r_[True, differ][once])
    node, n, known, place, token, nodes = (x[once] for x in (node, n, known, place, token, nodes))
    of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(node)]))
    hot = nodes > OFTEN
    before = np.cumsum(hot) - hot
    before -= before[start][of]
    need = missing(n, percent) + 1
    # Sets with too few rare tokens go one by one, which most need not.
    short = known[start] - np.add.reduceat(hot.astype(np.int64), start) < need[start]
    rare = ~hot & (place - before < need) & ~short[of]
    sigs, owners = [token[rare]], [node[rare]]
    ends = np.r_[start, len(node)]
    for k in np.flatnonzero(short).tolist():
        a, b = int(ends[k]), int(ends[k + 1])
        own = signatures(int(n[a]), int(known[a]), list(zip(place[a:b].tolist(), token[a:b].tolist(), nodes[a:b].tolist())), percent)
        sigs.append(np.array(own, np.int64))
        owners.append(np.full(len(own), node[a]))
    return np.concatenate(sigs), np.concatenate(owners)


def read(given: DataFrame, width: int, percent: int) -> DataFrame:
    """Of every row of (``key``, ``text``, ``spot``) the set: ``node``, ``n``, judges and ``front``, its first tokens."""

    def run(batches):
        for batch in batches:
            marks = np.zeros((batch.num_rows, len(_JUDGES)), np.uint64)
            names, sizes, fronts = [], [], []
            for i, text in enumerate(batch.column(1)):
                s = shingles(text.as_py(), width)
                names.append(simhash.set_node(s))
                sizes.append(len(s))
                if len(s):
                    marks[i] = simhash.variations(s, len(_JUDGES))
                fronts.append(s[: window(len(s), percent)].view(np.int64))
            ends = np.cumsum([0, *map(len, fronts)])
            front = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*fronts, np.zeros(0, np.int64)])))
            columns = [pa.array(np.ascontiguousarray(marks[:, k]).view(np.int64)) for k in range(len(_JUDGES))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *columns, front],
                ["key", "spot", "node", "n", *_JUDGES, "front"],
            )

    layout = "key long, spot long, node long, n long, " + ", ".join(f"{m} long" for m in _JUDGES) + ", front array<long>"
    return given.mapInArrow(handing_back(run), layout)


def _texts(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` but ``spot``, and ``text``: only texts that may be wanted are shuffled."""
    kept = [c for c in wanted.columns if c != "spot"]
    return sifted(given.select("spot", "text"), "spot", wanted).join(wanted, "spot").select(*kept, "text")


def _own(batches, width: int):
    """Of batches with a ``node`` and a ``text``: the batch, which of its rows say the node's set, and these sets, about once a task."""
    seen: set[int] = set()
    for batch in batches:
        at, sets = [], []
        for i, (node, text) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text"))):
            if node in seen:
                continue
            s = shingles(text.as_py(), width)
            if simhash.set_node(s) == node:
                seen.add(node)
                at.append(i)
                sets.append(s)
        yield batch, at, sets


def _sets(given: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The columns of ``wanted`` (``spot``, ``node`` and others) with the ``hashes`` of each node, about once a task."""
    rows = _texts(given, wanted)

    def run(batches):
        for batch, at, sets in _own(batches, width):
            told = batch.drop_columns("text").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*told.columns, pa.array([s.tobytes() for s in sets], pa.binary())], [*told.schema.names, "hashes"])

    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", hashes binary"
    return rows.mapInArrow(handing_back(run), layout)


def _tokens(given: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(``node``, ``n``, ``place``, ``token``) of whole sets, again for each task that has a row equal to the node's.

    One map from texts on: a second one behind it would keep a second Python process for every task.
    """

    def run(batches):
        for batch, at, sets in _own(batches, width):
            nodes = batch.column("node").take(pa.array(at, pa.int64())).to_numpy()
            # A few at a time, as each set is many rows.
            for k in range(0, len(sets), 64):
                some = sets[k : k + 64]
                sizes = np.array([len(s) for s in some])
                columns = [np.repeat(nodes[k : k + 64], sizes), np.repeat(sizes, sizes), np.concatenate([np.arange(x) for x in sizes]), np.concatenate(some).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "n", "place", "token"])

    return _texts(given, wanted).mapInArrow(handing_back(run), "node long, n long, place long, token long")


def posted(given: DataFrame, nodes: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(``sig``, ``node``): what each node is indexed by, and tables to discard later."""
    first = nodes.select("node", "n", F.posexplode("front").alias("place", "token")).withColumn("place", F.col("place").cast("long"))
    seen = cut(first.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "seen")
    release(given.sparkSession)
    shared = cut(first.join(seen, "token").select("node", "n", "place", "token", "c"), "shared")
    made = [seen, shared]

    def short(rows: DataFrame) -> DataFrame:
        """Nodes of which a part is known, with too few rare tokens there."""
        hot = rows.where(F.col("c") > OFTEN).groupBy("node", "n").agg(F.count("*").alias("hot"))
        known = _window(F.col("n"), percent)
        return hot.where((known < F.col("n")) & (known - F.col("hot") < _needed(F.col("n"), percent))).select("node")

    def whole(some: DataFrame) -> DataFrame:
        # Written first: where Spark sees that these are few, no text is shuffled.
        told = cut(nodes.join(some, "node").select("spot", "node"), "told")
        out = cut(_tokens(given, told, width), "whole")
        discard(told)
        return out

    rows = shared.withColumn("known", _window(F.col("n"), percent).cast("long"))
    wanting = cut(short(shared), "short")
    made.append(wanting)
    if not wanting.isEmpty():
        more = whole(wanting)
        made.append(more)
        # The classes are settled here: nodes in which a token stands at the front, and nodes that say all.
        again = cut(more.groupBy("token").agg(F.count("*").alias("e")), "again")
        made.append(again)

        def classed(rows: DataFrame) -> DataFrame:
            counted = rows.join(again, "token", "left") if "c" in rows.columns else rows.join(seen, "token", "left").join(again, "token", "left")
            return counted.withColumn("c", F.coalesce("c", F.lit(0)) + F.coalesce("e", F.lit(0))).drop("e")

        def also(tokens: DataFrame) -> DataFrame:
            """Tokens that only one front has, but a set that is known whole has as well."""
            # Written, as Spark would join before it sifts.
            some = cut(sifted(first, "token", tokens), "some")
            made.append(some)
            return classed(some.join(tokens, "token", "left_semi").join(seen, "token", "left_anti"))

        found = cut(also(again), "also")
        made.append(found)
        partly = classed(shared).unionByName(found)
        late = cut(short(partly.join(wanting, "node", "left_anti")), "short")
        made.append(late)
        if not late.isEmpty():
            rest = whole(late)
            made.append(rest)
            new = cut(rest.select("token").distinct().join(again, "token", "left_anti"), "new")
            made.append(new)
            partly = partly.unionByName(also(new))
            more = more.unionByName(rest)
        partly = partly.join(wanting.unionByName(late), "node", "left_anti")
        rows = partly.withColumn("known", _window(F.col("n"), percent).cast("long")).unionByName(classed(more).withColumn("known", F.col("n")))

    def run(batches):
        for place, node, n, known, token, nodes in simhash.whole_buckets(batches, 6):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in signed(node, n, known, place, token, nodes, percent)], ["sig", "node"])

    # Tokens stay rows, which tasks sort and pass on a few at a time; a list of each node's would be objects in both languages.
    by_node = rows.select("place", "node", "n", "known", "token", "c").repartition("node").sortWithinPartitions("node", "n", "known", "place", "token")
    return by_node.mapInArrow(handing_back(run), "sig long, node long").distinct(), made


def proposals(posts: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """Links (``a``, ``b``) between nodes of one signature that may be alike, in blocks."""
    sizes = posts.groupBy("sig").agg(F.count("*").alias("s")).where("s > 1").select("sig", F.ceil(F.col("s") / BUCKET).cast("int").alias("g"))
    dealt = posts.join(sizes, "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda k: (k != F.col("own")) | (F.col("g") == 1))
    dealt = dealt.withColumn("other", F.explode(other))
    cell = (F.least("own", "other").cast("long") * F.col("g") + F.greatest("own", "other")).alias("table")
    dealt = dealt.select("node", cell, F.col("sig").alias("part")).join(nodes.select("node", "n", *_JUDGES), "node")
    dealt = dealt.select("node", "table", "part", F.col("j0").alias("fp"), *_JUDGES, "n", F.lit(0).cast("long").alias("place"))
    dealt = dealt.repartition("table", "part").sortWithinPartitions("table", "part")
    return simhash.bucket_links(dealt, len(_JUDGES), most, percent)


def alike(sets: list[np.ndarray], percent: int = 80) -> np.ndarray:
    """Of each set the first position of its component over pairs with that similarity or more, counted."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Rarest first, as places in one order.
    place = np.empty(len(values), np.int64)
    place[np.lexsort((values, counts))] = np.arange(len(values))
    sets = np.split(place[inverse], np.cumsum(sizes)[:-1])
    up = np.arange(len(sets))

    def find(i):
        while True:
            above = up[i]
            if (up[above] == above).all():
                return above
            up[i] = up[above]

    mark = np.zeros(len(values), bool)
    tried = np.full(len(sets), -1)
    # Of each shingle the texts that have it in their prefixes, by size.
    order = np.argsort(sizes, kind="stable")
    fronts = [np.sort(sets[i])[: missing(len(sets[i]), percent) + (len(sets[i]) > 0)] for i in order.tolist()]
    token = np.concatenate(fronts)
    owner = np.repeat(order, [len(x) for x in fronts])
    rank = np.repeat(np.arange(len(order)), [len(x) for x in fronts])
    by = np.lexsort((rank, token))
    owner, rank, token = owner[by], rank[by], token[by]
    at = np.searchsorted(token, np.arange(len(values) + 1))
    for r, i in enumerate(order.tolist()):
        mark[sets[i]] = True
        for t in fronts[r].tolist():
            a, b = at[t], at[t + 1]
            j = owner[a : a + np.searchsorted(rank[a:b], r)]
            j = j[(tried[j] != i) & (100 * sizes[j] >= percent * sizes[i])]
            j = j[find(j) != find(np.array([i]))] if len(j) else j
            while len(j):
                tried[j[-1]] = i
                one, j = int(j[-1]), j[:-1]
                if (100 + percent) * int(mark[sets[one]].sum()) >= percent * int(sizes[i] + sizes[one]):
                    x, y = int(find(np.array([i]))[0]), int(find(np.array([one]))[0])
                    up[max(x, y)] = min(x, y)
                    j = j[find(j) != min(x, y)]
        mark[sets[i]] = False
    return find(np.arange(len(sets)))


def confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """(``node``, ``component``) by the sets (``near``, ``node``, ``g``, ``hashes``) of groups, each of ``g`` blocks."""
    own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    # Every two blocks meet; a group of one block meets itself.
    other = F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda k: (k != F.col("own")) | (F.col("g") == 1))
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.select("near", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "hashes")

    def run(batches):
        cell, held = None, {}

        def settle():
            nodes = sorted(held)
            first = alike([np.frombuffer(held[k], np.uint64) for k in nodes], percent)
            component = [nodes[k] for k in first.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(component, pa.int64())], ["node", "component"])

        for batch in batches:
            for near, i, j, node, hashes in zip(*[c.to_pylist() for c in batch.columns[:4]], batch.column(4)):
                if (near, i, j) != cell and held:
                    yield settle()
                    held = {}
                cell = near, i, j
                held[node] = hashes.as_py()
        if held:
            yield settle()

    return dealt.repartition("near", "i", "j").sortWithinPartitions("near", "i", "j").mapInArrow(handing_back(run), "node long, component long")


def join(
    df: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", empty_alone: bool = True, most: int = simhash.JUDGED_BITS, gray: bool = False
) -> DataFrame:
    """The id, ``n_shingles``, ``node``, ``component_id`` and ``spot`` of every row.

    With ``gray`` nodes whose fingerprints the Gray-order index of :mod:`.simhash` links are proposed as well.
    ``component_id`` is the smallest id reachable by links; ``spot`` is :func:`locusframe.llm.simhash.spot` of the row.
    """
    given = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    given = given.withColumn("spot", simhash.spot("key", "text"))
    prints = cut(read(given, width, percent).withColumnRenamed("key", id_col), "prints")
    held = prints.groupBy("node", "n", *_JUDGES).agg(F.min(id_col).alias("least"), F.min("spot").alias("spot"), F.first("front").alias("front"))
    nodes = cut(held, "nodes")
    rows = cut(prints.select(id_col, "node", "n", "spot"), "rows")
    discard(prints)
    posts, made = posted(given, nodes, width, percent)
    posts = cut(posts, "posts")
    for table in made:
        discard(table)
    links, indexed = proposals(posts, nodes, percent, most), []
    if gray:
        near, indexed = simhash.gray_links(nodes.where("n > 0").select("node", F.col("j0").alias("fp")))
        links = near.unionByName(links)
    found = simhash.components(links)
    for table in [posts, *indexed]:
        discard(table)
    near = found.withColumnRenamed("component", "near")
    # One row of each text in question says its set.
    sizes = near.groupBy("near").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    wanted = cut(nodes.select("node", "spot").join(near, "node").join(sizes, "near").select("near", "node", "spot", "g"), "wanted")
    joined = confirmed(_sets(given, wanted, width), percent)
    done = [nodes, found, wanted]
    if not wanted.where("g > 1").isEmpty():
        # What the cells of a group found apart comes together.
        joined = simhash.components(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).distinct())
        done.append(joined)
    labelled = nodes.select("node", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = cut(labelled, "labelled")
    for table in done:
        discard(table)
    first = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(labelled.join(first, "component").select("node", "component_id"), "named")
    discard(labelled)
    own = F.when(F.lit(empty_alone) & (F.col("n") == 0), F.col(id_col)).otherwise(F.col("component_id"))
    return rows.join(named, "node").select(id_col, F.col("n").alias("n_shingles"), "node", own.alias("component_id"), "spot")
