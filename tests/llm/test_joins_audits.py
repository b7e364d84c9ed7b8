"""N-gram join, source divergence and hard negatives against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.llm import divergence, mining, ngram_join, simhash, topk
from locusframe.llm.common import cut, handing_back, sifted


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    links = 0
    for b in range(len(rows)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links += sets[a] != sets[b]
                x, y = group[a], group[b]
                if x != y:
                    group = [min(x, y) if g in (x, y) else g for g in group]
    least = defaultdict(list)
    for (i, _), g in zip(rows, group):
        least[g].append(i)
    return [(i, len(s), min((k for k in least[g] if k is not None), default=None)) for (i, _), s, g in zip(rows, sets, group)], links


def near_rows(r, n=70):
    """Texts around a similarity of 0.85, short ones too, many with a shared passage or made of shared lines."""
    words = ["".join(r.choices("abcdefghijklmn", k=r.randint(2, 9))) for _ in range(3000)]
    passage, lines = r.choices(words, k=40), [r.choices(words, k=12) for _ in range(6)]
    texts = []
    for i in range(n):
        size = r.choice([5, 6, 7, 9, 10, 14, 30, 80, 300])
        base = r.choices(words, k=size)
        if i % 3 == 0:
            base = base + passage
        if i % 7 == 0:
            base = sum(r.sample(lines, 4), []) + r.choices(words, k=2)
        texts.append(base)
        for _ in range(2):
            copy = list(base)
            for k in r.sample(range(len(base)), max(1, round(len(base) * r.uniform(0.01, 0.025)))):
                copy[k] = "new"
            texts.append(copy)
        texts += [base + r.choices(words, k=max(1, len(base) // 6)), base[1:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(9000, rows[5][1]), (9001, None), (9002, ""), (9003, " \t"), (9004, "One"), (9005, "one"), (9006, rows[7][1].upper()), (9007, "w " * 20_000), (None, rows[9][1])]


@pytest.mark.parametrize("often, very, bucket, block", [(32, 2048, 4096, 10_000), (2, 4, 2, 3), (0, 0, 2, 10_000), (0, 100, 4096, 4)])
def test_ngram_join(spark, monkeypatch, often, very, bucket, block):
    for name, x in (("OFTEN", often), ("VERY", very), ("BUCKET", bucket), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, x)
    rows = near_rows(random.Random(often + 5))
    want, links = brute_components(rows, 4, 85)
    assert links > 60 and len({c for _, _, c in want}) > 60
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    out = ngram_join.join(df).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_partners_share_a_signature(monkeypatch):
    """Whatever tokens are frequent, and however the sets differ."""
    monkeypatch.setattr(ngram_join, "OFTEN", 3)
    monkeypatch.setattr(ngram_join, "VERY", 6)
    r = random.Random(3)
    for _ in range(600):
        n = r.choice([6, 7, 8, 20, 63, 64, 70, 130, 300])
        universe = [r.getrandbits(63) for _ in range(n)]
        nodes = {t: r.choice([1, 5, 9]) if r.random() < 0.9 else 1 for t in universe}
        gone = r.randint(0, ngram_join.missing(n, 85))
        x, y = set(universe), set(r.sample(universe, n - gone))
        for _ in range(r.randint(0, 3)):
            t = r.getrandbits(63)
            nodes[t] = r.choice([1, 5, 9])
            x.add(t)
        if 100 * len(x & y) < 85 * len(x | y):
            continue
        told = [ngram_join.signatures(len(s), len(s), [(k, t, nodes[t]) for k, t in enumerate(sorted(s))], 85) for s in (x, y)]
        assert set(told[0]) & set(told[1]) or x == y


def test_a_shingle_of_very_many_texts(spark, monkeypatch):
    """Texts that share one line meet in no task as a whole, and only copies link."""
    monkeypatch.setattr(ngram_join, "BUCKET", 64)
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    rows = [(i, "all of these share one line " + " ".join(word() for _ in range(12))) for i in range(600)]
    rows += [(1000, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x.component_id for x in ngram_join.join(df).collect()}
    assert out[1000] == 3 and sum(out[i] == i for i in out) == 600


def brute_divergence(rows, min_docs, top):
    count, total, docs, groups = Counter(), Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        for t in found:
            count[lang, source, t] += 1
            total[lang, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in docs.items() if k == lang and n >= min_docs]
        sources = sorted(s for k, s in groups if k == lang)
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s, t] + 2) // (n[s] + 2 * len(kept)) for t in kept} for s in sources}
        every = sum(n.values())
        q = {t: 1 + 10**9 * (total[lang, t] + 2) // (every + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]}
            parts["term"] = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("leaves, terms, sources", [(250_000, 8192, 128), (5, 7, 2)])
def test_divergence(spark, monkeypatch, leaves, terms, sources):
    for name, x in (("LEAVES", leaves), ("TERMS", terms), ("SOURCES", sources), ("GATHER", 90 if leaves == 5 else 4_000_000), ("HELD", 20 if leaves == 5 else 200_000)):
        monkeypatch.setattr(divergence, name, x)
    r = random.Random(2)
    vocabulary = ["".join(r.choices("abcé漢ÀZ", k=r.randint(1, 4))) for _ in range(90)]
    rows = [(" ".join(r.choices(vocabulary[: 20 + 10 * k], k=r.randint(0, 30))) + r.choice(["", "!", " A1b\x00c"]), r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "s3", None, "", "é"])) for k in [r.randrange(7) for _ in range(300)]]
    rows += [(None, "none", "a"), ("", "none", "b"), ("rare", "alone", "x"), ("word " * 50_000, "en", "s1"), rows[0], rows[0]]
    df = spark.createDataFrame([(t, k, s, "u", 1) for t, k, s in rows], "text string, lang string, source string, term string, total int").repartition(5)
    out = divergence.audit(df, min_docs=4)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == brute_divergence(rows, 4, 10)
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("held, fold", [(200_000, 2), (3, 2), (200_000, 4), (3, 4)])
def test_tries(monkeypatch, held, fold):
    """Pages of several tries, cut anyhow, merge to the counts of all terms."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "FOLD", fold)
    r = random.Random(5)
    texts = ["".join(r.choices("abAé 1", k=r.randint(0, 40))) for _ in range(300)]
    uses, docs, pages = Counter(), Counter(), []
    for a in range(0, 300, 60):
        trie = divergence.Trie()
        for b in range(a, a + 60, 20):
            some = texts[b : b + 20]
            trie.count(pa.array(some), ["l" if k % 2 else "m" for k in range(20)], [f"s{k % 3}" for k in range(20)])
            for k, t in enumerate(some):
                found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.replace("A", "a"))
                for w in found:
                    uses["l" if k % 2 else "m", w, f"s{k % 3}"] += 1
                for w in set(found):
                    docs["l" if k % 2 else "m", w] += 1
        own = list(trie.pages())
        assert [x[:2] for x in own] == sorted(x[:2] for x in own) or {x[0] for x in own} == {"l", "m"}
        pages += own
    pages.sort(key=lambda x: x[:2])
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pages[k : k + 7])], ["lang", "prefix", "page"]) for k in range(0, len(pages), 7)]
    out = [row for b in divergence._merged(1)(iter(batches)) for row in b.to_pylist()]
    dealt = sorted(((*x, k % 3) for k, x in enumerate(pages)), key=lambda x: (*x[:2], x[3]))
    batches_ = [divergence._batch(dealt[k : k + 7], True) for k in range(0, len(dealt), 7)]
    folded = [tuple(r.values()) for b in divergence._folded(iter(batches_)) for r in b.to_pylist()]
    if fold == 2:
        assert len(folded) == len({(*x[:2], x[3]) for x in dealt})
    again = [row for b in divergence._merged(1)(iter([divergence._batch(sorted(folded))])) for row in b.to_pylist()]
    told = lambda rows: sorted((x["lang"], x["term"], x["docs"], sorted(zip(x["sources"], x["counts"]))) for x in rows)
    assert told(again) == told(out)
    assert Counter({(x["lang"], x["term"].decode()): x["docs"] for x in out}) == docs and len(out) == len(docs)
    assert Counter({(x["lang"], x["term"].decode(), s): n for x in out for s, n in zip(x["sources"], x["counts"])}) == uses


def test_shares_are_exact():
    r = random.Random(6)
    count = [0, 1, 5, 10**9, 9 * 10**14, *(r.randrange(10**13) for _ in range(200))]
    whole = [n + 3 + r.randrange(10**14) for n in count]
    got = divergence.share(np.array(count, np.int64), np.array(whole, np.int64))
    assert got.tolist() == [1 + 10**9 * (n + 2) // w for n, w in zip(count, whole)]


def brute_negatives(rows, positives=5, negatives=3):
    out = []
    for a, la, va in rows:
        if a % 50:
            continue
        own = sorted((-sum(x * y for x, y in zip(va, v)), i) for i, k, v in rows if i != a and k == la and len(v) == len(va))[:positives]
        other = sorted((-sum(x * y for x, y in zip(va, v)), i) for i, k, v in rows if k != la and len(v) == len(va))
        for p, i in own:
            fit = [(s, j) for s, j in other if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("anchors, block, dims", [(128, 1024, 32), (2, 16, 3), (3, 7, 1)])
def test_hard_negatives(spark, monkeypatch, anchors, block, dims):
    for name, x in (("ANCHORS", anchors), ("ROWS", block), ("DIMS", dims)):
        monkeypatch.setattr(mining, name, x)
    r = np.random.default_rng(7)
    # Small values: many ties; a hot label; ids that repeat; vectors of other lengths.
    rows = [(int(i), int(k), v.tolist()) for i, (k, v) in enumerate(zip(np.minimum(r.integers(0, 6, 300), 3), r.integers(-1, 4, (300, 7))))]
    rows += [(400, 1, [2, 3]), (450, 1, [1, 1]), (451, 2, [1, 1]), (500, 2, []), (501, 2, []), (550, 9, [1] * 7)]
    big = [(600, 1, [1 << 29] * 3), (601, 1, [1 << 29, 1, 1]), (602, 2, [1 << 28, 1, (1 << 28) + 1]), (650, 2, [3, 1 << 29, 7])]
    rows += big
    given = [(i, k, v, "x") for i, k, v in rows] + [(3, 99, [9] * 7, "x"), (None, 1, [1] * 7, "x"), (50, None, [1] * 7, "x"), (51, 1, None, "x"), rows[0] + ("y",)]
    df = spark.createDataFrame(given, "vec_id long, label int, ints array<long>, grid string")
    out = mining.mine(df, F.col("vec_id") % 50 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == brute_negatives(rows)
    assert mining.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_negatives_take_no_part_without_numbers(spark):
    rows = [(0, 1, [1.0, 0.5]), (50, 1, [1.0, None]), (2, 1, [0.9, 0.5]), (3, 2, [float("nan"), 1.0]), (4, 2, [0.7, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, e array<double>").withColumn("ints", topk.quantised(F.col("e")))
    assert [tuple(x) for x in mining.mine(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 2, 1, 4, 75264, 62208)]


def test_top_k_deals_by_the_rows(spark, monkeypatch):
    """Whatever the order and partitions of the rows, each stands in the same cell; results equal brute force, repeats of an id included."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 32)
    r = np.random.default_rng(3)
    rows = [(int(i), v.tolist()) for i, v in enumerate(r.integers(-3, 4, (200, 6)))]
    rows += rows[:40] * 3 + [(7, [9] * 6), (7, [-9] * 6)]
    want = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        best = defaultdict(lambda: -(10**9))
        for own in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q:
                    best[i] = max(best[i], sum(a * b for a, b in zip(own, v)))
        want += [(q, k + 1, i, s) for k, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, ints array<long>").repartition(3 if order is rows else 7)
        got = topk.search(df.where("vec_id % 20 = 0"), df, 5).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_hard_negatives_shuffle_no_scores(spark, monkeypatch):
    """Cells add their panels up in strips, whatever the blocks; only vectors are shuffled."""
    r = np.random.default_rng(5)
    rows = [(k, int(r.integers(0, 3)), [int(x) for x in r.integers(-200, 200, 70)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, ints array<long>")
    asks = F.col("vec_id") % 10 == 0
    whole = mining.mine(df, asks)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapGroupsInArrow" not in plan
    want = sorted(map(tuple, whole.collect()))
    for name, size in (("ANCHORS", 7), ("ROWS", 50), ("SMALL", 40), ("STRIP", 3), ("DIMS", 16)):
        monkeypatch.setattr(mining, name, size)
    assert want and sorted(map(tuple, mining.mine(df, asks).collect())) == want


def test_discard_frees_shuffles(spark):
    """Shuffle files of finished steps go with their tables."""
    import time

    from locusframe.llm import common

    files = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    seen = []
    for k in range(4):
        made = common.cut(spark.range(1000).repartition(7).groupBy(F.col("id") % 5).count(), "made")
        common.discard(made)
        time.sleep(1)
        seen.append(files())
    # Those of the last step may stay until the next.
    assert seen[-1] <= seen[0]


def test_sifted_keeps_all_that_may_match_and_little_else(spark, tmp_path):
    df = spark.range(20_000).select(F.when(F.col("id") % 1000 != 1, F.col("id") * 4096 - 7).alias("k"), F.lit("x").alias("more"))
    some = cut(df.where("k % 37 = 0"), "some")
    wanted = {r.k for r in some.collect()}
    got = [r.k for r in sifted(df, "k", some).collect()]
    assert len(got) == len(set(got)) and wanted and wanted <= set(got)
    assert len(got) < len(wanted) + 2000
    # With a map that is full, more stay and none are lost.
    assert wanted <= {r.k for r in sifted(df, "k", some, 1 << 8).collect()}
    assert sifted(df, "k", cut(some.where("k is null"), "none")).count() == 0


def test_whole_sets_take_one_python_process_a_task_and_shuffle_only_wanted_texts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(5000).select(F.col("id").alias("key"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k) % 997) for k in range(1, 30)]).alias("text"))
        given = docs.withColumn("spot", simhash.spot("key", "text"))
        prints = cut(ngram_join.read(given, 4, 85), "prints")
        wanted = cut(prints.where("key % 100 = 3").select("spot", "node"), "wanted")
        tokens = ngram_join._tokens(given, wanted, 4)
        assert tokens._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        rows = {(r.node, r.n, r.place, r.token) for r in tokens.collect()}
        want = set()
        for r in given.where("key % 100 = 3").collect():
            s = ngram_join.shingles(r.text, 4)
            want |= {(simhash.set_node(s), len(s), i, t) for i, t in enumerate(s.view("int64").tolist())}
        assert rows == want
        told = ngram_join._sets(given, wanted, 4)
        assert {(r.node, bytes(r.hashes)) for r in told.collect()} == {(simhash.set_node(s), s.tobytes()) for s in (ngram_join.shingles(r.text, 4) for r in given.where("key % 100 = 3").collect())}
        assert ngram_join.sifted(given.select("spot", "text"), "spot", wanted).count() < 50 + 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_signatures_come_from_sorted_rows_and_no_task_holds_lists_of_tokens(spark):
    r = random.Random(11)
    rows, want = [], set()
    for node in range(-150, 150):
        n = r.choice([1, 5, 8, 60, 200])
        counts = [r.choice([0, 2, 40, 3000] if node % 3 else [0, 2, 2, 2, 2, 2, 2, 40]) for _ in range(n)]
        known = n if sum(c > ngram_join.OFTEN for c in counts) else min(n, ngram_join.window(n, 80))
        told = [(k, r.getrandbits(63), counts[k]) for k in range(known)]
        want |= {(s, node) for s in ngram_join.signatures(n, known, told, 80)}
        # Rare ones of one set only may be left out, others may come twice.
        rows += [(node, n, known, *t) for t in told + told[:2]]
    table = np.array(sorted(rows), np.int64)
    sigs, nodes = ngram_join.signed(*[table[:, k] for k in range(6)], 80)
    assert len(sigs) == len(want) and set(zip(sigs.tolist(), nodes.tolist())) == want
    docs = spark.createDataFrame([(i, t) for i, t in near_rows(random.Random(2)) if i is not None], "key long, text string")
    given = docs.withColumn("spot", simhash.spot("key", "text"))
    prints = cut(ngram_join.read(given, 4, 85), "prints")
    posts, _ = ngram_join.posted(given, cut(prints.dropDuplicates(["node"]), "nodes"), 4, 85)
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan


def test_a_map_hands_back_the_memory_it_freed():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) >> 10

    kept = []

    def run(batches):
        some = [bytearray(b"x" * 700) for _ in range(200_000)]
        # What stays lies behind what goes, so that the heap can't shrink by itself.
        kept.extend(bytearray(b"y" * 700) for _ in range(2000))
        yield from batches
        some.clear()

    before = held()
    assert list(handing_back(run)(iter([1, 2]))) == [1, 2]
    assert len(kept) == 2000 and held() < before + 60
