"""Top-k, archives, near copies, repeated strings and the pipeline."""

import base64
import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash

from locusframe.llm import ngram_join, simhash, suffix, topk, warc


# Top-k


def brute_topk(rows, k):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v is not None]
    for q, x in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        best = {}
        for i, y in good:
            if i != q and len(y) == len(x):
                best[i] = max(best.get(i, -(1 << 62)), sum(a * b for a, b in zip(x, y)))
        top = sorted((-s, i) for i, s in best.items())[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(top)]
    return sorted(out)


@pytest.mark.parametrize("dims, big", [(40, 200), (3, 2), (70, 1 << 27)])
def test_topk(spark, monkeypatch, dims, big):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 90)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = random.Random(dims)
    rows = [(i, [r.randint(-big, big) for _ in range(dims)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(1000, 1030)]  # a common vector: ties
    rows += [(55, rows[55][1]), (2000, None), (None, rows[3][1]), (2001, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, ints array<long>").repartition(3)
    out = topk.search(df.where("vec_id % 50 = 0"), df, 5)
    assert sorted(tuple(x) for x in out.collect()) == brute_topk(rows, 5)


def test_topk_odd(spark):
    df = spark.createDataFrame([(1, [0.5, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [-0.001, 0.5]), (5, None), (6, [])], "vec_id long, v array<float>")
    ints = {x.vec_id: x.ints for x in df.select("vec_id", topk.quantised(df.v).alias("ints")).collect()}
    assert ints == {1: None, 2: None, 3: None, 4: [-1, 128], 5: None, 6: []}
    none = spark.createDataFrame([], "vec_id long, ints array<long>")
    assert topk.search(none, none, 5).count() == 0


# Archives


def test_warc(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", "<p>\r\n\r\nWARC/1.1\r\n" * (i % 3)) for i in range(1, 40)]
    rows += [(100, None, None), (101, "http://x/a b\r\nEvil: 1", "é日本"), (102, "u", "é日本"), (103, "u", "x" * 300_000), (None, "u", "é日本"), (None, "u", "alone")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, refers_to string")
    path = warc.archive(df)
    out = warc.read(spark, path).collect()
    assert len(out) == len(rows)
    body = {i: (h or "").encode() for i, _, h in rows}
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        best[b] = max(best.get(b, -1), -1 if i is None else i)
    for r in out:
        if r.page_id is None:
            continue
        b = body[r.page_id]
        assert r.payload_bytes == len(b) and r.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = best[b] == r.page_id
        assert r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else best[b])
        assert r.payload == (b if first else None)
    loose = {(r.record_type, r.refers_to) for r in out if r.page_id is None}
    assert loose == {("revisit", 102), ("response", None)}
    text = "".join(r.value for r in spark.read.option("lineSep", "\r\n").text(path).collect())
    ids = re.findall(r"WARC-Record-ID: (<[^>]*>)", text)
    assert len({i for i in ids if "null" in i}) == 2 and "1970" not in text
    monkeypatch.setattr(warc, "PER_FILE", 5)
    assert warc.read(spark, warc.archive(df.coalesce(1))).count() == len(rows)
    assert warc.read(spark, warc.archive(df, min_bytes=1000)).where("record_type = 'revisit'").count() == 0
    assert warc.read(spark, warc.archive(df.limit(0))).count() == 0


def test_warc_breaks_loudly():
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [b for _, b in warc.parse(iter([whole[:9], whole[9:], whole]))] == [b"hello", b"hello"]
    for bad in (whole[:-1], whole[:30], b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(iter([bad])))


# Near copies


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    n = len(prints)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def random_prints(rng, trial):
    x = rng.integers(0, 2**63, 8, dtype=np.uint64)[rng.integers(0, 8, int(rng.integers(2, 500)))]
    for _ in range(int(rng.integers(0, 6))):
        x = x ^ (np.uint64(1) << rng.integers(0, 64 if trial % 2 else 16, len(x), dtype=np.uint64)) * rng.integers(0, 2, len(x), dtype=np.uint64)
    return np.unique(x)


def united(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_gray_index_equals_brute_force():
    """Over all fingerprints in one tree, and by leading bits, as tables have them."""
    rng = np.random.default_rng(0)
    first, second = simhash.leads(3)
    assert len(first) == 4 and len(second) == 16 and all(sorted(sum(first, [])) == list(range(64)) for _ in "a")
    for trial in range(40):
        x = random_prints(rng, trial)
        want = brute_components([int(v) for v in x])
        assert united(len(x), simhash.GrayIndex(x).links(3)) == want
        for tables in (first, [b for b in second if b[:16] == first[0]] + first[1:]):
            pairs = []
            for bits in tables:
                found = simhash.GrayIndex(simhash.led_by(x, bits), len(bits)).links(3)
                assert all(all(int(x[i] ^ x[j]) >> b & 1 == 0 for b in bits) and bin(int(x[i] ^ x[j])).count("1") <= 3 for i, j in found)
                pairs += found
            if tables is first:
                assert united(len(x), pairs) == want


def test_gray_index_prunes():
    """Whole groups fall by accumulated differences, and one component is not compared pair by pair."""
    rng = np.random.default_rng(1)
    looked = 0

    class Counting(simhash.Forest):
        def join(self, a, b):
            nonlocal looked
            looked += len(a)
            return super().join(a, b)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "Forest", Counting)
        far = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
        assert not simhash.GrayIndex(simhash.led_by(far, list(range(16))), 16).links(3) and looked == 0
        # A dense group: every pair is a link, and a small part of them is looked at.
        dense = np.unique(rng.integers(0, 8, 60_000, dtype=np.uint64) | far[0] & ~np.uint64(7) | rng.integers(0, 2, 60_000, dtype=np.uint64) << np.uint64(40))
        dense = np.unique(np.concatenate([dense ^ np.uint64(1 << k) for k in range(16)]))
        assert len(set(united(len(dense), simhash.GrayIndex(dense).links(3)))) == 1
        assert looked < len(dense) ** 2 / 4


def test_hot_blocks_are_split(spark, monkeypatch):
    """Values of a block that many fingerprints have are dealt by a second block, with the same links."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64) & ~np.uint64(0xFFFF)
    x = np.unique(np.concatenate([base, base[:150] ^ np.uint64(1 << 50), base[:100] ^ np.uint64(7 << 30), base[:60] ^ np.uint64(0b1001 << 20)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(3)
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    want = brute_components([int(v) for v in x])
    for most, chunk in ((1 << 16, 200_000), (20, 200_000), (20, 50)):
        monkeypatch.setattr(simhash, "SPLIT", most)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        pairs = [(at[r.a], at[r.b]) for r in simhash.candidate_edges(df).collect()]
        assert united(len(x), pairs) == want


def test_whole_buckets():
    import pyarrow as pa

    table, part = [0] * 50 + [1] * 70, sorted(random.Random(1).choices(range(6), k=50)) + sorted(random.Random(2).choices(range(3), k=70))
    columns = [np.arange(120), np.array(table), np.array(part)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "CHUNK", 20)
        batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 7]) for c in columns], ["x", "t", "p"]) for k in range(0, 120, 7)]
        got = list(simhash.whole_buckets(batches, 3))
    assert np.concatenate([g[0] for g in got]).tolist() == list(range(120)) and len(got) > 3
    ends = [{(t, p) for t, p in zip(g[1].tolist(), g[2].tolist())} for g in got]
    assert not any(a & b for a, b in zip(ends, ends[1:]))


def test_gray_rank():
    gray = np.array([i ^ i >> 1 for i in range(1024)], np.uint64)
    assert (simhash.gray_rank(gray) == np.arange(1024, dtype=np.uint64)).all()


def test_simhash(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = r.choices(words, k=r.randint(40, 200))
        rows.append((i * 3 + 1, " ".join(base)))
        for k in range(r.randint(0, 3)):
            copy = list(base)
            copy[r.randrange(len(copy))] = "Changed"
            rows.append((i * 3 + 200 + k * 1000, " ".join(copy)))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, ""), (904, " \t\n"), (905, "one"), (906, "ONE"), (907, "É x\ty z\x0bq\x1cr s\x85t"), (908, "w " * 20_000), (908, "w " * 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    out = {}
    for x in simhash.dedupe(df).collect():
        out[x.doc_id] = (x.fp & (1 << 64) - 1, x.component_id)
    prints = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(prints)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, i), i)
    for (i, _), p, c in zip(rows, prints, comp):
        assert out[i] == (p, least[c]), i
    assert simhash.dedupe(df).count() == len(rows)
    from locusframe.llm import queries

    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "documents", lambda *_: df)
        query = queries.QUERIES["op7_simhash"](spark, "").collect()
    assert {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in query} == out and all(len(x.fingerprint) == 16 for x in query)
    lone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    assert sorted(str(x.component_id) for x in simhash.dedupe(lone).collect()) == ["4", "4", "4", "None"]
    assert simhash.dedupe(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (5000, 1001), (7, 7)]
    random.Random(0).shuffle(path)
    out = {r.node: r.component for r in simhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {out[i] for i in range(1, 301)} == {1} and out[5000] == out[1001] == 1000 and len(out) == 303


# Repeated strings


def brute_repeats(docs, length, first):
    places = collections.defaultdict(list)
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((i, p))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [0] * len(b)
        for p in range(len(b) - length + 1):
            at = places[b[p : p + length]]
            if len(at) > 1 and (not first or min(at) != (i, p)):
                gone[p : p + length] = [1] * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out)


def repeat_docs(seed, length):
    r = random.Random(seed)
    passages = ["".join(r.choice(["ab", "c", "déf", "gh ", "x\n", "yz"]) for _ in range(r.randint(length // 3, length * 2))) for _ in range(6)]
    docs = []
    for i in range(50):
        t = ""
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            if kind < 0.5:
                p = r.choice(passages)
                if r.random() < 0.5:
                    k = r.randint(0, len(p) - 1)
                    p = p[:k] + "Q" + p[k + 1 :]
                t += p[r.randint(0, 9) if r.random() < 0.3 else 0 :]
            elif kind < 0.6:
                t += "z" * r.randint(1, 3 * length)
            elif kind < 0.7:
                t += "pq" * r.randint(1, 2 * length)
            else:
                t += "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, length)))
        docs.append((i, t))
    return docs + [(100, None), (101, ""), (102, docs[3][1]), (103, docs[3][1])]


@pytest.mark.parametrize("hot, keep", [(2048, "none"), (2048, "first"), (1, "none"), (1, "first")])
def test_repeats(spark, monkeypatch, hot, keep):
    monkeypatch.setattr(suffix, "HOT", hot)
    docs = repeat_docs(hot, 40)
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, row string")
    out = suffix.digest(df, length=40, keep=keep, short=25).collect()
    assert sorted(tuple(r)[:5] for r in out) == brute_repeats(docs, 40, keep == "first")
    assert sorted((r.doc_id, r.n_repeated) for r in out) == sorted((x[0], x[2]) for x in brute_repeats(docs, 25, False))


def test_repeats_at_the_query_length(spark):
    """The query itself, at its own lengths, on texts with shared passages, periods and copies."""
    from locusframe.llm import queries

    docs = repeat_docs(5, 400)
    docs += [(200, "z" * 20_000), (201, "ab" * 3000 + "tail"), (200, "z" * 20_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, row string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "documents", lambda *_: df)
        out = queries.QUERIES["op10_suffix_dedup"](spark, "").collect()
    assert sorted(tuple(r)[:5] for r in out) == brute_repeats(docs, 400, False)
    assert sorted((r.doc_id, r.n_repeated) for r in out) == sorted((x[0], x[2]) for x in brute_repeats(docs, 256, False))


def test_a_period_is_named_once(spark):
    """A text of one letter, or of few, has few segments, and one span."""
    given = suffix.keyed(spark.createDataFrame([(1, "a" * 300_000 + "xyz" * 50_000)], "doc_id long, text string"), "doc_id", "text")
    rows = suffix.segments(given, 400).collect()
    assert len(rows) < 100 and sum(r.c for r in rows) > 300_000
    (one,) = suffix.digest(spark.createDataFrame([(1, "a" * 300_000)], "doc_id long, text string")).collect()
    assert (one.n_removed, one.n_spans, one.n_repeated) == (300_000, 1, 300_000)


def test_longest_previous():
    """Against a look at all pairs; capped at the length in question."""
    r = random.Random(3)
    for trial in range(60):
        kind = (np.uint8, np.uint64)[trial % 2]
        data = np.array(r.choices([0, 1, 2] if trial % 3 else [7], k=r.randint(1, 70)), kind)
        cap = r.choice([1, 5, 9, 20])
        raw = data.tolist() + [0] * cap
        at = sorted(range(len(data)), key=lambda i: (raw[i : i + cap] + [0] * cap)[:cap] + [i])
        factor, source = suffix.longest_previous(data, np.array(at), cap, suffix.prefix_ranks(data, cap))
        for k, i in enumerate(at):
            share = lambda j: next((n for n in range(cap) if (raw + [0] * cap)[i + n] != (raw + [0] * cap)[j + n]), cap)  # noqa: B023, E731
            assert factor[k] == max((share(j) for j in range(i)), default=0)
            assert source[k] < 0 and factor[k] == 0 or source[k] < i and share(int(source[k])) == factor[k]


def test_runs_of_spans():
    group = np.array([0, 0, 0, 2, 2], np.int64)
    g, lo, hi = suffix.runs_of(group, np.array([1, 2, 9, 3, 7]), np.array([6, 4, 12, 7, 8]))
    assert (g.tolist(), lo.tolist(), hi.tolist()) == ([0, 0, 2], [1, 9, 3], [6, 12, 8])


def test_equal_rows_of_one_id(spark):
    """Equal rows are one place in the order; rows of one id order by a hash, and one of them keeps what they share."""
    a, b = ("".join(random.Random(k).choices("abcdefgh ", k=300)) for k in (1, 2))
    rows = [(1, a), (1, a), (2, b + a), (3, a + "one"), (3, b + a + "two")]
    out = suffix.digest(spark.createDataFrame(rows, "doc_id long, text string"), length=100, keep="first", short=50).collect()
    kept = {(r.doc_id, r.n_bytes): r.n_bytes - r.n_removed for r in out}
    assert kept == {(1, 300): 300, (2, 600): 300, (3, 303): 3, (3, 603): 3}
    assert {r.n_removed for r in suffix.digest(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()} == {0}
    twice = suffix.digest(spark.createDataFrame([(1, a * 2), (1, a * 2)], "doc_id long, text string"), length=400).collect()
    assert [r.n_removed for r in twice] == [600, 600]


def test_repeats_in_text(spark):
    passage = "".join(random.Random(1).choices("abcdefgh é", k=300))
    df = spark.createDataFrame([(1, "one " + passage + " end", "k"), (2, passage + "zwei", None), (None, None, "n")], "doc_id long, text string, row string")
    out = {r.doc_id: r for r in suffix.strip(df, length=100).collect()}
    assert out[1].text == "one " + passage + " end" and out[2].text == "zwei" and out[None].text is None and out[1].row == "k"
    assert suffix.strip(df.limit(0), length=100).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    text = bytes(random.Random(0).choices(range(97, 105), k=5000)) * 2
    a, lo, hi = suffix.Minimizers(50).runs(np.frombuffer(text, np.uint8))
    covered = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi)])
    assert (covered == np.arange(len(text) - 49)).all()


def test_suffix_ranks():
    data = np.frombuffer(b"banana banana bandana" * 3, np.uint8)
    for length in (1, 3, 8, 11, 20):
        rank = suffix.suffix_ranks(data, length)
        raw = data.tobytes() + bytes(length)
        cuts = [raw[i : i + length] for i in range(len(data))]
        assert (rank == np.array([sorted(set(cuts)).index(c) for c in cuts])).all() or [sorted(set(cuts))[r] for r in np.unique(rank, return_inverse=True)[1]] == cuts


# Pipeline


def brute_passages(rows):
    """Texts without words of a run of 51 that an earlier place has as well; rows in order of their ids."""
    seen, left = set(), {}
    for i, t in rows:
        places = [m.span() for m in re.finditer(rb"\S+", (t or "").encode())]
        raw, gone = (t or "").encode(), []
        for k in range(len(places) - 50):
            window = tuple(raw[a:b] for a, b in places[k : k + 51])
            if window in seen:
                gone.append((places[k][0], places[k + 50][1]))
            seen.add(window)
        inside = [k for k in range(len(raw)) if not any(a <= k < b for a, b in gone)]
        raw = bytes(raw[k] for k in inside)
        left[i] = None if t is None else raw.decode()
    return left


def brute_survivors(rows):
    """Of groups linked by a five-word similarity of 0.8 the smallest id, and of equal rows one."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    group = united(len(rows), links)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, i), i)
    return sorted(set(least.values()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    rows = [(i, prose(120)) for i in range(120)]
    toxic = [(1000 + i, prose(30) + " vilex " + prose(30)) for i in range(60)]
    passage = prose(80)
    rows += [(200, rows[0][1]), (201, rows[1][1]), (300, prose(50) + " " + passage), (301, prose(50) + " " + passage), (302, "mail me: a@b.org " + prose(60)), (400, None), (401, None), (401, None), (402, "")]
    every = rows + toxic
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0) for i, _ in rows[:100]] + [(i, 1) for i, _ in toxic[:50]]
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in p.STAGES:
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == df.columns
    ids = lambda n: sorted(x.doc_id for x in seen[n].collect())
    assert not [i for i in ids("toxicity") if i >= 1000] and len(ids("toxicity")) == len(rows)
    left = ids("simhash_near_dedup")
    assert 0 in left and 200 not in left and 201 not in left and 400 in left and 401 not in left
    assert len(left) == len(set(left)) == 120 + 3 + 1
    assert left == brute_survivors([(x.doc_id, x.text) for x in seen["toxicity"].collect()])
    kept = sorted(((x.doc_id, x.text) for x in seen["simhash_near_dedup"].collect()), key=lambda x: x[0])
    assert {x.doc_id: x.text for x in seen["suffix_array_dedup"].collect()} == brute_passages(kept)
    text = {x.doc_id: x for x in seen["suffix_array_dedup"].collect()}
    assert passage in text[300].text and passage not in text[301].text and text[301].n_chars == len(text[301].text)
    assert "a@b.org" not in "".join(x.text or "" for x in seen["pii"].collect())
    assert "[email]" in {x.doc_id: x.text for x in seen["pii"].collect()}[302]
    tokens = seen["packing"].groupBy("doc_id").sum("length").count()
    assert tokens == len(left)
    from locusframe.llm.common import shared_dir

    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    assert p.run(spark, str(tmp_path)).count() == seen["packing"].count()
    # The last stage's input only is left.
    assert [x.split("-")[0] for x in set(os.listdir(shared)) - before] == ["pii"]


def test_similar_texts(spark):
    """Pairs of a five-word similarity well over 0.8 meet, those well below do not; equal texts always do."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmn", k=r.randint(2, 9))) for _ in range(4000)]
    rows, near, far = [], [], []
    for i in range(80):
        base = r.choices(words, k=400)
        copy, other = list(base), list(base)
        for k in r.sample(range(0, 400, 10), 4):  # about 0.9
            copy[k] = "new"
        for k in r.sample(range(0, 400, 5), 40):  # about 0.33
            other[k] = "new"
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(other))]
        near.append((3 * i, 3 * i + 1))
        far.append((3 * i, 3 * i + 2))
    rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (1003, " "), (None, rows[3][1]), (1004, "one two"), (1005, "One two"), (1006, "w " * 30_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    found = simhash.similar(df).collect()
    out = {x.doc_id: x.component_id for x in found}
    assert len(found) == len(rows)
    assert sum(out[a] == out[b] for a, b in near) >= 76
    assert not any(out[a] == out[b] for a, b in far)
    assert out[1000] == out[0] and out[1002] == out[1003] == 1001 and out[None] == out[3] and out[1005] == 1004
    assert simhash.similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [10_000, 2])
def test_similar_equals_brute_force(spark, monkeypatch, block):
    """Around 0.8, short texts too, pairs are linked if and only if their exact similarity says so, in one block or many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(17)
    words = ["".join(r.choices("abcdefghijklmn", k=r.randint(2, 9))) for _ in range(4000)]
    texts = []
    for i in range(120):
        n = r.choice([8, 12, 13, 30, 100, 400])
        base = r.choices(words, k=n)
        for _ in range(2):
            copy = list(base)
            for k in r.sample(range(n), max(1, round(n * r.uniform(0.015, 0.03)))):
                copy[k] = "new"
            texts.append(copy)
        texts += [base, base + r.choices(words, k=max(1, (n - 4) // 4)), ["one", "notice", "that", "all", "have", "on", "top"] + base]
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    group = list(range(len(texts)))
    close = 0
    for b in range(len(texts)):
        for a in range(b - b % 5, b):
            both = len(sets[a] & sets[b])
            close += 0.75 < both / (len(sets[a]) + len(sets[b]) - both) < 0.85
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert close > 150 and len(set(group)) > 130
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [x.component_id for x in simhash.similar(df).orderBy("doc_id").collect()] == group


@pytest.mark.parametrize("hot", [2048, 1])
def test_passages_by_words(spark, monkeypatch, hot):
    """Passages of over 50 words go however short these are, those of 50 stay however long."""
    import corpus_pipeline as p

    monkeypatch.setattr(suffix, "HOT", hot)
    r = random.Random(8)
    word = lambda a, b: "".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=r.randint(a, b)))
    prose = lambda n, a=4, b=9: " ".join(word(a, b) for _ in range(n))
    short, fifty, spaced, part = prose(51, 1, 2), prose(50, 12, 20), prose(60), prose(70)
    rows = [(0, f"{prose(80)} {short} {prose(9)}"), (1, f"{prose(20)} {short} {prose(40)}"), (2, short)]
    rows += [(3, f"{prose(8)} {fifty} {prose(8)}"), (4, f"{fifty} {prose(8)}")]
    rows += [(5, spaced), (6, prose(3) + "\n" + spaced.replace(" ", "\n ") + "\n\nend"), (7, part + " " + prose(5)), (8, prose(5) + " " + " ".join(part.split()[10:61]) + " x")]
    rows += [(9, "to " * 60), (10, None), (11, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x.text for x in p.cut_repeats(spark, df, "").collect()}

    assert out == brute_passages(rows)
    assert len(short) < 256 < len(fifty) and short not in out[1] and out[2] == "" and fifty in out[3] and fifty in out[4] and "end" in out[6] and out[5] == spaced


def test_near_copies_of_repeated_ids(spark):
    """A copy goes by its id and text; another text of that id stays."""
    import corpus_pipeline as p

    a, b = "alone " * 3 + "clean text without any copy", "some other text that stands on two rows"
    rows = [(1, a), (1, b), (0, b), (2, a + " x y z"), (None, b), (None, b), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(x) for x in p.drop_near_copies(spark, df, "").collect()]
    assert sorted(left, key=str) == sorted([(1, a), (0, b), (2, a + " x y z"), (None, b)], key=str)


def test_similar_takes_links_of_the_gray_index(spark, monkeypatch):
    from locusframe.llm import ngram_join, simhash

    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words)), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = lambda: [x.component_id for x in simhash.similar(df).orderBy("doc_id").collect()]
    assert told() == [0, 0, 2, 3]
    # Without any pair of shared shingles the index finds the copy by its fingerprint.
    monkeypatch.setattr(ngram_join, "proposals", lambda *a: spark.createDataFrame([], "a long, b long"))
    assert told() == [0, 0, 2, 3]
