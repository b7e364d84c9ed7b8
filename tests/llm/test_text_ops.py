"""Packing, sentence pieces, toxicity, personal data, media, licences."""

import hashlib
import math
from pathlib import Path
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from locusframe.llm import license_scan, ogg, packing, pii, spm, toxicity
from locusframe.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, start string, score string"


def docs(spark, rows):
    """With columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (None, "no id"), (5, "é日本😀" * 50), (6, "x" * 30_000), (7, "word " * 9000), (8, "<|endoftext|> a")]


# Packing


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    rows = ODD + [(100 + i, " ".join(random.Random(i).choices(["alpha", "bé", "7", "\n"], k=i * 7))) for i in range(120)]
    out = packing.pack(docs(spark, rows).coalesce(2), path, group_tokens=5000).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*slow.encode(t or "", add_special_tokens=False).ids, 1])
    place, by_doc = {}, {}
    for r in out:
        assert len(r.ids) == r.length > 0
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, texts in ids.items():
        assert len({tuple(x) for x in texts}) == 1
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(map(len, texts))
        assert all(r.doc_tokens == len(texts[0]) and r.ids == texts[0][r.start : r.start + r.length] for r in pieces)
    padded = 0
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded == 0


def test_balance():
    lengths = [random.Random(i).randint(1, 2047) for i in range(300)]
    out = packing.balance(lengths, 2048, 1.0, 1 / 2048)
    assert sum(n for _, _, n, _ in out) == sum(lengths)
    cost = Counter()
    for _, _, n, to in out:
        cost[to] += n + n * n / 2048
    full = [cost[k] for k in range(sum(lengths) // 2048)]
    # First fit by length alone leaves a spread of about twice; balancing keeps it lower.
    assert max(full) / (sum(full) / len(full)) < 1.6
    assert packing.balance([], 2048, 1, 1) == [] and packing.sequence_lengths(4096 + 5, 2048) == [2048, 2048, 4, 1]


def brute_balance(lengths, seq_len):
    """The sequence of lowest cost with room, by a look at all of them."""
    room = packing.sequence_lengths(sum(lengths), seq_len)
    cost, out = [0.0] * len(room), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[piece]
        while left:
            fits = [k for k in range(len(room)) if room[k] >= left] or [k for k in range(len(room)) if room[k] == max(room)]
            to = min(fits, key=lambda k: (cost[k], k))
            n = min(left, room[to])
            out.append((piece, start, n, to))
            room[to] -= n
            cost[to] += n + n * n / seq_len
            start, left = start + n, left - n
    return out


def test_balance_equals_brute_force():
    r = random.Random(6)
    for most in (3, 300, 2047) * 8:
        lengths = [r.randint(1, most) for _ in range(r.randint(0, 200))]
        assert packing.balance(lengths, 2048, 1.0, 1 / 2048) == brute_balance(lengths, 2048)


def test_packing_long_white_space(spark):
    """Runs of white space of any length give the ids of the tokenizer, and the job lives."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    slow, encode = Tokenizer.from_file(path), packing.encoder(path)
    r = random.Random(5)
    texts = ["a" + "\n" * 2_000_000 + "b", " " * 2_000_000, "\u3000" * 5000 + "'s", " " * 4095 + "x", " " * 4096 + "x", "\x1c" * 5000 + " " * 4097]
    texts += ["".join(r.choice([" ", "\n", "\t", "a", "'s", "9", "é", " " * 4090, "\n" * 4096]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    for t in texts:
        assert list(encode(t)) == slow.encode(t, add_special_tokens=False).ids
    out = packing.pack(docs(spark, list(enumerate(texts[:2]))).coalesce(1), path, with_ids=False)
    got = {x[0]: x[1] for x in out.groupBy("doc_id").sum("length").collect()}
    assert got == {i: len(encode(t)) + 1 for i, t in enumerate(texts[:2])}


def test_packing_many_small_rows(spark):
    """Groups end by their number of pieces as well; none of their sequences is padded."""
    rows = spark.range(200_000).selectExpr("id as doc_id", "'' as text").coalesce(1)
    out = packing.pack(rows, tokenizer_path("byte_bpe_50k.json"), with_ids=False)
    by = [x[1] for x in out.groupBy("sequence_id").sum("length").collect()]
    assert sum(by) == 200_000 and all(n & (n - 1) == 0 for n in by)


def test_packing_empty(spark):
    assert packing.pack(docs(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


# Sentence pieces


def test_pieces_equal_the_library():
    enc = spm.PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(3)
    texts = [t or "" for _, t in ODD] + ["a  b", " a", "▁▁a b▁", "\x00z", "<s>x</s> <0x41>", " " * 501, "\n\n \n"]
    texts += ["".join(r.choice("abcdeè \n▁日😀thionre  .,1") for _ in range(r.randint(0, 90))) for _ in range(4000)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == [*enc.library.encode(t), enc.end], t
        assert enc.decimals(ids) == " ".join(map(str, ids))
    # The table of last tokens and merging step by step are two ways to one result.
    for t in ("▁thereupon", "▁wörld", "unbelievable", "日本"):
        assert enc.prefixes(t) == enc.merge(t)
    spm_ids = enc.encode("x " * 5000)
    assert enc.decode(spm_ids) == "x " * 5000


def test_pieces_query(spark):
    out = {r.doc_id: r for r in spm.digest(docs(spark, ODD), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 1 and out[2].ids_sha256 == hashlib.sha256(b"2").hexdigest()
    full = {r.doc_id: r for r in spm.encode(docs(spark, ODD), tokenizer_path("piece_bpe_32k.model")).collect()}
    for i, t in ODD:
        assert full[i].decoded == (t or "") and len(full[i].ids) == out[i].n_tokens
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert spm.digest(docs(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0


# Toxicity


def labelled(n=900):
    r = random.Random(1)
    plain = ["river", "stone", "walk", "bright", "window", "garden", "seven", "table", "music", "paper"]
    rows = []
    for i in range(n):
        words = r.choices(plain, k=r.randint(3, 40))
        toxic = i % 4 == 0
        if toxic:
            words.insert(r.randint(0, len(words)), r.choice(["vilex", "vileness", "horridon"]))
        # Toxic rows mention one group more often than others: a biased sample.
        if r.random() < (0.7 if toxic else 0.1):
            words.insert(0, "muslims")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = labelled()
    df = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10_000, 1)], "doc_id long, toxic int")
    train = lambda fairness: toxicity.train(df, labels.where(~toxicity.held_out("doc_id")), fairness=fairness)
    return rows, df, train(1.0), train(0.0)


def test_toxicity(spark, model):
    rows, df, fair, unfair = model
    out = {r.doc_id: r for r in toxicity.score(df, fair).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200
    right = sum(out[i].predicted == y for i, y in held) / len(held)
    assert right > 0.97
    # The swap penalty takes the weight of the group's name away.
    mention = toxicity.features({"muslims"})
    assert sum(unfair.weights.get(f, 0) for f in mention) > 5 * sum(fair.weights.get(f, 0) for f in mention)


NEUTRAL = {
    "en": ("muslims", "jews", "gay", "immigrants", "women", "black"),
    "de": ("muslime", "juden", "schwule", "ausländer", "frauen", "schwarze"),
    "fr": ("musulmans", "juifs", "lesbiennes", "immigrés", "femmes", "noirs"),
    "es": ("musulmanes", "judíos", "lesbianas", "inmigrantes", "mujeres", "negros"),
}


def test_counterfactuals_lower_false_positives(spark):
    """Neutral mentions of groups that toxic rows name often: how many are taken for toxic, with and without the penalty."""
    r = random.Random(11)
    plain = ["".join(r.choices("abcdefghijklm", k=r.randint(3, 8))) for _ in range(400)]
    rows, rates = [], {}
    for i in range(1600):
        terms = NEUTRAL[("en", "de", "fr", "es")[i % 4]]
        toxic = i % 3 == 0
        words = r.choices(plain, k=r.randint(4, 25))
        if toxic and r.random() < 0.7:
            words.append(r.choice(["vilex", "horridon", "scummo"]))
        if r.random() < (0.8 if toxic else 0.02):
            words.append(r.choice(terms))
        rows.append((i, " ".join(words), int(toxic)))
    df = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = docs(spark, [(k, " ".join(r.choices(plain, k=12)) + " " + t) for k, t in enumerate(t for ts in NEUTRAL.values() for t in ts * 5)])
    insults = docs(spark, [(k, " ".join(r.choices(plain, k=12)) + " " + t) for k, t in enumerate(["vilex", "horridon", "scummo"] * 10)])
    for fairness in (0.0, 1.0, 30.0):
        made = toxicity.train(df, labels, fairness=fairness)
        hit = lambda x: sum(s.score >= 0.5 for s in toxicity.score(x, made).collect()) / x.count()  # noqa: B023, E731
        rates[fairness] = (hit(neutral), hit(insults))
    assert rates[0.0][0] > 0.9 and rates[30.0][0] < 0.1, rates
    assert rates[1.0][0] < 0.1 and rates[1.0][1] == rates[30.0][1] == 1.0, rates


@pytest.mark.parametrize("fairness", [0.0, 1.0, 5.0])
def test_fit_is_the_least_loss(fairness):
    """Against plain projected gradient descent over all features at once."""
    r = np.random.default_rng(5)
    n, m, l1 = 90, 7, 3e-3
    x = (r.random((n, m)) < 0.4).astype(float)
    y = (r.random(n) < 1 / (1 + np.exp(1.5 - 2 * x[:, 0] - x[:, 1]))).astype(int)
    x[y == 1, 2] = r.random((y == 1).sum()) < 0.9
    swapped = x.copy()
    swapped[:, [2, 3]] = x[:, [3, 2]]
    pairs = np.flatnonzero(x[:, 2] + x[:, 3] > 0)
    rows = [(int(y[k]), np.flatnonzero(x[k]), np.flatnonzero(swapped[k]) if k in set(pairs.tolist()) else None) for k in range(n)]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    d = (x - swapped)[pairs]

    def loss(w, b):
        z = x @ w + b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + l1 * w.sum() + fairness * ((d @ w) ** 2).mean())

    w, b = np.zeros(m), 0.0
    for _ in range(60_000):
        e = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = np.maximum(0.0, w - 0.1 * (x.T @ e + l1 + 2 * fairness * d.T @ (d @ w) / len(pairs))), b - 0.1 * e.sum()
    made = toxicity.fit(rows, np.arange(m), l1, fairness, 4000)
    got = np.array([made.weights.get(k, 0.0) for k in range(m)])
    assert np.abs(got - w).max() < 0.02 and abs(made.bias - b) < 0.02 and loss(got, made.bias) < loss(w, b) + 1e-5


def test_toxicity_sample_is_bounded(spark):
    rows = labelled(300)
    df = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    few = toxicity.train(df, labels, max_per_class=40)
    again = toxicity.train(df.repartition(5), labels.repartition(3), max_per_class=40)
    assert few.weights == again.weights and few.bias == again.bias and few.weights


def test_toxicity_odd_rows(spark, model):
    _, _, fair, _ = model
    out = toxicity.score(docs(spark, ODD), fair)
    assert out.columns == ["doc_id", "text", "source", "start", "score", "predicted"]
    scores = [r.score for r in out.collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(docs(spark, []), fair).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    blank = toxicity.train(docs(spark, ODD), none)
    assert {r.score for r in toxicity.score(docs(spark, ODD), blank).collect()} == {0.0}


# Personal data


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_pii(t):
    spans, numbers = [], []
    for rank, (kind, pattern) in enumerate(BASE):
        n = 0
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                n += 1
                spans.append((m.start(), rank, m.end(), kind))
        numbers.append(n)
    text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return (*numbers, hashlib.sha256(text.encode()).hexdigest())


def test_pii(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("0123456789" * 2 + ".. -@+()aZé\x01_😀") for _ in range(r.randint(0, 120)))) for i in range(1500)]
    rows += [(7000 + i, t) for i, (_, t) in enumerate(ODD)]
    rows += [(9001, "a@b.c_foo@d.e 1.2.3.4.5.6.7.8 4111 1111 1111 1111 x 999.1.2.3.4 0255.1.1.1 +" + "9" * 3000 + "a" * 30_000), (9002, "1 2 3" * 5000), (9003, "4111-1111-1111-1111 " * 50 + "+1." * 1000)]
    out = {x.doc_id: x for x in pii.counts(pii.find(docs(spark, rows))).collect()}
    for i, t in rows:
        assert tuple(out[i][1:6]) == brute_pii(t), t
    assert pii.counts(pii.find(docs(spark, []))).count() == 0


def test_pii_added_kinds(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "nr 123-45-6789")]
    out = {x.doc_id: x.spans for x in pii.counts(pii.find(docs(spark, rows))).collect()}
    assert out[1].startswith("iban:5:32") and "iban" not in out[2]
    assert "idnum:4:15" in out[3] and "idnum" not in out[4]
    found = pii.redact(pii.find(docs(spark, [(1, "mail a@b.co or 4111 1111 1111 1111."), (2, None)]))).collect()
    assert [x.text for x in found] == ["mail [email] or [card].", None]


def test_redact_equals_brute_force(spark, monkeypatch):
    """Blocks and pieces of any size give what a walk over the spans gives."""
    r = random.Random(8)
    bits = ["a@b.co", "4111 1111 1111 1111", "1.2.3.4", "+1 234 567 8901", "é日😀", " ", "word ", "\n", "x" * 40]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(200)]
    for block, piece in ((256, 1000), (2, 7)):
        monkeypatch.setattr(pii, "BLOCK", block)
        monkeypatch.setattr(pii, "PIECE", piece)
        found = pii.find(docs(spark, rows))
        spans = {x.doc_id: x.found for x in found.collect()}
        texts = dict(rows)
        for x in pii.redact(found).collect():
            out, at = "", 0
            for s in spans[x.doc_id]:
                if s.start >= at:
                    out += texts[x.doc_id][at : s.start] + f"[{s.kind}]"
                at = max(at, s.end)
            assert x.text == out + texts[x.doc_id][at:]
        assert sorted(tuple(x[1:6]) for x in pii.counts(found).collect()) == sorted(brute_pii(t) for _, t in rows)


def test_pii_very_many_matches(spark):
    """40,000 addresses in one text cost in proportion."""
    import time

    text = " ".join(f"u{i}@b.co" for i in range(40_000))
    found = pii.find(docs(spark, [(1, text)]))
    began = time.time()
    (one,) = pii.counts(found).collect()
    (cut,) = pii.redact(found).collect()
    assert one.n_email == 40_000 and tuple(one[1:6]) == brute_pii(text)
    assert cut.text == " ".join(["[email]"] * 40_000) and time.time() - began < 60


# Media


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_ogg():
    assert all(ogg.page_checksum(x) == slow_crc(x) for x in (b"", b"a", bytes(range(256)) * 3))
    for n in (0, 1, 63, 64, 65, 255 * 255, 255 * 255 * 3 + 7, 1_000_000):
        payload = ogg.payload_of(bytes(i * 7 & 255 for i in range(n)))
        assert len(payload) % 64 == 0 and payload
        media = ogg.write(payload, n)
        back, length, streams, fault = ogg.samples_of(media)
        assert (back, length, fault, len(streams)) == (payload, n, "", 2)
        assert max(g for s in streams.values() for g in s.granules) == len(payload)
    broken = bytearray(media)
    broken[5000] ^= 1
    assert "checksum" in ogg.demultiplex(bytes(broken))[1]
    assert ogg.demultiplex(media[:-10])[1] and ogg.demultiplex(b"junk")[1] and ogg.demultiplex(media[: len(media) // 2])[1]


def test_ogg_packet_over_pages():
    s = ogg.Stream(5)
    packets = [b"x" * 255 * 600, b"", b"y" * 255, b"z"]
    pages = [ogg.write_page(s, [1], b"h", 0, 2), *ogg.write_packets(s, [(p, i) for i, p in enumerate(packets)], True)]
    streams, fault = ogg.demultiplex(b"".join(pages))
    assert fault == "" and streams[5].packets == [b"h", *packets] and len(pages) == 4


def test_ogg_query(spark):
    out = {r.doc_id: r for r in ogg.digest(ogg.from_text(docs(spark, ODD))).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = ogg.payload_of(raw)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert tuple(out[i][1:5]) == want
    assert out[1].media_sha256 == out[2].media_sha256
    seen = ogg.read(ogg.from_text(docs(spark, ODD)).unionByName(spark.createDataFrame([(99, 0, None), (98, 0, b"junk")], "doc_id long, n_bytes long, media binary"))).collect()
    by = {r.doc_id: r for r in seen}
    assert by[99].streams is None and "no page" in by[98].fault and {s.codec for s in by[6].streams} == {"PCM8", "NOTE"}
    assert ogg.digest(ogg.from_text(docs(spark, []))).count() == 0


# Licences


def brute_license(files):
    m = license_scan.model(license_scan.TEMPLATES, license_scan.THRESHOLD)

    def best(unit, few=2, title=False):
        c = Counter(re.findall(license_scan.TERM, unit))
        norm = math.sqrt(sum((x * m.idf.get(t, m.unseen)) ** 2 for t, x in c.items()))
        if not norm or len(c) < few:
            return None
        scores = ((math.floor(sum(c[t] * m.idf[t] * w for t, w in v.items()) / norm * 1e9 + 0.5) / 1e9, k) for k, v in m.vectors.items())
        top = sorted((-s, k[0] in license_scan.FAMILIES, k[0], k not in m.titles) for s, k in scores if s >= m.limits[k])
        if title:
            return bool(top) and not top[0][1] and not top[0][3] and top[0][0] <= -license_scan.STRICT
        return (top[0][1], top[0][0], top[0][2]) if top else None

    def opens(low):
        parts = [x for x in re.split(license_scan.GAP, low) if re.search("[a-z0-9]", x)]
        return any(best("\n".join(parts[:k]), 1, True) for k in (1, 2))

    own, says = {}, {}
    for i, path, text in files:
        low = (text or "").lower()
        name = path.rsplit("/", 1)[-1]
        units = re.split("[\r\n]+", low) + re.split(license_scan.GAP, low) + [low]
        found = [x for x in map(best, units) if x]
        own[i] = min(found) if found else None
        folder = path.rsplit("/", 1)[0] if "/" in path else ""
        if own[i] and (re.match(license_scan.LICENSE_FILE, name) or (best(low) or (0, 0))[1] <= -license_scan.STRICT or opens(low)):
            says[folder] = min(says.get(folder, own[i]), own[i])
    out = {}
    for i, path, _ in files:
        found, folder = own[i], path.rsplit("/", 1)[0] if "/" in path else ""
        while found is None:
            found = says.get(folder)
            if not folder:
                break
            folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
        out[i] = found[2] if found else None
    return out


def test_license(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "plain words"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/d/e.py", "# nothing"), (5, "x/y.py", "text\n# This file is subject to the terms of the Mozilla Public License, v. 2.0.\nmore"), (6, "x/z.py", None), (7, "top.txt", ""),
        (8, "a/q.txt", "the license of the file is version public"), (9, "a/q.txt", "All rights reserved. Copyright. Unauthorized copying of this file is prohibited."), (9, "a/q.txt", "words " * 20_000),
    ]
    files = [(i + 100 * k, p, t) for k, (i, p, t) in enumerate(files)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    out = license_scan.scan(df).collect()
    want = brute_license(files)
    assert {r.doc_id: r.license for r in out} == want and len(out) == len(files)
    origin = {r.path: r.origin for r in out}
    assert origin["a/b/d/e.py"] == "directory:a/b" and origin["a/b/c.txt"] == "directory:a/b" and origin["x/z.py"] == "none"
    assert license_scan.scan(df.limit(0)).count() == 0


def wrapped(text, mark="", width=60):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licences_as_they_come(spark):
    """Whole texts, wrapped headers, first lines and tags."""
    T = license_scan
    mit = f"{wrapped(T.MIT_GRANT)}\n\n{wrapped(T.MIT_CONDITION)}\n\n{wrapped(T.MIT_WARRANTY)}\n"
    bsd2 = f"Copyright (c) 2001, A. Person\n\n{wrapped(T.BSD_GRANT)}\n\n{wrapped(T.BSD_CONDITIONS)}\n\n{wrapped(T.BSD_WARRANTY)}"
    bsd3 = bsd2.replace(wrapped(T.BSD_WARRANTY), wrapped(T.BSD_NAME) + "\n\n" + wrapped(T.BSD_WARRANTY))
    code = "\n\nint main() { return 0; }\n" * 30
    gpl3 = wrapped("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", " * ", 50)
    cases = {
        "MIT": [mit, "The MIT License\n\nCopyright (c) 2019\n\n" + mit, "# SPDX-License-Identifier: MIT" + code, "licensed under the MIT license"],
        "BSD-2-Clause": [bsd2],
        "BSD-3-Clause": [bsd3, "// SPDX-License-Identifier: BSD-3-Clause" + code, "BSD 3-Clause License"],
        "GPL": ["GNU GENERAL PUBLIC LICENSE"],
        "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n Everyone is permitted", "/*\n" + gpl3 + "\n */" + code, "# SPDX-License-Identifier: GPL-3.0-only" + code],
        "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991", "/*\n" + gpl3.replace("version 3", "version 2") + "\n */" + code, "// SPDX-License-Identifier: GPL-2.0-or-later"],
        "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"],
        "Apache-2.0": ["  Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS", "/*\n" + wrapped(T.APACHE_HEADER, " * ") + "\n *\n" + wrapped(T.APACHE_WARRANTY, " * ") + "\n */" + code],
        "Apache": ["Apache License"],
        "MPL-2.0": ["Mozilla Public License Version 2.0", wrapped(T.MPL_HEADER, "# ", 40) + code],
        "CC-BY-SA-4.0": ["Licensed under Creative Commons Attribution-ShareAlike 4.0 International", "This work is licensed under CC BY-SA 4.0"],
        "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
        None: ["mit", "nd", "isc", "the license of the file is version public", "SPDX-License-Identifier: Xyz", "", None, "we went to the public library with no warranty " * 50],
    }
    flat = [(k, text) for k, texts in cases.items() for text in texts]
    files = [(i, f"d{i}/x.c", text) for i, (_, text) in enumerate(flat)]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {i: out[i].license for i in out} == {i: k for i, (k, _) in enumerate(flat)}
    assert out[0].origin == "file" and out[2].origin == "header"
    assert {r: out[r].license for r in out} == brute_license(files)


def test_texts_of_licenses(spark):
    """Licences as they are handed out, which the templates do not hold whole: named, and told to their neighbours."""
    folder = Path("/usr/share/common-licenses")
    want = {
        "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
        "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
    }
    if not all((folder / n).exists() for n in want):
        pytest.skip("no folder of licences here")
    files = [(2 * i, f"d{i}/{n}.txt", (folder / n).read_text("utf-8", "replace")) for i, n in enumerate(want)]
    files += [(2 * i + 1, f"d{i}/sub/code.py", "x = 1") for i in range(len(want))]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {n: out[2 * i].license for i, n in enumerate(want)} == want
    assert {n: out[2 * i + 1].license for i, n in enumerate(want)} == want
    assert {out[2 * i].origin for i in range(len(want))} == {"file"}
    assert {r: out[r].license for r in out} == brute_license(files)


def test_short_notices_of_further_licenses(spark):
    said = {
        "GPL-3.0": ["Licensed under GPLv3", "License: GPLv3+"], "LGPL-2.1": ["Licensed under LGPLv2.1"], "Apache-2.0 OR MIT": ["// SPDX-License-Identifier: MIT OR Apache-2.0"], "Zlib": ["SPDX-License-Identifier: Zlib", license_scan.ZLIB],
        "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", license_scan.BOOST], "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0", license_scan.ECLIPSE.format(v="2.0", at="https://www.eclipse.org/legal/epl-2.0/")],
        "GFDL-1.3": ["SPDX-License-Identifier: GFDL-1.3-or-later", license_scan.GFDL_GRANT.format(v="1.3")], "MIT": ["SPDX-License-Identifier: MIT"], None: ["a boost of zlib", "the artistic side of an eclipse", "gplv"],
    }
    flat = [(k, x) for k, xs in said.items() for x in xs]
    files = [(i, f"d{i}/a.py", f"# {x}\n\nimport os\n") for i, (_, x) in enumerate(flat)]
    out = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert out == {i: k for i, (k, _) in enumerate(flat)} == brute_license(files)


def test_license_triggers_lose_nothing():
    m = license_scan.model(license_scan.TEMPLATES, license_scan.THRESHOLD)
    for k, v in m.vectors.items():
        assert math.sqrt(sum(w * w for t, w in v.items() if t not in m.triggers)) < m.limits[k]


def test_license_triggers_beside_underscores(spark):
    """Terms end at underscores and after a number's dot, and so do triggers."""
    m = license_scan.model(license_scan.TEMPLATES, license_scan.THRESHOLD)
    trigger = re.compile(license_scan.any_word(m.triggers))
    for w in m.triggers:
        for line in (w, f"_{w}_", f"v2.0{w}", f"x.5{w}-", f"é{w}é"):
            assert w not in re.findall(license_scan.TERM, line) or trigger.search(line), line
    df = spark.createDataFrame([(1, "a/x.txt", "mit_license"), (2, "b/x.txt", "x\n_mit_license_\ny")], "doc_id long, path string, text string")
    assert [x.license for x in license_scan.scan(df).orderBy("doc_id").collect()] == ["MIT", "MIT"]


# The queries themselves


def contract(name, df, monkeypatch, tables=""):
    """A query over the given documents, in place of its own."""
    from locusframe.llm import queries

    monkeypatch.setattr(queries, "documents", lambda *_: df)
    return queries.QUERIES[name](df.sparkSession, tables).collect()


def test_query_sentencepiece(spark, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in contract("op5_sentencepiece", docs(spark, ODD), monkeypatch)}
    want = set()
    for i, t in ODD:
        ids = sp.encode(t or "", add_eos=True)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert out == want


def test_query_pii(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("0123456789" * 2 + ".. -@+()aZé😀") for _ in range(r.randint(0, 150)))) for i in range(400)] + [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    out = contract("op6_pii", docs(spark, rows), monkeypatch)
    assert sorted((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in out) == sorted((i, *brute_pii(t)) for i, t in rows)


def test_query_media(spark, monkeypatch):
    out = contract("op8_media_columns", docs(spark, ODD), monkeypatch)
    want = []
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((tuple(x[:5]) for x in out), key=str) == sorted(want, key=str)
    same = [(x.media_bytes, x.media_sha256, x.feature) for x in out if x.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1] and all(x.media_bytes > x.payload_bytes for x in out)


def test_query_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(6)
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(100 + i, " ".join(r.choices(["alpha", "bé", "7", "\n"], k=i * 40))) for i in range(60)]
    out = contract("op9_packing", docs(spark, rows), monkeypatch)
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    seen, place = {i: [] for i in ids}, {}
    for x in sorted(out, key=lambda x: (x.doc_id, x.start)):
        piece = ids[x.doc_id][x.start : x.start + x.length]
        assert x.doc_tokens == len(ids[x.doc_id]) and x.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in piece))
        assert x.start == sum(map(len, seen[x.doc_id]))
        seen[x.doc_id].append(piece)
        place.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert {i: sum(map(len, v)) for i, v in seen.items()} == {i: len(v) for i, v in ids.items()}
    for parts in place.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for o, n in parts if o < a) for a, _ in sorted(parts)] and sum(n for _, n in parts) <= 2048


def test_query_toxicity(spark, monkeypatch, tmp_path):
    """Scores of the query equal those of a plain sum over a text's features; held-out rows teach nothing."""
    rows = labelled(500)
    df = docs(spark, [(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")])
    kept = [(i, y) for i, _, y in rows]
    spark.createDataFrame(kept, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {x.doc_id: x for x in contract("op4_toxicity", df, monkeypatch, str(tmp_path))}
    out_of = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert all(x.held_out == out_of(i) and x.predicted == int(x.score >= 0.7) for i, x in out.items()) and len(out) == len(rows) + 2
    # Other labels of held-out rows change nothing.
    flipped = tmp_path / "flipped"
    spark.createDataFrame([(i, 1 - y if out_of(i) else y) for i, y in kept], "doc_id long, toxic int").write.parquet(str(flipped / "labels.parquet"))
    assert {i: x.score for i, x in out.items()} == {x.doc_id: x.score for x in contract("op4_toxicity", df, monkeypatch, str(flipped))}
    labels = spark.createDataFrame([(i, y) for i, y in kept if not out_of(i)], "doc_id long, toxic int")
    made = toxicity.train(df, labels)
    for i, t, _ in rows:
        z = made.bias + sum(w for f, w in made.weights.items() if f in toxicity.features(set(re.findall(r"\w+", t.lower()))))
        assert abs(out[i].score - 1 / (1 + math.exp(-z))) < 1e-9
