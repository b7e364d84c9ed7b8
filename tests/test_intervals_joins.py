import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import intervals as iv
from locusframe.operators import joins as j
from locusframe.operators import loci


def table(spark, rows):
    return spark.createDataFrame(rows, "contig string, start long, end long")


def got(df):
    return sorted((r.contig, r.start, r.end) for r in df.collect())


def test_parse():
    assert iv.parse("chr1:100-200, chrX:1,000-2,000") == [("chr1", 100, 200), ("chrX", 1000, 2000)]
    for bad in ("chr1", "chr1:5", "chr1:20-10"):
        with pytest.raises(ValueError):
            iv.parse(bad)


def test_merge_adjacent_or_not(spark):
    t = table(spark, [("1", 1, 5), ("1", 6, 9), ("1", 8, 20), ("1", 8, 20), ("1", 30, 40), ("2", 1, 2)])
    assert got(iv.merge(t)) == [("1", 1, 20), ("1", 30, 40), ("2", 1, 2)]
    assert got(iv.merge(t, adjacent=False)) == [("1", 1, 5), ("1", 6, 20), ("1", 30, 40), ("2", 1, 2)]
    assert got(iv.merge(table(spark, []))) == []


def test_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\n# c\nchr1\t99\t200\tname\nchr2\t5\t5\nchr3\t0\t7\n")
    (tmp_path / "a.json").write_text('[{"contig": "chr1", "start": 100, "end": 200, "note": 1}, {"contig": "chr3", "start": 1, "end": 7}]')
    (tmp_path / "a.txt").write_text("# c\nchr1:100-200\n\nchr3:1-7\n")
    for name in ("a.bed", "a.json", "a.txt"):
        assert got(iv.read(spark, str(tmp_path / name))) == [("chr1", 100, 200), ("chr3", 1, 7)], name


def random_case(seed):
    r = random.Random(seed)
    rows = [(i, f"chr{r.randint(1, 3)}", r.randint(1, 3000)) for i in range(300)]
    spans = []
    for _ in range(40):
        a = r.randint(1, 2900)
        spans.append((f"chr{r.randint(1, 3)}", a, a + r.choice([0, 5, 50, 900, 2500])))
    return rows, spans


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_joins(spark, seed):
    rows, spans = random_case(seed)
    df = spark.createDataFrame(rows, "id int, contig string, position int")
    t = table(spark, spans)
    pairs = sorted((i, a, b) for i, c, p in rows for d, a, b in spans if c == d and a <= p <= b)
    assert sorted((r.id, r.start, r.end) for r in j.interval_join(df, t, bin_width=4).collect()) == pairs
    inside = sorted({x[0] for x in pairs})
    assert sorted(r.id for r in j.interval_semi_join(df, t, bin_width=16).collect()) == inside
    assert sorted(r.id for r in j.in_any(df, t).collect()) == inside


def test_overlap_join(spark):
    _, spans = random_case(3)
    t = table(spark, spans)
    right = t.toDF("g_contig", "g_start", "g_end")
    want = sorted((c, a, b, x, y) for c, a, b in spans for d, x, y in spans if c == d and a <= y and b >= x)
    out = j.overlap_join(t, right, bin_width=32)
    assert sorted((r.contig, r.start, r.end, r.g_start, r.g_end) for r in out.collect()) == want


@pytest.mark.parametrize("few", [0, 1000])
def test_joins_by_either_plan(spark, monkeypatch, few):
    """Listings that are merged give the pairs of those that are broadcast; intervals of any width have few listings."""
    monkeypatch.setattr(j, "FEW", few)
    rows, spans = random_case(6)
    spans += [("chr1", 1, 10**12), ("chr2", -50, 10**9), ("chr2", 9, 3)]
    df, t = spark.createDataFrame(rows, "id int, contig string, position int"), table(spark, spans)
    pairs = sorted((i, a, b) for i, c, p in rows for d, a, b in spans if c == d and a <= p <= b)
    assert sorted((r.id, r.start, r.end) for r in j.interval_join(df, t, bin_width=4).collect()) == pairs
    right = t.toDF("g_contig", "g_start", "g_end")
    good = [x for x in spans if x[1] <= x[2]]
    want = sorted((c, a, b, x, y) for c, a, b in good for d, x, y in good if c == d and a <= y and b >= x)
    assert sorted((r.contig, r.start, r.end, r.g_start, r.g_end) for r in j.overlap_join(t, right, bin_width=32).collect()) == want


@pytest.mark.parametrize("few", [0, 1000])
def test_joins_in_tiles(spark, monkeypatch, few):
    """Tiles of few spans and blocks of few rows give every pair once, whichever side is dense, repeated rows and spans too."""
    for name, value in (("FEW", few), ("DENSE", 0), ("TILE", 3), ("BLOCK", 4), ("TASK", 50)):
        monkeypatch.setattr(j, name, value)
    rows, spans = random_case(8)
    rows, spans = rows + rows[:20] + [(900, None, 5), (901, "chr1", None)], spans + spans[:9] + [("chr1", 1, 10**12), ("chr2", -50, 10**9), ("chr2", 9, 3), (None, 1, 9)]
    df, t = spark.createDataFrame(rows, "id int, contig string, position int"), table(spark, spans)
    pairs = sorted((i, c, p, a, b) for i, c, p in rows for d, a, b in spans if c and p and c == d and a <= p <= b)
    out = j.interval_join(df, t, bin_width=4)
    assert out.columns == ["id", "contig", "position", "start", "end"] and sorted(map(tuple, out.collect())) == pairs
    right = t.toDF("g_contig", "g_start", "g_end")
    good = [x for x in spans if x[0] and x[1] <= x[2]]
    want = sorted((c, a, b, x, y) for c, a, b in good for d, x, y in good if c == d and a <= y and b >= x)
    assert sorted((r.contig, r.start, r.end, r.g_start, r.g_end) for r in j.overlap_join(t, right, bin_width=32).collect()) == want
    assert j.interval_join(df, t.limit(0)).count() == 0 == j.interval_join(df.limit(0), t).count()


def written_bits(df, path):
    df.write.parquet(str(path))
    files = list(path.glob("*.parquet"))
    return 8 * sum(f.stat().st_size for f in files) / df.sparkSession.read.parquet(str(path)).count()


def many(spark):
    """Rows in any order, and spans of which hundreds lie over one place."""
    rows = spark.range(6000).selectExpr("hash(id) % 100000 as k", "'chr1' as contig", "pmod(hash(id, 1), 200000) as position").repartition(4)
    spans = spark.range(1500).selectExpr("'chr1' as contig", "pmod(hash(id, 2), 100000) + 0L as start", "pmod(hash(id, 2), 100000) + 50000L + pmod(hash(id, 3), 100000) as end")
    return rows, spans


def test_many_pairs_take_few_bits(spark, tmp_path):
    """A written pair takes a few bits, not whole values of both sides."""
    rows, spans = many(spark)
    assert written_bits(j.interval_join(rows, spans).select("k", "start", "end"), tmp_path / "points") < 8


@pytest.mark.parametrize("columns", [["gene", "start", "end"], ["contig", "start", "end", "g_start", "g_end"]], ids=["j6", "f9"])
def test_many_overlaps_take_few_bits(spark, tmp_path, columns):
    rows, spans = many(spark)
    genes = rows.selectExpr("k as gene", "contig as g_contig", "position + 0L as g_start", "position + 500L as g_end")
    assert written_bits(j.overlap_join(spans, genes).select(*columns), tmp_path / "overlaps") < 8


def test_rows_are_not_broadcast(spark, tmp_path):
    """Rows in a small file, each looked up at several levels, stay where they are; the intervals go to them."""
    rows, spans = random_case(7)
    spark.createDataFrame(rows, "id int, contig string, position int").write.parquet(str(tmp_path / "rows"))
    kept = spark.read.parquet(str(tmp_path / "rows"))
    plan = j.interval_join(kept, table(spark, spans * 40))._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_overlaps_are_dealt_out(spark):
    """Few rows that make many pairs are the work of several tasks."""
    t = table(spark, [("chr1", k, k + 5000) for k in range(300)]).coalesce(1)
    out = j.overlap_join(t, t.toDF("g_contig", "g_start", "g_end"))
    assert out.groupBy(F.spark_partition_id()).count().where("count > 10000").count() > 1 and out.count() == 90000


def test_equal_rows_are_dealt_out(spark):
    """Copies of one row under many intervals stay the work of several tasks."""
    rows = spark.range(0, 400, 1, 8).selectExpr("7 as k", "'chr1' as contig", "5000 as position")
    out = j.interval_join(rows, table(spark, [("chr1", k, k + 9000) for k in range(300)]))
    assert out.groupBy(F.spark_partition_id()).count().count() > 1 and out.count() == 120_000


def test_no_nested_loop(spark):
    rows, spans = random_case(4)
    df = spark.createDataFrame(rows, "id int, contig string, position int")
    plan = j.interval_semi_join(df, table(spark, spans))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairing(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, l int")
    right = spark.createDataFrame([("a", 9)], "k string, r int")
    out = j.pair_left_join(left, right, ["k"], [left.l], [right.r]).collect()
    assert sorted((x.k, x.l, x.r) for x in out) == [("a", 1, 9), ("a", 2, None), ("b", 3, None)]


def brute_clump(rows, threshold, window):
    out, taken = [], set()
    hits = sorted((p, pos, ref, alt, c, i) for i, (c, pos, ref, alt, p) in enumerate(rows) if p < threshold)
    for p, pos, ref, alt, c, i in hits:
        if i in taken:
            continue
        own = [k for q, x, *_, d, k in hits if d == c and k not in taken and max(1, pos - window) <= x <= pos + window]
        taken.update(own)
        out.append((c, pos, ref, alt, p, len(own)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clump(spark, seed):
    r = random.Random(seed)
    rows = [(f"chr{r.randint(1, 2)}", r.randint(1, 4000), r.choice("AC"), r.choice("GT"), r.choice([1e-9, 2e-9, 1e-12, 0.5])) for _ in range(200)]
    df = spark.createDataFrame(rows, "contig string, position int, ref string, alt string, pvalue double")
    out = loci.clump(df, 5e-8, 60)
    assert sorted((x.contig, x.lead_position, x.lead_ref, x.lead_alt, x.lead_pvalue, x.n_variants) for x in out.collect()) == brute_clump(rows, 5e-8, 60)


@pytest.mark.parametrize("block, halo", [(64, 8), (3, 1), (2, 2)])
def test_clump_in_blocks(spark, monkeypatch, block, halo):
    """Groups without gaps, runs of falling p over many blocks, ties and repeated rows: as one by one."""
    monkeypatch.setattr(loci, "BLOCK", block)
    monkeypatch.setattr(loci, "HALO", halo)
    r = random.Random(block)
    groups = {}
    for who in ("a", "b", ""):
        rows = [(f"chr{r.randint(1, 2)}", r.randint(1, 4000), r.choice("AC"), "G", r.choice([1e-9, 2e-9, 10.0 ** -r.randint(9, 40), 0.5])) for _ in range(700)]
        rows += [("chr3", 40 * k, "A", "G", 10.0 ** -(10 + k / 4)) for k in range(1, 120)]
        groups[who] = rows + rows[:50]
    df = spark.createDataFrame([(w, *x) for w, rows in groups.items() for x in rows], "phenotype string, contig string, position int, ref string, alt string, pvalue double")
    out = loci.clump(df, 5e-8, 60, by=["phenotype"]).collect()
    for who, rows in groups.items():
        got = sorted((x.contig, x.lead_position, x.lead_ref, x.lead_alt, x.lead_pvalue, x.n_variants) for x in out if x.phenotype == who)
        assert got == brute_clump(rows, 5e-8, 60)
    assert loci.clump(df.limit(0), 5e-8, 60).count() == 0


def test_loci_of_many_phenotypes(spark):
    r = random.Random(2)
    rows = [(w, "eur", f"chr{r.randint(1, 2)}", r.randint(1, 9000), "A", "G", 10.0 ** -r.randint(7, 30), r.choice(["exome", "genome"])) for w in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "phenotype string, ancestry string, contig string, position int, ref string, alt string, pvalue double, sequencing_type string")
    every = loci.loci(df, window=100, by=["phenotype", "ancestry"])
    for who in ("a", "b"):
        one = loci.loci(df.where(F.col("phenotype") == who), window=100)
        assert sorted(map(tuple, every.where(F.col("phenotype") == who).drop("phenotype", "ancestry").collect())) == sorted(map(tuple, one.collect()))
    # Each phenotype's significant rows are written by one scan of the input.
    assert every.count() > 20 and "phenotype" in every.columns


def test_pipeline_of_many_phenotypes(spark):
    """Tables of all phenotypes at once equal those made one by one; a phenotype may have genes only."""
    from locusframe.operators import manhattan

    r = random.Random(6)
    rows = [(w, a, f"chr{r.randint(1, 2)}", r.randint(1, 9000), "A", "G", 10.0 ** -r.randint(1, 20), r.choice(["exome", "genome"])) for w, a in (("a", "x"), ("a", "y"), ("b", "x")) for _ in range(300)]
    df = spark.createDataFrame(rows, "phenotype string, ancestry string, contig string, position int, ref string, alt string, pvalue double, sequencing_type string")
    genes = [(w, a, f"G{k}", f"S{k}", "m", 0.01, 10.0 ** -r.randint(1, 9), 0.5, 0.5, 0.1, 5, f"chr{k % 3}", 100 * k) for w, a in (("a", "x"), ("c", "x")) for k in range(40)]
    tests = spark.createDataFrame(genes, "phenotype string, ancestry string, gene_id string, gene_symbol string, annotation string, max_maf double, pvalue double, pvalue_burden double, pvalue_skat double, beta_burden double, mac long, contig string, position long")
    made = manhattan.pipeline_of_many(df, tests, window=200, strategy="clump")
    for w, a in (("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")):
        own = lambda t: t.where((F.col("phenotype") == w) & (F.col("ancestry") == a))  # noqa: B023, E731
        one = manhattan.pipeline(own(df).drop("phenotype", "ancestry"), None, own(tests).drop("phenotype", "ancestry"), None, w, a, window=200, strategy="clump")
        for name, table in one.items():
            columns = [c for c in table.columns if c not in ("phenotype", "ancestry")]
            assert sorted(map(repr, own(made[name]).select(*columns).collect())) == sorted(map(repr, table.select(*columns).collect())), (w, a, name)
