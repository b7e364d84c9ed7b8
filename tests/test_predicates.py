import pytest

from locusframe.functions import predicates as p


def test_literals():
    assert [p.literal(x) for x in ("1", "3000000000", "1.5", "2e-3", "true", "chr1", "'a b'", "yes")] == [1, 3000000000, 1.5, 0.002, True, "chr1", "a b", "yes"]


@pytest.mark.parametrize(
    "text, path, op, value",
    [("af>=0.1", ("af",), ">=", 0.1), ("locus.contig = chr1", ("locus", "contig"), "=", "chr1"), ("x gte 5", ("x",), ">=", 5), ("x lte 5", ("x",), "<=", 5),
     ("a!=b", ("a",), "!=", "b"), ("name=salted", ("name",), "=", "salted"), ("x<3", ("x",), "<", 3)],
)
def test_clause(text, path, op, value):
    assert p.clause(text) == p.Clause(path, op, value)


def test_bad_clauses():
    for text in ("af", "", "af ~ 3", "=3"):
        with pytest.raises(ValueError):
            p.clause(text)


def rows(spark):
    return spark.createDataFrame(
        [(1, ("chr1", 99), 0.1), (2, ("chr1", 100), None), (3, ("chr1", 200), 0.5), (4, ("chr1", 201), 2.0), (5, None, 0.7)],
        "id int, locus struct<contig:string,position:int>, af double",
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_inclusive_ends(spark):
    assert ids(p.in_ranges(rows(spark), p.KeyRange.between("locus.position", 100, 200))) == [2, 3]
    assert ids(p.in_ranges(rows(spark), p.KeyRange.between("locus.position", 99, 201, inclusive=False))) == [2, 3]


def test_modes(spark):
    assert ids(p.where(rows(spark), "af > 0.3")) == [3, 4, 5]
    assert ids(p.where(rows(spark), "af > 0.3", mode="compat")) == [2, 3, 4, 5]
    # An int literal against a double column, and an unknown path, filter nothing in this mode.
    assert ids(p.where(rows(spark), "af > 1", mode="compat")) == [1, 2, 3, 4, 5]
    assert ids(p.where(rows(spark), "af > 1")) == [4]
    assert len(ids(p.where(rows(spark), "none = 1", mode="compat"))) == 5
    with pytest.raises(ValueError):
        p.where(rows(spark), "none = 1")
    assert ids(p.where(rows(spark), "locus.contig = chr1 AND id >= 3")) == [3, 4]
    # A fraction against an integer column keeps its sense.
    assert ids(p.where(rows(spark), "id > 3.5")) == [4, 5]


def test_calls_mode(spark):
    """An unknown path or a null above drops; a null or a literal of another kind is equal."""
    met = lambda *text: ids(p.where(rows(spark), *text, mode="calls"))
    assert met("none = 1") == [] and met("af > 0.3") == [3, 4, 5] and met("af >= 0.3") == [2, 3, 4, 5]
    assert met("af > 1") == [] and met("af <= 1") == [1, 2, 3, 4, 5]
    assert met("locus.position >= 100") == [2, 3, 4] and met("locus.contig >= 5") == [1, 2, 3, 4] and met("locus.contig > 5") == []


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark).write.parquet(path)
    plan = p.where(spark.read.parquet(path), "locus.contig = chr1", "af > 0.3").select("id")._jdf.queryExecution().toString()
    assert "EqualTo(locus.contig,chr1)" in plan and "GreaterThan(af,0.3)" in plan


def test_and_within_quotes(spark):
    df = spark.createDataFrame([("a AND b", 1), ("c", 2), ("5' end", 3)], "name string, n int")
    names = lambda *c: [r.name for r in p.where(df, *c).collect()]
    assert names("name = 'a AND b'") == ["a AND b"] and names("name = 'a AND b' and n >= 1") == ["a AND b"]
    assert names('n < 3 AND name != "a AND b"') == ["c"] and names("name = 5' end AND n > 1") == ["5' end"]
    assert [r.path for r in p.key_ranges("name = 'x AND y' AND n > 1")] == [("name",), ("n",)]


def test_conditions_of_a_request(spark):
    """No blank is cut from names or values, and the first operator cuts."""
    assert p.request_clause("a.b>= x ") == p.Clause(("a", "b"), ">=", " x ") and p.request_clause("n=5") == p.Clause(("n",), "=", 5)
    assert p.request_clause("n= 5") == p.Clause(("n",), "=", " 5") and p.request_clause("a =true") == p.Clause(("a ",), "=", True)
    assert p.request_clause("a='x'") == p.Clause(("a",), "=", "'x'") and p.request_clause("a<b>c").op == ">"
    with pytest.raises(ValueError):
        p.request_clause("nothing")
    df = spark.createDataFrame([(" x",), ("x",)], "a string")
    assert [r.a for r in p.where(df, "a= x", request=True).collect()] == [" x"] and [r.a for r in p.where(df, "a= x").collect()] == ["x"]
