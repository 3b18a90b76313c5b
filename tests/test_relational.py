import pytest
from pyspark.sql import functions as F

from quantafold.operators import relational as R


@pytest.fixture(scope="module")
def crimes(spark):
    data = [(1, "567.pdf", "2020-03-04", "cannabis"), (2, "ppp.pdf", "2020-06-01", "ketamine"), (3, "abc.pdf", "2019-01-01", None), (4, "x.pdf", None, "Cannabis oil")]
    return spark.createDataFrame(data, "doc_id int, doc_name string, day string, goods string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_lookups(crimes):
    assert ids(crimes.filter(R.where(crimes, goods="cannabis"))) == [1]
    assert ids(crimes.filter(R.where(crimes, goods__icontains="CANNABIS"))) == [1, 4]
    assert ids(crimes.filter(R.where(crimes, day__gte="2020-01-01", day__lt="2021-01-01"))) == [1, 2]
    assert ids(crimes.filter(R.where(crimes, doc_id__in=[3, 4], goods__isnull=True))) == [3]
    assert ids(crimes.filter(R.negated(R.where(crimes, goods="cannabis")))) == [2, 3, 4]
    with pytest.raises(ValueError, match="no field"):
        R.where(crimes, nothing=1)
    with pytest.raises(ValueError, match="no lookup"):
        R.where(crimes, goods__like="x")


def test_changes(crimes):
    assert ids(R.delete_where(crimes, None)) == [1, 2, 3, 4] and ids(R.delete_where(crimes, F.col("goods") == "cannabis")) == [2, 3, 4]
    assert R.update_where(crimes, None, {"goods": F.lit("x")}) is crimes
    assert {r.doc_id for r in R.update_where(crimes, F.col("goods").isNull(), {"goods": F.lit("x")}).filter("goods = 'x'").collect()} == {3}
    new = crimes.sparkSession.createDataFrame([(1, "new.pdf", None, None), (9, "n.pdf", None, None), (9, "o.pdf", None, None)], crimes.schema)
    assert ids(R.insert_new(crimes, new, ["doc_id"])) == [1, 2, 3, 4, 9]
    merged = {r.doc_id: r for r in R.upsert(crimes, new.filter("doc_name <> 'o.pdf'"), ["doc_id"]).collect()}
    assert merged[1].doc_name == "new.pdf" and merged[1].goods == "cannabis" and len(merged) == 5
    assert ids(R.replace_by_key(crimes, new, ["doc_id"])) == [1, 2, 3, 4, 9, 9]
    with pytest.raises(ValueError):
        R.insert_new(crimes, new.drop("goods"), ["doc_id"])


def test_ordered(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), ("b", 1, "x")], "g string, t int, v string")
    assert [r.island for r in R.islands(df, ["g"], ["t"], ["v"]).orderBy("g", "t").collect()] == [1, 1, 2, 2, 3, 1]
    assert [r.c for r in R.carry_forward(df, ["g"], ["t"], "v", "c").orderBy("g", "t").collect()] == ["x"] * 6
    assert [r.batch for r in R.batches(df, ["g"], ["t"], 2, full_only=True).orderBy("g", "t").collect()] == [0, 0, 1, 1]


def test_best_by_max_equals_best_per_key(spark):
    df = spark.range(500).selectExpr("id % 7 AS k", "id % 11 AS s", "id AS u")
    a = R.best_by_max(df, ["k"], ["s"], ["u"]).orderBy("k").collect()
    b = R.best_per_key(df, ["k"], [F.desc("s"), F.desc("u")]).select("k", "s", "u").orderBy("k").collect()
    assert a == b


def test_shards():
    assert R.shard_ranges(0, 5) == [(0, 0)] * 5 and R.shard_ranges(16, 2) == [(0, 8), (8, 16)]
    assert R.shard_ranges(2, 3) == [(0, 1), (1, 2), (2, 2)] and R.shard_ranges(42, 4) == [(0, 11), (11, 22), (22, 32), (32, 42)]
