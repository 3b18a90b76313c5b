import math

from quantafold.operators.wide import conflicting_cells, dense_ids, stitch

SCHEMA = "entity string, year string, attribute string, value double, ordinal int"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_cells_conflicts_nulls_and_repeats(spark):
    df = rows(spark, [("a", "1", "x", 1.0, 9), ("a", "1", "x", 1.0, 9), ("a", "1", "y", 2.0, 9), ("a", "1", "y", 3.0, 9), (None, "1", "x", 5.0, 9), ("b", "2", "x", None, 9), ("b", "2", "y", math.nan, 9), ("c", "3", None, 1.0, 9), ("d", "4", "other", 1.0, 9)])
    wide = stitch(df, ["entity", "year"], "attribute", "value", {"x": "double", "y": "double"}, buckets=3)
    got = {(r.entity, r.year): (r.x, r.y, r.conflicts) for r in wide.collect()}
    assert got == {("a", "1"): (1.0, 2.0, ["y"]), (None, "1"): (5.0, None, [])}
    assert [tuple(r) for r in conflicting_cells(wide, ["entity", "year"], "attribute").collect()] == [("a", "1", "y")]


def test_ordinals_have_no_gaps_over_ranges(spark):
    data = [(f"e{i}", str(i % 3), a, float(i), 0) for i in range(500) for a in ("x", "y") if (i + len(a)) % 2 or a == "x"]
    wide = stitch(rows(spark, data), ["entity"], "attribute", "value", {"x": "double", "y": "double"}, buckets=4, span=7).collect()
    assert sorted(r.ordinal for r in wide) == list(range(500))
    assert all(r.x == float(r.entity[1:]) for r in wide)


def test_typed_columns_and_clashing_names(spark):
    df = spark.createDataFrame([("a", "n", "7"), ("a", "s", "seven"), ("a", "ordinal", "1.5"), ("b", "n", "no number")], "e string, k string, v string")
    wide = stitch(df, ["e"], "k", "v", {"n": "bigint", "s": "string", "ordinal": "double", "E": "string"}, buckets=2)
    assert wide.columns == ["ordinal", "e", "n", "s", "ordinal_value", "E_value", "conflicts"]
    assert [tuple(r)[1:6] for r in wide.collect()] == [("a", 7, "seven", 1.5, None)]


def test_empty_table(spark):
    assert stitch(rows(spark, []), ["entity"], "attribute", "value", {"x": "double"}).count() == 0


def test_one_hot_entity(spark):
    df = spark.range(20000).selectExpr("'hot' AS e", "'x' AS k", "CAST(id AS DOUBLE) AS v")
    assert [(r.e, r.x, r.conflicts) for r in stitch(df, ["e"], "k", "v", {"x": "double"}).collect()] == [("hot", 0.0, ["x"])]


def test_dense_ids(spark):
    df = spark.createDataFrame([(5,), (9,), (5,), (None,), (1,)], "k bigint")
    assert sorted(map(tuple, dense_ids(df, "k", "d", 3).collect())) == [(1, 0), (5, 1), (9, 2)]


def test_every_entity_has_a_row(spark):
    data = [("a", "1", "x", 1.0, 9), ("a", "1", "other", 7.0, 9), ("b", "2", "x", None, 9), ("b", "2", "y", math.nan, 9), ("c", "3", None, 1.0, 9), ("d", "4", "other", 1.0, 9), (None, "5", "y", None, 9), ("e", "6", "y", 2.0, 9), ("e", "6", "y", 3.0, 9), ("e", "6", "x", None, 9)]
    for span in (1, 4096):
        wide = stitch(rows(spark, data), ["entity", "year"], "attribute", "value", {"x": "double", "y": "double"}, buckets=3, span=span, every=True).collect()
        assert sorted(r.ordinal for r in wide) == list(range(6))
        assert {(r.entity, r.year): (r.x, r.y, r.conflicts) for r in wide} == {
            ("a", "1"): (1.0, None, []), ("b", "2"): (None, None, []), ("c", "3"): (None, None, []), ("d", "4"): (None, None, []), (None, "5"): (None, None, []), ("e", "6"): (None, 2.0, ["y"])
        }


def test_every_entity_with_typed_and_many_columns(spark):
    df = spark.createDataFrame([("a", "n", "7"), ("b", "n", "no number"), ("c", "s", "seven"), ("d", "other", "1"), ("e", None, "1")], "e string, k string, v string")
    for more in ({}, {f"m{i}": "string" for i in range(200)}):
        wide = stitch(df, ["e"], "k", "v", {"n": "bigint", "s": "string", **more}, buckets=2, every=True).collect()
        assert {r.e: (r.n, r.s) for r in wide} == {"a": (7, None), "b": (None, None), "c": (None, "seven"), "d": (None, None), "e": (None, None)}


def test_company_year_without_listed_value_is_in_p1_wide(spark, tmp_path):
    from quantafold.plans.core_problems import p1_found, p1_wide

    spark.createDataFrame([("A", "2020", "Energy", 1.0), ("A", "2021", "Energy", None), ("B", "2020", "free words", 2.0), ("", "2020", "Energy", 1.0), ("C", None, "Energy", 1.0)], "company_name string, year string, target_metric string, converted_value double").write.parquet(f"{tmp_path}/environment_info.parquet")
    spark.createDataFrame([(1, '["Energy", "Power"]', "kWh", 1.0, "c")], "id bigint, metric string, unit string, density_ntp_kg_per_m3 double, category string").write.parquet(f"{tmp_path}/metric_schema.parquet")
    assert {(r.company_name, r.year, r.Energy) for r in p1_wide(spark, str(tmp_path)).collect()} == {("A", "2020", 1.0), ("A", "2021", None), ("B", "2020", None)}
    assert p1_found(spark, str(tmp_path)).count() == 0
