import pytest
from pyspark.sql import functions as F

from quantafold.functions import text as T
from quantafold.operators.vectors import best_matches, hashed_grams, top_matches


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("r")).collect()[0].r


@pytest.mark.parametrize("text, number", [("1.453e-4", 1.453e-4), ("1.00 x 10-4", 1e-4), ("1.0 x 10<s>3</s>", 1000.0), ("1,234", 1234.0), ("20%", 20.0), ("1.2104", 1.2104), ("", None), ("no", None), (None, None)])
def test_numbers(spark, text, number):
    assert one(spark, T.to_number("c0"), text) == (pytest.approx(number) if number is not None else None)


@pytest.mark.parametrize("text, relation", [("more than 50 m3", "more than"), ("no less than 5", "more than"), ("no more than 5", "less than"), ("~5", "approximate"), ("5", "equal"), ("increased by 5%", "increased_by"), ("reduced waste by 3", "reduced_by")])
def test_relations(spark, text, relation):
    assert one(spark, T.relation_of("c0"), text) == relation


def test_units(spark):
    assert one(spark, T.word_factor("c0"), "hundred thousand tonnes") == 1e5 and one(spark, T.plain_unit("c0"), "t CO2-e per m<s>3</s>") == "tCO2e per m3"
    assert tuple(one(spark, T.range_of("c0"), "21 to 95")) == (21, 95) and one(spark, T.range_of("c0"), "x") is None
    assert tuple(one(spark, T.split_cell("c0", "c1"), "1,234 (kg)", "Waste (t)")) == ("1,234", "kg") and tuple(one(spark, T.split_cell("c0", "c1"), "12", "Waste (t)")) == ("12", "t")


def test_strings(spark):
    assert one(spark, T.roman("c0"), "MCMXCIV") == 1994 and one(spark, T.roman("c0"), "ABC") is None and one(spark, T.roman("c0"), "") is None
    assert one(spark, T.split_sentences("c0"), "One. Two! 三。四") == ["One.", "Two!", "三。", "四"]
    assert [tuple(x) for x in one(spark, T.occurrences("c0", "aa"), "aaab")] == [(0, 2), (1, 3)] and one(spark, T.occurrences("c0", "aa"), "a") == []
    assert one(spark, T.status_text("c0"), "x" * 300) == "x" * 253 + ".." and one(spark, T.status_text("c0"), "x" * 256) == "x" * 256
    assert one(spark, T.clean_text("c0"), "“a”  b \n , c\x01") == '"a" b, c' and one(spark, T.document_kind("c0"), "Annual reports.pdf") == "report"
    facts = one(spark, T.file_facts("c0"), "00123_Company_2021 Annual Report 2020.pdf")
    assert (facts.stock_id, facts.year, facts.kind, facts.language) == (123, 2020, "annual", "en")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<float>")
    got = {r.id: r.best for r in best_matches(df, df.filter("id <= 3"), "id", "v", 0.5).collect()}
    assert got == {1: 2, 2: 1}
    assert {r.id: r.matches for r in top_matches(df, df.filter("id <= 3"), "id", "v", 0.05, 2).collect()} == {1: [2], 2: [1, 3], 3: [2]}
    row = spark.createDataFrame([("waste",), (None,)], "t string").select(hashed_grams("t").alias("h"), F.col("t")).collect()
    assert sum(row[0].h) == 5 and len(row[1].h) == 64


def test_near_names_like_trying_all(spark, tmp_path):
    from quantafold.plans import registry

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    typed = ["Waste", "waste ", "Waste\u00a0x", "Wsate", "waist", "wa", "溫室氣體", "溫室氣休", "", None, "Waste", "Water"]
    spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "id bigint, metric string").write.parquet(f"{tmp_path}/environment_info.parquet")
    spark.createDataFrame([(1, '["Waste"]'), (2, '["溫室氣體"]')], "id bigint, metric string").selectExpr("*", "'t' AS unit", "CAST(NULL AS DOUBLE) AS density_ntp_kg_per_m3", "'x' AS category").write.parquet(f"{tmp_path}/metric_schema.parquet")
    got = {tuple(r) for r in registry.QUERIES["edit_distance"](spark, str(tmp_path)).collect()}
    names = {t.lower().strip(" ") for t in typed if t and t.strip(" ")}
    assert got == {(t, n, d) for t in names for n in ("waste", "溫室氣體") if t[:2] == n[:2] and (d := distance(t, n)) <= 2}
