import pytest

from quantafold.functions.numbers import parse_quantity
from quantafold.functions.unit_grammar import UnitGrammar
from quantafold.functions.years import calendar_year
from quantafold.operators.units import bounded, convert_units, misconverted

GRAMMAR = UnitGrammar()


@pytest.mark.parametrize(
    "text, number, unit",
    [
        ("272450", 272450.0, ""), ("147 719 000", 147719000.0, ""), ("2,990,370,000", 2990370000.0, ""), ("1.01770 x 10<s>3</s>", 1017.7, ""), ("1.21999e+01", 12.1999, ""), ("~359.655", 359.655, ""),
        ("approx. -344,165", -344165.0, ""), ("350.136萬", 3501360.0, ""), ("44.8 million", 44.8e6, ""), ("291.996 (restated)", 291.996, ""), ("210,877 (HK$'000)", 210877.0, "HK$'000"),
        ("'000 persons 0.103", 0.103, "'000 persons"), ("t CO<s>2</s>e 1.92135 x 10<s>5</s>", 192135.0, "t CO2e"), ("65188700kg CO2e", 65188700.0, "kg CO2e"), ("20.1491 thousand (lb)", 20149.1, "lb"),
        ("3237.29 milliong", 3237.29, "milliong"), ("ratio (0-1) 0.55", 0.55, "ratio"),
    ],
)
def test_quantities(text, number, unit):
    got = parse_quantity(text)
    assert got[0] == pytest.approx(number) and got[1] == unit


@pytest.mark.parametrize("text", [None, "", "—", "N/A", "不適用", "not disclosed"])
def test_no_quantity(text):
    assert parse_quantity(text) is None


@pytest.mark.parametrize(
    "text, factor, kind",
    [
        ("MW h", 1.0, (("energy", 1),)), ("million kWh", 1e3, (("energy", 1),)), ("'000 MWh", 1e3, (("energy", 1),)), ("兆焦", 1 / 3600, (("energy", 1),)), ("ML", 1e3, (("length", 3),)), ("百萬立方米", 1e6, (("length", 3),)),
        ("cu. m", 1.0, (("length", 3),)), ("kgCO2e/employee", 1e-3, (("carbon", 1), ("people", -1))), ("千瓦時/平方米", 1e-3, (("energy", 1), ("length", -2))), ("HK$ M", 1e6, (("money", 1),)), ("HK$'000", 1e3, (("money", 1),)),
        ("ratio (0-1)", 100.0, (("share", 1),)), ("milliong", 1.0, (("mass", 1),)), ("m2", 1.0, (("length", 2),)),
    ],
)
def test_units(text, factor, kind):
    got = GRAMMAR.read(text)
    assert got[0] == pytest.approx(factor) and GRAMMAR.kind(got[1]) == kind


@pytest.mark.parametrize("text", [None, "", "widgets", "per", "kg kg", "x" * 5000])
def test_no_units(text):
    assert GRAMMAR.read(text) is None


METRICS = [(1, '["Diesel Burned", "Fuel"]', '["m3", "L"]', 840.0, "Fuel"), (2, '["Gifts"]', "HKD", None, "Money"), (3, '["Female Employees"]', "persons", None, "Count"), (4, '["Waste"]', "tonnes", None, "Absolute")]


@pytest.fixture(scope="module")
def references(spark):
    schema = spark.createDataFrame(METRICS, "id bigint, metric string, unit string, density_ntp_kg_per_m3 double, category string")
    units = spark.createDataFrame([("kg", "mass", 0.001, "tonnes"), ("bale", "mass", 0.25, "tonnes")], "unit string, dimension string, factor double, common_unit string")
    rates = spark.createDataFrame([("USD", 2010, 7.8)], "currency string, rate_year int, hkd_per_unit double")
    return schema, units, rates


FACTS = "id bigint, value string, unit string, metric string, target_metric string, year string, converted_value double, converted_unit string, std_value string"


def test_conversion_of_all_rows(spark, references):
    data = [
        (1, "840", "kg", "Fuel", "Diesel Burned", "2010", 1.0, "m3", "x"), (2, "2 million", "USD", None, "Gifts", "FY2010", 15.6e6, "HKD", "x"), (3, "2", "USD", None, "Gifts", None, None, None, "x"),
        (4, "5", None, "Female Employees", "Female Employees", "2010", 5.0, "persons", "x"), (5, "5", None, "Female Employees ('000 persons)", "Female Employees", "2010", 5.0, "persons", "x"),
        (6, "4", "bale", None, "Waste", "2010", 1.004, "tonnes", "x"), (7, None, "kg", None, "Waste", "2010", None, None, "x"), (8, "7", "cases", None, "Waste", "2010", None, None, "x"),
        (9, "7", "kg", None, "unknown", "2010", None, None, "x"), (10, None, None, None, None, None, None, None, None), (11, "7 kg", None, None, "Waste", "2010", float("nan"), "tonnes", "x"), (12, "5", "t", None, "Waste", "2010", 5.0, "kg", "x"),
        (12, "5", "t", None, "Waste", "2010", 5.0, "kg", "x"), (13, "9" * 400 + "kg", None, "w" * 9000, "Waste", "2010", None, None, "x"),
    ]
    facts = spark.createDataFrame(data, FACTS)
    made = convert_units(facts, *references)
    assert made.columns == [*facts.columns[:-1], "std_value", "std_unit", "std_status"]
    got = {r.id: (r.std_value, r.std_status) for r in made.collect()}
    assert got[1] == (pytest.approx(1.0), "converted") and got[2] == (pytest.approx(15.6e6), "converted") and got[3] == (None, "no rate")
    assert got[4] == (None, "no unit") and got[5] == (pytest.approx(5000.0), "converted") and got[6] == (pytest.approx(1.0), "converted")
    assert got[7][1] == "no number" and got[8][1] == "other dimension" and got[9][1] == got[10][1] == "no common unit" and made.count() == 14
    assert sorted(r.id for r in misconverted(facts, *references).filter("id < 13").collect()) == [5, 11, 12, 12]


def test_empty_tables(spark, references):
    empty = spark.createDataFrame([], FACTS)
    assert convert_units(empty, *references).count() == 0
    one = spark.createDataFrame([(1, "1", "kg", "m", "Waste", "2010", 1.0, "t", "x")], FACTS)
    assert [r.std_status for r in convert_units(one, *(t.limit(0) for t in references)).collect()] == ["no common unit"]


def test_bound_is_checked(spark):
    with pytest.raises(ValueError):
        bounded(spark.range(5), 4, "numbers")


def test_years(spark):
    texts = ["2006", " 2006 ", "2006.0", "FY2006", "Year 2006", "2006年", "２００６", "12345", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "y string").select(calendar_year("y").alias("y"))
    assert [r.y for r in df.collect()] == [2006] * 7 + [None] * 3


# factor in the base unit: tonnes, MWh, metres, HKD, %, hours
SIZES = {
    "mg": 1e-9, "Mg": 1.0, "µg": 1e-12, "g": 1e-6, "kg": 1e-3, "KG": 1e-3, "kt": 1e3, "Mt": 1e6, "MT": 1.0, "mt": 1.0, "lbs": 0.00045359237, "short tons": 0.90718474, "oz": 0.028349523125e-3,
    "mL": 1e-6, "ml": 1e-6, "cl": 1e-5, "L": 1e-3, "hL": 0.1, "kL": 1.0, "ML": 1e3, "GL": 1e6, "gallons": 3.785411784e-3, "barrels": 0.158987294928,
    "mm": 1e-3, "cm": 1e-2, "km": 1e3, "ft": 0.3048, "miles": 1609.344, "cm2": 1e-4, "km²": 1e6, "ha": 1e4, "sq. ft": 0.09290304, "acres": 4046.8564224, "mm3": 1e-9, "cm³": 1e-6, "dm3": 1e-3, "cubic centimetres": 1e-6,
    "mWh": 1e-9, "Wh": 1e-6, "kWh": 1e-3, "MWh": 1.0, "GWh": 1e3, "TWh": 1e6, "MJ": 1 / 3600, "GJ": 1 / 3.6, "TJ": 1e3 / 3.6, "PJ": 1e6 / 3.6, "kcal": 4.184e-3 / 3600, "toe": 11.63, "ktoe": 11630.0, "MMBtu": 0.2930710701722222,
    "HK$ million": 1e6, "HKD bn": 1e9, "US$'000": 1e3, "RMB mn": 1e6, "m3/HK$ million": 1e-6, "kg/HK$ million": 1e-9, "kg per million HKD": 1e-9, "tCO2e/HK$'000": 1e-3, "t per thousand employees": 1e-3, "kg/year": 1e-3, "10³ m3": 1e3, "basis points": 0.01, "minutes": 1 / 60,
}


@pytest.mark.parametrize("text", SIZES)
def test_sizes(text):
    assert GRAMMAR.read(text)[0] == pytest.approx(SIZES[text])


def test_priors_decide_where_case_is_lost():
    energy, volume = ((("energy", 1),), 1.0), ((("length", 3),), 1.0)
    assert GRAMMAR.read("mwh", *energy)[0] == 1.0 and GRAMMAR.read("mWh", *energy)[0] == pytest.approx(1e-9)
    assert GRAMMAR.read("pj", *energy)[0] == pytest.approx(1e6 / 3.6) and GRAMMAR.read("Mm3", *volume)[0] == 1e6 and GRAMMAR.read("ml", *volume)[0] == pytest.approx(1e-6)


def test_texts_of_any_length_are_read():
    assert GRAMMAR.read(" " * 3000 + "kilo" + "-" * 3000 + "tonnes" + " " * 3000) == (1e3, (("mass", 1),))
    assert GRAMMAR.read("per kg " * 1000) is None and GRAMMAR.read("mm/" * 2000 + "mm") is None


def test_unit_behind_a_name_among_notes(references, spark):
    rows = [(1, "5", None, "Waste (audited) (kg) – group", "Waste", None), (2, "5", None, "Waste in kg, restated", "Waste", None), (3, "5", None, "Female staff", "Female Employees", None), (4, "5", "kg" + " " * 4000, "Waste", "Waste", None)]
    df = spark.createDataFrame(rows, "id bigint, value string, unit string, metric string, target_metric string, year string")
    got = {r.id: (r.std_value, r.std_status) for r in convert_units(df, *references).collect()}
    assert got == {1: (0.005, "converted"), 2: (0.005, "converted"), 3: (None, "no unit"), 4: (0.005, "converted")}
