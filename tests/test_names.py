import pytest

from quantafold.functions.names import Form, NameReader, edit_distance, likeness
from quantafold.operators.company_keys import ALIKE, company_of, general_words, meets

READER = NameReader(["Power", "Paper", "Property", "Shipping", "Electronics", "Steel"])
WHOLE = READER.form("Ginosyel Drastenbri Power Company Limited")


@pytest.mark.parametrize("name", ["GINOSYEL DRASTENBRI POWER COMPANY LIMITED", "Company Limited, Ginosyel Drastenbri Power", "Power Company Limited (Drastenbri Ginosyel)", "The Ginosyel Drastenbri Power Co. and its subsidiaries", "Ginosyel-Drastenbri Pwr Grp", "Ginosye1 Drastenbri Power Int'l Hldgs Ltd"])
def test_forms_are_the_same(name):
    assert READER.form(name) == WHOLE


@pytest.mark.parametrize("name", ["Ginos  Drasten Power", "Ginsoyel Drastenbri Power", "Ginosyel Drastenbri", "GinosyelDrastenbri Power", "ginosyeldrastenbri power"])
def test_variants_are_alike(name):
    assert likeness(READER.form(name), WHOLE) >= 0.8


@pytest.mark.parametrize("name", ["Ginosyel Drastenbri Paper", "Ginosyel Other Power", "Power Company Limited", "", None, "永信卓邦億運輸股份有限公司"])
def test_others_are_not(name):
    assert likeness(READER.form(name), WHOLE) < 0.8


def test_nothing_left():
    assert READER.form(None) == READER.form("  ") == READER.form("The Group Limited") == Form("", "", ())


def test_edit_distance():
    assert edit_distance("abcd", "abdc") == 1 and edit_distance("abc", "") == 3 and edit_distance("kitten", "sitting") == 3 and edit_distance("abc", "xyz", 1) == 2


def test_companies(spark):
    registry = spark.createDataFrame([("1", "Ginosyel Drastenbri Power Company Limited"), ("1", "永信卓邦億電力股份有限公司"), ("2", "Felrostam Drakarfel Paper Group"), ("3", "Felrostam Drakarfel Power Group")], "entity string, name string")
    names = ["Ginos Drasten Power", "永信卓邦億電力", "Felrostam Drakarfel", "Felrostam Drakarfel Pwr", "Unknown Name Steel", None, "", "  ", "Felrostam Drakarfel Pwr"]
    got = {r.name: r.entity for r in company_of(spark.createDataFrame([(n,) for n in names], "name string"), registry, ["Power", "Paper", "Steel"]).collect()}
    assert got["Ginos Drasten Power"] == got["永信卓邦億電力"] == "1" and got["Felrostam Drakarfel Pwr"] == "3"
    assert got["Felrostam Drakarfel"].startswith("form:") and got["Unknown Name Steel"].startswith("form:") and len(got) == 5


def test_general_words_are_learnt_and_registered_ones_kept(spark):
    cores = ["Alba Bova", "Cora Dune", "Elfa Fino", "Gala Hemi", "Iota Jura", "Kelo Lima"]
    registry = spark.createDataFrame([(str(i), f"{c} Power Limited") for i, c in enumerate(cores)], "entity string, name string")
    names = spark.createDataFrame([(f"{c} {end}",) for c in cores for end in ("Power Limited", "(Asia)")] + [("Zorb Quix",), ("Zorb Quixx",), ("Zorb Quox",), ("",), (None,)], "name string")
    assert general_words(names.filter("name <> ''").distinct(), registry, ["Power"]) == ["asia"]
    with_asia = registry.unionByName(spark.createDataFrame([("9", "Asia Alba Power")], "entity string, name string"))
    assert general_words(names.filter("name <> ''").distinct(), with_asia, ["Power"]) == []
    assert general_words(names.limit(0), registry, ["Power"]) == []


def test_a_word_that_many_registered_names_hold(spark):
    import random

    rng = random.Random(4)
    others = sorted({"".join(rng.choices("bdfgklmnprstv", k=3)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("bdfgk", k=3)) for _ in range(120)})
    registry = spark.createDataFrame([(str(i), f"Northgate {o} Steel") for i, o in enumerate(others)], "entity string, name string")
    names = [f"NORTHGATE {o.upper()} STEEL LTD" for o in others] + ["***", "The Group Limited"]
    got = {r.name: r.entity for r in company_of(spark.createDataFrame([(n,) for n in names], "name string"), registry, ["Steel"]).collect()}
    assert all(got[f"NORTHGATE {o.upper()} STEEL LTD"] == str(i) for i, o in enumerate(others)) and len(got) == len(names) and got["***"] == "name:***"


def _near_names(rng, syllables, count):
    """Names of few syllables with the mistakes that people make, so that many are alike and many hold a word."""
    made = []
    while len(made) < count:
        words = ["".join(rng.choices(syllables, k=rng.choice([1, 2, 3, 4]))) for _ in range(rng.choice([1, 2, 2, 2, 3]))]
        if rng.random() < 0.4:
            words[0] = "Northgate"
        made.append(" ".join(words))
        for _ in range(2):
            again = list(words)
            for _ in range(rng.choice([1, 2])):
                k, (at, letter) = rng.randrange(len(again)), (rng.randrange(9), rng.choice("abkz"))
                w = again[k]
                again[k] = rng.choice([w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :], w[:at] + w[at + 1 : at + 2] + w[at : at + 1] + w[at + 2 :], w[: max(2, len(w) - 3)], w[:at] + w[at + 1 :]]) or w
            made.append(rng.choice([" ", " ", " ", ""]).join(again) + rng.choice(["", " Steel"]))
    return made + ["信卓邦億電力", "信卓邦億電水", "卓信邦億電力", "信卓邦億電", "信卓", "Alba Alba", "Alba Alba Bova", "Alba Alba"]


@pytest.mark.parametrize("many", [1, 5, 1000])
def test_no_pair_that_is_alike_is_missed(spark, many):
    import random

    names = _near_names(random.Random(11), ["gra", "tam", "ost", "nel", "quel", "pa", "bri", "dor"], 80)
    forms = sorted({NameReader(["Steel"]).form(n) for n in names} - {Form("", "", ())})
    df = spark.createDataFrame([(f.key, f.kind, f.sector, list(f.tokens)) for f in forms], "form string, kind string, sector string, tokens array<string>")
    got = {(r.form, r.partner) for r in meets(df, df, many).collect()}
    whole = {(a.key, b.key) for a in forms for b in forms if likeness(a, b) >= ALIKE}
    assert len(whole) > 1.5 * len(forms) and whole <= got and len(got) < len(forms) ** 2 / 4


def test_names_that_differ_in_the_word_beside_a_common_one(spark):
    # both ends of the other word are misspelt, and over 50 Chinese names begin alike
    others = [a + b + "mosvel" for a in ("bak", "dor", "fel", "gim", "jun", "kav", "lop", "nur") for b in ("ta", "ri", "so", "ne", "pu", "hi", "ga", "lo")]
    chinese = [f"信卓邦{a}{b}光" for a in "億永安泰康達偉嘉" for b in "海榮平景凱聯輝"]
    registry = spark.createDataFrame([(f"e{i}", f"Northgate {o} Steel") for i, o in enumerate(others)] + [(f"c{i}", f"{c}股份有限公司") for i, c in enumerate(chinese)], "entity string, name string")
    names = ["Northgate Bzktamosvbl Steel", "信卓邦億海先有限公司", "信卓邦達凱光"]
    got = {r.name: r.entity for r in company_of(spark.createDataFrame([(n,) for n in names], "name string"), registry, ["Steel"]).collect()}
    assert got == {names[0]: "e0", names[1]: f"c{chinese.index('信卓邦億海光')}", names[2]: f"c{chinese.index('信卓邦達凱光')}"}
