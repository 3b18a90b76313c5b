from quantafold.functions.names import Form, likeness
from quantafold.llm.spellings import ALIKE, components, link_spellings, propose, propose_alike, read_forms, variant_pairs

SECTORS = ["Power", "Paper", "Steel"]
REGISTRY = [("1", "Ginosyel Drastenbri Power Company Limited"), ("1", "永信卓邦億電力股份有限公司"), ("2", "Felrostam Drakarfel Paper Group"), ("3", "Felrostam Drakarfel Power Group"), ("4", None)]


def linked(spark, names, registry=REGISTRY):
    df = spark.createDataFrame([(n, 1) for n in names], "name string, entity int")
    reg = spark.createDataFrame(registry, "entity string, name string") if registry is not None else None
    return link_spellings(df, reg, SECTORS)


def test_variants_link_through_the_registry(spark):
    names = ["Ginos Drasten Power", "GINSOYEL DRASTENBRI POWER LTD", "永信卓邦億電力", "Power Group (Felrostam Drakarfel)", "Felrostam Drakarfel Ppr", "Felrostam Drakarfel", None, "", " ", "The Group Limited", "Ginos Drasten Power"]
    got = {r.name: r.entity for r in linked(spark, names).collect()}
    assert [got[n] for n in names[:5]] == ["1", "1", "1", "3", "2"] and got["Felrostam Drakarfel"].startswith("form:") and got["The Group Limited"] == "name:The Group Limited" and len(got) == 7


def test_without_registry_forms_link_with_each_other(spark):
    names = ["Valbakel Jodradra Steel", "Valbakel Jodrarda Steel Co.", "JODRADRA VALBAKEL STEEL", "Something Else Paper", "x" * 5000]
    got = {r.name: r.entity for r in linked(spark, names, None).collect()}
    assert got[names[0]] == got[names[1]] == got[names[2]] != got[names[3]] and len(got) == 5


def test_pairs(spark):
    pairs = [tuple(r) for r in variant_pairs(linked(spark, ["Ginos Drasten Power", "永信卓邦億電力", "Ginosyel Drastenbri Power", "Other One Steel"])).collect()]
    assert sorted(pairs) == [("Ginos Drasten Power", "Ginosyel Drastenbri Power"), ("Ginos Drasten Power", "永信卓邦億電力"), ("Ginosyel Drastenbri Power", "永信卓邦億電力")]


def test_empty(spark):
    assert linked(spark, []).count() == 0


def test_prefix_filter_loses_no_pair(spark):
    import random

    rng = random.Random(3)
    syllables = ["gra", "tam", "ost", "nel", "quel", "pa", "bri", "dor"]
    names = ["".join(rng.choices(syllables, k=3)) + " " + "".join(rng.choices(syllables, k=2)) for _ in range(60)]
    forms = read_forms(spark.createDataFrame([(n,) for n in names], "name string"), SECTORS).dropDuplicates(["form"]).drop("name").cache()
    rows = forms.collect()
    whole = {(a.form, b.form) for a in rows for b in rows if len(set(a.grams) & set(b.grams)) >= -(-len(a.grams) // 2)}
    assert {(r.form, r.partner) for r in propose(forms, forms, 0.5).collect()} == whole


def test_proposals_that_can_be_alike_and_few_others(spark):
    import random

    rng = random.Random(5)
    syllables = ["gra", "tam", "ost", "nel", "quel", "pa", "bri", "dor"]
    names = ["".join(rng.choices(syllables, k=3)) + " " + "".join(rng.choices(syllables, k=3)) for _ in range(150)]
    names += [n[:3] + "x" + n[4:] for n in names[:75]] + [n.replace(" ", "") for n in names[75:]]
    forms = read_forms(spark.createDataFrame([(n,) for n in names], "name string"), SECTORS).dropDuplicates(["form"]).drop("name").cache()
    read = {r.form: Form(r.kind, r.sector, tuple(r.tokens)) for r in forms.collect()}
    every = {(r.form, r.partner) for r in propose(forms, forms).collect()}
    alike = {p for p in every if likeness(read[p[0]], read[p[1]]) >= ALIKE}
    for many in (2, 1000):
        got = {(r.form, r.partner) for r in propose_alike(forms, forms, many=many).collect()}
        assert len(alike) > len(read) and alike <= got <= every and len(got) < len(every) / 2


def test_components(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y")]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"n{i:02}"] == "n00" for i in range(21)) and got["y"] == got["x"] == "x"
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_names_of_every_script_stay(spark):
    names = ["Газпром нефть", "ГАЗПРОМ НЕФТЬ", "삼성전자", "삼성전자 주식회사", "トヨタ自動車", "شركة النور", "Société Générale Énergie", "Societe Generale Energie", "***", "ABC集團", "XYZ集團"]
    got = {r.name: r.entity for r in linked(spark, names, None).collect()}
    assert set(got) == set(names) and got["***"] == "name:***"
    assert got[names[0]] == got[names[1]] and got[names[6]] == got[names[7]] and got["ABC集團"] != got["XYZ集團"] and got["삼성전자"] != got["トヨタ自動車"]


def test_a_registered_word_is_never_general(spark):
    registry = [("1", "Northgate Power Ltd"), ("2", "Northgate Asia Power Ltd")]
    got = {r.name: r.entity for r in linked(spark, ["Northgate Power Limited", "Northgate Asia Power Limited"], registry).collect()}
    assert got == {"Northgate Power Limited": "1", "Northgate Asia Power Limited": "2"}
