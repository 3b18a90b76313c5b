from hypothesis import given, settings
from hypothesis import strategies as st

from quantafold.functions.names import edit_distance
from quantafold.llm.canonical import AliasTrie, Canonicalizer, allowed, canonicalize, mine_aliases, mine_asides

ENTRIES = {"Female Employees": ["Female Employees", "Women employed", "女性僱員"], "Male Employees": ["Male Employees", "Men employed"], "Diesel Burned by Vehicles": ["Diesel Burned by Vehicles"], "Hazardous Waste Generated": ["Hazardous Waste Generated"]}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=8), st.text("abcd", max_size=8), st.integers(0, 3))
def test_automaton_finds_what_brute_force_finds(words, query, most):
    trie = AliasTrie()
    for w in words:
        trie.add(w, w)
    assert trie.within(query, most) == sorted((d, w) for w in set(words) if (d := plain_distance(query, w)) <= most)


def test_meanings():
    find = Canonicalizer(ENTRIES, [("ladies on staff", "Female Employees")], [("beside", "year"), ("beside", "group"), ("before", "kpi")]).find
    for text in ["Female Empolyees", "(b) FEMALE_EMPLOYEES<s>5</s>", "Employees, Female", "• Women\nemployed / year [2]", "女性僱員 (千人)", "Female Empl.", "KPI Ladies on staff, in persons", "Women employed persons", "Employees, 6.5 Female", "– group, Female Employees"]:
        assert find(text) == "Female Employees", text
    assert find("Burned by Vehicles, Diesel") == "Diesel Burned by Vehicles" and find("Haz. Waste Gen.") == "Hazardous Waste Generated"
    for text in [None, "", "  ", "Total", "2019", "Net promoter score", "emale Employees " * 2000]:
        assert find(text) == "unmatched", text


def test_ties_are_unmatched():
    find = Canonicalizer({"abcde1": ["abcde1"], "abcde2": ["abcde2"]}).find
    assert find("abcde3") == "unmatched" and find("abcde1") == "abcde1"


def test_table(spark):
    data = [(1, None, "Women employd", "z"), (2, "nonsense words", "Men employed", "z"), (3, None, None, "z"), (4, "", "", "z"), (5, "Female Employees", "Men employed", "z"), (5, "Female Employees", "Men employed", "z")]
    df = spark.createDataFrame(data, "id int, a string, b string, canonical string")
    got = canonicalize(df, ["a", "b"], ENTRIES)
    assert got.columns == ["id", "a", "b", "canonical"]
    assert sorted((r.id, r.canonical) for r in got.collect()) == [(1, "Female Employees"), (2, "Male Employees"), (3, "unmatched"), (4, "unmatched"), (5, "Female Employees"), (5, "Female Employees")]
    assert canonicalize(df.limit(0), ["a"], ENTRIES).count() == 0
    assert {r.canonical for r in canonicalize(df, ["a"], {}).collect()} == {"unmatched"}


def test_aliases(spark):
    rows = [("Ladies on staff", "Female Employees", f"c{i}") for i in range(5)] + [("ladies on stafff", "Female Employees", "c9"), ("Fenale Employees", "Female Employees", "c1"), ("either", "Female Employees", "a"), ("either", "Male Employees", "b"), (None, "Male Employees", "b")]
    assert mine_aliases(spark.createDataFrame(rows, "value string, entry string, who string"), ENTRIES) == [("ladies on staff", "Female Employees")]


def test_distances_are_allowed_by_length():
    assert [allowed(n) for n in (3, 4, 9, 18, 24)] == [0, 1, 2, 3, 4] and edit_distance("ab", "ba") == 1


def test_values_of_any_length_are_searched():
    long = "energy used by the plants of the northern region " * 100
    find = Canonicalizer({"Energy": [long.strip()], "Short": ["Short"]}).find
    assert find(long.replace("plants", "plantz", 1)) == "Energy" and find(long * 2) == "unmatched"


def test_shortened_words_of_any_number():
    words = [f"{a}{v}{b}t" for a in "bcdf" for v in "aeiou" for b in "lmnr"]
    name = " ".join(words[i] for i in (0, 17, 33, 50, 66, 79, 12))
    find = Canonicalizer({"It": [name], "Other": [" ".join(words[20:40])], "All": [" ".join(words)]}).find
    assert find(" ".join(w[:2] + "." for w in name.split())) == "It"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=6), st.text("abcd", max_size=6), st.integers(0, 2))
def test_beginnings(words, query, most):
    trie = AliasTrie()
    for w in words:
        trie.add(w, w)
    assert trie.begins(query, most) == any(plain_distance(query, w[:k]) <= most for w in words for k in range(len(w) + 1))


def test_notes_are_learnt(spark):
    entries = {name: [name] for name in ("Waste", "Water", "Energy", "Staff", "Gifts", "Fines", "Total Paper")}
    rows = [(f"KPI {e} (note {k}) – group", e) for k, e in enumerate(entries)] + [(f"{e}, all sites", e) for e in entries] + [("Waste (Scope 1)", "Waste"), ("Water (Scope 1)", "Water"), (None, "Water"), ("", "Water")]
    known = spark.createDataFrame(rows, "value string, entry string")
    asides = mine_asides(known, entries)
    assert asides == [("before", "kpi"), ("beside", "all sites"), ("beside", "group"), ("beside", "note #")]
    find = Canonicalizer(entries, (), asides).find
    assert find("Fines (note 99), all sites") == "Fines" and find("KPI Gifts – group [2]") == "Gifts" and find("Total Paper") == "Total Paper"
    assert mine_asides(known.limit(0), entries) == []
