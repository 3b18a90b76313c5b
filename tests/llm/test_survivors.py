import itertools
import random

from quantafold.llm.survivors import FACT_BUNDLES, Bundles, best_choice, choose_bundles, choose_survivors, fact_trust, fuse

COLUMNS = "id bigint, k string, f int, s double, t double, document_id string, metric string, group_id string"
CRITERIA = {"reading": ("f",), "place": ("s",), "match": ("t",)}


def test_one_leader_survives_with_ties_nulls_and_repeats(spark):
    data = [
        (1, "a", 5, 0.9, 0.5, "d", "m", "z"), (2, "a", 7, 0.9, 0.6, "d", "m", "z"), (3, "a", 7, 0.9, 0.6, "d", "m", "z"), (4, "b", 1, None, 0.1, None, None, "z"), (5, "b", 1, 0.2, 0.1, "d", "m", "z"),
        (6, "c", 1, 1.0, 1.0, "d", "m", "z"), (7, None, 1, 1.0, 1.0, "d", "m", "z"), (8, None, 1, 1.0, 1.0, "d", "m", "z"), (9, "e", None, None, None, None, None, None), (10, "e", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, COLUMNS)
    got = {(r.k, r.group_id, r.id) for r in choose_survivors(df, ["k"], CRITERIA).collect()}
    assert got == {("a", 1, 2), ("b", 4, 5), ("e", 9, 9)}
    assert choose_survivors(df.limit(0), ["k"], CRITERIA).count() == 0


def test_contested_group_comes_of_one_record(spark):
    data = [(1, "a", 9, 0.1, 0.1, "d1", "m1", "z"), (2, "a", 1, 0.9, 0.9, "d2", "m1", "z"), (3, "a", 1, 0.1, 0.2, "d3", "m2", "z")]
    got = choose_survivors(spark.createDataFrame(data, COLUMNS), ["k"], CRITERIA).collect()
    assert [(r.group_id, r.id) for r in got] == [(1, 2)]


def tried(candidates, same):
    """The best legal choice by trying all."""
    names = list(candidates)
    legal = [c for c in itertools.product(*candidates.values()) if all(c[names.index(a)][2].get(f) == c[names.index(b)][2].get(f) for a, b, f in same)]
    return max(((sum(x[0] for x in c), tuple(-x[1] for x in c)) for c in legal), default=None)


def test_branch_and_bound_equals_trying_all():
    rng = random.Random(5)
    same = (("p", "q", "x"), ("q", "r", "y"))
    mixed = 0
    for _ in range(500):
        candidates = {b: [(rng.randint(0, 5), k, {"x": rng.choice(["a", "b", None]), "y": rng.choice("ab")}) for k in range(rng.randint(0, 5))] for b in "pqr"}
        want, got = tried(candidates, same), best_choice(candidates, same)
        assert (got is None) == (want is None)
        if got:
            assert (got[0], tuple(-i for i in got[1].values())) == want
            mixed += len(set(got[1].values())) > 1
    assert mixed > 100


def groups_of(data):
    out = {}
    for r in data:
        if r[1] is not None:
            out.setdefault(r[1], []).append(r)
    return {k: rows for k, rows in out.items() if len(rows) > 1}


def test_bundles_mix_sources_as_trying_all_does(spark):
    rng = random.Random(11)
    data = [(i, str(i % 60), rng.choice(["d1", "d2", None]), rng.choice(["m1", "m2"]), rng.randint(0, 9), rng.choice([None, *range(9)]), rng.randint(0, 9)) for i in range(600)] + [(900, None, "d", "m", 1, 1, 1), (901, "alone", "d", "m", 1, 1, 1)]
    df = spark.createDataFrame(data, "id bigint, k string, document_id string, metric string, a int, b int, c int")
    trust = {"reading": "a", "place": "b", "match": "c"}
    mixed = 0
    for part in (4096, 3):
        got = {r.k: r for r in choose_bundles(df, ["k"], trust, part=part).collect()}
        want = groups_of(data)
        assert set(got) == set(want)
        for k, rows in want.items():
            candidates = {b: [(r[4 + j] or 0, r[0], {"document_id": r[2], "metric": r[3]}) for r in rows] for j, b in enumerate(trust)}
            best = tried(candidates, FACT_BUNDLES.same)
            single = max((sum(x or 0 for x in r[4:]), -r[0]) for r in rows)
            chosen = [got[k].sources[b] for b in trust]
            assert tuple(-i for i in chosen) == (best[1] if best[0] > single[0] else (single[1],) * 3)
            assert got[k].group_id == min(r[0] for r in rows) and got[k].id in chosen
            mixed += len(set(chosen)) > 1
    assert mixed > 60
    assert choose_bundles(df.limit(0), ["k"], trust).count() == 0


def test_fused_record_takes_whole_bundles_of_the_more_complete_record(spark):
    fields = sorted({f for b in FACT_BUNDLES.bundles.values() for f in b} - {"table_score", "similar_score"})
    full = {f: f"{f}1" for f in fields} | {"document_id": "d", "metric": "m"}
    poor = {**full, "page_no": None, "position": "", "table_area": None, "value": "v2", "label": "l2", "new_metric": "n2"}
    rows = [(1, "k", *[{**full, "value": None, "raw_value": None}[f] for f in fields], 0.2, 0.9), (2, "k", *[poor[f] for f in fields], 0.3, 0.95)]
    df = spark.createDataFrame(rows, f"id bigint, k string, {', '.join(f'{f} string' for f in fields)}, table_score double, similar_score double")
    uploads = spark.createDataFrame([("d", 10**15)], "document_id string, uploaded bigint")
    picked = choose_bundles(fact_trust(df, uploads), ["k"], {b: f"trust_{b}" for b in FACT_BUNDLES.bundles})
    row = fuse(df, picked).collect()[0]
    assert (row.group_id, row.id, row.value, row.label, row.page_no, row.position, row.table_score) == (1, 2, "v2", "l2", "page_no1", "position1", 0.2)


def test_hot_group(spark):
    df = spark.range(20000).selectExpr("id", "'hot' AS k", "CAST(id % 7 AS INT) AS f", "CAST(id % 11 AS DOUBLE) AS s", "CAST(1 AS DOUBLE) AS t", "concat('d', id % 500) AS document_id", "'m' AS metric")
    assert [(r.group_id, r.id) for r in choose_survivors(df, ["k"], CRITERIA).collect()] == [(0, 76)]
    assert [(r.group_id, r.sources) for r in choose_bundles(df, ["k"], {"reading": "f", "place": "s", "match": "t"}, part=100).collect()] == [(0, {"reading": 76, "place": 76, "match": 76})]


def test_most_leads_survive_ties_for_each_criterion(spark):
    columns = "id bigint, k string, f int, s double, t double, u double"
    of = {"reading": ("f",), "place": ("s",), "match": ("t", "u")}
    data = [(1, "a", 10, 1.0, 0.5, 0.5), (2, "a", 10, 0.5, 1.0, 0.5), (3, "a", 10, 0.5, 0.5, 1.0), (4, "a", 9, 1.0, 1.0, 1.0)]
    assert [(r.group_id, r.id) for r in choose_survivors(spark.createDataFrame(data, columns), ["k"], of).collect()] == [(1, 4)]
    rng = random.Random(8)
    data = [(i, str(i % 400), *(rng.choice([None, 1, 2, 3]) for _ in range(4))) for i in range(3200)]
    df = spark.createDataFrame([(*r[:3], *(x if x is None else float(x) for x in r[3:6])) for r in data], columns)
    want = {}
    for k in {r[1] for r in data}:
        group = [(r[0], [-1 if x is None else x for x in r[2:6]]) for r in data if r[1] == k]
        most = [max(c[j] for _, c in group) for j in range(4)]
        want[k] = max(group, key=lambda r: (sum(a == b for a, b in zip(r[1], most, strict=True)), r[1], -r[0]))[0]
    assert {r.k: r.id for r in choose_survivors(df, ["k"], of).collect()} == want


def test_rules_name_shared_fields():
    assert Bundles({"a": (), "b": ()}, (("a", "b", "x"),)).shared("b") == ("x",) and FACT_BUNDLES.shared("reading") == ("document_id", "metric")
