import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantafold.functions.boxes import box
from quantafold.functions.clauses import longest_matches
from quantafold.operators import detection as D
from quantafold.operators import layout as L
from quantafold.operators import relational as R
from quantafold.operators import tables as G
from quantafold.operators.vectors import block_matches, cosine, hashed_grams, word_vectors


def boxes(spark, rows):
    """rows: page, obj_id, x0, y0, x1, y1, score, label"""
    rows = [(*r[:2], *map(float, r[2:7]), r[7]) for r in rows]
    df = spark.createDataFrame(rows, "page int, obj_id int, x0 double, y0 double, x1 double, y1 double, score double, label string")
    return df.withColumn("box", box("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


def test_turned_boxes():
    square = (0.0, 0.0, 10.0, 10.0)
    assert G.turned_iou((*square, 0.0), (*square, 90.0)) == pytest.approx(1.0)
    assert G.turned_iou((*square, 0.0), (*square, 45.0)) == pytest.approx(math.sqrt(0.5))
    assert G.turned_iou((*square, 0.0), (20.0, 0.0, 30.0, 10.0, 30.0)) == 0.0 and G.turned_iou((*square, 0.0), (5.0, 5.0, 5.0, 5.0, 0.0)) == 0.0
    assert G.turned_iou((*square, 0.0), (5.0, 0.0, 15.0, 10.0, 0.0)) == pytest.approx(1 / 3)


def test_rings():
    square = [("v", 0, 0, 2), ("v", 3, 0, 2), ("h", 0, 0, 3), ("h", 2, 0, 3)]
    hole = [("v", 10, 10, 12), ("v", 13, 10, 12), ("h", 10, 10, 13), ("h", 12, 10, 13)]
    rings = G.trace_rings(square + hole)
    assert rings == [[(0, 0), (0, 2), (3, 2), (3, 0)], [(10, 10), (10, 12), (13, 12), (13, 10)]]


def test_outline_of_overlapping_rectangles(spark):
    corners = spark.createDataFrame([(0, 0), (0, 2), (2, 0), (2, 1), (3, 1), (3, 2)], "x int, y int")
    edges = [tuple(r) for r in G.outline_edges(corners).collect()]
    assert G.trace_rings(edges) == [[(0, 0), (0, 2), (3, 2), (3, 1), (2, 1), (2, 0)]]
    assert G.outline_edges(corners.limit(0)).count() == 0


def test_labels_in_two_passes(spark):
    schema = "page int, id int, text string, label string"
    truth = spark.createDataFrame([(1, 1, "a", "A1"), (1, 2, "a", "A2"), (1, 3, "long name here", "L"), (2, 4, "x", "X")], schema)
    tokens = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (1, 4, "name"), (2, 5, "xx"), (2, 6, None), (3, 7, "")], "page int, id int, text string")
    got = {r.id: r.label for r in L.transfer_labels_twice(tokens, truth, ["page"], "text", "id", "label").collect()}
    # the third `a` is part of the long name, which is still free
    assert got == {1: "A1", 2: "A2", 3: "L", 4: "L", 5: "X", 6: None, 7: None}


def test_longest_matches_like_the_plain_form(spark):
    rng = random.Random(1)
    rows = [(g, a, a + rng.randint(0, 9)) for g in range(20) for a in (rng.randint(0, 30) for _ in range(12))]
    got = {}
    for r in L.longest(spark.createDataFrame(rows, "g int, a int, b int"), ["g"], "a", "b").collect():
        got.setdefault(r.g, set()).add((r.a, r.b))
    for g in range(20):
        assert got[g] == {(a, b) for _, a, b in longest_matches([("", a, b) for h, a, b in rows if h == g])}


def test_positions_like_a_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 20), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    want = {r.id: (r.n, r.r) for r in df.withColumn("n", F.row_number().over(w)).withColumn("r", F.rank().over(Window.partitionBy("k").orderBy(F.desc("v")))).collect()}
    numbered = {r.id: r.n for r in R.positions(df, ["k"], [F.desc("v"), "id"], "n").collect()}
    ranked = {r.id: r.n for r in R.positions(df, ["k"], [F.desc("v")], "n", ties=True).collect()}
    assert {i: (numbered[i], ranked[i]) for i in numbered} == want
    assert R.positions(df.limit(0), ["k"], ["id"], "n").count() == 0
    least = {(r.k, r.v) for r in R.least_k(df, ["k"], "v", 2, ["id"]).collect()}
    assert all(sum(1 for k, _ in least if k == x) <= 2 for x in ("hot", "b", None))


def test_first_seen_with_nulls_and_copies(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "")], "id int, v string")
    assert {r.id: r.first_seen for r in R.first_seen(df, "v", "id").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_block_matches_like_trying_all(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3) for i in range(90)] + [(90, None, 0), (91, [0.0] * 4, 1), (92, [1.0] * 4, 2), (93, [1.0] * 4, 2)]
    df = spark.createDataFrame(rows, "id int, v array<double>, g int")

    def like(a, b):
        a, b = np.array(a), np.array(b)
        return round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 5)

    usable = [(i, v, g) for i, v, g in rows if v is not None and any(v)]
    got = {r.id: (r.other, r.likeness) for r in block_matches(df.filter("id % 5 = 0"), df, "id", "v", block=16).collect()}
    for i, v, _ in usable:
        if i % 5 == 0:
            best = max(((like(v, w), -o) for o, w, _ in usable if o != i))
            assert got[i] == (-best[1], pytest.approx(best[0]))
    assert set(got) == {i for i, _, _ in usable if i % 5 == 0}
    grouped = block_matches(df.filter("id % 5 = 0"), df, "id", "v", k=2, group="g", block=16).groupBy("id", "g").count().collect()
    assert all(r["count"] == 2 for r in grouped)
    assert block_matches(df.limit(0), df, "id", "v").count() == 0


def test_hashed_grams_count_what_they_hash(spark):
    df = spark.createDataFrame([("abcabc",), ("",), (None,), ("x" * 3000,)], "t string")
    sums = [sum(r.v) for r in df.select(hashed_grams("t").alias("v")).collect()]
    assert sums == [6, 0, 0, 3000]


def test_average_precision_like_the_plain_form(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), rng.randint(0, 30) / 10, i, rng.randint(0, 1)) for i in range(800)]
    df = spark.createDataFrame(rows, "c string, s double, id int, hit int")
    got = {r.c: (r.ap, r.ap11) for r in D.average_precision(df, "c", "s", "hit", ["id"], df.groupBy("c").agg(F.sum("hit").alias("n"))).collect()}
    for c in "ab":
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2]))
        n = sum(r[3] for r in mine)
        tp, curve = 0, []
        for k, r in enumerate(mine, 1):
            tp += r[3]
            curve.append((tp, tp / k, r[3]))
        best = list(itertools.accumulate(reversed([p for _, p, _ in curve]), max))[::-1]
        assert got[c][0] == pytest.approx(sum(b * h / n for b, (_, _, h) in zip(best, curve, strict=True)))
        assert got[c][1] == pytest.approx(sum(max((p for t, p, _ in curve if t * 10 >= k * n), default=0.0) for k in range(11)) / 11)


def test_greedy_matches_and_recall(spark):
    truth = boxes(spark, [(1, 1, 0, 0, 10, 10, 1, "a"), (1, 2, 100, 0, 110, 10, 1, "a"), (2, 1, 0, 0, 200, 200, 1, "a")])
    found = boxes(spark, [(1, 1, 0, 0, 10, 10, 0.9, "a"), (1, 2, 0, 0, 10, 9, 0.8, "a"), (2, 1, 0, 0, 200, 100, 0.9, "a")])
    matched = D.greedy_matches(found, truth, "page")
    assert sorted(map(tuple, matched.collect())) == [(1, 1, 1.0), (2, 1, 0.5)]
    recall = {(r.size, r.threshold): r.recall for r in D.recall_by_size(matched, truth, "page", [0.5, 0.75], {"small": (0.0, 1000.0), "large": (1000.0, 1e9)}).collect()}
    assert recall == {("small", 0.5): 0.5, ("small", 0.75): 0.5, ("large", 0.5): 1.0, ("large", 0.75): 0.0}


def test_shared_words_and_panoptic(spark):
    areas = boxes(spark, [(1, 1, 0, 0, 100, 10, 0.9, "a"), (1, 2, 50, 0, 150, 10, 0.8, "a"), (1, 3, 300, 0, 310, 10, 0.7, "a")])
    words = boxes(spark, [(1, 7, 60, 0, 70, 10, 1, "a"), (1, 8, 120, 0, 130, 10, 1, "a")])
    assert sorted(r.obj_id for r in D.suppress_by_words(areas, words, ["page"]).collect()) == [1, 3]
    quality = {r.label: (r.pq, r.rq) for r in D.panoptic_quality(areas.filter("obj_id < 3"), areas.filter("obj_id IN (1, 3)"), ["page"], "label").collect()}
    assert quality == {"a": (0.5, 0.5)}


def test_table_operators_on_small_and_empty_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, "Name"), (1, 0, 1, "2020"), (1, 1, 0, "Waste N"), (1, 1, 1, "5"), (2, 0, 0, "2019"), (2, 0, 1, "2020")], "table_id int, row_ int, col_ int, text string")
    assert [tuple(r) for r in G.flat_map(cells).collect()] == [(1, 1, "Waste N", "5")]
    assert [tuple(r) for r in G.lookup(cells, "waste", 1).collect()] == [(1, "5")]
    assert {(r.table_id, r.row_): r.part for r in G.split_at_years(cells).collect()} == {(1, 0): 0, (1, 1): 0, (2, 0): 1}
    assert sorted(map(tuple, G.transpose(cells.filter("table_id = 1")).collect())) == [(1, 0, 0, "Name"), (1, 0, 1, "Waste N"), (1, 1, 0, "2020"), (1, 1, 1, "5")]
    for made in (G.orient(cells.limit(0), F.lit(True)), G.flat_map(cells.limit(0)), G.with_headers(cells.limit(0), 1), G.neighbours(cells.limit(0)), G.projected_headers(cells.limit(0))):
        assert made.count() == 0


def test_recognised_table(spark):
    parts = boxes(spark, [(1, 1, 0, 0, 100, 10, 0.9, "row"), (1, 2, 0, 10, 100, 20, 0.8, "row"), (1, 3, 0, 0, 50, 20, 0.7, "col"), (1, 4, 50, 0, 100, 20, 0.6, "col"), (1, 5, 0, 0, 100, 10, 0.9, "span"), (1, 6, 0, 0, 100, 10, 0.1, "row")]).withColumnRenamed("page", "table_id")
    got = sorted((r.rows, r.columns, r.confidence) for r in G.recognise(parts, {"row": "row", "col": "column", "span": "span"}, 0.5).collect())
    assert got == [([1], [3, 4], pytest.approx(0.8)), ([2], [3], pytest.approx(0.8)), ([2], [4], pytest.approx(0.8))]


def test_likeness_of_tables_by_place(spark):
    rows = [(1, side, r, c, "x", [0.0, 0.0, 1.0, 1.0], [c * 10.0, r * 10.0, c * 10.0 + (10.0 if side == "truth" else 5.0), r * 10.0 + 10.0]) for side in ("truth", "predicted") for r in range(2) for c in range(2)]
    df = spark.createDataFrame(rows, "table_id int, side string, row int, col int, text string, span array<double>, box array<double>")
    assert [D.table_similarity(df, kind).collect()[0].similarity for kind in ("content", "topology", "location")] == [1.0, 1.0, 0.5]


def test_enriching_fails_on_a_missing_record(spark):
    rows, records = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert R.enrich(rows.filter("k = 1"), records, ["k"]).collect()[0].v == "a"
    with pytest.raises(Exception, match="no record for 2"):
        R.enrich(rows, records, ["k"]).collect()


def test_trained_word_vectors(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["waste water", "Waste, water!", "energy power"] * 10 + ["unknownword", "", None])], "id int, t string")
    made = {r.id: r for r in word_vectors(df, "t", dimensions=8).withColumn("own", cosine("vector", "vector")).collect()}
    assert len(made) == 33 and made[0].vector == made[1].vector != made[2].vector and all(made[i].vector == [0.0] * 8 for i in (30, 31, 32)) and made[0].own == pytest.approx(1.0)
