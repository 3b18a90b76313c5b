import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantafold.functions import boxes as B
from quantafold.operators import detection as D


def test_overlap_matrix(spark):
    a = (0, 0, 1, 1)
    others = [(0, 0, 1, 1), (0, 0, 0.5, 1), (0, 0, 1, 0.5), (0, 0, 0.5, 0.5), (0.5, 0.5, 1, 1), (0.5, 0.5, 1.5, 1.5)]
    df = spark.createDataFrame([(i, *map(float, (*a, *o))) for i, o in enumerate(others)], "i int, a double, b double, c double, d double, e double, f double, g double, h double")
    got = df.select(B.iou(B.box("a", "b", "c", "d"), B.box("e", "f", "g", "h")).alias("iou"), B.covered(B.box("e", "f", "g", "h"), B.box("a", "b", "c", "d")).alias("ioa"), "i").orderBy("i").collect()
    assert [r.iou for r in got] == pytest.approx([1, 0.5, 0.5, 0.25, 0.25, 0.25 / 1.75]) and [r.ioa for r in got] == pytest.approx([1, 1, 1, 1, 1, 0.25])


def test_conversions(spark):
    row = spark.range(1).select(
        B.to_xywh(B.box(5.0, 5.0, 10.0, 10.0)).alias("w"), B.rotated_hull(F.lit(50.0), F.lit(50.0), F.lit(30.0), F.lit(20.0), F.lit(0.0)).alias("r"), B.area(B.box(3.0, 3.0, 1.0, 9.0)).alias("none"),
        B.decode_delta(B.box(0.0, 0.0, 2.0, 4.0), B.encode_delta(B.box(0.0, 0.0, 2.0, 4.0), B.box(1.0, 1.0, 9.0, 3.0))).alias("back"), B.polygon_area(F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0)))).alias("p"),
        B.normalise(B.box(-5.0, 10.0, 5000.0, 20.0), 100, 100).alias("n"), B.point_distance(F.lit(0.0), F.lit(0.0), B.box(3.0, 4.0, 5.0, 6.0)).alias("d")).collect()[0]
    assert tuple(row.w) == (5, 5, 5, 5) and tuple(row.r) == pytest.approx((35, 40, 65, 60)) and row.none == 0 and tuple(row.back) == pytest.approx((1, 1, 9, 3)) and row.p == 12 and tuple(row.n) == (0, 100, 1000, 200) and row.d == 5


SCHEMA = "page int, obj_id int, box struct<x0: double, y0: double, x1: double, y1: double>, score double, label string"


def test_suppression(spark):
    data = [(1, 1, (0.0, 0.0, 10.0, 10.0), 0.9, "a"), (1, 2, (1.0, 0.0, 10.0, 10.0), 0.8, "a"), (1, 3, (20.0, 0.0, 30.0, 10.0), 0.7, "a"), (2, 1, (1.0, 0.0, 10.0, 10.0), 0.8, "a")]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted((r.page, r.obj_id) for r in D.suppress(df, ["page"]).collect()) == [(1, 1), (1, 3), (2, 1)]
    assert D.suppress(df.limit(0), ["page"]).count() == 0


def test_assignment_is_optimal():
    rng = random.Random(2)
    for n, m in [(1, 1), (2, 3), (3, 2), (4, 4)] * 10:
        costs = np.array([[rng.random() for _ in range(m)] for _ in range(n)])
        small, large = min(n, m), max(n, m)
        best = min(sum(costs[i, p[i]] if n <= m else costs[p[i], i] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert sum(costs[i, j] for i, j in D.assign(costs)) == pytest.approx(best)


def test_alignment_and_grids():
    same = lambda x, y: float(x == y)
    assert D.align(list("abcd"), list("acd"), same) == ([(0, 0), (2, 1), (3, 2)], 3.0)
    grid = [["a", "b"], ["c", "d"]]
    assert D.grid_similarity(grid, grid, same) == 1.0 and D.grid_similarity(grid, [["a", "b"]], same) == pytest.approx(2 * 2 / 6) and D.grid_similarity([], [], same) == 1.0


def test_table_similarity(spark):
    rows = [("t", s, r, c, x) for s in ("truth", "predicted") for r, line in enumerate([["NOx", "1.57"], ["SOx", "59.36"]]) for c, x in enumerate(line)]
    assert D.table_similarity(spark.createDataFrame(rows, "table_id string, side string, row int, col int, text string")).collect()[0].similarity == 1.0


def test_spans_are_cut_back():
    spans = pd.DataFrame([(0, 1, 0, 2, 0.9), (1, 2, 1, 1, 0.5), (0, 0, 0, 0, 0.1)], columns=["r0", "r1", "c0", "c1", "score"])
    assert list(D.shrink_overlaps(spans)) == [(0, 1, 0, 2), (2, 2, 1, 1)]


def test_scores(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "t string, p string")
    s = D.segmentation_scores(rows, "t", "p").collect()[0]
    assert (s.miou, s.pacc, s.macc) == pytest.approx(((0.5 + 2 / 3) / 2, 0.75, 0.75))
    r = D.precision_recall(rows.select("p"), rows.select(F.col("t").alias("p")), ["p"]).collect()[0]
    assert (r.tp, r.fp, r.fn) == (3, 1, 1)
    assert [x.recall for x in D.recall_at(spark.createDataFrame([(0.6,), (0.8,)], "overlap double"), 4, [0.5, 0.7, 0.9]).orderBy("threshold").collect()] == [0.5, 0.25, 0.0]
