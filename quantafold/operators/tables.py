"""Operators on the cells of recognised tables: *cells* have table_id, row_, col_ and text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import grid_cells

YEAR = "^(?:19|20)[0-9]{2}$"


def transpose(cells: DataFrame) -> DataFrame:
    """Rows and columns exchanged."""
    return cells.withColumns({"row_": F.col("col_"), "col_": F.col("row_")})


def orient(cells: DataFrame, is_metric: Column, share: float = 0.5) -> DataFrame:
    """Tables whose first row holds metrics by at least *share* are transposed, so that metrics stand in the first column.

    Tables without a first row stay. One aggregate per table, joined back."""
    turned = cells.filter("row_ = 0").groupBy("table_id").agg((F.avg(F.coalesce(is_metric, F.lit(False)).cast("int")) >= share).alias("_turn"))
    turn = F.coalesce("_turn", F.lit(False))
    made = cells.join(turned, "table_id", "left")
    return made.select("table_id", F.when(turn, F.col("col_")).otherwise(F.col("row_")).alias("row_"), F.when(turn, F.col("row_")).otherwise(F.col("col_")).alias("col_"), "text")


def split_at_years(cells: DataFrame, least: int = 2) -> DataFrame:
    """table_id, row_ and `part`: a row with at least *least* years begins the next part of its table, from 0 before the first."""
    rows = cells.groupBy("table_id", "row_").agg((F.count_if(F.col("text").rlike(YEAR)) >= least).cast("int").alias("_new"))
    return rows.select("table_id", "row_", F.sum("_new").over(Window.partitionBy("table_id").orderBy("row_").rowsBetween(Window.unboundedPreceding, 0)).alias("part"))


def with_headers(cells: DataFrame, header_rows: int) -> DataFrame:
    """The cells below the header with `heading`, the texts of the header rows above them that aren't empty, joined by blanks; rows are counted from 0 again."""
    texts = F.filter(F.array_sort(F.collect_list(F.struct("row_", "text"))), lambda x: x["text"] != "")
    heads = cells.filter(F.col("row_") < header_rows).groupBy("table_id", "col_").agg(F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("heading"))
    return cells.filter(F.col("row_") >= header_rows).join(heads, ["table_id", "col_"]).withColumn("row_", F.col("row_") - header_rows)


def flat_map(cells: DataFrame) -> DataFrame:
    """table_id, row_, `name`, `value`: of tables of two columns label and value, of wider ones `label-column` and value; the first row holds the columns' names."""
    labels = cells.filter("col_ = 0 AND row_ > 0").select("table_id", "row_", F.col("text").alias("_label"))
    heads = cells.filter("row_ = 0").select("table_id", "col_", F.col("text").alias("_head"))
    widths = cells.groupBy("table_id").agg(F.max("col_").alias("_last"))
    made = cells.filter("col_ > 0 AND row_ > 0").join(labels, ["table_id", "row_"]).join(heads, ["table_id", "col_"]).join(widths, "table_id")
    return made.select("table_id", "row_", F.when(F.col("_last") == 1, F.col("_label")).otherwise(F.concat_ws("-", "_label", "_head")).alias("name"), F.col("text").alias("value"))


def lookup(cells: DataFrame, name: str, column: int) -> DataFrame:
    """table_id and `value`: the text in *column* of the first row whose label holds *name*, case aside."""
    rows = cells.filter((F.col("col_") == 0) & F.contains(F.lower("text"), F.lit(name.lower()))).groupBy("table_id").agg(F.min("row_").alias("row_"))
    return rows.join(cells.filter(F.col("col_") == column), ["table_id", "row_"]).select("table_id", F.col("text").alias("value"))


def relative_grid(spans: DataFrame) -> DataFrame:
    """table_id, row_, col_ of each place and how far its cell reaches from there: `up`, `before` (0 or less), `down`, `behind` (past the end)."""
    rows = spans.withColumn("row_", F.explode(F.sequence("row0", "row1")))
    places = rows.withColumn("col_", F.explode(F.sequence("col0", "col1")))
    return places.select("table_id", "row_", "col_", (F.col("row0") - F.col("row_")).alias("up"), (F.col("col0") - F.col("col_")).alias("before"), (F.col("row1") - F.col("row_") + 1).alias("down"), (F.col("col1") - F.col("col_") + 1).alias("behind"))


def neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of cells that aren't empty next to each other along rows and columns, empty ones between them counted as `blanks`."""
    full = cells.filter("text <> ''")

    def along(way: str, fixed: str, runs: str) -> DataFrame:
        w = Window.partitionBy("table_id", fixed).orderBy(runs)
        return full.select("table_id", F.lit(way).alias("way"), "row_", "col_", F.col("text").alias("a"), F.lead("text").over(w).alias("b"), (F.lead(runs).over(w) - F.col(runs) - 1).alias("blanks"))

    return along("row", "row_", "col_").unionByName(along("column", "col_", "row_")).filter("b IS NOT NULL")


def projected_headers(cells: DataFrame, empty: float = 0.7, run: float = 0.5) -> DataFrame:
    """table_id, row_ of rows that head a section: more than *empty* of their cells are empty, or more than *run* of them in a row."""
    rows = cells.groupBy("table_id", "row_").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_", "text"))), lambda x: F.when(x["text"] == "", "1").otherwise("0")), "").alias("_blanks"), F.count("*").alias("_n"))
    many = F.char_length(F.replace("_blanks", F.lit("0"), F.lit(""))) > empty * F.col("_n")
    long = F.contains("_blanks", F.repeat(F.lit("1"), (F.floor(F.col("_n") * run) + 1).cast("int")))
    return rows.filter(many | long).select("table_id", "row_")


def outline_edges(corners: DataFrame) -> DataFrame:
    """Edges of an outline from its corners x, y: the corners of each line paired in order. `kind` 'v' or 'h', `at_`, `from_`, `to_`."""
    def along(kind: str, fixed: str, runs: str) -> DataFrame:
        w = Window.partitionBy(fixed).orderBy(runs)
        return corners.select(F.lit(kind).alias("kind"), F.col(fixed).alias("at_"), F.col(runs).alias("from_"), F.lead(runs).over(w).alias("to_"), F.row_number().over(w).alias("_k"))

    return along("v", "x", "y").unionByName(along("h", "y", "x")).filter("_k % 2 = 1 AND to_ IS NOT NULL").drop("_k")


def trace_rings(edges: list[tuple[str, int, int, int]]) -> list[list[tuple[int, int]]]:
    """The closed rings of an outline's edges (kind, at, from, to), each from its least corner, along the vertical edge first."""
    v: dict[tuple[int, int], tuple[int, int]] = {}
    h: dict[tuple[int, int], tuple[int, int]] = {}
    for kind, at, start, end in edges:
        a, b = ((at, start), (at, end)) if kind == "v" else ((start, at), (end, at))
        (v if kind == "v" else h).update({a: b, b: a})
    rings, left = [], set(v) & set(h)
    while left:
        corner = min(left)
        ring, upright = [], True
        while corner in left:
            left.discard(corner)
            ring.append(corner)
            corner = (v if upright else h).get(corner, ring[0])
            upright = not upright
        rings.append(ring)
    return rings


def mask_bounds(runs: DataFrame) -> DataFrame:
    """`mask`, its box and its number of pixels; *runs*: mask, y, x (first pixel), n (pixels). By partial minima and maxima."""
    return runs.groupBy("mask").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("n")).alias("x1"), (F.max("y") + 1).alias("y1"), F.sum("n").alias("pixels"))


def recognise(objects: DataFrame, parts: dict[str, str], least: float) -> DataFrame:
    """Labelled objects of a table to cells: objects of at least *least* score are rows, columns and spanning cells by *parts* (label -> part),
    rows and columns meet, spanning cells merge what they cover; `confidence` is the mean of the best row's and column's score."""
    good = objects.filter(F.col("score") >= least)
    of = lambda part: good.filter(F.col("label").isin([k for k, v in parts.items() if v == part])).select("table_id", "obj_id", "box", "score")
    made = grid_cells(of("row"), of("column"), of("span"), "table_id")
    best = of("row").groupBy("table_id").agg(F.max("score").alias("_r")).join(of("column").groupBy("table_id").agg(F.max("score").alias("_c")), "table_id")
    return made.join(best, "table_id").withColumn("confidence", (F.col("_r") + F.col("_c")) / 2).drop("_r", "_c")


def _corners(x0: float, y0: float, x1: float, y1: float, degrees: float) -> list[tuple[float, float]]:
    import math

    cx, cy, c, s = (x0 + x1) / 2, (y0 + y1) / 2, math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def _area(points: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], *points[:1]], strict=True)) / 2


def turned_iou(a: tuple, b: tuple) -> float:
    """Overlap of two turned boxes (x0, y0, x1, y1, degrees): one cut by each side of the other. 0 for boxes without extent."""
    p, q = _corners(*a), _corners(*b)
    whole = _area(p) + _area(q)
    for (ax, ay), (bx, by) in zip(q, [*q[1:], *q[:1]], strict=True):
        side = lambda pt, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (pt[1] - ay) - (by - ay) * (pt[0] - ax)
        cut: list[tuple[float, float]] = []
        for u, w in zip(p, [*p[1:], *p[:1]], strict=True):
            su, sw = side(u), side(w)
            if su >= 0:
                cut.append(u)
            if su * sw < 0:
                cut.append((u[0] + (w[0] - u[0]) * su / (su - sw), u[1] + (w[1] - u[1]) * su / (su - sw)))
        p = cut
        if len(p) < 3:
            return 0.0
    inter = _area(p)
    return inter / (whole - inter) if whole > inter else 0.0


def rotated_iou(a: str, b: str) -> Column:
    """turned_iou of two columns struct(box, degrees), over Arrow batches."""

    @F.pandas_udf("double")
    def overlap(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        def boxes(part: pd.DataFrame) -> Iterator[tuple]:
            return ((r["x0"], r["y0"], r["x1"], r["y1"], g) for r, g in zip(part["box"], part["degrees"], strict=True))

        return pd.Series([turned_iou(p, q) for p, q in zip(boxes(x), boxes(y), strict=True)], dtype="float64")

    return overlap(a, b)
