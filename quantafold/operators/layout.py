"""Operators on words, blocks and cells of pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import boxes as B
from ..functions.clauses import parse_clauses
from .vectors import dot


def words_in_boxes(words: DataFrame, areas: DataFrame, page: list[str]) -> DataFrame:
    """`text` of the words that lie wholly within each area, in reading order; areas without words have ''.

    *words*: *page*, pos, box, word; *areas*: *page*, obj_id, box.
    """
    w = words.select(*page, "pos", F.col("box").alias("w"), "word")
    inside = (F.col("w.x0") >= F.col("box.x0")) & (F.col("w.y0") >= F.col("box.y0")) & (F.col("w.x1") <= F.col("box.x1")) & (F.col("w.y1") <= F.col("box.y1"))
    met = areas.join(w, page).filter(inside).groupBy(*page, "obj_id").agg(F.array_sort(F.collect_list(F.struct("w.y0", "w.x0", "pos", "word"))).alias("ws"))
    made = areas.select(*page, "obj_id").join(met, [*page, "obj_id"], "left")
    return made.select(*page, "obj_id", F.coalesce(F.array_join(F.transform("ws", lambda x: x["word"]), " "), F.lit("")).alias("text"))


def transfer_labels(tokens: DataFrame, truth: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """*tokens* with *label* of the truth of the same keys, one to one: the n-th of equal tokens takes the n-th truth."""
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return number(tokens).join(number(truth).select(*keys, "_n", label), [*keys, "_n"], "left").drop("_n")


def segment_blocks(items: DataFrame, document: str, order: str, tag: str, follows: dict[str, list[str]], page: str | None = None, across: list[str] | None = None) -> DataFrame:
    """Numbers blocks: an item goes on with the block of the one before it if its tag may follow that one's tag and, with *page*, if it stands
    on the same page or its tag is one of *across*, which go on over a page's end."""
    w = Window.partitionBy(document).orderBy(order)
    before = F.lag(tag).over(w)
    goes_on = F.lit(False)
    for first, nexts in follows.items():
        goes_on = goes_on | ((before == first) & F.col(tag).isin(nexts))
    goes_on = F.coalesce(goes_on, F.lit(False))
    if page:
        goes_on = goes_on & (F.col(page).eqNullSafe(F.lag(page).over(w)) | F.coalesce(F.col(tag).isin(across or []), F.lit(False)))
    marked = items.withColumn("_new", F.when(goes_on, 0).otherwise(1))
    return marked.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def grid_cells(rows: DataFrame, columns: DataFrame, spans: DataFrame, table: str, least: float = 0.5) -> DataFrame:
    """Cells of recognised tables: each row meets each column of its table; cells of which *least* lies in a spanning
    cell are merged into it (the one that covers most; ties: smallest id). Gives rows and columns as sorted arrays and the hull.
    """
    r = rows.select(table, F.col("obj_id").alias("row_id"), F.col("box").alias("r"))
    c = columns.select(table, F.col("obj_id").alias("col_id"), F.col("box").alias("c"))
    cells = r.join(c, table).withColumn("cell", B.intersection("r", "c"))
    s = spans.select(table, F.col("obj_id").alias("span_id"), F.col("box").alias("s"))
    over = cells.join(s, table).withColumn("part", B.covered("cell", "s")).filter(F.col("part") >= least)
    best = over.groupBy(table, "row_id", "col_id").agg(F.max(F.struct("part", (-F.col("span_id")).alias("n"))).alias("m")).select(table, "row_id", "col_id", (-F.col("m.n")).alias("span_id"))
    owned = cells.join(best, [table, "row_id", "col_id"], "left")
    own = F.when(F.col("span_id").isNull(), F.struct("row_id", "col_id"))
    hull = B.box(F.min("cell.x0"), F.min("cell.y0"), F.max("cell.x1"), F.max("cell.y1"))
    return owned.groupBy(table, "span_id", own.alias("_own")).agg(F.array_sort(F.collect_set("row_id")).alias("rows"), F.array_sort(F.collect_set("col_id")).alias("columns"), hull.alias("box")).select(table, "span_id", "rows", "columns", "box")


def clauses(texts: DataFrame, key: str, text: str) -> DataFrame:
    """*key*, `pos`, `label`, `clause`, `level` of the numbered clauses of each text."""

    @F.pandas_udf("array<struct<label: string, clause: string, level: int>>")
    def parse(column: pd.Series) -> pd.Series:
        return column.map(parse_clauses)

    made = texts.select(key, F.posexplode(parse(text)).alias("pos", "c"))
    return made.select(key, "pos", "c.label", "c.clause", "c.level")


def transfer_labels_twice(tokens: DataFrame, truth: DataFrame, page: list[str], text: str, order: str, label: str) -> DataFrame:
    """*tokens* with *label*: first of the truth of the same page and text, one to one; tokens left over take the first truth left over of
    the page whose text holds theirs or is held by it. Only tokens and truths of one page meet."""
    exact = transfer_labels(tokens, truth.withColumn("_found", F.lit(True)), [*page, text], order, "_found").drop("_found")
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*page, text).orderBy(order)))
    t, g = number(tokens), number(truth)
    first = t.join(g.select(*page, text, "_n", F.col(label).alias("_label"), F.lit(True).alias("_met")), [*page, text, "_n"], "left")
    rest = first.filter("_met IS NULL").select(*page, order, F.col(text).alias("_a"))
    unused = g.join(t.select(*page, text, "_n"), [*page, text, "_n"], "left_anti").select(*page, F.col(text).alias("_b"), F.col(order).alias("_o"), F.col(label).alias("_second"))
    either = (F.contains("_a", "_b") | F.contains("_b", "_a")) & (F.col("_a") != "") & (F.col("_b") != "")
    second = rest.join(unused, page).filter(either).groupBy(*page, order).agg(F.min_by("_second", "_o").alias("_second"))
    return exact.join(first.select(*page, order, "_label"), [*page, order]).join(second, [*page, order], "left").withColumn(label, F.coalesce("_label", "_second")).drop("_label", "_second")


def covered_rows(spans: DataFrame, rows: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """*page*, obj_id and `rows_`, the ids of the rows of which a spanning cell covers at least *least* of the height, in order."""
    r = rows.select(*page, F.col("obj_id").alias("_row"), F.col("box").alias("r"))
    share = (F.least("r.y1", "box.y1") - F.greatest("r.y0", "box.y0")) / (F.col("r.y1") - F.col("r.y0"))
    met = spans.select(*page, "obj_id", "box").join(r, page).filter(share >= least).groupBy(*page, "obj_id").agg(F.array_sort(F.collect_list("_row")).alias("rows_"))
    return spans.select(*page, "obj_id").join(met, [*page, "obj_id"], "left").withColumn("rows_", F.coalesce("rows_", F.array().cast(met.schema["rows_"].dataType)))


def drop_empty(areas: DataFrame, words: DataFrame, page: list[str]) -> DataFrame:
    """The areas in which the middle of some word lies."""
    w = words.select(*page, ((F.col("box.x0") + F.col("box.x1")) / 2).alias("_x"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("_y"))
    held = areas.select(*page, "obj_id", "box").join(w, page).filter(F.col("_x").between(F.col("box.x0"), F.col("box.x1")) & F.col("_y").between(F.col("box.y0"), F.col("box.y1"))).select(*page, "obj_id").distinct()
    return areas.join(held, [*page, "obj_id"], "left_semi")


def hulls(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """*keys*, `hull` and `n`: the box around all boxes of a group, by partial minima and maxima."""
    return boxes.groupBy(*keys).agg(B.box(F.min("box.x0"), F.min("box.y0"), F.max("box.x1"), F.max("box.y1")).alias("hull"), F.count("*").alias("n"))


def tag_superscripts(words: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """*words* with the marks of their line that touch them, in order of obj_id, tagged behind `word`."""
    m = marks.select(*keys, F.col("obj_id").alias("_m"), F.col("box").alias("_b"), "mark")
    met = words.select(*keys, "obj_id", "box").join(m, keys).filter(B.touches("box", "_b")).groupBy(*keys, "obj_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_m", "mark"))), lambda x: x["mark"]), "").alias("_marks"))
    made = words.join(met, [*keys, "obj_id"], "left")
    return made.withColumn("word", F.when(F.col("_marks").isNotNull(), F.concat("word", F.lit("<s>"), "_marks", F.lit("</s>"))).otherwise(F.col("word"))).drop("_marks")


def nearest_by_cosine(boxes: DataFrame, page: list[str]) -> DataFrame:
    """*page*, obj_id and `nearest`: the box of the page whose coordinates are nearest by cosine (seven digits), ties by the smallest id."""
    vector = F.array("box.x0", "box.y0", "box.x1", "box.y1")
    a, b = boxes.select(*page, "obj_id", vector.alias("_a")), boxes.select(*page, F.col("obj_id").alias("_o"), vector.alias("_b"))
    pairs = a.join(b, page).filter("obj_id <> _o")
    likes = F.round(F.try_divide(dot("_a", "_b"), F.sqrt(dot("_a", "_a") * dot("_b", "_b"))), 7)
    return pairs.groupBy(*page, "obj_id").agg(F.max_by("_o", F.struct(likes.alias("l"), (-F.col("_o")).alias("n"))).alias("nearest"))


def hull_of_words(areas: DataFrame, words: DataFrame, page: list[str], least: float, margin: float) -> DataFrame:
    """*page*, obj_id and `box`: the hull, widened by *margin*, of the words of which at least *least* lies in the area; areas without words are left out."""
    w = words.select(*page, F.col("box").alias("w"))
    held = areas.select(*page, "obj_id", F.col("box").alias("a")).join(w, page).filter(B.covered("w", "a") >= least)
    m = F.lit(float(margin))
    return held.groupBy(*page, "obj_id").agg(B.box(F.min("w.x0") - m, F.min("w.y0") - m, F.max("w.x1") + m, F.max("w.y1") + m).alias("box"))


def longest(matches: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """The matches that lie within no longer one of their group: in order of their beginning, the longest first, those that reach beyond
    all before them, and repeats of those."""
    before = Window.partitionBy(*keys).orderBy(F.col(first), F.desc(last)).rowsBetween(Window.unboundedPreceding, -1)
    marked = matches.withColumn("_reach", F.max(last).over(before)).withColumn("_from", F.max_by(F.col(first), F.struct(last, (-F.col(first)).alias("_f"))).over(before))
    repeat = (F.col("_reach") == F.col(last)) & (F.col("_from") == F.col(first))
    return marked.filter(F.col("_reach").isNull() | (F.col(last) > F.col("_reach")) | repeat).drop("_reach", "_from")


def rank_styles(sizes: DataFrame, page: list[str], size: str) -> DataFrame:
    """*page*, *size*, `n`, `kind` and `rank` of the sizes of letters: the commonest (ties: the smaller) is a paragraph's, larger ones head,
    smaller ones annotate; the largest has rank 1."""
    used = sizes.groupBy(*page, size).agg(F.count("*").alias("n"))
    body = used.groupBy(*page).agg(F.max_by(size, F.struct("n", (-F.col(size)).alias("s"))).alias("_body"))
    kind = F.when(F.col(size) > F.col("_body"), "heading").when(F.col(size) < F.col("_body"), "note").otherwise("paragraph")
    return used.join(body, page).select(*page, size, "n", kind.alias("kind"), F.dense_rank().over(Window.partitionBy(*page).orderBy(F.desc(size))).alias("rank"))


def neighbourhood_mode(items: DataFrame, document: list[str], order: str, tag: str, reach: int, without: list[str]) -> DataFrame:
    """*order* and `tag`: the commonest tag (ties: the larger) of the *reach* items before and behind, those of *without* and missing ones left out;
    items without such neighbours are left out. By lags and leads: no item meets another."""
    w = Window.partitionBy(*document).orderBy(order)
    near = F.array(*[f(F.col(tag), k).over(w) for k in range(1, reach + 1) for f in (F.lag, F.lead)])
    good = items.select(order, near.alias("_near")).select(order, F.explode("_near").alias("tag")).filter(F.col("tag").isNotNull() & (F.col("tag") != "") & ~F.col("tag").isin(without))
    return good.groupBy(order, "tag").agg(F.count("*").alias("_n")).groupBy(order).agg(F.max_by("tag", F.struct("_n", "tag")).alias("tag"))


def parents(items: DataFrame, document: str, order: str, level: str, levels: int) -> DataFrame:
    """*order* and `parent`: the last item before of a higher level (a smaller number); null where there's none."""
    before = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    made = items
    for k in range(2, levels + 1):
        made = made.withColumn(f"_p{k}", F.max(F.when(F.col(level) < k, F.col(order))).over(before))
    parent = F.lit(None)
    for k in range(2, levels + 1):
        parent = F.when(F.col(level) == k, F.col(f"_p{k}")).otherwise(parent)
    return made.select(order, parent.alias("parent"))


def explode_relations(nested: DataFrame, key: str, sentences: str) -> DataFrame:
    """*key*, `sentence`, `relation` (places, from 0) and `r`, each relation of an array of arrays."""
    one = nested.select(key, F.posexplode(sentences).alias("sentence", "_s"))
    return one.select(key, "sentence", F.posexplode("_s").alias("relation", "r"))


def flatten(df: DataFrame) -> DataFrame:
    """Fields of structs at any depth as columns, their names joined by underscores."""
    def fields(schema: StructType, path: str, name: str) -> list:
        made = []
        for f in schema.fields:
            at, called = f"{path}`{f.name}`", f"{name}{f.name}"
            made += fields(f.dataType, f"{at}.", f"{called}_") if isinstance(f.dataType, StructType) else [F.col(at).alias(called)]
        return made

    return df.select(*fields(df.schema, "", ""))


def unpivot_years(wide: DataFrame, metric: str, file_year: int) -> DataFrame:
    """*metric*, `yr`, `value` of a wide table: the year of a column's name; columns that name an amount and no year have the file's year; others are left out."""
    columns = [c for c in wide.columns if c != metric and (re.search(r"20\d\d|19\d\d", c) or re.search(r"(?i)emission|amount|data|value", c))]
    long = wide.unpivot([metric], columns, "_name", "value")
    return long.select(metric, F.coalesce(F.regexp_extract("_name", r"((?:19|20)\d\d)", 1).try_cast("int"), F.lit(file_year)).alias("yr"), "value")
