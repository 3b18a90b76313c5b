"""Queries of recognised tables and boxes on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import detection as D
from ..operators import layout as L
from ..operators import tables as G
from ..sources.tables import table
from .layout import AREA, BOX_SQL, INTER, IOU, detections
from .register import Register

queries = Register()

CELL_SQL = """r AS (SELECT l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS row_, l_returnflag AS f, CAST(l_quantity AS INT) AS q, l_partkey AS p, l_suppkey AS s FROM lineitem),
c AS (SELECT table_id, row_, 0 AS col_, 'Waste ' || f AS text FROM r UNION ALL SELECT table_id, row_, 1, CASE WHEN q % 4 = 0 THEN '' ELSE CAST(q AS VARCHAR) END FROM r
 UNION ALL SELECT table_id, row_, 2, CASE WHEN p % 3 = 0 THEN CAST(1990 + s % 10 AS VARCHAR) WHEN p % 3 = 1 THEN '' ELSE CAST(s AS VARCHAR) END FROM r UNION ALL SELECT table_id, row_, 3, CASE WHEN s % 2 = 0 THEN CAST(1990 + p % 10 AS VARCHAR) ELSE '' END FROM r)"""
YEAR = "^(?:19|20)[0-9]{2}$"


def cells(spark, d) -> DataFrame:
    """A table per order: a label, an amount that may be blank, and two columns that may hold years."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    q, year = F.col("l_quantity").cast("int"), lambda x: (F.lit(1990) + x % 10).cast("string")
    texts = [
        F.concat(F.lit("Waste "), "l_returnflag"), F.when(q % 4 == 0, "").otherwise(q.cast("string")),
        F.when(F.col("l_partkey") % 3 == 0, year(F.col("l_suppkey"))).when(F.col("l_partkey") % 3 == 1, "").otherwise(F.col("l_suppkey").cast("string")), F.when(F.col("l_suppkey") % 2 == 0, year(F.col("l_partkey"))).otherwise(""),
    ]
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.row_number().over(w) - 1).cast("int").alias("row_"), F.array(*texts).alias("t"))
    return rows.select("table_id", "row_", F.posexplode("t").alias("col_", "text"))


@queries("oriented_tables", f"""WITH {CELL_SQL}, t AS (SELECT table_id, avg(CASE WHEN regexp_matches(text, '^(?:Waste|19)') THEN 1 ELSE 0 END) >= 0.5 AS turn FROM c WHERE row_ = 0 GROUP BY 1)
SELECT table_id, CASE WHEN turn THEN col_ ELSE row_ END AS row_, CASE WHEN turn THEN row_ ELSE col_ END AS col_, text FROM c JOIN t USING (table_id)""")
def oriented_tables(spark, d):
    return G.orient(cells(spark, d), F.col("text").rlike("^(?:Waste|19)"))


@queries("year_row_parts", f"""WITH {CELL_SQL}, y AS (SELECT table_id, row_, count(*) FILTER (regexp_matches(text, '{YEAR}')) >= 2 AS b FROM c GROUP BY 1, 2)
SELECT table_id, row_, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_ ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM y""")
def year_row_parts(spark, d):
    return G.split_at_years(cells(spark, d))


@queries("joined_headers", f"""WITH {CELL_SQL}, h AS (SELECT table_id, col_, coalesce(string_agg(text, ' ' ORDER BY row_) FILTER (text <> ''), '') AS heading FROM c WHERE row_ < 2 GROUP BY 1, 2) SELECT c.table_id, c.row_ - 2 AS row_, h.heading, c.text FROM c JOIN h USING (table_id, col_) WHERE c.row_ >= 2""")
def joined_headers(spark, d):
    return G.with_headers(cells(spark, d), 2).select("table_id", "row_", "heading", "text")


@queries("flat_metric_map", f"""WITH {CELL_SQL}, k AS (SELECT * FROM c WHERE table_id % 2 = 0 OR col_ < 2), n AS (SELECT table_id, max(col_) AS last FROM k GROUP BY 1)
SELECT l.table_id, l.row_, CASE WHEN n.last = 1 THEN l.text ELSE l.text || '-' || h.text END AS name, v.text AS value FROM k l JOIN n USING (table_id) JOIN k v ON v.table_id = l.table_id AND v.row_ = l.row_ AND v.col_ > 0 JOIN k h ON h.table_id = v.table_id AND h.col_ = v.col_ AND h.row_ = 0 WHERE l.col_ = 0 AND l.row_ > 0""")
def flat_metric_map(spark, d):
    return G.flat_map(cells(spark, d).filter("table_id % 2 = 0 OR col_ < 2"))


@queries("metric_lookup", f"""WITH {CELL_SQL} SELECT c.table_id, arg_min(v.text, c.row_) AS value FROM c JOIN c v ON v.table_id = c.table_id AND v.row_ = c.row_ AND v.col_ = 1 WHERE c.col_ = 0 AND contains(lower(c.text), 'waste n') GROUP BY 1""")
def metric_lookup(spark, d):
    return G.lookup(cells(spark, d), "Waste N", 1)


SPAN_SQL = """s AS (SELECT l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) * 2 AS row0, CAST(l_quantity AS INT) % 3 AS col1 FROM lineitem)"""


def spans(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    row = ((F.row_number().over(w) - 1) * 2).cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), row.alias("row0"), (row + 1).alias("row1"), F.lit(0).alias("col0"), (F.col("l_quantity").cast("int") % 3).alias("col1"))


@queries("relative_grid", f"""WITH {SPAN_SQL} SELECT table_id, row0 + a.a AS row_, b.b AS col_, -a.a AS up, -b.b AS before, 2 - a.a AS down, col1 - b.b + 1 AS behind FROM s, LATERAL (SELECT unnest(range(0, 2)) AS a) a, LATERAL (SELECT unnest(range(0, col1 + 1)) AS b) b""")
def relative_grid(spark, d):
    made = G.relative_grid(spans(spark, d))
    return made.select("table_id", *[F.col(c).cast("bigint").alias(c) for c in ("row_", "col_", "up", "before", "down", "behind")])


@queries("cell_neighbours", f"""WITH {CELL_SQL}, k AS (SELECT * FROM c WHERE text <> '') SELECT * FROM (SELECT table_id, 'row' AS way, row_, col_, text AS a, lead(text) OVER w AS b, lead(col_) OVER w - col_ - 1 AS blanks FROM k WINDOW w AS (PARTITION BY table_id, row_ ORDER BY col_)
 UNION ALL SELECT table_id, 'column', row_, col_, text, lead(text) OVER w, lead(row_) OVER w - row_ - 1 FROM k WINDOW w AS (PARTITION BY table_id, col_ ORDER BY row_)) WHERE b IS NOT NULL""")
def cell_neighbours(spark, d):
    return G.neighbours(cells(spark, d))


@queries("projected_headers", f"""WITH {CELL_SQL}, x AS (SELECT table_id, row_, string_agg(CASE WHEN text = '' THEN '1' ELSE '0' END, '' ORDER BY col_) AS blanks, count(*) AS n FROM c GROUP BY 1, 2)
SELECT table_id, row_ FROM x WHERE length(replace(blanks, '0', '')) > 0.7 * n OR contains(blanks, repeat('1', CAST(n // 2 + 1 AS INT)))""")
def projected_headers(spark, d):
    return G.projected_headers(cells(spark, d))


@queries("table_shape", f"""WITH {CELL_SQL}, {SPAN_SQL}, y AS (SELECT table_id, row_, count(*) FILTER (regexp_matches(text, '{YEAR}')) >= 2 AS b FROM c GROUP BY 1, 2), h AS (SELECT table_id, coalesce(min(row_) FILTER (NOT b), count(*)) AS header_rows FROM y GROUP BY 1),
 z AS (SELECT table_id, count(*) FILTER (col1 > 0) AS spanning FROM s GROUP BY 1), n AS (SELECT table_id, max(row_) + 1 AS rows_, max(col_) + 1 AS cols, count(*) FILTER (text <> '') AS filled FROM c GROUP BY 1) SELECT table_id, rows_, cols, filled, spanning, header_rows FROM n JOIN h USING (table_id) JOIN z USING (table_id)""")
def table_shape(spark, d):
    """Rows, columns, filled cells, spanning cells and the rows of years at the top."""
    made = cells(spark, d)
    size = made.groupBy("table_id").agg((F.max("row_") + 1).alias("rows_"), (F.max("col_") + 1).alias("cols"), F.count_if(F.col("text") != "").alias("filled"))
    rows = made.groupBy("table_id", "row_").agg((F.count_if(F.col("text").rlike(YEAR)) >= 2).alias("b"))
    header = rows.groupBy("table_id").agg(F.coalesce(F.min(F.when(~F.col("b"), F.col("row_"))), F.count("*")).cast("bigint").alias("header_rows"))
    return size.join(header, "table_id").join(spans(spark, d).groupBy("table_id").agg(F.count_if(F.col("col1") > 0).alias("spanning")), "table_id").select("table_id", "rows_", "cols", "filled", "spanning", "header_rows")


CORNER_SQL = "o AS (SELECT x, y FROM (SELECT l_partkey % 97 AS x, l_suppkey % 89 AS y, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n % 2 = 1)"


@queries("outline_edges", f"""WITH {CORNER_SQL}, v AS (SELECT 'v' AS kind, x, y, lead(y) OVER (PARTITION BY x ORDER BY y) AS z, row_number() OVER (PARTITION BY x ORDER BY y) AS k FROM o UNION ALL SELECT 'h', y, x, lead(x) OVER (PARTITION BY y ORDER BY x), row_number() OVER (PARTITION BY y ORDER BY x) FROM o)
SELECT kind, x AS at_, y AS from_, z AS to_ FROM v WHERE k % 2 = 1 AND z IS NOT NULL""")
def outline_edges(spark, d):
    """Edges of the outline of rectangles: corners met an odd number of times, paired along each line."""
    odd = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 97).alias("x"), (F.col("l_suppkey") % 89).alias("y")).agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return G.outline_edges(odd.select("x", "y"))


@queries("mask_bounds", "SELECT l_orderkey AS mask, min(l_partkey % 100) AS x0, min(l_suppkey) AS y0, max(l_partkey % 100 + CAST(l_quantity AS INT)) AS x1, max(l_suppkey) + 1 AS y1, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS pixels FROM lineitem GROUP BY 1")
def mask_bounds(spark, d):
    """The box around a mask stated as runs of pixels, and its size."""
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mask"), F.col("l_suppkey").alias("y"), (F.col("l_partkey") % 100).alias("x"), F.col("l_quantity").cast("int").alias("n"))
    return G.mask_bounds(runs)


@queries("recognised_cells")
def recognised_cells(spark, d):
    """Rows, columns and spanning cells of a page, by score, to cells with their confidence."""
    return G.recognise(detections(spark, d).withColumnRenamed("page", "table_id"), {"A": "row", "N": "column", "R": "span"}, 0.5).select("table_id", "rows", "columns", "confidence")


@queries("span_alignment", f"""WITH {BOX_SQL} SELECT s.page, s.obj_id, coalesce(list(r.obj_id ORDER BY r.obj_id) FILTER (r.obj_id IS NOT NULL), []) AS rows_ FROM b s LEFT JOIN b r ON r.page = s.page AND r.label = 'A' AND (least(r.y1, s.y1) - greatest(r.y0, s.y0)) / (r.y1 - r.y0) >= 0.5 WHERE s.label = 'R' GROUP BY 1, 2""")
def span_alignment(spark, d):
    """The rows that each spanning cell covers by at least half of their height."""
    made = detections(spark, d)
    return L.covered_rows(made.filter("label = 'R'"), made.filter("label = 'A'"), ["page"])


@queries("header_nesting", f"""WITH {BOX_SQL}, s AS (SELECT s.page, s.obj_id, list(r.obj_id) AS rows_ FROM b s JOIN b r ON r.page = s.page AND r.label = 'A' AND (least(r.y1, s.y1) - greatest(r.y0, s.y0)) / (r.y1 - r.y0) >= 0.5 WHERE s.label = 'R' GROUP BY 1, 2)
SELECT a.page, a.obj_id AS inner_id, b.obj_id AS outer_id, len(list_filter(a.rows_, lambda x: NOT list_contains(b.rows_, x))) = 0 AS nested FROM s a JOIN s b ON a.page = b.page AND a.obj_id <> b.obj_id""")
def header_nesting(spark, d):
    """Whether the rows of one spanning cell are among those of another, as a tree of headers needs."""
    made = L.covered_rows(detections(spark, d).filter("label = 'R'"), detections(spark, d).filter("label = 'A'"), ["page"]).filter(F.size("rows_") > 0)
    a, b = made.select("page", F.col("obj_id").alias("inner_id"), F.col("rows_").alias("a")), made.select("page", F.col("obj_id").alias("outer_id"), F.col("rows_").alias("b"))
    return a.join(b, "page").filter("inner_id <> outer_id").select("page", "inner_id", "outer_id", (F.size(F.array_except("a", "b")) == 0).alias("nested"))


@queries("shared_token_suppression")
def shared_token_suppression(spark, d):
    """Boxes that share a word with one of higher score fall."""
    made = detections(spark, d)
    return D.suppress_by_words(made.filter("side = 'F'"), made.filter("side = 'O'"), ["page"]).select("page", "obj_id")


@queries("filled_rows", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id FROM b p WHERE p.label = 'A' AND EXISTS (SELECT 1 FROM b q WHERE q.page = p.page AND q.label <> 'A' AND (q.y0 + q.y1) / 2 BETWEEN p.y0 AND p.y1 AND (q.x0 + q.x1) / 2 BETWEEN p.x0 AND p.x1)""")
def filled_rows(spark, d):
    """Rows in which the middle of some word lies; the empty ones are dropped."""
    made = detections(spark, d)
    return L.drop_empty(made.filter("label = 'A'"), made.filter("label <> 'A'"), ["page"]).select("page", "obj_id")


@queries("containers_all", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id, q.obj_id AS container FROM b p JOIN b q ON p.page = q.page AND p.side = 'F' AND q.side = 'O' AND ({INTER}) / {AREA.format('p')} >= 0.5""")
def containers_all(spark, d):
    """All containers that hold at least half of an item."""
    made = detections(spark, d)
    return D.overlapping_pairs(made.filter("side = 'F'"), made.filter("side = 'O'"), ["page"], B.covered).filter("overlap >= 0.5").select("page", F.col("a_id").alias("obj_id"), F.col("b_id").alias("container"))


@queries("words_in_boxes", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id, coalesce(string_agg(q.label, ' ' ORDER BY q.y0, q.x0, q.obj_id) FILTER (q.obj_id IS NOT NULL), '') AS text FROM b p LEFT JOIN b q ON q.page = p.page AND q.side = 'O' AND q.x0 >= p.x0 - 60 AND q.y0 >= p.y0 - 60 AND q.x1 <= p.x1 + 60 AND q.y1 <= p.y1 + 60 WHERE p.side = 'F' GROUP BY 1, 2""")
def words_in_boxes(spark, d):
    made = detections(spark, d)
    grown = B.box(F.col("box.x0") - 60, F.col("box.y0") - 60, F.col("box.x1") + 60, F.col("box.y1") + 60)
    areas = made.filter("side = 'F'").select("page", "obj_id", grown.alias("box"))
    return L.words_in_boxes(made.filter("side = 'O'").select("page", F.col("obj_id").alias("pos"), "box", F.col("label").alias("word")), areas, ["page"])


@queries("cluster_hulls", f"WITH {BOX_SQL} SELECT page, label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b GROUP BY 1, 2")
def cluster_hulls(spark, d):
    return L.hulls(detections(spark, d), ["page", "label"]).select("page", "label", "hull.*", "n")


@queries("reading_sorted", f"WITH {BOX_SQL} SELECT page, obj_id, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, y1, x1, obj_id) AS INT) AS reading, CAST(row_number() OVER (PARTITION BY page ORDER BY x0 + x1, obj_id) AS INT) AS by_middle FROM b")
def reading_sorted(spark, d):
    """Order of reading, and of the middles across."""
    down = Window.partitionBy("page").orderBy("box.y0", "box.x0", "box.y1", "box.x1", "obj_id")
    across = Window.partitionBy("page").orderBy(F.col("box.x0") + F.col("box.x1"), "obj_id")
    return detections(spark, d).select("page", "obj_id", F.row_number().over(down).alias("reading"), F.row_number().over(across).alias("by_middle"))


@queries("superscript_words", f"""WITH {BOX_SQL}, l AS (SELECT *, CAST(floor(y0 / 200) AS INT) AS line FROM b) SELECT w.page, w.obj_id, CASE WHEN count(s.obj_id) > 0 THEN w.label || '<s>' || string_agg(CAST(s.obj_id AS VARCHAR), '' ORDER BY s.obj_id) || '</s>' ELSE w.label END AS word
FROM l w LEFT JOIN l s ON s.page = w.page AND s.line = w.line AND s.side = 'O' AND s.x0 <= w.x1 AND w.x0 <= s.x1 AND s.y0 <= w.y1 AND w.y0 <= s.y1 WHERE w.side = 'F' GROUP BY w.page, w.obj_id, w.label""")
def superscript_words(spark, d):
    """Words with the raised marks that touch them on their line, tagged."""
    made = detections(spark, d).withColumn("line", F.floor(F.col("box.y0") / 200).cast("int"))
    return L.tag_superscripts(made.filter("side = 'F'").withColumnRenamed("label", "word"), made.filter("side = 'O'").withColumn("mark", F.col("obj_id").cast("string")), ["page", "line"]).select("page", "obj_id", "word")


@queries("image_proposals", f"""WITH {BOX_SQL}, p AS (SELECT CAST(page AS VARCHAR) AS image, list(obj_id ORDER BY score DESC, obj_id) AS proposals FROM b GROUP BY 1) SELECT o_orderkey, proposals FROM orders JOIN p ON CAST(o_orderkey AS VARCHAR) = p.image""")
def image_proposals(spark, d):
    """Images with their proposals, the best first, joined on the id as text."""
    props = detections(spark, d).groupBy(F.col("page").cast("string").alias("image")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "obj_id"))), lambda x: x["obj_id"]).alias("proposals"))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("image")).join(props, "image").select("o_orderkey", "proposals")


@queries("frame_pairs", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id AS a_id, q.obj_id AS b_id, round({IOU}, 6) AS iou FROM b p JOIN b q ON q.page = p.page - 1 AND ({INTER}) > 0""")
def frame_pairs(spark, d):
    """Boxes that overlap one of the frame before."""
    now = detections(spark, d)
    before = now.withColumn("page", F.col("page") + 1)
    return D.overlapping_pairs(now, before, ["page"]).select("page", "a_id", "b_id", F.round("overlap", 6).alias("iou"))


VEC = "list_dot_product([{0}.x0, {0}.y0, {0}.x1, {0}.y1], [{1}.x0, {1}.y0, {1}.x1, {1}.y1])"


@queries("nearest_box", f"""WITH {BOX_SQL}, x AS (SELECT p.page, p.obj_id, q.obj_id AS other, round({VEC.format('p', 'q')} / sqrt({VEC.format('p', 'p')} * {VEC.format('q', 'q')}), 7) AS c FROM b p JOIN b q ON p.page = q.page AND p.obj_id <> q.obj_id) SELECT page, obj_id, arg_max(other, (c, -other)) AS nearest FROM x GROUP BY 1, 2""")
def nearest_box(spark, d):
    """The box of the page whose four coordinates are nearest by cosine."""
    return L.nearest_by_cosine(detections(spark, d), ["page"])


@queries("box_predicates", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id AS a_id, q.obj_id AS b_id, (p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1) AS touch,
 (least(abs(p.x0 - q.x0), abs(p.x0 - q.x1), abs(p.x1 - q.x0), abs(p.x1 - q.x1)) <= 30 AND least(abs(p.y0 - q.y0), abs(p.y0 - q.y1), abs(p.y1 - q.y0), abs(p.y1 - q.y1)) <= 30) AS near, ({INTER}) / {AREA.format('p')} >= 0.95 AS held, (p.x0 >= q.x0 AND p.y0 >= q.y0 AND p.x1 <= q.x1 AND p.y1 <= q.y1) AS inside FROM b p JOIN b q ON p.page = q.page AND p.obj_id < q.obj_id""")
def box_predicates(spark, d):
    a = detections(spark, d).select("page", F.col("obj_id").alias("a_id"), F.col("box").alias("a"))
    b = detections(spark, d).select("page", F.col("obj_id").alias("b_id"), F.col("box").alias("b"))
    pairs = a.join(b, "page").filter("a_id < b_id")
    return pairs.select("page", "a_id", "b_id", B.touches("a", "b").alias("touch"), B.adjacent("a", "b", 30, 30).alias("near"), (B.covered("a", "b") >= 0.95).alias("held"), B.inside("a", "b").alias("inside"))


@queries("box_measures", f"""WITH {BOX_SQL} SELECT page, obj_id, CAST(trunc(x0 * 1100 / 1000) AS DOUBLE) AS page_x0, round(sqrt(pow(greatest(x0 - 500, 0, 500 - x1), 2) + pow(greatest(y0 - 400, 0, 400 - y1), 2)), 6) AS distance, round(x0 * 0.5 + 20, 6) AS crop_x0, round((x1 - x0) * (y1 - y0), 6) AS outline, round(x0 / 1100, 6) AS relative_x0,
 round((x1 - x0) * cos(radians(30)) + (y1 - y0) * sin(radians(30)), 6) AS turned_width, (x0 <= 0 OR y0 <= 0 OR x1 >= 1000 OR y1 >= 1000) AS on_edge FROM b""")
def box_measures(spark, d):
    made = detections(spark, d)
    b = F.col("box")
    turned = B.rotated_hull(F.lit(0.0), F.lit(0.0), b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(30.0))
    outline = B.polygon_area(F.array(b["x0"], b["x1"], b["x1"], b["x0"]), F.array(b["y0"], b["y0"], b["y1"], b["y1"]))
    return made.select("page", "obj_id", B.denormalise("box", 1100, 800)["x0"].alias("page_x0"), F.round(B.point_distance(F.lit(500.0), F.lit(400.0), "box"), 6).alias("distance"), F.round(B.from_crop("box", 0.5, 0.5, 20.0, 30.0)["x0"], 6).alias("crop_x0"),
                       F.round(outline, 6).alias("outline"), F.round(B.relative("box", 1100, 800)["x0"], 6).alias("relative_x0"), F.round(turned["x1"] - turned["x0"], 6).alias("turned_width"), B.on_edge("box").alias("on_edge"))


@queries("matched_iou", f"""WITH {BOX_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY page, side ORDER BY obj_id) AS k FROM b) SELECT p.page, p.k, round({IOU}, 6) AS iou FROM n p JOIN n q ON p.page = q.page AND p.k = q.k AND p.side = 'F' AND q.side = 'O'""")
def matched_iou(spark, d):
    """Overlap of the k-th boxes of two lists."""
    w = Window.partitionBy("page", "side").orderBy("obj_id")
    made = detections(spark, d).withColumn("k", F.row_number().over(w)).select("page", "side", "k", "box")
    a, b = made.filter("side = 'F'").select("page", "k", F.col("box").alias("a")), made.filter("side = 'O'").select("page", "k", F.col("box").alias("b"))
    return a.join(b, ["page", "k"]).select("page", "k", F.round(B.iou("a", "b"), 6).alias("iou"))


@queries("table_word_hulls", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id, min(q.x0) - 5 AS x0, min(q.y0) - 5 AS y0, max(q.x1) + 5 AS x1, max(q.y1) + 5 AS y1 FROM b p JOIN b q ON q.page = p.page AND q.side = 'O' AND ({INTER}) / {AREA.format('q')} >= 0.5 WHERE p.side = 'F' GROUP BY 1, 2""")
def table_word_hulls(spark, d):
    """A table's box from the words that lie in it by half or more, with a margin."""
    made = detections(spark, d)
    return L.hull_of_words(made.filter("side = 'F'"), made.filter("side = 'O'"), ["page"], 0.5, 5.0).select("page", "obj_id", "box.*")


@queries("rescaled_boxes", f"""WITH {BOX_SQL}, s AS (SELECT page, obj_id, greatest(0, least(400, x0 * 0.5)) AS x0, greatest(0, least(300, y0 * 0.5)) AS y0, greatest(0, least(400, x1 * 0.5)) AS x1, greatest(0, least(300, y1 * 0.5)) AS y1 FROM b) SELECT * FROM s WHERE x1 > x0 AND y1 > y0""")
def rescaled_boxes(spark, d):
    """Detections scaled to the output's size, clipped, the empty ones dropped."""
    made = detections(spark, d).select("page", "obj_id", B.clip(B.scale("box", 0.5, 0.5), 400, 300).alias("box")).filter(B.area("box") > 0)
    return made.select("page", "obj_id", "box.*")


@queries("rotated_iou")
def rotated_iou(spark, d):
    """Overlap of boxes turned by 0 to 90 degrees."""
    made = detections(spark, d).withColumn("degrees", (F.col("page") % 90).cast("double"))
    a = made.filter("side = 'F'").select("page", F.col("obj_id").alias("a_id"), F.struct("box", "degrees").alias("a"))
    b = made.filter("side = 'O'").select("page", F.col("obj_id").alias("b_id"), F.struct("box", F.lit(0.0).alias("degrees")).alias("b"))
    return a.join(b, "page").select("page", "a_id", "b_id", F.round(G.rotated_iou("a", "b"), 6).alias("iou"))
