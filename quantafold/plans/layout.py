"""Queries of boxes, detections, evaluation and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import detection as D
from ..operators.vectors import best_matches, block_matches, hashed_grams, top_matches
from ..sources.tables import table
from .register import Register

queries = Register()

BOX_SQL = """b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS obj_id, (l_partkey % 900)::DOUBLE AS x0, (l_suppkey % 90 * 10)::DOUBLE AS y0,
  (l_partkey % 900)::DOUBLE + 100 + l_quantity AS x1, (l_suppkey % 90 * 10)::DOUBLE + 100 + l_quantity AS y1, round(1 - l_discount * 5, 2) AS score, l_returnflag AS label, l_linestatus AS side FROM lineitem)"""
INTER = "greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0))"
AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
IOU = f"({INTER}) / ({AREA.format('p')} + {AREA.format('q')} - ({INTER}))"


def detections(spark, d):
    """A page of boxes per order."""
    line = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x, y = (F.col("l_partkey") % 900).cast("double"), (F.col("l_suppkey") % 90 * 10).cast("double")
    return line.select(F.col("l_orderkey").alias("page"), F.row_number().over(w).alias("obj_id"), B.box(x, y, x + 100 + F.col("l_quantity"), y + 100 + F.col("l_quantity")).alias("box"),
                       F.round(1 - F.col("l_discount") * 5, 2).alias("score"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("side"))


@queries("box_normalise", f"WITH {BOX_SQL} SELECT page, obj_id, greatest(0, least(1000, CAST(trunc(x0 * 1000 / 1100) AS INT)))::DOUBLE AS x0, greatest(0, least(1000, CAST(trunc(y1 * 1000 / 800) AS INT)))::DOUBLE AS y1 FROM b")
def box_normalise(spark, d):
    return detections(spark, d).select("page", "obj_id", B.normalise("box", 1100, 800).alias("n")).select("page", "obj_id", "n.x0", "n.y1")


@queries("box_convert", f"WITH {BOX_SQL} SELECT page, obj_id, x1 - x0 AS w, (y0 + y1) / 2 AS cy, 1000 - x1 AS flipped, least(x1, 800.0)::DOUBLE AS clipped, (x1 - x0) * (y1 - y0) AS area, round(1000 - y1 * 0.5, 4) AS page_y0 FROM b")
def box_convert(spark, d):
    made = detections(spark, d)
    return made.select("page", "obj_id", B.to_xywh("box")["w"].alias("w"), B.to_centre("box")["cy"].alias("cy"), B.flip("box", F.lit(1000.0))["x0"].alias("flipped"), B.clip("box", 800, 800)["x1"].alias("clipped"), B.area("box").alias("area"), F.round(B.image_to_page("box", F.lit(0.5), F.lit(1000.0))["y0"], 4).alias("page_y0"))


@queries("box_pairs", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id AS a_id, q.obj_id AS b_id, round({IOU}, 6) AS iou, round(({INTER}) / {AREA.format('p')}, 6) AS covered,
 least(abs(p.x0 - q.x0), abs(p.x0 - q.x1), abs(p.x1 - q.x0), abs(p.x1 - q.x1)) AS dx FROM b p JOIN b q ON p.page = q.page AND p.obj_id < q.obj_id AND ({INTER}) > 0""")
def box_pairs(spark, d):
    a = detections(spark, d).select("page", F.col("obj_id").alias("a_id"), F.col("box").alias("a"))
    b = detections(spark, d).select("page", F.col("obj_id").alias("b_id"), F.col("box").alias("b"))
    pairs = a.join(b, "page").filter((F.col("a_id") < F.col("b_id")) & (B.area(B.intersection("a", "b")) > 0))
    return pairs.select("page", "a_id", "b_id", F.round(B.iou("a", "b"), 6).alias("iou"), F.round(B.covered("a", "b"), 6).alias("covered"), B.offset("a", "b", "x").alias("dx"))


@queries("generalised_iou", f"""WITH {BOX_SQL}, x AS (SELECT p.page, p.obj_id AS a_id, q.obj_id AS b_id, {IOU} AS iou, {AREA.format('p')} + {AREA.format('q')} - ({INTER}) AS un, (greatest(p.x1, q.x1) - least(p.x0, q.x0)) * (greatest(p.y1, q.y1) - least(p.y0, q.y0)) AS hull
FROM b p JOIN b q ON p.page = q.page AND p.obj_id < q.obj_id) SELECT page, a_id, b_id, round(iou - (hull - un) / hull, 6) AS giou FROM x""")
def generalised_iou(spark, d):
    a = detections(spark, d).select("page", F.col("obj_id").alias("a_id"), F.col("box").alias("a"))
    b = detections(spark, d).select("page", F.col("obj_id").alias("b_id"), F.col("box").alias("b"))
    return a.join(b, "page").filter("a_id < b_id").select("page", "a_id", "b_id", F.round(B.giou("a", "b"), 6).alias("giou"))


@queries("box_delta", f"WITH {BOX_SQL} SELECT page, obj_id, round(ln((x1 - x0) / 120), 6) AS dw, round(((x0 + x1) / 2 - 60) / 120, 6) AS dx FROM b")
def box_delta(spark, d):
    delta = B.encode_delta(B.box(0.0, 0.0, 120.0, 120.0), "box")
    return detections(spark, d).select("page", "obj_id", F.round(delta["dw"], 6).alias("dw"), F.round(delta["dx"], 6).alias("dx"))


@queries("neighbour_directions", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id AS a_id, q.obj_id AS b_id, CASE WHEN v = '' AND h = '' THEN 'overlap' ELSE v || h END AS direction FROM b p JOIN b q ON p.page = q.page AND p.obj_id <> q.obj_id,
 LATERAL (SELECT CASE WHEN q.y1 <= p.y0 THEN 'n' WHEN q.y0 >= p.y1 THEN 's' ELSE '' END AS v, CASE WHEN q.x1 <= p.x0 THEN 'w' WHEN q.x0 >= p.x1 THEN 'e' ELSE '' END AS h)""")
def neighbour_directions(spark, d):
    a = detections(spark, d).select("page", F.col("obj_id").alias("a_id"), F.col("box").alias("a"))
    b = detections(spark, d).select("page", F.col("obj_id").alias("b_id"), F.col("box").alias("b"))
    return a.join(b, "page").filter("a_id <> b_id").select("page", "a_id", "b_id", B.direction("a", "b").alias("direction"))


@queries("table_dedupe", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id FROM b p WHERE NOT EXISTS (SELECT 1 FROM b q WHERE p.page = q.page AND (q.score > p.score OR (q.score = p.score AND q.obj_id < p.obj_id)) AND ({INTER}) / {AREA.format('p')} > 0.3)""")
def table_dedupe(spark, d):
    return D.drop_overlapped(detections(spark, d), ["page"]).select("page", "obj_id")


@queries("container_assign", f"""WITH {BOX_SQL} SELECT p.page, p.obj_id, arg_max(q.obj_id, (({INTER}) / {AREA.format('p')}, -q.obj_id)) AS container FROM b p JOIN b q ON p.page = q.page AND p.side = 'F' AND q.side = 'O' AND ({INTER}) / {AREA.format('p')} >= 0.5 GROUP BY ALL""")
def container_assign(spark, d):
    made = detections(spark, d)
    return D.best_container(made.filter("side = 'F'"), made.filter("side = 'O'"), ["page"]).select("page", "obj_id", "container")


@queries("matcher_bands", f"""WITH {BOX_SQL}, x AS (SELECT p.page, p.obj_id AS a, q.obj_id AS t, {IOU} AS o FROM b p JOIN b q ON p.page = q.page AND p.side = 'F' AND q.side = 'O' AND ({INTER}) > 0),
s AS (SELECT DISTINCT page, a FROM x QUALIFY o = max(o) OVER (PARTITION BY page, t)), m AS (SELECT page, a, max(o) AS o FROM x GROUP BY ALL)
SELECT b.page, b.obj_id, CAST(CASE WHEN s.a IS NOT NULL OR coalesce(m.o, 0) >= 0.7 THEN 1 WHEN coalesce(m.o, 0) >= 0.3 THEN -1 ELSE 0 END AS INT) AS band FROM b LEFT JOIN m ON m.page = b.page AND m.a = b.obj_id LEFT JOIN s ON s.page = b.page AND s.a = b.obj_id WHERE side = 'F'""")
def matcher_bands(spark, d):
    made = detections(spark, d)
    return D.match_bands(made.filter("side = 'F'"), made.filter("side = 'O'"), ["page"]).select("page", "obj_id", "band")


@queries("nms")
def nms(spark, d):
    return D.suppress(detections(spark, d), ["page"]).select("page", "obj_id", "score")


@queries("class_nms")
def class_nms(spark, d):
    return D.suppress(detections(spark, d), ["page", "label"]).select("page", "label", "obj_id", "score")


@queries("set_matching")
def set_matching(spark, d):
    made = detections(spark, d)
    return D.match_sets(made.filter("side = 'F'"), made.filter("side = 'O'"), "page")


@queries("threshold_by_class", f"WITH {BOX_SQL} SELECT page, obj_id FROM b WHERE score >= CASE label WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.7 ELSE 0.9 END")
def threshold_by_class(spark, d):
    limits = spark.createDataFrame([("A", 0.5), ("N", 0.7), ("R", 0.9)], "label string, least double")
    return detections(spark, d).join(F.broadcast(limits), "label").filter("score >= least").select("page", "obj_id")


@queries("adjacency_prf", """WITH p AS (SELECT l_orderkey, l_returnflag, count(*) AS p FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), t AS (SELECT l_orderkey, l_returnflag, count(*) AS t FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
s AS (SELECT sum(least(coalesce(p, 0), coalesce(t, 0))) AS tp, sum(p) AS np, sum(t) AS nt FROM p FULL JOIN t USING (l_orderkey, l_returnflag))
SELECT CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(nt - tp AS BIGINT) AS fn, round(tp / np, 6) AS "precision", round(tp / nt, 6) AS recall, round(2 * (tp / np) * (tp / nt) / (tp / np + tp / nt), 6) AS f1 FROM s""")
def adjacency_prf(spark, d):
    line = table(spark, d, "lineitem")
    made = D.precision_recall(line.filter("l_linestatus = 'F'"), line.filter("l_linestatus = 'O'"), ["l_orderkey", "l_returnflag"])
    return made.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@queries("confusion_matrix", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def confusion_matrix(spark, d):
    return D.confusion(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@queries("segmentation_scores", """WITH r AS (SELECT l_partkey % 5 AS t, CASE WHEN l_quantity > 10 THEN l_partkey % 5 ELSE l_suppkey % 5 END AS p FROM lineitem), c AS (SELECT t, p, count(*) AS n FROM r GROUP BY ALL),
x AS (SELECT a.t, a.nt, b.np, coalesce(c.n, 0) AS tp FROM (SELECT t, sum(n) AS nt FROM c GROUP BY t) a JOIN (SELECT p, sum(n) AS np FROM c GROUP BY p) b ON a.t = b.p LEFT JOIN c ON c.t = a.t AND c.p = a.t)
SELECT round(avg(tp / (nt + np - tp)), 6) AS miou, round(sum(nt * tp / (nt + np - tp)) / sum(nt), 6) AS fwiou, round(avg(tp / nt), 6) AS macc, round(sum(tp) / sum(nt), 6) AS pacc FROM x""")
def segmentation_scores(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 5).alias("t"), F.when(F.col("l_quantity") > 10, F.col("l_partkey") % 5).otherwise(F.col("l_suppkey") % 5).alias("p"))
    return D.segmentation_scores(rows, "t", "p").select(*[F.round(c, 6).alias(c) for c in ("miou", "fwiou", "macc", "pacc")])


@queries("average_precision", """WITH r AS (SELECT event_type AS category, value AS score, event_id, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS hit FROM events), n AS (SELECT category, count(*) FILTER (hit = 1) AS n FROM r GROUP BY 1),
w AS (SELECT r.category, score, event_id, sum(hit) OVER v AS tp, row_number() OVER v AS k, n.n FROM r JOIN n USING (category) WINDOW v AS (PARTITION BY r.category ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT category, max(tp / k) OVER (PARTITION BY category ORDER BY score, event_id DESC ROWS UNBOUNDED PRECEDING) AS best, tp / n - coalesce(lag(tp / n) OVER (PARTITION BY category ORDER BY score DESC, event_id), 0) AS step FROM w),
p AS (SELECT category, t, coalesce(max(tp / k) FILTER (tp * 10 >= t * n), 0) AS best FROM w, range(11) AS x(t) GROUP BY 1, 2)
SELECT category, ap, ap11 FROM (SELECT category, round(sum(best * step), 6) AS ap FROM e GROUP BY category) JOIN (SELECT category, round(avg(best), 6) AS ap11 FROM p GROUP BY category) USING (category)""")
def average_precision(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("value").alias("score"), "event_id", F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("hit"))
    positives = rows.groupBy("category").agg(F.sum("hit").alias("n"))
    return D.average_precision(rows, "category", "score", "hit", ["event_id"], positives).select("category", F.round("ap", 6).alias("ap"), F.round("ap11", 6).alias("ap11"))


VERDICT_SQL = f"""x AS (SELECT p.page, p.obj_id AS t_id, q.obj_id AS f_id, ({INTER}) / {AREA.format('p')} AS iog, ({INTER}) / {AREA.format('q')} AS iod FROM b p JOIN b q ON p.page = q.page AND p.side = 'F' AND q.side = 'O'),
v AS (SELECT b.page, b.obj_id, CASE WHEN coalesce(max(iog), 0) = 0 THEN 'miss' WHEN max(iog) >= 2 / 3 AND max(iod) >= 2 / 3 THEN 'correct' WHEN max(iod) >= 2 / 3 THEN 'split' WHEN max(iog) >= 2 / 3 THEN 'merge' ELSE 'split&merge' END AS verdict FROM b LEFT JOIN x ON x.page = b.page AND x.t_id = b.obj_id WHERE side = 'F' GROUP BY ALL
 UNION ALL SELECT b.page, b.obj_id, 'false' FROM b LEFT JOIN x ON x.page = b.page AND x.f_id = b.obj_id WHERE side = 'O' GROUP BY ALL HAVING coalesce(max(iog), 0) = 0)"""


@queries("block_verdict", f"WITH {BOX_SQL}, {VERDICT_SQL} SELECT * FROM v")
def block_verdict(spark, d):
    """How each true block was found: correct, split, merge, split&merge or miss; and the found blocks that meet no true one: false."""
    made = detections(spark, d)
    return D.block_verdicts(made.filter("side = 'O'"), made.filter("side = 'F'"), ["page"])


@queries("block_scores", f"""WITH {BOX_SQL}, {VERDICT_SQL}, c AS (SELECT count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'miss') AS miss, count(*) AS n FROM v)
SELECT correct, miss, n, round(correct / (n - miss), 6) AS "precision", round(correct / (correct + miss), 6) AS recall FROM c""")
def block_scores(spark, d):
    """The sums of the verdicts and what precision and recall follow."""
    c = block_verdict(spark, d).agg(F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "miss").alias("miss"), F.count("*").alias("n"))
    return c.select("correct", "miss", "n", F.round(F.try_divide("correct", F.col("n") - F.col("miss")), 6).alias("precision"), F.round(F.try_divide("correct", F.col("correct") + F.col("miss")), 6).alias("recall"))


@queries("table_statistics", """WITH t AS (SELECT l_orderkey AS table_id, count(DISTINCT l_linenumber) AS rows_, count(DISTINCT l_returnflag) AS cols, count(*) AS cells, stddev_samp(l_quantity) / avg(l_quantity) AS cv, count(*) AS n FROM lineitem GROUP BY 1)
SELECT table_id, rows_, cols, cells, round(CASE WHEN n < 2 THEN 0 ELSE cv END, 6) AS variation FROM t""")
def table_statistics(spark, d):
    made = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(
        F.count_distinct("l_linenumber").alias("rows_"), F.count_distinct("l_returnflag").alias("cols"), F.count("*").alias("cells"), (F.stddev_samp("l_quantity") / F.avg("l_quantity")).alias("cv"))
    return made.select("table_id", "rows_", "cols", "cells", F.round(F.when(F.col("cells") < 2, 0.0).otherwise(F.col("cv")), 6).alias("variation"))


@queries("match_confidence", "SELECT l_orderkey, round((avg(l_tax) + min(l_tax)) / 2, 6) AS confidence FROM lineitem GROUP BY 1")
def match_confidence(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.coalesce((F.avg("l_tax") + F.min("l_tax")) / 2, F.lit(0.0)), 6).alias("confidence"))


@queries("dense_grid", "SELECT l_orderkey, r.r AS row_, c.c AS col_, count(*) AS n FROM lineitem, LATERAL (SELECT unnest(range(l_linenumber, l_linenumber + 2)) AS r) r, LATERAL (SELECT unnest(range(0, CAST(l_quantity AS INT) % 3 + 1)) AS c) c GROUP BY 1, 2, 3")
def dense_grid(spark, d):
    """Cells that span rows and columns repeated over a grid."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.sequence("l_linenumber", F.col("l_linenumber") + 1)).alias("row_"), (F.col("l_quantity").cast("int") % 3).alias("last"))
    return rows.withColumn("col_", F.explode(F.sequence(F.lit(0), F.col("last")))).groupBy("l_orderkey", F.col("row_").cast("bigint").alias("row_"), F.col("col_").cast("bigint").alias("col_")).agg(F.count("*").alias("n"))


@queries("adjacent_pairs", """WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag, lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nx FROM lineitem)
SELECT l_returnflag AS a, nx AS b, count(*) AS n FROM g WHERE nx IS NOT NULL GROUP BY 1, 2""")
def adjacent_pairs(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.lead("l_returnflag").over(w).alias("b")).filter("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


@queries("head_tail_negatives", """WITH e AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS k, l_returnflag AS f FROM lineitem) SELECT a.doc, a.k AS head, b.k AS tail, (a.f = 'A' AND b.f = 'N') AS positive FROM e a JOIN e b ON a.doc = b.doc AND a.f = 'A' AND b.f <> 'A'""")
def head_tail_negatives(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("f")).distinct()
    heads, tails = e.filter("f = 'A'").select("doc", F.col("k").alias("head")), e.filter("f <> 'A'").select("doc", F.col("k").alias("tail"), F.col("f").alias("g"))
    return heads.join(tails, "doc").select("doc", "head", "tail", (F.col("g") == "N").alias("positive"))


@queries("outer_tags", "SELECT page, obj_id, CASE WHEN page % 7 <> 1 AND (y1 <= 120 OR y1 >= 920) THEN 'margin' ELSE label END AS tag FROM (WITH " + BOX_SQL + " SELECT * FROM b)")
def outer_tags(spark, d):
    made = detections(spark, d)
    return made.select("page", "obj_id", F.when((F.col("page") % 7 != 1) & ((F.col("box.y1") <= 120) | (F.col("box.y1") >= 920)), "margin").otherwise(F.col("label")).alias("tag"))


COS = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


@queries("cosine_best", f"""WITH b AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0) SELECT b.vec_id, arg_max(a.vec_id, (round({COS}, 5), -a.vec_id)) AS best FROM embeddings a JOIN b ON a.vec_id <> b.vec_id GROUP BY 1""")
def cosine_best(spark, d):
    """The nearest of all vectors to each of a stated query set, those whose id is divisible by 20."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return best_matches(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding").select("vec_id", "best")


@queries("cosine_top3", f"""WITH b AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0) SELECT vec_id, list(g ORDER BY c DESC, g) AS matches FROM (SELECT b.vec_id, a.vec_id AS g, round({COS}, 5) AS c FROM embeddings a JOIN b ON a.vec_id <> b.vec_id WHERE {COS} >= 0.2 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY c DESC, g) <= 3) GROUP BY 1""")
def cosine_top3(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return top_matches(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 0.2, 3)


@queries("group_cosine", f"""WITH b AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), g AS (SELECT b.vec_id, a.label AS lab, max({COS}) AS c FROM embeddings a JOIN b ON a.vec_id <> b.vec_id GROUP BY 1, 2) SELECT vec_id, arg_max(lab, (round(c, 5), -lab)) AS label FROM g GROUP BY 1""")
def group_cosine(spark, d):
    """The group whose nearest member is nearest."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    per = block_matches(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", group="label")
    return per.groupBy("vec_id").agg(F.max_by("label", F.struct("likeness", -F.col("label"))).alias("label"))


@queries("topic_scores", f"""WITH t AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0) SELECT b.vec_id AS topic, round(greatest(max({COS}), 0), 5) AS score FROM t b JOIN embeddings a ON a.vec_id <> b.vec_id GROUP BY 1""")
def topic_scores(spark, d):
    """How well each topic's seed is covered by any vector."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = best_matches(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding")
    return near.select(F.col("vec_id").alias("topic"), F.round(F.greatest("likeness", F.lit(0.0)), 5).alias("score"))


@queries("hashed_encoder")
def hashed_encoder(spark, d):
    """The deterministic stand-in for a sentence encoder, over metric names."""
    names = table(spark, d, "environment_info").select("metric").distinct()
    return names.withColumn("vector", hashed_grams("metric"))
