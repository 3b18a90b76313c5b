"""Queries of evaluation, sampling and the preparation of annotated records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import detection as D
from ..operators import relational as R
from ..sources.tables import table
from .layout import AREA, BOX_SQL, INTER, IOU, detections
from .register import Register

queries = Register()
ORDER = ["ts", "event_id"]

SETS_SQL = """t AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS k, l_returnflag AS label FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber + CASE WHEN CAST(l_quantity AS INT) % 5 = 0 THEN 1 ELSE 0 END AS k, CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN 'A' ELSE l_returnflag END AS label FROM lineitem)"""


@queries("set_scores", f"""WITH {SETS_SQL}, j AS (SELECT coalesce(p.label, t.label) AS label, p.doc IS NOT NULL AS hp, t.doc IS NOT NULL AS ht FROM p FULL JOIN t ON p.doc = t.doc AND p.k = t.k AND p.label = t.label),
b AS (SELECT count(*) FILTER (x.doc IS NOT NULL AND y.doc IS NOT NULL) AS tp, count(*) FILTER (y.doc IS NULL) AS fp, count(*) FILTER (x.doc IS NULL) AS fn FROM (SELECT DISTINCT doc, k FROM p) x FULL JOIN (SELECT DISTINCT doc, k FROM t) y ON x.doc = y.doc AND x.k = y.k),
e AS (SELECT label, count(*) FILTER (hp AND ht) AS tp, count(*) FILTER (NOT ht) AS fp, count(*) FILTER (NOT hp) AS fn FROM j GROUP BY 1),
s AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS rc FROM (SELECT * FROM e UNION ALL SELECT 'micro', sum(tp), sum(fp), sum(fn) FROM e UNION ALL SELECT 'boundaries', * FROM b)), f AS (SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, pr, rc, 2 * pr * rc / (pr + rc) AS f1 FROM s)
SELECT label, tp, fp, fn, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(f1, 6) AS f1 FROM f UNION ALL SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6) FROM f WHERE label NOT IN ('micro', 'boundaries')""")
def set_scores(spark, d):
    line = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    truth = line.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("label"))
    predicted = line.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") + F.when(q % 5 == 0, 1).otherwise(0)).alias("k"), F.when(q % 7 == 0, "A").otherwise(F.col("l_returnflag")).alias("label"))
    return D.set_scores(predicted, truth, ["doc", "k"], "label").select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


PAIR_SQL = "x AS (SELECT l_returnflag AS t, CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN 'A' ELSE l_returnflag END AS p FROM lineitem)"


@queries("class_report", f"""WITH {PAIR_SQL}, c AS (SELECT DISTINCT t AS class FROM x) SELECT class, count(*) FILTER (t = class) AS support, round(count(*) FILTER (t = class AND p = class) / count(*) FILTER (p = class), 6) AS "precision", round(count(*) FILTER (t = class AND p = class) / count(*) FILTER (t = class), 6) AS recall FROM c, x GROUP BY class""")
def class_report(spark, d):
    """Precision, recall and support per class, from the counts of pairs of classes."""
    pairs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("t"), F.when(F.col("l_quantity").cast("int") % 7 == 0, "A").otherwise(F.col("l_returnflag")).alias("p"))
    return D.class_report(pairs, "t", "p").select("class", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@queries("recall_curve")
def recall_curve(spark, d):
    """Recall at overlaps from 0.5 to 0.95 and its mean, by size of the true boxes, after greedy matching."""
    made = detections(spark, d)
    truth = made.filter("side = 'O'")
    return D.recall_by_size(D.greedy_matches(made.filter("side = 'F'"), truth, "page"), truth, "page", [0.5 + 0.05 * k for k in range(10)], {"all": (0.0, 1e18), "small": (0.0, 15_625.0), "large": (15_625.0, 1e18)})


@queries("panoptic_quality", f"""WITH {BOX_SQL}, h AS (SELECT p.label, {IOU} AS iou FROM b p JOIN b q ON p.page = q.page AND p.label = q.label AND p.side = 'F' AND q.side = 'O' AND {IOU} > 0.5), n AS (SELECT label, count(*) FILTER (side = 'F') AS np, count(*) FILTER (side = 'O') AS nt FROM b GROUP BY 1),
m AS (SELECT n.label, np, nt, count(iou) AS tp, coalesce(sum(iou), 0) AS s FROM n LEFT JOIN h ON n.label = h.label GROUP BY 1, 2, 3) SELECT label, round(s / ((np + nt) / 2), 6) AS pq, round(CASE WHEN tp = 0 THEN 0 ELSE s / tp END, 6) AS sq, round(tp / ((np + nt) / 2), 6) AS rq FROM m""")
def panoptic_quality(spark, d):
    made = detections(spark, d)
    return D.panoptic_quality(made.filter("side = 'F'"), made.filter("side = 'O'"), ["page"], "label").select("label", *[F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")])


@queries("class_histogram", f"WITH {BOX_SQL} SELECT label, count(*) AS instances, count(DISTINCT page) AS images FROM b GROUP BY 1")
def class_histogram(spark, d):
    """Instances and images of each class; one row per image and class before the images are counted."""
    return detections(spark, d).groupBy("label", "page").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("instances"), F.count("*").alias("images"))


@queries("usable_images", f"WITH {BOX_SQL} SELECT page FROM b GROUP BY page HAVING bool_or(label <> 'R') AND count(*) FILTER (score >= 0.8) >= 2")
def usable_images(spark, d):
    """Images with an annotation that isn't a crowd and at least two visible points."""
    held = detections(spark, d).groupBy("page").agg(F.collect_list(F.struct("label", "score")).alias("a"))
    return held.filter(F.exists("a", lambda x: x["label"] != "R") & (F.size(F.filter("a", lambda x: x["score"] >= 0.8)) >= 2)).select("page")


@queries("smoothed_values", """SELECT event_id, quantile_disc(value, 0.5) OVER w AS middle, max(value) OVER w AS top, round(sum(value) OVER a, 2) AS total, count(value) OVER a AS n FROM events WHERE value IS NOT NULL
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def smoothed_values(spark, d):
    """Over the last 20 values the lower middle one and the largest; sum and number of all so far, whose ratio is the overall mean."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    near, all_ = w.rowsBetween(-19, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "events").filter("value IS NOT NULL").select("event_id", "user_id", "value", "ts").withColumn("held", F.array_sort(F.collect_list("value").over(near)))
    rows = rows.withColumn("total", F.round(F.sum("value").over(all_), 2)).withColumn("n", F.count("value").over(all_))
    return rows.select("event_id", F.get("held", F.floor((F.size("held") - 1) / 2).cast("int")).alias("middle"), F.array_max("held").alias("top"), "total", "n")


@queries("reduced_maps", """SELECT event_type AS key, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def reduced_maps(spark, d):
    """Maps of many workers reduced to one: the sum and the mean of each key."""
    maps = table(spark, d, "events").select(F.create_map("event_type", "value").alias("m"))
    return maps.select(F.explode("m").alias("key", "v")).groupBy("key").agg(F.round(F.sum("v"), 4).alias("total"), F.round(F.avg("v"), 6).alias("mean"))


@queries("merged_results", "SELECT user_id AS image_id, min(event_id) AS result FROM events GROUP BY user_id")
def merged_results(spark, d):
    """Results of several workers, of each image the one of the least worker and row."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("image_id"), "event_id")
    return rows.filter("event_id % 2 = 0").unionByName(rows.filter("event_id % 2 = 1")).groupBy("image_id").agg(F.min("event_id").alias("result"))


@queries("interleaved_sources", """WITH r(event_type, ratio) AS (VALUES ('click', 3.0), ('view', 1.0), ('purchase', 0.5)) SELECT event_id, round(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) / CAST(ratio AS DOUBLE), 6) AS slot FROM events JOIN r USING (event_type)""")
def interleaved_sources(spark, d):
    """Places of rows when sources are mixed three to one to a half."""
    return R.interleave(table(spark, d, "events"), "event_type", ORDER, {"click": 3.0, "view": 1.0, "purchase": 0.5}).select("event_id", F.round("slot", 6).alias("slot"))


CATEGORY = [("A", 1), ("N", 0)]


@queries("mapped_categories", f"""WITH {BOX_SQL}, m(label, id) AS (VALUES ('A', 1), ('N', 0)) SELECT b.page, list_sort(coalesce(list(m.id) FILTER (m.id IS NOT NULL), [])) AS categories FROM b LEFT JOIN m USING (label) GROUP BY 1""")
def mapped_categories(spark, d):
    """Annotations of mapped categories with their new ids; images that have none left stay."""
    ids = spark.createDataFrame(CATEGORY, "label string, id int")
    return detections(spark, d).select("page", "label").join(F.broadcast(ids), "label", "left").groupBy("page").agg(F.array_sort(F.collect_list("id")).alias("categories"))


@queries("merged_categories", """WITH a AS (SELECT 'one' AS dataset, p_brand AS name, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'two', replace(p_brand, 'Brand#1', 'Brand#2'), count(*) FROM part GROUP BY 2) SELECT name, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT dataset) AS datasets, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS id FROM a GROUP BY name""")
def merged_categories(spark, d):
    """Categories of several datasets under one name and id; one row per category is numbered."""
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    renamed = brands.withColumn("name", F.replace("name", F.lit("Brand#1"), F.lit("Brand#2")))
    both = brands.withColumn("dataset", F.lit("one")).unionByName(renamed.withColumn("dataset", F.lit("two")))
    made = both.groupBy("name").agg(F.sum("n").alias("n"), F.count_distinct("dataset").alias("datasets"))
    return made.withColumn("id", F.row_number().over(Window.orderBy("name")) - 1)


@queries("coco_records", f"WITH {BOX_SQL} SELECT page AS image_id, page * 1000 + obj_id AS id, [x0, y0, x1 - x0, y1 - y0] AS bbox, (x1 - x0) * (y1 - y0) AS area FROM b")
def coco_records(spark, d):
    """Records as annotations: ids offset by their image, boxes as corner and extent, areas."""
    return D.to_coco(detections(spark, d), "page", 1000)


@queries("enriched_records", f"WITH {BOX_SQL} SELECT page, obj_id, o_orderstatus AS status FROM b JOIN orders ON o_orderkey = page")
def enriched_records(spark, d):
    """Instances with the record of their image; one that lacks it is an error."""
    return R.enrich(detections(spark, d).select("page", "obj_id"), table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("status")), ["page"])


@queries("balanced_labels", f"WITH {BOX_SQL} SELECT page, obj_id, label FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(page || '|' || obj_id), page, obj_id) <= 500")
def balanced_labels(spark, d):
    """Up to 500 instances of each label, drawn by a hash."""
    made = detections(spark, d).select("page", "obj_id", "label", F.struct(F.md5(F.concat_ws("|", F.col("page").cast("string"), F.col("obj_id").cast("string"))).alias("h"), "page", "obj_id").alias("draw"))
    return R.least_k(made, ["label"], "draw", 500, ["page", "obj_id"]).select("page", "obj_id", "label")


@queries("sharded_sampler", "SELECT event_id, CAST((row_number() OVER (ORDER BY md5(event_id || '|1'), event_id) - 1) % 4 AS INT) AS rank_ FROM events")
def sharded_sampler(spark, d):
    """A shuffled epoch dealt to four ranks: the order is that of a hash of epoch and id."""
    rows = table(spark, d, "events").select("event_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit("|1"))).alias("h"), F.lit(1).alias("epoch"))
    return R.positions(rows, ["epoch"], ["h", "event_id"], "at_").select("event_id", ((F.col("at_") - 1) % 4).cast("int").alias("rank_"))


@queries("class_matching")
def class_matching(spark, d):
    """One-to-one matching whose cost counts a wrong class too."""
    made = detections(spark, d)
    return D.match_sets(made.filter("side = 'F'"), made.filter("side = 'O'"), "page", (5.0, 2.0), label="label", class_weight=1.0)


@queries("flipped_boxes", f"WITH {BOX_SQL} SELECT page, obj_id, 1000 - x1 AS x0, x0 * 1.5 AS stretched, y1 * 0.5 - 10 AS moved FROM b")
def flipped_boxes(spark, d):
    """Boxes flipped, stretched and moved."""
    made = detections(spark, d)
    return made.select("page", "obj_id", B.flip("box", F.lit(1000.0))["x0"].alias("x0"), B.scale("box", 1.5, 1.5)["x0"].alias("stretched"), B.from_crop("box", 0.5, 0.5, 0.0, -10.0)["y1"].alias("moved"))


@queries("shrunk_spans")
def shrunk_spans(spark, d):
    """Spanning cells cut back until none of a table overlap."""
    line = table(spark, d, "lineitem")
    spans = line.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row0"), (F.col("l_linenumber") + F.col("l_suppkey") % 3).cast("int").alias("row1"), (F.col("l_partkey") % 4).cast("int").alias("col0"), (F.col("l_partkey") % 4 + F.col("l_suppkey") % 2).cast("int").alias("col1"), F.col("l_tax").alias("score"))
    return D.shrunk_spans(spans, "table_id")


@queries("class_best", """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), x AS (SELECT q.vec_id, a.vec_id AS other, round(list_dot_product(q.v, a.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(a.v, a.v))), 5) AS c FROM a q JOIN a ON q.label = a.label AND q.vec_id <> a.vec_id WHERE q.vec_id % 20 = 0) SELECT vec_id, arg_max(other, (c, -other)) AS best FROM x GROUP BY 1""")
def class_best(spark, d):
    """The nearest vector of a query's own class."""
    from ..operators.vectors import block_matches

    vectors = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    per = block_matches(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", group="label")
    return per.join(vectors.select("vec_id", "label"), ["vec_id", "label"], "left_semi").select("vec_id", F.col("other").alias("best"))


@queries("canonical_matches", """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), n AS (SELECT label, min(vec_id) AS canonical FROM a GROUP BY 1), x AS (SELECT q.vec_id, a.vec_id AS other, a.label, round(list_dot_product(q.v, a.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(a.v, a.v))), 5) AS c FROM a q JOIN a ON q.vec_id <> a.vec_id WHERE q.vec_id % 20 = 0)
SELECT x.vec_id, arg_max(n.canonical, (c, -other)) AS canonical, round(max(c), 2) AS score FROM x JOIN n USING (label) GROUP BY 1 HAVING max(c) >= 0.2""")
def canonical_matches(spark, d):
    """The best match from a threshold on, as the canonical member of its group, with two digits."""
    from ..operators.vectors import best_matches

    vectors = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    names = vectors.groupBy("label").agg(F.min("vec_id").alias("canonical"))
    near = best_matches(vectors.filter("vec_id % 20 = 0"), vectors.drop("label"), "vec_id", "embedding", 0.2)
    return near.join(vectors.select(F.col("vec_id").alias("best"), "label"), "best").join(names, "label").select("vec_id", "canonical", F.round("likeness", 2).alias("score"))
