"""Queries of ordered operators, top-k, reshaping and batching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table
from .register import Register

queries = Register()
ORDER = ["ts", "event_id"]


@queries("neighbour_triples", "SELECT event_id, lag(event_id) OVER w AS before_id, lead(event_id) OVER w AS after_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbour_triples(spark, d):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before_id"), F.lead("event_id").over(w).alias("after_id"))


@queries("islands", """WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM g GROUP BY user_id, island""")
def islands(spark, d):
    marked = R.islands(table(spark, d, "events"), ["user_id"], ORDER, ["event_type"])
    return marked.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@queries("line_spacing", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS gap FROM events")
def line_spacing(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy(*ORDER)), 4).alias("gap"))


@queries("reading_order", "SELECT doc_id, page_id, CAST(row_number() OVER (PARTITION BY document_id, page_id ORDER BY doc_id) - 1 AS INT) AS pos FROM documents")
def reading_order(spark, d):
    placed = R.positions(table(spark, d, "documents").select("doc_id", "document_id", "page_id"), ["document_id", "page_id"], ["doc_id"], "pos")
    return placed.select("doc_id", "page_id", (F.col("pos") - 1).cast("int").alias("pos"))


@queries("carry_prefix", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def carry_prefix(spark, d):
    marked = table(spark, d, "events").withColumn("head", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return R.carry_forward(marked, ["user_id"], ORDER, "head", "section").select("event_id", "section")


@queries("duplicate_suffix", """WITH r AS (SELECT doc_id, block_element AS b, row_number() OVER (PARTITION BY document_id, page_id, block_element ORDER BY doc_id) - 1 AS k FROM documents)
SELECT doc_id, b || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS tag, b || repeat('*', CAST(k AS INT)) AS header FROM r""")
def duplicate_suffix(spark, d):
    placed = R.positions(table(spark, d, "documents").select("doc_id", "document_id", "page_id", "block_element"), ["document_id", "page_id", "block_element"], ["doc_id"], "k")
    made = placed.select("doc_id", F.col("block_element").alias("b"), (F.col("k") - 1).cast("int").alias("k"))
    return made.select("doc_id", F.concat(F.col("b"), F.when(F.col("k") > 0, F.concat(F.lit("_"), F.col("k"))).otherwise("")).alias("tag"), F.concat(F.col("b"), F.repeat(F.lit("*"), F.col("k"))).alias("header"))


@queries("continuation_merge", """WITH g AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM events)
SELECT user_id, CAST(k AS BIGINT) AS k, string_agg(event_type, ' ' ORDER BY ts, event_id) AS merged FROM g GROUP BY user_id, k""")
def continuation_merge(spark, d):
    """Rows that continue another are merged into the row before them."""
    k = F.sum((F.col("event_type") != "error").cast("int")).over(Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    grouped = table(spark, d, "events").withColumn("k", k).groupBy("user_id", "k").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("rows"))
    return grouped.select("user_id", "k", F.array_join(F.transform("rows", lambda r: r["event_type"]), " ").alias("merged"))


@queries("fixed_batches", "SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 16) AS BIGINT) AS batch FROM events")
def fixed_batches(spark, d):
    return R.batches(table(spark, d, "events"), ["user_id"], ORDER, 16).select("event_id", "batch")


@queries("aspect_batches", """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, CAST(floor(k / 32) AS BIGINT) AS batch FROM r WHERE (floor(k / 32) + 1) * 32 <= n""")
def aspect_batches(spark, d):
    """Batches of one kind only, full ones only."""
    return R.batches(table(spark, d, "events"), ["event_type"], ORDER, 32, full_only=True).select("event_id", "event_type", "batch")


@queries("smoothed_median", """SELECT event_id, round(quantile_cont(value, 0.5) OVER w, 6) AS middle, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING)""")
def smoothed_median(spark, d):
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(-19, 0)
    return table(spark, d, "events").select("event_id", F.round(F.percentile("value", 0.5).over(w), 6).alias("middle"), F.round(F.avg("value").over(w), 6).alias("mean"), F.max("value").over(w).alias("top"))


@queries("strict_max_column", "SELECT user_id, arg_max(event_type, (n, -k)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS k FROM events GROUP BY 1, 2) GROUP BY user_id")
def strict_max_column(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("k"))
    return counts.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", (-F.col("k")).alias("k"))).alias("event_type"))


@queries("contiguous_prefix", "SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE l_linenumber = rn GROUP BY l_orderkey")
def contiguous_prefix(spark, d):
    """Header rows: the run 1, 2, 3, ... up to the first gap."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return rows.withColumn("rn", rn).filter("l_linenumber = rn").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@queries("hull_snapping", """WITH s AS (SELECT event_id, user_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n, lead(value) OVER w AS nx, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
SELECT event_id, round(CASE WHEN rn = 1 THEN lo WHEN rn = n THEN hi ELSE (value + nx) / 2 END, 6) AS edge FROM s""")
def hull_snapping(spark, d):
    """The first and last edge go to the outer hull, the others to the middle of shared edges."""
    w, whole = Window.partitionBy("user_id").orderBy("value", "event_id"), Window.partitionBy("user_id")
    s = table(spark, d, "events").select("event_id", "value", F.row_number().over(w).alias("rn"), F.count("*").over(whole).alias("n"), F.lead("value").over(w).alias("nx"), F.min("value").over(whole).alias("lo"), F.max("value").over(whole).alias("hi"))
    return s.select("event_id", F.round(F.when(F.col("rn") == 1, F.col("lo")).when(F.col("rn") == F.col("n"), F.col("hi")).otherwise((F.col("value") + F.col("nx")) / 2), 6).alias("edge"))


@queries("heading_tree", """WITH h AS (SELECT doc_id, document_id, CASE block_element WHEN 'title' THEN 1 WHEN 'caption' THEN 2 ELSE 3 END AS lvl FROM documents WHERE document_id <> ''),
c AS (SELECT a.doc_id, a.document_id, a.lvl, (SELECT min(b.doc_id) FROM h b WHERE b.document_id = a.document_id AND b.doc_id > a.doc_id AND b.lvl <= a.lvl) AS stop FROM h a)
SELECT c.doc_id, count(b.doc_id) AS children, min(b.doc_id) AS first_child, max(b.doc_id) AS last_child FROM c LEFT JOIN h b ON b.document_id = c.document_id AND b.doc_id > c.doc_id AND (c.stop IS NULL OR b.doc_id < c.stop) GROUP BY c.doc_id""")
def heading_tree(spark, d):
    """Children of a block: those that follow until one of the same or a higher level.

    By windows alone: for each level the next block of that level or above ends the run, and the number
    of blocks between is a difference of positions, so no block meets another.
    """
    level = F.when(F.col("block_element") == "title", 1).when(F.col("block_element") == "caption", 2).otherwise(3)
    blocks = table(spark, d, "documents").filter("document_id <> ''").select("doc_id", "document_id", level.alias("lvl"))
    w = Window.partitionBy("document_id").orderBy("doc_id")
    after = Window.partitionBy("document_id").orderBy(F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, -1)  # from the end, so that each row adds one to the minimum
    pos = blocks.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("document_id")))
    for k in (1, 2, 3):
        pos = pos.withColumn(f"stop{k}", F.min(F.when(F.col("lvl") <= k, F.col("pos"))).over(after))
    stop = F.coalesce(F.when(F.col("lvl") == 1, F.col("stop1")).when(F.col("lvl") == 2, F.col("stop2")).otherwise(F.col("stop3")), F.col("n") + 1)
    children = stop - F.col("pos") - 1
    made = pos.withColumn("children", children).withColumn("ids", F.lead("doc_id").over(w))
    last = pos.select("document_id", F.col("pos").alias("at"), F.col("doc_id").alias("last_child"))
    joined = made.withColumn("at", F.when(children > 0, F.col("pos") + children)).join(last, ["document_id", "at"], "left")
    return joined.select("doc_id", "children", F.when(F.col("children") > 0, F.col("ids")).alias("first_child"), "last_child")


@queries("first_k_per_group", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def first_k_per_group(spark, d):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    return table(spark, d, "events").withColumn("rn", rn).filter("rn <= 3").select("event_id")


@queries("last_k_per_group", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def last_k_per_group(spark, d):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("rn", rn).filter("rn <= 3").select("event_id")


@queries("dense_renumber", "SELECT DISTINCT l_partkey, CAST(dense_rank() OVER (ORDER BY l_partkey) - 1 AS BIGINT) AS dense FROM lineitem")
def dense_renumber(spark, d):
    """Sparse ids to 0, 1, 2, ... by the ordinals of positional stitching, without one global window."""
    from ..operators.wide import dense_ids

    return dense_ids(table(spark, d, "lineitem").select("l_partkey"), "l_partkey", "dense")


@queries("class_weights", "SELECT event_type, round(pow(count(*), 0.5), 6) AS weight FROM events GROUP BY event_type")
def class_weights(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.pow(F.count("*"), F.lit(0.5)), 6).alias("weight"))


@queries("padded_chunks", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT user_id, CAST(floor(k / 8) AS BIGINT) AS chunk, list_resize(list(event_id ORDER BY k), 8) AS ids FROM r GROUP BY 1, 2""")
def padded_chunks(spark, d):
    """Chunks of 8, the last padded with nulls."""
    chunked = R.batches(table(spark, d, "events"), ["user_id"], ORDER, 8, "chunk").groupBy("user_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("got"))
    return chunked.select("user_id", "chunk", F.concat("got", F.array_repeat(F.lit(None).cast("bigint"), 8 - F.size("got"))).alias("ids"))


@queries("bottom_k", "SELECT user_id, round(max(value), 4) AS score FROM events GROUP BY user_id ORDER BY score, user_id LIMIT 5")
def bottom_k(spark, d):
    """The least covered topics: a top-k report from below."""
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.max("value"), 4).alias("score")).orderBy("score", "user_id").limit(5)


@queries("repeat_factor", """WITH f AS (SELECT event_type, count(DISTINCT user_id) * 1.0 / (SELECT count(DISTINCT user_id) FROM events) AS f FROM events GROUP BY 1)
SELECT user_id, round(max(greatest(1.0, sqrt(0.99 / f))), 6) AS factor FROM (SELECT DISTINCT user_id, event_type FROM events) JOIN f USING (event_type) GROUP BY user_id""")
def repeat_factor(spark, d):
    pairs = table(spark, d, "events").select("user_id", "event_type").distinct()
    total = pairs.agg(F.count_distinct("user_id").alias("all"))
    rare = pairs.groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("event_type", (F.col("n") / F.col("all")).alias("f"))
    return pairs.join(rare, "event_type").groupBy("user_id").agg(F.round(F.max(F.greatest(F.lit(1.0), F.sqrt(F.lit(0.99) / F.col("f")))), 6).alias("factor"))


@queries("tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    made = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n")


@queries("sliding", """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1""")
def sliding(spark, d):
    made = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return made.select(F.col("window.start").alias("start"), "n")


@queries("sessions", """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def sessions(spark, d):
    made = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("ts").alias("start"), F.count("*").alias("n"))
    return made.select("user_id", "start", "n")
