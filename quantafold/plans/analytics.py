"""Queries of the analytics model: facts, dimensions, verdicts and derived metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table
from .register import Register

queries = Register()

FACT_SQL = """fact AS (
  SELECT o.o_custkey AS company, p.p_brand AS metric, CAST(year(o.o_orderdate) AS INT) AS yr, round(1 - l.l_discount * 5, 2) AS score,
         l.l_extendedprice AS value, l.l_orderkey AS k1, l.l_linenumber AS k2, l.l_partkey AS k3, l.l_suppkey AS k4, l.l_quantity AS k5
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Company, metric, year, score and value, with keys that tell rows apart."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
        .select(F.col("o_custkey").alias("company"), F.col("p_brand").alias("metric"), F.year("o_orderdate").alias("yr"), F.round(1 - F.col("l_discount") * 5, 2).alias("score"),
                F.col("l_extendedprice").alias("value"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"), F.col("l_quantity").alias("k5"))
    )


KEYS = ["k1", "k2", "k3", "k4", "k5"]


@queries("industry_average", f"""WITH {FACT_SQL}, best AS (
  SELECT * FROM fact WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY company, metric, yr ORDER BY score DESC, value DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC) = 1)
SELECT yr, metric, count(*) AS n, round(sum(value), 2) AS total FROM best GROUP BY yr, metric""")
def industry_average(spark, d):
    best = R.best_by_max(facts(spark, d).filter("score >= 0.6"), ["company", "metric", "yr"], ["score", "value"], KEYS)
    return best.groupBy("yr", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@queries("best_match_lowest", f"""WITH {FACT_SQL} SELECT company, metric, yr, score, round(value, 2) AS value FROM fact WHERE score >= 0.6
QUALIFY row_number() OVER (PARTITION BY company, metric, yr ORDER BY score, CAST(value AS VARCHAR), k1, k2, k3, k4, k5) = 1""")
def best_match_lowest(spark, d):
    """The parity form that keeps the lowest score, values ordered as text."""
    good = facts(spark, d).filter("score >= 0.6")
    best = R.best_per_key(good, ["company", "metric", "yr"], [F.col("score"), F.format_string("%s", "value"), *map(F.col, KEYS)])
    return best.select("company", "metric", "yr", "score", F.round("value", 2).alias("value"))


@queries("top_companies", f"""WITH {FACT_SQL}, s AS (SELECT company, metric, round(sum(value), 2) AS total FROM fact GROUP BY company, metric)
SELECT *, CAST(rank() OVER (PARTITION BY metric ORDER BY total DESC) AS INT) AS place FROM s""")
def top_companies(spark, d):
    sums = facts(spark, d).groupBy("company", "metric").agg(F.round(F.sum("value"), 2).alias("total"))
    return R.positions(sums, ["metric"], [F.desc("total")], "place", ties=True).withColumn("place", F.col("place").cast("int"))


@queries("share_of_disclosure", f"""WITH {FACT_SQL}, s AS (SELECT yr, metric, sum(value) AS v FROM fact GROUP BY yr, metric)
SELECT yr, metric, round(v / sum(v) OVER (PARTITION BY yr), 4) AS share FROM s""")
def share_of_disclosure(spark, d):
    return R.share_of_group(facts(spark, d), ["yr"], ["metric"], "value")


@queries("coverage_ratio", f"""WITH {FACT_SQL} SELECT yr, round(count(DISTINCT CASE WHEN score >= 0.8 THEN company END) / count(DISTINCT company), 4) AS coverage FROM fact GROUP BY yr""")
def coverage_ratio(spark, d):
    return R.coverage(facts(spark, d), ["yr"], "company", F.col("score") >= 0.8)


@queries("industries_mean", """WITH dim AS (
  SELECT c_mktsegment AS industry, CAST(c_custkey AS VARCHAR) AS identifier FROM customer UNION ALL SELECT c_mktsegment, c_name FROM customer)
SELECT d.industry, CAST(year(o_orderdate) AS INT) AS yr, o_orderpriority AS metric, round(avg(o_totalprice) + 1e-7, 2) AS mean_value
FROM orders JOIN dim d ON CAST(o_custkey AS VARCHAR) = d.identifier WHERE d.industry IS NOT NULL GROUP BY 1, 2, 3""")
def industries_mean(spark, d):
    dim = R.unpivot_identifiers(table(spark, d, "customer"), ["c_mktsegment"], ["c_custkey", "c_name"])
    orders = table(spark, d, "orders").withColumn("identifier", F.col("o_custkey").cast("string"))
    joined = orders.join(dim, "identifier").select(F.col("c_mktsegment").alias("industry"), F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("metric"), "o_totalprice")
    return joined.dropna(subset=["industry", "yr", "metric"]).groupBy("industry", "yr", "metric").agg(F.round(F.avg("o_totalprice") + 1e-7, 2).alias("mean_value"))


@queries("column_maxima", "SELECT user_id, max(event_id) AS event_id, max(ts) AS ts, max(event_type) AS event_type, max(value) AS value, max(props) AS props FROM events GROUP BY user_id")
def column_maxima(spark, d):
    return R.column_maxima(table(spark, d, "events"), ["user_id"])


@queries("company_profile", f"""WITH {FACT_SQL}, rows AS (
  SELECT company, metric, yr, score AS similarity, value, k1, k2, k3, k4, k5, 'table' AS kind FROM fact
  UNION ALL SELECT o_custkey, o_orderpriority, CAST(year(o_orderdate) AS INT), NULL, o_totalprice, o_orderkey, 0, 0, 0, 0, 'text' FROM orders),
best AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY company, metric, yr ORDER BY coalesce(similarity, 0) DESC, k1, k2, k3, k4, k5) = 1)
SELECT company, metric || ' (' || kind || ')' AS label, yr, round(value, 2) AS value FROM best QUALIFY row_number() OVER (PARTITION BY company, metric, kind ORDER BY yr) = 1""")
def company_profile(spark, d):
    """Union of two fact tables, best per company, metric and year, oldest year per label."""
    tables = facts(spark, d).withColumnRenamed("score", "similarity").withColumn("kind", F.lit("table"))
    orders = table(spark, d, "orders")
    texts = orders.select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("yr"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("k1"), F.lit("text").alias("kind"))
    both = tables.unionByName(texts, allowMissingColumns=True).fillna(0, ["k2", "k3", "k4", "k5"])
    best = R.best_per_key(both, ["company", "metric", "yr"], [F.coalesce("similarity", F.lit(0.0)).desc(), *map(F.col, KEYS)])
    oldest = R.best_per_key(best, ["company", "metric", "kind"], [F.col("yr")])
    return oldest.select("company", F.format_string("%s (%s)", "metric", "kind").alias("label"), "yr", F.round("value", 2).alias("value"))


@queries("compliance_matrix", """SELECT p_type AS metric, coalesce(max(CASE WHEN y = 1995 THEN 'yes' END), 'Not processed') AS y1995, coalesce(max(CASE WHEN y = 1996 THEN 'yes' END), 'Not processed') AS y1996,
  coalesce(max(CASE WHEN y = 1997 THEN 'yes' END), 'Not processed') AS y1997
FROM part LEFT JOIN (SELECT DISTINCT l_partkey, year(l_shipdate) AS y FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) ON l_partkey = p_partkey GROUP BY p_type""")
def compliance_matrix(spark, d):
    line = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey", F.year("l_shipdate").alias("y")).distinct()
    wide = table(spark, d, "part").join(line, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy(F.col("p_type").alias("metric")).pivot("y", [1995, 1996, 1997]).agg(F.max(F.lit("yes")))
    return wide.select("metric", *[F.coalesce(F.col(str(y)), F.lit("Not processed")).alias(f"y{y}") for y in (1995, 1996, 1997)])


@queries("kpi_verdict_metric", """WITH c AS (SELECT p_brand AS kpi, p_partkey, CASE WHEN p_size <= 10 THEN 'compulsory' WHEN p_size <= 30 THEN 'any' ELSE 'optional' END AS check_type FROM part),
r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50)
SELECT kpi, coalesce(bool_or(check_type IN ('any', 'compulsory') AND l_partkey IS NOT NULL), false) AND NOT coalesce(bool_or(check_type = 'compulsory' AND l_partkey IS NULL), false) AS complied,
  count(*) FILTER (check_type = 'compulsory' AND l_partkey IS NULL) AS missing
FROM c LEFT JOIN r ON p_partkey = l_partkey GROUP BY kpi""")
def kpi_verdict_metric(spark, d):
    kind = F.when(F.col("p_size") <= 10, "compulsory").when(F.col("p_size") <= 30, "any").otherwise("optional")
    checks = table(spark, d, "part").select(F.col("p_brand").alias("kpi"), "p_partkey", kind.alias("check_type"))
    reported = table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("there", F.lit(True))
    there = F.coalesce("there", F.lit(False))
    lacks = (F.col("check_type") == "compulsory") & ~there
    return checks.join(reported, "p_partkey", "left").groupBy("kpi").agg((F.bool_or(F.col("check_type").isin("any", "compulsory") & there) & ~F.bool_or(lacks)).alias("complied"), F.count_if(lacks).alias("missing"))


KEYWORDS = [("K1", "ring"), ("K2", "bolt"), ("K3", "zzz")]


@queries("kpi_verdict_text", """WITH k(kpi, keyword) AS (VALUES ('K1', 'ring'), ('K2', 'bolt'), ('K3', 'zzz')), h AS (SELECT DISTINCT p_name, kpi FROM part JOIN k ON contains(p_name, keyword))
SELECT k.kpi, count(h.p_name) AS sentences, count(h.p_name) > 0 AS complied FROM k LEFT JOIN h ON k.kpi = h.kpi GROUP BY k.kpi""")
def kpi_verdict_text(spark, d):
    words = spark.createDataFrame(KEYWORDS, "kpi string, keyword string")
    hits = table(spark, d, "part").join(F.broadcast(words), F.expr("contains(p_name, keyword)")).select("kpi", "p_name").distinct()
    return words.select("kpi").join(hits, "kpi", "left").groupBy("kpi").agg(F.count("p_name").alias("sentences"), (F.count("p_name") > 0).alias("complied"))


@queries("pending_company_years", """SELECT DISTINCT o_custkey AS company, CAST(year(o_orderdate) AS INT) AS yr FROM orders
WHERE (o_custkey, year(o_orderdate)) NOT IN (SELECT o_custkey, year(o_orderdate) FROM orders WHERE o_orderstatus = 'F')""")
def pending_company_years(spark, d):
    years = table(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("yr"), "o_orderstatus")
    return years.select("company", "yr").distinct().join(years.filter("o_orderstatus = 'F'").select("company", "yr"), ["company", "yr"], "left_anti")


@queries("kpi_prefix_counts", """SELECT c_mktsegment AS family, c_nationkey AS aspect, count(*) FILTER (c_acctbal > 0) AS complied FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def kpi_prefix_counts(spark, d):
    return table(spark, d, "customer").rollup(F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("aspect")).agg(F.count_if(F.col("c_acctbal") > 0).alias("complied"))


def _summary(spark, d):
    orders = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    old = orders.filter("yr < 1997").groupBy("o_custkey", "yr").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    new = orders.filter("yr >= 1996").groupBy("o_custkey", "yr").agg((F.count("*") + 1000).alias("n"), F.max("o_totalprice").alias("top"))
    return old, new


SUMMARY_SQL = """o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE year(o_orderdate) < 1997 GROUP BY 1, 2),
w AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS yr, count(*) + 1000 AS n, max(o_totalprice) AS top FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1, 2)"""


@queries("upsert_summary", f"WITH {SUMMARY_SQL} SELECT o_custkey, yr, coalesce(w.n, o.n) AS n, coalesce(w.top, o.top) AS top FROM o FULL JOIN w USING (o_custkey, yr)")
def upsert_summary(spark, d):
    old, new = _summary(spark, d)
    return R.upsert(old, new, ["o_custkey", "yr"])


@queries("replace_by_key", f"WITH {SUMMARY_SQL} SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM w) UNION ALL SELECT * FROM w")
def replace_by_key(spark, d):
    old, new = _summary(spark, d)
    return R.replace_by_key(old, new, ["o_custkey"])


@queries("insert_ignore", f"WITH {SUMMARY_SQL} SELECT * FROM o UNION ALL SELECT * FROM w WHERE (o_custkey, yr) NOT IN (SELECT o_custkey, yr FROM o)")
def insert_ignore(spark, d):
    old, new = _summary(spark, d)
    return R.insert_new(old, new, ["o_custkey", "yr"])


@queries("update_where", "SELECT id, CASE WHEN industry = 'Energy' THEN 'updated' ELSE sector END AS sector, industry FROM company_industry")
def update_where(spark, d):
    companies = table(spark, d, "company_industry").select("id", "sector", "industry")
    return R.update_where(companies, R.where(companies, industry="Energy"), {"sector": F.lit("updated")})


@queries("delete_where", "SELECT id, industry FROM company_industry WHERE industry IS NULL OR industry <> 'Energy'")
def delete_where(spark, d):
    companies = table(spark, d, "company_industry").select("id", "industry")
    return R.delete_where(companies, R.where(companies, industry="Energy"))


@queries("lookups", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice < 400000 AND contains(lower(o_orderpriority), 'low')")
def lookups(spark, d):
    orders = table(spark, d, "orders")
    return R.project(orders.filter(R.where(orders, o_orderstatus__in=["F", "O"], o_totalprice__gte=1000, o_totalprice__lt=400000, o_orderpriority__icontains="LOW")), ["o_orderkey"])


@queries("negated_disjunction", "SELECT id FROM company_industry WHERE NOT coalesce(industry = 'Energy' OR sector = 'Power', false)")
def negated_disjunction(spark, d):
    return table(spark, d, "company_industry").filter(R.negated((F.col("industry") == "Energy") | (F.col("sector") == "Power"))).select("id")


@queries("truthy_values", "SELECT id, converted_value FROM environment_info WHERE converted_value IS NOT NULL AND converted_value <> 0 AND similar_score >= 0.6")
def truthy_values(spark, d):
    return table(spark, d, "environment_info").filter("converted_value IS NOT NULL AND converted_value <> 0 AND similar_score >= 0.6").select("id", "converted_value")


@queries("include_exclude", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)energy|emission') AND NOT regexp_matches(text, '(?i)waste')")
def include_exclude(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike("(?i)energy|emission") & ~F.col("text").rlike("(?i)waste")).select("doc_id")


@queries("without_cjk", "SELECT doc_id, length(text) AS n FROM documents WHERE NOT regexp_matches(text, '[\\u4e00-\\u9fff]')".replace("\\u4e00", "一").replace("\\u9fff", "鿿"))
def without_cjk(spark, d):
    return table(spark, d, "documents").filter(~F.col("text").rlike(r"[一-鿿]")).select("doc_id", F.char_length("text").cast("bigint").alias("n"))


@queries("first_seen", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS first_seen FROM documents")
def first_seen(spark, d):
    return R.first_seen(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "first_seen")


@queries("containment_guard", "SELECT id FROM environment_info WHERE metric <> '' AND target_metric <> '' AND NOT (contains(metric, target_metric) OR contains(target_metric, metric))")
def containment_guard(spark, d):
    guard = ~(F.col("metric").contains(F.col("target_metric")) | F.col("target_metric").contains(F.col("metric")))
    return table(spark, d, "environment_info").filter((F.col("metric") != "") & (F.col("target_metric") != "") & guard).select("id")


@queries("relation_validator", """WITH v(head, tail, relation) AS (VALUES ('A', 'F', 'COLLECT'), ('N', 'O', 'NONE')),
  r AS (SELECT l_returnflag AS head, l_linestatus AS tail, CASE WHEN l_quantity > 25 THEN 'COLLECT' ELSE 'NONE' END AS relation, l_orderkey FROM lineitem)
SELECT r.relation, r.head, r.tail, count(*) AS n FROM r JOIN v ON r.relation = v.relation AND ((r.head = v.head AND r.tail = v.tail) OR (r.head = v.tail AND r.tail = v.head)) GROUP BY 1, 2, 3""")
def relation_validator(spark, d):
    valid = spark.createDataFrame([("A", "F", "COLLECT"), ("N", "O", "NONE")], "head string, tail string, relation string")
    both = valid.unionByName(valid.select(F.col("tail").alias("head"), F.col("head").alias("tail"), "relation")).distinct()
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("head"), F.col("l_linestatus").alias("tail"), F.when(F.col("l_quantity") > 25, "COLLECT").otherwise("NONE").alias("relation"))
    return rows.join(F.broadcast(both), ["head", "tail", "relation"]).groupBy("relation", "head", "tail").agg(F.count("*").alias("n"))


@queries("class_threshold", """WITH t(event_type, thr) AS (VALUES ('click', 10.0), ('view', 20.0), ('error', 5.0)) SELECT event_id FROM events JOIN t USING (event_type) WHERE value >= thr""")
def class_threshold(spark, d):
    limits = spark.createDataFrame([("click", 10.0), ("view", 20.0), ("error", 5.0)], "event_type string, thr double")
    return table(spark, d, "events").join(F.broadcast(limits), "event_type").filter("value >= thr").select("event_id")


@queries("unpivot_years", """WITH w AS (SELECT o_orderpriority, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1995), 2) AS y1995, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 2) AS y1996 FROM orders GROUP BY 1)
SELECT o_orderpriority AS metric, 1995 AS yr, y1995 AS value FROM w UNION ALL SELECT o_orderpriority, 1996, y1996 FROM w""")
def unpivot_years(spark, d):
    """Wide year columns back to rows; the year is read from the column's name."""
    wide = table(spark, d, "orders").withColumn("y", F.concat(F.lit("y"), F.year("o_orderdate"))).groupBy("o_orderpriority").pivot("y", ["y1995", "y1996"])
    made = wide.agg(F.round(F.sum("o_totalprice"), 2))
    long = made.unpivot(["o_orderpriority"], ["y1995", "y1996"], "name", "value")
    return long.select(F.col("o_orderpriority").alias("metric"), F.regexp_extract("name", r"((?:19|20)\d\d)", 1).cast("int").alias("yr"), "value")


@queries("or_join_as_union", "SELECT DISTINCT p.document_id FROM pdffiles p JOIN company_industry c ON p.company = c.company_name_ch OR p.company = c.company_name_en")
def or_join_as_union(spark, d):
    files, companies = table(spark, d, "pdffiles").select("document_id", "company"), table(spark, d, "company_industry").select("company_name_ch", "company_name_en")
    return R.any_of_equal(files, companies, [("company", "company_name_ch"), ("company", "company_name_en")], "document_id").select("document_id")


@queries("melt_join_distinct", "SELECT DISTINCT c.industry, p.document_id, company || '_' || coalesce(p.year, '') AS label FROM (SELECT industry, company_name_en AS n FROM company_industry UNION ALL SELECT industry, company_name_ch FROM company_industry) c JOIN pdffiles p ON p.company = c.n")
def melt_join_distinct(spark, d):
    names = table(spark, d, "company_industry").unpivot(["industry"], ["company_name_en", "company_name_ch"], "kind", "company").select("industry", "company")
    files = table(spark, d, "pdffiles").select("document_id", "company", "year")
    return names.join(files, "company").select("industry", "document_id", F.concat(F.col("company"), F.lit("_"), F.coalesce("year", F.lit(""))).alias("label")).distinct()


@queries("synonym_units", """WITH s AS (SELECT id, unnest(from_json(metric, '["VARCHAR"]')) AS synonym, unit FROM metric_schema), one AS (SELECT synonym, max(unit ORDER BY id DESC) AS x, arg_max(unit, id) AS unit FROM s GROUP BY synonym)
SELECT e.id, one.unit AS schema_unit FROM environment_info e LEFT JOIN one ON e.metric = one.synonym""")
def synonym_units(spark, d):
    """Each fact's unit by the dictionary's synonyms; of entries that share one the last counts."""
    words = table(spark, d, "metric_schema").select("id", "unit", F.explode(F.from_json("metric", "array<string>")).alias("metric"))
    last = words.groupBy("metric").agg(F.max_by("unit", "id").alias("schema_unit"))
    return table(spark, d, "environment_info").select("id", "metric").join(last, "metric", "left").select("id", "schema_unit")


@queries("metric_members", "SELECT id FROM environment_info WHERE target_metric IN (SELECT json_extract_string(metric, '$[0]') FROM metric_schema)")
def metric_members(spark, d):
    from ..sources.tables import listed

    return listed(table(spark, d, "environment_info"), table(spark, d, "metric_schema")).select("id")


@queries("derived_ratio", f"""WITH {FACT_SQL}, m AS (SELECT company, yr, metric, min(value) AS v FROM fact GROUP BY ALL)
SELECT a.company, a.yr, round(a.v / b.v, 6) AS ratio FROM m a JOIN m b ON a.company = b.company AND a.yr = b.yr AND a.metric = 'Brand#1' AND b.metric = 'Brand#2'""")
def derived_ratio(spark, d):
    return _wide_metrics(spark, d).dropna(subset=["a", "b"]).select("company", "yr", F.round(F.try_divide("a", "b"), 6).alias("ratio"))


def _wide_metrics(spark, d):
    wide = facts(spark, d).filter(F.col("metric").isin("Brand#1", "Brand#2")).groupBy("company", "yr")
    return wide.agg(F.min(F.when(F.col("metric") == "Brand#1", F.col("value"))).alias("a"), F.min(F.when(F.col("metric") == "Brand#2", F.col("value"))).alias("b"))


@queries("derived_sum", f"""WITH {FACT_SQL}, m AS (SELECT company, yr, metric, min(value) AS v FROM fact WHERE metric IN ('Brand#1', 'Brand#2') GROUP BY ALL)
SELECT company, yr, round(sum(v), 2) AS total FROM m GROUP BY company, yr HAVING count(DISTINCT metric) = 2""")
def derived_sum(spark, d):
    return _wide_metrics(spark, d).dropna(subset=["a", "b"]).select("company", "yr", F.round(F.col("a") + F.col("b"), 2).alias("total"))


@queries("derived_if_unreported", f"""WITH {FACT_SQL}, m AS (SELECT company, yr, metric, min(value) AS v FROM fact WHERE metric IN ('Brand#1', 'Brand#2') GROUP BY ALL),
s AS (SELECT company, yr, round(sum(v), 2) AS total FROM m GROUP BY company, yr HAVING count(DISTINCT metric) = 2)
SELECT * FROM s WHERE (company, yr) NOT IN (SELECT company, yr FROM fact WHERE metric = 'Brand#3')""")
def derived_if_unreported(spark, d):
    """The policy 'either': the derived metric only where it isn't reported."""
    reported = facts(spark, d).filter("metric = 'Brand#3'").select("company", "yr")
    return derived_sum(spark, d).join(reported, ["company", "yr"], "left_anti")


@queries("file_status", """SELECT document_id, status, top AS progress FROM (SELECT *, max(process1_progress) OVER (PARTITION BY document_id) AS top FROM pdffiles)
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY process1_update_date DESC NULLS LAST, process2_update_date DESC NULLS LAST, last_process_date DESC NULLS LAST, status DESC NULLS LAST) = 1""")
def file_status(spark, d):
    """The state of each document after its latest run and the most that any run reached.

    Runs of the same time go by the second process' time, the last time and the status; nulls come first, so runs
    without a time count only where a document has no other.
    """
    latest = F.struct("process1_update_date", "process2_update_date", "last_process_date", "status")
    return table(spark, d, "pdffiles").groupBy("document_id").agg(F.max_by("status", latest).alias("status"), F.max("process1_progress").alias("progress"))


@queries("upload_list", "SELECT document_id, max(filename) AS filename, strftime(max(uploaded_date), '%Y-%m-%d %H:%M:%S') AS uploaded FROM pdffiles GROUP BY document_id")
def upload_list(spark, d):
    return table(spark, d, "pdffiles").groupBy("document_id").agg(F.max("filename").alias("filename"), F.date_format(F.max("uploaded_date"), "yyyy-MM-dd HH:mm:ss").alias("uploaded"))


@queries("category_tree", "SELECT subject, target_aspect, list_sort(list(DISTINCT disclosure)) AS disclosures, count(*) AS metrics FROM metric_schema GROUP BY 1, 2")
def category_tree(spark, d):
    return table(spark, d, "metric_schema").groupBy("subject", "target_aspect").agg(F.array_sort(F.collect_set("disclosure")).alias("disclosures"), F.count("*").alias("metrics"))


@queries("nested_metrics", "SELECT subject, category, compulsory, count(*) AS n FROM metric_schema WHERE NOT coalesce(category = 'Intensity', false) GROUP BY ALL")
def nested_metrics(spark, d):
    return table(spark, d, "metric_schema").filter(R.negated(F.col("category") == "Intensity")).groupBy("subject", "category", "compulsory").agg(F.count("*").alias("n"))


@queries("heterogeneous_union", "SELECT id, company_name, metric, 'table' AS data_source FROM environment_info UNION ALL SELECT id, company_name, metric, 'text' FROM test_text_info")
def heterogeneous_union(spark, d):
    one = table(spark, d, "environment_info").select("id", "company_name", "metric", F.lit("table").alias("data_source"))
    return one.unionByName(table(spark, d, "test_text_info").select("id", "company_name", "metric", F.lit("text").alias("data_source")))


@queries("distinct_ordered", "SELECT DISTINCT industry, sector FROM company_industry ORDER BY industry, sector")
def distinct_ordered(spark, d):
    return table(spark, d, "company_industry").select("industry", "sector").distinct().orderBy("industry", "sector")


@queries("set_difference", "SELECT DISTINCT company_name FROM environment_info EXCEPT SELECT company_name FROM test_text_info")
def set_difference(spark, d):
    return table(spark, d, "environment_info").select("company_name").subtract(table(spark, d, "test_text_info").select("company_name"))


@queries("odd_corners", "SELECT x, y FROM (SELECT l_partkey % 97 AS x, l_suppkey % 89 AS y, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n % 2 = 1")
def odd_corners(spark, d):
    """Corner points met an odd number of times."""
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 97).alias("x"), (F.col("l_suppkey") % 89).alias("y")).agg(F.count("*").alias("n")).filter("n % 2 = 1").select("x", "y")


@queries("ordered_distinct", "SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def ordered_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"))
