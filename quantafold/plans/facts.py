"""Queries over the facts of reports: what endpoints show, look-ups in the dictionary of metrics, verdicts and shares of progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators.units import bounded, convert_units
from ..sources.tables import own_names, present, table
from .register import Register

queries = Register()

NUMBER_SQL = r"""coalesce(try_cast(trim(value) AS DOUBLE),
  try_cast(nullif(regexp_extract(trim(value), '^([-+]?\d+(?:\.\d+)?) *[x×] *10(?:<s>)?([-+]?\d+)(?:</s>)?$', 1), '') AS DOUBLE) * pow(10.0, try_cast(nullif(regexp_extract(trim(value), '^([-+]?\d+(?:\.\d+)?) *[x×] *10(?:<s>)?([-+]?\d+)(?:</s>)?$', 2), '') AS DOUBLE)),
  try_cast(nullif(regexp_replace(regexp_replace(value, '<s>[^<]*</s>', '', 'g'), '[^-\d.]', '', 'g'), '') AS DOUBLE))"""
SYNONYM_SQL = """s AS (SELECT id, unnest(from_json(metric, '["VARCHAR"]')) AS synonym, subject, target_aspect, disclosure FROM metric_schema)"""


def synonyms(spark, d, *fields: str) -> DataFrame:
    """One row per synonym of the dictionary, with `seq`, its entry's id."""
    return table(spark, d, "metric_schema").select(F.col("id").alias("seq"), F.explode(F.from_json("metric", "array<string>")).alias("synonym"), *fields)


@queries("view_metrics", f"""WITH {SYNONYM_SQL}, one AS (SELECT synonym, arg_max(subject, id) AS subject FROM s GROUP BY synonym),
f AS (SELECT 'table' AS data_source, id, company_name, year, target_metric, {NUMBER_SQL} AS number FROM environment_info UNION ALL SELECT 'text', id, company_name, year, metric, {NUMBER_SQL} FROM test_text_info)
SELECT data_source, id, company_name, year, target_metric, one.subject, number, 'raw' AS type FROM f LEFT JOIN one ON f.target_metric = one.synonym WHERE number <> 0""")
def view_metrics(spark, d):
    """Facts of tables and texts that hold a number other than 0, with the subject of their metric; of entries that share a synonym the last counts."""
    last = synonyms(spark, d, "subject").groupBy(F.col("synonym").alias("target_metric")).agg(F.max_by("subject", "seq").alias("subject"))
    one = lambda name, kind, metric: table(spark, d, name).select(F.lit(kind).alias("data_source"), "id", "company_name", "year", F.col(metric).alias("target_metric"), T.to_number("value").alias("number"))
    both = one("environment_info", "table", "target_metric").unionByName(one("test_text_info", "text", "metric")).filter("number <> 0")
    return both.join(last, "target_metric", "left").select("data_source", "id", "company_name", "year", "target_metric", "subject", "number", F.lit("raw").alias("type"))


@queries("key_performance", """WITH k AS (SELECT json_extract_string(metric, '$[0]') AS target_metric FROM metric_schema WHERE compulsory)
SELECT id, company_name, target_metric, year FROM environment_info WHERE similar_score >= 0.6 AND target_metric IN (SELECT target_metric FROM k)
QUALIFY row_number() OVER (PARTITION BY company_name, target_metric, year ORDER BY similar_score, value NULLS LAST, unit NULLS LAST, id) = 1""")
def key_performance(spark, d):
    """Of each company, key metric and year the row of the lowest likeness from 0.6 on (values in order of their text)."""
    wanted = own_names(table(spark, d, "metric_schema").filter("compulsory")).select(F.col("own_name").alias("target_metric"))
    rows = table(spark, d, "environment_info").filter("similar_score >= 0.6").select("id", "company_name", "target_metric", "year", "similar_score", "value", "unit").join(wanted, "target_metric", "left_semi")
    first = F.struct("similar_score", F.col("value").isNull(), "value", F.col("unit").isNull(), "unit", "id")  # by partial minima: no sort of a hot company
    return rows.groupBy("company_name", "target_metric", "year").agg(F.min(first)["id"].alias("id")).select("id", "company_name", "target_metric", "year")


@queries("key_metrics")
def key_metrics(spark, d):
    """Facts of each document's file: the company and the least year of its name, and the quantity in the metric's common unit."""
    names = table(spark, d, "pdffiles").filter(present("document_id")).groupBy("document_id").agg(F.max("filename").alias("filename"))
    files = names.select("document_id", T.file_company("filename").alias("file_company"), T.file_facts("filename")["year"].alias("file_year"))
    facts = table(spark, d, "environment_info").select("id", "document_id", "value", "unit", "metric", "target_metric", "year")
    made = convert_units(facts, table(spark, d, "metric_schema"), table(spark, d, "unit_reference"), table(spark, d, "fx_rate"))
    return made.join(files, "document_id").select("id", "document_id", "file_company", "file_year", "target_metric", F.col("std_value").alias("converted_value"), F.col("std_unit").alias("converted_unit"))


@queries("schema_first_match", """WITH t AS (SELECT DISTINCT target_metric FROM environment_info WHERE target_metric <> '')
SELECT t.target_metric, s.subject, s.disclosure FROM t JOIN metric_schema s ON contains(lower(s.metric), lower(t.target_metric)) QUALIFY row_number() OVER (PARTITION BY t.target_metric ORDER BY s.metric DESC, s.id) = 1""")
def schema_first_match(spark, d):
    """The first entry, by descending list of names, whose list literal holds the target, case aside. Distinct targets meet a bounded dictionary."""
    entries = spark.createDataFrame(bounded(table(spark, d, "metric_schema").select("id", "metric", "subject", "disclosure"), 20_000, "metric_schema"), "id bigint, metric string, subject string, disclosure string")
    targets = table(spark, d, "environment_info").select("target_metric").filter(present("target_metric")).distinct()
    met = targets.join(F.broadcast(entries), F.contains(F.lower("metric"), F.lower("target_metric")))
    return met.groupBy("target_metric").agg(F.max_by(F.struct("subject", "disclosure"), F.struct("metric", -F.col("id"))).alias("m")).select("target_metric", "m.subject", "m.disclosure")


@queries("keyword_disclosure", f"""WITH {SYNONYM_SQL} SELECT e.id, one.disclosure, one.target_aspect, one.subject FROM environment_info e LEFT JOIN (SELECT synonym, arg_min(disclosure, id) AS disclosure, arg_min(target_aspect, id) AS target_aspect, arg_min(subject, id) AS subject FROM s GROUP BY synonym) one ON e.metric = one.synonym""")
def keyword_disclosure(spark, d):
    """The disclosure, aspect and subject of the first entry whose list holds the keyword; null where none does."""
    first = synonyms(spark, d, "disclosure", "target_aspect", "subject").groupBy(F.col("synonym").alias("metric")).agg(*[F.min_by(c, "seq").alias(c) for c in ("disclosure", "target_aspect", "subject")])
    return table(spark, d, "environment_info").select("id", "metric").join(first, "metric", "left").select("id", "disclosure", "target_aspect", "subject")


@queries("keyword_disclosures", f"""WITH {SYNONYM_SQL}, k AS (SELECT document_id, metric AS kw FROM environment_info WHERE document_id <> '' AND metric <> '' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY id) <= 3),
h AS (SELECT document_id, disclosure, min(s.id) AS seq FROM k JOIN s ON k.kw = s.synonym GROUP BY 1, 2) SELECT document_id, list(disclosure ORDER BY seq, disclosure) AS disclosures FROM h GROUP BY 1""")
def keyword_disclosures(spark, d):
    """The disclosures of a document's first three keywords, each once, in order of the dictionary."""
    rows = table(spark, d, "environment_info").filter(present("document_id") & present("metric")).select("document_id", "id", "metric")
    three = R.least_k(rows, ["document_id"], "id", 3, ["metric"]).select("document_id", F.col("metric").alias("synonym"))
    hits = three.join(synonyms(spark, d, "disclosure"), "synonym").groupBy("document_id", "disclosure").agg(F.min("seq").alias("seq"))
    return hits.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "disclosure"))), lambda x: x["disclosure"]).alias("disclosures"))


@queries("keyword_alternation", """WITH k AS (SELECT DISTINCT unnest([target_aspect, disclosure] || from_json(metric, '["VARCHAR"]')) AS kw FROM metric_schema), a AS (SELECT kw FROM k WHERE regexp_matches(kw, '^[ -~]+$'))
SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM a WHERE regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])' || regexp_escape(kw) || '(?:$|[^A-Za-z0-9_])'))""")
def keyword_alternation(spark, d):
    """Documents that hold a keyword of the dictionary (aspect, disclosure or name of a metric in Latin letters) as whole words: one pattern of
    all keywords, each with its own bounds."""
    words = table(spark, d, "metric_schema").select(F.explode(F.concat(F.array("target_aspect", "disclosure"), F.from_json("metric", "array<string>"))).alias("kw")).filter(F.col("kw").rlike("^[ -~]+$")).distinct()
    kept = sorted((r[0] for r in bounded(words, 20_000, "keywords")), key=lambda w: (-len(w), w))
    pattern = r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(rf"\Q{w}\E" for w in kept) + r")(?![A-Za-z0-9_])"
    docs = table(spark, d, "documents").select("doc_id", "text")
    return (docs.filter(F.col("text").rlike(pattern)) if kept else docs.limit(0)).select("doc_id")


@queries("numeric_only", "SELECT id, try_cast(value AS DOUBLE) AS number FROM environment_info WHERE try_cast(value AS DOUBLE) IS NOT NULL")
def numeric_only(spark, d):
    return table(spark, d, "environment_info").select("id", F.col("value").try_cast("double").alias("number")).dropna()


@queries("has_digit", r"SELECT id, coalesce(regexp_matches(metric, '\d'), false) AS digit FROM environment_info")
def has_digit(spark, d):
    return table(spark, d, "environment_info").select("id", F.coalesce(F.col("metric").rlike(r"\d"), F.lit(False)).alias("digit"))


@queries("icontains_any", "SELECT id FROM environment_info WHERE contains(lower(metric), 'waste') OR contains(lower(metric), 'water') OR contains(lower(metric), 'ghg')")
def icontains_any(spark, d):
    return table(spark, d, "environment_info").filter(R.any_contains("metric", ["Waste", "water", "GHG"])).select("id")


@queries("relation_head_only", """SELECT l_orderkey, l_linenumber, (l_returnflag = 'A' AND ((l_linestatus = 'F' AND l_quantity > 25) OR (l_linestatus = 'O' AND l_quantity <= 25))) AS valid FROM lineitem""")
def relation_head_only(spark, d):
    """Whether a relation may lead from its head's type to its tail's; the other way round doesn't count."""
    rows = table(spark, d, "lineitem").withColumn("relation", F.when(F.col("l_quantity") > 25, "collect").otherwise("none"))
    return rows.select("l_orderkey", "l_linenumber", R.valid_relation("l_returnflag", "relation", "l_linestatus", {("A", "collect"): ["F"], ("A", "none"): ["O"]}).alias("valid"))


@queries("aspect_verdicts", """WITH m AS (SELECT json_extract_string(metric, '$[0]') AS target_metric, target_aspect, coalesce(compulsory, false) AS must FROM metric_schema), r AS (SELECT DISTINCT company_name, target_metric FROM environment_info WHERE company_name <> ''),
c AS (SELECT DISTINCT company_name FROM environment_info WHERE company_name <> '')
SELECT c.company_name, m.target_aspect, bool_or(r.target_metric IS NOT NULL) AND NOT bool_or(must AND r.target_metric IS NULL) AS complied, count(*) FILTER (r.target_metric IS NOT NULL) AS reported,
 coalesce(list(m.target_metric ORDER BY m.target_metric) FILTER (must AND r.target_metric IS NULL), []) AS missing
FROM c CROSS JOIN m LEFT JOIN r ON r.company_name = c.company_name AND r.target_metric = m.target_metric GROUP BY 1, 2""")
def aspect_verdicts(spark, d):
    """Per company and aspect: whether anything is reported and nothing compulsory is missing, how many metrics are reported and which are missing.

    The checklist is bounded; what a company reports comes down to its distinct metrics before they're compared.
    """
    entries = table(spark, d, "metric_schema").select(F.get(F.from_json("metric", "array<string>"), F.lit(0)).alias("m"), "target_aspect", F.coalesce("compulsory", F.lit(False)).alias("must"))
    checklist = bounded(entries, 20_000, "metric_schema")
    facts = table(spark, d, "environment_info").filter(present("company_name")).select("company_name", "target_metric").distinct()
    reported = facts.groupBy("company_name").agg(F.collect_set(F.when(F.col("target_metric").isin([r.m for r in checklist if r.m]), F.col("target_metric"))).alias("has"))  # bounded by the checklist
    aspects = spark.createDataFrame([(a, sorted([r.m for r in checklist if r.target_aspect == a]), sorted([r.m for r in checklist if r.target_aspect == a and r.must])) for a in sorted({r.target_aspect for r in checklist})], "target_aspect string, all array<string>, must array<string>")
    made = reported.join(F.broadcast(aspects))
    missing, n = F.array_sort(F.filter("must", lambda m: ~F.array_contains("has", m))), F.size(F.filter("all", lambda m: F.array_contains("has", m)))
    return made.select("company_name", "target_aspect", ((n > 0) & (F.size(missing) == 0)).alias("complied"), n.cast("bigint").alias("reported"), missing.alias("missing"))


@queries("text_checklist", """WITH k AS (SELECT DISTINCT CASE WHEN compulsory THEN 'paragraph' ELSE 'list' END AS kind, target_aspect, lower(json_extract_string(metric, '$[1]')) AS keyword FROM metric_schema WHERE json_extract_string(metric, '$[1]') <> '')
SELECT k.target_aspect, k.keyword, count(DISTINCT d.doc_id) AS hits FROM k LEFT JOIN documents d ON d.block_element = k.kind AND contains(lower(d.text), k.keyword) GROUP BY 1, 2""")
def text_checklist(spark, d):
    """How many texts of the kind that each check names hold its keyword; checks without a hit have 0."""
    entry = table(spark, d, "metric_schema").select(F.when(F.col("compulsory"), "paragraph").otherwise("list").alias("kind"), "target_aspect", F.lower(F.get(F.from_json("metric", "array<string>"), F.lit(1))).alias("keyword")).filter(present("keyword")).distinct()
    checks = spark.createDataFrame(bounded(entry, 20_000, "checklist"), entry.schema)
    docs = table(spark, d, "documents").select("doc_id", F.col("block_element").alias("kind"), F.lower("text").alias("low"))
    hits = docs.join(F.broadcast(checks), "kind").filter(F.contains("low", "keyword")).groupBy("target_aspect", "keyword").agg(F.count_distinct("doc_id").alias("n"))
    return checks.select("target_aspect", "keyword").distinct().join(hits, ["target_aspect", "keyword"], "left").select("target_aspect", "keyword", F.coalesce("n", F.lit(0)).alias("hits"))


@queries("compliance_substring", """WITH y AS (SELECT DISTINCT year FROM environment_info WHERE year <> ''), f AS (SELECT DISTINCT year, target_metric FROM environment_info WHERE year <> '' AND target_metric <> '')
SELECT s.id, y.year, coalesce(bool_or(f.target_metric IS NOT NULL), false) AS reported FROM metric_schema s CROSS JOIN y LEFT JOIN f ON f.year = y.year AND contains(s.metric, f.target_metric) GROUP BY 1, 2""")
def compliance_substring(spark, d):
    """For each entry of the dictionary and year whether a fact's metric is part of the entry's list literal."""
    entries = spark.createDataFrame(bounded(table(spark, d, "metric_schema").select("id", "metric"), 20_000, "metric_schema"), "id bigint, metric string")
    facts = table(spark, d, "environment_info").filter(present("year")).select("year", "target_metric").distinct()
    named = facts.filter(present("target_metric")).join(F.broadcast(entries), F.contains("metric", "target_metric")).select("id", "year").distinct().withColumn("reported", F.lit(True))
    return facts.select("year").distinct().join(F.broadcast(entries.select("id"))).join(named, ["id", "year"], "left").select("id", "year", F.coalesce("reported", F.lit(False)).alias("reported"))


@queries("aspect_families", "SELECT substr(aspect_no, 1, 1) AS family, aspect_no, count(*) FILTER (compulsory) AS compulsory, count(*) AS n FROM metric_schema GROUP BY ROLLUP (substr(aspect_no, 1, 1), aspect_no)")
def aspect_families(spark, d):
    """Counts by number of aspect with subtotals by its letter."""
    return table(spark, d, "metric_schema").rollup(F.substring("aspect_no", 1, 1).alias("family"), F.col("aspect_no")).agg(F.count_if("compulsory").alias("compulsory"), F.count("*").alias("n"))


@queries("menu_tree", """WITH a AS (SELECT subject_no || '. ' || subject AS subject, aspect_no || ' ' || target_aspect AS aspect, min(id) AS seq FROM metric_schema GROUP BY 1, 2) SELECT subject, list(aspect ORDER BY seq, aspect) AS aspects, min(seq) AS first_id FROM a GROUP BY subject""")
def menu_tree(spark, d):
    """Numbered subjects with their numbered aspects in order of appearance."""
    label = lambda no, sep, name: F.concat(F.col(no), F.lit(sep), F.col(name))
    aspects = table(spark, d, "metric_schema").groupBy(label("subject_no", ". ", "subject").alias("subject"), label("aspect_no", " ", "target_aspect").alias("aspect")).agg(F.min("id").alias("seq"))
    return aspects.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "aspect"))), lambda x: x["aspect"]).alias("aspects"), F.min("seq").alias("first_id"))


@queries("progress_sum", """SELECT document_id, uploaded_date, process1_update_date, round(least(1.0, sum(coalesce(process1_progress, 0)) OVER (PARTITION BY document_id ORDER BY process1_update_date NULLS FIRST, process1_progress NULLS FIRST, status NULLS FIRST, filename NULLS FIRST ROWS UNBOUNDED PRECEDING)), 6) AS progress FROM pdffiles""")
def progress_sum(spark, d):
    """Progress added up over a document's runs, at most 1."""
    w = Window.partitionBy("document_id").orderBy("process1_update_date", "process1_progress", "status", "filename").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce("process1_progress", F.lit(0.0))).over(w)
    return table(spark, d, "pdffiles").select("document_id", "uploaded_date", "process1_update_date", F.round(F.least(F.lit(1.0), total), 6).alias("progress"))


@queries("default_order", "SELECT id, metric, disclosure FROM metric_schema ORDER BY metric DESC, id")
def default_order(spark, d):
    """The dictionary in its default order."""
    return table(spark, d, "metric_schema").orderBy(F.desc("metric"), "id").select("id", "metric", "disclosure")


@queries("first_row", "SELECT id, disclosure FROM metric_schema WHERE contains(lower(metric), 'waste') ORDER BY metric DESC, id LIMIT 1")
def first_row(spark, d):
    """The first row of a filter in the default order."""
    return table(spark, d, "metric_schema").filter(R.any_contains("metric", ["waste"])).orderBy(F.desc("metric"), "id").select("id", "disclosure").limit(1)


@queries("sorted_verdicts", "SELECT aspect_no, count(*) AS metrics FROM metric_schema GROUP BY aspect_no ORDER BY aspect_no")
def sorted_verdicts(spark, d):
    return table(spark, d, "metric_schema").groupBy("aspect_no").agg(F.count("*").alias("metrics")).orderBy("aspect_no")


@queries("seeded_choice", "SELECT target_aspect, arg_min(disclosure, md5(disclosure || '|' || '7')) AS chosen FROM metric_schema WHERE disclosure IS NOT NULL GROUP BY target_aspect")
def seeded_choice(spark, d):
    """One candidate per group, drawn by a hash of seed and candidate, so that a run again draws the same."""
    return table(spark, d, "metric_schema").filter("disclosure IS NOT NULL").groupBy("target_aspect").agg(F.min_by("disclosure", F.md5(F.concat("disclosure", F.lit("|7")))).alias("chosen"))


@queries("random_groups", "SELECT company_name, count(*) AS n FROM environment_info WHERE company_name IN (SELECT company_name FROM (SELECT DISTINCT company_name FROM environment_info WHERE company_name <> '') ORDER BY md5(company_name || '|7'), company_name LIMIT 10) GROUP BY company_name")
def random_groups(spark, d):
    """An evaluation sample of ten companies, drawn by a hash of seed and name."""
    names = table(spark, d, "environment_info").select("company_name").filter(present("company_name")).distinct()
    drawn = names.orderBy(F.md5(F.concat("company_name", F.lit("|7"))), "company_name").limit(10)
    return table(spark, d, "environment_info").select("company_name").join(drawn, "company_name").groupBy("company_name").agg(F.count("*").alias("n"))


@queries("random_k_per_group", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR) || '|7'), event_id) <= 3")
def random_k_per_group(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.struct(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("|7"))).alias("h"), F.col("event_id").alias("e")).alias("draw"))
    return R.least_k(rows, ["user_id"], "draw", 3, ["event_id"]).select("event_id")


@queries("group_sheet", """SELECT document_id, page_no, list(metric ORDER BY id) AS metrics FROM environment_info WHERE document_id <> '' AND metric <> '' GROUP BY 1, 2""")
def group_sheet(spark, d):
    """Metrics of each document's pages, in order, as rows of a sheet."""
    rows = table(spark, d, "environment_info").filter(present("document_id") & present("metric")).groupBy("document_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("id", "metric"))).alias("r"))
    return rows.select("document_id", "page_no", F.transform("r", lambda x: x["metric"]).alias("metrics"))


@queries("name_intersection", "SELECT DISTINCT company_name FROM environment_info WHERE company_name <> '' INTERSECT SELECT company_name FROM test_text_info")
def name_intersection(spark, d):
    return table(spark, d, "environment_info").select("company_name").filter(present("company_name")).intersect(table(spark, d, "test_text_info").select("company_name"))


@queries("subset_test", """WITH g AS (SELECT event_type, list(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT a.event_type AS inner_type, b.event_type AS outer_type, len(list_filter(a.users, lambda x: NOT list_contains(b.users, x))) = 0 AS within FROM g a JOIN g b ON a.event_type <> b.event_type""")
def subset_test(spark, d):
    """Whether the users of one kind of event are all among those of another: counts of an equi-join, no sets in one task."""
    pairs = table(spark, d, "events").select("event_type", "user_id").distinct()
    sizes = pairs.groupBy("event_type").agg(F.count("*").alias("n"))
    shared = pairs.alias("a").join(pairs.alias("b"), F.col("a.user_id") == F.col("b.user_id")).groupBy(F.col("a.event_type").alias("inner_type"), F.col("b.event_type").alias("outer_type")).agg(F.count("*").alias("both"))
    kinds = sizes.select(F.col("event_type").alias("inner_type"), "n").join(sizes.select(F.col("event_type").alias("outer_type")), F.col("inner_type") != F.col("outer_type"))
    return kinds.join(shared, ["inner_type", "outer_type"], "left").select("inner_type", "outer_type", (F.coalesce("both", F.lit(0)) == F.col("n")).alias("within"))


@queries("flat_distinct", """SELECT target_aspect, list_sort(list_distinct(flatten(list(from_json(metric, '["VARCHAR"]'))))) AS names FROM metric_schema GROUP BY target_aspect""")
def flat_distinct(spark, d):
    """The names of all metrics of an aspect, each once."""
    return table(spark, d, "metric_schema").groupBy("target_aspect").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.from_json("metric", "array<string>"))))).alias("names"))


@queries("map_lookup", """WITH m AS (SELECT user_id, list(event_id ORDER BY event_id) FILTER (event_type = 'click') AS clicks, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1) SELECT user_id, bought, CAST(coalesce(len(clicks), 0) AS INT) AS clicks FROM m""")
def map_lookup(spark, d):
    """A map of lists per user: whether it has a key, and the length of a list."""
    lists = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("ids")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ids"))).alias("m"))
    return lists.select("user_id", F.map_contains_key("m", "purchase").alias("bought"), F.coalesce(F.size(F.try_element_at("m", F.lit("click"))), F.lit(0)).alias("clicks"))


@queries("zip_to_map", "SELECT user_id, event_type, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def zip_to_map(spark, d):
    """Keys and values zipped to a map in which the last of a key wins, and read out again."""
    lists = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("v")).groupBy("user_id").agg(F.collect_list(F.struct("event_type", "v")).alias("kv"))
    zipped = lists.select("user_id", F.map_from_arrays(F.transform("kv", lambda x: x["event_type"]), F.transform("kv", lambda x: x["v"])).alias("m"))
    return zipped.select("user_id", F.explode("m").alias("event_type", "last_id"))


@queries("json_navigation", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS fields FROM events""")
def json_navigation(spark, d):
    """A document of unknown fields read to a map and navigated."""
    m = F.from_json("props", "map<string, string>")
    return table(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).try_cast("bigint").alias("k"), F.size(F.map_keys(m)).cast("bigint").alias("fields"))


@queries("unit_ladder", """WITH m AS (SELECT json_extract_string(metric, '$[0]') AS target_metric, coalesce(json_extract_string(CASE WHEN unit LIKE '[%' THEN unit END, '$[0]'), unit) AS common FROM metric_schema), p AS (SELECT DISTINCT e.unit, m.common FROM environment_info e JOIN m USING (target_metric) WHERE e.unit <> '')
SELECT p.unit, p.common, coalesce(CASE WHEN 1 - levenshtein(lower(p.unit), lower(p.common)) / greatest(length(p.unit), length(p.common)) >= 0.8 THEN 1.0::DOUBLE END, a.factor / b.factor, f.hkd_per_unit) AS multiplier
FROM p LEFT JOIN unit_reference a ON a.unit = p.unit LEFT JOIN unit_reference b ON b.unit = p.common AND b.dimension = a.dimension LEFT JOIN fx_rate f ON f.currency = p.unit AND f.rate_year = 2015 AND p.common = 'HKD'""")
def unit_ladder(spark, d):
    """The multiplier of each unit as stated: 1 for a name nearly the common unit's, else by the reference, else by the rate of a currency, else null."""
    common = own_names(table(spark, d, "metric_schema")).select(F.col("own_name").alias("target_metric"), F.col("common_unit").alias("common"))
    pairs = table(spark, d, "environment_info").filter(present("unit")).select("unit", "target_metric").distinct().join(common, "target_metric").select("unit", "common").distinct()
    reference = table(spark, d, "unit_reference")
    own = reference.select("unit", F.col("dimension").alias("d"), F.col("factor").alias("a"))
    to = reference.select(F.col("unit").alias("common"), F.col("dimension").alias("e"), F.col("factor").alias("b"))
    rates = table(spark, d, "fx_rate").filter("rate_year = 2015").select(F.col("currency").alias("unit"), "hkd_per_unit")
    near = 1 - F.levenshtein(F.lower("unit"), F.lower("common")) / F.greatest(F.char_length("unit"), F.char_length("common")) >= 0.8
    made = pairs.join(own, "unit", "left").join(to, "common", "left").join(rates, "unit", "left")
    return made.select("unit", "common", F.coalesce(F.when(near, 1.0), F.when(F.col("d") == F.col("e"), F.col("a") / F.col("b")), F.when(F.col("common") == "HKD", F.col("hkd_per_unit"))).alias("multiplier"))


@queries("intensity_split", r"""WITH u AS (SELECT DISTINCT unit FROM environment_info WHERE regexp_matches(unit, ' per |/')), s AS (SELECT unit, trim(regexp_extract(unit, '^(.*?)(?: per |/)(.*)$', 1)) AS base, trim(regexp_extract(unit, '^(.*?)(?: per |/)(.*)$', 2)) AS divisor FROM u)
SELECT s.unit, s.base, s.divisor, a.factor AS base_factor FROM s LEFT JOIN unit_reference a ON a.unit = s.base""")
def intensity_split(spark, d):
    """Intensity units split at their sign of division, with the factor of what is divided."""
    units = table(spark, d, "environment_info").select("unit").filter(F.col("unit").rlike(" per |/")).distinct()
    part = lambda k: F.trim(F.regexp_extract("unit", r"^(.*?)(?: per |/)(.*)$", k))
    factors = table(spark, d, "unit_reference").select(F.col("unit").alias("base"), F.col("factor").alias("base_factor"))
    return units.select("unit", part(1).alias("base"), part(2).alias("divisor")).join(factors, "base", "left").select("unit", "base", "divisor", "base_factor")


@queries("artefact_grid", """WITH t(task) AS (VALUES ('process1'), ('process2')), f AS (SELECT DISTINCT document_id FROM pdffiles WHERE document_id <> ''), r AS (SELECT document_id, 'process1' AS task FROM pdffiles WHERE process1_status = 'completed' UNION SELECT document_id, 'process2' FROM pdffiles WHERE process2_status = 'completed')
SELECT f.document_id, t.task, r.document_id IS NOT NULL AS there FROM f CROSS JOIN t LEFT JOIN r ON r.document_id = f.document_id AND r.task = t.task""")
def artefact_grid(spark, d):
    """For each document and task whether its artefact is there."""
    files = table(spark, d, "pdffiles").filter(present("document_id"))
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.coalesce(F.col(f"{t}_status") == "completed", F.lit(False)).alias("done")) for t in ("process1", "process2")])).alias("k")
    return files.select("document_id", kinds).groupBy("document_id", "k.task").agg(F.bool_or("k.done").alias("there"))


@queries("upsert_from_rows", "SELECT coalesce(b.id, a.id) AS id, coalesce(b.sector, a.sector) AS sector FROM (SELECT id, sector FROM company_industry) a FULL JOIN (SELECT max(id) AS id, max('S' || sector) AS sector FROM company_industry WHERE sector IS NOT NULL GROUP BY stock_id UNION ALL SELECT id + 1000000000, sector FROM company_industry) b USING (id)")
def upsert_from_rows(spark, d):
    """Rows of a file merged into a table by key: known keys are updated, others added."""
    own = table(spark, d, "company_industry").select("id", "stock_id", "sector")
    changed = own.filter("sector IS NOT NULL").groupBy("stock_id").agg(F.max("id").alias("id"), F.max(F.concat(F.lit("S"), "sector")).alias("sector")).select("id", "sector")
    return R.upsert(own.select("id", "sector"), changed.unionByName(own.select((F.col("id") + 1000000000).alias("id"), "sector")), ["id"])


@queries("document_counts", """SELECT document_id, count(DISTINCT page_id) AS pages, count(*) AS items, count(DISTINCT block_element) AS styles, sum(coalesce(length(text), 0)) AS chars FROM documents WHERE document_id <> '' GROUP BY document_id""")
def document_counts(spark, d):
    """Pages, items, kinds of blocks and characters of each document."""
    return table(spark, d, "documents").filter(present("document_id")).groupBy("document_id").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("items"), F.count_distinct("block_element").alias("styles"), F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"))
