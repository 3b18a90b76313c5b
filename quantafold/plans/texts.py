"""Queries of scalar functions on numbers, units, names and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.years import calendar_year
from ..sources.tables import table
from .register import Register

queries = Register()


@queries("parse_number", """SELECT id, coalesce(try_cast(trim(value) AS DOUBLE),
  try_cast(nullif(regexp_extract(trim(value), '^([-+]?\\d+(?:\\.\\d+)?) *[x×] *10(?:<s>)?([-+]?\\d+)(?:</s>)?$', 1), '') AS DOUBLE) * pow(10.0, try_cast(nullif(regexp_extract(trim(value), '^([-+]?\\d+(?:\\.\\d+)?) *[x×] *10(?:<s>)?([-+]?\\d+)(?:</s>)?$', 2), '') AS DOUBLE)),
  try_cast(nullif(regexp_replace(regexp_replace(value, '<s>[^<]*</s>', '', 'g'), '[^-\\d.]', '', 'g'), '') AS DOUBLE)) AS number FROM environment_info""")
def parse_number(spark, d):
    return table(spark, d, "environment_info").select("id", T.to_number("value").alias("number"))


@queries("percent_scale", """SELECT id, round(converted_value * CASE WHEN regexp_matches(unit, '^(?:%|％|pct|per ?cent)$') THEN 0.01::DOUBLE WHEN regexp_matches(unit, '^(?:‰|per mille)$') THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END, 6) AS fraction FROM environment_info""")
def percent_scale(spark, d):
    """The quantity of every row as a fraction where its unit is a share; null where it has none."""
    return table(spark, d, "environment_info").select("id", F.round(T.share_scale("converted_value", "unit"), 6).alias("fraction"))


@queries("unit_words", """SELECT id, (CASE WHEN regexp_matches(lower(unit), '\\bhundred\\b') THEN 100.0 ELSE 1.0 END * CASE WHEN regexp_matches(lower(unit), '\\bthousand\\b') THEN 1000.0 ELSE 1.0 END
  * CASE WHEN regexp_matches(lower(unit), '\\bmillion\\b') THEN 1000000.0 ELSE 1.0 END * CASE WHEN regexp_matches(lower(unit), '\\bbillion\\b') THEN 1000000000.0 ELSE 1.0 END)::DOUBLE AS factor FROM environment_info""")
def unit_words(spark, d):
    return table(spark, d, "environment_info").select("id", T.word_factor("unit").alias("factor"))


@queries("plain_units", """SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(unit, '</?s>|\\n', '', 'g'), 'm³|cubic met(?:re|er)s?', 'm3', 'g'), '(?i)hk\\$', 'HKD', 'g'), '(?i)\\b(?:rmb|yuan)\\b|¥', 'CNY', 'g'), '(?i)t ?co2-?e(?:q)?\\b', 'tCO2e', 'g')) AS plain FROM environment_info""")
def plain_units(spark, d):
    return table(spark, d, "environment_info").select("id", T.plain_unit("unit").alias("plain"))


@queries("plain_metrics", """SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(metric, '<s>[^<]*</s>', '', 'g'), '\\([^()]*\\)|（[^（）]*）', '', 'g'), '[\\n\\t\\r\\f ]+', ' ', 'g'), '^[ –—•-]+|[ –—•-]+$', '', 'g') AS plain FROM environment_info""")
def plain_metrics(spark, d):
    return table(spark, d, "environment_info").select("id", T.plain_metric("metric").alias("plain"))


# Words that tell what an intensity metric divides by.
PER = "intensity|density| per"
PER_UNIT = "/|intensity| per"
REVENUE = "RMB|HK|million|revenue"
PRODUCTION = "volume|produced|MWh/1,000 tonnes|barrel|m2|square meter|unit|capita"
STAFF = "employee|person"


@queries("metric_label", f"""WITH x AS (SELECT id, coalesce(metric, '') AS m FROM environment_info)
SELECT id, CASE WHEN NOT regexp_matches(m, '(?i){PER}') THEN 'not_intensity' WHEN regexp_matches(m, '(?i)per production') THEN 'per_production_intensity' WHEN regexp_matches(m, '(?i)per revenue') THEN 'per_revenue_intensity'
 WHEN regexp_matches(m, '(?i)per employee') THEN 'per_employee_intensity' ELSE 'intensity' END AS label FROM x""")
def metric_label(spark, d):
    return table(spark, d, "environment_info").select("id", T.metric_kind("metric").alias("label"))


@queries("metric_with_divisor", f"""WITH x AS (SELECT id, coalesce(metric, '') AS m, coalesce(unit, '') AS u FROM environment_info), y AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '<s>[^<]*</s>', '', 'g'), '\\([^()]*\\)|（[^（）]*）', '', 'g'), '[\\n\\t\\r\\f ]+', ' ', 'g'), '^[ –—•-]+|[ –—•-]+$', '', 'g') AS plain,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(m || ' ' || u, '<s>[^<]*</s>', '', 'g'), '\\([^()]*\\)|（[^（）]*）', '', 'g'), '[\\n\\t\\r\\f ]+', ' ', 'g'), '^[ –—•-]+|[ –—•-]+$', '', 'g') AS whole FROM x)
SELECT id, CASE WHEN NOT (regexp_matches(m, '(?i){PER}') OR regexp_matches(u, '(?i){PER_UNIT}')) THEN plain WHEN regexp_matches(m || u, '(?i){REVENUE}') THEN CASE WHEN regexp_matches(m, '(?i)MtCO2e') THEN plain ELSE plain || ' per revenue' END
 WHEN regexp_matches(m || u, '(?i){PRODUCTION}') THEN plain || ' per production' WHEN regexp_matches(m || u, '(?i){STAFF}') THEN plain || ' per employee' ELSE whole END AS named FROM y""")
def metric_with_divisor(spark, d):
    return table(spark, d, "environment_info").select("id", T.with_divisor("metric", "unit", PER, PER_UNIT, REVENUE, PRODUCTION, STAFF).alias("named"))


@queries("cell_value_unit", """WITH x AS (SELECT id, trim(value) AS v, metric AS m FROM environment_info)
SELECT id, CASE WHEN v IS NULL THEN NULL ELSE regexp_extract(v, '[-+]?[\\d,]+(?:\\.\\d+)?', 0) END AS number,
  coalesce(nullif(trim(regexp_extract(v, '\\(([^()]+)\\)\\s*$', 1)), ''), nullif(trim(regexp_extract(v, '^[-+~]?[\\d.,]+\\s*([^\\d\\s.,()*][^()]*)$', 1)), ''), nullif(trim(regexp_extract(m, '\\(([^()]+)\\)\\s*$', 1)), '')) AS unit FROM x""")
def cell_value_unit(spark, d):
    made = table(spark, d, "environment_info").select("id", T.split_cell("value", "metric").alias("s"))
    return made.select("id", "s.number", "s.unit")


@queries("filename_parse", """SELECT document_id, try_cast(nullif(regexp_extract(filename, '^(\\d{4,6})(?:\\D|$)', 1), '') AS INT) AS stock_id, list_min(list_transform(regexp_extract_all(filename, '((?:19|20)\\d\\d)', 1), lambda x: CAST(x AS INT))) AS yr,
  CASE WHEN regexp_matches(lower(filename), 'annual report|\\bar\\b') THEN 'annual' WHEN regexp_matches(lower(filename), 'carbon') THEN 'carbon' WHEN regexp_matches(lower(filename), 'esg|sustainab|environmental') THEN 'esg' ELSE 'other' END AS kind,
  CASE WHEN regexp_matches(filename, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM pdffiles""")
def filename_parse(spark, d):
    made = table(spark, d, "pdffiles").select("document_id", T.file_facts("filename").alias("f"))
    return made.select("document_id", "f.stock_id", F.col("f.year").alias("yr"), "f.kind", "f.language")


@queries("sentence_year", "SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1), '') AS INT), 1900) AS yr FROM documents")
def sentence_year(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentence_year("text", F.lit(1900)).alias("yr"))


@queries("text_clean", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '“”‘’', '""'''''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' +([,.;:!?])', '\\1', 'g'))) AS digest FROM documents""")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_text("text")).alias("digest"))


@queries("document_kind", """SELECT document_id, CASE WHEN regexp_matches(lower(filename), '\\bts\\b|term sheet') THEN 'term_sheet' WHEN regexp_matches(lower(filename), '\\bfa\\b|facility agreement') THEN 'agreement' WHEN regexp_matches(lower(filename), 'report') THEN 'report' ELSE 'other' END AS kind FROM pdffiles""")
def document_kind(spark, d):
    return table(spark, d, "pdffiles").select("document_id", T.document_kind("filename").alias("kind"))


@queries("edit_distance")
def edit_distance(spark, d):
    """Printed metric names within two edits of a metric's own name, by blocks of the first two characters and near length."""
    from ..sources.tables import own_names

    typed = table(spark, d, "environment_info").select(F.trim(F.lower("metric")).alias("typed")).filter("typed <> ''").distinct()
    own = own_names(table(spark, d, "metric_schema")).select(F.trim(F.lower("own_name")).alias("name"))
    pairs = typed.join(own, F.substring("typed", 1, 2) == F.substring("name", 1, 2)).filter(F.abs(F.char_length("typed") - F.char_length("name")) <= 2)
    return pairs.withColumn("distance", F.levenshtein("typed", "name", 2).cast("bigint")).filter("distance BETWEEN 0 AND 2")


@queries("sentence_counts", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[\s\p{Z}]+|([。！？])', '\1\2' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[^\s\p{Z}\x{200B}\x{FEFF}]'))) AS sentences FROM documents")
def sentence_counts(spark, d):
    """Sentences of every document; null for a null text, 0 for an empty or blank one."""
    return table(spark, d, "documents").select("doc_id", F.array_size(T.split_sentences("text")).cast("bigint").alias("sentences"))


@queries("tokens_exploded", """SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
def tokens_exploded(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''")
    # one row per document and word before the distinct count, so a frequent word's documents are counted in parts
    return words.groupBy("word", "doc_id").agg(F.count("*").alias("c")).groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@queries("bio_tags", """SELECT doc_id, pos, CASE WHEN pos = 0 THEN 'B-' ELSE 'I-' END || upper(block_element) AS tag FROM (
 SELECT doc_id, block_element, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents WHERE block_element IN ('title', 'caption') AND text <> '')""")
def bio_tags(spark, d):
    words = table(spark, d, "documents").filter("block_element IN ('title', 'caption') AND text <> ''").select("doc_id", "block_element", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.concat(F.when(F.col("pos") == 0, "B-").otherwise("I-"), F.upper("block_element")).alias("tag"))


@queries("stride_windows", """SELECT doc_id, CAST(start AS INT) AS first_char, length(substr(text, CAST(start + 1 AS INT), 512)) AS n FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 128)) AS start FROM documents WHERE text <> '')""")
def stride_windows(spark, d):
    """Sliding windows of 512 characters with a stride of 128 over whole texts."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.char_length("text"), F.lit(1)) - 1, F.lit(128))).alias("first_char")
    made = table(spark, d, "documents").filter("text <> ''").select("doc_id", "text", starts)
    return made.select("doc_id", "first_char", F.char_length(F.substring("text", F.col("first_char") + 1, F.lit(512))).cast("bigint").alias("n"))


@queries("number_measure_words", """WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)? (?:kg|tonnes|MWh|m3|persons)')) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n FROM m WHERE n > 0""")
def number_measure_words(spark, d):
    """Numbers followed by a measure at a gap of one blank."""
    found = F.size(F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)? (?:kg|tonnes|MWh|m3|persons))"), 1)).cast("bigint")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", found.alias("n")).filter("n > 0")


@queries("number_measure_keyword", """WITH t AS (SELECT event_id, user_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id FROM t WHERE a = 'view' AND b = 'click' AND c = 'purchase'""")
def number_measure_keyword(spark, d):
    """Three kinds of match in a row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").withColumn("b", F.lead("event_type", 1).over(w)).withColumn("c", F.lead("event_type", 2).over(w))
    return t.filter("event_type = 'view' AND b = 'click' AND c = 'purchase'").select("event_id", "user_id")


@queries("list_literals", "SELECT id, json_extract_string(metric, '$[0]') AS first_name, CAST(json_array_length(metric) AS INT) AS names FROM metric_schema")
def list_literals(spark, d):
    names = F.from_json("metric", "array<string>")
    return table(spark, d, "metric_schema").select("id", F.get(names, F.lit(0)).alias("first_name"), F.size(names).alias("names"))


@queries("json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@queries("grouped_lists", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id")
def grouped_lists(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@queries("dates", "SELECT event_id, strftime(ts, '%d/%m/%Y, %H:%M:%S') AS shown, make_date(year(ts)::BIGINT, 12, 31) AS year_end FROM events")
def dates(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy, HH:mm:ss").alias("shown"), F.make_date(F.year("ts"), F.lit(12), F.lit(31)).alias("year_end"))


@queries("si_convert", """SELECT u.unit, v.unit AS to_unit, round(u.factor / v.factor, 9) AS multiplier FROM unit_reference u JOIN unit_reference v ON u.dimension = v.dimension""")
def si_convert(spark, d):
    units = table(spark, d, "unit_reference")
    to = units.select("dimension", F.col("unit").alias("to_unit"), F.col("factor").alias("to_factor"))
    return units.join(to, "dimension").select("unit", "to_unit", F.round(F.col("factor") / F.col("to_factor"), 9).alias("multiplier"))


@queries("currency_year_end", """SELECT e.id, round(e.converted_value / f.hkd_per_unit, 4) AS usd FROM environment_info e JOIN fx_rate f ON f.currency = 'USD' AND f.rate_year = TRY_CAST(nullif(regexp_extract(e.year, '[0-9]{4}', 0), '') AS INT) WHERE e.converted_unit = 'HKD'""")
def currency_year_end(spark, d):
    """Amounts of any size in HKD at the rate of their year; null for a missing amount."""
    rates = table(spark, d, "fx_rate").filter("currency = 'USD'")
    facts = table(spark, d, "environment_info").filter("converted_unit = 'HKD'").withColumn("y", calendar_year("year"))
    return facts.join(rates, F.col("y") == F.col("rate_year")).select("id", F.round(F.col("converted_value") / F.col("hkd_per_unit"), 4).alias("usd"))


@queries("mask_prompt", "SELECT p_partkey, '<mask> ' || array_to_string(string_split(p_name, ' '), ' <mask> ') || ' <mask>' AS prompt FROM part")
def mask_prompt(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("<mask> "), F.array_join(F.split("p_name", " "), " <mask> "), F.lit(" <mask>")).alias("prompt"))


@queries("status_cut", "SELECT doc_id, CASE WHEN length(text) > 256 THEN substr(text, 1, 253) || '..' ELSE text END AS status FROM documents")
def status_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", T.status_text("text").alias("status"))


@queries("literal_positions", "SELECT p_partkey, instr(p_name, 'in') - 1 AS first_at FROM part WHERE contains(p_name, 'in')")
def literal_positions(spark, d):
    found = T.occurrences("p_name", "in")
    return table(spark, d, "part").select("p_partkey", F.get(found, F.lit(0))["start"].cast("bigint").alias("first_at")).filter("first_at IS NOT NULL")
