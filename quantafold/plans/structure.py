"""Queries of texts and of the structure of documents: fragments, positions, tags, headings, nested and flat forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scorers
from ..functions import text as T
from ..operators import layout as L
from ..operators import relational as R
from ..sources.tables import present, table
from .register import Register

queries = Register()
ORDER = ["ts", "event_id"]
NUMBER_UNIT = r"\d+(?:\.\d+)? (?:kg|tonnes|MWh|m3|persons)"


@queries("split_around", "SELECT doc_id, len(string_split(text, 'energy')) AS fragments, md5(array_to_string(string_split(text, 'energy'), '|')) AS digest FROM documents WHERE text IS NOT NULL")
def split_around(spark, d):
    """Texts split around an entity, the order of the fragments kept."""
    parts = T.around("text", "energy")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(parts).cast("bigint").alias("fragments"), F.md5(F.array_join(parts, "|")).alias("digest"))


@queries("ordered_fragments", """WITH p AS (SELECT doc_id, string_split(text, 'energy') AS parts FROM documents WHERE contains(text, 'energy')), x AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
f AS (SELECT doc_id, i, length(parts[i]) AS n, CAST(coalesce(list_sum(list_transform(parts[1:i - 1], lambda s: length(s))), 0) + (i - 1) * 6 AS BIGINT) AS start, len(parts) AS k FROM x)
SELECT doc_id, 'normal' AS kind, start AS start_, start + n AS end_ FROM f WHERE n > 0 UNION ALL SELECT doc_id, 'entity', start + n, start + n + 6 FROM f WHERE i < k""")
def ordered_fragments(spark, d):
    """Fragments and entities of a text with their positions, in order."""
    docs = table(spark, d, "documents").filter(F.contains("text", F.lit("energy")))
    return docs.select("doc_id", F.explode(T.fragments("text", "energy")).alias("f")).select("doc_id", F.col("f.kind").alias("kind"), F.col("f.start").cast("bigint").alias("start_"), F.col("f.end").cast("bigint").alias("end_"))


@queries("pattern_positions", rf"""WITH p AS (SELECT doc_id, string_split_regex(text, '{NUMBER_UNIT}') AS parts, regexp_extract_all(text, '{NUMBER_UNIT}') AS found FROM documents WHERE regexp_matches(text, '{NUMBER_UNIT}')), x AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM p)
SELECT doc_id, found[i] AS match, CAST(list_sum(list_transform(parts[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS first_at, CAST(list_sum(list_transform(parts[1:i], lambda s: length(s))) + list_sum(list_transform(found[1:i], lambda s: length(s))) - 1 AS BIGINT) AS last_at FROM x""")
def pattern_positions(spark, d):
    """Matches of a pattern with their first and last character."""
    docs = table(spark, d, "documents").filter(F.col("text").rlike(NUMBER_UNIT))
    made = docs.select("doc_id", F.explode(T.matches("text", NUMBER_UNIT)).alias("m"))
    return made.select("doc_id", F.col("m.match").alias("match"), F.col("m.first").cast("bigint").alias("first_at"), F.col("m.last").cast("bigint").alias("last_at"))


@queries("marks_replaced", r"SELECT doc_id, md5(regexp_replace(text, '[\x{2500}-\x{25FF}\x{E000}-\x{F8FF}]', '_', 'g')) AS digest FROM documents")
def marks_replaced(spark, d):
    """Box drawing, block, geometric and private-use characters become underscores."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.without_marks("text")).alias("digest"))


@queries("camel_case", r"SELECT doc_id, regexp_replace(substr(text, 1, 10000000), '([a-z])([A-Z])', '\1 \2', 'g') = text AS plain FROM documents WHERE text IS NOT NULL")
def camel_case(spark, d):
    """Whether a text holds no words run together in camel case."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", (T.camel_split("text") == F.col("text")).alias("plain"))


@queries("no_punctuation", r"SELECT doc_id, md5(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS digest FROM documents")
def no_punctuation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.without_punctuation("text")).alias("digest"))


@queries("spaced_variants", "SELECT p_partkey, list_transform(range(1, length(p_type)), lambda i: substr(p_type, 1, i) || ' ' || substr(p_type, i + 1)) AS variants FROM part WHERE length(p_type) > 1")
def spaced_variants(spark, d):
    """The forms of a word with a blank at each place within."""
    return table(spark, d, "part").filter(F.char_length("p_type") > 1).select("p_partkey", T.spaced("p_type").alias("variants"))


@queries("phrases", r"SELECT doc_id, len(list_filter(string_split_regex(text, ';\s*|\s+(?:and|or)\s+'), lambda s: trim(s) <> '')) AS phrases FROM documents WHERE text IS NOT NULL")
def phrases(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(T.phrases("text")).cast("bigint").alias("phrases"))


@queries("superscript_tags", r"SELECT id, regexp_replace(unit, '\b(m|CO)([23])', '\1<s>\2</s>', 'g') AS tagged FROM environment_info")
def superscript_tags(spark, d):
    return table(spark, d, "environment_info").select("id", T.tag_raised("unit").alias("tagged"))


@queries("ascii_names")
def ascii_names(spark, d):
    """Names decomposed by compatibility and stripped to ASCII."""
    return table(spark, d, "environment_info").select("metric").filter(present("metric")).distinct().select("metric", T.ascii_of("metric").alias("plain"))


@queries("bioes_tags", """WITH w AS (SELECT doc_id, upper(block_element) AS b, len(string_split(text, ' ')) AS n, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents WHERE block_element IN ('title', 'caption') AND text <> '')
SELECT doc_id, pos, CASE WHEN n = 1 THEN 'S-' WHEN pos = 0 THEN 'B-' WHEN pos = n - 1 THEN 'E-' ELSE 'I-' END || b AS tag FROM w""")
def bioes_tags(spark, d):
    words = F.split("text", " ")
    docs = table(spark, d, "documents").filter("block_element IN ('title', 'caption') AND text <> ''").select("doc_id", F.upper("block_element").alias("b"), F.size(words).alias("n"), F.posexplode(words).alias("pos", "w"))
    return docs.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.concat(T.bioes("pos", "n"), F.col("b")).alias("tag"))


@queries("joined_spans", "SELECT document_id, page_id, md5(string_agg(text, ' ' ORDER BY doc_id)) AS digest FROM documents WHERE document_id <> '' AND text IS NOT NULL AND NOT regexp_matches(text, '^[0-9]+$') GROUP BY 1, 2")
def joined_spans(spark, d):
    """Spans of a page joined in order, those of digits only left out."""
    rows = table(spark, d, "documents").filter(present("document_id") & F.col("text").isNotNull() & ~F.col("text").rlike("^[0-9]+$")).groupBy("document_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("s"))
    return rows.select("document_id", "page_id", F.md5(F.array_join(F.transform("s", lambda x: x["text"]), " ")).alias("digest"))


@queries("relation_number_unit", r"""WITH x AS (SELECT doc_id, lower(text) AS t, regexp_extract(text, '(\d+(?:\.\d+)?) (kg|tonnes|MWh|m3|persons)', 1) AS v, regexp_extract(text, '(\d+(?:\.\d+)?) (kg|tonnes|MWh|m3|persons)', 2) AS unit FROM documents WHERE length(text) < 100000000)
SELECT doc_id, CASE WHEN regexp_matches(t, 'increas\w*\b.*\bby\b') THEN 'increased_by' WHEN regexp_matches(t, '(?:decreas|reduc|drop|down)\w*\b.*\bby\b') THEN 'reduced_by' WHEN regexp_matches(t, '\bno less than\b') THEN 'more than' WHEN regexp_matches(t, '\bno more than\b') THEN 'less than'
 WHEN regexp_matches(t, '\b(?:over|more than|above|at least)\b') THEN 'more than' WHEN regexp_matches(t, '\b(?:less than|up to|below|under)\b') THEN 'less than' WHEN regexp_matches(t, '\b(?:approximately|approx|about|around)\b|~') THEN 'approximate' ELSE 'equal' END AS relation, CAST(v AS DOUBLE) AS number, unit FROM x WHERE v <> ''""")
def relation_number_unit(spark, d):
    """How a text relates its first quantity, the number and its unit."""
    q = T.quantity_in("text", "kg|tonnes|MWh|m3|persons")
    return table(spark, d, "documents").select("doc_id", T.relation_of("text").alias("relation"), q.alias("q")).filter("q IS NOT NULL").select("doc_id", "relation", "q.number", "q.unit")


@queries("unit_powers", r"""SELECT id, similar_score * CASE WHEN id % 3 = 0 THEN pow(10.0::DOUBLE, id % 5) ELSE 1.0::DOUBLE END AS scaled FROM environment_info WHERE similar_score IS NOT NULL""")
def unit_powers(spark, d):
    """Values whose unit begins with a power of ten."""
    unit = F.when(F.col("id") % 3 == 0, F.concat(F.lit("10<s>"), (F.col("id") % 5).cast("string"), F.lit("</s> t"))).otherwise("t")
    return table(spark, d, "environment_info").filter("similar_score IS NOT NULL").select("id", T.unit_power("similar_score", unit).alias("scaled"))


@queries("ranges", "SELECT l_orderkey, l_linenumber, l_partkey, least(l_suppkey, l_partkey)::DOUBLE AS low, greatest(l_suppkey, l_partkey)::DOUBLE AS high FROM lineitem")
def ranges(spark, d):
    """Ranges written as text, read to two numbers."""
    written = F.concat(F.least("l_suppkey", "l_partkey").cast("string"), F.lit(" - "), F.greatest("l_suppkey", "l_partkey").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.range_of(written).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "r.low", "r.high")


@queries("relations", r"""WITH x AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN regexp_matches(t, 'increas\w*\b.*\bby\b') THEN 'increased_by' WHEN regexp_matches(t, '(?:decreas|reduc|drop|down)\w*\b.*\bby\b') THEN 'reduced_by' ELSE 'other' END AS change FROM x""")
def relations(spark, d):
    found = T.relation_of("text")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.when(found.isin("increased_by", "reduced_by"), found).otherwise("other").alias("change"))


ROMAN_SQL = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII']"


@queries("roman_numbers", f"SELECT event_id, CAST(event_id % 12 + 1 AS INT) AS number FROM events")
def roman_numbers(spark, d):
    """Roman numerals read to numbers."""
    written = F.get(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")]), (F.col("event_id") % 12).cast("int"))
    return table(spark, d, "events").select("event_id", T.roman(written).alias("number"))


@queries("next_labels", """SELECT event_id, (event_id % 3 = 0) AS follows FROM events""")
def next_labels(spark, d):
    """Whether a label follows another, as numbers, letters or roman numerals."""
    k, step = (F.col("event_id") % 11).cast("int"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(2)
    roman = F.array(*[F.lit(x) for x in ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv")])
    letters = F.array(*[F.lit(chr(97 + i)) for i in range(14)])
    pick = lambda i: F.when(F.col("event_id") % 2 == 0, (i + 1).cast("string")).when(F.col("event_id") % 5 == 0, F.get(roman, i)).otherwise(F.get(letters, i))
    kind = F.when(F.col("event_id") % 2 == 0, "number").when(F.col("event_id") % 5 == 0, "roman").otherwise("letter")
    return table(spark, d, "events").select("event_id", T.follows(pick(k), pick(k + step), kind).alias("follows"))


@queries("longest_matches", """WITH m AS (SELECT l_orderkey, l_partkey % 200 AS a, l_partkey % 200 + CAST(l_quantity AS INT) AS b FROM lineitem), u AS (SELECT DISTINCT * FROM m) SELECT x.l_orderkey, x.a AS first_at, x.b AS last_at FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.l_orderkey = x.l_orderkey AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b))""")
def longest_matches(spark, d):
    """Matches that lie within no longer one: by the furthest end of those that begin before, no pair is compared."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("first_at"), (F.col("l_partkey") % 200 + F.col("l_quantity").cast("int")).alias("last_at")).distinct()
    return L.longest(rows, ["l_orderkey"], "first_at", "last_at")


@queries("numbered_clauses")
def numbered_clauses(spark, d):
    """The numbered clauses of texts with their level."""
    return L.clauses(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@queries("clauses_joined", r"SELECT doc_id, true AS whole FROM documents WHERE regexp_matches(text, '\S')")
def clauses_joined(spark, d):
    """Clauses joined again give the text, blanks aside."""
    parts = L.clauses(table(spark, d, "documents").filter(F.col("text").rlike(r"\S")).select("doc_id", "text"), "doc_id", "text")
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label", "clause"))), lambda x: F.concat(x["label"], x["clause"])), "").alias("back"))
    squeezed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return joined.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", (squeezed("back") == squeezed("text")).alias("whole"))


@queries("section_levels", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '^\d+\.\d+\.\d+') THEN 'section 3' WHEN regexp_matches(text, '^\d+\.\d+') THEN 'section 2' WHEN regexp_matches(text, '^\d+\.? ') THEN 'section 1' ELSE coalesce(block_element, 'none') END AS level FROM documents""")
def section_levels(spark, d):
    """The level of a section by the depth of its number, else the kind of block."""
    return table(spark, d, "documents").select("doc_id", T.section_level("text", F.coalesce("block_element", F.lit("none"))).alias("level"))


@queries("style_ranks", """WITH s AS (SELECT l_orderkey AS page, CAST(l_quantity AS INT) // 10 AS size, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT page, arg_max(size, (n, -size)) AS body FROM s GROUP BY 1)
SELECT s.page, s.size, n, CASE WHEN s.size > body THEN 'heading' WHEN s.size < body THEN 'note' ELSE 'paragraph' END AS kind, dense_rank() OVER (PARTITION BY s.page ORDER BY s.size DESC) AS rank_ FROM s JOIN b USING (page)""")
def style_ranks(spark, d):
    """Sizes of letters on a page ranked; the commonest is the paragraphs', larger ones head, smaller ones annotate."""
    sizes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.floor(F.col("l_quantity").cast("int") / 10).cast("int").alias("size"))
    return L.rank_styles(sizes, ["page"], "size").select("page", "size", "n", "kind", F.col("rank").cast("bigint").alias("rank_"))


@queries("style_usage", "SELECT lang, block_element, count(*) AS n, min(doc_id) AS first_id, CAST(row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS INT) AS place FROM documents GROUP BY 1, 2")
def style_usage(spark, d):
    """Styles by use, the commonest first, ties by the first seen. A row per style is ranked."""
    used = table(spark, d, "documents").groupBy("lang", "block_element").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return used.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_id")))


@queries("spacing_modes", """WITH g AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS gap, count(*) AS n, min(event_id) AS k FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT user_id, arg_max(gap, (n, -k)) AS mode, max(gap) AS most, min(gap) AS least FROM g GROUP BY 1""")
def spacing_modes(spark, d):
    """The commonest spacing of a page (ties by the first seen), the largest and the least."""
    gaps = table(spark, d, "events").filter("value IS NOT NULL").groupBy("user_id", F.floor("value").alias("gap")).agg(F.count("*").alias("n"), F.min("event_id").alias("k"))
    return gaps.groupBy("user_id").agg(F.max_by("gap", F.struct("n", (-F.col("k")).alias("k"))).alias("mode"), F.max("gap").alias("most"), F.min("gap").alias("least"))


@queries("neighbourhood_tags", """WITH p AS (SELECT doc_id, document_id, block_element AS tag, row_number() OVER (PARTITION BY document_id ORDER BY doc_id) AS k FROM documents WHERE document_id <> ''), n AS (SELECT a.doc_id, b.tag, count(*) AS n FROM p a JOIN p b ON a.document_id = b.document_id AND abs(a.k - b.k) BETWEEN 1 AND 2 AND b.tag <> '' AND b.tag <> 'title' GROUP BY 1, 2)
SELECT doc_id, arg_max(tag, (n, tag)) AS tag FROM n GROUP BY 1""")
def neighbourhood_tags(spark, d):
    """The commonest tag of the two blocks before and behind, titles left out."""
    return L.neighbourhood_mode(table(spark, d, "documents").filter(present("document_id")), ["document_id"], "doc_id", "block_element", 2, ["title"])


@queries("block_segments", """WITH w AS (SELECT doc_id, document_id, page_id, block_element AS t, lag(block_element) OVER v AS b, lag(page_id) OVER v AS bp, row_number() OVER v AS k FROM documents WHERE document_id <> '' WINDOW v AS (PARTITION BY document_id ORDER BY doc_id)),
f AS (SELECT *, CASE WHEN coalesce((b = 'title' AND t = 'paragraph') OR (b = 'paragraph' AND t IN ('list', 'caption')) OR (b = 'list' AND t = 'list'), false) AND (page_id IS NOT DISTINCT FROM bp OR coalesce(t = 'list', false)) THEN 0 ELSE 1 END AS s FROM w)
SELECT doc_id, CAST(sum(s) OVER (PARTITION BY document_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM f""")
def block_segments(spark, d):
    """Blocks by which tag may follow which; a page's end closes a block but within a list."""
    docs = table(spark, d, "documents").filter(present("document_id")).select("doc_id", "document_id", "page_id", "block_element")
    return L.segment_blocks(docs, "document_id", "doc_id", "block_element", {"title": ["paragraph"], "paragraph": ["list", "caption"], "list": ["list"]}, "page_id", ["list"]).select("doc_id", "block")


@queries("merged_islands", """WITH b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, l_returnflag AS tag, (l_partkey % 900)::DOUBLE AS x0, (l_partkey % 900)::DOUBLE + 100 + l_quantity AS x1 FROM lineitem), f AS (SELECT *, CASE WHEN tag = lag(tag) OVER (PARTITION BY page ORDER BY k) THEN 0 ELSE 1 END AS s FROM b),
g AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT page, CAST(island AS BIGINT) AS island, min(tag) AS tag, string_agg(CAST(k AS VARCHAR), ' ' ORDER BY k) AS text, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY 1, 2""")
def merged_islands(spark, d):
    """Neighbours of one tag merged: their texts joined, their boxes' hull."""
    from .layout import detections

    marked = R.islands(detections(spark, d).select("page", "obj_id", F.col("label").alias("tag"), "box"), ["page"], ["obj_id"], ["tag"])
    made = marked.groupBy("page", "island").agg(F.min("tag").alias("tag"), F.array_sort(F.collect_list("obj_id")).alias("ids"), F.min("box.x0").alias("x0"), F.max("box.x1").alias("x1"))
    return made.select("page", "island", "tag", F.array_join(F.col("ids").cast("array<string>"), " ").alias("text"), "x0", "x1")


@queries("sentence_groups", """WITH f AS (SELECT *, CASE WHEN row_number() OVER v = 1 OR page_id IS DISTINCT FROM lag(page_id) OVER v OR block_element IS DISTINCT FROM lag(block_element) OVER v THEN 1 ELSE 0 END AS s FROM documents WHERE document_id <> '' WINDOW v AS (PARTITION BY document_id ORDER BY doc_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY document_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT document_id, CAST(k AS BIGINT) AS k, min(page_id) AS page_id, min(block_element) AS block_element, count(*) AS sentences FROM g GROUP BY 1, 2""")
def sentence_groups(spark, d):
    """Runs of rows of one page and kind of block."""
    marked = R.islands(table(spark, d, "documents").filter(present("document_id")), ["document_id"], ["doc_id"], ["page_id", "block_element"], "k")
    return marked.groupBy("document_id", "k").agg(F.min("page_id").alias("page_id"), F.min("block_element").alias("block_element"), F.count("*").alias("sentences"))


@queries("heading_parents", """WITH h AS (SELECT doc_id, document_id, page_id, CASE block_element WHEN 'title' THEN 1 WHEN 'caption' THEN 2 ELSE 3 END AS lvl FROM documents WHERE document_id <> '')
SELECT a.doc_id, (SELECT max(b.doc_id) FROM h b WHERE b.document_id = a.document_id AND b.doc_id < a.doc_id AND b.lvl < a.lvl) AS parent FROM h a""")
def heading_parents(spark, d):
    """The block above each block: the last one before it of a higher level, by running maxima per level."""
    level = F.when(F.col("block_element") == "title", 1).when(F.col("block_element") == "caption", 2).otherwise(3)
    return L.parents(table(spark, d, "documents").filter(present("document_id")).select("doc_id", "document_id", level.alias("lvl")), "document_id", "doc_id", "lvl", 3)


@queries("chunk_entities", "SELECT doc_id, CAST((instr(text, 'energy') - 1) // 512 AS BIGINT) AS chunk, CAST((instr(text, 'energy') - 1) % 512 AS BIGINT) AS start_ FROM documents WHERE contains(text, 'energy')")
def chunk_entities(spark, d):
    """Entities with the chunk of 512 characters that they begin in and their place in it."""
    at = F.instr("text", F.lit("energy")) - 1
    return table(spark, d, "documents").filter(F.contains("text", F.lit("energy"))).select("doc_id", F.floor(at / 512).alias("chunk"), (at % 512).cast("bigint").alias("start_"))


@queries("gap_pattern", """WITH t AS (SELECT event_id, user_id, event_type AS a, ts AS ta, lead(event_type, 1) OVER w AS b, lead(ts, 1) OVER w AS tb, lead(event_type, 2) OVER w AS c, lead(ts, 2) OVER w AS tc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id FROM t WHERE a = 'view' AND b = 'click' AND c <> 'view' AND tb - ta <= INTERVAL 12 HOUR AND tc - tb <= INTERVAL 30 HOUR""")
def gap_pattern(spark, d):
    """Three kinds of match in a row, each within its gap of the one before."""
    return R.in_a_row(table(spark, d, "events"), ["user_id"], ORDER, "ts", [F.col("event_type") == "view", F.col("event_type") == "click", F.col("event_type") != "view"], [12 * 3600, 30 * 3600]).select("event_id", "user_id")


@queries("nine_matches", """WITH t AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS n, event_type IN ('click', 'purchase', 'error') AS m, ts FROM events), l AS (SELECT user_id, event_id, n AS n0, lead(m, 1) OVER w AS m1, lead(n, 2) OVER w AS n2, lead(m, 3) OVER w AS m3, lead(n, 4) OVER w AS n4, lead(m, 5) OVER w AS m5,
 lead(event_id, 1) OVER w AS e1, lead(event_id, 2) OVER w AS e2, lead(event_id, 3) OVER w AS e3, lead(event_id, 4) OVER w AS e4, lead(event_id, 5) OVER w AS e5, lead(event_id, 6) OVER w AS e6, lead(event_id, 7) OVER w AS e7, lead(event_id, 8) OVER w AS e8 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT * FROM l WHERE n0 AND m1 AND n2 AND m3 AND n4 AND m5 AND e8 IS NOT NULL) SELECT user_id, event_id AS number_id, e1 AS measure_id, e6 AS keyword_id FROM h UNION ALL SELECT user_id, e2, e3, e7 FROM h UNION ALL SELECT user_id, e4, e5, e8 FROM h""")
def nine_matches(spark, d):
    """Three pairs of number and measure followed by three keywords: three rows of number, measure and keyword."""
    number, measure = F.col("event_type").isin("view", "click"), F.col("event_type").isin("click", "purchase", "error")
    return R.paired_triples(table(spark, d, "events"), ["user_id"], ORDER, "event_id", number, measure)


@queries("label_transfer", """WITH e AS (SELECT id, metric, page_no, target_metric, id % 2 AS side FROM environment_info WHERE metric <> '' AND page_no IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY side, metric, page_no ORDER BY id) AS k FROM e)
SELECT a.id, b.target_metric AS label FROM n a LEFT JOIN n b ON b.side = 0 AND a.metric = b.metric AND a.page_no = b.page_no AND a.k = b.k WHERE a.side = 1""")
def label_transfer(spark, d):
    """Labels of rows that agree in text and page, one to one."""
    rows = table(spark, d, "environment_info").filter(present("metric") & F.col("page_no").isNotNull()).select("id", "metric", "page_no", F.col("target_metric").alias("label"))
    return L.transfer_labels(rows.filter("id % 2 = 1").drop("label"), rows.filter("id % 2 = 0"), ["metric", "page_no"], "id", "label").select("id", "label")


@queries("token_truth", """SELECT DISTINCT a.metric, a.page_no, b.target_metric AS label FROM environment_info a LEFT JOIN environment_info b ON b.id % 2 = 0 AND a.metric = b.metric AND a.page_no = b.page_no AND a.document_id = b.document_id WHERE a.id % 2 = 1""")
def token_truth(spark, d):
    """Predicted tokens with the truths of the same text, page and document, each once."""
    rows = table(spark, d, "environment_info").select("id", "metric", "page_no", "document_id", "target_metric")
    keys = ["metric", "page_no", "document_id"]
    truth = rows.filter("id % 2 = 0").select(*keys, F.col("target_metric").alias("label")).distinct()
    return rows.filter("id % 2 = 1").select(*keys).distinct().join(truth, keys, "left").select("metric", "page_no", "label").distinct()


NESTED_SQL = "SELECT document_id, string_agg(page || ':' || blocks, ';' ORDER BY page) AS tree FROM (SELECT document_id, coalesce(CAST(page_id AS VARCHAR), '-') AS page, string_agg(coalesce(block_element, '-'), ',' ORDER BY doc_id) AS blocks FROM documents WHERE document_id <> '' GROUP BY 1, 2) GROUP BY 1"


@queries("nested_blocks", NESTED_SQL)
def nested_blocks(spark, d):
    """Rows to documents of pages of blocks, shown as text."""
    pages = table(spark, d, "documents").filter(present("document_id")).groupBy("document_id", F.coalesce(F.col("page_id").cast("string"), F.lit("-")).alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("block_element", F.lit("-")).alias("b")))).alias("blocks"))
    tree = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("pages"))
    shown = F.transform("pages", lambda p: F.concat(p["page"], F.lit(":"), F.array_join(F.transform(p["blocks"], lambda b: b["b"]), ",")))
    return tree.select("document_id", F.array_join(shown, ";").alias("tree"))


@queries("relations_exploded", """WITH d AS (SELECT document_id, block_element, CAST(row_number() OVER (PARTITION BY document_id ORDER BY doc_id) - 1 AS INT) AS sentence FROM documents WHERE document_id <> '' AND text IS NOT NULL)
SELECT document_id, sentence, CAST(k AS INT) AS relation, block_element AS head FROM d, (VALUES (0), (1)) AS v(k)""")
def relations_exploded(spark, d):
    """Nested predictions (a document's sentences, each with its relations) to rows with the ids of what they stand in."""
    docs = table(spark, d, "documents").filter(present("document_id") & F.col("text").isNotNull())
    relation = F.array(*[F.struct(F.lit(k).alias("k"), F.col("block_element").alias("head")) for k in (0, 1)])
    nested = docs.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", relation.alias("relations")))), lambda s: s["relations"]).alias("sentences"))
    return L.explode_relations(nested, "document_id", "sentences").select("document_id", "sentence", "relation", "r.head")


@queries("melted_blocks", """SELECT doc_id, name, value FROM (SELECT doc_id, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'block_element', block_element FROM documents) WHERE value IS NOT NULL""")
def melted_blocks(spark, d):
    """Nested fields to rows of name and value."""
    nested = table(spark, d, "documents").select("doc_id", F.create_map(*[x for c in ("lang", "source", "block_element") for x in (F.lit(c), F.col(c))]).alias("m"))
    return nested.select("doc_id", F.explode("m").alias("name", "value")).filter("value IS NOT NULL")


@queries("flat_fields", "SELECT doc_id, lang AS meta_lang, source AS meta_origin_source, page_id AS meta_origin_page FROM documents")
def flat_fields(spark, d):
    """Nested fields flattened, their names joined by underscores."""
    nested = table(spark, d, "documents").select("doc_id", F.struct("lang", F.struct("source", F.col("page_id").alias("page")).alias("origin")).alias("meta"))
    return L.flatten(nested)


@queries("zipped_rows", "SELECT user_id, event_id, event_type FROM events")
def zipped_rows(spark, d):
    """Columns held as arrays, zipped to rows."""
    held = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "event_type")).alias("r")).select("user_id", F.transform("r", lambda x: x["event_id"]).alias("event_id"), F.transform("r", lambda x: x["event_type"]).alias("event_type"))
    return held.select("user_id", F.inline(F.arrays_zip("event_id", "event_type")))


@queries("unpivot_by_header", """WITH w AS (SELECT o_orderpriority, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1995), 2) AS y1995, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 2) AS y1996, round(max(o_totalprice), 2) AS amount FROM orders GROUP BY 1)
SELECT o_orderpriority AS metric, 1995 AS yr, y1995 AS value FROM w UNION ALL SELECT o_orderpriority, 1996, y1996 FROM w UNION ALL SELECT o_orderpriority, 2020, amount FROM w""")
def unpivot_by_header(spark, d):
    """A wide table to metric, year and value: the year of a column's name, for a column of amounts that names none the file's year."""
    wide = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(*[F.round(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))), 2).alias(f"y{y}") for y in (1995, 1996)], F.round(F.max("o_totalprice"), 2).alias("amount"), F.max("o_orderstatus").alias("remark"))
    return L.unpivot_years(wide, "metric", 2020).select("metric", "yr", "value")


@queries("utc_now", "SELECT 1 AS row_, now() > TIMESTAMP '2020-01-01' AS later")
def utc_now(spark, d):
    return spark.range(1).select(F.lit(1).alias("row_"), (F.current_timestamp() > F.to_timestamp(F.lit("2020-01-01 00:00:00"))).alias("later"))


@queries("scored_cells")
def scored_cells(spark, d):
    """Number and unit of cells by a scorer of candidates; the one that comes with the engine goes by rule."""
    return scorers.apply(table(spark, d, "environment_info").select("id", "value"), "value", scorers.split_by_rule, "number string, unit string").select("id", "made.number", "made.unit")


@queries("grammar_filter", "SELECT doc_id FROM documents WHERE text IS NOT NULL")
def grammar_filter(spark, d):
    """Texts that a scorer finds well formed; the one that comes with the engine passes all."""
    return scorers.keep(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "text", scorers.pass_through).select("doc_id")


@queries("text_likeness")
def text_likeness(spark, d):
    """Likeness of a printed metric's name and the one that it was matched to, by matching blocks."""
    pairs = table(spark, d, "environment_info").filter(present("metric") & present("target_metric")).select("metric", "target_metric").distinct()
    return pairs.select("metric", "target_metric", T.block_ratio("metric", "target_metric").alias("likeness"))
