"""Texts cut off by field limits or in transfer (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

# White space of all kinds, brackets of notes behind the last sentence, closing marks, sentence
# ends, marks of a cut, abbreviations whose full stop may stand before another.
BLANKS = " \t\r\n\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u200b\u3000\ufeff\v"
NOTES = {")": "(", "）": "（", "]": "["}
QUOTES = "\"'”’»」』)]）"
STOPS = ".!?。！？"
CUT_MARKS = ("…", "..", "[truncated]", "[cut]", "[more]")
ABBREVIATED = re.compile(r"(?i)\b(?:kg|kgs|ltd|co|inc|no|approx|incl|etc|sq|cu|st)\.\.$")
CAPTION = r"^\s*(?:Figure|Fig\.|Table|Chart|Exhibit|Graph|Tableau|Graphique|Tabela|Quadro|Gráfico|圖|图|表|圖表)\s*\d"
SENTENCES = r"[a-zà-ÿ0-9)%][.!?]\s+[A-ZÀ-Þ\"“]|[。！？]"
_BLANK = frozenset(BLANKS)
_TAG, _ENTITY = re.compile(r"/?\w+ ?/?"), re.compile(r"\w+")


def _note(text: str, end: int) -> int:
    """Where the note that ends at *end* begins; *end* itself if there's none. A note is bracketed, an element or a
    tag of markup, an entity, `Unit: ` and up to four words, or `— End of` and a word. Any length."""
    last = text[end - 1]
    if last in NOTES:
        start = text.rfind(NOTES[last], 0, end - 1)
        return start if start >= 0 and text.rfind(last, start, end - 1) < 0 else end
    if last == ">":
        start = text.rfind("<", 0, end - 1)
        inside = text[start + 1 : end - 1]
        if start < 0 or not _TAG.fullmatch(inside):
            return end
        opened = text.rfind("<", 0, start) if inside.startswith("/") else -1
        whole = opened >= 0 and re.match(r"\w+", text[opened + 1 : opened + 2 + len(inside)]) and text.startswith(inside[1:].strip(), opened + 1) and text.find(">", opened, start) >= 0
        return opened if whole else start
    if last == ";":
        start = text.rfind("&", 0, end - 1)
        return start if start >= 0 and _ENTITY.fullmatch(text, start + 1, end - 1) else end
    start = text.rfind("Unit: ", 0, end)
    if start >= 0 and text.count(" ", start + 6, end) < 4 and "" not in (words := text[start + 6 : end].split(" ")) and not any(c.isspace() for w in words for c in w):
        return start
    start = max(text.rfind("— End of ", 0, end), text.rfind("– End of ", 0, end))
    return start if start >= 0 and _ENTITY.fullmatch(text, start + 9, end) else end


def ending(text: str | None) -> tuple[bool, bool]:
    """(bears a mark of a cut, ends in the middle of a sentence). One scan from the end past blanks and notes, however
    many and long they are; null, empty and blank texts give (False, False)."""
    end = len(text or "")
    while end and text[end - 1] in _BLANK:
        end -= 1
    if not end:
        return False, False
    marked = text.endswith(CUT_MARKS, 0, end) and not ABBREVIATED.search(text[max(0, end - 12) : end])
    while True:
        while end and text[end - 1] in _BLANK:
            end -= 1
        start = _note(text, end) if end else end
        if start == end:
            break
        end = start
    while end and text[end - 1] in QUOTES:
        end -= 1
    return marked, not (end and text[end - 1] in STOPS)


@F.pandas_udf(StructType([StructField("marked", BooleanType()), StructField("open", BooleanType())]))
def _ending(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame([ending(t) for t in part], columns=["marked", "open"])


def _widest(text: Column) -> Column:
    """Bytes of the text's widest character in UTF-8, 1 to 4."""
    return F.when(F.octet_length(text) == F.char_length(text), 1).when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), 4).when(text.rlike(r"[\u0800-\uFFFF]"), 3).otherwise(2)


def length_limits(texts: DataFrame, text: str, source: str, least: int = 3, share: float = 0.004, peak: float = 4.0) -> DataFrame:
    """Per source the lengths at which texts are cut: `limit_kind` ('characters' or 'bytes'), `limit`, `n`.

    A length at the upper end of a source's histogram, with at most a quarter as many longer texts (strays) as
    it holds itself, is a spike where it holds at least *least* texts, *share* of the source's texts, and
    *peak* times as many as the average length of the tenth below it. A byte limit also holds the texts that
    stop short of it by less than their widest character, as the next one may not have fitted; one that
    holds fewer texts than the same number of characters is that limit seen in plain texts, and left out.
    Aggregations with partial sums; what is shuffled is one row per source and length.
    """
    t = F.col(text)
    sized = texts.filter(t.isNotNull() & (F.rtrim(t, F.lit(BLANKS)) != "")).select(
        F.col(source).alias("_source"), F.explode(F.array(F.struct(F.lit("characters").alias("kind"), F.char_length(t).alias("size"), F.lit(1).alias("widest")), F.struct(F.lit("bytes").alias("kind"), F.octet_length(t).alias("size"), _widest(t).alias("widest")))).alias("_x")
    )
    wider = [F.count_if(F.col("_x.widest") > gap).alias(f"_wider{gap}") for gap in (1, 2, 3)]
    histogram = sized.groupBy("_source", F.col("_x.kind").alias("limit_kind"), F.col("_x.size").cast("bigint").alias("_size")).agg(F.count("*").alias("_n"), *wider)
    per = Window.partitionBy("_source", "limit_kind")
    by_size = per.orderBy("_size")
    short = sum((F.coalesce(F.sum(f"_wider{gap}").over(by_size.rangeBetween(-gap, -gap)), F.lit(0)) for gap in (1, 2, 3)), F.lit(0))
    placed = histogram.withColumn("_short", short).withColumn("_all", F.sum("_n").over(per)).withColumn("_above", F.coalesce(F.sum("_n").over(by_size.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)))
    held = F.col("_n") + F.col("_short")
    high = (held >= least) & (held >= share * F.col("_all")) & (held >= 4 * F.col("_above"))
    # few lengths of a source are that high: each holds four times what lies above it
    tops = placed.withColumn("_tops", F.collect_list(F.when(high, F.struct(F.col("_size").alias("limit"), held.alias("n"), F.col("_short").alias("short")))).over(per)).withColumn("_top", F.explode("_tops"))
    near = (F.col("_size") < F.col("_top.limit")) & (F.col("_size") >= F.col("_top.limit") * 0.9)
    below = tops.groupBy("_source", "limit_kind", "_top").agg(F.coalesce(F.sum(F.when(near, F.col("_n"))), F.lit(0)).alias("_near"))
    usual = F.greatest(F.col("_near") - F.col("_top.short"), F.lit(0)) / F.greatest(F.col("_top.limit") * 0.1, F.lit(1))
    spikes = below.filter(F.col("_top.n") >= peak * usual).select(F.col("_source").alias("limit_source"), "limit_kind", F.col("_top.limit").cast("int").alias("limit"), F.col("_top.n").alias("n"))
    by_characters = F.max(F.when(F.col("limit_kind") == "characters", F.col("n"))).over(Window.partitionBy("limit_source", "limit"))
    return spikes.withColumn("_by_characters", F.coalesce(by_characters, F.lit(0))).filter((F.col("n") >= F.col("_by_characters")) | (F.col("limit_kind") == "characters")).drop("_by_characters")


def flag_truncated(texts: DataFrame, text: str = "text", source: str = "source", block: str | None = "block_element") -> DataFrame:
    """All rows of *texts* with `at_limit`, `truncated` (booleans, never null) and `rule`, what says that it's cut (null if it isn't).

    'length spike': the text's length is at a spike of its source's histogram (in characters or bytes, or short of the bytes by
    less than a character; see length_limits), whatever kind of block it is, and it has no sentence end once notes behind the last sentence
    are set aside, or it bears a mark of a cut. Texts cut in mid-transfer have any length, so no histogram shows them: 'mark' is a
    mark of a cut elsewhere, 'open end' a missing sentence end elsewhere; there titles, captions and list
    items, by *block* or where that is missing by their shape, are complete without a full stop.

    Cases: null, empty and blank texts aren't truncated; a null source is a source of its own; a
    source of few texts has no spike and is judged by endings alone; repeated rows are each judged;
    very long texts and notes are read whole; an empty table gives no rows; columns named
    `at_limit`, `truncated` or `rule` are replaced. Only the limits (one row per source) are joined.
    """
    texts = texts.drop("at_limit", "truncated", "rule")
    t = F.col(text)
    limits = length_limits(texts, text, source).withColumnRenamed("limit_source", "_quantafold_source").groupBy("_quantafold_source").agg(
        F.collect_set(F.when(F.col("limit_kind") == "characters", F.col("limit"))).alias("_quantafold_characters"), F.collect_set(F.when(F.col("limit_kind") == "bytes", F.col("limit"))).alias("_quantafold_bytes")
    )
    judged = texts.withColumn("_quantafold_end", _ending(t))
    joined = judged.join(limits, F.col(source).eqNullSafe(F.col("_quantafold_source")), "left")
    size = F.octet_length(t)
    full = F.exists("_quantafold_bytes", lambda most: (size <= most) & (size > most - 4) & (size + _widest(t) > most))  # the next character may not have fitted
    at_limit = F.coalesce(F.array_contains("_quantafold_characters", F.char_length(t)), F.lit(False)) | F.coalesce(full, F.lit(False))
    whole = F.rtrim(t, F.lit(BLANKS))
    lines = F.contains(whole, F.lit("\n"))
    shaped = whole.rlike(CAPTION) | (~whole.rlike(SENTENCES) & (lines | ((F.char_length(whole) <= 80) & ~whole.rlike(r", (?!\d{4}$)"))))
    kind = F.lower(F.col(block)) if block else F.lit(None).cast("string")
    brief = F.when(F.coalesce(kind, F.lit("")) == "", shaped).otherwise(kind.isin("title", "caption", "list"))
    marked, open_end = F.col("_quantafold_end.marked"), F.col("_quantafold_end.open")
    rule = F.when(F.col("_quantafold_at") & (marked | open_end), "length spike").when(marked, "mark").when(open_end & ~brief, "open end")
    ruled = joined.withColumn("_quantafold_at", at_limit).withColumn("_quantafold_rule", rule)
    return ruled.select(*[F.col(f"`{c}`") for c in texts.columns], F.col("_quantafold_at").alias("at_limit"), F.col("_quantafold_rule").isNotNull().alias("truncated"), F.col("_quantafold_rule").alias("rule"))


def truncation_report(flagged: DataFrame, source: str = "source") -> DataFrame:
    """Per source: texts, how many are at the source's limit, how many are cut, by which rule, and their share."""
    by_rule = [F.count_if(F.coalesce(F.col("rule") == r, F.lit(False))).alias(n) for r, n in (("length spike", "by_length"), ("mark", "by_mark"), ("open end", "by_open_end"))]
    return flagged.groupBy(source).agg(
        F.count("*").alias("texts"), F.count_if("at_limit").alias("at_limit"), F.count_if("truncated").alias("cut"), *by_rule, F.round(F.count_if("truncated") / F.count("*"), 6).alias("cut_share")
    )
