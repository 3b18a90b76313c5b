"""Scalar text functions as column expressions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that multiply, in the order in which they're applied.
WORD_VALUES = (("hundred", 100), ("thousand", 1_000), ("million", 1_000_000), ("billion", 1_000_000_000))


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def to_number(column: str | Column) -> Column:
    """The number in a cell: plain, in scientific notation (1.45e-4, 1.00 x 10-4, 1.02 x 10<s>3</s>),
    with thousands parted by commas or blanks, or what digits are left once other characters are
    taken out; null where there's none.
    """
    c = F.trim(_c(column))
    power = r"^([-+]?\d+(?:\.\d+)?) *[x×] *10(?:<s>)?([-+]?\d+)(?:</s>)?$"
    scaled = F.regexp_extract(c, power, 1).try_cast("double") * F.pow(F.lit(10.0), F.regexp_extract(c, power, 2).try_cast("double"))
    return F.coalesce(c.try_cast("double"), scaled, F.regexp_replace(F.regexp_replace(c, r"<s>[^<]*</s>", ""), r"[^-\d.]", "").try_cast("double"))


def unit_power(value: str | Column, unit: str | Column) -> Column:
    """A value whose unit begins with a power (10<s>3</s> t), scaled by it; missing values are 0."""
    k = F.regexp_extract(_c(unit), r"^10<s>([-+]?\d+)</s>", 1).try_cast("double")
    return F.coalesce(_c(value), F.lit(0.0)) * F.coalesce(F.pow(F.lit(10.0), k), F.lit(1.0))


def range_of(column: str | Column) -> Column:
    """`a-b` as struct(low, high); a single number is both ends; null otherwise."""
    c = F.trim(_c(column))
    p = r"^(-?\d+(?:\.\d+)?)(?: *(?:-|to) *(-?\d+(?:\.\d+)?))?$"
    low = F.regexp_extract(c, p, 1).try_cast("double")
    return F.when(low.isNotNull(), F.struct(low.alias("low"), F.coalesce(F.regexp_extract(c, p, 2).try_cast("double"), low).alias("high")))


def relation_of(column: str | Column) -> Column:
    """How a text relates its number: change first, then bounds, else 'equal'."""
    c = F.lower(_c(column))
    return (
        F.when(c.rlike(r"increas\w*\b.*\bby\b"), "increased_by")
        .when(c.rlike(r"(?:decreas|reduc|drop|down)\w*\b.*\bby\b"), "reduced_by")
        .when(c.rlike(r"\bno less than\b"), "more than")
        .when(c.rlike(r"\bno more than\b"), "less than")
        .when(c.rlike(r"\b(?:over|more than|above|at least)\b"), "more than")
        .when(c.rlike(r"\b(?:less than|up to|below|under)\b"), "less than")
        .when(c.rlike(r"\b(?:approximately|approx|about|around)\b|~"), "approximate")
        .otherwise("equal")
    )


def share_scale(value: str | Column, unit: str | Column) -> Column:
    """A value in percent, per mille or per ten thousand as a fraction."""
    u = _c(unit)
    return _c(value) * F.when(u.rlike(r"^(?:%|％|pct|per ?cent)$"), 0.01).when(u.rlike(r"^(?:‰|per mille)$"), 0.001).when(u == "‱", 0.0001).otherwise(1.0)


def word_factor(column: str | Column) -> Column:
    """The product of the number words of a unit: hundred tonnes -> 100, hundred thousand -> 100000."""
    c = F.lower(_c(column))
    factor = F.lit(1.0)
    for word, value in WORD_VALUES:
        factor = factor * F.when(c.rlike(rf"\b{word}\b"), float(value)).otherwise(1.0)
    return factor


def plain_unit(column: str | Column) -> Column:
    """Common spellings of a unit made one: no markup, m3, HKD, CNY, tCO2e."""
    c = F.regexp_replace(_c(column), r"</?s>|\n", "")
    for pattern, to in ((r"m³|cubic met(?:re|er)s?", "m3"), (r"(?i)hk\$", "HKD"), (r"(?i)\b(?:rmb|yuan)\b|¥", "CNY"), (r"(?i)t ?co2-?e(?:q)?\b", "tCO2e")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def plain_metric(column: str | Column) -> Column:
    """A metric's name without markup, notes in brackets, dashes at its ends and line breaks."""
    c = F.regexp_replace(_c(column), r"<s>[^<]*</s>", "")
    c = F.regexp_replace(c, r"\([^()]*\)|（[^（）]*）", "")
    c = F.regexp_replace(c, r"[\n\s]+", " ")
    return F.regexp_replace(c, r"^[ –—•-]+|[ –—•-]+$", "")


def metric_kind(metric: str | Column) -> Column:
    """What a metric's name says it's divided by: production, revenue or employees, something else ('intensity'), or nothing."""
    m = F.coalesce(_c(metric), F.lit(""))
    return (
        F.when(~m.rlike("(?i)intensity|density| per"), "not_intensity")
        .when(m.rlike("(?i)per production"), "per_production_intensity")
        .when(m.rlike("(?i)per revenue"), "per_revenue_intensity")
        .when(m.rlike("(?i)per employee"), "per_employee_intensity")
        .otherwise("intensity")
    )


def with_divisor(metric: str | Column, unit: str | Column, per: str, per_unit: str, revenue: str, production: str, staff: str) -> Column:
    """The plain name of a metric; of one that *per* in its name or *per_unit* in its unit tells to be an intensity, with what it's divided
    by, told by the words of *revenue*, *production* and *staff* in name or unit, else with its unit. Null counts as empty."""
    m, u = F.coalesce(_c(metric), F.lit("")), F.coalesce(_c(unit), F.lit(""))
    plain, both = plain_metric(m), F.concat(m, u)
    has = lambda c, words: c.rlike(f"(?i){words}")
    return (
        F.when(~(has(m, per) | has(u, per_unit)), plain)
        .when(has(both, revenue), F.when(has(m, "MtCO2e"), plain).otherwise(F.concat(plain, F.lit(" per revenue"))))
        .when(has(both, production), F.concat(plain, F.lit(" per production")))
        .when(has(both, staff), F.concat(plain, F.lit(" per employee")))
        .otherwise(plain_metric(F.concat(m, F.lit(" "), u)))
    )


def split_cell(value: str | Column, metric: str | Column) -> Column:
    """struct(number, unit) of a cell: a unit in brackets or behind the number, else in brackets behind the metric."""
    v, m = F.trim(_c(value)), _c(metric)
    bracket = F.regexp_extract(v, r"\(([^()]+)\)\s*$", 1)
    tail = F.regexp_extract(v, r"^[-+~]?[\d.,]+\s*([^\d\s.,()*][^()]*)$", 1)
    named = F.regexp_extract(m, r"\(([^()]+)\)\s*$", 1)
    unit = F.coalesce(*[F.when(x != "", F.trim(x)) for x in (bracket, tail, named)])
    return F.struct(F.regexp_extract(v, r"[-+]?[\d,]+(?:\.\d+)?", 0).alias("number"), unit.alias("unit"))


def file_facts(filename: str | Column) -> Column:
    """struct(stock_id, year, kind, language) of a report's file name; the year is the least four-digit one."""
    f = _c(filename)
    years = F.filter(F.transform(F.regexp_extract_all(f, F.lit(r"((?:19|20)\d\d)"), 1), lambda x: x.cast("int")), lambda x: x.isNotNull())
    low = F.lower(f)
    kind = F.when(low.rlike(r"annual report|\bar\b"), "annual").when(low.rlike(r"carbon"), "carbon").when(low.rlike(r"esg|sustainab|environmental"), "esg").otherwise("other")
    return F.struct(
        F.regexp_extract(f, r"^(\d{4,6})(?!\d)", 1).try_cast("int").alias("stock_id"), F.array_min(years).alias("year"), kind.alias("kind"),
        F.when(f.rlike(r"[一-鿿]"), "zh").otherwise("en").alias("language"),
    )


def file_company(filename: str | Column) -> Column:
    """The company in a report's file name: the part before the first underscore that isn't a number; null where there's no such part."""
    parts = F.split(_c(filename), "_")
    return F.when(F.size(parts) > 1, F.get(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.rlike(r"^\d+$") & (p != "")), F.lit(0)))


def sentence_year(sentence: str | Column, default: str | Column) -> Column:
    """The first year written in a sentence, else *default*."""
    return F.coalesce(F.regexp_extract(_c(sentence), r"(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)", 1).try_cast("int"), _c(default))


def clean_text(column: str | Column) -> Column:
    """One kind of quotes, no control characters, no blank before punctuation, single blanks."""
    c = F.translate(_c(column), "“”‘’", "\"\"''")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    c = F.regexp_replace(c, r"[ \t\r\n]+", " ")
    return F.trim(F.regexp_replace(c, r" +([,.;:!?])", "$1"))


def document_kind(filename: str | Column) -> Column:
    """term sheet, annual report or other; whole words, so that 'reports' isn't a term sheet."""
    low = F.lower(_c(filename))
    return F.when(low.rlike(r"\bts\b|term sheet"), "term_sheet").when(low.rlike(r"\bfa\b|facility agreement"), "agreement").when(low.rlike(r"report"), "report").otherwise("other")


def split_sentences(column: str | Column) -> Column:
    """Sentences, parted behind . ! ? and white space of any kind, or behind 。 ！ ？ (a rule, not a trained model).

    Pieces of nothing but white space, zero-width characters included, are no sentences; a null text has a null list.
    """
    return F.filter(F.split(_c(column), r"(?U)(?<=[.!?])\s+|(?<=[。！？])"), lambda s: s.rlike(r"(?U)[^\s\u200b\ufeff]"))


def roman(column: str | Column) -> Column:
    """The value of a roman numeral with subtractive pairs; null on other characters or the empty string."""
    c = F.upper(_c(column))
    digit = lambda x: F.element_at(F.create_map(*[F.lit(v) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in p]), x)
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    total = F.aggregate(
        F.reverse(F.transform(letters, digit)), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most")),
        lambda s, v: F.struct((s["sum"] + F.when(v < s["most"], -v).otherwise(v)).alias("sum"), F.greatest(s["most"], v).alias("most")), lambda s: s["sum"],
    )
    return F.when(c.rlike("^[IVXLCDM]+$"), total)


def status_text(column: str | Column, most: int = 256) -> Column:
    """A status of over *most* characters is cut to most - 3 and marked by two dots."""
    c = _c(column)
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit(".."))).otherwise(c)


def occurrences(column: str | Column, literal: str) -> Column:
    """All [start, end) of a literal, overlapping ones too."""
    c, n = _c(column), len(literal)
    at = F.when(F.char_length(c) >= n, F.filter(F.sequence(F.lit(1), F.char_length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)) == literal)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct((i - 1).alias("start"), (i - 1 + n).alias("end")))


def around(column: str | Column, entity: str) -> Column:
    """The fragments before, between and behind an entity's occurrences, in order; null for null."""
    return F.split(_c(column), F.lit(rf"\Q{entity}\E"), F.lit(-1))


def fragments(column: str | Column, entity: str) -> Column:
    """array<struct(kind, start, end)>: fragments that aren't empty ('normal') and entities with their [start, end), in order."""
    parts, n = around(column, entity), len(entity)
    place = lambda p, i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, x: s + F.char_length(x)) + i * n
    made = F.transform(parts, lambda p, i: F.array(
        F.when(p != "", F.struct(F.lit("normal").alias("kind"), place(p, i).alias("start"), (place(p, i) + F.char_length(p)).alias("end"))),
        F.when(i < F.size(parts) - 1, F.struct(F.lit("entity").alias("kind"), (place(p, i) + F.char_length(p)).alias("start"), (place(p, i) + F.char_length(p) + n).alias("end"))),
    ))
    return F.array_compact(F.flatten(made))


def matches(column: str | Column, pattern: str) -> Column:
    """array<struct(match, first, last)>: the matches of a pattern without groups, with their first and last character."""
    parts, found = F.split(_c(column), pattern, -1), F.regexp_extract_all(_c(column), F.lit(f"({pattern})"), 1)
    length = lambda a, k: F.aggregate(F.slice(a, F.lit(1), k), F.lit(0), lambda s, x: s + F.char_length(x))
    return F.transform(found, lambda m, i: F.struct(m.alias("match"), (length(parts, i + 1) + length(found, i)).alias("first"), (length(parts, i + 1) + length(found, i + 1) - 1).alias("last")))


def without_marks(column: str | Column) -> Column:
    """Box drawing, block and geometric characters and those of private use become underscores."""
    return F.regexp_replace(_c(column), r"[\x{2500}-\x{25FF}\x{E000}-\x{F8FF}]", "_")


def camel_split(column: str | Column) -> Column:
    """Words run together in camel case parted by blanks."""
    return F.regexp_replace(_c(column), "([a-z])([A-Z])", "$1 $2")


def without_punctuation(column: str | Column) -> Column:
    """The ASCII punctuation taken out."""
    return F.regexp_replace(_c(column), r"[!-/:-@\[-`{-~]", "")


def spaced(column: str | Column) -> Column:
    """The forms of a word with a blank at each place within; none for words of one character."""
    c = _c(column)
    return F.when(F.char_length(c) > 1, F.transform(F.sequence(F.lit(1), F.char_length(c) - 1), lambda i: F.concat(F.substring(c, F.lit(1), i), F.lit(" "), F.substring(c, i + 1, F.char_length(c))))).otherwise(F.array().cast("array<string>"))


def phrases(column: str | Column) -> Column:
    """A text parted at semicolons and at `and` and `or`; blank pieces are no phrases."""
    return F.filter(F.split(_c(column), r";\s*|\s+(?:and|or)\s+"), lambda s: F.trim(s) != "")


def tag_raised(column: str | Column) -> Column:
    """The digits of m2, m3, CO2 tagged as raised or lowered."""
    return F.regexp_replace(_c(column), r"\b(m|CO)([23])", "$1<s>$2</s>")


def bioes(pos: str | Column, n: str | Column) -> Column:
    """The prefix of a tag by a word's place: single, first, last or inner."""
    p, k = _c(pos), _c(n)
    return F.when(k == 1, "S-").when(p == 0, "B-").when(p == k - 1, "E-").otherwise("I-")


def quantity_in(column: str | Column, units: str) -> Column:
    """struct(number, unit) of the first number that one of *units* (a pattern) follows; null where there's none."""
    pattern = rf"(\d+(?:\.\d+)?) ({units})"
    number = F.regexp_extract(_c(column), pattern, 1)
    return F.when(number != "", F.struct(number.cast("double").alias("number"), F.regexp_extract(_c(column), pattern, 2).alias("unit")))


def follows(label: Column, next_: Column, kind: Column) -> Column:
    """Whether a label is the successor of another: of kind 'number', 'letter' or 'roman'; false for null and other kinds."""
    step = F.when(kind == "number", next_.try_cast("int") - label.try_cast("int")).when(kind == "letter", F.ascii(F.lower(next_)) - F.ascii(F.lower(label))).when(kind == "roman", roman(next_) - roman(label))
    return F.coalesce(step == 1, F.lit(False))


def section_level(column: str | Column, otherwise: Column) -> Column:
    """The level of a heading by the depth of its number; *otherwise* where no number begins the text."""
    c = _c(column)
    return F.when(c.rlike(r"^\d+\.\d+\.\d+"), "section 3").when(c.rlike(r"^\d+\.\d+"), "section 2").when(c.rlike(r"^\d+\.? "), "section 1").otherwise(otherwise)


def ascii_of(column: str | Column) -> Column:
    """A text decomposed by compatibility, what isn't ASCII left out; null for null."""

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    return strip(_c(column))


def block_ratio(a: str | Column, b: str | Column) -> Column:
    """Likeness of two texts by their matching blocks, 0 to 1; null where either is null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else difflib.SequenceMatcher(None, s, t, autojunk=False).ratio() for s, t in zip(x, y, strict=True)], dtype="float64")

    return ratio(_c(a), _c(b))
