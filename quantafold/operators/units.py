"""Quantities recorded in different units, brought to the common unit of their metric (problem 4)."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.numbers import parse_quantity
from ..functions.unit_grammar import UnitGrammar
from ..functions.years import calendar_year
from ..sources.tables import own_names

RESULT = StructType([StructField("value", DoubleType()), StructField("unit", StringType()), StructField("status", StringType())])
_MASS, _VOLUME = (("mass", 1),), (("length", 3),)
NAMELIKE = 0.7  # likeness to a name that must be left where a unit behind it stands in no brackets
_TAIL_MARKS = re.compile(r"[\s:;,，：*#†]+$")
_BRACKETED = re.compile(r"\((?:[^()]|\([^()]*\))+\)|（[^（）]+）|\[[^\[\]]+\]")
_STOP = re.compile(r"\s*[(（\[,，]|\s[-–—/]\s")
_PART = re.compile(r"[)）\],，]\s*|\s[-–—/]\s+")
_WORD_START = re.compile(r"(?<=\s)\S")


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a reference table of at most *most* rows; more raise ValueError.

    Reference tables don't grow with the facts; the bound is checked, not assumed.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it can't be held by each worker")
    return rows


class UnitConverter:
    """Converts one quantity at a time; holds the reference tables and caches of one worker."""

    def __init__(self, metrics: dict[str, tuple], units: list[tuple], rates: dict[tuple[str, int], float]):
        self.grammar = UnitGrammar()
        own = {}
        for unit, factor, common in units:  # spellings that the lexicon doesn't know
            whole = self.grammar.read(common)
            if unit and whole and factor and self.grammar.read(unit) is None and len(whole[1]) == 1 and whole[1][0][1] == 1:
                own[self.grammar.clean(unit)] = (factor * whole[0], whole[1][0][0])
        if own:
            self.grammar = UnitGrammar(own)
        self.metrics = {name: (unit, self.grammar.read(unit), density, [" ".join(sorted(re.findall(r"[^\W_]+", x.lower()))) for x in names if x]) for name, (names, unit, density) in metrics.items()}
        self.rates = rates
        self.tails: dict[tuple[str, str], str | None] = {}

    def convert(self, value: str | None, unit: str | None, metric: str | None, target: str | None, year: int | None) -> tuple[float | None, str | None, str]:
        known = self.metrics.get(target)
        if known is None or known[1] is None:
            return None, None, "no common unit"
        common, (per, vector), density, _ = known
        quantity = parse_quantity(value)
        if quantity is None:
            return None, common, "no number"
        number, rest = quantity
        kind = self.grammar.kind(vector)
        if unit:
            got = self.grammar.read(unit, vector, per)
        else:
            got = self.grammar.read(rest, vector, per) if rest else None
            if got is None:
                got = self.grammar.read(self.behind_name(metric, target), vector, per)
            if got is None:
                return None, common, "no unit"
        if got is None:
            return None, common, "unit not understood"
        factor, of = got
        if self.grammar.kind(of) == kind:
            if of != vector:  # other currencies; the power of the amount is that of its rate
                rate = self._rate(of, vector, year)
                if rate is None:
                    return None, common, "no rate"
                factor *= rate ** next(p for d, p in of if d.startswith("money"))
            return number * factor / per, common, "converted"
        if of == _MASS and vector == _VOLUME and density:
            return number * factor * 1000 / density / per, common, "converted"
        return None, common, "other dimension"

    def _rate(self, of: tuple, to: tuple, year: int | None) -> float | None:
        """Through HKD, the currency that the rates are stated in."""
        if year is None:
            return None
        one = 1.0 if (a := UnitGrammar.currency(of)) == "HKD" else self.rates.get((a, year))
        two = 1.0 if (b := UnitGrammar.currency(to)) == "HKD" else self.rates.get((b, year))
        return one / two if one and two else None

    def behind_name(self, metric: str | None, target: str) -> str | None:
        """The unit text behind a metric's name: `Name (kg)`, `Name, in kg` or `Name kg`.

        What follows counts as a unit only where it reads as one and where the rest is nearer
        to a name of the metric than the whole, so that the `Employees` of `Female Employees` stays.
        """
        if not metric:
            return None
        key = (metric, target)
        if key not in self.tails:
            if len(self.tails) > 200_000:  # bounded memory of a long-lived worker
                self.tails.clear()
            self.tails[key] = self._behind(metric, target)
        return self.tails[key]

    def _behind(self, metric: str, target: str) -> str | None:
        _, (size, vector), _, names = self.metrics[target]
        text = " ".join(metric.split())
        fits = lambda unit: (got := self.grammar.read(unit, vector, size)) and (self.grammar.kind(got[1]) == self.grammar.kind(vector) or got[1] == _MASS and vector == _VOLUME)
        best = None
        for first, start, end, unit in self._candidates(text):
            if fits(unit):
                bracketed = text[start] in "(（["
                whole, rest = (text, f"{text[:start]} {text[end:]}") if bracketed else (text[first:end], text[first:start])
                near, far = self._likeness(rest, names), self._likeness(whole, names)
                if (near >= far if bracketed else near > far and near >= NAMELIKE) and (best is None or near > best[0]):
                    best = (near, unit)
        return best[1] if best else None

    @staticmethod
    def _candidates(text: str) -> Iterator[tuple[int, int, int, str]]:
        """(where its part of the text begins, start, end, text) of what may be a unit: what stands in brackets, and the ends of what stands before a
        bracket, a comma, a dash between blanks or the text's end. Notes around it needn't be known."""
        for m in _BRACKETED.finditer(text):
            yield 0, m.start(), m.end(), m[0][1:-1]
        parts = [0, *(m.end() for m in _PART.finditer(text))]
        for stop in {m.start() for m in _STOP.finditer(text)} | {len(text)}:
            first = max(p for p in parts if p <= stop)
            end = len(_TAIL_MARKS.sub("", text[:stop]))
            for m in _WORD_START.finditer(text, first, end):
                unit = text[m.start() : end]
                yield first, m.start(), end, unit[3:] if unit.startswith("in ") else unit

    @staticmethod
    def _likeness(text: str, names: list[str]) -> float:
        """The largest likeness to a name, case, marks and the order of words left aside."""
        mine = " ".join(sorted(re.findall(r"[^\W_]+", re.sub(r"<[^<>]*>[^<>]*</[^<>]*>", " ", text.lower()))))
        return max((difflib.SequenceMatcher(None, mine, n, autojunk=False).ratio() for n in names), default=0.0)


def convert_units(facts: DataFrame, schema: DataFrame, units: DataFrame, rates: DataFrame, prefix: str = "std_") -> DataFrame:
    """All rows of *facts* with `<prefix>value`, `<prefix>unit` and `<prefix>status`.

    Segments unit strings by dynamic programming over tries (functions.unit_grammar); the common
    unit of the metric is the prior of ambiguous readings. One narrow pass, no shuffle; the
    reference tables (metrics, units, rates; at most 20,000 rows each, checked) go with the code.

    Cases: target_metric null or unlisted -> null value, 'no common unit'; no number in value ->
    'no number'; unit missing and none in value or behind the metric's name -> 'no unit'; a unit of
    another dimension -> 'other dimension'; a foreign amount without year or rate -> 'no rate'.
    Repeated rows are each converted. Further columns are kept; those of the new names are replaced.
    """
    facts = facts.drop(*[f"{prefix}{n}" for n in RESULT.names])
    metrics = {r.own_name: (list(r.synonyms), r.common_unit, r.density) for r in bounded(own_names(schema).select("own_name", "synonyms", "common_unit", "density"), 20_000, "metric_schema")}
    unit_rows = [tuple(r) for r in bounded(units.select("unit", "factor", "common_unit"), 20_000, "unit_reference")]
    rate_rows = {(r[0], r[1]): r[2] for r in bounded(rates.select("currency", "rate_year", "hkd_per_unit"), 20_000, "fx_rate")}
    kept: list[UnitConverter] = []

    @F.pandas_udf(RESULT)
    def convert(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        if not kept:
            kept.append(UnitConverter(metrics, unit_rows, rate_rows))
        one = kept[0].convert
        for value, unit, metric, target, year in parts:
            years = [None if y != y or y is None else int(y) for y in year]
            yield pd.DataFrame([one(*x) for x in zip(value, unit, metric, target, years, strict=True)], columns=RESULT.names)

    made = convert("value", "unit", "metric", "target_metric", calendar_year("year"))
    return facts.withColumn("_quantafold_made", made).select(*[F.col(f"`{c}`") for c in facts.columns], *[F.col(f"_quantafold_made.{n}").alias(f"{prefix}{n}") for n in RESULT.names])


def misconverted(facts: DataFrame, schema: DataFrame, units: DataFrame, rates: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The `id` of listed rows whose quantity can be stated in the common unit but isn't.

    Missing converted_value (null or NaN) or converted_unit (null or empty), another unit than the
    common one, or a value off by more than *tolerance* of the right one.
    """
    needed = facts.select("id", "value", "unit", "metric", "target_metric", "year", "converted_value", "converted_unit")
    done = convert_units(needed, schema, units, rates).filter("std_status = 'converted'")
    wrong = (
        F.col("converted_value").isNull()
        | F.isnan("converted_value")
        | F.col("converted_unit").isNull()
        | (F.col("converted_unit") != F.col("std_unit"))
        | (F.abs(F.col("converted_value") - F.col("std_value")) > tolerance * F.abs("std_value"))
    )
    return done.filter(wrong).select("id")
