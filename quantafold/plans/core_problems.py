"""Queries of the problems whose operators belong to the core (1, 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.years import calendar_year
from ..operators.company_keys import company_of
from ..operators.spikes import flag_implausible
from ..operators.units import bounded, convert_units, misconverted
from ..operators.wide import conflicting_cells, stitch
from ..session import cut
from ..sources.tables import listed, own_names, present, table


def _wide(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    facts, schema = table(spark, folder, "environment_info"), table(spark, folder, "metric_schema")
    names = sorted(r[0] for r in bounded(own_names(schema).select("own_name"), 10_000, "metric_schema"))
    rows = facts.select("company_name", "year", "target_metric", "converted_value").filter(present("company_name") & present("year"))
    return stitch(rows, ["company_name", "year"], "target_metric", "converted_value", dict.fromkeys(names, "double"), every=every)


def p1_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per company and year with a number column for each metric, of nulls where no listed value is stated."""
    return _wide(spark, folder, every=True).drop("ordinal")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of the wide table that are not single-valued."""
    return conflicting_cells(_wide(spark, folder), ["company_name", "year"], "target_metric")


def p4_converted(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with the quantity in the metric's common unit and what came of it."""
    facts = table(spark, folder, "environment_info").select("id", "value", "unit", "metric", "target_metric", "year")
    made = convert_units(facts, table(spark, folder, "metric_schema"), table(spark, folder, "unit_reference"), table(spark, folder, "fx_rate"))
    return made.select("id", F.col("std_value").alias("converted_value"), F.col("std_unit").alias("converted_unit"), F.col("std_status").alias("status"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose stored conversion is missing or wrong though the quantity can be stated."""
    facts = table(spark, folder, "environment_info")
    return misconverted(facts, table(spark, folder, "metric_schema"), table(spark, folder, "unit_reference"), table(spark, folder, "fx_rate"))


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """`name`, `entity`: the company of each spelling among the facts."""
    registry = table(spark, folder, "company_industry")
    both = registry.select(F.col("stock_id").cast("string").alias("entity"), F.explode(F.array("company_name_ch", "company_name_en")).alias("name")).filter("entity IS NOT NULL").distinct()
    sectors = [r[0] for r in bounded(registry.select("sector").filter(present("sector")).distinct(), 2_000, "sectors")]
    return company_of(table(spark, folder, "environment_info").select(F.col("company_name").alias("name")), both, sectors)


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    facts, schema = table(spark, folder, "environment_info"), table(spark, folder, "metric_schema")
    shares = {r[0]: 100.0 for r in bounded(own_names(schema).filter("common_unit = '%'").select("own_name"), 10_000, "metric_schema")}
    rows = listed(facts.select("id", "company_name", "target_metric", calendar_year("year").alias("year"), "converted_value"), schema)
    named = cut(companies(spark, folder).withColumnRenamed("name", "company_name"))  # read by both sides of p6_found
    rows = rows.filter("converted_value IS NOT NULL AND year IS NOT NULL").join(named, "company_name")
    return rows, flag_implausible(rows, ["entity", "target_metric"], "year", "converted_value", shares, "target_metric")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each listed row whose stored converted_value is implausible for its company and metric."""
    rows, points = _judged(spark, folder)
    return rows.join(points, ["entity", "target_metric", "year", "converted_value"], "left_semi").select("id")


def p6_points(spark: SparkSession, folder: str) -> DataFrame:
    """The implausible points of each company's series and why they are so."""
    return _judged(spark, folder)[1]


QUERIES = {"p6_found": p6_found, "p6_points": p6_points, "p1_found": p1_found, "p1_wide": p1_wide, "p4_found": p4_found, "p4_converted": p4_converted}
SQL = {
    "p1_found": """
        SELECT company_name, year, target_metric FROM environment_info
        WHERE company_name <> '' AND year <> '' AND converted_value IS NOT NULL AND NOT isnan(converted_value)
          AND target_metric IN (SELECT json_extract_string(metric, '$[0]') FROM metric_schema)
        GROUP BY ALL HAVING count(DISTINCT converted_value) > 1
    """,
}
