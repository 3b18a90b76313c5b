"""Named parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table *name* of *folder*; a missing table raises the analyser's error."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def present(column: str | Column) -> Column:
    """Null and the empty string both mean missing."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & (c != "")


def own_names(schema: DataFrame) -> DataFrame:
    """metric_schema with `own_name`, `synonyms` (array) and `common_unit`, one row per own name.

    `metric` and `unit` are list literals (JSON arrays) or, for `unit`, a plain string. Of rows
    with the same own name the one with the smallest id counts. Rows without a name are left out.
    """
    names = F.from_json("metric", "array<string>")
    units = F.from_json("unit", "array<string>")
    return (
        schema.withColumn("synonyms", F.coalesce(names, F.array("metric")))
        .withColumn("own_name", F.get("synonyms", F.lit(0)))
        .withColumn("common_unit", F.coalesce(F.get(units, F.lit(0)), F.col("unit")))
        .filter(present("own_name"))
        .groupBy("own_name")
        .agg(
            F.min_by("synonyms", "id").alias("synonyms"),
            F.min_by("common_unit", "id").alias("common_unit"),
            F.min_by("density_ntp_kg_per_m3", "id").alias("density"),
            F.min_by("category", "id").alias("category"),
        )
    )


def listed(facts: DataFrame, schema: DataFrame) -> DataFrame:
    """The facts whose target_metric, exactly as written, is some metric's own name."""
    return facts.join(own_names(schema).select(F.col("own_name").alias("target_metric")), "target_metric", "left_semi")
