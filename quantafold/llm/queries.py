"""Queries of the operators of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.years import calendar_year
from ..operators.units import bounded
from ..sources.tables import listed, own_names, present, table
from .canonical import canonicalize, mine_aliases, mine_asides
from .encode import encode, round_trip_losses
from .packing import fill_report, overfull, pack
from .spellings import link_spellings, variant_pairs
from .survivors import FACT_BUNDLES, FACT_CRITERIA, choose_bundles, choose_survivors, fact_trust, filled, fuse, upload_times
from .truncation import flag_truncated, truncation_report


def linked_names(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with the company that it stands for."""
    companies = table(spark, folder, "company_industry")
    both = companies.select(F.col("stock_id").cast("string").alias("entity"), F.explode(F.array("company_name_ch", "company_name_en")).alias("name")).filter("entity IS NOT NULL").distinct()
    sectors = [r[0] for r in bounded(companies.select("sector").filter(present("sector")).distinct(), 2_000, "sectors")]
    names = table(spark, folder, "environment_info").select(F.col("company_name").alias("name")).unionByName(table(spark, folder, "test_text_info").select(F.col("company_name").alias("name")))
    return link_spellings(names, both, sectors)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of different spellings of one company."""
    return variant_pairs(linked_names(spark, folder))


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling, the company it stands for and how sure that is."""
    return linked_names(spark, folder)


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    facts, schema = table(spark, folder, "environment_info"), table(spark, folder, "metric_schema")
    entries = {r.own_name: list(r.synonyms) for r in bounded(own_names(schema).select("own_name", "synonyms"), 20_000, "metric_schema")}
    known = listed(facts.select("metric", "target_metric", "company_name"), schema)
    known = known.select(F.col("metric").alias("value"), F.col("target_metric").alias("entry"), F.col("company_name").alias("who"))
    asides = mine_asides(known, entries)
    aliases = mine_aliases(known, entries, asides=asides)
    own = own_names(schema).select(F.col("own_name").alias("target_metric"))
    rows = facts.select("id", "target_metric", "metric").filter(present("target_metric") | present("metric")).join(own, "target_metric", "left_anti")
    return canonicalize(rows, ["target_metric", "metric"], entries, aliases, asides=asides)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each row that isn't listed but names something, with the metric it means or 'unmatched'."""
    return _canonical(spark, folder).select("id", F.col("canonical").alias("target_metric"))


def _stated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The listed rows of a company and year, and the upload time of each document."""
    facts = table(spark, folder, "environment_info")
    rows = listed(facts, table(spark, folder, "metric_schema")).filter(present("company_name") & present("year"))
    return rows.withColumn("_filled", filled(facts.columns)).withColumn("_year", calendar_year("year")), upload_times(table(spark, folder, "pdffiles"))


def _named(spark: SparkSession, folder: str, slim: DataFrame) -> DataFrame:
    return slim.join(linked_names(spark, folder).select(F.col("name").alias("company_name"), "entity"), "company_name").drop("company_name")


KEYS = ["entity", "_year", "target_metric"]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving row of each fact that several rows state."""
    rows, uploads = _stated(spark, folder)
    named = _named(spark, folder, rows.select("id", "company_name", "_year", "target_metric", "document_id", "_filled", "similar_score", "table_score"))
    return choose_survivors(named.join(uploads, "document_id", "left").drop("document_id"), KEYS, FACT_CRITERIA).select("group_id", "id")


def p5_fused(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving records, each bundle from the record most trusted for it that agrees with the others."""
    rows, uploads = _stated(spark, folder)
    trusted = fact_trust(rows, uploads).select("id", "company_name", "_year", "target_metric", "document_id", "metric", "trust_reading", "trust_place", "trust_match")
    return fuse(table(spark, folder, "environment_info"), choose_bundles(_named(spark, folder, trusted), KEYS, {b: f"trust_{b}" for b in FACT_BUNDLES.bundles}))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of each document by byte_bpe_50k."""
    return encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that decoding doesn't give back."""
    return round_trip_losses(table(spark, folder, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, for each kind of container."""
    return pack(table(spark, folder, "documents"), table(spark, folder, "token_container"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p8_packed(spark, folder), table(spark, folder, "token_container"))


def p8_overfull(spark: SparkSession, folder: str) -> DataFrame:
    """Containers over their capacity."""
    return overfull(p8_packed(spark, folder), table(spark, folder, "token_container"))


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return flag_truncated(table(spark, folder, "documents").select("doc_id", "text", "source", "block_element"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document whose text was cut."""
    return _flagged(spark, folder).filter("truncated").select("doc_id")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts."""
    return truncation_report(_flagged(spark, folder))


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p5_found": p5_found, "p5_fused": p5_fused, "p7_ids": p7_ids, "p7_losses": p7_losses, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_overfull": p8_overfull, "p9_found": p9_found, "p9_report": p9_report}
SQL: dict[str, str] = {"p7_losses": "SELECT doc_id FROM documents WHERE false", "p8_overfull": "SELECT container_id, 0::BIGINT AS bin, 0::BIGINT AS tokens, capacity_tokens FROM token_container WHERE false"}
