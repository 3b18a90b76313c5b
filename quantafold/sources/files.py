"""Reading and writing of files of several formats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

READERS = {"parquet": "parquet", "csv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "orc": "orc", "xml": "xml", "txt": "text"}


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Reads by the path's suffix; an unknown one raises ValueError. json is one object a file, ndjson and jsonl one a line."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix}; there are {', '.join(READERS)}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if suffix == "csv":
        options = {"header": True, "inferSchema": schema is None, "multiLine": True, "escape": '"'} | options
    if suffix == "json":
        options = {"multiLine": True} | options
    df = reader.options(**options).format(READERS[suffix]).load(path)
    return df.toDF(*[re.sub(r"[^\x20-\x7e]", "", c) or f"column_{i}" for i, c in enumerate(df.columns)]) if suffix == "csv" else df


def missing_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become null."""
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema.fields])


def listing(spark: SparkSession, folder: str, suffix: str = "", prefix_out: str = "") -> DataFrame:
    """`path`, `name`, `length`, `modified` of a folder's files of a suffix, without those whose name has a prefix."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    made = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    return made.filter(~F.col("name").startswith(prefix_out)) if prefix_out else made


def named_within(files: DataFrame, request: str) -> DataFrame:
    """Files whose name without suffix is part of *request*."""
    return files.filter(F.lit(request).contains(F.regexp_replace("name", r"\.[^.]+$", "")))


def with_keyword(pages: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """Pages that hold one of the keywords, case aside, before anything expensive is done to them."""
    low = F.lower(text)
    return pages.filter(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k)))


def voc_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Annotated objects of VOC XML files: `filename`, `label`, x0, y0 (less 1), x1, y1."""
    schema = "filename string, object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
    objects = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path).select("filename", F.explode("object").alias("o"))
    return objects.select("filename", F.col("o.name").alias("label"), (F.col("o.bndbox.xmin") - 1).alias("x0"), (F.col("o.bndbox.ymin") - 1).alias("y0"), F.col("o.bndbox.xmax").alias("x1"), F.col("o.bndbox.ymax").alias("y1"))


def coco_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of a COCO JSON file with their image and category: `file_name`, `category`, x0, y0, x1, y1, `area`, `iscrowd`."""
    schema = "images array<struct<id: bigint, file_name: string>>, annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, area: double, iscrowd: int>>, categories array<struct<id: bigint, name: string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    images = raw.select(F.inline("images")).withColumnRenamed("id", "image_id")
    names = raw.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    b = lambda i: F.get("bbox", F.lit(i))
    return raw.select(F.inline("annotations")).join(images, "image_id").join(names, "category_id").select("file_name", "category", b(0).alias("x0"), b(1).alias("y0"), (b(0) + b(2)).alias("x1"), (b(1) + b(3)).alias("y1"), "area", "iscrowd")


def form_words(forms: DataFrame) -> DataFrame:
    """Words of annotated forms with BIO tags; *forms*: doc, form array<struct<label, words array<struct<text>>>>."""
    fields = forms.select("doc", F.posexplode("form").alias("field", "f"))
    words = fields.select("doc", "field", F.col("f.label").alias("label"), F.posexplode("f.words").alias("pos", "w"))
    tag = F.when(F.col("label") == "other", "O").otherwise(F.concat(F.when(F.col("pos") == 0, "B-").otherwise("I-"), F.upper("label")))
    return words.select("doc", "field", "pos", F.col("w.text").alias("word"), tag.alias("tag"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header and doubled quotes; null and the empty string are both read back as null."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, characters as they are."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log table."""
    df.write.mode("append").parquet(path)


def in_chunks(df: DataFrame, order: list[str], chunks: int, name: str = "chunk") -> DataFrame:
    """Numbers *chunks* contiguous blocks of equal size in order; the last may be smaller.

    By quantile bounds of a sorted layout: the rows are range-partitioned and numbered per partition,
    so no single task sees them all.
    """
    from ..operators.wide import dense_ids

    keyed = df.withColumn("_key", F.struct(*order))
    ranks = dense_ids(keyed.select("_key"), "_key", "_rank")
    size = F.ceil(F.lit(ranks.count() / max(chunks, 1)))
    return keyed.join(ranks, "_key").withColumn(name, F.floor(F.col("_rank") / size)).drop("_key", "_rank")


def frame(spark: SparkSession, data, schema: StructType | str | None = None, **options) -> DataFrame:
    """A data frame of whatever holds the rows: a data frame, a pandas frame, a list of rows or mappings, a mapping of columns, or the path of a file."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return read(spark, data, schema, **options)
    if isinstance(data, dict):
        data = [dict(zip(data, row, strict=True)) for row in zip(*data.values(), strict=True)]
    return spark.createDataFrame(data, schema)


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **properties) -> DataFrame:
    """Rows of a query of a database; with *key*, a whole number, read in *parts* ranges from *low* to *high* at once. Predicates are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) AS q").options(**properties)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `sheet` (from 1), `row` (from 1), `cells` (array of text, null where a cell is missing) of spreadsheets; one workbook at a time is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows = list(_sheets(content))
                yield pd.DataFrame({"path": [name] * len(rows), "sheet": [r[0] for r in rows], "row": [r[1] for r in rows], "cells": [r[2] for r in rows]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, "path string, sheet int, row int, cells array<string>")


def _sheets(content: bytes) -> Iterator[tuple[int, int, list]]:
    import io
    import xml.etree.ElementTree as X
    import zipfile

    plain = lambda tag: tag.rsplit("}", 1)[-1]
    texts = lambda node: "".join(t.text or "" for t in node.iter() if plain(t.tag) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = [texts(e) for e in X.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for sheet, name in sheets:
            for row in (e for e in X.fromstring(book.read(name)).iter() if plain(e.tag) == "row"):
                cells: list = []
                for c in row:
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    value = next((v.text for v in c if plain(v.tag) == "v"), None)
                    text = texts(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value else value
                    cells += [None] * (at - len(cells)) + [text]
                yield sheet, int(row.get("r") or 0), cells


def hocr_words(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `pos`, `word` and its box x0, y0, x1, y1 of recognised pages in hOCR."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    span = r"<span[^>]*class=['\"]ocrx_word['\"][^>]*title=['\"][^'\"]*?bbox (\d+ \d+ \d+ \d+)[^'\"]*['\"][^>]*>(.*?)</span>"
    found = pages.select("path", F.posexplode(F.arrays_zip(F.regexp_extract_all("value", F.lit(f"(?s){span}"), 1).alias("b"), F.regexp_extract_all("value", F.lit(f"(?s){span}"), 2).alias("w"))).alias("pos", "x"))
    box = lambda k: F.get(F.split("x.b", " "), F.lit(k)).cast("double")
    return found.select("path", "pos", F.trim(F.regexp_replace("x.w", "<[^>]*>", "")).alias("word"), box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"))


def images_with_annotations(annotations: DataFrame) -> DataFrame:
    """`file_name` and `annotations`, all of an image in order of category and box, from rows of coco_annotations; files without crowds count as 0."""
    each = F.struct("category", "x0", "y0", "x1", "y1", "area", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))
    return annotations.groupBy("file_name").agg(F.array_sort(F.collect_list(each)).alias("annotations"))


def form_relations(forms: DataFrame) -> DataFrame:
    """`doc`, `head`, `tail`: ids of linked fields, each link once, questions first; *forms*: doc, form array<struct<id, label, linking array<array<int>>>>."""
    fields = forms.select("doc", F.inline("form"))
    links = fields.select("doc", F.explode("linking").alias("l")).select("doc", F.get("l", F.lit(0)).alias("a"), F.get("l", F.lit(1)).alias("b"))
    kinds = fields.select("doc", F.col("id").alias("a"), F.col("label").alias("kind"))
    turned = links.join(kinds, ["doc", "a"], "left").withColumn("turn", F.col("kind") == "answer")
    return turned.select("doc", F.when(F.col("turn"), F.col("b")).otherwise(F.col("a")).alias("head"), F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")).alias("tail")).distinct()


def write_documents(df: DataFrame, path: str) -> None:
    """A JSON document per row, over several lines, characters as they are, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv_marked(df: DataFrame, path: str) -> None:
    """CSV files that begin with a byte order mark, as spreadsheets want; read() takes it off."""
    first, *rest = df.columns
    write_csv(df.select(F.col(f"`{first}`").alias(f"﻿{first}"), *[F.col(f"`{c}`") for c in rest]), path)


def append_csv_log(df: DataFrame, path: str) -> None:
    """Rows added to a log of CSV files, each with its header."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def upsert_csv(target: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """*target* with the rows of a CSV file: known keys are updated, others added; all data rows count."""
    from ..operators.relational import upsert

    rows = read(target.sparkSession, path, ", ".join(f"`{n}` {t}" for n, t in target.dtypes))
    return upsert(target, missing_to_null(rows), keys)


def write_page_tables(cells: DataFrame, page: str, table_id: str, path: str) -> None:
    """CSV files of tables, in folders named by page and the table's number on its page, from 0."""
    from pyspark.sql import Window

    number = F.dense_rank().over(Window.partitionBy(page).orderBy(table_id)) - 1
    cells.withColumn("_k", number).withColumn("name", F.concat_ws("_", F.col(page).cast("string"), F.col("_k").cast("string"))).drop("_k").write.mode("overwrite").option("header", True).partitionBy("name").csv(path)
