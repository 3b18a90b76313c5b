import json

import pytest

from quantafold.sources.catalog import Catalog
from quantafold.sources.files import append_log, coco_annotations, form_words, in_chunks, listing, missing_to_null, named_within, read, voc_boxes, with_keyword, write_csv, write_json
from quantafold.sources.tables import listed, own_names


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, \"b\"\nc", "")], "id int, t string, e string")
    write_csv(df, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in read(spark, str(tmp_path / "x.csv")).collect()] == [(1, "a, \"b\"\nc", None)]
    write_json(df, str(tmp_path / "x.ndjson"))
    assert read(spark, str(tmp_path / "x.ndjson"), "id int, t string").collect()[0].t == "a, \"b\"\nc"
    (tmp_path / "bom.csv").write_text("﻿id,name\n1,x\n", encoding="utf-8")
    assert read(spark, str(tmp_path / "bom.csv")).columns == ["id", "name"]
    (tmp_path / "doc.json").write_text(json.dumps({"a": {"b": [1, 2]}}, indent=2))
    assert read(spark, str(tmp_path / "doc.json")).collect()[0].a.b == [1, 2]
    assert missing_to_null(df).collect()[0].e is None
    with pytest.raises(ValueError):
        read(spark, "x.pdf")


def test_listing_and_log(spark, tmp_path):
    for n in ("a.txt", "0b.txt", "c.md"):
        (tmp_path / n).write_text("x")
    files = listing(spark, str(tmp_path), ".txt", "0")
    assert [r.name for r in files.collect()] == ["a.txt"] and named_within(files, "see a for more").count() == 1
    for _ in range(2):
        append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    pages = spark.createDataFrame([(1, "Scope 1 Emissions"), (2, "nothing")], "p int, t string")
    assert [r.p for r in with_keyword(pages, "t", ["EMISSIONS"]).collect()] == [1]


def test_annotations(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<annotation><filename>f</filename><object><name>table</name><bndbox><xmin>11</xmin><ymin>21</ymin><xmax>30</xmax><ymax>40</ymax></bndbox></object><object><name>row</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert sorted(tuple(r)[1:] for r in voc_boxes(spark, str(tmp_path / "v.xml")).collect()) == [("row", 0, 0, 3, 4), ("table", 10, 20, 30, 40)]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "f"}], "categories": [{"id": 7, "name": "cell"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0}]}))
    assert tuple(coco_annotations(spark, str(tmp_path / "c.json")).collect()[0])[:6] == ("f", "cell", 1, 2, 4, 6)
    forms = spark.createDataFrame([("d", [{"label": "question", "words": [{"text": "Who"}, {"text": "?"}]}, {"label": "other", "words": [{"text": "x"}]}])], "doc string, form array<struct<label: string, words: array<struct<text: string>>>>")
    assert [r.tag for r in form_words(forms).orderBy("field", "pos").collect()] == ["B-QUESTION", "I-QUESTION", "O"]


def test_catalog(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "n.parquet"))
    catalog = Catalog(spark, str(tmp_path))
    catalog.register("two", spark.range(2))
    assert catalog.names() == ["n", "two"] and catalog.fields("n") == ["id"] and catalog.sql("SELECT count(*) AS c FROM n WHERE id >= :least", least=1).collect()[0].c == 2
    for bad in (lambda: catalog.get("none"), lambda: catalog.register("n", spark.range(1))):
        with pytest.raises(ValueError):
            bad()


def test_chunks(spark):
    got = in_chunks(spark.range(10), ["id"], 3).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == [4, 4, 2]


def test_own_names(spark):
    schema = spark.createDataFrame([(1, '["A", "a1"]', '["kg", "t"]', None, None), (2, "plain", "m3", 1.0, "x"), (3, None, "t", None, None), (4, '["A"]', "t", None, None)], "id bigint, metric string, unit string, density_ntp_kg_per_m3 double, category string")
    assert {r.own_name: (r.synonyms, r.common_unit) for r in own_names(schema).collect()} == {"A": (["A", "a1"], "kg"), "plain": (["plain"], "m3")}
    facts = spark.createDataFrame([("A",), ("a1",), (None,)], "target_metric string")
    assert listed(facts, schema).count() == 1
