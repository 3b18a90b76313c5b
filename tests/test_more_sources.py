import io
import json
import zipfile
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantafold.functions import scorers
from quantafold.functions import text as T
from quantafold.sources import files as S
from quantafold.sources.catalog import Catalog
from quantafold.sources.pdf import pdf_spans, pdf_words
from quantafold.streaming.events import latest_version, parquet_upsert, track_frame


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Metric</t></si><si><r><t>20</t></r><r><t>20</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>4.5</v></c><c r="C3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheets(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook())
    assert sorted(tuple(r)[1:] for r in S.read_xlsx(spark, str(tmp_path)).collect()) == [(1, 1, ["Metric", None, "2020"]), (1, 3, [None, "4.5", "x"])]


def test_hocr(spark, tmp_path):
    (tmp_path / "p.hocr").write_text("<html><span class='ocrx_word' id='w1' title='bbox 10 20 30 40; x_wconf 9'><strong>Scope</strong></span>\n<span class=\"ocrx_word\" title=\"bbox 35 20 50 40\">1</span></html>")
    assert [tuple(r)[1:] for r in S.hocr_words(spark, str(tmp_path / "p.hocr")).orderBy("pos").collect()] == [(0, "Scope", 10, 20, 30, 40), (1, "1", 35, 20, 50, 40)]


def test_pdf(spark, tmp_path):
    page = b"BT /F1 10 Tf 50 700 Td (Scope \\(1\\)) Tj 0 -12 Td [(total) -20 (s)] TJ ET"
    packed = zlib.compress(b"BT /F2 8 Tf 1 0 0 1 20 30 Tm <48656C6C6F> Tj ET")
    stream = lambda body, more=b"": b"<< /Length %d %s >>\nstream\n%s\nendstream\n" % (len(body), more, body)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n" + stream(page) + b"endobj\n2 0 obj\n" + stream(packed, b"/Filter /FlateDecode") + b"endobj\n3 0 obj\n" + stream(b"q Q") + b"endobj\n")
    (tmp_path / "empty.pdf").write_bytes(b"%PDF-1.4\n")
    spans = sorted(tuple(r)[1:] for r in pdf_spans(spark, str(tmp_path)).collect())
    assert spans == [(1, 0, "Scope (1)", 10.0, "F1", 50.0, 700.0, 95.0, 710.0), (1, 1, "totals", 10.0, "F1", 50.0, 688.0, 80.0, 698.0), (2, 0, "Hello", 8.0, "F2", 20.0, 30.0, 40.0, 38.0)]
    words = sorted((r.page, r.block, r.word_no, r.word, r.x0, r.x1) for r in pdf_words(spark, str(tmp_path)).collect())
    assert words[:2] == [(1, 0, 0, "Scope", 50.0, 75.0), (1, 0, 1, "(1)", 80.0, 95.0)]


def test_documents_and_marked_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "溫室", None)], "id int, t string, e string")
    S.write_documents(df, str(tmp_path / "d"))
    whole = spark.read.text(str(tmp_path / "d"), wholetext=True).filter("value <> ''").collect()[0].value
    assert json.loads(whole) == {"id": 1, "t": "溫室", "e": None} and whole.count("\n") > 2 and "溫" in whole
    S.write_csv_marked(df, str(tmp_path / "m.csv"))
    assert S.read(spark, str(tmp_path / "m.csv")).columns == ["id", "t", "e"]
    for _ in range(2):
        S.append_csv_log(df.select("id", "t"), str(tmp_path / "log.csv"))
    assert [tuple(r) for r in S.read(spark, str(tmp_path / "log.csv")).collect()] == [(1, "溫室")] * 2
    (tmp_path / "u.csv").write_text("id,t\n1,new\n2,more\n")
    got = S.upsert_csv(df.select("id", "t"), str(tmp_path / "u.csv"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "new"), (2, "more")]


def test_page_tables(spark, tmp_path):
    cells = spark.createDataFrame([(1, "t1", "a"), (1, "t2", "b"), (2, "t3", "c")], "page int, table_id string, text string")
    S.write_page_tables(cells, "page", "table_id", str(tmp_path / "t"))
    assert {r.name: r.text for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()} == {"1_0": "a", "1_1": "b", "2_0": "c"}


def test_frames_of_whatever_holds_the_rows(spark):
    want = [(1, "a"), (2, "b")]
    for data in ([{"x": 1, "y": "a"}, {"x": 2, "y": "b"}], {"x": [1, 2], "y": ["a", "b"]}, pd.DataFrame({"x": [1, 2], "y": ["a", "b"]}), spark.createDataFrame(want, "x int, y string")):
        assert sorted((r.x, r.y) for r in S.frame(spark, data).collect()) == want
    with pytest.raises(ValueError):
        S.frame(spark, "rows.unknown")


def test_forms_and_images(spark):
    forms = spark.createDataFrame([("d", [{"id": 1, "label": "question", "linking": [[1, 2]]}, {"id": 2, "label": "answer", "linking": [[2, 1]]}])], "doc string, form array<struct<id: int, label: string, linking: array<array<int>>>>")
    assert [tuple(r) for r in S.form_relations(forms).collect()] == [("d", 1, 2)]
    rows = spark.createDataFrame([("f", "b", 1.0, 2.0, 3.0, 4.0, 4.0, None), ("f", "a", 1.0, 2.0, 3.0, 4.0, 4.0, 1)], "file_name string, category string, x0 double, y0 double, x1 double, y1 double, area double, iscrowd int")
    assert [(a.category, a.iscrowd) for a in S.images_with_annotations(rows).collect()[0].annotations] == [("a", 1), ("b", 0)]


def test_factories_are_lazy_and_metadata_agrees(spark, tmp_path):
    catalog, made = Catalog(spark, str(tmp_path)), []
    catalog.register_factory("late", lambda: made.append(1) or spark.range(2), classes=["a"])
    assert catalog.names() == ["late"] and not made
    assert catalog.get("late").count() == catalog.get("late").count() == 2 and made == [1]
    assert catalog.describe("late", root="x") == {"classes": ["a"], "root": "x"}
    for bad in (lambda: catalog.describe("late", root="y"), lambda: catalog.register_factory("late", lambda: spark.range(1))):
        with pytest.raises(ValueError):
            bad()


def test_batches_run_again_merge_once(spark, tmp_path):
    merge, folder = parquet_upsert(str(tmp_path / "t"), ["k"]), str(tmp_path / "t")
    with pytest.raises(ValueError):
        latest_version(spark, folder)
    one, two = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), spark.createDataFrame([("a", 2), ("c", 2)], "k string, n int")
    for rows, batch in ((one, 0), (two, 1), (two, 1)):
        merge(rows, batch)
    assert sorted(map(tuple, latest_version(spark, folder).collect())) == [("a", 2), ("b", 1), ("c", 2)]


def test_tracker_by_assignment():
    state, _ = track_frame({}, 0, [(0, [0, 0, 10, 10]), (1, [8, 0, 18, 10])])
    # greedy gives box 0 the track it overlaps most and leaves box 1 too little; the assignment serves both
    frame = [(0, [4, 0, 14, 10]), (1, [3, 0, 13, 10])]
    assert len({t for _, t in track_frame(state, 1, frame, 0.2, optimal=True)[1]} & {0, 1}) == 2
    assert track_frame({}, 0, [], optimal=True) == ({"tracks": {}, "next": 0}, [])


def test_fragments_and_positions(spark):
    texts = ["an energy and energy", "energy", "none", "", None, "energyenergy"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in df.withColumn("f", T.fragments("t", "energy")).collect():
        if r.t is None:
            assert r.f is None
            continue
        assert "".join(r.t[x.start : x.end] for x in r.f) == r.t and [r.t[x.start : x.end] for x in r.f if x.kind == "entity"] == ["energy"] * r.t.count("energy")
    found = spark.createDataFrame([("5 kg and 12.5 kg",)], "t string").select(T.matches("t", r"\d+(?:\.\d+)? kg").alias("m")).collect()[0].m
    assert [tuple(x) for x in found] == [("5 kg", 0, 3), ("12.5 kg", 9, 15)]


def test_small_scalars(spark):
    df = spark.createDataFrame([("Ünïcode ﬁne", "abcd", "CamelCaseName"), (None, None, None)], "a string, b string, c string")
    one, none = df.select(T.ascii_of("a").alias("x"), T.block_ratio("b", F.lit("abxd")).alias("y"), T.camel_split("c").alias("z"), T.spaced("b").alias("s")).collect()
    assert (one.x, one.y, one.z, one.s) == ("Unicode fine", 0.75, "Camel Case Name", ["a bcd", "ab cd", "abc d"]) and none.x is None and none.y is None
    names = spark.createDataFrame([("100044_Some Company_ESG Report 2006.pdf",), ("Name_2006Report.pdf",), ("Annual Report 2006.pdf",), (None,)], "f string")
    assert [r.c for r in names.select(T.file_company("f").alias("c")).collect()] == ["Some Company", "Name", None, None]


def test_scorers_can_be_put_in_place(spark):
    df = spark.createDataFrame([("5 kg",), ("no",), (None,)], "v string")
    got = [tuple(r.made) for r in scorers.apply(df, "v", scorers.split_by_rule, "number string, unit string").collect()]
    assert got == [("5", "kg"), (None, None), (None, None)]
    assert scorers.keep(df, "v", lambda s: s.str.len() > 2).count() == 1 and scorers.keep(df, "v", scorers.pass_through).count() == 2
