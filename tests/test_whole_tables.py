"""Queries over whole tables: rows that a filter once left out."""

import datetime
import math

from quantafold.operators import relational as R
from quantafold.plans import registry


def run(spark, folder, name, **tables):
    """Rows of a query over a folder of the given tables: name -> (rows, schema)."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return registry.QUERIES[name](spark, str(folder)).collect()


def test_sentence_counts_of_every_text(spark, tmp_path):
    texts = [
        ("One. Two! Three?", 3), ("It’s “done”. Next.", 2), ("One.\nTwo.\r\n\r\nThree", 3), ("Use of 5 m³. Done.", 2), ("排放量下降。用電量上升！為何？", 3), ("第一句。\n第二句。\n", 2), ("混合 text. 第二句。Third.", 3),
        ("Émissions réduites. Économies à venir.", 2), ("A emissão caiu. Não há mais.", 2), ("One. Two.　Three.", 3), ("One.​", 1), ("A\x01B. C", 2), ("3.5 kg", 1), ("", 0), (" \n　", 0), (None, None),
    ]
    got = run(spark, tmp_path, "sentence_counts", documents=([(k, t) for k, (t, _) in enumerate(texts)], "doc_id bigint, text string"))
    assert {r.doc_id: r.sentences for r in got} == {k: n for k, (_, n) in enumerate(texts)}


def close(a, b):
    return a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-6)


def test_shares_of_all_sizes(spark, tmp_path):
    facts = [(1, 5.0, "%", 0.05), (2, 2.5e6, "tonnes", 2.5e6), (3, -3e7, "pct", -3e5), (4, 123456789012.5, None, 123456789012.5), (5, 1e6, "‰", 1e3), (6, None, "%", None), (7, 0.0, "kWh", 0.0)]
    got = run(spark, tmp_path, "percent_scale", environment_info=([f[:3] for f in facts], "id bigint, converted_value double, unit string"))
    assert len(got) == len(facts) and {r.id for r in got} == {f[0] for f in facts}
    assert all(close(r.fraction, {f[0]: f[3] for f in facts}[r.id]) for r in got)


def test_amounts_of_all_sizes(spark, tmp_path):
    facts = [(1, 780.0, "HKD", "2020", 100.0), (2, 7.8e11, "HKD", "FY2020", 1e11), (3, -7.75e9, "HKD", "2021", -1e9), (4, 1e9, "HKD", "2020", 1e9 / 7.8), (5, None, "HKD", "2020", None)]
    others = [(8, 5.0, "kWh", "2020"), (9, 5.0, "HKD", "1950")]
    rates = [("USD", 2020, 7.8), ("USD", 2021, 7.75), ("CNY", 2020, 1.1)]
    got = run(spark, tmp_path, "currency_year_end", environment_info=([f[:4] for f in facts] + others, "id bigint, converted_value double, converted_unit string, year string"), fx_rate=(rates, "currency string, rate_year int, hkd_per_unit double"))
    assert len(got) == len(facts) and {r.id for r in got} == {f[0] for f in facts}
    assert all(math.isclose(r.usd, want, rel_tol=1e-12, abs_tol=1e-4) if want is not None else r.usd is None for r in got for want in [{f[0]: f[4] for f in facts}[r.id]])


def test_lookups_over_all_customers(spark, tmp_path):
    orders = [(1, 7, "F", 1000.0, "5-LOW"), (2, 1001, "O", 399999.99, "5-LOW"), (3, 10**9, "F", 5000.0, "5-LOW"), (4, None, "F", 5000.0, "5-LOW"), (5, 1, "P", 5000.0, "5-LOW"), (6, 2000, "F", 400000.0, "5-LOW"), (7, 2000, "F", 999.99, "5-LOW"), (8, 2000, "F", 5000.0, "1-URGENT")]
    got = run(spark, tmp_path, "lookups", orders=(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"))
    assert sorted(r.o_orderkey for r in got) == [1, 2, 3, 4]
    made = spark.read.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.o_orderkey for r in made.filter(R.where(made, o_totalprice__lte=1000.0)).collect()) == [1, 7]


def test_status_of_every_document(spark, tmp_path):
    t = [None, *[datetime.datetime(2020, 1, k) for k in range(1, 5)]]
    runs = [  # document, process 1, process 2, last, progress, status
        ("repeated", t[1], t[2], t[2], 100.0, "completed"), ("repeated", t[1], t[2], t[2], 100.0, "completed"),
        ("second", t[1], None, t[1], 40.0, "uploaded"), ("second", t[1], t[2], t[2], 30.0, "completed"),
        ("by status", t[1], None, t[1], 40.0, "processing"), ("by status", t[1], None, t[1], 40.0, "uploaded"), ("by status", t[1], None, t[1], 40.0, None),
        ("latest", t[3], None, t[3], 40.0, "error"), ("latest", t[2], t[4], t[4], 100.0, "completed"), ("latest", t[2], t[4], t[4], 100.0, "completed"),
        ("no time", None, None, None, None, "uploaded"), ("some time", None, None, None, 50.0, "uploaded"), ("some time", t[1], None, t[1], 40.0, "processing"),
        ("null last", t[2], None, t[2], 40.0, None), ("null last", t[1], None, t[1], 40.0, "uploaded"),
    ]
    want = {"repeated": ("completed", 100.0), "second": ("completed", 40.0), "by status": ("uploaded", 40.0), "latest": ("error", 100.0), "no time": ("uploaded", None), "some time": ("processing", 50.0), "null last": (None, 40.0)}
    schema = "document_id string, process1_update_date timestamp_ntz, process2_update_date timestamp_ntz, last_process_date timestamp_ntz, process1_progress double, status string"
    for order in (runs, runs[::-1]):
        got = run(spark, tmp_path, "file_status", pdffiles=(order, schema))
        assert len(got) == len(want) and {r.document_id: (r.status, r.progress) for r in got} == want
