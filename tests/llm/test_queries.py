"""Each query of the subpackage on the least test data, against its SQL and against what its output must hold."""

import os

import pytest

from quantafold.llm import queries

FOLDER = os.environ.get("QUANTAFOLD_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER) or not os.path.isdir("/opt/tokenizers"), reason="no test data")
COLUMNS = {
    "p2_found": ["name_a", "name_b"], "p2_entities": ["name", "entity", "alike"], "p3_found": ["id", "target_metric"], "p5_found": ["group_id", "id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def made(spark):
    return {name: query(spark, FOLDER).cache() for name, query in queries.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(made, name):
    rows = made[name].collect()
    assert made[name].columns == COLUMNS.get(name, made[name].columns)
    assert bool(rows) != (name in ("p7_losses", "p8_overfull"))


def test_no_row_is_lost(spark, made):
    facts, texts = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("environment_info", "test_text_info"))
    names = {r[0] for t in (facts, texts) for r in t.select("company_name").filter("trim(company_name) <> ''").distinct().collect()}
    assert {r.name for r in made["p2_entities"].collect()} == names
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert made["p7_ids"].count() == documents.count()
    per_kind = made["p8_packed"].groupBy("container_id").agg({"doc_id": "count"}).collect()
    assert {r.container_id for r in per_kind} == {r.container_id for r in spark.read.parquet(f"{FOLDER}/token_container.parquet").collect()}
    assert made["p8_packed"].select("doc_id").distinct().count() == documents.count()
    assert {r.id for r in made["p5_found"].collect()} <= {r.id for r in facts.select("id").collect()}
    assert made["p9_report"].agg({"cut": "sum"}).collect()[0][0] == made["p9_found"].count()
    assert {tuple(r) for r in made["p5_fused"].select("group_id").collect()} == {tuple(r) for r in made["p5_found"].select("group_id").collect()}
