from pathlib import Path

import pytest
from oracle import assert_same

from lexigraph.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert assert_same(queries()[name](spark, DATA), oracle_sql()[name], DATA) > 0


@pytest.mark.parametrize("name", ["op3_token_counts", "op6_sentencepiece", "op7_language_id", "op8_token_binary"])
def test_every_document_has_a_row(spark, name):
    got = sorted(r["doc_id"] for r in queries()[name](spark, DATA).select("doc_id").collect())
    assert got == sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


def test_every_page_has_a_row(spark):
    assert queries()["op9_html_extraction"](spark, DATA).count() == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_copies_form_groups(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    group = {r["doc_id"]: r["group_id"] for r in queries()["op4_simhash_near_dedup"](spark, DATA).collect()}
    same = {}
    for r in docs.collect():
        same.setdefault(r["text"], []).append(r["doc_id"])
    for ids in same.values():
        if len(ids) > 1 and any(c.isalnum() for c in docs.where(docs.doc_id == ids[0]).first()["text"]):
            assert len({group[i] for i in ids}) == 1


def test_toxicity_on_labelled_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    found = {r["doc_id"] for r in queries()["op2_toxicity"](spark, DATA).collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in found for i in clean) <= 0.1 * len(clean)
