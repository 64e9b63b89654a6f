"""The registered queries against SQL, and the pipeline against its operators."""

import duckdb
import pytest

import corpus_pipeline
from llm_cases import same_rows
from tickloom.llm import additive, overlap_join, phrases
from tickloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    names = [column[0] for column in wanted.description]
    assert sorted(names) == sorted(found.columns)
    same_rows(found.select(*names).collect(), wanted.fetchall())


def test_pipeline(spark, tmp_path):
    docs = source = spark.read.parquet(f"{SF}/documents.parquet")
    results = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"s{number}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"s{number}"))
        results[name] = (before, docs)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.schema == source.schema
    ids = lambda frame: sorted(r[0] for r in frame.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = results["quality"]
    assert ids(after) == ids(additive.classify(before, labels).where("predicted = 1"))
    before, after = results["near_duplicates"]
    assert ids(after) == ids(overlap_join.join_documents(before).where("doc_id = component_id"))
    before, after = results["decontamination"]
    found = phrases.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit = 0").selectExpr("id AS doc_id")
    assert ids(after) == ids(found)
    before, after = results["source_mix"]
    copies = ids(after)
    assert set(copies) <= set(ids(before)) and max(map(copies.count, set(copies))) <= 3
    before, after = results["token_ids"]
    assert ids(after) == ids(before)
