"""The pipeline and the oracles of the training-data queries."""

import pytest

import corpus_pipeline
from quitanda.llm import line_spread, merge_dropout, ngram_join, pigeonhole, queries, toxicity
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    held = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
            held = spark.createDataFrame(out.collect(), docs.schema)
    clean = docs.join(toxicity.score(docs, toxicity.fit(docs, labels)).filter("not rejected").select("doc_id"), "doc_id", "left_semi")
    cut = line_spread.drop_boilerplate(clean.select(docs.columns))
    one = ngram_join.ngram_jaccard(cut).filter("component_id = doc_id").select("doc_id")
    cut = cut.join(one, "doc_id", "left_semi")
    hit = pigeonhole.contaminated(cut, items).filter("contaminated").select("doc_id")
    want = merge_dropout.checked(cut.join(hit, "doc_id", "left_anti"), queries.dropout_model())
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, ran.collect())) == sorted(map(repr, want.select(ran.columns).collect()))
    assert all(r["lossless"] for r in ran.collect())


def test_empty_documents(spark):
    held = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        held = spark.createDataFrame(stage(spark, held, SF).collect(), stage(spark, held, SF).schema)
    assert held.count() == 0
