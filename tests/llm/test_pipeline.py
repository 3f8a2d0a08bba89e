"""Registered queries against their SQL, and the pipeline's stages against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import queries
from colloquy.llm.common import documents
from colloquy.session import materialize
from tests.llm.test_text_search import line_truth, near_truth
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_stages_on_what_the_stage_before_kept(spark):
    docs = documents(spark, SF)
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = docs.collect()
        columns, docs = docs.columns, materialize(stage(spark, docs, SF), name)
        assert docs.columns[:len(columns)] == columns and (docs.columns == columns or name == "mixing")
    scored = {r.doc_id: r.p_toxic for r in queries.op8_toxicity(spark, SF).collect()}
    ids = {name: [r.doc_id for r in rows[name]] for name in rows}
    assert sorted(ids["line_dedup"]) == sorted(i for i in ids["toxicity"] if scored[i] < 0.5)
    lines = line_truth([(r.doc_id, r.text) for r in rows["line_dedup"]])
    assert {(r.doc_id, r.text) for r in rows["near_dedup"]} == {(i, text) for i, text, _, _ in lines}
    near = near_truth([(r.doc_id, r.text) for r in rows["near_dedup"]])
    assert sorted(ids["decontamination"]) == sorted(i for i, _, _, kept in near if kept)
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in rows["decontamination"] if not any(x in r.text.lower() for x in items)]
    assert sorted(ids["mixing"]) == sorted(clean)
    assert set(r.doc_id for r in docs.collect()) <= set(clean)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, SF).count() == docs.count()


def test_awkward_rows_go_through_every_stage(spark):
    docs = documents(spark, SF)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", None, None, None), (1, None, "en", "src0", 0), (1, None, "en", "src0", 0)], docs.schema,
    )
    docs = docs.limit(30).unionByName(odd).withColumns({"node": F.lit(1), "key": F.lit("x"), "component": F.lit(2), "copy_no": F.lit("c")})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() <= 4 * before
        empty = materialize(stage(spark, empty, SF), f"empty-{name}")
        assert empty.count() == 0 and Counter(empty.columns) == Counter(docs.columns)
