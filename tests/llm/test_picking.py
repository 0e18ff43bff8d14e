import pytest

import corpus_pipeline
from siftstone.llm import picking
from tests.llm.cases import docs as odd, same


def moved_bytes(df):
    """Bytes that the shuffles of ``df`` move when it is collected."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            out += node.metrics().apply("dataSize").value()
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ResultQueryStageExec": "plan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan"}.get(name)
        below = node.children()
        todo += [getattr(node, inner)()] if inner else [below.apply(k) for k in range(below.size())]
    return out


@pytest.mark.parametrize("marks", [1 << 24, 2])
@pytest.mark.parametrize("ids", [[], [1, 3, 7], [None, 2, 99], [1, 1, 2, 3, 4, 5, 6, 7, 8, None]])
def test_rows_are_those_of_the_join(spark, monkeypatch, marks, ids):
    monkeypatch.setattr(picking, "MARKS", marks)
    docs = odd(spark, clash=True).withColumn("bucket", picking.F.lit("x")).withColumn("bit", picking.F.lit("x"))
    got = picking.rows_of(docs, spark.createDataFrame([(k,) for k in ids], "id bigint"))
    assert got.columns == docs.columns
    assert same(got, spark.createDataFrame([r for r in docs.collect() if r.doc_id in ids], docs.schema))


def test_an_empty_table_gives_no_rows(spark):
    assert picking.rows_of(odd(spark, []), spark.createDataFrame([(1,)], "id bigint")).count() == 0


def test_the_pipelines_mixture_leaves_texts_where_they_are(spark):
    words = "some of the words that are in every one of these rather long texts ".split()
    rows = [(k, " ".join(f"{w}{k if k % 3 else k - 1}" for w in words * 20), "a") for k in range(1, 301)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ids were many
    try:
        got = corpus_pipeline.mixture(spark, docs, "")
        assert moved_bytes(got) < 0.02 * sum(len(r[1]) for r in rows)
        assert 150 < got.count() < 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
