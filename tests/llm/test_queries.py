import re

import __spark_entry__ as driver

SMALL = "/root/testdata/sf0.001"


def test_written_operators_and_pipeline_are_registered():
    names = driver.queries()
    assert {m[1] for x in names if (m := re.match(r"(op\d+)_", x))} >= {"op1", "op2", "op5", "op7", "op8"}
    assert "pipeline" in names


def test_operators_give_a_row_for_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = driver.queries()
    for name in ("op2_string_kernel_language", "op7_hierarchical_bayes_quality"):
        assert names[name](spark, SMALL).count() == docs.count(), name
    worded = docs.where("length(text) > 0").select("doc_id").distinct().count()
    assert names["op8_best_fit_packing"](spark, SMALL).select("doc_id").distinct().count() == worded
    assert names["op5_subset_sum_mixing"](spark, SMALL).count() > 0


def test_pipeline_packs_only_documents(spark):
    bins = driver.queries()["pipeline"](spark, SMALL)
    assert bins.columns == ["doc_id", "piece", "begin", "n_tokens", "bin_id"]
    assert bins.count() > 0
    assert not bins.join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id", "left_anti").count()
    assert bins.groupBy("bin_id").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048
