import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators import runner, scan
from siftstone.sinks import render
from siftstone.sources.corpus import src_files

SF, WHEN = "/root/testdata/sf0.001", "2026-01-01T00:00:00.000Z"
FORMS = {"json": render.as_json, "sarif": render.as_sarif, "pretty": render.as_pretty}


def joined(df):
    rows = df.collect()
    assert [r.piece for r in rows] == list(range(len(rows)))
    return "\n".join(r.document for r in rows)


@pytest.fixture(scope="module")
def found(spark):
    found = scan.unsafe_findings(src_files(spark, SF)).withColumn("severity", F.when(F.col("line") < 4, "error").when(F.col("line") < 7, "info").otherwise("warn"))
    odd = found.limit(40).withColumn("message", F.lit('a "b"\n\\   é 😀 \x1b findings are here')).withColumn("confidence", F.lit(1.0)).withColumn("severity", F.lit("off")).withColumn("rule_id", F.lit("x"))
    fixed = found.limit(40).withColumn("fix", F.struct(F.lit("a").alias("from"), F.lit("b\n").alias("to"))).withColumn("part", F.lit(1)).withColumn("rule_id", F.lit("y"))
    return found.limit(500).unionByName(odd).unionByName(fixed).localCheckpoint()


@pytest.mark.parametrize("form", FORMS)
def test_pieces_make_the_document(found, form):
    want = FORMS[form](render.result(found, timestamp=WHEN))
    assert joined(render.pieces(found, form, timestamp=WHEN)) == want


@pytest.mark.parametrize("form", FORMS)
def test_no_findings(found, form):
    none = found.where("false")
    assert joined(render.pieces(none, form, timestamp=WHEN)) == FORMS[form](render.result(none, timestamp=WHEN))


def test_a_document_is_in_many_rows(spark):
    """One row can't hold the document of a large table."""
    rows = render.pieces(runner.run(src_files(spark, SF)), "json")
    assert rows.count() == 2721 + 2 and len(json.loads(joined(rows))["findings"]) == 2721
