import tiktoken
from pyspark.sql import functions as F

from siftstone.llm.token_table import read, stripes, write
from siftstone.llm.tokens import VOCABULARY, tokens

from .cases import ROWS, docs, same


def written(spark, tmp_path, df, **parameters):
    path = str(tmp_path / "t.orc")
    write(df, path, **parameters)
    return path


def test_exact_round_trip_of_every_case(spark, tmp_path):
    path = written(spark, tmp_path, docs(spark, clash=True))
    got = read(spark, path).collect()
    encode = tokens(VOCABULARY).encode
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.token_ids) for r in got))) == sorted(map(repr, ((k, len(encode(t or "")), encode(t or "")) for k, t, _, _ in ROWS)))
    decode = encode.__self__
    assert isinstance(decode, tiktoken.Encoding)
    assert {(r.doc_id, decode.decode(r.token_ids)) for r in got} == {(k, t or "") for k, t, _, _ in ROWS}


def test_stripes_are_read_apart_and_metadata_prunes(spark, tmp_path):
    many = spark.range(20_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("document number "), F.sha2(F.col("id").cast("string"), 512)).alias("text")).coalesce(1)
    path = written(spark, tmp_path, many, stripe_bytes=1 << 18, index_rows=1000)
    found = stripes(path)
    assert len(found) > 3 and sum(rows for _, _, rows in found) == 20_000
    one = read(spark, path, [300])
    assert [r.doc_id for r in one.collect()] == [300]
    assert read(spark, path, [301]).count() == 0  # between the least and the most of its stripe: the Bloom filter says no

    def scanned(df):
        df = df.select("doc_id", "n_tokens")
        df.collect()
        scan = [x for x in _nodes(df._jdf.queryExecution().executedPlan()) if x.nodeName().startswith("Scan orc")]
        return scan[0].metrics().apply("numOutputRows").value()

    assert scanned(read(spark, path)) == 20_000
    assert scanned(one) <= 1000
    assert scanned(read(spark, path, [301])) <= 1000
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()


def _nodes(plan):
    plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        todo += [p.children().apply(k) for k in range(p.children().size())]
        if p.nodeName().startswith("WholeStageCodegen") or p.nodeName().startswith("InputAdapter"):
            continue
    return out


def test_empty_table(spark, tmp_path):
    path = written(spark, tmp_path, docs(spark, []))
    assert read(spark, path).count() == 0
    assert same(read(spark, path), read(spark, path, [1]))
