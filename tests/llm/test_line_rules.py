import duckdb

from siftstone.llm.line_rules import SQL, cleaned

from .cases import docs, same

GOOD = "This is an ordinary sentence that says something, and it ends here."


def test_lines_are_judged_first_and_then_the_document(spark):
    texts = {
        1: f"{GOOD}\nHome | News | Sport | Contact.\n{GOOD[:30]}.\nAll rights reserved 2020 by us.\nNo mark at the end",
        2: "Home | News | Sport.\n" * 30 + GOOD,
        3: f"{GOOD} 😀\r\n“{GOOD}”\n\n   \n{GOOD}\n{GOOD}",
        4: "BUY!! NOW!! CHEAP!! PILLS!! HERE!!",
        5: "word%%% other$$$ thing&&& more***.",
    }
    got = {r.doc_id: r for r in cleaned(docs(spark, [(k, t, "en", "a") for k, t in texts.items()]), most_lost=0.8).collect()}
    assert got[1].text == f"{GOOD}\n{GOOD[:30]}." and (got[1].n_lines, got[1].n_kept) == (5, 2)
    assert set(got) == {1, 3}
    assert got[3].text == f"“{GOOD}”\n{GOOD}" and got[3].n_lines == 4


def test_tie_of_lost_text_stays(spark):
    half = [(1, "abcdefghi.\nabcdefghij", "en", "a"), (2, "abcdefghi.\nabcdefghijk", "en", "a")]
    assert [r.doc_id for r in cleaned(docs(spark, half), most_lost=0.5).collect()] == [1]


def test_every_case(spark):
    got = cleaned(docs(spark))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "2", "7", "8", "None"]
    assert same(got, cleaned(docs(spark, clash=True)))
    assert cleaned(docs(spark, [])).count() == 0
    con = duckdb.connect()
    documents = docs(spark).toPandas()  # noqa: F841
    con.register("documents", documents)
    want = sorted(map(repr, con.execute(SQL).fetchall()))
    assert len(want) == 6


def test_many_lines_take_time_in_proportion(spark):
    text = "\n".join(f"Line number {k} is a sentence of its own." for k in range(100_000))
    assert cleaned(docs(spark, [(1, text, "en", "a")])).first().n_kept == 100_000


def test_clean_documents_of_the_corpus_stay(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = cleaned(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id")
    good, bad = labels.where("quality = 1"), labels.where("quality = 0")
    assert good.join(kept, "doc_id").count() >= 0.98 * good.count()
    assert bad.join(kept, "doc_id").count() <= 0.5 * bad.count()
