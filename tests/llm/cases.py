"""Rows that every operator must bear, and how to compare."""

LONG = "A sentence of some words that goes on and on for a while. " * 40_000
ROWS = [
    (1, "A plain text of several words, well written. It has two sentences.", "en", "a"),
    (1, "A plain text of several words, well written. It has two sentences.", "en", "a"),
    (2, "A plain text of several words, well written. It has two sentences.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", "en", None),
    (5, " \n\t ", None, "a"),
    (6, "...", "en", "b"),
    (None, "A text without an id but with words.", "en", "a"),
    (None, None, None, None),
    (7, LONG, "en", "a"),
    (8, "Ein Text mit Wörtern, die es gibt. 😀 Noch ein Satz.", "de", "b"),
]
CLASHING = ["h", "n", "row", "lines", "kept", "part", "upto", "piece", "sig", "rep", "v", "label", "host", "path", "p", "n_tokens", "take", "bin_id", "word", "id", "good", "url_", "source_", "a", "b"]


def docs(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


def same(a, b):
    """Equal as bags of rows."""
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
