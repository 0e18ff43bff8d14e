"""Rows of a table by their ids, while nearly all texts stay where they are.

A join against many ids moves every text. Here ids alone are moved: each sets
one of ``MARKS`` bits, among those of the named ids or those of the others. A row
is decided where it is read if its bit is set on one side only; the rest, whose
share is that of the bits which the other side has set, is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.durable import written

#: Bits of either side: 2 MB, whatever the table. With 10 million other ids nearly half of the rows are joined, with 100,000 less than 1 %.
MARKS = 1 << 24


def _place(name: str) -> tuple[Column, Column]:
    """The bucket and, in it, the bit of an id; a null has its own as well."""
    mark = F.pmod(F.xxhash64(name), F.lit(MARKS)) + 1
    return F.bitmap_bucket_number(mark).alias("bucket"), F.bitmap_bit_position(mark).cast("int").alias("bit")


def _bits(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(bucket, named, other)``: bits of the ids of ``docs`` that ``ids`` has and of those that it hasn't."""
    named = ids.select(F.col("id").alias("named_id"), F.lit(True).alias("is_named")).distinct()
    every = docs.select(F.col("doc_id").cast("bigint").alias("id")).distinct()
    told = every.join(named, F.col("id").eqNullSafe(F.col("named_id")), "left").select(*_place("id"), F.coalesce("is_named", F.lit(False)).alias("is_named"))
    side = lambda said: F.bitmap_construct_agg(F.when(F.col("is_named") == said, F.col("bit")))
    return told.repartition("bucket").groupBy("bucket").agg(side(True).alias("named"), side(False).alias("other"))


def _set(side: str) -> Column:
    return F.expr(f"shiftright(cast(conv(hex(substring({side}, bit div 8 + 1, 1)), 16, 10) as int), bit % 8) & 1 = 1")


def _parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row, id)`` of the rows that are picked by their bits alone, and of those that bits don't tell."""
    bits = written(_bits(docs, ids), "bits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    met = rows.select("row", "id", *_place("id")).join(F.broadcast(bits), "bucket")  # 4 MB, at most ``MARKS`` >> 15 rows
    named, other = _set("named"), _set("other")
    return met.where(named & ~other).select("row", "id"), met.where(named & other).select("row", "id")


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` the table ``ids(id)`` has; columns unchanged.

    Exact for any ids. A null id is a value like any other, repeated rows are
    picked each, ids that ``docs`` hasn't do no harm. ``docs`` is read twice and
    ``ids`` should be written, as it is read twice, too.
    """
    sure, unsure = _parted(docs, ids)
    # no semi-join: Spark would push it below the look at the bits, where it meets every text
    found = unsure.join(ids.select(F.col("id").alias("named_id")).distinct(), F.col("id").eqNullSafe(F.col("named_id"))).select("row", "id")
    return sure.unionByName(found).select("row.*")
