"""Operator 6: token ids in ORC, for readers that take stripes side by side.

A row is a document with its token ids; ORC's version 2 integer run-length
encoding holds them. Rows are in id order within a file, so that each stripe and
each row group covers a narrow range of ids in the file's metadata, and stripes
have Bloom filters on ``doc_id``: a lookup of some ids reads the footers, then
only row groups that may hold them. Splits follow stripes, so that one file is
read by as many tasks as it has.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.durable import fresh_path
from siftstone.llm.textbatch import chunks, plain
from siftstone.llm.tokens import VOCABULARY, tokens

SCHEMA = "doc_id bigint, n_tokens bigint, token_ids array<int>"
#: Bytes of a stripe, rows of a row group in the index, and the share of ids that a Bloom filter lets pass in vain.
STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES = 16 << 20, 1000, 0.01
#: Bytes of text that are encoded into one Arrow batch.
BATCH_BYTES = 4 << 20


def token_rows(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, token_ids)`` of every row of ``docs``, texts whole."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in chunks(plain(batch.column(1)), BATCH_BYTES):
                ids = tokens(vocabulary).ids(part)
                yield pa.record_batch([batch.column(0).slice(begin, len(part)), pa.compute.list_value_length(ids).cast(pa.int64()), ids], ["doc_id", "n_tokens", "token_ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, SCHEMA)


def write(docs: DataFrame, path: str, *, vocabulary: str = VOCABULARY, stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS, mode: str = "errorifexists") -> None:
    """Writes the token table of ``docs`` to ``path``.

    Ids are sorted before texts become tokens, within the tasks that read them,
    so nothing is shuffled. A row for every row of ``docs``: null and empty
    texts have no tokens and an empty list, rows without an id come first,
    repeated rows are repeated. A text of any length is one row. Reads
    ``doc_id`` and ``text``; other columns may have any name. An empty table
    gives files without rows, or none.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).sortWithinPartitions("doc_id")
    options = {
        "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.create.index": "true", "orc.write.format": "0.12",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES, "compression": "zstd",
    }
    token_rows(slim, vocabulary).write.options(**{k: str(v) for k, v in options.items()}).mode(mode).orc(path)


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The token table at ``path``, or the rows of ``ids``: these are pushed down to the footers, row indexes and Bloom filters."""
    out = spark.read.schema(SCHEMA).orc(path)
    return out if ids is None else out.where(F.col("doc_id").isin([int(k) for k in ids]))


def stripes(path: str) -> list[tuple[str, int, int]]:
    """``(file, stripe, rows)`` of a local table, for readers outside Spark that take a stripe each."""
    from pyarrow import orc

    files = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".orc")]
    return [(f, k, o.read_stripe(k, columns=["doc_id"]).num_rows) for f in files for o in [orc.ORCFile(f)] for k in range(o.nstripes)]


def round_trip(docs: DataFrame, **parameters: object) -> DataFrame:
    """The token table of ``docs`` as written to the shared folder and read again."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, path, **parameters)
    return read(docs.sparkSession, path)
