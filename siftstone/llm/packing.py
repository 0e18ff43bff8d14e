"""Operator 8: best-fit-decreasing packing of documents into bins of tokens.

A document longer than a bin is cut in pieces; all but its last fill a bin. The
pieces are counted by length, and best fit decreasing runs over those counts: a
segment tree over remaining capacities finds the tightest open bin for a length
in logarithmic time, and bins with the same history are held as one range. So
the packing is that of all documents at once, while the driver only sees as many
numbers as a bin has tokens. Each piece then finds its bin from its place among
the pieces of its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.durable import written
from siftstone.llm.mixing import token_count
from siftstone.llm.tokens import VOCABULARY

CAPACITY = 2048
#: Pieces of a length are ranked in so many parts side by side.
PARTS = 512


class CapacityTree:
    """Which remaining capacities have open bins: least one of at least a given size, in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, remaining: int, open_: bool) -> None:
        k = remaining + self.size
        self.any[k] = open_
        while k > 1:
            k //= 2
            now = self.any[2 * k] or self.any[2 * k + 1]
            if self.any[k] == now:
                break
            self.any[k] = now

    def tightest(self, need: int) -> int | None:
        k = need + self.size
        if self.any[k]:
            return need
        while k > 1:
            if not k & 1 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def packed(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first, last, bin, per_bin)``: the pieces of a length from place ``first`` to before ``last`` go to ``bin`` and those after it, ``per_bin`` in each."""
    tree = CapacityTree(capacity)
    held: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first bin, bins) by remaining capacity
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def keep(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            if not held[remaining]:
                tree.put(remaining, True)
            held[remaining].append((first, n))

    for length in sorted(histogram, reverse=True):
        place, count = 0, histogram[length]
        while place < count:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                n = -(-(count - place) // per)
                room, first = capacity, bins
                bins += n
            else:
                first, n = held[room].pop()
                if not held[room]:
                    tree.put(room, False)
                per = room // length
            full = min(n, (count - place) // per)
            if full:
                out.append((length, place, place + full * per, first, per))
                keep(room - per * length, first, full)
                place += full * per
            rest = min(per, count - place) if full < n else 0
            if rest:
                out.append((length, place, place + rest, first + full, rest))
                keep(room - rest * length, first + full, 1)
                place += rest
                full += 1
            keep(room, first + full, n - full)
    return out


def bins(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, piece, begin, n_tokens, bin_id)``: which tokens of which document are in which bin.

    A document of n tokens has ceil(n / capacity) pieces: ``begin`` is the first
    token of a piece, counted from 0. No bin holds more than ``capacity``
    tokens and no token is lost. Null and empty texts have no tokens and no
    pieces. Rows with the same id are packed each; rows that are equal in id and
    length are interchangeable. Pieces of a length are placed in the order of
    their hash part, id and number. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), token_count(F.col("text"), vocabulary).alias("n")).where("n > 0")
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)).alias("piece"))
    begin = F.col("piece").cast("bigint") * capacity
    pieces = cut.select("doc_id", "piece", begin.alias("begin"), F.least(F.col("n") - begin, F.lit(capacity)).alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).alias("part"))
    pieces = written(pieces, "pieces")
    parts = pieces.groupBy("n_tokens", "part").agg(F.count("*").alias("many"))
    parts = written(parts.withColumn("before", F.sum("many").over(Window.partitionBy("n_tokens").orderBy("part")) - F.col("many")), "parts")
    histogram = {r.n_tokens: r.many for r in parts.groupBy("n_tokens").agg(F.sum("many").alias("many")).collect()}  # at most ``capacity`` rows
    rows = packed(histogram, capacity)
    columns = np.array(rows, np.int64).reshape(-1, 5)
    names = ["n_tokens", "first", "last", "bin", "per_bin"]
    plan = spark.createDataFrame(pa.table({k: pa.array(columns[:, i]) for i, k in enumerate(names)}).to_pandas(), "n_tokens bigint, first bigint, last bigint, bin bigint, per_bin bigint")
    within = F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("doc_id", "piece")) - 1
    placed = pieces.withColumn("within", within).join(parts.select("n_tokens", "part", "before"), ["n_tokens", "part"])
    placed = placed.withColumn("place", F.col("before") + F.col("within"))
    found = placed.alias("p").join(plan.alias("q"), (F.col("p.n_tokens") == F.col("q.n_tokens")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")))
    where = F.col("bin") + F.floor((F.col("place") - F.col("first")) / F.col("per_bin"))
    return found.select("doc_id", "piece", "begin", F.col("p.n_tokens").alias("n_tokens"), where.cast("bigint").alias("bin_id"))
