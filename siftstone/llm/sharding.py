"""Operator 10: contiguous shards of the least possible size of the largest.

Atomic groups (the rows of one document) stand in one order, with running sums
of their sizes. A capacity is feasible if filling shard after shard, each as far
as it goes, needs no more shards than there are; the least feasible capacity is
found by binary search, and the greedy filling at it gives the cuts.

The running sums stay distributed. The driver knows some of the places between
groups, ``KNOWN`` at most, and for each stretch between two of them whether a
group border may be within. Filling with the known places alone bounds the
least capacity from above, filling that may cut anywhere in such a stretch
bounds it from below. Only stretches where the two can differ are looked at
again, at a finer grain, until both agree on the capacity and on every cut. The
result is that of one greedy pass over all groups, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.durable import discard, written

#: Shards of the production query.
SHARDS = 128
#: Places between groups that the driver knows after each look, about.
KNOWN = 1 << 17


@dataclass
class Places:
    """Known running sums, ascending from 0 to the total, and which stretches before each hold more than one group."""

    at: np.ndarray
    loose: np.ndarray  # loose[k]: a border may be between at[k - 1] and at[k]

    def fill(self, capacity: int, shards: int, anywhere: bool) -> np.ndarray:
        """Ends of the shards filled one after another; with ``anywhere``, cuts may be at any place in loose stretches."""
        ends, x, total = [], 0, int(self.at[-1])
        for _ in range(shards):
            goal = x + capacity
            if goal >= total:
                ends.append(total)
                break
            k = int(np.searchsorted(self.at, goal, "right"))
            x = goal if anywhere and self.loose[k] else int(self.at[k - 1])
            if ends and x <= ends[-1] or not ends and x <= 0:
                break  # a group that is larger than the capacity
            ends.append(x)
        return np.array(ends, np.int64)

    def least(self, shards: int, anywhere: bool, low: int) -> int:
        """The least capacity, ``low`` or more, with which the filling reaches the total."""
        high = int(self.at[-1])
        while low < high:
            mid = (low + high) // 2
            ends = self.fill(mid, shards, anywhere)
            if len(ends) and ends[-1] == self.at[-1]:
                high = mid
            else:
                low = mid + 1
        return low


def _windows(places: Places, low: int, high: int, shards: int) -> np.ndarray:
    """Numbers of the loose stretches in which a cut can be for capacities from ``low`` to ``high``."""
    first, last = places.fill(low, shards, False), places.fill(high, shards, True)
    n = max(len(first), len(last))
    # a filling that stopped short may have any later cut from where it stopped on
    first = np.concatenate([first, np.full(n - len(first), first[-1] if len(first) else 0)])
    last = np.concatenate([last, np.full(n - len(last), places.at[-1])])
    mark = np.zeros(len(places.at) + 1, np.int64)
    begin = np.searchsorted(places.at, first, "left")
    end = np.minimum(np.searchsorted(places.at, last, "left"), len(places.at) - 1)
    open_ = begin < end  # the earliest cut is a known place; what is after it, up to the last, isn't settled
    np.add.at(mark, begin[open_] + 1, 1)
    np.add.at(mark, end[open_] + 1, -1)
    return np.flatnonzero((np.cumsum(mark)[:-1] > 0) & places.loose)


def minimax_cuts(sums: DataFrame, total: int, largest: int, shards: int, known: int = KNOWN) -> tuple[int, np.ndarray]:
    """The least capacity and the greedy ends of the shards at it, over ``sums(upto, n)``: the running sum after each group."""
    places = Places(np.array([0, total], np.int64), np.array([False, True]))
    while True:
        low = places.least(shards, True, max(largest, -(-total // shards)))
        high = places.least(shards, False, low)
        here = _windows(places, low, high, shards)
        if low == high and (not len(here) or np.array_equal(places.fill(low, shards, False), places.fill(low, shards, True))):
            return low, places.fill(low, shards, False)
        begins, ends = places.at[here - 1], places.at[here]
        width = max(1, -(-int((ends - begins).sum()) // known))

        def slot(batches: Iterator[pa.RecordBatch], begins: np.ndarray = begins, ends: np.ndarray = ends, width: int = width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                upto = batch.column(0).to_numpy()
                k = np.maximum(np.searchsorted(begins, upto, "left") - 1, 0)
                inside = (upto > begins[k]) & (upto <= ends[k])
                k, upto = k[inside], upto[inside]
                yield pa.record_batch([pa.array(k), pa.array((upto - begins[k] - 1) // width), pa.array(upto)], ["k", "part", "upto"])

        found = sums.select("upto").mapInArrow(slot, "k bigint, part bigint, upto bigint")
        rows = found.groupBy("k", "part").agg(F.min("upto").alias("first"), F.max("upto").alias("last"), F.count("*").alias("many")).toArrow()
        many = rows.column("many").to_numpy()
        # nothing is between a part's first border and the one before it
        at = np.concatenate([rows.column("first").to_numpy(), rows.column("last").to_numpy()[many > 1]])
        old = np.ones(len(places.at), bool)
        old[here] = False  # they come back as the last of their stretch
        at, loose = np.concatenate([places.at[old], at]), np.concatenate([places.loose[old], np.zeros(len(many), bool), many[many > 1] > 2])
        order = np.argsort(at, kind="stable")
        places = Places(at[order], loose[order])


def groups(docs: DataFrame) -> DataFrame:
    """``(source, doc_id, lone, n_bytes)``: the atomic groups and their UTF-8 bytes, one more for each row."""
    text = F.col("text").cast("string")
    ident = F.col("doc_id").cast("bigint")
    slim = docs.select(F.col("source").cast("string").alias("source"), ident.alias("doc_id"), F.when(ident.isNull(), F.xxhash64(text)).alias("lone"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("n_bytes"))
    return slim.groupBy("source", "doc_id", "lone").agg(F.sum("n_bytes").alias("n_bytes"))


def shards(docs: DataFrame, *, n_shards: int = SHARDS, known: int = KNOWN) -> DataFrame:
    """``(source, doc_id, n_bytes, shard_id)``: a row for every atomic group, in which shard it is.

    Groups are the rows of one document of one source, in the order of source
    and id; a shard has neighbouring groups only, and no way of cutting gives a
    smaller largest shard. A row counts its UTF-8 bytes and one more, so null
    and empty texts have a place as well. Null sources and ids come first; rows
    without an id are groups by their text. Repeated rows of a document are one
    group. A text of any length is one group; if it is larger than a fair
    share, it sets the capacity. Of equal solutions the one that fills the first
    shards is taken. Fewer groups than shards leave the last shards empty. Reads
    ``doc_id``, ``source`` and ``text``; other columns may have any name. An
    empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("there must be a shard")
    slim = written(groups(docs), "groups")
    keys = ["source", "doc_id", "lone"]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            upto = total + np.cumsum(batch.column(3).to_numpy())
            total = int(upto[-1]) if len(upto) else total
            yield pa.record_batch([*batch.columns[:2], batch.column(3), batch.column(4), pa.array(upto, pa.int64())], ["source", "doc_id", "n_bytes", "part", "within"])

    ranged = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "n_bytes", F.spark_partition_id().alias("part"))
    ranged = written(ranged.mapInArrow(running, "source string, doc_id bigint, n_bytes bigint, part int, within bigint"), "ranged")
    discard(slim)
    parts = ranged.groupBy("part").agg(F.max("within").alias("own"), F.max("n_bytes").alias("largest")).toArrow()  # a row for each task of the sort
    order = np.argsort(parts.column("part").to_numpy())
    own = parts.column("own").to_numpy()[order]
    part_of, before = parts.column("part").to_numpy()[order], np.concatenate([[0], np.cumsum(own)]).astype(np.int64)

    def upto(part: pa.Array, within: pa.Array) -> pa.Array:
        return pa.array(before[np.searchsorted(part_of, part.to_numpy())] + within.to_numpy())

    upto.__annotations__ = {"part": pa.Array, "within": pa.Array, "return": pa.Array}
    sums = ranged.select("source", "doc_id", "n_bytes", F.arrow_udf(upto, "bigint")("part", "within").alias("upto"))
    total = int(before[-1])
    ends = minimax_cuts(sums, total, int(parts.column("largest").to_numpy().max()), n_shards, known)[1] if total else np.zeros(0, np.int64)

    def place(upto: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(ends, upto.to_numpy(), "left").astype(np.int32))

    place.__annotations__ = {"upto": pa.Array, "return": pa.Array}
    return sums.select("source", "doc_id", "n_bytes", F.arrow_udf(place, "int")("upto").alias("shard_id"))


#: The same by one greedy pass over a list for each capacity that the binary search tries; rows without an id are in another order.
SQL = f"""
WITH RECURSIVE grouped AS MATERIALIZED (
  SELECT source, doc_id, CASE WHEN doc_id IS NULL THEN hash(text) END AS lone, SUM(COALESCE(strlen(text), 0) + 1)::BIGINT AS n_bytes
  FROM documents GROUP BY ALL),
ordered AS MATERIALIZED (SELECT source, doc_id, n_bytes, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, lone) AS k FROM grouped),
listed AS MATERIALIZED (
  SELECT list({{'n': 0::BIGINT, 'held': n_bytes}} ORDER BY k) AS sizes, SUM(n_bytes)::BIGINT AS total, MAX(n_bytes)::BIGINT AS largest FROM ordered),
search(low, high) AS (
  SELECT GREATEST(largest, (total + {SHARDS - 1}) // {SHARDS})::BIGINT, total FROM listed
  UNION ALL
  SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END
  FROM (SELECT low, high, mid, list_reduce(sizes, lambda a, x: CASE WHEN a.held + x.held <= mid THEN {{'n': a.n, 'held': a.held + x.held}} ELSE {{'n': a.n + 1, 'held': x.held}} END).n < {SHARDS} AS fits
        FROM (SELECT low, high, (low + high) // 2 AS mid FROM search WHERE low < high), listed)),
best AS MATERIALIZED (SELECT MIN(high) AS capacity FROM search),
sums AS MATERIALIZED (SELECT k, SUM(n_bytes) OVER (ORDER BY k)::BIGINT AS upto FROM ordered),
cuts(shard_id, after) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT shard_id + 1, (SELECT MAX(upto) FROM sums WHERE upto <= after + capacity)::BIGINT FROM cuts, best WHERE after < (SELECT MAX(upto) FROM sums))
SELECT source, doc_id, n_bytes, shard_id::INTEGER AS shard_id
FROM (SELECT o.*, s.upto FROM ordered o JOIN sums s USING (k)) ASOF JOIN cuts ON upto > after
"""
