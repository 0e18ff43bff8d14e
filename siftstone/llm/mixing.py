"""Operator 5: mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. A source's share of the
budget is fitted on those counts: first every length gives about the same
fraction of its documents, with the rounding carried from length to length.
Then some of these documents, ``WINDOWS`` tokens or so, are put back, and a
bounded-knapsack dynamic programme over all that isn't taken finds the sum
nearest to what remains; more are put back as long as a nearer sum may exist.
Last, each length gives that many documents, in the order of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.durable import written
from siftstone.llm.picking import rows_of
from siftstone.llm.tokens import VOCABULARY, tokens

SEED = 41
#: Production: a source weighs its tokens to the power POWER (1: as it comes, 0: all the same), the mixture has SHARE of the corpus's tokens.
POWER, SHARE = 0.7, 0.8
#: Tokens that are put back for the dynamic programme, the next if the one before leaves a gap. A budget up to the last is fitted exactly.
WINDOWS = (1 << 12, 1 << 15, 1 << 18)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Exact tokens of a text; 0 for null."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(tokens(vocabulary).counts(texts))

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "bigint").asNondeterministic()(text.cast("string"))


def bounded_knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is as near to ``budget`` from below as can be.

    Counts are split in powers of two. Reachable sums are the bits of one
    integer, and each is remembered from the first item that reached it.
    """
    if budget <= 0:
        return [0] * len(lengths)
    mask = (1 << (budget + 1)) - 1
    items: list[tuple[int, int, int]] = []
    layers = [1]
    reach = 1
    for k, (length, count) in enumerate(zip(lengths, counts)):
        part, left = 1, min(count, budget // length)
        while left > 0 and not reach >> budget & 1:
            n = min(part, left)
            wider = reach | reach << n * length & mask
            if wider != reach:
                reach = wider
                items.append((k, n, length))
                layers.append(reach)
            left -= n
            part *= 2
        if reach >> budget & 1:
            break
    total = reach.bit_length() - 1
    take = [0] * len(lengths)
    for (k, n, length), before in zip(reversed(items), reversed(layers[:-1])):
        if not before >> total & 1:
            take[k] += n
            total -= n * length
    return take


def _put_back(lengths: np.ndarray, take: np.ndarray, window: int) -> np.ndarray:
    """Counts of ``take`` that add up to ``window`` tokens or more, of several lengths, short ones first; all if there are fewer."""
    back = np.zeros(len(take), np.int64)
    held = 0
    for part in (8, 1):
        for k in np.flatnonzero(take > back).tolist():
            if held >= window:
                return back
            n = min(int(take[k] - back[k]), max(1, window // (part * int(lengths[k]))))
            back[k] += n
            held += n * int(lengths[k])
    return take.copy() if held < window else back


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts to take from ascending ``lengths`` for a sum of at most ``budget``, as near as the two steps get."""
    total = int((lengths * counts).sum())
    budget = max(0, min(budget, total))
    if budget == total:
        return counts.copy()
    order = np.argsort(-lengths, kind="stable")
    bulk = np.zeros(len(lengths), np.int64)
    wanted, taken = 0, 0
    for k in order.tolist():
        length, count = int(lengths[k]), int(counts[k])
        wanted += length * count
        n = (wanted * budget // total - taken) // length
        bulk[k] = max(0, min(count, n))
        taken += length * int(bulk[k])
    most = budget - budget % int(np.gcd.reduce(lengths[counts > 0]))  # no sum is between this and the budget
    best, reached = bulk, taken
    for window in WINDOWS:
        if reached == most:
            break
        take = bulk - _put_back(lengths, bulk, window)
        left = counts - take
        remaining = budget - int((lengths * take).sum())
        some = order[(left[order] > 0) & (lengths[order] <= remaining)]
        more = bounded_knapsack([int(x) for x in lengths[some]], [int(x) for x in left[some]], remaining)
        take[some] += np.array(more, np.int64).reshape(-1)
        if (now := int((lengths * take).sum())) > reached:
            best, reached = take, now
    return best


def budgets(histogram: DataFrame, weights: dict[str | None, float] | None, budget: int | None, power: float = 0.0, share: float | None = None) -> DataFrame:
    """``(source, budget)``: without ``budget`` and ``share`` the largest whole budget that no source falls short of."""
    have = histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("many")).alias("have"))
    spark = histogram.sparkSession
    if weights is None:
        weighed = have.withColumn("weight", F.round(F.pow(F.col("have"), F.lit(float(power)))))  # whole, so that sums don't hang on their order
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [], "source string, weight double")
        weighed = have.alias("h").join(given.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source"))).select("h.source", "have", "weight").where("weight > 0")
    weighed = weighed.crossJoin(F.broadcast(weighed.agg(F.sum("weight").alias("all"), F.min(F.col("have") / F.col("weight")).alias("least"), F.sum("have").alias("tokens"))))
    whole = F.lit(float(budget)) if budget is not None else F.floor(F.lit(float(share)) * F.col("tokens")) if share is not None else None
    own = F.floor(F.col("weight") * F.col("least")) if whole is None else F.floor(whole * F.col("weight") / F.col("all"))
    return weighed.select("source", own.cast("bigint").alias("budget"))


def selection(docs: DataFrame, *, weights: dict[str | None, float] | None = None, budget: int | None = None, power: float = 0.0, share: float | None = None, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents in the mixture.

    ``weights`` gives each source's share of tokens (without it, a source weighs
    its tokens to the power ``power``, by default all the same; sources that
    aren't named, or have no positive weight, are left out); ``budget`` is the
    mixture's tokens, or ``share`` what it has of the tokens of all weighed
    sources; without both it has as many as the weights allow. A source short of its budget gives all it has. Rows of one id
    are one document: their tokens add up and the least source counts. Null and
    empty texts have no tokens and are left out; a null source or id is a value
    like any other. Ties of the seeded hash go to the lower id. An empty table
    gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count(F.col("text"), vocabulary).alias("n"))
    slim = slim.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n").alias("n_tokens")).where("n_tokens > 0")
    slim = written(slim, "lengths")
    histogram = slim.groupBy("source", "n_tokens").agg(F.count("*").alias("many"))
    own = budgets(histogram, weights, budget, power, share)

    def fit(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("n_tokens").to_numpy(), kind="stable")
        lengths, many = group.column("n_tokens").to_numpy()[order], group.column("many").to_numpy()[order]
        take = fitted(lengths, many, group.column("budget")[0].as_py())
        return pa.table({"source": group.column("source").take(pa.array(order)), "n_tokens": pa.array(lengths), "take": pa.array(take)})

    joined = histogram.alias("h").join(own.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source"))).select("h.source", "n_tokens", "many", "budget")
    takes = written(joined.groupBy("source").applyInArrow(fit, "source string, n_tokens bigint, take bigint").where("take > 0"), "takes")
    place = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    ranked = slim.withColumn("place", place)
    both = ranked.alias("d").join(takes.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.n_tokens") == F.col("t.n_tokens")))
    return both.where("place <= take").select("doc_id", "d.source", "d.n_tokens")


def mixed_documents(docs: DataFrame, **parameters: object) -> DataFrame:
    """The rows of ``docs`` whose ids :func:`selection` has, columns unchanged; few texts are moved."""
    return rows_of(docs, written(selection(docs, **parameters).select(F.col("doc_id").alias("id")), "chosen"))

