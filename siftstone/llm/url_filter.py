"""Operator 3: URLs by the ratio of two character language models.

Accepted and rejected URLs each give a smoothed variable-order Markov model over
their UTF-8 bytes: a suffix tree of contexts of up to ``ORDER`` bytes that holds
every context with at least ``LEAST_SHARE`` of the class's symbols (Ron, Singer
and Tishby, 1996). The probability of a byte starts from the uniform one and is
interpolated along the context's suffixes, from the shortest to the longest that
is held, by Witten and Bell's weights. A URL's score is the difference of its
two log-likelihoods over its length, turned into a probability of being accepted
by a logistic curve fitted on URLs that the counts leave out.

Counts are made over all labelled URLs but the held-out ones; since contexts
are held by their share, a tree has at most (ORDER + 1) / LEAST_SHARE contexts
however many URLs there are. The curve is fitted on a histogram of all held-out
scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.durable import discard, written
from siftstone.llm.textbatch import buffers, chunks, plain

#: Bytes of the longest context, and the least share of a class's symbols of a context that is held.
ORDER, LEAST_SHARE = 5, 2e-5
#: One of so many labelled URLs is held out for calibration.
HELD_OUT, SEED = 10, 53
#: Least calibrated probability of a URL that is accepted.
KEEP = 0.5
#: Width of the calibration histogram's bins, in nats a symbol.
BIN = 1e-3

_BEGIN, _END = 2, 3
_LOW = (np.uint64(1) << np.uint64(48)) - np.uint64(1)


def symbols(urls: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol (bytes of all URLs, each with an end) its last ``order + 1`` bytes as one number, and len + 1 offsets.

    Before a URL there are ``order`` begin marks, so every symbol has a context of every length.
    """
    raw, at = buffers(urls)
    n = np.diff(at)
    begins = at[:-1] + np.arange(len(n)) * (order + 1)
    data = np.full(len(raw) + len(n) * (order + 1), _BEGIN, np.uint8)
    inside = np.arange(len(raw)) + np.repeat(begins + order - at[:-1], n)
    data[inside] = raw
    data[begins + order + n] = _END
    code = np.zeros(len(data), np.uint64)
    for back in range(order, -1, -1):
        code[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    wanted = np.ones(len(data), bool)
    wanted[(begins[:, None] + np.arange(order)).ravel()] = False
    return code[wanted], np.concatenate([[0], np.cumsum(n + 1)])


def _grams(code: np.ndarray, k: int) -> np.ndarray:
    """Context of ``k`` bytes and symbol, with the order on top, so that codes of all orders differ."""
    return (code & ((np.uint64(1) << np.uint64(8 * (k + 1))) - np.uint64(1))) | np.uint64(k) << np.uint64(48)


@dataclass
class Tree:
    """Held contexts with their symbols: ``grams`` and ``counts``, and by context ``totals`` and how many ``kinds`` follow."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def of(grams: np.ndarray, counts: np.ndarray) -> Tree:
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.uint64), counts[order].astype(np.float64)
        contexts, place = np.unique(grams >> np.uint64(8) & (_LOW >> np.uint64(8)) | (grams >> np.uint64(48)) << np.uint64(48), return_inverse=True)
        return Tree(grams, counts, contexts, np.bincount(place, counts), np.bincount(place).astype(np.float64))

    def logs(self, code: np.ndarray, order: int) -> np.ndarray:
        """Log-probability of each symbol after its context."""
        p = np.full(len(code), 1 / 256)
        for k in range(order + 1):
            g = _grams(code, k)
            c = (g & _LOW) >> np.uint64(8) | np.uint64(k) << np.uint64(48)
            at = np.minimum(np.searchsorted(self.contexts, c), len(self.contexts) - 1)
            held = np.flatnonzero(self.contexts[at] == c)
            if not len(held):
                break  # suffixes of held contexts are held
            at, g = at[held], g[held]
            place = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
            n = np.where(self.grams[place] == g, self.counts[place], 0.0)
            p[held] = (n + self.kinds[at] * p[held]) / (self.totals[at] + self.kinds[at])
        return np.log(p)


@dataclass
class UrlModel:
    accepted: Tree
    rejected: Tree
    order: int = ORDER
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, urls: pa.Array) -> np.ndarray:
        """Difference of log-likelihoods over the number of symbols; NaN for an empty URL."""
        out = np.full(len(urls), np.nan)
        for begin, part in chunks(urls, 1 << 20):
            code, at = symbols(part, self.order)
            total = np.concatenate([[0.0], np.cumsum(self.accepted.logs(code, self.order) - self.rejected.logs(code, self.order))])
            n = np.diff(at)
            out[begin : begin + len(part)] = np.where(n > 1, (total[at[1:]] - total[at[:-1]]) / n, np.nan)
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


def calibrated(score: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope, 0 or more, and offset of the logistic curve of weighted scores (Platt's targets, a little ridge on the slope)."""
    up, down = float(weight[good].sum()), float(weight[~good].sum())
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.column_stack([score, np.ones(len(score))])
    ridge = np.array([1e-3, 1e-6])

    def loss(w: np.ndarray) -> float:
        x = z @ w
        return float((weight * (np.logaddexp(0, x) - target * x)).sum() + (ridge * w * w).sum() / 2)

    w = np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (target - p)) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((up + 1) / (down + 1))))


def _scored(model: UrlModel, url: Column) -> Column:
    def judge(urls: pa.Array) -> pa.Array:
        s = model.scores(plain(urls))
        return pa.array(s, from_pandas=True)

    judge.__annotations__ = {"urls": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, "double").asNondeterministic()(url)


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``(good, gram, n)`` over all rows of ``labelled(url, good)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for side in (False, True):
                own = plain(batch.column(0).filter(pa.array(good == side)))
                for _, part in chunks(own, 1 << 20):
                    code, _ = symbols(part, order)
                    for k in range(order + 1):
                        gram, n = np.unique(_grams(code, k), return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(gram), side)), pa.array(gram.view(np.int64)), pa.array(n)], ["good", "gram", "n"])

    return labelled.select("url", "good").mapInArrow(count, "good boolean, gram bigint, n bigint").groupBy("good", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, *, order: int = ORDER, least_share: float = LEAST_SHARE, held_out: int = HELD_OUT, seed: int = SEED) -> UrlModel | None:
    """The model of ``labelled(url, good)``; None unless both kinds have a URL. Null labels and null or empty URLs are left out."""
    rows = labelled.where("url is not null and url <> '' and good is not null")
    rows = written(rows.select("url", F.col("good").cast("boolean").alias("good"), (F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(held_out)) == 0).alias("held")), "urls")
    kinds = {(r.good, r.held): r["count"] for r in rows.groupBy("good", "held").count().collect()}
    if not all(any(good == side for good, _ in kinds) for side in (False, True)):
        return None
    # the few URLs of small tables count for both when one side would be left without any
    apart = all((good, held) in kinds for good in (False, True) for held in (False, True))
    counts = written(gram_counts(rows.where("not held") if apart else rows, order), "grams")
    all_ = counts.where(F.shiftright("gram", 48) == 0).groupBy("good").agg(F.sum("n").alias("symbols"))
    context = F.shiftright(F.col("gram").bitwiseAND((1 << 48) - 1), 8).bitwiseOR(F.shiftleft(F.shiftright("gram", 48), 48))
    named = counts.withColumn("context", context)
    held = named.groupBy("good", "context").agg(F.sum("n").alias("all")).join(F.broadcast(all_), "good").where(F.col("all") >= F.lit(least_share) * F.col("symbols")).select("good", "context")
    got = named.join(held, ["good", "context"]).select("good", "gram", "n").toArrow()  # bounded by the least share
    good = got.column("good").to_numpy(zero_copy_only=False).astype(bool)
    gram, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
    model = UrlModel(Tree.of(gram[good], n[good]), Tree.of(gram[~good], n[~good]), order)
    test = rows.where("held") if apart else rows
    bins = test.select("good", F.round(_scored(model, F.col("url")) / BIN).cast("bigint").alias("bin")).groupBy("good", "bin").count().toArrow()
    model.slope, model.offset = calibrated(bins.column("bin").to_numpy() * BIN, bins.column("good").to_numpy(zero_copy_only=False).astype(bool), bins.column("count").to_numpy().astype(np.float64))
    discard(rows, counts)
    return model


def weak_labels(pages: DataFrame, *, least_words: int = 100, most_links: float = 0.2) -> DataFrame:
    """``(url, good)`` of every page: good has ``least_words`` words of text, at most ``most_links`` of them in links. Null for null html."""
    words = lambda c: F.size(F.filter(F.split(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+"), lambda w: w != ""))
    body = F.regexp_replace(F.col("html").cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    seen = pages.select(F.col("url").cast("string").alias("url"), body.alias("body"))
    counted = seen.select("url", words(F.col("body")).alias("n"), words(F.array_join(F.regexp_extract_all("body", F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), " ")).alias("linked"))
    return counted.select("url", ((F.col("n") >= least_words) & (F.col("linked") <= F.col("n") * most_links)).alias("good"))


def scored_urls(pages: DataFrame, labelled: DataFrame, *, keep: float = KEEP, **parameters: object) -> DataFrame:
    """``(page_id, url, score, probability, accepted)``, a row for every row of ``pages``.

    ``score`` is the length-normalised difference of the log-likelihoods under
    the models of accepted and of rejected URLs in ``labelled(url, good)``,
    ``probability`` its calibrated value, and accepted are those of ``keep`` or
    more (ties are accepted). Null and empty URLs have neither and aren't
    accepted. URLs of any length are read whole; repeated rows count as often as
    they occur and give equal rows. Unless both kinds are labelled, figures are
    null and every URL is accepted. Other columns may have any name; an empty
    table gives no rows.
    """
    model = train(labelled, **parameters)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("page_id", "url", none.alias("score"), none.alias("probability"), F.coalesce(F.col("url") != "", F.lit(False)).alias("accepted"))
    out = rows.withColumn("score", _scored(model, F.col("url")))
    p = 1 / (1 + F.exp(-(F.col("score") * model.slope + model.offset)))
    return out.withColumn("probability", p).withColumn("accepted", F.coalesce(F.col("probability") >= keep, F.lit(False)))
