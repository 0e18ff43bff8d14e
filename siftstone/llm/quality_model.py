"""Operator 7: document quality with hierarchical empirical Bayes.

A logistic model of text statistics gives each document its own evidence. The
predicted shares of good documents are then averaged by host and by path within
the host; a path's share is shrunk toward its host's and a host's toward the
global one, the more so the fewer documents it has, with prior strengths
estimated from the spread between groups. A document's posterior is its evidence
on top of its path's shrunk share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.durable import written
from siftstone.llm.textbatch import buffers, chunks, mixed, plain, released, shingles, words

#: Labelled documents that are fitted on, at most.
SAMPLE, SEED = 20_000, 29
#: Least posterior of a document that is kept.
KEEP = 0.5
#: Bounds of the prior strengths, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6
#: No document, host or path counts as surer than this.
SURE = 1e-4

_SYMBOL = np.array([chr(b) in "#$%&*+<=>@[]^_`{}~\\/" for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
STATISTICS = ("log_words", "symbols", "bars", "exclamations", "upper", "digits", "distinct_words", "distinct_shingles", "repeats", "word_length", "lines", "stops")


def _distinct_share(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    count = np.diff(at)
    row = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    key = np.sort(mixed(h) >> np.uint64(24) | row << np.uint64(40))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    found = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(count))
    return found / np.maximum(count, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    texts = plain(texts)
    out = np.zeros((len(texts), len(STATISTICS)))
    for begin, part in chunks(texts):
        raw, at = buffers(part)
        size = np.maximum(np.diff(at), 1)

        def share(mask: np.ndarray, raw: np.ndarray = raw, at: np.ndarray = at) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask[raw])])
            return total[at[1:]] - total[at[:-1]]

        letters = share(_LETTER)
        one = lambda c: np.arange(256) == ord(c)
        h, w = words(part)
        n = np.maximum(np.diff(w), 1)
        s, sw = shingles(part, 3)
        same = np.zeros(len(h) + 1, np.int64)
        if len(h) > 1:
            same[2:] = np.cumsum(h[1:] == h[:-1])
        cols = [
            np.log1p(np.diff(w)), share(_SYMBOL) / size, share(one("|")) / n, share(one("!")) / n, share(_UPPER) / np.maximum(letters, 1), share(_DIGIT) / size,
            _distinct_share(h, w), _distinct_share(s, sw), (same[w[1:]] - same[np.minimum(w[:-1] + 1, w[1:])]) / n, letters / n, share(one("\n")) / n, share(one(".")) / n,
        ]
        out[begin : begin + len(part)] = np.column_stack(cols)
        del cols, h, w, s, sw, same, raw, at, share
    released()
    return out


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float  # share of good documents among the labelled

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([z, z * z, np.ones((len(z), 1))])

    def of(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of statistics."""
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> QualityModel:
    """Logistic regression by Newton steps; with labels of one kind only, that kind's share decides."""
    model = QualityModel(x.mean(0), x.std(0) + 1e-9, np.zeros(2 * x.shape[1] + 1), float(np.clip(y.mean(), 0.01, 0.99)))
    z = model.design(x)
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ model.weights)
        model.weights = model.weights + step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return model


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, seed: int = SEED) -> QualityModel | None:
    """A model of at most ``sample`` labelled documents of ``docs``, those of the least seeded hashes; one text of each id.

    Only their statistics come to the driver. None if no document is labelled.
    """
    there = docs.select(F.col("doc_id").cast("bigint").alias("id")).where("id is not null")
    said = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.min("quality").alias("quality"))
    said = said.join(there, "id", "left_semi")
    ids = {r.id: r.quality for r in said.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).collect()}
    known = F.broadcast(docs.sparkSession.createDataFrame([(k, int(v)) for k, v in ids.items()], "id bigint, good int"))  # ``sample`` rows at most
    picked = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).join(known, "id")

    def measure(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))

    measure.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    rows = picked.select("id", "good", F.arrow_udf(measure, "array<double>")("text").alias("x")).groupBy("id", "good").agg(F.min("x").alias("x")).collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r.id, r.x))
    return fit(np.array([r.x for r in rows]), np.array([float(r.good) for r in rows]))


def evidence(model: QualityModel, text: Column) -> Column:
    """The text's own probability of being good; that of a text without a word is the least."""

    def judge(texts: pa.Array) -> pa.Array:
        texts = plain(texts)
        x = statistics(texts)
        p = np.clip(model.of(x), SURE, 1 - SURE)
        return pa.array(np.where(x[:, 0] == 0, SURE, p))

    judge.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, "double").asNondeterministic()(text.cast("string"))


def _strength(within: Column, spread: Column, groups: Column, size: Column) -> Column:
    """Prior strength in documents by moments: the variance within groups over that between them.

    ``spread`` is the sum of squares of group means about what is above them,
    ``groups`` its degrees of freedom, ``size`` the documents it is worth.
    """
    between = F.try_divide(spread - groups * within, size)
    k = F.least(F.greatest(F.try_divide(within, F.greatest(between, F.lit(1e-12))), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))
    return F.when(between.isNull() | (between <= 0) | (groups < 1), F.lit(MOST_STRENGTH)).otherwise(k)


def posteriors(scored: DataFrame) -> DataFrame:
    """``(host, path, n, s, hn, hs, m, kh, kp)`` of ``scored(host, path, p)``, hosts and paths null-safe: what a document's shares are made of.

    Counts and sums by path and host, the global mean, and the two prior
    strengths, from sums and sums of squares: a probability varies less within
    a group than a yes or no would, so the variance is that of the figures.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    all_ = hosts.agg(F.sum("hn").alias("an"), F.try_divide(F.sum("hs"), F.sum("hn")).alias("m"))
    over = hosts.crossJoin(F.broadcast(all_))  # one row
    mean, n, h = F.col("hs") / F.col("hn"), F.col("n"), F.col("hn")
    host_within = F.coalesce(F.try_divide(F.sum(F.col("hq") - F.col("hs") * mean), F.sum(h) - F.count("*")), F.lit(0.0))
    kh = over.agg(_strength(F.greatest(host_within, F.lit(0.0)), F.sum(h * (mean - F.col("m")) ** 2), F.count("*") - 1, F.sum(h) - F.try_divide(F.sum(h * h), F.sum(h))).alias("kh"))
    both = paths.alias("p").join(over.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "n", "s", "q", "hn", "hs", "m", F.col("n").alias("_n"))
    own = F.col("s") / n
    path_within = F.coalesce(F.try_divide(F.sum(F.col("q") - F.col("s") * own), F.sum(n) - F.count("*")), F.lit(0.0))
    degrees = F.count("*") - F.sum(n / h)  # paths less hosts
    kp = both.agg(_strength(F.greatest(path_within, F.lit(0.0)), F.sum(n * (own - mean) ** 2), F.round(degrees, 6), F.sum(n) - F.sum(n * n / h)).alias("kp"))
    return both.crossJoin(F.broadcast(kh)).crossJoin(F.broadcast(kp)).select("host", "path", "n", "s", "hn", "hs", "m", "kh", "kp")


def _shares() -> tuple[Column, Column]:
    """The host's and the path's shrunk share for a document of evidence ``p``, which is left out of both."""
    host = (F.col("hs") - F.col("p") + F.col("kh") * F.col("m")) / (F.col("hn") - 1 + F.col("kh"))
    return host, (F.col("s") - F.col("p") + F.col("kp") * host) / (F.col("n") - 1 + F.col("kp"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(SURE)), F.lit(1 - SURE))
    return F.log(q / (1 - q))


def _posterior(p: Column, share: Column, base: float) -> Column:
    return 1 / (1 + F.exp(-(_logit(p) - _logit(F.lit(base)) + _logit(share))))


def _site(host: str, path: str, url: str | None) -> tuple[Column, Column]:
    """Columns of host and path; of a ``url`` its host and its path's first step."""
    if url is None:
        return F.col(host).cast("string"), F.col(path).cast("string")
    u = F.col(url).cast("string")
    return F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def _met(scored: DataFrame, sites: DataFrame) -> DataFrame:
    return scored.alias("d").join(sites.alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))


def scores(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", url: str | None = None, keep: float = KEEP, **parameters: int) -> DataFrame:
    """``(doc_id, evidence, host_share, path_share, posterior, kept)``, a row for every row of ``docs``.

    ``host`` and ``path`` name the site columns (for documents: the source, and
    the language section within it), or ``url`` the column that both are in; a
    null is a site of its own. Shares are of the site's other documents: a
    document's own evidence counts once. A null or empty text, or one without a
    word, has the least evidence. Statistics are of whole texts; repeated rows
    count as often as they occur and give equal rows; a posterior that ties with
    ``keep`` is kept. Other columns may have any name. With no labels every
    document is kept with null figures; no documents, no rows.
    """
    model = train(docs, labels, **parameters)
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(ids, none.alias("evidence"), none.alias("host_share"), none.alias("path_share"), none.alias("posterior"), F.lit(True).alias("kept"))
    h, p = _site(host, path, url)
    scored = written(docs.select(ids, h.alias("host"), p.alias("path"), evidence(model, F.col("text")).alias("p")), "scored")
    host_share, path_share = _shares()
    out = _met(scored, posteriors(scored)).select("doc_id", F.col("p").alias("evidence"), host_share.alias("host_share"), path_share.alias("path_share"))
    return out.withColumn("posterior", _posterior(F.col("evidence"), F.col("path_share"), model.base)).withColumn("kept", F.col("posterior") >= keep)


def kept(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", url: str | None = None, keep: float = KEEP, **parameters: int) -> DataFrame:
    """The rows of ``docs`` that :func:`scores` keeps, columns unchanged.

    Evidence is computed once for the sites' shares and once more to filter, as
    that costs less than moving every text; the sites' table meets the documents
    in a join whose kind Spark picks by its size.
    """
    model = train(docs, labels, **parameters)
    if model is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    h, p = _site(host, path, url)
    site = docs.select(row, h.alias("host"), p.alias("path"), evidence(model, F.col("text")).alias("p"))
    sites = written(posteriors(site.select("host", "path", "p")), "sites")
    return _met(site, sites).where(_posterior(F.col("p"), _shares()[1], model.base) >= keep).select("row.*")
