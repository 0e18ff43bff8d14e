"""Operator 2: language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: how many
character 1-, 2- and 3-grams both have, over the root of how many each has.
Grams are those of the code points themselves, letters and marks of any script;
whatever else is between them counts as one word edge. The features are all
grams of the landmarks, so the kernel with a landmark is exact. A Nyström map
on a few landmark texts makes it a finite feature space, in which one-versus-rest
kernel ridge regression is an ordinary ridge. A text's kernel values count which
landmarks have its grams; scores are a product of these with the weights.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.textbatch import chunks, plain, released

#: Labelled texts that are fitted on, at most; the bound of the training sample.
SAMPLE = 2000
#: Of these, texts of one language, at most.
PER_LANGUAGE = 500
LANDMARKS, RIDGE, SEED = 128, 1e-2, 17
#: How much better than the declared language another must score before a text is rejected.
MARGIN = 0.5
#: Least kernel value with the nearest landmark; below it a text is in none of the languages.
LEAST_KERNEL = 0.05

_EDGE = 1
#: Grams whose landmarks are counted at a time.
_BLOCK = 4096


def _classes() -> np.ndarray:
    """A code below 2**21 for every code point: its own for letters and marks, else that of a word edge."""
    out = np.arange(2, 0x110002, dtype=np.int64)
    out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] not in "LM"]] = _EDGE
    return out


_lookup: list[np.ndarray] = []


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, bool]]:
    """For each text the distinct codes of its 1- to 3-grams, ascending, and whether it has a letter.

    Three code points fill 63 bits and no code is 0, so different grams have different codes.
    """
    if not _lookup:
        _lookup.append(_classes())
    for text in pc.utf8_lower(texts).to_numpy(zero_copy_only=False):
        c = _lookup[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        pair = c[:-1] << 21 | c[1:]
        codes = np.sort(np.concatenate([c, pair, pair[:-1] << 21 | c[2:]]))
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        yield codes[new], bool((c != _EDGE).any())


@dataclass
class LanguageModel:
    languages: list[str]
    features: np.ndarray  # codes of the landmarks' grams, ascending
    landmarks: np.ndarray  # for each feature, which landmarks have it, a bit each
    norms: np.ndarray  # of each landmark, one over the root of its grams
    weights: np.ndarray  # landmarks + 1 x languages

    def kernel(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values by text and landmark, and which texts have a letter."""
        k, letters = np.zeros((len(texts), len(self.norms)), np.float32), np.zeros(len(texts), bool)
        for row, (codes, some) in enumerate(grams(texts)):
            letters[row] = some
            f = np.searchsorted(self.features, codes)
            f[f == len(self.features)] = 0
            f = f[self.features[f] == codes]
            for begin in range(0, len(f), _BLOCK):
                held = np.unpackbits(self.landmarks[f[begin : begin + _BLOCK]], axis=1, count=len(self.norms)).astype(np.float32)
                k[row] += np.ones(len(held), np.float32) @ held
            k[row] /= np.sqrt(max(len(codes), 1))
        return k * self.norms, letters

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores by text and language, and whether the text is near any landmark."""
        out, known = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for begin, part in chunks(texts):
            k, letters = self.kernel(part)
            span = slice(begin, begin + len(part))
            out[span] = k @ self.weights[:-1] + self.weights[-1]
            known[span] = letters & (k.max(1) >= LEAST_KERNEL)
        return out, known


def fit(texts: list[str], labels: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Landmarks are the first texts of each language in turn; features are all their n-grams."""
    languages = sorted(set(labels))
    by = [[k for k, x in enumerate(labels) if x == lang] for lang in languages]
    turns = [g[r] for r in range(max(map(len, by))) for g in by if r < len(g)][:landmarks]
    marks = [codes for codes, _ in grams(pa.array([texts[k] for k in turns], pa.string()))]
    features = np.unique(np.concatenate(marks))
    mark = np.zeros((len(features), len(turns)), bool)
    for n, codes in enumerate(marks):
        mark[np.searchsorted(features, codes), n] = True
    norms = np.array([1 / np.sqrt(len(codes)) for codes in marks], np.float32)
    model = LanguageModel(languages, features, np.packbits(mark, axis=1), norms, np.zeros((2, len(languages))))
    k = model.kernel(pa.array(texts, pa.string()))[0].astype(np.float64)
    value, vector = np.linalg.eigh((k[turns] + k[turns].T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # every language weighs the same, however many texts it has
    weight = np.array([1 / len(by[languages.index(x)]) for x in labels])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(z.T @ (z * weight[:, None]) + penalty, z.T @ (y * weight[:, None]))
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def train(docs: DataFrame, *, sample: int = SAMPLE, per_language: int = PER_LANGUAGE, seed: int = SEED, text: str = "text", label: str = "lang") -> LanguageModel | None:
    """A model of at most ``sample`` labelled texts and ``per_language`` of each language; None if there are none.

    Of each language those of the least seeded hashes, the languages in turn, so
    that a rare one has its texts in the sample.
    """
    rows = docs.where("doc_id is not null").where(F.col(label).isNotNull() & (F.length(F.trim(F.col(text))) > 0))
    rows = rows.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).alias("label"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))).where(F.col("turn") <= per_language)
    ids = sorted({r.id for r in rows.orderBy("turn", "h", "id").limit(sample).collect()})
    picked = docs.where(F.col("doc_id").isin(ids)).select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    # one text of each id and language, so that repeated rows don't add to what is collected
    picked = picked.where("text is not null and label is not null and length(trim(text)) > 0").groupBy("h", "label").agg(F.min("text").alias("text"))
    got = sorted((r.h, r.label, r.text) for r in picked.collect())
    return fit([r[2] for r in got], [r[1] for r in got]) if got else None


def verdict(model: LanguageModel, text: Column, declared: Column, margin: float = MARGIN) -> Column:
    """A struct of ``predicted``, ``score``, ``runner_up`` (scores) and ``accepted``."""

    def judge(texts: pa.Array, said: pa.Array) -> pa.Array:
        s, known = model.scores(plain(texts))
        released()
        best = s.argmax(1) if len(s) else np.zeros(0, int)
        at = np.arange(len(s))
        top = s[at, best] if len(s) else np.zeros(0)
        ranked = np.sort(s, axis=1)
        second = ranked[:, -2] if s.shape[1] > 1 else np.full(len(s), -np.inf)
        place = {x: k for k, x in enumerate(model.languages)}
        own = np.array([place.get(x, -1) for x in said.to_pylist()], int)
        against = np.where(own >= 0, top - s[at, np.maximum(own, 0)], 0.0)
        accepted = known & (against <= margin)
        names = pa.array(model.languages).take(pa.array(best))
        names = pc.if_else(pa.array(known), names, pa.scalar(None, pa.string()))
        return pa.StructArray.from_arrays([names, pa.array(top, pa.float64()), pa.array(second, pa.float64()), pa.array(accepted)], ["predicted", "score", "runner_up", "accepted"])

    judge.__annotations__ = {"texts": pa.Array, "said": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, "predicted string, score double, runner_up double, accepted boolean").asNondeterministic()(text.cast("string"), declared.cast("string"))


def identified(docs: DataFrame, **parameters: int) -> DataFrame:
    """``(doc_id, predicted, score, runner_up, accepted)``, a row for every row of ``docs``.

    Accepted is a text that is in one of the languages and whose declared
    language (``lang``) none other beats by more than ``MARGIN``; a null or
    unknown declaration contradicts nothing. Null and empty texts, and those
    without a letter, have no language and aren't accepted. Whole texts are
    read. Repeated rows give equal rows; ties go to the first language by name.
    Texts of any length are read whole, at about 55 bytes of memory a character.
    Other columns may have any name; an empty table gives no rows. With no
    labelled text at all, every ``predicted`` is null.
    """
    model = train(docs, **parameters)
    if model is None:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("runner_up"), F.lit(False).alias("accepted"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), verdict(model, F.col("text"), F.col("lang")).alias("v")).select("doc_id", "v.predicted", "v.score", "v.runner_up", "v.accepted")


def accepted(docs: DataFrame, **parameters: int) -> DataFrame:
    """The rows of ``docs`` that :func:`identified` accepts, columns unchanged. One pass, no shuffle."""
    model = train(docs, **parameters)
    if model is None:
        return docs.limit(0)
    columns = docs.columns
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), verdict(model, F.col("text"), F.col("lang")).alias("v"))
    return judged.where("v.accepted").select("row.*")
