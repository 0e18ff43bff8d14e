from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.llm.url_filter import _BEGIN, _END, ORDER, Tree, UrlModel, calibrated, gram_counts, scored_urls, train, weak_labels


def brute_logs(urls, url, order, least=0.0):
    """Witten-Bell by dictionaries, a symbol at a time."""
    n, symbols = defaultdict(Counter), 0
    for u in urls:
        s = bytes([_BEGIN] * order) + u.encode() + bytes([_END])
        for k in range(order, len(s)):
            symbols += 1
            for m in range(order + 1):
                n[s[k - m : k]][s[k]] += 1
    held = {c for c, x in n.items() if sum(x.values()) >= least * symbols}
    s = bytes([_BEGIN] * order) + url.encode() + bytes([_END])
    total = 0.0
    for k in range(order, len(s)):
        p = 1 / 256
        for m in range(order + 1):
            c = s[k - m : k]
            if c in held:
                p = (n[c][s[k]] + len(n[c]) * p) / (sum(n[c].values()) + len(n[c]))
        total += log(p)
    return total / (len(s) - order)


GOOD = [f"https://www.paper{k % 7}.example/articles/2020/{k}/story-of-the-day" for k in range(300)]
BAD = [f"http://cheap{k % 5}.example/buy?id={k}&aff={k * 7}&win=1" for k in range(200)]


def labelled(spark):
    return spark.createDataFrame([(u, True) for u in GOOD] + [(u, False) for u in BAD] + [(None, True), ("", False), ("http://x.example", None)], "url string, good boolean")


def test_probabilities_equal_brute_force(spark):
    counts = gram_counts(spark.createDataFrame([(u, True) for u in GOOD[:40]] + [(u, False) for u in BAD[:30]], "url string, good boolean"), ORDER).toPandas()
    trees = [Tree.of(c["gram"].to_numpy(), c["n"].to_numpy()) for c in (counts[counts.good], counts[~counts.good])]
    model = UrlModel(*trees)
    test = [*GOOD[38:45], *BAD[28:33], "ünïcode/ä", "x"]
    want = [brute_logs(GOOD[:40], u, ORDER) - brute_logs(BAD[:30], u, ORDER) for u in test]
    assert np.allclose(model.scores(pa.array(test)), want)


def test_held_contexts_are_those_of_the_least_share(spark):
    model = train(labelled(spark), least_share=0.01, held_out=10**9)
    for u in (GOOD[3], BAD[4], "https://other.example/"):
        want = brute_logs(GOOD, u, ORDER, 0.01) - brute_logs(BAD, u, ORDER, 0.01)
        assert np.isclose(model.scores(pa.array([u]))[0], want)
    assert len(model.accepted.contexts) <= (ORDER + 1) / 0.01


def test_unseen_urls_are_told_apart_and_probabilities_are_calibrated(spark):
    rng = np.random.RandomState(1)
    rows = [(u, bool(rng.rand() < 0.9)) for u in GOOD] + [(u, bool(rng.rand() < 0.1)) for u in BAD]
    noisy = spark.createDataFrame(rows, "url string, good boolean")
    fresh = [(k, f"https://www.paper{k % 7}.example/articles/2020/{k}/story-of-the-day", 1) for k in range(300, 400)] + [(k, f"http://cheap{k % 5}.example/buy?id={k}&aff={k * 7}&win=1", 0) for k in range(400, 500)]
    got = scored_urls(spark.createDataFrame(fresh, "page_id bigint, url string, side int"), noisy).toPandas()
    good = got.page_id < 400
    assert (got.accepted == good).mean() >= 0.95
    assert 0.7 < got.probability[good].mean() < 1.0 and 0.0 < got.probability[~good].mean() < 0.3


def test_calibration_without_signal_gives_the_share():
    slope, offset = calibrated(np.array([-0.1, 0.1, -0.1, 0.1]), np.array([True, True, False, False]), np.array([90.0, 90.0, 10.0, 10.0]))
    assert slope == pytest.approx(0, abs=0.05) and 1 / (1 + np.exp(-offset)) == pytest.approx(0.9, abs=0.01)


def test_every_case(spark):
    long = "https://long.example/" + "a/" * 200_000
    pages = spark.createDataFrame([(1, GOOD[0]), (1, GOOD[0]), (None, BAD[0]), (3, None), (4, ""), (5, long)], "page_id bigint, url string").select("*", *[F.lit("x").alias(c) for c in ("score", "good", "gram", "n", "held", "probability", "html")])
    got = scored_urls(pages, labelled(spark)).collect()
    assert len(got) == 6
    by = {r.url: r for r in got}
    assert not by[None].accepted and not by[""].accepted and by[None].score is None and by[""].score is None
    assert by[long].score is not None and by[GOOD[0]].accepted and not by[BAD[0]].accepted
    one_kind = scored_urls(pages, labelled(spark).where("good")).collect()
    assert [r.accepted for r in one_kind].count(True) == 4 and all(r.score is None for r in one_kind)
    assert scored_urls(pages.limit(0), labelled(spark)).count() == 0
    assert scored_urls(pages, labelled(spark).limit(0)).count() == 6


def test_weak_labels(spark):
    page = "<html><script>a b c</script><body><p>{}</p><a href='x'>{}</a></body></html>"
    pages = spark.createDataFrame([("a", page.format("word " * 120, "link")), ("b", page.format("word", "link")), ("c", page.format("word " * 100, "link " * 60)), ("d", None)], "url string, html string")
    assert {r.url: r.good for r in weak_labels(pages).collect()} == {"a": True, "b": False, "c": False, "d": None}
