import numpy as np
import pytest

import corpus_pipeline
from siftstone.llm.mixing import WINDOWS, fitted


def nearest(lengths, counts, budget):
    sums = {0}
    for length, count in zip(lengths, counts):
        sums = {s + n * length for s in sums for n in range(count + 1) if s + n * length <= budget}
    return max(sums)


def test_gap_that_greedy_leaves_is_closed():
    take = fitted(np.array([300, 500]), np.array([100, 100]), 40_100)
    assert take @ [300, 500] == 40_100


@pytest.mark.parametrize("seed", range(300))
def test_sum_is_the_nearest_there_is(seed):
    draw = np.random.RandomState(seed)
    lengths = np.sort(draw.choice(np.arange(3, 200), draw.randint(1, 7), replace=False))
    counts = draw.randint(1, 8, len(lengths))
    budget = int(draw.randint(0, lengths @ counts + 1))
    take = fitted(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    assert take @ lengths == nearest(lengths.tolist(), counts.tolist(), budget)


def test_large_budget_is_met_and_stays_proportional():
    draw = np.random.RandomState(1)
    lengths = np.unique(draw.randint(20, 30_000, 2000))
    counts = draw.randint(1, 40, len(lengths))
    total = int(lengths @ counts)
    for budget in draw.randint(total // 10, total, 20):
        take = fitted(lengths, counts, int(budget))
        assert take @ lengths == budget
        half = len(lengths) // 2
        share = take[half:] @ lengths[half:] / (counts[half:] @ lengths[half:])
        assert abs(share - budget / total) < 2 * WINDOWS[0] / total + 0.01


def test_tiny_source_does_not_shrink_the_pipelines_mixture(spark):
    hot = [(k, f"some words of document {k} in the hot source", "hot") for k in range(400)]
    docs = spark.createDataFrame([*hot, (1000, "tiny", "small"), (1001, "a text without a source", None)], "doc_id bigint, text string, source string")
    got = {r.doc_id for r in corpus_pipeline.mixture(spark, docs, "").select("doc_id").collect()}
    assert {1000, 1001} <= got
    assert len(got) > 300


def test_counting_remembers_no_token_ids():
    import tracemalloc

    import pyarrow as pa

    from siftstone.llm.tokens import VOCABULARY, Tokens

    own = Tokens(VOCABULARY)
    parts = [f"zq{k:x}xv{k * 7919:x}" for k in range(20_000)]
    texts = pa.array([" ".join(parts[k : k + 100]) for k in range(0, len(parts), 100)] + [None, "", "a  b ", "x \n y"])
    tracemalloc.start()
    counts = own.counts(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert counts.tolist() == [len(x) for x in own.ids(texts).to_pylist()]
    assert held < 200 * len(parts)
