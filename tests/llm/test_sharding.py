import numpy as np
import pytest

from siftstone.llm.sharding import Places, minimax_cuts, shards

from .cases import docs, same


def brute(sizes, n):
    """Least capacity by trying all, and the greedy ends."""
    def ends(capacity):
        out, held, upto = [], 0, 0
        for s in sizes:
            if held + s > capacity:
                out.append(upto)
                held = 0
            held += s
            upto += s
        return [*out, upto]

    for capacity in range(max(sizes), sum(sizes) + 1):
        if len(ends(capacity)) <= n:
            return capacity, ends(capacity)


@pytest.mark.parametrize("seed", range(12))
def test_equals_brute_force_however_little_the_driver_knows(spark, seed):
    draw = np.random.RandomState(seed)
    sizes = draw.randint(1, draw.choice([3, 50, 400]), draw.randint(1, 60)).tolist()
    n = int(draw.randint(1, 9))
    sums = spark.createDataFrame([(int(x),) for x in np.cumsum(sizes)], "upto bigint")
    capacity, ends = minimax_cuts(sums, sum(sizes), max(sizes), n, known=int(draw.choice([2, 7, 1000])))
    assert (capacity, ends.tolist()) == brute(sizes, n)


def test_loose_stretches_bound_from_both_sides():
    at = np.cumsum([0, 5, 5, 90])
    places = Places(at, np.array([False, False, False, True]))
    assert places.least(2, False, 1) == 90 and places.least(2, True, 1) == 50


def test_documents_in_order_and_every_case(spark):
    got = shards(docs(spark), n_shards=3)
    rows = sorted(((r.source or "", r.doc_id or 0, r.shard_id, r.n_bytes) for r in got.collect()))
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert sum(r[3] for r in rows) == sum(len((t or "").encode()) + 1 for _, t, _, _ in __import__("tests.llm.cases", fromlist=["ROWS"]).ROWS)
    assert same(got, shards(docs(spark, clash=True), n_shards=3))
    assert shards(docs(spark, []), n_shards=3).count() == 0
    assert {r.shard_id for r in shards(docs(spark, [(1, "x", None, None)]), n_shards=3).collect()} == {0}
    with pytest.raises(ValueError):
        shards(docs(spark), n_shards=0)
