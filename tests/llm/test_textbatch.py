import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siftstone.llm import ngram_join, quality_model, textbatch

TEXTS = pa.array([" ".join(f"word{k}of{j}" for j in range(170)) for k in range(2500)])


@pytest.mark.parametrize("work", [quality_model.statistics, lambda texts: ngram_join.signatures(texts, 3, 160)])
def test_memory_does_not_follow_the_batch(monkeypatch, work):
    monkeypatch.setattr(textbatch, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    work(TEXTS.slice(0, 10))
    tracemalloc.start()
    work(TEXTS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert TEXTS.nbytes > 4 << 20
    assert peak < 40 << 20
