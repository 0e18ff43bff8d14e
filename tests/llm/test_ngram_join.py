import numpy as np
import pyarrow as pa
import pytest

from siftstone.llm import ngram_join, textbatch
from siftstone.llm.ngram_join import _tree, duplicate_groups, linked_documents, similar_pairs


def groups(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        x, y = of[a], of[b]
        of = [min(x, y) if k in (x, y) else k for k in of]
    return of


def check(n, hit, rows, cols):
    i, j = _tree(hit, rows, cols)
    assert hit[i, j].all()
    a, b = np.nonzero(hit)
    every = groups(n, zip(rows[a], cols[b]))
    assert groups(n, zip(rows[i], cols[j])) == every
    assert len(i) == n - len(set(every))


def test_shared_column_keeps_its_own_edges():
    hit = np.zeros((4, 4), bool)
    hit[0, 3] = hit[2, 3] = hit[1, 2] = True
    check(4, hit, np.arange(4), np.arange(4))


@pytest.mark.parametrize("seed", range(200))
def test_forest_has_the_components_of_all_hits(seed):
    draw = np.random.RandomState(seed)
    n = draw.randint(1, 30)
    hit = np.triu(draw.rand(n, n) < draw.choice([0.02, 0.05, 0.1, 0.3]), 1)
    check(n, hit, np.arange(n), np.arange(n))
    cut = draw.rand(n) < 0.5
    rows, cols = np.flatnonzero(cut), np.flatnonzero(~cut)
    check(n, draw.rand(len(rows), len(cols)) < 0.1, rows, cols)


def test_chains_in_any_order():
    for seed in range(50):
        order = np.random.RandomState(seed).permutation(25)
        hit = np.zeros((25, 25), bool)
        hit[np.minimum(order[1:], order[:-1]), np.maximum(order[1:], order[:-1])] = True
        check(25, hit, np.arange(25), np.arange(25))


def test_each_text_of_an_id_is_a_query(spark):
    one = "the first of two texts that share an id with nothing else in common"
    two = "quite another piece about ships in a harbour on some winter evening long ago"
    near = two + " indeed"
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two), (4, near), (5, "alone here")], "doc_id bigint, text string")
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in similar_pairs(docs).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 4), (3, 4)}
    assert got[1, 2] == got[1, 3] == 1.0
    assert got[3, 4] == got[1, 4] < 1.0
    assert {(r.doc_id, r.group_id) for r in duplicate_groups(docs).collect()} == {(k, 1) for k in (1, 2, 3, 4)}


def counted(pairs, ids):
    """(doc_id, class_id, links) from a list of pairs."""
    near = {k: set() for k in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = set()
    for k in ids:
        todo, seen = [k], {k}
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.add((k, min(seen), len(near[k])))
    return out


def corpus(seed=3, bases=12, changes=9):
    """Exact and near copies in groups of many sizes, some ids with two texts, a repeated row, rows without words."""
    draw = np.random.RandomState(seed)
    rows, k = [], 0
    for base in range(bases):
        words = [f"w{x}" for x in draw.randint(0, 4000, 60)]
        for _ in range(base + 1):
            own = list(words)
            for at in draw.randint(0, 60, draw.randint(0, changes)):
                own[at] = f"v{draw.randint(0, 9999)}"
            for _ in range(draw.randint(1, 4)):
                rows.append((k, " ".join(own)))
                k += 1
    rows += [(5, rows[70][1]), (5, rows[20][1]), (9, rows[70][1]), (40, "a text that no other has at all"), rows[0]]
    rows += [(k, None), (k + 1, ""), (k + 2, "..."), (None, rows[0][1]), (None, None)]
    return rows


@pytest.mark.parametrize("tile", [2048, 5])
def test_links_and_classes_are_those_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = [(r.doc_id_a, r.doc_id_b) for r in similar_pairs(docs).collect()]
    got = linked_documents(docs).collect()
    assert len(got) == len({k for k, _ in rows if k is not None})
    assert {tuple(r) for r in got} == counted(pairs, {k for k, _ in rows if k is not None})


def test_links_are_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = corpus(4, changes=3)  # no similarity near the threshold, where the search is approximate
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    said = con.execute(ngram_join.SQL).fetchall()
    got = [tuple(r) for r in linked_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(said)


def test_rows_grow_as_the_documents_and_not_as_the_pairs(spark):
    docs = spark.createDataFrame([(k, "one text of several words that all of them have") for k in range(60)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in linked_documents(docs).collect()) == [(k, 0, 59) for k in range(60)]


def test_an_empty_table_gives_no_rows(spark):
    assert linked_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_large_group_of_near_copies_is_counted_and_not_listed(spark):
    draw = np.random.RandomState(5)
    base = [f"w{x}" for x in range(100)]
    rows = []
    for k in range(200):
        own = list(base)
        own[draw.randint(100)] = f"v{k}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    members, named, blocks = ngram_join.candidate_blocks(docs, n=3, threshold=0.5, bands=40, rows=4, tolerance=0.005)
    found = ngram_join.counted_links(docs, named, blocks.selectExpr("id", "component", "1L AS copies", "false AS mixed"), n=3, threshold=0.5).collect()
    assert sorted(r.kind for r in found) == [ngram_join.EDGE] * 199 + [ngram_join.SUM] * 200
    assert {r.links for r in found if r.kind == ngram_join.SUM} == {199}


def test_a_signed_text_is_cut_into_words_once(monkeypatch):
    cut, real = [], textbatch.words
    for module in (textbatch, ngram_join):
        monkeypatch.setattr(module, "words", lambda texts: cut.append(len(texts)) or real(texts), raising=False)
    texts = pa.array(["one text of several words", "", "another text of several words", None])
    _, some, d1, d2 = ngram_join.signatures(texts, 3, 160)
    assert cut == [4]
    assert some.tolist() == [True, False, True, False]
    assert [x.tolist() for x in (d1, d2)] == [x.tolist() for x in textbatch.sequence_digests(textbatch.plain(texts))]


def test_rows_of_buckets_are_moved_once(spark):
    keys = [np.array(k, np.uint32).tobytes() for k in ([7, 4_000_000_000, 1], [1, 4_000_000_000, 7], [7, 2, 3])]
    met = ngram_join._shared_buckets(spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(keys)], "rep bigint, keys binary"), 3)
    assert sorted(tuple(r) for r in met.collect()) == [(0, 7), (0, (1 << 32) + 4_000_000_000), (1, (1 << 32) + 4_000_000_000), (2, 7)]
    assert met._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 0


def test_only_texts_that_are_verified_are_moved(spark):
    docs = spark.createDataFrame([(k, f"text number {k} of many") for k in range(-2000, 2000)] + [(None, "no id")], "doc_id bigint, text string")
    wanted = set(range(-2000, 2000, 100))
    rows = ngram_join._digested(docs, spark.createDataFrame([(k,) for k in wanted], "id bigint")).collect()
    assert wanted <= {r.leader for r in rows}
    assert len(rows) < len(wanted) + 5
    assert all(r.text == f"text number {r.leader} of many" for r in rows)
    assert ngram_join._digested(docs, spark.createDataFrame([], "id bigint")).count() == 0
