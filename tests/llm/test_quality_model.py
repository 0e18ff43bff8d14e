import numpy as np
from pyspark.sql import functions as F

from siftstone.llm.quality_model import LEAST_STRENGTH, MOST_STRENGTH, _met, _shares, kept, posteriors, scores

from .cases import docs, same


def brute(rows):
    """Shares of each row's site without the row itself, a document at a time."""
    host, path, p = zip(*rows)
    p = np.array(p)
    hosts, paths = sorted(set(host), key=str), sorted(set(zip(host, path)), key=str)
    in_host = {h: [k for k in range(len(p)) if host[k] == h] for h in hosts}
    in_path = {x: [k for k in range(len(p)) if (host[k], path[k]) == x] for x in paths}
    m, n = p.mean(), len(p)

    def strength(within, spread, degrees, size):
        between = (spread - degrees * within) / size if size > 1e-12 else -1
        return MOST_STRENGTH if between <= 0 or degrees < 1 else min(max(within / max(between, 1e-12), LEAST_STRENGTH), MOST_STRENGTH)

    def pooled(groups):
        free = n - len(groups)
        return sum(((p[g] - p[g].mean()) ** 2).sum() for g in groups.values()) / free if free else 0.0

    kh = strength(pooled(in_host), sum(len(g) * (p[g].mean() - m) ** 2 for g in in_host.values()), len(hosts) - 1, n - sum(len(g) ** 2 for g in in_host.values()) / n)
    kp = strength(pooled(in_path), sum(len(g) * (p[g].mean() - p[in_host[x[0]]].mean()) ** 2 for x, g in in_path.items()), len(paths) - len(hosts), n - sum(len(g) ** 2 / len(in_host[x[0]]) for x, g in in_path.items()))
    out = []
    for k in range(n):
        h, g = in_host[host[k]], in_path[host[k], path[k]]
        hs = (p[h].sum() - p[k] + kh * m) / (len(h) - 1 + kh)
        out.append((hs, (p[g].sum() - p[k] + kp * hs) / (len(g) - 1 + kp)))
    return out


def test_shares_equal_brute_force(spark):
    draw = np.random.RandomState(5)
    rows = []
    for h in range(12):
        level = draw.beta(2, 2)
        rows += [(f"h{h}" if h else None, f"p{draw.randint(3)}" if draw.rand() < 0.9 else None, float(np.clip(level + 0.1 * draw.randn(), 0.001, 0.999))) for _ in range(draw.randint(1, 30))]
    scored = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, host string, path string, p double")
    host, path = _shares()
    got = {r.k: (r.h, r.s) for r in _met(scored, posteriors(scored)).select("k", host.alias("h"), path.alias("s")).collect()}
    for k, want in enumerate(brute(rows)):
        assert np.allclose(got[k], want, atol=1e-6), k


def test_sites_of_soft_evidence_keep_their_signal(spark):
    scored = spark.createDataFrame([(f"h{k}", "p", 0.6 if k % 2 else 0.4) for k in range(300) for _ in range(3)], "host string, path string, p double")
    host, _ = _shares()
    got = _met(scored, posteriors(scored)).select("p", host.alias("h")).groupBy("p").agg(F.avg("h").alias("h")).collect()
    by = {r.p: r.h for r in got}
    assert by[0.6] > 0.53 and by[0.4] < 0.47


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int")


def test_every_case(spark):
    known = labels(spark, [(1, 1), (2, 1), (5, 0), (6, 0), (8, 1), (99, 1), (None, 1), (7, None)])
    got = scores(docs(spark), known)
    rows = got.collect()
    assert len(rows) == 11
    least = min(r.evidence for r in rows)
    assert {r.doc_id for r in rows if r.evidence == least} >= {3, 4, 5, 6}
    assert same(got.select("doc_id", F.round("posterior", 9)), scores(docs(spark, clash=True), known).select("doc_id", F.round("posterior", 9)))
    stay = kept(docs(spark, clash=True), known)
    assert stay.columns == docs(spark, clash=True).columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert scores(docs(spark), labels(spark, [])).where("kept").count() == 11
    assert kept(docs(spark, []), known).count() == 0 and scores(docs(spark, []), known).count() == 0


def test_held_out_labels_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    every = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = scores(spark.read.parquet(f"{d}/documents.parquet"), every.where(~out)).join(every.where(out), "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() >= 0.95
    assert got.kept[got.quality == 1].mean() >= 0.98


def test_url_gives_host_and_path(spark):
    df = spark.createDataFrame([(1, "some words here", "https://A.example/x/y?z"), (2, "some other words", "https://a.example/x"), (3, "words", None)], "doc_id bigint, text string, url string")
    assert scores(df, labels(spark, [(1, 1), (2, 0)]), url="url").count() == 3
