import numpy as np

from gleaner.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int"


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1200, 24)).astype(np.float32)
    x[600:800] = x[:200] + 0.1 * rng.standard_normal((200, 24)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], SCHEMA)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=20, block=500, query_block=25).toPandas()
    exact, hits = x.astype(float) @ x.astype(float).T, 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, exact[q, g.vec_id.to_numpy()], atol=1e-12) and (np.diff(g.score) <= 0).all()
        s = exact[q].copy()
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(s)), -s))[:20]) & set(g.vec_id))
    assert got.query_id.nunique() == 60 and hits / (60 * 20) >= 0.9


def test_few_rows_are_exact_with_ties_and_invalid_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (40, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = ann.search(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 20, 1.0), (0, 2, 5, 0.5), (0, 3, 6, 0.5), (20, 1, 0, 1.0), (20, 2, 5, 0.5), (20, 3, 6, 0.5)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_a_hot_vector_yields_its_smallest_ids(spark):
    rows = [(k, [1.0, 1.0] if k % 3 else [1.0, k / 1000], 0) for k in range(300)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:2], SCHEMA), k=5).filter("query_id = 1").orderBy("rank")
    assert [r["vec_id"] for r in got.collect()] == [2, 4, 5, 7, 8]


def test_recall_on_uneven_norms():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((4000, 64))
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    for scale in (np.r_[3.0, np.ones(3999)], np.exp(0.5 * rng.standard_normal(4000))):
        x = (unit * scale[:, None]).astype(np.float32)
        hits = 0
        for q, (places, _) in zip(x[100:140], ann.NormRanges(x).search(x[100:140], 20), strict=True):
            hits += len(set(np.argsort(-(x.astype(float) @ q.astype(float)))[:20]) & set(places.tolist()))
        assert hits / (40 * 20) >= 0.9


def test_recall_holds_as_a_block_grows_and_is_one_if_all_is_verified():
    rng = np.random.default_rng(9)
    for n in (2_000, 16_000):
        x = rng.standard_normal((n, 64)).astype(np.float32)
        x /= np.sqrt((x**2).sum(axis=1))[:, None]
        queries = x[:25]
        for verify, least in ((ann.VERIFY, 0.9), (1.0, 1.0)):
            hits = 0
            for q, (places, _) in zip(queries, ann.NormRanges(x, verify).search(queries, 20), strict=True):
                hits += len(set(np.argsort(-(x.astype(float) @ q.astype(float)))[:20]) & set(places.tolist()))
            assert hits / (25 * 20) >= least
