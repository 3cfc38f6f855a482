import math

import numpy as np

from inkdex.llm import vptree


def brute(ids, points, query, k):
    d = sorted((math.dist(points[query], p), i) for n, (i, p) in enumerate(zip(ids, points)) if i != ids[query])
    return d[:k]


def test_exact_search_equals_brute_force():
    rng = np.random.default_rng(9)
    for n, dim in ((1, 3), (5, 3), (900, 2), (900, 8)):
        points = rng.normal(size=(n, dim))
        points = np.round(points * 4) / 4 if dim == 2 else points  # a grid has many ties, and exact squares
        ids = rng.permutation(n).astype(np.int64) * 3
        tree = vptree.Tree(ids, points, 1.0)
        queries = np.arange(0, n, max(1, n // 40))
        row, found, d = tree.search(ids[queries], points[queries], 10)
        for at, q in enumerate(queries):
            want = brute(ids, points, q, 10)
            assert found[row == at].tolist() == [i for _, i in want]
            assert np.allclose(d[row == at], [x for x, _ in want], rtol=1e-12)
        if n == 900 and dim == 2:
            assert tree.looked < 0.5 * len(queries) * n


def test_relaxed_search_looks_at_fewer_and_recalls_most():
    rng = np.random.default_rng(10)
    points, ids = rng.normal(size=(4000, 4)), np.arange(4000)
    found, looked = {}, {}
    for factor in (1.0, 0.6):
        tree = vptree.Tree(ids, points, factor)
        row, got, _ = tree.search(ids[:200], points[:200], 10)
        found[factor], looked[factor] = set(zip(row.tolist(), got.tolist())), tree.looked
    assert looked[0.6] < 0.9 * looked[1.0]
    assert len(found[0.6] & found[1.0]) >= 0.9 * len(found[1.0])


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, shard string")


def test_documents(spark):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(700, 16)).astype(np.float32)
    points[5], points[9] = points[0], points[0]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [None] + [1.0] * 15), (1100, [float("inf")] * 16), (1200, [1.0, 2.0]), (None, [1.0] * 16)]
    got = vptree.nearest(table(spark, rows + odd), k=10, every=100, shard_rows=150).collect()
    want = {}
    exact = points.astype(np.float64)
    for q in range(0, 700, 100):
        want[q] = brute(list(range(700)), exact, q, 10)
    assert {r.query_id for r in got} == set(want)
    for q, near in want.items():
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[1] for m in mine] == [i for _, i in near]
        assert np.allclose([m[2] for m in mine], [d for d, _ in near], rtol=1e-12)


def test_repeated_query_rows(spark):
    """Rows that repeat a query are one query; another vector under its id is a query of its own; none finds its own id."""
    rng = np.random.default_rng(12)
    points = np.round(rng.normal(size=(60, 3)), 1)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    other = [5.0, 5.0, 5.0]
    for shard_rows in (1000, 8):
        got = vptree.nearest(table(spark, rows + [rows[0], rows[0], (0, other), rows[7]]), k=10, every=100, shard_rows=shard_rows).collect()
        by = {}
        for r in got:
            by.setdefault(r.query_key, []).append((r["rank"], r.vec_id, r.score))
        assert {r.query_id for r in got} == {0} and len(by) == 2
        vecs = [(i, np.float32(p).astype(float)) for i, p in rows + [rows[7]] if i]
        want = [sorted((math.dist(np.float32(q).astype(float), p), i) for i, p in vecs)[:10] for q in (rows[0][1], other)]
        mine = [[(i, round(d, 9)) for _, i, d in sorted(x)] for x in by.values()]
        assert sorted(mine) == sorted([(i, round(d, 9)) for d, i in w] for w in want)


def test_clusters_are_pruned_and_a_crowd_of_equal_vectors_is_split(spark):
    rng = np.random.default_rng(13)
    centers = rng.normal(size=(20, 8)) * 20
    points = centers[np.arange(3000) % 20] + rng.normal(size=(3000, 8))
    points[::3] = points[0]  # a third of all rows
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    df = table(spark, rows)
    exact = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    got = vptree.nearest(df, k=10, every=100, shard_rows=100).collect()
    for q in range(0, 3000, 700):
        want = brute(list(range(3000)), exact, q, 10)
        assert [(r.vec_id, round(r.score, 9)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, round(d, 9)) for d, i in want]
    looked = vptree.search(df, 10, 100, 1.0, "vec_id", "embedding", 100).selectExpr("sum(looked)").first()[0]
    assert looked < 0.6 * 30 * 3000


def test_recall_of_the_registered_factor(spark):
    from inkdex.llm.common import table as load
    from inkdex.llm.registry import VP_FACTOR

    df = load(spark, "/root/testdata/sf0.1", "embeddings")
    pairs = lambda factor: {(r.query_id, r.vec_id) for r in vptree.nearest(df, factor=factor).select("query_id", "vec_id").collect()}
    exact = pairs(1.0)
    assert len(pairs(VP_FACTOR) & exact) >= 0.9 * len(exact)


def test_few_and_none(spark):
    got = vptree.nearest(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), k=10).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)]
    assert vptree.nearest(table(spark, [(0, [1.0, 0.0])])).collect() == []
    assert vptree.nearest(table(spark, []).limit(0)).collect() == []
