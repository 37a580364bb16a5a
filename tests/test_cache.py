"""The semantic cache index beside all pairs: norms, copies, ties, nulls, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.operators import cache, retrieve


def frames(spark, requests, entries):
    q = spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in requests], "request_id int, embedding array<float>")
    e = spark.createDataFrame([(i, None if x is None else [float(y) for y in x], 1) for i, x in entries], "entry_id int, embedding array<float>, pivot int")
    return q, e


@pytest.mark.parametrize("at_least", [0.92, 0.5])
def test_index_equals_all_pairs(spark, at_least):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(6, 8))
    v = (middle[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * rng.choice([0.05, 0.3, 1.0], (300, 1))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[200:260] = v[3]
    v[290:] *= rng.choice([0.5, 0.95, 1.3], (10, 1))
    w = (v[rng.integers(0, 300, 80)] + rng.normal(size=(80, 8)) * 0.1).astype(np.float32)
    w[:40] /= np.linalg.norm(w[:40], axis=1, keepdims=True)
    w[5] = 0
    q, e = frames(spark, [*enumerate(w), (900, None), (901, [])], [*enumerate(v), (900, None), (901, np.zeros(8))])
    dots = np.maximum(0, w.astype(float) @ v.astype(float).T)
    want = {i: int(d.argmax()) for i, d in enumerate(dots) if d.max() > 0 and d.max() >= at_least}
    got = {r["request_id"]: r["entry_id"] for r in cache.semantic(q, e, at_least, pivots=12).collect()}
    assert got == want and 20 < len(want) < 82
    entries = e.filter("size(embedding) > 0").select("entry_id", "embedding")
    pivots = cache.pivot_vectors(entries, 12)
    pairs = cache.candidates(q.filter("size(embedding) > 0"), cache.pivot_index(entries, pivots), pivots, at_least).count()
    assert pairs < (0.5 if at_least > 0.9 else 0.9) * 80 * 240


def test_index_of_empty_tables(spark):
    q, e = frames(spark, [(1, [1, 0])], [(1, [1, 0])])
    assert cache.semantic(q.filter("false"), e).count() == 0 and cache.semantic(q, e.filter("false")).count() == 0
    assert [tuple(r) for r in cache.semantic(q, e).collect()] == [(1, 1, 1.0)]


def test_cells_of_any_size_give_all_pairs(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[100:220] = v[7]
    w = np.concatenate([v[::10], rng.normal(size=(10, 16)).astype(np.float32)])
    q, e = frames(spark, [*enumerate(w), (900, None)], list(enumerate(v)))
    dots = np.zeros((len(w), len(v)))
    for i in range(16):
        dots += w[:, i : i + 1].astype(float) * v[:, i].astype(float)
    want = {(i, int(d.argmax())) for i, d in enumerate(dots) if d.max() >= 5}
    for requests, entries in [(7, 50), (1000, 1000)]:
        assert {(r[0], r[1]) for r in cache.semantic(q, e, 5.0, pivots=5, most_requests=requests, most_entries=entries).collect()} == want and want
    ranks = {(i, int(j), n + 1) for i, d in enumerate(dots) for n, j in enumerate(np.lexsort((np.arange(len(v)), -np.maximum(d, 0)))[:12])}
    for requests, entries in [(7, 50), (1000, 1000)]:
        got = retrieve.vector_top_k(q.filter("size(embedding) > 0"), e, "request_id", "entry_id", 12, most_queries=requests, most_vectors=entries)
        assert {(r["request_id"], r["entry_id"], r["rank"]) for r in got.collect()} == ranks
    odd, held = frames(spark, [(1, None), (2, [1, 0, 0])], [(3, [1, 0]), (4, None), (5, [2, 0, 0])])
    got = sorted((r["request_id"], r["rank"], r["entry_id"], r["score"]) for r in retrieve.vector_top_k(odd, held, "request_id", "entry_id", 2).collect())
    assert got == [(1, 1, 3, 0.0), (1, 2, 4, 0.0), (2, 1, 5, 2.0), (2, 2, 3, 0.0)]
    assert not any("CartesianProduct" in p or "BroadcastNestedLoopJoin" in p for p in [retrieve.vector_top_k(odd, held, "request_id", "entry_id", 2)._jdf.queryExecution().executedPlan().toString()])


def test_semantic_query_asks_with_every_tenth_vector(spark):
    from inkwarden.plans import catalog

    assert "% 10 = 0 AND v.vec_id % 10 <> 0" in catalog.ORACLES["cache_semantic"] and "0.5" in catalog.ORACLES["cache_semantic"]
