"""The pipeline's stages beside plain loops, on empty tables and odd rows; the quality model beside numpy on all rows at once."""

import random

import numpy as np
import pytest

from inkwarden.llm import line_dedup, near_dedup, quality

from .test_operators import brute_components, prose, within_one

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], FIELDS)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(30)))], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id bigint, quality int").write.parquet(f"{sf}/labels.parquet")
    return str(sf)


def test_stages_of_an_empty_table(spark, inputs):
    import corpus_pipeline

    docs = frame(spark, []).filter("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, inputs)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, inputs).count() == 0


def test_stages_beside_plain_loops(spark, inputs):
    import corpus_pipeline

    rng, stages = random.Random(81), dict(corpus_pipeline.STAGES)
    leak = " ".join(f"word{k}" for k in range(30))
    shared = "a line of the footer that many documents share"
    bodies = [prose(rng, 50) for _ in range(12)]
    rows = [(i, f"{rng.choice(bodies)}\n{rng.choice([shared, shared[:-1], 'short', 'shorT', ''])}\nown {i} {prose(rng, 6)}") for i in range(60)]
    rows += [(100 + k, f"{prose(rng, 30)} {leak} {prose(rng, 10)}") for k in range(4)] + [(None, None), (200, ""), (7, "other text under a used number"), (None, shared)]

    # lines: equal to an earlier one, or of 20 characters within one edit of it
    key = lambda r: 2**63 if r[0] is None else r[0]
    lines = [((key(r), k), s.strip()) for r in rows for k, s in enumerate((r[1] or "").split("\n")) if s.strip()]
    gone = {p for p, s in lines if any(q < p and (s == t or min(len(s), len(t)) >= 20 and within_one(s, t)) for q, t in lines)}
    want = []
    for i, t in rows:
        kept = [s for k, s in enumerate((t or "").split("\n")) if (key((i,)), k) not in gone or not s.strip()]
        if t is None or len(kept) == len(t.split("\n")):
            want.append((i, t))
        elif "\n".join(kept).strip():
            want.append((i, "\n".join(kept)))
    out = stages["line_dedup"](spark, frame(spark, rows), inputs)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())

    # near copies: the smallest id of each component
    numbered = [r for r in rows if r[0] is not None and r[0] != 7 or r == rows[7]]
    _, comps = brute_components([t for _, t in sorted(numbered)])
    ids = [i for i, _ in sorted(numbered)]
    near = stages["near_dedup"](spark, frame(spark, numbered), inputs)
    assert sorted(r["doc_id"] for r in near.collect()) == [i for k, i in enumerate(ids) if comps[k] == k]

    # leaks, and the whole of what is packed
    clean = stages["decontaminate"](spark, frame(spark, rows), inputs)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted([r for r in rows if leak not in (r[1] or "")], key=repr)
    packed = stages["packing"](spark, clean, inputs).collect()
    assert sorted((r["doc_id"] for r in packed if r["piece"] == 0), key=repr) == sorted((i for i, t in rows if leak not in (t or "")), key=repr)


def test_quality_model_equals_numpy_on_all_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0.2).astype(float)
    calibrate = rng.random(600) < 0.3
    rows = spark.createDataFrame([(a.tolist(), float(b), bool(c)) for a, b, c in zip(x, y, calibrate)], "x array<double>, y double, calibrate boolean").repartition(7)
    model = quality.fit(rows)
    a, b = x[~calibrate], y[~calibrate]
    one = quality.Model(a.mean(0), np.sqrt(a.var(0)) + 1e-3, 256, 4.0, 7)
    w = np.where(b > 0, 0.5 * len(b) / b.sum(), 0.5 * len(b) / (len(b) - b.sum()))[:, None]
    p = one.phi(a)
    one.theta = np.linalg.solve(p.T @ (w * p) + np.eye(p.shape[1]), (w * p).T @ (2 * b - 1))
    assert np.allclose(model.raw(x), one.raw(x), atol=1e-6)
    held, knots = model.raw(x[calibrate]), model.knots
    assert np.all(np.diff(knots[1]) > 0) and np.all((0 <= model.probability(x)) & (model.probability(x) <= 1))
    assert abs(model.probability(x[calibrate]).mean() - y[calibrate].mean()) < 0.03 and len(held)


def test_isotonic_map_is_the_best_rising_one():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = rng.integers(1, 9)
        rate, weight = rng.random(n), rng.integers(1, 5, n).astype(float)
        at, level = quality.isotonic(np.arange(n, dtype=float), rate, weight)
        assert np.all(np.diff(level) > 0)
        # least squares over all ways to cut the sequence into blocks of equal level that rise
        ways = []
        for cuts in range(1 << (n - 1)):
            begin = [0, *[k + 1 for k in range(n - 1) if cuts >> k & 1]]
            blocks = list(zip(begin, [*begin[1:], n]))
            means = [np.average(rate[i:j], weights=weight[i:j]) for i, j in blocks]
            if np.all(np.diff(means) > 0):
                ways.append((sum(weight[i:j] @ (rate[i:j] - m) ** 2 for (i, j), m in zip(blocks, means)), means))
        assert np.allclose(min(ways, key=lambda w: w[0])[1], level)
