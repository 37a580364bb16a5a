"""Budgets and running flags by scans over blocks, beside a plain loop."""

import random
from collections import defaultdict

import pytest

from inkwarden.operators import evaluate, jobs


def brute_ledger(rows, most):
    spent, out = defaultdict(int), {}
    for tenant, at, key, eps, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        need = round((eps or 0) * 10)
        allowed = spent[tenant] + need <= most
        spent[tenant] += need if allowed and ok else 0
        out[key] = (allowed, round(spent[tenant] / 10, 6))
    return out


@pytest.mark.parametrize("bits", [(2, 1), (3, 4), (10, 10)])
def test_refused_and_failed_uses_cost_nothing(spark, bits):
    rng = random.Random(sum(bits))
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randrange(90), k, rng.choice([0.1, 0.1, 0.5, 0.7, None, 9.9]), rng.choice([True, True, False, None])) for k in range(400)]
    df = spark.createDataFrame(rows, "tenant_id int, at int, key int, epsilon double, succeeded boolean").repartition(5)
    got = {r["key"]: (r["allowed"], r["spent"]) for r in jobs.ledger(df, 5.0, ["at", "key"], block_bits=bits[0], fan_bits=bits[1]).collect()}
    want = brute_ledger(rows, 50)
    assert got == want and {a for a, _ in want.values()} == {True, False}
    assert jobs.ledger(df.filter("false"), 5.0, ["at", "key"]).count() == 0
    with pytest.raises(ValueError):
        jobs.ledger(df, 5.0, ["at"], grain=1e-7)


def test_a_smaller_use_fits_after_a_refused_one(spark):
    rows = [(1, 0, 0, 4.8), (1, 1, 1, 0.5), (1, 2, 2, 0.2), (1, 3, 3, 0.1)]
    df = spark.createDataFrame(rows, "tenant_id int, at int, key int, epsilon double")
    assert sorted((r["key"], r["allowed"], r["spent"]) for r in jobs.ledger(df, 5.0, ["at"]).collect()) == [(0, True, 4.8), (1, False, 4.8), (2, True, 5.0), (3, False, 5.0)]


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_best_flags_over_blocks(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice([None, *range(60)])) for k in range(300)]
    df = spark.createDataFrame([(j, o, None if x is None else 60.0 - o / 10 + x) for j, o, x in rows], "job_id int, ord int, eval_loss double").repartition(4)
    want, least, last = {}, {}, {}
    for j, o, x in rows:
        loss = None if x is None else 60.0 - o / 10 + x
        want[o] = loss is not None and (least.get(j) is None or loss < least[j])
        if want[o]:
            least[j], last[j] = loss, o
    got = {r["ord"]: (r["was_best"], r["is_best"]) for r in evaluate.flag_best(df, block_bits=bits).collect()}
    assert got == {o: (was, was and last[j] == o) for (j, o, _), was in zip(rows, want.values())}
