import numpy as np
import pytest

from lexframe.llm import mixing as mx

SIZES = "row_id bigint, source string, tokens bigint, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def test_pivotal_keeps_the_total_and_the_expectation():
    rng = np.random.default_rng(0)
    weight = rng.integers(1, 200, 300).astype(float)
    mean = np.zeros(300)
    for seed in range(400):
        p, left = mx.pivotal(np.full(300, 0.3), weight, np.random.default_rng(seed))
        assert abs((p * weight).sum() - 0.3 * weight.sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != left)
        mean += p / 400
    assert abs(mean - 0.3).max() < 0.12 and abs(mean.mean() - 0.3) < 0.01


def test_pivotal_edges():
    assert mx.pivotal(np.array([]), np.array([]), np.random.default_rng(0))[1] == -1
    p, left = mx.pivotal(np.array([0.0, 1.0, 1 - 1e-12]), np.ones(3), np.random.default_rng(0))
    assert list(p) == [0, 1, 1] and left == -1


@pytest.fixture
def frames(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", "c", None, "other"][i % 5 if i % 3 else 0], int(rng.integers(0, 300)), 0) for i in range(4000)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("absent", 0.1, 1), (None, 0.5, 1), ("a", 0.5, 1)]
    return spark.createDataFrame(rows, SIZES), spark.createDataFrame(targets, TARGETS)


@pytest.mark.parametrize("leaf", [10_000, 150, 7])
def test_shares_are_reached(frames, leaf):
    sizes, targets = frames
    plan = mx.plan(sizes, targets)
    chosen = mx.mixed(sizes, plan, 4000, leaf=leaf)
    rows = {r["source"]: r for r in mx.shares(chosen, plan).collect()}
    assert set(rows) == {"a", "b", "c", "absent"} and rows["absent"]["chosen"] == 0
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(rows[s]["reached"] - want) < 0.003
    assert chosen.groupBy("row_id").count().where("count > 1").count() == 0
    most = {r["source"]: r["m"] for r in chosen.groupBy("source").agg({"repeats": "max"}).withColumnRenamed("max(repeats)", "m").collect()}
    assert most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 4


def test_the_same_rows_give_the_same_mix(frames):
    sizes, targets = frames
    plan = mx.plan(sizes, targets)
    pick = lambda df: sorted(tuple(r) for r in mx.mixed(df, plan, 4000, seed=5, leaf=200).collect())
    assert pick(sizes) == pick(sizes.repartition(7))


def test_a_larger_total_caps_small_sources(frames):
    sizes, targets = frames
    plan = mx.plan(sizes, targets, total_tokens=10**9)
    assert {r["source"]: r["copies"] for r in plan.collect()} == {"a": 1.0, "b": 2.0, "c": 4.0, "absent": 0.0}


def test_empty(spark, frames):
    none = spark.createDataFrame([], SIZES)
    plan = mx.plan(none, frames[1])
    assert mx.mixed(none, plan, 0).count() == 0
    assert mx.shares(mx.mixed(none, plan, 0), plan).count() == 4


def test_a_scarce_source_falls_short_and_shrinks_no_other(spark):
    sizes = spark.createDataFrame([(i, "big" if i else "tiny", 20, 0) for i in range(1001)], SIZES)
    targets = spark.createDataFrame([("big", 0.99, 2), ("tiny", 0.01, 2)], TARGETS)
    plan = mx.plan(sizes, targets)
    got = {r["source"]: r for r in mx.shares(mx.mixed(sizes, plan, 1001), plan).collect()}
    assert got["tiny"]["tokens"] == 40 and got["tiny"]["reached"] < 0.003
    assert abs(got["big"]["tokens"] - 0.99 * 20 * 1001) <= 20
