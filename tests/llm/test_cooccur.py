import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lexframe.llm import cooccur as co

SCHEMA = "field string, record bigint, item string, extra int"


def brute(rows, least=5, lift=4):
    out = {}
    for field in {r[0] for r in rows}:
        baskets, n, ab = defaultdict(set), defaultdict(int), defaultdict(int)
        for f, record, item, _ in rows:
            if f == field and item and record is not None:
                baskets[record].add(item)
        for items in baskets.values():
            for x in items:
                n[x] += 1
            for pair in combinations(sorted(items, key=str.encode), 2):
                ab[pair] += 1
        for (a, b), k in ab.items():
            if k >= least and k * len(baskets) >= lift * n[a] * n[b]:
                out[field, a, b] = (n[a], n[b], len(baskets), k)
    return out


def data(seed=3, baskets=400):
    rng = random.Random(seed)
    rows = []
    for r in range(baskets):
        topic = rng.randrange(20)
        items = {f"t{topic}-{rng.randrange(4)}" for _ in range(rng.randrange(1, 6))} | {f"n{rng.randrange(300)}" for _ in range(2)}
        items |= {"hot"} if rng.random() < 0.4 else set()
        rows += [(rng.choice(["x", "y"]) if rng.random() < 0.02 else "x", r, i, 0) for i in items]
    for r in range(baskets, baskets + 6):  # wide baskets
        rows += [("x", r, f"n{i}", 0) for i in rng.sample(range(300), 60)] + [("x", r, f"t0-{i}", 0) for i in range(4)]
    return rows + rows[:50] + [("x", None, "t1-1", 0), ("x", 5, None, 0), ("x", 5, "", 0), ("x", 5, "é", 0)]


@pytest.mark.parametrize("block", [1000, 20, 3])
def test_against_brute_force(spark, block):
    rows = data()
    got = co.cooccurrences(spark.createDataFrame(rows, SCHEMA), block_items=block)
    assert {(r["field"], r["item_a"], r["item_b"]): (r["n_a"], r["n_b"], r["m"], r["n_ab"]) for r in got.collect()} == brute(rows)


def test_blocks_are_cut_between_baskets(monkeypatch):
    rows = [("x", r, 0, 0, 0, i) for r in range(200) for i in range(r % 5)]
    types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    names = ["field", "record", "block_a", "block_b", "block", "id"]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[i : i + 7]), types)], names=names) for i in range(0, len(rows), 7)]
    monkeypatch.setattr(co, "BLOCK_ROWS", 50)
    total = sum(sum(b.column("n").to_pylist()) for b in co._multiplied(iter(batches)))
    assert total == sum(k * (k - 1) // 2 for k in (r % 5 for r in range(200)))


@pytest.mark.parametrize("products", [1, 7, 10**6])
def test_products_of_sparse_blocks(monkeypatch, products):
    monkeypatch.setattr(co, "PRODUCTS", products)
    rng = np.random.default_rng(1)
    x, y = rng.random((60, 12)) < 0.3, rng.random((60, 9)) < 0.2
    a, b, n = co.product(*np.nonzero(x), *np.nonzero(y))
    g = x.astype(int).T @ y.astype(int)
    assert {(i, j): k for i, j, k in zip(a, b, n)} == {(i, j): g[i, j] for i in range(12) for j in range(9) if g[i, j]}
    place, item = np.nonzero(x)
    all_ = np.ones(len(place), bool)
    a, b, n = co.gram(place, item * 10, all_, all_, True)
    g = x.astype(int).T @ x.astype(int)
    assert {(i, j): k for i, j, k in zip(a, b, n)} == {(10 * i, 10 * j): g[i, j] for i in range(12) for j in range(i + 1, 12) if g[i, j]}


def test_a_basket_with_a_third_of_all_rows(spark):
    rows = [("x", 0, f"i{i:04d}", 0) for i in range(900)] + [("x", 1 + i // 3, f"i{(i // 3 % 150) * 3 + i % 3:04d}", 0) for i in range(1800)]
    got = co.cooccurrences(spark.createDataFrame(rows, SCHEMA), min_count=3, block_items=100)
    assert {(r["field"], r["item_a"], r["item_b"]): (r["n_a"], r["n_b"], r["m"], r["n_ab"]) for r in got.collect()} == brute(rows, 3)


def test_empty(spark):
    assert co.cooccurrences(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.cooccurrences(spark.createDataFrame([("x", 1, "a", 0), ("x", 1, "b", 0)] * 9, SCHEMA)).count() == 0
