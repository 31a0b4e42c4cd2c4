import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexframe.llm import packing as pk
from lexframe.llm import tokens


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=150, deadline=None)
def test_a_packing_keeps_all_items(sizes):
    bins = pk.best_two_fit(sizes, 40)
    assert sorted(x for b in bins for x in b) == sorted(sizes)
    assert all(b and sum(b) <= 40 for b in bins)
    gaps = [40 - sum(b) for b in bins]
    for i, b in enumerate(bins):  # nothing packed later would have fitted
        later = [x for c in bins[i + 1 :] for x in c]
        assert all(x > gaps[i] for x in later)


def test_two_items_replace_the_smallest():
    assert pk.best_two_fit([6, 4, 3, 3], 12) == [[6, 3, 3], [4]]


def test_best_two_is_the_best():
    rng = random.Random(2)
    for _ in range(300):
        sizes = sorted({rng.randrange(1, 60) for _ in range(rng.randrange(1, 9))})
        count = {s: rng.randrange(1, 3) for s in sizes}
        room, over = rng.randrange(5, 90), rng.randrange(0, 30)
        sums = [a + b for i, a in enumerate(sizes) for b in sizes[i:] if (a != b or count[a] > 1) and over < a + b <= room]
        got = pk._best_two(sizes, count, room, over)
        assert (sum(got) if got else None) == (max(sums) if sums else None)


def test_every_text_in_every_capacity(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, rng.randrange(1, 50), rng.randrange(1, 900)]), "x") for i in range(3000)] + [(3000, None, "x")]
    df = spark.createDataFrame(sizes, "row_id bigint, tokens bigint, extra string")
    caps = spark.createDataFrame([(1, 64), (2, 500), (2, 500), (3, None), (4, 0)], "capacity_id int, max_tokens int")
    rows = pk.packed(df, caps, 3000, pool=700).collect()
    for cap_id, cap in ((1, 64), (2, 500)):
        own = [r for r in rows if r["capacity_id"] == cap_id]
        by_row, by_bin = {}, {}
        for r in own:
            by_row.setdefault(r["row_id"], []).append(r)
            by_bin.setdefault(r["container"], []).append(r)
        assert set(by_row) == {i for i, t, _ in sizes if t}
        for i, parts in by_row.items():
            parts.sort(key=lambda r: r["piece"])
            t = sizes[i][1]
            assert [p["piece"] for p in parts] == list(range(-(-t // cap))) and sum(p["tokens"] for p in parts) == t
            assert all(p["tokens"] == cap for p in parts[:-1])
        assert all(sum(r["tokens"] for r in b) == b[0]["fill"] <= cap for b in by_bin.values())
        assert sum(t or 0 for _, t, _ in sizes) / (len(by_bin) * cap) > 0.97
    assert {r["capacity_id"] for r in rows} == {1, 2}


def test_empty(spark):
    caps = spark.createDataFrame([(1, 64)], "capacity_id int, max_tokens int")
    none = spark.createDataFrame([], "row_id bigint, tokens bigint")
    assert pk.packed(none, caps, 0).count() == 0
    assert pk.fill_report(pk.packed(none, caps, 0)).count() == 0


@pytest.mark.parametrize("text", ["Hello world, naïve 日本語 text!\n\n  x", "", "a" * 50_000, " " * 20_000, "é" * 5000])
def test_token_counts_are_those_of_the_tokenizer(spark, text):
    df = spark.createDataFrame([(1, text), (2, None)], "id bigint, text string")
    got = {r["id"]: r["tokens"] for r in tokens.with_token_counts(df, ["id"]).collect()}
    assert got == {1: tokens.count_tokens(text), 2: 0}
    enc = tokens.encoder()
    assert enc.decode(enc.encode_ordinary(text)) == text
