import random

import pytest
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.operators import crossword, graph, index, lookup, quality, validate


def heads(spark, *words, pack="p"):
    return spark.createDataFrame([(pack, i, w, None, i) for i, w in enumerate(words)], "pack_id string, entry_id bigint, headword string, see string, ord bigint").withColumn("fold", T.fold("headword"))


def test_ordinals_and_front_coding(spark):
    words = [f"hw{i:04d}" for i in range(300)] + ["Apple", "apple", "apply", "banana", "あ", "い", "愛"]
    num = index.ordinals(heads(spark, *words)).select("pack_id", "ordinal", "headword", "fold")
    got = [r["headword"] for r in num.orderBy("ordinal").collect()]
    assert got == sorted(words, key=lambda w: (w.lower().encode(), w.encode()))
    back = index.front_decoded(index.front_coded(num))
    assert [r["headword"] for r in back.orderBy("ordinal").collect()] == got
    first = {r["block"]: (r["first"], r["entries"]) for r in index.directory(num).collect()}
    assert first == {0: ("Apple", 256), 1: (got[256], 51)}
    assert validate.sortedness(num).count() == 0


def test_prefix_pages(spark):
    h = heads(spark, "apple", "Apple", "apply", "banana")
    page = lambda *a: [r["headword"] for r in lookup.prefix(h, *a).collect()]
    assert page("APP") == ["Apple", "apple", "apply"] and page("app", 1, 1) == ["apple"]
    assert page("app", 0, 0) == [] and page("x") == [] and page("", 0, 9) == ["Apple", "apple", "apply", "banana"]
    assert lookup.exact(h, "APPLE").count() == 0


def test_prefix_reaches_the_scan(spark, tmp_path):
    lookup.store_fold(heads(spark, "apple", "banana").drop("fold"), str(tmp_path / "f"), 1)
    plan = lookup.prefix(spark.read.parquet(str(tmp_path / "f")), "AP")._jdf.queryExecution().toString()
    assert "StringStartsWith(fold,ap)" in plan


def test_block_packing(spark):
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate([100, 100, 300, 10, 256])], "pack_id string, ordinal bigint, size int")
    assert [(r["block"], r["at"]) for r in index.packed_blocks(df, 256).orderBy("ordinal").collect()] == [(0, 0), (0, 100), (1, 0), (2, 0), (3, 0)]


@pytest.mark.parametrize("segment", [1, 3, 7, 1000])
def test_blocks_do_not_depend_on_segments(spark, segment):
    rng = random.Random(segment)
    sizes = {p: [rng.choice([0, 0, 1, 5, 20, 99, 100, 130]) for _ in range(n)] for p, n in (("p", 200), ("q", 1), ("r", 40))} | {"z": [0] * 9 + [200] + [0] * 5}
    want = {}
    for p, own in sizes.items():
        block = used = 0
        for i, s in enumerate(own):
            if used and used + s > 100:
                block, used = block + 1, 0
            want[p, i] = (block, used)
            used += s
    df = spark.createDataFrame([(p, i, s) for p, own in sizes.items() for i, s in enumerate(own)], "pack_id string, ordinal bigint, size int")
    assert {(r["pack_id"], r["ordinal"]): (r["block"], r["at"]) for r in index.packed_blocks(df, 100, segment).collect()} == want


def test_pools_by_first_appearance(spark):
    rows = [("p", "tag", v, i) for i, v in enumerate(["exam:IELTS", "level:B2", "exam:IELTS", None, "level:C1"])]
    got = index.pools(spark.createDataFrame(rows, "pack_id string, pool string, value string, at int"))
    assert {r["value"]: r["idx"] for r in got.collect()} == {"exam:IELTS": 1, "level:B2": 2, "level:C1": 3}


def test_postings_are_chunked(spark):
    df = spark.range(0, 200_000).select(F.lit("p").alias("pack_id"), F.lit("k").alias("key"), F.col("id").alias("ordinal"))
    sizes = [len(r["ids"]) for r in index.postings(df, "key").orderBy("chunk").collect()]
    assert sizes == [65_536] * 3 + [200_000 - 3 * 65_536]


def test_graph(spark):
    h = heads(spark, "hello", "world", "hello world", "un known")
    rel = spark.createDataFrame([(0, 0, "see", "world"), (0, 1, "syn", "world"), (1, 0, "syn", "hello"), (0, 2, None, "world"), (0, 3, None, "world"), (0, 4, "syn", "hello"), (0, 5, "ant", "none")], "entry_id bigint, ord int, type string, target string")
    e = graph.edges(rel, h)
    assert graph.dangling(e, h).count() == 1
    sane = graph.sanitized(e, h)
    assert sorted((r["src"], r["type"] or "", r["dst"], r["ord"]) for r in sane.collect()) == [("hello", "", "world", 2), ("hello", "see", "world", 0), ("hello", "syn", "world", 1), ("world", "syn", "hello", 0)]
    closed = graph.with_reverse(sane)
    assert closed.where("NOT authored").count() == 0
    assert sorted((r["src"], r["dst"]) for r in graph.phrase_edges(graph.words_of(h), h, e).collect()) == [("hello", "hello world"), ("world", "hello world")]
    assert sorted(r["component"] for r in graph.missing_components(graph.words_of(h), h).collect()) == ["known", "un"]


def test_redirect_chains(spark):
    rows = [("p", "a", "b"), ("p", "b", "c"), ("p", "x", "y"), ("p", "y", "x")] + [("p", f"n{i}", f"n{i + 1}") for i in range(10)]
    got = {r["src"]: (r["dst"], r["hops"]) for r in graph.redirect_chains(spark.createDataFrame(rows, "pack_id string, src string, dst string")).collect()}
    assert got["a"] == ("c", 2) and got["b"] == ("c", 1) and got["x"] == ("y", 1) and got["n0"] == ("n8", 8)


@pytest.mark.parametrize(
    ("value", "spans", "rules"),
    [
        ("Take care of yourself", [[(0, 13)]], set()), ("Look the word up", [[(0, 4), (13, 2)]], set()), ("He ran and ran.", [[(3, 3)], [(11, 3)]], set()),
        ("ab", [[(0, 3)]], {"span out of range"}), ("ab", [[(0, 0)]], {"span out of range"}), ("abcd", [[(0, 3), (2, 1)]], {"spans overlap"}), ("abcd", [[(2, 1)], [(0, 1)]], {"spans overlap"}),
        ("世界", [[(1, 3)]], {"span cuts a character"}), ("ab", [[]], {"target without span"}),
    ],
)
def test_span_rules(spark, value, spans, rules):
    df = spark.createDataFrame([("k", value, [(s,) for s in spans])], "key string, value string, targets array<struct<spans:array<struct<offset:bigint,length:bigint>>>>")
    assert {r["rule"] for r in validate.bad_spans(df).collect()} == rules


def test_definition_ids(spark):
    s = spark.createDataFrame([(1, 0, 0, "NOUN"), (1, 0, 1, "VERB"), (1, 0, 2, "NOUN"), (1, 1, 0, "NOUN"), (1, 1, 1, None)], "entry_id bigint, ety_ord int, sense_ord int, pos string")
    assert [r["id"] for r in quality.pos_sequence_ids(s).orderBy("ety_ord", "sense_ord").collect()] == ["n.1", "v.1", "n.2", "e2.n.1", "e2.x.1"]
    new = quality.next_ids(spark.createDataFrame([(1, "n", 4)], "entry_id bigint, prefix string, n int"), spark.createDataFrame([(1, "n", 0), (1, "v", 1)], "entry_id bigint, prefix string, at int"))
    assert sorted((r["prefix"], r["n"]) for r in new.collect()) == [("n", 5), ("v", 1)]


def test_crosswords_are_legal(spark):
    words = ["stream", "table", "merge", "lexeme", "sense", "entry", "gloss", "term"]
    df = spark.createDataFrame([(w, w + "?") for w in words], "word string, clue string")
    p = crossword.puzzles(df, 3, 6)
    assert p.groupBy("seed").count().count() == 3
    grid = {}
    for r in crossword.best(p).collect():
        for i, c in enumerate(r["word"]):
            at = (r["x"] + i * (r["direction"] == "A"), r["y"] + i * (r["direction"] == "D"))
            assert min(at) >= 0 and grid.setdefault(at, c) == c
    assert {tuple(r) for r in p.collect()} == {tuple(r) for r in crossword.puzzles(df, 3, 6).collect()}


def test_table_rules(spark):
    rules = lambda df: sorted(r["rule"] for r in df.collect())
    assert rules(validate.pack_rules(spark.createDataFrame([("a", "n", "en"), ("b", "", "en"), (None, "n", "en")], "id string, name string, source_lang string"))) == ["pack without id, name or language"] * 2
    assert rules(validate.pron_rules(spark.createDataFrame([("a", 0, "x"), ("a", 1, None)], "owner_id string, ord int, value string"))) == ["pronunciation without value"]
    tr = spark.createDataFrame([("a", 0, "de"), ("a", 1, None)], "owner_id string, ord int, lang string")
    assert rules(validate.translation_rules(tr, 2)) == ["translation without language"] and rules(validate.translation_rules(tr, 1)) == []
    man = spark.createDataFrame([("audio", "a3" * 20, "none"), ("audio", "A3" * 20, "none"), ("image", "xyz", "none")], "kind string, hash string, compression string")
    assert rules(validate.manifest_rules(man)) == ["media hash", "media repeated"]
    assert rules(validate.entry_rules(heads(spark, "a", "a", ""))) == ["headword empty", "headword repeated"]


def test_crossword_sweep_is_whole(spark):
    words = ["".join(chr(97 + (i * 7 + j * j * 3 + i // 26) % 26) for j in range(4 + i % 3)) for i in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = {r["pool"]: r for r in crossword.sweep(df, restarts=2).collect()}
    assert sorted(rows) == [2, 4, 6, 8, 10, 15, 20, 30, 50, 100, 300] and all(r["seeds"] == 50 for r in rows.values())
    drawn = {}
    for r in crossword.draws(df, 10, 5).collect():
        drawn.setdefault(r["seed"], set()).add(r["word"])
    assert all(len(d) == 10 for d in drawn.values()) and len(set(map(frozenset, drawn.values()))) == 5


def test_restarts_keep_the_best_layout():
    words = ["crane", "acorn", "ocean", "nacre", "rance", "caner"]
    tries = [crossword.layout(words, 3, 6, n) for n in range(30)]
    assert len(crossword.generate(words, 3, 6)) == max(map(len, tries)) and crossword.generate([], 3, 6) == []
