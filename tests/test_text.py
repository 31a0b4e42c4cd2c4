import random

from pyspark.sql import functions as F

from lexframe.functions import text as T


def one(spark, column, **values):
    """The column over a single row of values."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>'}" for k, v in values.items()))
    return df.select(column.alias("x")).collect()[0]["x"]


def each(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def feats_model(s):
    out, cur, i = [], "", 0
    while i < len(s):
        if s[i] == "\\":
            if i + 1 == len(s):
                break
            cur += s[i : i + 2]
            i += 2
        elif s[i] == "|":
            out.append(cur)
            cur = ""
            i += 1
        else:
            cur += s[i]
            i += 1
    return [*out, cur] if cur else out


def test_fold_ignores_context(spark):
    assert each(spark, T.fold("s"), ["ΟΔΟΣ", "İ", "Apple", "", None, "Ё"]) == ["οδοσ", "i̇", "apple", "", None, "ё"]


def test_feats_follow_the_model(spark):
    rng = random.Random(1)
    cases = ["a||b", "|a", "a|", r"a\|b|c", r"a\\|b", "a\\", "a\n", "|", "||"] + ["".join(rng.choice("ab|\\=\n") for _ in range(rng.randrange(12))) for _ in range(1500)]
    cases = [c for c in cases if c]
    assert each(spark, T.feats("s"), cases) == [feats_model(c) for c in cases]
    assert each(spark, T.feats("s"), ["", None]) == [[], []]


def test_inflected(spark):
    assert one(spark, T.inflected("s"), s="make") == ["make", "makes", "makees", "makeed", "maked", "makeing", "makely", "making"]
    assert one(spark, T.inflected("s"), s="Carry")[-2:] == ["carries", "carried"]
    assert one(spark, T.inflected("s"), s="naïve") == ["naïve"]


def test_tags(spark):
    got = {t: (one(spark, T.tag_category("s"), s=t), one(spark, T.tag_value("s"), s=t), one(spark, T.tag_label("s"), s=t), one(spark, T.tag_series("s"), s=t)) for t in ("exam:A-B-1", "plain", ":x")}
    assert got == {"exam:A-B-1": ("exam", "A-B-1", "1", "A-B"), "plain": (None, None, None, None), ":x": ("", "x", "x", "x")}


def test_morphology(spark):
    assert [tuple(m) for m in one(spark, T.morphology("s"), s='[["prefix","un"],["x"],["root","do"]]')] == [("prefix", "un"), ("root", "do")]
    assert [tuple(m) for m in one(spark, T.morphology("s"), s='[{"kind":"root","term":"a"},{"kind":"x"},{"term":"b"}]')] == [("root", "a"), (None, "b")]
    assert [tuple(m) for m in one(spark, T.morphology("s"), s="un + do")] == [("root", "un + do")]
    assert one(spark, T.morphology("s"), s="") == []


def spans(spark, text, word):
    return [tuple(x) for x in one(spark, T.word_spans(F.col("t"), F.col("w")), t=text, w=word)]


def test_word_spans(spark):
    assert spans(spark, "He ran and Ran.", "ran") == [(3, 3), (11, 3)]
    assert spans(spark, "überran ran", "ran") == [(9, 3)]
    assert spans(spark, "İ ran", "ran") == [(3, 3)]  # the fold of the first letter is longer than the letter
    assert spans(spark, "a.b axb", "a.b") == [(0, 3)]
    assert spans(spark, "no", "yes") == [] and spans(spark, "no", "") == [] and spans(spark, None, "a") == []
    assert len(spans(spark, "a " * 20, "a")) == 8


def test_highlight_runs(spark):
    runs = T.highlight_runs(F.col("t"), T.word_spans(F.col("t"), F.col("w")))
    assert [tuple(r) for r in one(spark, runs, t="Ähm ran off", w="ran")] == [("Ähm ", False), ("ran", True), (" off", False)]
    assert [tuple(r) for r in one(spark, runs, t="nothing", w="x")] == [("nothing", False)]


def test_names(spark):
    keys = lambda explain: one(spark, T.pack_key(F.lit("en"), F.col("t"), F.lit(explain)), t=["zh-Hans", "es-ES"])
    assert keys(False) == "lexframe.en-es+zh" and keys(True) == "lexframe.en-en+es+zh"
    assert one(spark, T.pack_file(F.lit("ja"), F.col("t")), t=["es-ES", "fr", "en", "zh-Hans"]) == "dictionary_ja_zh-Hans+en+es-ES+fr"
    assert one(spark, T.media_path(F.lit("audio"), F.col("s"), F.lit("mp3")), s="a3" * 20) == f"media/audio/a3/{'a3' * 20}.mp3"
    assert each(spark, T.block_number(F.col("s")), ["data/00042.zst", "data/x.zst"]) == [42, None]


def test_pronunciations(spark):
    df = spark.createDataFrame([("en", "ipa"), ("en", "ipa_uk"), ("en", "kk"), ("ja", "ipa")], "l string, k string")
    got = [tuple(r) for r in df.select(T.pron_lang(F.col("l"), F.col("k")), T.pron_kind(F.col("l"), F.col("k"))).collect()]
    assert got == [("en-US", "ipa"), ("en-GB", "ipa"), ("en", "kk"), ("ja", "ipa")]


def test_html_and_markup(spark):
    assert one(spark, T.plain_html("s"), s="<a b='c'>&amp;lt;</a> x<br") == "< x"
    assert one(spark, T.glosses("s"), s='<li class="gloss"> a </li><li class="gloss"></li><li class="gloss"><b>b</b></li><li class="gloss">c</li>') == "a\u001fb"
    ruby = "<span><ruby>寿<rt>す</rt></ruby><ruby>司<rt>し</rt></ruby>屋</span>"
    assert one(spark, T.ruby_base("s"), s=ruby) == "寿司屋" and one(spark, T.ruby_reading("s"), s=ruby) == "すし屋"
    assert one(spark, T.strip_markup("s"), s="a\x01b\x02 c\x00\x03") == "ab c\x03"
    assert each(spark, T.link_target("s"), ["@@@LINK= to \r\n", "plain"]) == ["to", None]


def test_offsets_and_deltas(spark):
    assert one(spark, T.utf16_offset(F.col("s"), F.lit(7)), s="aé𐐀b") == 4
    df = spark.createDataFrame([([0, 5, 10, 20],), ([],)], "a array<bigint>").select("a", T.deltas(F.col("a")).alias("d"))
    rows = df.select("a", "d", T.undeltas(F.col("d")).alias("u")).collect()
    assert rows[0]["d"] == [0, 5, 5, 10] and all(r["u"] == r["a"] for r in rows)


def test_times_and_languages(spark):
    assert [str(x) for x in each(spark, T.created_at("s").cast("string"), ["unix:86400", "2024-01-02T03:04:05Z", "soon", None])] == ["1970-01-02 00:00:00", "2024-01-02 03:04:05", "None", "None"]
    df = spark.createDataFrame([(None, None), (None, "zh"), ("ja", "zh")], "o string, e string")
    assert [r[0] for r in df.select(T.inherited_lang(F.col("o"), F.col("e"), F.lit("en"))).collect()] == ["en", "zh", "ja"]
