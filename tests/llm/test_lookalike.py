import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexframe.llm import lookalike as la

SAME = [
    ("ran", "rаn"), ("nu", "ոս"), ("wide", "ｗｉｄｅ"), ("é", "é"), ("zero", "ze​ro﻿"), ("a b", "a b"), ("a b", "a　 b "), ("Bus", "Βuѕ"), ("sans", "𝗌𝖺𝗇𝗌"),
    ("vil", "ⅴⅰⅼ"), ("flu", "ﬂu"), ("人", "⼈"), ("車", "車"), ("タ", "夕"), ("ダ", "夕‌゙"), ("ガ", "ｶﾞ"), ("ё", "ё"), ("한", "한"), ("ά", "ά"), ("go", "ɡо"), ("x-y", "x－y"), ("so­ft", "soft"),
]
APART = [("Ran", "ran"), ("résumé", "resume"), ("x2", "x²"), ("a-b", "ab"), ("a b", "ab"), ("ば", "ぱ"), ("lo", "1o"), ("mi", "ni"), ("ūs", "us"), ("л", "п"), ("σ", "ο"), ("½", "1/2"), ("①", "1"), ("ſ", "s"), ("a-b", "a‐b")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert la.look(a) == la.look(b)


@pytest.mark.parametrize(("a", "b"), APART)
def test_other_look(a, b):
    assert la.look(a) != la.look(b)


@given(st.text())
def test_a_look_is_its_own_look(text):
    once = la.look(text)
    assert la.look(once) == once
    assert la.look(unicodedata.normalize("NFD", text)) == once


def frame(spark, rows):
    return spark.createDataFrame(rows, "field string, scope string, id bigint, text string")


def test_pairs(spark):
    rows = [("f", "p", 1, "ran"), ("f", "p", 2, "rаn"), ("f", "p", 3, "ran"), ("f", "q", 4, "rаn"), ("f", "p", 5, "Ran"), ("f", "p", 6, None), ("f", None, 7, "x"), ("f", "p", 2, "rаn"), ("g", "p", 8, "ran"), ("f", "p", 9, ""), ("f", "p", 10, "​")]
    assert sorted(tuple(r) for r in la.lookalike_pairs(frame(spark, rows)).collect()) == [("f", 1, 2), ("f", 2, 3), ("f", 9, 10)]
    canon = {r["id"]: r["canonical"] for r in la.canonical_texts(frame(spark, rows)).collect()}
    assert canon[2] == "ran" and canon[5] == "Ran" and canon[6] is None and canon[10] == ""


def test_copies_give_no_pairs(spark):
    assert la.lookalike_pairs(frame(spark, [("f", "p", i, "copy") for i in range(2000)])).count() == 0
    assert la.lookalike_pairs(frame(spark, [])).count() == 0
    assert la.lookalike_pairs(frame(spark, [("f", "p", 1, "a" * 200_000), ("f", "p", 2, "а" * 200_000)])).count() == 1


TIDY = [
    ("ze​ro﻿", "zero"), ("ｗｉｄｅ", "wide"), ("e\u0301", "é"), ("rаn", "ran"), ("a  b ", "a b"), ("сор", "сор"), ("русcкий", "русский"),
    ("夕クシー", "タクシー"), ("夕方", "夕方"), ("カ月", "カ月"), ("ɡo", "go"), ("Москва Moscow", "Москва Moscow"),
]


@pytest.mark.parametrize(("text", "form"), TIDY)
def test_tidy(text, form):
    assert la.tidy(text) == form


@given(st.text(alphabet=st.sampled_from(list("aсоeрxнжタ夕クー力ɡ ​́１ﬁ한κĸʼ-İ"))))
def test_tidy_keeps_the_look(text):
    assert la.look(la.tidy(text)) == la.look(text) and la.tidy(la.tidy(text)) == la.tidy(text)


def test_one_form_over_the_whole_column(spark):
    rows = [("f", "p", 1, "ran"), ("f", "q", 2, "rаn"), ("g", "q", 3, "rаn​"), ("f", None, 4, "lo​ne"), ("f", "r", 5, "сор"), ("f", "r", 6, "x​"), ("f", "s", 7, "x­")]
    canon = {r["id"]: r["canonical"] for r in la.canonical_texts(frame(spark, rows)).collect()}
    assert canon == {1: "ran", 2: "ran", 3: "ran", 4: "lone", 5: "сор", 6: "x", 7: "x"}
