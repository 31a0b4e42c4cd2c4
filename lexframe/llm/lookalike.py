"""Texts that look the same and differ in their characters.

Every text is mapped to its look: invisible characters go, every sort of space becomes one plain
space, width and font variants and letters borrowed from another script become the usual letter of
that shape, and the result is composed. Looks are then grouped in SQL under the accent- and
case-sensitive Unicode collation, each class gets a deterministic canonical member, and the classes
are joined back to the texts. Case, accents, raised digits, hyphens and word limits stay distinct.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.operators.skew import HOT_LIMIT, hot_values, repeated, salts_for
from lexframe.session import stored

# Letters of one shape, as "letter of the usual script: the others". Public knowledge of Unicode.
SHAPES = (
    "a:аɑα b:Ьᖯ c:сϲⲥ d:ԁ e:еҽ g:ɡց h:һհ i:іι j:јϳյ l:ӏ n:ոռ o:оοօⲟ p:рρⲣ q:ԛզ s:ѕ u:սυ v:νѵ w:ԝ x:хχ y:у "
    "A:АΑᎪꓮ B:ВΒᏴꓐ C:СϹᏟꓚⲤ D:Ꭰꓓ E:ЕΕᎬꓰ F:ꓝϜ G:ԌᏀꓖ H:НΗᎻꓧⲎ I:ІΙӀꓲⲒ J:ЈͿᎫꓙ K:КΚᏦꓗⲔ L:ԼᏞꓡ M:МΜᎷꓟⲘ N:ΝꓠⲚ O:ОΟՕꓳⲞ P:РΡᏢꓑⲢ "
    "Q:Ԛ R:Ꭱꓣ S:ЅՏᏚꓢ T:ТΤᎢꓔⲦ U:Սꓴ V:ѴᏙꓦ W:ԜᎳꓪ X:ХΧꓫⲬ Y:УΥҮꓬ Z:ΖᏃꓜ "
    "к:κĸᴋ т:τᴛ в:ʙ н:ʜ м:ᴍ ф:φɸ Г:Γ П:Π Ф:Φ "
    "ト:卜 ハ:八 タ:夕 ロ:口 ニ:二 カ:力 エ:工 オ:才 ノ:丿 ー:一 ヘ:へ ’:ʼ"
)
# Compatibility variants that look as their base; raised, lowered, circled, squared and fraction forms don't.
PLAIN_VARIANTS = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
# Format characters that are seen, and invisible characters outside the format category (fixed values of Unicode).
SEEN_FORMATS = (range(0x600, 0x606), (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD))
UNSEEN = (range(0xFE00, 0xFE10), range(0xE0100, 0xE01F0), range(0x180B, 0x1810), (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0))
_LONG_S = (0x17F, 0x1E9B)
_UNSEEN = {c for r in UNSEEN for c in r}
_SEEN = {c for r in SEEN_FORMATS for c in r}
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u3099\u309a])*")


@cache
def _script(ch: str) -> str:
    """The script of a letter; empty for all else."""
    return re.split("[ -]", unicodedata.name(ch, ""))[0] if ch.isalpha() else ""


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters that look like a letter of another script, from the public table of confusable characters that comes with Spark's ICU.

    The table also joins what has to stay apart here, so a letter is left out where its partner is of
    another case, raised, no letter, or where the class already has a letter of its script (as the
    Greek class of "o" has omicron, sigma stays itself). Empty where the library isn't there.
    """
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()  # noqa: SLF001
    except TypeError:
        return {}
    letters = [c for c in map(chr, range(0x80, 0x30000)) if unicodedata.category(c)[0] == "L"]
    members: dict[str, set[str]] = {}
    base = {other: pair[0] for pair in SHAPES.split() for other in pair[2:]}
    for other, usual in base.items():
        members.setdefault(usual, {_script(usual)}).add(_script(other))
    out: dict[str, str] = {}
    for ch, like in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")):
        if like == "l" and ch.isupper():
            like = "I"
        if ch in base or len(like) != 1 or not like.isalpha() or ch == like or unicodedata.decomposition(ch) or ch.isupper() != like.isupper() or ch.islower() != like.islower():
            continue
        usual = base.get(like, like)
        known = members.setdefault(usual, {_script(usual)})
        if _script(ch) not in known:
            known.add(_script(ch))
            out[ch] = usual
    return out


class _Shapes(dict):
    """The translation table, filled in as code points of decomposed texts turn up; without ``letters`` letters keep their script."""

    def __init__(self, base: dict[str, str], letters: bool) -> None:
        self.base, self.letters = base, letters

    def __missing__(self, cp: int) -> str:
        self[cp] = out = self.shape(cp)
        return out

    def shape(self, cp: int) -> str:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if cp in _UNSEEN or (kind == "Cf" and cp not in _SEEN):
            return ""
        if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
            return " "
        if kind == "Cc":
            return ""
        if ch in self.base and (self.letters or not ch.isalpha() or kind == "Lm" and ch not in "ー"):
            return self.base[ch]
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if tag in PLAIN_VARIANTS and cp not in _LONG_S and not rest.startswith("0020 "):
            return "".join(self.shape(ord(c)) for part in rest.split() for c in unicodedata.normalize("NFD", chr(int(part, 16))))
        return ch


class Looks:
    """Looks and tidy forms of texts; ``more``: further letters of one shape (of ``confusables``)."""

    def __init__(self, more: dict[str, str] | None = None) -> None:
        self.base = {**(more or {}), **{other: pair[0] for pair in SHAPES.split() for other in pair[2:]}}
        self.table, self.same_script = _Shapes(self.base, True), _Shapes(self.base, False)
        groups: dict[str, str] = {}
        for other, usual in self.base.items():
            groups[usual] = groups.get(usual, usual) + other
        self.groups = {c: g for g in groups.values() for c in g}

    def look(self, text: str) -> str:
        """The look of a text: equal for texts that look the same, and a text of that look itself."""
        if text.isascii() and text.isprintable():
            return _one_space(text)
        return _one_space(unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(self.table)))

    def tidy(self, text: str) -> str:
        """The text without invisible characters, odd spaces, variants and letters borrowed from another script.

        It keeps its look. Words wholly in one script stay in it, so that a Cyrillic word doesn't become a half Latin one.
        """
        if text.isascii() and text.isprintable():
            return _one_space(text)
        out = _WORD.sub(self._one_script, unicodedata.normalize("NFD", text).translate(self.same_script))
        out = unicodedata.normalize("NFC", out)
        return _one_space(out) if self.look(out) == self.look(text) else self.look(text)

    def _in_script(self, word: str, script: str) -> str | None:
        """The word in letters of one script; None if a letter has no shape there."""
        out = []
        for ch in word:
            of = _script(ch)
            if script == "LATIN" and ch in self.base and _script(self.base[ch]) == script:
                ch = self.base[ch]
            elif of not in ("", script):
                ch = next((c for c in self.groups.get(ch, "") if _script(c) == script), "")
                if not ch:
                    return None
            out.append(ch)
        return "".join(out)

    def _one_script(self, m: re.Match) -> str:
        """A word in the one script that its letters allow, the one of most letters first; other words stay."""
        word = m[0]
        if word.isascii():
            return word
        count = Counter(s for s in map(_script, word) if s)
        if len(count) < 2:
            return (self._in_script(word, "LATIN") or word) if "LATIN" in count else word
        for script in sorted(count, key=lambda s: (-count[s], s != "LATIN", s)):
            # Han and kana stand together in Japanese; only among more katakana is a sign that looks like one meant as one.
            if script != "CJK" and not (script == "KATAKANA" and count[script] <= count["CJK"]) and (out := self._in_script(word, script)) is not None:
                return out
        return word


def _one_space(out: str) -> str:
    return out if "  " not in out and out[:1] != " " and out[-1:] != " " else " ".join(filter(None, out.split(" ")))


_plain = Looks()
look, tidy = _plain.look, _plain.tidy


def applied(text: str, of: Callable[[str], str]) -> Column:
    """``of`` each text of a column; a text of printable ASCII with single spaces is its own look and doesn't leave the JVM."""
    c = F.col(text)
    odd = F.when(c.rlike(r"[^\x20-\x7e]|  |^ | \z"), c)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of, na_action="ignore")

    return F.coalesce(F.pandas_udf(run, T.StringType())(odd), c)


def _mapped(texts: DataFrame) -> tuple[DataFrame, list]:
    """field, scope, id, text, mapped of the texts that aren't null, and the looks that hold more than a 256th of them."""
    looks = Looks(confusables(texts.sparkSession))
    seen = Observation()
    own = texts.where(F.col("text").isNotNull()).select("field", "scope", "id", "text", applied("text", looks.look).alias("mapped"))
    table = stored(own.observe(seen, F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(mapped, {HOT_LIMIT}, {HOT_LIMIT * 40})").alias("top")))
    m = seen.get
    return table, [x["item"] for x in m.get("top") or [] if x["count"] * HOT_LIMIT > m["n"]]


_CLASSES = """SELECT field, scope, mapped COLLATE UNICODE AS look, min(struct(text <> mapped AS untidy, text)).text AS canonical, count(DISTINCT text) AS variants
FROM {mapped} GROUP BY field, scope, mapped COLLATE UNICODE HAVING min(text) <> max(text)"""


def classes(texts: DataFrame) -> DataFrame:
    """Classes of texts that look the same within a scope and differ in their characters.

    texts: field, scope, id, text. Null texts belong to no class. Result: field, scope, look
    (collated), canonical (the member that is its own look if there is one, else the least by
    UTF-8 bytes) and variants (number of different texts, at least 2). A class of one text, however
    often it is repeated, is left out.
    """
    return texts.sparkSession.sql(_CLASSES, mapped=_mapped(texts)[0])


def members(texts: DataFrame) -> DataFrame:
    """The texts of all classes joined back: field, scope, id, text, canonical; rows delivered again once."""
    mapped, hot = _mapped(texts)
    spark = texts.sparkSession
    mapped = mapped.withColumn("hot", _hot_only(hot))
    named = spark.sql(_CLASSES.replace("AS variants", "AS variants, min(hot) AS hot"), mapped=mapped)
    return spark.sql(
        """SELECT DISTINCT t.field, t.scope, CAST(c.canonical AS STRING) AS canonical, t.id, t.text
           FROM {mapped} t JOIN {classes} c ON t.field = c.field AND t.scope = c.scope AND t.mapped COLLATE UNICODE = c.look AND t.salt = c.salt""",
        mapped=mapped.withColumn("salt", salts_for("mapped", hot, ["id"])),
        classes=repeated(named, "hot", hot, "salt"),
    )


def _hot_only(hot: list) -> Column:
    """The look if it is a hot one: a class is repeated for the salts if any of its looks is."""
    return F.when(F.col("mapped").isin(hot), F.col("mapped")) if hot else F.lit(None).cast("string")


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """field, id_a < id_b: ids of one scope whose texts differ and look the same.

    Only different texts of a class meet; their ids are put in afterwards, so copies of one text never meet each other.
    """
    m = stored(members(texts))
    hot = hot_values(m, ["text"])["text"]
    key = ["field", "scope", "canonical"]
    t = m.select(*key, "text").distinct()
    met = t.withColumnRenamed("text", "text_a").join(t.withColumnRenamed("text", "text_b"), key).where(F.col("text_a") < F.col("text_b"))
    a = m.select(*key, F.col("text").alias("text_a"), F.col("id").alias("a")).withColumn("salt", salts_for("text_a", hot, ["a"]))
    b = m.select(*key, F.col("text").alias("text_b"), F.col("id").alias("b")).withColumn("salt", salts_for("text_b", hot, ["b"]))
    out = repeated(met, "text_a", hot, "salt").join(a, [*key, "text_a", "salt"]).drop("salt", "text_a")
    out = repeated(out, "text_b", hot, "salt").join(b, [*key, "text_b", "salt"])
    return out.where(F.col("a") != F.col("b")).select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def changed_texts(texts: DataFrame) -> DataFrame:
    """text, canonical: the texts that are not the one form of their look over all of ``texts``.

    Field and scope play no part. The form is the tidied member that is its own look if there is
    one, else the least by UTF-8 bytes; so it is tidy also where no member is, or only one text has the look.
    """
    spark = texts.sparkSession
    looks = Looks(confusables(spark))
    known = texts.where(F.col("text").isNotNull()).select("text").distinct().select("text", applied("text", looks.look).alias("mapped"), applied("text", looks.tidy).alias("tidied"))
    known = stored(known)
    hot = hot_values(known, ["mapped"])["mapped"]
    known = known.withColumn("hot", _hot_only(hot))
    named = spark.sql(
        """SELECT mapped COLLATE UNICODE AS look, min(struct(tidied <> mapped AS borrowed, tidied)).tidied AS canonical, min(hot) AS hot
           FROM {known} GROUP BY mapped COLLATE UNICODE HAVING min(text) <> max(text) OR min(text) <> min(struct(tidied <> mapped AS borrowed, tidied)).tidied""",
        known=known,
    )
    return spark.sql(
        """SELECT t.text AS text, CAST(c.canonical AS STRING) AS canonical FROM {known} t JOIN {classes} c ON t.mapped COLLATE UNICODE = c.look AND t.salt = c.salt
           WHERE t.text <> c.canonical""",
        known=known.withColumn("salt", salts_for("mapped", hot, ["text"])),
        classes=repeated(named, "hot", hot, "salt"),
    )


def canonical_texts(texts: DataFrame) -> DataFrame:
    """``texts`` with the column ``canonical``: the one form of its look over all of ``texts``."""
    out = texts.join(changed_texts(texts).withColumnRenamed("canonical", "_canonical"), "text", "left")
    return out.select(*texts.columns, F.coalesce("_canonical", "text").alias("canonical"))
