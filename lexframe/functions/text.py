"""Text expressions of the lexical model: Catalyst columns in, Catalyst columns out."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 17 universal parts of speech, their short labels, and the labels of other codes.
UPOS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split()
POS_LABELS = {
    "NOUN": "n", "VERB": "v", "ADJ": "adj", "ADV": "adv", "PRON": "pron", "DET": "det", "ADP": "prep", "NUM": "num", "CCONJ": "conj", "SCONJ": "conj",
    "INTJ": "intj", "PROPN": "n", "AUX": "aux", "PART": "part", "SYM": "sym", "PUNCT": "punct", "X": "x",
}
POS_COLOURS = {
    "NOUN": "64,140,217", "PROPN": "64,140,217", "VERB": "204,89,77", "ADJ": "77,166,115", "ADV": "191,128,51", "PRON": "153,102,191", "DET": "140,140,140",
    "ADP": "140,140,140", "NUM": "166,115,77", "CCONJ": "128,128,153", "SCONJ": "128,128,153", "INTJ": "217,140,38",
}
OTHER_COLOUR = "128,128,128"
LANG_LABELS = {"zh-Hans": "中", "es-ES": "Es", "en": "En", "ja": "日"}
LANG_ALIASES = {"zh": "zh-Hans", "es": "es-ES"}
MORPHEME_LABELS = {"prefix": "Prefix", "suffix": "Suffix", "root": "Root", "combining_form": "Combining form", "combining form": "Combining form", "particle": "Particle", "stem": "Stem"}
RELATION_LABELS = {"SYN": "Synonym", "ANT": "Antonym", "DER": "Derived"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mapped(value: Column, table: dict[str, str], other: Column) -> Column:
    """The entry of a small fixed table, or ``other``."""
    return reduce(lambda acc, kv: acc.when(value == kv[0], kv[1]), list(table.items())[1:], F.when(value == next(iter(table)), table[next(iter(table))])).otherwise(other)


def fold(text: Column | str) -> Column:
    """Lower case by single code points: the sort and prefix key of a headword.

    ``lower`` turns a final capital sigma into its word-final form, which depends on context; only
    texts with that letter take the slower way.
    """
    c = F.col(text) if isinstance(text, str) else text
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.lower(x)), "")
    return F.when(F.instr(c, "Σ") > 0, each).otherwise(F.lower(c))


def none_if_empty(text: Column | str) -> Column:
    """Null for an empty text."""
    return F.nullif(F.col(text) if isinstance(text, str) else text, F.lit(""))


def feats(text: Column | str) -> Column:
    """The segments of ``k=v|k=v``, split at unescaped bars.

    Escapes stay as they are; inner empty segments stay, a last empty one and a last lone backslash go.
    Null and empty texts give an empty array.
    """
    c = F.col(text) if isinstance(text, str) else text
    whole = F.regexp_replace(c, r"(?s)^((?:\\.|[^\\])*)\\\z", "$1")
    parts = F.regexp_extract_all(F.concat(whole, F.lit("|")), F.lit(r"(?s)((?:\\.|[^|\\])*)\|"), F.lit(1))
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(cut)


def tag_category(tag: Column | str) -> Column:
    """What stands before the first colon; null without one."""
    c = F.col(tag) if isinstance(tag, str) else tag
    return F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1))


def tag_value(tag: Column | str) -> Column:
    """What stands after the first colon; null without one."""
    c = F.col(tag) if isinstance(tag, str) else tag
    return F.when(F.instr(c, ":") > 0, F.substring(c, F.instr(c, ":") + 1, F.length(c)))


def tag_label(tag: Column | str) -> Column:
    """The part of the value after its last hyphen, or all of it."""
    return F.substring_index(tag_value(tag), "-", -1)


def tag_series(tag: Column | str) -> Column:
    """The part of the value before its last hyphen, or all of it."""
    v = tag_value(tag)
    return F.when(F.instr(v, "-") > 0, F.substring(v, F.lit(1), F.length(v) - F.length(F.substring_index(v, "-", -1)) - 1)).otherwise(v)


def tag_visible(tag: Column | str) -> Column:
    """Whether a tag is shown: exams only."""
    return F.coalesce(tag_category(tag) == "exam", F.lit(False))


def inflected(word: Column | str) -> Column:
    """A word and its regular English inflections, without repeats; a word that isn't plain ASCII has itself only."""
    c = F.col(word) if isinstance(word, str) else word
    low = F.lower(c)
    ends = lambda s, tail, cut: F.when(low.endswith(s), F.concat(F.substring(low, F.lit(1), F.length(low) - cut), F.lit(tail)))
    all_ = F.array(
        c, *[F.concat(low, F.lit(t)) for t in ("s", "es", "ed", "d", "ing", "ly")], ends("e", "ing", 1), ends("e", "ed", 1),
        F.when(F.length(low) > 1, ends("y", "ies", 1)), F.when(F.length(low) > 1, ends("y", "ied", 1)),
    )
    return F.when(c.rlike(r"^[\x00-\x7F]+\z"), F.array_distinct(F.filter(all_, lambda x: x.isNotNull()))).otherwise(F.array(c))


def morphology(raw: Column | str) -> Column:
    """Morphemes of ``[["kind","term"],...]`` or ``[{"kind":..,"term":..},...]``; any other text is one root."""
    c = F.col(raw) if isinstance(raw, str) else raw
    kind = "array<struct<kind:string,term:string>>"
    pairs = F.from_json(c, "array<array<string>>")
    nested = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].alias("kind"), p[1].alias("term")))
    objects = F.filter(F.from_json(c, kind), lambda m: m["term"].isNotNull())
    return (
        F.when(c.isNull() | (c == ""), F.array().cast(kind))
        .when(c.rlike(r"^\s*\[\s*\["), nested)
        .when(c.rlike(r"^\s*\[\s*\{"), objects)
        .otherwise(F.array(F.struct(F.lit("root").alias("kind"), c.alias("term"))))
    )


def pron_lang(source: Column, kind: Column) -> Column:
    """Language of a pronunciation: the two English alphabets are told apart by kind, others are the source's."""
    return F.when((source == "en") & (kind == "ipa"), "en-US").when((source == "en") & (kind == "ipa_uk"), "en-GB").otherwise(source)


def pron_kind(source: Column, kind: Column) -> Column:
    """The kind, with the regional one made plain."""
    return F.when((source == "en") & (kind == "ipa_uk"), "ipa").otherwise(kind)


def created_at(text: Column | str) -> Column:
    """The time of ``unix:<seconds>`` or of an RFC 3339 text; null for anything else."""
    c = F.col(text) if isinstance(text, str) else text
    seconds = F.regexp_extract(c, r"^unix:(\d{1,18})$", 1)
    return F.when(c.startswith("unix:"), F.timestamp_seconds(F.nullif(seconds, F.lit("")).try_cast("bigint"))).otherwise(c.try_cast("timestamp"))


def inherited_lang(own: Column, enclosing: Column, source: Column) -> Column:
    """Language of a pronunciation: its own, that of the translation around it, or the source's."""
    return F.coalesce(own, enclosing, source)


def long_lang(lang: Column) -> Column:
    """The full tag of a short language code."""
    return mapped(lang, LANG_ALIASES, lang)


def short_lang(lang: Column) -> Column:
    """The short code of a full language tag."""
    return mapped(lang, {v: k for k, v in LANG_ALIASES.items()}, lang)


def pack_key(source: Column, targets: Column, explanatory: Column, prefix: str = "lexframe") -> Column:
    """``prefix.src-t1+t2`` with short codes in order; an explanatory pack names its source first."""
    short = F.array_sort(F.transform(targets, short_lang))
    own = F.concat(F.lit(prefix + "."), source, F.lit("-"))
    named = F.concat(own, source, F.array_join(F.transform(short, lambda t: F.concat(F.lit("+"), t)), ""))
    return F.when(explanatory, named).when(F.size(targets) == 0, F.concat(own, source)).otherwise(F.concat(own, F.array_join(short, "+")))


def pack_file(source: Column, targets: Column) -> Column:
    """``dictionary_src_t1+t2``; zh-Hans comes first, then en and es-ES, then the others as given."""
    rank = lambda t: mapped(t, {"zh-Hans": "0", "en": "1", "es-ES": "2"}, F.lit("9"))
    keyed = F.transform(targets, lambda t, i: F.concat(rank(t), F.format_string("%09d", i), t))
    names = F.transform(F.array_sort(keyed), lambda k: F.substring(k, 11, 1000))
    return F.concat(F.lit("dictionary_"), source, F.when(F.size(targets) > 0, F.concat(F.lit("_"), F.array_join(names, "+"))).otherwise(""))


def plain_html(html: Column | str) -> Column:
    """Text without tags, with the five basic entities replaced in turn (so ``&amp;lt;`` becomes ``<``)."""
    out = F.regexp_replace(html, r"<[^>]*>?", "")
    for entity, c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    return out


def glosses(html: Column | str, most: int = 2) -> Column:
    """The first non-empty glosses of an entry, joined by the unit separator; a top-k by definition."""
    items = F.regexp_extract_all(html, F.lit(r'(?s)<li class="gloss">(.*?)</li>'), F.lit(1))
    texts = F.filter(F.transform(items, lambda x: F.trim(plain_html(x))), lambda x: x != "")
    return F.array_join(F.slice(texts, 1, most), "\u001f")


def ruby_base(html: Column | str) -> Column:
    """The written form of ruby text."""
    return F.regexp_replace(F.regexp_replace(html, r"<ruby>(.*?)<rt>.*?</rt></ruby>", "$1"), r"</?span>", "")


def ruby_reading(html: Column | str) -> Column:
    """The reading of ruby text; text outside ruby is shared."""
    return F.regexp_replace(F.regexp_replace(html, r"<ruby>.*?<rt>(.*?)</rt></ruby>", "$1"), r"</?span>", "")


def strip_markup(text: Column | str) -> Column:
    """Text without inline marks: codes 1 to 9 open and close spans; 0 makes the character after it plain text. Null where the marks are invalid."""
    return F.when(~markup_fault(text), F.regexp_replace(text, r"(?s)\x00(.)|[\x01-\x09]", "$1"))


def markup_fault(text: Column | str) -> Column:
    """Whether the inline marks of a text are invalid: a span that isn't closed, is closed by another mark, or nests; a 0 at the end."""
    bare = F.regexp_replace(text, r"(?s)\x00.", "")
    rest = F.regexp_replace(bare, r"(?s)\x01[^\x00-\x09]*\x02|\x03[^\x00-\x09]*\x04|\x05[^\x00-\x09]*\x06|\x07[^\x00-\x09]*\x08[^\x00-\x09]*\x09", "")
    return rest.rlike(r"[\x00-\x09]")


def link_target(record: Column | str) -> Column:
    """Target of a link record, trimmed; null for other records."""
    c = F.col(record) if isinstance(record, str) else record
    return F.when(c.startswith("@@@LINK="), F.trim(F.regexp_replace(F.substring(c, 9, 1 << 30), r"^\s+|\s+\z", "")))


def media_path(kind: Column, digest: Column, ext: Column) -> Column:
    """``media/kind/hh/hash.ext``."""
    return F.concat(F.lit("media/"), kind, F.lit("/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("."), ext)


def block_path(block: Column) -> Column:
    """``data/NNNNN.zst``."""
    return F.format_string("data/%05d.zst", block)


def block_number(path: Column) -> Column:
    """The number in a block path; null for other paths."""
    return F.nullif(F.regexp_extract(path, r"^data/(\d+)\.zst$", 1), F.lit("")).cast("int")


def byte_slice(text: Column, offset: Column, length: Column) -> Column:
    """The text of a span given in UTF-8 bytes."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), offset + 1, length), "UTF-8")


def utf16_offset(text: Column, offset: Column) -> Column:
    """UTF-16 offset of a UTF-8 byte offset: code points before it, those beyond the basic plane twice."""
    head = byte_slice(text, F.lit(0), offset)
    return F.length(head) + F.length(F.regexp_replace(head, r"[\x{0}-\x{FFFF}]", ""))


def _even(text: str) -> str:
    """Lower case by single code points; a letter whose lower case is longer stands for itself, so that places stay the same."""
    return text.lower() if text.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _hits(text: str, low: str, needle: str, most: int) -> list[tuple[int, int]]:
    """(offset, length) in UTF-8 bytes of the whole-word hits, from left to right without overlaps."""
    out, at, byte, size = [], 0, 0, len(needle)
    p = low.find(needle) if needle else -1
    while p >= 0 and len(out) < most:
        free = lambda c: not (c.isascii() and c.isalnum())
        if (p == 0 or free(low[p - 1])) and (p + size == len(low) or free(low[p + size])):
            byte, at = byte + len(text[at:p].encode()), p
            out.append((byte, len(text[p : p + size].encode())))
        p = low.find(needle, p + size)
    return out


_SPANS = "array<struct<offset:bigint,length:bigint>>"


def word_spans(text: Column, word: Column, most: int = 8) -> Column:
    """Whole-word hits as (offset, length) in UTF-8 bytes of the original text, in order; a top-k by definition.

    Case is folded by single code points, so a hit maps back to the original even where a fold
    changes the length; a word boundary is any place without an ASCII letter or digit beside it.
    The search goes on after a hit, also a rejected one. Empty words and nulls have no hits. One pass over each text.
    """
    return first_form_spans(text, F.array(word), most)


def first_form_spans(text: Column, forms: Column, most: int = 8) -> Column:
    """The hits of the first form that has any, as ``word_spans`` gives them; none if no form has one."""

    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, fs in zip(texts, lists):
            low = _even(t) if t and fs is not None else ""
            found = next((h for f in (fs if low else ()) if f and (h := _hits(t, low, _even(f), most))), [])
            out.append([{"offset": a, "length": n} for a, n in found])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, _SPANS)(text, forms)


def highlight_runs(text: Column, spans: Column) -> Column:
    """Alternating runs of a text as (text, marked): spans in UTF-8 bytes; invalid and overlapping ones are skipped."""
    total = F.octet_length(text).cast("bigint")
    return let(spans, lambda own: _runs(text, own, total))


def _runs(text: Column, spans: Column, total: Column) -> Column:
    good = F.array_sort(F.filter(spans, lambda s: (s["offset"] >= 0) & (s["length"] > 0) & (s["offset"] + s["length"] <= total)))
    kind = "struct<at:bigint,runs:array<struct<offset:bigint,length:bigint,marked:boolean>>>"
    run = lambda a, b, m: F.array(F.struct(a.alias("offset"), (b - a).alias("length"), F.lit(m).alias("marked")))
    step = lambda acc, s: F.when(
        s["offset"] >= acc["at"],
        F.struct(
            (s["offset"] + s["length"]).alias("at"),
            F.concat(acc["runs"], run(acc["at"], s["offset"], False), run(s["offset"], s["offset"] + s["length"], True)).alias("runs"),
        ),
    ).otherwise(acc)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<offset:bigint,length:bigint,marked:boolean>>").alias("runs")).cast(kind)
    walked = F.aggregate(good, start, step)
    whole = let(walked, lambda w: F.concat(w["runs"], run(w["at"], total, False)))
    return F.transform(F.filter(whole, lambda r: r["length"] > 0), lambda r: F.struct(byte_slice(text, r["offset"], r["length"]).alias("text"), r["marked"].alias("marked")))


def deltas(ids: Column) -> Column:
    """Differences of an ascending array, the first against 0."""
    return F.transform(ids, lambda x, i: x - F.when(i > 0, F.element_at(ids, F.greatest(i, F.lit(1)))).otherwise(F.lit(0)))


def undeltas(d: Column) -> Column:
    """Running sums: the inverse of ``deltas``. One pass over each array, in Arrow batches."""

    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: np.cumsum(p, dtype=np.int64), na_action="ignore")

    return F.pandas_udf(run, "array<bigint>")(d)


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading UTF-8 bytes that two texts share; 0 beside a null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0 if p is None or q is None else len(os.path.commonprefix((p.encode(), q.encode()))) for p, q in zip(x, y)], dtype="int32")

    return F.pandas_udf(run, "int")(a, b)
