"""Rules that a dictionary must keep, as one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.functions.text import UPOS
from lexframe.operators import graph
from lexframe.operators.index import POOL_LIMIT

HEAD_LIMIT = 65_535  # bytes of a headword
MEDIA_KINDS = ("audio", "image", "video")
COMPRESSIONS = ("none", "zstd")


def _rule(df: DataFrame, name: str, *key: str) -> DataFrame:
    return df.select(F.lit(name).alias("rule"), F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("∅")) for k in key]).alias("key"))


def entry_rules(heads: DataFrame, limit: int = HEAD_LIMIT) -> DataFrame:
    """Empty, repeated and overlong headwords of the live entries."""
    twice = heads.groupBy("pack_id", "headword").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [
        _rule(heads.where(F.coalesce("headword", F.lit("")) == ""), "headword empty", "entry_id"),
        _rule(twice, "headword repeated", "pack_id", "headword"),
        _rule(heads.where(F.octet_length("headword") > limit), "headword too long", "entry_id"),
    ])


def relation_rules(e: DataFrame, heads: DataFrame, hot: list = ()) -> DataFrame:
    """Empty targets, self-references, dangling and repeated edges; a null type is a value like others."""
    twice = e.groupBy("pack_id", "src", "type", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [
        _rule(e.where(F.coalesce("dst", F.lit("")) == ""), "relation without target", "pack_id", "src", "ord"),
        _rule(e.where(F.col("src") == F.col("dst")), "relation to itself", "pack_id", "src", "ord"),
        _rule(graph.dangling(e.where(F.coalesce("dst", F.lit("")) != ""), heads, hot), "relation dangling", "pack_id", "src", "ord"),
        _rule(twice, "relation repeated", "pack_id", "src", "type", "dst"),
    ])


def sense_rules(senses: DataFrame) -> DataFrame:
    """Parts of speech outside the universal ones; null is allowed."""
    return _rule(senses.where(F.col("pos").isNotNull() & ~F.col("pos").isin(*UPOS)), "pos unknown", "entry_id", "ety_ord", "sense_ord")


def media_rules(media: DataFrame) -> DataFrame:
    """Kinds and compressions that aren't known."""
    return _rule(media.where(~F.coalesce(F.col("kind").isin(*MEDIA_KINDS) & F.col("compression").isin(*COMPRESSIONS), F.lit(False))), "media kind or compression", "pack_id", "ord")


def pack_rules(packs: DataFrame) -> DataFrame:
    """Packs (id, name, source_lang) without one of these."""
    return _rule(packs.where(F.greatest(*[(F.coalesce(c, F.lit("")) == "").cast("int") for c in ("id", "name", "source_lang")]) == 1), "pack without id, name or language", "id", "name")


def pron_rules(prons: DataFrame) -> DataFrame:
    """Pronunciations (owner_id, ord, value) without a value."""
    return _rule(prons.where(F.coalesce("value", F.lit("")) == ""), "pronunciation without value", "owner_id", "ord")


def translation_rules(translations: DataFrame, targets: int) -> DataFrame:
    """Translations (owner_id, ord, lang) without a language, in packs of several target languages."""
    return _rule(translations.where(F.coalesce("lang", F.lit("")) == "").where(F.lit(targets > 1)), "translation without language", "owner_id", "ord")


def manifest_rules(man: DataFrame) -> DataFrame:
    """Media manifest rows (kind, hash, compression) with a bad hash, or of a kind and hash that are there twice."""
    bad = _rule(man.where(~F.coalesce(F.col("hash").rlike(r"^[0-9a-fA-F]{40}\z"), F.lit(False))), "media hash", "kind", "hash")
    twice = man.groupBy("kind", F.lower("hash").alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bad.unionByName(_rule(twice, "media repeated", "kind", "hash"))


def pool_rules(pool_rows: DataFrame, limit: int = POOL_LIMIT) -> DataFrame:
    """Pools with more values than an index can number."""
    return _rule(pool_rows.groupBy("pack_id", "pool").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "pool too large", "pack_id", "pool")


def sortedness(numbered: DataFrame) -> DataFrame:
    """Neighbours out of order or equal, per block of numbered rows: must find nothing. Ends of blocks are compared too."""
    nxt = numbered.select("pack_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("fold").alias("_f"), F.col("headword").alias("_h"))
    both = numbered.join(nxt, ["pack_id", "ordinal"])
    return _rule(both.where(F.struct("fold", "headword") >= F.struct(F.col("_f").alias("fold"), F.col("_h").alias("headword"))), "not in order", "pack_id", "ordinal")


def span_fault(value: str, targets: list[dict]) -> str | None:
    """The rule that the targets of one example break, or None: the same rules as ``bad_spans``, for a text at hand."""
    raw, end = value.encode(), 0
    for target in targets:
        if not target.get("spans"):
            return "target without span"
        for s in target["spans"]:
            a, n = s["offset"], s["length"]
            if n <= 0 or a < 0 or a + n > len(raw):
                return "span out of range"
            if any(x < len(raw) and raw[x] & 0xC0 == 0x80 for x in (a, a + n)):
                return "span cuts a character"
            if a < end:
                return "spans overlap"
            end = a + n
    return None


def bad_spans(examples: DataFrame) -> DataFrame:
    """Examples (key, value, targets) with a bad target: key, rule.

    targets: array of structs with an array ``spans`` of (offset, length) in UTF-8 bytes. A target
    has a span; spans have a length, end inside the text, begin and end between code points, and
    neither overlap nor go back, within a target or from one to the next.
    """
    no_span = examples.where(F.exists("targets", lambda t: F.coalesce(F.size(t["spans"]), F.lit(0)) <= 0)).select("key", F.lit("target without span").alias("rule"))
    spans = examples.select("key", "value", F.flatten(F.transform("targets", lambda t: F.coalesce(t["spans"], F.array().cast("array<struct<offset:bigint,length:bigint>>")))).alias("s"))
    size = F.octet_length("value")

    def boundary(at):  # noqa: ANN001, ANN202
        b = F.conv(F.hex(F.substring(F.encode("value", "UTF-8"), (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return (at == size) | (b < 0x80) | (b >= 0xC0)

    bad_end = spans.where(F.exists("s", lambda x: (x["length"] <= 0) | (x["offset"] < 0) | (x["offset"] + x["length"] > size))).select("key", F.lit("span out of range").alias("rule"))
    inside = F.filter("s", lambda x: (x["offset"] >= 0) & (x["length"] > 0) & (x["offset"] + x["length"] <= size))
    cut = spans.where(F.exists(inside, lambda x: ~(boundary(x["offset"]) & boundary(x["offset"] + x["length"])))).select("key", F.lit("span cuts a character").alias("rule"))
    pairs = F.arrays_zip(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))).alias("a"), F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))).alias("b"))
    over = spans.where((F.size("s") > 1) & F.exists(pairs, lambda p: p["b"]["offset"] < p["a"]["offset"] + p["a"]["length"])).select("key", F.lit("spans overlap").alias("rule"))
    return no_span.unionByName(bad_end).unionByName(cut).unionByName(over)
