"""Data-quality reports, stable definition ids, frequency tags, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions.text import POS_LABELS, mapped


def report(heads: DataFrame, senses: DataFrame, forms: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per pack: headwords, senses, senses without pos, forms, tags."""
    own = heads.select("entry_id", "pack_id")
    count = lambda df, name, cond=None: df.join(own, "entry_id").groupBy("pack_id").agg(F.count(F.when(cond, 1) if cond is not None else F.lit(1)).alias(name))
    out = heads.groupBy("pack_id").agg(F.count(F.lit(1)).alias("headwords"))
    for part in (count(senses, "senses"), count(senses, "no_pos", F.coalesce("pos", F.lit("")) == ""), count(forms, "forms"), count(tags, "tags")):
        out = out.join(part, "pack_id", "left")
    return out.na.fill(0)


def repeated_forms(forms: DataFrame) -> DataFrame:
    """entry_id, term, n: terms that an entry has more than once."""
    return forms.where(F.col("term").isNotNull()).groupBy("entry_id", "term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def nested_report(nodes: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: definitions, those with an id, examples, those without translation and without target. nodes: raw_id, path, parent_path, kind, payload; packs: raw_id, pack_id."""
    translated = nodes.where("kind = 'translation'").select("raw_id", F.col("parent_path").alias("path")).distinct().withColumn("_t", F.lit(True))
    own = nodes.where(F.col("kind").isin("definition", "example")).join(translated, ["raw_id", "path"], "left").join(packs, "raw_id")
    definition, example = F.col("kind") == "definition", F.col("kind") == "example"
    targets = F.coalesce(F.size(F.from_json(F.get_json_object("payload", "$.targets"), "array<string>")), F.lit(0))
    every = nodes.select("raw_id").distinct().join(packs, "raw_id").select("pack_id").distinct()
    by = own.groupBy("pack_id").agg(
        F.count_if(definition).alias("definitions"), F.count_if(definition & (F.coalesce(F.get_json_object("payload", "$.id"), F.lit("")) != "")).alias("with_id"),
        F.count_if(example).alias("examples"), F.count_if(example & F.col("_t").isNull()).alias("untranslated"), F.count_if(example & (targets <= 0)).alias("untargeted"),
    )
    return every.join(by, "pack_id", "left").na.fill(0)


def repeated_ids(definitions: DataFrame) -> DataFrame:
    """raw_id, id, n: ids that an entry gives to more than one definition."""
    return definitions.where(F.coalesce("id", F.lit("")) != "").groupBy("raw_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_senses(senses: DataFrame, translations: DataFrame, words: DataFrame, least: int = 2) -> DataFrame:
    """headword, pos, translations, n: senses of a headword and part of speech that have the same translations, ``least`` of them or more. words: raw_id, headword."""
    one = F.concat_ws(":", F.coalesce("lang", F.lit("-")), F.coalesce("value", F.lit("-")))
    said = translations.groupBy("raw_id", F.col("parent_path").alias("path")).agg(F.array_join(F.sort_array(F.collect_list(one)), ",").alias("translations"))
    all_ = senses.select("raw_id", "path", "pos").join(said, ["raw_id", "path"]).join(words.where("headword IS NOT NULL"), "raw_id")
    return all_.groupBy("headword", "pos", "translations").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def pos_sequence_ids(senses: DataFrame) -> DataFrame:
    """entry_id, ety_ord, sense_ord, id: ``pos.n``, numbered per entry, etymology and part of speech; later etymologies lead with ``eN.``."""
    label = mapped(F.upper("pos"), POS_LABELS, F.coalesce(F.lower("pos"), F.lit("x")))
    w = Window.partitionBy("entry_id", "ety_ord", "_l").orderBy("sense_ord")
    head = F.when(F.col("ety_ord") > 0, F.concat(F.lit("e"), (F.col("ety_ord") + 1).cast("string"), F.lit("."))).otherwise("")
    out = senses.withColumn("_l", F.when(F.coalesce("pos", F.lit("")) == "", "x").otherwise(label)).withColumn("_n", F.row_number().over(w))
    return out.select("entry_id", "ety_ord", "sense_ord", F.concat(head, "_l", F.lit("."), F.col("_n").cast("string")).alias("id"))


def next_ids(known: DataFrame, new: DataFrame) -> DataFrame:
    """Ids for new senses that never reuse a number: known and new have entry_id, prefix; known also n, new also at (its order)."""
    top = known.groupBy("entry_id", "prefix").agg(F.max("n").alias("_top"))
    w = Window.partitionBy("entry_id", "prefix").orderBy("at")
    out = new.join(top, ["entry_id", "prefix"], "left").withColumn("n", F.coalesce("_top", F.lit(0)) + F.row_number().over(w))
    return out.drop("_top")


def frequency(tags: DataFrame) -> DataFrame:
    """entry_id, source, rank of tags ``freq:source=rank``; a lower rank is more common."""
    pattern = r"^freq:([^=]+)=(\d+)$"
    hit = tags.where(F.col("tag").rlike(pattern))
    return hit.select("entry_id", F.regexp_extract("tag", pattern, 1).alias("source"), F.regexp_extract("tag", pattern, 2).cast("bigint").alias("rank")).distinct()


def commonest(ranks: DataFrame, n: int) -> DataFrame:
    """The n lowest ranks (a top-k report); ties by entry."""
    return ranks.orderBy("rank", "entry_id", "source").limit(n)


def plain_words(heads: DataFrame, senses: DataFrame, low: int = 4, high: int = 9) -> DataFrame:
    """All plain lower-case words with a sense: headword, entry_id."""
    plain = heads.where(F.col("headword").rlike(r"^[a-z]+\z") & F.length("headword").between(low, high))
    return plain.join(senses.select("entry_id").distinct(), "entry_id", "left_semi").groupBy("headword").agg(F.min("entry_id").alias("entry_id"))


def sample_words(heads: DataFrame, senses: DataFrame, low: int = 4, high: int = 9, n: int = 300, seed: str = "0") -> DataFrame:
    """A random sample of plain lower-case words with a sense: headword, entry_id. The order is a hash with the seed, so it repeats."""
    return plain_words(heads, senses, low, high).orderBy(F.md5(F.concat(F.lit(seed), F.col("headword"))), "headword").limit(n)
