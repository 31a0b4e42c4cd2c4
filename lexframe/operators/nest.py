"""Nesting rows into documents and reading nested documents in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(*fields: Column | str) -> Column:
    """An array of structs sorted by their first fields, for use in ``agg``."""
    return F.sort_array(F.collect_list(F.struct(*fields)))


def assembled(entries: DataFrame, senses: DataFrame, forms: DataFrame) -> DataFrame:
    """entry_id, headword, senses: entries with their senses and these with their forms, all in order.

    entries: entry_id, headword; senses: entry_id, ety_ord, sense_ord, pos, lemma; forms: entry_id,
    ety_ord, sense_ord, ord, kind, term. Each level is one grouping; absent children are empty arrays.
    """
    keys = ["entry_id", "ety_ord", "sense_ord"]
    f = forms.groupBy(*keys).agg(ordered("ord", "kind", "term").alias("forms"))
    empty = F.array().cast("array<struct<ord:int,kind:string,term:string>>")
    s = senses.join(f, keys, "left").withColumn("forms", F.coalesce("forms", empty))
    s = s.groupBy("entry_id").agg(ordered("ety_ord", "sense_ord", "pos", "lemma", "forms").alias("senses"))
    return entries.join(s, "entry_id", "left").select("entry_id", "headword", F.coalesce("senses", F.array().cast(dict(s.dtypes)["senses"])).alias("senses"))


def with_children(parents: DataFrame, children: DataFrame, name: str, *fields: str) -> DataFrame:
    """``parents`` (raw_id, path, ...) with the array ``name`` of their children (raw_id, parent_path, ordinal, ...) in order; empty without any."""
    below = children.groupBy("raw_id", F.col("parent_path").alias("path")).agg(ordered("ordinal", *fields).alias(name))
    kind = dict(below.dtypes)[name]
    return parents.join(below, ["raw_id", "path"], "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def kept_definitions(definitions: DataFrame, targets: DataFrame, keep: bool) -> DataFrame:
    """``definitions`` (pack_id, value, ...) with their texts blank in packs that have target languages, unless they are kept. targets: pack_id, lang."""
    bilingual = targets.where(F.col("lang").isNotNull()).select("pack_id").distinct().withColumn("_has", F.lit(True))
    out = definitions.join(bilingual, "pack_id", "left")
    return out.withColumn("value", F.when(F.col("_has").isNotNull() & F.lit(not keep), "").otherwise(F.col("value"))).drop("_has")


def has_content(entries: DataFrame, senses: DataFrame) -> DataFrame:
    """Entries with a sense or a redirect."""
    some = senses.select("entry_id").distinct().withColumn("_has", F.lit(True))
    return entries.join(some, "entry_id", "left").where(F.col("_has").isNotNull() | (F.coalesce("see", F.lit("")) != "")).drop("_has")


def in_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` (raw_id, path, ...) with ``place``, a key that sorts paths in document order.

    Steps of a path are letters and positions; positions are padded, so that text order is document order.
    """
    pad = F.array_join(F.transform(F.split("path", "/"), lambda p: F.concat(F.substring(p, 1, 1), F.lpad(F.substring(p, 2, 12), 9, "0"))), "/")
    return nodes.withColumn("place", pad)


def languages(translations: DataFrame) -> DataFrame:
    """raw_id, langs (sorted), labelled (whether languages are to be shown: more than one). Null languages don't count."""
    by = translations.groupBy("raw_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return by.select("raw_id", F.array_join("langs", ",").alias("langs"), (F.size("langs") > 1).alias("labelled"))


def visible_definitions(nodes: DataFrame) -> DataFrame:
    """raw_id, path, visible of every definition and group: it or a definition below it has a text, a note or media."""
    media = F.coalesce(F.size(F.from_json(F.get_json_object("payload", "$.media"), "array<string>")), F.lit(0)) > 0
    own = nodes.where(F.col("kind").isin("definition", "note")).where((F.col("kind") == "note") | (F.coalesce(F.get_json_object("payload", "$.value"), F.lit("")) != "") | media)
    steps = F.split("path", "/")
    up = own.select("raw_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("path")).distinct()
    defs = nodes.where(F.col("kind").isin("definition", "group")).select("raw_id", "path")
    return defs.join(up.withColumn("_v", F.lit(True)), ["raw_id", "path"], "left").select("raw_id", "path", F.col("_v").isNotNull().alias("visible"))
