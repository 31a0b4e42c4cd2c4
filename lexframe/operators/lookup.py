"""Exact, batched, prefix and cross-pack look-up of headwords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import text as T

SHELF_LIMIT = 200  # hits of one pack, and of the whole shelf, in a cross-pack search


def exact(heads: DataFrame, word: str) -> DataFrame:
    """Entries of exactly this headword; none is an empty result."""
    return heads.where(F.col("headword") == word)


def bulk(needles: DataFrame, heads: DataFrame) -> DataFrame:
    """``needles`` (pack_id, word) with ``entry_id``, null where no entry has the word. Small needles are broadcast by the optimizer."""
    found = heads.select(F.col("pack_id").alias("_p"), F.col("headword").alias("_h"), "entry_id")
    return needles.join(found, (F.col("pack_id") == F.col("_p")) & (F.col("word") == F.col("_h")), "left").drop("_p", "_h")


def prefix(heads: DataFrame, text: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of the entries whose fold starts with the fold of ``text``, ordered by (fold, headword).

    ``heads`` has ``fold`` stored, so the filter reaches the scan. An empty text matches all; a limit
    of 0 or less gives nothing.
    """
    key = "".join(c if len(c.lower()) == 0 else "".join(x.lower() for x in c) for c in text)
    hits = heads.where(F.col("fold").startswith(F.lit(key)))
    return hits.orderBy("fold", "headword").offset(max(skip, 0)).limit(max(limit, 0))


def page(heads: DataFrame, text: str, size: int = 200) -> DataFrame:
    """The first ``size`` hits of a prefix, each with ``more``: whether the page is full, so that a longer one may be asked for."""
    hits = prefix(heads, text, 0, size)
    return hits.withColumn("more", F.count(F.lit(1)).over(Window.partitionBy()) >= size)  # a page is small


def shelf(heads: DataFrame, text: str, pack_order: DataFrame, limit: int = SHELF_LIMIT) -> DataFrame:
    """Prefix hits over all packs: at most ``limit`` of each, in shelf order, ``limit`` in all (a top-k by definition).

    pack_order: pack_id, shelf (one row per pack).
    """
    hits = heads.where(F.col("fold").startswith("".join(x.lower() for x in text))).join(pack_order, "pack_id")
    w = Window.partitionBy("pack_id").orderBy("fold", "headword")
    return hits.withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= limit).orderBy("shelf", "fold", "headword").limit(limit)


def store_fold(entries: DataFrame, path: str, files: int = 8) -> None:
    """Headwords with their stored fold, range-partitioned and sorted, so that prefix filters skip row groups."""
    keyed = entries.withColumn("fold", T.fold("headword"))
    keyed.repartitionByRange(files, "fold", "headword").sortWithinPartitions("fold", "headword").write.mode("overwrite").parquet(path)
