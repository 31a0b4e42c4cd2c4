"""The graph of relations and redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.operators.skew import repeated, salts_for

SYMMETRIC = ("syn", "ant")


def edges(relations: DataFrame, heads: DataFrame) -> DataFrame:
    """pack_id, src, type, dst, ord: outgoing edges by headword; relations delivered again count once."""
    once = relations.select("entry_id", "ord", "type", "target").distinct()
    return once.join(heads.select("entry_id", "pack_id", F.col("headword").alias("src")), "entry_id").select("pack_id", "src", "type", F.col("target").alias("dst"), "ord")


def _against(e: DataFrame, heads: DataFrame, how: str, hot: list) -> DataFrame:
    """``e`` joined with the headwords that are its targets; hot: the targets to salt, as many edges share one."""
    h = repeated(heads.select(F.col("pack_id").alias("_p"), F.col("headword").alias("_h")), "_h", hot, "_s")
    on = (F.col("pack_id") == F.col("_p")) & (F.col("dst") == F.col("_h")) & (F.col("_salt") == F.col("_s"))
    return e.withColumn("_salt", salts_for("dst", hot, ["src", "ord"])).join(h, on, how).drop("_salt")


def dangling(e: DataFrame, heads: DataFrame, hot: list = ()) -> DataFrame:
    """Edges whose target is no headword of the pack."""
    return _against(e, heads, "left_anti", hot)


def sanitized(e: DataFrame, heads: DataFrame, hot: list = ()) -> DataFrame:
    """Edges without self-references, dangling and repeated ones; of repeated ones the first stays. A null type is a value."""
    kept = _against(e.where(F.col("src") != F.col("dst")), heads, "left_semi", hot)
    return kept.groupBy("pack_id", "src", "type", "dst").agg(F.min("ord").alias("ord"))


def with_reverse(e: DataFrame) -> DataFrame:
    """``e`` and the missing reverses of its symmetric edges; the added ones come last (authored is false)."""
    back = e.where(F.col("type").isin(*SYMMETRIC)).select("pack_id", F.col("dst").alias("src"), "type", F.col("src").alias("dst")).distinct()
    added = back.join(e.select("pack_id", "src", "type", "dst"), ["pack_id", "src", "type", "dst"], "left_anti")
    return e.select("pack_id", "src", "type", "dst", F.lit(True).alias("authored")).unionByName(added.withColumn("authored", F.lit(False)))


def words_of(heads: DataFrame) -> DataFrame:
    """pack_id, phrase, component: the words of each headword that has several, for packs that declare no components."""
    words = heads.where(F.instr("headword", " ") > 0).select("pack_id", F.col("headword").alias("phrase"), F.explode(F.array_distinct(F.split("headword", " "))).alias("component"))
    return words.where((F.col("component") != "") & (F.col("component") != F.col("phrase")))


def phrase_edges(declared: DataFrame, heads: DataFrame, e: DataFrame) -> DataFrame:
    """Edges ``phrase`` from each component that is a headword to its phrase; those that exist aren't added. declared: pack_id, phrase, component."""
    known = declared.join(heads.select("pack_id", F.col("headword").alias("component")), ["pack_id", "component"], "left_semi")
    new = known.select("pack_id", F.col("component").alias("src"), F.lit("phrase").alias("type"), F.col("phrase").alias("dst")).distinct()
    return new.join(e.where(F.col("type") == "phrase").select("pack_id", "src", "dst"), ["pack_id", "src", "dst"], "left_anti")


def missing_components(declared: DataFrame, heads: DataFrame) -> DataFrame:
    """Declared components that are no headword, which is an error of the source: pack_id, phrase, component."""
    return declared.select("pack_id", "phrase", "component").distinct().join(heads.select("pack_id", F.col("headword").alias("component")), ["pack_id", "component"], "left_anti").select("pack_id", "phrase", "component")


def redirect_chains(redirects: DataFrame, hops: int = 8) -> DataFrame:
    """Where redirects end: pack_id, src, dst, hops.

    A chain stops at a word that redirects nowhere, before a word it has been at, or after ``hops``.
    redirects: pack_id, src, dst with one dst per src.
    """
    step = redirects.select(F.col("pack_id").alias("_p"), F.col("src").alias("_s"), F.col("dst").alias("_d"))
    at = redirects.select("pack_id", "src", "dst", F.lit(1).alias("hops"), F.array("src", "dst").alias("seen"))
    for _ in range(hops - 1):
        on = (F.col("pack_id") == F.col("_p")) & (F.col("dst") == F.col("_s")) & ~F.array_contains("seen", F.col("_d"))
        go = F.col("_d").isNotNull()
        at = at.join(step, on, "left").select(
            "pack_id", "src", F.coalesce("_d", "dst").alias("dst"), (F.col("hops") + go.cast("int")).alias("hops"), F.when(go, F.concat("seen", F.array("_d"))).otherwise(F.col("seen")).alias("seen")
        )
    return at.drop("seen")


def unsettled(redirects: DataFrame, heads: DataFrame) -> DataFrame:
    """Redirects whose source is still a headword with content: a rule that must find nothing. heads: pack_id, headword."""
    return redirects.join(heads.select("pack_id", F.col("headword").alias("src")), ["pack_id", "src"], "left_semi")


def followed(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """One hop along ``see``: pack_id, headword, see, target_id (null where it leads nowhere)."""
    h = heads.select(F.col("pack_id").alias("_p"), F.col("headword").alias("_h"), F.col("entry_id").alias("target_id"))
    hop = entries.where(F.coalesce("see", F.lit("")) != "").join(h, (F.col("pack_id") == F.col("_p")) & (F.col("see") == F.col("_h")), "left")
    return hop.select("pack_id", "headword", "see", "target_id")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
