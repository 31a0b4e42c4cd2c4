"""References to records that do not exist.

``orphan_references`` checks composite references with partial nulls: references are grouped by
which key columns are null (the null mask), each mask is anti-joined on its non-null columns, and
the declared match semantics (SQL's SIMPLE, PARTIAL, FULL) decide what a null means.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.operators.skew import hot_values, repeated, salts_for

MATCHES = ("simple", "partial", "full")


def target_states(targets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per target key: ``live_from``, the earliest arrival of a row that isn't deleted.

    ``targets`` has the key columns, ``deleted`` (boolean) and ``arrived``. Rows delivered again
    fold into the same minimum. A key whose rows are all deleted has a null ``live_from``.
    """
    return targets.groupBy(*keys).agg(F.min(F.when(~F.coalesce("deleted", F.lit(False)), F.col("arrived"))).alias("live_from"), F.lit(True).alias("known"))


def orphan_references(
    refs: DataFrame, targets: DataFrame, keys: list[str], ids: list[str], skewed: str, hot: list, match: str = "simple"
) -> DataFrame:
    """Unresolved references: the columns ``ids``, ``ref_date`` and ``reason``, one row per reference.

    refs: ``ids`` (what names a reference), ``keys``, ``ref_date``; rows with equal ``ids`` are
    deliveries of one reference, dated by the earliest. targets: ``keys``, ``deleted``, ``arrived``.
    skewed: the key column that may hold hot values. hot: those values (of ``hot_values``); they are salted.

    reason: ``missing`` (no target row), ``deleted`` (all target rows deleted), ``late`` (the first
    live row arrived after the reference).

    Nulls in ``keys``, by ``match``: ``simple``: a reference with any null is not checked.
    ``partial``: the non-null columns must match some target; all null is not checked.
    ``full``: all null is not checked, a mixture is ``missing``. A null ``ref_date`` is never late.
    Empty refs give no rows; empty targets make every checked reference ``missing``. Other columns
    of either side are ignored, whatever their names.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    refs, targets = refs.select(*ids, *keys, "ref_date"), targets.select(*keys, "deleted", "arrived")
    parts = []
    for mask in product((False, True), repeat=len(keys)) if match == "partial" else [(False,) * len(keys)]:  # True: this column is null
        present = [k for k, null in zip(keys, mask) if not null]
        if present:
            same_mask = reduce(and_, [F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(keys, mask)])
            parts.append(_anti(refs.where(same_mask), targets, present, ids, skewed, hot))
    if match == "full":  # every mask with some null and some not is a violation by itself
        some, every = (reduce(op, [F.col(k).isNull() for k in keys]) for op in (or_, and_))
        parts.append(refs.where(some & ~every).select(*ids, "ref_date", F.lit("missing").alias("reason")))
    found = reduce(DataFrame.unionByName, parts)
    # Deliveries of one reference: if any is unresolved, the earliest is, so a minimum over orphans dates it.
    first = found.groupBy(*ids).agg(F.min(F.struct("ref_date", "reason")).alias("_f"))
    return first.select(*ids, "_f.ref_date", "_f.reason")


def _anti(group: DataFrame, targets: DataFrame, present: list[str], ids: list[str], skewed: str, hot: list) -> DataFrame:
    """References whose non-null columns match no live target of their time, with the reason."""
    hot = hot if skewed in present else []
    states = target_states(targets, present).select(*[F.col(k).alias(f"_t_{k}") for k in present], "live_from", "known")
    right = repeated(states, f"_t_{skewed}", hot, "_t_salt")
    left = group.withColumn("_salt", salts_for(skewed, hot, ids))
    same = [F.col(k) == F.col(f"_t_{k}") for k in present] + ([F.col("_salt") == F.col("_t_salt")] if hot else [])
    on_time = F.col("live_from").isNotNull() & (F.col("ref_date").isNull() | (F.col("live_from") <= F.col("ref_date")))
    orphans = left.join(right, [*same, on_time], "left_anti")
    why = F.when(F.col("known").isNull(), "missing").when(F.col("live_from").isNull(), "deleted").otherwise("late")
    return orphans.join(right, same, "left").select(*ids, "ref_date", why.alias("reason"))


def with_owner_pack(refs: DataFrame, entries: DataFrame, ids: list[str], hot: list) -> DataFrame:
    """``refs`` with the ``pack_id`` of the entry named by ``entry_id`` (null if there is none).

    Entries delivered again count once. hot: the values of ``entry_id`` to salt.
    """
    owners = entries.where(F.col("entry_id").isNotNull()).groupBy(F.col("entry_id").alias("_owner")).agg(F.min("pack_id").alias("pack_id"))
    right = repeated(owners, "_owner", hot, "_t_salt")
    same = [F.col("entry_id") == F.col("_owner")] + ([F.col("_salt") == F.col("_t_salt")] if hot else [])
    return refs.withColumn("_salt", salts_for("entry_id", hot, ids)).join(right, same, "left").drop("_owner", "_salt", "_t_salt")


def lexical_orphans(entries: DataFrame, relations: DataFrame, media_refs: DataFrame, media: DataFrame) -> DataFrame:
    """Orphans of the dictionary tables: ref_table, owner_id, ord, reason, period (``YYYY-MM``).

    Relations and ``see`` redirects name a headword of the same pack, media references an asset of
    the same pack and kind by SHA-1 (hex in any letter case). Null relation targets, null or empty
    redirects and null hashes are no references. Match is FULL: a reference whose owner entry (and
    so its pack) is unknown is ``missing``.
    """
    ids = ["ref_table", "owner_id", "ord"]
    rel = relations.where(F.col("target").isNotNull()).select(
        F.lit("relations").alias("ref_table"), F.col("entry_id").cast("string").alias("owner_id"), "ord", "entry_id", F.col("target").alias("headword"), F.col("loaded_at").alias("ref_date")
    )
    hot = hot_values(relations, ["entry_id", "target"])
    hot["target"] = sorted({*hot["target"], *hot_values(entries.where(F.coalesce("see", F.lit("")) != ""), ["see"])["see"]})  # both are joined together
    rel = with_owner_pack(rel, entries, ids, hot["entry_id"]).select(*ids, "pack_id", "headword", "ref_date")
    see = entries.where(F.coalesce("see", F.lit("")) != "").select(
        F.lit("entries").alias("ref_table"), F.col("entry_id").cast("string").alias("owner_id"), F.lit(0).alias("ord"), "pack_id", F.col("see").alias("headword"), F.col("loaded_at").alias("ref_date")
    )
    heads = entries.select("pack_id", "headword", F.col("deleted_at").isNotNull().alias("deleted"), F.col("loaded_at").alias("arrived"))
    assets = media.select("pack_id", "kind", F.sha1("bytes").alias("hash"), F.col("deleted_at").isNotNull().alias("deleted"), F.col("loaded_at").alias("arrived"))
    att = media_refs.where(F.col("hash").isNotNull()).select(
        F.lit("media_refs").alias("ref_table"), "owner_id", "ord", F.substring_index("owner_id", "/", 1).try_cast("bigint").alias("entry_id"), "kind", F.lower("hash").alias("hash"), F.col("loaded_at").alias("ref_date")
    )
    hot_att = hot_values(att, ["entry_id", "hash"])
    att = with_owner_pack(att, entries, ids, hot_att["entry_id"]).select(*ids, "pack_id", "kind", "hash", "ref_date")
    found = orphan_references(rel.unionByName(see), heads, ["pack_id", "headword"], ids, "headword", hot["target"], "full").unionByName(
        orphan_references(att, assets, ["pack_id", "kind", "hash"], ids, "hash", hot_att["hash"], "full")
    )
    return found.select(*ids, "reason", F.substring(F.col("ref_date").cast("string"), 1, 7).alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of unresolved references per table, month and reason, with each table's running total."""
    by = orphans.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("ref_table", "reason").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumn("running", F.sum("n").over(running))
