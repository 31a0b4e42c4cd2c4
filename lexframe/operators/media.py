"""Content-addressed media assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.functions.text import media_path
from lexframe.operators.skew import repeated, salts_for


def manifest(media: DataFrame) -> DataFrame:
    """pack_id, kind, hash, ord, ext, mime, compression, size: one row per (pack, kind, content); of copies the first by ord counts."""
    own = media.withColumn("hash", F.sha1("bytes"))
    first = F.min(F.struct("ord", "ext", "mime", "compression", F.octet_length("bytes").cast("bigint").alias("size"))).alias("_f")
    return own.groupBy("pack_id", "kind", "hash").agg(first).select("pack_id", "kind", "hash", "_f.*")


def paths(man: DataFrame) -> DataFrame:
    """The manifest with the member path of each asset."""
    return man.withColumn("path", media_path(F.col("kind"), F.col("hash"), F.col("ext")))


def totals(man: DataFrame) -> DataFrame:
    """pack_id, assets, bytes."""
    return man.groupBy("pack_id").agg(F.count(F.lit(1)).alias("assets"), F.sum("size").alias("bytes"))


def resolved(refs: DataFrame, man: DataFrame, hot: list = ()) -> DataFrame:
    """References (pack_id, owner_id, ord, kind, hash) with the path of their asset, null where there is none; hex in any case. hot: hashes (lower case) to salt."""
    m = repeated(paths(man).select(F.col("pack_id").alias("_p"), F.col("kind").alias("_k"), F.col("hash").alias("_h"), "path"), "_h", hot, "_s")
    same = (F.col("pack_id") == F.col("_p")) & (F.col("kind") == F.col("_k")) & (F.lower("hash") == F.col("_h")) & (F.col("_salt") == F.col("_s"))
    refs = refs.withColumn("_l", F.lower("hash")).withColumn("_salt", salts_for("_l", hot, ["owner_id", "ord"])).drop("_l")
    return refs.join(m, same, "left").select("pack_id", "owner_id", "ord", "path")
