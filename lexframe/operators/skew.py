"""Salting of hot join keys.

``hot_values`` lists the values that hold more than ``1/limit`` of all rows; there are at most
``limit`` of them whatever the size of the table, which is the bound that lets them into the plan
as literals. ``salts_for`` then spreads the rows of these values over ``salts`` sub-keys and
``repeated`` repeats only the matching rows of the other side, so no task receives a hot key whole
and a join on the keys and the salt gives exactly the rows of the unsalted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_LIMIT = 256
SALTS = 256


def hot_values(df: DataFrame, columns: list[str], limit: int = HOT_LIMIT) -> dict[str, list]:
    """For each of ``columns``, its values with about more than ``1/limit`` of the rows; at most ``limit``.

    One aggregation with bounded frequent-item sketches, whatever the number of distinct values; the
    counts are approximate, which costs nothing in exactness, as any value may be salted. Nulls are
    never hot (they join nothing); an empty table has no hot value.
    """
    top = [F.expr(f"approx_top_k(`{c}`, {limit}, {limit * 40})").alias(f"_{n}") for n, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *top).collect()[0]
    return {c: sorted(x["item"] for x in row[f"_{n}"] or [] if x["item"] is not None and x["count"] * limit > row["_rows"]) for n, c in enumerate(columns)}


def hot_counts(counts: DataFrame, value: str, n: str, limit: int = HOT_LIMIT) -> list:
    """The values that hold more than ``1/limit`` of all rows, from exact counts (one row a value); at most ``limit``."""
    total = counts.agg(F.sum(n).alias("_all")).collect()[0]["_all"] or 0
    return sorted(r[value] for r in counts.where(F.col(n) * limit > total).select(value).collect() if r[value] is not None)


def salts_for(column: str, hot: list, spread: list[str], salts: int = SALTS) -> Column:
    """The salt of a row on the side with hot keys: a hash of ``spread`` if it is hot, otherwise 0."""
    return F.when(F.col(column).isin(hot), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int") if hot else F.lit(0)


def repeated(df: DataFrame, column: str, hot: list, name: str, salts: int = SALTS) -> DataFrame:
    """``df`` with the salt column ``name``: hot rows once per salt, others once with 0."""
    if not hot:
        return df.withColumn(name, F.lit(0))
    last = F.when(F.col(column).isin(hot), F.lit(salts - 1)).otherwise(F.lit(0))
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), last)))
