"""Mixing sources to target shares of all tokens.

Each source gets an expected number of copies per document; its whole part is given to every
document and its fraction is rounded by weighted pivotal rounding: two documents with fractional
copies trade tokens at random until one of them is integral, so the tokens of a source never change
and every document keeps its expectation. Documents are dealt to leaves by a hash, each leaf is
rounded by one task and leaves at most one fractional document per source; these residuals are
combined level by level in a distributed tree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.session import checkpointed

LEAF = 20_000
FANOUT = 64
EPS = 1e-9
NO_ID = -(1 << 63)  # stands for a null id inside the operator
SMALL = 10_000  # rows of a table of sources that may be broadcast
_STATE = "source string, node bigint, row_id bigint, tokens bigint, p double, up boolean"


def pivotal(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounded ``p`` (values in [0, 1]) and the index of the one value that stayed fractional, or -1.

    Keeps sum(p * weight) and the expectation of every value.
    """
    p = p.astype(float).copy()
    draws = rng.random(len(p))
    i = -1
    for j in range(len(p)):
        if p[j] <= EPS or p[j] >= 1 - EPS:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        wi, wj = float(weight[i]), float(weight[j])
        up = min((1 - p[i]) * wi, p[j] * wj)  # tokens that may move from j to i
        down = min(p[i] * wi, (1 - p[j]) * wj)  # and from i to j
        moved = up if draws[j] * (up + down) < down else -down
        p[i] += moved / wi
        p[j] -= moved / wj
        open_i, open_j = EPS < p[i] < 1 - EPS, EPS < p[j] < 1 - EPS
        for k, is_open in ((i, open_i), (j, open_j)):
            if not is_open:
                p[k] = round(p[k])
        i = i if open_i else j if open_j else -1
    return p, i


def _node(seed: int, level: int, root: bool):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Longest first: the document that stays fractional, and with it the error of a share, is then a short one.
        pdf = pdf.sort_values(["tokens", "row_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        source, node = pdf["source"].iloc[0], int(pdf["node"].iloc[0])
        rng = np.random.default_rng([seed, level, node, zlib.crc32(source.encode())])
        p, open_ = pivotal(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(), rng)
        up = np.zeros(len(p), bool)
        if open_ >= 0:
            if root:
                p[open_] = float(rng.random() < p[open_])
            else:
                up[open_] = True
        return pdf.assign(p=p, up=up)[[c.split()[0] for c in _STATE.split(", ")]]

    return run


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most SMALL rows; else the optimizer decides."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source: source, target_share, share, max_repeats, documents, tokens, total, copies.

    ``share`` is the target share among the sources that have tokens; ``total`` the size of the mix,
    by default all tokens of these sources; ``copies`` the expected copies of each document, at most
    ``max_repeats``: a source that would need more falls short of its share, and the mix of ``total``. Targets with a null
    source or share count as absent, repeated ones once.
    """
    by = sizes.where(F.col("tokens") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).select("source", "target_share", "max_repeats").distinct()
    p = wanted.join(by, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    p = checkpointed(p)  # as many rows as there are targets
    live = p.where(F.col("available") > 0)
    share: Column = F.when(F.col("available") > 0, F.col("target_share") / live.agg(F.sum("target_share")).scalar()).otherwise(0.0)
    p = p.withColumn("share", share)
    if total_tokens is None:
        most = live.agg(F.sum("available").cast("double")).scalar()
    else:
        most = F.lit(float(total_tokens))
    copies = F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("double"), F.col("total") * F.col("share") / F.col("available"))).otherwise(0.0)
    return p.withColumn("total", most).withColumn("copies", copies)


def mixed(sizes: DataFrame, planned: DataFrame, rows: int, seed: int = 0, leaf: int = LEAF) -> DataFrame:
    """row_id, source, tokens, repeats (at least 1) of the chosen documents.

    sizes: row_id (bigint), source, tokens, other columns are ignored; rows: about how many. Rows of one id or none are documents of their own. Documents of other sources
    or none, and documents without tokens, are not chosen. The result depends only on the rows and
    the seed, so lost tasks repeat it.
    """
    leaves = max(1, -(-rows // leaf))
    rates = small(planned.where(F.col("copies") > 0).select("source", "copies"))
    start = sizes.where(F.col("tokens") > 0).select(F.coalesce("row_id", F.lit(NO_ID)).alias("row_id"), "source", "tokens").join(rates, "source").withColumn("whole", F.floor(F.col("copies") + EPS))
    state = start.select("source", F.pmod(F.xxhash64("row_id", "tokens"), F.lit(leaves)).alias("node"), "row_id", "tokens", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole")).alias("p"))
    level, done = 0, None
    while True:
        root = leaves == 1
        out = checkpointed(state.groupBy("source", "node").applyInPandas(_node(seed, level, root), _STATE))
        settled = out.where(~F.col("up")).select("source", "row_id", "tokens", "p")
        done = settled if done is None else done.unionByName(settled)
        if root:
            break
        leaves, level = -(-leaves // FANOUT), level + 1
        state = out.where("up").select("source", F.floor(F.col("node") / FANOUT).alias("node"), "row_id", "tokens", "p")
    repeats = (F.floor(F.col("copies") + EPS) + F.col("p")).cast("int")
    return done.join(rates, "source").select(F.nullif("row_id", F.lit(NO_ID)).alias("row_id"), "source", "tokens", repeats.alias("repeats")).where(F.col("repeats") > 0)


def shares(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """source, target_share, share (among the sources there are), max_repeats, chosen, tokens, reached: one row per target."""
    by = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("chosen"), F.sum(F.col("tokens") * F.col("repeats")).alias("used"))
    total = by.agg(F.sum("used")).scalar()
    out = planned.select("source", "target_share", "share", "max_repeats").join(by, "source", "left")
    return out.select(
        "source", "target_share", F.round("share", 9).alias("share"), "max_repeats", F.coalesce("chosen", F.lit(0)).alias("chosen"),
        F.coalesce("used", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("used") / total, F.lit(0.0)), 9).alias("reached"),
    )
