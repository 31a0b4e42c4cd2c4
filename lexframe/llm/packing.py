"""Filling containers of fixed capacity with texts.

Best-two-fit: a container is filled greedily with the largest text that still fits; when none does,
its smallest text is replaced by the two unpacked texts that fit the gap so widened most tightly.
Texts are dealt to pools by a hash, so that a pool has about ``POOL`` texts whatever the size of the
collection, and each pool and capacity is packed by one task; only the last container of a pool
stays underfilled for want of texts.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOL = 20_000
NO_ID = -(1 << 63)  # stands for a null id inside the operator
_OUT = "capacity_id int, max_tokens bigint, container bigint, fill bigint, row_id bigint, piece int, tokens bigint"


def _best_two(sizes: list[int], count: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """The two unpacked sizes with the largest sum in (over, room]; ``sizes`` ascend."""
    best, found = over, None
    lo, hi = 0, bisect_right(sizes, room - sizes[0]) - 1 if sizes else -1
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        total = a + b
        if total > room or (lo == hi and count[a] < 2):
            hi -= 1
            continue
        if total > best:
            best, found = total, (a, b)
            if total == room:
                break
        lo += 1
    return found


def best_two_fit(items: Iterable[int], capacity: int) -> list[list[int]]:
    """Containers as lists of sizes; every size is in 1..capacity."""
    count: dict[int, int] = {}
    for s in items:
        count[s] = count.get(s, 0) + 1
    sizes = sorted(count)
    bins: list[list[int]] = []

    def take(s: int) -> None:
        count[s] -= 1
        if not count[s]:
            del count[s], sizes[bisect_right(sizes, s) - 1]

    while sizes:
        gap, held = capacity, []
        while sizes and (i := bisect_right(sizes, gap)):
            s = sizes[i - 1]
            n = min(gap // s, count[s])
            for _ in range(n):
                take(s)
            held += [s] * n
            gap -= n * s
        if gap and sizes and (two := _best_two(sizes, count, gap + held[-1], held[-1])):
            small = held.pop()
            for s in two:
                take(s)
            held += two
            if small not in count:
                insort(sizes, small)
            count[small] = count.get(small, 0) + 1
        bins.append(held)
    return bins


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """All containers of one pool for one capacity."""
    cap, capacity_id, pool = int(pdf["max_tokens"].iloc[0]), int(pdf["capacity_id"].iloc[0]), int(pdf["pool"].iloc[0])
    pdf = pdf.sort_values(["tokens", "row_id"], kind="stable")
    row, tokens = pdf["row_id"].to_numpy(), pdf["tokens"].to_numpy()
    full, rest = tokens // cap, tokens % cap
    # Pieces of texts that exceed the capacity fill containers of their own; what is left of them is packed as a text is.
    r_row, r_piece, r_tokens = np.repeat(row, full), np.concatenate([np.arange(k) for k in full]) if full.sum() else np.empty(0, np.int64), np.full(full.sum(), cap)
    some = rest > 0
    order = np.argsort(rest[some], kind="stable")
    p_row, p_piece, p_tokens = row[some][order], full[some][order], rest[some][order]
    stacks = {s: list(range(a, b)) for s, a, b in zip(*_groups(p_tokens))}
    bins = best_two_fit(p_tokens.tolist(), cap)
    at = np.fromiter((stacks[s].pop() for b in bins for s in b), np.int64, len(p_tokens))
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins]) if bins else np.empty(0, np.int64)
    fill = np.repeat([sum(b) for b in bins], [len(b) for b in bins]) if bins else np.empty(0, np.int64)
    base = pool << 32
    return pd.DataFrame({
        "capacity_id": capacity_id, "max_tokens": cap,
        "container": base + np.concatenate([number, len(bins) + np.arange(len(r_row))]).astype(np.int64),
        "fill": np.concatenate([fill, r_tokens]).astype(np.int64), "row_id": np.concatenate([p_row[at], r_row]).astype(np.int64),
        "piece": np.concatenate([p_piece[at], r_piece]).astype(np.int32), "tokens": np.concatenate([p_tokens[at], r_tokens]).astype(np.int64),
    })


def _groups(sorted_values: np.ndarray) -> tuple[list, list, list]:
    values, start = np.unique(sorted_values, return_index=True)
    return values.tolist(), start.tolist(), [*start[1:].tolist(), len(sorted_values)]


def packed(sizes: DataFrame, capacities: DataFrame, rows: int, pool: int = POOL) -> DataFrame:
    """capacity_id, max_tokens, container, fill, row_id, piece, tokens: each text once per capacity.

    sizes: row_id (bigint) and tokens; rows: about how many rows it has. Rows of one id or none are texts of their own. A text beyond the
    capacity is cut into pieces numbered from 0, all but the last full. Texts without tokens (null,
    empty) are in no container and give no row. capacities: capacity_id, max_tokens; null and
    non-positive capacities are left out, repeated rows count once. ``container`` is unique within a
    capacity (pool * 2^32 + number), ``fill`` the tokens of the whole container.
    """
    pools = max(1, -(-rows // pool))
    dealt = sizes.where(F.col("tokens") > 0).select(F.coalesce("row_id", F.lit(NO_ID)).alias("row_id"), F.col("tokens").cast("bigint").alias("tokens"), F.pmod(F.xxhash64("row_id", "tokens"), F.lit(pools)).alias("pool"))
    caps = capacities.where(F.col("max_tokens") > 0).select(F.col("capacity_id").cast("int").alias("capacity_id"), F.col("max_tokens").cast("bigint").alias("max_tokens")).distinct()
    # The capacities are a parameter table of a few rows; they go along as one array, so nothing is crossed.
    each = caps.agg(F.sort_array(F.collect_list(F.struct("capacity_id", "max_tokens"))).alias("c")).scalar()
    spread = dealt.select("row_id", "tokens", "pool", F.explode(each).alias("c")).select("row_id", "tokens", "pool", "c.capacity_id", "c.max_tokens")
    out = spread.groupBy("pool", "capacity_id", "max_tokens").applyInPandas(_pack, _OUT)
    return out.withColumn("row_id", F.nullif("row_id", F.lit(NO_ID)))


def fill_report(p: DataFrame) -> DataFrame:
    """capacity_id, containers, tokens, used (share of the capacity filled)."""
    by = p.groupBy("capacity_id", "max_tokens").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return by.select("capacity_id", "max_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6).alias("used"))
