"""Items that appear together much more often than chance.

Blocked Gram matrix: items get integer numbers in their order, baskets become binary sparse blocks
of records by items, the transpose-products of blocks are summed over the records of a task, the
partial sums are added up by item pair, and the counts are set against the marginals.

Two bounds prune items without losing a case. A pair with at least ``min_count`` common records needs
items in at least as many. As n(a,b) <= n(a), the lift n(a,b) M >= L n(a) n(b) needs L n(b) <= M, so an
item in more than one basket in L is in no case; thereby the hottest items never reach the product.

Every basket is cut into blocks of about ``BLOCK_ITEMS`` items (a narrow basket is one block) and each
pair of its blocks is a product of its own, so that no task gets a wide basket whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.operators.skew import hot_counts, repeated, salts_for
from lexframe.session import stored

BLOCK_ITEMS = 1_024  # items of one block of a basket, about
BLOCK_ROWS = 200_000  # ones of the sparse blocks that are multiplied at a time, about
PRODUCTS = 4_000_000  # products of one expansion, about
_SUMS = "a bigint, b bigint, n bigint"
_SUM_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_GROUP = ["field", "record", "block_a", "block_b"]


def product(row_a: np.ndarray, item_a: np.ndarray, row_b: np.ndarray, item_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A'B of two binary sparse matrices with the same rows, as (column of A, column of B, sum).

    The ones stand at (row, item), ordered by row. Every one of A meets the ones of B in its row, and
    equal pairs of columns are added up, a bounded number of products at a time.
    """
    height = int(max(row_a[-1] if len(row_a) else -1, row_b[-1] if len(row_b) else -1)) + 1
    ones = np.bincount(row_b, minlength=height)
    first = np.cumsum(ones) - ones
    meets = ones[row_a]
    upto = np.cumsum(meets)
    width = int(max(item_a.max(initial=0), item_b.max(initial=0))) + 1
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    start = 0
    while start < len(row_a):
        base = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + PRODUCTS, "right")))
        m = meets[start:stop]
        left = np.repeat(np.arange(start, stop), m)
        right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + first[row_a[left]]
        new, count = np.unique(item_a[left] * width + item_b[right], return_counts=True)
        keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([sums, count]), len(keys)).astype(np.int64)
        start = stop
    return keys // width, keys % width, sums


def gram(place: np.ndarray, item: np.ndarray, left: np.ndarray, right: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs a < b of items with the number of places that hold one of them on the left and the other on the right.

    place ascends; ``square``: left and right are the same ones, so each pair turns up in both orders and is halved.
    """
    names, code = np.unique(item, return_inverse=True)
    a, b, n = product(place[left], code[left], place[right], code[right])
    apart = a != b
    low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
    keys, at = np.unique(low * len(names) + high, return_inverse=True)
    sums = np.bincount(at, n[apart], len(keys)).astype(np.int64)
    return names[keys // max(len(names), 1)], names[keys % max(len(names), 1)], sums // (1 + square)


def _places(t: pa.Table) -> np.ndarray:
    """For each row of a sorted table the number of its block pair."""
    codes = [t.column("field").combine_chunks().dictionary_encode().indices.to_numpy()] + [t.column(c).to_numpy() for c in _GROUP[1:]]
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for c in codes:
        new |= c[1:] != c[:-1]
    return np.cumsum(np.r_[False, new])


def _sums(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The products of whole block pairs (field, record, block_a, block_b, block, id)."""
    place = _places(t)
    block_a, block_b, block, item = (t.column(c).to_numpy() for c in ("block_a", "block_b", "block", "id"))
    for square in (True, False):  # blocks that meet themselves; blocks that meet another
        mine = (block_a == block_b) == square
        a, b, n = gram(place[mine], item[mine], (block == block_a)[mine], (block == block_b)[mine], square)
        if len(a):
            yield pa.RecordBatch.from_arrays([*map(pa.array, (a, b, n))], schema=_SUM_SCHEMA)


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of about BLOCK_ROWS rows at a time, cut between block pairs; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            t = pa.Table.from_batches(held)
            place = _places(t)
            cut = int(np.searchsorted(place, place[-1]))
            if cut:
                yield from _sums(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), rows - cut
    if held:
        yield from _sums(pa.Table.from_batches(held))


def cooccurrences(baskets: DataFrame, min_count: int = 5, lift: int = 4, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs of items in at least ``min_count`` common records and at least ``lift`` times as often as by chance.

    baskets: field, record (bigint), item. Null and empty items and null records are left out, rows
    that repeat an item in a record count once, other columns are ignored. Result: field, item_a <
    item_b (by UTF-8 bytes), n_a, n_b, m (records with any item of the field) and n_ab, with
    n_ab * m >= lift * n_a * n_b. Empty input gives no rows. ``block_items`` changes the work, not the result.
    """
    real = F.col("item").isNotNull() & (F.col("item") != "") & F.col("record").isNotNull() & F.col("field").isNotNull()
    base = stored(baskets.select("field", "record", "item").where(real).distinct())
    widths = base.groupBy("field", "record").agg(F.count(F.lit(1)).alias("k"))
    m = widths.groupBy("field").agg(F.count(F.lit(1)).alias("m"))
    counts = base.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n")).join(m, "field")
    # Numbers in the order of (field, item), so that a < b holds for numbers as it does for the items.
    useful = counts.where((F.col("n") >= min_count) & (F.col("n") * lift <= F.col("m"))).orderBy("field", "item").withColumn("id", F.monotonically_increasing_id())
    useful = stored(useful)
    # Items with more than one row in 256 are salted, the ones of them that are in no case go before the join.
    hot = hot_counts(counts.groupBy("item").agg(F.sum("n").alias("n")), "item", "n")
    idle = sorted(set(hot) - {r["item"] for r in useful.where(F.col("item").isin(hot)).select("item").collect()})
    left = (base.where(~F.col("item").isin(idle)) if idle else base).withColumn("_salt", salts_for("item", hot, ["record"]))
    right = repeated(useful.select("field", "item", "id"), "item", hot, "_salt")
    kept = left.join(right, ["field", "item", "_salt"]).select("field", "record", "id")
    # The blocks of a basket; the few baskets of more than one block are told by the widths.
    wide = stored(widths.where(F.col("k") > block_items).select("field", "record", F.ceil(F.col("k") / block_items).cast("int").alias("blocks")))
    broad = hot_counts(wide.groupBy("record").agg(F.sum("blocks").alias("n")), "record", "n")
    kept = kept.withColumn("_salt", salts_for("record", broad, ["id"])).join(repeated(wide, "record", broad, "_salt"), ["field", "record", "_salt"], "left")
    kept = kept.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = kept.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "field", "record", F.least("block", "_o").alias("block_a"), F.greatest("block", "_o").alias("block_b"), "block", "id"
    )
    sums = pairs.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_multiplied, _SUMS)
    common = sums.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    a = useful.select("field", F.col("id").alias("a"), F.col("item").alias("item_a"), F.col("n").alias("n_a"), "m")
    b = useful.select(F.col("id").alias("b"), F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    found = common.join(a, "a").join(b, "b").where(F.col("n_ab") * F.col("m") >= lift * F.col("n_a") * F.col("n_b"))
    return found.select("field", "item_a", "item_b", "n_a", "n_b", "m", "n_ab")
