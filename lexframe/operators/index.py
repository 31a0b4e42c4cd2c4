"""Ordinals, dictionary pools, postings, front coding and block packing of packs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.session import checkpointed

FRONT_BLOCK = 256  # entries after which front coding starts anew
POSTING_CHUNK = 65_536  # ids of one posting row at most
PACK_SEGMENT = 1 << 20  # entries that one task packs at a time; the blocks don't depend on it
POOL_LIMIT = 65_535


def entries_once(entries: DataFrame) -> DataFrame:
    """Entries without their arrival time; rows delivered again count once."""
    return entries.select("pack_id", "entry_id", "headword", "see", "ord", "edited_at", "deleted_at").distinct()


def live(entries: DataFrame) -> DataFrame:
    """Entries that aren't deleted: pack_id, entry_id, headword, see, ord, fold."""
    return entries_once(entries).where(F.col("deleted_at").isNull()).select("pack_id", "entry_id", "headword", "see", "ord").withColumn("fold", T.fold("headword"))


def ordinals(heads: DataFrame) -> DataFrame:
    """``heads`` (pack_id, fold, headword, ...) with ``ordinal``, the 0-based place by (fold, headword) in its pack.

    Range-partitioned sort, then offsets of the partitions: no pack is ever sorted or numbered by one
    task. The offsets are one row per partition and pack in it, and a partition is a range, so there
    are fewer of them than partitions and packs together.
    """
    keys = ["pack_id", "fold", "headword"]
    placed = checkpointed(heads.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    runs = placed.groupBy("_part", "pack_id").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("pack_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select(F.col("_part").alias("_p"), F.col("pack_id").alias("_pack"), "_first", before.alias("_before"))
    same = (F.col("_part") == F.col("_p")) & F.col("pack_id").eqNullSafe(F.col("_pack"))
    out = placed.join(F.broadcast(offsets), same)
    return out.withColumn("ordinal", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_p", "_pack", "_first", "_before")


def front_coded(numbered: DataFrame) -> DataFrame:
    """pack_id, block, ordinal, shared, suffix: bytes shared with the headword before, anew every FRONT_BLOCK entries."""
    block = F.floor(F.col("ordinal") / FRONT_BLOCK)
    w = Window.partitionBy("pack_id", "block").orderBy("ordinal")
    prev = F.lag("headword").over(w)
    out = numbered.withColumn("block", block).withColumn("shared", F.coalesce(T.shared_prefix(prev, F.col("headword")), F.lit(0)))
    return out.select("pack_id", "block", "ordinal", "shared", F.hex(F.substring(F.encode("headword", "UTF-8"), F.col("shared") + 1, F.lit(1 << 30))).alias("suffix"))


def front_decoded(coded: DataFrame) -> DataFrame:
    """pack_id, ordinal, headword from ``front_coded``; a block has FRONT_BLOCK rows at most."""
    row = F.sort_array(F.collect_list(F.struct("ordinal", "shared", "suffix")))
    blocks = coded.groupBy("pack_id", "block").agg(row.alias("r"))
    kind = "struct<last:string,all:array<struct<ordinal:bigint,hex:string>>>"
    first = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<ordinal:bigint,hex:string>>").alias("all")).cast(kind)

    def step(acc, x):  # noqa: ANN001, ANN202
        whole = F.concat(F.substring(acc["last"], F.lit(1), x["shared"] * 2), x["suffix"])
        return F.struct(whole.alias("last"), F.concat(acc["all"], F.array(F.struct(x["ordinal"].cast("bigint").alias("ordinal"), whole.alias("hex")))).alias("all"))

    return blocks.select("pack_id", F.explode(F.aggregate("r", first, step)["all"]).alias("e")).select("pack_id", "e.ordinal", F.decode(F.unhex("e.hex"), "UTF-8").alias("headword"))


def directory(numbered: DataFrame) -> DataFrame:
    """pack_id, block, first (headword), entries: the directory of the front-coded index."""
    return numbered.groupBy("pack_id", F.floor(F.col("ordinal") / FRONT_BLOCK).alias("block")).agg(F.min_by("headword", "ordinal").alias("first"), F.count(F.lit(1)).alias("entries"))


def pools(values: DataFrame) -> DataFrame:
    """pack_id, pool, value, idx: distinct values numbered from 1 by first appearance.

    values: pack_id, pool, value, at (a struct that orders appearances). Null values are in no pool.
    Pools hold at most POOL_LIMIT values each, so numbering one is bounded work.
    """
    first = values.where(F.col("value").isNotNull()).groupBy("pack_id", "pool", "value").agg(F.min("at").alias("at"))
    w = Window.partitionBy("pack_id", "pool").orderBy("at", "value")
    return first.select("pack_id", "pool", "value", F.row_number().over(w).alias("idx"))


def postings(keyed: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """pack_id, key, chunk, ids: sorted distinct ordinals, in rows of at most POSTING_CHUNK ids."""
    chunk = F.floor(F.col(ordinal) / POSTING_CHUNK)
    return keyed.groupBy("pack_id", key, chunk.alias("chunk")).agg(F.sort_array(F.collect_set(ordinal)).alias("ids"))


def _breaks(size: np.ndarray, block_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each entry (and of all), and for a block that starts at each entry the start of the next one (the length if none).

    A block is closed before an entry that would exceed ``block_max``, unless nothing but empty entries is in it.
    """
    n = len(size)
    total = np.concatenate([[0], np.cumsum(size)])
    filled = np.append(np.flatnonzero(size > 0), n)
    first = filled[np.searchsorted(filled, np.arange(n))]
    return total, np.minimum(np.maximum(np.searchsorted(total, total[:-1] + block_max, "right") - 1, first + 1), n)


def _segments(run: Callable[[str | None, int, np.ndarray, pa.Table], Iterator[pa.RecordBatch]]):  # noqa: ANN202
    """An Arrow mapper over rows sorted by pack and segment, a whole segment at a time."""

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        segment = t.column("segment").to_numpy()
        pack = t.column("pack_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (pack[1:] != pack[:-1]), True])
        for a, b in zip(edges, edges[1:]):
            part = t.slice(a, b - a)
            yield from run(part.column("pack_id")[0].as_py(), int(segment[a]), part.column("size").to_numpy(), part)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = lambda b, i: (b.column("pack_id")[i].as_py(), b.column("segment")[i].as_py())
            if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
                yield from whole(held)
                held = []
            held.append(batch)
        if held:
            yield from whole(held)

    return mapper


_STEPS = "pack_id string, segment bigint, reach bigint, blocks bigint, left bigint, total bigint"


def _steps(block_max: int):  # noqa: ANN202
    """What a segment does to whatever comes into it.

    One row for each entry at which an open block may be closed: it is the one if the bytes that come in and ``reach`` first
    exceed the block; then ``blocks`` begin in the segment and ``left`` bytes are in the last. The row with reach -1 is for none coming in.
    """

    def run(pack: str | None, segment: int, size: np.ndarray, _: pa.Table) -> Iterator[pa.RecordBatch]:
        total, after = _breaks(size, block_max)
        n = len(size)
        blocks, left = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            j = int(after[i])
            blocks[i], left[i] = (blocks[j] + 1, left[j]) if j < n else (0, int(total[n] - total[i]))
        last = min(n - 1, int(np.searchsorted(total, block_max - 1, "right")) - 1)
        reach = [-1, *(int(total[b + 1]) for b in range(last + 1))]
        rows = [blocks[0], *(1 + blocks[b] for b in range(last + 1))], [left[0], *(left[b] for b in range(last + 1))]
        k = len(reach)
        cols = ([pack] * k, [segment] * k, reach, rows[0], rows[1], [int(total[n])] * k)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 5))], names=[c.split()[0] for c in _STEPS.split(", ")])

    return _segments(run)


def _entries(block_max: int):  # noqa: ANN202
    """The state in which each segment of a pack begins: its open block and the bytes in it. The segments are few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, used, rows = 0, 0, []
        for segment, own in pdf.sort_values(["segment", "reach"]).groupby("segment", sort=True):
            rows.append((pdf["pack_id"].iloc[0], segment, block, used))
            hit = own[own["reach"] < 0] if used == 0 else own[(own["reach"] >= 0) & (own["reach"] + used > block_max)]
            if len(hit):
                block, used = block + int(hit["blocks"].iloc[0]), int(hit["left"].iloc[0])
            else:
                used += int(own["total"].iloc[0])
        return pd.DataFrame(rows, columns=["pack_id", "segment", "block0", "used0"])

    return run


def _packed(block_max: int):  # noqa: ANN202
    """The blocks of a segment, from the state in which it begins (block0, used0)."""

    def run(_: str | None, __: int, size: np.ndarray, part: pa.Table) -> Iterator[pa.RecordBatch]:
        total, after = _breaks(size, block_max)
        n, block, used = len(size), part.column("block0")[0].as_py(), part.column("used0")[0].as_py()
        blocks, ats = np.empty(n, np.int64), np.empty(n, np.int64)
        end = int(after[0]) if used == 0 else min(n, max(0, int(np.searchsorted(total, block_max - used, "right")) - 1))
        blocks[:end], ats[:end] = block, used + total[:end]
        while end < n:
            start, end, block = end, int(after[end]), block + 1
            blocks[start:end], ats[start:end] = block, total[start:end] - total[start]
        t = part.select(["pack_id", "ordinal", "size"]).append_column("block", pa.array(blocks)).append_column("at", pa.array(ats))
        yield from t.combine_chunks().to_batches()

    return _segments(run)


def packed_blocks(sizes: DataFrame, block_max: int, segment: int = PACK_SEGMENT) -> DataFrame:
    """pack_id, block, ordinal, at, size: greedy blocks in order of ordinals.

    A block is closed when it isn't empty and the next entry would exceed ``block_max``; a larger
    entry has a block of its own. Packs are walked in segments of so many entries by many tasks: first each
    segment tells what it does to whatever comes into it, then the segments of a pack are gone through in
    order, then each is packed from its own beginning. The result is that of one walk, whatever the segments are.
    """
    cut = sizes.select("pack_id", "ordinal", F.col("size").cast("bigint").alias("size"), F.floor(F.col("ordinal") / segment).cast("bigint").alias("segment"))
    order = ["pack_id", "segment", "ordinal"]
    spread = lambda df: df.repartition("pack_id", "segment").sortWithinPartitions(*order)
    begins = spread(cut).mapInArrow(_steps(block_max), _STEPS).groupBy("pack_id").applyInPandas(_entries(block_max), "pack_id string, segment bigint, block0 bigint, used0 bigint")
    begins = begins.select(F.col("pack_id").alias("_p"), F.col("segment").alias("_s"), "block0", "used0")
    known = cut.join(begins, F.col("pack_id").eqNullSafe(F.col("_p")) & (F.col("segment") == F.col("_s"))).drop("_p", "_s")
    out = spread(known).mapInArrow(_packed(block_max), "pack_id string, ordinal bigint, size bigint, block bigint, at bigint")
    return out.select("pack_id", "block", "ordinal", "at", "size")
