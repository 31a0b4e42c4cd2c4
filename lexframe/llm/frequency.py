"""Frequency of every distinct value: occurrences, distinct records, and a mark for the useless ones.

Range-partitioned external sort of (field, term, record, row key), then one run-length scan of each
sorted partition counts occurrences and distinct records. As the ranges are cut on the whole tuple,
a term with a third of all rows spreads over many partitions; each partition reports one partial
count per term together with the first and last record of its run, and a record whose run is cut by
a partition boundary is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("field", "term", "record", "key_a", "key_b")
_RUNS = "field string, term string, part int, occurrences bigint, records bigint, first_record bigint, last_record bigint"
_RUN_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_RUN_SCHEMA = pa.schema(list(zip((c.split()[0] for c in _RUNS.split(", ")), _RUN_TYPES)))


def occurrences(df: DataFrame, field: str, term: str, record: str, key: tuple[str, ...]) -> DataFrame:
    """Rows of ``df`` as (field, term, record, key_a, key_b) for ``term_frequencies``; key names a row."""
    a, b = (F.col(key[i]).cast("bigint") if i < len(key) else F.lit(0).cast("bigint") for i in (0, 1))
    return df.select(F.lit(field).alias("field"), F.col(term).alias("term"), F.col(record).cast("bigint").alias("record"), a.alias("key_a"), b.alias("key_b"))


def _changed(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Where a value differs from the one before it (nulls equal nulls); before: the last of the batch before."""
    n = len(column)
    out = np.ones(n, bool)
    a, b = column.slice(1), column.slice(0, n - 1)
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    out[1:] = ~same
    if before is not None:
        first = column[0]
        out[0] = not ((not first.is_valid and not before.is_valid) or (first.is_valid and before.is_valid and first.as_py() == before.as_py()))
    return out


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    last: list[pa.Scalar] | None = None
    open_run: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = batch.columns
        diff = [_changed(c, last and last[i]) for i, c in enumerate(cols)]
        term = diff[0] | diff[1]
        record = term | diff[2]
        row = record | diff[3] | diff[4]
        counted = record & pc.is_valid(cols[2]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(term)
        edges = starts if len(starts) and starts[0] == 0 else np.r_[0, starts]
        occ, rec = np.add.reduceat(row.astype(np.int64), edges), np.add.reduceat(counted.astype(np.int64), edges)
        ends = np.r_[edges[1:], batch.num_rows] - 1
        fields, terms = cols[0].take(pa.array(edges)).to_pylist(), cols[1].take(pa.array(edges)).to_pylist()
        # nulls sort first, so the last record of a run is null only if all are
        firsts, lasts = cols[2].take(pa.array(edges)).to_pylist(), cols[2].take(pa.array(ends)).to_pylist()
        done: list[list] = []
        for i in range(len(edges)):
            if i == 0 and not term[0]:
                open_run[3] += int(occ[0])
                open_run[4] += int(rec[0])
                open_run[6] = lasts[0] if lasts[0] is not None else open_run[6]
                if open_run[5] is None and lasts[0] is not None:
                    valid = cols[2].slice(0, int(ends[0]) + 1).drop_null()
                    open_run[5] = valid[0].as_py()
                continue
            if open_run is not None:
                done.append(open_run)
            first = firsts[i]
            if first is None and lasts[i] is not None:
                first = cols[2].slice(int(edges[i]), int(ends[i] - edges[i]) + 1).drop_null()[0].as_py()
            open_run = [fields[i], terms[i], part, int(occ[i]), int(rec[i]), first, lasts[i]]
        last = [c[batch.num_rows - 1] for c in cols]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*done), _RUN_TYPES)], schema=_RUN_SCHEMA)
    if open_run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(open_run, _RUN_TYPES)], schema=_RUN_SCHEMA)


def term_frequencies(occ: DataFrame) -> DataFrame:
    """field, term, occurrences, records: one row per distinct non-empty term of each field.

    occ: KEYS, as ``occurrences`` makes them; other columns are ignored. Rows equal in all KEYS are
    deliveries of one row and count once. Null and empty terms are left out. A null record counts
    as an occurrence and not as a record. Empty input gives no rows.
    """
    kept = occ.select(*KEYS).where(F.col("term").isNotNull() & (F.col("term") != ""))
    runs = kept.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_run_lengths, _RUNS)
    order = Window.partitionBy("field", "term").orderBy("part")
    # A partition in which the term has only null records can't stand between two parts of one record, as nulls sort first.
    cut = F.coalesce((F.lag("last_record").over(order) == F.col("first_record")).cast("bigint"), F.lit(0))
    return (
        runs.withColumn("cut", cut)
        .groupBy("field", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum(F.col("records") - F.col("cut")).alias("records"))
    )


def marked(freq: DataFrame, total_records: Column, rare_at_most: int = 2, common_above_one_in: int = 10) -> DataFrame:
    """``freq`` with ``mark``: ``rare`` (records <= rare_at_most), else ``common`` (more than one record in
    ``common_above_one_in`` of ``total_records`` has the term), else null."""
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") * common_above_one_in > total_records, "common")
    return freq.withColumn("mark", mark)
