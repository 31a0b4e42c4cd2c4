import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexframe.llm import frequency as fq

SCHEMA = "field string, term string, record bigint, key_a bigint, key_b bigint, extra string"


def brute(rows):
    occ, rec = Counter(), defaultdict(set)
    for field, term, record, a, b in {r[:5] for r in rows}:
        if term:
            occ[field, term] += 1
            rec[field, term] |= {record} - {None}
    return {k: (n, len(rec[k])) for k, n in occ.items()}


def ours(spark, rows):
    got = fq.term_frequencies(spark.createDataFrame(rows, SCHEMA))
    return {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in got.collect()}


def test_against_brute_force_with_a_hot_term(spark):
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        term = rng.choice(["hot", "hot", f"t{rng.randrange(50)}", "", None, "é", "Z"])
        rows.append((rng.choice(["f", "g"]), term, rng.choice([None, 7, rng.randrange(900)]), i % 500, rng.randrange(3), "x"))
    rows += rows[:200]  # delivered again
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # runs go on from batch to batch
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # and from partition to partition
    try:
        assert ours(spark, rows) == brute(rows)
        one = [("f", "only", 1, i, 0, "") for i in range(3000)]  # one record with all rows, cut by partitions
        assert ours(spark, one) == {("f", "only"): (3000, 1)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    assert ours(spark, []) == {}
    assert ours(spark, [("f", None, 1, 1, 1, ""), ("f", "", 1, 1, 1, "")]) == {}
    assert ours(spark, [("f", "x" * 100_000, None, None, None, "")] * 3) == {("f", "x" * 100_000): (1, 0)}


def test_marks(spark):
    rows = [("f", "r", i, 0, 0, "") for i in range(2)] + [("f", "m", i, 0, 0, "") for i in range(3)] + [("f", "c", i, 0, 0, "") for i in range(4)]
    got = fq.marked(fq.term_frequencies(spark.createDataFrame(rows, SCHEMA)), F.lit(30))
    assert {r["term"]: r["mark"] for r in got.collect()} == {"r": "rare", "m": None, "c": "common"}
