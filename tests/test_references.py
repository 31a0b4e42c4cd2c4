import datetime as dt

import pytest

from lexframe.operators import references as R

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(1)
REF = "owner string, a string, b string, ref_date timestamp_ntz, extra int"
TARGET = "a string, b string, deleted boolean, arrived timestamp_ntz, extra int"


def orphans(spark, refs, targets, match, hot=()):
    r, t = spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET)
    out = R.orphan_references(r, t, ["a", "b"], ["owner"], "b", list(hot), match)
    return {x["owner"]: x["reason"] for x in out.collect()}


TARGETS = [("p", "x", False, T0, 1), ("p", "gone", True, T0, 1), ("p", "new", False, T0 + 9 * DAY, 1), ("p", "new", True, T0, 1), (None, "x", False, T0, 1)]
REFS = [
    ("ok", "p", "x", T0, 0), ("none", "p", "y", T0, 0), ("gone", "p", "gone", T0, 0), ("late", "p", "new", T0 + DAY, 0), ("in time", "p", "new", T0 + 9 * DAY, 0),
    ("half", None, "x", T0, 0), ("half none", None, "y", T0, 0), ("only a", "p", None, T0, 0), ("null", None, None, T0, 0), ("undated", "p", "new", None, 0), (None, "p", "zz", T0, 0),
]
COMMON = {"none": "missing", "gone": "deleted", "late": "late", None: "missing"}


@pytest.mark.parametrize(
    ("match", "more"),
    [("simple", {}), ("partial", {"half none": "missing"}), ("full", {"half": "missing", "half none": "missing", "only a": "missing"})],
)
def test_match_semantics(spark, match, more):
    assert orphans(spark, REFS, TARGETS, match) == COMMON | more


@pytest.mark.parametrize("hot", [("new", "y"), ("x",)])
def test_salting_changes_nothing(spark, hot):
    assert orphans(spark, REFS, TARGETS, "full", hot) == orphans(spark, REFS, TARGETS, "full")


def test_deliveries_count_once_and_by_the_earliest(spark):
    again = [("late", "p", "new", T0 + 20 * DAY, 0), ("late", "p", "new", T0 + 2 * DAY, 0)]
    r, t = spark.createDataFrame(REFS + again, REF), spark.createDataFrame(TARGETS, TARGET)
    rows = [x for x in R.orphan_references(r, t, ["a", "b"], ["owner"], "b", [], "simple").collect() if x["owner"] == "late"]
    assert [(x["reason"], x["ref_date"]) for x in rows] == [("late", T0 + DAY)]


def test_empty_tables(spark):
    assert orphans(spark, [], TARGETS, "full") == {}
    assert orphans(spark, [("r", "p", "x", T0, 0)], [], "simple") == {"r": "missing"}
    with pytest.raises(ValueError, match="match"):
        orphans(spark, [], [], "other")


def test_hot_values_are_bounded(spark):
    from lexframe.operators.skew import hot_values

    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE CAST(id AS STRING) END AS k")
    assert hot_values(df, ["k"], 10) == {"k": ["hot"]}
    assert hot_values(df.where("false"), ["k"]) == {"k": []}
