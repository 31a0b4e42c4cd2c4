import json

from lexframe.functions.jsontree import canonical, loads
from lexframe.operators import flatten as fl

RAW = "raw_id bigint, body string, loaded_at timestamp_ntz, kind string"
DOC = {
    "headword": "w",
    "x_import": {"definitions": [{"value": "no node"}]},
    "etymologies": {
        "senses": [
            None,
            {
                "translations": [{"value": "t", "lang": "de"}, None],
                "definitions": [
                    {"Group": {"description": "g", "definitions": [{"Definition": {"value": "d", "examples": {"value": "e", "translations": {"value": "u"}}, "notes": [{"value": "n", "examples": [{"value": "f"}]}]}}]}},
                    {"definitions": None},
                    {"value": "bare"},
                    "text",
                    {"Definition": None},
                ],
            },
        ]
    },
}
PATHS = {
    ("ety", "e0"), ("sense", "e0/s1"), ("translation", "e0/s1/t0"), ("group", "e0/s1/d0"), ("definition", "e0/s1/d0/d0"), ("example", "e0/s1/d0/d0/x0"), ("translation", "e0/s1/d0/d0/x0/t0"),
    ("note", "e0/s1/d0/d0/n0"), ("example", "e0/s1/d0/d0/n0/x0"), ("group", "e0/s1/d1"), ("definition", "e0/s1/d2"),
}


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b, None, "clash") for i, b in enumerate(bodies)], RAW)


def found(spark, *bodies):
    return {(r["raw_id"], r["kind"], r["path"]) for r in fl.flatten(frame(spark, *bodies), ("raw_id", "kind", "path")).collect()}


def test_every_node_and_no_other(spark):
    assert found(spark, json.dumps(DOC)) == {(0, *p) for p in PATHS}


def test_bodies_that_are_no_object(spark):
    assert found(spark, None, "", " ", "[]", '"x"', "{", '{"etymologies":[{}]} x', '{"etymologies": NaN}', "null", '{"etymologies": "s"}') == set()


def test_deliveries_count_once(spark):
    body = json.dumps(DOC)
    df = spark.createDataFrame([(1, body, None, ""), (1, body, None, ""), (None, body, None, "")], RAW)
    assert fl.flatten(df, ("raw_id", "path")).count() == 2 * len(PATHS)


def test_unlimited_depth(spark):
    depth = 30_000
    body = '{"etymologies":[{"senses":[{"definitions":[' + '{"Group":{"definitions":[' * depth + "]}}" * depth + "]}]}]}"
    assert len(found(spark, body)) == depth + 2
    assert canonical(loads(body)) == body


def test_iterative_reader_agrees_with_the_recursive_one():
    from lexframe.functions.jsontree import _iterative

    for text in (json.dumps(DOC), "[]", "{}", ' [1, -2.5e3, true, null, "\\u0041\\n", {"a": {}, "b": [[]]}] ', '{"a":1,"a":2}', "7"):
        assert _iterative(text) == json.loads(text)
    for text in ("[1,]", "{", '{"a"}', "[1 2]", "{1:2}", "tru", "[]]", ""):
        try:
            _iterative(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_equal_subtrees_share_one_object(spark):
    a, b = {"etymologies": [{"root": "r", "senses": []}], "headword": "a"}, {"etymologies": [{"senses": [], "root": "r"}, {"root": "r"}, {"root": "r", "senses": None}], "headword": "b"}
    raw = frame(spark, json.dumps(a), json.dumps(b))
    ety = fl.objects(raw).where("kind = 'ety'").collect()
    assert sorted(r["occurrences"] for r in ety) == [1, 1, 2]  # empty, absent and null are three things
    assert fl.bridge(raw).count() == 4


def whole(spark, raw):
    """The documents put together from roots, bridge and objects."""
    payload = {bytes(r["node_id"]): (r["kind"], r["payload"]) for r in fl.objects(raw).collect()}
    child = {(bytes(r["parent_id"]), r["step"], r["ordinal"]): bytes(r["child_id"]) for r in fl.bridge(raw).collect()}

    def of(node):
        kind, text = payload[node]
        own = json.loads(text)
        for field, _, step in fl.CHILDREN[kind]:
            if field not in own:
                continue

            def put(n, mark):
                if isinstance(mark, list):
                    return mark[0]
                inner = of(child[node, step, n])
                return inner if mark == 0 else {mark: inner} if isinstance(mark, str) else {**next(iter(mark.values())), next(iter(mark)): inner}

            held = own[field]
            own[field] = [put(n, m) for n, m in enumerate(held)] if isinstance(held, list) else put(0, held["1"]) if "1" in held else held[""]
        return own

    return {r["raw_id"]: canonical(of(bytes(r["node_id"]))) for r in fl.roots(raw).collect()}


def test_the_stored_tables_lose_nothing(spark):
    odd = {"etymologies": [{"senses": {"definitions": [{"Group": {"definitions": None}, "x": 1}, {"Definition": 5}, 7, None, {"Group": {}}], "translations": "text"}}, None, [1]], "n": None}
    docs = [DOC, DOC, {"etymologies": [DOC["etymologies"]]}, {}, odd, {"etymologies": None}]
    raw = frame(spark, *map(json.dumps, docs))
    again = fl.rebuild(fl.roots(raw), fl.bridge(raw))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in fl.flatten(raw, ("raw_id", "kind", "path")).collect()}
    assert whole(spark, raw) == {i: canonical(json.loads(json.dumps(d))) for i, d in enumerate(docs)}


def test_no_documents(spark):
    none = frame(spark, None, "[]")
    assert fl.rebuild(*fl.stored_tables(none)).count() == 0 and fl.objects(none).count() == 0


def test_flat_tables(spark):
    rows = fl.flat_table(frame(spark, json.dumps(DOC)), "translation").orderBy("path").collect()
    assert [(r["path"], r["parent_path"], r["lang"], r["value"]) for r in rows] == [("e0/s1/d0/d0/x0/t0", "e0/s1/d0/d0/x0", None, "u"), ("e0/s1/t0", "e0/s1", "de", "t")]


def test_long_numbers_and_lone_surrogates(spark):
    assert found(spark, '{"etymologies":[{"root":"\\ud800","n":' + "9" * 6000 + "}]}") == {(0, "ety", "e0")}


def test_rebuilding_has_no_deepest_level(spark):
    group = {"definitions": [{"value": "v"}]}
    for _ in range(12):
        group = {"definitions": [{"Group": group}]}
    raw = frame(spark, json.dumps({"etymologies": [{"senses": [group]}]}))
    again = fl.rebuild(fl.roots(raw), fl.bridge(raw))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in fl.flatten(raw, ("raw_id", "kind", "path")).collect()}


def test_found_comes_from_the_stored_tables_and_all_tables_have_a_query(spark, tmp_path, monkeypatch):
    from lexframe.plans import general

    raw = frame(spark, json.dumps(DOC), json.dumps(DOC), "{}", "[]")
    raw.write.parquet(str(tmp_path / "raw_entries.parquet"))
    want = sorted(tuple(r) for r in fl.flatten(raw, ("raw_id", "kind", "path")).collect())
    assert {"p3_roots", *(f"p3_{n}" for n in general.FLAT_TABLES)} <= set(general.QUERIES)
    assert {*general.FLAT_TABLES.values(), "sense"} == set(fl.KINDS)
    used = []
    monkeypatch.setattr(fl, "rebuild", lambda *a, kept=fl.rebuild: used.append(1) or kept(*a))
    assert sorted(tuple(r) for r in general.p3_found(spark, str(tmp_path)).collect()) == want and used
