import json
import zipfile

import pytest

from lexframe.sources import codec, pack

ENTRY = {
    "see": "x", "tags": ["exam:A", "level:B"], "media": [{"kind": "image", "hash": "a3" * 20, "description": None, "alt": "alt"}],
    "pron": [{"lang": "en", "accent": "GA", "kind": "ipa", "value": "/rʌn/", "media": []}],
    "etymologies": [{"id": "e1", "root": "bancus", "senses": [{"pos": "NOUN", "lemma": "l", "translations": [{"lang": "zh", "value": "愛", "pron": []}], "forms": [{"kind": "past", "term": "ran", "tags": ["t"], "feats": "a=b|c=d", "pron": []}],
        "tags": ["s"], "pron": [], "definitions": [{"Group": {"id": None, "description": "g", "definitions": [{"Definition": {"value": "d", "id": "n.1", "examples": [{"value": "He ran", "translations": [{"lang": "fr", "value": "v", "pron": []}], "pron": [], "media": [], "targets": [{"spans": [{"offset": 3, "length": 3}]}]}],
        "notes": [{"value": "n", "id": None, "examples": []}], "media": []}}]}}]}]}],
    "morphology": [{"kind": "root", "term": "run"}, {"kind": None, "term": "s"}], "relations": [{"type": None, "target": "y"}, {"type": "syn", "target": "z"}],
}


def pools_of(*entries):
    pools = {p: [] for p in codec.POOLS}
    for e in entries:
        for p, s in codec.strings_used("entry", e):
            if s not in pools[p]:
                pools[p].append(s)
    return pools, {p: {s: i for i, s in enumerate(v, 1)} for p, v in pools.items()}


def test_entries_come_back():
    pools, index = pools_of(ENTRY)
    assert "fr" in pools["lang"]  # used only inside an example
    raw = codec.encode("entry", ENTRY, index)
    assert codec.decode("entry", codec.Cursor(raw), pools) == ENTRY
    empty = codec.encode("entry", {}, index)
    assert empty == b"\0" and codec.decode("entry", codec.Cursor(empty), pools)["tags"] == []


def test_unknown_and_malformed_records():
    pools, index = pools_of(ENTRY)
    raw = codec.encode("entry", ENTRY, index)
    with pytest.raises(codec.Unknown):
        codec.decode("entry", codec.Cursor(b"\x80"), pools)
    with pytest.raises(codec.Malformed):
        codec.decode("entry", codec.Cursor(raw[:-1]), pools)
    with pytest.raises(codec.Malformed):
        codec.decode("entry", codec.Cursor(raw), {**pools, "tag": []})
    for bad in (b"\x80\x00", b"\xff" * 9 + b"\x7f", b"\xff" * 11):
        with pytest.raises(codec.Malformed):
            codec.Cursor(bad).varint()
    with pytest.raises(codec.Malformed):
        codec.Cursor(b"\x01\xff").string()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 2**32, 2**64 - 1])
def test_varints(n):
    assert codec.Cursor(codec.varint(n)).varint() == n


def test_indexes_come_back():
    who = codec.Identity()
    heads = [(f"entry{i:03d}", i // 50, i, 7) for i in range(300)]
    assert codec.decode_heads(codec.encode_heads(heads, 6, who), who) == (heads, 6)
    assert codec.decode_heads(codec.encode_heads([], 1, who), who) == ([], 1)
    lists = [(1, [0, 2]), (2, [0, 1]), (4, [1])]
    data = codec.encode_postings(lists, who.tags)
    assert codec.decode_postings(data, who.tags, True) == lists
    assert codec.decode_postings(data[:6] + b"\1\0" + data[8:], who.tags, True) is None
    named = [("a=b", [0]), ("ü", [3, 9])]
    assert codec.decode_postings(codec.encode_postings(named, who.morph), who.morph, False) == named
    pools, _ = pools_of(ENTRY)
    assert codec.decode_pools(codec.encode_pools(pools, who), who) == pools


META = {"id": "x", "name": "n", "source_lang": "en", "target_langs": ["zh"], "extra": {"k": [1]}}
DOCS = "ord bigint, headword string, body string"


@pytest.fixture(params=[1, 3])
def written(spark, tmp_path, request):
    """The same pack as one file and as a folder of three."""
    path = str(tmp_path / "a.pack")
    words = ["Apple", "apple", "banana", "zeta", "あ"]
    bodies = [json.dumps(ENTRY | {"tags": [f"t{i % 2}"], "relations": [{"type": "syn", "target": words[i - 1]}]}) for i in range(5)]
    docs = spark.createDataFrame([(9 - i, w, b) for i, (w, b) in enumerate(zip(words, bodies))], DOCS)
    media = spark.createDataFrame(
        [(2, "audio", "mp3", "audio/mpeg", "zstd", b"FAKE" * 50), (1, "audio", "ogg", None, "none", b"FAKE" * 50), (0, "image", "png", "image/png", "none", b"P")],
        "ord bigint, kind string, ext string, mime string, compression string, bytes binary",
    )
    pack.write_pack(docs, path, META, media, block_max=300, cover=b"PNG", shards=request.param)
    pack.register(spark)
    return path, request.param, lambda t: spark.read.format("lexpack").option("table", t).option("groupsPerTask", "1").load(path)


def test_pack_file(written):
    path, shards, load = written
    words = ["Apple", "apple", "banana", "zeta", "あ"]
    rows = load("entries").orderBy("ordinal").collect()
    assert [r["headword"] for r in rows] == words and {r["status"] for r in rows} == {"decoded"} and [r["ordinal"] for r in rows] == list(range(5))
    assert json.loads(rows[1]["body"])["etymologies"] == ENTRY["etymologies"]
    for n, w in enumerate(words):
        assert [r["ordinal"] for r in load("entries").where(f"headword = '{w}'").collect()] == [n]
    assert [load("heads").where(f"headword = '{w}'").count() for w in ("aaa", "APPLE", "zzz", "ん")] == [0] * 4
    tags = {}
    for r in load("postings").where("kind = 'tag'").collect():
        tags.setdefault(r["key"], []).extend(r["ids"])
    assert {k: sorted(v) for k, v in tags.items()} == {"t0": [0, 2, 4], "t1": [1, 3]}
    morph = [r for r in load("postings").where("kind = 'morph'").collect() if r["key"] == "a=b"]
    assert sorted(i for r in morph for i in r["ids"]) == [0, 1, 2, 3, 4]
    assert {(r["kind"], r["ext"]) for r in load("media").collect()} == {("audio", "ogg"), ("image", "png")}
    assert all(r["hash"] == pack.digest(bytes(r["bytes"])) for r in load("media").collect())
    assert {bytes(r["bytes"]) for r in load("cover").collect()} == {b"PNG"} == {bytes(r["bytes"]) for r in load("members").where("path = 'cover.png'").collect()}
    man = load("manifest").collect()
    assert sum(r["index"]["entry_count"] for r in man) == 5 and man[0]["pack"]["target_langs"] == ["zh"]
    assert json.loads(man[0]["body"])["pack"]["extra"] == {"k": [1]}  # as written, also what has no column
    if shards == 1:
        # by first appearance in the source, which has the entries backwards
        assert [r["value"] for r in load("pools").where("pool = 'tag'").orderBy("idx").collect()] == ["t0", "t1"]
        assert zipfile.ZipFile(path).infolist()[0].filename == "mimetype"


def test_an_empty_pack(spark, tmp_path):
    path = str(tmp_path / "e.pack")
    pack.write_pack(spark.createDataFrame([], DOCS), path, META)
    pack.register(spark)
    assert spark.read.format("lexpack").load(path).count() == 0
    assert spark.read.format("lexpack").load(path).where("headword = 'a'").count() == 0


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A pack in two files whose indexes of headwords are longer than what is read of them at a time."""
    path = str(tmp_path_factory.mktemp("many") / "m.pack")
    pack.write_pack(spark.range(6000).selectExpr("id AS ord", "concat(sha1(cast(id AS string)), '/', id) AS headword", """concat('{"see":"', id, '"}') AS body"""), path, META, shards=2)
    pack.register(spark)
    return path


def test_a_headword_is_found_far_into_a_large_index(spark, many):
    heads = {r["headword"]: r["ordinal"] for r in spark.read.format("lexpack").option("table", "heads").load(many).collect()}
    assert len(heads) == 6000
    for word in sorted(heads)[5::997]:
        rows = spark.read.format("lexpack").load(many).where(f"headword = '{word}'").collect()
        assert [(r["ordinal"], json.loads(r["body"])["see"]) for r in rows] == [(heads[word], word.split("/")[1])]


def test_entries_of_a_large_index_come_back(spark, many):
    rows = spark.read.format("lexpack").option("groupsPerTask", "5").load(many).select("ordinal", "headword", "status", "body").collect()
    assert sorted(r["ordinal"] for r in rows) == list(range(6000)) and {r["status"] for r in rows} == {"decoded"}
    assert sorted(r["headword"] for r in rows) == [r["headword"] for r in sorted(rows, key=lambda r: r["ordinal"])]
    assert all(json.loads(r["body"])["see"] == r["headword"].split("/")[1] for r in rows)


@pytest.mark.parametrize("mode", ["auto", "eager", "lazy"])
def test_a_large_index_is_read_in_every_mode(spark, tmp_path, mode):
    from lexframe.sources import files

    path = str(tmp_path / "l.pack")
    pack.write_pack(spark.range(12_000).selectExpr("id AS ord", "concat(sha1(cast(id AS string)), '/', id) AS headword", "'{}' AS body"), path, META, shards=1)
    rows = files.opened(spark, path, mode)
    assert rows.selectExpr("count(*)", "sum(ordinal)", "count(DISTINCT headword)").first() == (12_000, 12_000 * 11_999 // 2, 12_000)
    rows.unpersist()


def nested(depth):
    group = {"id": None, "description": None, "definitions": [{"Definition": {"value": "d", "id": None, "examples": [], "notes": [], "media": []}}]}
    for _ in range(depth):
        group = {"id": None, "description": "g", "definitions": [{"Group": group}]}
    return {"etymologies": [{"id": None, "root": None, "senses": [{"pos": None, "definitions": [{"Group": group}]}]}]}


def test_groups_of_any_depth(spark, tmp_path):
    from lexframe.functions.jsontree import canonical, loads

    path = str(tmp_path / "d.pack")
    pack.write_pack(spark.createDataFrame([(0, "deep", canonical(nested(5000))), (1, "flat", "{}")], DOCS), path, META)
    pack.register(spark)
    rows = {r["headword"]: r for r in spark.read.format("lexpack").load(path).collect()}
    assert rows["flat"]["status"] == rows["deep"]["status"] == "decoded"
    group, depth = loads(rows["deep"]["body"])["etymologies"][0]["senses"][0]["definitions"][0]["Group"], 0
    while "Group" in group["definitions"][0]:
        group, depth = group["definitions"][0]["Group"], depth + 1
    assert depth == 5000


def test_a_bad_entry_stays_opaque(spark, tmp_path):
    path = str(tmp_path / "o.pack")
    pack.write_pack(spark.createDataFrame([(0, "a", "{}"), (1, "b", "{}")], DOCS), path, META)
    other = str(tmp_path / "p.pack")
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(other, "w") as out:
        for m in z.namelist():
            out.writestr(m, codec.compress(b"\0\x80") if m.startswith("data/") else z.read(m))
    pack.register(spark)
    rows = {r["headword"]: (r["status"], bytes(r["raw"])) for r in spark.read.format("lexpack").load(other).collect()}
    assert rows == {"a": ("decoded", b"\0"), "b": ("opaque", b"\x80")}


RULES = {
    "unique": [("a", "{}"), ("a", "{}")], "non-empty": [("", "{}")], "null": [(None, "{}")], "dangling": [("a", '{"relations":[{"type":null,"target":"b"}]}')],
    "itself": [("a", '{"relations":[{"type":null,"target":"a"}]}')], "twice": [("a", '{"relations":[{"target":"b"},{"target":"b"}]}'), ("b", "{}")],
    "pos": [("a", '{"etymologies":[{"senses":[{"pos":"noun","definitions":[]}]}]}')], "pron": [("a", '{"pron":[{"kind":"ipa","value":""}]}')], "body": [("a", "[]")],
    "span": [("a", '{"etymologies":[{"senses":[{"definitions":[{"Definition":{"value":"d","examples":[{"value":"世界","targets":[{"spans":[{"offset":1,"length":2}]}]}]}}]}]}]}')],
}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_a_pack_that_breaks_a_rule_is_refused(spark, tmp_path, rule):
    docs = spark.createDataFrame([(i, w, b) for i, (w, b) in enumerate(RULES[rule])], DOCS)
    with pytest.raises(Exception, match="Malformed|headword|relation"):
        pack.write_pack(docs, str(tmp_path / "d"), META)
    assert not (tmp_path / "d").exists()


def test_metadata_is_needed(spark, tmp_path):
    with pytest.raises(codec.Malformed):
        pack.write_pack(spark.createDataFrame([], DOCS), str(tmp_path / "d"), {"id": "x", "name": "n"})


def test_span_rules():
    from lexframe.operators.validate import span_fault

    one = lambda *spans: [{"spans": [{"offset": a, "length": n} for a, n in spans]}]
    assert span_fault("Take care of yourself", one((0, 13))) is None and span_fault("Look the word up", one((0, 4), (13, 2))) is None
    bad = [span_fault("abc", x) for x in (one((0, 4)), one((0, 0)), one((1, 1), (0, 1)), [{"spans": []}])] + [span_fault("世界", one((1, 2)))]
    assert bad == ["span out of range", "span out of range", "spans overlap", "target without span", "span cuts a character"]


def test_containers_are_checked(tmp_path):
    who = codec.Identity()
    for name, members in {"order": ["x", "mimetype"], "name": ["mimetype", "../x"], "none": [], "twice": ["mimetype", "a", "a"], "step": ["mimetype", "a//b"]}.items():
        path = tmp_path / name
        with zipfile.ZipFile(path, "w") as z:
            for m in members:
                z.writestr(m, who.mimetype)
        with pytest.raises(codec.Malformed):
            pack.open_zip(str(path), who)
    squeezed = tmp_path / "squeezed"
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", who.mimetype)
    (tmp_path / "cut").write_bytes(b"PK\3\4")
    for path in (squeezed, tmp_path / "cut"):
        with pytest.raises(codec.Malformed):
            pack.open_zip(str(path), who)


def test_the_index_is_checked():
    who = codec.Identity()
    for words in (["b", "a"], ["a", "a"], ["a", "A"]):
        with pytest.raises(codec.Malformed):
            codec.decode_heads(codec.encode_heads([(w, 0, 0, 1) for w in words], 1, who), who)
    good = codec.encode_heads([("A", 0, 0, 1), ("a", 0, 1, 1)], 1, who)
    for at in (4, 8, 12, 24 + 8, 24 + 16, len(good) - 3):
        with pytest.raises(codec.Malformed):
            codec.decode_heads(good[:at] + b"\xff\xff" + good[at + 2 :], who)


def test_a_case_pair_on_the_edge_of_two_groups():
    who = codec.Identity()
    words = sorted([f"k{i:03d}" for i in range(255)] + ["Zed", "zed", "zz"], key=codec.sort_key)
    data = codec.encode_heads([(w, 0, i, 1) for i, w in enumerate(words)], 1, who)
    h = codec.Heads(lambda at, n: data[at : at + n], len(data), who)
    for i, w in enumerate(words):
        g = h.group_of(w)
        assert [r[0] for r in h.rows(g, g + 1) if r[1] == w] == [i]
    assert h.group_of("a") is None


@pytest.mark.parametrize("text", ["a=b|c=d", "a||b", "|a", "a|", r"a\|b|c", "a\\", "", None, "a\n", "a\\\\|b"])
def test_feature_keys_are_those_of_the_expression(spark, text):
    from lexframe.functions import text as T

    assert spark.createDataFrame([(text,)], "f string").select(T.feats("f")).collect()[0][0] == pack.feature_keys(text)
