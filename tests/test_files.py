import json

from pyspark.sql import functions as F

from lexframe.sources import files, pack

PAGE = """<div class="headline priority"><span class="headword"><ruby>寿<rt>す</rt></ruby>し<span class="priority-symbol">★</span></span></div>
<ul><li class="gloss">sushi</li><li class="gloss">rice &amp; fish</li><li class="forms"><table><tr class="forms-header-row"><th></th><th>寿司</th><th>鮨</th></tr>
<tr class="forms-body-row"><th>すし</th><td></td><td class="form-rare">✓</td></tr><tr class="forms-body-row"><th>スシ</th><td><span class="form-pri">△</span></td><td></td></tr></table></li></ul>"""


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"headword": "x", "tags": ["1"]}, {"headword": "y"}]))
    (tmp_path / "b.json").write_text(json.dumps({"entries": [{"headword": "x", "tags": ["2"]}]}))
    rows = {r["headword"]: json.loads(r["body"]) for r in files.documents(spark, str(tmp_path)).collect()}
    assert rows == {"x": {"headword": "x", "tags": ["1"]}, "y": {"headword": "y"}}


def test_registry(spark):
    r = files.registry(spark, '[[packs]]\ncombo = "en|es,zh"\nid = "1"\nname = "N"\n')
    one = spark.createDataFrame([("en", ["zh", "es"])], "s string, t array<string>").select(files.combo(F.col("s"), F.col("t")).alias("combo"))
    assert one.join(r, "combo").collect()[0]["id"] == "1"


def test_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id bigint, html string")
    assert [tuple(r) for r in files.page_forms(pages).collect()] == [(1, "鮨", "すし", "rare"), (1, "寿司", "スシ", "pri")]
    row = files.page_entries(pages).where("page_id = 1").collect()[0]
    assert (row["priority"], row["written"], row["reading"], row["glosses"]) == (True, "寿し", "すし", "sushi\u001frice & fish")


def test_modes_media_and_dump(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", json.dumps({"etymologies": [{"root": "r", "senses": [{"pos": "NOUN", "definitions": [{"Definition": {"value": "d"}}]}]}]}))], "ord bigint, headword string, body string")
    media = spark.createDataFrame([(0, "audio", "mp3", "audio/mpeg", "zstd", b"DATA")], "ord bigint, kind string, ext string, mime string, compression string, bytes binary")
    path = str(tmp_path / "p")
    pack.write_pack(docs, path, {"id": "x", "name": "n", "source_lang": "en"}, media)
    eager, lazy = files.opened(spark, path), files.opened(spark, path, "lazy")
    assert eager.collect() == lazy.collect() and eager.is_cached and not lazy.is_cached
    assert [r["line"] for r in files.dump(lazy).orderBy("n").collect()] == ["a", "  ety: r", "    sense: NOUN", "      definition: d"]
    assert files.extract_media(files.opened(spark, path, "lazy", "media"), str(tmp_path / "out")) == 1
    name = f"media/audio/{pack.digest(b'DATA')[:2]}/{pack.digest(b'DATA')}.mp3"
    assert (tmp_path / "out" / name).read_bytes() == b"DATA"
