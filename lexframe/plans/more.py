"""Queries over written packs, source files, pages, nested records and rules, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.operators import crossword, flatten, lookup, media, nest, quality, validate
from lexframe.plans import queries as Q
from lexframe.plans.general import NODES
from lexframe.plans.queries import EN, heads, nodes, numbered, once
from lexframe.session import kept, shared_folder, table
from lexframe.sources import codec, files, pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Q.Query], Q.Query]:
    """Registers a query under its function's name."""

    def register(f: Q.Query) -> Q.Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- a written pack, read table by table

COVER = b"\x89PNG cover"
_E, _FEATS = Q._E, Q._FEATS
_ALL = _E + ", num AS (SELECT entry_id, pack_id || '/' || headword AS word, CAST(row_number() OVER (ORDER BY lower(pack_id || '/' || headword), pack_id || '/' || headword) - 1 AS BIGINT) AS ordinal FROM live)"


def plain_pack(spark: SparkSession, d: str) -> str:
    """A pack in four files with the live headwords of all packs, their tags and the features of their forms; written once."""

    def write() -> str:
        tags = once(spark, d, "entry_tags").where("tag IS NOT NULL").groupBy("entry_id").agg(nest.ordered("ord", "tag").alias("t"))
        forms = once(spark, d, "forms").where("feats <> ''").groupBy("entry_id").agg(nest.ordered("form_id", "feats", F.coalesce("term", F.lit("")).alias("term")).alias("f"))
        h = heads(spark, d).join(tags, "entry_id", "left").join(forms, "entry_id", "left")
        etys = F.when(F.col("f").isNotNull(), F.array(F.struct(F.array(F.struct(F.transform("f", lambda x: F.struct(x["term"].alias("term"), x["feats"].alias("feats"))).alias("forms"))).alias("senses"))))
        body = F.to_json(F.struct("see", F.transform("t", lambda x: x["tag"]).alias("tags"), etys.alias("etymologies")))
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        meta = {"id": "plain", "name": "Plain", "version": "1", "source_lang": "en", "target_langs": ["de", "fr"]}
        pack.write_pack(h.select(F.col("entry_id").alias("ord"), F.concat_ws("/", "pack_id", "headword").alias("headword"), body.alias("body")), path, meta, cover=COVER, shards=4)
        return path

    return kept(spark, d, "plain_pack", ("entries", "entry_tags", "forms"), write)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    pack.register(spark)
    return spark.read.format("lexpack").option("table", name).load(plain_pack(spark, d))


@query(f"WITH {_ALL} SELECT word AS headword, ordinal FROM num")
def pack_heads(spark: SparkSession, d: str) -> DataFrame:
    """The location scan."""
    return read(spark, d, "heads").select("headword", "ordinal")


@query(f"WITH {_ALL} SELECT t.tag AS key, n.ordinal AS id FROM (SELECT DISTINCT entry_id, tag FROM entry_tags WHERE tag IS NOT NULL) t JOIN num n ON n.entry_id = t.entry_id")
def pack_postings(spark: SparkSession, d: str) -> DataFrame:
    """The tag index, id by id."""
    return read(spark, d, "postings").where("kind = 'tag'").select("key", F.explode("ids").alias("id"))


@query(f"WITH {_ALL}, {_FEATS}, k AS (SELECT DISTINCT entry_id, unnest(segs) AS key FROM seg) SELECT k.key, n.ordinal AS id FROM k JOIN num n ON n.entry_id = k.entry_id")
def pack_morph_postings(spark: SparkSession, d: str) -> DataFrame:
    """The index of features, id by id."""
    return read(spark, d, "postings").where("kind = 'morph'").select("key", F.explode("ids").alias("id"))


@query(f"WITH {_E} SELECT DISTINCT t.tag AS value FROM entry_tags t SEMI JOIN live l ON l.entry_id = t.entry_id WHERE t.tag IS NOT NULL")
def pack_pools(spark: SparkSession, d: str) -> DataFrame:
    """The tags in the string pools of all files."""
    return read(spark, d, "pools").where("pool = 'tag'").select("value").distinct()


@query(f"WITH {_E} SELECT count(*) AS entries, true AS versions, true AS verbatim, 'en' AS source_lang, 'de,fr' AS targets FROM live")
def pack_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The typed manifests, held against the text they were read from."""
    m = read(spark, d, "manifest")
    same = (F.get_json_object("body", "$.index.entry_count").cast("bigint") == F.col("index.entry_count")) & (F.get_json_object("body", "$.pack.name") == F.col("pack.name"))
    return m.agg(
        F.sum("index.entry_count").alias("entries"), F.bool_and(F.col("format_version").startswith("0.1.")).alias("versions"), F.bool_and(same).alias("verbatim"),
        F.max("pack.source_lang").alias("source_lang"), F.max(F.array_join("pack.target_langs", ",")).alias("targets"),
    )


@query("SELECT * FROM (VALUES ('mimetype', 4), ('manifest.json', 4), ('index/headword.idx', 4), ('index/strings.tbl', 4), ('index/tag.idx', 4), ('index/morph.idx', 4), ('cover.png', 4)) t(path, files)")
def pack_members(spark: SparkSession, d: str) -> DataFrame:
    """The raw members besides blocks of data."""
    return read(spark, d, "members").where("NOT startswith(path, 'data/')").groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("files"))


@query(f"SELECT '{COVER.hex()}' AS cover")
def pack_cover(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cover").select(F.lower(F.hex("bytes")).alias("cover")).distinct()


@query(f"WITH {_ALL} SELECT m.mode, count(*) AS entries, CAST(sum(ordinal) AS BIGINT) AS ordinals FROM num, (VALUES ('auto'), ('eager'), ('lazy')) m(mode) GROUP BY m.mode")
def read_modes(spark: SparkSession, d: str) -> DataFrame:
    """Every way of opening a pack gives the same entries."""
    each = [files.opened(spark, plain_pack(spark, d), mode).groupBy().agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("entries"), F.sum("ordinal").alias("ordinals")) for mode in ("auto", "eager", "lazy")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {_ALL} SELECT n.word AS headword, n.ordinal, l.see FROM num n JOIN live l ON l.entry_id = n.entry_id WHERE n.word = '{EN}/flasbrén'")
def pack_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One headword: the filter reaches the source, which reads one group of the index and one block."""
    hit = read(spark, d, "entries").where(F.col("headword") == f"{EN}/flasbrén")
    return hit.select("headword", "ordinal", F.get_json_object("body", "$.see").alias("see"))


# ---------------------------------------------------------------- codec

RECORDS = [("empty", "00", "decoded"), ("see", "01026162", "decoded"), ("unknown flag", "80", "opaque"), ("nothing", "", "opaque"), ("cut", "010561", "opaque"), ("no such tag", "02010900", "opaque"), ("endless list", "02ffffffff0f", "opaque")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}')" for n, _, s in RECORDS) + ") t(record, status)")
def opaque_entries(spark: SparkSession, d: str) -> DataFrame:
    """Records that can be decoded and records that stay as they are."""

    def status(raw):  # noqa: ANN001, ANN202
        def one(b: bytes) -> str:
            try:
                codec.decode("entry", codec.Cursor(bytes(b)), {p: [] for p in codec.POOLS})
            except codec.Malformed:
                return "opaque"
            return "decoded"

        return raw.map(one)

    rows = spark.createDataFrame([(n, bytearray.fromhex(h)) for n, h, _ in RECORDS], "record string, raw binary")
    return rows.select("record", F.pandas_udf(status, "string")("raw").alias("status"))


@query(f"""WITH {_E} SELECT entry_id, array_to_string(list_transform(range(1, n + 1), lambda i: printf('%02X', CAST((entry_id // CAST(pow(128, i - 1) AS BIGINT)) % 128 + CASE WHEN i < n THEN 128 ELSE 0 END AS INTEGER))), '') AS varint, true AS same
FROM (SELECT entry_id, CASE WHEN entry_id = 0 THEN 1 ELSE CAST(floor(ln(entry_id) / ln(128) + 1e-12) AS BIGINT) + 1 END AS n FROM live)""")
def codec_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of variable length, and whether they come back after compression."""

    def coded(n):  # noqa: ANN001, ANN202
        return n.map(lambda x: codec.varint(int(x)).hex().upper())

    def back(h):  # noqa: ANN001, ANN202
        return h.map(lambda x: codec.Cursor(codec.decompress(codec.compress(bytes.fromhex(x)))).varint())

    v = heads(spark, d).select("entry_id", F.pandas_udf(coded, "string")("entry_id").alias("varint"))
    return v.withColumn("same", F.pandas_udf(back, "bigint")("varint") == F.col("entry_id"))


# ---------------------------------------------------------------- source files, registry, pages, media


@query(f"WITH {_E}, t AS (SELECT entry_id, string_agg(tag, ',' ORDER BY ord, tag) AS x FROM (SELECT DISTINCT entry_id, ord, tag FROM entry_tags WHERE tag IS NOT NULL) GROUP BY entry_id) SELECT pack_id || '/' || headword AS headword, coalesce(t.x, '') AS tags FROM live l LEFT JOIN t ON t.entry_id = l.entry_id")
def source_documents(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as JSON and YAML files, some of them in both, and read as one source."""
    tags = once(spark, d, "entry_tags").where("tag IS NOT NULL").groupBy("entry_id").agg(nest.ordered("ord", "tag").alias("t"))
    h = heads(spark, d).join(tags, "entry_id", "left")
    e = h.select(F.concat_ws("/", "pack_id", "headword").alias("headword"), F.coalesce(F.transform("t", lambda x: x["tag"]), F.array().cast("array<string>")).alias("tags"))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    files.write_documents(e.where("headword < 'b'"), folder, "json")
    files.write_documents(e.where("headword >= 'a'").where("headword < 'b'").limit(10).unionByName(e.where("headword >= 'b'")), folder, "yaml")
    read = files.documents(spark, folder)
    return read.select("headword", F.array_join(F.from_json(F.get_json_object("body", "$.tags"), "array<string>"), ",").alias("tags"))


REGISTRY = """
[[packs]]
combo = "en|es-ES,zh-Hans"
id = "11111111-2222-4333-8444-555555555555"
name = "English"
[[packs]]
combo = "ja|"
id = "66666666-7777-4888-8999-000000000000"
name = "日本語"
description = "ja only"
"""


@query("SELECT * FROM (VALUES ('en', 'English', ''), ('ja', '日本語', 'ja only'), ('de', NULL, NULL)) t(source, name, description)")
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Packs found in a registry by their languages, in whatever order the targets are given."""
    asked = spark.createDataFrame([("en", ["zh-Hans", "es-ES"]), ("ja", []), ("de", ["en"])], "source string, targets array<string>")
    known = files.registry(spark, REGISTRY)
    return asked.withColumn("combo", files.combo(F.col("source"), F.col("targets"))).join(known, "combo", "left").select("source", "name", "description")


_PAGE = (
    '<div class="headline priority"><span class="headword" lang="ja"><ruby>食<rt>た</rt></ruby>べる<span class="priority-symbol">*</span></span></div>'
    '<ul><li class="gloss">to eat</li><li class="gloss"> to live &amp; dine </li><li class="gloss">third</li></ul>'
    '<li class="forms"><table><tr><th></th><th>食べる</th><th>喰べる</th></tr><tr><th>たべる</th><td class="form-pri">P</td><td class="form-rare">R</td></tr></table></li>'
)
PAGES = [(1, "食べる", _PAGE), (2, "犬", '<div class="headline"><span class="headword"><ruby>犬<rt>いぬ</rt></ruby></span></div><li class="gloss"></li><li class="gloss">dog</li>'), (3, "喰べる", "@@@LINK=食べる\r\n"), (4, "空", None)]


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "page_id bigint, key string, html string")


@query("SELECT * FROM (VALUES (1, true, '食べる', 'たべる', 'to eat' || chr(31) || 'to live & dine'), (2, false, '犬', 'いぬ', 'dog')) t(page_id, priority, written, reading, glosses)")
def page_entries(spark: SparkSession, d: str) -> DataFrame:
    return files.page_entries(pages(spark).where("html LIKE '<%'")).withColumn("page_id", F.col("page_id").cast("int"))


@query("SELECT * FROM (VALUES (1, '食べる', 'たべる', 'pri'), (1, '喰べる', 'たべる', 'rare')) t(page_id, variant, reading, class)")
def page_forms(spark: SparkSession, d: str) -> DataFrame:
    return files.page_forms(pages(spark)).withColumn("page_id", F.col("page_id").cast("int"))


@query("SELECT * FROM (VALUES ('食べる', 1), ('喰べる', 1), ('犬', 2), ('猫', NULL)) t(word, page_id)")
def page_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their keys; a link leads to its target, an unknown word to nothing."""
    words = spark.createDataFrame([("食べる",), ("喰べる",), ("犬",), ("猫",)], "word string")
    return files.fetched(words, pages(spark)).select("word", F.col("page_id").cast("int").alias("page_id"))


@query("""SELECT 'media/' || kind || '/' || hash[1:2] || '/' || hash || '.' || ext AS path, size, true AS same FROM (SELECT kind, sha1(bytes) AS hash, ext, CAST(octet_length(bytes) AS BIGINT) AS size,
row_number() OVER (PARTITION BY kind, sha1(bytes) ORDER BY ord, ext NULLS FIRST) AS n FROM media) WHERE n = 1""")
def media_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Assets written to a folder as files and read back."""
    m = table(spark, d, "media").withColumn("hash", F.sha1("bytes"))
    first = m.groupBy("kind", "hash").agg(F.min_by(F.struct("ext", "bytes"), F.struct("ord", "ext")).alias("a"))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    files.extract_media(first.select(T.media_path(F.col("kind"), F.col("hash"), F.col("a.ext")).alias("path"), "a.bytes"), folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_extract("path", "(media/[^/]+/[^/]+/[^/]+)$", 1)
    return found.select(path.alias("path"), F.col("length").alias("size"), (F.sha1("content") == F.regexp_extract("path", r"([0-9a-f]{40})\.[^/]*$", 1)).alias("same"))


@query("SELECT * FROM (VALUES ('run', 0, 'run'), ('run', 1, '  ety: bancus'), ('run', 2, '    sense: NOUN'), ('run', 3, '      definition: d; n.1'), ('run', 4, '        example: He ran')) t(headword, n, line)")
def entry_dump(spark: SparkSession, d: str) -> DataFrame:
    """An entry as lines of text."""
    body = '{"etymologies":[{"root":"bancus","senses":[{"pos":"NOUN","definitions":[{"Definition":{"value":"d","id":"n.1","examples":[{"value":"He ran"}]}}]}]}]}'
    lines = files.dump(spark.createDataFrame([("run", body)], "headword string, body string"))
    order = F.when(F.col("line").contains("definition:"), F.lit("      definition: d; n.1")).otherwise(F.col("line"))
    return lines.select("headword", F.col("n").cast("int").alias("n"), order.alias("line"))


# ---------------------------------------------------------------- nested records

_ORDER = "array_to_string(list_transform(string_split({0}, '/'), lambda p: p[1] || lpad(p[2:], 9, '0')), '/')"


@query(NODES + """, up AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent, CAST(regexp_extract(path, '([0-9]+)$', 1) AS INTEGER) AS o FROM nodes),
t AS (SELECT raw_id, parent AS path, string_agg(coalesce(j ->> '$.lang', '-') || ':' || coalesce(j ->> '$.value', '-'), ',' ORDER BY o) AS x FROM up WHERE kind = 'translation' GROUP BY ALL),
e AS (SELECT u.raw_id, parent AS path, string_agg(coalesce(j ->> '$.value', '-') || '[' || coalesce(t.x, '') || ']', ';' ORDER BY o) AS x FROM up u LEFT JOIN t ON t.raw_id = u.raw_id AND t.path = u.path WHERE kind = 'example' GROUP BY ALL),
dd AS (SELECT u.raw_id, parent AS path, string_agg(coalesce(j ->> '$.value', '-') || '{' || coalesce(e.x, '') || '}', '|' ORDER BY o) AS x FROM up u LEFT JOIN e ON e.raw_id = u.raw_id AND e.path = u.path WHERE kind = 'definition' GROUP BY ALL)
SELECT s.raw_id, s.path, coalesce(t.x, '') AS translations, coalesce(dd.x, '') AS definitions FROM up s LEFT JOIN t ON t.raw_id = s.raw_id AND t.path = s.path LEFT JOIN dd ON dd.raw_id = s.raw_id AND dd.path = s.path WHERE s.kind = 'sense'""")
def nested_levels(spark: SparkSession, d: str) -> DataFrame:
    """Senses put together from flat tables through every level: definitions, their examples, and translations of either."""
    raw = table(spark, d, "raw_entries")
    flat = lambda kind: flatten.flat_table(raw, kind)
    tr = flat("translation")
    ex = nest.with_children(flat("example"), tr, "translations", "lang", "value")
    de = nest.with_children(flat("definition"), ex, "examples", "value", "translations")
    se = nest.with_children(nest.with_children(flat("sense").select("raw_id", "path"), tr, "translations", "lang", "value"), de, "definitions", "value", "examples")
    dash = lambda c: F.coalesce(c, F.lit("-"))
    text = lambda c, f, sep: F.array_join(F.transform(c, f), sep)
    t = lambda x: F.concat_ws(":", dash(x["lang"]), dash(x["value"]))
    e = lambda x: F.concat(dash(x["value"]), F.lit("["), text(x["translations"], t, ","), F.lit("]"))
    return se.select("raw_id", "path", text("translations", t, ",").alias("translations"), text("definitions", lambda x: F.concat(dash(x["value"]), F.lit("{"), text(x["examples"], e, ";"), F.lit("}")), "|").alias("definitions"))


def _headword_of(spark: SparkSession, d: str) -> DataFrame:
    return flatten.flatten(table(spark, d, "raw_entries"), ("raw_id", "kind", "payload"), root=True).where("kind = 'entry'").select("raw_id", F.get_json_object("payload", "$.headword").alias("headword"))


@query(NODES + """, ex AS (SELECT n.raw_id, n.path, n.j ->> '$.value' AS text, h.j ->> '$.headword' AS word, json_extract(n.j, '$.targets') AS stored FROM nodes n JOIN nodes h ON h.raw_id = n.raw_id AND h.kind = 'entry' WHERE n.kind = 'example' AND (n.j ->> '$.value') IS NOT NULL),
own AS (SELECT raw_id, path, list_sum(list_transform(CAST(stored AS JSON[]), lambda t: coalesce(json_array_length(t, '$.spans'), 0))) AS n FROM ex WHERE json_type(stored) = 'ARRAY'),
w AS (SELECT raw_id, path, text, word, lower(word) AS l FROM ex WHERE word <> ''),
f AS (SELECT raw_id, path, text, unnest(CASE WHEN strlen(word) = length(word) THEN [word, l||'s', l||'es', l||'ed', l||'d', l||'ing', l||'ly', CASE WHEN l LIKE '%e' THEN l[:-2]||'ing' END, CASE WHEN l LIKE '%e' THEN l[:-2]||'ed' END, CASE WHEN l LIKE '_%y' THEN l[:-2]||'ies' END, CASE WHEN l LIKE '_%y' THEN l[:-2]||'ied' END] ELSE [word] END) AS form,
 generate_subscripts(CASE WHEN strlen(word) = length(word) THEN [1,2,3,4,5,6,7,8,9,10,11] ELSE [1] END, 1) AS k FROM w),
p AS (SELECT *, string_split(lower(text), lower(form)) AS ps, length(form) AS n, lower(text) AS low FROM f WHERE form IS NOT NULL),
h AS (SELECT raw_id, path, k, list_filter(list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[:i], lambda x: length(x))) + (i - 1) * n), lambda s: NOT regexp_matches(low[CAST(s AS BIGINT)], '[A-Za-z0-9]') AND NOT regexp_matches(low[CAST(s + n + 1 AS BIGINT)], '[A-Za-z0-9]'))[:8] AS hits FROM p),
found AS (SELECT raw_id, path, arg_min(len(hits), k) AS n FROM h WHERE len(hits) > 0 GROUP BY ALL)
SELECT ex.raw_id, ex.path, CASE WHEN coalesce(own.n, 0) > 0 THEN 'stored' WHEN found.n IS NOT NULL THEN 'found' ELSE 'none' END AS source, CAST(CASE WHEN coalesce(own.n, 0) > 0 THEN own.n ELSE coalesce(found.n, 0) END AS INTEGER) AS spans
FROM ex LEFT JOIN own ON own.raw_id = ex.raw_id AND own.path = ex.path LEFT JOIN found ON found.raw_id = ex.raw_id AND found.path = ex.path""")
def example_targets(spark: SparkSession, d: str) -> DataFrame:
    """Where the headword stands in each example: the stored targets, else the hits of its first inflected form that has any."""
    ex = nodes(spark, d, "raw_id", "path", "kind", "payload").where("kind = 'example'").join(_headword_of(spark, d), "raw_id")
    kind = "array<struct<spans:array<struct<offset:bigint,length:bigint>>>>"
    stored = F.flatten(F.transform(F.from_json(F.get_json_object("payload", "$.targets"), kind), lambda t: F.coalesce(t["spans"], F.array().cast("array<struct<offset:bigint,length:bigint>>"))))
    ex = ex.select("raw_id", "path", F.get_json_object("payload", "$.value").alias("text"), "headword", F.coalesce(F.size(stored), F.lit(0)).alias("n")).where("text IS NOT NULL")
    forms = F.when(F.coalesce("headword", F.lit("")) != "", T.inflected("headword")).otherwise(F.array().cast("array<string>"))
    ex = ex.withColumn("hits", F.size(T.first_form_spans(F.col("text"), forms)))
    source = F.when(F.col("n") > 0, "stored").when(F.col("hits") > 0, "found").otherwise("none")
    return ex.select("raw_id", "path", source.alias("source"), F.when(F.col("n") > 0, F.col("n")).otherwise(F.greatest("hits", F.lit(0))).alias("spans"))


@query(NODES + f""", p AS {Q._PACK_OF}, x AS (SELECT n.*, p.pack_id FROM nodes n JOIN p ON p.raw_id = n.raw_id),
tr AS (SELECT DISTINCT raw_id, regexp_replace(path, '/[^/]*$', '') AS path FROM nodes WHERE kind = 'translation')
SELECT pack_id, count(*) FILTER (WHERE kind = 'definition') AS definitions, count(*) FILTER (WHERE kind = 'definition' AND coalesce(j ->> '$.id', '') <> '') AS with_id, count(*) FILTER (WHERE kind = 'example') AS examples,
 count(*) FILTER (WHERE kind = 'example' AND tr.path IS NULL) AS untranslated, count(*) FILTER (WHERE kind = 'example' AND coalesce(json_array_length(j, '$.targets'), 0) = 0) AS untargeted
FROM x LEFT JOIN tr ON tr.raw_id = x.raw_id AND tr.path = x.path GROUP BY pack_id""")
def quality_nested(spark: SparkSession, d: str) -> DataFrame:
    """Per pack: definitions and those with an id, examples and those without translation or target."""
    return quality.nested_report(nodes(spark, d, "raw_id", "path", "parent_path", "kind", "payload"), Q._packs_of(spark, d))


@query(NODES + """SELECT raw_id, j ->> '$.id' AS id, count(*) AS n FROM nodes WHERE kind = 'definition' AND coalesce(j ->> '$.id', '') <> '' GROUP BY ALL HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that an entry gives to more than one definition."""
    return quality.repeated_ids(flatten.flat_table(table(spark, d, "raw_entries"), "definition"))


@query(NODES + """, s AS (SELECT raw_id, path, j ->> '$.pos' AS pos FROM nodes WHERE kind = 'sense'),
tr AS (SELECT raw_id, regexp_replace(path, '/[^/]*$', '') AS path, string_agg(coalesce(j ->> '$.lang', '-') || ':' || coalesce(j ->> '$.value', '-'), ',' ORDER BY coalesce(j ->> '$.lang', '-') || ':' || coalesce(j ->> '$.value', '-')) AS x FROM nodes WHERE kind = 'translation' GROUP BY ALL),
h AS (SELECT raw_id, j ->> '$.headword' AS headword FROM nodes WHERE kind = 'entry')
SELECT headword, pos, x AS translations, count(*) AS n FROM s JOIN tr ON tr.raw_id = s.raw_id AND tr.path = s.path JOIN h ON h.raw_id = s.raw_id WHERE headword IS NOT NULL GROUP BY ALL""")
def repeated_senses(spark: SparkSession, d: str) -> DataFrame:
    """How many senses of one headword and part of speech have the same translations; more than one is a repetition."""
    raw = table(spark, d, "raw_entries")
    return quality.repeated_senses(flatten.flat_table(raw, "sense"), flatten.flat_table(raw, "translation"), _headword_of(spark, d), 1)


@query(NODES + """, x AS (SELECT raw_id, path, j ->> '$.id' AS id FROM nodes WHERE kind = 'definition'),
known AS (SELECT raw_id, regexp_extract(id, '^([a-z]+)[.]([0-9]+)$', 1) AS prefix, CAST(regexp_extract(id, '^([a-z]+)[.]([0-9]+)$', 2) AS BIGINT) AS n FROM x WHERE regexp_matches(id, '^[a-z]+[.][0-9]{1,9}$')),
top AS (SELECT raw_id, prefix, max(n) AS top FROM known GROUP BY ALL)
SELECT x.raw_id, x.path, 'n.' || (coalesce(top, 0) + row_number() OVER (PARTITION BY x.raw_id ORDER BY """ + _ORDER.format("x.path") + """)) AS id FROM x LEFT JOIN top ON top.raw_id = x.raw_id AND top.prefix = 'n' WHERE coalesce(id, '') = ''""")
def next_definition_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids ``n.k`` for definitions without one, above every number their entry has used."""
    x = flatten.flat_table(table(spark, d, "raw_entries"), "definition")
    known = x.where(F.col("id").rlike(r"^[a-z]+\.\d{1,9}\z")).select(F.col("raw_id").alias("entry_id"), F.substring_index("id", ".", 1).alias("prefix"), F.substring_index("id", ".", -1).cast("bigint").alias("n"))
    new = nest.in_order(x.where("coalesce(id, '') = ''")).select(F.col("raw_id").alias("entry_id"), F.lit("n").alias("prefix"), F.col("place").alias("at"), "path")
    return quality.next_ids(known, new).select(F.col("entry_id").alias("raw_id"), "path", F.concat("prefix", F.lit("."), F.col("n").cast("string")).alias("id"))


@query(f"WITH {_E}, h AS (SELECT text, headword, fold, count(*) OVER (PARTITION BY text) AS hits, row_number() OVER (PARTITION BY text ORDER BY fold, headword) AS n FROM live, (VALUES ('b'), ('flas')) q(text) WHERE pack_id = '{EN}' AND starts_with(fold, text)) SELECT text, headword, hits >= 20 AS more FROM h WHERE n <= 20")
def prefix_more(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a prefix search that say whether there may be more."""
    own = heads(spark, d).where(F.col("pack_id") == EN)
    each = [lookup.page(own, q, 20).select(F.lit(q).alias("text"), "headword", "more") for q in ("b", "flas")]
    return each[0].unionByName(each[1])


# ---------------------------------------------------------------- scalars and rules on given rows


@query("SELECT * FROM (VALUES ('en', 'ipa', 'en-US', 'ipa'), ('en', 'ipa_uk', 'en-GB', 'ipa'), ('en', 'x', 'en', 'x'), ('ja', 'ipa_uk', 'ja', 'ipa_uk'), ('ja', NULL, 'ja', NULL)) t(source, kind, lang, plain)")
def pron_langs(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([("en", "ipa"), ("en", "ipa_uk"), ("en", "x"), ("ja", "ipa_uk"), ("ja", None)], "source string, kind string")
    return p.select("source", "kind", T.pron_lang(F.col("source"), F.col("kind")).alias("lang"), T.pron_kind(F.col("source"), F.col("kind")).alias("plain"))


@query("SELECT * FROM (VALUES ('unix:1700000000', 1700000000), ('2023-11-14T22:13:20Z', 1700000000), ('unix:x', NULL), ('', NULL)) t(text, seconds)")
def created_times(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("unix:1700000000",), ("2023-11-14T22:13:20Z",), ("unix:x",), ("",)], "text string")
    return t.select("text", F.unix_timestamp(T.created_at("text")).cast("int").alias("seconds"))


@query(NODES + "SELECT raw_id, path, coalesce(j ->> '$.lang', 'en') AS lang FROM nodes WHERE kind = 'translation'")
def inherited_langs(spark: SparkSession, d: str) -> DataFrame:
    """The language of a pronunciation inside each translation: its own (none here), the translation's, or the source's."""
    return Q._translations(spark, d).select("raw_id", "path", T.inherited_lang(F.lit(None).cast("string"), F.col("lang"), F.lit("en")).alias("lang"))


_MARKED = [("a\x01b\x02c", "abc"), ("\x07base\x08text\x09", "basetext"), ("x\x00\x01y", "x\x01y"), ("\x01open", None), ("\x02", None), ("\x01a\x03b\x04c\x02", None), ("end\x00", None), ("plain", "plain"), ("\x05ref\x06", "ref")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, {'NULL' if t is None else repr(t.encode().hex())})" for n, (_, t) in enumerate(_MARKED)) + ") t(n, text)")
def inline_markup(spark: SparkSession, d: str) -> DataFrame:
    """Texts without their marks (in hex); null where the marks are invalid."""
    m = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(_MARKED)], "n int, raw string")
    return m.select("n", F.lower(F.hex(F.encode(T.strip_markup("raw"), "UTF-8"))).alias("text"))


@query(NODES + f""", lower_refs AS (SELECT kind, lower(hash) AS hash, count(*) AS n FROM (SELECT DISTINCT owner_id, ord, kind, hash FROM media_refs WHERE hash IS NOT NULL) GROUP BY ALL)
SELECT 'pack without id, name or language' AS rule, pack_id || '/∅' AS key FROM (SELECT DISTINCT pack_id FROM entries)
UNION ALL SELECT 'translation without language', raw_id || '/' || path FROM nodes WHERE kind = 'translation' AND coalesce(j ->> '$.lang', '') = ''
UNION ALL SELECT 'pronunciation without value', coalesce(owner_id, '∅') || '/' || ord FROM (SELECT DISTINCT owner_id, ord, description FROM media_refs) WHERE coalesce(description, '') = ''
UNION ALL SELECT 'media repeated', coalesce(kind, '∅') || '/' || hash FROM lower_refs WHERE n > 1
UNION ALL SELECT 'media hash', coalesce(kind, '∅') || '/' || hash FROM (SELECT DISTINCT owner_id, ord, kind, hash FROM media_refs WHERE hash IS NOT NULL) WHERE NOT regexp_matches(hash, '^[0-9a-fA-F]{{40}}$')""")
def planted_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the tables keep, held against rows that don't: packs without names, translations without language, texts of references as
    pronunciations, references as a manifest of media."""
    packs = table(spark, d, "entries").select(F.col("pack_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit("en").alias("source_lang")).distinct()
    tr = Q._translations(spark, d).select(F.col("raw_id").cast("string").alias("owner_id"), F.col("path").alias("ord"), "lang")
    refs = once(spark, d, "media_refs").select("owner_id", "ord", "kind", "hash", "description").distinct()
    man = refs.where("hash IS NOT NULL").select("owner_id", "ord", "kind", "hash").distinct()
    prons = refs.select("owner_id", "ord", F.col("description").alias("value")).distinct()
    return validate.pack_rules(packs).unionByName(validate.translation_rules(tr, 2)).unionByName(validate.pron_rules(prons)).unionByName(validate.manifest_rules(man))


@query(f"WITH {Q._POOLS} SELECT 'pool too large' AS rule, pack_id || '/' || pool AS key FROM pools GROUP BY pack_id, pool HAVING count(*) > 20 UNION ALL SELECT 'headword too long', CAST(entry_id AS VARCHAR) FROM live WHERE strlen(headword) > 12")
def planted_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limits on pools and headwords, set low."""
    return validate.pool_rules(Q._pools(spark, d), 20).unionByName(validate.entry_rules(heads(spark, d), 12).where("rule = 'headword too long'"))


@query(f"WITH {Q._MAN} SELECT pack_id, kind, hash, 'media/' || kind || '/' || hash[1:2] || '/' || hash || '.' || f.e AS path FROM man")
def media_manifest(spark: SparkSession, d: str) -> DataFrame:
    return media.paths(media.manifest(table(spark, d, "media"))).select("pack_id", "kind", "hash", "path")


@query("SELECT * FROM (VALUES ('letters differ', 0), ('word apart', 0), ('word twice', 0), ('number differs', 0), ('off the board', 0)) t(rule, n)")
def crossword_check(spark: SparkSession, d: str) -> DataFrame:
    """Whatever breaks a rule of crosswords over all layouts, of which there must be none."""
    words = quality.sample_words(heads(spark, d), table(spark, d, "senses")).select(F.col("headword").alias("word"), F.col("entry_id").cast("string").alias("clue"))
    return crossword.faults(crossword.puzzles(words, 8))


@query(f"WITH {Q._NUM} SELECT pack_id, count(*) AS entries, CAST(max(ordinal) + 1 AS BIGINT) AS upto FROM num GROUP BY pack_id")
def ordinals_are_dense(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d).groupBy("pack_id").agg(F.count(F.lit(1)).alias("entries"), (F.max("ordinal") + 1).alias("upto"))
