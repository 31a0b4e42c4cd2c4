"""Packs: dictionaries in one file or in a folder of such files, as a Spark data source and sink.

``spark.read.format("lexpack").option("table", ...).load(path)`` reads the tables entries, heads,
pools, postings, manifest, media, cover and members. A task gets a range of the headword index and reads
that range of the file and the data blocks it points to, nothing else; a look-up halves the directory
down. ``write_pack`` gives each range of headwords to one task, which writes a whole file of it; the
driver only lists the files. Paths may be of any file system that Arrow knows.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from lexframe.functions import text as T
from lexframe.functions.jsontree import canonical, loads
from lexframe.operators import index, validate
from lexframe.session import stored
from lexframe.sources import codec
from lexframe.sources.codec import Identity, Malformed

SHARD = 250_000  # entries of one file, where the caller sets no number of files
LISTING = "_files.json"
_MANIFEST = (
    "format string, format_version string, pack struct<id:string,name:string,version:string,description:string,created_at:string,source_lang:string,target_langs:array<string>,cover:string>, strings_file string, "
    "index struct<headword_file:string,entry_count:bigint,block_count:bigint>, data struct<block_max_uncompressed:bigint,compression:string,zstd_level:int,block_count:bigint>, "
    "tags struct<index_file:string,has_index:boolean,tag_count:bigint>, morph struct<index_file:string,has_index:boolean,key_count:bigint>, media struct<hash_algo:string,total_size:bigint,dedup:boolean>, body string"
)
SCHEMAS = {
    "entries": "ordinal bigint, headword string, status string, body string, raw binary",
    "heads": "ordinal bigint, headword string, block bigint, offset bigint, size bigint",
    "pools": "pool string, idx int, value string, file int",
    "postings": "kind string, key string, ids array<bigint>",
    "manifest": _MANIFEST,
    "cover": "bytes binary",
    "members": "path string, bytes binary",
    "media": "path string, kind string, hash string, ext string, mime string, compression string, bytes binary",
}


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def open_zip(path: str, who: Identity) -> zipfile.ZipFile:
    """The container, checked: the type member first, all members stored, names safe and different."""
    fs, at = _place(path)
    try:
        z = zipfile.ZipFile(at if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at))
    except (zipfile.BadZipFile, pa.ArrowInvalid) as e:
        raise Malformed("no container") from e
    members = z.infolist()
    if not members or members[0].filename != "mimetype" or z.read("mimetype") != who.mimetype:
        raise Malformed("the first member doesn't name the type")
    for m in members:
        if m.compress_type != zipfile.ZIP_STORED or not safe(m.filename):
            raise Malformed(f"member {m.filename!r} isn't stored or has an unsafe name")
    if len({m.filename for m in members}) != len(members):
        raise Malformed("a member is there twice")
    return z


def safe(name: str) -> bool:
    """Whether a member may have this name: relative, forward slashes, no steps up, no empty step."""
    return bool(name) and "\\" not in name and "\0" not in name and not ({"", ".", ".."} & set(name.split("/")))


def manifest(z: zipfile.ZipFile, who: Identity) -> tuple[dict, str]:
    """The manifest as an object and as it is written."""
    text = z.read("manifest.json").decode()
    m = json.loads(text)
    if m.get("format") != who.name or not str(m.get("format_version", "")).startswith("0.1."):
        raise Malformed("the manifest is of another format or version")
    if m["data"]["compression"] != "zstd" or m["media"]["hash_algo"] != "sha1":
        raise Malformed("the manifest has an unknown compression or hash")
    return m, text


def places(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> Callable[[int, int], bytes]:
    """Reads n bytes at a place of a stored member, wherever the file stands.

    The members that ``zipfile`` opens can't do it: some of its versions seek forward from where the last read of any member ended.
    """
    z.open(info).close()  # checks the header before the member
    z.fp.seek(info.header_offset + 26)
    start = info.header_offset + 30 + sum(struct.unpack("<HH", z.fp.read(4)))  # after its name and extra field

    def read(at: int, n: int) -> bytes:
        z.fp.seek(start + at)
        return z.fp.read(max(0, min(n, info.compress_size - at)))

    return read


class Pack:
    """One file of a pack, open: manifest, headword index and, when asked, pools; their counts are checked against each other."""

    def __init__(self, path: str, who: Identity) -> None:
        self.who, self.zip = who, open_zip(path, who)
        self.manifest, self.text = manifest(self.zip, who)
        info = self.zip.getinfo("index/headword.idx")
        self.heads = codec.Heads(places(self.zip, info), info.file_size, who)
        m = self.manifest
        if self.heads.entries != m["index"]["entry_count"] or self.heads.data_blocks != m["data"]["block_count"] or self.heads.groups != m["index"]["block_count"]:
            raise Malformed("the counts of manifest and index differ")

    def pools(self) -> dict[str, list[str]]:
        return codec.decode_pools(self.zip.read("index/strings.tbl"), self.who)

    def block(self, n: int) -> bytes:
        return codec.decompress(self.zip.read(f"data/{n:05d}.zst"))

    def media(self) -> list[dict]:
        """The media manifest, checked by its rules; none without media."""
        if "media/manifest.json" not in self.zip.NameToInfo:
            return []
        entries = json.loads(self.zip.read("media/manifest.json"))["entries"]
        keys = [(e["kind"], e["hash"].lower()) for e in entries]
        for e in entries:
            if e["kind"] not in codec.MEDIA_KINDS or e["compression"] not in validate.COMPRESSIONS or len(e["hash"]) != 40 or set(e["hash"].lower()) - set("0123456789abcdef"):
                raise Malformed(f"the media manifest has a bad row: {e['kind']} {e['hash']}")
        if len(set(keys)) != len(keys):
            raise Malformed("the media manifest has an asset twice")
        return entries


class _Part(InputPartition):
    def __init__(self, path: str, number: int, base: int, first: int, last: int) -> None:
        self.path, self.number, self.base, self.first, self.last = path, number, base, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, who: Identity) -> None:
        self.path, self.table, self.who = options["path"], options.get("table", "entries"), who
        self.step, self.word = int(options.get("groupsPerTask", "32")), None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if self.table in ("entries", "heads") and isinstance(f, EqualTo) and f.attribute == ("headword",) and self.word is None:
                self.word = f.value
            else:
                yield f

    def _files(self) -> list[dict]:
        fs, at = _place(self.path)
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            p = Pack(self.path, self.who)
            return [{"path": self.path, "base": 0, "groups": p.heads.groups, "first": p.heads.first(0) if p.heads.groups else None}]
        with fs.open_input_file(f"{at}/{LISTING}") as f:
            return [{**x, "path": f"{self.path}/{x['file']}"} for x in json.loads(f.read())]

    def partitions(self) -> list:
        files = list(enumerate(self._files()))
        if self.table not in ("entries", "heads"):
            return [_Part(f["path"], n, f["base"], 0, f["groups"]) for n, f in files]
        if self.word is None:
            parts = [_Part(f["path"], n, f["base"], g, min(g + self.step, f["groups"])) for n, f in files for g in range(0, f["groups"], self.step)]
            return parts or [_Part(files[0][1]["path"], 0, 0, 0, 0)]
        # A look-up opens the one file and reads the one group that can hold the word.
        key = codec.sort_key(self.word)
        held = [(n, f) for n, f in files if f["first"] is not None and codec.sort_key(f["first"]) <= key]
        if held:
            n, f = held[-1]
            g = Pack(f["path"], self.who).heads.group_of(self.word)
            return [_Part(f["path"], n, f["base"], g, g + 1)]
        return [_Part(files[0][1]["path"], 0, 0, 0, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        p = Pack(part.path, self.who)
        if self.table in ("entries", "heads"):
            pools, data, at = p.pools() if self.table == "entries" else None, b"", None
            for n, word, block, offset, size in p.heads.rows(part.first, part.last):
                if self.word is not None and word != self.word:
                    continue
                if pools is None:
                    yield part.base + n, word, block, offset, size
                    continue
                if block != at:
                    data, at = p.block(block), block
                if offset + size > len(data):
                    raise Malformed("an entry ends outside its block")
                raw = data[offset : offset + size]
                try:
                    body = canonical({"headword": word, **codec.decode("entry", codec.Cursor(raw), pools)})
                except Malformed:
                    yield part.base + n, word, "opaque", None, raw
                else:
                    yield part.base + n, word, "decoded", body, raw
        elif self.table == "pools":
            pools = p.pools()
            yield from ((name, i, s, part.number) for name in codec.POOLS for i, s in enumerate(pools[name], 1))
        elif self.table == "postings":
            pools = p.pools()
            for kind, member, magic in (("tag", "index/tag.idx", self.who.tags), ("morph", "index/morph.idx", self.who.morph)):
                if member in p.zip.NameToInfo:
                    for key, ids in codec.decode_postings(p.zip.read(member), magic, kind == "tag") or ():
                        yield kind, pools["tag"][key - 1] if kind == "tag" else key, [part.base + i for i in ids]
        elif self.table == "members":  # raw bytes: indexes, the cover, anything else
            yield from ((name, p.zip.read(name)) for name in p.zip.namelist())
        elif self.table == "manifest":
            yield tuple({**p.manifest, "body": p.text}.get(c.split(" ")[0]) for c in _columns(_MANIFEST))
        elif self.table == "cover":
            name = p.manifest["pack"].get("cover")
            yield (p.zip.read(name) if name in p.zip.NameToInfo else None,)
        elif self.table == "media":
            for e in p.media():
                path = f"media/{e['kind']}/{e['hash'][:2]}/{e['hash']}.{e['ext']}"
                data = p.zip.read(path)
                yield path, e["kind"], e["hash"], e["ext"], e["mime"], e["compression"], codec.decompress(data) if e["compression"] == "zstd" else data


def _columns(ddl: str) -> list[str]:
    """The columns of a schema, each as its text."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


class LexPack(DataSource):
    """The data source ``lexpack``."""

    identity = Identity()

    @classmethod
    def name(cls) -> str:
        return "lexpack"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "entries")]

    def reader(self, schema: st.StructType) -> DataSourceReader:
        return _Reader(self.options, self.identity)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LexPack)


# ---------------------------------------------------------------- writing


def feature_keys(feats: str | None) -> list[str]:
    """The segments of ``k=v|k=v``, as ``functions.text.feats`` gives them."""
    out, now, escaped = [], "", False
    for c in feats or "":
        if escaped:
            now, escaped = f"{now}\\{c}", False
        elif c == "\\":
            escaped = True
        elif c == "|":
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out


def broken(value: dict) -> str | None:
    """The first rule that an entry breaks by itself: parts of speech, pronunciations, target spans."""
    for ety in value.get("etymologies") or ():
        for sense in ety.get("senses") or ():
            if sense.get("pos") is not None and sense["pos"] not in T.UPOS:
                return f"pos {sense['pos']!r}"
            prons = [*(sense.get("pron") or ()), *(p for x in (*(sense.get("forms") or ()), *(sense.get("translations") or ())) for p in x.get("pron") or ())]
            stack = [*(sense.get("definitions") or ())]
            while stack:
                d = stack.pop()
                if "Group" in d:
                    stack += d["Group"].get("definitions") or ()
                    continue
                own = d["Definition"]
                for x in [*(own.get("examples") or ()), *(e for n in own.get("notes") or () for e in n.get("examples") or ())]:
                    prons += x.get("pron") or ()
                    if rule := validate.span_fault(x.get("value") or "", x.get("targets") or ()):
                        return rule
            if any(not p.get("value") for p in prons):
                return "pronunciation without value"
    return "pronunciation without value" if any(not p.get("value") for p in value.get("pron") or ()) else None


class _File:
    """One file being written: entries in order, then media, then ``close``."""

    def __init__(self, path: str, settings: dict) -> None:
        self.s, self.who, self.path = settings, settings["who"], path
        fs, at = _place(path)
        if isinstance(fs, pafs.LocalFileSystem):
            fs.create_dir(os.path.dirname(at) or ".", recursive=True)
            self.sink = open(at, "wb")  # noqa: SIM115
        else:
            self.sink = fs.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.names: set[str] = set()
        self.add("mimetype", self.who.mimetype)
        self.raws: list[tuple[str, bytearray, list]] = []
        self.number: dict[str, dict[str, int]] = {p: {} for p in codec.POOLS}
        self.first: dict[tuple[str, str], tuple[int, int]] = {}
        self.tags: dict[str, list[int]] = {}
        self.feats: dict[str, list[int]] = {}
        self.assets: list[dict] = []
        self.stored = 0

    def add(self, name: str, data: bytes) -> None:
        if name in self.names or not safe(name):
            raise Malformed(f"member {name!r} is there already or has an unsafe name")
        self.names.add(name)
        self.zip.writestr(zipfile.ZipInfo(name), data)

    def entry(self, order: int, word: str, body: str | None) -> None:
        value = loads(body)
        if not isinstance(value, dict):
            raise Malformed(f"the body of {word!r} is no object")
        if self.s["check"] and (rule := broken(value)):
            raise Malformed(f"{word!r}: {rule}")
        n, id_ = 0, len(self.raws)

        def number(pool: str, text: str) -> int:
            nonlocal n
            n += 1
            at, key = (order, n), (pool, text)
            if key not in self.first or at < self.first[key]:
                self.first[key] = at
            known = self.number[pool]
            return known.setdefault(text, len(known) + 1) & 0xFFFF

        self.raws.append((word, *codec.encode_noting(value, number)))
        for tag in dict.fromkeys(value.get("tags") or ()):
            self.tags.setdefault(tag, []).append(id_)
        keys = (k for e in value.get("etymologies") or () for s in e.get("senses") or () for f in s.get("forms") or () for k in feature_keys(f.get("feats")))
        for key in dict.fromkeys(keys):
            self.feats.setdefault(key, []).append(id_)

    def asset(self, kind: str, digest: str, ext: str, mime: str | None, compression: str, data: bytes) -> None:
        put = codec.compress(data) if compression == "zstd" else data
        self.add(f"media/{kind}/{digest[:2]}/{digest}.{ext}", put)
        self.stored += len(put)
        self.assets.append({"hash": digest, "kind": kind, "ext": ext, "mime": mime or "", "compression": compression, "size": len(put), "uncompressed_size": len(data)})

    def close(self) -> tuple[int, int, str | None]:
        """(entries, groups, first headword)"""
        if any(len(p) > index.POOL_LIMIT for p in self.number.values()):
            raise Malformed("a pool has too many texts")
        pools = {p: sorted(known, key=lambda s, p=p: self.first[p, s]) for p, known in self.number.items()}  # by first appearance in the source
        moved = {p: {self.number[p][s]: i for i, s in enumerate(v, 1)} for p, v in pools.items()}
        moved = {p: m for p, m in moved.items() if any(a != b for a, b in m.items())}
        heads, held, used, block = [], [], 0, 0
        for word, raw, refs in self.raws:
            for at, pool in refs:
                if pool in moved:
                    raw[at : at + 2] = moved[pool][int.from_bytes(raw[at : at + 2], "little")].to_bytes(2, "little")
            if used and used + len(raw) > self.s["block_max"]:
                self.add(f"data/{block:05d}.zst", codec.compress(b"".join(held), self.s["level"]))
                held, used, block = [], 0, block + 1
            heads.append((word, block, used, len(raw)))
            held.append(raw)
            used += len(raw)
        self.add(f"data/{block:05d}.zst", codec.compress(b"".join(held), self.s["level"]))
        self.add("index/headword.idx", codec.encode_heads(heads, block + 1, self.who))
        self.add("index/strings.tbl", codec.encode_pools(pools, self.who))
        meta = self.s["meta"]
        if self.s["cover"] is not None:
            meta = {"cover": "cover.png", **meta}
            self.add(meta["cover"], self.s["cover"])
        numbered = {s: i for i, s in enumerate(pools["tag"], 1)}
        if self.tags:
            self.add("index/tag.idx", codec.encode_postings(sorted((numbered[t], ids) for t, ids in self.tags.items()), self.who.tags))
        if self.feats:
            self.add("index/morph.idx", codec.encode_postings(sorted(self.feats.items(), key=lambda kv: kv[0].encode()), self.who.morph))
        if self.assets:
            self.add("media/manifest.json", json.dumps({"hash_algo": "sha1", "entries": self.assets}).encode())
        groups = -(-len(heads) // codec.FRONT_BLOCK)
        self.add("manifest.json", json.dumps({
            "format": self.who.name, "format_version": self.who.version, "pack": meta, "strings_file": "index/strings.tbl", **{f"{p}_table": v for p, v in pools.items() if v},
            "index": {"headword_file": "index/headword.idx", "entry_count": len(heads), "block_count": groups},
            "data": {"block_max_uncompressed": self.s["block_max"], "compression": "zstd", "zstd_level": self.s["level"], "block_count": block + 1},
            "tags": {"index_file": "index/tag.idx", "has_index": bool(self.tags), "tag_count": len(pools["tag"])},
            "morph": {"index_file": "index/morph.idx", "has_index": bool(self.feats), "key_count": len(self.feats)},
            "media": {"hash_algo": "sha1", "total_size": self.stored, "dedup": True},
        }, ensure_ascii=False).encode())
        self.zip.close()
        self.sink.close()
        return len(heads), groups, heads[0][0] if heads else None


_WRITTEN = "shard int, file string, entries bigint, groups bigint, first string"


def _writer(folder: str, settings: dict):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name, out = None, "", None

        def done() -> pa.RecordBatch:
            row = (shard, name, *out.close())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "file", "entries", "groups", "first"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for s, part, _, order, word, body, kind, digest, ext, mime, compression, data in zip(*cols):
                if s != shard:
                    if out:
                        yield done()
                    # Each attempt of a task writes a file of its own; the listing names the ones that count.
                    shard, name = s, f"{s:05d}-{uuid.uuid4().hex}.pack"
                    out = _File(f"{folder}/{name}", settings)
                if part == 0:
                    out.entry(order, word, body)
                elif part == 1:
                    out.asset(kind, digest, ext, mime, compression, data)
        if out:
            yield done()

    return run


def check_pack(docs: DataFrame, meta: dict) -> None:
    """The rules that need the whole pack: id, name and language; headwords; relations. Raises Malformed with some of what breaks them."""
    if not all(meta.get(k) for k in ("id", "name", "source_lang")):
        raise Malformed("a pack needs an id, a name and a source language")
    heads = docs.select(F.lit("").alias("pack_id"), F.col("ord").alias("entry_id"), "headword")
    rel = F.from_json(F.get_json_object("body", "$.relations"), "array<struct<type:string,target:string>>")
    e = docs.select(F.lit("").alias("pack_id"), F.col("headword").alias("src"), F.posexplode(rel).alias("ord", "r")).select("pack_id", "src", "ord", "r.type", F.col("r.target").alias("dst"))
    e = stored(e)  # read by each rule
    bad = validate.entry_rules(heads).unionByName(validate.relation_rules(e, heads)).limit(5).collect()
    if bad:
        raise Malformed("; ".join(f"{r['rule']}: {r['key']}" for r in bad))


def write_pack(
    docs: DataFrame, path: str, meta: dict, media: DataFrame | None = None, who: Identity | None = None, block_max: int = 262_144, level: int = 3, cover: bytes | None = None, shards: int | None = None, check: bool = True
) -> None:
    """Writes a pack: one file for ``shards=1``, else a folder of as many files, each a whole pack of a range of headwords.

    docs: ord (bigint, the order of the source), headword, body (JSON of the fields of an entry). Headwords must be
    non-empty and unique. meta: the ``pack`` object of the manifest. media: ord, kind, ext, mime, compression, bytes; of equal
    contents of a kind the first by ord is stored. Without ``shards`` a file holds about SHARD entries, so that no task holds more.
    The files of a folder have string pools of their own; ordinals run through all of them. check: the rules of a pack are
    tested before anything is written (``check_pack``, ``broken``); without it only the format is.
    """
    who = who or Identity()
    docs = stored(docs.select("ord", "headword", "body"))
    if check:
        check_pack(docs, meta)
    twice = docs.groupBy("headword").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.coalesce("headword", F.lit("")) == ""))
    if not check and not twice.isEmpty():
        raise Malformed("headwords must be non-empty and unique")
    n = docs.count()
    shards = shards or max(1, -(-n // SHARD))
    size = max(1, -(-n // shards))
    placed = index.ordinals(docs.select(F.lit("").alias("pack_id"), "headword", T.fold("headword").alias("fold"), "ord", "body"))
    none = {c: F.lit(None).cast(t) for c, t in (("kind", "string"), ("hash", "string"), ("ext", "string"), ("mime", "string"), ("compression", "string"), ("bytes", "binary"))}
    columns = ["shard", "part", "ordinal", "ord", "headword", "body", *none]
    rows = placed.select(F.floor(F.col("ordinal") / size).cast("int").alias("shard"), F.lit(0).alias("part"), "ordinal", "ord", "headword", "body").withColumns(none).select(*columns)
    if media is not None:
        first = media.withColumn("hash", F.sha1("bytes")).groupBy("kind", "hash").agg(F.min_by(F.struct("ext", "mime", "compression", "bytes"), F.struct("ord", "ext", "mime", "compression")).alias("a"))
        own = first.select(
            F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("part"), F.lit(None).cast("bigint").alias("ordinal"), F.lit(None).cast("bigint").alias("ord"),
            F.lit(None).cast("string").alias("headword"), F.lit(None).cast("string").alias("body"), "kind", "hash", "a.ext", "a.mime", "a.compression", "a.bytes",
        )
        rows = rows.unionByName(own)
    # Every file gets a row, so that there is a file also where nothing is in it.
    rows = rows.unionByName(docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(2).alias("part"), *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in columns[2:]]))
    folder = path if shards > 1 else f"{path}.{uuid.uuid4().hex}"
    settings = {"who": who, "meta": meta, "cover": cover, "block_max": block_max, "level": level, "check": check}
    done = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "part", "ordinal", "kind", "hash").mapInArrow(_writer(folder, settings), _WRITTEN)
    files = sorted((r.asDict() for r in done.collect()), key=lambda r: r["shard"])  # a row a file
    fs, at = _place(folder)
    if shards == 1:
        fs.move(f"{at}/{files[0]['file']}", _place(path)[1])
        fs.delete_dir(at)
        return
    for f in files:
        f["base"] = f["shard"] * size
    with fs.open_output_stream(f"{at}/{LISTING}") as f:
        f.write(json.dumps(files, ensure_ascii=False).encode())


def digest(data: bytes) -> str:
    """SHA-1 in hex, the name of an asset."""
    return hashlib.sha1(data).hexdigest()
