"""Plain-file sources and sinks: entry documents, the pack registry, dictionary pages, media folders."""

from __future__ import annotations

import json
import re
import tomllib
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.functions import text as T

READ_EAGERLY = 10 << 20  # bytes up to which a pack is kept in memory

# The classes of cells in the table of forms of a dictionary page.
FORM_CLASSES = {"form-pri": "pri", "form-rare": "rare", "form-valid": "valid", "form-ik": "ik", "form-ok": "ok", "form-uk": "uk"}


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        import yaml
    except ImportError:
        yaml = None
    for b in batches:
        rows = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            if path.endswith(".json"):
                loaded = json.loads(content)
            elif yaml is None:
                raise RuntimeError("YAML files need PyYAML; JSON files don't")
            else:
                loaded = yaml.safe_load(content)
            entries = loaded.get("entries", []) if isinstance(loaded, dict) else loaded or []
            rows += [(path, n, e.get("headword"), json.dumps(e, ensure_ascii=False)) for n, e in enumerate(entries)]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "n", "headword", "body"])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, n, headword, body of every entry in the .yaml, .yml and .json files of a folder; of equal headwords the first by path and place.

    A file holds a list of entries or an object with the list ``entries``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml,json}").load(folder).select("path", "content")
    found = files.mapInArrow(_documents, "path string, n bigint, headword string, body string")
    first = found.groupBy("headword").agg(F.min(F.struct("path", "n", "body")).alias("f"))
    return first.select("f.path", "f.n", "headword", "f.body")


def write_documents(entries: DataFrame, folder: str, kind: str = "json") -> int:
    """Entries (any columns) as source documents, one file a partition, in JSON or YAML; returns their number. Works on any file system that Arrow knows."""
    from pyarrow import fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [json.loads(x) for b in batches for x in b.column(0).to_pylist()]
        if rows:
            if kind == "yaml":
                import yaml

                data = yaml.safe_dump({"entries": rows}, allow_unicode=True, sort_keys=False)
            else:
                data = json.dumps({"entries": rows}, ensure_ascii=False)
            fs, at = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{uuid.uuid4().hex}.{kind}") as f:
                f.write(data.encode())
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    return entries.select(F.to_json(F.struct(*entries.columns)).alias("j")).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()[0][0] or 0


def fetched(words: DataFrame, pages: DataFrame) -> DataFrame:
    """word, page_id, html: the page of each word (pages: page_id, key, html), over one link; null where there is none."""
    own = pages.select("key", "page_id", "html", T.link_target("html").alias("_to"))
    first = words.join(own, words["word"] == own["key"], "left").drop("key")
    there = pages.select(F.col("key").alias("_k"), F.col("page_id").alias("_id"), F.col("html").alias("_html"))
    return first.join(there, F.col("_to") == F.col("_k"), "left").select("word", F.when(F.col("_to").isNull(), F.col("page_id")).otherwise(F.col("_id")).alias("page_id"), F.when(F.col("_to").isNull(), F.col("html")).otherwise(F.col("_html")).alias("html"))


def registry(spark: SparkSession, toml: str) -> DataFrame:
    """combo, id, name, description of the packs in a registry; its text is small by nature."""
    packs = tomllib.loads(toml).get("packs", [])
    return spark.createDataFrame([(p["combo"], p["id"], p["name"], p.get("description", "")) for p in packs], "combo string, id string, name string, description string")


def combo(source, targets):  # noqa: ANN001, ANN201
    """The key of a registry: source and sorted targets."""
    return F.concat(source, F.lit("|"), F.array_join(F.array_sort(targets), ","))


class _Grid(HTMLParser):
    """The rows of the table of forms: per cell whether it is a head, its class, and its text."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list]] = []
        self.inside = self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        cls = dict(attrs).get("class") or ""
        if tag == "li" and "forms" in cls.split():
            self.inside = True
        elif self.inside and tag == "tr":
            self.rows.append([])
        elif self.inside and tag in ("th", "td") and self.rows:
            self.rows[-1].append([tag, next((v for k, v in FORM_CLASSES.items() if k in cls), None), ""])
            self.cell = True
        elif self.cell and self.rows[-1][-1][1] is None:
            self.rows[-1][-1][1] = next((v for k, v in FORM_CLASSES.items() if k in cls), None)

    def handle_endtag(self, tag: str) -> None:
        self.cell = self.cell and tag not in ("th", "td")
        self.inside = self.inside and tag != "table"

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.rows[-1][-1][2] += data


def forms_of(html: str | None) -> list[tuple[str, str, str]]:
    """(variant, reading, class) of the marked cells; cells keep their column, also beside empty ones."""
    g = _Grid()
    g.feed(html or "")
    if not g.rows:
        return []
    variants = [c[2].strip() for c in g.rows[0] if c[0] == "th"]
    variants = variants[1:] if variants and not variants[0] else variants
    out = []
    for row in g.rows[1:]:
        heads, cells = [c for c in row if c[0] == "th"], [c for c in row if c[0] == "td"]
        if heads:
            out += [(v, heads[0][2].strip(), c[1]) for v, c in zip(variants, cells) if v and c[1]]
    return out


def page_forms(pages: DataFrame) -> DataFrame:
    """page_id, variant, reading, class of the tables of forms. pages: page_id (bigint), html; null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *f) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in forms_of(h)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["page_id", "variant", "reading", "class"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, variant string, reading string, class string")


def page_entries(pages: DataFrame) -> DataFrame:
    """page_id, priority, written, reading, glosses of dictionary pages."""
    head = F.regexp_extract("html", r'(?s)<span class="headword"[^>]*>(.*?)(?:<span class="priority-symbol"|</span></div>|\z)', 1)
    return pages.select("page_id", F.instr("html", 'class="headline priority"').cast("boolean").alias("priority"), T.ruby_base(head).alias("written"), T.ruby_reading(head).alias("reading"), T.glosses("html").alias("glosses"))


def extract_media(assets: DataFrame, folder: str) -> int:
    """Writes assets (path, bytes) below a shared folder of any file system that Arrow knows, from the executors, each by rename; returns their number."""
    from pyarrow import fs as pafs

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist()):
                if ".." in path.split("/") or not re.fullmatch(r"[\w.-]+(?:/[\w.-]+)*", path):
                    raise ValueError(f"unsafe path {path!r}")
                fs.create_dir(f"{at}/{path}".rpartition("/")[0], recursive=True)
                part = f"{at}/{path}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(data)
                fs.move(part, f"{at}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return assets.select("path", "bytes").mapInArrow(save, "n bigint").agg(F.sum("n")).collect()[0][0] or 0


def opened(spark: SparkSession, path: str, mode: str = "auto", table: str = "entries") -> DataFrame:
    """A table of a pack. eager: kept in memory; lazy: read as needed; auto: eager up to READ_EAGERLY bytes of entries."""
    from lexframe.sources import pack

    pack.register(spark)
    df = spark.read.format("lexpack").option("table", table).load(path)
    if mode == "auto":
        m = json.loads(spark.read.format("lexpack").option("table", "manifest").load(path).collect()[0]["body"])
        mode = "eager" if m["data"]["block_max_uncompressed"] * m["data"]["block_count"] <= READ_EAGERLY else "lazy"
    return df.cache() if mode == "eager" else df


def dump(entries: DataFrame) -> DataFrame:
    """headword, line: each entry as indented lines of text, for reading."""
    from lexframe.operators.flatten import FLAT_FIELDS, nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for word, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append((word, 0, word))
                for n, (kind, path, _, _, _, _, payload) in enumerate(sorted(nodes(json.loads(body))[1:], key=lambda x: [(p[0], int(p[1:])) for p in x[1].split("/")]), 1):
                    own = json.loads(payload)
                    rows.append((word, n, "  " * path.count("/") + "  " + kind + ": " + "; ".join(str(own[f]) for f in FLAT_FIELDS[kind] if own.get(f))))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["headword", "n", "line"])

    return entries.where("body IS NOT NULL").select("headword", "body").mapInArrow(run, "headword string, n bigint, line string")
