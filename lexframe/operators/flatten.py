"""Deeply nested entry documents as related flat tables.

Merkle subtree identities: every object gets an identity hashed bottom-up from its kind, its own
canonical fields and the identities of its children with their places. Equal subtrees therefore
share one identity, are stored once (``objects``), and every occurrence is kept by parent-child
bridge rows with ordinals (``bridge``) under the identity of its document (``roots``). The canonical
fields also say what stood in the places of children (null, absent, one object or a list, wrappers,
elements that are no node), so a document can be put together again from the stored objects.

Malformed input: null, blank or unreadable bodies and bodies that are no JSON object yield nothing.
A child field holds a list or one object that stands for a list of one; null and non-object
elements keep their position and are no node. Depth and width are unlimited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexframe.functions.jsontree import canonical, loads
from lexframe.operators.skew import HOT_LIMIT, repeated, salts_for
from lexframe.session import stored

# Child fields of each kind, in order: field, kind of its elements (None: told by the element), step.
CHILDREN = {
    "entry": (("etymologies", "ety", "e"),),
    "ety": (("senses", "sense", "s"),),
    "sense": (("translations", "translation", "t"), ("definitions", None, "d")),
    "group": (("definitions", None, "d"),),
    "definition": (("examples", "example", "x"), ("notes", "note", "n")),
    "note": (("examples", "example", "x"),),
    "example": (("translations", "translation", "t"),),
    "translation": (),
}
KINDS = tuple(k for k in CHILDREN if k != "entry")
FLAT_FIELDS = {
    "ety": ("id", "root"), "sense": ("pos", "lemma"), "translation": ("lang", "value"), "definition": ("id", "value"),
    "group": ("id", "description"), "example": ("value",), "note": ("id", "value"),
}
NODE_TYPES = {
    "raw_id": ("bigint", pa.int64()), "kind": ("string", pa.string()), "path": ("string", pa.string()), "parent_path": ("string", pa.string()),
    "step": ("string", pa.string()), "ordinal": ("int", pa.int32()), "node_id": ("binary", pa.binary()), "parent_id": ("binary", pa.binary()),
    "parent_kind": ("string", pa.string()), "payload": ("string", pa.string()),
}

_ORDER = list(NODE_TYPES)  # of the values of a node in _scan


def _unwrapped(element: object) -> tuple[str, dict] | None:
    """Kind and object of an element of ``definitions``; None if it is no node."""
    if not isinstance(element, dict):
        return None
    for wrapper, kind in (("Group", "group"), ("Definition", "definition")):
        if wrapper in element:
            return (kind, element[wrapper]) if isinstance(element[wrapper], dict) else None
    return ("group" if "definitions" in element else "definition"), element


def _place(of: str | None, element: object) -> object:
    """What an element of a child field leaves in the payload: 0 for a node, its wrapper, or itself in a list."""
    if (element is None or not isinstance(element, dict)) or (of is None and _unwrapped(element) is None):
        return [element]
    wrapper = next((w for w in ("Group", "Definition") if of is None and w in element), None)
    if wrapper is None:
        return 0
    rest = {k: v for k, v in element.items() if k != wrapper}
    return {wrapper: rest} if rest else wrapper


def nodes(root: dict) -> list[list]:
    """The nodes of one document, parents before children.

    Each is [kind, path, index of its parent (-1 for the root), step, ordinal, identity, payload];
    the first is the document itself, of kind ``entry`` with the path ''. The payload is the canonical
    JSON of the object, with the nodes below it replaced by marks of their places.
    """
    out: list[list] = [["entry", "", -1, "", 0, b"", root]]
    i = 0
    while i < len(out):
        kind, path, _, _, _, _, obj = out[i]
        own = dict(obj)
        for field, of, step in CHILDREN[kind]:
            if field not in obj:
                continue
            held = obj[field]
            if isinstance(held, dict):
                own[field] = {"1": _place(of, held)}
                held = [held]
            elif isinstance(held, list):
                own[field] = [_place(of, e) for e in held]
            else:
                own[field] = {"": held}
                continue
            for n, element in enumerate(held):
                if of is None:
                    node = _unwrapped(element)
                else:
                    node = (of, element) if isinstance(element, dict) else None
                if node:
                    out.append([node[0], f"{path}/{step}{n}" if path else f"{step}{n}", i, step, n, b"", node[1]])
        out[i][6] = own
        i += 1
    below: list[list[bytes]] = [[] for _ in out]
    for i in range(len(out) - 1, -1, -1):
        kind, _, parent, step, n, _, own = out[i]
        payload = canonical(own)
        digest = hashlib.blake2b(b"\x00".join((kind.encode(), payload.encode(), *reversed(below[i]))), digest_size=16).digest()
        out[i][5:] = [digest, payload]
        if parent >= 0:
            below[parent].append(b"%b%d:%b" % (step.encode(), n, digest))
    return out


def _scan(columns: list[str], rows_per_batch: int = 20_000):  # noqa: ANN202
    """An Arrow mapper from (raw_id, body) to the node columns asked for."""
    schema = pa.schema([(c, NODE_TYPES[c][1]) for c in columns])

    def flush(acc: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(acc[c], type=NODE_TYPES[c][1]) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, list] = {c: [] for c in columns}
        places = [_ORDER.index(c) for c in columns]
        for batch in batches:
            for raw_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = loads(body)
                if not isinstance(root, dict):
                    continue
                found = nodes(root)
                top = (None, None, None, None, None, None)
                rows = [(raw_id, kind, path, up[1], step, n, digest, up[5], up[0], payload) for kind, path, parent, step, n, digest, payload in found for up in (found[parent] if parent >= 0 else top,)]
                for held, i in zip(acc.values(), places):
                    held += [r[i] for r in rows]
                if len(acc[columns[0]]) >= rows_per_batch:
                    yield flush(acc)
                    acc = {c: [] for c in columns}
        if acc[columns[0]]:
            yield flush(acc)

    return run


def flatten(raw: DataFrame, columns: tuple[str, ...] = tuple(NODE_TYPES), root: bool = False) -> DataFrame:
    """Every node of every body: by default all of NODE_TYPES, one row per occurrence.

    raw: ``raw_id``, ``body``, ``loaded_at``; other columns are ignored. Rows with equal raw_id are
    deliveries of one record and the earliest counts (on a tie the least body). A null raw_id is an
    id like any other. root: also give the documents themselves (kind ``entry``, path '').
    """
    once = raw.groupBy("raw_id").agg(F.min(F.struct("loaded_at", "body")).alias("_r")).select("raw_id", "_r.body")
    need = list(dict.fromkeys([*columns, "kind"]))
    out = once.mapInArrow(_scan(need), ", ".join(f"{c} {NODE_TYPES[c][0]}" for c in need))
    return (out if root else out.where(F.col("kind") != "entry")).select(*columns)


def objects(raw: DataFrame) -> DataFrame:
    """Distinct objects: node_id, kind, payload (canonical JSON of their own fields), occurrences."""
    return flatten(raw, ("node_id", "kind", "payload"), root=True).groupBy("node_id", "kind").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("occurrences"))


LINK = ("parent_id", "parent_kind", "step", "ordinal", "node_id", "kind")


def _links(seen: DataFrame) -> DataFrame:
    return seen.where("parent_id IS NOT NULL").select(*LINK[:4], F.col("node_id").alias("child_id"), F.col("kind").alias("child_kind")).distinct()


def bridge(raw: DataFrame) -> DataFrame:
    """Distinct parent-child links: parent_id, parent_kind, step, ordinal, child_id, child_kind."""
    return _links(flatten(raw, LINK))


def roots(raw: DataFrame) -> DataFrame:
    """The identity of each document: raw_id, node_id."""
    return flatten(raw, ("raw_id", "node_id", "kind"), root=True).where(F.col("kind") == "entry").select("raw_id", "node_id")


def flat_table(raw: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind: raw_id, path, parent_path, ordinal and the kind's own fields."""
    found = flatten(raw, ("raw_id", "kind", "path", "parent_path", "ordinal", "payload")).where(F.col("kind") == kind)
    return found.select("raw_id", "path", "parent_path", "ordinal", *[F.get_json_object("payload", f"$.{c}").alias(c) for c in FLAT_FIELDS[kind]])


def stored_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots and bridge, written from one reading of the bodies."""
    seen = stored(flatten(raw, ("raw_id", *LINK), root=True))
    return seen.where("kind = 'entry'").select("raw_id", "node_id"), stored(_links(seen), "parent_kind")


def rebuild(roots_: DataFrame, bridge_: DataFrame) -> DataFrame:
    """Occurrences from the stored tables alone: raw_id, kind, path.

    The documents' identities are expanded along the bridge one kind after the other, so that each
    link and each occurrence moves once; groups, which nest in each other, are expanded until a level
    is empty, which comes, as no object holds itself. Identities that occur often are salted.
    """
    waiting: dict[str, list[tuple[DataFrame, list]]] = {k: [] for k in CHILDREN}
    waiting["entry"] = [_level(roots_.select("raw_id", "node_id", F.lit("entry").alias("kind"), F.lit("").alias("path")))[:2]]
    levels = []
    for kind in ("entry", "ety", "sense", "group", "definition", "note", "example"):
        links = bridge_.where(F.col("parent_kind") == kind)
        level, hot = reduce(DataFrame.unionByName, [df for df, _ in waiting[kind]]), sorted({h for _, hs in waiting[kind] for h in hs})
        while True:
            below, hot, groups = _level(_expanded(level, links, hot))
            levels.append(below.select("raw_id", "kind", "path"))
            for k in {of for _, of, _ in CHILDREN[kind] if of} | ({"group", "definition"} if kind in ("sense", "group") else set()):
                waiting[k].append((below.where(F.col("kind") == k), hot))
            if kind != "group" or not groups:
                break
            level = below.where("kind = 'group'")
    return reduce(DataFrame.unionByName, levels)


def _level(df: DataFrame) -> tuple[DataFrame, list, int]:
    """The rows stored, the hashes of identities that hold more than a 256th of them, and the number of groups: all from one job."""
    seen = Observation()
    top = F.expr(f"approx_top_k(xxhash64(node_id), {HOT_LIMIT}, {HOT_LIMIT * 40})").alias("top")
    table = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "group").alias("groups"), top))
    m = seen.get
    return table, [x["item"] for x in m.get("top") or [] if x["count"] * HOT_LIMIT > m["n"]], m.get("groups") or 0


def _expanded(level: DataFrame, links: DataFrame, hot: list) -> DataFrame:
    """raw_id, node_id, kind, path of what is directly below (raw_id, node_id, path); hot: hashes of the identities to salt."""
    left = level.drop("kind").withColumn("h", F.xxhash64("node_id")).withColumn("_salt", salts_for("h", hot, ["raw_id", "path"]))
    right = repeated(links.withColumn("h", F.xxhash64("parent_id")), "h", hot, "_salt").drop("h")
    on = (left["node_id"] == right["parent_id"]) & (left["_salt"] == right["_salt"])
    step = F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), F.concat("step", F.col("ordinal").cast("string")))
    return left.join(right, on).select("raw_id", F.col("child_id").alias("node_id"), F.col("child_kind").alias("kind"), step.alias("path"))
