"""Queries of the data-preparation operators in the core: p2 (orphan references), p3 (nested records)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.operators import flatten, references
from lexframe.session import stored, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.lexical_orphans(table(spark, d, "entries"), table(spark, d, "relations"), table(spark, d, "media_refs"), table(spark, d, "media"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence, from the identities of the documents along the bridge."""
    return flatten.rebuild(*flatten.stored_tables(table(spark, d, "raw_entries")))


def _hex(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in columns})


def p3_roots(spark: SparkSession, d: str) -> DataFrame:
    return _hex(flatten.roots(table(spark, d, "raw_entries")), "node_id")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return _hex(flatten.bridge(table(spark, d, "raw_entries")), "parent_id", "child_id")


def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    return _hex(flatten.objects(table(spark, d, "raw_entries")), "node_id")


def p3_senses(spark: SparkSession, d: str) -> DataFrame:
    return flatten.flat_table(table(spark, d, "raw_entries"), "sense")


def p3_check(spark: SparkSession, d: str) -> DataFrame:
    """What the stored tables hold, and whatever is wrong with them (nothing may be): what, n."""
    seen = stored(flatten.flatten(table(spark, d, "raw_entries"), ("raw_id", *flatten.LINK), root=True))
    links = seen.where("parent_id IS NOT NULL").select("parent_id", "step", "ordinal", F.col("node_id").alias("child_id")).distinct()
    objects = seen.groupBy("node_id").agg(F.countDistinct("kind").alias("kinds"), F.count(F.lit(1)).alias("occurrences"))
    one = lambda df, what: df.select(F.lit(what).alias("what"), "n")
    count = F.count(F.lit(1)).alias("n")
    parts = [
        one(seen.where("kind = 'entry'").agg(count), "documents"), one(objects.agg(F.sum("occurrences").alias("n")), "occurrences"), one(objects.where("kinds > 1").agg(count), "objects of two kinds"),
        one(links.join(objects, links["child_id"] == objects["node_id"], "left_anti").agg(count), "links without a child"), one(links.join(objects, links["parent_id"] == objects["node_id"], "left_anti").agg(count), "links without a parent"),
        one(links.groupBy("parent_id", "step", "ordinal").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(count), "places with two children"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _flat(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: flatten.flat_table(table(spark, d, "raw_entries"), kind)


FLAT_TABLES = {"etymologies": "ety", "translations": "translation", "definitions": "definition", "groups": "group", "examples": "example", "notes": "note"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_links": p3_links, "p3_objects": p3_objects, "p3_senses": p3_senses,
    "p3_roots": p3_roots, "p3_check": p3_check, **{f"p3_{name}": _flat(kind) for name, kind in FLAT_TABLES.items()},
}

_P2 = """
WITH owner AS (SELECT entry_id, min(pack_id) AS pack_id FROM entries GROUP BY entry_id),
refs AS (
  SELECT 'relations' AS ref_table, CAST(r.entry_id AS VARCHAR) AS owner_id, r.ord, o.pack_id, r.target AS k, NULL AS kind, min(r.loaded_at) AS d
  FROM relations r LEFT JOIN owner o ON r.entry_id = o.entry_id WHERE r.target IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'entries', CAST(entry_id AS VARCHAR), 0, pack_id, see, NULL, min(loaded_at) FROM entries WHERE see <> '' GROUP BY ALL
  UNION ALL
  SELECT 'media_refs', m.owner_id, m.ord, o.pack_id, lower(m.hash), m.kind, min(m.loaded_at)
  FROM media_refs m LEFT JOIN owner o ON TRY_CAST(split_part(m.owner_id, '/', 1) AS BIGINT) = o.entry_id WHERE m.hash IS NOT NULL GROUP BY ALL),
targets AS (
  SELECT pack_id, headword AS k, NULL AS kind, min(loaded_at) FILTER (WHERE deleted_at IS NULL) AS live FROM entries GROUP BY ALL
  UNION ALL
  SELECT pack_id, sha1(bytes), kind, min(loaded_at) FILTER (WHERE deleted_at IS NULL) FROM media GROUP BY ALL),
found AS (
  SELECT r.ref_table, r.owner_id, r.ord, r.d,
         CASE WHEN t.k IS NULL THEN 'missing' WHEN t.live IS NULL THEN 'deleted' WHEN t.live > r.d THEN 'late' END AS reason
  FROM refs r LEFT JOIN targets t ON r.pack_id = t.pack_id AND r.k = t.k AND r.kind IS NOT DISTINCT FROM t.kind),
orphans AS (SELECT ref_table, owner_id, ord, reason, strftime(d, '%Y-%m') AS period FROM found WHERE reason IS NOT NULL)
"""

# The nodes of all bodies: raw_id, kind, path and the JSON of the node; the root has the kind "entry".
NODES = """
WITH RECURSIVE fields AS (SELECT * FROM (VALUES ('entry', 'etymologies', 'ety', 'e'), ('ety', 'senses', 'sense', 's'), ('sense', 'translations', 'translation', 't'), ('sense', 'definitions', NULL, 'd'), ('group', 'definitions', NULL, 'd'),
 ('definition', 'examples', 'example', 'x'), ('definition', 'notes', 'note', 'n'), ('note', 'examples', 'example', 'x'), ('example', 'translations', 'translation', 't')) f(kind, field, child, step)),
docs AS (SELECT raw_id, CAST(body AS JSON) AS j FROM (SELECT raw_id, arg_min(body, {'l': loaded_at, 'b': body}) AS body FROM raw_entries GROUP BY raw_id) WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
nodes AS (
 SELECT raw_id, 'entry' AS kind, '' AS path, j FROM docs
 UNION ALL
 SELECT raw_id, CASE WHEN child IS NOT NULL THEN child WHEN json_exists(e, '$.Group') THEN 'group' WHEN json_exists(e, '$.Definition') THEN 'definition' WHEN json_exists(e, '$.definitions') THEN 'group' ELSE 'definition' END,
  path || CASE WHEN path = '' THEN '' ELSE '/' END || step || i, CASE WHEN child IS NOT NULL THEN e ELSE coalesce(json_extract(e, '$.Group'), json_extract(e, '$.Definition'), e) END
 FROM (SELECT raw_id, path, child, step, i, es[i + 1] AS e FROM (SELECT raw_id, path, child, step, es, unnest(range(len(es))) AS i
  FROM (SELECT n.raw_id, n.path, f.child, f.step, CASE json_type(json_extract(n.j, '$.' || f.field)) WHEN 'ARRAY' THEN CAST(json_extract(n.j, '$.' || f.field) AS JSON[]) WHEN 'OBJECT' THEN [json_extract(n.j, '$.' || f.field)] ELSE [] END AS es FROM nodes n JOIN fields f ON f.kind = n.kind)))
 WHERE json_type(e) = 'OBJECT' AND coalesce(json_type(json_extract(e, '$.Group')), json_type(json_extract(e, '$.Definition')), 'OBJECT') = 'OBJECT')
"""



def _flat_sql(kind: str) -> str:
    fields = ", ".join(f"j ->> '$.{c}' AS {c}" for c in flatten.FLAT_FIELDS[kind])
    return NODES + rf"SELECT raw_id, path, regexp_replace(path, '/?[^/]*$', '') AS parent_path, CAST(regexp_extract(path, '([0-9]+)$', 1) AS INTEGER) AS ordinal, {fields} FROM nodes WHERE kind = '{kind}'"


SQL: dict[str, str] = {
    **{f"p3_{name}": _flat_sql(kind) for name, kind in FLAT_TABLES.items()},
    "p3_found": NODES + "SELECT raw_id, kind, path FROM nodes WHERE kind <> 'entry'",
    "p3_check": NODES
    + """SELECT 'documents' AS what, count(*) FILTER (WHERE kind = 'entry') AS n FROM nodes UNION ALL SELECT 'occurrences', count(*) FROM nodes
UNION ALL SELECT w, 0 FROM (VALUES ('objects of two kinds'), ('links without a child'), ('links without a parent'), ('places with two children')) t(w)""",
    "p3_senses": NODES
    + r"""SELECT raw_id, path, regexp_replace(path, '/[^/]*$', '') AS parent_path, CAST(regexp_extract(path, '([0-9]+)$', 1) AS INTEGER) AS ordinal, j ->> '$.pos' AS pos, j ->> '$.lemma' AS lemma
FROM nodes WHERE kind = 'sense'""",
    "p2_found": _P2 + "SELECT * FROM orphans",
    "p2_report": _P2
    + """SELECT ref_table, period, reason, n, CAST(sum(n) OVER (PARTITION BY ref_table, reason ORDER BY period) AS BIGINT) AS running
FROM (SELECT ref_table, period, reason, count(*) AS n FROM orphans GROUP BY ALL)""",
}
