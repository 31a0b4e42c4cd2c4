"""Queries over the dictionary tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.operators import crossword, flatten, graph, index, lookup, media, nest, quality, validate
from lexframe.plans.general import NODES
from lexframe.operators.skew import hot_values
from lexframe.session import kept, shared_folder, stored, table
from lexframe.sources import pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- tables


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """The live entries with fold and ordinal, in order: the compiled headword index, stored once and read by every query."""
    return kept(spark, d, "numbered", ("entries",), lambda: stored(index.ordinals(index.live(table(spark, d, "entries")))))


def heads(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d).drop("ordinal")


def hot_targets(spark: SparkSession, d: str) -> list:
    """Targets that many relations share."""
    return kept(spark, d, "hot_targets", ("relations",), lambda: hot_values(table(spark, d, "relations"), ["target"])["target"])


def once(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table without its arrival time; rows delivered again count once."""
    return table(spark, d, name).drop("loaded_at").distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "relations"), heads(spark, d))


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return flatten.flatten(table(spark, d, "raw_entries"), columns)


_E = """once AS (SELECT DISTINCT pack_id, entry_id, headword, see, ord, edited_at, deleted_at FROM entries),
live AS (SELECT pack_id, entry_id, headword, see, ord, lower(headword) AS fold FROM once WHERE deleted_at IS NULL)"""
_NUM = _E + ", num AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY fold, headword) - 1 AS ordinal FROM live)"
_EDGES = _E + """, edges AS (SELECT l.pack_id, l.headword AS src, r.type, r.target AS dst, r.ord
 FROM (SELECT DISTINCT entry_id, ord, type, target FROM relations) r JOIN live l ON l.entry_id = r.entry_id)"""
EN = "5d0c7e1a-93b4-4c58-8f21-0a6be4d1c701"

# ---------------------------------------------------------------- look-up


@query(f"WITH {_NUM} SELECT pack_id, headword, fold, CAST(ordinal AS BIGINT) AS ordinal FROM num")
def list_headwords(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d).select("pack_id", "headword", "fold", "ordinal")


@query(f"WITH {_E} SELECT pack_id, entry_id, headword FROM live WHERE headword = 'flasbrén'")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.exact(heads(spark, d), "flasbrén").select("pack_id", "entry_id", "headword")


@query(f"""WITH {_E}, needles AS (SELECT DISTINCT pack_id, headword AS word FROM documents WHERE headword IS NOT NULL)
SELECT n.pack_id, n.word, l.entry_id FROM needles n LEFT JOIN live l ON l.pack_id = n.pack_id AND l.headword = n.word""")
def bulk_lookup(spark: SparkSession, d: str) -> DataFrame:
    needles = table(spark, d, "documents").where(F.col("headword").isNotNull()).select("pack_id", F.col("headword").alias("word")).distinct()
    return lookup.bulk(needles, heads(spark, d)).select("pack_id", "word", "entry_id")


@query(f"WITH {_E} SELECT headword, fold FROM live WHERE pack_id = '{EN}' AND starts_with(fold, 'ga') ORDER BY fold, headword LIMIT 50 OFFSET 5")
def prefix_page(spark: SparkSession, d: str) -> DataFrame:
    return lookup.prefix(heads(spark, d).where(F.col("pack_id") == EN), "Ga", 5, 50).select("headword", "fold")


@query(f"WITH {_E} SELECT pack_id, headword FROM live WHERE pack_id = '{EN}' ORDER BY fold, headword LIMIT 200")
def prefix_empty(spark: SparkSession, d: str) -> DataFrame:
    return lookup.prefix(heads(spark, d).where(F.col("pack_id") == EN), "", 0, 200).select("pack_id", "headword")


@query(f"""WITH {_E}, shelf AS (SELECT pack_id, row_number() OVER (ORDER BY pack_id) AS shelf FROM (SELECT DISTINCT pack_id FROM live)),
hits AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY fold, headword) AS hit FROM live WHERE starts_with(fold, 'b'))
SELECT h.pack_id, h.headword FROM hits h JOIN shelf s ON s.pack_id = h.pack_id WHERE hit <= 200 ORDER BY shelf, fold, headword LIMIT 200""")
def cross_pack_search(spark: SparkSession, d: str) -> DataFrame:
    h = heads(spark, d)
    shelf = h.select("pack_id").distinct().selectExpr("pack_id", "row_number() OVER (ORDER BY pack_id) AS shelf")
    return lookup.shelf(h, "B", shelf).select("pack_id", "headword")


@query(f"WITH {_E} SELECT headword FROM live WHERE pack_id = '{EN}' ORDER BY headword LIMIT 100")
def first_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    return heads(spark, d).where(F.col("pack_id") == EN).orderBy("headword").limit(100).select("headword")


@query(f"WITH {_E} SELECT pack_id, headword, see, t.entry_id AS target_id FROM live l LEFT JOIN (SELECT pack_id AS p, headword AS h, entry_id FROM live) t ON l.pack_id = t.p AND l.see = t.h WHERE see <> ''"
       .replace("SELECT pack_id, headword, see", "SELECT l.pack_id, l.headword, l.see"))
def see_followed(spark: SparkSession, d: str) -> DataFrame:
    h = heads(spark, d)
    return graph.followed(h, h)


# ---------------------------------------------------------------- indexes


@query(f"WITH {_NUM} SELECT pack_id, entry_id, CAST(ordinal AS BIGINT) AS ordinal FROM num")
def entry_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d).select("pack_id", "entry_id", "ordinal")


@query(f"""WITH {_NUM}, prev AS (SELECT *, ordinal // 256 AS block, lag(headword) OVER (PARTITION BY pack_id, ordinal // 256 ORDER BY ordinal) AS p FROM num),
n AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE len(list_filter(range(1, CAST(least(strlen(p), strlen(headword)) AS BIGINT) + 1), lambda i: hex(encode(p))[1:2*i] = hex(encode(headword))[1:2*i])) END AS shared FROM prev)
SELECT pack_id, CAST(block AS BIGINT) AS block, CAST(ordinal AS BIGINT) AS ordinal, CAST(shared AS INTEGER) AS shared, substr(hex(encode(headword)), 2 * CAST(shared AS BIGINT) + 1) AS suffix FROM n""")
def front_coding(spark: SparkSession, d: str) -> DataFrame:
    return index.front_coded(numbered(spark, d))


@query(f"WITH {_NUM} SELECT pack_id, CAST(ordinal AS BIGINT) AS ordinal, headword FROM num")
def front_decoding(spark: SparkSession, d: str) -> DataFrame:
    return index.front_decoded(index.front_coded(numbered(spark, d)))


@query(f"WITH {_NUM} SELECT pack_id, CAST(ordinal // 256 AS BIGINT) AS block, arg_min(headword, ordinal) AS first, count(*) AS entries FROM num GROUP BY pack_id, ordinal // 256")
def index_directory(spark: SparkSession, d: str) -> DataFrame:
    return index.directory(numbered(spark, d))


@query(f"""WITH RECURSIVE {_NUM}, sized AS (SELECT pack_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(strlen(headword) AS BIGINT) AS size FROM num),
walk AS (SELECT pack_id, ordinal, size, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS "at" FROM sized WHERE ordinal = 0
 UNION ALL SELECT s.pack_id, s.ordinal, s.size, w.block + CASE WHEN w."at" + w.size > 0 AND w."at" + w.size + s.size > 256 THEN 1 ELSE 0 END,
 CASE WHEN w."at" + w.size > 0 AND w."at" + w.size + s.size > 256 THEN 0 ELSE w."at" + w.size END FROM walk w JOIN sized s ON s.pack_id = w.pack_id AND s.ordinal = w.ordinal + 1)
SELECT pack_id, block, ordinal, "at", size FROM walk""")
def block_packing(spark: SparkSession, d: str) -> DataFrame:
    return index.packed_blocks(numbered(spark, d).withColumn("size", F.octet_length("headword")), 256, 1000)


def _pools(spark: SparkSession, d: str) -> DataFrame:
    own = heads(spark, d).select("entry_id", "pack_id", F.col("ord").alias("entry_ord"))
    tag = once(spark, d, "entry_tags").select("entry_id", F.lit("tag").alias("pool"), F.col("tag").alias("value"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), "ord").alias("w"))
    pos = once(spark, d, "senses").select("entry_id", F.lit("pos").alias("pool"), F.col("pos").alias("value"), F.struct(F.col("ety_ord").alias("a"), F.col("sense_ord").alias("b"), F.lit(0).alias("ord")).alias("w"))
    kind = once(spark, d, "forms").select("entry_id", F.lit("form_kind").alias("pool"), F.col("kind").alias("value"), F.struct(F.col("ety_ord").alias("a"), F.col("sense_ord").alias("b"), "ord").alias("w"))
    rel = once(spark, d, "relations").select("entry_id", F.lit("relation").alias("pool"), F.col("type").alias("value"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), "ord").alias("w"))
    values = tag.unionByName(pos).unionByName(kind).unionByName(rel).join(own, "entry_id")
    return index.pools(values.select("pack_id", "pool", "value", F.struct("entry_ord", "entry_id", "w.a", "w.b", "w.ord").alias("at")))


_POOLS = _E + """, vals AS (
 SELECT entry_id, 'tag' AS pool, tag AS value, 0 AS a, 0 AS b, ord AS c FROM entry_tags UNION ALL SELECT entry_id, 'pos', pos, ety_ord, sense_ord, 0 FROM senses
 UNION ALL SELECT entry_id, 'form_kind', kind, ety_ord, sense_ord, ord FROM forms UNION ALL SELECT entry_id, 'relation', type, 0, 0, ord FROM relations),
firsts AS (SELECT l.pack_id, pool, value, min({'o': l.ord, 'e': l.entry_id, 'a': a, 'b': b, 'c': c}) AS pos FROM vals v JOIN live l ON l.entry_id = v.entry_id WHERE value IS NOT NULL GROUP BY l.pack_id, pool, value),
pools AS (SELECT pack_id, pool, value, CAST(row_number() OVER (PARTITION BY pack_id, pool ORDER BY pos, value) AS INTEGER) AS idx FROM firsts)"""


@query(f"WITH {_POOLS} SELECT pack_id, pool, value, idx FROM pools")
def intern_pools(spark: SparkSession, d: str) -> DataFrame:
    return _pools(spark, d)


@query(f"""WITH {_POOLS}, t AS (SELECT DISTINCT entry_id, ord, tag FROM entry_tags)
SELECT t.entry_id, t.ord, coalesce(p.idx, 0) AS idx, p.value FROM t JOIN live l ON l.entry_id = t.entry_id LEFT JOIN pools p ON p.pack_id = l.pack_id AND p.pool = 'tag' AND p.value = t.tag""")
def strref_resolve(spark: SparkSession, d: str) -> DataFrame:
    """String to index (0 if absent) and back to string (null for 0)."""
    p = _pools(spark, d).where("pool = 'tag'").select("pack_id", F.col("value").alias("_v"), "idx")
    t = once(spark, d, "entry_tags").join(heads(spark, d).select("entry_id", "pack_id"), "entry_id").withColumnRenamed("pack_id", "_pack")
    ref = t.join(p, (F.col("_pack") == p["pack_id"]) & (F.col("tag") == F.col("_v")), "left").select("entry_id", "ord", "_pack", F.coalesce("idx", F.lit(0)).alias("idx"))
    back = p.select(F.col("pack_id").alias("_p"), F.col("idx").alias("_i"), F.col("_v").alias("value"))
    return ref.join(back, (F.col("_pack") == F.col("_p")) & (F.col("idx") == F.col("_i")), "left").select("entry_id", "ord", "idx", "value")


def _tag_postings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "entry_tags").where("tag IS NOT NULL").select("entry_id", "tag")
    return index.postings(t.join(numbered(spark, d).select("entry_id", "pack_id", "ordinal"), "entry_id"), "tag")


_TAGP = _NUM + """, tp AS (SELECT n.pack_id, t.tag, n.ordinal // 65536 AS chunk, list_sort(list(DISTINCT n.ordinal)) AS ids
 FROM entry_tags t JOIN num n ON n.entry_id = t.entry_id WHERE t.tag IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_TAGP} SELECT pack_id, tag, CAST(chunk AS BIGINT) AS chunk, array_to_string(ids, ',') AS ids FROM tp")
def tag_postings(spark: SparkSession, d: str) -> DataFrame:
    return _tag_postings(spark, d).select("pack_id", "tag", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""WITH {_TAGP} SELECT pack_id, tag, CAST(chunk AS BIGINT) AS chunk,
array_to_string(list_transform(range(1, len(ids) + 1), lambda i: ids[i] - CASE WHEN i > 1 THEN ids[i - 1] ELSE 0 END), ',') AS deltas, true AS same FROM tp""")
def postings_delta(spark: SparkSession, d: str) -> DataFrame:
    p = _tag_postings(spark, d).withColumn("d", T.deltas(F.col("ids")))
    return p.select("pack_id", "tag", "chunk", F.array_join(F.col("d").cast("array<string>"), ",").alias("deltas"), (T.undeltas(F.col("d")) == F.col("ids")).alias("same"))


# feats in the oracle: none of its patterns looks around, and the data have no backslash before the end of a text
_SEGS = r"regexp_extract_all(feats || '|', '(?s)((?:\\.|[^|\\])*)\|', 1)"
_FEATS = f"fs AS (SELECT DISTINCT form_id, entry_id, feats FROM forms WHERE feats <> ''), seg AS (SELECT form_id, entry_id, {_SEGS} AS segs FROM fs)"


@query(f"WITH {_FEATS} SELECT form_id, array_to_string(segs, '␟') AS feats FROM seg")
def feats_split(spark: SparkSession, d: str) -> DataFrame:
    f = once(spark, d, "forms").where(F.coalesce("feats", F.lit("")) != "")
    return f.select("form_id", F.array_join(T.feats("feats"), "␟").alias("feats"))


@query(f"""WITH {_NUM}, {_FEATS}, k AS (SELECT entry_id, unnest(segs) AS key FROM seg)
SELECT n.pack_id, k.key, CAST(n.ordinal // 65536 AS BIGINT) AS chunk, array_to_string(list_sort(list(DISTINCT n.ordinal)), ',') AS ids FROM k JOIN num n ON n.entry_id = k.entry_id GROUP BY n.pack_id, k.key, n.ordinal // 65536""")
def morph_postings(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "forms").select("entry_id", F.explode(T.feats("feats")).alias("key"))
    p = index.postings(keys.join(numbered(spark, d).select("entry_id", "pack_id", "ordinal"), "entry_id"), "key")
    return p.select("pack_id", "key", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {_E}, {_FEATS}, k AS (SELECT entry_id, unnest(segs) AS key FROM seg) SELECT l.pack_id, count(DISTINCT key) AS keys FROM k JOIN live l ON l.entry_id = k.entry_id GROUP BY l.pack_id")
def morph_key_count(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "forms").select("entry_id", F.explode(T.feats("feats")).alias("key"))
    return keys.join(heads(spark, d).select("entry_id", "pack_id"), "entry_id").groupBy("pack_id").agg(F.countDistinct("key").alias("keys"))


@query(f"""WITH {_E} SELECT entry_id FROM (SELECT entry_id FROM entry_tags WHERE tag = 'core:general' INTERSECT SELECT entry_id FROM (SELECT entry_id FROM entry_tags WHERE tag = 'level:B1' UNION SELECT entry_id FROM entry_tags WHERE tag = 'level:B2'))
EXCEPT SELECT entry_id FROM entry_tags WHERE tag = 'domain:general'""")
def tags_and_or_not(spark: SparkSession, d: str) -> DataFrame:
    """core:general AND (level:B1 OR level:B2) AND NOT domain:general."""
    with_tag = lambda *tags: table(spark, d, "entry_tags").where(F.col("tag").isin(*tags)).select("entry_id")
    return with_tag("core:general").join(with_tag("level:B1", "level:B2"), "entry_id", "left_semi").join(with_tag("domain:general"), "entry_id", "left_anti").distinct()


@query(f"WITH {_NUM} SELECT e.pack_id, e.entry_id FROM num e JOIN (SELECT DISTINCT entry_id FROM entry_tags WHERE tag = 'level:C1') t ON t.entry_id = e.entry_id")
def postings_to_entries(spark: SparkSession, d: str) -> DataFrame:
    """From the ordinals of a posting list back to entries."""
    num = numbered(spark, d).select("pack_id", "entry_id", "ordinal")
    ids = _tag_postings(spark, d).where("tag = 'level:C1'").select("pack_id", F.explode("ids").alias("ordinal"))
    return ids.join(num, ["pack_id", "ordinal"]).select("pack_id", "entry_id")


@query(f"WITH {_NUM} SELECT 'not in order' AS rule, pack_id || '/' || CAST(max(ordinal) OVER (PARTITION BY pack_id) - ordinal AS BIGINT) AS key FROM num WHERE ordinal > 0")
def sortedness(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours out of order: none as the entries are numbered, all if they are numbered backwards."""
    num = numbered(spark, d)
    back = num.withColumn("ordinal", F.max("ordinal").over(Window.partitionBy("pack_id")) - F.col("ordinal"))
    return validate.sortedness(num).unionByName(validate.sortedness(back))


# ---------------------------------------------------------------- graph


@query(f"WITH {_EDGES} SELECT pack_id, src, type, dst, ord FROM edges")
def outgoing_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query(f"WITH {_EDGES} SELECT e.pack_id, src, type, dst, ord FROM edges e ANTI JOIN live l ON l.pack_id = e.pack_id AND l.headword = e.dst")
def relation_validate(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(edges(spark, d), heads(spark, d), hot_targets(spark, d))


_SANE = _EDGES + ", sane AS (SELECT e.pack_id, src, type, dst, min(e.ord) AS ord FROM edges e SEMI JOIN live l ON l.pack_id = e.pack_id AND l.headword = e.dst WHERE src <> dst GROUP BY e.pack_id, src, type, dst)"


@query(f"WITH {_SANE} SELECT * FROM sane")
def relation_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return graph.sanitized(edges(spark, d), heads(spark, d), hot_targets(spark, d))


@query(f"""WITH {_SANE} SELECT pack_id, src, type, dst, true AS authored FROM sane UNION ALL
SELECT *, false FROM (SELECT DISTINCT pack_id, dst AS src, type, src AS dst FROM sane WHERE type IN ('syn', 'ant') EXCEPT SELECT pack_id, src, type, dst FROM sane)""")
def symmetric_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_reverse(graph.sanitized(edges(spark, d), heads(spark, d), hot_targets(spark, d)))


_DECLARED = "declared AS (SELECT DISTINCT pack_id, src AS phrase, dst AS component FROM edges WHERE type = 'der')"


def _declared(spark: SparkSession, d: str) -> DataFrame:
    """Declared components of phrases: here what an entry is derived from."""
    return edges(spark, d).where("type = 'der'").select("pack_id", F.col("src").alias("phrase"), F.col("dst").alias("component"))


@query(f"""WITH {_EDGES}, {_DECLARED} SELECT x.pack_id, component AS src, phrase AS dst, 'phrase' AS type FROM declared x SEMI JOIN live l ON l.pack_id = x.pack_id AND l.headword = x.component
EXCEPT SELECT pack_id, src, dst, type FROM edges WHERE type = 'phrase'""")
def phrase_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.phrase_edges(_declared(spark, d), heads(spark, d), edges(spark, d))


@query(f"WITH {_EDGES}, {_DECLARED} SELECT x.pack_id, phrase, component FROM declared x ANTI JOIN live l ON l.pack_id = x.pack_id AND l.headword = x.component")
def phrase_missing(spark: SparkSession, d: str) -> DataFrame:
    return graph.missing_components(_declared(spark, d), heads(spark, d))


@query(f"""WITH {_E} SELECT DISTINCT pack_id, headword AS phrase, w AS component FROM (SELECT pack_id, headword, unnest(string_split(headword, ' ')) AS w FROM live WHERE contains(headword, ' ')) WHERE w <> '' AND w <> headword""")
def phrase_words(spark: SparkSession, d: str) -> DataFrame:
    return graph.words_of(heads(spark, d))


def _redirects(spark: SparkSession, d: str) -> DataFrame:
    return heads(spark, d).where(F.coalesce("see", F.lit("")) != "").select("pack_id", F.col("headword").alias("src"), F.col("see").alias("dst"))


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT pack_id, headword AS src, see AS dst FROM live WHERE see <> ''),
walk AS (SELECT pack_id, src, dst, 1 AS hops, [src, dst] AS seen FROM r
 UNION ALL SELECT w.pack_id, w.src, r.dst, w.hops + 1, list_append(w.seen, r.dst) FROM walk w JOIN r ON r.pack_id = w.pack_id AND r.src = w.dst WHERE w.hops < 8 AND NOT list_contains(w.seen, r.dst))
SELECT pack_id, src, arg_max(dst, hops) AS dst, max(hops) AS hops FROM walk GROUP BY pack_id, src""")
def redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.redirect_chains(_redirects(spark, d))


@query(f"WITH {_E} SELECT DISTINCT o.pack_id, o.headword AS src FROM once o SEMI JOIN live l ON l.pack_id = o.pack_id AND l.headword = o.headword WHERE o.deleted_at IS NOT NULL")
def redirect_rule3(spark: SparkSession, d: str) -> DataFrame:
    """Redirected headwords that still resolve; the headwords of deleted entries are the redirected ones."""
    gone = table(spark, d, "entries").where("deleted_at IS NOT NULL").select("pack_id", F.col("headword").alias("src")).distinct()
    return graph.unsettled(gone, heads(spark, d)).select("pack_id", "src")


@query("""WITH once AS (SELECT DISTINCT pack_id, entry_id, headword, ord FROM entries) SELECT pack_id, headword, entry_id FROM once QUALIFY row_number() OVER (PARTITION BY pack_id, headword ORDER BY ord, entry_id) = 1""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entries").select("pack_id", "entry_id", "headword", "ord").distinct()
    return graph.keep_first(e, ["pack_id", "headword"], ["ord", "entry_id"]).select("pack_id", "headword", "entry_id")


# ---------------------------------------------------------------- nesting and content


@query(f"WITH {_E} SELECT l.pack_id, l.entry_id FROM live l WHERE l.see <> '' OR EXISTS (SELECT 1 FROM senses s WHERE s.entry_id = l.entry_id)")
def has_content(spark: SparkSession, d: str) -> DataFrame:
    return nest.has_content(heads(spark, d), table(spark, d, "senses")).select("pack_id", "entry_id")


@query(f"WITH {_E} SELECT l.pack_id, count(*) AS entries FROM live l WHERE EXISTS (SELECT 1 FROM senses s WHERE s.entry_id = l.entry_id) GROUP BY l.pack_id")
def content_counts(spark: SparkSession, d: str) -> DataFrame:
    return heads(spark, d).join(table(spark, d, "senses").select("entry_id"), "entry_id", "left_semi").groupBy("pack_id").agg(F.count(F.lit(1)).alias("entries"))


@query(f"""WITH {_E}, f AS (SELECT entry_id, ety_ord, sense_ord, string_agg(coalesce(kind, '-') || ':' || coalesce(term, '-'), ',' ORDER BY ord, kind NULLS FIRST, term NULLS FIRST) AS fs
 FROM (SELECT DISTINCT form_id, entry_id, ety_ord, sense_ord, ord, kind, term FROM forms) GROUP BY ALL),
s AS (SELECT s.entry_id, string_agg(coalesce(pos, '-') || '(' || coalesce(fs, '') || ')', ';' ORDER BY s.ety_ord, s.sense_ord) AS senses
 FROM (SELECT DISTINCT entry_id, ety_ord, sense_ord, pos FROM senses) s LEFT JOIN f ON f.entry_id = s.entry_id AND f.ety_ord = s.ety_ord AND f.sense_ord = s.sense_ord GROUP BY s.entry_id)
SELECT l.entry_id, l.headword, coalesce(s.senses, '') AS senses FROM live l LEFT JOIN s ON s.entry_id = l.entry_id""")
def nested_assembly(spark: SparkSession, d: str) -> DataFrame:
    a = nest.assembled(heads(spark, d), once(spark, d, "senses").drop("tags").distinct(), once(spark, d, "forms").select("form_id", "entry_id", "ety_ord", "sense_ord", "ord", "kind", "term").distinct())
    form = lambda f: F.concat(F.coalesce(f["kind"], F.lit("-")), F.lit(":"), F.coalesce(f["term"], F.lit("-")))
    sense = lambda s: F.concat(F.coalesce(s["pos"], F.lit("-")), F.lit("("), F.array_join(F.transform(s["forms"], form), ","), F.lit(")"))
    return a.select("entry_id", "headword", F.array_join(F.transform("senses", sense), ";").alias("senses"))


@query("SELECT entry_id, ety_ord, sense_ord, CAST(row_number() OVER (PARTITION BY entry_id, ety_ord ORDER BY sense_ord) AS INTEGER) AS number FROM (SELECT DISTINCT entry_id, ety_ord, sense_ord FROM senses)")
def sense_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "senses").select("entry_id", "ety_ord", "sense_ord").distinct().selectExpr(
        "entry_id", "ety_ord", "sense_ord", "row_number() OVER (PARTITION BY entry_id, ety_ord ORDER BY sense_ord) AS number"
    )


def _translations(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "raw_id", "path", "kind", "payload").where("kind = 'translation'").select(
        "raw_id", "path", F.get_json_object("payload", "$.lang").alias("lang"), F.get_json_object("payload", "$.value").alias("value")
    )


@query(NODES + "SELECT raw_id, path, j ->> '$.lang' AS lang, j ->> '$.value' AS value FROM nodes WHERE kind = 'translation' AND j ->> '$.lang' IN ('de', 'zh')")
def target_lang_filter(spark: SparkSession, d: str) -> DataFrame:
    """Translations into the target languages; those without a language go."""
    return _translations(spark, d).where(F.col("lang").isin("de", "zh"))


@query(NODES + "SELECT raw_id, path, CASE WHEN regexp_matches(path, '(^|/)n[0-9]+/') THEN j ->> '$.lang' ELSE coalesce(j ->> '$.lang', 'en') END AS lang FROM nodes WHERE kind = 'translation'")
def lang_fill(spark: SparkSession, d: str) -> DataFrame:
    """Translations without a language get the sole target; those of examples of notes don't."""
    note = F.col("path").rlike(r"(^|/)n\d+/")
    return _translations(spark, d).select("raw_id", "path", F.when(note, F.col("lang")).otherwise(F.coalesce("lang", F.lit("en"))).alias("lang"))


@query(NODES + "SELECT raw_id, coalesce(array_to_string(list_sort(list(DISTINCT j ->> '$.lang') FILTER (WHERE (j ->> '$.lang') IS NOT NULL)), ','), '') AS langs, count(DISTINCT j ->> '$.lang') > 1 AS labelled FROM nodes WHERE kind = 'translation' GROUP BY raw_id")
def translation_langs(spark: SparkSession, d: str) -> DataFrame:
    return nest.languages(_translations(spark, d))


@query(NODES + "SELECT raw_id, CAST(row_number() OVER (PARTITION BY raw_id ORDER BY array_to_string(list_transform(string_split(path, '/'), lambda p: p[1] || lpad(p[2:], 9, '0')), '/')) AS INTEGER) AS n, j ->> '$.value' AS value FROM nodes WHERE kind = 'example'")
def examples_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The examples of each record in document order: raw_id, n (from 1), value."""
    ex = nest.in_order(nodes(spark, d, "raw_id", "path", "kind", "payload").where("kind = 'example'"))
    return ex.selectExpr("raw_id", "row_number() OVER (PARTITION BY raw_id ORDER BY place) AS n", "get_json_object(payload, '$.value') AS value")


_PACK_OF = "(SELECT raw_id, arg_min(pack_id, {'l': loaded_at, 'b': body}) AS pack_id FROM raw_entries GROUP BY raw_id)"


def _packs_of(spark: SparkSession, d: str) -> DataFrame:
    """raw_id, pack_id: of repeated deliveries the earliest."""
    return table(spark, d, "raw_entries").groupBy("raw_id").agg(F.min(F.struct("loaded_at", "body", "pack_id")).alias("f")).select("raw_id", "f.pack_id")


@query(NODES + f""", target AS (SELECT DISTINCT pack_id FROM nodes n JOIN {_PACK_OF} p ON p.raw_id = n.raw_id WHERE kind = 'translation' AND (j ->> '$.lang') = 'ja')
SELECT n.raw_id, n.path, k.keep, CASE WHEN NOT k.keep AND p.pack_id IN (SELECT pack_id FROM target) THEN '' ELSE n.j ->> '$.value' END AS value
FROM nodes n JOIN {_PACK_OF} p ON p.raw_id = n.raw_id, (VALUES (true), (false)) k(keep) WHERE n.kind = 'definition'""")
def defs_mode(spark: SparkSession, d: str) -> DataFrame:
    """Definition texts kept, and dropped as in packs that have a target language (here: Japanese, where a pack has translations into it)."""
    n = nodes(spark, d, "raw_id", "path", "kind", "payload").join(_packs_of(spark, d), "raw_id")
    value = F.get_json_object("payload", "$.value").alias("value")
    targets = n.where("kind = 'translation'").select("pack_id", F.get_json_object("payload", "$.lang").alias("lang")).where("lang = 'ja'")
    defs = n.where("kind = 'definition'").select("raw_id", "path", "pack_id", value)
    modes = [nest.kept_definitions(defs, targets, keep).withColumn("keep", F.lit(keep)) for keep in (True, False)]
    return modes[0].unionByName(modes[1]).select("raw_id", "path", "keep", "value")


@query(NODES + """, own AS (SELECT raw_id, path FROM nodes WHERE kind = 'note' OR (kind = 'definition' AND (coalesce(j ->> '$.value', '') <> '' OR coalesce(json_array_length(j, '$.media'), 0) > 0)))
SELECT raw_id, path, EXISTS (SELECT 1 FROM own o WHERE o.raw_id = d.raw_id AND (o.path = d.path OR starts_with(o.path, d.path || '/'))) AS visible FROM nodes d WHERE kind IN ('definition', 'group')""")
def def_visible(spark: SparkSession, d: str) -> DataFrame:
    return nest.visible_definitions(nodes(spark, d, "raw_id", "path", "kind", "payload"))


_SPANNED = NODES + """, sp AS (SELECT raw_id || '/' || path AS key, j ->> '$.value' AS value, strlen(j ->> '$.value') AS size, list_transform(CAST(json_extract(j, '$.targets') AS JSON[]), lambda t: CAST(json_extract(t, '$.spans') AS JSON[])) AS ts
 FROM nodes WHERE kind = 'example' AND json_type(json_extract(j, '$.targets')) = 'ARRAY' AND (j ->> '$.value') IS NOT NULL),
ends AS (SELECT key, value, size, len(flatten(ts)) AS n, list_max(list_transform(flatten(ts), lambda s: CAST(s ->> '$.offset' AS BIGINT) + CAST(s ->> '$.length' AS BIGINT))) AS stop FROM sp)
"""


@query(_SPANNED + """SELECT key, 'as it is' AS planted, 'span out of range' AS rule FROM ends WHERE n > 0 AND stop > size
UNION ALL SELECT key, 'beyond the end', 'span out of range' FROM ends WHERE n > 0 UNION ALL SELECT key, 'without length', 'span out of range' FROM ends WHERE n > 0
UNION ALL SELECT key, 'twice', 'spans overlap' FROM ends WHERE n > 0 UNION ALL SELECT key, 'twice', 'span out of range' FROM ends WHERE n > 0 AND stop > size UNION ALL SELECT key, 'without spans', 'target without span' FROM ends WHERE n > 0""")
def span_validation(spark: SparkSession, d: str) -> DataFrame:
    """Examples whose target spans break a rule: as they are, and with faults planted into each."""
    ex = nodes(spark, d, "raw_id", "path", "kind", "payload").where("kind = 'example'")
    kind = "array<struct<spans:array<struct<offset:bigint,length:bigint>>>>"
    targets = F.coalesce(F.from_json(F.get_json_object("payload", "$.targets"), kind), F.array().cast(kind))
    own = ex.select(F.concat_ws("/", "raw_id", "path").alias("key"), F.get_json_object("payload", "$.value").alias("value"), targets.alias("targets"))
    own = own.where("value IS NOT NULL AND exists(targets, t -> size(t.spans) > 0)")
    each = lambda f: F.transform("targets", lambda t: F.struct(f(t["spans"]).alias("spans")))
    moved = lambda o, n: each(lambda s: F.transform(s, lambda x: F.struct(o(x).alias("offset"), n(x).alias("length"))))
    size = F.octet_length("value").cast("bigint")
    plants = {
        "as it is": F.col("targets"), "beyond the end": moved(lambda x: x["offset"] + size, lambda x: x["length"]), "without length": moved(lambda x: x["offset"], lambda x: F.lit(0).cast("bigint")),
        "twice": F.concat("targets", "targets"), "without spans": each(lambda s: F.slice(s, 1, 0)),
    }
    found = [validate.bad_spans(own.withColumn("targets", F.when(F.size("targets") > 0, t))).withColumn("planted", F.lit(name)) for name, t in plants.items()]
    return reduce(DataFrame.unionByName, found).select("key", "planted", "rule")


# ---------------------------------------------------------------- scalar functions over the tables


@query("""SELECT DISTINCT tag, CASE WHEN contains(tag, ':') THEN split_part(tag, ':', 1) END AS category, CASE WHEN contains(tag, ':') THEN substr(tag, instr(tag, ':') + 1) END AS value,
CASE WHEN contains(tag, ':') THEN string_split(substr(tag, instr(tag, ':') + 1), '-')[-1] END AS label, coalesce(CASE WHEN contains(tag, ':') THEN split_part(tag, ':', 1) END = 'exam', false) AS visible,
CASE WHEN contains(tag, ':') THEN regexp_replace(substr(tag, instr(tag, ':') + 1), '-[^-]*$', '') END AS series FROM entry_tags WHERE tag IS NOT NULL""")
def tag_parse(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "entry_tags").where("tag IS NOT NULL").select("tag").distinct()
    return t.select("tag", T.tag_category("tag").alias("category"), T.tag_value("tag").alias("value"), T.tag_label("tag").alias("label"), T.tag_visible("tag").alias("visible"), T.tag_series("tag").alias("series"))


@query(f"""WITH {_E}, w AS (SELECT DISTINCT headword AS word, lower(headword) AS l FROM live WHERE headword <> ''), f AS (SELECT word, CASE WHEN strlen(word) = length(word) THEN
[word, l||'s', l||'es', l||'ed', l||'d', l||'ing', l||'ly', CASE WHEN l LIKE '%e' THEN l[:-2]||'ing' END, CASE WHEN l LIKE '%e' THEN l[:-2]||'ed' END, CASE WHEN l LIKE '_%y' THEN l[:-2]||'ies' END, CASE WHEN l LIKE '_%y' THEN l[:-2]||'ied' END]
ELSE [word] END AS fs FROM w) SELECT word, array_to_string(list_filter(fs, lambda x, i: x IS NOT NULL AND NOT list_contains(fs[:i-1], x)), ',') AS forms FROM f""")
def inflected_forms(spark: SparkSession, d: str) -> DataFrame:
    return heads(spark, d).where("headword <> ''").select(F.col("headword").alias("word")).distinct().select("word", F.array_join(T.inflected("word"), ",").alias("forms"))


_MORPHS = """m AS (SELECT entry_id, string_agg(coalesce(kind, '-') || '=' || term, '|' ORDER BY ord, kind NULLS FIRST, term) AS x, string_agg(coalesce(kind, '') || '=' || term, '|' ORDER BY ord, kind NULLS FIRST, term) AS y
 FROM (SELECT DISTINCT entry_id, ord, kind, term FROM morphology WHERE term IS NOT NULL) GROUP BY entry_id)"""


@query(f"WITH {_E}, {_MORPHS} SELECT entry_id, 'objects' AS shape, x AS morphemes FROM m UNION ALL SELECT entry_id, 'pairs', y FROM m UNION ALL SELECT entry_id, 'text', 'root=' || headword FROM live WHERE headword <> '' AND NOT starts_with(headword, '[')")
def morphology_parse(spark: SparkSession, d: str) -> DataFrame:
    """Morphemes written as JSON objects, as JSON pairs and as plain text, read back."""
    m = once(spark, d, "morphology").where("term IS NOT NULL").select("entry_id", "ord", "kind", "term").distinct()
    own = m.groupBy("entry_id").agg(nest.ordered("ord", "kind", "term").alias("m"))
    objects = own.select("entry_id", F.lit("objects").alias("shape"), F.to_json(F.transform("m", lambda x: F.struct(x["kind"].alias("kind"), x["term"].alias("term")))).alias("raw"))
    pairs = own.select("entry_id", F.lit("pairs").alias("shape"), F.to_json(F.transform("m", lambda x: F.array(F.coalesce(x["kind"], F.lit("")), x["term"]))).alias("raw"))
    text = heads(spark, d).where("headword <> '' AND NOT startswith(headword, '[')").select("entry_id", F.lit("text").alias("shape"), F.col("headword").alias("raw"))
    every = objects.unionByName(pairs).unionByName(text)
    return every.select("entry_id", "shape", F.array_join(F.transform(T.morphology("raw"), lambda x: F.concat(F.coalesce(x["kind"], F.lit("-")), F.lit("="), x["term"])), "|").alias("morphemes"))


_LANGS = "l AS (SELECT DISTINCT coalesce(lang, '?') AS lang FROM documents)"


@query(f"WITH {_LANGS} SELECT lang, CASE lang WHEN 'zh' THEN 'zh-Hans' WHEN 'es' THEN 'es-ES' ELSE lang END AS long, lang AS short, CASE lang WHEN 'en' THEN 'En' WHEN 'ja' THEN '日' WHEN 'zh' THEN '中' WHEN 'es' THEN 'Es' ELSE lang END AS label FROM l")
def lang_alias(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("lang")
    x = table(spark, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang")).distinct().withColumn("long", T.long_lang(c))
    return x.select("lang", "long", T.short_lang(F.col("long")).alias("short"), T.mapped(F.col("long"), T.LANG_LABELS, F.col("long")).alias("label"))


@query("""WITH p AS (SELECT pack_id, list_sort(list(DISTINCT lang)) AS langs FROM documents WHERE lang IS NOT NULL GROUP BY pack_id)
SELECT pack_id, 'lexframe.en-' || array_to_string(langs, '+') AS bilingual, 'lexframe.en-en+' || array_to_string(langs, '+') AS explanatory,
'dictionary_en_' || array_to_string(list_concat(list_concat(list_filter(langs, lambda x: x = 'zh'), list_filter(langs, lambda x: x = 'en')), list_filter(langs, lambda x: x <> 'zh' AND x <> 'en')), '+') AS file FROM p""")
def pack_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").where("lang IS NOT NULL").groupBy("pack_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    long = F.transform("langs", lambda x: F.when(x == "zh", "zh-Hans").otherwise(x))
    file = T.pack_file(F.lit("en"), long)
    return p.select(
        "pack_id", T.pack_key(F.lit("en"), long, F.lit(False)).alias("bilingual"), T.pack_key(F.lit("en"), long, F.lit(True)).alias("explanatory"), F.replace(file, F.lit("zh-Hans"), F.lit("zh")).alias("file")
    )


@query("""WITH p AS (SELECT DISTINCT pos FROM senses WHERE pos IS NOT NULL), m AS (SELECT * FROM (VALUES ('NOUN','n'),('VERB','v'),('ADJ','adj'),('ADV','adv'),('PRON','pron'),('DET','det'),('ADP','prep'),('NUM','num'),('CCONJ','conj'),('SCONJ','conj'),('INTJ','intj'),('PROPN','n'),('AUX','aux'),('PART','part'),('SYM','sym'),('PUNCT','punct'),('X','x')) t(k, v))
SELECT pos, coalesce(v, lower(pos)) AS label, CASE WHEN upper(pos) IN ('NOUN', 'PROPN') THEN '64,140,217' WHEN upper(pos) = 'VERB' THEN '204,89,77' WHEN upper(pos) = 'ADJ' THEN '77,166,115' WHEN upper(pos) = 'ADV' THEN '191,128,51' WHEN upper(pos) = 'PRON' THEN '153,102,191'
WHEN upper(pos) IN ('DET', 'ADP') THEN '140,140,140' WHEN upper(pos) = 'NUM' THEN '166,115,77' WHEN upper(pos) IN ('CCONJ', 'SCONJ') THEN '128,128,153' WHEN upper(pos) = 'INTJ' THEN '217,140,38' ELSE '128,128,128' END AS colour FROM p LEFT JOIN m ON k = upper(pos)""")
def pos_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "senses").where("pos IS NOT NULL").select("pos").distinct()
    return p.select("pos", T.mapped(F.upper("pos"), T.POS_LABELS, F.lower("pos")).alias("label"), T.mapped(F.upper("pos"), T.POS_COLOURS, F.lit(T.OTHER_COLOUR)).alias("colour"))


@query("""SELECT DISTINCT 'morpheme' AS field, kind AS value, CASE kind WHEN 'prefix' THEN 'Prefix' WHEN 'suffix' THEN 'Suffix' WHEN 'root' THEN 'Root' WHEN 'combining_form' THEN 'Combining form' ELSE coalesce(kind, '') END AS label FROM morphology
UNION ALL SELECT DISTINCT 'relation', type, CASE type WHEN 'syn' THEN 'Synonym' WHEN 'ant' THEN 'Antonym' WHEN 'der' THEN 'Derived' ELSE coalesce(type, '') END FROM relations""")
def label_maps(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "morphology").select(F.lit("morpheme").alias("field"), F.col("kind").alias("value")).distinct()
    r = table(spark, d, "relations").select(F.lit("relation").alias("field"), F.col("type").alias("value")).distinct()
    raw = F.coalesce("value", F.lit(""))
    return m.withColumn("label", T.mapped(F.col("value"), T.MORPHEME_LABELS, raw)).unionByName(r.withColumn("label", T.mapped(F.upper("value"), T.RELATION_LABELS, raw)))


@query("SELECT DISTINCT pos, nullif(pos, '') AS kept FROM senses")
def empty_to_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "senses").select("pos").distinct().select("pos", T.none_if_empty("pos").alias("kept"))


@query("""WITH h AS (SELECT DISTINCT form_id, '<div class="h">' || term || '</div> <b>&amp;lt;</b> &quot;' || coalesce(kind, '') || '&quot; <i' AS html FROM forms WHERE term IS NOT NULL)
SELECT form_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS text FROM h""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    f = once(spark, d, "forms").where("term IS NOT NULL")
    html = F.concat(F.lit('<div class="h">'), "term", F.lit("</div> <b>&amp;lt;</b> &quot;"), F.coalesce("kind", F.lit("")), F.lit("&quot; <i"))
    return f.select("form_id", T.plain_html(html).alias("text")).distinct()


@query("""WITH h AS (SELECT entry_id, string_agg('<li class="gloss">' || coalesce(term, ' ') || '</li>', '' ORDER BY ety_ord, sense_ord, ord, form_id) AS html FROM (SELECT DISTINCT form_id, entry_id, ety_ord, sense_ord, ord, term FROM forms) GROUP BY entry_id)
SELECT entry_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '<li class="gloss">(.*?)</li>', 1), lambda x: trim(x, ' ')), lambda x: x <> '')[:2], chr(31)) AS glosses FROM h""")
def glosses(spark: SparkSession, d: str) -> DataFrame:
    f = once(spark, d, "forms").select("form_id", "entry_id", "ety_ord", "sense_ord", "ord", "term").distinct()
    item = F.concat(F.lit('<li class="gloss">'), F.coalesce("term", F.lit(" ")), F.lit("</li>"))
    html = f.groupBy("entry_id").agg(nest.ordered("ety_ord", "sense_ord", "ord", "form_id", item.alias("i")).alias("x"))
    return html.select("entry_id", T.glosses(F.array_join(F.transform("x", lambda y: y["i"]), "")).alias("glosses"))


@query(f"WITH {_E}, h AS (SELECT entry_id, headword, '<span><ruby>' || headword || '<rt>' || fold || '</rt></ruby> x</span>' AS html FROM live) SELECT entry_id, headword || ' x' AS base, lower(headword) || ' x' AS reading FROM h")
def ruby(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<span><ruby>"), "headword", F.lit("<rt>"), "fold", F.lit("</rt></ruby> x</span>"))
    return heads(spark, d).select("entry_id", T.ruby_base(html).alias("base"), T.ruby_reading(html).alias("reading"))


@query(f"WITH {_E} SELECT entry_id, CASE WHEN see <> '' THEN see END AS target FROM live")
def link_records(spark: SparkSession, d: str) -> DataFrame:
    record = F.when(F.coalesce("see", F.lit("")) != "", F.concat(F.lit("@@@LINK="), "see", F.lit("\r\n"))).otherwise(F.col("headword"))
    return heads(spark, d).select("entry_id", T.link_target(record).alias("target"))


_HITS = """t AS (SELECT doc_id, text, headword FROM documents WHERE text IS NOT NULL AND headword IS NOT NULL AND headword <> ''),
p AS (SELECT doc_id, text, headword, string_split(lower(text), lower(headword)) AS ps, length(headword) AS n, lower(text) AS low FROM t),
s AS (SELECT doc_id, text, low, n, list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[:i], lambda x: length(x))) + (i - 1) * n) AS starts FROM p),
h AS (SELECT doc_id, text, n, list_filter(starts, lambda s: NOT regexp_matches(low[CAST(s AS BIGINT)], '[A-Za-z0-9]') AND NOT regexp_matches(low[CAST(s + n + 1 AS BIGINT)], '[A-Za-z0-9]'))[:8] AS hits FROM s)"""


@query(f"""WITH {_HITS} SELECT doc_id, array_to_string(list_transform(hits, lambda s: CAST(strlen(left(text, CAST(s AS BIGINT))) AS BIGINT) || '+' || strlen(substr(text, CAST(s + 1 AS BIGINT), n))), ',') AS spans FROM h""")
def word_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL AND headword <> ''")
    spans = T.word_spans(F.col("text"), F.col("headword"))
    return docs.select("doc_id", F.array_join(F.transform(spans, lambda s: F.concat(s["offset"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",").alias("spans"))


@query(f"WITH {_HITS} SELECT doc_id, CAST(len(hits) AS INTEGER) AS marked, true AS whole FROM h")
def highlight_runs(spark: SparkSession, d: str) -> DataFrame:
    """Texts as alternating plain and marked runs; the runs joined are the text."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND headword <> ''")
    runs = T.highlight_runs(F.col("text"), T.word_spans(F.col("text"), F.col("headword")))
    return docs.select("doc_id", F.size(F.filter(runs, lambda r: r["marked"])).alias("marked"), (F.array_join(F.transform(runs, lambda r: r["text"]), "") == F.col("text")).alias("whole"))


@query(f"WITH {_E} SELECT entry_id, CAST(strlen(headword) AS BIGINT) AS bytes, CAST(list_sum(list_transform(string_split(headword, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN unicode(c) > 65535 THEN 2 ELSE 1 END)) AS BIGINT) AS units FROM live WHERE headword <> ''")
def utf16_offsets(spark: SparkSession, d: str) -> DataFrame:
    b = F.octet_length("headword")
    return heads(spark, d).where("headword <> ''").select("entry_id", b.cast("bigint").alias("bytes"), T.utf16_offset(F.col("headword"), b).cast("bigint").alias("units"))


@query(f"WITH {_NUM} SELECT entry_id, 'data/' || lpad(CAST(ordinal AS VARCHAR), 5, '0') || '.zst' AS path, CAST(ordinal AS INTEGER) AS number FROM num")
def block_paths(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d).select("entry_id", T.block_path(F.col("ordinal")).alias("path")).withColumn("number", T.block_number(F.col("path")))


# ---------------------------------------------------------------- media

_MAN = "man AS (SELECT pack_id, kind, sha1(bytes) AS hash, min({'o': ord, 'e': ext, 'm': mime, 'c': compression, 's': octet_length(bytes)}) AS f FROM media GROUP BY pack_id, kind, sha1(bytes))"


@query("""SELECT pack_id, kind, hash, ord, ext, mime, compression, size FROM (SELECT pack_id, kind, sha1(bytes) AS hash, ord, ext, mime, compression, CAST(octet_length(bytes) AS BIGINT) AS size,
row_number() OVER (PARTITION BY pack_id, kind, sha1(bytes) ORDER BY ord, ext NULLS FIRST, mime NULLS FIRST) AS n FROM media) WHERE n = 1""")
def media_dedup(spark: SparkSession, d: str) -> DataFrame:
    return media.manifest(table(spark, d, "media"))


@query("""SELECT pack_id, hash, 'media/' || kind || '/' || hash[1:2] || '/' || hash || '.' || ext AS path FROM (SELECT pack_id, kind, sha1(bytes) AS hash, arg_min(ext, ord) AS ext FROM media GROUP BY ALL)""")
def media_paths(spark: SparkSession, d: str) -> DataFrame:
    return media.paths(media.manifest(table(spark, d, "media"))).select("pack_id", "hash", "path")


@query("SELECT pack_id, count(*) AS assets, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT pack_id, kind, sha1(bytes) AS h, any_value(octet_length(bytes)) AS size FROM media GROUP BY ALL) GROUP BY pack_id")
def media_totals(spark: SparkSession, d: str) -> DataFrame:
    return media.totals(media.manifest(table(spark, d, "media")))


@query(f"""WITH {_E}, refs AS (SELECT DISTINCT l.pack_id, owner_id, r.ord, kind, lower(hash) AS hash FROM media_refs r JOIN live l ON l.entry_id = TRY_CAST(split_part(owner_id, '/', 1) AS BIGINT)),
m AS (SELECT pack_id, kind, sha1(bytes) AS hash, arg_min(ext, ord) AS ext FROM media GROUP BY ALL)
SELECT r.pack_id, r.owner_id, r.ord, 'media/' || m.kind || '/' || m.hash[1:2] || '/' || m.hash || '.' || m.ext AS path FROM refs r LEFT JOIN m ON m.pack_id = r.pack_id AND m.kind = r.kind AND m.hash = r.hash""")
def media_resolve(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "media_refs").select("owner_id", "ord", "kind", "hash", F.substring_index("owner_id", "/", 1).try_cast("bigint").alias("entry_id")).distinct()
    r = r.join(heads(spark, d).select("entry_id", "pack_id"), "entry_id").select("pack_id", "owner_id", "ord", "kind", F.lower("hash").alias("hash")).distinct()
    hot = hot_values(table(spark, d, "media_refs").select(F.lower("hash").alias("h")), ["h"])["h"]
    return media.resolved(r, media.manifest(table(spark, d, "media")), hot)


# ---------------------------------------------------------------- rules and quality


@query(f"""WITH {_EDGES}, upos AS (SELECT unnest(string_split('{" ".join(T.UPOS)}', ' ')) AS p), s AS (SELECT DISTINCT entry_id, ety_ord, sense_ord, pos FROM senses)
SELECT 'headword empty' AS rule, CAST(entry_id AS VARCHAR) AS key FROM live WHERE coalesce(headword, '') = ''
UNION ALL SELECT 'headword repeated', pack_id || '/' || headword FROM live GROUP BY pack_id, headword HAVING count(*) > 1
UNION ALL SELECT 'relation without target', pack_id || '/' || src || '/' || ord FROM edges WHERE coalesce(dst, '') = ''
UNION ALL SELECT 'relation to itself', pack_id || '/' || src || '/' || ord FROM edges WHERE src = dst
UNION ALL SELECT 'relation dangling', e.pack_id || '/' || src || '/' || ord FROM edges e ANTI JOIN live l ON l.pack_id = e.pack_id AND l.headword = e.dst WHERE coalesce(dst, '') <> ''
UNION ALL SELECT 'relation repeated', pack_id || '/' || src || '/' || coalesce(type, '∅') || '/' || dst FROM edges GROUP BY pack_id, src, type, dst HAVING count(*) > 1
UNION ALL SELECT 'pos unknown', entry_id || '/' || ety_ord || '/' || sense_ord FROM s WHERE pos IS NOT NULL AND pos NOT IN (SELECT p FROM upos)
UNION ALL SELECT 'media kind or compression', pack_id || '/' || ord FROM media WHERE NOT coalesce(kind IN ('audio', 'image', 'video') AND compression IN ('none', 'zstd'), false)""")
def violations(spark: SparkSession, d: str) -> DataFrame:
    h, e = heads(spark, d), edges(spark, d)
    parts = [validate.entry_rules(h), validate.relation_rules(e, h, hot_targets(spark, d)), validate.sense_rules(once(spark, d, "senses").drop("tags")), validate.media_rules(table(spark, d, "media")), validate.pool_rules(_pools(spark, d))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {_E}, s AS (SELECT DISTINCT entry_id, ety_ord, sense_ord, pos FROM senses), f AS (SELECT DISTINCT form_id, entry_id FROM forms), t AS (SELECT DISTINCT entry_id, ord FROM entry_tags)
SELECT l.pack_id, count(*) AS headwords, CAST(sum(coalesce(sn, 0)) AS BIGINT) AS senses, CAST(sum(coalesce(np, 0)) AS BIGINT) AS no_pos, CAST(sum(coalesce(fn, 0)) AS BIGINT) AS forms, CAST(sum(coalesce(tn, 0)) AS BIGINT) AS tags FROM live l
LEFT JOIN (SELECT entry_id, count(*) AS sn, count(*) FILTER (WHERE coalesce(pos, '') = '') AS np FROM s GROUP BY entry_id) a ON a.entry_id = l.entry_id
LEFT JOIN (SELECT entry_id, count(*) AS fn FROM f GROUP BY entry_id) b ON b.entry_id = l.entry_id LEFT JOIN (SELECT entry_id, count(*) AS tn FROM t GROUP BY entry_id) c ON c.entry_id = l.entry_id GROUP BY l.pack_id""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(heads(spark, d), once(spark, d, "senses").drop("tags"), once(spark, d, "forms").select("form_id", "entry_id").distinct(), once(spark, d, "entry_tags"))


@query("SELECT entry_id, term, count(*) AS n FROM (SELECT DISTINCT form_id, entry_id, term FROM forms) WHERE term IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_forms(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated_forms(table(spark, d, "forms").select("form_id", "entry_id", "term").distinct())


@query("""WITH s AS (SELECT DISTINCT entry_id, ety_ord, sense_ord, pos FROM senses), m AS (SELECT * FROM (VALUES ('NOUN','n'),('VERB','v'),('ADJ','adj'),('ADV','adv'),('PRON','pron'),('DET','det'),('ADP','prep'),('NUM','num'),('CCONJ','conj'),('SCONJ','conj'),('INTJ','intj'),('PROPN','n'),('AUX','aux'),('PART','part'),('SYM','sym'),('PUNCT','punct'),('X','x')) t(k, v)),
l AS (SELECT s.*, CASE WHEN coalesce(pos, '') = '' THEN 'x' ELSE coalesce(v, lower(pos)) END AS l FROM s LEFT JOIN m ON k = upper(pos))
SELECT entry_id, ety_ord, sense_ord, CASE WHEN ety_ord > 0 THEN 'e' || (ety_ord + 1) || '.' ELSE '' END || l || '.' || row_number() OVER (PARTITION BY entry_id, ety_ord, l ORDER BY sense_ord) AS id FROM l""")
def pos_seq_ids(spark: SparkSession, d: str) -> DataFrame:
    return quality.pos_sequence_ids(table(spark, d, "senses").select("entry_id", "ety_ord", "sense_ord", "pos").distinct())


_FREQ = "f AS (SELECT DISTINCT entry_id, regexp_extract(tag, '^freq:([^=]+)=([0-9]+)$', 1) AS source, CAST(regexp_extract(tag, '^freq:([^=]+)=([0-9]+)$', 2) AS BIGINT) AS rank FROM entry_tags WHERE regexp_matches(tag, '^freq:([^=]+)=([0-9]+)$'))"


@query(f"WITH {_FREQ} SELECT entry_id, source, rank FROM f ORDER BY rank, entry_id, source LIMIT 50")
def freq_topn(spark: SparkSession, d: str) -> DataFrame:
    return quality.commonest(quality.frequency(table(spark, d, "entry_tags")), 50)


@query(f"WITH {_FREQ} SELECT entry_id, source, rank FROM f WHERE rank BETWEEN 100 AND 5000")
def freq_range(spark: SparkSession, d: str) -> DataFrame:
    return quality.frequency(table(spark, d, "entry_tags")).where(F.col("rank").between(100, 5000))


@query(f"""WITH {_E} SELECT headword, min(entry_id) AS entry_id FROM live l WHERE regexp_matches(headword, '^[a-z]+$') AND length(headword) BETWEEN 4 AND 9 AND EXISTS (SELECT 1 FROM senses s WHERE s.entry_id = l.entry_id)
GROUP BY headword ORDER BY md5('0' || headword), headword LIMIT 300""")
def word_sample(spark: SparkSession, d: str) -> DataFrame:
    return quality.sample_words(heads(spark, d), table(spark, d, "senses"))


@query("""SELECT 'entries' AS name, pack_id || '/' || headword AS key, count(*) AS n FROM (SELECT DISTINCT pack_id, headword, entry_id FROM entries) GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'relations', entry_id || '/' || coalesce(type, '∅') || '/' || coalesce(target, '∅'), count(*) FROM (SELECT DISTINCT entry_id, ord, type, target FROM relations) GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'media', pack_id || '/' || kind || '/' || sha1(bytes), count(*) FROM media GROUP BY ALL HAVING count(*) > 1""")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entries").select(F.lit("entries").alias("name"), F.concat_ws("/", "pack_id", "headword").alias("key"), "entry_id").distinct().drop("entry_id")
    m = table(spark, d, "media").select(F.lit("media").alias("name"), F.concat_ws("/", "pack_id", "kind", F.sha1("bytes")).alias("key"))
    r = table(spark, d, "relations").select("entry_id", "ord", "type", "target").distinct()
    r = r.select(F.lit("relations").alias("name"), F.concat_ws("/", "entry_id", F.coalesce("type", F.lit("∅")), F.coalesce("target", F.lit("∅"))).alias("key"))
    return e.unionByName(m).unionByName(r).groupBy("name", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---------------------------------------------------------------- packs, generation


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """ord, headword, body: the live entries of all packs as nested documents that keep the rules of a pack.

    Headwords lead with their pack, to be unique; relations are sanitized; parts of speech outside the universal ones are absent.
    """
    h = heads(spark, d).select("entry_id", F.concat_ws("/", "pack_id", "headword").alias("headword"), "see", F.col("entry_id").alias("ord"))
    keys = ["entry_id", "ety_ord", "sense_ord"]
    # Each table moves once, by its keys: what is then made distinct, grouped and joined lies together.
    only = lambda name, by, *cols: table(spark, d, name).select(*by, *cols).repartition(*by).distinct()
    tags = only("entry_tags", ["entry_id"], "ord", "tag").where("tag IS NOT NULL").groupBy("entry_id").agg(nest.ordered("ord", "tag").alias("t"))
    morph = only("morphology", ["entry_id"], "ord", "kind", "term").groupBy("entry_id").agg(nest.ordered("ord", "kind", F.coalesce("term", F.lit("")).alias("term")).alias("m"))
    sane = graph.sanitized(edges(spark, d), heads(spark, d), hot_targets(spark, d))
    rel = sane.groupBy(F.concat_ws("/", "pack_id", "src").alias("headword")).agg(nest.ordered("ord", "type", F.concat_ws("/", "pack_id", "dst").alias("target")).alias("r"))
    forms = only("forms", keys, "form_id", "ord", "kind", "term", "tags", "feats")
    forms = forms.groupBy(*keys).agg(nest.ordered("ord", "form_id", "kind", F.coalesce("term", F.lit("")).alias("term"), "tags", "feats").alias("forms"))
    senses = only("senses", keys, "pos", "lemma", "tags").withColumn("pos", F.when(F.col("pos").isin(*T.UPOS), F.col("pos"))).join(forms, keys, "left")
    etys = senses.repartition("entry_id").groupBy("entry_id", "ety_ord").agg(nest.ordered("sense_ord", "pos", "lemma", "tags", "forms").alias("senses")).groupBy("entry_id").agg(nest.ordered("ety_ord", "senses").alias("etymologies"))
    j = h.join(rel, "headword", "left").join(tags, "entry_id", "left").join(morph, "entry_id", "left").join(etys, "entry_id", "left")
    body = F.to_json(F.struct("see", F.transform("t", lambda x: x["tag"]).alias("tags"), F.col("m").alias("morphology"), F.col("r").alias("relations"), "etymologies"))
    return j.select("ord", "headword", body.alias("body"))


def written_pack(spark: SparkSession, d: str, docs: DataFrame, with_media: bool = False) -> str:
    """The path of a new pack of ``docs``, in as many files as there are tasks at a time."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    assets = table(spark, d, "media").select("ord", "kind", "ext", "mime", "compression", "bytes") if with_media else None
    pack.write_pack(docs, path, {"id": "all", "name": "All", "version": "1", "source_lang": "en", "target_langs": []}, assets, shards=max(2, spark.sparkContext.defaultParallelism))
    pack.register(spark)
    return path


@query(f"""WITH {_SANE}, n AS (SELECT pack_id, headword, pack_id || '/' || headword AS word, see, entry_id FROM live),
t AS (SELECT entry_id, string_agg(tag, ',' ORDER BY ord, tag) AS x FROM (SELECT DISTINCT entry_id, ord, tag FROM entry_tags WHERE tag IS NOT NULL) GROUP BY entry_id),
m AS (SELECT entry_id, string_agg(coalesce(kind, '-') || '=' || coalesce(term, ''), ',' ORDER BY ord, kind NULLS FIRST, term NULLS FIRST) AS x FROM (SELECT DISTINCT entry_id, ord, kind, term FROM morphology) GROUP BY entry_id),
r AS (SELECT pack_id, src, string_agg(coalesce(type, '-') || '>' || pack_id || '/' || dst, ',' ORDER BY ord, type NULLS FIRST, dst) AS x FROM sane GROUP BY pack_id, src),
f AS (SELECT entry_id, ety_ord, sense_ord, string_agg(coalesce(kind, '-') || ':' || coalesce(term, '') || ':' || coalesce(array_to_string(tags, '+'), '') || ':' || coalesce(feats, '-'), ',' ORDER BY ord, form_id) AS x
 FROM (SELECT DISTINCT form_id, entry_id, ety_ord, sense_ord, ord, kind, term, tags, feats FROM forms) GROUP BY ALL),
s AS (SELECT s.entry_id, string_agg(CASE WHEN pos IN ({", ".join(f"'{p}'" for p in T.UPOS)}) THEN pos ELSE '-' END || '/' || coalesce(lemma, '-') || '/' || coalesce(array_to_string(tags, '+'), '') || '(' || coalesce(f.x, '') || ')', ';' ORDER BY s.ety_ord, s.sense_ord) AS x
 FROM (SELECT DISTINCT entry_id, ety_ord, sense_ord, pos, lemma, tags FROM senses) s LEFT JOIN f ON f.entry_id = s.entry_id AND f.ety_ord = s.ety_ord AND f.sense_ord = s.sense_ord GROUP BY s.entry_id)
SELECT row_number() OVER (ORDER BY lower(word), word) - 1 AS ordinal, word AS headword, 'decoded' AS status,
 md5(coalesce(see, '-') || '|' || coalesce(t.x, '') || '|' || coalesce(m.x, '') || '|' || coalesce(r.x, '') || '|' || coalesce(s.x, '')) AS body
FROM n LEFT JOIN t ON t.entry_id = n.entry_id LEFT JOIN m ON m.entry_id = n.entry_id LEFT JOIN r ON r.pack_id = n.pack_id AND r.src = n.headword LEFT JOIN s ON s.entry_id = n.entry_id""")
def pack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All live entries written as one pack and read back through the data source: a digest of everything in each."""
    back = spark.read.format("lexpack").load(written_pack(spark, d, documents_of(spark, d)))
    schema = (
        "see string, tags array<string>, morphology array<struct<kind:string,term:string>>, relations array<struct<type:string,target:string>>, "
        "etymologies array<struct<senses:array<struct<pos:string,lemma:string,tags:array<string>,forms:array<struct<kind:string,term:string,tags:array<string>,feats:string>>>>>>"
    )
    dash = lambda c: F.coalesce(c, F.lit("-"))
    text = lambda c, f, sep=",": F.array_join(F.transform(c, f), sep)
    form = lambda x: F.concat_ws(":", dash(x["kind"]), x["term"], F.array_join(x["tags"], "+"), dash(x["feats"]))
    sense = lambda x: F.concat(F.concat_ws("/", dash(x["pos"]), dash(x["lemma"]), F.array_join(x["tags"], "+")), F.lit("("), text(x["forms"], form), F.lit(")"))
    v = back.withColumn("v", F.from_json("body", schema)).select("ordinal", "headword", "status", "v.*")
    parts = [dash(F.col("see")), F.array_join("tags", ","), text("morphology", lambda x: F.concat(dash(x["kind"]), F.lit("="), x["term"])), text("relations", lambda x: F.concat(dash(x["type"]), F.lit(">"), x["target"]))]
    senses = text(F.flatten(F.transform("etymologies", lambda e: e["senses"])), sense, ";")
    return v.select("ordinal", "headword", "status", F.md5(F.concat_ws("|", *parts, senses)).alias("body"))


@query("""SELECT kind, hash, ext, coalesce(mime, '') AS mime, compression, size, true AS same FROM (SELECT kind, sha1(bytes) AS hash, ext, mime, compression, CAST(octet_length(bytes) AS BIGINT) AS size,
row_number() OVER (PARTITION BY kind, sha1(bytes) ORDER BY ord, ext NULLS FIRST, mime NULLS FIRST, compression NULLS FIRST) AS n FROM media) WHERE n = 1""")
def pack_media(spark: SparkSession, d: str) -> DataFrame:
    """The assets of all packs written into one and read back; of equal contents the first counts."""
    path = written_pack(spark, d, documents_of(spark, d).where("false"), True)
    m = spark.read.format("lexpack").option("table", "media").load(path)
    return m.select("kind", "hash", "ext", "mime", "compression", F.octet_length("bytes").cast("bigint").alias("size"), (F.sha1("bytes") == F.col("hash")).alias("same"))


@query()
def crossword_puzzles(spark: SparkSession, d: str) -> DataFrame:
    """The best of eight crosswords over the sampled words, each the best of 30 starts."""
    words = quality.sample_words(heads(spark, d), table(spark, d, "senses")).select(F.col("headword").alias("word"), F.col("entry_id").cast("string").alias("clue"))
    return crossword.best(crossword.puzzles(words, 8))


@query()
def crossword_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How crosswords fare with pools of 2 to 300 words, drawn from all plain words with a sense by each of 50 seeds."""
    words = quality.plain_words(heads(spark, d), table(spark, d, "senses")).select(F.col("headword").alias("word"))
    return crossword.sweep(words)
