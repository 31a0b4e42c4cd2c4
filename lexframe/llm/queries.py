"""Queries of the training-data operators (p1, p4 to p8) and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexframe.llm import cooccur, frequency, lookalike, mixing, packing, pii, tokens
from lexframe.session import stored, table


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    tags = frequency.occurrences(table(spark, d, "entry_tags"), "entry_tags.tag", "tag", "entry_id", ("ord",))
    pos = frequency.occurrences(
        table(spark, d, "senses").select("pos", "entry_id", "ety_ord", "sense_ord"), "senses.pos", "pos", "entry_id", ("ety_ord", "sense_ord")
    )
    return tags.unionByName(pos).unionByName(frequency.occurrences(table(spark, d, "forms"), "forms.kind", "kind", "entry_id", ("form_id",)))


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "entries").agg(F.countDistinct("entry_id")).scalar()
    return frequency.marked(frequency.term_frequencies(_occurrences(spark, d)), n).withColumnRenamed("term", "item")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_frequencies(spark, d).where(F.col("mark").isNotNull()).select("field", "item", "mark")


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "entry_tags").select(F.lit("tags").alias("field"), F.col("entry_id").alias("record"), F.col("tag").alias("item"))
    return tags.unionByName(table(spark, d, "morphology").select(F.lit("morphology").alias("field"), F.col("entry_id").alias("record"), F.col("term").alias("item")))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.cooccurrences(_baskets(spark, d)).withColumn("lift", F.round(F.col("n_ab") * F.col("m") / (F.col("n_a") * F.col("n_b")), 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.cooccurrences(_baskets(spark, d)).select("field", "item_a", "item_b")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "entries").select(F.lit("headword").alias("field"), F.col("pack_id").alias("scope"), F.col("entry_id").alias("id"), F.col("headword").alias("text"))
    terms = table(spark, d, "forms").select(F.lit("term").alias("field"), F.col("entry_id").cast("string").alias("scope"), F.col("form_id").alias("id"), F.col("term").alias("text"))
    return heads.unionByName(terms)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_texts(spark, d))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return texts.join(lookalike.changed_texts(texts), "text").select("field", "scope", "canonical", "id", "text").distinct()


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Whatever is wrong with the canonical texts (nothing may be): rule, n."""
    looks = lookalike.Looks(lookalike.confusables(spark))
    out = stored(lookalike.canonical_texts(_texts(spark, d)).where("text IS NOT NULL").select("text", "canonical").distinct())
    seen = out.withColumn("a", lookalike.applied("text", looks.look)).withColumn("b", lookalike.applied("canonical", looks.look))
    count = lambda df, rule: df.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(rule).alias("rule"), "n")
    again = lookalike.changed_texts(out.select(F.lit("f").alias("field"), F.lit("s").alias("scope"), F.lit(0).alias("id"), F.col("canonical").alias("text")))
    return (
        count(seen.where("a <> b"), "canonical looks different")
        .unionByName(count(seen.groupBy("a").agg(F.countDistinct("canonical").alias("k")).where("k > 1"), "one look, two forms"))
        .unionByName(count(again, "canonical isn't canonical"))
    )


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their tokens; ``doc_id`` names them, so the result doesn't depend on how the files are split."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", "text")
    return stored(tokens.with_token_counts(docs, ["row_id", "source"]))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    out = packing.packed(sizes, table(spark, d, "capacities"), sizes.count())
    return out.select("capacity_id", "container", "fill", F.col("row_id").alias("doc_id"), "piece", "tokens")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    return packing.fill_report(packing.packed(sizes, table(spark, d, "capacities"), sizes.count()))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Whatever breaks a rule of containers (there must be none), and what was packed: capacity_id, rule, n.

    Every text with tokens is whole in one container, or cut where it exceeds the capacity; no container
    holds more than its capacity; ``fill`` is what a container holds.
    """
    out = stored(p6_packed(spark, d)).join(table(spark, d, "capacities").distinct(), "capacity_id")
    inside = out.groupBy("capacity_id", "max_tokens", "container").agg(F.sum("tokens").alias("held"), F.min("fill").alias("least"), F.max("fill").alias("most"))
    text = out.groupBy("capacity_id", "max_tokens", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    cut = F.ceil(F.col("tokens") / F.col("max_tokens"))
    rule = lambda df, name, cond: df.groupBy("capacity_id").agg(F.count_if(cond).alias("n")).select("capacity_id", F.lit(name).alias("rule"), "n")
    return (
        rule(inside, "over the capacity", F.col("held") > F.col("max_tokens"))
        .unionByName(rule(inside, "fill not as held", (F.col("held") != F.col("least")) | (F.col("held") != F.col("most"))))
        .unionByName(rule(text, "cut without need", F.col("pieces") != cut))
        .unionByName(rule(text, "texts packed", F.lit(True)))
    )


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = _sizes(spark, d)
    planned = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return planned, mixing.mixed(sizes, planned, sizes.count())


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    planned, chosen = _mix(spark, d)
    reached = mixing.shares(chosen, planned).select("source", "target_share", "reached")
    return chosen.join(mixing.small(reached), "source").select(F.col("row_id").alias("doc_id"), "source", "tokens", "repeats", "target_share", "reached")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    planned, chosen = _mix(spark, d)
    return mixing.shares(chosen, planned)


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per target source what breaks a rule of the mix: source, too_often, foreign, twice, missed.

    Documents repeated more often than allowed; chosen ones that are of another source; chosen twice; and whether a source
    that could give its share misses it by more than its longest document.
    """
    sizes = _sizes(spark, d)
    planned = mixing.plan(sizes, table(spark, d, "mix_targets")).join(sizes.groupBy("source").agg(F.max("tokens").alias("longest")), "source", "left")
    chosen = mixing.mixed(sizes, planned, sizes.count())
    chosen, docs = stored(chosen), table(spark, d, "documents").select("doc_id", F.col("source").alias("own"))
    joined = chosen.join(docs, chosen["row_id"] == docs["doc_id"]).join(planned.select("source", "max_repeats", "copies", "total", "share", "longest"), "source", "right")
    by = joined.groupBy("source").agg(
        F.count_if(F.col("repeats") > F.col("max_repeats")).alias("too_often"),
        F.count_if(F.col("own") != F.col("source")).alias("foreign"),
        (F.count("row_id") - F.countDistinct("row_id")).alias("twice"),
        F.coalesce(F.sum(F.col("tokens") * F.col("repeats")), F.lit(0)).alias("used"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest"),
        F.max("copies").alias("copies"), F.max("max_repeats").alias("most"), F.max(F.col("total") * F.col("share")).alias("wanted"),
    )
    return by.select("source", "too_often", "foreign", "twice", ((F.col("copies") < F.col("most")) & (F.abs(F.col("used") - F.col("wanted")) > F.col("longest") + 1)).alias("missed"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return pii.found(docs, pii.learn(docs)).select("doc_id", "kind", "start_pos", "end_pos")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Whatever is wrong with the spans and the redacted texts (nothing may be): rule, n."""
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    names = pii.learn(docs)
    spans = stored(pii.found(docs, names))
    cut = spans.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("gone"), F.sum(F.length("kind") + 2).alias("put"))
    by = spans.join(docs, "doc_id")
    nxt = F.lead("start_pos").over(Window.partitionBy("doc_id").orderBy("start_pos"))
    both = docs.join(pii.redacted(docs, names).withColumnRenamed("text", "after"), "doc_id").join(cut, "doc_id", "left").na.fill(0, ["gone", "put"])
    count = lambda df, rule: df.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return (
        count(by.where("start_pos < 0 OR end_pos > length(text) OR start_pos >= end_pos"), "outside the text")
        .unionByName(count(spans.withColumn("next", nxt).where("next < end_pos"), "overlap"))
        .unionByName(count(both.where("text IS NOT NULL AND length(after) <> length(text) - gone + put"), "more or less replaced"))
        .unionByName(count(by.where("kind = 'email' AND NOT lower(substring(text, start_pos + 1, end_pos - start_pos)) RLIKE '@|＠|at'"), "email without a sign"))
    )


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return pii.redacted(docs, pii.learn(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_frequencies": p1_frequencies, "p4_found": p4_found, "p4_pairs": p4_pairs,
    "p5_found": p5_found, "p5_canonical": p5_canonical, "p5_check": p5_check, "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_check": p6_check,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_check": p7_check,
    "p8_found": p8_found, "p8_redacted": p8_redacted, "p8_check": p8_check,
}

_P1 = """
WITH rows_once AS (
  SELECT DISTINCT 'entry_tags.tag' AS field, tag AS item, entry_id, ord AS a, 0 AS b FROM entry_tags WHERE tag <> ''
  UNION ALL SELECT DISTINCT 'senses.pos', pos, entry_id, ety_ord, sense_ord FROM senses WHERE pos <> ''
  UNION ALL SELECT DISTINCT 'forms.kind', kind, entry_id, form_id, 0 FROM forms WHERE kind <> ''),
freq AS (SELECT field, item, count(*) AS occurrences, count(DISTINCT entry_id) AS records FROM rows_once GROUP BY ALL),
marks AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 > (SELECT count(DISTINCT entry_id) FROM entries) THEN 'common' END AS mark FROM freq)
"""
_P4 = """
WITH base AS (
  SELECT DISTINCT 'tags' AS field, entry_id, tag AS item FROM entry_tags WHERE tag <> ''
  UNION ALL SELECT DISTINCT 'morphology', entry_id, term FROM morphology WHERE term <> ''),
m AS (SELECT field, count(DISTINCT entry_id) AS m FROM base GROUP BY field),
n AS (SELECT field, item, count(*) AS n FROM base GROUP BY ALL),
ab AS (SELECT x.field, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM base x JOIN base y
       ON x.field = y.field AND x.entry_id = y.entry_id AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5),
found AS (SELECT ab.field, item_a, item_b, na.n AS n_a, nb.n AS n_b, m.m, n_ab FROM ab JOIN m ON ab.field = m.field
          JOIN n na ON na.field = ab.field AND na.item = item_a JOIN n nb ON nb.field = ab.field AND nb.item = item_b
          WHERE n_ab * m.m >= 4 * na.n * nb.n)
"""
SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT field, item, mark FROM marks WHERE mark IS NOT NULL",
    "p1_frequencies": _P1 + "SELECT field, item, occurrences, records, mark FROM marks",
    "p4_found": _P4 + "SELECT field, item_a, item_b FROM found",
    # Tokens can't be counted in SQL, so p6 and p7 are held against the rules that any right result keeps.
    "p6_check": """SELECT c.capacity_id, r.rule, CASE WHEN r.rule = 'texts packed' THEN (SELECT count(*) FROM documents WHERE text <> '') ELSE 0 END AS n
FROM capacities c, (VALUES ('over the capacity'), ('fill not as held'), ('cut without need'), ('texts packed')) r(rule)""",
    "p5_check": "SELECT * FROM (VALUES ('canonical looks different', 0), ('one look, two forms', 0), ('canonical isn''t canonical', 0)) t(rule, n)",
    "p8_check": "SELECT * FROM (VALUES ('outside the text', 0), ('overlap', 0), ('more or less replaced', 0), ('email without a sign', 0)) t(rule, n)",
    "p7_check": "SELECT DISTINCT source, CAST(0 AS BIGINT) AS too_often, CAST(0 AS BIGINT) AS \"foreign\", CAST(0 AS BIGINT) AS twice, false AS missed FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0",
    "p4_pairs": _P4 + "SELECT *, round(n_ab * m / (n_a * n_b), 6) AS lift FROM found",
}
