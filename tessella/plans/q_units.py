"""Retrieval unit queries U01-U08."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import segment as sg
from tessella.operators import units as un
from tessella.plans import derived as dv
from tessella.plans.q_structure import with_paths
from tessella.plans.registry import fragment, query


@query("u01_raw_text_units", """
  WITH b AS (
    SELECT s.segment_id AS segment_key, doc_id, raw_text, doc_title, token_count, is_heading, x1, x2, x3,
      list_filter([x1, CASE WHEN x2 = x1 THEN NULL ELSE x2 END, CASE WHEN x3 = x1 OR x3 = x2 THEN NULL ELSE x3 END], lambda x: x IS NOT NULL) AS p
    FROM segments s JOIN (SELECT segment_id, x1, x2, x3 FROM section_paths) USING (segment_id)),
  c AS (SELECT *, array_to_string(CASE WHEN list_contains(p, doc_title) THEN p ELSE list_prepend(doc_title, p) END, ' > ') AS crumb,
      list_filter([x1, x2, x3], lambda x: x IS NOT NULL AND NOT contains(raw_text, x)) AS extra FROM b)
  SELECT 'ru:' || segment_key || ':raw_text' AS unit_key, segment_key, raw_text AS text, concat_ws(chr(10),
    CASE WHEN NOT contains(raw_text, crumb) THEN crumb WHEN len(extra) > 0 THEN array_to_string(extra, ' > ') END,
    CASE WHEN token_count > 50 THEN 'part of ' || doc_id END, raw_text) AS search_text
  FROM c WHERE NOT is_heading
""", ("segments", "section_paths"))
def u01(spark, d):
    s = with_paths(spark, d).select(
        F.col("segment_id").alias("segment_key"), F.col("text").alias("raw_text"), F.col("doc_title").alias("section_title"),
        F.col("is_heading").alias("is_navigation"), F.transform("section_path", lambda p: p["title"]).alias("path_titles"),
        sg.breadcrumb(F.col("doc_title"), F.col("section_path")).alias("breadcrumb"),
        F.when(F.col("token_count") > 50, F.concat(F.lit("part of "), "doc_id")).alias("context"))
    return un.raw_text_units(s).select("unit_key", "segment_key", "text", "search_text")


# Capitalised words stand for entities: long ones are strong, short ones are not.
fragment("word_refs", r"""
  SELECT segment_id AS segment_key, doc_id, segment_index, pos, CASE WHEN length(name) >= 9 THEN 'term' ELSE 'word' END AS type, name FROM (
    SELECT segment_id, doc_id, segment_index, unnest(regexp_extract_all(raw_text, '[A-Z][a-z]{5,}')) AS name,
      generate_subscripts(regexp_extract_all(raw_text, '[A-Z][a-z]{5,}'), 1) - 1 AS pos FROM segments)
""", ("segments",))


def word_refs(spark, d):
    return dv.segments(spark, d).select(
        F.col("segment_id").alias("segment_key"), "doc_id", "segment_index",
        F.posexplode(F.regexp_extract_all("raw_text", F.lit(r"[A-Z][a-z]{5,}"), F.lit(0))).alias("pos", "name"),
    ).withColumn("type", F.when(F.length("name") >= 9, "term").otherwise("word"))


@query("u02_entity_cards", r"""
  WITH f AS (SELECT doc_id, type, name, arg_min(segment_key, {'i': segment_index, 'p': pos}) AS segment_key,
      arg_min(pos, {'i': segment_index, 'p': pos}) AS pos FROM word_refs WHERE type = 'term' GROUP BY 1, 2, 3),
  t AS (SELECT k.*, raw_text, instr(raw_text, name) - 1 AS p0 FROM f k JOIN segments ON segment_key = segment_id),
  w AS (SELECT *, greatest(0, p0 - 40) AS a, least(length(raw_text), p0 + length(name) + 40) AS b FROM t)
  SELECT 'ru:entity:' || type || ':' || name AS unit_key, doc_id, segment_key, name || '（' || type || '） ' ||
    CASE WHEN a > 0 THEN '...' ELSE '' END || regexp_replace(substr(raw_text, a + 1, b - a), '^\s+|\s+$', '', 'g') || CASE WHEN b < length(raw_text) THEN '...' ELSE '' END AS text
  FROM w
""", ("word_refs", "segments"))
def u02(spark, d):
    s = dv.segments(spark, d).select(F.col("segment_id").alias("segment_key"), "raw_text", F.col("doc_title").alias("section_title"))
    return un.entity_cards(s, word_refs(spark, d), ["term"], 1000).select("unit_key", "doc_id", "segment_key", "text")


@query("u03_table_row_units", """
  WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) - 1 AS i,
      'P' || l_partkey AS part, 'S' || l_suppkey AS supplier, CASE WHEN l_discount > 0.05 THEN 'high' ELSE '' END AS discount FROM lineitem)
  SELECT 'ru:' || l_orderkey || ':table_row_' || i AS unit_key, '行' || (i + 1) || ': ' || part || '、' || supplier || CASE WHEN discount <> '' THEN '、' || discount ELSE '' END AS title,
    'part为' || part || '，supplier为' || supplier || CASE WHEN discount <> '' THEN '，discount为' || discount ELSE '' END || '。' AS text,
    part || ' ' || supplier || CASE WHEN discount <> '' THEN ' ' || discount ELSE '' END || ' part supplier discount' AS search_text
  FROM r
""")
def u03(spark, d):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    o = dv.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    rows = F.transform("r", lambda x: F.create_map(
        F.lit("part"), F.concat(F.lit("P"), x["l_partkey"]), F.lit("supplier"), F.concat(F.lit("S"), x["l_suppkey"]),
        F.lit("discount"), F.when(x["l_discount"] > 0.05, "high").otherwise("")))
    t = o.select(F.col("l_orderkey").cast("string").alias("segment_key"),
                 F.array(F.lit("part"), F.lit("supplier"), F.lit("discount")).alias("columns"), rows.alias("rows"))
    return un.table_row_units(t).select("unit_key", "title", "text", "search_text")


# Sentences of a segment stand for generated questions; every other one carries a number prefix.
def _questions(spark, d):
    q = F.transform(F.split("raw_text", r"\. "), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit(" Q"), i + 1, F.lit(": "), x)).otherwise(x))
    return dv.segments(spark, d).select(F.col("segment_id").alias("segment_key"), "raw_text", F.col("doc_title").alias("section_title"), q.alias("questions"))


fragment("asked_questions", r"""
  WITH q AS (SELECT segment_id AS segment_key, doc_title, raw_text, unnest(string_split(raw_text, '. ')) AS x, generate_subscripts(string_split(raw_text, '. '), 1) - 1 AS i FROM segments),
  t AS (SELECT *, regexp_replace(CASE WHEN i % 2 = 0 THEN ' Q' || (i + 1) || ': ' || x ELSE x END, '^\s+|\s+$', '', 'g') AS y FROM q),
  p AS (SELECT *, regexp_replace(y, '^Q\d+\s*[:：]\s*', '') AS z FROM t WHERE length(y) >= 5)
  SELECT segment_key, doc_title, raw_text, z AS question, row_number() OVER (PARTITION BY segment_key ORDER BY i) - 1 AS question_index FROM p WHERE length(z) >= 5
""", ("segments",))


@query("u04_question_units", """
  SELECT 'ru:' || segment_key || ':gen_q_' || question_index AS unit_key, segment_key, substr(question, 1, 120) AS title,
    question || chr(10) || '---' || chr(10) || '来源: ' || doc_title || chr(10) || substr(raw_text, 1, 200) AS text
  FROM asked_questions WHERE question_index < 2
""", ("asked_questions",))
def u04(spark, d):
    return un.question_units(_questions(spark, d), 2).select("unit_key", "segment_key", "title", "text")


@query("u05_question_worthy", r"""
  SELECT segment_id, NOT is_heading AND token_count >= 20 AND length(regexp_replace(raw_text, '^\s+|\s+$', '', 'g')) >= 15
    AND coalesce(quality = 1, true) AND coalesce(toxic = 0, true) AS worthy
  FROM segments LEFT JOIN labels USING (doc_id)
""", ("segments",))
def u05(spark, d):
    s = dv.segments(spark, d).join(dv.table(spark, d, "labels"), "doc_id", "left").select(
        "segment_id", "raw_text", "token_count", F.when(F.col("is_heading"), "heading").otherwise("paragraph").alias("block_type"),
        (F.col("quality") == 1).alias("is_substantive"), F.when(F.col("toxic") == 1, "note").otherwise("unknown").alias("semantic_role"))
    return s.select("segment_id", un.question_worthy().alias("worthy"))


@query("u06_prune_questions", "SELECT segment_key, question_index, question FROM asked_questions", ("asked_questions",))
def u06(spark, d):
    return _questions(spark, d).select("segment_key", F.posexplode(un.prune_questions(F.col("questions"))).alias("question_index", "question"))


@query("u07_facets", """
  SELECT segment_id, block_type, CASE WHEN x1 IS NULL AND x2 IS NULL AND x3 IS NULL THEN 0 ELSE (x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT END AS section_depth,
    doc_id AS document_key, block_index AS segment_index
  FROM section_paths JOIN (SELECT segment_id, block_type FROM blocks) USING (segment_id)
""", ("section_paths", "blocks"))
def u07(spark, d):
    s = with_paths(spark, d).withColumn("semantic_role", F.lit("")).withColumn("segment_index", F.col("block_index"))
    return un.with_facets(s).select(
        "segment_id", "facets.block_type", F.coalesce("facets.section_depth", F.lit(0)).alias("section_depth"),
        "source_refs.document_key", "source_refs.segment_index")


@query("u08_attach_embeddings", """
  SELECT unit_id AS unit_key, text, round(list_sum(embedding::DOUBLE[]), 5) AS vector_sum
  FROM units JOIN embeddings ON doc_id = vec_id WHERE label <> 9
""", ("units",))
def u08(spark, d):
    # Every unit of a document has the vector of the document's number; those of one label are cut short.
    u = dv.units(spark, d).select(F.col("unit_id").alias("unit_key"), "doc_id", "text")
    v = dv.table(spark, d, "embeddings").join(u.select(F.col("doc_id").alias("vec_id"), "unit_key"), "vec_id").select(
        "unit_key", F.when(F.col("label") == 9, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return un.attach_embeddings(u.drop("doc_id"), v, 64).select("unit_key", "text", F.round(total, 5).alias("vector_sum"))
