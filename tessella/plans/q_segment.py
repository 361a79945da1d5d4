"""Segmentation queries G01-G12."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import folds as fd
from tessella.operators import segment as sg
from tessella.plans import derived as dv
from tessella.plans.q_structure import blocks, with_paths
from tessella.plans.registry import fragment, query

CLEAN_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\*\*(.+?)\*\*', '\1', 'g'), "
    r"'(?i)<br\s*/?>', chr(10), 'g'), '!\[.*?\]\([^)]*\)', '', 'g'), '!\[.*?\]\[.*?\]', '', 'g'), '\[([^\]]*)\]\((?:[^()]+|\([^()]*\))*\)', '\1', 'g'), "
    r"'\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
)


def sectioned(spark, d):
    w = W.partitionBy("doc_id").orderBy("block_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    return with_paths(spark, d).withColumn("section_id", F.sum(F.col("is_heading").cast("int")).over(w))


fragment("sectioned", "SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY block_index) AS section_id FROM blocks", ("blocks",))
fragment("grouped", """
  WITH c AS (SELECT *, block_type <> 'paragraph' OR coalesce(lag(block_type) OVER w, 'x') <> 'paragraph' AS edge
             FROM sectioned WHERE NOT is_heading WINDOW w AS (PARTITION BY doc_id, section_id ORDER BY block_index))
  SELECT *, sum(edge::INT) OVER (PARTITION BY doc_id, section_id ORDER BY block_index) - 1 AS group_index FROM c
""", ("sectioned",))


@query("g01_group_blocks", f"""
  SELECT doc_id, section_id, group_index, min(block_index) AS first_block, arg_min(block_type, block_index) AS block_type,
    {CLEAN_SQL.format("string_agg(text, chr(10) || chr(10) ORDER BY block_index)")} AS raw_text
  FROM grouped GROUP BY 1, 2, 3
""", ("grouped",))
def g01(spark, d):
    return sg.group_blocks(sectioned(spark, d)).select("doc_id", "section_id", "group_index", "first_block", "block_type", "raw_text")


@query("g02_clean_text", f"SELECT doc_id, {CLEAN_SQL.format('text')} AS text FROM documents")
def g02(spark, d):
    return dv.documents(spark, d).select("doc_id", tx.clean_markup(F.col("text")).alias("text"))


def document_segments(spark, d):
    """Each document's ordered segments as one array, as the block grouper leaves them."""
    item = F.struct("block_index", F.col("block_type").alias("type"), F.transform("section_path", lambda p: p["title"]).alias("path"), "text")
    s = with_paths(spark, d).filter("block_type <> 'heading'")
    return s.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("segments"))


@query("g03_merge_small", """
  SELECT * FROM (
    WITH RECURSIVE s AS MATERIALIZED (
      SELECT b.doc_id, b.block_type, coalesce(path, '') AS path, b.text, b.token_count AS n, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.block_index) AS i
      FROM blocks b JOIN section_paths p ON b.doc_id = p.doc_id AND b.block_index = p.block_index WHERE NOT is_heading),
    r AS (SELECT doc_id, i, path, block_type, n, 0 AS segment_index FROM s WHERE i = 1
      UNION ALL SELECT doc_id, i, path, CASE WHEN joins AND old_rank >= new_rank THEN old_type ELSE block_type END, CASE WHEN joins THEN old_n + n ELSE n END, segment_index + CASE WHEN joins THEN 0 ELSE 1 END
      FROM (SELECT s.*, r.block_type AS old_type, r.n AS old_n, segment_index,
              CASE r.block_type WHEN 'table' THEN 4 WHEN 'list' THEN 3 ELSE 1 END AS old_rank, CASE s.block_type WHEN 'table' THEN 4 WHEN 'list' THEN 3 ELSE 1 END AS new_rank,
              r.path = s.path AND r.n + s.n <= 512 AND (
                (r.block_type = 'paragraph' AND r.n < 100 AND (s.block_type = 'list' OR (s.block_type = 'table' AND s.n <= 300)))
                OR (s.n < 100 AND s.block_type <> 'table' AND r.block_type <> 'table')) AS joins
            FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1))
    SELECT r.doc_id, r.segment_index, arg_max(r.block_type, r.i) AS block_type, min(r.path) AS path, string_agg(text, chr(10) || chr(10) ORDER BY r.i) AS raw_text, max(r.n) AS token_count
    FROM r JOIN s ON r.doc_id = s.doc_id AND r.i = s.i GROUP BY 1, 2)
""", ("blocks", "section_paths"))
def g03(spark, d):
    merged = fd.fold_segments(document_segments(spark, d), ("merge_small",))
    return merged.withColumn("path", F.array_join("path", " > "))


@query("g04_absorb_orphans")
def g04(spark, d):
    return fd.fold_segments(document_segments(spark, d), ("merge_small", "absorb_orphans"))


@query("g05_merge_lead_ins")
def g05(spark, d):
    return fd.fold_segments(document_segments(spark, d), ("merge_small", "absorb_orphans", "merge_lead_ins"))


@query("g06_split_large")
def g06(spark, d):
    return fd.fold_segments(document_segments(spark, d))


@query("g07_breadcrumbs", """
  SELECT segment_id, array_to_string(CASE WHEN list_contains(p, doc_title) THEN p ELSE list_prepend(doc_title, p) END, ' > ') AS breadcrumb
  FROM (SELECT segment_id, list_filter([x1, CASE WHEN x2 = x1 THEN NULL ELSE x2 END, CASE WHEN x3 = x1 OR x3 = x2 THEN NULL ELSE x3 END], lambda x: x IS NOT NULL) AS p FROM section_paths)
  JOIN blocks USING (segment_id)
""", ("section_paths", "blocks"))
def g07(spark, d):
    return with_paths(spark, d).select("segment_id", sg.breadcrumb(F.col("doc_title"), F.col("section_path")).alias("breadcrumb"))


@query("g08_token_count", r"""
  SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[\x{4e00}-\x{9fff}]', ' ', 'g'), '[\p{L}\p{N}]+'))
    + round_even(1.5 * len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')), 0)::INT AS token_count FROM documents
""")
def g08(spark, d):
    return dv.documents(spark, d).select("doc_id", tx.token_count(F.col("text")).alias("token_count"))


@query("g09_segment_hashes", r"""
  SELECT segment_id, sha256(raw_text) AS content_hash, sha256(regexp_replace(lower(raw_text), '^\s+|\s+$', '', 'g')) AS normalized_hash FROM segments
""", ("segments",))
def g09(spark, d):
    t = F.col("raw_text")
    return dv.segments(spark, d).select("segment_id", tx.content_hash(t).alias("content_hash"), tx.normalized_hash(t).alias("normalized_hash"))


@query("g10_source_offsets", """
  SELECT doc_id, section_id, group_index, min(line_start) AS line_start, max(line_end) AS line_end, min(block_index) AS first_block FROM grouped GROUP BY 1, 2, 3
""", ("grouped",))
def g10(spark, d):
    return sg.group_blocks(sectioned(spark, d)).select("doc_id", "section_id", "group_index", "line_start", "line_end", "first_block")


@query("g11_structure_summary", """
  SELECT doc_id, section_id, count(*) FILTER (WHERE block_type = 'paragraph') AS paragraph_count, count(*) FILTER (WHERE block_type = 'list') AS item_count,
    max(CASE WHEN block_type = 'table' THEN len(string_split(text, ' | ')) ELSE 0 END) AS col_count,
    CASE WHEN max(block_type = 'table') THEN 'table' WHEN max(block_type = 'list') THEN 'list' ELSE 'paragraph' END AS block_type
  FROM grouped GROUP BY 1, 2
""", ("grouped",))
def g11(spark, d):
    b = sectioned(spark, d).filter("NOT is_heading").select("doc_id", "section_id", "block_index", "block_type", "text")
    by = ["doc_id", "section_id"]
    return sg.structure_summary(b, by).drop("row_count").join(sg.dominant_type(b, by), by)


@query("g12_reindex_segments", """
  SELECT doc_id, segment_index, doc_id || '#' || segment_index AS segment_key, sha256(doc_id || '#' || segment_index) AS segment_id, text
  FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1 AS segment_index FROM blocks WHERE NOT is_heading)
""", ("blocks",))
def g12(spark, d):
    return sg.reindex(blocks(spark, d).filter("NOT is_heading").select("doc_id", "block_index", "text"), ["block_index"]).drop("block_index")
