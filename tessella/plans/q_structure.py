"""Document structuring queries D01-D12."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import structure as st
from tessella.plans import derived as dv
from tessella.plans.registry import fragment, query


def _pages(spark, d):
    stem = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    return dv.spread(dv.table(spark, d, "pages")).select("page_id", stem.alias("title"), "html")


@query("d01_html_to_markdown")
def d01(spark, d):
    return st.html_to_markdown(_pages(spark, d))


# Orders as HTML tables: the order number spans all its lines.
def order_tables(spark, d):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    o = dv.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    lead = F.concat(F.lit("<td rowspan='"), F.size("r"), F.lit("'>"), F.col("l_orderkey"), F.lit("</td>"))
    body = F.array_join(F.transform("r", lambda x, i: F.concat(
        F.lit("<tr>"), F.when(i == 0, lead).otherwise(F.lit("")), F.lit("<td>P"), x["l_partkey"], F.lit("</td><td>"),
        x["l_quantity"].cast("int"), F.lit("</td></tr>"))), "")
    head = F.lit("<table><thead><tr><th>order</th><th>part</th><th>quantity</th></tr></thead><tbody>")
    return o.select(F.col("l_orderkey").alias("table_id"), F.concat(head, body, F.lit("</tbody></table>")).alias("html"))


@query("d02_html_table_grid", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem)
  SELECT l_orderkey AS table_id, 0 AS table_index, i AS row_index, 0 AS col_index, 'order' AS "column", l_orderkey::VARCHAR AS value, NULL::VARCHAR AS error FROM r
  UNION ALL SELECT l_orderkey, 0, i, 1, 'part', 'P' || l_partkey, NULL FROM r
  UNION ALL SELECT l_orderkey, 0, i, 2, 'quantity', l_quantity::INT::VARCHAR, NULL FROM r
""")
def d02(spark, d):
    return st.html_table_cells(order_tables(spark, d), "table_id")


def markdown_documents(spark, d):
    """Documents written as Markdown: short lines become headings, every line its own paragraph."""
    mark = lambda x, i: F.when(
        tx.token_count(x) <= dv.HEADING_TOKENS, F.concat(F.repeat(F.lit("#"), i % 3 + 1), F.lit(" "), x)).otherwise(x)
    return dv.documents(spark, d).select("doc_id", F.array_join(F.transform(tx.lines(F.col("text")), mark), "\n\n").alias("text"))


@query("d03_markdown_blocks")
def d03(spark, d):
    return st.parse_markdown(markdown_documents(spark, d))


def blocks(spark, d):
    """Segments as blocks of the structuring operators; long lines stand for tables, quotes and lists."""
    n = F.col("token_count")
    kind = F.when(F.col("is_heading"), "heading").when(n <= 8, "list").when(n >= 120, "table").otherwise("paragraph")
    return dv.segments(spark, d).select(
        "doc_id", "doc_title", F.col("segment_index").alias("block_index"), "segment_id", kind.alias("block_type"),
        F.col("raw_text").alias("text"), F.col("raw_text").alias("title"), "level", "is_heading", "token_count",
        F.col("line_no").alias("line_start"), (F.col("line_no") + 1).alias("line_end"))


fragment("blocks", """
  SELECT doc_id, doc_title, segment_index AS block_index, segment_id, raw_text AS text, level, is_heading, token_count, line_no AS line_start, line_no + 1 AS line_end,
    CASE WHEN is_heading THEN 'heading' WHEN token_count <= 8 THEN 'list' WHEN token_count >= 120 THEN 'table' ELSE 'paragraph' END AS block_type
  FROM segments
""", ("segments",))
fragment("section_paths", """
  WITH h AS (SELECT *,
      max(CASE WHEN level = 1 THEN block_index END) OVER w AS p1, max(CASE WHEN level = 2 THEN block_index END) OVER w AS p2,
      max(CASE WHEN level = 3 THEN block_index END) OVER w AS p3 FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)),
  t AS (SELECT doc_id, block_index AS at, text FROM blocks WHERE is_heading)
  SELECT h.doc_id, h.block_index, h.segment_id, concat_ws(' > ', t1.text, t2.text, t3.text) AS path, t1.text AS x1, t2.text AS x2, t3.text AS x3
  FROM h LEFT JOIN t t1 ON h.doc_id = t1.doc_id AND p1 = t1.at
  LEFT JOIN t t2 ON h.doc_id = t2.doc_id AND p2 = t2.at AND p2 > coalesce(p1, -1)
  LEFT JOIN t t3 ON h.doc_id = t3.doc_id AND p3 = t3.at AND p3 > greatest(coalesce(p1, -1), coalesce(p2, -1))
""", ("blocks",))


def with_paths(spark, d):
    return st.section_paths(blocks(spark, d))


@query("d04_section_paths", "SELECT doc_id, block_index, path FROM section_paths", ("section_paths",))
def d04(spark, d):
    path = F.array_join(F.transform("section_path", lambda x: x["title"]), " > ")
    return with_paths(spark, d).select("doc_id", "block_index", path.alias("path"))


@query("d05_paragraphs", r"""
  WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i
             FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)) AS t FROM documents)),
  g AS (SELECT *, NOT regexp_matches(x, '\S') AS blank, sum(CASE WHEN regexp_matches(x, '\S') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l),
  p AS (SELECT doc_id, island, min(i) AS line_start, max(i) + 1 AS line_end, string_agg(x, chr(10) ORDER BY i) AS text FROM g WHERE NOT blank GROUP BY 1, 2)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS paragraph_index, line_start, line_end, text FROM p
""")
def d05(spark, d):
    docs = dv.documents(spark, d).select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n \n")).alias("text"))
    return st.paragraphs(docs)


@query("d06_token_chunks", r"""
  WITH p AS (SELECT doc_id AS id, text, regexp_extract_all(text, '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS p FROM documents),
  n AS (SELECT *, len(p) AS n FROM p),
  s AS (SELECT *, unnest(CASE WHEN n <= 300 THEN [0] ELSE range(0, (ceil((n - 300) / 270.0) + 1)::BIGINT) END) AS k FROM n)
  SELECT id, k AS chunk_index, least(300, n - k * 270) AS n_tokens,
    CASE WHEN n <= 300 THEN text ELSE regexp_replace(array_to_string(p[k * 270 + 1 : k * 270 + 300], ''), '^\s+|\s+$', '', 'g') END AS chunk
  FROM s
""")
def d06(spark, d):
    return st.token_chunks(dv.documents(spark, d).select(F.col("doc_id").alias("id"), "text"))


# Lines of a source as page lines: the page is the document, the position its share of the document.
fragment("page_lines", """
  SELECT source, doc_id, segment_id, raw_text AS text, (segment_index + 0.5::DOUBLE) / n_segments AS position FROM segments
""", ("segments",))


def page_lines(spark, d):
    return dv.segments(spark, d).select(
        "source", "doc_id", "segment_id", F.col("raw_text").alias("text"), ((F.col("segment_index") + 0.5) / F.col("n_segments")).alias("position"))


@query("d07_drop_headers_footers", r"""
  WITH s AS (SELECT *, regexp_replace(text, '\d+', 'N', 'g') AS shape FROM page_lines),
  pages AS (SELECT source, count(DISTINCT doc_id) AS pages FROM s GROUP BY 1),
  rep AS (SELECT source, shape FROM s JOIN pages USING (source) GROUP BY source, shape, pages HAVING pages >= 3 AND count(*) >= greatest(3, pages // 2))
  SELECT segment_id FROM s WHERE NOT ((source, shape) IN (SELECT source, shape FROM rep) AND (position < 0.15 OR position > 0.88))
""", ("page_lines",))
def d07(spark, d):
    return st.drop_headers_footers(page_lines(spark, d), "source", "doc_id").select("segment_id")


# Numbered and sized blocks: level-1 headings carry a clause number, level-2 headings a larger font.
fragment("sized", """
  SELECT doc_id, block_index, CASE WHEN level = 1 THEN (block_index + 1) || '.' || line_start || ' ' || text
      WHEN level = 3 THEN text || ' ..... ' || line_start WHEN token_count = 10 THEN 'Table ' || block_index || ' ' || text ELSE text END AS text,
    CASE WHEN level = 2 THEN 14.0 ELSE 10.0 END::DOUBLE AS font_size
  FROM blocks
""", ("blocks",))


def _sized(spark, d):
    lvl, t = F.col("level"), F.col("text")
    text = (
        F.when(lvl == 1, F.concat((F.col("block_index") + 1).cast("string"), F.lit("."), "line_start", F.lit(" "), t))
        .when(lvl == 3, F.concat(t, F.lit(" ..... "), "line_start"))
        .when(F.col("token_count") == 10, F.concat(F.lit("Table "), "block_index", F.lit(" "), t)).otherwise(t))
    return blocks(spark, d).select("doc_id", "block_index", text.alias("text"), F.when(lvl == 2, 14.0).otherwise(10.0).alias("font_size"))


@query("d08_classify_headings", r"""
  WITH body AS (SELECT doc_id, arg_max(font_size, {'n': n, 's': font_size}) AS body FROM (SELECT doc_id, font_size, count(*) AS n FROM sized GROUP BY 1, 2) GROUP BY 1),
  rk AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS r FROM (SELECT DISTINCT doc_id, font_size FROM sized)),
  x AS (SELECT s.*, body, r, regexp_replace(text, '^\s+|\s+$', '', 'g') AS line FROM sized s JOIN body USING (doc_id) JOIN rk USING (doc_id, font_size)),
  y AS (SELECT *, regexp_extract(line, '^(\d+(?:\.\d+){0,4})[\x{00a0}\s]+(\S.{0,200})$', 1) AS num,
      regexp_replace(regexp_extract(line, '^(\d+(?:\.\d+){0,4})[\x{00a0}\s]+(\S.{0,200})$', 2), '^\s+|\s+$', '', 'g') AS title
    FROM x WHERE NOT regexp_matches(line, '\.{4,}\s*\d+\s*$')),
  z AS (SELECT *, num <> '' AND NOT contains(title, '....') AND length(line) <= 200 AND length(text) <= 400 AND font_size + 0.1 >= body AS numeric,
      font_size > body * 1.2 AND length(line) < 200 AND length(text) <= 400 AS big FROM y)
  SELECT doc_id, block_index,
    CASE WHEN numeric OR big THEN 'heading' WHEN regexp_matches(line, '(?i)^(Tabelle|Table|Abbildung|Figure|Bild)\s+\d+(?:\.\d+)?\b') THEN 'table' ELSE 'paragraph' END AS block_type,
    coalesce(CASE WHEN numeric THEN len(string_split(num, '.')) WHEN big THEN least(r, 6) END, 0) AS level,
    CASE WHEN numeric THEN num || ' ' || title WHEN big THEN line ELSE text END AS text
  FROM z
""", ("sized",))
def d08(spark, d):
    return st.classify_headings(_sized(spark, d)).withColumn("level", F.coalesce("level", F.lit(0)))


@query("d09_drop_toc_lines", r"SELECT doc_id, block_index FROM sized WHERE NOT regexp_matches(text, '\.{4,}\s*\d+\s*$')", ("sized",))
def d09(spark, d):
    return st.drop_toc_lines(_sized(spark, d)).select("doc_id", "block_index")


@query("d10_clause_numbers", r"""
  WITH g AS (SELECT segment_id, regexp_replace(regexp_replace(regexp_replace((segment_index % 7) || CASE WHEN level = 2 THEN '' ELSE '.' || line_no END || raw_text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'),
        '^((?:\d+[A-Za-z]?)(?:\.\d+[A-Za-z]?)*)([A-Z][A-Za-z].*)$', '\1 \2') AS heading FROM segments WHERE is_heading),
  c AS (SELECT *, regexp_extract(heading, '^((?:\d+[A-Za-z]?)(?:\.\d+[A-Za-z]?)*)(?:\s+|$)', 1) AS c FROM g)
  SELECT segment_id, heading, CASE WHEN c <> '' AND (contains(c, '.') OR regexp_matches(c, '^\d+$')) THEN c ELSE '' END AS clause,
    CASE WHEN c <> '' AND (contains(c, '.') OR regexp_matches(c, '^\d+$')) THEN len(string_split(c, '.')) ELSE 0 END AS level
  FROM c
""", ("segments",))
def d10(spark, d):
    s = dv.segments(spark, d).filter("is_heading")
    glued = F.concat((F.col("segment_index") % 7).cast("string"),
                     F.when(F.col("level") == 2, F.lit("")).otherwise(F.concat(F.lit("."), "line_no")), "raw_text")
    h = s.select("segment_id", st.heading_spacing(glued).alias("heading"))
    return h.select("segment_id", "heading", F.coalesce(st.clause_number(F.col("heading")), F.lit("")).alias("clause"),
                    F.coalesce(st.clause_level(F.col("heading")), F.lit(0)).alias("level"))


@query("d11_assemble_sections", """
  WITH s AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY block_index) AS section_index FROM blocks)
  SELECT doc_id, section_index, coalesce(max(CASE WHEN is_heading THEN text END), '') AS title, count(*) FILTER (WHERE NOT is_heading) AS block_count,
    coalesce(sum(CASE WHEN NOT is_heading THEN length(text) END), 0)::BIGINT AS char_count
  FROM s GROUP BY 1, 2
""", ("blocks",))
def d11(spark, d):
    return st.assemble_sections(blocks(spark, d)).na.fill("", ["title"])


@query("d12_parse_skip_reasons", """
  WITH x AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'markdown' WHEN 'fr' THEN 'txt' WHEN 'de' THEN 'docx' ELSE 'html' END AS file_type,
      CASE WHEN toxic = 1 THEN 'bad archive' ELSE '' END AS pre, CASE WHEN quality = 0 THEN 'no text layer' ELSE '' END AS err,
      CASE WHEN n_chars < 300 THEN ' ' ELSE text END AS content FROM documents LEFT JOIN labels USING (doc_id))
  SELECT CASE WHEN pre <> '' THEN 'preprocess_failed' WHEN err <> '' THEN 'parser_failed' WHEN file_type = 'html' THEN 'unsupported_type'
    WHEN file_type <> 'docx' AND content = ' ' THEN 'empty_file' ELSE 'parse_no_tree' END AS reason, count(*) AS n FROM x GROUP BY 1
""")
def d12(spark, d):
    x = dv.table(spark, d, "documents").join(dv.table(spark, d, "labels"), "doc_id", "left")
    kind = F.when(F.col("lang") == "en", "markdown").when(F.col("lang") == "fr", "txt").when(F.col("lang") == "de", "docx").otherwise("html")
    reason = st.parse_skip_reason(F.when(F.col("toxic") == 1, "bad archive"), F.when(F.col("quality") == 0, "no text layer"), kind,
                                  F.when(F.col("n_chars") < 300, F.lit(" ")).otherwise(F.col("text")))
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
