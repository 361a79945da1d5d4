"""Source and sink queries S01-S12 (S09 lives with retrieval)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessella.operators import structure as st
from tessella.plans import derived as dv
from tessella.plans.q_structure import blocks
from tessella.plans.registry import fragment, query
from tessella.sources import files as fl
from tessella.sources import stored as sd


@query("s01_scan_files")
def s01(spark, d):
    return fl.scan_files(spark, d, with_content=False).select("file_name", "file_size", "file_type", "outcome")


# Pages laid out as one text file each, then scanned with their content.
@query("s01_scan_content", """
  SELECT page_id, 'txt' AS file_type, 'parsed' AS outcome, strlen(html || chr(10)) AS file_size, sha256(html || chr(10)) AS raw_hash, sha256(html || chr(10)) AS text_hash
  FROM pages WHERE html IS NOT NULL
""")
def s01_content(spark, d):
    root = fl.scratch(spark)
    p = dv.table(spark, d, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("page"), "html")
    fl.write_pages(p, root)
    found = fl.scan_files(spark, root).where("file_type = 'txt'")
    page = F.regexp_extract("path", r"page=(\d+)/", 1).cast("long")
    return found.select(page.alias("page_id"), "file_type", "outcome", "file_size", "raw_hash", F.sha2("text", 256).alias("text_hash"))


@query("s02_decode_text", "SELECT page_id, sha256(html) AS utf8, sha256(html) AS sniffed FROM pages")
def s02(spark, d):
    p = dv.table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return p.select("page_id", F.sha2(fl.decode_utf8("content"), 256).alias("utf8"), F.sha2(fl.sniff_decode("content"), 256).alias("sniffed"))


# A file per document: type by language; half the Markdown files open with a heading on their second line.
@query("s03_title_and_mime", r"""
  WITH f AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'markdown' WHEN 'fr' THEN 'txt' WHEN 'de' THEN 'pdf' ELSE 'other' END AS t,
      CASE WHEN n_chars > 1000 THEN 'x' || chr(10) || ' # ' || text ELSE text END AS content, 'doc.' || doc_id || '.md' AS name FROM documents)
  SELECT doc_id, CASE t WHEN 'markdown' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime,
    CASE WHEN t = 'markdown' AND regexp_matches(content, '(?m)^[ \t]*# ') THEN regexp_replace(regexp_extract(content, '(?m)^[ \t]*# (.*)$', 1), '^\s+|\s+$', '', 'g')
      ELSE 'doc.' || doc_id END AS title
  FROM f
""")
def s03(spark, d):
    t = F.when(F.col("lang") == "en", "markdown").when(F.col("lang") == "fr", "txt").when(F.col("lang") == "de", "pdf").otherwise("other")
    content = F.when(F.col("n_chars") > 1000, F.concat(F.lit("x\n # "), "text")).otherwise(F.col("text"))
    f = dv.documents(spark, d).select("doc_id", t.alias("t"), content.alias("content"), F.concat(F.lit("doc."), "doc_id", F.lit(".md")).alias("name"))
    return f.select("doc_id", fl.mime_type(F.col("t")).alias("mime"), fl.infer_title(F.col("t"), F.col("content"), F.col("name")).alias("title"))


@query("s04_section_jsonl", """
  WITH s AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY block_index) AS section_index FROM blocks)
  SELECT doc_id || '#' || section_index AS section_id, doc_id, coalesce(max(CASE WHEN is_heading THEN text END), '') AS title,
    coalesce(string_agg(CASE WHEN NOT is_heading THEN text END, chr(10) ORDER BY block_index), '') AS text,
    count(*) FILTER (WHERE NOT is_heading) AS block_count, coalesce(sum(CASE WHEN NOT is_heading THEN length(text) END), 0)::BIGINT AS char_count
  FROM s GROUP BY doc_id, section_index
""", ("blocks",))
def s04(spark, d):
    from pyspark.sql import Window as W

    b = blocks(spark, d)
    w = W.partitionBy("doc_id").orderBy("block_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = b.withColumn("section_index", F.sum(F.col("is_heading").cast("int")).over(w))
    body = n.filter("NOT is_heading").groupBy("doc_id", "section_index").agg(
        F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("parts"))
    s = st.assemble_sections(b).join(body, ["doc_id", "section_index"], "left").select(
        F.concat_ws("#", "doc_id", "section_index").alias("section_id"), "doc_id", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), F.lit("")).alias("text"), "block_count", "char_count")
    path = fl.scratch(spark)
    fl.write_sections(s, path)
    return fl.read_sections(spark, path)


# Every table: its rows, and a sum of hashes over a column or two of whole numbers or text.
TABLES = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name", "customer": "c_custkey, c_name", "supplier": "s_suppkey, s_name", "part": "p_partkey, p_name",
    "orders": "o_orderkey, o_orderstatus", "lineitem": "l_orderkey, l_linenumber, l_partkey", "events": "event_id, event_type", "documents": "doc_id, text",
    "embeddings": "vec_id, label", "pages": "page_id, html", "benchmark": "item_id, text", "labels": "doc_id, quality, toxic", "conversations": "conv_id, turn, text"}


@query("s05_dump_and_reload", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n, coalesce(sum(('0x' || substr(md5(concat_ws('|', {c})), 1, 8))::BIGINT), 0)::BIGINT AS digest FROM {t}" for t, c in TABLES.items())
       + " UNION ALL SELECT 'missing_optional', 0, 0")
def s05(spark, d):
    tables = {t: dv.table(spark, d, t) for t in TABLES}
    root = fl.scratch(spark)
    fl.dump_tables(tables, root)
    schemas = {t: df.schema for t, df in tables.items()}
    schemas["missing_optional"] = tables["labels"].schema
    parts = []
    for name, df in fl.reload_tables(spark, root, schemas, ("missing_optional",)).items():
        of = TABLES.get(name, TABLES["labels"]).split(", ")
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *of)), 1, 8), 16, 10).cast("bigint")
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("digest")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _selections(spark, d):
    old = dv.parent_selections(spark, d).select("domain", "document_id", "snapshot_id", F.col("source_batch_id").alias("batch"))
    new = dv.run_decisions(spark, d).select(
        "domain", "document_id", "snapshot_id", F.when(F.col("source_batch_id") != "5-LOW", F.col("source_batch_id")).alias("batch"))
    return old, new


fragment("old_sel", "SELECT domain, document_id, snapshot_id, source_batch_id AS batch FROM parent_selections", ("parent_selections",))
fragment("new_sel", "SELECT domain, document_id, snapshot_id, CASE WHEN source_batch_id <> '5-LOW' THEN source_batch_id END AS batch FROM run_decisions", ("run_decisions",))


@query("s06_upsert", """
  WITH f AS (SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.document_id, o.document_id) AS document_id, o.snapshot_id AS os, n.snapshot_id AS ns,
      o.batch AS ob, n.batch AS nb FROM old_sel o FULL OUTER JOIN new_sel n ON o.domain = n.domain AND o.document_id = n.document_id)
  SELECT 'overwrite' AS mode, domain, document_id, coalesce(ns, os) AS snapshot_id, coalesce(CASE WHEN ns IS NOT NULL THEN nb ELSE ob END, '') AS batch FROM f
  UNION ALL SELECT 'keep', domain, document_id, coalesce(ns, os), coalesce(nb, ob, '') FROM f
  UNION ALL SELECT 'ignore', domain, document_id, coalesce(os, ns), coalesce(CASE WHEN os IS NOT NULL THEN ob ELSE nb END, '') FROM f
""", ("old_sel", "new_sel"))
def s06(spark, d):
    old, new = _selections(spark, d)
    parts = [fl.upsert(old, new, ["domain", "document_id"], m).withColumn("mode", F.lit(m)) for m in ("overwrite", "keep", "ignore")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).na.fill("", ["batch"])


@query("s06_stored_upsert", """
  SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.document_id, o.document_id) AS document_id, coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.batch, o.batch, '') AS batch
  FROM old_sel o FULL OUTER JOIN new_sel n ON o.domain = n.domain AND o.document_id = n.document_id
""", ("old_sel", "new_sel"))
def s06_stored(spark, d):
    old, new = _selections(spark, d)
    root = fl.scratch(spark)
    sd.create_stored(old, root, ["domain", "document_id"])
    sd.upsert_stored(new, root, "keep")
    return sd.read_stored(spark, root).na.fill("", ["batch"])


# Model outputs built from event properties: fenced, bare, broken, wrong type, missing key, plain text.
@query("s07_parse_outputs", """
  SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'json_array' WHEN 'signup' THEN 'text' ELSE 'json_object' END AS expected_type,
    CASE event_type WHEN 'view' THEN props WHEN 'click' THEN substr(props, 1, length(props) - 1) WHEN 'error' THEN replace(props, '"k"', '"z"') WHEN 'purchase' THEN '[' || props || ']' ELSE props END AS body,
    CASE event_type WHEN 'click' THEN 'failed' WHEN 'error' THEN 'schema_invalid' ELSE 'succeeded' END AS parse_status
  FROM events
""")
def s07(spark, d):
    e, p = F.col("event_type"), F.col("props")
    raw = (
        F.when(e == "view", F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(e == "click", F.expr("substr(props, 1, length(props) - 1)"))
        .when(e == "error", F.replace(p, F.lit('"k"'), F.lit('"z"'))).when(e == "purchase", F.concat(F.lit("```\n["), p, F.lit("]```"))).otherwise(p))
    kind = F.when(e == "purchase", "json_array").when(e == "signup", "text").otherwise("json_object")
    return fl.parse_outputs(dv.table(spark, d, "events").select(F.col("event_id").alias("id"), raw.alias("raw_text"), kind.alias("expected_type")), ["k"])


@query("s08_json_vectors", """
  SELECT vec_id, label NOT IN (8, 9) AS parsed, CASE WHEN label IN (8, 9) THEN 0 ELSE round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM embeddings
""")
def s08(spark, d):
    e = dv.table(spark, d, "embeddings")
    js = F.to_json("embedding")
    text = F.when(F.col("label") == 9, F.expr("substr(to_json(embedding), 1, length(to_json(embedding)) - 1)")).when(
        F.col("label") == 8, F.to_json(F.slice("embedding", 1, 10))).otherwise(js)
    v = e.select("vec_id", fl.json_vector(text, 64).alias("v"))
    return v.select("vec_id", F.col("v").isNotNull().alias("parsed"),
                    F.coalesce(F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4), F.lit(0.0)).alias("total"))


@query("s10_bootstrap_ontology", """
  WITH seed AS (SELECT DISTINCT r_name AS domain, 'node_type' AS kind, p_type AS name, '' AS alias FROM part, region
    UNION SELECT r_name, 'alias', n_name, lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT domain, CASE domain WHEN 'ASIA' THEN 3 ELSE 1 END AS version_no, kind, name, alias AS alias_normalized FROM seed WHERE domain <> 'AFRICA'
""")
def s10(spark, d):
    region, nation, part = (dv.table(spark, d, t) for t in ("region", "nation", "part"))
    types = part.agg(F.collect_set("p_type").alias("ts")).scalar()
    n = region.select(F.col("r_name").alias("domain"), F.lit("node_type").alias("kind"), F.explode(types).alias("name"), F.lit("").alias("alias"))
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("domain"), F.lit("alias").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit(" "), "n_name").alias("alias"))
    seed = n.unionByName(a).withColumn("head", F.lit(None).cast("string")).withColumn("tail", F.lit(None).cast("string"))
    versions = region.filter("r_name IN ('AFRICA', 'ASIA')").select(
        F.col("r_name").alias("domain"), F.when(F.col("r_name") == "ASIA", 2).otherwise(1).alias("version_no"),
        F.when(F.col("r_name") == "ASIA", "superseded").otherwise("active").alias("status"))
    return fl.bootstrap_ontology(seed, versions).select("domain", "version_no", "kind", "name", "alias_normalized")


@query("s11_append_query_log", """
  SELECT conv_id AS query_log_id, turn, role, length(text) AS query_chars FROM conversations WHERE role = 'user'
""")
def s11(spark, d):
    c = dv.table(spark, d, "conversations").filter("role = 'user'").select(
        F.col("conv_id").alias("query_log_id"), "turn", "role", "text", F.length("text").alias("query_chars"))
    path = fl.scratch(spark)
    fl.append_query_log(c, path)
    return spark.read.parquet(path)


@query("s12_active_downloads", """
  WITH a AS (SELECT domain, document_id, snapshot_id, source_batch_id FROM parent_selections WHERE selection_status = 'active'),
  k AS (SELECT document_id, snapshot_id, batch_id, 'file:' || snapshot_id || '/' || copy AS source_uri, linked_at + to_days(copy::INT) AS linked_at, snapshot_id * 10 + copy AS link_id
        FROM links, (SELECT unnest([0, 1, 2]) AS copy))
  SELECT domain, a.document_id, a.snapshot_id, source_uri, link_id FROM a JOIN k ON a.document_id = k.document_id AND a.snapshot_id = k.snapshot_id AND source_batch_id IS NOT DISTINCT FROM batch_id
  QUALIFY row_number() OVER (PARTITION BY a.document_id ORDER BY linked_at DESC, link_id DESC) = 1
""", ("parent_selections", "links"))
def s12(spark, d):
    scope = dv.parent_selections(spark, d).filter("selection_status = 'active'").select("domain", "document_id", "snapshot_id", "source_batch_id")
    k = dv.links(spark, d).select("document_id", "snapshot_id", "batch_id", "linked_at", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy")).select(
        "document_id", "snapshot_id", "batch_id", F.concat(F.lit("file:"), "snapshot_id", F.lit("/"), "copy").alias("source_uri"),
        F.expr("linked_at + make_dt_interval(copy)").alias("linked_at"), (F.col("snapshot_id") * 10 + F.col("copy")).alias("link_id"))
    return fl.active_downloads(scope, k).select("domain", "document_id", "snapshot_id", "source_uri", "link_id")
