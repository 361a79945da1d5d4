"""Enrichment queries E01-E11."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import enrich as en
from tessella.plans import derived as dv
from tessella.plans.registry import fragment, query

# Role of a labelled document, standing for the model's answer: toxic -> risk, quality -> benefit, else note.
fragment("doc_roles", """
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'risk' WHEN quality = 1 THEN 'benefit' ELSE 'note' END AS role, quality, toxic FROM labels
""")


def doc_roles(spark, d):
    return dv.table(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "risk").when(F.col("quality") == 1, "benefit").otherwise("note").alias("role"),
        "quality", "toxic")


def _segments(spark, d):
    return dv.segments(spark, d).select("segment_id", "doc_id", "segment_index", "token_count").withColumn("semantic_role", F.lit("unknown"))


@query("e01_tiny_segments", """
  SELECT segment_id, token_count >= 30 AS send, CASE WHEN token_count < 30 THEN 'note' ELSE 'unknown' END AS semantic_role,
    CASE WHEN token_count < 30 THEN 'segment below min_enrich_tokens (' || token_count || ' tokens)' ELSE '' END AS reason
  FROM segments
""", ("segments",))
def e01(spark, d):
    return en.mark_tiny(_segments(spark, d)).select(
        "segment_id", "send", "semantic_role", F.coalesce("assessment_reason", F.lit("")).alias("reason"))


@query("e02_apply_enrichment", """
  SELECT segment_id, CASE WHEN role IN ('benefit', 'note') THEN role ELSE 'unknown' END AS semantic_role,
    CASE WHEN quality IS NULL THEN '' ELSE 'type' || quality END AS document_type,
    coalesce(quality = 1, false) AS is_substantive, quality IS NOT NULL AS assessed
  FROM segments LEFT JOIN doc_roles USING (doc_id)
""", ("segments", "doc_roles"))
def e02(spark, d):
    s = _segments(spark, d)
    res = s.select("segment_id", "doc_id").join(doc_roles(spark, d), "doc_id").select(
        "segment_id", "role", F.concat(F.lit("type"), "quality").alias("document_type"),
        (F.col("quality") == 1).alias("is_substantive"), F.lit(None).cast("boolean").alias("is_navigation"))
    return en.apply_enrichment(s, res, ["benefit", "note"]).select(
        "segment_id", "semantic_role", F.coalesce("document_type", F.lit("")).alias("document_type"),
        F.coalesce("is_substantive", F.lit(False)).alias("is_substantive"), F.coalesce("assessed", F.lit(False)).alias("assessed"))


@query("e03_entity_refs", """
  WITH res AS (
    SELECT DISTINCT l_orderkey AS segment_id, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS channel, type, name, round(1 - 8 * l_tax, 4) AS confidence
    FROM (SELECT *, 'part' AS type, 'P' || l_partkey AS name FROM lineitem WHERE l_returnflag <> 'N'
          UNION ALL SELECT *, 'supplier', 'S' || l_suppkey FROM lineitem WHERE l_returnflag <> 'N')),
  old AS (SELECT DISTINCT l_orderkey AS segment_id, 'part' AS type, 'P' || l_partkey AS name FROM lineitem WHERE l_returnflag = 'N'),
  new AS (SELECT segment_id,
      CASE WHEN channel = 'A' AND type = 'part' AND confidence >= 0.5 THEN type ELSE '__untyped__' END AS type, name,
      CASE WHEN channel = 'A' AND type = 'part' AND confidence >= 0.5 THEN '' ELSE type END AS proposed_type,
      CASE WHEN channel = 'A' AND type = 'part' AND confidence >= 0.5 THEN '' WHEN channel = 'B' THEN 'llm_out_of_schema'
           WHEN type <> 'part' THEN 'off_schema_type' ELSE 'low_confidence' END AS reason
    FROM res)
  SELECT segment_id, type, name, '' AS proposed_type, '' AS reason FROM old
  UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.segment_id = n.segment_id AND o.type = n.type AND o.name = n.name)
""")
def e03(spark, d):
    li = dv.table(spark, d, "lineitem")
    res = li.filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("segment_id"), F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("channel"),
        F.round(1 - 8 * F.col("l_tax"), 4).alias("confidence"),
        F.explode(F.array(F.struct(F.lit("part").alias("type"), F.concat(F.lit("P"), "l_partkey").alias("name")),
                          F.struct(F.lit("supplier").alias("type"), F.concat(F.lit("S"), "l_suppkey").alias("name")))).alias("e"),
    ).select("segment_id", "channel", "e.type", "e.name", "confidence").distinct()
    old = li.filter("l_returnflag = 'N'").select(
        F.col("l_orderkey").alias("segment_id"), F.lit("part").alias("type"), F.concat(F.lit("P"), "l_partkey").alias("name")).distinct()
    return en.entity_refs(res, old, ["part"]).na.fill("", ["proposed_type", "reason"])


# Rules for the kinds of names the documents hold.
RULES = [
    (r"\d{1,3}(?:\.\d{1,3}){3}", "ip_address"),
    (r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+", "email"),
    (r"[0-9a-f]{40}", "digest"),
    (r"[A-Z][a-z]+tion", "action"),
]


@query("e04_regex_entities", " UNION ALL ".join(
    f"SELECT doc_id AS id, '{t}' AS entity_type, name, upper(name) AS normalized_name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS name FROM documents)"
    for p, t in RULES))
def e04(spark, d):
    return en.regex_entities(dv.documents(spark, d).select(F.col("doc_id").alias("id"), "text"), RULES)


@query("e05_alias_resolution", """
  WITH refs AS (SELECT DISTINCT ' ' || p_name || ' ' AS name FROM part UNION SELECT n_name FROM nation UNION SELECT lower(r_name) FROM region),
  aliases AS (SELECT lower(p_name) AS alias, min(p_type) AS canonical FROM part GROUP BY 1
              UNION ALL SELECT lower(n_name), r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
  norm AS (SELECT name, lower(trim(name)) AS n FROM refs)
  SELECT name, coalesce(a.canonical, o.canonical, '') AS canonical_name, CASE WHEN coalesce(a.canonical, o.canonical) IS NULL THEN 'pending' ELSE 'auto' END AS resolve_status
  FROM norm LEFT JOIN aliases a ON n = alias LEFT JOIN (SELECT DISTINCT canonical FROM aliases) o ON n = lower(o.canonical)
""")
def e05(spark, d):
    part, nation, region = (dv.table(spark, d, t) for t in ("part", "nation", "region"))
    refs = part.select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name")).union(nation.select("n_name")).union(
        region.select(F.lower("r_name"))).distinct()
    aliases = part.groupBy(F.lower("p_name").alias("alias_normalized")).agg(F.min("p_type").alias("canonical_name")).union(
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name"), "r_name"))
    return en.resolve_aliases(refs, aliases).na.fill("", ["canonical_name"])


# Relation patterns (name, head type, tail type).
PATTERNS = [("supplied_by", "part", "supplier"), ("sold_with", "part", "part")]
fragment("pairs", """
  WITH one AS (SELECT DISTINCT segment_id, node_type, mention_text AS key FROM mentions)
  SELECT a.segment_id, a.key AS head, a.node_type AS head_type, b.key AS tail, b.node_type AS tail_type
  FROM one a JOIN one b ON a.segment_id = b.segment_id AND a.key <> b.key
""", ("mentions",))


def pairs(spark, d):
    return en.co_mentions(dv.mentions(spark, d).select("segment_id", F.col("node_type").alias("type"), F.col("mention_text").alias("key")))


fragment("typed_pairs", """
  SELECT segment_id, head, CASE WHEN tail_type = 'supplier' THEN 'supplied_by' ELSE 'sold_with' END AS relation_type, tail, head_type, tail_type
  FROM pairs WHERE head_type = 'part'
""", ("pairs",))


@query("e06_candidate_relations", "SELECT * FROM typed_pairs", ("typed_pairs",))
def e06(spark, d):
    return en.candidate_relations(pairs(spark, d), PATTERNS)


@query("e07_off_schema_pairs", "SELECT * FROM pairs WHERE head_type = 'supplier'", ("pairs",))
def e07(spark, d):
    return en.off_schema_pairs(pairs(spark, d), PATTERNS)


# The same rows folded to one per entity: how many, and a sum of hashes over them, so that all of them are compared.
def folded(rows, by: list[str], of: list[str]):
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *of)), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


def folded_sql(table: str, by: str, of: str) -> str:
    return f"SELECT {by}, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', {of})), 1, 8))::BIGINT)::BIGINT AS digest FROM {table} GROUP BY ALL"


@query("e06_relations_folded", folded_sql("typed_pairs", "head, relation_type", "segment_id, head, relation_type, tail, head_type, tail_type"), ("typed_pairs",))
def e06b(spark, d):
    of = ["segment_id", "head", "relation_type", "tail", "head_type", "tail_type"]
    return folded(en.candidate_relations(pairs(spark, d), PATTERNS), ["head", "relation_type"], of)


@query("e07_off_schema_folded", folded_sql("(SELECT * FROM pairs WHERE head_type = 'supplier')", "head, tail_type", "segment_id, head, head_type, tail, tail_type"), ("pairs",))
def e07b(spark, d):
    return folded(en.off_schema_pairs(pairs(spark, d), PATTERNS), ["head", "tail_type"], ["segment_id", "head", "head_type", "tail", "tail_type"])


fragment("windows", """
  WITH c AS (SELECT doc_id, segment_id, token_count, row_number() OVER (PARTITION BY doc_id ORDER BY segment_index) - 1 AS pos,
               count(*) OVER (PARTITION BY doc_id) AS n FROM segments WHERE NOT is_heading),
  w AS (SELECT *, pos // 14 AS window_id FROM c UNION ALL SELECT *, pos // 14 - 1 FROM c WHERE pos % 14 = 0 AND pos > 0)
  SELECT doc_id, window_id, pos - window_id * 14 AS window_pos, segment_id, token_count FROM w WHERE least(15, n - window_id * 14) >= 2
""", ("segments",))


@query("e08_discourse_windows", "SELECT * FROM windows", ("windows",))
def e08(spark, d):
    return en.discourse_windows(dv.segments(spark, d))


# Model answers per window: each segment is related to the next two; the label follows its length.
fragment("answers", """
  SELECT doc_id, window_id, window_pos AS source, window_pos + o AS target,
    CASE WHEN token_count >= 80 THEN 'ELABORATES' WHEN token_count >= 50 THEN 'CAUSES' WHEN token_count >= 30 THEN 'unrelated'
         WHEN token_count >= 15 THEN 'CONTRASTS_WITH' ELSE 'GUESSED' END AS relation,
    round(least(1.0, token_count / 100.0::DOUBLE), 2) AS confidence
  FROM windows, (SELECT unnest([1, 2]) AS o)
""", ("windows",))
fragment("mapped", """
  SELECT s.segment_id AS source_id, t.segment_id AS target_id, lower(relation) AS relation_type, confidence, target - source AS distance
  FROM answers a JOIN windows s ON a.doc_id = s.doc_id AND a.window_id = s.window_id AND source = s.window_pos
  JOIN windows t ON a.doc_id = t.doc_id AND a.window_id = t.window_id AND target = t.window_pos
  WHERE relation NOT IN ('unrelated', 'GUESSED')
""", ("answers", "windows"))


def mapped(spark, d):
    w = en.discourse_windows(dv.segments(spark, d))
    n = F.col("token_count")
    label = F.when(n >= 80, "ELABORATES").when(n >= 50, "CAUSES").when(n >= 30, "unrelated").when(n >= 15, "CONTRASTS_WITH").otherwise("GUESSED")
    answers = w.select(
        "doc_id", "window_id", F.col("window_pos").alias("source"), label.alias("relation"),
        F.round(F.least(F.lit(1.0), n / 100), 2).alias("confidence"), F.explode(F.array(F.lit(1), F.lit(2))).alias("o"),
    ).withColumn("target", F.col("source") + F.col("o")).drop("o")
    return en.map_discourse(answers, w)


@query("e09_map_discourse", "SELECT * FROM mapped", ("mapped",))
def e09(spark, d):
    return mapped(spark, d)


fragment("best_mapped", """
  SELECT source_id, target_id, relation_type, max(confidence) AS confidence FROM mapped WHERE confidence >= 0.5 GROUP BY 1, 2, 3
""", ("mapped",))


@query("e10_best_relations", "SELECT * FROM best_mapped", ("best_mapped",))
def e10(spark, d):
    return en.best_relations(mapped(spark, d))


fragment("roles", """
  WITH ends AS (
    SELECT source_id AS segment_id, CASE WHEN relation_type = 'causes' THEN 1 ELSE 2 END AS role FROM relations WHERE relation_type <> 'previous'
    UNION ALL SELECT target_id, CASE WHEN relation_type = 'elaborates' THEN 1 ELSE 2 END FROM relations WHERE relation_type <> 'previous')
  SELECT segment_id, CASE max(role) WHEN 2 THEN 'nucleus' WHEN 1 THEN 'satellite' ELSE 'standalone' END AS discourse_role
  FROM segments LEFT JOIN ends USING (segment_id) GROUP BY 1
""", ("relations", "segments"))


def roles(spark, d, few=None):
    return en.discourse_roles(dv.segments(spark, d, few), dv.relations(spark, d, few))


@query("e11_discourse_roles", "SELECT * FROM roles", ("roles",))
def e11(spark, d):
    return roles(spark, d)
