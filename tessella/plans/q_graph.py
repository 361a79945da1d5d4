"""Knowledge graph queries B01-B27."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph as gr
from tessella.plans import derived as dv
from tessella.plans.q_enrich import PATTERNS, folded, folded_sql
from tessella.plans.q_units import word_refs
from tessella.plans.registry import fragment, query

SUPPLIED = [PATTERNS[0]]


@query("b01_flatten_mentions", """
  SELECT snapshot_id, segment_id, node_type, mention_text, coalesce(canonical_name, '') AS canonical_name, resolve_status, 'order ' || o_orderpriority AS quote
  FROM mentions JOIN orders ON segment_id = o_orderkey
""", ("mentions",))
def b01(spark, d):
    ref = F.struct(F.col("node_type").alias("type"), F.col("mention_text").alias("name"), "canonical_name", "resolve_status")
    s = dv.mentions(spark, d).groupBy("snapshot_id", "segment_id").agg(F.collect_list(ref).alias("refs"))
    o = dv.table(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), F.concat(F.lit("order "), "o_orderpriority").alias("raw_text"))
    return gr.flatten_mentions(s.join(o, "segment_id")).drop("pos").na.fill("", ["canonical_name"])


@query("b02_canonical_entities", """
  SELECT node_type, canonical_name, count(*) AS mention_count, count(DISTINCT snapshot_id) AS document_count FROM mentions WHERE resolve_status = 'auto' GROUP BY 1, 2
""", ("mentions",))
def b02(spark, d):
    return gr.canonical_entities(dv.mentions(spark, d))


fragment("edges_all", """
  SELECT head, relation_type, tail, min(head_type) AS head_type, min(tail_type) AS tail_type, count(*) AS cooccur, min(segment_id) AS first_segment
  FROM typed_pairs WHERE relation_type = 'supplied_by' GROUP BY 1, 2, 3
""", ("typed_pairs",))


def mention_refs(spark, d):
    return dv.mentions(spark, d).select("segment_id", F.col("node_type").alias("type"), F.col("mention_text").alias("key"))


def edges_all(spark, d):
    return gr.co_mention_edges(mention_refs(spark, d), SUPPLIED)


@query("b03_edge_aggregation", "SELECT * FROM edges_all", ("edges_all",))
def b03(spark, d):
    return edges_all(spark, d)


fragment("strength", """
  WITH seen AS (SELECT DISTINCT mention_text AS key, segment_id FROM mentions), n AS (SELECT key, count(*) AS n FROM seen GROUP BY 1),
  b AS (SELECT x.key AS head, y.key AS tail, count(*) AS n_both FROM seen x JOIN seen y ON x.segment_id = y.segment_id AND x.key <> y.key GROUP BY 1, 2),
  p AS (SELECT e.*, h.n / total AS ph, t.n / total AS pt, coalesce(n_both, 0) / total AS pht FROM edges_all e JOIN n h ON head = h.key JOIN n t ON tail = t.key
        LEFT JOIN b ON e.head = b.head AND e.tail = b.tail, (SELECT count(*) AS total FROM orders))
  SELECT head, relation_type, tail, head_type, tail_type, cooccur, round(CASE WHEN pht <= 0 THEN -1 WHEN pht = 1 THEN 1 ELSE ln(pht / (ph * pt)) / -ln(pht) END, 9) AS npmi FROM p
""", ("mentions", "edges_all"))


def strength(spark, d, entities=None):
    total = dv.table(spark, d, "orders").agg(F.count("*")).scalar()
    return gr.strong_edges(mention_refs(spark, d), SUPPLIED, total, entities=entities)


@query("b04_npmi", "SELECT head, tail, cooccur, round(npmi, 6) AS npmi FROM strength", ("strength",))
def b04(spark, d):
    return strength(spark, d).select("head", "tail", "cooccur", F.round("npmi", 6).alias("npmi"))


@query("b05_kept_edges", """
  SELECT head AS head_id, tail AS tail_id, relation_type, round(greatest(0, least(1, (npmi + 1) / 2)), 6) AS confidence, cooccur FROM strength
  WHERE npmi >= 0.1 AND head IN (SELECT entity_id FROM entities) AND tail IN (SELECT entity_id FROM entities)
""", ("strength", "entities"))
def b05(spark, d):
    # Order lines pair at random, so the floor is set below its default of 0.3.
    return gr.kept_edges(strength(spark, d, dv.entities(spark, d)), floor=0.1)


@query("b06_off_schema_candidates", """
  WITH p AS (SELECT * FROM pairs WHERE head_type = 'supplier'),
  e AS (SELECT head_type, tail_type, head, tail FROM (SELECT DISTINCT head_type, tail_type, head, tail FROM p) QUALIFY row_number() OVER (PARTITION BY head_type, tail_type ORDER BY head, tail) <= 5)
  SELECT head_type || '->' || tail_type AS proposed_name, (SELECT count(*) FROM p WHERE p.head_type = e.head_type AND p.tail_type = e.tail_type) AS cooccur,
    string_agg(head || '/' || tail, ',' ORDER BY head, tail) AS examples FROM e GROUP BY head_type, tail_type
""", ("pairs",))
def b06(spark, d):
    c = gr.off_schema_summary(mention_refs(spark, d), PATTERNS)
    return c.withColumn("examples", F.array_join(F.transform("examples", lambda x: F.concat_ws("/", x["head"], x["tail"])), ","))


def _rebuild_sql(mention_filter: str) -> str:
    return f"""
  WITH seen AS (SELECT DISTINCT canonical_name AS key, node_type, segment_id FROM mentions WHERE {mention_filter}), n AS (SELECT key, count(*) AS n FROM seen GROUP BY 1),
  e AS (SELECT x.key AS head_id, y.key AS tail_id, count(*) AS c FROM seen x JOIN seen y ON x.segment_id = y.segment_id WHERE x.node_type = 'part' AND y.node_type = 'supplier' GROUP BY 1, 2),
  p AS (SELECT e.*, ln((c / total) / ((h.n / total) * (t.n / total))) / -ln(c / total) AS npmi FROM e JOIN n h ON head_id = h.key JOIN n t ON tail_id = t.key, (SELECT count(*) AS total FROM orders))
  SELECT head_id, tail_id, 'supplied_by' AS relation_type, round(greatest(0, least(1, (round(npmi, 9) + 1) / 2)), 6) AS confidence, c AS cooccur FROM p WHERE round(npmi, 9) >= 0.3
"""


fragment("run_snapshots", "SELECT DISTINCT o_orderstatus AS run_id, o_orderkey // 10 AS snapshot_id FROM orders WHERE o_orderpriority = '1-URGENT'")
fragment("rebuilt", _rebuild_sql("resolve_status <> 'pending'"), ("mentions",))


def run_snapshots(spark, d):
    return dv.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderstatus").alias("run_id"), F.floor(F.col("o_orderkey") / 10).alias("snapshot_id")).distinct()


def linked_mentions(spark, d):
    return dv.mentions(spark, d).withColumn("entity_id", F.col("canonical_name"))


@query("b07_rebuild_edges", "SELECT * FROM rebuilt", ("rebuilt",))
def b07(spark, d):
    total = dv.table(spark, d, "orders").agg(F.count("*")).scalar()
    return gr.rebuild_edges(linked_mentions(spark, d), dv.entities(spark, d), SUPPLIED, total)


@query("b08_scoped_recompute", "SELECT * FROM rebuilt", ("rebuilt",))
def b08(spark, d):
    total = dv.table(spark, d, "orders").agg(F.count("*")).scalar()
    m, e = linked_mentions(spark, d), dv.entities(spark, d)
    changed = e.groupBy("node_type").agg(F.max_by("entity_id", F.struct("mention_count", "entity_id")).alias("entity_id")).select("entity_id")
    # Edges before the change lack the strengths around the changed entities: they are set to zero here.
    now = gr.rebuild_edges(m, e, SUPPLIED, total)
    ends = changed.withColumn("stale", F.lit(True))
    stale = now.join(ends.withColumnRenamed("entity_id", "head_id"), "head_id", "left").withColumn(
        "confidence", F.when(F.col("stale"), 0.0).otherwise(F.col("confidence"))).select(now.columns)
    return gr.scoped_recompute(changed, stale, m, e, SUPPLIED, total)


@query("b09_replace_snapshots", """
  WITH new AS (SELECT mention_id, snapshot_id, 'redone' AS resolve_status FROM mentions WHERE resolve_status = 'auto')
  SELECT mention_id, snapshot_id, resolve_status FROM mentions WHERE snapshot_id NOT IN (SELECT snapshot_id FROM new) UNION ALL SELECT * FROM new
""", ("mentions",))
def b09(spark, d):
    old = dv.mentions(spark, d).select("mention_id", "snapshot_id", "resolve_status")
    return gr.replace_snapshots(old, old.filter("resolve_status = 'auto'").withColumn("resolve_status", F.lit("redone")))


def all_entities(spark, d):
    """Every part and supplier, mentioned or not."""
    p = dv.table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.lit("part").alias("node_type"))
    s = dv.table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.lit("supplier").alias("node_type"))
    return p.unionByName(s).withColumn("canonical_name", F.col("entity_id"))


fragment("all_entities", "SELECT 'P' || p_partkey AS entity_id, 'part' AS node_type FROM part UNION ALL SELECT 'S' || s_suppkey, 'supplier' FROM supplier")
COUNT_SQL = """
  SELECT a.entity_id, a.node_type, count(m.mention_id) AS mention_count, count(DISTINCT m.snapshot_id) AS document_count
  FROM all_entities a LEFT JOIN mentions m ON m.canonical_name = a.entity_id GROUP BY 1, 2
"""


@query("b10_recount_entities", COUNT_SQL, ("all_entities", "mentions"))
def b10(spark, d):
    return gr.recount(all_entities(spark, d).drop("canonical_name"), linked_mentions(spark, d))


# Merges: overdrawn suppliers into the first of their nation, firsts of a nation into the first of the region.
def merges(spark, d):
    s = dv.table(spark, d, "supplier").join(dv.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    by_n = s.groupBy("n_nationkey").agg(F.min("s_suppkey").alias("mn"))
    by_r = s.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("mr"))
    a = s.filter("s_acctbal < 0").join(by_n, "n_nationkey").select("s_suppkey", F.col("mn").alias("p"))
    b = by_n.join(dv.table(spark, d, "nation"), "n_nationkey").join(by_r, "n_regionkey").select(F.col("mn").alias("s_suppkey"), F.col("mr").alias("p"))
    return a.unionByName(b).select(F.concat(F.lit("S"), "s_suppkey").alias("drop_id"), F.concat(F.lit("S"), "p").alias("primary_id"))


fragment("roots", """
  WITH s AS (SELECT s_suppkey, s_acctbal, min(s_suppkey) OVER (PARTITION BY n_nationkey) AS mn, min(s_suppkey) OVER (PARTITION BY n_regionkey) AS mr
             FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT 'S' || s_suppkey AS drop_id, 'S' || mr AS primary_id FROM s WHERE (s_acctbal < 0 OR s_suppkey = mn) AND s_suppkey <> mr
""")


@query("b11_merge_entities", """
  WITH m AS (SELECT coalesce(primary_id, canonical_name) AS entity_id, snapshot_id FROM mentions LEFT JOIN roots ON canonical_name = drop_id WHERE canonical_name IS NOT NULL)
  SELECT 'entity' AS kind, a.entity_id AS a, node_type AS b, count(m.entity_id) AS n FROM all_entities a LEFT JOIN m USING (entity_id)
    WHERE a.entity_id NOT IN (SELECT drop_id FROM roots) GROUP BY 1, 2, 3
  UNION ALL SELECT 'edge', head, tail, 1 FROM graph_edges WHERE head NOT IN (SELECT drop_id FROM roots)
""", ("mentions", "roots", "all_entities", "graph_edges"))
def b11(spark, d):
    roots = gr.merge_roots(merges(spark, d))
    edges = dv.graph_edges(spark, d).select(F.col("head").alias("head_id"), F.col("tail").alias("tail_id"))
    ev = linked_mentions(spark, d).select("entity_id", "segment_id")
    out = gr.merge_entities(roots, all_entities(spark, d), linked_mentions(spark, d), ev, edges)
    return out["entities"].select(F.lit("entity").alias("kind"), F.col("entity_id").alias("a"), F.col("node_type").alias("b"), F.col("mention_count").alias("n")).union(
        out["edges"].select(F.lit("edge"), "head_id", "tail_id", F.lit(1).cast("bigint")))


# Named entities: the (type, name) pairs of the parts.
def named(spark, d):
    return dv.table(spark, d, "part").groupBy(F.col("p_type").alias("node_type"), F.col("p_name").alias("canonical_name")).agg(
        F.min("p_partkey").alias("entity_id"), F.count("*").alias("mention_count"), F.count_distinct("p_brand").alias("document_count"))


fragment("named", """
  SELECT p_type AS node_type, p_name AS canonical_name, min(p_partkey) AS entity_id, count(*) AS mention_count, count(DISTINCT p_brand) AS document_count FROM part GROUP BY 1, 2
""")


@query("b12_retype_entities", """
  WITH d AS (SELECT * FROM named WHERE node_type = 'ECONOMY'), h AS (SELECT canonical_name, entity_id AS holder FROM named WHERE node_type = 'SMALL'),
  t AS (SELECT entity_id, holder FROM d LEFT JOIN h USING (canonical_name))
  SELECT 'entity' AS kind, entity_id AS a, CASE WHEN entity_id IN (SELECT entity_id FROM t WHERE holder IS NULL) THEN 'SMALL' ELSE node_type END AS b FROM named
  UNION ALL SELECT 'merge', entity_id, holder::VARCHAR FROM t WHERE holder IS NOT NULL
""", ("named",))
def b12(spark, d):
    e = named(spark, d)
    ents, mg = gr.retype_entities(e, e.filter("node_type = 'ECONOMY'").select("entity_id", F.lit("SMALL").alias("new_type")))
    return ents.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("a"), F.col("node_type").alias("b")).union(
        mg.select(F.lit("merge"), "drop_id", F.col("primary_id").cast("string")))


fragment("overdrawn", "SELECT 'S' || s_suppkey AS entity_id FROM supplier WHERE s_acctbal < 0")


@query("b13_delete_entities", """
  SELECT 'entities' AS kind, count(*) AS n FROM all_entities WHERE entity_id NOT IN (SELECT entity_id FROM overdrawn)
  UNION ALL SELECT 'mentions', count(*) FROM mentions WHERE canonical_name IS NULL OR canonical_name NOT IN (SELECT entity_id FROM overdrawn)
  UNION ALL SELECT 'evidence', count(*) FROM mentions WHERE resolve_status = 'human' AND canonical_name NOT IN (SELECT entity_id FROM overdrawn)
  UNION ALL SELECT 'edges', count(*) FROM graph_edges WHERE head NOT IN (SELECT entity_id FROM overdrawn)
""", ("all_entities", "mentions", "graph_edges", "overdrawn"))
def b13(spark, d):
    ids = dv.table(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"))
    m = linked_mentions(spark, d)
    edges = dv.graph_edges(spark, d).select(F.col("head").alias("head_id"), F.col("tail").alias("tail_id"))
    out = gr.delete_entities(ids, all_entities(spark, d), m, m.filter("resolve_status = 'human'").select("entity_id", "segment_id"), edges)
    parts = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in out.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


fragment("untyped", "SELECT *, CASE WHEN node_type IN ('SMALL', 'PROMO') THEN '__untyped__' ELSE node_type END AS t FROM named", ("named",))


@query("b14_rebind_untyped", """
  WITH w AS (SELECT entity_id, canonical_name FROM untyped WHERE t = '__untyped__' AND canonical_name LIKE 'small%'),
  f AS (SELECT canonical_name, min(entity_id) AS f FROM w WHERE canonical_name NOT IN (SELECT canonical_name FROM untyped WHERE t = 'ECONOMY') GROUP BY 1)
  SELECT entity_id, CASE WHEN entity_id IN (SELECT f FROM f) THEN 'ECONOMY' ELSE t END AS node_type, canonical_name FROM untyped
""", ("untyped",))
def b14(spark, d):
    e = named(spark, d).withColumn("node_type", F.when(F.col("node_type").isin("SMALL", "PROMO"), gr.UNTYPED).otherwise(F.col("node_type"))).select(
        "entity_id", "node_type", "canonical_name")
    # Candidates: the untyped 'small ...' entities are accepted as ECONOMY, one list per first letter of the noun.
    c = e.filter(f"node_type = '{gr.UNTYPED}' AND canonical_name LIKE 'small%'").groupBy(
        F.split_part("canonical_name", F.lit(" "), F.lit(2)).alias("noun")).agg(F.collect_list("entity_id").alias("member_ids")).select(
        F.lit("ECONOMY").alias("proposed_name"), F.lit("accepted").alias("status"), "member_ids")
    return gr.rebind_untyped(e, c)


@query("b15_type_candidates", """
  WITH e AS (SELECT lower(canonical_name) AS n, entity_id, document_count, mention_count FROM named QUALIFY row_number() OVER (PARTITION BY canonical_name ORDER BY entity_id DESC) = 1)
  SELECT split_part(n, ' ', 1) AS type_name, count(*) AS members, sum(document_count)::BIGINT AS df, sum(mention_count)::BIGINT AS support FROM e GROUP BY 1
  HAVING sum(document_count) >= least(2, (SELECT greatest(max(document_count), 1) FROM named))
""", ("named",))
def b15(spark, d):
    p = dv.table(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("type_name")).agg(
        F.collect_set(F.concat(F.lit(" "), F.upper("p_name"))).alias("members"))
    return gr.type_candidates(named(spark, d), p)


fragment("type_list", "SELECT p_type AS name, lower(p_type) AS t, max(p_name) AS example FROM part GROUP BY 1")
fragment("proposals", """
  SELECT DISTINCT p_type || ' X' AS proposed_name FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT substr(p_type, 1, 3) FROM part
""")


def _types(spark, d):
    return dv.table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.array(F.max("p_name")).alias("examples"))


def _proposals(spark, d):
    p = dv.table(spark, d, "part")
    return p.select(F.concat("p_type", F.lit(" X")).alias("proposed_name")).union(p.select("p_name")).union(p.select(F.substring("p_type", 1, 3))).distinct()


DUP_SQL = """
  SELECT proposed_name, min(name) AS duplicate_of FROM (SELECT proposed_name, lower(replace(proposed_name, ' ', '')) AS p FROM proposals) x
  JOIN type_list ON contains(p, t) OR contains(t, p) OR p = lower(replace(example, ' ', '')) GROUP BY 1
"""


@query("b16_duplicate_types", DUP_SQL, ("proposals", "type_list"))
def b16(spark, d):
    return gr.duplicate_types(_proposals(spark, d), _types(spark, d))


@query("b17_suggest_entities", """
  WITH m AS (SELECT p_partkey AS mention_id, split_part(p_name, ' ', 1) AS mt, p_type FROM part)
  SELECT mention_id, entity_id, canonical_name, mention_count, row_number() OVER (PARTITION BY mention_id ORDER BY mention_count DESC, entity_id) AS rank
  FROM m JOIN named ON p_type = node_type AND (contains(canonical_name, mt) OR contains(mt, canonical_name)) QUALIFY rank <= 5
""", ("named",))
def b17(spark, d):
    m = dv.table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("mention_text"),
                                          F.col("p_type").alias("node_type"))
    return gr.suggest_entities(m, named(spark, d))


def fact_edges(spark, d):
    return dv.graph_edges(spark, d).select(F.col("head").alias("head_id"), F.col("tail").alias("tail_id"), "relation_type", "confidence")


def graph_seeds(spark, d):
    return dv.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("S"), F.min("s_suppkey")).alias("seed_id")).select("seed_id")


fragment("hood", """
  WITH s AS (SELECT 'S' || min(s_suppkey) AS seed_id FROM supplier GROUP BY s_nationkey), e AS (SELECT * FROM graph_edges),
  r AS (SELECT seed_id, seed_id AS entity_id FROM s UNION SELECT seed_id, tail FROM s JOIN e ON head = seed_id)
  SELECT seed_id, head AS head_id, tail AS tail_id, relation_type, confidence FROM r JOIN e ON head = entity_id
  UNION SELECT seed_id, head, tail, relation_type, confidence FROM r JOIN e ON tail = entity_id
""", ("graph_edges",))


@query("b18_neighbourhood_edges", "SELECT * FROM hood", ("hood",))
def b18(spark, d):
    return gr.neighbourhood_edges(graph_seeds(spark, d), fact_edges(spark, d), 1)


@query("b18_neighbourhood_folded", folded_sql("hood", "seed_id", "head_id, tail_id, relation_type"), ("hood",))
def b18b(spark, d):
    return folded(gr.neighbourhood_edges(graph_seeds(spark, d), fact_edges(spark, d), 1), ["seed_id"], ["head_id", "tail_id", "relation_type"])


# Mentions with text: capitalised words; long words are kept in upper case, so some never occur as written.
@query("b19_best_quotes", """
  WITH m AS (SELECT name AS entity_id, CASE WHEN length(name) >= 12 THEN upper(name) ELSE name END AS mention, segment_key FROM word_refs),
  j AS (SELECT *, instr(raw_text, mention) - 1 AS p0 FROM m JOIN segments ON segment_key = segment_id
        QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY instr(raw_text, mention) = 0, length(raw_text), segment_id) = 1),
  w AS (SELECT *, greatest(0, p0 - 80) AS a, least(length(raw_text), p0 + length(mention) + 80) AS b FROM j)
  SELECT entity_id, mention, CASE WHEN p0 < 0 THEN regexp_replace(substr(raw_text, 1, 160), '^\\s+|\\s+$', '', 'g') ELSE
    CASE WHEN a > 0 THEN '…' ELSE '' END || regexp_replace(substr(raw_text, a + 1, b - a), '^\\s+|\\s+$', '', 'g') || CASE WHEN b < length(raw_text) THEN '…' ELSE '' END END AS quote
  FROM w
""", ("word_refs", "segments"))
def b19(spark, d):
    m = word_refs(spark, d).select(F.col("name").alias("entity_id"), F.when(F.length("name") >= 12, F.upper("name")).otherwise(F.col("name")).alias("mention_text"),
                                   F.col("segment_key").alias("segment_id"))
    return gr.best_quotes(m, dv.segments(spark, d).select("segment_id", "raw_text"))


@query("b20_entity_members", """
  WITH m AS (SELECT canonical_name AS entity_id, segment_id, mention_text FROM mentions WHERE canonical_name IS NOT NULL GROUP BY ALL)
  SELECT entity_id, count(segment_id) AS members, coalesce(min(segment_id), -1) AS first_segment, coalesce(sum(segment_id), 0)::BIGINT AS segment_sum FROM all_entities LEFT JOIN m USING (entity_id) GROUP BY 1
""", ("mentions", "all_entities"))
def b20(spark, d):
    e = gr.entity_members(all_entities(spark, d), linked_mentions(spark, d), chunk=500)
    seg = F.transform("members", lambda m: m["segment_id"])
    per = e.select("entity_id", F.size("members").alias("n"), F.array_min(seg).alias("lo"), F.aggregate(seg, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("s"))
    return per.groupBy("entity_id").agg(F.sum("n").alias("members"), F.coalesce(F.min("lo"), F.lit(-1)).alias("first_segment"), F.sum("s").alias("segment_sum"))


# Type candidates: one per part name in the domain of its brand; half were known before, some reviewed.
def _candidates(spark, d):
    p = dv.table(spark, d, "part").groupBy(F.col("p_brand").alias("domain"), F.col("p_name").alias("proposed_name")).agg(
        F.count("*").alias("n"), F.max("p_size").alias("size")).withColumn("kind", F.lit("node_type"))
    old = p.filter("size >= 25").select("domain", "kind", "proposed_name", F.lit(0).cast("bigint").alias("score"), F.when(F.col("size") >= 45, "rejected").otherwise("proposed").alias("status"))
    return p, old


fragment("cand_base", "SELECT p_brand AS domain, p_name AS proposed_name, count(*) AS n, max(p_size) AS size FROM part GROUP BY 1, 2")
fragment("cand_reviewed", """
  SELECT domain, CASE WHEN size < 45 AND size >= 40 THEN proposed_name || ' type' ELSE proposed_name END AS proposed_name, CASE WHEN n >= 2 OR size < 25 THEN n ELSE 0 END AS score,
    CASE WHEN size >= 45 THEN 'rejected' WHEN size >= 40 THEN 'accepted' WHEN size < 5 THEN 'rejected' ELSE 'proposed' END AS status
  FROM cand_base WHERE n >= 2 OR size >= 25
""", ("cand_base",))


def reviewed(spark, d):
    p, old = _candidates(spark, d)
    new = p.filter("n >= 2 OR size < 25").filter("n >= 2 OR size >= 25").select("domain", "kind", "proposed_name", F.col("n").alias("score"))
    up = gr.upsert_candidates(old, new)
    dec = p.filter("size >= 40 OR size < 5").select("domain", "kind", "proposed_name", F.when(F.col("size") >= 40, "accept").otherwise("reject").alias("action"),
                                                   F.when(F.col("size") >= 40, F.concat("proposed_name", F.lit(" type"))).alias("new_name"))
    return gr.review_candidates(up, dec)


@query("b21_candidate_review", "SELECT domain, 'node_type' AS kind, proposed_name, score, status FROM cand_reviewed", ("cand_reviewed",))
def b21(spark, d):
    return reviewed(spark, d)


@query("b21_promote_accepted", """
  WITH t AS (SELECT DISTINCT p_brand AS domain, p_type AS name FROM part), a AS (SELECT DISTINCT domain, proposed_name AS name FROM cand_reviewed WHERE status = 'accepted')
  SELECT domain, 8 AS version_no, 'node_type' AS kind, name FROM (SELECT * FROM t WHERE domain IN (SELECT domain FROM a) UNION SELECT * FROM a)
""", ("cand_reviewed",))
def b21b(spark, d):
    t = dv.table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.lit(7).alias("version_no"), F.lit("node_type").alias("kind"), F.col("p_type").alias("name")).distinct()
    return gr.promote_accepted(t, reviewed(spark, d))


@query("b22_list_entities", """
  SELECT entity_id, node_type, canonical_name, mention_count, (SELECT count(*) FROM named WHERE canonical_name ILIKE '%BOLT%') AS total
  FROM named WHERE canonical_name ILIKE '%BOLT%' ORDER BY mention_count DESC NULLS LAST, canonical_name, node_type LIMIT 20 OFFSET 5
""", ("named",))
def b22(spark, d):
    e = named(spark, d).withColumn("canonical_name", F.concat_ws("|", "canonical_name", "node_type"))
    total = gr.matching_entities(e, name="BOLT").agg(F.count("*")).scalar()
    return gr.list_entities(e, name="BOLT", limit=20, offset=5).select(
        "entity_id", "node_type", F.split_part("canonical_name", F.lit("|"), F.lit(1)).alias("canonical_name"), "mention_count", total.alias("total"))


# Reviews of the pending mentions: by line, merged into the first supplier, made new, or rejected.
def _reviews(spark, d):
    li = dv.table(spark, d, "lineitem").filter("l_returnflag = 'N'")
    m = li.select(F.col("l_linenumber").alias("n"), F.explode(F.array(
        F.concat_ws("-", "l_orderkey", "l_linenumber", F.concat(F.lit("P"), "l_partkey")), F.concat_ws("-", "l_orderkey", "l_linenumber", F.concat(F.lit("S"), "l_suppkey")))).alias("mention_id"))
    act = F.when(F.col("n") == 1, "merge").when(F.col("n") == 2, "new").when(F.col("n") == 3, "reject")
    return m.filter("n <= 3").select("mention_id", act.alias("action"), F.when(F.col("n") == 1, "S0").alias("target_id")).distinct()


fragment("reviewed_mentions", """
  SELECT mention_id, snapshot_id, segment_id, node_type, mention_text,
    CASE WHEN pending AND n = 1 THEN 'S0' WHEN pending AND n = 2 THEN mention_text WHEN pending AND n = 3 THEN NULL ELSE canonical_name END AS entity_id,
    CASE WHEN pending AND n <= 2 THEN 'human' WHEN pending AND n = 3 THEN 'rejected' ELSE resolve_status END AS resolve_status, pending AND n <= 2 AS done
  FROM (SELECT *, split_part(mention_id, '-', 2)::INT AS n, mention_id IN (SELECT mention_id FROM mentions WHERE resolve_status = 'pending') AS pending FROM mentions)
""", ("mentions",))


def _review(spark, d):
    m = linked_mentions(spark, d).select("mention_id", "snapshot_id", "segment_id", "node_type", "mention_text", "entity_id", "resolve_status")
    return gr.review_mentions(m, _reviews(spark, d), all_entities(spark, d))


@query("b23_review_mentions", "SELECT mention_id, coalesce(entity_id, '') AS entity_id, resolve_status FROM reviewed_mentions", ("reviewed_mentions",))
def b23(spark, d):
    return _review(spark, d)[0].select("mention_id", F.coalesce("entity_id", F.lit("")).alias("entity_id"), "resolve_status")


@query("b23_reviews_folded", folded_sql("reviewed_mentions", "snapshot_id, resolve_status", "mention_id, coalesce(entity_id, ''), resolve_status"), ("reviewed_mentions",))
def b23c(spark, d):
    return folded(_review(spark, d)[0], ["snapshot_id", "resolve_status"], ["mention_id", F.coalesce("entity_id", F.lit("")), "resolve_status"])


@query("b23_review_counts", """
  SELECT a.entity_id, count(m.mention_id) AS mention_count, count(DISTINCT m.snapshot_id) AS document_count FROM all_entities a
  LEFT JOIN (SELECT * FROM reviewed_mentions WHERE resolve_status IN ('auto', 'human')) m USING (entity_id) GROUP BY 1
""", ("reviewed_mentions", "all_entities"))
def b23b(spark, d):
    return _review(spark, d)[1].select("entity_id", "mention_count", "document_count")


def _order_texts(spark, d):
    return dv.table(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("segment_text"))


@query("b24_pending_mentions", """
  SELECT mention_id, run_id, segment_id, coalesce(o_orderpriority || ' ' || o_orderstatus, '') AS segment_text
  FROM mentions JOIN run_snapshots USING (snapshot_id) LEFT JOIN orders ON segment_id = o_orderkey WHERE resolve_status = 'pending'
""", ("mentions", "run_snapshots"))
def b24(spark, d):
    p = gr.pending_mentions(dv.mentions(spark, d), _order_texts(spark, d), run_snapshots(spark, d))
    return p.select("mention_id", "run_id", "segment_id", F.coalesce("segment_text", F.lit("")).alias("segment_text"))


@query("b25_evidence_back_links", """
  SELECT canonical_name AS target_id, segment_id, o_orderpriority || ' ' || o_orderstatus AS segment_text FROM mentions JOIN orders ON segment_id = o_orderkey WHERE resolve_status = 'human'
""", ("mentions",))
def b25(spark, d):
    ev = dv.mentions(spark, d).select(F.col("canonical_name").alias("target_id"), "segment_id", F.when(F.col("resolve_status") == "human", "entity").otherwise("mention").alias("target_kind"))
    return gr.evidence_back_links(ev, _order_texts(spark, d), "entity").select("target_id", "segment_id", "segment_text")


# Type versions: a version per (brand, size group), the middle one active, the last one a draft.
fragment("versions", """
  SELECT domain, v AS version_no, CASE WHEN v = mx AND v > 1 THEN 'draft' WHEN v = mx - 1 OR mx = 1 THEN 'active' ELSE 'superseded' END AS status
  FROM (SELECT *, max(v) OVER (PARTITION BY domain) AS mx FROM (SELECT DISTINCT p_brand AS domain, p_size // 10 + 1 AS v FROM part))
""")
fragment("version_types", "SELECT DISTINCT p_brand AS domain, p_size // 10 + 1 AS version_no, p_type AS name FROM part")


def versions(spark, d):
    v = dv.table(spark, d, "part").select(F.col("p_brand").alias("domain"), (F.floor(F.col("p_size") / 10) + 1).alias("version_no")).distinct()
    mx = v.groupBy("domain").agg(F.max("version_no").alias("mx"))
    s = F.when((F.col("version_no") == F.col("mx")) & (F.col("mx") > 1), "draft").when(
        (F.col("version_no") == F.col("mx") - 1) | (F.col("mx") == 1), "active").otherwise("superseded")
    return v.join(mx, "domain").select("domain", "version_no", s.alias("status"))


def version_types(spark, d):
    return dv.table(spark, d, "part").select(
        F.col("p_brand").alias("domain"), (F.floor(F.col("p_size") / 10) + 1).alias("version_no"), F.col("p_type").alias("name")).distinct()


@query("b26_publish_draft", """
  WITH p AS (SELECT domain, version_no, CASE WHEN domain < 'Brand#2' AND status = 'draft' THEN 'active' WHEN domain < 'Brand#2' AND status = 'active'
      AND domain IN (SELECT domain FROM versions WHERE status = 'draft') THEN 'superseded' ELSE status END AS status FROM versions)
  SELECT domain, version_no, name FROM version_types JOIN p USING (domain, version_no) WHERE status = 'active'
""", ("versions", "version_types"))
def b26(spark, d):
    v = versions(spark, d)
    pub = gr.publish_drafts(v, v.filter("domain < 'Brand#2'").select("domain").distinct())
    return gr.active_types(version_types(spark, d), pub)


@query("b26_replace_draft", """
  SELECT domain, version_no, name FROM version_types WHERE (domain, version_no) NOT IN (SELECT domain, version_no FROM versions WHERE status = 'draft')
  UNION ALL SELECT domain, version_no, 'DRAFT' FROM versions WHERE status = 'draft'
""", ("versions", "version_types"))
def b26b(spark, d):
    drafts = versions(spark, d).filter("status = 'draft'").select("domain", "version_no")
    return gr.replace_draft(version_types(spark, d), drafts.withColumn("name", F.lit("DRAFT")), drafts)


@query("b26_next_versions", """
  SELECT domain, coalesce(max(CASE WHEN status = 'active' THEN version_no END), -1) AS active_version, coalesce(max(CASE WHEN status = 'draft' THEN version_no END), -1) AS draft_version,
    max(version_no) + 1 AS next_version FROM versions GROUP BY 1
""", ("versions",))
def b26c(spark, d):
    return gr.next_versions(versions(spark, d)).na.fill(-1, ["active_version", "draft_version"])


@query("b27_neighbourhood_nodes", """
  WITH e AS (SELECT seed_id, head_id AS entity_id FROM hood UNION SELECT seed_id, tail_id FROM hood)
  SELECT seed_id, entity_id, node_type, mention_count, document_count FROM e JOIN entities USING (entity_id)
""", ("hood", "entities"))
def b27(spark, d):
    e = gr.neighbourhood_edges(graph_seeds(spark, d), fact_edges(spark, d), 1)
    return gr.neighbourhood_nodes(e, dv.entities(spark, d)).select("seed_id", "entity_id", "node_type", "mention_count", "document_count")
