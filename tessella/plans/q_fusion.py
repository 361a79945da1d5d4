"""Fusion and reranking queries F01-F14 over the route candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import fusion as fu
from tessella.plans import derived as dv
from tessella.plans.q_retrieval import candidates, lexical
from tessella.plans.registry import fragment, query
from tessella.session import cut_lineage


@query("f01_identity_fusion", """
  SELECT query_id, unit_id, max(score) AS fusion_score, arg_max(route, {'s': score, 'r': route}) AS route FROM candidates GROUP BY 1, 2
""", ("candidates",))
def f01(spark, d):
    return fu.identity(candidates(spark, d))


@query("f02_rrf", """
  SELECT query_id, unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score, max(score) AS raw_score FROM candidates GROUP BY 1, 2
""", ("candidates",))
def f02(spark, d):
    return fu.rrf(candidates(spark, d)).drop("route_sources")


fragment("fused", """
  SELECT query_id, unit_id, round(sum(weight / (60 + rank)), 9) AS score, max(score) AS raw_score,
    string_agg(route, ',' ORDER BY route) AS routes
  FROM candidates GROUP BY 1, 2
""", ("candidates",))


def fused(spark, d):
    return fu.rrf(candidates(spark, d), weighted=True).select(
        "query_id", "unit_id", F.col("fusion_score").alias("score"), "raw_score", F.array_join("route_sources", ",").alias("routes"))


@query("f03_weighted_rrf", "SELECT * FROM fused", ("fused",))
def f03(spark, d):
    return fused(spark, d)


@query("f04_score_rerank", """
  SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank
  FROM fused WHERE score >= 0.013
""", ("fused",))
def f04(spark, d):
    return fu.score_rerank(fused(spark, d).select("query_id", "unit_id", "score"), 0.013)


# Ranked list with text, and model outputs derived from it: the model scores raw text by length and
# answers only questions of even length; rankings list headings last, with a bad and a repeated index.
fragment("ranked_list", """
  SELECT query_id, unit_id, fused.score, text, unit_type, units.segment_id, length(query) AS q_len, query,
    row_number() OVER (PARTITION BY query_id ORDER BY fused.score DESC, unit_id) AS rank
  FROM fused JOIN units USING (unit_id) JOIN questions USING (query_id)
""", ("fused", "units", "questions"))
fragment("model_scores", """
  SELECT query_id, unit_id, round(1.0::DOUBLE / (1 + length(text)), 9) AS model_score FROM ranked_list
  WHERE q_len >= 200 AND unit_type = 'raw_text'
""", ("ranked_list",))


def ranked_list(spark, d):
    f = cut_lineage(fused(spark, d).select("query_id", "unit_id", "score"))
    u = dv.units(spark, d, f.select("unit_id")).select("unit_id", "text", "unit_type", "segment_id")
    q = dv.questions(spark, d).select("query_id", F.length("query").alias("q_len"))
    return fu.ranked(f.join(u, "unit_id").join(q, "query_id"),
                     [F.col("score").desc(), F.col("unit_id")])


def model_scores(ranked):
    return ranked.filter((F.col("q_len") >= 200) & (F.col("unit_type") == "raw_text")).select(
        "query_id", "unit_id", F.round(1.0 / (1 + F.length("text")), 9).alias("model_score"))


@query("f05_model_scores", """
  SELECT query_id, unit_id, coalesce(model_score, score) AS score, model_score IS NOT NULL AS scored,
    row_number() OVER (PARTITION BY query_id ORDER BY model_score IS NOT NULL DESC, model_score DESC NULLS LAST, rank) AS rank
  FROM ranked_list LEFT JOIN model_scores USING (query_id, unit_id)
""", ("ranked_list", "model_scores"))
def f05(spark, d):
    r = cut_lineage(ranked_list(spark, d))
    return fu.apply_model_scores(r, model_scores(r))


def rankings(ranked):
    """A ranking per question: last five of the window first, then index 0 twice and one out of range."""
    r = ranked.groupBy("query_id").agg(F.least(F.count("*"), F.lit(20)).cast("int").alias("n"))
    idx = F.concat(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("n") - i), F.array(F.lit(0), F.lit(0), F.lit(999)))
    entry = F.transform(idx, lambda i: F.struct(i.alias("index"), (1.0 / (2 + F.abs(i))).alias("score")))
    return r.select("query_id", entry.alias("ranking"))


fragment("ranking_entries", """
  WITH n AS (SELECT query_id, least(count(*), 20) AS n FROM ranked_list GROUP BY 1),
  e AS (SELECT query_id, n, unnest([n - 1, n - 2, n - 3, n - 4, n - 5, 0, 0, 999]) AS idx, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos FROM n)
  SELECT query_id, idx, min(pos) AS pos, 1.0::DOUBLE / (2 + abs(idx)) AS new_score FROM e WHERE idx >= 0 AND idx < n GROUP BY 1, 2
""", ("ranked_list",))


@query("f06_llm_ranking", """
  SELECT l.query_id, unit_id, coalesce(new_score, score) AS score, pos IS NOT NULL AS ranked,
    row_number() OVER (PARTITION BY l.query_id ORDER BY pos IS NULL, pos, rank) AS rank
  FROM ranked_list l LEFT JOIN ranking_entries e ON l.query_id = e.query_id AND idx = rank - 1
""", ("ranked_list", "ranking_entries"))
def f06(spark, d):
    r = cut_lineage(ranked_list(spark, d))
    return fu.apply_ranking(r, rankings(r))


@query("f07_rerank_cascade", """
  WITH m AS (
    SELECT query_id, unit_id, coalesce(model_score, score) AS score, 'model' AS tier,
      row_number() OVER (PARTITION BY query_id ORDER BY model_score IS NOT NULL DESC, model_score DESC NULLS LAST, rank) AS rank
    FROM ranked_list LEFT JOIN model_scores USING (query_id, unit_id)
    WHERE query_id IN (SELECT query_id FROM model_scores)),
  l AS (
    SELECT l.query_id, unit_id, coalesce(new_score, score) AS score, 'llm' AS tier,
      row_number() OVER (PARTITION BY l.query_id ORDER BY pos IS NULL, pos, rank) AS rank
    FROM ranked_list l LEFT JOIN ranking_entries e ON l.query_id = e.query_id AND idx = rank - 1
    WHERE l.query_id NOT IN (SELECT query_id FROM m) AND q_len >= 120),
  s AS (SELECT query_id, unit_id, score, 'score' AS tier, rank FROM ranked_list
    WHERE query_id NOT IN (SELECT query_id FROM m UNION ALL SELECT query_id FROM l))
  SELECT * FROM m UNION ALL SELECT * FROM l UNION ALL SELECT * FROM s
""", ("ranked_list", "model_scores", "ranking_entries"))
def f07(spark, d):
    r = cut_lineage(ranked_list(spark, d))
    methods = dv.questions(spark, d).select(
        "query_id", F.when(F.length("query") >= 120, "cascade").otherwise("score").alias("method"))
    return fu.rerank_cascade(r, model_scores(r), rankings(r), methods)


# Two units of one segment compete: the second half of the list points at its predecessor's segment.
@query("f08_best_per_segment", """
  WITH c AS (SELECT query_id, unit_id, score, CASE WHEN unit_type = 'heading' THEN NULL ELSE split_part(segment_id, '#', 1) END AS segment_id
             FROM ranked_list)
  SELECT * FROM c WHERE segment_id IS NULL
  UNION ALL (SELECT * FROM c WHERE segment_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY query_id, segment_id ORDER BY score DESC, unit_id) = 1)
""", ("ranked_list",))
def f08(spark, d):
    c = ranked_list(spark, d).select("query_id", "unit_id", "score", F.when(
        F.col("unit_type") != "heading", F.split_part("segment_id", F.lit("#"), F.lit(1))).alias("segment_id"))
    return fu.best_per_segment(c)


@query("f09_downweight_types", """
  SELECT query_id, unit_id, unit_type, CASE WHEN unit_type = 'heading' THEN score * 0.5 ELSE score END AS score FROM ranked_list
""", ("ranked_list",))
def f09(spark, d):
    return fu.downweight(ranked_list(spark, d).select("query_id", "unit_id", "unit_type", "score"))


@query("f10_drop_similar_texts", r"""
  SELECT query_id, unit_id, score FROM (
    WITH RECURSIVE l AS MATERIALIZED (
      SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS n,
        list_distinct(list_transform(range(1, greatest(length(t), 1)), lambda i: substr(t, i::INT, 2))) AS g
      FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM ranked_list)),
    met AS MATERIALIZED (SELECT x.query_id, x.n, y.n AS m, len(x.g) + len(y.g) AS size, len(list_intersect(x.g, y.g)) AS shared
             FROM l x JOIN l y ON x.query_id = y.query_id AND y.n < x.n AND len(y.g) >= 0.9 * len(x.g) AND len(x.g) >= 0.9 * len(y.g)),
    near AS MATERIALIZED (SELECT query_id, n, list(m) AS earlier FROM met WHERE shared > 0 AND shared / (size - shared) > 0.9 GROUP BY 1, 2),
    step AS (SELECT query_id, 1::BIGINT AS n, [1::BIGINT] AS kept FROM l WHERE n = 1
      UNION ALL SELECT l.query_id, l.n, CASE WHEN list_has_any(kept, coalesce(earlier, []::BIGINT[])) THEN kept ELSE list_append(kept, l.n) END
      FROM step JOIN l ON l.query_id = step.query_id AND l.n = step.n + 1 LEFT JOIN near ON near.query_id = l.query_id AND near.n = l.n),
    done AS (SELECT query_id, arg_max(kept, n) AS kept FROM step GROUP BY 1)
    SELECT l.query_id, unit_id, score FROM l JOIN done ON l.query_id = done.query_id AND list_contains(kept, l.n))
""", ("ranked_list",))
def f10(spark, d):
    return fu.drop_similar_texts(ranked_list(spark, d)).select("query_id", "unit_id", "score")


@query("f11_score_chain", """
  SELECT query_id, unit_id, raw_score, score AS fusion_score, CASE WHEN unit_type = 'heading' THEN score * 0.5 ELSE score END AS rerank_score, routes AS route_sources
  FROM fused JOIN units USING (unit_id)
""", ("fused", "units"))
def f11(spark, d):
    c = fused(spark, d).withColumn("fusion", F.col("score")).join(dv.units(spark, d).select("unit_id", "unit_type"), "unit_id")
    chain = fu.score_chain(F.col("raw_score"), F.col("fusion"), F.col("score"), F.col("routes"))
    return fu.downweight(c).select("query_id", "unit_id", chain.alias("c")).select("query_id", "unit_id", "c.*")


fragment("final_list", """
  SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM fused
  WHERE score >= 0.01 QUALIFY rank <= 10
""", ("fused",))


def final_list(spark, d):
    return fu.cut(fused(spark, d).select("query_id", "unit_id", "score"), 10)


@query("f12_min_score_max_items", "SELECT * FROM final_list", ("final_list",))
def f12(spark, d):
    return final_list(spark, d)


@query("f13_rerank_batches", r"""
  SELECT * FROM (
    WITH RECURSIVE l AS MATERIALIZED (
      SELECT query_id, rank, unit_id, substr(text, 1, 4096) AS document, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n
      FROM lexical JOIN units USING (unit_id) WHERE regexp_matches(text, '\S')),
    step AS (SELECT query_id, n, 0 AS batch_id, 1 AS docs, length(document) AS chars FROM l WHERE n = 1
      UNION ALL SELECT l.query_id, l.n, batch_id + CASE WHEN closed THEN 1 ELSE 0 END, CASE WHEN closed THEN 1 ELSE docs + 1 END, CASE WHEN closed THEN length(document) ELSE chars + length(document) END
      FROM (SELECT step.*, l.n AS m, docs + 1 > 128 OR chars + length(l.document) > 28000 AS closed FROM step JOIN l ON l.query_id = step.query_id AND l.n = step.n + 1) s
      JOIN l ON l.query_id = s.query_id AND l.n = s.m)
    SELECT query_id, batch_id, rank, unit_id, document FROM l JOIN step USING (query_id, n))
""", ("lexical", "units"))
def f13(spark, d):
    c = cut_lineage(lexical(spark, d))
    return fu.rerank_batches(c.join(dv.units(spark, d, c.select("unit_id")).select("unit_id", "text"), "unit_id"))


@query("f14_collect_terminal", "SELECT query_id, unit_id, score, rank FROM ranked_list WHERE rank <= 20", ("ranked_list",))
def f14(spark, d):
    return fu.collect_terminal(ranked_list(spark, d)).select("query_id", "unit_id", "score", "rank")
