"""Catalog and operations queries Q01-Q21."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import catalog as ct
from tessella.operators import graph as gr
from tessella.plans import derived as dv
from tessella.plans.q_graph import DUP_SQL, _proposals, _types, reviewed
from tessella.plans.q_lifecycle import scope
from tessella.plans.registry import fragment, query

# Children of a snapshot (an order): its lines are segments, returned lines questions, open lines have vectors.
fragment("lines", """
  SELECT l_orderkey AS snapshot_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS segment_id, l_linenumber, l_linestatus, l_returnflag,
    CASE l_returnflag WHEN 'R' THEN 'generated_question' WHEN 'A' THEN 'entity_card' ELSE 'raw_text' END AS unit_type,
    CASE WHEN l_linestatus = 'O' THEN 'Q' || l_linenumber || ': part ' ELSE 'part ' END || l_partkey AS title, 'supplier ' || l_suppkey || repeat(' part ' || l_partkey, 40) AS text
  FROM lineitem
""")


def lines(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "generated_question").when(F.col("l_returnflag") == "A", "entity_card").otherwise("raw_text")
    lead = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("Q"), "l_linenumber", F.lit(": part "))).otherwise("part ")
    return dv.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("segment_id"),
        "l_linenumber", "l_linestatus", "l_returnflag", kind.alias("unit_type"), F.concat(lead, "l_partkey").alias("title"),
        F.concat(F.lit("supplier "), "l_suppkey", F.repeat(F.concat(F.lit(" part "), "l_partkey"), 40)).alias("text"))


SNAPS = "(SELECT DISTINCT domain, snapshot_id FROM scope)"


@query("q01_knowledge_stats", f"""
  SELECT domain, count(DISTINCT document_id) AS documents, count(DISTINCT snapshot_id) AS snapshots,
    (SELECT count(*) FROM lines JOIN {SNAPS} s USING (snapshot_id) WHERE s.domain = scope.domain) AS segments,
    (SELECT count(*) FROM lines JOIN {SNAPS} s USING (snapshot_id) WHERE s.domain = scope.domain AND l_linenumber > 1) AS relations,
    (SELECT count(*) FROM lines JOIN {SNAPS} s USING (snapshot_id) WHERE s.domain = scope.domain AND l_returnflag <> 'N') AS units,
    (SELECT count(*) FROM lines JOIN {SNAPS} s USING (snapshot_id) WHERE s.domain = scope.domain AND l_linestatus = 'O') AS embeddings
  FROM scope GROUP BY 1
""", ("scope", "lines"))
def q01(spark, d):
    k = lines(spark, d)
    return ct.knowledge_stats(scope(spark, d), k, k.filter("l_linenumber > 1"), k.filter("l_returnflag <> 'N'"), k.filter("l_linestatus = 'O'"))


@query("q01_unit_types", f"SELECT domain, unit_type, count(*) AS n FROM lines JOIN {SNAPS} USING (snapshot_id) GROUP BY 1, 2", ("scope", "lines"))
def q01b(spark, d):
    return ct.unit_type_distribution(scope(spark, d), lines(spark, d))


def documents(spark, d):
    return dv.links(spark, d).groupBy("domain", "document_id", "document_type").agg(F.min("linked_at").alias("created_at"))


fragment("docs", "SELECT domain, document_id, document_type, min(linked_at) AS created_at FROM links GROUP BY 1, 2, 3", ("links",))


@query("q02_document_list", """
  SELECT domain, document_id, source_batch_id, document_type FROM (SELECT DISTINCT domain, document_id, source_batch_id FROM scope WHERE source_batch_id = '5-LOW') JOIN docs USING (domain, document_id)
  WHERE document_type IN ('BUILDING', 'HOUSEHOLD') ORDER BY created_at DESC, document_id LIMIT 50 OFFSET 2
""", ("scope", "docs"))
def q02(spark, d):
    docs = documents(spark, d).filter("document_type IN ('BUILDING', 'HOUSEHOLD')")
    r = ct.document_list(scope(spark, d), docs, batch="5-LOW")
    return ct.page(r, [F.col("created_at").desc(), F.col("document_id")], 50, 2).select("domain", "document_id", "source_batch_id", "document_type")


@query("q03_batch_list", """
  WITH s AS (SELECT domain, document_id, CASE WHEN source_batch_id <> '5-LOW' THEN source_batch_id END AS b FROM scope),
  r AS (SELECT domain, batch_id AS b, arg_max(snapshot_id, {'a': linked_at, 's': snapshot_id}) AS run_id, min(linked_at) AS created_at FROM links GROUP BY 1, 2)
  SELECT s.domain, coalesce(s.b, '') AS source_batch_id, count(DISTINCT document_id) AS documents, coalesce(any_value(run_id), -1) AS run_id, s.b IS NULL AS unclassified
  FROM s LEFT JOIN r ON s.domain = r.domain AND s.b = r.b GROUP BY s.domain, s.b
""", ("scope", "links"))
def q03(spark, d):
    s = scope(spark, d).withColumn("source_batch_id", F.when(F.col("source_batch_id") != "5-LOW", F.col("source_batch_id")))
    k = dv.links(spark, d)
    b = k.groupBy("domain", F.col("batch_id").alias("source_batch_id")).agg(F.min("linked_at").alias("created_at"))
    runs = k.select("domain", F.col("batch_id").alias("source_batch_id"), F.col("snapshot_id").alias("run_id"), F.col("linked_at").alias("started_at"))
    return ct.batch_list(s, b, runs).select("domain", F.coalesce("source_batch_id", F.lit("")).alias("source_batch_id"), "documents",
                                            F.coalesce("run_id", F.lit(-1)).alias("run_id"), "unclassified")


@query("q04_document_detail", """
  SELECT s.domain, s.document_id, s.snapshot_id, strftime(max(k.linked_at), '%Y-%m-%d') AS linked_on FROM scope s LEFT JOIN links k
    ON s.document_id = k.document_id AND s.snapshot_id = k.snapshot_id AND s.source_batch_id IS NOT DISTINCT FROM k.batch_id GROUP BY 1, 2, 3
""", ("scope", "links"))
def q04(spark, d):
    return ct.document_detail(scope(spark, d), dv.links(spark, d)).select("domain", "document_id", "snapshot_id", F.date_format("linked_at", "yyyy-MM-dd").alias("linked_on"))


@query("q05_document_segments", f"""
  SELECT s.domain, document_id, snapshot_id, segment_id, unit_type, substr(text, 1, 200) AS preview FROM lines JOIN (SELECT DISTINCT domain, document_id, snapshot_id FROM scope) s USING (snapshot_id)
""", ("scope", "lines"))
def q05(spark, d):
    return ct.document_children(scope(spark, d), lines(spark, d)).select("domain", "document_id", "snapshot_id", "segment_id", "unit_type", "preview")


@query("q06_relation_list", """
  SELECT relation_id, relation_type, confidence, s.raw_text AS source_text, t.raw_text AS target_text FROM relations
  LEFT JOIN segments s ON source_id = s.segment_id LEFT JOIN segments t ON target_id = t.segment_id WHERE relation_type <> 'previous'
""", ("relations", "segments"))
def q06(spark, d):
    seg = dv.segments(spark, d).select("segment_id", F.col("raw_text").alias("text"))
    r = dv.relations(spark, d).filter("relation_type <> 'previous'")
    return ct.relation_list(r, seg).select("relation_id", "relation_type", "confidence", "source_text", "target_text")


fragment("runs", "SELECT run_id, count(*) AS total_documents, CASE WHEN count(*) FILTER (WHERE status = 'processing') > 35 THEN 'running' ELSE 'completed' END AS status FROM run_documents GROUP BY 1", ("run_documents",))


def runs(spark, d):
    return dv.run_documents(spark, d).groupBy("run_id").agg(
        F.count("*").alias("total_documents"), F.when(F.count_if(F.col("status") == "processing") > 35, "running").otherwise("completed").alias("status"))


@query("q07_run_list", "SELECT run_id, status, total_documents FROM runs ORDER BY run_id DESC LIMIT 10 OFFSET 3", ("runs",))
def q07(spark, d):
    return ct.page(runs(spark, d), [F.col("run_id").desc()], 10, 3).select("run_id", "status", "total_documents")


@query("q08_run_documents", """
  SELECT r.run_id, r.document_id, status, action, coalesce(error_message, '') AS error_message, current_stage, duration_ms FROM run_documents r
  JOIN (SELECT run_id, document_id, arg_max(stage, {'a': created_at, 'e': event_id}) AS current_stage, date_diff('millisecond', min(created_at), max(created_at)) AS d1,
     (epoch_us(max(created_at)) - epoch_us(min(created_at))) // 1000 AS duration_ms FROM stage_events GROUP BY 1, 2) e ON r.run_id = e.run_id AND r.document_id = e.document_id
""", ("run_documents", "stage_events"))
def q08(spark, d):
    return ct.run_document_report(dv.run_documents(spark, d), dv.stage_events(spark, d)).na.fill("", ["error_message"])


@query("q09_run_progress", """
  WITH o AS (SELECT e.run_id, e.stage, e.created_at FROM stage_events e WHERE status = 'started' AND NOT EXISTS (
      SELECT 1 FROM stage_events f WHERE f.run_id = e.run_id AND f.document_id = e.document_id AND f.stage = e.stage AND f.status IN ('completed', 'failed') AND f.created_at > e.created_at)),
  cur AS (SELECT run_id, arg_max(stage, {'a': created_at, 's': stage}) AS current_stage FROM o GROUP BY 1),
  c AS (SELECT run_id, count(*) FILTER (WHERE status = 'committed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'processing') AS processing FROM run_documents GROUP BY 1)
  SELECT run_id, completed, failed, processing, coalesce(current_stage, '') AS current_stage,
    CASE WHEN status = 'completed' THEN 100.0 ELSE least(round((completed + failed) / (total_documents + 4) * 100, 1), 99.9) END::DOUBLE AS progress_percent
  FROM runs JOIN c USING (run_id) LEFT JOIN cur USING (run_id)
""", ("stage_events", "run_documents", "runs"))
def q09(spark, d):
    p = ct.run_progress(dv.run_documents(spark, d), dv.stage_events(spark, d), runs(spark, d))
    return p.select("run_id", "completed", "failed", "processing", F.coalesce("current_stage", F.lit("")).alias("current_stage"), "progress_percent")


@query("q09_stage_summary", """
  SELECT run_id, stage, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'failed') AS failed FROM stage_events GROUP BY 1, 2
""", ("stage_events",))
def q09b(spark, d):
    return ct.stage_summary(dv.stage_events(spark, d))


@query("q10_artifact_counts", """
  SELECT o_orderkey AS snapshot_id, count(segment_id) AS segments, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS units, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS embeddings
  FROM orders LEFT JOIN lines ON o_orderkey = snapshot_id GROUP BY 1
""", ("lines",))
def q10(spark, d):
    k = lines(spark, d)
    o = dv.table(spark, d, "orders").select(F.col("o_orderkey").alias("snapshot_id"))
    return ct.artifact_counts(o, segments=k, units=k.filter("l_returnflag <> 'N'"), embeddings=k.filter("l_linestatus = 'O'"))


@query("q11_run_trace", """
  WITH r AS (SELECT DISTINCT p_brand AS domain FROM part), p AS (SELECT p_brand AS domain, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N' GROUP BY 1)
  SELECT 'run-' || domain AS run_id, domain, (SELECT count(*) FROM cand_reviewed c WHERE c.domain = r.domain AND status = 'proposed') AS proposed_candidates, coalesce(p.n, 0) AS pending_mentions,
    (SELECT count(*) FROM part WHERE p_brand = r.domain) AS entity_count, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = r.domain AND l_discount = 0) AS relation_count
  FROM r LEFT JOIN p USING (domain)
""", ("cand_reviewed",))
def q11(spark, d):
    part = dv.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("domain"))
    li = dv.table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_discount").join(part, F.col("l_partkey") == F.col("p_partkey"))
    r = part.select("domain").distinct().withColumn("run_id", F.concat(F.lit("run-"), "domain"))
    pend = li.filter("l_returnflag = 'N'").select(F.concat(F.lit("run-"), "domain").alias("run_id"))
    return ct.run_trace(r, reviewed(spark, d), pend, part.select("domain"), li.filter("l_discount = 0").select("domain")).select(
        "run_id", "domain", "proposed_candidates", "pending_mentions", "entity_count", "relation_count")


@query("q12_stage_timeline", """
  WITH e AS (SELECT *, lag(status) OVER w AS ps, lag(created_at) OVER w AS pc FROM stage_events WINDOW w AS (PARTITION BY run_id, document_id, stage ORDER BY created_at, event_id))
  SELECT event_id, run_id, document_id, stage, status, (epoch_us(created_at) - epoch_us(pc)) // 1000 AS duration_ms FROM e WHERE status <> 'started' AND ps = 'started'
""", ("stage_events",))
def q12(spark, d):
    return ct.stage_timeline(dv.stage_events(spark, d))


@query("q13_build_list", """
  SELECT r_regionkey AS build_id, r_name AS domain, (SELECT count(*) FROM parent_selections s WHERE s.domain = r_name AND selection_status = 'active') AS active_documents,
    CASE r_name WHEN 'ASIA' THEN '' ELSE 'prod' END AS channels FROM region
""", ("parent_selections",))
def q13(spark, d):
    from tessella.plans.q_lifecycle import release_table

    r = dv.table(spark, d, "region").select(F.col("r_regionkey").alias("build_id"), F.col("r_name").alias("domain"))
    sel = dv.parent_selections(spark, d).join(r, "domain").select("build_id", "selection_status")
    return ct.build_list(r, release_table(spark, d), sel)


@query("q13_release_list", """
  SELECT domain, release_id, build_id, channel, status, rank, total FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY activated_at DESC, release_id) AS rank, count(*) OVER (PARTITION BY domain) AS total FROM releases) WHERE rank > 1 AND rank <= 4
""", ("releases",))
def q13_releases(spark, d):
    from tessella.plans.q_lifecycle import releases

    return ct.release_list(releases(spark, d), limit=3, offset=1).select("domain", "release_id", "build_id", "channel", "status", "rank", "total")


@query("q13_active_release", """
  SELECT r_name AS domain, 'prod' AS channel, CASE r_name WHEN 'ASIA' THEN -1 ELSE r_regionkey + 100 END AS release_id, CASE r_name WHEN 'ASIA' THEN -1 ELSE r_regionkey END AS build_id FROM region
""")
def q13_active(spark, d):
    from tessella.plans.q_lifecycle import release_table

    wanted = dv.table(spark, d, "region").select(F.col("r_name").alias("domain"), F.lit("prod").alias("channel"))
    return ct.active_releases(release_table(spark, d), wanted).na.fill(-1, ["release_id", "build_id"])


@query("q13_build_detail", """
  SELECT r_regionkey AS build_id, r_name AS domain, coalesce(document_id, -1) AS document_id, coalesce(snapshot_id, -1) AS snapshot_id, coalesce(selection_status, '') AS selection_status, coalesce(reason, '') AS reason
  FROM region LEFT JOIN parent_selections s ON s.domain = r_name
""", ("parent_selections",))
def q13_detail(spark, d):
    r = dv.table(spark, d, "region").select(F.col("r_regionkey").alias("build_id"), F.col("r_name").alias("domain"))
    sel = dv.parent_selections(spark, d).join(r, "domain").drop("domain")
    return ct.build_detail(r, sel).na.fill(-1, ["document_id", "snapshot_id"]).na.fill("", ["selection_status", "reason"])


# Runs: a day's events of one type; failed at the last event means interrupted, started means it waits for review.
def _runs(spark, d):
    last = F.max_by("status", F.struct("created_at", "event_id"))
    return dv.stage_events(spark, d).groupBy("run_id", F.col("stage").alias("domain")).agg(F.min("created_at").alias("started_at"), last.alias("s")).select(
        "run_id", "domain", "started_at", F.when(F.col("s") == "failed", "interrupted").when(F.col("s") == "started", "awaiting_review").otherwise("completed").alias("status"))


@query("q19_waiting_runs", """
  WITH r AS (SELECT run_id, stage AS domain, min(created_at) AS started_at, arg_max(status, {'c': created_at, 'e': event_id}) AS s FROM stage_events GROUP BY 1, 2)
  SELECT CASE s WHEN 'failed' THEN 'interrupted' ELSE 'awaiting_review' END AS status, domain, run_id, row_number() OVER (PARTITION BY s, domain ORDER BY started_at, run_id) AS place
  FROM r WHERE s IN ('failed', 'started')
""", ("stage_events",))
def q19_waiting(spark, d):
    runs = _runs(spark, d)
    return ct.runs_in(runs, "interrupted").unionByName(ct.runs_in(runs, "awaiting_review")).select("status", "domain", "run_id", "place")


@query("q14_usage_overview", """
  SELECT (SELECT count(*) FROM llm_tasks) AS tasks, (SELECT round(count(*) FILTER (WHERE status = 'succeeded') / count(*), 4) FROM llm_tasks) AS success_rate,
    (SELECT count(*) FROM llm_tasks WHERE status = 'failed' AND created_at > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR) AS recent_failures,
    (SELECT string_agg(DISTINCT caller_service, ',' ORDER BY caller_service) FROM llm_tasks) AS services, (SELECT string_agg(DISTINCT knowledge_domain, ',' ORDER BY knowledge_domain) FROM llm_tasks) AS domains,
    (SELECT string_agg(DISTINCT pipeline_stage, ',' ORDER BY pipeline_stage) FROM llm_tasks) AS stages,
    count(*) FILTER (WHERE status = 'succeeded') AS succeeded_attempts, sum(total_tokens)::BIGINT AS total_tokens, round(avg(latency_ms), 1) AS avg_latency_ms FROM llm_attempts
""", ("llm_tasks", "llm_attempts"))
def q14(spark, d):
    now = dv.table(spark, d, "events").agg(F.max("ts")).scalar()
    return ct.usage_overview(dv.llm_tasks(spark, d), dv.llm_attempts(spark, d), now)


@query("q15_token_usage", """
  SELECT caller_service, knowledge_domain, pipeline_stage, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS attempt_count, round(avg(latency_ms), 4) AS avg_latency
  FROM llm_attempts JOIN (SELECT task_id, caller_service, knowledge_domain, pipeline_stage FROM llm_tasks) USING (task_id) GROUP BY 1, 2, 3
""", ("llm_tasks", "llm_attempts"))
def q15(spark, d):
    return ct.token_usage(dv.llm_tasks(spark, d), dv.llm_attempts(spark, d).select("task_id", "total_tokens", "latency_ms"), ["caller_service", "knowledge_domain", "pipeline_stage"])


@query("q16_task_list", """
  SELECT task_id, status, attempt_count, coalesce(total_tokens, -1) AS total_tokens, coalesce(latency_ms, -1) AS latency_ms FROM llm_tasks LEFT JOIN (
    SELECT task_id, total_tokens, latency_ms FROM llm_attempts WHERE status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt_no DESC) = 1) USING (task_id)
""", ("llm_tasks", "llm_attempts"))
def q16(spark, d):
    return ct.task_list(dv.llm_tasks(spark, d), dv.llm_attempts(spark, d)).na.fill(-1, ["total_tokens", "latency_ms"]).select(
        "task_id", "status", "attempt_count", "total_tokens", "latency_ms")


@query("q17_quality_summary", f"""
  WITH u AS (SELECT s.domain, count(*) AS units, count(*) FILTER (WHERE unit_type = 'generated_question') AS questions,
      count(*) FILTER (WHERE unit_type = 'generated_question' AND regexp_matches(title, '^Q\\d+\\s*[:：]')) AS prefixed, count(*) FILTER (WHERE l_linenumber > 6) AS rel FROM lines JOIN {SNAPS} s USING (snapshot_id) GROUP BY 1)
  SELECT domain, units, questions, prefixed, rel AS discourse_relations, concat_ws('; ', CASE WHEN questions = 0 THEN 'No generated_question units found' END,
    CASE WHEN prefixed > 0 THEN prefixed || ' question titles still have Qn prefix' END, CASE WHEN rel = 0 THEN 'No discourse relations found' END) AS warnings FROM u
""", ("scope", "lines"))
def q17(spark, d):
    k = lines(spark, d)
    return ct.quality_summary(scope(spark, d), k.select("snapshot_id", "unit_type", "title"), k.filter("l_linenumber > 6").select("snapshot_id"))


@query("q18_retry_state", """
  WITH t AS (SELECT task_id, CASE WHEN status = 'failed' THEN 'failed' WHEN attempt_count = 1 THEN 'running' ELSE status END AS status, attempt_count, created_at + to_hours(attempt_count::INT) AS lease FROM llm_tasks)
  SELECT task_id, CASE WHEN status = 'running' THEN 'lease_expired' ELSE 'error' END AS cause, attempt_count + 1 AS attempt_count, CASE WHEN attempt_count + 1 < 3 THEN 'queued' ELSE 'dead_letter' END AS next_status,
    CASE WHEN attempt_count + 1 < 3 THEN least(pow(2, attempt_count + 1), 60) ELSE 0 END::INT AS backoff_seconds
  FROM t WHERE status = 'failed' OR (status = 'running' AND lease < TIMESTAMP '2024-01-20')
""", ("llm_tasks",))
def q18(spark, d):
    s = F.when(F.col("status") == "failed", "failed").when(F.col("attempt_count") == 1, "running").otherwise(F.col("status"))
    t = dv.llm_tasks(spark, d).select("task_id", s.alias("status"), "attempt_count", F.lit(3).alias("max_attempts"),
                                      F.expr("created_at + make_dt_interval(0, cast(attempt_count as int))").alias("lease_expires_at"))
    return ct.retry_state(t, F.lit("2024-01-20").cast("timestamp"))


@query("q19_latest_links", """
  SELECT document_id, snapshot_id, batch_id FROM links QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY linked_at DESC, snapshot_id DESC) = 1
""", ("links",))
def q19(spark, d):
    return ct.latest(dv.links(spark, d).select("document_id", "snapshot_id", "batch_id", "linked_at"), ["document_id"], "linked_at", "snapshot_id").drop("linked_at")


@query("q19_latest_stage_status", """
  SELECT run_id, document_id, stage, status FROM stage_events QUALIFY row_number() OVER (PARTITION BY run_id, document_id, stage ORDER BY created_at DESC, event_id DESC) = 1
""", ("stage_events",))
def q19b(spark, d):
    e = dv.stage_events(spark, d).select("run_id", "document_id", "stage", "status", "created_at", "event_id")
    return ct.latest(e, ["run_id", "document_id", "stage"], "created_at", "event_id").select("run_id", "document_id", "stage", "status")


@query("q20_template_lookup", """
  WITH t AS (SELECT p_type AS template_key, CASE WHEN p_size < 25 THEN p_brand END AS domain, p_size, p_partkey AS version FROM part WHERE p_size <> 7),
  req AS (SELECT DISTINCT a.p_type AS template_key, b.p_brand AS domain FROM part a, part b),
  own AS (SELECT template_key, domain, arg_max(version, {'s': p_size, 'v': version}) AS own FROM t WHERE domain IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT template_key, arg_max(version, {'s': p_size, 'v': version}) AS shared FROM t WHERE domain IS NULL GROUP BY 1)
  SELECT template_key, domain, coalesce(own, shared, -1) AS version, own IS NOT NULL AS overridden FROM req LEFT JOIN own USING (template_key, domain) LEFT JOIN g USING (template_key)
""")
def q20(spark, d):
    p = dv.table(spark, d, "part")
    t = p.select(F.col("p_type").alias("template_key"), F.when(F.col("p_size") < 25, F.col("p_brand")).alias("domain"),
                 F.when(F.col("p_size") == 7, "archived").otherwise("active").alias("status"), F.col("p_size").alias("created_at"), F.col("p_partkey").alias("version"))
    brands = p.agg(F.collect_set("p_brand")).scalar()
    req = p.select(F.col("p_type").alias("template_key")).distinct().select("template_key", F.explode(brands).alias("domain"))
    return ct.template_lookup(req, t).na.fill(-1, ["version"])


@query("q21_candidate_review_list", f"""
  WITH c AS (SELECT DISTINCT proposed_name FROM proposals), dup AS ({DUP_SQL}),
  m AS (SELECT proposed_name, name AS entity_id FROM c JOIN (SELECT DISTINCT p_type AS name FROM part) ON contains(lower(proposed_name), lower(name))),
  qt AS (SELECT p_type AS entity_id, arg_min(p_name, {{'l': length(p_name), 'k': p_partkey}}) AS quote FROM part GROUP BY 1)
  SELECT proposed_name, coalesce(duplicate_of, '') AS duplicate_of, coalesce(entity_id, '') AS entity_id, coalesce(quote, '') AS quote
  FROM c LEFT JOIN dup USING (proposed_name) LEFT JOIN m USING (proposed_name) LEFT JOIN qt USING (entity_id)
""", ("proposals", "type_list"))
def q21(spark, d):
    p = dv.table(spark, d, "part")
    names = p.agg(F.collect_set("p_type")).scalar()
    q = _proposals(spark, d)
    hits = q.select("proposed_name", F.explode(names).alias("name")).filter(F.contains(F.lower("proposed_name"), F.lower("name"))).groupBy(
        "proposed_name").agg(F.collect_set("name").alias("members"))
    c = q.join(hits, "proposed_name", "left").select("proposed_name", F.lit("node_type").alias("kind"), F.lit(1).alias("score"), "members")
    quotes = p.groupBy(F.col("p_type").alias("entity_id")).agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_partkey")).alias("quote"))
    dup = gr.duplicate_types(_proposals(spark, d), _types(spark, d))
    return ct.candidate_review_list(c, dup, quotes).na.fill("", ["duplicate_of", "entity_id", "quote"]).select("proposed_name", "duplicate_of", "entity_id", "quote")
