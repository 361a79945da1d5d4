"""Lifecycle queries L01-L15 on builds of customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import lifecycle as lc
from tessella.plans import derived as dv
from tessella.plans.q_graph import reviewed
from tessella.plans.registry import fragment, query

# Content of a snapshot is the order's price band, so different orders can carry the same content.


def linked(spark, d):
    return dv.links(spark, d).withColumn("content_hash", F.sha2(F.floor(F.col("content") / 20000).cast("string"), 256))


fragment("linked_docs", "SELECT *, sha256(floor(content / 20000)::BIGINT::VARCHAR) AS content_hash FROM links", ("links",))
# Incoming documents: every customer with the content of the latest order overall; snapshots complete when lines exist.
fragment("incoming", """
  SELECT r_name AS domain, c_custkey AS document_id, coalesce(l.content_hash, 'none') AS content_hash
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT document_id, content_hash FROM linked_docs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY linked_at DESC, snapshot_id DESC) = 1) l ON document_id = c_custkey
""", ("linked_docs",))
fragment("complete", "SELECT DISTINCT l_orderkey AS snapshot_id FROM lineitem WHERE l_returnflag <> 'N'")


def incoming(spark, d):
    c = dv.table(spark, d, "customer").join(dv.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        dv.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("domain"), F.col("c_custkey").alias("document_id"))
    last = linked(spark, d).groupBy("document_id").agg(F.max_by("content_hash", F.struct("linked_at", "snapshot_id")).alias("content_hash"))
    return c.join(last, "document_id", "left").withColumn("content_hash", F.coalesce("content_hash", F.lit("none")))


fragment("state", f"""
  WITH past AS (SELECT * FROM linked_docs WHERE linked_at < TIMESTAMP '{dv.PARENT_UNTIL}'),
  hist AS (SELECT i.document_id, p.snapshot_id, p.content_hash FROM incoming i JOIN past p ON i.document_id = p.document_id AND i.content_hash = p.content_hash
           QUALIFY row_number() OVER (PARTITION BY i.document_id ORDER BY linked_at DESC, p.snapshot_id DESC) = 1),
  act AS (SELECT s.document_id, s.snapshot_id, l.content_hash FROM parent_selections s JOIN linked_docs l ON s.snapshot_id = l.snapshot_id WHERE selection_status = 'active')
  SELECT i.domain, i.document_id, i.content_hash, i.document_id IN (SELECT document_id FROM past) AS known, h.snapshot_id AS historical_snapshot, h.content_hash AS historical_hash,
    h.snapshot_id IN (SELECT snapshot_id FROM complete) AS historical_complete, a.snapshot_id AS active_snapshot, a.content_hash AS active_hash, a.snapshot_id IN (SELECT snapshot_id FROM complete) AS active_complete
  FROM incoming i LEFT JOIN hist h USING (document_id) LEFT JOIN act a USING (document_id)
""", ("linked_docs", "incoming", "parent_selections", "complete"))


def state(spark, d):
    k = linked(spark, d)
    past = k.filter(F.col("linked_at") < F.lit(dv.PARENT_UNTIL).cast("timestamp")).select("domain", "document_id", "snapshot_id", "content_hash", "linked_at")
    act = dv.parent_selections(spark, d).filter("selection_status = 'active'").select("domain", "document_id", "snapshot_id").join(
        k.select("snapshot_id", "content_hash"), "snapshot_id")
    done = dv.table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("snapshot_id"))
    return lc.lifecycle_state(incoming(spark, d), past, act, done)


@query("l01_lifecycle_action", """
  SELECT domain, document_id, CASE WHEN NOT known THEN 'NEW' WHEN active_hash = content_hash AND active_complete THEN 'SKIP'
    WHEN active_hash IS NULL AND historical_hash = content_hash AND historical_complete THEN 'RESTORE' ELSE 'UPDATE' END AS action FROM state
""", ("state",))
def l01(spark, d):
    return lc.decide(state(spark, d)).select("domain", "document_id", "action")


@query("l02_lifecycle_state", """
  SELECT domain, document_id, known, coalesce(historical_snapshot, -1) AS historical_snapshot, coalesce(historical_complete, false) AS historical_complete,
    coalesce(active_snapshot, -1) AS active_snapshot, coalesce(active_complete, false) AS active_complete FROM state
""", ("state",))
def l02(spark, d):
    s = state(spark, d).na.fill(-1, ["historical_snapshot", "active_snapshot"])
    return s.select("domain", "document_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("known", "historical_complete", "active_complete")],
                    "historical_snapshot", "active_snapshot")


fragment("classified", """
  WITH p AS (SELECT * FROM parent_selections WHERE selection_status = 'active')
  SELECT coalesce(n.domain, p.domain) AS domain, coalesce(n.document_id, p.document_id) AS document_id, coalesce(n.snapshot_id, p.snapshot_id) AS snapshot_id,
    CASE WHEN n.snapshot_id IS NULL THEN 'REMOVE' WHEN p.snapshot_id IS NULL THEN 'NEW' WHEN n.snapshot_id = p.snapshot_id THEN 'SKIP' ELSE 'UPDATE' END AS action,
    CASE WHEN n.snapshot_id IS NULL THEN 'remove' WHEN p.snapshot_id IS NULL THEN 'add' WHEN n.snapshot_id = p.snapshot_id THEN 'retain' ELSE 'update' END AS reason,
    CASE WHEN n.snapshot_id IS NULL THEN 'removed' ELSE 'active' END AS selection_status
  FROM run_decisions n FULL OUTER JOIN p ON n.domain = p.domain AND n.document_id = p.document_id
""", ("run_decisions", "parent_selections"))


def classified(spark, d, detect_remove=True):
    return lc.classify(dv.run_decisions(spark, d), dv.parent_selections(spark, d), detect_remove)


@query("l03_classify_documents", "SELECT * FROM classified", ("classified",))
def l03(spark, d):
    return classified(spark, d)


fragment("build", """
  SELECT domain, document_id, snapshot_id, source_batch_id, selection_status, reason, 'carried' AS origin FROM parent_selections
  WHERE (domain, document_id) NOT IN (SELECT domain, document_id FROM classified WHERE action <> 'REMOVE')
  UNION ALL SELECT c.domain, c.document_id, c.snapshot_id, CASE WHEN c.action = 'SKIP' THEN p.source_batch_id ELSE 'B2' END, c.selection_status, c.reason, 'decided'
  FROM classified c LEFT JOIN parent_selections p ON c.domain = p.domain AND c.document_id = p.document_id WHERE c.action <> 'REMOVE'
""", ("classified", "parent_selections"))


def build(spark, d):
    return lc.assemble_build(classified(spark, d, False), dv.parent_selections(spark, d), "B2")


@query("l04_assemble_build", "SELECT * FROM build", ("build",))
def l04(spark, d):
    return build(spark, d)


@query("l04_action_counts", "SELECT domain, action, count(*) AS n FROM classified GROUP BY 1, 2", ("classified",))
def l04b(spark, d):
    return lc.action_counts(classified(spark, d))


# Builds under validation: one per region; AFRICA lost its parent, ASIA is emptied by a withdrawal.
@query("l05_validate_build", """
  SELECT domain, 'no_segments' AS violation, snapshot_id FROM build WHERE selection_status = 'active' AND domain NOT IN ('ASIA', 'EUROPE') AND snapshot_id NOT IN (SELECT snapshot_id FROM complete)
  UNION ALL SELECT 'EUROPE', 'no_active_snapshot', -1 UNION ALL SELECT 'AFRICA', 'missing_parent', -1
""", ("build", "complete"))
def l05(spark, d):
    r = dv.table(spark, d, "region").select(
        F.col("r_name").alias("domain"), (F.col("r_regionkey") + 100).cast("bigint").alias("build_id"), F.lit("incremental").alias("build_mode"),
        F.when(F.col("r_name") == "AFRICA", 999).when(F.col("r_name") != "EUROPE", 100).cast("bigint").alias("parent_id"),
        F.when(F.col("r_name") == "ASIA", "withdrawal").alias("operation"))
    sel = build(spark, d).filter("domain NOT IN ('ASIA', 'EUROPE')")
    done = dv.table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("snapshot_id"))
    return lc.build_violations(r, sel, done).na.fill(-1, ["snapshot_id"])


# Releases: per (domain, channel) the parents' latest batch release is active; the run publishes some channels anew.
fragment("releases", """
  SELECT document_id * 10 AS release_id, document_id AS build_id, domain, batch_id AS channel, 'active' AS status, CAST(NULL AS BIGINT) AS previous_release_id, linked_at AS activated_at
  FROM (SELECT * FROM links WHERE linked_at < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY domain, batch_id ORDER BY linked_at DESC, snapshot_id DESC) = 1)
""", ("links",))
fragment("new_releases", """
  SELECT snapshot_id * 10 + 1 AS release_id, document_id AS build_id, domain, batch_id AS channel, linked_at AS activated_at FROM links
  WHERE linked_at >= TIMESTAMP '1998-01-01'
""", ("links",))
fragment("published", """
  WITH w AS (SELECT domain, channel, arg_max(release_id, {'a': activated_at, 'r': release_id}) AS winner FROM new_releases GROUP BY 1, 2)
  SELECT r.release_id, build_id, r.domain, r.channel, CASE WHEN winner IS NOT NULL THEN 'retired' ELSE status END AS status, -1 AS previous_release_id FROM releases r LEFT JOIN w ON r.domain = w.domain AND r.channel = w.channel
  UNION ALL SELECT n.release_id, n.build_id, n.domain, n.channel, CASE WHEN n.release_id = winner THEN 'active' ELSE 'retired' END, coalesce(r.release_id, -1)
  FROM new_releases n JOIN w ON n.domain = w.domain AND n.channel = w.channel LEFT JOIN releases r ON n.domain = r.domain AND n.channel = r.channel
""", ("releases", "new_releases"))


def releases(spark, d):
    k = dv.links(spark, d).filter(F.col("linked_at") < F.lit("1998-01-01").cast("timestamp"))
    return k.groupBy("domain", F.col("batch_id").alias("channel")).agg(
        F.max_by(F.struct("document_id", "linked_at"), F.struct("linked_at", "snapshot_id")).alias("b")).select(
        (F.col("b.document_id") * 10).alias("release_id"), F.col("b.document_id").alias("build_id"), "domain", "channel", F.lit("active").alias("status"),
        F.lit(None).cast("bigint").alias("previous_release_id"), F.col("b.linked_at").alias("activated_at"))


def published(spark, d):
    new = dv.links(spark, d).filter(F.col("linked_at") >= F.lit("1998-01-01").cast("timestamp")).select(
        (F.col("snapshot_id") * 10 + 1).alias("release_id"), F.col("document_id").alias("build_id"), "domain", F.col("batch_id").alias("channel"), F.col("linked_at").alias("activated_at"))
    return lc.publish(releases(spark, d), new)


@query("l06_publish_release", "SELECT * FROM published", ("published",))
def l06(spark, d):
    return published(spark, d).select("release_id", "build_id", "domain", "channel", "status", F.coalesce("previous_release_id", F.lit(-1)).alias("previous_release_id"))


@query("l06_duplicate_active", """
  SELECT domain, channel, count(*) AS n FROM (SELECT domain, batch_id AS channel FROM links WHERE order_status = 'F') GROUP BY 1, 2 HAVING count(*) > 1
""", ("links",))
def l06b(spark, d):
    r = dv.links(spark, d).select("domain", F.col("batch_id").alias("channel"), F.when(F.col("order_status") == "F", "active").otherwise("retired").alias("status"))
    return lc.duplicate_active(r)


@query("l07_withdraw_documents", """
  SELECT domain, document_id, snapshot_id, source_batch_id, CASE WHEN hit THEN 'removed' ELSE selection_status END AS selection_status, CASE WHEN hit THEN 'remove' ELSE reason END AS reason
  FROM (SELECT *, selection_status = 'active' AND document_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS hit FROM parent_selections)
""", ("parent_selections",))
def l07(spark, d):
    p = dv.parent_selections(spark, d).drop("document_type")
    bad = dv.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("document_id"))
    return lc.withdraw(p, documents=p.select("domain", "document_id").join(bad, "document_id", "left_semi").select("domain", "document_id"))


@query("l07_withdraw_batch", """
  SELECT domain, document_id, snapshot_id, source_batch_id, CASE WHEN hit THEN 'removed' ELSE selection_status END AS selection_status, CASE WHEN hit THEN 'remove' ELSE reason END AS reason
  FROM (SELECT *, selection_status = 'active' AND source_batch_id = '5-LOW' AS hit FROM parent_selections)
""", ("parent_selections",))
def l07b(spark, d):
    p = dv.parent_selections(spark, d).drop("document_type")
    b = dv.table(spark, d, "region").select(F.col("r_name").alias("domain"), F.lit("5-LOW").alias("source_batch_id"))
    return lc.withdraw(p, batches=b)


# Scope: one build per region; documents and snapshots exist in their domain unless the order is still open.
fragment("scope", """
  SELECT 100 + r_regionkey AS release_id, r_regionkey AS build_id, s.domain, 'prod' AS channel, document_id, snapshot_id, source_batch_id
  FROM parent_selections s JOIN region ON r_name = domain WHERE selection_status = 'active'
    AND snapshot_id IN (SELECT snapshot_id FROM links WHERE order_status = 'F') AND r_name NOT IN ('ASIA')
""", ("parent_selections", "links"))


def release_table(spark, d):
    r = dv.table(spark, d, "region")
    one = r.select((F.col("r_regionkey") + 100).alias("release_id"), F.col("r_regionkey").alias("build_id"), F.col("r_name").alias("domain"), F.lit("prod").alias("channel"),
                   F.when(F.col("r_name") == "ASIA", "retired").otherwise("active").alias("status"))
    two = r.filter("r_name = 'EUROPE'").select((F.col("r_regionkey") + 200).alias("release_id"), F.lit(-1).alias("build_id"), F.col("r_name").alias("domain"), F.lit("prod").alias("channel"), F.lit("active").alias("status"))
    return one.unionByName(two)


def scope(spark, d):
    r = dv.table(spark, d, "region").select(F.col("r_name").alias("domain"), F.col("r_regionkey").alias("build_id"))
    sel = dv.parent_selections(spark, d).join(r, "domain").select("build_id", "document_id", "snapshot_id", "source_batch_id", "selection_status")
    k = dv.links(spark, d)
    return lc.active_scope(release_table(spark, d), sel, k.select("domain", "document_id").distinct(), k.filter("order_status = 'F'").select("domain", "snapshot_id"), "prod")


@query("l08_active_scope", "SELECT * FROM scope", ("scope",))
def l08(spark, d):
    return scope(spark, d)


@query("l08_scope_errors", """
  WITH r AS (SELECT r_name AS domain, CASE r_name WHEN 'ASIA' THEN 'retired' ELSE 'active' END AS status FROM region UNION ALL SELECT r_name, 'active' FROM region WHERE r_name = 'EUROPE')
  SELECT r_name AS domain, CASE count(r.domain) WHEN 0 THEN 'no_active_release' ELSE 'multiple_active_releases' END AS error
  FROM region LEFT JOIN r ON r.domain = r_name AND status = 'active' GROUP BY 1 HAVING count(r.domain) <> 1
""")
def l08b(spark, d):
    return lc.scope_errors(release_table(spark, d), dv.table(spark, d, "region").select(F.col("r_name").alias("domain")), "prod")


@query("l09_backfill_domain", """
  WITH c AS (SELECT l_partkey AS asset_id, s_nationkey::VARCHAR AS domain FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    UNION ALL SELECT p_partkey, CASE WHEN p_size < 10 THEN 'default' ELSE p_brand END FROM part)
  SELECT p_partkey AS asset_id, CASE count(DISTINCT domain) WHEN 0 THEN '__legacy_unscoped__' WHEN 1 THEN min(domain) ELSE '__legacy_shared__' END AS domain
  FROM part LEFT JOIN (SELECT * FROM c WHERE domain NOT IN ('', 'default')) ON asset_id = p_partkey GROUP BY 1
""")
def l09(spark, d):
    li = dv.table(spark, d, "lineitem").join(dv.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("asset_id"), F.col("s_nationkey").cast("string").alias("domain"))
    p = dv.table(spark, d, "part")
    own = p.select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_size") < 10, "default").otherwise(F.col("p_brand")).alias("domain"))
    return lc.backfill_domain(p.select(F.col("p_partkey").alias("asset_id")), [li, own])


# As-of: a build per (part, ship mode); links are the part's order lines with the supplier's nation as batch.
fragment("asof_links", "SELECT l_partkey AS document_id, l_linenumber AS snapshot_id, s_nationkey AS batch_id, date_trunc('month', l_shipdate) AS linked_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
fragment("asof_sel", "SELECT p_size AS build_id, p_partkey AS document_id, n AS snapshot_id, TIMESTAMP '1998-06-01' + to_days(p_size * 10) AS created_at FROM part, (SELECT unnest([1, 2, 3]) AS n)")


@query("l10_as_of_batch", """
  WITH e AS (SELECT build_id, document_id, batch_id, linked_at, max(linked_at) OVER (PARTITION BY build_id, document_id) AS latest
             FROM asof_sel JOIN asof_links USING (document_id, snapshot_id) WHERE linked_at <= created_at)
  SELECT build_id, document_id, min(batch_id) AS source_batch_id FROM e WHERE linked_at = latest GROUP BY 1, 2 HAVING count(DISTINCT batch_id) = 1
""", ("asof_sel", "asof_links"))
def l10(spark, d):
    k = dv.table(spark, d, "lineitem").join(dv.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("snapshot_id"), F.col("s_nationkey").alias("batch_id"), F.date_trunc("month", "l_shipdate").alias("linked_at"))
    sel = dv.table(spark, d, "part").select(
        F.col("p_size").alias("build_id"), F.col("p_partkey").alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("snapshot_id"),
        F.expr("timestamp'1998-06-01 00:00:00' + make_dt_interval(p_size * 10)").alias("created_at"))
    return lc.backfill_batch(sel, k)


@query("l11_rebuild_decisions", """
  SELECT run_id, document_id, CASE WHEN action = 'SKIP' THEN 'SKIP' ELSE '' END AS lifecycle_action FROM run_documents WHERE status = 'committed'
""", ("run_documents",))
def l11(spark, d):
    return lc.rebuild_decisions(dv.run_documents(spark, d)).na.fill("", ["lifecycle_action"])


fragment("counters", """
  SELECT run_id, count(*) FILTER (WHERE status = 'committed' AND action <> 'SKIP') AS committed_count, count(*) FILTER (WHERE status = 'committed' AND action = 'NEW') AS new_count,
    count(*) FILTER (WHERE status = 'committed' AND action = 'UPDATE') AS updated_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
    count(*) FILTER (WHERE status = 'committed' AND action = 'SKIP') AS skipped_count FROM run_documents GROUP BY 1
""", ("run_documents",))


@query("l11_rebuild_counters", "SELECT * FROM counters", ("counters",))
def l11b(spark, d):
    return lc.rebuild_counters(dv.run_documents(spark, d))


def _attempts(spark, d):
    s = F.col("status")
    st = F.when(s == "completed", "committed").when(s == "failed", "failed").when(F.col("value") < 3, "pending").otherwise("processing")
    return dv.stage_events(spark, d).select("run_id", "document_id", st.alias("status"))


@query("l12_resume_plan", """
  WITH a AS (SELECT run_id, document_id, CASE status WHEN 'completed' THEN 'committed' WHEN 'failed' THEN 'failed' ELSE CASE WHEN value < 3 THEN 'pending' ELSE 'processing' END END AS status FROM stage_events)
  SELECT DISTINCT run_id, document_id, 'skip' AS plan FROM a WHERE status = 'committed'
  UNION ALL SELECT DISTINCT run_id, document_id, 'pending' FROM a WHERE status = 'pending'
  UNION ALL (SELECT run_id, document_id, 'redo' FROM a WHERE status IN ('failed', 'processing') EXCEPT SELECT run_id, document_id, 'redo' FROM a WHERE status = 'committed')
""", ("stage_events",))
def l12(spark, d):
    return lc.resume_plan(_attempts(spark, d))


@query("l13_review_gates", """
  WITH runs AS (SELECT run_id, 'Brand#' || (CAST(substr(run_id, 9, 2) AS INT) % 25 + 1) AS domain, count(*) FILTER (WHERE status = 'failed' AND value > 250) AS pending FROM stage_events GROUP BY 1),
  p AS (SELECT domain, count(*) AS proposed FROM cand_reviewed WHERE status = 'proposed' GROUP BY 1)
  SELECT run_id, domain, pending, coalesce(proposed, 0) AS proposed, CASE WHEN pending > 0 THEN 'entity_review' WHEN proposed > 0 THEN 'ontology_review' ELSE 'none' END AS gate
  FROM runs LEFT JOIN p USING (domain)
""", ("stage_events", "cand_reviewed"))
def l13(spark, d):
    ev = dv.stage_events(spark, d)
    runs = ev.select("run_id").distinct().withColumn("domain", F.concat(F.lit("Brand#"), (F.substring("run_id", 9, 2).cast("int") % 25 + 1).cast("string")))
    return lc.review_gates(runs, ev.filter("status = 'failed' AND value > 250").select("run_id"), reviewed(spark, d).filter("status = 'proposed'").select("domain")).select(
        "run_id", "domain", "pending", "proposed", "gate")


@query("l14_commit_outcomes", """
  WITH x AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'write failed' ELSE '' END AS error, lang <> 'es' AS has_tree, doc_id IN (SELECT doc_id FROM segments WHERE token_count > 50) AS has
             FROM documents LEFT JOIN labels USING (doc_id))
  SELECT doc_id, CASE WHEN error <> '' THEN 'failed' WHEN NOT has_tree OR NOT has THEN 'skipped' ELSE 'committed' END AS status,
    CASE WHEN error <> '' THEN error WHEN NOT has_tree THEN 'unsupported_type' WHEN NOT has THEN 'no_segments' ELSE '' END AS reason FROM x
""", ("segments",))
def l14(spark, d):
    docs = dv.table(spark, d, "documents").join(dv.table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("toxic") == 1, "write failed").alias("error"), (F.col("lang") != "es").alias("has_tree"), F.lit("unsupported_type").alias("skip_reason"))
    return lc.commit_outcomes(docs, dv.segments(spark, d).filter("token_count > 50").select("doc_id")).na.fill("", ["reason"])


@query("l15_run_status", """
  SELECT *, CASE WHEN failed_count > 0 AND committed_count = 0 THEN 'failed' ELSE 'completed' END AS status, failed_count > 0 AND committed_count > 0 AS has_failures FROM counters
""", ("counters",))
def l15(spark, d):
    return lc.run_status(lc.rebuild_counters(dv.run_documents(spark, d)))
