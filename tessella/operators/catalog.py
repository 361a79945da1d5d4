"""Catalog and operations reports over scope, run, stage and task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
PREVIEW = 200
GLOBAL_STAGES = ("graph_write", "assemble_build", "validate_build", "publish_release")
BACKOFF_BASE, BACKOFF_MAX = 2, 60
END = ("completed", "failed")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a report; Spark keeps the first limit + offset rows per task and merges those."""
    return df.orderBy(*order).offset(offset).limit(limit)


def knowledge_stats(scope: DataFrame, segments: DataFrame, relations: DataFrame, units: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Counts of documents, snapshots, segments, relations, units and embeddings per domain in scope.

    Each child table (snapshot_id, id) is cut to the scope by a join on snapshots and counted; snapshots
    of the scope are made distinct first, so nothing is counted twice.
    """
    snaps = scope.select("domain", "snapshot_id").distinct()
    out = scope.groupBy("domain").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("snapshot_id").alias("snapshots"))
    for name, t in (("segments", segments), ("relations", relations), ("units", units), ("embeddings", embeddings)):
        n = t.select("snapshot_id").join(snaps, "snapshot_id").groupBy("domain").agg(F.count("*").alias(name))
        out = out.join(n, "domain", "left")
    return out.na.fill(0)


def unit_type_distribution(scope: DataFrame, units: DataFrame) -> DataFrame:
    snaps = scope.select("domain", "snapshot_id").distinct()
    return units.join(snaps, "snapshot_id").groupBy("domain", "unit_type").agg(F.count("*").alias("n"))


def document_list(scope: DataFrame, documents: DataFrame, document_type: str | None = None, batch: str | None = None, unclassified: bool = False) -> DataFrame:
    """Active documents, by type and batch, or those without a batch."""
    s = scope
    if batch is not None:
        s = s.filter(F.col("source_batch_id") == batch)
    elif unclassified:
        s = s.filter(F.col("source_batch_id").isNull())
    d = documents if document_type is None else documents.filter(F.col("document_type") == document_type)
    return s.select("domain", "document_id", "source_batch_id").distinct().join(d, ["domain", "document_id"])


def batch_list(scope: DataFrame, batches: DataFrame, runs: DataFrame) -> DataFrame:
    """Active documents per source batch with the latest run of the batch.

    ``batches``: (domain, source_batch_id, created_at); ``runs``: (domain, source_batch_id, run_id, started_at).
    """
    key = ["domain", "source_batch_id"]
    n = scope.groupBy(*key).agg(F.count_distinct("document_id").alias("documents"))
    last = runs.groupBy(*key).agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return n.join(batches, key, "left").join(last, key, "left").withColumn("unclassified", F.col("source_batch_id").isNull())


def document_detail(scope: DataFrame, links: DataFrame) -> DataFrame:
    """Active snapshot of each document with its latest link of the same batch, NULL matching NULL."""
    s, k = scope.alias("s"), links.alias("k")
    on = (F.col("s.document_id") == F.col("k.document_id")) & (F.col("s.snapshot_id") == F.col("k.snapshot_id")) & F.col(
        "s.source_batch_id").eqNullSafe(F.col("k.batch_id"))
    return s.join(k, on, "left").groupBy("s.domain", "s.document_id", "s.snapshot_id").agg(F.max("k.linked_at").alias("linked_at"))


def document_children(scope: DataFrame, rows: DataFrame) -> DataFrame:
    """Segments or units of the active snapshots, with a short preview of the text."""
    snaps = scope.select("domain", "document_id", "snapshot_id").distinct()
    return rows.join(snaps, "snapshot_id").withColumn("preview", F.substring("text", 1, PREVIEW)).drop("text")


def relation_list(relations: DataFrame, segments: DataFrame) -> DataFrame:
    """Relations with the texts of both ends."""
    s = segments.select(F.col("segment_id").alias("source_id"), F.col("text").alias("source_text"))
    t = segments.select(F.col("segment_id").alias("target_id"), F.col("text").alias("target_text"))
    return relations.join(s, "source_id", "left").join(t, "target_id", "left")


def run_document_report(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Run documents with their latest stage and the time between first and last event in milliseconds."""
    key = ["run_id", "document_id"]
    e = events.groupBy(*key).agg(
        F.max_by("stage", F.struct("created_at", "event_id")).alias("current_stage"),
        F.expr("timestampdiff(MILLISECOND, min(created_at), max(created_at))").alias("duration_ms"))
    return documents.join(e, key, "left")


def open_stages(events: DataFrame) -> DataFrame:
    """Latest start of each (run, document, stage) that no end follows.

    An end follows some start unless the last start is not before the last end, so two maxima decide it.
    """
    key = ["run_id", "document_id", "stage"]
    e = events.groupBy(*key).agg(
        F.max(F.when(F.col("status") == "started", F.col("created_at"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*END), F.col("created_at"))).alias("ended_at"))
    return e.filter(F.col("started_at").isNotNull() & (F.col("ended_at").isNull() | (F.col("ended_at") <= F.col("started_at")))).drop("ended_at")


def run_progress(documents: DataFrame, events: DataFrame, runs: DataFrame, global_done: DataFrame | None = None) -> DataFrame:
    """Status counts, current stage and percent done of each run; below 100 until the run is completed.

    ``runs``: (run_id, status, total_documents); ``global_done``: (run_id, stage) of finished global stages.
    """
    s = F.col("status")
    c = documents.groupBy("run_id").agg(
        F.count_if(s == "committed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"),
        F.count_if(s.isin("processing", "pending")).alias("processing"))
    cur = open_stages(events).groupBy("run_id").agg(F.max_by("stage", F.struct("started_at", "stage")).alias("current_stage"))
    j = runs.join(c, "run_id", "left").join(cur, "run_id", "left")
    if global_done is not None:
        g = global_done.filter(F.col("stage").isin(*GLOBAL_STAGES)).groupBy("run_id").agg(F.count_distinct("stage").alias("global_done"))
        j = j.join(g, "run_id", "left")
    else:
        j = j.withColumn("global_done", F.lit(0))
    j = j.na.fill(0, ["completed", "failed", "skipped", "processing", "global_done", "total_documents"])
    done = F.col("completed") + F.col("failed") + F.col("skipped") + F.col("global_done")
    pct = F.round(done / (F.col("total_documents") + len(GLOBAL_STAGES)) * 100, 1)
    return j.withColumn("progress_percent", F.when(F.col("status") == "completed", 100.0).otherwise(F.least(pct, F.lit(99.9))))


def stage_summary(events: DataFrame) -> DataFrame:
    """Completed and failed events per run and stage."""
    s = F.col("status")
    return events.groupBy("run_id", "stage").agg(F.count_if(s == "completed").alias("done"), F.count_if(s == "failed").alias("failed"))


def artifact_counts(documents: DataFrame, **children: DataFrame) -> DataFrame:
    """Rows of each child table per run document; ``children`` share the documents' snapshot_id."""
    out = documents
    for name, t in children.items():
        out = out.join(t.groupBy("snapshot_id").agg(F.count("*").alias(name)), "snapshot_id", "left")
    return out.na.fill(0, list(children))


def run_trace(runs: DataFrame, candidates: DataFrame, pending: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Overview of each run: open reviews and graph size of its domain.

    ``candidates``: (domain, status); ``pending``: (run_id); ``entities`` and ``edges``: (domain).
    """
    def count(t: DataFrame, key: str, name: str) -> DataFrame:
        return t.groupBy(key).agg(F.count("*").alias(name))

    j = runs.join(count(candidates.filter("status = 'proposed'"), "domain", "proposed_candidates"), "domain", "left")
    j = j.join(count(pending, "run_id", "pending_mentions"), "run_id", "left").join(count(entities, "domain", "entity_count"), "domain", "left")
    j = j.join(count(edges, "domain", "relation_count"), "domain", "left")
    return j.na.fill(0, ["proposed_candidates", "pending_mentions", "entity_count", "relation_count"])


def stage_timeline(events: DataFrame) -> DataFrame:
    """End events with the start directly before them in the same stage, and the time between in milliseconds."""
    w = W.partitionBy("run_id", "document_id", "stage").orderBy("created_at", "event_id")
    prev = F.lag(F.struct("status", "created_at")).over(w)
    e = events.withColumn("prev", prev).filter(F.col("status").isin(*END) & (F.col("prev.status") == "started"))
    return e.select("event_id", "run_id", "document_id", "stage", "status",
                    F.expr("timestampdiff(MILLISECOND, prev.created_at, created_at)").alias("duration_ms"))


def build_list(builds: DataFrame, releases: DataFrame, selections: DataFrame) -> DataFrame:
    """Builds with their active selections and the channels they are active in."""
    n = selections.filter("selection_status = 'active'").groupBy("build_id").agg(F.count("*").alias("active_documents"))
    r = releases.filter("status = 'active'").groupBy("build_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    return builds.join(n, "build_id", "left").join(r, "build_id", "left").na.fill(0, ["active_documents"]).na.fill("", ["channels"])


def release_list(releases: DataFrame, limit: int = 20, offset: int = 0, channel: str | None = None) -> DataFrame:
    """One page of the releases of every domain, newest first, with the number of all of them; ``rank`` counts from 1."""
    r = releases.filter(F.col("channel") == channel) if channel else releases
    newest = W.partitionBy("domain").orderBy(F.col("activated_at").desc(), "release_id")
    totals = r.groupBy("domain").agg(F.count("*").alias("total"))
    page = r.withColumn("rank", F.row_number().over(newest)).filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return page.join(totals, "domain")


def active_releases(releases: DataFrame, wanted: DataFrame) -> DataFrame:
    """The active release of each wanted (domain, channel), NULL where there is none; the smallest id if there are several."""
    a = releases.filter("status = 'active'").groupBy("domain", "channel").agg(F.min_by(F.struct("release_id", "build_id"), "release_id").alias("r"))
    return wanted.join(a, ["domain", "channel"], "left").select("domain", "channel", "r.release_id", "r.build_id")


def build_detail(builds: DataFrame, selections: DataFrame) -> DataFrame:
    """Builds with their document selections, one row each; a build without any has one row of NULLs."""
    return builds.join(selections.select("build_id", "document_id", "snapshot_id", "selection_status", "reason"), "build_id", "left")


def runs_in(runs: DataFrame, status: str, domain: str | None = None) -> DataFrame:
    """Runs that wait in one status (``interrupted``, ``awaiting_review``), in the order of their start."""
    r = runs.filter(F.col("status") == status)
    if domain:
        r = r.filter(F.col("domain") == domain)
    return r.withColumn("place", F.row_number().over(W.partitionBy("domain").orderBy("started_at", "run_id")))


def usage_overview(tasks: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """One row: tasks, success rate, recent failures, services, attempts, tokens, mean latency."""
    s = F.col("status")
    t = tasks.agg(
        F.count("*").alias("tasks"), F.round(F.count_if(s == "succeeded") / F.count("*"), 4).alias("success_rate"),
        F.count_if((s == "failed") & (F.col("created_at") > now - F.expr("INTERVAL 1 HOUR"))).alias("recent_failures"),
        F.array_join(F.array_sort(F.collect_set("caller_service")), ",").alias("services"),
        F.array_join(F.array_sort(F.collect_set("knowledge_domain")), ",").alias("domains"),
        F.array_join(F.array_sort(F.collect_set("pipeline_stage")), ",").alias("stages"))
    a = attempts.agg(F.struct(
        F.count_if(s == "succeeded").alias("succeeded_attempts"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms")).alias("a")).scalar()
    return t.select("*", a["succeeded_attempts"].alias("succeeded_attempts"), a["total_tokens"].alias("total_tokens"), a["avg_latency_ms"].alias("avg_latency_ms"))


def token_usage(tasks: DataFrame, attempts: DataFrame, keys: list[str], cube: bool = False) -> DataFrame:
    """Tokens, attempts and mean latency by task keys; all sub-totals as well with ``cube``."""
    j = attempts.join(tasks.select("task_id", *keys), "task_id")
    g = j.cube(*keys) if cube else j.groupBy(*keys)
    return g.agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("attempt_count"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


def task_list(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Tasks with tokens and latency of their latest succeeded attempt."""
    best = attempts.filter("status = 'succeeded'").groupBy("task_id").agg(F.max_by(F.struct("total_tokens", "latency_ms"), "attempt_no").alias("a"))
    return tasks.join(best, "task_id", "left").select(*tasks.columns, "a.total_tokens", "a.latency_ms")


def quality_summary(scope: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """Per domain: question units, those with a number prefix, discourse relations, and the warnings."""
    snaps = scope.select("domain", "snapshot_id").distinct()
    question = F.col("unit_type") == "generated_question"
    u = units.join(snaps, "snapshot_id").groupBy("domain").agg(
        F.count("*").alias("units"), F.count_if(question).alias("questions"), F.count_if(question & F.col("title").rlike(r"^Q\d+\s*[:：]")).alias("prefixed"))
    r = relations.join(snaps, "snapshot_id").groupBy("domain").agg(F.count("*").alias("discourse_relations"))
    j = snaps.select("domain").distinct().join(u, "domain", "left").join(r, "domain", "left").na.fill(0)
    warn = F.concat_ws("; ", F.when(F.col("questions") == 0, "No generated_question units found"),
                       F.when(F.col("prefixed") > 0, F.concat(F.col("prefixed").cast("string"), F.lit(" question titles still have Qn prefix"))),
                       F.when(F.col("discourse_relations") == 0, "No discourse relations found"))
    return j.withColumn("warnings", warn)


def retry_state(tasks: DataFrame, now: Column) -> DataFrame:
    """Next state of failed and lease-expired tasks: queued after min(2^n, 60) seconds, or dead letter.

    ``tasks``: (task_id, status, attempt_count, max_attempts, lease_expires_at).
    """
    expired = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    n = F.col("attempt_count") + 1
    again = n < F.col("max_attempts")
    return tasks.filter((F.col("status") == "failed") | expired).select(
        "task_id", F.when(expired, "lease_expired").otherwise("error").alias("cause"), n.alias("attempt_count"),
        F.when(again, "queued").otherwise("dead_letter").alias("next_status"),
        F.when(again, F.least(F.pow(F.lit(BACKOFF_BASE), n), F.lit(BACKOFF_MAX))).otherwise(F.lit(0)).cast("int").alias("backoff_seconds"))


def latest(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """Latest row per key, by one combinable maximum."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("x")).select(*by, "x.*")


def links_per_snapshot(links: DataFrame) -> DataFrame:
    return links.groupBy("snapshot_id").agg(F.count("*").alias("links"), F.max("linked_at").alias("last_linked_at"))


def template_lookup(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Newest active template per (key, domain), falling back to the global one.

    ``requests``: (template_key, domain); ``templates``: (template_key, domain or NULL, status, created_at, version).
    """
    a = templates.filter("status = 'active'")
    own = a.filter("domain IS NOT NULL").groupBy("template_key", "domain").agg(F.max_by("version", F.struct("created_at", "version")).alias("own"))
    shared = a.filter("domain IS NULL").groupBy("template_key").agg(F.max_by("version", F.struct("created_at", "version")).alias("shared"))
    j = requests.join(own, ["template_key", "domain"], "left").join(shared, "template_key", "left")
    return j.select("template_key", "domain", F.coalesce("own", "shared").alias("version"), F.col("own").isNotNull().alias("overridden"))


def candidate_review_list(candidates: DataFrame, duplicates: DataFrame, quotes: DataFrame) -> DataFrame:
    """Candidates with their duplicate flag and one row per member with its quote.

    ``candidates``: (proposed_name, kind, score, members ARRAY); relation types are not checked.
    """
    m = candidates.select("*", F.explode_outer("members").alias("entity_id")).drop("members")
    d = duplicates.select("proposed_name", "duplicate_of")
    return m.join(d, "proposed_name", "left").withColumn(
        "duplicate_of", F.when(F.col("kind") == "node_type", F.col("duplicate_of"))).join(quotes, "entity_id", "left")
