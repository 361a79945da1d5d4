"""Incremental lifecycle: decisions, builds, releases, withdrawal, scope, backfill, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["domain", "document_id"]
# Labels of documents whose domain cannot be told.
UNSCOPED, SHARED = "__legacy_unscoped__", "__legacy_shared__"


def lifecycle_action(known: Column, new_hash: Column, active_hash: Column, active_complete: Column,
                     historical_hash: Column, historical_complete: Column) -> Column:
    """NEW, SKIP, RESTORE or UPDATE of an incoming document; the order of the rules matters."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "NEW")
        .when(active_hash.isNotNull() & (active_hash == new_hash) & F.coalesce(active_complete, F.lit(False)), "SKIP")
        .when(active_hash.isNull() & historical_hash.isNotNull() & (historical_hash == new_hash) & F.coalesce(historical_complete, F.lit(False)), "RESTORE")
        .otherwise("UPDATE"))


def lifecycle_state(incoming: DataFrame, links: DataFrame, selections: DataFrame, complete: DataFrame) -> DataFrame:
    """Known, active and matching historical state of each incoming document.

    ``incoming``: (domain, document_id, content_hash); ``links``: (domain, document_id, snapshot_id,
    content_hash, linked_at); ``selections``: active rows (domain, document_id, snapshot_id, content_hash);
    ``complete``: snapshots that have segments. The latest link is a combinable maximum.
    """
    known = links.select(*KEY).distinct().withColumn("known", F.lit(True))
    mine = links.join(incoming.select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_semi")
    last = mine.groupBy(*KEY).agg(F.max_by(F.struct("snapshot_id", "content_hash"), F.struct("linked_at", "snapshot_id")).alias("h")).select(
        *KEY, F.col("h.snapshot_id").alias("historical_snapshot"), F.col("h.content_hash").alias("historical_hash"))
    done = complete.select("snapshot_id").distinct()
    h = last.join(done.select(F.col("snapshot_id").alias("historical_snapshot"), F.lit(True).alias("historical_complete")), "historical_snapshot", "left")
    a = selections.select(*KEY, F.col("snapshot_id").alias("active_snapshot"), F.col("content_hash").alias("active_hash")).join(
        done.select(F.col("snapshot_id").alias("active_snapshot"), F.lit(True).alias("active_complete")), "active_snapshot", "left")
    return incoming.join(known, KEY, "left").join(h, KEY, "left").join(a, KEY, "left")


def decide(state: DataFrame) -> DataFrame:
    return state.withColumn("action", lifecycle_action(
        F.col("known"), F.col("content_hash"), F.col("active_hash"), F.col("active_complete"), F.col("historical_hash"), F.col("historical_complete")))


def classify(decisions: DataFrame, parent: DataFrame, detect_remove: bool = True) -> DataFrame:
    """Run against the active parent build: NEW, UPDATE, SKIP, and REMOVE where the run lacks a document."""
    p = parent.filter("selection_status = 'active'").select(*KEY, F.col("snapshot_id").alias("parent_snapshot"), F.col("source_batch_id").alias("parent_batch"))
    d = decisions.select(*KEY, F.col("snapshot_id").alias("new_snapshot"), F.col("source_batch_id").alias("new_batch"))
    j = d.join(p, KEY, "full_outer" if detect_remove else "left")
    action = (
        F.when(F.col("new_snapshot").isNull(), "REMOVE").when(F.col("parent_snapshot").isNull(), "NEW")
        .when(F.col("parent_snapshot") == F.col("new_snapshot"), "SKIP").otherwise("UPDATE"))
    names = {"REMOVE": "remove", "NEW": "add", "SKIP": "retain", "UPDATE": "update"}
    reason = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("action")]
    return j.withColumn("action", action).select(
        *KEY, F.coalesce("new_snapshot", "parent_snapshot").alias("snapshot_id"), "action", reason.alias("reason"),
        F.when(F.col("action") == "REMOVE", "removed").otherwise("active").alias("selection_status"))


def assemble_build(decisions: DataFrame, parent: DataFrame, batch_id: Column | str) -> DataFrame:
    """Selections of the next build: parent rows the run did not decide, overlaid with its decisions.

    New, updated and restored documents belong to the run's batch; skipped and removed ones keep the
    parent's. ``decisions``: output of :func:`classify`, optionally with ``lifecycle_action``.
    """
    p = parent.select(*KEY, "snapshot_id", "source_batch_id", "selection_status", "reason")
    carried = p.join(decisions.select(*KEY), KEY, "left_anti").withColumn("origin", F.lit("carried"))
    effective = F.coalesce("lifecycle_action", "action") if "lifecycle_action" in decisions.columns else F.col("action")
    batch = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    source = F.when(effective.isin("SKIP", "REMOVE"), F.col("parent_batch")).otherwise(batch)
    decided = decisions.join(p.select(*KEY, F.col("source_batch_id").alias("parent_batch")), KEY, "left").select(
        *KEY, "snapshot_id", source.alias("source_batch_id"), "selection_status", "reason", F.lit("decided").alias("origin"))
    return carried.unionByName(decided)


def action_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("domain", "action").agg(F.count("*").alias("n"))


def build_violations(builds: DataFrame, selections: DataFrame, segments: DataFrame) -> DataFrame:
    """Reasons a build may not be published; an empty result means valid.

    ``builds``: (domain, build_id, build_mode, parent_id, operation). A build of the withdrawal operation
    may be empty. ``segments``: snapshots that have segments.
    """
    active = selections.filter("selection_status = 'active'")
    counts = active.groupBy("domain").agg(F.count("*").alias("n"))
    b = builds.join(counts, "domain", "left")
    empty = b.filter(F.col("n").isNull() & (F.coalesce("operation", F.lit("")) != "withdrawal")).select("domain", F.lit("no_active_snapshot").alias("violation"), F.lit(None).cast("bigint").alias("snapshot_id"))
    bare = active.join(segments.select("snapshot_id").distinct(), "snapshot_id", "left_anti").select("domain", F.lit("no_segments").alias("violation"), "snapshot_id")
    ids = builds.select(F.col("build_id").alias("parent_id"))
    orphan = builds.filter("build_mode = 'incremental' AND parent_id IS NOT NULL").join(ids, "parent_id", "left_anti").select(
        "domain", F.lit("missing_parent").alias("violation"), F.lit(None).cast("bigint").alias("snapshot_id"))
    return empty.unionByName(bare).unionByName(orphan)


def publish(releases: DataFrame, new: DataFrame) -> DataFrame:
    """Next release table: the newest published release of a (domain, channel) is active, its predecessor retired.

    ``new``: (release_id, build_id, domain, channel, activated_at) for validated builds. Of several new
    ones for one channel the latest wins and the others are retired at once.
    """
    win = new.groupBy("domain", "channel").agg(F.max_by("release_id", F.struct("activated_at", "release_id")).alias("winner"))
    prev = releases.filter("status = 'active'").groupBy("domain", "channel").agg(F.max("release_id").alias("prev"))
    fresh = new.join(win, ["domain", "channel"]).join(prev, ["domain", "channel"], "left").select(
        "release_id", "build_id", "domain", "channel", F.when(F.col("release_id") == F.col("winner"), "active").otherwise("retired").alias("status"),
        F.col("prev").alias("previous_release_id"), "activated_at")
    old = releases.join(win, ["domain", "channel"], "left").withColumn(
        "status", F.when(F.col("winner").isNotNull() & (F.col("status") == "active"), "retired").otherwise(F.col("status"))).select(releases.columns)
    return old.unionByName(fresh.select(releases.columns))


def duplicate_active(releases: DataFrame) -> DataFrame:
    """(domain, channel) pairs with more than one active release."""
    return releases.filter("status = 'active'").groupBy("domain", "channel").agg(F.count("*").alias("n")).filter("n > 1")


def withdraw(parent: DataFrame, documents: DataFrame | None = None, batches: DataFrame | None = None) -> DataFrame:
    """Clone of a build with the active rows of the given documents or batches removed; nothing else changes."""
    if batches is not None:
        hit = parent.filter("selection_status = 'active'").join(
            batches.select("domain", F.col("source_batch_id")), ["domain", "source_batch_id"], "left_semi").select(*KEY)
    else:
        hit = parent.filter("selection_status = 'active'").join(documents.select(*KEY), KEY, "left_semi").select(*KEY)
    flag = hit.distinct().withColumn("hit", F.lit(True))
    j = parent.join(flag, KEY, "left")
    target = F.col("hit") & (F.col("selection_status") == "active")
    return j.withColumn("reason", F.when(target, "remove").otherwise(F.col("reason"))).withColumn(
        "selection_status", F.when(target, "removed").otherwise(F.col("selection_status"))).select(parent.columns)


def active_scope(releases: DataFrame, selections: DataFrame, documents: DataFrame, snapshots: DataFrame, channel: str) -> DataFrame:
    """Documents and snapshots visible through the active release of each domain.

    Everything must lie in the release's own domain. ``selections`` carries ``build_id``.
    """
    r = releases.filter((F.col("status") == "active") & (F.col("channel") == channel)).select("release_id", "build_id", "domain", "channel")
    s = selections.filter("selection_status = 'active'").select("build_id", "document_id", "snapshot_id", "source_batch_id")
    return (
        r.join(s, "build_id").join(documents.select("domain", "document_id"), KEY, "left_semi")
        .join(snapshots.select("domain", "snapshot_id"), ["domain", "snapshot_id"], "left_semi").distinct())


def scope_errors(releases: DataFrame, domains: DataFrame, channel: str) -> DataFrame:
    """Domains whose channel has no active release, or more than one."""
    n = releases.filter((F.col("status") == "active") & (F.col("channel") == channel)).groupBy("domain").agg(F.count("*").alias("n"))
    j = domains.join(n, "domain", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.filter("n <> 1").select("domain", F.when(F.col("n") == 0, "no_active_release").otherwise("multiple_active_releases").alias("error"))


def backfill_domain(assets: DataFrame, candidates: list[DataFrame]) -> DataFrame:
    """Domain of each asset from all provenance paths: none, one, or shared by several.

    ``candidates``: tables of (asset_id, domain); blank and default domains count for nothing.
    """
    every = candidates[0].select("asset_id", "domain")
    for c in candidates[1:]:
        every = every.unionByName(c.select("asset_id", "domain"))
    ok = every.filter(F.col("domain").isNotNull() & ~F.col("domain").isin("", "default")).groupBy("asset_id").agg(
        F.min("domain").alias("lo"), F.max("domain").alias("hi"))
    return assets.select("asset_id").join(ok, "asset_id", "left").select(
        "asset_id", F.when(F.col("lo").isNull(), UNSCOPED).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(SHARED).alias("domain"))


def as_of(questions: DataFrame, marks: DataFrame, keys: list[str], time: str, at: str, value: str, stretch: str = "month") -> DataFrame:
    """``questions`` with ``found``: the struct ``value`` of the latest mark of the same keys up to the question's time, else NULL.

    ``marks``: (keys, ``at``, ``value``), one row per keys and time. Both sides lie in one table sorted by time, and the last
    mark is carried along; marks and questions of one key are never multiplied. A key's history is cut in stretches of
    time, so that a hot key is many tasks: each stretch starts with the last mark of those before it, of which
    there is one row per stretch.
    """
    cut = lambda c: F.date_trunc(stretch, c).alias("_s")
    asked = questions.select("*", cut(time))
    ends = marks.select(*keys, cut(at), at, value).groupBy(*keys, "_s").agg(F.max_by(value, at).alias("_end"))
    steps = ends.unionByName(asked.select(*keys, "_s").distinct().withColumn("_end", F.lit(None).cast(marks.schema[value].dataType)))
    steps = steps.groupBy(*keys, "_s").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.select(*keys, "_s", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    rest = [c for c in questions.columns if c not in keys]
    both = asked.select(*keys, "_s", F.col(time).alias("_t"), F.lit(1).alias("_k"), F.struct(*rest).alias("_q"), F.lit(None).cast(marks.schema[value].dataType).alias("_m")).unionByName(
        marks.select(*keys, cut(at), F.col(at).alias("_t"), F.lit(0).alias("_k"), F.col(value).alias("_m")), allowMissingColumns=True)
    running = W.partitionBy(*keys, "_s").orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_m", F.last("_m", ignorenulls=True).over(running)).where("_k = 1")
    return seen.join(steps, [*keys, "_s"], "left").select(*keys, "_q.*", F.coalesce("_m", "_carried").alias("found"))


def backfill_batch(selections: DataFrame, links: DataFrame) -> DataFrame:
    """As-of batch of selections without one: that of the latest link up to the build, if it is unambiguous.

    ``selections``: (build_id, document_id, snapshot_id, created_at); ``links``: (document_id, snapshot_id,
    batch_id, linked_at). Links of one time are folded to their least and greatest batch first; of a build's several
    snapshots of a document the one linked last counts.
    """
    keys = ["document_id", "snapshot_id"]
    marks = links.filter("batch_id IS NOT NULL AND linked_at IS NOT NULL").groupBy(*keys, "linked_at").agg(
        F.struct(F.min("batch_id").alias("lo"), F.max("batch_id").alias("hi")).alias("b")).select(
        *keys, "linked_at", F.struct("linked_at", "b.lo", "b.hi").alias("mark"))
    asked = selections.filter("created_at IS NOT NULL").select("build_id", *keys, "created_at").distinct()
    found = as_of(asked, marks, keys, "created_at", "linked_at", "mark").filter("found IS NOT NULL")
    t = found.groupBy("build_id", "document_id", "found.linked_at").agg(F.min("found.lo").alias("lo"), F.max("found.hi").alias("hi"))
    last = t.groupBy("build_id", "document_id").agg(F.max_by(F.struct("lo", "hi"), "linked_at").alias("b"))
    return last.filter("b.lo = b.hi").select("build_id", "document_id", F.col("b.lo").alias("source_batch_id"))


def rebuild_decisions(run_documents: DataFrame) -> DataFrame:
    """Decisions of committed run documents, for a resumed run."""
    return run_documents.filter("status = 'committed' AND document_id IS NOT NULL").select(
        "run_id", "document_id", F.when(F.col("action") == "SKIP", "SKIP").alias("lifecycle_action"))


def rebuild_counters(run_documents: DataFrame) -> DataFrame:
    """Counters of each run from its documents; a committed SKIP counts as skipped."""
    done, skip = F.col("status") == "committed", F.col("action") == "SKIP"
    return run_documents.groupBy("run_id").agg(
        F.count_if(done & ~skip).alias("committed_count"), F.count_if(done & (F.col("action") == "NEW")).alias("new_count"),
        F.count_if(done & (F.col("action") == "UPDATE")).alias("updated_count"), F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.count_if((done & skip) | (F.col("status") == "skipped")).alias("skipped_count"))


def resume_plan(attempts: DataFrame) -> DataFrame:
    """What a resumed run does per document: skip the committed, take the pending, redo failed ones never committed.

    ``attempts``: (run_id, document_id, status), several rows per document allowed.
    """
    key = ["run_id", "document_id"]
    committed = attempts.filter("status = 'committed'").select(*key).distinct()
    failed = attempts.filter("status IN ('failed', 'processing')").select(*key).distinct()
    pending = attempts.filter("status = 'pending'").select(*key).distinct()
    return (
        committed.withColumn("plan", F.lit("skip")).unionByName(pending.withColumn("plan", F.lit("pending")))
        .unionByName(failed.subtract(committed).withColumn("plan", F.lit("redo"))))


def review_gates(runs: DataFrame, pending: DataFrame, proposed: DataFrame) -> DataFrame:
    """Gate each run waits at: entity review while mentions are pending, then ontology review.

    ``runs``: (run_id, domain); ``pending``: (run_id) rows; ``proposed``: (domain) rows.
    """
    p = pending.groupBy("run_id").agg(F.count("*").alias("pending"))
    q = proposed.groupBy("domain").agg(F.count("*").alias("proposed"))
    gate = F.when(F.col("pending") > 0, "entity_review").when(F.col("proposed") > 0, "ontology_review").otherwise("none")
    return runs.join(p, "run_id", "left").join(q, "domain", "left").na.fill(0, ["pending", "proposed"]).withColumn("gate", gate)


def commit_outcomes(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Outcome of each document: failed with an error, skipped without tree or segments, else committed."""
    has = segments.select("doc_id").distinct().withColumn("has", F.lit(True))
    return documents.join(has, "doc_id", "left").select(
        "doc_id", F.when(F.length("error") > 0, "failed").when(~F.col("has_tree") | F.col("has").isNull(), "skipped").otherwise("committed").alias("status"),
        F.when(F.length("error") > 0, F.col("error")).when(~F.col("has_tree"), F.col("skip_reason")).when(F.col("has").isNull(), "no_segments").alias("reason"))


def run_status(counters: DataFrame) -> DataFrame:
    """Final status of each run: failed if nothing was committed and something failed, else completed."""
    bad, none = F.col("failed_count") > 0, F.col("committed_count") == 0
    return counters.withColumn("status", F.when(bad & none, "failed").otherwise("completed")).withColumn("has_failures", bad & ~none)
