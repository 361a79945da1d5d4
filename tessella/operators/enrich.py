"""Rules around model outputs: enrichment, entities, alias resolution, co-mentions, discourse."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx

# Fixed values.
MIN_ENRICH_TOKENS = 30
MIN_ENTITY_CONFIDENCE = 0.5
UNTYPED = "__untyped__"
WILDCARD = "*"
WINDOW_SIZE = 15
MIN_RELATION_CONFIDENCE = 0.5
# Discourse labels and which side is the nucleus ("both", "earlier" or "later" segment).
NUCLEUS = {
    "elaborates": "earlier", "exemplifies": "earlier", "evidences": "earlier", "justifies": "earlier",
    "purposes": "earlier", "results_in": "earlier", "backgrounds": "later", "conditions": "later",
    "enables": "later", "causes": "later", "concedes": "later", "summarizes": "both",
    "sequences": "both", "contrasts_with": "both", "parallels": "both",
}


def lookup(table: dict, key: Column) -> Column:
    """Value of a small constant table, NULL for unknown keys."""
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def mark_tiny(segments: DataFrame, min_tokens: int = MIN_ENRICH_TOKENS) -> DataFrame:
    """Short segments become notes without substance and are not sent to a model."""
    tiny = F.coalesce("token_count", F.lit(0)) < min_tokens
    return (
        segments.withColumn("send", ~tiny)
        .withColumn("semantic_role", F.when(tiny, "note").otherwise(F.col("semantic_role")))
        .withColumn("is_substantive", F.when(tiny, F.lit(False)))
        .withColumn("is_navigation", F.when(tiny, F.lit(False)))
        .withColumn("assessment_reason", F.when(tiny, F.concat(
            F.lit("segment below min_enrich_tokens ("), "token_count", F.lit(" tokens)"))))
    )


def apply_enrichment(segments: DataFrame, results: DataFrame, roles: list[str] | None) -> DataFrame:
    """Take role, document type and assessment from results; unknown roles and empty assessments are ignored.

    ``results``: (segment_id, role, document_type, is_substantive, is_navigation).
    """
    r = results.select(
        "segment_id", F.col("role").alias("r_role"), F.col("document_type").alias("r_type"),
        F.col("is_substantive").alias("r_sub"), F.col("is_navigation").alias("r_nav"))
    ok = F.length("r_role") > 0
    if roles is not None:
        ok = ok & F.col("r_role").isin(*roles)
    return segments.join(r, "segment_id", "left").select(
        *[c for c in segments.columns if c != "semantic_role"],
        F.when(ok, F.col("r_role")).otherwise(F.col("semantic_role")).alias("semantic_role"),
        F.when(F.length("r_type") > 0, F.col("r_type")).alias("document_type"),
        F.col("r_sub").alias("is_substantive"), F.col("r_nav").alias("is_navigation"),
        (F.col("r_sub").isNotNull() | F.col("r_nav").isNotNull()).alias("assessed"))


def entity_refs(results: DataFrame, existing: DataFrame, allowed: list[str],
                min_confidence: float = MIN_ENTITY_CONFIDENCE) -> DataFrame:
    """Merge two result channels into the refs of each segment.

    ``results``: (segment_id, channel, type, name, confidence). Channel A keeps its type when the type is
    allowed and the confidence high enough; everything else turns untyped with a reason. Refs already
    present as (type, name) are not added again.
    """
    allowed_type = F.col("type").isin(*allowed) if allowed else F.lit(True)
    sure = F.col("confidence").isNull() | (F.col("confidence") >= min_confidence)
    typed = (F.col("channel") == "A") & allowed_type & sure
    reason = (
        F.when(F.col("channel") == "B", "llm_out_of_schema").when(~allowed_type, "off_schema_type").otherwise("low_confidence"))
    new = results.filter(F.length("name") > 0).select(
        "segment_id", F.when(typed, F.col("type")).otherwise(UNTYPED).alias("type"), "name",
        F.when(~typed & (F.col("type") != UNTYPED), F.col("type")).alias("proposed_type"),
        F.when(~typed, reason).alias("reason"))
    added = new.join(existing.select("segment_id", "type", "name"), ["segment_id", "type", "name"], "left_anti")
    old = existing.select("segment_id", "type", "name", F.lit(None).cast("string").alias("proposed_type"),
                          F.lit(None).cast("string").alias("reason"))
    return old.unionByName(added)


def regex_entities(texts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """All matches of each (pattern, entity type) rule in ``texts.text`` with their upper-case form."""
    found = F.concat(*[
        F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)),
                    _typed(t)) for p, t in rules])
    return texts.select("id", F.explode(found).alias("e")).select(
        "id", "e.entity_type", "e.name", F.upper("e.name").alias("normalized_name"))


def _typed(entity_type: str):
    return lambda m: F.struct(F.lit(entity_type).alias("entity_type"), m.alias("name"))


def normalize_alias(name: Column) -> Column:
    return F.lower(tx.strip(name))


def resolve_aliases(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias to canonical name, else a name that is itself canonical, else pending.

    ``aliases``: (alias_normalized, canonical_name).
    """
    direct = aliases.groupBy(F.col("alias_normalized").alias("norm")).agg(F.max("canonical_name").alias("c1"))
    own = aliases.groupBy(normalize_alias(F.col("canonical_name")).alias("norm")).agg(F.max("canonical_name").alias("c2"))
    j = refs.withColumn("norm", normalize_alias(F.col("name"))).join(direct, "norm", "left").join(own, "norm", "left")
    found = F.coalesce("c1", "c2")
    return j.select(*refs.columns, found.alias("canonical_name"),
                    F.when(found.isNotNull(), "auto").otherwise("pending").alias("resolve_status"))


def co_mentions(refs: DataFrame) -> DataFrame:
    """Ordered pairs of different entities of one segment, each pair once.

    ``refs``: (segment_id, type, key). Repeated mentions are folded before pairing, so a segment costs
    the square of its distinct entities only.
    """
    one = refs.filter(F.length("key") > 0).select("segment_id", "type", "key").distinct()
    head = one.select("segment_id", F.col("type").alias("head_type"), F.col("key").alias("head"))
    tail = one.select("segment_id", F.col("type").alias("tail_type"), F.col("key").alias("tail"))
    return head.join(tail, "segment_id").filter(F.col("head") != F.col("tail"))


def relation_conditions(patterns: list[tuple[str, str, str]]) -> dict[str, Column]:
    """Relation names of the patterns (name, head type, tail type) with the condition under which a typed pair fits one."""
    fits: dict[str, Column] = {}
    for name, head, tail in patterns:
        ok = F.lit(True)
        if head != WILDCARD:
            ok = ok & F.coalesce(F.col("head_type") == head, F.lit(False))
        if tail != WILDCARD:
            ok = ok & F.coalesce(F.col("tail_type") == tail, F.lit(False))
        fits[name] = fits[name] | ok if name in fits else ok
    return fits


def fits_pattern(patterns: list[tuple[str, str, str]]) -> Column:
    """True when a typed pair fits any pattern."""
    return reduce(or_, relation_conditions(patterns).values(), F.lit(False))


def with_relations(pairs: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """``pairs`` once per relation whose pattern their types fit, with its name as ``relation_type``."""
    fits = relation_conditions(patterns)
    if len(fits) == 1:
        return pairs.where(fits_pattern(patterns)).withColumn("relation_type", F.lit(next(iter(fits))))
    names = F.array(*[F.when(ok, name) for name, ok in fits.items()]) if fits else F.array().cast("array<string>")
    return pairs.select("*", F.explode(names).alias("relation_type")).where("relation_type is not null")


def candidate_relations(pairs: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Typed relation candidates of each segment: pairs whose types fit a pattern."""
    return (
        with_relations(pairs, patterns)
        .groupBy("segment_id", "head", "relation_type", "tail")
        .agg(F.min("head_type").alias("head_type"), F.min("tail_type").alias("tail_type"))
    )


def off_schema_pairs(pairs: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Pairs of a segment whose types fit no pattern."""
    return pairs.where(~fits_pattern(patterns)).select("segment_id", "head", "head_type", "tail", "tail_type")


def discourse_windows(segments: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """Overlapping windows of content segments: size w, step w - 1, windows of one segment dropped.

    The position among content segments needs one window per document, whose size is bounded by the
    document row the segments came from.
    """
    step = size - 1
    w = W.partitionBy("doc_id")
    c = segments.filter(~F.col("is_heading")).withColumn("pos", F.row_number().over(w.orderBy("segment_index")) - 1).withColumn(
        "n", F.count("*").over(w))
    k = F.floor(F.col("pos") / step).cast("int")
    both = F.when((F.col("pos") % step == 0) & (F.col("pos") > 0), F.array(k - 1, k)).otherwise(F.array(k))
    return (
        c.select("doc_id", "segment_id", "segment_index", "token_count", "pos", "n", F.explode(both).alias("window_id"))
        .filter(F.least(F.lit(size), F.col("n") - F.col("window_id") * step) >= 2)
        .select("doc_id", "window_id", (F.col("pos") - F.col("window_id") * step).alias("window_pos"), "segment_id", "token_count")
    )


def map_discourse(results: DataFrame, windows: DataFrame) -> DataFrame:
    """Window-local indices to segments; unknown labels and indices outside the window fall away.

    ``results``: (doc_id, window_id, source, target, relation, confidence).
    """
    pos = windows.select("doc_id", "window_id", "window_pos", "segment_id")
    src = pos.select("doc_id", "window_id", F.col("window_pos").alias("source"), F.col("segment_id").alias("source_id"))
    dst = pos.select("doc_id", "window_id", F.col("window_pos").alias("target"), F.col("segment_id").alias("target_id"))
    label = F.lower(F.coalesce("relation", F.lit("other")))
    known = results.withColumn("relation_type", label).filter(F.col("relation_type").isin(*NUCLEUS))
    gap = F.abs(F.col("source") - F.col("target"))
    return (
        known.join(src, ["doc_id", "window_id", "source"]).join(dst, ["doc_id", "window_id", "target"])
        .select("source_id", "target_id", "relation_type", F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
                F.when(gap > 0, gap).alias("distance"))
    )


def best_relations(relations: DataFrame, min_confidence: float = MIN_RELATION_CONFIDENCE) -> DataFrame:
    """Whitelisted relations above the confidence floor (missing passes), best one per (source, target, type)."""
    c = F.col("confidence")
    ok = relations.filter(F.col("relation_type").isin(*NUCLEUS) & (c.isNull() | (c >= min_confidence)))
    return ok.groupBy("source_id", "target_id", "relation_type").agg(F.max("confidence").alias("confidence"))


def discourse_roles(segments: DataFrame, relations: DataFrame) -> DataFrame:
    """Nucleus if it is one in any relation, else satellite if in any, else standalone; order decides sides.

    ``segments``: (segment_id, segment_index); ``relations``: (source_id, target_id, relation_type).
    """
    idx = lambda c: F.split_part(F.col(c), F.lit("#"), F.lit(-1)).cast("int")
    side = lookup(NUCLEUS, F.col("relation_type"))
    earlier = F.when(idx("source_id") <= idx("target_id"), F.col("source_id")).otherwise(F.col("target_id"))
    later = F.when(idx("source_id") <= idx("target_id"), F.col("target_id")).otherwise(F.col("source_id"))
    ends = relations.withColumn("side", side).filter("side IS NOT NULL").select(F.explode(F.array(
        F.struct(earlier.alias("segment_id"), F.when(F.col("side") == "later", 1).otherwise(2).alias("role")),
        F.struct(later.alias("segment_id"), F.when(F.col("side") == "earlier", 1).otherwise(2).alias("role")),
    )).alias("e")).select("e.*").groupBy("segment_id").agg(F.max("role").alias("role"))
    return segments.select("segment_id").join(ends, "segment_id", "left").select(
        "segment_id", F.when(F.col("role") == 2, "nucleus").when(F.col("role") == 1, "satellite").otherwise("standalone")
        .alias("discourse_role"))
