"""Context assembly for tables of queries: items, relations, sources, budget, issues, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators.enrich import lookup
from tessella.session import cut_lineage, rows_of

# Fixed values.
MAX_CHARS = 12000
SEED_SHARE = 0.6
LOW_CONFIDENCE = 0.1
HIGH_SCORE, MEDIUM_SCORE = 0.7, 0.4
# Score and evidence role of an item by the relation that led to it.
RELATION_WEIGHT = {
    "elaborates": 1.5, "conditions": 1.4, "backgrounds": 1.3, "enables": 1.2, "results_in": 1.1, "sequences": 1.0,
    "contrasts_with": 0.9, "causes": 0.8, "parallels": 0.7, "evidences": 1.35, "exemplifies": 1.25, "purposes": 1.15,
    "justifies": 1.10, "summarizes": 1.05, "concedes": 0.85, "section_header_of": 0.6, "same_section": 0.5,
    "previous": 0.4, "next": 0.4, "same_parent_section": 0.3,
}
RELATION_ROLE = {
    "elaborates": "support", "conditions": "support", "causes": "support", "results_in": "support",
    "backgrounds": "background", "enables": "support", "evidences": "support", "exemplifies": "support",
    "purposes": "support", "justifies": "support", "summarizes": "support", "concedes": "contrast",
    "parallels": "context", "contrasts_with": "contrast", "previous": "context", "next": "context",
    "same_section": "context", "same_parent_section": "context", "section_header_of": "context",
}
OPPOSED_ROLES = (("advantage", "disadvantage"), ("pro", "con"), ("benefit", "risk"))
SUGGESTIONS = {
    "no_result": "尝试使用更通用的关键词",
    "low_confidence": "尝试更精确的描述或添加产品/版本约束",
    "conflicting_evidence": "检索到矛盾信息，建议参考多方文档进行综合判断",
}


def candidate_sources(candidates: DataFrame) -> DataFrame:
    """Source segments of a candidate: its segment, else its source refs, else its target refs."""
    refs = F.coalesce(
        F.when(F.col("segment_id").isNotNull(), F.array("segment_id")),
        F.when(F.size("source_refs") > 0, F.col("source_refs")),
        F.when(F.size("target_refs") > 0, F.col("target_refs")))
    return candidates.select("query_id", "unit_id", "rank", F.posexplode(refs).alias("pos", "segment_id"))


def source_items(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """Drill-down items: each source segment of a query once, with its document's columns."""
    first = sources.groupBy("query_id", "segment_id").agg(F.min(F.struct("rank", "pos")).alias("o"))
    return first.join(segments, "segment_id").select(
        "query_id", F.col("segment_id").alias("item_id"), F.lit("context").alias("role"), F.lit(0.0).alias("score"),
        F.col("o.rank").alias("o1"), F.col("o.pos").alias("o2"),
        *[c for c in segments.columns if c != "segment_id"])


def seed_items(candidates: DataFrame, sources: DataFrame, roles: DataFrame, sections: DataFrame,
               navigated: DataFrame) -> DataFrame:
    """Candidates ordered by navigated chapter, then discourse tier, then relevance.

    A candidate is a nucleus if any source segment is, else a satellite if any is. Its chapter is that
    of its first source segment with one. Of ``navigated`` only the candidates' chapters are joined, and which queries have any.
    """
    sections = cut_lineage(sources.select("segment_id").distinct().join(sections, "segment_id"))
    tier = F.when(F.col("discourse_role") == "nucleus", 0).when(F.col("discourse_role") == "satellite", 1).otherwise(2)
    per = (
        sources.join(roles, "segment_id", "left").join(sections, "segment_id", "left")
        .groupBy("query_id", "unit_id")
        .agg(F.min(tier).alias("t"), F.min(F.when(F.col("section").isNotNull(), F.struct("pos", "section")))["section"].alias("section"))
    )
    nav = rows_of(navigated, sections, "section").select("query_id", "section").distinct().withColumn("in_navigated_section", F.lit(True))
    has_nav = navigated.select("query_id").distinct().withColumn("has_nav", F.lit(True))
    j = candidates.join(per, ["query_id", "unit_id"], "left").join(nav, ["query_id", "section"], "left").join(has_nav, "query_id", "left")
    inside = F.coalesce("in_navigated_section", F.lit(False))
    role = F.when(F.col("t") == 0, "nucleus").when(F.col("t") == 1, "satellite").otherwise("standalone")
    section_tier = F.when(F.col("has_nav") & ~inside, 1).otherwise(0)
    role_tier = F.when(F.col("t") == 0, 0).when(F.col("t") == 1, 2).otherwise(1)
    w = W.partitionBy("query_id").orderBy(section_tier, role_tier, "rank")
    return j.select("query_id", "unit_id", "score", "rank", role.alias("discourse_role"),
                    F.coalesce("section", F.lit("")).alias("section"), inside.alias("in_navigated_section"),
                    F.row_number().over(w).alias("seed_rank"))


def expanded_items(expanded: DataFrame, segments: DataFrame) -> DataFrame:
    """Expanded segments as items: role and score follow the relation that led there."""
    rel = F.coalesce("relation_type", F.lit(""))
    return expanded.join(segments, "segment_id").select(
        "query_id", F.col("segment_id").alias("item_id"), F.lit("support").alias("role"), rel.alias("relation"),
        F.coalesce(lookup(RELATION_WEIGHT, rel), F.lit(0.3)).alias("score"),
        F.coalesce(lookup(RELATION_ROLE, rel), F.lit("background")).alias("evidence_role"),
        (rel == "contrasts_with").alias("is_contrasting"), "root_id",
        *[c for c in segments.columns if c != "segment_id"])


def context_relations(expanded: DataFrame, sources: DataFrame, relations: DataFrame) -> DataFrame:
    """Expansion edges and the direct relations that leave or reach a source segment, once per id."""
    grown = expanded.select(
        "query_id", F.concat_ws("-", F.lit("rel"), "root_id", "segment_id").alias("relation_id"),
        F.col("root_id").alias("from_id"), F.col("segment_id").alias("to_id"), F.lit("expansion").alias("relation_type"), "distance")
    mine = sources.select("query_id", "segment_id").distinct()
    out = mine.join(relations, F.col("segment_id") == F.col("source_id"))
    into = mine.join(relations, F.col("segment_id") == F.col("target_id"))
    direct = out.unionByName(into).select(
        "query_id", "relation_id", F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "relation_type",
        F.lit(0).alias("distance"))
    return grown.unionByName(direct).dropDuplicates(["query_id", "relation_id"])


def source_references(sources: DataFrame, segments: DataFrame, documents: DataFrame) -> DataFrame:
    """One reference per (query, document) behind the source segments."""
    touched = sources.select("query_id", "segment_id").join(segments.select("segment_id", "doc_id"), "segment_id").select(
        "query_id", "doc_id").distinct()
    return touched.join(documents, "doc_id")


def issues(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """``no_result`` for queries without seeds, ``low_confidence`` when every seed scores under 0.1."""
    top = seeds.groupBy("query_id").agg(F.max("score").alias("top_score"))
    j = queries.select("query_id").join(top, "query_id", "left")
    kind = F.when(F.col("top_score").isNull(), "no_result").when(F.col("top_score") < LOW_CONFIDENCE, "low_confidence")
    return j.select("query_id", kind.alias("issue"), F.coalesce("top_score", F.lit(0.0)).alias("top_score")).filter("issue IS NOT NULL")


def evidence_role(role: Column, score: Column, discourse: Column, relation: Column) -> Column:
    """Evidence role of an item from its kind, relevance, discourse role and relation."""
    by_score = F.when(score >= MEDIUM_SCORE, "support").otherwise("background")
    seed = F.when(discourse == "satellite", by_score).when(score >= HIGH_SCORE, "direct_answer").otherwise(by_score)
    expansion = (
        F.when(relation == "contrasts_with", "contrast")
        .when(relation.isin("elaborates", "conditions", "causes", "results_in"), "support").otherwise("background"))
    other = F.when(discourse == "satellite", "background").otherwise(by_score)
    return F.when(role == "seed", seed).when(F.coalesce(relation, F.lit("")) != "", expansion).otherwise(other)


def assemble(items: DataFrame, max_items: int) -> DataFrame:
    """Seeds, then context, then support; first occurrence of an id stays; at most ``max_items`` per query.

    ``items``: (query_id, item_id, role, o1, o2, ...), ordered inside a role by (o1, o2).
    """
    tier = F.when(F.col("role") == "seed", 0).when(F.col("role") == "context", 1).otherwise(2)
    rest = [c for c in items.columns if c not in ("query_id", "item_id")]
    once = items.withColumn("tier", tier).groupBy("query_id", "item_id").agg(
        F.min(F.struct("tier", "o1", "o2", *[c for c in rest if c not in ("o1", "o2")])).alias("x"))
    w = W.partitionBy("query_id").orderBy("x.tier", "x.o1", "x.o2", "item_id")
    return once.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= max_items).select(
        "query_id", "item_id", "position", *[F.col(f"x.{c}").alias(c) for c in rest])


def budgets(items: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Character allowance of every item; NULL for queries that fit the budget as they are.

    Seeds share 60 percent and get at least 200 characters each, the others the rest and at least 100.
    """
    seed = F.col("role") == "seed"
    total = items.groupBy("query_id").agg(
        F.sum(F.length("text")).alias("total"), F.count_if(seed).alias("n_seed"), F.count_if(~seed).alias("n_other"))
    share = int(max_chars * SEED_SHARE)
    allowed = F.when(seed, F.greatest(F.lit(200), F.floor(F.lit(share) / F.col("n_seed")))).otherwise(
        F.greatest(F.lit(100), F.floor(F.lit(max_chars - share) / F.col("n_other"))))
    return items.join(total, "query_id").withColumn("allowed", F.when(F.col("total") > max_chars, allowed).cast("int")).drop(
        "total", "n_seed", "n_other")


def truncated(text: Column, limit: Column) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, F.lit(1), limit), F.lit("..."))).otherwise(text)


#: Fixed value: a sentence ends after its mark, with the white space that follows, or at line breaks.
SENTENCE_END = r"(?<=[。！？!?])\s*|\n+"


def _bigrams(text: Column) -> Column:
    """Distinct character pairs of a text."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def summarised(items: DataFrame) -> DataFrame:
    """``items`` (text, allowed, wanted) with the text cut to the sentences that share most pairs with ``wanted`` and fit.

    Sentences are ranked inside the row and taken by one fold over the ranked list; those taken keep their order in
    the text. Without two sentences or without wanted pairs the text is truncated; if no sentence fits, the best one is.
    """
    sentences = F.filter(F.transform(F.split("text", SENTENCE_END), tx.strip), lambda x: F.length(x) > 0)
    ranked = F.array_sort(F.transform("_sentences", lambda x, i: F.struct(
        (-F.size(F.array_intersect(_bigrams(x), F.col("wanted")))).alias("shared"), i.alias("i"), F.length(x).alias("n"))))
    nothing = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))

    def take(state: Column, x: Column) -> Column:
        cost = x["n"] + F.when(F.size(state["taken"]) > 0, 1).otherwise(0)
        fits = state["used"] + cost <= F.col("allowed")
        return F.struct(F.when(fits, state["used"] + cost).otherwise(state["used"]).alias("used"),
                        F.when(fits, F.concat(state["taken"], F.array(x["i"]))).otherwise(state["taken"]).alias("taken"))

    chosen = F.sort_array(F.aggregate("_ranked", nothing, take, lambda state: state["taken"]))
    told = (F.when((F.size("_sentences") <= 1) | (F.size("wanted") == 0), truncated(F.col("text"), F.col("allowed")))
            .when(F.size("_taken") == 0, F.substring(F.get("_sentences", F.get("_ranked", F.lit(0))["i"]), F.lit(1), F.col("allowed")))
            .otherwise(F.array_join(F.transform("_taken", lambda i: F.get("_sentences", i)), " ")))
    step = items.withColumn("_sentences", sentences).withColumn("_ranked", ranked).withColumn("_taken", chosen)
    return step.withColumn("text", told).drop("_sentences", "_ranked", "_taken")


def compress(items: DataFrame, queries: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Fit each query's items into the budget: seeds are truncated, other items summarised.

    What a summary should speak of are the query and, if there is such a column, its ``keywords``.
    """
    parts = ["query", F.array_join("keywords", " ")] if "keywords" in queries.columns else ["query"]
    asked = queries.select("query_id", _bigrams(tx.strip(F.concat_ws(" ", *parts))).alias("wanted"))
    b = budgets(items, max_chars)
    long = F.col("allowed").isNotNull() & (F.length("text") > F.col("allowed"))
    kept = b.filter(~long)
    cut = b.filter(long & (F.col("role") == "seed")).withColumn("text", truncated(F.col("text"), F.col("allowed")))
    told = summarised(b.filter(long & (F.col("role") != "seed")).join(asked, "query_id", "left").withColumn(
        "wanted", F.coalesce("wanted", F.array().cast("array<string>"))))
    return kept.unionByName(cut).unionByName(told.drop("wanted")).drop("allowed")


def relations_between(relations: DataFrame, items: DataFrame) -> DataFrame:
    """Relations whose two ends are both among the query's items."""
    ids = items.select("query_id", F.col("item_id"))
    return relations.join(ids.withColumnRenamed("item_id", "from_id"), ["query_id", "from_id"], "left_semi").join(
        ids.withColumnRenamed("item_id", "to_id"), ["query_id", "to_id"], "left_semi")


def contradictions(seeds: DataFrame) -> DataFrame:
    """Queries whose seeds hold opposed semantic roles, with the ids in conflict."""
    role = F.lower("semantic_role")
    opposed = [r for pair in OPPOSED_ROLES for r in pair]
    g = seeds.filter(role.isin(*opposed)).groupBy("query_id").agg(
        F.collect_set(role).alias("roles"), F.array_sort(F.collect_list("item_id")).alias("conflict_ids"))
    hit = F.lit(False)
    for a, b in OPPOSED_ROLES:
        hit = hit | (F.array_contains("roles", a) & F.array_contains("roles", b))
    return g.filter(hit).select("query_id", F.lit("conflicting_evidence").alias("issue"), F.size("conflict_ids").alias("n_conflicts"), "conflict_ids")


def contrast_issues(items: DataFrame) -> DataFrame:
    """Queries with items reached over a contrast relation."""
    return items.filter("is_contrasting").groupBy("query_id").agg(
        F.count("*").alias("n_conflicts"), F.array_sort(F.collect_list("item_id")).alias("conflict_ids")).select(
        "query_id", F.lit("conflicting_evidence").alias("issue"), "n_conflicts", "conflict_ids")


def evidence_groups(items: DataFrame, relations: DataFrame) -> DataFrame:
    """Items per (query, snapshot) and the relations touching one of them at either end."""
    mine = items.select("query_id", "snapshot_id", "item_id").distinct()
    ends = [relations.select("query_id", F.col(end).alias("item_id"), "relation_id") for end in ("from_id", "to_id")]
    a, b = (e.join(mine, ["query_id", "item_id"]).select("query_id", "snapshot_id", "relation_id") for e in ends)
    rels = a.union(b).groupBy("query_id", "snapshot_id").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    ids = mine.groupBy("query_id", "snapshot_id").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return ids.join(rels, ["query_id", "snapshot_id"], "left").withColumn(
        "relation_ids", F.coalesce("relation_ids", F.array().cast("array<string>")))


def suggestions(found: DataFrame) -> DataFrame:
    """A hint per issue type."""
    return found.select("query_id", "issue", lookup(SUGGESTIONS, F.col("issue")).alias("suggestion")).filter("suggestion IS NOT NULL")
