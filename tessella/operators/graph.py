"""Knowledge graph over mention, entity, edge and evidence tables.

Reviews arrive as decision tables: many merges, retypes, deletes or mention reviews give the next version
of the affected tables in one job.
"""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators.enrich import UNTYPED, WILDCARD, candidate_relations, co_mentions, fits_pattern, with_relations
from tessella.operators.retrieval import HUB_EDGES, containing, meet, split_hubs, symmetric
from tessella.session import at_most, cut_lineage, rows_of

# Fixed values.
QUOTE_CHARS = 300
NPMI_FLOOR = 0.3
MIN_DF = 2
CONFIRMED = ("auto", "human")
SUGGESTIONS = 5


def flatten_mentions(segments: DataFrame) -> DataFrame:
    """Entity refs of segments as mention rows with a quote.

    ``segments``: (snapshot_id, segment_id, raw_text, refs ARRAY<STRUCT<type, name, canonical_name, resolve_status>>).
    """
    r = segments.select("snapshot_id", "segment_id", F.substring("raw_text", 1, QUOTE_CHARS).alias("quote"), F.posexplode("refs").alias("pos", "r"))
    return r.filter((F.length("r.name") > 0) & (F.length("r.type") > 0)).select(
        "snapshot_id", "segment_id", "pos", F.col("r.type").alias("node_type"), F.col("r.name").alias("mention_text"), "r.canonical_name",
        F.coalesce("r.resolve_status", F.lit("pending")).alias("resolve_status"), "quote")


def canonical_entities(mentions: DataFrame) -> DataFrame:
    """Entities of automatically resolved mentions: mentions and distinct snapshots."""
    return mentions.filter("resolve_status = 'auto' AND canonical_name IS NOT NULL").groupBy("node_type", "canonical_name").agg(
        F.count("*").alias("mention_count"), F.count_distinct("snapshot_id").alias("document_count"))


def aggregate_edges(relations: DataFrame) -> DataFrame:
    """Candidate relations folded to edges with their number of supporting segments."""
    return relations.groupBy("head", "relation_type", "tail").agg(
        F.min("head_type").alias("head_type"), F.min("tail_type").alias("tail_type"), F.count("*").alias("cooccur"),
        F.min("segment_id").alias("first_segment"))


def npmi(p_h: Column, p_t: Column, p_ht: Column) -> Column:
    """Normalised pointwise mutual information: -1 without co-occurrence, 1 when always together."""
    none = (p_h <= 0) | (p_t <= 0) | (p_ht <= 0)
    return F.when(none, -1.0).when(p_ht == 1, 1.0).otherwise(F.log(p_ht / (p_h * p_t)) / -F.log(p_ht))


def edge_strength(edges: DataFrame, mentions: DataFrame, total_segments: int | Column) -> DataFrame:
    """Adds ``npmi``: how often the ends share a segment against how often each occurs, over all segments.

    ``mentions``: (segment_id, key). Shared segments are counted over the distinct keys of each segment,
    the cost of the co-mentions themselves, and combined before the shuffle.
    """
    seen = mentions.select("key", "segment_id").distinct()
    n = seen.groupBy("key").agg(F.count("*").alias("n"))
    pairs = edges.select("head", "tail").distinct()
    left = seen.select(F.col("key").alias("head"), "segment_id")
    right = seen.select(F.col("key").alias("tail"), "segment_id")
    both = left.join(right, "segment_id").filter("head <> tail").groupBy("head", "tail").agg(F.count("*").alias("n_both"))
    j = (
        edges.join(pairs.join(both, ["head", "tail"], "left"), ["head", "tail"])
        .join(n.select(F.col("key").alias("head"), F.col("n").alias("n_head")), "head", "left")
        .join(n.select(F.col("key").alias("tail"), F.col("n").alias("n_tail")), "tail", "left"))
    total = F.lit(total_segments) if not isinstance(total_segments, Column) else total_segments
    p = [F.coalesce(c, F.lit(0)) / total for c in ("n_head", "n_tail", "n_both")]
    return j.withColumn("npmi", F.round(npmi(*p), 9)).drop("n_head", "n_tail", "n_both")


def _one_type_pairs(one: DataFrame, patterns: list[tuple[str, str, str]], hubs: DataFrame, ends: dict[str, str]) -> DataFrame:
    """Counted pairs of keys that have one type each: by ``ends`` of both sides and their types, with cooccur and first_segment.

    ``one``: (segment_id, type, key, ...), each once; ``ends``: its columns that tell entities apart, with their names after
    "head" and "tail". Only types that a pattern has are paired. A hub's tails lie in chunks, its heads go to each of them; hubs
    are few and handed to every task.
    """
    placed = one.join(F.broadcast(hubs), "segment_id", "left")
    chunks = F.coalesce("chunks", F.lit(1))

    def side(place: int, end: str, chunk: Column) -> DataFrame:
        wanted = {p[place] for p in patterns}
        rows = placed if WILDCARD in wanted else placed.where(F.col("type").isin(*wanted))
        kind = F.lit(next(iter(wanted))) if len(wanted) == 1 and WILDCARD not in wanted else F.col("type")
        return rows.select("segment_id", kind.alias(f"{end}_type"), F.col("key").alias(f"{end}_key"),
                           *[F.col(c).alias(end + name) for c, name in ends.items()], chunk.alias("chunk"))

    heads = side(1, "head", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tails = side(2, "tail", F.pmod(F.xxhash64("key"), chunks).cast("int"))
    met = heads.join(tails, ["segment_id", "chunk"]).where((F.col("head_key") != F.col("tail_key")) & fits_pattern(patterns))
    by = [end + name for name in (*ends.values(), "_type") for end in ("head", "tail")]
    return met.groupBy(*by).agg(F.count("*").alias("cooccur"), F.min("segment_id").alias("first_segment"))


def _prepared(refs: DataFrame, hub: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Refs each once, those of them whose key has one type, hub segments, and the keys of several types or None."""
    refs = refs.filter(F.length("key") > 0).select("segment_id", "type", "key")
    one = refs.distinct()
    hubs = refs.groupBy("segment_id").agg(F.count("*").alias("n")).where(F.col("n") > hub).select(
        "segment_id", F.ceil(F.col("n") / hub).cast("int").alias("chunks"))
    types = refs.select("key", "type").distinct().groupBy("key").agg(F.count("*").alias("types"))
    mixed = cut_lineage(types.where("types > 1").select("key"))
    if mixed.isEmpty():
        return one, one, hubs, None
    return one, one.join(mixed, "key", "left_anti"), hubs, mixed


def _mixed_pairs(one: DataFrame, mixed: DataFrame) -> DataFrame:
    """Pairs with a key of several types at either end."""
    around = one.join(one.join(mixed, "key", "left_semi").select("segment_id").distinct(), "segment_id", "left_semi")
    return co_mentions(around).join(
        mixed.select(F.col("key").alias("head"), F.lit(True).alias("h")), "head", "left").join(
        mixed.select(F.col("key").alias("tail"), F.lit(True).alias("t")), "tail", "left").where("h or t")


def co_mention_edges(refs: DataFrame, patterns: list[tuple[str, str, str]], hub: int = HUB_EDGES) -> DataFrame:
    """Edges of co-mentioned entities that fit a pattern: what ``aggregate_edges`` makes of all their ``candidate_relations``.

    Pairs of keys of one type need no look at their segment, so they are counted by their ends and types before they are
    shuffled, once.
    """
    columns = ["head", "relation_type", "tail", "head_type", "tail_type", "cooccur", "first_segment"]
    one, single, hubs, mixed = _prepared(refs, hub)
    edges = with_relations(_one_type_pairs(single, patterns, hubs, {"key": ""}), patterns).select(*columns)
    if mixed is None:
        return edges
    return edges.unionByName(aggregate_edges(candidate_relations(_mixed_pairs(one, mixed), patterns)).select(*columns))


def strong_edges(refs: DataFrame, patterns: list[tuple[str, str, str]], total_segments: int | Column, hub: int = HUB_EDGES,
                 entities: DataFrame | None = None) -> DataFrame:
    """Edges of co-mentioned entities that fit a pattern, with ``cooccur`` and ``npmi``, from one pass over the pairs.

    ``refs``: (segment_id, type, key). Entities are paired only where a pattern has their types, and a segment of very many
    tails is paired in chunks. How many segments a key has, and the ``entity_id`` that ``entities`` (entity_id, node_type,
    canonical_name) give it, are joined to the refs; pairs bring both along and are shuffled once, after they are counted. With
    ``entities`` only edges between these are returned, by ``head_id`` and ``tail_id`` instead of ``head`` and ``tail``. Keys that
    occur under several types are few; their pairs of any type count for the strength, so they go by ``co_mentions``.
    """
    one, single, hubs, mixed = _prepared(refs, hub)
    n = single.groupBy("key", "type").agg(F.count("*").alias("n"))
    named = None if entities is None else entities.select(F.col("node_type").alias("type"), F.col("canonical_name").alias("key"), F.col("entity_id").alias("id"))
    ends = {"key": "", "n": "_n"} if named is None else {"id": "_id", "n": "_n"}
    known = (n if named is None else n.join(named, ["type", "key"])).drop("type")
    columns = ["relation_type", "cooccur", "first_segment", "n_both", *[end + c for c in (*ends.values(), "_type") for end in ("head", "tail")]]
    counted = _one_type_pairs(single.join(known, "key"), patterns, hubs, ends).withColumn("n_both", F.col("cooccur"))
    edges = with_relations(counted, patterns).select(*columns)
    if mixed is not None:
        pairs = _mixed_pairs(one, mixed)
        both = pairs.groupBy("head", "tail").agg(F.count_distinct("segment_id").alias("n_both"))
        other = aggregate_edges(candidate_relations(pairs, patterns)).join(both, ["head", "tail"])
        size = one.groupBy("key").agg(F.count_distinct("segment_id").alias("n"))
        for end in ("head", "tail"):
            other = other.join(size.select(F.col("key").alias(end), F.col("n").alias(f"{end}_n")), end)
            if named is not None:
                other = other.join(named.select(*[F.col(c).alias(f"{end}_{c}") for c in ("type", "id")], F.col("key").alias(end)), [end, f"{end}_type"])
        edges = edges.unionByName(other.select(*columns))
    total = F.lit(total_segments) if not isinstance(total_segments, Column) else total_segments
    return edges.withColumn("npmi", F.round(npmi(*[F.col(c) / total for c in ("head_n", "tail_n", "n_both")]), 9)).drop("head_n", "tail_n", "n_both")


def kept_edges(edges: DataFrame, entities: DataFrame | None = None, floor: float = NPMI_FLOOR) -> DataFrame:
    """Fact edges: strong enough, with evidence, between different confirmed entities; confidence from NPMI.

    Without ``entities`` the edges have ``head_id`` and ``tail_id`` already (see ``strong_edges``).
    """
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("npmi") + 1) / 2)), 6)
    strong = edges.filter((F.col("npmi") >= floor) & (F.col("cooccur") > 0))
    if entities is not None:
        h = entities.select(F.col("node_type").alias("head_type"), F.col("canonical_name").alias("head"), F.col("entity_id").alias("head_id"))
        t = entities.select(F.col("node_type").alias("tail_type"), F.col("canonical_name").alias("tail"), F.col("entity_id").alias("tail_id"))
        strong = strong.join(h, ["head_type", "head"]).join(t, ["tail_type", "tail"])
    return strong.filter("head_id <> tail_id").select("head_id", "tail_id", "relation_type", confidence.alias("confidence"), "cooccur")


def off_schema_candidates(pairs: DataFrame, examples: int = 5) -> DataFrame:
    """Type pairs outside the schema with their count and a few distinct examples (the smallest).

    Examples are picked by a ranked cut per type pair, so the full example set is never gathered.
    """
    counts = pairs.groupBy("head_type", "tail_type").agg(F.count("*").alias("cooccur"))
    one = pairs.select("head_type", "tail_type", F.struct("head", "tail").alias("e")).distinct()
    w = W.partitionBy("head_type", "tail_type").orderBy("e")
    few = one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= examples).groupBy("head_type", "tail_type").agg(
        F.array_sort(F.collect_list("e")).alias("examples"))
    return counts.join(few, ["head_type", "tail_type"]).select(
        F.concat("head_type", F.lit("->"), "tail_type").alias("proposed_name"), "cooccur", "examples")


def off_schema_summary(refs: DataFrame, patterns: list[tuple[str, str, str]], examples: int = 5) -> DataFrame:
    """What ``off_schema_candidates`` makes of all pairs of ``refs`` (segment_id, type, key) outside the schema, without making them.

    A segment's pairs of a head with a type are its keys of that type, less the head's own. Heads are counted, and only the
    ``examples`` smallest heads of each type pair, handed to every task, are paired for its examples.
    """
    one = refs.filter(F.length("key") > 0).select("segment_id", "type", "key").distinct()
    kinds = one.groupBy("segment_id", F.col("type").alias("tail_type")).agg(F.count("*").alias("n"))
    there = kinds.groupBy("segment_id").agg(F.collect_list(F.struct("tail_type", "n")).alias("kinds"))
    own = one.groupBy("segment_id", F.col("key").alias("head")).agg(F.collect_set("type").alias("own"))
    met = own.join(there, "segment_id").select("head", "own", F.explode("own").alias("head_type"), "kinds").select(
        "head", "own", "head_type", F.explode("kinds").alias("k")).select(
        "head", "head_type", F.col("k.tail_type").alias("tail_type"),
        (F.col("k.n") - F.when(F.array_contains("own", F.col("k.tail_type")), 1).otherwise(0)).alias("n"))
    outside = ~fits_pattern(patterns)
    heads = cut_lineage(met.where(outside & (F.col("n") > 0)).groupBy("head_type", "tail_type", "head").agg(F.sum("n").alias("n")))
    counts = heads.groupBy("head_type", "tail_type").agg(F.sum("n").alias("cooccur"))
    w = W.partitionBy("head_type", "tail_type").orderBy("head")
    first = heads.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).select("head_type", "tail_type", "head")
    near = one.join(F.broadcast(first.withColumnsRenamed({"head_type": "type", "head": "key"})), ["type", "key"]).select(
        "segment_id", F.col("type").alias("head_type"), "tail_type", F.col("key").alias("head"))
    pairs = near.join(one.select("segment_id", F.col("type").alias("tail_type"), F.col("key").alias("tail")), ["segment_id", "tail_type"]).where("head <> tail")
    few = pairs.select("head_type", "tail_type", F.struct("head", "tail").alias("e")).distinct().withColumn(
        "r", F.row_number().over(W.partitionBy("head_type", "tail_type").orderBy("e"))).where(F.col("r") <= examples).groupBy("head_type", "tail_type").agg(
        F.array_sort(F.collect_list("e")).alias("examples"))
    return counts.join(few, ["head_type", "tail_type"]).select(
        F.concat("head_type", F.lit("->"), "tail_type").alias("proposed_name"), "cooccur", "examples")


def rebuild_edges(mentions: DataFrame, entities: DataFrame, patterns: list, total_segments, floor: float = NPMI_FLOOR) -> DataFrame:
    """Edges from confirmed mentions with the entity's present type and name.

    ``mentions``: (segment_id, entity_id, resolve_status); ``entities``: (entity_id, node_type, canonical_name).
    """
    m = mentions.filter(F.col("resolve_status").isin(*CONFIRMED)).select("segment_id", "entity_id").join(
        entities.select("entity_id", "node_type", "canonical_name"), "entity_id")
    refs = m.select("segment_id", F.col("node_type").alias("type"), F.col("canonical_name").alias("key"))
    return kept_edges(strong_edges(refs, patterns, total_segments, entities=entities), floor=floor)


def scoped_recompute(changed: DataFrame, old_edges: DataFrame, mentions: DataFrame, entities: DataFrame, patterns: list,
                     total_segments, floor: float = NPMI_FLOOR) -> DataFrame:
    """Edges after a change: recomputed around the changed entities, the rest carried over.

    The recomputed set is every entity sharing a segment with a changed one. Old edges inside the set
    are replaced by new ones with both ends inside it; strength always uses the whole corpus.
    """
    ok = mentions.filter(F.col("resolve_status").isin(*CONFIRMED))
    touched = ok.join(changed, "entity_id", "left_semi").select("segment_id").distinct()
    scope = cut_lineage(ok.join(touched, "segment_id", "left_semi").select("entity_id").unionByName(changed).distinct())
    near = rows_of(ok, scope, "entity_id")
    fresh = rebuild_edges(near, entities, patterns, total_segments, floor)
    for end in ("head_id", "tail_id"):
        fresh = rows_of(fresh, scope.withColumnRenamed("entity_id", end), end)
    few = at_most(scope, 500_000)
    kept = old_edges
    for end in ("head_id", "tail_id"):
        mark = scope.select(F.col("entity_id").alias(end), F.lit(True).alias(f"_{end}"))
        kept = kept.join(F.broadcast(mark) if few else mark, end, "left")
    kept = kept.where("_head_id is null or _tail_id is null").select(old_edges.columns)
    return kept.unionByName(fresh.select(old_edges.columns))


def replace_snapshots(old: DataFrame, new: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Replace all rows of the snapshots found in ``new``; running it twice changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def recount(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Counts of every entity from its confirmed mentions; 0 where none is left."""
    c = mentions.filter(F.col("resolve_status").isin(*CONFIRMED)).groupBy("entity_id").agg(
        F.count("*").alias("mention_count"), F.count_distinct("snapshot_id").alias("document_count"))
    return entities.drop("mention_count", "document_count").join(c, "entity_id", "left").na.fill(0, ["mention_count", "document_count"])


def merge_roots(merges: DataFrame, rounds: int = 20) -> DataFrame:
    """Final target of chained merges (drop_id -> primary_id), by pointer doubling.

    Every round doubles the length of the chains resolved, so ``rounds`` bounds chains of 2^rounds; the
    loop stops as soon as nothing moves. Merges in a circle of three or more have no root and never settle:
    that is an error. Of a pair merged into each other each keeps the other.
    """
    m = merges.filter("drop_id <> primary_id").groupBy("drop_id").agg(F.min("primary_id").alias("primary_id"))
    for _ in range(rounds):
        nxt = m.select(F.col("drop_id").alias("primary_id"), F.col("primary_id").alias("next_id"))
        step = m.join(nxt, "primary_id", "left")
        if step.filter("next_id IS NOT NULL AND next_id <> primary_id AND next_id <> drop_id").isEmpty():
            break
        m = step.select("drop_id", F.when(F.col("next_id") == F.col("drop_id"), F.col("primary_id")).otherwise(
            F.coalesce("next_id", "primary_id")).alias("primary_id"))
        m = cut_lineage(m)
    else:
        raise ValueError("merges form a circle, or a chain longer than the rounds allow")
    return m


def repoint(table: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Rewrite an id column through a merge map."""
    r = roots.select(F.col("drop_id").alias(column), F.col("primary_id").alias("_to"))
    return table.join(r, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(table.columns)


def merge_entities(roots: DataFrame, entities: DataFrame, mentions: DataFrame, evidence: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Apply merges: mentions and evidence follow, dropped entities and their edges go, counts are redone."""
    gone = roots.select(F.col("drop_id").alias("entity_id"))
    m = repoint(mentions, roots, "entity_id")
    e = edges
    for end in ("head_id", "tail_id"):
        e = e.join(gone.withColumnRenamed("entity_id", end), end, "left_anti")
    return {
        "mentions": m, "evidence": repoint(evidence, roots, "entity_id"),
        "edges": e.select(edges.columns), "entities": recount(entities.join(gone, "entity_id", "left_anti"), m)}


def retype_entities(entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New types for entities: (entities, merges). A change that meets an existing (type, name) is a merge.

    ``decisions``: (entity_id, new_type). Two decisions that give two entities the same new identity keep
    the smaller id.
    """
    d = decisions.join(entities.select("entity_id", "node_type", "canonical_name"), "entity_id").filter("node_type <> new_type")
    taken = entities.join(d.select("entity_id"), "entity_id", "left_anti").select(
        F.col("node_type").alias("new_type"), "canonical_name", F.col("entity_id").alias("holder"))
    first = d.groupBy("new_type", "canonical_name").agg(F.min("entity_id").alias("first"))
    j = d.join(taken, ["new_type", "canonical_name"], "left").join(first, ["new_type", "canonical_name"])
    target = F.coalesce("holder", "first")
    merges = j.filter(target != F.col("entity_id")).select(F.col("entity_id").alias("drop_id"), target.alias("primary_id"))
    moved = j.filter(target == F.col("entity_id")).select("entity_id", "new_type")
    out = entities.join(moved, "entity_id", "left").withColumn("node_type", F.coalesce("new_type", "node_type")).drop("new_type")
    return out.select(entities.columns), merges


def delete_entities(ids: DataFrame, entities: DataFrame, mentions: DataFrame, evidence: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Remove entities with their mentions, evidence and edges."""
    e = edges
    for end in ("head_id", "tail_id"):
        e = e.join(ids.select(F.col("entity_id").alias(end)), end, "left_anti")
    return {
        "entities": entities.join(ids, "entity_id", "left_anti"), "mentions": mentions.join(ids, "entity_id", "left_anti"),
        "evidence": evidence.join(ids, "entity_id", "left_anti"), "edges": e.select(edges.columns)}


def rebind_untyped(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Give untyped member entities their accepted type, unless the (type, name) is taken.

    ``candidates``: (proposed_name, status, member_ids ARRAY).
    """
    want = candidates.filter(f"status = 'accepted' AND proposed_name <> '{UNTYPED}'").select(
        F.explode("member_ids").alias("entity_id"), F.col("proposed_name").alias("new_type")).groupBy("entity_id").agg(F.min("new_type").alias("new_type"))
    names = entities.select(F.col("node_type").alias("new_type"), "canonical_name").distinct().withColumn("taken", F.lit(True))
    j = entities.join(want, "entity_id", "left").join(names, ["new_type", "canonical_name"], "left")
    move = (F.col("node_type") == UNTYPED) & F.col("new_type").isNotNull() & F.col("taken").isNull()
    j = j.withColumn("move", F.coalesce(move, F.lit(False)))
    first = j.filter("move").groupBy("new_type", "canonical_name").agg(F.min("entity_id").alias("first"))
    return j.join(first, ["new_type", "canonical_name"], "left").withColumn(
        "node_type", F.when(F.col("move") & (F.col("first") == F.col("entity_id")), F.col("new_type")).otherwise(F.col("node_type"))).select(entities.columns)


def type_candidates(entities: DataFrame, proposals: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """Proposed types matched to confirmed entities by name; those covering too few documents are dropped.

    ``proposals``: (type_name, members ARRAY<STRING>). The floor shrinks with a small corpus: it is
    min(min_df, max(largest document count, 1)).
    """
    e = entities.select(F.lower(tx.strip(F.col("canonical_name"))).alias("n"), "entity_id", "document_count", "mention_count")
    by_name = e.groupBy("n").agg(F.max_by(F.struct("entity_id", "document_count", "mention_count"), "entity_id").alias("e"))
    corpus = entities.agg(F.greatest(F.max("document_count"), F.lit(1))).scalar()
    p = proposals.filter(F.length(tx.strip(F.col("type_name"))) > 0).select(
        tx.strip(F.col("type_name")).alias("type_name"), F.explode("members").alias("member")).withColumn("n", F.lower(tx.strip(F.col("member"))))
    m = p.join(by_name, "n").select("type_name", "e.*").dropDuplicates(["type_name", "entity_id"])
    return m.groupBy("type_name").agg(
        F.count("*").alias("members"), F.sum("document_count").alias("df"), F.sum("mention_count").alias("support")).filter(
        F.col("df") >= F.least(F.lit(min_df), corpus))


def squeezed(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\s+", ""))


def duplicate_types(proposals: DataFrame, types: DataFrame) -> DataFrame:
    """Existing type each proposal repeats: equal, containing, contained, or one of its examples; first by name.

    ``types``: (name, examples ARRAY). Both containments are found through shared grams, not by comparing
    every proposal with every type.
    """
    p = proposals.select("proposed_name", squeezed(F.col("proposed_name")).alias("p")).filter(F.length("p") > 0)
    t = types.select("name", squeezed(F.col("name")).alias("t"), F.transform(F.coalesce("examples", F.array().cast("array<string>")), squeezed).alias("ex")).filter(
        F.length("t") > 0)
    inner = containing(t.select(F.col("t").alias("term")), p.select(F.col("p").alias("id"), F.col("p").alias("text")).distinct())
    outer = containing(p.select(F.col("p").alias("term")), t.select(F.col("t").alias("id"), F.col("t").alias("text")).distinct())
    pairs = inner.select(F.col("id").alias("p"), F.col("term").alias("t")).unionByName(outer.select(F.col("term").alias("p"), F.col("id").alias("t"))).distinct()
    by_name = p.join(pairs, "p").join(t.select("name", "t"), "t").select("proposed_name", "name")
    by_example = p.join(t.select("name", F.explode("ex").alias("p")), "p").select("proposed_name", "name")
    return by_name.unionByName(by_example).groupBy("proposed_name").agg(F.min("name").alias("duplicate_of"))


def suggest_entities(mentions: DataFrame, entities: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """Entities of a mention's type whose name contains it or is contained in it, most mentioned first.

    ``mentions``: (mention_id, mention_text, node_type).
    """
    m = mentions.filter(F.length("mention_text") > 0).withColumn("mt", F.lower("mention_text"))
    e = entities.withColumn("en", F.lower("canonical_name"))
    up = containing(m.select(F.col("mt").alias("term")), e.select(F.col("en").alias("id"), F.col("en").alias("text")).distinct())
    down = containing(e.select(F.col("en").alias("term")), m.select(F.col("mt").alias("id"), F.col("mt").alias("text")).distinct())
    pairs = up.select(F.col("term").alias("mt"), F.col("id").alias("en")).unionByName(down.select(F.col("id").alias("mt"), F.col("term").alias("en"))).distinct()
    # Ranked once per distinct (text, type), then handed to every mention that reads so.
    texts = m.select("mt", "node_type").distinct()
    j = texts.join(pairs, "mt").join(e, ["en", "node_type"]).select("mt", "node_type", "entity_id", "canonical_name", "mention_count")
    w = W.partitionBy("mt", "node_type").orderBy(F.col("mention_count").desc(), "entity_id")
    best = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return m.select("mention_id", "mt", "node_type").join(best, ["mt", "node_type"]).select(
        "mention_id", "entity_id", "canonical_name", "mention_count", "rank")


def reachable(seeds: DataFrame, edges: DataFrame, hops: int, hub: int = HUB_EDGES) -> DataFrame:
    """Entities within ``hops`` undirected hops of each seed; the frontier holds new nodes only, and meets hubs chunk by chunk."""
    both, hubs = split_hubs(symmetric(edges.select("head_id", "tail_id"), "head_id", "tail_id").distinct(), "src", hub)
    seen = seeds.select("seed_id", F.col("seed_id").alias("entity_id")).distinct()
    front = seen
    for _ in range(hops):
        nxt = meet(front, "entity_id", both, hubs, "src").select("seed_id", F.col("dst").alias("entity_id")).distinct()
        front = nxt.join(seen, ["seed_id", "entity_id"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def neighbourhood_edges(seeds: DataFrame, edges: DataFrame, hops: int, hub: int = HUB_EDGES) -> DataFrame:
    """All edges with an end among the reached entities (one hop beyond the reach)."""
    r = reachable(seeds, edges, hops, hub)
    parts = []
    for end in ("head_id", "tail_id"):
        adjacency, hubs = split_hubs(edges, end, hub)
        parts.append(meet(r, "entity_id", adjacency, hubs, end).select("seed_id", *edges.columns))
    return parts[0].unionByName(parts[1]).distinct()


def neighbourhood_nodes(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities touched by the edges of each neighbourhood."""
    ends = edges.select("seed_id", F.col("head_id").alias("entity_id")).union(edges.select("seed_id", "tail_id")).distinct()
    return ends.join(entities, "entity_id")


def best_quotes(mentions: DataFrame, segments: DataFrame, window: int = 80) -> DataFrame:
    """One quote per entity: a text that holds the mention before one that does not, then the shortest."""
    j = mentions.filter(F.col("entity_id").isNotNull() & (F.length("mention_text") > 0)).join(
        segments.select("segment_id", "raw_text"), "segment_id").filter(F.length("raw_text") > 0)
    pos = F.instr("raw_text", F.col("mention_text"))
    order = F.struct((pos == 0).alias("missing"), F.length("raw_text").alias("n"), "segment_id", "mention_text")
    best = j.groupBy("entity_id").agg(F.min_by(F.struct("mention_text", "raw_text"), order).alias("b")).select("entity_id", "b.*")
    around = tx.window_around(F.col("raw_text"), F.col("mention_text"), window, window, "…")
    head = tx.strip(F.substring("raw_text", 1, 2 * window))
    return best.select("entity_id", F.col("mention_text").alias("mention"), F.when(around != "", around).otherwise(head).alias("quote"))


def entity_members(entities: DataFrame, mentions: DataFrame, chunk: int = 1000) -> DataFrame:
    """Entities with their distinct mentions as a nested list; an empty list when there is none.

    An entity with very many mentions gets several rows of about ``chunk`` members each, spread by a hash
    of the segment, so no list grows without bound. Ordinary entities have the single chunk 0.
    """
    m = mentions.filter("entity_id IS NOT NULL").groupBy("entity_id", "segment_id", "mention_text").agg(F.count("*").alias("n"))
    chunks = m.groupBy("entity_id").agg(F.ceil(F.count("*") / chunk).cast("bigint").alias("chunks"))
    c = m.join(chunks, "entity_id").withColumn("chunk", F.pmod(F.xxhash64("segment_id"), F.col("chunks")))
    lists = c.groupBy("entity_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("segment_id", "mention_text", "n"))).alias("members"))
    out = entities.join(lists, "entity_id", "left")
    none = F.filter(F.array(F.struct(F.lit(None).cast("bigint").alias("segment_id"), F.lit("").alias("mention_text"), F.lit(0).cast("bigint").alias("n"))),
                    lambda x: F.lit(False))
    return out.withColumn("chunk", F.coalesce("chunk", F.lit(0))).withColumn("members", F.coalesce("members", none))


def upsert_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Next candidate table: a known (domain, kind, name) takes the new score but keeps its review status."""
    key = ["domain", "kind", "proposed_name"]
    n = new.select(*key, F.col("score").alias("new_score"))
    return old.join(n, key, "full_outer").select(
        *key, F.coalesce("new_score", "score").alias("score"), F.coalesce("status", F.lit("proposed")).alias("status"))


def review_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (domain, kind, proposed_name, action, new_name) to candidates still proposed."""
    key = ["domain", "kind", "proposed_name"]
    j = candidates.join(decisions, key, "left")
    open_ = (F.col("status") == "proposed") & F.col("action").isin("accept", "reject")
    return j.select("domain", "kind", F.when(open_ & F.col("new_name").isNotNull(), F.col("new_name")).otherwise(F.col("proposed_name")).alias("proposed_name"),
                    "score", F.when(open_ & (F.col("action") == "accept"), "accepted").when(open_, "rejected").otherwise(F.col("status")).alias("status"))


def promote_accepted(types: DataFrame, candidates: DataFrame) -> DataFrame:
    """Types of the next version of each domain with accepted candidates: the old active types and the new ones.

    ``types``: (domain, version_no, kind, name) of the active versions.
    """
    new = candidates.filter("status = 'accepted'").select("domain", "kind", F.col("proposed_name").alias("name")).distinct()
    version = types.groupBy("domain").agg(F.max("version_no").alias("v"))
    promoted = new.select("domain").distinct()
    old = types.join(promoted, "domain", "left_semi").select("domain", "kind", "name")
    return old.unionByName(new).distinct().join(version, "domain", "left").select(
        "domain", (F.coalesce("v", F.lit(0)) + 1).alias("version_no"), "kind", "name")


def list_entities(entities: DataFrame, node_type: str | None = None, name: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of entities by mention count; ``name`` matches anywhere, ignoring case."""
    return matching_entities(entities, node_type, name).orderBy(F.col("mention_count").desc_nulls_last(), "canonical_name").offset(offset).limit(limit)


def matching_entities(entities: DataFrame, node_type: str | None = None, name: str | None = None) -> DataFrame:
    e = entities if node_type is None else entities.filter(F.col("node_type") == node_type)
    return e if name is None else e.filter(F.col("canonical_name").ilike(f"%{name}%"))


def review_mentions(mentions: DataFrame, decisions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply merge / new / reject to mentions: (mentions, entities, added evidence).

    ``decisions``: (mention_id, action, target_id). A new entity is identified by type and name, so equal
    ones fold together and an existing one is reused.
    """
    names = entities.select(F.col("entity_id").alias("target_id"), F.col("canonical_name").alias("target_name"))
    known = entities.select("node_type", F.col("canonical_name").alias("mention_text"), F.col("entity_id").alias("known_id"))
    j = mentions.join(decisions, "mention_id", "left").join(names, "target_id", "left").join(known, ["node_type", "mention_text"], "left")
    fresh_id = F.concat_ws(":", F.lit("new"), "node_type", "mention_text")
    is_merge, is_new = F.col("action") == "merge", F.col("action") == "new"
    eid = F.when(is_merge & F.col("target_name").isNotNull(), F.col("target_id")).when(is_new, F.coalesce("known_id", fresh_id)).when(
        F.col("action") == "reject", F.lit(None)).otherwise(F.col("entity_id"))
    done = (is_merge & F.col("target_name").isNotNull()) | is_new
    status = F.when(done, "human").when(F.col("action") == "reject", "rejected").otherwise(F.col("resolve_status"))
    r = j.withColumn("_eid", eid).withColumn("_status", status).withColumn("_done", F.coalesce(done, F.lit(False)))
    out = r.select("mention_id", "snapshot_id", "segment_id", "node_type", "mention_text", F.col("_eid").alias("entity_id"), F.col("_status").alias("resolve_status"))
    added = r.filter((F.col("action") == "new") & F.col("known_id").isNull()).select(
        F.col("_eid").alias("entity_id"), "node_type", F.col("mention_text").alias("canonical_name")).distinct()
    evidence = r.filter("_done").select(F.col("_eid").alias("entity_id"), "snapshot_id", "segment_id", F.col("mention_text").alias("quote"))
    ents = recount(entities.select("entity_id", "node_type", "canonical_name").unionByName(added), out)
    return out, ents, evidence


def pending_mentions(mentions: DataFrame, segments: DataFrame, run_documents: DataFrame | None = None) -> DataFrame:
    """Mentions waiting for review with the text of their segment; of one set of run documents if given."""
    p = mentions.filter("resolve_status = 'pending'").join(segments, "segment_id", "left")
    return p if run_documents is None else p.join(run_documents.select("run_id", "snapshot_id"), "snapshot_id")


def evidence_back_links(evidence: DataFrame, segments: DataFrame, kind: str) -> DataFrame:
    """Evidence of one kind of target with the source text."""
    return evidence.filter(F.col("target_kind") == kind).join(segments, "segment_id", "left")


def next_versions(versions: DataFrame) -> DataFrame:
    """Per domain: active version, draft version and the next free number."""
    return versions.groupBy("domain").agg(
        F.max(F.when(F.col("status") == "active", F.col("version_no"))).alias("active_version"),
        F.max(F.when(F.col("status") == "draft", F.col("version_no"))).alias("draft_version"), (F.max("version_no") + 1).alias("next_version"))


def publish_drafts(versions: DataFrame, domains: DataFrame) -> DataFrame:
    """Activate the latest draft of the given domains; their active version is superseded."""
    draft = versions.filter("status = 'draft'").join(domains, "domain", "left_semi").groupBy("domain").agg(F.max("version_no").alias("pub"))
    j = versions.join(draft, "domain", "left")
    status = F.when(F.col("version_no") == F.col("pub"), "active").when(F.col("pub").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return j.withColumn("status", status).select(versions.columns)


def replace_draft(types: DataFrame, draft_types: DataFrame, drafts: DataFrame) -> DataFrame:
    """Replace all types of the given draft versions (domain, version_no)."""
    return types.join(drafts, ["domain", "version_no"], "left_anti").unionByName(draft_types)


def active_types(types: DataFrame, versions: DataFrame) -> DataFrame:
    """Types of the active version of each domain."""
    return types.join(versions.filter("status = 'active'").select("domain", "version_no"), ["domain", "version_no"], "left_semi")


