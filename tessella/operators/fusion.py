"""Rank fusion, reranking from score tables, and the clean-up of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx

# Fixed values.
RRF_K = 60
MIN_SCORE = 0.01
LOW_VALUE_TYPES = ("heading", "toc", "link")
LOW_VALUE_FACTOR = 0.5
TEXT_SIMILARITY = 0.9
LLM_WINDOW = 20
RERANK_DOC_CHARS = 4096
RERANK_BATCH_DOCS = 128
RERANK_BATCH_CHARS = 28000


def ranked(df: DataFrame, order: list[Column], by: str = "query_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)))


def identity(candidates: DataFrame) -> DataFrame:
    """Best score per unit with the route it came from."""
    best = F.max_by("route", F.struct("score", "route"))
    return candidates.groupBy("query_id", "unit_id").agg(F.max("score").alias("fusion_score"), best.alias("route"))


def rrf(candidates: DataFrame, k: int = RRF_K, weighted: bool = False, dedupe_variants: bool = False) -> DataFrame:
    """Reciprocal rank fusion over the routes of each query: sum of weight / (k + rank).

    Ranks are taken inside (query, route). With ``dedupe_variants`` a unit found twice by one route
    counts once, at its best score.
    """
    c = candidates
    if dedupe_variants:
        extra = [F.max("weight").alias("weight")] if "weight" in c.columns else []
        c = c.groupBy("query_id", "route", "unit_id").agg(F.max("score").alias("score"), *extra)
    w = W.partitionBy("query_id", "route").orderBy(F.col("score").desc(), "unit_id")
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if weighted else F.lit(1.0)
    return (
        c.withColumn("r", F.row_number().over(w))
        .groupBy("query_id", "unit_id")
        .agg(
            F.round(F.sum(weight / (k + F.col("r"))), 9).alias("fusion_score"),
            F.max("score").alias("raw_score"),
            F.array_sort(F.collect_set("route")).alias("route_sources"),
        )
    )


def score_rerank(candidates: DataFrame, threshold: float | None = None) -> DataFrame:
    """Order by score, optionally above a threshold."""
    kept = candidates if threshold is None else candidates.filter(F.col("score") >= threshold)
    return ranked(kept, [F.col("score").desc(), F.col("unit_id")])


def apply_model_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Model scores first; candidates the model did not return, or with blank text, keep their order after.

    ``candidates`` carries ``rank`` (old order), ``score`` and ``text``; ``scores`` has (query_id, unit_id,
    model_score).
    """
    best = scores.groupBy("query_id", "unit_id").agg(F.max("model_score").alias("model_score"))
    j = candidates.join(best, ["query_id", "unit_id"], "left")
    seen = F.when(F.col("text").rlike(r"\S"), F.col("model_score"))
    j = j.withColumn("score", F.coalesce(seen, "score")).withColumn("scored", seen.isNotNull())
    order = [F.col("scored").desc(), F.when(F.col("scored"), F.col("score")).desc_nulls_last(), F.col("rank")]
    return ranked(j, order, name="new_rank").select("query_id", "unit_id", "score", "scored", F.col("new_rank").alias("rank"))


def apply_ranking(candidates: DataFrame, rankings: DataFrame, window: int = LLM_WINDOW) -> DataFrame:
    """Reorder the first ``window`` candidates by a ranking list of (index, score) entries.

    Indices outside the window and repeats are ignored; unranked candidates of the window follow,
    then the rest, each in old order. ``rankings`` has (query_id, ranking ARRAY<STRUCT<index, score>>).
    """
    sizes = candidates.groupBy("query_id").agg(F.least(F.count("*"), F.lit(window)).alias("n"))
    entries = (
        rankings.select("query_id", F.posexplode("ranking").alias("pos", "e"))
        .select("query_id", "pos", F.col("e.index").alias("index"), F.col("e.score").alias("new_score"))
        .join(sizes, "query_id").filter((F.col("index") >= 0) & (F.col("index") < F.col("n")))
        .groupBy("query_id", "index")
        .agg(F.min("pos").alias("pos"), F.min_by("new_score", "pos").alias("new_score"))
    )
    j = candidates.withColumn("index", F.col("rank") - 1).join(entries, ["query_id", "index"], "left")
    tier = F.when(F.col("pos").isNotNull(), 0).otherwise(1)
    j = j.withColumn("score", F.coalesce("new_score", "score")).withColumn("ranked", F.col("pos").isNotNull())
    return ranked(j, [tier, F.col("pos"), F.col("rank")], name="new_rank").select(
        "query_id", "unit_id", "score", "ranked", F.col("new_rank").alias("rank"))


def rerank_cascade(candidates: DataFrame, scores: DataFrame, rankings: DataFrame, methods: DataFrame) -> DataFrame:
    """Per query: model scores if any, else a ranking if the plan allows it, else the score order.

    ``methods`` has (query_id, method); rankings are used for the methods ``llm`` and ``cascade``.
    """
    q = candidates.select("query_id").distinct()
    model_q = q.join(scores.select("query_id").distinct(), "query_id", "left_semi")
    rest = q.join(model_q, "query_id", "left_anti")
    allowed = methods.filter(F.col("method").isin("llm", "cascade")).select("query_id")
    llm_q = rest.join(rankings.filter(F.size("ranking") > 0).select("query_id"), "query_id", "left_semi").join(
        allowed, "query_id", "left_semi")
    score_q = rest.join(llm_q, "query_id", "left_anti")
    cols = ["query_id", "unit_id", "score", "rank"]
    one = apply_model_scores(candidates.join(model_q, "query_id", "left_semi"), scores).select(*cols).withColumn("tier", F.lit("model"))
    two = apply_ranking(candidates.join(llm_q, "query_id", "left_semi"), rankings).select(*cols).withColumn("tier", F.lit("llm"))
    three = score_rerank(candidates.join(score_q, "query_id", "left_semi").drop("rank")).select(*cols).withColumn("tier", F.lit("score"))
    return one.unionByName(two).unionByName(three)


def best_per_segment(candidates: DataFrame) -> DataFrame:
    """Best candidate of each source segment; candidates without a segment all stay."""
    has = candidates.filter(F.col("segment_id").isNotNull())
    w = W.partitionBy("query_id", "segment_id").orderBy(F.col("score").desc(), "unit_id")
    kept = has.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return kept.unionByName(candidates.filter(F.col("segment_id").isNull()))


def downweight(candidates: DataFrame) -> DataFrame:
    """Halve the score of headings, tables of contents and links."""
    low = F.col("unit_type").isin(*LOW_VALUE_TYPES)
    return candidates.withColumn("score", F.when(low, F.col("score") * LOW_VALUE_FACTOR).otherwise(F.col("score")))


def drop_similar_texts(candidates: DataFrame, threshold: float = TEXT_SIMILARITY) -> DataFrame:
    """Greedy removal of near-equal texts inside each query's list, best first.

    The list of a query is its top-k by then, so one row holds it. Each candidate knows the earlier places whose character
    pairs are too similar; one fold over the list keeps those that no kept place is similar to.
    """
    text = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    n = F.length(text)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))
    grams = F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))
    lists = candidates.withColumn("grams", grams).groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("neg"), "unit_id", "text", "grams"))).alias("items"))

    def similar(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return (both > 0) & (both / (F.size(a) + F.size(b) - both) > threshold)

    near = F.transform("items", lambda x, j: F.filter(
        F.transform("items", lambda y, i: F.when((i < j) & similar(x["grams"], y["grams"]), i)), lambda i: i.isNotNull()))
    kept = F.aggregate(
        F.transform("near", lambda x, i: F.struct(i.alias("i"), x.alias("near"))), F.array().cast("array<int>"),
        lambda kept, x: F.when(F.arrays_overlap(kept, x["near"]), kept).otherwise(F.concat(kept, F.array(x["i"]))))
    best = lists.withColumn("near", near).withColumn("kept", kept)
    return best.select("query_id", F.explode(F.transform("kept", lambda i: F.get("items", i))).alias("z")).select(
        "query_id", "z.unit_id", (-F.col("z.neg")).alias("score"), "z.text")


def score_chain(raw: Column, fusion: Column, rerank: Column, sources: Column) -> Column:
    """Struct that records a candidate's score at every step."""
    return F.struct(F.coalesce(raw, rerank).alias("raw_score"), F.coalesce(fusion, F.lit(0.0)).alias("fusion_score"),
                    rerank.alias("rerank_score"), sources.alias("route_sources"))


def cut(candidates: DataFrame, max_items: int, min_score: float = MIN_SCORE) -> DataFrame:
    """Drop scores under the minimum and keep the best ``max_items`` per query."""
    kept = candidates.filter(F.col("score") >= min_score)
    return ranked(kept, [F.col("score").desc(), F.col("unit_id")]).filter(F.col("rank") <= max_items)


def collect_terminal(candidates: DataFrame, max_items: int = 20) -> DataFrame:
    """First ``max_items`` of each list, order unchanged."""
    return candidates.filter(F.col("rank") <= max_items)


def rerank_batches(candidates: DataFrame, doc_chars: int = RERANK_DOC_CHARS, batch_docs: int = RERANK_BATCH_DOCS,
                   batch_chars: int = RERANK_BATCH_CHARS) -> DataFrame:
    """Cut documents to the provider limit and pack them into batches in rank order.

    A batch closes when the next document would pass either limit. The fold runs over the sorted
    list of one query's candidates.
    """
    doc = F.substring("text", F.lit(1), F.lit(doc_chars))
    lists = candidates.filter(F.col("text").rlike(r"\S")).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "unit_id", doc.alias("doc")))).alias("items"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("docs"), F.lit(0).alias("chars"),
                     F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        n = F.length(x["doc"])
        full = (acc["docs"] > 0) & ((acc["docs"] + 1 > batch_docs) | (acc["chars"] + n > batch_chars))
        batch = acc["batch"] + full.cast("int")
        return F.struct(
            batch.alias("batch"), F.when(full, 1).otherwise(acc["docs"] + 1).alias("docs"),
            F.when(full, n).otherwise(acc["chars"] + n).alias("chars"),
            F.concat(acc["out"], F.array(batch)).alias("out"))

    folded = lists.withColumn("batches", F.aggregate("items", start, step, lambda a: a["out"]))
    return folded.select("query_id", F.explode(F.arrays_zip("items", "batches")).alias("z")).select(
        "query_id", F.col("z.batches").alias("batch_id"), F.col("z.items.rank").alias("rank"),
        F.col("z.items.unit_id").alias("unit_id"), F.col("z.items.doc").alias("document"))
