"""Retrieval units from segments: raw text, entity cards, table rows, questions; embeddings and facets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as tx

# Fixed values.
CARD_CONTEXT = 40
QUESTION_MIN_CHARS = 5
WORTHY_MIN_CHARS = 15
WORTHY_MIN_TOKENS = 20
NOT_WORTHY_ROLES = ("note", "navigation", "toc")
UNIT_WEIGHT = {"raw_text": 1.0, "table_row": 0.8, "generated_question": 0.7, "entity_card": 0.5}
EMBED_BATCH = 32


def raw_text_units(segments: DataFrame) -> DataFrame:
    """One raw_text unit per segment; navigation segments are skipped.

    The search text opens with the breadcrumb unless the text already holds it, else with the section
    titles the text lacks; then come a model's context, if any, and the text.
    """
    text = F.col("raw_text")
    titles = F.filter("path_titles", lambda t: (F.length(t) > 0) & ~F.contains(text, t))
    use_crumb = (F.length("breadcrumb") > 0) & ~F.contains(text, F.col("breadcrumb"))
    lead = F.when(use_crumb, F.col("breadcrumb")).when(F.size(titles) > 0, F.array_join(titles, " > "))
    context = F.when(F.length("context") > 0, F.col("context"))
    return segments.filter(~F.coalesce("is_navigation", F.lit(False))).select(
        F.concat(F.lit("ru:"), "segment_key", F.lit(":raw_text")).alias("unit_key"), F.lit("raw_text").alias("unit_type"),
        F.col("segment_key"), F.col("section_title").alias("title"), text.alias("text"),
        F.concat_ws("\n", lead, context, text).alias("search_text"), F.lit(UNIT_WEIGHT["raw_text"]).alias("weight"))


def _claim(refs: list, per_segment: int) -> list[int]:
    """Positions of the refs that get a card: in order, new names only, at most so many per segment."""
    seen, taken, used = set(), [], {}
    for i, r in enumerate(refs):
        name, segment = (r["type"], r["name"]), r["segment_index"]
        if name not in seen and used.get(segment, 0) < per_segment:
            seen.add(name)
            used[segment] = used.get(segment, 0) + 1
            taken.append(i)
    return taken


def entity_cards(segments: DataFrame, refs: DataFrame, strong: list[str], per_segment: int) -> DataFrame:
    """A card for the first occurrence of each strong entity in a document, at most ``per_segment`` per segment.

    ``refs``: (segment_key, doc_id, segment_index, pos, type, name). A name cut by the limit gets its card
    in the next segment that mentions it, so the choice is a fold over one document's distinct refs.
    """
    @F.pandas_udf("array<int>")
    def claim(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: _claim(xs, per_segment))

    once = refs.filter(F.col("type").isin(*strong)).groupBy("doc_id", "segment_index", "segment_key", "type", "name").agg(
        F.min("pos").alias("pos"))
    lists = once.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct("segment_index", "pos", "segment_key", "type", "name"))).alias("refs"))
    cards = lists.withColumn("taken", claim("refs")).select(
        "doc_id", F.explode(F.transform("taken", lambda i: F.get("refs", i))).alias("r"))
    c = cards.select("doc_id", "r.type", "r.name", "r.segment_key").join(
        segments.select("segment_key", "raw_text", "section_title"), "segment_key")
    around = tx.window_around(F.col("raw_text"), F.col("name"), CARD_CONTEXT, CARD_CONTEXT, "...")
    label = F.concat("name", F.lit("（"), "type", F.lit("）"))
    tail = F.when(around != "", F.concat(F.lit(" "), around)).when(
        F.length("section_title") > 0, F.concat(F.lit(" — 见 "), "section_title")).otherwise(F.lit(""))
    return c.select(
        F.concat_ws(":", F.lit("ru:entity"), "type", "name").alias("unit_key"), "doc_id", "segment_key", F.col("name").alias("title"),
        F.concat(label, tail).alias("text"), F.concat_ws(" ", "name", "type", around).alias("search_text"),
        F.lit(UNIT_WEIGHT["entity_card"]).alias("weight"))


def table_row_units(tables: DataFrame) -> DataFrame:
    """One unit per non-empty table row, written as ``column为value`` clauses.

    ``tables``: (segment_key, columns ARRAY<STRING>, rows ARRAY<MAP<STRING,STRING>>).
    """
    r = tables.select("segment_key", "columns", F.posexplode("rows").alias("row_index", "row"))
    filled = F.filter("columns", lambda c: F.length(F.element_at("row", c)) > 0)
    values = F.transform(filled, lambda c: F.element_at("row", c))
    clauses = F.transform(filled, lambda c: F.concat(c, F.lit("为"), F.element_at("row", c)))
    return r.filter(F.size(filled) > 0).select(
        F.concat(F.lit("ru:"), "segment_key", F.lit(":table_row_"), "row_index").alias("unit_key"), "segment_key", "row_index",
        F.concat(F.lit("行"), (F.col("row_index") + 1).cast("string"), F.lit(": "), F.array_join(F.slice(values, 1, 3), "、")).alias("title"),
        F.concat(F.array_join(clauses, "，"), F.lit("。")).alias("text"),
        F.concat_ws(" ", F.array_join(values, " "), F.array_join("columns", " ")).alias("search_text"),
        F.lit(UNIT_WEIGHT["table_row"]).alias("weight"))


def prune_questions(questions: Column) -> Column:
    """Trim, strip a ``Qn:`` prefix and drop what is shorter than five characters."""
    trimmed = F.filter(F.transform(questions, tx.strip), lambda q: F.length(q) >= QUESTION_MIN_CHARS)
    bare = F.transform(trimmed, lambda q: F.regexp_replace(q, r"^Q\d+\s*[:：]\s*", ""))
    return F.filter(bare, lambda q: F.length(q) >= QUESTION_MIN_CHARS)


def question_units(segments: DataFrame, cap: int) -> DataFrame:
    """Units for the first ``cap`` pruned questions of each segment."""
    q = segments.select("*", F.posexplode(F.slice(prune_questions(F.col("questions")), 1, cap)).alias("question_index", "question"))
    source = F.coalesce("section_title", F.lit("未知"))
    return q.select(
        F.concat(F.lit("ru:"), "segment_key", F.lit(":gen_q_"), "question_index").alias("unit_key"), "segment_key", "question_index",
        F.substring("question", 1, 120).alias("title"),
        F.concat("question", F.lit("\n---\n来源: "), source, F.lit("\n"), F.substring("raw_text", 1, 200)).alias("text"),
        F.concat_ws(" ", "question", "section_title").alias("search_text"), F.lit(UNIT_WEIGHT["generated_question"]).alias("weight"))


def question_worthy(min_tokens: int = WORTHY_MIN_TOKENS, roles: tuple[str, ...] = NOT_WORTHY_ROLES) -> Column:
    """Whether a segment is worth asking a model about."""
    return (
        (F.col("block_type") != "heading")
        & (F.col("token_count").isNull() | (F.col("token_count") >= min_tokens))
        & (F.length(tx.strip(F.col("raw_text"))) >= WORTHY_MIN_CHARS)
        & F.coalesce("is_substantive", F.lit(True))
        & ~F.coalesce(F.col("semantic_role").isin(*roles), F.lit(False)))


def with_facets(segments: DataFrame) -> DataFrame:
    """Facet and provenance structs of a segment's units; empty values are left out."""
    facets = F.struct(
        F.when(F.length("block_type") > 0, F.col("block_type")).alias("block_type"),
        F.when(F.length("semantic_role") > 0, F.col("semantic_role")).alias("semantic_role"),
        F.when(F.size("section_path") > 0, F.size("section_path")).alias("section_depth"))
    refs = F.struct(F.col("doc_id").alias("document_key"), "segment_index", F.array("segment_id").alias("raw_segment_ids"))
    return segments.withColumn("facets", facets).withColumn("source_refs", refs)


def attach_embeddings(units: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors joined by unit key; units without one, and vectors of a wrong size, fall away."""
    ok = vectors.filter(F.size("vector") == dim).select("unit_key", "vector")
    return units.join(ok, "unit_key")


def embed(units: DataFrame, embedder, batch: int = EMBED_BATCH) -> DataFrame:
    """Run a user's ``embedder(list of texts) -> list of vectors`` over non-empty texts in batches.

    A batch whose answer has the wrong length is dropped whole, as no text can be matched to a vector.
    """
    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i:i + batch]
                got = embedder(list(part["text"]))
                if got is not None and len(got) == len(part):
                    yield pd.DataFrame({"unit_key": part["unit_key"], "vector": [list(map(float, v)) for v in got]})

    return units.filter(F.length("text") > 0).select("unit_key", "text").mapInPandas(run, "unit_key string, vector array<double>").filter(
        F.size("vector") > 0)
