"""Segmentation of block rows: grouping, clean-up, breadcrumbs, identifiers; the ordered folds are in ``folds``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators.folds import TYPE_PRIORITY

# Fixed values.
ALONE = ("table", "html_table", "code", "list", "blockquote")


def group_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Join runs of prose of one section; tables, code, lists and quotes stand alone; headings only name sections.

    ``blocks``: (key, section_id, block_index, block_type, text, line_start, line_end, section_path).
    """
    c = blocks.filter(F.col("block_type") != "heading")
    alone = F.col("block_type").isin(*ALONE)
    w = W.partitionBy(key, "section_id").orderBy("block_index")
    edge = alone | F.lag(alone, 1, False).over(w) | F.lag("block_index").over(w).isNull()
    run = F.sum(F.col("edge").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    g = c.withColumn("edge", edge).withColumn("group_index", run)
    parts = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    # Position of the segment inside its section, lines it came from, and counts by block type.
    return g.groupBy(key, "section_id", "group_index").agg(
        F.min("block_index").alias("first_block"), F.min_by("block_type", "block_index").alias("block_type"),
        tx.clean_markup(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")).alias("raw_text"),
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.count_if(F.col("block_type") == "paragraph").alias("paragraph_count"),
        F.first("section_path").alias("section_path"))


def dominant_type(types: DataFrame, by: list[str]) -> DataFrame:
    """Block type of highest priority per group; the earliest wins a tie."""
    pr = F.coalesce(F.create_map(*[x for k, v in TYPE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])[F.col("block_type")], F.lit(0))
    return types.groupBy(*by).agg(F.min_by("block_type", F.struct((-pr).alias("p"), "block_index")).alias("block_type"))


def structure_summary(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of paragraphs, list items, table rows and columns of a group of blocks."""
    kind = F.col("block_type")
    rows = F.size(F.split("text", "\n"))
    return blocks.groupBy(*by).agg(
        F.count_if(kind == "paragraph").alias("paragraph_count"),
        F.coalesce(F.sum(F.when(kind == "list", rows)), F.lit(0)).alias("item_count"),
        F.coalesce(F.sum(F.when(kind == "table", rows - 1)), F.lit(0)).alias("row_count"),
        F.coalesce(F.max(F.when(kind == "table", F.size(F.split(F.split_part("text", F.lit("\n"), F.lit(1)), r" \| ")))), F.lit(0)).alias("col_count"))


def breadcrumb(doc_title: Column, path: Column) -> Column:
    """``title > section > subsection`` without repeats; a title already in the path keeps its place there."""
    titles = F.array_distinct(F.filter(F.transform(path, lambda p: p["title"]), lambda t: F.length(t) > 0))
    lead = F.when((F.length(doc_title) > 0) & ~F.array_contains(titles, doc_title), F.concat(F.array(doc_title), titles)).otherwise(titles)
    return F.array_join(lead, " > ")


def reindex(segments: DataFrame, order: list[str], key: str = "doc_id") -> DataFrame:
    """Dense segment index in reading order and an id that is a function of document and index."""
    w = W.partitionBy(key).orderBy(*order)
    s = segments.withColumn("segment_index", F.row_number().over(w) - 1)
    return s.withColumn("segment_key", F.concat_ws("#", key, "segment_index")).withColumn("segment_id", F.sha2("segment_key", 256))
