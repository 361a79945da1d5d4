"""Line de-duplication: an exact Jaccard join on the word sets of lines (see setjoin); later matches are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import row_key, settle, table
from llm.setjoin import JOIN_WORDS, Threshold, matches, near_enough, sets_of, star_pairs, survey, verify, with_words
from llm.words import Texts, slices

#: Lines of at least so many distinct words get parities besides their 64-bit signature.
LONG = 64


def line_items(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Items of the join: one per line (cut at line feeds), its distinct words, A to Z lower-cased."""
    for first, data, offsets in slices(texts):
        feeds = np.flatnonzero(data == 10)
        start = np.concatenate([offsets[:-1], feeds + 1])
        text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, "right") - 1])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        x = Texts(data, np.append(start, len(data)), lower=True)
        no = np.arange(len(text)) - np.searchsorted(text, text)
        yield first + text, no.astype(np.int32), x.hashes(), np.append(0, np.cumsum(x.n))


def removed_lines(texts: DataFrame, hundredths: int = 80) -> DataFrame:
    """(doc, row, lines): numbers, from 0, of the lines of each row's text that repeat an earlier line.

    ``texts``: (doc_id, text, row), where row tells rows of one id with different texts apart. Lines are ordered by
    document id, then by row, then by number. A line goes when an earlier line, kept or not, has a word set of
    Jaccard similarity at least hundredths / 100. Lines of equal sets are folded to the first. Each line is first
    checked against one other, that which is the earliest for most of its prefix tokens; only lines that found no match
    so meet the other earlier ones. Lines without words stay.
    """
    rule = Threshold(hundredths)
    surveyed = survey(texts, line_items, LONG, 18)
    own = surveyed.where("slot is null and n > 0 and doc is not null").select("doc", "row", "no", "s")
    first = settle(own.groupBy("s").agg(F.min(F.struct("doc", "row", "no")).alias("f")))
    by_row = texts.where("doc_id is not null").select("row", "text")
    found = settle(matches(texts, line_items, surveyed, rule).join(first, "s"))

    def check(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.where(~F.col("long")).select("a", "b").union(near_enough(pairs.where("long").select("a", "b"), surveyed, rule)))
        needed = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct().join(first, "s").select("s", F.col("f.row").alias("doc"), "f.no")
        return verify(pairs, sets_of(by_row, line_items, needed), rule)

    row = F.struct("f", "s", "n", "p", "g")
    star = settle(star_pairs(found, row, rule).select("a", "b", (F.least("na", "nb") >= LONG).alias("long")))
    decided = check(star).select(F.col("b").alias("s")).distinct()
    wide = with_words(found, surveyed)
    row = F.struct("f", "s", "n", "p", "g", "w")
    x = wide.select("t", row.alias("x"))
    y = wide.join(decided, "s", "left_anti").select("t", row.alias("y"))
    rest = x.join(y, "t").where("x.f < y.f").where(rule.passes(F.col("x"), F.col("y"), JOIN_WORDS))
    rest = rest.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), (F.least("x.n", "y.n") >= LONG).alias("long")).distinct().join(star, ["a", "b"], "left_anti")
    gone = decided.union(check(settle(rest)).select(F.col("b").alias("s"))).distinct().withColumn("gone", F.lit(True))
    fate = first.join(gone, "s", "left")
    return own.join(fate, "s").where("gone or f.doc != doc or f.row != row or f.no != no").groupBy("doc", "row").agg(F.collect_set("no").alias("lines"))


def dedupe_lines(docs: DataFrame, hundredths: int = 80) -> DataFrame:
    """``docs`` without repeated lines; all columns stay, text is shortened, and n_lines and n_removed are added.

    Needs doc_id and text. Null texts stay null and have no lines; a text whose lines all go becomes empty. Rows
    without doc_id keep their text and remove nothing elsewhere. Repeated rows keep the same lines; rows of one doc_id
    with different texts are different documents, in the order of a hash of the text. Columns of the names added
    here are replaced.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    lines = removed_lines(texts, hundredths).select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "lines")
    parts = F.split(text, "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lines"))
    kept = F.transform(numbers, lambda i: F.get(parts, i))
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & (row_key(F.col("doc_id"), text) == F.col("_row"))
    joined = docs.join(lines, same, "left").drop("_doc", "_row")
    return joined.withColumns({
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long"),
        "n_removed": F.when(F.col("lines").isNull() | text.isNull(), 0).otherwise(F.size("lines")).cast("long"),
        "text": F.when(F.col("lines").isNull(), text).otherwise(F.array_join(kept, "\n")),
    }).drop("lines")


def op3_lines(spark, sf_dir: str) -> DataFrame:
    return dedupe_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")
