"""A corpus pipeline: toxic documents go, repeated lines go, near copies go, personal data is replaced, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``. The
output of each stage is written and read again as the next one's input. Packing and class choice of documents have no
SQL form, so there is no statement for the whole; tests hold it against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import row_key, settle, table
from llm.lines import dedupe_lines
from llm.packing import pack_documents, special_tokens
from llm.pii import replace_entities
from llm.shingles import near_documents
from llm.toxicity import drop_toxic, fit_in

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, n_chars after the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, unchanged. Null texts stay."""
    return drop_toxic(docs.select(*COLUMNS), fit_in(docs, spark, sf_dir))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that repeat an earlier one; a text may become empty."""
    return _documents(dedupe_lines(docs.select(*COLUMNS)))


def clean_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, then of the smallest hash of its text.

    Texts of one doc_id that are no near copies of each other all stay. Of equal rows one stays, of rows that differ in
    lang, source or n_chars alone the least. Rows without doc_id stay, and so do texts without words.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", row_key(F.col("doc_id"), F.col("text")))
    known = docs.where("doc_id is not null")
    classed = near_documents(known.select("doc_id", "text")).select("doc_id", "row", F.coalesce("set", "row").alias("set"))
    kept = classed.groupBy("set").agg(F.min(F.struct("doc_id", "row")).alias("k"))
    rows = known.join(kept.select(F.col("k.row").alias("_row"), F.col("k.doc_id").alias("doc_id")), ["doc_id", "_row"])
    one = rows.groupBy("doc_id", "_row").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")).select("doc_id", "r.*")
    return one.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates in place of personal data."""
    return _documents(replace_entities(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          special=special_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", clean_toxicity),
    ("line_dedup", clean_lines),
    ("near_copies", clean_near_copies),
    ("surrogates", replace_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else settle(out)
    return docs
