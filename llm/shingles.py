"""Near-duplicate documents: an exact Jaccard join on word n-grams (see setjoin)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import release, row_key, settle, table
from llm.components import components
from llm.setjoin import JOIN_WORDS, Threshold, matches, near_enough, sets_of, survey, verify, with_words
from llm.words import Texts, mix, slices, spans

WORDS = 5
#: Rounds in which sets are checked against their neighbours at each token, before all pairs of other components are, and
#: how many neighbours they meet there. They decide speed only.
MERGES = 2
REACH = 3
#: Prefix tokens before a common one that are looked at to see whether a pair has met already.
BEFORE = 4


def shingle_items(words: int = WORDS):
    """Items of the join: one per text, its shingles; a text of fewer words is one shingle, one without words is empty."""

    def items(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for first, data, offsets in slices(texts):
            x = Texts(data, offsets, lower=True)
            h = x.hashes()
            _, grams = x.grams(h, words)
            n = np.where(x.n >= words, x.n - words + 1, np.minimum(x.n, 1))
            short = (x.n > 0) & (x.n < words)
            tokens = np.zeros(int(n.sum()), np.uint64)
            from_short = np.repeat(short, n)
            tokens[~from_short] = grams
            if short.any():
                tokens[from_short] = mix(spans(h, x.first[:-1][short], x.first[1:][short]) + np.uint64(1))
            yield first + np.arange(len(n)), np.zeros(len(n), np.int32), tokens, np.append(0, np.cumsum(n))

    return items


def _placed(found: DataFrame, links: DataFrame) -> DataFrame:
    """Prefix rows with the component c of their set."""
    classes = components(links).withColumnRenamed("id", "s")
    return settle(found.join(classes, "s", "left").withColumn("c", F.coalesce("component", "s")).drop("component"))


def _neighbours(placed: DataFrame, rule: Threshold, turn: int) -> DataFrame:
    """(a, b): each set with the next REACH sets at every token, where they are of another component.

    Sets of a token are ordered by size, after the first turn by a hash. So a group of near copies gets a pair for each of its
    rows, and is one component unless REACH sets in a row are too far from the one before them.
    """
    order = ["n", "s"] if not turn else [F.xxhash64("s", F.lit(turn)), "s"]
    y = F.struct("n", "s", "p", "g", "c")
    at = W.partitionBy("t").orderBy(*order)
    met = placed.select(y.alias("y"), F.array(*[F.lead(y, i).over(at) for i in range(1, REACH + 1)]).alias("x")).select("y", F.explode("x").alias("x"))
    return met.where("x.c != y.c").where(rule.passes(F.col("x"), F.col("y"))).select(
        F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct()


def _crossing(side: DataFrame, rule: Threshold) -> DataFrame:
    """(a, b): pairs of sets of different components that pass the filters at a token they share; a pair may occur more than once.

    ``side`` has prefix rows t, n, s, p, g, c and w. A pair is left out at a token if both sets share one of the BEFORE
    tokens before it. There it has passed too, as its places are earlier and all else is the same, or was left out for
    a token still earlier; so each pair is met at its first.
    """
    own = W.partitionBy("s").orderBy("p", "t")
    before = F.filter(F.array(*[F.lag("t", i).over(own) for i in range(1, BEFORE + 1)]), lambda t: t.isNotNull())
    rows = side.select("t", F.struct("n", "s", "p", "g", "c", "w", before.alias("before")).alias("x"))
    cross = rows.join(rows.withColumnRenamed("x", "y"), "t").where("x.c != y.c and (x.n < y.n or (x.n = y.n and x.s < y.s))")
    cross = cross.where(~F.arrays_overlap("x.before", "y.before")).where(rule.passes(F.col("x"), F.col("y"), JOIN_WORDS))
    return cross.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b"))


def near_documents(docs: DataFrame, hundredths: int = 80, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every row.

    Documents link when their sets of word n-grams have a Jaccard similarity of at least hundredths / 100. In two
    rounds each set is checked against its neighbours at each of its tokens, first by size, then by a hash; what is linked
    forms components. Pairs within a component need no check any more; all other pairs that pass the filters get one. So
    a group of near copies costs some chains, not its square, and no link between components is lost.

    ``docs`` needs doc_id and text; other columns are ignored. Null or empty texts have no shingles and link with
    nothing. Rows without doc_id link by their text and get the smallest doc_id of their component. Repeated rows stay.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A set's tokens are cut again out of one row that has it. Rows of one hash do no harm: both are cut, and the set is told by its name.
    keyed = own.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    texts = keyed.select("row", "text")
    rule, items = Threshold(hundredths), shingle_items(words)
    surveyed = survey(keyed, items, parities_from=1)
    rows = surveyed.where("slot is null").select("doc", "s", "n", "row")
    found = matches(texts, items, surveyed, rule)
    first = surveyed.where("n > 0").groupBy("s").agg(F.min("row").alias("doc"), F.lit(0).alias("no"))

    def check(pairs: DataFrame) -> DataFrame:
        pairs = settle(near_enough(pairs, surveyed, rule))
        needed = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct().join(first, "s")
        return verify(pairs, sets_of(texts, items, needed), rule)

    tested = links = None
    for turn in range(MERGES):
        placed = found.withColumn("c", F.col("s")) if links is None else _placed(found, links)
        pairs = _neighbours(placed, rule, turn)
        pairs = settle(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        near = check(pairs)
        if links is not None:
            release(placed)
        links, tested = (near, pairs) if links is None else (links.union(near), tested.union(pairs))
    placed = _placed(found, links)
    mixed = placed.groupBy("t").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("t")
    side = with_words(placed.join(mixed, "t"), surveyed)
    more = check(_crossing(side, rule).distinct().join(tested, ["a", "b"], "left_anti"))
    classes = components(links.union(more)).withColumnRenamed("id", "s")
    named = rows.join(classes, "s", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("component", "s")))
    least = named.where("c is not null").groupBy("c").agg(F.min("doc").alias("component_id"))
    return named.join(least, "c", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"), "row", F.col("c").alias("set"))


def op8_near_documents(spark, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))
