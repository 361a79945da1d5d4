"""Ranked lexical search over geometric blocks of posting lists.

Documents lie in shards, a bounded number per shard; a shard's index never leaves its task. It has one posting list for
each term of the items. A list longer than a block is clustered: its documents go to the most similar of some of its own
documents, by inner products of sketched impact vectors, and each cluster is cut in blocks. A block's summary is the
coordinatewise maximum of its documents' impact vectors, over the terms of all items that visit the list. So the sum of a
summary over an item's terms bounds the score of every document of the block. Lists are visited from the weightiest term
to the lightest, a list's blocks by falling bound. Blocks whose bound is below the item's k-th best score so far are
skipped; that score is carried through all lists and shards of a task. Clustering and order decide speed only: a skipped
block holds no document that could rank.

Corpus statistics cover all documents; a first pass counts them while it writes the shards' term counts. Items come in
blocks of at most ``ITEM_TERMS`` terms, which is what every task gets of them and what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import rows, settle, table
from llm.exchange import pack, unpack
from llm.words import Texts, slices

K = 10
BLOCK = 32
SHARD_DOCS = 4096
#: Documents times terms of a shard at most.
SHARD_CELLS = 1 << 24
ITEM_TERMS = 1 << 14
SKETCH = 32
CENTRES = 64
#: Documents scored before the k-th best score is looked at again.
STEP = 256
#: Bytes that no term holds: ASCII other than digits and letters.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = [not chr(b).isalnum() for b in range(128)]
RESULT = "item_id long, rank int, doc_id long, score long"


class Items(NamedTuple):
    """Items by number: their ids, the hashes of all their terms in order, and each item's terms as numbers of these."""

    ids: list[int]
    terms: np.ndarray
    own: list[np.ndarray]


class Corpus(NamedTuple):
    """Documents that hold terms, all their terms, and every item term's weight."""

    documents: int
    terms: int
    weights: np.ndarray


def _cut(texts: pa.Array) -> Iterator[tuple[int, Texts]]:
    for i, data, offsets in slices(texts):
        yield i, Texts(data, offsets, lower=True, breaks=BREAKS)


def item_blocks(items: DataFrame, most: int = ITEM_TERMS) -> Iterator[Items]:
    """Items with their distinct terms, in blocks of at most ``most`` of them (or one item)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in _cut(batch.column(1)):
                ids = batch.column(0).slice(i, len(words.n)).take(pa.array(words.text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.hashes().view(np.int64))], ["item_id", "term"])

    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    terms = known.mapInArrow(hashed, "item_id long, term long").groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    held: list[tuple[int, np.ndarray]] = []

    def block() -> Items:
        every = np.unique(np.concatenate([t for _, t in held]))
        return Items([i for i, _ in held], every, [np.searchsorted(every, t) for _, t in held])

    for row in terms.orderBy("item_id").toLocalIterator():
        own = np.array(row["terms"], np.int64).view(np.uint64)
        if held and sum(len(t) for _, t in held) + len(own) > most:
            yield block()
            held = []
        held.append((row["item_id"], own))
    if held:
        yield block()


def term_counts(docs: DataFrame, items: Items) -> DataFrame:
    """Settled term counts of all documents for the items' terms, with the corpus' statistics by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("payload", pa.binary()), ("documents", pa.int64()), ("terms", pa.int64()), ("df", pa.list_(pa.int64()))])
        documents, terms, df = 0, 0, np.zeros(len(items.terms), np.int64)
        for batch in batches:
            for i, words in _cut(batch.column(1)):
                hashes = words.hashes()
                at = np.minimum(np.searchsorted(items.terms, hashes), len(items.terms) - 1)
                hit = np.flatnonzero(items.terms[at] == hashes)
                pairs, tf = np.unique(words.text[hit] * len(items.terms) + at[hit], return_counts=True)
                text, term = pairs // len(items.terms), pairs % len(items.terms)
                documents, terms = documents + int((words.n > 0).sum()), terms + len(hashes)
                df += np.bincount(term, minlength=len(df))
                yield rows(schema, payload=[pack(doc_id=batch.column(0).slice(i, len(words.n)), n=words.n.astype(np.int64),
                                                 ptr=np.searchsorted(text, np.arange(len(words.n) + 1)), term=term.astype(np.int32), tf=tf.astype(np.int32))],
                           documents=[None], terms=[None], df=[None])
        yield rows(schema, payload=[None], documents=[documents], terms=[terms], df=[df])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(own.mapInArrow(count, "payload binary, documents long, terms long, df array<long>"))


def corpus(counts: DataFrame, items: Items) -> Corpus:
    parts = counts.where("payload is null")
    got = parts.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    n, length, df = got["n"] or 0, got["l"] or 0, np.zeros(len(items.terms), np.int64)
    for r in parts.select(F.posexplode("df")).where("col > 0").groupBy("pos").agg(F.sum("col").alias("df")).collect():
        df[r["pos"]] = r["df"]
    return Corpus(n, length, np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64))


class _Best:
    """Best k of one item: falling score, then rising id, rows without id last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = np.append(self.score, score), np.append(self.doc, doc), np.append(self.none, none)
        order = np.lexsort((doc, none, -score))[:self.k]
        order = order[score[order] > 0]
        self.score, self.doc, self.none = score[order], doc[order], none[order]


def quotients(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied with; less than a million."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 8 * m)).astype(np.int32)


class Shard:
    """Documents as columns of quotients, one row per term, and their posting lists in blocks."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, quotient: np.ndarray, weights: np.ndarray, block: int = BLOCK):
        doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        self.weights, self.block = weights, block
        self.table = np.zeros((len(weights), len(ptr) - 1), np.int32)
        self.table[term, doc] = quotient
        order = np.argsort(term, kind="stable")
        self.lists, self.listed = np.append(0, np.cumsum(np.bincount(term, minlength=len(weights)))), doc[order]
        signs = (np.random.Generator(np.random.PCG64(11)).integers(0, 2, (len(weights), SKETCH)) * 2 - 1) * weights[:, None]
        signs = signs.astype(np.float32)
        sketch = np.concatenate([self.table[:, i:i + 256].T.astype(np.float32) @ signs for i in range(0, max(1, len(ptr) - 1), 256)])
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term's list, cluster by cluster, and the bounds of its blocks."""
        own = self.listed[self.lists[term]:self.lists[term + 1]]
        if len(own) <= self.block:
            return own, np.unique([0, len(own)])
        centres = own[np.linspace(0, len(own) - 1, min(CENTRES, -(-len(own) // self.block))).astype(np.int64)]
        near = (self.sketch[own] @ self.sketch[centres].T).argmax(1)
        order = np.argsort(near, kind="stable")
        own, near = own[order], near[order]
        first = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
        size = np.diff(np.append(first, len(own)))
        pieces = -(-size // self.block)
        number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        return own, np.append(np.repeat(first, pieces) + number * self.block, len(own))

    def summaries(self, docs: np.ndarray, bounds: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Coordinatewise maxima of the blocks, one column each, over some terms."""
        return np.maximum.reduceat(self.table[terms[:, None], docs], bounds[:-1], axis=1)

    def scores(self, docs: np.ndarray, own: np.ndarray) -> np.ndarray:
        return self.weights[own] @ self.table[own[:, None], docs].astype(np.int64)

    def search(self, own: list[np.ndarray], best: list[_Best], ids: np.ndarray, none: np.ndarray) -> int:
        """Offer to each item's best what may rank; returns how many scores it took."""
        askers: dict[int, list[int]] = {}
        for i, terms in enumerate(own):
            for t in terms.tolist():
                askers.setdefault(t, []).append(i)
        seen = np.zeros((len(own), self.table.shape[1]), bool)
        taken = 0
        for t in sorted(askers, key=lambda t: (-self.weights[t], t)):
            docs, bounds = self.blocks(t)
            if not len(docs) or not self.weights[t]:
                continue
            block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            terms = np.unique(np.concatenate([own[i] for i in askers[t]]))
            tops = self.summaries(docs, bounds, terms)
            for i in askers[t]:
                bound = self.weights[own[i]] @ tops[np.searchsorted(terms, own[i])].astype(np.int64)
                visited = np.flatnonzero((bound >= max(best[i].floor(), 1))[block] & ~seen[i, docs])
                if not len(visited):
                    continue
                ahead = bound[block[visited]]
                order = np.argsort(-ahead, kind="stable")
                fresh, ahead, at = docs[visited[order]], ahead[order], 0
                while at < len(fresh) and ahead[at] >= max(best[i].floor(), 1):
                    now = fresh[at:at + STEP]
                    at += STEP
                    seen[i, now] = True
                    taken += len(now)
                    scores = self.scores(now, own[i])
                    may = scores >= max(best[i].floor(), 1)
                    if may.any():
                        best[i].add(scores[may], ids[now[may]], none[now[may]])
        return taken


def _search(counts: DataFrame, items: Items, stats: Corpus, k: int, shard_docs: int) -> DataFrame:
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    most = max(1, min(shard_docs, SHARD_CELLS // max(1, len(items.terms))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in items.ids]
        held: list[dict] = []

        def work() -> None:
            n = np.concatenate([x["n"] for x in held])
            ids = pa.chunked_array([pa.array(x["doc_id"], pa.int64()) for x in held]).combine_chunks()
            none, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
            term, tf = np.concatenate([x["term"] for x in held]).astype(np.int64), np.concatenate([x["tf"] for x in held])
            size = np.concatenate([np.diff(x["ptr"]) for x in held])
            m = 10 + 90 * n * stats.documents // max(stats.terms, 1)
            shard = Shard(np.append(0, np.cumsum(size)), term, quotients(tf, np.repeat(m, size)), stats.weights)
            shard.search(items.own, best, ids, none)

        for batch in batches:
            for payload in batch.column(0):
                held.append(unpack(payload.as_py()))
                if sum(len(x["n"]) for x in held) >= most:
                    work()
                    held = []
        if held:
            work()
        for item, found in zip(items.ids, best):
            yield rows(schema, item_id=[item] * len(found.score), doc_id=pa.array(found.doc, mask=found.none), score=found.score)

    found = counts.where("payload is not null").select("payload").mapInArrow(search, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, item_terms: int = ITEM_TERMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank (from 1), doc_id, score.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. Terms are runs of ASCII digits
    and letters and of characters beyond ASCII, A to Z lower-cased. A null or empty text has no terms. Equal scores rank by
    rising doc_id, rows without doc_id last. Every row of documents is a document, so a repeated row counts, and may rank,
    as often as it occurs. Rows of one item_id are one item with all their terms; rows without item_id ask nothing. Items
    without a scoring document, and empty tables, give no rows.
    """
    parts = []
    for block in item_blocks(items, item_terms):
        counts = term_counts(docs, block)
        parts.append(_search(counts, block, corpus(counts, block), k, shard_docs))
    if not parts:
        return docs.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, parts)


def op11_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
     q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL),
     c AS (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
     words AS (SELECT r, unnest(ts) AS t FROM d),
     tf AS (SELECT r, t, count(*) AS tf FROM words SEMI JOIN q USING (t) GROUP BY ALL),
     w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY t, n),
     hit AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * n) // l))) AS s FROM tf JOIN w USING (t) JOIN d USING (r), c),
     total AS (SELECT item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM hit JOIN q USING (t) GROUP BY ALL),
     ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM total WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}"""
