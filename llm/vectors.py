"""Search and de-duplication over vectors.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part.
Equal vectors are folded before any work and unfolded at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import bucket, runs, settle, table
from llm.components import components

#: Vectors compared at once with others; a list or bucket of more is cut into blocks of this size.
BLOCK = 2048


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, key (a digest of the components) and v (float64 components as bytes) of the vectors that take part."""
    v = F.col(vec_col)
    own = df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    schema = "id long, key binary, v binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix_of(batch.column(1), size) + 0.0
            raw = [r.tobytes() for r in m]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "v"])

    return own.where(F.size("v") == size).mapInArrow(pack, schema)


def matrix_of(lists: pa.ListArray, size: int) -> np.ndarray:
    return np.asarray(lists.flatten(), float).reshape(-1, size) if len(lists) else np.zeros((0, max(size, 1)))


def unpack(raw) -> np.ndarray:
    """Rows of float64 components out of a column of bytes."""
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere for one seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, in one order of summing."""
    return np.einsum("ij,ij->i", a, b)


def nearest_centres(m: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n centres of largest inner product with the direction of each row, best first."""
    s = m @ centres.T
    part = np.argpartition(-s, min(n, s.shape[1]) - 1, axis=1)[:, :n] if n < s.shape[1] else np.argsort(-s, axis=1)
    order = np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


def fit_centres(vectors: DataFrame, lists: int, sample: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means over at most ``sample`` vectors (the first by a hash of their components)."""
    rows = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    m = unpack([r["v"] for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centres = m[rng.permutation(len(m))[:lists]]
    for _ in range(rounds):
        own = np.concatenate([(m[i:i + 4096] @ centres.T).argmax(1) for i in range(0, len(m), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, own, m)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-300), centres)
    return centres


def scan_block(q: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int, own: np.ndarray | None = None, steps: int = 8, z: float = 3.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Adaptive dimension scan of one block: pairs (row of q, row of x) that may be among the k nearest.

    q and x are rotated, so a prefix of the columns is a random sample of directions. After each column block the
    inner product is estimated from the prefix; a pair is abandoned when even z standard errors above the estimate
    stay below the query's floor. The error's scale is that of a random projection of d out of D dimensions. The
    floor rises to the k-th best of the pairs that were scanned to the end. Third result: components multiplied.
    """
    size = q.shape[1]
    # The first column block is two steps wide: fewer columns hardly ever rule a pair out.
    ends = sorted({max(1, size * i // steps) for i in range(2, steps + 1)})
    d = ends[0]
    part = q[:, :d] @ x[:, :d].T
    cost = part.size * d
    qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    error = z * np.sqrt((1 - d / size) / d) * qn[:, None] * xn[None, :]
    i, j = np.nonzero(part * (size / d) + error >= floor[:, None])
    got = part[i, j]
    for d0, d1 in zip(ends, ends[1:]):
        for at in range(0, len(i), 1 << 18):
            s = slice(at, at + (1 << 18))
            got[s] += np.einsum("ij,ij->i", q[i[s], d0:d1], x[j[s], d0:d1])
        cost += len(i) * (d1 - d0)
        if d1 < size:
            keep = got * (size / d1) + z * np.sqrt((1 - d1 / size) / d1) * qn[i] * xn[j] >= floor[i]
            i, j, got = i[keep], j[keep], got[keep]
    order = np.lexsort((-got, i))
    i, j, got = i[order], j[order], got[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k + 1], j[place < k + 1], cost


def nearest_vectors(df: DataFrame, query: Column, k: int = 20, lists: int | None = None, probe_share: float = 0.7, sample: int = 16384,
                    id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors of largest inner product for each row that ``query`` (a condition on ``id``) picks.

    Columns: query_id, rank (from 1), vec_id, score. Vectors are put in lists by direction; centres come from a
    bounded sample, every vector is in a list. A query first scans its nearest list, which sets its floor, then the
    other lists among its nearest ``probe_share`` with that floor. Lists are cut in blocks of about BLOCK vectors
    and the queries of a block in runs, so a large list is many tasks. Survivors get the exact inner product of the
    original vectors. Ties go to the smaller id; a vector is not its own neighbour. Empty tables give no rows.

    Rows repeated with the same id and vector count once. An id with several vectors is asked and found by each of
    them and stands once, with its best score. So each query has k different neighbours, where the table has them.
    """
    every = settle(valid_vectors(df, id_col, vec_col).dropDuplicates(["id", "key"]))
    # Vectors that hold k + 1 different ids at least, as an id has no more than ``most`` vectors.
    most = every.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    enough = (k + 1) * most
    at_most = Window.partitionBy("key").orderBy("id")
    # Of equal vectors no more than the k + 1 smallest ids can be among a query's k nearest others.
    firsts = every.select("key", "id", "v", F.row_number().over(at_most).alias("r")).where(F.col("r") <= k + 1)
    folded = settle(firsts.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")))
    n = folded.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return df.sparkSession.createDataFrame([], empty)
    lists = lists or max(1, int(np.ceil(np.sqrt(n) / 4)))
    centres = fit_centres(folded, lists, sample)
    lists, probes = len(centres), max(1, int(np.ceil(probe_share * len(centres))))
    turn = rotation(centres.shape[1])
    wanted = every.where(query).select("key", F.col("id").alias("query_id")).distinct()
    asked = wanted.select("key").distinct()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = unpack(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_centres(m, centres, 1)[:, 0].astype(np.int32))], ["key", "v", "ids", "list"])

    base = folded.mapInArrow(listed, "key binary, v binary, ids array<long>, list int")
    sizes = {r["list"]: r["count"] for r in base.groupBy("list").count().collect()}
    blocks = {i: max(1, -(-c // BLOCK)) for i, c in sizes.items()}

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = [f"{i}/{int.from_bytes(key[:8], 'little') % blocks.get(i, 1)}" for i, key in zip(batch.column(3).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), batch.column(2)], ["cell", "key", "v", "ids"])

    def probing(first: int, end: int):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                floors = batch.column(2).to_pylist()
                near = nearest_centres(unpack(raw), centres, end)[:, first:end]
                out = [(f"{i}/{b}", key, v, f) for key, v, f, own in zip(keys, raw, floors, near.tolist()) for i in own for b in range(blocks.get(i, 0))]
                for a in range(0, len(out), 20000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a:a + 20000]), (pa.string(), pa.binary(), pa.binary(), pa.float64()))], ["cell", "key", "v", "floor"])
        return probe

    cells = settle(base.mapInArrow(block_of, "cell string, key binary, v binary, ids array<long>"))

    def search(name, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "score": [], "ids": []})
        right = right.sort_values("key").reset_index(drop=True)
        x = unpack(right["v"].tolist())
        out = []
        for a in range(0, len(left), BLOCK):
            part = left.iloc[a:a + BLOCK]
            q = unpack(part["v"].tolist())
            i, j, _ = scan_block(q @ turn, x @ turn, part["floor"].to_numpy(), enough - 1)
            out.append(pd.DataFrame({"key": part["key"].to_numpy()[i], "score": inner(q[i], x[j]), "ids": right["ids"].to_numpy()[j]}))
        return pd.concat(out)

    def found(probes_df: DataFrame) -> DataFrame:
        hits = probes_df.groupBy("cell").cogroup(cells.groupBy("cell")).applyInPandas(search, "key binary, score double, ids array<long>")
        best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
        return hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= enough).drop("r")

    ask = folded.join(asked, "key", "left_semi").select("key", "v", F.lit(float("-inf")).alias("floor"))
    near = settle(found(ask.mapInArrow(probing(0, 1), "cell string, key binary, v binary, floor double")))
    floor = near.groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("n"), F.min("score").alias("low")).select("key", F.when(F.col("n") > k, F.col("low")).alias("low"))
    again = ask.drop("floor").join(floor, "key", "left").select("key", "v", F.coalesce("low", F.lit(float("-inf"))).alias("floor"))
    hits = near
    if probes > 1:
        hits = near.unionByName(found(again.mapInArrow(probing(1, probes), "cell string, key binary, v binary, floor double")))
    each = hits.select("key", "score", F.explode("ids").alias("vec_id")).groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    named = wanted.join(top, "key").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # A query's own id is no neighbour: the places behind it move up.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


class Hashes:
    """p-stable hashing: per table, a few projections shifted and cut in steps of one width, as one 32-bit number."""

    def __init__(self, size: int, tables: int, projections: int, width: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.shape, self.width = (tables, projections), width
        self.lines = rng.normal(size=(size, tables * projections))
        self.shift = rng.uniform(0, width, tables * projections)
        self.odd = rng.integers(1, 2**62, projections, dtype=np.int64) * 2 + 1

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        steps = np.floor((unit @ self.lines + self.shift) / self.width).astype(np.int64).reshape(len(unit), *self.shape)
        mixed = (steps * self.odd).sum(2)
        return (mixed ^ (mixed >> 29)).astype(np.int64) * 0x5851F42D4C957F2D >> 32


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links between 0..n-1, the smallest number each reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def link_vectors(df: DataFrame, cosine: float = 0.9, tables: int = 32, projections: int = 8, width: float = 1.5,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Near copies by cosine: vec_id, n_links, component_id, kept, one row for each row with an id.

    Normalised vectors are hashed ``tables`` times; those that share a bucket are compared exactly, bucket by bucket,
    larger buckets in blocks. A pair that meets in several buckets counts in the first table alone, so blocks report
    counts and spanning links rather than pairs. Equal vectors are folded and counted by their number. With the
    defaults a pair of cosine 0.9 meets with probability above 0.97, one of 0.95 always but for 1 in 4,000.
    """
    vectors = settle(valid_vectors(df, id_col, vec_col))
    folded = settle(vectors.groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("w"), F.min("id").alias("rep")))
    head = folded.select("v").limit(1).collect()
    size = len(head[0]["v"]) // 8 if head else 1
    hashes = Hashes(size, tables, projections, width)

    def units(raw) -> np.ndarray:
        m = unpack(raw)
        m = m / np.abs(m).max(1, keepdims=True)
        return m / np.sqrt(inner(m, m))[:, None]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                unit = units(part.column(1).to_pylist())
                codes = hashes(unit)
                own = np.arange(len(unit)).repeat(tables)
                pick = pa.array(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(unit))), pa.array(codes.ravel()),
                    part.column(0).take(pick), part.column(2).take(pick), pa.array([r.tobytes() for r in unit], pa.binary()).take(pick),
                    pa.array([r.astype(np.int32).tobytes() for r in codes], pa.binary()).take(pick)], ["t", "h", "rep", "w", "v", "codes"])

    signed = folded.select("rep", "v", "w").mapInArrow(sign, "t int, h long, rep long, w long, v binary, codes binary")
    counts = settle(signed.groupBy("t", "h").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = bucket(1 << 30, "rep") % F.col("parts")
    # A bucket of p blocks is compared block against block: each member goes to p cells.
    met = signed.join(counts, ["t", "h"]).withColumn("parts", parts).withColumn("mine", mine.cast("int"))
    cells = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "t", "h", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "w", "v", "codes")

    def compare(t: int, diagonal: bool, at: np.ndarray, v: np.ndarray, codes: np.ndarray, w: np.ndarray, mine: np.ndarray, first_block: int):
        """Links of one cell, as counts by member and as a spanning forest; ``at`` are the cell's rows."""
        left = at[mine[at] == first_block]
        right = left if diagonal else at[mine[at] != first_block]
        counted, ends = [], []
        for a in range(0, len(left), 512):
            some = left[a:a + 512]
            i, j = np.nonzero(v[some] @ v[right].T >= cosine - 1e-9)
            i, j = some[i], right[j]
            if diagonal:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 17):
                p, q = i[s:s + (1 << 17)], j[s:s + (1 << 17)]
                new = (inner(v[p], v[q]) >= cosine) & ~(codes[p, :t] == codes[q, :t]).any(1)
                p, q = p[new], q[new]
                if len(p):
                    base = at[0]
                    counted.append(np.bincount(p - base, w[q], at[-1] - base + 1) + np.bincount(q - base, w[p], at[-1] - base + 1))
                    root = _forest(at[-1] - base + 1, np.concatenate([p - base, *(x for x, _ in ends)]), np.concatenate([q - base, *(y for _, y in ends)]))
                    own = np.flatnonzero(root != np.arange(len(root)))
                    ends = [(own, root[own])]
        return (sum(counted), *ends[0]) if counted else None

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in runs(batches, 4):
            t, h, bi, bj, mine, rep, w = (rows_.column(c).to_numpy() for c in range(7))
            raw, codes = (b"".join(rows_.column(c).to_pylist()) for c in (7, 8))
            v, codes = np.frombuffer(raw, np.float64).reshape(len(t), -1), np.frombuffer(codes, np.int32).reshape(len(t), -1)
            change = np.flatnonzero((np.diff(t) != 0) | (np.diff(h) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
            for a, b in zip(np.append(0, change).tolist(), np.append(change, len(t)).tolist()):
                if b - a < 2:
                    continue
                got = compare(int(t[a]), bi[a] == bj[a], np.arange(a, b), v, codes, w, mine, bi[a])
                if got:
                    n_links, child, parent = got
                    to = rep[a:b].copy()
                    to[child] = rep[a:b][parent]
                    some = n_links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(rep[a:b][some]), pa.array(n_links[some].astype(np.int64)), pa.array(to[some])], ["rep", "links", "to"])

    dealt = cells.repartition("t", "h", "i", "j").sortWithinPartitions("t", "h", "i", "j", "rep")
    found = settle(dealt.mapInArrow(links, "rep long, links long, to long"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = folded.select("key", "rep", "w").join(totals, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    own = vectors.select("id", "key").join(per_class, "key").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = df.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null").join(own.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                      (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))


def op7_near_vectors(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
