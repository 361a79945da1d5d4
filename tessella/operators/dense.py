"""Exact cosine top-k over cells: a cell is read only by queries whose k-th best score its bound can reach.

Vectors lie in cells around centres that are fitted on a bounded sample; each cell knows the widest angle between its
centre and a vector of it. By the triangle inequality of angles, no vector of a cell is nearer to a query than the angle
to the centre less that width. Queries go to cells, the corpus is never copied: it lies in parts of bounded size, and
queries stream past a part in blocks. Each query first meets its nearest cells, which give it a floor; then only cells
whose bound reaches the floor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.retrieval import top_k
from tessella.session import cut_lineage

#: Centres are fitted on at most so many vectors and there are at most so many.
SAMPLE = 8192
CELLS = 1024
#: Numbers of a part of a cell, and of a block of scores.
PART_NUMBERS = 1 << 21
BLOCK_NUMBERS = 1 << 21
#: Queries whose cells are bounded at a time.
QUERIES = 512
#: Allowance for rounding when scores are compared with bounds.
SLACK = 1e-5


class Cells(NamedTuple):
    """Parts of cells (g, cell, part, ids, rows), the extent of every cell (g, cell, width, parts, n), and the centres."""

    parts: DataFrame
    extents: DataFrame
    centres: np.ndarray
    dim: int


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors; a zero vector stays zero."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = values.reshape(-1, dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def fit_centres(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Centres of unit length by a few rounds of spherical k-means."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(np.int64)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _usable(df: DataFrame, dim: int) -> Column:
    """Vectors of the right size without null or non-finite numbers."""
    v = F.col("vector").cast("array<double>")
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def build_cells(vectors: DataFrame, dim: int, cells: int = CELLS, sample: int = SAMPLE) -> Cells:
    """Cells of ``vectors(unit_id, vector)``, kept apart by ``group`` if there is such a column."""
    group = F.coalesce(F.col("group").cast("string"), F.lit("")) if "group" in vectors.columns else F.lit("")
    v = vectors.where(_usable(vectors, dim)).select(group.alias("g"), "unit_id", F.col("vector").cast("array<double>").alias("vector"))
    kind = v.schema["unit_id"].dataType.simpleString()
    some = v.select("vector").orderBy(F.xxhash64("vector")).limit(sample).toArrow().column("vector").combine_chunks()
    known = _matrix(some, dim) if len(some) else np.zeros((1, dim))
    centres = fit_centres(known, max(1, min(cells, len(known) // 16)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), dim)
                near = (x @ centres.T).argmax(1)
                angle = np.arccos(np.clip((x * centres[near]).sum(1), -1, 1))
                rows = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(angle), batch.column(1), pa.array(rows, pa.binary())],
                                                 ["g", "cell", "angle", "unit_id", "row"])

    placed = cut_lineage(v.mapInArrow(place, f"g string, cell int, angle double, unit_id {kind}, row binary"))
    most = max(1, PART_NUMBERS // dim)
    sizes = placed.groupBy("g", "cell").agg(F.max("angle").alias("width"), F.count("*").alias("n"))
    extents = cut_lineage(sizes.withColumn("parts", F.ceil(F.col("n") / most).cast("int")))
    dealt = placed.join(extents.select("g", "cell", "parts"), ["g", "cell"]).withColumn(
        "part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int"))
    return Cells(dealt.select("g", "cell", "part", "unit_id", "row"), extents, centres, dim)


def _meet(cells: Cells, asked: DataFrame, k: int) -> DataFrame:
    """Best k of every (query, part) that meets: (query_id, unit_id, score). ``asked``: (g, cell, part, query_id, row, floor)."""
    id_kind, q_kind = cells.parts.schema["unit_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    dim = cells.dim
    corpus = cells.parts.select("g", "cell", "part", F.lit(0).alias("kind"), "unit_id", F.lit(None).cast(q_kind).alias("query_id"), "row", F.lit(None).cast("double").alias("floor"))
    both = corpus.unionByName(asked.select("g", "cell", "part", F.lit(1).alias("kind"), F.lit(None).cast(id_kind).alias("unit_id"), "query_id", "row", "floor"))

    def best(ids: pa.Array, x: np.ndarray, q_ids: pa.Array, q: np.ndarray, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = np.asarray(ids.to_pandas())
        for lo in range(0, len(q), max(1, BLOCK_NUMBERS // max(len(x), 1))):
            rows = slice(lo, lo + max(1, BLOCK_NUMBERS // max(len(x), 1)))
            scores = q[rows] @ x.T
            at, who, points = [], [], []
            for i, s in enumerate(scores):
                own = np.flatnonzero(s >= floor[rows][i] - SLACK)
                if len(own) > 4 * k:
                    cut = own[s[own] >= np.partition(s[own], -4 * k)[-4 * k] - SLACK]
                    own = cut if len(set(names[cut])) >= k else own
                rounded = np.round(s[own], 6)
                seen: set = set()
                for j in np.lexsort((names[own], -rounded)):
                    if names[own[j]] not in seen:
                        seen.add(names[own[j]])
                        at.append(own[j])
                        who.append(lo + i)
                        points.append(rounded[j])
                        if len(seen) == k:
                            break
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(who, pa.int64())), ids.take(pa.array(at, pa.int64())), pa.array(points, pa.float64())], ["query_id", "unit_id", "score"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, x, ids = None, [], None, None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(4)]))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a][:3] != key:
                    key, held, x = keys[a][:3], [], None
                part = batch.slice(a, b - a)
                rows = np.frombuffer(b"".join(part.column(6).to_pylist()), np.float64).reshape(-1, dim)
                if keys[a][3] == 0:
                    held.append((part.column(4), rows))
                elif held:
                    if x is None:
                        ids, x = pa.chunked_array([i for i, _ in held]).combine_chunks(), np.concatenate([r for _, r in held])
                    yield from best(ids, x, part.column(5), rows, part.column(7).to_numpy(zero_copy_only=False))

    dealt = both.repartition("g", "cell", "part").sortWithinPartitions("g", "cell", "part", "kind")
    return dealt.mapInArrow(meet, f"query_id {q_kind}, unit_id {id_kind}, score double")


def cell_search(queries: DataFrame, cells: Cells, k: int, least: float = -2.0, active: DataFrame | None = None) -> DataFrame:
    """The k nearest units of every query by cosine, ties to the smaller id: (query_id, unit_id, score, rank).

    Scores are rounded to six decimals; none is below ``least``. Of several vectors of a unit the nearest counts. Queries of the wrong size, and
    vectors with null or non-finite numbers, take no part. ``active`` (unit_id) is the released scope: only its units are met,
    so the best k are the best in scope. With a ``group`` column only vectors of the query's group count.
    """
    dim, centres = cells.dim, cells.centres
    if active is not None:
        cells = cells._replace(parts=cells.parts.join(active.select("unit_id").distinct(), "unit_id", "left_semi"))
    group = F.coalesce(F.col("group").cast("string"), F.lit("")) if "group" in queries.columns else F.lit("")
    q = queries.where(_usable(queries, dim)).select(group.alias("g"), "query_id", F.col("vector").cast("array<double>").alias("vector"))
    q_kind = q.schema["query_id"].dataType.simpleString()
    lists = cells.extents.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("cell", "width", "parts", "n"))).alias("cells"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query: its cells by falling bound, which of them it meets first; in slices, as a query may have all cells."""
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(at, QUERIES)
                x = _matrix(batch.column(2), dim)
                angle = _angles(x, centres)
                flat = batch.column(3).flatten()
                cell, width, parts, n = (np.asarray(pc.struct_field(flat, f)) for f in ("cell", "width", "parts", "n"))
                size = np.asarray(pc.list_value_length(batch.column(3)))
                row = np.repeat(np.arange(len(x)), size)
                bound = np.cos(np.maximum(angle[row, cell] - width, 0))
                order = np.lexsort((-bound, row))
                start = np.cumsum(size) - size
                ahead = np.cumsum(n[order]) - n[order]
                ahead -= np.repeat(ahead[np.minimum(start, max(0, len(ahead) - 1))], size) if len(ahead) else 0
                told = pa.StructArray.from_arrays([pa.array(cell[order]), pa.array(parts[order]), pa.array(bound[order]), pa.array(ahead < 2 * k)],
                                                  ["cell", "parts", "bound", "first"])
                ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()),
                                                  pa.ListArray.from_arrays(ends, told)], ["g", "query_id", "row", "cells"])

    asked = cut_lineage(q.join(lists, "g").select("g", "query_id", "vector", "cells").mapInArrow(
        bounds, f"g string, query_id {q_kind}, row binary, cells array<struct<cell:int,parts:int,bound:double,first:boolean>>"))

    def ask(rows: DataFrame, wanted: Column) -> DataFrame:
        each = rows.select("g", "query_id", "row", "floor", F.explode(F.filter("cells", lambda c: wanted(c))).alias("c"))
        return each.select("g", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("c.parts") - 1)).alias("part"), "query_id", "row", "floor")

    reach = F.lit(float(least))
    first = cut_lineage(_meet(cells, ask(asked.withColumn("floor", reach), lambda c: c["first"] & (c["bound"] >= reach - SLACK)), k))
    once = first.groupBy("query_id", "unit_id").agg(F.max("score").alias("score"))
    floors = top_k(once, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = asked.join(floors, "query_id", "left").withColumn("floor", F.greatest("floor", reach))
    second = _meet(cells, ask(rest, lambda c: ~c["first"] & (c["bound"] >= F.col("floor") - SLACK)), k)
    every = first.unionByName(second).where(F.col("score") >= reach)
    return top_k(every.groupBy("query_id", "unit_id").agg(F.max("score").alias("score")), k)
