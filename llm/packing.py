"""Packing: documents become full token sequences by cutting-stock column generation.

A document's ids are cut every ``capacity`` tokens; the last piece keeps the rest. A linear program over the
histogram of piece lengths chooses patterns (how many pieces of which length class fill one sequence), a
knapsack dynamic program prices new patterns, the solution is rounded, and ranked pieces take the patterns'
slots. Only the histogram, at most ``CLASSES`` rows, meets the driver; pieces are ranked, assigned and given
offsets by joins and windows.
"""

from __future__ import annotations

import json
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import bucket, rows, settle

CAPACITY = 2048
#: Length classes of a sequence; a piece counts as its length rounded up to a class.
CLASSES = 256
END_ID = 1
#: Ranks are counted within (class, bucket); buckets keep a hot class in many tasks.
BUCKETS = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def special_tokens(path: str) -> dict[str, int]:
    """Added special tokens of a vocabulary's JSON file. Their strings inside texts are these ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}


def byte_encoding(path: str, special: dict[str, int] | None = None):
    """The byte-level vocabulary, given as ranks; strings of special tokens that are not named are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {})


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of a document's ids, which end with ``end_id``. A null text is empty: one piece of one id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(vocabulary, special)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoding.encode_to_numpy(text.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                out += [(doc_id, i, len(p), zlib.crc32(p.tobytes()), len(ids))
                        for i in range(0, len(ids), capacity) for p in [ids[i:i + capacity]]]
            yield rows(_ARROW, **dict(zip(_ARROW.names, zip(*out) if out else [[]] * 5)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def _best_pattern(widths: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of greatest value within the room."""
    use = values > 1e-12
    w, v = widths[use], values[use]
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = int(np.searchsorted(w, c, "right"))
        if k:
            got = best[c - w[:k]] + v[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], choice[c] = got[i], i
    pattern, c = np.zeros(len(widths)), room
    where = np.flatnonzero(use)
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[where[choice[c]]] += 1
            c -= int(w[choice[c]])
    return float(best[room]), pattern


def plan_patterns(counts: dict[int, int], room: int = CLASSES, gap: float = 2e-4) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {class: pieces}) for all pieces, by column generation and rounding.

    Stops when the bound of the linear program is within ``gap`` of its value. The parts lost by rounding down
    are filled first-fit by falling class; they are at most one sequence's worth per pattern.
    """
    plan = [(n, {w: 1}) for w, n in counts.items() if w == room]
    widths = np.array(sorted(w for w, n in counts.items() if w < room and n > 0))
    if not len(widths):
        return plan
    need = np.array([counts[int(w)] for w in widths], float)
    basis = np.diag((room // widths).astype(float))
    for _ in range(20 * len(widths)):
        use = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(len(widths)))
        value, pattern = _best_pattern(widths, price, room)
        if value <= 1 + gap:
            break
        step = np.linalg.solve(basis, pattern)
        fit = step > 1e-9
        if not fit.any():
            break
        ratio = np.where(fit, use / np.where(fit, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    else:
        warnings.warn(f"patterns priced {20 * len(widths)} times; the plan may take more sequences than its bound allows", stacklevel=2)
    use = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-6)
    left = need.astype(np.int64)
    for j in np.argsort(-use, kind="stable"):
        have = basis[:, j] > 0
        n = min(int(use[j]), int((left[have] // basis[have, j].astype(np.int64)).min()))
        if n > 0:
            plan.append((n, {int(w): int(a) for w, a in zip(widths[have], basis[have, j])}))
            left[have] -= n * basis[have, j].astype(np.int64)
    while left.sum():
        space, taken = room, {}
        for i in range(len(widths) - 1, -1, -1):
            if left[i] and widths[i] <= space:
                n = int(min(left[i], space // widths[i]))
                taken[int(widths[i])] = n
                space -= n * int(widths[i])
        n = min(int(left[np.searchsorted(widths, w)]) // a for w, a in taken.items())
        for w, a in taken.items():
            left[np.searchsorted(widths, w)] -= n * a
        plan.append((n, taken))
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, pieces of the class in one sequence) of each pattern and class."""
    out, used, sequence = [], {}, 0
    for n, taken in plan:
        for w, a in taken.items():
            first = used.get(w, 0)
            out.append((w, first, first + n * a, sequence, a))
            used[w] = first + n * a
        sequence += n
    return out


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, special: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``docs`` needs doc_id and text;
    other columns are ignored. ``special`` names strings that stand for one id each; any other is ordinary text. Null or
    empty text: one piece with the end id alone. Repeated rows are packed as often as they occur. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    unit = -(-capacity // CLASSES)
    room = capacity // unit
    pieces = settle(cut_pieces(docs, vocabulary, capacity, end_id, special)
                    .withColumn("w", F.when(F.col("length") == capacity, F.lit(room)).otherwise(F.ceil(F.col("length") / unit)).cast("int"))
                    .withColumn("b", bucket(BUCKETS, "doc_id", "start", "ids_crc32")))
    sizes = pieces.groupBy("w", "b").count()
    counts = {r["w"]: r["n"] for r in sizes.groupBy("w").agg(F.sum("count").alias("n")).collect()}
    slots = spark.createDataFrame(_slots(plan_patterns(counts, room)), "w int, r0 long, r1 long, s0 long, a long")
    before = sizes.select("w", "b", (F.sum("count").over(Window.partitionBy("w").orderBy("b")) - F.col("count")).alias("before"))
    local = F.row_number().over(Window.partitionBy("w", "b").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    ranked = pieces.withColumn("local", local).join(before, ["w", "b"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    placed = ranked.join(F.broadcast(slots), "w").where("rank >= r0 and rank < r1").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr("s0 + (rank - r0) div a").alias("sequence_id"), "w", "rank")
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("w", "rank")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          special=special_tokens(public_tokenizers.path("byte_bpe_50k.json")))
