"""Corpus-wide tables of 64-bit keys, and what runs of documents send to them and ask of them.

A run is the documents of about ``RUN_BYTES`` of text that one task reads; a longer text is a run alone. A run knows
each of its distinct keys once. So what it sends are packed numpy rows, one per (run, shard), not one row per key and
document. A shard holds the keys of one hash range. Their number follows an estimate of the distinct keys, so a
shard's table stays near ``SHARD_KEYS`` entries at every size of the corpus; hashing spreads the keys evenly.

* ``spread`` cuts what runs send by shard, ``sum_by_key`` adds it up per key, row by row of the sorted shards.
* ``look_up`` answers the runs' keys from such a table; the table's rows of a shard come before its requests.
* ``by_run`` brings the answers to the settled rows of their run.

Nothing here holds more than one shard's table or one run in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import rows

RUN_BYTES = 16 << 20
SHARD_KEYS = 1 << 18
#: Entries of one row of a shard's table.
PART_KEYS = 1 << 16
#: Entries held before they are added up.
FOLD = 1 << 20
#: One of 2 to the power of this many keys is counted for the estimate of distinct keys.
ESTIMATE_BITS = 6

RUNS = "run long, part int, payload binary"
SENT = "shard int, run long, keys binary, sums binary"
ANSWERS = "run long, shard int, payload binary"
_RUNS = pa.schema([("run", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
_SENT = pa.schema([("shard", pa.int32()), ("run", pa.int64()), ("keys", pa.binary()), ("sums", pa.binary())])
_ANSWERS = pa.schema([("run", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed Arrow message."""
    columns = [pa.LargeListArray.from_arrays(pa.array([0, len(a)], pa.int64()), pa.array(a)) for a in arrays.values()]
    batch = pa.RecordBatch.from_arrays(columns, list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    """Arrays of ``pack``; those that hold nulls or text come as Arrow arrays."""
    batch = pa.ipc.open_stream(payload).read_next_batch()
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        values = column.values
        plain = not values.null_count and not pa.types.is_large_string(values.type) and not pa.types.is_string(values.type)
        out[name] = values.to_numpy(zero_copy_only=False) if plain else values
    return out


def run_numbers() -> Iterator[int]:
    """Numbers of runs, different in every task and equal when a task runs again."""
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32
    while True:
        yield first
        first += 1


def run_rows(run: int, header: bytes, slices: list[bytes]) -> pa.RecordBatch:
    """A settled run: its header as part -1, then its slices."""
    return rows(_RUNS, run=[run] * (len(slices) + 1), part=range(-1, len(slices)), payload=[header, *slices])


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def by_shard(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts keys of one shard together, and the bounds of the shards in it."""
    shard = shard_of(keys, bits)
    return np.argsort(shard, kind="stable"), np.append(0, np.cumsum(np.bincount(shard, minlength=1 << bits)))


def sent_rows(run: int, keys: np.ndarray, sums: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """What a run sends to the shards of its sorted keys; without sums, a request."""
    order, bounds = by_shard(keys, bits)
    shards = [s for s in range(1 << bits) if bounds[s] < bounds[s + 1]]
    cuts = [order[bounds[s]:bounds[s + 1]] for s in shards]
    return rows(_SENT, shard=shards, run=[run] * len(shards), keys=[keys[c].tobytes() for c in cuts],
                sums=[None if sums is None else np.ascontiguousarray(sums[c]).tobytes() for c in cuts])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*[c if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]):
            yield tuple(v.as_py() if isinstance(v, pa.BinaryScalar) else v for v in row)


def headers(runs: DataFrame) -> DataFrame:
    return runs.where("part = -1").select("run", "payload")


def shard_bits(runs: DataFrame, name: str = "keys") -> int:
    """Bits of a shard's number, from an estimate of the distinct keys: an exact count in a small part of the hash range."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload in _records(batches):
            keys = unpack(payload)[name]
            yield pa.RecordBatch.from_arrays([pa.array(keys[shard_of(keys, ESTIMATE_BITS) == 0].view(np.int64))], ["k"])

    n = headers(runs).mapInArrow(few, "k long").select(F.count_distinct("k").alias("n")).first()["n"]
    return max(5, int(n << ESTIMATE_BITS).bit_length() - SHARD_KEYS.bit_length() + 1)


def spread(runs: DataFrame, bits: int, keys: str = "keys", sums: str | None = None) -> DataFrame:
    """What the headers of settled runs hold under these names, cut by shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, payload in _records(batches):
            got = unpack(payload)
            if len(got[keys]):
                yield sent_rows(run, got[keys], got[sums] if sums else None, bits)

    return headers(runs).mapInArrow(cut, SENT)


def _added(pending: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in pending])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(np.concatenate([v for _, v in pending])[order], first)


def sum_by_key(sent: DataFrame, dtype: str, width: int = 1) -> DataFrame:
    """The table of all keys: (shard, run, keys, sums) with a part number as run. Sums are rows of ``width`` numbers.

    Fractions are added up in double precision and written as ``dtype``.
    """
    wide = np.float64 if np.dtype(dtype).kind == "f" else np.dtype(dtype)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pending, size, folded = None, [], 0, 0

        def table() -> Iterator[pa.RecordBatch]:
            keys, sums = _added(pending)
            for part, i in enumerate(range(0, len(keys), PART_KEYS)):
                yield rows(_SENT, shard=[shard], run=[part], keys=[keys[i:i + PART_KEYS].tobytes()], sums=[sums[i:i + PART_KEYS].astype(dtype).tobytes()])

        for s, _, keys, sums in _records(batches):
            if s != shard and pending:
                yield from table()
                pending, size, folded = [], 0, 0
            shard = s
            pending.append((np.frombuffer(keys, np.uint64), np.frombuffer(sums, dtype).reshape(-1, width).astype(wide)))
            size += len(pending[-1][0])
            if size > 2 * folded + FOLD:
                pending = [_added(pending)]
                size = folded = len(pending[0][0])
        if pending:
            yield from table()

    return sent.repartition("shard").sortWithinPartitions("shard", "run").mapInArrow(add, SENT)


def look_up(requests: DataFrame, table: DataFrame, dtype: str, width: int = 1) -> DataFrame:
    """Rows of the table for the keys of every request, in the request's order; zeros for keys it does not hold."""
    both = table.withColumn("kind", F.lit(0)).unionByName(requests.withColumn("kind", F.lit(1)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, known, values = None, [], np.zeros(0, np.uint64), np.zeros((0, width), dtype)
        for s, kind, run, keys, sums in _records(batches):
            if s != shard:
                shard, parts, known, values = s, [], np.zeros(0, np.uint64), np.zeros((0, width), dtype)
            keys = np.frombuffer(keys, np.uint64)
            if kind == 0:
                parts.append((keys, np.frombuffer(sums, dtype).reshape(-1, width)))
                continue
            if parts:
                known, values = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
                parts = []
            out = np.zeros((len(keys), width), dtype)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = values[at[hit]]
            yield rows(_ANSWERS, run=[run], shard=[s], payload=[out.tobytes()])

    return (both.repartition("shard").sortWithinPartitions("shard", "kind", "run").select("shard", "kind", "run", "keys", "sums")
            .mapInArrow(answer, ANSWERS))


def assembled(keys: np.ndarray, answers: dict[int, bytes], bits: int, dtype: str, width: int = 1) -> np.ndarray:
    """The answers to a run's keys, in the order of the keys."""
    order, bounds = by_shard(keys, bits)
    out = np.zeros((len(keys), width), dtype)
    for s, payload in answers.items():
        out[order[bounds[s]:bounds[s + 1]]] = np.frombuffer(payload, dtype).reshape(-1, width)
    return out


def by_run(runs: DataFrame, answers: DataFrame | None, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(run, header, slices, answers)`` for every run, with its answers by shard; slices are yet packed."""
    both = runs.select("run", F.lit(1).alias("kind"), "part", "payload")
    if answers is not None:
        both = both.unionByName(answers.select("run", F.lit(0).alias("kind"), F.col("shard").alias("part"), "payload"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, header, slices, got = None, None, [], {}
        for r, kind, part, payload in _records(batches):
            if r != run and header is not None:
                yield from work(run, unpack(header), slices, got)
            if r != run:
                run, header, slices, got = r, None, [], {}
            if kind == 0:
                got[part] = payload
            elif part < 0:
                header = payload
            else:
                slices.append(payload)
        if header is not None:
            yield from work(run, unpack(header), slices, got)

    return both.repartition("run").sortWithinPartitions("run", "kind", "part").mapInArrow(each, schema)
