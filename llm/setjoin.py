"""Exact set-similarity join: rare-first prefixes, length, positional and signature filters, one check per pair.

Items are token sets cut out of texts (lines, shingle sets). Equal sets are one item, named by a 64-bit sum of their
tokens. Tokens are ordered by a frequency class, rare first, then by hash. The class comes from a counting table of
fixed size over all tokens: any order that is the same everywhere gives the same result, and this one puts tokens of
a notable share of the corpus last, so a common token is in the prefix of hardly any set.

Two sets of a and b tokens with Jaccard at least t share at least t * (a + b) / (1 + t) tokens. So they share one among
the first a - ceil(t * a) + 1 tokens of the larger and the first n - ceil(2t / (1 + t) * n) + 1 of the smaller. Prefix
tokens are dealt by token to cells, as packed numpy blocks; a cell with more than LIMIT rows is cut in blocks that are
compared block by block. A cell reports the prefix rows that have any partner left after the filters, not the pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import bucket, release, runs, settle
from llm.words import mix

#: Rows compared at once.
LIMIT = 1 << 18
#: The counting table has 2 to the power of this many counts.
SKETCH_BITS = 20
#: Bits of a token; the rest of 64 holds its frequency class.
TOKEN_BITS = 57
#: 64-bit words of the parities that prefix rows are joined with.
JOIN_WORDS = 16
SLOTS = 16
#: Members of a centre that are verified together.
STAR = 256
_MASK = np.uint64((1 << TOKEN_BITS) - 1)
#: A packed prefix row: token, size, position (65,535 for any above, which only weakens a filter), set, signature.
_ROW = np.dtype([("t", "<u4"), ("n", "<u4"), ("p", "<u2"), ("s", "<u8"), ("g", "<u8")])

#: Cuts items out of an Arrow array of texts: yields (index of the text, number within it, tokens, bounds) of some items.
Items = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


class Threshold:
    """Jaccard at least ``hundredths`` / 100, in whole numbers; methods take numpy arrays or Spark columns."""

    def __init__(self, hundredths: int = 80):
        self.h = hundredths

    def overlap(self, a, b):
        """Least number of shared tokens of sets of a and b tokens."""
        return -((-self.h * (a + b)) // (100 + self.h))

    def probe(self, n):
        return n + ((-self.h * n) // 100) + 1

    def index(self, n):
        return n + ((-2 * self.h * n) // (100 + self.h)) + 1

    def passes(self, a: Column, b: Column, words: int = 0) -> Column:
        """Filters on two prefix rows (structs of n, p, g, and w of some words) that share a token, in Spark."""
        need = F.ceil(self.h * (a["n"] + b["n"]) / (100 + self.h))
        low, high = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
        after = F.least(a["n"] - a["p"], b["n"] - b["p"])
        most = a["n"] + b["n"] - 2 * need
        out = (100 * low >= self.h * high) & (after >= need) & (F.bit_count(a["g"].bitwiseXOR(b["g"])) <= most)
        if words:
            differ = F.lit(0)
            for i in range(words):
                differ = differ + F.bit_count(F.get(a["w"], F.lit(i)).bitwiseXOR(F.get(b["w"], F.lit(i))))
            out = out & (F.coalesce(differ, F.lit(0)) <= most)
        return out


def distinct(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of every item, and the new bounds."""
    tokens = tokens.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            tokens[a:b].sort()
    keep = np.ones(len(tokens), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[bounds[:-1][bounds[:-1] < len(tokens)]] = True
    kept = np.append(0, np.cumsum(keep))
    return tokens[keep], kept[bounds]


def names(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set, whatever the order of its tokens; 0 for an empty set."""
    total = np.append(np.uint64(0), np.cumsum(mix((tokens & _MASK) + np.uint64(0x5EED))))
    n = np.diff(bounds)
    return np.where(n > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)), np.uint64(0))


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 parities of every set; two sets differ in at least as many tokens as parities."""
    bits = np.append(np.uint64(1) << (mix(tokens & _MASK) & np.uint64(63)), np.uint64(0))
    return np.where(np.diff(bounds) > 0, np.bitwise_xor.reduceat(bits, np.minimum(bounds[:-1], len(bits) - 1)), np.uint64(0)) if len(bounds) > 1 else bits[:0]


def parities(tokens: np.ndarray) -> bytes:
    """Parities of a set by the low bits of its tokens, four or more for each token and JOIN_WORDS words at least, as bytes."""
    bits = 64 * JOIN_WORDS
    while bits < 4 * len(tokens):
        bits *= 2
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def join_words(bits: bytes) -> list[int]:
    """Parities folded to JOIN_WORDS words."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > 8 * JOIN_WORDS:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return np.frombuffer(x.tobytes(), np.int64).tolist()


def parity_distance(a: bytes, b: bytes) -> int:
    """A lower bound on the number of tokens that are in one of two sets only; the finer parities are folded."""
    x, y = sorted((np.frombuffer(v, np.uint8) for v in (a, b)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def survey(texts: DataFrame, items: Items, parities_from: int, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """One row per item (doc, no, s, n, bits) and, at the end of each task, its share of the counting table (slot, counts).

    ``texts`` has two columns, id and text; more columns, of whole numbers, are handed on. bits are the parities of
    items of at least parities_from tokens. Written once, as every later step reads it.
    """
    more = texts.columns[2:]
    fields = pa.schema([("doc", pa.int64()), ("no", pa.int32()), ("s", pa.int64()), ("n", pa.int32()), ("slot", pa.int32()), ("counts", pa.binary()), ("bits", pa.binary()), *((c, pa.int64()) for c in more)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << sketch_bits, np.int64)
        for batch in batches:
            for at, no, tokens, bounds in items(batch.column(1)):
                tokens, bounds = distinct(tokens & _MASK, bounds)
                counts += np.bincount((tokens >> np.uint64(TOKEN_BITS - sketch_bits)).astype(np.int64), minlength=len(counts))
                k = len(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(no, pa.int32()), pa.array(names(tokens, bounds).view(np.int64)),
                                                  pa.array(np.diff(bounds), pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                                                  pa.array([parities(tokens[a:b]) if b - a >= parities_from else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
                                                  *(c.take(pa.array(at)) for c in batch.columns[2:])], schema=fields)
        parts = [p.astype(np.uint32).tobytes() for p in np.split(counts, SLOTS)]
        yield pa.RecordBatch.from_arrays([pa.nulls(SLOTS, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32())] + [pa.array(range(SLOTS), pa.int32()), pa.array(parts), pa.nulls(SLOTS, pa.binary()), *(pa.nulls(SLOTS, pa.int64()) for _ in more)], schema=fields)

    return settle(texts.mapInArrow(read, "doc long, no int, s long, n int, slot int, counts binary, bits binary" + "".join(f", {c} long" for c in more)))


def with_words(rows: DataFrame, surveyed: DataFrame) -> DataFrame:
    """Adds ``w``, the folded parities of each row's set; null for sets of few tokens."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([join_words(b) for b in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["s", "w"])

    words = surveyed.where("bits is not null").select("s", "bits").mapInArrow(fold, "s long, w array<long>").dropDuplicates(["s"])
    return rows.join(words, "s", "left")


def star_pairs(rows: DataFrame, row: Column, rule: Threshold) -> DataFrame:
    """(a, b, na, nb): for each set b the one set a that is the least, by ``row``, for the most of b's prefix tokens.

    The least of a token is a combinable minimum, so a hot token is not gathered anywhere.
    """
    heads = rows.groupBy("t").agg(F.min(row).alias("x"))
    met = rows.withColumn("y", row).join(heads, "t").where("x.s != y.s").where(rule.passes(F.col("x"), F.col("y")))
    shared = met.groupBy(F.col("y.s").alias("b"), F.col("x.s").alias("a")).agg(F.count("*").alias("c"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
    return shared.groupBy("b").agg(F.max(F.struct("c", "a", "na", "nb")).alias("m")).select("m.a", "b", "m.na", "m.nb")


def near_enough(pairs: DataFrame, surveyed: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (a, b) that the sets' parities don't rule out; pairs of a set without parities stay."""
    bits = surveyed.where("bits is not null").select("s", "n", "bits").dropDuplicates(["s"])
    x = bits.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = bits.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xa, xb = (c.to_pylist() for c in batch.columns[2:])
            good = [p is None or q is None or parity_distance(p, q) <= a + b - 2 * rule.overlap(a, b) for a, b, p, q in zip(na, nb, xa, xb)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(keep, "a long, b long")


def frequencies(surveyed: DataFrame) -> np.ndarray:
    """The counting table of all tokens, of fixed size, summed in tasks slot by slot."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[slot] = total.get(slot, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()])], ["slot", "counts"])

    got = surveyed.where("slot is not null").select("slot", "counts").repartition(SLOTS, "slot").mapInArrow(add, "slot int, counts binary").collect()
    if not got:
        return np.zeros(1 << SKETCH_BITS, np.int64)
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(got, key=lambda r: r["slot"])])


def ordered(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens with their frequency class in the top bits, so that a rising order is rare-first."""
    level = np.minimum(127, 4 * np.log2(np.maximum(counts, 1))).astype(np.uint64)
    tokens = tokens & _MASK
    return level[(tokens >> np.uint64(TOKEN_BITS + 1 - len(counts).bit_length())).astype(np.int64)] << np.uint64(TOKEN_BITS) | tokens


def _to_block(rows: np.ndarray) -> bytes:
    """Rows as bytes, field after field, which compresses better than row after row."""
    return b"".join(rows[k].tobytes() for k in _ROW.names)


def _from_block(block: bytes) -> np.ndarray:
    rows, at = np.zeros(len(block) // _ROW.itemsize, _ROW), 0
    for k in _ROW.names:
        kind = _ROW[k]
        rows[k] = np.frombuffer(block, kind, len(rows), at)
        at += len(rows) * kind.itemsize
    return rows


def _partnered(rows: np.ndarray, left: np.ndarray, rule: Threshold) -> np.ndarray:
    """Which rows have a partner after the filters. rows: sorted by (t, n); left: side of each (0, 1, or 2 for both)."""
    t, n, p, s, g = (rows[k].astype(np.int64) if k in "np" else rows[k] for k in _ROW.names)
    hit = np.zeros(len(rows), bool)
    change = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    # Partners of a row i as the smaller set: later rows of its token of at most n / t tokens.
    group = np.repeat(np.arange(len(change)), np.diff(np.append(change, len(t))))
    width = int(n.max()) + 2 if len(n) else 1
    reach = np.searchsorted(group * width + n, group * width + np.minimum(100 * n // rule.h, width - 1), "right")
    able = p < rule.index(n)
    live, step = np.flatnonzero(able & (reach > np.arange(len(rows)) + 1)), 1
    while len(live):
        i, j = live, live + step
        look = ~(hit[i] & hit[j]) & (s[i] != s[j]) & ((left[i] != left[j]) | (left[i] == 2))
        i, j = i[look], j[look]
        need = rule.overlap(n[i], n[j])
        good = (np.minimum(n[i] - p[i], n[j] - p[j]) >= need) & (np.bitwise_count(g[i] ^ g[j]) <= n[i] + n[j] - 2 * need)
        hit[i[good]] = True
        hit[j[good]] = True
        step += 1
        live = live[reach[live] > live + step]
    return hit


def matches(texts: DataFrame, items: Items, surveyed: DataFrame, rule: Threshold) -> DataFrame:
    """Prefix rows with a possible partner: t (token), s, n, p (position), g (signature); written once."""
    counts = frequencies(surveyed)
    size = surveyed.where("n > 0").select(F.sum(F.expr(f"n + floor(-{rule.h} * n / 100) + 1"))).first()[0] or 0
    cells = max(16, -(-int(size) // (LIMIT // 4)))

    def pack(blocks: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(blocks)
        cell = (rows["t"] % np.uint32(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        rows, cell = rows[order], cell[order]
        ends = np.flatnonzero(np.append(cell[1:] != cell[:-1], True)) + 1
        starts = np.append(0, ends[:-1])
        return pa.RecordBatch.from_arrays([pa.array(cell[starts], pa.int32()), pa.array(ends - starts), pa.array([_to_block(rows[a:b]) for a, b in zip(starts, ends)], pa.binary())], ["cell", "rows", "block"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for _, _, tokens, bounds in items(batch.column(1)):
                tokens, bounds = distinct(ordered(tokens, counts), bounds)
                n = np.diff(bounds)
                where = np.repeat(np.arange(len(n)), n)
                p = np.arange(len(tokens)) - bounds[:-1][where]
                own = p < rule.probe(n)[where]
                rows = np.zeros(int(own.sum()), _ROW)
                where = where[own]
                rows["t"] = mix(tokens[own]) >> np.uint64(32)
                rows["n"], rows["p"], rows["s"], rows["g"] = n[where], np.minimum(p[own], 65535), names(tokens, bounds)[where], signatures(tokens, bounds)[where]
                held.append(rows)
                n_held += len(rows)
                if n_held > LIMIT:
                    yield pack(held)
                    held, n_held = [], 0
        if n_held:
            yield pack(held)

    blocks = settle(texts.mapInArrow(prefixes, "cell int, rows long, block binary"))
    # Only cells above the limit come to the driver; there are at most (all rows / LIMIT) of them.
    large = {r["cell"]: -(-r["n"] // LIMIT) for r in blocks.groupBy("cell").agg(F.sum("rows").alias("n")).where(F.col("n") > LIMIT).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a large cell go to each pair of parts that holds their own."""
        for batch in batches:
            cell = batch.column(0).to_pylist()
            out = []
            for k, c in enumerate(cell):
                parts = large.get(c, 1)
                mine = zlib.crc32(batch.column(2)[k].as_py()) % parts if parts > 1 else 0
                out += [(k, min(mine, o), max(mine, o), mine) for o in range(parts)]
            k, i, j, mine = (pa.array(c) for c in zip(*out)) if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(k), i.cast(pa.int32()), j.cast(pa.int32()), mine.cast(pa.int32()), batch.column(2).take(k)], ["cell", "i", "j", "mine", "block"])

    dealt = blocks.mapInArrow(deal, "cell int, i int, j int, mine int, block binary") if large else blocks.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("mine"), "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            cell, i, j, mine = (table.column(c).to_numpy() for c in range(4))
            key = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
            for a, b in zip(key.tolist(), [*key[1:].tolist(), len(cell)]):
                parts = [_from_block(x) for x in table.column(4).slice(a, b - a).to_pylist()]
                rows = np.concatenate(parts)
                side = np.repeat(np.where(i[a] == j[a], 2, mine[a:b] == j[a]), [len(x) for x in parts])
                order = np.lexsort((rows["s"], rows["n"], rows["t"]))
                rows, side = rows[order], side[order]
                fresh = np.ones(len(rows), bool)
                fresh[1:] = (rows["t"][1:] != rows["t"][:-1]) | (rows["s"][1:] != rows["s"][:-1]) | (side[1:] != side[:-1])
                rows, side = rows[fresh], side[fresh]
                rows = rows[_partnered(rows, side, rule)]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[k].astype(np.int64) if k != "g" and k != "s" else rows[k].view(np.int64)) for k in ("t", "s", "n", "p", "g")], ["t", "s", "n", "p", "g"])

    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = settle(dealt.mapInArrow(compare, "t long, s long, n long, p long, g long").distinct())
    release(blocks)
    return found


def sets_of(texts: DataFrame, items: Items, wanted: DataFrame) -> DataFrame:
    """(s, tokens) of the wanted items (s, doc, no): the texts of their documents are cut again."""
    id_col, text_col = texts.columns
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("no", "s")).alias("want")).withColumnRenamed("doc", id_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = [{(w["no"], w["s"]) for w in x} for x in batch.column(1).to_pylist()]
            for at, no, tokens, bounds in items(batch.column(0)):
                tokens, bounds = distinct(tokens & _MASK, bounds)
                s = names(tokens, bounds).view(np.int64)
                own = [k for k, key in enumerate(zip(at.tolist(), no.tolist(), s.tolist())) if key[1:] in want[key[0]]]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(s[own]), pa.array([tokens[bounds[k]:bounds[k + 1]].tobytes() for k in own], pa.binary())], ["s", "tokens"])

    return texts.join(lists, id_col).select(text_col, "want").mapInArrow(cut, "s long, tokens binary").dropDuplicates(["s"])


def verify(pairs: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are similar enough. A centre a meets its members in runs of STAR."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    cells = pairs.join(many, "a").withColumn("part", bucket(1 << 30, "b") % F.col("parts"))
    roles = cells.select("a", "part", F.col("b").alias("s"), F.lit(1).alias("role")).union(
        cells.select("a", "part", F.col("a").alias("s"), F.lit(0).alias("role")).distinct())
    placed = roles.join(sets, "s").select("a", "part", "role", "s", "tokens").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            a, part, role, s = (table.column(c).to_numpy() for c in range(4))
            raw = table.column(4)
            centre, steps, out = None, None, []
            for k in range(len(a)):
                if k and (a[k], part[k]) != (a[k - 1], part[k - 1]):
                    centre = None
                if role[k] == 0:
                    centre = np.frombuffer(raw[k].as_py(), np.uint64)
                    steps = np.append(0, np.arange(1, 8) * len(centre) // 8)
                    continue
                if centre is None:
                    raise ValueError(f"no tokens of the set {a[k]}")
                other = np.frombuffer(raw[k].as_py(), np.uint64)
                need = rule.overlap(len(centre), len(other))
                # Suffix filter: between pivots of one set the counts of both must not differ by too much in sum.
                counts = np.diff(np.append(np.searchsorted(other, centre[steps]), len(other)))
                own = np.diff(np.append(steps, len(centre)))
                head = np.searchsorted(other, centre[0])
                if head + np.abs(counts - own).sum() > len(centre) + len(other) - 2 * need:
                    continue
                at = np.searchsorted(centre, other)
                shared = int((centre[np.minimum(at, len(centre) - 1)] == other).sum())
                if shared >= need:
                    out.append((int(a[k]), int(s[k])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return settle(placed.mapInArrow(check, "a long, b long"))
