"""Alignment of two tokenizers over the same bytes, by products of sparse incidence matrices.

A token-byte matrix has one row per token and one column per byte of the text; row i holds the bytes of token i. The
product A Bt of two such matrices has an entry wherever tokens of the two sides share bytes, and its value is the
number of bytes. A token-group matrix has one column per group, the stretch between two places where tokens of both
sides end; its product links all tokens of a group. Matrices are compressed rows built here by hand; products run row by
row after Gustavson, in blocks of rows whose merged entries stay bounded.

Byte-level ids come from the vocabulary in its rank form, which gives the same ids as the JSON file of that vocabulary
with special strings taken as plain text (held against each other in tests); piece ids come from sentencepiece.
Counts of linked id pairs cover the whole corpus: runs of documents send each distinct pair once (``llm.exchange``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import exchange as ex
from llm.common import rows, settle, table
from llm.words import SLICE_BYTES

#: Merged entries of one block of a product.
BLOCK = 1 << 22
RUN_BYTES = 8 << 20
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, n_shared long, groups_sha256 string")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
_RESULT = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared")]
                    + [("groups_sha256", pa.string())])


class Csr(NamedTuple):
    """A sparse matrix of small whole numbers: entries of row i lie at ptr[i]:ptr[i + 1]."""

    ptr: np.ndarray
    cols: np.ndarray
    data: np.ndarray
    width: int

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        ptr = np.append(0, np.cumsum(np.bincount(self.cols, minlength=self.width)))
        return Csr(ptr, self.row_numbers()[order], self.data[order], len(self.ptr) - 1)


def incidence(of: np.ndarray, size: int) -> Csr:
    """One row per element, one entry each: its column."""
    return Csr(np.arange(len(of) + 1), of, np.ones(len(of), np.int32), size)


def spans(end: np.ndarray, size: int) -> Csr:
    """Rows that cover the columns from the end of the row before to their own end."""
    return Csr(np.append(0, end), np.arange(size), np.ones(size, np.int32), size)


def product_sizes(x: Csr, y: Csr) -> np.ndarray:
    """Entries that every row of x y merges, equal columns counted once each time they come up."""
    total = np.append(0, np.cumsum(np.diff(y.ptr)[x.cols]))
    return total[x.ptr[1:]] - total[x.ptr[:-1]]


def product(x: Csr, y: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (row, column, value) of x y, sorted, in blocks of rows; a row's own entries are never parted.

    Gustavson: row i is the sum of the rows of y that the entries of row i of x name. The rows of a block are laid
    out one after the other and equal columns are added up.
    """
    total = np.append(0, np.cumsum(product_sizes(x, y)))
    i, n = 0, len(x.ptr) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + block, "right")) - 1)
        lo, hi = x.ptr[i], x.ptr[j]
        names = x.cols[lo:hi]
        sizes = y.ptr[names + 1] - y.ptr[names]
        at = np.repeat(y.ptr[names] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))
        row = np.repeat(np.repeat(np.arange(i, j), np.diff(x.ptr[i:j + 1])), sizes)
        col, value = y.cols[at], np.repeat(x.data[lo:hi], sizes) * y.data[at]
        i = j
        if not len(row):
            continue
        key = row * y.width + col
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, row, col, value = key[order], row[order], col[order], value[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        yield row[first], col[first], np.add.reduceat(value, first)


class Side(NamedTuple):
    """Bytes of every id of a vocabulary, end to end, with their places."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        shift = np.repeat(self.start[ids] - np.append(0, np.cumsum(size)[:-1]), size) if len(ids) else np.zeros(0, np.int64)
        return self.data[shift + np.arange(len(shift))]


def _side(surface: list[bytes]) -> Side:
    size = np.array([len(s) for s in surface])
    return Side(np.frombuffer(b"".join(surface), np.uint8), np.append(0, np.cumsum(size)[:-1]), size)


class Pair:
    """The two vocabularies."""

    def __init__(self, ranks: str, pieces: str):
        import sentencepiece

        from llm.packing import byte_encoding

        self.a = byte_encoding(ranks)
        self.b = lib = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.n_b = lib.get_piece_size()
        self.a_side = _side([self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)])
        self.b_side = _side([bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) or lib.is_unknown(i)
                             else p.replace("▁", " ").encode() for i in range(self.n_b) for p in [lib.id_to_piece(i)]])
        #: Decimal ids, each with the four endings that the text form of groups needs.
        self.written = [str(i).encode() + end for i in range(max(self.a.n_vocab, self.n_b)) for end in (b",", b"|", b";", b"")]


@lru_cache(2)
def pair(ranks: str, pieces: str) -> Pair:
    return Pair(ranks, pieces)


class Aligned:
    """Tokens of a slice of texts on one axis of bytes, texts without tokens left out.

    ``a`` and ``b`` are ids, ``a_text`` and ``b_text`` their texts, ``a_group`` and ``b_group`` their groups, counted over the
    slice; ``ok`` says which texts have tokens.
    """

    def __init__(self, vocabulary: Pair, texts: list[str | None]):
        self.vocabulary, self.n = vocabulary, len(texts)
        plain = [t or "" for t in texts]
        raw = [np.frombuffer((" " + t).encode(), np.uint8) for t in plain]
        a = [vocabulary.a.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) if t else np.zeros(0, np.int64) for t in plain]
        b = [np.array(i, np.int64) for i in vocabulary.b.encode(plain, num_threads=1)]
        size = np.array([len(r) for r in raw])
        self.ok = np.array([bool(t) for t in plain], bool)
        for side, ids in ((vocabulary.a_side, a), (vocabulary.b_side, b)):
            self.ok &= np.array([int(side.size[i].sum()) for i in ids], np.int64) == size
            for k in np.flatnonzero(self.ok).tolist():
                self.ok[k] = np.array_equal(side.joined(ids[k]), raw[k])
        self.keep = np.flatnonzero(self.ok)
        self.a, self.a_text, self.a_end = self._laid(vocabulary.a_side, a)
        self.b, self.b_text, self.b_end = self._laid(vocabulary.b_side, b)
        self.size = int(size[self.ok].sum())
        ends = np.zeros(self.size + 1, bool)
        ends[self.a_end] = True
        common = np.zeros(self.size + 1, bool)
        common[self.b_end] = ends[self.b_end]
        group = np.cumsum(common)
        self.n_all_groups = int(group[-1]) if self.size else 0
        self.a_group = group[self.a_end - vocabulary.a_side.size[self.a]]
        self.b_group = group[self.b_end - vocabulary.b_side.size[self.b]]

    def _laid(self, side: Side, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = [ids[k] for k in self.keep.tolist()]
        flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return flat, np.repeat(self.keep, [len(i) for i in kept]), np.cumsum(side.size[flat])

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, shared bytes) of every overlapping pair."""
        return product(spans(self.a_end, self.size), spans(self.b_end, self.size).transposed())

    def group_matrices(self) -> tuple[Csr, Csr]:
        return incidence(self.a_group, self.n_all_groups), incidence(self.b_group, self.n_all_groups).transposed()

    def shared_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of every pair that lies in one group."""
        return product(*self.group_matrices())

    def counts(self) -> dict[str, np.ndarray]:
        """Per text: tokens, groups and pairs of a group."""
        text_of_group = np.zeros(self.n_all_groups, np.int64)
        text_of_group[self.a_group] = self.a_text
        return {"n_a": np.bincount(self.a_text, minlength=self.n), "n_b": np.bincount(self.b_text, minlength=self.n),
                "n_groups": np.bincount(text_of_group, minlength=self.n),
                "n_shared": np.bincount(self.a_text, product_sizes(*self.group_matrices()), self.n).astype(np.int64)}

    def group_hashes(self) -> list[str]:
        """SHA-256 of the text form of every text's groups; '' for a text without tokens."""
        if not len(self.a):
            return [""] * self.n
        written = self.vocabulary.written
        a_before = np.append(0, np.cumsum(np.bincount(self.a_group, minlength=self.n_all_groups)))
        b_before = np.append(0, np.cumsum(np.bincount(self.b_group, minlength=self.n_all_groups)))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        last = np.append(self.a_group[1:] != self.a_group[:-1], True)
        codes[np.arange(len(self.a)) + b_before[self.a_group]] = self.a * 4 + last
        last = np.append(self.b_group[1:] != self.b_group[:-1], True)
        final = np.append(self.b_text[1:] != self.b_text[:-1], True)
        codes[np.arange(len(self.b)) + a_before[self.b_group + 1]] = self.b * 4 + np.where(final, 3, np.where(last, 2, 0))
        bounds = np.append(0, np.cumsum(np.bincount(self.a_text, minlength=self.n) + np.bincount(self.b_text, minlength=self.n))).tolist()
        codes = codes.tolist()
        return [hashlib.sha256(b"".join([written[c] for c in codes[x:y]])).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, id pair, links) of every distinct id pair that a text links, by text and pair; a pair is a * n_b + b."""
        both = [self.a_text[i] << 32 | (self.a[i] * self.vocabulary.n_b + self.b[j]) for i, j, _ in self.links()]
        if not both:
            return (np.zeros(0, np.int64),) * 3
        got, n = np.unique(np.concatenate(both), return_counts=True)
        return got >> 32, got & 0xFFFFFFFF, n


def _slices(ids: list, texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[list, list[str | None], int]]:
    """Runs of rows of about ``most`` characters; a longer text ends its run."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield ids[i:j + 1], texts[i:j + 1], size
            i, size = j + 1, 0
    if i < len(ids):
        yield ids[i:], texts[i:], size


def _settled_runs(docs: DataFrame, ranks: str, pieces: str, run_bytes: int) -> DataFrame:
    """Runs of aligned documents: distinct pairs with their links in the header, counts and pairs by document in the slices."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, numbers = pair(ranks, pieces), ex.run_numbers()
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            keys = np.unique(np.concatenate([p for *_, p, _ in held]))
            total, packed = np.zeros(len(keys), np.int64), []
            for ids, counts, hashes, ptr, p, n in held:
                at = np.searchsorted(keys, p)
                np.add.at(total, at, n)
                packed.append(ex.pack(doc_id=pa.array(ids, pa.int64()), **counts, groups_sha256=pa.array(hashes, pa.string()), ptr=ptr,
                                      at=at.astype(np.int32), n=n.astype(np.int32)))
            return ex.run_rows(next(numbers), ex.pack(keys=keys.astype(np.uint64), sums=total), packed)

        for batch in batches:
            for ids, texts, n_chars in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), min(run_bytes, SLICE_BYTES)):
                aligned = Aligned(vocabulary, texts)
                text, p, n = aligned.pairs()
                links = np.bincount(text, n, len(texts)).astype(np.int64)
                held.append((ids, aligned.counts() | {"n_links": links}, aligned.group_hashes(),
                             np.searchsorted(text, np.arange(len(texts) + 1)), p, n))
                size += n_chars
                if size >= run_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return settle(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(align, ex.RUNS))


def pair_counts(runs: DataFrame, bits: int) -> DataFrame:
    """The settled table of all linked id pairs with their number of links."""
    return settle(ex.sum_by_key(ex.spread(runs, bits, sums="sums"), "<i8"))


def best_counts(counts: DataFrame, n_b: int) -> np.ndarray:
    """The highest count of every B id; one number per id of a vocabulary, so it may pass the driver."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(n_b, np.int64)
        for batch in batches:
            for keys, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.maximum.at(best, (np.frombuffer(keys, np.uint64) % np.uint64(n_b)).astype(np.int64), np.frombuffer(sums, "<i8"))
        b = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(best[b])], ["b", "n"])

    got = counts.select("keys", "sums").mapInArrow(highest, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).toPandas()
    best = np.zeros(n_b, np.int64)
    best[got["b"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return best


def align_documents(docs: DataFrame, ranks: str, pieces: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Alignment figures of every document.

    Columns: doc_id, n_a, n_b (tokens), n_groups, n_links (overlapping token pairs), n_best (links whose id pair is the
    most counted of its B id, ties included), count_sum (corpus-wide counts over the links), n_shared (token pairs
    within a group), groups_sha256. ``docs`` needs doc_id and text; other columns are ignored. A null or empty text, or
    one that a tokenizer does not give back byte for byte, has no tokens: zeros and ''. Repeated rows stay and count as
    often as they occur; rows without doc_id stay. An empty table gives an empty result.
    """
    runs = _settled_runs(docs, ranks, pieces, run_bytes)
    bits = ex.shard_bits(runs)
    n_b = pair(ranks, pieces).n_b
    counts = pair_counts(runs, bits)
    best = best_counts(counts, n_b)

    def finish(run: int, header: dict, slices: list[bytes], answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        keys = header["keys"]
        n = ex.assembled(keys, answers, bits, "<i8")[:, 0]
        top = n == best[(keys % np.uint64(n_b)).astype(np.int64)]
        for payload in slices:
            got = ex.unpack(payload)
            at, times, ptr = got["at"], got["n"].astype(np.int64), got["ptr"]
            sums = [np.append(0, np.cumsum(x)) for x in (times * n[at], times * top[at])]
            yield rows(_RESULT, doc_id=got["doc_id"], **{c: got[c] for c in _COUNTS}, groups_sha256=got["groups_sha256"],
                       count_sum=sums[0][ptr[1:]] - sums[0][ptr[:-1]], n_best=sums[1][ptr[1:]] - sums[1][ptr[:-1]])

    return ex.by_run(runs, ex.look_up(ex.spread(runs, bits), counts, "<i8"), finish, RESULT)


def align_links(docs: DataFrame, ranks: str, pieces: str, shared: bool = False) -> DataFrame:
    """The links themselves: doc_id, a (place of the A token), b, a_id, b_id, weight (shared bytes).

    ``shared`` lists all pairs of a group instead, each of weight 1; their number is the product of the group's tokens.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("a_id", pa.int32()), ("b_id", pa.int32()), ("weight", pa.int32())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pair(ranks, pieces)
        for batch in batches:
            for ids, texts, _ in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = Aligned(vocabulary, texts)
                a_first, b_first = (np.append(0, np.cumsum(np.bincount(t, minlength=x.n))) for t in (x.a_text, x.b_text))
                for i, j, weight in (x.shared_links() if shared else x.links()):
                    text = x.a_text[i]
                    yield rows(schema, doc_id=pa.array(ids, pa.int64()).take(pa.array(text)), a=(i - a_first[text]).astype(np.int32),
                               b=(j - b_first[text]).astype(np.int32), a_id=x.a[i].astype(np.int32), b_id=x.b[j].astype(np.int32), weight=weight.astype(np.int32))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        align, "doc_id long, a int, b int, a_id int, b_id int, weight int")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
