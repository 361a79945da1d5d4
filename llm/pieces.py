"""Encoding and decoding with a merge-type piece vocabulary (score-ordered merges, byte fallback).

Each text is cut between characters that stand side by side in no piece, so no merge can cross a cut; equal
parts are encoded once.
A part's agenda holds its adjacent symbol pairs that form a piece. The pair of the highest score, leftmost
among equals, is merged and its two neighbours are entered anew, until the agenda is empty. Short parts run in
numpy, one agenda per row; long ones on a heap. Every newly met part is checked against the library.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import rows
from llm.words import mix, slices, spans
from llm.words import _VALUES as VALUES

BLANK = "▁"
#: Parts of more symbols than this are merged on a heap.
SHORT = 40
#: Parts kept between batches.
KEPT = 400_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Pieces:
    """Symbols, merges and rendered ids of a vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        special = [i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)]
        if any(lib.is_unused(i) for i in special):
            raise ValueError("vocabularies with unused pieces are not supported")
        names = {lib.id_to_piece(i): i for i in set(range(size)) - set(special)}
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        letters = sorted({c for p in names for c in p} - set(names))
        #: Symbol numbers: ids of pieces, then letters that are no piece, then any other character.
        self.symbol = {**names, **{c: size + i for i, c in enumerate(letters)}}
        self.other = size + len(letters)
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        merges = {}
        for piece, i in names.items():
            for k in range(1, len(piece)):
                pair = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if None not in pair:
                    merges[pair[0] << 32 | pair[1]] = i
        keys = np.array(sorted(merges), np.int64)
        made = np.array([merges[k] for k in keys.tolist()], np.int32)
        bits = max(16, int(len(keys)).bit_length() + 2)
        self.shift, slots = np.uint64(64 - bits), 1 << bits
        self.table_key, self.table_made = np.full(slots, -1, np.int64), np.full(slots, -1, np.int32)
        self.reach = 1
        for k, m in zip(keys.tolist(), made.tolist()):
            at = (k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            tries = 1
            while self.table_key[at] >= 0:
                at, tries = (at + 1) % slots, tries + 1
            self.table_key[at], self.table_made[at] = k, m
            self.reach = max(self.reach, tries)
        #: Whether some piece holds two bytes side by side; bytes of letters beyond ASCII count alike, and always join each other.
        self.joined = np.zeros((256, 256), bool)
        self.joined[128:, 128:] = True
        for p in names:
            plain = [ord(c) if c < "\x80" else 128 for c in p.replace(BLANK, " ")]
            self.joined[plain[:-1], plain[1:]] = True
        self.joined[129:, :128] = self.joined[128, :128]
        self.joined[:128, 129:] = self.joined[:128, 128:129]
        self.line = [lib.piece_to_id("\n")] if "\n" in names else [int(self.byte[10])]
        self.ahead = lib.encode("\n")[:-len(self.line)]
        if self.joined[10].any() or self.joined[:, 10].any():
            raise ValueError("vocabularies that join line feeds are not supported")
        #: Rank of a piece as an order of merging: a higher score first.
        scores = np.array([lib.get_score(i) for i in range(size)])
        levels = np.unique(scores)
        self.rank = np.append(np.searchsorted(levels, scores), -1).astype(np.int32)
        self.surface = [b"" if i in special else lib.id_to_piece(i).replace(BLANK, " ").encode() for i in range(size)]
        for b in range(256):
            self.surface[self.byte[b]] = bytes([b])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols form, or -1."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = np.where(self.table_key[at] == key, self.table_made[at], -1)
        open_ = np.flatnonzero((self.table_key[at] != key) & (self.table_key[at] >= 0))
        for step in range(1, self.reach):
            if not len(open_):
                break
            spot = (at[open_] + step) % len(self.table_key)
            hit = self.table_key[spot] == key[open_]
            found[open_[hit]] = self.table_made[spot[hit]]
            open_ = open_[~hit & (self.table_key[spot] >= 0)]
        return found

    def merge_rows(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agendas of many short parts: symbols is one row per part, n their numbers of symbols."""
        symbols, n = symbols.copy(), n.copy()
        width = symbols.shape[1]
        if width < 2:
            return symbols, n
        made = self.pair(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(-1, width - 1)
        made[np.arange(1, width)[None, :] >= n[:, None]] = -1
        live = np.flatnonzero((made >= 0).any(1))
        cols = np.arange(width)
        while len(live):
            m, s = made[live], symbols[live]
            best = self.rank[m].argmax(1)
            r = np.arange(len(live))
            new = m[r, best]
            take = cols[None, :] + (cols[None, :] > best[:, None])
            take[:, -1] = np.minimum(take[:, -1], width - 1)
            s = np.take_along_axis(s, take, 1)
            s[r, best] = new
            m = np.take_along_axis(np.append(m, np.full((len(m), 1), -1, m.dtype), 1), take, 1)[:, :-1]
            n[live] -= 1
            left = best > 0
            m[r[left], best[left] - 1] = self.pair(s[r[left], best[left] - 1], new[left])
            right = best + 1 < n[live]
            m[r[right], best[right]] = self.pair(new[right], s[r[right], best[right] + 1])
            m[r[~right], np.minimum(best[~right], width - 2)] = -1
            symbols[live], made[live] = s, m
            live = live[(m >= 0).any(1)]
        return symbols, n

    def merge_heap(self, symbols: list[int]) -> list[int]:
        """The same agenda for one long part, on a heap; positions are linked both ways."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            got = int(self.pair(np.array([symbols[i]]), np.array([symbols[j]]))[0])
            if got >= 0:
                heapq.heappush(agenda, (-int(self.rank[got]), i, symbols[i], symbols[j], got))

        first = self.pair(np.array(symbols[:-1]), np.array(symbols[1:])) if n > 1 else []
        agenda = [(-int(self.rank[g]), i, symbols[i], symbols[i + 1], int(g)) for i, g in enumerate(first) if g >= 0]
        heapq.heapify(agenda)
        while agenda:
            _, i, left, right, made = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                enter(i, after[j])
            if before[i] >= 0:
                enter(before[i], i)
        return [s for s in symbols if s >= 0]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts, which hold BLANK in place of spaces."""
        out: list[list[int]] = [[] for _ in parts]
        sizes = np.array([len(p) for p in parts])
        short = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
        short = short[np.argsort(sizes[short], kind="stable")]
        for group in np.split(short, np.searchsorted(sizes[short], [6, 10, 14, 20])):
            if len(group):
                width, n = int(sizes[group].max()), sizes[group]
                points = np.frombuffer("".join([parts[i].ljust(width, "\0") for i in group]).encode("utf-32-le"), np.uint32).reshape(-1, width)
                symbols, m = self.merge_rows(self.of_char[points], n)
                for i, row, k in zip(group.tolist(), symbols.tolist(), m.tolist()):
                    out[i] = row[:k]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            points = np.frombuffer(parts[i].encode("utf-32-le"), np.uint32)
            out[i] = self.merge_heap(self.of_char[points].tolist())
        last = self.library.get_piece_size()
        for i, ids in enumerate(out):
            if ids and max(ids) >= last:
                out[i] = self._fallback(parts[i], ids)
        return out

    def _fallback(self, part: str, symbols: list[int]) -> list[int]:
        """Characters that are no piece as the ids of their bytes."""
        ids, at, last = [], 0, self.library.get_piece_size()
        for s in symbols:
            if s < last:
                ids.append(s)
                at += len(self.library.id_to_piece(s))
            else:
                ids += self.byte[list(part[at].encode())].tolist()
                at += 1
        return ids

    def checked(self, parts: list[str]) -> list[list[int]]:
        """encode_parts, held against the library, which gets them as lines of one text; nothing joins a line feed."""
        got = self.encode_parts(parts)
        texts, want = range(0, len(parts), 16), []
        for i, ids in zip(texts, self.library.encode(["\n" + "\n".join(parts[i:i + 16]) for i in texts], num_threads=1)):
            want = ids[len(self.ahead):]
            if want != [x for own in got[i:i + 16] for x in self.line + own]:
                raise AssertionError(f"ids of {parts[i:i + 16]} differ: {got[i:i + 16]} and {want}")
        return got


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class _Parts:
    """Parts met so far: hash to rendered ids, surface bytes and number of ids."""

    def __init__(self, vocabulary: Pieces):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.ids: list[bytes] = []
        self.surface: list[bytes] = []
        self.n = np.zeros(0, np.int64)

    def rows_of(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row number of every part; parts not met before are encoded."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.ids) > KEPT:
            self.clear()
        at = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == unique[inside]
        fresh = first[~known]
        whole = data.tobytes()
        parts = [whole[s:e].decode("utf-8", "replace").replace(" ", BLANK) for s, e in zip(start[fresh].tolist(), end[fresh].tolist())]
        surface = self.vocabulary.surface
        base, count = len(self.ids), []
        for ids in self.vocabulary.checked(parts):
            self.ids.append((",".join(map(str, ids)) + ",").encode())
            self.surface.append(b"".join([surface[i] for i in ids]))
            count.append(len(ids))
        self.n = np.append(self.n, np.array(count, np.int64))
        order = np.argsort(np.append(self.hashes, unique[~known]), kind="stable")
        self.hashes = np.append(self.hashes, unique[~known])[order]
        self.row = np.append(self.row, base + np.arange(len(fresh)))[order]
        return self.row[np.searchsorted(self.hashes, unique)][inverse]


def encode_texts(texts: pa.Array, parts: _Parts) -> Iterator[tuple[int, bytes, bytes]]:
    """(number of ids, ids as text with a trailing comma, decoded bytes) of every text.

    A blank is set before a text that is not empty. Decoding drops that blank again.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring(texts, BLANK, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    joined = parts.vocabulary.joined
    for _, data, offsets in slices(texts):
        if not len(data):
            yield from ((0, b"", b"") for _ in offsets[1:])
            continue
        cut = np.ones(len(data), bool)
        cut[1:] = ~joined[data[:-1], data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        hashes = mix(spans(VALUES[data], start, end) ^ (end - start).astype(np.uint64))
        row = parts.rows_of(hashes, data, start, end)
        first = np.searchsorted(start, offsets)
        total = np.append(0, np.cumsum(parts.n[row]))
        row = row.tolist()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = row[a:b]
            yield int(total[b] - total[a]), b"".join([parts.ids[r] for r in own]), b"".join([parts.surface[r] for r in own])[1:]


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Number of ids, and hashes of ids and decoded text, of every document; with_ids adds ``ids`` and ``decoded``.

    ``docs`` needs doc_id and text; other columns are ignored. A null text is empty and has no ids. Repeated rows
    stay repeated.
    """
    schema = _ARROW.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string())) if with_ids else _ARROW

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(pieces(vocabulary))
        for batch in batches:
            n, ids, decoded, lists, plain = [], [], [], [], []
            for k, i, d in encode_texts(batch.column(1), parts):
                text = d.decode("utf-8", "replace")
                n.append(k)
                ids.append(hashlib.sha256(i[:-1]).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    lists.append([int(x) for x in i[:-1].split(b",") if x])
                    plain.append(text)
            yield rows(schema, doc_id=batch.column(0), n_tokens=n, ids_sha256=ids, decoded_sha256=decoded,
                       **({"ids": lists, "decoded": plain} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, RESULT + (", ids array<int>, decoded string" if with_ids else ""))


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
