"""Substring de-duplication: words inside any window of WINDOW words that stands more than once are removed.

1. Every window has an anchor, its least phrase of PHRASE words by hash. Equal windows have equal anchors, and
   neighbouring windows mostly share one, so a text has few anchors. Anchors that occur once lead nowhere.
2. Recurring anchors are the phrases of Aho-Corasick automata, one for each shard of the documents that hold them, over
   words as characters. Streaming the shard's documents locates every occurrence of its phrases, word by word.
3. The windows around located anchors are confirmed: runs of windows with one anchor (segments) that stand twice
   recur whole; of the other segments, each window is counted among the distinct segments.
4. Documents are read once more with their recurring ranges, and covered words go.

Counts combine before shuffles and joins may be split by the optimizer, so a passage in a third of all documents is not
gathered in one task. A row is known by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import settle, table
from llm.words import Texts, mix, slices, spans

WINDOW = 35
PHRASE = 12
#: Phrases of one automaton; a shard with more gets several.
PHRASES = 80_000
_NONE = np.uint64(2**64 - 1)


def _segments(x: Texts, h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, first and last window start, first and last place of the anchor."""
    width = window - phrase + 1
    at, grams = x.grams(h, phrase)
    full = np.full(len(h) + 2 * width, _NONE)
    full[at] = grams
    low, size = full, 1
    while 2 * size <= width:
        low = np.minimum(low[:len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[:len(h)], low[width - size:width - size + len(h)])
    starts = np.flatnonzero(np.arange(len(h)) + window <= x.first[1:][x.text]) if len(h) else np.zeros(0, np.int64)
    if not len(starts):
        return (np.zeros(0, np.uint64),) + (starts,) * 4
    value = low[starts]
    new = np.append(True, (np.diff(starts) != 1) | (value[1:] != value[:-1]))
    lo, hi, g = starts[new], starts[np.append(new[1:], True)], value[new]
    view = np.lib.stride_tricks.sliding_window_view(full, width)
    first, last = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    for a in range(0, len(lo), 1 << 16):
        s = slice(a, a + (1 << 16))
        first[s] = lo[s] + (view[lo[s]] == g[s, None]).argmax(1)
        last[s] = hi[s] + width - 1 - (view[hi[s]][:, ::-1] == g[s, None]).argmax(1)
    return g, lo, hi, first, last


def _locate(h: np.ndarray, phrase_at: np.ndarray, phrase: int) -> np.ndarray:
    """Starts of every occurrence in h of the phrases that start at the given places, by Aho-Corasick automata."""
    import ahocorasick

    found = []
    for a in range(0, len(phrase_at), PHRASES):
        own = phrase_at[a:a + PHRASES]
        letters = np.unique(h[(own[:, None] + np.arange(phrase)).ravel()])
        code = np.searchsorted(letters, h)
        code = np.where((code < len(letters)) & (letters[np.minimum(code, len(letters) - 1)] == h), code + 1, 0)
        code += (code >= 0xD800) * 0x800
        text = code.astype("<u4").tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for i in own.tolist():
            automaton.add_word(text[i:i + phrase])
        automaton.make_automaton()
        found.append(np.fromiter((end for end, _ in automaton.iter(text)), np.int64) - (phrase - 1))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def repeated_ranges(texts: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(key, ranges): runs of recurring windows as first word << 32 | end word, for each row (key, text) that has any."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in slices(batch.column(1)):
                x = Texts(data, offsets)
                g, lo, _, first, last = _segments(x, x.hashes(), window, phrase)
                if len(g):
                    own = x.text[lo]
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column(0).take(pa.array(i + own)), pa.array((first - x.first[own]).astype(np.int32)),
                                                      pa.array(np.where(first == last, 1, 2).astype(np.int32))], ["g", "key", "p", "n"])

    seen = settle(texts.mapInArrow(anchors, "g long, key long, p int, n int"))
    again = seen.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    phrases = settle(seen.join(again, "g").groupBy("key").agg(F.collect_set("p").alias("phrases")))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, places = batch.column(0), batch.column(2)
            for i, data, offsets in slices(batch.column(1)):
                x = Texts(data, offsets)
                h = x.hashes()
                g, lo, hi, first, _ = _segments(x, h, window, phrase)
                part = places.slice(i, len(x.n))
                counts = np.diff(np.asarray(part.offsets))
                at = np.asarray(part.flatten()) + np.repeat(x.first[:-1], counts)
                located = np.zeros(len(h) + 1, bool)
                located[_locate(h, at[at + phrase <= len(h)], phrase)] = True
                own = located[first]
                g, lo, hi = g[own], lo[own], hi[own]
                if not len(g):
                    continue
                n = hi - lo + 1
                salted = mix(h + np.uint64(77))
                segment = mix(spans(salted, lo, hi + window) + n.astype(np.uint64))
                starts = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                windows = mix(spans(salted, starts, starts + window)).view(np.int64)
                text = x.text[lo]
                yield pa.RecordBatch.from_arrays([
                    key.take(pa.array(i + text)), pa.array(g.view(np.int64)), pa.array(segment.view(np.int64)), pa.array((lo - x.first[text]).astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(windows))], ["key", "g", "segment", "lo", "n", "windows"])

    held = settle(texts.join(phrases, "key").select("key", "text", "phrases").mapInArrow(segments, "key long, g long, segment long, lo int, n int, windows array<long>"))
    token = F.xxhash64("key", "lo")
    kinds = held.groupBy("g", "segment").agg(F.count("*").alias("times"), F.min(token).alias("chosen"))
    known = settle(held.join(kinds, ["g", "segment"]).select(
        "key", "g", "lo", "n", "times", F.when(token == F.col("chosen"), F.col("windows")).alias("windows")))
    whole = known.where("times > 1").select("key", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + window).alias("b"))
    # Rows that are repeated whole carry the same token; their windows then count more than once, as they should.
    each = known.where("windows is not null").select("key", "g", "lo", "times", F.posexplode("windows").alias("i", "w"))
    twice = each.groupBy("g", "w").agg(F.count("*").alias("c")).where("c > 1").select("g", "w")
    single = each.where("times = 1").join(twice, ["g", "w"]).select("key", (F.col("lo") + F.col("i")).alias("a"), (F.col("lo") + F.col("i") + window).alias("b"))
    both = whole.union(single).select("key", (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("range"))
    return both.groupBy("key").agg(F.collect_set("range").alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words, one space between) of every row.

    A word goes when any window of ``window`` consecutive words that covers it starts anywhere else too, in the same
    text included; windows are judged on the input. ``docs`` needs doc_id and text; other columns are ignored. Null and
    empty texts have no words. Rows that are repeated count as repeats of each other.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    ranges = settle(repeated_ranges(keyed.select("key", "text"), window, phrase))
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, own in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if own.is_valid:
                    step = np.zeros(n + 1, np.int64)
                    packed = own.values.to_numpy()
                    np.add.at(step, packed >> 32, 1)
                    np.add.at(step, packed & 0xFFFFFFFF, -1)
                    words = list(compress(words, (np.cumsum(step)[:n] == 0).tolist()))
                total.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())], schema=fields)

    joined = keyed.join(ranges, "key", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op9_passages(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
