"""Tokenizer alignment against plain Python, and the sparse products against dense ones."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm import alignment
from llm.alignment import align_documents, align_links

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a<|endoftext|>b", "<s> </s> <unk>", "a▁b", "▁", " ", "  two  blanks ", "日本語テキスト naïve ☃ 🙂🙂", "\n\n\t\r x", "x" * 3000, "<0x41> é", "\x00a\x00", "ﬁ ½ ａ",
       "1234567890 " * 200, "don't we'll", "ا ب ج", "é", "áb", "﻿bom", "trailing   "]


def plain(rows):
    """Figures of (doc_id, text) rows by tokens one at a time, byte-level ids from the JSON file."""
    import sentencepiece
    from tokenizers import Tokenizer

    lib_a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib_a.encode_special_tokens = True
    lib_b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(keep)))}
    out, counts, linked = [], Counter(), []
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a = lib_a.encode(" " + (text or ""), add_special_tokens=False)
        a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
        b = lib_b.encode(text or "")
        b_bytes = [bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(lib_b.id_to_piece, b))]
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            out.append([doc_id, 0, 0, 0, 0, ""])
            linked.append([])
            continue
        spans = [np.cumsum([0] + [len(x) for x in s]).tolist() for s in (a_bytes, b_bytes)]
        links, j0 = [], 0
        for i in range(len(a.ids)):
            while spans[1][j0 + 1] <= spans[0][i]:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j] < spans[0][i + 1]:
                links.append((i, j))
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(spans[0][1:]) & set(spans[1][1:])):
            i2, j2 = spans[0].index(end, i), spans[1].index(end, j)
            groups.append(",".join(map(str, a.ids[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        pairs = [(a.ids[i], b[j]) for i, j in links]
        counts.update(pairs)
        linked.append(pairs)
        out.append([doc_id, len(a.ids), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [tuple(o[:5]) + (sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), o[5]) for o, pairs in zip(out, linked)]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def key(row):
    return tuple((v is None, v) if not isinstance(v, str) else (False, v) for v in row)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=key)


def test_alignment_matches_plain(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(align_documents(docs, RANKS, PIECES)) == sorted(plain(rows), key=key)


def test_odd_texts(spark):
    rows = list(enumerate(ODD))
    assert got(align_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), RANKS, PIECES)) == sorted(plain(rows), key=key)


def test_small_runs_change_nothing(docs):
    assert got(align_documents(docs, RANKS, PIECES, run_bytes=2000)) == got(align_documents(docs, RANKS, PIECES))


def test_empty(empty):
    assert align_documents(empty, RANKS, PIECES).collect() == []


def test_links(spark):
    rows = list(enumerate(ODD[:8]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: r for r in plain(rows)}
    counted = {r.doc_id: (r.n, r.w) for r in align_links(docs, RANKS, PIECES).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert {d: n for d, (n, _) in counted.items()} == {d: r[4] for d, r in want.items() if r[4]}
    assert all(w == len((" " + ODD[d]).encode()) for d, (_, w) in counted.items())
    shared = {r.doc_id: r.n for r in align_links(docs, RANKS, PIECES, shared=True).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert shared == {r.doc_id: r.n_shared for r in align_documents(docs, RANKS, PIECES).collect() if r.n_shared}


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_product(block):
    rng = np.random.default_rng(3)
    dense = [(rng.random((13, 9)) < .3) * rng.integers(1, 5, (13, 9)), (rng.random((9, 11)) < .3) * rng.integers(1, 5, (9, 11))]

    def csr(m):
        row, col = np.nonzero(m)
        return alignment.Csr(np.append(0, np.cumsum(np.bincount(row, minlength=len(m)))), col, m[row, col], m.shape[1])

    x, y = map(csr, dense)
    out = np.zeros((13, 11), int)
    for row, col, value in alignment.product(x, y, block):
        out[row, col] += value
    assert (out == dense[0] @ dense[1]).all()
    t = x.transposed()
    assert (np.array([[(t.data[t.ptr[c]:t.ptr[c + 1]][t.cols[t.ptr[c]:t.ptr[c + 1]] == r]).sum() for c in range(9)] for r in range(13)]) == dense[0]).all()
