"""Operators on texts against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import licenses, lines, packing, passages, pieces, pii, setjoin, shingles, toxicity
from llm.words import Texts, slices

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def similar(a, b):
    return 180 * len(a & b) >= 80 * (len(a) + len(b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\n\t\x0bé中😀", max_size=30)), max_size=8))
def test_words_are_cut_as_by_the_pattern(texts):
    got = []
    for i, data, offsets in slices(pa.array(texts, pa.string())):
        x = Texts(data, offsets)
        raw = data.tobytes()
        got += [[raw[a:b].decode() for a, b in zip(x.start[f:g], x.end[f:g])] for f, g in zip(x.first[:-1], x.first[1:])]
        by_word = {}
        for word, h in zip((raw[a:b] for a, b in zip(x.start, x.end)), x.hashes().tolist()):
            assert by_word.setdefault(word, h) == h
        assert len(set(by_word.values())) == len(by_word)
    assert got == [WORD.findall(t or "") for t in texts]


# -- near documents -------------------------------------------------------------------------------------------------

def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def least_reach(n, links):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_near_documents(spark, docs, empty, corpus):
    sets = [shingle_set(t) for _, t in corpus]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and similar(sets[a], sets[b])]
    root = least_reach(len(sets), links)
    want = collections.Counter((i, len(sets[i]), root[i]) for i in range(len(sets)))
    want[1, len(sets[1]), root[1]] += 1
    want[None, len(sets[2]), root[2]] += 1
    want[None, 0, None] += 1
    assert rows_of(shingles.near_documents(docs), "doc_id", "n_shingles", "component_id") == want
    assert shingles.near_documents(empty).count() == 0


def test_sets_of_rows_without_id_link(spark):
    # A row without id bridges two documents that are not near each other; it is centre or member as its hash falls.
    rng = random.Random(8)
    rows, want = [], collections.Counter()
    for k in range(12):
        base = [f"w{k}x{rng.randrange(10**6)}" for _ in range(200)]
        ends = [list(base), list(base)]
        for e, at in zip(ends, (10, 110)):
            for i in range(3):
                e[at + 20 * i] = f"new{at}"
        assert similar(shingle_set(" ".join(base)), shingle_set(" ".join(ends[0]))) and not similar(*(shingle_set(" ".join(e)) for e in ends))
        for i, words in ((2 * k, ends[0]), (None, base), (2 * k + 1, ends[1])):
            rows.append((i, " ".join(words)))
            want[i, 196, 2 * k] += 1
    got = rows_of(shingles.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "n_shingles", "component_id")
    assert got == want


def test_cells_above_the_limit_are_compared_in_blocks(spark, corpus, monkeypatch):
    texts = spark.createDataFrame([(i, t) for i, t in corpus], "doc_id long, text string").repartition(5)
    whole = rows_of(shingles.near_documents(texts), "doc_id", "n_shingles", "component_id")
    surveyed = setjoin.survey(texts, shingles.shingle_items(), 1)
    before = {r[:2] for r in rows_of(setjoin.matches(texts, shingles.shingle_items(), surveyed, setjoin.Threshold()), "t", "s")}
    monkeypatch.setattr(setjoin, "LIMIT", 40)
    after = {r[:2] for r in rows_of(setjoin.matches(texts, shingles.shingle_items(), surveyed, setjoin.Threshold()), "t", "s")}
    assert after == before and whole


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 300), max_size=120), st.sets(st.integers(0, 300), max_size=120))
def test_filters_never_rule_out_a_similar_pair(a, b):
    rule = setjoin.Threshold()
    tokens = [np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (a, b)]
    differ = len(a ^ b)
    assert setjoin.parity_distance(*(setjoin.parities(t) for t in tokens)) <= differ
    sig = setjoin.signatures(np.concatenate(tokens), np.array([0, len(a), len(a) + len(b)]))
    assert int(np.bitwise_count(sig[0] ^ sig[1])) <= differ
    if a and b:
        assert (len(a & b) >= rule.overlap(len(a), len(b))) == (100 * len(a & b) >= 80 * len(a | b))
        if similar(a, b):
            small, large = sorted((sorted(a), sorted(b)), key=len)
            assert set(small[:rule.index(len(small))]) & set(large[:rule.probe(len(large))])


# -- lines ----------------------------------------------------------------------------------------------------------

def test_lines(docs, empty, corpus):
    seen, want = [], {}
    for i, t in corpus:
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(WORD.findall(line.translate(LOWER)))
            if not s or not any(similar(s, o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[i] = None if t is None else "\n".join(kept)
    out = lines.dedupe_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert r["text"] == want[r["doc_id"]], r["doc_id"]
            assert r["n_removed"] == (0 if r["text"] is None else r["n_lines"] - r["text"].count("\n") - 1 if r["text"] or r["n_lines"] > r["n_removed"] else r["n_lines"])
        else:
            assert r["text"] in (None, corpus[2][1])
    assert lines.dedupe_lines(empty).count() == 0


def test_lines_of_one_id_with_two_texts(spark):
    """Texts that share an id share no fate; equal rows do."""
    rows = [(1, "alpha beta gamma delta\nother words of document one"), (7, "first line of seven here\nalpha beta gamma delta"),
            (7, "other words stand in this\nsecond line nobody else has"), (7, "other words stand in this\nsecond line nobody else has")]
    got = lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    kept = {t for i, t in rows_of(got, "doc_id", "text")}
    assert "first line of seven here" in kept and rows[0][1] in kept
    assert rows_of(got.where("text like 'other words stand%'"), "doc_id", "text") == {(7, rows[2][1]): 2}


# -- passages -------------------------------------------------------------------------------------------------------

def test_passages(docs, empty, corpus):
    texts = [(i, t) for i, t in corpus] + [corpus[1], (None, corpus[2][1]), (None, None)]
    words = [WORD.findall(t or "") for _, t in texts]
    seen = collections.Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    want = collections.Counter()
    for (doc, _), w in zip(texts, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert rows_of(passages.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == want
    assert passages.remove_repeats(empty).count() == 0


def test_passages_of_few_words_over_and_over(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["a", "b"]) for _ in range(rng.randrange(150)))) for i in range(40)] + [(99, "b " * 500), (100, "a b " * 200)]
    words = [t.split() for _, t in texts]
    seen = collections.Counter(tuple(w[i:i + 9]) for w in words for i in range(len(w) - 8))
    want = collections.Counter()
    for (doc, _), w in zip(texts, words):
        gone = [any(seen[tuple(w[k:k + 9])] > 1 for k in range(max(0, i - 8), min(i, len(w) - 9) + 1)) for i in range(len(w))]
        want[doc, sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert rows_of(passages.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), window=9, phrase=4), "doc_id", "n_removed", "kept") == want


# -- pieces ---------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\tab.,ée▁中0", max_size=120))
def test_pieces_equal_the_library(text):
    own = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    want = own.library.encode(text)
    [(n, ids, decoded)] = pieces.encode_texts(pa.array([text]), pieces._Parts(own))
    assert [int(x) for x in ids[:-1].split(b",") if x] == want and n == len(want)
    assert decoded.decode() == own.library.decode(want)


def test_pieces_of_documents(docs, empty, corpus, library):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = dict(corpus) | {None: None}
    got = pieces.encode_documents(docs, path, with_ids=True).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            ids = library.encode(texts[r["doc_id"]] or "")
            assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_documents(empty, path).count() == 0


def test_long_parts_run_on_a_heap():
    own = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for part in ("▁" + "abracadabra" * 30, "▁" * 70 + "x", "é" * 90):
        assert own.merge_heap(own.of_char[np.frombuffer(part.encode("utf-32-le"), np.uint32)].tolist()) == [
            s for s in own.merge_rows(own.of_char[np.frombuffer(part.encode("utf-32-le"), np.uint32)][None, :], np.array([len(part)]))[0][0][
                :own.merge_rows(own.of_char[np.frombuffer(part.encode("utf-32-le"), np.uint32)][None, :], np.array([len(part)]))[1][0]].tolist()]


# -- packing --------------------------------------------------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_patterns_take_every_piece_and_little_room(counts):
    plan = packing.plan_patterns(counts, 64)
    used = collections.Counter()
    for n, taken in plan:
        assert n > 0 and sum(w * a for w, a in taken.items()) <= 64
        for w, a in taken.items():
            used[w] += n * a
    assert used == collections.Counter(counts)
    size = sum(w * n for w, n in counts.items())
    small = sum(n for w, n in counts.items() if w <= 32)
    assert sum(n for n, _ in plan) <= 1.25 * size / 64 + 2 + sum(n for w, n in counts.items() if w > 32) or small == 0


def test_packing(spark, docs, empty, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert special == {"<|endoftext|>": 50256}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    odd = [(1000, "a<|endoftext|>b"), (1001, "two <|endoftext|>  <|endoftext|> x <|endoftext"), (1002, "<|endoftext|>")]
    corpus = [*corpus, *odd]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = packing.pack_documents(docs, path, capacity=256, special=special).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in corpus}
    assert ids[1000] == [64, 50256, 65, 1]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids) | {None}
    for i, want in ids.items():
        copies = 2 if i == 1 else 1
        assert sum(r["length"] for r in by_doc[i]) == copies * len(want)
        for r in by_doc[i]:
            own = np.array(want[r["start"]:r["start"] + r["length"]], "<u4")
            assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack_documents(empty, path).count() == 0


def test_ids_equal_those_of_the_other_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    encoding = packing.byte_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet=" \n\t\r\x0b'sé中😀1a.", max_size=80))
    def equal(text):
        assert encoding.encode_to_numpy(text, disallowed_special=()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids

    equal()
    assert encoding.encode_ordinary("a<|endoftext|>b") == tokenizer.encode("a<|endoftext|>b", add_special_tokens=False).ids


# -- licences -------------------------------------------------------------------------------------------------------

def test_licenses(spark, docs, empty):
    own = spark.createDataFrame([
        (1, "Released Under the MIT License. Later under THE mit, license!"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""),
        (5, "This work is licensed under the GNU General Public License, version 3."), (6, "the mit of license under"), (7, "Apache License, Version 2.0"),
        (8, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (8, "Permission is hereby granted"), (9, "été " * 5000 + "cc by nc"),
    ], "doc_id long, text string").withColumn("n_words", __import__("pyspark").sql.functions.lit("clash"))
    got = {(r["doc_id"], r["n_words"]): tuple(r)[2:] for r in licenses.scan_licenses(own).collect()}
    assert got[1, 10] == (2, 1, 6, "mit", "mit", 1.0)
    assert got[2, 7] == (1, 2, 2, "cc-by-nc", "cc-by-nc", 1.0)
    assert got[3, 0] == got[4, 0] == (0, None, None, "", "", 0.0)
    assert got[5, 12][:5] == (0, None, None, "", "gpl-3") and got[5, 12][5] > .8
    assert got[6, 5][3:] == ("", "", 0.0)
    assert got[7, 5][:4] == (1, 0, 0, "apache-2")
    assert got[8, 13][4] == "mit" and got[8, 4][4] == ""
    assert got[9, 5003][:3] == (1, 5000, 5000)
    assert licenses.scan_licenses(docs).count() == docs.count()
    assert licenses.scan_licenses(empty).count() == 0


# -- toxicity -------------------------------------------------------------------------------------------------------

def _labelled(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnorstuw") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    bad = ["blorkhead", "snargface", "vileworm", "grubbler"]
    texts, marks = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 250))]
        if i % 3 == 0:
            for _ in range(2):
                own.insert(rng.randrange(len(own) + 1), rng.choice(bad) + rng.choice(["", ",", "."]))
        texts.append(" ".join(own))
        marks.append(int(i % 3 == 0))
    return texts, marks


def test_toxicity_learns_and_bears_misspellings(spark, docs, empty):
    texts, marks = _labelled(900, 1)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, labels.where("doc_id % 4 != 2 or doc_id is null"), sample_per_class=300)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(frame, model).collect()}
    held = [i for i in range(900) if i % 4 == 2]
    assert sum(got[i] == marks[i] for i in held) / len(held) > .97
    clean = _labelled(60, 1)[0][1]
    misspelt = model.scores([f"{clean} blorkheadd {clean}", f"{clean} snargfacez"])
    assert (misspelt > model.scores([clean])[0]).all() and (misspelt >= .3).all()
    assert 0 <= model.scores([""])[0] <= 1 and model.scores(["x " * 50000]).shape == (1,)
    out = toxicity.drop_toxic(docs, model)
    assert out.columns == docs.columns
    assert {r["text"] for r in out.collect()} <= {r["text"] for r in docs.collect()}
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.fit(empty, labels.limit(0)).scores(["a"]).shape == (1,)


def test_without_toxic_labels_nothing_is_rejected(spark, docs):
    for marks in ([], [(1, 1, 0)], [(i, 1, 0) for i in range(9)]):
        model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
        assert toxicity.drop_toxic(docs, model).count() == docs.count()
    assert toxicity.drop_toxic(docs, toxicity.train(["x"], [True])).where("text is not null").count() == 0
    assert toxicity.drop_toxic(docs, toxicity.train(["x"], [True])).count() == docs.where("text is null").count()


def test_ngrams_stay_inside_their_word():
    bags = toxicity.Bags(["ab, Cde", "", "ab"])
    # <ab ab> <ab> | <cd cde de> <cde cde> <cde> | the same for the last text.
    assert sum(len(at) for at, _ in bags.grams()) == 3 + 6 + 3
    weights = np.random.default_rng(0).normal(size=1 << toxicity.BUCKETS_LOG2)
    total, count = bags.word_scores(weights)
    assert count.tolist() == [3, 6, 3] and total[0] == pytest.approx(total[2])


# -- personal data --------------------------------------------------------------------------------------------------

def test_surrogates(spark, docs, empty):
    mails = [f"user{i}.x@mail{i % 3}.example.com" for i in range(150)]
    texts = [(i, f"Write to {m} or {m.upper()}, or call +1 ({200 + i}) 555-{1000 + i}.") for i, m in enumerate(mails)]
    texts += [(900, "Mrs. Anna Smith met Mr. Paul Smith; Mrs. Anna Smith left. госпожа Анна Иванова 4111-1111-1111-1111 10.0.0.7"), (901, None), (902, ""), (903, "2021-10-11 12345 nothing v1.2.3.4")]
    frame = spark.createDataFrame([(i, t, 7) for i, t in texts] + [(0, texts[0][1], 7)], "doc_id long, text string, spans int")
    got = pii.replace_entities(frame, "k").collect()
    assert len(got) == len(texts) + 1
    new = {r["doc_id"]: r for r in got}
    values = {i: [s["surrogate"] for s in new[i]["spans"]] for i in range(150)}
    assert all(len(v) == 3 and v[0].lower() == v[1].lower() for v in values.values())
    assert len({v[0].lower() for v in values.values()}) == 150 and not {v[0].lower() for v in values.values()} & set(mails)
    assert len({v[0].split("@")[1] for v in values.values()}) == 3
    assert all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", v[2]) for v in values.values()) and len({v[2] for v in values.values()}) == 150
    assert all(texts[i][1].split()[0] == new[i]["text"].split()[0] and mails[i] not in new[i]["text"] for i in range(150))
    spans = new[900]["spans"]
    names = [s["surrogate"] for s in spans if s["kind"].startswith(("given", "surname"))]
    assert names[0] == names[4] and names[1] == names[3] == names[5] and names[0] != names[2]
    assert names[0][-1] in "ae" and "Smith" not in new[900]["text"] and re.search("[А-Я]", names[6])
    card = next(s["surrogate"] for s in spans if s["kind"] == "card")
    assert pii.luhn(card.replace("-", "")) and re.fullmatch(r"4\d{3}(-\d{4}){3}", card)
    assert new[901]["text"] is None and new[902]["text"] == "" and new[903]["text"] == texts[-1][1] and new[903]["n_entities"] == 0
    assert pii.replace_entities(docs).count() == docs.count() and pii.replace_entities(empty).count() == 0


def test_names_without_title_get_the_surrogate_of_their_document(spark):
    texts = [(1, "Smith came. Mr. John Smith’s car: Smith-led, SMITH's; John left, a smith and Smithson stayed."), (2, "Smith alone."), (3, "Mrs. Brown. Brown, госпожа Анна Иванова; Анна.")]
    new = {r["doc_id"]: r for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    own = {(s["kind"], s["surrogate"].casefold()) for s in new[1]["spans"]}
    assert len(own) == 2 and [texts[0][1][s["start"]:s["end"]] for s in new[1]["spans"]] == ["Smith", "John", "Smith", "Smith", "SMITH", "John"]
    given, last = new[1]["spans"][1]["surrogate"], new[1]["spans"][0]["surrogate"]
    assert new[1]["text"] == f"{last} came. Mr. {given} {last}’s car: {last}-led, {last.upper()}'s; {given} left, a smith and Smithson stayed."
    assert new[2]["text"] == texts[1][1] and new[3]["n_entities"] == 5 and not re.search("Brown|Анна", new[3]["text"])


def test_every_text_with_an_entity_passes_the_filter(spark):
    digits = [chr(i) for i in range(0x110000) if chr(i).isdecimal()]
    texts = [f"call +{d * 2} {d * 3} {d * 3} {d * 4} now" for d in digits] + ["a@b.cd", "AKIA" + "A" * 16, *(f"{t} Abc" for t in pii.TITLES), *(f"{t}. Abc" for t in pii.TITLES)]
    assert all(pii.find_entities(t) for t in texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in frame.where(~frame["text"].rlike(pii.MAY_HOLD)).collect()] == []
    full = spark.createDataFrame([(1, "call +８１ ９０１ ２３４ ５６７８ now")], "doc_id long, text string")
    assert pii.replace_entities(full).first()["n_entities"] == 1


def test_colliding_draws_are_drawn_again(spark, monkeypatch):
    # A form with 9 members for the last part: many collisions, all resolved.
    entities = spark.createDataFrame([("ip", f"{a}.{b}.1.1") for a in range(1, 5) for b in range(1, 10)], "kind string, norm string")
    got = [r["value"] for r in pii.assign_surrogates(entities, "k").collect()]
    assert len(set(got)) == 36 and not set(got) & {f"{a}.{b}.1.1" for a in range(1, 5) for b in range(1, 10)}
