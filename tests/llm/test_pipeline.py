"""The pipeline, stage by stage, against plain Python on a small folder of tables."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from llm import packing, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def similar(a, b):
    return 180 * len(a & b) >= 80 * (len(a) + len(b))


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghiklmnorstuw") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    rows, marks = [], []
    for i in range(300):
        own = [rng.choice(words) for _ in range(rng.randrange(8, 120))]
        if i % 4 == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["blorkhead", "snargface", "vileworm"]))
        if i % 5 == 0:
            own.append(f"mail{i}@site.example.com")
        text = " ".join(own[:6]) + "\n" + " ".join(own[6:])
        if i % 50 == 49:
            text = rows[-2][1]
        if i % 50 == 48:
            text = " ".join(own[1:]) if i < 100 else rows[-3][1] + "\nextra words at the end"
        rows.append((i, text, "en", "src", len(text)))
        marks.append((i, 1, int(i % 4 == 0)))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, "no id here", "en", "s", 10)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_copies", "surrogates", "packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, folder).cache()
    assert clean.columns == columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    model = toxicity.fit_in(docs, spark, folder)
    assert kept == {i: t for i, t in before.items() if t is None or model.scores([t])[0] < toxicity.THRESHOLD}
    bad = {i for i, t in before.items() if t and re.search("blorkhead|snargface|vileworm", t)}
    assert len(bad & set(kept)) <= .05 * len(bad) and len(set(before) - bad - set(kept)) <= .03 * len(before)

    lines = stages["line_dedup"](spark, clean, folder).cache()
    assert lines.columns == columns
    seen, want = [], {}
    for i in sorted(k for k in kept if k is not None):
        out = []
        for line in (kept[i] or "").split("\n"):
            s = frozenset(WORD.findall(line.translate(LOWER)))
            if not s or not any(similar(s, o) for o in seen):
                out.append(line)
            seen += [s] if s else []
        want[i] = None if kept[i] is None else "\n".join(out)
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert got == want | ({None: kept[None]} if None in kept else {})

    near = stages["near_copies"](spark, docs, folder)
    assert near.columns == columns
    sets = {i: shingles(t) for i, t in before.items() if i is not None}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and similar(sets[a], sets[b])]
    assert links
    for _ in range(8):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in near.collect()} == {i for i in root if root[i] == i} | {None}

    private = stages["surrogates"](spark, docs, folder)
    assert private.columns == columns
    new = {r["doc_id"]: r for r in private.collect()}
    assert set(new) == set(before)
    for i, t in before.items():
        mails = re.findall(r"\S+@\S+", t or "")
        assert re.sub(r"\S+@\S+", "@", t or "") == re.sub(r"\S+@\S+", "@", new[i]["text"] or "")
        assert not any(m in new[i]["text"] for m in mails)
        assert new[i]["n_chars"] == (None if t is None else len(new[i]["text"]))

    pieces = corpus_pipeline.run(spark, folder).collect()
    encoding = packing.byte_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ends = {r["doc_id"]: 0 for r in pieces}
    for r in pieces:
        ends[r["doc_id"]] += r["length"]
    assert all(ends[r["doc_id"]] == r["doc_tokens"] for r in pieces)
    assert set(ends) <= set(kept) and 500 in ends and ends[500] == 1
    assert len(encoding.encode_ordinary("x")) == 1


def test_near_copies_by_row(spark):
    """Texts of one id are told apart; of equal rows one stays; rows without id or words stay."""
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base.replace("w59", "x"), " ".join(f"v{i}" for i in range(40))
    rows = [(1, base, "en"), (7, near, "en"), (7, other, "en"), (7, other, "de"), (7, other, "en"), (8, "", "en"), (8, None, "en"), (9, "", "en"), (None, base, "en"), (3, base, "en")]
    docs = spark.createDataFrame([(*r, "s", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=str) == sorted(
        [(1, base, "en"), (7, other, "de"), (8, "", "en"), (8, None, "en"), (9, "", "en"), (None, base, "en")], key=str)
