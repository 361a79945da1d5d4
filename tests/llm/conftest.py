import random

import pytest

LOREM = "amber birch cedar delta ember flint grove heath inlet jetty knoll larch marsh north ocean pearl quartz ridge slope thorn umber vale".split()


def sentence(rng, n):
    return " ".join(rng.choice(LOREM) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with exact and near copies, shared passages, repeated lines, nulls, empties and a long text."""
    rng = random.Random(5)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    shared, line = sentence(rng, 60), sentence(rng, 9)
    for _ in range(30):
        add("\n".join([sentence(rng, rng.randrange(3, 40)), line, sentence(rng, 12)]))
    for _ in range(6):
        add(sentence(rng, 20) + " " + shared + "\t" + sentence(rng, 20))
    base = sentence(rng, 200).split()
    for _ in range(12):
        words = list(base)
        words[rng.randrange(200)] = "changed%d" % rng.randrange(99)
        add(" ".join(words))
    for text in (rows[3][1], rows[3][1], rows[3][1].upper(), "", None, "one", "ONE", "two words", " \n\t \n", "tick " * 300, sentence(rng, 6000),
                 "é" * 40 + " naïve Ünïcödé   wide", line + " extra", "the\nthe\nthe cat\nthe cat", "\n\n"):
        add(text)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with a repeated row, rows without id, and extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src", len(t or ""), 1, "x", 2.0, "k") for i, t in corpus]
    rows += [rows[1], (None, corpus[2][1], "en", None, None, 1, "x", 2.0, "k"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, s string, score double, key string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
