"""License scan by a positional index of rare words, with DataFrame functions alone.

Templates are short notices. Every word of the templates gets an inverse document frequency from the whole
corpus. A template's anchors are its rarest words, as many as outweigh what a match may lack, so a match always
holds one of them. Per document the anchors' positions are looked up, the templates' postings of those words
give relative positions (alignments), and each alignment is weighed over the template's words and must hold
its key phrase in place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose labels are always given.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed values: (label, notice, key phrase within it).
TEMPLATES = [
    ("agpl-3", "gnu affero general public license version 3", "affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial", "attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "granted free of charge"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]
#: Share of a template's weight, in hundredths, that an alignment must hold.
SHARE = 75
VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def words_of(text: Column) -> Column:
    """Lower-cased (A to Z) words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_weights(docs: DataFrame) -> dict[str, int]:
    """Inverse document frequency of every template word over all documents, in thousandths. One bounded row set."""
    some = F.array_distinct(F.filter(words_of(F.col("text")), lambda x: x.isin(VOCABULARY)))
    # Every document also counts once under the empty word.
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), some)).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in found.collect()}
    n = df.get("", 0)
    return {w: int(math.floor(1000 * math.log(1 + (n + 1) / (df.get(w, 0) + 1)) + .5)) for w in VOCABULARY}


def anchors(notice: list[str], weights: dict[str, int]) -> list[int]:
    """Positions of the rarest words; the rest together weigh too little for a match."""
    order = sorted(range(len(notice)), key=lambda k: (-weights[notice[k]], k))
    total = sum(weights[w] for w in notice)
    rest, out = total, []
    while rest * 100 >= SHARE * total:
        k = order[len(out)]
        out.append(k)
        rest -= weights[notice[k]]
    return out


def _phrase_at(words: Column, at: Column, phrase: list[str], skip: int = 0) -> Column:
    out = F.lit(True)
    for k, w in enumerate(phrase):
        out = out & F.coalesce(F.get(words, at + (k + skip)) == w, F.lit(False))
    return out


def _find(notice: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(notice)) if notice[i:i + len(phrase)] == phrase)


def _places(words: Column, at: Column, phrase: list[str]) -> Column:
    """Those of the positions at which a phrase stands."""
    return F.filter(at, lambda i: _phrase_at(words, i, phrase))


def _share(words: Column, at: Column, notice: list[str], key: list[str], marks: list[int], weights: dict[str, int]) -> Column:
    """Best share of a template's weight over its verified alignments, or 0."""
    total = sum(weights[w] for w in notice)

    def starts(k: int) -> Column:
        return F.transform(F.filter(at, lambda i: F.get(words, i) == notice[k]), lambda i: i - k)

    def held(s: Column) -> Column:
        got = F.lit(0)
        for k, w in enumerate(notice):
            got = got + F.when(F.get(words, s + k) == w, weights[w]).otherwise(0)
        good = _phrase_at(words, s, key, _find(notice, key)) & (got * 100 >= SHARE * total)
        return F.when(good, got / F.lit(total)).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(F.array_distinct(F.concat(*map(starts, marks))), held)), F.lit(0.0))


def scan_licenses(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Label the licences of every document.

    Columns: doc_id, n_words, n_base (places of the fixed phrases), first_word, last_word (null without such a
    place), base_labels, labels (base and template labels; empty string for none), score (best weighed share of a
    verified template, 1 for a base phrase, else 0). ``docs`` needs doc_id and text; other columns are ignored. A
    null text has no words. Repeated rows stay repeated.
    """
    weights = weights or word_weights(docs)
    plans = [(label, notice.split(), key.split(), anchors(notice.split(), weights)) for label, notice, key in TEMPLATES]
    heads = {p.split()[0] for p in PHRASES}
    looked_up = sorted(heads | {notice[k] for _, notice, _, marks in plans for k in marks})
    words, at = F.col("_words"), F.col("_at")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("_words"))
    out = out.select("doc_id", "_words", F.filter(F.transform(words, lambda x, i: F.when(x.isin(looked_up), i)), lambda i: i.isNotNull()).alias("_at"))
    found = {p: _places(words, at, p.split()) for p in PHRASES}
    shares = [_share(words, at, notice, key, marks, weights) for _, notice, key, marks in plans]
    out = out.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.array(*found.values()).alias("_found"),
                     F.when(F.size(at) > 0, F.array(*shares)).otherwise(F.array(*[F.lit(0.0)] * len(plans))).alias("_shares"))
    places = F.flatten("_found")
    base = [F.when(F.size(F.col("_found")[i]) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]
    more = [F.when(F.col("_shares")[i] > 0, F.lit(label)) for i, (label, *_) in enumerate(plans)]

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull()))), ",")

    return out.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), joined(base).alias("base_labels"), joined(base + more).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.round(F.array_max("_shares"), 6)).alias("score"))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    templates = ", ".join(f"({t}, '{label}', {k}, '{w}', {_find(notice.split(), key.split()) <= k < _find(notice.split(), key.split()) + len(key.split())})"
                          for t, (label, notice, key) in enumerate(TEMPLATES) for k, w in enumerate(notice.split()))
    phrases = ", ".join(f"({p}, '{label}', {k}, '{w}')" for p, (phrase, label) in enumerate(PHRASES.items()) for k, w in enumerate(phrase.split()))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
     templates(t, label, k, w, is_key) AS (VALUES {templates}),
     phrases(p, label, k, w) AS (VALUES {phrases}),
     words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
     df AS (SELECT w, count(DISTINCT doc_id) AS n FROM words GROUP BY w),
     weights AS (SELECT t.w, floor(1000 * ln(1 + ((SELECT count(*) FROM d) + 1) / (coalesce(any_value(df.n), 0) + 1)) + 0.5) AS weight
                 FROM templates t LEFT JOIN df ON df.w = t.w GROUP BY t.w),
     total AS (SELECT t, sum(weight) AS total, count(*) FILTER (is_key) AS keys FROM templates JOIN weights USING (w) GROUP BY t),
     aligned AS (SELECT doc_id, t, label, i - k AS s, sum(weight) AS got, count(*) FILTER (is_key) AS keys
                 FROM words JOIN templates USING (w) JOIN weights USING (w) GROUP BY ALL),
     more AS (SELECT doc_id, label, got / total AS share FROM aligned JOIN total USING (t, keys) WHERE got * 100 >= {SHARE} * total),
     base AS (SELECT doc_id, label, i - k AS s FROM words JOIN phrases p USING (w) GROUP BY doc_id, label, p, i - k
              HAVING count(*) = (SELECT count(*) FROM phrases q WHERE q.p = p.p)),
     b AS (SELECT doc_id, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
     a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM more) GROUP BY doc_id),
     m AS (SELECT doc_id, max(share) AS share FROM more GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE round(coalesce(m.share, 0), 6) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN m USING (doc_id)"""


ORACLE = _oracle()
