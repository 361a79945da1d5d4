"""Toxicity: a bag of subwords, averaged embeddings and a linear softmax, trained jointly in numpy.

Words are runs of letters and digits, lower case, framed by a mark; their character n-grams are hashed to
embeddings. A window of a few words is the mean of its n-grams' embeddings; a linear softmax of two classes
scores it. A document is as toxic as its worst window, so one insult counts the same in a short and in a long
text. As a mean of embeddings times a weight vector is a mean of numbers, scoring needs one number per bucket.

Training sees documents only: in toxic ones the windows that score highest stand for the label (first by
log-odds of their n-grams, then by the model itself), in clean ones every window counts as clean.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import rows, table, trim

BUCKETS_LOG2 = 18
SIZES = (3, 4, 5, 6)
WINDOW = 2
DIMENSIONS = 8
#: Labelled documents of each class that training reads at most, in the order of a hash of doc_id.
SAMPLE_PER_CLASS = 3000
#: Steps of a training round at least.
STEPS = 40
#: Characters scored at once.
SLICE_CHARS = 1 << 20
THRESHOLD = 0.3
_MULTIPLIER = np.uint32(0x9E3779B1)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it belongs to words, and its lower form."""
    word = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x30000):
        c = chr(i)
        word[i] = unicodedata.category(c)[0] in "LNM"
        low = c.lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return word, lower


class Bags:
    """n-grams of the words of some texts: ``bucket`` and ``at`` (character) of each, words with their text."""

    def __init__(self, texts: list[str]):
        word, lower = _characters()
        joined = "\n" + "\n".join(texts) + "\n\n\n\n\n\n"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        inside = word[points]
        self.text_end = np.cumsum([len(t) + 1 for t in texts])
        values = np.where(inside, lower[points] * np.uint32(2) + np.uint32(1), np.uint32(0)) * np.uint32(0x85EBCA77)
        values ^= values >> np.uint32(13)
        stops = np.flatnonzero(~inside)
        following = np.repeat(stops, np.diff(np.append(-1, stops)))
        n = len(points) - max(SIZES)
        self.reach = following[1:n + 1] - np.arange(n) + 1
        self.values, self.n = values, n
        edge = np.diff(np.append(False, inside).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.text_end, self.start, "right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(characters at which n-grams of one size start, their buckets), size by size."""
        h = self.values[:self.n].copy()
        power = np.uint32(1)
        for size in range(2, max(SIZES) + 1):
            power = np.uint32(int(power) * 0x01000193 & 0xFFFFFFFF)
            h += self.values[size - 1:self.n + size - 1] * power
            if size in SIZES:
                at = np.flatnonzero(self.reach >= size)
                g = h[at] * _MULTIPLIER
                yield at, ((g ^ (g >> np.uint32(15))) * np.uint32(0x846CA68B)) >> np.uint32(32 - BUCKETS_LOG2)

    def word_scores(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weights and number of the n-grams of every word."""
        total, count = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for at, g in self.grams():
            total[at + 1] += weights[g]
            count[at + 1] += 1
        np.cumsum(total, out=total)
        np.cumsum(count, out=count)
        return total[self.end] - total[self.start - 1], count[self.end] - count[self.start - 1]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of every window; a text of fewer words is one window, one without words has none."""
        last = self.first[1:][self.text]
        begin = self.first[:-1][self.text]
        i = np.arange(len(self.start))
        own = (i + WINDOW <= last) | (i == begin)
        return i[own], np.minimum(i[own] + WINDOW, last[own])

    def window_scores(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, end word, text and mean weight of every window."""
        total, count = (np.append(0, np.cumsum(x)) for x in self.word_scores(weights))
        a, b = self.windows()
        return a, b, self.text[a], (total[b] - total[a]) / np.maximum(count[b] - count[a], 1)


@dataclass
class Model:
    """One number per bucket (embedding times softmax weights), bias, and the scale from worst window to probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def worst(self, texts: list[str]) -> np.ndarray:
        """Logit of the worst window of every text; of a text without words, that of an empty bag."""
        out = np.full(len(texts), self.bias)
        i = 0
        sizes = np.cumsum([len(t) for t in texts])
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE_CHARS, "right")))
            _, _, text, score = Bags(texts[i:j]).window_scores(self.weights)
            best = np.full(j - i, -np.inf)
            np.maximum.at(best, text, score)
            out[i:j] = np.where(np.isfinite(best), best, 0) + self.bias
            i = j
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.shift, -30, 30)))


def _flat(bags: Bags, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some windows, window after window, and their numbers."""
    at, g = (np.concatenate(x) for x in zip(*bags.grams()))
    order = np.argsort(at, kind="stable")
    at, g = at[order], g[order]
    lo = np.searchsorted(at, bags.start[first] - 1)
    hi = np.searchsorted(at, bags.end[end - 1])
    n = hi - lo
    return g[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())], n


def train(texts: list[str], toxic: np.ndarray, rounds: int = 4, epochs: int = 10, seed: int = 7) -> Model:
    """Fit embeddings and softmax weights jointly (Adam), then the scale of document scores.

    Without toxic examples every text scores 0, as nothing is known against it; without clean ones every text has the
    share of toxic examples, smoothed.
    """
    toxic = np.asarray(toxic, bool)
    size = 1 << BUCKETS_LOG2
    if not toxic.any():
        return Model(np.zeros(size, np.float32), 0.0, 1.0, -30.0)
    if toxic.all():
        p = (toxic.sum() + 1) / (len(toxic) + 2)
        return Model(np.zeros(size, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, size))
    for i in range(len(texts)):
        for _, g in Bags([texts[i]]).grams():
            seen[int(toxic[i])][np.unique(g)] += 1
    weights = np.log((seen[1] + .5) / (toxic.sum() + 1)) - np.log((seen[0] + .5) / ((~toxic).sum() + 1))
    weights[seen.sum(0) < 3] = 0
    clean, bad = [t for t, x in zip(texts, toxic) if not x], [t for t, x in zip(texts, toxic) if x]
    embedding = rng.normal(0, .05, (size, DIMENSIONS)).astype(np.float32)
    out = np.ones(DIMENSIONS, np.float32)
    bias = np.float32(0)
    moments = [np.zeros_like(embedding), np.zeros_like(embedding), np.zeros_like(out), np.zeros_like(out), 0.0, 0.0]
    steps = 0
    for turn in range(rounds):
        picked = []
        for part, want in ((bad, 1), (clean, 0)):
            for i in range(0, len(part), 64):
                bags = Bags(part[i:i + 64])
                a, b, text, score = bags.window_scores(weights)
                if want:  # the best windows of each text, at least a third of the text's best
                    best = np.full(64, -np.inf)
                    np.maximum.at(best, text, score)
                    keep = score >= np.where(best[text] > 0, best[text] * .8, best[text])
                else:  # every clean window may be drawn; those that score high always are
                    keep = (rng.random(len(a)) < .25) | (score > np.quantile(score, .9) if len(score) else False)
                g, n = _flat(bags, a[keep], b[keep])
                picked.append((g, n, np.full(len(n), want, np.float32)))
        share = sum(x[2].sum() for x in picked) / max(1, sum(len(x[2]) for x in picked))
        batches = max(1, len(picked) // 8)
        for _ in range(max(epochs, -(-STEPS // batches))):
            order = rng.permutation(len(picked))
            for group in np.array_split(order, batches):
                g = np.concatenate([picked[k][0] for k in group])
                n = np.concatenate([picked[k][1] for k in group])
                y = np.concatenate([picked[k][2] for k in group])
                g, y, n = (g, y[n > 0], n[n > 0])
                if not len(n):
                    continue
                ends = np.append(0, np.cumsum(n)[:-1])
                mean = np.add.reduceat((embedding @ out)[g], ends) / n
                p = 1 / (1 + np.exp(-np.clip(mean + bias, -30, 30)))
                error = ((p - y) * np.where(y > 0, .5 / max(share, 1e-6), .5 / max(1 - share, 1e-6)) / len(y)).astype(np.float32)
                pull = np.bincount(g, np.repeat(error / n, n), size).astype(np.float32)
                grads = [pull[:, None] * out + 1e-7 * embedding, embedding.T @ pull, np.float32(error.sum())]
                steps += 1
                for k, (grad, rate) in enumerate(zip(grads, (.05, .02, .02))):
                    moments[2 * k] = .9 * moments[2 * k] + .1 * grad
                    moments[2 * k + 1] = .99 * moments[2 * k + 1] + .01 * grad ** 2
                    step = rate * (moments[2 * k] / (1 - .9 ** steps)) / (np.sqrt(moments[2 * k + 1] / (1 - .99 ** steps)) + 1e-8)
                    if k == 0:
                        embedding -= step
                    elif k == 1:
                        out -= step
                    else:
                        bias = np.float32(bias - step)
        weights = (embedding @ out).astype(np.float64)
    model = Model(weights.astype(np.float32), float(bias), 1.0, 0.0)
    x, y = model.worst(texts), toxic.astype(float)
    goal = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    centre, spread = x.mean(), x.std() + 1e-9
    z, coef = (x - centre) / spread, np.zeros(2)
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        coef -= np.clip(np.linalg.solve(hessian, design.T @ (p - goal) + 1e-3 * coef), -2, 2)
    slope = max(float(coef[0]) / spread, 1e-6)
    model.slope, model.shift = slope, float(coef[1]) - slope * centre
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Train on at most sample_per_class labelled documents of each class. Null texts or labels take no part.

    Of several texts of a doc_id the least in byte order counts, so that the sample is bounded by its ids.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for c in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    sample = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toPandas().sort_values(["doc_id", "text"])
    model = train(sample["text"].tolist(), sample["toxic"].to_numpy() > 0)
    del sample
    trim()
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row, from the text alone. Null texts score as empty ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.scores([t or "" for t in batch.column(1).to_pylist()])
            yield rows(schema, doc_id=batch.column(0), score=got, predicted=(got >= threshold).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, predicted int")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit_in(docs: DataFrame, spark, sf_dir: str) -> Model:
    """The model of the query and of the pipeline: labels of rows that are not held out."""
    return fit(docs, table(spark, sf_dir, "labels").where(~held_out()))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose text scores below the threshold. Null texts are kept."""
    fields = docs.schema
    arrow_text = fields.fieldNames().index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(arrow_text)
            got = model.scores([t or "" for t in texts.to_pylist()])
            yield batch.filter(pa.array((got < threshold) | np.asarray(texts.is_null())))

    return docs.mapInArrow(keep, fields)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit_in(docs, spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
