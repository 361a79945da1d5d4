"""A hidden Markov language model of words, trained by Baum-Welch over all learning documents.

A document is a chain of its lower-cased words and one end. Each token is drawn from a latent state, each state from the
one before. A state's words come from its own table, or with probability ``mix`` from the table of the whole corpus. Every
learnt word has an emission of its own, and the unknown word has one. A setting may have words rarer than one in ``share`` learnt tokens, or
learnt fewer than ``fewest`` times, join the unknown one in a class with one emission; within it they are drawn
by their counts plus 0.1. So every state spreads probability 1 over the known words and one unknown word.

Words are 64-bit hashes. Runs of documents (``llm.exchange``) hold their words as numbers and ask the corpus-wide table
for the rows of their own distinct words. In each round they send back expected counts of their words, states and
transitions, which are added up by key: the model's tables grow with the corpus and never meet the driver, which
sees only numbers of states. Start values are the corpus' counts, scattered by hash, and states that tend to stay.

Forward and backward run over many sequences side by side, longest first, scaled at every token. A long text is cut in
segments; their transfer matrices give each segment the exact state distribution it starts from and the exact message
from what follows, so cutting changes no likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import exchange as ex
from llm.common import let_go, release, rows, settle, table
from llm.words import Texts, mix, slices

#: Tokens of sequences that run side by side.
SIDE_BY_SIDE = 1 << 19
#: Key of the end; keys below RESERVED carry sums of the model itself.
END = np.uint64(0xE4D)
RESERVED = 64
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Setting(NamedTuple):
    """Parameters: latent states; rounds of Baum-Welch; words rarer than one in ``share`` learnt tokens, or learnt fewer than
    ``fewest`` times, share one emission with the unknown word, by default none; ``mix`` is the share of an emission that
    is the whole corpus' distribution; ``stay`` the probability of staying in a state before the first round; texts are
    cut in segments of ``segment`` tokens and runs of ``run_bytes``, which change no result but speed.
    """

    states: int = 6
    rounds: int = 3
    share: int = 1 << 62
    fewest: int = 1
    mix: float = 0.05
    stay: float = 0.9
    segment: int = 1024
    run_bytes: int = 32 << 20


class Counts(NamedTuple):
    """Learnt tokens and distinct words, the count from which words have an emission of their own, and the tokens and words below it."""

    tokens: int
    words: int
    least: int
    rare_tokens: int
    rare_words: int

    @property
    def rare_mass(self) -> float:
        """Counts of the rare class: its tokens and 0.1 for each of its words and the unknown one."""
        return self.rare_tokens + 0.1 * (self.rare_words + 1)

    @property
    def mass(self) -> float:
        return self.tokens - self.rare_tokens + self.rare_mass

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.words + 1)))

    def within_rare(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / self.rare_mass)


class Model(NamedTuple):
    """What every run needs of a model besides the rows of its own words."""

    start: np.ndarray
    moves: np.ndarray
    totals: np.ndarray
    rare: np.ndarray


def scattered(keys: np.ndarray, states: int) -> np.ndarray:
    """Factors around 1 that depend on a word's hash alone, one per state."""
    steps = np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return 0.5 + (mix(keys[:, None] ^ steps[None, :]) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def emissions(model: Model, counts: Counts, own: np.ndarray, c: np.ndarray, mix: float) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of words and, as the last row, of the rare class; and the share of each that is the state's own."""
    own = np.append(own, model.rare[None, :], 0)
    whole = (np.append(c, counts.rare_mass) / counts.mass)[:, None]
    mine = np.where(model.totals > 0, (1 - mix) * own / np.maximum(model.totals, 1e-300), (1 - mix) * whole)
    p = mine + mix * whole
    return p, mine / p


class SideBySide:
    """Sequences of codes, longest first, laid out step by step."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.steps = int(size[0]) if len(size) else 0
        active = len(size) - np.searchsorted(size[::-1], np.arange(self.steps), "right")
        self.ptr = np.append(0, np.cumsum(active))
        step = np.repeat(np.arange(self.steps), active)
        self.row = np.arange(len(step)) - np.repeat(self.ptr[:-1], active)
        self.codes = codes[start[self.order][self.row] + step]
        self.last = self.ptr[size - 1] + np.arange(len(size))

    def forward(self, p: np.ndarray, moves: np.ndarray, prior: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Last state distribution and log10 likelihood of every sequence; with keep, also all distributions and scales.

        Inside, states are rows and sequences columns.
        """
        n, k = len(self.order), p.shape[1]
        drawn = np.ascontiguousarray(p.T)[:, self.codes]
        alphas = drawn if keep else None
        scales, end, now, back = np.empty(len(self.codes)), np.empty((k, n)), prior[self.order].T, moves.T
        for t in range(self.steps):
            lo, hi = self.ptr[t], self.ptr[t + 1]
            a = now * drawn[:, lo:hi]
            scales[lo:hi] = scale = a.sum(0)
            a /= scale
            if keep:
                alphas[:, lo:hi] = a
            stay = self.ptr[t + 2] - hi if t + 1 < self.steps else 0
            if stay < hi - lo:
                end[:, stay:hi - lo] = a[:, stay:]
            now = back @ a[:, :stay]
        logs = np.bincount(self.row, np.log10(scales), n)
        placed = np.empty(n, np.int64)
        placed[self.order] = np.arange(n)
        return end.T[placed], logs[placed], alphas, scales

    def expected(self, p: np.ndarray, moves: np.ndarray, prior: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected visits by code and state, expected transitions, the distributions at the ends, and the messages to the starts.

        ``tail`` is the message from what follows a sequence, of any scale.
        """
        end, _, alphas, scales = self.forward(p, moves, prior, True)
        follows = np.ascontiguousarray((tail / (end * tail).sum(1, keepdims=True))[self.order].T)
        drawn = np.ascontiguousarray(p.T)[:, self.codes]
        drawn /= scales
        crossed = np.zeros_like(moves)
        for t in range(self.steps - 1, -1, -1):
            lo, hi = self.ptr[t], self.ptr[t + 1]
            n = hi - lo
            message = drawn[:, lo:hi] * follows[:, :n]
            alphas[:, lo:hi] *= follows[:, :n]
            if t:
                # distributions of the step before are yet untouched
                before = self.ptr[t - 1]
                crossed += alphas[:, before:before + n] @ message.T
                follows[:, :n] = moves @ message
        visits = np.stack([np.bincount(self.codes, alphas[z], len(p)) for z in range(p.shape[1])], 1)
        first = np.empty_like(tail)
        first[self.order] = message.T
        return visits, crossed * moves, end, first


class Chains:
    """Texts of codes cut in segments, with what each segment starts from and what follows it."""

    def __init__(self, codes: np.ndarray, size: np.ndarray, segment: int):
        first = np.append(0, np.cumsum(size)[:-1]) if len(size) else np.zeros(0, np.int64)
        parts = -(-size // segment)
        self.codes = codes
        self.text = np.repeat(np.arange(len(size)), parts)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = first[self.text] + self.number * segment
        self.size = np.minimum(size[self.text] - self.number * segment, segment)
        self.parts, self.n = parts, len(size)

    def _groups(self, which: np.ndarray, room: int) -> Iterator[np.ndarray]:
        which = which[np.argsort(-self.size[which], kind="stable")]
        part = np.cumsum(self.size[which]) // room
        yield from np.split(which, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(which) else []

    def transfers(self, p: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of segments of cut texts: the likelihood of every end state by start state, up to a factor, kept in (0, 1]."""
        k, which = len(moves), np.flatnonzero(self.parts[self.text] > 1)
        out = np.empty((len(which), k, k))
        place = np.empty(len(self.text), np.int64)
        place[which] = np.arange(len(which))
        for group in self._groups(which, SIDE_BY_SIDE // k):
            side = SideBySide(self.codes, np.repeat(self.start[group], k), np.repeat(self.size[group], k))
            end, logs, _, _ = side.forward(p, moves, np.tile(np.eye(k), (len(group), 1)), False)
            logs = logs.reshape(-1, k, 1)
            out[place[group]] = end.reshape(-1, k, k) * 10 ** (logs - logs.max(1, keepdims=True))
        return out, place

    def messages(self, p: np.ndarray, start: np.ndarray, moves: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """What each segment starts from; with back, also the message from what follows it."""
        k = len(start)
        prior, tail = np.tile(start, (len(self.text), 1)), np.ones((len(self.text), k))
        transfer, place = self.transfers(p, moves)
        for number in range(1, int(self.parts.max(initial=1))):
            at = np.flatnonzero(self.number == number)
            end = np.einsum("ni,nij->nj", prior[at - 1], transfer[place[at - 1]])
            prior[at] = end / end.sum(1, keepdims=True) @ moves
        if back:
            for number in range(int(self.parts.max(initial=1)) - 1, 0, -1):
                at = np.flatnonzero(self.number == number)
                got = np.einsum("nij,nj->ni", transfer[place[at]], tail[at]) @ moves.T
                tail[at - 1] = got / got.sum(1, keepdims=True)
        return prior, tail

    def likelihoods(self, p: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """log10 probability of every text."""
        prior, _ = self.messages(p, start, moves, False)
        out = np.zeros(len(self.text))
        for group in self._groups(np.arange(len(self.text)), SIDE_BY_SIDE):
            out[group] = SideBySide(self.codes, self.start[group], self.size[group]).forward(p, moves, prior[group], False)[1]
        return np.bincount(self.text, out, self.n)

    def expected(self, p: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected visits by code and state, transitions and start states of all texts."""
        prior, tail = self.messages(p, start, moves, True)
        visits, crossed = np.zeros_like(p), np.zeros_like(moves)
        ends, firsts = np.empty_like(prior), np.empty_like(prior)
        for group in self._groups(np.arange(len(self.text)), SIDE_BY_SIDE):
            side = SideBySide(self.codes, self.start[group], self.size[group])
            v, c, ends[group], firsts[group] = side.expected(p, moves, prior[group], tail[group])
            visits += v
            crossed += c
        later = np.flatnonzero(self.number > 0)
        crossed += (ends[later - 1].T @ firsts[later]) * moves
        return visits, crossed, (prior * firsts)[self.number == 0].sum(0)


def _settled_runs(docs: DataFrame, run_bytes: int) -> DataFrame:
    """Runs of documents as numbers of words; the header holds the words' hashes and learnt counts."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learnt = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = ex.run_numbers()
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            keys = np.unique(np.concatenate([k for _, _, _, k, _ in held]))
            sums, seen = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for _, learn, n, own, codes in held:
                at = np.searchsorted(keys, own)
                sums[at] += np.bincount(codes, np.repeat(learn, n), len(own)).astype(np.int64)
                seen[at] += np.bincount(codes, minlength=len(own))
            # Common words get the small numbers.
            order = np.argsort(-seen, kind="stable")
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            packed = [ex.pack(doc_id=ids, learnt=learn, n=n, codes=planes(place[np.searchsorted(keys, own)][codes])) for ids, learn, n, own, codes in held]
            return ex.run_rows(next(numbers), ex.pack(keys=keys[order], sums=sums[order]), packed)

        for batch in batches:
            ids, learn = batch.column(0), np.asarray(batch.column(2).to_pylist(), bool)
            for i, data, offsets in slices(batch.column(1)):
                words = Texts(data, offsets, lower=True)
                j = i + len(words.n)
                keys, codes = np.unique(np.insert(words.hashes(), words.first[1:], END), return_inverse=True)
                held.append((ids.slice(i, j - i), learn[i:j], words.n + 1, keys, codes.astype(np.int32)))
                size += len(data)
                if size >= run_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return settle(own.select("doc_id", "text", learnt.alias("learnt")).mapInArrow(number, ex.RUNS))


def _first_sums(table_: DataFrame, setting: Setting) -> tuple[Counts, np.ndarray]:
    """Counts of the whole corpus, and the totals of the scattered start values."""
    states = setting.states

    def add(measure, names: list[str]) -> list[float]:
        """Sums over the table's rows, added up in tasks."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(names))
            for batch in batches:
                for keys, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total += measure(np.frombuffer(keys, np.uint64), np.frombuffer(c, "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

        got = table_.select("keys", "sums").mapInArrow(sums, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        return [got[n] or 0.0 for n in names]

    tokens, words = add(lambda keys, c: [c.sum(), (c > 0).sum()], ["t", "w"])
    least = max(setting.fewest, -(-int(tokens) // setting.share))

    def measure(keys: np.ndarray, c: np.ndarray) -> np.ndarray:
        rare = (c > 0) & (c < least)
        return np.append(c[c >= least] @ scattered(keys[c >= least], states), [c[rare].sum(), rare.sum()])

    *own, rare_tokens, rare_words = add(measure, [f"s{z}" for z in range(states)] + ["rt", "rw"])
    return Counts(int(tokens), int(words), least, int(rare_tokens), int(rare_words)), np.array(own)


def planes(codes: np.ndarray) -> np.ndarray:
    """Whole numbers as all their low bytes, then all the next ones: small numbers compress well so."""
    return np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).ravel()


def codes_of(flat: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<i4").ravel()


def _recoded(runs: DataFrame, answers: DataFrame, bits: int, counts: Counts) -> DataFrame:
    """Settled runs whose codes number the run's frequent words, with what does not depend on the states worked out."""

    def recode(run: int, header: dict, packed: list[bytes], got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        c = ex.assembled(header["keys"], got, bits, "<i8")[:, 0]
        frequent = c >= counts.least
        # Common words get the small numbers.
        order = np.flatnonzero(frequent)
        order = order[np.argsort(-c[order], kind="stable")]
        code = np.full(len(c), len(order), np.int32)
        code[order] = np.arange(len(order))
        base, within, out = counts.base(c), np.where(frequent, 0, counts.within_rare(c)), []
        for payload in packed:
            x = ex.unpack(payload)
            text = np.repeat(np.arange(len(x["n"])), x["n"])
            old = codes_of(x["codes"])
            sums = [np.bincount(text, w[old], len(x["n"])) for w in (base, within, c > 0)]
            out.append(ex.pack(doc_id=x["doc_id"], learnt=x["learnt"], n=x["n"], codes=planes(code[old]), base=sums[0], within=sums[1], known=sums[2].astype(np.int64)))
        yield ex.run_rows(run, ex.pack(keys=header["keys"][order], c=c[order]), out)

    return settle(ex.by_run(runs, answers, recode, ex.RUNS))


def _own(header: dict, model: Model, answers: dict[int, bytes], bits: int, first: bool) -> np.ndarray:
    """The model's rows of a run's words."""
    if first:
        return header["c"][:, None] * scattered(header["keys"], len(model.start))
    return ex.assembled(header["keys"], answers, bits, "<f4", len(model.start)).astype(np.float64)


def _round(runs: DataFrame, answers: DataFrame | None, model: Model, counts: Counts, bits: int, setting: Setting) -> DataFrame:
    """Expected counts of one round of Baum-Welch, added up by key in a settled table.

    Row 0 of the reserved keys holds start states, row 1 the rare class, row 2 + z the transitions out of state z.
    """
    k, first_round = len(model.start), answers is None

    def expect(run: int, header: dict, packed: list[bytes], got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        p, share = emissions(model, counts, _own(header, model, got, bits, first_round), header["c"], setting.mix)
        codes, sizes = [], []
        for payload in packed:
            x = ex.unpack(payload)
            learnt = x["learnt"].astype(bool)
            codes.append(codes_of(x["codes"])[np.repeat(learnt, x["n"])])
            sizes.append(x["n"][learnt])
        visits, crossed, first = Chains(np.concatenate(codes), np.concatenate(sizes), setting.segment).expected(p, model.start, model.moves)
        visits *= share
        keys = np.append(header["keys"], np.arange(k + 2, dtype=np.uint64))
        sums = np.concatenate([visits[:-1], first[None, :], visits[-1:], crossed]).astype("<f4")
        seen = sums.any(1)
        if seen.any():
            yield ex.sent_rows(run, keys[seen], sums[seen], bits)

    return settle(ex.sum_by_key(ex.by_run(runs, answers, expect, ex.SENT), "<f4", k))


def _model(table_: DataFrame, states: int) -> Model:
    """The parts of a round's table that every run needs; a number of rows that depends on the states alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((states + 3, states))
        for batch in batches:
            for keys, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, sums = np.frombuffer(keys, np.uint64), np.frombuffer(sums, "<f4").reshape(-1, states).astype(np.float64)
                own = keys < RESERVED
                out[-1] += sums[~own].sum(0)
                out[keys[own].astype(np.int64)] += sums[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(states + 3), states)), pa.array(np.tile(np.arange(states), states + 3)), pa.array(out.ravel())], ["i", "z", "v"])

    got = np.zeros((states + 3, states))
    for r in table_.select("keys", "sums").mapInArrow(read, "i long, z long, v double").groupBy("i", "z").agg(F.sum("v").alias("v")).collect():
        got[r["i"], r["z"]] = r["v"]
    start, rare, moves, totals = got[0], got[1], got[2:2 + states], got[-1]

    def smooth(x: np.ndarray) -> np.ndarray:
        return (x + 1 / states) / (x.sum(-1, keepdims=True) + 1)

    return Model(smooth(start), smooth(moves), totals + rare, rare)


def score_documents(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """log10 probability of every document under a model learnt from those that are not held out.

    Columns: doc_id, held_out (crc32 of the id's text modulo 10 is 0), n_tokens (words and the end), n_known (tokens that
    learning saw), train_tokens (all learnt tokens), base_score (smoothed single words), score (the hidden Markov model).
    ``docs`` needs doc_id and text; other columns are ignored. A null text is empty and holds the end alone. Repeated
    rows stay and are learnt as often as they occur. Rows without doc_id are scored, held out and not learnt from. If
    nothing is learnt, every token has probability 1. An empty table gives an empty result.
    """
    states = setting.states
    if not 1 <= states <= RESERVED - 2:
        raise ValueError("states out of range")
    read = _settled_runs(docs, setting.run_bytes)
    bits = ex.shard_bits(read)
    counted = settle(ex.sum_by_key(ex.spread(read, bits, sums="sums"), "<i8"))
    counts, totals = _first_sums(counted, setting)
    runs = _recoded(read, ex.look_up(ex.spread(read, bits), counted, "<i8"), bits, counts)
    release(read)
    release(counted)
    away = (1 - setting.stay) / max(1, states - 1)
    moves = np.full((states, states), away) + np.eye(states) * (setting.stay - away) if states > 1 else np.ones((1, 1))
    rare = np.full(states, counts.rare_mass)
    model, answers, kept = Model(np.full(states, 1 / states), moves, totals + rare, rare), None, None
    for _ in range(setting.rounds):
        learnt = _round(runs, answers, model, counts, bits, setting)
        if kept is not None:
            release(kept)
        model, kept = _model(learnt, states), learnt
        let_go(docs.sparkSession)
        answers = ex.look_up(ex.spread(runs, bits), learnt, "<f4", states)

    def score(run: int, header: dict, packed: list[bytes], got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        p, _ = emissions(model, counts, _own(header, model, got, bits, setting.rounds == 0), header["c"], setting.mix)
        parts = [ex.unpack(payload) for payload in packed]
        logs = Chains(np.concatenate([codes_of(x["codes"]) for x in parts]), np.concatenate([x["n"] for x in parts]), setting.segment).likelihoods(p, model.start, model.moves)
        for x, own in zip(parts, np.split(logs, np.cumsum([len(x["n"]) for x in parts])[:-1])):
            yield rows(_RESULT, doc_id=x["doc_id"], held_out=~x["learnt"].astype(bool), n_tokens=x["n"], n_known=x["known"],
                       train_tokens=np.full(len(own), counts.tokens), base_score=x["base"], score=own + x["within"])

    return ex.by_run(runs, answers, score, RESULT)


def op12_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
