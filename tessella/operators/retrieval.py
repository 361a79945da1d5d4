"""Recall over tables of queries: lexical, trigram, substring, dense, entity and graph routes.

Every function takes a table of queries and returns candidate rows keyed by ``query_id``. Ranking
always rounds the score and ends with the unit id, so results do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions import text as tx
from tessella.session import at_most, cut_lineage, rows_of

# Words never used as search terms.
STOPWORDS_ZH = (
    "的 了 在 是 和 与 及 或 也 都 这 那 有 没 不 会 能 要 可以 什么 怎么 如何 哪些 为什么 吗 呢 啊 "
    "个 一 到 把 被 让 给 从 对 等 请问 帮我 告诉 知道 想 应该 需要"
).split()
STOPWORDS_EN = (
    "a an the is are was were be been do does did has have had and or but not no in on at to of "
    "for with from by as what which how why when where who"
).split()
# Weights of the fields of the search vector.
FIELD_WEIGHTS = {"title": 1.0, "search_text": 0.4, "text": 0.2}
# Facet keys a unit can carry.
FACET_KEYS = ("block_type", "section_depth", "semantic_role")
# Order in which relation types claim the expansion budget.
RELATION_PRIORITY = {
    "entity_relation": 0, "elaborates": 1, "conditions": 2, "backgrounds": 3, "enables": 4,
    "results_in": 5, "sequences": 6, "contrasts_with": 7, "causes": 8, "parallels": 9,
    "evidences": 2, "exemplifies": 3, "purposes": 5, "justifies": 5, "summarizes": 6, "concedes": 7,
    "section_header_of": 10, "same_section": 11, "previous": 12, "next": 13, "same_parent_section": 14,
}
LOWEST_PRIORITY = 2147483647
EXACT_SCORE = 0.95
GRAPH_BASE = 0.85
CARD_BOOST = 1.1
EXPANSION_BUDGET = 20
K1, B = 1.2, 0.75
#: A node of more edges is a hub: its edges lie in chunks of about so many.
HUB_EDGES = 50_000
#: A scope: takes candidates (query_id, unit_id, ...) and returns those inside it.
Keep = Callable[[DataFrame], DataFrame]
#: Up to so many queries are met by every unit in its row; more are joined.
QUERIES_IN_ROWS = 4096
#: Tables of at most so many units have their distinct words looked through once; in larger ones each task does so.
FEW_UNITS = 20_000
#: Words whose parts a task remembers.
WORDS_KEPT = 1 << 18
#: Widths of needles' openings, and numbers that spread their hashes.
OPENINGS = (16, 12, 8, 6, 4, 3, 2, 1)
HASH_BASE, HASH_MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
OUTSIDE = -2.0  # below any cosine: marks a vector of another group


def top_k(df: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "unit_id") -> DataFrame:
    """Best k rows per query with their rank; Spark cuts to k per partition before the shuffle."""
    w = W.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- lexical -----------------------------------------------------------------------------------


def search_tokens(text: Column) -> Column:
    """Tokens of length two or more (or one CJK character) without stopwords; all tokens if none is left."""
    raw = tx.tokens(text)
    stop = F.array(*[F.lit(w) for w in STOPWORDS_ZH + STOPWORDS_EN])
    kept = F.filter(raw, lambda t: ((F.length(t) >= 2) | t.rlike(tx.CJK)) & ~F.array_contains(stop, t))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct search terms per query, from keywords and sub-queries, else from the raw query."""
    cols = queries.columns
    parts = [F.array_join(c, " ") for c in ("keywords", "sub_queries") if c in cols]
    text = F.col("query")
    if parts:
        joined = F.concat_ws(" ", *parts)
        text = F.when(tx.is_blank(joined), text).otherwise(joined)
    return queries.select("query_id", F.explode(F.array_distinct(search_tokens(text))).alias("term"))


def postings(units: DataFrame) -> DataFrame:
    """Search vector of each unit: (unit_id, field, term, tf), map-side combined."""
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), tx.tokens(F.coalesce(F.col(f), F.lit(""))).alias("terms"))
        for f in FIELD_WEIGHTS
    ])
    return (
        units.select("unit_id", F.explode(fields).alias("x"))
        .select("unit_id", "x.field", F.explode("x.terms").alias("term"))
        .groupBy("unit_id", "field", "term").agg(F.count("*").alias("tf"))
    )


def bm25(terms: DataFrame, units: DataFrame, round_to: int = 6, max_shared: int = 1_000_000) -> DataFrame:
    """Field-weighted BM25 of every unit that shares a term with a query.

    Units are placed by ``unit_id`` once, as text. Up to ``max_shared`` query terms are shared with every
    task, so a unit's postings are matched, weighted and summed where the unit lies: no posting and no
    partial score is shuffled. More terms than that are joined by shuffle. Document frequencies count
    the distinct terms of each unit in a pass of their own; corpus size and mean length enter as one
    scalar subquery.
    """
    share = F.broadcast if at_most(terms, max_shared) else (lambda df: df)
    toks = {f: tx.tokens(F.coalesce(F.col(f), F.lit(""))) for f in FIELD_WEIGHTS}

    def weigh(field: str) -> Column:
        return F.transform(toks[field], lambda t: F.struct(t.alias("term"), F.lit(FIELD_WEIGHTS[field]).alias("w")))

    wanted = share(terms.select("term").distinct())
    corpus = units.select(sum((F.size(t) for t in toks.values()), F.lit(0)).alias("dl")).agg(
        F.struct(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).alias("s")).scalar()
    df = (
        units.select(F.explode(F.array_distinct(F.concat(*toks.values()))).alias("term"))
        .join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    )
    idf = F.log(1 + (corpus["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = share(terms.join(df, "term").select("query_id", "term", idf.alias("idf")))
    hits = (
        units.select("unit_id", *FIELD_WEIGHTS).repartition("unit_id")
        .select("unit_id", F.concat(*[weigh(f) for f in FIELD_WEIGHTS]).alias("v"))
        .select("unit_id", F.size("v").alias("dl"), F.explode("v").alias("p")).select("unit_id", "dl", "p.term", "p.w")
        .join(wanted, "term", "left_semi")
        .groupBy("unit_id", "term").agg(F.sum("w").alias("wtf"), F.max("dl").alias("dl"))
    )
    saturation = F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("dl") / corpus["avgdl"]))
    return (
        hits.select("unit_id", "term", saturation.alias("sat")).join(weights, "term")
        .groupBy("query_id", "unit_id").agg(F.round(F.sum(F.col("idf") * F.col("sat")), round_to).alias("score"))
    )


class Within:
    """A scope of whole units, the same for every query; a search holds it on the units before they are scored."""

    def __init__(self, units: DataFrame):
        self.units = units

    def __call__(self, found: DataFrame) -> DataFrame:
        return found.join(self.units, "unit_id", "left_semi")


def best_places(query: np.ndarray, score: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best rows, equal scores by unit; only rows that reach the k-th score are sorted by unit."""
    order = np.lexsort((-score, query))
    q, s = query[order], score[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.array([], int)
    size = np.diff(np.append(start, len(q)))
    last = np.repeat(s[start + np.minimum(size, k) - 1], size)
    order = order[s >= last]
    order = order[np.lexsort((unit[order], -score[order], query[order]))]
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else start
    return order[np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k]


def word_trigrams(word: str) -> list[str]:
    """Trigrams of one word as ``trigrams`` cuts them."""
    padded = f"  {word} "
    return [padded[i:i + 3] for i in range(len(word) + 1)]


class _Parts:
    """Parts of words, trigrams or terms, as numbers: those of queries first. A task keeps the words it has met up to a bound."""

    def __init__(self, of_queries: list[str], whole: bool):
        self.of_queries, self.whole = of_queries, whole
        self.lengths = sorted({len(t) for t in of_queries})
        self.clear()

    def clear(self) -> None:
        self.number = {t: i for i, t in enumerate(self.of_queries)}
        self.known: dict[str, list[int]] = {}

    def _cut(self, word: str) -> list[int]:
        if self.whole:  # every trigram counts for the size of the unit's set
            return [self.number.setdefault(g, len(self.number)) for g in word_trigrams(word)]
        n = len(word)
        inside = {word[i:i + k] for k in self.lengths if k <= n for i in range(n - k + 1)}
        return [self.number[t] for t in inside & self.number.keys()]

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the words one after the other, and how many each has."""
        if len(self.known) > WORDS_KEPT or len(self.number) > len(self.of_queries) + WORDS_KEPT:
            self.clear()
        got = []
        for w in words:
            parts = self.known.get(w)
            if parts is None:
                parts = self.known[w] = self._cut(w)
            got.append(parts)
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((p for parts in got for p in parts), np.int64, int(size.sum())), size


def _met_in_rows(units: DataFrame, text: Column, asked: pd.DataFrame, size: pd.DataFrame, q_type: T.DataType, whole: bool, least: float, best: int | None) -> DataFrame:
    """(query_id, unit_id, shared, score) of units that share parts of words with a query, counted where the unit's text lies.

    ``asked``: (query_id, part, n); ``size``: (query_id, n), the parts of a query. With ``whole`` parts are trigrams and the score
    is that of Jaccard, else they are terms inside words and the score is the share of the query's. Scores are rounded half up to
    six decimals, and rows below ``least`` dropped. Each task keeps the ``best`` of every query, or all without it.
    """
    queries = size["query_id"].to_numpy()
    number = {q: i for i, q in enumerate(queries.tolist())}
    names, part = np.unique(asked["part"].to_numpy().astype(object), return_inverse=True)
    weight = np.zeros((len(names), len(queries)), np.float32)
    np.add.at(weight, (part, asked["query_id"].map(number).to_numpy().astype(np.int64)), asked["n"].to_numpy().astype(np.float32))
    shared = units.sparkSession.sparkContext.broadcast((queries, size["n"].to_numpy().astype(np.int64), list(names), weight))
    kind, q_arrow = units.schema["unit_id"].dataType.simpleString(), to_arrow_type(q_type)
    cut_units = units.select("unit_id", tx.tokens(text).alias("words"))
    many, cells = 1 << 18, 1 << 21

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_q, names, weight = shared.value
        parts, floor = _Parts(names, whole), np.full(len(queries), least)
        held: list[tuple] = []
        total = 0

        def cut() -> None:
            q, u, c, s = (np.concatenate(x) for x in zip(*held))
            keep = best_places(q, s, u, best)
            q, u, c, s = q[keep], u[keep], c[keep], s[keep]
            held[:] = [(q, u, c, s)]
            ends = np.append(q[1:] != q[:-1], True) if len(q) else np.zeros(0, bool)
            full = np.bincount(q, minlength=len(queries)) >= best
            floor[q[ends]] = np.where(full[q[ends]], np.maximum(s[ends], least), least)

        def out(q: np.ndarray, u: pa.Array, c: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(queries[q], q_arrow), u, pa.array(c), pa.array(s)], ["query_id", "unit_id", "shared", "score"])

        for batch in batches:
            if not batch.num_rows or not len(queries):
                continue
            words = batch.column("words")
            codes = words.flatten().dictionary_encode()
            flat, n = parts.of(codes.dictionary.to_pylist())
            first = np.append(0, np.cumsum(n))
            word = np.asarray(codes.indices).astype(np.int64)
            ends = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(words), 0))))
            used, local = np.unique(flat, return_inverse=True)
            own = int(np.searchsorted(used, len(names)))
            w, ids = weight[used[:own]], batch.column("unit_id")
            step = max(1, cells // max(1, len(used), len(queries)))
            for at in range(0, batch.num_rows, step):
                to = min(at + step, batch.num_rows)
                mine = word[ends[at]:ends[to]]
                row = np.repeat(np.arange(to - at), np.diff(ends[at:to + 1]))
                k = n[mine]
                each = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[mine], k)
                has = np.zeros((to - at, len(used)), bool)
                has[np.repeat(row, k), local[each]] = True
                n_u = has.sum(1)
                c = has[:, :own].astype(np.float32) @ w
                of = np.maximum(n_q[None, :] + n_u[:, None] - c, 1) if whole else n_q[None, :].astype(np.float32)
                u, q = np.nonzero((c >= 0.5) & (c >= (floor[None, :] - 1e-5) * of))
                c = c[u, q].astype(np.int64)
                d = n_q[q] + n_u[u] - c if whole else n_q[q]
                s = (2_000_000 * c + d) // (2 * d) / 1e6
                ok = s >= least
                mine = ids.take(pa.array(at + u[ok]))
                if best is None:
                    yield out(q[ok], mine, c[ok], s[ok])
                    continue
                held.append((q[ok], np.asarray(mine.to_pandas()), c[ok], s[ok]))
                total += int(ok.sum())
                if total > many + 2 * len(queries) * best:
                    cut()
                    total = len(held[0][0])
        if held:
            cut()
            q, u, c, s = held[0]
            yield out(q, pa.array(u, batch.column("unit_id").type), c, s)

    if best is not None:
        cut_units = cut_units.where("unit_id is not null")
    return cut_units.mapInArrow(meet, f"query_id {q_type.simpleString()}, unit_id {kind}, shared bigint, score double")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded with two blanks before and one after."""
    toks = tx.tokens(text)
    padded = F.concat(F.lit("  "), F.array_join(toks, " \n  "), F.lit(" "))
    grams = F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=([^\n]{3}))"), F.lit(1)))
    return F.when(F.size(toks) > 0, grams).otherwise(F.array().cast("array<string>"))


def _within(units: DataFrame, keep: Keep | Within | None) -> tuple[DataFrame, Keep | None]:
    """Units inside a scope of whole units, and the scope that is left to hold on candidates."""
    if not isinstance(keep, Within):
        return units, keep
    return rows_of(units, keep.units, "unit_id"), None


def trigram_similarity(queries: DataFrame, units: DataFrame, threshold: float = 0.3, max_shared: int = 1_000_000,
                       keep: Keep | Within | None = None, best: int | None = None) -> DataFrame:
    """Units whose trigram set overlaps the query's by at least ``threshold`` (Jaccard); exact.

    Each unit meets all queries in its row, as one product of its trigrams with theirs; no text and no trigram is shuffled. With
    ``best``, tasks give on no more than that many rows of a query, equal scores by unit. A ``Within`` holds on units before,
    any other ``keep`` on all pairs that reach the threshold, which are not cut then. More than ``QUERIES_IN_ROWS`` queries are joined.
    """
    if not at_most(queries, QUERIES_IN_ROWS):
        return _joined_trigrams(queries, units, threshold, max_shared, keep)
    units, keep = _within(units, keep)
    words = queries.where("query_id is not null").select("query_id", tx.tokens(F.array_join(search_tokens(F.col("query")), " ")).alias("words"))
    grams = [(r["query_id"], g) for r in words.collect() for g in {g for w in r["words"] or [] for g in word_trigrams(w)}]
    asked = pd.DataFrame(grams, columns=["query_id", "part"])
    size = asked.groupby("query_id").size().rename("n").reset_index()
    asked = asked.drop_duplicates().assign(n=1)
    q_type = queries.schema["query_id"].dataType
    met = _met_in_rows(units.where("unit_id is not null"), F.col("text"), asked, size, q_type, True, threshold, None if keep else best).select("query_id", "unit_id", "score")
    return keep(met) if keep else met


def _joined_trigrams(queries: DataFrame, units: DataFrame, threshold: float, max_shared: int, keep: Keep | Within | None) -> DataFrame:
    """Similar pairs by joins, for any number of queries.

    A unit that similar shares one of the query's n - ceil(threshold n) + 1 rarest trigrams, so only these, by their
    frequency in the corpus, are looked for; sizes that cannot reach the threshold are dropped in the join. What a pair
    shares of them, with all other trigrams of the query on top, must reach the overlap that both sizes ask for. Pairs that
    are left and that ``keep`` lets through are verified once, where the unit's text lies. Neither text nor trigrams of units
    are shuffled unless queries or pairs are more than ``max_shared``.
    """
    def share(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if at_most(df, max_shared) else df

    grams = trigrams(F.array_join(search_tokens(F.col("query")), " "))
    q = queries.select("query_id", F.explode(grams).alias("gram"))
    u = units.select("unit_id", trigrams(F.col("text")).alias("g"))
    freq = u.select(F.explode("g").alias("gram")).join(share(q.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    o = q.join(freq, "gram", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("o"))
    nq = F.size("o")
    ordered = cut_lineage(o.select("query_id", nq.alias("nq"), F.transform("o", lambda x: x["gram"]).alias("grams"), (nq - F.ceil(nq * F.lit(threshold) - 1e-9) + 1).cast("int").alias("first")))
    probe = ordered.select("query_id", "nq", "first", F.explode(F.slice("grams", F.lit(1), F.col("first"))).alias("gram"))
    fits = (F.col("nu") >= threshold * F.col("nq") - 1e-9) & (threshold * F.col("nu") - 1e-9 <= F.col("nq"))
    met = u.select("unit_id", F.size("g").alias("nu"), F.explode("g").alias("gram")).join(share(probe), "gram").where(fits)
    need = (F.col("nq") + F.col("nu")) * (threshold / (1 + threshold)) - 1e-6
    able = met.groupBy("query_id", "unit_id").agg(F.count("*").alias("c"), F.first("nq").alias("nq"), F.first("nu").alias("nu"), F.first("first").alias("first")).where(
        F.col("c") + F.col("nq") - F.col("first") >= need)
    able = able.select("query_id", "unit_id")
    pairs = cut_lineage(keep(able) if keep else able)
    c = F.size(F.array_intersect("grams", "g"))
    verified = u.join(share(pairs), "unit_id").join(share(ordered.select("query_id", "nq", "grams")), "query_id").select(
        "query_id", "unit_id", F.round(c / (F.col("nq") + F.size("g") - c), 6).alias("score"))
    return verified.filter(F.col("score") >= threshold)


def _windows(codes: np.ndarray) -> Callable[[int], np.ndarray]:
    """Hashes of all stretches of a width, by the width; a stretch's hash is put together from those of its halves."""
    known = {1: codes.astype(np.uint64)}

    def of(width: int) -> np.ndarray:
        if width not in known:
            left = width // 2
            n = max(0, len(codes) - width + 1)
            known[width] = of(left)[:n] * np.uint64(pow(HASH_BASE, width - left, 1 << 64)) + of(width - left)[left:left + n]
        return known[width]

    return of


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _opened(needles: DataFrame, texts: DataFrame, with_text: bool, points: Callable[[str, str], int] | None = None) -> DataFrame:
    """(id, term) of texts that contain a needle, and the text if asked for; ``needles`` are distinct, not empty and few.

    With ``points``, also the points of each (text, term).

    A needle's opening, as wide as a width of ``OPENINGS`` allows, is looked for by its hash at all places of the texts.
    """
    terms = sorted(r["term"] for r in needles.collect())
    by_width: dict[int, list[int]] = {}
    for i, t in enumerate(terms):
        by_width.setdefault(next(w for w in OPENINGS if w <= len(t)), []).append(i)
    tables = []
    for w, which in sorted(by_width.items()):
        hashes = np.array([_windows(_codes(terms[i][:w]))(w)[0] for i in which], np.uint64)
        order = np.argsort(hashes, kind="stable")
        maybe = np.zeros(1 << 16, bool)
        maybe[(hashes * HASH_MIX) >> np.uint64(48)] = True
        tables.append((w, hashes[order], np.array(which)[order], maybe))
    shared = texts.sparkSession.sparkContext.broadcast((terms, tables))
    names = ["id", "text"] if with_text else ["id"]
    kind, room = texts.schema["id"].dataType.simpleString(), 1 << 20

    def places(codes: np.ndarray, tables: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the codes at which needles may open, and the needles."""
        widest = max((w for w, _, _, _ in tables), default=1)
        for at in range(0, len(codes), room):
            windows = _windows(codes[at:at + room + widest - 1])
            for w, hashes, which, maybe in tables:
                h = windows(w)[:room]
                hit = np.flatnonzero(maybe[(h * HASH_MIX) >> np.uint64(48)])
                lo, hi = (np.searchsorted(hashes, h[hit], side) for side in ("left", "right"))
                n = hi - lo
                each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                yield np.repeat(hit, n) + at, which[each]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, tables = shared.value
        told = pa.array(terms, pa.string())
        for whole in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(whole.column("text")), 0)).astype(np.int64))
            cuts = np.flatnonzero(np.diff(size // room, prepend=0))
            for start, end in zip(np.append(0, cuts), np.append(cuts, whole.num_rows)):
                batch = whole.slice(start, end - start)
                if not batch.num_rows or not terms:
                    continue
                own = [t or "" for t in batch.column("text").to_pylist()]
                ends = np.cumsum([len(t) for t in own])
                keys = [np.searchsorted(ends, place, "right") * len(terms) + term for place, term in places(_codes("".join(own)), tables)]
                row, term = np.divmod(np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64), len(terms))
                ok = np.fromiter((terms[t] in own[r] for r, t in zip(row.tolist(), term.tolist())), bool, len(row))
                bounds = pa.array(np.searchsorted(row[ok], np.arange(batch.num_rows + 1)).astype(np.int32))
                found = pa.ListArray.from_arrays(bounds, told.take(pa.array(term[ok])))
                scored = [] if points is None else [points(own[r], terms[t]) for r, t in zip(row[ok].tolist(), term[ok].tolist())]
                more = [] if points is None else [pa.ListArray.from_arrays(bounds, pa.array(scored, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found, *more], [*names, "term", "points"][:len(names) + 1 + len(more)])

    found = texts.select("id", "text").mapInArrow(
        meet, f"id {kind}, {'text string, ' if with_text else ''}term array<string>{', points array<int>' if points else ''}")
    if points is None:
        return found.select(*names, F.explode("term").alias("term"))
    return found.select(*names, F.explode(F.arrays_zip("term", "points")).alias("x")).select(*names, "x.term", "x.points")


def containing(needles: DataFrame, texts: DataFrame, widths: tuple[int, ...] = (3, 2, 1),
               max_shared: int = 100_000, **extra: Column) -> DataFrame:
    """All (term, id) pairs where ``texts.text`` contains ``needles.term``; exact, without a cross join.

    Up to ``max_shared`` needles are handed to every task, which finds their openings in its texts and verifies each there. Of
    more, each needle is anchored on its rarest gram of the largest of ``widths`` that fits it; texts meet needles
    on that gram and are then verified with ``contains``. ``extra`` columns may use text and term.
    """
    columns = [c.alias(n) for n, c in extra.items()]
    few = needles.filter(F.length("term") > 0).select("term").distinct()
    if at_most(few, max_shared):
        return _opened(few, texts, bool(extra)).select("id", "term", *columns)
    width = F.coalesce(*[F.when(F.length("term") >= w, F.lit(w)) for w in sorted(widths, reverse=True)])
    needle_grams = needles.filter(F.length("term") > 0).select("term").distinct().select("term", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("term") - width + 1),
        lambda i: F.substring(F.col("term"), i, width))).alias("gram"))
    grams = F.flatten(F.array(*[tx.char_ngrams(F.col("text"), w) for w in widths]))
    freq = (
        texts.select(F.explode(grams).alias("gram"))
        .join(needle_grams.select("gram").distinct(), "gram", "left_semi")
        .groupBy("gram").agg(F.count("*").alias("n"))
    )
    anchors = needle_grams.join(freq, "gram", "left").groupBy("term").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    # Too many needles to share: meet on (id, gram) alone and fetch the text for the survivors.
    pairs = texts.select("id", F.explode(grams).alias("gram")).join(anchors, "gram").select("id", "term")
    found = pairs.join(texts.select("id", "text"), "id")
    return found.filter(F.contains("text", "term")).select("id", "term", *columns)


def word_hits(terms: DataFrame, units: DataFrame, max_shared: int = 1_000_000) -> DataFrame:
    """Distinct (unit_id, term) of units whose lower-case text contains a term that is one token.

    Such a term lies inside one token of the text, so terms are looked for in the distinct tokens of all texts, and a task
    needs no more than its units' tokens and the (token, term) pairs that were found.
    """
    words = units.select("unit_id", F.array_distinct(tx.tokens(F.coalesce("text", F.lit("")))).alias("words"))
    known = words.select(F.explode("words").alias("id")).distinct().withColumn("text", F.col("id"))
    pairs = cut_lineage(containing(terms.select("term").distinct(), known).select(F.col("id").alias("word"), "term"))
    if not at_most(pairs, max_shared):
        return words.select("unit_id", F.explode("words").alias("word")).join(pairs, "word").select("unit_id", "term").distinct()
    local = pairs.toPandas().sort_values("word", ignore_index=True)
    names, first = np.unique(local["word"].to_numpy().astype(object), return_index=True)
    all_terms, codes = np.unique(local["term"].to_numpy().astype(object), return_inverse=True)
    shared = units.sparkSession.sparkContext.broadcast((names, first, np.diff(np.append(first, len(local))), all_terms, codes))

    def meet_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, size, all_terms, codes = shared.value
        known, told = pa.array(names, pa.string()), pa.array(all_terms, pa.string())
        for batch in batches:
            items = batch.column("words")
            place = pc.index_in(items.flatten(), value_set=known)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(items)))[np.asarray(place.is_valid())]
            word = np.asarray(place.drop_null())
            n = size[word]
            each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)
            key = np.unique(np.repeat(row, n) * max(1, len(all_terms)) + codes[each])
            unit, term = np.divmod(key, max(1, len(all_terms)))
            yield pa.RecordBatch.from_arrays([batch.column("unit_id").take(pa.array(unit)), told.take(pa.array(term))], ["unit_id", "term"])

    return words.mapInArrow(meet_words, f"unit_id {units.schema['unit_id'].dataType.simpleString()}, term string")


def substring_hits(terms: DataFrame, units: DataFrame, keep: Keep | Within | None = None, best: int | None = None) -> DataFrame:
    """Share of a query's terms found anywhere inside the unit text, for the units that ``keep`` lets through.

    Rows of one unit_id count as one unit, with the hits of all. Terms of one token lie inside tokens of the text: a task
    looks for them in the distinct tokens that it meets and scores each unit in its row. With ``best``, tasks give on no more
    than that many rows of a query, equal scores by unit; units that come in several rows are added up first.
    """
    units, keep = _within(units, keep)
    size = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    one_token = F.col("term").rlike(f"^(?:{tx.CJK}|{tx.WORD})$")
    others = terms.where(~one_token)
    in_rows = others.isEmpty() and not at_most(units.select("unit_id"), FEW_UNITS) and at_most(size, QUERIES_IN_ROWS) and at_most(terms, 1_000_000)
    if in_rows:
        asked = terms.where(one_token).where("query_id is not null").groupBy("query_id", F.col("term").alias("part")).agg(F.count("*").alias("n")).toPandas()
        sizes = size.where("query_id is not null").withColumnRenamed("n_terms", "n").toPandas()
        q_type = terms.schema["query_id"].dataType

        def met(some: DataFrame, best: int | None) -> DataFrame:
            return _met_in_rows(some, F.coalesce("text", F.lit("")), asked, sizes, q_type, False, 0.0, best)

        if best is not None and not keep:
            again = cut_lineage(units.groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1 OR unit_id is null").select("unit_id"))
            if again.isEmpty():
                return met(units, best).select("query_id", "unit_id", "score")
            share = F.broadcast(again) if at_most(again, 500_000) else again
            once = met(units.join(share, "unit_id", "left_anti"), best).select("query_id", "unit_id", F.col("shared").alias("hits"))
            several = met(rows_of(units, again, "unit_id").unionByName(units.where("unit_id is null")), None).groupBy("query_id", "unit_id").agg(F.sum("shared").alias("hits"))
            hits = once.unionByName(several)
        else:
            hits = met(units, None).groupBy("query_id", "unit_id").agg(F.sum("shared").alias("hits"))
    else:
        found = word_hits(terms.where(one_token), units)
        if not others.isEmpty():
            low = units.select(F.col("unit_id").alias("id"), F.lower("text").alias("text"))
            found = found.unionByName(containing(others, low).select(F.col("id").alias("unit_id"), "term"))
        asked = F.broadcast(terms) if at_most(terms, 1_000_000) else terms
        hits = found.join(asked, "term").groupBy("query_id", "unit_id").agg(F.count("*").alias("hits"))
    return (
        (keep(hits) if keep else hits).join(size, "query_id")
        .select("query_id", "unit_id", F.round(F.col("hits") / F.col("n_terms"), 6).alias("score"))
    )


def cascade(queries: DataFrame, levels: list) -> DataFrame:
    """Run each level only for the queries no earlier level answered.

    ``levels`` is a list of (source name, function from queries to candidates). A level's candidates are settled, as all later
    levels ask for their queries; when every query is answered, no further level is asked.
    """
    left, parts = queries, []
    for source, route in levels:
        if parts and left.isEmpty():
            break
        found = cut_lineage(route(left).withColumn("source", F.lit(source)))
        parts.append(found)
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return reduce(DataFrame.unionByName, parts)


def scoped_cascade(queries: DataFrame, levels: list, keeps: list[Keep | None]) -> DataFrame:
    """A cascade whose every level tries the scopes in turn, strictest first, before the next level is asked.

    ``levels`` is a list of (source name, function from queries and scope to candidates); ``step`` is the scope's place in the list.
    """
    steps = [(f"{source}#{i}", lambda q, route=route, keep=keep: route(q, keep)) for source, route in levels for i, keep in enumerate(keeps)]
    parts = F.split("source", "#")
    return cascade(queries, steps).withColumns({"source": parts[0], "step": parts[1].cast("int")})


# --- filters -----------------------------------------------------------------------------------


def facet_scope(candidates: DataFrame, facets: DataFrame, scope: DataFrame) -> DataFrame:
    """Keep candidates whose facet value is listed for every facet the query restricts.

    Unknown facet keys are ignored; a query without restrictions passes everything.
    """
    known = scope.filter(F.col("facet").isin(*FACET_KEYS))
    want = known.groupBy("query_id").agg(F.count_distinct("facet").alias("n_facets"))
    ok = (
        candidates.select("query_id", "unit_id").join(facets, "unit_id").join(known, ["query_id", "facet", "value"])
        .groupBy("query_id", "unit_id").agg(F.count_distinct("facet").alias("n_ok"))
    )
    return (
        candidates.join(want, "query_id", "left").join(ok, ["query_id", "unit_id"], "left")
        .filter(F.col("n_facets").isNull() | (F.col("n_ok") == F.col("n_facets"))).drop("n_facets", "n_ok")
    )


def section_filter(candidates: DataFrame, unit_sections: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Keep candidates lying in one of the query's chapters; queries without chapters pass."""
    keyed = unit_sections.select("unit_id", F.lower(tx.strip(F.col("section"))).alias("section"))
    inside = candidates.join(keyed, "unit_id").join(prefixes, ["query_id", "section"], "left_semi").drop("section")
    free = candidates.join(prefixes.select("query_id").distinct(), "query_id", "left_anti")
    return inside.unionByName(free)


def relaxation(candidates: DataFrame) -> DataFrame:
    """Keep each query's strictest non-empty level: scope and section, scope only, neither.

    ``candidates`` carries boolean ``in_scope`` and ``in_section``. The strictest level is found by
    a combinable aggregate and joined back, so a query with very many candidates is never gathered.
    """
    level = F.when(F.col("in_scope") & F.col("in_section"), 0).when(F.col("in_scope"), 1).otherwise(2)
    c = candidates.withColumn("level", level)
    best = c.groupBy("query_id").agg(F.min("level").alias("level"))
    return c.join(best, ["query_id", "level"], "left_semi")


# --- dense -------------------------------------------------------------------------------------


def _unit_rows(vectors: pd.Series, dim: int) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype="float64") for v in vectors]) if len(vectors) else np.zeros((0, dim))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _best(ids: np.ndarray, scores: np.ndarray, k: int):
    """Best k distinct ids by score, ties by id; one row of scores."""
    order = np.lexsort((ids, -scores))
    seen, keep = set(), []
    for i in order:
        if ids[i] not in seen:
            seen.add(ids[i])
            keep.append(i)
            if len(keep) == k:
                break
    return keep


def _score_frame(q_ids, q_mat, ids, mat, k, q_groups=None, groups=None):
    scores = np.round(q_mat @ mat.T, 6)
    if groups is not None:
        scores[np.asarray(q_groups)[:, None] != np.asarray(groups)[None, :]] = OUTSIDE
    out = []
    for row, q in enumerate(q_ids):
        s = scores[row]
        if len(s) > 4 * k:  # cheap cut that keeps every tie; distinct ids may need more than k rows
            floor = np.partition(s, -4 * k)[-4 * k]
            idx = np.flatnonzero(s >= floor)
            if len(set(ids[idx])) < k:
                idx = np.arange(len(s))
        else:
            idx = np.arange(len(s))
        keep = idx[_best(ids[idx], s[idx], k)]
        keep = keep[s[keep] > OUTSIDE]
        out.append(pd.DataFrame({"query_id": q, "unit_id": ids[keep], "score": s[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "unit_id": [], "score": []})


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, dim: int, max_shared_queries: int = 4096,
                block: int = 4096) -> DataFrame:
    """Cosine top-k of ``queries(query_id, vector)`` over ``vectors(unit_id, vector)``; wrong sizes are dropped.

    Up to ``max_shared_queries`` query vectors are shared with every task and the corpus is read
    once without a shuffle: each task keeps its k best per query. More queries than that are
    compared block by block, every (corpus block, query block) pair being one bounded task.
    Several vectors may carry the same ``unit_id``; the closest one counts. If both tables have a
    ``group`` column, only vectors of the query's own group count.
    """
    extra = ["group"] if "group" in queries.columns and "group" in vectors.columns else []
    q = queries.filter(F.size("vector") == dim).select("query_id", "vector", *extra)
    v = vectors.filter(F.size("vector") == dim).select("unit_id", "vector", *extra)
    id_type = v.schema["unit_id"].dataType.simpleString()
    q_type = q.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, unit_id {id_type}, score double"
    if at_most(q, max_shared_queries):
        local = q.limit(max_shared_queries).toPandas()
        shared = q.sparkSession.sparkContext.broadcast((
            local["query_id"].to_numpy(), _unit_rows(local["vector"], dim), local["group"].to_numpy() if extra else None))

        def score(frames):
            q_ids, q_mat, q_groups = shared.value
            best = None
            for pdf in frames:
                if len(pdf) == 0 or len(q_ids) == 0:
                    continue
                part = _score_frame(q_ids, q_mat, pdf["unit_id"].to_numpy(), _unit_rows(pdf["vector"], dim), k, q_groups,
                                    pdf["group"].to_numpy() if extra else None)
                best = part if best is None else pd.concat([best, part])
                if len(best) > 20 * k * len(q_ids):
                    best = _cut(best, k)
            if best is not None:
                yield _cut(best, k)

        partial = v.mapInPandas(score, schema)
    else:
        n_q, n_v = q.count(), v.count()
        b_q, b_v = max(1, -(-n_q // block)), max(1, -(-n_v // (16 * block)))
        qs = q.withColumn("bq", F.pmod(F.xxhash64("query_id"), F.lit(b_q))).withColumn(
            "bv", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(b_v - 1).cast("bigint"))))
        vs = v.withColumn("bv", F.pmod(F.xxhash64("unit_id", "vector"), F.lit(b_v))).withColumn(
            "bq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(b_q - 1).cast("bigint"))))

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if len(left) == 0 or len(right) == 0:
                return pd.DataFrame({"query_id": [], "unit_id": [], "score": []})
            return _score_frame(left["query_id"].to_numpy(), _unit_rows(left["vector"], dim),
                                right["unit_id"].to_numpy(), _unit_rows(right["vector"], dim), k,
                                left["group"].to_numpy() if extra else None, right["group"].to_numpy() if extra else None)

        partial = qs.groupBy("bq", "bv").cogroup(vs.groupBy("bq", "bv")).applyInPandas(pair, schema)
    return top_k(partial.groupBy("query_id", "unit_id").agg(F.max("score").alias("score")), k)


def _cut(best: pd.DataFrame, k: int) -> pd.DataFrame:
    best = best.sort_values(["query_id", "score", "unit_id"], ascending=[True, False, True])
    best = best.drop_duplicates(["query_id", "unit_id"])
    return best.groupby("query_id", sort=False).head(k)


def dense_by_kind(queries: DataFrame, vectors: DataFrame, kind: str, k: int, dim: int) -> DataFrame:
    """Dense top-k over one kind of unit text: ``raw_text``, ``generated_question`` or ``both``."""
    pool = vectors if kind == "both" else vectors.filter(F.col("text_kind") == kind)
    return dense_top_k(queries, pool, k, dim)


# --- entities and graph ------------------------------------------------------------------------


def entity_names(query_entities: DataFrame, keywords: DataFrame) -> DataFrame:
    """Entity names of each query; keywords of two or more characters where it has none."""
    named = query_entities.filter(~tx.is_blank(F.col("name"))).select("query_id", "name").distinct()
    spare = keywords.filter(F.length("name") >= 2).select("query_id", "name").distinct()
    return named.unionByName(spare.join(named.select("query_id").distinct(), "query_id", "left_anti"))


def entity_exact(names: DataFrame, unit_refs: DataFrame, k: int) -> DataFrame:
    """Units that carry one of the names, heaviest first, all at the same fixed score."""
    hit = unit_refs.join(names, "name").groupBy("query_id", "unit_id").agg(F.max("weight").alias("weight"))
    return top_k(hit, k, score="weight").withColumn("score", F.lit(EXACT_SCORE))


def link_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Query names to entity ids, by canonical name or by alias."""
    low = names.select("query_id", F.lower(tx.strip(F.col("name"))).alias("n")).distinct()
    direct = low.join(entities.select("entity_id", F.lower("canonical_name").alias("n")), "n")
    via = low.join(aliases.select(F.col("alias_normalized").alias("n"), "canonical_name"), "n") \
        .join(entities.select("entity_id", "canonical_name"), "canonical_name")
    return direct.select("query_id", "entity_id").unionByName(via.select("query_id", "entity_id")).distinct()


def symmetric(edges: DataFrame, head: str = "head", tail: str = "tail") -> DataFrame:
    """Both directions of every edge as (src, dst, other columns)."""
    rest = [c for c in edges.columns if c not in (head, tail)]
    one = edges.select(F.col(head).alias("src"), F.col(tail).alias("dst"), *rest)
    two = edges.select(F.col(tail).alias("src"), F.col(head).alias("dst"), *rest)
    return one.unionByName(two)


def split_hubs(adjacency: DataFrame, key: str, hub: int = HUB_EDGES) -> tuple[DataFrame, DataFrame]:
    """Adjacency rows with a ``chunk`` number, and the hubs: nodes of more than ``hub`` rows with their number of chunks.

    A hub's rows are dealt over its chunks by a hash of the whole row; all others have chunk 0. There are at most
    (rows / hub) hubs.
    """
    hubs = adjacency.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hub).select(key, F.ceil(F.col("n") / hub).cast("int").alias("chunks"))
    spread = F.pmod(F.xxhash64(*adjacency.columns), F.coalesce("chunks", F.lit(1))).cast("int")
    return adjacency.join(hubs, key, "left").withColumn("chunk", spread).drop("chunks"), hubs


def meet(front: DataFrame, entity: str, adjacency: DataFrame, hubs: DataFrame, key: str) -> DataFrame:
    """Frontier rows with the adjacency rows of their entity; a row on a hub goes to each of the hub's chunks."""
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    placed = front.withColumnRenamed(entity, key).join(hubs, key, "left").withColumn("chunk", copies).drop("chunks")
    return placed.join(adjacency, [key, "chunk"]).drop("chunk")


def graph_reach(seeds: DataFrame, edges: DataFrame, max_hop: int, min_confidence: float, hub: int = HUB_EDGES) -> DataFrame:
    """Entities within ``max_hop`` undirected hops: fewest hops and best product of confidences.

    Confidences lie in [0, 1], so a walk that returns to a node never beats the path without the
    loop: the best value per (query, node) after each hop is enough and paths are never listed. A hub's edges
    are met chunk by chunk (``split_hubs``); the best values are combined before they are shuffled.
    """
    both = symmetric(edges.filter(F.col("confidence") >= min_confidence)).groupBy("src", "dst").agg(
        F.max("confidence").alias("w"))
    both, hubs = split_hubs(both, "src", hub)
    front = seeds.select("query_id", "entity_id", F.lit(0).alias("hop"), F.lit(1.0).alias("conf"))
    reached = [front]
    for hop in range(1, max_hop + 1):
        front = (
            meet(front.select("query_id", "entity_id", "conf"), "entity_id", both, hubs, "src")
            .groupBy("query_id", F.col("dst").alias("entity_id"))
            .agg(F.lit(hop).alias("hop"), F.max(F.col("conf") * F.col("w")).alias("conf"))
        )
        reached.append(front)
    return reduce(DataFrame.unionByName, reached).groupBy("query_id", "entity_id").agg(
        F.min("hop").alias("hop"), F.max("conf").alias("conf"))


def graph_recall(seeds: DataFrame, edges: DataFrame, evidence: DataFrame, unit_segments: DataFrame, max_hop: int,
                 min_confidence: float, active: DataFrame | None = None) -> DataFrame:
    """Units whose segment is evidence of a reached entity, one row per (query, unit).

    ``active`` (segment_id) is the released scope: evidence outside it leads to no unit. Edges are walked whatever their evidence.
    """
    reach = graph_reach(seeds, edges, max_hop, min_confidence)
    if active is not None:
        evidence = evidence.join(active.select("segment_id").distinct(), "segment_id", "left_semi")
    return (
        reach.join(evidence.select("entity_id", "segment_id").distinct(), "entity_id")
        .groupBy("query_id", "segment_id").agg(F.min("hop").alias("hop"), F.max("conf").alias("conf"))
        .join(unit_segments.select("segment_id", "unit_id", "unit_type"), "segment_id")
        .select("query_id", "unit_id", "unit_type", "hop", "conf")
    )


def graph_score(decay: float = 0.6) -> Column:
    """Score of a graph candidate: base x decay^hop x confidence, raised for entity cards."""
    d = decay if 0 < decay <= 1 else 0.6
    conf = F.when(F.col("conf") <= 0, F.lit(0.01)).otherwise(F.least(F.col("conf"), F.lit(1.0)))
    boost = F.when(F.col("unit_type") == "entity_card", F.lit(CARD_BOOST)).otherwise(F.lit(1.0))
    return F.lit(GRAPH_BASE) * F.pow(F.lit(d), F.greatest(F.col("hop"), F.lit(0))) * conf * boost


def one_hop(frontier: DataFrame, relations: DataFrame, types: list[str] | None = None,
            scope: DataFrame | None = None) -> DataFrame:
    """Neighbours of frontier segments in both directions, within scope on both ends."""
    r = relations if not types else relations.filter(F.col("relation_type").isin(*types))
    if scope is not None:
        for end in ("source_id", "target_id"):
            r = r.join(scope.select(F.col("segment_id").alias(end)), end, "left_semi")
    both = symmetric(r.select("source_id", "target_id", "relation_type", "relation_id"), "source_id", "target_id")
    return frontier.join(both, frontier["segment_id"] == both["src"]).select(
        *[c for c in frontier.columns if c != "segment_id"], F.col("src").alias("from_id"),
        F.col("dst").alias("neighbor_id"), "relation_type", "relation_id")


def priority_of(types: list[str] | None) -> Column:
    """Budget priority of a relation type: the given order, else the global table; unknown ones last."""
    table = {t: i for i, t in reversed(list(enumerate(types)))} if types else RELATION_PRIORITY
    pairs = [x for t, p in table.items() for x in (F.lit(t), F.lit(p))]
    return F.coalesce(F.create_map(*pairs)[F.col("relation_type")], F.lit(LOWEST_PRIORITY))


def expand(seeds: DataFrame, relations: DataFrame, depth: int, types: list[str] | None = None,
           budget: int = EXPANSION_BUDGET, scope: DataFrame | None = None, ceiling: int = EXPANSION_BUDGET) -> DataFrame:
    """Breadth-first expansion of seed segments under a node budget per query, never above ``ceiling``.

    First visit wins; within a level better relation types claim the budget first. Each level keeps
    at most ``budget`` rows per query, so the frontier stays small whatever the degree of a node.
    """
    budget = min(budget, ceiling)
    seeds = cut_lineage(seeds.select("query_id", "segment_id"))
    visited = seeds.select("query_id", "segment_id").distinct()
    frontier = visited.withColumn("root_id", F.col("segment_id"))
    used = visited.select("query_id").distinct().withColumn("used", F.lit(0))
    parts = []
    for level in range(1, depth + 1):
        step = one_hop(frontier, relations, types, scope).withColumn("p", priority_of(types))
        best = F.min_by(F.struct("relation_type", "root_id"), F.struct("p", "root_id", "relation_type"))
        fresh = (
            step.groupBy("query_id", F.col("neighbor_id").alias("segment_id"))
            .agg(F.min("p").alias("p"), best.alias("b"))
            .join(visited, ["query_id", "segment_id"], "left_anti")
        )
        w = W.partitionBy("query_id").orderBy("p", "segment_id")
        taken = (
            fresh.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= budget)
            .join(used, "query_id").filter(F.col("n") + F.col("used") <= budget)
            .select("query_id", "segment_id", F.lit(level).alias("distance"), "b.relation_type", "b.root_id")
        )
        taken = cut_lineage(taken)
        parts.append(taken)
        visited = visited.unionByName(taken.select("query_id", "segment_id"))
        frontier = taken.select("query_id", "segment_id", "root_id")
        got = reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(F.count("*").alias("g"))
        used = seeds.select("query_id").distinct().join(got, "query_id", "left").select(
            "query_id", F.coalesce("g", F.lit(0)).alias("used"))
    return reduce(DataFrame.unionByName, parts)


def expansion_candidates(expanded: DataFrame) -> DataFrame:
    """Expanded segments as candidates scored by distance."""
    return expanded.select(
        "query_id", F.col("segment_id").alias("unit_id"), "relation_type",
        (1.0 / (1 + F.greatest(F.col("distance"), F.lit(0)))).alias("score"), F.lit("graph_expand").alias("source"))


# --- execution ---------------------------------------------------------------------------------


def run_routes(plan: DataFrame, routes: dict[str, DataFrame]) -> DataFrame:
    """Candidates of the routes each query's plan asks for, each cut to its own top-k.

    ``plan`` has (query_id, route, weight, top_k); routes not supplied are skipped.
    """
    parts = [r.select("query_id", "unit_id", "score").withColumn("route", F.lit(n)) for n, r in routes.items()]
    both = reduce(DataFrame.unionByName, parts).join(plan, ["query_id", "route"])
    w = W.partitionBy("query_id", "route").orderBy(F.col("score").desc(), "unit_id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("top_k"))


def route_trace(plan: DataFrame, executed: DataFrame, registered: list[str]) -> DataFrame:
    """One row per planned route with its state and candidate count."""
    counts = executed.groupBy("query_id", "route").agg(F.count("*").alias("n"))
    return plan.join(counts, ["query_id", "route"], "left").select(
        "query_id", "route",
        F.when(~F.col("route").isin(*registered), "skipped").otherwise("done").alias("state"),
        F.coalesce("n", F.lit(0)).alias("candidates"))


def hydrate(candidates: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """Join heavy columns to the surviving candidates only."""
    return candidates.join(units.select("unit_id", *columns), "unit_id", "left")


def section_keyword_search(terms: DataFrame, sections: DataFrame, exclude_title: str | None = "change history") -> DataFrame:
    """Sections containing every term of a query: 1000 per title hit, up to 50 text hits per term."""
    base = sections.select(
        F.col("section_id").alias("id"), F.lower("title").alias("title"), F.lower("text").alias("body"))
    if exclude_title:
        base = base.filter(~F.contains("title", F.lit(exclude_title)))
    title, body = F.split_part("text", F.lit("\x00"), F.lit(1)), F.split_part("text", F.lit("\x00"), F.lit(2))
    term = F.col("term")
    score = tx.occurrences(title, term) * 1000 + F.least(tx.occurrences(body, term), F.lit(50))
    joined = base.select("id", F.concat_ws("\x00", "title", "body").alias("text"))
    size = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    few = terms.filter(F.length("term") > 0).select("term").distinct()

    def points(text: str, term: str) -> int:
        parts = text.split("\x00")
        return parts[0].count(term) * 1000 + min(parts[1].count(term) if len(parts) > 1 else 0, 50)

    found = _opened(few, joined, False, points) if at_most(few, 100_000) else containing(terms, joined, points=score)
    return (
        found.join(terms, "term")
        .groupBy("query_id", F.col("id").alias("section_id")).agg(F.sum("points").alias("score"), F.count("*").alias("hits"))
        .join(size, "query_id").filter("hits = n_terms").select("query_id", "section_id", "score")
    )
