"""Ordered folds over one document's segments, inside the document's row and without Python.

A document's segments are an array; a fold is one ``aggregate`` over it. What a fold moves are cells: a type, the section's
path, the counts of words and CJK characters and the numbers of the segments that a cell holds. Counts add up, so no fold
reads text; texts are joined once, at the end, in the order of the numbers. Only ``split_text`` cuts text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as tx

# Fixed values.
MERGE_BELOW, MERGE_MAX, TABLE_ALONE = 100, 512, 300
MIN_CHUNK, MAX_CHUNK = 128, 512
TABLES = ("table", "html_table")
RIGID = (*TABLES, "code")
TYPE_PRIORITY = {"table": 4, "html_table": 4, "list": 3, "code": 2, "blockquote": 1, "paragraph": 1, "raw_html": 1, "unknown": 0}

CELL = "struct<type:string,path:array<string>,words:int,cjk:int,members:array<int>>"


def cells_of(segments: Column) -> Column:
    """One cell per segment of an array of (type, path, text)."""
    return F.transform(segments, lambda s, i: F.struct(
        s["type"].alias("type"), s["path"].alias("path"), F.regexp_count(s["text"], F.lit(tx.WORD)).alias("words"),
        F.regexp_count(s["text"], F.lit(tx.CJK)).alias("cjk"), F.array(i).alias("members")))


def tokens_in(cell: Column) -> Column:
    return (cell["words"] + F.bround(cell["cjk"] * F.lit(1.5))).cast("int")


def _rank(kind: Column) -> Column:
    known = F.create_map(*[x for k, v in TYPE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, kind), F.lit(0))


def _cell(kind: Column, path: Column, words: Column, cjk: Column, members: Column) -> Column:
    return F.struct(kind.alias("type"), path.alias("path"), words.alias("words"), cjk.alias("cjk"), members.alias("members"))


def _joined(host: Column, guest: Column) -> Column:
    """The host with the guest's segments behind its own, under the type of higher priority."""
    kind = F.when(_rank(host["type"]) >= _rank(guest["type"]), host["type"]).otherwise(guest["type"])
    return _cell(kind, host["path"], host["words"] + guest["words"], host["cjk"] + guest["cjk"], F.concat(host["members"], guest["members"]))


def _nothing(kind: str = CELL) -> Column:
    return F.array().cast(f"array<{kind}>")


def _swap_last(done: Column, cell: Column) -> Column:
    return F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(cell))


def merge_small(cells: Column) -> Column:
    """Fold short neighbours of one section together; big tables and code stay alone.

    A short paragraph takes a list or table that follows it; anything short that may move joins what stands before it.
    """

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = last.isNotNull() & (last["path"] == s["path"]) & (tokens_in(last) + tokens_in(s) <= MERGE_MAX)
        big = s["type"].isin(*TABLES) & (tokens_in(s) > TABLE_ALONE)
        leads = (last["type"] == "paragraph") & (tokens_in(last) < MERGE_BELOW) & s["type"].isin("list", *TABLES) & ~big
        follows = (tokens_in(s) < MERGE_BELOW) & ~s["type"].isin(*RIGID) & ~last["type"].isin(*RIGID)
        return F.when(near & (leads | follows), _swap_last(done, _joined(last, s))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(cells, _nothing(), step)


def absorb_orphans(cells: Column) -> Column:
    """Move short segments, last first, into the nearest cell of the closest ancestor section that has room.

    The state is the whole list; a cell that moved keeps its place without members until the end.
    """
    short = F.filter(F.transform(cells, lambda c, i: F.when((tokens_in(c) < MIN_CHUNK) & ~c["type"].isin(*RIGID), i)), lambda i: i.isNotNull())

    def host_of(state: Column, i: Column) -> Column:
        """Place of the cell that takes cell i, null if none does."""
        lone = F.get(state, i)
        deep = F.size(lone["path"])
        depths = F.when(deep > 0, F.sequence(deep - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

        def nearest(depth: Column) -> Column:
            above = F.slice(lone["path"], F.lit(1), depth)
            gaps = F.transform(state, lambda c, j: F.when((F.size(c["members"]) > 0) & (j != i) & (c["path"] == above), F.struct(F.abs(j - i).alias("gap"), j.alias("at"))))
            return F.array_min(F.filter(gaps, lambda g: g.isNotNull()))["at"]

        def has_room(j: Column) -> Column:
            host = F.get(state, j)
            return j.isNotNull() & (tokens_in(host) + tokens_in(lone) <= MAX_CHUNK) & ~host["type"].isin(*RIGID)

        return F.get(F.filter(F.transform(depths, nearest), has_room), F.lit(0))

    def step(held: Column, i: Column) -> Column:
        # The host's place is worked out once per orphan, in the state, before the list is rewritten.
        state, host = held["cells"], host_of(held["cells"], i)
        moved = F.transform(F.array(F.struct(state.alias("s"), host.alias("h"))), lambda x: F.when(x["h"].isNull(), x["s"]).otherwise(F.transform(
            x["s"], lambda c, k: F.when(k == x["h"], _joined(c, F.get(x["s"], i))).when(
                k == i, _cell(c["type"], c["path"], F.lit(0), F.lit(0), F.array().cast("array<int>"))).otherwise(c))))
        return F.struct(F.get(moved, F.lit(0)).alias("cells"))

    left = F.aggregate(F.reverse(short), F.struct(cells.alias("cells")), step, lambda held: held["cells"])
    return F.filter(left, lambda c: F.size(c["members"]) > 0)


def merge_lead_ins(cells: Column) -> Column:
    """Hand a short paragraph on to the next cell when that lies above or below it in the same lineage."""
    start = F.struct(_nothing().alias("done"), F.lit(None).cast(CELL).alias("held"))

    def step(state: Column, s: Column) -> Column:
        held = state["held"]
        depth = F.least(F.size(held["path"]), F.size(s["path"]))
        kin = (held["path"] != s["path"]) & (F.slice(held["path"], F.lit(1), depth) == F.slice(s["path"], F.lit(1), depth))
        taken = held.isNotNull() & kin & ~s["type"].isin(*RIGID) & (tokens_in(held) + tokens_in(s) <= MAX_CHUNK)
        now = F.when(taken, _cell(s["type"], s["path"], held["words"] + s["words"], held["cjk"] + s["cjk"], F.concat(held["members"], s["members"]))).otherwise(s)
        done = F.when(held.isNotNull() & ~taken, F.concat(state["done"], F.array(held))).otherwise(state["done"])
        waits = (now["type"] == "paragraph") & (tokens_in(now) < MIN_CHUNK)
        return F.struct(F.when(waits, done).otherwise(F.concat(done, F.array(now))).alias("done"), F.when(waits, now).alias("held"))

    return F.aggregate(cells, start, step, lambda state: F.when(state["held"].isNotNull(), F.concat(state["done"], F.array(state["held"]))).otherwise(state["done"]))


PIECE = "struct<run:int,glue:string,text:string,n:int>"


def split_text(text: Column, limit: int = MAX_CHUNK) -> Column:
    """Pieces of a text: itself within the limit, else paragraphs, and sentences of long paragraphs, packed up to the limit.

    Only neighbours of one run are packed: paragraphs between two long ones, or the sentences of one.
    """

    def piece(run: Column, glue: str, x: Column) -> Column:
        return F.struct(run.cast("int").alias("run"), F.lit(glue).alias("glue"), x.alias("text"), tx.token_count(x).alias("n"))

    parts = F.transform(F.split(text, "\n\n", -1), lambda x: F.struct(x.alias("x"), (tx.token_count(x) > limit).alias("long")))

    def pieces(parts: Column) -> Column:
        def cut(p: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: q["long"]))
            sentences = F.filter(F.transform(F.split(p["x"], "(?<=[。！？\n])", -1), tx.strip), lambda y: F.length(y) > 0)
            return F.when(p["long"], F.transform(sentences, lambda y: piece(2 * before + 1, "", y))).otherwise(F.array(piece(2 * before, "\n\n", p["x"])))

        return F.flatten(F.transform(parts, cut))

    def pack(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = last.isNotNull() & (last["run"] == x["run"]) & (last["n"] + x["n"] <= limit)
        both = F.struct(x["run"].alias("run"), x["glue"].alias("glue"), F.concat(last["text"], x["glue"], x["text"]).alias("text"), (last["n"] + x["n"]).alias("n"))
        return F.when(fits, _swap_last(done, both)).otherwise(F.concat(done, F.array(x)))

    packed = F.transform(F.array(F.struct(parts.alias("p"))), lambda x: F.aggregate(pieces(x["p"]), _nothing(PIECE), pack))
    texts = F.filter(F.transform(F.get(packed, F.lit(0)), lambda p: p["text"]), lambda y: ~tx.is_blank(y))
    return F.when(tx.token_count(text) <= limit, F.array(text)).otherwise(texts)


FOLDS = {"merge_small": merge_small, "absorb_orphans": absorb_orphans, "merge_lead_ins": merge_lead_ins}
STEPS = (*FOLDS, "split_large")


def fold_segments(documents: DataFrame, steps: tuple[str, ...] = STEPS, key: str = "doc_id") -> DataFrame:
    """Run the ordered folds on rows that hold a whole document's segments.

    ``documents``: (key, segments ARRAY<STRUCT<type, path ARRAY<STRING>, text>>). Result: (key, segment_index, block_type, path,
    raw_text, token_count). The segments travel inside the document's row, as its text did, so there is no shuffle and
    no group to gather. ``split_large`` can only come last.
    """
    if "split_large" in steps[:-1]:
        raise ValueError("split_large must be the last step")
    rows = documents.select(key, "segments", cells_of(F.col("segments")).alias("cells"))
    for step in steps:
        if step != "split_large":
            rows = rows.withColumn("cells", FOLDS[step](F.col("cells")))
    def row(c: Column, x: Column) -> Column:
        return F.struct(c["type"].alias("block_type"), c["path"].alias("path"), x.alias("raw_text"))

    def joined(c: Column) -> Column:
        return F.array_join(F.transform(c["members"], lambda i: F.get("segments", i)["text"]), "\n\n")

    whole = F.transform("cells", lambda c: row(c, joined(c)))
    if "split_large" in steps:
        whole = F.flatten(F.transform(whole, lambda r: F.transform(split_text(r["raw_text"]), lambda x: F.struct(
            r["block_type"].alias("block_type"), r["path"].alias("path"), x.alias("raw_text")))))
    return rows.select(key, F.posexplode(whole).alias("segment_index", "x")).select(
        key, "segment_index", "x.*", tx.token_count(F.col("x.raw_text")).alias("token_count"))
