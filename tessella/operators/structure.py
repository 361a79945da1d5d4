"""Document structuring: HTML and Markdown rows to typed blocks, headings, sections, paragraphs, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators.markup import page_markdown, read_page

# Heading, caption and table-of-contents patterns.
HEADING = r"^(\d+(?:\.\d+){0,4})[\x{00a0}\s]+(\S.{0,200})$"
TOC_LEADER = r"\.{4,}\s*\d+\s*$"
CAPTION = r"(?i)^(Tabelle|Table|Abbildung|Figure|Bild)\s+\d+(?:\.\d+)?\b"
CN_CHAPTER = r"^第[一二三四五六七八九十百千零\d]+[章部篇]"
CN_SECTION = r"^第[一二三四五六七八九十百千零\d]+[节条款]"
CN_ENUM = r"^[（(][一二三四五六七八九十\d]+[）)]\s*\S"
CN_DASH_ENUM = r"^[一二三四五六七八九十]+[、．.]\s*\S"
CLAUSE = r"^((?:\d+[A-Za-z]?)(?:\.\d+[A-Za-z]?)*)(?:\s+|$)"
CLAUSE_GLUED = r"^((?:\d+[A-Za-z]?)(?:\.\d+[A-Za-z]?)*)([A-Z][A-Za-z].*)$"
CHUNK_TOKENS, CHUNK_OVERLAP = 300, 30
MAX_LEVEL = 6

# --- HTML ----------------------------------------------------------------------------------------

def html_to_markdown(pages: DataFrame, key: str = "page_id", heading_offset: int = 0, image_prefix: str = "") -> DataFrame:
    """Markdown of every page of ``pages(key, title, html)``; a page that fails keeps its error instead.

    Headings are written ``heading_offset`` levels lower; relative images get ``image_prefix`` before their path.
    """
    key_type = pages.schema[key].dataType.simpleString()

    def convert(frames):
        for pdf in frames:
            texts, errors = [], []
            for html, title in zip(pdf["html"], pdf["title"]):
                try:
                    texts.append(page_markdown(html, title, heading_offset, image_prefix))
                    errors.append(None)
                except Exception as e:  # a bad page must not stop the batch
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "markdown": texts, "error": errors})

    return pages.select(key, "title", "html").mapInPandas(convert, f"{key} {key_type}, markdown string, error string")


def row_runs(rows: Iterable[tuple[tuple, int]], most: int = 5000, characters: int = 1 << 21) -> Iterator[list[tuple]]:
    """Rows, given with their number of characters, in runs of at most ``most`` rows that end when they reach ``characters``."""
    out, size = [], 0
    for row, n in rows:
        out.append(row)
        size += n
        if len(out) >= most or size >= characters:
            yield out
            out, size = [], 0
    if out:
        yield out


def html_table_cells(tables: DataFrame, key: str) -> DataFrame:
    """Cells of all tables of each row of ``tables(key, html)`` after expanding spans.

    Output: (key, table_index, row_index, col_index, column, value, error), the header row giving the column names.
    A row that cannot be read gives one line with nothing but its key and error.
    """
    key_type = tables.schema[key].dataType.simpleString()

    def cells(k, html):
        for t, (grid, header, _) in enumerate(read_page(html, grids_only=True).grids):
            names = grid[0] if header else [f"col{i}" for i in range(len(grid[0]) if grid else 0)]
            for r, row in enumerate(grid[1:] if header else grid):
                yield from ((k, t, r, c, names[c], v, None) for c, v in enumerate(row))

    def convert(frames):
        for pdf in frames:
            out = []
            for k, html in zip(pdf[key], pdf["html"]):
                try:
                    out.extend(list(cells(k, html)))
                except Exception as e:  # a bad table must not stop the batch
                    out.append((k, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=[key, "table_index", "row_index", "col_index", "column", "value", "error"])
            yield frame.astype({c: "Int32" for c in ("table_index", "row_index", "col_index")})

    return tables.select(key, "html").mapInPandas(
        convert, f"{key} {key_type}, table_index int, row_index int, col_index int, column string, value string, error string")


# --- Markdown --------------------------------------------------------------------------------------

_MD_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*(\S*)")
_MD_ITEM = re.compile(r"( *)(?:[-*+]|(\d{1,9})[.)])[ \t]+(.*)")
_MD_RULE = re.compile(r" {0,3}(?:[-*_][ \t]*){3,}$")
_MD_DELIM = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_MD_HTML = re.compile(r" {0,3}</?[A-Za-z!][^>]*>?")


def _cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|").removesuffix("|")
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def markdown_blocks(text: str) -> list[tuple]:
    """(type, text, level, line_start, line_end, language) of each block, line_end exclusive."""
    lines = text.split("\n")
    out, i, n = [], 0, len(lines)

    def starts_block(j: int) -> bool:
        s = lines[j]
        return bool(_MD_HEADING.match(s) or _MD_FENCE.match(s) or _MD_RULE.match(s) or s.lstrip().startswith(">")
                    or _MD_ITEM.match(s) or _MD_HTML.match(s))

    while i < n:
        s, j = lines[i], i + 1
        if not s.strip() or _MD_RULE.match(s):
            i = j
            continue
        if m := _MD_HEADING.match(s):
            out.append(("heading", (m[2] or "").strip(), len(m[1]), i, j, None))
        elif m := _MD_FENCE.match(s):
            while j < n and not lines[j].strip().startswith(m[1]):
                j += 1
            out.append(("code", "\n".join(lines[i + 1:j]) + "\n", None, i, min(j + 1, n), m[2]))
            j = min(j + 1, n)
        elif "|" in s and j < n and "|" in lines[j] + s and _MD_DELIM.match(lines[j]) and "-" in lines[j]:
            head = _cells(s)
            j += 1
            rows = [head]
            while j < n and lines[j].strip() and "|" in lines[j]:
                row = _cells(lines[j])
                rows.append((row + [""] * len(head))[: len(head)])
                j += 1
            out.append(("table", "\n".join(" | ".join(r) for r in rows), None, i, j, None))
        elif s.lstrip().startswith(">"):
            while j < n and lines[j].lstrip().startswith(">"):
                j += 1
            out.append(("blockquote", " ".join(x.lstrip().lstrip(">").strip() for x in lines[i:j]).strip(), None, i, j, None))
        elif m := _MD_ITEM.match(s):
            ordered, number, items = m[2] is not None, 0, []
            indents = [len(m[1])]
            j = i
            while j < n and lines[j].strip() and (j == i or _MD_ITEM.match(lines[j]) or not starts_block(j)):
                if k := _MD_ITEM.match(lines[j]):
                    while len(indents) > 1 and len(k[1]) < indents[-1]:
                        indents.pop()
                    if len(k[1]) >= indents[-1] + 2:
                        indents.append(len(k[1]))
                    items.append([len(indents), k[3].strip()])
                else:
                    items[-1][1] += "\n" + lines[j].strip()
                j += 1
            shown = []
            for depth, item in items:
                number += ordered and depth == 1
                shown.append("  " * (depth - 1) + (f"{number}. " if ordered and depth == 1 else "- ") + item)
            out.append(("list", "\n".join(shown), None, i, j, None))
        elif _MD_HTML.match(s):
            while j < n and lines[j].strip():
                j += 1
            body = "\n".join(lines[i:j]).strip()
            out.append(("html_table" if "<table" in body.lower() else "raw_html", body, None, i, j, None))
        else:
            while j < n and lines[j].strip() and not starts_block(j):
                j += 1
            out.append(("paragraph", "\n".join(x.strip() for x in lines[i:j]), None, i, j, None))
        i = j
    return out


def parse_markdown(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Typed blocks of every document of ``documents(key, text)``; one row is parsed at a time."""
    key_type = documents.schema[key].dataType.simpleString()

    def parsed(frames):
        for pdf in frames:
            for k, t in zip(pdf[key], pdf["text"]):
                for i, b in enumerate(markdown_blocks(t or "")):
                    yield (k, i, *b), len(b[1] or "")

    def parse(frames):
        for out in row_runs(parsed(frames)):
            yield pd.DataFrame(out, columns=[key, "block_index", "block_type", "text", "level", "line_start", "line_end", "language"]).astype(
                {"level": "Int32"})

    return documents.select(key, "text").mapInPandas(
        parse, f"{key} {key_type}, block_index int, block_type string, text string, level int, line_start int, "
               "line_end int, language string")


# --- sections, paragraphs, chunks ------------------------------------------------------------------


def section_paths(blocks: DataFrame, key: str = "doc_id", order: str = "block_index") -> DataFrame:
    """Adds ``section_path``: the open headings above each block, outermost first.

    A heading closes every heading of the same or a deeper level. Per level the last heading is kept by
    one running window over the document; it is open while no shallower heading came after it.
    """
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    title = F.struct(F.col(order).alias("at"), F.col("title").alias("title"), F.col("level").alias("level"))
    last = [F.last(F.when(F.col("level") == n, title), ignorenulls=True).over(w).alias(f"_h{n}") for n in range(1, MAX_LEVEL + 1)]
    b = blocks.select("*", *last)
    open_ = []
    for n in range(1, MAX_LEVEL + 1):
        above = [F.coalesce(F.col(f"_h{m}.at"), F.lit(-1)) for m in range(1, n)]
        alive = F.col(f"_h{n}.at") > F.greatest(*above, F.lit(-1)) if above else F.col(f"_h{n}.at").isNotNull()
        open_.append(F.when(alive, F.struct(F.col(f"_h{n}.title").alias("title"), F.col(f"_h{n}.level").alias("level"))))
    path = F.filter(F.array(*open_), lambda x: x.isNotNull())
    return b.withColumn("section_path", path).drop(*[f"_h{n}" for n in range(1, MAX_LEVEL + 1)])


def paragraphs(documents: DataFrame) -> DataFrame:
    """Blank-line separated paragraphs with first line and end line, cut inside the row."""
    numbered = F.transform(tx.lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), x.alias("x"), tx.is_blank(x).alias("blank")))
    empty = F.array().cast("array<struct<start:int,stop:int,text:string>>")

    def step(acc, s):
        grow = F.struct(
            F.when(acc["open"], acc["cur"]["start"]).otherwise(s["i"]).alias("start"), (s["i"] + 1).alias("stop"),
            F.when(acc["open"], F.concat(acc["cur"]["text"], F.lit("\n"), s["x"])).otherwise(s["x"]).alias("text"))
        closed = F.when(s["blank"] & acc["open"], F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        return F.struct(closed.alias("out"), F.when(s["blank"], acc["cur"]).otherwise(grow).alias("cur"), (~s["blank"]).alias("open"))

    zero = F.struct(empty.alias("out"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("text")).alias("cur"),
                    F.lit(False).alias("open"))
    found = F.aggregate(numbered, zero, step, lambda a: F.when(a["open"], F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))
    return documents.select("doc_id", F.posexplode(found).alias("paragraph_index", "p")).select(
        "doc_id", "paragraph_index", F.col("p.start").alias("line_start"), F.col("p.stop").alias("line_end"), F.col("p.text").alias("text"))


def token_chunks(texts: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks of ``texts(id, text)`` cut at token starts; short texts stay whole.

    The text is cut once into pieces that each begin with a token; a chunk is a run of pieces, so the
    work is linear in the text.
    """
    token = f"(?:{tx.CJK}|{tx.WORD})"
    pieces = F.regexp_extract_all("text", F.lit(f"(?s){token}(?:(?!{token}).)*"), F.lit(0))
    step = size - overlap
    p = texts.select("id", "text", pieces.alias("p")).withColumn("n", F.size("p"))
    starts = F.when(F.col("n") <= size, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.ceil((F.col("n") - size) / step).cast("int")), lambda i: i * step))
    c = p.select("id", "text", "p", "n", F.posexplode(starts).alias("chunk_index", "start"))
    body = F.when(F.col("n") <= size, F.col("text")).otherwise(
        tx.strip(F.array_join(F.slice("p", F.col("start") + 1, F.lit(size)), "")))
    return c.select("id", "chunk_index", body.alias("chunk"), F.least(F.lit(size), F.col("n") - F.col("start")).alias("n_tokens"))


def digit_shape(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "N")


def repeated_lines(lines: DataFrame, group: str, page: str) -> DataFrame:
    """Line shapes (digits folded) seen on at least max(3, half of the group's pages).

    ``lines``: (group, page, text). Counting is a plain aggregate, so a group of any size is fine.
    """
    pages = lines.groupBy(group).agg(F.count_distinct(page).alias("pages"))
    shapes = lines.groupBy(group, digit_shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(3), F.floor(F.col("pages") / 2))
    return shapes.join(pages, group).filter((F.col("pages") >= 3) & (F.col("n") >= need)).select(group, "shape", "n")


def drop_headers_footers(lines: DataFrame, group: str, page: str) -> DataFrame:
    """Remove repeated line shapes near the top (15 %) or bottom (12 %) of their page.

    ``lines``: (group, page, position from the top as a share of the page height, text).
    """
    rep = repeated_lines(lines, group, page).select(group, "shape").withColumn("repeated", F.lit(True))
    edge = (F.col("position") < 0.15) | (F.col("position") > 0.88)
    j = lines.withColumn("shape", digit_shape(F.col("text"))).join(rep, [group, "shape"], "left")
    return j.filter(F.col("repeated").isNull() | ~edge).drop("shape", "repeated")


def classify_headings(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Heading, table caption or paragraph by the block's first line and font size.

    ``blocks``: (key, block_index, text, font_size). The body size is the document's most frequent size;
    sizes are ranked per document for level by size. Table-of-contents lines are dropped.
    """
    sizes = blocks.filter("font_size > 0").groupBy(key, "font_size").agg(F.count("*").alias("n"))
    body = sizes.groupBy(key).agg(F.max_by("font_size", F.struct("n", "font_size")).alias("body_size"))
    ladder = sizes.groupBy(key).agg(F.sort_array(F.collect_set("font_size"), asc=False).alias("ladder"))
    first = tx.strip(F.split_part("text", F.lit("\n"), F.lit(1)))
    b = blocks.withColumn("first_line", first).filter(~F.col("first_line").rlike(TOC_LEADER))
    b = b.join(body, key, "left").join(ladder, key, "left")
    # Level by size: place of the first size of the document within half a point.
    near = F.array_position(F.transform("ladder", lambda s: F.abs(s - F.col("font_size")) < 0.5), True)
    b = b.withColumn("size_rank", near)
    line, size = F.col("first_line"), F.col("font_size")
    body_size = F.coalesce("body_size", F.lit(10.0))
    short, font_ok = F.length("text") <= 400, size + 0.1 >= body_size
    cn = (F.when(line.rlike(CN_CHAPTER), 1).when(line.rlike(CN_SECTION), 2)
          .when(line.rlike(CN_ENUM) | line.rlike(CN_DASH_ENUM), 3))
    number, title = F.regexp_extract(line, HEADING, 1), tx.strip(F.regexp_extract(line, HEADING, 2))
    depth = F.size(F.split(number, r"\."))
    numeric = line.rlike(HEADING) & ~F.contains(title, F.lit("....")) & (F.length(line) <= 200) & short & font_ok
    by_size = (size > body_size * 1.2) & (F.length(line) < 200) & short
    is_cn = cn.isNotNull() & short & font_ok
    level = F.when(is_cn, cn).when(numeric, depth).when(by_size, F.least(F.col("size_rank"), F.lit(MAX_LEVEL)))
    kind = F.when(level.isNotNull(), "heading").when(line.rlike(CAPTION), "table").otherwise("paragraph")
    shown = F.when(is_cn, line).when(numeric, F.concat_ws(" ", number, title)).when(by_size, line).otherwise(F.col("text"))
    return b.select(key, "block_index", kind.alias("block_type"), level.cast("int").alias("level"), shown.alias("text"))


def drop_toc_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("text").rlike(TOC_LEADER))


def heading_spacing(text: Column) -> Column:
    """Insert the missing blank in headings such as ``4.2.1General``."""
    return F.regexp_replace(tx.strip(F.regexp_replace(text, r"\s+", " ")), CLAUSE_GLUED, "$1 $2")


def clause_number(text: Column) -> Column:
    """Leading clause number, NULL when there is none; a lone number must be all digits."""
    c = F.regexp_extract(text, CLAUSE, 1)
    return F.when((c != "") & (F.contains(c, F.lit(".")) | c.rlike(r"^\d+$")), c)


def clause_level(text: Column) -> Column:
    parts = F.size(F.split(clause_number(text), r"\."))
    return F.when(clause_number(text).isNotNull() & (parts <= MAX_LEVEL), parts)


def assemble_sections(blocks: DataFrame, key: str = "doc_id", order: str = "block_index") -> DataFrame:
    """One row per section: its heading, and how many blocks and characters it holds.

    ``blocks`` carries ``is_heading``. Text before the first heading belongs to section 0.
    """
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.sum(F.col("is_heading").cast("int")).over(w)
    b = blocks.withColumn("section_index", n)
    own = ~F.col("is_heading")
    return b.groupBy(key, "section_index").agg(
        F.max(F.when(F.col("is_heading"), F.col("text"))).alias("title"),
        F.count_if(own).alias("block_count"), F.coalesce(F.sum(F.when(own, F.length("text"))), F.lit(0)).alias("char_count"))


def parse_skip_reason(preprocess_error: Column, parse_error: Column, file_type: Column, content: Column) -> Column:
    """Why a document gave no section tree; the order of the reasons matters."""
    # File types with a parser, and the type whose content is read from the file.
    parsable, from_file = ("markdown", "txt", "pdf", "docx"), "docx"
    return (
        F.when(F.length(preprocess_error) > 0, "preprocess_failed")
        .when(F.length(parse_error) > 0, "parser_failed")
        .when(~file_type.isin(*parsable), "unsupported_type")
        .when((file_type != from_file) & ~F.coalesce(content, F.lit("")).rlike(r"\S"), "empty_file")
        .otherwise("parse_no_tree"))
