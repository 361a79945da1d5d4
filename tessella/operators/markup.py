"""HTML pages to Markdown and tables to grids, as events come: open elements are a stack, nothing else of a page is kept.

An open element collects what its closed children left: a piece of Markdown each, and what lists, rows and tables need of
them. When it closes, it leaves one piece itself. The page's own division (or its body) hands its text over as it closes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple

#: Elements without text, without end, that end a paragraph, and the divisions that hold a page's article.
SILENT = frozenset("script style head noscript title meta link".split())
ENDLESS = frozenset("br hr img meta link input col area base source wbr embed param track".split())
BLOCKS = frozenset("p table div ul ol pre hr blockquote h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("articleBoxWithoutHead", "articleBox", "topicBody"))
#: What closes an element that its author left open.
CLOSERS = {"p": BLOCKS, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Elements whose text a table's grid holds.
TELLING = frozenset(("td", "th", "caption"))
LEVELS = 6
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Cell(NamedTuple):
    text: str
    wide: int
    tall: int


class Grid(NamedTuple):
    """Lines of a table with spans filled in, whether the first names the columns, and the caption."""

    lines: list[list[str]]
    header: bool
    caption: str


class Piece(NamedTuple):
    """What a closed element leaves: its tag ('' for plain text), its Markdown, and its parts if it is part of a list or table."""

    tag: str
    text: str
    parts: object = None


class Open:
    """An element that is not closed yet."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.pieces: list[Piece] = []
        self.caption: str | None = None
        #: Number of a table on its page.
        self.place = 0

    def text(self) -> str:
        return "".join(p.text for p in self.pieces)

    def line(self) -> str:
        return " ".join(self.text().split())

    def span(self, name: str, most: int) -> int:
        value = self.attrs.get(name)
        if not value:
            return 1
        return min(most, max(1, int(value))) if value.isdecimal() else 1


def filled(rows: list[list[Cell]]) -> list[list[str]]:
    """Every place of a table: a cell stands in all columns and rows it spans, and rows go on as long as one hangs down."""
    lines: list[dict[int, str]] = []
    hanging: dict[int, tuple[str, int]] = {}
    at = 0
    while at < len(rows) or hanging:
        line = {c: text for c, (text, _) in hanging.items()}
        after = {c: (text, n - 1) for c, (text, n) in hanging.items() if n > 1}
        column = 0
        for cell in rows[at] if at < len(rows) else []:
            while column in line:
                column += 1
            for c in range(column, column + cell.wide):
                line[c] = cell.text
                if cell.tall > 1:
                    after[c] = cell.text, cell.tall - 1
            column += cell.wide
        lines.append(line)
        hanging, at = after, at + 1
    width = max((max(line, default=-1) for line in lines), default=-1) + 1
    return [[line.get(c, "") for c in range(width)] for line in lines] if width else []


def _grid(e: Open) -> Grid:
    rows = [row for p in e.pieces if p.tag in ("thead", "tbody", "tfoot", "tr") for row in ([p.parts] if p.tag == "tr" else p.parts)]
    rows = [(head, cells) for head, cells in rows if cells]
    lines = filled([cells for _, cells in rows])
    return Grid(lines, bool(lines) and rows[0][0], e.caption or "")


def _section(e: Open) -> list[tuple[bool, list[Cell]]]:
    rows = []
    for p in e.pieces:
        if p.tag == "tr":
            rows.append((e.tag == "thead" or p.parts[0], p.parts[1]))
        elif p.tag in ("thead", "tbody", "tfoot"):
            rows += p.parts
    return rows


def _pipes(grid: Grid) -> str:
    if not grid.lines:
        return ""
    head, body = (grid.lines[0], grid.lines[1:]) if grid.header else ([""] * len(grid.lines[0]), grid.lines)
    rows = ["| " + " | ".join(line) + " |" for line in (head, ["---"] * len(head), *body)]
    return "\n".join(["\n", *([grid.caption + "\n"] if grid.caption else []), *rows, "\n"])


def _item(e: Open) -> list[Piece]:
    """Runs of inline text and the blocks between them, empty ones left out."""
    out, run = [], ""
    for p in [*e.pieces, None]:
        if p is not None and p.tag not in BLOCKS:
            run += p.text
            continue
        if run.strip():
            out.append(Piece("", " ".join(run.split())))
        run = ""
        if p is not None and p.text.strip():
            out.append(p)
    return out


def _bullets(e: Open) -> str:
    out = "\n"
    for n, item in enumerate((p for p in e.pieces if p.tag == "li"), 1):
        parts = list(item.parts)
        if parts:
            lead = parts.pop(0).text if not parts[0].tag else ""
            out += (f"{n}. " if e.tag == "ol" else "- ") + lead + "\n" + "".join(p.text if p.tag else f"\n{p.text}\n" for p in parts)
    return out + "\n"


def _code(e: Open) -> str:
    text = e.text()
    return f"\n\n```\n{text.strip()}\n```\n\n" if "\n" in text else f"`{text}`" if text else ""


def _pre(e: Open) -> str:
    text = e.text().strip("\n")
    return f"\n\n{text}\n\n" if text.startswith("```") else f"\n\n```\n{text}\n```\n\n"


def _around(before: str, after: str) -> Callable[[Open], str]:
    """The element's text on one line between two marks; nothing if there is none."""
    return lambda e: before + e.line() + after if e.line() else ""


WRITE: dict[str, Callable[[Open], str]] = {
    **dict.fromkeys(SILENT | {"li"}, lambda e: ""), **dict.fromkeys(("strong", "b"), _around("**", "**")), **dict.fromkeys(("em", "i"), _around("*", "*")),
    "p": _around("\n\n", "\n\n"), "br": lambda e: "  \n", "hr": lambda e: "\n\n---\n\n", "code": _code, "pre": _pre, "ul": _bullets, "ol": _bullets,
}
PARTS: dict[str, Callable[[Open], object]] = {
    "li": _item, **dict.fromkeys(("thead", "tbody", "tfoot"), _section),
    **dict.fromkeys(("td", "th"), lambda e: Cell(e.line().replace("|", "\\|"), e.span("colspan", MOST_COLUMNS), e.span("rowspan", MOST_ROWS))),
    "tr": lambda e: (any(p.tag == "th" for p in e.pieces), [p.parts for p in e.pieces if p.tag in ("td", "th")]),
}


class Writer(HTMLParser):
    """Feed a page, then read ``markdown()`` or ``grids``, the tables in the order in which they open."""

    def __init__(self, heading_offset: int = 0, image_prefix: str = "", grids_only: bool = False):
        super().__init__(convert_charrefs=True)
        self.grids_only = grids_only
        #: Open cells and captions.
        self.telling = 0
        self.lower = heading_offset
        self.prefix = image_prefix if not image_prefix or image_prefix.endswith("/") else image_prefix + "/"
        self.stack = [Open("", {})]
        self.article: Open | str | None = None
        self.body: Open | str | None = None
        self.grids: list[Grid | None] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while tag in CLOSERS.get(self.stack[-1].tag, ()):
            self._close()
        self._open(tag, attrs)
        if tag in ENDLESS:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._open(tag, attrs)
        self._close()

    def _open(self, tag: str, attrs: list) -> None:
        e = Open(tag, {k: v or "" for k, v in attrs})
        self.stack.append(e)
        self.telling += tag in TELLING
        if tag == "table":
            e.place = len(self.grids)
            self.grids.append(None)
        if tag == "body" and self.body is None:
            self.body = e
        if e.attrs and tag == "div" and self.article is None and ARTICLES & set(e.attrs.get("class", "").split()):
            self.article = e

    def handle_endtag(self, tag: str) -> None:
        if len(self.stack) > 1 and self.stack[-1].tag == tag:
            self._close()
        elif any(e.tag == tag for e in self.stack[1:]):
            while self.stack[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        self.stack[-1].pieces.append(Piece("", data))

    def close(self) -> None:
        super().close()
        while len(self.stack) > 1:
            self._close()

    def _close(self) -> None:
        e = self.stack.pop()
        self.telling -= e.tag in TELLING
        above = self.stack[-1]
        if e.tag == "caption" and e.caption is None:
            e.caption = e.line()
        if above.caption is None:
            above.caption = e.caption
        if e is self.article:
            self.article = e.text()
        if e is self.body:
            self.body = e.text()
        parts = PARTS[e.tag](e) if e.tag in PARTS else None
        if e.tag == "table":
            parts = self.grids[e.place] = _grid(e)
        silent = self.grids_only and not self.telling
        above.pieces.append(Piece(e.tag, "" if silent else self._text(e, parts), parts))

    def _text(self, e: Open, parts: object) -> str:
        if e.tag == "table":
            return _pipes(parts)
        if e.tag == "img":
            return self._image(e.attrs.get("src", "").strip(), e.attrs.get("alt", "").strip())
        if re.fullmatch("h[1-6]", e.tag):
            return _around("\n\n" + "#" * max(1, min(LEVELS, int(e.tag[1]) + self.lower)) + " ", "\n\n")(e)
        return WRITE.get(e.tag, Open.text)(e)

    def _image(self, src: str, alt: str) -> str:
        near = src and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:|/|#", src)
        return f"![{alt}]({self.prefix if near else ''}{src})" if src else ""

    def markdown(self) -> str:
        text = next((t for t in (self.article, self.body) if t is not None), None)
        text = self.stack[0].text() if text is None else text
        return re.sub(r"\n{3,}", "\n\n", text).replace("****", "").strip()


#: Text and tags of a page that is plain: quoted attributes with values, no references, comments or declarations.
_PLAIN = re.compile(r"""([^<&]+)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][A-Za-z-]*=(?:"[^"<>&]*"|'[^'<>&]*'))*)[ \t\n]*>""")
_ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z-]*)=(?:"([^"]*)"|'([^']*)')""")
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())


def plain_tokens(html: str) -> list[tuple[str, str, str, str]] | None:
    """(text, "/" of an end, tag, attributes) of a plain page in order; None if any part of it is not plain."""
    tokens = _PLAIN.findall(html)
    read = 0
    for text, end, tag, attrs in tokens:
        read += len(text) or len(end) + len(tag) + len(attrs) + 2
    if read != len(html):
        return None
    return None if any(t[1] and t[3] for t in tokens) or not _RAW.isdisjoint({t[2].lower() for t in tokens}) else tokens


def read_page(html: str | None, heading_offset: int = 0, image_prefix: str = "", grids_only: bool = False) -> Writer:
    """A page read to its end. Plain pages are cut by one expression; others, and all they may hold, go through the parser.

    With ``grids_only`` no text is written that no table needs.
    """
    writer = Writer(heading_offset, image_prefix, grids_only)
    tokens = plain_tokens(html or "")
    if tokens is None:
        writer.feed(html or "")
    else:
        for text, end, tag, attrs in tokens:
            if text:
                writer.handle_data(text)
            elif end:
                writer.handle_endtag(tag.lower())
            else:
                writer.handle_starttag(tag.lower(), [(k.lower(), v or w) for k, v, w in _ATTRIBUTE.findall(attrs)] if attrs else [])
    writer.close()
    return writer


def page_markdown(html: str | None, title: str | None, heading_offset: int = 0, image_prefix: str = "") -> str:
    """A page under its title; headings are ``heading_offset`` levels lower, relative images lie under ``image_prefix``."""
    return f"# {title}\n\n{read_page(html, heading_offset, image_prefix).markdown()}\n"
