"""Column expressions over text: tokens, counts, hashes, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The CJK range counted as one token per character, and the word class.
CJK = r"[\x{4e00}-\x{9fff}]"
WORD = r"[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; every CJK character is a token of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{CJK}|{WORD}"), F.lit(0))


def token_count(text: Column) -> Column:
    """Words plus 1.5 per CJK character, rounded half to even."""
    words = F.regexp_count(text, F.lit(WORD))
    cjk = F.regexp_count(text, F.lit(CJK))
    return (words + F.bround(cjk * F.lit(1.5))).cast("int")


def strip(text: Column) -> Column:
    """Trim white space of any kind on both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def snapshot_text(text: Column) -> Column:
    """LF line ends, right-trimmed lines, blank lines dropped."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    kept = F.filter(F.split(lf, "\n", -1), lambda x: x.rlike(r"\S"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")


def snapshot_hash(text: Column) -> Column:
    return F.sha2(snapshot_text(text), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized_hash(text: Column) -> Column:
    return F.sha2(strip(F.lower(text)), 256)


def clean_markup(text: Column) -> Column:
    """Remove bold marks, ``<br>``, images and link targets; squeeze blank lines."""
    # The markup patterns and their replacements.
    steps = (
        (r"\*\*(.+?)\*\*", "$1"),
        (r"(?i)<br\s*/?>", "\n"),
        (r"!\[.*?\]\([^)]*\)", ""),
        (r"!\[.*?\]\[.*?\]", ""),
        (r"\[([^\]]*)\]\((?:[^()]+|\([^()]*\))*\)", "$1"),
        (r"\n{3,}", "\n\n"),
    )
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams, cut in one regex pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle`` in ``text``."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("int")).otherwise(F.lit(0))


def window_around(text: Column, needle: Column, before: int, after: int, mark: str) -> Column:
    """Text around the first hit of ``needle`` with a mark at each cut end; '' without a hit."""
    pos = F.instr(text, needle) - 1
    start = F.greatest(F.lit(0), pos - before)
    end = F.least(F.length(text), pos + F.length(needle) + after)
    body = strip(F.substring(text, start + 1, end - start))
    marked = F.concat(
        F.when(start > 0, F.lit(mark)).otherwise(F.lit("")),
        body,
        F.when(end < F.length(text), F.lit(mark)).otherwise(F.lit("")),
    )
    return F.when(pos >= 0, marked).otherwise(F.lit(""))
