"""Personal data: detected entities get keyed surrogates of the same type, format, script and gender.

An entity is known by its type and normal form (digits of a number, lower case of an address, a name's parts), so its
mentions in any spelling and document get one surrogate. Names are detected after a title (TITLES), each part of two letters or more; the parts of such
a name are then found in the rest of its document too, as capitalised whole words without a title. A name that carries no
title anywhere in its document is not detected. Surrogates are drawn from a keyed hash and follow the form: digits
for digits, letters for letters, check digits that hold where they held, names of the gender and script of the name. A
draw is checked against all entities of its type and all surrogates given so far; the few that collide draw again, so
different entities stay different and no surrogate is a real entity of the corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import settle, table

#: A key for tests and the query; callers pass their own.
DEMO_KEY = "surrogates"
#: Words before a name and the gender they tell.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f",
          "Mademoiselle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Doña": "f", "Dr": "u", "Prof": "u", "Professor": "u", "господин": "m", "госпожа": "f"}
#: Syllables of made names: (starts, middles, male ends, female ends, surname ends).
SYLLABLES = {
    "latin": ("Al Be Ca Do El Fa Ge Ha Ir Jo Ka Le Ma No Ol Pe Ro Sa Te Vi".split(), "ra le mi no ri sa ti lo va de".split(),
              "n r s ld rt ck".split(), "a ia ina ette elle ara".split(), "man sen ter ley son berg".split()),
    "cyrillic": ("Ан Бо Ва Га Да Ев Ко Ле Ми Ни Ол Па Ро Се Та Фё".split(), "ра ле ми но ри са ти ло ва де".split(),
                 "н р с ил ей ан".split(), "а ия ина ана елла ара".split(), "ов ев ин енко ский".split()),
    "han": ("王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 林".split(), "文 志 建 明 国 海 春 晓 云 天".split(), "强 军 伟 勇 刚 杰".split(), "丽 芳 静 娟 敏 艳".split(), "".split()),
}
_TITLE = "|".join(sorted(TITLES, key=lambda t: (-len(t), t)))
_NAME = r"[^\W\d_][^\W\d_'’-]+"
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))"
    r"|(?P<key>(?<!\w)AKIA[0-9A-Z]{16}(?!\w))"
    r"|(?P<secret>(?<!\w)(?=[a-f]*[0-9])(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?!\w))"
    rf"|(?P<name>(?<!\w)(?P<title>{_TITLE})(?:\. ?| )(?P<first>{_NAME})(?: (?P<last>{_NAME}))?)")
#: A quick look at whether a text can hold an entity at all, in the JVM. Python's digits may be unassigned in an older JVM's Unicode.
MAY_HOLD = r"[\p{{Nd}}\p{{Cn}}@]|AKIA|[{}](?:{})[. ]|{}".format(
    "".join(sorted({t[0] for t in TITLES if t[0].isascii()})), "|".join(sorted({t[1:] for t in TITLES if t[0].isascii()})), "|".join(t for t in TITLES if not t[0].isascii()))


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "han" if name.startswith("CJK") else "latin"


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _bare_names(text: str, found: list[tuple[int, int, str, str]], parts: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """Mentions of detected name parts outside of ``found``: capitalised whole words, hyphens and apostrophes end one."""
    ends = [0, *(e[1] for e in found)]
    rest = "\n".join(text[a:b] for a, b in zip(ends, [*(e[0] for e in found), len(text)])).casefold()
    if not any(p in rest for p in parts):
        return []
    out, k = [], 0
    for m in _WORD.finditer(text):
        a, b, word = *m.span(), m.group()
        kind = parts.get(word.casefold())
        if kind is None or not (word[0].isupper() or _script(word) == "han"):
            continue
        while k < len(found) and found[k][1] <= a:
            k += 1
        if k == len(found) or found[k][0] >= b:
            out.append((a, b, kind, word.casefold()))
    return out


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of all entities, from left to right, none overlapping. Names give one per part.

    A part detected after titles as of several types has the first of them where it stands alone.
    """
    out, parts = [], {}

    def name(a: int, kind: str, word: str) -> None:
        parts.setdefault(word.casefold(), kind)
        out.append((a, a + len(word), kind, word.casefold()))

    for m in PATTERN.finditer(text):
        kind, own = m.lastgroup, m.group()
        if kind in ("title", "first", "last") or m.group("name"):
            gender, first, last = TITLES[m.group("title")], m.group("first"), m.group("last")
            if not first[0].isupper() and _script(first) != "han":
                continue
            if last and (last[0].isupper() or _script(last) == "han"):
                name(m.start("first"), f"given_{gender}_{_script(first)}", first)
                name(m.start("last"), f"surname_{_script(last)}", last)
            else:
                name(m.start("first"), f"surname_{_script(first)}", first)
        elif kind == "email":
            out.append((*m.span(), kind, own.lower()))
        elif kind in ("phone", "card", "ssn"):
            n = len(_digits(own))
            if kind != "phone" or 9 <= n <= 15:
                out.append((*m.span(), kind, ("+" if own[0] == "+" else "") + _digits(own)))
        elif kind == "iban":
            out.append((*m.span(), kind, own.replace(" ", "")))
        else:
            out.append((*m.span(), kind, own))
    return sorted(out + _bare_names(text, out, parts)) if parts else out


class _Draw:
    """Numbers from a keyed hash of a type, a normal form and the number of the draw."""

    def __init__(self, key: str, kind: str, norm: str, attempt: int):
        self.seed, self.block, self.have = f"{kind}|{attempt}|{norm}".encode(), 0, b""
        self.key = key.encode()

    def below(self, n: int) -> int:
        if len(self.have) < 4:
            self.have += hmac.new(self.key, self.seed + b"|%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.have = int.from_bytes(self.have[:4], "big"), self.have[4:]
        return value % n

    def like(self, text: str) -> str:
        """Digits for digits and letters for letters, in their case; all else stays."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z" else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text)


def surrogate(key: str, kind: str, norm: str, attempt: int = 0) -> str:
    """The attempt-th surrogate of a normal form: of the same length and classes of characters, but for names."""
    draw = _Draw(key, kind, norm, attempt)
    if kind == "email":
        local, _, host = norm.partition("@")
        labels = host.split(".")
        # A host has one surrogate, so that addresses of one host stay together.
        return draw.like(local) + "@" + ".".join([*(_Draw(key, "host", host, 0).like(x) for x in labels[:1]), *labels[1:]])
    if kind == "ip":
        return ".".join(str(10 ** (len(p) - 1) + draw.below((9, 90, 155)[len(p) - 1]) if len(p) > 1 else 1 + draw.below(9)) for p in norm.split("."))
    if kind == "phone":
        head = 2 if norm[0] == "+" else 0
        rest = "".join(str(draw.below(10)) for _ in norm[head:])
        return norm[:head] + (str(2 + int(rest[0]) % 8) + rest[1:] if rest else "")
    if kind == "ssn":
        return f"{1 + draw.below(899):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "card":
        body = norm[0] + "".join(str(draw.below(10)) for _ in norm[1:-1])
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if luhn(norm) else str((int(last) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = draw.like(norm[4:])
        value = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00"))
        return f"{norm[:2]}{98 - value % 97:02d}{body}"
    if kind == "key":
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return norm[:4] + "".join(letters[draw.below(36)] for _ in norm[4:])
    if kind == "secret":
        return "".join("0123456789abcdef"[draw.below(16)] for _ in norm)
    what, *gender, script = kind.split("_")
    starts, middles, male, female, ends = SYLLABLES[script]
    pick = lambda pool: pool[draw.below(len(pool))]
    # Later draws are longer, so there is always a free name.
    inner = "".join(pick(middles) for _ in range(1 + attempt // 2))
    if what == "surname":
        return (pick(starts) + inner + (pick(ends) if ends else "")).casefold()
    end = {"m": male, "f": female}.get(gender[0]) or male + female
    return ((inner if script == "han" else pick(starts) + inner) + pick(end)).casefold()


def render(kind: str, mention: str, value: str) -> str:
    """A surrogate's normal form in the spelling of a mention."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(_digits(value))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        letters = iter(value)
        return "".join(c if c == " " else next(letters) for c in mention)
    if kind == "email":
        return "".join(v.upper() if m.isupper() else v for m, v in zip(mention, value)) if len(mention) == len(value) else value
    if kind.startswith(("given", "surname")):
        return value.upper() if mention.isupper() and len(mention) > 1 else value[:1].upper() + value[1:]
    return value


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, value) for distinct entities (kind, norm); values of a kind differ from each other and from all norms.

    Each round draws for the entities without a value. A draw counts if no entity of the kind and no earlier value is
    equal; among equal draws the smallest entity keeps it. The rounds end when none is left, after few: a draw collides
    with the share of its form's space that is taken. Where a form has too few members (an IPv4 space that is full), draws
    go on until the round limit and then an error is raised.
    """

    def drawing(attempt: int):
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [surrogate(key, k, n, attempt) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], ["kind", "norm", "value"])
        return draw

    schema = "kind string, norm string, value string"
    taken = entities.select("kind", F.col("norm").alias("value"))
    left, given = entities.select("kind", "norm"), None
    for attempt in range(64):
        drawn = left.mapInArrow(drawing(attempt), schema)
        free = drawn.join(taken, ["kind", "value"], "left_anti")
        winners = settle(free.groupBy("kind", "value").agg(F.min("norm").alias("norm")).select("kind", "norm", "value"))
        given = winners if given is None else given.unionByName(winners)
        left = settle(left.join(winners, ["kind", "norm"], "left_anti"))
        if left.isEmpty():
            return given
        taken = taken.unionByName(winners.select("kind", "value"))
    raise ValueError("some entities found no free surrogate")


def replace_entities(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """``docs`` with surrogates in place of personal data; adds n_entities and spans (start, end, kind, surrogate).

    All columns stay; n_chars, where it exists, is left as it was. Needs doc_id and text. Null and empty texts hold no
    entities. Repeated rows are treated alike. Spans count characters of the input text. Columns of the names added
    here are replaced. A row is known by a 64-bit hash of doc_id and text.
    """
    docs = docs.drop("n_entities", "spans").withColumn("text", F.col("text").cast("string"))
    some = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    row = F.xxhash64(F.col("doc_id").cast("string"), "text")
    texts = docs.where(some).select(row.alias("row"), "text")

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r, k, n) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, n in {e[2:] for e in find_entities(t)}]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], ["row", "kind", "norm"])

    found = settle(texts.mapInArrow(mentions, "row long, kind string, norm string"))
    values = settle(assign_surrogates(settle(found.select("kind", "norm").distinct()), key))
    per_row = found.distinct().join(values, ["kind", "norm"]).groupBy("row").agg(F.collect_list(F.struct("kind", "norm", "value")).alias("values"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            texts_, spans = [], []
            for row_, text, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                value = {(p["kind"], p["norm"]): p["value"] for p in pairs}
                out, own, at = [], [], 0
                for a, b, kind, norm in find_entities(text):
                    new = render(kind, text[a:b], value[kind, norm])
                    out += [text[at:a], new]
                    own.append({"start": a, "end": b, "kind": kind, "surrogate": new})
                    at = b
                texts_.append("".join([*out, text[at:]]))
                spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, pa.string()), pa.array(spans, span)], ["row", "new_text", "spans"])

    changed = texts.join(per_row, "row").select("row", "text", "values").mapInArrow(
        apply, "row long, new_text string, spans array<struct<start: int, end: int, kind: string, surrogate: string>>").dropDuplicates(["row"])
    none = F.expr("cast(array() as array<struct<start: int, end: int, kind: string, surrogate: string>>)")
    held = docs.where(some).withColumn("row", row).join(changed, "row", "left")
    held = held.withColumn("text", F.coalesce("new_text", "text")).withColumn("spans", F.coalesce("spans", none)).drop("row", "new_text")
    both = held.select(*docs.columns, "spans").unionByName(docs.where(~some).withColumn("spans", none))
    return both.select(*docs.columns, F.size("spans").cast("long").alias("n_entities"), "spans")


def op2_surrogates(spark, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["kind"]))), ",").alias("kinds")
    return replace_entities(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", kinds, F.sha2("text", 256).alias("text_sha256"), "spans")
