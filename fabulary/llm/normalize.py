"""One form for text that looks the same.

A character is unstable when its canonical form differs from it, or when it can join the character
before it. A JVM regular expression first passes the rows that hold stable characters only (the
quick check); in the others only the unstable segments, each with the character before it as
boundary context, are normalised and spliced back into the unchanged text.

The canonical form of a segment: compatibility decomposition; invisible characters deleted; every
kind of blank made U+0020; letters of other scripts that look like a Latin letter made that letter;
composition. Case, accents, quotes, punctuation, digits and missing blanks stay as they are.

Null stays null and the empty text stays empty. The mapping is idempotent.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fabulary.session import cut

# Letters of the Greek, Cyrillic, Armenian and Cherokee blocks and the Latin letters they look like.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԌԚԜӀаеѕіјһӏорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲϳՕօսհոցᎪᏴᏟᎠᎬᏀᎻᎫᏞᎷᏢᏚᎢᏙᎳᏃ",
        "ABESIJKMHOPCTYXGQWIaesijhlopcyxdqwABEZHIKMNOPTYXaikvopuxcjOouhngABCDEGHJLMPSTVWZ",
        strict=True,
    )
)
# Characters that leave no mark, besides those of category Cf.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)]
# Ranges whose characters are stable wherever they stand; the rest goes to the exact test.
STABLE_CORE = [
    (0x09, 0x0A), (0x20, 0x7E), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAC), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0x131), (0x134, 0x13E),
    (0x141, 0x148), (0x14A, 0x17E), (0x904, 0x928), (0x92A, 0x930), (0x932, 0x933), (0x935, 0x939), (0x93E, 0x94C), (0x901, 0x903), (0x964, 0x96F), (0xE01, 0xE32), (0xE34, 0xE37),
    (0xE40, 0xE47), (0xE4C, 0xE59), (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x201F), (0x3001, 0x3003), (0x3005, 0x3007),
    (0x3008, 0x3011), (0x3041, 0x3096), (0x30A1, 0x30FE), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
]


def _blank_or_invisible(c: str) -> str | None:
    if ord(c) in _INVISIBLE or unicodedata.category(c) == "Cf":
        return ""
    return " " if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\x0b\x0c\x85" else None


_INVISIBLE = set(INVISIBLE)


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")  # rare; kept out of the segment class, whose search is fast only without them


class _Translate(dict):
    def __missing__(self, point: int):
        c = chr(point)
        to = LOOK_ALIKE.get(c)
        if to is None:
            to = _blank_or_invisible(c)
        self[point] = c if to is None else to
        return self[point]


_TRANSLATE = _Translate()


def canonical_segment(segment: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", segment).translate(_TRANSLATE))


@lru_cache(maxsize=1)
def _segments() -> tuple[re.Pattern, re.Pattern, frozenset[str]]:
    """Runs of unstable characters and marks, without and with all characters beyond the basic plane; the marks that are stable alone."""
    points = range(0x10000)
    joins: set[int] = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    unstable: set[int] = set()
    for p in points:
        if 0xD800 <= p < 0xE000 or 0xAC00 <= p <= 0xD7A3 or 0x4E00 <= p < 0xA000:
            continue
        c = chr(p)
        if canonical_segment(c) != c:
            unstable.add(p)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", c) == c:
            joins.add(int(parts.split(" ")[1], 16))
    marks = {p for p in points if not 0xD800 <= p < 0xE000 and unicodedata.combining(chr(p))}
    kind = _class(unstable | joins | marks)
    return re.compile(kind + "+"), re.compile(f"(?:{kind}|[\U00010000-\U0010ffff])+"), frozenset(map(chr, marks - unstable - joins))


def _class(points: set[int]) -> str:
    out, run = [], []
    for p in [*sorted(points), sys.maxunicode + 2]:
        if run and p != run[-1] + 1:
            out.append(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}" if len(run) > 1 else re.escape(chr(run[0])))
            run = []
        run.append(p)
    return "[" + "".join(out) + "]"


class _Memo(dict):
    def __missing__(self, segment: str) -> str:
        value = canonical_segment(segment)
        if len(self) < 50_000:
            self[segment] = value
        return value


_MEMO = _Memo()


def canonical(text: str | None) -> str | None:
    """The canonical form of one text."""
    if text is None or text.isascii() and "\t" not in text and "\x0b" not in text and "\x0c" not in text:
        return text
    basic, every, alone = _segments()
    pattern = every if _ASTRAL.search(text) else basic
    out, done = [], 0
    for m in pattern.finditer(text):
        start, end = m.span()
        if end - start == 1 and text[start] in alone:
            continue
        start = max(done, start - 1)
        out += (text[done:start], _MEMO[text[start:end]])
        done = end
    return "".join(out) + text[done:] if out else text


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def needs_look(col: Column) -> Column:
    """The quick check: true when the text holds anything outside the stable core."""
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in STABLE_CORE if a != 0x09) + "\\n"
    return col.rlike(f"[^{ranges}]")


def canonical_text(col: Column) -> Column:
    """The canonical form of a text column; rows that pass the quick check never leave the JVM."""
    return F.coalesce(_canonical(F.when(needs_look(col), col)), col)


def look_alike_pairs(records: DataFrame) -> DataFrame:
    """Pairs of records of one place that look the same and differ.

    records: record_kind, record_id, place (struct or string), text; a record may have several texts.
    Out: record_kind, id_a, id_b with id_a < id_b, distinct. A pair is one whose texts have one
    canonical form without being equal. Null ids, places and texts take no part; repeated rows count
    once. Only digests are shuffled, and only places where one form is written in two ways are joined.
    """
    forms = (
        records.where(F.col("record_id").isNotNull() & F.col("place").isNotNull() & F.col("text").isNotNull())
        .select("record_kind", "record_id", "place", F.md5("text").alias("form"), F.md5(canonical_text(F.col("text"))).alias("key"))
        .distinct()
    )
    forms = cut(forms)
    group = ["record_kind", "place", "key"]
    mixed = forms.groupBy(*group).agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo < hi").select(*group)
    members = forms.join(mixed, group, "left_semi")
    a = members.select(*group, F.col("record_id").alias("id_a"), F.col("form").alias("form_a"))
    b = members.select(*group, F.col("record_id").alias("id_b"), F.col("form").alias("form_b"))
    pairs = a.join(b, group).where("id_a < id_b and form_a <> form_b")
    return pairs.select("record_kind", "id_a", "id_b").distinct()
