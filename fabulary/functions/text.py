"""Text functions as Column expressions, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English prepositions of place.
SPATIAL = "in into inside through throughout at to from near outside within under over on across along around beside between beyond down up".split()
# Personal pronouns that stand for a character.
PRONOUNS = "i me my myself you your yourself he him his himself she her hers herself we us our ourselves they them their theirs themselves".split()
# Titles that belong to no chapter of the story.
NON_STORY_TITLE = r"\b(cover|title\s*page|copyright|contents|table\s+of\s+contents|toc|nav|navigation|colophon|imprint|acknowledg|dedication|pg[-_\s]*header|pg[-_\s]*footer|project\s+gutenberg|footer|header)\b"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: str | Column) -> Column:
    """Runs of white space made one blank, none at the ends; no-break spaces are white space."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def missing_if_blank(c: str | Column) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def key(c: str | Column) -> Column:
    """Latin letters, digits and Hangul kept, the rest one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9가-힣]+", "_"), "^_+|_+$", "")


def safe_id(c: str | Column, most: int) -> Column:
    return F.substring(F.regexp_replace(col(c), "[^a-zA-Z0-9:_-]", "_"), 1, most)


def plain_span(c: str | Column) -> Column:
    """Trimmed, lower case, one leading English article dropped."""
    return F.trim(F.regexp_replace(F.lower(F.trim(col(c))), r"^(the|a|an)\s+", ""))


def chapter_title(c: str | Column) -> Column:
    """A title from a title or a path: no fragment, folder, page extension or underscores; null if nothing is left."""
    name = F.element_at(F.split(F.split_part(col(c), F.lit("#"), F.lit(1)), r"[\\/]", -1), -1)
    bare = F.regexp_replace(name, r"(?i)\.(xhtml|html|htm)$", "")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(bare, "_+", " "), r"\s+", " ")), F.lit(""))


def generic_title(c: str | Column) -> Column:
    """True where a title says nothing; a missing one does not either."""
    compact = F.regexp_replace(F.lower(chapter_title(c)), r"[\s._-]+", "")
    return F.coalesce(compact.rlike(r"^(item|id|xhtml|html|body|text|page|file|section)\d*$|^(nav|toc|contents|cover|titlepage|pgheader|pgfooter)$|^chapter\d+$"), F.lit(True))


def heading(c: str | Column) -> Column:
    """Does a line look like a chapter heading?"""
    t = squeeze(c)
    shape = t.rlike(r"(?i)^chapter\s+([0-9]+|[ivxlcdm]+)\b|^(book|part|volume)\s+([0-9]+|[ivxlcdm]+)\b") | t.rlike(r"^[0-9]+[.)]\s+\S+|^[IVXLCDM]+[.)]\s+\S+")
    loud = (F.length(t) <= 80) & (t == F.upper(t)) & t.rlike("[A-Z]")
    return F.coalesce((t != "") & (F.length(t) <= 140) & ~t.rlike("(?i)" + NON_STORY_TITLE) & (shape | loud), F.lit(False))


def href(c: str | Column) -> Column:
    """Forward slashes, no leading ./, lower case, no fragment."""
    return F.split_part(F.lower(F.regexp_replace(F.replace(col(c), F.lit("\\"), F.lit("/")), r"^\.?/", "")), F.lit("#"), F.lit(1))


def bigram_similarity(a: str | Column, b: str | Column) -> Column:
    """1 if equal; shares of length if one holds the other; else the shorter's bigrams found in the longer. Texts under two characters: 0."""
    a, b = col(a), col(b)
    longer = F.when(F.length(a) > F.length(b), a).otherwise(b)
    shorter = F.when(F.length(a) > F.length(b), b).otherwise(a)
    hits = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(shorter) - 1, F.lit(1))), lambda i: F.contains(longer, F.substr(shorter, i, F.lit(2)))))
    return (
        F.when(a == b, 1.0)
        .when((F.length(a) < 2) | (F.length(b) < 2), 0.0)
        .when(F.contains(longer, shorter), F.length(shorter) / F.length(longer))
        .otherwise(2.0 * hits / (F.length(longer) + F.length(shorter) - 2))
    )


def bounded(c: str | Column, fallback: float = 0.0) -> Column:
    """A score in [0, 1]; null and NaN give the fallback."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), F.lit(fallback)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def unique_strings(c: str | Column) -> Column:
    """Trimmed, no empty ones, the first of equals kept in order."""
    return F.array_distinct(F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def keep(a: str | Column, b: str | Column) -> Column:
    """Elements of a that are in b, in a's order, repeats kept."""
    b = col(b)
    return F.filter(col(a), lambda x: F.array_contains(b, x))


def drop(a: str | Column, b: str | Column) -> Column:
    """Elements of a that are not in b, in a's order, repeats kept."""
    b = col(b)
    return F.filter(col(a), lambda x: ~F.array_contains(b, x))


def padded(n: str | Column, width: int = 2) -> Column:
    """A number with leading zeros; longer numbers are never cut."""
    text = col(n).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def short_hash(c: str | Column, n: int = 24) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, n)
