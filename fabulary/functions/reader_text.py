"""Text as a reader is shown it, as Column expressions. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fabulary.functions import text as X


def clean(c: str | Column) -> Column:
    """White space squeezed, names of stages left out."""
    return F.trim(F.regexp_replace(F.regexp_replace(X.col(c), r"[\s\p{Z}]+", " "), r"\b(SUP\.\d+|BOOK\.0|FINAL\.\d+)\b", ""))


def compact(c: str | Column, most: int = 120) -> Column:
    """Cleaned; longer than `most` characters: cut one shorter, with an ellipsis. The cut is what is displayed, the text stays whole elsewhere."""
    t = clean(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.trim(F.substring(t, 1, most - 1)), F.lit("…")))


def sentence(c: str | Column, most: int = 180) -> Column:
    """One closed sentence: no loose marks at its end, a full stop where no other mark closes it; empty stays empty."""
    bare = F.trim(F.regexp_replace(compact(c, most), r"[.;,\s]+$", ""))
    return F.when(bare == "", "").when(bare.rlike("[.!?。！？]$"), bare).otherwise(F.concat(bare, F.lit(".")))


def compact_list(c: str | Column, most: int = 4, fallback: str = "no explicit detail") -> Column:
    """The first distinct items, or the fallback where there is none."""
    items = X.unique_strings(c)
    return F.when(F.size(items) > 0, F.array_join(F.slice(items, 1, most), ", ")).otherwise(F.lit(fallback))


def bridge(c: str | Column) -> tuple[Column, Column]:
    """previous, current: a label parted at its last arrow; both null where there is none."""
    parts = F.filter(F.transform(F.split(X.col(c), r"\s*(?:->|→|=>)\s*"), lambda p: F.trim(p)), lambda p: p != "")
    many = F.size(parts) > 1
    return F.when(many, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " -> ")).alias("previous"), F.when(many, F.element_at(parts, -1)).alias("current")


def fields(c: str | Column, labels: list[str]) -> Column:
    """label -> value of a text of the form "Label: value Label: value"; a value ends where the next label begins, its last occurrence counts."""
    text, any_of = clean(c), "|".join(labels)
    value = lambda label: F.regexp_replace(F.try_element_at(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(rf"(?is)\s{label}:\s*(.*?)(?=\s(?:{any_of}):|\z)"), 1), F.lit(-1)), r"[.;,\s]+$", "")
    made = F.array(*[F.struct(F.lit(label.lower()).alias("key"), value(label).alias("value")) for label in labels])
    return F.map_from_entries(F.filter(made, lambda f: f["value"].isNotNull() & (f["value"] != "")))


def file_name(c: str | Column, fallback: str = "original.epub") -> Column:
    """Letters, digits, dots and hyphens kept, the rest one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.trim(X.col(c)), r"[^A-Za-z0-9_.\-]+", "_"), "_+", "_"), F.lit("")), F.lit(fallback))


def path_segment(c: str | Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(X.col(c)), r"[^A-Za-z0-9_\-]+", "_"), "_+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(fallback))
