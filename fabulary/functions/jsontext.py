"""JSON out of model responses: fence stripping, the first whole object, a careful repair."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*|\s*```\s*$")


def first_object(text: str) -> str | None:
    """The first object whose braces are balanced, braces inside strings not counted."""
    start = text.find("{")
    depth, inside, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def repaired(text: str) -> str:
    """Raw line breaks inside strings escaped, commas before closing brackets dropped."""
    out, inside, escaped = [], False, False
    for c in text:
        if inside:
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c))
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        else:
            inside = c == '"'
            out.append(c)
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


def read(text: str) -> tuple[str, object]:
    """(how, value); how is plain, fenced, object, repaired or unreadable."""
    bare = _FENCE.sub("", text)
    for how, candidate in (("plain", text), ("fenced", bare), ("object", first_object(bare)), ("repaired", repaired(bare)), ("repaired", first_object(repaired(bare)))):
        if candidate is not None:
            try:
                return how, json.loads(candidate)
            except ValueError:
                continue
    return "unreadable", None


@F.pandas_udf(StructType([StructField("how", StringType()), StructField("first_key", StringType()), StructField("fields", IntegerType())]))
def reading(texts: pd.Series) -> pd.DataFrame:
    found = [read(t) for t in texts]
    return pd.DataFrame({"how": [h for h, _ in found], "first_key": [next(iter(v), None) if isinstance(v, dict) else None for _, v in found], "fields": [len(v) if isinstance(v, dict) else 0 for _, v in found]})
