"""The canonical form of normalize.py as SQL, to check it by: its table of single characters is made from the same rule."""

from __future__ import annotations

from functools import lru_cache

from fabulary.llm.normalize import canonical_segment

# Characters that become several, as far as texts in the scripts at hand hold them.
SEVERAL = "…‥ำ№™℡"


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str]:
    """Characters that become another one, what they become, and characters that vanish."""
    one, other, gone = [], [], []
    for p in [*range(0x20, 0xD800), *range(0xF900, 0xFB00), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(p)
        if 0xAC00 <= p <= 0xD7A3 or 0x4E00 <= p < 0xA000 or c in "'":
            continue
        to = canonical_segment(c)
        if to == "":
            gone.append(c)
        elif to != c and len(to) == 1 and to != "'":
            one.append(c)
            other.append(to)
    return "".join(one), "".join(other), "".join(gone)


def canonical_sql(c: str) -> str:
    """SQL of the canonical form; accents and syllables that are given apart are composed."""
    one, other, gone = _tables()
    blanks = "".join(chr(p) for p in (9, 11, 12, 0x85))
    text = f"translate({c}, '{one}{blanks}', '{other}{' ' * len(blanks)}')"
    vanish = "".join(f"\\x{{{ord(x):X}}}" for x in gone)
    text = f"regexp_replace({text}, '[{vanish}\\x{{E0100}}-\\x{{E01EF}}]', '', 'g')"
    for x in SEVERAL:
        text = f"replace({text}, '{x}', '{canonical_segment(x)}')"
    return f"nfc_normalize({text})"
