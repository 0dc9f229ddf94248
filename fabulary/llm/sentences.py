"""Sentence boundaries across languages by a hidden-event n-gram model.

Between any two words, and in scripts without blanks between any two characters, an unseen event may
stand: a sentence boundary. Its neighbours are the word or mark on its left (none, where words only stand
side by side) and the kind of word on its right, so the model is a trigram (left, event, right). It is
trained without labels over all texts. How texts begin gives the right neighbours after an event, gaps
between words without any mark give those without one, and texts end in events; from there expectation
maximisation finds how often each left neighbour is followed by the event and, where letter case tells,
which right neighbours follow. Left neighbours of which the texts tell nothing special fall back to their
shape (one letter, digits, inner dots, or a word).

Forward-backward over the gaps of a text turns this into posteriors: two states per gap, tied where only
one word lies between two gaps, as a one-word sentence is unlikely. A boundary is where the posterior is
over one half; gaps that can reach it in no context are left out of the chain, which changes no posterior
by more than their own share. A boundary ends after closing quotes and brackets. In Thai the mark is a
blank outside quotes; every place between the characters of a stretch has an event too, and its posterior
comes from forward-backward over the lengths of Thai sentences and the character n-grams on both sides.

Counts are over all texts. Words are fitted by sums over the workers and only those come to the driver
that are decided otherwise than their shape; the other tables are bounded by the number of marks, of
opening words (STARTS) and of Thai characters.

Offsets count code points of the text as given; marks are found on a cleaned copy with an offset map
(invisible characters left out, other forms of a character made plain). A text without a boundary is
one sentence; the last end is the length of the text. Null and empty texts have no sentences.
Repeated rows of one record count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, inf, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulary.llm.normalize import INVISIBLE, LOOK_ALIKE
from fabulary.session import cut

STARTS, EM_STEPS, EM_NEAR, BACKOFF, ONE_WORD, GAP_FLOOR = 400, 25, 1e-3, 2.0, -3.0, 0.0
THAI_GRAM, THAI_LONGEST = 4, 1_000

MARKS = ".!?…。！？।॥｡"
_MARK = re.compile(f"[{MARKS}]+")
_ASKS = re.compile("[!?！？]")
_LETTERS = re.compile(r".(?:[^\W\d_]|['’])*")
_CLOSE = "”’)]」』»"
_OPEN = "“„«‘(\"「『[¿¡"
_SCRIPT = [("th", re.compile("[ก-๛]+")), ("hi", re.compile("[ऀ-ॿ]+")), ("ko", re.compile("[가-힣ᄀ-ᇿ]+")), ("ja", re.compile("[ぁ-ヿｦ-ﾟ]+")), ("zh", re.compile("[一-鿿]+"))]
_LATIN = re.compile("[A-Za-z]+")
_ODD = re.compile("[^\t\n -~À-ʯ“”„‘’«»…—¡¿ऀ-़ा-ॿก-๛ぁ-ヿ一-鿿가-힣、。「」『』]")


class _Clean(dict):
    def __missing__(self, point: int):
        c = chr(point)
        if point in _GONE or unicodedata.category(c) == "Cf":
            to = None
        elif c in LOOK_ALIKE:
            to = LOOK_ALIKE[c]
        elif unicodedata.category(c) in ("Zs", "Zl", "Zp"):
            to = " "
        else:
            plain = unicodedata.normalize("NFKC", c)
            to = plain if len(plain) == 1 else c
        self[point] = to
        return to


_GONE = set(INVISIBLE)
_CLEAN = _Clean()


def clean(text: str) -> tuple[str, list[int] | None]:
    """A plain copy, and the offset of each of its characters if any was left out."""
    if not _ODD.search(text):
        return text.replace("\n", " ").replace("\t", " "), None
    out = text.translate(_CLEAN).replace("\n", " ").replace("\t", " ")
    if len(out) == len(text):
        return out, None
    return out, [i for i, c in enumerate(text) if _CLEAN[ord(c)] is not None]


_WIDE = re.compile("[ऀ-ॿก-๛ᄀ-ᇿぁ-ヿ一-鿿가-힣ｦ-ﾟ]")


def script(text: str) -> str:
    if text.isascii() or not _WIDE.search(text):
        return "lat"
    best = max((sum(map(len, p.findall(text))), s) for s, p in _SCRIPT)
    latin = sum(map(len, _LATIN.findall(text)))
    if best[1] == "zh" and re.search("[ぁ-ヿ]", text):
        return "ja"
    return best[1] if best[0] * 2 >= latin and best[0] else "lat"


@lru_cache(4096)
def _mark(signs: str) -> str:
    """The kind of mark that signs in a row, closing quotes among them, stand for."""
    return signs if signs == "." else "?" if _ASKS.search(signs) else "…" if signs[0] == "…" or signs.startswith("..") else "." if signs[0] == "." else "。"


def marks(t: str, kind: str, starts: frozenset[str] | set[str]) -> list[tuple[int, str, str, bool]]:
    """(end, left, right, one word since the last mark) of every place where a sentence may end."""
    german, quote, french = "„" in t, '"' in t, " »" in t
    blanks, latin = kind not in ("ko", "ja", "zh"), kind == "lat"
    n, last = len(t), 0
    quotes = upto = 0
    out = []
    for m in _MARK.finditer(t):
        i, e = m.span()
        if i < last:
            continue
        closers = ""
        while e < n and ((c := t[e]) != " " or french and t.startswith(" »", e)):
            if c == '"' and quote:
                quotes, upto = quotes + t.count('"', upto, e), e
            if c in _CLOSE or c == '"' and quotes % 2 or c == "“" and german and t.rfind("„", 0, e) > t.rfind("“", 0, e):
                closers += c
                e += 1
            elif c == " ":
                closers += "»"
                e += 2
            elif c in MARKS:
                e += 1
            else:
                break
        s = e
        while s < n and t[s] == " ":
            s += 1
        mark = (_mark if e - i < 9 else _mark.__wrapped__)(t[i:e])
        if s == n:
            right = "END"
        else:
            if s == e and mark == "." and not closers and ((c := t[s]).islower() or c.isdigit()):
                last = e
                continue
            right = _right(t, s, n, starts)
        if closers:
            left = f"<{mark}{')' if closers in (')', ']') else chr(34)}>"
        elif mark != "." or not blanks:
            left = f"<{mark}>"
        else:
            begin = max(t.rfind(" ", max(0, i - 24), i), i - 25)
            low = t[begin + 1 : i].lstrip("“„«‘(\"'「『[—¿¡").lower()
            digit = begin > 0 and t[begin - 1].isdigit()
            left = "#" if low.isdigit() else ("# " if digit else "") + low
        out.append((e, left, right, latin and i - last < 16 and t.count(" ", last, i) < 2))
        last = e
    return out


class _Kinds(dict):
    """What a character is like on the right of a mark."""

    def __missing__(self, c: str) -> str:
        if c in ",;:、，；：)":
            kind = "PUNCT"
        elif c in "—–-":
            kind = "dash-"
        elif c in _OPEN:
            kind = "open"
        elif c.islower():
            kind = "l"
        elif c.isupper():
            kind = "U"
        elif c.isdigit():
            kind = "digit"
        else:
            kind = "to" if c == "と" else "C" if c.isalpha() else "other"
        self[c] = kind
        return kind


_KINDS = _Kinds()


def _right(t: str, s: int, n: int, starts) -> str:
    kind = _KINDS[t[s]]
    if kind == "U":
        k = t.find(" ", s, s + 24)
        if k < 0 or not (word := t[s:k]).isalpha():
            k = _LETTERS.match(t, s).end()
            word = t[s:k]
        return "U." if k == s + 1 and t[k : k + 1] == "." else "U:" + word if word in starts else "U"
    if kind == "dash-":
        k = s + 1
        while k < n and t[k] == " ":
            k += 1
        return "PUNCT" if k == n else kind + ("l" if t[k].islower() else "U")
    return kind


def _thai_blanks(t: str) -> list[int]:
    """Ends before blanks outside quotes, and after a closing quote with a letter after it."""
    signs = [m.start() for m in re.finditer("[“”]", t)]
    out, k = [], 0
    for m in re.finditer(" +|”(?=[ก-๛])", t):
        if m.group() == "”":
            out.append(m.end())
            continue
        while k < len(signs) and signs[k] < m.start():
            k += 1
        if signs and (t[signs[k]] == "”" if k < len(signs) else t[signs[-1]] == "“"):
            continue
        out.append(m.start())
    return out


_GAP = re.compile(r"[^.!?…。！？।॥｡”’)\]»」』 ][ ]+(?=([A-ZÀ-ÞΑ-ΫА-Я][^\W\d_'’]*(?:['’][^\W\d_]+)*\.?|[^\s]))|([^.!?…。！？।॥｡ “„«‘(\"「『\[])(?=[“„«‘(「『])")
# What _GAP finds on the right of gaps, in two searches that begin with a character to look for: the word or sign after a blank, and an opening sign next to a letter.
_AFTER = re.compile(r" (?<=[^.!?…。！？।॥｡”’)\]»」』 ] ) *([A-ZÀ-ÞΑ-ΫА-Я][^\W\d_'’]*(?:['’][^\W\d_]+)*\.?|[^\s])")
_BEFORE = re.compile("[“„«‘(「『](?<=[^.!?…。！？।॥｡ “„«‘(\"「『\\[].)")
_FIRST = re.compile(r"[^\s“„«‘(\"「『\[¿¡—]")


def _class(c: str) -> str:
    return "open" if c in _OPEN else "PUNCT" if c in ",:;—–-、，；：)" else "l" if c.islower() else "U" if c.isupper() else "digit" if c.isdigit() else "C" if c.isalpha() else "other"


def gaps(t: str, kind: str, starts) -> Iterator[tuple[int, str]]:
    """(end, right) of every place between words without a mark."""
    for m in _GAP.finditer(t):
        s = m.start(1) if m[1] else m.end()
        yield m.start() + 1, _right(t, s, len(t), starts)


def gap_classes(found: Counter, starts) -> Counter:
    """What was found on the right of places without a mark, by its class."""
    out: Counter = Counter()
    for w, n in found.items():
        if w[0].isupper():
            word = w.rstrip(".")
            out["U." if len(w) == 2 and w != word else "U:" + word if word in starts else "U"] += n
        else:
            out[_class(w)] += n
    return out


def _family(kind: str, left: str) -> str:
    return "gap" if left == "<>" else "mark" if left[:1] == "<" else "word"


def _fold(kind: str, right: str) -> str:
    """Without letter case only the ends of texts and opening quotes tell."""
    return right if kind == "lat" or right in ("END", "open") else "rest"


def count_contexts(texts: DataFrame, starts: frozenset[str]) -> DataFrame:
    """script, left, right, n over all texts; left "^" counts how texts begin and "<>" places without a mark.

    Of Thai the character n-grams beside boundaries (th-l, th-r) and anywhere (th-al, th-ar), and lengths (th-len).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for rows in batches:
            beside: dict[str, Counter] = {}
            met: dict[str, Counter] = {}
            thai = {"th-al": Counter(), "th-ar": Counter()}
            for text in rows["text"]:
                t, _ = clean(text)
                kind = script(t)
                if kind == "th":
                    ends = _thai_blanks(t)
                    g = THAI_GRAM
                    for e in ends:
                        b = e
                        while b < len(t) and t[b] == " ":
                            b += 1
                        total["th-l", t[max(0, e - g) : e], ""] += 1
                        total["th-r", t[b : b + g], ""] += 1
                    if ends:
                        for seg in t.split(" "):
                            total["th-len", str(min(len(seg), THAI_LONGEST)), ""] += 1
                            thai["th-al"].update([seg[max(0, i - g) : i] for i in range(1, len(seg))])
                            thai["th-ar"].update([seg[i : i + g] for i in range(1, len(seg))])
                    continue
                if first := _FIRST.search(t):
                    total[kind, "^", _fold(kind, "open" if first.start() else _right(t, first.start(), len(t), starts))] += 1
                found = _AFTER.findall(t) + _BEFORE.findall(t)
                beside.setdefault(kind, Counter()).update(found)
                if kind in ("ja", "zh"):  # between characters, as blanks part no words
                    total[kind, "<>", "rest"] += max(0, len(t) - len(found))
                met.setdefault(kind, Counter()).update([x[1:3] for x in marks(t, kind, starts)])
                if t and not _MARK.search(t, max(0, len(t) - 4)):
                    total[kind, "<>", "END"] += 1
            for side, found in thai.items():
                for gram, n in found.items():
                    total[side, gram, ""] += n
            for kind, found in met.items():
                for (left, right), n in found.items():
                    total[kind, left, _fold(kind, right)] += n
            for kind, found in beside.items():
                for c, n in gap_classes(found, starts).items():
                    total[kind, "<>", _fold(kind, c)] += n
            if len(total) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["script", "left", "right", "n"])
                total.clear()
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["script", "left", "right", "n"])

    return texts.mapInPandas(count, "script string, left string, right string, n long").groupBy("script", "left", "right").agg(F.sum("n").alias("n"))


def _log(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return log(p / (1 - p))


class Model:
    """Log odds of the event by left neighbour, and likelihood ratios of right neighbours."""

    def __init__(self, rows: list[tuple[str, str, str, int]], starts: frozenset[str]) -> None:
        """rows: the contexts of all left neighbours but words; their families are fitted here."""
        self.starts = starts
        self.left: dict[tuple[str, str], float] = {}
        self.yes: dict[tuple[str, str], dict[str, float]] = {}
        self.no: dict[tuple[str, str], dict[str, float]] = {}
        self.thai: dict[str, Counter] = {k: Counter() for k in ("th-l", "th-r", "th-al", "th-ar", "th-len")}
        self.by: dict[str, dict[str, Counter]] = {}
        for kind, left, right, n in rows:
            if kind in self.thai:
                self.thai[kind][left] += n
            else:
                self.by.setdefault(kind, {}).setdefault(left, Counter())[right] += n
        for kind, lefts in self.by.items():
            own = {k: c for k, c in lefts.items() if _family(kind, k) == "mark"}
            if own:
                self._fit_marks(kind, own)
            plain = lefts.get("<>", Counter())
            yes, no = self.start(kind, "mark")
            self.left[kind, "<>"] = min(_log((plain["END"] + 0.5) / (sum(plain.values()) + 1)), 0.0)
            self.yes[kind, "gap"], self.no[kind, "gap"] = yes, no
        self._ratios()
        self._thai_tables()

    def start(self, kind: str, family: str) -> tuple[dict[str, float], dict[str, float]]:
        """Shares of right neighbours after the event, from how texts begin, and without it, from places without a mark."""
        lefts = self.by.get(kind, {})
        begin, plain = lefts.get("^", Counter()), Counter({r: n for r, n in lefts.get("<>", Counter()).items() if r != "END"})
        ends = sum(c["END"] for k, c in lefts.items() if k[:1] == "<" and k != "<>")
        events = sum(n for k, c in lefts.items() if k[:1] == "<" and k != "<>" for n in c.values())
        kinds = {*begin, *plain, *(r for c in lefts.values() for r in c), "END", "open"}
        end = (ends + 1) / (events + 8)
        yes = {r: (begin[r] + 0.5) / (sum(begin.values()) + 0.5 * len(kinds)) * (1 - end) for r in kinds if r != "END"} | {"END": end}
        no = {r: (plain[r] + 0.5) / (sum(plain.values()) + 0.5 * len(kinds)) for r in kinds if r != "END"} | {"END": 1e-3}
        return yes, no

    def type_odds(self, kind: str, family: str, left: str, rights: Counter) -> float:
        """Of a left neighbour that behaves alike wherever it stands: its odds given all its right neighbours."""
        yes, no = self.yes[kind, family], self.no[kind, family]
        odds = sum(n * log(yes.get(r, 1e-4) / no.get(r, 1e-4)) for r, n in rights.items())
        return max(-6.0, min(6.0, self._unseen(left) + odds / (1 if family == "word" else 1 + 0.01 * sum(rights.values()))))

    def _fit_marks(self, kind: str, lefts: dict[str, Counter]) -> None:
        """A mark in the Latin script can do both and is told apart at each place by the letter case on its right; elsewhere by its type."""
        yes, no = self.start(kind, "mark")
        prior: dict[str, float] = {}
        for _ in range(EM_STEPS if kind == "lat" else 0):
            before, up, down, prior = prior, Counter(), Counter(), {}
            for left, c in lefts.items():
                p, hits = before.get(left, 0.5), 0.0
                for r, n in c.items():
                    q = p * yes[r] / (p * yes[r] + (1 - p) * no[r])
                    hits += n * q
                    up[r] += n * q
                    down[r] += n * (1 - q)
                prior[left] = (hits + BACKOFF * 0.5) / (sum(c.values()) + BACKOFF)
            yes = {r: (up[r] + 0.5) / (sum(up.values()) + 0.5 * len(yes)) for r in yes}
            no = {r: 1e-3 if r == "END" else (down[r] + 0.5) / (sum(down.values()) + 0.5 * len(no)) for r in no}
            if before and max(abs(p - before[left]) for left, p in prior.items()) < EM_NEAR / 10:
                break
        self.yes[kind, "mark"], self.no[kind, "mark"] = yes, no
        for left, c in lefts.items():
            self.left[kind, left] = _log(prior[left]) if kind == "lat" else self.type_odds(kind, "mark", left, c)

    def fit_words(self, words: DataFrame) -> None:
        """words: script, left, rights array<struct<right, n>>. By expectation maximisation, its sums made by the workers."""
        kinds = [r.script for r in words.select("script").distinct().collect()]  # one row per script
        for kind in kinds:
            self.yes[kind, "word"], self.no[kind, "word"] = self.start(kind, "word")

        def sums(yes, no):
            def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                model = Model([], frozenset())
                model.yes, model.no = yes, no
                total: Counter = Counter()
                for rows in batches:
                    for kind, left, rights in zip(rows["script"], rows["left"], rows["rights"], strict=True):
                        c = Counter({x["right"]: x["n"] for x in rights})
                        p = 1 / (1 + exp(-model.type_odds(kind, "word", left, c)))
                        for r, n in c.items():
                            total[kind, r, True] += n * p
                            total[kind, r, False] += n * (1 - p)
                yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["script", "right", "event", "n"])

            rows = words.mapInPandas(add, "script string, right string, event boolean, n double").groupBy("script", "right", "event").agg(F.sum("n").alias("n")).collect()  # scripts times right neighbours
            out = {(r.script, r.right, r.event): r.n for r in rows}
            return out

        live = [k for k in kinds if k == "lat"]
        for _ in range(EM_STEPS if live else 0):
            share = sums({k: v for k, v in self.yes.items() if k[1] == "word"}, {k: v for k, v in self.no.items() if k[1] == "word"})
            moved = 0.0
            for kind in live:
                for event, table in ((True, self.yes), (False, self.no)):
                    old = table[kind, "word"]
                    total = sum(share.get((kind, r, event), 0.0) for r in old)
                    new = {r: (share.get((kind, r, event), 0.0) + 0.5) / (total + 0.5 * len(old)) for r in old}
                    if not event:
                        new["END"] = 1e-3  # where no event stands, a text does not end but by a cut
                    moved = max(moved, *(abs(new[r] - old[r]) for r in old))
                    table[kind, "word"] = new
            if moved < EM_NEAR:
                break
        self._ratios()
        sent = words.sparkSession.sparkContext.broadcast((self.yes, self.no, self.right))

        def special(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = Model([], frozenset())
            model.yes, model.no, model.right = sent.value
            for rows in batches:
                out = []
                for kind, left, rights in zip(rows["script"], rows["left"], rows["rights"], strict=True):
                    c = Counter({x["right"]: x["n"] for x in rights})
                    own, shape = model.type_odds(kind, "word", left, c), model._unseen(left)
                    if any((own + f + tie > 0) != (shape + f + tie > 0) for r in c for f in (model.follow(kind, "word", r),) for tie in (0.0, ONE_WORD)):
                        out.append((kind, left, own))
                yield pd.DataFrame(out, columns=["script", "left", "odds"])

        for r in words.mapInPandas(special, "script string, left string, odds double").toLocalIterator():
            self.left[r.script, r.left] = r.odds

    def _ratios(self) -> None:
        self.follows: dict[tuple[str, str, str], float] = {}
        self.right = {(k[0] + k[1], r): max(-5.0, min(5.0, log(p / self.no[k][r]))) for k, yes in self.yes.items() for r, p in yes.items()}
        # The highest log odds of a gap without a mark over all right neighbours. Ties only lower a posterior, so where this is under zero no gap can pass one half, and none is laid out.
        self.gap_top = {kind: self.left.get((kind, "<>"), -9.0) + max((v for (f, _), v in self.right.items() if f == kind + "gap"), default=0.0) for kind in self.by}

    def _thai_tables(self) -> None:
        lengths = Counter({int(k): n for k, n in self.thai.pop("th-len").items() if int(k)})
        total = sum(lengths.values())
        longest, tail = 0, 0
        for length in sorted(lengths, reverse=True):
            tail += lengths[length]
            if tail > 0.001 * total:
                longest = length
                break
        # Shares of the lengths up to the longest that is usual, each smoothed over its neighbours, and of any beyond it.
        near = [sum(lengths[k + d] * w for d, w in ((-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1))) / 9 for k in range(1, longest + 3)]
        self.thai_lengths = (np.array(near) + 1e-3) / (total + 1)
        self.thai_beyond = 1e-3 / (total + 1)
        for k in ("th-l", "th-al", "th-r", "th-ar"):
            for gram, n in list(self.thai[k].items()):
                for size in range(1, len(gram)):
                    self.thai[k][gram[-size:] if k[-1] == "l" else gram[:size]] += n
        events = sum(n for gram, n in self.thai["th-l"].items() if len(gram) == 1)
        self.thai_base = (events + 1) / (events + sum(n for gram, n in self.thai["th-al"].items() if len(gram) == 1) + 2)
        self.thai_known: dict[str, dict[str, float]] = {"l": {}, "r": {}}

    @staticmethod
    def _unseen(left: str) -> float:
        """What a left neighbour is like before anything is known of it: one letter, a number or inner dots look like an abbreviation, a long word hardly does."""
        if left[:1] == "<":
            return -2.0 if "…" in left else -1.0 if left.endswith('">') else 2.0
        return -2.0 if len(left) == 1 or "." in left or left[:1] == "#" else 2.0 if len(left) < 4 else 4.0

    def follow(self, kind: str, family: str, right: str) -> float:
        known = self.follows.get((kind, family, right))
        if known is None:
            found = self.right.get((kind + family, _fold(kind, right)))
            known = self.follows[kind, family, right] = self.right.get(("lat" + family, right), 0.0) if found is None else found
        return known

    def odds(self, kind: str, left: str, right: str) -> float:
        prior = self.left.get((kind, left))
        if prior is None:
            prior = self._unseen(left)
        return prior - 8 if right in ("PUNCT", "to") else prior + self.follow(kind, _family(kind, left), right)

    def _thai_odds(self, side: str, gram: str) -> float:
        """How much a gram speaks for an event beside it; of grams seen seldom their shorter parts speak too."""
        p = base = self.thai_base
        for k in range(1, len(gram) + 1):
            part = gram[-k:] if side == "l" else gram[:k]
            n = self.thai["th-" + side][part]
            p = (n + BACKOFF * p) / (n + self.thai["th-a" + side][part] + BACKOFF)
        known = self.thai_known[side][gram] = log(p / (1 - p)) - log(base / (1 - base))
        return known

    def _thai_inside(self, t: str, lo: int, hi: int) -> list[int]:
        """Boundaries without a blank inside a stretch, by forward-backward over all ways to part it into sentences.

        A sentence counts by the odds of its length, a boundary by the odds of the characters beside it; none is inside quotes.
        """
        t = t[lo:hi]
        g, n, span = THAI_GRAM, hi - lo, len(self.thai_lengths)
        if n < 2:
            return []
        known_l, known_r = self.thai_known["l"], self.thai_known["r"]
        quoted, depth = "“" in t, False
        odds = [0.0] * n + [1.0]
        for j in range(1, n):
            if quoted:
                c = t[j - 1]
                depth = c == "“" or depth and c != "”"
                if depth:
                    continue
            before, after = t[max(0, j - g) : j], t[j : j + g]
            a, b = known_l.get(before), known_r.get(after)
            odds[j] = exp((self._thai_odds("l", before) if a is None else a) + (self._thai_odds("r", after) if b is None else b))
        usual, beyond = self.thai_lengths, self.thai_beyond
        # All ways with m inner boundaries weigh at most peak ** (m + 1) * (sum of their odds) ** m / m!; where all of them weigh less than the stretch left whole, no posterior passes one half.
        if n <= span:
            peak, inner = max(usual.max(), beyond), sum(odds[1:n])
            if peak * inner < 50 and peak * (exp(peak * inner) - 1) < usual[n - 1]:
                return []
        forward = self._thai_sums(odds, usual, beyond)
        # Nor does any where the stretch left whole has one half.
        if log(usual[n - 1] if n <= span else beyond) - forward[n] >= log(0.5):
            return []
        # From the end the same sums run over the boundaries in turned order; each has the odds of its own boundary too, which count once.
        backward = self._thai_sums([1.0, *odds[n - 1 : 0 : -1], 1.0], usual, beyond)
        half = forward[n] + log(0.5)
        return [lo + j for j in range(1, n) if odds[j] and forward[j] + backward[n - j] - log(odds[j]) > half]

    @staticmethod
    def _thai_sums(odds: list[float], usual: np.ndarray, beyond: float) -> list[float]:
        """Log of the summed weight of all ways to part a stretch up to each place where a boundary has odds."""
        n, span = len(odds) - 1, len(usual)
        turned = usual[::-1].copy()
        sums, out = np.zeros(n + 1), [-inf] * (n + 1)
        sums[0] = 1.0
        out[0] = far = scale = 0.0
        for j in range(1, n + 1):
            if j > span:
                far += float(sums[j - span - 1])
            if odds[j]:
                w = min(j, span)
                x = odds[j] * (float(sums[j - w : j].dot(turned[span - w :])) + far * beyond)
                out[j] = log(x) + scale
                if x > 1e100:  # all that later places read is made smaller
                    sums[j - w : j] /= x
                    far /= x
                    scale += log(x)
                    x = 1.0
                sums[j] = x
        return out

    def ends(self, text: str) -> list[int]:
        """The offsets after the sentences of a text."""
        if not text:
            return []
        t, offsets = clean(text)
        kind = script(t)
        if kind == "th":
            found = _thai_blanks(t)
            if self.thai["th-l"]:
                bounds = [0, *found, len(t)]
                inside = []
                for lo, hi in zip(bounds, bounds[1:], strict=False):
                    while lo < hi and t[lo] == " ":
                        lo += 1
                    # A list of things parted by ';' is one sentence.
                    if ";" not in t[lo:hi]:
                        inside += self._thai_inside(t, lo, hi)
                found = sorted({*found, *inside})
        else:
            chain = [(e, self.odds(kind, left, right), tied) for e, left, right, tied in marks(t, kind, self.starts)]
            if self.gap_top.get(kind, -9.0) > GAP_FLOOR:
                chain = sorted([*chain, *((e, self.odds(kind, "<>", right), False) for e, right in gaps(t, kind, self.starts))])
            found = self._decode(chain)
        last = len(t.rstrip(" "))
        return [*(e if offsets is None else offsets[e - 1] + 1 for e in found if 0 < e < last), len(text)]

    @staticmethod
    def _decode(chain: list[tuple[int, float, bool]]) -> list[int]:
        """Forward-backward over runs of marks that are tied; elsewhere the posterior is the mark's own."""
        if not any([x[2] for x in chain[1:]]):
            return [e for e, odds, _ in chain if odds > 0]
        out, k = [], 0
        while k < len(chain):
            j = k + 1
            while j < len(chain) and chain[j][2]:
                j += 1
            if j == k + 1:
                if chain[k][1] > 0:
                    out.append(chain[k][0])
            else:
                run = chain[k:j]
                forward, backward = [(1.0, exp(min(30, run[0][1])))], [(1.0, 1.0)]
                tie = exp(ONE_WORD)
                for _, odds, _ in run[1:]:
                    a, b = forward[-1]
                    w = exp(min(30, odds))
                    z = a + b
                    forward.append(((a + b) / z, w * (a + b * tie) / z))
                for _, odds, _ in reversed(run[1:]):
                    a, b = backward[-1]
                    w = exp(min(30, odds))
                    z = a + w * b
                    backward.append(((a + w * b) / z, (a + w * b * tie) / z))
                for (e, _, _), (fa, fb), (ba, bb) in zip(run, forward, reversed(backward), strict=True):
                    if fb * bb > fa * ba:
                        out.append(e)
            k = j
        return out


def fit(texts: DataFrame) -> Model:
    """texts: text. The model over all of them."""
    texts = texts.select("text").where("text is not null and text <> ''")
    first = F.regexp_extract("text", r"^[\s“„«‘(\"\[—¿¡]*(\p{Lu}[\p{L}'’]+|\p{Lu}(?![.\p{L}]))", 1).alias("word")
    starts = frozenset(r.word for r in texts.select(first).where("word <> ''").groupBy("word").count().orderBy(F.desc("count"), "word").limit(STARTS).collect())
    contexts = cut(count_contexts(texts, starts))
    bounded = F.col("left").rlike("^[<^]") | F.col("script").startswith("th-")
    model = Model([(r.script, r.left, r.right, r.n) for r in contexts.where(bounded).collect()], starts)  # marks and characters, no words
    model.fit_words(cut(contexts.where(~bounded).groupBy("script", "left").agg(F.collect_list(F.struct("right", "n")).alias("rights"))))
    return model


def sentence_ends(records: DataFrame, model: Model) -> DataFrame:
    """records: record_kind, record_id, text. Out: record_kind, record_id, sentence_no (from 0), start_char, end_char, distinct."""
    sent = records.sparkSession.sparkContext.broadcast(model)
    kind = records.schema["record_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"record_kind": rows["record_kind"], "record_id": rows["record_id"], "ends": [sent.value.ends(t) for t in rows["text"]]})

    found = records.where("record_id is not null and text is not null and text <> ''").select("record_kind", "record_id", "text").mapInPandas(cut_up, f"record_kind string, record_id {kind}, ends array<int>").distinct()
    start = F.when(F.col("pos") == 0, 0).otherwise(F.get("ends", F.col("pos") - 1))
    return found.select("*", F.posexplode("ends").alias("pos", "end_char")).select("record_kind", "record_id", F.col("pos").alias("sentence_no"), start.alias("start_char"), "end_char")
