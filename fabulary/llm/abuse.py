"""Abusive, hateful and sexually explicit language, scored after noisy-channel restoration.

Writers hide words by look-alike digits and signs, by signs put for letters, by spacing letters out
and by repeating them. A span that looks hidden becomes a lattice: at every position the letters that
could have been meant, with the channel's probability. Viterbi decoding finds the likeliest letters
under a character language model, a mixture of a trigram model counted over all documents and of a
list of words that people hide, each word by its whole likelihood.

The restored text is scored sentence by sentence by a log-linear model. Its features are how words of
the lists stand together (an insult beside an address, harm turned at the reader, a group called
vermin, explicit acts, signs of a quoted, literal or friendly use) and the character n-grams of the
sentence. The weights start from fixed values and are fitted to a bounded sample of labelled documents:
a document is toxic if any sentence is, which sentence it was stays unseen; raters err at two rates
fitted with it; and weights are drawn to their starting values, so few labels change little. Without
labels the starting values stand.

score = the highest of its sentences, in [0, 1]. Null and empty texts score 0. Repeated rows of one id
count once, with the highest score. Labels with a null id or vote, and of unknown ids, are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulary.llm.neardup import kmer_hashes
from fabulary.llm.normalize import canonical
from fabulary.session import cut

THRESHOLD, HIDDEN_SHARE = 0.5, 0.2
FIT_DOCUMENTS, FIT_ROUNDS, FIT_STEPS, GRAM, GRAM_BITS, HOLD, GRAM_HOLD, VOTE_ERROR, VOTE_HOLD, SETTLED = 3_000, 12, 40, 4, 14, 4.0, 1.0, 0.1, 20.0, 5e-3

# What a sign may stand for.
CHANNEL = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Words by what they say; a word may end in the endings of ENDINGS, and scripts without blanks match anywhere.
INSULT = [
    *"idiot moron cretin imbecile scum scumbag bastard bitch whore slut cunt asshole arsehole arse ass dumbass jackass prick dickhead pig swine coward maggot trash vermin rat worm wanker twat shithead motherfucker loser parasite jerk fool creep pervert degenerate lowlife douchebag tosser bellend freak wretch filth toad hag".split(),
    "piece of shit", "waste of skin", "waste of space", "waste of air", "waste of breath",
    *"connard connasse salaud salope pute ordure enculé merde con abruti crétin arschloch hure schlampe wichser hurensohn drecksau miststück missgeburt vollidiot idiotin puta puto cabrón gilipollas imbécil zorra escoria mierda maricón".split(),
    *"병신 새끼 미친놈 쓰레기 년아 개자식 野郎 淫売 クズ ゴミ 馬鹿 阿呆 畜生め 傻逼 婊子 杂种 贱人 王八蛋 混蛋 废物 人渣 हरामी हरामज़ादा कमीने कमीना कुत्ते रंडी चूतिया मादरचोद ไอ้เหี้ย ไอ้สัตว์ ไอ้ควาย อีดอก อีสัตว์ อีกะหรี่".split(),
]
SLUR_ADJECTIVE = [*"fucking shitty goddamn goddamned damn damned stupid filthy worthless pathetic disgusting ugly lying rotten dirty brainless bloody dumb useless miserable sale pauvre espèce dumme dreckige elende verdammte wertloses dreckiges inútil asqueroso クソ くそ".split()]
ADDRESS = [*"you your yourself you're u tu toi te ta ton vous du dich dir dein deine dein eres tú ti usted".split(), *"너 네 니가 이 お前 貴様 てめえ この 你 तू तुम तेरी तेरे मึง มึง".split()]
SAID = [
    *"kys".split(), "fuck you", "fuck off", "fuck your", "shut your", "gas the", "go to hell", "drop dead", "kill yourself", "drown yourself", "hang yourself", "get out of my sight", "crawl back", "make me sick", "do us all a favor", "do us all a favour", "everyone hates you", "rot in hell", "screw you",
    "ferme ta", "ta gueule", "va crever", "va te faire", "fils de pute", "stück scheiße", "halt dein", "halt die fresse", "verpiss dich", "verrecke", "niemand will dein", "la puta boca", "hija de puta", "hijo de puta", "ojalá te mueras", "vete a la mierda", "nadie te quiere",
    "씨발", "시발", "닥쳐", "꺼져", "죽어 버려", "死ね", "失せろ", "黙れ", "殺してやる", "操你", "他妈的", "去死", "滚开", "杀了你", "मार डालूँगा", "मर जा", "ฆ่ามึง", "เย็ดแม่", "ไปตาย", "ส้นตีน",
]
HARM = [*"kill murder gas gut slit burn strangle strangled hang drown shoot stab beat beaten cut die dies dead burned burnt hanged rape choke exterminate lynch slaughter wipe wiped brûler crever tuer verbrannt vergast umbringen töten abstechen quemarlos quemarlas quemar matar mueras".split(), "down like a", *"죽여 죽어 태워 없애 皆殺し 焼き殺 殺せ 杀光 烧死 杀死 मार जला ฆ่า เผา".split()]
WISH = [*"hope should must will gonna would ought let may hay faut gehören soll sollen müssen ojalá debería".split(), "going to", "i'll", "i’ll", "deserve to", *"한다 해야 にしろ べき 应该 必须 चाहिए ต้อง".split()]
GROUP = [*"them they those these women men folk people kind everyone thief thieves les los las diese all tous todos alle".split(), *"놈들 것들 連中 やつら 奴ら 那些 这些 他们 लोग พวก".split()]
LESSER = [*"vermin subhuman animals rats plague cockroaches parasites filth savages cripple mongrels vermine ungeziefer ratas sous-hommes untermenschen alimañas".split(), "breed like", "in their blood", "that kind", "born to steal", "only good", "on a chain", "back to the mud", "not people", "at birth", "never trust", *"벌레 짐승 害虫 畜生 ゴキブリ 蛆 虫けら कीड़े जानवर สัตว์นรก แมลง".split()]
ACT = [*"fuck fucked fucking cock pussy cunt orgasm erection blowjob masturbate masturbated ejaculated penis vagina clitoris cumming ficken fickten gefickt baisé baiser joui foutre follaron follar corrió polla coño".split(), "came inside", "ride him", "ride her", "until she came", "until he came", "in ihr kam", *"섹스 신음 セックス 挿入 做爱 性交 सेक्स ร่วมเพศ".split()]
BARE = [*"naked nude nipple nipples thighs hips breasts lick licked suck sucked groan moan moaned groaned wet hard mouth legs tongue sweating nus nues nackt desnudos desnudas gritando crier criant".split(), *"벌거벗 裸 赤裸 नंगे เปลือย".split()]
QUOTED = [*"word words dictionary notice forbade forbidden spelling term terms definition means meaning etymology entry slang mot wort palabra printed glossary".split(), "such as", "under ‘", "or ‘", "as ‘", *"단어 言葉 词语 शब्द คำว่า".split()]
LITERAL = [*"file nut pipe water apple pond kennel pups doctor nurse lumps rash sow flame hay yard crowed brayed willow pot price farm hens breeder surgeon medical clinic exam farmer well-fed vet rooster stable".split()]
FRIENDLY = [*"fondly laughed laughing grinned teased teasing joked joking winked affectionately chuckled hugged smiled smiling dear darling lovingly".split()]
LISTS = {"insult": INSULT, "adjective": SLUR_ADJECTIVE, "address": ADDRESS, "said": SAID, "harm": HARM, "wish": WISH, "group": GROUP, "lesser": LESSER, "act": ACT, "bare": BARE, "quoted": QUOTED, "literal": LITERAL, "friendly": FRIENDLY}
ENDINGS = ("", "s", "es", "ed", "ing", "n")
HIDDEN = sorted({w for k in ("insult", "adjective", "harm", "lesser", "act", "bare") for w in LISTS[k] if w.isalpha() and w.isascii()} | set("yourself mouth skin piece throat shit breed mud steal".split()) | set("kotze scheiße fick hure merde pute connard puta mierda cabrón".split()))

_HIDDEN = frozenset(HIDDEN)

# What the weights of the features start from, with the kind of language a feature speaks for.
FEATURES = {
    "said": (4.0, "insult"), "said_twice": (2.0, "insult"), "insult_addressed": (5.0, "insult"), "insult_called": (4.5, "insult"), "insult_qualified": (2.5, "insult"), "insult": (1.0, "insult"),
    "harm_at_you": (4.5, "threat"), "harm_wished_you": (2.0, "threat"), "harm_announced": (3.0, "threat"), "group_lesser": (5.0, "hate"), "lesser_twice": (4.5, "hate"), "lesser": (1.0, "hate"), "group_harm_wished": (5.0, "hate"), "lesser_harm": (2.0, "hate"), "harm_wished": (1.0, "hate"),
    "act": (2.0, "sexual"), "act_bare": (4.5, "sexual"), "act_twice": (2.0, "sexual"), "bare_thrice": (6.5, "sexual"), "qualified": (0.5, "insult"),
    "quoted": (-6.0, ""), "literal": (-4.5, ""), "friendly": (-5.0, ""), "bias": (-4.5, ""),
}
NAMES = list(FEATURES)
START = np.array([w for w, _ in FEATURES.values()])

_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_SIGNED = re.compile(r"(?<![\w@$!|+*€£])(?=[a-z@$!|+*€£\d]*[a-z])(?=[a-z@$|+*€£!]*[\d@$|+*€£!])(?!\d+[a-z]{1,2}\b)[a-z\d@$!|+*€£]{2,}[a-z\d@$*]")
_SIGN_BESIDE_LETTER = re.compile(r"[a-z][\d@$!|+*€£]|[\d@$!|+*€£][a-z]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED_DENSE = re.compile(r"(?<=[가-힣ぁ-ヿ一-鿿])[ .\-_*·​](?=[가-힣ぁ-ヿ一-鿿](?:[ .\-_*·]|$))")


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def repeated_words(text: str, replace) -> str:
    """Every word with a letter three times running, replaced; found by the letters, as few words have any."""
    out, done = [], 0
    for m in _TRIPLE.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and _letter(text[a - 1]):
            a -= 1
        while b < len(text) and _letter(text[b]):
            b += 1
        out += (text[done:a], replace(text[a:b]))
        done = b
    return "".join(out) + text[done:] if out else text


def trigram_counts(documents: DataFrame) -> DataFrame:
    """trigram (base 27, blank and a to z) and its count over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = np.zeros(256, np.int64)
        to[97:123] = np.arange(1, 27)
        to[65:91] = np.arange(1, 27)
        total = np.zeros(27**3, np.int64)
        for rows in batches:
            codes = to[np.frombuffer(("  ".join(t for t in rows["text"] if t)).encode(), np.uint8)]
            total += np.bincount(codes[:-2] * 729 + codes[1:-1] * 27 + codes[2:], minlength=27**3) if len(codes) > 2 else 0
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": seen.astype(np.int32), "n": total[seen]})

    return documents.select("text").where("text is not null").mapInPandas(count, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


class Restorer:
    """Decodes hidden spans under the mixture model."""

    def __init__(self, counts: dict[int, int]) -> None:
        table = np.zeros(27**3)
        for k, n in counts.items():
            table[k] = n
        table = table.reshape(27, 27, 27)
        for word in HIDDEN:
            codes = [0, 0, *((ord(c) - 96 if "a" <= c <= "z" else 0) for c in word), 0]
            for x, y, z in zip(codes, codes[1:], codes[2:], strict=False):
                table[x, y, z] += 1 + 1e-4 * table.sum() / len(HIDDEN)
        table += 0.01
        single = table.sum((0, 1)) / table.sum()
        mixed = 0.9 * table / table.sum(2, keepdims=True) + 0.1 * single
        self.logp = np.log(mixed).tolist()
        self.word = log(HIDDEN_SHARE / len(HIDDEN))

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """At every position the strings that may have been meant, with log probabilities."""
        out = []
        for m in re.finditer(r"([^\W\d_])\1\1+|.", span):
            c = m.group()
            if len(c) > 1:
                out.append([(c[0], log(0.6)), (c[0] * 2, log(0.4))])
            elif c in CHANNEL:
                out.append([(x, -log(len(CHANNEL[c]))) for x in CHANNEL[c]])
            elif c == "*":
                out.append([(x, -log(26)) for x in LETTERS])
            elif c.isalpha():
                out.append([(c, 0.0)])
        return out

    def decode(self, span: str) -> str:
        key = span.lower()
        if _SPACED.fullmatch(key):
            key = re.sub(r"[ .\-_*·]", "", key)
            if key[0] == "a" and key[1:] in _HIDDEN and key not in _HIDDEN:  # an article spaced out with its word
                return f"a {key[1:]}"
        return self._decode(key)

    @lru_cache(maxsize=20_000)  # noqa: B019
    def _decode(self, key: str) -> str:
        lattice = self.lattice(key)
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in lattice:
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (p, done) in paths.items():
                for letters, q in options:
                    x, y, r = a, b, p + q
                    for c in letters:
                        z = ord(c) - 96 if "a" <= c <= "z" else 0
                        r += self.logp[x][y][z]
                        x, y = y, z
                    if step.get((x, y), (-1e99,))[0] < r:
                        step[(x, y)] = (r, done + letters)
            paths = step
        best, text = max((p + self.logp[a][b][0], done) for (a, b), (p, done) in paths.items())
        accepts = re.compile("".join("(?:" + "|".join(re.escape(x) for x, _ in o) + ")" for o in lattice))
        words = [w + e for w in HIDDEN for e in ("", "s") if accepts.fullmatch(w + e)]
        # A word of the list by its share and its own likelihood; letters of a plain word by the model alone.
        told = {w: self.word + self._channel(lattice, w) + 0.1 * self._likelihood(w) for w in words}
        known = max(told, key=lambda w: (told[w], w), default=None)
        return known if known is not None and told[known] - 0.1 * self._likelihood(known) > best + log(1 - HIDDEN_SHARE) else text

    def _likelihood(self, word: str) -> float:
        codes = [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 0 for c in word), 0]
        return sum(self.logp[x][y][z] for x, y, z in zip(codes, codes[1:], codes[2:], strict=False))

    @staticmethod
    def _channel(lattice: list[list[tuple[str, float]]], word: str) -> float:
        """The best log probability of the lattice's options that spell the word."""
        at = {0: 0.0}
        for options in lattice:
            step: dict[int, float] = {}
            for i, p in at.items():
                for letters, q in options:
                    if word.startswith(letters, i):
                        step[i + len(letters)] = max(step.get(i + len(letters), -1e99), p + q)
            at = step
        return at.get(len(word), -1e99)

    def restore(self, text: str) -> str:
        text = canonical(text).lower()
        text = _SPACED.sub(lambda m: self.decode(m.group()), text)
        if _SIGN_BESIDE_LETTER.search(text):
            text = _SIGNED.sub(lambda m: self.decode(m.group()), text)
        text = repeated_words(text, lambda w: self.decode(w) if w.isascii() else w)
        return _SPACED_DENSE.sub("", text) if not text.isascii() else text


_CLOSED = re.compile("[。 ]*(?:[!,;.！、]|$)")
_CALLED = re.compile(r"(?:^|[,:] )(?:\w+ ){0,2}$")
_DENSE = re.compile("[฀-๿ऀ-ॿ぀-ヿ一-鿿가-힣]")
_SENTENCE = re.compile(r"(?:[^.!?。！？।\n]|[.!?]+(?=[”’»\"\d])|[。！？]+(?=[”’」』]))+[.!?。！？।\n]*")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[str]] = {}
    for kind, words in LISTS.items():
        for w in words:
            for e in ENDINGS if kind in ("insult", "harm", "act", "lesser") and w.isascii() and " " not in w else ("",):
                found.setdefault(w + e, []).append(kind)
    out = ahocorasick.Automaton()
    for w, kinds in found.items():
        out.add_word(w, (len(w), bool(_DENSE.search(w)), tuple(kinds)))
    out.make_automaton()
    return out


def _hits(text: str) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """(start, end, lists) of the words of the lists; words of scripts with blanks stand alone."""
    for last, (n, dense, kinds) in _automaton().iter(text):
        a, b = last - n + 1, last + 1
        if dense or not (a and text[a - 1].isalnum() and not _DENSE.match(text[a - 1]) or b < len(text) and text[b].isalnum() and not _DENSE.match(text[b])):
            yield a, b, kinds


def _after(spans: list[tuple[int, int]], at: int, most: int, least: int = 0) -> Iterator[tuple[int, int]]:
    """Of spans in order, those that begin from `least` to `most` characters after a place."""
    k = bisect_left(spans, (at + least,))
    while k < len(spans) and spans[k][0] <= at + most:
        yield spans[k]
        k += 1


def _near(xs: list[tuple[int, int]], ys: list[tuple[int, int]], gap: int) -> bool:
    return any(True for x in xs for _ in _after(ys, x[1], gap, -1)) or any(True for y in ys for _ in _after(xs, y[1], gap, -1))


def features(sentence: str, hits: list[tuple[int, int, tuple[str, ...]]]) -> list[str]:
    """The names of the features of a sentence, from the words of the lists in it, in order."""
    by: dict[str, list[tuple[int, int]]] = {k: [] for k in LISTS}
    for a, b, kinds in hits:
        for k in kinds:
            by[k].append((a, b))
    insults, reach = [], -1
    for a, b in by["insult"]:  # a word inside a longer one is no word of its own
        if b > reach:
            insults.append((a, b))
            reach = b
    has = {k: bool(v) for k, v in by.items()}
    out = {k for k in ("said", "lesser", "act", "quoted", "friendly") if has[k]}
    # A literal sense speaks for what stands on its own side of a closed quotation.
    sides = [m.end() for m in re.finditer('[.!?…][”»"]', sentence)]
    side = lambda x: bisect_right(sides, x[0])
    if has["literal"] and {side(x) for x in by["literal"]} & {side(x) for k in ("insult", "act", "bare", "adjective") for x in by[k]}:
        out.add("literal")
    if insults:
        out.add("insult")
        if _near(insults, by["address"], 40):
            out.add("insult_addressed")
        ended = [(a, b) for a, b in insults if _CLOSED.match(sentence, b)]
        named = (has["said"] or has["adjective"] or has["harm"] and has["address"]) and any(_CALLED.search(sentence, max(0, a - 60), a) for a, _ in ended)
        if named or has["said"] and ended or re.search(r"\bonly an? (?:\w+ ){1,3}would\b", sentence):
            out.add("insult_called")
        if any(True for y in by["adjective"] for _ in _after(insults, y[1], 2)):
            out.add("insult_qualified")
    if has["adjective"]:
        out.add("qualified")
    if len(by["said"]) > 1:
        out.add("said_twice")
    wide = lambda x: bool(_DENSE.match(sentence[x[0]]))
    at_you = [h for h in by["harm"] if any(wide(h) == wide(y) for y in _after(by["address"], h[1], 26))]
    if at_you:
        out.add("harm_at_you")
    if has["harm"] and has["address"] and has["wish"]:
        out.add("harm_wished_you")
        if any(True for w in by["wish"] for _ in _after(at_you, w[1], 24)):
            out.add("harm_announced")
    if has["lesser"] and has["group"]:
        out.add("group_lesser")
    if len(set(by["lesser"])) > 1:
        out.add("lesser_twice")
    if has["harm"] and has["lesser"]:
        out.add("lesser_harm")
    wished = any(True for w in by["wish"] for _ in _after(by["harm"], w[1], 14, -2))
    if wished:
        out.add("harm_wished")
    if has["group"] and wished and not at_you and (has["insult"] or has["lesser"] or any(True for h in by["harm"] for _ in _after(by["group"], h[1], 40))):
        out.add("group_harm_wished")
    if has["act"] and has["bare"]:
        out.add("act_bare")
    if len(by["act"]) > 1:
        out.add("act_twice")
    if len(by["bare"]) > 2:
        out.add("bare_thrice")
    return sorted(out)


def sentences_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, features) of the sentences of a restored text."""
    hits = sorted(_hits(text), key=lambda h: (h[0], -h[1]))
    out, k = [], 0
    for m in _SENTENCE.finditer(text):
        a, b = m.span()
        own = []
        while k < len(hits) and hits[k][0] < b:
            if hits[k][0] >= a:
                own.append((hits[k][0] - a, hits[k][1] - a, hits[k][2]))
            k += 1
        out.append((a, b, features(text[a:b], own) if own else []))
    return out


def _grams(text: str) -> np.ndarray:
    """The hashed n-gram at every position."""
    return (kmer_hashes(text, GRAM) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


class Scorer:
    """A log-linear model of sentences."""

    def __init__(self, weights: np.ndarray = START, grams: np.ndarray | None = None) -> None:
        self.weights = dict(zip(NAMES, map(float, weights), strict=True))
        self.grams = grams

    def odds(self, text: str) -> list[tuple[float, list[str]]]:
        """The log odds and the features of every sentence of a restored text."""
        units = sentences_of(text)
        out = [self.weights["bias"] + sum(self.weights[f] for f in found) for _, _, found in units]
        if self.grams is not None and len(text) >= GRAM:
            sums = np.concatenate([[0.0], np.cumsum(self.grams[_grams(text)])])
            for i, (a, b, _) in enumerate(units):
                n = b - a - GRAM + 1
                if n > 0:
                    out[i] += float(sums[a + n] - sums[a]) / n**0.5
        return [(z, found) for z, (_, _, found) in zip(out, units, strict=True)]

    def score(self, text: str) -> tuple[float, list[str]]:
        """Of a restored text: its score and the kinds of language that its likeliest sentences hold."""
        best, kinds = 0.0, set()
        for z, found in self.odds(text):
            p = 1 / (1 + exp(-max(-30.0, min(30.0, z))))
            best = max(best, p)
            if p >= THRESHOLD:
                kinds |= {FEATURES[f][1] for f in found} - {""}
        return best, sorted(kinds)


def fit_scorer(rows: list[tuple[str, int, int]]) -> Scorer:
    """rows: restored text, votes for toxic, votes.

    By expectation maximisation, a document being toxic if any of its sentences is: how likely each is, from the model and the
    votes, whose two error rates are fitted too; then the weights from the sentences' shares.
    """
    column = {n: i for i, n in enumerate(NAMES)}
    units = [(d, found, _grams(text[a:b])) for d, (text, _, _) in enumerate(rows) for a, b, found in sentences_of(text)]
    if not units:
        return Scorer()
    doc = np.array([d for d, _, _ in units])
    toxic, votes = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    dense = np.zeros((len(units), len(NAMES)))
    dense[:, column["bias"]] = 1
    for i, (_, found, _) in enumerate(units):
        dense[i, [column[f] for f in found]] = 1
    # n-grams of all sentences one after another; a sentence's weigh 1 / sqrt(their number) each.
    size = np.array([len(g) for _, _, g in units])
    gram = np.concatenate([g for _, _, g in units])
    scale = 1 / np.sqrt(np.maximum(1, size))
    full = np.flatnonzero(size)
    begin = np.concatenate([[0], np.cumsum(size[full])[:-1]]).astype(np.int64)
    w, v = START.copy(), np.zeros(1 << GRAM_BITS)

    def odds() -> np.ndarray:
        z = dense @ w
        if len(full):
            z[full] += scale[full] * np.add.reduceat(v[gram], begin)
        return np.clip(z, -30, 30)

    spread = np.bincount(gram, np.repeat(scale**2, size), minlength=len(v))
    false, missed = VOTE_ERROR, VOTE_ERROR
    for _ in range(FIT_ROUNDS):
        single = 1 / (1 + np.exp(-odds()))
        any_of = np.clip(1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(single, 1 - 1e-12)), minlength=len(rows))), 1e-12, 1 - 1e-12)
        told = np.log(any_of / (1 - any_of)) + toxic * log((1 - missed) / false) + (votes - toxic) * log(missed / (1 - false))
        share = 1 / (1 + np.exp(-np.clip(told, -30, 30)))
        false = ((1 - share) @ toxic + VOTE_HOLD * VOTE_ERROR) / ((1 - share) @ votes + VOTE_HOLD)
        missed = (share @ (votes - toxic) + VOTE_HOLD * VOTE_ERROR) / (share @ votes + VOTE_HOLD)
        target = np.minimum(1.0, share[doc] * single / any_of[doc])
        for _ in range(FIT_STEPS):
            miss = target - 1 / (1 + np.exp(-odds()))
            step = 0.5 * (dense.T @ miss - HOLD * (w - START)) / (HOLD + 0.25 * dense.sum(0))
            step[column["bias"]] = 0.0  # stays: it sets what a sentence without any sign is worth, which labels of whole documents cannot tell
            w += step
            lift = 0.5 * (np.bincount(gram, np.repeat(scale * miss, size), minlength=len(v)) - GRAM_HOLD * v) / (GRAM_HOLD + 0.25 * spread)
            v += lift
            if max(np.abs(step).max(), np.abs(lift).max()) < SETTLED:
                break
    return Scorer(w, v)


def score_documents(documents: DataFrame, labels: DataFrame | None = None, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """documents: doc_id, text; labels: doc_id, toxic. Out: doc_id, score, kinds; every document with an id, once.

    The scorer is fitted to at most `fit_documents` labelled documents, those of the least hashes of their ids.
    """
    spark = documents.sparkSession
    counts = {r.trigram: r.n for r in trigram_counts(documents).collect()}  # at most 27 ** 3 rows
    restorer = Restorer(counts)
    scorer = Scorer()
    if labels is not None:
        votes = labels.where("doc_id is not null and toxic is not null").distinct().groupBy("doc_id").agg(F.sum(F.col("toxic").cast("int")).alias("toxic"), F.count("*").alias("votes"))
        sample = cut(votes.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents))
        texts = documents.join(sample, "doc_id").groupBy("doc_id", "toxic", "votes").agg(F.max("text").alias("text")).where("text is not null")
        scorer = fit_scorer([(restorer.restore(r.text), r.toxic, r.votes) for r in texts.orderBy("doc_id").collect()])  # at most fit_documents rows
    sent = spark.sparkContext.broadcast((restorer.logp, scorer))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Restorer({})
        reader.logp, model = sent.value
        for rows in batches:
            found = [model.score(reader.restore(t)) if t else (0.0, []) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": [s for s, _ in found], "kinds": [k for _, k in found]})

    scored = documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(judge, f"doc_id {kind}, score double, kinds array<string>")
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"), F.max_by("kinds", F.struct("score", "kinds")).alias("kinds"))
