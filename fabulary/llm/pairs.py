"""Defects of prompt and response pairs, by ordered rules.

In this order: `empty` (nothing beyond blanks, fences or an empty JSON value, null included),
`prompt_copy` (the response's own text is the prompt or its passage), `refusal` (its own wording
declines the task), `truncated` (unclosed JSON, or a last sentence that breaks off), and
`wrong_language` (its own wording is not in the language that the prompt asks for). Every rule that
fires is emitted with its rank; the first is the trial's defect.

Own wording of a JSON response is its string values without those under keys that hold quotations,
names or labels. A null prompt can have neither a copy nor a language. Repeated rows count once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from fabulary.llm.normalize import canonical

ORDER = ["empty", "prompt_copy", "refusal", "truncated", "wrong_language"]
COPY_RUN, COPY_SHARE, COPY_LEAST = 12, 0.8, 20

_QUOTED_KEYS = re.compile(r"evidence|quote|span|type|_id$|^id$|pid|confidence|source", re.I)
_FENCE = re.compile(r"^\s*```[A-Za-z]*|```\s*$")
_PLAIN = re.compile(r"[\W_]+")
_JSON_START = re.compile(r'\{|\[\s*(?:["\[{\]]|-?\d|true|false|null|$)')

# How assistants decline, by language.
REFUSALS = re.compile(
    r"\bi(?:['’]m| am) (?:sorry|afraid|not able|unable)|\bi (?:must|have to) decline|\bi (?:cannot|can['’]t|won['’]t|will not|am unable to)\b.{0,30}\b(?:assist|help|do|complete|comply|provide|produce|discuss|answer|continue)"
    r"|\bsorry, (?:this|i|but)|something i can['’]t do|consult the publisher|\bas an? (?:language|ai)\b|guidelines (?:do not|don['’]t) allow|against (?:the|my|our) (?:content )?polic|unable to (?:help|assist|comply|complete)"
    r"|won['’]t be able to|désolée?,|je ne (?:peux|suis) pas (?:répondre|en mesure|traiter|vous aider|aider|autorisée?)|je suis dans l['’]impossibilité|je refuse de|"
    r"\bleider (?:kann|darf)|\bich (?:kann|darf) (?:diese|dabei|das|ihnen|dir|hierbei|darauf|den|die)\b.{0,60}\bnicht|es tut mir leid|tut mir leid,|lo siento,|no puedo (?:ayudar|responder|cumplir|procesar|atender|analizar)|no me es posible"
    r"|죄송하지만|죄송합니다|도와드릴 수 없|처리할 수 없|답변(?:해 드릴|할) 수 없|정책상|申し訳(?:ありません|ございません)|お応えできません|お答えできません|対応できません|ご依頼には|抱歉|对不起|无法(?:处理|回答|协助|完成|满足|提供)|不能(?:协助|回答)"
    r"|ขออภัย|ขอโทษ|ไม่สามารถ|क्षमा कर|माफ़ कर|माफ कर|खेद है|मैं (?:इस|यह|आपकी).{0,40}(?:नहीं|असमर्थ)|सहायता नहीं कर",
    re.I,
)
# Frequent words that only one of these languages has.
WORDS = {
    "English": "the of and was in had it at to for with that not is were has this he she they before after on by as a an".split(),
    "French": "le la les une un des du au aux et est dans sur pas pour qui que avec sans avait il elle ne plus pourquoi quel quelle sous où cet cette entre près je tu nous vous à".split(),
    "German": "der die das den dem und ist nicht mit war ein eine einen einem zu von im am auf vor nach bei warum hat wir ich ohne weil unter hinter zwischen jenseits diesen jemand niemand".split(),
    "Spanish": "el la los las un una y en no con por que del al de se su más para porque qué lo entre había hay es tan bajo sin hacia".split(),
}
_WORDS = {k: frozenset(v) for k, v in WORDS.items()}
_ASKED = re.compile(r"\b(?:in|auf|en) (English|French|German|Spanish|Korean|Japanese|Chinese|Thai|Hindi)\b")
_SCRIPTS = {"Korean": re.compile("[가-힣]"), "Japanese": re.compile("[ぁ-ゖァ-ヺー]"), "Chinese": re.compile("[一-鿿]"), "Thai": re.compile("[ก-๛]"), "Hindi": re.compile("[ऀ-ॿ]")}
# How many Latin letters say what one sign of a script says; names in another script are not to outweigh a wording.
_LETTERS_PER_SIGN = {"Chinese": 3, "Japanese": 3, "Korean": 2}
_ABRUPT = re.compile(r"(?:^|[\s“„«(])(?:Dr|Mr|Mrs|Ms|St|Hr|Fr|Mme|Sr|Sra|Dra|No|vol|p|pág|art|cf|z|B|d|h|e|i|g|ej|a|[A-Z]|\d+)\.$")
_ENDED = re.compile(r"[.!?。！？।॥][\"'”’»“)\]」』]*$|[.!?。！？।…][\"'”’»“)\]」』]+$")


def bare(response: str) -> str:
    """The response without fences, blanks and invisible characters around it."""
    text, last = canonical(response), None
    while text != last:
        last, text = text, _FENCE.sub("", text).strip()
    return text


def own_values(value, key: str = "") -> list[str]:
    if isinstance(value, str):
        return [] if _QUOTED_KEYS.search(key) else [value]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in own_values(v, k)]
    return [x for v in value for x in own_values(v, key)] if isinstance(value, list) else []


def unclosed(text: str) -> bool:
    """Are there brackets or a string of a JSON text that are never closed?"""
    depth, inside, escaped = 0, False, False
    for c in text:
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return inside or depth > 0


def _loose_values(text: str) -> list[str]:
    """String literals that are not keys, of a text that does not parse."""
    out = []
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)("?)(\s*:)?', text):
        key = re.findall(r'"(\w+)"\s*:\s*\[?[^"]*$', text[: m.start()][-80:])
        if not m[3] and not (key and _QUOTED_KEYS.search(key[-1])):
            out.append(m[1])
    return out


def language(words: str) -> str | None:
    """The language of a wording; names, that is capitalised words, count for no script."""
    kept = re.sub(r"\b[A-ZÀ-Þ][\w'’-]*", " ", words)
    latin = len(re.findall(r"[a-zà-ÿß]", kept))
    counts = {k: len(p.findall(words)) for k, p in _SCRIPTS.items()}
    if counts["Japanese"]:
        counts["Japanese"] += counts.pop("Chinese")
    most = max(counts, key=counts.get)
    if counts[most] * _LETTERS_PER_SIGN.get(most, 1) > latin and counts[most] > 1:
        return most
    found = re.findall(r"[a-zà-ÿß]+", words.lower())
    scores = {k: sum(w in v for w in found) for k, v in _WORDS.items()}
    scores["French"] += 2 * len(re.findall(r"[«] |\b[ldnjmsc]'|[êèùœ]", words.lower()))
    scores["German"] += 2 * len(re.findall(r"[ßäöü]|„", re.sub(r"\b[A-ZÀ-Þ][\w'’-]*", " ", words)))
    scores["Spanish"] += 2 * len(re.findall(r"[¿¡ñ]", words.lower()))
    best = max(scores, key=scores.get)
    return best if scores[best] and sorted(scores.values())[-2] < scores[best] else None


def _copied(own: str, prompt: str) -> bool:
    flat, source = _PLAIN.sub("", own.lower()), _PLAIN.sub("", canonical(prompt).lower())
    if len(flat) < COPY_LEAST:
        return False
    if flat in source:
        return True
    runs = {source[i : i + COPY_RUN] for i in range(len(source) - COPY_RUN + 1)}
    n = len(flat) - COPY_RUN + 1
    return sum(flat[i : i + COPY_RUN] in runs for i in range(n)) >= COPY_SHARE * n


def _declines(own: str) -> bool:
    sentences = [s for s in re.split(r"(?<=[.!?。！？।])\s*", own.strip()) if len(_PLAIN.sub("", s)) > 2]
    if not sentences or re.match(r"[“„«「\"]", sentences[0]):
        return False
    hits = [bool(REFUSALS.search(s)) for s in sentences]
    return hits[0] and 2 * sum(hits) >= len(hits)


def defects(prompt: str | None, response: str | None) -> list[str]:
    """All defects of one trial, in the order of the rules."""
    text = bare(response or "")
    try:
        value, parsed = json.loads(text), True
    except ValueError:
        value, parsed = None, False
    if not text or parsed and (value is None or value == "" or value == [] or value == {} or isinstance(value, str) and not bare(value)):
        return ["empty"]
    looks_json = bool(_JSON_START.match(text))
    parts = own_values(value) if parsed else _loose_values(text) if looks_json else [text]
    own = " ".join(parts)
    out = []
    copied = prompt is not None and _copied(own, prompt)
    if copied:
        out.append("prompt_copy")
    if _declines(own):
        out.append("refusal")
    if looks_json and not parsed:
        if unclosed(text):
            out.append("truncated")
    else:
        last = next((p.rstrip() for p in reversed(parts) if p.strip()), "")
        spaceless = re.search("[฀-๿]", last[-3:])
        if last and not spaceless and (not _ENDED.search(last) or last.endswith("...") or _ABRUPT.search(last)):
            out.append("truncated")
    asked = prompt and _ASKED.search(prompt)
    if asked:
        spoken = language(own)
        if spoken and spoken != asked[1]:
            out.append("wrong_language")
    return out


def flag_pairs(trials: DataFrame) -> DataFrame:
    """trials: trial_key, prompt, raw_response. Out: trial_key, defect, rank (1 = first rule that fired), distinct."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(key, d, k + 1) for key, p, r in zip(rows["trial_key"], rows["prompt"], rows["raw_response"], strict=True) for k, d in enumerate(defects(p, r))]
            yield pd.DataFrame(found, columns=["trial_key", "defect", "rank"])

    kind = trials.schema["trial_key"].dataType.simpleString()
    return trials.select("trial_key", "prompt", "raw_response").where("trial_key is not null").mapInPandas(judge, f"trial_key {kind}, defect string, rank int").distinct()
