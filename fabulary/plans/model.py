"""The seam for model-backed stages: a client called inside mapInPandas, batched, with recorded answers offline."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from fabulary.functions.jsontext import read


class ModelClient(Protocol):
    def answer(self, prompt: str) -> str: ...


class RecordedClient:
    """Answers by the prompt's hash; a prompt without a recording gets the fallback's answer."""

    def __init__(self, recordings: dict[str, str], fallback: Callable[[str], str] | None = None) -> None:
        self.recordings, self.fallback = recordings, fallback

    @staticmethod
    def key(prompt: str) -> str:
        return hashlib.sha256(prompt.encode()).hexdigest()

    def answer(self, prompt: str) -> str:
        found = self.recordings.get(self.key(prompt))
        return found if found is not None else self.fallback(prompt) if self.fallback else "{}"


def call_json(client: ModelClient, items: list[str], prompt: Callable[[list[str]], str]) -> list:
    """One JSON list of answers for a batch; a batch whose answer breaks off is halved and asked again."""
    how, value = read(client.answer(prompt(items)))
    got = value.get("items") if isinstance(value, dict) else value
    if isinstance(got, list) and len(got) == len(items):
        return got
    if len(items) <= 1:
        return [None] * len(items)
    half = len(items) // 2
    return call_json(client, items[:half], prompt) + call_json(client, items[half:], prompt)


def ask(rows: DataFrame, client: ModelClient) -> DataFrame:
    """rows: key, prompt. Out: key, how (how the answer could be read), response."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [client.answer(p) for p in batch["prompt"]]
            yield pd.DataFrame({"key": batch["key"], "how": [read(a)[0] for a in answers], "response": answers})

    return rows.select("key", "prompt").mapInPandas(run, f"key {kind}, how string, response string")
