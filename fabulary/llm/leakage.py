"""Passages of held-out items inside documents, by SimHash windows and multi-index Hamming blocks.

Items and documents are brought to one form (canonical characters, lower case, letters and digits
only). A run of `need` characters of an item holds one of the item's windows of need / 2 characters
laid end to end, so the item is fingerprinted by those windows and a document by the window at every
position. A fingerprint is the SimHash of a window's shingles; sums over windows come from running
sums of the shingles' bits, `STRETCH` positions at a time, so a long document costs no more memory
than a short one. Windows of which less than a `similar` share of the shingles stands in any item
could never pass the verification below, and are not fingerprinted. Fingerprints within `radius` bits are found through radius + 1 blocks of
bits: of two such fingerprints one block is equal, so no pair within the radius is missed. A
candidate is verified by the exact weighted similarity of the two windows' shingles (weights: how few
item windows hold the shingle), and its longest common run with the item is measured around it.

The items are the stated query set. They are sent to the workers in blocks of at most `block_windows`
windows of either width, one pass over the documents per block, so what is broadcast has a fixed bound. Documents
are never shuffled; only hits are. Nulls and texts shorter than a window give nothing; repeated rows
count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulary.llm.neardup import kmer_hashes
from fabulary.llm.normalize import canonical

NEED, NEED_DENSE, DENSE_LANGS = 60, 30, ("ko", "ja")
SHINGLE, RADIUS, SIMILAR, BLOCK_WINDOWS, STRETCH, KNOWN_BITS = 4, 3, 0.8, 50_000, 1 << 15, 20

U = np.uint64
_NOT_PLAIN = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    return _NOT_PLAIN.sub("", canonical(text).lower())


def window_prints(hashes: np.ndarray, per: int) -> np.ndarray:
    """The SimHash of every run of `per` shingle hashes."""
    n = len(hashes) - per + 1
    if n <= 0:
        return np.empty(0, U)
    sums = np.zeros((n + per, 64), np.int32)
    np.cumsum(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=sums[1:], dtype=np.int32)
    return np.packbits((sums[per:] - sums[:-per]) * 2 > per, axis=1).view(U).ravel()


class Index:
    """Item windows of one width."""

    def __init__(self, width: int, need: int, rows: list[tuple[int, str]], radius: int) -> None:
        self.width, self.need, self.radius, self.rows, self.per = width, need, radius, rows, width - SHINGLE + 1
        windows = [(k, m) for k, (_, text) in enumerate(rows) for m in range(0, len(text) - width + 1, width)]
        self.row, self.at = np.array([k for k, _ in windows], np.int64), np.array([m for _, m in windows], np.int64)
        hashed = [kmer_hashes(rows[k][1][m : m + width], SHINGLE) for k, m in windows]
        self.prints = np.array([window_prints(h, self.per)[0] for h in hashed], U)
        self.known = np.zeros(1 << KNOWN_BITS, bool)  # of shingles in item windows; others that fall together with one only cost time
        if hashed:
            self.known[(np.concatenate(hashed) >> U(64 - KNOWN_BITS)).astype(np.int64)] = True
        spread = Counter(s for k, m in windows for s in self._shingles(rows[k][1][m : m + width]))
        self.weight = {s: 1 + log((1 + len(windows)) / (1 + n)) for s, n in spread.items()}
        self.rare = 1 + log(1 + len(windows))
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            keys = self._block(self.prints, int(lo), int(hi))
            order = np.argsort(keys, kind="stable")
            here = np.zeros(1 << (hi - lo), bool)
            here[keys.astype(np.int64)] = True
            self.blocks.append((int(lo), int(hi), here, keys[order], order))

    @staticmethod
    def _block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return prints >> U(lo) & U((1 << (hi - lo)) - 1)

    @staticmethod
    def _shingles(text: str) -> Counter:
        return Counter(text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and item windows within the radius, each pair once."""
        found = []
        for lo, hi, here, keys, order in self.blocks:
            block = self._block(prints, lo, hi)
            at = np.flatnonzero(here[block.astype(np.int64)])
            if not len(at):
                continue
            first, last = np.searchsorted(keys, block[at], "left"), np.searchsorted(keys, block[at], "right")
            n = last - first
            where = np.repeat(at, n)
            which = order[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[where] ^ self.prints[which]) <= self.radius
            found.append(where[near] * len(self.prints) + which[near])
        both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))

    def similarity(self, a: str, b: str) -> float:
        x, y = self._shingles(a), self._shingles(b)
        weight = lambda s: self.weight.get(s, self.rare)
        common = sum(min(n, y[s]) * weight(s) for s, n in x.items() if s in y)
        return common / (sum(n * weight(s) for s, n in x.items()) + sum(n * weight(s) for s, n in y.items()) - common)

    def near(self, text: str) -> Iterator[tuple[int, int]]:
        """(position, item window) of all candidates, stretch by stretch, in order of position."""
        for lo in range(0, len(text) - self.width + 1, STRETCH):
            hashes = kmer_hashes(text[lo : lo + STRETCH + self.width - 1], SHINGLE)
            seen = np.zeros(len(hashes) + 1, np.int32)
            np.cumsum(self.known[(hashes >> U(64 - KNOWN_BITS)).astype(np.int64)], out=seen[1:])
            at = np.flatnonzero(seen[self.per :] - seen[: -self.per] >= SIMILAR * self.per - 1e-9)
            for part in np.split(at, np.flatnonzero(np.diff(at) > self.per) + 1) if len(at) else ():
                first = int(part[0])
                prints = window_prints(hashes[first : int(part[-1]) + self.per], self.per)[part - first]
                where, which = self.candidates(prints)
                yield from zip((lo + part[where]).tolist(), which.tolist(), strict=True)

    def matches(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(item, longest common run around a verified window, similarity), the best of each item."""
        best: dict[int, tuple[int, float]] = {}
        covered: dict[tuple[int, int], int] = {}
        for p, w in self.near(text):
            k, m = int(self.row[w]), int(self.at[w])
            item, passage = self.rows[k]
            if covered.get((k, p - m), -1) >= p:
                continue
            alike = self.similarity(text[p : p + self.width], passage[m : m + self.width])
            if alike < SIMILAR:
                continue
            run = 0
            if text.startswith(passage[m : m + self.width], p):
                a, b = 0, self.width
                while p + a > 0 and m + a > 0 and text[p + a - 1] == passage[m + a - 1]:
                    a -= 1
                while p + b < len(text) and m + b < len(passage) and text[p + b] == passage[m + b]:
                    b += 1
                run, covered[(k, p - m)] = b - a, p + b
            best[item] = max(best.get(item, (0, 0.0)), (run, alike))
        for item, (run, alike) in best.items():
            yield item, run, alike


def leaks(documents: DataFrame, items: DataFrame, need: int = NEED, need_dense: int = NEED_DENSE, dense_langs: tuple[str, ...] = DENSE_LANGS, radius: int = RADIUS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """documents: doc_id, text; items: item_id, lang, passage. Out: doc_id, item_id, run, similarity, complete.

    One row for every document and item with a verified window; run is 0 where the windows are alike
    but not equal; complete: a run of at least `need` (`need_dense` for `dense_langs`) characters.
    """
    spark = documents.sparkSession
    kinds: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for r in items.select("item_id", "lang", "passage").where("item_id is not null and passage is not null").distinct().orderBy("item_id", "passage").toLocalIterator():
        n = need_dense if r.lang in dense_langs else need
        kinds.setdefault((n // 2, n), []).append((r.item_id, plain(r.passage)))
    blocks: list[list[Index]] = []
    held = block_windows
    for (width, n), rows in kinds.items():
        part: list[tuple[int, str]] = []
        for row in rows:
            if len(row[1]) < width:
                continue
            if held >= block_windows:
                if part:
                    blocks[-1].append(Index(width, n, part, radius))
                part, held = [], 0
                blocks.append([])
            part.append(row)
            held += len(row[1]) // width
        if part:
            blocks[-1].append(Index(width, n, part, radius))
    out_type = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, run int, similarity double, complete boolean"
    out = spark.createDataFrame([], out_type)
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for rows in batches:
                found = []
                for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                    flat = plain(text)
                    for index in sent.value:
                        found += [(doc, item, run, alike, run >= index.need) for item, run, alike in index.matches(flat)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "run", "similarity", "complete"])

        out = out.unionByName(texts.mapInPandas(search, out_type))
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("similarity").alias("similarity"), F.max("complete").alias("complete"))
