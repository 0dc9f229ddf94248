"""Near-duplicate texts by Order MinHash, verified by banded alignment and exact shingle overlap.

A text is lower-cased and reduced to letters and digits; shorter ones than `least` are left out.
Exact copies of this form make one class, and everything after works on one representative of each.

Sketch: every k-mer is labelled with its occurrence number and hashed; the hash space is cut into
bins; in each bin the `ell` least hashes are kept in the order in which they stand in the text. Two
texts meet in a bin when they share these k-mers in the same order, which depends on edits and on
order, not on the mere set of k-mers. Candidates are texts that meet in at least one bin.

A hot bin, of more than `hot` texts, mostly holds a passage that many otherwise different texts share.
Its texts are not paired off. Each gives its rarest shingles instead, by counts over all texts of hot
bins: of n shingles the (1 - threshold) n + 1 rarest. Two texts over the threshold always share one of
them, so this loses no pair, and texts that share only the passage hardly meet.

Verification: the hash-sampled k-mers of both texts, in text order, are aligned within a band (the
longest common subsequence, bit-parallel). A pair under `aligned` is aligned once more in segments
that may each lie anywhere, so that moved blocks are recognised, and is rejected if it stays under.
Aligned candidates then pass the exact check: of the distinct runs of `shingle` characters in either
text, the given share must occur in both.

Nulls and short texts take no part; repeated rows of one id count once (of different texts under one
id the one with the least digest). The classes and the pairs of their representatives are the linear
result; `expand` turns them into all pairs of linked records, exact copies among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulary.session import cut

LEAST, SHINGLE, THRESHOLD, HOT = 400, 12, 0.6, 200
K, ELL, BIN_BITS = 24, 2, 5
SAMPLED, BAND, ALIGNED, SEGMENT = 128, 0.25, 0.5, 16
COUNT_BITS = 20

U = np.uint64
_BASE, _MULT = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * _MULT
    h = (h ^ (h >> U(32))) * _MULT
    return h ^ (h >> U(32))


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """The hash of every run of k characters, built by doubling."""
    run = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U) + U(1)
    n = len(run) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, done, power, width, rest = None, 0, np.array([_BASE]), 1, k
    while rest:
        if rest & 1:
            out = run[done : done + n] if out is None else out * power + run[done : done + n]
            done += width
        rest >>= 1
        if rest:
            run, power, width = run[:-width] * power + run[width:], power * power, 2 * width
    return mix(out)


def order_sketch(text: str, k: int = K, ell: int = ELL, bin_bits: int = BIN_BITS) -> np.ndarray:
    """One number per bin, from the bin's least labelled k-mers in text order."""
    hashes = kmer_hashes(text, k)
    bins = 1 << bin_bits
    if not len(hashes):
        return np.empty(0, U)
    in_bin = hashes << U(bin_bits)
    enough = 10 * ell * bins / len(hashes)  # so many survive per bin that its least ones are among them
    places = np.flatnonzero(in_bin < U(int(enough * 2.0**63) * 2)) if enough < 0.9 else np.arange(len(hashes))
    order = places[np.argsort(hashes[places], kind="stable")]
    ranked = hashes[order]
    again = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if again.any():
        at = np.arange(len(ranked))
        occurrence = (at - np.maximum.accumulate(np.where(again, 0, at))).astype(U)
        ranked = np.where(again, mix(ranked + occurrence * _BASE), ranked)
        resorted = np.argsort(ranked, kind="stable")
        ranked, order = ranked[resorted], order[resorted]
    number = np.arange(bins, dtype=U)
    first = np.searchsorted(ranked, number << U(64 - bin_bits))
    take = np.minimum(first[:, None] + np.arange(ell), len(ranked) - 1)
    kept = np.where((ranked[take] >> U(64 - bin_bits)) == number[:, None], ranked[take], U(0))
    kept = np.take_along_axis(kept, np.argsort(order[take], axis=1), 1)
    sketch = mix(number + U(1))
    for j in range(ell):
        sketch = mix(sketch * U(31) + kept[:, j])
    return sketch[(kept != 0).all(axis=1)]


def aligned_share(a: list[int], b: list[int], band: float | None) -> float:
    """Twice the longest common subsequence over both lengths; None: without a band."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, slope = (1 << len(a)) - 1, len(a) / len(b)
    width = len(a) if band is None else max(32, int(band * len(a)))
    window, row = (1 << (2 * width + 1)) - 1, full
    for j, x in enumerate(b):
        hit = places.get(x, 0)
        if hit and band is not None:
            low = int(j * slope) - width
            hit &= window << low if low >= 0 else window >> -low
        if hit:
            u = row & hit
            row = (row + u) | (row - u)
    return 2 * (len(a) - (row & full).bit_count()) / (len(a) + len(b))


def moved_share(a: list[int], b: list[int]) -> float:
    """The same with the shorter list cut into segments that may each lie anywhere in the other."""
    if len(a) > len(b):
        a, b = b, a
    hits = sum(aligned_share(part, b, None) * (len(part) + len(b)) / 2 for part in (a[i : i + SEGMENT] for i in range(0, len(a), SEGMENT)))
    return 2 * hits / (len(a) + len(b)) if a else 0.0


def sampled(hashes: np.ndarray, rate: int) -> list[int]:
    return hashes[hashes % U(rate) == 0].tolist()


class _Prepared(dict):
    """By text, its distinct shingles and all of them in order."""

    def __init__(self, shingle: int) -> None:
        self.shingle = shingle

    def __missing__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        hashes = kmer_hashes(text, self.shingle)
        if len(self) >= 64:
            self.clear()
        self[text] = value = (np.unique(hashes), hashes)
        return value


def similarity(a: tuple, b: tuple) -> tuple[float, float]:
    """The aligned share and the exact share of common shingles (0 where the alignment rejects the pair)."""
    rate = max(1, min(len(a[1]), len(b[1])) // SAMPLED)
    x, y = sampled(a[1], rate), sampled(b[1], rate)
    aligned = aligned_share(x, y, BAND)
    if aligned < ALIGNED:
        aligned = moved_share(x, y)
    if aligned < ALIGNED:
        return aligned, 0.0
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return aligned, common / max(1, len(a[0]) + len(b[0]) - common)


def rare_shingles(hashes: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """Of distinct shingles the rarest, as many as two texts over the threshold need to share one."""
    order = np.lexsort((hashes, counts[(hashes >> U(64 - COUNT_BITS)).astype(np.int64)]))
    return hashes[order[: len(hashes) - int(np.ceil(threshold * len(hashes) - 1e-9)) + 1]]


def _rare_pairs(texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """texts: record_kind, rep, plain. Pairs (record_kind, rep_a, rep_b) that share a rare shingle; every pair over the threshold is among them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for rows in batches:
            for t in rows["plain"]:
                total += np.bincount((np.unique(kmer_hashes(t, shingle)) >> U(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for r in texts.select("plain").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most 2 ** COUNT_BITS rows
        counts[r.bucket] = r.n
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            whole = [np.unique(kmer_hashes(t, shingle)) for t in rows["plain"]]
            yield pd.DataFrame({"record_kind": rows["record_kind"], "rep": rows["rep"], "size": [len(h) for h in whole], "keys": [rare_shingles(h, sent.value, threshold).view(np.int64) for h in whole]})

    keyed = cut(texts.mapInPandas(rare, "record_kind string, rep string, size long, keys array<long>")).select("record_kind", "rep", "size", F.explode("keys").alias("key"))
    met = keyed.alias("x").join(keyed.alias("y"), F.expr("x.key = y.key and x.record_kind = y.record_kind and x.rep < y.rep")).where(F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size") - 1e-9)
    return met.select("x.record_kind", F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b")).distinct()


def letters_and_digits(col):
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def near_duplicates(records: DataFrame, least: int = LEAST, shingle: int = SHINGLE, threshold: float = THRESHOLD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """records: record_kind, record_id string, text. Out: classes and pairs of class representatives.

    classes: record_kind, rep, record_id, copies (records in the class); pairs: record_kind, rep_a, rep_b, aligned,
    shared, for all representatives of one kind with shared >= threshold that the sketches bring together.
    """
    plain = records.where("record_id is not null and text is not null").select("record_kind", "record_id", letters_and_digits(F.col("text")).alias("plain")).where(F.char_length("plain") >= least)

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"record_kind": rows["record_kind"], "record_id": rows["record_id"], "digest": rows["digest"], "bins": [order_sketch(t).view(np.int64) for t in rows["plain"]]})

    sketched = cut(plain.withColumn("digest", F.unhex(F.md5("plain"))).mapInPandas(sketches, "record_kind string, record_id string, digest binary, bins array<long>"))
    one = sketched.groupBy("record_kind", "record_id").agg(F.min("digest").alias("digest"))
    reps = one.groupBy("record_kind", "digest").agg(F.min("record_id").alias("rep"), F.count("*").alias("copies"))
    classes = one.join(reps, ["record_kind", "digest"]).select("record_kind", "rep", "record_id", "copies")

    bands = sketched.groupBy("record_kind", "digest").agg(F.first("bins").alias("bins")).join(reps, ["record_kind", "digest"]).select(F.explode("bins").alias("bin"), "record_kind", "rep")
    size = bands.groupBy("record_kind", "bin").agg(F.count("*").alias("texts")).where("texts > 1")
    shared = cut(bands.join(size, ["record_kind", "bin"]))
    cold = shared.where(F.col("texts") <= hot)
    pairs = cold.alias("x").join(cold.alias("y"), F.expr("x.bin = y.bin and x.record_kind = y.record_kind and x.rep < y.rep"))
    pairs = pairs.select("x.record_kind", F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b"))
    warm = shared.where(F.col("texts") > hot).select("record_kind", "rep").distinct()
    if not warm.isEmpty():
        crowd = plain.join(warm.withColumnRenamed("rep", "record_id"), ["record_kind", "record_id"], "left_semi").groupBy("record_kind", F.col("record_id").alias("rep")).agg(F.min_by("plain", F.unhex(F.md5("plain"))).alias("plain"))
        pairs = pairs.unionByName(_rare_pairs(cut(crowd), shingle, threshold))
    pairs = cut(pairs.distinct())

    wanted = pairs.select("record_kind", F.explode(F.array("rep_a", "rep_b")).alias("record_id")).distinct()
    texts = plain.join(wanted, ["record_kind", "record_id"], "left_semi").groupBy("record_kind", "record_id").agg(F.min_by("plain", F.unhex(F.md5("plain"))).alias("plain"))
    a = texts.select("record_kind", F.col("record_id").alias("rep_a"), F.col("plain").alias("text_a"))
    b = texts.select("record_kind", F.col("record_id").alias("rep_b"), F.col("plain").alias("text_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = _Prepared(shingle)
        for rows in batches:
            found = [similarity(ready[x], ready[y]) for x, y in zip(rows["text_a"], rows["text_b"], strict=True)]
            out = rows[["record_kind", "rep_a", "rep_b"]].assign(aligned=[x for x, _ in found], shared=[x for _, x in found])
            yield out[out["shared"] >= threshold]

    checked = pairs.join(a, ["record_kind", "rep_a"]).join(b, ["record_kind", "rep_b"]).mapInPandas(verify, "record_kind string, rep_a string, rep_b string, aligned double, shared double")
    return classes, checked


def expand(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """record_kind, id_a, id_b with id_a < id_b: all pairs of records of one class or of linked classes."""
    side = lambda n: classes.select("record_kind", F.col("rep").alias(f"rep_{n}"), F.col("record_id").alias(n))
    across = pairs.select("record_kind", "rep_a", "rep_b").join(side("a"), ["record_kind", "rep_a"]).join(side("b"), ["record_kind", "rep_b"]).select("record_kind", "a", "b")
    many = classes.where("copies > 1")
    within = many.alias("x").join(many.alias("y"), F.expr("x.record_kind = y.record_kind and x.rep = y.rep and x.record_id < y.record_id")).select("x.record_kind", F.col("x.record_id").alias("a"), F.col("y.record_id").alias("b"))
    return across.unionByName(within).select("record_kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
