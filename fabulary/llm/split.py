"""Oversized texts cut into overlapping pieces at natural boundaries, by byte ranges.

A text (a row, or a file too large for one worker) is seen as UTF-8 bytes cut into ranges. A worker
gets one range with a halo of bytes on both sides and never the whole text. It marks boundaries by
looking at five characters at a time, so two workers that see the same place mark it alike. The
strongest boundary in the first stretch of a range is that range's section start; its neighbour
finds the same one in its halo, so pieces can be laid out from one section start to the next without
talking to anyone. Each range reports its length in characters and its pieces by local offset; a
running sum over these small rows stitches them to offsets and piece numbers of the whole text; the
ranges are then read once more and the pieces emitted by offset. A text of a single range needs no
neighbour: it is laid out and emitted where it lies, and only the boundary rows of it are shuffled.

Strength of a boundary: line break, end of sentence, end of clause, blank, change of letter case or
kind, any place that does not part a base character from its marks.

Results: every piece has at most `limit` characters; piece k + 1 starts `overlap` characters before
piece k ends; the pieces without their overlaps joined in order are the text. A text of at most
`limit` characters is one piece. Null texts and ids give no piece; the empty text gives none either.
Repeated rows of one id count once (of different texts under one id the one with the least digest).
Other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP, RANGE_BYTES = 1200, 120, 1 << 16

# Kinds of characters.
OTHER, LINE, BLANK, END, WIDE_END, CLOSE, CLAUSE, WIDE_CLAUSE, MARK, UPPER, LOWER, DIGIT = range(12)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.zeros(0x10000, np.uint8)
    for p in range(0x10000):
        c = chr(p)
        category = unicodedata.category(c)
        if c in "\n\r  ":
            kinds[p] = LINE
        elif c.isspace():
            kinds[p] = BLANK
        elif c in ".!?…":
            kinds[p] = END
        elif c in "。！？।॥｡":
            kinds[p] = WIDE_END
        elif c in "\"'”’»“)]」』":
            kinds[p] = CLOSE
        elif c in ",:—–":
            kinds[p] = CLAUSE
        elif c in ";、，；：､":
            kinds[p] = WIDE_CLAUSE
        elif category in ("Mn", "Mc", "Me", "Cf") or 0xDC00 <= p < 0xE000 or 0x1160 <= p < 0x1200 or c in "ะาำๅ":
            kinds[p] = MARK
        elif category in ("Lu", "Lt"):
            kinds[p] = UPPER
        elif category == "Ll":
            kinds[p] = LOWER
        elif category[0] == "N":
            kinds[p] = DIGIT
    return kinds


def strengths(text: str) -> np.ndarray:
    """At p, how natural it is to cut before character p (p = 0 .. length); -1 where a mark follows."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.concatenate([[LINE] * 4, _kinds()[np.minimum(points, 0xFFFF)], [LINE]]).astype(np.uint8)
    far, left, right = kinds[2:-2], kinds[3:-1], kinds[4:]
    short = np.isin(kinds[1:-3], (BLANK, END)) | np.isin(kinds[:-4], (BLANK, END))  # as after an abbreviation
    out = np.zeros(len(points) + 1, np.int8)
    case = (left == LOWER) & (right == UPPER) | (left == DIGIT) != (right == DIGIT)
    out[case] = 1
    blank = (left == BLANK) & (right != BLANK)
    out[blank] = 2
    out[blank & np.isin(far, (CLAUSE, WIDE_CLAUSE)) | (left == WIDE_CLAUSE) & (right != BLANK)] = 3
    ended = blank & np.isin(far, (END, WIDE_END, CLOSE)) & (right != LOWER)
    out[ended] = 3
    ended &= (far != END) | ~short
    ended |= (left == WIDE_END) & ~np.isin(right, (WIDE_END, CLOSE, BLANK)) | (left == CLOSE) & (far == WIDE_END) & ~np.isin(right, (CLOSE, BLANK, CLAUSE))
    out[ended] = 4
    out[(left == LINE) & (right != LINE)] = 5
    out[right == MARK] = -1
    return out


def _best(strength: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """The last of the strongest places in [lo, hi], and its strength."""
    part = strength[lo : hi + 1][::-1]
    at = int(part.argmax())
    return hi - at, int(part[at])


def lay_out(strength: np.ndarray, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) that cover [start, end)."""
    pieces = []
    while end - start > limit:
        cut, how = _best(strength, start + max(limit // 2, overlap + 1), start + limit)
        if how < 2:
            early, natural = _best(strength, start + overlap + 1, start + max(limit // 2, overlap + 1))
            if natural >= 2:
                cut = early
        pieces.append((start, cut))
        start = cut - overlap
    pieces.append((start, end))
    return pieces


def _open(chunk: bytes, at: int, own_start: int, own_end: int) -> tuple[str, int, int]:
    """The text of a chunk that starts at byte `at`, and its characters before and in the own range."""
    raw = np.frombuffer(chunk, np.uint8)
    heads = (raw & 0xC0) != 0x80
    first = int(heads.argmax()) if heads.any() else len(raw)
    text = chunk[first:].decode("utf-8", "ignore")
    before = int(heads[: max(0, own_start - at)].sum())
    return text, before, int(heads[max(0, own_start - at) : max(0, own_end - at)].sum())


def range_pieces(chunk: bytes, at: int, own_start: int, own_end: int, size: int, limit: int, overlap: int) -> tuple[int, list[tuple[int, int]]]:
    """Characters of the own range, and its pieces by offsets from its first character."""
    text, before, own = _open(chunk, at, own_start, own_end)
    strength = strengths(text)

    def section(first: int) -> int:
        return _best(strength, first, min(first + limit, len(text)))[0]

    start = 0 if own_start == 0 else section(before) - overlap
    if own_end >= size:
        end = len(text)
    else:
        end = section(before + own)
    return own, [(a - before, b - before) for a, b in lay_out(strength, start, end, limit, overlap)]


def _ranges(items: DataFrame, range_bytes: int, halo: int) -> DataFrame:
    """items: item, size. Out: one row per range with the bytes to read."""
    lo, hi = F.col("range_no") * range_bytes, (F.col("range_no") + 1) * range_bytes
    at = F.greatest(F.lit(0), lo - halo)
    return items.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / range_bytes) - 1).cast("long")))).withColumns(
        {"own_start": lo, "own_end": F.least(F.col("size"), hi), "at": at, "take": F.least(F.col("size"), hi + halo) - at}
    )


def _check(limit: int, overlap: int, range_bytes: int) -> int:
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    if range_bytes < 8 * limit:
        raise ValueError("a range must hold at least eight times the limit")
    return 4 * (2 * limit + overlap + 8)


def _stitch(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """chunks: item, range_no, at, own_start, own_end, size, take, chunk. Out: the boundary table, stitched."""

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [range_pieces(*x, limit, overlap) for x in zip(rows["chunk"], rows["at"], rows["own_start"], rows["own_end"], rows["size"], strict=True)]
            kept = rows[["item", "size", "range_no", "own_start", "own_end", "at", "take"]]
            yield kept.assign(n_chars=[n for n, _ in found], starts=[[a for a, _ in p] for _, p in found], ends=[[b for _, b in p] for _, p in found])

    item = chunks.schema["item"].dataType.simpleString()
    local = chunks.select("item", "size", "range_no", "own_start", "own_end", "at", "take", "chunk").mapInPandas(detect, f"item {item}, size long, range_no long, own_start long, own_end long, at long, take long, n_chars long, starts array<long>, ends array<long>")
    before = Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return local.withColumns({"chars_before": F.coalesce(F.sum("n_chars").over(before), F.lit(0)), "pieces_before": F.coalesce(F.sum(F.size("starts")).over(before), F.lit(0))})


def _emit(stitched: DataFrame) -> DataFrame:
    """stitched: the boundary table with the chunk of every range."""

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for x in rows.itertuples():
                text, before, _ = _open(x.chunk, x.at, x.own_start, x.own_end)
                out += [(x.item, x.pieces_before + k, x.chars_before + a, x.chars_before + b, text[before + a : before + b]) for k, (a, b) in enumerate(zip(x.starts, x.ends, strict=True))]
            yield pd.DataFrame(out, columns=["item", "piece_no", "start_char", "end_char", "piece"])

    item = stitched.schema["item"].dataType.simpleString()
    return stitched.mapInPandas(cut_out, f"item {item}, piece_no long, start_char long, end_char long, piece string")


def _items(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null and text <> ''")


def _text_chunks(items: DataFrame, range_bytes: int, halo: int) -> DataFrame:
    """items: item, text, each item once."""
    chunk = F.substring(F.col("raw"), (F.col("at") + 1).cast("int"), F.col("take").cast("int"))
    return _ranges(items.select("item", F.encode(F.col("text"), "UTF-8").alias("raw")).withColumn("size", F.length("raw").cast("long")), range_bytes, halo).withColumn("chunk", chunk).drop("raw")


def _once(items: DataFrame) -> DataFrame:
    """Every item once; only texts of repeated items are shuffled."""
    repeated = items.groupBy("item").agg(F.count("*").alias("rows")).where("rows > 1").select("item")
    best = items.join(repeated, "item", "left_semi").groupBy("item").agg(F.min_by("text", F.md5("text")).alias("text"))
    return items.join(repeated, "item", "left_anti").unionByName(best)


def _one_range(range_bytes: int):
    return F.octet_length("text") <= range_bytes


def boundary_table(texts: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """item, range_no, n_chars, starts, ends, chars_before, pieces_before: where the pieces will lie. No text of one range is shuffled."""
    halo = _check(limit, overlap, range_bytes)
    items = _items(texts, id_col, text_col)
    cols = ["item", "range_no", "n_chars", "starts", "ends", "chars_before", "pieces_before"]
    item = items.schema["item"].dataType.simpleString()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            laid = [lay_out(strengths(t), 0, len(t), limit, overlap) if len(t) > limit else [(0, len(t))] for t in rows["text"]]
            yield pd.DataFrame({"item": rows["item"], "digest": rows["digest"], "n_chars": rows["text"].str.len(), "starts": [[a for a, _ in p] for p in laid], "ends": [[b for _, b in p] for p in laid]})

    digest = F.md5("text").alias("digest")
    small = items.where(_one_range(range_bytes)).select("item", "text", digest).mapInPandas(whole, f"item {item}, digest string, n_chars long, starts array<long>, ends array<long>")
    large = items.where(~_one_range(range_bytes))
    kept = small.unionByName(large.select("item", digest), allowMissingColumns=True).groupBy("item").agg(F.min_by(F.struct("n_chars", "starts", "ends"), "digest").alias("b"))
    zero = F.lit(0).cast("long")
    one = kept.where("b.starts is not null").select("item", zero.alias("range_no"), "b.*", zero.alias("chars_before"), zero.alias("pieces_before"))
    many = _once(items.join(kept.where("b.starts is null").select("item"), "item", "left_semi").where(~_one_range(range_bytes)))
    return one.select(*cols).unionByName(_stitch(_text_chunks(many, range_bytes, halo), limit, overlap).select(*cols))


def split_texts(texts: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """item, piece_no (from 0), start_char, end_char, piece, for every text of the table."""
    halo = _check(limit, overlap, range_bytes)
    items = _once(_items(texts, id_col, text_col))
    item = items.schema["item"].dataType.simpleString()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, t in zip(rows["item"], rows["text"], strict=True):
                out += [(i, k, a, b, t[a:b]) for k, (a, b) in enumerate(lay_out(strengths(t), 0, len(t), limit, overlap) if len(t) > limit else [(0, len(t))])]
            yield pd.DataFrame(out, columns=["item", "piece_no", "start_char", "end_char", "piece"])

    small = items.where(_one_range(range_bytes)).mapInPandas(whole, f"item {item}, piece_no long, start_char long, end_char long, piece string")
    chunks = _text_chunks(items.where(~_one_range(range_bytes)), range_bytes, halo)
    return small.unionByName(_emit(_stitch(chunks, limit, overlap).join(chunks.select("item", "range_no", "chunk"), ["item", "range_no"])))


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 32 << 20) -> DataFrame:
    """The same for the UTF-8 text files at `path`; workers read byte ranges, never a whole file."""
    halo = _check(limit, overlap, range_bytes)
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("item"), F.col("length").alias("size")).where("size > 0")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for rows in batches:
            for k in range(len(rows)):
                row = rows.iloc[k : k + 1].copy()
                uri = row["item"].iat[0]
                where, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                with where.open_input_file(name) as f:
                    f.seek(int(row["at"].iat[0]))
                    row["chunk"] = [f.read(int(row["take"].iat[0]))]
                yield row

    place = "item string, size long, range_no long, own_start long, own_end long, at long, take long"
    ranges = _ranges(listed, range_bytes, halo).select("item", "size", "range_no", "own_start", "own_end", "at", "take")
    spread = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "item", "range_no")
    stitched = _stitch(spread.mapInPandas(read, f"{place}, chunk binary"), limit, overlap)
    again = stitched.repartition(spark.sparkContext.defaultParallelism * 4, "item", "range_no")
    return _emit(again.mapInPandas(read, f"{place}, n_chars long, starts array<long>, ends array<long>, chars_before long, pieces_before long, chunk binary"))


assert sys.byteorder == "little", "code points are read in little-endian order"
