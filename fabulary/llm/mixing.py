"""A training mix with target shares by source, drawn by a hypergeometric splitting tree.

Documents are measured in tokens of a public tokenizer. A source's quota is its target share of the
mix's size, or all it has times its cap on repeats, whichever is less; what a capped or empty source
leaves out is reported, not filled from others, so the others keep their share of the size asked for.

Documents fall into blocks of about `block_tokens` tokens (by default some 256 blocks a shard) by a
hash of their id. A source is drawn in
passes: every pass is another permutation of all its blocks, the last pass ends within the block where
the quota is reached, and there by a permutation of the documents. The quotas, counted in block
draws, are split over the output shards by a binary tree: at every node the draws that the left half
gets are multivariate hypergeometric, so every shard gets a random, exact share of every source.
Shards take disjoint runs of a source's permuted draws, and rows are shuffled within their shard.

The tree and the quotas work on one number per source on the driver; everything else stays
distributed, and a hot source is spread over its blocks.

Nulls: documents without id, text or source, or of sources without a target, take no part; empty texts
have no tokens and are not drawn. Repeated rows of one id count once (the greatest text). A missing
share counts as 0, a missing cap as 1.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulary.session import cut

TOKENIZER, SHARDS, SEED = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 16, 7
# Fixed value: how the public vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens: every document once, texts of at least one token. The vocabulary file is sent to the workers."""
    documents.sparkSession.sparkContext.addFile(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(SparkFiles.get(os.path.basename(tokenizer))).encode_ordinary
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "source": rows["source"], "tokens": [len(encode(t)) for t in rows["text"]]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    kept = documents.select("doc_id", "source", "text").where("doc_id is not null and source is not null and text <> ''")
    counted = kept.mapInPandas(count, f"doc_id {kind}, source string, tokens long").where("tokens > 0")
    best = counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("best"))
    return best.select("doc_id", "best.source", "best.tokens")


def split_tree(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block draws by shard and source; every column sums to the source's draws."""
    if shards == 1:
        return draws[None, :]
    left = shards // 2
    half = rng.multivariate_hypergeometric(draws, int(draws.sum()) * left // shards, method="marginals")
    return np.concatenate([split_tree(half, left, rng), split_tree(draws - half, shards - left, rng)])


def plan(sources: pd.DataFrame, mix_tokens: int | None = None) -> pd.DataFrame:
    """sources: source, target_share, max_repeats, tokens. Adds quota and passes; tokens as whole numbers."""
    out = sources.fillna({"target_share": 0.0, "max_repeats": 1, "tokens": 0}).sort_values("source", ignore_index=True)
    out["tokens"] = out["tokens"].astype("int64")
    size = int(out["tokens"].sum()) if mix_tokens is None else mix_tokens
    most = out["tokens"] * out["max_repeats"].clip(lower=0).astype("int64")
    out["quota"] = np.minimum((out["target_share"] * size).round().astype("int64"), most)
    out["wanted"] = (out["target_share"] * size).round().astype("int64")
    return out


def draw_mix(documents: DataFrame, targets: DataFrame, mix_tokens: int | None = None, block_tokens: int | None = None, shards: int = SHARDS, seed: int = SEED, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    mix: doc_id, source, tokens, pass_no (1 = first use), shard, place (order within the shard).
    report: source, target_share, max_repeats, available_tokens, wanted_tokens, drawn_tokens,
    actual_share (of all drawn tokens), share_of_size (of the size asked for), most_uses, short.
    """
    spark = documents.sparkSession
    wish = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    counted = cut(count_tokens(documents, tokenizer).join(wish.select("source"), "source", "left_semi"))
    totals = wish.join(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source", "left").toPandas()  # one row per target
    planned = plan(totals, mix_tokens)
    size = int(planned["tokens"].sum()) if mix_tokens is None else mix_tokens
    block_tokens = block_tokens or min(max(size // (256 * shards), 1000), 10_000_000)
    planned["blocks"] = np.ceil(planned["tokens"] / block_tokens).clip(lower=1).astype("int64")
    quotas = spark.createDataFrame(planned[["source", "quota", "blocks", "tokens"]].rename(columns={"tokens": "all_tokens"}), "source string, quota long, blocks long, all_tokens long")

    blocked = counted.join(quotas.select("source", "blocks"), "source").withColumn("block_no", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "blocks")).drop("blocks")
    blocks = blocked.groupBy("source", "block_no").agg(F.sum("tokens").alias("block_tokens"))
    passes = blocks.join(quotas, "source").where("quota > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.ceil(F.col("quota") / F.col("all_tokens")).cast("int"))))
    order = Window.partitionBy("source").orderBy("pass_no", F.xxhash64("source", "block_no", "pass_no", F.lit(seed)), "block_no")
    drawn = passes.withColumns({"before": F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "draw": F.row_number().over(order) - 1}).where("before < quota")
    drawn = cut(drawn.select("source", "block_no", "pass_no", "draw", "block_tokens", (F.col("quota") - F.col("before")).alias("room")))

    per_source = {r.source: r.n for r in drawn.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = sorted(per_source)
    table = split_tree(np.array([per_source[s] for s in names], np.int64), shards, np.random.default_rng(seed)) if names else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(table, axis=0)
    runs = [(s, int(ends[k, j] - table[k, j]), int(ends[k, j]), k) for j, s in enumerate(names) for k in range(shards) if table[k, j]]
    takes = spark.createDataFrame(runs, "source string, lo long, hi long, shard int")
    placed = drawn.join(takes, "source").where("draw >= lo and draw < hi").drop("lo", "hi", "draw")

    rows = blocked.join(placed, ["source", "block_no"])
    inside = Window.partitionBy("source", "block_no", "pass_no").orderBy(F.xxhash64("doc_id", "pass_no", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rows.where("block_tokens <= room")
    cut_off = rows.where("block_tokens > room").withColumn("so_far", F.sum("tokens").over(inside)).where("so_far <= room").drop("so_far")
    mix = whole.unionByName(cut_off).select("doc_id", "source", "tokens", "pass_no", "shard", F.xxhash64("doc_id", "pass_no", F.lit(seed + 1)).alias("place"))

    used = mix.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.max("pass_no").alias("most_uses"))
    sums = Window.partitionBy()
    report = (
        spark.createDataFrame(planned[["source", "target_share", "max_repeats", "tokens", "wanted"]].astype({"max_repeats": "int64"}), "source string, target_share double, max_repeats long, available_tokens long, wanted_tokens long")
        .join(used, "source", "left").na.fill(0, ["drawn_tokens", "most_uses"])
        .withColumns({"actual_share": F.col("drawn_tokens") / F.nullif(F.sum("drawn_tokens").over(sums), F.lit(0)), "share_of_size": F.col("drawn_tokens") / F.lit(max(1, size))})
        .withColumn("short", F.col("wanted_tokens") > F.col("available_tokens") * F.col("max_repeats"))
    )
    return mix, report
