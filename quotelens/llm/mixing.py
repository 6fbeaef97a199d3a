"""Operator 1: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources weigh 1, 2, 3, 1, 2, 3, ... in code-point order (NULL last) unless
weights are given.  The words of all sources are shared out by weight; no
target exceeds ``most`` times its source's words, and what is left over is
shared out again by weight among the others (water filling).

A source's documents fall by a hash into blocks of about equal words.  A
target is drawn in blocks: whole epochs of all blocks, each epoch in its own
permutation, then a part of one more epoch whose last block gives exactly the
words still missing (documents in hash order, the last one cut at a word).
All block draws are dealt to output shards of equal size by a binary tree: at
each node the left half gets a multivariate hypergeometric draw of the block
counts of all sources, so each shard holds an exact, fair quota of every
source.  Shards take disjoint ranges of the permuted draws and are shuffled
where they are.

The tree works on block counts alone.  ``most_blocks`` bounds the block table
(blocks grow in words instead), so what the driver holds doesn't grow with the
corpus; sources are the components of a recipe, one row each on the driver.

Defined cases: NULL or empty text has size 0 and never adds words; a source
without words has target 0; without any words every target is 0; repeated rows
are drawn alike, row by row.  The same input gives the same mix on every run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"
MOST_TIMES = 3
BLOCK_WORDS = 50_000
MOST_BLOCKS = 1 << 18
SHARD_BLOCKS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST_TIMES) -> np.ndarray:
    """Words of each source in the mix: shares by weight, none above ``most`` times its size."""
    out, open_, left = np.zeros(len(sizes)), sizes > 0, float(sizes.sum())
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        left -= float(out[over].sum())
        open_ &= ~over
    return out


def split_quotas(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact block quotas (shard x source) by recursive halving."""
    out = np.zeros((shards, len(counts)), np.int64)

    def node(c: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = c
            return
        mid = (lo + hi) // 2
        n = int(round(int(c.sum()) * (mid - lo) / (hi - lo)))
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(c, n, method="marginals")
        node(left, lo, mid)
        node(c - left, mid, hi)

    node(counts.astype(np.int64), 0, shards)
    return out


def plan_draws(blocks: pd.DataFrame, target: np.ndarray, seed: int, shard_blocks: int) -> pd.DataFrame:
    """One row per block draw: rank (of the source), bucket, epoch, shard, words (NULL: the whole block)."""
    parts, counts = [], np.zeros(len(target), np.int64)
    grouped = {k: g for k, g in blocks.sort_values(["rank", "bucket"]).groupby("rank")}
    for s, g in grouped.items():
        words, bucket = g["words"].to_numpy(np.int64), g["bucket"].to_numpy()
        size, left, epoch = int(words.sum()), int(round(target[s])), 0
        while left > 0 and size > 0:
            order = np.random.default_rng([seed, s, epoch]).permutation(len(words))
            before = np.concatenate([[0], np.cumsum(words[order])[:-1]])
            some = order[before < left]
            room = left - before[before < left]
            parts.append(pd.DataFrame({"rank": s, "bucket": bucket[some], "epoch": epoch,
                                       "words": np.where(words[some] > room, room, -1),
                                       "position": counts[s] + np.arange(len(some))}))
            counts[s] += len(some)
            left -= min(left, size)
            epoch += 1
    if not parts:
        return pd.DataFrame({"rank": [], "bucket": [], "epoch": [], "words": [], "shard": []}).astype(int)
    draws = pd.concat(parts, ignore_index=True)
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, len(draws) / shard_blocks)))))
    ends = split_quotas(counts, shards, seed).cumsum(axis=0)
    draws["shard"] = 0
    for s in grouped:
        mine = (draws["rank"] == s).to_numpy()
        draws.loc[mine, "shard"] = np.searchsorted(ends[:, s], draws.loc[mine, "position"].to_numpy(), side="right")
    return draws


def mix_plan(sized: DataFrame, weights: dict | None, seed: int, block_words: int, most_blocks: int,
             shard_blocks: int) -> tuple[DataFrame, DataFrame]:
    """(one row per source, one row per drawn block) from rows of (id, source, size)."""
    spark = sized.sparkSession
    # Spark orders strings by their UTF-8 bytes, that is by code point
    found = sized.groupBy("source").agg(F.sum("size").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = np.array([r["words"] or 0 for r in found], np.float64)
    weight = np.array([float((weights or {}).get(r["source"], 1 + k % 3)) for k, r in enumerate(found)])
    target = targets(sizes, weight)
    per_block = max(block_words, int(sizes.sum() // most_blocks) + 1)
    schema = T.StructType([T.StructField("s", sized.schema["source"].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                           T.StructField("n_buckets", T.LongType())])
    sources = spark.createDataFrame([(r["source"], k, int(sizes[k]), float(target[k]), max(1, int(-(-sizes[k] // per_block))))
                                     for k, r in enumerate(found)], schema)
    # at most most_blocks blocks and one more for each source
    blocks = _placed(sized, sources, seed).groupBy("rank", "bucket").agg(F.sum("size").alias("words")).toPandas()
    draws = plan_draws(blocks, target, seed, shard_blocks)
    rows: dict[tuple[int, int], list] = {}
    for r, b, e, sh, w in zip(*(draws[c].tolist() for c in ("rank", "bucket", "epoch", "shard", "words"))):
        rows.setdefault((r, b), []).append((e, sh, w))
    plan = spark.createDataFrame([(r, b, d) for (r, b), d in rows.items()], f"rank int, bucket long, block_draws {_DRAWS}")
    return sources, plan


_DRAWS = "array<struct<epoch:int,shard:int,words:long>>"


def _placed(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Each row's source rank and block."""
    return (sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # one row per source
            .withColumn("bucket", F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.col("n_buckets"))).drop("n_buckets"))


def draw(sized: DataFrame, plan: tuple[DataFrame, DataFrame], seed: int) -> DataFrame:
    """Rows of (id, source, size, ...) with source_size, target, draws (epoch, shard, words) and taken."""
    sources, blocks = plan
    drawn = _placed(sized, sources, seed).join(F.broadcast(blocks), ["rank", "bucket"], "left")  # bounded by most_blocks
    some = F.coalesce("block_draws", F.array().cast(_DRAWS))
    cut = F.filter(some, lambda d: d["words"] >= 0)
    # a source's last block gives what is still missing: documents in hash order, at most one such block per source
    in_order = Window.partitionBy("rank", "bucket").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "size")
    before = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), cut[0]["words"] - before))
    rows = (drawn.where(F.size(cut) == 0).withColumn("part", F.lit(None).cast("long"))
            .unionByName(drawn.where(F.size(cut) > 0).withColumn("part", part)))
    draws = F.transform(some, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"),
                                                 F.when(d["words"] < 0, F.col("size")).otherwise(F.col("part")).alias("words")))
    return (rows.withColumn("draws", draws)
            .withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
            .drop("rank", "bucket", "block_draws", "part"))


def mix_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights: dict | None = None, seed: int = 11, block_words: int = BLOCK_WORDS,
              most_blocks: int = MOST_BLOCKS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Per row: id, size, source_size, target, taken, draws; one pass over the texts."""
    sized = staged(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"),
                               word_count(docs[text_col]).alias("size")), "mix-sizes")
    plan = mix_plan(sized, weights, seed, block_words, most_blocks, shard_blocks)
    return draw(sized, plan, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "draws")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: dict | None = None, seed: int = 11, block_words: int = BLOCK_WORDS,
        most_blocks: int = MOST_BLOCKS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per draw, with shard, epoch and the words taken
    (a text that is cut keeps its first words), shards apart and shuffled inside.

    Columns of ``docs`` named mix_shard, mix_epoch or mix_words, as an earlier mix leaves them, are replaced."""
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    plan = mix_plan(staged(sized.select("id", "source", "size"), "mix-sizes"), weights, seed, block_words, most_blocks, shard_blocks)
    drawn = draw(sized, plan, seed).select("row", "size", F.explode("draws").alias("d")).where("d.words > 0")
    text = F.col("row")[text_col]
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("d.words").cast("int")), "")
    whole = F.when(F.col("d.words") < F.col("size"), first).otherwise(text)
    added = {"mix_shard": F.col("d.shard"), "mix_epoch": F.col("d.epoch"), "mix_words": F.col("d.words")}
    columns = [whole.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    out = drawn.select(*columns, *[e.alias(c) for c, e in added.items()])
    return (out.repartition("mix_shard")
            .sortWithinPartitions("mix_shard", F.xxhash64(id_col, "mix_epoch", F.lit(seed + 2)), id_col))
