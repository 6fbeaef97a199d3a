"""Operator 12: exact top-k search by distributed histogram selection.

Queries meet all rows in blocks of QUERY_BLOCK queries: a block is broadcast
(a few MB, whatever the size of the table), every task scores its own rows
against it, and rows never move.

1. Every score falls in one of BINS bins of its query's range.  A task reports
   its counts from the top down to the bin of its own kth score: the global kth
   score is never below that of a part, so lower bins can't matter.
2. Summed counts name the bin that holds each query's kth score.  That bin is
   the next round's range, until a bin is one score wide.
3. A last pass keeps what scores higher than the kth score and, of the rows
   that equal it, each task's smallest ids, as many as still fit.  The ranks
   come from these few rows.

Scores are sums of integers, exact in float32, float64 or int64, whichever the
largest possible score needs.

Defined cases: vectors that are NULL or hold a NULL or non-finite component
take no part, nor do rows with a NULL id; a shorter vector counts as followed
by zeros; repeated rows are candidates as often as they occur; an id on
several rows asks once, with its least vector, and never finds itself; with
fewer candidates than k, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .clustering import scaled
from .common import ship, staged

K, EVERY, SCALE = 20, 20, 64
QUERY_BLOCK = 8192
BINS = 256
TILE = 1 << 22  # scores held at a time
_NO_SCORE = -(1 << 62)


def matrix(v: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of an int64 matrix, shorter ones filled up with zeros."""
    size = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(v), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def score_type(largest: float) -> type:
    """The fastest number type in which sums up to ``largest`` are exact."""
    return np.float32 if largest < 2 ** 24 else np.float64 if largest < 2 ** 53 else np.int64


def tiles(batches, ids: np.ndarray, queries: np.ndarray, kind: type):
    """(row ids ascending, scores: queries x rows as int64) of one task; a query's own rows score _NO_SCORE."""
    q = queries.astype(kind)
    order = np.argsort(ids)
    step = max(1, TILE // max(1, len(ids)))
    for b in batches:
        rid = b.column(0).to_numpy()
        rows = matrix(b.column(1), queries.shape[1])
        by = np.argsort(rid, kind="stable")
        rid, rows = rid[by], rows[by].astype(kind)
        for at in range(0, len(rid), step):
            part = rid[at:at + step]
            s = (q @ rows[at:at + step].T).astype(np.int64)
            spot = np.minimum(np.searchsorted(ids, part, sorter=order), len(ids) - 1)
            own = np.flatnonzero(ids[order[spot]] == part)
            s[order[spot[own]], own] = _NO_SCORE
            yield part, s


def histogram(rows: DataFrame, shared, k: int) -> DataFrame:
    """(q, bin, n, need): counts of the scores in each query's range, from the top down to each task's own kth."""

    def count(batches):
        ids, queries, kind, low, high, wide, above = shared.value
        total = np.zeros((len(ids), BINS), np.int64)
        base = np.arange(len(ids))[:, None] * BINS
        for _, s in tiles(batches, ids, queries, kind):
            inside = (s >= low[:, None]) & (s < high[:, None])
            place = (base + (s - low[:, None]) // wide[:, None])[inside]
            total += np.bincount(place, minlength=total.size).reshape(total.shape)
        reached = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total  # in higher bins
        need = k - above
        q, b = np.nonzero((total > 0) & (reached < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[q, b]),
                                          pa.array(need[q])], names=["q", "bin", "n", "need"])

    return (rows.mapInArrow(count, "q int, bin int, n long, need long")
            .groupBy("q", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need")))


def best(rows: DataFrame, shared, k: int) -> DataFrame:
    """(q, vec_id, score): all rows above each query's kth score and the smallest ids that equal it, per task."""

    def keep(batches):
        ids, queries, kind, kth, _, _, above = shared.value
        need = np.where(kth > _NO_SCORE, k - above, 0)
        tied_q, tied_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part, s in tiles(batches, ids, queries, kind):
            q, r = np.nonzero((s > kth[:, None]) & (s > _NO_SCORE))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(part[r]), pa.array(s[q, r])],
                                             names=["q", "id", "score"])
            q, r = np.nonzero(s == kth[:, None])  # ascending ids within a query
            tied_q, tied_id = np.concatenate([tied_q, q]), np.concatenate([tied_id, part[r]])
            by = np.lexsort((tied_id, tied_q))
            tied_q, tied_id = tied_q[by], tied_id[by]
            place = np.arange(len(tied_q)) - np.searchsorted(tied_q, tied_q)
            tied_q, tied_id = (x[place < need[tied_q]] for x in (tied_q, tied_id))
        yield pa.RecordBatch.from_arrays([pa.array(tied_q.astype(np.int32)), pa.array(tied_id), pa.array(kth[tied_q])],
                                         names=["q", "id", "score"])

    return rows.mapInArrow(keep, "q int, id long, score long")


def kth_scores(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, kind: type, largest: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query: the kth greatest score (below all scores if there are fewer) and the number of greater ones."""
    low, high, above = -largest, largest + 1, np.zeros(len(ids), np.int64)
    few = np.zeros(len(ids), bool)
    open_ = high > low
    running = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # BINS rows a query
    while open_.any():
        wide = -(-(high - low) // BINS)
        shared = rows.sparkSession.sparkContext.broadcast((ids, queries, kind, low, np.where(open_, high, low), wide, above))
        cut = (histogram(rows, shared, k).withColumn("upto", F.sum("n").over(running))
               .where("upto >= need AND upto - n < need").select("q", "bin", (F.col("upto") - F.col("n")).alias("more")))
        found = {r["q"]: (r["bin"], r["more"]) for r in cut.collect()}  # one row per query of the block
        for q in np.flatnonzero(open_):
            if q not in found:
                few[q], open_[q] = True, False
                continue
            b, more = found[q]
            low[q] += b * wide[q]
            high[q] = min(high[q], low[q] + wide[q])
            above[q] += more
            open_[q] = high[q] - low[q] > 1
    return np.where(few, _NO_SCORE, low), above


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = SCALE, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k greatest inner products of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    ship(spark)
    rows = staged(scaled(vectors, id_col, vec_col, scale).where("id IS NOT NULL"), "vectors")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    asked = staged(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    most = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("x"), F.max(F.size("v")).alias("n")).first()
    path = scratch_path(spark, "llm-found")
    schema = f"query_id long, rank int, {id_col} long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for number in range(blocks):
        mine = asked.where(F.col("block") == number).orderBy("id").collect()
        if not mine:
            continue
        ids = np.array([r["id"] for r in mine], np.int64)
        width = max(most["n"], 1)
        queries = np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in mine], np.int64)
        reach = [sum(map(abs, r["v"])) * (most["x"] or 0) for r in mine]
        if max(reach) >= 1 << 61:
            raise ArithmeticError("inner products of these vectors don't fit in 64 bits")
        largest = np.array(reach, np.int64)
        kind = score_type(float(largest.max()))
        kth, above = kth_scores(rows, ids, queries, kind, largest, k)
        shared = spark.sparkContext.broadcast((ids, queries, kind, kth, None, None, above))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        names = spark.createDataFrame(list(enumerate(ids.tolist())), "q int, query_id long")
        (best(rows, shared, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
         .join(F.broadcast(names), "q").select("query_id", "rank", F.col("id").alias(id_col), "score")
         .write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)
