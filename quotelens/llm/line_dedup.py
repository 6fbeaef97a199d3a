"""Operator 6: line deduplication with a once-seen and a twice-seen Bloom filter.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys of at least ``least_length`` code points held by at least ``least_docs``
documents lose all their lines except in the largest id that holds them.

1. Every task hashes its eligible keys (each once per document, each once per
   batch) to 64 bits; only these hashes are dealt out, by hash segment.
2. Each segment's task streams its hashes through a once-seen Bloom filter (in
   layers that grow with what comes in); a hash met again is a suspect and
   goes into the segment's twice-seen filter, sized to the suspects.
3. The twice-seen filters go to all tasks if they are no larger than
   ``filter_bytes``, and only lines that pass them are shuffled; beyond that
   size every eligible line counts as suspected.
4. Suspected keys are counted exactly, and each document gets the list of keys
   that it loses.

Defined cases: NULL or empty text is one empty line; repeated rows count as
documents, rows with the largest id all keep their lines; a NULL id is smaller
than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, partitions, ship, staged

LEAST_LENGTH, LEAST_DOCS = 40, 5
FILTER_BYTES = 128 << 20
PROBES = 4
SLOTS_PER_KEY = 12


def keys_of(text: str | None, least_length: int) -> list[bytes]:
    """The key of every line; b"" for lines too short to count."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip().lower()
        if len(key) < least_length or (len(key) < 4 * least_length and not key.isascii()
                                       and len(key.decode()) < least_length):
            key = b""
        out.append(key)
    return out


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _slots(h: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
    step = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) | np.uint64(1)
    return [(h + np.uint64(i) * step) % np.uint64(size) for i in range(PROBES)] if np.isscalar(size) else \
        [(h + np.uint64(i) * step) % size for i in range(PROBES)]


class Bloom:
    """A Bloom filter in layers; a layer holds ``room`` keys and the next one twice as many."""

    def __init__(self, room: int = 1 << 14):
        self.layers: list[np.ndarray] = []
        self.room, self.free = room, 0

    def add(self, h: np.ndarray) -> None:
        if len(h) > self.free:
            self.room = max(2 * self.room, 2 * len(h))
            self.layers.append(np.zeros(self.room * SLOTS_PER_KEY // 8, np.uint8))
            self.free = self.room
        self.free -= len(h)
        set_bits(self.layers[-1], h)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for bits in self.layers:
            out |= test_bits(bits, h)
        return out


def set_bits(bits: np.ndarray, h: np.ndarray) -> None:
    for s in _slots(h, len(bits) * 8):
        np.bitwise_or.at(bits, (s >> np.uint64(3)).astype(np.int64), (1 << (s & np.uint64(7))).astype(np.uint8))


def test_bits(bits: np.ndarray, h: np.ndarray, start: np.ndarray | int = 0, size: np.ndarray | None = None) -> np.ndarray:
    """Whether all of a hash's bits are set, in one filter or in the part (start, size) of each hash."""
    out = np.ones(len(h), bool)
    for s in _slots(h, len(bits) * 8 if size is None else size):
        at = (s >> np.uint64(3)).astype(np.int64) + start
        out &= (bits[at] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def twice_seen(docs: DataFrame, least_length: int, segments: int, text_col: str) -> DataFrame:
    """One row per hash segment: segment, bits of its twice-seen filter."""

    def hash_lines(cols: dict[str, list]) -> dict[str, list]:
        per_doc = [hashes_of(list(set(keys_of(t, least_length)) - {b""})) for t in cols["text"]]
        h, n = np.unique(np.concatenate(per_doc or [np.zeros(0, np.uint64)]), return_counts=True)
        return {"h": h.view(np.int64), "again": n > 1, "segment": (h % np.uint64(segments)).astype(np.int32)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, suspects, segment = Bloom(), np.zeros(0, np.uint64), None
        for b in batches:
            if b.num_rows == 0:
                continue
            segment = b.column(2)[0].as_py()
            order, start, n = np.unique(b.column(0).to_numpy().view(np.uint64), return_index=True, return_counts=True)
            again = np.zeros(len(order), bool)
            again[np.searchsorted(order, b.column(0).to_numpy().view(np.uint64)[b.column(1).to_numpy(zero_copy_only=False)])] = True
            suspects = np.union1d(suspects, order[again | (n > 1) | once.has(order)])
            once.add(order)
        if len(suspects):
            bits = np.zeros(-(-len(suspects) * SLOTS_PER_KEY // 8) + 8, np.uint8)
            set_bits(bits, suspects)
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits.tobytes()], pa.binary())],
                                             names=["segment", "bits"])

    narrow = docs.select(docs[text_col].alias("text"))
    hashed = map_batches(narrow, hash_lines, "h long, again boolean, segment int")
    return hashed.repartitionById(segments, "segment").mapInArrow(build, "segment int, bits binary")


def suspected(docs: DataFrame, least_length: int, filter_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key) of every eligible key that may be held by two documents or more, once per row."""
    spark = docs.sparkSession
    segments = partitions(spark)
    filters = staged(twice_seen(docs, least_length, segments, text_col), "twice-seen")
    size = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    shared = None
    if size <= filter_bytes:
        start, length, parts, at = np.zeros(segments, np.int64), np.zeros(segments, np.int64), [], 0
        for segment, bits in filters.collect():  # no more than filter_bytes, checked above
            start[segment], length[segment] = at, len(bits) * 8
            parts.append(np.frombuffer(bits, np.uint8))
            at += len(bits)
        shared = spark.sparkContext.broadcast((np.concatenate(parts or [np.zeros(1, np.uint8)]), start, length))

    def pick(cols: dict[str, list]) -> dict[str, list]:
        ids, keys = [], []
        for i, t in zip(cols["id"], cols["text"]):
            mine = list(set(keys_of(t, least_length)) - {b""})
            ids += [i] * len(mine)
            keys += mine
        if shared is not None and keys:
            bits, start, length = shared.value
            h = hashes_of(keys)
            segment = (h % np.uint64(segments)).astype(np.int64)
            passes = np.zeros(len(h), bool)
            some = np.nonzero(length[segment] > 0)[0]
            passes[some] = test_bits(bits, h[some], start[segment[some]], length[segment[some]].astype(np.uint64))
            ids, keys = [ids[k] for k in np.nonzero(passes)[0]], [keys[k] for k in np.nonzero(passes)[0]]
        return {"id": ids, "key": [k.decode() for k in keys]}

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, pick, f"id {kind}, key string")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_docs: int = LEAST_DOCS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per row: id, kept_text, n_lines, n_dropped."""
    seen = staged(suspected(docs, least_length, filter_bytes, id_col, text_col), "suspected-lines")
    repeated = (seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
                .where(F.col("n") >= least_docs).select("key", "keeper"))
    loses = (seen.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
             .groupBy("id").agg(F.collect_set("key").alias("loses")).withColumnRenamed("id", "loser"))
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    joined = narrow.join(loses, F.col("id").eqNullSafe(F.col("loser")), "left").drop("loser")

    def drop(cols: dict[str, list]) -> dict[str, list]:
        kept, total, dropped = [], [], []
        for t, gone in zip(cols["text"], cols["loses"]):
            lines = (t or "").encode().split(b"\n")
            stay = lines
            if gone:
                gone = {g.encode() for g in gone}
                stay = [x for x in lines if x.strip().lower() not in gone]
            kept.append(b"\n".join(stay).decode())
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
        return {"id": cols["id"], "kept_text": kept, "n_lines": total, "n_dropped": dropped}

    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(joined, drop, f"id {kind}, kept_text string, n_lines long, n_dropped long").withColumnRenamed("id", id_col)
