"""Operator 9: repeated windows by a depth-limited radix sort of suffixes.

A byte goes if it is covered by a string of ``WINDOW`` = 400 bytes that also
starts anywhere else (same document included).  Suffixes are sorted only
through those 400 bytes, most significant digit first; a suffix that is alone
with its digits drops out of the sort, and the groups still equal at full
depth are exactly the repeated windows.  Digits are taken around a point that
the window's own content fixes, so neighbouring suffixes share them and a
whole run of suffixes is one row:

1. digit one: the least (by hash) of the window's 201 strings of 200 bytes,
   the leftmost if there are several; all suffixes with the same one in a
   document are a run.  Anchors that occur once drop out.
2. Runs equal in all their bytes are one class: with two members or more, all
   their suffixes are repeated at full depth, without being listed.
3. digit two: 300 bytes around the anchor, to its left for suffixes that start
   100 bytes or more before it, else to its right.  Those alone drop out.
4. the rest at full depth: the suffixes left, one class member each, are
   grouped by all 400 bytes; groups of two or more are repeated windows.

Digits travel as 64-bit hashes, a group is told apart by two of them.
Documents are read whole, in pieces of at most a megabyte that overlap.

Defined cases: NULL counts as empty; texts shorter than 400 bytes lose
nothing; repeated rows are documents of their own, so all of their windows are
repeated; rows with one id and different texts are kept apart by a text hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

WINDOW, ANCHOR, REACH = 400, 200, 100
SPREAD = WINDOW - ANCHOR + 1
PIECE = 1 << 20
#: Entries of 8 to 40 bytes up to which a side is broadcast, after they are counted.
BROADCAST_ROWS = 2_000_000
#: Documents that a task turns into rows at a time.
BATCH = 500
#: More than the windows of one run.
PART_WINDOWS = 512

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of two strings' hashes, in order."""
    h = x * _A
    h += y
    h *= _B
    h ^= h >> np.uint64(31)
    return h


def hashes_128(raw: np.ndarray) -> np.ndarray:
    """The hash of the 128 bytes from every position on (at least 128 bytes given)."""
    h = np.lib.stride_tricks.as_strided(raw.view(np.uint8), shape=(len(raw) - 7, 8), strides=(1, 1))
    h = np.ascontiguousarray(h).view(np.uint64).ravel()
    h = joined(h, h >> np.uint64(32))
    for size in (8, 16, 32, 64):
        h = joined(h[:-size], h[size:])
    return h


def at_256(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    return joined(h[p], h[p + 128])


def at_300(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    return joined(at_256(h, p), at_256(h, p + 44))


def at_400(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    return joined(at_256(h, p), at_256(h, p + 144))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by block prefixes and suffixes."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def pieces(texts: list[bytes]):
    """(buffer, segments): texts packed into buffers of about PIECE bytes; a segment is
    (text, offset in the text, place in the buffer, windows).  Every window is in one segment."""
    parts, segments, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(0, len(t) - WINDOW + 1), PIECE):
            part = t[at:at + PIECE + WINDOW - 1]
            if size and size + len(part) > PIECE + WINDOW:
                yield np.frombuffer(b"".join(parts), np.uint8), segments
                parts, segments, size = [], [], 0
            segments.append((k, at, size, len(part) - WINDOW + 1))
            parts.append(part)
            size += len(part)
    if segments:
        yield np.frombuffer(b"".join(parts), np.uint8), segments


def runs_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Columns text, start, n, off, a, s, dl, dr of all runs of suffixes."""
    found = []
    low = np.uint64((1 << 21) - 1)
    for raw, segments in pieces(texts):
        h = hashes_128(raw)
        anchor_hash = joined(h[:len(raw) - ANCHOR + 1], h[ANCHOR - 128:])
        order = (anchor_hash & ~low) | np.arange(len(anchor_hash), dtype=np.uint64)
        anchor = (sliding_least(order, SPREAD) & low).astype(np.int64)
        seg = np.array(segments, np.int64)
        inside = np.zeros(len(anchor) + 1, bool)
        for place, n in seg[:, 2:]:
            inside[place:place + n] = True
        changes = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        changes[1:] |= inside[1:-1] != inside[:-2]
        start = np.nonzero(changes & inside[:-1])[0]
        stop = np.concatenate([np.nonzero(changes)[0], [len(anchor)]])
        last = stop[np.searchsorted(stop, start, side="right")] - 1
        mid = anchor[start]
        at = np.searchsorted(seg[:, 2], start, side="right") - 1
        off = mid - start
        left, right = np.maximum(mid - REACH, start), np.minimum(mid, last + WINDOW - 300)
        found.append((seg[at, 0], start - seg[at, 2] + seg[at, 1], last - start + 1, off, anchor_hash[mid],
                      joined(at_400(h, start), at_400(h, last)), at_300(h, left), ~at_300(h, right)))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 4
    return dict(zip(("text", "start", "n", "off", "a", "s", "dl", "dr"), columns))


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def _text_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _runs(docs: DataFrame) -> DataFrame:
    def run(cols: dict[str, list]) -> dict[str, list]:
        raw = _encoded(cols["text"])
        r = runs_of(raw)
        ids, th = cols["id"], [_text_hash(x) for x in raw]
        out = {"id": pa.array(ids, pa.int64()).take(r["text"]), "th": np.array(th, np.int64)[r["text"]]}
        out |= {c: r[c].astype(np.int32) for c in ("start", "n", "off")}
        return out | {c: r[c].view(np.int64) for c in ("a", "s", "dl", "dr")}

    return map_batches(docs, run, "id long, th long, start int, n int, off int, a long, s long, dl long, dr long",
                       rows=BATCH)


def _windows(docs: DataFrame) -> DataFrame:
    """Rows of (id, text, th, parts (lo, hi, d, copies, part)) to one row per suffix: its two hashes
    (digits one to two with full depth, full depth), its class's members and its place (part, offset)."""

    def spread(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("k", "v", "copies", "place")}
        for th, raw, parts in zip(cols["th"], _encoded(cols["text"]), cols["parts"]):
            if _text_hash(raw) != th:
                continue
            for p in parts:
                n = p["hi"] - p["lo"] + 1
                h = hashes_128(np.frombuffer(raw[p["lo"]:p["hi"] + WINDOW], np.uint8))
                w = at_400(h, np.arange(n))
                out["k"].append(joined(w, np.array([p["d"]], np.int64).view(np.uint64)).view(np.int64))
                out["v"].append((w >> np.uint64(32)).astype(np.uint32).view(np.int32))
                out["copies"].append(np.full(n, p["copies"]))
                out["place"].append(p["part"] * PART_WINDOWS + np.arange(n))
        return {c: np.concatenate(v or [np.zeros(0, np.int64)]) for c, v in out.items()}

    return map_batches(docs, spread, "k long, v int, copies long, place long", rows=BATCH)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table whose counted entries allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _merged(spans: DataFrame) -> DataFrame:
    """(id, th, spans of (start, windows)) to (id, th, cuts): maximal byte ranges (from, to), in order."""

    def merge(cols: dict[str, pa.Array]) -> dict[str, list]:
        lists = cols["spans"]
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        start = lists.flatten().field("start").to_numpy().astype(np.int64)
        end = start + lists.flatten().field("n").to_numpy() - 1 + WINDOW
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        # how far the ranges before reach, within a document: documents lie far apart
        shift = doc * (int(end.max(initial=0)) + 2)
        reach = np.maximum.accumulate(end + shift)
        opens = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]]) if len(doc) else np.zeros(0, bool)
        first = np.nonzero(opens)[0]
        stop = np.append(first[1:] - 1, len(doc) - 1) if len(first) else first
        cuts: list[list[dict]] = [[] for _ in range(len(lists))]
        for d, a, b in zip(doc[first], start[first], (reach - shift)[stop]):
            cuts[d].append({"from": int(a), "to": int(b)})
        return {"id": cols["id"], "th": cols["th"], "cuts": cuts}

    return map_batches(spans, merge, "id long, th long, cuts array<struct<from:int,to:int>>", rows=BATCH, as_lists=False)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(id, th, cuts): of (id, text) rows, the byte ranges covered by windows that start elsewhere too."""
    runs = staged(_runs(docs), "runs")
    # digit one
    anchors = staged(runs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a"), "anchors")
    runs = staged(runs.join(_small(anchors, anchors.count()), "a", "left_semi"), "runs")
    # equal runs
    run_key = ["a", "off", "n", "s"]
    classes = staged(runs.groupBy(*run_key, "dl", "dr").agg(F.count(F.lit(1)).alias("copies"),
                                                            F.min(F.struct("id", "th", "start")).alias("one")), "run-classes")
    equal = classes.where("copies > 1").select(*run_key)
    whole = runs.join(equal, run_key, "left_semi").select("id", "th", "start", "n")
    # digit two: the last suffixes of a run start less than REACH before the anchor
    lo, last = F.col("one.start"), F.col("one.start") + F.col("n") - 1
    turn = F.col("one.start") + F.col("off") - REACH  # the last start that has REACH bytes before the anchor
    half = F.array(F.struct(lo.alias("lo"), F.least(last, turn).alias("hi"), F.col("dl").alias("d")),
                   F.struct(F.greatest(lo, turn + 1).alias("lo"), last.alias("hi"), F.col("dr").alias("d")))
    halves = staged(classes.select("one.id", "one.th", "copies", F.explode(half).alias("p"))
                    .where("p.lo <= p.hi").select("id", "th", "copies", "p.lo", "p.hi", "p.d"), "halves")
    open_ = staged(halves.groupBy("d").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("k"), F.min("copies").alias("least"))
                   .where("c > 1 AND k > 1 AND least = 1").select("d"), "open-digits")
    parts = staged(halves.join(_small(open_, open_.count()), "d", "left_semi")
                   .withColumn("part", F.monotonically_increasing_id()), "parts")
    # full depth
    by_doc = parts.groupBy(F.col("id").alias("_id"), "th").agg(F.collect_list(F.struct("lo", "hi", "d", "copies", "part")).alias("parts"))
    n_parts = parts.count()
    deep = staged(_windows(docs.join(_small(by_doc, n_parts), F.col("id").eqNullSafe(F.col("_id"))).drop("_id")), "suffixes")
    groups = deep.groupBy("k", "v").agg(F.sum("copies").alias("c")).where("c > 1").select("k", "v")
    alone = (deep.where("copies = 1").join(groups, ["k", "v"], "left_semi")
             .select(F.expr(f"place div {PART_WINDOWS}").alias("part"), (F.col("place") % PART_WINDOWS).cast("int").alias("at"))
             .join(_small(parts.select("part", "id", "th", "lo"), n_parts), "part")
             .select("id", "th", (F.col("lo") + F.col("at")).alias("start"), F.lit(1).alias("n")))
    return _merged(whole.unionByName(alone).groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans")))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans."""
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    ranges = staged(repeated_ranges(narrow), "ranges")
    entries = ranges.agg(F.sum(F.size("cuts") + 1)).first()[0] or 0
    found = ranges.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("th", "cuts")).alias("found"))

    def cut(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("kept", "n_bytes", "n_removed", "n_spans")}
        for raw, found in zip(_encoded(cols["text"]), cols["found"]):
            mine = [c for f in found or [] if f["th"] == _text_hash(raw) for c in f["cuts"]]
            stay, at = [], 0
            for c in mine:
                stay.append(raw[at:c["from"]])
                at = c["to"]
            out["kept"].append(b"".join(stay) + raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(c["to"] - c["from"] for c in mine))
            out["n_spans"].append(len(mine))
        return {"id": cols["id"]} | out

    both = narrow.join(_small(found, entries), F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return map_batches(both, cut, "id long, kept binary, n_bytes long, n_removed long, n_spans long", rows=BATCH).withColumnRenamed("id", id_col)
