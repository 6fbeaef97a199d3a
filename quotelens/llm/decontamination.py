"""Operator 10: benchmark decontamination by spaced-seed hashing.

Words are lower-cased and stripped of ASCII punctuation at both ends.  A seed
is a mask over consecutive words: only the words under its 1s are hashed, so a
hit survives substitutions under its 0s.  The masks' hashes of all benchmark
items form an index; a document's hashes are looked up in it, and every hit is
verified on its diagonal (document and item side by side): a document is
contaminated where a stretch of ``window`` words (or the whole item, if it is
shorter) agrees with the item in all words but ``(words - 1) // tolerance`` (two of 13).  The
masks are lossless for that rule: any window with so few substitutions holds a
hit of at least one mask (``covers`` proves it, and a test checks it).

The benchmark is indexed in blocks of at most ``block_bytes`` of text (its
size is measured first); each block is broadcast and passed over once, so a
benchmark of any size is covered and no document is ever shuffled.

Defined cases: NULL and empty texts are never contaminated and never
contaminate; items shorter than every mask are looked up as a whole, exactly;
repeated items and rows give the same result each; a NULL item id is reported
as -1.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import ship

#: Fixed masks: words under 1 are hashed.
MASKS = ("11101", "11011")
WINDOW, TOLERANCE = 13, 6
BLOCK_BYTES = 16 << 20
SPANS = "array<struct<item_id:long,start:int,words:int,agree:int>>"
_PUNCTUATION = b".,;:!?\"'()[]{}<>#$%&*+-=/\\|~^_`@"


def words_of(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(_PUNCTUATION) for x in (text or "").encode().lower().split()) if w]


def covers(masks: tuple[str, ...], window: int, substitutions: int) -> bool:
    """Whether any choice of so many substituted words in a window leaves some mask a hit."""
    places = [[k + o for o, c in enumerate(m) if c == "1"] for m in masks for k in range(window - len(m) + 1)]
    return all(any(not set(p) & set(bad) for p in places) for bad in combinations(range(window), substitutions))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the masked words from every position on."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for o, c in enumerate(mask):
        if c == "1":
            out = _mix(out + h[o:o + n])
    return out


class Index:
    """Word hashes of benchmark items and the positions of their seeds."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, tolerance: int = TOLERANCE):
        self.window, self.tolerance, self.known = window, tolerance, {}
        bags = [(i, words_of(t)) for i, t in items]
        bags = [(i, w) for i, w in bags if w]
        self.ids = np.array([-1 if i is None else i for i, _ in bags], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(w) for _, w in bags])]).astype(np.int64)
        self.words = self.hashed([x for _, w in bags for x in w])
        shortest = min(map(len, MASKS))
        exact = sorted({len(w) for _, w in bags if len(w) < shortest})
        self.masks = list(MASKS) + ["1" * n for n in exact]
        self.tables = []
        item = np.repeat(np.arange(len(bags)), np.diff(self.starts))
        for m in self.masks:
            h = seed_hashes(self.words, m)
            at = np.arange(len(h))
            inside = self.starts[item[:len(h)] + 1] - at >= len(m) if len(h) else np.zeros(0, bool)
            h, at = h[inside], at[inside]
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], at[order]))
        self.item = item
        # first sieve: the low bits of every seed
        self.sieve = np.zeros(1 << 20, bool)
        for h, _ in self.tables:
            self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hashed(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text: verified (item id, first word, words, agreeing words), one per item and diagonal."""
        bags = [words_of(t) for t in texts]
        ends = np.cumsum([len(b) for b in bags])
        h = self.hashed([w for b in bags for w in b])
        doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        out: list[list] = [[] for _ in bags]
        met: set[tuple[int, int]] = set()
        for m, (table, at) in zip(self.masks, self.tables):
            key = seed_hashes(h, m)
            hit = np.nonzero(self.sieve[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
            lo, hi = np.searchsorted(table, key[hit], "left"), np.searchsorted(table, key[hit], "right")
            for p, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo]):
                if doc[p] != doc[p + len(m) - 1]:
                    continue
                for j in at[a:b]:
                    met.add((int(p - j + self.starts[self.item[j]]), int(self.item[j])))
        for shift, k in sorted(met):
            # shift: where the item's first word would stand among the batch's words
            item = self.words[self.starts[k]:self.starts[k + 1]]
            d = self._home(shift, len(item), doc, ends)
            for q in d:
                first = max(shift, ends[q] - len(bags[q]))
                last = min(shift + len(item), ends[q])
                best = self._verify(h[first:last] == item[first - shift:last - shift], len(item))
                if best:
                    begin, size, agree = best
                    out[q].append((int(self.ids[k]), int(first + begin - ends[q] + len(bags[q])), size, agree))
        return out

    @staticmethod
    def _home(shift: int, n: int, doc: np.ndarray, ends: np.ndarray) -> range:
        """The documents that the item at this shift lies over."""
        a, b = max(shift, 0), min(shift + n, len(doc)) - 1
        return range(int(doc[a]), int(doc[b]) + 1) if b >= a else range(0)

    def _verify(self, same: np.ndarray, item_words: int) -> tuple[int, int, int] | None:
        size = min(self.window, item_words)
        if len(same) < size:
            return None
        total = np.concatenate([[0], np.cumsum(same)])
        agree = total[size:] - total[:-size]
        good = np.nonzero(agree >= size - (size - 1) // self.tolerance)[0]
        if not len(good):
            return None
        begin, end = int(good[0]), int(good[-1]) + size
        return begin, end - begin, int(total[end] - total[begin])


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> Column:
    """A column of the verified overlaps of each text with all benchmark items (``SPANS``)."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(benchmark[item_col].alias("i"), benchmark[item_text].alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    columns = []
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        index = Index([tuple(r) for r in part.orderBy("i", "t").collect()])  # about block_bytes
        columns.append(_overlap_udf(spark.sparkContext.broadcast(index))(F.col(text_col)))
    return columns[0] if blocks == 1 else F.concat(*columns)


def _overlap_udf(shared):
    def find(texts: pd.Series) -> pd.Series:
        found: list = []
        values = list(texts)
        for at in range(0, len(values), 128):
            found += shared.value.spans(values[at:at + 128])
        return pd.Series([[dict(zip(("item_id", "start", "words", "agree"), x)) for x in f] for f in found], dtype=object)

    return pandas_udf(find, SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, contaminated, item_ids (sorted, distinct), spans."""
    found = docs.select(docs[id_col].alias(id_col), overlaps(docs, benchmark, text_col).alias("spans"))
    return found.select(id_col, (F.size("spans") > 0).alias("contaminated"),
                        F.array_sort(F.array_distinct(F.col("spans.item_id"))).alias("item_ids"), "spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any overlap, columns as they were."""
    return docs.where(F.size(overlaps(docs, benchmark, text_col)) == 0)
