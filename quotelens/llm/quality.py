"""Operator 5: quality classifier, histogram gradient-boosted trees over document statistics.

Every text is reduced to a fixed row of statistics (character classes, word
and line shapes, repetition).  Trees are grown leaf by leaf on binned features
from gradient histograms, then flattened into arrays; scoring walks all rows
through all trees at once with numpy.

The trees are fitted on at most ``max_rows`` labelled rows (taken by a hash of
their ids, so the choice doesn't depend on order or partitions); statistics
and scores cover every row and whole text.

Defined cases: NULL counts as empty, an empty text gets the score its
statistics (all 0) lead to; labels that contradict each other for one id count
by their mean; without labels of both kinds every score is the share of 1s
(0.5 without labels).  Repeated rows are scored row by row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_modulo, map_batches, staged

FEATURES = ["bytes", "words", "lines", "mean_word", "longest_word", "upper", "digit", "space", "punct", "symbol",
            "pipe", "bang", "beyond_ascii", "distinct_words", "distinct_pairs", "distinct_lines", "top_word",
            "words_per_line", "short_words", "ends_in_stop", "symbol_ended_words", "upper_words"]
MAX_ROWS = 30_000
THRESHOLD = 0.3

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def statistics(text: str | None) -> list[float]:
    """The feature row of one whole text."""
    raw = (text or "").encode()
    n = len(raw)
    if n == 0:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = raw.split(b"\n")
    w = max(1, len(words))
    distinct = set(words)
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    tails = np.frombuffer(b"".join([x[-1:] for x in words]), np.uint8)
    top = max(Counter(words).values(), default=0)
    return [float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))),
            sum(map(len, words)) / w, float(np.log1p(max(map(len, words), default=0))),
            h[65:91].sum() / n, h[48:58].sum() / n, h[_SPACE].sum() / n, h[_PUNCT].sum() / n, h[_SYMBOLS].sum() / n,
            h[124] / n, h[33] / n, h[128:].sum() / n, len(distinct) / w, pairs / max(1, len(words) - 1),
            len(set(lines)) / len(lines), top / w, len(words) / len(lines),
            sum(1 for x in words if len(x) <= 2) / w, h[46] / w,
            float(_SYMBOLS[tails].mean() + (tails == 33).mean()) if words else 0.0,
            sum(1 for x in words if x.isupper()) / w]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, lambda c: {"id": c["id"], "stats": [statistics(t) for t in c["text"]]},
                       f"id {kind}, stats array<float>")


@dataclass
class FlatTrees:
    """All trees in shared arrays: node i tests feature[i] <= cut[i], leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, leaves: int = 12, rate: float = 0.12, bins: int = 64,
              least_rows: int = 12, ridge: float = 1.0, depth: int = 6) -> FlatTrees:
    """Leaf-wise boosting of the logistic loss on binned features."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for column, start in ((feature, 0), (cut, 0.0), (value, 0.0)):
            column.append(start)
        left.append(len(left))
        right.append(len(right))
        return len(left) - 1

    if len(y) == 0 or y.min() == y.max():
        roots.append(node())
        return FlatTrees(*map(np.array, (feature, cut, left, right, value, roots)), depth=1, base=base)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    offset = binned + np.arange(d) * bins
    raw = np.full(n, base)

    def split_of(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        flat = offset[rows].ravel()
        size = d * bins
        hg = np.bincount(flat, np.repeat(g[rows], d), size).reshape(d, bins).cumsum(axis=1)
        hh = np.bincount(flat, np.repeat(h[rows], d), size).reshape(d, bins).cumsum(axis=1)
        hc = np.bincount(flat, minlength=size).reshape(d, bins).cumsum(axis=1)
        tg, th, tc = hg[:, -1:], hh[:, -1:], hc[:, -1:]
        gain = hg ** 2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg ** 2 / (th + ridge)
        gain[(hc < least_rows) | (tc - hc < least_rows)] = -1
        j, b = np.unravel_index(int(gain.argmax()), gain.shape)
        return float(gain[j, b]), int(j), int(b)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        grown = [(split_of(np.arange(n), g, h), root, np.arange(n), 0)]
        made = 1
        while made < leaves:
            k = max(range(len(grown)), key=lambda i: grown[i][0][0] if grown[i][3] < depth else -1)
            (gain, j, b), at, rows, deep = grown[k]
            if gain <= 1e-6 or deep >= depth:
                break
            grown.pop(k)
            feature[at], cut[at] = j, float(edges[j][b])
            goes = binned[rows, j] <= b
            for side, part in ((left, rows[goes]), (right, rows[~goes])):
                side[at] = node()
                grown.append((split_of(part, g, h), side[at], part, deep + 1))
            made += 1
        for _, at, rows, _ in grown:
            value[at] = -rate * float(g[rows].sum() / (h[rows].sum() + ridge))
            raw[rows] += value[at]
    return FlatTrees(*map(np.array, (feature, cut, left, right, value, roots)), depth=depth, base=base)


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, held_out: bool | None, modulo: int, rest: int,
                    max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``rows`` (column id) with their label, held-out ids left out, at most ``max_rows`` by id hash."""
    mark = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.avg(label).alias("label")))
    mark = mark.where(~hash_modulo("id", modulo, rest)).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    return rows.join(mark, "id")


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    stats = staged(features(docs, id_col, text_col), "quality-stats")
    known = labelled_sample(stats, labels, "quality", None, 5, 0, max_rows, id_col)
    # one row per id reaches the driver: of an id on several rows, the one with the least statistics
    known = known.groupBy("id").agg(F.min("stats").alias("stats"), F.max("label").alias("label")).toPandas().sort_values("id")
    x = np.array(known["stats"].tolist(), np.float64).reshape(len(known), len(FEATURES))
    model = fit_trees(x, known["label"].to_numpy(float))

    def score(cols: dict[str, list]) -> dict[str, list]:
        p = model.score(np.array(cols["stats"], np.float64))
        return {"id": cols["id"], "held_out": cols["held_out"], "score": p, "predicted": (p >= threshold).astype(np.int32)}

    kind = stats.schema["id"].dataType.simpleString()
    out = map_batches(stats.withColumn("held_out", hash_modulo("id", 5, 0)), score,
                      f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
