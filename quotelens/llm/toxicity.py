"""Operator 8: toxicity by a subsequence string-kernel support vector machine.

A labelled sentence is a bag of fragments (its words; runs of single letters
are read as one word, whatever white space parts them; a word longer than
``PIECE`` characters is read in overlapping pieces).  Fragments are compared by
the gap-weighted subsequence kernel of order 3: two pieces agree in every triple
of letters they share in order, however far apart the letters are, each
occurrence weighing DECAY ** (length it spans), so inserted characters and gaps
lower the kernel but don't break it.  Punctuation takes up room in a span but is
never part of a triple.  A word parted by white space into runs of two or more
letters is read as those runs.

Nystrom landmarks give the kernel a finite feature map, z = K^-1/2 k(., landmarks),
on which a linear SVM (squared hinge loss) is fitted.  Only documents are
labelled, so the witness of a toxic document, the fragment that speaks most
for its label, is chosen anew after each fit (multiple-instance learning).
The fitted function is linear in the landmarks' kernels, which in turn are
linear in the triples: it folds into one weight per triple, and a fragment is
scored in time linear in its length.  A document's score is the logistic
calibration of its largest fragment value.

Fitted on at most ``max_rows`` labelled rows of each class, by a hash of the
ids; the calibration weighs each class by its labelled rows over those taken,
so scores follow the real share of toxic rows whether or not a class was cut.
Scoring covers every whole text.

Defined cases: NULL counts as empty; a text without letters gets the least
score; repeated rows are scored row by row; of a labelled id's texts one is
learnt from, always the same; without labels of both kinds every
score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_modulo, map_batches, ship

DECAY, PIECE, GRAM = 0.6, 24, 4
ALPHABET = 32
LANDMARKS = 400
#: Likelihood ratio from which a run of letters speaks for a label before any fit.
SURE = 20.0
#: Fragments of one toxic document that are learnt from in a round.
WITNESSES = 3
MAX_ROWS = 4_000
THRESHOLD = 0.3
REMEMBERED = 300_000

# Letters and digits that stand for letters share a code; 0 is never part of a triple.
_CODE = np.zeros(256, np.int64)
for _i in range(26):
    _CODE[97 + _i] = 1 + _i
for _digit, _letter in zip(b"01345", b"oieas"):
    _CODE[_digit] = _CODE[_letter]
for _b in range(128, 192):  # second and later bytes of UTF-8
    _CODE[_b] = 27 + _b % 5
_CODE[36], _CODE[64] = _CODE[ord("s")], _CODE[ord("a")]


_SPELT = re.compile(rb"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def fragments(text: str | None) -> list[bytes]:
    """The distinct fragments of one text: words of three letters or more, and runs of single letters."""
    low = (text or "").lower().encode()
    out = {w for w in low.split() if len(w) > 2}
    for run in _SPELT.findall(low):
        out.add(b"".join(run.split()))
    return sorted(out)


def pieces(fragment: bytes) -> list[bytes]:
    if len(fragment) <= PIECE:
        return [fragment]
    return [fragment[i:i + PIECE] for i in range(0, len(fragment) - PIECE // 2, PIECE // 2)]


@lru_cache(maxsize=PIECE + 1)
def _places(width: int) -> np.ndarray:
    """(first, second, third) places of all triples in a piece of ``width`` characters."""
    return np.array(list(combinations(range(width), 3)), np.int64).reshape(-1, 3).T


def triples(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of each part's triples of letters, padded with weight 0."""
    width = max(map(len, parts), default=1)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
    c = _CODE[raw]
    i, j, k = _places(width)
    a, b, d = c[:, i], c[:, j], c[:, k]
    return (a * ALPHABET + b) * ALPHABET + d, np.where((a > 0) & (b > 0) & (d > 0), DECAY ** (k - i - 2.0), 0.0)


def norms(weights: np.ndarray) -> np.ndarray:
    """Length of each part's feature row, every occurrence of a triple counted as its own."""
    return np.sqrt((weights ** 2).sum(axis=1))


@dataclass
class Landmarks:
    """Normalised feature rows of a few parts over the triples that occur in them."""

    codes: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(parts: list[bytes]) -> "Landmarks":
        codes, weights = triples(parts)
        known, column = np.unique(codes[weights > 0], return_inverse=True)
        rows = np.zeros((len(parts), len(known) + 1), np.float32)  # the last column: any other triple
        np.add.at(rows, (np.nonzero(weights > 0)[0], column), weights[weights > 0])
        size = norms(weights)[:, None]
        return Landmarks(known, rows / np.where(size > 0, size, 1))

    def kernel(self, parts: list[bytes]) -> np.ndarray:
        """Normalised kernel of each part with each landmark."""
        column = np.full(ALPHABET ** 3, len(self.codes))
        column[self.codes] = np.arange(len(self.codes))
        by_code = np.ascontiguousarray(self.rows.T)
        out = np.zeros((len(parts), len(self.rows)), np.float32)
        for at in range(0, len(parts), 256):
            codes, weights = triples(parts[at:at + 256])
            size = norms(weights)
            k = np.stack([w[w > 0] @ by_code[column[c[w > 0]]] for c, w in zip(codes, weights.astype(np.float32))])
            out[at:at + 256] = k / np.where(size > 0, size, 1)[:, None]
        return out

    def folded(self, coefficients: np.ndarray) -> np.ndarray:
        """One weight per triple: a sum of landmarks' kernels is linear in the triples."""
        out = np.zeros(ALPHABET ** 3, np.float32)
        out[self.codes] = (coefficients @ self.rows)[:-1]
        return out


@dataclass
class Fitted:
    """One weight per triple, the bias of the SVM, and the logistic calibration."""

    triple_weight: np.ndarray
    bias: float
    slope: float
    shift: float
    known: dict | None = None

    def values(self, parts: list[bytes]) -> np.ndarray:
        out = np.empty(len(parts))
        order = np.argsort([len(p) for p in parts], kind="stable")
        for at in range(0, len(parts), 1024):
            some = order[at:at + 1024]
            out[some] = self._values([parts[i] for i in some])
        return out

    def _values(self, parts: list[bytes]) -> np.ndarray:
        width = max(map(len, parts))
        c = _CODE[np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8)].astype(np.int32).reshape(-1, width)
        high, middle, is_letter = c * ALPHABET ** 2, c * ALPHABET, (c > 0).astype(np.float32)
        total, size = np.zeros(len(parts), np.float32), np.zeros(len(parts), np.float32)
        for k in range(2, width):  # from the first to the third letter
            n, value, number = width - k, np.zeros((len(parts), width - k), np.float32), np.zeros((len(parts), width - k), np.float32)
            outer = high[:, :n] + c[:, k:]
            for j in range(1, k):
                inner = is_letter[:, j:n + j]
                value += self.triple_weight[outer + middle[:, j:n + j]] * inner
                number += inner
            ends = is_letter[:, :n] * is_letter[:, k:]
            decay = np.float32(DECAY ** (k - 2))
            total += decay * np.einsum("ij,ij->i", value, ends)
            size += decay ** 2 * np.einsum("ij,ij->i", number, ends)
        return total / np.sqrt(np.where(size > 0, size, 1)) + self.bias

    def largest(self, texts: list[str | None]) -> np.ndarray:
        """Each text's largest fragment value (the bias alone without fragments)."""
        known = self.known if self.known is not None else {}
        bags = [fragments(t) for t in texts]
        new = list({f for bag in bags for f in bag if f not in known})
        cut = [pieces(f) for f in new]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known = {f: known[f] for bag in bags for f in bag if f in known}
            starts = np.cumsum([0] + [len(c) for c in cut[:-1]])
            value = np.maximum.reduceat(self.values([p for c in cut for p in c]), starts)
            known.update(zip(new, value.tolist()))
        self.known = known
        return np.array([max(map(known.__getitem__, bag), default=self.bias - 1) for bag in bags])

    def score(self, texts: list[str | None]) -> np.ndarray:
        top = np.concatenate([self.largest(texts[i:i + 256]) for i in range(0, len(texts), 256)] or [np.zeros(0)])
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -40, 40)))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Primal squared-hinge SVM by Newton steps; the last weight is the bias."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    active = None
    for _ in range(steps):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a = x[active] * weight[active, None]
        w = np.linalg.solve(a.T @ x[active] + np.diag(reg), a.T @ y[active])
    return w


def _first_witness(bags: list[list[bytes]], y: np.ndarray, use: np.ndarray):
    """How much a part speaks for its document's label before any fit: the likelihood ratio
    of its most telling run of GRAM letters between toxic and other documents."""
    in_toxic, in_clean = Counter(), Counter()
    for bag, toxic, mine in zip(bags, y, use):
        if mine:
            (in_toxic if toxic else in_clean).update({g for p in bag for g in _grams(p)})
    n1, n0 = int((y & use).sum()), int((~y & use).sum())
    telling = {}
    for g, a in in_toxic.items():
        b = in_clean[g]
        if a >= 2 and a * n0 > b * n1:
            p1, p0, p = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 1) / (n1 + n0 + 2)
            telling[g] = (a * np.log(p1 / p) + b * np.log(p0 / p)
                          + (n1 - a) * np.log((1 - p1) / (1 - p)) + (n0 - b) * np.log((1 - p0) / (1 - p)))
    return lambda part: max([telling.get(g, 0.0) for g in _grams(part)], default=0.0)


def _grams(part: bytes) -> set[bytes]:
    return {part[i:i + GRAM] for i in range(len(part) - GRAM + 1)} or {part}


def fit(texts: list[str], labels: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 5, negatives: int = 12_000,
        seed: int = 7, stands_for: tuple[float, float] = (1.0, 1.0)) -> Fitted:
    """``stands_for``: labelled rows for which each clean and each toxic text stands."""
    rng = np.random.default_rng(seed)
    one: dict[bytes, bytes] = {}  # documents share the fragments they have in common
    bags = [list(dict.fromkeys(one.setdefault(p, p) for f in fragments(t) for p in pieces(f))) for t in texts]
    del one
    y = labels >= 0.5
    empty = Fitted(np.zeros(ALPHABET ** 3, np.float32), -1.0, 1.0, -40.0)
    if y.all() or not y.any() or not any(bags):
        return empty
    calibration = rng.random(len(bags)) < 0.25
    if not (y & calibration).any() or not (y & ~calibration).any() or not (~y & calibration).any():
        calibration[:] = True
    fit_on = ~calibration if not calibration.all() else calibration
    first = _first_witness(bags, y, fit_on)
    toxic = [b for b, t, f in zip(bags, y, fit_on) if t and f and b]
    clean = [b for b, t, f in zip(bags, y, fit_on) if not t and f and b]
    vocabulary = sorted({p for b in clean for p in b})
    in_clean = set(vocabulary)
    spread = [vocabulary[i] for i in rng.permutation(len(vocabulary))[:negatives]]
    current = None
    hard: list[bytes] = []
    for _ in range(rounds):
        if current is None:
            value = np.array([first(p) for b in toxic for p in b]) - SURE
        else:
            value = current.values([p for b in toxic for p in b])
            worst = np.argsort(-current.values(vocabulary))[:600]
            hard = list(dict.fromkeys(hard + [vocabulary[i] for i in worst]))[-6000:]
        witnesses = []
        for b, v in zip(toxic, np.split(value, np.cumsum([len(b) for b in toxic])[:-1])):
            # every fragment that speaks for the label and that no clean document holds, else the strongest
            said = [b[i] for i in np.argsort(-v)[:WITNESSES] if v[i] > 0 and b[i] not in in_clean]
            witnesses += said or [b[int(np.argmax(v))]]
        kinds, counts = np.unique(np.array(witnesses, object), return_counts=True)
        common = [kinds[i] for i in np.argsort(-counts, kind="stable")[: landmarks * 3 // 4]]
        chosen = list(dict.fromkeys(common + hard[-landmarks // 8:] + spread))[:landmarks]
        points = Landmarks.of(chosen)
        gram = points.rows @ points.rows.T
        value, vector = np.linalg.eigh(gram.astype(np.float64))
        good = value > 1e-4 * value.max()
        half = vector[:, good] / np.sqrt(value[good])
        negative = list(dict.fromkeys(spread + hard))
        parts = list(kinds) + negative
        z = points.kernel(parts) @ half
        target = np.concatenate([np.ones(len(kinds)), -np.ones(len(negative))])
        weight = np.concatenate([np.sqrt(counts) / np.sqrt(counts).sum() * len(negative) * 0.5, np.ones(len(negative))])
        w = _svm(z, target, weight, ridge=1.0)
        current = Fitted(points.folded(half @ w[:-1]), float(w[-1]), 1.0, 0.0)
    # logistic calibration on rows that no fit has seen
    top = current.largest([t for t, c in zip(texts, calibration) if c])
    yc = y[calibration].astype(float)
    target = np.where(yc > 0, (yc.sum() + 1) / (yc.sum() + 2), 1 / ((1 - yc).sum() + 2))
    mass = np.where(yc > 0, stands_for[1], stands_for[0])
    mass = mass / mass.mean()
    centre, scale = top.mean(), top.std() + 1e-9
    x = np.stack([(top - centre) / scale, np.ones(len(top))], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        b += np.linalg.solve((x * (mass * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2),
                             x.T @ (mass * (target - p)) - 1e-3 * b)
    return Fitted(current.triple_weight, current.bias, float(b[0] / scale), float(b[1] - b[0] * centre / scale))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_rows: int = MAX_ROWS) -> Fitted:
    """Fit on at most ``max_rows`` labelled rows of each class, one row per id (of several texts
    the one with the smallest hash).

    The bounded sample is fitted in a task, so the driver holds neither its
    texts nor the kernel matrices, and a lost executor only repeats the fit.
    """
    mark = (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.avg("toxic").alias("label"))
            .where(~hash_modulo("id", 4, 2)))
    all_rows = mark.agg(F.count_if(F.col("label") < 0.5), F.count_if(F.col("label") >= 0.5)).first()
    stands_for = tuple(max(1.0, n / max_rows) for n in all_rows)
    order = [F.xxhash64("id"), F.col("id")]
    mark = (mark.where("label >= 0.5").orderBy(*order).limit(max_rows)
            .unionByName(mark.where("label < 0.5").orderBy(*order).limit(max_rows)))
    text = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    known = text.join(F.broadcast(mark), "id").groupBy("id").agg(   # 2 * max_rows ids
        F.min("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        rows = pd.concat(frames).sort_values("id")
        m = fit(rows["text"].tolist(), rows["label"].to_numpy(float), stands_for=stands_for)
        yield pd.DataFrame({"weights": [m.triple_weight.astype(np.float32).tobytes()], "bias": [m.bias],
                            "slope": [m.slope], "shift": [m.shift]})

    ship(docs.sparkSession)
    row = known.repartition(1).mapInPandas(run, "weights binary, bias double, slope double, shift double").first()
    if row is None:   # no labelled text
        return fit([], np.zeros(0))
    return Fitted(np.frombuffer(row.weights, np.float32), row.bias, row.slope, row.shift)


def score_toxicity(docs: DataFrame, model: Fitted, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight per triple: 1 MB

    def score(cols: dict[str, list]) -> dict[str, list]:
        p = shared.value.score(cols["text"])
        return {"id": cols["id"], "held_out": cols["held_out"], "score": p, "predicted": (p >= threshold).astype(np.int32)}

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("held_out", hash_modulo("id", 4, 2))
    kind = narrow.schema["id"].dataType.simpleString()
    out = map_batches(narrow, score, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labelled rows, score every row."""
    return score_toxicity(docs, fit_toxicity(docs, labels, id_col, text_col, max_rows), id_col, text_col, threshold)


def without_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``labelled`` doesn't reject, columns as they were."""
    model = fit_toxicity(labelled, labels, id_col, text_col)
    return docs.where(toxic_score(docs, model, text_col) < F.lit(THRESHOLD))


def toxic_score(docs: DataFrame, model: Fitted, text_col: str = "text"):
    """The score as a column over the text, for filters that keep all other columns in place."""
    from pyspark.sql.pandas.functions import pandas_udf

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(texts)))

    return pandas_udf(score, "double")(F.col(text_col))
