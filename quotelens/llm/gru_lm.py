"""Operator 7: scoring with a gated recurrent language model trained here.

Tokens are the words (A-Z in lower case) and one end per document.  The model
factors a token's probability into P(class | history) * P(token | class):

* a GRU in numpy reads the tokens (embeddings of the ``FREQUENT`` commonest
  words; other words share one embedding per word shape) and gives the
  distribution of the next token's class by a softmax;
* the classes are clusters of frequent words by their contexts, the shapes of
  all other words, and the end; within a class a token has its smoothed share
  of the training counts, (c + 0.1) / sum, so every word has a probability.

Documents lie end to end in parallel streams; the state is carried from one
truncated window to the next through a whole document and reset at its start.

1. Documents are encoded once in blocks of about BLOCK_BYTES of text: a block is
   a row of word numbers and its word table (64-bit hashes, shapes, training
   counts).  All further passes read numbers, no text.
2. Summed over all training documents these are the corpus counts, and the
   frequent words' contexts, summed likewise, give the classes.  A start
   model is fitted on ``start_docs`` documents (by a hash of the ids) on the
   driver; then every partition trains on all of its training documents from
   that start, and the parameters are averaged by tokens, tree-wise.
3. Each block gets the counts of its own rarer words back by a join (where
   other blocks hold them too), so the vocabulary is never held in one place,
   and is scored as a whole.

Defined cases: NULL or empty text is the end alone; repeated rows are scored
row by row and learnt from as often; without training tokens the model's
classes are equally likely and base counts are 0.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_modulo, ship, staged

FREQUENT, CLUSTERS, EMBEDDING, HIDDEN = 8192, 24, 16, 16
STREAMS, STEPS = 512, 32
BLOCK_BYTES = 16 << 20
START_DOCS = 1000
SMOOTH = 0.1
SHAPES = 24
END = xxhash.xxh3_64_intdigest(b"\n") - (1 << 63)  # white space is never a word
_TAIL = np.full(256, 3, np.int64)
_TAIL[[*range(97, 123), *range(128, 256)]] = 0
_TAIL[[44, 46, 58, 59, 63]] = 1
_TAIL[33] = 2
_TAIL = _TAIL.tolist()


def shape(word: bytes) -> int:
    """Characters beyond ASCII, kind of the last one, length."""
    return (0 if word.isascii() else 12) + _TAIL[word[-1]] * 3 + (0 if len(word) < 5 else 1 if len(word) < 9 else 2)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Block:
    """The documents of a block as arrays of local word numbers; the end is number 0."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[bytes, int] = {b"\n": 0}
        self.docs: list[np.ndarray] = []
        for t in texts:
            self.add(t)
        self.close()

    def add(self, text: str | None) -> None:
        number = self.number
        self.docs.append(np.array([number.setdefault(w, len(number)) for w in words_of(text)] + [0], np.int32))

    def close(self) -> None:
        self.hash = np.array([word_hash(w) for w in self.number], np.int64)
        self.shape = np.array([shape(w) for w in self.number], np.int32)

    @staticmethod
    def of(row: dict) -> "Block":
        """From a written row; ``held`` tells the held-out documents."""
        out = Block.__new__(Block)
        codes = np.frombuffer(row["codes"], np.int32)
        out.docs = np.split(codes, np.cumsum(row["sizes"])[:-1]) if len(row["sizes"]) else []
        out.hash, out.shape = np.asarray(row["h"], np.int64), np.asarray(row["shape"], np.int32)
        out.ids, out.held = row["ids"], np.asarray(row["held"], bool)
        return out

    def training(self) -> list[np.ndarray]:
        return [d for d, held in zip(self.docs, self.held) if not held]


class Vocabulary:
    """Frequent words by hash, their class, and every class's counts."""

    def __init__(self, top: np.ndarray, top_count: np.ndarray, cluster: np.ndarray, shape_count: np.ndarray,
                 shape_words: np.ndarray, ends: int):
        order = np.argsort(top)
        self.top, self.top_count, self.cluster = top[order], top_count[order], cluster[order]
        self.clusters = int(cluster.max()) + 1 if len(cluster) else 0
        size = np.bincount(self.cluster, self.top_count + SMOOTH, self.clusters)
        self.top_share = np.log10((self.top_count + SMOOTH) / size[self.cluster]) if len(top) else np.zeros(0)
        self.shape_total = shape_count + SMOOTH * (shape_words + 1)
        self.ends = ends

    @property
    def inputs(self) -> int:  # frequent words, shapes, the end
        return len(self.top) + SHAPES + 1

    @property
    def classes(self) -> int:  # clusters, shapes, the end
        return self.clusters + SHAPES + 1

    def place(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per local word: input number, class, place among the frequent words (-1: rarer)."""
        at = np.minimum(np.searchsorted(self.top, block.hash), max(0, len(self.top) - 1))
        known = self.top[at] == block.hash if len(self.top) else np.zeros(len(block.hash), bool)
        known[0] = False
        inputs = np.where(known, at, len(self.top) + block.shape)
        classes = np.where(known, self.cluster[at] if len(self.top) else 0, self.clusters + block.shape)
        inputs[0], classes[0] = self.inputs - 1, self.classes - 1
        return inputs, classes, np.where(known, at, -1)


class Gru:
    """Embedding, gated recurrent unit and class softmax, with truncated backpropagation."""

    NAMES = ("emb", "w", "u", "b", "out", "bias")

    def __init__(self, inputs: int, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        e, h = EMBEDDING, HIDDEN
        self.p = {"emb": normal(inputs, e, scale=0.3), "w": normal(e, 3 * h, scale=e ** -0.5),
                  "u": normal(h, 3 * h, scale=h ** -0.5), "b": np.zeros(3 * h, np.float32),
                  "out": normal(h, classes, scale=0.1), "bias": np.zeros(classes, np.float32)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.step = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> "Gru":
        at = 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = flat[at:at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self

    def _forward(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray):
        """x, keep: steps x streams.  Returns all that backpropagation needs: embeddings, states before
        each step (0 at a document's start) and after it, gates, candidates and their recurrent part."""
        t, n = x.shape
        k = HIDDEN
        e = self.p["emb"][x.ravel()]
        pre = (e @ self.p["w"] + self.p["b"]).reshape(t, n, 3 * k)
        hs, start = np.empty((t + 1, n, k), np.float32), np.empty((t, n, k), np.float32)
        zr, cand, hu = np.empty((t, n, 2 * k), np.float32), np.empty((t, n, k), np.float32), np.empty((t, n, k), np.float32)
        u = self.p["u"]
        pre[:, :, :2 * k] *= -1  # of the gates: -(a + b) is -a - b to the bit
        hs[0] = h
        for i in range(t):
            h = np.multiply(hs[i], keep[i][:, None], out=start[i])
            g = h @ u
            a = zr[i]
            np.subtract(pre[i, :, :2 * k], g[:, :2 * k], out=a)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            hu[i] = g[:, 2 * k:]
            c = cand[i]
            np.multiply(a[:, k:], hu[i], out=c)
            c += pre[i, :, 2 * k:]
            np.tanh(c, out=c)
            hs[i + 1] = c + a[:, :k] * (h - c)
        return e, start, hs, zr, cand, hu

    def _log_classes(self, hs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(natural log probability of each target class, exponentials of all classes, their sum) of flattened states."""
        s = hs.reshape(-1, HIDDEN) @ self.p["out"]
        s += self.p["bias"]
        s -= s.max(axis=1, keepdims=True)
        target = s[np.arange(len(s)), y]
        np.exp(s, out=s)
        total = s @ np.ones(s.shape[1], np.float32)
        return target - np.log(total), s, total

    def log_classes(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.float32)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for at in range(0, len(x), STEPS):
            hs = self._forward(x[at:at + STEPS], keep[at:at + STEPS], h)[2]
            part = y[at:at + STEPS]
            out[at:at + STEPS] = self._log_classes(hs[1:], part.ravel())[0].reshape(part.shape)
            h = hs[-1]
        return out

    def train(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray, real: np.ndarray, rate: float) -> None:
        """One pass over the streams: a step of Adam per truncated window."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for at in range(0, len(x), STEPS):
            s = slice(at, at + STEPS)
            h = self._learn(x[s], keep[s], y[s], real[s], h, rate)

    def _learn(self, x, keep, y, real, h, rate) -> np.ndarray:
        k, (t, n) = HIDDEN, x.shape
        e, start, hs, zr, cand, hu = self._forward(x, keep, h)
        _, soft, total = self._log_classes(hs[1:], y.ravel())
        share = real.ravel() / np.float32(max(1.0, real.sum()))
        soft *= (share / total)[:, None]
        soft[np.arange(t * n), y.ravel()] -= share
        flat = hs[1:].reshape(-1, k)
        grad = {"out": flat.T @ soft, "bias": soft.sum(axis=0)}
        dh_out = (soft @ self.p["out"].T).reshape(t, n, k)
        dpre = np.empty((t, n, 3 * k), np.float32)
        dg = np.empty((t, n, 3 * k), np.float32)
        dh = np.zeros((n, k), np.float32)
        ut = np.ascontiguousarray(self.p["u"].T)
        z, r = np.ascontiguousarray(zr[:, :, :k]), np.ascontiguousarray(zr[:, :, k:])
        not_z, not_r, slope, moved = 1 - z, 1 - r, 1 - cand * cand, start - cand
        for i in range(t - 1, -1, -1):
            dh += dh_out[i]
            dc, dz, d = dh * not_z[i], dh * moved[i], dg[i]
            dc *= slope[i]
            dz *= z[i]
            np.multiply(dz, not_z[i], out=d[:, :k])
            dr = dc * hu[i]
            dr *= r[i]
            np.multiply(dr, not_r[i], out=d[:, k:2 * k])
            dpre[i, :, 2 * k:] = dc
            np.multiply(dc, r[i], out=d[:, 2 * k:])
            dh *= z[i]
            dh += d @ ut
            dh *= keep[i][:, None]
        dpre[:, :, :2 * k] = dg[:, :, :2 * k]
        flat_pre = dpre.reshape(-1, 3 * k)
        grad["u"] = start.reshape(-1, k).T @ dg.reshape(-1, 3 * k)
        grad["w"] = e.T @ flat_pre
        grad["b"] = flat_pre.sum(axis=0)
        de = flat_pre @ self.p["w"].T
        ids = x.ravel()
        grad["emb"] = np.stack([np.bincount(ids, de[:, j], len(self.p["emb"])) for j in range(EMBEDDING)], axis=1).astype(np.float32)
        self._adam(grad, rate)
        return hs[-1]

    def _adam(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        fix = np.float32(np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step))
        for k, g in grad.items():
            self.m[k] *= np.float32(0.9)
            self.m[k] += np.float32(0.1) * g
            self.v[k] *= np.float32(0.999)
            self.v[k] += np.float32(0.001) * g * g
            self.p[k] -= np.float32(rate) * fix * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))


def streams(docs: list[np.ndarray], inputs: np.ndarray, classes: np.ndarray):
    """Documents end to end in parallel streams: inputs, keep (0 at a document's start), target
    classes, real (0 in padding), and each document's (stream, first step)."""
    # no more streams than the longest document fills, so that little of them is padding
    n = max(1, min(STREAMS, len(docs), -(-sum(map(len, docs)) // max(map(len, docs), default=1))))
    load = [(0, s) for s in range(n)]
    place: list[tuple[int, int]] = [(0, 0)] * len(docs)
    for d in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        used, s = heapq.heappop(load)
        place[d] = (s, used)
        heapq.heappush(load, (used + len(docs[d]), s))
    steps = max((u for u, _ in load), default=0)
    x = np.full((steps, n), inputs[0], np.int64)
    y, keep, real = np.zeros((steps, n), np.int64), np.ones((steps, n), np.float32), np.zeros((steps, n), np.float32)
    for d, (s, at) in zip(docs, place):
        x[at + 1:at + len(d), s] = inputs[d[:-1]]
        y[at:at + len(d), s] = classes[d]
        keep[at, s] = 0
        real[at:at + len(d), s] = 1
    return x, keep, y, real, place


def context_sums(block: Block, docs: list[np.ndarray], order: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Per frequent word (``order``: their sorted hashes): summed codes of two words to the left, then to the right."""
    at = np.minimum(np.searchsorted(order, block.hash), max(0, len(order) - 1))
    known = np.where(order[at] == block.hash, at, len(order))
    k = np.concatenate([known[d] for d in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    pairs = [(k[gap:][same], k[:-gap][same]) for gap in (1, 2) for same in [doc[gap:] == doc[:-gap]]]
    word, before = (np.concatenate(x) for x in zip(*pairs))
    n = len(order) + 1
    pair, count = np.unique(word * n + before, return_counts=True)
    out = np.zeros((n, 2 * code.shape[1]), np.int64)
    for target, other, half in ((pair // n, pair % n, 0), (pair % n, pair // n, 1)):
        by = np.argsort(target, kind="stable")
        by = by[target[by] < len(order)]
        for some in np.array_split(by, len(by) // 100_000 + 1):
            if len(some):
                first = np.flatnonzero(np.diff(target[some], prepend=-1))
                out[target[some][first], half * code.shape[1]:(half + 1) * code.shape[1]] += np.add.reduceat(
                    code[other[some]] * count[some, None].astype(np.int32), first)
    return out[:-1]


def word_contexts(blocks: DataFrame, top: np.ndarray, seed: int = 3, width: int = 48, group: int = 128) -> np.ndarray:
    """The frequent words' contexts over all training documents, in the order of their sorted hashes.

    Codes are signs, so the sums are whole numbers and don't depend on how rows lie in partitions.
    """
    order = np.sort(top)
    code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int32), (len(order) + 1, width))
    shared = blocks.sparkSession.sparkContext.broadcast((order, code))  # under 2 MB

    def partial(batches):
        order, code = shared.value
        total = np.zeros((len(order), 2 * width), np.int64)
        for block in written_blocks(batches):
            if mine := block.training():
                total += context_sums(block, mine, order, code)
        if total.any():
            rows = [zlib.compress(total[i:i + group].tobytes(), 1) for i in range(0, len(order), group)]
            yield [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())]

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(r), np.int64) for r in rows["sums"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "sums": [zlib.compress(total.tobytes(), 1)]})

    names, schema = ["part", "sums"], "part int, sums binary"
    with few_rows(blocks.sparkSession):
        parts = staged(blocks.mapInArrow(_arrow_rows(partial, names), schema), "lm-contexts")
    sums = parts.groupBy("part").applyInPandas(add, schema)
    context = np.zeros((len(order), 2 * width), np.int64)
    for r in sums.collect():  # one row per ``group`` words
        rows = np.frombuffer(zlib.decompress(r["sums"]), np.int64).reshape(-1, 2 * width)
        context[r["part"] * group:r["part"] * group + len(rows)] = rows
    return context


def cluster_words(context: np.ndarray, top: np.ndarray, clusters: int, seed: int = 3) -> np.ndarray:
    """K-means of the frequent words' contexts (rows in the order of their sorted hashes)."""
    x = context.astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centre = x[np.random.default_rng(seed).permutation(len(x))[:clusters]]
    label = np.zeros(len(x), np.int64)
    for _ in range(12):
        label = (x @ centre.T).argmax(axis=1)
        total = np.stack([np.bincount(label, x[:, j], len(centre)) for j in range(x.shape[1])], axis=1)
        centre = (total / (np.linalg.norm(total, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    back = np.empty(len(top), np.int64)
    back[np.argsort(top)] = np.unique(label, return_inverse=True)[1]
    return back


def _arrow_rows(run, schema_names):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out, names=schema_names)
    return rows


BLOCK = ("block long, ids array<long>, held array<boolean>, sizes array<int>, codes binary, h array<long>, "
         "shape array<int>, n array<int>")


#: Blocks are written one to a row group: whoever writes or reads them holds one at a time, however many a file has.
ONE_A_GROUP = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1}


@contextmanager
def few_rows(spark: SparkSession, rows: int = 1, whole_files: bool = False):
    """Arrow batches of a few rows for what is run inside: a block is one row of several MB.

    With ``whole_files`` every file read is a partition of its own, the one that wrote it."""
    inside = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows}
    if whole_files:
        inside |= dict.fromkeys(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), 1 << 40)
    before = {key: spark.conf.get(key) for key in inside}
    for key, value in inside.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}
            yield Block.of({"ids": row["ids"].as_py(), "held": row["held"].as_py(), "sizes": row["sizes"].values.to_numpy(),
                            "codes": row["codes"].as_buffer(), "h": row["h"].values.to_numpy(), "shape": row["shape"].values.to_numpy()})


def blocked(docs: DataFrame, id_col: str, text_col: str, rest: int) -> DataFrame:
    """One row per block (BLOCK): documents in reading order, cut where a block is full, and its word table."""
    ship(docs.sparkSession)

    def rows(block: Block, number: int, ids: list, held: list) -> list[pa.Array]:
        block.close()
        mine = [d for d, h in zip(block.docs, held) if not h]
        n = np.bincount(np.concatenate(mine or [np.zeros(0, np.int32)]), minlength=len(block.hash))
        one = lambda x, t: pa.array([x], pa.list_(t))
        return [pa.array([number], pa.int64()), one(ids, pa.int64()), one(held, pa.bool_()),
                one(np.array([len(d) for d in block.docs], np.int32), pa.int32()),
                pa.array([np.concatenate(block.docs).tobytes()], pa.binary()),
                one(block.hash, pa.int64()), one(block.shape, pa.int32()), one(n.astype(np.int32), pa.int32())]

    def cut(batches):
        number, size, block, ids, held = TaskContext.get().partitionId() << 32, 0, Block([]), [], []
        for b in batches:
            for i, h, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                n = len(text or "")
                if size and size + n > BLOCK_BYTES:
                    yield rows(block, number, ids, held)
                    number, size, block, ids, held = number + 1, 0, Block([]), [], []
                block.add(text)
                ids.append(i)
                held.append(h)
                size += n
        if ids:
            yield rows(block, number, ids, held)

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    with few_rows(docs.sparkSession, 1000):
        return staged(narrow.select("id", hash_modulo("id", 10, rest).alias("held_out"), "text")
                      .mapInArrow(_arrow_rows(cut, [f.split()[0] for f in BLOCK.split(", ")]), BLOCK), "lm-blocks", ONE_A_GROUP)


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, h, n, shape): each block's distinct words with their counts in its training documents."""
    table = F.explode(F.slice(F.arrays_zip("h", "n", "shape"), 2, 1 << 30))  # number 0 is the end
    return blocks.select("block", table.alias("w")).select("block", "w.h", F.col("w.n").cast("long").alias("n"), "w.shape")


def train(blocks: DataFrame, vocabulary: Vocabulary, start: Gru, rate: float) -> Gru:
    """Every partition trains on all its training documents from ``start``; parameters averaged by tokens."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast((vocabulary, start.flat()))  # one model: under 1 MB

    def learn(batches):
        words, flat = shared.value
        model, tokens = Gru(words.inputs, words.classes).load(flat), 0
        for block in written_blocks(batches):
            if mine := block.training():
                inputs, classes, _ = words.place(block)
                x, keep, y, real, _ = streams(mine, inputs, classes)
                model.train(x, keep, y, real, rate)
                tokens += int(real.sum())
        if tokens:
            yield [pa.array([float(tokens)]), pa.array([model.flat().astype(np.float32).tobytes()], pa.binary())]

    def merge(batches):
        total, weight = None, 0.0
        for b in batches:
            for w, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(raw, np.float32) * np.float64(w)
                total, weight = part if total is None else total + part, weight + w
        if weight:
            yield [pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())]

    names, schema = ["tokens", "model"], "tokens double, model binary"
    with few_rows(blocks.sparkSession, whole_files=True):
        models = staged(blocks.mapInArrow(_arrow_rows(learn, names), schema), "lm-models")
    n = models.count()
    while n > 32:  # about 32 models of a level become one
        models = staged(models.repartition(-(-n // 32)).mapInArrow(_arrow_rows(merge, names), schema), "lm-models")
        n = models.count()
    rows = models.collect()
    if not rows:
        return start
    weight = np.array([r["tokens"] for r in rows])
    flat = sum(np.frombuffer(r["model"], np.float32) * (w / weight.sum()) for r, w in zip(rows, weight))
    return Gru(vocabulary.inputs, vocabulary.classes).load(flat)


def first_texts(narrow: DataFrame, n: int) -> list[str | None]:
    """The texts of the first n rows by a hash of the ids; the last hash comes first, so that
    the driver gets about n texts and not n of every partition."""
    order = F.xxhash64("id")
    last = narrow.select("id", order.alias("h")).orderBy("h", "id").limit(n).agg(F.max("h")).first()[0]
    return narrow.where(order <= F.lit(last)).orderBy(order, "id").limit(n).select("text").toPandas()["text"].tolist()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: int = 0,
                    frequent: int = FREQUENT, clusters: int = CLUSTERS, start_docs: int = START_DOCS,
                    start_epochs: int = 3) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = blocked(docs, id_col, text_col, rest)
    words = block_words(blocks)
    counts = staged(words.groupBy("h").agg(F.sum("n").alias("c"), F.first("shape").alias("shape")).where("c > 0"), "lm-counts")
    ends = blocks.select(F.explode("held").alias("held")).where("NOT held").count()
    total = counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # SHAPES rows
    tokens = sum(r["c"] for r in total) + ends
    distinct = sum(r["v"] for r in total) + (ends > 0)
    top = counts.orderBy(F.desc("c"), "h").limit(frequent).collect()
    shape_count, shape_words = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in total:
        shape_count[r["shape"]], shape_words[r["shape"]] = r["c"], r["v"]
    for r in top:
        shape_count[r["shape"]] -= r["c"]
        shape_words[r["shape"]] -= 1
    top_hash = np.array([r["h"] for r in top], np.int64)
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(~hash_modulo("id", 10, rest))
    sample = first_texts(narrow, start_docs)
    block = Block(sample)
    label = cluster_words(word_contexts(blocks, top_hash), top_hash, clusters) if len(top) else np.zeros(0, np.int64)
    vocabulary = Vocabulary(top_hash, np.array([r["c"] for r in top], np.float64), label, shape_count, shape_words, ends)
    model = Gru(vocabulary.inputs, vocabulary.classes)
    if sample:
        inputs, classes, _ = vocabulary.place(block)
        x, keep, y, real, _ = streams(block.docs, inputs, classes)
        seen = np.concatenate([np.bincount(label, [r["c"] for r in top], vocabulary.clusters), shape_count, [ends]])
        model.p["bias"] = np.log(seen + 1).astype(np.float32)
        for epoch in range(start_epochs):
            model.train(x, keep, y, real, 0.01 * 0.6 ** epoch)
        model = train(blocks, vocabulary, model, 0.002)
    return _scored(blocks, words, counts, vocabulary, model, tokens, distinct).withColumnRenamed("id", id_col)


def _scored(blocks: DataFrame, words: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Gru,
            tokens: int, distinct: int) -> DataFrame:
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, model.flat()))
    known = spark.createDataFrame([(int(h),) for h in vocabulary.top], "h long")
    # a block knows its own counts: it is sent those of words that other blocks hold too
    rarer = (words.select("block", "h", "n").join(F.broadcast(known), "h", "left_anti")
             .join(counts.select("h", "c"), "h").where("c <> n").select(F.col("block").alias("of"), "h", "c"))
    floor = tokens + SMOOTH * (distinct + 1)

    def score(docs: pd.DataFrame, rare: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c: [] for c in names})
        vocab, flat = shared.value
        gru = Gru(vocab.inputs, vocab.classes).load(flat)
        row = docs.iloc[0]
        block = Block.of(row)
        inputs, classes, at = vocab.place(block)
        h, c = rare["h"].to_numpy(np.int64), rare["c"].to_numpy(np.float64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        count = np.asarray(row["n"]).astype(float)
        if len(h):
            spot = np.minimum(np.searchsorted(h, block.hash), len(h) - 1)
            count = np.where(h[spot] == block.hash, c[spot], count)
        top = at >= 0
        count[top] = vocab.top_count[at[top]]
        count[0] = vocab.ends
        base = np.log10((count + SMOOTH) / floor)
        inside = np.zeros(len(count))
        inside[top] = vocab.top_share[at[top]]
        low = ~top
        low[0] = False
        inside[low] = np.log10((count[low] + SMOOTH) / vocab.shape_total[classes[low] - vocab.clusters])
        x, keep, y, _, place = streams(block.docs, inputs, classes)
        log = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(gru.log_classes(x, keep, y).astype(np.float64), axis=0)])
        chain = [(log[t + len(d), s] - log[t, s]) / np.log(10) for d, (s, t) in zip(block.docs, place)]
        return pd.DataFrame({
            "id": pd.array(block.ids, "Int64"), "held_out": block.held, "n_tokens": [len(d) for d in block.docs],
            "n_known": [int((count[d] > 0).sum()) for d in block.docs], "train_tokens": tokens,
            "base_score": [float(base[d].sum()) for d in block.docs],
            "score": [float(g + inside[d].sum()) for g, d in zip(chain, block.docs)]})

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = ("id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return blocks.groupBy("block").cogroup(rarer.groupBy("of")).applyInPandas(score, schema)
