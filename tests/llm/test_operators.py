"""The training-data operators against brute force, and on difficult rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelens.llm import (components, decontamination, exact_dedup, gru_lm, line_dedup, minhash, mixing, quality,
                           suffix_dedup, token_counts, toxicity)

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, key string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, partitions=3):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, None, "x", "y", "z", 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def hard_rows():
    rng = random.Random(3)
    words = ["wa" + str(rng.randrange(500)) for _ in range(400)]
    long_text = " ".join(rng.choice(words) for _ in range(30_000))
    line = "This very line is long enough to be counted as repeated."
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two", "b"), (5, "One  TWO", "b"),
            (6, "one two", "b"), (6, "one two", "b"), (None, "one two", None), (7, long_text, "c"), (8, long_text, "c"),
            (9, "äöü ß " * 200, "c"), (10, "x" * 5000, "b"), (None, None, None)]
    return rows + [(20 + k, f"start {k}\n  {line.upper()}\nend", "d") for k in range(6)]


@pytest.fixture(scope="module")
def hard(spark):
    return frame(spark, hard_rows())


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# ------------------------------------------------------------------ 1 mixing
def test_targets_share_the_excess_again():
    sizes, weights = np.array([100.0, 10.0, 1.0, 0.0]), np.array([1.0, 2.0, 3.0, 1.0])
    t = mixing.targets(sizes, weights)
    assert t[2] == 3 and t[1] == 30 and t[3] == 0 and abs(t.sum() - 111) < 1e-9
    rng = np.random.default_rng(1)
    for _ in range(50):
        s, w = rng.integers(1, 1000, 8).astype(float), np.array([1.0, 2, 3, 1, 2, 3, 1, 2])
        t = mixing.targets(s, w)
        assert (t <= 3 * s + 1e-9).all() and abs(t.sum() - s.sum()) < 1e-6
        free = t < 3 * s - 1e-9
        assert np.ptp(t[free] / w[free]) < 1e-9 if free.any() else True


def test_splitting_tree_keeps_exact_quotas():
    counts = np.array([70, 1, 0, 33])
    q = mixing.split_quotas(counts, 8, 5)
    assert (q.sum(axis=0) == counts).all() and np.ptp(q.sum(axis=1)) <= 1
    assert (q == mixing.split_quotas(counts, 8, 5)).all()


def test_mix_takes_exactly_the_targets(spark, small, hard, nothing):
    for docs, block in ((small, 3000), (hard, 50), (small, 10 ** 9)):
        out = mixing.mix_words(docs, block_words=block, shard_blocks=2)
        rows = out.join(docs.select("doc_id", "source").distinct(), "doc_id").collect() if docs is small else None
        assert out.count() == docs.count()
        assert out.where("taken > 3 * size OR taken < 0").count() == 0
        if rows:
            taken, target = Counter(), {}
            for r in rows:
                taken[r.source] += r.taken
                target[r.source] = r.target
            assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.mix_words(small.repartition(7), block_words=3000, shard_blocks=2).drop("draws")
    first = mixing.mix_words(small, block_words=3000, shard_blocks=2).drop("draws")
    assert again.exceptAll(first).count() == 0
    assert mixing.mix_words(nothing).count() == 0


def test_mixed_rows_hold_the_words_they_count(spark, small, hard, nothing):
    words = F.regexp_count("text", F.lit(mixing.WORD))
    for docs in (small, hard):
        out = mixing.mix(docs, block_words=2000, shard_blocks=4)
        assert out.columns == [*docs.columns, "mix_shard", "mix_epoch", "mix_words"]
        assert out.where(words != F.col("mix_words")).count() == 0
    want = sum(r.taken for r in mixing.mix_words(small, block_words=2000, shard_blocks=4).collect())
    got = mixing.mix(small, block_words=2000, shard_blocks=4)
    assert got.agg(F.sum("mix_words")).first()[0] == want
    assert mixing.mix(nothing).count() == 0


# ------------------------------------------------------------------ 2 token counts
def greedy(word, first, rest):
    n, at, vocabulary = 0, 0, first
    while at < len(word):
        size = max(k for k in range(1, len(word) - at + 1) if word[at:at + k] in vocabulary)
        at, n, vocabulary = at + size, n + 1, rest
    return n


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(30):
        letters = b"ab" if rng.random() < 0.5 else b"abc"
        piece = lambda: bytes(rng.choice(letters) for _ in range(rng.randint(2, 6)))
        one = {bytes([c]) for c in letters}
        first, rest = one | {piece() for _ in range(6)}, one | {piece() for _ in range(6)}
        counter = token_counts.WordPieceCounter(sorted(first), sorted(rest))
        for _ in range(200):
            w = bytes(rng.choice(letters) for _ in range(rng.randint(1, 15)))
            assert counter.count(w) == greedy(w, first, rest), (w, first, rest)


def test_token_counts_of_documents(small, hard, nothing):
    first, rest = map(set, token_counts.read_vocabulary(token_counts.DEFAULT_VOCABULARY))
    got = {r.doc_id: r for r in token_counts.count_tokens(small).collect()}
    for i, t in list(texts_of(small).items())[:60]:
        words = t.encode().split()
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(greedy(w, first, rest) for w in words))
    out = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(hard).collect()}
    assert out[1] == out[2] == out[3] == 0 and out[7] == out[8] > 30_000
    assert token_counts.count_tokens(nothing).count() == 0


# ------------------------------------------------------------------ 3 exact dedup
def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] if m[0] is not None else -2 ** 63))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep[0], len(members), (i, n) == keep, digest) for i, n in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, small, hard, nothing, bits):
    for docs in (small, hard):
        got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(docs, bits=bits).collect()), key=repr)
        assert got == exact_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_dedup.exact_duplicates(nothing, bits=bits).count() == 0


def test_surviving_rows(hard, small):
    out = exact_dedup.surviving(hard)
    assert out.columns == hard.columns
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in hard_rows()})
    assert sorted(r.doc_id for r in exact_dedup.surviving(small).collect()) == sorted(
        {k for _, k, *_ in exact_brute(list(texts_of(small).items()))})


def test_texts_with_one_chunk_exchanged_differ(spark):
    rng = random.Random(5)
    a, b, c = ("".join(rng.choice("abcdefghij") for _ in range(3000)) for _ in range(3))
    docs = frame(spark, [(1, a + b + c, "s"), (2, a + c + b, "s"), (3, a + " " + b + c, "s")])
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs).collect()} == {1: 3, 2: 2, 3: 3}


# ------------------------------------------------------------------ 4 near dedup
def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, small, nothing):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, t, "s") for i, t in texts_of(small).items()]
    for k in range(40):  # a chain of copies, each a few words from the last one
        base = list(base)
        for _ in range(3):
            base[rng.randrange(300)] = f"v{rng.randrange(5000)}"
        rows.append((10_000 + k, " ".join(base), "s"))
    rows += [(20_000, None, "s"), (20_001, "", "s"), (20_002, "a b", "s"), (20_003, "A  B", "s")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    want = near_brute([(i, t) for i, t, _ in rows])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][1]) for i, r in got.items())
    stay = minhash.one_of_each_group(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, w in want.items() if w[1] == i)
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_hard_rows(hard):
    rows = minhash.near_duplicates(hard).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(hard_rows())
    assert got[4].component_id == got[6].component_id == 4 and got[8].component_id == 7
    assert got[1].n_shingles == got[3].n_shingles == 0 and got[2].component_id == 2


def test_parity_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for size in (1, 5, 60, 300, 5000):
        for shared in (0.0, 0.5, 0.9, 1.0):
            both = rng.integers(0, 2**63, int(size * shared) + 1).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, size).astype(np.uint64)])) for _ in "ab")
            flipped = minhash.parity_sketch(a) ^ minhash.parity_sketch(b)
            differ = int(np.bitwise_count(flipped.view(np.uint64)).sum())  # signed numbers would count their absolute value
            apart = len(np.setxor1d(a, b))
            assert differ <= apart and differ % 2 == apart % 2
            assert not (minhash.parity_sketch(a) ^ minhash.parity_sketch(a)).any()


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
        a, b = pool[:200], pool[100:]
        same = (minhash.super_minhash(np.unique(a), 256) == minhash.super_minhash(np.unique(b), 256)).mean()
        errors.append(same - 100 / 300)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < (1 / 3 * 2 / 3 / 256) ** 0.5 * 1.2
    one = np.array([12345], np.uint64)
    assert sorted(np.floor(minhash.super_minhash(one, 32)).astype(int)) == list(range(32))


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 0, 2000: 2000, 2001: 2000}


# ------------------------------------------------------------------ 5 quality
def test_quality_on_held_out_rows(spark, hard, nothing):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify_quality(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    scored = quality.classify_quality(hard, labels.where("false")).collect()
    assert len(scored) == len(hard_rows()) and {r.score for r in scored} == {0.5}
    one_class = labels.withColumn("quality", F.lit(1))
    assert all(r.score > 0.99 for r in quality.classify_quality(hard, one_class).where("doc_id = 4").collect())
    assert quality.classify_quality(nothing, labels).count() == 0


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit_trees(x, y, trees=20)
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.97
    for row in x[:50]:
        total = m.base
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if row[m.feature[at]] <= m.cut[at] else m.right[at]
            total += m.value[at]
        assert abs(total - m.raw(row[None])[0]) < 1e-9


# ------------------------------------------------------------------ 6 line dedup
def lines_brute(rows):
    held, keeper = defaultdict(int), {}
    key = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held[k] += 1
                keeper[k] = max(keeper.get(k, -1), i if i is not None else -1)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if held.get(key(x), 0) < 5 or keeper[key(x)] == (i if i is not None else -1)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("filter_bytes", [line_dedup.FILTER_BYTES, 0])
def test_line_dedup(small, hard, nothing, filter_bytes):
    for docs in (small, hard):
        got = sorted((tuple(r) for r in line_dedup.dedup_lines(docs, filter_bytes=filter_bytes).collect()), key=repr)
        assert got == lines_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert line_dedup.dedup_lines(nothing, filter_bytes=filter_bytes).count() == 0


def test_bloom_filter_forgets_nothing():
    rng = np.random.default_rng(4)
    b, h = line_dedup.Bloom(room=64), np.unique(rng.integers(0, 2 ** 63, 5000).astype(np.uint64))
    for part in np.array_split(h, 50):
        b.add(part)
    assert b.has(h).all()
    assert b.has(rng.integers(0, 2 ** 63, 5000).astype(np.uint64)).mean() < 0.1


# ------------------------------------------------------------------ 7 language model
def test_base_score_and_counts(spark, small, hard, nothing):
    for docs in (small, hard):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
        tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
        count = Counter(w for ts, h in zip(tokens, held) if not h for w in ts)
        total = sum(count.values())
        want = sorted((i, h, len(ts), sum(count[w] > 0 for w in ts), total,
                       round(float(sum(np.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in ts)), 4))
                      for (i, _), h, ts in zip(rows, held, tokens) if i is not None)
        out = gru_lm.score_documents(docs, start_epochs=1)
        got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.score)
               for r in out.collect()]
        assert len(got) == len(rows)
        assert sorted(g[:6] for g in got if g[0] is not None) == want
        assert all(np.isfinite(g[6]) and g[6] < 0 for g in got)
    assert gru_lm.score_documents(nothing).count() == 0


def test_model_beats_word_frequencies_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    r = gru_lm.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] / r[2] > r[1] / r[2] + 0.2


def _tiny_model():
    words = gru_lm.Vocabulary(np.array([11, 22, 33]), np.array([5.0, 3.0, 2.0]), np.array([0, 1, 0]),
                              np.full(gru_lm.SHAPES, 4.0), np.full(gru_lm.SHAPES, 2.0), 3)
    return words, gru_lm.Gru(words.inputs, words.classes)


def test_class_shares_add_up_to_one():
    words, model = _tiny_model()
    for c in range(words.clusters):
        assert abs((10 ** words.top_share[words.cluster == c]).sum() - 1) < 1e-9
    # two known words of 4 counts in all and one unknown one, in every shape
    assert np.allclose(((3 + 0.1) + (1 + 0.1) + 0.1) / words.shape_total, 1)
    x = np.array([[0], [1], [2]])
    keep = np.ones((3, 1), np.float32)
    total = sum(np.exp(model.log_classes(x, keep, np.full((3, 1), c))) for c in range(words.classes))
    assert np.allclose(total, 1, atol=1e-5)


def test_backpropagation_agrees_with_differences():
    words, model = _tiny_model()
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, words.inputs, (6, 4)), rng.integers(0, words.classes, (6, 4))
    keep, real = np.ones((6, 4), np.float32), np.ones((6, 4), np.float32)
    keep[3, 1] = 0
    found = {}
    model._adam = lambda grad, rate: found.update(grad)
    model._learn(x, keep, y, real, np.zeros((4, gru_lm.HIDDEN), np.float32), 0.0)
    for name in ("u", "w", "out", "emb"):
        at = np.unravel_index(int(np.abs(found[name]).argmax()), found[name].shape)
        loss, old = [], model.p[name][at]
        for step in (1e-2, -1e-2):
            model.p[name][at] = old + step
            loss.append(-model.log_classes(x, keep, y).astype(np.float64).mean())
        model.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - found[name][at]) < 2e-3 * max(1, abs(found[name][at]) * 10)


def test_state_is_carried_through_a_document(monkeypatch):
    words, model = _tiny_model()
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, words.inputs, (50, 2)), rng.integers(0, words.classes, (50, 2))
    keep = np.ones((50, 2), np.float32)
    whole = model.log_classes(x, keep, y)
    monkeypatch.setattr(gru_lm, "STEPS", 7)
    assert np.allclose(whole, model.log_classes(x, keep, y), atol=1e-5)


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000])
def test_score_equals_the_recurrence_step_by_step(spark, hard, monkeypatch, block_bytes):
    """Every document alone, word by word, in 64-bit numbers; in one block and in many."""
    monkeypatch.setattr(gru_lm, "BLOCK_BYTES", block_bytes)
    seen = {}
    scored = gru_lm._scored

    def noted(blocks, words, counts, vocabulary, model, tokens, distinct):
        seen.update(v=vocabulary, p={k: x.astype(np.float64) for k, x in model.p.items()})
        return scored(blocks, words, counts, vocabulary, model, tokens, distinct)

    monkeypatch.setattr(gru_lm, "_scored", noted)
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = {(r.doc_id, r.n_tokens): r.score for r in gru_lm.score_documents(hard, frequent=20, start_epochs=1).collect()}
    train = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in gru_lm.words_of(t))
    v, p, k = seen["v"], seen["p"], gru_lm.HIDDEN
    place = {h: i for i, h in enumerate(v.top.tolist())}
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for i, text in rows:
        words = gru_lm.words_of(text)[:3000]
        if len(words) < len(gru_lm.words_of(text)):
            continue  # too long for this loop
        h, x, total = np.zeros(k), v.inputs - 1, 0.0
        for w in [*words, None]:
            if w is None:
                y, inside, nxt = v.classes - 1, 0.0, None
            elif gru_lm.word_hash(w) in place:
                at = place[gru_lm.word_hash(w)]
                y, nxt = int(v.cluster[at]), at
                inside = np.log10((v.top_count[at] + 0.1) / (v.top_count[v.cluster == y] + 0.1).sum())
            else:
                sh = gru_lm.shape(w)
                y, nxt = v.clusters + sh, len(v.top) + sh
                inside = np.log10((train[w] + 0.1) / v.shape_total[sh])
            pre, g = p["emb"][x] @ p["w"] + p["b"], h @ p["u"]
            z, r = sigmoid(pre[:k] + g[:k]), sigmoid(pre[k:2 * k] + g[k:2 * k])
            c = np.tanh(pre[2 * k:] + r * g[2 * k:])
            h = c + z * (h - c)
            s = h @ p["out"] + p["bias"]
            total += (s[y] - s.max() - np.log(np.exp(s - s.max()).sum())) / np.log(10) + inside
            x = nxt
        assert abs(got[i, len(words) + 1] - total) < 1e-3 * max(1.0, abs(total)), (i, len(words))


def test_lm_classes_come_from_all_training_documents(spark, small):
    docs = small.limit(120)
    blocks = gru_lm.blocked(docs, "doc_id", "text", 0)
    texts = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 10 != 0]
    count = Counter(w for t in texts for w in gru_lm.words_of(t))
    top = np.array([gru_lm.word_hash(w) for w, _ in count.most_common(300)], np.int64)
    got = gru_lm.word_contexts(blocks, top, width=8, group=7)
    order = {h: i for i, h in enumerate(np.sort(top).tolist())}
    code = np.random.default_rng(3).choice(np.array([-1, 1], np.int32), (301, 8))
    want = np.zeros((301, 16), np.int64)
    for t in texts:
        k = [order.get(gru_lm.word_hash(w), 300) for w in gru_lm.words_of(t)] + [300]
        for i in range(len(k)):
            for j in (i - 1, i - 2):
                if j >= 0:
                    want[k[i], :8] += code[k[j]]
                    want[k[j], 8:] += code[k[i]]
    assert (got == want[:300]).all()
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(gru_lm, "cluster_words", lambda context, *a, f=gru_lm.cluster_words: seen.append(context) or f(context, *a))
        gru_lm.score_documents(docs, start_docs=3, start_epochs=1)
    assert (np.abs(seen[0]).sum(axis=1) > 0).mean() > 0.99


def test_lm_blocks_are_read_one_at_a_time(spark, monkeypatch):
    """A file's blocks of over 1 MB lie in row groups of their own; training still takes a file as a whole."""
    monkeypatch.setattr(gru_lm, "BLOCK_BYTES", 2 << 20)
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.randrange(10 ** 6):x}" for _ in range(100_000))) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = gru_lm.blocked(docs, "doc_id", "text", 0)
    parquet = spark.sparkContext._jvm.org.apache.parquet.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    held = []
    for f in blocks.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, conf))
        held += [g.getRowCount() for g in reader.getRowGroups()]
        reader.close()
    assert blocks.count() > 3 and held == [1] * blocks.count()
    assert sorted(i for r in blocks.select("ids").collect() for i in r["ids"]) == list(range(16))
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[1], "1m")
    try:
        assert blocks.select("block").rdd.getNumPartitions() > 1
        with gru_lm.few_rows(spark, whole_files=True):
            assert blocks.select("*").rdd.getNumPartitions() == len(blocks.inputFiles())
    finally:
        spark.conf.set(keys[1], before[1])
    assert [spark.conf.get(k) for k in keys] == before


def test_lm_start_sample_goes_by_the_hash_of_the_ids(spark):
    ids = [*range(300), *range(40), None, None]  # some twice
    rows = spark.createDataFrame([(i, f"text of {i}") for i in ids], "id long, text string").repartition(7)
    want = [r["text"] for r in rows.orderBy(F.xxhash64("id"), "id").collect()]
    for n in (1, 90, 1000):
        assert gru_lm.first_texts(rows, n) == want[:n]
    assert gru_lm.first_texts(rows.where("false"), 5) == []


# ------------------------------------------------------------------ 8 toxicity
def test_folded_triples_equal_the_landmark_kernel():
    parts, marks = [b"loser", b"lo.ser", b"hatch", b"worthless"], toxicity.Landmarks.of([b"loser", b"idiot", b"hello"])
    k = marks.kernel(parts)
    assert abs(k[0, 0] - 1) < 1e-5 and k[1, 0] > 0.3 > k[2, 0]
    coefficients = np.array([1.0, -0.5, 0.25])
    folded = toxicity.Fitted(marks.folded(coefficients), 0.0, 1.0, 0.0)
    assert np.allclose(folded.values(parts), k @ coefficients, atol=1e-5)


def test_toxicity_learns_gapped_insults(spark, hard, nothing):
    rng = random.Random(2)
    piece = ["the", "ing", "ere", "an", "th", "ond", "est", "ha"]
    insults = ["grumbled", "snivelok", "vexhorn"]
    rows, marks = [], []
    for k in range(900):
        words = ["".join(rng.choice(piece) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        toxic = rng.random() < 0.25
        if toxic:
            words[rng.randrange(60)] = rng.choice(insults) + rng.choice(["", ",", "."])
        rows.append((k, " ".join(words), "s"))
        marks.append((k, int(toxic)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.classify_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    model = toxicity.fit_toxicity(docs, labels)
    assert (model.score(["the g.rumbled ing", "ere sniv-elok", "than v e x h o r n"]) > 0.3).all()
    left = toxicity.without_toxic(docs, docs, labels)
    assert left.columns == docs.columns and 0.7 < left.count() / 900 < 0.8
    assert toxicity.classify_toxicity(hard, labels).count() == len(hard_rows())
    assert toxicity.classify_toxicity(nothing, labels.where("false")).count() == 0
    assert {r.predicted for r in toxicity.classify_toxicity(hard, labels.where("toxic = 0")).collect()} == {0}
    # an id on several rows and texts is one row of the fit, whatever the order of the rows
    again = [(k, f"other {k} text", "s") for k, _, _ in rows[:40]]
    one, two = (toxicity.fit_toxicity(frame(spark, r), labels) for r in (rows + again + rows, again + rows[::-1]))
    assert (one.triple_weight == two.triple_weight).all() and (one.bias, one.slope) == (two.bias, two.slope)


def test_triples_reach_over_the_whole_piece():
    rng = np.random.default_rng(4)
    weight = rng.normal(size=toxicity.ALPHABET ** 3).astype(np.float32)
    model = toxicity.Fitted(weight, 0.5, 1.0, 0.0)
    parts = [b"idiot", b"i..d..i..o..t", b"l--o--s--e--r", b"v......e......x", b"abcdefghijklmnopqrstuvwx", b"ab", b"...", b"x"]
    for part, value in zip(parts, model.values(parts)):
        code, total, size = [int(toxicity._CODE[x]) for x in part], 0.0, 0.0
        for i, j, k in itertools.combinations(range(len(part)), 3):
            if code[i] and code[j] and code[k]:
                w = toxicity.DECAY ** (k - i - 2)
                total += w * weight[(code[i] * toxicity.ALPHABET + code[j]) * toxicity.ALPHABET + code[k]]
                size += w * w
        assert abs(value - (total / np.sqrt(size) if size else 0) - 0.5) < 1e-4
    marks = toxicity.Landmarks.of([b"idiot", b"loser", b"hello"])
    k = marks.kernel([b"i..d..i..o..t", b"l---o---s---e---r"])
    assert k[0, 0] > 0.7 > 0.3 > k[0, 2] and k[1, 1] > 0.7 > 0.3 > k[1, 0]


def test_toxicity_finds_wide_gaps_and_any_white_space():
    rng = random.Random(2)
    piece = ["the", "ing", "ere", "an", "th", "ond", "est", "ha"]
    texts, marks = [], []
    for _ in range(900):
        words = ["".join(rng.choice(piece) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        marks.append(rng.random() < 0.25)
        if marks[-1]:
            words[rng.randrange(60)] = rng.choice(["grumbled", "snivelok", "vexhorn", "loser"])
        texts.append(" ".join(words))
    model = toxicity.fit(texts, np.array(marks, float))
    said = ["the g..r..u..m..b..l..e..d ing", "l--o--s--e--r", "l---o---s---e---r", "v--e--x--h--o--r--n here",
            "than v  e  x  h  o  r  n", "than v\ne\nx\n\th\no\nr\nn the"]
    assert (model.score(said) > 0.3).all() and (model.score(["the th--an", "t  h  e  r  e"]) < 0.3).all()


def test_toxicity_scores_follow_the_real_share_when_classes_are_cut(spark):
    rng = random.Random(5)
    piece = ["the", "ing", "ere", "an", "th", "ond", "est", "ha"]
    rows, marks = [], []
    for k in range(2400):  # a fifth holds the insult, half of them are labelled toxic
        words = ["".join(rng.choice(piece) for _ in range(rng.randint(1, 4))) for _ in range(20)]
        said = rng.random() < 0.2
        if said:
            words[rng.randrange(20)] = "grumbled"
        rows.append((k, " ".join(words), "s"))
        marks.append((k, int(said and rng.random() < 0.5)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    texts = [t for _, t, _ in rows]
    whole, cut = (toxicity.fit_toxicity(docs, labels, max_rows=n).score(texts) for n in (4000, 150))
    share = sum(m for _, m in marks) / len(marks)
    assert abs(whole.mean() - share) < 0.03 and abs(cut.mean() - whole.mean()) < 0.04


# ------------------------------------------------------------------ 9 suffix dedup
def repeats_brute(rows, size=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + size] for _, b in raw for k in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if count[b[k:k + size]] > 1:
                gone[k:k + size] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:len(b)]).sum())
        out.append((i, kept, len(b), int(gone.sum()), spans))
    return sorted(out, key=repr)


def test_repeated_windows(spark, small, nothing):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgäß") for _ in range(rng.randint(2, 8))) for _ in range(n))
    shared, other = words(120), words(90)
    rows = [(1, words(50) + shared + words(40), "s"), (2, shared, "s"), (3, words(10) + shared[:450] + words(30), "s"),
            (4, "z" * 1000, "s"), (5, other + words(5) + other, "s"), (6, words(300), "s"), (6, words(300), "s"),
            (7, None, "s"), (8, "", "s"), (9, "y" * 400, "s"), (10, "q" * 401, "s"), (None, shared[100:], "s"),
            (11, words(30) + shared[3:] + words(3), "s"), (12, "ab" * 400, "s"), (13, "ab" * 300 + "c", "s")]
    for docs in (frame(spark, rows), small.where("doc_id < 60")):
        got = sorted((tuple(r) for r in suffix_dedup.drop_repeats(docs).collect()), key=repr)
        got = [(i, bytes(k), *rest) for i, k, *rest in got]
        assert sorted(got, key=repr) == repeats_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert suffix_dedup.drop_repeats(nothing).count() == 0


def test_windows_of_pieces(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (399, 400, 401, 700, 1099, 1100, 5000)]
    runs = suffix_dedup.runs_of(texts)
    covered = sorted((int(k), int(s) + j) for k, s, n in zip(runs["text"], runs["start"], runs["n"]) for j in range(n))
    assert covered == [(k, j) for k, t in enumerate(texts) for j in range(len(t) - 399)]


# ------------------------------------------------------------------ 10 decontamination
def overlaps_brute(text, item, window=13, tolerance=6):
    d, b = np.array(decontamination.words_of(text), object), np.array(decontamination.words_of(item), object)
    size = min(window, len(b))
    if not size or len(d) < size:
        return False
    same = d[:, None] == b[None, :]
    agree = sum(same[k:len(d) - size + k + 1, k:len(b) - size + k + 1].astype(int) for k in range(size))
    return bool((agree >= size - (size - 1) // tolerance).any())


def test_masks_are_lossless():
    for size in range(5, decontamination.WINDOW + 1):
        assert decontamination.covers(decontamination.MASKS, size, (size - 1) // decontamination.TOLERANCE), size


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 600])
def test_contamination(spark, hard, nothing, block_bytes):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"  # noqa: E731  few words, so that near misses occur
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 13, 14, 9, 7, 5, 3, 1, 40, 25])]
    items += [(20, None), (21, ""), (22, "w1 , w2"), (None, " ".join(f"n{k}" for k in range(20)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, None, "s"), (2, "", "s")]
    for k in range(60):
        text = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            part = decontamination.words_of(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(part) - 14))
            part = [w.decode() for w in part[a:a + rng.randint(10, 20)]]
            for _ in range(rng.randint(0, 4)):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(["changed", "Other"])
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in part]
        rows.append((100 + k, " ".join(text), "s"))
    docs = frame(spark, rows)
    spans = decontamination.overlaps(docs, benchmark, block_bytes=block_bytes)
    got = {r.doc_id: sorted({s.item_id for s in r.spans}) for r in docs.select("doc_id", spans.alias("spans")).collect()}
    want = {i: sorted({-1 if k is None else k for k, b in items if overlaps_brute(t, b)}) for i, t, _ in rows}
    assert got == want
    assert any(want.values()) and not all(want.values())
    left = decontamination.decontaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, w in want.items() if not w)
    assert decontamination.contamination(hard, benchmark).count() == len(hard_rows())
    assert decontamination.contamination(nothing, benchmark).count() == 0
    assert decontamination.contamination(docs, benchmark.where("false")).where("contaminated").count() == 0


# ------------------------------------------------------------------ names and ids
def test_stages_with_columns_named_like_their_helpers(spark, hard):
    names = ["_keep_id", "_keep_text", "_text", "_clash", "_row", "_kept", "count", "_KEPT2", "mix_shard"]
    odd = hard.select("*", *[F.lit(n).alias(n) for n in names])
    for stage in (exact_dedup.surviving, minhash.one_of_each_group):
        plain, got = stage(hard), stage(odd)
        assert got.columns == odd.columns
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in plain.collect())
        assert got.where("_row <> '_row' OR _kept <> '_kept'").count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_near_duplicates_of_an_id_with_different_texts(spark, partitions):
    """Each row of an id keeps its own links."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    docs = frame(spark, [(1, a, "s"), (1, b, "s"), (2, a + " more", "s"), (3, b + " more", "s"), (4, "alone here", "s"), (4, "", "s")], partitions)
    out = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert out == Counter([(1, 76, 1, True), (1, 76, 1, True), (2, 77, 1, False), (3, 77, 1, False), (4, 1, 4, True), (4, 0, 4, True)])


def test_near_duplicates_with_text_ids(spark):
    a = " ".join(f"a{i}" for i in range(80))
    docs = spark.createDataFrame([("x", a), ("w", a + " more"), ("y", "other"), (None, a)], "doc_id string, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got["x"] == ("w", False) and got["w"] == ("w", True) and got["y"] == ("y", True)


def test_commonest_word_counts_in_texts_of_many_words():
    text = " ".join([f"w{i}" for i in range(10)] + ["again"] * 300)
    at = quality.FEATURES.index("top_word")
    assert abs(quality.statistics(text)[at] - 300 / 310) < 1e-9


def test_quality_of_a_labelled_id_on_several_rows(spark, small):
    """The fit takes one row of an id, always the same one."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    twice = small.unionByName(small.withColumn("text", F.concat("text", F.lit(" | | |"))))
    runs = [sorted((r.doc_id, round(r.score, 9)) for r in quality.classify_quality(d, labels).collect())
            for d in (twice.repartition(2), twice.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == 2 * small.count()
