"""Lexical search, top-k search and clustering against brute force, and on difficult rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quotelens.llm import clustering, lexical_search, topk_search

DOCS = "doc_id long, text string, id string, row string, n int, terms string, item string, term int"
ITEMS = "item_id long, text string, item int, term string, q int"
VECTORS = "vec_id long, embedding array<float>, id string, v int, q string, rank int, cluster string, distance int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "i", 2) for i, t in rows], DOCS).repartition(partitions)


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], ITEMS)


def vectors_frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2, "z", 3) for i, v in rows], VECTORS).repartition(partitions)


def words_of(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k=20):
    """The contract's ranking, every pair scored."""
    each = [(i, Counter(words_of(t))) for i, t in docs]
    size = [sum(c.values()) for _, c in each]
    n_docs, length = sum(x > 0 for x in size), sum(size)
    df = Counter(w for _, c in each for w in c)
    least = {}
    for i, t in items:
        if i is not None:
            least[i] = min(least.get(i, t or ""), t or "")
    out = []
    for item, text in least.items():
        scored = []
        for (d, c), n in zip(each, size):
            s = 0
            for w, q in Counter(words_of(text)).items():
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // length
                    s += q * weight * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_docs(n, seed, hot=None):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200])))) for i in range(n)]
    if hot:
        rows += [(n + i, hot) for i in range(n // 2)]
    return rows


@pytest.fixture(scope="module")
def hard_docs():
    long_text = " ".join(f"w{i % 911}" for i in range(40_000))
    rows = random_docs(150, 1, hot="w3 w5 w280 again")
    return rows + [(900, None), (901, ""), (902, " .,;\n"), (903, "W3, w3; WÄ ä b c"), (None, "w3 w9 w280"), (None, None),
                   (904, long_text), (5, "w280 w281 w282"), (5, "w280 w281 w282"), (905, "wÄ x\x85y _ 12-3")]


ITEM_ROWS = [(1, "w3 w280 w5 W3"), (2, None), (3, ""), (4, "unknown words only"), (5, "w0 w1 w2 w299 w298 w297 12 3 wÄ"), (None, "w3"),
             (6, "w10 w20"), (6, "w10 w1"), (7, "again"), (8, "w910 w900 ä b c x\x85y")]


@pytest.mark.parametrize("first,at_once", [(256, 200_000), (16, 40)])
def test_lexical_search_equals_scoring_every_pair(spark, hard_docs, monkeypatch, first, at_once):
    """Whole, with many levels, and with items dealt to several blocks."""
    monkeypatch.setattr(lexical_search, "FIRST", first)
    monkeypatch.setattr(lexical_search, "GROWTH", 2)
    out = lexical_search.search(docs_frame(spark, hard_docs), items_frame(spark, ITEM_ROWS), item_terms_at_once=at_once)
    assert found(out) == ranked(hard_docs, ITEM_ROWS)


def test_lexical_search_shuffles_beyond_the_broadcast_bound(spark, hard_docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lexical_search, "FIRST", 64)
    out = lexical_search.search(docs_frame(spark, hard_docs), items_frame(spark, ITEM_ROWS), k=3)
    assert found(out) == ranked(hard_docs, ITEM_ROWS, 3)


def test_lexical_search_stops_before_the_lists_end(spark, monkeypatch):
    """Random documents: after the items are shut, only the remaining documents are read further."""
    monkeypatch.setattr(lexical_search, "FIRST", 4)
    monkeypatch.setattr(lexical_search, "GROWTH", 2)
    read = []
    whole = lexical_search.bounds

    def noted(asked, lists, level, among):
        read.append((level, among is not None))
        return whole(asked, lists, level, among)

    monkeypatch.setattr(lexical_search, "bounds", noted)
    docs, items = random_docs(600, 4), [(1, "w200 w210 w220 w0 w1"), (2, "w150 w0")]
    assert found(lexical_search.search(docs_frame(spark, docs), items_frame(spark, items), k=5)) == ranked(docs, items, 5)
    assert max(level for level, among in read if not among) < max(level for level, _ in read)


def test_lexical_search_of_empty_tables(spark, hard_docs):
    docs, items = docs_frame(spark, hard_docs), items_frame(spark, ITEM_ROWS)
    assert found(lexical_search.search(docs.where("false"), items)) == []
    assert found(lexical_search.search(docs.where("doc_id = 900"), items)) == []
    assert found(lexical_search.search(docs, items.where("false"))) == []


def integers(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(64 * float(np.float32(x))) for x in v]


def best_products(rows, k=20):
    vectors = [(i, integers(v)) for i, v in rows if i is not None and integers(v) is not None]
    asked = {}
    for i, v in vectors:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in vectors if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def hard_vectors(n=300, hot=150, scale=1.0):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in (rng.standard_normal(64) * scale).astype(np.float32)]) for i in range(n)]
    same = rows[40][1]
    rows += [(1000 + i, same) for i in range(hot)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2001, [nan] + [0.0] * 63), (2020, [inf] + [0.0] * 63), (2002, [None] + [0.0] * 63), (2040, []),
             (2060, [0.5, -0.5]), (None, same), (3, same), (60, rows[7][1]), (60, rows[60][1]), (2080, [0.0] * 64)]
    return rows


@pytest.mark.parametrize("scale", [0.1, 30.0, 3e5])
def test_topk_search_equals_scoring_every_pair(spark, scale):
    """With copies that tie over a third of all rows; sums exact in 24, 53 and more bits."""
    rows = hard_vectors(scale=scale)
    assert sorted(map(tuple, topk_search.search(vectors_frame(spark, rows)).collect())) == best_products(rows)


def test_topk_search_in_blocks_of_queries_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "TILE", 200)
    rows = hard_vectors(120, 60)
    out = topk_search.search(vectors_frame(spark, rows, 5), block=3)
    assert sorted(map(tuple, out.collect())) == best_products(rows)


def test_topk_search_with_few_or_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])]
    assert sorted(map(tuple, topk_search.search(vectors_frame(spark, rows)).collect())) == best_products(rows)
    assert topk_search.search(vectors_frame(spark, rows).where("false")).count() == 0
    assert topk_search.search(vectors_frame(spark, rows[:1])).count() == 0


def clustered(rows, k=16, rounds=3):
    kept = [(i, integers(v)) for i, v in rows if integers(v) is not None and len(integers(v)) == 64]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in last:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), clustering.centroid_digest(centres[c])) for i, c, d in last), key=str)


def as_rows(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, clustering.centroid_digest(r.centroid))
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_clustering_equals_exact_integer_rounds(spark, partitions):
    rows = hard_vectors()
    assert as_rows(clustering.cluster_vectors(vectors_frame(spark, rows, partitions))) == clustered(rows)


def test_clustering_with_few_equal_or_no_vectors(spark):
    same = [(i, [0.25] * 64) for i in range(40)]
    assert as_rows(clustering.cluster_vectors(vectors_frame(spark, same))) == clustered(same)  # ties, empty clusters
    few = hard_vectors(70, 0)[:5]
    assert as_rows(clustering.cluster_vectors(vectors_frame(spark, few))) == clustered(few)
    none = clustering.cluster_vectors(vectors_frame(spark, few).where("false"))
    assert none.count() == 0 and "centroid" in none.columns
