"""Operator 4: near-duplicate groups by SuperMinHash.

Words are lower-cased (A-Z); a document's set holds the 64-bit hashes of its
distinct five-word shingles.  SuperMinHash gives each element a random value
in every rank of one random permutation of the signature's places, so places
are correlated and vary less than independent minima; the walk over the ranks
stops as soon as no later rank can lower any place.

1. Documents with the same set (same size and set hash) are one class, a node of
   its own number, and only classes are compared, never copies.
2. Signatures are banded: BANDS bands of ROWS places.  A pair with a Jaccard
   similarity of 0.75 shares no band with probability (1-0.75^4)^28 < 3e-5.
3. Verification on whole sets, in rounds.  In a round every member of a bucket
   is compared with the leader of its bucket (MORE_LEADERS times as many in
   each further round); then components are formed, and the next leaders follow in buckets
   that still hold more than one component.  Pairs whose sizes or parity
   sketches rule a link out, or that are already connected, aren't compared.
   When no bucket is left, every other candidate pair has been verified or is
   connected by verified links.
   A parity sketch holds for each of PARITY places whether the set has an odd
   number of elements there.  Every element that only one of two sets has flips
   one place, so the places that differ are never more than those elements: a
   bound, not an estimate, and no link is lost by it.
4. Components by union-find and star contraction (components.py).

Defined cases: NULL or empty texts have an empty set and are linked with
nothing; fewer than five words give one shingle; repeated rows share a class;
an id on rows with different texts belongs to the class of each of them, every
row with its own links; ids may be numbers or texts; among rows with a NULL id,
no links are reported (component NULL).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, staged, unused
from .components import components

SHINGLE = 5
BANDS, ROWS = 28, 4
LIKENESS = 75  # percent
#: A bucket has one leader in the first round and this many times more in each further one.
MORE_LEADERS = 16
#: Places of a parity sketch, a multiple of 64.
PARITY = 512
REMEMBERED = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

_KNOWN: dict[bytes, int] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.clear()
    hashes = []
    for w in words:
        h = _KNOWN.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w.lower())
            if len(w) <= 64:
                _KNOWN[w] = h
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        out = mixed(out + h[k:k + n] * _ODD[k])
    return np.unique(out)


def super_minhash(elements: np.ndarray, places: int) -> np.ndarray:
    """The signature of a non-empty set: per place the least rank + fraction over all elements."""
    sig = np.full(places, np.inf)
    for at in range(0, len(elements), 4096):
        seeds = elements[at:at + 4096]
        n = len(seeds)
        order = np.broadcast_to(np.arange(places, dtype=np.int16), (n, places)).copy()
        rows = np.arange(n)
        for rank in range(places):
            if rank > sig.max():
                break  # no place can still get a smaller value
            draw = mixed(seeds + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
            fraction = (draw >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            pick = rank + (mixed(draw) % np.uint64(places - rank)).astype(np.int64)
            place = order[rows, pick]
            order[rows, pick] = order[:, rank]
            np.minimum.at(sig, place, rank + fraction)
    return sig


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """PARITY bits in 64-bit words: whether an odd number of elements falls into each place."""
    odd = np.bincount((elements % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(elements: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = super_minhash(elements, bands * rows).view(np.uint64).reshape(bands, rows)
    out = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        out = mixed(out + sig[:, r])
    return out.view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, n, set_hash, keys, sketch): the keys hold one value per band, empty for an empty set (as its sketch)."""

    def sign(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": cols["id"], "n": [], "set_hash": [], "keys": [], "sketch": []}
        for t in cols["text"]:
            s = shingle_set(t)
            out["n"].append(len(s))
            out["set_hash"].append(xxhash.xxh3_128_digest(s.tobytes()))
            out["keys"].append(band_keys(s, bands, rows) if len(s) else [])
            out["sketch"].append(parity_sketch(s) if len(s) else [])
        return out

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, sign, f"id {kind}, n long, set_hash binary, keys array<long>, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, size, members): the whole sets of the wanted classes (rep, set_hash, id of one of its rows).

    Of an id's rows those count whose set is the class's."""

    def collect(cols: dict[str, list]) -> dict[str, list]:
        found = [shingle_set(t) for t in cols["text"]]
        return {"id": cols["id"], "size": [len(x) for x in found], "members": [x.view(np.int64) for x in found],
                "set_hash": [xxhash.xxh3_128_digest(x.tobytes()) for x in found]}

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    mine = narrow.join(wanted.select("id").distinct(), "id", "left_semi")
    found = map_batches(mine, collect, f"id {kind}, size long, set_hash binary, members array<long>")
    return found.join(wanted, ["id", "set_hash"]).select("rep", "size", "members")


def _verified(pairs: DataFrame, sets: DataFrame, likeness: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough, as links (u, v)."""
    one = sets.select(F.col("rep").alias("a"), F.col("size").alias("na"), F.col("members").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("size").alias("nb"), F.col("members").alias("sb"))
    same = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(one, "a").join(two, "b")
            .where(same * 100 >= (F.col("na") + F.col("nb") - same) * likeness)
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


def _candidates(live: DataFrame, leaders: int, likeness: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of this round, buckets without this round's leaders) from rows (band, key, rep, n, sketch, c)."""
    order = Window.partitionBy("band", "key").orderBy("rep")
    lead = (live.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders)
            .select("band", "key", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("asketch"),
                    F.col("c").alias("ac")))
    # at least so many elements are in one of the two sets only
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("asketch")[i])) for i in range(PARITY // 64)), F.lit(0))
    pairs = (live.join(lead, ["band", "key"]).where("a < rep AND c <> ac")
             .where(F.least("n", "an") * 100 >= F.greatest("n", "an") * likeness)
             .where(apart * (100 + likeness) <= (F.col("n") + F.col("an")) * (100 - likeness))
             .select("a", F.col("rep").alias("b")).distinct())
    rest = live.join(lead.select("band", "key", F.col("a").alias("rep")), ["band", "key", "rep"], "left_anti")
    return pairs, rest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: int = LIKENESS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    signed = staged(_signed(docs, id_col, text_col, bands, rows), "signatures")
    # a class is a set; its number is a node of the link graph, whatever ids its rows have
    classes = staged(signed.where("n > 0 AND id IS NOT NULL").groupBy("set_hash", "n")
                     .agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
                     .withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("rep", "n", "sketch", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    live = staged(buckets.join(shared.select("band", "key"), ["band", "key"], "left_semi").withColumn("c", F.col("rep")), "buckets")
    label = None
    if not live.isEmpty():
        # only classes that share a bucket with another are ever compared
        wanted = classes.select("rep", "set_hash", "id").join(live.select("rep").distinct(), "rep", "left_semi")
        sets = _sets(docs, wanted, id_col, text_col)
        repeated = signed.groupBy("id").count().where("count > 1")
        sets = staged(sets if repeated.isEmpty() else sets.dropDuplicates(["rep"]), "sets")  # equal rows of an id
        links, compared, leaders = None, None, 1
        while not live.isEmpty():
            pairs, rest = _candidates(live, leaders, likeness)
            if compared is not None:
                pairs = pairs.join(compared, ["a", "b"], "left_anti")
            pairs = staged(pairs, "pairs")
            held = staged(_verified(pairs, sets, likeness), "links")
            if label is None or not held.isEmpty():
                links = held if links is None else links.unionByName(held)
                label = staged(components(links), "components")
            compared = pairs if compared is None else compared.unionByName(pairs)
            named = (rest.drop("c").join(label.withColumnRenamed("node", "rep"), "rep", "left")
                     .withColumn("c", F.coalesce("component", "rep")).drop("component"))
            # a bucket goes on while its members belong to more than one component
            several = (named.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
                       .where("lo <> hi").select("band", "key"))
            live = staged(named.join(several, ["band", "key"], "left_semi"), "buckets")
            leaders *= MORE_LEADERS
    reps = classes.select("set_hash", "n", "id", F.col("rep").alias("component"))
    if label is not None:
        reps = (reps.withColumnRenamed("component", "node").join(label, "node", "left")
                .select("set_hash", "n", "id", F.coalesce("component", "node").alias("component")))
    least = reps.groupBy("component").agg(F.min("id").alias("component_id"))
    reps = reps.join(least, "component").select("set_hash", "n", "component_id")
    narrow = signed.drop("keys", "sketch")
    # empty sets are linked with nothing: they stay out of the join
    out = (narrow.where("n > 0").join(reps, ["set_hash", "n"], "left").select("id", "n", "component_id")
           .unionByName(narrow.where("n = 0").select("id", "n", F.col("id").alias("component_id"))))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      (F.col("id") == F.col("component_id")).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, columns as they were: the smallest id of each group.

    Of an id on several rows, all stay if one of them stays."""
    kept_id = unused("_kept", docs)
    kept = near_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(kept_id)).distinct()
    unlinked = F.col(id_col).isNull()
    return docs.where(~unlinked).join(kept, F.col(id_col) == F.col(kept_id), "left_semi").unionByName(docs.where(unlinked))
