"""Operator 11: ranked lexical search by NRA over impact-ordered lists.

Terms of the items are looked up in lists of (document, impact) that are only
read in order of falling impact, never by document.  Reading is in rounds:
each goes GROWTH times as deep into all lists at once.

1. One pass over the documents counts terms: per document its length and the
   items' terms with their numbers of occurrences.  Impacts follow from these
   and the corpus totals.
2. A histogram of impacts per term (IMPACT_BINS bins, exact counts) deals every
   list to levels of depth FIRST, FIRST * GROWTH, ...; a bin is never divided.
   Postings are written by level, so that a round reads one more folder.
3. After a round every (item, document) that was met has a lower bound (what
   it has been seen with) and an upper bound (that, and for the lists where
   it hasn't been seen the greatest impact not yet read).  Once the kth lower
   bound of an item exceeds what an unseen document could reach, only documents
   whose upper bound reaches it remain, and the further reads keep theirs
   alone.  An item is finished when both bounds of all that remain agree: then
   membership, ties and scores are final.

Lists of terms with weight 0 add nothing and aren't read.  Items go in blocks
of at most ITEM_TERMS different (item, term) pairs (an item stays whole), so
that what is broadcast doesn't grow with the number of items.

Defined cases: NULL and empty texts have no terms and don't count in N; an
item without a known term has no rows; rows that repeat a document id are
documents of their own, also in the result; NULL document ids come last among
equal scores; an item id on several rows asks once, with its least text; rows
with a NULL item id ask nothing; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import map_batches, staged

K = 20
FIRST, GROWTH = 256, 4
IMPACT_STEP = 1000          # width of an impact bin; impacts are below 10^6
ITEM_TERMS = 200_000        # (item, term) pairs of a block of items
BROADCAST_ROWS = 200_000    # rows of two or three numbers that are broadcast

#: Bytes of terms: letters in lower case, digits and everything beyond ASCII; all else parts them.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, q): the items' terms and how often each occurs in them."""

    def count(cols: dict[str, list]) -> dict[str, list]:
        rows = [(i, w.decode(), n) for i, t in zip(cols["item"], cols["text"]) for w, n in Counter(terms(t)).items()]
        return {"item": [r[0] for r in rows], "term": [r[1] for r in rows], "q": [r[2] for r in rows]}

    one = (items.select(items[id_col].alias("item"), items[text_col].alias("text")).where("item IS NOT NULL")
           .groupBy("item").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    return staged(map_batches(one, count, "item long, term string, q long"), "item-terms")


def counted(docs: DataFrame, id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    """(row, id, n, terms, tfs): per document its number of terms, and the wanted ones (by place) with their counts."""
    places = {w.encode(): i for i, w in enumerate(wanted)}
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def count(cols: dict[str, list]) -> dict[str, list]:
        places = shared.value
        out: dict[str, list] = {"id": cols["id"], "n": [], "terms": [], "tfs": []}
        for t in cols["text"]:
            words = terms(t)
            tf = Counter(p for w in words if (p := places.get(w)) is not None)
            out["n"].append(len(words))
            out["terms"].append(list(tf.keys()))
            out["tfs"].append(list(tf.values()))
        return out

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = map_batches(narrow, count, "id long, n long, terms array<int>, tfs array<int>", rows=500)
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "term-counts")


def postings(rows: DataFrame, documents: int, length: int) -> DataFrame:
    """(term, row, impact) of all documents that hold wanted terms."""
    m = F.lit(75) + F.expr(f"(25L * n * {documents}L) div {max(1, length)}L")
    tf = F.col("p.tfs").cast("long")
    return (rows.select("row", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
            .select(F.col("p.terms").alias("term"), "row",
                    F.expr("(1000000000L * p.tfs) div (1000L * p.tfs + 12L * m)").cast("int").alias("impact")))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= most else df


class Lists:
    """The impact-ordered lists of a block's terms: postings by level, and what is left unread after each."""

    def __init__(self, rows: DataFrame, documents: int, length: int):
        spark = rows.sparkSession
        found = postings(rows, documents, length)
        place = F.floor(F.col("impact") / IMPACT_STEP).cast("int")
        bins = found.groupBy("term", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("top"))
        down = Window.partitionBy("term").orderBy(F.desc("bin"))  # at most 10^6 / IMPACT_STEP rows a term
        before = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1))
        depth = F.log(float(GROWTH), F.coalesce(before, F.lit(0)) / FIRST)
        df = F.sum("n").over(Window.partitionBy("term"))
        weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
        bins = (bins.withColumn("level", F.greatest(F.lit(0), F.coalesce(F.floor(depth) + 1, F.lit(0))).cast("int"))
                .withColumn("df", df).withColumn("w", weight).where("w > 0"))
        self.bins = staged(bins.select("term", "bin", "top", "level", "w"), "impact-bins")
        self.levels = (self.bins.agg(F.max("level")).first()[0] or 0) + 1
        # lowest bin of each level; a posting's level is the number of levels that end above its bin
        ends = self.bins.groupBy("term").agg(*[F.min(F.when(F.col("level") <= i, F.col("bin"))).alias(f"e{i}")
                                               for i in range(self.levels - 1)], F.max("w").alias("w"))
        self.terms = staged(ends, "list-ends")
        level = sum((F.when(place < F.col(f"e{i}"), 1).otherwise(0) for i in range(self.levels - 1)), F.lit(0))
        self.path = scratch_path(spark, "llm-postings")
        (found.join(small(self.terms), "term").select("term", "row", "impact", level.alias("level"))
         .write.partitionBy("level").option("compression", "zstd").parquet(self.path))
        self.spark = spark

    def read(self, level: int) -> DataFrame:
        """All postings down to a level."""
        return (self.spark.read.schema("term int, row long, impact int, level int").parquet(self.path)
                .where(F.col("level") <= level).drop("level"))

    def unread(self, level: int) -> DataFrame:
        """(term, rest): the greatest impact not yet read, 0 at a list's end."""
        return self.bins.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("level") > level, F.col("top"))), F.lit(0)).alias("rest"))


def bounds(asked: DataFrame, lists: Lists, level: int, among: DataFrame | None) -> DataFrame:
    """(item, row, low, seen): what each document met so far has, and the unread rest of the lists that met it."""
    read = lists.read(level)
    if among is not None:
        read = read.join(small(among), "row").join(small(asked), ["item", "term"])
    else:
        read = read.join(small(asked), "term")
    return read.groupBy("item", "row").agg(F.sum(F.col("qw") * F.col("impact")).alias("low"),
                                           F.sum(F.col("qw") * F.col("rest")).alias("seen"))


def resolved(asked: DataFrame, lists: Lists, k: int) -> DataFrame:
    """(item, row, score) of every document that may be among the best k of its item, scores final."""
    results: list[DataFrame] = []
    fresh, among = asked, None       # items that any document can still enter; documents that remain of the others
    for level in range(lists.levels):
        rest = lists.unread(level)
        parts = []
        if fresh is not None:
            weighed = staged(fresh.join(F.broadcast(rest), "term"), "asked")
            parts.append(bounds(weighed, lists, level, None))
        if among is not None:
            held = staged(asked.join(among.select("item").distinct(), "item", "left_semi").join(F.broadcast(rest), "term"), "asked")
            parts.append(bounds(held, lists, level, among))
        if not parts:
            break
        met = staged(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "bounds")
        order = Window.partitionBy("item").orderBy(F.desc("low"))
        kth = (met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
               .groupBy("item").agg(F.max("place").alias("places"), F.min("low").alias("least")))
        total = (asked.join(F.broadcast(rest), "term").groupBy("item").agg(F.sum(F.col("qw") * F.col("rest")).alias("reach"))
                 .join(kth, "item").withColumn("kth", F.when(F.col("places") >= k, F.col("least")).otherwise(F.lit(0))))
        # no unseen document can enter an item whose kth lower bound is beyond its reach
        total = staged(total.select("item", "reach", "kth", ((F.col("reach") < F.col("kth")) | (F.col("reach") == 0)).alias("shut")), "items")
        held = (met.join(small(total.where("shut")), "item").withColumn("high", F.col("low") + F.col("reach") - F.col("seen"))
                .where("high >= kth").select("item", "row", "low", "high"))
        held = staged(held, "candidates")
        loose = held.where("high > low").select("item").distinct()
        results.append(held.join(F.broadcast(loose), "item", "left_anti").select("item", "row", F.col("low").alias("score")))
        among = held.join(F.broadcast(loose), "item", "left_semi").select("item", "row")
        among = None if among.isEmpty() else staged(among, "candidates")
        still = total.where("NOT shut").select("item")
        fresh = None if fresh is None or still.isEmpty() else asked.join(still, "item", "left_semi")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", item_terms_at_once: int = ITEM_TERMS) -> DataFrame:
    """(item, rank, id, score): the k best documents of every item with a score above 0."""
    spark = docs.sparkSession
    pairs = item_terms(items, item_col, item_text_col)
    blocks = max(1, -(-2 * pairs.count() // item_terms_at_once))
    path = scratch_path(spark, "llm-ranked")
    schema = f"{item_col} long, rank int, {id_col} long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for number in range(blocks):
        mine = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        wanted = [r["term"] for r in mine.select("term").distinct().orderBy("term").collect()]  # a block's terms
        if not wanted:
            continue
        rows = counted(docs, id_col, text_col, wanted)
        totals = rows.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        if not totals["documents"]:
            continue
        lists = Lists(rows, totals["documents"], totals["length"])
        names = spark.createDataFrame(list(enumerate(wanted)), "place int, term string")
        asked = staged(mine.join(F.broadcast(names), "term").select("item", F.col("place").alias("term"), "q")
                       .join(F.broadcast(lists.terms.select("term", "w")), "term")
                       .select("item", "term", (F.col("q") * F.col("w")).alias("qw")), "asked")
        best = resolved(asked, lists, k).where("score > 0")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        (best.join(rows.select("row", "id"), "row").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
         .select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
         .write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)
