"""Operator 3: exact deduplication by content-defined chunk recipes.

Texts are equal when they agree after every white-space character is deleted.
The normalised text is cut where its content says so (a boundary pair of
characters after a least length, a forced cut at a greatest length), so equal
texts have equal cuts.  A chunk's identifier is a 64-bit hash; before it is
trusted, every chunk with an identifier that occurs more than once is compared
with the others of that identifier.  Documents are then equal exactly when
their ordered identifier lists (recipes) are equal: only recipes are grouped
and joined, and a chunk's text moves once, already deduplicated in its task.

DataFrame functions only.  Defined cases: NULL text counts as empty; all empty
texts form one group; of equal texts the row with the most code points, then
the smallest id stays (a NULL id is the smallest); repeated rows with the id
that stays are all marked kept, and ``surviving`` leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, staged, unused

LEAST_CHUNK, MOST_CHUNK = 256, 4096
# A cut may follow these pairs: about one pair in sixty of ordinary prose.
BOUNDARY = "[aeimquy048EIMQUY,;|][bdfhjlnprtvxz13579]"
CHUNKS = f"(?s).{{{LEAST_CHUNK},{MOST_CHUNK}}}?{BOUNDARY}|.{{1,{MOST_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def chunks_of(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNKS), F.lit(0))


def identifier(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.shiftright(h, 64 - bits)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One narrow row per document: id, code points, digest, recipe."""
    norm = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_cp"),
                       normalised(F.col(text_col)).alias("norm"))
    return norm.select("id", "n_cp", F.sha2("norm", 256).alias("text_sha256"),
                       F.transform(chunks_of(F.col("norm")), lambda c: identifier(c, bits)).alias("recipe"))


def colliding_identifiers(docs: DataFrame, recipe: DataFrame, text_col: str = "text", bits: int = 64) -> DataFrame:
    """Identifiers of two or more different chunks, found by comparing the chunks themselves."""
    ids = recipe.select(F.explode("recipe").alias("chunk_id"))
    repeated = ids.groupBy("chunk_id").count().where("count > 1").select("chunk_id")
    chunk = docs.select(F.explode(chunks_of(normalised(F.col(text_col)))).alias("chunk"))
    distinct = chunk.select(identifier(F.col("chunk"), bits).alias("chunk_id"), "chunk").distinct()
    held = distinct.groupBy("chunk_id").count().where("count > 1").select("chunk_id")
    return held.join(repeated, "chunk_id", "left_semi")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.

    ``bits`` shortens the identifiers (tests of the collision path only).
    """
    recipe = staged(recipes(docs, id_col, text_col, bits), "recipes")
    bad = staged(colliding_identifiers(docs, recipe, text_col, bits), "chunk-collisions")
    spoilt = F.lit("")
    if not bad.isEmpty():
        # rare: a recipe that holds such an identifier is told apart by the digest of its whole text
        hit = (recipe.select("text_sha256", F.explode(F.array_distinct("recipe")).alias("chunk_id"))
               .join(bad, "chunk_id", "left_semi").select("text_sha256").distinct())
        recipe = recipe.join(hit.withColumn("spoilt", F.col("text_sha256")), "text_sha256", "left")
        spoilt = F.coalesce("spoilt", F.lit(""))
    keyed = recipe.withColumn("spoilt", spoilt)
    best = (keyed.groupBy("recipe", "spoilt")
            .agg(F.max(F.struct("n_cp", F.negative(F.coalesce("id", F.lit(-2**63 + 1))).alias("back"), "id")).alias("best"),
                 F.count(F.lit(1)).alias("group_size"))
            .select("recipe", "spoilt", F.col("best.id").alias("keep_id"), F.col("best.n_cp").alias("best_cp"), "group_size"))
    out = keyed.join(best, ["recipe", "spoilt"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size",
                      (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("best_cp"))).alias("kept"),
                      "text_sha256")


def surviving(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, columns as they were."""
    keep_id, keep_text, own_text, clashing, row = (unused(n, docs) for n in ("_keep_id", "_keep_text", "_text", "_clash", "_row"))
    marked = exact_duplicates(docs, id_col, text_col).where("kept")
    keep = marked.select(F.col(id_col).alias(keep_id), F.col("text_sha256").alias(keep_text)).distinct()
    text = F.sha2(normalised(F.col(text_col)), 256)
    found = docs.withColumn(own_text, text).join(
        keep, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(own_text) == F.col(keep_text)), "left_semi")
    clash = docs.groupBy(F.col(id_col).alias(clashing)).count().where("count > 1").select(clashing)
    once = found.join(clash, F.col(id_col).eqNullSafe(F.col(clashing)), "left_anti")
    again = found.join(clash, F.col(id_col).eqNullSafe(F.col(clashing)), "left_semi")
    if again.isEmpty():
        return found.drop(own_text)
    longest = again.groupBy(F.col(id_col).alias(keep_id), own_text).agg(
        F.max_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(F.length(text_col), F.col(text_col))).alias(row))
    return once.drop(own_text).unionByName(longest.select(f"{row}.*"))
