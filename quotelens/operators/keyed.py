"""Per-key building blocks that stay correct and balanced when one key is hot.

Rules followed here:

* a group is never gathered whole into one task: statistics are computed by
  aggregation (partial, map-side combine) and attached back by a join;
* in that join, keys with ``hot_rows`` rows or more are spread over ``salts``
  shuffle partitions and their statistic row is replicated once per salt; all
  other keys have salt 0, so there is one plan at every size.  At most
  (rows / hot_rows) keys can be hot, which bounds the broadcast set of them;
* a lookup table of one row per key is written, counted and broadcast if it is
  small, so the big side isn't shuffled for it;
* ranks within a key come from a distributed prefix sum, never from a window
  over the whole key;
* "first row per key" uses ``row_number() = 1``, which Spark plans as a partial
  ``WindowGroupLimit`` before the shuffle, so a hot key sends at most one row per
  map partition.

Keys compare null-safely: rows with a missing key form a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

HOT_KEY_ROWS = 2_000_000     # rows per key from which the key is salted
SALTS = 64                   # partitions a hot key is spread over
BROADCAST_ROWS = 500_000     # rows (of a few numbers each) up to which a lookup table is broadcast


def settings(spark, hot_rows: int | None = None, salts: int | None = None) -> tuple[int, int]:
    """Explicit arguments, else the session settings quotelens.hotKeyRows /
    quotelens.salts, else the module defaults."""
    def pick(given, key, default):
        return int(given) if given is not None else int(spark.conf.get(key, None) or default)
    return pick(hot_rows, "quotelens.hotKeyRows", HOT_KEY_ROWS), pick(salts, "quotelens.salts", SALTS)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key by ``order`` (T5: not an arbitrary row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the key columns of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def with_key_stats(df: DataFrame, keys: Sequence[str], *aggs: Column, count_col: str = "_n",
                   keep_count: bool = False, hot_rows: int | None = None, salts: int | None = None) -> DataFrame:
    """Attach per-key aggregates (plus a row count) to every row, hot keys salted.

    The salt is a hash of the row, so a retried task reproduces the routing.
    """
    keys = list(keys)
    hot_rows, salts = settings(df.sparkSession, hot_rows, salts)
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col), *aggs)
    is_hot = F.col(count_col) >= hot_rows
    hot = stats.where(is_hot).select(*keys, F.lit(True).alias("_hot"))   # at most rows / hot_rows keys
    salted = (null_safe_join(df, F.broadcast(hot), keys)
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*df.columns), F.lit(salts))).otherwise(F.lit(0)))
              .drop("_hot"))
    each = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    out = null_safe_join(salted, stats.withColumn("_salt", F.explode(each)), [*keys, "_salt"]).drop("_salt")
    return out if keep_count else out.drop(count_col)


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], most_rows: int = BROADCAST_ROWS,
                written: bool = False) -> DataFrame:
    """Left-join a one-row-per-key table onto a big table.

    ``small`` is written once (unless it is ``written``) and counted; up to
    ``most_rows`` it is broadcast and the big side stays where it is.  Beyond,
    both sides are shuffled and AQE splits skewed partitions.
    """
    table = small if written else materialize(small, "lookup")
    return null_safe_join(big, F.broadcast(table) if table.count() <= most_rows else table, keys)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], amount: str,
                   name: str = "ranked") -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the rows of the same key that come earlier in ``order``.

    A distributed prefix sum: rows are range-partitioned by key and order and
    written once with their slice; the totals of the slices, one row per key and
    slice, give each slice's start.  No task holds more than a slice of a key.
    """
    ranged = materialize(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), name)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_t"))
              .withColumn("_start", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t"))
    inner = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    out = null_safe_join(inside, starts, [*keys, "_slice"])   # starts: a row per key and slice, broadcast by its size
    return out.withColumn("before", F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_slice")


MEDIAN_BUCKETS = 500         # buckets per factor e of a value's size, from which the medians start


def _bucket(v: Column) -> Column:
    """A whole number that never falls as the value grows: the value's size on a logarithmic scale, NaN last."""
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(800.0)) * MEDIAN_BUCKETS) + 800 * MEDIAN_BUCKETS
    return (F.when(v.isNull(), F.lit(None).cast("long")).when(F.isnan(v), F.lit(2000 * MEDIAN_BUCKETS))
            .when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size))


def exact_medians(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Exact interpolated medians per key (T7), NULLs skipped; one row per key.

    ``values`` maps output alias -> input column.  Two passes over ``df``:

    1. one aggregation counts, per key and measure, the values in buckets of 0.2 % of
       their size; running totals over the buckets tell which one or two hold the middle ranks;
    2. the values in these are counted per value; a distributed prefix sum of the counts
       finds the two middle ranks, and the median interpolates between them as ``percentile`` does.

    Values closer together than a bucket only make the second count longer.
    """
    by = list(keys) or ["_all"]
    src = df.select(*keys, *[F.col(c).cast("double").alias(f"_v_{i}") for i, c in enumerate(values.values())])
    if not keys:
        src = src.withColumn("_all", F.lit(1))
    each = range(len(values))
    listed = src.select(*by, F.posexplode(F.array(*[F.col(f"_v_{i}") for i in each])).alias("m", "v"))
    buckets = materialize(listed.groupBy(*by, "m", _bucket(F.col("v")).alias("b")).agg(
        F.count("v").alias("f"), F.min("v").alias("least"), F.max("v").alias("most")), "buckets")
    measure = Window.partitionBy(*by, "m")
    upto = F.sum("f").over(measure.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    ranks = buckets.where("b IS NOT NULL").withColumns({"upto": upto, "n": F.sum("f").over(measure)})
    pos = (F.col("n") - 1) * 0.5
    p, f, c = pos, F.floor(pos), F.ceil(pos)
    holds = lambda rank: (rank >= F.col("upto") - F.col("f")) & (rank < F.col("upto"))
    around = materialize(ranks.where(holds(f) | holds(c)).groupBy(*by, "m").agg(
        F.min("least").alias("lo"), F.max("most").alias("hi"), F.min(F.col("upto") - F.col("f")).alias("below"),
        F.max("n").alias("n")), "enclosures")
    bounds = around.groupBy(*by).agg(*[F.max(F.when(F.col("m") == i, F.col(x))).alias(f"_{x}_{i}") for i in each for x in ("lo", "hi")])
    placed = lookup_join(src, bounds, by)
    inside = [F.when(F.col(f"_v_{i}").between(F.col(f"_lo_{i}"), F.col(f"_hi_{i}")), F.col(f"_v_{i}")) for i in each]
    counts = (placed.select(*by, F.posexplode(F.array(*inside)).alias("m", "v")).where("v IS NOT NULL")
              .groupBy(*by, "m", "v").agg(F.count(F.lit(1)).alias("f")))
    ranked = running_totals(counts, [*by, "m"], ["v"], "f", "medians")
    met = null_safe_join(ranked, around.select(*by, "m", "n", "below"), [*by, "m"], "inner")
    first = F.col("below") + F.col("before")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < first + F.col("f")), F.col("v")))

    two = met.groupBy(*by, "m").agg(at(f).alias("lo"), at(c).alias("hi"), F.max("n").alias("n"))
    missed = F.raise_error(F.lit("a median lies outside its buckets")).cast("double")
    middle = (F.when(F.col("lo").isNull() | F.col("hi").isNull(), missed)
              .when(f == c, F.col("lo")).otherwise((c - p) * F.col("lo") + (p - f) * F.col("hi")))
    found = two.select(*by, "m", middle.alias("med")).groupBy(*by).agg(
        *[F.max(F.when(F.col("m") == i, F.col("med"))).alias(a) for i, a in enumerate(values)])
    # every key has a row; measures without values stay NULL
    return null_safe_join(buckets.select(*by).distinct(), found, by).select(*keys, *values)


def weighted_medians(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Exact interpolated medians per key of values that count ``weight`` times each, NULLs skipped.

    Weights per value are summed and a distributed prefix sum finds the two middle
    ranks; one row per key, NULL without values.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.sum(weight).alias("f"))
    ranked = running_totals(present, keys, ["v"], "f", "weighted")
    sizes = df.groupBy(*keys).agg(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).alias("n"))
    met = null_safe_join(ranked, sizes, keys)
    pos = (F.col("n") - 1) * 0.5

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("before")) & (rank < F.col("before") + F.col("f")), F.col("v")))

    two = met.groupBy(*keys).agg(at(F.floor(pos)).alias("lo"), at(F.ceil(pos)).alias("hi"))
    return null_safe_join(sizes.select(*keys), two, keys).select(*keys, ((F.col("lo") + F.col("hi")) * 0.5).alias(out))
