"""Test-input adapters over the driver's TPC-H-style tables.

``quotes`` is a quotation-line table derived from ``lineitem JOIN part``
(definitions in FIXTURES.md section 1); ``requests`` is one pricing scenario per
clean quote line (FIXTURES.md section 2).  Both read the whole tables.

``line_seq`` stands in for file order, which a real quotation file carries
(see ``readers.conform``); deriving it needs a row_number per order key, and
the highest-price flag of the fixture is computed in the same window exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import partitions_for
from .readers import QUOTE_COLUMNS, conform


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(base: DataFrame) -> DataFrame:
    """FIXTURES.md section 1 columns from (quote_id, line_seq, lineitem and part fields)."""
    qint = F.col("l_quantity").cast("int")
    m = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29 + qint) % 81 - 10
    h = (F.col("l_orderkey") * 37 + F.col("l_suppkey") * 11) % 100
    k = F.col("l_partkey") + F.col("l_suppkey")
    b = base.select(
        "quote_id", "line_seq",
        F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("H")).alias("product"),
        F.when(F.col("p_partkey") % 53 != 0, F.col("p_size") / 2).alias("kw"),
        F.when((F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1), F.lit(0))
        .otherwise(qint).alias("qty"),
        m.alias("_m"), h.alias("_h"), k.alias("_k"), F.col("p_retailprice").alias("_cpu"),
        "l_partkey", "l_suppkey", "p_size", "p_retailprice",
    )
    comp_a = F.when(F.col("_k") % 3 != 0, F.col("p_retailprice") * (
        1 + ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % 61) / 100))
    comp_b = F.when(F.col("_k") % 2 != 0, F.col("p_retailprice") * (
        1 + ((F.col("l_partkey") * 5 + F.col("l_suppkey")) % 71) / 100))
    comp_c = (F.when(F.col("_k") % 5 != 0, F.lit(None).cast("double"))
              .when(F.col("l_suppkey") % 4 == 0, F.lit(0.0))
              .otherwise(F.col("p_retailprice") * (1 + (F.col("l_partkey") % 81) / 100)))
    d1 = b.select(
        "quote_id", "line_seq", "product", "kw", "qty", "_m", "_h", "_cpu",
        (F.col("_m") / 100).alias("gross_margin_rate"),
        (F.col("_cpu") / (1 - F.col("_m") / 100)).alias("unit_price"),
        (F.col("p_size") * 10).cast("double").alias("energy_grant_amount"),
        (F.col("_cpu") * F.col("qty")).alias("estimated_cost"),
        comp_a.alias("competitor_a"), comp_b.alias("competitor_b"), comp_c.alias("competitor_c"),
    )
    a, bb, c = (F.nullif(F.col(x), F.lit(0.0)) for x in ("competitor_a", "competitor_b", "competitor_c"))
    cnt = a.isNotNull().cast("int") + bb.isNotNull().cast("int") + c.isNotNull().cast("int")
    avg = (F.coalesce(a, F.lit(0.0)) + F.coalesce(bb, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))) / F.nullif(cnt, F.lit(0))
    d2 = d1.select(
        "*",
        (F.col("energy_grant_amount") / F.nullif(F.col("unit_price") * F.col("qty"), F.lit(0.0)))
        .alias("grant_ratio_to_subtotal"),
        cnt.alias("competitor_count_available"),
        avg.alias("avg_competitor_price"),
        F.least(a, bb, c).alias("min_competitor_price"),
        (F.col("unit_price") * F.col("qty") - F.col("_cpu") * F.col("qty")).alias("estimated_gross_profit"),
        F.when(F.col("_h") < 70 - F.col("_m"), F.lit(0)).otherwise(F.lit(1)).alias("convert_to_order"),
    ).select(
        "*",
        ((F.col("unit_price") - F.col("avg_competitor_price")) / F.col("avg_competitor_price") * 100)
        .alias("price_gap_avg_competitor_pct"),
        ((F.col("unit_price") - F.col("min_competitor_price")) / F.col("min_competitor_price") * 100)
        .alias("price_gap_min_competitor_pct"),
    )
    return d2.drop("_m", "_h", "_cpu")


SEQ_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def lines_partitions(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions the lines are dealt to, by their number (parquet footers tell it)."""
    return partitions_for(spark, _table(spark, sf_dir, "lineitem").count())


def most_lines_of_a_quote(spark: SparkSession, sf_dir: str) -> int:
    """A number of lines that no quote exceeds, from the two tables apart (no join of them): the most lines of
    an order, times the most rows of a part, times the copies ``quotes_from_tpch`` makes."""
    def most(name: str, key: str) -> int:
        sizes = _table(spark, sf_dir, name).groupBy(key).count()
        return sizes.agg(F.max("count")).first()[0] or 0
    return 2 * most("lineitem", "l_orderkey") * most("part", "p_partkey")


def quotes_from_tpch(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """The ``quotes`` view; the line number, the highest-price flag and (later)
    the deduplication share one exchange on quote_id, to ``partitions`` if given."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    pa = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    j = li.join(pa, li.l_partkey == pa.p_partkey, "inner").withColumn("quote_id", F.col("l_orderkey"))
    if partitions:
        j = j.repartition(partitions, "quote_id")
    seq_w = Window.partitionBy("quote_id").orderBy(*SEQ_ORDER)
    lines = _derive(j.withColumn("line_seq", F.row_number().over(seq_w).cast("bigint")))
    top = F.max("unit_price").over(Window.partitionBy("quote_id", "product"))
    flagged = lines.withColumn("is_highest_price", F.when(F.col("unit_price") == top, F.lit(1)).otherwise(F.lit(0)))
    # exact duplicates of every line of quotes with quote_id % 101 = 0 (one pass, no union)
    copies = F.when(F.col("quote_id") % 101 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    doubled = flagged.withColumn("_copy", F.explode(copies)).drop("_copy")
    return conform(doubled).select(*QUOTE_COLUMNS)


def requests_from_clean(clean: DataFrame, min_margin: float = 0.20,
                        min_win_probability: float = 0.40) -> DataFrame:
    """One pricing request per clean quote line (FIXTURES.md section 2)."""
    return clean.select(
        "quote_id", "line_seq", "product", "kw", "qty",
        F.try_divide(F.col("estimated_cost"), F.col("qty")).alias("cost_per_unit"),
        "gross_margin_rate", "energy_grant_amount",
        "competitor_a", "competitor_b", "competitor_c",
        F.lit(min_margin).alias("minimum_margin"),
        F.lit(min_win_probability).alias("minimum_win_probability"),
    )


def sparse_requests(requests: DataFrame) -> DataFrame:
    """Requests with missing inputs (for prefill): quote_id % 7 = 0 loses kw, cost, grant, competitors."""
    blank = F.col("quote_id") % 7 == 0
    out = requests
    for c in ("kw", "cost_per_unit", "energy_grant_amount", "competitor_a", "competitor_b", "competitor_c"):
        out = out.withColumn(c, F.when(~blank, F.col(c)))
    return out
