"""Cleaning, filters and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gmr_band, gmr_band_ord, is_win
from ..session import is_grouped
from .keyed import first_per_key, with_key_stats


def filter_positive_qty(df: DataFrame) -> DataFrame:
    """Quantity <= 0 (or missing) is a system error."""
    return df.where(F.col("qty") > 0)


def filter_highest_price(df: DataFrame) -> DataFrame:
    """Keep the highest-price record, only when the flag column exists."""
    if "is_highest_price" in df.columns:
        return df.where(F.col("is_highest_price") == 1)
    return df


def mark_highest_price(df: DataFrame, out: str = "is_highest_price_calc", **kw) -> DataFrame:
    """1 where unit_price is the maximum of its (quote, product); ties all flagged.

    The per-key maximum is aggregated (map-side combine) and joined back with
    hot-key salting, so a huge quote never lands in a single task.
    """
    marked = with_key_stats(df, ["quote_id", "product"], F.max("unit_price").alias("_max_up"), **kw)
    return (marked.withColumn(out, F.when(F.col("unit_price") == F.col("_max_up"), F.lit(1))
                              .otherwise(F.lit(0)))
            .drop("_max_up"))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """C4: exact whole-row duplicate removal.

    ``line_seq`` stands for the place in the file and isn't part of the row:
    of equal rows the first one stays.
    """
    business = [c for c in df.columns if c != "line_seq"]
    return df.groupBy(*business).agg(F.min("line_seq").alias("line_seq")).select(*df.columns)


def derive_columns(df: DataFrame) -> DataFrame:
    """Row-local derived columns."""
    return (df
            .withColumn("is_win", is_win("convert_to_order"))
            .withColumn("gmr_pct", F.col("gross_margin_rate") * 100)
            .withColumn("band_ord", gmr_band_ord("gross_margin_rate"))
            .withColumn("gmr_band", gmr_band("gross_margin_rate"))
            .withColumn("estimated_cost_per_unit", F.try_divide(F.col("estimated_cost"), F.col("qty"))))


def flag_multi_product(df: DataFrame, **kw) -> DataFrame:
    """A quote holds more than one distinct (non-null) product."""
    if is_grouped(df, "quote_id"):   # a quote's lines already lie together
        w = Window.partitionBy("quote_id")
        several = F.min("product").over(w) != F.max("product").over(w)
        return df.withColumn("multi_product_quote", F.coalesce(several, F.lit(False)))
    out = with_key_stats(df, ["quote_id"], F.min("product").alias("_lo"), F.max("product").alias("_hi"), **kw)
    return (out.withColumn("multi_product_quote", F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)))
            .drop("_lo", "_hi"))


def clean_quotes(raw: DataFrame, with_multi_product: bool = False) -> DataFrame:
    """The reference's load-time cleaning: filters, distinct, derived columns.

    One shuffle (the distinct).  The multi-product flag is never read by any
    report, so it is added only on request (it costs a keyed join).
    """
    out = derive_columns(dedupe_rows(filter_highest_price(filter_positive_qty(raw))))
    return flag_multi_product(out) if with_multi_product else out


def quote_header(df: DataFrame) -> DataFrame:
    """First line of each quote, in line order."""
    return first_per_key(df, ["quote_id"], ["line_seq"])


def quote_product_header(df: DataFrame) -> DataFrame:
    """C11: first line of each (quote, product)."""
    return first_per_key(df, ["quote_id", "product"], ["line_seq"])


def filter_lost_lines(df: DataFrame) -> DataFrame:
    """Lost lines only."""
    return df.where(F.col("is_win") == 0)


def filter_with_benchmark(df: DataFrame) -> DataFrame:
    """Lines with a minimum competitor price."""
    return df.where(F.col("min_competitor_price").isNotNull())


def select_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Projection to the model features (with the quote, the label and any weight they are fitted with)."""
    return df.select(*features)


def product_list(df: DataFrame) -> DataFrame:
    """C14: distinct products as text (a missing product reads 'nan')."""
    return (df.select(F.coalesce(F.col("product").cast("string"), F.lit("nan")).alias("product"))
            .distinct().orderBy("product"))
