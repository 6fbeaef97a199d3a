"""Historical aggregations and reports.

Every report is a partial (map-side) aggregation followed by one exchange on
its grouping key; dimension completion (8 bands, 3 positions) joins a fixed,
tiny dimension table.  No report gathers a group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    LOSS_MARGIN_FLOOR,
    PRODUCT_MIN_QUOTES,
    PRODUCT_POSITION_MIN_LINES,
    SIG_ABOVE,
    SIG_HIGH_MARGIN,
    SIG_NO_INFO,
    SIG_OTHER,
)
from ..functions.columns import band_dimension, position_dimension, price_position_by_pct
from .cleaning import quote_header, quote_product_header
from .keyed import exact_medians, lookup_join


def _share(pred):
    """Mean of a predicate with NULL counted as False."""
    return F.avg(F.coalesce(pred, F.lit(False)).cast("int"))


# ------------------------------------------------------------------ A1
def overview_kpis(clean: DataFrame) -> DataFrame:
    """A1: quotes, products, quote-level win rate, share of lines with competitor info."""
    return overview_row(quote_header(clean), clean.agg(
        F.count_distinct("product").alias("product_categories"),
        _share(F.col("competitor_count_available") > 0).alias("competitor_info_share")))


def overview_row(first_lines: DataFrame, lines: DataFrame) -> DataFrame:
    """A1's row from the first lines of the quotes and the one-row aggregate of all lines."""
    headers = first_lines.agg(
        F.count("quote_id").alias("historical_quotations"),
        F.avg("is_win").alias("historical_win_rate"))
    # two one-row aggregates side by side, folded without a cross join
    nb, nd = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    both = headers.select("historical_quotations", nb.alias("product_categories"),
                          "historical_win_rate", nd.alias("competitor_info_share")).unionByName(
        lines.select(nb.alias("historical_quotations"), "product_categories",
                     nd.alias("historical_win_rate"), "competitor_info_share"))
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# ------------------------------------------------------------------ A2 / A7 / A8 / A9
def _complete_bands(agg: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """Emit all 8 bands per key combination (T8): empty -> count 0, means NULL."""
    spark = agg.sparkSession
    dim = F.broadcast(band_dimension(spark))
    if keys:
        frame = agg.select(*keys).distinct().withColumn("band_ord", F.explode(F.sequence(F.lit(0), F.lit(7))))
        frame = frame.join(dim, "band_ord")
    else:
        frame = dim
    out = frame.join(agg.where(F.col("band_ord").isNotNull()).drop("gmr_band"), keys + ["band_ord"], "left")
    return out.withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("bigint"))


def win_rate_by_band(clean: DataFrame) -> DataFrame:
    """A2: quote-level win rate per margin band, over quote headers."""
    agg = quote_header(clean).groupBy("band_ord").agg(
        F.count("quote_id").alias("quotations"), F.avg("is_win").alias("win_rate"))
    return (_complete_bands(agg, [], "quotations").select("band_ord", "gmr_band", "quotations", "win_rate")
            .orderBy("band_ord"))


def _sweet_spot_agg(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, band) aggregate, including the NULL band (used for selection totals)."""
    return headers.groupBy(*keys, "band_ord").agg(
        F.count("quote_id").alias("quotations"),
        F.avg("is_win").alias("historical_win_rate"),
        F.avg("estimated_gross_profit").alias("average_gross_profit"))


def _sweet_spot(agg: DataFrame, keys: list[str]) -> DataFrame:
    out = _complete_bands(agg, keys, "quotations")
    return out.withColumn("expected_gp_proxy", F.col("historical_win_rate") * F.col("average_gross_profit"))


SWEET_COLS = ["selection", "band_ord", "gmr_band", "quotations", "historical_win_rate",
              "average_gross_profit", "expected_gp_proxy"]


def _all_agg(clean: DataFrame) -> DataFrame:
    return _sweet_spot_agg(quote_header(clean), [])


def _product_agg(clean: DataFrame) -> DataFrame:
    return _sweet_spot_agg(quote_product_header(clean.where(F.col("product").isNotNull())), ["product"])


def sweet_spot_all(clean: DataFrame, agg: DataFrame | None = None) -> DataFrame:
    """Sweet-spot table for all products (first line per quote)."""
    agg = _all_agg(clean) if agg is None else agg
    return _sweet_spot(agg, []).withColumn("selection", F.lit("All products")).select(*SWEET_COLS)


def sweet_spot_by_product(clean: DataFrame, agg: DataFrame | None = None) -> DataFrame:
    """Sweet-spot table per product (first line per quote *within* the product)."""
    agg = _product_agg(clean) if agg is None else agg
    return (_sweet_spot(agg, ["product"])
            .withColumn("selection", F.col("product").cast("string")).select(*SWEET_COLS))


def sweet_spot(clean: DataFrame) -> DataFrame:
    """A7 + A8: every selection of the product filter at once."""
    return sweet_spot_all(clean).unionByName(sweet_spot_by_product(clean))


def best_bands(clean: DataFrame) -> DataFrame:
    """Best win-rate band and best proxy band per selection (ties -> lowest band).

    Selections with no non-null band row yield no row (the reference crashes).
    The quote count of a selection is the sum over all its bands, NULL band
    included, taken from the same aggregates as the tables.
    """
    all_agg, prod_agg = _all_agg(clean), _product_agg(clean)
    table = sweet_spot_all(clean, all_agg).unionByName(sweet_spot_by_product(clean, prod_agg)).where(
        F.col("historical_win_rate").isNotNull() & F.col("expected_gp_proxy").isNotNull())
    best = table.groupBy("selection").agg(
        F.max(F.struct("historical_win_rate", (-F.col("band_ord")).alias("nb"), "gmr_band")).alias("_w"),
        F.max(F.struct("expected_gp_proxy", (-F.col("band_ord")).alias("nb"), "gmr_band")).alias("_p"))
    counts = (all_agg.agg(F.sum("quotations").alias("quotations"))
              .withColumn("selection", F.lit("All products"))
              .unionByName(prod_agg.groupBy(F.col("product").cast("string").alias("selection"))
                           .agg(F.sum("quotations").alias("quotations"))))
    return best.join(counts, "selection", "left").select(
        "selection",
        F.col("_w.gmr_band").alias("best_win_rate_band"),
        F.col("_w.historical_win_rate").alias("best_win_rate"),
        F.col("_p.gmr_band").alias("best_proxy_band"),
        F.col("_p.expected_gp_proxy").alias("best_proxy"),
        F.col("quotations").cast("bigint").alias("quotations"))


# ------------------------------------------------------------------ A3
def product_win_rate(clean: DataFrame, min_quotes: int = PRODUCT_MIN_QUOTES) -> DataFrame:
    """A3: per-product quote count and win rate over (quote, product) first rows; HAVING >= 20."""
    headers = quote_product_header(clean.where(F.col("product").isNotNull()))
    return (headers.groupBy("product")
            .agg(F.count("quote_id").alias("observations"), F.avg("is_win").alias("win_rate"))
            .where(F.col("observations") >= min_quotes)
            .orderBy("win_rate", "product"))


# ------------------------------------------------------------------ A4-A6
def product_median_margin(clean: DataFrame) -> DataFrame:
    """A4: exact median gross margin per product, over all lines."""
    return exact_medians(clean.where(F.col("product").isNotNull()), ["product"],
                         {"median_margin": "gross_margin_rate"})


def review_signal(far_above: Column, margin_floor: float) -> Column:
    """A5's label: the first rule that holds, given the product's ``median_margin``."""
    threshold = F.greatest(F.lit(margin_floor), F.col("median_margin"))
    return (F.when(far_above, F.lit(SIG_ABOVE))
            .when(F.col("gross_margin_rate") > threshold, F.lit(SIG_HIGH_MARGIN))
            .when(F.col("competitor_count_available") == 0, F.lit(SIG_NO_INFO))
            .otherwise(F.lit(SIG_OTHER)))


def loss_signals(clean: DataFrame, margin_floor: float = LOSS_MARGIN_FLOOR,
                 gap_threshold: float = 5.0) -> DataFrame:
    """A5: first-matching review signal for each lost line.

    The per-product medians table has one row per product; it is attached with
    ``lookup_join`` (hot products salted; AQE broadcasts it when small).
    """
    med = product_median_margin(clean)
    lost = clean.where(F.col("is_win") == 0)
    j = lookup_join(lost, med, ["product"])
    gap = F.col("price_gap_min_competitor_pct")
    signal = review_signal(gap.isNotNull() & (gap > gap_threshold), margin_floor)
    return j.select("quote_id", "line_seq", "product", "gross_margin_rate",
                    "price_gap_min_competitor_pct", "competitor_count_available",
                    signal.alias("review_signal"))


def loss_signal_summary(clean: DataFrame) -> DataFrame:
    """Lost lines per signal, most frequent first."""
    return (loss_signals(clean).groupBy("review_signal")
            .agg(F.count(F.lit(1)).alias("failed_lines"))
            .orderBy(F.desc("failed_lines"), "review_signal"))


# ------------------------------------------------------------------ A10-A13
def price_position_lines(clean: DataFrame) -> DataFrame:
    """A10: position label from the stored gap percent, for lines with a benchmark."""
    return (clean.where(F.col("min_competitor_price").isNotNull())
            .withColumn("price_position", price_position_by_pct("price_gap_min_competitor_pct")))


def price_position_summary(clean: DataFrame) -> DataFrame:
    """Lines and win rate per position, fixed 3-row order; a missing one has NULL count."""
    agg = price_position_lines(clean).groupBy("price_position").agg(
        F.count(F.lit(1)).alias("product_lines"), F.avg("is_win").alias("historical_win_rate"))
    dim = F.broadcast(position_dimension(clean.sparkSession))
    return dim.join(agg, "price_position", "left").select(
        "position_ord", "price_position", "product_lines", "historical_win_rate").orderBy("position_ord")


def competitor_availability(clean: DataFrame) -> DataFrame:
    """Histogram of available competitor prices."""
    return (clean.where(F.col("competitor_count_available").isNotNull())
            .groupBy(F.col("competitor_count_available").alias("available_competitor_prices"))
            .agg(F.count(F.lit(1)).alias("product_lines"))
            .orderBy("available_competitor_prices"))


def product_position(clean: DataFrame, min_lines: int = PRODUCT_POSITION_MIN_LINES) -> DataFrame:
    """Lines and win rate per (product, position), HAVING >= 10."""
    return (price_position_lines(clean).where(F.col("product").isNotNull())
            .groupBy("product", "price_position")
            .agg(F.count(F.lit(1)).alias("observations"), F.avg("is_win").alias("win_rate"))
            .where(F.col("observations") >= min_lines))


# ------------------------------------------------------------------ A14 / A15
def data_quality_kpis(clean: DataFrame) -> DataFrame:
    """Lines, quotes, multi-line quotes, negative-margin lines (strict < 0, T2).

    One aggregation per quote (map-side combined), then a global fold.
    """
    per_quote = clean.groupBy("quote_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((F.col("gross_margin_rate") < 0).cast("int")).alias("_neg"))
    return quality_row(per_quote)


def quality_row(per_quote: DataFrame) -> DataFrame:
    """A14's row from the number of lines ``_n`` and of negative margins ``_neg`` per quote."""
    return per_quote.agg(
        F.sum("_n").cast("bigint").alias("clean_lines"),
        F.count("quote_id").alias("unique_quotes"),
        F.sum(F.when(F.col("quote_id").isNotNull() & (F.col("_n") > 1), 1).otherwise(0))
        .cast("bigint").alias("multi_line_quotes"),
        F.coalesce(F.sum("_neg"), F.lit(0)).cast("bigint").alias("negative_margin_lines"))


def competitor_missingness(clean: DataFrame) -> DataFrame:
    """Missing count and rate of competitors A/B/C, long form (a zero price is not missing)."""
    wide = clean.agg(*[
        agg(F.col(f"competitor_{x}").isNull().cast("int")).alias(f"{name}_{x}")
        for x in ("a", "b", "c") for name, agg in (("n", F.sum), ("r", F.avg))])
    return missingness_rows(wide)


def missingness_rows(wide: DataFrame) -> DataFrame:
    """A15's rows from counts ``n_a`` to ``n_c`` and rates ``r_a`` to ``r_c``."""
    return wide.select(F.expr(
        "stack(3, 'Competitor A', n_a, r_a, 'Competitor B', n_b, r_b, 'Competitor C', n_c, r_c) "
        "as (field, missing_records, missing_rate)")).select(
        "field", F.coalesce(F.col("missing_records"), F.lit(0)).cast("bigint").alias("missing_records"), "missing_rate")
