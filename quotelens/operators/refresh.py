"""Incremental refresh of the reports (S2 with A1-A15) from mergeable partial states.

Two narrow tables stand for all lines seen so far:

* ``firsts``: per (quote, product) the first line's report columns, the number
  of lines and of lines with a negative margin;
* ``shapes``: how many lines share a product, a margin and the other values
  that the line reports look at.

Both merge by least ``line_seq`` and by sums, so the states of two batches give
the same reports as one run over all lines.  A refresh reads the new lines and
the states; of the history only the rows of quotes that get new lines are
looked up, to find lines sent again.

New lines come later in the file order than known ones: of equal lines the
known one stays.  An empty batch leaves the states as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    LOSS_MARGIN_FLOOR,
    POSITION_TOLERANCE_PCT,
    PRODUCT_MIN_QUOTES,
    PRODUCT_POSITION_MIN_LINES,
)
from ..functions.columns import position_dimension, price_position_by_pct
from ..session import materialize, materialize_grouped
from . import reports as A
from .cleaning import quote_header
from .keyed import lookup_join, settings, weighted_medians

FIRST_COLS = ["line_seq", "band_ord", "gmr_band", "is_win", "estimated_gross_profit"]
COMPETITORS = ["a", "b", "c"]
SHAPE_COLS = ["product", "gross_margin_rate", "is_win", "competitor_count_available", "price_position", "far_above",
              *[f"no_competitor_{x}" for x in COMPETITORS]]
#: What a state is made of.
LINE_COLS = ["quote_id", "product", *FIRST_COLS, "gross_margin_rate", "competitor_count_available", "min_competitor_price",
             "price_gap_min_competitor_pct", *[f"competitor_{x}" for x in COMPETITORS]]


class ReportState(NamedTuple):
    firsts: DataFrame
    shapes: DataFrame


def _folded(firsts: DataFrame, shapes: DataFrame) -> ReportState:
    """Least first line and summed counts per key (map-side combine)."""
    one = firsts.groupBy("quote_id", "product").agg(
        F.min(F.struct(*FIRST_COLS)).alias("_f"), F.sum("n_lines").alias("n_lines"),
        F.sum("n_negative").alias("n_negative"))
    return ReportState(one.select("quote_id", "product", "_f.*", "n_lines", "n_negative"),
                       shapes.groupBy(*SHAPE_COLS).agg(F.sum("n").alias("n")))


def summarise(lines: DataFrame) -> ReportState:
    """The state of a table of clean lines."""
    negative = F.coalesce(F.col("gross_margin_rate") < 0, F.lit(False)).cast("long")
    firsts = lines.select("quote_id", "product", *FIRST_COLS, F.lit(1).cast("long").alias("n_lines"),
                          negative.alias("n_negative"))
    gap = "price_gap_min_competitor_pct"
    shapes = lines.select(
        "product", "gross_margin_rate", "is_win", "competitor_count_available",
        F.when(F.col("min_competitor_price").isNotNull(), price_position_by_pct(gap)).alias("price_position"),
        F.coalesce(F.col(gap) > POSITION_TOLERANCE_PCT, F.lit(False)).alias("far_above"),
        *[F.col(f"competitor_{x}").isNull().alias(f"no_competitor_{x}") for x in COMPETITORS],
        F.lit(1).cast("long").alias("n"))
    return _folded(firsts, shapes)


def merge(a: ReportState, b: ReportState) -> ReportState:
    """The state of both tables' lines together."""
    return _folded(a.firsts.unionByName(b.firsts), a.shapes.unionByName(b.shapes))


def fresh_lines(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Lines of a clean batch that ``known`` doesn't hold yet (C4: ``line_seq`` isn't part of a row).

    ``known`` is first cut to the quotes of the batch (lines without a quote all
    stay).  Equal lines, NULL equal to NULL, then meet in one window: of tables
    bucketed by quote no row leaves its partition for that.
    """
    business = ["quote_id", *[c for c in batch.columns if c not in ("line_seq", "quote_id")]]
    quotes = batch.select(F.col("quote_id").alias("_q")).distinct()
    near = known.join(quotes, F.col("quote_id") == F.col("_q"), "left_semi").unionByName(
        known.where(F.col("quote_id").isNull()))
    both = batch.select(*business, "line_seq", F.lit(False).alias("_known")).unionByName(
        near.select(*business, F.lit(None).cast(batch.schema["line_seq"].dataType).alias("line_seq"), F.lit(True).alias("_known")))
    again = F.max("_known").over(Window.partitionBy(*business))
    return both.withColumn("_again", again).where(~F.col("_again")).select(*batch.columns)


def write_state(state: ReportState) -> ReportState:
    """Write the state in the shared folder, first lines bucketed by quote: reports on them need no exchange.

    They are written before they are counted for that, so that nothing behind them runs twice."""
    firsts = materialize_grouped(materialize(state.firsts, "merged"), "firsts", "quote_id", ["line_seq"],
                                 hot_rows=settings(state.firsts.sparkSession)[0])
    return ReportState(firsts, materialize(state.shapes, "shapes"))


def refresh(state: ReportState, batch: DataFrame, known: DataFrame) -> ReportState:
    """The written state after a batch of clean lines; ``known`` are the clean lines it was made of."""
    fresh = materialize(fresh_lines(batch, known).select(*LINE_COLS), "fresh")   # both tables of the state read it
    return write_state(merge(state, summarise(fresh)))


# ------------------------------------------------------------------ reports
def _lines(pred: Column | None = None) -> Column:
    """Number of lines (that satisfy a predicate; NULL counts as False)."""
    n = F.col("n") if pred is None else F.when(pred, F.col("n")).otherwise(F.lit(0))
    return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")


def _rate(pred: Column) -> Column:
    """Share of lines; NULL without lines."""
    return F.try_divide(_lines(pred), _lines())


def overview_kpis(state: ReportState) -> DataFrame:
    """A1."""
    return A.overview_row(
        quote_header(state.firsts),
        state.shapes.agg(F.count_distinct("product").alias("product_categories"),
                         _rate(F.col("competitor_count_available") > 0).alias("competitor_info_share")))


def win_rate_by_band(state: ReportState) -> DataFrame:
    """A2."""
    return A.win_rate_by_band(state.firsts)


def product_win_rate(state: ReportState, min_quotes: int = PRODUCT_MIN_QUOTES) -> DataFrame:
    """A3."""
    return A.product_win_rate(state.firsts, min_quotes)


def product_median_margin(state: ReportState) -> DataFrame:
    """A4: each margin counts as often as lines have it."""
    return weighted_medians(state.shapes.where(F.col("product").isNotNull()), ["product"],
                            "gross_margin_rate", "n", "median_margin")


def loss_signal_summary(state: ReportState, margin_floor: float = LOSS_MARGIN_FLOOR) -> DataFrame:
    """All lines of a shape have the same signal."""
    lost = lookup_join(state.shapes.where(F.col("is_win") == 0), product_median_margin(state), ["product"])
    signal = A.review_signal(F.col("far_above"), margin_floor)
    return (lost.groupBy(signal.alias("review_signal")).agg(_lines().alias("failed_lines"))
            .orderBy(F.desc("failed_lines"), "review_signal"))


def sweet_spot(state: ReportState) -> DataFrame:
    """A7, A8."""
    return A.sweet_spot(state.firsts)


def best_bands(state: ReportState) -> DataFrame:
    """A9."""
    return A.best_bands(state.firsts)


def price_position_summary(state: ReportState) -> DataFrame:
    """A10, A11."""
    agg = state.shapes.where(F.col("price_position").isNotNull()).groupBy("price_position").agg(
        _lines().alias("product_lines"), _rate(F.col("is_win") == 1).alias("historical_win_rate"))
    dim = F.broadcast(position_dimension(agg.sparkSession))
    return dim.join(agg, "price_position", "left").select(
        "position_ord", "price_position", "product_lines", "historical_win_rate").orderBy("position_ord")


def competitor_availability(state: ReportState) -> DataFrame:
    """A12."""
    return (state.shapes.where(F.col("competitor_count_available").isNotNull())
            .groupBy(F.col("competitor_count_available").alias("available_competitor_prices"))
            .agg(_lines().alias("product_lines")).orderBy("available_competitor_prices"))


def product_position(state: ReportState, min_lines: int = PRODUCT_POSITION_MIN_LINES) -> DataFrame:
    """A13."""
    return (state.shapes.where(F.col("product").isNotNull() & F.col("price_position").isNotNull())
            .groupBy("product", "price_position")
            .agg(_lines().alias("observations"), _rate(F.col("is_win") == 1).alias("win_rate"))
            .where(F.col("observations") >= min_lines))


def data_quality_kpis(state: ReportState) -> DataFrame:
    """A14."""
    return A.quality_row(state.firsts.groupBy("quote_id").agg(
        F.sum("n_lines").alias("_n"), F.sum("n_negative").alias("_neg")))


def competitor_missingness(state: ReportState) -> DataFrame:
    """A15."""
    return A.missingness_rows(state.shapes.agg(*[
        e for x in COMPETITORS for e in (_lines(F.col(f"no_competitor_{x}")).alias(f"n_{x}"),
                                         _rate(F.col(f"no_competitor_{x}")).alias(f"r_{x}"))]))


REPORTS = {fn.__name__: fn for fn in (
    overview_kpis, win_rate_by_band, product_win_rate, product_median_margin, loss_signal_summary, sweet_spot,
    best_bands, price_position_summary, competitor_availability, product_position, data_quality_kpis,
    competitor_missingness)}
