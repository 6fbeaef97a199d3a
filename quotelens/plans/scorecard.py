"""Win-probability scorers as Column expressions.

A scorer maps a dict of feature Columns (the 13 model features) to a
probability Column.  Because it is an expression, it can be evaluated inside
``transform(sequence(...))`` for the whole margin grid of a request without
exploding rows or calling back into Python.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class WinScorer(Protocol):
    """probability(f) is required.  A scorer may also

    * ``prepare`` a table, attaching columns it looks up (a model's product
      terms), before its expressions are used on it;
    * split its logit into a margin-independent ``fixed_logit(f)`` and
      ``varying_logit(f, fixed)``;
    * give its logit over the margin grid as ``grid_terms(f, fixed)``: columns
      a, b, c, d of a + b * margin + c * price + d / price, all of them
      margin-independent, so that a grid point costs a few operations."""

    def probability(self, f: dict[str, Column]) -> Column: ...


def prepared(df: DataFrame, scorer: WinScorer) -> DataFrame:
    return scorer.prepare(df) if hasattr(scorer, "prepare") else df


MARGIN_VARYING = {"unit_price", "gross_margin_rate", "grant_ratio_to_subtotal",
                  "price_gap_avg_competitor_pct", "price_gap_min_competitor_pct"}


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


class Scorecard:
    """Fixed logistic scorecard (deterministic stand-in for a fitted model).

    p = 1 / (1 + exp(-z)),
    z = b0 + b_gmr * gmr + b_gap * coalesce(gap_min_pct, gap_fill) + b_kw * coalesce(kw, kw_fill)
    """

    def __init__(self, b0: float = 1.0, b_gmr: float = -4.0, b_gap: float = -0.02,
                 gap_fill: float = 20.0, b_kw: float = 0.01, kw_fill: float = 12.5):
        self.b0, self.b_gmr, self.b_gap = b0, b_gmr, b_gap
        self.gap_fill, self.b_kw, self.kw_fill = gap_fill, b_kw, kw_fill

    def fixed_logit(self, f: dict[str, Column]) -> Column:
        """The part of the logit that does not depend on the margin."""
        return F.lit(self.b_kw) * F.coalesce(f["kw"], F.lit(self.kw_fill))

    def varying_logit(self, f: dict[str, Column], fixed: Column) -> Column:
        return (F.lit(self.b0)
                - F.lit(-self.b_gmr) * f["gross_margin_rate"]
                - F.lit(-self.b_gap) * F.coalesce(f["price_gap_min_competitor_pct"], F.lit(self.gap_fill))
                + fixed)

    def grid_terms(self, f: dict[str, Column], fixed: Column) -> dict[str, Column]:
        least = f["min_competitor_price"]
        known = least.isNotNull()
        gap = F.lit(self.b_gap)
        return {"a": fixed + F.lit(self.b0) + F.when(known, gap * F.lit(-100.0)).otherwise(gap * F.lit(self.gap_fill)),
                "b": F.lit(self.b_gmr), "c": F.when(known, gap * F.lit(100.0) / least).otherwise(F.lit(0.0)), "d": F.lit(0.0)}

    def logit(self, f: dict[str, Column]) -> Column:
        return self.varying_logit(f, self.fixed_logit(f))

    def probability(self, f: dict[str, Column]) -> Column:
        return sigmoid(self.logit(f))


DEFAULT_SCORECARD = Scorecard()
