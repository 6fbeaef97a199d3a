"""Column expressions (JVM-side, codegen-friendly); no Python UDFs.

Every function here maps Columns to a Column, so it runs unchanged in a batch
or streaming plan and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    BAND_LABELS,
    BAND_UPPER_EDGES,
    POS_ABOVE,
    POS_ALIGNED,
    POS_BELOW,
    POS_UNAVAILABLE,
    POSITION_ORDER,
    POSITION_TOLERANCE,
    POSITION_TOLERANCE_PCT,
)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- bands
def gmr_band_ord(g: Column | str) -> Column:
    """0..7 for the right-closed bands; NULL for NULL and -inf."""
    g = col_(g)
    expr = F.when(g.isNull() | (g == F.lit(float("-inf"))), F.lit(None).cast("int"))
    for i, edge in enumerate(BAND_UPPER_EDGES):
        expr = expr.when(g <= F.lit(edge), F.lit(i))
    return expr.otherwise(F.lit(len(BAND_UPPER_EDGES)))


def band_label(ord_: Column | str) -> Column:
    """Label of a band ordinal; NULL stays NULL (a CASE chain, not an array lookup)."""
    o = col_(ord_)
    expr = F.when(o.isNull(), F.lit(None).cast("string"))
    for i, lbl in enumerate(BAND_LABELS):
        expr = expr.when(o == i, F.lit(lbl))
    return expr


def gmr_band(g: Column | str) -> Column:
    return band_label(gmr_band_ord(g))


def band_dimension(spark: SparkSession) -> DataFrame:
    """The 8-row ordered band dimension (fixed size, safe to broadcast)."""
    return spark.createDataFrame(
        [(i, lbl) for i, lbl in enumerate(BAND_LABELS)],
        T.StructType([T.StructField("band_ord", T.IntegerType(), False),
                      T.StructField("gmr_band", T.StringType(), False)]))


def position_dimension(spark: SparkSession) -> DataFrame:
    """The 3-row ordered price-position dimension."""
    return spark.createDataFrame(
        [(i, p) for i, p in enumerate(POSITION_ORDER)],
        T.StructType([T.StructField("position_ord", T.IntegerType(), False),
                      T.StructField("price_position", T.StringType(), False)]))


# ---------------------------------------------------------------- labels
def is_win(convert_to_order: Column | str) -> Column:
    """0 = won (inverted flag); a missing flag counts as a loss."""
    return col_(convert_to_order).eqNullSafe(0).cast("int")


# ---------------------------------------------------------------- competitors
def available_competitors(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """Competitor prices that are present and > 0, in A, B, C order."""
    return F.filter(F.array(col_(a), col_(b), col_(c)), lambda x: x > 0)


def array_mean(arr: Column) -> Column:
    """Left-to-right sum / size; NULL for an empty array."""
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(arr) > 0, total / F.size(arr))


def competitor_summary(a: Column | str, b: Column | str, c: Column | str) -> tuple[Column, Column, Column]:
    """(number, mean, least) of the available competitor prices, as ``available_competitors`` lists them.

    Without an array and its lambdas, so that it is compiled with the rest of a row's expressions."""
    usable = [F.when(col_(x) > 0, col_(x)) for x in (a, b, c)]
    n, total = F.lit(0), F.lit(0.0)
    for x in usable:
        n, total = n + x.isNotNull().cast("int"), total + F.coalesce(x, F.lit(0.0))
    return n, F.when(n > 0, total / n), F.least(*usable)


# ---------------------------------------------------------------- positions
def price_position_by_ratio(unit_price: Column | str, min_competitor: Column | str) -> Column:
    up, mc = col_(unit_price), col_(min_competitor)
    ratio = F.try_divide(up - mc, mc)
    return (F.when(mc.isNull(), F.lit(POS_UNAVAILABLE))
            .when(ratio < -POSITION_TOLERANCE, F.lit(POS_BELOW))
            .when(ratio <= POSITION_TOLERANCE, F.lit(POS_ALIGNED))
            .otherwise(F.lit(POS_ABOVE)))


def price_position_by_pct(gap_pct: Column | str) -> Column:
    g = col_(gap_pct)
    return (F.when(g < -POSITION_TOLERANCE_PCT, F.lit(POS_BELOW))
            .when(g.between(-POSITION_TOLERANCE_PCT, POSITION_TOLERANCE_PCT), F.lit(POS_ALIGNED))
            .otherwise(F.lit(POS_ABOVE)))


def position_ord(label: Column | str) -> Column:
    lbl = col_(label)
    expr = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, p in enumerate(POSITION_ORDER):
        expr = expr.when(lbl == p, F.lit(i))
    return expr


# ---------------------------------------------------------------- scenario math
def scenario_columns(cost_per_unit: Column, gmr: Column, qty: Column, grant: Column,
                     a: Column, b: Column, c: Column) -> dict[str, Column]:
    """The derived columns of one priced scenario, as expressions."""
    unit_price = F.try_divide(cost_per_unit, F.lit(1.0) - gmr)
    subtotal = unit_price * qty
    total_cost = cost_per_unit * qty
    n, avg_c, min_c = competitor_summary(a, b, c)
    return {
        "unit_price": unit_price,
        "subtotal_price": subtotal,
        "estimated_cost": total_cost,
        "grant_ratio_to_subtotal": F.when(subtotal != 0, grant / subtotal),
        "competitor_count_available": n,
        "avg_competitor_price": avg_c,
        "min_competitor_price": min_c,
        "price_gap_avg_competitor_pct": (unit_price - avg_c) / avg_c * 100,
        "price_gap_min_competitor_pct": (unit_price - min_c) / min_c * 100,
        "gross_profit_amount": subtotal - total_cost,
    }


# ---------------------------------------------------------------- rounding
def rounded(x: Column | str, places: int) -> Column:
    """``round(x, places)`` of a double, to the bit, without a decimal per value.

    A whole number below 2^53 over a power of ten is the double next to that decimal, as ``round`` returns it.
    Below 2^43 the scaled value is off by less than 0.01; values that close to a tie, larger ones, NaN and
    infinities are left to ``round``."""
    x, unit = col_(x).cast("double"), 10.0 ** places
    near = F.floor(x * unit + 0.5)
    plain = (F.abs(x) < 2.0 ** 43 / unit) & (F.abs(x * unit - near) < 0.49)
    return F.when(plain, near / F.lit(unit)).otherwise(F.round(x, places))


# ---------------------------------------------------------------- formatting
def fmt_currency(v: Column | str) -> Column:
    """Thousands separators, no decimals (half-even); 'N/A' when missing."""
    return F.coalesce(F.format_number(col_(v), 0), F.lit("N/A"))


def fmt_signed_currency(v: Column | str) -> Column:
    v = col_(v)
    return F.when(v.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.when(v >= 0, F.lit("+")).otherwise(F.lit("")), F.format_number(v, 0)))


def fmt_percent(v: Column | str, decimals: int = 1, signed: bool = False,
                na: str | None = None) -> Column:
    """Python-style ``{:.Nf%}``: value x 100, rounded half-even, optional sign."""
    v = col_(v)
    r = F.bround(v * 100, decimals)
    fmt = f"%.{decimals}f%%"
    # a negative value that rounds to zero keeps its sign ("-0.0%"), as in Python
    body = F.when((v < 0) & (r == 0), F.concat(F.lit("-"), F.format_string(fmt, F.lit(0.0)))) \
        .otherwise(F.format_string(fmt, r))
    if signed:
        body = F.concat(F.when(v >= 0, F.lit("+")).otherwise(F.lit("")), body)
    if na is not None:
        body = F.when(v.isNull(), F.lit(na)).otherwise(body)
    return body
