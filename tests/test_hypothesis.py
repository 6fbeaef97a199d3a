"""Property-based checks of column functions against plain-Python references."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from quotelens.constants import BAND_LABELS, BAND_UPPER_EDGES
from quotelens.functions.columns import gmr_band, price_position_by_pct


def band_ref(g):
    """Right-closed bins (a, b]; NULL, NaN and -inf have no band."""
    if g is None or math.isnan(g) or g == float("-inf"):
        return None
    for i, edge in enumerate(BAND_UPPER_EDGES):
        if g <= edge:
            return BAND_LABELS[i]
    return BAND_LABELS[-1]


def position_ref(gap):
    if gap is not None and gap < -5:
        return "Below competitor benchmark"
    if gap is not None and -5 <= gap <= 5:
        return "Approximately aligned (±5%)"
    return "Above competitor benchmark"


values = st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=True, width=64),
                   st.sampled_from([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, -5.0, 5.0, 0.60000001]))


@settings(max_examples=5, deadline=None)
@given(st.lists(values, min_size=1, max_size=60))
def test_bands_match_right_closed_bins(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, g double")
    got = [r[0] for r in df.orderBy("i").select(gmr_band("g")).collect()]
    assert got == [band_ref(x) for x in xs]


@settings(max_examples=5, deadline=None)
@given(st.lists(values, min_size=1, max_size=60))
def test_positions_match_reference(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, g double")
    got = [r[0] for r in df.orderBy("i").select(price_position_by_pct("g")).collect()]
    assert got == [position_ref(x) for x in xs]
