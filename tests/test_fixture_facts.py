"""The verified facts of FIXTURES.md section 1.1 at sf0.001, and the reference's safeguards."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from quotelens.operators import cleaning as C
from quotelens.operators import model as M
from quotelens.operators import reports as A
from quotelens.plans.catalog import clean_of, raw_of


@pytest.fixture(scope="module")
def clean(spark):
    return clean_of(spark, SF_SMALL)


def test_raw_and_clean_counts(spark, clean):
    raw = raw_of(spark, SF_SMALL)
    assert raw.count() == 6051
    assert raw.select("quote_id").distinct().count() == 1473
    assert raw.select("product").distinct().count() == 25
    assert raw.where("qty <= 0").count() == 8
    assert clean.count() == 5473
    assert clean.select("quote_id").distinct().count() == 1473


def test_clean_facts(clean):
    row = clean.agg(
        F.avg("is_win").alias("wr"),
        F.sum((F.col("gross_margin_rate") < 0).cast("int")).alias("neg"),
        F.sum((F.col("gross_margin_rate") == 0).cast("int")).alias("zero"),
        F.sum(F.col("kw").isNull().cast("int")).alias("kw_null"),
        *[F.sum(F.col(f"competitor_{x}").isNull().cast("int")).alias(f"{x}_null") for x in "abc"],
    ).first()
    assert round(row.wr, 4) == 0.3901
    assert (row.neg, row.zero, row.kw_null) == (611, 61, 114)       # negative margins are kept
    assert (row.a_null, row.b_null, row.c_null) == (1847, 2686, 4373)  # missing never zero-filled


def test_availability_positions_and_multi_product(clean):
    avail = {r.available_competitor_prices: r.product_lines for r in A.competitor_availability(clean).collect()}
    assert avail == {0: 800, 1: 2402, 2: 2019, 3: 252}
    kpi = A.overview_kpis(clean).first()
    assert round(kpi.competitor_info_share, 4) == 0.8538
    pos = {r.price_position: r.product_lines for r in A.price_position_summary(clean).collect()}
    assert list(pos.values()) == [1355, 454, 2864]
    multi = C.flag_multi_product(clean).where("multi_product_quote").select("quote_id").distinct().count()
    assert multi == 1350


def test_split_size_and_disjoint(clean):
    s = M.group_split(clean)
    assert s.where("is_test").select("quote_id").distinct().count() == 348
    both = s.groupBy("quote_id").agg(F.countDistinct("is_test").alias("sides")).where("sides > 1").count()
    assert both == 0


def test_header_win_rate_falls_with_margin(clean):
    rates = [r.win_rate for r in A.win_rate_by_band(clean).orderBy("band_ord").collect()]
    assert round(rates[0], 3) == 0.768 and round(rates[-1], 3) == 0.084
