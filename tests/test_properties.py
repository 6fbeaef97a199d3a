"""Properties, partition invariance, skew path equivalence and model optimality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from quotelens.operators import cleaning as C
from quotelens.operators import evaluation as E
from quotelens.operators import model as M
from quotelens.operators import pricing as P
from quotelens.operators import reports as A
from quotelens.plans.catalog import clean_of, requests_of
from quotelens.plans.model_queries import scorecard_scores
from quotelens.plans.scorecard import DEFAULT_SCORECARD
from quotelens.session import is_grouped


@pytest.fixture(scope="module")
def clean(spark):
    return clean_of(spark, SF_SMALL)


@pytest.fixture(scope="module")
def reqs(spark):
    return requests_of(spark, SF_SMALL)


def test_bands_cover_non_null_headers(clean):
    total = A.win_rate_by_band(clean).agg(F.sum("quotations")).first()[0]
    expect = C.quote_header(clean).where("band_ord IS NOT NULL").count()
    assert total == expect


def test_price_times_one_minus_margin_is_cost(reqs):
    bad = P.price_scenarios(reqs).where(
        F.abs(F.col("unit_price") * (1 - F.col("gross_margin_rate")) - F.col("cost_per_unit"))
        > 1e-9 * F.abs(F.col("cost_per_unit"))).count()
    assert bad == 0


def test_recommendation_is_feasible_and_optimal(reqs):
    rec = P.recommend_margin(reqs, DEFAULT_SCORECARD)
    assert rec.where(F.col("recommended_margin") < F.lit(0.2) - 1e-12).count() == 0
    curve = P.margin_curve(reqs, DEFAULT_SCORECARD).where("meets_minimum_margin")
    best = curve.groupBy("quote_id", "line_seq").agg(F.max("expected_gross_profit").alias("m"))
    j = rec.join(best, ["quote_id", "line_seq"])
    assert j.count() == reqs.count()
    assert j.where(F.abs(F.col("m") - F.col("recommended_expected_gross_profit")) > 1e-9).count() == 0


def test_quote_weights_sum_to_one(clean):
    w = M.quote_weights(clean).groupBy("quote_id").agg(F.sum("quote_weight").alias("s"))
    assert w.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_flags_nonempty_and_low_alone(reqs):
    f = P.risk_flags(reqs, DEFAULT_SCORECARD)
    per = f.groupBy("quote_id", "line_seq").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("severity") == "Low").cast("int")).alias("low"))
    assert per.count() == reqs.count()
    assert per.where((F.col("low") > 0) & (F.col("n") > 1)).count() == 0


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_distributed_cumulation_matches_brute_force(clean, slices):
    s = scorecard_scores(clean)
    got = E.curve_metrics(s, slices=slices).first()
    pdf = s.toPandas()
    y, p = pdf["label"].to_numpy(), pdf["score"].to_numpy()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    at = np.unique(p)
    tp, fp = (pos[:, None] >= at).sum(axis=0), (neg[:, None] >= at).sum(axis=0)
    gain = -np.diff(np.append(tp, 0)) / len(pos)
    assert abs(got.roc_auc - auc) < 1e-9
    assert abs(got.average_precision - (gain * tp / (tp + fp)).sum()) < 1e-9
    again = E.roc_auc(s.withColumn("score", F.col("score") * 3 + 7)).first()[0]
    assert abs(got.roc_auc - again) < 1e-12


def test_fitted_model_has_signal(spark):
    import __spark_entry__ as entry
    m = entry.queries()["model_metrics"](spark, SF_SMALL).first()
    assert m.roc_auc > 0.5 and 0 <= m.accuracy <= 1


PER_QUOTE = ["quote_header", "quote_product_header", "flag_multi_product", "quote_weights_all", "overview_kpis", "win_rate_by_band",
             "product_win_rate", "sweet_spot_all", "sweet_spot_by_product", "best_bands", "data_quality_kpis"]


def test_per_quote_operators_need_no_exchange_of_the_clean_table(spark):
    from quotelens.plans import catalog
    for name in PER_QUOTE:
        df = catalog.spark_queries()[name](spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(quote_id" not in plan, name


def _rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_partition_invariance_and_layouts_agree(spark):
    from quotelens.plans import catalog
    out = []
    for partitions, hot in (("1", None), ("64", None), ("8", "1")):   # hot 1: the table isn't grouped
        catalog.clear_cache()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        if hot:
            spark.conf.set("quotelens.hotKeyRows", hot)
        try:
            c = clean_of(spark, SF_SMALL)
            assert is_grouped(c, "quote_id") == (hot is None)
            out.append([_rounded(A.win_rate_by_band(c)), _rounded(A.sweet_spot_by_product(c)),
                        _rounded(C.quote_header(c).select("quote_id", "line_seq")), _rounded(M.quote_weights(c).select("quote_id", "line_seq", "quote_weight")),
                        _rounded(C.flag_multi_product(c).select("quote_id", "line_seq", "multi_product_quote")),
                        _rounded(E.roc_auc(scorecard_scores(M.group_split(c).where("is_test"))))])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("quotelens.hotKeyRows")
    catalog.clear_cache()
    assert out[0] == out[1] == out[2]
