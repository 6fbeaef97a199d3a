"""The fitted model: optimum, scoring forms, split, store; and the distributed ranks behind its medians."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from quotelens.operators import keyed as K
from quotelens.operators import model as M
from quotelens.operators import pricing as P
from quotelens.plans.catalog import clean_of, requests_of
from quotelens.plans.fixed_model import FIXED_MODEL
from quotelens.plans.model_queries import fitted
from quotelens.plans.scorecard import DEFAULT_SCORECARD


@pytest.fixture(scope="module")
def clean(spark):
    return clean_of(spark, SF_SMALL)


@pytest.fixture(scope="module")
def final(spark):
    return fitted(spark, SF_SMALL, "final")


def dense_fit(pdf, prep, classes, C=0.5):
    """The same objective solved in numpy with every product as its own column."""
    z = [(pdf[f].astype(float).fillna(prep.medians[f]) - prep.means[f]) / prep.scales[f] for f in prep.features]
    product = pdf["product"].fillna(prep.product_fill)
    levels = sorted(product.unique())
    x = np.column_stack([np.ones(len(pdf)), *z, *[(product == v).astype(float) for v in levels]])
    y = pdf["is_win"].to_numpy(float)
    w = (1 / pdf.groupby("quote_id")["quote_id"].transform("count")).to_numpy() * np.where(y == 1, classes.weight[1], classes.weight[0])
    ridge = np.diag([0.0] + [1 / C] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ beta)
    return beta, levels


def test_fit_equals_a_dense_solution(spark, clean, final):
    pdf = clean.select("quote_id", "is_win", "product", *final.prep.features).toPandas()
    beta, levels = dense_fit(pdf, final.prep, final.classes)
    table = {r.product: (r.product_index, r.coefficient) for r in final.level_table(spark).collect()}
    assert sorted(table) == levels and [table[v][0] for v in levels] == list(range(len(levels)))
    got = [final.intercept, *final.numeric.values(), *[table[v][1] for v in levels]]
    assert np.allclose(got, beta, atol=1e-6)
    assert M.stationarity(final, clean).agg(F.max("gradient")).first()[0] < 1e-8


def test_steps_that_go_too_far_are_halved(spark):
    """Separable rows and hardly any penalty: plain Newton steps overshoot."""
    rows = [(i, "a" if i % 3 else "b", float(i), int(i > 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "quote_id long, product string, kw double, is_win int")
    model = M.fit_win_model(df, C=1e6, features=["kw"], max_iter=200)
    assert M.stationarity(model, df, C=1e6).agg(F.max("gradient")).first()[0] < 1e-6


def test_unknown_and_null_product(spark, final):
    base = {"kw": 10.0, "qty": 2, "unit_price": 1000.0, "gross_margin_rate": 0.3, "energy_grant_amount": 100.0,
            "estimated_cost": 1400.0, "grant_ratio_to_subtotal": 0.05, "competitor_count_available": 1,
            "avg_competitor_price": 990.0, "min_competitor_price": 990.0,
            "price_gap_avg_competitor_pct": 1.0, "price_gap_min_competitor_pct": 1.0}
    types = ", ".join(f"{c} {'int' if c in ('qty', 'competitor_count_available') else 'double'}" for c in base)
    df = spark.createDataFrame([(p, *base.values()) for p in ["ZZ_unseen", None, final.prep.product_fill]], f"product string, {types}")
    p = [r.win_probability for r in M.predict_win(final, df).collect()]
    z = final.intercept + sum(b * (base[f] - final.prep.means[f]) / final.prep.scales[f] for f, b in final.numeric.items())
    assert abs(p[0] - 1 / (1 + math.exp(-z))) < 1e-9          # unseen: no product term
    assert abs(p[1] - p[2]) < 1e-12                           # missing: the most frequent product


def test_all_null_feature_is_dropped(clean):
    m = M.fit_win_model(clean.withColumn("kw", F.lit(None).cast("double")))
    assert "kw" not in m.prep.features and "kw" not in m.numeric


def test_rows_without_any_product(spark):
    rows = [(i, None, float(i % 7), int(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(rows, "quote_id long, product string, kw double, is_win int")
    m = M.fit_win_model(df, features=["kw"])
    assert m.level_table(spark).count() == 0 and M.predict_win(m, df).where("win_probability IS NULL").count() == 0


def test_weighted_class_counts_option(clean):
    w = M.quote_weights(clean)
    raw, weighted = M.class_weights(w), M.class_weights(w, by_weight=True)
    n, n1 = clean.count(), clean.where("is_win = 1").count()
    assert abs(raw.weight[1] - n / (2 * n1)) < 1e-12
    assert abs(sum(weighted.count.values()) - clean.select("quote_id").distinct().count()) < 1e-6


def test_a_model_of_many_products_scores_with_the_same_plan(spark, clean):
    many = spark.range(200_000).select(F.concat(F.lit("Q"), "id").alias("product"), F.col("id").cast("int").alias("product_index"),
                                       (F.col("id") / 1e6).alias("coefficient"))
    few = many.limit(3)
    models = [M.FittedWinModel(FIXED_MODEL.prep, FIXED_MODEL.numeric, 0.1, M.materialize(t, "levels")) for t in (few, many)]
    sizes = []
    for m in models:
        out = M.predict_win(m, clean)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert out.count() == clean.count()
    assert abs(sizes[0] - sizes[1]) < 200
    one = spark.createDataFrame([("Q150000",)], "product string")
    assert models[1].product_index(one).first().product_index == 150_000


# ------------------------------------------------------------------ S3
def test_store_keeps_versions_and_detects_damage(spark, clean, final, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        M.FittedWinModel.load(spark, path)
    other = M.FittedWinModel(final.prep, final.numeric, final.intercept + 1, final.levels, final.classes)
    assert [final.save(spark, path), other.save(spark, path)] == [1, 2]
    first, latest = M.FittedWinModel.load(spark, path, 1), M.FittedWinModel.load(spark, path)
    assert latest.intercept == other.intercept and first.classes == final.classes
    scores = [M.predict_win(m, clean).select("quote_id", "line_seq", "win_probability") for m in (final, first)]
    apart = scores[0].join(scores[1].withColumnRenamed("win_probability", "q"), ["quote_id", "line_seq"])
    assert apart.where(F.abs(F.col("win_probability") - F.col("q")) > 1e-12).count() == 0 and apart.count() == clean.count()
    assert M.stationarity(first, clean).agg(F.max("gradient")).first()[0] < 1e-6
    folder = next(r["folder"] for r in M._manifest(spark, path) if r["version"] == 1)
    final.level_table(spark).limit(2).write.mode("overwrite").parquet(f"{path}/{folder}/levels")
    with pytest.raises(ValueError):
        M.FittedWinModel.load(spark, path, 1)


# ------------------------------------------------------------------ M1
@pytest.mark.parametrize("few", [1000, 2])
def test_split_takes_exactly_its_share_of_the_quotes(spark, monkeypatch, few):
    monkeypatch.setattr(M, "SPLIT_FEW", few)   # 2: the range is narrowed again and again
    for n in (0, 1, 4, 5, 777):
        lines = spark.range(3 * n).select((F.col("id") % n if n else F.col("id")).alias("quote_id"))
        lines = lines.unionByName(spark.createDataFrame([(None,)], "quote_id long"))
        split = M.group_split(lines)
        sides = split.where("quote_id IS NOT NULL").groupBy("quote_id").agg(F.min("is_test").alias("a"), F.max("is_test").alias("b"))
        assert sides.where("a <> b").count() == 0 and sides.where("b").count() == math.ceil(0.25 * n)
        assert split.where("quote_id IS NULL AND is_test").count() == 0


# ------------------------------------------------------------------ medians
def test_no_slice_holds_more_than_its_share(spark):
    """One global key whose values all differ: ranks come from every slice, none of which is large."""
    n = 40_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.xxhash64("id").alias("v"), F.lit(1).alias("f"))
    slices = []
    kept = K.materialize
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # else so few rows become one slice
    try:
        K.materialize = lambda d, name: slices.append(kept(d, name)) or slices[-1]
        out = K.running_totals(df, ["k"], ["v"], "f").collect()
    finally:
        K.materialize = kept
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in slices[0].groupBy("_slice").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2.5 * n / len(sizes)
    order = sorted(r.v for r in out)
    assert {r.v: r.before for r in out} == {v: i for i, v in enumerate(order)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 25_001])
def test_medians_of_different_and_equal_values(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.standard_normal(n) * 1e6, rng.integers(0, 3, n).astype(float)
    rows = [(("x", "y", None)[i % 3], float(a[i]), float(b[i]) if i % 5 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    for keys in ([], ["k"]):
        got = {tuple(r[k] for k in keys): (r["ma"], r["mb"]) for r in K.exact_medians(df, keys, {"ma": "a", "mb": "b"}).collect()}
        groups = {}
        for k, x, y in rows:
            groups.setdefault((k,) if keys else (), []).append((x, y))
        for k, v in groups.items():
            ys = [y for _, y in v if y is not None]
            assert got[k][0] == np.median([x for x, _ in v]) and got[k][1] == (np.median(ys) if ys else None)


# ------------------------------------------------------------------ the margin grid
@pytest.mark.parametrize("which", ["scorecard", "fixed", "fitted"])
def test_grid_terms_give_the_profits_of_the_whole_scenario(spark, final, which):
    reqs = requests_of(spark, SF_SMALL)
    odd = spark.createDataFrame([(-1, 1, "H11", None, 3, 100.0, 0.3, None, None, None, None, 0.2, 0.4),
                                 (-2, 1, None, 5.0, 0, 100.0, 0.3, 50.0, 0.0, 90.0, None, 0.2, 0.4),
                                 (-3, 1, "none", 5.0, 2, 0.0, 0.3, 50.0, 95.0, None, None, 0.2, 0.4)],
                                ", ".join(f"{n} {t}" for n, t in P.REQUEST_TYPES))
    reqs = reqs.select(*[n for n, _ in P.REQUEST_TYPES]).unionByName(odd)
    scorer = {"scorecard": DEFAULT_SCORECARD, "fixed": FIXED_MODEL, "fitted": final}[which]
    rows = P.with_expected_profits(reqs, scorer, False).select("quote_id", "line_seq", F.posexplode("_profits").alias("grid_index", "e"))
    both = rows.join(P.margin_curve(reqs, scorer), ["quote_id", "line_seq", "grid_index"])
    assert both.count() == reqs.count() * P.grid_size()
    off = F.abs(F.col("e") - F.col("expected_gross_profit")) > 1e-7 * (1 + F.abs(F.col("e")))
    assert both.where(off | (F.col("e").isNull() != F.col("expected_gross_profit").isNull())).count() == 0


def test_fitted_recommendation_is_the_curves_best_point(spark, final):
    reqs = requests_of(spark, SF_SMALL)
    best = (P.margin_curve(reqs, final).where("meets_minimum_margin").groupBy("quote_id", "line_seq")
            .agg(F.max("expected_gross_profit").alias("m")))
    j = P.recommend_margin(reqs, final).join(best, ["quote_id", "line_seq"])
    assert j.count() == reqs.count()
    assert j.where(F.abs(F.col("m") - F.col("recommended_expected_gross_profit")) > 1e-7).count() == 0
