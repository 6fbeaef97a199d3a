"""Model training and evaluation queries (M1-M15) and their oracle SQL.

Preprocessing queries read the objects of the actual fit.  Queries whose values
come from the fitted logistic model (coefficients, probabilities) have no
oracle: the optimiser's floats differ by engine.  Beside them, the fits are
checked for stationarity of their objective, and prediction, metrics and the
recommender run through the same model code with fixed numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NUMERIC_FEATURES
from ..operators import evaluation as E
from ..operators import model as M
from ..operators import pricing as P
from ..session import scratch_path
from .fixed_model import FIXED_MODEL, probability_sql
from .oracle_base import d, with_ctes
from .scorecard import DEFAULT_SCORECARD

#: |gradient| / sum of weights below which a term counts as at the optimum.
STATIONARY = 1e-6

_MODELS: dict[tuple[int, str, str], M.FittedWinModel] = {}


def _clean(spark, sf):
    from .catalog import clean_of
    return clean_of(spark, sf)


def _split(spark, sf) -> DataFrame:
    return M.group_split(_clean(spark, sf))


def _train(spark, sf) -> DataFrame:
    return _split(spark, sf).where(~F.col("is_test"))


def _test(spark, sf) -> DataFrame:
    return _split(spark, sf).where(F.col("is_test"))


def fitted(spark: SparkSession, sf: str, which: str = "eval") -> M.FittedWinModel:
    """'eval' = fit on the training split; 'final' = refit on all rows."""
    key = (id(spark), sf, which)
    if key not in _MODELS:
        data = _train(spark, sf) if which == "eval" else _clean(spark, sf)
        _MODELS[key] = M.fit_win_model(data)
    return _MODELS[key]


def scorecard_scores(df: DataFrame) -> DataFrame:
    f = {"gross_margin_rate": F.col("gross_margin_rate"), "kw": F.col("kw"),
         "price_gap_min_competitor_pct": F.col("price_gap_min_competitor_pct")}
    # both engines see one score where rounding errors differ, so ties are the same
    return df.select(F.col("is_win").alias("label"),
                     F.round(DEFAULT_SCORECARD.probability(f), 9).alias("score"))


def fixed_scores(df: DataFrame) -> DataFrame:
    return M.predict_win(FIXED_MODEL, df).select(
        F.col("is_win").alias("label"), F.round("win_probability", 9).alias("score"))


def imputed_medians(spark, sf) -> DataFrame:
    """M4 as the fitted model learnt it."""
    return spark.createDataFrame(list(fitted(spark, sf).prep.medians.items()), "feature string, median double")


def scaled_features(spark, sf) -> DataFrame:
    """M4 and M6 as the fitted model learnt them."""
    prep = fitted(spark, sf).prep
    return spark.createDataFrame([(f, prep.medians[f], prep.means[f], prep.scales[f]) for f in prep.features],
                                 "feature string, median double, mean double, std double")


def _fold(*ones: DataFrame) -> DataFrame:
    """Put one-row frames side by side without a cross join (union + max)."""
    cols = [c for o in ones for c in o.columns]
    padded = []
    for o in ones:
        padded.append(o.select(*[F.col(c) if c in o.columns else F.lit(None).cast("double").alias(c)
                                 for c in cols]))
    u = padded[0]
    for p in padded[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def model_queries():
    Q = {}
    Q["group_split"] = lambda s, f: _split(s, f).select("quote_id", "line_seq", "is_test")
    Q["quote_weights"] = lambda s, f: M.quote_weights(_train(s, f), "train_weight").select(
        "quote_id", "line_seq", "train_weight")
    Q["quote_weights_all"] = lambda s, f: M.quote_weights(_clean(s, f), "all_weight").select(
        "quote_id", "line_seq", "all_weight")
    Q["class_weights"] = lambda s, f: fitted(s, f).classes.table(s)
    Q["impute_numeric"] = imputed_medians
    Q["impute_product"] = lambda s, f: M.product_mode(_train(s, f))
    Q["standardize"] = scaled_features
    Q["onehot_product"] = lambda s, f: fitted(s, f).product_index(_clean(s, f)).select(
        "quote_id", "line_seq", "product", "product_index")

    # the fits are at the optimum of the documented objective, term by term (oracle: the terms)
    Q["win_model_stationary"] = lambda s, f: M.stationarity(fitted(s, f, "eval"), _train(s, f)).select(
        "term", (F.col("gradient") < STATIONARY).alias("stationary"))
    Q["final_model_stationary"] = lambda s, f: M.stationarity(fitted(s, f, "final"), _clean(s, f)).select(
        "term", (F.col("gradient") < STATIONARY).alias("stationary"))

    def stored(s, f):
        path = scratch_path(s, "model-store")
        version = fitted(s, f, "final").save(s, path)
        return M.stationarity(M.FittedWinModel.load(s, path, version), _clean(s, f)).select(
            "term", (F.col("gradient") < STATIONARY).alias("stationary"))
    Q["stored_model_stationary"] = stored   # S3: written, read back and still at the optimum

    Q["split_share"] = lambda s, f: _split(s, f).agg(
        F.count_distinct("quote_id").alias("quotes"),
        F.count_distinct(F.when(F.col("is_test"), F.col("quote_id"))).alias("test_quotes"))

    # prediction and its metrics through the model code, with fixed numbers
    Q["predict_win_fixed_model"] = lambda s, f: M.predict_win(FIXED_MODEL, _test(s, f)).select(
        "quote_id", "line_seq", "is_win", "win_probability", "predicted_win")
    Q["model_metrics_fixed_model"] = lambda s, f: _fold(E.curve_metrics(fixed_scores(_test(s, f))),
                                                        E.classification_metrics(fixed_scores(_test(s, f))))
    Q["confusion_matrix_fixed_model"] = lambda s, f: E.confusion_matrix(fixed_scores(_test(s, f)))

    # fitted model (rows-only checks)
    Q["train_win_model"] = lambda s, f: fitted(s, f, "eval").coefficient_table(s)
    Q["train_final_model"] = lambda s, f: fitted(s, f, "final").coefficient_table(s)
    Q["predict_win"] = lambda s, f: M.predict_win(fitted(s, f, "eval"), _test(s, f)).select(
        "quote_id", "line_seq", "is_win", "win_probability", "predicted_win")

    def model_metrics(s, f):
        scored = M.predict_win(fitted(s, f, "eval"), _test(s, f)).select(
            F.col("is_win").alias("label"), F.col("win_probability").alias("score"))
        return _fold(E.curve_metrics(scored), E.classification_metrics(scored))
    Q["model_metrics"] = model_metrics

    def model_confusion(s, f):
        scored = M.predict_win(fitted(s, f, "eval"), _test(s, f)).select(
            F.col("is_win").alias("label"), F.col("win_probability").alias("score"))
        return E.confusion_matrix(scored)
    Q["model_confusion_matrix"] = model_confusion

    def recommend_fitted(s, f):
        from .catalog import requests_of
        return P.recommend_margin(requests_of(s, f), fitted(s, f, "final"))
    Q["recommend_margin_fitted"] = recommend_fitted

    # holdout metrics on the fixed scorecard (oracle-checked)
    Q["metric_roc_auc"] = lambda s, f: E.roc_auc(scorecard_scores(_test(s, f)))
    Q["metric_avg_precision"] = lambda s, f: E.average_precision(scorecard_scores(_test(s, f)))
    Q["classification_metrics"] = lambda s, f: E.classification_metrics(scorecard_scores(_test(s, f)))
    Q["confusion_matrix"] = lambda s, f: E.confusion_matrix(scorecard_scores(_test(s, f)))
    return Q


#: Exactly a quarter of the quotes, rounded up: those with the smallest hashes.
SPLIT = """coalesce(md5(CAST(quote_id AS VARCHAR) || ':42') <= (
  SELECT max(h) FROM (SELECT DISTINCT md5(CAST(quote_id AS VARCHAR) || ':42') AS h FROM clean WHERE quote_id IS NOT NULL
                      ORDER BY h LIMIT (SELECT CAST(ceil(0.25 * count(DISTINCT quote_id)) AS BIGINT) FROM clean))), false)"""
TRAIN = f""",
tr AS (SELECT * FROM clean WHERE NOT ({SPLIT}))"""
SCORECARD_SQL = (f"round(1 / (1 + exp(-(1 - 4 * gross_margin_rate - {d(0.02)} * coalesce(price_gap_min_competitor_pct, 20) "
                 f"+ {d(0.01)} * coalesce(kw, {d(12.5)})))), 9)")


def test_ctes(score: str) -> str:
    """Holdout scores, threshold counts and curve counts for a score expression."""
    return f""",
te AS (
  SELECT is_win AS label, {score} AS score
  FROM clean WHERE {SPLIT}
),
tc AS (
  SELECT sum(CASE WHEN label = 1 AND score >= {d(0.5)} THEN 1 ELSE 0 END)::DOUBLE AS tp,
         sum(CASE WHEN label <> 1 AND score >= {d(0.5)} THEN 1 ELSE 0 END)::DOUBLE AS fp,
         sum(CASE WHEN label <> 1 AND score < {d(0.5)} THEN 1 ELSE 0 END)::DOUBLE AS tn,
         sum(CASE WHEN label = 1 AND score < {d(0.5)} THEN 1 ELSE 0 END)::DOUBLE AS fn
  FROM te
),
sc AS (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM te GROUP BY score),
cu AS (
  SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above,
            coalesce(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_above
  FROM sc
)"""


TEST, TEST_FIXED = test_ctes(SCORECARD_SQL), test_ctes(f"round({probability_sql()}, 9)")
AUC_SQL = "round(sum(neg * (pos_above + pos * 0.5)) / (sum(pos) * sum(neg)), 6) AS roc_auc"
AP_SQL = ("round(sum(CASE WHEN pos > 0 THEN pos * (pos_above + pos) / (pos_above + pos + neg_above + neg) END) "
          "/ sum(pos), 6) AS average_precision")
RATES_SQL = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_win,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_win,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_win"""
CONFUSION_SQL = """
SELECT 'Actual Loss' AS actual, 'Predicted Loss' AS predicted, CAST(tn AS BIGINT) AS n FROM tc
UNION ALL SELECT 'Actual Loss', 'Predicted Win', CAST(fp AS BIGINT) FROM tc
UNION ALL SELECT 'Actual Win', 'Predicted Loss', CAST(fn AS BIGINT) FROM tc
UNION ALL SELECT 'Actual Win', 'Predicted Win', CAST(tp AS BIGINT) FROM tc"""


def terms_sql(rows: str) -> str:
    """Every term a fit on ``rows`` has, as the query reports it at the optimum."""
    numeric = " UNION ALL ".join(f"SELECT 'num:{f}' AS term, true AS stationary WHERE EXISTS "
                                 f"(SELECT 1 FROM {rows} WHERE {f} IS NOT NULL)" for f in NUMERIC_FEATURES)
    return f"""
SELECT 'intercept' AS term, true AS stationary
UNION ALL {numeric}
UNION ALL SELECT DISTINCT 'product:' || product, true FROM {rows} WHERE product IS NOT NULL"""


def model_oracles():
    Q = {}
    Q["group_split"] = with_ctes("", f"SELECT quote_id, line_seq, {SPLIT} AS is_test FROM clean")
    Q["quote_weights"] = with_ctes(TRAIN, """
SELECT quote_id, line_seq, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY quote_id), 6) AS train_weight FROM tr""")
    Q["quote_weights_all"] = with_ctes("", """
SELECT quote_id, line_seq, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY quote_id), 6) AS all_weight FROM clean""")
    Q["class_weights"] = with_ctes(TRAIN, """
SELECT is_win, n_class, round(CAST(sum(n_class) OVER () AS DOUBLE) / (count(*) OVER () * n_class), 6) AS class_weight
FROM (SELECT is_win, count(*) AS n_class FROM tr GROUP BY is_win)""")
    med = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(median({f}), 6) AS median FROM tr"
                             for f in NUMERIC_FEATURES)
    Q["impute_numeric"] = with_ctes(TRAIN, med)
    Q["impute_product"] = with_ctes(TRAIN, """
SELECT product FROM tr WHERE product IS NOT NULL GROUP BY product ORDER BY count(*) DESC, product LIMIT 1""")
    std = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(m, 6) AS median, round(avg(coalesce(CAST({f} AS DOUBLE), m)), 6) AS mean, "
        f"round(stddev_pop(coalesce(CAST({f} AS DOUBLE), m)), 6) AS std "
        f"FROM tr, (SELECT median(CAST({f} AS DOUBLE)) AS m FROM tr) GROUP BY m"
        for f in NUMERIC_FEATURES)
    Q["standardize"] = with_ctes(TRAIN, std)
    Q["onehot_product"] = with_ctes(TRAIN + """,
md AS (SELECT product AS mode_product FROM tr WHERE product IS NOT NULL GROUP BY product
       ORDER BY count(*) DESC, product LIMIT 1),
lv AS (SELECT lvl, CAST(row_number() OVER (ORDER BY lvl) - 1 AS INTEGER) AS product_index
       FROM (SELECT DISTINCT coalesce(tr.product, md.mode_product) AS lvl FROM tr LEFT JOIN md ON TRUE))""", """
SELECT c.quote_id, c.line_seq, c.product, lv.product_index
FROM clean c LEFT JOIN md ON TRUE LEFT JOIN lv ON coalesce(c.product, md.mode_product) = lv.lvl""")
    Q["metric_roc_auc"] = with_ctes(TEST, f"SELECT {AUC_SQL} FROM cu")
    Q["metric_avg_precision"] = with_ctes(TEST, f"SELECT {AP_SQL} FROM cu")
    Q["classification_metrics"] = with_ctes(TEST, f"SELECT {RATES_SQL} FROM tc")
    Q["confusion_matrix"] = with_ctes(TEST, CONFUSION_SQL)
    Q["confusion_matrix_fixed_model"] = with_ctes(TEST_FIXED, CONFUSION_SQL)
    Q["model_metrics_fixed_model"] = with_ctes(TEST_FIXED, f"""
SELECT (SELECT {AUC_SQL} FROM cu) AS roc_auc, (SELECT {AP_SQL} FROM cu) AS average_precision, {RATES_SQL} FROM tc""")
    p = probability_sql()
    Q["predict_win_fixed_model"] = with_ctes("", f"""
SELECT quote_id, line_seq, is_win, round({p}, 6) AS win_probability, CAST({p} >= {d(0.5)} AS INTEGER) AS predicted_win
FROM clean WHERE {SPLIT}""")
    Q["win_model_stationary"] = with_ctes(TRAIN, terms_sql("tr"))
    Q["final_model_stationary"] = Q["stored_model_stationary"] = with_ctes("", terms_sql("clean"))
    Q["split_share"] = with_ctes("", """
SELECT count(DISTINCT quote_id) AS quotes, CAST(ceil(0.25 * count(DISTINCT quote_id)) AS BIGINT) AS test_quotes FROM clean""")
    return Q
