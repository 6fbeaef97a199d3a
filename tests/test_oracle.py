"""Every registered query against its DuckDB oracle on the smallest fixture."""

import math
from collections import Counter

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

from quotelens.plans.oracle import all_oracles

ORACLES = all_oracles()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLES[name]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert sum(r1.values()) == sum(r2.values())
    assert r1 == r2


def test_every_query_has_oracle_or_is_model_based():
    from quotelens.plans.catalog import spark_queries
    no_oracle = set(spark_queries()) - set(ORACLES)
    assert no_oracle <= {"train_win_model", "train_final_model", "predict_win", "model_metrics",
                         "model_confusion_matrix", "recommend_margin_fitted"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 5473
    assert "recommended_margin" in df.columns
