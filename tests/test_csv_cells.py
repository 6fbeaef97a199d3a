"""Cells of a CSV that mean a missing value."""

from quotelens.constants import CSV_NA_TOKENS
from quotelens.sources.readers import _without_na


def test_na_tokens_are_looked_up_in_a_set(spark):
    cells = spark.createDataFrame([(t,) for t in [*CSV_NA_TOKENS, " NA ", "1", None, "na na"]], "qty string")
    out = _without_na(cells)
    assert sorted(r.qty for r in out.where("qty IS NOT NULL").collect()) == ["1", "na na"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan
