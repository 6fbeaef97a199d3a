"""The grid's best points as arrays, flags without lambdas, and the fit's sums per task."""

import numpy as np
from pyspark.sql import functions as F

from quotelens.operators import model as M
from quotelens.operators import pricing as P
from quotelens.plans.fixed_model import FIXED_MODEL

COLUMNS = ", ".join(f"{n} {t}" for n, t in P.REQUEST_TYPES)


def odd_requests(spark):
    return spark.createDataFrame([
        (1, 1, "H11", 5.0, 3, 100.0, 0.3, 50.0, 120.0, None, 0.0, 0.2, 0.4),
        (2, 1, None, None, 0, 100.0, 0.3, None, None, None, None, 0.2, 0.4),      # no units: all profits are 0
        (3, 1, "none", 5.0, 2, None, 0.3, 50.0, 95.0, None, None, 0.2, 0.4),      # no cost: all profits are NULL
        (4, 1, "H21", 5.0, 2, 80.0, 0.1, 50.0, 95.0, 90.0, None, None, None),     # no minimum: nothing is feasible
        (5, 1, "H21", 5.0, 2, 80.0, -0.1, 0.0, 20.0, None, None, 0.9, 0.4)], COLUMNS)   # minimum beyond the grid


def test_chosen_points_are_those_of_the_curve(spark):
    reqs = odd_requests(spark)
    curve = {}
    for r in P.margin_curve(reqs, FIXED_MODEL).collect():
        curve.setdefault(r.quote_id, []).append(r)
    rank = lambda r: (r.expected_gross_profit is None, -(r.expected_gross_profit or 0.0), r.grid_index)
    top = {}
    frame = P.top_margin_scenarios(reqs, FIXED_MODEL)
    for r in sorted(frame.collect(), key=lambda r: (r.quote_id, r["rank"])):
        top.setdefault(r.quote_id, []).append(r.grid_index)
    best = {r.quote_id: r.recommended_margin for r in P.recommend_margin(reqs, FIXED_MODEL).collect()}
    for q, points in curve.items():
        assert top[q] == [r.grid_index for r in sorted(points, key=rank)[:10]]
        allowed = [r for r in points if r.meets_minimum_margin and r.expected_gross_profit is not None]
        assert best[q] == (min(allowed, key=rank).gross_margin_rate if allowed else None)
    assert "lambdafunction" not in frame._jdf.queryExecution().executedPlan().toString()


def test_flags_are_compiled_and_in_order(spark):
    frame = P.risk_flags(odd_requests(spark), FIXED_MODEL)
    assert "lambdafunction" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.quote_id, r.flag_order)):
        got.setdefault(r.quote_id, []).append(r.title)
    assert got[2][-1] == "Information gap" and all(got.values()) and set(got) == {1, 2, 3, 4, 5}


def test_a_task_of_the_fit_writes_one_dense_row(spark, monkeypatch):
    monkeypatch.setattr(M, "PRODUCTS_AT_ONCE", 2)   # sums are written before a task has seen all its products
    rng = np.random.default_rng(1)
    z, y = rng.standard_normal(300), rng.integers(0, 2, 300).astype(float)
    product = [None if i % 7 == 0 else "abcde"[i % 5] for i in range(300)]
    rows = spark.createDataFrame([(product[i], float(y[i]), 0.5, float(z[i])) for i in range(300)],
                                 "product string, y double, _w double, z_f double").repartition(3)
    levels = spark.createDataFrame([(p, i, 0.1 * i) for i, p in enumerate("abcde")], M.LEVELS)
    newton = M._Newton(rows, ["f"], "y", 1.0, 150.0)
    found = newton.sums(np.array([0.2, -0.3]), levels, 5)
    assert found.where("dense").count() == 3
    per_level, loss, g, a = newton.totals(found)[:4]
    known = np.array([0.0 if p is None else 0.1 * "abcde".index(p) for p in product])
    x = np.column_stack([np.ones(300), z])
    eta = known + x @ [0.2, -0.3]
    p = 1 / (1 + np.exp(-eta))
    assert np.allclose(g, x.T @ (0.5 * (p - y))) and np.allclose(a, x.T @ (x * (0.5 * p * (1 - p))[:, None]))
    assert np.isclose(loss, 0.5 * (np.logaddexp(0, eta) - y * eta).sum() + 0.5 * sum((0.1 * i) ** 2 for i in range(5)))
    of = {r["product"]: r for r in per_level.collect()}
    mine = np.array([q == "b" for q in product])
    assert set(of) == {None, *"abcde"} and of[None].coefficient is None and of["b"].coefficient == 0.1
    assert np.isclose(of["b"].r0, (0.5 * (p - y))[mine].sum()) and np.isclose(of["b"].s0_1, (0.5 * p * (1 - p) * z)[mine].sum())
    assert per_level.where(F.col("s0_0") <= 0).count() == 0


def test_ten_best_points_with_infinite_and_equal_profits(spark):
    """Scorers of extreme numbers: equal, NaN and infinite profits keep Spark's order, equal ones by their index."""
    rows = [(a, b, c, 0.0, cost, float(qty), cost * qty, 0.2)
            for a in (0.0, 800.0, -800.0) for b in (0.0, 5.0) for c in (0.0, -0.05) for cost in (0.0, 90.0, 1e308) for qty in (0, 3)]
    names = ["a", "b", "c", "d", "cost", "qty", "total", "least"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.top for r in df.select("id", P._choose(71, 0.01, 10)(*names).alias("top")).collect()}
    margin = np.arange(71) * 0.01
    for i, (a, b, c, _, cost, qty, total, _) in enumerate(rows):
        with np.errstate(all="ignore"):
            price = cost / (1.0 - margin)
            e = 1.0 / (1.0 + np.exp(-(a + b * margin + c * price))) * (price * qty - total)
        assert got[i] == sorted(range(71), key=lambda j: (not np.isnan(e[j]), 0.0 if np.isnan(e[j]) else -e[j], j))[:10]


def test_coefficients_sent_and_joined_give_the_same_sums(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(None if i % 11 == 0 else f"p{i % 17}", float(i % 2), 1.0 + i % 3, float(rng.standard_normal()))
                                  for i in range(500)], "product string, y double, _w double, z_f double").repartition(4)
    levels = spark.createDataFrame([(f"p{i}", i, 0.05 * i) for i in range(15)], M.LEVELS)   # two have no coefficient
    monkeypatch.setattr(M, "BLOCK_ROWS", 40)
    newton = M._Newton(rows, ["f"], "y", 1.0, 1000.0)
    assert newton.blocks.count() > 10   # a row holds many lines
    u, both = np.array([0.3, 0.7]), []
    for sent in (100, 3):
        monkeypatch.setattr(M, "PRODUCTS_SENT", sent)
        per_level, *numbers = newton.totals(newton.sums(u, levels, 15))
        both.append((sorted(map(tuple, per_level.collect()), key=str), numbers))
    (few, one), (many, two) = both
    assert [r[0] for r in few] == [r[0] for r in many] and len(few) == 18
    assert [r[1] for r in few] == [r[1] for r in many] and sum(r[1] is None for r in few) == 3
    assert np.allclose([r[2:] for r in few], [r[2:] for r in many])
    assert all(np.allclose(x, y) for x, y in zip(one, two))
