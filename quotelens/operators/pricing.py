"""Scenario pricing over a table of requests.

The reference prices one hand-typed scenario at a time; here every function
takes a DataFrame of requests (any number of rows).  Everything is row-local:
the margin grid of a request is an array of expected gross profits only, one
double per margin (``expected_profits``); its best or top entries give the
margin, and price, probability and profit are computed from that margin once.
Nothing is grouped, so requests need no unique id, and the operators work on
streams as they are.  ``margin_curve`` lists all points as rows.

A margin of 95 % or more has no price (P3): its computed columns are NULL, or
an error is raised with ``strict``; the grid stops below it.

Request columns: quote_id, line_seq (the request id), product, kw, qty,
cost_per_unit, gross_margin_rate, energy_grant_amount, competitor_a/b/c,
minimum_margin, minimum_win_probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BOUND_MARGIN_RANGE,
    BOUND_MIN_COMPETITOR,
    BOUND_MIN_COST,
    BOUND_MIN_GRANT,
    BOUND_MIN_KW,
    BOUND_MIN_MARGIN_RANGE,
    BOUND_MIN_QTY,
    BOUND_THRESHOLD_RANGE,
    COMPARISON_ROWS,
    COMPETITOR_LABELS,
    DEFAULT_MARGIN,
    DEFAULT_MIN_MARGIN,
    DEFAULT_MIN_WIN_PROBABILITY,
    DEFAULT_QTY,
    FLAG_ABOVE_COMPETITOR,
    FLAG_BELOW_MINIMUM,
    FLAG_LOW_PROBABILITY,
    FLAG_NEGATIVE_MARGIN,
    FLAG_NO_BENCHMARK,
    FLAG_NONE,
    GRID_MAX_MARGIN,
    GRID_STEP,
    MAX_VALID_MARGIN,
    PROPOSED_PRICE_LABEL,
    SCENARIO_ERROR,
    TOP_SCENARIOS,
)
from ..functions.columns import (
    available_competitors,
    band_label,
    competitor_summary,
    fmt_currency,
    fmt_percent,
    fmt_signed_currency,
    gmr_band_ord,
    price_position_by_ratio,
    scenario_columns,
)
from ..plans.scorecard import WinScorer, prepared, sigmoid
from .keyed import exact_medians, first_per_key, lookup_join

REQUEST_KEYS = ["quote_id", "line_seq"]

REQUEST_TYPES = [
    ("quote_id", "bigint"), ("line_seq", "bigint"), ("product", "string"), ("kw", "double"),
    ("qty", "int"), ("cost_per_unit", "double"), ("gross_margin_rate", "double"),
    ("energy_grant_amount", "double"), ("competitor_a", "double"), ("competitor_b", "double"),
    ("competitor_c", "double"), ("minimum_margin", "double"), ("minimum_win_probability", "double"),
]


def conform_requests(df: DataFrame) -> DataFrame:
    """Typed request table: NaN -> NULL (T3); absent optional inputs -> NULL (prefill fills them)."""
    cols = []
    for name, typ in REQUEST_TYPES:
        c = F.col(name).cast(typ) if name in df.columns else F.lit(None).cast(typ)
        if typ == "double":
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(name))
    return df.select(*cols)


# ------------------------------------------------------------------ P1
def with_available_competitors(df: DataFrame) -> DataFrame:
    """The list of usable competitor prices and its summary."""
    arr = available_competitors("competitor_a", "competitor_b", "competitor_c")
    return df.withColumn("available_prices", arr)


# ------------------------------------------------------------------ P2
def valid_margin(gmr: Column, strict: bool = False) -> Column:
    """The margin where a price may be made of it (P3), else NULL or an error."""
    other = F.raise_error(F.lit(SCENARIO_ERROR)).cast("double") if strict else F.lit(None).cast("double")
    return F.when(margin_ok(gmr), gmr).otherwise(other)


def _scenario(df: DataFrame, gmr: Column) -> dict[str, Column]:
    return scenario_columns(F.col("cost_per_unit"), gmr, F.col("qty"), F.col("energy_grant_amount"),
                            F.col("competitor_a"), F.col("competitor_b"), F.col("competitor_c"))


def features_for(df: DataFrame, gmr: Column, sc: dict[str, Column]) -> dict[str, Column]:
    """The 13 model features of a scenario (for scoring)."""
    return {
        "product": F.col("product"),
        "kw": F.col("kw"),
        "qty": F.col("qty"),
        "unit_price": sc["unit_price"],
        "gross_margin_rate": gmr,
        "energy_grant_amount": F.col("energy_grant_amount"),
        "estimated_cost": sc["estimated_cost"],
        "grant_ratio_to_subtotal": sc["grant_ratio_to_subtotal"],
        "competitor_count_available": sc["competitor_count_available"],
        "avg_competitor_price": sc["avg_competitor_price"],
        "min_competitor_price": sc["min_competitor_price"],
        "price_gap_avg_competitor_pct": sc["price_gap_avg_competitor_pct"],
        "price_gap_min_competitor_pct": sc["price_gap_min_competitor_pct"],
    }


SCENARIO_OUTPUT = ["unit_price", "estimated_cost", "grant_ratio_to_subtotal",
                   "competitor_count_available", "avg_competitor_price", "min_competitor_price",
                   "price_gap_avg_competitor_pct", "price_gap_min_competitor_pct",
                   "subtotal_price", "gross_profit_amount"]


def price_scenarios(requests: DataFrame, keys: list[str] = REQUEST_KEYS, strict: bool = False) -> DataFrame:
    """Price each request at its own proposed margin."""
    sc = _scenario(requests, valid_margin(F.col("gross_margin_rate"), strict))
    return requests.select(*keys, "product", "kw", "qty", "cost_per_unit", "gross_margin_rate",
                           "energy_grant_amount", "competitor_a", "competitor_b", "competitor_c",
                           "minimum_margin", "minimum_win_probability",
                           *[sc[c].alias(c) for c in SCENARIO_OUTPUT])


# ------------------------------------------------------------------ P3 / P4
def margin_ok(gmr: Column) -> Column:
    """A scenario margin must be below 95 % (a missing margin passes, as in pandas)."""
    return ~F.coalesce(gmr >= MAX_VALID_MARGIN, F.lit(False))


def reject_bad_margin(requests: DataFrame, strict: bool = False,
                      keys: list[str] = REQUEST_KEYS) -> DataFrame:
    """Mark (or, strict, fail on) requests with margin >= 95 %."""
    ok = margin_ok(F.col("gross_margin_rate"))
    out = requests.select(*keys, "gross_margin_rate", ok.alias("margin_ok"),
                          F.when(~ok, F.lit(SCENARIO_ERROR)).alias("error_message"))
    if strict:
        out = out.withColumn("margin_ok", F.when(F.col("margin_ok"), F.lit(True))
                             .otherwise(F.raise_error(F.lit(SCENARIO_ERROR)).cast("boolean")))
    return out


# fixed order of validation rules (name, predicate on a request)
def _rules() -> list[tuple[str, Column]]:
    lo_m, hi_m = BOUND_MARGIN_RANGE
    lo_mm, hi_mm = BOUND_MIN_MARGIN_RANGE
    lo_t, hi_t = BOUND_THRESHOLD_RANGE
    comp_ok = [F.coalesce(F.col(c) >= BOUND_MIN_COMPETITOR, F.lit(True))
               for c in ("competitor_a", "competitor_b", "competitor_c")]
    return [
        ("kw", F.coalesce(F.col("kw") >= BOUND_MIN_KW, F.lit(False))),
        ("qty", F.coalesce(F.col("qty") >= BOUND_MIN_QTY, F.lit(False))),
        ("cost_per_unit", F.coalesce(F.col("cost_per_unit") >= BOUND_MIN_COST, F.lit(False))),
        ("energy_grant_amount", F.coalesce(F.col("energy_grant_amount") >= BOUND_MIN_GRANT, F.lit(False))),
        ("competitors", comp_ok[0] & comp_ok[1] & comp_ok[2]),
        ("gross_margin_rate", F.coalesce(F.col("gross_margin_rate").between(lo_m, hi_m), F.lit(False))
         & margin_ok(F.col("gross_margin_rate"))),
        ("minimum_margin", F.coalesce(F.col("minimum_margin").between(lo_mm, hi_mm), F.lit(False))),
        ("minimum_win_probability",
         F.coalesce(F.col("minimum_win_probability").between(lo_t, hi_t), F.lit(False))),
    ]


def validate_requests(requests: DataFrame, keys: list[str] = REQUEST_KEYS) -> DataFrame:
    """Input-bound checks; failing rule names listed in fixed order."""
    rules = _rules()
    failed = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in rules])
    return requests.select(*keys, failed.alias("violations"),
                           (failed == "").alias("is_valid"))


# ------------------------------------------------------------------ P5 / P6
def product_defaults(clean: DataFrame) -> DataFrame:
    """P5: per-product medians used to prefill a request."""
    return exact_medians(clean.where(F.col("product").isNotNull()), ["product"], {
        "default_kw": "kw",
        "default_cost_per_unit": "estimated_cost_per_unit",
        "default_grant": "energy_grant_amount",
        "default_competitor_a": "competitor_a",
        "default_competitor_b": "competitor_b",
        "default_competitor_c": "competitor_c",
    })


def prefill_requests(requests: DataFrame, defaults: DataFrame) -> DataFrame:
    """Fill missing request inputs from product defaults and form defaults.

    Competitors are used by default only when the product has a median for A;
    then a missing competitor becomes 0 (= unavailable).  ``defaults`` has one
    row per product, so the join never multiplies rows.
    """
    use_comp = F.col("default_competitor_a").isNotNull()
    out = lookup_join(requests, defaults, ["product"])
    cols = {
        "kw": F.coalesce(F.col("kw"), F.col("default_kw")),
        "qty": F.coalesce(F.col("qty"), F.lit(DEFAULT_QTY)),
        "cost_per_unit": F.coalesce(F.col("cost_per_unit"), F.bround(F.col("default_cost_per_unit"), 2)),
        "gross_margin_rate": F.coalesce(F.col("gross_margin_rate"), F.lit(DEFAULT_MARGIN)),
        "energy_grant_amount": F.coalesce(F.col("energy_grant_amount"), F.bround(F.col("default_grant"), 2)),
        "minimum_margin": F.coalesce(F.col("minimum_margin"), F.lit(DEFAULT_MIN_MARGIN)),
        "minimum_win_probability": F.coalesce(F.col("minimum_win_probability"),
                                              F.lit(DEFAULT_MIN_WIN_PROBABILITY)),
    }
    for x in ("a", "b", "c"):
        cols[f"competitor_{x}"] = F.coalesce(
            F.col(f"competitor_{x}"),
            F.when(use_comp, F.coalesce(F.col(f"default_competitor_{x}"), F.lit(0.0))))
    return out.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in requests.columns])


# ------------------------------------------------------------------ P7
def _proposal(requests: DataFrame, scorer: WinScorer, strict: bool = False) -> tuple[dict[str, Column], Column]:
    """(scenario columns, win probability) of the proposed margin; NULL where P3 rejects it."""
    gmr = valid_margin(F.col("gross_margin_rate"), strict)
    sc = _scenario(requests, gmr)
    p = scorer.probability(features_for(requests, gmr, sc))
    return sc, F.when(margin_ok(F.col("gross_margin_rate")), p)


def score_scenarios(requests: DataFrame, scorer: WinScorer, keys: list[str] = REQUEST_KEYS,
                    strict: bool = False) -> DataFrame:
    """Probability, gross profit and expected gross profit of the proposed margin."""
    requests = prepared(requests, scorer)
    sc, p = _proposal(requests, scorer, strict)
    return requests.select(*keys, "product", "gross_margin_rate",
                           sc["unit_price"].alias("unit_price"),
                           p.alias("win_probability"),
                           sc["gross_profit_amount"].alias("gross_profit_amount"),
                           (p * sc["gross_profit_amount"]).alias("expected_gross_profit"))


# ------------------------------------------------------------------ P8-P10: the margin grid
def grid_size(max_margin: float = GRID_MAX_MARGIN, step: float = GRID_STEP) -> int:
    """Number of points of arange(0, max + 0.001, step) that P3 allows."""
    return sum(1 for i in range(int(math.ceil((max_margin + 0.001) / step))) if i * step < MAX_VALID_MARGIN)


GRID_FIELDS = ["grid_index", "gross_margin_rate", "unit_price", "win_probability",
               "gross_profit_if_won", "expected_gross_profit", "meets_minimum_margin"]


def _seed(requests: DataFrame, scorer: WinScorer) -> Column:
    """What a request's grid points share: competitor summary, total cost, the fixed part of the logit."""
    n_comp, avg_comp, min_comp = competitor_summary("competitor_a", "competitor_b", "competitor_c")
    inv = {
        "product": F.col("product"), "kw": F.col("kw"), "qty": F.col("qty"),
        "energy_grant_amount": F.col("energy_grant_amount"),
        "estimated_cost": F.col("cost_per_unit") * F.col("qty"),
        "competitor_count_available": n_comp,
        "avg_competitor_price": avg_comp,
        "min_competitor_price": min_comp,
    }
    fields = [v.alias(k) for k, v in inv.items()]
    fields += [F.col("cost_per_unit").alias("cost_per_unit"), F.col("minimum_margin").alias("minimum_margin")]
    if hasattr(scorer, "fixed_logit"):
        fields.append(scorer.fixed_logit(inv).alias("fixed"))
    return F.struct(*fields)


def _grid_terms(scorer: WinScorer) -> Column:
    """The scorer's logit over the grid as four numbers per request, from ``_seed``."""
    s = F.col("_seed")
    f = {k: s[k] for k in ("kw", "qty", "cost_per_unit", "energy_grant_amount", "avg_competitor_price", "min_competitor_price")}
    return F.struct(*[c.alias(n) for n, c in scorer.grid_terms(f, s["fixed"]).items()])


def _point(s: Column, index: Column, scorer: WinScorer, step: float) -> dict[str, Column]:
    """One grid point from the seed and its index."""
    g = index.cast("double") * F.lit(step)
    up = F.try_divide(s["cost_per_unit"], F.lit(1.0) - g)
    sub = up * s["qty"]
    avg_c, min_c = s["avg_competitor_price"], s["min_competitor_price"]
    f = {k: s[k] for k in ("product", "kw", "qty", "energy_grant_amount", "estimated_cost",
                           "competitor_count_available", "avg_competitor_price", "min_competitor_price")}
    f |= {"unit_price": up, "gross_margin_rate": g,
          "grant_ratio_to_subtotal": F.when(sub != 0, s["energy_grant_amount"] / sub),
          "price_gap_avg_competitor_pct": (up - avg_c) / avg_c * 100,
          "price_gap_min_competitor_pct": (up - min_c) / min_c * 100}
    p = sigmoid(scorer.varying_logit(f, s["fixed"])) if hasattr(scorer, "fixed_logit") else scorer.probability(f)
    gp = sub - s["estimated_cost"]
    return {"grid_index": index, "gross_margin_rate": g, "unit_price": up, "win_probability": p,
            "gross_profit_if_won": gp, "expected_gross_profit": p * gp,
            "meets_minimum_margin": g >= s["minimum_margin"]}


def with_expected_profits(requests: DataFrame, scorer: WinScorer, feasible_only: bool,
                          max_margin: float = GRID_MAX_MARGIN, step: float = GRID_STEP) -> DataFrame:
    """Add ``_seed`` and ``_profits``: the expected gross profit at each grid margin, NULL where infeasible.

    What the points share is computed once per request.  Prices are a first
    array; the lambda over them holds the few operations that depend on the
    margin if the scorer gives its ``grid_terms``, else the whole scenario.
    """
    points = grid_size(max_margin, step)
    seeded = prepared(requests, scorer).withColumn("_seed", _seed(requests, scorer))
    if hasattr(scorer, "grid_terms"):
        t, s = F.col("_terms"), F.col("_seed")
        margin = lambda i: i.cast("double") * F.lit(step)
        seeded = seeded.withColumn("_terms", _grid_terms(scorer)).withColumn("_prices", F.transform(
            F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.try_divide(s["cost_per_unit"], F.lit(1.0) - margin(i))))

        def profit(price: Column, i: Column) -> Column:
            logit = t["a"] + t["b"] * margin(i) + t["c"] * price + F.coalesce(F.try_divide(t["d"], price), F.lit(0.0))
            e = sigmoid(logit) * (price * s["qty"] - s["estimated_cost"])
            return F.when(margin(i) >= s["minimum_margin"], e) if feasible_only else e

        return seeded.withColumn("_profits", F.transform("_prices", profit)).drop("_terms", "_prices")

    def whole(s: Column, i: Column) -> Column:
        point = _point(s, i, scorer, step)
        e = point["expected_gross_profit"]
        return F.when(point["meets_minimum_margin"], e) if feasible_only else e

    return seeded.withColumn("_profits", F.transform(F.array_repeat("_seed", points), whole))


def _choose(points: int, step: float, k: int | None):
    """Arrow function of (a, b, c, d, cost, qty, total cost, minimum margin): per request the index of the best feasible
    grid point (``k`` None) or the indices of the ``k`` best points, of which equal ones go by their index."""
    margin = np.arange(points) * step

    def profits(a, b, c, d, cost, qty, total):
        price = cost[:, None] / (1.0 - margin)
        with np.errstate(all="ignore"):
            logit = a[:, None] + b[:, None] * margin + c[:, None] * price + np.where(price == 0, 0.0, np.nan_to_num(d)[:, None] / price)
            return 1.0 / (1.0 + np.exp(-logit)) * (price * qty[:, None] - total[:, None])

    def read(columns):
        missing = np.zeros(len(columns[0]), bool)
        for x in (*columns[:3], *columns[4:7]):
            missing |= x.is_null().to_numpy(zero_copy_only=False)
        numbers = [x.to_numpy(zero_copy_only=False).astype(float) for x in columns]
        return missing, numbers[7], profits(*numbers[:7])

    def best(*columns: pa.Array) -> pa.Array:
        missing, least, e = read(columns)
        feasible = margin >= least[:, None]   # a run up to the last point; nothing for a missing minimum
        start = points - feasible.sum(axis=1)
        # NaN is above all numbers here as in Spark's order
        at = np.maximum(np.where(feasible, e, -np.inf).argmax(axis=1), start)
        return pa.array(at.astype(np.int32), pa.int32(), mask=missing | (start == points))

    def first(*columns: pa.Array) -> pa.Array:
        missing, _, e = read(columns)
        e[missing] = 0.0
        lowest = np.isneginf(e).any(axis=1)
        order = np.argsort(-e[lowest], axis=1, kind="stable")
        for i, r in enumerate(e[lowest]):
            if np.isnan(r).any():
                order[i] = np.lexsort((-r, ~np.isnan(r)))
        # the best point k times: argmax gives the first of equal ones and takes NaN for the largest, as Spark does
        top, each = np.empty((len(e), min(k, points)), np.int32), np.arange(len(e))
        for j in range(top.shape[1]):
            top[:, j] = e.argmax(axis=1)
            e[each, top[:, j]] = -np.inf
        top[lowest] = order[:, :top.shape[1]]   # where -inf is a value, what is taken can't be marked by it
        return pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1, dtype=np.int32) * top.shape[1]),
                                        pa.array(top.ravel()))

    return F.arrow_udf(best, "int") if k is None else F.arrow_udf(first, "array<int>")


def with_choice(requests: DataFrame, scorer: WinScorer, k: int | None, max_margin: float, step: float) -> DataFrame:
    """Add ``_seed`` and ``_at``: the index of the best feasible grid point (``k`` None), or those of the ``k`` best points.

    With the scorer's ``grid_terms`` the whole grid of a batch of requests is one numpy array; only the indices
    come back, and the chosen points are computed from them.  Other scorers' grids are ``with_expected_profits``."""
    if not hasattr(scorer, "grid_terms"):
        grid = with_expected_profits(requests, scorer, k is None, max_margin, step)
        if k is None:
            return grid.withColumn("_at", F.array_position("_profits", F.array_max("_profits")).cast("int") - 1).drop("_profits")
        order = F.transform("_profits", lambda e, i: F.struct(e.alias("e"), F.negative(i).alias("i")))
        top = F.slice(F.sort_array(order, asc=False), 1, k)
        return grid.withColumn("_at", F.transform(top, lambda t: F.negative(t["i"]))).drop("_profits")
    s, t = F.col("_seed"), F.col("_terms")
    seeded = (prepared(requests, scorer).withColumn("_seed", _seed(requests, scorer)).withColumn("_terms", _grid_terms(scorer)))
    given = [t["a"], t["b"], t["c"], t["d"], s["cost_per_unit"], s["qty"], s["estimated_cost"], s["minimum_margin"]]
    chosen = _choose(grid_size(max_margin, step), step, k)(*[c.cast("double") for c in given])
    return seeded.withColumn("_at", chosen).drop("_terms")


def margin_curve(requests: DataFrame, scorer: WinScorer, keys: list[str] = REQUEST_KEYS,
                 max_margin: float = GRID_MAX_MARGIN, step: float = GRID_STEP) -> DataFrame:
    """Every grid point of every request as a row (71 per request by default)."""
    # two selects: the seed is computed below the explode, once per request
    base = prepared(requests, scorer).select("*", _seed(requests, scorer).alias("_seed")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(grid_size(max_margin, step) - 1))).alias("grid_index"))
    point = _point(F.col("_seed"), F.col("grid_index"), scorer, step)
    return base.select(*keys, *[point[f].alias(f) for f in GRID_FIELDS])


def with_best_point(requests: DataFrame, scorer: WinScorer, max_margin: float = GRID_MAX_MARGIN,
                    step: float = GRID_STEP) -> DataFrame:
    """Add ``_b``: the feasible grid point of the highest expected gross profit, the lowest margin
    among equals (T14); NULL fields without a feasible point."""
    found = with_choice(requests, scorer, None, max_margin, step)
    point = _point(F.col("_seed"), F.col("_at"), scorer, step)
    chosen = F.struct(*[F.when(F.col("_at").isNotNull(), point[f]).alias(f) for f in GRID_FIELDS])
    return found.withColumn("_b", chosen).drop("_seed", "_at")


def recommend_margin(requests: DataFrame, scorer: WinScorer, keys: list[str] = REQUEST_KEYS,
                     **grid_kw) -> DataFrame:
    """The recommended margin per request."""
    r = with_best_point(requests, scorer, **grid_kw)
    return r.select(*keys, "product",
                    F.col("_b.gross_margin_rate").alias("recommended_margin"),
                    F.col("_b.unit_price").alias("recommended_unit_price"),
                    F.col("_b.win_probability").alias("recommended_win_probability"),
                    F.col("_b.gross_profit_if_won").alias("recommended_gross_profit"),
                    F.col("_b.expected_gross_profit").alias("recommended_expected_gross_profit"))


def top_margin_scenarios(requests: DataFrame, scorer: WinScorer, k: int = TOP_SCENARIOS,
                         keys: list[str] = REQUEST_KEYS, max_margin: float = GRID_MAX_MARGIN,
                         step: float = GRID_STEP) -> DataFrame:
    """P10: top-k grid points by expected GP (feasible or not), ties -> lower margin."""
    grid = with_choice(requests, scorer, k, max_margin, step).withColumnRenamed("_at", "_top")
    rows = grid.select("*", F.posexplode("_top").alias("_pos", "_at")).withColumn("rank", F.col("_pos") + 1)
    point = _point(F.col("_seed"), F.col("_at"), scorer, step)
    return rows.select(*keys, "rank", *[point[f].alias(f) for f in GRID_FIELDS])


# ------------------------------------------------------------------ P11 / P12
def quote_comparison(requests: DataFrame, scorer: WinScorer, keys: list[str] = REQUEST_KEYS,
                     **grid_kw) -> DataFrame:
    """Proposed vs recommended, five deltas."""
    requests = prepared(requests, scorer)
    sc, p = _proposal(requests, scorer)
    proposed = {"margin": F.col("gross_margin_rate"), "unit_price": sc["unit_price"], "win_probability": p,
                "gross_profit": sc["gross_profit_amount"], "expected_gross_profit": p * sc["gross_profit_amount"]}
    fields = {"margin": "gross_margin_rate", "gross_profit": "gross_profit_if_won"}
    r = with_best_point(requests.withColumns({f"_p_{n}": c for n, c in proposed.items()}), scorer, **grid_kw)
    cols = [F.col(c) for c in keys]
    for name in proposed:
        best = F.col(f"_b.{fields.get(name, name)}")
        cols += [F.col(f"_p_{name}").alias(f"proposed_{name}"), best.alias(f"recommended_{name}"),
                 (best - F.col(f"_p_{name}")).alias(f"delta_{name}")]
    return r.select(*cols)


def _denoise(x: Column, eps: float = 1e-9) -> Column:
    """Float noise around zero (e.g. the proposed margin is the recommended one) reads as 0.

    A deviation: the reference formats the raw difference, which may show as -0.
    """
    return F.when(F.abs(x) < eps, F.lit(0.0)).otherwise(x)


def comparison_table(comparison: DataFrame, keys: list[str] = REQUEST_KEYS) -> DataFrame:
    """The long, formatted comparison table (5 rows per request)."""
    fmts = {
        "margin": (lambda c: fmt_percent(c, 0), lambda c: fmt_percent(c, 0, signed=True)),
        "unit_price": (fmt_currency, fmt_signed_currency),
        "win_probability": (lambda c: fmt_percent(c, 1), lambda c: fmt_percent(c, 1, signed=True)),
        "gross_profit": (fmt_currency, fmt_signed_currency),
        "expected_gross_profit": (fmt_currency, fmt_signed_currency),
    }
    rows = []
    for i, ((category, metric), name) in enumerate(zip(COMPARISON_ROWS, fmts)):
        plain, signed = fmts[name]
        rows.append(F.struct(F.lit(i + 1).alias("row_order"), F.lit(category).alias("category"),
                             F.lit(metric).alias("metric"),
                             plain(F.col(f"proposed_{name}")).alias("proposed_quote"),
                             plain(F.col(f"recommended_{name}")).alias("recommended_quote"),
                             signed(_denoise(F.col(f"delta_{name}"))).alias("difference")))
    return (comparison.select(*keys, F.explode(F.array(*rows)).alias("_r"))
            .select(*keys, "_r.*"))


# ------------------------------------------------------------------ P13
def benchmark_table(clean: DataFrame) -> DataFrame:
    """Historical (product, band) -> quotes and win rate, first line per quote in the subset."""
    first = first_per_key(clean.where(F.col("product").isNotNull() & F.col("band_ord").isNotNull()),
                          ["product", "band_ord", "quote_id"], ["line_seq"])
    return first.groupBy("product", "band_ord").agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_win").alias("historical_win_rate"))


def historical_benchmark(requests: DataFrame, clean: DataFrame, keys: list[str] = REQUEST_KEYS) -> DataFrame:
    """Attach the benchmark of the request's (product, band).

    The benchmark table has at most 8 rows per product.
    """
    bench = benchmark_table(clean)
    r = requests.select(*keys, "product", gmr_band_ord("gross_margin_rate").alias("band_ord"))
    out = lookup_join(r, bench, ["product", "band_ord"])
    return out.select(*keys, "product",
                      F.coalesce(band_label("band_ord"), F.lit("nan")).alias("band"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
                      "historical_win_rate")


# ------------------------------------------------------------------ P14
def classify_price_position(requests: DataFrame, keys: list[str] = REQUEST_KEYS) -> DataFrame:
    """Position of the proposed unit price against the cheapest competitor."""
    sc = _scenario(requests, valid_margin(F.col("gross_margin_rate")))
    return requests.select(*keys, sc["unit_price"].alias("unit_price"),
                           sc["min_competitor_price"].alias("min_competitor_price"),
                           price_position_by_ratio(sc["unit_price"], sc["min_competitor_price"])
                           .alias("price_position"))


# ------------------------------------------------------------------ P15
def _flag(t: tuple[str, str, str], explanation: Column | None = None) -> Column:
    sev, title, text = t
    return F.struct(F.lit(sev).alias("severity"), F.lit(title).alias("title"),
                    (explanation if explanation is not None else F.lit(text)).alias("explanation"))


def _template(text: str, value: Column) -> Column:
    before, after = text.split("{pct}")
    return F.concat(F.lit(before), value, F.lit(after))


def risk_flag_array(gmr: Column, p: Column, min_margin: Column, min_prob: Column,
                    n_comp: Column, gap_min: Column) -> Column:
    """Ordered review flags; 'Low' only when nothing else fires."""
    gap_txt = F.concat(F.format_string("%.1f", F.bround(gap_min, 1)), F.lit("%"))
    fires = lambda c: F.coalesce(c, F.lit(False))
    negative, below, unlikely = fires(gmr < 0), fires(gmr < min_margin), fires(p < min_prob)
    alone, above = fires(n_comp == 0), fires(gap_min > 5)
    nothing = F.array().cast("array<struct<severity:string,title:string,explanation:string>>")
    # parts put together rather than filtered: no lambda, so a row's flags are compiled
    return F.concat(
        F.when(negative, F.array(_flag(FLAG_NEGATIVE_MARGIN)))
        .when(below, F.array(_flag(FLAG_BELOW_MINIMUM, _template(FLAG_BELOW_MINIMUM[2], fmt_percent(min_margin, 0)))))
        .otherwise(nothing),
        F.when(unlikely, F.array(_flag(FLAG_LOW_PROBABILITY, _template(FLAG_LOW_PROBABILITY[2], fmt_percent(min_prob, 0)))))
        .otherwise(nothing),
        F.when(alone, F.array(_flag(FLAG_NO_BENCHMARK)))
        .when(above, F.array(_flag(FLAG_ABOVE_COMPETITOR, _template(FLAG_ABOVE_COMPETITOR[2], gap_txt))))
        .otherwise(nothing),
        F.when(negative | below | unlikely | alone | above, nothing).otherwise(F.array(_flag(FLAG_NONE))))


def risk_flags(requests: DataFrame, scorer: WinScorer, keys: list[str] = REQUEST_KEYS) -> DataFrame:
    """One row per (request, flag), in the reference's order."""
    gmr = F.col("gross_margin_rate")
    requests = prepared(requests, scorer)
    sc, p = _proposal(requests, scorer)
    # the numbers first, once per request: the flags read them several times
    numbers = requests.withColumns({"_p": p, "_n_comp": sc["competitor_count_available"],
                                    "_gap_min": sc["price_gap_min_competitor_pct"]})
    arr = risk_flag_array(gmr, F.col("_p"), F.col("minimum_margin"), F.col("minimum_win_probability"),
                          F.col("_n_comp"), F.col("_gap_min"))
    r = numbers.select(*keys, F.posexplode(arr).alias("_i", "_f"))
    return r.select(*keys, (F.col("_i") + 1).alias("flag_order"), "_f.severity", "_f.title",
                    "_f.explanation")


# ------------------------------------------------------------------ P16
def price_references(requests: DataFrame, keys: list[str] = REQUEST_KEYS) -> DataFrame:
    """Proposed unit price plus one row per available competitor (letters kept)."""
    sc = _scenario(requests, valid_margin(F.col("gross_margin_rate")))
    refs = F.array(
        F.struct(F.lit(0).alias("ref_order"), F.lit(PROPOSED_PRICE_LABEL).alias("price_reference"),
                 sc["unit_price"].alias("price")),
        *[F.struct(F.lit(i + 1).alias("ref_order"), F.lit(label).alias("price_reference"),
                   F.col(column).alias("price"))
          for i, (column, label) in enumerate(COMPETITOR_LABELS.items())])
    keep = F.filter(refs, lambda r: F.when(r["ref_order"] == 0, F.lit(True))
                    .otherwise(F.coalesce(r["price"] > 0, F.lit(False))))
    has_comp = F.size(available_competitors("competitor_a", "competitor_b", "competitor_c")) > 0
    r = requests.where(has_comp).select(*keys, F.explode(keep).alias("_r"))
    return r.select(*keys, "_r.ref_order", "_r.price_reference", "_r.price")


# ------------------------------------------------------------------ the recommender page as one table
def quote_review(requests: DataFrame, clean: DataFrame, scorer: WinScorer,
                 keys: list[str] = REQUEST_KEYS, **grid_kw) -> DataFrame:
    """Everything the recommender shows for a request, one row per request.

    Proposed vs recommended (P7, P9, P11), price position (P14), review flags
    (P15, titles in order) and the historical benchmark (P13).  All of it is
    row-local but the benchmark, which is one lookup join.
    """
    gmr = F.col("gross_margin_rate")
    requests = prepared(requests, scorer)
    sc, p = _proposal(requests, scorer)
    req = requests.withColumns({
        "proposed_margin": gmr, "proposed_unit_price": sc["unit_price"],
        "proposed_win_probability": p,
        "proposed_expected_gross_profit": p * sc["gross_profit_amount"],
        "_min_comp": sc["min_competitor_price"], "_n_comp": sc["competitor_count_available"],
        "_gap_min": sc["price_gap_min_competitor_pct"],
        "_mm": F.col("minimum_margin"), "_mp": F.col("minimum_win_probability"),
    })
    best = with_best_point(req, scorer, **grid_kw)
    flags = risk_flag_array(F.col("proposed_margin"), F.col("proposed_win_probability"), F.col("_mm"),
                            F.col("_mp"), F.col("_n_comp"), F.col("_gap_min"))
    row = best.withColumn("_flags", flags).select(
        *keys, "product", gmr_band_ord("proposed_margin").alias("band_ord"),
        "proposed_margin", "proposed_unit_price", "proposed_win_probability", "proposed_expected_gross_profit",
        F.col("_b.gross_margin_rate").alias("recommended_margin"),
        F.col("_b.unit_price").alias("recommended_unit_price"),
        F.col("_b.win_probability").alias("recommended_win_probability"),
        F.col("_b.expected_gross_profit").alias("recommended_expected_gross_profit"),
        price_position_by_ratio("proposed_unit_price", "_min_comp").alias("price_position"),
        F.size("_flags").alias("flag_count"),
        F.concat_ws("; ", F.col("_flags.title")).alias("flag_titles"))
    out = lookup_join(row, benchmark_table(clean), ["product", "band_ord"])
    return out.select(
        *keys, "product", F.coalesce(band_label("band_ord"), F.lit("nan")).alias("band"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("historical_n"),
        "historical_win_rate", "proposed_margin", "proposed_unit_price", "proposed_win_probability",
        "proposed_expected_gross_profit", "recommended_margin", "recommended_unit_price",
        "recommended_win_probability", "recommended_expected_gross_profit", "price_position",
        "flag_count", "flag_titles")
