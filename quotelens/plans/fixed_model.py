"""A logistic model over all 13 features with fixed numbers.

It runs through the same ``FittedWinModel`` code as a fitted model, so that
pricing, prediction and review with a full model can be compared with an
independent SQL formulation.
"""

from __future__ import annotations

from ..operators.model import FittedWinModel, Preprocessing
from .oracle_base import d

# feature: (median, mean, scale, coefficient)
NUMBERS = {
    "kw": (12.5, 12.0, 7.0, 0.10),
    "qty": (25.0, 25.5, 14.0, -0.15),
    "unit_price": (1800.0, 1900.0, 600.0, -0.30),
    "gross_margin_rate": (0.3, 0.3, 0.23, -0.90),
    "energy_grant_amount": (250.0, 255.0, 140.0, 0.08),
    "estimated_cost": (35000.0, 36000.0, 21000.0, 0.05),
    "grant_ratio_to_subtotal": (0.008, 0.012, 0.02, 0.12),
    "competitor_count_available": (1.0, 1.2, 0.8, -0.10),
    "avg_competitor_price": (1900.0, 1910.0, 400.0, 0.20),
    "min_competitor_price": (1700.0, 1720.0, 400.0, 0.25),
    "price_gap_avg_competitor_pct": (10.0, 12.0, 40.0, -0.35),
    "price_gap_min_competitor_pct": (20.0, 22.0, 45.0, -0.45),
}
PRODUCTS = {"H11": 0.10, "H12": -0.20, "H21": 0.15, "H23": -0.05, "H32": 0.25, "H34": -0.10, "H45": 0.30, "H55": -0.15}
MOST_FREQUENT, INTERCEPT = "H11", 0.2

FIXED_MODEL = FittedWinModel(
    prep=Preprocessing({f: n[0] for f, n in NUMBERS.items()}, {f: n[1] for f, n in NUMBERS.items()},
                       {f: n[2] for f, n in NUMBERS.items()}, MOST_FREQUENT, list(NUMBERS)),
    numeric={f: n[3] for f, n in NUMBERS.items()}, intercept=INTERCEPT, levels=PRODUCTS)


def probability_sql(columns: dict[str, str] | None = None) -> str:
    """The model's probability in DuckDB SQL; ``columns`` renames features."""
    name = lambda f: (columns or {}).get(f, f)
    level = " ".join(f"WHEN '{k}' THEN {d(v)}" for k, v in PRODUCTS.items())
    z = [d(INTERCEPT), f"(CASE coalesce(product, '{MOST_FREQUENT}') {level} ELSE {d(0.0)} END)"]
    z += [f"{d(b)} * ((coalesce(CAST({name(f)} AS DOUBLE), {d(m)}) - {d(mean)}) / {d(s)})"
          for f, (m, mean, s, b) in NUMBERS.items()]
    return f"1 / (1 + exp(-({' + '.join(z)})))"
