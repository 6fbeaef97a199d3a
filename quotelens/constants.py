"""Fixed values that must equal the reference's for the same results.

Everything in this module is a fixed value (labels, thresholds, feature lists,
message texts), stated plainly and in its natural order.
"""

from __future__ import annotations

# --- fixed values: gross-margin bands (right-closed bins, en dash in labels) ---
# Upper edges of the bands; the last band is open ("> 60%").
BAND_UPPER_EDGES = [0.0, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60]
BAND_LABELS = ["< 0%", "0–10%", "10–20%", "20–30%", "30–40%", "40–50%", "50–60%", "> 60%"]

# --- fixed values: model features, in the reference's order ---
MODEL_FEATURES = [
    "product",
    "kw",
    "qty",
    "unit_price",
    "gross_margin_rate",
    "energy_grant_amount",
    "estimated_cost",
    "grant_ratio_to_subtotal",
    "competitor_count_available",
    "avg_competitor_price",
    "min_competitor_price",
    "price_gap_avg_competitor_pct",
    "price_gap_min_competitor_pct",
]
NUMERIC_FEATURES = [f for f in MODEL_FEATURES if f != "product"]
CATEGORICAL_FEATURES = ["product"]

# --- fixed values: price-position labels and their display order ---
POS_UNAVAILABLE = "Competitor information unavailable"
POS_BELOW = "Below competitor benchmark"
POS_ALIGNED = "Approximately aligned (±5%)"
POS_ABOVE = "Above competitor benchmark"
POSITION_ORDER = [POS_BELOW, POS_ALIGNED, POS_ABOVE]

# --- fixed values: lost-line review signals ---
SIG_ABOVE = "Above competitor benchmark"
SIG_HIGH_MARGIN = "High margin for product"
SIG_NO_INFO = "Competitor information unavailable"
SIG_OTHER = "Other factors not captured"

# --- fixed values: review flags (severity, title, explanation template) ---
FLAG_NEGATIVE_MARGIN = ("High", "Profitability risk",
                        "Negative margin: manager approval is required before submission.")
FLAG_BELOW_MINIMUM = ("Medium", "Margin review",
                      "Margin is below the selected minimum target of {pct}.")
FLAG_LOW_PROBABILITY = ("Medium", "Conversion risk",
                        "Estimated win probability is below the review threshold of {pct}.")
FLAG_NO_BENCHMARK = ("Medium", "Information gap",
                     "No competitor benchmark is available. Review with additional sales information.")
FLAG_ABOVE_COMPETITOR = ("High", "Competitor positioning risk",
                         "Quoted unit price is {pct} above the minimum available competitor benchmark.")
FLAG_NONE = ("Low", "No major rule-based warning",
             "The quotation does not trigger the current review rules.")

# --- fixed values: comparison table rows (category, metric) ---
COMPARISON_ROWS = [
    ("Pricing", "Gross Margin Rate"),
    ("Pricing", "Unit Price"),
    ("Probability", "Win Probability"),
    ("Profitability", "Gross Profit if Won"),
    ("Profitability", "Expected Gross Profit"),
]

# --- fixed values: thresholds and defaults of the reference ---
MAX_VALID_MARGIN = 0.95          # a scenario margin must be strictly below this
GRID_STEP = 0.01
GRID_MAX_MARGIN = 0.70
DEFAULT_QTY = 1
DEFAULT_MARGIN = 0.30
DEFAULT_MIN_MARGIN = 0.20
DEFAULT_MIN_WIN_PROBABILITY = 0.40
POSITION_TOLERANCE = 0.05         # ratio form (+-5 %)
POSITION_TOLERANCE_PCT = 5.0      # stored percent form (+-5, inclusive)
LOSS_MARGIN_FLOOR = 0.40
PRODUCT_MIN_QUOTES = 20
PRODUCT_POSITION_MIN_LINES = 10
TOP_SCENARIOS = 10
DECISION_THRESHOLD = 0.50
SPLIT_TEST_SIZE = 0.25
SPLIT_SEED = 42
LOGREG_C = 0.5
LOGREG_MAX_ITER = 1500

# --- fixed values: input bounds of the request form ---
BOUND_MIN_KW = 0.1
BOUND_MIN_QTY = 1
BOUND_MIN_COST = 1.0
BOUND_MIN_GRANT = 0.0
BOUND_MIN_COMPETITOR = 0.0
BOUND_MARGIN_RANGE = (-0.10, 0.80)
BOUND_MIN_MARGIN_RANGE = (0.0, 0.50)
BOUND_THRESHOLD_RANGE = (0.10, 0.80)

# --- fixed values: CSV tokens read as missing (pandas default NA set) ---
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                 "n/a", "nan", "null"]

# Texts of scenario pricing.
SCENARIO_ERROR = "Gross margin rate must be below 95%."
PROPOSED_PRICE_LABEL = "Proposed unit price"
COMPETITOR_LABELS = {
    "competitor_a": "Competitor A",
    "competitor_b": "Competitor B",
    "competitor_c": "Competitor C",
}

# Labels of the confusion matrix.
ACTUAL_LABELS = ("Actual Loss", "Actual Win")
PREDICTED_LABELS = ("Predicted Loss", "Predicted Win")
