"""DuckDB oracle SQL, one statement per registered query.

Each statement reads only the driver's raw tables (through the CTEs of
``oracle_base``) and re-derives the answer with plain SQL: windows, GROUP BY,
joins.  Column names and rounding (6 places on doubles) match the Spark side.
"""

from __future__ import annotations

from ..constants import (
    BAND_LABELS,
    FLAG_ABOVE_COMPETITOR,
    FLAG_BELOW_MINIMUM,
    FLAG_LOW_PROBABILITY,
    FLAG_NEGATIVE_MARGIN,
    FLAG_NO_BENCHMARK,
    FLAG_NONE,
    POS_ABOVE,
    POS_ALIGNED,
    POS_BELOW,
    POS_UNAVAILABLE,
    POSITION_ORDER,
    SIG_ABOVE,
    SIG_HIGH_MARGIN,
    SIG_NO_INFO,
    SIG_OTHER,
)
from .oracle_base import band_label_sql, band_ord_sql, d, r6, with_base, with_ctes

QUOTE_DOUBLES = {"kw", "unit_price", "gross_margin_rate", "energy_grant_amount", "estimated_cost",
                 "grant_ratio_to_subtotal", "avg_competitor_price", "min_competitor_price",
                 "price_gap_avg_competitor_pct", "price_gap_min_competitor_pct", "competitor_a",
                 "competitor_b", "competitor_c", "estimated_gross_profit"}
QUOTE_ORDER = ["quote_id", "line_seq", "product", "kw", "qty", "unit_price", "gross_margin_rate",
               "energy_grant_amount", "estimated_cost", "grant_ratio_to_subtotal",
               "competitor_count_available", "avg_competitor_price", "min_competitor_price",
               "price_gap_avg_competitor_pct", "price_gap_min_competitor_pct", "competitor_a",
               "competitor_b", "competitor_c", "convert_to_order", "estimated_gross_profit",
               "is_highest_price"]


def sel(cols, doubles=QUOTE_DOUBLES, prefix=""):
    return ", ".join(r6(prefix + c, c) if c in doubles else prefix + c for c in cols)


def band_values() -> str:
    rows = ", ".join(f"({i}, '{lbl}')" for i, lbl in enumerate(BAND_LABELS))
    return f"(VALUES {rows}) AS bands(band_ord, gmr_band)"


def position_values() -> str:
    rows = ", ".join(f"({i}, '{p}')" for i, p in enumerate(POSITION_ORDER))
    return f"(VALUES {rows}) AS positions(position_ord, price_position)"


SCORECARD_P = (f"1 / (1 + exp(-(1 - 4 * g - {d(0.02)} * coalesce(gap_min, 20) "
               f"+ {d(0.01)} * coalesce(kw, {d(12.5)}))))")


def scenario_ctes(source: str, g: str, name: str) -> str:
    """CTE chain pricing ``source`` rows at margin expression ``g``; final CTE is ``name``."""
    return f""",
{name}_0 AS (
  SELECT src.*, {g} AS g,
         CASE WHEN competitor_a > 0 THEN competitor_a END AS ca2,
         CASE WHEN competitor_b > 0 THEN competitor_b END AS cb2,
         CASE WHEN competitor_c > 0 THEN competitor_c END AS cc2
  FROM {source} src
),
{name}_1 AS (
  SELECT *, cost_per_unit / (1 - g) AS up, cost_per_unit * qty AS tc,
         (ca2 IS NOT NULL)::INTEGER + (cb2 IS NOT NULL)::INTEGER + (cc2 IS NOT NULL)::INTEGER AS n_c,
         least(ca2, cb2, cc2) AS mn
  FROM {name}_0
),
{name}_2 AS (
  SELECT *, up * qty AS sub,
         CASE WHEN n_c > 0 THEN (coalesce(ca2, 0) + coalesce(cb2, 0) + coalesce(cc2, 0)) / n_c END AS av
  FROM {name}_1
),
{name}_3 AS (
  SELECT *, (up - av) / av * 100 AS gap_avg, (up - mn) / mn * 100 AS gap_min, sub - tc AS gp,
         CASE WHEN sub <> 0 THEN energy_grant_amount / sub END AS grant_ratio
  FROM {name}_2
),
{name} AS (
  SELECT *, {SCORECARD_P} AS p
  FROM {name}_3
)"""


GRID_SOURCE = "(SELECT r.*, t.i AS i FROM requests r, generate_series(0, 70) AS t(i))"
GRID_G = f"i * {d(0.01)}"


def pct0(x: str) -> str:
    return f"printf('%.0f%%', {x} * 100)"


def pct1(x: str) -> str:
    return f"printf('%.1f%%', {x} * 100)"


def sign(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN '+' ELSE '' END)"


def cur(x: str) -> str:
    return f"coalesce(printf('%,.0f', {x}), 'N/A')"


def scur(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'N/A' ELSE {sign(x)} || printf('%,.0f', {x}) END)"


STRESS = f""",
stress AS (
  SELECT * FROM requests
  UNION ALL SELECT quote_id, -(line_seq * 10 + 1), product, kw, qty, cost_per_unit, {d(0.95)},
        energy_grant_amount, competitor_a, competitor_b, competitor_c, minimum_margin, minimum_win_probability
     FROM requests
  UNION ALL SELECT quote_id, -(line_seq * 10 + 2), product, kw, 0, cost_per_unit, gross_margin_rate,
        energy_grant_amount, competitor_a, competitor_b, competitor_c, minimum_margin, minimum_win_probability
     FROM requests
  UNION ALL SELECT quote_id, -(line_seq * 10 + 3), product, kw, qty, {d(0.5)}, gross_margin_rate,
        energy_grant_amount, competitor_a, competitor_b, competitor_c, minimum_margin, minimum_win_probability
     FROM requests
  UNION ALL SELECT quote_id, -(line_seq * 10 + 4), product, {d(0.05)}, qty, cost_per_unit, gross_margin_rate,
        energy_grant_amount, competitor_a, competitor_b, competitor_c, minimum_margin, minimum_win_probability
     FROM requests
)"""

MEDIANS = """,
dfl AS (
  SELECT product, median(kw) AS default_kw, median(estimated_cost_per_unit) AS default_cost_per_unit,
         median(energy_grant_amount) AS default_grant, median(competitor_a) AS default_competitor_a,
         median(competitor_b) AS default_competitor_b, median(competitor_c) AS default_competitor_c
  FROM clean WHERE product IS NOT NULL GROUP BY product
)"""

LOSS = f""",
med AS (SELECT product, median(gross_margin_rate) AS median_margin FROM clean
        WHERE product IS NOT NULL GROUP BY product),
loss AS (
  SELECT c.quote_id, c.line_seq, c.product, c.gross_margin_rate, c.price_gap_min_competitor_pct,
         c.competitor_count_available,
         CASE WHEN c.price_gap_min_competitor_pct IS NOT NULL AND c.price_gap_min_competitor_pct > 5 THEN '{SIG_ABOVE}'
              WHEN c.gross_margin_rate > greatest({d(0.4)}, coalesce(m.median_margin, {d(0.4)})) THEN '{SIG_HIGH_MARGIN}'
              WHEN c.competitor_count_available = 0 THEN '{SIG_NO_INFO}'
              ELSE '{SIG_OTHER}' END AS review_signal
  FROM clean c LEFT JOIN med m ON c.product = m.product
  WHERE c.is_win = 0
)"""

POSITION = f""",
ppl AS (
  SELECT *, CASE WHEN price_gap_min_competitor_pct < -5 THEN '{POS_BELOW}'
                 WHEN price_gap_min_competitor_pct BETWEEN -5 AND 5 THEN '{POS_ALIGNED}'
                 ELSE '{POS_ABOVE}' END AS price_position
  FROM clean WHERE min_competitor_price IS NOT NULL
)"""

SWEET = f""",
ss_all AS (
  SELECT 'All products' AS selection, b.band_ord, b.gmr_band,
         CAST(coalesce(a.quotations, 0) AS BIGINT) AS quotations, a.historical_win_rate,
         a.average_gross_profit, a.historical_win_rate * a.average_gross_profit AS expected_gp_proxy
  FROM {band_values()}
  LEFT JOIN (SELECT band_ord, count(quote_id) AS quotations, avg(is_win) AS historical_win_rate,
                    avg(estimated_gross_profit) AS average_gross_profit
             FROM qh WHERE band_ord IS NOT NULL GROUP BY band_ord) a ON a.band_ord = b.band_ord
),
ss_prod AS (
  SELECT CAST(pr.product AS VARCHAR) AS selection, b.band_ord, b.gmr_band,
         CAST(coalesce(a.quotations, 0) AS BIGINT) AS quotations, a.historical_win_rate,
         a.average_gross_profit, a.historical_win_rate * a.average_gross_profit AS expected_gp_proxy
  FROM (SELECT DISTINCT product FROM qph) pr
  CROSS JOIN {band_values()}
  LEFT JOIN (SELECT product, band_ord, count(quote_id) AS quotations, avg(is_win) AS historical_win_rate,
                    avg(estimated_gross_profit) AS average_gross_profit
             FROM qph WHERE band_ord IS NOT NULL GROUP BY product, band_ord) a
    ON a.product = pr.product AND a.band_ord = b.band_ord
)"""

SWEET_SEL = ("selection, band_ord, gmr_band, quotations, round(historical_win_rate, 6) AS historical_win_rate, "
             "round(average_gross_profit, 6) AS average_gross_profit, "
             "round(expected_gp_proxy, 6) AS expected_gp_proxy")

SCEN_OUT = ["unit_price", "estimated_cost", "grant_ratio_to_subtotal", "competitor_count_available",
            "avg_competitor_price", "min_competitor_price", "price_gap_avg_competitor_pct",
            "price_gap_min_competitor_pct", "subtotal_price", "gross_profit_amount"]


def _scenario_select() -> str:
    return ("quote_id, line_seq, product, round(kw, 6) AS kw, qty, round(cost_per_unit, 6) AS cost_per_unit, "
            "round(gross_margin_rate, 6) AS gross_margin_rate, "
            "round(energy_grant_amount, 6) AS energy_grant_amount, round(competitor_a, 6) AS competitor_a, "
            "round(competitor_b, 6) AS competitor_b, round(competitor_c, 6) AS competitor_c, "
            "round(minimum_margin, 6) AS minimum_margin, "
            "round(minimum_win_probability, 6) AS minimum_win_probability, "
            "round(up, 6) AS unit_price, round(tc, 6) AS estimated_cost, "
            "round(grant_ratio, 6) AS grant_ratio_to_subtotal, "
            "CAST(n_c AS INTEGER) AS competitor_count_available, round(av, 6) AS avg_competitor_price, "
            "round(mn, 6) AS min_competitor_price, round(gap_avg, 6) AS price_gap_avg_competitor_pct, "
            "round(gap_min, 6) AS price_gap_min_competitor_pct, round(sub, 6) AS subtotal_price, "
            "round(gp, 6) AS gross_profit_amount")


GRID_SEL = ("CAST(i AS INTEGER) AS grid_index, round(g, 6) AS gross_margin_rate, round(up, 6) AS unit_price, "
            "round(p, 6) AS win_probability, round(gp, 6) AS gross_profit_if_won, "
            "round(p * gp, 6) AS expected_gross_profit, g >= minimum_margin AS meets_minimum_margin")

BEST = f"""{scenario_ctes(GRID_SOURCE, GRID_G, 'gs')}{scenario_ctes('requests', 'gross_margin_rate', 'ps')},
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY quote_id, line_seq
                                 ORDER BY p * gp DESC NULLS LAST, i ASC) AS rk
    FROM gs WHERE g >= minimum_margin) WHERE rk = 1
),
cmp AS (
  SELECT ps.quote_id, ps.line_seq,
         ps.g AS proposed_margin, b.g AS recommended_margin, b.g - ps.g AS delta_margin,
         ps.up AS proposed_unit_price, b.up AS recommended_unit_price, b.up - ps.up AS delta_unit_price,
         ps.p AS proposed_win_probability, b.p AS recommended_win_probability,
         b.p - ps.p AS delta_win_probability,
         ps.gp AS proposed_gross_profit, b.gp AS recommended_gross_profit, b.gp - ps.gp AS delta_gross_profit,
         ps.p * ps.gp AS proposed_expected_gross_profit, b.p * b.gp AS recommended_expected_gross_profit,
         b.p * b.gp - ps.p * ps.gp AS delta_expected_gross_profit
  FROM ps JOIN best b ON ps.quote_id = b.quote_id AND ps.line_seq = b.line_seq
)"""


def _flags_sql() -> str:
    s1 = f"""SELECT quote_id, line_seq, 1 AS slot,
       CASE WHEN g < 0 THEN '{FLAG_NEGATIVE_MARGIN[0]}' WHEN g < minimum_margin THEN '{FLAG_BELOW_MINIMUM[0]}' END AS severity,
       CASE WHEN g < 0 THEN '{FLAG_NEGATIVE_MARGIN[1]}' WHEN g < minimum_margin THEN '{FLAG_BELOW_MINIMUM[1]}' END AS title,
       CASE WHEN g < 0 THEN '{FLAG_NEGATIVE_MARGIN[2]}'
            WHEN g < minimum_margin THEN '{FLAG_BELOW_MINIMUM[2].split("{pct}")[0]}' || {pct0('minimum_margin')} || '{FLAG_BELOW_MINIMUM[2].split("{pct}")[1]}'
       END AS explanation
  FROM ps"""
    s2 = f"""SELECT quote_id, line_seq, 2 AS slot,
       CASE WHEN p < minimum_win_probability THEN '{FLAG_LOW_PROBABILITY[0]}' END,
       CASE WHEN p < minimum_win_probability THEN '{FLAG_LOW_PROBABILITY[1]}' END,
       CASE WHEN p < minimum_win_probability THEN '{FLAG_LOW_PROBABILITY[2].split("{pct}")[0]}' || {pct0('minimum_win_probability')} || '{FLAG_LOW_PROBABILITY[2].split("{pct}")[1]}' END
  FROM ps"""
    above = FLAG_ABOVE_COMPETITOR[2].split("{pct}")
    s3 = f"""SELECT quote_id, line_seq, 3 AS slot,
       CASE WHEN n_c = 0 THEN '{FLAG_NO_BENCHMARK[0]}' WHEN gap_min IS NOT NULL AND gap_min > 5 THEN '{FLAG_ABOVE_COMPETITOR[0]}' END,
       CASE WHEN n_c = 0 THEN '{FLAG_NO_BENCHMARK[1]}' WHEN gap_min IS NOT NULL AND gap_min > 5 THEN '{FLAG_ABOVE_COMPETITOR[1]}' END,
       CASE WHEN n_c = 0 THEN '{FLAG_NO_BENCHMARK[2]}'
            WHEN gap_min IS NOT NULL AND gap_min > 5 THEN '{above[0]}' || printf('%.1f', gap_min) || '%{above[1]}' END
  FROM ps"""
    return with_ctes(f"""{scenario_ctes('requests', 'gross_margin_rate', 'ps')},
fl AS ({s1} UNION ALL {s2} UNION ALL {s3}),
fl2 AS (SELECT *, row_number() OVER (PARTITION BY quote_id, line_seq ORDER BY slot) AS flag_order
        FROM fl WHERE severity IS NOT NULL)""", f"""
SELECT quote_id, line_seq, CAST(flag_order AS INTEGER) AS flag_order, severity, title, explanation FROM fl2
UNION ALL
SELECT quote_id, line_seq, 1, '{FLAG_NONE[0]}', '{FLAG_NONE[1]}', '{FLAG_NONE[2]}'
FROM ps WHERE NOT EXISTS (SELECT 1 FROM fl2 WHERE fl2.quote_id = ps.quote_id AND fl2.line_seq = ps.line_seq)""")


def _quote_review_sql() -> str:
    """Recommendation, position, flags (titles in order) and benchmark per request."""
    flags = _flags_sql()
    body = flags[flags.index("\nSELECT quote_id, line_seq, CAST(flag_order"):]
    flag_ctes = flags[len("WITH "):flags.index(body)]
    # reuse the flag CTE chain (it already prices the proposal as ps) and add the rest
    return "WITH " + flag_ctes + f"""{scenario_ctes(GRID_SOURCE, GRID_G, 'gs')},
allflags AS ({body}),
ft AS (SELECT quote_id, line_seq, CAST(count(*) AS INTEGER) AS flag_count,
              string_agg(title, '; ' ORDER BY flag_order) AS flag_titles
       FROM allflags GROUP BY quote_id, line_seq),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY quote_id, line_seq ORDER BY p * gp DESC NULLS LAST, i ASC) AS rk
    FROM gs WHERE g >= minimum_margin) WHERE rk = 1
),
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, band_ord, quote_id ORDER BY line_seq) AS rnb
                      FROM clean WHERE product IS NOT NULL AND band_ord IS NOT NULL) WHERE rnb = 1),
bt AS (SELECT product, band_ord, count(*) AS n, avg(is_win) AS wr FROM fb GROUP BY product, band_ord)
SELECT ps.quote_id, ps.line_seq, ps.product,
       coalesce({band_label_sql(band_ord_sql('ps.g'))}, 'nan') AS band,
       CAST(coalesce(bt.n, 0) AS BIGINT) AS historical_n, round(bt.wr, 6) AS historical_win_rate,
       round(ps.g, 6) AS proposed_margin, round(ps.up, 6) AS proposed_unit_price,
       round(ps.p, 6) AS proposed_win_probability, round(ps.p * ps.gp, 6) AS proposed_expected_gross_profit,
       round(b.g, 6) AS recommended_margin, round(b.up, 6) AS recommended_unit_price,
       round(b.p, 6) AS recommended_win_probability, round(b.p * b.gp, 6) AS recommended_expected_gross_profit,
       CASE WHEN ps.mn IS NULL THEN '{POS_UNAVAILABLE}'
            WHEN (ps.up - ps.mn) / ps.mn < {d(-0.05)} THEN '{POS_BELOW}'
            WHEN (ps.up - ps.mn) / ps.mn <= {d(0.05)} THEN '{POS_ALIGNED}'
            ELSE '{POS_ABOVE}' END AS price_position,
       ft.flag_count, ft.flag_titles
FROM ps
JOIN best b ON ps.quote_id = b.quote_id AND ps.line_seq = b.line_seq
JOIN ft ON ps.quote_id = ft.quote_id AND ps.line_seq = ft.line_seq
LEFT JOIN bt ON ps.product = bt.product AND {band_ord_sql('ps.g')} = bt.band_ord"""


def _comparison_table_sql() -> str:
    rows = [
        (1, "Pricing", "Gross Margin Rate", pct0("proposed_margin"), pct0("recommended_margin"),
         sign("delta_margin") + " || " + pct0("delta_margin")),
        (2, "Pricing", "Unit Price", cur("proposed_unit_price"), cur("recommended_unit_price"),
         scur("delta_unit_price")),
        (3, "Probability", "Win Probability", pct1("proposed_win_probability"),
         pct1("recommended_win_probability"),
         sign("delta_win_probability") + " || " + pct1("delta_win_probability")),
        (4, "Profitability", "Gross Profit if Won", cur("proposed_gross_profit"),
         cur("recommended_gross_profit"), scur("delta_gross_profit")),
        (5, "Profitability", "Expected Gross Profit", cur("proposed_expected_gross_profit"),
         cur("recommended_expected_gross_profit"), scur("delta_expected_gross_profit")),
    ]
    for n in ("margin", "unit_price", "win_probability", "gross_profit", "expected_gross_profit"):
        rows = [tuple(x.replace(f"delta_{n}", f"(CASE WHEN abs(delta_{n}) < 1e-9 THEN CAST(0 AS DOUBLE) ELSE delta_{n} END)")
                      if isinstance(x, str) else x for x in r) for r in rows]
    parts = [f"SELECT quote_id, line_seq, {i} AS row_order, '{c}' AS category, '{m}' AS metric, "
             f"{a} AS proposed_quote, {b} AS recommended_quote, {x} AS difference FROM cmp"
             for i, c, m, a, b, x in rows]
    return with_ctes(BEST, "\n" + "\nUNION ALL\n".join(parts))


def oracle_queries() -> dict[str, str]:
    Q: dict[str, str] = {}
    allq = QUOTE_ORDER
    Q["scan_quotes"] = with_base(f"SELECT {sel(allq)} FROM quotes")
    Q["filter_positive_qty"] = with_base(f"SELECT {sel(allq)} FROM quotes WHERE qty > 0")
    Q["filter_highest_price"] = with_base(f"SELECT {sel(allq)} FROM quotes WHERE is_highest_price = 1")
    Q["mark_highest_price"] = with_base(
        "SELECT quote_id, line_seq, product, round(unit_price, 6) AS unit_price, is_highest_price, "
        "CASE WHEN unit_price = max(unit_price) OVER (PARTITION BY quote_id, product) THEN 1 ELSE 0 END "
        "AS is_highest_price_calc FROM quotes")
    Q["dedupe_rows"] = with_base(f"SELECT {sel(allq)} FROM dedup")
    business = [c for c in allq if c != "line_seq"]
    Q["clean_from_file"] = with_base(
        f"SELECT {sel(business)}, is_win, round(gmr_pct, 6) AS gmr_pct, band_ord, gmr_band, "
        "round(estimated_cost_per_unit, 6) AS estimated_cost_per_unit FROM clean")
    number = "TRY_CAST(v AS DOUBLE)"
    dirty = """,
dirty AS (
  SELECT quote_id, line_seq, product,
         CASE WHEN quote_id % 29 = 0 THEN 'two' WHEN quote_id % 31 = 0 THEN '2.5'
              WHEN quote_id % 37 = 0 THEN '99999999999' ELSE CAST(qty AS VARCHAR) END AS qty_text,
         CASE WHEN quote_id % 41 = 0 THEN '12,50' WHEN quote_id % 43 = 0 THEN NULL
              ELSE CAST(unit_price AS VARCHAR) END AS price_text,
         CASE WHEN quote_id % 47 = 0 THEN 'ask' ELSE CAST(competitor_a AS VARCHAR) END AS a_text
  FROM quotes
)"""
    Q["rejected_cells"] = with_ctes(dirty + """,
cells AS (
  SELECT quote_id, line_seq, 'qty' AS "column", qty_text AS v FROM dirty
  UNION ALL SELECT quote_id, line_seq, 'unit_price', price_text FROM dirty
  UNION ALL SELECT quote_id, line_seq, 'competitor_a', a_text FROM dirty
)""", f"""
SELECT CAST(quote_id AS VARCHAR) AS quote_id, line_seq, "column", v AS value,
       CASE WHEN {number} IS NULL THEN 'not a number' WHEN {number} > 2147483647 THEN 'out of range'
            ELSE 'not a whole number' END AS reason
FROM cells
WHERE v IS NOT NULL AND ({number} IS NULL OR "column" = 'qty' AND
      ({number} > 2147483647 OR {number} <> floor({number})))""")
    Q["checked_quotes"] = with_ctes(dirty, """
SELECT quote_id, line_seq, product,
       CASE WHEN TRY_CAST(qty_text AS DOUBLE) <= 2147483647
            THEN floor(TRY_CAST(qty_text AS DOUBLE)) END AS qty,
       round(TRY_CAST(price_text AS DOUBLE), 6) AS unit_price,
       round(TRY_CAST(a_text AS DOUBLE), 6) AS competitor_a
FROM dirty""")
    Q["derive_is_win"] = with_base("SELECT quote_id, line_seq, convert_to_order, is_win FROM clean")
    Q["derive_gmr_pct"] = with_base(
        "SELECT quote_id, line_seq, round(gross_margin_rate, 6) AS gross_margin_rate, "
        "round(gmr_pct, 6) AS gmr_pct FROM clean")
    Q["derive_gmr_band"] = with_base(
        "SELECT quote_id, line_seq, round(gross_margin_rate, 6) AS gross_margin_rate, band_ord, gmr_band "
        "FROM clean")
    Q["derive_unit_cost"] = with_base(
        "SELECT quote_id, line_seq, round(estimated_cost, 6) AS estimated_cost, qty, "
        "round(estimated_cost_per_unit, 6) AS estimated_cost_per_unit FROM clean")
    Q["flag_multi_product"] = with_base(
        "SELECT quote_id, line_seq, product, coalesce(min(product) OVER (PARTITION BY quote_id) <> "
        "max(product) OVER (PARTITION BY quote_id), false) AS multi_product_quote FROM clean")
    hdr = "quote_id, line_seq, product, round(gross_margin_rate, 6) AS gross_margin_rate, band_ord, is_win"
    Q["quote_header"] = with_base(f"SELECT {hdr} FROM qh")
    Q["quote_product_header"] = with_base(f"SELECT {hdr} FROM qph")
    Q["filter_lost_lines"] = with_base("SELECT quote_id, line_seq, product, is_win FROM clean WHERE is_win = 0")
    Q["filter_with_benchmark"] = with_base(
        "SELECT quote_id, line_seq, round(min_competitor_price, 6) AS min_competitor_price FROM clean "
        "WHERE min_competitor_price IS NOT NULL")
    Q["product_list"] = with_base("SELECT DISTINCT coalesce(CAST(product AS VARCHAR), 'nan') AS product FROM clean")

    Q["available_competitors"] = with_base("""
SELECT quote_id, line_seq, CAST(len(arr) AS INTEGER) AS n_available, round(arr[1], 6) AS price_1,
       round(arr[2], 6) AS price_2, round(arr[3], 6) AS price_3
FROM (SELECT quote_id, line_seq, list_filter([competitor_a, competitor_b, competitor_c], lambda x: x > 0) AS arr
      FROM clean)""")
    Q["price_scenarios"] = with_ctes(scenario_ctes("requests", "gross_margin_rate", "ps"),
                                     f"SELECT {_scenario_select()} FROM ps")
    Q["price_stress"] = with_ctes(STRESS + scenario_ctes("stress", "gross_margin_rate", "ps"), f"""
SELECT quote_id, line_seq, round(g, 6) AS gross_margin_rate, round(CASE WHEN g < {d(0.95)} THEN up END, 6) AS unit_price,
       round(CASE WHEN g < {d(0.95)} THEN p * gp END, 6) AS expected_gross_profit FROM ps""")
    Q["margin_limit"] = with_ctes(scenario_ctes(GRID_SOURCE.replace("(0, 70)", "(0, 105)"), GRID_G, "gs"), f"""
SELECT quote_id, line_seq, count(*) AS points, round(max(g), 6) AS highest_margin, round(min(up), 6) AS lowest_price
FROM gs WHERE g < {d(0.95)} GROUP BY quote_id, line_seq""")
    Q["reject_bad_margin"] = with_ctes(STRESS, """
SELECT quote_id, line_seq, round(gross_margin_rate, 6) AS gross_margin_rate,
       NOT coalesce(gross_margin_rate >= CAST(0.95 AS DOUBLE), false) AS margin_ok,
       CASE WHEN coalesce(gross_margin_rate >= CAST(0.95 AS DOUBLE), false)
            THEN 'Gross margin rate must be below 95%.' END AS error_message
FROM stress""")
    rules = [
        ("kw", f"coalesce(kw >= {d(0.1)}, false)"),
        ("qty", "coalesce(qty >= 1, false)"),
        ("cost_per_unit", f"coalesce(cost_per_unit >= {d(1.0)}, false)"),
        ("energy_grant_amount", f"coalesce(energy_grant_amount >= {d(0.0)}, false)"),
        ("competitors", "coalesce(competitor_a >= 0, true) AND coalesce(competitor_b >= 0, true) "
                        "AND coalesce(competitor_c >= 0, true)"),
        ("gross_margin_rate", f"coalesce(gross_margin_rate BETWEEN {d(-0.1)} AND {d(0.8)}, false) "
                              f"AND NOT coalesce(gross_margin_rate >= {d(0.95)}, false)"),
        ("minimum_margin", f"coalesce(minimum_margin BETWEEN {d(0.0)} AND {d(0.5)}, false)"),
        ("minimum_win_probability", f"coalesce(minimum_win_probability BETWEEN {d(0.1)} AND {d(0.8)}, false)"),
    ]
    viol = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({p}) THEN '{n}' END" for n, p in rules) + ")"
    Q["validate_requests"] = with_ctes(STRESS, f"""
SELECT quote_id, line_seq, violations, violations = '' AS is_valid
FROM (SELECT quote_id, line_seq, {viol} AS violations FROM stress)""")
    Q["product_defaults"] = with_ctes(MEDIANS, """
SELECT product, round(default_kw, 6) AS default_kw, round(default_cost_per_unit, 6) AS default_cost_per_unit,
       round(default_grant, 6) AS default_grant, round(default_competitor_a, 6) AS default_competitor_a,
       round(default_competitor_b, 6) AS default_competitor_b, round(default_competitor_c, 6) AS default_competitor_c
FROM dfl""")
    blank = lambda c: f"CASE WHEN quote_id % 7 = 0 THEN NULL ELSE {c} END AS {c}"
    comp = lambda x: (f"round(coalesce(sp.competitor_{x}, CASE WHEN dfl.default_competitor_a IS NOT NULL "
                      f"THEN coalesce(dfl.default_competitor_{x}, 0) END), 6) AS competitor_{x}")
    Q["prefill_requests"] = with_ctes(MEDIANS + f""",
sp AS (
  SELECT quote_id, line_seq, product, {blank('kw')}, qty, {blank('cost_per_unit')}, gross_margin_rate,
         {blank('energy_grant_amount')}, {blank('competitor_a')}, {blank('competitor_b')},
         {blank('competitor_c')}, minimum_margin, minimum_win_probability
  FROM requests
)""", f"""
SELECT sp.quote_id, sp.line_seq, sp.product, round(coalesce(sp.kw, dfl.default_kw), 6) AS kw,
       coalesce(sp.qty, 1) AS qty,
       round(coalesce(sp.cost_per_unit, round_even(dfl.default_cost_per_unit, 2)), 6) AS cost_per_unit,
       round(coalesce(sp.gross_margin_rate, {d(0.3)}), 6) AS gross_margin_rate,
       round(coalesce(sp.energy_grant_amount, round_even(dfl.default_grant, 2)), 6) AS energy_grant_amount,
       {comp('a')}, {comp('b')}, {comp('c')},
       round(coalesce(sp.minimum_margin, {d(0.2)}), 6) AS minimum_margin,
       round(coalesce(sp.minimum_win_probability, {d(0.4)}), 6) AS minimum_win_probability
FROM sp LEFT JOIN dfl ON sp.product = dfl.product""")
    Q["score_scenarios"] = with_ctes(scenario_ctes("requests", "gross_margin_rate", "ps"), """
SELECT quote_id, line_seq, product, round(g, 6) AS gross_margin_rate, round(up, 6) AS unit_price,
       round(p, 6) AS win_probability, round(gp, 6) AS gross_profit_amount,
       round(p * gp, 6) AS expected_gross_profit
FROM ps""")
    Q["margin_curve"] = with_ctes(scenario_ctes(GRID_SOURCE, GRID_G, "gs"),
                                  f"SELECT quote_id, line_seq, {GRID_SEL} FROM gs")
    Q["recommend_margin"] = with_ctes(BEST, """
SELECT b.quote_id, b.line_seq, b.product, round(b.g, 6) AS recommended_margin,
       round(b.up, 6) AS recommended_unit_price, round(b.p, 6) AS recommended_win_probability,
       round(b.gp, 6) AS recommended_gross_profit, round(b.p * b.gp, 6) AS recommended_expected_gross_profit
FROM best b""")
    Q["top_margin_scenarios"] = with_ctes(scenario_ctes(GRID_SOURCE, GRID_G, "gs"), f"""
SELECT quote_id, line_seq, CAST(rank AS INTEGER) AS rank, {GRID_SEL}
FROM (SELECT *, row_number() OVER (PARTITION BY quote_id, line_seq ORDER BY p * gp DESC NULLS LAST, i ASC) AS rank
      FROM gs) WHERE rank <= 10""")
    cmp_cols = []
    for n in ("margin", "unit_price", "win_probability", "gross_profit", "expected_gross_profit"):
        for k in ("proposed", "recommended", "delta"):
            cmp_cols.append(f"round({k}_{n}, 6) AS {k}_{n}")
    Q["quote_comparison"] = with_ctes(BEST, f"SELECT quote_id, line_seq, {', '.join(cmp_cols)} FROM cmp")
    Q["comparison_table"] = _comparison_table_sql()
    Q["historical_benchmark"] = with_ctes(f""",
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, band_ord, quote_id ORDER BY line_seq) AS rnb
                      FROM clean WHERE product IS NOT NULL AND band_ord IS NOT NULL) WHERE rnb = 1),
bt AS (SELECT product, band_ord, count(*) AS n, avg(is_win) AS wr FROM fb GROUP BY product, band_ord),
rq AS (SELECT quote_id, line_seq, product, {band_ord_sql('gross_margin_rate')} AS band_ord FROM requests)""", f"""
SELECT rq.quote_id, rq.line_seq, rq.product, coalesce({band_label_sql('rq.band_ord')}, 'nan') AS band,
       CAST(coalesce(bt.n, 0) AS BIGINT) AS n, round(bt.wr, 6) AS historical_win_rate
FROM rq LEFT JOIN bt ON rq.product = bt.product AND rq.band_ord = bt.band_ord""")
    Q["classify_price_position"] = with_ctes(scenario_ctes("requests", "gross_margin_rate", "ps"), f"""
SELECT quote_id, line_seq, round(up, 6) AS unit_price, round(mn, 6) AS min_competitor_price,
       CASE WHEN mn IS NULL THEN '{POS_UNAVAILABLE}'
            WHEN (up - mn) / mn < {d(-0.05)} THEN '{POS_BELOW}'
            WHEN (up - mn) / mn <= {d(0.05)} THEN '{POS_ALIGNED}'
            ELSE '{POS_ABOVE}' END AS price_position
FROM ps""")
    Q["risk_flags"] = _flags_sql()
    Q["quote_review"] = _quote_review_sql()
    Q["price_references"] = with_ctes(scenario_ctes("requests", "gross_margin_rate", "ps"), """
SELECT quote_id, line_seq, ref_order, price_reference, round(price, 6) AS price FROM (
  SELECT quote_id, line_seq, 0 AS ref_order, 'Proposed unit price' AS price_reference, up AS price FROM ps WHERE n_c > 0
  UNION ALL SELECT quote_id, line_seq, 1, 'Competitor A', competitor_a FROM ps WHERE n_c > 0 AND competitor_a > 0
  UNION ALL SELECT quote_id, line_seq, 2, 'Competitor B', competitor_b FROM ps WHERE n_c > 0 AND competitor_b > 0
  UNION ALL SELECT quote_id, line_seq, 3, 'Competitor C', competitor_c FROM ps WHERE n_c > 0 AND competitor_c > 0
)""")

    # --- reports
    Q["overview_kpis"] = with_base("""
SELECT (SELECT count(quote_id) FROM qh) AS historical_quotations,
       (SELECT count(DISTINCT product) FROM clean) AS product_categories,
       (SELECT round(avg(is_win), 6) FROM qh) AS historical_win_rate,
       (SELECT round(avg(CASE WHEN competitor_count_available > 0 THEN 1 ELSE 0 END), 6) FROM clean)
           AS competitor_info_share""")
    Q["win_rate_by_band"] = with_base(f"""
SELECT b.band_ord, b.gmr_band, CAST(coalesce(a.quotations, 0) AS BIGINT) AS quotations,
       round(a.win_rate, 6) AS win_rate
FROM {band_values()}
LEFT JOIN (SELECT band_ord, count(quote_id) AS quotations, avg(is_win) AS win_rate
           FROM qh WHERE band_ord IS NOT NULL GROUP BY band_ord) a ON a.band_ord = b.band_ord""".replace(
        "AS bands(", "AS b("))
    Q["product_win_rate"] = with_base("""
SELECT product, count(quote_id) AS observations, round(avg(is_win), 6) AS win_rate
FROM qph GROUP BY product HAVING count(quote_id) >= 20""")
    Q["product_median_margin"] = with_base("""
SELECT product, round(median(gross_margin_rate), 6) AS median_margin FROM clean
WHERE product IS NOT NULL GROUP BY product""")
    Q["loss_signals"] = with_ctes(LOSS, """
SELECT quote_id, line_seq, product, round(gross_margin_rate, 6) AS gross_margin_rate,
       round(price_gap_min_competitor_pct, 6) AS price_gap_min_competitor_pct,
       competitor_count_available, review_signal FROM loss""")
    Q["loss_signal_summary"] = with_ctes(LOSS, """
SELECT review_signal, count(*) AS failed_lines FROM loss GROUP BY review_signal""")
    sweet_all = SWEET.replace("AS bands(", "AS b(")
    Q["sweet_spot_all"] = with_ctes(sweet_all, f"SELECT {SWEET_SEL} FROM ss_all")
    Q["sweet_spot_by_product"] = with_ctes(sweet_all, f"SELECT {SWEET_SEL} FROM ss_prod")
    Q["sweet_spot"] = with_ctes(sweet_all, f"SELECT {SWEET_SEL} FROM ss_all UNION ALL SELECT {SWEET_SEL} FROM ss_prod")
    Q["best_bands"] = with_ctes(sweet_all + """,
ss AS (SELECT * FROM ss_all UNION ALL SELECT * FROM ss_prod),
f AS (SELECT * FROM ss WHERE historical_win_rate IS NOT NULL AND expected_gp_proxy IS NOT NULL),
bw AS (SELECT selection, gmr_band AS best_win_rate_band, historical_win_rate AS best_win_rate
       FROM (SELECT *, row_number() OVER (PARTITION BY selection ORDER BY historical_win_rate DESC, band_ord) AS rn
             FROM f) WHERE rn = 1),
bp AS (SELECT selection, gmr_band AS best_proxy_band, expected_gp_proxy AS best_proxy
       FROM (SELECT *, row_number() OVER (PARTITION BY selection ORDER BY expected_gp_proxy DESC, band_ord) AS rn
             FROM f) WHERE rn = 1),
cnt AS (SELECT 'All products' AS selection, count(quote_id) AS quotations FROM qh
        UNION ALL SELECT CAST(product AS VARCHAR), count(quote_id) FROM qph GROUP BY product)""", """
SELECT bw.selection, best_win_rate_band, round(best_win_rate, 6) AS best_win_rate, best_proxy_band,
       round(best_proxy, 6) AS best_proxy, cnt.quotations
FROM bw JOIN bp ON bw.selection = bp.selection LEFT JOIN cnt ON bw.selection = cnt.selection""")
    Q["price_position_lines"] = with_ctes(POSITION, """
SELECT quote_id, line_seq, product, round(price_gap_min_competitor_pct, 6) AS price_gap_min_competitor_pct,
       is_win, price_position FROM ppl""")
    Q["price_position_summary"] = with_ctes(POSITION, f"""
SELECT pos.position_ord, pos.price_position, a.product_lines, round(a.historical_win_rate, 6) AS historical_win_rate
FROM {position_values().replace('AS positions(', 'AS pos(')}
LEFT JOIN (SELECT price_position, count(*) AS product_lines, avg(is_win) AS historical_win_rate
           FROM ppl GROUP BY price_position) a ON a.price_position = pos.price_position""")
    Q["competitor_availability"] = with_base("""
SELECT competitor_count_available AS available_competitor_prices, count(*) AS product_lines
FROM clean WHERE competitor_count_available IS NOT NULL GROUP BY competitor_count_available""")
    Q["product_position"] = with_ctes(POSITION, """
SELECT product, price_position, count(*) AS observations, round(avg(is_win), 6) AS win_rate
FROM ppl WHERE product IS NOT NULL GROUP BY product, price_position HAVING count(*) >= 10""")
    Q["data_quality_kpis"] = with_base("""
SELECT CAST(count(*) AS BIGINT) AS clean_lines, CAST(count(DISTINCT quote_id) AS BIGINT) AS unique_quotes,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT quote_id FROM clean WHERE quote_id IS NOT NULL
                                              GROUP BY quote_id HAVING count(*) > 1)) AS multi_line_quotes,
       CAST(sum(CASE WHEN gross_margin_rate < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_margin_lines
FROM clean""")
    miss = " UNION ALL ".join(
        f"SELECT 'Competitor {x.upper()}' AS field, "
        f"CAST(sum(CASE WHEN competitor_{x} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_records, "
        f"round(avg(CASE WHEN competitor_{x} IS NULL THEN 1 ELSE 0 END), 6) AS missing_rate FROM clean"
        for x in "abc")
    Q["competitor_missingness"] = with_base(miss)

    # --- formatting
    Q["fmt_currency"] = with_base(f"""
SELECT quote_id, line_seq, {cur('estimated_gross_profit')} AS gross_profit_text,
       {cur('avg_competitor_price')} AS avg_competitor_text FROM clean""")
    Q["fmt_signed_currency"] = with_base(f"""
SELECT quote_id, line_seq, {scur('(unit_price - min_competitor_price)')} AS gap_to_min_text FROM clean""")
    Q["fmt_percent"] = with_base(f"""
SELECT quote_id, line_seq, {pct0('gross_margin_rate')} AS margin_text,
       {sign('gross_margin_rate')} || {pct1('gross_margin_rate')} AS margin_signed_text,
       CASE WHEN price_gap_min_competitor_pct IS NULL THEN 'N/A'
            ELSE {pct1('(price_gap_min_competitor_pct / 100)')} END AS gap_text FROM clean""")
    return Q


def positive_zero(sql: str) -> str:
    """Wrap every ``round(..., 6)`` as ``(round(..., 6) + 0.0)``: DuckDB keeps -0.0, Spark does not."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        call = sql[j:k + 1]
        inner = positive_zero(call[6:-1])
        call = "round(" + inner + ")"
        if call.replace(" ", "").endswith(",6)"):
            call = f"({call} + CAST(0 AS DOUBLE))"
        out.append(sql[i:j])
        out.append(call)
        i = k + 1


#: Recommender queries that are also registered with the fixed 13-feature model.
MODEL_PRICED = ["score_scenarios", "margin_curve", "recommend_margin", "top_margin_scenarios", "quote_comparison",
                "comparison_table", "risk_flags", "quote_review"]


def all_oracles() -> dict[str, str]:
    from .fixed_model import probability_sql
    from ..operators.refresh import REPORTS
    from .model_queries import model_oracles
    q = oracle_queries()
    p = probability_sql({"unit_price": "up", "gross_margin_rate": "g", "estimated_cost": "tc",
                         "grant_ratio_to_subtotal": "grant_ratio", "competitor_count_available": "n_c",
                         "avg_competitor_price": "av", "min_competitor_price": "mn",
                         "price_gap_avg_competitor_pct": "gap_avg", "price_gap_min_competitor_pct": "gap_min"})
    q.update({f"{n}_fixed_model": q[n].replace(SCORECARD_P, p) for n in MODEL_PRICED})
    q.update(model_oracles())
    # a refreshed report equals the report over all lines
    q.update({f"refreshed_{n}": q[n] for n in REPORTS})
    return {k: positive_zero(v) for k, v in q.items()}
