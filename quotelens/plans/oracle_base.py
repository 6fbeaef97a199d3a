"""SQL text shared by the DuckDB oracle queries.

The oracle is an independent formulation of each query in plain ANSI SQL over
the driver's raw tables (``lineitem``, ``part``); it builds the same fixture
views (``quotes``, ``clean``, ``requests``) as common table expressions.
Decimal constants are written as CAST(... AS DOUBLE) so both engines compute
in binary floating point.
"""

from __future__ import annotations

# Fixed values, stated here independently of the library's own constants.
BAND_UPPER_EDGES = [0.0, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60]
BAND_LABELS = ["< 0%", "0–10%", "10–20%", "20–30%", "30–40%", "40–50%", "50–60%", "> 60%"]


def d(x: float) -> str:
    """A double literal valid in DuckDB."""
    return f"CAST({x!r} AS DOUBLE)"


def band_ord_sql(g: str) -> str:
    parts = [f"WHEN {g} IS NULL OR {g} = CAST('-inf' AS DOUBLE) THEN NULL"]
    for i, e in enumerate(BAND_UPPER_EDGES):
        parts.append(f"WHEN {g} <= {d(e)} THEN {i}")
    return "CASE " + " ".join(parts) + f" ELSE {len(BAND_UPPER_EDGES)} END"


def band_label_sql(ord_: str) -> str:
    parts = [f"WHEN {ord_} = {i} THEN '{lbl}'" for i, lbl in enumerate(BAND_LABELS)]
    return "CASE " + " ".join(parts) + " END"


QUOTE_COLS = ("quote_id, line_seq, product, kw, qty, unit_price, gross_margin_rate, "
              "energy_grant_amount, estimated_cost, grant_ratio_to_subtotal, "
              "competitor_count_available, avg_competitor_price, min_competitor_price, "
              "price_gap_avg_competitor_pct, price_gap_min_competitor_pct, competitor_a, "
              "competitor_b, competitor_c, convert_to_order, estimated_gross_profit, is_highest_price")

QUOTES_CTE = f"""
qb AS (
  SELECT l.l_orderkey AS quote_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey,
              l.l_suppkey, l.l_extendedprice, l.l_quantity) AS BIGINT) AS line_seq,
         replace(p.p_brand, 'Brand#', 'H') AS product,
         CASE WHEN p.p_partkey % 53 = 0 THEN NULL ELSE p.p_size / 2 END AS kw,
         CASE WHEN l.l_orderkey % 97 = 0 AND l.l_linenumber = 1 THEN 0
              ELSE CAST(l.l_quantity AS INTEGER) END AS qty,
         (l.l_partkey * 7 + l.l_suppkey * 13 + l.l_linenumber * 29 + CAST(l.l_quantity AS INTEGER)) % 81 - 10 AS m,
         (l.l_orderkey * 37 + l.l_suppkey * 11) % 100 AS h,
         l.l_partkey + l.l_suppkey AS k,
         p.p_retailprice AS cpu, l.l_partkey AS pk, l.l_suppkey AS sk, p.p_size AS psize
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
q1 AS (
  SELECT quote_id, line_seq, product, kw, qty, m, h, cpu,
         m / 100 AS gross_margin_rate,
         cpu / (1 - m / 100) AS unit_price,
         CAST(psize * 10 AS DOUBLE) AS energy_grant_amount,
         cpu * qty AS estimated_cost,
         CASE WHEN k % 3 = 0 THEN NULL ELSE cpu * (1 + ((pk * 3 + sk) % 61) / 100) END AS competitor_a,
         CASE WHEN k % 2 = 0 THEN NULL ELSE cpu * (1 + ((pk * 5 + sk) % 71) / 100) END AS competitor_b,
         CASE WHEN k % 5 <> 0 THEN NULL WHEN sk % 4 = 0 THEN CAST(0 AS DOUBLE)
              ELSE cpu * (1 + (pk % 81) / 100) END AS competitor_c
  FROM qb
),
q2 AS (
  SELECT *, nullif(competitor_a, 0) AS ca, nullif(competitor_b, 0) AS cb, nullif(competitor_c, 0) AS cc
  FROM q1
),
q3 AS (
  SELECT *,
         energy_grant_amount / nullif(unit_price * qty, 0) AS grant_ratio_to_subtotal,
         CAST((ca IS NOT NULL)::INTEGER + (cb IS NOT NULL)::INTEGER + (cc IS NOT NULL)::INTEGER AS INTEGER)
              AS competitor_count_available,
         (coalesce(ca, 0) + coalesce(cb, 0) + coalesce(cc, 0))
              / nullif((ca IS NOT NULL)::INTEGER + (cb IS NOT NULL)::INTEGER + (cc IS NOT NULL)::INTEGER, 0)
              AS avg_competitor_price,
         least(ca, cb, cc) AS min_competitor_price,
         unit_price * qty - cpu * qty AS estimated_gross_profit,
         CASE WHEN h < 70 - m THEN 0 ELSE 1 END AS convert_to_order
  FROM q2
),
q4 AS (
  SELECT *,
         (unit_price - avg_competitor_price) / avg_competitor_price * 100 AS price_gap_avg_competitor_pct,
         (unit_price - min_competitor_price) / min_competitor_price * 100 AS price_gap_min_competitor_pct,
         CASE WHEN unit_price = max(unit_price) OVER (PARTITION BY quote_id, product) THEN 1 ELSE 0 END
              AS is_highest_price
  FROM q3
),
quotes AS (
  SELECT {QUOTE_COLS} FROM q4
  UNION ALL
  SELECT {QUOTE_COLS} FROM q4 WHERE quote_id % 101 = 0
),
dedup AS (
  SELECT {QUOTE_COLS.replace("line_seq", "min(line_seq) AS line_seq")}
  FROM quotes WHERE qty > 0 AND is_highest_price = 1
  GROUP BY {QUOTE_COLS.replace("line_seq, ", "")}
),
clean AS (
  SELECT *,
         CAST(convert_to_order IS NOT DISTINCT FROM 0 AS INTEGER) AS is_win,
         gross_margin_rate * 100 AS gmr_pct,
         {band_ord_sql('gross_margin_rate')} AS band_ord,
         {band_label_sql(band_ord_sql('gross_margin_rate'))} AS gmr_band,
         estimated_cost / qty AS estimated_cost_per_unit
  FROM dedup
),
requests AS (
  SELECT quote_id, line_seq, product, kw, qty, estimated_cost / qty AS cost_per_unit,
         gross_margin_rate, energy_grant_amount, competitor_a, competitor_b, competitor_c,
         {d(0.2)} AS minimum_margin, {d(0.4)} AS minimum_win_probability
  FROM clean
),
qh AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY line_seq) AS rn_q FROM clean)
  WHERE rn_q = 1
),
qph AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quote_id, product ORDER BY line_seq) AS rn_qp
                 FROM clean WHERE product IS NOT NULL)
  WHERE rn_qp = 1
)"""


def with_base(body: str) -> str:
    return "WITH " + QUOTES_CTE.strip() + "\n" + body


def with_ctes(ctes: str, body: str) -> str:
    """Base CTEs plus extra CTEs (``ctes`` starts with ', name AS (...)')."""
    return "WITH " + QUOTES_CTE.strip() + "\n" + ctes + "\n" + body


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"
