"""Registered queries: one callable per operator of the inventory.

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole
fixture tables.  Double outputs are rounded to 6 places so that results can be
compared with an independent SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fmt_currency, fmt_percent, fmt_signed_currency, rounded
from ..operators import cleaning as C
from ..operators import pricing as P
from ..operators import refresh
from ..operators import reports as A
from ..sources.fixture import lines_partitions, most_lines_of_a_quote, quotes_from_tpch, requests_from_clean, sparse_requests
from ..operators.keyed import settings
from ..session import materialize_grouped, scratch_path
from ..sources.readers import read_quotes, read_quotes_checked
from .fixed_model import FIXED_MODEL
from .oracle import MODEL_PRICED
from .scorecard import DEFAULT_SCORECARD

_CACHE: dict[tuple[int, str], dict] = {}


#: Queries of several grid points per request: most of their time would be ``round``.
GRID_ROWS = [f"{q}{m}" for q in ("margin_curve", "top_margin_scenarios") for m in ("", "_fixed_model")]


def finish(df: DataFrame, places: int = 6, grid_rows: bool = False) -> DataFrame:
    """Round every double column (comparison-friendly output).

    ``rounded`` gives the same as ``round`` but is longer code, too long for the JVM to compile beside
    the expressions of a wide row (quote_review); so it is used for ``grid_rows`` only."""
    to_places = rounded if grid_rows else F.round
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(to_places(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def lines(spark: SparkSession, sf_dir: str) -> dict:
    """Raw quotes and the number of partitions they are dealt to; ``inputs`` adds to them."""
    key = (id(spark), sf_dir)
    if key not in _CACHE:
        n = lines_partitions(spark, sf_dir)
        _CACHE[key] = {"raw": quotes_from_tpch(spark, sf_dir, n), "partitions": n}
    return _CACHE[key]


def inputs(spark: SparkSession, sf_dir: str) -> dict:
    """Raw quotes, the cleaned table (written once, bucketed by quote, read by every report: S2) and requests."""
    tables = lines(spark, sf_dir)
    if "clean" not in tables:
        n = tables["partitions"]
        clean = materialize_grouped(C.clean_quotes(tables["raw"]), "clean", "quote_id", ["line_seq"], buckets=n,
                                    hot_in=quotes_from_tpch(spark, sf_dir), hot_rows=settings(spark)[0],
                                    most=most_lines_of_a_quote(spark, sf_dir))
        tables |= {"clean": clean, "requests": requests_from_clean(clean)}
    return tables


def clear_cache() -> None:
    _CACHE.clear()


def raw_of(spark, sf):
    return lines(spark, sf)["raw"]


def clean_of(spark, sf):
    return inputs(spark, sf)["clean"]


def requests_of(spark, sf):
    return inputs(spark, sf)["requests"]


def stress_requests(requests: DataFrame) -> DataFrame:
    """Every request plus four out-of-bounds variants of it (FIXTURES.md section 2).

    Variant v of request (q, s) gets line_seq -(10 s + v); one pass, no union.
    """
    variants = [
        ("gross_margin_rate", F.lit(0.95)),
        ("qty", F.lit(0)),
        ("cost_per_unit", F.lit(0.5)),
        ("kw", F.lit(0.05)),
    ]
    v = F.col("_v")
    out = requests.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(len(variants)))))
    cols = []
    for c in requests.columns:
        e = F.col(c)
        for i, (name, value) in enumerate(variants, start=1):
            if c == name:
                e = F.when(v == i, value.cast(requests.schema[c].dataType)).otherwise(e)
        if c == "line_seq":
            e = F.when(v == 0, e).otherwise(-(F.col("line_seq") * 10 + v))
        cols.append(e.alias(c))
    return out.select(*cols)


LINE_KEYS = ["quote_id", "line_seq"]


def clean_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """The load path of a real file (S1, C1-C8): the fixture's lines as CSV without ``line_seq``,
    read and cleaned.  ``line_seq`` is left out of the result: it depends on the file's layout."""
    path = scratch_path(spark, "quotes-csv")
    raw_of(spark, sf).drop("line_seq").write.option("header", True).csv(path)
    return C.clean_quotes(read_quotes(spark, path, "csv")).drop("line_seq")


def dirty_file(spark: SparkSession, sf: str) -> str:
    """The fixture's lines as CSV with faults in some cells: words, fractions, numbers too large, NA tokens."""
    path = scratch_path(spark, "quotes-dirty")
    k = F.col("quote_id")
    faults = {
        "qty": F.when(k % 29 == 0, F.lit("two")).when(k % 31 == 0, F.lit("2.5")).when(k % 37 == 0, F.lit("99999999999")),
        "unit_price": F.when(k % 41 == 0, F.lit("12,50")).when(k % 43 == 0, F.lit("n/a")),
        "competitor_a": F.when(k % 47 == 0, F.lit("ask")),
    }
    text = raw_of(spark, sf).select(*[
        F.coalesce(faults[c], F.col(c).cast("string")).alias(c) if c in faults else F.col(c)
        for c in ("quote_id", "line_seq", "product", "qty", "unit_price", "competitor_a")])
    text.write.option("header", True).csv(path)
    return path


def report_state(spark: SparkSession, sf: str) -> refresh.ReportState:
    """The reports' state after two batches: lines 1 and 2 of each quote, then the later ones together
    with some of the first batch sent again."""
    tables = inputs(spark, sf)
    if "firsts" not in tables:
        clean = tables["clean"]
        known = clean.where(F.col("line_seq") <= 2)
        later = clean.where((F.col("line_seq") > 2) | (F.col("quote_id") % 7 == 0))
        state = refresh.refresh(refresh.write_state(refresh.summarise(known)), later, known)
        tables.update(state._asdict())
    return refresh.ReportState(tables["firsts"], tables["shapes"])


def _q(fn: Callable[[SparkSession, str], DataFrame], grid_rows: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: finish(fn(spark, sf), grid_rows=grid_rows)


def _spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    sc = DEFAULT_SCORECARD
    Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    # --- sources and cleaning
    Q["scan_quotes"] = lambda s, f: raw_of(s, f)
    Q["filter_positive_qty"] = lambda s, f: C.filter_positive_qty(raw_of(s, f))
    Q["filter_highest_price"] = lambda s, f: C.filter_highest_price(raw_of(s, f))
    Q["mark_highest_price"] = lambda s, f: C.mark_highest_price(raw_of(s, f)).select(
        *LINE_KEYS, "product", "unit_price", "is_highest_price", "is_highest_price_calc")
    Q["dedupe_rows"] = lambda s, f: C.dedupe_rows(C.filter_highest_price(C.filter_positive_qty(raw_of(s, f))))
    Q["clean_from_file"] = clean_from_file
    Q["rejected_cells"] = lambda s, f: read_quotes_checked(s, dirty_file(s, f))[1].drop("file")
    Q["checked_quotes"] = lambda s, f: read_quotes_checked(s, dirty_file(s, f))[0].withColumn(
        "qty", F.col("qty").cast("double"))   # with NULLs: the same in every client
    Q["derive_is_win"] = lambda s, f: clean_of(s, f).select(*LINE_KEYS, "convert_to_order", "is_win")
    Q["derive_gmr_pct"] = lambda s, f: clean_of(s, f).select(*LINE_KEYS, "gross_margin_rate", "gmr_pct")
    Q["derive_gmr_band"] = lambda s, f: clean_of(s, f).select(*LINE_KEYS, "gross_margin_rate", "band_ord",
                                                               "gmr_band")
    Q["derive_unit_cost"] = lambda s, f: clean_of(s, f).select(*LINE_KEYS, "estimated_cost", "qty",
                                                                "estimated_cost_per_unit")
    Q["flag_multi_product"] = lambda s, f: C.flag_multi_product(clean_of(s, f)).select(
        *LINE_KEYS, "product", "multi_product_quote")
    Q["quote_header"] = lambda s, f: C.quote_header(clean_of(s, f)).select(
        *LINE_KEYS, "product", "gross_margin_rate", "band_ord", "is_win")
    Q["quote_product_header"] = lambda s, f: C.quote_product_header(clean_of(s, f)).select(
        *LINE_KEYS, "product", "gross_margin_rate", "band_ord", "is_win")
    Q["filter_lost_lines"] = lambda s, f: C.filter_lost_lines(clean_of(s, f)).select(
        *LINE_KEYS, "product", "is_win")
    Q["filter_with_benchmark"] = lambda s, f: C.filter_with_benchmark(clean_of(s, f)).select(
        *LINE_KEYS, "min_competitor_price")
    Q["product_list"] = lambda s, f: C.product_list(clean_of(s, f))

    # --- scenario pricing
    def avail(s, f):
        arr = F.col("available_prices")
        return P.with_available_competitors(clean_of(s, f)).select(
            *LINE_KEYS, F.size(arr).alias("n_available"),
            F.get(arr, 0).alias("price_1"), F.get(arr, 1).alias("price_2"), F.get(arr, 2).alias("price_3"))
    Q["available_competitors"] = avail
    Q["price_scenarios"] = lambda s, f: P.price_scenarios(requests_of(s, f))
    Q["price_stress"] = lambda s, f: P.price_scenarios(stress_requests(requests_of(s, f))).select(
        *LINE_KEYS, "gross_margin_rate", "unit_price").join(
        P.score_scenarios(stress_requests(requests_of(s, f)), sc).select(*LINE_KEYS, "expected_gross_profit"), LINE_KEYS)
    Q["margin_limit"] = lambda s, f: P.margin_curve(requests_of(s, f), sc, max_margin=1.05).groupBy(*LINE_KEYS).agg(
        F.count(F.lit(1)).alias("points"), F.max("gross_margin_rate").alias("highest_margin"),
        F.min("unit_price").alias("lowest_price"))
    Q["reject_bad_margin"] = lambda s, f: P.reject_bad_margin(stress_requests(requests_of(s, f)))
    Q["validate_requests"] = lambda s, f: P.validate_requests(stress_requests(requests_of(s, f)))
    Q["product_defaults"] = lambda s, f: P.product_defaults(clean_of(s, f))
    Q["prefill_requests"] = lambda s, f: P.prefill_requests(
        sparse_requests(requests_of(s, f)), P.product_defaults(clean_of(s, f)))
    priced = {
        "score_scenarios": lambda s, f, m: P.score_scenarios(requests_of(s, f), m),
        "margin_curve": lambda s, f, m: P.margin_curve(requests_of(s, f), m),
        "recommend_margin": lambda s, f, m: P.recommend_margin(requests_of(s, f), m),
        "top_margin_scenarios": lambda s, f, m: P.top_margin_scenarios(requests_of(s, f), m),
        "quote_comparison": lambda s, f, m: P.quote_comparison(requests_of(s, f), m),
        "comparison_table": lambda s, f, m: P.comparison_table(P.quote_comparison(requests_of(s, f), m)),
        "risk_flags": lambda s, f, m: P.risk_flags(requests_of(s, f), m),
        "quote_review": lambda s, f, m: P.quote_review(requests_of(s, f), clean_of(s, f), m),
    }
    for name in MODEL_PRICED:
        Q[name] = lambda s, f, run=priced[name]: run(s, f, sc)
        Q[f"{name}_fixed_model"] = lambda s, f, run=priced[name]: run(s, f, FIXED_MODEL)
    Q["historical_benchmark"] = lambda s, f: P.historical_benchmark(requests_of(s, f), clean_of(s, f))
    Q["classify_price_position"] = lambda s, f: P.classify_price_position(requests_of(s, f))
    Q["price_references"] = lambda s, f: P.price_references(requests_of(s, f))

    # --- historical reports
    Q["overview_kpis"] = lambda s, f: A.overview_kpis(clean_of(s, f))
    Q["win_rate_by_band"] = lambda s, f: A.win_rate_by_band(clean_of(s, f))
    Q["product_win_rate"] = lambda s, f: A.product_win_rate(clean_of(s, f))
    Q["product_median_margin"] = lambda s, f: A.product_median_margin(clean_of(s, f))
    Q["loss_signals"] = lambda s, f: A.loss_signals(clean_of(s, f))
    Q["loss_signal_summary"] = lambda s, f: A.loss_signal_summary(clean_of(s, f))
    Q["sweet_spot_all"] = lambda s, f: A.sweet_spot_all(clean_of(s, f))
    Q["sweet_spot_by_product"] = lambda s, f: A.sweet_spot_by_product(clean_of(s, f))
    Q["sweet_spot"] = lambda s, f: A.sweet_spot(clean_of(s, f))
    Q["best_bands"] = lambda s, f: A.best_bands(clean_of(s, f))
    Q["price_position_lines"] = lambda s, f: A.price_position_lines(clean_of(s, f)).select(
        *LINE_KEYS, "product", "price_gap_min_competitor_pct", "is_win", "price_position")
    Q["price_position_summary"] = lambda s, f: A.price_position_summary(clean_of(s, f))
    Q["competitor_availability"] = lambda s, f: A.competitor_availability(clean_of(s, f))
    Q["product_position"] = lambda s, f: A.product_position(clean_of(s, f))
    Q["data_quality_kpis"] = lambda s, f: A.data_quality_kpis(clean_of(s, f))
    Q["competitor_missingness"] = lambda s, f: A.competitor_missingness(clean_of(s, f))

    # --- the same reports from partial states, after two batches
    for name, report in refresh.REPORTS.items():
        Q[f"refreshed_{name}"] = lambda s, f, run=report: run(report_state(s, f))

    # --- scalar formatting functions
    Q["fmt_currency"] = lambda s, f: clean_of(s, f).select(
        *LINE_KEYS, fmt_currency("estimated_gross_profit").alias("gross_profit_text"),
        fmt_currency("avg_competitor_price").alias("avg_competitor_text"))
    Q["fmt_signed_currency"] = lambda s, f: clean_of(s, f).select(
        *LINE_KEYS, fmt_signed_currency(F.col("unit_price") - F.col("min_competitor_price"))
        .alias("gap_to_min_text"))
    Q["fmt_percent"] = lambda s, f: clean_of(s, f).select(
        *LINE_KEYS, fmt_percent("gross_margin_rate", 0).alias("margin_text"),
        fmt_percent("gross_margin_rate", 1, signed=True).alias("margin_signed_text"),
        fmt_percent(F.col("price_gap_min_competitor_pct") / 100, 1, na="N/A").alias("gap_text"))
    return {k: _q(v, k in GRID_ROWS) for k, v in Q.items()}


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .model_queries import model_queries
    q = _spark_queries()
    q.update({k: _q(v) for k, v in model_queries().items()})
    return q
