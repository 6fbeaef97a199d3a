"""Edge micro-tables (FIXTURES.md section 5) with hand-computed expectations."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quotelens.functions.columns import fmt_currency, fmt_percent, fmt_signed_currency, gmr_band
from quotelens.operators import cleaning as C
from quotelens.operators import evaluation as E
from quotelens.operators import pricing as P
from quotelens.operators import reports as A
from quotelens.operators.keyed import exact_medians
from quotelens.plans.scorecard import DEFAULT_SCORECARD
from quotelens.sources.readers import QUOTE_COLUMNS, QUOTE_SCHEMA, conform, read_quotes_csv

REQ_COLS = ["quote_id", "line_seq", "product", "kw", "qty", "cost_per_unit", "gross_margin_rate",
            "energy_grant_amount", "competitor_a", "competitor_b", "competitor_c", "minimum_margin",
            "minimum_win_probability"]
REQ_SCHEMA = ("quote_id bigint, line_seq bigint, product string, kw double, qty int, cost_per_unit double, "
              "gross_margin_rate double, energy_grant_amount double, competitor_a double, competitor_b double, "
              "competitor_c double, minimum_margin double, minimum_win_probability double")


def quotes(spark, rows):
    """Quote lines from partial dicts; defaults give a valid, kept line."""
    base = {"qty": 1, "is_highest_price": 1, "convert_to_order": 1, "product": "H1", "unit_price": 100.0,
            "gross_margin_rate": 0.2, "estimated_cost": 80.0, "competitor_count_available": 0}
    full = []
    for i, r in enumerate(rows):
        d = dict(base)
        d.setdefault("line_seq", i + 1)
        d.update(r)
        full.append(tuple(d.get(c) for c in QUOTE_COLUMNS))
    return conform(spark.createDataFrame(full, QUOTE_SCHEMA))


def requests(spark, rows):
    base = {"product": "H1", "kw": 10.0, "qty": 1, "cost_per_unit": 100.0, "gross_margin_rate": 0.3,
            "energy_grant_amount": 0.0, "minimum_margin": 0.2, "minimum_win_probability": 0.4}
    full = []
    for i, r in enumerate(rows):
        d = dict(base, quote_id=1, line_seq=i + 1)
        d.update(r)
        full.append(tuple(d.get(c) for c in REQ_COLS))
    return spark.createDataFrame(full, REQ_SCHEMA)


class FixedP:
    """A scorer returning the probability stored in column ``p_fixed``."""

    def probability(self, f):
        return F.col("p_fixed")


def test_edge_bands(spark):
    vals = [float("-inf"), -0.1, 0.0, 0.1, 0.3, 0.6, 0.61, float("inf"), None, float("nan")]
    df = quotes(spark, [{"gross_margin_rate": v, "quote_id": i} for i, v in enumerate(vals)])
    got = [r[0] for r in df.orderBy("quote_id").select(gmr_band("gross_margin_rate")).collect()]
    assert got == [None, "< 0%", "< 0%", "0–10%", "20–30%", "50–60%", "> 60%", "> 60%", None, None]


def test_edge_labels(spark):
    df = quotes(spark, [{"quote_id": i, "convert_to_order": v} for i, v in enumerate([0, 1, None])])
    got = [r.is_win for r in C.clean_quotes(df).orderBy("quote_id").collect()]
    assert got == [1, 0, 0]


def test_edge_first_row_is_in_line_order(spark):
    df = quotes(spark, [{"quote_id": 7, "line_seq": 2, "gross_margin_rate": 0.55},
                        {"quote_id": 7, "line_seq": 1, "gross_margin_rate": 0.05}])
    df = C.clean_quotes(df).repartition(5)
    h = C.quote_header(df).collect()
    assert len(h) == 1 and h[0].line_seq == 1 and h[0].gmr_band == "0–10%"


def test_edge_pair(spark):
    rows = [{"quote_id": 1, "product": "H1", "unit_price": 200.0, "gross_margin_rate": 0.05, "line_seq": 1},
            {"quote_id": 1, "product": "H1", "unit_price": 200.0, "gross_margin_rate": 0.35, "line_seq": 2},
            {"quote_id": 1, "product": "H1", "unit_price": 150.0, "gross_margin_rate": 0.25, "line_seq": 3}]
    df = quotes(spark, rows)
    marked = C.mark_highest_price(df).orderBy("line_seq").collect()
    assert [r.is_highest_price_calc for r in marked] == [1, 1, 0]
    # the salted path (every key hot) gives the same flags
    salted = C.mark_highest_price(df, hot_rows=1, salts=4).orderBy("line_seq").collect()
    assert [r.is_highest_price_calc for r in salted] == [1, 1, 0]
    clean = C.clean_quotes(df)
    assert C.quote_product_header(clean).count() == 1
    ss = A.sweet_spot_by_product(clean).where("quotations > 0").collect()
    assert len(ss) == 1 and ss[0].gmr_band == "0–10%"
    bench = P.benchmark_table(clean).orderBy("band_ord").collect()
    assert [(r.band_ord, r.n) for r in bench] == [(1, 1), (3, 1), (4, 1)]


def test_edge_thresholds(spark):
    rows = []
    for q in range(19):
        rows.append({"quote_id": q, "product": "P19"})
    for q in range(20):
        rows.append({"quote_id": 100 + q, "product": "P20"})
    clean = C.clean_quotes(quotes(spark, rows))
    got = {r.product: r.observations for r in A.product_win_rate(clean).collect()}
    assert got == {"P20": 20}
    rows = []
    for i in range(9):
        rows.append({"quote_id": 500 + i, "product": "X9", "min_competitor_price": 100.0,
                     "price_gap_min_competitor_pct": 0.0})
    for i in range(10):
        rows.append({"quote_id": 600 + i, "product": "X10", "min_competitor_price": 100.0,
                     "price_gap_min_competitor_pct": 0.0})
    got = {r.product: r.observations for r in A.product_position(C.clean_quotes(quotes(spark, rows))).collect()}
    assert got == {"X10": 10}


def test_edge_dups(spark):
    rows = [{"quote_id": 1, "line_seq": 1}, {"quote_id": 1, "line_seq": 1},
            {"quote_id": 1, "line_seq": 1, "unit_price": 120.0}]
    assert C.clean_quotes(quotes(spark, rows)).count() == 2


def test_edge_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None)], "k string, v double")
    assert exact_medians(df, ["k"], {"m": "v"}).first().m == 1.5


def test_medians_match_percentile(spark):
    df = spark.range(0, 20000).select((F.col("id") % 3).alias("k"),
                                      ((F.col("id") * 7919) % 4999 / 7.0).alias("v"),
                                      F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 17).alias("w"))
    df = df.unionByName(spark.createDataFrame([(9, None, None), (None, 1.0, None), (None, 2.0, 5)], "k long, v double, w long"))
    got = exact_medians(df, ["k"], {"mv": "v", "mw": "w"}).collect()
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("mv"), F.percentile("w", F.lit(0.5)).alias("mw")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert exact_medians(df, [], {"m": "v"}).first().m == df.agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_equal_rows_of_a_file_are_one_row(spark, tmp_path):
    from quotelens.sources.readers import read_quotes
    folder = tmp_path / "quotes"
    folder.mkdir()
    header = "quote_id,product,qty,unit_price,is_highest_price,convert_to_order\n"
    (folder / "b.csv").write_text(header + "7,H1,2,100.0,1,0\n7,H1,2,100.0,1,0\n7,H2,1,50.0,1,1\n")
    (folder / "a.csv").write_text(header + "7,H1,2,100.0,1,0\n" + "8,H3,1,9.0,1,0\n" * 200)
    clean = C.dedupe_rows(C.filter_positive_qty(read_quotes(spark, str(folder), "csv")))
    rows = clean.orderBy("line_seq").collect()
    assert [(r.quote_id, r["product"]) for r in rows] == [(7, "H1"), (8, "H3"), (7, "H2")]  # a.csv comes first


def test_grid_makes_no_price_at_95_percent_or_more(spark):
    from quotelens.plans.scorecard import DEFAULT_SCORECARD
    req = requests(spark, [{"gross_margin_rate": 0.97}])
    curve = P.margin_curve(req, DEFAULT_SCORECARD, max_margin=1.05).collect()
    assert len(curve) == 95 and min(r.unit_price for r in curve) > 0
    assert P.price_scenarios(req).first().unit_price is None
    assert P.score_scenarios(req, DEFAULT_SCORECARD).first().win_probability is None
    for strict in (P.price_scenarios(req, strict=True), P.score_scenarios(req, DEFAULT_SCORECARD, strict=True)):
        with pytest.raises(Exception):
            strict.collect()


def test_requests_without_ids_all_come_back(spark):
    from quotelens.plans.scorecard import DEFAULT_SCORECARD
    one = requests(spark, [{"gross_margin_rate": 0.3}, {"gross_margin_rate": 0.4}])
    req = one.withColumn("quote_id", F.lit(None).cast("long")).withColumn("line_seq", F.lit(None).cast("long"))
    assert P.recommend_margin(req, DEFAULT_SCORECARD).count() == 2
    assert P.top_margin_scenarios(req, DEFAULT_SCORECARD).count() == 20


def test_scaling_of_large_means(spark):
    from quotelens.operators.model import learn_preprocessing
    df = spark.createDataFrame([(1e9 + k, "H1") for k in (0.0, 1.0, 2.0)], "kw double, product string")
    prep = learn_preprocessing(df, ["kw"])
    assert abs(prep.scales["kw"] - (2 / 3) ** 0.5) < 1e-6 and prep.means["kw"] == 1e9 + 1


def test_edge_empty_band(spark):
    clean = C.clean_quotes(quotes(spark, [{"quote_id": 1, "gross_margin_rate": 0.15}]))
    rows = A.win_rate_by_band(clean).orderBy("band_ord").collect()
    assert len(rows) == 8
    assert [r.quotations for r in rows] == [0, 0, 1, 0, 0, 0, 0, 0]
    assert sum(r.win_rate is None for r in rows) == 7


def test_edge_positions(spark):
    gaps = [-5.01, -5.0, 5.0, 5.01, None]
    rows = [{"quote_id": i, "min_competitor_price": 100.0, "price_gap_min_competitor_pct": g}
            for i, g in enumerate(gaps)]
    got = [r.price_position for r in
           A.price_position_lines(C.clean_quotes(quotes(spark, rows))).orderBy("quote_id").collect()]
    assert got == ["Below competitor benchmark", "Approximately aligned (±5%)",
                   "Approximately aligned (±5%)", "Above competitor benchmark", "Above competitor benchmark"]
    summary = A.price_position_summary(C.clean_quotes(quotes(spark, rows[:1]))).orderBy("position_ord").collect()
    assert [r.product_lines for r in summary] == [1, None, None]


def test_edge_zero_comp(spark):
    req = requests(spark, [{"competitor_a": 0.0, "competitor_b": None, "competitor_c": 10.0}])
    s = P.price_scenarios(req).first()
    assert s.competitor_count_available == 1 and s.min_competitor_price == 10.0
    clean = C.clean_quotes(quotes(spark, [{"quote_id": 1, "competitor_a": 0.0, "competitor_b": None,
                                           "competitor_c": 10.0}]))
    miss = {r.field: r.missing_records for r in A.competitor_missingness(clean).collect()}
    assert miss == {"Competitor A": 0, "Competitor B": 1, "Competitor C": 0}


def test_edge_no_comp(spark):
    req = requests(spark, [{}])
    s = P.price_scenarios(req).first()
    assert s.competitor_count_available == 0
    assert s.avg_competitor_price is None and s.min_competitor_price is None
    assert s.price_gap_min_competitor_pct is None and s.price_gap_avg_competitor_pct is None
    flags = [r.title for r in P.risk_flags(req, DEFAULT_SCORECARD).collect()]
    assert "Information gap" in flags
    assert P.price_references(req).count() == 0


def test_edge_ties_pick_lowest_margin(spark):
    req = requests(spark, [{"minimum_margin": 0.2}]).withColumn("p_fixed", F.lit(0.0))
    r = P.recommend_margin(req, FixedP()).first()
    assert abs(r.recommended_margin - 0.20) < 1e-12
    top = P.top_margin_scenarios(req, FixedP()).orderBy("rank").collect()
    assert [t.grid_index for t in top] == list(range(10))


def test_edge_flags(spark):
    req = requests(spark, [
        {"gross_margin_rate": -0.1, "cost_per_unit": 110.0, "competitor_a": 100.0 / 1.06},
        {"gross_margin_rate": 0.1, "cost_per_unit": 90.0, "competitor_a": 100.0},
        {"gross_margin_rate": 0.3, "cost_per_unit": 70.0, "competitor_a": 100.0},
    ]).withColumn("p_fixed", F.when(F.col("line_seq") == 1, 0.1).otherwise(0.9))
    got = {}
    for r in P.risk_flags(req, FixedP()).orderBy("line_seq", "flag_order").collect():
        got.setdefault(r.line_seq, []).append((r.severity, r.title))
    assert got[1] == [("High", "Profitability risk"), ("Medium", "Conversion risk"),
                      ("High", "Competitor positioning risk")]
    assert got[2] == [("Medium", "Margin review")]
    assert got[3] == [("Low", "No major rule-based warning")]
    msgs = {r.title: r.explanation for r in P.risk_flags(req, FixedP()).collect()}
    assert msgs["Conversion risk"].endswith("review threshold of 40%.")
    assert msgs["Competitor positioning risk"].startswith("Quoted unit price is 6.0% above")


def test_edge_metrics(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.3), (0, 0.3)], "label int, score double")
    m = E.classification_metrics(df).first()
    assert m.precision_win == 0.0 and m.f1_win == 0.0 and m.recall_win == 0.0
    assert E.roc_auc(df).first().roc_auc == 0.5


def test_edge_csv_nulls(spark):
    d = tempfile.mkdtemp(prefix="quotelens-csv-")
    path = os.path.join(d, "q.csv")
    with open(path, "w") as fh:
        fh.write("quote_id,product,kw,qty,competitor_a,competitor_b,competitor_c,unit_price\n")
        fh.write('1,H1,,3,NA,NaN,null,None\n')
        fh.write('2,H2,1.5,4.0,10,N/A,0,12.5\n')
    rows = read_quotes_csv(spark, path).orderBy("quote_id").collect()
    r = rows[0]
    assert r.kw is None and r.competitor_a is None and r.competitor_b is None
    assert r.competitor_c is None and r.unit_price is None
    assert rows[1].qty == 4 and rows[1].kw == 1.5 and rows[1].competitor_b is None
    assert rows[1].competitor_c == 0.0
    assert rows[0].line_seq < rows[1].line_seq


def test_edge_format(spark):
    df = spark.createDataFrame([(0.0625,), (2.5,), (1234.5,), (-0.4,), (None,)], "v double")
    got = df.select(fmt_percent("v", 1).alias("p"), fmt_currency("v").alias("c"),
                    fmt_signed_currency("v").alias("s")).collect()
    assert got[0].p == "6.2%"
    assert got[1].c == "2" and got[1].s == "+2"
    assert got[2].c == "1,234"
    assert got[3].c == "-0"
    assert got[4].c == "N/A" and got[4].s == "N/A"


def test_reject_strict_raises(spark):
    req = requests(spark, [{"gross_margin_rate": 0.95}])
    with pytest.raises(Exception):
        P.reject_bad_margin(req, strict=True).collect()
    assert P.reject_bad_margin(req).first().margin_ok is False


def test_conform_requests_nan_and_missing(spark):
    df = spark.createDataFrame([(1, 1, "H1", float("nan"), 2, 100.0, 0.3)],
                               "quote_id long, line_seq long, product string, kw double, qty long, "
                               "cost_per_unit double, gross_margin_rate double")
    r = P.conform_requests(df).first()
    assert r.kw is None and r.qty == 2 and r.minimum_margin is None and r.competitor_a is None


def test_distributed_median_small_groups(spark):
    rows = [("one", 5.0), ("two", 1.0), ("two", 4.0), ("rep", 2.0)] + [("rep", 7.0)] * 50 + [("rep", 3.0)] * 10
    df = spark.createDataFrame(rows, "k string, v double")
    a = {r.k: r.m for r in exact_medians(df, ["k"], {"m": "v"}).collect()}
    assert a == {"one": 5.0, "two": 2.5, "rep": 7.0}


def test_curve_metrics_single_class_is_null(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.7)], "label int, score double")
    m = E.curve_metrics(df).first()
    assert m.roc_auc is None and m.average_precision is None


def test_parquet_reader_nan_to_null_and_line_order(spark, tmp_path):
    from quotelens.sources.readers import read_quotes
    path = str(tmp_path / "q.parquet")
    spark.createDataFrame([(1, "H1", float("nan"), 2, 100.0), (2, "H2", 3.5, 1, float("nan"))],
                          "quote_id long, product string, kw double, qty int, unit_price double") \
        .coalesce(1).write.parquet(path)
    rows = read_quotes(spark, path).orderBy("quote_id").collect()
    assert rows[0].kw is None and rows[1].unit_price is None and rows[1].kw == 3.5
    assert rows[0].line_seq < rows[1].line_seq          # file order stands in for a missing line_seq


def test_configure_for_scale(spark):
    from quotelens.session import CLUSTER_SQL_CONF, configure_for_scale
    before = {k: spark.conf.get(k, None) for k in CLUSTER_SQL_CONF}
    try:
        configure_for_scale(spark)
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "256m"
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_rounded_is_round(spark):
    import math
    import random
    from quotelens.functions.columns import rounded
    r = random.Random(3)
    values = [None, 0.0, -0.0, -1e-9, 5e-7, -5e-7, 1.5e-6, 2.5e-6, 0.1234565, -0.1234565, 1.0000005, 123456.7890125, 554646333.4728065, 4503599626.999999,
              4503599628.1234567, 1e15, 1e300, -1e300, 5e-324, math.nan, math.inf, -math.inf]
    values += [r.choice([-1, 1]) * r.random() * 10 ** r.randint(-8, 11) for _ in range(20_000)]
    values += [r.randint(-10**9, 10**9) / 2e6 for _ in range(20_000)]   # ties and their neighbours
    values += [math.nextafter(r.randint(-10**8, 10**8) / 2e6, r.choice([-1, 1]) * 1e9) for _ in range(20_000)]
    out = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", F.round("v", 6).cast("string").alias("a"), rounded("v", 6).cast("string").alias("b"),
        F.round("v", 2).cast("string").alias("c"), rounded("v", 2).cast("string").alias("d"))
    assert out.where("NOT (a <=> b AND c <=> d)").collect() == []
    plan = spark.range(5).select((F.col("id") / 7).alias("v")).select(rounded("v", 6).alias("v"))
    assert [x.v for x in plan.collect()] == [0.0, 0.142857, 0.285714, 0.428571, 0.571429]


def test_medians_over_all_sizes_of_values(spark):
    """Signs, zeros, infinities, denormals, near-equal values, keys that are NULL or without values."""
    inf = float("inf")
    groups = {"signs": [-1e300, -2.5, -2.4999, -0.0, 0.0, 1e-320, 3.0], "inf": [-inf, -inf, 1.0, inf, inf, inf], "close": [1000 + i * 1e-9 for i in range(400)],
              "far": [1e-300, 1e300], "none": [None, None], None: [5.0, None, 7.0, 8.0], "zeros": [0.0, -0.0, 0.0, 1.0], "low": [-8.0, -7.0, -7.0, -1e-9]}
    df = spark.createDataFrame([(k, v, None if v is None else -v) for k, vs in groups.items() for v in vs], "k string, v double, w double").repartition(5)
    for keys in (["k"], []):
        got = {tuple(r)[:-2]: tuple(r)[-2:] for r in exact_medians(df, keys, {"a": "v", "b": "w"}).collect()}
        want = df.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("w", F.lit(0.5)).alias("b"))
        assert got == {tuple(r)[:-2]: tuple(r)[-2:] for r in want.collect()}
