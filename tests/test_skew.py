"""Hot-key paths give exactly the results of the ordinary paths."""

from pyspark.sql import functions as F

from conftest import SF_SMALL

from quotelens.operators.keyed import lookup_join, with_key_stats


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_key_stats_of_hot_keys_equal_plain_join(spark):
    df = spark.range(0, 3000).select((F.col("id") % 4).alias("k"), F.col("id").alias("x"))
    df = df.unionByName(spark.createDataFrame([(None, -1), (None, -2)], "k long, x long"))
    plain = with_key_stats(df, ["k"], F.max("x").alias("m"), keep_count=True, hot_rows=10**9)
    salted = with_key_stats(df, ["k"], F.max("x").alias("m"), keep_count=True, hot_rows=100, salts=8)
    assert _rows(plain) == _rows(salted)
    assert {r.m for r in salted.where("k IS NULL").collect()} == {-1}


def test_lookup_join_forms_agree(spark):
    big = spark.range(0, 3000).select((F.col("id") % 4).alias("k"), F.col("id").alias("x"))
    big = big.unionByName(spark.createDataFrame([(None, -1)], "k long, x long"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (None, "n")], "k long, s string")
    cast = lookup_join(big, small, ["k"])
    shuffled = lookup_join(big, small, ["k"], most_rows=0)
    assert _rows(cast) == _rows(shuffled)
    assert cast.count() == 3001 and cast.where("k IS NULL").first().s == "n"


def test_lookups_leave_the_big_side_where_it_is(spark):
    from quotelens.plans import catalog
    Q = catalog.spark_queries()
    for name in ("prefill_requests", "historical_benchmark"):
        plan = Q[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan, name


SKEW_QUERIES = ["scan_quotes", "dedupe_rows", "mark_highest_price", "flag_multi_product",
                "quote_weights_all", "loss_signals", "prefill_requests", "historical_benchmark",
                "quote_review", "win_rate_by_band", "sweet_spot_by_product", "product_defaults"]


def test_queries_identical_when_every_key_is_hot(spark):
    from quotelens.plans import catalog
    Q = catalog.spark_queries()
    out = {}
    for mode in ("default", "hot"):
        catalog.clear_cache()
        if mode == "hot":
            spark.conf.set("quotelens.hotKeyRows", "3")
            spark.conf.set("quotelens.salts", "4")
        try:
            out[mode] = {k: _rows(Q[k](spark, SF_SMALL)) for k in SKEW_QUERIES}
        finally:
            spark.conf.unset("quotelens.hotKeyRows")
            spark.conf.unset("quotelens.salts")
    catalog.clear_cache()
    for k in SKEW_QUERIES:
        assert out["default"][k] == out["hot"][k], k
