"""A task's share of the lines doesn't grow with the table."""

from pyspark.sql import functions as F

from conftest import SF_SMALL

from quotelens import session
from quotelens.operators import cleaning as C
from quotelens.plans import catalog
from quotelens.sources import fixture


def test_lines_and_buckets_follow_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    catalog.clear_cache()
    try:
        raw = catalog.raw_of(spark, SF_SMALL)
        per_task = raw.groupBy(F.spark_partition_id().alias("p")).count().agg(F.count("p"), F.max("count")).first()
        assert per_task[0] >= 55 and per_task[1] < 300   # 6,051 lines
        clean = catalog.clean_of(spark, SF_SMALL)
        files = {f.rsplit("_", 1)[1] for f in clean.inputFiles()}
        assert len(files) >= 55   # a bucket is what a task reads
        assert C.dedupe_rows(C.filter_highest_price(C.filter_positive_qty(raw))).count() == clean.count() == 5473
    finally:
        catalog.clear_cache()


def test_small_tables_keep_one_partition_per_core(spark):
    assert session.partitions_for(spark, 0) == spark.sparkContext.defaultParallelism
    assert session.partitions_for(spark, 216_000_000) == 1440


def test_raw_queries_leave_the_clean_table_unwritten(spark):
    catalog.clear_cache()
    catalog.raw_of(spark, SF_SMALL)
    assert "clean" not in catalog.lines(spark, SF_SMALL)
    catalog.clear_cache()


def _tables(spark, folder, lines, parts):
    """lineitem of (order, part) pairs and part, one row per key given."""
    spark.createDataFrame([(o, p, 1, n, 5, 10.0) for n, (o, p) in enumerate(lines)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity long, "
                          "l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p}", 3, 100.0) for p in parts],
                          "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_the_bound_on_a_quotes_lines_holds(spark, tmp_path):
    # order 101 comes twice (a multiple of 101), part 1 has two rows: 3 lines make 12
    sf = _tables(spark, tmp_path, [(101, 1), (101, 1), (101, 1), (7, 2), (None, 2)], [1, 1, 2, None, None])
    most = fixture.quotes_from_tpch(spark, sf).groupBy("quote_id").count().agg(F.max("count")).first()[0]
    assert most == 12 == fixture.most_lines_of_a_quote(spark, sf)


def test_no_join_is_counted_where_the_bound_rules_out_a_hot_quote(spark, tmp_path):
    sf = _tables(spark, tmp_path, [(101, 1), (101, 2), (7, 2)], [1, 2])
    joins, real = [], fixture.quotes_from_tpch

    class Counted:
        def groupBy(self, *_):
            joins.append("counted")
            return real(spark, sf).groupBy("quote_id")

    raw = real(spark, sf, 4)
    for hot_rows, counted in ((100, []), (4, ["counted"])):
        most = fixture.most_lines_of_a_quote(spark, sf)
        table = session.materialize_grouped(C.clean_quotes(raw), "clean", "quote_id", ["line_seq"], buckets=4, hot_in=Counted(),
                                            hot_rows=hot_rows, most=most)
        assert joins == counted
        assert session.is_grouped(table, "quote_id") == (hot_rows > 4) and table.count() == C.clean_quotes(raw).count()
