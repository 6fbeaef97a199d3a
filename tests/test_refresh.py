"""Incremental refresh against full runs, and the table of rejected cells."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quotelens.operators import cleaning as C
from quotelens.operators import refresh as R
from quotelens.operators import reports as A
from quotelens.operators.keyed import exact_medians, weighted_medians
from quotelens.session import materialize_grouped
from quotelens.sources import readers
from quotelens.sources.readers import read_quotes_checked, read_quotes_csv

from test_edges import quotes


def rows(df):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def lines(spark):
    """Quotes over three batches, with a missing quote, product, margin and competitor."""
    made = []
    for i in range(240):
        made.append({"quote_id": None if i % 40 == 39 else i % 50, "line_seq": i,
                     "product": None if i % 17 == 0 else f"H{i % 3}",
                     "gross_margin_rate": None if i % 13 == 0 else (i * 7 % 90 - 10) / 100,
                     "convert_to_order": i % 2, "estimated_gross_profit": float(i),
                     "competitor_count_available": None if i % 19 == 0 else i % 3,
                     "competitor_a": float(i) if i % 5 else None,
                     "min_competitor_price": 100.0 if i % 4 else None,
                     "price_gap_min_competitor_pct": float(i % 21 - 10) if i % 4 else None})
    return C.clean_quotes(quotes(spark, made))


def full(name, clean):
    return getattr(A, name)(clean)


@pytest.mark.parametrize("name", sorted(R.REPORTS))
def test_batches_equal_one_run(lines, name):
    state = R.summarise(lines.where("line_seq < 90"))
    state = R.merge(state, R.summarise(lines.where("line_seq >= 90 AND line_seq < 91")))
    state = R.merge(R.summarise(lines.where("line_seq >= 91")), state)
    assert rows(R.REPORTS[name](state)) == rows(full(name, lines))


@pytest.mark.parametrize("name", sorted(R.REPORTS))
def test_empty_state(lines, name):
    none = lines.where(F.lit(False))
    assert rows(R.REPORTS[name](R.summarise(none))) == rows(full(name, none))


def test_lines_sent_again_count_once(lines):
    known = lines.where("line_seq < 120")
    state = R.write_state(R.summarise(known))
    batch = lines.where("line_seq >= 60").withColumn("line_seq", F.col("line_seq") + 1000)
    assert R.fresh_lines(batch, known).count() == lines.where("line_seq >= 120").count()
    both = R.refresh(state, batch, known)
    assert rows(R.data_quality_kpis(both)) == rows(A.data_quality_kpis(lines))
    assert rows(both.shapes.select(*R.SHAPE_COLS, "n")) == rows(R.summarise(lines).shapes)


def test_one_hot_quote_takes_the_plain_layout(spark, lines):
    spark.conf.set("quotelens.hotKeyRows", "2")
    try:
        state = R.write_state(R.summarise(lines))
        assert rows(R.sweet_spot(state)) == rows(A.sweet_spot(lines))
    finally:
        spark.conf.unset("quotelens.hotKeyRows")


def test_weighted_medians_repeat_values(spark):
    data = [("a", 1.0, 3), ("a", 5.0, 3), ("a", None, 9), ("b", 2.0, 1), ("c", None, 4)]
    df = spark.createDataFrame(data, "k string, v double, n long")
    long = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert rows(weighted_medians(df, ["k"], "v", "n", "m")) == rows(exact_medians(long, ["k"], {"m": "v"}))


HEADER = "quote_id,product,qty,unit_price,note\n"


def test_rejected_cells_and_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,H1,2,10.5,x\n2,H1,two,NA,x\n3,H1,2.5,1e400,x\n4,H1\n")
    (tmp_path / "b.csv").write_text(HEADER + "5,H1,3.0,9,x\n6,H1,1,9,x,too,many\n9007199254740993,H1,99999999999,,\n")
    good, bad = read_quotes_checked(spark, str(tmp_path))
    assert [(r.quote_id, r.qty, r.unit_price) for r in good.orderBy("line_seq").collect()] == [
        (1, 2, 10.5), (2, None, None), (3, 2, float("inf")), (5, 3, 9.0), (9007199254740993, None, None)]
    got = [(r.file.rsplit("/", 1)[1], r.quote_id, r["column"], r["value"], r.reason)
           for r in bad.orderBy("line_seq", "column").collect()]
    assert got == [("a.csv", "2", "qty", "two", readers.NOT_A_NUMBER),
                   ("a.csv", "3", "qty", "2.5", readers.NOT_WHOLE),
                   ("a.csv", "4", None, "4,H1", readers.CELL_COUNT),
                   ("b.csv", "6", None, "6,H1,1,9,x,too,many", readers.CELL_COUNT),
                   ("b.csv", "9007199254740993", "qty", "99999999999", readers.OUT_OF_RANGE)]
    places = {r.line_seq for r in good.collect()} | {r.line_seq for r in bad.collect()}
    assert len(places) == 7   # a line has the same place in both tables


def test_clean_file_rejects_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,H1,2,10.5,x\n,,,,\n")
    good, bad = read_quotes_checked(spark, str(tmp_path / "a.csv"))
    assert bad.count() == 0
    assert rows(good) == rows(read_quotes_csv(spark, str(tmp_path / "a.csv")))


def test_unlike_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,H1,2,10.5,x\n")
    (tmp_path / "b.csv").write_text("product,quote_id,qty,unit_price,note\nH1,1,2,10.5,x\n")
    with pytest.raises(Exception, match="header"):
        read_quotes_checked(spark, str(tmp_path))[0].collect()


def test_lines_of_a_grouped_table_are_matched_without_an_exchange(spark, lines):
    table = materialize_grouped(lines, "grouped", "quote_id", ["line_seq"])
    known, batch = table.where("line_seq < 120"), table.where("line_seq >= 60")
    fresh = R.fresh_lines(batch, known)
    assert rows(fresh) == rows(lines.where("line_seq >= 120"))
    assert "Exchange hashpartitioning" not in fresh._jdf.queryExecution().executedPlan().toString()


def test_a_refresh_writes_the_fresh_lines_once(spark, lines, monkeypatch):
    written = []
    monkeypatch.setattr(R, "materialize", lambda df, name, real=R.materialize: written.append(name) or real(df, name))
    known = lines.where("line_seq < 120")
    R.refresh(R.write_state(R.summarise(known)), lines.where("line_seq >= 60"), known)
    assert written.count("fresh") == 1


def test_equal_lines_of_a_batch_all_stay(lines):
    known = lines.where("line_seq < 120")
    batch = lines.where("line_seq >= 60")
    twice = batch.unionByName(batch.withColumn("line_seq", F.col("line_seq") + 1000))
    want = lines.where("line_seq >= 120")
    assert rows(R.fresh_lines(twice, known)) == rows(want.unionByName(want.withColumn("line_seq", F.col("line_seq") + 1000)))
