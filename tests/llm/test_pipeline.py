"""The corpus pipeline: each stage on all its predecessor kept, against brute force."""

import re

import corpus_pipeline
import __spark_entry__ as E
from quotelens.llm import common, decontamination, mixing, toxicity
from test_operators import exact_brute, near_brute, overlaps_brute

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = common.table(spark, SMALL, "documents")
    columns = docs.columns
    benchmark = [r.text for r in common.table(spark, SMALL, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    kept = [common.staged(docs, "test")]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(common.staged(stage(spark, kept[-1], SMALL), f"test-{name}"))
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    assert all(k.columns == columns for k in kept[:-1])
    labels = common.table(spark, SMALL, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    score = dict(zip(rows[0], model.score(list(rows[0].values()))))
    assert set(rows[1]) == {i for i, p in score.items() if p < toxicity.THRESHOLD}
    assert set(rows[2]) == {i for i, _, _, stays, _ in exact_brute(list(rows[1].items())) if stays}
    assert set(rows[3]) == {i for i, (_, c) in near_brute(list(rows[2].items())).items() if c == i}
    assert set(rows[4]) == {i for i, t in rows[3].items() if not any(overlaps_brute(t, b) for b in benchmark)}
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in rows[4].values())
    taken = kept[5].agg({"mix_words": "sum"}).first()[0]
    assert abs(taken - words) <= 20  # one rounded target per source
    assert set(rows[5]) <= set(rows[4])


def test_run_is_registered_and_keeps_the_stages_results(spark):
    out = E.queries()["pipeline"](spark, SMALL)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.count() > 0 and "pipeline" not in E.oracle_sql()
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q)[0] for q in E.queries() if re.match(r"op\d+_", q)}


def test_oracles_of_the_operators(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name in ("op3_exact_dedup", "op6_line_dedup", "op11_lexical_search", "op12_topk_search", "op13_clustering"):
        got = E.queries()[name](spark, SMALL).toPandas()
        want = con.execute(E.oracle_sql()[name]).df()[list(got.columns)]
        assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
