"""Queries of the package beside their SQL on the smallest tables."""

import duckdb
import pytest

from sievelight.llm import queries

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, expected = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[expected.columns.index(c)]) for c in order) for r in expected.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_covers_its_table(spark, name):
    df = queries.queries()[name](spark, SF)
    if name == "op3_decontamination":
        assert df.where("similarity < 0.8").count() == 0 and df.count() > 0
    else:
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_learned_models_hold_out_of_sample(spark):
    """On texts and labels that they did not learn from, at a size where there is enough to learn."""
    sf = "/root/testdata/sf0.01"
    r = queries.queries()["op9_quality_classifier"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert r.where("predicted = quality").count() >= 0.95 * r.count()
    s = queries.queries()["op2_lm_scoring"](spark, sf)
    known, unknown = (s.where(c).selectExpr("sum(score) / sum(n_tokens)").first()[0] for c in ("not held_out", "held_out"))
    assert unknown < known < 0


def test_the_trie_beats_the_unigrams_on_texts_that_it_did_not_see(spark):
    """With enough to learn from: at a tenth of this size the unigrams are still better."""
    s = queries.queries()["op2_lm_scoring"](spark, "/root/testdata/sf0.1").where("held_out")
    score, base = s.selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base
