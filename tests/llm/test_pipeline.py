"""Each stage against brute force on a small table with nulls, ties, repeated rows, long texts and clashing names."""

import random

import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, documents, prose
from tests.llm.test_models_and_dedup import ITEM
from tests.llm.test_rules_and_scans import WORD, base_spans
from tests.llm.test_secrets import rule
from tests.llm.test_similar import edited, groups

SF = "/root/testdata/sf0.001"


def key(r):
    return tuple((x is None, str(x)) for x in r)


def rows():
    rng = random.Random(21)
    out = documents()
    base = prose(rng, 200)
    out += [(200 + k, edited(rng, base, 0.01), "en", "src1", 0) for k in range(6)]
    out += [(300, prose(rng, 30) + " " + ITEM + " " + prose(rng, 20), "en", "src0", 0), (None, "x y " + ITEM, "en", None, 0), (None, prose(rng, 40), "en", None, 0)]
    out += [(301, "key Zq8x1LmP0vR7tY2uW5sD9fGhJ4kB6nC3aE end of the line", "en", "src0", 0)]
    return [(r[0], r[1], r[2], r[3], r[4]) for r in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit("clash") for c in ("spans", "fp", "size", "score", "_row", "similarity")}).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    items = [(1, ITEM), (2, None), (3, ""), (4, "unseen words of another item stand here alone and far from all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i < 86), 0) for i in range(100)] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def kept(df):
    return sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()), key=key)


def test_the_classifier_judges_equal_texts_alike(spark, table, folder):
    out = corpus_pipeline.classify(spark, table, folder)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    got = kept(out)
    texts = {r[1] for r in got}
    assert got == sorted((r for r in rows() if r[1] in texts), key=key)  # rows of one text go or stay together


def test_one_row_of_each_group_stays(spark, table, folder):
    got = kept(corpus_pipeline.deduplicate(spark, table, folder))
    data = rows()
    root, first = groups(data), {}
    for i, r in enumerate(data):
        order = (r[0] is None, r[0] or 0)
        first[root[i]] = min(first.get(root[i], order), order)
    assert sorted((x[0] is None, x[0] or 0) for x in got) == sorted(first.values())
    assert all(x in data for x in got)


def test_rows_with_a_passage_go_and_others_stay(spark, table, folder):
    got = kept(corpus_pipeline.decontaminate_benchmark(spark, table, folder))
    item = ITEM.lower().split()
    holds = lambda t: any(w[i : i + len(item)] == item for w in [(t or "").lower().split()] for i in range(len(w)))
    assert got == sorted((r for r in rows() if not holds(r[1])), key=key) and len(got) == len(rows()) - 2


def test_secrets_are_cut_and_no_row_goes(spark, table, folder):
    data = rows()
    random_ = rule([r[1] for r in data])
    expected = []
    for i, r in enumerate(data):
        spans = sorted([tuple(map(int, s.split(":")[1:])) for s in base_spans(r[1])] + random_[i])
        out, at = "", 0
        for s, e in spans:
            out, at = (out + r[1][at:s] + "[SECRET]" if s >= at else out), max(at, e)
        text = r[1] if not spans else out + r[1][at:]
        expected.append((r[0], text, r[2], r[3], r[4] if text is None else len(text)))
    assert kept(corpus_pipeline.redact_secrets(spark, table, folder)) == sorted(expected, key=key)
    assert sum("[SECRET]" in (r[1] or "") for r in expected) >= 3


def test_the_mix_takes_what_it_says(spark, table, folder):
    out = corpus_pipeline.mix(spark, table, folder).collect()
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    taken, target = {}, {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 < r["taken"] <= 3 * len(WORD.findall(r["text"])) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - target[s]) < 1 for s in taken) and abs(sum(target.values()) - sum(sizes.values())) < 1


def test_stages_stand_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or tuple(out.columns) == corpus_pipeline.COLUMNS)


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= n
        n = docs.count()
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["taken"]) for r in got.collect()) == sorted((r["doc_id"], r["taken"]) for r in docs.collect())
