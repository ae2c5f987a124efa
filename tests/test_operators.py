"""Known answers and properties of the audit operators."""

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sievelight.functions import scalars as fn
from sievelight.operators import bootstrap, duplicates, metrics, models, neighbours, qc, queues, ranking, review, splits
from sievelight.sources import readers, sinks


def one(df):
    return df.first().asDict()


def col(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_macro_f1_with_an_absent_class(spark):
    counts = spark.createDataFrame([(0, 0, 2), (1, 0, 1), (1, 1, 1)], "truth int, predicted int, n long")
    assert math.isclose(one(metrics.macro_metrics(counts, [0, 1, 2]))["macro_f1"], (0.8 + 2 / 3) / 3)
    recalls = {r["class"]: r["recall_or_null"] for r in metrics.per_class(counts, [0, 1, 2]).collect()}
    assert recalls == {0: 1.0, 1: 0.5, 2: None}


def scored(spark, rows):
    return spark.createDataFrame([(f"s{i:03d}", bool(e), float(s)) for i, (e, s) in enumerate(rows)], "sample_id string, event boolean, score double")


def test_review_budget(spark):
    df = scored(spark, [(i in (0, 2), 10 - i) for i in range(10)])
    r = one(ranking.review_budgets(df, F.col("event"), "score", "sample_id", [0.2]))
    assert (r["reviewed"], r["found"], r["precision"], r["recall"], r["expected_random_recall"], r["lift"]) == (2, 1, 0.5, 0.5, 0.2, 2.5)
    assert col(spark, fn.budget_count(F.lit(10), 0.01)) == 1 and col(spark, fn.budget_count(F.lit(100), 0.07)) == 8


def test_no_events(spark):
    df = scored(spark, [(False, i) for i in range(20)])
    r = one(ranking.review_budgets(df, F.col("event"), "score", "sample_id", [0.1]))
    assert r["recall"] is None and r["lift"] is None and r["found"] == 0 and r["precision"] == 0.0
    assert one(ranking.average_precision(df, F.col("event"), "score"))["average_precision"] is None
    assert one(ranking.auroc(df, F.col("event"), "score"))["auroc"] is None


def test_auroc(spark):
    assert one(ranking.auroc(scored(spark, [(i >= 5, i) for i in range(10)]), F.col("event"), "score"))["auroc"] == 1.0
    assert one(ranking.auroc(scored(spark, [(i >= 5, 1) for i in range(10)]), F.col("event"), "score"))["auroc"] == 0.5


def test_average_precision_takes_ties_together(spark):
    rng = np.random.default_rng(1)
    rows = [(bool(rng.random() < 0.3), int(rng.integers(0, 6))) for _ in range(200)]
    got = one(ranking.average_precision(scored(spark, rows), F.col("event"), "score"))["average_precision"]
    e, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    expected, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        recall, precision = e[s >= t].sum() / e.sum(), e[s >= t].mean()
        expected, last = expected + (recall - last) * precision, recall
    assert math.isclose(got, expected)


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 13).cast("double").alias("x")).repartition(5)
    got = ranking.rank_rows(df, "x", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r["x"], r["id"]) for r in got] == sorted(((r["x"], r["id"]) for r in got), key=lambda p: (-p[0], p[1]))


def test_percentiles(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "id int, x double")
    got = {r["id"]: r["percentile"] for r in ranking.percentile_normalise(df, "x").collect()}
    assert got == {3: 0.0, 1: 0.5, 2: 0.5, 4: 1.0}
    assert one(ranking.percentile_normalise(df.where("id = 1"), "x"))["percentile"] == 0.5


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "id int, p double")
    got = {r["id"]: round(r["adjusted"], 12) for r in ranking.holm(df, "p", "id").collect()}
    assert got == {0: 0.03, 1: 0.06, 2: 0.06}


@pytest.mark.parametrize("rows,events,status", [(100, 10, "reported"), (99, 10, "insufficient_support"), (100, 9, "insufficient_support")])
def test_support_gate(spark, rows, events, status):
    df = scored(spark, [(i < events, i) for i in range(rows)]).withColumn("g", F.lit("a"))
    assert one(ranking.subgroup_average_precision(df, F.col("event"), "score", ["g"]))["status"] == status


P = [[0.7, 0.2, 0.1], [0.2, 0.5, 0.3], [0.1, 0.1, 0.8]]


def test_risks(spark):
    df = spark.createDataFrame([(i, p, y) for i, (p, y) in enumerate(zip(P, (10, 10, 90)))], "id int, probs array<double>, y int")
    classes = (10, 30, 90)
    r = df.select("id", *[fn.risk(m, F.col("probs"), F.col("y"), classes).alias(m) for m in ("confidence", "nll", "margin", "entropy")], fn.predicted_class(F.col("probs"), classes).alias("p")).orderBy("id").collect()
    assert [round(x["confidence"], 9) for x in r] == [0.3, 0.8, 0.2] and [x["p"] for x in r] == [10, 30, 90]
    assert math.isclose(r[1]["nll"], -math.log(0.2)) and math.isclose(r[1]["margin"], 0.3) and math.isclose(r[0]["entropy"], -sum(p * math.log(p) for p in P[0]))
    with pytest.raises(ValueError):
        fn.risk("unheard of", F.col("probs"), F.col("y"), classes)
    bad = spark.createDataFrame([([0.5, 0.6],), ([float("nan"), 1.0],), ([1.0],), (None,), ([0.5, 0.5],)], "p array<double>")
    assert [x[0] for x in bad.select(fn.valid_probabilities(F.col("p"), 2)).collect()] == [False, False, False, False, True]


def test_ensemble(spark):
    models_ = [
        [[0.8, 0.1, 0.1], [0.7, 0.2, 0.1], [0.1, 0.8, 0.1]],
        [[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.1, 0.7, 0.2]],
        [[0.9, 0.05, 0.05], [0.1, 0.1, 0.8], [0.1, 0.2, 0.7]],
    ]
    rows = [(f"s{i}", m, y, p) for m, t in enumerate(models_) for i, (p, y) in enumerate(zip(t, (10, 30, 90)))]
    df = spark.createDataFrame(rows, "sample_id string, model_id int, observed_label int, probs array<double>")
    got = review.ensemble_disagreement(df, (10, 30, 90)).orderBy("sample_id").collect()
    assert [round(r["variation_ratio"], 9) for r in got] == [0.0, round(2 / 3, 9), round(1 / 3, 9)]
    assert [round(r["pairwise_disagreement"], 9) for r in got] == [0.0, 1.0, round(2 / 3, 9)]
    assert all(0 <= r["mean_js_divergence"] <= math.log(2) for r in got)


def test_persistent_risk(spark):
    table = np.zeros((3, 3, 3))
    table[:, :, 0] = 0.9
    table[0, :, 1] = 0.9
    table[:, 0, 2] = 0.9
    rows = [(m, c, f"s{i}", float(table[m, c, i])) for m in range(3) for c in range(3) for i in range(3)]
    got = review.persistent_risk(spark.createDataFrame(rows, "model_id int, checkpoint int, sample_id string, risk double"), threshold=0.7, checkpoint_share=2 / 3, model_share=2 / 3).orderBy("sample_id").collect()
    assert [r["persistent"] for r in got] == [True, False, False] and [r["priority"] for r in got] == [1.0, 0.0, 0.0]


def test_votes(spark):
    samples = [(f"s{i}", y, i > 0, i == 2, i == 5, i == 6) for i, y in enumerate((0, 0, 0, 0, 0, 1, 0))]
    s = spark.createDataFrame(samples, "sample_id string, observed_label int, reviewed boolean, ambiguous boolean, insufficient boolean, technical boolean")
    votes = {"s1": [0, 0, 0], "s2": [0, 1], "s3": [0, 0, 1], "s4": [1, 1, 1], "s5": [1], "s6": [0]}
    v = spark.createDataFrame([(k, j, x) for k, xs in votes.items() for j, x in enumerate(xs)], "sample_id string, reviewer_id int, vote int")
    got = review.resolve_votes(s, v).orderBy("sample_id").collect()
    assert [r["action"] for r in got] == ["keep", "keep", "soft_label", "soft_label", "hard_change", "exclude", "exclude"]
    assert [r["hard_label"] for r in got] == [0, 0, 0, 0, 1, 1, 0] and [r["weight"] for r in got] == [1, 1, 0.5, 0.5, 1, 0, 0]
    assert got[2]["soft_label"] == {0: 0.5, 1: 0.5} and {k: round(x, 9) for k, x in got[3]["soft_label"].items()} == {0: round(2 / 3, 9), 1: round(1 / 3, 9)}


def samples(spark, n=60, d=4, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i:03d}", f"g{i % 10}", i % 10 % 5, f"t{i % 3}", int(i % 3), [float(x) for x in rng.normal(size=d) + (i % 3)]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, group_id string, fold_id int, tissue string, observed_label int, features array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_against_brute_force(spark, metric):
    df = samples(spark)
    got = {}
    for r in neighbours.nearest_neighbours(df, k=4, metric=metric, query_blocks=3, reference_blocks=2).collect():
        got.setdefault(r["sample_id"], []).append((r["rank"], r["neighbour_id"], r["distance"]))
    rows = df.collect()
    for q in rows:
        refs = [r for r in rows if r["fold_id"] != q["fold_id"]]
        x = np.array([r["features"] for r in refs])
        m, s = x.mean(0), x.std(0)
        a = (np.array(q["features"]) - m) / s
        near = []
        for r in refs:
            if r["group_id"] == q["group_id"]:
                continue
            b = (np.array(r["features"]) - m) / s
            dist = np.linalg.norm(a - b) if metric == "euclidean" else 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
            near.append((dist, r["sample_id"]))
        near = sorted(near)[:4]
        assert [x[1] for x in sorted(got[q["sample_id"]])] == [n for _, n in near]
        assert np.allclose([x[2] for x in sorted(got[q["sample_id"]])], [dist for dist, _ in near])


def test_queue_caps(spark):
    rows = [(f"s{i}", 1.0 - i / 10, f"g{i // 2}", i % 3, f"t{i % 2}", f"{i % 3}->{(i + 1) % 3}", [math.cos(i), math.sin(i)]) for i in range(8)]
    df = spark.createDataFrame(rows, "sample_id string, risk double, group_id string, observed_label int, tissue string, transition string, features array<double>")
    chosen, rejected = queues.balanced_queue(df, "risk", 4, queues.Quotas(group=1, label=2, tissue=2, transition=2, min_cosine=0.05))
    got = chosen.collect()
    assert len(got) == 4 and len({r["group_id"] for r in got}) == 4
    assert max(sum(r["observed_label"] == c for r in got) for c in range(3)) <= 2
    assert {r["rejected_by"]: r["n"] for r in rejected.collect()}["group_quota"] >= 1
    only_group = queues.balanced_queue(df, "risk", 4, queues.Quotas(group=1))[0]
    window = queues.group_quota_queue(df, "risk", "sample_id", "group_id", 1, 4)
    assert {r["sample_id"] for r in only_group.collect()} == {r["sample_id"] for r in window.collect()}


def test_model_queue_needs_cross_fitted_evidence(spark):
    df = samples(spark).withColumn("risk", F.rand(1)).withColumn("lower", F.rand(2))
    assert queues.model_queue_priority(df, "risk", "lower", 0.0, "in_sample").count() == 0
    assert queues.model_queue_priority(df, "risk", "lower", 0.0, "cross_fitted").count() == 60


def test_matched_comparator_is_all_or_nothing(spark):
    df = samples(spark).withColumn("risk", fn.unit_hash(1, "sample_id"))
    top = ranking.top_n(df, "risk", "sample_id", 10)
    got = queues.matched_random(top, df, ["observed_label"], 5)
    assert got.count() == 10 and got.join(top, "sample_id").count() == 0
    assert queues.matched_random(top, top, ["observed_label"], 5).count() == 0


def test_corruption(spark):
    df = samples(spark)
    for out in (
        splits.corrupt_symmetric(df, 0.1, (0, 1, 2), 1),
        splits.corrupt_targeted(df, 10, splits.next_class_matrix(3), (0, 1, 2), 1),
        splits.corrupt_by_group(df, 0.1, (0, 1, 2), 1, "group_id"),
        splits.corrupt_instances(df, 0.1),
    ):
        assert out.where("is_corrupted").count() == 6
        assert out.where("is_corrupted <> (pre_corruption_label <> observed_label)").count() == 0
    assert col(spark, fn.exact_corruption_count(F.lit(5), 0.5)) == 3
    assert fn.normalise_rate(1.5) == 0.015 and fn.normalise_rate(1) == 1.0
    with pytest.raises(ValueError):
        fn.normalise_rate(-0.1)


def test_splits_refuse_leaks(spark):
    df = samples(spark)
    parts = splits.fractional_split(df, "group_id", 0.2, 0.2, 3)
    assert splits.group_overlap(parts, "group_id", "partition").count() == 0 and {r[0] for r in parts.select("partition").distinct().collect()} == {"final", "validation", "development"}
    with pytest.raises(ValueError):
        splits.outer_split(df.withColumn("fold_id", F.col("observed_label")), "group_id", "fold_id", 0, 0.5, 1)
    plan = splits.group_fold_plan(df, "group_id", "observed_label", 5, 0)
    assert sorted(plan["group_id"]) == sorted({r["group_id"] for r in df.collect()}) and set(plan["fold"]) == set(range(5))


def test_reference_groups(spark):
    rows = [(f"g{g:02d}", c) for g in range(12) for c in range(5)]
    df = spark.createDataFrame(rows, "group_id string, label int")
    chosen = splits.reference_groups(df, "group_id", "label", 0.1, 1)
    assert len(chosen) == 2 and df.where(F.col("group_id").isin(chosen)).select("label").distinct().count() == 5


def test_multiplicity_average_precision_equals_expanded(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(f"g{int(rng.integers(0, 5))}", bool(rng.random() < 0.4), float(rng.integers(0, 8))) for _ in range(120)], "grp string, event boolean, score double")
    draws = bootstrap.group_draws(df, "grp", 10, 3)
    assert {r["n"] for r in draws.groupBy("draw").agg(F.sum("multiplicity").alias("n")).collect()} == {5}
    fast = {r["draw"]: r["score"] for r in bootstrap.bootstrap_average_precision(df, F.col("event"), ["score"], "grp", draws).collect()}
    expanded = df.join(draws, "grp").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("multiplicity").cast("int"))))
    slow = {r["draw"]: r["average_precision"] for r in ranking.average_precision(expanded, F.col("event"), "score", by=["draw"]).collect()}
    assert fast.keys() == slow.keys() and all(math.isclose(fast[k], slow[k]) for k in fast)


def test_guard(spark):
    rows = [(f"g{i // 2}", i % 2, 1 - i % 2, i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "grp string, truth int, base int, cand int")
    r = one(bootstrap.retraining_guard(df, "truth", "base", "cand", "grp", (0, 1), bootstrap.group_draws(df, "grp", 20, 1)))
    assert r["decision"] == "apply_candidate" and (r["low"], r["high"]) == (1.0, 1.0)
    alone = df.withColumn("grp", F.lit("g"))
    r = one(bootstrap.retraining_guard(alone, "truth", "base", "cand", "grp", (0, 1), bootstrap.group_draws(alone, "grp", 20, 1)))
    assert r["decision"] == "keep_baseline" and r["low"] is None


def test_duplicates(spark):
    df = spark.createDataFrame([(0, "a", "ffffffffffffffff", 0, [1.0, 0.0]), (1, "a", "fffffffffffffff0", 1, [0.999, 0.01]), (2, "b", "0000000000000000", 0, [0.0, 1.0])], "id int, c string, h string, fold int, v array<double>")
    assert [(r["a_id"], r["b_id"]) for r in duplicates.exact_duplicates(df, "id", "c", "fold").collect()] == [(0, 1)]
    assert [(r["a_id"], r["b_id"], r["hamming"]) for r in duplicates.perceptual_duplicates(df, "id", "h", "fold").collect()] == [(0, 1, 4)]
    assert [(r["a_id"], r["b_id"]) for r in duplicates.embedding_duplicates(df, "id", "v", "fold", blocks=2).collect()] == [(0, 1)]
    image = spark.createDataFrame([(0, [float(x) for x in range(256)], 16, 16), (1, [255.0] * 256, 16, 16)], "id int, p array<double>, h int, w int")
    got = {r["id"]: r["average_hash"] for r in duplicates.average_hash(image, "id", "p", "h", "w").collect()}
    assert got[0] == "00000000ffffffff" and got[1] == "f" * 16


def test_counts_of_duplicates_are_those_of_the_pairs(spark):
    rng = np.random.default_rng(8)
    some = lambda values: values[rng.integers(len(values))]
    rows = [(some([None, *range(150)]), some(["a", "a", "b", "", None, f"c{i % 90}"]), some([None, 0, 1, 2])) for i in range(400)]  # ids repeat
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "id long, c string, fold int").withColumn("id", F.col("id").cast(kind))
        for across in (True, False):
            pairs = {}
            ids = [(None if i is None else str(i) if kind == "string" else i, c, f) for i, c, f in rows]
            for i, c, f in ids:
                for j, d, g in ids:
                    if None not in (i, j, c) and c == d and i < j and not (across and (f is None or g is None or f == g)):
                        pairs[i] = pairs.get(i, 0) + 1
            made = duplicates.exact_duplicates(df, "id", "c", "fold", cross_fold_only=across).groupBy("a_id").count()
            counted = duplicates.exact_duplicate_counts(df, "id", "c", "fold", cross_fold_only=across)
            assert {r["a_id"]: r["count"] for r in made.collect()} == pairs == {r["a_id"]: r["n"] for r in counted.collect()}
            assert duplicates.exact_duplicate_counts(df.where("false"), "id", "c", "fold", cross_fold_only=across).count() == 0


def test_counts_of_duplicates_make_no_pairs(spark):
    n = 200_000  # two contents: 5 billion pairs in different folds
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"), F.expr("int(id % 4 / 2)").alias("fold"))
    got = {r["a_id"]: r["n"] for r in duplicates.exact_duplicate_counts(df, "id", "c", "fold").collect()}
    assert got == {i: (n - i + 1) // 4 for i in range(n) if (n - i + 1) // 4}


def test_oof_predictions_cover_rows_once(spark):
    out = models.oof_logistic(samples(spark), "observed_label", (0, 1, 2))
    assert splits.coverage_violations(out, "sample_id").count() == 0 and out.where(~fn.valid_probabilities(F.col("probs"), 3)).count() == 0
    with pytest.raises(ValueError):
        models.oof_logistic(samples(spark).withColumn("group_id", F.lit("g")), "observed_label", (0, 1, 2))


def test_ridge_and_conformal(spark):
    df = spark.createDataFrame([([float(i), float(i * i)], 0.5 + 2.0 * i) for i in range(10)], "features array<double>, y double")
    assert np.allclose(models.ridge(df, "y", 0.0), [2.0, 0.0, 0.5])
    r = spark.createDataFrame([(float(i),) for i in range(10)], "r double")
    assert models.conformal_radius(r, "r", 0.1) == 9.0 and models.conformal_radius(r, "r", 0.5) == 6.0


def test_rules_fail_closed(spark):
    df = samples(spark)
    with pytest.raises(ValueError):
        qc.join_one_to_one(df.unionByName(df), df, "sample_id")
    with pytest.raises(ValueError):
        qc.lookup_in_order(df, spark.createDataFrame([("absent", 1)], "sample_id string, o int"), "sample_id", "o")
    with pytest.raises(ValueError):
        qc.map_labels(df, "tissue", {"t0": "x"})
    with pytest.raises(ValueError):
        qc.collapse_to_parent(df, "group_id", ["observed_label"])
    assert qc.map_labels(df, "tissue", {"t0": "x", "t1": None, "t2": "y"}).where("mapped_label is null").count() == 20


def test_sources_and_sinks(spark, tmp_path):
    df = readers.synthetic_samples(spark)
    assert df.count() == 210 and df.select("observed_label").distinct().count() == 5
    path = str(tmp_path / "s.parquet")
    sinks.write_validated(df, path, qc.rule_violations(df, "sample_id", {"no_group": F.col("group_id").isNull()}))
    with pytest.raises(AnalysisException):
        sinks.write_validated(df, path)
    assert readers.read_manifest(spark, path, required=["sample_id"]).count() == readers.row_count(spark, path) == 210
    sinks.write_rankings(df.withColumn("risk", fn.unit_hash(1, "sample_id")), str(tmp_path / "r"), "risk", 5)
    assert spark.read.option("header", True).csv(str(tmp_path / "r/top_overall")).count() == 5
    (tmp_path / "a.csv").write_text("sample_id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("sample_id,x\n2,2\n")
    union = readers.read_csv_union(spark, str(tmp_path / "*.csv"), required=["x"], anchor=["source_stem", "sample_id"])
    assert {r["source_stem"] for r in union.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        readers.read_manifest(spark, str(tmp_path / "a.csv"), required=["absent"])
    np.save(tmp_path / "v.npy", np.arange(12.0).reshape(3, 4))
    assert [r["values"] for r in readers.read_npy(spark, str(tmp_path / "v.npy")).orderBy("row").collect()][1] == [4.0, 5.0, 6.0, 7.0]
    np.savez(tmp_path / "v.npz", m=np.ones((2, 2)))
    assert readers.read_npz(spark, str(tmp_path / "v.npz"), "m").count() == 2
    (tmp_path / "f.geojson").write_text('{"features": [{"properties": {"classification": {"name": "tumor"}}, "geometry": {"coordinates": [[[1,2],[4,2],[4,7]]]}}]}')
    g = readers.read_geojson(spark, str(tmp_path / "f.geojson")).first()
    assert (g["raw_label"], g["x0"], g["y1"], g["centre_x"], g["centre_y"]) == ("tumor", 1.0, 7.0, 2, 4)
    (tmp_path / "r.xml").write_text('<A><Region Id="1"><Vertices><Vertex X="0" Y="0"/><Vertex X="1" Y="0"/><Vertex X="1" Y="1"/></Vertices></Region><Region Id="2"><Vertices><Vertex X="0" Y="0"/><Vertex X="1" Y="0"/></Vertices></Region></A>')
    assert [r["region_id"] for r in readers.read_xml_regions(spark, str(tmp_path / "r.xml")).collect()] == ["1"]
    assert readers.inventory(spark, str(tmp_path / "a.csv")).first()["size"] == 16
    (tmp_path / "c.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        readers.load_config(str(tmp_path / "c.json"))
    chain = sinks.chain_records([{"a": 1}, {"a": 2}])
    assert sinks.verify_chain(chain) and not sinks.verify_chain([chain[0] | {"a": 3}, chain[1]])


def test_soft_targets_and_perceptron(spark):
    df = samples(spark).withColumn("targets", F.transform(F.array(*[F.lit(c) for c in range(3)]), lambda c: F.when(c == F.col("observed_label"), 0.8).otherwise(0.1))).withColumn("weight", F.lit(1.0))
    for predict in (models.soft_logistic(df, "targets", (0, 1, 2)), models.perceptron(df, "observed_label", (0, 1, 2), hidden=4, max_iter=20)):
        out = predict(df)
        assert out.count() == 60 and out.where(~fn.valid_probabilities(F.col("probs"), 3)).count() == 0
        assert out.where(fn.predicted_class(F.col("probs"), (0, 1, 2)) == F.col("observed_label")).count() > 30


def test_small_functions(spark):
    row = spark.range(1).select(
        fn.spread_indices(F.lit(10), F.lit(4)).alias("spread"),
        fn.spread_indices(F.lit(3), F.lit(5)).alias("all"),
        fn.normalise_label(F.lit("  Correction_Tumor ")).alias("label"),
        fn.normalise_label(F.lit("  ")).alias("blank"),
        fn.hamming_hex(F.lit("ff"), F.lit("0f")).alias("bits"),
        fn.box_centre(F.lit(1), F.lit(2)).alias("low"),
        fn.box_centre(F.lit(1), F.lit(2), half_even=True).alias("even"),
        fn.ratio(F.lit(1), F.lit(0)).alias("ratio"),
    ).first()
    assert (row["spread"], row["all"], row["label"], row["blank"], row["bits"], row["low"], row["even"], row["ratio"]) == ([0, 3, 6, 9], [0, 1, 2], "tumor", None, 4, 1, 2, None)


def test_finalists_have_to_be_exact(spark):
    from sievelight.operators import studies

    c = spark.createDataFrame([(f"c{i}", f"m{i % 2}", 1, i, float(i), 0.1) for i in range(6)], "candidate_sha string, risk_method string, budget int, complexity int, objective double, effect double")
    out = {r["pool"]: r["candidate_sha"] for r in studies.exact_finalists(c, [f"c{i}" for i in range(6)], models.pick_winner, "m1").collect()}
    assert out == {"all": "c5", "without_m1": "c4"}
    with pytest.raises(ValueError):
        studies.exact_finalists(c, ["c0"], models.pick_winner, "m1")
    halved = models.successive_halving(c, [("one", 4, lambda x: x), ("two", 2, lambda x: x.withColumn("objective", -F.col("objective")))])
    assert {r["candidate_sha"] for r in halved.collect()} == {"c2", "c3"}
