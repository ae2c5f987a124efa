"""Validation operators and the models' queries against small exact computations."""

import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import bootstrap, models, queues, ranking, splits, validation
from sievelight.sources import readers, sinks

CLASSES = (0, 1, 2)


def rows(n=180, groups=12, folds=3, seed=3, noise=0.2):
    """Grouped samples of three classes in four features, some labels wrong."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        g = i % groups
        y = int(rng.integers(0, 3))
        x = rng.normal(0, 1, 4) + np.eye(4)[y] * 2.5
        bad = bool(rng.random() < noise)
        seen = int((y + rng.integers(1, 3)) % 3) if bad else y
        out.append((f"s{i:04d}", f"g{g:02d}", g % folds, f"t{i % 2}", seen, y, bad, [float(v) for v in x]))
    return out


SCHEMA = "sample_id string, group_id string, fold_id int, tissue string, observed_label int, reference_label int, is_corrupted boolean, features array<double>"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumn("pre_corruption_label", F.col("reference_label")).cache()


def fit_exactly(x, y, w, l2, rounds=200):
    """Multinomial logistic regression by Newton's method; Spark's loss is the weighted mean plus l2 / 2 of the squares."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std < 1e-12, 1.0, std)
    z = np.c_[(x - mean) / std, np.ones(len(x))]
    k, d = len(CLASSES), z.shape[1]
    b, total = np.zeros((k, d)), w.sum()
    penalty = np.diag(np.r_[np.full(d - 1, l2), 1e-9])
    onehot = np.eye(k)[y]
    for _ in range(rounds):
        s = z @ b.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = (((p - onehot) * w[:, None]).T @ z) / total + b @ penalty
        h = np.zeros((k * d, k * d))
        for i in range(k):
            for j in range(k):
                c = w * p[:, i] * ((i == j) - p[:, j]) / total
                h[i * d : (i + 1) * d, j * d : (j + 1) * d] = (z * c[:, None]).T @ z + (i == j) * penalty
        step = np.linalg.solve(h + 1e-10 * np.eye(k * d), gradient.ravel()).reshape(k, d)
        b -= step
        if np.abs(step).max() < 1e-10:
            break

    def predict(q):
        s = np.c_[(q - mean) / std, np.ones(len(q))] @ b.T
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    return predict


def test_out_of_fold_logistic_equals_an_exact_solver(spark, samples):
    got = {r["sample_id"]: r["probs"] for r in models.oof_logistic(samples, "observed_label", CLASSES, l2=1e-2).collect()}
    data = rows()
    x, y, fold = np.array([r[7] for r in data]), np.array([r[4] for r in data]), np.array([r[2] for r in data])
    assert len(got) == len(data)
    for f in range(3):
        inside = fold != f
        w = np.array([inside.sum() / (3 * (y[inside] == c).sum()) for c in y[inside]])
        expected = fit_exactly(x[inside], y[inside], w, 1e-2)(x[~inside])
        for r, p in zip([d for d, i in zip(data, inside) if not i], expected):
            assert np.allclose(got[r[0]], p, atol=2e-3)


def test_soft_targets_of_one_class_equal_hard_labels(samples):
    hard = F.transform(F.lit(list(CLASSES)), lambda c: (c == F.col("observed_label")).cast("double"))
    soft = models.soft_logistic(samples.withColumn("t", hard).withColumn("weight", F.lit(1.0)), "t", CLASSES, l2=1e-2)(samples)
    plain = models.logistic(samples, "observed_label", CLASSES, l2=1e-2)(samples)
    both = soft.select("sample_id", F.col("probs").alias("p")).join(plain.select("sample_id", F.col("probs").alias("q")), "sample_id").collect()
    assert max(abs(a - b) for r in both for a, b in zip(r["p"], r["q"])) < 1e-3


def test_ridge_and_radius_equal_their_formulas(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(f"s{i}", [float(v) for v in x[i]], float(y[i])) for i in range(60)], "sample_id string, features array<double>, gain double")
    z = np.c_[x, np.ones(60)]
    expected = np.linalg.solve(z.T @ z + np.diag([0.7, 0.7, 0.7, 0.0]), z.T @ y)
    assert np.allclose(models.ridge(df, "gain", 0.7), expected, atol=1e-8)
    for m in (1, 2, 9, 10, 11, 60):
        for alpha in (0.05, 0.1, 0.5):
            residuals = np.sort(rng.normal(size=m))
            level = min(1.0, math.ceil((m + 1) * (1 - alpha)) / m)
            radius = models.conformal_radius(spark.createDataFrame([(float(v),) for v in residuals], "r double"), "r", alpha)
            assert math.isclose(radius, float(np.quantile(residuals, level, method="higher")))


def test_temperature_equals_a_search_in_numpy(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 1, 1], 200)
    sharp = p**3 / (p**3).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    df = spark.createDataFrame([([float(v) for v in q], t) for q, t in zip(sharp, y)], "probs array<double>, y int")

    def loss(t):
        s = np.log(np.clip(sharp, 1e-15, 1)) / t
        e = np.exp(s - s.max(1, keepdims=True))
        return -np.log(np.clip((e / e.sum(1, keepdims=True))[np.arange(200), y], 1e-15, 1)).mean()

    assert models.best_temperature(df, "probs", "y", CLASSES) == min(models.GRID, key=loss)


def walk(table, n, caps, cosine):
    """The greedy queue in plain Python: (selected ids, rejections by rule)."""
    taken, vectors, chosen, rejected = {}, [], [], {}
    for r in sorted(table, key=lambda r: (-r["risk"], r["sample_id"])):
        if len(chosen) == n:
            break
        why = next((f"{name}_quota" for name, c, cap in caps if taken.get((c, r[c]), 0) >= cap), None)
        v = np.array(r["features"]) / max(np.linalg.norm(r["features"]), 1e-12)
        if why is None and cosine is not None and any(1 - float(u @ v) < cosine for u in vectors):
            why = "similarity"
        if why:
            rejected[why] = rejected.get(why, 0) + 1
            continue
        chosen.append(r["sample_id"])
        vectors.append(v)
        for _, c, _ in caps:
            taken[c, r[c]] = taken.get((c, r[c]), 0) + 1
    return chosen, rejected


def test_balanced_queue_equals_a_walk_in_python(spark, samples):
    s = samples.withColumn("risk", F.round(F.abs(F.element_at("features", 1)), 1)).withColumn("transition", F.concat_ws("->", "observed_label", "reference_label"))
    table = [r.asDict() for r in s.collect()]
    caps = [("group", "group_id", 3), ("class", "observed_label", 9), ("tissue", "tissue", 12), ("transition", "transition", 4)]
    for cosine in (None, 0.05, 0.3):
        selected, rejected = queues.balanced_queue(s, "risk", 20, queues.Quotas(group=3, label=9, tissue=12, transition=4, min_cosine=cosine))
        chosen, why = walk(table, 20, caps, cosine)
        assert [r["sample_id"] for r in selected.orderBy("queue_rank").collect()] == chosen
        assert {r["rejected_by"]: r["n"] for r in rejected.collect()} == why


def test_matched_random_takes_null_strata(spark):
    top = spark.createDataFrame([("a", None), ("b", "x")], "sample_id string, k string")
    eligible = spark.createDataFrame([("a", None), ("b", "x"), ("c", None), ("d", "x"), ("e", None)], "sample_id string, k string")
    picked = queues.matched_random(top, eligible, ["k"], 3).collect()
    assert sorted(str(r["k"]) for r in picked) == ["None", "x"] and not {r["sample_id"] for r in picked} & {"a", "b"}


def test_multicriteria_guard_equals_numpy(spark, samples):
    s = samples.withColumn("base", F.col("observed_label")).withColumn("better", F.when(F.crc32("sample_id") % 4 == 0, F.col("observed_label")).otherwise(F.col("reference_label")))
    draws = bootstrap.group_draws(s, "group_id", 60, 8)
    table, drawn = s.collect(), {}
    for r in draws.collect():
        drawn.setdefault(r["draw"], {})[r["group_id"]] = r["multiplicity"]

    def figures(weights, column):
        c = np.zeros((3, 3))
        for r in table:
            c[r["reference_label"], r[column]] += weights.get(r["group_id"], 0)
        true, all_true, all_said = np.diag(c), c.sum(1), c.sum(0)
        f1 = np.where(all_true + all_said > 0, 2 * true / np.maximum(all_true + all_said, 1e-12), 0.0)
        return f1.mean(), np.where(all_true > 0, true / np.maximum(all_true, 1e-12), np.nan)

    gains, recalls = [], []
    for weights in drawn.values():
        (b, rb), (c, rc) = figures(weights, "base"), figures(weights, "better")
        gains.append(c - b)
        recalls.append(rc - rb)
    got = bootstrap.multicriteria_guard(s, "reference_label", "base", "better", "group_id", CLASSES, draws).first()
    worst = min(np.nanquantile(np.array(recalls)[:, k], 0.025) for k in range(3))
    assert math.isclose(got["low"], np.quantile(gains, 0.025), abs_tol=1e-9) and math.isclose(got["worst_recall_low"], worst, abs_tol=1e-9)
    assert got["decision"] == ("apply_candidate" if got["low"] > 0 and worst >= -0.01 else "keep_baseline")


def test_group_plans_hold_their_rules(samples):
    plan = splits.group_fold_plan(samples, "group_id", "observed_label", 4, 3)
    assert sorted(plan["group_id"]) == sorted({r[1] for r in rows()}) and set(plan["fold"]) == {0, 1, 2, 3}
    fold = dict(zip(plan["group_id"], plan["fold"]))
    shares = np.zeros((4, 3))
    for r in rows():
        shares[fold[r[1]], r[4]] += 1
    assert (shares.sum(0) - shares > 0).all()  # every training side has every class
    assert plan.equals(splits.group_fold_plan(samples, "group_id", "observed_label", 4, 3))
    chosen = splits.reference_groups(samples, "group_id", "observed_label", 0.25, 4)
    counts = {}
    for r in rows():
        counts.setdefault(r[1], np.zeros(3))[r[4]] += 1
    total = sum(counts.values())
    inside = sum(counts[g] for g in chosen)
    assert len(chosen) == 3 and (inside > 0).all() and (total - inside > 0).all()
    first = min(counts, key=lambda g: np.abs(counts[g] / counts[g].sum() - total / total.sum()).sum())
    best = np.abs(counts[first] / counts[first].sum() - total / total.sum()).sum()
    assert np.abs(inside / inside.sum() - total / total.sum()).sum() <= best + 0.2


def test_audit_scores_by_name(samples):
    told = models.oof_logistic(samples, "observed_label", CLASSES, l2=1e-2).cache()
    one = {m: {r["sample_id"]: r["risk"] for r in validation.audit_scores(told, m, CLASSES).collect()} for m in ("nll", "self-confidence", "neighbour_disagreement", "fixed_hybrid")}
    assert all(len(x) == 180 for x in one.values())
    order = sorted(one["nll"], key=one["nll"].get)
    assert order == sorted(order, key=lambda i: (one["self-confidence"][i], one["nll"][i]))
    halves = [{k: (sum(v < x[k] for v in x.values()) + (sum(v == x[k] for v in x.values()) - 1) / 2) / 179 for k in x} for x in (one["self-confidence"], one["neighbour_disagreement"])]
    assert all(math.isclose(one["fixed_hybrid"][k], (halves[0][k] + halves[1][k]) / 2, abs_tol=1e-9) for k in halves[0])
    for bad in ("unknown", "fixed_hybrid"):
        with pytest.raises(ValueError):
            validation.audit_scores(told, bad, CLASSES, weights=(1.0,))


def macro(pairs):
    c = np.zeros((3, 3))
    for t, p, w in pairs:
        c[t, p] += w
    s = c.sum(1) + c.sum(0)
    return float(np.where(s > 0, 2 * np.diag(c) / np.maximum(s, 1e-12), 0.0).mean())


def test_downstream_summary_equals_numpy(spark):
    rng = np.random.default_rng(7)
    table = []
    for i in range(120):
        t = int(rng.integers(0, 3))
        for treatment, good, repeats in (("candidate", 0.85, 1), ("unchanged", 0.7, 1), ("random", 0.7, 2)):
            for seed in range(2):
                for r in range(repeats):
                    p = t if rng.random() < good else int(rng.integers(0, 3))
                    table.append((f"g{i % 8}", t, p, treatment, seed, r))
    df = spark.createDataFrame(table, "g string, truth int, predicted int, treatment string, seed int, repeat int")
    draws = bootstrap.group_draws(df, "g", 40, 5)
    comparisons, classes = validation.downstream_summary(df, draws, "g", CLASSES)
    drawn = {}
    for r in draws.collect():
        drawn.setdefault(r["draw"], {})[r["g"]] = r["multiplicity"]

    def mean(treatment, w):
        seeds = []
        for s in range(2):
            repeats = sorted({x[5] for x in table if x[3] == treatment})
            seeds.append(np.mean([macro([(x[1], x[2], w.get(x[0], 0)) for x in table if x[3:] == (treatment, s, r)]) for r in repeats]))
        return float(np.mean(seeds))

    for r in comparisons.collect():
        one = {f"g{i}": 1 for i in range(8)}
        assert math.isclose(r["difference"], mean("candidate", one) - mean(r["comparison"], one), abs_tol=1e-9)
        d = [mean("candidate", w) - mean(r["comparison"], w) for w in drawn.values()]
        assert math.isclose(r["low"], np.quantile(d, 0.025), abs_tol=1e-9) and math.isclose(r["high"], np.quantile(d, 0.975), abs_tol=1e-9)
    for r in classes.collect():
        k = r["class"]
        recall = {t: np.mean([x[2] == k for x in table if x[1] == k and x[3] == t]) for t in ("candidate", "unchanged")}
        assert math.isclose(r["recall_difference"], recall["candidate"] - recall["unchanged"], abs_tol=1e-9) and r["low"] <= r["high"]


def test_ranking_validation_figures(spark, samples):
    s = samples.withColumn("risk", F.when(F.col("is_corrupted"), 1.0).otherwise(0.0) + F.round(F.element_at("features", 2), 1) / 5)
    r = validation.ranking_validation(s, F.col("is_corrupted"), "risk", "sample_id", "group_id", bootstrap.group_draws(s, "group_id", 50, 2), budget=0.1)
    r = r.first()
    ap = ranking.average_precision(s, F.col("is_corrupted"), "risk").first()["average_precision"]
    assert math.isclose(r["ap_minus_prevalence"], ap - r["n_events"] / 180) and r["reviewed"] == 18 and r["n_groups"] == 12
    assert r["ap_low"] <= r["ap_minus_prevalence"] <= r["ap_high"] and r["precision_low"] <= r["precision_minus_prevalence"] + 0.1 and r["supported"]


def test_review_strategies_adopt_only_what_passes(spark, samples):
    train = samples.where("fold_id <> 0").withColumns({"hard_label": F.col("reference_label"), "weight": F.lit(1.0), "soft_label": F.lit(None).cast("array<double>")})
    test = samples.where("fold_id = 0").withColumn("truth", F.col("reference_label"))
    out = {r["strategy"]: r for r in validation.compare_review_strategies(train, test, CLASSES, lambda p: bootstrap.group_draws(p, "group_id", 40, 6), recall_loss=0.5).collect()}
    assert len(out) == 5 and sum(r["selected"] for r in out.values()) == 1
    passing = [r for r in out.values() if r["decision"] == "apply_candidate"]
    chosen = next(r for r in out.values() if r["selected"])
    assert chosen["strategy"] == (min(passing, key=lambda r: (-r["low"], -r["mean_difference"], r["strategy"]))["strategy"] if passing else "uncorrected_observed_labels")
    with pytest.raises(Exception, match="overlap"):
        validation.compare_review_strategies(train, train.withColumn("truth", F.col("observed_label")), CLASSES, lambda p: p)


def test_nested_validation_covers_every_row_once(samples):
    out = validation.nested_downstream(samples.where("fold_id < 2"), CLASSES, budget=0.2, inner_folds=2).cache()
    n = samples.where("fold_id < 2").count()
    by = {r["treatment"]: r["n"] for r in out.groupBy("treatment").agg(F.countDistinct("sample_id").alias("n"), F.count(F.lit(1)).alias("c")).where("n = c").collect()}
    assert by == {t: n for t in ("candidate", "unchanged", "random", "reference")}
    right = {r["treatment"]: r["a"] for r in out.groupBy("treatment").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("a")).collect()}
    assert right["reference"] >= right["unchanged"] - 0.05


def test_policy_search_returns_the_best_survivor(samples):
    """Eight policies, two of which the ranking leaves for the downstream stage."""
    found = validation.policy_search(samples.where("fold_id <> 0"), samples.where("fold_id = 0"), CLASSES, [0.1, 0.3], (2, 1)).collect()
    assert len(found) == 1 and found[0]["stage"] == "downstream" and found[0]["effect"] > 0 and -1 <= found[0]["objective"] <= 1


def test_first_distinct_and_identities(spark):
    df = spark.createDataFrame([(3, "b", 1), (1, "a", 2), (2, "a", 3), (4, None, 4), (5, "c", 5), (6, None, 6)], "at int, sha string, v int")
    assert [(r["sha"], r["v"]) for r in validation.first_distinct(df, "sha", ["at"], 3).collect()] == [("a", 2), ("b", 1), (None, 4)]
    ids = spark.createDataFrame([("x/tcga-a1-A0SK-01Z-00-DX1_id-5.png",)], "path string")
    r = validation.with_identities(ids, "path").first()
    assert (r["patient_id"], r["slide_id"], r["fov_key"]) == ("TCGA-A1-A0SK", "TCGA-A1-A0SK-01Z-00-DX1", "tcga-a1-A0SK-01Z-00-DX1_id-5.png")
    with pytest.raises(Exception, match="patient"):
        validation.with_identities(spark.createDataFrame([("nothing",), (None,)], "path string"), "path")


def test_files_are_written_whole_or_not_at_all(tmp_path):
    path = tmp_path / "a.json"
    sinks.write_json(path, {"b": 1, "a": [1.5]})
    assert json.loads(path.read_text()) == {"a": [1.5], "b": 1} and not list(tmp_path.glob("*.part*"))
    with pytest.raises(ValueError):
        sinks.write_json(tmp_path / "nan.json", {"x": float("nan")})
    with pytest.raises(FileExistsError):
        sinks.write_json(path, {})
    sinks.write_arrays(tmp_path / "x.npz", {"f": np.arange(6.0).reshape(2, 3), "ids": np.array(["a", "b"])}, {"seed": 3})
    arrays, about = sinks.read_arrays(tmp_path / "x.npz")
    assert arrays["f"].tolist() == [[0, 1, 2], [3, 4, 5]] and about["seed"] == 3
    with pytest.raises(FileExistsError):
        sinks.write_arrays(tmp_path / "x.npz", {}, {})
    (tmp_path / "x.npz").write_bytes(b"changed")
    with pytest.raises(ValueError):
        sinks.read_arrays(tmp_path / "x.npz")


def test_ledger_appends_under_a_lock(tmp_path):
    path = tmp_path / "ledger.jsonl"
    for i in range(3):
        sinks.append_record(path, {"run": i})
    records = [json.loads(x) for x in path.read_text().splitlines()]
    assert [r["run"] for r in records] == [0, 1, 2] and sinks.verify_chain(records)


def test_sqlite_tables_and_release_roles(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as con:
        con.execute("create table t (k integer, name text)")
        con.executemany("insert into t values (?, ?)", [(i % 3, f"n{i}") for i in range(9)] + [(None, None)])
    got = readers.read_sqlite(spark, str(tmp_path / "a.db"), "select k, count(distinct name) as n from t group by k", "k long, n long")
    assert {r["k"]: r["n"] for r in got.collect()} == {0: 3, 1: 3, 2: 3, None: 0}
    names = ["fold1/images/fold1/images.npy", "fold1/masks/fold1/masks.npy", "fold1/images/fold1/types.npy", "Fold 2/images.npy", "Fold 2/masks.npy", "Fold 2/types.npy"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    roles = {(r["fold_id"], r["role"]): r["path"] for r in readers.release_roles(files).collect()}
    assert len(roles) == 6 and roles[2, "tissue"] == "Fold 2/types.npy"
    for bad in (names[:5], [*names, "images.npy"], [*names, "fold1/other/images.npy"]):
        with pytest.raises(Exception):
            readers.release_roles(spark.createDataFrame([(n,) for n in bad], "path string"))
