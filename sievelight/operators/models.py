"""Out-of-fold models: multinomial logistic regression, calibration, ridge utility with conformal bounds, strategies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.functions.scalars import class_list, negative_log_likelihood, temperature_transform
from sievelight.operators.metrics import classification_summary, confusion, expected_calibration_error, macro_metrics
from sievelight.operators.qc import require_empty
from sievelight.operators.ranking import running
from sievelight.operators.splits import spanning_groups, standardisation


def scaled(df: DataFrame, stats: DataFrame, features: str = "features") -> DataFrame:
    """Add ``vector``: features less the mean over the std of ``stats`` (one row)."""
    s = df.crossJoin(F.broadcast(stats.select(F.col("mean").alias("_m"), F.col("std").alias("_s"))))
    z = F.transform(F.arrays_zip(F.col(features).alias("x"), F.col("_m").alias("m"), F.col("_s").alias("s")), lambda q: (q["x"] - q["m"]) / q["s"])
    return s.withColumn("vector", array_to_vector(z)).drop("_m", "_s")


def class_weights(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """Balanced weights n / (k n_c) as ``class_weight``."""
    n = df.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    w = n.crossJoin(F.broadcast(total)).select("_c", (F.col("_t") / (len(classes) * F.col("_n"))).alias("class_weight"))
    return df.join(F.broadcast(w), F.col(label) == F.col("_c")).drop("_c")  # a row for each class


def logistic(train: DataFrame, label: str, classes: Sequence[int], *, l2: float = 1e-3, max_iter: int = 400, weight: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Fit multinomial logistic regression; returns a function that adds ``probs`` in the order of ``classes``.

    Features are scaled by mean and population std of the training rows; the penalty leaves the biases out.  Classes
    weigh the same in total, times ``weight`` if given.
    """
    stats = standardisation(train, "features")
    t = class_weights(train, label, classes)
    t = t.withColumn("_w", F.col("class_weight") * (F.col(weight) if weight else F.lit(1.0))).where("_w > 0")
    t = scaled(t, stats).withColumn("_y", (F.array_position(class_list(classes), F.col(label)) - 1).cast("double"))
    lr = LogisticRegression(
        featuresCol="vector", labelCol="_y", weightCol="_w", family="multinomial", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9
    )
    model = lr.fit(t.select("vector", "_y", "_w"))
    known = model.numClasses

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(scaled(df, stats)).withColumn("probs", vector_to_array("probability"))
        pad = F.array(*[F.lit(0.0)] * (len(classes) - known)) if known < len(classes) else None
        out = out.withColumn("probs", F.concat("probs", pad)) if pad is not None else out
        return out.drop("vector", "rawPrediction", "probability", "prediction")

    return predict


def soft_logistic(train: DataFrame, targets: str, classes: Sequence[int], *, l2: float = 1e-3, weight: str = "weight") -> Callable[[DataFrame], DataFrame]:
    """Fit on soft targets: an ``array<double>`` of shares in the order of ``classes``, one weighted row for each class."""
    rows = train.select("*", F.posexplode(targets).alias("_k", "_t")).where("_t > 0")
    rows = rows.withColumn("_label", F.element_at(class_list(classes), F.col("_k") + 1)).withColumn("_row", F.col("_t") * F.col(weight))
    return logistic(rows.drop("_k", "_t"), "_label", classes, l2=l2, weight="_row")


def perceptron(train: DataFrame, label: str, classes: Sequence[int], *, hidden: int = 32, max_iter: int = 100, seed: int = 5) -> Callable[[DataFrame], DataFrame]:
    """One hidden layer on frozen embeddings.  Sigmoid units without dropout: an approximation of ReLU networks, not the same."""
    stats = standardisation(train, "features")
    t = scaled(train, stats).withColumn("_y", (F.array_position(class_list(classes), F.col(label)) - 1).cast("double"))
    width = len(t.select("features").first()[0])
    model = MultilayerPerceptronClassifier(featuresCol="vector", labelCol="_y", layers=[width, hidden, len(classes)], maxIter=max_iter, seed=seed).fit(t.select("vector", "_y"))
    return lambda df: model.transform(scaled(df, stats)).withColumn("probs", vector_to_array("probability")).drop("vector", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], *, fold: str = "fold_id", group: str = "group_id") -> DataFrame:
    """Predictions for each fold by a model of the other folds: a fit for each fold, and each row predicted once.

    Raises if a group spans folds.
    """
    require_empty(spanning_groups(df, group, fold), "a group spans folds")
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = [fit(df.where(F.col(fold) != f))(df.where(F.col(fold) == f)) for f in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oof_logistic(df: DataFrame, label: str, classes: Sequence[int], *, l2: float = 1e-3) -> DataFrame:
    return out_of_fold(df, lambda train: logistic(train, label, classes, l2=l2))


GRID = tuple(float(x) for x in np.exp(np.linspace(np.log(0.05), np.log(20.0), 41)))


def best_temperature(df: DataFrame, probs: str, truth: str, classes: Sequence[int], grid: Sequence[float] = GRID) -> float:
    """The temperature of the grid with the least mean negative log-likelihood, found in one aggregation."""
    tried = df.select(F.col(probs).alias("p"), F.col(truth).alias("y"), F.explode(F.lit([float(t) for t in grid])).alias("t"))
    loss = negative_log_likelihood(temperature_transform(F.col("p"), F.col("t")), F.col("y"), classes, 1e-15)
    rows = tried.groupBy("t").agg(F.avg(loss).alias("loss")).collect()  # a row for each temperature
    return min(rows, key=lambda r: (r["loss"], r["t"]))["t"]


def calibrate_cross_fitted(df: DataFrame, probs: str, truth: str, classes: Sequence[int], *, fold: str = "fold_id") -> tuple[DataFrame, dict]:
    """Temperatures fitted on the other folds; adopted if the likelihood improves and the calibration error doesn't rise."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    table = {f: best_temperature(df.where(F.col(fold) != f), probs, truth, classes) for f in folds}
    at = F.lit(None).cast("double")
    for f, t in table.items():
        at = F.when(F.col(fold) == f, F.lit(t)).otherwise(at)
    scaled_df = df.withColumn("temperature", at).withColumn("calibrated", temperature_transform(F.col(probs), F.col("temperature")))
    nll = [classification_summary(scaled_df, c, truth, classes).first()["nll"] for c in (probs, "calibrated")]
    ece = [expected_calibration_error(scaled_df, c, truth, classes).first()["ece"] for c in (probs, "calibrated")]
    adopt = nll[1] < nll[0] and ece[1] <= ece[0]
    out = scaled_df.withColumn("calibrated", F.col("calibrated") if adopt else F.col(probs)).withColumn("adopted", F.lit(adopt))
    return out, {"temperatures": table, "nll": nll, "ece": ece, "adopted": adopt}


def ridge(df: DataFrame, target: str, l2: float, features: str = "features") -> np.ndarray:
    """Weights of ridge regression, the unpenalised bias last: the Gram matrix is one distributed sum."""
    x = F.concat(F.col(features), F.array(F.lit(1.0)))
    d = len(df.select(features).first()[0]) + 1
    cross = df.select(F.posexplode(x).alias("i", "a"), x.alias("x"), F.col(target).cast("double").alias("y"))
    gram = cross.select("i", F.posexplode("x").alias("j", "b"), "a").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect()
    side = cross.groupBy("i").agg(F.sum(F.col("a") * F.col("y")).alias("s")).collect()
    a, b = np.zeros((d, d)), np.zeros(d)
    for r in gram:
        a[r["i"], r["j"]] = r["s"]
    for r in side:
        b[r["i"]] = r["s"]
    penalty = np.eye(d) * l2
    penalty[-1, -1] = 0.0
    return np.linalg.pinv(a + penalty) @ b


def ridge_predict(weights: np.ndarray, features: str = "features") -> Column:
    w = F.lit([float(x) for x in weights[:-1]])
    return F.aggregate(F.zip_with(F.col(features), w, lambda x, c: x * c), F.lit(float(weights[-1])), lambda s, x: s + x)


def conformal_radius(residuals: DataFrame, residual: str, alpha: float) -> float:
    """The residual at level min(1, ceil((m + 1)(1 - alpha)) / m), the higher of two neighbours.

    Ranks are counted in ranges, so no task sorts all residuals.
    """
    m = residuals.count()
    level = min(1.0, np.ceil((m + 1) * (1 - alpha)) / m)
    at = int(np.ceil(level * (m - 1) - 1e-12)) + 1
    counts = residuals.groupBy(F.col(residual).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    reached = running(counts, {"_upto": F.col("_c")}, "_x", descending=False)
    return float(reached.where(F.col("_upto") >= at).agg(F.min("_x")).first()[0])


def cross_fitted_utility(df: DataFrame, target: str, *, alpha: float = 0.1, l2: float = 1.0, outer: str = "fold_id", inner_splits: int = 3, group: str = "group_id") -> DataFrame:
    """Expected gain and a one-sided conformal lower bound for each row, by models that never saw its group.

    For each outer fold the other rows are cut by group into inner folds; residuals of inner predictions give the radius,
    and a model of all other rows gives the prediction.
    """
    folds = sorted(r[0] for r in df.select(outer).distinct().collect())
    inner = F.pmod(F.xxhash64(F.lit("inner"), group), F.lit(inner_splits))
    parts = []
    for f in folds:
        train = df.where(F.col(outer) != f).withColumn("_i", inner)
        held = None
        for i in range(inner_splits):
            fit, test = train.where(F.col("_i") != i), train.where(F.col("_i") == i)
            if not fit.limit(1).count() or not test.limit(1).count():
                continue
            one = test.select((ridge_predict(ridge(fit, target, l2)) - F.col(target)).alias("over"))
            held = one if held is None else held.unionByName(one)
        radius = max(0.0, conformal_radius(held, "over", alpha))
        out = df.where(F.col(outer) == f).withColumn("expected_gain", ridge_predict(ridge(train, target, l2)))
        parts.append(out.withColumn("gain_lower_bound", F.col("expected_gain") - F.lit(radius)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_strategies(train: DataFrame, test: DataFrame, policies: dict[str, tuple[str, str]], truth: str, classes: Sequence[int], *, l2: float = 1e-3) -> DataFrame:
    """Macro F1, balanced accuracy and accuracy on clean rows of the same model after each policy (label, weight columns)."""
    out = None
    for name, (label, weight) in policies.items():
        predicted = logistic(train, label, classes, l2=l2, weight=weight)(test)
        best = F.element_at(class_list(classes), F.array_position("probs", F.array_max("probs")).cast("int"))
        predicted = predicted.withColumn("_p", best)
        m = macro_metrics(confusion(predicted, truth, "_p"), classes)
        one = m.crossJoin(predicted.agg(F.avg((F.col("_p") == F.col(truth)).cast("double")).alias("accuracy"))).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("strategy", "macro_f1", "balanced_accuracy", "accuracy")


def pick_finalists(candidates: DataFrame, per_family: int, n: int) -> DataFrame:
    """Finalists: the best of each (risk_method, budget) first, at most ``per_family``, then the rest by objective."""
    order = W.partitionBy("risk_method", "budget").orderBy(F.col("objective").desc(), F.col("candidate_sha").asc())
    ranked = candidates.dropDuplicates(["candidate_sha"]).withColumn("_r", F.row_number().over(order))
    return ranked.orderBy((F.col("_r") > per_family).cast("int"), F.col("objective").desc(), F.col("candidate_sha").asc()).limit(n).drop("_r")


def pick_winner(candidates: DataFrame, excluded_family: str | None = None) -> DataFrame:
    """The best by objective, effect, lower complexity and hash; optionally without a family."""
    pool = candidates if excluded_family is None else candidates.where(F.col("risk_method") != excluded_family)
    return pool.orderBy(F.col("objective").desc(), F.col("effect").desc(), F.col("complexity").asc(), F.col("candidate_sha").asc()).limit(1)


def successive_halving(candidates: DataFrame, stages: Sequence[tuple[str, int, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Run each stage's evaluation (adds or replaces ``objective``) over what the last one left, and keep its best."""
    out = candidates
    for name, keep, evaluate in stages:
        out = evaluate(out).withColumn("stage", F.lit(name)).orderBy(F.col("objective").desc(), F.col("candidate_sha").asc()).limit(keep)
    return out
