"""Classification metrics from confusion counts and class probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.scalars import class_list, negative_log_likelihood, predicted_class, probability_of


def confusion(df: DataFrame, truth: str, predicted: str, *, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")
    )


def confusion_grid(counts: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Counts for every pair of classes, 0 where there are none."""
    each = F.explode(class_list(classes))
    grid = counts.sparkSession.range(1).select(each.alias("truth")).select("truth", each.alias("predicted"))
    return grid.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def per_class(counts: DataFrame, classes: Sequence[int], *, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 of every class in each group; 0 on an empty denominator.

    recall_or_null is null for a class that the group lacks.
    """
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")),
    )
    one = counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.class", "s.t", "s.p", "s.tp")
    groups = counts.select(*by).distinct() if by else None
    every = F.explode(class_list(classes)).alias("class")
    blank = [F.lit(0).cast("long").alias(c) for c in ("t", "p", "tp")]
    zero = groups.select(*by, every, *blank) if by else counts.sparkSession.range(1).select(every, *blank)
    sums = one.unionByName(zero).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        *by,
        "class",
        F.col("t").cast("long").alias("support"),
        share(F.col("tp"), F.col("p")).alias("precision"),
        share(F.col("tp"), F.col("t")).alias("recall"),
        share(2.0 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"),
        F.try_divide("tp", "t").alias("recall_or_null"),
    )


def macro_metrics(counts: DataFrame, classes: Sequence[int], *, by: Sequence[str] = ()) -> DataFrame:
    """Macro F1 over all classes and balanced accuracy over those with support."""
    return per_class(counts, classes, by=by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg("recall_or_null").alias("balanced_accuracy"))


def brier(probs: Column, truth: Column, classes: Sequence[int]) -> Column:
    """Sum over the classes of squared differences to the truth."""
    hit = F.zip_with(probs, class_list(classes), lambda p, c: F.pow(p - (c == truth).cast("double"), F.lit(2.0)))
    return F.aggregate(hit, F.lit(0.0), lambda a, x: a + x)


#: Edges of ten equal bins as binary fractions of evenly spaced points give them.
EDGES = tuple(i * 0.1 for i in range(10)) + (1.0,)


def calibration_bins(df: DataFrame, probs: str, truth: str, classes: Sequence[int], edges: Sequence[float] = EDGES) -> DataFrame:
    """Rows, accuracy and mean confidence by bin of the greatest probability; the last bin is closed."""
    top = F.array_max(probs)
    inner = list(edges[1:-1])
    at = F.size(F.filter(F.lit(inner), lambda e: e <= top))
    hit = (predicted_class(F.col(probs), classes) == F.col(truth)).cast("double")
    return df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(top).alias("confidence"))


def expected_calibration_error(df: DataFrame, probs: str, truth: str, classes: Sequence[int]) -> DataFrame:
    bins = calibration_bins(df, probs, truth, classes)
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def classification_summary(df: DataFrame, probs: str, truth: str, classes: Sequence[int]) -> DataFrame:
    """Accuracy, Brier score and mean negative log-likelihood."""
    p, y = F.col(probs), F.col(truth)
    return df.agg(
        F.avg((predicted_class(p, classes) == y).cast("double")).alias("accuracy"),
        F.avg(brier(p, y, classes)).alias("brier"),
        F.avg(negative_log_likelihood(p, y, classes, 1e-15)).alias("nll"),
    )


def score_distribution(df: DataFrame, score: str, *, by: Sequence[str] = ()) -> DataFrame:
    q = lambda p: F.percentile(score, F.lit(p)).alias(f"p{int(100 * p):02d}")
    return df.groupBy(*by).agg(
        F.count(score).alias("n"),
        F.min(score).alias("least"),
        F.max(score).alias("greatest"),
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        *[q(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)],
    )


def noise_matrix(counts: DataFrame, classes: Sequence[int], pseudocount: float = 1.0) -> DataFrame:
    """Row-stochastic matrix of confusions with a pseudocount off the diagonal and 0 on it."""
    from pyspark.sql import Window as W

    grid = confusion_grid(counts, classes)
    w = F.when(F.col("truth") == F.col("predicted"), F.lit(0.0)).otherwise(F.col("n") + F.lit(float(pseudocount)))
    grid = grid.withColumn("_w", w)
    return grid.select("truth", "predicted", (F.col("_w") / F.sum("_w").over(W.partitionBy("truth"))).alias("probability"))


def stratum_weights(df: DataFrame, error: Column, by: Sequence[str]) -> DataFrame:
    """Smoothed error rate (e + 1) / (n + 2) of each stratum over the greatest one."""
    rates = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(error.cast("long")).alias("errors"))
    rates = rates.withColumn("rate", (F.col("errors") + 1) / (F.col("n") + 2))
    top = rates.agg(F.max("rate").alias("_top"))
    return rates.crossJoin(F.broadcast(top)).withColumn("weight", F.col("rate") / F.col("_top")).drop("_top")


def label_issues(df: DataFrame, probs: str, label: str, classes: Sequence[int]) -> DataFrame:
    """Confident-joint counts: rows whose most likely class, among those over their class's mean self-confidence, is not
    the label.  Adds ``confident_class`` (null if no class is over its threshold) and ``is_issue``."""
    own = df.select(F.col(label).alias("c"), probability_of(F.col(probs), F.col(label), classes).alias("p"))
    limits = own.groupBy("c").agg(F.avg("p").alias("t"))
    table = limits.agg(F.map_from_entries(F.collect_list(F.struct("c", "t"))).alias("_t"))  # a row for each class
    over = F.zip_with(F.col(probs), class_list(classes), lambda p, c: F.when(p >= F.coalesce(F.element_at(F.col("_t"), c), F.lit(2.0)), p))
    out = df.crossJoin(F.broadcast(table)).withColumn("_o", over)
    best = F.get(class_list(classes), F.nullif(F.array_position(F.col("_o"), F.array_max("_o")), F.lit(0).cast("long")).cast("int") - 1)
    return out.withColumn("confident_class", best).withColumn("is_issue", F.coalesce(F.col("confident_class") != F.col(label), F.lit(False))).drop("_t", "_o")
