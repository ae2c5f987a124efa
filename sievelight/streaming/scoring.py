"""Incremental scoring of arriving samples: an extension for streams, with frozen class means per fold.

Nothing else in the library needs a stream.  Rows are scored as they come by class means that were fitted before, so
scoring keeps no state; late and repeated rows are told apart by a watermark on the arrival time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions import scalars as fn
from sievelight.operators.splits import centroids


def frozen_means(train: DataFrame, *, fold: str = "fold_id") -> dict[int, list[tuple[int, list[float]]]]:
    """Class means of the rows of all other folds, by fold: a table of folds times classes."""
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())
    return {f: sorted((r["class"], r["centroid"]) for r in centroids(train.where(F.col(fold) != f), "features", "observed_label").collect()) for f in folds}


def score(df: DataFrame, means: dict[int, list[tuple[int, list[float]]]], classes: Sequence[int], *, temperature: float = 0.1, method: str = "self_confidence") -> DataFrame:
    """Add ``probs`` and ``risk`` to rows of a stream or a table; a fold without means gives nulls."""
    probs = F.lit(None).cast("array<double>")
    for f, table in means.items():
        known = dict(table)
        distances = [-fn.l2_distance(F.col("features"), F.lit(known[c])) / temperature if c in known else F.lit(-1e9) for c in classes]
        probs = F.when(F.col("fold_id") == f, fn.softmax(F.array(*distances))).otherwise(probs)
    out = df.withColumn("probs", probs)
    return out.withColumn("risk", fn.risk(method, F.col("probs"), F.col("observed_label"), classes))


def risk_by_window(stream: DataFrame, time: str, *, window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Rows, mean and greatest risk by window of arrival and class; repeated ids within the lateness count once."""
    unique = stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["sample_id"])
    grouped = unique.groupBy(F.window(time, window).alias("w"), "observed_label")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "observed_label", "n", "mean_risk", "max_risk"
    )
