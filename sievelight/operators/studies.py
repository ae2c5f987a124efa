"""Studies over cells of scenarios: independence of feature spaces, comparisons with their statuses, validation of results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.scalars import unit_hash, valid_probabilities
from sievelight.operators.models import compare_strategies
from sievelight.operators.qc import paired_alignment, require_empty
from sievelight.operators.ranking import holm, running
from sievelight.operators.splits import restore_labels


def independence(pairs: DataFrame, spaces: DataFrame) -> DataFrame:
    """Whether an auditor's feature space is independent of the generator's of the noise.

    pairs: generator, auditor, decision; spaces: name, artifact_hash, signature.  Adds status (unverified without evidence
    on both sides, circularity_risk for the same artifact or signature or without a positive decision, else
    verified_independent) and circularity_risk, which is true unless verified.
    """
    g = spaces.select(F.col("name").alias("generator"), F.col("artifact_hash").alias("_gh"), F.col("signature").alias("_gs"))
    a = spaces.select(F.col("name").alias("auditor"), F.col("artifact_hash").alias("_ah"), F.col("signature").alias("_as"))
    j = pairs.join(g, "generator", "left").join(a, "auditor", "left")
    missing = F.col("_gh").isNull() | F.col("_ah").isNull()
    same = (F.col("_gh") == F.col("_ah")) | (F.col("_gs") == F.col("_as"))
    refused = ~F.coalesce(F.col("decision") == "verified_independent", F.lit(False))
    status = F.when(missing, "unverified").when(same | refused, "circularity_risk").otherwise("verified_independent")
    return j.withColumn("status", status).withColumn("circularity_risk", F.col("status") != "verified_independent").drop("_gh", "_gs", "_ah", "_as")


def comparison_statuses(comparisons: DataFrame, cells: DataFrame, draws: DataFrame) -> DataFrame:
    """Point and bootstrap differences of comparisons with a status; only reported ones get figures and Holm values.

    comparisons: comparison_id, cell_a, cell_b, family; cells: cell_id, circularity_risk, n_events, metric; draws: cell_id,
    draw, metric (null where a draw says nothing).  The status is the first that holds: a cell isn't available, a cell has
    a circularity risk, a cell has no events, else reported.  p is one-sided with one added above and below.
    """
    a = cells.select(F.col("cell_id").alias("cell_a"), *[F.col(c).alias(f"a_{c}") for c in ("circularity_risk", "n_events", "metric")])
    b = cells.select(F.col("cell_id").alias("cell_b"), *[F.col(c).alias(f"b_{c}") for c in ("circularity_risk", "n_events", "metric")])
    j = comparisons.join(a, "cell_a", "left").join(b, "cell_b", "left")
    status = (
        F.when(F.col("a_n_events").isNull() | F.col("b_n_events").isNull(), "not_available_frozen_optional_cell")
        .when(F.col("a_circularity_risk") | F.col("b_circularity_risk"), "excluded_circularity_risk")
        .when((F.col("a_n_events") == 0) | (F.col("b_n_events") == 0), "not_applicable_zero_corruption")
        .otherwise("reported")
    )
    j = j.withColumn("status", status)
    da, db = draws.select(F.col("cell_id").alias("cell_a"), "draw", F.col("metric").alias("_a")), draws.select(F.col("cell_id").alias("cell_b"), "draw", F.col("metric").alias("_b"))
    d = j.where("status = 'reported'").select("comparison_id", "cell_a", "cell_b").join(da, "cell_a").join(db, ["cell_b", "draw"])
    d = d.withColumn("_d", F.col("_a") - F.col("_b"))
    n = F.count("_d")
    s = d.groupBy("comparison_id").agg(
        n.alias("valid_draws"), F.avg("_d").alias("mean_difference"), F.percentile("_d", F.lit(0.025)).alias("low"), F.percentile("_d", F.lit(0.975)).alias("high"),
        ((1 + F.coalesce(F.sum((F.col("_d") <= 0).cast("long")), F.lit(0))) / (1 + n)).alias("p"),
    )
    reported = F.col("status") == "reported"
    point = F.when(reported, F.col("a_metric") - F.col("b_metric")).alias("point_difference")
    out = j.select("comparison_id", "family", "status", point).join(s, "comparison_id", "left")
    adjusted = holm(out, "p", "comparison_id", family=["family"]).select("comparison_id", "adjusted")
    return out.join(adjusted, "comparison_id", "left")


def matched_operands(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values of two methods side by side, null where a method says nothing; raises unless both have the same keys, once each."""
    for side in (first, second):
        require_empty(side.groupBy(*keys).count().where("count > 1"), "repeated operands")
    require_empty(paired_alignment(first, second, keys), "operands don't match")
    a, b = first.select(*keys, F.col(value).alias("first")), second.select(*keys, F.col(value).alias("second"))
    both = a.join(b, list(keys))
    return both.withColumn("difference", F.col("first") - F.col("second"))


def oof_violations(df: DataFrame, n_classes: int, *, expected: DataFrame | None = None) -> DataFrame:
    """What is wrong with out-of-fold predictions: repeated or missing rows, bad probabilities, groups in several folds."""
    twice = df.groupBy("sample_id").count().where("count > 1").select(F.lit("predicted_twice").alias("rule"), F.col("sample_id").alias("detail"))
    bad = df.where(~valid_probabilities(F.col("probs"), n_classes)).select(F.lit("bad_probabilities").alias("rule"), F.col("sample_id").alias("detail"))
    leak = df.groupBy("group_id").agg(F.countDistinct("fold_id").alias("n")).where("n > 1").select(F.lit("group_in_several_folds").alias("rule"), F.col("group_id").alias("detail"))
    out = twice.unionByName(bad).unionByName(leak)
    if expected is None:
        return out
    lost = expected.select("sample_id").join(df.select("sample_id"), "sample_id", "left_anti")
    return out.unionByName(lost.select(F.lit("not_predicted").alias("rule"), F.col("sample_id").alias("detail")))


def downstream_restoration(train: DataFrame, test: DataFrame, guided: Column, n_reviewed: int, classes: Sequence[int], *, repeats: int = 3, seed: int = 1, l2: float = 1e-2) -> DataFrame:
    """The same model after four treatments of the training labels, on clean test labels.

    The treatments: clean labels, corrupted ones, restoration of a random review of ``n_reviewed`` rows (repeated, by
    seed), and restoration of the guided review.
    """
    t = restore_labels(train, guided).withColumnRenamed("restored_label", "guided").withColumn("one", F.lit(1.0))
    policies = {"reference": ("pre_corruption_label", "one"), "corrupted": ("observed_label", "one"), "guided": ("guided", "one")}
    for r in range(repeats):
        placed = running(t.select("sample_id", unit_hash(f"{seed}-{r}", "sample_id").alias("_u")), {"_k": F.lit(1)}, "_u", then=["sample_id"], descending=False)
        chosen = placed.select("sample_id", (F.col("_k") <= n_reviewed).alias(f"_r{r}"))
        t = restore_labels(t.join(chosen, "sample_id"), F.col(f"_r{r}")).withColumnRenamed("restored_label", f"random_{r}").drop(f"_r{r}")
        policies[f"random_{r}"] = (f"random_{r}", "one")
    return compare_strategies(t, test, policies, "pre_corruption_label", classes, l2=l2)


def exact_finalists(candidates: DataFrame, expected: Sequence[str], pick: Callable[[DataFrame, str | None], DataFrame], family: str) -> DataFrame:
    """The winner with and without a family, after proving that the finalists are exactly the expected ones."""
    spark = candidates.sparkSession
    wanted = spark.createDataFrame([(e,) for e in expected], "candidate_sha string")
    require_empty(wanted.join(candidates, "candidate_sha", "left_anti"), "missing finalists")
    require_empty(candidates.join(wanted, "candidate_sha", "left_anti"), "unexpected finalists")
    return pick(candidates, None).withColumn("pool", F.lit("all")).unionByName(pick(candidates, family).withColumn("pool", F.lit(f"without_{family}")))
