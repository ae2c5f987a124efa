"""Whole-group bootstrap: shared draws, sufficient statistics by group, and the decisions that rest on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.functions.scalars import unit_hash
from sievelight.operators.metrics import macro_metrics, per_class
from sievelight.operators.ranking import rank_rows


def group_draws(groups: DataFrame, group: str, n_draws: int, seed: int) -> DataFrame:
    """(draw, group, multiplicity): each draw takes as many groups as there are, with replacement, by hashes.

    The groups' table is a dimension: one row a group.  Groups that a draw misses have no row.
    """
    g = groups.select(group).distinct()
    g = g.withColumn("_o", (F.row_number().over(W.orderBy(group)) - 1).cast("long"))
    size = g.agg(F.count(F.lit(1)).alias("_n"))
    draws = g.sparkSession.range(n_draws).select(F.col("id").cast("int").alias("draw")).crossJoin(F.broadcast(size))
    picks = draws.select("draw", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_j"))
    picks = picks.select("draw", F.floor(unit_hash(seed, "draw", "_j") * F.col("_n")).cast("long").alias("_o"))
    picks = picks.groupBy("draw", "_o").agg(F.count(F.lit(1)).alias("multiplicity"))
    return picks.join(g, "_o").select("draw", group, "multiplicity")


def seeded_draws(spark, names: Sequence[str], n_draws: int, seed: int, group: str) -> DataFrame:
    """The same table from a NumPy generator on the driver, choosing among the sorted names."""
    names = sorted(set(names))
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n_draws):
        at, n = np.unique(rng.choice(len(names), size=len(names), replace=True), return_counts=True)
        rows += [(d, names[i], int(c)) for i, c in zip(at, n)]
    return spark.createDataFrame(rows, f"draw int, {group} string, multiplicity long")


def weighted_average_precision(points: DataFrame, draws: DataFrame, group: str, name: str) -> DataFrame:
    """Average precision of each draw from (group, threshold, n, tp) sums, without drawing rows again.

    Rows count as often as their group is drawn, so running sums of multiplicities stand for the drawn table.
    """
    weighted = points.join(draws, group)
    w = weighted.groupBy("draw", "threshold").agg(
        F.sum(F.col("n") * F.col("multiplicity")).alias("n"), F.sum(F.col("tp") * F.col("multiplicity")).alias("tp")
    )
    order = W.partitionBy("draw").orderBy(F.col("threshold").desc()).rowsBetween(W.unboundedPreceding, 0)
    w = w.withColumn("cn", F.sum("n").over(order)).withColumn("ct", F.sum("tp").over(order))
    return w.groupBy("draw").agg((F.sum(F.col("tp") * F.col("ct") / F.col("cn")) / F.nullif(F.sum("tp"), F.lit(0))).alias(name))


def score_points(df: DataFrame, event: Column, score: str, group: str) -> DataFrame:
    return df.groupBy(group, F.col(score).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(event.cast("long")).alias("tp"))


def bootstrap_average_precision(df: DataFrame, event: Column, scores: Sequence[str], group: str, draws: DataFrame) -> DataFrame:
    """(draw, one column a score) of average precisions over the same draws."""
    out = None
    for s in scores:
        one = weighted_average_precision(score_points(df, event, s, group), draws, group, s)
        out = one if out is None else out.join(one, "draw")
    return out


def summarise_differences(diffs: DataFrame, difference: str = "difference") -> DataFrame:
    """Mean, 95 % interval, P(> 0) + P(= 0) / 2, one-sided and two-sided p-values; invalid (null) draws are left out."""
    d = F.col(difference)
    n = F.count(d)
    share = lambda c: F.avg(F.when(d.isNotNull(), c.cast("double")))
    low, high = share(d <= 0), share(d >= 0)
    return diffs.agg(
        n.alias("valid_draws"),
        F.avg(d).alias("mean_difference"),
        F.percentile(d, F.lit(0.025)).alias("low"),
        F.percentile(d, F.lit(0.975)).alias("high"),
        (share(d > 0) + 0.5 * share(d == 0)).alias("probability_better"),
        ((1 + F.sum((d <= 0).cast("long"))) / (1 + n)).alias("p_one_sided"),
        F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p_two_sided"),
    )


def paired_bootstrap(df: DataFrame, event: Column, first: str, second: str, group: str, draws: DataFrame) -> DataFrame:
    """Average precision of ``first`` minus that of ``second`` over whole-group draws."""
    both = bootstrap_average_precision(df, event, [first, second], group, draws)
    return summarise_differences(both.withColumn("difference", F.col(first) - F.col(second)))


def group_confusions(df: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(group, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def drawn_confusions(counts: DataFrame, draws: DataFrame, group: str) -> DataFrame:
    joined = counts.join(draws, group)
    return joined.groupBy("draw", "truth", "predicted").agg(F.sum(F.col("n") * F.col("multiplicity")).alias("n"))


def bootstrap_macro_f1(counts: DataFrame, draws: DataFrame, group: str, classes: Sequence[int]) -> DataFrame:
    """(draw, macro_f1, balanced_accuracy) from confusion counts by group."""
    return macro_metrics(drawn_confusions(counts, draws, group), classes, by=["draw"])


def retraining_guard(
    df: DataFrame, truth: str, baseline: str, candidate: str, group: str, classes: Sequence[int], draws: DataFrame, *, minimum_effect: float = 0.0
) -> DataFrame:
    """Whether to apply a candidate: the interval of its macro F1 gain has to lie above ``minimum_effect``.

    With fewer than two groups there is no interval and the decision is to keep the baseline.
    """
    one = bootstrap_macro_f1(group_confusions(df, group, truth, baseline), draws, group, classes).select("draw", F.col("macro_f1").alias("_b"))
    two = bootstrap_macro_f1(group_confusions(df, group, truth, candidate), draws, group, classes).select("draw", F.col("macro_f1").alias("_c"))
    n = df.agg(F.countDistinct(group).alias("n_groups"))
    out = summarise_differences(one.join(two, "draw").withColumn("difference", F.col("_c") - F.col("_b"))).crossJoin(n)
    enough = F.col("n_groups") >= 2
    decision = F.when(enough & (F.col("low") > minimum_effect), "apply_candidate").otherwise("keep_baseline")
    return out.select("n_groups", "valid_draws", "mean_difference", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), decision.alias("decision"))


def multicriteria_guard(
    df: DataFrame,
    truth: str,
    baseline: str,
    candidate: str,
    group: str,
    classes: Sequence[int],
    draws: DataFrame,
    *,
    minimum_effect: float = 0.0,
    recall_loss: float = 0.01,
    valid_share: float = 0.95,
) -> DataFrame:
    """The guard with a floor for every class: the lower end of each class's recall difference may not be under
    -``recall_loss``, and at least ``valid_share`` of the draws have to say something of the class."""
    sides = []
    for name, predicted in (("_b", baseline), ("_c", candidate)):
        drawn = drawn_confusions(group_confusions(df, group, truth, predicted), draws, group)
        sides.append(per_class(drawn, classes, by=["draw"]).select("draw", "class", F.col("recall_or_null").alias(name)))
    diff = sides[0].join(sides[1], ["draw", "class"]).withColumn("d", F.col("_c") - F.col("_b"))
    by_class = diff.groupBy("class").agg(F.count("d").alias("valid"), F.count(F.lit(1)).alias("all"), F.percentile("d", F.lit(0.025)).alias("recall_low"))
    fine = (F.col("recall_low") >= -recall_loss) & (F.col("valid") >= valid_share * F.col("all"))
    classes_ok = by_class.agg(F.coalesce(F.bool_and(F.coalesce(fine, F.lit(False))), F.lit(False)).alias("classes_pass"), F.min("recall_low").alias("worst_recall_low"))
    guard = retraining_guard(df, truth, baseline, candidate, group, classes, draws, minimum_effect=minimum_effect)
    out = guard.crossJoin(classes_ok)
    both = (F.col("decision") == "apply_candidate") & F.col("classes_pass")
    return out.withColumn("decision", F.when(both, "apply_candidate").otherwise("keep_baseline"))


def retrieval_counts(df: DataFrame, event: Column, selected: Column, group: str) -> DataFrame:
    """Selected rows and found events by group: what a bootstrap of retrieval precision needs."""
    return df.groupBy(group).agg(F.sum(selected.cast("long")).alias("selected"), F.sum((selected & event).cast("long")).alias("found"))


def retrieval_summary(df: DataFrame, event: Column, candidate: Column, controls: Sequence[Column], group: str, draws: DataFrame) -> DataFrame:
    """Precision of a candidate selection minus the mean of its random controls, averaged inside each draw."""

    def precision(selected: Column, name: str) -> DataFrame:
        counts = retrieval_counts(df, event, selected, group).join(draws, group)
        share = F.sum(F.col("found") * F.col("multiplicity")) / F.nullif(F.sum(F.col("selected") * F.col("multiplicity")), F.lit(0))
        return counts.groupBy("draw").agg(share.alias(name))

    out = precision(candidate, "_c")
    for i, c in enumerate(controls):
        out = out.join(precision(c, f"_r{i}"), "draw")
    mean = sum((F.col(f"_r{i}") for i in range(len(controls))), F.lit(0.0)) / len(controls)
    return summarise_differences(out.withColumn("difference", F.col("_c") - mean))


def success_gates(row: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One row a gate, and whether all pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in gates.items()])
    return row.select(F.explode(pairs).alias("g")).select("g.gate", "g.passed").withColumn("all_passed", F.bool_and("passed").over(W.partitionBy()))


def random_rankings_precision(df: DataFrame, event: Column, row_id: str, budget: int, repeats: int, seed: int) -> DataFrame:
    """Precision of the first ``budget`` rows of seeded permutations, a row a repeat."""
    runs = df.sparkSession.range(repeats).select(F.col("id").cast("int").alias("run"))
    rows = df.select(F.col(row_id).alias("_id"), event.cast("long").alias("_e")).crossJoin(F.broadcast(runs))
    ranked = rank_rows(rows.withColumn("_u", unit_hash(seed, "run", "_id")), "_u", "_id", by=["run"])
    return ranked.where(F.col("rank") <= budget).groupBy("run").agg(F.avg("_e").alias("precision"))
